"""Queries over rules, answers and categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from docpipe.operators import classify as K
from docpipe.plans.derived import ddb, view

c = F.col
QUERIES, SQL = {}, {}


def query(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
NAMES = "case when pos%101=0 then '  ' when pos%97=0 then '未分类' else name end"


@query("rules_validate", ddb("cats", f"with n as (select pos, {NAMES} as name from cats), t as (select pos, {TRIM.format('name')} as k from n), r as (select *, row_number() over (partition by lower(k) order by pos) as i from t) select coalesce(case when k='' then 'empty_name' when k='未分类' then 'reserved_name' when i>1 then 'duplicate_name' end, 'ok') as outcome, count(*) as n from r group by 1"))
def rules_validate(s, d):
    labels = view(s, d, "cats").withColumn("name", F.expr(NAMES))
    return K.rule_errors(labels).groupBy(F.coalesce("error", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"))


@query("rules_hash", ddb("cats", "with g as (select pos//20 as rule_set, string_agg(name||chr(31)||description, chr(30) order by pos) as l from cats group by 1) select rule_set, sha256('multiple'||chr(30)||l) as hash from g"))
def rules_hash(s, d):
    g = view(s, d, "cats").groupBy(F.expr("pos div 20").alias("rule_set")).agg(F.array_sort(F.collect_list(F.struct("pos", "name", "description"))).alias("l"))
    return g.select("rule_set", K.rules_hash(F.lit("multiple"), c("l")).alias("hash"))


@query("question_batches", ddb("cats", "select pos//16 as batch, count(*) as n, '{'||string_agg('\"label_'||pos||'\":\"'||name||'\"', ',' order by pos)||'}' as questions from cats group by 1"))
def question_batches(s, d):
    return K.question_batches(view(s, d, "cats"))


LABELS = "select 'label_0' as label_key, 'good' as name, 0 as pos union all select 'label_1', 'toxic', 1"


@query("decision_single", "with a as (select doc_id, case when quality is null then 'x' when doc_id%10=0 then 'unclassified' when doc_id%11=0 then 'label_9' when toxic=1 then 'label_1' else 'label_0' end as choice from labels) select doc_id, case choice when 'unclassified' then '未分类' when 'label_0' then 'good' when 'label_1' then 'toxic' end as category, case when choice not in ('unclassified','label_0','label_1') then 'unknown_choice' end as error from a")
def decision_single(s, d):
    choice = F.when(c("quality").isNull(), "x").when(c("doc_id") % 10 == 0, "unclassified").when(c("doc_id") % 11 == 0, "label_9").when(c("toxic") == 1, "label_1").otherwise("label_0")
    return K.read_single(view(s, d, "labels").select("doc_id", choice.alias("choice")), s.sql(LABELS))


@query("decision_multi", ddb("answers", "with a as (select doc_id, label_key, case when doc_id%13=0 and label_key='label_1' then 1.1 when doc_id%17=0 then null else noul end as p from answers), g as (select doc_id, bool_and(p is not null and p between 0 and 1) as ok, string_agg(case when p>0.5 then case label_key when 'label_0' then 'good' else 'toxic' end end, ',' order by label_key) as names from a group by 1) select doc_id, case when ok then coalesce(names, '未分类') end as categories, case when not ok then 'invalid_answer' end as error from g"))
def decision_multi(s, d):
    p = F.when((c("doc_id") % 13 == 0) & (c("label_key") == "label_1"), 1.1).when(c("doc_id") % 17 == 0, F.lit(None)).otherwise(c("noul"))
    out = K.read_multi(view(s, d, "answers").select("doc_id", "label_key", p.alias("p")), s.sql(LABELS))
    return out.select("doc_id", F.array_join("categories", ",").alias("categories"), "error")


VALUES = "case doc_id%6 when 0 then {a}'good'{z} when 1 then {a}' toxic ', 'good', 'good'{z} when 2 then {a}'other'{z} when 3 then {a}'未分类'{z} when 4 then {a}'未分类', 'good'{z} else {e} end"


@query("answer_validate", f"""with v as (select doc_id, case when doc_id%2=0 then 'multiple' else 'single' end as mode, {VALUES.format(a='[', z=']', e='[]::varchar[]')} as vs from documents), t as (select doc_id, mode, list_transform(vs, lambda x: trim(x)) as vs from v),
 o as (select *, case when len(vs)=0 then 'empty' when mode='single' and len(vs)<>1 then 'not_single' when len(list_filter(vs, lambda x: x not in ('good','toxic','未分类')))>0 then 'unknown_category' when list_contains(vs, '未分类') and len(list_distinct(vs))>1 then 'fallback_not_alone' else 'ok' end as outcome from t)
 select doc_id, outcome, case when outcome='ok' then case when list_contains(vs, '未分类') then '未分类' else array_to_string(list_filter(['good','toxic'], lambda a: list_contains(vs, a)), ',') end end as categories from o""")
def answer_validate(s, d):
    allowed = F.array(F.lit("good"), F.lit("toxic"))
    values = F.expr(VALUES.format(a="array(", z=")", e="cast(array() as array<string>)"))
    x = view(s, d, "documents").select("doc_id", F.when(c("doc_id") % 2 == 0, "multiple").otherwise("single").alias("mode"), values.alias("vs"))
    x = x.withColumn("outcome", K.submitted(c("vs"), c("mode"), allowed))
    return x.select("doc_id", "outcome", F.when(c("outcome") == "ok", F.array_join(K.canonical(c("vs"), allowed), ",")).alias("categories"))


@query("apply_rules", ddb("md_docs tag_jobs", "select 'existing' as mode, 'queue' as action, count(*) as n from md_docs union all select 'future', case when j.id is null then 'record_cancelled' else 'mark_outdated' end, count(*) from md_docs left join tag_jobs j on id=doc_id group by 2 union all select 'off', 'cancel', count(*) from tag_jobs where status in ('queued','outdated')"))
def apply_rules(s, d):
    files = view(s, d, "md_docs").select(c("doc_id").alias("path"))
    jobs = view(s, d, "tag_jobs").select(c("id").alias("path"), "status")
    out = None
    for mode, on, existing in (("existing", True, True), ("future", True, False), ("off", False, False)):
        x = K.apply_rules(files, jobs, on, existing).groupBy("action").agg(F.count("*").alias("n")).select(F.lit(mode).alias("mode"), "action", "n")
        out = x if out is None else out.unionByName(x)
    return out


@query("stale_results", ddb("src", "select doc_id, case when doc_id%10=0 then 'gone' when doc_id%7=0 then 'conflict' else 'applied' end as outcome from src"))
def stale_results(s, d):
    x = view(s, d, "src")
    results = x.select(c("rel_path").alias("path"), "doc_id", F.when(c("doc_id") % 7 == 0, "old").otherwise(c("content_hash")).alias("read_hash"))
    return K.compare_and_set(results, x.where("doc_id % 10 <> 0").select(c("rel_path").alias("path"), "content_hash")).select("doc_id", "outcome")


@query("late_results", ddb("src", """select doc_id, case when doc_id%5=2 or doc_id%5=3 and doc_id%4=0 or doc_id%5=4 and doc_id%6=0 then 'cancelled' when doc_id%10=0 then 'gone' when doc_id%7=0 then 'conflict' when doc_id%9=0 then 'outdated' else 'applied' end as outcome from src"""))
def late_results(s, d):
    """Results of five profiles, one of them off, one gone for some results' ids, one set up anew; of older contents and of older rules."""
    x = view(s, d, "src").withColumn("profile_id", F.when((c("doc_id") % 5 == 4) & (c("doc_id") % 6 == 0), "removed").otherwise(F.concat(F.lit("p"), (c("doc_id") % 5).cast("string"))))
    results = x.select(
        "doc_id", F.concat_ws("#", "rel_path", "doc_id").alias("path"), "profile_id", F.when(c("doc_id") % 7 == 0, "old").otherwise(c("content_hash")).alias("read_hash"),
        F.when(c("doc_id") % 9 == 0, "rules-1").otherwise("rules-2").alias("read_rules"), F.when((c("doc_id") % 5 == 3) & (c("doc_id") % 4 == 0), 1).otherwise(2).alias("read_epoch"),
    )
    profiles = x.where("profile_id <> 'removed'").select("profile_id").distinct().select("profile_id", (c("profile_id") != "p2").alias("enabled"), F.lit("rules-2").alias("rules_hash"), F.lit(2).alias("epoch"))
    documents = x.where("doc_id % 10 <> 0").select(F.concat_ws("#", "rel_path", "doc_id").alias("path"), "content_hash")
    return K.late_results(results, documents, profiles).select("doc_id", "outcome")


@query("result_categories", "select event_id, case event_id%5 when 0 then '' when 1 then 'a'||user_id when 2 then '' when 3 then 'b,'||event_type else '' end as categories from events")
def result_categories(s, d):
    """Stored results read leniently: what is no array counts as empty, and only texts are kept."""
    text = F.element_at(F.array(F.lit("{broken"), F.concat(F.lit('["a'), c("user_id").cast("string"), F.lit('", 3, null]')), F.lit('{"a": 1}'), F.concat(F.lit('["b", "'), c("event_type"), F.lit('", [1]]')), F.lit(None)), (c("event_id") % 5 + 1).cast("int"))
    items = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>")
    kept = F.transform(F.filter(F.coalesce(items, F.array().cast("array<variant>")), lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))
    return view(s, d, "events").select("event_id", F.array_join(kept, ",").alias("categories"))


OLD = "select pos, name, description from cats where pos%3=0"
NEW = "select pos, ' '||name||' ' as name, case when pos%3=0 then description||'!' else description end as description from cats where pos%4<>1"
KEY = f"lower({TRIM.format('name')})"


@query("category_import_preview", ddb("cats", f"with o0 as ({OLD}), n as ({NEW}), o as (select * from o0 qualify row_number() over (partition by {KEY} order by pos)=1) select n.pos, lower({TRIM.format('n.name')}) as key, case when o.pos is null then 'added' when o.description=n.description then 'identical' else 'conflict' end as outcome from n left join o on lower({TRIM.format('n.name')})=lower({TRIM.format('o.name')})"))
def category_import_preview(s, d):
    return K.import_preview(view(s, d, "cats").selectExpr("pos", "' '||name||' ' as name", "case when pos%3=0 then description||'!' else description end as description").where("pos%4<>1"), once(view(s, d, "cats").where("pos%3=0")))


def once(rules):
    """The first rule of each name."""
    key = F.lower(F.trim("name"))
    first = rules.groupBy(key.alias("k")).agg(F.min_by(F.struct("pos", "name", "description"), "pos").alias("r"))
    return first.select("r.*")


@query("category_import_merge", ddb("cats", f"with o0 as ({OLD}), n0 as ({NEW}), o as (select *, {KEY} as k from o0 qualify row_number() over (partition by {KEY} order by pos)=1), n as (select *, {KEY} as k from n0 qualify row_number() over (partition by {KEY} order by pos)=1) select (row_number() over (order by o.pos nulls last, n.pos))::int as place, coalesce(o.name, {TRIM.format('n.name')}) as name, case when n.pos is not null then n.description else o.description end as description from o full join n on o.k=n.k"))
def category_import_merge(s, d):
    new = view(s, d, "cats").selectExpr("pos", "' '||name||' ' as name", "case when pos%3=0 then description||'!' else description end as description").where("pos%4<>1")
    return K.import_merge(once(new), once(view(s, d, "cats").where("pos%3=0")), overwrite=True)


@query("category_import_validate", ddb("cats", """with b as (select pos//10 as batch, count(*) as n, min(pos) as p, count(*) filter (pos%40=7) as w from cats group by 1), k as (select pos//10 as batch, pos%10 as i, row_number() over (partition by pos//10 order by pos) as place, lower(trim(name)) as key, pos from cats),
 e as (select batch, place, case when pos%70=3 then 'bad_item' when pos%90=5 then 'empty_name' when row_number() over (partition by batch, case when pos%70=3 then 'bad'||pos when pos%90=5 then '' else key end order by pos)>1 then 'duplicate_name' end as error from k),
 f as (select batch, count(*) as n, min(case when error is not null then place end) as error_position, min_by(error, case when error is not null then place end) as error from e group by 1)
 select batch, case when batch%9=4 then 0 else n end as n, case when batch%9=4 then 0 else error_position end as error_position, case when batch%9=4 then 'not_an_array' else error end as error from f"""))
def category_import_validate(s, d):
    """Batches of ten, some items of which carry a number for a text or an empty name, and some of which are no array."""
    item = F.when(c("pos") % 70 == 3, F.concat(F.lit('{"name": 1, "description": "'), c("description"), F.lit('"}'))).when(c("pos") % 90 == 5, F.lit('{"name": "  ", "description": ""}'))
    item = item.otherwise(F.to_json(F.struct("name", "description")))
    g = view(s, d, "cats").groupBy(F.expr("pos div 10").alias("batch")).agg(F.array_sort(F.collect_list(F.struct("pos", item.alias("j")))).alias("l"))
    text = F.concat(F.lit("["), F.array_join(F.transform("l", lambda x: x["j"]), ","), F.lit("]"))
    return K.category_batches(g.select("batch", F.when(c("batch") % 9 == 4, F.lit('{"name": "x"}')).otherwise(text).alias("json")))
