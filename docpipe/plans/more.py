"""Queries over retries, assets, requests and changes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docpipe.functions import paths as P
from docpipe.functions import text as T
from docpipe.operators import classify as K
from docpipe.operators import convert as V
from docpipe.operators import inventory as I
from docpipe.operators import parts as R
from docpipe.operators import search_index as search
from docpipe.operators import state as S
from docpipe.operators.order import numbered
from docpipe.plans import rules
from docpipe.plans.derived import ddb, view
from docpipe.sources.tables import scratch

c = F.col
QUERIES, SQL = {}, {}


def query(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@query("retry_actions", ddb("tasks parts", """with t as (select id, status, id%7 as h, case when id%3=0 then id%7+1 else id%7 end as now_h from tasks where id%5<>0), f as (select parent_task_id as id, part_index from parts where status='failed')
 select id, part_index, 'reset_part' as action from t join f using (id) where h=now_h union all select id, 0, case when h<>now_h then 'requeue' else 'reset' end from t where h<>now_h and (status='failed' or id in (select id from f)) or status='failed' and id not in (select id from f)"""))
def retry_actions(s, d):
    t = view(s, d, "tasks").select("id", "status", (c("id") % 7).alias("source_hash"))
    now = t.where("id % 5 <> 0").select("id", (c("source_hash") + F.when(c("id") % 3 == 0, 1).otherwise(0)).alias("content_hash"))
    return S.retry_actions(t, view(s, d, "parts"), now).withColumn("part_index", F.coalesce("part_index", F.lit(0)))


@query("first_wins", ddb("parts", "select parent_task_id, status, part_index, pages from parts qualify row_number() over (partition by parent_task_id, status order by part_index)=1"))
def first_wins(s, d):
    return S.first_wins(view(s, d, "parts").select("parent_task_id", "status", "part_index", "pages"), ["parent_task_id", "status"], "part_index")


@query("asset_numbers", "with r as (select l_orderkey as doc_id, l_partkey as resource, min(l_linenumber*100000000+l_partkey) as pos from lineitem group by all) select doc_id, resource, 'mhtml-'||lpad((row_number() over (partition by doc_id order by pos)-1)::varchar, 4, '0')||'.png' as name from r")
def asset_numbers(s, d):
    refs = view(s, d, "lineitem").select(c("l_orderkey").alias("doc_id"), (c("l_linenumber") * F.lit(100000000).cast("long") + c("l_partkey")).alias("position"), c("l_partkey").alias("resource"), F.lit("png").alias("ext"))
    return V.numbered_assets(refs)


@query("merged_warnings", ddb("messages", "with e as (select doc_id, part_index, unnest(['w'||(part_index%3), 'all']) as w, unnest([0, 1]) as k from messages), f as (select doc_id, w, min(part_index*2+k) as pos from e group by all) select doc_id, string_agg(w, ',' order by pos) as warnings from f group by 1"))
def merged_warnings(s, d):
    m = view(s, d, "messages").select("doc_id", "part_index", F.array(F.concat(F.lit("w"), (c("part_index") % 3).cast("string")), F.lit("all")).alias("warnings"))
    return V.merged_warnings(m).select("doc_id", F.array_join("warnings", ",").alias("warnings"))


@query("request_bodies", "select doc_id, sha256('{\"model\":\"m\",\"state\":{\"document\":\"'||lang||'/'||source||'\",\"truncated\":'||case when n_chars>32768 then 'true' else 'false' end||'},\"questions\":{\"label_0\":\"good\"}}') as body_sha256 from documents")
def request_bodies(s, d):
    body = K.request_body("m", F.concat_ws("/", "lang", "source"), c("n_chars") > 32768, F.create_map(F.lit("label_0"), F.lit("good")))
    return view(s, d, "documents").select("doc_id", F.sha2(body, 256).alias("body_sha256"))


@query("missing_requested", ddb("src requests", "with r as (select distinct 'en/src'||(path%20)||'/doc-'||(path%40)||'.md' as path from requests) select path from r where path not in (select rel_path from src)"))
def missing_requested(s, d):
    asked = view(s, d, "requests").select(F.concat(F.lit("en/src"), (c("path") % 20).cast("string"), F.lit("/doc-"), (c("path") % 40).cast("string"), F.lit(".md")).alias("path"))
    return I.missing_requested(asked, view(s, d, "src"))


@query("file_strategy", ddb("tasks", "select case when id*40000>200000000 then 'split' when id%700>200 then 'ranges' else 'direct' end as strategy, count(*) as n from tasks group by 1"))
def file_strategy(s, d):
    return view(s, d, "tasks").groupBy(R.strategy(c("id") * 40000, c("id") % 700).alias("strategy")).agg(F.count("*").alias("n"))


@query("times", ddb("src tasks", "select doc_id, strftime(epoch_ms(modified_ms), '%Y-%m-%d %H:%M') as index_time, strftime(epoch_ms(modified_ms), '%m-%d %H:%M') as list_time, strftime(epoch_ms(modified_ms), '%Y%m%d-%H%M%S')||'.'||lpad((modified_ms%1000)::varchar, 3, '0') as stamp from src"))
def times(s, d):
    at = F.timestamp_millis("modified_ms")
    return view(s, d, "src").select("doc_id", F.date_format(at, "yyyy-MM-dd HH:mm").alias("index_time"), F.date_format(at, "MM-dd HH:mm").alias("list_time"), F.date_format(at, "yyyyMMdd-HHmmss.SSS").alias("stamp"))


@query("folder_depth", ddb("md_docs", "with f as (select distinct regexp_extract(rel_path, '^(.*)/[^/]*$', 1) as folder from md_docs) select folder, len(string_split(folder, '/'))::int as depth, row_number() over (order by len(string_split(folder, '/')) desc, folder)::int as place from f"))
def folder_depth(s, d):
    """Folders, the deepest first: the order in which they are pruned."""
    f = view(s, d, "md_docs").select(P.parent(c("rel_path")).alias("folder")).distinct().withColumn("depth", F.size(F.split("folder", "/")))
    return numbered(f.select("folder", "depth"), [], [-c("depth"), c("folder")])


@query("failure_status", "with e as (select ['mineru','copy'][event_id%2+1] as engine, ['network_timeout','mineru_not_configured','file_in_use','service_unavailable','unexpected_error'][event_id%5+1] as code from events) select engine, code, case when engine='mineru' and code in ('network_timeout','service_unavailable','mineru_not_configured') then 'waiting_mineru' else 'failed' end as status, count(*) as n from e group by all")
def failure_status(s, d):
    e = view(s, d, "events").selectExpr("element_at(array('mineru','copy'), cast(event_id%2+1 as int)) as engine", "element_at(array('connection timed out','MinerU token missing','file is being used','HTTP 503','odd'), cast(event_id%5+1 as int)) as message")
    e = e.withColumn("code", T.error_class(c("message")))
    return e.groupBy("engine", "code", T.failure_status(c("engine"), c("code")).alias("status")).agg(F.count("*").alias("n"))


@query("breadcrumbs", ddb("md_docs", "with f as (select distinct regexp_extract(rel_path, '^(.*)/[^/]*$', 1) as folder from md_docs), p as (select folder, string_split(folder, '/') as ps from f) select folder, '[Knowledge index]('||repeat('../', len(ps)::bigint)||'index.md) / '||case when len(ps)>1 then '['||ps[1]||'](../index.md) / ' else '' end||ps[-1] as line from p"))
def breadcrumbs(s, d):
    return view(s, d, "md_docs").select(P.parent(c("rel_path")).alias("folder")).distinct().select("folder", P.breadcrumbs(c("folder")).alias("line"))


@query("single_question", ddb("cats", """with k as (select pos, name, (pos-1)//100 as set_id from cats where pos>50 union all select pos, name, -1 from cats), p as (select set_id, row_number() over (partition by set_id order by pos)-1 as pos, name from k)
 select set_id, count(*) as n, case when count(*)<=254 then '['||string_agg('{"id":"label_'||pos||'","name":"'||name||'"}', ',' order by pos)||',{"id":"unclassified","name":"未分类"}]' end as options, case when count(*)>254 then 'too_many_options' end as error from p group by 1"""))
def single_question(s, d):
    """Rule sets of a hundred labels, and one of all of them, which is too large."""
    k = view(s, d, "cats")
    sets = k.where("pos > 50").select("pos", "name", F.expr("(pos - 1) div 100").alias("set_id")).union(k.select("pos", "name", F.lit(-1).cast("long")))
    placed = numbered(sets, ["set_id"], [c("pos")])
    return K.single_question(placed.select("set_id", (c("place") - 1).alias("pos"), "name"), "set_id")


@query("import_result", ddb("cats", f"with o0 as ({rules.OLD}), n as ({rules.NEW}), o as (select * from o0 qualify row_number() over (partition by {rules.KEY} order by pos)=1), p as (select case when o.pos is null then 'added' when o.description=n.description then 'identical' else 'conflict' end as outcome from n left join o on lower(trim(n.name))=lower(trim(o.name))) select count(*) filter (outcome='added') as added, count(*) filter (outcome='identical') as skipped, count(*) filter (outcome='conflict') as overwritten from p"))
def import_result(s, d):
    preview = rules.category_import_preview(s, d)
    return K.import_result(preview, overwrite=True)


@query("missing_images", "select doc_id, n||' images are missing' as warning from (select l_orderkey as doc_id, count(*) filter (l_quantity<10) as n from lineitem group by 1) where n>0")
def missing_images(s, d):
    refs = view(s, d, "lineitem").select(c("l_orderkey").alias("doc_id"), (c("l_quantity") >= 10).alias("found"))
    return V.missing_image_warnings(refs)


_NEEDLES = ("DOC-1", "doc-12", " .pdf ", "en/", "x", "s", "-1", "rc1/doc", "nothing like it", "c", "1", "")


@query("search_index", ddb("src", f"with n as (select distinct lower(trim(x)) as needle from unnest([{', '.join(repr(x) for x in _NEEDLES)}]) as t(x)) select needle, doc_id from src, n where contains(lower(rel_path), needle)"))
def search_index(s, d):
    """All files whose path contains each of some texts, short ones and the empty one too, by an index of trigrams."""
    texts = view(s, d, "src").select(c("doc_id").alias("id"), c("rel_path").alias("text"))
    path = f"{scratch(s)}/docpipe/search-{uuid.uuid4().hex}"
    search.build(texts, path)
    return search.found(s, path, texts, _NEEDLES).select("needle", c("id").alias("doc_id"))
