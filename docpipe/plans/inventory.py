"""Queries over files, tasks and folders."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docpipe.functions import paths as P
from docpipe.operators import index as X
from docpipe.operators import inventory as I
from docpipe.operators.increment import FolderIndex
from docpipe.operators.order import numbered
from docpipe.plans.derived import ddb, view
from docpipe.sources.tables import scratch

ENABLED = ("md", "html", "PDF", "docx", "csv", "png")
c = F.col
LIST = lambda xs: ", ".join(f"'{x}'" for x in xs)
# Values are written out here, not taken from the functions that the SQL checks.
TEXTS = "'txt','html','htm','mhtml','mht'"
LOCALS = f"'md','doc','docx','docm','xls','xlsx','xlsm','xlsb','ppt','pps','pot','pptx','pptm','ppsx','ppsm','odt','ods','odp','rtf','epub','pdf','csv',{TEXTS}"
OCRS = "'png','jpg','jpeg','webp','bmp'"
SUPPORTED = f"({LOCALS},{OCRS})"
PENDING = "'waiting_stable','queued','waiting_mineru'"
ACTIVE = "'converting','waiting_parts','uploading','processing','downloading'"
EXT = "nullif(lower(regexp_extract(rel_path, '^.*/[^/]+\\.([^./]+)$', 1)), '')"
PARENT = "regexp_extract(rel_path, '^(.*)/[^/]*$', 1)"
NAME = "regexp_extract(rel_path, '([^/]*)$', 1)"
STEM = "regexp_replace(regexp_extract(rel_path, '([^/]*)$', 1), '\\.[^.]+$', '')"
E_ENGINE = f"case when {EXT}='md' then 'copy' when {EXT} in ({TEXTS}) then 'text' when {EXT} in ({LOCALS}) then 'document' when {EXT} in ({OCRS}) then 'ocr' end"
DOCS = "md as (select rel_path, modified_ms, case when quality is null then []::varchar[] when quality=1 and toxic=1 then ['good','toxic'] when quality=1 then ['good'] when toxic=1 then ['toxic'] else ['other'] end as categories, string_split(rel_path, '/') as ps from md_docs)"
FOLDERS = DOCS + ", folders as (select *, unnest(list_transform(range(0, len(ps)), lambda n: array_to_string(ps[1:n], '/'))) as folder from md)"


def classified(spark, d):
    m = view(spark, d, "md_docs")
    cats = F.when(c("quality").isNull(), F.array().cast("array<string>")).when((c("quality") == 1) & (c("toxic") == 1), F.array(F.lit("good"), F.lit("toxic")))
    cats = cats.when(c("quality") == 1, F.array(F.lit("good"))).when(c("toxic") == 1, F.array(F.lit("toxic"))).otherwise(F.array(F.lit("other")))
    return m.select("doc_id", "rel_path", "modified_ms", cats.alias("categories"))


def snapshot(spark, d):
    """Files beside an older state of their tasks: every 7th file is new, every 5th changed its time, every 11th has a legacy row."""
    s = view(spark, d, "src")
    status = F.element_at(F.array(*[F.lit(x) for x in ("completed", "failed", "queued", "waiting_mineru", "converting", "completed")]), (c("doc_id") % 6 + 1).cast("int"))
    known = c("doc_id") % 7 != 0
    return s.select(
        "doc_id", "rel_path", "size_bytes", "modified_ms", "content_hash", F.when(known, status).alias("status"),
        F.when(known & (c("doc_id") % 11 != 0), c("size_bytes")).alias("task_size"), F.when(known & (c("doc_id") % 11 != 0), c("modified_ms") - F.when(c("doc_id") % 5 == 0, 1000).otherwise(0)).alias("task_ms"),
        F.when(known, F.when(c("doc_id") % 13 == 0, "elsewhere.md").otherwise(F.concat("rel_path", F.lit(".md")))).alias("task_output"),
        F.when(known & (c("doc_id") % 3 != 0), c("modified_ms") + F.when(c("doc_id") % 2 == 0, 5).otherwise(-5)).alias("output_ms"),
    )


SNAP = """snap as (select doc_id, rel_path, size_bytes, modified_ms, content_hash, case when doc_id%7<>0 then ['completed','failed','queued','waiting_mineru','converting','completed'][doc_id%6+1] end as status,
 case when doc_id%7<>0 and doc_id%11<>0 then size_bytes end as task_size, case when doc_id%7<>0 and doc_id%11<>0 then modified_ms - case when doc_id%5=0 then 1000 else 0 end end as task_ms,
 case when doc_id%7<>0 then case when doc_id%13=0 then 'elsewhere.md' else rel_path||'.md' end end as task_output,
 case when doc_id%7<>0 and doc_id%3<>0 then modified_ms + case when doc_id%2=0 then 5 else -5 end end as output_ms from src)"""
QUERIES, SQL = {}, {}


def query(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@query("src_inventory", ddb("src", f"select rel_path, size_bytes::bigint as size_bytes, {EXT} as ext, {EXT} in {SUPPORTED} as supported, {EXT} in ({LIST(x.lower() for x in ENABLED)}) as enabled from src where {EXT} in {SUPPORTED}"))
def src_inventory(s, d):
    p = c("rel_path")
    return view(s, d, "src").where(P.is_supported(p)).select("rel_path", c("size_bytes").cast("long").alias("size_bytes"), P.extension(p).alias("ext"), P.is_supported(p).alias("supported"), P.is_enabled(p, ENABLED).alias("enabled"))


@query("engine_routing", ddb("src", f"select coalesce({E_ENGINE}, 'none') as engine, count(*) as n, sum(size_bytes)::bigint as bytes from src group by 1"))
def engine_routing(s, d):
    return view(s, d, "src").groupBy(F.coalesce(P.engine(c("rel_path")), F.lit("none")).alias("engine")).agg(F.count("*").alias("n"), F.sum(c("size_bytes").cast("long")).alias("bytes"))


@query("size_guard", ddb("src", f"select rel_path, coalesce({EXT}='md', false) or size_bytes*(200000) <= case when {EXT}='pdf' then 1073741824 else 536870912 end as fits from src where {EXT} in {SUPPORTED}"))
def size_guard(s, d):
    """Sizes scaled up, so that both sides of the limits occur."""
    return view(s, d, "src").where(P.is_supported(c("rel_path"))).select("rel_path", P.size_ok(c("rel_path"), c("size_bytes").cast("long") * 200000).alias("fits"))


@query("content_hash", ddb("src", "select content_hash, count(*) as copies, min(doc_id) as first_id from src group by content_hash"))
def content_hash(s, d):
    return view(s, d, "src").groupBy("content_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))


@query("output_path", ddb("src", f"""with k as (select *, {EXT} as x, {PARENT} as folder, {STEM} as stem, {NAME} as name from src), u as (select *, count(*) over (partition by folder, lower(stem)) > 1 as collides from k where x in {SUPPORTED}),
 o as (select rel_path, collides, folder||'/'||case when x='md' then name when collides then name||'.md' else stem||'.md' end as output_path from u) select *, regexp_replace(output_path, '\\.md$', '')||'.assets' as asset_dir from o"""))
def output_path(s, d):
    return I.planned_outputs(view(s, d, "src")).select("rel_path", "collides", "output_path", "asset_dir")


ODD = "case doc_id%6 when 0 then rel_path when 1 then '../'||rel_path when 2 then '/'||rel_path when 3 then replace(rel_path, '/', '//') when 4 then replace(rel_path, 'doc', '..') else replace(rel_path, '/', '/../') end"


@query("path_safety", ddb("src", f"with o as (select doc_id, {ODD} as path from src) select path, not list_has_any(string_split(path, '/'), ['', '.', '..']) as safe from o"))
def path_safety(s, d):
    return view(s, d, "src").select(F.expr(ODD).alias("path")).select("path", P.is_safe_relative(c("path")).alias("safe"))


# Names get two more runs of digits: up to 34 digits long, and with leading zeros. DuckDB compares them as numbers, in a struct of what the names are made of.
_LONG = "'v'||(doc_id%4)||repeat('7', ((doc_id//4)%33)::int)||'-'||repeat('0', (doc_id%3)::int)||doc_id"


@query("natural_sort", ddb("src", f"""with k as (select rel_path, {PARENT} as folder, {_LONG} as mark, doc_id, {NAME} as name from src)
 select folder, rel_path, mark, row_number() over (partition by folder order by ((doc_id%4)::varchar||repeat('7', ((doc_id//4)%33)::int))::hugeint, doc_id, rel_path)::int as place from k"""))
def natural_sort(s, d):
    """Files of a folder by a mark with long runs of digits: by value, not by text."""
    mark = F.expr("concat('v', doc_id % 4, repeat('7', cast((doc_id div 4) % 33 as int)), '-', repeat('0', cast(doc_id % 3 as int)), doc_id)")
    f = view(s, d, "src").select("rel_path", P.parent(c("rel_path")).alias("folder"), mark.alias("mark"))
    return numbered(f.select("folder", "rel_path", "mark"), ["folder"], [P.natural_key(c("mark")), c("rel_path")])


@query("natural_names", ddb("src", f"""with k as (select distinct {PARENT} as folder, {NAME} as name, rel_path from src), p as (select *, regexp_extract(name, '^([^0-9]*)', 1) as a, regexp_extract(name, '^[^0-9]*([0-9]+)', 1)::bigint as n, lower(regexp_extract(name, '^[^0-9]*[0-9]+(.*)$', 1)) as z from k)
 select folder, rel_path, row_number() over (partition by folder order by a, n, z, rel_path)::int as place from p"""))
def natural_names(s, d):
    """Files of a folder in the order of their names, doc-2 before doc-10."""
    f = view(s, d, "src").select("rel_path", P.parent(c("rel_path")).alias("folder")).distinct()
    return numbered(f.select("folder", "rel_path"), ["folder"], [P.natural_key(P.file_name(c("rel_path"))), c("rel_path")])


@query("ext_normalize", f"select doc_id, array_to_string(list_filter(list_filter(xs, lambda x, i: list_position(xs, x) = i), lambda x: x in {SUPPORTED}), ',') as exts from (select doc_id, list_transform([' .'||upper(lang), 'MD', '..pdf ', source, 'md', 'html'], lambda x: lower(ltrim(trim(x), '.'))) as xs from documents)")
def ext_normalize(s, d):
    raw = F.array(F.concat(F.lit(" ."), F.upper("lang")), F.lit("MD"), F.lit("..pdf "), c("source"), F.lit("md"), F.lit("html"))
    known = F.array(*[F.lit(x) for x in (*P.LOCAL_EXTENSIONS, *P.OCR_EXTENSIONS)])
    xs = F.transform(raw, lambda x: F.lower(F.regexp_replace(F.trim(x), r"^\.+", "")))
    return view(s, d, "documents").select("doc_id", F.array_join(F.array_distinct(F.filter(xs, lambda x: F.array_contains(known, x))), ",").alias("exts"))


ODD_PATHS = "case doc_id%8 when 0 then rel_path when 1 then replace(rel_path, 'doc', 'x.assets/doc') when 2 then '.trash/'||rel_path when 3 then rel_path||'.tmp' when 4 then replace(rel_path, 'doc', '~$doc') when 5 then lang_dir||'/INDEX.md' when 6 then replace(rel_path, 'doc', 'A.ASSETS/doc') else replace(rel_path, 'doc', 'n.docpipe.tmp1') end"


@query("markdown_discovery", ddb("md_docs", f"""with p as (select {ODD_PATHS.replace('lang_dir', "regexp_extract(rel_path, '^([^/]*)', 1)")} as path from md_docs), q as (select path, string_split(path, '/') as ps, string_split(lower(path), '/') as lo from p)
 select path, not (lo[-1]='index.md' or len(list_filter(lo, lambda x: x='.trash' or ends_with(x, '.assets') or contains(x, '.docpipe.tmp') or starts_with(x, '~$')))>0) as indexed,
 not (list_contains(ps, '.trash') or ends_with(ps[-1], '.tmp') or contains(ps[-1], '.docpipe.tmp') or starts_with(ps[-1], '~$')) as classified,
 len(list_filter(ps, lambda x: x='.trash' or ends_with(x, '.assets') or contains(x, '.docpipe.tmp')))=0 as watched from q"""))
def markdown_discovery(s, d):
    p = view(s, d, "md_docs").select(F.expr(ODD_PATHS.replace("lang_dir", "substring_index(rel_path, '/', 1)")).alias("path"))
    return p.select("path", (~P.excluded_from_index(c("path"))).alias("indexed"), (~P.excluded_from_classification(c("path"))).alias("classified"), (~P.excluded_from_changes(c("path"))).alias("watched"))


@query("folder_rollup", ddb("md_docs", f"with {FOLDERS} select folder, count(*) as documents, count(*) filter (len(categories)>0) as classified, count(*) filter (len(categories)=0) as pending, max(modified_ms) as last_modified_ms from folders group by folder"))
def folder_rollup(s, d):
    return X.folder_rollup(classified(s, d))


@query("category_view", ddb("md_docs", f"""with {FOLDERS}, e as (select folder, unnest(case when len(categories)=0 then [null] else categories end) as category from folders), g as (select folder, category, count(*) as documents from e group by all)
 select *, row_number() over (partition by folder order by category is null, case category when 'toxic' then 0 when 'good' then 1 else 2 end, category)::int as place from g"""))
def category_view(s, d):
    return X.category_view(classified(s, d), ["toxic", "good"])


@query("recent_documents", ddb("md_docs", f"with {FOLDERS}, r as (select folder, row_number() over (partition by folder order by modified_ms desc nulls last, rel_path)::int as rank, rel_path from folders) select * from r where rank <= 10"))
def recent_documents(s, d):
    return X.recent_documents(classified(s, d))


@query("folder_listing", ddb("md_docs", f"""with {FOLDERS}, e as (select distinct regexp_extract(folder, '^(.*)/[^/]*$', 1) as folder, folder as entry, 'directory' as kind from folders where folder<>'' union all select regexp_extract(rel_path, '^(.*)/[^/]*$', 1), rel_path, 'file' from md)
 select *, row_number() over (partition by folder order by kind, lower(entry), entry)::int as place from e"""))
def folder_listing(s, d):
    return X.folder_listing(classified(s, d))


@query("index_changed", ddb("md_docs", f"with {FOLDERS}, a as (select folder, count(*) as n from folders group by 1), b as (select folder, count(*) filter (modified_ms%3000<>0) as n from folders where folder<>'' group by 1) select a.folder, 'documents: '||a.n as page from a left join b using (folder) where a.n is distinct from b.n"))
def index_changed(s, d):
    f = X.in_folders(classified(s, d))
    page = F.concat(F.lit("documents: "), c("n").cast("string")).alias("page")
    new = f.groupBy("folder").agg(F.count("*").alias("n")).select("folder", page)
    old = f.where("folder <> ''").groupBy("folder").agg(F.count_if(c("modified_ms") % 3000 != 0).alias("n")).select("folder", page)
    return X.changed_pages(new, old)


@query("index_stale", ddb("md_docs", f"with {FOLDERS}, have as (select distinct replace(folder, '/src1', '/gone1') as folder from folders where folder<>'') select folder from have where folder not in (select folder from folders)"))
def index_stale(s, d):
    docs = classified(s, d)
    have = X.in_folders(docs).select(F.replace("folder", F.lit("/src1"), F.lit("/gone1")).alias("folder")).distinct()
    return X.stale_pages(have, docs)


_KINDS = "case when quality is null then []::varchar[] when quality=1 and toxic=1 then ['good','toxic'] when quality=1 then ['good'] when toxic=1 then ['toxic'] else ['other'] end"


@query("index_increment", ddb("md_docs", f"""with now as (select rel_path, case when here then modified_ms when doc_id%13=0 then modified_ms-1000000000 else modified_ms end as modified_ms, case when not here and doc_id%5=0 then []::varchar[] else {_KINDS} end as categories
  from (select *, split_part(rel_path, '/', 1) in ('de', 'fr') as here from md_docs) where case when here then doc_id%11<>0 else doc_id%7<>3 end),
 folders as (select *, unnest(list_transform(range(0, len(string_split(rel_path, '/'))), lambda n: array_to_string(string_split(rel_path, '/')[1:n], '/'))) as folder from now),
 newest as (select *, row_number() over (partition by folder order by modified_ms desc nulls last, rel_path) as k from folders)
 select folder, count(*) as documents, count(*) filter (len(categories)>0) as classified, count(*) filter (len(categories)=0) as pending, max(modified_ms) as last_modified_ms, string_agg(rel_path, '|' order by k) filter (k<=10) as newest from newest group by folder"""))
def index_increment(s, d):
    """An index of what was, put up to date by what came, changed and went in two languages; its folders after that."""
    docs, here = classified(s, d), F.split("rel_path", "/")[0].isin("de", "fr")
    none = F.array().cast("array<string>")
    was = docs.where(c("doc_id") % 7 != 3).select("rel_path", F.when(c("doc_id") % 5 == 0, none).otherwise(c("categories")).alias("categories"), (c("modified_ms") - F.when(c("doc_id") % 13 == 0, 1000000000).otherwise(0)).alias("modified_ms"), F.lit(False).alias("gone"), F.lit(0).cast("long").alias("seq"))
    moved = (c("doc_id") % 7 == 3) | (c("doc_id") % 5 == 0) | (c("doc_id") % 11 == 0) | (c("doc_id") % 13 == 0)
    changes = docs.where(here & moved).select("rel_path", "categories", "modified_ms", (c("doc_id") % 11 == 0).alias("gone"), c("doc_id").alias("seq"))
    index = FolderIndex(s, f"{scratch(s)}/docpipe/index-{uuid.uuid4().hex}")
    index.apply(was, 0)
    index.apply(changes, 1)
    newest = index.recent().groupBy("folder").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "rel_path"))), lambda x: x["rel_path"]), "|").alias("newest"))
    return index.rollup().where("documents > 0").join(newest, "folder", "left")


_UP = "repeat('../', case when folder='' then 0 else len(string_split(folder, '/')) end::bigint)"
# The way from a folder to a path: the part of it below the folder, or up to the root and down.
_LINK = "case when folder='' then {p} when starts_with({p}, folder||'/') then substr({p}, length(folder)+2) else " + _UP + "||{p} end"
_STEM = "regexp_replace(regexp_extract({p}, '([^/]*)$', 1), '\\.[^.]+$', '')"
_ITEM = "'- ['||" + _STEM + "||']('||" + _LINK + "||')'||chr(10)"
_MARK = "regexp_replace({p}, '([\\\\*_\\[\\]<>#`|])', '\\\\\\1', 'g')"


@query("index_render", ddb("md_docs", f"""with {FOLDERS}, roll as (select folder, count(*) as n, count(*) filter (len(categories)>0) as done, max(modified_ms) as ms from folders group by 1),
 entries as (select distinct regexp_extract(folder, '^(.*)/[^/]*$', 1) as folder, folder as entry, 0 as kind from folders where folder<>'' union all select regexp_extract(rel_path, '^(.*)/[^/]*$', 1), rel_path, 1 from md),
 cats as (select folder, rel_path, category from (select folder, rel_path, unnest(categories) as category from folders) union all select folder, rel_path, null from folders where len(categories)=0),
 sizes as (select folder, category, count(*) as n from cats group by all),
 newest as (select folder, rel_path, row_number() over (partition by folder order by modified_ms desc, rel_path) as k from folders),
 lines as (select folder, 1 as section, -1 as rank, '' as category, 0 as kind, '' as low, '' as entry, chr(10)||'## Browse by folder'||chr(10)||chr(10) as line from roll union all select folder, 2, -1, '', 0, '', '', chr(10)||'## Browse by category'||chr(10)||chr(10) from roll union all select folder, 3, -1, '', 0, '', '', chr(10)||'## Recently updated'||chr(10)||chr(10) from roll
  union all select folder, 1, 0, '', kind, lower(entry), entry, case kind when 0 then '- [**'||regexp_extract(entry, '([^/]*)$', 1)||'/**]('||{_LINK.format(p="entry")}||'/index.md)'||chr(10) else {_ITEM.format(p="entry")} end from entries
  union all select folder, 2, case when category is null then 1 else 0 end, coalesce(category, ''), 0, '', '', '### '||{_MARK.format(p="coalesce(category, 'Pending classification')")}||' ('||n||')'||chr(10)||chr(10) from sizes
  union all select folder, 2, case when category is null then 1 else 0 end, coalesce(category, ''), 2, '', '', chr(10) from sizes
  union all select folder, 2, case when category is null then 1 else 0 end, coalesce(category, ''), 1, lower(rel_path), rel_path, {_ITEM.format(p="rel_path")} from cats
  union all select folder, 3, k::int, '', 0, '', '', {_ITEM.format(p="rel_path")} from newest where k<=10),
 placed as (select folder, line, row_number() over (partition by folder order by section, rank, category, kind, low, entry) - 1 as place from lines),
 parts as (select folder, (place//1000+1)::int as part, string_agg(line, '' order by place) as body from placed group by all),
 k as (select *, max(part) over (partition by folder) as parts, case when folder='' then 'Knowledge index' else regexp_extract(folder, '([^/]*)$', 1) end as name, string_split(folder, '/') as ps from parts join roll using (folder))
 select folder, part, parts, case when part=1 then '# '||{_MARK.format(p="name")}||chr(10)||chr(10)||'> Corpus · '||n||' documents · '||done||' classified · '||(n-done)||' pending'||chr(10)||'> Last document update: '||strftime(epoch_ms(ms), '%Y-%m-%d %H:%M')||chr(10)
  ||case when folder='' then '' else chr(10)||'> [Knowledge library]('||{_UP}||'index.md) / '||case when len(ps)>1 then '['||ps[1]||'](../index.md) / ' else '' end||ps[-1]||chr(10) end else '# '||{_MARK.format(p="name")}||' · '||part||'/'||parts||chr(10)||chr(10) end
  ||body||case when part<parts then chr(10)||'['||(part+1)||'/'||parts||'](index-'||(part+1)||'.md)'||chr(10) else '' end as page from k"""))
def index_render(s, d):
    return X.rendered(classified(s, d), profile="Corpus")


@query("prune_folders", ddb("md_docs", f"with {FOLDERS}, all_ as (select distinct replace(folder, '/src', '/was') as path from folders union select distinct folder from folders), used as (select distinct folder from folders where rel_path not like '%/src2/%') select path from all_ where path<>'' and path not in (select folder from used) and path not in (select folder from folders where rel_path like '%/src3/%')"))
def prune_folders(s, d):
    docs = classified(s, d)
    f = X.in_folders(docs).select("folder")
    all_ = f.select(F.replace("folder", F.lit("/src"), F.lit("/was")).alias("path")).union(f.select(c("folder").alias("path"))).distinct()
    return I.prunable_folders(docs.where(~c("rel_path").contains("/src2/")), docs.where(c("rel_path").contains("/src3/")), all_)


@query("relative_link", ddb("md_docs", """with l as (select doc_id, rel_path, string_split(regexp_extract(rel_path, '^(.*)/[^/]*$', 1), '/') as a, string_split(lag(rel_path) over (order by doc_id), '/') as b from md_docs),
 k as (select *, list_max(list_filter(range(0, len(a)+1), lambda n: a[1:n]=b[1:n])) as m from l where b is not null) select doc_id, repeat('../', (len(a)-m)::bigint)||array_to_string(b[m+1:], '/') as link from k"""))
def relative_link(s, d):
    """A link from each document's folder to the document before it by id."""
    m = numbered(view(s, d, "md_docs").select("doc_id", "rel_path"), [], [c("doc_id")])
    before = m.select((c("place") + 1).alias("place"), c("rel_path").alias("target"))
    return m.join(before, "place").select("doc_id", P.relative_link(P.parent(c("rel_path")), c("target")).alias("link"))


@query("link_encode", r"""with t as (select doc_id, replace(text, chr(10), ' ') as name from documents) select doc_id,
 md5(array_to_string(list_transform(regexp_extract_all(name, '.'), lambda x: case when regexp_matches(x, '[\p{L}\p{N}\-_.~/]') then x else regexp_replace(upper(hex(encode(x))), '(..)', '%\1', 'g') end), '')) as link,
 md5(array_to_string(list_transform(regexp_extract_all(name, '.'), lambda x: case when regexp_matches(x, '[A-Za-z0-9\-_.~/]') then x else regexp_replace(upper(hex(encode(x))), '(..)', '%\1', 'g') end), '')) as encoded,
 md5(regexp_replace(name, '([\\\[\]])', '\\\1', 'g')) as link_text, md5(regexp_replace(name, '([\\*_\[\]<>#`|])', '\\\1', 'g')) as plain from t""")
def link_encode(s, d):
    name = F.replace("text", F.lit("\n"), F.lit(" "))
    return view(s, d, "documents").select("doc_id", F.md5(P.link_encode(name)).alias("link"), F.md5(P.percent_encode(name)).alias("encoded"), F.md5(P.escape_link_text(name)).alias("link_text"), F.md5(P.escape_markdown(name)).alias("plain"))


FLIGHT = f"'failed','waiting_mineru',{ACTIVE}"


@query("queue_decision", ddb("src", f"""with {SNAP}, x as (select *, doc_id%17=0 as force, coalesce(task_output=rel_path||'.md', false) as same_out, status='completed' and output_ms is not null as done from snap)
 select doc_id, case when force then 'queue' when coalesce(task_size=size_bytes and task_ms=modified_ms, false) and same_out and (done or status in ({FLIGHT})) then 'skip'
 when status is not null and (task_size is null or task_ms is null) and same_out and done and output_ms>=modified_ms then 'adopt'
 when status is not null and (task_size is null or task_ms is null) and same_out and (done or status in ('failed','waiting_mineru')) then 'verify' else 'queue' end as action from x"""))
def queue_decision(s, d):
    return snapshot(s, d).select("doc_id", I.queue_decision(c("doc_id") % 17 == 0, c("size_bytes"), c("modified_ms"), F.concat("rel_path", F.lit(".md")), c("task_size"), c("task_ms"), c("task_output"), c("status"), c("output_ms")).alias("action"))


@query("prepare_decision", ddb("src", f"with {SNAP} select doc_id, case when doc_id%4<>0 and task_output=rel_path||'.md' and (status='completed' and output_ms is not null or status in ({FLIGHT})) then 'refresh' else 'queue' end as action from snap"))
def prepare_decision(s, d):
    same_output = c("task_output") == F.concat("rel_path", F.lit(".md"))
    return snapshot(s, d).select("doc_id", I.prepare_decision(c("doc_id") % 4 != 0, c("status"), c("output_ms").isNotNull(), same_output).alias("action"))


@query("ocr_required", ddb("src", f"select doc_id, doc_id%8=0 as ocr_required, case when doc_id%8=0 then 'ocr' else coalesce({E_ENGINE}, 'none') end as engine from src"))
def ocr_required(s, d):
    """Verdicts of every 4th document, half of them on a content that it no longer has."""
    src = view(s, d, "src")
    verdicts = src.where("doc_id % 4 = 0").select("rel_path", F.when(c("doc_id") % 8 == 0, c("content_hash")).otherwise("another content").alias("ocr_required_hash"))
    out = I.with_ocr_verdicts(src, verdicts)
    return out.select("doc_id", "ocr_required", F.when(c("ocr_required"), "ocr").otherwise(F.coalesce(P.engine(c("rel_path")), F.lit("none"))).alias("engine"))


@query("remaining_parts", ddb("tasks parts", "select p.parent_task_id, p.part_index from parts p join tasks t on p.parent_task_id=t.id where t.id%3<>0 and t.id%11<>0 union all select parent_task_id, part_index from parts where parent_task_id not in (select id from tasks)"))
def remaining_parts(s, d):
    """Every 3rd task has another content now, every 11th is forced."""
    t = view(s, d, "tasks").select("id", c("id").cast("string").alias("source_hash"), F.when(c("id") % 3 == 0, "other").otherwise(c("id").cast("string")).alias("content_hash"), (c("id") % 11 == 0).alias("force"))
    return I.remaining_parts(view(s, d, "parts"), t).select("parent_task_id", "part_index")


@query("source_changed", ddb("src", f"with {SNAP} select doc_id, coalesce(status='completed' and (coalesce(task_size<>size_bytes, false) or coalesce(task_ms<>modified_ms, false)), false) as changed, output_ms is not null as output_available from snap"))
def source_changed(s, d):
    return snapshot(s, d).select("doc_id", F.coalesce(I.source_changed(c("status"), c("task_size"), c("size_bytes"), c("task_ms"), c("modified_ms")), F.lit(False)).alias("changed"), c("output_ms").isNotNull().alias("output_available"))


@query("classify_eligible", ddb("src", f"with {SNAP} select coalesce(case when doc_id%19=0 then 'rules_off' when status is null then 'no_task' when status<>'completed' then 'not_completed' when not coalesce(task_size=size_bytes and task_ms=modified_ms, false) then 'source_changed' when output_ms is null then 'output_missing' when task_output<>rel_path||'.md' then 'output_moved' else 'eligible' end) as reason, count(*) as n from snap group by 1"))
def classify_eligible(s, d):
    x = snapshot(s, d)
    same = F.coalesce((c("task_size") == c("size_bytes")) & (c("task_ms") == c("modified_ms")), F.lit(False))
    reason = I.classification_eligible(c("doc_id") % 19 != 0, c("status"), same, F.concat("rel_path", F.lit(".md")), c("task_output"), c("output_ms").isNotNull())
    return x.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("file_filter", ddb("src", f"""with {SNAP}, a as (select *, {EXT} as x from snap), b as (select *, case when doc_id%23=0 then 'unreadable' when x not in {SUPPORTED} or x is null then 'unsupported' when x not in ({LIST(x.lower() for x in ENABLED)}) then 'disabled' else 'eligible' end as av from a)
 select case when av='unreadable' then 'unreadable' when status is not null then case when status in ({PENDING}) then 'pending' when status in ({ACTIVE}) then 'active' else status end when av='eligible' then 'untracked' else av end as class, count(*) as n from b group by 1"""))
def file_filter(s, d):
    av = I.availability(c("rel_path"), ENABLED, F.when(c("doc_id") % 23 == 0, "unreadable"))
    return snapshot(s, d).groupBy(I.file_class(av, c("status")).alias("class")).agg(F.count("*").alias("n"))


@query("file_search", ddb("src", f"with h as (select rel_path, string_split(rel_path, '/') as ps from src where contains(lower({NAME}), 'doc-1')) select rel_path as path, 'file' as kind from h union all select distinct unnest(list_transform(range(1, len(ps)), lambda n: array_to_string(ps[1:n], '/'))), 'directory' from h"))
def file_search(s, d):
    return I.search(view(s, d, "src"), " DOC-1 ")


@query("reconcile_missing", ddb("src", f"with {SNAP} select rel_path as source_path, 'p'||(doc_id%5) as profile_id, status from snap where status is not null and doc_id%9=0 and doc_id%5<>2 and doc_id%4<>1"))
def reconcile_missing(s, d):
    x = snapshot(s, d).withColumnRenamed("rel_path", "source_path").withColumn("profile_id", F.concat(F.lit("p"), (c("doc_id") % 5).cast("string")))
    roots = x.select("profile_id").distinct().withColumn("available", c("profile_id") != "p2")
    return I.missing_sources(x.select("source_path", "profile_id", "status"), x.where("doc_id % 9 <> 0"), roots, x.where("doc_id % 4 = 1")).select("source_path", "profile_id", "status")


@query("delete_policy", ddb("md_docs", "with t as (select doc_id as id, rel_path as output_path, ['keep','trash','delete'][doc_id%3+1] as action from md_docs), p as (select id, action, unnest([output_path, regexp_replace(output_path, '\\.md$', '')||'.assets']) as path from t) select id, path, action, case when action='trash' then '.trash/20240101-000000.000-'||id||'/'||path end as target from p"))
def delete_policy(s, d):
    t = view(s, d, "md_docs").select(c("doc_id").alias("id"), c("rel_path").alias("output_path"))
    policy = F.element_at(F.array(F.lit("keep"), F.lit("trash"), F.lit("delete")), (c("id") % 3 + 1).cast("int"))
    return I.delete_actions(t, policy, F.lit("20240101-000000.000"))


@query("previous_output", ddb("src", f"with {SNAP} select doc_id, task_output as old_output from snap where task_output is not null and task_output<>rel_path||'.md' and not starts_with(task_output, '/')"))
def previous_output(s, d):
    x = snapshot(s, d)
    return x.where((c("task_output") != F.concat("rel_path", F.lit(".md"))) & P.is_safe_relative(c("task_output"))).select("doc_id", c("task_output").alias("old_output"))


@query("drop_disabled", ddb("src", f"with {SNAP} select doc_id from snap where status in ({PENDING}) and coalesce({EXT} not in ({LIST(x.lower() for x in ENABLED)}), true)"))
def drop_disabled(s, d):
    return snapshot(s, d).where(c("status").isin(*I.PENDING) & ~P.is_enabled(c("rel_path"), ENABLED)).select("doc_id")


@query("longest_prefix", ddb("roots paths", "select p.id, max_by(r.id, length(r.root)) as root_id from paths p join roots r on starts_with(p.path, r.root||'/') group by p.id"))
def longest_prefix(s, d):
    return I.longest_prefix(view(s, d, "paths"), view(s, d, "roots"))


@query("profile_overlap", ddb("roots", 'select a.id as "outer", b.id as "inner" from roots a join roots b on a.id<>b.id and (b.root=a.root or starts_with(b.root, a.root||\'/\'))'))
def profile_overlap(s, d):
    return I.overlaps(view(s, d, "roots"))
