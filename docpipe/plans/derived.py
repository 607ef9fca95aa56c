"""Views that stand in for files, jobs and parts on the supplied tables, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

KINDS = "'md','txt','html','DOCX','pdf','png','exe','csv','mhtml','xlsx'"
STATUSES = "'waiting_stable','queued','converting','waiting_parts','waiting_mineru','uploading','processing','downloading','completed','failed'"
ENGINES = "'anydoc','copy','anytomd','mineru'"

#: {pick}: an array's element by a number from 1; {div}: division of integers; {bytes}, {sha}: of the text.
VIEWS = {
    "src": "select doc_id, lang||'/'||source||'/doc-'||(doc_id {div} 60)||'.'||{pick_kind} as rel_path, {bytes} as size_bytes, 1704067200000+doc_id*1000 as modified_ms, {sha} as content_hash from documents",
    "md_docs": "select d.doc_id, d.lang||'/'||d.source||'/doc-'||d.doc_id||'.md' as rel_path, l.quality, l.toxic, 1704067200000+d.doc_id*1000 as modified_ms from documents d left join labels l using(doc_id)",
    "tasks": "select o_orderkey as id, 'p'||(o_custkey%5) as profile_id, {pick_status} as status, {pick_engine} as engine, o_orderdate as updated_at from orders",
    "parts": "select l_orderkey as parent_task_id, cast(row_number() over(partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_shipdate,l_extendedprice) as bigint) as part_index, count(*) over(partition by l_orderkey) as part_count, cast(l_quantity as bigint) as pages, case when l_linestatus='F' then 'completed' when l_returnflag='R' then 'failed' else 'processing' end as status, l_returnflag<>'N' as artifact_ready, l_shipdate as updated_at from lineitem",
    "tag_jobs": "select d.doc_id as id, 'p'||(d.doc_id%5) as profile_id, case when quality=1 and toxic=0 then 'completed' when quality=1 then 'outdated' when toxic=1 then 'failed' else 'queued' end as status, case when d.doc_id%3=0 then 'old' else 'new' end as schema_hash, least({bytes}, 32768) as read_bytes, {bytes} as total_bytes from documents d join labels using(doc_id)",
    "roots": "select 'r'||r_regionkey as id, '/'||r_name as root from region union all select 'n'||n_nationkey, '/'||r_name||'/'||n_name from nation join region on n_regionkey=r_regionkey",
    "paths": "select c_custkey as id, '/'||r_name||'/'||n_name||'/'||c_name||'.md' as path from customer join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey",
    "answers": "select doc_id, 'label_0' as label_key, cast(case when quality=1 then 0.9 else 0.5 end as double) as noul from labels union all select doc_id, 'label_1', cast(case when toxic=1 then 0.51 else 0.2 end as double) from labels",
    "messages": "select conv_id as doc_id, turn+1 as part_index, text from conversations",
    "requests": "select user_id as path, ts, case event_type when 'error' then 2 when 'purchase' then 1 else 0 end as strength from events",
    "cats": "select p_partkey as pos, case when p_partkey%2=0 then ' '||p_brand||' ' else upper(p_brand) end as name, p_type as description from part",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _fill(view: str, spark: bool) -> str:
    def pick(items: str, index: str) -> str:
        return f"element_at(array({items}), cast({index} as int))" if spark else f"list_extract([{items}], {index})"

    return VIEWS[view].format(
        div="div" if spark else "//",
        pick_kind=pick(KINDS, "(doc_id div 20)%10+1" if spark else "((doc_id//20)%10)+1"),
        pick_status=pick(STATUSES, "o_orderkey%10+1"),
        pick_engine=pick(ENGINES, "o_orderkey%4+1"),
        bytes="octet_length(text)" if spark else "octet_length(encode(text))",
        sha="sha2(text,256)" if spark else "sha256(text)",
    )


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A supplied table or a derived view."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = _fill(name, True)
    words = {w.strip("(),") for w in text.replace("(", " ").replace(")", " ").split()}
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if t in words}
    import re

    for t in used:
        text = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", text)
        text = text.replace(f"{{{t}}} d", f"{{{t}}} as d").replace(f"{{{t}}} l", f"{{{t}}} as l")
    return spark.sql(text, **used)


def ddb(views: str, body: str) -> str:
    """DuckDB SQL: the named views, then the body, which may begin with further common tables."""
    held = ", ".join(f"{v} as ({_fill(v, False)})" for v in views.split())
    body = body.strip()
    return f"with {held}, {body[5:]}" if body.lower().startswith("with ") else f"with {held} {body}"
