"""Queries over texts and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from docpipe.functions import paths as P
from docpipe.functions import text as T
from docpipe.operators import convert as V
from docpipe.operators import roots
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


HEAD = "'---'||chr(10)||'title: t'||chr(10)||'categories:'||chr(10)||'  - old'||chr(10)||'---'||chr(10)"


@query("decision_input", "with k as (select doc_id, case when doc_id%3=0 then '---'||chr(10)||'title: t'||chr(10)||'---'||chr(10)||text when doc_id%7=1 then null else text end as body from documents), m as (select doc_id, body, case when strlen(body)<=4096 then length(body) else list_max(list_filter(range(1024, 4097), lambda k: strlen(substr(body, 1, k))<=4096)) end as n from k) select doc_id, sha256(substr(body, 1, n)) as input_sha256 from m")
def decision_input(s, d):
    """Every 3rd document has front matter with old categories; some are blank."""
    t = view(s, d, "documents").select("doc_id", F.when(c("doc_id") % 3 == 0, F.concat(F.expr(HEAD), "text")).when(c("doc_id") % 7 == 1, F.lit(" \n\t")).otherwise(c("text")).alias("t"))
    return t.select("doc_id", F.sha2(V.decision_input(c("t"), 4096), 256).alias("input_sha256"))


FLOW = """case doc_id%7 when 0 then 'categories: ['||lang||', "'||source||'", 3, true, '||lang||', null]  # kinds' when 1 then 'categories:'||chr(10)||'- '||lang||chr(10)||'- 4.5'||chr(10)||'- "'||source||'"  # so'||chr(10)||'- "  "' when 2 then 'categories: [broken' when 3 then 'categories: '||lang
 when 4 then 'categories: ['||chr(39)||'it'||chr(39)||chr(39)||'s '||lang||chr(39)||', "a, b"]' when 5 then '- '||lang else 'categories:'||chr(10)||'  - "'||lang||'"'||chr(10)||'  - {a: 1}'||chr(10)||'  - yes' end"""


@query("frontmatter_forms", "select doc_id, case doc_id%7 when 0 then lang||'|'||source when 1 then lang||'|'||source when 4 then 'it''s '||lang||'|a, b' when 6 then lang||'|yes' else '' end as categories from documents")
def frontmatter_forms(s, d):
    """Categories in any form of YAML: in brackets and in blocks, quoted or not, with items that are no text, broken, and none."""
    yaml = T.frontmatter(F.expr(f"'---'||chr(10)||{FLOW}||chr(10)||'---'||chr(10)||text"))
    return view(s, d, "documents").select("doc_id", F.array_join(V.category_list(yaml), "|").alias("categories"))


@query("decision_prefix", "with k as (select doc_id, text, case when strlen(text)<=32768 then length(text) else list_max(list_filter(range(8192, 32769), lambda k: strlen(substr(text, 1, k))<=32768)) end as n from documents) select doc_id, sha256(substr(text, 1, n)) as prefix_sha256, strlen(text)>32768 as truncated from k")
def decision_prefix(s, d):
    """What a decision reads: 32 KiB at most, cut between characters."""
    return view(s, d, "documents").select("doc_id", F.sha2(T.utf8_prefix(c("text"), 32768), 256).alias("prefix_sha256"), (F.octet_length("text") > 32768).alias("truncated"))


FRONT = "'---'||chr(10)||'title: doc'||doc_id||chr(10)||'categories:'||chr(10)||'  - '||lang||chr(10)||'  - {q}'||source||'{q}'||chr(10)||'  - '||lang||chr(10)||case doc_id%3 when 0 then '---'||chr(10) when 1 then '...'||chr(10) else '' end||text"


@query("frontmatter_extract", "select doc_id, case when doc_id%3<2 then 'title: doc'||doc_id||chr(10)||'categories:'||chr(10)||'  - '||lang||chr(10)||'  - \"'||source||'\"'||chr(10)||'  - '||lang||chr(10) end as yaml from documents")
def frontmatter_extract(s, d):
    return view(s, d, "documents").select("doc_id", T.frontmatter(F.expr(FRONT.format(q='"'))).alias("yaml"))


@query("frontmatter_categories", "select doc_id, case when doc_id%3<2 then lang||','||source end as categories from documents")
def frontmatter_categories(s, d):
    yaml = T.frontmatter(F.expr(FRONT.format(q='"')))
    return view(s, d, "documents").select("doc_id", F.when(yaml.isNotNull(), F.array_join(T.frontmatter_list(yaml, "categories"), ",")).alias("categories"))


@query("frontmatter_merge", "select doc_id, sha256(case when doc_id%3<2 then '---'||chr(10)||'title: doc'||doc_id||chr(10)||'categories:'||chr(10)||'  - good'||chr(10)||'  - '||lang||chr(10)||case doc_id%3 when 0 then '---' else '...' end||chr(10)||text else '---'||chr(10)||'categories:'||chr(10)||'  - good'||chr(10)||'  - '||lang||chr(10)||'---'||chr(10)||text end) as markdown_sha256 from documents")
def frontmatter_merge(s, d):
    docs = view(s, d, "documents")
    text = F.when(c("doc_id") % 3 < 2, F.expr(FRONT.format(q='"'))).otherwise(c("text"))
    out = V.categorized(docs.select("doc_id", text.alias("text"), F.array(F.lit("good"), c("lang")).alias("categories")))
    return out.select("doc_id", F.sha2("markdown", 256).alias("markdown_sha256"))


BLOCK = "'n: '||doc_id||chr(10)"
PAGE = f"case doc_id%5 when 0 then text when 1 then 'intro'||chr(10)||'<!-- docpipe:index:start -->'||chr(10)||'old'||chr(10)||'<!-- docpipe:index:end -->'||chr(10)||'tail' when 2 then '' when 3 then text||'<!-- docpipe:index:start --> torn' else text||chr(10)||chr(10) end"


@query("managed_block", f"""with p as (select doc_id, text, {BLOCK} as block, '<!-- docpipe:index:start -->'||chr(10)||{BLOCK}||'<!-- docpipe:index:end -->' as new from documents) select doc_id, sha256(case doc_id%5 when 0 then text||case when ends_with(text, chr(10)||chr(10)) then '' when ends_with(text, chr(10)) then chr(10) else chr(10)||chr(10) end||new||chr(10)
 when 1 then 'intro'||chr(10)||new||chr(10)||'tail' when 2 then new||chr(10) when 3 then null else text||chr(10)||chr(10)||new||chr(10) end) as page_sha256 from p""")
def managed_block(s, d):
    """Pages without a block, with one, empty, with torn markers and ending in a blank line."""
    return view(s, d, "documents").select("doc_id", F.sha2(T.merge_managed(F.expr(PAGE), F.expr(BLOCK)), 256).alias("page_sha256"))


@query("managed_remove", "select doc_id, sha256(regexp_replace(text||repeat(chr(10), 5)||'tail', '\\n{3,}', chr(10)||chr(10), 'g')) as page_sha256 from documents")
def managed_remove(s, d):
    page = F.expr(f"text||'\n\n\n'||'<!-- docpipe:index:start -->'||'\nold\n'||'<!-- docpipe:index:end -->'||'\n\ntail'")
    return view(s, d, "documents").select("doc_id", F.sha2(T.remove_managed(page), 256).alias("page_sha256"))


@query("converted_document", ddb("src", "with t as (select s.*, d.text from src s join documents d using (doc_id)) select doc_id, sha256('---'||chr(10)||'source: \"'||rel_path||'\"'||chr(10)||'source_sha256: \"'||content_hash||'\"'||chr(10)||'converter: text'||chr(10)||'converted_at: 2024-01-01T00:00:00+00:00'||chr(10)||'warnings: [\"w'||(doc_id%3)||'\"]'||chr(10)||'---'||chr(10)||chr(10)||ltrim(text)) as markdown_sha256 from t"))
def converted_document(s, d):
    t = view(s, d, "src").join(view(s, d, "documents").select("doc_id", "text"), "doc_id")
    head = T.build_frontmatter(c("rel_path"), c("content_hash"), F.lit("text"), F.lit("2024-01-01T00:00:00+00:00"), F.array(F.concat(F.lit("w"), (c("doc_id") % 3).cast("string"))))
    return t.select("doc_id", F.sha2(F.concat(head, F.lit("\n"), F.ltrim("text")), 256).alias("markdown_sha256"))


@query("md_passthrough", ddb("src", "select doc_id, content_hash as written_hash, true as same from src where regexp_matches(rel_path, '\\.md$')"))
def md_passthrough(s, d):
    """Markdown is kept byte for byte."""
    src = view(s, d, "src").where(P.engine(c("rel_path")) == "copy")
    t = src.join(view(s, d, "documents").select("doc_id", c("text").cast("binary").alias("content")), "doc_id")
    return t.select("doc_id", F.sha2("content", 256).alias("written_hash"), (F.sha2("content", 256) == c("content_hash")).alias("same"))


@query("text_to_md", "select doc_id, sha256(text) as markdown_sha256, trim(text)='' as empty from documents")
def text_to_md(s, d):
    return view(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("markdown_sha256"), (F.trim("text") == "").alias("empty"))


MD = "'![a](images/x y'||doc_id||'.png) [b](./images/b.png) <img src=\"images/b.png\"> [c](<images/c d.png>) '||case when doc_id%2=0 then 'images/e%20f.png' else '' end"
ASSETS = ("images/b.png", "images/c d.png", "images/e f.png", "images/none.png")


@query("asset_refs", "with a as (select doc_id, unnest(['images/b.png','images/c d.png','images/e f.png','images/none.png']) as asset from documents) select doc_id, asset from a where asset in ('images/b.png','images/c d.png') or asset='images/e f.png' and doc_id%2=0")
def asset_refs(s, d):
    docs = view(s, d, "documents").select("doc_id", F.expr(MD).alias("markdown"))
    return V.asset_links(docs, docs.select("doc_id", F.explode(F.array(*[F.lit(a) for a in ASSETS])).alias("asset")), P.percent_encode)


@query("asset_rewrite", "select doc_id, '![a](images/x y'||doc_id||'.png) [b](doc.assets/b.png) <img src=\"doc.assets/b.png\"> [c](<images/c d.png>) '||case when doc_id%2=0 then 'images/e%20f.png' else '' end as markdown from documents")
def asset_rewrite(s, d):
    return view(s, d, "documents").select("doc_id", T.rewrite_assets(F.expr(MD), F.lit("images/b.png"), F.lit("doc.assets/b.png")).alias("markdown"))


@query("redact_paths", ddb("paths", "select id, replace(replace('failed at '||path||' key sk-'||id, '/EUROPE', '<input:eu>'), 'key sk-', 'key ***') as message from paths"))
def redact_paths(s, d):
    x = F.concat(F.lit("failed at "), c("path"), F.lit(" key sk-"), c("id").cast("string"))
    return view(s, d, "paths").select("id", T.redact(x, [("/EUROPE", "<input:eu>"), ("key sk-", "key ***")]).alias("message"))


@query("redact_roots", "select c_custkey as id, 'failed at <nation:'||n_name||'>/'||c_name||'.md, root <region:'||r_name||'>, not /nowhere' as message from customer join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey")
def redact_roots(s, d):
    """Messages in which regions' and nations' roots are masked, the longer one where both begin."""
    region = view(s, d, "region")
    nation = view(s, d, "nation").join(region, c("n_regionkey") == c("r_regionkey"))
    masks = {f"/{x['r_name']}": f"<region:{x['r_name']}>" for x in region.collect()}  # as configured: some tens
    masks |= {f"/{x['r_name']}/{x['n_name']}": f"<nation:{x['n_name']}>" for x in nation.collect()}
    text = F.concat(F.lit("failed at "), c("path"), F.lit(", root /"), F.split("path", "/")[1], F.lit(", not /nowhere"))
    return view(s, d, "paths").select("id", roots.redact(s, text, masks).alias("message"))


@query("nearest_roots", ddb("roots paths", "select p.id, max_by(r.id, length(r.root)) as root_id from paths p left join roots r on starts_with(p.path, r.root||'/') group by p.id"))
def nearest_roots(s, d):
    """The deepest root of each path, by a trie of roots in tasks; the same as longest_prefix gives by joins."""
    known = {x["root"]: x["id"] for x in view(s, d, "roots").collect()}  # as configured: some tens
    return view(s, d, "paths").select("id", roots.nearest_root(s, c("path"), known).alias("root_id"))


_WORDS = [w for _, ws in T.ERRORS for w in ws] + ["pdf 超过 512 mib", "all is well"]
_LIST = ", ".join(f"'{w}'" for w in _WORDS)
# The rules in order, written out: regular expressions over the lower-cased message.
_CASES = """when regexp_matches(m, '未知转换引擎') then 'engine_version_mismatch' when regexp_matches(m, '未配置 mineru|mineru token|凭据库') then 'mineru_not_configured' when regexp_matches(m, '429|too many requests|rate limit|限流') then 'service_rate_limited'
 when regexp_matches(m, 'timeout|timed out|超时') then 'network_timeout' when regexp_matches(m, '500|502|503|504|server error|服务错误') then 'service_unavailable' when regexp_matches(m, '决策模型|system one') then 'decision_model_error'
 when regexp_matches(m, 'tool calling|tool_call|未调用分类工具|不支持工具') then 'agent_tool_calling' when regexp_matches(m, 'agent api key|未配置 agent|模型名称不能为空') then 'agent_not_configured' when regexp_matches(m, '最大调用|超过轮次|调用轮次|参数不合法|schema') then 'agent_invalid_response'
 when regexp_matches(m, '超过 1 gib|1 gib 本地预处理安全上限') then 'pdf_source_too_large' when regexp_matches(m, '超过 512 mib|512 mib 本地预处理安全上限') and contains(m, 'pdf') then 'pdf_legacy_source_limit' when regexp_matches(m, '单页分片达到或超过 190 mb|单页分片仍超过 190 mb|单页分片超过安全大小') then 'pdf_page_too_large'
 when regexp_matches(m, '分片合并失败|不能合并旧 mineru 分片') then 'mineru_part_merge_failed' when regexp_matches(m, 'pdf 分片|拆分失败|无法安装隔离的 pdf 分片') then 'pdf_split_failed' when regexp_matches(m, 'pdf 已损坏|pdf 分片无法重新读取') then 'pdf_invalid'
 when regexp_matches(m, 'mineru 分片解析失败|个 mineru 分片解析失败') then 'mineru_part_failed' when regexp_matches(m, 'encrypted|password|加密|密码') then 'document_encrypted' when regexp_matches(m, 'permission denied|access is denied|拒绝访问|权限不足|无法写入') then 'permission_denied'
 when regexp_matches(m, 'being used|used by another process|被占用|共享冲突') then 'file_in_use' when regexp_matches(m, 'not found|找不到|不存在|no such file') then 'file_not_found' when regexp_matches(m, '不支持|unsupported') then 'unsupported_format'
 when regexp_matches(m, '未产生 markdown|没有产生 markdown|内容为空|empty') then 'empty_output' when regexp_matches(m, 'yaml|frontmatter') then 'invalid_yaml'"""


@query("error_classes", f"with e as (select event_id, case when event_id%50=49 then null else upper(event_type)||': '||[{_LIST}][event_id%{len(_WORDS)}+1] end as message from events), l as (select *, lower(message) as m from e) select coalesce(case when m is null then null {_CASES} else 'unexpected_error' end, 'none') as code, count(*) as n from l group by 1")
def error_classes(s, d):
    words = F.array(*[F.lit(w) for w in _WORDS])
    message = F.when(c("event_id") % 50 != 49, F.concat(F.upper("event_type"), F.lit(": "), F.element_at(words, (c("event_id") % len(_WORDS) + 1).cast("int"))))
    return view(s, d, "events").groupBy(F.coalesce(T.error_class(message), F.lit("none")).alias("code")).agg(F.count("*").alias("n"))


@query("error_help", "with e as (select ['timed out','HTTP 503','encrypted file','no such file','bad yaml','odd'][event_id%6+1] as m from events), h as (select * from (values ('timed out', 'Network timeout', 'Check the connection, then retry.'), ('HTTP 503', 'Service unavailable', 'Retry when the service is up again.'), ('encrypted file', 'Encrypted document', 'Remove the password, then retry.'), ('no such file', 'File not found', 'Check that the source is still there.'), ('bad yaml', 'Invalid front matter', 'Mend the YAML at the top of the document.'), ('odd', 'Unexpected error', 'Retry; if it stays, look into the log.')) v(m, title, suggestion)) select title, suggestion, count(*) as n from e join h using (m) group by all")
def error_help(s, d):
    message = F.element_at(F.array(*[F.lit(x) for x in ("timed out", "HTTP 503", "encrypted file", "no such file", "bad yaml", "odd")]), (c("event_id") % 6 + 1).cast("int"))
    help_ = T.error_help(T.error_class(message))
    return view(s, d, "events").select(help_.alias("h")).groupBy("h.title", "h.suggestion").agg(F.count("*").alias("n"))


@query("media_ext", ddb("src", "with m as (select rel_path, case doc_id%6 when 0 then 'image/png' when 1 then 'image/jpeg' when 2 then 'image/svg+xml' when 3 then 'image/x-wmf' when 4 then 'application/x' end as media from src) select rel_path, case media when 'image/png' then 'png' when 'image/jpeg' then 'jpg' when 'image/svg+xml' then 'svg' when 'image/x-wmf' then 'wmf' else coalesce(nullif(regexp_extract(rel_path, '\\.([A-Za-z0-9]{1,10})$', 1), ''), 'bin') end as ext from m"))
def media_ext(s, d):
    media = F.expr("case doc_id%6 when 0 then 'image/png' when 1 then 'image/jpeg' when 2 then 'image/svg+xml' when 3 then 'image/x-wmf' when 4 then 'application/x' end")
    return view(s, d, "src").select("rel_path", P.media_extension(media, c("rel_path")).alias("ext"))


@query("html_title", "select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) as heading, len(regexp_extract_all(html, '<p>'))::int as paragraphs from pages")
def html_title(s, d):
    return view(s, d, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("heading"), F.regexp_count("html", F.lit("<p>")).alias("paragraphs"))


@query("html_sniff", "select page_id, page_id%4<>3 as is_html from pages")
def html_sniff(s, d):
    page = F.expr("case page_id%4 when 0 then html when 1 then '  <!-- x -->\n<?xml version=\"1.0\"?>'||html when 2 then '\ufeff'||html else 'PK'||html end")
    return view(s, d, "pages").select("page_id", T.is_html_start(page).alias("is_html"))


@query("html_to_md")
def html_to_md(s, d):
    return V.converted(view(s, d, "pages"), lambda x: (V.html_to_markdown(x), []), "html", "page_id")


# Where a piece from byte `at` of at most `most` bytes ends: at the last byte before which a character begins. x: the text in hexadecimal digits.
_ENDS = "least({at} + {most}, n, 65536)"
_CUT = f"case when {_ENDS} >= n then n else {_ENDS} - case when substr(x, 2*{_ENDS} + 1, 1) not in ('8','9','A','B') then 0 when substr(x, 2*{_ENDS} - 1, 1) not in ('8','9','A','B') then 1 when substr(x, 2*{_ENDS} - 3, 1) not in ('8','9','A','B') then 2 else 3 end end"


@query("doc_chunks", f"""with recursive h as (select doc_id, hex(encode(text)) as x, octet_length(encode(text)) as n from documents where text <> ''),
 c as (select doc_id, x, n, 0 as chunk, 0::bigint as b, ({_CUT.format(at="0", most="4096")})::bigint as e from h union all select doc_id, x, n, chunk + 1, e, ({_CUT.format(at="e", most="8192")})::bigint from c where e < least(n, 65536) and {_CUT.format(at="e", most="8192")} > e)
 select doc_id, chunk, sha256(unhex(substr(x, 2*b + 1, 2*(e - b)))) as piece_sha256, e = max(e) over (partition by doc_id) as last, max(e) over (partition by doc_id) < n as truncated from c""")
def doc_chunks(s, d):
    """Pieces of every document, with their digests."""
    return V.chunked(view(s, d, "documents")).select("doc_id", "chunk", F.sha2("piece", 256).alias("piece_sha256"), "last", "truncated")
