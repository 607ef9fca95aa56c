"""Column functions over document texts: front matter, managed blocks, limits, errors, redaction."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

START, END = "<!-- docpipe:index:start -->", "<!-- docpipe:index:end -->"

# Error classes and the words that mark them, the first that matches wins.
ERRORS = (
    ("engine_version_mismatch", ("未知转换引擎",)),
    ("mineru_not_configured", ("未配置 mineru", "mineru token", "凭据库")),
    ("service_rate_limited", ("429", "too many requests", "rate limit", "限流")),
    ("network_timeout", ("timeout", "timed out", "超时")),
    ("service_unavailable", ("500", "502", "503", "504", "server error", "服务错误")),
    ("decision_model_error", ("决策模型", "system one")),
    ("agent_tool_calling", ("tool calling", "tool_call", "未调用分类工具", "不支持工具")),
    ("agent_not_configured", ("agent api key", "未配置 agent", "模型名称不能为空")),
    ("agent_invalid_response", ("最大调用", "超过轮次", "调用轮次", "参数不合法", "schema")),
    ("pdf_source_too_large", ("超过 1 gib", "1 gib 本地预处理安全上限")),
    ("pdf_legacy_source_limit", ("超过 512 mib", "512 mib 本地预处理安全上限")),  # only with "pdf"
    ("pdf_page_too_large", ("单页分片达到或超过 190 mb", "单页分片仍超过 190 mb", "单页分片超过安全大小")),
    ("mineru_part_merge_failed", ("分片合并失败", "不能合并旧 mineru 分片")),
    ("pdf_split_failed", ("pdf 分片", "拆分失败", "无法安装隔离的 pdf 分片")),
    ("pdf_invalid", ("pdf 已损坏", "pdf 分片无法重新读取")),
    ("mineru_part_failed", ("mineru 分片解析失败", "个 mineru 分片解析失败")),
    ("document_encrypted", ("encrypted", "password", "加密", "密码")),
    ("permission_denied", ("permission denied", "access is denied", "拒绝访问", "权限不足", "无法写入")),
    ("file_in_use", ("being used", "used by another process", "被占用", "共享冲突")),
    ("file_not_found", ("not found", "找不到", "不存在", "no such file")),
    ("unsupported_format", ("不支持", "unsupported")),
    ("empty_output", ("未产生 markdown", "没有产生 markdown", "内容为空", "empty")),
    ("invalid_yaml", ("yaml", "frontmatter")),
)
UNEXPECTED = "unexpected_error"


def error_class(message: Column) -> Column:
    """The code of an error message; null for no message. The message is lower-cased once."""

    def code_of(low: Column) -> Column:
        out = F.when(low.isNull(), F.lit(None).cast("string"))
        for code, words in ERRORS:
            hit = reduce(or_, [low.contains(w) for w in words])
            out = out.when(hit & low.contains("pdf") if code == "pdf_legacy_source_limit" else hit, code)
        return out.otherwise(UNEXPECTED)

    return F.get(F.transform(F.array(F.lower(message)), code_of), F.lit(0))


#: What an error is called, and what to do about it.
HELP = {
    "engine_version_mismatch": ("Unknown engine", "Convert the document again with this version."),
    "mineru_not_configured": ("OCR service not set up", "Store the service's token, then retry."),
    "service_rate_limited": ("Too many requests", "Wait, then retry with fewer requests at once."),
    "network_timeout": ("Network timeout", "Check the connection, then retry."),
    "service_unavailable": ("Service unavailable", "Retry when the service is up again."),
    "decision_model_error": ("Decision model failed", "Check the model's address and key, then classify again."),
    "agent_tool_calling": ("Model cannot call tools", "Choose a model that can, or use the decision model."),
    "agent_not_configured": ("Model not set up", "Enter the model's name and key."),
    "agent_invalid_response": ("Unusable answer", "Classify again; if it stays, simplify the rules."),
    "pdf_source_too_large": ("PDF above the limit", "Split the file below 1 GiB."),
    "pdf_legacy_source_limit": ("PDF above an old limit", "Retry: the limit is higher now."),
    "pdf_page_too_large": ("PDF page too large", "Shrink the page's images."),
    "mineru_part_merge_failed": ("Parts do not merge", "Convert all parts again."),
    "pdf_split_failed": ("PDF does not split", "Save the file anew, then retry."),
    "pdf_invalid": ("Broken PDF", "Repair the file or get it again."),
    "mineru_part_failed": ("A part failed", "Retry the failed parts."),
    "document_encrypted": ("Encrypted document", "Remove the password, then retry."),
    "permission_denied": ("No permission", "Allow reading the source and writing the output."),
    "file_in_use": ("File in use", "Close the program that holds it, then retry."),
    "file_not_found": ("File not found", "Check that the source is still there."),
    "unsupported_format": ("Unsupported format", "Save the document in a supported format."),
    "empty_output": ("Nothing converted", "Check whether the document has any text."),
    "invalid_yaml": ("Invalid front matter", "Mend the YAML at the top of the document."),
    UNEXPECTED: ("Unexpected error", "Retry; if it stays, look into the log."),
}


def error_help(code: Column) -> Column:
    """A struct (title, suggestion) for an error's code; null for none."""
    table = F.create_map(*[x for k, (title, suggestion) in HELP.items() for x in (F.lit(k), F.struct(F.lit(title).alias("title"), F.lit(suggestion).alias("suggestion")))])
    return F.try_element_at(table, code)


def trimmed(x: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def normalized_name(x: Column) -> Column:
    return F.lower(trimmed(x))


def newline_of(x: Column) -> Column:
    return F.when(x.contains("\r\n"), "\r\n").otherwise("\n")


def with_newlines(x: Column, newline: Column) -> Column:
    return F.replace(F.replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), F.lit("\n"), newline)


def utf8_prefix(x: Column, n: int) -> Column:
    """The longest prefix of a text of at most n bytes that ends between characters."""
    b = x.cast("binary")
    cuts = [F.try_validate_utf8(F.substring(b, 1, n - k).cast("string")) for k in range(4)]
    return F.when(F.octet_length(x) <= n, x).otherwise(F.coalesce(*cuts))


def frontmatter(x: Column) -> Column:
    """The YAML between an opening --- at the very start and a closing --- or ...; null if it does not close."""
    pattern = r"(?s)^---\r?\n(.*?)(?:(?<=\n)|(?<=^---\n)|(?<=^---\r\n))(?:---|\.\.\.)\r?(?:\n|$)"
    return F.when(x.rlike(pattern), F.regexp_extract(x, pattern, 1))


def without_frontmatter(x: Column) -> Column:
    """A text without closed front matter at its start, and without the blank lines after it; any other text as it is."""
    whole = r"(?s)^---\r?\n(?:.*?)(?:(?<=\n)|(?<=^---\n)|(?<=^---\r\n))(?:---|\.\.\.)\r?(?:\n|$)[\r\n]*"
    return F.when(F.startswith(x, F.lit("---")), F.regexp_replace(x, whole, "")).otherwise(x)


def frontmatter_list(yaml: Column, key: str) -> Column:
    """The items of a plain block list under a key: trimmed, without quotes and blanks, each once."""
    block = F.regexp_extract(yaml, rf"(?m)^{key}:[ \t]*\r?\n((?:[ \t]*- .*(?:\r?\n|$))*)", 1)
    items = F.transform(F.regexp_extract_all(block, F.lit(r"- (.*)"), F.lit(1)), lambda s: F.regexp_replace(trimmed(s), r"^(['\"])(.*)\1$", "$2"))
    return F.array_distinct(F.filter(F.transform(items, trimmed), lambda s: s != ""))


def build_frontmatter(source: Column, sha256: Column, converter: Column, converted_at: Column, warnings: Column) -> Column:
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.concat(
        F.lit("---\nsource: "), quote(source), F.lit("\nsource_sha256: "), quote(F.coalesce(sha256, F.lit(""))), F.lit("\nconverter: "), converter,
        F.lit("\nconverted_at: "), converted_at, F.lit("\nwarnings: "), F.to_json(warnings), F.lit("\n---\n"),
    )


def ensure_newline(x: Column, newline: Column) -> Column:
    return F.when(F.endswith(x, newline), x).otherwise(F.concat(x, newline))


def managed_state(x: Column) -> Column:
    """none, whole or torn: whether a page has the block's markers."""
    a, b = F.locate(START, x), F.instr(F.substring_index(x, START, -1), END)
    return F.when(a == 0, "none").when(b > 0, "whole").otherwise("torn")


def merge_managed(page: Column, block: Column) -> Column:
    """A page with the managed block put between its markers, or at its end; null where the markers are torn."""
    nl = newline_of(page)
    new = F.concat(F.lit(START), nl, ensure_newline(with_newlines(block, nl), nl), F.lit(END))
    after = F.expr("''")
    head = F.substring_index(page, START, 1)
    rest = F.substring(page, F.length(head) + len(START) + 1, F.length(page))
    after = F.substring(rest, F.instr(rest, END) + len(END), F.length(rest))
    gap = F.when((page == "") | F.endswith(page, F.concat(nl, nl)), "").when(F.endswith(page, nl), nl).otherwise(F.concat(nl, nl))
    state = managed_state(page)
    fresh = F.concat(F.lit(START + "\n"), ensure_newline(block, F.lit("\n")), F.lit(END + "\n"))
    return F.when(page.isNull(), fresh).when(state == "none", F.concat(page, gap, new, nl)).when(state == "whole", F.concat(head, new, after))


def remove_managed(page: Column) -> Column:
    """A page without its managed block, runs of blank lines closed up; null where there is none or it is torn."""
    head = F.substring_index(page, START, 1)
    rest = F.substring(page, F.length(head) + len(START) + 1, F.length(page))
    after = F.substring(rest, F.instr(rest, END) + len(END), F.length(rest))
    joined = F.regexp_replace(F.concat(head, after), r"(\r\n){3,}", "\r\n\r\n")
    return F.when(managed_state(page) == "whole", F.regexp_replace(joined, r"\n{3,}", "\n\n"))


def redact(x: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Each of the given texts replaced by its mask, in order."""
    for old, new in pairs:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def rewrite_assets(markdown: Column, old: Column, new: Column) -> Column:
    """References to an asset rewritten: Markdown links, plain and in angle brackets, and src and href of either quote."""
    for a, b in (("](", ")"), ("](<", ">)"), ('src="', '"'), ("src='", "'"), ('href="', '"'), ("href='", "'")):
        for lead in ("", "./"):
            markdown = F.replace(markdown, F.concat(F.lit(a + lead), old, F.lit(b)), F.concat(F.lit(a), new, F.lit(b)))
    return markdown


def is_html_start(x: Column) -> Column:
    """Whether a text is HTML behind a byte-order mark, white space, comments and an XML declaration."""
    return x.rlike(r"(?is)^\x{FEFF}?(?:\s+|<!--.*?-->|<\?xml.*?\?>)*<(?:!doctype\s+html|html)\b")


def failure_status(engine: Column, code: Column) -> Column:
    """waiting for an OCR failure of the network or of missing credentials, which a later try may mend; else failed."""
    passing = code.isin("network_timeout", "service_unavailable", "service_rate_limited", "mineru_not_configured")
    return F.when((engine == "mineru") & passing, "waiting_mineru").otherwise("failed")
