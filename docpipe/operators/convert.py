"""Content jobs: documents to Markdown, a row in, a row out; a failed row has an error and never fails the job."""

from __future__ import annotations

import csv
import email
import email.policy
import io
import re
import urllib.parse
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docpipe.functions import text as T
from docpipe.sources.tables import give_back, text_batches

RESULT = "markdown string, warnings array<string>, status string, error string"
SKIPPED = ("script", "style", "title", "noscript", "template")
BLOCK = ("p", "div", "section", "article", "header", "footer", "main", "aside", "nav", "body", "blockquote", "figure", "form", "dl", "dd", "dt")
#: Limits of an archive: members, bytes of Markdown, of an asset, in all; parts of a web archive.
MOST_MEMBERS, MOST_MARKDOWN, MOST_ASSET, MOST_TOTAL, MOST_PARTS = 20_000, 64 << 20, 128 << 20, 512 << 20, 10_000
#: Rows that a task makes at once.
ROWS = 250


class Markdown(HTMLParser):
    """HTML as Markdown: headings, paragraphs, links, images, lists, tables, emphasis, code."""

    def __init__(self, base: str = ""):
        super().__init__(convert_charrefs=True)
        self.base, self.out, self.text, self.skip, self.href = base, [], [], 0, []
        self.lists: list[list] = []
        self.rows: list[list[str]] | None = None
        self.prefix, self.pre, self.cell = "", 0, False

    def flush(self) -> None:
        t = "".join(self.text)
        t = t.strip("\n") if self.pre else re.sub(r"[ \t\r\n\f\v]+", " ", t).strip()
        self.text = []
        if t:
            self.out.append(self.prefix + t)
        self.prefix = ""

    def close_cell(self) -> None:
        if self.cell and self.rows:
            self.rows[-1].append(re.sub(r"\s+", " ", "".join(self.text)).strip().replace("|", "\\|"))
            self.text = []
        self.cell = False

    def handle_starttag(self, tag: str, attrs) -> None:
        a = {k: v or "" for k, v in attrs}
        if tag in SKIPPED:
            self.skip += 1
        elif tag == "base" and a.get("href"):
            self.base = urllib.parse.urljoin(self.base, a["href"])
        elif re.fullmatch("h[1-6]", tag):
            self.flush()
            self.prefix = "#" * int(tag[1]) + " "
        elif tag in BLOCK:
            self.flush() if self.rows is None else None
        elif tag == "pre":
            self.flush()
            self.pre = 1
        elif tag in ("ul", "ol"):
            self.flush()
            self.lists.append([tag, 0])
        elif tag == "li":
            self.flush()
            if self.lists:
                self.lists[-1][1] += 1
            kind, n = self.lists[-1] if self.lists else ("ul", 1)
            self.prefix = "  " * (len(self.lists) - 1) + (f"{n}. " if kind == "ol" else "- ")
        elif tag == "table":
            self.flush()
            self.rows = []
        elif tag == "tr" and self.rows is not None:
            self.close_cell()
            self.rows.append([])
        elif tag in ("td", "th") and self.rows is not None:
            self.close_cell()
            self.text, self.cell = [], True
        elif tag == "br":
            self.text.append(" " if self.rows is not None or not self.pre else "\n")
        elif tag == "a":
            self.href.append((self.link(a.get("href", "")), len(self.text)))
        elif tag == "img" and a.get("src"):
            self.text.append(f"![{a.get('alt', '')}]({self.link(a['src'])})")
        elif tag in ("b", "strong") and not self.skip:
            self.text.append("**")
        elif tag in ("i", "em") and not self.skip:
            self.text.append("*")
        elif tag == "code" and not self.pre:
            self.text.append("`")

    def link(self, href: str) -> str:
        return href if href.startswith("#") or not self.base else urllib.parse.urljoin(self.base, href)

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in ("td", "th", "tr"):
            self.close_cell()
        elif tag == "table" and self.rows is not None:
            self.close_cell()
            rows, self.rows = self.rows, None
            self.out += [table_lines(rows)] if any(rows) else []
        elif tag == "pre":
            t = "".join(self.text).strip("\n")
            self.text, self.pre = [], 0
            self.out.append(f"```\n{t}\n```")
        elif tag in ("ul", "ol"):
            self.flush()
            self.lists = self.lists[:-1]
        elif tag == "li" or re.fullmatch("h[1-6]", tag) or tag in BLOCK:
            self.flush() if self.rows is None else None
        elif tag == "a" and self.href:
            href, at = self.href.pop()
            inside = "".join(self.text[at:])
            self.text[at:] = [f"[{inside.strip()}]({href})" if href else inside]
        elif tag in ("b", "strong") and not self.skip:
            self.text.append("**")
        elif tag in ("i", "em") and not self.skip:
            self.text.append("*")
        elif tag == "code" and not self.pre:
            self.text.append("`")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.text.append(data)

    def result(self) -> str:
        self.flush()
        lines = []
        for k, x in enumerate(self.out):
            item = re.match(r" *(-|\d+\.) ", x)
            before = k and re.match(r" *(-|\d+\.) ", self.out[k - 1])
            lines.append(("\n" if k and item and before else "\n\n" if k else "") + x)
        return re.sub(r"\*\*\s*\*\*|(?<!\*)\*\s+\*(?!\*)", "", "".join(lines))


def table_lines(rows: list[list[str]]) -> str:
    width = max(map(len, rows))
    full = [r + [""] * (width - len(r)) for r in rows if r]
    return "\n".join(["| " + " | ".join(full[0]) + " |", "|" + " --- |" * width, *["| " + " | ".join(r) + " |" for r in full[1:]]])


def html_to_markdown(page: str, base: str = "") -> str:
    p = Markdown(base)
    p.feed(page)
    p.close()
    return p.result()


def csv_to_markdown(text: str) -> str:
    rows = [[c.strip().replace("|", "\\|").replace("\n", " ") for c in r] for r in csv.reader(io.StringIO(text)) if r]
    return table_lines(rows) if rows else ""


def decoded(raw: bytes, declared: str | None = None, bom_first: bool = False, meta_bytes: int = 4096) -> str:
    """Text by the declared charset, a meta tag's, a byte-order mark's, or UTF-8; strict. Word exports look at the mark first."""
    boms = ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"))
    mark = next(((len(b), name) for b, name in boms if raw.startswith(b)), None)
    meta = re.search(rb"charset\s*=\s*[\"']?\s*([A-Za-z0-9_\-]+)", raw[:meta_bytes], re.I)
    named = declared or (meta and meta[1].decode("ascii"))
    if mark and (bom_first or not named):
        return raw[mark[0] :].decode(mark[1])
    return raw.decode(named or "utf-8").removeprefix("\ufeff")


def unpack_web_archive(raw: bytes) -> tuple[str, list[tuple[str, bytes]], list[str]]:
    """(Markdown, assets, warnings) of a web archive: the root page, its images by content id or address, each once."""
    message = email.message_from_bytes(raw, policy=email.policy.default)
    parts = [p for p in message.walk() if not p.is_multipart()]
    if len(parts) > MOST_PARTS:
        raise ValueError(f"more than {MOST_PARTS} parts")
    start = message.get_param("start") or ""
    cid = lambda p: str(p.get("Content-ID", "")).strip("<> ")
    pages = [p for p in parts if p.get_content_type() in ("text/html", "application/xhtml+xml")]
    root = next((p for p in pages if start and cid(p) == str(start).strip("<> ")), pages[0] if pages else None)
    if root is None:
        raise ValueError("no HTML part")
    base = str(root.get("Content-Location", ""))
    known: dict[str, object] = {}
    for p in parts:
        for key in (f"cid:{cid(p)}" if cid(p) else "", urllib.parse.urldefrag(urllib.parse.urljoin(base, str(p.get("Content-Location", ""))))[0]):
            if key and p is not root:
                known.setdefault(key, p)
    text = html_to_markdown(decoded(root.get_payload(decode=True), root.get_content_charset()), base)
    assets: dict[int, tuple[str, bytes]] = {}
    warnings: list[str] = []

    def image(m: re.Match) -> str:
        key = urllib.parse.unquote(m[2]) if m[2].startswith("cid:") else urllib.parse.urldefrag(m[2])[0]
        p = known.get(key)
        if p is None:
            if m[2].startswith("cid:") and (w := f"missing image: {m[2]}") not in warnings:
                warnings.append(w)
            return m[0]
        if id(p) not in assets:
            kind = p.get_content_type().rpartition("/")[2].split("+")[0].replace("jpeg", "jpg")
            assets[id(p)] = (f"mhtml-{len(assets):04d}.{kind}", p.get_payload(decode=True))
        return f"![{m[1]}]({assets[id(p)][0]})"

    return re.sub(r"!\[([^\]]*)\]\(([^)]*)\)", image, text), list(assets.values()), warnings


def unpack_archive(raw: bytes) -> tuple[str, list[tuple[str, bytes]]]:
    """(Markdown, assets) of a result archive: full.md, else the first .md; only assets that the Markdown mentions."""
    z = zipfile.ZipFile(io.BytesIO(raw))
    members = [m for m in z.infolist() if not m.is_dir()]
    if len(members) > MOST_MEMBERS:
        raise ValueError(f"more than {MOST_MEMBERS} members")
    pages = [m for m in members if m.filename.lower().endswith(".md")]
    page = next((m for m in pages if m.filename.rpartition("/")[2] == "full.md"), pages[0] if pages else None)
    if page is None:
        raise ValueError("no Markdown member")
    if page.file_size > MOST_MARKDOWN:
        raise ValueError("Markdown too large")
    text, folder, total, assets = z.read(page).decode("utf-8"), page.filename.rpartition("/")[0], 0, []
    for m in members:
        name = m.filename.removeprefix(f"{folder}/") if folder else m.filename
        safe = not name.startswith("/") and not {"", ".", ".."} & set(name.split("/"))
        if m is page or not safe or not (name in text or urllib.parse.quote(name) in text):
            continue
        total += m.file_size
        if m.file_size > MOST_ASSET or total > MOST_TOTAL:
            raise ValueError("assets too large")
        assets.append((name, z.read(m)))
    return text, assets


def chunks(text: str, first: int = 4096, rest: int = 8192, most: int = 65_536) -> tuple[list[str], bool]:
    """Pieces of a text by bytes, cut between characters, up to a limit; and whether something is left."""
    raw, at, out = text.encode("utf-8", "surrogatepass"), 0, []
    while at < min(len(raw), most):
        end = min(at + (rest if at else first), len(raw), most)
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        if end <= at:
            break
        out.append(raw[at:end].decode("utf-8", "surrogatepass"))
        at = end
    return out, at < len(raw)


def few_at_once(batches: Iterator[pa.RecordBatch], rows: Callable[[list], list[tuple]], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Of batches (key, content, ...): rows gives (place, values) of some contents, which come out with the key of their place. Memory is given back after each batch."""
    for x in batches:
        for low in range(0, x.num_rows, ROWS):
            part = x.slice(low, ROWS)
            out = rows([y.to_pylist() for y in part.columns[1:]])
            if out:
                columns = list(zip(*out, strict=True))
                keys = part.column(0).take(pa.array(columns[0], pa.int32()))
                yield pa.record_batch([keys, *[pa.array(c, t) for c, t in zip(columns[1:], types, strict=True)]], names=names)
        del x
        give_back()


def converted(docs: DataFrame, convert: Callable[[object], tuple[str, list[str]]], content: str, key: str = "doc_id") -> DataFrame:
    """Rows (key, markdown, warnings, status, error); blank Markdown is an error."""
    kind = docs.schema[key].dataType.simpleString()

    def rows(columns: list[list]) -> list[tuple]:
        out = []
        for k, raw in enumerate(columns[0]):
            try:
                text, warnings = convert(raw) if raw is not None else ("", [])
                error = None if text.strip() else "empty result"
                out.append((k, text if error is None else None, warnings, "converted" if error is None else "failed", error))
            except Exception as e:  # a document, not the job
                out.append((k, None, [], "failed", str(e)[:500]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from few_at_once(batches, rows, [key, "markdown", "warnings", "status", "error"], [pa.string(), pa.list_(pa.string()), pa.string(), pa.string()])

    text_batches(docs.sparkSession)
    return docs.select(key, content).mapInArrow(run, f"{key} {kind}, {RESULT}")


def chunked(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows (key, chunk, piece, last, truncated) of docs."""
    kind = docs.schema[key].dataType.simpleString()

    def rows(columns: list[list]) -> list[tuple]:
        out = []
        for k, t in enumerate(columns[0]):
            pieces, more = chunks(t or "")
            out += [(k, i, piece, i == len(pieces) - 1, more) for i, piece in enumerate(pieces)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from few_at_once(batches, rows, [key, "chunk", "piece", "last", "truncated"], [pa.int32(), pa.string(), pa.bool_(), pa.bool_()])

    text_batches(docs.sparkSession)
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, chunk int, piece string, last boolean, truncated boolean")


def merge_categories(text: str, categories: list[str], key: str = "categories") -> str:
    """A document whose front matter has the categories at its end; other lines, comments, newlines and the mark stay."""
    import yaml

    if not categories:
        raise ValueError("no category")
    bom, text = ("\ufeff", text[1:]) if text.startswith("\ufeff") else ("", text)
    nl = "\r\n" if "\r\n" in text else "\n"
    block = f"{key}:{nl}" + "".join(f"  - {yaml.safe_dump(c, allow_unicode=True, width=10**9).splitlines()[0]}{nl}" for c in categories)
    m = re.match(r"---\r?\n((?:.*\n)*?)(---|\.\.\.)(\r?\n|\Z)", text)
    if not m:
        return f"{bom}---{nl}{block}---{nl}{text}"
    held = yaml.safe_load(m[1]) if m[1].strip() else {}
    if held is not None and not isinstance(held, dict):
        raise ValueError("front matter is no mapping")
    own = re.sub(rf"(?m)^{re.escape(key)}:.*(?:\r?\n(?:[ \t]+.*|- .*|[ \t]*(?=\r?\n)))*(?:\r?\n|\Z)", "", m[1])
    return f"{bom}---{nl}{own}{block}{text[m.start(2):]}"


def category_list(yaml: Column, key: str = "categories") -> Column:
    """The texts of the list under a key of front matter, in any YAML form: trimmed, without blanks and items that are no text, each once.

    Front matter that is no YAML, no mapping, or has no list there gives no item; null stays null. Yes, no, on and off are texts, as in YAML 1.2.
    """

    def read(x: pd.Series) -> pd.Series:
        import yaml as y

        class Loader(y.SafeLoader):
            pass

        drop = {"tag:yaml.org,2002:bool", "tag:yaml.org,2002:timestamp"}
        Loader.yaml_implicit_resolvers = {k: [(t, r) for t, r in v if t not in drop] for k, v in y.SafeLoader.yaml_implicit_resolvers.items()}
        Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))

        def items(text: str | None) -> list[str] | None:
            if text is None:
                return None
            try:
                held = y.load(text, Loader)
            except Exception:  # a document, not the job
                return []
            values = held.get(key) if isinstance(held, dict) else None
            return list(dict.fromkeys(v.strip() for v in values if isinstance(v, str) and v.strip())) if isinstance(values, list) else []

        return x.map(items)

    return F.pandas_udf(read, "array<string>")(yaml)


def decision_input(text: Column, n: int, key: str = "categories") -> Column:
    """What a decision reads: the text without old categories, its first n bytes; null where that is blank or its front matter is no mapping."""

    def strip(x: pd.Series) -> pd.Series:
        def body(t: str | None) -> str | None:
            try:
                return t if t is None or not t.lstrip("\ufeff").startswith("---") else strip_categories(t, key)
            except Exception:  # a document, not the job
                return None

        return x.map(body)

    has_head = F.ltrim(F.substring(text, 1, 4)).rlike("^\ufeff?---")
    own = F.when(has_head, F.pandas_udf(strip, "string")(F.when(has_head, text))).otherwise(text)
    return F.when(own.rlike(r"[^\s\p{Z}]"), T.utf8_prefix(own, n))


def strip_categories(text: str, key: str = "categories") -> str:
    """A document without the categories in its front matter."""
    import yaml

    m = re.match(r"(\ufeff?---\r?\n)((?:.*\n)*?)((?:---|\.\.\.)(?:\r?\n|\Z))", text)
    if not m:
        return text
    held = yaml.safe_load(m[2]) if m[2].strip() else {}
    if held is not None and not isinstance(held, dict):
        raise ValueError("front matter is no mapping")
    own = re.sub(rf"(?m)^{re.escape(key)}:.*(?:\r?\n(?:[ \t]+.*|- .*|[ \t]*(?=\r?\n)))*(?:\r?\n|\Z)", "", m[2])
    return m[1] + own + text[m.start(3) :]


def categorized(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs (key, text, categories array) with text carrying its categories; rows (key, markdown, error)."""
    kind = docs.schema[key].dataType.simpleString()

    def rows(columns: list[list]) -> list[tuple]:
        out = []
        for k, (t, cs) in enumerate(zip(*columns, strict=True)):
            try:
                out.append((k, merge_categories(t or "", list(cs)), None))
            except Exception as e:  # a document, not the job
                out.append((k, None, str(e)[:500]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from few_at_once(batches, rows, [key, "markdown", "error"], [pa.string(), pa.string()])

    text_batches(docs.sparkSession)
    return docs.select(key, "text", "categories").mapInArrow(run, f"{key} {kind}, markdown string, error string")


def with_scores(docs: DataFrame, score: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A scoring plug-in over batches of documents."""
    return docs.mapInPandas(lambda batches: (score(x) for x in batches), schema)


def asset_links(docs: DataFrame, assets: DataFrame, encode: Callable) -> DataFrame:
    """Assets (doc_id, asset) that their document's Markdown mentions, as written or percent-encoded."""
    met = assets.join(docs.select("doc_id", "markdown"), "doc_id")
    return met.where(F.col("markdown").contains(F.col("asset")) | F.col("markdown").contains(encode(F.col("asset")))).select(*assets.columns)


def numbered_assets(references: DataFrame, prefix: str = "mhtml-") -> DataFrame:
    """Rows (doc_id, resource, name): resources of references (doc_id, position, resource, ext) numbered by first use; repeats share a name."""
    first = references.groupBy("doc_id", "resource").agg(F.min("position").alias("at"), F.min_by("ext", "position").alias("ext"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1
    return first.select("doc_id", "resource", F.concat(F.lit(prefix), F.lpad(n.cast("string"), 4, "0"), F.lit("."), F.col("ext")).alias("name"))


def merged_warnings(parts: DataFrame) -> DataFrame:
    """Rows (doc_id, warnings) of parts (doc_id, part_index, warnings): in order, each once."""
    held = F.array_sort(F.collect_list(F.struct("part_index", "warnings")))
    return parts.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.transform(held, lambda x: x["warnings"]))).alias("warnings"))


def missing_image_warnings(references: DataFrame) -> DataFrame:
    """Rows (doc_id, warning) of image references (doc_id, found): one warning for a document with images that are missing."""
    n = references.groupBy("doc_id").agg(F.count_if(~F.coalesce("found", F.lit(False))).alias("n")).where("n > 0")
    return n.select("doc_id", F.format_string("%d images are missing", "n").alias("warning"))
