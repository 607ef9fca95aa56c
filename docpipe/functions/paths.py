"""Column functions over relative paths with '/' separators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The document formats.
LOCAL_EXTENSIONS = (
    "md", "doc", "docx", "docm", "xls", "xlsx", "xlsm", "xlsb", "ppt", "pps", "pot", "pptx", "pptm", "ppsx", "ppsm",
    "odt", "ods", "odp", "rtf", "epub", "pdf", "html", "htm", "mhtml", "mht", "csv", "txt",
)
OCR_EXTENSIONS = ("png", "jpg", "jpeg", "webp", "bmp")
TEXT_EXTENSIONS = ("txt", "html", "htm", "mhtml", "mht")
INDEX_NAME, TRASH, ASSETS = "index.md", ".trash", ".assets"
GIB, MIB = 1 << 30, 1 << 20


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """The lower-cased extension; null if there is none. A leading dot does not start one."""
    return F.nullif(F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]+)$", 1)), F.lit(""))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]+$", "$1")


def is_supported(path: Column) -> Column:
    return F.coalesce(extension(path).isin(*LOCAL_EXTENSIONS, *OCR_EXTENSIONS), F.lit(False))


def is_enabled(path: Column, enabled: Sequence[str]) -> Column:
    return is_supported(path) & F.coalesce(extension(path).isin(*[x.lower() for x in enabled]), F.lit(False))


def engine(path: Column) -> Column:
    """copy, text, document or ocr by extension; null for what is not supported."""
    x = extension(path)
    return F.when(x == "md", "copy").when(x.isin(*TEXT_EXTENSIONS), "text").when(x.isin(*LOCAL_EXTENSIONS), "document").when(x.isin(*OCR_EXTENSIONS), "ocr")


def size_ok(path: Column, size: Column) -> Column:
    """PDF up to 1 GiB, others up to 512 MiB; Markdown is not checked."""
    x = extension(path)
    return (x == "md") | (size <= F.when(x == "pdf", F.lit(GIB)).otherwise(F.lit(512 * MIB)))


def is_safe_relative(path: Column) -> Column:
    """Only plain components: no root, no empty one, none that goes up."""
    return (path != "") & ~F.exists(F.split(path, "/"), lambda c: c.isin("", "..", "."))


def ancestors(path: Column) -> Column:
    """The folders above a path, from the root (the empty string) down."""
    parts = F.split(path, "/")
    deeper = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.concat(F.array(F.lit("")), F.when(F.size(parts) > 1, deeper).otherwise(F.array().cast("array<string>")))


def ancestor_paths(path: Column) -> Column:
    """All prefixes of an absolute path that end before a separator, and the path itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts), F.lit(2))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def excluded_from_index(path: Column) -> Column:
    """Index pages, and anything under trash, asset folders, temporary or lock files; lower-cased, any component."""
    low = F.lower(path)
    return (file_name(low) == INDEX_NAME) | F.exists(F.split(low, "/"), lambda c: (c == TRASH) | c.endswith(ASSETS) | c.contains(".docpipe.tmp") | c.startswith("~$"))


def excluded_from_classification(path: Column) -> Column:
    """Anything under trash, and temporary or lock files by their own name; as written."""
    name = file_name(path)
    return F.array_contains(F.split(path, "/"), TRASH) | name.endswith(".tmp") | name.contains(".docpipe.tmp") | name.startswith("~$")


def excluded_from_changes(path: Column) -> Column:
    """Anything under trash or asset folders, and temporary files."""
    return F.exists(F.split(path, "/"), lambda c: (c == TRASH) | c.endswith(ASSETS) | c.contains(".docpipe.tmp"))


def natural_key(name: Column) -> Column:
    """A sort key in which runs of digits, of any length, compare by value; letters by lower-cased code points.

    A run becomes the number of its digits without leading zeros, in ten places, and these digits.
    """
    runs = F.regexp_extract_all(F.lower(name), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))

    def key(x: Column) -> Column:
        plain = F.regexp_replace(x, "^0+", "")
        return F.when(x.rlike("^[0-9]"), F.concat(F.lpad(F.length(plain).cast("string"), 10, "0"), plain)).otherwise(x)

    return F.array_join(F.transform(runs, key), "")


def output_path(path: Column, collides: Column) -> Column:
    """Markdown keeps its name; a stem that collides keeps its extension; else the stem with .md."""
    folder = parent(path)
    name = F.when(extension(path) == "md", file_name(path)).when(collides, F.concat(file_name(path), F.lit(".md"))).otherwise(F.concat(file_stem(path), F.lit(".md")))
    return F.when(folder == "", name).otherwise(F.concat_ws("/", folder, name))


def asset_dir(output: Column) -> Column:
    return F.concat(F.regexp_replace(output, r"\.md$", ""), F.lit(ASSETS))


def percent_encode(path: Column) -> Column:
    """All bytes but ASCII letters, digits and - _ . ~ / encoded."""
    out = F.url_encode(path)
    for a, b in (("+", "%20"), ("%2F", "/"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def link_encode(path: Column) -> Column:
    """Like percent_encode, but letters and digits of all scripts are kept."""
    chars = F.regexp_extract_all(path, F.lit(r"[\p{L}\p{N}\-_.~/]+|[^\p{L}\p{N}\-_.~/]"), F.lit(0))
    return F.array_join(F.transform(chars, lambda c: F.when(c.rlike(r"^[\p{L}\p{N}\-_.~/]"), c).otherwise(percent_encode(c))), "")


def relative_link(folder: Column, target: Column) -> Column:
    """The way from a folder to a target, up by .. past what they share."""
    a = F.when(folder == "", F.array().cast("array<string>")).otherwise(F.split(folder, "/"))
    b = F.split(target, "/")
    same = F.transform(F.sequence(F.lit(0), F.size(a)), lambda n: F.when(F.slice(a, 1, n) == F.slice(b, 1, n), n))
    common = F.array_max(same)
    up = F.when(F.size(a) > common, F.repeat(F.lit("../"), F.size(a) - common)).otherwise("")
    return F.concat(up, F.array_join(F.slice(b, common + 1, F.size(b) - common), "/"))


def escape_link_text(x: Column) -> Column:
    return F.regexp_replace(x, r"([\\\[\]])", r"\\$1")


def escape_markdown(x: Column) -> Column:
    return F.regexp_replace(x, r"([\\*_\[\]<>#`|])", r"\\$1")


def media_extension(media: Column, origin: Column) -> Column:
    """An asset's extension by media type, else its origin's if that is short and plain, else bin."""
    own = F.regexp_extract(file_name(origin), r"^.+\.([A-Za-z0-9]{1,10})$", 1)
    # Media types and their extensions.
    known = {
        "image/png": "png", "image/jpeg": "jpg", "image/gif": "gif", "image/webp": "webp", "image/bmp": "bmp", "image/x-ms-bmp": "bmp", "image/tiff": "tiff",
        "image/svg+xml": "svg", "image/x-emf": "emf", "image/emf": "emf", "image/x-wmf": "wmf", "image/wmf": "wmf",
    }
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.coalesce(F.try_element_at(table, media), F.nullif(own, F.lit("")), F.lit("bin"))


def breadcrumbs(folder: Column, root_title: str = "Knowledge index", page: str = INDEX_NAME) -> Column:
    """Links from a folder's page up to the root's, the root first: [title](../../index.md) / [a](../index.md) / b."""
    parts = F.split(folder, "/")
    up = lambda n: F.concat(F.repeat(F.lit("../"), n), F.lit(page))
    root = F.concat(F.lit(f"[{root_title}]("), up(F.size(parts)), F.lit(")"))
    above = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda x, i: F.concat(F.lit("["), escape_link_text(x), F.lit("]("), up(F.size(parts) - i.cast("int") - 1), F.lit(")")))
    here = escape_markdown(F.element_at(parts, -1))
    return F.when(folder == "", "").otherwise(F.array_join(F.concat(F.array(root), above, F.array(here)), " / "))
