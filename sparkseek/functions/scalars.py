"""Column functions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Language by file extension.
LANGUAGE_BY_EXTENSION = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "py": "python", "rb": "ruby", "go": "go", "rs": "rust", "java": "java", "kt": "kotlin",
    "swift": "swift", "c": "c", "cpp": "cpp", "h": "c", "hpp": "cpp", "cs": "csharp", "php": "php", "sh": "bash", "bash": "bash", "zsh": "bash", "json": "json", "yaml": "yaml", "yml": "yaml", "xml": "xml", "html": "html",
    "css": "css", "scss": "scss", "sql": "sql", "md": "markdown", "toml": "ini", "ini": "ini",
}


def content_hash(text: Column) -> Column:
    """SHA-256 of UTF-8 text or bytes, lower-case hex."""
    return F.sha2(text, 256)


def sha256_uuid(digest: Column) -> Column:
    """UUID from the first 32 hex digits of a SHA-256: version 5, RFC variant."""
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def parent_path(path: Column) -> Column:
    """Everything before the last slash, or `.`."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def file_extension(path: Column) -> Column:
    """The extension without dot in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def has_extension(path: Column, extensions: list[str]) -> Column:
    """Whether the extension is one of those given (with or without dots); any if none is given."""
    wanted = [e.strip().lower().lstrip(".") for e in extensions]
    found = file_extension(path)
    return found.isin(wanted) if wanted else found != ""


def is_hidden(path: Column) -> Column:
    """Whether any name of the path starts with a dot."""
    return path.rlike(r"(^|/)\.")


def relative_path(path: Column, root: str) -> Column:
    """The path below root, null if it isn't below it."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1)))


def language(path: Column) -> Column:
    """The language of a path's extension, null if unknown."""
    pairs = [F.lit(x) for pair in LANGUAGE_BY_EXTENSION.items() for x in pair]
    return F.create_map(*pairs)[file_extension(path)]


def text_lines(text: Column) -> Column:
    """Lines split at line feeds, trailing empty ones kept."""
    return F.split(text, "\n", -1)


def line_range(text: Column, start: Column, end: Column) -> Column:
    """Lines start..end (1-based, inclusive, clamped) joined again."""
    lines = text_lines(text)
    first = F.greatest(start, F.lit(1))
    return F.array_join(F.slice(lines, first, F.greatest(F.least(end, F.size(lines)) - first + 1, F.lit(0))), "\n")


def line_tokens(text: Column) -> Column:
    """Estimated tokens of whole lines: a quarter of the characters and line feeds, rounded up."""
    return F.ceil((F.length(text) + 1) / 4)


def batch_tokens(text: Column) -> Column:
    """Estimated tokens for batching: a third of the characters, rounded up."""
    return F.ceil(F.length(text) / 3)


def truncated(text: Column, most: int = 24_000) -> Column:
    return F.substring(text, 1, most)


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision, summed in order."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, null if either vector is all zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector scaled to length 1; an all-zero vector stays as it is."""
    length = norm(a)
    return F.transform(a, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(x.cast("double")))


def path_safe(name: Column) -> Column:
    return F.regexp_replace(name, r"[/\\:]", "_")


def byte_size(n: Column) -> Column:
    """Bytes as B, KB or MB with one decimal."""
    return F.when(n.isNull(), F.lit(None).cast("string")).when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024.0)).otherwise(F.format_string("%.1f MB", n / (1024.0 * 1024.0)))


def percent_bar(value: Column, width: int = 20) -> Column:
    """A bar of filled and open cells for a share between 0 and 1."""
    filled = F.round(value * width).cast("int")
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))


def register(spark) -> None:
    """SQL names of the functions users call by name."""
    from pyspark.sql import types as T

    spark.udf.register("sha256_uuid", lambda h: None if h is None else f"{h[:8]}-{h[8:12]}-5{h[13:16]}-{int(h[16], 16) & 3 | 8:x}{h[17:20]}-{h[20:32]}", T.StringType())
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION est_tokens(t STRING) RETURNS BIGINT RETURN ceil(length(t) / 3)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION cosine_similarity(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 0D)")
