"""What the beginning of a file tells: binary or text, its language by name, its kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The share of bad bytes beyond which a head is binary (fixed value).
BAD = 0.30
#: Languages by extension and by whole name, and extensions of images (fixed values).
LANGUAGES = {
    "go": "go", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "py": "python", "rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "java": "java", "kt": "kotlin", "swift": "swift",
    "rb": "ruby", "php": "php", "sh": "bash", "bash": "bash", "zsh": "bash", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "ini", "ini": "ini", "xml": "xml", "html": "xml", "css": "css", "scss": "scss", "md": "markdown",
    "sql": "sql", "diff": "diff", "patch": "diff", "cs": "csharp", "zig": "zig", "lua": "lua", "vim": "vim",
}
WHOLE_NAMES = {"dockerfile": "dockerfile", "makefile": "makefile", "gnumakefile": "makefile"}
IMAGES = ["png", "jpg", "jpeg", "gif", "webp", "bmp"]


def _table(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def _extension(path: Column) -> Column:
    return F.regexp_extract(F.lower(path), r"\.([^./]*)$", 1)


def is_binary(head: Column) -> Column:
    """A head (binary) with a NUL byte, or with more than BAD of its bytes neither valid UTF-8 nor printable or white space; a replacement character that the head itself holds is good."""
    aligned = F.regexp_count(F.regexp_replace(F.hex(head), "(..)", "$1 "), F.lit("EF BF BD "))
    text = F.make_valid_utf8(head.cast("string"))
    good = F.regexp_replace(text, "[\\x01-\\x08\\x0e-\\x1f\ufffd]", "")
    return (F.instr(text, F.lit("\0")) > 0) | (F.octet_length(head) - F.octet_length(good) - 3 * aligned > BAD * F.octet_length(head))


def capped(content: Column, kilobytes: int) -> Column:
    """Struct (text, truncated, size): the first so many KiB as valid UTF-8, whether there is more, and the whole size."""
    most = kilobytes * 1024
    return F.struct(F.make_valid_utf8(F.substring(content, 1, most).cast("string")).alias("text"), (F.octet_length(content) > most).alias("truncated"), F.octet_length(content).cast("long").alias("size"))


def language(path: Column) -> Column:
    """The language of a file by its whole name, then by its extension; empty if unknown."""
    return F.coalesce(_table(WHOLE_NAMES)[F.regexp_extract(F.lower(path), "([^/]*)/*$", 1)], _table(LANGUAGES)[_extension(path)], F.lit(""))


def is_image(path: Column) -> Column:
    return _extension(path).isin(IMAGES)


def kind(path: Column, is_dir: Column, is_link: Column) -> Column:
    """directory, symlink, image, text or file, from the name alone."""
    return F.when(is_dir, "directory").when(is_link, "symlink").when(is_image(path), "image").when(language(path) != "", "text").otherwise("file")
