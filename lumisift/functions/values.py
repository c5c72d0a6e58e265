"""Column builders for what is shown: rates, sizes and shares as text, image sizes and kinds, colours, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import paths as P

KB, MB, GB = 1 << 10, 1 << 20, 1 << 30

#: First bytes of image files (fixed values).
IMAGES = [(b"\x89PNG\r\n\x1a\n", "image/png"), (b"GIF87a", "image/gif"), (b"GIF89a", "image/gif"), (b"\xff\xd8\xff", "image/jpeg")]
LATE_IMAGES = [(b"\x00\x00\x01\x00", "image/x-icon"), (b"BM", "image/bmp")]


def short_number(v: Column) -> Column:
    """One decimal below 10, none from 10 on."""
    return F.when(v < 10, F.format_string("%.1f", v)).otherwise(F.floor(v + 0.5).cast("string"))


def percent(v: Column) -> Column:
    return F.concat(F.floor(v + 0.5).cast("string"), F.lit("%"))


def rate_text(v: Column, largest: str = "G") -> Column:
    """Bytes per second in binary units up to the largest one, K, M or G."""
    out = F.when(v < KB, F.concat(F.floor(v + 0.5).cast("string"), F.lit("B")))
    for unit, size in (("K", KB), ("M", MB), ("G", GB)):
        text = F.concat(short_number(v / float(size)), F.lit(unit))
        if unit == largest:
            return out.otherwise(text)
        out = out.when(v < size * 1024, text)
    raise ValueError(f"no unit {largest}")


def used_of_total(used: Column, total: Column) -> Column:
    """Both in the unit that the total chooses, the unit once."""
    unit = F.when(total >= GB, float(GB)).otherwise(float(MB))
    return F.concat(short_number(used / unit), F.lit("/"), short_number(total / unit), F.when(total >= GB, "G").otherwise("M"))


def fit_within(w: Column, h: Column, edge: int) -> Column:
    """Struct (w, h) scaled down so that the longer edge is at most ``edge``, 1 at least; an edge of 0 or less scales nothing."""
    scale = F.lit(float(edge)) / F.greatest(w, h)
    fits = F.lit(edge <= 0) | ((w <= edge) & (h <= edge))
    return F.struct(*(F.when(fits, x).otherwise(F.greatest(F.lit(1), F.floor(x * scale + 0.5))).cast("int").alias(k) for k, x in (("w", w), ("h", h))))


def image_type(data: Column) -> Column:
    """The media type that the bytes tell, null for what is no image."""
    out = F.when(F.lit(False), "")
    for head, kind in IMAGES:
        out = out.when(F.startswith(data, F.lit(bytearray(head))), kind)
    webp = F.startswith(data, F.lit(bytearray(b"RIFF"))) & (F.substring(data, 9, 4) == F.lit(bytearray(b"WEBP")))
    out = out.when(webp, "image/webp")
    for head, kind in LATE_IMAGES:
        out = out.when(F.startswith(data, F.lit(bytearray(head))), kind)
    text = F.regexp_replace(F.decode(data, "ISO-8859-1"), "^(ï»¿)?[ \t\r\n]*", "")
    return out.when(text.startswith("<") & F.left(text, F.lit(1024)).contains("<svg"), "image/svg+xml")


def hex_color(text: Column) -> Column:
    """Struct (r, g, b) of ``#rgb`` or ``#rrggbb``, null for anything else."""
    digits = F.regexp_extract(text, r"^#([0-9A-Fa-f]{3}|[0-9A-Fa-f]{6})$", 1)
    wide = F.when(F.length(digits) == 3, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    parts = [F.conv(F.substring(wide, 2 * i + 1, 2), 16, 10).cast("int").alias(k) for i, k in enumerate("rgb")]
    return F.when(digits != "", F.struct(*parts))


def leading_int(text: Column) -> Column:
    """The digits that the first line begins with, null without any."""
    return F.regexp_extract(text, r"^[ \t]*([0-9]+)", 1).try_cast("long")


def app_key(desktop_id: Column, argv: Column) -> Column:
    """The usage key of an application: its id, else its command line; empty without either."""
    has_id, has_argv = F.coalesce(desktop_id, F.lit("")) != "", F.coalesce(F.size(argv), F.lit(0)) > 0
    return F.when(has_id, F.concat(F.lit("app:"), desktop_id)).when(has_argv, F.concat(F.lit("app:"), F.array_join(argv, " "))).otherwise("")


#: Bytes of an icon that isn't a name, at most (a fixed value).
ICON_BYTES = 32
#: Sources of the engine's own applications (fixed names).
APPLICATIONS = ["apps", "apps-search"]


def safe_icon(icon: Column) -> Column:
    """An icon that is a name or a short sign; anything else is none."""
    name = icon.rlike("^[a-z0-9_-]+$")
    return F.when(name, icon).when((F.octet_length(icon) > ICON_BYTES) | icon.rlike(r"\p{Cc}"), "").otherwise(F.coalesce(icon, F.lit("")))


def page_icon_key(url: Column) -> Column:
    return F.when(F.coalesce(url, F.lit("")) == "", "").otherwise(F.concat(F.lit("favicon:"), url))


def picked_app_key(source: Column, action: Column, desktop_id: Column, arguments: Column) -> Column:
    """The key that a launch counts under: of a command that one of the engine's own sources of applications has run; else none."""
    return F.when(source.isin(APPLICATIONS) & (action == "run_command"), app_key(desktop_id, arguments)).otherwise("")


def meta_rows(path: Column, size: Column, modified: Column, mode: Column, kind: Column) -> Column:
    """What a card tells of a file: an array of (label, value)."""
    rows = [("Size", P.human_size(size)), ("Modified", F.date_format(modified, "yyyy-MM-dd HH:mm")), ("Mode", mode), ("Kind", kind), ("Path", path)]
    return F.array(*(F.struct(F.lit(k).alias("label"), v.alias("value")) for k, v in rows))
