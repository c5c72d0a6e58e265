"""Column builders on paths, URLs, numbers and signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories of noise, by lower-cased name (fixed values).
NOISE_DIRS = [".cache", "cache", ".git", "node_modules", "tmp", ".tmp", "temp", ".temp"]
#: Costs of a path's location (fixed values).
NOISE_COST, DOT_COST, DEPTH_COST, DEPTH_MOST, DEPTH_FREE = 0.3, 0.1, 0.05, 0.25, 6
#: Half-life of opens and picks, and the horizon of recency.
HALF_LIFE_DAYS, HORIZON_HOURS = 14, 720
#: The prior of a rate: picks and impressions that each key starts with, its weight and its bound (fixed values).
RATE_PICKS, RATE_SMOOTH, RATE_WEIGHT, RATE_BOUND, EXACT_WEIGHT = 1.0, 20.0, 0.2, 1.5, 6.0


def entry_path(parent: Column, name: Column) -> Column:
    """Directory and name joined; the root keeps its separator."""
    return F.when(parent.endswith("/"), F.concat(parent, name)).otherwise(F.concat(parent, F.lit("/"), name))


def components(path: Column) -> Column:
    """Parts between slashes of either kind, without empty ones."""
    return F.filter(F.split(path, r"[/\\]"), lambda x: x != "")


def depth(path: Column) -> Column:
    return F.size(components(path))


def within(path: Column, directory: Column) -> Column:
    """The directory itself, or below it."""
    return (path == directory) | path.startswith(F.when(directory.endswith("/"), directory).otherwise(F.concat(directory, F.lit("/"))))


def ancestors(path: Column) -> Column:
    """All directories above a path that begins with a slash, nearest last, the root included."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.when(k == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, 1, k), "/")))


def holder(path: Column) -> Column:
    """The last of a path's ``ancestors``; its own ancestors and itself are those of the path, so one of them stands for all that it holds."""
    head = F.substring(path, F.lit(1), F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1)
    return F.when(~F.contains(path, F.lit("/")), "").when(~F.contains(head, F.lit("/")), "/").otherwise(head)


def above(path: Column) -> Column:
    """A path with all directories above it."""
    return F.array_distinct(F.array_append(ancestors(path), path))


def path_penalty(path: Column) -> Column:
    """How noisy a path's directories are, 0 to 1; the last part never counts but for the depth."""
    parts = components(path)
    dirs = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    cost = F.aggregate(dirs, F.lit(0.0), lambda s, x: s + F.when(F.lower(x).isin(NOISE_DIRS), NOISE_COST).when(x.startswith(".") & ~x.isin(".", ".."), DOT_COST).otherwise(0.0))
    deep = F.least(F.greatest(F.size(parts) - DEPTH_FREE, F.lit(0)) * DEPTH_COST, F.lit(DEPTH_MOST))
    return F.least(cost + deep, F.lit(1.0))


def cwd_boost(path: Column, cwd: str, weight: float) -> Column:
    """The weight for the directory itself and its children, half for each further level, 0 elsewhere."""
    here = [x for x in cwd.replace("\\", "/").split("/") if x]
    if not here or weight <= 0:
        return F.lit(0.0)
    parts = components(path)
    inside = F.slice(parts, 1, len(here)) == F.array(*(F.lit(x) for x in here))
    return F.when(inside, weight * F.pow(F.lit(0.5), F.greatest(F.size(parts) - len(here) - 1, F.lit(0)))).otherwise(0.0)


def recency_score(hours: Column) -> Column:
    """1 for what is new, falling with the logarithm of the age to 0 at the horizon."""
    return F.when(hours <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.log1p(hours) / F.log1p(F.lit(float(HORIZON_HOURS)))))


def decayed(count: Column, age_seconds: Column, half_life_days: float = HALF_LIFE_DAYS) -> Column:
    """The count halved for each half-life; times that haven't come yet don't grow it."""
    return count * F.pow(F.lit(2.0), -F.greatest(age_seconds, F.lit(0.0)) / (half_life_days * 86400.0))


def extension_key(path: Column) -> Column:
    """The lower-cased extension of the last part, with its dot."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def directory_key(path: Column, parts: int = 3) -> Column:
    """The first directories of a path as they're written; the last part never counts."""
    return F.regexp_extract(path, rf"^((?:[/\\]*[^/\\]+){{0,{parts}}})(?=[/\\])", 1)


def top_component(path: Column) -> Column:
    return F.regexp_extract(path, "^(/[^/]*)", 1)


def rate_term(picks: Column, impressions: Column) -> Column:
    """The nudge of a smoothed pick rate against the base rate; a key that hasn't been seen has none."""
    odds = F.log((picks + RATE_PICKS) / (impressions + RATE_PICKS * RATE_SMOOTH) * RATE_SMOOTH)
    return F.coalesce(RATE_WEIGHT * F.greatest(F.lit(-RATE_BOUND), F.least(F.lit(RATE_BOUND), odds)), F.lit(0.0))


def exact_term(weight: Column) -> Column:
    return F.coalesce(EXACT_WEIGHT * weight / (1 + weight), F.lit(0.0))


def number_key(path: Column) -> Column:
    """A sort key under which aligned runs of digits stand in falling order and all else in byte order (runs under a million digits)."""

    def key(run: Column) -> Column:
        digits = F.regexp_replace(run, "^0+", "")
        return F.when(run.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad((F.lit(999_999) - F.length(digits)).cast("string"), 6, "0"), F.translate(digits, "0123456789", "9876543210"))).otherwise(run)

    return F.array_join(F.transform(F.regexp_extract_all(path, F.lit("([0-9]+|[^0-9]+)"), F.lit(1)), key), "")


def url_host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def is_web_url(url: Column) -> Column:
    """http or https with a host."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))).isin("http", "https") & (F.coalesce(url_host(url), F.lit("")) != ""), F.lit(False))


def title_or_host(title: Column, url: Column) -> Column:
    return F.when(F.trim(F.coalesce(title, F.lit(""))) != "", title).otherwise(url_host(url))


def merge_positions(positions: Column) -> Column:
    """Positions -> sorted, merged half-open ranges."""
    empty = F.array().cast("array<array<int>>")

    def add(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        return F.when((F.size(out) > 0) & (last[1] == x), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.array(last[0], x + 1)))).otherwise(F.concat(out, F.array(F.array(x, x + 1))))

    return F.aggregate(F.array_sort(F.array_distinct(positions)).cast("array<int>"), empty, add)


def merge_ranges(ranges: Column, length: Column, most: int = 32) -> Column:
    """Half-open ranges clamped to the text, sorted, merged where they touch, the first ``most``."""
    empty = F.array().cast("array<array<int>>")
    clamped = F.filter(F.transform(ranges.cast("array<array<int>>"), lambda r: F.array(F.greatest(r[0], F.lit(0)), F.least(r[1], length.cast("int")))), lambda r: r[0] < r[1])

    def add(out: Column, x: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        joins = (F.size(out) > 0) & (x[0] <= last[1])
        return F.when(joins, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.array(last[0], F.greatest(last[1], x[1]))))).otherwise(F.concat(out, F.array(x)))

    return F.slice(F.aggregate(F.array_sort(clamped), empty, add), 1, most)


def human_size(n: Column, largest: str = "PB") -> Column:
    """Bytes in units of 1024 up to the largest one, one decimal unless it is 0."""
    units = ("KB", "MB", "GB", "TB", "PB")
    last = units.index(largest) + 1
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for k, unit in enumerate(units[:last], 1):
        value = F.regexp_replace(F.format_string("%.1f", F.bround(n / float(1024**k), 1)), r"\.0$", "")
        out = out.when(n < 1024 ** (k + 1), F.concat(value, F.lit(f" {unit}"))) if k < last else out.otherwise(F.concat(value, F.lit(f" {unit}")))
    return out


def fnv_bucket(text: Column, buckets: int) -> Column:
    """FNV-1a of the UTF-8 bytes, modulo buckets."""
    digits = F.hex(F.encode(text, "UTF-8"))
    codes = F.transform(F.filter(F.split(F.regexp_replace(digits, "(..)", "$1 "), " "), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("long"))
    return F.aggregate(codes, F.lit(2166136261).cast("long"), lambda h, b: F.pmod(h.bitwiseXOR(b) * F.lit(16777619).cast("long"), F.lit(4294967296))) % buckets


def saturate(v: Column) -> Column:
    return F.when(v > 0, v / (1 + v)).otherwise(0.0)


def clamp(v: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def rgb_to_hsl(r: Column, g: Column, b: Column) -> Column:
    """Struct (h, s, l) of whole degrees and percents from 0..255 channels."""
    r, g, b = r / 255.0, g / 255.0, b / 255.0
    most, least = F.greatest(r, g, b), F.least(r, g, b)
    span, light = most - least, (most + least) / 2
    sat = F.when(span == 0, 0.0).when(light > 0.5, span / (2 - most - least)).otherwise(span / (most + least))
    hue = F.when(span == 0, 0.0).when(most == r, (g - b) / span + F.when(g < b, 6).otherwise(0)).when(most == g, (b - r) / span + 2).otherwise((r - g) / span + 4) * 60
    return F.struct(F.round(hue).cast("int").alias("h"), F.round(sat * 100).cast("int").alias("s"), F.round(light * 100).cast("int").alias("l"))
