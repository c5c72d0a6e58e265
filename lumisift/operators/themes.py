"""Icon themes: their index files, the chain of inheritance, and the file that serves a name at a size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Themes that every chain ends with, extensions in order of preference, and how deep inheritance is followed (fixed values).
LAST, EXTENSIONS, DEEPEST = ["Adwaita", "hicolor"], [".png", ".svg"], 8
#: Bytes of an icon, at most.
MOST_BYTES = 1 << 20


def _positive(value: Column, default: Column | int) -> Column:
    number = F.when(F.trim(value).rlike(r"^\+?[0-9]{1,9}$"), F.trim(value).try_cast("int"))
    return F.when(number > 0, number).otherwise(default)


def index_sections(lines: DataFrame) -> DataFrame:
    """(theme, n, section, key, value) of index files (theme, n, value): n is the line that the section begins on, of a key the last value counts."""
    file = Window.partitionBy("theme").orderBy("n")
    rows = lines.select("theme", "n", F.trim("value").alias("text")).where("text <> '' and not startswith(text, '#') and not startswith(text, ';')")
    head = F.when(F.col("text").rlike(r"(?s)^\[.*\]$"), F.struct(F.col("n").alias("at"), F.trim(F.expr("substring(text, 2, length(text) - 2)")).alias("name")))
    rows = rows.withColumn("head", head).withColumn("section", F.last("head", ignorenulls=True).over(file)).where("head is null and section is not null and instr(text, '=') > 0")
    key, value = F.trim(F.substring_index("text", "=", 1)), F.trim(F.expr("substring(text, instr(text, '=') + 1)"))
    return rows.select("theme", F.col("section.at").alias("start"), F.col("section.name").alias("section"), key.alias("key"), value.alias("value"), "n").groupBy("theme", "start", "section", "key").agg(F.max_by("value", "n").alias("value")).withColumnRenamed("start", "n")


def theme_dirs(sections: DataFrame) -> DataFrame:
    """(theme, ord, dir, size, scale, least, most, threshold, type): the folders of icons, sections with a positive size, in order of the file."""
    wide = sections.where("section not in ('', 'Icon Theme')").groupBy("theme", "n", "section").pivot("key", ["Size", "Scale", "MinSize", "MaxSize", "Threshold", "Type"]).agg(F.first("value"))
    size = _positive(F.col("Size"), F.lit(None).cast("int"))
    kind = F.lower("Type")
    return wide.withColumn("size", size).where("size is not null").select(
        "theme", F.col("n").alias("ord"), F.col("section").alias("dir"), "size", _positive(F.col("Scale"), F.lit(1)).alias("scale"), _positive(F.col("MinSize"), F.col("size")).alias("least"), _positive(F.col("MaxSize"), F.col("size")).alias("most"),
        _positive(F.col("Threshold"), F.lit(2)).alias("threshold"), F.when(kind.isin("fixed", "scalable"), kind).otherwise("threshold").alias("type"),
    )


def inherits(sections: DataFrame) -> DataFrame:
    """(theme, ord, above): the themes that a theme names as those it inherits from."""
    rows = sections.where("section = 'Icon Theme' and key = 'Inherits'").groupBy("theme").agg(F.max_by("value", "n").alias("value"))
    return rows.select("theme", F.posexplode(F.filter(F.transform(F.split("value", ","), lambda x: F.trim(x)), lambda x: x != "")).alias("ord", "above"))


def chains(wanted: DataFrame, edges: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """(start, ord, theme): for each theme wanted (start) the themes that are looked at in turn: itself, depth first what it inherits from, each once, and at last the common ones.

    edges: (theme, ord, above). Levels are joined one after the other, ``deepest`` at most, along ways that no theme is on twice; a walk over
    a start's ways in order then keeps what it meets first.
    """
    level = wanted.where("start <> ''").distinct().select("start", F.col("start").alias("theme"), F.array(F.col("start")).alias("way"), F.array().cast("array<int>").alias("place"))
    every = level
    for _ in range(deepest):
        level = level.join(edges, "theme").where(~F.array_contains("way", F.col("above"))).select("start", F.col("above").alias("theme"), F.array_append("way", F.col("above")).alias("way"), F.array_append("place", F.col("ord")).alias("place"))
        every = every.union(level)
    met = every.groupBy("start").agg(F.array_sort(F.collect_list(F.struct("place", "theme"))).alias("steps"))
    none = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<array<int>>").alias("open"))

    def walk(acc: Column, x: Column) -> Column:
        depth = F.size(x["place"])
        over = F.slice(x["place"], F.lit(1), F.greatest(depth - 1, F.lit(0)))
        first = ((depth == 0) | F.array_contains(acc["open"], over)) & ~F.array_contains(acc["seen"], x["theme"])
        return F.when(first, F.struct(F.array_append(acc["seen"], x["theme"]).alias("seen"), F.array_append(acc["open"], x["place"]).alias("open"))).otherwise(acc)

    found = met.select("start", F.aggregate("steps", none, walk)["seen"].alias("seen"))
    known = wanted.select("start").distinct().join(found, "start", "left")
    whole = F.concat(F.coalesce("seen", F.array().cast("array<string>")), F.array_except(F.array(*(F.lit(x) for x in LAST)), F.coalesce("seen", F.array().cast("array<string>"))))
    return known.select("start", F.posexplode(whole).alias("ord", "theme"))


def serves(size: Column) -> Column:
    """Whether a folder serves the size in pixels exactly."""
    at = F.col("size") * F.col("scale")
    scalable = (F.col("least") * F.col("scale") <= size) & (size <= F.col("most") * F.col("scale"))
    return F.when(F.col("type") == "fixed", at == size).when(F.col("type") == "scalable", scalable).otherwise(F.abs(size - at) <= F.col("threshold") * F.col("scale"))


def distance(size: Column) -> Column:
    """How far a folder's sizes are from the size in pixels."""
    scale, low, high = F.col("scale"), F.col("least") * F.col("scale"), F.col("most") * F.col("scale")
    scalable = F.when(size < low, low - size).when(size > high, size - high).otherwise(0)
    threshold = F.when(size < (F.col("size") - F.col("threshold")) * scale, low - size).when(size > (F.col("size") + F.col("threshold")) * scale, size - high).otherwise(0)
    return F.when(F.col("type") == "fixed", F.abs(F.col("size") * scale - size)).when(F.col("type") == "scalable", scalable).otherwise(threshold)


def safe_name(name: Column) -> Column:
    return F.coalesce((name != "") & ~name.rlike(r"[/\\]") & ~name.contains(".."), F.lit(False))


def bare_name(name: Column) -> Column:
    """A name without one of the extensions that launchers shouldn't give and do."""
    return F.regexp_replace(name, r"(?i)\.(png|svg|xpm)$", "")


def lookup(wanted: DataFrame, chain: DataFrame, dirs: DataFrame, files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(start, name, pixels, path): the file that serves each name at a size under a theme; names without one have no row.

    wanted: (start, name, pixels); chain: (start, ord, theme); dirs: (theme, ord, dir, ...) of ``theme_dirs``; files: (base, theme, dir, name, ext, bytes, path), base
    the place of its folder among the bases; files that lie loose in a base have no theme and no dir, those of the last folders have the base after all of
    them. The first theme that has the name decides: a folder that serves the size, else the nearest one, by order of
    folders, bases and extensions; after all themes the loose files.
    """
    usable = files.where((F.col("bytes") > 0) & (F.col("bytes") <= most_bytes) & F.col("ext").isin(EXTENSIONS)).withColumn("e", F.array_position(F.array(*(F.lit(x) for x in EXTENSIONS)), F.col("ext")))
    asked = wanted.where(safe_name(F.col("name"))).distinct()
    of_themes = asked.join(usable.where("theme is not null"), "name").join(chain.withColumnRenamed("ord", "turn"), ["start", "theme"]).join(dirs.withColumnRenamed("ord", "place"), ["theme", "dir"])
    exact = serves(F.col("pixels"))
    ranked = of_themes.select("start", "name", "pixels", F.struct("turn", F.when(exact, 0).otherwise(1).alias("kind"), F.when(exact, 0).otherwise(distance(F.col("pixels"))).alias("far"), "place", F.col("base").cast("int").alias("base"), "e", "path").alias("r"))
    last = F.lit((1 << 31) - 1)
    loose = asked.join(usable.where("theme is null"), "name").select("start", "name", "pixels", F.struct(last.alias("turn"), F.lit(0).alias("kind"), F.lit(0).alias("far"), F.lit(0).alias("place"), F.col("base").cast("int").alias("base"), "e", "path").alias("r"))
    return ranked.select("start", "name", "pixels", "r.*").unionByName(loose.select("start", "name", "pixels", "r.*")).groupBy("start", "name", "pixels").agg(F.min(F.struct("turn", "kind", "far", "place", "base", "e", "path")).alias("b")).select("start", "name", "pixels", "b.path")


def generic_icons(lines: DataFrame) -> DataFrame:
    """(type, icon) of ``type:icon`` lines (dir, n, value): of a type the first line of the earliest folder counts."""
    text = F.trim("value")
    rows = lines.where((text != "") & ~text.startswith("#") & text.contains(":")).select("dir", "n", F.substring_index(text, ":", 1).alias("type"), F.expr("substring(trim(value), instr(trim(value), ':') + 1)").alias("icon")).where("type <> '' and icon <> ''")
    return rows.groupBy("type").agg(F.min_by("icon", F.struct("dir", "n")).alias("icon"))


def size_rank(nominal: Column, wanted: Column) -> Column:
    """How well an entry of a nominal size serves the wanted one, the least best: as large or larger ones first, then smaller ones, then those of no known size."""
    return F.when(nominal >= wanted, nominal - wanted).when(nominal > 0, F.lit(1 << 20) + wanted - nominal).otherwise(F.lit(1 << 30))
