"""Browser tables, icons, names of types, commands and rewrites."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import matching as M
from ..functions import paths as P

#: Visit types that don't count (fixed values: embedded and framed links).
EMBEDDED, FRAMED = 4, 8


def frequent_sites(places: DataFrame, visits: DataFrame, now: Column, least_month: int = 11, least_week: int = 1, limit: int = 50) -> DataFrame:
    """(id, url, title, host, c30, c7): sites of enough visits in 30 and 7 days. places (id, url, title, hidden), visits (place_id, ts, visit_type).

    Hidden and non-web places and embedded or framed visits don't count. Rows without a host go after the limit.
    """
    recent = visits.where(~F.col("visit_type").isin(EMBEDDED, FRAMED) & (F.col("ts") >= now - F.expr("INTERVAL 30 DAYS")))
    counts = recent.groupBy("place_id").agg(F.count("*").alias("c30"), F.sum(F.when(F.col("ts") >= now - F.expr("INTERVAL 7 DAYS"), 1).otherwise(0)).alias("c7")).where((F.col("c30") >= least_month) & (F.col("c7") >= least_week))
    web = places.where((F.coalesce("hidden", F.lit(0)) == 0) & (F.col("url").startswith("http://") | F.col("url").startswith("https://")))
    best = web.join(counts, web.id == counts.place_id).select("id", "url", F.coalesce("title", F.lit("")).alias("title"), "c30", "c7").orderBy(F.desc("c30"), F.desc("c7"), "url").limit(limit)
    return best.withColumn("host", P.url_host(F.col("url"))).where(F.coalesce("host", F.lit("")) != "")


def best_icons(icons: DataFrame, want: int, by: list[str], most_bytes: int = 1 << 20) -> DataFrame:
    """One icon (width, ord, size) for each group: the smallest of the wanted width or more, else the largest; the first on ties."""
    enough = F.col("width") >= want
    w = Window.partitionBy(*by).orderBy(F.desc(enough), F.when(enough, F.col("width")).otherwise(-F.col("width")), "ord")
    return icons.where((F.col("size") > 0) & (F.col("size") <= most_bytes)).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def page_icons(pages: DataFrame, bridge: DataFrame, icons: DataFrame, want: int) -> DataFrame:
    """(page_url, icon_url) by the page's own icons, else by its site's root favicon. pages (page_id, page_url), bridge (page_id, icon_id), icons (id, icon_url, width, root, ord, size)."""
    own = pages.join(bridge, "page_id").join(icons.withColumnRenamed("id", "icon_id"), "icon_id")
    own = best_icons(own, want, ["page_url"]).select("page_url", F.col("icon_url").alias("own_icon"))
    host = P.url_host(F.col("page_url"))
    other = F.when(host.startswith("www."), F.substring(host, 5, 4096)).otherwise(F.concat(F.lit("www."), host))
    roots = pages.select("page_url", F.explode(F.array(*(F.concat(F.lit(s), h, F.lit("/favicon.ico")) for h in (host, other) for s in ("https://", "http://")))).alias("icon_url"))
    rooted = best_icons(roots.join(icons.where("root"), "icon_url"), want, ["page_url"]).select("page_url", F.col("icon_url").alias("root_icon"))
    return pages.select("page_url").join(own, "page_url", "left").join(rooted, "page_url", "left").select("page_url", F.coalesce("own_icon", "root_icon").alias("icon_url"))


def open_tabs(sessions: DataFrame, most: int = 500) -> DataFrame:
    """Tabs of nested sessions (windows: array of (tabs: array of (entries: array of (url, title), index, hidden))), each at its current entry.

    Hidden and empty tabs and those that aren't on the web are left out; the first ``most`` by window and tab.
    """
    tabs = sessions.select(F.posexplode("windows").alias("win", "w")).select("win", F.posexplode("w.tabs").alias("tab", "t")).where(~F.coalesce("t.hidden", F.lit(False)) & (F.size("t.entries") > 0))
    at = F.greatest(F.lit(1), F.least(F.coalesce("t.index", F.lit(1)), F.size("t.entries"))).cast("int")
    now = tabs.select("win", "tab", F.element_at("t.entries", at).alias("e"))
    return now.where(P.is_web_url(F.col("e.url"))).orderBy("win", "tab").limit(most).select("win", "tab", F.col("e.url").alias("url"), P.title_or_host(F.col("e.title"), F.col("e.url")).alias("title"))


def types_of_names(names: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(name, type): the type of a name's longest suffix, then of the highest weight. suffixes (suffix, type, weight) is a small table."""
    return types_of_globs(names, suffixes.select(F.concat(F.lit("*"), "suffix").alias("glob"), "type", "weight"))


def types_of_globs(names: DataFrame, globs: DataFrame) -> DataFrame:
    """(name, type) of each row of names: that of the glob which is the name itself, else of the longest ``*`` with a suffix, else of the first other glob by weight.

    globs: a small table (glob, type, weight), optionally with cs (matches in this case only) and ord (the first wins ties; else by type). Each distinct
    length of a suffix is looked up once in it, so no name is spread over its suffixes.
    """
    rows = globs.select("glob", "type", "weight", *(F.col(c) if c in globs.columns else F.lit(v).alias(c) for c, v in (("cs", False), ("ord", 0)))).where("glob <> ''").collect()
    rows = sorted(rows, key=lambda r: (-r["weight"], r["ord"], r["type"] if "ord" not in globs.columns else ""), reverse=False)
    literal: dict[tuple[bool, str], tuple[str, int]] = {}
    suffix: dict[int, dict[tuple[bool, str], tuple[str, int]]] = {}
    other = F.lit(None).cast("string")
    special = re.compile(r"[*?\[]")
    for r in rows:
        cs, glob = bool(r["cs"]), r["glob"] if r["cs"] else r["glob"].lower()
        if not special.search(glob):
            literal.setdefault((cs, glob), (r["type"], r["weight"]))
        elif glob[0] == "*" and len(glob) > 1 and not special.search(glob[1:]):
            suffix.setdefault(len(glob) - 1, {}).setdefault((cs, glob[1:]), (r["type"], r["weight"]))
    for r in reversed(rows):
        glob = r["glob"] if r["cs"] else r["glob"].lower()
        if special.search(glob) and not (glob[0] == "*" and len(glob) > 1 and not special.search(glob[1:])):
            try:
                other = F.when((F.col("name") if r["cs"] else F.lower("name")).rlike(M.glob_pattern(glob)), r["type"]).otherwise(other)
            except ValueError:
                pass  # a malformed glob matches nothing

    def look(table: dict[tuple[bool, str], tuple[str, int]], text: Column) -> list[Column]:
        """The types under the text as it stands and folded, the heavier first."""
        if not table:
            return []
        found = {cs: {k: v for (c, k), v in table.items() if c == cs} for cs in (True, False)}
        exact, folded = ((F.create_map(*(F.lit(x) for k, (t, w) in part.items() for x in (k, f"{w:09d}{t}"))) if part else None) for part in (found[True], found[False]))
        own = [m[k] for m, k in ((exact, text), (folded, F.lower(text))) if m is not None]
        if len(own) == 1:
            return [F.substring(own[0], 10, 1 << 30)]
        heavier = F.when(F.substring(own[0], 1, 9) >= F.coalesce(F.substring(own[1], 1, 9), F.lit("")), own[0]).otherwise(F.coalesce(own[1], own[0]))
        return [F.substring(heavier, 10, 1 << 30)]

    name = F.col("name")
    tiers = [*look({k: v for k, v in literal.items() if k[0]}, name), *look({k: v for k, v in literal.items() if not k[0]}, name)]
    for n in sorted(suffix, reverse=True):
        tiers += [F.when(F.length(name) >= n, c) for c in look(suffix[n], F.right(name, F.lit(n)))]
    return names.select("name", F.when(name != "", F.coalesce(*tiers, other)).alias("type"))


def icon_names(kind: Column, generic: dict[str, str]) -> Column:
    """The names of icons for a type, the most specific first: its own, the generic one that a small table gives it, and that of its class."""
    first = F.substring_index(kind, "/", 1)
    own = F.create_map(*(F.lit(x) for pair in generic.items() for x in pair))[kind] if generic else F.lit(None).cast("string")
    by_class = F.concat(F.when(first.isin("text", "image", "audio", "video", "font"), first).otherwise("application"), F.lit("-x-generic"))
    return F.when(kind != "", F.array_distinct(F.filter(F.array(F.replace(kind, F.lit("/"), F.lit("-")), own, by_class), lambda x: x.isNotNull())))


#: Field codes of launchers (fixed values).
_CODES = "fFuUdDnNickvm"


def exec_arguments(line: Column) -> Column:
    """The arguments of a launcher's command line: double quotes group, a backslash in them escapes, ``%%`` is a per cent sign, field codes go.

    A fold over the line's tokens; no token's pattern repeats a group, so lines of any length are read without recursion.
    """
    tokens = F.regexp_extract_all(line, F.lit(rf'\\|"|[ \t]+|%[%{_CODES}]|[^"\\ \t%]+|%'), F.lit(0))
    none = F.struct(F.array().cast("array<string>").alias("args"), F.lit("").alias("arg"), F.lit(False).alias("kept"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"))

    def state(acc: Column, **changed: Column | bool | str) -> Column:
        return F.struct(*(F.lit(changed[c]).alias(c) if c in changed and not isinstance(changed[c], Column) else changed.get(c, acc[c]).alias(c) for c in ("args", "arg", "kept", "quoted", "escaped")))

    def ended(acc: Column) -> Column:
        return F.when(acc["kept"], F.array_append(acc["args"], acc["arg"])).otherwise(acc["args"])

    def step(acc: Column, token: Column) -> Column:
        text = state(acc, arg=F.concat(acc["arg"], token), kept=True, escaped=False)
        quoted = F.when(acc["escaped"], text).when(token == "\\", state(acc, escaped=True)).when(token == '"', state(acc, quoted=False)).otherwise(text)
        bare = F.when(token == '"', state(acc, quoted=True, kept=True)).when(token.rlike("^[ \\t]"), state(acc, args=ended(acc), arg="", kept=False))
        bare = bare.when(token == "%%", state(acc, arg=F.concat(acc["arg"], F.lit("%")), kept=True)).when(token.rlike(f"^%[{_CODES}]$"), acc).otherwise(text)
        return F.when(acc["quoted"], quoted).otherwise(bare)

    return F.aggregate(tokens, none, step, ended)


def parse_command(query: Column, sigils: str = "!/@") -> Column:
    """Struct (sigil, name, rest, complete) of a command, null if the query is none."""
    pattern = rf"(?s)^([{sigils}])([A-Za-z0-9_-]*)( (.*))?$"
    return F.when(query.rlike(pattern), F.struct(F.regexp_extract(query, pattern, 1).alias("sigil"), F.lower(F.regexp_extract(query, pattern, 2)).alias("name"), F.regexp_extract(query, pattern, 4).alias("rest"), (F.regexp_extract(query, pattern, 3) != "").alias("complete")))


def resolve_commands(names: DataFrame, commands: DataFrame) -> DataFrame:
    """(name, provider, command): the command of this name, else that of this alias, else the only one that begins so.

    commands: (command, provider, aliases), a small table.
    """
    exact = commands.select(F.col("command").alias("name"), F.struct("provider", "command").alias("by_name"))
    alias = commands.select(F.explode("aliases").alias("name"), F.struct("provider", "command").alias("by_alias")).dropDuplicates(["name"])
    begins = commands.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("command")), lambda k: F.left(F.col("command"), k))).alias("name"), "provider", "command")
    only = begins.groupBy("name").agg(F.count("*").alias("n"), F.first(F.struct("provider", "command")).alias("by_prefix")).where("n = 1").drop("n")
    out = names.join(F.broadcast(exact), "name", "left").join(F.broadcast(alias), "name", "left").join(F.broadcast(only), "name", "left")
    return out.withColumn("r", F.coalesce("by_name", "by_alias", "by_prefix")).select("name", "r.provider", "r.command")


def rewrites(queries: DataFrame, rules: list[tuple[str, str]], most: int = 8) -> DataFrame:
    """(query, ord, url): web addresses that rules (pattern, template) make of a query, in order of the rules.

    A pattern without ^ and $ must match the whole query; templates name groups as $1 or ${name}.
    """
    made = []
    for i, (pattern, template) in enumerate(rules):
        body = pattern if pattern.startswith("^") or pattern.endswith("$") else f"^(?:{pattern})$"
        whole = f"(?s)^.*?(?:{body}).*$" if not body.startswith("^") else f"(?s){body}" + ("" if body.endswith("$") else ".*$")
        made.append(F.struct(F.lit(i).alias("ord"), F.when(F.col("query").rlike(body), F.regexp_replace("query", whole, template)).alias("url")))
    rows = queries.select("query", F.explode(F.array(*made)).alias("m")).select("query", "m.*").where(F.col("url").isNotNull() & P.is_web_url(F.col("url")))
    return rows.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("ord"))).where(F.col("n") <= most).drop("n")


def first_rules(names: DataFrame, rules: list[tuple[str, str]], default: str) -> DataFrame:
    """(name, icon) by the first rule (regular expression on the lower-cased name, icon) that matches."""
    icon = F.lit(default)
    for pattern, value in reversed(rules):
        icon = F.when(F.lower("name").rlike(pattern), value).otherwise(icon)
    return names.select("name", icon.alias("icon"))
