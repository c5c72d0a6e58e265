"""Providers of results: callables that make a candidate DataFrame for a query, routed, cleaned and ranked together."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths as P
from . import web as W

from . import ranking
from ..functions import matching as M

CANDIDATE = "display string, texts array<string>, tie_break long, sort_key string, hint double, ord int, url string, command string"
#: Bounds of what a provider may answer (fixed values), and of suggested commands and rows of applications.
MOST_ROWS, LONGEST_TITLE, MOST_COMMANDS, MOST_APPS = 20, 200, 12, 6
#: The sign that commands are shown with.
SIGIL = "!"
ACTIONS = ["open_url", "open_path", "copy_text", "run_command"]


@dataclass(frozen=True)
class Trigger:
    """When a provider answers: after a prefix, on a regular expression, or always from ``least`` characters on."""

    prefix: str = ""
    pattern: str = ""
    always: bool = False
    least: int = 2

    def match(self, query: str) -> tuple[str, bool, bool]:
        """(what the provider gets, whether it answers, whether it claims the query)."""
        if self.prefix and M.term(query[: len(self.prefix)]).text == M.term(self.prefix).text:
            return query[len(self.prefix) :].strip(), True, True
        if self.pattern and re.search(self.pattern, query, re.I):
            return query, True, True
        if self.always and len(query.strip()) >= self.least:
            return query, True, False
        return "", False, False


@dataclass
class Provider:
    name: str
    candidates: Callable[[SparkSession, str], DataFrame]
    trigger: Trigger = field(default_factory=lambda: Trigger(always=True))
    command: str = ""
    aliases: tuple[str, ...] = ()
    priority: int = 0
    given: bool = False
    limit: int = MOST_ROWS
    #: A source of the engine's own: all its rows are candidates and its commands may run.
    own: bool = False
    #: The priority counts only where the best row matches at a word's start or better.
    strong: bool = False
    title: str = ""


class Registry:
    """Providers by name; a name that is taken is reported and left out."""

    def __init__(self, providers: list[Provider], suggest: bool = False):
        self.providers: dict[str, Provider] = {}
        self.suggest = suggest
        self.errors: list[str] = []
        for p in providers:
            if p.name in self.providers:
                self.errors.append(f"provider {p.name} is there already")
            else:
                self.providers[p.name] = p

    def resolve(self, name: str) -> list[Provider]:
        """The provider of a command, else of an alias, else all whose command begins so."""
        name = name.lower()
        for found in ([p for p in self.providers.values() if p.command and p.command == name], [p for p in self.providers.values() if name in p.aliases]):
            if found:
                return found[:1]
        return sorted((p for p in self.providers.values() if p.command and p.command.startswith(name)), key=lambda p: p.command)

    def suggestions(self, spark: SparkSession, query: str) -> DataFrame:
        """Candidates that complete a command query: the command that it means first, then all that begin so, each to be put in its place with what follows it."""
        sigil = query[:1]
        name, rest = re.fullmatch(r"(?s)([A-Za-z0-9_-]*)(.*)", query[1:]).groups()
        begins = sorted((p for p in self.providers.values() if p.command and p.command.startswith(name.lower())), key=lambda p: p.command)
        meant = self.resolve(name)
        order = [*meant[:1], *(p for p in begins if p is not meant[0])] if len(meant) == 1 else begins
        rows = [(SIGIL + p.command, [SIGIL + p.command], 0, p.command, None, i, None, f"{sigil}{p.command} {rest.strip()}") for i, p in enumerate(order) if p.command]
        return spark.createDataFrame(rows, CANDIDATE)

    def cheat_sheet(self, spark: SparkSession) -> DataFrame:
        """What a bare sigil suggests: (display, subtitle, command, rank) of the first commands."""
        titles = spark.createDataFrame([(SIGIL + p.command, p.title or p.name) for p in self.providers.values() if p.command], "display string, subtitle string")
        ranked = ranking.rank_given(self.suggestions(spark, SIGIL), MOST_COMMANDS)
        return ranked.join(F.broadcast(titles), "display").select("display", "subtitle", "command", "rank")  # a row for each command

    def dispatch(self, spark: SparkSession, query: str, fuzzy: bool = True) -> DataFrame:
        """Results of all providers that answer, by section and row; a provider that fails gives nothing and is reported."""
        command = re.fullmatch(r"(?s)[!/@]([A-Za-z0-9_-]*)(?: (.*))?", query)
        out = []
        targets = self.resolve(command[1]) if command else list(self.providers.values())
        if command and len(targets) != 1:
            targets = [*targets, Provider("commands", lambda s, _: self.suggestions(s, query), given=True, limit=MOST_COMMANDS, own=True)] if self.suggest else targets
        for p in targets:
            text, answers, claims = (command[2] or "", True, False) if command else p.trigger.match(query)
            if not answers:
                continue
            try:
                rows = p.candidates(spark, text) if p.own else clean(p.candidates(spark, text))
                if p.given:
                    ranked = ranking.rank_given(rows, p.limit)
                elif claims:
                    ranked = ranking.rank_claimed(rows, p.limit)
                elif not text.strip():
                    ranked = ranking.rank_listed(rows, p.limit)
                else:
                    ranked = ranking.rank_matched(rows, [F.get("texts", F.lit(i)) for i in range(3)], text, fuzzy, p.limit)
                best = F.min("tier").over(Window.partitionBy(F.lit(0)))  # of no more rows than the limit
                priority = F.when(best <= M.WORD_START, F.lit(p.priority)).otherwise(F.lit(0)) if p.strong else F.lit(p.priority)
                out.append(ranked.select(F.lit(p.name).alias("source"), priority.cast("int").alias("priority"), "display", "score", F.col("rank").alias("ord"), "url", "command"))
            except Exception as error:  # one provider must not take the others along
                self.errors.append(f"{p.name}: {error}")
        if not out:
            return spark.createDataFrame([], "source string, priority int, display string, score double, ord long, url string, command string, section_rank long, row_rank long")
        rows = out[0]
        for more in out[1:]:
            rows = rows.unionByName(more)
        return ranking.sections(rows)


def clean(rows: DataFrame, allow_commands: bool = False) -> DataFrame:
    """The first rows of an answer with titles cut, control characters as blanks, and addresses and commands that aren't allowed taken out."""
    from ..functions.paths import is_web_url

    title = F.left(F.regexp_replace(F.coalesce("display", F.lit("")), r"\p{Cc}", " "), F.lit(LONGEST_TITLE))
    rows = rows.orderBy("ord").limit(MOST_ROWS).withColumn("display", title).where(F.trim("display") != "")
    rows = rows.where(F.col("url").isNull() | is_web_url(F.col("url")))
    return rows if allow_commands else rows.withColumn("command", F.lit(None).cast("string"))


def focused_boost(score: Column, name: Column, pattern: str, boost: int) -> Column:
    """Scores raised where the focused application's name matches."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.coalesce(score, F.lit(50.0)) + F.when(name.rlike(f"(?i){pattern}"), boost).otherwise(0)))


def usage_tie_break(count: Column) -> Column:
    """A decayed count of launches as a whole tie break; 0 for none."""
    return F.when(count > 0, F.round(count * 1000).cast("long")).otherwise(F.lit(0).cast("long"))


def applications(apps: DataFrame, launches: DataFrame | None = None) -> DataFrame:
    """Candidates of installed applications (id, name, exec and other columns, which pass): display, arguments, subtitle, sort_key and tie_break by launches.

    launches: (key, n), the decayed count under ``desktop:<id>``. Applications without a command to run drop out.
    """
    rows = apps.withColumn("arguments", W.exec_arguments(F.col("exec"))).where((F.size("arguments") > 0) & (F.get("arguments", F.lit(0)) != ""))
    rows = rows.withColumns({"display": F.col("name"), "subtitle": F.array_join("arguments", " "), "sort_key": F.coalesce("id", F.lit("")), "key": F.concat(F.lit("desktop:"), "id")})
    if launches is None:
        return rows.withColumn("tie_break", F.lit(0).cast("long")).drop("key")
    return rows.join(launches.select("key", "n"), "key", "left").withColumn("tie_break", usage_tie_break(F.col("n"))).drop("key", "n")


def sites(frequent: DataFrame) -> DataFrame:
    """Candidates of frequent sites (url, title, host, c30): the title or host to show, and visits as tie break."""
    return frequent.withColumns({"display": P.title_or_host(F.col("title"), F.col("url")), "subtitle": F.col("url"), "sort_key": F.col("url"), "tie_break": F.col("c30").cast("long")})


def tabs(found: DataFrame) -> DataFrame:
    """Candidates of open tabs (url, title, win, tab): the order of windows and tabs breaks ties."""
    return found.withColumns({"display": P.title_or_host(F.col("title"), F.col("url")), "subtitle": P.url_host(F.col("url")), "sort_key": F.format_string("%08d.%08d", "win", "tab"), "tie_break": F.lit(0).cast("long")})


def _shaped(rows: DataFrame, texts: list[Column], url: Column, command: Column) -> DataFrame:
    """Rows with display, sort_key and tie_break in the shape of CANDIDATE; ties stand in order of the sort key."""
    return rows.select("display", F.array(*texts).alias("texts"), F.coalesce(F.col("tie_break"), F.lit(0)).cast("long").alias("tie_break"), F.coalesce("sort_key", F.lit("")).alias("sort_key"), F.lit(None).cast("double").alias("hint"), F.lit(0).alias("ord"), url.alias("url"), command.alias("command"))


def _bare_host(url: Column) -> Column:
    return F.regexp_replace(F.lower(P.url_host(url)), "^www[.]", "")


def site_candidates(frequent: DataFrame) -> DataFrame:
    """Frequent sites (url, title, host, c30) as candidates: found by host, title and address, visits break ties."""
    return _shaped(sites(frequent), [_bare_host(F.col("url")), F.coalesce("title", F.lit("")), F.col("url")], F.col("url"), F.lit(None).cast("string"))


def tab_candidates(found: DataFrame) -> DataFrame:
    """Open tabs (url, title, last_accessed and, of live ones, conn and id) as candidates: found by title, host and address, the latest first; the command of a live tab names it."""
    rows = found.withColumns({"display": P.title_or_host(F.col("title"), F.col("url")), "sort_key": F.col("url"), "tie_break": F.col("last_accessed") if "last_accessed" in found.columns else F.lit(0)})
    token = F.concat(F.lit("tab "), F.col("conn"), F.lit(" "), F.col("id")) if {"conn", "id"} <= set(found.columns) else F.lit(None).cast("string")
    return _shaped(rows, [F.coalesce("title", F.lit("")), _bare_host(F.col("url")), F.col("url")], F.col("url"), token)


def application_candidates(apps: DataFrame, launches: DataFrame | None = None) -> DataFrame:
    """Installed applications (id, name, exec) as candidates: found by name, launches break ties; the command is what runs."""
    rows = applications(apps, launches).withColumn("sort_key", F.col("subtitle"))
    return _shaped(rows, [F.col("display")], F.lit(None).cast("string"), F.col("subtitle"))


def command_candidates(commands: DataFrame, name: str) -> DataFrame:
    """The one command (command, title) of the engine itself that a query names, as a candidate."""
    return _shaped(commands.where(F.col("command") == name).withColumns({"display": F.col("title"), "sort_key": F.col("command"), "tie_break": F.lit(0)}), [F.col("title")], F.lit(None).cast("string"), F.col("command"))


def built_in(frequent: DataFrame | None = None, tabs: DataFrame | None = None, apps: DataFrame | None = None, launches: DataFrame | None = None, commands: dict[str, str] | None = None) -> list[Provider]:
    """The engine's own sources over these tables, ready for a Registry: applications in every search and by command, frequent sites, open tabs, commands (name: title)."""
    out = []
    if apps is not None:
        found = application_candidates(apps, launches)
        out.append(Provider("apps-search", lambda s, q: found, Trigger(always=True), priority=1, limit=MOST_APPS, own=True, strong=True, title="Apps"))
        out.append(Provider("apps", lambda s, q: found, Trigger(), command="app", aliases=("launch",), own=True, title="Apps"))
    if frequent is not None:
        out.append(Provider("firefox-frequent", lambda s, q: site_candidates(frequent), Trigger(always=True), command="site", priority=1, own=True, strong=True, title="Frequent sites"))
    if tabs is not None:
        out.append(Provider("firefox-tabs", lambda s, q: tab_candidates(tabs), Trigger(always=True), command="tab", priority=1, own=True, strong=True, title="Open tabs"))
    for name, title in (commands or {}).items():
        out.append(Provider(f"command-{name}", lambda s, q, name=name, title=title: command_candidates(s.createDataFrame([(name, title)], "command string, title string"), name), Trigger(), command=name, given=True, own=True, limit=1, title=title))
    return out
