"""URL filters: host-suffix and path-prefix expressions matched by short hash prefixes.

A rule is (host, path, action) and fits the host and its subdomains where the URL's path starts
with the rule's. A URL is expanded into one expression for each shape of the rules (labels in the host,
characters in the path) that it is long enough for. One equi-join meets the expressions with the
rules on the first ``PREFIX`` hex digits of their digests, the full digest confirms the match, and among
the confirmed rules the longest wins. The plan is the same for five rules and for a million.

Matches are summed up for each host and path, which decide the verdict, and joined back on these: one
shuffle of the matches and at most one of the rows. Where one URL is a large share of the rows, AQE splits it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.llm._common import fresh

PREFIX = 8
#: Rules up to which their table is broadcast.
BROADCAST_RULES = 50_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The rules of the registered query.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(F.translate(raw, _UPPER, _LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def _unique(rules) -> list[tuple[str, str, str]]:
    """Rules with hosts in lower case. Of equal rules with two actions, block stays."""
    actions: dict[tuple[str, str], str] = {}
    for host, path, action in rules:
        key = (host.translate(str.maketrans(_UPPER, _LOWER)), path)
        actions[key] = "block" if "block" in (action, actions.get(key)) else action
    return sorted((host, path, action) for (host, path), action in actions.items())


def _expressions(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The digests of a URL's expressions, one for each shape it is long enough for."""
    listed = F.transform(F.split(F.lit(",".join(f"{labels}:{length}" for labels, length in shapes)), ","), lambda x: F.split(x, ":").cast("array<int>"))
    labels, size = F.size(F.split(host, "\\.")), F.length(path)
    fits = F.filter(listed, lambda s: (host != "") & (s[0] <= labels) & (s[1] <= size))
    return F.transform(fits, lambda s: F.sha2(F.concat(F.call_function("substring_index", host, F.lit("."), -s[0]), F.lit("\n"), F.substring(path, F.lit(1), s[1])), 256))


def url_verdicts(pages: DataFrame, rules=RULES, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Append ``host, path, rule, verdict`` to every row; columns of those names are replaced.

    ``rule`` is the winning rule as host and path joined, null where none fits, and then the
    verdict is ``default``: an unlisted URL passes. Null urls and urls without ``://`` have an empty
    host, which no rule fits. Between fitting rules of equal length the longer host wins. Repeated
    rows are judged alike, each on its own.
    """
    spark = pages.sparkSession
    kept = pages.drop("host", "path", "rule", "verdict")
    host, path = host_and_path(F.col(url_col))
    given = pages.select(*kept.columns, host.alias("host"), path.alias("path"))
    own = _unique(rules)
    if not own:
        return given.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    table = spark.createDataFrame(own, "rule_host string, rule_path string, action string")
    table = table.select(
        F.sha2(F.concat("rule_host", F.lit("\n"), "rule_path"), 256).alias("full"),
        F.struct(F.length(F.concat("rule_host", "rule_path")).alias("size"), F.length("rule_host").alias("host_size"), F.concat("rule_host", "rule_path").alias("rule"), "action").alias("found"),
    )
    table = table.withColumn("key", F.substring("full", 1, PREFIX))
    shapes = sorted({(h.count(".") + 1, len(p)) for h, p, _ in own})
    asked = given.select("host", "path", F.explode(_expressions(F.col("host"), F.col("path"), shapes)).alias("digest"))
    asked = asked.withColumn("key", F.substring("digest", 1, PREFIX))
    met = asked.join(F.broadcast(table) if len(own) <= BROADCAST_RULES else table, "key").filter(F.col("digest") == F.col("full"))
    at_host, at_path, best = fresh(given.columns, "rule_host", "rule_path", "best")
    won = met.groupBy(F.col("host").alias(at_host), F.col("path").alias(at_path)).agg(F.max("found").alias(best))
    out = given.join(won, (F.col("host") == F.col(at_host)) & (F.col("path") == F.col(at_path)), "left")
    return out.select(*given.columns, F.col(f"{best}.rule").alias("rule"), F.coalesce(F.col(f"{best}.action"), F.lit(default)).alias("verdict"))


def verdict_sql() -> str:
    """The registered query's verdicts in DuckDB's SQL."""
    rules = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[0], r[1]))

    def fits(host: str, path: str) -> str:
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"

    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in rules)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{a}'" for h, p, a in rules)
    return f"""
        WITH cut AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), split AS (
            SELECT page_id, rest, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw FROM cut
        ), named AS (
            SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host,
                   coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path
            FROM split
        )
        SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE 'allow' END AS verdict FROM named
    """
