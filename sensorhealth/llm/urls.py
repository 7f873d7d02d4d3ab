"""URL filters: host and path rules, and trust spread over the host graph for all other hosts.

Rules name a host (with its subdomains) and a path prefix; the longest that fits decides. A host is a
trusted seed by the share of its pages that allow rules cover, and a blocked seed by the share that block
rules cover: both are masses, so a host may be either in part. Two personalised PageRanks run over the host edges in one job per step:
trust flows from the trusted seeds along links, distrust from the blocked seeds against them (who
links to a blocked host is suspect). A page without a rule is blocked if its host's distrust exceeds
``ratio`` times its trust (by more than rounding of sums), and allowed otherwise.

Host edges are absolute links (href, src, action), attribution lines naming another host, and links
between a host and its parent domain where both have pages; they are counted per pair of hosts
before anything else is shuffled, so a hot host is a few rows. Steps are joins and
sums over edges; a table is written every few steps. Everything is DataFrame operations.

Defined results: a null url or one without ``://`` has empty host and path and no rule, and is allowed;
null html has no links; repeated rows each get a verdict; mass of hosts without links is not handed on;
an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import discard, settle


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("org", "/", "allow"),
    UrlRule("example.org", "/es/", "block"),
    UrlRule("example.org", "/en/1", "block"),
    UrlRule("com", "/fr/", "allow"),
    UrlRule("com", "/de/", "block"),
)

#: Sums of the same masses in another order differ by less than this share of them.
ROUNDING = 1e-12

LINK = (
    r"(?:href|src|action)=[\"'](?:https?:)?//([^/?#\"'\s<>]+)"
    r"|&copy;\s*((?:[a-z0-9-]+\.)+[a-z]{2,24})"
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` and path after it; both empty where there is none."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(url)), r"^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """Text and verdict of the longest fitting rule as a struct, else null; the list is compiled in."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        own = F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, own).otherwise(out)
    return out


def parsed(pages: DataFrame, rules: tuple[UrlRule, ...]) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    ruled = split.withColumn("_r", rule_of(F.col("host"), F.col("path"), rules))
    return ruled.select("page_id", "host", "path", "_r.rule", F.col("_r.verdict").alias("ruled"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): pages of host ``src`` that name host ``dst``."""
    host, _ = host_and_path(F.col("url"))
    named = F.concat(*(F.regexp_extract_all("html", F.lit(LINK), F.lit(g)) for g in (1, 2)))
    rows = pages.select(host.alias("src"), F.array_distinct(named).alias("_named"))
    named_pairs = rows.select("src", F.explode("_named").alias("_dst")).select(
        "src", ascii_lower(F.col("_dst")).alias("dst")
    )
    own = pages.select(host.alias("src")).filter("src != ''").distinct()
    parent = F.regexp_extract("src", r"^[^.]*\.(.*)$", 1)
    kin = own.select("src", parent.alias("dst")).join(own.select(F.col("src").alias("dst")), "dst")
    pairs = named_pairs.unionAll(kin.select("src", "dst")).unionAll(
        kin.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    )
    return (
        pairs.filter("src != '' and dst != '' and src != dst")
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).cast("double").alias("weight"))
    )


def seeds(ruled: DataFrame) -> DataFrame:
    """(kind, host, mass): the shares of a host's pages that rules allow (trust) and block (distrust)."""
    by_host = (
        ruled.filter("host != ''")
        .groupBy("host")
        .agg(
            F.count(F.lit(1)).alias("_pages"),
            F.count(F.when(F.col("ruled") == "allow", 1)).alias("trust"),
            F.count(F.when(F.col("ruled") == "block", 1)).alias("distrust"),
        )
    )
    long = by_host.select(
        "host",
        F.explode(
            F.array(
                *(
                    F.struct(F.lit(k).alias("kind"), (F.col(k) / F.col("_pages")).alias("mass"))
                    for k in ("trust", "distrust")
                )
            )
        ).alias("_s"),
    ).select("_s.kind", "host", "_s.mass")
    return long.filter("mass > 0")


def spread(edges: DataFrame, starts: DataFrame, damping: float, steps: int, per_table: int = 5) -> DataFrame:
    """(kind, host, score) after ``steps`` steps of walks that restart at the seeds."""
    out = edges.groupBy(F.col("src").alias("_k")).agg(F.sum("weight").alias("_all"))
    into = edges.groupBy(F.col("dst").alias("_k")).agg(F.sum("weight").alias("_all"))
    share = F.col("weight") / F.col("_all")
    along = edges.join(out, edges["src"] == out["_k"]).select(
        F.lit("trust").alias("_kind"), F.col("src").alias("_from"), F.col("dst").alias("_to"), share.alias("_share")
    )
    against = edges.join(into, edges["dst"] == into["_k"]).select(
        F.lit("distrust").alias("_kind"), F.col("dst").alias("_from"), F.col("src").alias("_to"), share.alias("_share")
    )
    moves = settle(along.unionAll(against), "host_moves")
    restart = starts.select("kind", "host", (F.col("mass") * (1 - damping)).alias("score"))
    score, written = restart, None
    for step in range(1, steps + 1):
        moved = score.join(moves, (score["kind"] == moves["_kind"]) & (score["host"] == moves["_from"])).select(
            "kind", F.col("_to").alias("host"), (F.col("score") * F.col("_share") * damping).alias("score")
        )
        score = restart.unionAll(moved).groupBy("kind", "host").agg(F.sum("score").alias("score"))
        if step % per_table == 0 or step == steps:
            score = settle(score, "host_scores")
            if written is not None:
                discard(written)
            written = score
    discard(moves)
    return score


def host_verdicts(scores: DataFrame, ratio: float) -> DataFrame:
    """(host, trust, distrust, verdict) of the hosts that any mass reached."""
    of = lambda k: F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k)
    ahead = F.col("distrust") - F.col("trust") * ratio
    judged = F.when(ahead > ROUNDING * (F.col("distrust") + F.col("trust")), "block").otherwise("allow")
    return scores.groupBy("host").agg(of("trust"), of("distrust")).withColumn("verdict", judged)


def judge(
    pages: DataFrame,
    rules: tuple[UrlRule, ...] = RULES,
    damping: float = 0.85,
    steps: int = 15,
    ratio: float = 1.0,
) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    ruled = parsed(pages, rules)
    starts = settle(seeds(ruled), "host_seeds")
    edges = settle(host_edges(pages), "host_edges")
    hosts = host_verdicts(spread(edges, starts, damping, steps), ratio).select(
        F.col("host").alias("_host"), "trust", "distrust", F.col("verdict").alias("_verdict")
    )
    discard(edges)
    discard(starts)
    own = F.coalesce("ruled", "_verdict", F.lit("allow"))
    return ruled.join(hosts, ruled["host"] == hosts["_host"], "left").select(
        "page_id", "host", "path", "rule", own.alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def judge_sql(
    rules: tuple[UrlRule, ...] = RULES, damping: float = 0.85, steps: int = 15, ratio: float = 1.0
) -> str:
    """DuckDB SQL for ``judge`` over the table ``pages``, one pair of CTEs for each step."""
    by_length = sorted(rules, key=lambda r: (len(r.text), r.text), reverse=True)

    def case(pick) -> str:
        tests = (
            f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') "
            f"THEN '{pick(r)}'"
            for r in by_length
        )
        return "CASE " + " ".join(tests) + " END"

    link = LINK.replace("'", "''")
    named = " UNION ".join(
        f"SELECT page_id, src, unnest(regexp_extract_all(html, '{link}', {g})) AS dst FROM hosted" for g in (1, 2)
    )

    def step(i: int) -> str:
        return (
            f"s{i} AS (SELECT kind, host, sum(score) AS score FROM (SELECT * FROM restart UNION ALL "
            f"SELECT s.kind, m.dst, s.score * m.share * {damping} FROM s{i - 1} s JOIN moves m "
            f"ON s.kind = m.kind AND s.host = m.src) GROUP BY kind, host)"
        )

    steps_sql = reduce(lambda a, b: a + ",\n" + b, (step(i) for i in range(1, steps + 1)))
    return rf"""
WITH cut AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0
    THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
raw AS (SELECT *, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw_host FROM cut),
hosted AS (SELECT page_id, html, translate(raw_host, '{UPPER}', '{LOWER}') AS host,
    translate(raw_host, '{UPPER}', '{LOWER}') AS src,
    regexp_extract(substr(coalesce(rest, ''), length(raw_host) + 1), '^[^?#]*') AS path FROM raw),
ruled AS (SELECT page_id, host, path, {case(lambda r: r.text)} AS rule,
    {case(lambda r: r.verdict)} AS ruled FROM hosted),
named AS ({named}),
own AS (SELECT DISTINCT host FROM hosted WHERE host <> ''),
kin AS (SELECT a.host AS sub, b.host AS top FROM own a JOIN own b
    ON b.host = regexp_extract(a.host, '^[^.]*\.(.*)$', 1)),
pairs AS (SELECT src, translate(dst, '{UPPER}', '{LOWER}') AS dst FROM named
    UNION ALL SELECT sub, top FROM kin UNION ALL SELECT top, sub FROM kin),
edges AS (SELECT src, dst, count(*) AS w FROM pairs
    WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2),
moves AS (SELECT 'trust' AS kind, src, dst, w / sum(w) OVER (PARTITION BY src) AS share FROM edges
    UNION ALL SELECT 'distrust', dst, src, w / sum(w) OVER (PARTITION BY dst) FROM edges),
shares AS (SELECT host, count(*) AS n, count(*) FILTER (ruled = 'allow') / count(*) AS trust,
    count(*) FILTER (ruled = 'block') / count(*) AS distrust FROM ruled WHERE host <> '' GROUP BY host),
restart AS (SELECT 'trust' AS kind, host, trust * {1 - damping} AS score FROM shares WHERE trust > 0
    UNION ALL SELECT 'distrust', host, distrust * {1 - damping} FROM shares WHERE distrust > 0),
s0 AS (SELECT * FROM restart),
{steps_sql},
mass AS (SELECT host, sum(CASE WHEN kind = 'trust' THEN score ELSE 0 END) AS trust,
    sum(CASE WHEN kind = 'distrust' THEN score ELSE 0 END) AS distrust FROM s{steps} GROUP BY host),
judged AS (SELECT host, CASE WHEN distrust - trust * {ratio} > {ROUNDING} * (distrust + trust)
    THEN 'block' ELSE 'allow' END AS verdict FROM mass)
SELECT page_id, host, path, rule, coalesce(ruled, verdict, 'allow') AS verdict
FROM ruled LEFT JOIN judged USING (host)"""
