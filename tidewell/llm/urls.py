"""URL filters: rules for hosts and paths, and trust and distrust spread over the host graph."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Rounds that the SQL writes out; enough where no walk over links is longer.
ROUNDS = 12
DAMPING = 0.85
#: A host is blocked if this share or more of the rank it has received is distrust.
DISTRUST = 0.5
#: Rounds between two cuts of the lineage, and between two tests whether the ranks have settled.
CUT_EVERY = 4
#: Ranks have settled if between two cuts no host is new and none changes by more than this share of its rank.
TOLERANCE = 1e-10
LINK = r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a host and the start of a path; it holds for the host and all its subdomains."""

    pattern: str
    verdict: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return self.pattern[len(self.host) :]


RULES = (Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow"))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, "://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does. Rules are a bounded list, held in the plan."""
    which, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        which, verdict = F.when(fits, rule.pattern).otherwise(which), F.when(fits, rule.verdict).otherwise(verdict)
    return which, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts by the addresses with a host, ://host or //host at the start, that pages link to."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("link"))
    link = F.when(F.col("link").startswith("//"), F.concat(F.lit(":"), "link")).otherwise(F.col("link"))
    found = links.where(F.instr(link, "://") > 0).select("src", host_of(link).alias("dst"))
    return found.where("src <> dst AND src <> '' AND dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, rounds: int | None = None) -> DataFrame:
    """(kind, host, rank): personalised PageRank of each kind of seed over its own edges.

    edges: kind, src, dst, w with the weights of a src summing to 1; seeds:
    kind, host, s with the seeds of a kind summing to 1. Rank that reaches a
    host without edges stays there. A round is a join and an aggregation.
    ``rounds`` of them, or, if that is None, as many as it takes until every
    host within reach has a rank and each has settled to TOLERANCE of its own
    size. Change after that is at most TOLERANCE times the mean length of the
    walks that lead to a host. Ranks under the least double count as 0.
    """
    rank = settled = seeds.select("kind", "host", F.col("s").alias("rank"))
    k = 0
    while rounds is None or k < rounds:
        sent = rank.join(edges, (rank["kind"] == edges["kind"]) & (rank["host"] == edges["src"])).select(
            rank["kind"], F.col("dst").alias("host"), (F.col("rank") * F.col("w") * F.lit(DAMPING)).alias("r")
        )
        own = seeds.select("kind", "host", (F.col("s") * F.lit(1 - DAMPING)).alias("r"))
        rank = sent.unionAll(own).groupBy("kind", "host").agg(F.sum("r").alias("rank"))
        k += 1
        if k % CUT_EVERY == 0:
            rank = cut(rank)
            if rounds is None:
                # Hosts that have a rank keep one, so a host without a former rank is new.
                former = settled.withColumnRenamed("rank", "was")
                moves = F.col("was").isNull() | (F.abs(F.col("rank") - F.col("was")) > F.col("rank") * F.lit(TOLERANCE))
                if rank.join(former, ["kind", "host"], "left").where(moves).isEmpty():
                    break
                settled = rank
    return rank


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, rounds: int | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and distrust for each row of ``pages`` (page_id, url, html).

    The host runs from the first :// to the next /, ? or #, with A-Z
    lower-cased; the path from there to ? or #; both are empty if the url is
    null or has no ://. The longest rule that fits decides. Where none fits the
    host graph does: trust starts from hosts whose pages rules allow and
    follows links, distrust starts from hosts whose pages rules block and
    follows links backwards. distrust is a host's share of distrust in what it
    has received of both (0 if nothing); DISTRUST or more blocks it. Ranks are
    spread until they settle, however far the seeds are, or ``rounds`` times.

    Null html has no links. Repeated rows are judged each; they count again as
    seeds and links. One row per input row; other columns are ignored; empty
    tables give none.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    which, verdict = rule_of(F.col("host"), F.col("path"), rules)
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("rule", which).withColumn("said", verdict)
    counts = cut(
        judged.where("said IS NOT NULL AND host <> ''")
        .groupBy(F.when(F.col("said") == "allow", "trust").otherwise("distrust").alias("kind"), "host")
        .agg(F.count("*").alias("n"))
    )
    sums = counts.groupBy("kind").agg(F.sum("n").alias("all"))
    seeds = cut(counts.join(sums, "kind").select("kind", "host", (F.col("n") / F.col("all")).alias("s")))
    links = cut(host_edges(pages))
    both = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionAll(
        links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    )
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    edges = cut(both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("all")).alias("w")))
    rank = spread(edges, seeds, rounds)
    share = (
        rank.groupBy("host")
        .agg(
            F.sum(F.when(F.col("kind") == "distrust", F.col("rank")).otherwise(0.0)).alias("bad"),
            F.sum("rank").alias("all"),
            F.every(F.col("kind") == "distrust").alias("only_bad"),
        )
        # A host that only distrust reaches has all of it, however small its rank.
        .select("host", F.when(F.col("only_bad"), 1.0).otherwise(F.round(F.try_divide("bad", "all"), 9)).alias("distrust"))
    )
    met = judged.join(cut(share), "host", "left").withColumn("distrust", F.coalesce("distrust", F.lit(0.0)))
    by_graph = F.when(F.col("distrust") >= DISTRUST, "block").otherwise("allow")
    return met.select("page_id", "host", "path", "rule", F.coalesce("said", by_graph).alias("verdict"), "distrust")


def judge_sql(rules: tuple[Rule, ...] = RULES, rounds: int = ROUNDS) -> str:
    """The same as DuckDB SQL over ``pages``, with the rounds written out and without links that start with //."""
    cases = {"rule": "NULL", "said": "NULL"}
    for rule in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):
        fits = f"(host = '{rule.host}' OR ends_with(host, '.{rule.host}')) AND starts_with(path, '{rule.path}')"
        cases = {"rule": f"CASE WHEN {fits} THEN '{rule.pattern}' ELSE {cases['rule']} END", "said": f"CASE WHEN {fits} THEN '{rule.verdict}' ELSE {cases['said']} END"}
    host = "translate(regexp_extract(coalesce({}, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    step = lambda q, k: q + f""", r{k + 1} AS (
  SELECT kind, host, sum(r) AS rank FROM (
    SELECT e.kind, e.dst AS host, r.rank * e.w * {DAMPING} AS r FROM r{k} r JOIN edges e ON r.kind = e.kind AND r.host = e.src
    UNION ALL SELECT kind, host, s * {1 - DAMPING} AS r FROM seeds) GROUP BY kind, host)"""  # noqa: E731
    ranks = reduce(step, range(rounds), ", r0 AS (SELECT kind, host, s AS rank FROM seeds)")
    return f"""
WITH parsed AS (
  SELECT page_id, html, {host.format('url')} AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages
), judged AS (
  SELECT page_id, html, host, path, {cases['rule']} AS rule, {cases['said']} AS said FROM parsed
), counts AS (
  SELECT CASE said WHEN 'allow' THEN 'trust' ELSE 'distrust' END AS kind, host, count(*) AS n FROM judged
  WHERE said IS NOT NULL AND host <> '' GROUP BY 1, 2
), seeds AS (
  SELECT kind, host, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY kind) AS s FROM counts
), links AS (
  SELECT src, dst, count(*) AS n FROM (
    SELECT host AS src, {host.format('link')} AS dst
    FROM (SELECT host, unnest(regexp_extract_all(html, '(?i)\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1)) AS link FROM judged) WHERE contains(link, '://'))
  WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY 1, 2
), edges AS (
  SELECT 'trust' AS kind, src, dst, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY src) AS w FROM links
  UNION ALL
  SELECT 'distrust', dst, src, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY dst) FROM links
){ranks}, share AS (
  SELECT host, round(sum(CASE kind WHEN 'distrust' THEN rank ELSE 0 END) / sum(rank), 9) AS distrust FROM r{rounds} GROUP BY host
)
SELECT page_id, j.host, path, rule, coalesce(said, CASE WHEN coalesce(distrust, 0) >= {DISTRUST} THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(distrust, 0.0) AS distrust
FROM judged j LEFT JOIN share s ON j.host = s.host
"""
