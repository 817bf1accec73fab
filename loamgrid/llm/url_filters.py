"""URL filters by rules and, where no rule speaks, by link-graph propagation.

Hosts are nodes; an edge stands for the links from one host's pages to another, and for a subdomain and the host above it, level by level.  Trust starts from
hosts whose pages the rules allow and flows along links (personalised PageRank); distrust starts from hosts whose pages the rules block and
flows against them: who links to a blocked host is suspect.  A host whose distrust outweighs its trust by a threshold is blocked, if what reaches it
from blocked pages is also enough of what would reach it from all pages."""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DAMPING, ROUNDS, THRESHOLD, LEAST = 0.85, 20, 0.5, 0.5
HREF = r"""(?i)\b(?:href|src)\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


class Rule(NamedTuple):
    verdict: str                     # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null and where there is no ``://``."""
    at = F.instr(url, "://")
    behind = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    host = F.translate(F.regexp_extract(behind, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(behind, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits (of equal length, the first given); null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(reversed(rules), key=lambda r: len(r.name)):
        fits = ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, weight`` between different hosts from ``pages (host, html)``: links counted, and 1 each way between a host and the one above it.

    The hosts above are taken at every level, with pages or without, so that subdomains meet in a host that has none."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("target"))
    links = links.select("src", F.translate(F.regexp_extract("target", r"//([^/?#]*)", 1), UPPER, LOWER).alias("dst"))
    links = links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    hosts = pages.select("host").distinct().select("host").union(links.select("dst")).distinct()
    levels = hosts.select(F.explode(F.expr("transform(sequence(2, greatest(2, size(split(host, '[.]')))), i -> substring_index(host, '.', -i))")).alias("host")).distinct()
    above = levels.select(F.col("host").alias("src"), F.regexp_extract("host", r"^[^.]+\.(.+\..+)$", 1).alias("dst")).where("dst <> ''")
    family = above.union(above.select("dst", "src")).distinct().withColumn("weight", F.lit(1.0))
    return links.union(family).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagated(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """``host, trust, distrust, reach``: personalised PageRank from ``seeds (host, trust, distrust, reach)``, trust along the edges, the others against them.

    What a host without outgoing edges holds goes back to the seeds' side (it is not passed on).  Both walks take one join a round; every round is written to the shared
    folder, so a lost executor costs one round."""
    ways = edges.select("src", "dst", "weight", F.lit(0).alias("way")).union(edges.select("dst", "src", "weight", F.lit(1)))
    out = ways.groupBy("src", "way").agg(F.sum("weight").alias("whole"))
    steps = cut_lineage(ways.join(out, ["src", "way"]).select("src", "dst", "way", (F.col("weight") / F.col("whole")).alias("part")))
    start = cut_lineage(seeds)
    score = start
    for _ in range(rounds):
        flow = steps.join(score.withColumnRenamed("host", "src"), "src").groupBy(F.col("dst").alias("host")).agg(
            F.sum(F.when(F.col("way") == 0, F.col("trust") * F.col("part")).otherwise(0.0)).alias("trust"),
            *[F.sum(F.when(F.col("way") == 1, F.col(c) * F.col("part")).otherwise(0.0)).alias(c) for c in ("distrust", "reach")])
        parts = flow.select("host", *[(F.col(c) * damping).alias(c) for c in ("trust", "distrust", "reach")]).union(
            start.select("host", *[(F.col(c) * (1 - damping)).alias(c) for c in ("trust", "distrust", "reach")]))
        score = cut_lineage(parts.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("trust", "distrust", "reach")]))
    return score


def judged(pages: DataFrame, rules: tuple[Rule, ...] = RULES, damping: float = DAMPING, rounds: int = ROUNDS, threshold: float = THRESHOLD,
           least: float = 0.0) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for every row of ``pages (page_id, url, html, ...)``.

    A page's verdict is that of the longest rule that fits its url, else that of its host: block if the host's distrust exceeds its trust by more than
    ``threshold`` times their sum and is more than ``least`` of what the host would have if all pages of all hosts were blocked (a share from 0 to 1: a host's own
    blocked pages count by their share, and so do those of hosts it links to).  Seeds weigh as the share of the host's pages that the rules allow or block, scaled to a sum of one on
    either side.  Hosts that neither side reaches, and pages without host, are allowed.  Null html has no link."""
    host, path = host_and_path(F.col("url"))
    named = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").select("page_id", host.alias("host"), path.alias("path"), "html")
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    ruled = named.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    shares = ruled.where("host <> ''").groupBy("host").agg(F.avg((F.coalesce("ruled", F.lit("")) == "allow").cast("double")).alias("trust"),
                                                           F.avg((F.coalesce("ruled", F.lit("")) == "block").cast("double")).alias("distrust"))
    sums = shares.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()
    seeds = shares.select("host", (F.col("trust") / (sums["t"] or 1.0)).alias("trust"), (F.col("distrust") / (sums["d"] or 1.0)).alias("distrust"),
                          F.lit(1.0 / (sums["d"] or 1.0)).alias("reach"))
    scores = propagated(host_edges(named.select("host", "html")), seeds, damping, rounds)
    blocked = (F.col("distrust") - F.col("trust") > threshold * (F.col("distrust") + F.col("trust"))) & (F.col("distrust") > least * F.col("reach"))
    return ruled.join(scores, "host", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(blocked, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
