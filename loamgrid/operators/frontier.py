"""Crawl frontier: which links to visit next.  Fetching is not part of it."""
from __future__ import annotations

import re
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..functions.vocabulary import DENY_URL_PATTERNS


def disallow_pattern(rule: str) -> str:
    """A disallow rule as a pattern: everything literal but ``*``; like the original it may match anywhere."""
    return ".*".join(re.escape(part) for part in rule.split("*"))


def is_admitted(link: Column, deny: Sequence[str] = DENY_URL_PATTERNS, disallow: Sequence[str] = ()) -> Column:
    refused = F.lit(False)
    for pattern in deny:
        refused = refused | link.rlike(pattern)
    for rule in disallow:
        refused = refused | urls.path_and_query(link).rlike(disallow_pattern(rule))
    return ~refused


def admit_urls(links: DataFrame, hosts: DataFrame, link: str = "link", deny: Sequence[str] = DENY_URL_PATTERNS,
               disallow: Sequence[str] = ()) -> DataFrame:
    """Links on an allowed host that no deny or disallow rule hits."""
    return (links.where(F.col(link).isNotNull() & is_admitted(F.col(link), deny, disallow))
            .withColumn("host", urls.host(F.col(link))).join(hosts.select("host").distinct(), "host", "left_semi").drop("host"))


def link_priority(link: Column, parent_priority: Column) -> Column:
    """Profiles first, then admission and fee pages, then one below the parent."""
    def has(part: str) -> Column:
        return F.contains(link, F.lit(part))
    return (F.when(has("profile.php") | has("faculty/") | has("staff/"), F.lit(1))
            .when(has("admiss") | has("fee"), F.lit(2)).otherwise(parent_priority + 1))


def expand_frontier(links: DataFrame, queue: DataFrame) -> DataFrame:
    """New addresses to visit: ``url, depth, priority, visit_no``.

    ``links``: link, depth, priority of the parent page (already admitted).  An address found from several parents
    takes its best priority, then its least depth.  ``visit_no`` orders the whole batch; see ``next_to_visit``."""
    found = links.select(F.col("link").alias("url"), (F.col("depth") + 1).alias("depth"),
                         link_priority(F.col("link"), F.col("priority")).alias("priority"))
    best = found.groupBy("url").agg(F.min(F.struct("priority", "depth")).alias("_b"))
    return (best.join(queue.select("url").distinct(), "url", "left_anti")
            .select("url", F.col("_b.depth").alias("depth"), F.col("_b.priority").alias("priority")))


def next_to_visit(queue: DataFrame, n: int) -> DataFrame:
    """The ``n`` pending addresses of best priority, oldest first."""
    return (queue.where(F.col("status") == "pending").orderBy("priority", "created_at", "url").limit(n))


def next_per_host(queue: DataFrame, n: int) -> DataFrame:
    """At most ``n`` pending addresses per host, best first: a batch many workers can fetch side by side."""
    w = Window.partitionBy("host").orderBy("priority", "created_at", "url")
    return (queue.where(F.col("status") == "pending").withColumn("host", urls.host(F.col("url")))
            .withColumn("visit_no", F.row_number().over(w)).where(F.col("visit_no") <= n))


def last_seen(pages: DataFrame, entries: DataFrame) -> DataFrame:
    """When each page was last taken in; null if never."""
    seen = (entries.where(F.col("last_scraped_at").isNotNull()).groupBy(F.col("source_url").alias("url"))
            .agg(F.max("last_scraped_at").alias("last_scraped_at")))
    return pages.select("url").join(seen, "url", "left")


def error_category(message: Column) -> Column:
    m = F.coalesce(message, F.lit(""))
    return F.when(F.contains(m, F.lit("404")), "404").when(F.contains(m, F.lit("timeout")), "timeout").otherwise("other")


def matching_links(anchors: DataFrame, keyword: str) -> DataFrame:
    """Distinct links whose address or anchor text has the keyword, media files aside."""
    target = F.concat(F.lower("link"), F.lit(" "), F.lower("anchor_text"))
    return (anchors.where(F.col("link").isNotNull() & F.contains(target, F.lit(keyword.lower())) & ~urls.is_media_file(F.col("link")))
            .select("link").distinct())
