"""Column functions over URLs."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vocabulary import MEDIA_FILE_PATTERN, TRACKING_PARAMETERS

_ABSOLUTE = r"^(?i)(https?)://([^/?#]+)([^?#]*)(\?[^#]*)?"


def host(url: Column) -> Column:
    """Lower-case host with port; empty for anything that is not an absolute http(s) URL."""
    return F.lower(F.regexp_extract(url, _ABSOLUTE, 2))


def path_and_query(url: Column) -> Column:
    return F.concat(F.regexp_extract(url, _ABSOLUTE, 3), F.regexp_extract(url, _ABSOLUTE, 4))


def unescape(href: Column) -> Column:
    """Reads the character references that addresses are written with; the ampersand last."""
    for name, sign in (("&quot;|&#34;", '"'), ("&#39;|&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;|&#38;|&#x26;", "&")):
        href = F.regexp_replace(href, name, sign)
    return href


def without_dots(url: Column) -> Column:
    """An absolute URL whose path has no ``.`` and ``..`` segments; others as they are."""
    def step(done: Column, part: Column) -> Column:
        return (F.when(part == ".", done).when(part == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1))))
                .otherwise(F.concat(done, F.array(part))))
    path = F.regexp_extract(url, _ABSOLUTE, 3)
    parts = F.split(path, "/")
    short = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array(F.lit("")), step)
    short = F.when(path.rlike(r"/\.\.?$"), F.concat(short, F.array(F.lit("")))).otherwise(short)
    whole = F.concat(F.regexp_extract(url, r"^(?i)(https?://[^/?#]+)", 1), F.array_join(short, "/"), F.regexp_extract(url, r"^[^?#]*(.*)$", 1))
    return F.when(path.rlike(r"/\.\.?(/|$)"), whole).otherwise(url)


def resolve(href: Column, base: Column) -> Column:
    """Absolute form of a link found on ``base``: absolute, scheme-relative, rooted, query-only or relative to
    the folder of the page.  Other schemes (mail, script, telephone) give null."""
    scheme = F.lower(F.regexp_extract(base, _ABSOLUTE, 1))
    root = F.concat(scheme, F.lit("://"), F.regexp_extract(base, _ABSOLUTE, 2))
    page = F.concat(root, F.regexp_extract(base, _ABSOLUTE, 3))
    folder = F.concat(root, F.regexp_extract(F.concat(F.regexp_extract(base, _ABSOLUTE, 3)), r"^(.*/)", 1))
    folder = F.when(folder == root, F.concat(root, F.lit("/"))).otherwise(folder)
    link = F.trim(href)
    return without_dots(F.when(link.isNull() | (scheme == ""), F.lit(None).cast("string"))
            .when(link.rlike(r"^(?i)https?://"), link)
            .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None).cast("string"))
            .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
            .when(link.startswith("/"), F.concat(root, link))
            .when((link == "") | link.startswith("#"), page)
            .when(link.startswith("?"), F.concat(page, link))
            .otherwise(F.concat(folder, link)))


def normalise(url: Column, drop: tuple[str, ...] = TRACKING_PARAMETERS) -> Column:
    """Canonical URL: no fragment, no tracking parameter, no trailing slash below the root, lower-case host."""
    scheme = F.lower(F.regexp_extract(url, _ABSOLUTE, 1))
    path = F.regexp_extract(url, _ABSOLUTE, 3)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    path = F.when((F.length(path) > 1) & path.endswith("/"), F.left(path, F.length(path) - 1)).otherwise(path)
    query = F.substring(F.regexp_extract(url, _ABSOLUTE, 4), F.lit(2), F.length(url))
    tracked = r"^(" + "|".join(drop) + r")(=|$)"
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(tracked)), "&")
    return F.when(scheme == "", F.lit(None).cast("string")).otherwise(
        F.concat(scheme, F.lit("://"), host(url), path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept))))


def is_media_file(url: Column) -> Column:
    return url.rlike(MEDIA_FILE_PATTERN)
