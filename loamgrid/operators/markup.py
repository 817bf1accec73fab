"""Markup as a flat array of tokens, and ancestry as intervals over their positions.

Python only reads the markup: one pass, one token per element or text, with the position behind its last descendant.  An element holds what lies between its
position and its end, so removing, choosing and reading parts of a page are array functions on the row; nothing is shuffled and there is no tree."""
from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements without content, and what an opening tag closes on its way, up to which elements.
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr "
                           "main nav ol p pre section table ul".split())
PARAGRAPH_LIMITS = frozenset("td th table button".split())
ENDS_SIBLING = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
                "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"})}

ATTRIBUTES = ("id", "class", "role", "href", "property", "content")
TOKEN = T.StructType([T.StructField(n, T.IntegerType()) for n in ("at", "end", "depth")]
                     + [T.StructField(n, T.StringType()) for n in ("tag", *ATTRIBUTES, "text")])
PAGE = T.StructType([T.StructField("problem", T.StringType()), T.StructField("tokens", T.ArrayType(TOKEN))])
_STRINGS = ("tag", *ATTRIBUTES, "text")


class _Reader(HTMLParser):
    """Lists of the tokens' fields; ``open`` are the positions of elements not closed yet."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.fields: dict[str, list] = {n: [] for n in ("end", "depth", *_STRINGS)}
        self.open: list[int] = []
        self.open_tags: Counter[str] = Counter()

    def _add(self, tag: str | None, attributes: dict[str, str | None], text: str | None) -> int:
        at, f = len(self.fields["end"]), self.fields
        f["end"].append(at + 1), f["depth"].append(len(self.open)), f["tag"].append(tag), f["text"].append(text)
        for name in ATTRIBUTES:
            f[name].append(attributes.get(name, None if name not in attributes else ""))
        return at

    def _close(self, tags: set[str], limits: frozenset[str] | set[str] = frozenset()) -> None:
        if not any(self.open_tags[t] for t in tags):
            return
        for k in range(len(self.open) - 1, -1, -1):
            tag = self.fields["tag"][self.open[k]]
            if tag in limits:
                return
            if tag in tags:
                self._end(k)
                return

    def _end(self, k: int) -> None:
        for at in self.open[k:]:
            self.fields["end"][at] = len(self.fields["end"])
            self.open_tags[self.fields["tag"][at]] -= 1
        del self.open[k:]

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_PARAGRAPH:
            self._close({"p"}, PARAGRAPH_LIMITS)
        if tag in ENDS_SIBLING:
            self._close(*ENDS_SIBLING[tag])
        at = self._add(tag, {k: v or "" for k, v in attrs}, None)
        if tag not in VOID_TAGS:
            self.open.append(at)
            self.open_tags[tag] += 1

    def handle_endtag(self, tag):
        self._close({tag})

    def handle_data(self, data):
        self._add(None, {}, data)


LOT_PAGES = 64                  # pages whose tokens are Python objects at once


def _read_lot(sources: pa.Array) -> pa.Array:
    flat: dict[str, list] = {n: [] for n in ("at", "end", "depth", *_STRINGS)}
    bounds, problems = [0], []
    for source in sources.to_pylist():
        reader, problem = _Reader(), None
        try:
            reader.feed(source or "")
            reader.close()
            reader._end(0)
        except Exception as fault:                       # markup of strangers: whatever the reader trips over
            problem, reader = f"{type(fault).__name__}: {fault}", _Reader()
        for name, values in reader.fields.items():
            flat[name] += values
        flat["at"] += range(len(reader.fields["end"]))
        bounds.append(len(flat["at"]))
        problems.append(problem)
    kinds = {n: pa.int32() if n in ("at", "end", "depth") else pa.string() for n in flat}
    tokens = pa.StructArray.from_arrays([pa.array(flat[f.name], kinds[f.name]) for f in TOKEN], names=TOKEN.names)
    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), tokens)
    return pa.StructArray.from_arrays([pa.array(problems, pa.string()), lists], names=["problem", "tokens"])


@F.arrow_udf(PAGE)
def markup_tokens(html: pa.Array) -> pa.Array:
    """``problem, tokens`` of each page: ``at, end, depth, tag, id, class, role, href, property, content, text`` in document order.

    Elements have a tag and texts a text; ``end`` is the position behind the last token within.  A page that cannot be read has a ``problem`` and no tokens, and the
    others are not touched by it; a null page has none.  Of a batch, only ``LOT_PAGES`` pages are lists at once; the rest are Arrow columns."""
    return pa.concat_arrays([_read_lot(html[i:i + LOT_PAGES]) for i in range(0, max(len(html), 1), LOT_PAGES)])


def has_class(token: Column, *names: str) -> Column:
    return F.coalesce(token["class"].rlike(r"(^|\s)(" + "|".join(names) + r")(\s|$)"), F.lit(False))


def selected(token: Column, selector: str) -> Column:
    """Whether a token is what ``tag``, ``#id``, ``.class`` or ``role=value`` names."""
    if selector.startswith("."):
        return has_class(token, selector[1:])
    if selector.startswith("#"):
        return token["id"].eqNullSafe(selector[1:])
    if "=" in selector:
        name, value = selector.split("=", 1)
        return token[name].eqNullSafe(value)
    return token["tag"].eqNullSafe(selector)


def span(token: Column) -> Column:
    return F.struct(token["at"].alias("at"), token["end"].alias("end"))


def outermost(spans: Column) -> Column:
    """Those of the intervals, given in order, that lie in none before."""
    none = F.struct(F.lit(0).alias("limit"), F.array().cast("array<struct<at:int,end:int>>").alias("kept"))
    return F.aggregate(spans, none, lambda s, x: F.when(x["at"] < s["limit"], s).otherwise(
        F.struct(x["end"].alias("limit"), F.concat(s["kept"], F.array(x)).alias("kept"))), lambda s: s["kept"])


def without(tokens: Column, gone: Column) -> Column:
    """The tokens with null in place of those in the intervals ``gone`` (disjoint, in order), so that positions stay."""
    blank = F.lit(None).cast(TOKEN)

    def piece(i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get(gone, i - 1)["end"])
        stop = F.coalesce(F.get(gone, i)["at"], F.size(tokens))
        return F.concat(F.slice(tokens, begin + 1, stop - begin), F.array_repeat(blank, F.coalesce(F.get(gone, i)["end"] - stop, F.lit(0))))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), piece))


def within(tokens: Column, element: Column) -> Column:
    """The tokens between an element and its end."""
    return F.slice(tokens, element["at"] + 2, element["end"] - element["at"] - 1)


def text_of(tokens: Column, element: Column) -> Column:
    """Texts within an element put together, each run of white space as one blank."""
    joined = F.array_join(F.transform(within(tokens, element), lambda t: t["text"]), "")
    return F.trim(F.regexp_replace(joined, r"(?U)\s+", " "))


def first_text(tokens: Column, *selectors: str) -> Column:
    """Text of the first element that one of ``selectors`` names; empty if there is none."""
    def named(t: Column) -> Column:
        hit = F.lit(False)
        for selector in selectors:
            hit = hit | selected(t, selector)
        return hit
    return F.coalesce(text_of(tokens, F.get(F.filter(tokens, named), F.lit(0))), F.lit(""))
