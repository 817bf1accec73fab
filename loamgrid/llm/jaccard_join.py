"""N-gram Jaccard join by set relations.

Documents are sets of word shingles; two link when their Jaccard similarity reaches a threshold.  Sets are put in one order, rare shingles first, and a
set is listed under the first shingles only that two similar sets cannot both lack.  Relations between sets then save work:

* equal sets are one class, listed once and known by 64 bits of its digest;
* lists are ordered by position, and a block of entries too deep for the sizes at hand is skipped whole;
* a list first compares its least set with the others.  Sets found linked form components, and later only pairs from different components are looked at;
* a set that differs from such a set (its hub) in few shingles is known by these.  Two sets of one hub differ in just what one of their two differences has and
  the other lacks, so they are joined by their differences, however many sets a hub has.  What most sets of a hub have in common takes the hub's place, which leaves
  the differences that few sets share;
* the answers of a set of another hub are not computed anew either: they follow from its hub's by the differences.

Where links are counted, pairs within a component are looked at too.  Sets of one hub that link whatever their differences have in common are
counted by sums over their slacks; the others are counted in the lists, which return a number for each set, not the pairs.

Lists get no shingle that occurs once.  How often one occurs is counted over all documents for a fixed share of all hashes, and kept by levels in sieves of
fixed size; both decide on the order only, so the result is exact at any size."""
from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loamgrid.llm.shared import SIEVE_BITS, Scratch, arrow_map, components, lists, sieve_of
from loamgrid.llm.words import follow, joined, mix, signed, words_of
from loamgrid.session import cut_lineage

SHINGLE, SIMILAR, OUT_OF = 5, 8, 10
LEVELS = (2, 8, 64, 512)                 # a shingle's rank is the number of these that its count reaches
MIDDLE = 2                               # shingles that are not counted come behind this rank
LARGE, BLOCK = 256, 4096                 # entries of a component that is compared on its own; entries compared at once
BITS = SIEVE_BITS - 1                    # of the largest sieve; a fuller one spares less work and changes no result
PART, STRIP, ITEMS = 4096, 1024, 512     # sets of a list of differences that one task compares; sets and items at once


def _counted(similar: int, out_of: int) -> np.uint64:
    """Hashes below are counted: about twice as many of a set as it is listed under."""
    return np.uint64(min(2**64 - 1, 2**64 * 2 * (out_of - similar) // out_of))


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted hashes of each row's distinct shingles; fewer words than ``size`` count as one shingle."""
    for words in words_of(column, lower=True):
        made = joined(words.hashes, size)
        for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
            if b - a >= size:
                yield np.unique(made[a:b - size + 1])
            elif b > a:
                yield mix(joined(words.hashes[a:b], b - a)[:1] + np.uint64(b - a))
            else:
                yield np.empty(0, np.uint64)


def _digest(hashes: np.ndarray) -> tuple[int, int]:
    if not len(hashes):
        return 0, 0
    spread = mix(hashes + np.uint64(0x632BE59BD9B4E019))
    return int(signed(spread.sum(keepdims=True))[0]), int(signed(np.bitwise_xor.reduce(mix(spread), keepdims=True))[0])


def _profiles(docs: DataFrame, size: int, counted: np.uint64) -> DataFrame:
    """``doc_id, n, d1, d2, low``: size and digest of each set, and its counted hashes."""
    def scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ns, d1, d2, low = [], [], [], []
        for hashes in shingle_sets(batch.column("text"), size):
            one, two = _digest(hashes)
            ns.append(len(hashes)), d1.append(one), d2.append(two)
            low.append(signed(hashes[:np.searchsorted(hashes, counted)]))
        yield pa.record_batch([batch.column("doc_id"), pa.array(ns, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                               lists(low, pa.int64())], names=["doc_id", "n", "d1", "d2", "low"])
    return arrow_map(docs, scan, "doc_id long, n long, d1 long, d2 long, low array<long>")


def _entries(docs: DataFrame, often: DataFrame, classes: DataFrame, size: int, similar: int, out_of: int, bits: int, scratch: Scratch) -> DataFrame:
    """``token, id, n, at``: the list entries of one set of each class, of tokens that occur in more than one."""
    sieves = [sieve_of(often.where(F.col("n") >= n), "token", bits if n == LEVELS[0] else bits - 2) for n in LEVELS]
    held, counted = docs.sparkSession.sparkContext.broadcast(sieves), _counted(similar, out_of)

    def scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows, ids, ns, ats, tokens = [], [], [], [], []
        for i, hashes in enumerate(shingle_sets(batch.column("text"), size)):
            n = len(hashes)
            if not n:
                continue
            low = int(np.searchsorted(hashes, counted))
            shared = hashes[:low][held.value[0].holds(hashes[:low])]
            alone = low - len(shared)                            # these come first, and no other set has them
            length = n - (similar * n + out_of - 1) // out_of + 1
            if alone >= length:
                continue
            rank = 1 + sum(sieve.holds(shared).astype(np.int64) for sieve in held.value[1:])
            ranked = shared[np.argsort(rank, kind="stable")]
            rare = int((rank <= MIDDLE).sum())
            listed = np.concatenate((ranked[:rare], hashes[low:low + length], ranked[rare:]))[:length - alone]
            rows.append(i), ids.append(_digest(hashes)[0]), ns.append(n), tokens.append(signed(listed)), ats.append(np.arange(alone, alone + len(listed)))
        yield pa.record_batch([batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(ids, pa.int64()), pa.array(ns, pa.int64()),
                               lists(ats, pa.int64()), lists(tokens, pa.int64())], names=["doc_id", "id", "n", "at", "token"])

    of_class = classes.select(F.col("rep").alias("doc_id"), F.col("d1").alias("id"))
    listed = arrow_map(docs, scan, "doc_id long, id long, n long, at array<long>, token array<long>").join(of_class, ["doc_id", "id"], "left_semi")
    each = listed.select("id", "n", F.explode(F.arrays_zip("token", "at")).alias("e")).select("e.token", "id", "n", "e.at")
    each = scratch.cut(each)
    twice = each.groupBy("token").agg(F.count("*").alias("m")).where("m > 1").select("token")
    return scratch.cut(each.join(twice, "token"))


def _needed(nx: np.ndarray, ny: np.ndarray, similar: int, out_of: int) -> np.ndarray:
    return -(-similar * (nx + ny) // (similar + out_of))


def _fits(nx: np.ndarray, i: np.ndarray, ny: np.ndarray, j: np.ndarray, similar: int, out_of: int) -> np.ndarray:
    """Whether two sets can be similar whose first common token is at ``i`` and ``j``."""
    return np.minimum(nx - i, ny - j) >= _needed(nx, ny, similar, out_of)


def _runs(frame: DataFrame, columns: list[str], pairs, schema: str) -> DataFrame:
    """Applies ``pairs(columns of one token's entries)`` list by list; the entries are dealt by token and sorted by ``columns``."""
    ordered = frame.repartition("token").sortWithinPartitions(*columns).select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def table(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(np.concatenate([p[k] for p in found])) for k in (0, 1)], names=["a", "b"])

        def flush(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero(np.diff(parts[0])) + 1
            found, held = [], 0
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(parts[0])]):
                for pair in pairs(*[x[a:b] for x in parts]) if b - a > 1 else ():
                    found.append(pair)
                    held += len(pair[0])
                    if held > 1 << 18:
                        yield table(found)
                        found, held = [], 0
            if found:
                yield table(found)

        for batch in batches:
            now = [c.to_numpy() for c in batch.columns]
            parts = [np.concatenate(x) for x in zip(rest, now)] if rest is not None else now
            if not len(parts[0]):
                continue
            end = int(np.searchsorted(parts[0], parts[0][-1]))          # the last list may go on in the next batch
            rest = [x[end:] for x in parts]
            if end:
                yield from flush([x[:end] for x in parts])
        if rest is not None:
            yield from flush(rest)
    return ordered.mapInArrow(run, schema)


def _stars(entries: DataFrame, similar: int, out_of: int) -> DataFrame:
    """Pairs of each list's least set with its others."""
    def pairs(_: np.ndarray, ids: np.ndarray, ns: np.ndarray, ats: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        good = _fits(ns[0], ats[0], ns[1:], ats[1:], similar, out_of) & (ids[1:] != ids[0])
        if good.any():
            yield np.full(int(good.sum()), ids[0]), ids[1:][good]
    return _runs(entries, ["token", "id", "n", "at"], pairs, "a long, b long").distinct()


def _across(entries: DataFrame, similar: int, out_of: int) -> DataFrame:
    """Pairs of one list whose sets have different hubs and lie in different components.  A hub's entries are ordered by position, and those too deep are skipped."""
    def pairs(_: np.ndarray, groups: np.ndarray, ats: np.ndarray, ids: np.ndarray, ns: np.ndarray, parts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if groups[0] == groups[-1] or (parts == parts[0]).all():
            return
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(groups)) + 1, [len(groups)]))
        large = [np.arange(a, b) for a, b in zip(cuts[:-1], cuts[1:]) if b - a >= LARGE]
        small = np.repeat(np.diff(cuts) < LARGE, np.diff(cuts))
        before = np.flatnonzero(small)
        before = before[np.argsort(ats[before], kind="stable")]
        yield from compare(before, before, groups, ats, ids, ns, parts)
        for block in large:
            yield from compare(before, block, groups, ats, ids, ns, parts)
            before = np.concatenate((before, block))
            before = before[np.argsort(ats[before], kind="stable")]

    def compare(xs: np.ndarray, ys: np.ndarray, groups: np.ndarray, ats: np.ndarray, ids: np.ndarray, ns: np.ndarray,
                parts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of entries of ``xs`` and ``ys`` (each in order of position), block by block; behind a block too deep all are."""
        most = ns * (out_of - similar) // similar - ats
        for a in range(0, len(xs), LARGE):
            x = xs[a:a + LARGE]
            end = int(np.searchsorted(ats[ys], most[x].max(), "right"))
            for b in range(0, end, BLOCK):
                y = ys[b:min(b + BLOCK, end)]
                good = (groups[x][:, None] != groups[y]) & (parts[x][:, None] != parts[y]) & _fits(ns[x][:, None], ats[x][:, None], ns[y], ats[y], similar, out_of)
                i, j = np.nonzero(good)
                if len(i):
                    one, two = ids[x[i]], ids[y[j]]
                    keep = (one < two) if xs is ys else (one != two)
                    yield np.minimum(one, two)[keep], np.maximum(one, two)[keep]
    return _runs(entries, ["token", "group", "at", "id", "n", "component"], pairs, "a long, b long").distinct()


def _hubs(stars: DataFrame, scratch: Scratch) -> DataFrame:
    """``id, hub, n, n_hub, minus, plus``: the least near set of each set that has one, and what the set lacks of it and has besides.

    Where a hub has a hub itself its sets pass to that, their differences being put together, as long as they stay less than half of the set."""
    # A set that lists compare with two least sets tells how these two differ, so that the sets of one group come to one hub.
    least = stars.groupBy("b").agg(F.min("a").alias("low"))
    via = stars.join(least, "b").where("a <> low").groupBy("a").agg(F.min(F.struct("low", "b")).alias("via")).select("a", "via.low", "via.b")
    lower = stars.select(F.col("a").alias("low"), "b", F.col("na").alias("n_low"), F.col("minus").alias("low_minus"), F.col("plus").alias("low_plus"))
    told = via.join(stars, ["a", "b"]).join(lower, ["low", "b"]).select(
        F.col("low").alias("new_a"), F.col("a").alias("new_b"), F.col("n_low").alias("new_na"), F.col("na").alias("new_nb"),
        F.concat(F.array_except("low_minus", "minus"), F.array_except("plus", "low_plus")).alias("new_minus"),
        F.concat(F.array_except("low_plus", "plus"), F.array_except("minus", "low_minus")).alias("new_plus"))
    told = told.where("2 * (size(new_minus) + size(new_plus)) <= new_na + new_nb").select(*[F.col(f"new_{c}").alias(c) for c in ("a", "b", "na", "nb", "minus", "plus")])
    stars = scratch.cut(stars.select("a", "b", "na", "nb", "minus", "plus").union(told))
    first = stars.groupBy("b").agg(F.min("a").alias("a")).join(stars, ["a", "b"]).dropDuplicates(["b"])
    hubs = first.select(F.col("b").alias("id"), F.col("a").alias("hub"), F.col("nb").alias("n"), F.col("na").alias("n_hub"), "minus", "plus")
    for _ in range(4):
        hubs = scratch.cut(hubs)
        up = hubs.select(F.col("id").alias("hub"), F.col("hub").alias("up"), F.col("n_hub").alias("n_up"), F.col("minus").alias("up_minus"), F.col("plus").alias("up_plus"))
        # What a set lacks of the hub's hub: what the hub lacks of it, unless the set has it besides; and what the set lacks of the hub, unless the hub has it besides.
        minus = F.concat(F.array_except("up_minus", "plus"), F.array_except("minus", "up_plus"))
        plus = F.concat(F.array_except("plus", "up_minus"), F.array_except("up_plus", "minus"))
        joint = hubs.join(up, "hub", "left").withColumns({"m": minus, "p": plus})
        passes = F.coalesce(2 * (F.size("m") + F.size("p")) <= F.col("n") + F.col("n_up"), F.lit(False))
        hubs = joint.select("id", F.when(passes, F.col("up")).otherwise(F.col("hub")).alias("hub"), "n", F.when(passes, F.col("n_up")).otherwise(F.col("n_hub")).alias("n_hub"),
                            F.when(passes, F.col("m")).otherwise(F.col("minus")).alias("minus"), F.when(passes, F.col("p")).otherwise(F.col("plus")).alias("plus"))
    return scratch.cut(hubs)


def _enough(shared: Column, na: Column, nb: Column, similar: int, out_of: int) -> Column:
    return (similar + out_of) * shared >= similar * (na + nb)


def _slack(n: Column, d: Column, similar: int, out_of: int) -> Column:
    """How far a set may be from others, known by the size of its difference from what its group has in common.

    Two sets with differences of d1 and d2, k of them common, link when the sum of their slacks and 2 * k * (similar + out_of) is not negative."""
    return ((out_of - similar) * n - (similar + out_of) * d).cast("long")


def _apart(hubs: DataFrame, classes: DataFrame, similar: int, out_of: int, scratch: Scratch) -> DataFrame:
    """``id, hub, n, d, slack, n_rows, shared``: the sets of each hub (itself among them, unless it has another), known by what they do not have in common.

    What over half of a hub's sets have takes the hub's place, so that a set's ``d`` differences are what it alone or a minority has or lacks.  ``shared`` are those that other
    sets of the hub have as well, the rarest first, with the number of sets: those of one set alone come before them and make no list."""
    roots = hubs.select("hub", "n_hub").distinct().join(hubs.select(F.col("id").alias("hub")), "hub", "left_anti")
    members = scratch.cut(hubs.select("id", "hub", "n", F.concat("minus", "plus").alias("apart")).union(
        roots.select(F.col("hub").alias("id"), "hub", F.col("n_hub").alias("n"), F.array().cast("array<long>").alias("apart"))))
    sizes = members.groupBy("hub").agg(F.count("*").alias("m"))
    counts = scratch.cut(members.select("hub", F.explode("apart").alias("item")).groupBy("hub", "item").agg(F.count("*").alias("c")).where("c > 1").join(sizes, "hub"))
    flips = counts.where("2 * c > m").groupBy("hub").agg(F.collect_list("item").alias("flip"))      # at most twice the mean difference
    turned = F.concat(F.array_except("apart", "flip"), F.array_except("flip", "apart"))
    sets = scratch.cut(members.join(flips, "hub", "left").select("id", "hub", "n", F.when(F.col("flip").isNull(), F.col("apart")).otherwise(turned).alias("apart")))
    often = counts.select("hub", "item", F.when(F.expr("2 * c > m"), F.col("m") - F.col("c")).otherwise(F.col("c")).alias("c")).where("c > 1")
    shared = (sets.select("id", "hub", F.explode("apart").alias("item")).join(often, ["hub", "item"])
              .groupBy("id").agg(F.array_sort(F.collect_list(F.struct("c", "item"))).alias("shared")))
    rows = classes.select(F.col("d1").alias("id"), "n_rows")
    d = F.size("apart")
    return scratch.cut(sets.join(shared, "id", "left").join(rows, "id").select(
        "id", "hub", "n", d.alias("d"), _slack(F.col("n"), d, similar, out_of).alias("slack"), "n_rows", F.coalesce("shared", F.array().cast("array<struct<c:long,item:long>>")).alias("shared")))


def _told_links(sets: DataFrame) -> DataFrame:
    """``a, b``: links of sets of one hub that their slacks tell, as stars: who links with any links with the set of the greatest slack."""
    top = sets.groupBy("hub").agg(F.max(F.struct("slack", "id")).alias("top"))
    return (sets.join(top, "hub").where((F.col("slack") + F.col("top.slack") >= 0) & (F.col("id") != F.col("top.id")))
            .select(F.col("top.id").alias("a"), F.col("id").alias("b")))


def _told_counts(sets: DataFrame) -> DataFrame:
    """``id, n_others``: rows of the sets of one hub that each links with by their slacks, from sums over the different slacks of a hub."""
    cells = sets.groupBy("hub", "slack").agg(F.sum("n_rows").alias("n_rows"))
    line = cells.select("hub", F.col("slack").alias("v"), "n_rows", F.lit(None).cast("long").alias("asks")).union(
        cells.select("hub", -F.col("slack"), F.lit(0).cast("long"), F.col("slack")))
    upto = Window.partitionBy("hub").orderBy(F.desc("v"), F.col("asks").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    reached = line.withColumn("reached", F.sum("n_rows").over(upto)).where("asks is not null").select("hub", F.col("asks").alias("slack"), "reached")
    itself = F.when(F.col("slack") >= 0, F.col("n_rows")).otherwise(0)
    return sets.join(reached, ["hub", "slack"]).select("id", (F.col("reached") - itself).alias("n_others"))


def _within(sets: DataFrame, groups: DataFrame, similar: int, out_of: int, counted: bool) -> DataFrame:
    """``a, b, n``: what lists of shared differences say of sets of one hub whose slacks do not tell that they link.

    A set is listed under its differences as far as a similar set can first share one with it.  A task compares the entries of a list by their whole differences and takes a
    pair where its first common difference is.  It returns pairs (``n`` null) that join what it found linked, one fewer than sets at most, and, if ``counted``, for each set
    the rows of the sets it links with (``b`` null): rows out grow with the entries, however many pairs link.  Otherwise sets of one component are not compared.
    A long list is dealt out by pairs of parts of ``PART`` sets, so no task holds it whole."""
    tops = sets.groupBy("hub").agg(F.max("slack").alias("top"))
    # With what it shares at least with any set that it links with, a set's first common difference is not among its last.
    least = F.greatest(F.lit(1), F.ceil(-(F.col("slack") + F.col("top")) / F.lit(2.0 * (similar + out_of))))
    alone = F.col("d") - F.size("shared")
    listed = F.least(F.floor(F.col("n") * (out_of - similar) / F.lit(similar)) - alone, F.size("shared") - least) + 1
    ahead = (sets.join(tops, "hub").join(groups, "id", "left").select(
        "id", "hub", "n", "slack", "n_rows", F.coalesce("component", "id").alias("component"), alone.alias("alone"), F.transform("shared", lambda e: e["item"]).alias("items"),
        F.slice("shared", F.lit(1), F.greatest(listed, F.lit(0)).cast("int")).alias("front")).where(F.size("front") > 0))
    each = ahead.select("id", "hub", "n", "slack", "n_rows", "component", "alone", "items", F.posexplode("front").alias("k", "e"))
    parts = F.ceil(F.col("e.c") / F.lit(float(PART))).cast("int")
    cells = F.transform(F.sequence(F.lit(0), parts - 1), lambda q: F.struct(F.least("own", q).alias("low"), F.greatest("own", q).alias("high")))
    dealt = (each.withColumn("own", F.pmod(F.xxhash64("id"), parts).cast("int")).withColumn("cell", F.explode(cells))
             .select(F.xxhash64("hub", "e.item", "cell.low", "cell.high").alias("token"), (F.col("alone") + F.col("k")).cast("long").alias("at"), "id", "hub", "n", "slack", "n_rows",
                     "component", F.when(F.col("cell.low") == F.col("cell.high"), 2).when(F.col("own") == F.col("cell.low"), 0).otherwise(1).cast("long").alias("side"),
                     F.col("k").cast("long").alias("k"), "items"))
    names = ["token", "at", "id", "hub", "n", "slack", "n_rows", "component", "side", "k"]
    ordered = dealt.repartition("token").sortWithinPartitions("token", "at", "id")
    weight = 2 * (similar + out_of)

    def compare(columns: dict[str, np.ndarray], bounds: np.ndarray, items: np.ndarray) -> Iterator[tuple[list[int], list[int | None], list[int | None]]]:
        """One list: entries in order of position, with their shared differences."""
        size, at, side = len(bounds) - 1, columns["at"], columns["side"]
        if not counted and (columns["component"] == columns["component"][0]).all():
            return
        reach = columns["n"] * (out_of - similar) // similar - at
        sums, part = np.zeros(size, np.int64), list(range(size))

        def root(i: int) -> int:
            while part[i] != i:
                part[i] = part[part[i]]
                i = part[i]
            return i

        def spots_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Row, item and place within the row of all items of some entries, by item."""
            lengths = bounds[rows + 1] - bounds[rows]
            owner = np.repeat(np.arange(len(rows), dtype=np.int32), lengths)
            place = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            mine = items[place + np.repeat(bounds[rows], lengths)]
            order = np.argsort(mine, kind="stable")
            return owner[order], mine[order], (place < np.repeat(columns["k"][rows], lengths))[order]

        def together(xs: np.ndarray, ys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """How many items each two entries share, and how many of them stand ahead of the list's own in both; some items at a time."""
            shared, ahead = np.zeros((2, len(xs), len(ys)), np.float32)
            (ox, ix, fx), (oy, iy, fy) = spots_of(xs), spots_of(ys)
            known = np.intersect1d(ix, iy)
            for at_ in range(0, len(known), ITEMS):
                now = known[at_:at_ + ITEMS]
                sides = []
                for owner, mine, front, size_ in ((ox, ix, fx, len(xs)), (oy, iy, fy, len(ys))):
                    low, high = np.searchsorted(mine, now[0]), np.searchsorted(mine, now[-1], "right")
                    to = np.searchsorted(now, mine[low:high])
                    good = now[to] == mine[low:high]
                    both = np.zeros((2, size_, len(now)), np.float32)
                    both[0, owner[low:high][good], to[good]] = 1
                    both[1, owner[low:high][good], to[good]] = front[low:high][good]
                    sides.append(both)
                shared += sides[0][0] @ sides[1][0].T
                ahead += sides[0][1] @ sides[1][1].T
            return shared, ahead

        links: list[tuple[int, int]] = []
        for a in range(0, size, LARGE):
            xs = np.arange(a, min(a + LARGE, size))
            end = int(np.searchsorted(at, reach[xs].max(), "right"))
            for b in range(a, end, STRIP):
                ys = np.arange(b, min(b + STRIP, end))
                if not len(ys):
                    continue
                open_ = columns["slack"][xs][:, None] + columns["slack"][ys]
                wanted = ((xs[:, None] < ys) & (open_ < 0) & (at[xs][:, None] + at[ys] <= np.maximum(columns["n"][xs][:, None], columns["n"][ys]) * (out_of - similar) // similar)
                          & (columns["hub"][xs][:, None] == columns["hub"][ys]) & ((side[xs][:, None] != side[ys]) | (side[xs][:, None] == 2)))
                if not counted:
                    wanted &= columns["component"][xs][:, None] != columns["component"][ys]
                if not wanted.any():
                    continue
                shared, ahead = together(xs, ys)
                good = wanted & (open_ + weight * np.rint(shared).astype(np.int64) >= 0) & (ahead < 0.5)
                if not good.any():
                    continue
                sums[xs] += good @ columns["n_rows"][ys]
                sums[ys] += columns["n_rows"][xs] @ good
                rows, others = _same_part(good)
                ends = np.flatnonzero(others >= 0)
                for i, j in chain(zip((a + rows).tolist(), xs.tolist()), zip((a + others[ends]).tolist(), ys[ends].tolist())):
                    one, two = root(i), root(j)
                    if one != two:
                        part[max(one, two)] = min(one, two)
                        links.append((i, j))
        ids = columns["id"].tolist()
        if links:
            yield [ids[i] for i, _ in links], [ids[j] for _, j in links], [None] * len(links)
        if counted and sums.any():
            used = np.flatnonzero(sums).tolist()
            yield [ids[i] for i in used], [None] * len(used), sums[used].tolist()

    def lists_of(table: pa.RecordBatch, cuts: list[int]) -> Iterator[pa.RecordBatch]:
        column = table.column("items")
        offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
        whole = {c: table.column(c).to_numpy() for c in names}
        out: tuple[list, list, list] = ([], [], [])
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                for found in compare({c: x[a:b] for c, x in whole.items()}, offsets[a:b + 1] - offsets[a], values[offsets[a]:offsets[b]]):
                    for to, more in zip(out, found):
                        to += more
        yield pa.record_batch([pa.array(x, pa.int64()) for x in out], names=["a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            tokens = table.column("token").to_numpy()
            cuts = [0, *(np.flatnonzero(tokens[1:] != tokens[:-1]) + 1).tolist()]
            if len(cuts) > 1:
                yield from lists_of(table, cuts)
            rest = table.slice(cuts[-1])                             # the last list may go on in the next batch
        if rest is not None:
            yield from lists_of(rest, [0, rest.num_rows])
    return ordered.mapInArrow(run, "a long, b long, n long")


def _same_part(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row and each column of a matrix of links the least row that it is joined to by links; columns without a link have none (-1)."""
    rows, none = np.arange(len(linked)), len(linked)
    while True:
        columns = np.where(linked, rows[:, None], none).min(axis=0)
        lower = np.minimum(rows, np.where(linked, columns, none).min(axis=1))
        if (lower == rows).all():
            return rows, np.where(columns == none, -1, columns)
        rows = lower


def jaccard_components(docs: DataFrame, size: int = SHINGLE, similar: int = SIMILAR, out_of: int = OUT_OF, bits: int = BITS) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs (doc_id, text, ...)``.

    Words are runs of bytes other than white space, A-Z lower-cased; shingles are ``size`` words; fewer words are one shingle.  Documents link
    when ``out_of * shared >= similar * united``; a component is named by its least doc_id.  Null, empty and white texts have no shingle and stand alone.
    Rows that share a doc_id are one document as to links.  A row without doc_id links with nothing: its component_id is null."""
    return _joined(docs, size, similar, out_of, bits, False)


def jaccard_links(docs: DataFrame, size: int = SHINGLE, similar: int = SIMILAR, out_of: int = OUT_OF, bits: int = BITS) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links``: as ``jaccard_components``, with the number of other rows with a doc_id that each row links with.

    All links count, those within a component and those with equal sets too; rows that share a doc_id count each, by their own texts."""
    return _joined(docs, size, similar, out_of, bits, True)


def _joined(docs: DataFrame, size: int, similar: int, out_of: int, bits: int, counted: bool) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scratch = Scratch(docs.sparkSession)
    profiles = scratch.cut(_profiles(docs, size, _counted(similar, out_of)))
    often = scratch.cut(profiles.select(F.explode("low").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= LEVELS[0]))
    members = cut_lineage(profiles.select("doc_id", "n", "d1", "d2"))
    scratch.empty(profiles)
    named = members.where("n > 0 and doc_id is not null")
    classes = cut_lineage(named.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_rows")))
    entries = _entries(docs, often, classes, size, similar, out_of, bits, scratch)

    # Sets of all that are listed beside another, from the texts, which only sieves of their rows and classes have to sort out.
    listed = entries.select("id").distinct().join(classes.select(F.col("d1").alias("id"), F.xxhash64("rep").alias("key")), "id")
    held = docs.sparkSession.sparkContext.broadcast([sieve_of(listed, c, min(bits, 27)) for c in ("key", "id")])

    def scan(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        batch = batch.filter(pa.array(held.value[0].holds(batch.column("key").to_numpy())))
        parts = [signed(h) for h in shingle_sets(batch.column("text"), size)]
        ids = np.array([_digest(h.view(np.uint64))[0] for h in parts], np.int64)
        keep = np.flatnonzero(held.value[1].holds(ids))
        yield pa.record_batch([pa.array(ids[keep]), lists([parts[k] for k in keep], pa.int64())], names=["id", "items"])
    sets = scratch.cut(arrow_map(docs.where("doc_id is not null").withColumn("key", F.xxhash64("doc_id")), scan, "id long, items array<long>"))

    def side(name: str) -> DataFrame:
        return sets.select(F.col("id").alias(name), F.col("items").alias(f"items_{name}"))

    # Each list's least set against the others.
    stars = _stars(entries, similar, out_of).join(side("b"), "b").join(side("a"), "a").select(
        "a", "b", F.size("items_a").alias("na"), F.size("items_b").alias("nb"),
        F.array_except("items_a", "items_b").alias("minus"), F.array_except("items_b", "items_a").alias("plus"))
    enough = _enough(F.col("na") - F.size("minus"), F.col("na"), F.col("nb"), similar, out_of)
    stars = scratch.cut(stars.where(enough | F.expr("2 * (size(minus) + size(plus)) <= na + nb")))
    hubs = _hubs(stars, scratch)
    linked = stars.where(enough).select("a", "b").union(
        hubs.where(_enough(F.col("n_hub") - F.size("minus"), F.col("n_hub"), F.col("n"), similar, out_of)).select("hub", "id"))
    same_id = named.select("doc_id", F.col("d1").alias("b")).distinct()
    lowest = same_id.groupBy("doc_id").agg(F.min("b").alias("a"))
    links = scratch.cut(linked.union(same_id.join(lowest, "doc_id").where("b <> a").select("a", "b")).distinct())
    groups = scratch.cut(links.select(F.col("a").alias("id"), F.col("b").alias("component")).where("false") if counted else components(links))

    # Sets of one hub, by their differences.  Where links are counted each set is taken as a component of its own.
    alike = _apart(hubs, classes, similar, out_of, scratch)
    within = scratch.cut(_within(alike, groups, similar, out_of, counted))
    links = scratch.cut(links.union(_told_links(alike)).union(within.where("n is null").select("a", "b")).distinct())
    groups = groups if counted else scratch.cut(components(links))

    # Sets of different hubs and components: from the answers of the hub of one of them.
    apart = (entries.join(hubs.select("id", "hub"), "id", "left").join(groups, "id", "left")
             .select("token", F.coalesce("hub", "id").alias("group"), "at", "id", "n", F.coalesce("component", "id").alias("component")))
    pairs = _across(apart, similar, out_of)
    of_a = hubs.select(F.col("id").alias("a"), *(F.col(c).alias(f"{c}_a") for c in ("hub", "minus", "plus")))
    of_b = hubs.select(F.col("id").alias("b"), *(F.col(c).alias(f"{c}_b") for c in ("hub", "minus", "plus")))
    none = F.array().cast("array<long>")
    turn = F.col("hub_a").isNull() & F.col("hub_b").isNotNull()           # x is the one that has a hub, if any
    asked = pairs.join(of_a, "a", "left").join(of_b, "b", "left").select(
        F.when(turn, F.col("b")).otherwise(F.col("a")).alias("x"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("y"),
        F.when(turn, F.col("hub_b")).otherwise(F.coalesce("hub_a", "a")).alias("hub"),
        F.coalesce(F.when(turn, F.col("minus_b")).otherwise(F.col("minus_a")), none).alias("minus"),
        F.coalesce(F.when(turn, F.col("plus_b")).otherwise(F.col("plus_a")), none).alias("plus"))
    asked = scratch.cut(asked)
    answers = asked.select("hub", "y").distinct().join(side("hub"), "hub").join(side("y"), "y").select(
        "hub", "y", F.size("items_hub").alias("n_hub"), F.size("items_y").alias("n_y"), F.size(F.array_intersect("items_hub", "items_y")).alias("shared_hub"))
    n_x = F.col("n_hub") - F.size("minus") + F.size("plus")
    open_ = asked.join(answers, ["hub", "y"]).where(_enough(F.col("shared_hub") + F.size("plus"), n_x, F.col("n_y"), similar, out_of))
    shared = F.col("shared_hub") - F.size(F.array_intersect("minus", "items_y")) + F.size(F.array_intersect("plus", "items_y"))
    late = open_.join(side("y"), "y").where(_enough(shared, n_x, F.col("n_y"), similar, out_of)).select(F.col("x").alias("a"), F.col("y").alias("b"))
    late = scratch.cut(late.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    final = components(links.union(late))
    if counted:
        rows = classes.select(F.col("d1").alias("b"), "n_rows")
        others = cut_lineage(_told_counts(alike).union(within.where("n is not null").select(F.col("a").alias("id"), "n"))
                             .union(late.union(late.select("b", "a")).join(rows, "b").select(F.col("a").alias("id"), "n_rows"))
                             .groupBy("id").agg(F.sum("n_others").alias("n_others")))
    scratch.empty()

    ends = classes.select(F.col("d1").alias("id"), "rep").join(final, "id")
    names = ends.join(ends.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select(F.col("id").alias("d1"), "component_id")
    reps = classes.join(names, "d1", "left").withColumn("component_id", F.coalesce("component_id", "rep"))
    extra = []
    if counted:
        reps = reps.join(others.withColumnRenamed("id", "d1"), "d1", "left")
        extra = [F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("n_rows") - 1 + F.coalesce("n_others", F.lit(0))).otherwise(0).cast("long").alias("n_links")]
    return members.join(reps, ["n", "d1", "d2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"), *extra)


def first_of_each(docs: DataFrame, size: int = SHINGLE, similar: int = SIMILAR, out_of: int = OUT_OF) -> DataFrame:
    """The rows of ``docs`` whose document is the least of its component; rows without doc_id stay.

    Rows that repeat a doc_id stay together."""
    found = jaccard_components(docs, size, similar, out_of)
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
