"""Exact and near duplicates.

Groups of copies are never gathered: they are summarised by partial aggregation, and their members stay rows."""
from __future__ import annotations

from functools import lru_cache, reduce
from typing import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut_lineage, fits_broadcast, shuffles_emptied, spread
from .ordered import number_rows, ordered_fold


def keep_first(df: DataFrame, keys: Sequence[Column], order: Sequence[str], id_col: str = "id") -> DataFrame:
    """One row per key, the least by ``order`` then id.  Only keys and ids are aggregated; the rows themselves
    move once, in the semi join on the unique id."""
    named = [k.alias(f"_k{i}") for i, k in enumerate(keys)]
    first = (df.select(*named, F.struct(*[F.col(c) for c in dict.fromkeys([*order, id_col])]).alias("_o"))
             .groupBy(*[f"_k{i}" for i in range(len(keys))]).agg(F.min("_o").alias("_o"))
             .select(F.col(f"_o.{id_col}").alias(id_col)))
    return df.join(first, id_col, "left_semi")


def drop_near_duplicate_pages(pages: DataFrame, content: str = "content", order: Sequence[str] = (),
                              id_col: str = "page_id", prefix: int | None = None) -> DataFrame:
    """First page in crawl order of each fingerprint."""
    return keep_first(pages, [tx.fingerprint(F.col(content), prefix)], order, id_col)


def duplicate_content(df: DataFrame) -> DataFrame:
    """Groups of entries with one content hash: size, number of sources, oldest entry, its text."""
    groups = (df.where(F.col("content_hash").isNotNull()).groupBy("content_hash")
              .agg(F.count("*").alias("occurrence_count"), F.countDistinct("source_url").alias("source_count"),
                   F.min("created_at").alias("first_seen"),
                   F.min(F.struct("created_at", "id")).alias("_first"))
              .where(F.col("occurrence_count") > 1).withColumn("first_id", F.col("_first.id")).drop("_first"))
    return groups.join(df.select(F.col("id").alias("first_id"), F.col("content").alias("content_preview")), "first_id")


def group_members(df: DataFrame, keys: Sequence[str], extra: Sequence[str] = ("source_url",)) -> DataFrame:
    """Members of every group with more than one entry, numbered from the oldest: the ordered id list of each
    group, as rows.  A huge group is spread over many tasks (see ``ordered``), whenever its members were loaded."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).drop("_n")
    members = df.select(*keys, "id", "created_at", *[c for c in extra if c not in keys]).join(sizes, list(keys), "left_semi")
    return number_rows(members, keys, ["created_at", "id"], "member_no")


def group_sources(df: DataFrame, keys: Sequence[str], value: str = "source_url") -> DataFrame:
    """Distinct ``value`` of every group with more than one entry, as rows."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > 1).drop("_n")
    return df.select(*keys, value).distinct().join(sizes, list(keys), "left_semi")


def duplicate_urls(df: DataFrame) -> DataFrame:
    """Sources with more entries than their chunk count plus one allows."""
    return (df.where(F.col("source_url").isNotNull() & (F.col("source_url") != "")).groupBy("source_url")
            .agg(F.count("*").alias("entry_count"), F.countDistinct("content_hash").alias("unique_hashes"),
                 F.min("created_at").alias("first_seen"), F.max("updated_at").alias("last_updated"),
                 F.min("total_chunks").alias("_allowed"))
            .where(F.col("entry_count") > F.coalesce("_allowed", F.lit(0)) + 1).drop("_allowed"))


def similar_entries(df: DataFrame) -> DataFrame:
    return (df.groupBy("title", "category").agg(F.count("*").alias("n"), F.countDistinct("source_url").alias("source_count"),
                                               F.min(F.struct("created_at", "id")).alias("_first"))
            .where(F.col("n") > 1).select("title", "category", "n", "source_count", F.col("_first.id").alias("first_id")))


def duplicate_pages(df: DataFrame, url: str = "url", id_col: str = "id") -> DataFrame:
    return (df.groupBy(url).agg(F.count("*").alias("n"), F.min(id_col).alias("first_id")).where(F.col("n") > 1))


def duplicate_summary(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """Number of groups of each kind, and surplus entries over all content groups."""
    content = (entries.where(F.col("content_hash").isNotNull()).groupBy("content_hash").agg(F.count("*").alias("n"))
               .where(F.col("n") > 1))
    totals = content.agg(F.count("*").alias("duplicate_content_groups"),
                         F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("total_duplicate_entries"))
    return totals.select(
        duplicate_urls(entries).agg(F.count("*")).scalar().alias("duplicate_url_groups"),
        "duplicate_content_groups",
        duplicate_pages(pages).agg(F.count("*")).scalar().alias("duplicate_page_groups"),
        entries.groupBy("title", "category").agg(F.count("*").alias("n")).where(F.col("n") > 1)
        .agg(F.count("*")).scalar().alias("similar_entry_groups"),
        "total_duplicate_entries")


def remove_duplicates(df: DataFrame) -> DataFrame:
    """Keep the oldest entry of each content hash; entries without a hash all stay."""
    key = F.coalesce(F.col("content_hash"), F.concat(F.lit("id:"), F.col("id")))
    return keep_first(df, [key], ["created_at"])


# ---- ranked lists ---------------------------------------------------------------------------------------------

SLOTS = 8192


def _grams(text: str | None, k: int, prefix: int | None) -> tuple[np.ndarray, frozenset]:
    """Distinct character k-grams.  A gram of letters below U+1000 is packed into one integer, 12 bits a letter, which
    is as exact as the string; other grams stay strings."""
    low = (text or "")[:prefix].lower()
    n = len(low) - k + 1
    if n < 1 or k > 5:
        return np.empty(0, dtype=np.int64), frozenset(low[i:i + k] for i in range(n))
    points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    codes, packed = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    for i in range(k):
        letters = points[i:i + n]
        codes = (codes << 12) | (letters & 4095)
        packed &= letters < 4096
    return np.unique(codes[packed]), frozenset(low[i:i + k] for i in np.nonzero(~packed)[0])


def _size(grams: tuple) -> int:
    return len(grams[0]) + len(grams[1])


def _exceeds(common: int, a: int, b: int, threshold: float) -> bool:
    return common > threshold * (a + b - common)


def _similar(a: tuple, b: tuple, threshold: float) -> bool:
    na, nb = _size(a), _size(b)
    if na == 0 and nb == 0:
        return True
    if not _exceeds(min(na, nb), na, nb, threshold):
        return False
    common = len(np.intersect1d(a[0], b[0], assume_unique=True)) + len(a[1] & b[1])
    return _exceeds(common, na, nb, threshold)


def _slots(grams: tuple) -> np.ndarray:
    """How many grams fall into each of a fixed number of slots."""
    mixed = (grams[0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(51)
    counts = np.bincount(mixed.astype(np.int64), minlength=SLOTS)
    for g in grams[1]:
        counts[hash(g) % SLOTS] += 1
    return counts.astype(np.int32)


def dedupe_ranked(df: DataFrame, key: str = "query_id", rank: str = "rank", text: str = "content",
                  threshold: float = 0.70, k: int = 5, prefix: int | None = None) -> DataFrame:
    """Walk each ranked list from the top and drop a row too similar to any row kept before it.

    The sum of the lesser slot counts bounds what two texts can share, so most pairs need no exact comparison."""
    def step(kept: list, row: dict) -> tuple:
        mine = _grams(row[text], k, prefix)
        n, slots = _size(mine), _slots(mine)
        for other, m, theirs in kept:
            if (n == 0 and m == 0) or (_exceeds(int(np.minimum(slots, theirs).sum()), n, m, threshold)
                                       and _similar(mine, other, threshold)):
                return (False,)
        kept.append((mine, n, slots))
        return (True,)
    return ordered_fold(df, [key], [rank], list, step, "_kept boolean").where("_kept").drop("_kept")


# ---- whole corpus ---------------------------------------------------------------------------------------------

BANDS, ROWS_PER_BAND = 110, 6   # a pair at 0.70 shares no band with probability (1 - 0.7^6)^110, about 1e-6
SKETCH_DEVIATIONS = 6.5         # so far under its similarity, in standard deviations, a pair's sketches agree with a probability of about 1e-9
WIDER = 8                       # how many times as many heads a band has in each further round
LOT_CELLS = 1 << 16             # cells of 4 bytes that the permutations of a text fill at once
LOT_ROWS = 1 << 24              # rows of bands that are dealt out at once; where there are more, bands are taken in lots
MOST_SENT = 1 << 20             # ids or bands that every task may get; more are matched by a shuffle


def _band_hashes(bands: int, rows: int, k: int, prefix: int | None):
    n = bands * rows
    rng = np.random.default_rng(20240131)
    mult = rng.integers(0, 2 ** 32, (n, 1), dtype=np.uint32) | np.uint32(1)
    add = rng.integers(0, 2 ** 32, (n, 1), dtype=np.uint32)

    def one(text: str) -> tuple[int, np.ndarray, np.ndarray]:
        points = np.frombuffer((text or "")[:prefix].lower().encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        count = len(points) - k + 1
        if count < 1:
            return 0, np.zeros(n, dtype=np.uint8), np.zeros(bands, dtype=np.int64)
        grams = np.zeros(count, dtype=np.uint64)
        for i in range(k):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + points[i:i + count]
        grams = (grams ^ (grams >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        # Grams are mixed once, to 32 bits; a permutation of them is then one multiplication and one addition, in lots that stay in a core's cache.
        mixed = np.unique((grams >> np.uint64(32)).astype(np.uint32))
        lot = max(1, min(n, LOT_CELLS // len(mixed)))
        cells = np.empty((lot, len(mixed)), dtype=np.uint32)
        mins = np.empty(n, dtype=np.uint64)
        for start in range(0, n, lot):
            part = cells[:min(lot, n - start)]
            np.multiply(mixed, mult[start:start + lot], out=part)
            part += add[start:start + lot]
            mins[start:start + lot] = part.min(axis=1)
        banded = mins.reshape(bands, rows)
        out = np.arange(bands, dtype=np.uint64)
        for i in range(rows):
            out = (out ^ banded[:, i]) * np.uint64(0x94D049BB133111EB)
            out ^= out >> np.uint64(32)
        return len(mixed), (mins >> np.uint64(12)).astype(np.uint8), out.view(np.int64)

    def one_bit(sketch: np.ndarray) -> np.ndarray:
        packed = np.zeros(-(-n // 64) * 8, dtype=np.uint8)
        packed[:-(-n // 8)] = np.packbits(sketch & 1)
        return packed.view(np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            signatures = [one(t) for t in batch["_text"]]
            yield pd.DataFrame({"_id": batch["_id"], "_size": np.array([s[0] for s in signatures], dtype=np.int32),
                                "_sketch": [s[1].tobytes() for s in signatures], "_bits": [one_bit(s[1]) for s in signatures], "_bands": [s[2] for s in signatures]})
    return run


def _least_share(similarity: float, n: int) -> float:
    """The share of ``n`` places in which two signatures agree at least, if they do so with the probability ``similarity`` in each."""
    return similarity - SKETCH_DEVIATIONS * (similarity * (1 - similarity) / n) ** 0.5


def _among(df: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of ``df`` with one of the different values ``known`` (one column); the others are left out before anything is shuffled, if a bounded count says
    that all tasks can have the values."""
    return df.join(F.broadcast(known) if fits_broadcast(known, MOST_SENT) else known, known.columns[0], "left_semi")


def _in_lots(tables: list[DataFrame]) -> list[DataFrame]:
    """Tables in a row put together as long as they have no more than ``LOT_ROWS`` rows."""
    lots, size = [], 0
    for table in tables:
        n = table.count()
        if lots and size + n <= LOT_ROWS:
            lots[-1], size = lots[-1].union(table), size + n
        else:
            lots.append(table)
            size = n
    return lots


def _sketched(df: DataFrame, signed: DataFrame, id_col: str, name: str, words: int) -> DataFrame:
    """Add one bit of each minimum, as ``words`` columns of 64."""
    return df.join(signed.select(F.col("_id").alias(id_col), *[F.col("_bits")[i].alias(f"{name}{i}") for i in range(words)]), id_col)


def _sketch_test(least: float):
    """Pairs whose sketches agree in at least the share ``least``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hits = [(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)).mean() >= least for a, b in zip(batch["_sketch"], batch["_head_sketch"])]
            yield batch.loc[hits, ["_id", "_head"]]
    return run


def _pair_test(threshold: float, k: int, prefix: int | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        recent = lru_cache(maxsize=64)(lambda text: _grams(text, k, prefix))
        for batch in batches:
            hits = [_similar(recent(a), recent(b), threshold) for a, b in zip(batch["_text"], batch["_head_text"])]
            yield batch.loc[hits, ["_id", "_head"]]
    return run


def near_duplicates(df: DataFrame, id_col: str = "id", text: str = "content", threshold: float = 0.70, k: int = 5,
                    prefix: int | None = None, bands: int = BANDS, rows: int = ROWS_PER_BAND) -> DataFrame:
    """The ranked-list rule over a whole corpus in id order: ``id, kept_id``; kept rows name themselves.

    Equal texts are folded first.  Rows that agree in a band of their min-hash signature may be similar; similarity
    is then tested exactly, once per pair, unless their sketches agree in too few places.  Pairs of rows that are not similar
    grow with the square of the rows, so a bit of each minimum is compared where rows meet in a band, and only pairs that
    pass are written; then a byte of each minimum, then the texts.
    Rounds: in every band the least undecided rows are heads, one in the first round and ``WIDER`` times as many in each
    further one, and all rows of the band are tested against them.  A row that is a head in all its bands has no untested
    earlier rival: without a similar undecided one it is kept, and rows similar to it are dropped.  The first round
    empties groups of copies, however large, at one pair per row and band; once all rows are heads, what is left are
    rounds over similar pairs alone.  A text missing counts as empty."""
    with shuffles_emptied(df.sparkSession):
        return _near_duplicates(df, id_col, text, threshold, k, prefix, bands, rows)


def _near_duplicates(df: DataFrame, id_col: str, text: str, threshold: float, k: int, prefix: int | None, bands: int, rows: int) -> DataFrame:
    n = bands * rows
    words = -(-n // 64)
    ids = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    id_type = ids.schema["_id"].dataType.simpleString()
    keyed = cut_lineage(ids.select("_id", F.unhex(F.sha2(F.lower(ids["_text"] if prefix is None else F.left("_text", F.lit(prefix))), 256)).alias("_key")))
    copies = cut_lineage(keyed.join(keyed.groupBy("_key").agg(F.min("_id").alias("_rep")), "_key").select("_id", "_rep"))
    again = copies.where("_id <> _rep").select("_id")
    texts = (ids.join(F.broadcast(again), "_id", "left_anti") if fits_broadcast(again, MOST_SENT) else _among(ids, copies.where("_id = _rep").select("_id")))
    signed = spread(texts, "_id").mapInPandas(_band_hashes(bands, rows, k, prefix), f"_id {id_type}, _size int, _sketch binary, _bits array<bigint>, _bands array<bigint>")
    signed = cut_lineage(signed)

    def shared(start: int, length: int) -> DataFrame:
        members = signed.select("_id", "_size", F.explode(F.slice("_bands", start + 1, length)).alias("_band"))
        several = cut_lineage(members.groupBy("_band").agg(F.count("*").alias("_n")).where("_n > 1").select("_band"))
        return cut_lineage(_among(members, several).select("_id", "_size", "_band"))

    length = max(1, min(bands, LOT_ROWS // max(signed.count(), 1)))
    lots = _in_lots([shared(start, min(length, bands - start)) for start in range(0, bands, length)])
    undecided = reduce(DataFrame.union, [live.select("_id") for live in lots]).distinct()
    least = Window.partitionBy("_band").orderBy("_id")
    most_apart = n - int(n * _least_share((1 + threshold) / 2, n))
    apart = reduce(Column.__add__, [F.bit_count(F.col(f"_row{i}").bitwiseXOR(F.col(f"_head_row{i}"))) for i in range(words)])
    # Gram counts are those of hashed grams, so a pair goes untested only if it is under the bound by more than these may be off.
    low, high = F.least("_size", "_head_size"), F.greatest("_size", "_head_size")
    rivals = (F.col("_head") < F.col("_id")) & (low * 1.001 + 2 >= high * threshold) & (apart <= most_apart)
    width, all_tested, tested, similar, decided = 1, False, None, None, None
    while not undecided.isEmpty():
        ready = undecided
        if not all_tested:
            met, waiting = [], []
            for live in lots:
                placed = cut_lineage(live.withColumn("_place", F.row_number().over(least)).where(F.col("_place") <= width + 1))
                heads = placed.where(F.col("_place") <= width).select("_band", F.col("_id").alias("_head"), F.col("_size").alias("_head_size"))
                beyond = placed.where(F.col("_place") > width).select("_band", F.col("_id").alias("_from"))
                pairs = (_sketched(live, signed, "_id", "_row", words).join(_sketched(heads, signed, "_head", "_head_row", words), "_band")
                         .where(rivals).select("_id", "_head").distinct())
                pairs = cut_lineage(pairs if tested is None else pairs.join(tested, ["_id", "_head"], "left_anti"))
                tested = pairs if tested is None else tested.union(pairs)
                met.append(pairs)
                if not beyond.isEmpty():
                    waiting.append(cut_lineage(live.join(beyond, "_band").where("_id >= _from").select("_id").distinct()))
            pairs = reduce(DataFrame.union, met)
            sketches = _among(signed.select("_id", "_sketch"), pairs.select("_id").union(pairs.select("_head")).distinct())
            close = cut_lineage(pairs.join(sketches, "_id").join(sketches.select(F.col("_id").alias("_head"), F.col("_sketch").alias("_head_sketch")), "_head")
                                .select("_id", "_head", "_sketch", "_head_sketch")
                                .mapInPandas(_sketch_test(_least_share(threshold, n)), f"_id {id_type}, _head {id_type}"))
            read = _among(ids, close.select("_id").union(close.select("_head")).distinct())
            found = (close.join(read, "_id").join(read.select(F.col("_id").alias("_head"), F.col("_text").alias("_head_text")), "_head")
                     .select("_id", "_head", "_text", "_head_text").mapInPandas(_pair_test(threshold, k, prefix), f"_id {id_type}, _head {id_type}"))
            similar = cut_lineage(found if similar is None else similar.unionByName(found))
            for later in waiting:
                ready = ready.join(later, "_id", "left_anti")
            all_tested = not waiting
            width *= WIDER
        kept = ready.join(similar.select("_id"), "_id", "left_anti")
        dropped = similar.join(kept.select(F.col("_id").alias("_head")), "_head", "left_semi").groupBy("_id").agg(F.min("_head").alias("_kept"))
        now = cut_lineage(kept.select("_id", F.col("_id").alias("_kept")).unionByName(dropped))
        decided = now if decided is None else decided.unionByName(now)
        undecided = cut_lineage(undecided.join(now, "_id", "left_anti"))
        similar = cut_lineage(similar.join(now, "_id", "left_anti").join(now.select(F.col("_id").alias("_head")), "_head", "left_anti"))
        if not all_tested:
            lots = _in_lots([cut_lineage(live.join(now, "_id", "left_anti")) for live in lots])
    if decided is None:
        return copies.select(F.col("_id").alias(id_col), F.col("_rep").alias("kept_id"))
    return (copies.join(decided.select(F.col("_id").alias("_rep"), "_kept"), "_rep", "left")
            .select(F.col("_id").alias(id_col), F.coalesce("_kept", "_rep").alias("kept_id")))


# ---- documents ------------------------------------------------------------------------------------------------

def plan_documents(new: DataFrame, registry: DataFrame, policy: str = "ask") -> DataFrame:
    """What to do with each arriving document: ``ingest`` when its bytes are unknown, else what ``policy`` says
    (``ask``, ``skip``, ``replace``, ``reindex``).  Of several registry rows with one hash the oldest counts."""
    if policy not in ("ask", "skip", "replace", "reindex"):
        raise ValueError(policy)
    known = (registry.groupBy("document_hash").agg(F.min(F.struct("created_at", "id")).alias("_first"))
             .select("document_hash", F.col("_first.id").alias("existing_id")))
    return (new.join(known, "document_hash", "left")
            .withColumn("action", F.when(F.col("existing_id").isNull(), F.lit("ingest")).otherwise(F.lit(policy))))


def new_content_only(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks whose hash is not stored yet."""
    known = stored.where(F.col("content_hash").isNotNull()).select("content_hash").distinct()
    return chunks.join(known, "content_hash", "left_anti")
