"""Hybrid retrieval for a table of questions: routing, vector and keyword search, fusion, confidence, fallback."""
from __future__ import annotations

from typing import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import vectors as vec
from ..functions.vocabulary import (DEFAULT_NAMESPACE, RETRY_SYNONYMS, ROUTING_RULES, STAGE_TOPIC_PATTERN,
                                    STAGE_TOPIC_SUFFIX, SYNONYM_TRIGGER_PATTERN, SYNONYMS, Rule)
from ..session import cut_lineage, fits_broadcast
from .dedupe import dedupe_ranked
from .keyword_index import KeywordIndex, keyword_hits
from .postings import keyword_topk
from .rules import all_matches, matches

# List lengths, fusion constant, score limits.
TOP_K_VECTOR, TOP_K_KEYWORD, RRF_K = 30, 40, 60
MIN_VECTOR_SCORE, PRIMARY_BOOST = 0.10, 0.15
HIGH_SCORE, MEDIUM_SCORE = 0.014, 0.006
BROADCAST_QUERIES = 20_000          # question rows of 1 KB or so: some 20 MB per executor
BLOCK_VECTORS, BLOCK_QUERIES = 50_000, 2_000


# ---- questions ------------------------------------------------------------------------------------------------

def route(queries: DataFrame, rules: Sequence[Rule] = ROUTING_RULES, default: str = DEFAULT_NAMESPACE,
          text: str = "text") -> DataFrame:
    """Namespaces to search: those of every matching rule, the default last and not primary."""
    found = F.array_union(all_matches(F.lower(F.col(text)), rules), F.array(F.lit(default)))
    return (queries.select(*queries.columns, F.explode(found).alias("namespace"))
            .withColumn("is_primary", F.col("namespace") != default))


def expand_synonyms(text: Column, synonyms: Sequence[tuple[str, Sequence[str]]] = SYNONYMS, skip_present: bool = True) -> Column:
    """The text followed by the alternatives of every term it contains."""
    low = F.lower(text)
    extra = []
    for term, alternatives in synonyms:
        for alternative in alternatives:
            wanted = F.contains(low, F.lit(term))
            if skip_present:
                wanted = wanted & ~F.contains(low, F.lit(alternative))
            extra.append(F.when(wanted, F.lit(alternative)))
    return F.concat_ws(" ", text, *extra)


def variants(queries: DataFrame, paraphrases: DataFrame | None = None, synonyms: Sequence = SYNONYMS,
             trigger: str = SYNONYM_TRIGGER_PATTERN) -> DataFrame:
    """``query_id, variant_no, text``: the question (0), given paraphrases, and the synonym form when a trigger
    word occurs and the form differs from all others."""
    cols = ["query_id", "variant_no", "text"]
    base = queries.select("query_id", F.lit(0).alias("variant_no"), F.trim("text").alias("text"))
    if paraphrases is not None:
        base = base.unionByName(paraphrases.select(*cols))
    widened = (queries.where(F.lower("text").rlike(trigger))
               .select("query_id", F.lit(1000).alias("variant_no"), expand_synonyms(F.trim("text"), synonyms).alias("text"))
               .join(base.select("query_id", "text"), ["query_id", "text"], "left_anti").select(*cols))
    return base.unionByName(widened)


# ---- vectors --------------------------------------------------------------------------------------------------

def embed_text(df: DataFrame, text: str = "text", dims: int = 256, out: str = "embedding") -> DataFrame:
    """Hashed bag-of-words vector of unit length for each row; rows without any word are left out."""
    from pyspark.ml.feature import HashingTF, Normalizer
    from pyspark.ml.functions import vector_to_array
    words = df.withColumn("_w", tx.words(F.col(text)))
    counted = HashingTF(inputCol="_w", outputCol="_tf", numFeatures=dims).transform(words)
    unit = Normalizer(inputCol="_tf", outputCol="_v", p=2.0).transform(counted)
    return (unit.withColumn(out, vector_to_array("_v", "float32")).where(vec.is_usable(F.col(out)))
            .drop("_w", "_tf", "_v"))


def _unit(rows) -> np.ndarray:
    m = np.stack([np.asarray(r, dtype=np.float64) for r in rows])
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _best(qids: np.ndarray, qm: np.ndarray, ids: np.ndarray, vm: np.ndarray, k: int) -> pd.DataFrame:
    scores = qm @ vm.T
    if scores.shape[1] > k:
        # Everything at or above the k-th score stays, so ties are settled by id later, not by position.
        limit = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        row, col = np.nonzero(scores >= limit[:, None] - 1e-9)
    else:
        row, col = (a.ravel() for a in np.indices(scores.shape))
    return pd.DataFrame({"_qid": qids[row], "id": ids[col], "score": scores[row, col]})


def _scores_broadcast(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    local = queries.select("_qid", "namespace", "embedding").toPandas()
    by_namespace = {ns: (g["_qid"].to_numpy(), _unit(g["embedding"])) for ns, g in local.groupby("namespace")}
    shared = queries.sparkSession.sparkContext.broadcast(by_namespace)
    id_type = vectors.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ns, rows in batch.groupby("namespace", sort=False):
                if ns in shared.value:
                    qids, qm = shared.value[ns]
                    yield _best(qids, qm, rows["id"].to_numpy(), _unit(rows["embedding"]), k).assign(namespace=ns)
    return vectors.mapInPandas(run, f"_qid bigint, id {id_type}, score double, namespace string")


def _scores_blocked(queries: DataFrame, vectors: DataFrame, k: int, block_vectors: int, block_queries: int) -> DataFrame:
    """Both sides in hashed blocks per namespace; every pair of blocks is one small group."""
    def blocks(df: DataFrame, size: int, name: str) -> DataFrame:
        return df.groupBy("namespace").agg(F.ceil(F.count("*") / F.lit(size)).cast("int").alias(name))
    shape = blocks(vectors, block_vectors, "_nv").join(blocks(queries, block_queries, "_nq"), "namespace")
    left = (queries.join(shape, "namespace").withColumn("_qb", F.pmod(F.xxhash64("_qid"), F.col("_nq")).cast("int"))
            .withColumn("_vb", F.explode(F.sequence(F.lit(0), F.col("_nv") - 1)))
            .select("namespace", "_vb", "_qb", "_qid", "embedding"))
    right = (vectors.join(shape, "namespace").withColumn("_vb", F.pmod(F.xxhash64("id"), F.col("_nv")).cast("int"))
             .withColumn("_qb", F.explode(F.sequence(F.lit(0), F.col("_nq") - 1)))
             .select("namespace", "_vb", "_qb", "id", "embedding"))
    id_type = vectors.schema["id"].dataType.simpleString()
    schema = f"_qid bigint, id {id_type}, score double, namespace string"

    def run(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if q.empty or v.empty:
            return pd.DataFrame({"_qid": pd.Series(dtype="int64"), "id": pd.Series(dtype=v["id"].dtype),
                                 "score": pd.Series(dtype="float64"), "namespace": pd.Series(dtype="object")})
        return _best(q["_qid"].to_numpy(), _unit(q["embedding"]), v["id"].to_numpy(), _unit(v["embedding"]),
                     k).assign(namespace=q["namespace"].iloc[0])
    keys = ["namespace", "_vb", "_qb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = TOP_K_VECTOR, min_score: float = MIN_VECTOR_SCORE,
                boost: float = PRIMARY_BOOST, max_broadcast: int = BROADCAST_QUERIES,
                block_vectors: int = BLOCK_VECTORS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """Exact cosine top ``k`` per question variant and namespace; scores under ``min_score`` go, primary namespaces
    gain ``boost`` after that, and each chunk counts once per question with its best score.

    ``queries``: query_id, variant_no, namespace, is_primary, embedding.  ``vectors``: id, namespace, embedding.
    Pairs are scored as matrix products inside a task, which passes on about ``k`` rows per question and block."""
    asked = queries.where(vec.is_usable(F.col("embedding"))).withColumn(
        "_qid", F.xxhash64("query_id", "variant_no", "namespace"))
    stored = vectors.where(vec.is_usable(F.col("embedding"))).select("id", "namespace", "embedding")
    if fits_broadcast(asked, max_broadcast):
        scored = _scores_broadcast(asked, stored, k)
    else:
        scored = _scores_blocked(asked, stored, k, block_vectors, block_queries)
    per_list = Window.partitionBy("_qid", "namespace").orderBy(F.round("score", 9).desc(), "id")
    best = scored.withColumn("_r", F.row_number().over(per_list)).where(F.col("_r") <= k).where(F.col("score") >= min_score)
    lists = asked.select("_qid", "query_id", "namespace", "is_primary")
    boosted = best.join(lists, ["_qid", "namespace"]).withColumn(
        "score", F.when(F.col("is_primary"), F.col("score") + boost).otherwise(F.col("score")))
    return boosted.groupBy("query_id", "id").agg(F.max("score").alias("score"))


def coverage_test(tests: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """Does a namespace answer its question?  ``test_id, namespace, hits, top_score, confidence, passed``.

    ``tests``: test_id, namespace, embedding."""
    asked = tests.select(F.col("test_id").alias("query_id"), F.lit(0).alias("variant_no"), "namespace",
                         F.lit(False).alias("is_primary"), "embedding")
    hits = vector_topk(asked, vectors, k, min_score=-1.0, boost=0.0)
    summary = hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.max("score").alias("_top"))
    top = F.coalesce("_top", F.lit(0.0))
    level = F.when(top >= 0.75, "high").when(top >= 0.55, "medium").when(top >= 0.35, "low").otherwise("none")
    return (tests.select("test_id", "namespace").join(summary.withColumnRenamed("query_id", "test_id"), "test_id", "left")
            .select("test_id", "namespace", F.coalesce("hits", F.lit(0)).alias("hits"), F.round(top, 2).alias("top_score"),
                    level.alias("confidence"), (F.coalesce("hits", F.lit(0)) > 0).alias("_any"))
            .withColumn("passed", F.col("_any") & F.col("confidence").isin("high", "medium")).drop("_any"))


# ---- fusion ---------------------------------------------------------------------------------------------------

def rrf(vector_hits: DataFrame, keyword_hits: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion: ``query_id, id, score, keyword_score, rrf_score, rank``.

    The lists are top-k lists, so ranking one question is a small job."""
    def ranked(df: DataFrame, score: str) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.round(score, 9).desc(), "id")
        return df.withColumn("_part", F.lit(1.0) / (F.lit(k) + F.row_number().over(w)))
    both = (ranked(vector_hits, "score").select("query_id", "id", "score", F.lit(None).cast("double").alias("keyword_score"), "_part")
            .unionByName(ranked(keyword_hits, "keyword_score").select(
                "query_id", "id", F.lit(None).cast("double").alias("score"), "keyword_score", "_part")))
    fused = both.groupBy("query_id", "id").agg(F.max("score").alias("score"), F.max("keyword_score").alias("keyword_score"),
                                               F.sum("_part").alias("rrf_score"))
    return with_rank(fused)


def with_rank(df: DataFrame, score: str = "rrf_score") -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.round(score, 12).desc_nulls_last(), "id")
    return df.withColumn("rank", F.row_number().over(w))


def merge_by_precedence(stages: Sequence[DataFrame]) -> DataFrame:
    """Rows of the first stage, then those of each further stage whose id is new; ``rank`` runs through."""
    tagged = [s.withColumn("_stage", F.lit(i)) for i, s in enumerate(stages)]
    together = tagged[0]
    for s in tagged[1:]:
        together = together.unionByName(s, allowMissingColumns=True)
    first = Window.partitionBy("query_id", "id").orderBy("_stage")
    place = Window.partitionBy("query_id").orderBy("_stage", "rank", "id")
    return (together.withColumn("_n", F.row_number().over(first)).where("_n = 1")
            .withColumn("rank", F.row_number().over(place)).drop("_n", "_stage"))


def citations(ranked: DataFrame, depth: int = 10) -> DataFrame:
    """Web addresses among the first ``depth`` rows, each once, in rank order."""
    once = Window.partitionBy("query_id", "source_url").orderBy("rank")
    place = Window.partitionBy("query_id").orderBy("rank")
    return (ranked.where((F.col("rank") <= depth) & F.col("source_url").startswith("http"))
            .withColumn("_n", F.row_number().over(once)).where("_n = 1")
            .withColumn("citation_no", F.row_number().over(place))
            .select("query_id", "citation_no", "title", F.col("source_url").alias("url"), "page_type", "category"))


def confidence(queries: DataFrame, ranked: DataFrame, high: float = HIGH_SCORE, medium: float = MEDIUM_SCORE) -> DataFrame:
    """``query_id, n_rows, top_score, keyword_evidence, confidence``; questions without rows get ``no_data``."""
    score = F.coalesce("rrf_score", "score", F.lit(0.0))
    facts = ranked.groupBy("query_id").agg(
        F.count("*").alias("n_rows"), F.min_by(score, "rank").alias("top_score"),
        F.coalesce(F.max(F.when(F.col("rank") <= 5, F.coalesce("keyword_score", F.lit(0.0)) > 0)), F.lit(False)).alias("keyword_evidence"))
    strong = (F.col("n_rows") >= 5) & (F.col("top_score") > high)
    level = (F.when(F.col("n_rows") == 0, "no_data").when(strong & F.col("keyword_evidence"), "high")
             .when(strong, "low").when((F.col("n_rows") >= 2) & (F.col("top_score") > medium), "medium").otherwise("low"))
    return (queries.select("query_id").join(facts, "query_id", "left")
            .select("query_id", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("top_score", F.lit(0.0)).alias("top_score"),
                    F.coalesce("keyword_evidence", F.lit(False)).alias("keyword_evidence"))
            .withColumn("confidence", level))


# ---- whole retrieval ------------------------------------------------------------------------------------------

def hybrid(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, terms: KeywordIndex | DataFrame,
           paraphrases: DataFrame | None = None, k_vector: int = TOP_K_VECTOR, k_keyword: int = TOP_K_KEYWORD,
           rules: Sequence[Rule] = ROUTING_RULES, all_namespaces: bool = False, dims: int = 256,
           dedupe_prefix: int | None = None) -> DataFrame:
    """Fused, deduplicated candidates with chunk columns: ``query_id, id, score, keyword_score, rrf_score, rank``.

    ``terms`` is the stored index of the chunks or, for a few chunks, their term uses."""
    asked = variants(queries.where(F.trim("text") != ""), paraphrases)
    embedded = embed_text(asked, "text", dims)
    if all_namespaces:
        everywhere = vectors.select("namespace").distinct()
        named = F.array_sort(F.collect_set("namespace"))      # one entry per namespace, a directory listing
        routed = embedded.withColumn("namespace", F.explode(everywhere.agg(named).scalar())).withColumn("is_primary", F.lit(False))
    else:
        routed = route(embedded, rules)
    hits = vector_topk(routed, vectors, k_vector)
    fused = rrf(hits, keyword_hits(terms, queries, k_keyword) if isinstance(terms, KeywordIndex) else keyword_topk(queries, terms, k_keyword))
    shown = fused.join(chunks.select("id", "title", "content", "source_url", "page_type", "category", "updated_at"), "id")
    return with_rank(dedupe_ranked(shown, prefix=dedupe_prefix))


def retrieve_staged(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, terms: KeywordIndex | DataFrame,
                    paraphrases: DataFrame | None = None, rules: Sequence[Rule] = ROUTING_RULES,
                    topic: str = STAGE_TOPIC_PATTERN, dims: int = 256, dedupe_prefix: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Up to four attempts, each only for questions not settled before; returns (rows, outcome).

    A question is settled by high confidence, or medium with three rows.  1: as asked.  2: with synonyms, merged
    before 1.  3: only for the given topic, with a broadening suffix, merged before 2.  4: every namespace, 50 per
    list, believed only at high or medium.  If nothing but low is left the question has no data."""
    common = dict(chunks=chunks, vectors=vectors, terms=terms, dims=dims, rules=rules, dedupe_prefix=dedupe_prefix)
    tried: list[tuple[DataFrame, DataFrame]] = []       # rows and levels of each attempt, earlier rows merged in
    out: list[tuple[DataFrame, DataFrame]] = []         # what is final

    def attempt(asked: DataFrame, stage: int, **options) -> tuple[DataFrame, DataFrame]:
        rows = cut_lineage(hybrid(asked, **common, **options))
        level = confidence(asked, rows).withColumn("stage", F.lit(stage))
        if stage in (2, 3):
            found = rows.select("query_id").distinct()
            rows = cut_lineage(merge_by_precedence([rows, tried[-1][0].join(found, "query_id", "left_semi")]))
            counted = rows.groupBy("query_id").agg(F.count("*").alias("n_total"))
            level = level.join(counted, "query_id", "left").fillna(0, ["n_total"])
        else:
            level = level.withColumn("n_total", F.col("n_rows"))
        return rows, cut_lineage(level)

    def settle(rows: DataFrame, level: DataFrame, rest: DataFrame, rule: Column) -> DataFrame:
        done = level.where(rule)
        out.append((rows.join(done.select("query_id"), "query_id", "left_semi"), done))
        return cut_lineage(rest.join(done.select("query_id"), "query_id", "left_anti"))

    good = (F.col("confidence") == "high") | ((F.col("confidence") == "medium") & (F.col("n_total") >= 3))
    rest = queries
    for stage in (1, 2, 3):
        asked, options = rest, {}
        if stage > 1:
            options["paraphrases"] = None if paraphrases is None else paraphrases.join(rest.select("query_id"), "query_id", "left_semi")
        if stage == 2:
            asked = rest.withColumn("text", expand_synonyms(F.col("text"), RETRY_SYNONYMS, skip_present=False))
        if stage == 3:
            asked = rest.where(F.col("text").rlike(topic)).withColumn("text", F.concat("text", F.lit(STAGE_TOPIC_SUFFIX)))
            if asked.isEmpty():
                continue
        tried.append(attempt(asked, stage, **options))
        rest = settle(*tried[-1], rest, good)
        if rest.isEmpty():
            return _together(out)

    rows, level = attempt(rest, 4, paraphrases=paraphrases, all_namespaces=True, k_vector=50)
    believed = level.where(F.col("confidence").isin("high", "medium")).select("query_id")
    best = None                                         # rows of the latest attempt that found any
    for earlier, _ in reversed(tried):
        best = earlier if best is None else best.unionByName(earlier.join(best.select("query_id").distinct(), "query_id", "left_anti"))
    merged = merge_by_precedence([rows.join(believed, "query_id", "left_semi"), best.join(believed, "query_id", "left_semi")])
    rest = settle(cut_lineage(merged), level, rest, F.col("confidence").isin("high", "medium"))
    if rest.isEmpty():
        return _together(out)
    for rows, level in reversed(tried):                 # a medium attempt is better than nothing
        rest = settle(rows, level.join(rest.select("query_id"), "query_id", "left_semi"), rest, F.col("confidence") == "medium")
    nothing = rest.select("query_id", F.lit(0).cast("long").alias("n_rows"), F.lit(0.0).alias("top_score"),
                          F.lit(False).alias("keyword_evidence"), F.lit("no_data").alias("confidence"), F.lit(4).alias("stage"),
                          F.lit(0).cast("long").alias("n_total"))
    out.append((out[0][0].limit(0), nothing))
    return _together(out)


def _together(parts: Sequence[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    rows, levels = parts[0]
    for more_rows, more_levels in parts[1:]:
        rows, levels = rows.unionByName(more_rows), levels.unionByName(more_levels)
    return rows, levels


def explain_retrieval(queries: DataFrame, fused: DataFrame, reranked: DataFrame, depth: int = 10) -> DataFrame:
    """All scores of the first ``depth`` reranked rows side by side, with the number of fused candidates."""
    sizes = fused.groupBy("query_id").agg(F.count("*").alias("candidates"))
    return (reranked.where(F.col("final_rank") <= depth)
            .select("query_id", "final_rank", "id", F.coalesce("score", F.lit(0.0)).alias("score"),
                    F.coalesce("keyword_score", F.lit(0.0)).alias("keyword_score"), "rrf_score", "rerank_score")
            .join(sizes, "query_id").join(queries.select("query_id"), "query_id", "left_semi"))
