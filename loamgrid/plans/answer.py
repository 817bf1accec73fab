"""A table of questions to ranked context, citations and confidence."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import messages as ms
from ..operators.context import build_context
from ..operators.keyword_index import KeywordIndex, build_index
from ..operators.rerank import rerank
from ..operators.retrieval import citations, embed_text, retrieve_staged
from ..session import cut_lineage


def answer_context(queries: DataFrame, chunks: DataFrame, as_of: datetime, vectors: DataFrame | None = None,
                   paraphrases: DataFrame | None = None, dims: int = 256, index: KeywordIndex | None = None) -> dict[str, DataFrame]:
    """Everything an answer needs: ``outcome``, ``ranked``, ``context``, ``citations`` and ``unanswered``.

    ``queries``: query_id, text.  ``chunks``: the chunk table with ``keywords``.  ``index``: its stored keyword index, made here if there is none."""
    index = index or build_index(chunks)
    if vectors is None:
        vectors = cut_lineage(embed_text(chunks.select("id", "namespace", "content"), "content", dims).select("id", "namespace", "embedding"))     # every stage reads them
    rows, outcome = retrieve_staged(queries, chunks, vectors, index, paraphrases, dims=dims)
    rows = cut_lineage(rows)
    asked = queries.select("query_id", F.col("text").alias("query_text"), ms.result_size(F.col("text")).alias("_n"))
    candidates = rows.join(chunks.select("id", "keywords"), "id", "left").join(asked, "query_id")
    ranked = rerank(candidates, as_of, F.col("_n")).drop("_n")
    no_data = (outcome.where(F.col("confidence") == "no_data").join(queries, "query_id")
               .select("query_id", F.col("text").alias("question_text"), ms.language(F.col("text")).alias("language"),
                       ms.intent(F.col("text")).alias("persona"), F.lit("tier3").alias("tier")))
    return {"outcome": outcome, "ranked": ranked, "context": build_context(ranked), "citations": citations(rows), "unanswered": no_data}
