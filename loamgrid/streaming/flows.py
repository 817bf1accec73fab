"""Structured Streaming forms of the continuously running data flows."""
from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import messages as ms
from ..functions import text as tx
from ..operators.html import extract_pages
from ..operators.listing import latest_per_key
from ..operators.upsert import KEY, plan_upsert
from ..plans.ingest import page_chunks
from ..session import cut_lineage
from ..sources.readers import admit_pages
from ..sources.sinks import append_log, is_table


def read_events(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_trigger: int = 1000, ts: str = "ts") -> DataFrame:
    """Stream of the files of a folder; its event time becomes a zoned timestamp, as watermarks need."""
    raw = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
           .option("pathGlobFilter", pattern).parquet(folder))
    return raw.withColumn(ts, F.col(ts).cast("timestamp"))


def _start(df: DataFrame, checkpoint: str, mode: str, **sink) -> StreamingQuery:
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if "each" in sink:
        return writer.foreachBatch(sink["each"]).start()
    if "table" in sink:
        return writer.format("memory").queryName(sink["table"]).start()
    return writer.format("parquet").option("path", sink["path"]).start()


# ---- ingestion ------------------------------------------------------------------------------------------------

def fresh_pages(pages: DataFrame, seen_at: str = "fetched_at", watermark: str = "1 day", prefix: int | None = None) -> DataFrame:
    """Accepted pages without near copies that arrive within the watermark of each other."""
    taken = admit_pages(extract_pages(pages)).where(F.col("status") == "accepted").drop("status", "reason", "blocks", "title", "problem")
    marked = taken.withWatermark(seen_at, watermark).withColumn("fingerprint", tx.fingerprint(F.col("content"), prefix))
    return marked.dropDuplicatesWithinWatermark(["fingerprint"])


MARK = -1                            # chunk number of the row that says when a page was last taken
BUCKETS = 64


def _state(spark: SparkSession, changes_path: str, buckets: list[int] | None = None, below: int | None = None) -> DataFrame | None:
    """The last change of each key, marks and removals included, from the newest snapshot and the log behind it; ``buckets`` are the only ones read.

    Nothing is there before the first batch: None."""
    def part(name: str) -> DataFrame | None:
        path = f"{changes_path}/{name}"
        if not is_table(spark, path):
            return None
        rows = spark.read.parquet(path).withColumn("batch_id", F.col("batch_id").cast("long"))
        return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))
    snapshot, log = part("snapshot"), part("log")
    if log is not None and below is not None:
        log = log.where(F.col("batch_id") < below)
    if snapshot is not None:
        upto = spark.read.parquet(f"{changes_path}/snapshot").agg(F.max("batch_id")).first()[0]
        snapshot = snapshot.where(F.col("batch_id") == upto)
        log = log.where(F.col("batch_id") > upto) if log is not None else None
    both = snapshot if log is None else log if snapshot is None else snapshot.unionByName(log)
    return None if both is None else latest_per_key(both, list(KEY), ["fetched_at", "batch_id"])


def current_chunks(spark: SparkSession, changes_path: str) -> DataFrame:
    """State of the chunk table: the last change of each key, by the time its page was fetched; removed chunks are gone."""
    return _state(spark, changes_path).where((F.col("chunk_index") != MARK) & (F.col("action") != "delete"))


def compact_changes(spark: SparkSession, changes_path: str) -> None:
    """Write the state as one snapshot, bucketed like the log; later batches read it instead of the log before it, whose folders may then be removed."""
    upto = spark.read.parquet(f"{changes_path}/log").agg(F.max(F.col("batch_id").cast("long"))).first()[0]
    state = cut_lineage(_state(spark, changes_path).withColumn("batch_id", F.lit(upto)))
    (state.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", "bucket").parquet(f"{changes_path}/snapshot"))


def write_changes(changes_path: str, buckets: int = BUCKETS):
    """``foreachBatch`` writer: appends what a micro-batch inserts, updates or removes to a change log.

    Of a page that comes several times the last by ``fetched_at`` counts, whole; a page fetched before what is stored of it is passed over; chunks that a shorter page
    has lost are removed.  The log is dealt into buckets by source, and only buckets that the batch falls into are read.  The folder of a batch id is overwritten, so a repeated
    batch has no further effect; ``current_chunks`` gives the table, ``compact_changes`` shortens the log."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        place = F.pmod(F.xxhash64("source_url"), F.lit(buckets)).cast("int")
        pages = latest_per_key(batch.select("page_id", "url", "html", "fetched_at"), ["url"], ["fetched_at", "page_id"])
        new = cut_lineage(page_chunks(pages, with_keywords=True, drop_repeats=False, carried=("fetched_at",)).withColumn("bucket", place))
        marks = pages.select(F.col("url").alias("source_url"), F.lit("webpage").alias("source_type"), F.lit(MARK).alias("chunk_index"), "fetched_at").withColumn("bucket", place)
        touched = [r["bucket"] for r in marks.select("bucket").distinct().collect()]          # at most ``buckets`` numbers
        known = _state(spark, changes_path, touched, batch_id)
        if known is None:
            known = new.limit(0).withColumns({"id": F.lit(None).cast("string"), "action": F.lit(None).cast("string"), "old_namespace": F.lit(None).cast("string"),
                                              "created_at": F.lit(None).cast("timestamp"), "batch_id": F.lit(None).cast("long")})
        stored = known.groupBy("source_url").agg(F.max("fetched_at").alias("_stored"))
        late = marks.join(stored, "source_url").where(F.col("fetched_at") < F.col("_stored")).select("source_url")
        new, marks = new.join(late, "source_url", "left_anti"), marks.join(late, "source_url", "left_anti")
        living = known.where((F.col("chunk_index") != MARK) & (F.col("action") != "delete"))
        plan = plan_upsert(new, living, version=["fetched_at"]).where(F.col("action") != "touch")
        came = marks.select("source_url", "source_type", F.col("fetched_at").alias("_at"))
        gone = (living.join(came, ["source_url", "source_type"]).join(new.select(*KEY), list(KEY), "left_anti")
                .withColumns({"action": F.lit("delete"), "fetched_at": F.col("_at"), "content": F.lit(None).cast("string")}).drop("_at", "batch_id", "created_at"))
        rows = (plan.unionByName(gone, allowMissingColumns=True).unionByName(marks.withColumn("action", F.lit("mark")), allowMissingColumns=True)
                .withColumns({"created_at": F.current_timestamp(), "batch_id": F.lit(batch_id)}))
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id", "bucket").parquet(f"{changes_path}/log"))
    return write


def ingest_stream(pages: DataFrame, changes_path: str, checkpoint: str, **options) -> StreamingQuery:
    return _start(fresh_pages(pages, **options), checkpoint, "append", each=write_changes(changes_path))


# ---- counts ---------------------------------------------------------------------------------------------------

def tumbling_counts(events: DataFrame, columns: list[str], ts: str = "ts", width: str = "1 day", watermark: str = "1 hour") -> DataFrame:
    """Counts per window and key; later than the watermark is dropped."""
    return (events.withWatermark(ts, watermark).groupBy(F.window(ts, width).alias("w"), *columns).agg(F.count("*").alias("n"))
            .select(F.col("w.start").alias("window_start"), *columns, "n"))


def sliding_request_counts(events: DataFrame, key: str, ts: str = "ts", width: str = "1 minute", slide: str = "10 seconds",
                           limit: int = 20, watermark: str = "5 minutes") -> DataFrame:
    """Ids over the limit in any sliding window."""
    return (events.withWatermark(ts, watermark).groupBy(F.window(ts, width, slide).alias("w"), key).agg(F.count("*").alias("n"))
            .where(F.col("n") > limit).select(F.col("w.start").alias("window_start"), key, "n"))


def session_counts(events: DataFrame, key: str, ts: str = "ts", gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    return (events.withWatermark(ts, watermark).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
            .select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n"))


def limited_requests(events: DataFrame, key: str, event: str = "event_id", ts: str = "ts", window_seconds: int = 60,
                     limit: int = 20, watermark: str = "5 minutes") -> DataFrame:
    """Fixed windows from an id's first request, as state per id; ``refused`` above the limit.

    Rows of one id arrive in chunks; the state is two numbers and expires with the window."""
    span = window_seconds * 1000
    key_type = events.schema[key].dataType.simpleString()
    event_type = events.schema[event].dataType.simpleString()
    out = f"{key} {key_type}, {event} {event_type}, {ts} timestamp, request_no int, refused boolean"

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        opened, count = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values([ts, event])
        numbers = []
        for at in rows[ts].astype("datetime64[us]").astype("int64") // 1000:
            if opened is None or at > opened + span:
                opened, count = int(at), 0
            count += 1
            numbers.append(count)
        state.update((opened, count))
        state.setTimeoutTimestamp(max(opened + span, state.getCurrentWatermarkMs()) + 1)
        yield rows[[key, event, ts]].assign(request_no=numbers, refused=[n > limit for n in numbers])

    return (events.select(key, event, ts).withWatermark(ts, watermark).groupBy(key)
            .applyInPandasWithState(run, out, "opened long, count int", "append", GroupStateTimeout.EventTimeTimeout))


# ---- logs -----------------------------------------------------------------------------------------------------

def unanswered_stream(log: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Questions without data, appended to their table."""
    missing = (log.where(F.col("confidence") == "no_data")
               .select(F.col("query").alias("question_text"), ms.language(F.col("query")).alias("language"),
                       F.col("intent").alias("persona"), F.lit("tier3").alias("tier"), F.lit(False).alias("resolved"), "created_at"))
    return _start(missing, checkpoint, "append", path=path)


def feedback_stream(feedback: DataFrame, conversations: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Valid feedback matched to stored conversations on id and session, appended as changes."""
    valid = feedback.where(ms.feedback_problem(F.col("feedback")).isNull())
    stored = conversations.select(F.col("id").alias("conversation_id"), "session_id")
    matched = valid.join(stored, ["conversation_id", "session_id"])

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(path))
    return _start(matched, checkpoint, "append", each=write)


def log_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    return _start(rows, checkpoint, "append", each=lambda batch, _id: append_log(batch, path))


def run_to_end(query: StreamingQuery, timeout: float | None = None) -> None:
    """Waits until the stream has taken all there is; only a caller can set a limit (seconds)."""
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError("the stream did not finish")
    if query.exception():
        raise query.exception()
