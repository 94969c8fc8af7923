"""Streaming forms of ingest, index upkeep, reviews, ledgers and activity. Each also runs on a finite table, with the same result."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from attestry.functions.spans import chunk_text
from attestry.operators.aggregates import charge
from attestry.operators.mutations import SOURCE_KEY, append_sources, refresh_index


def stream_sources(arrivals: DataFrame, time: str = "ts", horizon: str = "1 day") -> DataFrame:
    """The first arrival of each source key; repeats are known within the horizon, which bounds the state. See ``ingest_batches`` for all of history."""
    if not arrivals.isStreaming:
        return arrivals.dropDuplicates(SOURCE_KEY)
    return arrivals.withWatermark(time, horizon).dropDuplicatesWithinWatermark(SOURCE_KEY)


def ingest_batches(read: Callable[[], DataFrame], write: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: appends the sources of a batch that are not in the table that ``read`` gives; a batch that is run again adds nothing."""

    def batch(df: DataFrame, _: int) -> None:
        write(append_sources(read(), df)[0])

    return batch


def _folders(spark: SparkSession, path: str) -> list[str]:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in files.listStatus(folder)] if files.exists(folder) else []


class VersionedChunks:
    """Chunks of sources as a table that batches add versions to; a source's newest batch is what counts.

    Batch n lies in a folder of its own, which only that batch writes: run again it writes the same, since what it compares with are the
    batches before it. Readers see whole batches alone, now or as of an earlier one. Sources that left have a row without a chunk.
    """

    def __init__(self, spark: SparkSession, path: str, index_version: str):
        self.spark, self.path, self.index_version = spark, path, index_version

    def _all(self, before: int | None = None) -> DataFrame | None:
        done = [f for f in _folders(self.spark, self.path) if f.startswith("batch=") and "_SUCCESS" in _folders(self.spark, f"{self.path}/{f}")]
        if before is not None:
            done = [f for f in done if int(f[6:]) < before]
        return self.spark.read.option("basePath", self.path).parquet(*(f"{self.path}/{f}" for f in done)) if done else None

    def _newest(self, before: int | None) -> DataFrame | None:
        rows = self._all(before)
        if rows is None:
            return None
        last = rows.groupBy("source_id").agg(F.max("batch").alias("batch"))
        return rows.join(last, ["source_id", "batch"])

    def chunks(self, before: int | None = None) -> DataFrame:
        """(source_id, digest, message_id, start_char, end_char) of the sources that there are, as of the batches before ``before``."""
        rows = self._newest(before)
        shape = "source_id string, digest string, message_id string, start_char int, end_char int"
        return self.spark.createDataFrame([], shape) if rows is None else rows.where("message_id is not null").select("source_id", "digest", "message_id", "start_char", "end_char")

    def batch(self, df: DataFrame, batch_id: int) -> None:
        """For ``foreachBatch`` over changed texts (source_id, digest, message_id, text, seq): cuts the sources whose digest is another than the newest known.

        Of several digests of a source in one batch the last ``seq`` counts; a null digest means that the source left.
        """
        last = df.groupBy("source_id").agg(F.max_by("digest", "seq").alias("digest"), F.max("seq").alias("seq"))
        known = self._newest(batch_id)
        changed = last
        if known is not None:
            old = known.select("source_id", F.col("digest").alias("_was"), F.col("index_version").alias("_version")).distinct()
            changed = last.join(old, "source_id", "left").where(~(F.col("_was").eqNullSafe(F.col("digest")) & F.col("_version").eqNullSafe(F.lit(self.index_version)))).drop("_was", "_version")
        texts = df.join(changed.select("source_id", "seq", "digest"), ["source_id", "seq", "digest"])
        cut = chunk_text(texts.select("source_id", "digest", "message_id", "text")).select("source_id", "digest", "message_id", F.col("start_char").cast("int").alias("start_char"), F.col("end_char").cast("int").alias("end_char"))
        # a source that left, or has no text, is known by a row without a chunk
        bare = changed.join(cut.select("source_id").distinct(), "source_id", "left_anti").select("source_id", "digest", F.lit(None).cast("string").alias("message_id"), F.lit(None).cast("int").alias("start_char"), F.lit(None).cast("int").alias("end_char"))
        cut.unionByName(bare).withColumn("index_version", F.lit(self.index_version)).write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}")


def index_batches(read: Callable[[], tuple[DataFrame, DataFrame]], write: Callable[[DataFrame], None], index_version: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over changed texts (source_id, digest, message_id, text) and a table of one's own: recuts the chunks of the sources in the batch. See ``VersionedChunks`` for a table that batches add to."""

    def batch(df: DataFrame, _: int) -> None:
        chunks, versions = read()
        sources = df.select("source_id", "digest").distinct()
        others = chunks.join(sources.select("source_id"), "source_id", "left_anti")
        own = versions.join(sources.select("source_id"), "source_id", "left_semi")
        redone = refresh_index(chunks.join(sources.select("source_id"), "source_id", "left_semi"), own, sources, df.select("source_id", "message_id", "text"), index_version)
        write(others.select(*redone.columns).unionByName(redone))

    return batch


def run_to_end(stream: DataFrame, path: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over all that its source has, then stops; the rows of all its batches, or of the last one in the complete mode.

    Batches are written by their ids below ``path``, so one that runs again after a failure replaces itself. With the same ``path`` and new
    input it goes on where it stopped.
    """
    spark = stream.sparkSession

    def batch(df: DataFrame, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")

    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", checkpoint or f"{path}/state").foreachBatch(batch).start().awaitTermination()
    batches = sorted((f for f in _folders(spark, f"{path}/rows") if f.startswith("batch=")), key=lambda f: int(f[6:]))
    if not batches:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(*(f"{path}/rows/{f}" for f in (batches[-1:] if mode == "complete" else batches)))


def scope_bursts(events: DataFrame, gap: str = "2 seconds", time: str = "ts", horizon: str = "1 minute") -> DataFrame:
    """(owner, scope, started, ended, arrivals): arrivals of a scope with no quiet time of ``gap`` between them count as one."""
    rows = events.withWatermark(time, horizon) if events.isStreaming else events
    out = rows.groupBy("owner", "scope", F.session_window(time, gap).alias("w")).agg(F.count("*").alias("arrivals"))
    return out.select("owner", "scope", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "arrivals")


def running_ledger(attempts: DataFrame) -> DataFrame:
    """Charges so far of each owner and scope; in a stream for the update or complete mode."""
    return attempts.groupBy("owner", "scope").agg(F.count("*").alias("attempts"), F.sum(charge()).alias("charged"))


def activity(events: DataFrame, width: str = "1 day", slide: str | None = None, time: str = "ts", horizon: str = "1 hour") -> DataFrame:
    """(operation, started, n) per window of event time, tumbling or sliding; later than the horizon is late."""
    rows = events.withWatermark(time, horizon) if events.isStreaming else events
    out = rows.groupBy("operation", F.window(time, width, slide).alias("w")).agg(F.count("*").alias("n"))
    return out.select("operation", F.col("w.start").alias("started"), "n")


class Reviews(StatefulProcessor):
    """Per record: accepts a review that names the current revision and moves on, else refuses it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.revision = handle.getValueState("revision", "revision int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        every = pd.concat(list(rows)).sort_values(["created", "review_id"])
        current = self.revision.get()[0] if self.revision.exists() else 0
        out = []
        for review_id, seen in zip(every["review_id"], every["revision"], strict=True):
            ok = int(seen) == current
            current += ok
            out.append((key[0], review_id, bool(ok), current))
        self.revision.update((current,))
        yield pd.DataFrame(out, columns=["record_id", "review_id", "accepted", "revision"])

    def close(self) -> None:
        pass


REVIEWED = "record_id string, review_id string, accepted boolean, revision int"


def stream_reviews(reviews: DataFrame) -> DataFrame:
    """(record_id, review_id, accepted, revision) of a stream of reviews (record_id, review_id, revision, created)."""
    return reviews.groupBy("record_id").transformWithStateInPandas(Reviews(), REVIEWED, "append", "none")


def batch_reviews(reviews: DataFrame) -> DataFrame:
    """The same on a finite table: a fold over each record's own reviews in order."""
    rows = F.array_sort(F.collect_list(F.struct("created", "review_id", F.col("revision").cast("int").alias("revision"))))
    zero = F.struct(F.lit(0).alias("cur"), F.array().cast("array<struct<review_id:string,accepted:boolean,revision:int>>").alias("out"))

    def step(acc, x):
        ok = x["revision"] == acc["cur"]
        cur = acc["cur"] + F.when(ok, 1).otherwise(0)
        return F.struct(cur.cast("int").alias("cur"), F.concat(acc["out"], F.array(F.struct(x["review_id"].alias("review_id"), ok.alias("accepted"), cur.cast("int").alias("revision")))).alias("out"))

    grouped = reviews.groupBy("record_id").agg(rows.alias("rows"))
    return grouped.select("record_id", F.explode(F.aggregate("rows", zero, step, lambda a: a["out"])).alias("x")).select("record_id", "x.*")
