"""Streams that are started, stopped and started again give what the finite form gives; late rows are left out, replayed batches change nothing."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from attestry.functions.spans import chunk_text
from attestry.streaming import jobs as ST

BEGIN = dt.datetime(2024, 1, 1)
EVENTS = "owner string, scope string, source_key string, operation string, ts timestamp"


def files(spark, tmp_path, batches, schema, name="in"):
    """Writes batches as files one by one; returns a function that adds file i, and the stream over them, one file a batch."""
    folder = f"{tmp_path}/{name}"

    def add(i):
        spark.createDataFrame(batches[i], schema).coalesce(1).write.mode("append").parquet(folder)

    add(0)
    return add, lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def events(r, n, minute, spread):
    """n arrivals around a minute, out of order within ``spread`` seconds."""
    return [("o", r.choice("ab"), f"k{r.randint(0, 30)}", r.choice("xy"), BEGIN + dt.timedelta(minutes=minute, seconds=r.randint(0, spread))) for _ in range(n)]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def flush(minute=10_000):
    return [("o", "end", "end", "end", BEGIN + dt.timedelta(minutes=minute))]


@pytest.mark.parametrize("kind", ["bursts", "tumbling", "sliding"])
def test_windows_over_restarts_and_late_rows(spark, tmp_path, kind):
    """Five batches, stopped after two; disorder within the horizon merges into sessions across batches, a late row counts nowhere."""
    form = {
        "bursts": lambda e: ST.scope_bursts(e, "40 seconds", horizon="5 minutes"),
        "tumbling": lambda e: ST.activity(e, "1 minute", horizon="5 minutes"),
        "sliding": lambda e: ST.activity(e, "2 minutes", "1 minute", horizon="5 minutes"),
    }[kind]
    r = random.Random(kind)
    late = [("o", "a", "late", "x", BEGIN)]
    batches = [events(r, 40, 0, 240), events(r, 40, 2, 240), [*events(r, 30, 60, 200), *events(r, 5, 4, 30)], [*late, *events(r, 20, 61, 100)], flush()]
    add, stream = files(spark, tmp_path, batches, EVENTS)
    add(1)
    ST.run_to_end(form(stream()), f"{tmp_path}/out")
    for i in (2, 3, 4):
        add(i)
        got = ST.run_to_end(form(stream()), f"{tmp_path}/out")
    # rows of batch 2 that are before its own newest row are not late: a watermark moves between batches
    counted = [e for b in batches[:4] for e in b if e not in late]
    want = form(spark.createDataFrame(counted, EVENTS))
    assert [x for x in rows_of(got) if "end" not in x] == rows_of(want)


def test_arrivals_within_the_horizon_once(spark, tmp_path):
    r = random.Random(3)
    batches = [events(r, 60, m, 100) for m in (0, 1, 2)]
    batches[2] += batches[0][:20]
    add, stream = files(spark, tmp_path, batches, EVENTS)
    key = ["owner", "scope", "source_key"]
    for i in (1, 2):
        add(i)
        got = ST.run_to_end(ST.stream_sources(stream().withColumn("digest", F.lit("d"))), f"{tmp_path}/out")
    want = ST.stream_sources(spark.createDataFrame([e for b in batches for e in b], EVENTS).withColumn("digest", F.lit("d")))
    assert rows_of(got.select(*key)) == rows_of(want.select(*key))


TEXTS = "source_id string, digest string, message_id string, text string, seq long"


def test_versioned_chunks(spark, tmp_path):
    """Changed, unchanged, emptied and leaving sources; every batch is run twice, and earlier versions stay readable."""
    long = "word " * 500
    batches = [
        [("a", "1", "m1", long, 1), ("a", "1", "m2", "short", 1), ("b", "1", "m1", "bee", 1)],
        [("a", "1", "m1", "the digest says nothing changed", 2), ("c", "1", "m1", "see", 2)],
        [("a", "2", "m1", long + "more", 3), ("a", "3", "m1", "last of this batch", 4), ("b", None, None, None, 3)],
        [("c", "2", "m1", "  ", 5), ("b", "9", "m1", "bee is back", 5)],
    ]
    table = ST.VersionedChunks(spark, f"{tmp_path}/chunks", "v1")
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, TEXTS)
        table.batch(df, i)
        table.batch(df, i)
    live = [
        [("a", "1", "m1", long), ("a", "1", "m2", "short"), ("b", "1", "m1", "bee")],
        [("a", "1", "m1", long), ("a", "1", "m2", "short"), ("b", "1", "m1", "bee"), ("c", "1", "m1", "see")],
        [("a", "3", "m1", "last of this batch"), ("c", "1", "m1", "see")],
        [("a", "3", "m1", "last of this batch"), ("b", "9", "m1", "bee is back")],
    ]
    for i, rows in enumerate(live):
        want = chunk_text(spark.createDataFrame(rows, "source_id string, digest string, message_id string, text string")).drop("chunk")
        assert rows_of(table.chunks(before=i + 1)) == rows_of(want.select("source_id", "digest", "message_id", "start_char", "end_char"))
    # what did not change was not written again
    assert spark.read.parquet(f"{tmp_path}/chunks/batch=1").select("source_id").distinct().count() == 1
    # a new version of the index cuts all that come by again
    ST.VersionedChunks(spark, f"{tmp_path}/chunks", "v2").batch(spark.createDataFrame(live[3][:1], TEXTS.rsplit(",", 1)[0]).withColumn("seq", F.lit(9)), 4)
    assert [r.source_id for r in spark.read.parquet(f"{tmp_path}/chunks/batch=4").collect()] == ["a"]
    assert table.chunks(before=0).count() == 0


def test_versioned_chunks_as_a_stream(spark, tmp_path):
    r = random.Random(5)
    seq, batches, last = 0, [], {}
    for _ in range(4):
        rows = []
        for s in r.sample("abcdefgh", 4):
            seq += 1
            text = "x" * r.randint(1, 3000)
            rows.append((s, str(seq), "m", text, seq))
            last[s] = rows[-1][:4]
        batches.append(rows)
    add, stream = files(spark, tmp_path, batches, TEXTS)
    table = ST.VersionedChunks(spark, f"{tmp_path}/chunks", "v1")
    for i in range(1, 4):
        add(i)
        stream().writeStream.foreachBatch(table.batch).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").start().awaitTermination()
    want = chunk_text(spark.createDataFrame(list(last.values()), "source_id string, digest string, message_id string, text string"))
    assert rows_of(table.chunks()) == rows_of(want.select("source_id", "digest", "message_id", "start_char", "end_char"))
