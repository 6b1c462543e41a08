"""The stream's guards against the same rules on the finished sequence."""

import pytest

from lumenvault.operators import sequences
from lumenvault.plans import frames
from lumenvault.streaming import guards

SF = "/root/testdata/sf0.001"


def streamed(spark, tmp_path, df, make, mode):
    """The rows that an operator gives out over df as a stream."""
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    # State that can time out asks for batches without data for ever, which availableNow would wait for.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    query = make(stream).writeStream.format("memory").queryName(f"q{abs(hash(str(tmp_path)))}").outputMode(mode).option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.table(query.name)


@pytest.fixture(scope="module")
def calls(spark):
    from pyspark.sql import functions as F

    return frames.calls_made(spark, SF).select("thread", "seq", F.concat("name", F.lit(":"), F.col("arg") % 3).alias("hash"))


def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))


def test_loop_guard(spark, tmp_path, calls):
    assert same(streamed(spark, tmp_path, calls, guards.loop_guard, "append"), sequences.loop_guard(calls))


def test_turn_guard(spark, tmp_path, calls):
    assert same(streamed(spark, tmp_path, calls, lambda s: guards.turn_guard(s, 5), "append"), sequences.turn_guard(calls, 5))


def test_token_guard(spark, tmp_path):
    from pyspark.sql import functions as F

    usage = frames.calls_made(spark, SF).select(F.col("thread").alias("run"), (F.col("arg") % 4).cast("string").alias("message"), "seq", F.floor("value").cast("long").alias("tokens"))
    assert same(streamed(spark, tmp_path, usage, lambda s: guards.token_guard(s, 300), "append"), sequences.token_guard(usage, 300).select("run", "seq", "total", "action"))


def ledger_rows(spark, rows):
    return spark.createDataFrame(rows, "run long, seq long, id string, status string, at long")


def test_ledger_keeps_terminal_statuses(spark, tmp_path):
    entries = ledger_rows(spark, [(1, 1, "a", "running", 10), (1, 2, "a", "done", 20), (1, 3, "a", "running", 30), (1, 4, "b", "running", 40)])
    found = {(r.id, r.status, r.created_at) for r in streamed(spark, tmp_path, entries, guards.ledger, "update").collect()}
    assert found == {("a", "done", 10), ("b", "running", 40)}


def test_trimmed_ids_stay_trimmed(spark):
    entries = ledger_rows(spark, [(1, 1, "a", "done", 1), (1, 2, "b", "running", 2), (1, 3, "c", "running", 3), (1, 4, "a", "running", 4), (1, 5, "b", "done", 5)])
    assert [(r.id, r.status, r.place) for r in guards.ledger(entries, most=2).orderBy("place").collect()] == [("b", "done", 1), ("c", "running", 2)]
    assert same(guards.ledger(entries, most=2), sequences.ledger(entries, most=2))


def test_bounded_state_drops_what_came_first(spark):
    rows = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "b", "x"), (1, 3, "a", "y"), (1, 4, "c", "x"), (1, 5, "a", "z")], "space long, seq long, key string, value string")
    assert [(r.key, r.value) for r in guards.bounded_latest(rows, 2).orderBy("place").collect()] == [("c", "x"), ("a", "z")]


def test_state_survives_a_restart(spark, tmp_path):
    """A query that is stopped and started again on its checkpoint goes on with its state."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    schema = "thread long, seq long, hash string"
    totals = []
    for batch in (((1, 1, "h"), (1, 2, "h")), ((1, 3, "h"), (1, 4, "h"), (1, 5, "h"))):
        spark.createDataFrame(list(batch), schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = guards.loop_guard(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        totals.append(sorted((r.seq, r.times, r.action) for r in spark.read.parquet(f"{tmp_path}/out").collect()))
    assert totals[0] == [(1, 1, "go"), (2, 2, "go")]
    assert totals[1] == [(1, 1, "go"), (2, 2, "go"), (3, 3, "warn"), (4, 4, "go"), (5, 5, "stop")]


def test_events_and_windows(spark, tmp_path):
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.txt").write_text('{"type": "text", "part": {"messageID": "m", "text": "x"}}\nnot json\n{"type": "step_finish", "part": {"tokens": {"input": 3, "output": 4}}}\n')
    decoded = guards.decode_events(spark.read.text(str(tmp_path / "lines"))).collect()
    assert [(r.type, r.message, r.tokens and r.tokens.output) for r in decoded] == [("text", "m", None), ("step_finish", None, 4)]
    events = spark.read.parquet(f"{SF}/events.parquet").select("ts", "event_type")
    events.coalesce(1).write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    query = guards.tumbling_counts(stream).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("windows").groupBy().sum("n").first()[0] == events.count()


def test_more_messages_than_a_batch_holds(spark, tmp_path):
    """12,000 messages of a run, each told again after a restart: none counts twice."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    schema = "run long, seq long, message string, tokens long"
    for batch in range(2):
        spark.range(12_000).selectExpr("1L as run", f"id + {batch * 12_000} as seq", "cast(id as string) as message", f"10L + {batch} * (id % 2) as tokens").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = guards.token_guard(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination(300)
        assert query.exception() is None
    totals = {r.seq: r.total for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(totals) == 24_000 and totals[11_999] == 120_000 and totals[23_999] == 126_000


def test_ledger_and_bounded_state_over_batches(spark, tmp_path):
    """What goes when there is no room, and trimmed ids that come back, in a stream that is stopped between its batches."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    rows = [(1, k, str(k % 7), ["running", "done", "failed"][k % 3], k * 10) for k in range(30)]
    for cut, (name, make, schema, pick) in enumerate((
        ("ledger", lambda s: guards.ledger(s, most=3), "run long, seq long, id string, status string, at long", lambda r: r),
        ("bounded", lambda s: guards.bounded_latest(s, 3), "space long, seq long, key string, value string", lambda r: r[:3] + (r[3] + str(r[1]),)),
    )):
        data = [pick(r) for r in rows]
        for part in (data[: 11 + cut], data[11 + cut :]):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}/in")
            stream = make(spark.readStream.schema(schema).parquet(f"{tmp_path}/{name}/in"))
            found: list = []
            query = stream.writeStream.foreachBatch(lambda df, n, found=found: found.append(sorted(map(tuple, df.collect())))).option("checkpointLocation", f"{tmp_path}/{name}/c").outputMode("update").trigger(availableNow=True).start()
            query.awaitTermination(120)
            assert query.exception() is None
        assert [f for f in found if f][-1] == sorted(map(tuple, make(spark.createDataFrame(data, schema)).collect()))
