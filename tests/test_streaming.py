import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from tracewright.streaming import windows as W

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def run(stream, path, mode="append"):
    name = f"out_{abs(hash(str(path)))}"
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    )
    query.awaitTermination(90)
    assert query.exception() is None
    return stream.sparkSession.table(name)


def test_stream_join_equals_batch(spark, tmp_path):
    rng = random.Random(1)
    nets = [(k, rng.choice("ab"), T0 + timedelta(seconds=rng.randint(0, 300))) for k in range(100)]
    apps = [(k, rng.choice("ab"), T0 + timedelta(seconds=rng.randint(0, 300))) for k in range(60)]
    a = spark.createDataFrame(nets, "net_id bigint, host string, net_at timestamp")
    b = spark.createDataFrame(apps, "app_id bigint, host string, app_at timestamp")
    a.coalesce(1).write.parquet(str(tmp_path / "n"))
    b.coalesce(1).write.parquet(str(tmp_path / "a"))
    sn, sa = (spark.readStream.schema(x.schema).parquet(str(tmp_path / p)) for x, p in ((a, "n"), (b, "a")))
    batch = W.correlate_streams(a, b, ["host"], "net_at", "app_at").select("net_id", "app_id")
    stream = run(W.correlate_streams(sn, sa, ["host"], "net_at", "app_at").select("net_id", "app_id"), tmp_path / "c1")
    expected = {(n, p) for n, h, t in nets for p, g, u in apps if h == g and abs((t - u).total_seconds()) <= 5}
    assert set(map(tuple, batch.collect())) == expected == set(map(tuple, stream.collect()))


def test_events_are_assembled_after_the_watermark(spark, tmp_path):
    rows = [(k // 3, T0 + timedelta(seconds=k), f"line {k}") for k in range(30)] + [(99, T0 + timedelta(hours=1), "last")]
    frame = spark.createDataFrame(rows, "event_id bigint, at timestamp, line string")
    for k, part in enumerate((rows[:30], rows[30:])):
        spark.createDataFrame(part, frame.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "l"))
        assert k < 2
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "l"))
    out = run(W.assemble_stream(stream, "event_id", "at", "line"), tmp_path / "c2")
    got = {r.event_id: r.lines for r in out.collect()}
    assert got == {k: [f"line {3 * k + i}" for i in range(3)] for k in range(10)}


def test_lines_of_an_event_are_ordered_across_batches(spark, tmp_path):
    late = [(1, T0 + timedelta(seconds=1), "first"), (1, T0 + timedelta(seconds=3), "third")]
    for part in ([(1, T0 + timedelta(seconds=2), "second")], late, [(9, T0 + timedelta(hours=1), "last")]):
        spark.createDataFrame(part, "event_id bigint, at timestamp, line string").coalesce(1).write.mode("append").parquet(str(tmp_path / "o"))
    stream = spark.readStream.schema("event_id bigint, at timestamp, line string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "o"))
    out = run(W.assemble_stream(stream, "event_id", "at", "line", "1 minute"), tmp_path / "c4")
    assert {r.event_id: r.lines for r in out.collect()} == {1: ["first", "second", "third"]}


def test_batches_of_a_size(spark, tmp_path):
    spark.range(25).coalesce(1).write.parquet(str(tmp_path / "b"))
    seen = {}
    query = W.in_batches(
        spark.readStream.schema("id bigint").parquet(str(tmp_path / "b")), 10, lambda df, n: seen.__setitem__(n, [r.id for r in df.orderBy("id").collect()]), ["id"], str(tmp_path / "c5")
    )
    query.processAllAvailable()
    query.stop()
    assert [seen[k] for k in sorted(seen)] == [list(range(10)), list(range(10, 20)), list(range(20, 25))]


def test_cluster_stream_keeps_state(spark, tmp_path):
    rng = random.Random(2)
    rows = [(0, k, [rng.gauss(c, 0.05), rng.gauss(c, 0.05)]) for k, c in enumerate([0, 5] * 40)]
    frame = spark.createDataFrame(rows, "g int, k bigint, vec array<double>")
    frame.repartition(2).write.parquet(str(tmp_path / "v"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "v"))
    out = run(W.cluster_stream(stream, "g", "k", 1.0, 0.5, 3.0, 0.001), tmp_path / "c3", "update")
    last = out.orderBy(F.desc("seen")).first()
    assert last.seen == 80 and last.clusters == 2


def test_session_groups(spark):
    rows = spark.createDataFrame([("a", T0 + timedelta(seconds=s)) for s in (0, 3, 20, 21)], "k string, at timestamp")
    assert sorted(r.n for r in W.session_groups(rows, ["k"], "at", "5 seconds").collect()) == [2, 2]
