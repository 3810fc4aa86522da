"""Shuffles as packed columns: what is packed comes back, and best labels shuffle few bytes a row."""

import random
from decimal import Decimal

import pyarrow as pa
import pytest

import __spark_entry__ as entry
from tests.test_shuffled_rows import HOUR, checked
from tracewright.operators import correlate as C
from tracewright.operators import packed


def test_packs_hold_what_was_packed():
    rng = random.Random(3)
    far = [0, -1, 1, 2**63 - 1, -(2**63), 2**40]
    some = lambda made: [None if rng.random() < 0.2 else made() for _ in range(500)]
    columns = {
        "a": pa.array(some(lambda: rng.choice(far)), pa.int64()), "b": pa.array(range(500), pa.int32()), "c": pa.array(some(lambda: rng.choice(["", "a,%", "é" * 50, "\0"])), pa.string()),
        "d": pa.array(some(lambda: rng.randbytes(rng.randrange(4))), pa.binary()), "e": pa.array(some(lambda: [rng.choice(far) for _ in range(rng.randrange(4))]), pa.list_(pa.int64())),
        "f": pa.array(some(lambda: rng.choices([None, 5, *far], k=rng.randrange(4))), pa.list_(pa.int64())), "g": pa.array(some(lambda: rng.choices([None, b"", b"xy"], k=rng.randrange(3))), pa.list_(pa.binary())),
        "h": pa.array(some(lambda: Decimal(rng.randrange(99))), pa.decimal128(9, 2)), "i": pa.nulls(500, pa.string()), "j": pa.nulls(500, pa.list_(pa.int64())), "k": pa.array([[]] * 500, pa.list_(pa.int64())),
    }
    rows = pa.RecordBatch.from_pydict(columns)
    for part in (rows, rows.slice(7, 1), rows.slice(100, 333), rows.slice(0, 0)):
        assert packed.unpack(packed.pack(part), rows.schema).to_pylist() == part.to_pylist()


def test_shuffled_rows_meet_and_are_sorted(spark, monkeypatch):
    monkeypatch.setattr(packed, "_HELD", 1000)
    left = spark.range(3000).selectExpr("id % 41 - 20 k", "id v", "cast(id as string) t").repartition(5)
    right = spark.range(3000).selectExpr("id % 43 - 20 k", "id v")
    both = packed.shuffled([(left, None), (right, None)], "k bigint, v bigint, t string", "k", ["k", "v"], ["v"])
    parts = [[tuple(r) for r in p] for p in both.rdd.glom().collect()]
    assert sorted(r for p in parts for r in p if r[2]) == sorted((i % 41 - 20, i, str(i)) for i in range(3000))
    assert sorted(r[:2] for p in parts for r in p if not r[2]) == sorted((i % 43 - 20, i) for i in range(3000))
    keys = [{r[0] for r in p} for p in parts]
    assert sum(map(len, keys)) == len(set().union(*keys)) and all([r[:2] for r in p] == sorted(r[:2] for r in p) for p in parts)


def brute(events, units, nets, window, prefix):
    """The best unit of each event as the docstring of ``best_labels`` has it, by (event, label)."""
    import math

    found = {}
    for event, at, *sides in events:
        for label, by, apps, payload, own in units:
            apps = [a for a in apps if a is not None]
            if label is None or at is None or not apps or not min(apps) - window <= at <= max(apps) + window:
                continue
            mine = [(t, v) for b, t, v in nets if b == by and b is not None]
            total = len(own) + len({v for _, v in mine})
            values = [v for v in own if v is not None] + list({v for _, v in mine if v is not None})
            b = [max(values.count(x), int(bool(payload and x.removeprefix(prefix)) and x.removeprefix(prefix) in payload)) if x is not None else 0 for x in sides]
            hits = sum(x > 0 for x in b)
            if hits and total:
                near = min(abs(at - t) for t in apps + [t for t, _ in mine if t is not None])
                s1, s2 = math.log1p(1 / (near / 1000 + 1e-9)), hits / 2 * math.exp(sum(b) / total)
                found.setdefault(event, []).append((-(s1 + s2), label, s1, s2))
    return {event: min(x)[1:] for event, x in found.items()}


def test_best_labels_of_odd_rows(spark):
    rng = random.Random(8)
    text = lambda: rng.choice([None, "", "a", "a,b", "%2C", ",", "%", "/p/a", "/p/", "é", "b"])
    owner = lambda: rng.choice([None, "x", "y,", "z"])
    time = lambda: rng.choice([None, *(rng.randrange(-3000, 3000) for _ in range(9))])
    events = [(i, time(), text(), text()) for i in range(200)]
    units = [(rng.choice([None, *[f"u{i}"] * 9]), owner(), [time() for _ in range(rng.randrange(4))], text(), [text() for _ in range(rng.randrange(3))]) for i in range(60)]
    nets = [(owner(), time(), text()) for _ in range(80)]
    got = C.best_labels(
        spark.createDataFrame(events, "event_id bigint, at bigint, subject string, object string").repartition(3), spark.createDataFrame(units, "label string, by string, app_at array<bigint>, payload string, own array<string>"),
        spark.createDataFrame(nets, "by string, at bigint, v string"), 50, "/p/", by="by",
    ).collect()
    want = brute(events, units, nets, 50, "/p/")
    assert {r.event_id: r.label for r in got} == {e: x[0] for e, x in want.items()} and len(want) > 50
    assert all((r.s1, r.s2) == pytest.approx(want[r.event_id][1:]) for r in got)


def spread(n):
    """Clicks, purchases and views of many users over a month, each user with a dozen views."""
    rng = random.Random(5)
    kinds = ["click", "purchase", "view", "view"]
    return [(i, rng.randrange(720 * HOUR), rng.randrange(n // 48), kinds[i % 4], rng.random() * 100, rng.randrange(100)) for i in range(n)]


@pytest.mark.parametrize("query", ["best_label_one_app", "best_label_two_apps"])
def test_best_labels_shuffle_few_bytes(spark, tmp_path, query):
    rows = spread(24_000)
    checked(spark, tmp_path, query, rows)
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    entry.queries()[query](spark, str(tmp_path)).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    print(query, (written() - before) / len(rows))
    assert (written() - before) / len(rows) < 30
