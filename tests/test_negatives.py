import random

from pyspark.sql import functions as F

from tracewright.operators import triples as T


def random_facts(seed):
    rng = random.Random(seed)
    facts = {(rng.randrange(12), rng.choice("rs"), rng.randrange(15)) for _ in range(150)}
    tails = {r: sorted({t for _, q, t in facts if q == r}) for r in "rs"}
    # One head knows all tails, one all but one.
    return sorted(facts | {(20, "r", t) for t in tails["r"]} | {(21, "r", t) for t in tails["r"][:-1]})


def test_constrained_tails_gives_every_draw(spark):
    facts = random_facts(1)
    expected = []
    for h, r, t in facts:
        tails = sorted({x for _, q, x in facts if q == r})
        k = tails.index(t)
        unknown = [x for x in tails[k:] + tails[:k] if (h, r, x) not in facts]
        expected += [(h, r, t, draw, unknown[(draw - 1) % len(unknown)]) for draw in (1, 2, 3) if unknown]
    got = T.constrained_tails(spark.createDataFrame(facts * 2, "h bigint, r string, t bigint"), 3).collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_corrupt_gives_every_draw_a_false_fact(spark):
    rng = random.Random(2)
    n, tries = 12, 2
    # Dense, so that tries are mostly known; head 3 knows every tail.
    facts = sorted({(rng.randrange(n), "r", rng.randrange(n)) for _ in range(400)} - {(0, "r", 0)} | {(3, "r", t) for t in range(n)})
    entities = spark.createDataFrame([(k, k) for k in range(n)], "id bigint, index bigint")
    pick = F.pmod(F.col("h") * 5 + F.col("t") * 3 + F.col("draw") + F.col("try"), F.lit(n))
    got = T.corrupt(spark.createDataFrame(facts, "h bigint, r string, t bigint"), entities, 2, pick, tries).collect()
    expected = []
    for h, r, t in facts:
        for draw in (1, 2):
            made = [(e, r, t) if draw % 2 == 0 else (h, r, e) for e in range(n)]
            order = [(h * 5 + t * 3 + draw + k) % n for k in range(tries)]
            order += [(order[-1] + k) % n for k in range(n)]
            false = [made[e] for e in order if made[e] not in facts]
            expected += [(h, r, t, draw, false[0][0], false[0][2])] if false else []
    assert sorted(map(tuple, got)) == sorted(expected)
    assert not any(row.h == 3 and row.draw == 1 for row in got)


def test_negatives_come_from_all_entities(spark, tmp_path):
    from tracewright.plans import catalogue

    rows = [(k, f"2024-01-01 00:00:{k % 60:02d}", 500 + k % 150, "view", 1.0, '{"k": %d}' % (1000 + k % 7)) for k in range(600)]
    events = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double, props string")
    events.selectExpr("* except (ts)", "cast(ts as timestamp) as ts").write.parquet(str(tmp_path / "events.parquet"))
    got = catalogue.negatives_filtered(spark, str(tmp_path)).collect()
    entities = {500 + k for k in range(150)} | {1000 + k for k in range(7)}
    facts = {(r[2], 1000 + r[0] % 7) for r in rows}
    assert len(got) == 2 * len(facts) and not any((r.nh, r.nt) in facts for r in got)
    drawn = {r.nh for r in got if r.draw == 2} | {r.nt for r in got if r.draw == 1}
    assert drawn <= entities and len(drawn) > 100
