"""Triples of a behaviour graph: dictionaries, weights, cardinalities, snapshots, corrupted facts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.ordering import global_numbers


def edge_view(events: DataFrame) -> DataFrame:
    """Events as edges: src = user, rel = type, dst = the number k of the properties."""
    dst = F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("bigint")
    return events.select("event_id", "ts", F.col("user_id").alias("src"), F.col("event_type").alias("rel"), dst.alias("dst"), "value")


def first_seen_ids(rows: DataFrame, name: str, seq: str, out: str = "id") -> DataFrame:
    """Names numbered from 0 in the order in which they are first seen."""
    first = rows.filter(F.col(name).isNotNull()).groupBy(name).agg(F.min(seq).alias("__first"))
    return global_numbers(first, ["__first", name], out).drop("__first")


def relation_ids(rows: DataFrame, relation: str, seq: str) -> DataFrame:
    """(name, id): relations take even ids in first-seen order, their inverses the odd ids after them."""
    ids = first_seen_ids(rows, relation, seq)
    plain = ids.select(F.col(relation).alias("name"), (F.col("id") * 2).alias("id"))
    inverse = ids.select(F.concat(F.col(relation), F.lit("_inv")).alias("name"), (F.col("id") * 2 + 1).alias("id"))
    return plain.unionByName(inverse)


def facts_with_ids(facts: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(h, r, t) of (s, r, o) names; ``entities`` and ``relations`` have (name, id)."""
    return (
        facts.join(entities.select(F.col("name").alias("s"), F.col("id").alias("h")), "s")
        .join(relations.select(F.col("name").alias("r"), F.col("id").alias("rid")), "r")
        .join(entities.select(F.col("name").alias("o"), F.col("id").alias("t")), "o")
        .select("h", F.col("rid").alias("r"), "t")
    )


def with_inverse(facts: DataFrame) -> DataFrame:
    """(h, r, t) and (t, r + 1, h)."""
    return facts.select("h", "r", "t").union(facts.select("t", F.col("r") + 1, "h"))


def edge_index(facts: DataFrame, loop_relation: int) -> DataFrame:
    """Both directions of every fact and a loop for every node."""
    both = with_inverse(facts)
    nodes = both.select("h").union(both.select("t")).distinct()
    return both.union(nodes.select("h", F.lit(loop_relation).cast("bigint"), F.col("h").alias("t")))


def term_frequency(triples: DataFrame, graph: str, term: list[str], n_graphs: int | None = None) -> DataFrame:
    """Document frequency of each term, its share of graphs (tf), idf and their product."""
    once = triples.select(graph, *term).distinct()
    df = once.groupBy(*term).agg(F.count(F.lit(1)).alias("df"))
    count = triples.agg(F.count_distinct(graph).alias("n")) if n_graphs is None else triples.sparkSession.range(1).select(F.lit(n_graphs).alias("n"))
    n = count.first()[0] or 0
    tf = F.col("df") / F.lit(n)
    idf = F.log10((F.lit(n) + 1) / (F.col("df") + 1))
    return df.select(*term, "df", tf.alias("tf"), idf.alias("idf"), (tf * idf).alias("tfidf"))


def uniform_weight(triples: DataFrame, term: list[str]) -> DataFrame:
    """Every distinct term with 1 / their number."""
    terms = triples.select(*term).distinct()
    n = terms.count()
    return terms.withColumn("weight", F.lit(1.0 / n if n else None).cast("double"))


def graph_scores(triples: DataFrame, weights: DataFrame, graph: str, term: list[str], weight: str = "tfidf") -> DataFrame:
    """Sum of the weights of a graph's triples, repeated ones counted each time (scalar pooling)."""
    counted = triples.groupBy(graph, *term).agg(F.count(F.lit(1)).alias("__n"))
    return counted.join(weights.select(*term, weight), term).groupBy(graph).agg(F.sum(F.col("__n") * F.col(weight)).alias("score"))


def graph_vectors(triples: DataFrame, vectors: DataFrame, weights: DataFrame, graph: str, term: list[str], weight: str = "tfidf") -> DataFrame:
    """Sum of weight times vector over a graph's triples; element sums, one row an element before the last step."""
    counted = triples.groupBy(graph, *term).agg(F.count(F.lit(1)).alias("__n"))
    joined = counted.join(weights.select(*term, weight), term).join(vectors.select(*term, "vec"), term)
    spread = joined.select(graph, (F.col("__n") * F.col(weight)).alias("__w"), F.posexplode("vec").alias("__i", "__v"))
    summed = spread.groupBy(graph, "__i").agg(F.sum(F.col("__w") * F.col("__v")).alias("__s"))
    return summed.groupBy(graph).agg(F.transform(F.array_sort(F.collect_list(F.struct("__i", "__s"))), lambda x: x["__s"]).alias("vec"))


def relation_cardinality(facts: DataFrame, threshold: float = 1.5) -> DataFrame:
    """Mean tails per (h, r) and heads per (r, t), and the class they make; the threshold counts as N."""
    once = facts.select("h", "r", "t").distinct()
    tails = once.groupBy("r", "h").agg(F.count(F.lit(1)).alias("n")).groupBy("r").agg(F.avg("n").alias("tails_per_head"))
    heads = once.groupBy("r", "t").agg(F.count(F.lit(1)).alias("n")).groupBy("r").agg(F.avg("n").alias("heads_per_tail"))
    side = lambda c: F.when(F.col(c) < threshold, "1").otherwise("N")
    kind = F.concat(side("heads_per_tail"), F.lit("-"), side("tails_per_head"))
    return tails.join(heads, "r").withColumn("kind", kind)


def type_constraints(facts: DataFrame) -> DataFrame:
    """Distinct heads and tails that each relation was seen with."""
    heads = facts.select("r", F.lit("head").alias("side"), F.col("h").alias("entity"))
    tails = facts.select("r", F.lit("tail").alias("side"), F.col("t").alias("entity"))
    return heads.union(tails).distinct()


def bernoulli_stats(facts: DataFrame) -> DataFrame:
    """Facts per distinct head and per distinct tail of each relation, for side-weighted corruption."""
    once = facts.select("h", "r", "t").distinct()
    n = F.count(F.lit(1))
    return once.groupBy("r").agg(
        n.alias("freq"), (n / F.count_distinct("h")).alias("left_mean"), (n / F.count_distinct("t")).alias("right_mean")
    )


def entity_frequency(facts: DataFrame) -> DataFrame:
    """How often each entity ends a fact."""
    ends = facts.select(F.col("h").alias("entity")).union(facts.select(F.col("t").alias("entity")))
    return ends.groupBy("entity").agg(F.count(F.lit(1)).alias("freq"))


def golden_answers(facts: DataFrame) -> DataFrame:
    """(h, r, answers): the tails known for each query, inverse queries included."""
    return with_inverse(facts).groupBy("h", "r").agg(F.array_sort(F.collect_set("t")).alias("answers"))


def golden_batches(facts: DataFrame, size: int) -> DataFrame:
    """(batch, h, r, answers) of the queries in order of (h, r), inverse ones included: ``answers`` are the places of a mask that are 1."""
    numbered = global_numbers(golden_answers(facts), ["h", "r"], "__n")
    return numbered.withColumn("batch", F.floor(F.col("__n") / size)).drop("__n")


def snapshot_growth(facts: DataFrame, snapshot: str = "snapshot") -> DataFrame:
    """Per snapshot: new and cumulative entities and relations, and facts so far."""
    ends = facts.select(snapshot, F.col("h").alias("x")).union(facts.select(snapshot, F.col("t").alias("x")))
    new_e = ends.groupBy("x").agg(F.min(snapshot).alias(snapshot)).groupBy(snapshot).agg(F.count(F.lit(1)).alias("new_entities"))
    new_r = facts.groupBy("r").agg(F.min(snapshot).alias(snapshot)).groupBy(snapshot).agg(F.count(F.lit(1)).alias("new_relations"))
    own = facts.groupBy(snapshot).agg(F.count(F.lit(1)).alias("facts"), F.count_distinct("r").alias("relations"))
    joined = own.join(new_e, snapshot, "left").join(new_r, snapshot, "left").na.fill(0)
    # One row a snapshot; a single window is small by construction.
    so_far = Window.orderBy(snapshot).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumns(
        {c: F.sum(d).over(so_far) for c, d in (("num_ent", "new_entities"), ("num_rel", "new_relations"), ("facts_so_far", "facts"))}
    )


def frontier_snapshots(facts: DataFrame, size: int, steps: int = 4, seed: int = 7) -> DataFrame:
    """(h, r, t, snapshot): a seeded sample, then growth along its frontier, then the rest.

    Each step takes facts that touch entities already seen, the ``size`` of lowest hash; the driver
    runs ``steps`` rounds and holds no facts.
    """
    from tracewright.session import durable

    left = durable(facts.select("h", "r", "t").distinct().withColumn("__x", F.xxhash64("h", "r", "t", F.lit(seed))))
    taken = durable(left.orderBy("__x", "h", "r", "t").limit(size).withColumn("snapshot", F.lit(0)))
    for step in range(1, steps):
        left = durable(left.join(taken.select("h", "r", "t"), ["h", "r", "t"], "left_anti"))
        seen = taken.select(F.col("h").alias("e")).union(taken.select(F.col("t").alias("e"))).distinct()
        touching = left.join(seen, left.h == seen.e, "left_semi").union(left.join(seen, left.t == seen.e, "left_semi")).distinct()
        taken = durable(taken.union(touching.orderBy("__x", "h", "r", "t").limit(size).withColumn("snapshot", F.lit(step))))
    rest = left.join(taken.select("h", "r", "t"), ["h", "r", "t"], "left_anti").withColumn("snapshot", F.lit(steps))
    return taken.union(rest).drop("__x")


def _marks_up_to(asks: DataFrame, marks: DataFrame, keys: list[str], strict: bool = False) -> DataFrame:
    """``asks`` with ``n_marks``: how many ``marks`` of the same keys have an ``at`` up to (``strict``: before) the row's own."""
    both = asks.withColumn("__k", F.lit(1)).unionByName(marks.select(*keys, "at").withColumn("__k", F.lit(2 if strict else 0)), True)
    order = Window.partitionBy(*keys).orderBy("at", "__k").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("n_marks", F.sum((F.col("__k") != 1).cast("bigint")).over(order)).filter("__k = 1").drop("__k")


def corrupt(
    facts: DataFrame, entities: DataFrame, ratio: int, pick: Column | None = None, tries: int = 4,
    known: DataFrame | None = None, shares: DataFrame | None = None, u: Column | None = None,
) -> DataFrame:
    """Filtered corruption: ``ratio`` false facts a fact, head or tail replaced, none of them known.

    Even draws replace the head, odd ones the tail; with ``shares`` (r, share) the head is replaced where
    ``u`` (by default a hash of fact and draw) is below the relation's share. ``known`` holds the known
    facts, by default the facts themselves.

    ``entities`` has dense (id, index from 0). Candidates come from a hash of (fact, draw, try); the
    first try that is no known fact is kept. Where all tries are known, the next entity in index order
    from the last try on, cyclically, that makes no known fact is taken; a draw for which every entity
    makes a known fact gives no row.
    """
    from tracewright.session import durable

    n = max(entities.count(), 1)
    draw = F.explode(F.sequence(F.lit(1), F.lit(ratio)))
    attempt = F.explode(F.sequence(F.lit(0), F.lit(tries - 1)))
    spread = facts.select("h", "r", "t").withColumn("draw", draw).withColumn("try", attempt)
    chosen = F.pmod(F.xxhash64("h", "r", "t", "draw", "try"), F.lit(n)) if pick is None else pick
    if shares is None:
        spread = spread.withColumn("side", F.pmod(F.col("draw"), F.lit(2)) == 0)
    else:
        drawn = F.pmod(F.xxhash64("h", "r", "t", "draw"), F.lit(1 << 30)) / float(1 << 30) if u is None else u
        spread = spread.join(shares.select("r", "share"), "r").withColumn("side", drawn < F.col("share")).drop("share")
    head = F.col("side")
    truth = facts if known is None else known
    spread = spread.withColumn("index", chosen).join(entities.select(F.col("index"), F.col("id").alias("e")), "index", "left")
    spread = spread.withColumns({"nh": F.when(head, F.col("e")).otherwise(F.col("h")), "nt": F.when(head, F.col("t")).otherwise(F.col("e"))})
    known = truth.select(F.col("h").alias("nh"), "r", F.col("t").alias("nt")).distinct().withColumn("known", F.lit(True))
    false = F.col("known").isNull() & F.col("e").isNotNull()
    kept = durable(
        spread.join(known, ["nh", "r", "nt"], "left").groupBy("h", "r", "t", "draw", "side")
        .agg(F.min_by(F.when(false, F.struct("nh", "nt")), F.when(false, F.col("try"))).alias("x"), F.max_by("index", "try").alias("last"))
    )
    left = kept.filter("x is null").select(
        "h", "r", "t", "draw", "side", F.when(head, F.col("t")).otherwise(F.col("h")).alias("fixed"),
        F.pmod(F.coalesce("last", F.lit(0)), F.lit(n)).cast("bigint").alias("at"),
    )
    keys = ["side", "r", "fixed"]
    ends = truth.select(F.lit(True).alias("side"), "r", F.col("t").alias("fixed"), F.col("h").alias("id")).union(
        truth.select(F.lit(False), "r", F.col("h"), F.col("t"))
    )
    places = ends.join(left.select(*keys).distinct(), keys, "left_semi").distinct().join(entities, "id").select(*keys, F.col("index").cast("bigint").alias("at"))
    own = Window.partitionBy(*keys)
    # Numbers among the entities that make no known fact: of the one to start from, and of those after each known one.
    begun = _marks_up_to(left, places, keys, strict=True).withColumn("at", F.col("at") - F.col("n_marks")).drop("n_marks")
    gaps = places.withColumn("at", F.col("at") - F.row_number().over(own.orderBy("at")) + 1)
    size = places.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    free = begun.join(size, keys, "left").withColumn("free", F.lit(n) - F.coalesce("c", F.lit(0))).filter("free > 0")
    asks = free.withColumn("at", F.pmod("at", "free")).drop("c", "free")
    found = _marks_up_to(asks, gaps, keys).withColumn("index", F.col("at") + F.col("n_marks")).join(entities.select("index", F.col("id").alias("e")), "index")
    rest = found.select("h", "r", "t", "draw", F.when(head, F.col("e")).otherwise(F.col("h")).alias("nh"), F.when(head, F.col("t")).otherwise(F.col("e")).alias("nt"))
    return kept.filter("x is not null").select("h", "r", "t", "draw", "x.nh", "x.nt").unionByName(rest)


def head_shares(stats: DataFrame) -> DataFrame:
    """(r, share): how often the head is replaced, by the relation's facts a tail against its facts a head."""
    return stats.select("r", (F.col("right_mean") / (F.col("left_mean") + F.col("right_mean"))).alias("share"))


#: Relations that every task may hold.
MAX_RELATIONS = 100_000


def corrupt_relations(
    facts: DataFrame, pick: Column | None = None, weights: DataFrame | None = None, u: Column | None = None, temperature: float = 1.0
) -> DataFrame:
    """(h, r, t, nr): every fact with a relation that its two entities are not known to have.

    ``pick`` (by default a hash) takes one of those in name order; with ``weights`` (r, x) they are drawn by
    softmax(-x / temperature) at ``u`` in [0, 1). Facts whose entities have every relation give no row. The
    relations are held by every task; their number is checked.
    """
    table = facts.select("r").distinct() if weights is None else weights
    x = F.lit(0.0) if weights is None else F.col("x")
    listed = sorted(map(tuple, table.select("r", x).limit(MAX_RELATIONS + 1).collect()))
    if len(listed) > MAX_RELATIONS:
        raise ValueError(f"more than {MAX_RELATIONS} relations")
    least = min((v for _, v in listed), default=0.0)
    every = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(math.exp(-(v - least) / temperature)).alias("p")) for r, v in listed])
    known = facts.groupBy("h", "t").agg(F.collect_set("r").alias("__known"))
    free = F.filter(every, lambda c: ~F.array_contains("__known", c["r"]))
    open_ = facts.select("h", "r", "t").distinct().join(known, ["h", "t"]).withColumn("__free", free).filter(F.size("__free") > 0)
    if weights is None:
        at = F.xxhash64("h", "r", "t") if pick is None else pick
        chosen = F.get("__free", F.pmod(at, F.size("__free")).cast("int"))["r"]
    else:
        drawn = F.pmod(F.xxhash64("h", "r", "t"), F.lit(1 << 30)) / float(1 << 30) if u is None else u
        whole = F.aggregate("__free", F.lit(0.0), lambda s, c: s + c["p"])
        start = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast(facts.schema["r"].dataType).alias("r"))
        passed = F.aggregate(
            "__free", start,
            lambda a, c: F.struct((a["s"] + c["p"]).alias("s"), F.when(a["r"].isNull() & (a["s"] + c["p"] > drawn * whole), c["r"]).otherwise(a["r"]).alias("r")),
        )
        chosen = F.coalesce(passed["r"], F.element_at("__free", -1)["r"])
    return open_.select("h", "r", "t", chosen.alias("nr"))


def cross_batches(facts: DataFrame, order: list[str], size: int) -> DataFrame:
    """Facts with ``batch`` (runs of ``size`` in order) and ``side``, the end that is corrupted: heads and tails batch by batch in turn."""
    numbered = global_numbers(facts, order, "__n").withColumn("batch", F.floor(F.col("__n") / size))
    return numbered.withColumn("side", F.when(F.col("batch") % 2 == 0, "head").otherwise("tail")).drop("__n")


def unknown_only(candidates: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates (h, r, t) that are no known fact."""
    return candidates.join(known.select("h", "r", "t").distinct(), ["h", "r", "t"], "left_anti")


def with_new_ids(facts: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Facts by the ids of ``old`` (name, id) written by those of ``new``; facts with a name that is in one only drop out."""
    same = old.select("name", F.col("id").alias("__old")).join(new.select("name", F.col("id").alias("__new")), "name").select("__old", "__new")
    first = facts.join(same, F.col("h") == F.col("__old")).select(F.col("__new").alias("h"), "r", "t")
    return first.join(same, F.col("t") == F.col("__old")).select("h", "r", F.col("__new").alias("t"))


def constrained_tails(facts: DataFrame, ratio: int) -> DataFrame:
    """Corruption by tails the relation was seen with: the k-th next of them in id order that is unknown for the head.

    The order is cyclic, so draws repeat only where there are fewer unknown tails than ``ratio``; a head
    that knows every tail of the relation has no negatives. The place of an unknown tail is its number
    among the unknown ones plus the known ones before it, which one sorted pass counts.
    """
    once = facts.select("h", "r", "t").filter("r is not null and t is not null").distinct()
    tails = once.select("r", "t").distinct()
    places = tails.withColumn("place", F.row_number().over(Window.partitionBy("r").orderBy("t")).cast("bigint") - 1)
    size = tails.groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("h", "r")
    placed = once.join(places, ["r", "t"]).join(size, "r").withColumns({
        "at": F.col("place") - F.row_number().over(own.orderBy("place")) + 1, "free": F.col("n") - F.count(F.lit(1)).over(own)
    })
    asks = (
        placed.filter("free > 0").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(ratio))))
        .select("h", "r", "t", "draw", F.pmod(F.col("at") + F.col("draw") - 1, F.col("free")).alias("at"))
    )
    counted = _marks_up_to(asks, placed, ["h", "r"]).withColumn("place", F.col("at") + F.col("n_marks"))
    return counted.join(places.withColumnRenamed("t", "nt"), ["r", "place"]).select("h", "r", "t", "draw", "nt")


def weighted_relations(facts: DataFrame, weights: DataFrame, temperature: float = 1.0) -> DataFrame:
    """(r, lo, hi): the cumulative softmax(-x / temperature) intervals from which a relation is drawn."""
    order = Window.orderBy("r")  # one row a relation
    p = F.exp(-F.col("x") / temperature)
    whole = weights.agg(F.sum(p).alias("z")).first()[0]
    shares = weights.withColumn("p", p / F.lit(whole))
    return shares.withColumn("hi", F.sum("p").over(order)).select("r", (F.col("hi") - F.col("p")).alias("lo"), "hi")


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of the left side that the right side does not hold; nulls are equal to nulls."""
    return left.subtract(right)
