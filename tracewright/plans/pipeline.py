"""The stages end to end: correlate, cut and compress graphs, pool vectors, cluster and evaluate."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators import clusters as K
from tracewright.operators import graph as G
from tracewright.operators import ordering as O
from tracewright.operators import rules
from tracewright.operators import triples as T


def correlate(program: str, apps: DataFrame, nets: DataFrame, compress: bool = False) -> DataFrame:
    """Network records with labels, compressed where asked."""
    labelled = rules.correlate(program, apps, nets)
    return rules.compressed(labelled) if compress else labelled


def cut_graphs(edges: DataFrame, noise: list[str] | None = None) -> DataFrame:
    """Edges (event_id, graph_id, src, dst, relation, start, end) without noise nodes, reduced by causality."""
    return G.cpr_merge(G.merge_nodes(edges, noise), ["graph_id"], "event_id")


def compress(edges: DataFrame, keys: list[str], edge_id: str, lasts_ms: int = 1000, gap_ms: int = 10, least: float = 0.95) -> DataFrame:
    """(edge_id, start, end, n_edges) of the edges that all four stages of the compression leave.

    ``edges`` have (src, dst, relation, stamp, data_source, log_data) and the keys; printed times are brought
    to milliseconds, every edge lasts ``lasts_ms``. Stages: noise nodes, causality (an edge stands for those
    merged into it), events like the one before, network noise.
    """
    timed = edges.withColumn("start", G.time_ms(F.col("stamp"), F.lit("audit"))).withColumn("end", F.col("start") + lasts_ms)
    cut = G.cpr_merge(G.merge_nodes(timed), keys, edge_id)
    rows = cut.join(edges.select(edge_id, "data_source", "log_data"), edge_id)
    sets = rows.withColumn("values", F.coalesce(G.value_set(F.col("log_data")), F.array().cast("array<string>")))
    kept = G.head_anchored(sets.withColumn("relation", F.coalesce("relation", F.lit(""))), [*keys, "src", "dst", "relation"], edge_id, gap_ms, least)
    return G.drop_net_noise(rows.join(kept, edge_id, "left_semi")).select(edge_id, "start", "end", "n_edges")


def graph_snapshots(edges: DataFrame, slices: int = 4) -> DataFrame:
    """Edges with their time slice, and once more under the slice ``slices``, which is the whole."""
    sliced = O.time_slices(edges, ["start", "event_id"], slices)
    return sliced.unionByName(sliced.withColumn("slice", F.lit(slices)))


def pool(edges: DataFrame, vectors: DataFrame, weighting: str = "tfidf") -> DataFrame:
    """(graph_id, vec): weighted sums of the vectors (src, relation, dst, vec) of a graph's triples."""
    term = ["src", "relation", "dst"]
    if weighting == "uniform":
        weights = T.uniform_weight(edges, term).withColumnRenamed("weight", "tfidf")
    else:
        weights = T.term_frequency(edges, "graph_id", term)
        if weighting == "idf":
            weights = weights.withColumn("tfidf", F.col("idf"))
    return T.graph_vectors(edges, vectors, weights, "graph_id", term)


def event_vectors(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(src, relation, dst, vec): entity, relation and entity vectors one after the other; ``entities`` and ``relations`` have (name, vec)."""
    s = entities.select(F.col("name").alias("src"), F.col("vec").alias("sv"))
    o = entities.select(F.col("name").alias("dst"), F.col("vec").alias("ov"))
    r = relations.select(F.col("name").alias("relation"), F.col("vec").alias("rv"))
    joined = triples.select("src", "relation", "dst").distinct().join(s, "src").join(r, "relation").join(o, "dst")
    return joined.select("src", "relation", "dst", F.concat("sv", "rv", "ov").alias("vec"))


def classify(graphs: DataFrame, truth: DataFrame, rounds: int = 10, seeds: str = "mean") -> DataFrame:
    """Scores of clusters seeded by the means (or sums) of known classes: ``graphs`` (graph_id, vec), ``truth`` (graph_id, label)."""
    known = graphs.join(truth, "graph_id")
    found = K.kmeans(graphs, K.centroids(known, "label", seeds), "graph_id", "label", rounds)
    pairs = found.select("graph_id", F.col("label").alias("cluster")).join(truth, "graph_id")
    return K.weighted_scores(pairs.join(K.majority_labels(pairs, "cluster", "label"), "cluster"), "label", "predicted")


def hooked(rows: DataFrame, label: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Rows through a function of frames, such as a call of a labelling service: the place to plug one in."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(label, frames)

    return rows.mapInPandas(run, schema)
