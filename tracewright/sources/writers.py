"""Writers: graphs, dictionaries, correlation documents and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.operators.ordering import global_numbers


def graph(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "overwrite", order: str | None = None) -> None:
    """Nodes once by name and edges, partitioned by graph; of a node's kinds and data the first that is there in ``order`` wins, the least without it."""
    first = (lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order)))) if order else F.min
    once = nodes.groupBy("graph_id", "name").agg(*[first(c).alias(c) for c in ("entity_type", "entity_data")])
    once.write.mode(mode).partitionBy("graph_id").parquet(f"{path}/nodes")
    edges.write.mode(mode).partitionBy("graph_id").parquet(f"{path}/edges")


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows whose key is not in the new ones, and the new ones."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def correlation_document(nets: DataFrame, apps: DataFrame, links: DataFrame, net: str, app: str, path: str, mode: str = "overwrite") -> None:
    """The document of nets, applications and links as JSON lines: a row's ``position`` is its place in the document's list.

    Nets (``net``, ...) carry ``app_position``, the position of their application as a text, "-1" for none.
    """
    numbered = global_numbers(apps, [app], "position")
    places = numbered.select(app, F.col("position").alias("app_position"))
    linked = global_numbers(nets, [net], "position").join(links.select(net, app), net, "left").join(places, app, "left")
    rows = linked.withColumn("app_position", F.coalesce(F.col("app_position").cast("string"), F.lit("-1"))).drop(app)
    for name, part in (("nets", rows), ("apps", numbered)):
        part.repartitionByRange("position").sortWithinPartitions("position").write.mode(mode).json(f"{path}/{name}")


def audit_rows(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows as tab-separated text, each file sorted by time and files in time order."""
    rows.repartitionByRange("ts_us").sortWithinPartitions("ts_us").write.mode(mode).csv(path, sep="\t", header=True)


def dictionary(ids: DataFrame, path: str, snapshot: str | None = None, mode: str = "overwrite") -> None:
    """(name, id) or triple tables, one folder a snapshot where there are some."""
    writer = ids.write.mode(mode)
    (writer.partitionBy(snapshot) if snapshot else writer).parquet(path)


def dictionary_text(ids: DataFrame, path: str, mode: str = "overwrite") -> None:
    """(name, id) as ``name<TAB>id`` lines in id order, the first line of the first file being their count."""
    counted = ids.agg(F.lit(-1).cast("bigint").alias("id"), F.count(F.lit(1)).cast("string").alias("value"))
    lines = ids.select(F.col("id").cast("bigint").alias("id"), F.concat_ws("\t", "name", F.col("id").cast("string")).alias("value"))
    lines.unionByName(counted).repartitionByRange("id").sortWithinPartitions("id").select("value").write.mode(mode).text(path)


def report(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A small summary as one CSV file with a header."""
    rows.coalesce(1).write.mode(mode).csv(path, header=True)


def dot_lines(edges: DataFrame) -> DataFrame:
    """Edges as lines of a DOT graph."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return edges.select(F.concat(quoted("src"), F.lit(" -> "), quoted("dst"), F.lit(" [label="), quoted("relation"), F.lit("];")).alias("line"))
