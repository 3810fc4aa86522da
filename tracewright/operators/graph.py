"""Provenance graphs on node and edge tables: build, compress, cut, reach."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import durable, stored

#: Texts whose presence makes a node noise, and names that are noise as a whole (fixed values, spelled as the
#: graphs to be matched were cut with them: one text has two paths in a row).
NOISE_PARTS = [
    "/tmp/", ".so", "/lib/x86_64-linux-gnu/", "vim.mo", ".ro", ".readonly", ".dll", ".dylib", ".conf", ".config",
    "/etc/localtime", "/usr/lib/locale/", "/usr/share/X11/locale/en_US.UTF-8/XLC_LOCALE", "/home/victim/en_US.UTF-8",
    "/usr/share/X11/locale/", "/usr/local/share/vim/vim80/", "/usr/local/pgsql/data/log/", "/var/log/proftpd/", "/var/log/redis/",
    "/usr/share/zoneinfo/", "/etc/audit/rules.d//usr/share/locale/", "/usr/share/locale-langpack/", "/home/victim/.viminfo",
    "/usr/lib/locale/locale-archive", "/etc/ld.so.cache", "/usr/local/share/vim/vim80/lang/", "/etc/X11/en_US.UTF-8/",
    "/usr/share/X11/", "/dev/urandom", "ciscodump", "dumpcap", "auditd", "auditctl", "lsof", "polkitd", " ", "/lib/systemd/",
    "wireshark", "127.0.0.53",
]
NOISE_NAMES = ["", "/", "."]
#: Calls that say nothing of what a process does, and those that only look at a file (fixed values).
NOISE_CALLS = [
    "sys_rt_sigprocmask", "sys_rt_sigaction", "sys_mmap", "sys_times", "sys_mprotect", "sys_stat", "sys_getpid", "sys_brk",
    "sys_prlimit64", "sys_futex", "sys_arch_prctl", "sys_munmap", "sys_set_tid_address", "sys_set_robust_list", "sys_sysinfo",
    "sys_sched_getaffinity", "sys_getcwd",
]
LOOK_CALLS = ["sys_stat", "sys_lstat"]


def without_calls(rows: DataFrame, calls: list[str], action: str = "action") -> DataFrame:
    """Rows of other calls; rows without a call stay."""
    return rows.filter(~F.coalesce(F.col(action).isin(calls), F.lit(False)))


def since(rows: DataFrame, at: str, source: str, begins: dict[str, int]) -> DataFrame:
    """Rows from the time on at which their source's record begins; sources without one, and null times, stay."""
    begin = F.lit(None).cast("bigint")
    for name, value in begins.items():
        begin = F.when(F.col(source) == name, value).otherwise(begin)
    return rows.filter(F.coalesce(F.col(at) >= begin, F.lit(True)))


def in_range(at: Column, low: Column, high: Column) -> Column:
    """Whether a time lies in a closed range; every time lies in a range that is null."""
    return F.when(low.isNull() | high.isNull(), True).otherwise(F.coalesce((at >= low) & (at <= high), F.lit(False)))


def fed_before(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edges (src, dst, label, start) whose source was entered by an edge of the same label not later than they start."""
    first = edges.filter("label is not null").groupBy(*keys, F.col("dst").alias("src"), "label").agg(F.min("start").alias("__first"))
    return edges.join(first, [*keys, "src", "label"]).filter("__first <= start").drop("__first")


def labelled_pairs(edges: DataFrame, label: object) -> DataFrame:
    """(src, dst, edge_id) of the edges of one relation."""
    return edges.filter(F.col("relation") == F.lit(label)).select("src", "dst", "edge_id").distinct()


def labelled_nodes(edges: DataFrame, nodes: DataFrame, label: object, kinds: list[str] | None = None) -> DataFrame:
    """(name, entity_type) of the nodes at the ends of one relation's edges, of the kinds asked for."""
    pairs = labelled_pairs(edges, label)
    ends = pairs.select(F.col("src").alias("name")).union(pairs.select("dst")).distinct()
    found = nodes.select("name", "entity_type").distinct().join(ends, "name", "left_semi")
    return found if kinds is None else of_kind(found, kinds)


def of_kind(nodes: DataFrame, kinds: list[str]) -> DataFrame:
    """Nodes of the kinds named (File, Socket, Process)."""
    return nodes.filter(F.col("entity_type").isin(kinds))


def time_ms(stamp: Column, source: Column) -> Column:
    """Whole milliseconds of a printed time: audit ones are in microseconds, Apache and network ones in seconds, others as they are."""
    number = stamp.try_cast("decimal(38,9)")
    ms = F.when(F.contains(source, F.lit("audit")), number / 1000)
    ms = ms.when((source == "Apache_app") | F.contains(source, F.lit("net")), number * 1000).otherwise(number)
    return F.floor(ms).cast("bigint")


def build_edges(rows: DataFrame, reverse: list[str], keep: list[str] | None = None) -> DataFrame:
    """Audit rows (process_name, file, ip, port, child, action, ts_us) as edges (src, dst, dst_type, relation, ts_us).

    The object is the file, else the socket, else a cloned child; other rows give no edge. Calls in
    ``reverse`` move data towards the process, so their edge points the other way.
    """
    socket = F.when(F.col("ip").isNotNull(), F.concat_ws(":", "ip", F.col("port").cast("string")))
    other = F.coalesce("file", socket, F.when(F.col("action").endswith("clone"), F.col("child")))
    kind = F.when(F.col("file").isNotNull(), "File").when(socket.isNotNull(), "Socket").otherwise("Process")
    turned = F.col("action").isin(reverse)
    return rows.filter(other.isNotNull() & F.col("process_name").isNotNull()).select(
        F.when(turned, other).otherwise(F.col("process_name")).alias("src"),
        F.when(turned, F.col("process_name")).otherwise(other).alias("dst"),
        F.when(turned, F.lit("Process")).otherwise(kind).alias("dst_type"),
        F.col("action").alias("relation"), "ts_us", *(keep or ()),
    )


def node_ids(edges: DataFrame, graph: str) -> DataFrame:
    """(graph, name, node_id): nodes of each graph numbered from 0 in name order."""
    ends = edges.select(graph, F.col("src").alias("name")).union(edges.select(graph, F.col("dst").alias("name")))
    return ends.filter("name is not null").distinct().withColumn(
        "node_id", F.row_number().over(Window.partitionBy(graph).orderBy("name")) - 1
    )


def drop_isolates(nodes: DataFrame, edges: DataFrame, keys: list[str], node: str) -> DataFrame:
    """Nodes that end at least one edge."""
    ends = edges.select(*keys, F.col("src").alias(node)).union(edges.select(*keys, F.col("dst").alias(node)))
    return nodes.join(ends.distinct(), [*keys, node], "left_semi")


def is_noise(name: Column, parts: list[str] | None = None, whole: list[str] | None = None) -> Column:
    """Whether a node name is null, noise as a whole, or holds a noise part."""
    holds = reduce(lambda a, b: a | b, [F.contains(name, F.lit(p)) for p in (NOISE_PARTS if parts is None else parts)], F.lit(False))
    return name.isNull() | name.isin(NOISE_NAMES if whole is None else whole) | holds


def merge_nodes(edges: DataFrame, parts: list[str] | None = None) -> DataFrame:
    """Edges without noise ends: the ends are edge columns, so no join is needed."""
    return edges.filter(~is_noise(F.col("src"), parts) & ~is_noise(F.col("dst"), parts))


#: Rows of a timeline that are read in one piece.
SLICE_ROWS = 1_000_000


def _long_timelines(rows: DataFrame, keys: list[str], at: str, slice_rows: int) -> DataFrame | None:
    """(__key, __n, __lo, __hi) of the timelines that are longer than a slice; None if there is none. Null keys are keys."""
    long = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.min(at).alias("__lo"), F.max(at).alias("__hi")).filter(F.col("__n") > slice_rows)
    long = stored(long.select(F.struct(*keys).alias("__key"), "__n", "__lo", "__hi"))
    return None if long.isEmpty() else long


def _sliced(rows: DataFrame, keys: list[str], at: str, long: DataFrame | None, slice_rows: int) -> DataFrame:
    """``rows`` with ``__b``, the slice of their timeline: so many equal spans of time that each has about ``slice_rows`` rows."""
    if long is None:
        return rows.withColumn("__b", F.lit(0).cast("bigint"))
    placed = rows.withColumn("__key", F.struct(*keys)).join(long, "__key", "left")
    share = (F.col(at) - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + 1)
    return placed.withColumn("__b", F.coalesce(F.floor(share * F.ceil(F.col("__n") / slice_rows)), F.lit(0))).drop("__key", "__n", "__lo", "__hi")


def _carried(rows: DataFrame, keys: list[str], long: DataFrame | None, totals: list[Column], values: dict[str, tuple[Column, str]]) -> DataFrame:
    """``rows`` with ``values`` (column, type), made of the ``totals`` of the slices before theirs on the timeline; null in first slices."""
    if long is None:
        return rows.withColumns({n: F.lit(None).cast(kind) for n, (_, kind) in values.items()})
    sums = rows.groupBy(*keys, "__b").agg(*totals)
    before = sums.select(F.struct(*keys, "__b").alias("__at"), "__b", *[v.alias(n) for n, (v, _) in values.items()]).filter("__b > 0").drop("__b")
    return rows.withColumn("__at", F.struct(*keys, "__b")).join(before, "__at", "left").drop("__at")


def _running(rows: DataFrame, keys: list[str], at: str, order: list[str], sums: dict[str, str], long: DataFrame | None, slice_rows: int) -> DataFrame:
    """``rows`` with running sums over each timeline: within the slice, plus the totals of the slices before it."""
    sliced = _sliced(rows, keys, at, long, slice_rows)
    along = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*keys, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    carried = _carried(sliced, keys, long, [F.sum(c).alias(c) for c in sums], {f"__b_{c}": (F.sum(c).over(along), "bigint") for c in sums})
    summed = {out: F.coalesce(f"__b_{c}", F.lit(0)) + F.sum(c).over(inside) for c, out in sums.items()}
    return carried.withColumns(summed).drop("__b", *[f"__b_{c}" for c in sums])


def cpr_merge(edges: DataFrame, keys: list[str], edge_id: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Causality-preserving reduction of edges (src, dst, relation, start, end) per graph key.

    An edge merges into the one before of the same (src, dst, relation) unless information could have
    flowed between them: an edge out of dst that overlaps [previous start, own start], or one into
    src that overlaps [previous end, own end]. Merged edges take the latest end. Overlaps are counted
    without pairing edges: those starting up to the right bound minus those ending before the left
    one. Both are read off one sorted pass over the timelines of all nodes; long timelines are cut into
    slices, so that a node or pair that holds most of the edges is no one task.
    """
    own = [*keys, "src", "dst", "relation"]
    order = ["start", "end", edge_id]
    inside, along = Window.partitionBy(*own, "__b").orderBy(*order), Window.partitionBy(*own).orderBy("__b")
    rows = edges.select(*own, *order)
    long, kind = _long_timelines(rows, own, "start", slice_rows), rows.select(F.struct(*order).alias("x")).schema["x"].dataType
    last = {"__before": (F.lag("__last").over(along), kind)}
    asked = _carried(_sliced(rows, own, "start", long, slice_rows), own, long, [F.max(F.struct(*order)).alias("__last")], last)
    asked = asked.withColumns(
        {"ps": F.coalesce(F.lag("start").over(inside), F.col("__before.start")), "pe": F.coalesce(F.lag("end").over(inside), F.col("__before.end"))}
    )
    asked = stored(asked.select(*own, *order, "ps", "pe"))

    def mark(way: int, node: str, at: str, place: int, starts: int, ends: int) -> Column:
        named = {"way": F.lit(way), "node": F.col(node), "t": F.col(at), "place": F.lit(place), "s": F.lit(starts), "e": F.lit(ends)}
        return F.struct(*[c.alias(n) for n, c in named.items()])

    # Edges out of a node (way 0) and into it (1); questions come before the ends and after the starts of their time.
    marks = [mark(way, end, at, 1, int(at == "start"), int(at == "end")) for way, end in ((0, "src"), (1, "dst")) for at in ("start", "end")]
    questions = [mark(0, "dst", "start", 2, 0, 0), mark(0, "dst", "ps", 0, 0, 0), mark(1, "src", "end", 2, 0, 0), mark(1, "src", "pe", 0, 0, 0)]
    rows = asked.select(*keys, edge_id, F.explode(F.when(F.col("ps").isNull(), F.array(*marks)).otherwise(F.array(*marks, *questions))).alias("m"))
    rows = rows.select(*keys, edge_id, "m.*")
    nodes = [*keys, "way", "node"]
    hubs = _long_timelines(rows, nodes, "t", slice_rows)
    summed = _running(rows, nodes, "t", ["t", "place"], {"s": "started", "e": "ended"}, hubs, slice_rows).filter("place <> 1")
    hits = lambda way: F.sum(F.when(F.col("way") == way, F.when(F.col("place") == 2, F.col("started")).otherwise(-F.col("ended"))))
    flowed = summed.groupBy(*keys, edge_id).agg(((hits(0) > 0) | (hits(1) > 0)).alias("__flowed"))
    checked = asked.join(flowed, [*keys, edge_id], "left")
    checked = stored(checked.select(*own, *order, (F.col("ps").isNull() | F.coalesce("__flowed", F.lit(False))).cast("int").alias("__kept")))
    islands = _running(checked, own, "start", order, {"__kept": "island"}, long, slice_rows)
    return islands.groupBy(*own, "island").agg(
        F.min_by(edge_id, F.struct(*order)).alias(edge_id), F.min("start").alias("start"), F.max("end").alias("end"),
        F.count(F.lit(1)).alias("n_edges"),
    )


#: Fields of a record that differ between equal events (fixed values).
VOLATILE = ["Timestamp", "log_id", "datetime", "data_source", "sequenceNum", "len", "label", "time"]


def value_set(record: Column) -> Column:
    """The distinct non-null values of a record's lasting fields."""
    lasting = F.map_filter(record, lambda k, v: ~k.isin(VOLATILE) & v.isNotNull())
    return F.array_sort(F.array_distinct(F.map_values(lasting)))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over joint values of two sets; two empty sets are equal."""
    joint = F.size(F.array_union(a, b))
    return F.when(joint == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / joint)


def jaccard_to_previous(edges: DataFrame, keys: list[str], order: list[str], record: str) -> DataFrame:
    """Every edge with the similarity of its record to that of the edge before in its key."""
    sets = edges.withColumn("values", F.coalesce(value_set(F.col(record)), F.array().cast("array<string>")))
    before = F.lag("values").over(Window.partitionBy(*keys).orderBy(*order))
    return sets.withColumn("before", before).withColumn("similarity", F.when(F.col("before").isNotNull(), jaccard(F.col("values"), F.col("before")))).drop("before")


def head_anchored(edges: DataFrame, keys: list[str], edge_id: str, gap_ms: int = 10, least: float = 0.95) -> DataFrame:
    """Edges (start, values) that are kept: later than the gap after the last kept one of the key, or unlike it.

    The head does not advance on a merge, so keys are folded in order; rows reach the fold sorted
    and in batches, with one head of state, so that a hot key needs no memory of its own.
    """
    schema = edges.select(edge_id).schema
    ordered = edges.select(*keys, edge_id, "start", "values").repartition(*keys).sortWithinPartitions(*keys, "start", edge_id)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, start, held = None, 0, frozenset()
        for batch in batches:
            keep = []
            columns = [batch[c].tolist() for c in keys]
            for k, (at, values) in zip(zip(*columns, strict=True), zip(batch["start"], batch["values"], strict=True), strict=True):
                now = frozenset(values)
                joint = len(now | held)
                alike = 1.0 if joint == 0 else len(now & held) / joint
                new = k != key or at - start > gap_ms or alike <= least
                if new:
                    key, start, held = k, at, now
                keep.append(new)
            yield batch.loc[keep, [edge_id]]

    return ordered.mapInPandas(fold, schema)


def drop_net_noise(edges: DataFrame, source: str = "data_source", record: str = "log_data") -> DataFrame:
    """Network edges without port, of DNS or bare TCP, or to the broadcast address are dropped."""
    get = lambda k: F.try_element_at(record, F.lit(k))
    noise = (
        get("port").isNull()
        | F.upper(F.coalesce(get("protocol"), F.lit(""))).isin("DNS", "TCP")
        | (F.coalesce(get("ip"), F.lit("")) == "255.255.255.255")
    )
    return edges.filter((F.col(source) != "net") | F.col(source).isNull() | ~noise)


def reduction_report(before: DataFrame, after: DataFrame, source: str) -> DataFrame:
    """Edges per source before and after compression and the share removed."""
    n = F.count(F.lit(1))
    a = before.groupBy(source).agg(n.alias("edges_before"))
    b = after.groupBy(source).agg(n.alias("edges_after"))
    joined = a.join(b, source, "left").na.fill(0, ["edges_after"])
    return joined.withColumn("removed_share", 1 - F.col("edges_after") / F.col("edges_before"))


def overlapping(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Closed intervals overlap."""
    return (a_end >= b_start) & (a_start <= b_end)


def exploding_nodes(edges: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """Nodes with more outgoing edges than ``cap``."""
    return edges.groupBy(*keys, "src").agg(F.count(F.lit(1)).alias("degree")).filter(F.col("degree") > cap)


def reach_in_time(edges: DataFrame, starts: DataFrame, hops: int, keys: list[str], cap: int | None = None) -> DataFrame:
    """(keys, start, node, hop, at): nodes reached by edges (src, dst, at), each strictly later than the one before.

    Only the earliest arrival at a node counts for going on, as any path from a later one exists from
    it too; the frontier is that of new or earlier arrivals, so rounds shrink.
    """
    used = edges if cap is None else edges.join(exploding_nodes(edges, keys, cap), [*keys, "src"], "left_anti")
    steps = used.select(*keys, F.col("src").alias("node"), F.col("dst").alias("next"), F.col("at").alias("then"))
    frontier = starts.select(*keys, F.col("start"), F.col("start").alias("node"), F.lit(None).cast(edges.schema["at"].dataType).alias("at"))
    reached: DataFrame | None = None
    for hop in range(1, hops + 1):
        later = F.col("at").isNull() | (F.col("then") > F.col("at"))
        moved = frontier.join(steps, [*keys, "node"]).filter(later).groupBy(*keys, "start", F.col("next").alias("node")).agg(F.min("then").alias("at"))
        moved = moved.withColumn("hop", F.lit(hop))
        if reached is not None:
            seen = reached.groupBy(*keys, "start", "node").agg(F.min("at").alias("__at"))
            moved = moved.join(seen, [*keys, "start", "node"], "left").filter("__at is null or at < __at").drop("__at")
        moved = durable(moved) if hop < hops else moved
        reached = moved if reached is None else reached.unionByName(moved)
        frontier = moved.drop("hop")
    return reached.groupBy(*keys, "start", "node").agg(F.min("at").alias("at"), F.min("hop").alias("hop"))


def components(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, component): weakly connected components, named by their smallest node.

    Large-star and small-star rounds: each links nodes to smaller ones until nothing changes, which
    takes logarithmically many rounds; no node is ever paired with more than its neighbours.
    """
    pairs = edges.filter("src is not null and dst is not null").select(*keys, F.col("src").alias("a"), F.col("dst").alias("b"))
    nodes = pairs.select(*keys, F.col("a").alias("node")).union(pairs.select(*keys, F.col("b").alias("node"))).distinct()
    links = stored(pairs.filter("a <> b").distinct())
    while True:
        both = links.union(links.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(*keys, "a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, [*keys, "a"]).filter("b > a").select(*keys, F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.filter("a <> b").distinct()
        low = down.groupBy(*keys, "a").agg(F.min("b").alias("m"))
        small = down.join(low, [*keys, "a"])
        # A node with one smaller neighbour only is as it should be unless that one goes on itself.
        up = small.filter("b <> m").select(*keys, F.col("b").alias("a"), F.col("m").alias("b"), F.lit(True).alias("moved"))
        kept = low.select(*keys, "a", F.col("m").alias("b"), F.lit(False).alias("moved"))
        links = stored(up.union(kept).groupBy(*keys, "a", "b").agg(F.max("moved").alias("moved")))
        chained = links.join(links.select(*keys, F.col("a").alias("b"), F.lit(True).alias("on")), [*keys, "b"], "left_semi")
        if links.filter("moved").isEmpty() and chained.isEmpty():
            break
        links = links.drop("moved")
    named = links.select(*keys, F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.join(named, [*keys, "node"], "left").withColumn("component", F.coalesce("component", "node"))


def largest_component(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node): the nodes of the largest component of each graph, of equally large ones the one named least."""
    labelled = stored(components(edges, keys))
    sized = labelled.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("n"))
    best = sized.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), "component")).alias("b")).select(*keys, "b.component")
    return labelled.join(best, [*keys, "component"], "left_semi").select(*keys, "node")


def component_bridges(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """One bridge edge from each further component to the first one of its graph."""
    roots = labelled.groupBy(*keys, "component").agg(F.min("node").alias("node"))
    first = roots.groupBy(*keys).agg(F.min("component").alias("__c"), F.min_by("node", "component").alias("dst"))
    return roots.join(first, keys).filter("component <> __c").select(*keys, F.col("node").alias("src"), "dst")


def claim_parallel(edges: DataFrame, keys: list[str], edge_id: str) -> DataFrame:
    """Labels for edges without one that run parallel (same src, dst) within a label's time range; the smallest label claims."""
    spans = edges.filter("label is not null").groupBy(*keys, "src", "dst", "label").agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
    free = edges.filter("label is null").select(*keys, "src", "dst", edge_id, "start")
    claimed = free.join(spans, [*keys, "src", "dst"]).filter("start between lo and hi").groupBy(*keys, edge_id).agg(F.min("label").alias("__l"))
    return edges.join(claimed, [*keys, edge_id], "left").withColumn("label", F.coalesce("label", "__l")).drop("__l")


def subset_graphs(edges: DataFrame, graph: str, keys: list[str]) -> DataFrame:
    """(keys, graph): graphs whose (src, dst) pairs all lie in an earlier graph of the key.

    A graph is the sorted list of the numbers of its pairs, rarest first. Of graphs with one list all but the first
    lie in an earlier one; that one is compared with the earlier lists that hold its rarest pair, list by list in a
    task. A pair that is null or of one graph only lies in no other graph, which settles its graph; for others it is
    not looked at.
    """
    whole = " and ".join(f"`{c}` is not null" for c in [*keys, graph])
    pairs = stored(edges.select(*keys, graph, "src", "dst").filter(whole).distinct())
    spread = pairs.filter("src is not null and dst is not null").groupBy(*keys, "src", "dst").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    # Stored, its size is known when the join is planned: few numbers are broadcast and the pairs stay where they are.
    numbered = stored(spread.select(*keys, "src", "dst", F.row_number().over(Window.partitionBy(*keys).orderBy("m", "src", "dst")).alias("__p")))
    coded = pairs.join(numbered, [*keys, "src", "dst"], "left")
    sets = stored(coded.groupBy(*keys, graph).agg(F.array_sort(F.collect_list("__p")).alias("__set"), F.max(F.col("__p").isNull()).alias("__own")))
    firsts = stored(sets.filter("size(__set) > 0").groupBy(*keys, "__set").agg(F.min(graph).alias("__first"), F.min_by("__own", graph).alias("__own")))
    asked = firsts.filter("not __own").select(*keys, F.element_at("__set", 1).alias("__p")).distinct()
    # The numbers under which a list is looked up are found before the lists are moved, so that each goes only where one asks.
    spots = firsts.select(*keys, "__first", F.explode("__set").alias("__p")).join(asked, [*keys, "__p"], "left_semi")
    held = firsts.join(spots.groupBy(*keys, "__first").agg(F.collect_list("__p").alias("__spots")), [*keys, "__first"])
    met = held.select(*keys, F.explode("__spots").alias("__p"), "__first", "__set", "__own").repartition(*keys, "__p").sortWithinPartitions(*keys, "__p", "__first")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, n, holders = None, 0, {}
        for batch in batches:
            alone = []
            columns = [batch[c].to_pylist() for c in [*keys, "__p"]]
            for row, (now, numbers, own) in enumerate(zip(zip(*columns, strict=True), batch["__set"].to_pylist(), batch["__own"].to_pylist(), strict=True)):
                if now != group:
                    group, n, holders = now, 0, {}
                if not own and numbers[0] == now[-1] and not _held_together(numbers[1:], n, holders):
                    alone.append(row)
                for number in numbers:
                    if number != now[-1]:
                        holders.setdefault(number, array("q")).append(n)
                n += 1
            yield batch.select([*keys, "__first"]).take(pa.array(alone, pa.int64()))

    alone = met.mapInArrow(fold, firsts.select(*keys, "__first").schema).withColumnRenamed("__first", graph)
    return sets.filter("not __own").select(*keys, graph).join(alone, [*keys, graph], "left_anti")


def _held_together(numbers: list[int], n: int, holders: dict[int, array]) -> bool:
    """Whether one of ``n`` lists holds all numbers; ``holders`` are the ascending places of the lists of a number."""
    if not numbers or not n:
        return n > 0
    if any(k not in holders for k in numbers):
        return False
    places = sorted((np.frombuffer(holders[k], np.int64) for k in numbers), key=len)
    found = places[0]
    for other in places[1:]:
        found = found[other[np.minimum(other.searchsorted(found), len(other) - 1)] == found]
    return len(found) > 0
