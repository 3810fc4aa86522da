"""Nested JSON records into flat tables that keep their parent-child links.

Every node of a record gets interval labels by one depth-first traversal (pre-order and post-order
numbers): a node lies below another exactly if its interval is contained in the other's. Objects
come out as one node table, from which the table of any type is a selection; each is linked to the
nearest enclosing object, the last interval begun before it that contains its own.

Defined results: texts that are null, empty, cut off, followed by more text, or not one JSON object
give no nodes; numbers like NaN are not JSON; null array elements take a position and are no node;
scalars in an array are members ``name[i]`` of the object around it, scalar layers those of the packet;
a member given twice counts with its last value; repeated deliveries (same ``pkt_id``) count once;
rows with null ``pkt_id`` have no identity to link by and are left out; nesting of any depth is
read; an empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members that always take an index, a lone object being [0] (fixed values of the data's definition).
ALWAYS_INDEXED = frozenset(
    ["ip", "tls", "tcp.option", "http.header", "dns.query", "dns.answer", "tls.record", "tls.handshake", "tls.extension", "mime.part"]
)

_NODES = "pkt_id bigint, pre int, post int, level int, layer string, type string, path string, members map<string,string>, parent_pre int, parent_post int, parent_path string"
_ARROW = pa.schema(
    [
        ("pkt_id", pa.int64()), ("pre", pa.int32()), ("post", pa.int32()), ("level", pa.int32()), ("layer", pa.string()),
        ("type", pa.string()), ("path", pa.string()), ("members", pa.map_(pa.string(), pa.string())),
        ("parent_pre", pa.int32()), ("parent_post", pa.int32()), ("parent_path", pa.string()),
    ]
)


def _no_constant(name: str) -> None:
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_int=str, parse_float=str, parse_constant=_no_constant)
_TOKEN = re.compile(r'[ \t\r\n]*(?:([\[\]{}:,])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null))')


def _parse_deep(text: str) -> object:
    """A JSON text nested too deeply for the recursive decoder, by an explicit stack."""
    stack: list = [[]]
    keys: list = [None]
    state, at = "value", 0  # what may come next: value, first (value or ]), key, firstkey, colon, more
    while match := _TOKEN.match(text, at):
        at = match.end()
        mark, string, scalar = match.groups()
        if state in ("value", "first") and (string or scalar or mark in ("{", "[")):
            item = {} if mark == "{" else [] if mark == "[" else json.loads(string) if string else _DECODER.decode(scalar)
            if isinstance(stack[-1], dict):
                stack[-1][keys[-1]] = item
            else:
                stack[-1].append(item)
            if mark:
                stack.append(item)
                keys.append(None)
            state = {"{": "firstkey", "[": "first"}.get(mark or "", "more")
        elif state in ("key", "firstkey") and string:
            keys[-1], state = json.loads(string), "colon"
        elif state == "colon" and mark == ":":
            state = "value"
        elif len(stack) > 1 and mark == ("}" if isinstance(stack[-1], dict) else "]") and state in ("more", "first", "firstkey"):
            stack.pop()
            keys.pop()
            state = "more"
        elif len(stack) > 1 and state == "more" and mark == ",":
            state = "key" if isinstance(stack[-1], dict) else "value"
        else:
            raise ValueError(text[at - 1 : at + 10])
    if text[at:].strip(" \t\r\n") or len(stack) > 1 or len(stack[0]) != 1:
        raise ValueError("not one value")
    return stack[0][0]


def parse_object(text: str | None) -> dict | None:
    """The one complete JSON object that a text holds, else None."""
    if not text:
        return None
    try:
        found = _DECODER.decode(text)
    except RecursionError:
        try:
            found = _parse_deep(text)
        except ValueError:
            return None
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def _text(value: object) -> str | None:
    return {True: "true", False: "false"}[value] if isinstance(value, bool) else value  # numbers are kept as texts


def _scalars(name: str, value: object) -> Iterator[tuple[str, str | None]]:
    """(name, text) of a scalar member and of the scalars in an array, which take the array's positions."""
    todo = [(name, value, False)]
    while todo:
        name, value, inside = todo.pop()
        if isinstance(value, list):
            todo += [(f"{name}[{i}]", value[i], True) for i in range(len(value) - 1, -1, -1)]
        elif not isinstance(value, dict) and not (inside and value is None):
            yield name, _text(value)


def label_record(layers: dict, members: bool) -> list[list]:
    """[pre, post, level, layer, type, path, members] of the packet and of every object in it, in pre-order.

    ``level`` counts enclosing objects: the packet itself has -1 and an empty path, its layers 0.
    """
    pre = post = 0
    done: list[list] = []
    # An entry opens a node (value, name, path, level, layer) or, as an int, closes the object done[int].
    stack: list = [(layers, "packet", "", -1, None)]
    while stack:
        top = stack.pop()
        if isinstance(top, int):
            done[top][1] = post
            post += 1
            continue
        value, name, path, level, layer = top
        if isinstance(value, dict):
            held = dict(pair for k, v in value.items() for pair in _scalars(k, v)) if members else {}
            stack.append(len(done))
            done.append([pre, 0, level, layer, name, path, list(held.items())])
            for k, v in reversed(value.items()):
                if isinstance(v, dict | list):
                    base = f"{path}/{k}" if level >= 0 else k
                    if isinstance(v, dict) and k in ALWAYS_INDEXED:
                        base += "[0]"
                    stack.append((v, k, base, level + 1, layer if level >= 0 else k))
        else:
            for i in range(len(value) - 1, -1, -1):
                if isinstance(value[i], dict | list):
                    stack.append((value[i], name, f"{path}[{i}]", level, layer))
        pre += 1
    return done


def enclosing(nodes: list[list]) -> list[int]:
    """For nodes in pre-order, the position of the nearest one whose interval contains theirs, or -1."""
    open_: list[int] = []
    out = []
    for k, node in enumerate(nodes):
        while open_ and nodes[open_[-1]][1] < node[1]:
            open_.pop()
        out.append(open_[-1] if open_ else -1)
        open_.append(k)
    return out


def label_nodes(packets: DataFrame, members: bool = True) -> DataFrame:
    """One row per packet and object: interval labels, type, path and scalar members, with the nearest enclosing object.

    A record's intervals are all at hand where they are made, so ``parent_pre``, ``parent_post`` and
    ``parent_path`` (null for the packet itself) are found there, without moving the nodes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in _ARROW]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                record = parse_object(text)
                if record is not None and isinstance(record.get("_source"), dict):
                    record = record["_source"].get("layers")
                if not isinstance(record, dict):
                    continue
                nodes = label_record(record, members)
                for node, up in zip(nodes, enclosing(nodes), strict=True):
                    around = (None, None, None) if up < 0 else (nodes[up][0], nodes[up][1], nodes[up][5])
                    for column, item in zip(columns, (key, *node, *around), strict=True):
                        column.append(item)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW
            )

    once = packets.filter("pkt_id is not null").select("pkt_id", "layers").dropDuplicates(["pkt_id"])
    return once.mapInArrow(run, _NODES)


def node_table(nodes: DataFrame, kind: str, fields: list[str]) -> DataFrame:
    """The flat table of the objects of one type: keys, link to the parent, and the named scalar members."""
    return nodes.filter(F.col("type") == kind).select(
        "pkt_id", "pre", "post", "parent_pre", "path", *[F.try_element_at("members", F.lit(f)).alias(f) for f in fields]
    )


def found_children(packets: DataFrame) -> DataFrame:
    """(pkt_id, parent_path, child_path) of every object below a layer."""
    nodes = label_nodes(packets, members=False)
    return nodes.filter("level > 0").select("pkt_id", "parent_path", F.col("path").alias("child_path"))
