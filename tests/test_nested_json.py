import json
import random

from tracewright.operators import nested_json as N

SCHEMA = "pkt_id bigint, capture_id bigint, layers string"


def plain(record):
    out = []

    def walk(value, path, parent):
        if isinstance(value, dict):
            if parent is not None:
                out.append((parent, path))
            for k, v in value.items():
                child = f"{path}/{k}" + ("[0]" if isinstance(v, dict) and k in N.ALWAYS_INDEXED else "")
                walk(v, child, path)
        elif isinstance(value, list):
            for i, v in enumerate(value):
                walk(v, f"{path}[{i}]", parent)

    for k, v in record.items():
        walk(v, k + ("[0]" if isinstance(v, dict) and k in N.ALWAYS_INDEXED else ""), None)
    return sorted(out)


def random_value(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice([None, True, 1, 2.5, "x", '{"a": {}}', ""])
    if rng.random() < 0.5:
        return [random_value(rng, depth - 1) for _ in range(rng.randint(0, 3))]
    return {rng.choice(["tcp.option", "http", "a/b", "x", "ip", "é"]): random_value(rng, depth - 1) for _ in range(rng.randint(0, 4))}


def test_random_records_against_recursion(spark):
    rng = random.Random(2)
    records = [{n: random_value(rng, 6) for n in ("frame", "ip", "tls", "dns")} for _ in range(200)]
    table = [(k, 1, json.dumps({"_index": "i", "_source": {"layers": r}} if k % 5 == 0 else r)) for k, r in enumerate(records)]
    packets = spark.createDataFrame(table + table[:20], SCHEMA).selectExpr("*", "'x' as path", "1 as level")
    got = sorted(map(tuple, N.found_children(packets).collect()))
    assert got == sorted((k, *pair) for k, r in enumerate(records) for pair in plain(r))


def test_texts_that_are_no_object(spark):
    bad = [None, "", " ", "null", "[]", '{"ip": {"a": {}}', '{"ip": {"a": {}}} x', '{"ip": {"a": {}, "n": NaN}}', "{}", '{"_source": null, "x": 1}', "é"]
    table = [(k, 1, text) for k, text in enumerate(bad)] + [(None, 1, '{"ip": {"a": {}}}')]
    assert N.found_children(spark.createDataFrame(table, SCHEMA)).count() == 0
    assert N.found_children(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_deep_records():
    text = '{"k":' * 20_000 + '{"x": [1, "\\u00e9"]}' + "}" * 20_000
    assert N.parse_object(text) is not None
    assert N.parse_object(text + "}") is None and N.parse_object(text[:-1]) is None
    for sample in ['{"a": [1, {"b": []}, null, "x\\"y"], "c": {}}', '{"a": 1e5, "b": false}', "{ }"]:
        assert N._parse_deep(sample) == N._DECODER.decode(sample)
    for broken in ['{"a": [1,]}', '{"a" 1}', '{"a": 1,}', "{,}", '{"a": 1 "b": 2}', '["a": 1]', "{]"]:
        try:
            N._parse_deep(broken)
        except ValueError:
            continue
        raise AssertionError(broken)


def test_node_tables_keep_links(spark):
    text = '{"dns": {"dns.answer": [{"name": "a", "ttl": 5, "rdata": {"kind": "S"}}, null, {"name": null, "ok": true}]}}'
    nodes = N.label_nodes(spark.createDataFrame([(1, 1, text)], SCHEMA))
    answers = N.node_table(nodes, "dns.answer", ["name", "ttl", "ok"]).orderBy("pre").collect()
    assert [(r.path, r.name, r.ttl, r.ok) for r in answers] == [
        ("dns/dns.answer[0]", "a", "5", None),
        ("dns/dns.answer[2]", None, None, "true"),
    ]
    parent = N.node_table(nodes, "dns", []).collect()[0]
    assert {r.parent_pre for r in answers} == {parent.pre}
    inner = N.node_table(nodes, "rdata", ["kind"]).collect()[0]
    assert inner.parent_pre == answers[0].pre and answers[0].pre < inner.pre and inner.post < answers[0].post


def test_scalars_in_arrays_and_scalar_layers_stay(spark):
    text = '{"http": {"via": ["a", null, {"x": 1}, ["b", 2]], "n": null}, "note": "s", "flags": [true, {"y": []}]}'
    nodes = {r.path: r for r in N.label_nodes(spark.createDataFrame([(1, 1, text)], SCHEMA)).collect()}
    assert nodes["http"].members == {"via[0]": "a", "via[3][0]": "b", "via[3][1]": "2", "n": None}
    assert nodes[""].members == {"note": "s", "flags[0]": "true"} and nodes[""].parent_pre is None
    assert set(nodes) == {"", "http", "http/via[2]", "flags[1]"} and nodes["http"].parent_pre == nodes[""].pre
    inner, outer = nodes["http/via[2]"], nodes["http"]
    assert (inner.parent_pre, inner.parent_post, inner.parent_path) == (outer.pre, outer.post, "http")
