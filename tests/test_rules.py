from pyspark.sql import functions as F

from tracewright.operators import rules as R
from tracewright.plans import pipeline as P

APP = "app_seq int, at int, host string, url string, port string, pid string, state string, statement string"
NET = "net_seq int, at int, src string, dst string, src_port string, dst_port string, protocol string, payload string, uri string, file string"


def app(seq, at=0, host=None, url=None, port=None, pid=None, state=None, statement=None):
    return (seq, at, host, url, port, pid, state, statement)


def net(seq, at=0, src="a", dst="b", sp="1", dp="80", protocol="HTTP", payload=None, uri=None, file=None):
    return (seq, at, src, dst, sp, dp, protocol, payload, uri, file)


def labels(spark, program, apps, nets):
    got = R.correlate(program, spark.createDataFrame(apps, APP), spark.createDataFrame(nets, NET))
    return {r.net_seq: r.app_seq for r in got.collect()}


def test_first_and_last_wins(spark):
    apps = [app(1, host="a", url="/x"), app(2, host="a", url="/y"), app(3, host="q", url="/z")]
    nets = [net(1), net(2, src="c", dst="a"), net(3, src="c", dst="d", payload="/z"), net(4, src="c", dst="d", payload="/z", protocol="tcp"), net(5, src=None, dst=None)]
    assert labels(spark, "apache", apps, nets) == {1: 1, 2: 1, 3: 3, 4: None, 5: None}
    assert labels(spark, "proftpd", apps, nets) == {1: 2, 2: 2, 3: 3, 4: None, 5: None}
    assert labels(spark, "mini_httpd", apps, nets) == {1: 1, 2: 1, 3: None, 4: None, 5: None}
    assert set(labels(spark, "vim", apps, nets).values()) == {None}


def test_ports_and_ends(spark):
    apps = [app(1, host="a", port="1"), app(2, host="a", port="2")]
    nets = [net(1, protocol="TCP"), net(2, sp="9", protocol="TCP"), net(3, sp="9")]
    assert labels(spark, "redis", apps, nets) == {1: 1, 2: None, 3: 2}
    ssh = [app(1, port="5", state="Connect"), app(2, port="5", state="Disconnect")]
    nets = [net(k, at=k, sp="5") for k in range(1, 11)]
    assert labels(spark, "openssh", ssh, nets) == {1: 1, 2: 1, 3: 1, 4: None, 5: None, 6: None, 7: 2, 8: 2, 9: 2, 10: 2}


def test_rank_matched_requests_follow_their_connection(spark):
    apps = [app(1, 1, "a", "/x"), app(2, 2, "a", "/x"), app(3, 3, "a", "/none")]
    nets = [net(1, 1, payload="/x", sp="1"), net(2, 2, payload="/x", sp="2"), net(3, 3, "b", "a", "80", "2", "TCP"), net(4, 4, sp="7", protocol="TCP"), net(5, 5, "b", "a", "80", "7", "TCP")]
    assert labels(spark, "php", apps, nets) == {1: 1, 2: 2, 3: 2, 4: None, 5: None}
    assert labels(spark, "nginx", apps, nets) == {1: 1, 2: 2, 3: 2, 4: 3, 5: 3}


def test_statements_and_uploads(spark):
    apps = [app(1, 1, port="1", statement="s"), app(2, 5, port="3", statement="t"), app(3, 9, port="4", statement="t")]
    nets = [net(1, 2, sp="1"), net(2, 4, sp="8", payload="t"), net(3, 6, sp="8", payload="t"), net(4, 10, sp="8", payload="t")]
    assert labels(spark, "postgres", apps, nets) == {1: 1, 2: 2, 3: 3, 4: None}
    apps = [app(1, 1, pid="7"), app(2, 2, pid="7"), app(3, 3, pid="8")]
    nets = [net(1, 1, src=None, file="f"), net(2, 2, src=None), net(3, 3, src=None, file="g"), net(4, 4, src=None, file="h")]
    assert labels(spark, "imagemagick", apps, nets) == {1: 1, 2: None, 3: 3, 4: None}


def test_compression_and_predicates(spark):
    frame = spark.createDataFrame([net(1, 1), net(2, 2), net(3, 3, payload="p")], NET).withColumn("app_seq", F.lit(1))
    assert sorted(r.net_seq for r in R.compressed(frame).collect()) == [1, 3]
    rows = spark.createDataFrame([(1, "a", 80), (2, "b", 80), (3, None, 80)], "i int, ip string, port int")
    assert [r.i for r in rows.filter(R.fits_any([{"ip": "a", "port": "80"}, {"ip": "c"}])).collect()] == [1]
    classes = {"one": ["x", "y"], "two": ["x"]}
    got = spark.createDataFrame([("xy",), ("x",), ("z",)], "r string").select(R.equality_class(F.col("r"), classes)).collect()
    assert [r[0] for r in got] == ["one", "two", None]
    assert R.augmented(rows, "i", {1: 3}).count() == 5


def test_stages_end_to_end(spark):
    edges = [(g * 10 + k, g, f"p{g % 2}", f"/f{(g % 2) * 5 + k}", "write", k * 1000, k * 1000 + 10) for g in range(8) for k in range(4)]
    frame = spark.createDataFrame(edges, "event_id bigint, graph_id bigint, src string, dst string, relation string, start bigint, `end` bigint")
    cut = P.cut_graphs(frame, noise=["/f8"])
    assert cut.filter("dst = '/f8'").count() == 0
    ends = cut.select(F.col("src").alias("name")).union(cut.select("dst")).distinct()
    entities = ends.select("name", F.array(F.pmod(F.xxhash64("name"), F.lit(97)).cast("double"), F.lit(1.0)).alias("vec"))
    relations = spark.createDataFrame([("write", [0.5])], "name string, vec array<double>")
    vectors = P.pool(cut, P.event_vectors(cut, entities, relations), "uniform")
    truth = frame.select("graph_id", (F.col("graph_id") % 2).cast("int").alias("label")).distinct()
    scores = P.classify(vectors, truth).first()
    assert scores.accuracy == 1 and scores.f1 == 1
    assert {r.slice for r in P.graph_snapshots(frame).select("slice").distinct().collect()} == {0, 1, 2, 3, 4}
