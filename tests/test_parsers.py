from pyspark.sql import functions as F

from tracewright.functions import names, parsers
from tracewright.sources import readers

SAMPLES = {
    "apache": ('10.0.0.5 - - [01/Mar/2024:10:00:00 +0800] "GET /a/b.gif HTTP/1.1" 200 512 - 10.0.0.9 80 4242', {"host": "10.0.0.5", "method": "GET", "url": "/a/b.gif", "response_code": "200", "dst_ip": "10.0.0.9", "dst_port": "80", "pid": "4242"}),
    "nginx": ('10.0.0.5 - - [01/Mar/2024:10:00:00 +0800] "GET /f.txt HTTP/1.1" 200 512 "-" "agent/1.0" "-"', {"user_agent": "agent/1.0", "referer": "-", "url": "/f.txt"}),
    "openssh": ("Mar  1 10:00:00 host sshd[77]: Accepted password for bob from 10.0.0.5 port 4022 ssh2", {"pid": "77", "user": "bob", "ip": "10.0.0.5", "port": "4022", "state": "Connect"}),
    "redis": ('1709258400.5 [0 10.0.0.5:5001] "GET" "k1"', {"time": "1709258400.5", "ip": "10.0.0.5", "port": "5001", "command": "GET", "content": '"k1"'}),
    "vim": ("1709258400\t2024-03-01\t12\tBufRead\t\t/d\tf.txt\tp", {"pid": "12", "action": "BufRead", "file": "f.txt"}),
    "imagemagick": ('2024-03-01T10:00:00+08:00 x Policy convert[77]: y rights=Read; pattern="/u/x.png" z', {"pid": "77", "rights": "Read", "path": "/u/x.png"}),
    "proftpd": ("Fri Mar 01 10:00:00 2024 1 10.1.1.1 99 /f.txt b _ o r user ftp 0 * RETR", {"host": "10.1.1.1", "transfer_size": "99", "ftp_command": "RETR", "transfer_status": "_"}),
    "postgres": ('2024-03-01 10:00:00.123 CST,"u","db",7,"1.1.1.1:5",s,1,"SELECT",2024-03-01 10:00:00 CST,1/2,0,LOG,00000,"statement: SELECT ""a"", b",,,,,,,,,"app"', {"user": "u", "session": "7", "statement": 'SELECT "a", b'}),
    "network": ("1\tMar  1, 2024 10:00:00.5\t10.0.0.5\t10.0.0.9\tHTTP\t5001,80\t\t99\tGET /a.txt HTTP/1.1", {"src_ip": "10.0.0.5", "dst_port": "80", "method": "GET", "filename": "/a.txt", "layout": 1, "ts_us": 1709258400500000}),
    "mini_httpd": ('10.0.0.5 - - [01/Mar/2024:10:00:00 +0800] "GET /f HTTP/1.1" 200 512 "-" "agent/1.0"', {"path": "/f", "status": "200", "user_agent": "agent/1.0", "ts_us": 1709258400000000}),
    "php": ('10.0.0.5 - - [01/Mar/2024:10:00:00 +0000] "GET /f HTTP/1.1" 200 512', {"url": "/f", "ts_us": 1709258400000000}),
}


def test_golden_lines(spark):
    for layout, (line, expected) in SAMPLES.items():
        got, bad = readers.parsed_log(spark.createDataFrame([(line,), ("nonsense",)], "line string"), layout)
        row = got.collect()
        assert len(row) == 1, layout
        fields = row[0].fields.asDict()
        assert {k: fields[k] for k in expected} == expected, (layout, fields)
        assert [r.line for r in bad.collect()] == ["nonsense"]


def test_key_values_and_texts(spark):
    one = spark.range(1).select(
        parsers.key_values(F.lit('a=1 b="x y" c=two words d= a=9')).alias("kv"), parsers.last_replaced(F.lit("a/b/a"), "a", "z").alias("l"),
        parsers.file_of_header(F.lit('x; filename="q.txt"')).alias("f"), parsers.payload_relevant(F.lit("in /x/y"), F.lit("/srv/x"), "/srv").alias("p"),
        parsers.json_cleaned(F.lit("{'a': None, 'b': True}")).alias("j"),
    ).first()
    assert one.kv == {"b": "x y", "c": "two words", "d": "", "a": "9"}
    texts = [("{'a': \"it's None\", 'b': None}", '{"a": "it\'s None", "b": null}'), ("{'q': 'say \"x\"', 'Nonet': True}", '{"q": "say \\"x\\"", "Nonet": true}')]
    got = spark.createDataFrame(texts, "a string, b string").select(parsers.json_cleaned(F.col("a")), "b").collect()
    assert [r[0] for r in got] == [r[1] for r in got]
    assert one.l == "a/b/z" and one.f == "q.txt" and one.p == 1 and one.j == '{"a": null, "b": true}'


def test_network_layouts(spark):
    ends, ip = "7\t1709258400.25\t10.0.0.5\t10.0.0.9\t", "  7   1.5 10.0.0.5 → 10.0.0.9 "
    lines = [
        ends + "HTTP\t50,80\t\t9\tGET /a HTTP/1.1", ends + "HTTP\t50,80\t\t9\tHTTP/1.1 200 OK yes", ends + "TCP\t\t50,80\t9\tACK here",
        ends + "TCP\t50,80\t\t9\tACK", ends + "TLS-x\t50,80\t\t9\tHello", ends + "TLS v1.2\t50,80\t\t9\tHello", ends + "ARP\t\t\t\twho has",
        ends + "TCP\t50,80\t\tno length", ends + "ICMP\t\t\t9\tping", ip + "HTTP 9 POST /f HTTP/1.1", ip + "TCP 9 50 → 80 [SYN]", ip + "DNS query",
    ]
    rows = [parsers.network_text(F.col("line")).alias("f")]
    got = [r.f for r in spark.createDataFrame([(x,) for x in [*lines, "none"]], "line string").select(*rows).collect()]
    assert [r.layout for r in got] == [*range(1, 13), None]
    assert {r.src_ip for r in got[:12]} == {"10.0.0.5"} and got[0].ts_us == 1709258400250000 and got[11].ts_us == 1500000
    assert (got[1].code, got[1].protocol, got[2].filename, got[4].protocol_name, got[6].text, got[9].method, got[10].dst_port) == ("200", "HTTP/1.1", "ACK here", "TLS-x", "who has", "POST", "80")


def test_redis_scripts(spark):
    head = '1709258400.5 [0 10.0.0.5:5001] "SCRIPT" "LOAD" '
    script = head + r'"local f = package.loadlib(\"/lib/x.so\", \"luaopen_io\"); local g = io.popen(\"id -u\", \"r\"); local r = g:read(\"*a\"); return r"'
    plain = '1709258400.5 [0 10.0.0.5:5001] "SET" "io.popen(a, b)"'
    a, b = (r.f for r in spark.createDataFrame([(script,), (plain,)], "line string").select(parsers.redis(F.col("line")).alias("f")).collect())
    assert (a.lib_path, a.function, a.command, a.content, a.command_mode, a.file_mode) == ("/lib/x.so", "luaopen_io", "id", "-u", "r", "*a")
    assert (b.command, b.lib_path, b.command_mode) == ("SET", None, None) and b.ts_us == 1709258400500000


def test_names(spark):
    cases = {"//a/./b/../c/": "/a/c", "/../x": "/x", "a/../../b": "../b", "/": "/", "/plain": "/plain", "..": ".."}
    got = spark.createDataFrame(list(cases.items()), "a string, b string").select("a", names.file_path(F.col("a")).alias("c")).collect()
    assert {r.a: r.c for r in got} == cases
    sockets = {"10.0.0.1:80": "10.0.0.1:80", "::ffff:10.0.0.1/080": "10.0.0.1:80", "[::FFFF:10.00.0.1]:80": "10.0.0.1:80", "[FE80::1]:5": "fe80::1:5"}
    got = spark.createDataFrame(list(sockets.items()), "a string, b string").select("a", names.socket(F.col("a")).alias("c")).collect()
    assert {r.a: r.c for r in got} == sockets
    numbers = {" 007 ": 7, '7"': 7, "[7]": 7, "7.0": 7, "-1": None, "port": None, "": None}
    got = spark.createDataFrame(list(numbers.items()), "a string, b int").select("a", names.number(F.col("a")).alias("c")).collect()
    assert {r.a: r.c for r in got} == numbers


def test_readers(spark, tmp_path):
    (tmp_path / "t.txt").write_text("a r b\n\n c  s  d \n")
    assert sorted(map(tuple, readers.triples(spark, str(tmp_path / "t.txt")).collect())) == [("a", "r", "b"), ("c", "s", "d")]
    (tmp_path / "e.txt").write_text("2\n/bin/my file\t0\nx 1\n")
    assert sorted(map(tuple, readers.id_names(spark, str(tmp_path / "e.txt")).collect())) == [("/bin/my file", 0), ("x", 1)]
    (tmp_path / "i.txt").write_text("2\n0 1 2\n0 1 2\n3 4 5\n")
    assert sorted(map(tuple, readers.id_triples(spark, str(tmp_path / "i.txt")).collect())) == [(0, 1, 2), (3, 4, 5)]
    (tmp_path / "v.txt").write_text("0\tsys_read\t[0.5, -1e-3]\nname\t1 2\n")
    assert {r.name: r.vec for r in readers.vectors(spark, str(tmp_path / "v.txt")).collect()} == {"sys_read": [0.5, -0.001], "name": [1.0, 2.0]}
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "lr_1.txt").write_text("MRR: 0.5\nHits: 0.7\n")
    (tmp_path / "r" / "lr_2.txt").write_text("MRR: 0.5\n")
    assert [(r.MRR, r.Hits) for r in readers.result_metrics(spark, str(tmp_path / "r"), ["MRR", "Hits"]).collect()] == [(0.5, 0.7)]
    packet = '{"_source": {"layers": {"frame": {"frame.time_epoch": "1.5"}, "ip": {"ip.src": "a", "ip.dst": "b"}, "tcp": {"tcp.srcport": "1", "tcp.dstport": "2"}, "http": {"GET /": {"http.request.method": "GET", "http.request.uri": "/"}}}}}'
    (tmp_path / "p.json").write_text(packet + "\n" + packet.replace('"ip":', '"ipv6": {"ipv6.src": "x"}, "ip":') + "\n")
    rows = readers.packets(spark, str(tmp_path / "p.json")).collect()
    assert [(r.src_ip, r.dst_port, r.method, r.uri) for r in rows] == [("a", "2", "GET", "/")]
    assert readers.parameter_grid(spark, {"lr": [1, 2], "dim": [3]}).count() == 2


def test_process_samples(spark):
    import os

    rows = readers.process_samples(spark, os.getpid(), 0.01, 3).collect()
    assert len(rows) == 3 and all(r.memory_mb > 0 for r in rows)
    assert readers.process_samples(spark, 2**22 + 1, 0.01, 3).count() == 0


def test_proftpd_rows_with_quotes_and_white_space(spark, tmp_path):
    from tracewright.plans import log_queries

    rest = "b _ o r user ftp 0 * RETR"
    raws = {
        1: f"Fri Mar 01 10:00:00 2024 1 10.1.1.1 99 /f.txt {rest}",
        2: f'Mon Jan 01 10:00:00 2024 1 10.1.1.1 99 "/pub/a b.php" {rest}\r',
        3: f'Mon  Jan\t1 10:00:00 2024  1 10.1.1.1 99 "/pub/\\"q\\" \\\\x" {rest}  ',
        4: f'Mon Jan 01 10:00:00 2024 1 10.1.1.1 99 "/pub/a b.php {rest}',
        5: "too few",
        6: None,
    }
    rows = [(k, "ProftpdLog", raw) for k, raw in raws.items()] + [(2, "ProftpdLog", raws[2]), (7, "PhpLog", raws[1])]
    spark.createDataFrame(rows, "row_id bigint, feed string, raw string").write.parquet(str(tmp_path / "accessrows.parquet"))
    got = {r.row_id: (r.time, r.host, r.file, r.transfer_status, r.ftp_command) for r in log_queries.proftpd_fields(spark, str(tmp_path)).collect()}
    same = ("10.1.1.1", "_", "RETR")
    assert got == {
        1: ("Fri Mar 01 10:00:00 2024", same[0], "/f.txt", *same[1:]),
        2: ("Mon Jan 01 10:00:00 2024", same[0], "/pub/a b.php", *same[1:]),
        3: ("Mon Jan 1 10:00:00 2024", same[0], '/pub/"q" \\x', *same[1:]),
        4: (None,) * 5, 5: (None,) * 5, 6: (None,) * 5,
    }


def test_apache_rows_with_escapes_and_white_space(spark, tmp_path):
    from tracewright.plans import log_queries

    head, tail = "10.0.0.5 - - [01/Mar/2024:10:00:00 +0800]", "404 51"
    raws = {
        1: f'{head} "GET /a HTTP/1.1" 200 51 - 10.0.0.9 80 42',
        2: f'{head} "GET /x.php?q=\\"a\\" HTTP/1.1" {tail}',
        3: f'{head}\t"GET  /a b HTTP/1.1"   404\t51  \r',
        4: f'{head} "GET /a HTTP/1.1 {tail}',
        5: f'{head} "GET /a HTTP/1.1" 304 51 - 443 10659',
        6: None,
    }
    rows = [(k, "ApacheLog", raw) for k, raw in raws.items()] + [(2, "ApacheLog", raws[2])]
    spark.createDataFrame(rows, "row_id bigint, feed string, raw string").write.parquet(str(tmp_path / "accessrows.parquet"))
    got = {r.row_id: (r.host, r.response_code, r.transfer_size, r.dst_ip, r.pid, r.method) for r in log_queries.apache_fields(spark, str(tmp_path)).collect()}
    assert got == {
        1: ("10.0.0.5", "200", "51", "10.0.0.9", "42", "GET"), 2: ("10.0.0.5", "404", "51", None, None, "GET"),
        3: ("10.0.0.5", "404", "51", None, None, "GET"), 4: (None,) * 6, 5: (None,) * 6, 6: (None,) * 6,
    }
    request = spark.range(1).select(parsers.apache(F.lit(raws[2])).alias("f")).first().f
    assert (request.request, request.url) == ('GET /x.php?q="a" HTTP/1.1', '/x.php?q="a"')
    assert {r.host: (r.n, r.failed) for r in log_queries.host_activity(spark, str(tmp_path)).collect()} == {"10.0.0.5": (3, 2), None: (3, 0)}
