from tracewright.operators import bad_rows as B

SCHEMA = "row_id bigint, feed string, raw string"
OK = '10.1.1.1 - u [01/Mar/2024:10:00:00 +0800] "GET /a b HTTP/1.1" 200 51'
FTP = "Fri Mar 01 10:00:00 2024 1 10.1.1.1 99 /f.txt b _ o r user ftp 0 * RETR"

#: (feed, raw, reason or None)
CASES = [
    ("ApacheLog", OK, None),
    ("PhpLog", OK + " - 10.2.2.2 80 7", None),
    ("ApacheLog", OK.replace(" ", "\t", 3) + "  \r", None),
    ("ApacheLog", OK.replace("51", "-"), None),
    ("ApacheLog", OK.replace("/a b", '/a?\\"q\\" \\\\'), None),
    ("ApacheLog", OK.replace("51", "0000000000000000000000051"), None),
    ("ApacheLog", OK.replace("51", "9223372036854775807"), None),
    ("ApacheLog", OK.replace("51", "9223372036854775808"), "value"),
    ("ApacheLog", OK.replace("51", "٥١"), "value"),
    ("ApacheLog", OK.replace("200", "600"), "value"),
    ("ApacheLog", OK.replace("200", "0200"), "value"),
    ("ApacheLog", OK.replace("200", "２００"), "value"),
    ("ApacheLog", OK.replace('HTTP/1.1"', 'HTTP/1.1\\"'), "quoting"),
    ("ApacheLog", OK + '"', "quoting"),
    ("ApacheLog", OK + " extra", "columns"),
    ("ApacheLog", OK.replace("+0800]", "+0800"), "columns"),
    ("ApacheLog", None, "columns"),
    ("ApacheLog", " \t ", "columns"),
    ("ApacheLog", '"', "quoting"),
    ("ProftpdLog", FTP, None),
    ("ProftpdLog", FTP.replace("/f.txt", '"/f [a.txt _ c"'), None),
    ("ProftpdLog", FTP.replace("/f.txt", "/f\\ [x"), None),
    ("ProftpdLog", FTP.replace(" _ ", " C "), "value"),
    ("ProftpdLog", FTP.replace(" 99 ", " - "), "value"),
    ("ProftpdLog", FTP + " more", "columns"),
    (None, OK, "columns"),
    ("ApacheLog", OK.replace("/a b", "/" + "a " * 60_000), None),
    ("ApacheLog", OK.replace("/a b", '\\"' * 60_000), None),
    ("ApacheLog", "[" * 60_000, "columns"),
]


def test_cases(spark):
    rows = [(k, feed, raw) for k, (feed, raw, _) in enumerate(CASES)]
    table = spark.createDataFrame(rows + rows, SCHEMA).selectExpr("*", "1 as n", "2 as reason")
    good, bad = B.split_rows(table)
    got = {r.row_id: r.reason for r in B.found_failures(table).collect()}
    assert got == {k: c[2] for k, c in enumerate(CASES) if c[2]}
    assert bad.count() == len(got)
    loaded = {r.row_id: r for r in good.collect()}
    assert sorted(loaded) == [k for k, c in enumerate(CASES) if c[2] is None]
    assert loaded[0].request == "GET /a b HTTP/1.1" and loaded[0].response_code == 200 and loaded[0].transfer_size == 51
    assert loaded[0].time == "01/Mar/2024:10:00:00 +0800" and loaded[3].transfer_size is None
    assert loaded[4].request == 'GET /a?"q" \\ HTTP/1.1' and loaded[5].transfer_size == 51
    assert loaded[20].file == "/f [a.txt _ c" and loaded[21].file == "/f [x" and loaded[19].ftp_command == "RETR"


def test_empty(spark):
    good, bad = B.split_rows(spark.createDataFrame([], SCHEMA))
    assert good.count() == 0 and bad.count() == 0
