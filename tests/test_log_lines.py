import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import log_lines as L

SCHEMA = "stream_id bigint, line_no bigint, line_id bigint, raw string"
ACCESS = '10.1.1.1 - - [01/Mar/2024:10:00:00 +0800] "GET /a?b=\\"c\\" HTTP/1.1" 200 51'
LINES = [
    "lost before any entry",
    ACCESS,
    "10.9.9.9 - - nothing",
    ACCESS + ' "-" "agent \\"x\\"" "-"',
    ACCESS + " - 10.2.2.2 80 7",
    "\x1b[31m[Fri Mar 01 10:00:00.123456 2024] [core:Error] [pid 7] text\x1b[0m",
    "Stack trace:",
    "",
    "[Fri Mar  1 10:00:00 2024] [warn] old form\r",
    "﻿2024/03/01 10:00:00 [warn] 7#7: *3 text",
    '2024-03-01 10:00:00.123 CST,"u","db",7,"1.1.1.1:5",s,1,"SELECT",2024-03-01 10:00:00 CST,1/2,0,LOG,00000,"statement: SELECT ""a""',
    ACCESS.replace('"', '""'),
    "[Sat Mar 02 10:00:00 2024] [error] inside the open field",
    ' FROM t",,,,,,,,,"app, v2"',
    "2024-03-01 10:00:00.123 CST [7] user@db LOG:  statement: SELECT 1",
    "\t[Sat Mar 02 10:00:00 2024] [error] indented",
    "Fri Mar 01 10:00:00 2024 1 10.1.1.1 99 /f.txt b _ o r user ftp 0 * RETR",
    "Mar  1 10:00:00 node1 proftpd[7]: debug5: dispatching CMD 'LIST /x'",
]
EXPECTED = [
    (2, 3, "-", "apache"), (4, 4, "-", "nginx"), (5, 5, "-", "apache"), (6, 8, "error", "core"), (9, 9, "warn", "apache"),
    (10, 10, "warn", "nginx"), (11, 14, "log", "postgresql"), (15, 16, "log", "postgresql"), (17, 17, "-", "proftpd"),
    (18, 18, "debug5", "proftpd"),
]


def rows(lines, stream=1, base=0):
    return [(stream, k + 1, base + k + 1, raw) for k, raw in enumerate(lines)]


@pytest.mark.parametrize("block", [1, 2, 3, 5, 8192])
def test_entries_at_any_block_size(spark, block):
    table = rows(LINES)
    lines = spark.createDataFrame(table + table[3:6] + [(None, 1, 99, ACCESS), (1, None, 98, ACCESS)], SCHEMA)
    found = L.parse_entries(lines, block_lines=block).select("first_line_id", "last_line_id", "lvl", "component").collect()
    assert sorted(map(tuple, found)) == EXPECTED


def test_shapes_beyond_the_broadcast_bound_are_joined_by_shuffle(spark):
    lines = spark.createDataFrame(rows(LINES), SCHEMA)
    found = L.parse_entries(lines, max_shapes=1).select("first_line_id", "last_line_id", "lvl", "component").collect()
    assert sorted(map(tuple, found)) == EXPECTED


def test_fields(spark):
    lines = spark.createDataFrame(rows(LINES), SCHEMA).selectExpr("*", "1 as layout", "'x' as message")
    got = {r.first_line_id: r for r in L.parse_entries(lines).collect()}
    assert got[2].url == '/a?b=\\"c\\"' and got[2].stamp_text == "01/Mar/2024:10:00:00 +0800"
    assert got[4].user_agent == 'agent \\"x\\"' and got[5].user_agent is None
    assert got[11].message.startswith('statement: SELECT "a"\n') and got[11].message.endswith(" FROM t")
    assert got[15].statement == "SELECT 1\n\t[Sat Mar 02 10:00:00 2024] [error] indented"
    assert got[17].ftp_command == "RETR" and got[18].ftp_command == "LIST"
    assert got[6].message == "text\nStack trace:\n"
    assert got[11].statement.startswith('SELECT "a"\n') and got[2].statement is None
    # 2024-03-01 02:00 UTC; the zone's clock is eight hours ahead.
    assert {got[k].utc_us // 1_000_000 for k in (2, 6, 9, 10, 11, 15, 17, 18)} == {1709258400} and got[6].utc_us % 1_000_000 == 123_456


def test_zone_abbreviations(spark):
    stamps = ["2024-03-01 10:00:00 CST", "2024-03-01 10:00:00 CET", "2024-03-01 10:00:00 UTC", "2024-03-01 10:00:00 PST", "2024-03-01 10:00:00 XYZ"]
    lines = [f"{stamp} [7] user@db LOG:  x" for stamp in stamps]
    got = {r.first_line_id: r.utc_us for r in L.parse_entries(spark.createDataFrame(rows(lines), SCHEMA)).collect()}
    ten = 1709287200 * 1_000_000
    assert [got[k + 1] for k in range(5)] == [ten - 8 * 3_600_000_000, ten - 3_600_000_000, ten, ten + 8 * 3_600_000_000, None]


def test_statements(spark):
    cases = {
        "statement: SELECT 1": "SELECT 1", "execute S_1: update x\nset y": "update x\nset y", "duration: 1.5 ms  statement: x": "x",
        "DELETE FROM a": "DELETE FROM a", "with q as (x) select": "with q as (x) select", "connection received: host=a port=1": None,
        "selection failed": None, "disconnection: session time": None, "": None, None: None,
    }
    frame = spark.createDataFrame([(k,) for k in cases], "m string")
    assert [r[0] for r in frame.select(L.statement_of(F.col("m"))).collect()] == list(cases.values())


def test_empty_and_null(spark):
    assert L.found_entries(spark.createDataFrame([], SCHEMA)).count() == 0
    lines = spark.createDataFrame(rows([None, ACCESS, None, "x" * 100_000, '"' * 50_001]), SCHEMA)
    assert [tuple(r) for r in L.found_entries(lines).collect()] == [(2, 5, "-", "apache")]


def plain_entries(lines):
    """The same by a plain loop over classified lines: [(layout or None, odd)] to opening flags."""
    opened, out = False, []
    for layout, odd in lines:
        starts = layout is not None and not opened
        out.append(starts)
        csv = layout == L.PG_CSV
        opened = (not opened if odd else opened) if (opened or csv) else False
    return out


def test_random_quote_states_against_a_loop(spark):
    choice = random.Random(5)
    csv = '2024-03-01 10:00:00 CST,"u","db",7,"h",s,1,"T",t,v,x,LOG,c,"m'
    pool = [csv, csv + '"', "plain", 'odd "', "2024/03/01 10:00:00 [warn] 7#7: text", '2024/03/01 10:00:00 [warn] 7#7: a " b']
    data, expected = [], []
    for stream in range(20):
        raws = [choice.choice(pool) for _ in range(40)]
        kinds = [(L.PG_CSV if r.startswith("2024-") else L.NGINX_ERROR if r.startswith("2024/") else None, r.count('"') % 2 == 1) for r in raws]
        data += rows(raws, stream, stream * 100)
        expected += [stream * 100 + k + 1 for k, starts in enumerate(plain_entries(kinds)) if starts]
    found = L.parse_entries(spark.createDataFrame(data, SCHEMA), block_lines=7).select("first_line_id").collect()
    assert sorted(r[0] for r in found) == expected
