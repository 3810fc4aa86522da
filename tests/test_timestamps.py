from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from tracewright.operators import timestamps as TS

SCHEMA = "rec_id bigint, node_id int, stamp_raw string, recv_ts timestamp"
NODES = [(1, "n", "Asia/Shanghai"), (2, "n", "Europe/Berlin"), (3, "n", "America/Chicago"), (4, "n", "No/Zone"), (None, "n", "UTC")]


def us(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp()) * 1_000_000


#: (node, stamp, received, expected microseconds or None)
CASES = [
    (1, "01/Mar/2024:10:00:00 +0800", None, us(2024, 3, 1, 2)),
    (1, "[01/Mar/2024:10:00:00.123 +08:00]", None, us(2024, 3, 1, 2) + 123_000),
    (None, "2024-03-01T10:00:00.1234569Z", None, us(2024, 3, 1, 10) + 123_456),
    (None, " 2024-03-01 10:00:00,5 UTC\t", None, us(2024, 3, 1, 10) + 500_000),
    (2, "2024-03-01 10:00:00.5+0530", None, us(2024, 3, 1, 4, 30) + 500_000),
    (1, "2024-03-01 10:00:00", None, us(2024, 3, 1, 2)),
    (1, "2024-03-01 10:00:00 CST", None, us(2024, 3, 1, 2)),
    (3, "2024-03-01 10:00:00 CST", None, us(2024, 3, 1, 16)),
    (3, "2024-03-01 10:00:00 CDT", None, None),
    (None, "2024-03-01 10:00:00 CST", None, None),
    (None, "2024-03-01 10:00:00", None, None),
    (4, "2024-03-01 10:00:00", None, None),
    (99, "2024-03-01 10:00:00", None, None),
    (2, "2024-03-31 02:30:00", "2024-04-01", None),
    (2, "2024-10-27 02:30:00", "2024-10-27 00:45:00", us(2024, 10, 27, 0, 30)),
    (2, "2024-10-27 02:30:00", "2024-10-28", us(2024, 10, 27, 1, 30)),
    (2, "2024-10-27 02:30:00 CEST", "2024-10-28", us(2024, 10, 27, 0, 30)),
    (2, "2024-10-27 02:30:00 CET", "2024-10-28", us(2024, 10, 27, 1, 30)),
    (2, "Mar 31 02:30:00", "2024-04-01", us(2023, 3, 31, 0, 30)),
    (1, "Jan  1 05:00:00", "2023-12-31 21:30:00", us(2023, 12, 31, 21)),
    (1, "Feb 29 05:00:00", "2026-01-01", us(2024, 2, 28, 21)),
    (1, "Mon Mar  4 10:00:00.25 2024", None, us(2024, 3, 4, 2) + 250_000),
    (1, "Mar  4, 2024 10:00:00.123456789", None, us(2024, 3, 4, 2) + 123_456),
    (1, "Mar  4, 2024 10:00:00.123456789 CST", None, us(2024, 3, 4, 2) + 123_456),
    (None, "1709258400.5", None, 1709258400_500_000),
    (None, '"1709258400123"', None, 1709258400_123_000),
    (None, "1709258400123456", None, 1709258400_123_456),
    (None, "1709258400123456789", None, 1709258400_123_456),
    (2, "1955-07-01 10:00:00", None, us(1955, 7, 1, 9)),
    (3, "2150-07-01 10:00:00 CDT", "2200-01-01", us(2150, 7, 1, 15)),
    (3, "2150-01-01 10:00:00", "2200-01-01", us(2150, 1, 1, 16)),
    (2, "2996-02-29 10:00:00", "3000-01-01", us(2996, 2, 29, 9)),
    (1, "1750-07-01 10:00:00 +0800", None, us(1750, 7, 1, 2)),
    (1, "2150-07-01 10:00:00 LMT", "2200-01-01", None),
    (3, "1700-01-01 00:00:00", None, us(1700, 1, 1, 5, 50, 36)),
    *[(1, bad, "2024-01-01", None) for bad in (None, "", "  ", "-", "[]", "1e", "16:05:09", "2024-03-", "2024-02-30T08:00:00Z", "29/Feb/2023:11:10:09 +0000", "2024-13-01 10:00:00 UTC", "2024-06-01 24:61:00", "Apr 31 25:61:00", "Smarch 3, 2024 10:00:00 UTC", "2024-03-01 10:00:00 +9900", "x" * 100_000)],
]


def test_cases(spark):
    rows = [
        (k, node, stamp, datetime.fromisoformat(recv or "2030-01-01").replace(tzinfo=timezone.utc))
        for k, (node, stamp, recv, _) in enumerate(CASES)
    ]
    records = spark.createDataFrame(rows + rows[:5], SCHEMA).selectExpr("*", "1 as tz_name", "2 as years")
    nodes = spark.createDataFrame(NODES, "node_id int, node_name string, tz_name string")
    got = {r.rec_id: r.utc_us for r in TS.found_instants(records, nodes).collect()}
    wrong = [(c, got.get(k)) for k, c in enumerate(CASES) if got.get(k) != c[3]]
    assert not wrong
    kept = TS.resolve_instants(records, nodes)
    assert kept.columns == [*records.columns, "utc_us"] and kept.count() == len(CASES) + 5


def test_empty(spark):
    nodes = spark.createDataFrame([], "node_id int, node_name string, tz_name string")
    assert TS.found_instants(spark.createDataFrame([], SCHEMA), nodes).count() == 0


def test_zone_periods_agree_with_the_zone():
    for name in ("Australia/Sydney", "America/New_York", "Asia/Kolkata"):
        zone, periods, last = ZoneInfo(name), TS.zone_periods(name), us(TS.LAST_YEAR, 12, 31) // 1_000_000
        assert all(a[1] == b[0] for a, b in zip(periods, periods[1:]))
        for low, high, offset, abbreviation in periods:
            for t in {max(low, -62_000_000_000), min(high - 1, last), (max(low, -10**10) + min(high, last)) // 2}:
                local = (datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=t)).astimezone(zone)
                assert (local.utcoffset().total_seconds(), local.tzname()) == (offset, abbreviation)


def test_integer_days(spark):
    days = [datetime(1999, 12, 31) + timedelta(days=k * 97) for k in range(400)]
    frame = spark.createDataFrame([(d.year, d.month, d.day) for d in days], "y int, m int, d int")
    got = [r[0] for r in frame.selectExpr(TS.days_from_civil("y", "m", "d")).collect()]
    assert got == [(d - datetime(1970, 1, 1)).days for d in days]


def test_years_beyond_the_table_go_by_one_that_is_alike(spark):
    years = [1, 1799, 1800, 2024, 2128, *range(2129, 2600, 7), 2400, 9999]
    frame = spark.createDataFrame([(y,) for y in years], "y int")
    for y, z in zip(years, (r[0] for r in frame.selectExpr(TS.rule_year("y")).collect()), strict=True):
        assert TS.FIRST_YEAR <= z <= TS.LAST_YEAR
        if y > TS.LAST_YEAR:
            assert datetime(y, 1, 1).weekday() == datetime(z, 1, 1).weekday() and datetime(y, 12, 31).weekday() == datetime(z, 12, 31).weekday()
        elif y >= TS.FIRST_YEAR:
            assert y == z
