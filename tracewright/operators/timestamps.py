"""Timestamps of many layouts, precisions and zones to one UTC instant.

All layouts are alternatives of one pattern with named groups; a single pass of it rewrites a stamp
to its components, calendar ranges are checked on integers, and days are counted by integer
arithmetic. Local times are resolved against the periods of constant offset of each zone, so hours
shown twice give two candidates and hours never shown give none.

The period table holds one row a zone; zones are those of the node table, of which the tz database
has under 600, so that its broadcast is bounded.

Defined results: null, blank and unreadable stamps, impossible dates, unknown or null nodes where
the node's clock is needed, and local times never shown give a null instant; years from 1 to 9999 are read (and no row in
``found_instants``). Equal records count once, with the earliest reception. An empty table gives
no rows. Other columns are kept by ``resolve_instants`` whatever their names.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone
from functools import cache
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Local years that the period table holds. Before the first every zone keeps its oldest offset; after the
#: last only yearly rules are left, so a year goes by that one of the last 28 that has the same days.
FIRST_YEAR, LAST_YEAR = 1800, 2128
MAX_ZONES = 1000
#: Years tried backwards for a stamp without year; two leap days are at most eight years apart.
YEARS_BACK = 8
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_NEVER = 9 * 10**15
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def _clock(k: str) -> str:
    return rf"(?<h{k}>\d{{2}}):(?<i{k}>\d{{2}}):(?<s{k}>\d{{2}})(?:[.,](?<f{k}>\d+))?"


def _zone(k: str) -> str:
    return rf"(?: ?(?<z{k}>[+-]\d{{2}}(?::?\d{{2}})?|[A-Za-z]{{1,5}}))?"


#: One alternation for every layout: access log, asctime and syslog, ISO, packet capture, number.
PATTERN = "^(?:" + "|".join(
    [
        r"(?<da>\d{1,2})/(?<ma>[A-Za-z]{3})/(?<ya>\d{4}):" + _clock("a") + _zone("a"),
        r"(?:[A-Za-z]{3},? )?(?<mb>[A-Za-z]{3}) +(?<db>\d{1,2}) " + _clock("b") + r"(?: (?<yb>\d{4}))?" + _zone("b"),
        r"(?<yc>\d{4})[-/](?<nc>\d{2})[-/](?<dc>\d{2})[Tt ]+" + _clock("c") + _zone("c"),
        r"(?<md>[A-Za-z]{3}) +(?<dd>\d{1,2}), (?<yd>\d{4}) " + _clock("d") + _zone("d"),
        r"(?<e>\d{1,20})(?:\.(?<g>\d+))?",
    ]
) + ")$"

_FIELDS = {
    "y": ["ya", "yb", "yc", "yd"],
    "m": ["ma", "mb", "md"],
    "n": ["nc"],
    "d": ["da", "db", "dc", "dd"],
    "h": ["ha", "hb", "hc", "hd"],
    "i": ["ia", "ib", "ic", "id"],
    "s": ["sa", "sb", "sc", "sd"],
    "f": ["fa", "fb", "fc", "fd"],
    "z": ["za", "zb", "zc", "zd"],
    "e": ["e"],
    "g": ["g"],
}
_MARK, _CUT = "﷐", "﷑"
_REWRITE = _MARK + _CUT.join("".join(f"${{{g}}}" for g in groups) for groups in _FIELDS.values())


def days_from_civil(year: str, month: str, day: str) -> str:
    """SQL text: days since 1970-01-01 of a proleptic Gregorian date, in integers."""
    y = f"({year} - IF({month} <= 2, 1, 0))"
    era = f"({y} div 400)"
    of_era = f"({y} - {era} * 400)"
    of_year = f"((153 * ({month} + IF({month} > 2, -3, 9)) + 2) div 5 + {day} - 1)"
    return f"({era} * 146097 + {of_era} * 365 + {of_era} div 4 - {of_era} div 100 + {of_year} - 719468)"


def days_in_month(year: str, month: str) -> str:
    """SQL text: the days that a month has."""
    leap = f"({year} % 4 = 0 AND ({year} % 100 <> 0 OR {year} % 400 = 0))"
    return f"(CASE WHEN {month} = 2 THEN IF({leap}, 29, 28) WHEN {month} IN (4, 6, 9, 11) THEN 30 ELSE 31 END)"


def zone_periods(name: str) -> list[tuple[int, int, int, str]]:
    """(from, to, offset, abbreviation) in seconds: spans of UTC in which a zone's clock is constant."""
    zone = ZoneInfo(name)

    def state(t: int) -> tuple[int, str]:
        local = (_EPOCH + timedelta(seconds=t)).astimezone(zone)
        return int(local.utcoffset().total_seconds()), local.tzname()

    start = int((datetime(FIRST_YEAR, 1, 1, tzinfo=timezone.utc) - _EPOCH).total_seconds())
    end = int((datetime(LAST_YEAR + 1, 1, 3, tzinfo=timezone.utc) - _EPOCH).total_seconds())
    settled = int((datetime(2090, 1, 1, tzinfo=timezone.utc) - _EPOCH).total_seconds())
    spans, begun, now = [], -_NEVER, state(start)
    t = start
    while t < end:
        # Some zones changed their clocks for weeks only; yearly rules do not.
        later = min(t + (6 if t < settled else 30) * 86400, end)
        if (then := state(later)) != now:
            low, high = t, later
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if state(middle) == now else (low, middle)
            spans.append((begun, high, *now))
            begun, now = high, state(high)
            t = high
            continue
        t = later
    return [*spans, (begun, _NEVER, *now)]


def _local_year(t: int, offset: int) -> int:
    return FIRST_YEAR if t == -_NEVER else LAST_YEAR if t >= _NEVER - 1 else (_EPOCH + timedelta(seconds=t + offset)).year


@cache
def zone_years(name: str) -> list[list[tuple[int, int, int, str]]] | None:
    """By local year from FIRST_YEAR, the periods that touch it; None for a name that no clock can show."""
    try:
        periods = zone_periods(name)
    except (KeyError, ValueError, OSError):
        return None
    years: list[list] = [[] for _ in range(FIRST_YEAR, LAST_YEAR + 1)]
    for low, high, offset, abbreviation in periods:
        for year in range(_local_year(low, offset), min(_local_year(high - 1, offset), LAST_YEAR) + 1):
            years[year - FIRST_YEAR].append((low, high, offset, abbreviation))
    return years


def zone_table(spark: SparkSession, names: list[str]) -> DataFrame:
    """(tz_name, years): for each zone an array by local year, from FIRST_YEAR, of the periods that touch it."""
    rows = [(name, years) for name in names if (years := zone_years(name)) is not None]
    schema = "tz_name string, years array<array<struct<lo: bigint, hi: bigint, off: int, abbr: string>>>"
    return spark.createDataFrame(rows, schema)


def rule_year(year: str) -> str:
    """SQL text: the year of the period table whose days and clock changes are those of ``year``."""
    alike = {}
    for y in range(LAST_YEAR - 27, LAST_YEAR + 1):
        alike.setdefault((int(y % 4 == 0), date(y, 1, 1).weekday()), y)
    table = f"array({', '.join(str(alike[leap, day]) for leap in (0, 1) for day in range(7))})"
    leap = f"IF({days_in_month(year, '2')} = 29, 7, 0)"
    # 1970-01-01 was a Thursday, the fourth day counted from Monday.
    day = f"pmod({days_from_civil(year, '1', '1')} + 3, 7)"
    return f"(CASE WHEN {year} < {FIRST_YEAR} THEN {FIRST_YEAR} WHEN {year} <= {LAST_YEAR} THEN {year} ELSE {table}[cast({leap} + {day} as int)] END)"


def components(stamp: Column) -> Column:
    """The components of a stamp as an array of texts in the order of the pattern's fields, else null."""
    bare = F.btrim(stamp, F.lit(" \t\r\n\x0b\x0c\"'[](){}<>"))
    rewritten = F.regexp_replace(bare, PATTERN, _REWRITE)
    return F.when(rewritten.startswith(_MARK), F.split(F.substring(rewritten, 2, 2**31 - 1), _CUT))


def resolve_instants(
    records: DataFrame,
    nodes: DataFrame,
    stamp: str = "stamp_raw",
    node: str = "node_id",
    received: str = "recv_ts",
    out: str = "utc_us",
) -> DataFrame:
    """``records`` with the instant of ``stamp`` as microseconds since 1970 in a new column ``out``."""
    spark = records.sparkSession
    names = [r[0] for r in nodes.select("tz_name").filter("tz_name is not null").distinct().limit(MAX_ZONES + 1).collect()]
    if len(names) > MAX_ZONES:
        raise ValueError(f"more than {MAX_ZONES} zones; the tz database has fewer")
    zones = F.broadcast(zone_table(spark, names))
    clocks = nodes.filter("node_id is not null").groupBy("node_id").agg(F.min("tz_name").alias("tz_name"))
    clocks = clocks.select(F.col("node_id").alias("__node"), "tz_name").withColumnRenamed("tz_name", "__tz")
    zones = zones.select(F.col("tz_name").alias("__tz"), F.col("years").alias("__years"))
    parts = records.withColumn("__p", components(F.col(stamp)))
    for k, name in enumerate(_FIELDS):
        field = F.element_at("__p", k + 1)
        parts = parts.withColumn(f"__{name}", F.when(field != "", field))
    month = F.instr(F.lit(_MONTHS), F.lower("__m"))
    parts = parts.withColumns(
        {
            "__month": F.coalesce(
                F.expr("try_cast(__n as int)"), F.when((month > 0) & ((month - 1) % 3 == 0), F.floor((month + 2) / 3).cast("int"))
            ),
            "__year": F.expr("try_cast(__y as int)"),
            "__day": F.expr("try_cast(__d as int)"),
            "__tod": F.expr("IF(__h < 24 AND __i < 60 AND __s < 60, (__h * 60 + __i) * 60 + __s, NULL)").cast("bigint"),
            "__frac": F.coalesce(F.expr("cast(rpad(substring(__f, 1, 6), 6, '0') as bigint)"), F.lit(0).cast("bigint")),
            "__recv": F.unix_micros(F.col(received).cast("timestamp")),
        }
    ).withColumns(
        {
            "__fixed": F.expr(
                """CASE WHEN upper(__z) IN ('Z', 'UTC') THEN 0
                   WHEN __z RLIKE '^[+-]' AND substring(__z, 2, 2) <= '15'
                        AND coalesce(nullif(substring(replace(__z, ':', ''), 4, 2), ''), '00') <= '59'
                   THEN IF(__z LIKE '-%', -1, 1) * (cast(substring(__z, 2, 2) as int) * 3600
                        + cast(coalesce(nullif(substring(replace(__z, ':', ''), 4, 2), ''), '00') as int) * 60) END"""
            ),
            "__abbr": F.expr("CASE WHEN __z RLIKE '^[A-Za-z]' AND upper(__z) NOT IN ('Z', 'UTC') THEN __z END"),
            "__ok": F.expr("__month BETWEEN 1 AND 12 AND __day BETWEEN 1 AND 31 AND __tod IS NOT NULL"),
        }
    )
    joined = parts.join(clocks, F.col(node) == F.col("__node"), "left").join(zones, "__tz", "left")
    local = f"cast({days_from_civil('yy', '__month', '__day')} as bigint) * 86400 + __tod"
    # Seconds between the year and the one it goes by, none for years of the table.
    moved = f"IF(yy <= {LAST_YEAR}, 0L, ({days_from_civil('yy', '1', '1')} - {days_from_civil(rule_year('yy'), '1', '1')}) * 86400L)"
    fits = "s.l - s.m - p.off >= p.lo AND s.l - s.m - p.off < p.hi AND (__abbr IS NULL OR p.abbr = __abbr)"
    periods = f"get(__years, cast({rule_year('s.y')} as int) - {FIRST_YEAR})"
    around = f"sequence(year(timestamp_micros(__recv)) + 1, year(timestamp_micros(__recv)) - {YEARS_BACK}, -1)"
    # The local second of each year tried is computed once; dates that a year lacks drop out.
    tried = f"""
        filter(transform(IF(__year IS NOT NULL, array(__year), {around}),
            yy -> named_struct('y', yy, 'm', {moved}, 'l', IF(__day > {days_in_month('yy', '__month')}, NULL, {local}))), s -> s.l IS NOT NULL)"""
    candidates = f"""
        flatten(transform({tried}, s -> coalesce(IF(__fixed IS NOT NULL, array((s.l - __fixed) * 1000000 + __frac),
            transform(filter({periods}, p -> {fits}), p -> (s.l - p.off) * 1000000 + __frac)), array())))"""
    whole = f"""IF(__day > {days_in_month('__year', '__month')}, NULL,
        (cast({days_from_civil('__year', '__month', '__day')} as bigint) * 86400 + __tod - __fixed) * 1000000 + __frac)"""
    chosen = f"""transform(array({candidates}), c ->
        IF(__year IS NOT NULL AND size(c) = 1, c[0], array_max(filter(c, t -> t <= __recv))))[0]"""
    number = """
        CASE WHEN length(__e) <= 11 THEN cast(__e as bigint) * 1000000 + coalesce(cast(rpad(substring(__g, 1, 6), 6, '0') as bigint), 0)
             WHEN length(__e) <= 14 THEN cast(__e as bigint) * 1000 + coalesce(cast(rpad(substring(__g, 1, 3), 3, '0') as bigint), 0)
             WHEN length(__e) <= 17 THEN cast(__e as bigint)
             ELSE cast(substring(__e, 1, length(__e) - 3) as bigint) END"""
    # Stamps with year and offset need neither the node's clock nor the reception.
    clock = "__fixed IS NOT NULL OR __z IS NULL OR __abbr IS NOT NULL"
    instant = f"""CASE WHEN __e IS NOT NULL THEN {number} WHEN NOT coalesce(__ok, false) THEN NULL
        WHEN __year IS NOT NULL AND __fixed IS NOT NULL THEN {whole}
        WHEN {clock} THEN {chosen} END"""
    return joined.withColumn(out, F.expr(instant)).select(*[F.col(f"`{c}`") for c in records.columns], out)


def found_instants(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """(rec_id, utc_us) of every record whose stamp names an instant."""
    resolved = resolve_instants(records.select("rec_id", "node_id", "stamp_raw", "recv_ts"), nodes)
    # Filtered after the aggregate: a filter before it would be pushed down and resolve every stamp twice.
    return resolved.groupBy("rec_id").agg(F.min("utc_us").alias("utc_us")).filter("utc_us is not null and rec_id is not null")
