"""Log entries out of mixed, interleaved, multi-line streams.

Three steps, none of which puts a whole stream into one task:

1. *Signatures.* Every line is collapsed to the shape of its first tokens. Each distinct shape is
   resolved to a layout once; the shape-to-layout table is broadcast after its size was checked,
   and joined by shuffle where it is larger. The layout's exact pattern then reads the whole line.
2. *Blocks.* Whether a quoted CSV field is still open is a two-state machine over the lines of a
   stream. Every line is one of three functions of that state (keep, flip, close), and their
   composition is a running count, so blocks of lines are scanned independently for either entry
   state and only one summary row a block is scanned per stream.
3. *Continuations.* Every line takes the number of the last opening line at or before it; entries
   are then grouped by (stream, opening line), keys of which no one is large.

Defined results: a repeated delivery (same stream and line number) counts once; a null text is a
blank line; rows without stream or line number cannot be placed and are left out; lines before
the first opening line of a stream belong to no entry; an empty table gives no entries. Other
columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.operators.timestamps import resolve_instants
from tracewright.session import stored

#: A CSV field; possessive, so that long fields cannot exhaust the stack.
_CSV = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
#: A quoted text with backslash escapes.
_QUOTED = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"'
_ISO = r"\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:[.,]\d+)? [A-Za-z0-9+:-]+"
_DAY = r"[A-Z][a-z]{2} +[A-Z][a-z]{2} +\d{1,2} \d{2}:\d{2}:\d{2}"

ACCESS, APACHE_ERROR, NGINX_ERROR, PG_CSV, PG_TEXT, FTP_XFER, FTP_MESSAGE = (
    "access", "apache_error", "nginx_error", "pg_csv", "pg_text", "ftp_xfer", "ftp_message",
)

#: Layout -> (pattern of its shape, exact pattern of the line).
LAYOUTS: dict[str, tuple[str, str]] = {
    ACCESS: (
        r"^\S+ \S+ \S+ \[0/a/0:0:0:0 [+-]0\] \S",
        r"(?s)^(\S+) (\S+) (\S+) \[(\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4})\] "
        + _QUOTED + r" (\d{3}|-) (\d+|-)(?: (.*))?$",
    ),
    APACHE_ERROR: (
        r"^\[a a 0 0:0:0(\.0)? 0\] \[",
        r"(?s)^\[(" + _DAY + r"(?:\.\d+)? \d{4})\] \[(?:([\w.-]*):)?([A-Za-z]+\d*)\](?: \[pid (\d+)(?::tid (\d+))?\])?(?: (.*))?$",
    ),
    NGINX_ERROR: (
        r"^0/0/0 0:0:0 \[a\] 0#0:",
        r"(?s)^(\d{4}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}) \[([A-Za-z]+)\] (\d+)#(\d+): ?(?:\*(\d+) ?)?(.*)$",
    ),
    PG_CSV: (
        r"^0-0-0 0:0:0([.,]0)? [^ ,]+,",
        r"(?s)^(" + _ISO + r"),((?:" + _CSV + r",){10})([A-Z]+\d*),(.*)$",
    ),
    PG_TEXT: (
        r"^0-0-0 0:0:0([.,]0)? \S+ \[0\] \S+@",
        r"(?s)^(" + _ISO + r") \[(\d+)\] ([^\s@]*)@(\S*) ([A-Z]+\d*): +(.*)$",
    ),
    FTP_XFER: (
        r"^a a 0 0:0:0 0 0( |$)",
        r"^(" + _DAY + r" \d{4}) (\d+) (\S+) (\d+) (\S+) (\S) (\S) (\S) (\S) (\S+) (\S+) (\S+) (\S+) (\S+)\s*$",
    ),
    FTP_MESSAGE: (
        r"^a 0 0:0:0 \S+ a\[0\]: a: ?",
        r"(?s)^([A-Z][a-z]{2} +\d{1,2} \d{2}:\d{2}:\d{2}) (\S+) proftpd\[(\d+)\]: ([A-Za-z]+\d*): ?(.*)$",
    ),
}

#: What announces a statement in a PostgreSQL message, and the words that SQL commands begin with (fixed values).
_STATEMENT = (
    r"(?is)^(?:(?:duration: [\d.]+ ms +)?(?:statement|(?:parse|bind|execute|execute fetch from) [^:]*): (.*)"
    r"|((?:ALTER|ANALYZE|BEGIN|CALL|CLOSE|CLUSTER|COMMENT|COMMIT|COPY|CREATE|DEALLOCATE|DECLARE|DELETE|DISCARD|DO|DROP|END|EXECUTE"
    r"|EXPLAIN|FETCH|GRANT|INSERT|LISTEN|LOCK|MERGE|MOVE|NOTIFY|PREPARE|REFRESH|REINDEX|RELEASE|RESET|REVOKE|ROLLBACK|SAVEPOINT"
    r"|SELECT|SET|SHOW|START|TABLE|TRUNCATE|UPDATE|VACUUM|VALUES|WITH)\b(?!:).*))$"
)
#: The clock of stamps without offset, unless the caller names another.
ZONE = "Asia/Shanghai"
#: Zones meant by abbreviations that no other zone in common use prints (fixed values); others are the clock's own.
ABBREVIATIONS = {
    "GMT": "Etc/GMT", "BST": "Europe/London", "CET": "Europe/Berlin", "CEST": "Europe/Berlin", "EET": "Europe/Athens", "EEST": "Europe/Athens",
    "MSK": "Europe/Moscow", "JST": "Asia/Tokyo", "EST": "America/New_York", "EDT": "America/New_York", "MST": "America/Denver",
    "MDT": "America/Denver", "PST": "America/Los_Angeles", "PDT": "America/Los_Angeles",
}

#: Shapes that resolve to a layout and are broadcast at most; more are joined by shuffle.
MAX_SHAPES = 20_000
#: Lines of a stream that form a block.
BLOCK_LINES = 8192
#: Tokens of a line that its shape keeps; no layout's opening needs more.
SHAPE_TOKENS = 6


def clean_line(raw: Column) -> Column:
    """The line without terminal codes, byte-order marks and trailing carriage returns."""
    text = F.coalesce(raw, F.lit(""))
    coded = F.contains(text, F.lit("\x1b")) | F.contains(text, F.lit("\ufeff"))
    text = F.when(coded, F.regexp_replace(text, "\\x1b\\[[0-9;?]*[ -/]*[@-~]|\\ufeff", "")).otherwise(text)
    return F.rtrim(text, F.lit("\r"))


def signature(line: Column) -> Column:
    """The shape of a line: words become ``a``, numbers ``0``, blanks one blank; leading tokens only."""
    head = F.substring_index(F.regexp_replace(line, r" {2,}", " "), " ", SHAPE_TOKENS)
    words = F.regexp_replace(head, r"\d*+[A-Za-z_\p{L}][\w\p{L}]*+", "a")
    return F.regexp_replace(words, r"\d+", "0")


def resolve_signatures(lines: DataFrame, max_shapes: int = MAX_SHAPES) -> DataFrame:
    """One row (shape, layout) for each distinct shape that opens a layout, broadcast if small."""
    layout = F.coalesce(
        *[F.when(F.col("shape").rlike(pattern), F.lit(name)) for name, (pattern, _) in LAYOUTS.items()]
    )
    # The layout depends on the count, so the filter stays above the aggregate and runs once a shape.
    shapes = lines.groupBy("shape").agg(F.count(F.lit(1)).alias("n")).withColumn("layout", F.when(F.col("n") > 0, layout))
    shapes = shapes.filter("layout is not null").select("shape", "layout")
    found = shapes.limit(max_shapes + 1).collect()
    if len(found) > max_shapes:
        return shapes
    schema = T.StructType([T.StructField("shape", T.StringType()), T.StructField("layout", T.StringType())])
    return F.broadcast(lines.sparkSession.createDataFrame(found, schema))


def classify_lines(lines: DataFrame, max_shapes: int = MAX_SHAPES) -> DataFrame:
    """Lines with their layout (null where the line opens none) and quote parity."""
    base = lines.filter("stream_id is not null and line_no is not null").select(
        "stream_id", "line_no", "line_id", clean_line(F.col("raw")).alias("line")
    )
    shaped = base.withColumn("shape", signature(F.col("line")))
    joined = shaped.join(resolve_signatures(shaped, max_shapes), "shape", "left").drop("shape")
    exact = F.lit(False)
    for name, (_, pattern) in LAYOUTS.items():
        exact = F.when(F.col("layout") == name, F.col("line").rlike(pattern)).otherwise(exact)
    quotes = F.length("line") - F.length(F.translate("line", '"', ""))
    return joined.withColumn("layout", F.when(exact, F.col("layout"))).withColumn("odd", quotes % 2 == 1)


def _group(layout: str, number: int, line: Column) -> Column:
    found = F.regexp_extract(line, LAYOUTS[layout][1], number)
    return F.when(found != "", found)


def line_level(layout: Column, line: Column) -> Column:
    """The printed level in lower case, ``-`` for access and transfer lines."""
    return F.lower(
        F.when(layout.isin(ACCESS, FTP_XFER), "-")
        .when(layout == APACHE_ERROR, _group(APACHE_ERROR, 3, line))
        .when(layout == NGINX_ERROR, _group(NGINX_ERROR, 2, line))
        .when(layout == PG_CSV, _group(PG_CSV, 3, line))
        .when(layout == PG_TEXT, _group(PG_TEXT, 5, line))
        .when(layout == FTP_MESSAGE, _group(FTP_MESSAGE, 4, line))
    )


def line_component(layout: Column, line: Column) -> Column:
    """The module of an Apache error line that names one, otherwise the program."""
    agents = F.regexp_extract(line, LAYOUTS[ACCESS][1], 8).rlike("^" + _QUOTED + " " + _QUOTED)
    return (
        F.when(layout == ACCESS, F.when(agents, "nginx").otherwise("apache"))
        .when(layout == APACHE_ERROR, F.coalesce(_group(APACHE_ERROR, 2, line), F.lit("apache")))
        .when(layout == NGINX_ERROR, "nginx")
        .when(layout.isin(PG_CSV, PG_TEXT), "postgresql")
        .when(layout.isin(FTP_XFER, FTP_MESSAGE), "proftpd")
    )


def attach_lines(
    lines: DataFrame, block_lines: int = BLOCK_LINES, max_shapes: int = MAX_SHAPES, text: bool = True
) -> DataFrame:
    """Every line of an entry with ``entry_no``, the line number its entry opens at; without its text if not wanted."""
    known = classify_lines(lines, max_shapes)
    known = known.withColumns(
        {
            "lvl": line_level(F.col("layout"), F.col("line")),
            "component": line_component(F.col("layout"), F.col("line")),
            "block": F.floor(F.col("line_no") / block_lines),
        }
    )
    # Written once: blocks are summarised and scanned from this table, and patterns run once a line.
    known = stored(known if text else known.drop("line"))
    inside = Window.partitionBy("stream_id", "block").orderBy("line_no", "line_id")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    known = known.withColumn("previous", F.lag("line_no").over(inside)).filter(
        "previous is null or previous <> line_no"
    )
    csv = F.coalesce(F.col("layout") == PG_CSV, F.lit(False))
    known = known.withColumns({"flip": (csv & F.col("odd")).cast("int"), "close": ~csv & F.col("odd")})
    known = known.withColumn("flips", F.coalesce(F.sum("flip").over(before), F.lit(0)))
    known = known.withColumn("at_close", F.last(F.when(F.col("close"), F.col("flips")), True).over(before))
    known = known.withColumn("open0", (F.col("flips") - F.coalesce("at_close", F.lit(0))) % 2 == 1)
    known = known.withColumn("open1", F.when(F.col("at_close").isNotNull(), F.col("open0")).otherwise(~F.col("open0")))

    def after(state: str) -> Column:
        return F.when(F.col("close"), False).when(F.col("flip") == 1, ~F.col(state)).otherwise(F.col(state))

    opens = F.col("layout").isNotNull()
    blocks = known.groupBy("stream_id", "block").agg(
        F.max_by(after("open0"), "line_no").alias("out0"),
        F.max_by(after("open1"), "line_no").alias("out1"),
        F.max(F.when(opens & ~F.col("open0"), F.col("line_no"))).alias("last0"),
        F.max(F.when(opens & ~F.col("open1"), F.col("line_no"))).alias("last1"),
    )
    along = Window.partitionBy("stream_id").orderBy("block")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    swaps = F.coalesce(F.sum((F.col("out0") & ~F.col("out1")).cast("int")).over(earlier), F.lit(0))
    blocks = blocks.withColumn("swaps", swaps)
    fixed = F.when(F.col("out0") == F.col("out1"), F.struct("swaps", F.col("out0").cast("int").alias("state")))
    blocks = blocks.withColumn("fixed", F.last(fixed, True).over(earlier))
    entered = F.col("swaps") - F.coalesce("fixed.swaps", F.lit(0)) + F.coalesce("fixed.state", F.lit(0))
    blocks = blocks.withColumn("entered_open", entered % 2 == 1)
    newest = F.when(F.col("entered_open"), F.col("last1")).otherwise(F.col("last0"))
    blocks = blocks.withColumn("carried", F.last(newest, True).over(earlier))
    joined = known.join(blocks.select("stream_id", "block", "entered_open", "carried"), ["stream_id", "block"])
    joined = joined.withColumn(
        "starts", opens & ~F.when(F.col("entered_open"), F.col("open1")).otherwise(F.col("open0"))
    )
    here = F.last(F.when(F.col("starts"), F.col("line_no")), True).over(
        inside.rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        joined.withColumn("entry_no", F.coalesce(here, F.col("carried")))
        .filter("entry_no is not null")
        .select("stream_id", "entry_no", "line_no", "line_id", *["line"] * text, "starts", "layout", "lvl", "component")
    )


def _opening(name: str) -> Column:
    return F.max(F.when(F.col("starts"), F.col(name))).alias(name)


def statement_of(message: Column) -> Column:
    """The SQL of a PostgreSQL message: what a statement prefix announces, or a message that is a command; else null."""
    return F.coalesce(*[F.when(found != "", found) for found in (F.regexp_extract(message, _STATEMENT, k) for k in (1, 2))])


def entry_instants(entries: DataFrame, zone: str) -> DataFrame:
    """Entries with ``utc_us``, the instant of ``stamp_text``; stamps without offset are read by ``zone``'s clock.

    Zone abbreviations of ``ABBREVIATIONS`` are read by that zone's clock; others must be ``zone``'s own. A stamp without year is the latest that is not after the stream's last dated entry by more than a day.
    """
    spark = entries.sparkSession
    zones = [zone, *dict.fromkeys(ABBREVIATIONS.values())]
    clock = spark.createDataFrame(list(enumerate(zones)), "node_id int, tz_name string")
    printed, at = F.regexp_extract("stamp_text", r" ([A-Z]{3,4})$", 1), F.lit(0)
    for name, meant in ABBREVIATIONS.items():
        at = F.when(printed == name, zones.index(meant)).otherwise(at)
    undated = F.col("layout") == FTP_MESSAGE
    columns = [*entries.columns, "utc_us"]
    known = entries.withColumns({"__at": at, "__seen": F.to_timestamp(F.lit("9999-12-31 00:00:00"))})
    dated = resolve_instants(known.filter(~undated), clock, "stamp_text", "__at", "__seen").select(*columns)
    last = dated.groupBy("stream_id").agg(F.max("utc_us").alias("__last"))
    late = known.filter(undated).join(last, "stream_id", "left")
    late = late.withColumn("__seen", F.coalesce(F.timestamp_micros(F.col("__last") + 86_400_000_000), F.current_timestamp()))
    return dated.unionByName(resolve_instants(late, clock, "stamp_text", "__at", "__seen").select(*columns))


def parse_entries(
    lines: DataFrame, block_lines: int = BLOCK_LINES, max_shapes: int = MAX_SHAPES, zone: str = ZONE
) -> DataFrame:
    """One row per log entry: position, layout, timestamp (text and instant), level, component, message and fields.

    An entry's message is one value, so an entry whose quote is never closed is as large as the rest of
    its stream; ``attach_lines`` gives the same lines one by one.
    """
    attached = attach_lines(lines, block_lines, max_shapes)
    opening = _opening

    entries = attached.groupBy("stream_id", "entry_no").agg(
        F.min_by("line_id", "line_no").alias("first_line_id"),
        F.max_by("line_id", "line_no").alias("last_line_id"),
        F.count(F.lit(1)).alias("n_lines"),
        _opening("layout"),
        _opening("lvl"),
        _opening("component"),
        F.max(F.when(F.col("starts"), F.col("line"))).alias("head"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("text"),
    )
    layout, head, text = F.col("layout"), F.col("head"), F.col("text")
    rest = F.when(F.col("n_lines") > 1, F.expr("substring(text, length(head) + 1)")).otherwise("")
    request = _group(ACCESS, 5, head)
    access_tail = F.regexp_extract(head, LAYOUTS[ACCESS][1], 8)
    agent = F.regexp_extract(access_tail, "^" + _QUOTED + " " + _QUOTED, 2)
    csv_message = F.regexp_replace(
        F.regexp_extract(text, r"^(?:" + _CSV + r",){13}(" + _CSV + r")(?:,|\s*$)", 1), '^"|"$', ""
    )
    tail = {APACHE_ERROR: 6, NGINX_ERROR: 6, PG_TEXT: 6, FTP_MESSAGE: 5}
    message = F.when(layout == PG_CSV, F.replace(csv_message, F.lit('""'), F.lit('"')))
    for name, number in tail.items():
        message = message.when(layout == name, F.concat(F.regexp_extract(head, LAYOUTS[name][1], number), rest))
    message = message.when(layout == ACCESS, F.concat(F.coalesce(request, F.lit("")), rest)).otherwise(text)
    stamp = F.coalesce(
        *[F.when(layout == name, _group(name, 4 if name == ACCESS else 1, head)) for name in LAYOUTS]
    )
    statement = statement_of(F.col("message"))
    command = F.when(layout == FTP_XFER, _group(FTP_XFER, 14, head)).when(
        layout == FTP_MESSAGE, F.regexp_extract(head, r"CMD '([A-Za-z]+)", 1)
    )
    parsed = (
        entries.withColumns({"stamp_text": stamp, "message": message})
        .withColumns(
            {
                "url": F.when(layout == ACCESS, F.regexp_extract(request, r"^\S+ (.*?)(?: HTTP/[\d.]+)?$", 1)),
                "user_agent": F.when((layout == ACCESS) & (agent != ""), agent),
                "statement": F.when(layout.isin(PG_CSV, PG_TEXT), statement),
                "ftp_command": F.when(command != "", command),
                "response_code": F.when(layout == ACCESS, _group(ACCESS, 6, head)),
                "transfer_size": F.coalesce(
                    F.when(layout == ACCESS, _group(ACCESS, 7, head)), F.when(layout == FTP_XFER, _group(FTP_XFER, 4, head))
                ),
            }
        )
        .drop("head", "text")
    )
    return entry_instants(stored(parsed), zone)


def found_entries(lines: DataFrame) -> DataFrame:
    """Entries reduced to first line, last line, level and component."""
    entries = attach_lines(lines, text=False).groupBy("stream_id", "entry_no").agg(
        F.min_by("line_id", "line_no").alias("first_line_id"),
        F.max_by("line_id", "line_no").alias("last_line_id"),
        _opening("lvl"),
        _opening("component"),
    )
    return entries.select("first_line_id", "last_line_id", "lvl", "component")
