"""Log lines of single programs to fields, as column builders.

Every builder takes the raw line and returns a struct of texts; a line that is not of the layout
gives null fields, so that a filter sets it aside. Directions follow the data: a read makes the
client the subject and the file the object, a write the other way round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.operators import bad_rows

_QUOTED = r'"([^"\\]*+(?:\\.[^"\\]*+)*+)"'
_COMMON = r"^(\S+) (\S+) (\S+) \[([^\]]+)\] " + _QUOTED + r" (\S+) (\S+)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is computed once, where a plain reference would be computed at every use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pick(line: Column, pattern: str, names: list[str]) -> list[Column]:
    """One named column per group; what did not match or is empty is null."""
    found = [F.regexp_extract(line, pattern, k + 1) for k in range(len(names))]
    return [F.when(f != "", f).alias(n) for f, n in zip(found, names, strict=True)]


def struct_of(line: Column, pattern: str, names: list[str]) -> Column:
    return F.struct(*pick(line, pattern, names))


#: The clock of local times in logs that print none (the offset of the machines whose logs these layouts are of).
OFFSET = "+0800"


def clock_us(text: Column, pattern: str) -> Column:
    """Microseconds since 1970 of a printed time with its offset; null where it is none of the pattern."""
    return F.unix_micros(F.try_to_timestamp(text, F.lit(pattern)))


def seconds_us(text: Column) -> Column:
    """Microseconds of printed seconds since 1970."""
    return (text.try_cast("decimal(20,6)") * 1_000_000).cast("bigint")


def access_us(time: Column, offset: str | None = None) -> Column:
    """Instant of an access time; with ``offset``, of its clock there, whatever offset is printed."""
    if offset is not None:
        time = F.concat(F.substring_index(time, " ", 1), F.lit(" " + offset))
    return clock_us(time, "dd/MMM/yyyy:HH:mm:ss Z")


def request_parts(request: Column) -> list[Column]:
    """method, url and protocol of a request line; the url may hold blanks."""
    return pick(request, r"^(\S+) (.*?)(?: (HTTP/[\d.]+))?$", ["method", "url", "protocol"])


def _values(line: Column, brackets: bool) -> tuple[Column, Column]:
    """The values of a row's fields, read as ``bad_rows`` reads them, and whether its double quotes are paired."""
    escaped = bad_rows._escapes(line)
    paired = F.length(F.regexp_replace(escaped, '[^"]', "")) % 2 == 0
    return F.transform(bad_rows.fields(escaped, F.lit(brackets)), bad_rows.value), paired


def apache(line: Column, offset: str | None = None) -> Column:
    """Access line: host, identity, user, [time], request, code, size, then optionally a dash, destination ip, port and pid.

    7 or 11 fields; white space separates, quoted and bracketed text is one field, escapes are resolved.
    """
    values, paired = _values(line, True)
    bracketed = F.get(bad_rows.fields(bad_rows._escapes(line), F.lit(True)), F.lit(3)).rlike(r"^\[.*\]$")
    read = F.when(paired & F.size(values).isin(7, 11) & bracketed, values)
    places = {"host": 0, "identity": 1, "user": 2, "time": 3, "request": 4, "response_code": 5, "transfer_size": 6, "dst_ip": 8, "dst_port": 9, "pid": 10}
    at = lambda k: F.get(read, F.lit(k))
    ts = access_us(at(3), offset).alias("ts_us")
    return F.struct(*[F.when(at(k) != "", at(k)).alias(n) for n, k in places.items()], *request_parts(at(4)), ts)


def php(line: Column) -> Column:
    """As for Apache; the clock is read at +08:00 whatever offset is printed."""
    return apache(line, OFFSET)


def nginx(line: Column) -> Column:
    """Access line followed by quoted referer and agent."""
    base = pick(line, _COMMON + " " + _QUOTED + " " + _QUOTED, ["host", "identity", "user", "time", "request", "response_code", "transfer_size", "referer", "user_agent"])
    return F.struct(*base, *request_parts(F.regexp_extract(line, _COMMON, 5)), access_us(F.regexp_extract(line, _COMMON, 4)).alias("ts_us"))


def mini_httpd(line: Column) -> Column:
    """Access line that ends with the agent: host, method, path, protocol, status, size, referer and agent."""
    pattern = r'^(\S+) - - \[([^\]]+)\] "(\S+) (\S+) (\S+)" (\d+) (\S+) "([^"]*)" "([^"]*)"'
    base = pick(line, pattern, ["host", "time", "method", "path", "protocol", "status", "length", "referer", "user_agent"])
    return F.struct(*base, access_us(F.regexp_extract(line, pattern, 2)).alias("ts_us"))


def openssh(line: Column, year: int = 2023) -> Column:
    """Accepted and disconnected sessions: time, pid, user, ip, port and state; ``year`` is that of times without one."""
    head = r"^([A-Z][a-z]{2} +\d{1,2} \d{2}:\d{2}:\d{2}|\d{4}-\S+) \S+ sshd\[(\d+)\]: "
    accepted = head + r"Accepted \S+ for (\S+) from (\S+) port (\d+)"
    closed = head + r"Disconnected from (?:user )?(\S+) (\S+) port (\d+)"
    names = ["time", "pid", "user", "ip", "port"]
    one, two = struct_of(line, accepted, names), struct_of(line, closed, names)
    state = F.when(one["time"].isNotNull(), "Connect").when(two["time"].isNotNull(), "Disconnect")
    time = F.coalesce(one["time"], two["time"])
    ts = clock_us(F.concat(F.regexp_replace(time, " +", " "), F.lit(f" {year} {OFFSET}")), "MMM d HH:mm:ss yyyy Z")
    return F.struct(*[F.coalesce(one[n], two[n]).alias(n) for n in names], state.alias("state"), ts.alias("ts_us"))


def postgres(line: Column) -> Column:
    """CSV line: time, user, database, session, connection and message; doubled quotes resolved."""
    field = r'(?:"[^"]*+(?:""[^"]*+)*+"|[^",]*+)'
    fields = [F.regexp_extract(line, r"(?s)^(?:" + field + r",){%d}(%s)(?:,|$)" % (k, field), 1) for k in (0, 1, 2, 3, 4, 13)]
    clean = [F.replace(F.regexp_replace(f, '^"|"$', ""), F.lit('""'), F.lit('"')) for f in fields]
    message = clean[5]
    port = F.regexp_extract(message, r"connection received: host=\S+ port=(\d+)", 1)
    statement = F.regexp_extract(message, r"(?s)^statement: (.*)$", 1)
    named = [F.when(c != "", c).alias(n) for c, n in zip(clean, ["time", "user", "database", "session", "connection", "message"], strict=True)]
    ts = clock_us(F.concat(F.substring_index(clean[0], " ", 2), F.lit(" " + OFFSET)), "yyyy-MM-dd HH:mm:ss[.SSSSSS] Z").alias("ts_us")
    whole = F.struct(*named, ts, F.when(port != "", port).alias("port"), F.when(statement != "", statement).alias("statement"))
    return F.when(line.rlike(r"(?s)^(?:" + field + r",){13}"), whole)


#: What a script line of a MONITOR log may hold: a loaded library with its function, a started command with its mode, a read mode (fixed values).
_LOADS, _STARTS, _READS = r"loadlib\((.*),(.*)\)", r"io\.popen\((.*),(.*)\)", r"read\((.*?)\)"


def redis(line: Column) -> Column:
    """MONITOR line: time, database, ip, port, command, content, and what a script loads, starts and reads (of its statements the last wins).

    A command that a script starts takes the place of the line's own command and content.
    """
    pattern = r'^(\d+(?:\.\d+)?) \[(\d+) ([^:\]]+):(\d+)\] "([^"]*)"(?: (.*))?$'
    base = pick(line, pattern, ["time", "db", "ip", "port", "command", "content"])
    script = F.upper(F.regexp_extract(line, pattern, 5)) == "SCRIPT"
    bare = lambda c: F.btrim(c, F.lit(' \\"'))

    def mined(found: str, group: int) -> Column:
        held = F.filter(F.split(line, ";"), lambda x: x.rlike(found))
        last = F.regexp_extract(F.element_at(held, -1), found, group)
        return F.when(script & (F.size(held) > 0), bare(last))

    started = F.split(mined(_STARTS, 1), " ")
    fields = dict(zip(["time", "db", "ip", "port", "command", "content"], base, strict=True))
    fields["command"] = F.coalesce(bare(F.get(started, F.lit(0))), fields["command"]).alias("command")
    fields["content"] = F.when(started.isNotNull(), bare(F.get(started, F.lit(1)))).otherwise(fields["content"]).alias("content")
    return F.struct(
        *fields.values(), mined(_LOADS, 1).alias("lib_path"), mined(_LOADS, 2).alias("function"), mined(_STARTS, 2).alias("command_mode"),
        mined(_READS, 1).alias("file_mode"), seconds_us(F.regexp_extract(line, pattern, 1)).alias("ts_us"),
    )


def vim(line: Column) -> Column:
    """Eight tab-separated fields."""
    parts = F.split(line, "\t")
    names = ["time", "datetime", "pid", "action", "empty", "path", "file", "payload"]
    at = [F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(names)]
    return F.when(F.size(parts) == 8, F.struct(*at, seconds_us(at[0]).alias("ts_us")))


def imagemagick(line: Column) -> Column:
    """Policy line: time, pid, rights and path; patterns that are a bare format name are none."""
    pattern = r'^(\S+) .*?\[(\d+)\]:.*?rights=(\w+); pattern="([^"]*)"'
    found = F.struct(*pick(line, pattern, ["time", "pid", "rights", "path"]), clock_us(F.regexp_extract(line, pattern, 1), "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX").alias("ts_us"))
    return F.when(found["path"].isNotNull() & (found["path"] != "PNG"), found)


def proftpd(line: Column) -> Column:
    """Transfer line of 18 fields: white space separates, quoted text is one field; the first five are the time, a date."""
    names = ["duration", "host", "transfer_size", "file", "transfer_type", "transfer_status", "direction", "mode", "user", "service", "offset", "hash", "ftp_command"]
    values, paired = _values(line, False)
    time = F.array_join(F.slice(values, 1, 5), " ")
    read = F.when(paired & (F.size(values) == 18) & time.rlike(r"^\S+ \S+ \d+ \S+ \d{4}$"), values)
    at = lambda k: F.get(read, F.lit(k))
    found = [F.when(at(k + 5) != "", at(k + 5)).alias(n) for k, n in enumerate(names)]
    date = F.concat(F.regexp_replace(F.regexp_replace(time, r"^\S+ ", ""), r"^(\S+) 0", "$1 "), F.lit(" " + OFFSET))
    ts = clock_us(F.regexp_replace(date, " +", " "), "MMM d HH:mm:ss yyyy Z")
    return F.struct(F.when(read.isNotNull(), time).alias("time"), *found, F.when(read.isNotNull(), ts).alias("ts_us"))


_NET = ["seq", "time", "src_ip", "dst_ip", "protocol_name", "src_port", "dst_port", "length", "method", "filename", "protocol", "code", "text"]
_TABBED = r"(\d+)\t(.*)\t(.*)\t(.*)\t"
_ENDS = ["seq", "time", "src_ip", "dst_ip"]
_PORTS = ["protocol_name", "src_port", "dst_port"]
_ARROW = r"\s*(\d+)\s+(.*)\s+([0-9]+.[0-9]+.[0-9]+.[0-9]+) → ([0-9]+.[0-9]+.[0-9]+.[0-9]+)\s+"
#: Layouts of text captures, tried in order, with the fields of their groups (fixed values).
NETWORK_LAYOUTS: list[tuple[str, list[str]]] = [
    (_TABBED + r"(\w+)\t(\d+),(\d+)\t\t(\d+)\t(\w+) (\S*) ([^\\\"\s]*)", [*_ENDS, *_PORTS, "length", "method", "filename", "protocol"]),
    (_TABBED + r"(\w+)\t(\d+),(\d+)\t\t(\d+)\t([^\\\"\s]*) (\d+) (.*)", [*_ENDS, *_PORTS, "length", "protocol", "code", "text"]),
    (_TABBED + r"(\w+)\t\t(\d+),(\d+)\t(\d+)\t(.*)", [*_ENDS, *_PORTS, "length", "text"]),
    (_TABBED + r"(\w+)\t(\d+),(\d+)\t\t(\d+)\t(.*)", [*_ENDS, *_PORTS, "length", "text"]),
    (_TABBED + r"([-\w]+)\t(\d+),(\d+)\t\t(\d+)\t(.*)", [*_ENDS, *_PORTS, "length", "text"]),
    (_TABBED + r"(.*)\t(\d+),(\d+)\t\t(\d+)\t(.*)", [*_ENDS, *_PORTS, "length", "text"]),
    (_TABBED + r"(.*)\t\t\t\t(.*)", [*_ENDS, "protocol_name", "text"]),
    (_TABBED + r"(.*)\t(\d+),(\d+)\t\t(.*)", [*_ENDS, *_PORTS, "text"]),
    (_TABBED + r"(.*)\t\t\t(\d+)\t(.*)", [*_ENDS, "protocol_name", "length", "text"]),
    (_ARROW + r"HTTP\s*(\d+)\s*(\w+)\s*(.*)\s*HTTP/1.1", [*_ENDS, "length", "method", "filename"]),
    (_ARROW + r"TCP\s*(\d+)\s*(\d+) → (\d+)\s*(.*)", [*_ENDS, "length", "src_port", "dst_port", "text"]),
    (_ARROW + r"(.*)", [*_ENDS, "text"]),
]


def network_text(line: Column, layouts: list[tuple[str, list[str]]] | None = None) -> Column:
    """Capture line by the first layout that it matches exactly once, which ``layout`` names (from 1).

    The file is the request's, else the text. ``ts_us`` is set for times in seconds and for
    ``Mon d, yyyy`` dates, whose zone name is read as the clock of ``OFFSET``.
    """
    layouts = NETWORK_LAYOUTS if layouts is None else layouts
    number = F.coalesce(*[F.when(F.regexp_count(line, F.lit(p)) == 1, F.lit(k + 1)) for k, (p, _) in enumerate(layouts)])

    def fields(layout: Column) -> Column:
        found = F.coalesce(*[
            F.when(layout == k + 1, F.array(*[F.trim(F.regexp_extract(line, p, names.index(n) + 1)) if n in names else F.lit("") for n in _NET]))
            for k, (p, names) in enumerate(layouts)
        ])
        return let(F.struct(layout.alias("layout"), found.alias("found")), named)

    def named(read: Column) -> Column:
        at = {n: F.when(F.get(read["found"], F.lit(k)) != "", F.get(read["found"], F.lit(k))) for k, n in enumerate(_NET)}
        at["filename"] = F.coalesce(at["filename"], at["text"])
        date = F.concat(F.regexp_replace(F.regexp_extract(at["time"], r"^([A-Z][a-z]{2} +\d{1,2}, \d{4} \d\d:\d\d:\d\d(?:\.\d{1,6})?)", 1), " +", " "), F.lit(" " + OFFSET))
        ts = F.coalesce(seconds_us(F.regexp_extract(at["time"], r"^\d+(?:\.\d{1,6})?", 0)), clock_us(date, "MMM d, yyyy HH:mm:ss[.SSSSSS] Z"))
        return F.struct(*[c.alias(n) for n, c in at.items()], read["layout"].alias("layout"), ts.alias("ts_us"))

    return let(number, fields)


def url_parts(url: Column) -> list[Column]:
    """path, suffix and number of parameters of a url."""
    path = F.when(F.contains(url, F.lit("?")), F.substring_index(url, "?", 1)).otherwise(url)
    n = F.when(F.contains(url, F.lit("?")), F.length(url) - F.length(F.replace(url, F.lit("&"), F.lit(""))) + 1).otherwise(0)
    return [path.alias("path"), F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1).alias("suffix"), n.cast("bigint").alias("n_parameters")]


def key_values(line: Column) -> Column:
    """``k=v k2=v2`` as a map: words without ``=`` go on the value before, quotes around values are dropped."""
    pattern = r"""([\w-]+)=("[^"]*"|'[^']*'|[^=]*?)(?=\s+[\w-]+=|\s*$)"""
    values = F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(2)), lambda v: F.regexp_replace(F.trim(v), r"""^["']|["']$""", ""))

    def entries(keys: Column) -> Column:
        # A key given twice keeps its last value.
        zipped = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("k"), v.alias("v")))
        once = F.filter(zipped, lambda e, i: F.array_position(F.reverse(keys), e["k"]) == (F.size(keys) - i))
        return F.map_from_entries(F.when(F.size(F.array_distinct(keys)) == F.size(keys), zipped).otherwise(once))

    return let(F.regexp_extract_all(line, F.lit(pattern), F.lit(1)), entries)


def event_of(kind: Column, subject: Column, object_: Column, object_type: Column, action: Column, payload: Column) -> Column:
    """The common event: subject and object entities, swapped for calls that move data the other way."""
    entity = lambda t, n: F.struct(t.alias("type"), n.alias("name"))
    reads = F.upper(action).isin("GET", "HEAD", "RETR", "OPTIONS", "PROPFIND")
    process, other = entity(kind, subject), entity(object_type, object_)
    return F.struct(
        F.when(reads, process).otherwise(other).alias("subject"), F.when(reads, other).otherwise(process).alias("object"),
        action.alias("action"), payload.alias("payload"),
    )


def last_replaced(text: Column, pattern: str, new: str) -> Column:
    """The last match of a pattern replaced."""
    return F.regexp_replace(text, r"(?s)^(.*)" + pattern, "$1" + new)


def file_of_header(header: Column) -> Column:
    """The file name of a multipart header."""
    found = F.regexp_extract(header, r'filename="([^"]+)"', 1)
    return F.when(found != "", found)


def payload_relevant(payload: Column, subject: Column, prefix: str) -> Column:
    """1 if what is left of the subject without the prefix is not empty and in the payload."""
    rest = F.when(F.startswith(subject, F.lit(prefix)), F.substring(subject, len(prefix) + 1, 2**31 - 1)).otherwise(subject)
    return F.when((rest != "") & F.contains(payload, rest), 1).otherwise(0)


def json_cleaned(text: Column) -> Column:
    """A printed record with quoted texts of either kind and Python constants as JSON text; what stands in quotes stays."""
    token = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^'"]+|['"]"""

    def translated(part: Column) -> Column:
        inner = F.replace(F.substring(part, 2, 2**31 - 1), F.lit("\\'"), F.lit("'"))
        inner = F.substring(inner, F.lit(1), F.length(inner) - 1)
        single = F.concat(F.lit('"'), F.regexp_replace(inner, r'(?<!\\)"', '\\\\"'), F.lit('"'))
        plain = part
        for old, new in (("None", "null"), ("True", "true"), ("False", "false")):
            plain = F.regexp_replace(plain, rf"\b{old}\b", new)
        double = F.replace(part, F.lit("\\'"), F.lit("'"))
        return F.when(F.startswith(part, F.lit("'")), single).when(F.startswith(part, F.lit('"')), double).otherwise(plain)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(token), F.lit(0)), translated), "")


def without(record: Column, names: list[str]) -> Column:
    """A record (a struct) without the named fields, as a map of texts; null values drop out."""
    kept = F.map_filter(F.from_json(F.to_json(record), "map<string,string>"), lambda k, v: ~k.isin(names) & v.isNotNull())
    return kept
