"""Named queries that print events as lines of programs, read them back with the parsers and compare; with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import parsers
from tracewright.operators import audit as A
from tracewright.session import shared_folder, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


_E = """WITH e AS (SELECT event_id, ts, epoch_us(ts) AS us, user_id AS u, event_type AS rel, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events)"""


def _events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(
        "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("user_id").alias("u"), F.col("event_type").alias("rel"),
        F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("bigint").alias("k"),
    )


def _line(template: str) -> Column:
    """The template with {column}s filled in; {at:pattern} prints the time."""
    parts: list[Column] = []
    for k, piece in enumerate(template.replace("{{", "\0").replace("}}", "\1").replace("{", "\2").replace("}", "\2").split("\2")):
        piece = piece.replace("\0", "{").replace("\1", "}")
        if k % 2 == 0:
            parts.append(F.lit(piece))
        elif piece.startswith("at:"):
            parts.append(F.date_format("ts", piece[3:]))
        else:
            parts.append(F.expr(piece).cast("string"))
    return F.concat(*parts)


def _parsed(s: SparkSession, d: str, template: str, parser: Callable[[Column], Column], fields: list[str]) -> DataFrame:
    read = _events(s, d).select("event_id", _line(template).alias("line")).select("event_id", parser(F.col("line")).alias("f"))
    return read.select("event_id", *[F.col(f"f.{c}").alias(c) for c in fields])


# ---- access lines ----------------------------------------------------------------------------------
_ACCESS = '10.0.{u % 250}.{k} - - [{at:dd/MMM/yyyy:HH:mm:ss} +0000] "GET /{rel}/{k}.gif HTTP/1.1" 200 {k}'
_ACCESS_SQL = "'10.0.' || u % 250 || '.' || k AS host, us // 1000000 * 1000000 AS ts_us"


@query(
    _E + f""" SELECT event_id, {_ACCESS_SQL}, 'GET' AS method, '/' || rel || '/' || k || '.gif' AS url, CAST(k AS VARCHAR) AS transfer_size,
    CAST(u AS VARCHAR) AS pid FROM e"""
)
def apache_times(s, d):
    return _parsed(s, d, _ACCESS + " - 10.9.9.9 80 {u}", parsers.apache, ["host", "ts_us", "method", "url", "transfer_size", "pid"])


@query(_E + f" SELECT event_id, '10.0.' || u % 250 || '.' || k AS host, us // 1000000 * 1000000 - 28800000000 AS ts_us, '/' || rel || '/' || k || '.gif' AS url FROM e")
def php_fields(s, d):
    """The printed clock is read at +08:00."""
    return _parsed(s, d, _ACCESS, parsers.php, ["host", "ts_us", "url"])


@query(_E + f" SELECT event_id, {_ACCESS_SQL}, '-' AS referer, 'agent \\\"' || u || '\\\"' AS user_agent, 'HTTP/1.1' AS protocol FROM e")
def nginx_fields(s, d):
    return _parsed(s, d, _ACCESS + r' "-" "agent \"{u}\""', parsers.nginx, ["host", "ts_us", "referer", "user_agent", "protocol"])


@query(_E + f" SELECT event_id, {_ACCESS_SQL}, '/' || rel || '/' || k || '.gif' AS path, '200' AS status, CAST(k AS VARCHAR) AS length, 'agent ' || u AS user_agent FROM e")
def mini_httpd_fields(s, d):
    return _parsed(s, d, _ACCESS + ' "-" "agent {u}"', parsers.mini_httpd, ["host", "ts_us", "path", "status", "length", "user_agent"])


# ---- other programs --------------------------------------------------------------------------------
@query(
    _E + """ SELECT event_id, CASE WHEN k % 3 < 2 THEN CAST(u AS VARCHAR) END AS pid, CASE WHEN k % 3 < 2 THEN rel END AS user, CASE WHEN k % 3 < 2 THEN '10.0.0.' || k END AS ip,
    CASE WHEN k % 3 < 2 THEN CAST(4000 + k AS VARCHAR) END AS port, CASE k % 3 WHEN 0 THEN 'Connect' WHEN 1 THEN 'Disconnect' END AS state,
    CASE WHEN k % 3 < 2 THEN epoch_us(make_timestamp(2023, month(ts), day(ts), hour(ts), minute(ts), second(ts))) - 28800000000 END AS ts_us FROM e"""
)
def openssh_fields(s, d):
    """Times without year are of the year 2023 and read at +08:00."""
    head = "{at:MMM} {lpad(cast(day(ts) as string), 2, ' ')} {at:HH:mm:ss} host sshd[{u}]: "
    said = "{case when k % 3 = 0 then concat('Accepted password for ', rel, ' from 10.0.0.', k, ' port ', 4000 + k, ' ssh2') when k % 3 = 1 then concat('Disconnected from user ', rel, ' 10.0.0.', k, ' port ', 4000 + k) else 'Server listening' end}"
    return _parsed(s, d, head + said, parsers.openssh, ["pid", "user", "ip", "port", "state", "ts_us"])


@query(
    _E + """ SELECT event_id, rel AS user, CAST(u AS VARCHAR) AS session, us // 1000 * 1000 - 28800000000 AS ts_us,
    CASE WHEN k % 2 = 0 THEN 'SELECT "' || k || '", x' END AS statement, CASE WHEN k % 2 = 1 THEN CAST(40000 + k AS VARCHAR) END AS port FROM e"""
)
def postgres_fields(s, d):
    said = "{case when k % 2 = 0 then concat('\"statement: SELECT \"\"', k, '\"\", x\"') else concat('connection received: host=h port=', 40000 + k) end}"
    line = '{at:yyyy-MM-dd HH:mm:ss.SSS} CST,"{rel}","db",{u},"10.0.0.1:5",s,1,"SELECT",{at:yyyy-MM-dd HH:mm:ss} CST,1/2,0,LOG,00000,' + said + ',,,,,,,,,"app"'
    return _parsed(s, d, line, parsers.postgres, ["user", "session", "ts_us", "statement", "port"])


@query(
    _E + """ SELECT event_id, us AS ts_us, '10.0.0.' || k AS ip, CAST(u AS VARCHAR) AS port, CASE WHEN rel = 'click' THEN 'id' ELSE 'GET' END AS command,
    CASE WHEN rel = 'click' THEN '/lib/x' || k || '.so' END AS lib_path, CASE WHEN rel = 'click' THEN 'open_io' END AS function,
    CASE WHEN rel = 'click' THEN 'r' END AS command_mode, CASE WHEN rel = 'click' THEN '*a' END AS file_mode FROM e"""
)
def redis_fields(s, d):
    script = r"concat('\"SCRIPT\" \"LOAD\" \"local f = package.loadlib(\\\"/lib/x', k, '.so\\\", \\\"open_io\\\"); local g = io.popen(\\\"id -u\\\", \\\"r\\\"); local r = g:read(\\\"*a\\\"); return r\"')"
    line = "{us div 1000000}.{lpad(cast(us % 1000000 as string), 6, '0')} [0 10.0.0.{k}:{u}] {case when rel = 'click' then " + script + " else concat('\"GET\" \"', k, '\"') end}"
    return _parsed(s, d, line, parsers.redis, ["ts_us", "ip", "port", "command", "lib_path", "function", "command_mode", "file_mode"])


@query(_E + " SELECT event_id, us // 1000000 * 1000000 AS ts_us, CAST(u AS VARCHAR) AS pid, rel AS action, 'f' || k AS file FROM e")
def vim_fields(s, d):
    return _parsed(s, d, "{us div 1000000}\t{at:yyyy-MM-dd}\t{u}\t{rel}\t\t/d\tf{k}\tp", parsers.vim, ["ts_us", "pid", "action", "file"])


@query(
    _E + """ SELECT event_id, CASE WHEN k % 5 > 0 THEN us // 1000000 * 1000000 - 28800000000 END AS ts_us, CASE WHEN k % 5 > 0 THEN CAST(u AS VARCHAR) END AS pid,
    CASE WHEN k % 5 > 0 THEN '/u/' || k || '.png' END AS path FROM e"""
)
def imagemagick_fields(s, d):
    line = "{at:yyyy-MM-dd}T{at:HH:mm:ss}+08:00 h Policy convert[{u}]: x rights=Read; pattern=\"{case when k % 5 = 0 then 'PNG' else concat('/u/', k, '.png') end}\" z"
    return _parsed(s, d, line, parsers.imagemagick, ["ts_us", "pid", "path"])


@query(
    _E + """ SELECT event_id, CAST(event_id % 12 + 1 AS INTEGER) AS layout, '10.0.0.' || k AS src_ip, CASE WHEN event_id % 12 IN (6, 8, 9, 11) THEN NULL ELSE '80' END AS dst_port,
    CASE event_id % 12 WHEN 0 THEN '/f' || k WHEN 1 THEN 'OK' WHEN 9 THEN '/f' || k ELSE 'info ' || k END AS filename, us AS ts_us FROM e"""
)
def network_layouts(s, d):
    """One line in each of the twelve layouts in turn."""
    tabbed, arrow = "{event_id}\t{sec}\t10.0.0.{k}\t10.9.9.9\t", " {event_id}  {sec} 10.0.0.{k} → 10.9.9.9 "
    kinds = [
        tabbed + "HTTP\t50,80\t\t9\tGET /f{k} HTTP/1.1", tabbed + "HTTP\t50,80\t\t9\tHTTP/1.1 200 OK", tabbed + "TCP\t\t50,80\t9\tinfo {k}",
        tabbed + "TCP\t50,80\t\t9\tinfo {k}", tabbed + "TLS-x\t50,80\t\t9\tinfo {k}", tabbed + "TLS v1\t50,80\t\t9\tinfo {k}", tabbed + "ARP\t\t\t\tinfo {k}",
        tabbed + "TCP\t50,80\t\tinfo {k}", tabbed + "ICMP\t\t\t9\tinfo {k}", arrow + "HTTP 9 POST /f{k} HTTP/1.1", arrow + "TCP 9 50 → 80 info {k}", arrow + "info {k}",
    ]
    line = F.element_at(F.array(*[_line(x) for x in kinds]), (F.col("event_id") % 12 + 1).cast("int"))
    sec = F.format_string("%d.%06d", F.floor(F.col("us") / 1_000_000), F.col("us") % 1_000_000)
    lines = _events(s, d).withColumn("sec", sec).select("event_id", line.alias("line"))
    read = lines.select("event_id", parsers.network_text(F.col("line")).alias("f"))
    return read.select("event_id", *[F.col(f"f.{c}").alias(c) for c in ("layout", "src_ip", "dst_port", "filename", "ts_us")])


@query(_E + """ SELECT event_id, CASE WHEN rel IN ('view', 'click') THEN 'u' || u ELSE 'k' || k END AS subject, CASE WHEN rel IN ('view', 'click') THEN 'k' || k ELSE 'u' || u END AS object FROM e""")
def common_events(s, d):
    """Reads make the client the subject; other actions turn the two."""
    action = F.when(F.col("rel").isin("view", "click"), "GET").otherwise("POST")
    event = parsers.event_of(F.lit("Socket"), F.concat(F.lit("u"), F.col("u").cast("string")), F.concat(F.lit("k"), F.col("k").cast("string")), F.lit("File"), action, F.lit(""))
    return _events(s, d).select("event_id", event.alias("x")).select("event_id", F.col("x.subject.name").alias("subject"), F.col("x.object.name").alias("object"))


@query(_E + """ SELECT event_id, 'rel' AS key, rel AS value FROM e UNION ALL SELECT event_id, 'u', CAST(u AS VARCHAR) FROM e""")
def record_without(s, d):
    e = _events(s, d).withColumn("r", F.struct("rel", "u", F.col("k").alias("label"), F.lit(None).cast("string").alias("gone")))
    return e.select("event_id", F.explode(parsers.without(F.col("r"), ["label"])).alias("key", "value"))


@query(
    _E + """ SELECT event_id, 'a/' || k || '/bz' || k AS replaced, 'f ' || k || '.txt' AS header_file, '{"a": "it''s ' || k || '", "b": null, "c": true}' AS cleaned FROM e"""
)
def text_helpers(s, d):
    one = parsers.last_replaced(_line("a/{k}/b/{k}"), "/", "z").alias("replaced")
    two = parsers.file_of_header(_line('form-data; name="x"; filename="f {k}.txt"')).alias("header_file")
    three = parsers.json_cleaned(_line("{{'a': \"it's {k}\", 'b': None, 'c': True}}")).alias("cleaned")
    return _events(s, d).select("event_id", one, two, three)


# ---- audit records ---------------------------------------------------------------------------------
_MS = "audit({us div 1000000}.{lpad(cast(us div 1000 % 1000 as string), 3, '0')}:"
_WHO = ' ppid=1 pid={u} comm="cat" exe="/bin/cat"'
#: A process opens a file by a relative name, reads it, connects, sends, renames and clones itself.
_AUDIT = [
    (0, "type=SYSCALL msg=" + _MS + "{event_id * 6}): syscall=openat success=yes exit=3 a0=ffffff9c a1=7f" + _WHO),
    (1, "type=CWD msg=" + _MS + '{event_id * 6}): cwd="/home/{rel}"'),
    (2, "type=PATH msg=" + _MS + '{event_id * 6}): item=0 name="f{k}.txt" nametype=NORMAL'),
    (3, "type=SYSCALL msg=" + _MS + "{event_id * 6 + 1}): syscall=read success=yes exit={k} a0=3" + _WHO),
    (4, "type=SYSCALL msg=" + _MS + "{event_id * 6 + 2}): syscall=connect success=yes exit=0 a0=4" + _WHO),
    (5, "type=SOCKADDR msg=" + _MS + "{event_id * 6 + 2}): saddr=020000500A0000{lpad(hex(k), 2, '0')}"),
    (6, "type=SYSCALL msg=" + _MS + "{event_id * 6 + 3}): syscall=write success=yes exit=9 a0=4" + _WHO),
    (7, "type=SYSCALL msg=" + _MS + "{event_id * 6 + 4}): syscall=rename success=yes exit=0 a0=1" + _WHO),
    (8, "type=CWD msg=" + _MS + '{event_id * 6 + 4}): cwd="/d"'),
    (9, "type=PATH msg=" + _MS + '{event_id * 6 + 4}): item=0 name="a{k}" nametype=DELETE'),
    (10, "type=PATH msg=" + _MS + "{event_id * 6 + 4}): item=1 name=2F622063 nametype=CREATE"),
    (11, "type=SYSCALL msg=" + _MS + "{event_id * 6 + 5}): syscall=clone success=yes exit={100000 + event_id}" + _WHO),
]


def _audit_lines(s: SparkSession, d: str) -> DataFrame:
    lines = F.explode(F.array(*[F.struct(F.lit(k).alias("seq"), _line(text).alias("line")) for k, text in _AUDIT]))
    return _events(s, d).select((F.col("u") % 16).alias("host"), lines.alias("x")).select("host", "x.seq", "x.line")


def _audit_events(s: SparkSession, d: str) -> DataFrame:
    return A.assemble(A.raw_lines(_audit_lines(s, d)), ["host"], "seq")


@query(
    _E + """ SELECT event_id * 6 + j AS event_id, us // 1000 * 1000 AS ts_us, CASE j WHEN 0 THEN 3 WHEN 2 THEN 2 WHEN 4 THEN 4 ELSE 1 END AS n_lines,
    ['openat', 'read', 'connect', 'write', 'rename', 'clone'][j + 1] AS call FROM e, (SELECT unnest(range(6)) AS j) q"""
)
def audit_assembled(s, d):
    return _audit_events(s, d).select("event_id", "ts_us", (F.size("parts") + 1).alias("n_lines"), F.col("call")["syscall"].alias("call"))


@query(
    _E + """, f AS (SELECT *, '/home/' || rel || '/f' || k || '.txt' AS file FROM e)
    SELECT event_id * 6 AS event_id, 'sys_openat' AS action, file, NULL AS ip, NULL AS port, NULL AS child FROM f
    UNION ALL SELECT event_id * 6 + 1, 'sys_read', file, NULL, NULL, NULL FROM f UNION ALL SELECT event_id * 6 + 2, 'sys_connect', NULL, '10.0.0.' || k, 80, NULL FROM f
    UNION ALL SELECT event_id * 6 + 3, 'sys_write', NULL, '10.0.0.' || k, 80, NULL FROM f UNION ALL SELECT event_id * 6 + 4, 'sys_rename_DELETE', '/d/a' || k, NULL, NULL, NULL FROM f
    UNION ALL SELECT event_id * 6 + 4, 'sys_rename_CREATE', '/b c', NULL, NULL, NULL FROM f UNION ALL SELECT event_id * 6 + 5, 'sys_clone', NULL, NULL, NULL, 100000 + event_id FROM f"""
)
def audit_rows(s, d):
    """Events of the same process in time order: descriptors stand for what was opened or connected last."""
    return A.interpret_events(_audit_events(s, d), ["host"]).select("event_id", "action", "file", "ip", "port", "child")


@query(
    _E + """, f AS (SELECT *, '/home/' || rel || '/f' || k || '.txt' AS file FROM e)
    SELECT event_id * 6 + 1 AS event_id, file AS subject, 'File' AS kind, '/bin/cat' AS object FROM f
    UNION ALL SELECT event_id * 6 + 3, '/bin/cat', 'Process', '10.0.0.' || k || '/80' FROM f UNION ALL SELECT event_id * 6 + 5, '/bin/cat', 'Process', CAST(100000 + event_id AS VARCHAR) FROM f"""
)
def audit_directions(s, d):
    turned = A.audit_event(A.interpret_events(_audit_events(s, d), ["host"]).filter("event_id % 6 in (1, 3, 5)"))
    return turned.select("event_id", F.col("subject.name").alias("subject"), F.col("subject.type").alias("kind"), F.col("object.name").alias("object"))


@query(_E + " SELECT event_id, us // 1000 * 1000 AS ts_us, 'CWD' AS kind, '/x ' || k AS cwd FROM e")
def audit_search(s, d):
    """Interpreted search output, its dates printed in two ways."""
    date = "{case when k % 2 = 0 then date_format(ts, 'MM/dd/yyyy HH:mm:ss.SSS') else concat(date_format(ts, 'yyyy'), '年', date_format(ts, 'MM'), '月', date_format(ts, 'dd'), '日 ', date_format(ts, 'HH:mm:ss.SSS')) end}"
    lines = _events(s, d).select(_line("type=CWD msg=audit(" + date + ":{event_id}) : cwd=/x {k}").alias("line"))
    return A.searched_lines(lines).select("event_id", "ts_us", "kind", F.col("fields")["cwd"].alias("cwd"))


@query(_E + " SELECT count(*) AS n_events, 3 * count(*) AS n_lines FROM e")
def audit_delimited(s, d):
    """Search output whose events end at dashes: events are numbered by the dashes before them."""
    e = _events(s, d)
    parts = F.array(F.lit("type=SYSCALL msg=audit(x:1) : a=1"), F.lit("type=CWD msg=audit(x:1) : cwd=/"), F.lit("type=PATH msg=audit(x:1) : name=b"), F.lit("----"))
    lines = e.select("event_id", F.posexplode(parts).alias("k", "line")).select((F.col("event_id") * 4 + F.col("k")).alias("seq"), "line")
    numbered = A.delimited_events(lines, "seq")
    return numbered.agg(F.count_distinct("event_no").alias("n_events"), F.count(F.lit(1)).alias("n_lines"))


@query(
    _E + """ SELECT event_id, CASE WHEN k % 2 = 0 THEN '/abs/' || k ELSE '/base/r' || k END AS joined, 'a b' AS decoded,
    CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN 'r' WHEN k % 4 = 2 THEN 'w' ELSE 'rw' END AS mode FROM e"""
)
def audit_paths(s, d):
    name = F.when(F.col("k") % 2 == 0, _line("/abs/{k}")).otherwise(_line("r{k}"))
    mode = A.mapped_mode((F.col("k") % 4).cast("string"), F.when(F.col("k") % 4 == 0, "22").otherwise("1"))
    return _events(s, d).select("event_id", A.joined_path(F.lit("/base"), name).alias("joined"), A.decoded_name(F.lit("612062")).alias("decoded"), mode.alias("mode"))


@query("SELECT DISTINCT CAST(user_id AS INTEGER) AS number, 'call_' || user_id AS name FROM events")
def call_numbers(s, d):
    """A system header of numbered calls, written and read."""
    from uuid import uuid4

    path = f"{shared_folder(s)}/header-{uuid4().hex}"
    _events(s, d).select("u").distinct().select(_line("#define __NR_call_{u} {u}").alias("value")).write.text(path)
    return A.syscall_names(s, path)
