from pyspark.sql import functions as F

from tracewright.operators import audit as A

LINES = [
    'type=SYSCALL msg=audit(1700000000.100:1): syscall=openat success=yes exit=3 a0=ffffff9c a1=7f a2=0 items=1 ppid=1 pid=10 comm="cat" exe="/bin/cat" key=(null)',
    'type=CWD msg=audit(1700000000.100:1): cwd="/home/u"',
    'type=PATH msg=audit(1700000000.100:1): item=0 name="notes.txt" nametype=NORMAL',
    'type=SYSCALL msg=audit(1700000000.200:2): syscall=read success=yes exit=5 a0=3 ppid=1 pid=10 comm="cat" exe="/bin/cat"',
    'type=SYSCALL msg=audit(1700000000.300:3): syscall=clone success=yes exit=11 a0=0 ppid=1 pid=10 comm="cat" exe="/bin/cat"',
    'type=SYSCALL msg=audit(1700000000.400:4): syscall=write success=yes exit=5 a0=3 ppid=10 pid=11 comm="cat" exe="/bin/cat"',
    'type=SYSCALL msg=audit(1700000000.500:5): syscall=close success=yes exit=0 a0=3 ppid=10 pid=11 comm="cat" exe="/bin/cat"',
    'type=SYSCALL msg=audit(1700000000.600:6): syscall=read success=no exit=EBADF a0=3 ppid=10 pid=11 comm="cat" exe="/bin/cat"',
    'type=SYSCALL msg=audit(1700000000.700:7): syscall=connect success=yes exit=0 a0=4 ppid=1 pid=10 comm="cat" exe="/bin/cat"',
    "type=SOCKADDR msg=audit(1700000000.700:7): saddr=020000500A000005",
    'type=SYSCALL msg=audit(1700000000.800:8): syscall=sendto success=yes exit=9 a0=4 ppid=1 pid=10 comm="cat" exe="/bin/cat"',
    'type=SYSCALL msg=audit(1700000000.900:9): syscall=rename success=yes exit=0 a0=1 ppid=1 pid=10 comm="mv" exe="/bin/mv"',
    'type=CWD msg=audit(1700000000.900:9): cwd="/d"',
    'type=PATH msg=audit(1700000000.900:9): item=0 name="a" nametype=DELETE',
    'type=PATH msg=audit(1700000000.900:9): item=1 name=2F622063 nametype=CREATE',
    'type=SYSCALL msg=audit(1700000001.000:10): syscall=dup2 success=yes exit=7 a0=4 a1=7 ppid=1 pid=10 comm="cat" exe="/bin/cat"',
    'type=SYSCALL msg=audit(1700000001.100:11): syscall=sendfile success=yes exit=7 a0=7 a1=3 ppid=1 pid=10 comm="cat" exe="/bin/cat"',
    "no record at all",
]


def test_lines_to_rows(spark):
    lines = spark.createDataFrame([("h", k, line) for k, line in enumerate(LINES)], "host string, seq int, line string")
    events = A.assemble(A.raw_lines(lines), ["host"], "seq")
    assert events.count() == 11
    rows = {}
    for r in A.interpret_events(events, ["host"]).orderBy("event_id").collect():
        rows.setdefault(r.event_id, []).append(r)
    assert rows[1][0].file == "/home/u/notes.txt" and rows[1][0].ts_us == 1_700_000_000_100_000
    assert rows[2][0].file == "/home/u/notes.txt" and rows[2][0].action == "sys_read"
    assert rows[3][0].child == 11 and rows[4][0].file == "/home/u/notes.txt"
    assert rows[6][0].file == "/proc/11/fd/3" and rows[6][0].error == "EBADF" and rows[6][0].success == "no"
    assert (rows[8][0].ip, rows[8][0].port) == ("10.0.0.5", 80)
    assert [(r.file, r.action) for r in rows[9]] == [("/d/a", "sys_rename_DELETE"), ("/b c", "sys_rename_CREATE")]
    assert [(r.file, r.ip, r.action) for r in rows[11]] == [("/home/u/notes.txt", None, "sys_sendfile_IN"), (None, "10.0.0.5", "sys_sendfile_OUT")]
    only = A.interpret_events(events, ["host"], keep=["mv"])
    assert only.count() == 2
    turned = A.audit_event(A.interpret_events(events, ["host"]).filter("event_id = 2")).first()
    assert turned.subject.name == "/home/u/notes.txt" and turned.object.type == "Process"
    assert A.interpret_events(events.limit(0), ["host"]).count() == 0


def test_enriched_fields_win_and_search_output(spark):
    raw = "type=SYSCALL msg=audit(1700000000.1:1): arch=c000003e syscall=2 a=1\x1dARCH=x86_64 SYSCALL=open"
    found = A.raw_lines(spark.createDataFrame([(raw,)], "line string")).first()
    assert found.fields["syscall"] == "open" and found.fields["a"] == "1" and found.ts_us == 1_700_000_000_100_000
    lines = ["type=CWD msg=audit(03/01/2024 10:00:00.250:77) : cwd=/x y", "type=CWD msg=audit(2024年03月01日 10:00:00.250:78) : cwd=/x", "type=CWD msg=audit(1709287200.250:79) : cwd=/x"]
    rows = A.searched_lines(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert {r.ts_us for r in rows} == {1_709_287_200_250_000} and rows[0].fields["cwd"] == "/x y"


def test_small_parts(spark):
    assert A.socket_address("0A0000500000000000000000000000000000FFFF0A00000500000000") == ("::ffff:10.0.0.5", 80)
    assert A.socket_address("inet host: 1.2.3.4 serv: 99") == ("1.2.3.4", 99)
    assert A.socket_address("01002F746D702F7300") == ("/tmp/s", None) and A.socket_address("zz") == (None, None)
    one = spark.range(1).select(
        A.joined_path(F.lit("/a"), F.lit("b")).alias("p"), A.joined_path(F.lit("/a"), F.lit("/c")).alias("q"), A.decoded_name(F.lit("2F612062")).alias("n"),
        A.mapped_mode(F.lit("3"), F.lit("1")).alias("m"), A.mapped_mode(F.lit("1"), F.lit("22")).alias("x"),
    ).first()
    assert tuple(one) == ("/a/b", "/c", "/a b", "rw", None)


def test_syscall_names_from_a_header(spark, tmp_path):
    (tmp_path / "unistd.h").write_text("#define __NR_read 0\n#define __NR_write 1\n#define OTHER 5\n")
    assert sorted(map(tuple, A.syscall_names(spark, str(tmp_path / "unistd.h")).collect())) == [(0, "read"), (1, "write")]
