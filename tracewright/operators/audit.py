"""System-call records: raw lines to events, and events to rows with the files and addresses they touch.

Lines are parsed by column expressions and grouped by event id, keys of which no one is large. What
a descriptor stands for depends on earlier calls of the same process and of those it was copied
from, so events are folded in time order per host (or process tree); rows reach the fold sorted and
in batches, and it holds only the descriptor tables of living processes.

Defined results: lines without an event id are set aside by ``raw_lines`` (null ``event_id``);
repeated keys of a line keep the last value; an unknown descriptor reads as /proc/<pid>/fd/<n>; an
exit that is no number is kept as ``error``; empty tables give no rows.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.parsers import key_values, let

#: Calls by what they touch (fixed values of the system's interface).
DUAL_PATH = ["rename", "link", "symlink", "renameat", "renameat2", "linkat", "symlinkat", "pivot_root", "mount"]
PATH = [
    "open", "stat", "lstat", "access", "shmat", "execve", "shmdt", "truncate", "chdir", "mkdir", "rmdir", "creat", "unlink", "chmod",
    "chown", "lchown", "utime", "mknod", "statfs", "chroot", "acct", "umount2", "swapon", "swapoff", "setxattr", "lsetxattr", "getxattr",
    "lgetxattr", "listxattr", "llistxattr", "removexattr", "lremovexattr", "utimes", "inotify_add_watch", "openat", "mkdirat", "mknodat",
    "fchownat", "futimeat", "newfstatat", "unlinkat", "readlinkat", "fchmodat", "faccessat", "epoll_pwait", "execveat",
]
#: Calls that may come with several path lines.
MANY_PATHS = ["openat", "creat", "unlinkat", "unlink", "open"]
SOCKET = ["connect", "accept", "sendto", "recvfrom", "getsockname", "getpeername", "accept4"]
FILE_FD = [
    "read", "write", "readv", "writev", "close", "lseek", "fstat", "ioctl", "pread", "pwrite", "pread64", "pwrite64", "fcntl", "flock",
    "fsync", "fdatasync", "ftruncate", "getdents", "fchdir", "fchmod", "fchown", "fstatfs", "readahead", "fsetxattr", "fgetxattr",
    "flistxattr", "fremovexattr", "getdents64", "fadvice64", "vmsplice", "finit_module",
]
NET_FD = ["sendmsg", "send", "sendto", "recvmsg", "recvfrom", "recv", "shutdown", "listen", "connect", "bind"]
POLL_FD = ["epoll_wait", "epoll_pwait", "epoll_pwait2"]
RETURNS_FD = ["open", "openat", "creat"]
MAKES_FD = {"socket": "socket", "pipe": "pipe", "pipe2": "pipe", "epoll_create": "epoll", "epoll_create1": "epoll", "memfd_create": "memfd", "eventfd2": "eventfd"}
DUPLICATES = ["dup", "dup2", "dup3"]
FORKS = ["fork", "vfork", "clone", "clone3"]
#: Calls on a descriptor in their first argument: those above, and further ones of sockets and polls.
USES_FD = [*FILE_FD, *NET_FD, *POLL_FD, "getsockopt", "setsockopt", "getsockname", "getpeername", "epoll_ctl"]
BINDS = ["bind", "connect", "accept", "accept4"]
TWO_FDS = ["sendfile", "splice", "tee", "copy_file_range"]
#: Calls in which data moves from the object to the process (fixed values).
REVERSED = [
    "sys_read", "sys_pread64", "sys_readv", "sys_getitimer", "sys_getpid", "sys_accept", "sys_recvfrom", "sys_recvmsg", "sys_getsockname",
    "sys_getpeername", "sys_getsockopt", "sys_readlink", "sys_getdents", "sys_getcwd", "sys_gettimeofday", "sys_getrlimit", "sys_accept4",
    "sys_getrusage", "sys_getuid", "sys_getgid", "sys_geteuid", "sys_getegid", "sys_getppid", "sys_getpgrp", "sys_getgroups", "sys_getresuid",
    "sys_getresgid", "sys_getpgid", "sys_getsid", "sys_getpriority", "sys_getxattr", "sys_lgetxattr", "sys_fgetxattr", "sys_getdents64",
    "sys_timer_gettime", "sys_get_mempolicy", "sys_readlinkat",
]
#: Where systems keep the header that numbers their calls.
HEADER = "/usr/include/x86_64-linux-gnu/asm/unistd_64.h"


def touched_by(name: Column) -> Column:
    """What a call touches: two paths, a path, a socket, a descriptor, or null."""
    kinds = (("paths", DUAL_PATH), ("path", PATH), ("socket", SOCKET), ("descriptor", [*FILE_FD, *NET_FD, *POLL_FD]))
    return F.coalesce(*[F.when(name.isin(names), F.lit(kind)) for kind, names in kinds])


def raw_lines(lines: DataFrame, text: str = "line") -> DataFrame:
    """(event_id, ts_us, kind, fields) and the columns given, of ``type=T msg=audit(sec.ms:id): k=v ...`` lines.

    After a group separator (0x1D) come the enriched fields, which win over the raw ones.
    """
    head = r"type=(\S+) msg=audit\((\d+)\.(\d+):(\d+)\):\s*(.*)$"
    part = lambda k: F.regexp_extract(text, head, k)
    body = F.split(part(5), "\x1d")
    plain = F.regexp_replace(F.get(body, F.lit(0)), r"[{}]", "")
    more = F.coalesce(F.get(body, F.lit(1)), F.lit(""))
    enriched = F.transform_keys(key_values(more), lambda k, v: F.lower(k))
    merged = let(enriched, lambda more: F.map_concat(F.map_filter(key_values(plain), lambda k, v: ~F.map_contains_key(more, k)), more))
    merged = F.when(more == "", key_values(plain)).otherwise(merged)
    at = part(2).try_cast("bigint") * 1_000_000 + F.rpad(F.substring(part(3), 1, 6), 6, "0").try_cast("bigint")
    return lines.withColumns(
        {"event_id": part(4).try_cast("bigint"), "ts_us": at, "kind": part(1), "fields": merged}
    )


def searched_lines(lines: DataFrame, text: str = "line") -> DataFrame:
    """As ``raw_lines`` for the interpreted search output, whose stamps are US or Chinese dates or numbers."""
    stamp = F.regexp_extract(text, r"msg=audit\((.*?):(\d+)\)", 1)
    us = F.try_to_timestamp(F.regexp_replace(stamp, r"\.\d+$", ""), F.lit("MM/dd/yyyy HH:mm:ss"))
    cn = F.try_to_timestamp(F.regexp_replace(stamp, r"\.\d+$", ""), F.lit("yyyy年MM月dd日 HH:mm:ss"))
    whole = F.coalesce(F.unix_micros(us), F.unix_micros(cn), F.regexp_extract(stamp, r"^(\d+)\.\d+$", 1).try_cast("bigint") * 1_000_000)
    fraction = F.rpad(F.regexp_extract(stamp, r"\.(\d{1,6})$", 1), 6, "0").try_cast("bigint")
    body = F.regexp_extract(text, r"msg=audit\(.*?\)\s*:\s*(.*)$", 1)
    return lines.withColumns(
        {
            "event_id": F.regexp_extract(text, r"msg=audit\(.*?:(\d+)\)", 1).try_cast("bigint"), "ts_us": whole + fraction,
            "kind": F.regexp_extract(text, r"type=(\S+)", 1), "fields": key_values(F.regexp_replace(body, r"[{}]", "")),
        }
    )


def delimited_events(lines: DataFrame, seq: str, text: str = "line") -> DataFrame:
    """Lines of search output with ``event_no``: dashes end an event and are dropped themselves."""
    from tracewright.operators.ordering import global_running_sum

    ends = F.startswith(F.col(text), F.lit("--"))
    counted = global_running_sum(lines.withColumn("event_no", ends.cast("bigint")), "event_no", [seq], "__n")
    return counted.filter(~F.coalesce(ends, F.lit(False))).withColumn("event_no", F.col("__n")).drop("__n")


def assemble(lines: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row per event: its call fields, and its other lines in order as (kind, fields)."""
    parts = F.filter(F.collect_list(F.struct(F.col(seq).alias("seq"), "kind", "fields")), lambda p: p["kind"] != "SYSCALL")
    in_order = F.array_sort(parts, lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0))
    call = F.max_by("fields", F.when(F.col("kind") == "SYSCALL", F.col(seq)))
    return (
        lines.filter("event_id is not null")
        .groupBy(*keys, "event_id")
        .agg(F.min("ts_us").alias("ts_us"), in_order.alias("parts"), F.max((F.col("kind") == "SYSCALL").cast("int")).alias("__c"), call.alias("call"))
        .withColumn("call", F.when(F.col("__c") == 1, F.col("call")))
        .drop("__c")
    )


def syscall_names(spark: SparkSession, header: str = HEADER) -> DataFrame:
    """(number, name) from a system header of ``#define __NR_name number`` lines."""
    text = spark.read.text(header)
    pattern = r"^#define\s+__NR_(\w+)\s+(\d+)"
    return text.select(
        F.regexp_extract("value", pattern, 2).try_cast("int").alias("number"), F.regexp_extract("value", pattern, 1).alias("name")
    ).filter("number is not null")


def decoded_name(name: Column) -> Column:
    """A path given in hexadecimal as text."""
    even = F.length(name) % 2 == 0
    return F.when(name.rlike("^[0-9A-Fa-f]{2,}$") & even, F.decode(F.unhex(name), "UTF-8")).otherwise(name)


def joined_path(base: Column, name: Column) -> Column:
    """base/name; an absolute name stands alone."""
    return F.when(F.startswith(name, F.lit("/")) | base.isNull(), name).otherwise(F.concat(F.regexp_replace(base, "/$", ""), F.lit("/"), name))


def mapped_mode(prot: Column, flags: Column) -> Column:
    """r, w or rw of a mapping; anonymous ones have none."""
    p, f = F.conv(prot, 16, 10).cast("bigint"), F.conv(flags, 16, 10).cast("bigint")
    reads, writes = p.bitwiseAND(1) > 0, p.bitwiseAND(2) > 0
    return F.when(f.bitwiseAND(0x20) > 0, None).when(reads & writes, "rw").when(reads, "r").when(writes, "w")


def socket_address(saddr: str | None) -> tuple[str | None, int | None]:
    """(ip or local path, port) of a socket address in hexadecimal or text."""
    if not saddr:
        return None, None
    if found := re.search(r"inet6? host: ?(\S+) serv: ?(\d+)", saddr):
        return found[1], int(found[2])
    if found := re.search(r"local (\S+)", saddr):
        return found[1], None
    if not re.fullmatch(r"(?:[0-9A-Fa-f]{2})+", saddr):
        return None, None
    data = bytes.fromhex(saddr)
    family = data[0] + (data[1] << 8) if len(data) > 1 else 0
    if family == 2 and len(data) >= 8:
        return str(ipaddress.IPv4Address(data[4:8])), int.from_bytes(data[2:4], "big")
    if family == 10 and len(data) >= 24:
        address = ipaddress.IPv6Address(data[8:24])
        mapped = address.ipv4_mapped
        return (f"::ffff:{mapped}" if mapped and mapped.is_private else str(mapped or address)), int.from_bytes(data[2:4], "big")
    if family == 1:
        return data[2:].split(b"\0")[0].decode("utf-8", "replace") or None, None
    return None, None


ROW_SCHEMA = (
    "event_id bigint, ts_us bigint, process_name string, action string, pid int, ppid int, file string, ip string, port int, "
    "return bigint, error string, success string, comm string, exe string, child int"
)


class Descriptors:
    """What the descriptors of each process stand for."""

    def __init__(self) -> None:
        self.of: dict[int, dict[int, tuple[str | None, str | None, int | None]]] = {}

    def find(self, pid: int, fd: int) -> tuple[str | None, str | None, int | None]:
        return self.of.get(pid, {}).get(fd, (f"/proc/{pid}/fd/{fd}", None, None))

    def put(self, pid: int, fd: int, what: tuple[str | None, str | None, int | None]) -> None:
        self.of.setdefault(pid, {})[fd] = what

    def copy(self, parent: int, child: int) -> None:
        self.of[child] = dict(self.of.get(parent, {}))


def _number(value: str | None, base: int = 10) -> int | None:
    try:
        return int(value, base) if value is not None else None
    except ValueError:
        return None


def _path(base: str | None, name: str) -> str:
    return name if name.startswith("/") or not base else f"{base.rstrip('/')}/{name}"


def interpret(call: dict, parts: list, table: Descriptors) -> list[dict]:
    """The rows of one event; ``table`` is brought up to date."""
    name = call.get("syscall", "").lower()
    pid, ppid = _number(call.get("pid")), _number(call.get("ppid"))
    out = _number(call.get("exit"))
    ok = call.get("success", "yes") == "yes"
    row = {
        "process_name": call.get("exe") or call.get("comm"), "action": f"sys_{name}", "pid": pid, "ppid": ppid, "file": None, "ip": None,
        "port": None, "return": out, "error": None if out is not None else call.get("exit"), "success": "yes" if ok else "no",
        "comm": call.get("comm"), "exe": call.get("exe"), "child": None,
    }
    arguments = [_number(call.get(f"a{k}"), 16) for k in range(4)]
    cwd = next((f.get("cwd") for k, f in parts if k == "CWD"), None)
    address = next((socket_address(f.get("saddr")) for k, f in parts if k == "SOCKADDR"), None)
    paths = [f for k, f in parts if k == "PATH" and f.get("name") not in (None, "(null)")]
    for f in paths:
        if re.fullmatch(r"(?:[0-9A-Fa-f]{2}){2,}", f["name"]) and not f["name"].isdigit():
            f["name"] = bytes.fromhex(f["name"]).decode("utf-8", "replace")

    def touched(fd: int | None) -> dict:
        file, ip, port = table.find(pid, fd) if fd is not None else (None, None, None)
        return {"file": file, "ip": ip, "port": port}

    if pid is None:
        return []
    if name in FORKS:
        if ok and out:
            table.copy(pid, out)
            return [row | {"child": out}]
        return [row]
    if name in DUPLICATES:
        if ok and out is not None and arguments[0] is not None:
            table.put(pid, out, table.find(pid, arguments[0]))
        return [row | touched(arguments[0])]
    if name in MAKES_FD:
        if ok and out is not None and MAKES_FD[name] != "pipe":
            table.put(pid, out, (f"{MAKES_FD[name]}:[{pid}:{out}]", None, None))
        for k, f in parts:
            if k == "FD_PAIR":
                for end in ("fd0", "fd1"):
                    if (fd := _number(f.get(end))) is not None:
                        table.put(pid, fd, (f"pipe:[{pid}:{fd}]", None, None))
        return [row | {"file": f"{MAKES_FD[name]}:[{pid}:{out}]"}]
    if name in BINDS:
        fd = out if name.startswith("accept") else arguments[0]
        if address and ok and fd is not None:
            table.put(pid, fd, (None if address[1] is not None else address[0], address[0] if address[1] is not None else None, address[1]))
        return [row | touched(fd)]
    if name in SOCKET and address:
        return [row | {"ip": address[0] if address[1] is not None else None, "port": address[1], "file": None if address[1] is not None else address[0]}]
    if name in TWO_FDS:
        a, b = (1, 0) if name == "sendfile" else (0, 1)
        one = row | touched(arguments[a]) | {"action": f"sys_{name}_IN"}
        return [one, row | touched(arguments[b]) | {"action": f"sys_{name}_OUT"}]
    if name == "mmap":
        fd = next((_number(f.get("fd")) for k, f in parts if k == "MMAP"), arguments[3] if len(arguments) > 3 else None)
        return [row | touched(fd)] if fd is not None and fd < 1 << 31 else []
    if name in USES_FD:
        rows = [row | touched(arguments[0])]
        if name == "close" and ok and arguments[0] is not None:
            table.of.get(pid, {}).pop(arguments[0], None)
        return rows
    if name in ("exit", "exit_group"):
        table.of.pop(pid, None)
        return [row]
    at = arguments[0]
    base = cwd
    if name.endswith("at") or name.endswith("at2"):
        known = table.find(pid, at)[0] if at is not None and at < 1 << 31 else None
        base = known if known and known.startswith("/") and not known.startswith("/proc/") else cwd
    parent = next((f["name"] for f in paths if f.get("nametype") == "PARENT"), None)
    own = [f for f in paths if f.get("nametype") != "PARENT"]
    if name in DUAL_PATH:
        return [row | {"file": _path(base, f["name"]), "action": f"sys_{name}_{f.get('nametype', 'NORMAL')}"} for f in own or paths]
    if not own and parent is None:
        return [row | (touched(at) if name.startswith("f") else {})]
    target = own[0] if own else {"name": parent}
    full = target["name"]
    if parent and not full.startswith("/") and not full.startswith(parent):
        full = _path(parent, full)
    row["file"] = _path(base, full)
    if target.get("nametype") == "CREATE":
        row["action"] += "_CREATE"
    if name == "unlinkat" and (arguments[2] or 0) & 0x200:
        row["action"] += "_DIR"
    if name in RETURNS_FD and ok and out is not None:
        table.put(pid, out, (row["file"], None, None))
    return [row]


def interpret_events(events: DataFrame, keys: list[str], keep: list[str] | None = None) -> DataFrame:
    """Rows of assembled events per host or process tree (``keys``), folded in time order.

    ``keep`` names programs whose rows come out; those of others still move descriptors.
    """
    names = [f.split()[0] for f in ROW_SCHEMA.split(", ")]
    schema = ", ".join(f"`{c}` {events.schema[c].dataType.simpleString()}" for c in keys) + ", " + ROW_SCHEMA.replace("return ", "`return` ")
    flat = events.filter("call is not null").select(
        *keys, "event_id", "ts_us", F.to_json("call").alias("call"), F.to_json(F.transform("parts", lambda p: F.struct(p["kind"].alias("k"), p["fields"].alias("f")))).alias("parts")
    )
    ordered = flat.repartition(*keys).sortWithinPartitions(*keys, "ts_us", "event_id")

    def wanted(row: dict) -> bool:
        return not keep or row["comm"] in keep or any(k in (row["exe"] or "") for k in keep)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        current, table = None, Descriptors()
        for batch in batches:
            rows = []
            columns = [batch[c].tolist() for c in keys]
            for k, record in zip(zip(*columns, strict=True), batch.itertuples(index=False), strict=True):
                if k != current:
                    current, table = k, Descriptors()
                parts = [(p.get("k"), p.get("f") or {}) for p in json.loads(record.parts)]
                for row in interpret(json.loads(record.call), parts, table):
                    if wanted(row):
                        rows.append((*k, record.event_id, record.ts_us, *[row[n] for n in names[2:]]))
            frame = pd.DataFrame(rows, columns=[*keys, *names])
            for c in ("pid", "ppid", "port", "return", "child"):
                frame[c] = frame[c].astype("Int64")
            yield frame

    return ordered.mapInPandas(fold, schema)


def audit_event(rows: DataFrame) -> DataFrame:
    """Rows as (subject, object): the process and its child, file, socket or itself, turned where data comes in."""
    socket = F.when(F.col("ip").isNotNull(), F.concat_ws("/", "ip", F.col("port").cast("string")))
    other = F.coalesce(F.col("child").cast("string"), "file", socket, "process_name")
    kind = F.when(F.col("child").isNotNull(), "Process").when(F.col("file").isNotNull(), "File").when(socket.isNotNull(), "Socket").otherwise("Process")
    process = F.struct(F.lit("Process").alias("type"), F.col("process_name").alias("name"))
    thing = F.struct(kind.alias("type"), other.alias("name"))
    turned = F.col("action").isin(REVERSED)
    return rows.withColumns({"subject": F.when(turned, thing).otherwise(process), "object": F.when(turned, process).otherwise(thing)})
