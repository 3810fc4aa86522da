"""Correlation rules per program: which application record a network record belongs to.

Applications have (app_seq, at, host, url, port, pid, state, statement), networks (net_seq, at, src,
dst, src_port, dst_port, protocol, payload, uri, file); a rule uses the columns it names. Every rule
gives (net_seq, app_seq): one application record a network record, which is its label. Rules are
equi-joins and ranks, so no rule compares all records with all others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.correlate import any_match, asof_forward, first_and_last, rank_to_rank


def _tcp() -> Column:
    return F.upper(F.coalesce("protocol", F.lit(""))) == "TCP"


def _host_or_payload(apps: DataFrame, nets: DataFrame, last: bool) -> DataFrame:
    """Host is either end, or the payload of a net above TCP is the url; the first (or last) application wins."""
    shaped = nets.withColumn("said", F.when(~_tcp(), F.col("payload")))
    return any_match(shaped, apps, [(["src"], ["host"]), (["dst"], ["host"]), (["said"], ["url"])], "net_seq", "app_seq", last)


def apache(apps: DataFrame, nets: DataFrame) -> DataFrame:
    return _host_or_payload(apps, nets, last=False)


def proftpd(apps: DataFrame, nets: DataFrame) -> DataFrame:
    return _host_or_payload(apps, nets, last=True)


def mini_httpd(apps: DataFrame, nets: DataFrame) -> DataFrame:
    return any_match(nets, apps, [(["src"], ["host"]), (["dst"], ["host"])], "net_seq", "app_seq")


def redis(apps: DataFrame, nets: DataFrame) -> DataFrame:
    """Address and port for TCP, address only above it; the last application wins."""
    tcp = any_match(nets.filter(_tcp()), apps, [(["src", "src_port"], ["host", "port"]), (["dst", "dst_port"], ["host", "port"])], "net_seq", "app_seq", True)
    rest = any_match(nets.filter(~_tcp()), apps, [(["src"], ["host"]), (["dst"], ["host"])], "net_seq", "app_seq", True)
    return tcp.union(rest)


def openssh(apps: DataFrame, nets: DataFrame) -> DataFrame:
    """A connect takes the first three records of its port, a disconnect the last four."""
    ports = nets.select("net_seq", "at", F.explode(F.array("src_port", "dst_port")).alias("port")).distinct()
    ends = first_and_last(ports, ["port"], ["at", "net_seq"], 3, 4)
    joined = ends.join(apps.select("app_seq", "port", "state"), "port")
    wanted = ((F.col("state") == "Connect") & (F.col("rank_first") <= 3)) | ((F.col("state") == "Disconnect") & (F.col("rank_last") <= 4))
    return joined.filter(wanted).groupBy("net_seq").agg(F.min("app_seq").alias("app_seq"))


def _tuple_key() -> Column:
    """A connection whichever way its packets go."""
    one, two = F.concat_ws("|", "src", "src_port"), F.concat_ws("|", "dst", "dst_port")
    return F.concat_ws("~", F.least(one, two), F.greatest(one, two))


def _propagated(nets: DataFrame, bound: DataFrame) -> DataFrame:
    """Every record of a bound connection takes the first application bound to it."""
    keyed = nets.withColumn("key", _tuple_key())
    labels = bound.join(keyed.select("net_seq", "key"), "net_seq").groupBy("key").agg(F.min("app_seq").alias("app_seq"))
    return keyed.join(labels, "key").select("net_seq", "app_seq")


def php(apps: DataFrame, nets: DataFrame) -> DataFrame:
    """The k-th request for a url from a host is the k-th record of it; both ways of its connection follow."""
    asked = nets.filter(~_tcp()).select("net_seq", "at", F.col("src").alias("host"), F.col("payload").alias("url"))
    bound = rank_to_rank(apps.select("app_seq", F.col("at").alias("app_at"), "host", "url"), asked, ["host", "url"], ["app_at", "app_seq"], ["at", "net_seq"])
    return _propagated(nets, bound.select("net_seq", "app_seq"))


def nginx(apps: DataFrame, nets: DataFrame) -> DataFrame:
    """As for PHP; applications left over take their host's free TCP records in turn, and those follow too."""
    first = php(apps, nets)
    free_apps = apps.join(first.select("app_seq").distinct(), "app_seq", "left_anti")
    free_nets = nets.join(first.select("net_seq"), "net_seq", "left_anti").filter(_tcp())
    opened = free_nets.withColumn("key", _tuple_key()).groupBy("src", "key").agg(F.min(F.struct("at", "net_seq")).alias("x"))
    opened = opened.select(F.col("src").alias("host"), F.col("x.at").alias("at"), F.col("x.net_seq").alias("net_seq"))
    forced = rank_to_rank(free_apps.select("app_seq", F.col("at").alias("app_at"), "host"), opened, ["host"], ["app_at", "app_seq"], ["at", "net_seq"])
    taken = _propagated(nets, forced.select("net_seq", "app_seq")).join(first.select("net_seq"), "net_seq", "left_anti")
    return first.union(taken)


def postgres(apps: DataFrame, nets: DataFrame) -> DataFrame:
    """The session's port, else the first statement of the same text at or after the record."""
    by_port = any_match(nets, apps, [(["src_port"], ["port"]), (["dst_port"], ["port"])], "net_seq", "app_seq")
    rest = nets.join(by_port.select("net_seq"), "net_seq", "left_anti").filter("payload is not null")
    later = asof_forward(
        rest.select(F.col("payload").alias("text"), "net_seq", "at"), apps.select(F.col("statement").alias("text"), "app_seq", "at"),
        ["text"], "net_seq", "at", "app_seq", "at",
    )
    return by_port.union(later.filter("app_seq is not null").select("net_seq", "app_seq"))


def imagemagick(apps: DataFrame, nets: DataFrame) -> DataFrame:
    """The k-th upload of a source belongs to its k-th process; the process is named by its first record.

    Sources bound the ranks: where records name none, all share the source ''.
    """
    uploads = nets.filter("file is not null").select("net_seq", "at", F.coalesce("src", F.lit("")).alias("source"))
    processes = apps.groupBy(F.coalesce("host", F.lit("")).alias("source"), "pid").agg(F.min(F.struct("at", "app_seq")).alias("x"))
    named = processes.select("source", F.col("x.at").alias("app_at"), F.col("x.app_seq").alias("app_seq"))
    return rank_to_rank(named, uploads, ["source"], ["app_at", "app_seq"], ["at", "net_seq"]).select("net_seq", "app_seq")


def vim(apps: DataFrame, nets: DataFrame) -> DataFrame:
    """Editors leave no network records: applications are labelled, nothing is joined."""
    return nets.join(apps.select("app_seq").limit(0), F.lit(False)).select("net_seq", "app_seq")


RULES: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "apache": apache, "proftpd": proftpd, "mini_httpd": mini_httpd, "redis": redis, "openssh": openssh, "php": php, "nginx": nginx,
    "postgres": postgres, "imagemagick": imagemagick, "vim": vim,
}


def correlate(program: str, apps: DataFrame, nets: DataFrame) -> DataFrame:
    """Every network record with the application record that the program's rule gives it, null where it gives none."""
    if program not in RULES:
        raise ValueError(f"no rule for {program}; there are {', '.join(RULES)}")
    return nets.join(RULES[program](apps, nets), "net_seq", "left")


def compressed(labelled: DataFrame, label: str = "app_seq") -> DataFrame:
    """One record per label and connection; records that carry data all stay."""
    order = Window.partitionBy(label, "src", "dst", "src_port", "dst_port").orderBy("at", "net_seq")
    marked = labelled.withColumn("__k", F.row_number().over(order))
    return marked.filter((F.col("__k") == 1) | F.col("payload").isNotNull()).drop("__k")


def first_of_label(apps: DataFrame, label: str = "label") -> DataFrame:
    """(label, app_seq): the first record of each label."""
    return apps.filter(F.col(label).isNotNull()).groupBy(label).agg(F.min("app_seq").alias("app_seq"))


def fits(rule: dict[str, str], prefix: str = "") -> Column:
    """All fields of a rule equal the record's; texts are compared, so numbers written as texts match."""
    out = F.lit(True)
    for name, value in rule.items():
        out = out & (F.col(prefix + name).cast("string") == F.lit(str(value)))
    return F.coalesce(out, F.lit(False))


def fits_any(rules: list[dict[str, str]], prefix: str = "") -> Column:
    out = F.lit(False)
    for rule in rules:
        out = out | fits(rule, prefix)
    return out


def equality_class(record: Column, classes: dict[str, list[str]], ends: tuple[str, ...] = ()) -> Column:
    """The first class all of whose tokens the record holds; tokens of ``ends`` must stand at its end."""
    out = F.lit(None).cast("string")
    for name, tokens in reversed(list(classes.items())):
        held = F.lit(True)
        for token in tokens:
            held = held & (F.endswith(record, F.lit(token)) if token in ends else F.contains(record, F.lit(token)))
        out = F.when(held, name).otherwise(out)
    return out


def augmented(graphs: DataFrame, graph: str, copies: dict[int, int]) -> DataFrame:
    """Graph rows, those of the named graphs so many times; copies are told apart by ``clone``."""
    times = F.lit(1)
    for g, n in copies.items():
        times = F.when(F.col(graph) == g, n).otherwise(times)
    return graphs.withColumn("clone", F.explode(F.sequence(F.lit(0), times - 1)))
