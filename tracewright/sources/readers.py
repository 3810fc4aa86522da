"""Readers: text logs, packet captures, triples, vectors and result files, under explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions import parsers

#: Packet captures: the layers that are read by name; others stay in the text.
PACKET_SCHEMA = (
    "_source struct<layers: struct<frame: struct<`frame.time_epoch`: string>, ip: struct<`ip.src`: string, `ip.dst`: string>, "
    "ipv6: struct<`ipv6.src`: string, `ipv6.dst`: string>, tcp: struct<`tcp.srcport`: string, `tcp.dstport`: string>, "
    "udp: struct<`udp.srcport`: string, `udp.dstport`: string>, http: map<string, string>, "
    "`urlencoded-form`: map<string, struct<`urlencoded-form.value`: string>>>>"
)
#: Log layouts by name.
LAYOUTS = {
    "apache": parsers.apache, "php": parsers.php, "nginx": parsers.nginx, "mini_httpd": parsers.mini_httpd, "openssh": parsers.openssh,
    "postgres": parsers.postgres, "redis": parsers.redis, "vim": parsers.vim, "imagemagick": parsers.imagemagick, "proftpd": parsers.proftpd,
    "network": parsers.network_text,
}


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line): lines of text files; the order within a file is given by ``numbered_lines``."""
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, seq, line) with seq rising in line order within a file: splits of a file are read in order of their offset."""
    read = spark.read.text(path).select("*", "_metadata.file_path", "_metadata.file_block_start")
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return read.select(F.col("file_path").alias("file"), F.struct(F.col("file_block_start").alias("block"), at.alias("row")).alias("seq"), F.col("value").alias("line"))


def parsed_log(lines: DataFrame, layout: str, text: str = "line") -> tuple[DataFrame, DataFrame]:
    """(rows with the layout's fields in ``fields``, lines that are not of the layout)."""
    read = lines.withColumn("fields", LAYOUTS[layout](F.col(text)))
    # Every layout's first field is there in each of its lines; a struct of nulls is no match.
    first = read.schema["fields"].dataType.names[0]
    matched = F.coalesce(F.col("fields").isNotNull() & F.col(f"fields.{first}").isNotNull(), F.lit(False))
    return read.filter(matched), read.filter(~matched).drop("fields")


def csv_log(spark: SparkSession, path: str) -> DataFrame:
    """Positional columns of a CSV log whose quoted fields span lines."""
    return spark.read.csv(path, header=False, multiLine=True, escape='"', quote='"')


def packets(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Packets with time, addresses and ports; IPv6 ones and those without address are left out.

    One packet a line keeps files splittable; ``lines=False`` reads arrays over whole files.
    """
    read = spark.read.schema(PACKET_SCHEMA).json(path, multiLine=not lines)
    layer = "_source.layers"
    kept = read.filter(f"{layer}.ip.`ip.src` is not null and {layer}.ipv6 is null")
    form = F.map_values(F.col(f"{layer}.`urlencoded-form`"))
    first = F.get(F.map_values(F.col(f"{layer}.http")), F.lit(0))
    port = lambda side: F.coalesce(F.col(f"{layer}.tcp.`tcp.{side}port`"), F.col(f"{layer}.udp.`udp.{side}port`"))
    return kept.select(
        F.col(f"{layer}.frame.`frame.time_epoch`").try_cast("decimal(20,9)").alias("time"), F.col(f"{layer}.ip.`ip.src`").alias("src_ip"),
        F.col(f"{layer}.ip.`ip.dst`").alias("dst_ip"), port("src").alias("src_port"), port("dst").alias("dst_port"),
        F.get_json_object(first, "$['http.request.method']").alias("method"), F.get_json_object(first, "$['http.request.uri']").alias("uri"),
        F.get_json_object(first, "$['http.response.code']").alias("code"), F.transform(form, lambda x: x["urlencoded-form.value"]).alias("form"),
    )


def triples(spark: SparkSession, path: str) -> DataFrame:
    """(s, r, o) of white-space separated lines."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(*[F.get(parts, F.lit(k)).alias(n) for k, n in enumerate("sro")]).filter("o is not null")


def id_names(spark: SparkSession, path: str) -> DataFrame:
    """(name, id) of dictionary files; names may hold blanks, the first line holds a count."""
    pattern = r"^(.*\S)\s+(\d+)\s*$"
    return spark.read.text(path).select(
        F.regexp_extract("value", pattern, 1).alias("name"), F.regexp_extract("value", pattern, 2).try_cast("bigint").alias("id")
    ).filter("id is not null")


def id_triples(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (h, t, r) of id files; the count line has one number only."""
    parts = F.split(F.trim("value"), r"\s+")
    read = spark.read.text(path).select(*[F.get(parts, F.lit(k)).try_cast("bigint").alias(n) for k, n in enumerate("htr")])
    return read.filter("r is not null").distinct()


def vectors(spark: SparkSession, path: str) -> DataFrame:
    """(name, vec) of ``name<TAB>floats`` or ``id<TAB>name<TAB>floats`` lines."""
    parts = F.split("value", "\t")
    numbers = F.transform(F.split(F.trim(F.element_at(parts, -1)), r"[\s,]+"), lambda x: F.regexp_replace(x, r"[\[\]]", "").try_cast("double"))
    return spark.read.text(path).filter(F.size(parts) > 1).select(F.element_at(parts, -2).alias("name"), F.filter(numbers, lambda x: x.isNotNull()).alias("vec"))


def result_metrics(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(file, one column a metric) of result files that hold all of the metrics as ``name: number`` lines."""
    read = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    number = lambda n: F.regexp_extract("value", rf"(?im)^\s*{n}\s*[:=]\s*([-+0-9.eE]+)", 1).try_cast("double").alias(n)
    return read.select("file", *[number(n) for n in names]).dropna()


def name_parts(names: DataFrame, column: str, fields: list[str], separator: str = "_") -> DataFrame:
    """The parameters that a result file's name holds, by position."""
    parts = F.split(F.regexp_replace(F.col(column), r"^.*/|\.[^.]*$", ""), separator)
    return names.select("*", *[F.get(parts, F.lit(k)).alias(f) for k, f in enumerate(fields)])


def parameter_grid(spark: SparkSession, values: dict[str, list]) -> DataFrame:
    """Every combination of parameter values; the lists are typed in, so their product is small."""
    from itertools import product

    return spark.createDataFrame([tuple(str(v) for v in row) for row in product(*values.values())], list(values))


def process_samples(spark: SparkSession, pid: int, every: float, samples: int) -> DataFrame:
    """(at, cpu_percent, memory_mb) of a process of the driver's machine, until it ends or the samples are full."""
    import os
    import time

    ticks, page = os.sysconf("SC_CLK_TCK"), os.sysconf("SC_PAGE_SIZE")
    rows: list[tuple[float, float, float]] = []
    last: tuple[float, float] | None = None
    for _ in range(samples):
        try:
            with open(f"/proc/{pid}/stat") as f:
                fields = f.read().rpartition(")")[2].split()
        except OSError:
            break
        now, used = time.time(), (int(fields[11]) + int(fields[12])) / ticks
        share = 100 * (used - last[1]) / (now - last[0]) if last and now > last[0] else 0.0
        rows.append((now, share, int(fields[21]) * page / 1e6))
        last = (now, used)
        time.sleep(every)
    return spark.createDataFrame(rows, "at double, cpu_percent double, memory_mb double")
