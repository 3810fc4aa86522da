"""Rows that load, typed, and rows that do not, with the reason.

Rows are read permissively under an explicit schema: every field is cast without failing, and the
raw text is kept wherever the row is not whole. Only those corrupt rows are classified again, by
quoting, field count and casts. The delimited layout has bracketed fields and runs of white space
that the built-in CSV reader cannot express, so fields are separated by column expressions; they
are loops over the text, never recursive patterns, and so take rows of any length.

Defined results: a null or blank row fails with ``columns``; rows of an unknown or null feed are
read as ProFTPD rows if they have its 18 fields, else fail with ``columns``; repeated deliveries
(same ``row_id``) count once; rows with null ``row_id`` are each kept; an empty table gives no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stand-ins for escaped characters and for white space inside a field (noncharacters of Unicode).
_BACKSLASH, _QUOTE, _OPEN, _CLOSE, _SPACE, _TAB, _BREAK, _RETURN = (chr(0xFDD0 + k) for k in range(8))
_WHITE = " \t\n\r\x0b\x0c"
_HIDDEN = _SPACE + _TAB + _BREAK + _RETURN + "﷘﷙"
ACCESS_FEEDS = ("ApacheLog", "PhpLog")

#: Names and types under which rows are read.
ACCESS_FIELDS = ["host", "ident", "user", "time", "request", "response_code", "transfer_size", "dash", "dst_ip", "dst_port", "pid"]
TRANSFER_FIELDS = [
    "day_name", "month", "day", "clock", "year", "duration", "host", "transfer_size", "file", "transfer_type",
    "transfer_status", "direction", "mode", "user", "service", "offset", "hash", "ftp_command",
]
TYPES = {"response_code": "int", "transfer_size": "bigint", "duration": "bigint", "year": "int"}


def _escapes(raw: Column) -> Column:
    """The text with escaped characters replaced by stand-ins, so that no backslash is left."""
    text = F.replace(raw, F.lit("\\\\"), F.lit(_BACKSLASH))
    text = F.replace(text, F.lit('\\"'), F.lit(_QUOTE))
    text = F.replace(text, F.lit("\\["), F.lit(_OPEN))
    text = F.replace(text, F.lit("\\]"), F.lit(_CLOSE))
    for white, hidden in zip(_WHITE, _HIDDEN, strict=True):
        text = F.replace(text, F.lit("\\" + white), F.lit(hidden))
    return text


def _shown(text: Column) -> Column:
    for stand_in, char in zip(_BACKSLASH + _QUOTE + _OPEN + _CLOSE + _HIDDEN, '\\"[]' + _WHITE, strict=True):
        text = F.replace(text, F.lit(stand_in), F.lit(char))
    return text


def fields(escaped: Column, brackets: Column) -> Column:
    """The fields of a row whose escapes are resolved: white space separates; quoted, and where ``brackets`` bracketed, text is one field."""

    def hide(text: Column) -> Column:
        return F.translate(text, _WHITE, _HIDDEN)

    def bracketed(text: Column) -> Column:
        pieces = F.split(text, r"\[")
        kept = F.transform(
            pieces,
            lambda x, k: F.when(
                (k > 0) & F.contains(x, F.lit("]")),
                F.concat(hide(F.substring_index(x, "]", 1)), F.expr("''"), F.substring(x, F.instr(x, "]"), F.length(x))),
            ).otherwise(x),
        )
        return F.array_join(kept, "[")

    parts = F.split(escaped, '"')
    hidden = F.transform(
        parts, lambda x, k: F.when(k % 2 == 1, hide(x)).otherwise(F.when(brackets, bracketed(x)).otherwise(x))
    )
    line = F.regexp_replace(F.array_join(hidden, '"'), r"^\s+|\s+$", "")
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.split(line, r"\s+"))


def value(field: Column) -> Column:
    """What a field holds: outer quotes or brackets dropped and escapes resolved."""
    return _shown(F.regexp_replace(field, r'^"([^"]*)"$|^\[([^\[\]]*)\]$', "$1$2"))


def read_permissive(rows: DataFrame) -> DataFrame:
    """Every row under the schema, with ``corrupt_raw`` (the raw text) where it is not whole."""
    feed, raw = F.col("feed"), F.coalesce("raw", F.lit(""))
    access = F.coalesce(feed.isin(*ACCESS_FEEDS), F.lit(False))
    escaped = F.when(F.contains(raw, F.lit("\\")), _escapes(raw)).otherwise(raw)
    quotes = F.length("e") - F.length(F.replace("e", F.lit('"'), F.lit("")))
    split = rows.select("row_id", "feed", "raw", access.alias("access"), escaped.alias("e")).select(
        "row_id", "feed", "raw", "access", (quotes % 2 == 1).alias("unpaired"), fields(F.col("e"), F.col("access")).alias("f")
    )
    split = split.withColumn("n", F.size("f"))

    def at(access_name: str | None, transfer_name: str | None) -> Column:
        one = value(F.get("f", F.lit(ACCESS_FIELDS.index(access_name)))) if access_name else F.lit(None)
        two = value(F.get("f", F.lit(TRANSFER_FIELDS.index(transfer_name)))) if transfer_name else F.lit(None)
        return F.when(F.col("access"), one).otherwise(two).cast("string")

    names = list(dict.fromkeys([*ACCESS_FIELDS, *TRANSFER_FIELDS]))
    split = split.withColumns(
        {f"v_{c}": at(c if c in ACCESS_FIELDS else None, c if c in TRANSFER_FIELDS else None) for c in names}
    )
    sized = F.col("v_transfer_size").rlike("^[0-9]+$") & F.expr(
        "try_cast(regexp_replace(v_transfer_size, '^0+(?=[0-9])', '') as bigint)"
    ).isNotNull()
    access_ok = F.col("v_response_code").rlike("^[1-5][0-9]{2}$") & (sized | (F.col("v_transfer_size") == "-"))
    transfer_ok = sized & F.col("v_transfer_status").isin("_", "c", "i")
    counted = F.when(F.col("access"), F.col("n").isin(7, 11)).otherwise(F.col("n") == 18)
    cast = F.coalesce(F.when(F.col("access"), access_ok).otherwise(transfer_ok), F.lit(False))
    whole = counted & cast & ~F.col("unpaired")
    typed = {
        c: F.expr(f"try_cast(regexp_replace(v_{c}, '^0+(?=[0-9])', '') as {TYPES[c]})") if c in TYPES else F.col(f"v_{c}")
        for c in names
    }
    return split.select(
        "row_id", "feed", F.when(~whole, F.coalesce("raw", F.lit(""))).alias("corrupt_raw"),
        F.col("unpaired"), counted.alias("counted"), (F.trim(F.regexp_replace(raw, r"\s", "")) == "").alias("blank"),
        *[e.alias(c) for c, e in typed.items()],
    )


def split_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(loaded typed rows, rows aside with their reason and raw text)."""
    read = read_permissive(rows)
    good = read.filter("corrupt_raw is null").drop("corrupt_raw", "unpaired", "counted", "blank")
    reason = (
        F.when(F.col("blank"), "columns")
        .when(F.col("unpaired"), "quoting")
        .when(~F.col("counted"), "columns")
        .otherwise("value")
    )
    bad = read.filter("corrupt_raw is not null").select(
        "row_id", "feed", reason.alias("reason"), F.col("corrupt_raw").alias("raw")
    )
    return _once(good), _once(bad)


def _once(rows: DataFrame) -> DataFrame:
    """One row a record; a null key is no key, so such rows all stay."""
    return rows.filter("row_id is not null").dropDuplicates(["row_id"]).unionByName(rows.filter("row_id is null"))


def found_failures(rows: DataFrame) -> DataFrame:
    """(row_id, reason) of every record that does not load."""
    return split_rows(rows)[1].select("row_id", "reason").filter("row_id is not null")
