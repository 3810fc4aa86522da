"""One way of writing for names that are written in many."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bare(text: Column) -> Column:
    """Without surrounding blanks and quotes; blank texts are null."""
    cut = F.btrim(text, F.lit(" \t\r\n\x0b\x0c\"'"))
    return F.when(cut != "", cut)


def file_path(path: Column) -> Column:
    """A bare path without doubled separators, ``.`` and ``x/..`` steps; case stays."""
    rooted = F.startswith(path, F.lit("/"))
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, x: F.when(
            (x == "..") & (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1)) != ".."),
            F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
        )
        .when((x == "..") & rooted, done)
        .otherwise(F.array_append(done, x)),
    )
    steps = path.rlike(r"(^|/)\.{0,2}/|/\.{0,2}$")
    return F.when(steps, F.concat(F.when(rooted, "/").otherwise(""), F.array_join(kept, "/"))).otherwise(path)


def address(text: Column) -> Column:
    """An IP address in lower case without brackets, mapping prefix and leading zeros."""
    plain = bare(text)
    cut = F.lower(F.regexp_replace(plain, r"^\[+|\]+$", ""))
    cut = F.regexp_replace(cut, r"^(?:0*:)*:?(?:0+:)*ffff:(?=\d+\.\d+\.\d+\.\d+)", "")
    dotted = F.regexp_replace(cut, r"(^|\.)0+(?=\d)", "$1")
    other = F.when(cut.rlike(r"^\d+\.\d+\.\d+\.\d+$"), dotted).otherwise(cut)
    return F.when(plain.rlike(r"^(?:[1-9]\d*|0)(?:\.(?:[1-9]\d*|0)){3}$"), plain).otherwise(other)


def socket(name: Column) -> Column:
    """``address:port`` from bare names like ``a:p``, ``a/p``, ``[a]:p`` and mapped forms."""
    port = F.regexp_extract(name, r"[:/](\d+)$", 1)
    host = F.regexp_replace(name, r"[:/]\d+$", "")
    joined = F.concat(address(host), F.lit(":"), F.regexp_replace(port, r"^0+(?=\d)", ""))
    plain = name.rlike(r"^[1-9]\d*(\.(0|[1-9]\d*)){3}:[1-9]\d*$")
    return F.when(plain, name).when(port == "", address(name)).when(port != "", joined)


def call(text: Column) -> Column:
    """A system call in lower case without its ``sys_`` prefix."""
    return F.regexp_replace(F.lower(bare(text)), r"^_*sys_|\(\)$", "")


def aliased(name: Column, aliases: dict[str, str]) -> Column:
    """The name that stands for an alias; other names stay."""
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else F.lit(None).cast("map<string,string>")
    return F.coalesce(F.try_element_at(known, name), name)


def rule_parts(key: Column) -> Column:
    """(source, fields) of a rule key ``source_field_field``."""
    parts = F.split(key, "_")
    return F.struct(F.get(parts, F.lit(0)).alias("source"), F.slice(parts, 2, 1 << 20).alias("fields"))


def number(text: Column) -> Column:
    """A non-negative whole number written with blanks, quotes, brackets, zeros or ``.0``, else null."""
    cut = F.btrim(text, F.lit(" \t\r\n\"'[](){}"))
    return F.regexp_extract(cut, r"^\+?0*(\d{1,18})(?:\.0*)?$", 1).try_cast("bigint")
