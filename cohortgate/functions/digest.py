"""Canonical JSON, leaf and node hashes, run ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ascii_escaped(json_text: Column) -> Column:
    r"""Non-ASCII characters as ``\uXXXX`` pairs of UTF-16 units, the form of ASCII-only JSON."""
    units = F.regexp_replace(
        F.hex(F.encode(json_text, "UTF-16BE")), "([0-9A-F]{4})", "$1,"
    )
    escaped = F.array_join(
        F.transform(
            F.filter(F.split(units, ","), lambda u: u != ""),
            lambda u: F.when(
                u < "0080", F.char(F.conv(u, 16, 10).cast("int"))
            ).otherwise(F.concat(F.lit("\\u"), F.lower(u))),
        ),
        "",
    )
    return F.when(json_text.rlike(r"[^\x00-\x7F]"), escaped).otherwise(json_text)


def in_key_order(column: Column, kind: T.DataType) -> Column:
    """The column with the fields of structs and the entries of maps in key order, at all levels."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda field: field.name)
        ordered = F.struct(*[in_key_order(column[f.name], f.dataType).alias(f.name) for f in fields])
        return F.when(column.isNotNull(), ordered)
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda item: in_key_order(item, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = F.transform(
            F.map_entries(column),
            lambda entry: F.struct(entry["key"].alias("key"), in_key_order(entry["value"], kind.valueType).alias("value")),
        )
        return F.map_from_entries(F.array_sort(entries, lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0)))
    return column


def canonical_json(fields: dict[str, tuple[Column, T.DataType]], optional: tuple[str, ...] = ()) -> Column:
    """Compact JSON with keys in order at all levels, ASCII only. Null fields are kept as null,
    but an ``optional`` one is left out."""

    def text(names: list[str]) -> Column:
        ordered = F.struct(*[in_key_order(*fields[name]).alias(name) for name in sorted(names)])
        return F.to_json(ordered, {"ignoreNullFields": "false"})

    def without_nulls(names: list[str], left: list[str]) -> Column:
        if not left:
            return text(names)
        fewer = [name for name in names if name != left[0]]
        return F.when(fields[left[0]][0].isNull(), without_nulls(fewer, left[1:])).otherwise(without_nulls(names, left[1:]))

    return ascii_escaped(without_nulls(list(fields), [name for name in optional if name in fields]))


def sha256_text(column: Column) -> Column:
    return F.sha2(column, 256)


def leaf_hash(json_text: Column) -> Column:
    """SHA-256 with the leaf prefix byte."""
    return F.sha2(F.concat(F.unhex(F.lit("00")), F.encode(json_text, "UTF-8")), 256)


def node_hash(left: Column, right: Column) -> Column:
    """SHA-256 of two child digests with the node prefix byte."""
    return F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex(left), F.unhex(right)), 256)


def json_string(column: Column) -> Column:
    """One string as a JSON literal with its quotes, ASCII only."""
    body = F.to_json(F.struct(column.alias("v")))
    return ascii_escaped(F.substring(body, F.lit(6), F.length(body) - 6))


def run_id(study_id: Column, cpra: Column, config_sha256: Column | None = None,
           input_sha256: Column | None = None) -> Column:
    """``RUN-`` and 12 hex digits of the hash of key-sorted, space-separated JSON.

    ``input_sha256`` is a map from input name to digest.
    """
    parts = []
    if config_sha256 is not None:
        parts.append(F.concat(F.lit('"config_sha256": '), json_string(config_sha256)))
    parts.append(F.concat(F.lit('"cpra": '), json_string(cpra)))
    if input_sha256 is not None:
        entries = F.transform(
            F.array_sort(F.map_entries(input_sha256)),
            lambda e: F.concat(json_string(e["key"]), F.lit(": "), json_string(e["value"])),
        )
        parts.append(F.concat(F.lit('"input_sha256": {'), F.array_join(entries, ", "), F.lit("}")))
    parts.append(F.concat(F.lit('"study_id": '), json_string(study_id)))
    text = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    return F.concat(F.lit("RUN-"), F.left(F.sha2(text, 256), F.lit(12)))
