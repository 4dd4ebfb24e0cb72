"""Packed property bags: ``name:kind:start:length:`` beside a value string.

Offsets count UTF-16 code units, so bags written by other systems decode the
same for text outside the basic plane. Strings have kind ``S``; binary values
and NULLs have kind ``B``; a NULL has length -1.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillbook.functions.text import utf16_length

_PACKED = "struct<names:string,values:string,blob:binary,units:int,bytes:int>"


def encode_bag(strings: Column, binaries: Column | None = None, allowed: Column | None = None) -> Column:
    """Struct (names, values, blob) of a string map and an optional binary map.

    Properties are written in name order. ``allowed`` is an array of property
    names to keep, for owners who may only store some of them.
    """
    none = F.lit(None)
    entries = F.transform(
        F.map_entries(strings),
        lambda e: F.struct(e["key"].alias("key"), e["value"].alias("text"), none.cast("binary").alias("data")),
    )
    if binaries is not None:
        packed = F.transform(
            F.map_entries(binaries),
            lambda e: F.struct(e["key"].alias("key"), none.cast("string").alias("text"), e["value"].alias("data")),
        )
        entries = F.concat(
            F.coalesce(entries, F.array().cast("array<struct<key:string,text:string,data:binary>>")),
            F.coalesce(packed, F.array().cast("array<struct<key:string,text:string,data:binary>>")),
        )
    if allowed is not None:
        entries = F.filter(entries, lambda e: F.array_contains(allowed, e["key"]))
    start = F.struct(
        F.lit("").alias("names"),
        F.lit("").alias("values"),
        F.lit(b"").alias("blob"),
        F.lit(0).alias("units"),
        F.lit(0).alias("bytes"),
    ).cast(_PACKED)

    def add(bag: Column, e: Column) -> Column:
        units = F.coalesce(utf16_length(e["text"]), F.lit(0))
        size = F.coalesce(F.octet_length(e["data"]), F.lit(0))
        position = F.when(e["text"].isNotNull(), bag["units"]).when(e["data"].isNotNull(), bag["bytes"]).otherwise(0)
        length = F.when(e["text"].isNotNull(), units).when(e["data"].isNotNull(), size).otherwise(-1)
        kind = F.when(e["text"].isNotNull(), "S").otherwise("B")
        return F.struct(
            F.concat(
                bag["names"], e["key"], F.lit(":"), kind, F.lit(":"), position.cast("string"), F.lit(":"),
                length.cast("string"), F.lit(":"),
            ).alias("names"),
            F.concat(bag["values"], F.coalesce(e["text"], F.lit(""))).alias("values"),
            F.concat(bag["blob"], F.coalesce(e["data"], F.lit(b""))).alias("blob"),
            (bag["units"] + units).alias("units"),
            (bag["bytes"] + size).alias("bytes"),
        ).cast(_PACKED)

    folded = F.aggregate(F.array_sort(entries), start, add)
    return F.struct(folded["names"].alias("names"), folded["values"].alias("values"), folded["blob"].alias("blob"))


def _descriptors(names: Column) -> Column:
    parts = F.split(names, ":")
    count = F.floor(F.size(parts) / 4).cast("int")
    return F.when(
        count > 0,
        F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda i: F.struct(
                F.get(parts, i * 4).alias("key"),
                F.get(parts, i * 4 + 1).alias("kind"),
                F.get(parts, i * 4 + 2).try_cast("int").alias("start"),
                F.get(parts, i * 4 + 3).try_cast("int").alias("length"),
            ),
        ),
    ).otherwise(F.array().cast("array<struct<key:string,kind:string,start:int,length:int>>"))


def _last_of_each_key(entries: Column) -> Column:
    return F.filter(
        entries,
        lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]),
    )


def decode_strings(names: Column, values: Column) -> Column:
    """Map of the string and NULL properties.

    A zero-length or out-of-range string entry is left out, as the stored
    format cannot tell it from a missing one.
    """
    units = F.encode(values, "UTF-16LE")
    total = F.octet_length(units)

    def readable(d: Column) -> Column:
        in_range = (d["kind"] == "S") & (d["start"] >= 0) & (d["length"] > 0) & (
            (d["start"].cast("bigint") + d["length"]) * 2 <= total
        )
        return (d["length"] == -1) | in_range

    kept = F.transform(
        F.filter(_descriptors(names), readable),
        lambda d: F.struct(
            d["key"].alias("key"),
            F.when(
                d["length"] > 0, F.decode(F.substring(units, d["start"] * 2 + 1, d["length"] * 2), "UTF-16LE")
            ).alias("value"),
        ),
    )
    return F.map_from_entries(_last_of_each_key(kept))


def decode_binaries(names: Column, blob: Column) -> Column:
    """Map of the binary properties."""
    total = F.octet_length(blob)
    kept = F.transform(
        F.filter(
            _descriptors(names),
            lambda d: (d["kind"] == "B")
            & (d["start"] >= 0)
            & (d["length"] > 0)
            & (d["start"].cast("bigint") + d["length"] <= total),
        ),
        lambda d: F.struct(
            d["key"].alias("key"), F.substring(blob, d["start"] + 1, d["length"]).alias("value")
        ),
    )
    return F.map_from_entries(_last_of_each_key(kept))
