"""JSON documents: what they hold, and building them. Texts that are no JSON hold nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import C, _c


def member(doc: C, key: str) -> Column:
    """A member as JSON text; text members without their quotes."""
    return F.get_json_object(_c(doc), f"$.{key}")


def has_key(doc: C, key: str) -> Column:
    """Whether an object has the key, null members too."""
    return F.coalesce(F.array_contains(F.json_object_keys(_c(doc)), key), F.lit(False))


def has_any_key(doc: C, *keys: str) -> Column:
    return F.coalesce(F.arrays_overlap(F.json_object_keys(_c(doc)), F.array(*[F.lit(k) for k in keys])), F.lit(False))


def kind(doc: C) -> Column:
    """object, array, string, number, boolean or null."""
    d = F.trim(_c(doc))
    first = F.substring(d, 1, 1)
    return F.when(first == "{", "object").when(first == "[", "array").when(first == '"', "string").when(d.isin("true", "false"), "boolean").when(d == "null", "null").when(d.rlike(r"^-?\d"), "number")


def array_length(doc: C) -> Column:
    return F.json_array_length(_c(doc))


def elements(doc: C) -> Column:
    """The elements of an array of plain values, as text; to be exploded."""
    return F.from_json(_c(doc), "array<string>")


def build_object(**members: Column) -> Column:
    """An object with its members in the order given, nulls included."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in members.items()]), {"ignoreNullFields": "false"})


def gathered(value: Column, *order: Column) -> Column:
    """An aggregate: the values as an array in an order. The values of a group are a group's of a report: bounded."""
    rows = F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{k}") for k, o in enumerate(order)], value.alias("v"))))
    return F.to_json(F.transform(rows, lambda r: r["v"]), {"ignoreNullFields": "false"})


def gathered_object(key: Column, value: Column) -> Column:
    """An aggregate: one object of the keys in order, each once."""
    return F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key.cast("string").alias("k"), value.alias("v"))))))
