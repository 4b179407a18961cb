"""JSON documents held as text: set, delete, merge, count and list keys, level by level.

A level is a map of variants, so values of any kind pass through unchanged. Texts that aren't objects give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVEL = "map<string,variant>"


def level(text: Column) -> Column:
    return F.from_json(text, LEVEL)


def as_text(value: Column) -> Column:
    return F.to_json(value)


def merged_map(left: Column, right: Column) -> Column:
    """The right one wins."""
    kept = F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k))
    return F.map_concat(kept, right)


def with_key(text: Column, path: list[str], json_value: Column) -> Column:
    """The document with the value, given as JSON text, at the path; missing objects on the way are made."""
    head, rest = path[0], path[1:]
    here = F.coalesce(level(text), F.from_json(F.lit("{}"), LEVEL))
    inner = json_value if not rest else with_key(F.coalesce(F.to_json(F.try_element_at(here, F.lit(head))), F.lit("{}")), rest, json_value)
    return as_text(merged_map(here, F.create_map(F.lit(head), F.parse_json(inner))))


def without_key(text: Column, path: list[str]) -> Column:
    """The document without the value at the path; unchanged if there is none."""
    here = level(text)
    head, rest = path[0], path[1:]
    if not rest:
        return as_text(F.map_filter(here, lambda k, v: k != head))
    inner = without_key(F.to_json(F.try_element_at(here, F.lit(head))), rest)
    return F.when(inner.isNull(), text).otherwise(as_text(merged_map(here, F.create_map(F.lit(head), F.parse_json(inner)))))


def merged(left: Column, right: Column, depth: int = 3) -> Column:
    """Objects merged level by level down to ``depth``; elsewhere the right one wins."""
    a, b = level(left), level(right)
    if depth <= 1:
        return as_text(merged_map(a, b))

    def both(key: Column, value: Column) -> Column:
        own, other = F.to_json(F.try_element_at(a, key)), F.to_json(value)
        object_in = own.startswith("{") & other.startswith("{")
        return F.parse_json(F.when(object_in, F.coalesce(merged(own, other, depth - 1), other)).otherwise(other))

    return as_text(F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), F.map_zip_with(b, b, lambda k, v, _: both(k, v))))


def keys(text: Column) -> Column:
    return F.json_object_keys(text)


def count(text: Column, path: str) -> Column:
    """Items of the array, or keys of the object, at a dotted path."""
    inner = F.get_json_object(text, f"$.{path}" if path else "$")
    return F.coalesce(F.json_array_length(inner), F.size(F.json_object_keys(inner)))
