"""JSON held in text columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gradeloom.functions.text import let

_END = "\ue000"
# A shorter text always fits a variant.
VARIANT_BYTES = 1 << 24


def strict_json(c: Column) -> Column:
    """The text as a variant; null unless all of it is one JSON value.

    The plain parser stops after the first value and ignores the rest, so the text is parsed as a
    member followed by an end mark, and the mark must be there.
    """
    whole = F.try_parse_json(F.concat(F.lit('{"v":'), c, F.lit(f',"{_END}":0}}')))
    members = F.try_variant_get(whole, "$", "map<string,variant>")
    return let(members, lambda m: F.when((F.size(m) == 2) & F.map_contains_key(m, _END), m["v"]))


def is_json(c: Column) -> Column:
    """Whether all of the text is one JSON value, of any size: texts beyond what a variant holds are only
    walked through, for the names of the wrapper's members."""
    names = F.json_object_keys(F.concat(F.lit('{"v":'), c, F.lit(f',"{_END}":0}}')))
    large = (F.octet_length(c) > VARIANT_BYTES) & F.coalesce(
        (F.size(names) == 2) & (F.get(names, F.lit(1)) == _END), F.lit(False))
    return strict_json(c).isNotNull() | F.coalesce(large, F.lit(False))


def is_object(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def is_array(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>").isNotNull()


def member(v: Column, key: str) -> Column:
    return F.try_variant_get(v, f"$.{key}", "variant")


def text_member(v: Column, key: str) -> Column:
    """Member if it is a string, else null."""
    m = member(v, key)
    return F.when(F.schema_of_variant(m) == "STRING", F.try_variant_get(m, "$", "string"))


def has_keys(text: Column, *keys: str) -> Column:
    """Whether a JSON object has all keys; a key whose value is null counts."""
    return let(F.coalesce(F.json_object_keys(text), F.array().cast("array<string>")), lambda names: F.size(
        F.array_intersect(names, F.array(*map(F.lit, keys)))) == len(keys))
