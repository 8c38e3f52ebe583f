"""Values inside a parsed document, by path and by type: each is null where something else, or nothing, stands there."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REST = "map<string,variant>"


def at(value: Column, path: str) -> Column:
    """What stands at a path of a variant, or null."""
    return F.try_variant_get(value, f"$.{path}", "variant")


def text(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def number(value: Column) -> Column:
    return F.when(F.substring(F.schema_of_variant(value), 1, 3).isin("BIG", "DEC", "DOU", "FLO"), F.try_variant_get(value, "$", "double"))


def flag(value: Column) -> Column:
    return F.when(F.schema_of_variant(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean"))


def items(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def fields(value: Column) -> Column:
    return F.try_variant_get(value, "$", REST)


def of(*names: str, **kinds: str) -> str:
    """The type that takes these fields of an object, as they are or as the types given, in one pass over it."""
    return f"struct<{', '.join([f'`{n}` variant' for n in names] + [f'`{n}` {kind}' for n, kind in kinds.items()])}>"


def listed(value: Column, path: str, kind: str) -> Column:
    """The items of the list at a path, each as a type (null where it is something else); null where no list stands there."""
    return F.try_variant_get(value, f"$.{path}", f"array<{kind}>")


def parsed(json: str) -> Column:
    """A generator of the one parsed value of a column (null: no JSON): the optimiser repeats an expression where its columns are used, but not what a generator gives."""
    return F.explode(F.array(F.try_parse_json(json)))
