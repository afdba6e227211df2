"""Typed getters over VARIANT: a number never passes for a string, a string never for a list."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtrace.functions import exprs as X


def node(tree: Column, path: str) -> Column:
    return F.try_variant_get(tree, path, "variant")


def kind(tree: Column) -> Column:
    """STRING, BIGINT, BOOLEAN, ARRAY<…>, OBJECT<…>, VOID for a JSON null; null when absent."""
    return F.schema_of_variant(tree)


def is_object(tree: Column) -> Column:
    """Any object becomes a struct of no fields, nothing else does; the types of its fields are not looked at."""
    return F.try_variant_get(tree, "$", "struct<>").isNotNull()


def text(tree: Column, path: str) -> Column:
    """String at the path, null for any other type."""
    found = node(tree, path)
    return F.when(kind(found) == "STRING", F.try_variant_get(found, "$", "string"))


def clean(tree: Column, path: str) -> Column:
    """Trimmed non-empty string at the path."""
    value = X.strip(text(tree, path))
    return F.when(value != "", value)


def whole(tree: Column, path: str) -> Column:
    """Integer number at the path, null for text that looks like one."""
    found = node(tree, path)
    return F.when(kind(found) == "BIGINT", F.try_variant_get(found, "$", "bigint"))


def size(tree: Column, path: str) -> Column:
    """Length of the array at the path."""
    found = node(tree, path)
    return F.when(kind(found).startswith("ARRAY"), F.size(F.try_variant_get(found, "$", "array<variant>")).cast("bigint"))


def texts(tree: Column, path: str) -> Column:
    """Strings of the array at the path."""
    items = F.try_variant_get(tree, path, "array<variant>")
    return F.filter(F.transform(items, lambda x: text(x, "$")), lambda x: x.isNotNull())


def agent_states(tree: Column, path: str) -> Column:
    """(thread_id, status, message) of each object in the object at the path, by key; null when it is no object."""
    states = F.when(is_object(node(tree, path)), F.try_variant_get(tree, path, "map<string,variant>"))
    entries = F.filter(F.map_entries(states), lambda e: is_object(e["value"]))
    said = F.transform(
        entries, lambda e: F.struct(e["key"].alias("thread_id"), text(e["value"], "$.status").alias("status"), text(e["value"], "$.message").alias("message"))
    )
    return F.sort_array(said)


def parse(value: Column) -> Column:
    """Tree of a JSON text, null unless the text is one JSON value and nothing more.

    The parser stops after the first value, so the text is read as the first of two list items.
    """
    pair = F.try_parse_json(F.concat(F.lit("["), value, F.lit(",0]")))
    alone = node(pair, "$[1]").isNotNull() & node(pair, "$[2]").isNull()
    return F.when(alone, node(pair, "$[0]"))


def as_text(tree: Column) -> Column:
    """JSON text of a tree, a string node as its plain text."""
    return F.when(kind(tree) == "STRING", F.try_variant_get(tree, "$", "string")).otherwise(F.to_json(tree))
