"""JSON-Schema checks of documents, as Spark expressions.

Supported keywords: ``type`` (one or several), ``const``, ``enum``, ``pattern``,
``minimum``, ``required``, ``properties``, ``additionalProperties: false``,
``items``, ``$ref`` into ``$defs``.  Others are refused.  A type error ends the
checks below it.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions.guards import let

KEYWORDS = {"$schema", "$id", "$ref", "$defs", "title", "description", "type", "const", "enum", "pattern", "minimum", "required", "properties", "additionalProperties", "items"}
_KIND = {"string": "^STRING", "integer": "^(BIGINT|INT|SMALLINT|TINYINT)", "number": "^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)", "boolean": "^BOOLEAN", "null": "^VOID", "array": "^ARRAY", "object": "^OBJECT"}


def errors(document: Column, schema: Mapping) -> Column:
    """Array of ``path: error`` for a JSON text column.

    Objects and scalars are checked by path, and every item of an array
    (``exploded`` gives a row for each item).  A schema that nests too deeply is refused.
    """
    defs = schema.get("$defs", {})

    def at(value: Column, node: Mapping, path: str, depth: int) -> Column:
        if unknown := set(node) - KEYWORDS:
            raise ValueError(f"unsupported keywords: {', '.join(sorted(unknown))}")
        if depth > 12:
            raise ValueError("schema nests too deeply")
        if ref := node.get("$ref"):
            return at(value, defs[ref.rpartition("/")[2]], path, depth + 1)
        # A value is taken, and its kind and keys told, once a row.
        keyed = {"required", "properties", "additionalProperties"} & set(node)
        keys = lambda v: F.json_object_keys(F.to_json(v)) if keyed else F.lit(None).cast("array<string>")
        return let(value, lambda v: let(F.struct(v.alias("value"), F.schema_of_variant(v).alias("kind"), keys(v).alias("keys")), lambda b: checked(b["value"], b["kind"], b["keys"], node, path, depth)))

    def checked(value: Column, kind: Column, keys: Column, node: Mapping, path: str, depth: int) -> Column:
        where = path or "/"
        number = F.when(kind.rlike(_KIND["number"]), F.try_variant_get(value, "$", "double"))
        text = F.when(kind.startswith("STRING"), F.try_variant_get(value, "$", "string"))

        def same(wanted: object) -> Column:
            """Whether the value equals a constant: values of different kinds differ, but booleans count as numbers do."""
            truth = F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("int").cast("double"))
            if wanted is None:
                return F.coalesce(kind == "VOID", F.lit(False))
            if isinstance(wanted, (bool, int, float)):
                return F.coalesce(F.coalesce(number, truth) == float(wanted), F.lit(False))
            if isinstance(wanted, str):
                return F.coalesce(text == wanted, F.lit(False))
            raise ValueError(f"unsupported constant: {wanted!r}")

        own: list[tuple[Column, str]] = []
        if "const" in node:
            own.append((~same(node["const"]), f"{where}: not {node['const']!r}"))
        if "enum" in node:
            own.append((~functools.reduce(lambda a, b: a | b, map(same, node["enum"]), F.lit(False)), f"{where}: not in enum"))
        if "pattern" in node:
            own.append((F.coalesce(kind.startswith("STRING") & ~text.rlike(node["pattern"]), F.lit(False)), f"{where}: pattern"))
        if "minimum" in node:
            own.append((F.coalesce(number < node["minimum"], F.lit(False)), f"{where}: below minimum"))
        for name in node.get("required", ()):
            own.append((kind.startswith("OBJECT") & ~F.coalesce(F.array_contains(keys, name), F.lit(False)), f"{path}/{name}: required"))
        found = F.filter(F.array(*(F.when(bad, F.lit(text_)) for bad, text_ in own)) if own else F.array().cast("array<string>"), lambda x: x.isNotNull())
        parts = [found]
        if node.get("additionalProperties") is False:
            more = F.array_except(F.coalesce(keys, F.array().cast("array<string>")), F.array(*map(F.lit, node.get("properties", {}))) if node.get("properties") else F.array().cast("array<string>"))
            parts.append(F.transform(more, lambda k: F.concat(F.lit(f"{path}/"), k, F.lit(": unknown property"))))
        for name, child in node.get("properties", {}).items():
            inner = F.try_variant_get(value, f"$['{name}']", "variant")
            there = F.coalesce(F.array_contains(keys, name), F.lit(False))
            parts.append(F.when(there, at(inner, child, f"{path}/{name}", depth + 1)).otherwise(F.array().cast("array<string>")))
        if "items" in node:
            members = F.try_variant_get(value, "$", "array<variant>")
            judged = F.transform(F.coalesce(members, F.array().cast("array<variant>")), lambda m, i: F.transform(at(m, node["items"], "", depth + 1), lambda e: F.concat(F.lit(f"{path}/"), i.cast("string"), e)))
            parts.append(F.flatten(judged))
        rest = F.concat(*parts)
        if "type" in node:
            kinds = [node["type"]] if isinstance(node["type"], str) else list(node["type"])
            fits = kind.rlike("|".join(_KIND[k] for k in kinds))
            return F.when(F.coalesce(fits, F.lit("null" in kinds)), rest).otherwise(F.array(F.lit(f"{where}: not {'/'.join(kinds)}")))
        return rest

    return at(F.try_parse_json(document), schema, "", 0)


def exploded(df: DataFrame, keys: list[str], document: str, path: str, item_schema: Mapping) -> DataFrame:
    """``keys, pos, error`` for every item of the array at a path, a row for each item."""
    members = df.select(*keys, F.posexplode(F.try_variant_get(F.try_parse_json(document), path, "array<variant>")).alias("pos", "m"))
    return listed(members, [*keys, "pos"], F.to_json("m"), item_schema)


def listed(df: DataFrame, keys: list[str], document: Column, schema: Mapping) -> DataFrame:
    """``keys, error`` for each error of each document.

    An outer explode: from another one Spark infers a filter, which checks each document again.
    """
    return df.select(*keys, F.explode_outer(errors(document, schema)).alias("error")).where("error IS NOT NULL")
