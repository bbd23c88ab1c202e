"""JSON contracts compiled to Columns: the first violation of a document, and the document as typed columns.

A contract is a JSON Schema, of which the keywords below are known; others raise an error when it is compiled, not when a
document comes. Documents are variants, so a missing value is told from a null one, an integer from a text, and nothing
but built-in functions looks at a row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keywords that say nothing about a document.
NOTES = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "$defs", "definitions", "deprecated", "readOnly"}
CHECKED = {
    "type", "enum", "const", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "pattern", "format", "items", "minItems", "maxItems", "uniqueItems",
    "required", "properties", "additionalProperties", "allOf", "anyOf", "oneOf", "not", "if", "then", "else", "$ref",
}
FORMATS = {
    "uuid": r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "date-time": r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$",
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:\S*$",
}
SQL_TYPES = {"integer": "bigint", "number": "double", "string": "string", "boolean": "boolean"}


def _kinds(v: Column) -> dict[str, Column]:
    name = F.schema_of_variant(v)
    whole = name.rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL\(\d+,0\))$")
    number = name.rlike(r"^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)")
    value = F.try_variant_get(v, "$", "double")
    return {
        "null": name == "VOID", "boolean": name == "BOOLEAN", "string": name == "STRING", "array": name.startswith("ARRAY"), "object": name.startswith("OBJECT"), "number": number,
        "integer": whole | (number & (value == F.floor(value))),
    }


def _text(value: object) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


class Contract:
    """One schema; ``local`` references alone are followed."""

    def __init__(self, schema: dict):
        self.schema, self._names = schema, count()

    @classmethod
    def read(cls, spark, path: str) -> Contract:
        """The schema in a file of any store that Spark reads."""
        return cls(json.loads(spark.read.text(path, wholetext=True).first().value))

    def _resolved(self, schema: dict) -> dict:
        seen = set()
        while isinstance(schema, dict) and "$ref" in schema:
            ref = schema["$ref"]
            if not ref.startswith("#/") or ref in seen:
                raise ValueError(f"not a reference that can be followed: {ref}")
            seen.add(ref)
            found = self.schema
            for part in ref[2:].split("/"):
                found = found[part.replace("~1", "/").replace("~0", "~")]
            schema = found | {k: v for k, v in schema.items() if k != "$ref"}
        return schema

    def violation(self, v: Column) -> Column:
        """``path: keyword`` of the first violation of a variant, in the contract's order, or null; ``$: json`` for a null variant."""
        return F.when(v.isNull(), F.lit("$: json")).otherwise(self._check(v, self.schema, F.lit("$")))

    def _check(self, v: Column, schema: dict | bool, path: Column) -> Column:
        """Null where ``v``, which is there, meets the schema."""
        none = F.lit(None).cast("string")
        if isinstance(schema, bool):
            return none if schema else F.concat(path, F.lit(": nothing allowed"))
        schema = self._resolved(schema)
        if odd := set(schema) - NOTES - CHECKED:
            raise ValueError(f"keywords that are not known: {', '.join(sorted(odd))}")
        found: list[Column] = []
        kinds = _kinds(v)
        bad = lambda keyword, when: found.append(F.when(when, F.concat(path, F.lit(f": {keyword}"))))
        if "type" in schema:
            names = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
            fits = kinds[names[0]]
            for name in names[1:]:
                fits = fits | kinds[name]
            bad("type", ~fits)
        for keyword, values in (("enum", schema.get("enum")), ("const", [schema["const"]] if "const" in schema else None)):
            if values is not None:
                bad(keyword, ~F.to_json(v).isin([_text(x) for x in values]))
        number, text = F.try_variant_get(v, "$", "double"), F.when(kinds["string"], F.try_variant_get(v, "$", "string"))
        limits = {"minimum": lambda a, b: a < b, "maximum": lambda a, b: a > b, "exclusiveMinimum": lambda a, b: a <= b, "exclusiveMaximum": lambda a, b: a >= b}
        for keyword, beyond in limits.items():
            if keyword in schema:
                bad(keyword, kinds["number"] & beyond(number, F.lit(float(schema[keyword]))))
        if "minLength" in schema:
            bad("minLength", F.coalesce(F.length(text) < schema["minLength"], F.lit(False)))
        if "maxLength" in schema:
            bad("maxLength", F.coalesce(F.length(text) > schema["maxLength"], F.lit(False)))
        if "pattern" in schema:
            re.compile(schema["pattern"])
            bad("pattern", F.coalesce(~text.rlike(schema["pattern"]), F.lit(False)))
        if "format" in schema:
            bad("format", F.coalesce(~text.rlike(FORMATS[schema["format"]]), F.lit(False)))
        self._array(v, schema, path, kinds["array"], bad, found)
        self._object(v, schema, path, kinds["object"], bad, found)
        for part in schema.get("allOf", ()):
            found.append(self._check(v, part, path))
        if "if" in schema:
            meets = self._check(v, schema["if"], path).isNull()
            then, other = (self._check(v, schema[k], path) if k in schema else none for k in ("then", "else"))
            found.append(F.when(meets, then).otherwise(other))
        for keyword, enough in (("anyOf", lambda n: n >= 1), ("oneOf", lambda n: n == 1)):
            if keyword in schema:
                met = sum(self._check(v, part, path).isNull().cast("int") for part in schema[keyword])
                bad(keyword, ~enough(met))
        if "not" in schema:
            bad("not", self._check(v, schema["not"], path).isNull())
        return F.coalesce(*found, none) if found else none

    def _array(self, v: Column, schema: dict, path: Column, is_array: Column, bad, found: list[Column]) -> None:
        if not {"items", "minItems", "maxItems", "uniqueItems"} & set(schema):
            return
        items = F.when(is_array, F.try_variant_get(v, "$", "array<variant>"))
        size = F.when(is_array, F.size(items))
        if "minItems" in schema:
            bad("minItems", F.coalesce(size < schema["minItems"], F.lit(False)))
        if "maxItems" in schema:
            bad("maxItems", F.coalesce(size > schema["maxItems"], F.lit(False)))
        if schema.get("uniqueItems"):
            bad("uniqueItems", F.coalesce(F.size(F.array_distinct(F.transform(items, lambda x: F.to_json(x)))) < size, F.lit(False)))
        if "items" in schema:
            told = F.transform(items, lambda x, i: self._check(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
            found.append(F.get(F.filter(told, lambda t: t.isNotNull()), F.lit(0)))

    def _object(self, v: Column, schema: dict, path: Column, is_object: Column, bad, found: list[Column]) -> None:
        at = lambda name: F.try_variant_get(v, f"$['{name}']", "variant")
        for name in schema.get("required", ()):
            found.append(F.when(is_object & at(name).isNull(), F.concat(path, F.lit(f".{name}: required"))))
        known = schema.get("properties", {})
        for name, part in known.items():
            below = self._check(at(name), part, F.concat(path, F.lit(f".{name}")))
            found.append(F.when(is_object & at(name).isNotNull(), below))
        if schema.get("additionalProperties") is False:
            extra = F.array_except(F.json_object_keys(F.to_json(v)), F.array(*map(F.lit, known)).cast("array<string>"))
            found.append(F.when(is_object & (F.size(extra) > 0), F.concat(path, F.lit("."), F.get(F.array_sort(extra), F.lit(0)), F.lit(": additionalProperties"))))

    def sql_type(self, schema: dict | None = None) -> str:
        """The type of columns that a document of the contract has; what may be of several types stays a variant."""
        schema = self._resolved(self.schema if schema is None else schema)
        names = schema.get("type", [])
        names = [n for n in ([names] if isinstance(names, str) else names) if n != "null"]
        if len(names) != 1:
            return "variant"
        if names[0] == "array":
            return f"array<{self.sql_type(schema['items']) if 'items' in schema else 'variant'}>"
        if names[0] == "object":
            inner = [f"`{k}`:{self.sql_type(p)}" for k, p in schema.get("properties", {}).items()]
            return f"struct<{','.join(inner)}>" if inner else "variant"
        return SQL_TYPES[names[0]]

    def typed(self, v: Column) -> Column:
        """The document as a struct of :meth:`sql_type`; null where it cannot be one."""
        return F.try_variant_get(v, "$", self.sql_type())


def parsed(lines: DataFrame, contract: Contract, text: str = "value", lenient: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """``(records, violations)`` of JSON lines: typed columns of the lines that keep the contract, and ``path, keyword, lines, example`` of the others.

    Violations below the top-level properties named ``lenient``, such as a version, are counted but keep the record.
    Blank lines are neither. Places in arrays are told as ``[]`` in the counts.
    """
    doc = F.try_parse_json(F.col(text))
    told = lines.where(F.trim(F.col(text)) != "").select(text, doc.alias("_doc")).withColumn("_found", contract.violation(F.col("_doc")))
    strict = Contract(contract.schema | {"properties": {k: k in lenient or p for k, p in contract.schema.get("properties", {}).items()}}) if lenient else contract
    keeps = strict.violation(F.col("_doc")).isNull() if lenient else F.col("_found").isNull()
    records = told.where(keeps).select(contract.typed(F.col("_doc")).alias("_r")).select("_r.*")
    place = F.regexp_replace(F.regexp_extract("_found", r"^(.*): ([^:]*)$", 1), r"\[\d+\]", "[]")
    bad = told.where("_found is not null").select(place.alias("path"), F.regexp_extract("_found", r"^(.*): ([^:]*)$", 2).alias("keyword"), text)
    return records, bad.groupBy("path", "keyword").agg(F.count("*").alias("lines"), F.min(text).alias("example"))
