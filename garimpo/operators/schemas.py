"""JSON Schema documents compiled to column checks over VARIANT rows.

A schema becomes one expression that lists a row's findings, each with the path
of the value that it is about.  Rows stay variants: a value of another type is a
finding, never a null, and keys that the schema doesn't know are seen at every
level.  Keywords that aren't known here refuse to compile.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FINDING = "array<struct<at: array<string>, turn: int, path: string, message: string>>"
#: What a finding about the whole row has for a path.
ROOT = "<raiz>"
#: Keywords that say nothing about values.
NOTES = {"$schema", "$id", "$comment", "title", "description", "default", "examples", "deprecated", "format"}
_TYPES = {"string": "STRING", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY", "null": "VOID", "integer": "BIGINT", "number": "(BIGINT|DOUBLE|FLOAT|DECIMAL)"}


def _name(key: str) -> str:
    if "'" in key and '"' in key:
        raise NotImplementedError(f"both kinds of quotes in {key}")
    return f'$["{key}"]' if "'" in key else f"$['{key}']"


def _is(value: Column, kind: str) -> Column:
    """Whether a variant (not null) is of a JSON type; a number without a fraction is an integer."""
    shown = F.schema_of_variant(value)
    found = shown.rlike(f"^{_TYPES[kind]}([<(]|$)")
    if kind == "integer":
        whole = F.try_variant_get(value, "$", "double")
        return found | (shown.rlike("^(DOUBLE|FLOAT|DECIMAL)") & (whole == F.floor(whole)))
    return found


def _let(value: Column, then) -> Column:
    return F.flatten(F.transform(F.array(value), then))


class _Compiler:
    def __init__(self):
        self.turn = 0

    def finding(self, bad: Column, at: Column, shown: Column, message: str) -> Column:
        self.turn += 1
        return F.when(bad, F.array(F.struct(at.alias("at"), F.lit(self.turn).alias("turn"), shown.alias("path"), F.lit(message).alias("message"))).cast(FINDING)).otherwise(F.array().cast(FINDING))

    def step(self, at: Column, name: str | Column) -> Column:
        key = F.lit(name) if isinstance(name, str) else F.lpad(name.cast("string"), 9, "0")
        return F.concat(at, F.array(key))

    def at_name(self, schema: dict, at: Column, shown: Column):
        return lambda v: self.checks(schema, v, at, shown)

    def at_item(self, schema: dict, at: Column, shown: Column):
        return lambda v, i: self.checks(schema, v, self.step(at, i), F.concat(shown, F.lit("."), i.cast("string")))

    def checks(self, schema: dict, value: Column, at: Column, shown: Column) -> Column:
        """The findings about ``value``, a variant that is there."""
        found = [F.array().cast(FINDING)]
        text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
        isa = lambda kind: _is(value, kind)
        items = F.when(isa("array"), F.try_variant_get(value, "$", "array<variant>"))
        keys = F.when(isa("object"), F.json_object_keys(F.to_json(value)))
        add = lambda applies, bad, message: found.append(self.finding(F.coalesce(applies & bad, F.lit(False)), at, shown, message))
        here = lambda key: F.when(shown == ROOT, F.lit(key)).otherwise(F.concat(shown, F.lit(f".{key}")))
        for keyword, want in schema.items():
            if keyword in NOTES:
                continue
            if keyword == "type":
                kinds = [want] if isinstance(want, str) else want
                right = isa(kinds[0])
                for k in kinds[1:]:
                    right = right | isa(k)
                add(F.lit(True), ~right, f"not of type {' or '.join(kinds)}")
            elif keyword in ("enum", "const"):
                allowed = [json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in (want if keyword == "enum" else [want])]
                add(F.lit(True), ~F.to_json(value).isin(*allowed), "not an allowed value")
            elif keyword == "minLength":
                add(isa("string"), F.length(text) < want, f"shorter than {want}")
            elif keyword == "maxLength":
                add(isa("string"), F.length(text) > want, f"longer than {want}")
            elif keyword == "pattern":
                add(isa("string"), ~text.rlike(want), f"does not match {want}")
            elif keyword in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"):
                bad = {"minimum": number < want, "maximum": number > want, "exclusiveMinimum": number <= want, "exclusiveMaximum": number >= want}[keyword]
                add(isa("number"), bad, f"beyond {keyword} {want}")
            elif keyword == "minItems":
                add(isa("array"), F.size(items) < want, f"fewer than {want} items")
            elif keyword == "maxItems":
                add(isa("array"), F.size(items) > want, f"more than {want} items")
            elif keyword == "uniqueItems":
                shown_items = F.transform(items, lambda x: F.to_json(x))
                add(isa("array") & F.lit(bool(want)), F.size(F.array_distinct(shown_items)) < F.size(items), "repeated item")
            elif keyword == "required":
                for name in want:
                    add(isa("object"), ~F.array_contains(keys, name), f"{name} is required")
            elif keyword == "properties":
                for name, inner in want.items():
                    child = F.try_variant_get(value, _name(name), "variant")
                    there = isa("object") & F.array_contains(keys, name)
                    inside = _let(child, self.at_name(inner, self.step(at, name), here(name)))
                    found.append(F.when(F.coalesce(there, F.lit(False)), inside).otherwise(F.array().cast(FINDING)))
            elif keyword == "additionalProperties":
                if want is True:
                    continue
                if want is not False:
                    raise NotImplementedError("additionalProperties other than true and false")
                known = list(schema.get("properties", {}))
                extra = F.filter(keys, lambda k: ~k.isin(*known)) if known else keys
                add(isa("object"), F.size(extra) > 0, "unknown key")
            elif keyword == "items":
                found.append(F.when(F.coalesce(isa("array"), F.lit(False)), F.flatten(F.transform(items, self.at_item(want, at, shown)))).otherwise(F.array().cast(FINDING)))
            else:
                raise NotImplementedError(f"keyword {keyword}")
        return F.concat(*found)


def compile_schema(schema: dict | str, text: Column) -> Column:
    """The findings about a column of JSON texts, in the order of their paths: the first one is what is reported.

    A text that is no JSON, or null, is one finding.  At one path findings keep
    the schema's order.
    """
    rules = json.loads(schema) if isinstance(schema, str) else schema
    compiler = _Compiler()
    broken = F.array(F.struct(F.array().cast("array<string>").alias("at"), F.lit(0).alias("turn"), F.lit(ROOT).alias("path"), F.lit("not JSON").alias("message"))).cast(FINDING)
    root = F.array().cast("array<string>")
    return _let(F.try_parse_json(text), lambda v: F.when(v.isNull(), broken).otherwise(F.array_sort(compiler.checks(rules, v, root, F.lit(ROOT)))))


def findings(rows: DataFrame, schema: dict | str, text: str, unique: str | None = None) -> DataFrame:
    """``rows`` with ``findings``; with ``unique``, a top-level value that other rows have as well is one more, the last."""
    out = rows.withColumn("findings", compile_schema(schema, F.col(text)))
    if unique is None:
        return out
    value = F.try_variant_get(F.try_parse_json(F.col(text)), _name(unique), "string")
    again = rows.select(value.alias("_value")).where("_value is not null").groupBy("_value").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("_value"), F.lit(True).alias("_again"))
    repeated = F.array(F.struct(F.array(F.lit(unique)).alias("at"), F.lit(2**31 - 1).alias("turn"), F.lit(unique).alias("path"), F.lit("repeated").alias("message"))).cast(FINDING)
    j = out.withColumn("_key", value).join(again, F.col("_key") == F.col("_value"), "left")
    return j.withColumn("findings", F.when(F.col("_again"), F.concat("findings", repeated)).otherwise(F.col("findings"))).drop("_key", "_value", "_again")


def checked(rows: DataFrame, schema: dict | str, text: str, order: str, unique: str | None = None) -> DataFrame:
    """The rows; reading them fails with the first finding of the first bad row in ``order``."""
    bad = findings(rows, schema, text, unique).where(F.size("findings") > 0).select(order, F.get("findings", F.lit(0)).alias("f"))
    first = bad.agg(F.min_by(F.concat(F.col("f.path"), F.lit(": "), F.col("f.message")), order).alias("v")).scalar()
    return rows.where(F.when(first.isNull(), True).otherwise(F.raise_error(F.concat(F.lit("invalid at "), first)).cast("boolean")))
