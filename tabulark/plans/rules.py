"""Record rules: a JSON schema compiled to one column that names every failing place of a record.

Records are parsed once, as variants; each rule is an expression over the parsed value, so a whole
collection is checked in one pass without Python in the tasks.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of a schema that describe and do not check.
ANNOTATIONS = {
    "$schema", "$id", "id", "$comment", "title", "description", "default", "examples", "definitions", "$defs",
    "readOnly", "writeOnly", "deprecated",
}
# Forms of texts. Other formats are refused.
FORMATS = {
    "date": r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$",
    "date-time": r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[Tt ]([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([Zz]|[+-]\d\d:\d\d)$",
    "email": r"^[^@\s]+@[^@\s]+$",
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s]*$",
}
FAILURES = "array<struct<path string, rule string>>"
NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")


def _member(value: Column, name: str) -> Column:
    """A member of an object: NULL where there is none, a variant null where it is null."""
    quote = '"' if "'" in name else "'"
    if quote in name:
        raise ValueError(f"member name with both quotes: {name}")
    return F.try_variant_get(value, f"$[{quote}{name}{quote}]", "variant")


def _kind(value: Column) -> Column:
    """STRING, BOOLEAN, VOID, ARRAY, OBJECT or the name of a number type."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _number(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _items(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _of_type(value: Column, name: str) -> Column:
    kind = _kind(value)
    whole = kind.isin("DECIMAL", "DOUBLE", "FLOAT") & (_number(value) == F.floor(_number(value)))
    known = {
        "string": kind == "STRING",
        "boolean": kind == "BOOLEAN",
        "null": kind == "VOID",
        "array": kind == "ARRAY",
        "object": kind == "OBJECT",
        "number": kind.isin(*NUMBERS),
        "integer": (kind == "BIGINT") | whole,
    }
    if name not in known:
        raise ValueError(f"unknown type: {name}")
    return known[name]


def _equal(value: Column, constant) -> Column:
    if isinstance(constant, (int, float)) and not isinstance(constant, bool):
        return _kind(value).isin(*NUMBERS) & (_number(value) == F.lit(float(constant)))
    return F.to_json(value) == F.to_json(F.parse_json(F.lit(json.dumps(constant))))


def _when(value: Column, kinds: tuple[str, ...], passes: Column) -> Column:
    """A rule that only speaks of some kinds of values."""
    return ~_kind(value).isin(*kinds) | F.coalesce(passes, F.lit(False))


def _simple(value: Column, rule: str, given) -> Column | None:
    """Whether a value passes a rule that looks at it alone; None for a rule of another sort."""
    if rule == "type":
        passes = F.lit(False)
        for name in [given] if isinstance(given, str) else given:
            passes = passes | _of_type(value, name)
        return passes
    if rule in ("enum", "const"):
        passes = F.lit(False)
        for constant in given if rule == "enum" else [given]:
            passes = passes | _equal(value, constant)
        return passes
    if rule == "format" and given not in FORMATS:
        raise ValueError(f"unknown format: {given}")
    texts, lists, size = ("STRING",), ("ARRAY",), F.size(_items(value))
    known = {
        "pattern": lambda: _when(value, texts, F.rlike(_text(value), F.lit(given))),
        "format": lambda: _when(value, texts, F.rlike(_text(value), F.lit(FORMATS[given]))),
        "minLength": lambda: _when(value, texts, F.length(_text(value)) >= given),
        "maxLength": lambda: _when(value, texts, F.length(_text(value)) <= given),
        "minimum": lambda: _when(value, NUMBERS, _number(value) >= given),
        "maximum": lambda: _when(value, NUMBERS, _number(value) <= given),
        "exclusiveMinimum": lambda: _when(value, NUMBERS, _number(value) > given),
        "exclusiveMaximum": lambda: _when(value, NUMBERS, _number(value) < given),
        "minItems": lambda: _when(value, lists, size >= given),
        "maxItems": lambda: _when(value, lists, size <= given),
        "uniqueItems": lambda: _when(value, lists, F.size(F.array_distinct(F.transform(_items(value), lambda item: F.to_json(item)))) == size) if given else F.lit(True),
    }
    return known[rule]() if rule in known else None


def failures(schema: Mapping | bool, value: Column, path: Column, root: Mapping | None = None, seen: tuple = ()) -> Column:
    """The failing places of a variant, as (path, rule), in the order of the schema's rules."""
    root = schema if root is None else root
    none = F.array().cast(FAILURES)

    def failed(at: Column, rule: str) -> Column:
        return F.array(F.struct(at.alias("path"), F.lit(rule).alias("rule"))).cast(FAILURES)

    def check(passes: Column, rule: str, at: Column = path) -> Column:
        return F.when(F.coalesce(passes, F.lit(False)), none).otherwise(failed(at, rule))

    def nested(inner: Mapping | bool, inner_value: Column, at: Column) -> Column:
        return failures(inner, inner_value, at, root, seen)

    if isinstance(schema, bool):
        return none if schema else failed(path, "false")
    found = []
    for rule, given in schema.items():
        simple = _simple(value, rule, given)
        if rule in ANNOTATIONS:
            continue
        if simple is not None:
            found.append(check(simple, rule))
        elif rule == "$ref":
            if given in seen or not given.startswith("#/"):
                raise ValueError(f"reference that cannot be followed: {given}")
            target = root
            for part in given[2:].split("/"):
                target = target[part]
            found.append(failures(target, value, path, root, (*seen, given)))
        elif rule == "required":
            is_object = _kind(value) == "OBJECT"
            for name in given:
                found.append(check(~is_object | _member(value, name).isNotNull(), rule, F.concat(path, F.lit(f".{name}"))))
        elif rule == "properties":
            for name, inner in given.items():
                member = _member(value, name)
                found.append(F.when(member.isNotNull(), nested(inner, member, F.concat(path, F.lit(f".{name}")))).otherwise(none))
        elif rule == "additionalProperties":
            others = F.map_filter(
                F.try_variant_get(value, "$", "map<string,variant>"),
                lambda name, _: ~F.coalesce(name.isin(*schema.get("properties", {})), F.lit(False)),
            )
            each = F.transform(
                F.map_entries(others),
                lambda e: F.when(F.lit(given is False), failed(F.concat(path, F.lit("."), e["key"]), rule)).otherwise(
                    none if isinstance(given, bool) else nested(given, e["value"], F.concat(path, F.lit("."), e["key"]))
                ),
            )
            found.append(F.when(_kind(value) == "OBJECT", F.flatten(each)).otherwise(none))
        elif rule == "items":
            each = F.transform(
                _items(value), lambda item, i: nested(given, item, F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))
            )
            found.append(F.when(_kind(value) == "ARRAY", F.flatten(each)).otherwise(none))
        elif rule == "allOf":
            found.extend(nested(inner, value, path) for inner in given)
        elif rule in ("anyOf", "oneOf"):
            hits = F.lit(0)
            for inner in given:
                hits = hits + (F.size(nested(inner, value, path)) == 0).cast("int")
            found.append(check(hits >= 1 if rule == "anyOf" else hits == 1, rule))
        elif rule == "not":
            found.append(check(F.size(nested(given, value, path)) > 0, rule))
        else:
            raise ValueError(f"unknown rule: {rule}")
    return F.concat(none, *found)


def checked(df: DataFrame, text: str, schema: Mapping, failing: str = "failures", valid: str = "valid") -> DataFrame:
    """Add to each record (a column of JSON text) its failing places and whether there are none; no row is dropped.

    Text that is NULL, is no JSON, or names a member twice fails as rule ``json`` at ``$``. A rule only speaks of the values it is about:
    a pattern of texts, a minimum of numbers. Lengths count code points, 1.0 is an integer and equals 1. Rules that are not known here and references that lead
    back to themselves raise ValueError, before anything runs.
    """
    parsed = df.withColumn("_parsed", F.try_parse_json(F.col(text)))
    broken = F.array(F.struct(F.lit("$").alias("path"), F.lit("json").alias("rule"))).cast(FAILURES)
    found = F.when(F.col("_parsed").isNull(), broken).otherwise(failures(schema, F.col("_parsed"), F.lit("$")))
    return parsed.withColumn(failing, found).withColumn(valid, F.size(failing) == 0).drop("_parsed")


def failure_counts(records: DataFrame, failing: str = "failures") -> DataFrame:
    """Failing records per place (list positions as ``[]``) and rule; a record counts once for each."""
    places = F.array_distinct(
        F.transform(failing, lambda f: F.struct(F.regexp_replace(f["path"], r"\[\d+\]", "[]").alias("path"), f["rule"].alias("rule")))
    )
    each = records.select(F.explode(places).alias("place")).select("place.*")
    return each.groupBy("path", "rule").agg(F.count(F.lit(1)).alias("records"))
