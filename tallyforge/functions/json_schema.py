"""A subset of JSON Schema, and matchers of values, compiled to Columns over variants.

A document is parsed once; every check is an expression of built-in functions, so Spark plans and runs them like any other.

Schemas: object (required, properties, additionalProperties: false), array (items, minItems, maxItems), string (enum, minLength,
maxLength), integer and number (minimum, exclusiveMinimum). Any other type is accepted as it is. A number with a fraction part that is
zero (2.0) is a number and no integer. Lengths are in characters.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


# What errors say behind the path.
MISSING, NOT_ALLOWED, TOO_FEW, TOO_MANY, NOT_ONE_OF, BAD_LENGTH, BELOW, NOT_ABOVE = (
    ": missing", ": not allowed", ": too few items", ": too many items", ": not one of ", ": bad length", ": below minimum", ": not above minimum",
)


def parsed(text: Column) -> Column:
    """The document as a variant; null where the text is null or no JSON."""
    return F.try_parse_json(text)


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """What becomes of a value that is used in many places: it is worked out once, not in each of them."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def kind(value: Column) -> Column:
    """object, array, string, integer, number, boolean or null; null where there is no value."""
    return once(F.schema_of_variant(value), _kind)


def _kind(name: Column) -> Column:
    return (
        F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string").when(name == "BIGINT", "integer")
        .when(name.startswith("DECIMAL") | name.isin("DOUBLE", "FLOAT"), "number").when(name == "BOOLEAN", "boolean").when(name == "VOID", "null")
    )


def _is(value: Column, *kinds: str) -> Column:
    return F.coalesce(kind(value).isin(*kinds), F.lit(False))


def _as(value: Column, kind_: str) -> Column:
    return F.try_variant_get(value, "$", kind_)


def members(value: Column) -> Column:
    """An object's fields as a map of variants."""
    return _as(value, "map<string,variant>")


def items(value: Column) -> Column:
    return _as(value, "array<variant>")


def field(value: Column, name: str) -> Column:
    """A field of an object; null where there is none."""
    return F.try_element_at(members(value), F.lit(name))


def by_name(name: Column, columns: Mapping[str, Column], otherwise: Column) -> Column:
    """The column that a name chooses."""
    out = None
    for key, column in columns.items():
        out = F.when(name == key, column) if out is None else out.when(name == key, column)
    return otherwise if out is None else out.otherwise(otherwise)


# -- schemas


def errors(schema: Mapping[str, Any], value: Column, path: str | Column = "$") -> Column:
    """What is wrong with a variant, as texts that begin with a path; empty if nothing is. A missing value counts as null."""
    at = F.lit(path) if isinstance(path, str) else path
    say = lambda *parts: F.array(F.concat(at, *[F.lit(p) if isinstance(p, str) else p for p in parts]))
    none = F.array().cast("array<string>")
    check = _CHECKS.get(schema.get("type"))
    if check is None:
        return none

    def checked(v: Column) -> Column:
        own, name = check(schema, v, at, say, none)
        return F.when(~_is(v, *_KINDS[schema["type"]]), say(": not an " if name[0] in "aeio" else ": not a ", name)).otherwise(own)

    return once(value, checked)


_KINDS = {"object": ("object",), "array": ("array",), "string": ("string",), "integer": ("integer",), "number": ("integer", "number")}


def _object(schema, value, at, say, none):
    properties = schema.get("properties", {})

    def inside(fields: Column) -> Column:
        keys, parts = F.map_keys(fields), []
        if missing := schema.get("required"):
            parts.append(F.transform(F.filter(F.array(*map(F.lit, missing)), lambda k: ~F.array_contains(keys, k)), lambda k: F.concat(at, F.lit("."), k, F.lit(MISSING))))
        if schema.get("additionalProperties") is False:
            known = F.array(*map(F.lit, properties)) if properties else none
            parts.append(F.transform(F.array_sort(F.array_except(keys, known)), lambda k: F.concat(at, F.lit("."), k, F.lit(NOT_ALLOWED))))
        for name, sub in properties.items():
            inner = errors(sub, F.try_element_at(fields, F.lit(name)), F.concat(at, F.lit(f".{name}")))
            parts.append(F.when(F.array_contains(keys, name), inner).otherwise(none))
        return F.concat(none, *parts)

    return once(members(value), inside), "object"


def _array(schema, value, at, say, none):
    def within(inside: Column) -> Column:
        parts = [F.when(F.size(inside) < schema.get("minItems", 0), say(TOO_FEW)).otherwise(none)]
        if "maxItems" in schema:
            parts.append(F.when(F.size(inside) > schema["maxItems"], say(TOO_MANY)).otherwise(none))
        if schema.get("items"):
            each = F.transform(inside, lambda v, i: errors(schema["items"], v, F.concat(at, F.lit("["), i.cast("string"), F.lit("]"))))
            parts.append(F.flatten(each))
        return F.concat(none, *parts)

    return once(items(value), within), "array"


def _string(schema, value, at, say, none):
    text = _as(value, "string")
    size = F.char_length(text)
    bad = (size < schema.get("minLength", 0)) | (size > schema["maxLength"] if "maxLength" in schema else F.lit(False))
    out = F.when(bad, say(BAD_LENGTH)).otherwise(none)
    if "enum" in schema:
        out = F.when(~text.isin(*schema["enum"]), say(NOT_ONE_OF, str([*schema["enum"]]))).otherwise(out)
    return out, "string"


def _number(schema, value, at, say, none):
    x, out = _as(value, "double"), none
    if "exclusiveMinimum" in schema:
        out = F.when(x <= schema["exclusiveMinimum"], say(NOT_ABOVE)).otherwise(out)
    if "minimum" in schema:
        out = F.when(x < schema["minimum"], say(BELOW)).otherwise(out)
    return out, schema["type"]


_CHECKS = {"object": _object, "array": _array, "string": _string, "integer": _number, "number": _number}


# -- matchers


def normal(value: Column) -> Column:
    """What values are compared by: text is trimmed and lower-cased and loses its commas, and is a number if it reads as one."""
    text = F.replace(F.lower(F.trim(_as(value, "string"))), F.lit(","), F.lit(""))
    number = F.when(_is(value, "string"), text.try_cast("double")).when(_is(value, "integer", "number"), _as(value, "double")).when(_is(value, "boolean"), _as(value, "boolean").cast("double"))
    other = F.when(_is(value, "string"), text).when(_is(value, "object", "array"), F.to_json(value))
    return F.struct(number.alias("number"), F.when(number.isNull(), other).alias("text"))


def _literal(value: Any) -> Column:
    import json

    return normal(F.parse_json(F.lit(json.dumps(value))))


def _same(a: Column, b: Column) -> Column:
    return a["number"].eqNullSafe(b["number"]) & a["text"].eqNullSafe(b["text"])


def matches(matcher: Mapping[str, Any], value: Column) -> Column:
    """Whether a variant (null where it is missing) meets all conditions of a matcher: never null.

    equals, one_of: by normal values. contains_any: one of the texts in it, whatever the case. range: a number between two. length: a
    list of so many. present: there, and not null, or not. contains: a list that has all of these. items: a list whose first items have
    fields that meet these matchers.
    """
    unknown = set(matcher) - set(_MATCHERS)
    if unknown:
        raise ValueError(f"unknown matcher: {', '.join(sorted(unknown))}")
    out = F.lit(True)
    for name, expected in matcher.items():
        out = out & F.coalesce(_MATCHERS[name](expected, value), F.lit(False))
    return out


def _fields(expected: list[Mapping[str, Mapping]], value: Column) -> Column:
    inside = items(value)
    out = _is(value, "array") & (F.size(inside) >= len(expected))
    for i, spec in enumerate(expected):
        for name, matcher in spec.items():
            out = out & matches(matcher, field(F.get(inside, F.lit(i)), name))
    return out


def _has_all(expected: list, value: Column) -> Column:
    inside = F.transform(items(value), normal)
    out = _is(value, "array")
    for x in map(_literal, expected):
        out = out & _exists(inside, x)
    return out


def _exists(values: Column, wanted: Column) -> Column:
    return F.exists(values, lambda v: _same(v, wanted))


def _any(columns: list[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out


_MATCHERS = {
    "equals": lambda e, v: _same(normal(v), _literal(e)),
    "one_of": lambda e, v: _any([_same(normal(v), _literal(x)) for x in e]),
    "contains_any": lambda e, v: _is(v, "string") & _any([F.contains(F.lower(_as(v, "string")), F.lit(x.lower())) for x in e]),
    "range": lambda e, v: _is(v, "integer", "number", "boolean") & normal(v)["number"].between(float(e[0]), float(e[1])),
    "length": lambda e, v: _is(v, "array") & (F.size(items(v)) == e),
    "present": lambda e, v: (v.isNotNull() & ~_is(v, "null")) == bool(e),
    "contains": _has_all,
    "items": _fields,
}
