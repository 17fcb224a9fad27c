"""Checks of JSON payloads against a schema, and merges of JSON objects, as column expressions over VARIANT."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What `schema_of_variant` says of each type of the schema; a number without a fraction is an integer.
TYPES = {"null": "VOID", "string": "STRING", "integer": r"BIGINT|DECIMAL\(\d+,0\)", "number": r"BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\)", "boolean": "BOOLEAN", "object": "OBJECT<.*", "array": "ARRAY<.*"}


def variant(payload: Column) -> Column:
    """A JSON text as VARIANT; null if it is none."""
    return F.try_parse_json(payload)


def part(value: Column, key: str, kind: str = "variant") -> Column:
    """A field of an object; null where it is missing, a null VARIANT where it is null."""
    if "'" in key and '"' in key:
        field = F.element_at(F.try_variant_get(value, "$", "map<string,variant>"), key)
        return field if kind == "variant" else F.try_variant_get(field, "$", kind)
    return F.try_variant_get(value, f'$["{key}"]' if "'" in key else f"$['{key}']", kind)


def _equals(value: Column, kind: Column, constant: object) -> Column:
    """Whether a VARIANT is a constant of JSON: numbers by value, all else by type and text."""
    if constant is None:
        return kind == "VOID"
    if isinstance(constant, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == constant)
    if isinstance(constant, int | float):
        return kind.rlike(f"^(?:{TYPES['number']})$") & (F.try_variant_get(value, "$", "double") == float(constant))
    if isinstance(constant, str):
        return (kind == "STRING") & (F.try_variant_get(value, "$", "string") == constant)
    return F.to_json(value) == F.to_json(F.parse_json(F.lit(json.dumps(constant))))


def errors(schema: dict, value: Column, path: Column | None = None) -> Column:
    """What a VARIANT breaks of a schema, as an array of "path: keyword" in the schema's order.

    The keywords are const, enum, type (one or several), format date, required, properties and items; others are not looked at. A value that is
    not the constant, not in the enumeration, or of another type is reported once and not looked into. Keys that the schema does not name are
    free. A payload that is no JSON (a null VARIANT column) breaks the type only.
    """
    path = F.lit("$") if path is None else path
    kind = F.coalesce(F.schema_of_variant(value), F.lit("NONE"))
    one = lambda hit, word: F.when(F.coalesce(hit, F.lit(False)), F.array(F.concat(path, F.lit(f": {word}"))))
    none = F.array().cast("array<string>")
    named = schema.get("type")
    types = [named] if isinstance(named, str) else [t for t in named or [] if isinstance(t, str)]
    known = all(t in TYPES for t in types)  # a type that is unknown admits all
    fails = []
    if "const" in schema:
        fails.append(one(~_equals(value, kind, schema["const"]), "const"))
    if "enum" in schema:
        within = F.lit(False)
        for constant in schema["enum"]:
            within = within | F.coalesce(_equals(value, kind, constant), F.lit(False))
        fails.append(one(~within, "enum"))
    if types and known:
        fails.append(one(~kind.rlike("^(?:" + "|".join(TYPES[t] for t in types) + ")$"), "type"))
    inside = [none]
    if schema.get("format") == "date":
        text = F.try_variant_get(value, "$", "string")
        day = F.try_to_timestamp(text, F.lit("yyyy-M-d"))
        inside.append(F.when(kind == "STRING", F.coalesce(one(~text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$") | day.isNull(), "format"), none)).otherwise(none))
    required = [k for k in schema.get("required") or [] if isinstance(k, str)]
    fields = {k: s for k, s in (schema.get("properties") or {}).items() if isinstance(s, dict)}
    if required or fields:
        missing = [F.coalesce(one(part(value, k).isNull(), f"required {k}"), none) for k in required]
        below = [F.when(part(value, k).isNotNull(), errors(s, part(value, k), F.concat(path, F.lit(f".{k}")))).otherwise(none) for k, s in fields.items()]
        inside.append(F.when(kind.startswith("OBJECT"), F.concat(*missing, *below)).otherwise(none))
    if isinstance(schema.get("items"), dict):
        each = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x, i: errors(schema["items"], x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        inside.append(F.when(kind.startswith("ARRAY"), F.flatten(each)).otherwise(none))
    return F.coalesce(*fails, F.concat(*inside))


def merged(old: Column, new: Column, deep: tuple[str, ...] = ()) -> Column:
    """A JSON text of two objects' fields, the new ones first; fields named in `deep` are merged themselves, other values replaced whole.

    What is no object counts as an empty one. Fields are in the order of their names.
    """
    fields = lambda v: F.coalesce(F.when(F.coalesce(F.schema_of_variant(v), F.lit("")).startswith("OBJECT"), F.try_variant_get(v, "$", "map<string,variant>")), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>")))
    both = lambda a, b: F.map_zip_with(fields(a), fields(b), lambda _, x, y: F.coalesce(y, x))
    inner = {k: both(part(old, k), part(new, k)) for k in deep}
    top = both(old, new)
    for k, value in inner.items():
        whole = F.map_from_arrays(F.array(F.lit(k)), F.array(F.parse_json(F.to_json(value))))
        top = F.when(part(old, k).isNotNull() | part(new, k).isNotNull(), F.map_zip_with(top, whole, lambda _, x, y: F.coalesce(y, x))).otherwise(top)
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(top), lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0))))


def updated(update: Column, columns: dict[str, Column], doc_types: tuple[str, ...]) -> dict[str, Column]:
    """Columns of a document after a model's answer (a VARIANT object): non-blank fields replace, an unknown doc_type or a year that is no number does not."""
    text = lambda k: F.nullif(F.trim(part(update, k, "string")), F.lit(""))
    out = {}
    for name, old in columns.items():
        new = text(name)
        if name == "doc_type":
            new = F.when(F.lower(new).isin(*doc_types), F.lower(new))
        elif name == "year":
            new = new.try_cast("double").cast("int")
        out[name] = F.coalesce(new, old)
    return out
