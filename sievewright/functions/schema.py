"""JSON outputs held against a JSON Schema (J14), with the part of draft 2020-12 that drafts of cards need."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = {"object": dict, "array": list, "string": str, "null": type(None), "boolean": bool, "integer": int, "number": (int, float)}
KNOWN = {"type", "anyOf", "required", "enum", "additionalProperties", "properties", "items", "minItems", "uniqueItems", "$ref", "$defs", "$schema", "title"}

_TEXT, _TEXTS = {"type": "string"}, {"type": "array", "items": {"type": "string"}}
_FIELDS = {
    **{k: _TEXT for k in ("name", "mana_cost", "type_line", "power", "toughness", "loyalty", "defense", "hand_modifier", "life_modifier", "oracle_text", "layout")},
    "colors": {"type": "array", "uniqueItems": True, "items": {"enum": ["W", "U", "B", "R", "G"]}},
    "design_notes": _TEXTS,
    "questions": _TEXTS,
}
_CARD = {"type": "object", "required": ["type_line", "oracle_text"], "additionalProperties": False}

#: An editable design: the fields of a face, and either a rarity or faces of its own besides.
DRAFT = _CARD | {
    "properties": _FIELDS | {"card_faces": {"type": "array", "minItems": 2, "items": {"$ref": "#/$defs/face"}}, "rarity": {"enum": ["common", "uncommon", "rare", "mythic", "special", "bonus"]}},
    "$defs": {"face": _CARD | {"properties": _FIELDS}},
}


def _same(x) -> str:
    """Text that is equal for values equal in JSON: 1 and 1.0 are, 1 and true are not."""
    plain = lambda v: {k: plain(w) for k, w in v.items()} if isinstance(v, dict) else [plain(w) for w in v] if isinstance(v, list) else int(v) if isinstance(v, float) and v.is_integer() else v
    return json.dumps(plain(x), sort_keys=True)


def validator(schema: dict) -> Callable[[object], list[str]]:
    """A function from a value to its errors as sorted `path:keyword`. A keyword that it does not know is an error here."""

    def refuse(s: dict) -> None:
        if unknown := s.keys() - KNOWN:
            raise ValueError(f"unknown keywords {sorted(unknown)}")
        for sub in [*s.get("anyOf", []), *s.get("properties", {}).values(), *s.get("$defs", {}).values(), *([s["items"]] if "items" in s else [])]:
            refuse(sub)
        if "type" in s and s["type"] not in KINDS or s.get("additionalProperties", False) is not False:
            raise ValueError("only the plain kinds, and no schema of further properties")

    def resolve(s: dict) -> dict:
        while "$ref" in s:
            at = schema
            for part in s["$ref"].removeprefix("#/").split("/"):
                at = at[part]
            s = at
        return s

    def errors(v, s: dict, path: str) -> Iterator[str]:
        s = resolve(s)
        if "type" in s and (not isinstance(v, KINDS[s["type"]]) or (isinstance(v, bool) and s["type"] in ("integer", "number"))):
            yield f"{path}:type"
        if "anyOf" in s and all(any(True for _ in errors(v, sub, path)) for sub in s["anyOf"]):
            yield f"{path}:anyOf"
        if "enum" in s and _same(v) not in map(_same, s["enum"]):
            yield f"{path}:enum"
        if isinstance(v, dict):
            fields = s.get("properties", {})
            yield from (f"{path}/{k}:required" for k in s.get("required", []) if k not in v)
            if "additionalProperties" in s and v.keys() - fields.keys():
                yield f"{path}:additionalProperties"
            for k in fields.keys() & v.keys():
                yield from errors(v[k], fields[k], f"{path}/{k}")
        if isinstance(v, list):
            if len(v) < s.get("minItems", 0):
                yield f"{path}:minItems"
            if s.get("uniqueItems") and len(set(map(_same, v))) < len(v):
                yield f"{path}:uniqueItems"
            for i, x in enumerate(v if "items" in s else []):
                yield from errors(x, s["items"], f"{path}/{i}")

    refuse(schema)
    return lambda v: sorted(errors(v, schema, ""))


def keyed_schema(key: str, labels: list[str], value: dict) -> dict:
    """The schema of a reply that has under `key` one `value` for each label and no other, or null."""
    entries = {"type": "object", "additionalProperties": False, "required": list(labels), "properties": {label: value for label in labels}}
    return {"type": "object", "additionalProperties": False, "required": [key], "properties": {key: {"anyOf": [{"type": "null"}, entries]}}}


def check_json(df: DataFrame, key: str, value: str, schema: dict = DRAFT, fields: tuple[str, ...] = ()) -> DataFrame:
    """(`key`, `is_json`, `is_object`, `schema_valid`, `schema_errors`) and the text `fields` of every row whose `value` is not null.

    What is JSON is what `json.loads` reads; text that it does not read has no schema errors, and is not valid. A field is
    null unless it is a string of an object.
    """
    kind = dict(df.dtypes)[key]
    names = ["is_json", "is_object", "schema_valid", "schema_errors", *fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        check = validator(schema)

        def one(raw: str) -> tuple:
            try:
                v = json.loads(raw)
                found = check(v)
            except (ValueError, RecursionError):
                return (False, False, False, None, *(None for _ in fields))
            texts = (v.get(f) if isinstance(v, dict) else None for f in fields)
            return (True, isinstance(v, dict), not found, ",".join(found), *(t if isinstance(t, str) else None for t in texts))

        for pdf in batches:
            out = pd.DataFrame([one(t) for t in pdf[value]], columns=names)
            yield out.assign(**{key: pdf[key].to_numpy()})[[key, *out.columns]]

    rows = df.filter(F.col(value).isNotNull()).select(key, F.make_valid_utf8(value).alias(value))
    shape = ", ".join(f"{n} {'boolean' if n in names[:3] else 'string'}" for n in names)
    return rows.mapInPandas(run, f"{key} {kind}, {shape}")
