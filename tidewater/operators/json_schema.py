"""JSON Schema documents compiled to columns: one array of errors for each JSON text, without Python and without a shuffle.

A text is parsed once to a variant; every keyword becomes an expression on the part it stands for.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.text import let

#: Keywords that say nothing about validity.
ANNOTATIONS = frozenset({"$schema", "$id", "$comment", "$defs", "title", "description", "default", "examples", "errorMessage"})
_NUMBER = "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"
_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
Schema = dict[str, Any]


def _none() -> Column:
    return F.array().cast("array<string>")


def _part(value: Column, name: str) -> Column:
    return F.try_variant_get(value, '$["' + name.replace("\\", "\\\\").replace('"', '\\"') + '"]', "variant")


def _is(value: Column, kind: str) -> Column:
    shape = F.schema_of_variant(value)
    tests = {
        "null": F.is_variant_null(value),
        "string": shape == "STRING",
        "boolean": shape == "BOOLEAN",
        "number": shape.rlike(_NUMBER),
        "integer": shape.rlike(_NUMBER) & (_number(value) % 1 == 0),
        "object": shape.startswith("OBJECT"),
        "array": shape.startswith("ARRAY"),
    }
    return F.coalesce(tests[kind], F.lit(False))


def _number(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _equals(value: Column, constant: Any) -> Column:
    if constant is None:
        return F.is_variant_null(value)
    if isinstance(constant, bool):
        return _is(value, "boolean") & (F.try_variant_get(value, "$", "boolean") == constant)
    if isinstance(constant, (int, float)):
        return _is(value, "number") & (_number(value) == float(constant))
    if isinstance(constant, str):
        return _is(value, "string") & (_text(value) == constant)
    return F.to_json(value) == F.to_json(F.parse_json(F.lit(json.dumps(constant))))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for test in tests:
        out = out | F.coalesce(test, F.lit(False))
    return out


class Compiler:
    """``errors`` of one document. A keyword that isn't known is an error when compiling, so that no rule is passed over."""

    def __init__(self, document: Schema) -> None:
        self.document = document

    def errors(self, payload: Column) -> Column:
        """Broken rules of a JSON text as array<string>, ``path: what is wrong``, in the document's order. Null and malformed texts break one rule."""
        # Branches don't share what they compute, so that the text would be parsed again for every keyword.
        return let(F.try_parse_json(payload), lambda v: F.when(v.isNull(), F.array(F.lit("(root): must be JSON"))).otherwise(self._errors(self.document, v, "", ())))

    def _errors(self, schema: Schema | bool, value: Column, path: str | Column, within: tuple[str, ...]) -> Column:
        """Errors of a part that is there. ``path`` is text as far as it is known when compiling, which keeps plans small."""
        if isinstance(schema, bool):
            return _none() if schema else self._said(F.lit(False), path, "must not be there")
        found = [self._keyword(name, schema, value, path, within) for name in schema if name not in ANNOTATIONS]
        found = [f for f in found if f is not None]
        errors = F.concat(*found) if found else _none()
        if "errorMessage" in schema:
            return F.when(F.size(errors) > 0, self._said(F.lit(False), path, schema["errorMessage"])).otherwise(_none())
        return errors

    @staticmethod
    def _said(ok: Column, path: str | Column, message: str | Column) -> Column:
        where = F.lit(f"{path or '(root)'}: ") if isinstance(path, str) else F.concat(path, F.lit(": "))
        whole = F.lit(f"{path or '(root)'}: {message}") if isinstance(path, str) and isinstance(message, str) else F.concat(where, F.lit(message) if isinstance(message, str) else message)
        return F.when(F.coalesce(ok, F.lit(False)), _none()).otherwise(F.array(whole))

    @staticmethod
    def _text(path: str | Column, message: str, name: Column) -> Column:
        start = F.lit(f"{path or '(root)'}: {message}") if isinstance(path, str) else F.concat(path, F.lit(f": {message}"))
        return F.concat(start, name)

    def _keyword(self, name: str, schema: Schema, value: Column, path: str | Column, within: tuple[str, ...]) -> Column | None:
        wanted = schema[name]
        said = lambda ok, message: self._said(ok, path, message)
        only = lambda kind, ok: ~_is(value, kind) | ok  # noqa: E731 - rules on a kind hold for all others
        if name == "type":
            kinds = [wanted] if isinstance(wanted, str) else wanted
            return said(_any([_is(value, k) for k in kinds]), f"must be {' or '.join(kinds)}")
        if name in ("enum", "const"):
            return said(_any([_equals(value, c) for c in (wanted if name == "enum" else [wanted])]), "must be one of the allowed values")
        if name in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum"):
            x = _number(value)
            ok = {"minimum": x >= wanted, "maximum": x <= wanted, "exclusiveMinimum": x > wanted, "exclusiveMaximum": x < wanted}[name]
            return said(only("number", ok), "must be a number within its range")
        if name in ("minLength", "maxLength"):
            n = F.char_length(_text(value))
            return said(only("string", n >= wanted if name == "minLength" else n <= wanted), "must not be empty" if (name, wanted) == ("minLength", 1) else "must have a fitting length")
        if name == "pattern":
            return said(only("string", _text(value).rlike(wanted)), f"must match {wanted}")
        if name == "format":
            if wanted != "date":
                raise ValueError(f"format {wanted!r} isn't known")
            return said(only("string", _text(value).rlike(_DATE) & F.try_to_date(_text(value), "yyyy-MM-dd").isNotNull()), "must be a date")
        if name in ("minItems", "maxItems", "uniqueItems"):
            items = F.try_variant_get(value, "$", "array<variant>")
            if name == "uniqueItems":
                if not wanted:
                    return None
                written = F.transform(items, lambda x: F.to_json(x))
                return said(only("array", F.size(written) == F.size(F.array_distinct(written))), "must not have duplicate items")
            return said(only("array", F.size(items) >= wanted if name == "minItems" else F.size(items) <= wanted), "must have a fitting number of items")
        if name == "items":
            items = F.try_variant_get(value, "$", "array<variant>")
            each = F.transform(items, lambda x, i: self._errors(wanted, x, F.concat(F.lit(path) if isinstance(path, str) else path, F.lit("/"), i.cast("string")), within))
            return F.coalesce(F.flatten(each), _none())
        if name == "required":
            keys = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
            missing = F.array_except(F.array(*map(F.lit, wanted)), keys)
            said_of = F.transform(missing, lambda n: self._text(path, "must have required property ", n))
            return F.coalesce(said_of, _none()) if wanted else None
        if name == "properties":

            def below(part_name: str, rules: Schema | bool) -> Column:
                where = f"{path}/{part_name}" if isinstance(path, str) else F.concat(path, F.lit(f"/{part_name}"))
                return let(_part(value, part_name), lambda v: F.when(v.isNotNull(), self._errors(rules, v, where, within)).otherwise(_none()))

            return F.concat(*[below(n, rules) for n, rules in wanted.items()]) if wanted else None
        if name == "additionalProperties":
            keys = F.map_keys(F.try_variant_get(value, "$", "map<string,variant>"))
            others = F.array_except(keys, F.array(*[F.lit(n) for n in schema.get("properties", {})]).cast("array<string>"))
            if wanted is True:
                return None
            if wanted is not False:
                raise ValueError("additionalProperties is known as true or false only")
            return F.coalesce(F.transform(others, lambda k: self._text(path, "must not have additional property ", k)), _none())
        if name == "$ref":
            return self._errors(self._resolved(wanted, within), value, path, (*within, wanted))
        if name == "allOf":
            return F.concat(*[self._errors(s, value, path, within) for s in wanted])
        if name in ("anyOf", "oneOf"):
            fits = [(F.size(self._errors(s, value, path, within)) == 0).cast("int") for s in wanted]
            n = sum(fits[1:], fits[0])
            return said(n >= 1 if name == "anyOf" else n == 1, "must match one of the alternatives")
        if name == "not":
            return said(F.size(self._errors(wanted, value, path, within)) > 0, "must not match")
        if name == "if":
            holds = F.size(self._errors(wanted, value, path, within)) == 0
            branch = lambda key: self._errors(schema.get(key, True), value, path, within)
            return F.when(holds, branch("then")).otherwise(branch("else"))
        if name in ("then", "else"):
            return None
        raise ValueError(f"keyword {name!r} isn't known")

    def _resolved(self, pointer: str, within: tuple[str, ...]) -> Schema | bool:
        if not pointer.startswith("#"):
            raise ValueError(f"{pointer!r} is outside of the document")
        if pointer in within:
            raise ValueError(f"{pointer!r} refers to itself")
        at: Any = self.document
        for step in pointer[1:].split("/")[1:]:
            at = at[step.replace("~1", "/").replace("~0", "~")]
        return at


def validate_json(records: DataFrame, payload: str, document: Schema) -> DataFrame:
    """``records`` with errors (array<string>) and valid, by a schema document, of the JSON texts in ``payload``.

    Known: type, enum, const, bounds, lengths, pattern, format date, items, minItems, maxItems, uniqueItems,
    required, properties, additionalProperties (false), $ref inside the document, allOf, anyOf,
    oneOf, not, if/then/else, and errorMessage, which replaces all errors below it. Anything else is an error when compiling.
    """
    return records.withColumn("errors", Compiler(document).errors(F.col(payload))).withColumn("valid", F.size("errors") == 0)
