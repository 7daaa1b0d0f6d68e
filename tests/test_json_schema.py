"""Schema documents compiled to columns: against today's rules, and against a plain checker on a third document."""

import datetime
import json
import random
import re

import pytest

from tidewater.operators.json_schema import Compiler, validate_json
from tidewater.operators.validation import evaluation_document, evaluation_errors, parse_products, product_document, validate
from tidewater.queries.products import _BROKEN, changed


def errors(spark, document, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, payload string")
    return [r.errors for r in validate_json(rows, "payload", document).orderBy("i").collect()]


def test_the_product_document_judges_as_todays_rules(spark):
    texts = [changed(changes) for _, changes, _ in _BROKEN]
    compiled = errors(spark, product_document(), texts)
    for (name, _, error), found in zip(_BROKEN, compiled, strict=True):
        assert (found == []) == (error is None), name
        if error and not error.endswith("duplicate items"):
            assert error in found, (name, found)
    rng = random.Random(4)
    paths = ["product.policyType", "deductible.applies", "roomRent.limitType", "roomRent.icuLimitType", "hospitalization.ayush.limitType", "copayAndZones.mandatory", "copayAndZones.mandatoryPercent", "sublimits.cataract.type", "sublimits.cataract.value", "bonuses.ncb.maxCapPercent", "deductible.amount", "roomRent.limitValue", "valueAdds.others", "notes", "sublimits.diseaseSpecific"]
    values = [None, 0, 50, 101, -1, True, "percent_of_SI", "rupee_cap", "no_cap", "percent", "none", "age", "not_applicable", "Floater", ["a", "a"], ["a"], [{"name": "x", "type": "percent", "value": 1}], [{"name": "", "type": "percent", "value": 1}], ...]
    fitting = lambda path, v: not isinstance(v, list) or path in ("valueAdds.others", "sublimits.diseaseSpecific")
    texts = []
    for _ in range(150):
        changes = {p: rng.choice(values) for p in rng.sample(paths, rng.randrange(1, 4))}
        texts.append(changed({p: v for p, v in changes.items() if fitting(p, v)}))
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, payload string")
    today = {r.i: r.valid for r in validate(parse_products(rows, "payload"), "payload").collect()}
    for i, found in enumerate(errors(spark, product_document(), texts)):
        # What a typed column can't hold, as a number where a text stands, only the document sees.
        if found == []:
            assert today[i], texts[i]
        if not today[i]:
            assert found, texts[i]


EVALUATION = {"productRef": {"insurer": "I", "planName": "P", "variant": None}, "scores": [{"parameter": "ncb", "rating": "Good", "score": 90, "rationale": "r"}], "overall": {"weightedScore": 90.5, "grade": "A+", "notes": None}, "version": "1.0.0"}


@pytest.mark.parametrize(("path", "value"), [((), None), (("overall", "grade"), "E"), (("overall", "weightedScore"), 101), (("scores", 0, "rating"), "Fine"), (("scores", 0, "score"), -1), (("scores", 0, "rationale"), ""), (("version",), "1.0"), (("productRef", "insurer"), "")])
def test_the_evaluation_document_judges_as_todays_rules(spark, path, value):
    text = json.loads(json.dumps(EVALUATION))
    at = text
    for step in path[:-1]:
        at = at[step]
    if path:
        at[path[-1]] = value
    schema = "productRef struct<insurer:string,planName:string,variant:string>, scores array<struct<parameter:string,rating:string,score:double,rationale:string>>, overall struct<weightedScore:double,grade:string,notes:string>, version string"
    row = spark.read.schema(schema).json(spark.sparkContext.parallelize([json.dumps(text)]))
    today = row.select(evaluation_errors().alias("e")).head().e
    assert (errors(spark, evaluation_document(), [json.dumps(text)])[0] == []) == (today == []) == (path == ())


THIRD = {
    "type": "object",
    "required": ["id", "kind"],
    "additionalProperties": False,
    "$defs": {"tag": {"type": "string", "minLength": 2, "maxLength": 4, "pattern": "^[a-z]+$"}, "point": {"type": "array", "items": {"type": "number"}, "minItems": 2, "maxItems": 2}},
    "properties": {
        "id": {"type": "integer", "minimum": 1, "exclusiveMaximum": 100},
        "kind": {"enum": ["a", "b", 3, None, True, [1, "x"]]},
        "tags": {"type": "array", "uniqueItems": True, "items": {"$ref": "#/$defs/tag"}},
        "day": {"type": ["string", "null"], "format": "date"},
        "place": {"anyOf": [{"$ref": "#/$defs/point"}, {"type": "string", "not": {"const": "nowhere"}}]},
        "odd key/~": {"oneOf": [{"minimum": 5}, {"type": "integer"}]},
    },
    "if": {"properties": {"kind": {"const": "a"}}},
    "then": {"required": ["tags"]},
    "else": {"properties": {"day": {"type": "string"}}},
}


def kind_of(x):
    return "null" if x is None else "boolean" if isinstance(x, bool) else "number" if isinstance(x, (int, float)) else "string" if isinstance(x, str) else "array" if isinstance(x, list) else "object"


def same(a, b):
    return kind_of(a) == kind_of(b) and a == b


def fits(schema, x):
    """A plain checker of the keywords above."""
    kind = kind_of(x)
    for k, v in schema.items():
        if k == "type":
            ok = any(t == kind or (t == "integer" and kind == "number" and x == int(x)) for t in ([v] if isinstance(v, str) else v))
        elif k in ("enum", "const"):
            ok = any(same(c, x) for c in (v if k == "enum" else [v]))
        elif k in ("minimum", "exclusiveMaximum"):
            ok = kind != "number" or (x >= v if k == "minimum" else x < v)
        elif k in ("minLength", "maxLength", "pattern"):
            ok = kind != "string" or (len(x) >= v if k == "minLength" else len(x) <= v if k == "maxLength" else re.search(v, x) is not None)
        elif k == "format":
            try:
                ok = kind != "string" or bool(datetime.date.fromisoformat(x) if re.fullmatch(r"\d{4}-\d\d-\d\d", x) else None)
            except ValueError:
                ok = False
        elif k in ("minItems", "maxItems"):
            ok = kind != "array" or (len(x) >= v if k == "minItems" else len(x) <= v)
        elif k == "uniqueItems":
            ok = kind != "array" or len({json.dumps(i) for i in x}) == len(x)
        elif k == "items":
            ok = kind != "array" or all(fits(v, i) for i in x)
        elif k == "required":
            ok = kind != "object" or all(n in x for n in v)
        elif k == "properties":
            ok = kind != "object" or all(fits(s, x[n]) for n, s in v.items() if n in x)
        elif k == "additionalProperties":
            ok = kind != "object" or set(x) <= set(schema.get("properties", {}))
        elif k == "$ref":
            ok = fits(THIRD["$defs"][v.rsplit("/", 1)[-1]], x)
        elif k in ("anyOf", "oneOf"):
            n = sum(fits(s, x) for s in v)
            ok = n >= 1 if k == "anyOf" else n == 1
        elif k == "not":
            ok = not fits(v, x)
        elif k == "if":
            ok = fits(schema["then"], x) if fits(v, x) else fits(schema["else"], x)
        else:
            ok = True
        if not ok:
            return False
    return True


def test_a_third_document_against_a_plain_checker(spark):
    rng = random.Random(8)
    pool = {
        "id": [1, 99, 100, 0, 2.0, 2.5, "1", None],
        "kind": ["a", "b", 3, 4, None, True, False, [1, "x"], [1], "c"],
        "tags": [[], ["ab"], ["ab", "ab"], ["a"], ["abcde"], ["AB"], [3], "ab", None, ["ab", "cd"]],
        "day": ["2024-02-29", "2023-02-29", "2024-1-1", None, 5, ""],
        "place": [[1, 2], [1], [1, "2"], [1.5, 2, 3], "here", "nowhere", 7, None],
        "odd key/~": [4, 5, 5.5, 4.5, "x", None],
        "more": [1],
    }
    docs = [1, "text", None, [], {}]
    for _ in range(400):
        docs.append({k: v[0] if rng.random() < 0.85 else rng.choice(v) for k, v in pool.items() if rng.random() < (0.1 if k == "more" else 0.75)})
    found = errors(spark, THIRD, [json.dumps(d) for d in docs])
    for d, e in zip(docs, found, strict=True):
        assert (e == []) == fits(THIRD, d), (d, e)
    assert 20 < sum(e == [] for e in found) < 300


def test_texts_that_are_no_json_and_documents_that_say_too_much(spark):
    assert errors(spark, {"type": "object"}, [None, "", "{bad", "[1]"]) == [["(root): must be JSON"]] * 3 + [["(root): must be object"]]
    assert errors(spark, {"properties": {"a": {"items": {"type": "string"}}}}, ['{"a": ["x", 1, null]}']) == [["/a/1: must be string", "/a/2: must be string"]]
    for document in ({"dependentRequired": {}}, {"format": "email"}, {"$ref": "#"}, {"$ref": "http://x"}, {"additionalProperties": {"type": "string"}}):
        with pytest.raises(ValueError):
            Compiler(document)._errors(document, None, None, ("#",)) if document == {"$ref": "#"} else errors(spark, document, ["{}"])
