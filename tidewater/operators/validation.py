"""Declarative validation of products: one rule, one boolean expression; all errors are reported.

Rules on values read the typed columns. Presence of keys and unknown keys can only be seen in
the raw JSON, so those read it, where it is given.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater import types
from tidewater.operators.scoring import WEIGHTS

#: Domains of enumerated fields; a null in a domain allows null.
DOMAINS = {
    "product.policyType": ("Individual", "Floater"),
    "deductible.type": ("per_year", "per_claim", None),
    "roomRent.limitType": ("no_cap", "single_private_room", "twin_sharing", "percent_of_SI", "rupee_cap"),
    "roomRent.icuLimitType": ("no_cap", "percent_of_SI", "rupee_cap"),
    "roomRent.proportionateDeduction": ("applies", "waived_with_addon", "not_applicable"),
    "hospitalization.inpatient": ("covered", "not_covered"),
    "hospitalization.daycare": ("all", "all_listed", "limited_list", "not_covered"),
    "hospitalization.ayush.limitType": ("up_to_SI", "percent", "rupee_cap", "not_covered"),
    "transport.airAmbulance": ("covered", "optional", "not_covered"),
    "bonuses.ncb.claimImpact": ("reduces", "no_impact", None),
    "bonuses.recharge.type": ("unlimited", "once", "twice", "na"),
    "copayAndZones.mandatory": ("none", "age", "zone", "network", "disease_specific"),
    "sublimits.cataract.type": ("percent_of_SI", "rupee_cap", "not_applicable"),
    "topUpSpecifics.howDeductibleApplies": ("aggregate_year", "per_claim", None),
    "topUpSpecifics.roomRuleOnTopUp": ("same_as_base", "plan_rule", None),
    "topUpSpecifics.rechargeOnTopUp": ("available", "na"),
    "topUpSpecifics.ncbOnTopUp": ("available", "na"),
    "provenance.sourceType": ("manual", "policy_pdf", "insurer_site", "broker_portal"),
}
#: Fixed values: (path, least, most, null allowed) of numbers.
RANGES = (
    ("sumInsured.baseSI", 0, None, False),
    ("deductible.amount", 0, None, True),
    ("hospitalization.preHospDays", 0, None, False),
    ("hospitalization.postHospDays", 0, None, False),
    ("hospitalization.domiciliary.minDays", 0, None, True),
    ("transport.roadAmbulanceLimit", 0, None, True),
    ("transport.airAmbulanceLimit", 0, None, True),
    ("bonuses.ncb.accrualPerYearPercent", 0, 200, True),
    ("bonuses.ncb.maxCapPercent", 0, 500, True),
    ("waitingPeriods.initialDays", 0, None, False),
    ("waitingPeriods.specificAilmentsMonths", 0, None, False),
    ("waitingPeriods.pedMonths", 0, None, False),
    ("copayAndZones.mandatoryPercent", 0, 100, True),
    ("sublimits.cataract.value", 0, None, True),
)
#: Objects may hold nothing but their declared keys, and lack none but these of the outermost.
OPTIONAL = ("notes",)
NON_EMPTY = ("product.insurer", "product.planName", "provenance.sourceName")
REQUIRED_BOOLEANS = (
    *("product.isTopUp", "sumInsured.unlimitedOneClaim", "deductible.applies", "roomRent.roomModifierOption", "hospitalization.domiciliary.covered"),
    *("hospitalization.domiciliary.negativeListPresent", "hospitalization.ayush.covered", "organDonor.covered", "waitingPeriods.reductionOptions.specificAilments"),
    *("waitingPeriods.reductionOptions.ped", "copayAndZones.optionalCopayAvailable", "valueAdds.annualHealthCheckup", "valueAdds.eConsult", "valueAdds.wellnessBenefits"),
)


@dataclass(frozen=True)
class Rule:
    """``holds``: SQL that is true where the rule is kept; null counts as broken."""

    path: str
    holds: str
    message: str


def _conditional(where: str, field: str, when: str, holds: str, message: str) -> Rule:
    return Rule(where, f"coalesce(NOT ({field} {when}), true) OR ({holds})", message)


def _between(x: str, high: int | None = 100) -> str:
    return f"{x} >= 0" + (f" AND {x} <= {high}" if high is not None else "")


_ROOM, _ICU, _AYUSH, _CATARACT, _COPAY = "roomRent.limitValue", "roomRent.icuLimitValue", "hospitalization.ayush.limitValue", "sublimits.cataract.value", "copayAndZones.mandatoryPercent"

#: Rules with a message of their own. The messages.
STATED = (
    Rule("/product/geography", "product.geography RLIKE '^[A-Z]{2,3}$'", "Geography must be an ISO-3166 alpha code (2-3 uppercase letters)."),
    Rule("/sumInsured/currency", "sumInsured.currency RLIKE '^[A-Z]{3}$'", "Currency must be a 3-letter ISO code."),
    _conditional("/deductible", "deductible.applies", "", "deductible.type IN ('per_year', 'per_claim') AND deductible.amount >= 0", "Deductible applying requires type per_year/per_claim and numeric amount."),
    _conditional("/roomRent", "roomRent.limitType", "= 'percent_of_SI'", _between(_ROOM), "When limitType is percent_of_SI, limitValue must be 0-100."),
    _conditional("/roomRent", "roomRent.limitType", "= 'rupee_cap'", _between(_ROOM, None), "Rupee cap requires a non-negative limitValue."),
    _conditional("/roomRent", "roomRent.limitType", "IN ('no_cap', 'single_private_room', 'twin_sharing')", f"{_ROOM} IS NULL", "Room types with inherent descriptions cannot have a numeric limitValue."),
    _conditional("/roomRent", "roomRent.icuLimitType", "= 'percent_of_SI'", _between(_ICU), "ICU percent limits must be within 0-100."),
    _conditional("/roomRent", "roomRent.icuLimitType", "= 'rupee_cap'", _between(_ICU, None), "ICU rupee cap must be a non-negative number."),
    _conditional("/roomRent", "roomRent.icuLimitType", "= 'no_cap'", f"{_ICU} IS NULL", "ICU with no cap cannot include a limit value."),
    _conditional("/hospitalization/ayush", "hospitalization.ayush.limitType", "= 'percent'", _between(_AYUSH), "AYUSH percent limits must have a value between 0 and 100."),
    _conditional("/hospitalization/ayush", "hospitalization.ayush.limitType", "= 'rupee_cap'", _between(_AYUSH, None), "AYUSH rupee caps must be non-negative."),
    _conditional("/hospitalization/ayush", "hospitalization.ayush.limitType", "IN ('up_to_SI', 'not_covered')", f"{_AYUSH} IS NULL", "AYUSH limitType up_to_SI or not_covered must not set limitValue."),
    _conditional("/copayAndZones", "copayAndZones.mandatory", "= 'none'", f"{_COPAY} IS NULL", "Mandatory percent must be null when no copay applies."),
    _conditional("/copayAndZones", "copayAndZones.mandatory", "IN ('age', 'zone', 'network', 'disease_specific')", _between(_COPAY), "Mandatory copays require a percentage between 0 and 100."),
    _conditional("/sublimits/cataract", "sublimits.cataract.type", "= 'percent_of_SI'", _between(_CATARACT), "Cataract percent sublimits must be 0-100."),
    _conditional("/sublimits/cataract", "sublimits.cataract.type", "= 'rupee_cap'", _between(_CATARACT, None), "Cataract rupee caps must be non-negative."),
    _conditional("/sublimits/cataract", "sublimits.cataract.type", "= 'not_applicable'", f"{_CATARACT} IS NULL AND sublimits.cataract.perEye IS NULL", "Not applicable cataract limits cannot have numeric values."),
    Rule("/provenance/sourceDate", "provenance.sourceDate RLIKE '^[0-9]{4}-[0-9]{2}-[0-9]{2}$' AND try_to_date(provenance.sourceDate, 'yyyy-MM-dd') IS NOT NULL", "Source date must follow ISO date format (YYYY-MM-DD)."),
    Rule("/provenance/extractionConfidence", "provenance.extractionConfidence BETWEEN 0 AND 1", "Extraction confidence must be a probability between 0 and 1."),
)


def _plain_rules() -> Iterator[Rule]:
    """Rules whose wording is ours."""
    at = lambda path: "/" + path.replace(".", "/")
    for path, domain in DOMAINS.items():
        listed = ", ".join(f"'{x}'" for x in domain if x)
        yield Rule(at(path), f"{path} IN ({listed})" + (f" OR {path} IS NULL" if None in domain else ""), "must be one of the allowed values")
    for path, least, most, nullable in RANGES:
        bound = f"{path} >= {least}" + (f" AND {path} <= {most}" if most is not None else "")
        yield Rule(at(path), bound + (f" OR {path} IS NULL" if nullable else ""), "must be a number within its range")
    for path in NON_EMPTY:
        yield Rule(at(path), f"length({path}) >= 1", "must not be empty")
    for path in REQUIRED_BOOLEANS:
        yield Rule(at(path), f"{path} IS NOT NULL", "must be boolean")
    no_type = "coalesce(deductible.applies, true) OR (deductible.type IS NULL AND deductible.amount IS NULL)"
    yield Rule("/deductible", no_type, "must not set type or amount where no deductible applies")
    yield Rule("/sumInsured/availableBands", "forall(sumInsured.availableBands, x -> x >= 0)", "must hold amounts of zero or more")
    for path in ("sumInsured.availableBands", "topUpSpecifics.coverageAboveDeductible", "valueAdds.others"):
        yield Rule(at(path), f"size({path}) = size(array_distinct({path}))", "must not have duplicate items")
    yield Rule("/topUpSpecifics/coverageAboveDeductible", "forall(topUpSpecifics.coverageAboveDeductible, x -> x IN ('IPD', 'daycare', 'AYUSH', 'pre_post'))", "must be one of the allowed values")
    items = "forall(sublimits.diseaseSpecific, x -> length(x.name) >= 1 AND x.type IN ('percent', 'rupee_cap') AND x.value >= 0)"
    yield Rule("/sublimits/diseaseSpecific", items, "must hold named sublimits of a known type and a value of zero or more")


RULES = (*STATED, *_plain_rules())


def _objects(kind: T.StructType, path: str = "") -> Iterator[tuple[str, list[str]]]:
    yield path, kind.fieldNames()
    for f in kind.fields:
        if isinstance(f.dataType, T.StructType):
            yield from _objects(f.dataType, f"{path}.{f.name}" if path else f.name)


def _schema() -> T.StructType:
    return T.StructType.fromDDL(types.PRODUCT)


def key_errors(payload: Column) -> Column:
    """Missing and unknown keys of every object in a JSON payload, as array<string>."""
    parts = []
    for path, names in _objects(_schema()):
        where = "(root)" if not path else "/" + path.replace(".", "/")
        keys = F.json_object_keys(F.get_json_object(payload, f"$.{path}") if path else payload)
        needed = F.array(*[F.lit(n) for n in names if path or n not in OPTIONAL])
        missing = _each(F.array_except(needed, keys), f"{where}: must have required property ")
        extra = _each(F.array_except(keys, F.array(*map(F.lit, names))), f"{where}: must not have additional property ")
        parts.append(F.when(keys.isNotNull(), F.concat(missing, extra)).otherwise(F.array().cast("array<string>")))
    return F.concat(*parts)


def _each(keys: Column, text: str) -> Column:
    return F.transform(keys, lambda k: F.concat(F.lit(text), k))


def kept_rules() -> Column:
    """Whether typed product columns keep each of ``RULES``, as array<boolean>."""
    return F.array(*[F.coalesce(F.expr(r.holds), F.lit(False)) for r in RULES])


def value_errors(holds: Column) -> Column:
    """Messages of the broken rules, as array<string>, in the order of ``RULES``. ``holds``: a column of ``kept_rules``."""
    said = F.array(*[F.lit(f"{r.path}: {r.message}") for r in RULES])
    broken = F.filter(F.arrays_zip(holds.alias("holds"), said.alias("said")), lambda x: ~x["holds"])
    return F.when(F.array_contains(holds, False), F.transform(broken, lambda x: x["said"])).otherwise(F.array().cast("array<string>"))


def validate(products: DataFrame, payload: str | None = None) -> DataFrame:
    """Adds errors (array<string>) and valid; with ``payload``, the name of a JSON column, its keys are checked too.

    The rules are a column of their own: Spark compiles them there, and only interprets what a
    lambda's argument holds. Without a payload, ``valid`` is read from them, not from messages.
    """
    judged = products.withColumn("_holds", kept_rules())
    errors = value_errors(F.col("_holds"))
    if payload is None:
        return judged.withColumns({"errors": errors, "valid": ~F.array_contains("_holds", False)}).drop("_holds")
    return judged.withColumn("errors", F.concat(key_errors(F.col(payload)), errors)).withColumn("valid", F.size("errors") == 0).drop("_holds")


def parse_products(records: DataFrame, payload: str) -> DataFrame:
    """A column of JSON products to typed product columns beside it."""
    return records.withColumn("_p", F.from_json(payload, types.PRODUCT)).select(*records.columns, "_p.*")


def evaluation_errors() -> Column:
    """What an evaluation (productRef, scores, overall, version) breaks of its output contract."""
    ratings, grades = ("Bad", "OK", "Good"), ("A+", "A", "B", "C", "D")
    checks = (
        (F.size("scores") >= 1, "/scores: must not be empty"),
        (F.forall("scores", lambda s: s["rating"].isin(*ratings)), "/scores: rating must be one of the allowed values"),
        (F.forall("scores", lambda s: s["score"].between(0, 100)), "/scores: score must be within 0-100"),
        (F.forall("scores", lambda s: F.char_length(s["rationale"]) >= 1), "/scores: rationale must not be empty"),
        (F.col("overall.weightedScore").between(0, 100), "/overall/weightedScore: must be within 0-100"),
        (F.col("overall.grade").isin(*grades), "/overall/grade: must be one of the allowed values"),
        (F.col("version").rlike(r"^\d+\.\d+\.\d+$"), "/version: must be a semantic version"),
        (F.char_length("productRef.insurer") >= 1, "/productRef/insurer: must not be empty"),
        (F.char_length("productRef.planName") >= 1, "/productRef/planName: must not be empty"),
    )
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)) for ok, text in checks]), lambda x: x.isNotNull())


#: Paths whose value may be null though it has no domain or range.
NULLABLE = ("product.variant", "product.uin", "deductible.aggregateApplies", "roomRent.limitValue", "roomRent.icuLimitValue", "hospitalization.ayush.limitValue", "hospitalization.domiciliary.notes", "organDonor.notes", "bonuses.recharge.sameIllnessAllowed", "sublimits.cataract.perEye", "notes")
_SHARE, _AMOUNT, _NULL = {"type": "number", "minimum": 0, "maximum": 100}, {"type": "number", "minimum": 0}, {"type": "null"}
#: Object, deciding field, its values, what then holds of other fields; messages are those of ``STATED``, in its order.
_DECIDED = (
    ("deductible", "applies", (True,), {"type": {"enum": ["per_year", "per_claim"]}, "amount": _AMOUNT}),
    ("roomRent", "limitType", ("percent_of_SI",), {"limitValue": _SHARE}),
    ("roomRent", "limitType", ("rupee_cap",), {"limitValue": _AMOUNT}),
    ("roomRent", "limitType", ("no_cap", "single_private_room", "twin_sharing"), {"limitValue": _NULL}),
    ("roomRent", "icuLimitType", ("percent_of_SI",), {"icuLimitValue": _SHARE}),
    ("roomRent", "icuLimitType", ("rupee_cap",), {"icuLimitValue": _AMOUNT}),
    ("roomRent", "icuLimitType", ("no_cap",), {"icuLimitValue": _NULL}),
    ("hospitalization.ayush", "limitType", ("percent",), {"limitValue": _SHARE}),
    ("hospitalization.ayush", "limitType", ("rupee_cap",), {"limitValue": _AMOUNT}),
    ("hospitalization.ayush", "limitType", ("up_to_SI", "not_covered"), {"limitValue": _NULL}),
    ("copayAndZones", "mandatory", ("none",), {"mandatoryPercent": _NULL}),
    ("copayAndZones", "mandatory", ("age", "zone", "network", "disease_specific"), {"mandatoryPercent": _SHARE}),
    ("sublimits.cataract", "type", ("percent_of_SI",), {"value": _SHARE}),
    ("sublimits.cataract", "type", ("rupee_cap",), {"value": _AMOUNT}),
    ("sublimits.cataract", "type", ("not_applicable",), {"value": _NULL, "perEye": _NULL}),
)


def product_document() -> dict:
    """The rules on products as a JSON Schema document, from the same fixed values."""
    names = {"string": "string", "double": "number", "boolean": "boolean"}
    ranges = {path: (least, most, null) for path, least, most, null in RANGES}

    def leaf(path: str, kind: T.DataType) -> dict:
        if isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, T.StructType):
                fields = {"name": {"type": "string", "minLength": 1}, "type": {"type": "string", "enum": ["percent", "rupee_cap"]}, "value": _AMOUNT}
                return {"type": "array", "items": {"type": "object", "additionalProperties": False, "required": list(fields), "properties": fields}}
            items = {"sumInsured.availableBands": _AMOUNT, "topUpSpecifics.coverageAboveDeductible": {"type": "string", "enum": ["IPD", "daycare", "AYUSH", "pre_post"]}}.get(path, {"type": "string"})
            return {"type": "array", "items": items, "uniqueItems": True}
        least, most, null = ranges.get(path, (None, None, False))
        null = null or path in NULLABLE or None in DOMAINS.get(path, ())
        out: dict = {"type": [names[kind.simpleString()], "null"] if null else names[kind.simpleString()]}
        if path in DOMAINS:
            out["enum"] = list(DOMAINS[path])
        if path in NON_EMPTY:
            out["minLength"] = 1
        out |= {k: v for k, v in (("minimum", least), ("maximum", most)) if v is not None}
        stated = {"product.geography": {"pattern": "^[A-Z]{2,3}$"}, "sumInsured.currency": {"pattern": "^[A-Z]{3}$"}, "provenance.sourceDate": {"format": "date"}, "provenance.extractionConfidence": {"minimum": 0, "maximum": 1}}
        if path in stated:
            out |= stated[path] | {"errorMessage": next(r.message for r in STATED if r.path == "/" + path.replace(".", "/"))}
        return out

    def node(path: str, kind: T.StructType) -> dict:
        below = lambda n: f"{path}.{n}" if path else n
        parts = {f.name: node(below(f.name), f.dataType) if isinstance(f.dataType, T.StructType) else leaf(below(f.name), f.dataType) for f in kind.fields}
        out: dict = {"type": "object", "additionalProperties": False, "required": [n for n in parts if path or n not in OPTIONAL], "properties": parts}
        decided = [{"if": {"properties": {field: {"enum": list(values)}}}, "then": {"properties": then, "errorMessage": said}} for (at, field, values, then), said in zip(_DECIDED, _messages(), strict=True) if at == path]
        if path == "deductible":
            decided.append({"if": {"properties": {"applies": {"const": False}}}, "then": {"properties": {"type": _NULL, "amount": _NULL}}})
        return out | ({"allOf": decided} if decided else {})

    return node("", _schema())


def _messages() -> list[str]:
    return [r.message for r in STATED if r.holds.startswith("coalesce(NOT")]


def evaluation_document() -> dict:
    """The contract of an evaluation as a JSON Schema document."""
    share = {"type": "number", "minimum": 0, "maximum": 100}
    closed = lambda **parts: {"type": "object", "additionalProperties": False, "required": list(parts), "properties": parts}
    text, maybe = {"type": "string", "minLength": 1}, {"type": ["string", "null"]}
    score = closed(parameter={"type": "string", "enum": list(WEIGHTS)}, rating={"type": "string", "enum": ["Bad", "OK", "Good"]}, score=share, rationale=text)
    overall = closed(weightedScore=share, grade={"type": "string", "enum": ["D", "C", "B", "A", "A+"]}, notes=maybe)
    return closed(productRef=closed(insurer=text, planName=text, variant=maybe), scores={"type": "array", "items": score}, overall=overall, version={"type": "string", "pattern": r"^v?[0-9]+\.[0-9]+\.[0-9]+$"})
