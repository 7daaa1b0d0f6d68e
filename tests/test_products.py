"""Golden values, boundaries and properties of normalising, validation and scoring."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater import types
from tidewater.functions.numbers import short_number, to_integer, to_number, two_places
from tidewater.operators.normalizing import normalize
from tidewater.operators.scoring import PARAMETERS, WEIGHTS, grade, rate, score_products
from tidewater.operators.validation import RULES, evaluation_errors, parse_products, validate
from tidewater.queries.products import _BROKEN, _TOP_UP_CHANGES, changed, evaluations

RAW = {
    "product": {"insurer": "Harbour Mutual", "planName": "Anchor", "policyType": "Floater", "isTopUp": False, "geography": "IN"},
    "sumInsured": {"baseSI": "Rs 750,000", "bands": ["1000000", "500000"]},
    "roomRent": {"text": "rooms: 1 % of SI a day; one class higher, upgrade optional", "icuText": "intensive care 2% of the sum", "addonInfo": "a waiver can be bought", "upgradeOption": False},
    "hospitalization": {"daycare": "all known procedures", "preHospDays": "60", "postHospDays": "120", "domiciliary": {"covered": True, "minDays": "2"}, "ayushText": "paid up to SI"},
    "bonuses": {"ncbText": "adds 50% for each year without claims, no impact if there is one", "rechargeText": "unlimited, for the same illness too"},
    "waitingPeriods": {"initialDays": "30 days", "specificAilmentsMonths": "24", "pedMonths": "36", "reductionSpecific": True, "reductionPed": False},
    "sublimits": {"cataractText": "no sub-limit on eyes"},
    "provenance": {"sourceType": "broker_portal", "sourceName": "Leaflet", "sourceDate": "2024-11-30", "extractionConfidence": 0.4},
    "notes": ["By hand"],
}


def raw(spark, **changes):
    record = json.loads(json.dumps(RAW))
    for path, value in changes.items():
        part, name = path.split("__")
        record.setdefault(part, {})[name] = value
    return spark.createDataFrame([(json.dumps(record),)], "payload string").select(F.from_json("payload", types.RAW).alias("r")).select("r.*")


def test_raw_facts_to_a_valid_scored_product(spark):
    r = validate(score_products(normalize(raw(spark)))).first()
    assert r.valid and r.overall.weightedScore == 73.8 and r.overall.grade == "B" and r.overall.notes == "By hand"
    assert [s.score for s in r.scores] == [45, 80, 100, 100, 95, 95, 100, 100, 100, 100, 60]
    assert (r.roomRent.limitType, r.roomRent.limitValue, r.roomRent.proportionateDeduction) == ("percent_of_SI", 1.0, "waived_with_addon")
    assert r.sumInsured.availableBands == [500000, 750000, 1000000] and r.hospitalization.ayush.limitType == "up_to_SI"
    assert (r.bonuses.ncb.accrualPerYearPercent, r.bonuses.ncb.maxCapPercent, r.bonuses.ncb.claimImpact) == (50, 100, "no_impact")


def test_normalised_columns_have_the_product_schema(spark):
    made = normalize(raw(spark)).schema
    wanted = parse_products(spark.createDataFrame([("{}",)], "payload string"), "payload").drop("payload").schema
    assert [(f.name, f.dataType.simpleString()) for f in made] == [(f.name, f.dataType.simpleString()) for f in wanted]


@pytest.mark.parametrize(
    ("changes", "path", "value"),
    [
        ({"roomRent__text": "No room rent cap"}, "roomRent.limitType", "no_cap"),
        ({"roomRent__text": "No cap on room rent"}, "roomRent.limitType", "percent_of_SI"),
        ({"roomRent__text": "% of SI, Rs 500"}, "roomRent.limitValue", None),
        ({"roomRent__text": "two persons"}, "roomRent.limitValue", None),
        ({"roomRent__text": "Rs. 5,000 a day"}, "roomRent.limitValue", 0.5),
        ({"roomRent__text": "up to 2 lakh"}, "roomRent.limitValue", 2.0),
        ({"hospitalization__ayushText": "50% of sum insured"}, "hospitalization.ayush.limitType", "up_to_SI"),
        ({"hospitalization__ayushText": "", "hospitalization__ayushLimitValue": "25000"}, "hospitalization.ayush.limitType", "rupee_cap"),
        ({"hospitalization__ayushText": "40%"}, "hospitalization.ayush.limitValue", 40.0),
        ({"bonuses__ncbText": "10% max 50%"}, "bonuses.ncb.maxCapPercent", 50.0),
        ({"bonuses__ncbText": "reduced, protected"}, "bonuses.ncb.claimImpact", "reduces"),
        ({"bonuses__rechargeText": "one-time"}, "bonuses.recharge.type", "once"),
        ({"hospitalization__daycare": "List"}, "hospitalization.daycare", "limited_list"),
        ({"hospitalization__daycare": ""}, "hospitalization.daycare", "all_listed"),
        ({"copay__mandatoryType": "Disease", "copay__mandatoryPercent": "10%"}, "copayAndZones.mandatory", "disease_specific"),
        ({"copay__mandatoryType": "other", "copay__mandatoryPercent": "10"}, "copayAndZones.mandatoryPercent", None),
        ({"sublimits__cataractText": "lakhs"}, "sublimits.cataract.type", "not_applicable"),
        ({"waitingPeriods__initialDays": "15.5"}, "waitingPeriods.initialDays", 16.0),
        ({"organDonor__notes": "Not covered"}, "organDonor.covered", False),
        ({"deductible__applies": True, "deductible__amount": "5 lakh"}, "deductible.aggregateApplies", True),
    ],
)
def test_text_ladders(spark, changes, path, value):
    assert normalize(raw(spark, **changes)).select(F.col(path)).first()[0] == value


def test_numbers(spark):
    texts = ["rs. 5,000 per day", "5 lakh", "1.2.3", ".", "", "-5", "1e5", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i")
    assert [r[0] for r in frame.select(to_number(F.col("t"))).collect()] == [0.5, 5, 1.2, None, None, 5, 15, None]
    values = spark.createDataFrame([(-2.5,), (2.5,), (-5.0,)], "x double")
    assert [r[0] for r in values.select(to_integer(F.lit(None).cast("string"), F.col("x"))).collect()] == [-2, 3, -5]
    shown = spark.createDataFrame([(75000.0,), (1e7,), (0.5,), (12345678.5,), (None,)], "x double")
    assert [r[0] for r in shown.select(short_number(F.col("x"))).collect()] == ["75000", "10000000", "0.5", "12345678.5", "null"]
    assert spark.range(1).select(two_places(F.lit(83.43333333333334))).first()[0] == 83.43


def test_grades_and_ratings_at_their_bounds(spark):
    at = [90, 89.999, 80, 79.99, 70, 69.99, 60, 59.99, 0]
    frame = spark.createDataFrame([(float(x),) for x in at], "x double")
    assert [r[0] for r in frame.select(grade(F.col("x"))).collect()] == ["A+", "A", "A", "B", "B", "C", "C", "D", "D"]
    assert [r[0] for r in frame.select(rate(F.col("x"))).collect()] == ["Good", "Good", "Good", "OK", "OK", "OK", "OK", "Bad", "Bad"]


def scores(spark, changes):
    rows = spark.createDataFrame([(changed(c),) for c in changes], "payload string")
    return [{s.parameter: s for s in r.scores} for r in score_products(parse_products(rows, "payload")).collect()]


@pytest.mark.parametrize(
    ("parameter", "cases"),
    [
        ("pre_post", [({"hospitalization.preHospDays": a, "hospitalization.postHospDays": b}, s) for a, b, s in ((60, 180, 100), (60, 179, 80), (60, 90, 80), (59, 90, 70), (45, 90, 70), (45, 89, 60), (44, 60, 40), (30, 60, 40), (29, 60, 30), (30, 59, 30))]),
        ("room_rent", [({"roomRent.limitType": "percent_of_SI", "roomRent.limitValue": v, "roomRent.icuLimitType": "percent_of_SI", "roomRent.icuLimitValue": i, "roomRent.proportionateDeduction": "applies"}, s) for v, i, s in ((1, 1, 30), (2, 1, 55), (5, 2, 75), (10, 1, 70), (None, 1, 30))]),
        ("ncb", [({"bonuses.ncb": {"accrualPerYearPercent": a, "maxCapPercent": c, "claimImpact": i}}, s) for a, c, i, s in ((50, 100, None, 90), (50, 200, None, 100), (49, 100, None, 79.33), (20, 40, None, 60), (19, 40, None, 40), (0, 0, "reduces", 0), (None, None, "no_impact", 5))]),
        ("cataract", [({"sublimits.cataract": {"type": "rupee_cap", "value": v, "perEye": False}}, s) for v, s in ((200000, 70), (199999, 50), (100000, 50), (99999, 20))] + [({"sublimits.cataract": {"type": "percent_of_SI", "value": v, "perEye": True}}, s) for v, s in ((25, 80), (20, 70), (10, 50), (9, 30))]),
        ("copay", [({"copayAndZones.mandatory": k, "copayAndZones.mandatoryPercent": p}, s) for k, p, s in (("age", 10, 70), ("age", 11, 40), ("network", 19, 40), ("network", 20, 20), ("zone", None, 70))]),
        ("waiting_periods", [({"waitingPeriods": {"initialDays": a, "specificAilmentsMonths": b, "pedMonths": c, "reductionOptions": {"specificAilments": False, "ped": p}}}, s) for a, b, c, p, s in ((30, 24, 36, False, 90), (30, 36, 48, False, 70), (31, 24, 36, False, 40), (30, 24, 49, False, 40), (31, 37, 49, True, 40))]),
        ("domiciliary", [({"hospitalization.domiciliary": {"covered": c, "minDays": d, "negativeListPresent": n, "notes": None}}, s) for c, d, n, s in ((True, 3, False, 95), (True, 4, False, 80), (True, None, True, 60), (False, 1, False, 0))]),
        ("recharge", [({"bonuses.recharge": {"type": t, "sameIllnessAllowed": a}}, s) for t, a, s in (("unlimited", None, 90), ("twice", True, 85), ("once", False, 60), ("na", None, 0))]),
        ("ayush", [({"hospitalization.ayush": {"covered": True, "limitType": t, "limitValue": v}}, s) for t, v, s in (("percent", 50, 80), ("percent", 25, 40), ("rupee_cap", 500000, 40), ("up_to_SI", None, 100), ("not_covered", None, 0))]),
    ],
)
def test_score_boundaries(spark, parameter, cases):
    found = [round(s[parameter].score, 2) for s in scores(spark, [c for c, _ in cases])]
    assert found == [s for _, s in cases]


def test_sample_products(spark):
    rows = spark.createDataFrame([(changed({}),), (changed(_TOP_UP_CHANGES),)], "payload string")
    base, top = validate(score_products(parse_products(rows, "payload")), "payload").withColumn("broken", evaluation_errors()).collect()
    assert (base.overall.weightedScore, base.overall.grade, base.valid, base.broken) == (87.8, "A", True, [])
    assert (top.overall.weightedScore, top.overall.grade, top.valid, top.broken) == (83.43, "A", True, [])
    assert top.scores[0].rationale == "No cap on room rent. ICU coverage generous. Proportionate deduction not applicable."
    assert top.scores[8].rationale == "Cataract rupee cap at 75000 per eye."
    assert top.overall.notes == "Zone based copay applies outside Tier-A cities. | Mandatory copay of 10% based on zone."


def test_every_stated_rule_is_broken_once(spark):
    messages = {m for _, _, m in _BROKEN if m}
    from tidewater.operators.validation import STATED

    stated = {f"{r.path}: {r.message}" for r in STATED}
    assert stated - messages == {"/sublimits/cataract: Cataract rupee caps must be non-negative."}
    assert len({(r.path, r.message, r.holds) for r in RULES}) == len(RULES)


def test_properties_of_scores(spark):
    assert abs(sum(WEIGHTS.values()) - 1) < 1e-9 and [p.name for p in PARAMETERS] == list(WEIGHTS)
    rows = evaluations(spark, "/root/testdata/sf0.001").select("scores", "overall").collect()
    assert all(0 <= s.score <= 100 and s.rationale == s.rationale.strip() != "" for r in rows for s in r.scores)
    for r in rows:
        total = 0.0
        for s in r.scores:
            total += s.score * WEIGHTS[s.parameter]
        assert abs(r.overall.weightedScore - total) <= 0.005 + 1e-9


def test_scoring_needs_no_shuffle_and_no_python(spark):
    plan = evaluations(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="0123456789., -eRs", max_size=12))
def test_number_reading_is_the_prefix_rule(spark, text):
    import re

    digits = re.match(r"\d+\.?\d*|\.\d+", re.sub(r"[^0-9.]", "", text))
    expected = float(digits.group()) if digits and digits.group() != "." else None
    assert spark.createDataFrame([(text,)], "t string").select(to_number(F.col("t"))).first()[0] == expected
