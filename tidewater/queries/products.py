"""Normalising, validating and scoring products that are derived from the part table."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater import types
from tidewater.functions.numbers import card_number, first_dash_to_space, percent_label, to_integer, to_number, two_places
from tidewater.operators.json_schema import validate_json
from tidewater.operators.normalizing import normalize
from tidewater.operators.scoring import PARAMETERS, WEIGHTS, fields_read, grade, judge_products, rate, score_products, weighted_sum
from tidewater.operators.validation import evaluation_errors, parse_products, product_document, validate
from tidewater.queries.base import Group, spread, table

group = Group()

_ROOMS = ("No room rent cap", "Single private AC room", "Twin sharing", "#% of SI", "Rs 5,000 per day", "Up to 2 lakh", "No cap on room rent", "% of SI, upgrade optional")
_ICUS = ("No cap", "#% of SI", "₹ 10000", None, "as per plan")
_ADDONS = ("Waiver available", None, "none")
_DAYCARES = ("All procedures covered", "All listed", "Not covered", "Limited", "List of 140", "")
_AYUSHES = ("AYUSH up to SI", "50% of sum insured", "#0% only", "Not covered", "capped", "", None)
_AYUSH_VALUES = (None, "25000", "40", "Rs 60,000")
_NCBS = ("50% up to 150%", "10% max 50%", "25% per year, reduced after claim", "protected", "No impact", "60% maximum 200%, bonus protected", "", None)
_RECHARGES = ("Unlimited, same illness too", "twice a year", "Once", "one-time", "none", None)
_CATARACTS = ("", "No sub-limit", "25% per eye", "20%", "10 %", "5% of SI per eye", "Rs 40000 per eye", "lakhs", None)
_COPAYS = ("None", "AGE", "zone", "network", "disease", "other", None)
_HOWS = ("aggregate_year", "per_claim", "per_year", None)
_AIRS = ("covered", "optional", "maybe", None)
_DONORS = ("Not covered for donors", "", None)
_INITIAL, _SPECIFIC, _PED = ("30 days", "45", None, "15.5"), ("24", "36", None), ("36", "48", "60", None)


def _pick(values: tuple, index: str) -> str:
    """Spark SQL for one of several texts; ``#`` stands for a digit of the part's key."""
    items = ", ".join("cast(null as string)" if v is None else f"'{v}'" for v in values)
    return f"replace(element_at(array({items}), cast({index} % {len(values)} + 1 as int)), '#', cast(p_partkey % 7 as string))"


def raw_products(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Raw facts about one product for each part, with p_partkey. ``dealt``: the rows of the table, a compact file, are spread over all cores first."""
    k, s = "p_partkey", "p_size"
    structs = {
        "product": f"named_struct('insurer', p_brand, 'planName', p_name, 'variant', cast(null as string), 'uin', cast(null as string), 'policyType', if({k} % 2 = 0, 'Floater', 'Other'), 'isTopUp', {k} % 3 = 0, 'geography', if({k} % 11 = 0, 'in', cast(null as string)))",
        "sumInsured": f"named_struct('baseSI', if({k} % 10 = 9, cast(null as string), concat('Rs ', ({k} % 10 + 1) * 100000)), 'currency', cast(null as string), 'bands', array('250000', cast(({k} % 4 + 1) * 250000 as string), 'n/a', '1000000'), 'unlimitedOneClaim', cast(null as boolean))",
        "deductible": f"named_struct('applies', CASE {k} % 5 WHEN 0 THEN true WHEN 1 THEN false END, 'type', if({k} % 2 = 0, 'per_claim', cast(null as string)), 'amount', if({k} % 7 = 0, cast(null as string), cast({k} % 7 * 50000 as string)), 'aggregateApplies', cast(null as boolean))",
        "roomRent": f"named_struct('text', {_pick(_ROOMS, k)}, 'icuText', {_pick(_ICUS, k)}, 'addonInfo', {_pick(_ADDONS, k)}, 'upgradeOption', {k} % 6 = 0)",
        "hospitalization": f"named_struct('inpatientCovered', if({k} % 13 = 0, false, cast(null as boolean)), 'daycare', {_pick(_DAYCARES, s)}, 'preHospDays', cast(15 * ({s} % 6) as string), 'postHospDays', cast(30 * ({s} % 8) as string), "
        f"'domiciliary', named_struct('covered', {s} % 3 <> 0, 'minDays', cast({s} % 6 as string), 'negativeListPresent', {s} % 5 = 0, 'notes', cast(null as string)), 'ayushText', {_pick(_AYUSHES, s)}, 'ayushLimitValue', {_pick(_AYUSH_VALUES, s)})",
        "transport": f"named_struct('roadAmbulanceLimit', concat({k} % 5 * 1000, ' only'), 'airAmbulance', {_pick(_AIRS, k)}, 'airAmbulanceLimit', cast(null as string))",
        "organDonor": f"named_struct('covered', cast(null as boolean), 'notes', {_pick(_DONORS, k)})",
        "bonuses": f"named_struct('ncbText', {_pick(_NCBS, s)}, 'rechargeText', {_pick(_RECHARGES, s)})",
        "waitingPeriods": f"named_struct('initialDays', {_pick(_INITIAL, s)}, 'specificAilmentsMonths', {_pick(_SPECIFIC, s)}, 'pedMonths', {_pick(_PED, k)}, 'reductionSpecific', {k} % 2 = 0, 'reductionPed', cast(null as boolean))",
        "copay": f"named_struct('mandatoryType', {_pick(_COPAYS, k)}, 'mandatoryPercent', cast({s} as string), 'optionalAvailable', {k} % 2 = 1)",
        "sublimits": f"named_struct('cataractText', {_pick(_CATARACTS, s)}, 'diseaseSpecific', array(named_struct('name', p_type, 'type', 'percent', 'value', '10'), named_struct('name', 'other', 'type', 'rs', 'value', 'none')))",
        "valueAdds": "named_struct('annualHealthCheckup', true, 'eConsult', cast(null as boolean), 'wellnessBenefits', cast(null as boolean), 'others', array(p_brand))",
        "topUpSpecifics": f"named_struct('howDeductibleApplies', {_pick(_HOWS, k)}, 'coverageList', slice(array('IPD', 'pre_post', 'daycare', 'dental', 'AYUSH'), 1, cast({k} % 5 + 1 as int)), 'roomRule', 'same_as_base', 'recharge', if({k} % 2 = 0, 'available', 'yes'), 'ncb', cast(null as string))",
        "provenance": f"named_struct('sourceType', 'policy_pdf', 'sourceName', p_name, 'sourceDate', if({k} % 9 = 0, '2025-13-01', '2025-01-15'), 'extractionConfidence', if({k} % 2 = 0, 0.75D, cast(null as double)))",
        "notes": "array(p_type, ' by hand ', p_type, '')",
    }
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size")
    return (spread(part) if dealt else part).select("p_partkey", *[F.expr(sql).alias(name) for name, sql in structs.items()])


def products(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    return normalize(raw_products(spark, sf_dir, dealt))


def evaluations(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    return score_products(products(spark, sf_dir, dealt))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw facts to graded, validated products: narrow all the way, no shuffle."""
    scored = validate(evaluations(spark, sf_dir))
    return scored.select("p_partkey", "productRef.insurer", "productRef.planName", "overall.weightedScore", "overall.grade", "valid", F.size("errors").alias("n_errors"))


# The same rules once more, written for DuckDB from the rules' descriptions.


def _choose(values: tuple, index: str) -> str:
    items = ", ".join("NULL" if v is None else "'" + v + "'" for v in values)
    return f"replace([{items}][{index} % {len(values)} + 1], '#', (p_partkey % 7)::VARCHAR)"


def _num(x: str) -> str:
    return f"try_cast(nullif(regexp_extract(regexp_replace({x}, '[^0-9.]', '', 'g'), '^(\\d+\\.?\\d*|\\.\\d+)', 1), '') AS DOUBLE)"


def _pct(x: str) -> str:
    return f"try_cast(nullif(regexp_extract({x}, '(\\d{{1,3}})\\s*%', 1), '') AS DOUBLE)"


_FACTS = f"""
facts AS (
  SELECT *, p_partkey AS k, p_size AS s, lower({_choose(_ROOMS, "p_partkey")}) AS room, coalesce(lower({_choose(_ICUS, "p_partkey")}), '') AS icu, coalesce(lower({_choose(_ADDONS, "p_partkey")}), '') AS addon,
    lower({_choose(_DAYCARES, "p_size")}) AS day, coalesce(lower({_choose(_AYUSHES, "p_size")}), '') AS ay, {_num(_choose(_AYUSH_VALUES, "p_size"))} AS ayv,
    coalesce(lower({_choose(_NCBS, "p_size")}), '') AS nc, coalesce(lower({_choose(_RECHARGES, "p_size")}), '') AS re, coalesce(lower({_choose(_CATARACTS, "p_size")}), '') AS ca,
    coalesce(lower({_choose(_COPAYS, "p_partkey")}), 'none') AS co, {_choose(_HOWS, "p_partkey")} AS how, {_choose(_AIRS, "p_partkey")} AS air, nullif({_choose(_DONORS, "p_partkey")}, '') AS donor,
    {_choose(_INITIAL, "p_size")} AS wi, {_choose(_SPECIFIC, "p_size")} AS ws, {_choose(_PED, "p_partkey")} AS wp FROM part),
steps AS (
  SELECT *, p_partkey % 3 = 0 AS topup,
    CASE WHEN room LIKE '%no room%' AND room LIKE '%cap%' THEN 'no_cap' WHEN room LIKE '%\\%%' ESCAPE '\\' THEN CASE WHEN regexp_matches(room, '\\d\\s*%') THEN 'percent_of_SI' END
      WHEN room LIKE '%single%' AND room LIKE '%private%' THEN 'single_private_room' WHEN room LIKE '%twin%' THEN 'twin_sharing'
      WHEN regexp_matches(room, 'rs|₹|lakh|lac|crore') AND {_num("room")} IS NOT NULL THEN 'rupee_cap' END AS room_step,
    CASE WHEN contains(icu, 'no cap') THEN 'no_cap' WHEN contains(icu, '%') THEN 'percent_of_SI' WHEN {_num("icu")} IS NOT NULL THEN 'rupee_cap' ELSE 'percent_of_SI' END AS icu_type,
    CASE WHEN ay = '' AND ayv IS NULL OR contains(ay, 'not covered') THEN 'not_covered' WHEN regexp_matches(ay, 'up ?to si|sum insured') THEN 'up_to_SI' WHEN contains(ay, '%') THEN 'percent'
      WHEN ayv IS NOT NULL THEN 'rupee_cap' ELSE 'up_to_SI' END AS ayush_type,
    CASE WHEN contains(re, 'unlimited') THEN 'unlimited' WHEN contains(re, 'twice') THEN 'twice' WHEN regexp_matches(re, 'once|one-time|one time') THEN 'once' ELSE 'na' END AS recharge_type,
    CASE WHEN ca = '' OR regexp_matches(ca, 'no sub-limit|not applicable') THEN 'not_applicable' WHEN contains(ca, '%') THEN 'percent_of_SI' WHEN {_num("ca")} IS NOT NULL THEN 'rupee_cap' ELSE 'not_applicable' END AS cataract_type,
    CASE co WHEN 'disease' THEN 'disease_specific' WHEN 'age' THEN 'age' WHEN 'zone' THEN 'zone' WHEN 'network' THEN 'network' ELSE 'none' END AS mandatory,
    CASE p_partkey % 5 WHEN 0 THEN true WHEN 1 THEN false ELSE p_partkey % 3 = 0 END AS applies FROM facts),
norm AS (
  SELECT p_partkey, p_brand, p_name, p_type, k, s, topup,
    CASE WHEN k % 11 = 0 THEN 'in' ELSE 'IN' END AS geography, CASE WHEN k % 2 = 0 THEN 'Floater' ELSE 'Individual' END AS policy_type,
    CASE WHEN k % 10 = 9 THEN 500000 ELSE (k % 10 + 1) * 100000 END::DOUBLE AS base,
    applies, CASE WHEN applies THEN CASE WHEN k % 2 = 0 THEN 'per_claim' ELSE 'per_year' END END AS deductible_type, CASE WHEN applies AND k % 7 <> 0 THEN (k % 7 * 50000)::DOUBLE END AS deductible_amount,
    CASE WHEN applies AND k % 2 = 1 THEN true END AS aggregate_applies,
    coalesce(room_step, 'percent_of_SI') AS room_type, CASE room_step WHEN 'percent_of_SI' THEN try_cast(regexp_extract(room, '(\\d+(?:\\.\\d+)?)\\s*%', 1) AS DOUBLE) WHEN 'rupee_cap' THEN {_num("room")} END AS room_value,
    icu_type, CASE WHEN icu_type = 'rupee_cap' THEN {_num("icu")} WHEN icu_type = 'percent_of_SI' THEN try_cast(nullif(regexp_extract(icu, '(\\d+(?:\\.\\d+)?)\\s*%', 1), '') AS DOUBLE) END AS icu_value,
    CASE WHEN contains(addon, 'waiver') THEN 'waived_with_addon' WHEN room_step IS NULL OR room_step = 'no_cap' THEN 'not_applicable' ELSE 'applies' END AS proportionate,
    k % 6 = 0 OR contains(room, 'upgrade optional') OR contains(room, 'optional upgrade') AS modifier,
    CASE WHEN k % 13 = 0 THEN 'not_covered' ELSE 'covered' END AS inpatient,
    CASE WHEN contains(day, 'all listed') THEN 'all_listed' WHEN contains(day, 'all') AND contains(day, 'procedures') THEN 'all' WHEN contains(day, 'not covered') THEN 'not_covered'
      WHEN contains(day, 'limited') OR contains(day, 'list') THEN 'limited_list' ELSE 'all_listed' END AS daycare,
    (15 * (s % 6))::DOUBLE AS pre, (30 * (s % 8))::DOUBLE AS post, s % 3 <> 0 AS home, (s % 6)::DOUBLE AS home_days, s % 5 = 0 AS home_negative,
    ayush_type, CASE ayush_type WHEN 'percent' THEN coalesce(ayv, {_num("ay")}) WHEN 'rupee_cap' THEN ayv END AS ayush_value,
    (k % 5 * 1000)::DOUBLE AS road, CASE WHEN air IN ('covered', 'optional') THEN air ELSE 'not_covered' END AS air, coalesce(NOT contains(lower(donor), 'not covered'), true) AS donor_covered, donor AS donor_notes,
    {_pct("nc")} AS accrual, coalesce(try_cast(nullif(regexp_extract(nc, 'max(?:imum)?\\s*(\\d{{1,3}})\\s*%', 1), '') AS DOUBLE), 2 * {_pct("nc")}) AS cap,
    CASE WHEN contains(nc, 'reduce') THEN 'reduces' WHEN contains(nc, 'no impact') OR contains(nc, 'protected') THEN 'no_impact' END AS impact,
    recharge_type, CASE WHEN recharge_type <> 'na' THEN contains(re, 'same illness') END AS same_illness,
    coalesce(floor({_num("wi")} + 0.5), 30)::DOUBLE AS initial_days, coalesce(floor({_num("ws")} + 0.5), 24)::DOUBLE AS specific_months, coalesce(floor({_num("wp")} + 0.5), 48)::DOUBLE AS ped_months, k % 2 = 0 AS shorter,
    mandatory, CASE WHEN mandatory <> 'none' THEN s::DOUBLE END AS copay_percent, k % 2 = 1 AS copay_optional,
    cataract_type, CASE cataract_type WHEN 'percent_of_SI' THEN {_pct("ca")} WHEN 'rupee_cap' THEN {_num("ca")} END AS cataract_value, CASE WHEN cataract_type <> 'not_applicable' THEN contains(ca, 'per eye') END AS per_eye,
    CASE WHEN topup THEN how END AS top_how, list_filter(['IPD', 'pre_post', 'daycare', 'dental', 'AYUSH'][1:(k % 5 + 1)], lambda x: x <> 'dental') AS covers, CASE WHEN topup THEN 'same_as_base' END AS room_rule,
    CASE WHEN k % 2 = 0 THEN 'available' ELSE 'na' END AS top_recharge, CASE WHEN k % 9 = 0 THEN '2025-13-01' ELSE '2025-01-15' END AS source_date, CASE WHEN k % 2 = 0 THEN 0.75 ELSE 0.5 END::DOUBLE AS confidence,
    p_type || ' | by hand' AS notes
  FROM steps)"""


def _js(x: str, missing: str) -> str:
    return f"coalesce(CASE WHEN {x} = floor({x}) THEN {x}::BIGINT::VARCHAR ELSE {x}::VARCHAR END, '{missing}')"


_SCORED = f"""
scored AS (
  SELECT *,
    greatest(0, least(100, CASE room_type WHEN 'no_cap' THEN 100 WHEN 'single_private_room' THEN 75 WHEN 'twin_sharing' THEN 60
      WHEN 'rupee_cap' THEN CASE WHEN room_value IS NULL OR room_value = 0 THEN 40 ELSE greatest(30, least(80, 40 + room_value / base * 40)) END
      ELSE CASE WHEN coalesce(room_value, 0) <= 1 THEN 30 ELSE greatest(30, least(70, 50 + (room_value - 1) * 5)) END END
      + CASE WHEN icu_type = 'no_cap' OR icu_type = 'percent_of_SI' AND coalesce(icu_value, 0) >= 2 THEN 5 ELSE 0 END + CASE WHEN proportionate <> 'applies' THEN 10 ELSE 0 END))::DOUBLE AS room_rent,
    CASE WHEN pre >= 60 AND post >= 180 THEN 100 WHEN pre >= 60 AND post >= 90 THEN 80 WHEN pre >= 45 AND post >= 90 THEN 70 WHEN pre >= 45 AND post >= 60 THEN 60 WHEN pre >= 30 AND post >= 60 THEN 40 ELSE 30 END::DOUBLE AS pre_post,
    CASE daycare WHEN 'limited_list' THEN 60 WHEN 'not_covered' THEN 0 ELSE 100 END::DOUBLE AS daycare_score,
    CASE ayush_type WHEN 'not_covered' THEN 0 WHEN 'up_to_SI' THEN 100 WHEN 'percent' THEN least(80, greatest(0, coalesce(ayush_value, 0) / 50 * 80)) ELSE least(80, greatest(0, coalesce(ayush_value, 0) / base * 80)) END::DOUBLE AS ayush,
    CASE WHEN NOT home THEN 0 WHEN home_negative THEN 60 WHEN home_days <= 3 THEN 95 ELSE 80 END::DOUBLE AS domiciliary,
    greatest(0, least(100, CASE WHEN coalesce(accrual, 0) >= 50 AND coalesce(cap, 0) >= 100 THEN least(100, 90 + least((cap - 100) / 50 * 5, 10)) WHEN coalesce(accrual, 0) >= 20 THEN 60 + least(1, (accrual - 20) / 30) * 20
      WHEN coalesce(accrual, 0) > 0 THEN 40 ELSE 0 END + CASE impact WHEN 'no_impact' THEN 5 WHEN 'reduces' THEN -10 ELSE 0 END))::DOUBLE AS ncb,
    CASE recharge_type WHEN 'unlimited' THEN 90 + 10 * same_illness::INT WHEN 'twice' THEN 75 + 10 * same_illness::INT WHEN 'once' THEN 60 + 15 * same_illness::INT ELSE 0 END::DOUBLE AS recharge,
    CASE WHEN mandatory = 'none' THEN 100 ELSE CASE WHEN coalesce(copay_percent, 0) <= 10 THEN 70 ELSE 40 END - CASE WHEN mandatory = 'network' AND copay_percent >= 20 THEN 20 ELSE 0 END END::DOUBLE AS copay,
    CASE cataract_type WHEN 'not_applicable' THEN 100 WHEN 'percent_of_SI' THEN CASE WHEN cataract_value >= 25 THEN 80 WHEN cataract_value >= 20 THEN 70 WHEN cataract_value >= 10 THEN 50 ELSE 30 END
      ELSE CASE WHEN cataract_value / base >= 0.2 THEN 70 WHEN cataract_value / base >= 0.1 THEN 50 ELSE 20 END END::DOUBLE AS cataract,
    greatest(0, least(100, CASE WHEN initial_days <= 30 AND specific_months <= 24 AND ped_months <= 36 THEN 90 WHEN initial_days <= 30 AND specific_months <= 36 AND ped_months <= 48 THEN 70 ELSE 50 END
      - CASE WHEN initial_days > 30 THEN 10 ELSE 0 END - CASE WHEN ped_months > 48 THEN 10 ELSE 0 END + CASE WHEN shorter THEN 10 ELSE 0 END))::DOUBLE AS waiting_periods,
    CASE WHEN NOT (topup OR applies) THEN 60 ELSE least(100, CASE top_how WHEN 'aggregate_year' THEN 90 WHEN 'per_claim' THEN 70 ELSE 60 END + CASE WHEN list_has_all(covers, ['IPD', 'pre_post', 'daycare']) THEN 5 ELSE 0 END
      + CASE WHEN list_contains(covers, 'AYUSH') THEN 3 ELSE 0 END + CASE WHEN room_type IN ('no_cap', 'single_private_room') THEN 5 ELSE 0 END) END::DOUBLE AS topup_friendliness,
    CASE room_type WHEN 'no_cap' THEN 'No cap on room rent.' WHEN 'single_private_room' THEN 'Single private room cap.' WHEN 'twin_sharing' THEN 'Twin sharing cap.' WHEN 'rupee_cap' THEN 'Rupee cap at ' || {_js("room_value", "unspecified")} || '.'
      ELSE 'Room limit at ' || {_js("room_value", "?")} || '% of sum insured.' END || CASE WHEN icu_type = 'no_cap' OR icu_type = 'percent_of_SI' AND coalesce(icu_value, 0) >= 2 THEN ' ICU coverage generous.' ELSE '' END
      || CASE proportionate WHEN 'waived_with_addon' THEN ' Proportionate deduction waiver available.' WHEN 'not_applicable' THEN ' Proportionate deduction not applicable.' ELSE '' END AS room_rent_said,
    'Pre ' || pre::BIGINT || ' days / Post ' || post::BIGINT || ' days.' || CASE WHEN pre >= 60 AND post >= 180 THEN ' Extended pre/post cover.' WHEN pre >= 60 AND post >= 90 THEN ' Strong pre/post cover.' ELSE '' END AS pre_post_said,
    CASE daycare WHEN 'limited_list' THEN 'Limited daycare list.' WHEN 'not_covered' THEN 'Daycare not covered.' ELSE 'All daycare procedures covered.' END AS daycare_said,
    CASE ayush_type WHEN 'not_covered' THEN 'AYUSH not covered.' WHEN 'up_to_SI' THEN 'AYUSH up to sum insured.' WHEN 'percent' THEN 'AYUSH limit at ' || {_js("ayush_value", "0")} || '% of sum insured.' ELSE 'AYUSH rupee cap at ' || {_js("ayush_value", "null")} || '.' END AS ayush_said,
    CASE WHEN NOT home THEN 'Domiciliary not covered.' WHEN home_negative THEN 'Domiciliary covered with notable exclusions.' WHEN home_days <= 3 THEN 'Domiciliary with low min days and no negative list.' ELSE 'Domiciliary covered with minimum ' || home_days::BIGINT || ' days.' END AS domiciliary_said,
    CASE WHEN coalesce(accrual, 0) >= 50 AND coalesce(cap, 0) >= 100 THEN 'NCB accrues ' || accrual::BIGINT || '% per year up to ' || cap::BIGINT || '%.' WHEN coalesce(accrual, 0) >= 20 THEN 'Moderate NCB accrual of ' || accrual::BIGINT || '%.'
      WHEN coalesce(accrual, 0) > 0 THEN 'Low NCB accrual of ' || accrual::BIGINT || '%.' ELSE 'No NCB accrual.' END || CASE impact WHEN 'no_impact' THEN ' Bonus protected after claims.' WHEN 'reduces' THEN ' NCB reduces post claim.' ELSE '' END AS ncb_said,
    CASE recharge_type WHEN 'unlimited' THEN CASE WHEN same_illness THEN 'Unlimited recharge covering same illness.' ELSE 'Unlimited recharge without same illness support.' END WHEN 'twice' THEN 'Recharge twice per year.' WHEN 'once' THEN 'Single recharge available.' ELSE 'No recharge benefit.' END AS recharge_said,
    CASE WHEN mandatory = 'none' THEN 'No mandatory copay.' WHEN copay_percent <= 10 THEN 'Mandatory ' || copay_percent::BIGINT || '% copay.' ELSE 'High mandatory copay at ' || copay_percent::BIGINT || '%.' END
      || CASE WHEN mandatory = 'network' AND copay_percent >= 20 THEN ' Additional penalty for network-based copay of 20% or more.' ELSE '' END AS copay_said,
    CASE cataract_type WHEN 'not_applicable' THEN 'No cataract sublimit.' WHEN 'percent_of_SI' THEN 'Cataract limit at ' || cataract_value::BIGINT || '% of sum insured' ELSE 'Cataract rupee cap at ' || cataract_value::BIGINT END
      || CASE WHEN cataract_type = 'not_applicable' THEN '' WHEN per_eye THEN ' per eye.' ELSE '.' END AS cataract_said,
    'Initial ' || initial_days::BIGINT || ' days, specific ' || specific_months::BIGINT || ' months, PED ' || ped_months::BIGINT || ' months.' || CASE WHEN shorter THEN ' Reduction options available.' ELSE '' END AS waiting_periods_said,
    CASE WHEN NOT (topup OR applies) THEN 'Base plan usable as primary cover; neutral top-up friendliness.' ELSE CASE top_how WHEN 'aggregate_year' THEN 'Aggregate annual deductible.' WHEN 'per_claim' THEN 'Per-claim deductible.' ELSE 'Deductible structure unspecified.' END
      || CASE WHEN list_has_all(covers, ['IPD', 'pre_post', 'daycare']) THEN ' Comprehensive coverage above deductible.' ELSE '' END || CASE WHEN room_type IN ('no_cap', 'single_private_room') THEN ' Base room rules support layering.' ELSE '' END END AS topup_friendliness_said
  FROM norm),
summed AS (
  SELECT *, room_rent * 0.25::DOUBLE + pre_post * 0.12::DOUBLE + daycare_score * 0.04::DOUBLE + ayush * 0.04::DOUBLE + domiciliary * 0.02::DOUBLE + ncb * 0.07::DOUBLE + recharge * 0.1::DOUBLE + copay * 0.04::DOUBLE
    + cataract * 0.04::DOUBLE + waiting_periods * 0.04::DOUBLE + topup_friendliness * 0.24::DOUBLE AS weighted FROM scored)"""

_GRADE = "CASE WHEN {0} >= 90 THEN 'A+' WHEN {0} >= 80 THEN 'A' WHEN {0} >= 70 THEN 'B' WHEN {0} >= 60 THEN 'C' ELSE 'D' END"
_RATE = "CASE WHEN {0} < 60 THEN 'Bad' WHEN {0} < 80 THEN 'OK' ELSE 'Good' END"
_TWO = "floor({0} * 100 + 0.5::DOUBLE) / 100"
_NOTES = """notes || CASE WHEN recharge_type = 'na' THEN ' | No recharge/reset benefit.' ELSE '' END
  || CASE WHEN mandatory <> 'none' THEN ' | Mandatory copay of ' || copay_percent::BIGINT || '% based on ' || mandatory || '.' ELSE '' END"""


def _norm(columns: str) -> str:
    return f"WITH {_FACTS} SELECT p_partkey, {columns} FROM norm"


def _flat(spark: SparkSession, sf_dir: str, **columns: str | F.Column) -> DataFrame:
    return products(spark, sf_dir, dealt=True).select("p_partkey", *[(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


_PARSED = {
    "parse_room_rent": (
        "room_type, room_value, icu_type, icu_value, proportionate, modifier",
        dict(room_type="roomRent.limitType", room_value="roomRent.limitValue", icu_type="roomRent.icuLimitType", icu_value="roomRent.icuLimitValue", proportionate="roomRent.proportionateDeduction", modifier="roomRent.roomModifierOption"),
    ),
    "parse_ayush": ("ayush_type, ayush_value, ayush_type <> 'not_covered' AS covered", dict(ayush_type="hospitalization.ayush.limitType", ayush_value="hospitalization.ayush.limitValue", covered="hospitalization.ayush.covered")),
    "parse_recharge": ("recharge_type, same_illness", dict(recharge_type="bonuses.recharge.type", same_illness="bonuses.recharge.sameIllnessAllowed")),
    "parse_ncb": ("accrual, cap, impact", dict(accrual="bonuses.ncb.accrualPerYearPercent", cap="bonuses.ncb.maxCapPercent", impact="bonuses.ncb.claimImpact")),
    "parse_waiting": (
        "initial_days, specific_months, ped_months, shorter, false AS ped_shorter",
        dict(initial_days="waitingPeriods.initialDays", specific_months="waitingPeriods.specificAilmentsMonths", ped_months="waitingPeriods.pedMonths", shorter="waitingPeriods.reductionOptions.specificAilments", ped_shorter="waitingPeriods.reductionOptions.ped"),
    ),
    "parse_copay": ("mandatory, copay_percent, copay_optional", dict(mandatory="copayAndZones.mandatory", copay_percent="copayAndZones.mandatoryPercent", copay_optional="copayAndZones.optionalCopayAvailable")),
    "parse_cataract": ("cataract_type, cataract_value, per_eye", dict(cataract_type="sublimits.cataract.type", cataract_value="sublimits.cataract.value", per_eye="sublimits.cataract.perEye")),
    "parse_disease_sublimits": (
        "p_type || ',other' AS names, 'percent,rupee_cap' AS kinds, 10::DOUBLE AS total",
        dict(names="array_join(sublimits.diseaseSpecific.name, ',')", kinds="array_join(sublimits.diseaseSpecific.type, ',')", total="aggregate(sublimits.diseaseSpecific.value, 0D, (a, x) -> a + x)"),
    ),
    "parse_topup": (
        "top_how, list_aggregate(covers, 'string_agg', ',') AS covers, room_rule, top_recharge, 'na' AS top_ncb",
        dict(top_how="topUpSpecifics.howDeductibleApplies", covers="array_join(topUpSpecifics.coverageAboveDeductible, ',')", room_rule="topUpSpecifics.roomRuleOnTopUp", top_recharge="topUpSpecifics.rechargeOnTopUp", top_ncb="topUpSpecifics.ncbOnTopUp"),
    ),
    "parse_misc": ("road, air, donor_covered, donor_notes, inpatient", dict(road="transport.roadAmbulanceLimit", air="transport.airAmbulance", donor_covered="organDonor.covered", donor_notes="organDonor.notes", inpatient="hospitalization.inpatient")),
    "parse_deductible": ("applies, deductible_type, deductible_amount, aggregate_applies", dict(applies="deductible.applies", deductible_type="deductible.type", deductible_amount="deductible.amount", aggregate_applies="deductible.aggregateApplies")),
    "parse_sum_insured": (
        "base, 'INR' AS currency, (SELECT string_agg(b::BIGINT::VARCHAR, ',' ORDER BY b) FROM (SELECT DISTINCT unnest([250000, (k % 4 + 1) * 250000, 1000000, base]) AS b)) AS bands",
        dict(base="sumInsured.baseSI", currency="sumInsured.currency", bands="array_join(transform(sumInsured.availableBands, x -> cast(cast(x as bigint) as string)), ',')"),
    ),
    "build_notes": ("notes", dict(notes="notes")),
    "parse_daycare": ("daycare", dict(daycare="hospitalization.daycare")),
    "normalize_product": (
        "p_brand AS insurer, p_name AS plan, policy_type, topup, geography, base, room_type, room_value, pre, post, home, home_days, ayush_type, accrual, cap, recharge_type, mandatory, cataract_type, top_how, confidence, notes",
        dict(
            insurer="product.insurer", plan="product.planName", policy_type="product.policyType", topup="product.isTopUp", geography="product.geography", base="sumInsured.baseSI", room_type="roomRent.limitType", room_value="roomRent.limitValue",
            pre="hospitalization.preHospDays", post="hospitalization.postHospDays", home="hospitalization.domiciliary.covered", home_days="hospitalization.domiciliary.minDays", ayush_type="hospitalization.ayush.limitType",
            accrual="bonuses.ncb.accrualPerYearPercent", cap="bonuses.ncb.maxCapPercent", recharge_type="bonuses.recharge.type", mandatory="copayAndZones.mandatory", cataract_type="sublimits.cataract.type",
            top_how="topUpSpecifics.howDeductibleApplies", confidence="provenance.extractionConfidence", notes="notes",
        ),
    ),
}

for _name, (_sql, _columns) in _PARSED.items():
    group.query(_norm(_sql), _name)(lambda spark, sf_dir, columns=_columns: _flat(spark, sf_dir, **columns))

_KEYS = {"waiting_periods": "score_waiting", "topup_friendliness": "score_topup"}
for _place, _parameter in enumerate(PARAMETERS):
    _column = {"daycare": "daycare_score"}.get(_parameter.name, _parameter.name)
    _sql = f"WITH {_FACTS}, {_SCORED} SELECT p_partkey, {_TWO.format(_column)} AS score, {_RATE.format(_column)} AS rating, {_parameter.name}_said AS rationale FROM summed"

    def _one(spark: SparkSession, sf_dir: str, place: int = _place) -> DataFrame:
        row, one = F.col("scores")[0], (PARAMETERS[place],)
        return judge_products(normalize(raw_products(spark, sf_dir, dealt=True), fields_read(one)), one).select("p_partkey", two_places(row["score"]).alias("score"), row["rating"].alias("rating"), row["rationale"].alias("rationale"))

    group.query(_sql, _KEYS.get(_parameter.name, f"score_{_parameter.name}"))(_one)

_SUMMED = f"WITH {_FACTS}, {_SCORED} SELECT p_partkey"


@group.query(f"{_SUMMED}, {_TWO.format('weighted')} AS weighted_score FROM summed")
def score_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluations(spark, sf_dir, dealt=True).select("p_partkey", F.col("overall.weightedScore").alias("weighted_score"))


@group.query(f"WITH {_FACTS}, {_SCORED} SELECT {_GRADE.format('weighted')} AS grade, count(*) AS n, {_TWO.format('min(weighted)')} AS least, {_TWO.format('max(weighted)')} AS most FROM summed GROUP BY 1")
def score_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = evaluations(spark, sf_dir, dealt=True).select("overall.grade", "overall.weightedScore")
    return graded.groupBy("grade").agg(F.count(F.lit(1)).alias("n"), F.min("weightedScore").alias("least"), F.max("weightedScore").alias("most"))


@group.query(f"{_SUMMED}, {_NOTES} AS notes FROM summed")
def score_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluations(spark, sf_dir, dealt=True).select("p_partkey", "overall.notes")


@group.query(
    f"{_SUMMED}, p_brand AS insurer, p_name AS plan_name, {_TWO.format('weighted')} AS weighted_score, {_GRADE.format('weighted')} AS grade, "
    + "concat_ws('/', " + ", ".join(_RATE.format(c) for c in ("room_rent", "pre_post", "daycare_score", "ayush", "domiciliary", "ncb", "recharge", "copay", "cataract", "waiting_periods", "topup_friendliness"))
    + ") AS ratings, '1.0.0' AS version, 0 AS broken FROM summed"
)
def score_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = evaluations(spark, sf_dir, dealt=True).withColumn("broken", F.size(evaluation_errors()))
    ratings = F.array_join(F.transform("scores", lambda x: x["rating"]), "/")
    return scored.select("p_partkey", "productRef.insurer", F.col("productRef.planName").alias("plan_name"), F.col("overall.weightedScore").alias("weighted_score"), "overall.grade", ratings.alias("ratings"), "version", "broken")


@group.query(f"{_SUMMED}, " + " || chr(10) || ".join(f"{n}_said" for n in WEIGHTS) + " AS rationale FROM summed")
def score_rationale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluations(spark, sf_dir, dealt=True).select("p_partkey", F.array_join("scores.rationale", "\n").alias("rationale"))


@group.query("SELECT p_partkey, " + _TWO.format("p_retailprice / 20") + " AS score, " + _RATE.format("(p_retailprice / 20)") + " AS rating, " + _GRADE.format("(p_retailprice / 20)") + " AS grade FROM part")
def score_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("p_retailprice") / 20
    return table(spark, sf_dir, "part").select("p_partkey", two_places(score).alias("score"), rate(score).alias("rating"), grade(score).alias("grade"))


# Products that keep or break single rules, as JSON.
_BASE = {
    "product": {"insurer": "Harbour Health", "planName": "Harbour One", "variant": "Prime", "uin": "HH1", "policyType": "Floater", "isTopUp": False, "geography": "IN"},
    "sumInsured": {"baseSI": 1000000, "currency": "INR", "availableBands": [500000, 1000000], "unlimitedOneClaim": False},
    "deductible": {"applies": False, "type": None, "amount": None, "aggregateApplies": None},
    "roomRent": {"limitType": "single_private_room", "limitValue": None, "icuLimitType": "no_cap", "icuLimitValue": None, "proportionateDeduction": "waived_with_addon", "roomModifierOption": True},
    "hospitalization": {
        "inpatient": "covered", "daycare": "all", "preHospDays": 60, "postHospDays": 180,
        "domiciliary": {"covered": True, "minDays": 2, "negativeListPresent": False, "notes": None}, "ayush": {"covered": True, "limitType": "up_to_SI", "limitValue": None},
    },
    "transport": {"roadAmbulanceLimit": 20000, "airAmbulance": "optional", "airAmbulanceLimit": 500000},
    "organDonor": {"covered": True, "notes": None},
    "bonuses": {"ncb": {"accrualPerYearPercent": 50, "maxCapPercent": 150, "claimImpact": "no_impact"}, "recharge": {"type": "unlimited", "sameIllnessAllowed": True}},
    "waitingPeriods": {"initialDays": 30, "specificAilmentsMonths": 24, "pedMonths": 36, "reductionOptions": {"specificAilments": True, "ped": True}},
    "copayAndZones": {"mandatory": "none", "mandatoryPercent": None, "optionalCopayAvailable": False},
    "sublimits": {"cataract": {"type": "not_applicable", "value": None, "perEye": None}, "diseaseSpecific": []},
    "valueAdds": {"annualHealthCheckup": True, "eConsult": True, "wellnessBenefits": True, "others": ["Second opinion"]},
    "topUpSpecifics": {"howDeductibleApplies": None, "coverageAboveDeductible": [], "roomRuleOnTopUp": None, "rechargeOnTopUp": "na", "ncbOnTopUp": "na"},
    "provenance": {"sourceType": "policy_pdf", "sourceName": "Brochure", "sourceDate": "2025-10-01", "extractionConfidence": 0.9},
    "notes": None,
}
_TOP_UP_CHANGES = {
    "product.isTopUp": True, "sumInsured.baseSI": 2000000, "deductible": {"applies": True, "type": "per_year", "amount": 500000, "aggregateApplies": True}, "roomRent.limitType": "no_cap",
    "roomRent.proportionateDeduction": "not_applicable", "hospitalization.daycare": "all_listed", "hospitalization.preHospDays": 45, "hospitalization.postHospDays": 120,
    "hospitalization.domiciliary": {"covered": True, "minDays": 3, "negativeListPresent": True, "notes": "x"}, "hospitalization.ayush": {"covered": True, "limitType": "percent", "limitValue": 50},
    "bonuses": {"ncb": {"accrualPerYearPercent": 25, "maxCapPercent": 100, "claimImpact": "reduces"}, "recharge": {"type": "twice", "sameIllnessAllowed": False}},
    "waitingPeriods": {"initialDays": 30, "specificAilmentsMonths": 36, "pedMonths": 48, "reductionOptions": {"specificAilments": False, "ped": False}},
    "copayAndZones": {"mandatory": "zone", "mandatoryPercent": 10, "optionalCopayAvailable": True}, "sublimits.cataract": {"type": "rupee_cap", "value": 75000, "perEye": True},
    "topUpSpecifics": {"howDeductibleApplies": "aggregate_year", "coverageAboveDeductible": ["IPD", "daycare", "pre_post", "AYUSH"], "roomRuleOnTopUp": "plan_rule", "rechargeOnTopUp": "available", "ncbOnTopUp": "na"},
    "notes": "Zone based copay applies outside Tier-A cities.",
}


def changed(changes: dict) -> str:
    """The sample product as JSON, with values set by path; a path to ``...`` loses its key."""
    product = json.loads(json.dumps(_BASE))
    for path, value in changes.items():
        *way, last = path.split(".")
        at = product
        for part in way:
            at = at[part]
        if value is ...:
            del at[last]
        else:
            at[last] = value
    return json.dumps(product)


@group.query(
    "SELECT p_partkey, v.* EXCLUDE (k) FROM part JOIN (VALUES (0, 87.8::DOUBLE, 'A', NULL, true, '90,100,100,100,95,100,100,100,100,100,60'), "
    "(1, 83.43::DOUBLE, 'A', 'Zone based copay applies outside Tier-A cities. | Mandatory copay of 10% based on zone.', true, '100,70,100,80,60,53,75,70,20,70,100')) v(k, weighted_score, grade, notes, valid, scores) ON p_partkey % 2 = k"
)
def score_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part has one of two sample products, under its own name."""
    named = F.concat(F.lit("Plan "), F.col("p_partkey").cast("string"))
    text = F.when(F.col("p_partkey") % 2 == 0, changed({"product.planName": "@name"})).otherwise(changed(_TOP_UP_CHANGES | {"product.planName": "@name"}))
    records = spread(table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", F.replace(text, F.lit("@name"), named).alias("payload"))
    scored = validate(score_products(parse_products(records, "payload")), "payload")
    scores = F.array_join(F.transform("scores", lambda x: F.floor(x["score"]).cast("string")), ",")
    return scored.select("p_partkey", F.col("overall.weightedScore").alias("weighted_score"), "overall.grade", "overall.notes", "valid", scores.alias("scores"))


_BROKEN = (
    ("fine", {}, None),
    ("percent without value", {"roomRent.limitType": "percent_of_SI"}, "/roomRent: When limitType is percent_of_SI, limitValue must be 0-100."),
    ("negative rupee cap", {"roomRent.limitType": "rupee_cap", "roomRent.limitValue": -1}, "/roomRent: Rupee cap requires a non-negative limitValue."),
    ("private room with value", {"roomRent.limitValue": 5}, "/roomRent: Room types with inherent descriptions cannot have a numeric limitValue."),
    ("ICU percent", {"roomRent.icuLimitType": "percent_of_SI", "roomRent.icuLimitValue": 101}, "/roomRent: ICU percent limits must be within 0-100."),
    ("ICU rupees", {"roomRent.icuLimitType": "rupee_cap"}, "/roomRent: ICU rupee cap must be a non-negative number."),
    ("ICU without cap", {"roomRent.icuLimitValue": 1}, "/roomRent: ICU with no cap cannot include a limit value."),
    ("ayush percent", {"hospitalization.ayush.limitType": "percent"}, "/hospitalization/ayush: AYUSH percent limits must have a value between 0 and 100."),
    ("ayush rupees", {"hospitalization.ayush.limitType": "rupee_cap"}, "/hospitalization/ayush: AYUSH rupee caps must be non-negative."),
    ("ayush with value", {"hospitalization.ayush.limitValue": 1}, "/hospitalization/ayush: AYUSH limitType up_to_SI or not_covered must not set limitValue."),
    ("deductible without amount", {"deductible.applies": True, "deductible.type": "per_year"}, "/deductible: Deductible applying requires type per_year/per_claim and numeric amount."),
    ("copay percent", {"copayAndZones.mandatoryPercent": 1}, "/copayAndZones: Mandatory percent must be null when no copay applies."),
    ("copay without percent", {"copayAndZones.mandatory": "zone"}, "/copayAndZones: Mandatory copays require a percentage between 0 and 100."),
    ("cataract percent", {"sublimits.cataract.type": "percent_of_SI"}, "/sublimits/cataract: Cataract percent sublimits must be 0-100."),
    ("cataract per eye", {"sublimits.cataract.perEye": True}, "/sublimits/cataract: Not applicable cataract limits cannot have numeric values."),
    ("geography", {"product.geography": "in"}, "/product/geography: Geography must be an ISO-3166 alpha code (2-3 uppercase letters)."),
    ("currency", {"sumInsured.currency": "RS"}, "/sumInsured/currency: Currency must be a 3-letter ISO code."),
    ("date", {"provenance.sourceDate": "2025-02-30"}, "/provenance/sourceDate: Source date must follow ISO date format (YYYY-MM-DD)."),
    ("confidence", {"provenance.extractionConfidence": 1.5}, "/provenance/extractionConfidence: Extraction confidence must be a probability between 0 and 1."),
    ("missing key", {"organDonor.notes": ...}, "/organDonor: must have required property notes"),
    ("unknown key", {"transport.boat": 1}, "/transport: must not have additional property boat"),
    ("unknown enum", {"hospitalization.inpatient": "maybe"}, "/hospitalization/inpatient: must be one of the allowed values"),
    ("out of range", {"bonuses.ncb.accrualPerYearPercent": 201}, "/bonuses/ncb/accrualPerYearPercent: must be a number within its range"),
    ("empty name", {"product.insurer": ""}, "/product/insurer: must not be empty"),
    ("repeated bands", {"sumInsured.availableBands": [1, 1]}, "/sumInsured/availableBands: must not have duplicate items"),
)
_BROKEN_SQL = ", ".join(f"({k}, {'NULL' if error is None else repr(error)})" for k, (_, _, error) in enumerate(_BROKEN))


_VALID_SQL = (
    f"WITH {_FACTS} SELECT p_partkey, geography <> 'in' AND source_date <> '2025-13-01' AND NOT (room_type = 'percent_of_SI' AND room_value IS NULL) AND NOT (icu_type = 'percent_of_SI' AND icu_value IS NULL)"
    " AND NOT (applies AND deductible_amount IS NULL) AND coalesce(top_how, '') <> 'per_year' AND NOT (ayush_type = 'percent' AND coalesce(ayush_value, -1) NOT BETWEEN 0 AND 100) AS valid FROM norm"
)


@group.query(_VALID_SQL)
def validate_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate(products(spark, sf_dir, dealt=True)).select("p_partkey", "valid")


@group.query(_VALID_SQL)
def validate_compiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same products as JSON texts, by rules that a schema document compiles to."""
    rows = products(spark, sf_dir, dealt=True)
    names = T.StructType.fromDDL(types.PRODUCT).fieldNames()
    payload = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    return validate_json(rows.select("p_partkey", payload.alias("payload")), "payload", product_document()).select("p_partkey", "valid")


@group.query(f"SELECT p_partkey, error FROM part JOIN (VALUES {_BROKEN_SQL}) v(k, error) ON p_partkey % {len(_BROKEN)} = k")
def validation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part has a sample product with one fault, or none, under a name of its own."""
    texts = F.array(*[F.lit(changed({"product.uin": "@name"} | changes)) for _, changes, _ in _BROKEN])
    text = F.replace(F.get(texts, F.pmod("p_partkey", F.lit(len(_BROKEN))).cast("int")), F.lit("@name"), F.col("p_name"))
    records = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name")).select("p_partkey", text.alias("payload"))
    return validate(parse_products(records, "payload"), "payload").select("p_partkey", F.explode_outer("errors").alias("error"))


_NUMBERS = ("rs. 5,000 per day", "5 lakh", "1.2.3", ".", "", "-5", "1e5", "12.50%", None)
_NUMBER_SQL = ", ".join("(NULL)" if x is None else f"('{x}')" for x in _NUMBERS)


@group.query(f"SELECT text, {_num('text')} AS number FROM (VALUES {_NUMBER_SQL}) v(text) UNION ALL SELECT p_name || ' ' || p_retailprice, {_num("p_name || ' ' || p_retailprice")} FROM part", "to_number")
def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    traps = spark.createDataFrame([(x,) for x in _NUMBERS], "text string")
    parts = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", F.col("p_retailprice").cast("string")).alias("text"))
    return traps.unionByName(parts).select("text", to_number(F.col("text")).alias("number"))


@group.query("SELECT p_partkey, floor(p_retailprice - 1000 + 0.5)::BIGINT AS whole, floor(p_size / 2.0 + 0.5)::BIGINT AS half FROM part", "to_integer")
def integers(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = to_integer((F.col("p_size") / 2).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", to_integer(F.lit(None).cast("string"), F.col("p_retailprice") - 1000).alias("whole"), half.alias("half"))


@group.query("SELECT p_partkey, printf('%.1f', floor(p_size / 8.0 * 10 + 0.5) / 10) AS rating, floor(p_size / 50.0 * 100 + 0.5)::BIGINT || '%' AS share, regexp_replace(replace(lower(p_type), ' ', '-'), '-', ' ') AS label FROM part")
def card_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    dashed = F.replace(F.lower("p_type"), F.lit(" "), F.lit("-"))
    return table(spark, sf_dir, "part").select("p_partkey", card_number(F.col("p_size") / 8).alias("rating"), percent_label(F.col("p_size") / 50).alias("share"), first_dash_to_space(dashed).alias("label"))


def raw_of_json(spark: SparkSession, payloads: list[str]) -> DataFrame:
    """Raw extracts in JSON to columns of ``types.RAW``."""
    return spark.createDataFrame([(p,) for p in payloads], "payload string").select(F.from_json("payload", types.RAW).alias("r")).select("r.*")


__all__ = ["evaluations", "flagship", "group", "products", "raw_of_json", "raw_products", "weighted_sum"]
