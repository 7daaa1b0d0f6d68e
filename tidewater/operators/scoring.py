"""Explainable scores: eleven parameters, each a rating, a score and a rationale; a weighted sum and a grade.

Each parameter is a declarative row of SQL over a normalised product's struct columns. Numbers
that texts quote, scores and texts are arrays, staged as columns: each is computed once. They
meet as structs without a lambda, so that who reads a single field makes no other.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.numbers import short_number, two_places

#: Weights in the order in which they are summed, grades, bands and version.
WEIGHTS = {
    "room_rent": 0.25,
    "pre_post": 0.12,
    "daycare": 0.04,
    "ayush": 0.04,
    "domiciliary": 0.02,
    "ncb": 0.07,
    "recharge": 0.10,
    "copay": 0.04,
    "cataract": 0.04,
    "waiting_periods": 0.04,
    "topup_friendliness": 0.24,
}
GRADES = (("A+", 90), ("A", 80), ("B", 70), ("C", 60))
LOWEST_GRADE = "D"
BANDS = (("Good", 80), ("OK", 60))
LOWEST_BAND = "Bad"
VERSION = "1.0.0"
#: Up to so many texts are compiled one by one; the code of many may be longer than the JVM compiles.
FEW = 2


@dataclass(frozen=True)
class Parameter:
    """SQL for the score (double) and the parts of the rationale, joined without separators; a null part is left out."""

    name: str
    score: str
    rationale: tuple[str, ...]


def _within(x: str, low: int, high: int) -> str:
    return f"greatest({low}D, least({high}D, {x}))"


def _said(x: str, missing: str) -> str:
    """A placeholder for a number in its short form."""
    return f"{{{x}|{missing}}}"


_BASE = "coalesce(nullif(sumInsured.baseSI, 0D), 1D)"
_ROOM = "roomRent.limitValue"
_ICU = "(roomRent.icuLimitType = 'no_cap' OR roomRent.icuLimitType = 'percent_of_SI' AND coalesce(roomRent.icuLimitValue, 0D) >= 2)"
_NCB, _NCB_CAP = "coalesce(bonuses.ncb.accrualPerYearPercent, 0D)", "coalesce(bonuses.ncb.maxCapPercent, 0D)"
_AYUSH, _AYUSH_OFF = "coalesce(hospitalization.ayush.limitValue, 0D)", "(NOT hospitalization.ayush.covered OR hospitalization.ayush.limitType = 'not_covered')"
_PRE, _POST = "hospitalization.preHospDays", "hospitalization.postHospDays"
_HOME, _HOME_DAYS = "hospitalization.domiciliary", "coalesce(hospitalization.domiciliary.minDays, 0D)"
_SAME = "coalesce(bonuses.recharge.sameIllnessAllowed, false)"
_COPAY = "coalesce(copayAndZones.mandatoryPercent, 0D)"
_NETWORK = f"(copayAndZones.mandatory = 'network' AND {_COPAY} >= 20)"
_EYE, _EYES = "coalesce(sublimits.cataract.value, 0D)", "if(coalesce(sublimits.cataract.perEye, false), ' per eye', '')"
_WAIT = "waitingPeriods"
_SHORTER = "(coalesce(waitingPeriods.reductionOptions.specificAilments, false) OR coalesce(waitingPeriods.reductionOptions.ped, false))"
_TOP_UP = "(product.isTopUp OR deductible.applies)"
_ABOVE = "size(array_intersect(topUpSpecifics.coverageAboveDeductible, array('IPD', 'pre_post', 'daycare'))) = 3"
_LAYERS = "roomRent.limitType IN ('no_cap', 'single_private_room')"

PARAMETERS = (
    Parameter(
        "room_rent",
        _within(
            f"""CASE roomRent.limitType WHEN 'no_cap' THEN 100D WHEN 'single_private_room' THEN 75D WHEN 'twin_sharing' THEN 60D
              WHEN 'rupee_cap' THEN if(coalesce({_ROOM}, 0D) <> 0, {_within(f"40 + {_ROOM} / {_BASE} * 40", 30, 80)}, 40D)
              WHEN 'percent_of_SI' THEN if(coalesce({_ROOM}, 0D) <= 1, 30D, {_within(f"50 + ({_ROOM} - 1) * 5", 30, 70)})
              ELSE 40D END + if({_ICU}, 5D, 0D) + if(roomRent.proportionateDeduction IN ('waived_with_addon', 'not_applicable'), 10D, 0D)""",
            0,
            100,
        ),
        (
            f"""CASE roomRent.limitType WHEN 'no_cap' THEN 'No cap on room rent.' WHEN 'single_private_room' THEN 'Single private room cap.'
              WHEN 'twin_sharing' THEN 'Twin sharing cap.' WHEN 'rupee_cap' THEN concat('Rupee cap at ', {_said(_ROOM, "unspecified")}, '.')
              WHEN 'percent_of_SI' THEN concat('Room limit at ', {_said(_ROOM, "?")}, '% of sum insured.')
              ELSE 'Room rent cap unspecified, conservative score applied.' END""",
            f"if({_ICU}, ' ICU coverage generous.', '')",
            """CASE roomRent.proportionateDeduction WHEN 'waived_with_addon' THEN ' Proportionate deduction waiver available.'
              WHEN 'not_applicable' THEN ' Proportionate deduction not applicable.' END""",
        ),
    ),
    Parameter(
        "pre_post",
        f"""CASE WHEN {_PRE} >= 60 AND {_POST} >= 180 THEN 100D WHEN {_PRE} >= 60 AND {_POST} >= 90 THEN 80D WHEN {_PRE} >= 45 AND {_POST} >= 90 THEN 70D
          WHEN {_PRE} >= 45 AND {_POST} >= 60 THEN 60D WHEN {_PRE} >= 30 AND {_POST} >= 60 THEN 40D ELSE 30D END""",
        (
            f"concat('Pre ', {_said(_PRE, 'null')}, ' days / Post ', {_said(_POST, 'null')}, ' days.')",
            f"CASE WHEN {_PRE} >= 60 AND {_POST} >= 180 THEN ' Extended pre/post cover.' WHEN {_PRE} >= 60 AND {_POST} >= 90 THEN ' Strong pre/post cover.' END",
        ),
    ),
    Parameter(
        "daycare",
        "CASE WHEN hospitalization.daycare IN ('all', 'all_listed') THEN 100D WHEN hospitalization.daycare = 'limited_list' THEN 60D ELSE 0D END",
        ("CASE WHEN hospitalization.daycare IN ('all', 'all_listed') THEN 'All daycare procedures covered.' WHEN hospitalization.daycare = 'limited_list' THEN 'Limited daycare list.' ELSE 'Daycare not covered.' END",),
    ),
    Parameter(
        "ayush",
        f"""CASE WHEN {_AYUSH_OFF} THEN 0D WHEN hospitalization.ayush.limitType = 'up_to_SI' THEN 100D
          WHEN hospitalization.ayush.limitType = 'percent' THEN if({_AYUSH} >= 50, 80D, {_within(f"{_AYUSH} / 50 * 80", 0, 80)})
          ELSE {_within(f"{_AYUSH} / {_BASE} * 80", 0, 80)} END""",
        (
            f"""CASE WHEN {_AYUSH_OFF} THEN 'AYUSH not covered.' WHEN hospitalization.ayush.limitType = 'up_to_SI' THEN 'AYUSH up to sum insured.'
              WHEN hospitalization.ayush.limitType = 'percent' THEN concat('AYUSH limit at ', {_said(_AYUSH, "0")}, '% of sum insured.')
              ELSE concat('AYUSH rupee cap at ', {_said("hospitalization.ayush.limitValue", "null")}, '.') END""",
        ),
    ),
    Parameter(
        "domiciliary",
        f"CASE WHEN NOT {_HOME}.covered THEN 0D WHEN {_HOME}.negativeListPresent THEN 60D WHEN {_HOME_DAYS} <= 3 THEN 95D ELSE 80D END",
        (
            f"""CASE WHEN NOT {_HOME}.covered THEN 'Domiciliary not covered.' WHEN {_HOME}.negativeListPresent THEN 'Domiciliary covered with notable exclusions.'
              WHEN {_HOME_DAYS} <= 3 THEN 'Domiciliary with low min days and no negative list.' ELSE concat('Domiciliary covered with minimum ', {_said(_HOME_DAYS, "0")}, ' days.') END""",
        ),
    ),
    Parameter(
        "ncb",
        f"""CASE bonuses.ncb.claimImpact WHEN 'no_impact' THEN {_within("{accrued} + 5", 0, 100)} WHEN 'reduces' THEN {_within("{accrued} - 10", 0, 100)} ELSE {{accrued}} END""".replace(
            "{accrued}",
            f"""(CASE WHEN {_NCB} >= 50 AND {_NCB_CAP} >= 100 THEN {_within(f"90 + least(({_NCB_CAP} - 100) / 50 * 5, 10D)", 90, 100)}
              WHEN {_NCB} >= 20 THEN 60 + {_within(f"({_NCB} - 20) / 30", 0, 1)} * 20 WHEN {_NCB} > 0 THEN 40D ELSE 0D END)""",
        ),
        (
            f"""CASE WHEN {_NCB} >= 50 AND {_NCB_CAP} >= 100 THEN concat('NCB accrues ', {_said(_NCB, "0")}, '% per year up to ', {_said(_NCB_CAP, "0")}, '%.')
              WHEN {_NCB} >= 20 THEN concat('Moderate NCB accrual of ', {_said(_NCB, "0")}, '%.') WHEN {_NCB} > 0 THEN concat('Low NCB accrual of ', {_said(_NCB, "0")}, '%.')
              ELSE 'No NCB accrual.' END""",
            "CASE bonuses.ncb.claimImpact WHEN 'no_impact' THEN ' Bonus protected after claims.' WHEN 'reduces' THEN ' NCB reduces post claim.' END",
        ),
    ),
    Parameter(
        "recharge",
        f"CASE bonuses.recharge.type WHEN 'unlimited' THEN if({_SAME}, 100D, 90D) WHEN 'twice' THEN if({_SAME}, 85D, 75D) WHEN 'once' THEN if({_SAME}, 75D, 60D) ELSE 0D END",
        (
            f"""CASE bonuses.recharge.type WHEN 'unlimited' THEN if({_SAME}, 'Unlimited recharge covering same illness.', 'Unlimited recharge without same illness support.')
              WHEN 'twice' THEN 'Recharge twice per year.' WHEN 'once' THEN 'Single recharge available.' ELSE 'No recharge benefit.' END""",
        ),
    ),
    Parameter(
        "copay",
        f"CASE WHEN copayAndZones.mandatory = 'none' THEN 100D ELSE if({_COPAY} <= 10, 70D, 40D) - if({_NETWORK}, 20D, 0D) END",
        (
            f"""CASE WHEN copayAndZones.mandatory = 'none' THEN 'No mandatory copay.' WHEN {_COPAY} <= 10 THEN concat('Mandatory ', {_said(_COPAY, "0")}, '% copay.')
              ELSE concat('High mandatory copay at ', {_said(_COPAY, "0")}, '%.') END""",
            f"if({_NETWORK}, ' Additional penalty for network-based copay of 20% or more.', '')",
        ),
    ),
    Parameter(
        "cataract",
        f"""CASE sublimits.cataract.type WHEN 'not_applicable' THEN 100D
          WHEN 'percent_of_SI' THEN CASE WHEN {_EYE} >= 25 THEN 80D WHEN {_EYE} >= 20 THEN 70D WHEN {_EYE} >= 10 THEN 50D ELSE 30D END
          WHEN 'rupee_cap' THEN CASE WHEN {_EYE} / {_BASE} >= 0.2D THEN 70D WHEN {_EYE} / {_BASE} >= 0.1D THEN 50D ELSE 20D END ELSE 0D END""",
        (
            f"""CASE sublimits.cataract.type WHEN 'not_applicable' THEN 'No cataract sublimit.' WHEN 'percent_of_SI' THEN concat('Cataract limit at ', {_said(_EYE, "0")}, '% of sum insured', {_EYES}, '.')
              WHEN 'rupee_cap' THEN concat('Cataract rupee cap at ', {_said(_EYE, "0")}, {_EYES}, '.') END""",
        ),
    ),
    Parameter(
        "waiting_periods",
        _within(
            f"""CASE WHEN {_WAIT}.initialDays <= 30 AND {_WAIT}.specificAilmentsMonths <= 24 AND {_WAIT}.pedMonths <= 36 THEN 90D
              WHEN {_WAIT}.initialDays <= 30 AND {_WAIT}.specificAilmentsMonths <= 36 AND {_WAIT}.pedMonths <= 48 THEN 70D ELSE 50D END
              - if({_WAIT}.initialDays > 30, 10D, 0D) - if({_WAIT}.pedMonths > 48, 10D, 0D) + if({_SHORTER}, 10D, 0D)""",
            0,
            100,
        ),
        (
            f"concat('Initial ', {_said(f'{_WAIT}.initialDays', 'null')}, ' days, specific ', {_said(f'{_WAIT}.specificAilmentsMonths', 'null')}, ' months, PED ', {_said(f'{_WAIT}.pedMonths', 'null')}, ' months.')",
            f"if({_SHORTER}, ' Reduction options available.', '')",
        ),
    ),
    Parameter(
        "topup_friendliness",
        f"""CASE WHEN NOT {_TOP_UP} THEN 60D ELSE {_within(f'''
          CASE topUpSpecifics.howDeductibleApplies WHEN 'aggregate_year' THEN 90D WHEN 'per_claim' THEN 70D ELSE 60D END
          + if({_ABOVE}, 5D, 0D) + if(array_contains(topUpSpecifics.coverageAboveDeductible, 'AYUSH'), 3D, 0D) + if({_LAYERS}, 5D, 0D)''', 0, 100)} END""",
        (
            f"""CASE WHEN NOT {_TOP_UP} THEN 'Base plan usable as primary cover; neutral top-up friendliness.'
              WHEN topUpSpecifics.howDeductibleApplies = 'aggregate_year' THEN 'Aggregate annual deductible.'
              WHEN topUpSpecifics.howDeductibleApplies = 'per_claim' THEN 'Per-claim deductible.' ELSE 'Deductible structure unspecified.' END""",
            f"if({_TOP_UP} AND {_ABOVE}, ' Comprehensive coverage above deductible.', '')",
            f"if({_TOP_UP} AND {_LAYERS}, ' Base room rules support layering.', '')",
        ),
    ),
)


def fields_read(parameters: tuple[Parameter, ...]) -> tuple[str, ...]:
    """Fields of a product's structs, as ``roomRent.limitType``, that the SQL of these parameters names outside its texts."""
    sql = re.sub("'[^']*'", "''", " ".join(x for p in parameters for x in (p.score, *p.rationale)))
    return tuple(dict.fromkeys(re.findall(r"\b[A-Za-z]\w*[.][A-Za-z]\w*", sql)))


def _quoted_by(parameters: tuple[Parameter, ...]) -> tuple[str, ...]:
    """Placeholders of the rationales, each once: the numbers that texts quote, in their short form."""
    return tuple(dict.fromkeys(x for p in parameters for part in p.rationale for x in re.findall(r"{([^{}]*)[|][^{}|]*}", part)))


def quoted_numbers(parameters: tuple[Parameter, ...] = PARAMETERS) -> Column:
    """array<string>: the short forms of the numbers that texts quote, by one expression over all of them."""
    return F.transform(F.array(*[F.expr(x).cast("double") for x in _quoted_by(parameters)]).cast("array<double>"), lambda x: short_number(x, None))


def _expanded(sql: str, quoted: tuple[str, ...]) -> str:
    """SQL whose placeholders are read from the column ``_quoted``."""
    return re.sub(r"{([^{}]*)[|]([^{}|]*)}", lambda m: f"coalesce(_quoted[{quoted.index(m[1])}], '{m[2]}')", sql)


def rate(score: Column) -> Column:
    """Bad, OK or Good."""
    ladder = F.when(score >= BANDS[0][1], BANDS[0][0])
    for name, least in BANDS[1:]:
        ladder = ladder.when(score >= least, name)
    return ladder.otherwise(LOWEST_BAND)


def grade(weighted: Column) -> Column:
    """By the sum before rounding."""
    ladder = F.when(weighted >= GRADES[0][1], GRADES[0][0])
    for name, least in GRADES[1:]:
        ladder = ladder.when(weighted >= least, name)
    return ladder.otherwise(LOWEST_GRADE)


def scores_of(parameters: tuple[Parameter, ...] = PARAMETERS) -> Column:
    """array<double>: the score of each parameter."""
    return F.array(*[F.expr(p.score).cast("double") for p in parameters])


def rationales_of(parameters: tuple[Parameter, ...] = PARAMETERS) -> Column:
    """array<string>: the text of each parameter, beside the column ``_quoted`` of the same parameters."""
    quoted = _quoted_by(parameters)
    texts = [F.concat_ws("", *[F.expr(_expanded(part, quoted)) for part in p.rationale]) for p in parameters]
    # A lambda's argument is interpreted, with all that Spark moves into it.
    return F.array(*[F.trim(x) for x in texts]) if len(texts) <= FEW else F.transform(F.array(*texts), lambda x: F.trim(x))


def judged(scores: Column, rationales: Column, parameters: tuple[Parameter, ...] = PARAMETERS) -> Column:
    """array<struct<parameter, score, rating, rationale>>."""
    row = lambda i, p: F.struct(F.lit(p.name).alias("parameter"), scores[i].alias("score"), rate(scores[i]).alias("rating"), rationales[i].alias("rationale"))
    return F.array(*[row(i, p) for i, p in enumerate(parameters)])


def weighted_sum(scores: dict[str, Column]) -> Column:
    """A left fold in the order of ``WEIGHTS``, so that floating-point sums agree from run to run."""
    return reduce(lambda a, b: a + b, [scores[n] * F.lit(w) for n, w in WEIGHTS.items()], F.lit(0.0))


def overall_notes() -> Column:
    percent = short_number(F.coalesce(F.col("copayAndZones.mandatoryPercent"), F.lit(0.0)))
    copay = F.concat(F.lit("Mandatory copay of "), percent, F.lit("% based on "), F.col("copayAndZones.mandatory"), F.lit("."))
    said = F.array(
        F.nullif(F.col("notes"), F.lit("")),
        F.when(F.col("bonuses.recharge.type") == "na", F.lit("No recharge/reset benefit.")),
        F.when(F.col("copayAndZones.mandatory") != "none", copay),
    )
    return F.nullif(F.array_join(F.array_distinct(F.filter(said, lambda x: x.isNotNull())), " | "), F.lit(""))


def _detailed(products: DataFrame, parameters: tuple[Parameter, ...]) -> DataFrame:
    return products.withColumns({"_quoted": quoted_numbers(parameters), "_score": scores_of(parameters)}).withColumn("_text", rationales_of(parameters))


def judge_products(products: DataFrame, parameters: tuple[Parameter, ...]) -> DataFrame:
    """Adds scores of these parameters only; what none of them reads of a product need not be made."""
    return _detailed(products, parameters).withColumn("scores", judged(F.col("_score"), F.col("_text"), parameters)).drop("_quoted", "_score", "_text")


def score_products(products: DataFrame) -> DataFrame:
    """Adds productRef, scores (in the order of ``WEIGHTS``), overall<weightedScore, grade, notes> and version."""
    names = [p.name for p in PARAMETERS]
    summed = _detailed(products, PARAMETERS).withColumn("_sum", weighted_sum({n: F.col("_score")[names.index(n)] for n in WEIGHTS}))
    overall = F.struct(two_places(F.col("_sum")).alias("weightedScore"), grade(F.col("_sum")).alias("grade"), overall_notes().alias("notes"))
    reference = F.struct("product.insurer", "product.planName", "product.variant")
    scored = summed.withColumns({"productRef": reference, "scores": judged(F.col("_score"), F.col("_text")), "overall": overall, "version": F.lit(VERSION)})
    return scored.drop("_sum", "_quoted", "_score", "_text")
