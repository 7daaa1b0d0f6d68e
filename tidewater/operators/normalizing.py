"""Raw facts to typed products: a select of struct columns, each a ladder of text rules.

Every rule is a native column expression, so that any number of products normalise without a
shuffle. Where a rule ladder looks for words, the first that holds decides.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.numbers import round_half_up, to_number

#: Fixed values.
DEFAULT_GEOGRAPHY, CURRENCY, DEFAULT_BASE = "IN", "INR", 500000.0
DEFAULT_PRE_DAYS, DEFAULT_POST_DAYS = 30.0, 60.0
DEFAULT_WAITS = {"initialDays": 30.0, "specificAilmentsMonths": 24.0, "pedMonths": 48.0}
DEFAULT_CONFIDENCE = 0.5
COPAY_TYPES = ("none", "age", "zone", "network", "disease_specific", "disease")
TOP_UP_COVERS = ("IPD", "daycare", "AYUSH", "pre_post")
AIR_AMBULANCE = ("covered", "optional", "not_covered")


def _lower(path: str) -> Column:
    return F.lower(F.coalesce(F.col(path), F.lit("")))


def _percent(text: Column) -> Column:
    return F.regexp_extract(text, r"(\d+(?:\.\d+)?)\s*%", 1).try_cast("double")


def _whole_percent(text: Column) -> Column:
    return F.regexp_extract(text, r"(\d{1,3})\s*%", 1).try_cast("double")


def _struct(**fields: Column) -> Column:
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _number(x: float | None) -> Column:
    return F.lit(x).cast("double")


def _numbers() -> dict[str, Column]:
    """Numbers that several fields ask for."""
    room = _lower("roomRent.text")
    return {
        "_room_percent": _percent(room),
        "_room_amount": to_number(room),
        "_icu_amount": to_number(_lower("roomRent.icuText")),
        "_ayush_value": to_number(F.col("hospitalization.ayushLimitValue")),
        "_accrual": _whole_percent(_lower("bonuses.ncbText")),
        "_cataract_amount": to_number(_lower("sublimits.cataractText")),
    }


def _kinds(at: dict[str, Column]) -> dict[str, Column]:
    """What several fields of a struct depend on, by the numbers in ``at``."""
    return {"_room": _room_step(at), "_ayush": _ayush_kind(at), "_cataract": _cataract_kind(at)}


def _room_step(at: dict[str, Column]) -> Column:
    """Each step of the ladder claims the text even where its number is missing."""
    text = _lower("roomRent.text")
    return (
        F.when(text.contains("no room") & text.contains("cap"), F.lit("no_cap"))
        .when(text.contains("%"), F.when(at["_room_percent"].isNotNull(), F.lit("percent_of_SI")))
        .when(text.contains("single") & text.contains("private"), F.lit("single_private_room"))
        .when(text.contains("twin"), F.lit("twin_sharing"))
        .when(text.rlike("rs|₹|lakh|lac|crore"), F.when(at["_room_amount"].isNotNull(), F.lit("rupee_cap")))
    )


def room_rent(at: dict[str, Column]) -> Column:
    text, icu, addon = _lower("roomRent.text"), _lower("roomRent.icuText"), _lower("roomRent.addonInfo")
    step, icu_amount = at["_room"], at["_icu_amount"]
    value = F.when(step == "percent_of_SI", at["_room_percent"]).when(step == "rupee_cap", at["_room_amount"])
    icu_type = F.when(icu.contains("no cap"), "no_cap").when(icu.contains("%") | icu_amount.isNull(), "percent_of_SI").otherwise("rupee_cap")
    icu_value = F.when(icu.contains("no cap"), _number(None)).when(icu.contains("%"), _percent(icu)).otherwise(icu_amount)
    applies = F.when(step.isNotNull() & (step != "no_cap"), "applies").otherwise("not_applicable")
    upgrade = F.coalesce(F.col("roomRent.upgradeOption"), F.lit(False)) | text.contains("optional upgrade") | text.contains("upgrade optional")
    return _struct(
        limitType=F.coalesce(step, F.lit("percent_of_SI")),
        limitValue=value,
        icuLimitType=icu_type,
        icuLimitValue=icu_value,
        proportionateDeduction=F.when(addon.contains("waiver"), "waived_with_addon").otherwise(applies),
        roomModifierOption=upgrade,
    )


def _ayush_kind(at: dict[str, Column]) -> Column:
    text, value = _lower("hospitalization.ayushText"), at["_ayush_value"]
    full = text.contains("up to si") | text.contains("upto si") | text.contains("sum insured")
    return (
        F.when(((text == "") & value.isNull()) | text.contains("not covered"), "not_covered")
        .when(full, "up_to_SI")
        .when(text.contains("%"), "percent")
        .when(value.isNotNull(), "rupee_cap")
        .otherwise("up_to_SI")
    )


def ayush(at: dict[str, Column]) -> Column:
    kind, value = at["_ayush"], at["_ayush_value"]
    limit = F.when(kind == "percent", F.coalesce(value, to_number(_lower("hospitalization.ayushText")))).when(kind == "rupee_cap", value)
    return _struct(covered=kind != "not_covered", limitType=kind, limitValue=limit)


def recharge() -> Column:
    text = _lower("bonuses.rechargeText")
    kind = (
        F.when(text.contains("unlimited"), "unlimited")
        .when(text.contains("twice"), "twice")
        .when(text.contains("once") | text.contains("one-time") | text.contains("one time"), "once")
        .otherwise("na")
    )
    return _struct(type=kind, sameIllnessAllowed=F.when(kind != "na", text.contains("same illness")))


def ncb(at: dict[str, Column]) -> Column:
    text = _lower("bonuses.ncbText")
    accrual = at["_accrual"]
    stated = F.regexp_extract(text, r"max(?:imum)?\s*(\d{1,3})\s*%", 1).try_cast("double")
    impact = F.when(text.contains("reduce"), "reduces").when(text.contains("no impact") | text.contains("protected"), "no_impact")
    return _struct(accrualPerYearPercent=accrual, maxCapPercent=F.coalesce(stated, accrual * 2), claimImpact=impact)


def waiting_periods() -> Column:
    days = {n: F.coalesce(round_half_up(to_number(F.col(f"waitingPeriods.{n}"))).cast("double"), _number(d)) for n, d in DEFAULT_WAITS.items()}
    flag = lambda n: F.coalesce(F.col(f"waitingPeriods.{n}"), F.lit(False))
    return _struct(**days, reductionOptions=_struct(specificAilments=flag("reductionSpecific"), ped=flag("reductionPed")))


def copay() -> Column:
    said = _lower("copay.mandatoryType")
    kind = F.when(said == "disease", "disease_specific").when(said.isin(*COPAY_TYPES), said).otherwise("none")
    percent = F.when(kind != "none", to_number(F.col("copay.mandatoryPercent")))
    return _struct(mandatory=kind, mandatoryPercent=percent, optionalCopayAvailable=F.coalesce(F.col("copay.optionalAvailable"), F.lit(False)))


def _cataract_kind(at: dict[str, Column]) -> Column:
    text = _lower("sublimits.cataractText")
    return (
        F.when((text == "") | text.contains("no sub-limit") | text.contains("not applicable"), "not_applicable")
        .when(text.contains("%"), "percent_of_SI")
        .when(at["_cataract_amount"].isNotNull(), "rupee_cap")
        .otherwise("not_applicable")
    )


def cataract(at: dict[str, Column]) -> Column:
    text, kind = _lower("sublimits.cataractText"), at["_cataract"]
    value = F.when(kind == "percent_of_SI", _whole_percent(text)).when(kind == "rupee_cap", at["_cataract_amount"])
    return _struct(type=kind, value=value, perEye=F.when(kind != "not_applicable", text.contains("per eye")))


def disease_sublimits() -> Column:
    given = F.coalesce(F.col("sublimits.diseaseSpecific"), F.array().cast("array<struct<name:string,type:string,value:string>>"))
    return F.transform(
        given,
        lambda x: _struct(name=x["name"], type=F.when(x["type"] == "percent", "percent").otherwise("rupee_cap"), value=F.coalesce(to_number(x["value"]), _number(0))),
    )


def deductible() -> Column:
    top_up = F.coalesce(F.col("product.isTopUp"), F.lit(False))
    applies = F.coalesce(F.col("deductible.applies"), top_up)
    kind = F.when(applies, F.when(F.col("deductible.type") == "per_claim", "per_claim").otherwise("per_year"))
    aggregate = F.coalesce(F.col("deductible.aggregateApplies"), F.when(kind == "per_year", F.lit(True)))
    return _struct(applies=applies, type=kind, amount=F.when(applies, to_number(F.col("deductible.amount"))), aggregateApplies=aggregate)


def sum_insured() -> Column:
    base = F.coalesce(to_number(F.col("sumInsured.baseSI")), _number(DEFAULT_BASE))
    bands = F.filter(F.transform(F.coalesce(F.col("sumInsured.bands"), F.array().cast("array<string>")), lambda x: to_number(x)), lambda x: x.isNotNull())
    every = F.array_sort(F.array_distinct(F.array_append(bands, base)))
    return _struct(baseSI=base, currency=F.coalesce(F.col("sumInsured.currency"), F.lit(CURRENCY)), availableBands=every, unlimitedOneClaim=F.coalesce(F.col("sumInsured.unlimitedOneClaim"), F.lit(False)))


def daycare() -> Column:
    text = _lower("hospitalization.daycare")
    return (
        F.when(text.contains("all listed"), "all_listed")
        .when(text.contains("all") & text.contains("procedures"), "all")
        .when(text.contains("not covered"), "not_covered")
        .when(text.contains("limited") | text.contains("list"), "limited_list")
        .otherwise("all_listed")
    )


def top_up() -> Column:
    is_top_up = F.coalesce(F.col("product.isTopUp"), F.lit(False))
    spec = lambda n: F.col(f"topUpSpecifics.{n}")
    covers = F.filter(F.coalesce(spec("coverageList"), F.array().cast("array<string>")), lambda x: x.isin(*TOP_UP_COVERS))
    offered = lambda n: F.when(spec(n) == "available", "available").otherwise("na")
    return _struct(
        howDeductibleApplies=F.when(is_top_up, spec("howDeductibleApplies")),
        coverageAboveDeductible=covers,
        roomRuleOnTopUp=F.when(is_top_up, spec("roomRule")),
        rechargeOnTopUp=offered("recharge"),
        ncbOnTopUp=offered("ncb"),
    )


def transport() -> Column:
    air = F.col("transport.airAmbulance")
    return _struct(
        roadAmbulanceLimit=to_number(F.col("transport.roadAmbulanceLimit")),
        airAmbulance=F.when(air.isin(*AIR_AMBULANCE), air).otherwise("not_covered"),
        airAmbulanceLimit=to_number(F.col("transport.airAmbulanceLimit")),
    )


def organ_donor() -> Column:
    notes = F.nullif(F.col("organDonor.notes"), F.lit(""))
    assumed = F.when(notes.isNull(), True).otherwise(~F.lower(notes).contains("not covered"))
    return _struct(covered=F.coalesce(F.col("organDonor.covered"), assumed), notes=notes)


def joined_notes(notes: Column) -> Column:
    """Trimmed, non-blank notes, each once, joined by bars; null where none is left."""
    trimmed = F.transform(F.coalesce(notes, F.array().cast("array<string>")), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    kept = F.array_distinct(F.filter(trimmed, lambda x: x.isNotNull() & (x != "")))
    return F.nullif(F.array_join(kept, " | "), F.lit(""))


def normalize(raw: DataFrame, reads: Iterable[str] | None = None) -> DataFrame:
    """Columns of ``types.RAW`` to those of ``types.PRODUCT``; other columns of ``raw`` go along.

    With ``reads``, fields such as ``hospitalization.ayush``, no others are made, nor structs without any of them. What
    several fields ask for is a column then, read and compiled once, so that the code stays short enough for the JVM to compile.
    """
    at = _numbers()
    if reads is None:
        at |= _kinds(at)
        facts = raw
    else:
        numbers = {n: F.col(n) for n in at}
        facts = raw.withColumns(at).withColumns(kinds := _kinds(numbers))
        at = numbers | {n: F.col(n) for n in kinds}
    flag = lambda path: F.coalesce(F.col(path), F.lit(False))
    days = lambda name, default: F.coalesce(round_half_up(to_number(F.col(f"hospitalization.{name}"))).cast("double"), _number(default))
    product = _struct(
        **{n: F.col(f"product.{n}") for n in ("insurer", "planName", "variant", "uin")},
        policyType=F.when(F.col("product.policyType") == "Floater", "Floater").otherwise("Individual"),
        isTopUp=flag("product.isTopUp"),
        geography=F.coalesce(F.col("product.geography"), F.lit(DEFAULT_GEOGRAPHY)),
    )
    home = _struct(
        covered=flag("hospitalization.domiciliary.covered"),
        minDays=round_half_up(to_number(F.col("hospitalization.domiciliary.minDays"))).cast("double"),
        negativeListPresent=flag("hospitalization.domiciliary.negativeListPresent"),
        notes=F.col("hospitalization.domiciliary.notes"),
    )
    made = {
        "product": product,
        "sumInsured": sum_insured(),
        "deductible": deductible(),
        "roomRent": room_rent(at),
        "hospitalization": _struct(
            inpatient=F.when(F.coalesce(F.col("hospitalization.inpatientCovered"), F.lit(True)), "covered").otherwise("not_covered"),
            daycare=daycare(),
            preHospDays=days("preHospDays", DEFAULT_PRE_DAYS),
            postHospDays=days("postHospDays", DEFAULT_POST_DAYS),
            domiciliary=home,
            ayush=ayush(at),
        ),
        "transport": transport(),
        "organDonor": organ_donor(),
        "bonuses": _struct(ncb=ncb(at), recharge=recharge()),
        "waitingPeriods": waiting_periods(),
        "copayAndZones": copay(),
        "sublimits": _struct(cataract=cataract(at), diseaseSpecific=disease_sublimits()),
        "valueAdds": _struct(**{n: flag(f"valueAdds.{n}") for n in ("annualHealthCheckup", "eConsult", "wellnessBenefits")}, others=F.coalesce(F.col("valueAdds.others"), F.array().cast("array<string>"))),
        "topUpSpecifics": top_up(),
        "provenance": _struct(
            **{n: F.col(f"provenance.{n}") for n in ("sourceType", "sourceName", "sourceDate")},
            extractionConfidence=F.coalesce(F.col("provenance.extractionConfidence"), _number(DEFAULT_CONFIDENCE)),
        ),
        "notes": joined_notes(F.col("notes")),
    }
    others = [F.col(f"`{c}`") for c in raw.columns if c not in made and c != "copay"]
    if reads is not None:
        read = dict.fromkeys(tuple(path.split(".")) for path in reads)
        made = {n: F.struct(*[made[n][f].alias(f) for m, f in read if m == n]) for n in dict.fromkeys(n for n, _ in read)}
    return facts.select(*others, *[c.alias(n) for n, c in made.items()])
