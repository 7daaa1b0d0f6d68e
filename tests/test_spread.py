"""Work on each row of a compact file is dealt over the cores, and a text is parsed once."""

import pytest

from tidewater.operators.json_schema import validate_json
from tidewater.operators.scoring import Parameter, judge_products
from tidewater.operators.validation import product_document
from tidewater.queries import products

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["score_ncb", "normalize_product", "score_fixture", "validation_errors"])
def test_parts_are_dealt_over_the_cores(spark, name):
    assert products.group.queries[name](spark, SF).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_texts_are_parsed_once(spark):
    checked = validate_json(spark.createDataFrame([("{}",)], "payload string"), "payload", product_document())
    assert checked._jdf.queryExecution().analyzed().toString().count("parse_json(") == 1


@pytest.mark.parametrize("name", ["score_daycare", "score_copay", "score_pre_post"])
def test_a_score_makes_only_what_it_reads(spark, name):
    plan = products.group.queries[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "p_partkey" in plan and not any(text in plan for text in ("Single private AC room", "Rs 40000 per eye", "per_claim"))


def test_validity_is_told_without_messages(spark):
    plan = products.group.queries["validate_product"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "p_partkey" in plan and "must be boolean" not in plan and "filter(arrays_zip(" not in plan


def test_rationales_are_read_without_scores(spark):
    plan = products.group.queries["score_rationale"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "No recharge benefit." in plan and "_score" not in plan and "arrays_zip(" not in plan


@pytest.mark.parametrize("name", ["score_ayush", "score_topup", "score_domiciliary", "score_room_rent", "score_recharge"])
def test_a_single_score_is_compiled(spark, name):
    plan = products.group.queries[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "concat_ws(" in plan and "transform(array(concat_ws(" not in plan


def test_rationales_lose_blanks_only(spark):
    one = Parameter("said", "0D", ("' 010 '", "'said '"))
    judge = lambda parameters: spark.range(1).transform(judge_products, parameters).first().scores
    assert [x.rationale for x in judge((one,))] == ["010 said"] and {x.rationale for x in judge((one,) * 5)} == {"010 said"}


@pytest.mark.parametrize(
    "name, unread",
    [("score_ayush", "availableBands"), ("score_domiciliary", "up to si"), ("score_topup", "icuLimitType"), ("score_room_rent", "roomModifierOption"), ("score_recharge", "claimImpact")],
)
def test_a_single_score_makes_no_other_field(spark, name, unread):
    plan = products.group.queries[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "p_partkey" in plan and unread not in plan


@pytest.mark.parametrize("name", ["score_ayush", "score_domiciliary", "score_room_rent"])
def test_methods_are_short_enough_to_be_compiled(spark, name):
    """A method of more than 8,000 bytes stays interpreted by the JVM."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = products.group.queries[name](spark, SF)._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    stages = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenStringSeq(plan)
    assert max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < 8000
