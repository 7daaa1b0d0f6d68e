"""Spellings are searched for once a text, and licences are given out where rows are dealt over the cores."""

import re

from pyspark.sql import functions as F

from tidewater.llm.license_scan import canonical
from tidewater.llm.queries import licence_dresses


def test_a_text_is_searched_once_for_all_spellings(spark):
    assert len(re.findall(r"(?<!_)replace\(", str(canonical(F.col("text"))))) == 1
    texts = ["Sub licence, whilst", "sub license", "The Licence licence LABOUR", "É licence\n(c) 2020 x\nİ Centre", "", "licences sub sub license"]
    said = spark.createDataFrame([(t,) for t in texts], "text string").select(F.regexp_replace(canonical(F.col("text")), " +", " "))
    assert [r[0] for r in said.collect()] == ["sublicense while", "sublicense", "the license license labor", "É license İ center", "", "licenses sub sublicense"]


def test_licences_are_given_out_to_dealt_rows(spark):
    plan = licence_dresses(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    below = [re.split(r"Relation ", part)[0] for part in plan.split("Repartition ")[1:]]
    assert below and not any("WARRANT" in part or "RLIKE" in part for part in below)
