"""Golden pairs of the display profiles; what a profile gives is a fixed point of it (but for pascal, which loses its words)."""

import pytest
from pyspark.sql import functions as F

from burnish.contract.vocabulary import StringFormat
from burnish.functions.profiles import apply_format
from burnish.queries import GOLDEN as GOLDEN_OF_QUERIES

GOLDEN = {
    "lower": {"ACTIVE Loan": "active loan"},
    "upper": {"active": "ACTIVE"},
    "title": {"loan STATUS": "Loan Status", "o'brien smith-jones": "O'brien Smith-jones", "a/b (c)": "A/b (c)"},
    "pascal": {"loan status": "LoanStatus"},
    "zip": {
        "1234": "01234", "123456789": "12345-6789", "123-45": "00123-0045", "123456": None, "1234, 67890": "01234, 67890", "12 345": "12345", "12a": None,
        "1,,2": None, "1-2-3": None,
    },
} | GOLDEN_OF_QUERIES


@pytest.mark.parametrize("name", GOLDEN)
def test_golden_and_idempotent(spark, name):
    profile = StringFormat(name)
    rows = spark.createDataFrame([(None, None), *GOLDEN[name].items()], "given string, wanted string")
    got = rows.select("given", "wanted", apply_format(F.col("given"), profile).alias("got")).withColumn("again", apply_format(F.col("got"), profile)).collect()
    assert [(r.given, r.got) for r in got] == [(r.given, r.wanted) for r in got]
    assert name == "pascal" or all(r.again == r.got for r in got if r.got)


def test_every_profile_is_covered():
    assert set(GOLDEN) == {f.value for f in StringFormat}


@pytest.mark.parametrize("name", ["address_us_v1", "county"])
def test_long_tokens_are_not_cut(spark, name):
    got = spark.range(1).select(apply_format(F.lit("x" * 1200), StringFormat(name)).alias("v")).first().v
    assert got.startswith("X" + "x" * 1199)
