import math

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import addresses as A, amounts as M, formulas, similarity as S, texts


def one(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


@pytest.mark.parametrize("number,letters", [(1, "A"), (26, "Z"), (27, "AA"), (52, "AZ"), (702, "ZZ"), (703, "AAA"), (16384, "XFD")])
def test_letters_round_trip(spark, number, letters):
    got = one(spark, [(number, letters)], "n int, s string", A.col_letters(F.col("n")), A.col_number(F.col("s")))
    assert got == [(letters, number)]


def test_references(spark):
    f = """=SUM('My Tab'!$A$1:b3)+Other!C7*LOG10(5)-"X9"+D$4"""
    df = spark.createDataFrame([(f,)], "f string").select(F.explode(A.reference_texts(F.col("f"))).alias("t"))
    got = [tuple(r) for r in df.select(*A.reference_parts(F.col("t"))).collect()]
    assert got == [("My Tab", "A1", "B3"), ("Other", "C7", None), (None, "D4", None)]


def test_mentioned_tabs(spark):
    got = one(spark, [("='A b'!C1+Rates!D2+Rates!D3",)], "f string", A.mentioned_tabs(F.col("f")))
    assert sorted(got[0][0]) == ["A b", "Rates"]


VERDICTS = [
    # delta, delta_pct, completeness, ambiguous, verdict at 1 % and 100
    (5.0, 0.0005, "complete", False, "pass"),
    (5.0, 0.00285, "complete", False, "warn"),
    (5.0, 0.01, "complete", False, "block"),
    (100.0, 0.0001, "complete", False, "block"),
    (10.0, 0.0001, "complete", False, "warn"),
    (9.99, 0.00099, "complete", False, "pass"),
    (0.0, 0.0, "complete", False, "pass"),
    (0.0, 0.0, "complete", True, "warn"),
    (1.0, 0.0001, "complete", True, "warn"),
    (500.0, 0.5, "complete", True, "block"),
    (0.0, 0.0, "partial", False, "incomplete"),
    (None, None, "complete", False, "incomplete"),
]


def test_verdict_grid(spark):
    df = spark.createDataFrame(VERDICTS, "d double, p double, c string, a boolean, want string")
    got = df.withColumn(
        "got", M.verdict(F.col("d"), F.col("p"), F.lit(0.01), F.lit(100.0), F.col("c"), F.col("a"))
    ).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_zero_thresholds_pass_only_equality(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1e-9, 1e-12)], "d double, p double")
    got = df.select(M.verdict(F.col("d"), F.col("p"), F.lit(0.0), F.lit(0.0), F.lit("complete"))).collect()
    assert [r[0] for r in got] == ["pass", "block"]


def test_delta_is_symmetric_and_zero_safe(spark):
    rows = [(1750.0, 1755.0), (1755.0, 1750.0), (0.0, 0.0), (0.0, 5.0), (None, 1.0), (-3.0, 3.0)]
    got = one(spark, rows, "a double, b double", M.delta(F.col("a"), F.col("b")), M.delta_pct(F.col("a"), F.col("b")))
    assert got[0] == got[1] == (5.0, 5 / 1755)
    assert got[2:] == [(0.0, 0.0), (5.0, 1.0), (None, None), (6.0, 2.0)]


def test_unknown_rank_stays_null(spark):
    got = one(spark, [(None,), (2,)], "r int", F.coalesce(M.verdict_of_rank(F.col("r")), F.lit("empty")))
    assert got == [("empty",), ("incomplete",)]


def test_signed_amount_has_no_minus_zero(spark):
    got = one(spark, [("0.1", "credit"), ("0", "credit")], "a string, s string",
              M.signed_amount(F.col("a").cast(M.MONEY), F.col("s")).cast("double"))
    assert got[0] == (-0.1,) and math.copysign(1, got[1][0]) == 1


def test_texts(spark):
    rows = [(" 1,234 ",), ("12%",), ("-5.5",), ("1.2.3",), ("",), ("n/a",)]
    got = one(spark, rows, "t string", texts.looks_like_number(F.col("t")))
    assert [g[0] for g in got] == [True, True, True, False, False, False]
    good = "a" * 64
    got = one(spark, [(good,), (good + "\n",), (good.upper(),), (None,)], "t string", texts.is_sha256(F.col("t")))
    assert [g[0] for g in got] == [True, False, False, False]
    got = one(spark, [(" Acme\t", "ACME"), (None, ""), ("a", "b")], "a string, b string",
              texts.same_text(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == [True, True, False]
    assert one(spark, [("Net premium reserves",)], "t string", texts.initials(F.col("t"))) == [("NPR",)]


@pytest.mark.parametrize("formula,reason", [
    ("=A1+B2", None),
    ("=SUM(A1:A3,'My Tab'!B2)", None),
    ("=sum(A1)", None),
    ("{=SUM(A1:A2)}", "array formulas are not rebuilt"),
    ("='[x.xlsx]S'!A1", "other workbooks are not read"),
    ('=A1&"x"', "texts are not calculated with"),
    ("=VLOOKUP(A1,B1:C2,2)+IF(A1,1,2)", "IF, VLOOKUP (unsupported)"),
    ("=SUM(A1,5)", "SUM argument is not a plain reference (unsupported)"),
    ("=SUM(A1*2)", "SUM argument is not a plain reference (unsupported)"),
])
def test_unsupported_reason(spark, formula, reason):
    assert one(spark, [(formula,)], "f string", formulas.unsupported_reason(F.col("f"))) == [(reason,)]


@pytest.mark.parametrize("formula,values,result", [
    ("=1+2*3", {}, 7.0),
    ("=(1+2)*-3", {}, -9.0),
    ("=A1/B1", {0: 1.0, 1: 0.0}, None),
    ("=-A1--B1", {0: 2.0, 1: 3.0}, 1.0),
    ("=A1^2", {0: 2.0}, None),
    ("=A1:A3+1", {0: 2.0}, None),
    ("=rate*2", {}, None),
    ("=A1*1e5", {0: 1.0}, None),
    ("=.5*$A$1", {0: 3.0}, 1.5),
    ("=SUM((A1),B1)", {}, None),
])
def test_postfix_and_evaluate(spark, formula, values, result):
    df = spark.createDataFrame([(formula, values)], "f string, v map<int,double>")
    df = df.withColumn("p", formulas.postfix("f"))
    assert df.select(formulas.evaluate(F.col("p.tokens"), F.col("v"))).collect()[0][0] == result


def test_similarity_bands():
    s = S.label_similarity
    assert s("Technical provisions", "Technical provisions") == 100
    assert s("NPR Total", "Net premium reserves") >= S.CONFIDENT
    assert s("Technical provision", "Technical provisions") >= S.CONFIDENT
    assert s("Reserve for claims", "Zzyzx") < S.PLAUSIBLE
    assert s("", "x") == 0
    assert s("ring small", "small ring") == 95.0
    assert s("a b", "a b c d e f g h i") > 80
