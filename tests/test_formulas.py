"""Formula structure on a small sheet."""

import random
import time
from collections import Counter

from pyspark.sql import functions as F

from valprint.operators import formulas

SHEET = [("s", "C2", "=A2*B2"), ("s", "C3", "= a3 * b3"), ("s", "C4", "=A4*B4"), ("s", "C5", "=A5*A5"), ("s", "D1", '=SUM(A1:A9)+IF(B1>10,"high",0)')]


def sheet(spark):
    return spark.createDataFrame(SHEET, "sheet string, cell string, formula string")


def test_skeletons(spark):
    got = {r[0]: tuple(r)[1:] for r in sheet(spark).select("cell", formulas.skeleton("formula"), formulas.skeleton("formula", indexed=True), formulas.depth("formula"), formulas.arity("formula"), formulas.functions_of("formula")).collect()}
    assert got["C3"] == ("@*@", "@1*@2", 0, 2, []) and got["C5"] == ("@*@", "@1*@1", 0, 1, [])
    assert got["D1"] == ("SUM(@)+IF(@>#,#,#)", "SUM(@1)+IF(@2>#,#,#)", 1, 2, ["IF", "SUM"])
    kept = sheet(spark).filter("cell = 'D1'").select(formulas.skeleton("formula", literals=False)).first()[0]
    assert kept == 'SUM(@)+IF(@>10,"HIGH",0)'


def test_clones_and_popular(spark):
    groups = {r["skeleton"]: r["n"] for r in formulas.clones(sheet(spark)).collect()}
    assert groups == {"@1*@2": 3, "@1*@1": 1, "SUM(@1)+IF(@2>#,#,#)": 1}
    assert [tuple(r) for r in formulas.popular(sheet(spark)).collect()] == [("@*@", 4)]


def test_similar_needs_the_same_domains(spark):
    kinds = "formula string, in_domains string, out_domain string"
    a = spark.createDataFrame([("=SUM(A1:A9)/2", "num", "num")], kinds)
    b = spark.createDataFrame([("=SUM(B1:B3)/4", "num", "num"), ("=SUM(B1:B4)/4", "text", "num"), ("=C1&D1", "num", "num")], kinds)
    assert [tuple(r) for r in formulas.similar(a, b).collect()] == [("=SUM(A1:A9)/2", "=SUM(B1:B3)/4", 1.0)]


KINDS = "formula string, in_domains array<string>, out_domain string"


def test_similar_equals_a_comparison_of_all_pairs(spark):
    rng = random.Random(5)
    part = lambda: rng.choice(["A{}", "B{}:C9", "SUM(A1:A{})", "IF(A{}>2,\"x y\",1)", "{}", "(A1+B{})", "MAX(B{},7)", "A{}<>B1", "\"\""]).format(rng.randint(1, 4))
    made = lambda n: [(rng.choice([None, "", "="] + 9 * ["=" + "".join(part() + rng.choice(["+", "*", "<", ">", "&", " "]) for _ in range(rng.randint(0, 3))) + part()]), rng.choice([["a"], ["a", "b"], None]), rng.choice(["x", "y", None])) for _ in range(n)]
    a, b = made(300), made(90)
    texts = {f for f, _, _ in a + b if f is not None}
    shapes = {r["formula"]: set(r["s"]) for r in spark.createDataFrame([(f,) for f in texts], "formula string").select("formula", formulas.shapes("formula").alias("s")).collect()}
    key = lambda r: (r[0], tuple(r[1] or ()), r[2])
    each = lambda rows: {key(r) for r in rows if None not in r}
    want = Counter()
    for f, i, o in each(a):
        for m, j, p in each(b):
            common = len(shapes[f] & shapes[m])
            if (i, o) == (j, p) and common and common / len(shapes[f] | shapes[m]) >= 0.1:
                want[f, m, round(common / len(shapes[f] | shapes[m]), 9)] += 1
    got = Counter((r[0], r[1], round(r[2], 9)) for r in formulas.similar(spark.createDataFrame(a, KINDS), spark.createDataFrame(b, KINDS), 0.1).collect())
    assert got == want and len(want) > 50
    assert formulas.similar(spark.createDataFrame([], KINDS), spark.createDataFrame(b, KINDS)).count() == 0


def test_many_formulas_of_few_forms_are_compared_by_form(spark):
    """Each formula was cut up once a shape before, which took some milliseconds each."""
    kinds = [F.array(F.lit("n")).alias("in_domains"), F.lit("n").alias("out_domain")]
    many = spark.range(40_000).select(F.format_string("=IF(SUM(A1:A4)>%d,SUM(B1:B4)*2,ROUND(C4/3,2))+MAX(A1,%d)*(B1-C1)/VLOOKUP(D1,A1:C9,2)", "id", "id").alias("formula"), *kinds)
    began = time.monotonic()
    assert formulas.similar(many, many.limit(3)).groupBy("jaccard").count().collect() == [(1.0, 120_000)]
    assert time.monotonic() - began < 60


def test_null_formula(spark):
    df = spark.createDataFrame([(None,), ("",)], "formula string")
    assert [r[0] for r in df.select(F.size(formulas.shapes("formula"))).collect()][1] == 1
