"""Golden values of the column functions."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from valprint.functions import charclass, codec, histogram, sketch
from valprint.functions.hashing import fold, normalized, sha256, value_hash, value_hash_normalized


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def values(df, c):
    return [r[0] for r in df.orderBy("i").select(c).collect()]


def sets(spark, *members):
    rows = [(i, m) for i, part in enumerate(members) for m in part]
    df = spark.createDataFrame(rows, "i int, v string").groupBy("i").agg(sketch.build("v").alias("s"))
    return {r["i"]: r["s"] for r in df.collect()}


def test_hash_vectors(spark):
    df = column(spark, ["hello", "California", "José", "", None])
    assert values(df, value_hash("v")) == [1335831723, 3551832919, 3133228423, 2166136261, None]


def test_normalisation(spark):
    df = column(spark, ["California", "CALIFORNIA", "José", "Jose", "ＡＢＣ", "ABC", "ß", "ﬁ", None])
    assert values(df, normalized("v")) == ["california", "california", "jose", "jose", "abc", "abc", "ss", "fi", None]
    h = values(df, value_hash_normalized("v"))
    assert h[0] == h[1] and h[2] == h[3] and h[4] == h[5] and h[8] is None


def test_sha256(spark):
    assert values(column(spark, ["abc"]), sha256("v")) == ["ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"]


def test_build_skips_null_and_gives_an_empty_set(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, None)], "g int, v string")
    found = {r["g"]: r["n"] for r in df.groupBy("g").agg(F.size(sketch.build("v")).alias("n")).collect()}
    assert found == {1: 1, 2: 0}


def test_json_arrays(spark):
    df = column(spark, ['["alpha","beta","gamma","alpha"]', "not json", '["a", 1, null, true, ["b"]]', "[]", None])
    assert values(df, F.size(sketch.from_json_array("v"))) == [3, 0, 1, 0, None]
    same = column(spark, ['["California","california","CALIFORNIA"]'])
    assert values(same, F.size(sketch.from_json_array("v", normalize=True))) == [1]
    assert values(same, F.size(sketch.from_json_array("v"))) == [3]


def test_set_algebra(spark):
    a, b = [str(i) for i in range(100)], [str(i) for i in range(50, 150)]
    s = sets(spark, a, b)
    df = spark.createDataFrame([(s[0], s[1], [])], "a array<bigint>, b array<bigint>, e array<bigint>")
    x, y, e = F.col("a"), F.col("b"), F.col("e")
    row = df.select(
        sketch.intersection_cardinality(x, y), sketch.containment(x, y), sketch.jaccard(x, y), F.size(sketch.union(x, y)), F.size(sketch.difference(x, y)), sketch.containment(e, x), sketch.jaccard(e, e),
        sketch.contains(x, x[0]), sketch.contains(x, F.lit(None).cast("bigint")), F.size(sketch.intersect(x, y)),
    ).first()
    assert list(row) == [50, 0.5, pytest.approx(1 / 3), 150, 50, 0.0, 1.0, True, False, 50]


def test_raw_arrays(spark):
    df = spark.createDataFrame([([5, 3, 3, None, (1 << 32) + 7],)], "v array<bigint>")
    assert df.select(sketch.from_array("v")).first()[0] == [3, 5, 7]


def test_probe_of_many(spark):
    s = sets(spark, ["foo", "bar", "unknown"], ["foo", "bar", "baz"], ["qux", "quux"])
    df = spark.createDataFrame([(s[0], [s[1], None, s[2]])], "p array<bigint>, r array<array<bigint>>")
    found = [(x["idx"], round(x["containment"], 4), x["jaccard"]) for x in df.select(sketch.probe_all(F.col("p"), F.col("r"))).first()[0]]
    assert found == [(0, 0.6667, 0.5), (2, 0.0, 0.0)]


def test_containment_of_json_and_plain_text(spark):
    s = sets(spark, ["CA", "NY"])
    df = column(spark, ['["CA","TX"]', "NY", "zz", "[broken"]).withColumn("s", F.array(*[F.lit(x) for x in s[0]]))
    assert values(df, sketch.containment_json(F.col("v"), F.col("s"))) == [0.5, 1.0, 0.0, 0.0]


def test_portable_sizes_and_checksum(spark):
    assert codec.encode(np.zeros(0)).hex() == "3a30000000000000"
    df = spark.createDataFrame([([],)], "s array<bigint>")
    assert df.select(codec.checksum(F.col("s"))).first()[0] == "0f483b868cd831d0846064a2fdd9b83c5c4946d4873ffb5b8c9a37224705b162"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 2**32 - 1), st.integers(65000, 66500)), max_size=300))
def test_portable_round_trip(members):
    assert codec.decode(codec.encode(np.array(members, np.int64))).tolist() == sorted(set(members))


def test_portable_large_and_runs():
    for m in (np.arange(500), np.arange(0, 200000, 3), np.arange(10000), np.concatenate([np.arange(70000), [2**32 - 1]])):
        assert codec.decode(codec.encode(m)).tolist() == m.tolist()


def test_base64_round_trip(spark):
    s = list(range(0, 3000, 7))
    df = spark.createDataFrame([(s,)], "s array<bigint>")
    text = df.select(codec.to_base64(F.col("s")).alias("t"))
    assert "\n" not in text.first()[0]
    assert text.select(codec.from_base64(F.col("t"))).first()[0] == s
    bad = spark.createDataFrame([("%%%",), ("AAAA",), (None,)], "t string")
    assert [r[0] for r in bad.select(codec.from_base64(F.col("t"))).collect()] == [None, None, None]


SIGNATURES = {
    "42": 17885560833, "CA": 140755513376770, "$1,234.56": 88236345000497, "2024-01-15": 35459921084481, "a@b.com": 281750659926036, "INV-0001": 35460055302211,
    "": 4294967296, "1999": 563019378589697, "é": 17716805632, "H3P3C": 140875833278467, "60661": 138144645121,
}


def test_signatures(spark):
    df = column(spark, [*SIGNATURES, None])
    assert values(df, charclass.signature("v")) == [*SIGNATURES.values(), None]


def test_feature_names(spark):
    df = column(spark, [0, 18, 49, 64], "int")
    assert values(df, charclass.feature_name(F.col("v"))) == ["has_digit", None, "year_shaped", None]
    names = column(spark, ["len_5", "is_all_caps"])
    assert values(names, charclass.feature_bit(F.col("v"))) == [37, None]
    assert charclass.vocabulary(spark).count() == 43


def test_expressions(spark):
    cases = [
        ("$9.50", "has_dollar & has_digit", True), ("CA", "all_upper & len_2", True), ("INV-0001", "all_upper & len_2", False), ("CA", "!has_digit", True),
        ("a", "has_upper & !has_lower | has_digit", False), ("1", "has_upper & !has_lower | has_digit", True), ("a", "has_upper ^ has_lower", True), ("Ab1", "(has_upper | has_digit) & has_lower", True),
        ("CA", "has_digit & bogus", None), ("CA", "& &", None), ("CA", "(has_upper", None), ("CA", "", None), ("CA", "has_upper has_lower", None), ("CA", "~has_digit", True),
    ]
    for value, text, want in cases:
        df = column(spark, [value])
        assert values(df, charclass.matches(charclass.signature("v"), text)) == [want], (value, text)


def test_profile(spark):
    df = spark.createDataFrame([("42",), ("CA",), ("99",), (None,)], "v string")
    found = {r["name"]: (r["n"], r["count"]) for r in charclass.profile(df, "v").collect()}
    assert found["all_digits"] == (3, 2) and found["all_upper"] == (3, 1) and found["len_2"] == (3, 3) and "has_dot" not in found
    assert '"n":3' in df.agg(charclass.profile_json("v")).first()[0]


def test_envelope(spark):
    df = column(spark, ["AL", "CA"]).select(charclass.signature("v").alias("sig"))
    need, allow = df.agg(charclass.necessary("sig"), charclass.envelope("sig")).first()
    probe = column(spark, ["TX", "T1", "TEX"])
    assert values(probe, charclass.plausible(charclass.signature("v"), F.lit(need), F.lit(allow))) == [True, False, False]


STATES = [("AL", 10000.0), ("CA", 50000.0), ("NY", 40000.0), ("TX", 35000.0), ("FL", 25000.0)]


def steps(spark, rows):
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], "g int, o int, k string, eq double, rng double, drng double")
    return histogram.build_steps(df, ["g"], "k", "eq", "rng", "drng", "o")


def test_histogram_of_steps(spark):
    h = steps(spark, [(k, n, 0.0, 0.0) for k, n in STATES])
    s = h.select("histogram.shape.*", F.size(histogram.bitmap(F.col("histogram"))).alias("n")).first()
    assert (s["repeatability"], s["discreteness"], s["range_density"], s["n"]) == (32000.0, 1.0, 0.0, 5)
    assert s["cardinality_ratio"] == pytest.approx(3.125e-05)
    domain = sets(spark, ["AL", "CA", "NY"])[0]
    got = h.select(histogram.weighted_containment(F.col("histogram"), F.array(*[F.lit(x) for x in domain]))).first()[0]
    assert got == pytest.approx(0.625)


def test_histogram_distances(spark):
    discrete = steps(spark, [(k, n, 0.0, 0.0) for k, n in STATES]).select(F.col("histogram").alias("a"))
    ranged = steps(spark, [(f"s{i}", 1.0, 5000.0, 500.0) for i in range(5)]).select(F.col("histogram").alias("b"))
    s = ranged.select("b.shape.*").first()
    assert s["cardinality_ratio"] == pytest.approx(0.10018, abs=1e-4) and s["repeatability"] == 1 and s["range_density"] == 500
    assert discrete.crossJoin(ranged).select(histogram.similarity(F.col("a"), F.col("b"))).first()[0] == pytest.approx(1.225151, abs=1e-5)


def test_weights_add_up_or_take_the_last(spark):
    df = spark.createDataFrame([(1, "CA", 100.0), (1, "ca", 50.0), (1, "Ca", 25.0), (1, None, 9.0), (1, "ny", None)], "g int, k string, w double")
    h = histogram.build_weighted(df, ["g"], "k", "w", normalize=True).select("histogram.*").first()
    assert sorted(h["weights"].values()) == [0.0, 175.0] and h["steps"] == 4
    last = steps(spark, [("x", 1.0, 0.0, 0.0), ("x", 5.0, 0.0, 0.0)]).select("histogram.*").first()
    assert list(last["weights"].values()) == [5.0] and last["total_equal_rows"] == 6.0


def test_sampled_weights(spark):
    df = spark.createDataFrame([(1, "CA", 50.0), (1, "NY", 40.0), (1, "TX", 35.0)], "g int, k string, w double")
    domain = sets(spark, ["CA", "NY"])[0]
    got = histogram.build_weighted(df, ["g"], "k", "w").select(histogram.weighted_containment(F.col("histogram"), F.array(*[F.lit(x) for x in domain]))).first()[0]
    assert got == pytest.approx(0.72)


def test_shape_and_wire(spark):
    h = steps(spark, [(k, n, 0.0, 0.0) for k, n in STATES])
    shaped = h.select(histogram.set_shape(F.col("histogram"), cardinality_ratio=0.01, data_type="varchar").alias("h"))
    assert '"cardinality_ratio":0.01' in shaped.select(histogram.shape_json(F.col("h"))).first()[0]
    assert '"data_type":"varchar"' in shaped.select(histogram.shape_json(F.col("h"))).first()[0]
    wire = h.select(histogram.to_wire(F.col("histogram")).alias("j"))
    back = wire.select(histogram.from_wire(F.col("j")).alias("b")).first()["b"]
    assert back["steps"] == 5 and back["total_equal_rows"] == 160000.0 and len(back["weights"]) == 5
    flat = spark.createDataFrame([('{"steps":2,"cardinality_ratio":0.5,"weights":{"7":3.0,"9":4.0}}',), ("broken",)], "j string")
    old = [r[0] for r in flat.select(histogram.from_wire(F.col("j"))).collect()]
    assert old[0]["shape"]["cardinality_ratio"] == 0.5 and old[0]["total_equal_rows"] == 7.0 and old[1] is None


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=20))
def test_fold_settles(text):
    assert fold(fold(text)) == fold(text) and pd.notna(fold(text))


def test_hash_of_a_long_value_is_linear(spark):
    import time

    from valprint.functions.hashing import value_hash

    df = spark.createDataFrame([("ab" * 500_000,)], "v string")
    began = time.time()
    got = df.select(value_hash("v").alias("h")).first()["h"]
    assert time.time() - began < 20
    h = 2166136261
    for b in b"ab" * 500_000:
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    assert got == h
