"""Expressions as rows and masks, page runs by ranges, and shape stability, against plain versions."""

import itertools
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from valprint.functions import charclass
from valprint.operators import expressions, pages, registry, stability

DEFINED = {
    "money": "has_dollar & has_digit", "clean_zip": "all_digits & len_5", "zip_no_dirt": "len_5 & !(has_upper)", "money_or_zip": "money | clean_zip", "flagged": "money_or_zip & !has_space",
    "postal5": "all_digits & len_5", "typo": "all_digits & len_55", "a": "b & has_digit", "b": "a | has_upper", "self": "self | has_upper", "hangs": "money & a", "far": "typo | money", "wrong": "money & & len_5",
}
SYMBOLS = ["60661", "60614", "90210", "10001", "INDIA", "H3P3C", "M1B5N", "JMCJS", "$9.50", "CHICAGO", "$ 5"]


def definitions(spark, defined=DEFINED):
    return spark.createDataFrame(list(defined.items()), "name string, expr string")


def test_registry_rows(spark):
    found = {r["name"]: r for r in expressions.registry(definitions(spark)).collect()}
    plain = registry.composites({n: e for n, e in DEFINED.items() if n != "wrong"})
    assert {n for n, r in found.items() if r["problem"] == "cycle"} == {"a", "b", "self", "hangs"}
    assert found["typo"]["problem"] == found["far"]["problem"] == "undefined: len_55" and found["far"]["depth"] == 1
    for n, p in plain.items():
        if p["valid"]:
            assert (found[n]["expanded"], found[n]["mask"], found[n]["problem"]) == (p["expanded"], p["mask"], None), n
    assert found["flagged"]["depth"] == 2 and found["flagged"]["expanded"] == "((has_dollar & has_digit) | (all_digits & len_5)) & !has_space"
    assert found["postal5"]["surrogate"] == found["clean_zip"]["surrogate"] != found["money"]["surrogate"]
    assert found["a"]["expanded"] is found["a"]["surrogate"] is None
    assert expressions.registry(definitions(spark).limit(0)).count() == 0


def test_matched_rows_equal_columns(spark):
    symbols = spark.createDataFrame([(s,) for s in [*SYMBOLS, SYMBOLS[0], None]], "sym string")
    got = {(r["name"], r["sym"]) for r in expressions.matched(symbols, definitions(spark)).collect()}
    want = {(r["name"], r["sym"]) for r in registry.composite_symbols(symbols, {n: e for n, e in DEFINED.items() if n != "wrong"}).collect()}
    assert got == want and ("zip_no_dirt", "60661") in got
    counted = {r["name"]: r["members"] for r in expressions.report(symbols, definitions(spark)).collect()}
    assert counted == {n: sum(name == n for name, _ in want) for n in DEFINED}


def test_a_long_chain_of_references(spark):
    chain = {"d0": "has_digit"} | {f"d{i}": f"d{i - 1} | has_dash" for i in range(1, 7)}
    found = {r["name"]: r["depth"] for r in expressions.registry(definitions(spark, chain)).collect()}
    assert found == {f"d{i}": i for i in range(7)}
    reach = {(r["name"], r["ref"]) for r in expressions.reachable(expressions.references(definitions(spark, chain))).collect()}
    assert reach == {(f"d{i}", f"d{j}") for i in range(7) for j in range(i)}


NAMES = ["has_digit", "has_upper", "has_lower", "len_5", "has_dash"]
texts = st.recursive(st.sampled_from(NAMES), lambda inner: st.one_of(inner.map(lambda x: f"!({x})"), inner.map(lambda x: f"~{x}"), st.tuples(inner, st.sampled_from("&|^"), inner).map(lambda t: f"({t[0]}{t[1]} {t[2]})"), st.tuples(inner, st.sampled_from("&|^"), inner).map(" ".join)), max_leaves=9)


@settings(max_examples=200, deadline=None)
@given(texts)
def test_clauses_mean_the_expression(text):
    """Python's own operators have the same order: ~ before & before ^ before |."""
    python = text.replace("!", "~")
    found = charclass.clauses(text)
    for values in itertools.product([False, True], repeat=len(NAMES)):
        sig = sum(1 << charclass.BITS[n] for n, v in zip(NAMES, values, strict=True) if v)
        want = eval(python, {}, {n: -int(v) for n, v in zip(NAMES, values, strict=True)}) != 0
        assert any(sig & need == need and sig & lack == 0 for need, lack in found) == want


def test_wrong_expressions_have_no_clauses():
    for text in ("", "has_digit &", "no_such", "(has_digit", "has_digit)", "has_digit has_upper", "a % b"):
        with pytest.raises(ValueError):
            charclass.clauses(text)
    with pytest.raises(ValueError, match="too many"):
        charclass.clauses(" ^ ".join(charclass.FEATURES.values()))
    assert charclass.clauses("has_digit & !has_digit") == [] and charclass.clauses("has_digit | !has_digit") == [(0, 1), (1, 0)]


@pytest.mark.parametrize("span", [2, 3, 16, 4096])
def test_runs_of_pages(spark, span):
    rng = random.Random(span)
    rows = [(p, rng.choice("aab")) for p in range(-20, 300) if rng.random() < 0.9] + [(10_000 + i, "a") for i in range(40)]
    want, last = [], None
    for p, s in rows:
        if last and last[3] == s and last[1] == p - 1:
            last[1], last[2] = p, last[2] + 1
        else:
            last = [p, p, 1, s]
            want.append(last)
    df = spark.createDataFrame(rows, "page_id int, signature string").repartition(3)
    got = sorted([r["start"], r["end"], r["pages"], r["signature"]] for r in pages.runs_of(df, span).collect())
    assert got == sorted(want)
    assert pages.runs_of(df.limit(0), span).count() == 0


def test_one_signature_on_very_many_pages(spark):
    signed = spark.range(1_000_000).select(F.col("id").alias("page_id"), F.when(F.col("id") == 700_000, "gap").otherwise("all").alias("signature"))
    got = {(r["start"], r["end"], r["pages"], r["signature"]) for r in pages.runs_of(signed).collect()}
    assert got == {(0, 699_999, 700_000, "all"), (700_000, 700_000, 1, "gap"), (700_001, 999_999, 299_999, "all")}


def test_samples_are_disjoint_and_alike_each_time(spark):
    df = spark.range(4000).select("id", (F.col("id") % 7).alias("seven"), F.col("id").alias("key"), F.lit(" ").alias("blank"), F.lit(None).cast("string").alias("none"))
    parts = stability.sampled_cells(df, "t", ["seven", "key", "blank", "none"], "id", 4, 50.0)
    rows = [(r["part"], r["cid"], r["val"]) for r in parts.collect()]
    assert sorted(rows) == sorted((r["part"], r["cid"], r["val"]) for r in stability.sampled_cells(df.repartition(5), "t", ["seven", "key", "blank", "none"], "id", 4, 50.0).collect())
    keys = [(p, v) for p, c, v in rows if c == "t.key"]
    assert len(keys) == len({v for _, v in keys}) and {c for _, c, _ in rows} == {"t.seven", "t.key"}
    assert all(400 < sum(p == q for p, _ in keys) < 600 for q in range(4))
    found = {r["cid"]: r for r in stability.shape_stability(parts).collect()}
    # a key repeats nothing in any sample; seven values over about 500 rows differ by their rows alone
    assert found["t.key"]["distance"] == found["t.key"]["spread"] == 0
    points = []
    for q in range(4):
        n = sum(p == q and c == "t.seven" for p, c, _ in rows)
        points.append((7 / n, math.log1p(n / 7) / math.log(1_000_001)))
    gaps = [math.dist(a, b) for a, b in itertools.combinations(points, 2)]
    assert found["t.seven"]["distance"] == pytest.approx(sum(gaps) / 6) and found["t.seven"]["spread"] == pytest.approx(max(gaps) - min(gaps)) and found["t.seven"]["samples"] == 4
    one = stability.shape_stability(parts.filter("part = 0")).first()
    assert one["samples"] == 1 and one["distance"] is None and one["ratio_deviation"] is None
