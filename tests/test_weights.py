"""Histograms as rows against those of one row, calls of formulas, and JSON documents."""

import collections
import json
import random

import pytest
from pyspark.sql import functions as F

from valprint.functions import histogram, sketch
from valprint.operators import formulas, weights
from valprint.sources.tables import json_rows


def test_rows_equal_the_histogram_of_one_row(spark):
    rng = random.Random(4)
    rows = [(f"c{rng.randrange(4)}", rng.choice([None, "a", "b", "c", "d", "e", "é"]), rng.choice([None, 0.0, 1.0, 2.5])) for _ in range(200)] + [("none", "a", 0.0)]
    df = spark.createDataFrame(rows, "cid string, val string, freq double")
    w = weights.weights(df).cache()
    whole = {r["cid"]: r["h"] for r in histogram.build_weighted(df, ["cid"], "val", "freq").toDF("cid", "h").collect()}
    for r in weights.shapes(w).collect():
        h = whole[r["cid"]]
        assert (r["steps"], r["total_rows"]) == (h["steps"], h["total_rows"])
        assert r["cardinality_ratio"] == pytest.approx(h["shape"]["cardinality_ratio"]) and r["repeatability"] == pytest.approx(h["shape"]["repeatability"])
    domains = {"one": ["a"], "two": ["a", "b", "b"], "same": ["b", "a"], "far": ["z"]}
    d = spark.createDataFrame([(k, v) for k, vs in domains.items() for v in vs], "cid string, val string")
    got = {(r["cid"], r["domain"]): r["held"] for r in weights.held(w, d).collect()}
    sets = d.groupBy("cid").agg(sketch.build("val").alias("s"))
    one = histogram.build_weighted(df, ["cid"], "val", "freq").crossJoin(sets.toDF("domain", "s")).select("cid", "domain", histogram.weighted_containment(F.col("histogram"), F.col("s")).alias("held"))
    want = {(r["cid"], r["domain"]): r["held"] for r in one.collect()}
    assert all(got.get(k, 0.0) == pytest.approx(v) for k, v in want.items()) and got["none", "one"] == 0.0
    best = {r["cid"]: (r["domain"], r["ties"]) for r in weights.classified(w, d).collect()}
    expected = {}
    for c in whole:
        most = max(v for (cid, _), v in want.items() if cid == c)
        first = sorted(d for (cid, d), v in want.items() if cid == c and v == most and d != "far")
        expected[c] = (first[0], len(first))
    assert best == expected and set(expected.values()) == {("one", 3), ("same", 2)}
    gaps = {(r["a"], r["b"]): r["distance"] for r in weights.distances(weights.shapes(w), spark.createDataFrame([("c0", "c1")], "a string, b string")).collect()}
    assert gaps["c0", "c1"] == pytest.approx(histogram_distance(whole["c0"], whole["c1"]))


def histogram_distance(a, b):
    import math

    log = lambda h: math.log1p(h["shape"]["repeatability"]) / math.log(1_000_001)
    return math.hypot(a["shape"]["cardinality_ratio"] - b["shape"]["cardinality_ratio"], log(a) - log(b))


def plain_calls(tokens):
    """Start and text of each call, by a stack."""
    out, stack = [], []
    for i, t in enumerate(tokens):
        if t == "(":
            stack.append(i - 1 if i and tokens[i - 1][0].isalpha() else None)
        elif t == ")" and stack:
            at = stack.pop()
            if at is not None:
                out.append((at, "".join(tokens[at : i + 1])))
    return sorted(out)


def test_calls_within_calls(spark):
    rng = random.Random(8)

    def made(depth):
        kind = rng.randrange(5 if depth else 2)
        if kind < 2:
            return [rng.choice(["@", "#"])]
        if kind == 2:
            return ["(", *made(depth - 1), rng.choice("+-*"), *made(depth - 1), ")"]
        if kind == 3:
            return [*made(depth - 1), ">=", *made(depth - 1)]
        inner = made(depth - 1)
        for _ in range(rng.randrange(3)):
            inner += [",", *made(depth - 1)]
        return [rng.choice(["SUM", "IF", "R1.X"]), "(", *inner, ")"]

    texts = {"".join(t): t for t in (made(5) for _ in range(60))} | {"SUM(@": ["SUM", "(", "@"], "@)+SUM(@)": ["@", ")", "+", "SUM", "(", "@", ")"], "(@)": ["(", "@", ")"]}
    found = collections.defaultdict(list)
    for r in formulas.calls(spark.createDataFrame([(t,) for t in texts], "skeleton string")).collect():
        found[r["skeleton"]].append((r["pos"], r["call"]))
    assert {t: sorted(found[t]) for t in texts} == {t: plain_calls(x) for t, x in texts.items()}


def test_support_and_cuts(spark):
    df = spark.createDataFrame([("s", "A1", "=SUM(B1:B2)+SUM(C1)"), ("s", "A2", "=IF(SUM(B3)>2,MAX(B4),0)"), ("s", "A3", "=B1"), ("s", "A4", None)], "sheet string, cell string, formula string")
    assert {r["call"]: r["n"] for r in formulas.call_support(df).collect()} == {"SUM(@)": 3, "MAX(@)": 1, "IF(SUM(@)>#,MAX(@),#)": 1}
    assert sorted((r["cell"], r["pos"], r["n"]) for r in formulas.guided_cuts(df).collect()) == [("A1", 0, 3), ("A1", 5, 3), ("A2", 2, 3)]
    known = spark.createDataFrame([("MAX(@)", 9)], "call string, n long")
    assert [(r["cell"], r["call"]) for r in formulas.guided_cuts(df, 5, known).collect()] == [("A2", "MAX(@)")]


def test_json_documents_by_file_and_by_line(spark, tmp_path):
    docs = [{"items": [{"k": 1}, {"k": 2}]}, {"items": [{"k": 3}]}, {"items": []}]
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.json").write_text("\n".join(json.dumps(d) for d in docs))
    (tmp_path / "files").mkdir()
    for i, d in enumerate(docs):
        (tmp_path / "files" / f"{i}.json").write_text(json.dumps(d, indent=1))
    read = lambda name, lines: sorted(r["k"] for r in json_rows(spark, str(tmp_path / name), "items", "k int", lines).collect())
    assert read("lines", True) == read("files", False) == [1, 2, 3]
