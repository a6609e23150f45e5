"""Key triage, covers of many columns, best ways and join trees against plain Python."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from valprint.operators import catalog, match, triage


def cells(spark, columns):
    return spark.createDataFrame([(c, str(v)) for c, vs in columns.items() for v in vs], "cid string, val string")


def random_columns(seed):
    rng = np.random.default_rng(seed)
    columns = {f"key{i}": list(range(lo, lo + n)) for i, (lo, n) in enumerate([(1, 30), (1, 400), (1000, 2000), (-50, 700)])}
    columns |= {f"child{i}": rng.choice(columns[f"key{i % 4}"], 900).tolist() for i in range(6)}
    columns["mixed"] = [*rng.choice(columns["key2"], 500).tolist(), *range(9000, 9020)] * 2
    columns["padded"] = [f"0{v}" for v in columns["key0"]] * 2
    columns["names"] = [f"name{i % 50}" for i in range(300)]
    columns["named"] = [f"name{i}" for i in range(60)]
    columns["measure"] = rng.random(500).round(9).tolist()
    columns["huge"] = [10**30 + i for i in range(20)]
    return columns


@pytest.mark.parametrize("first", [4, 64, 512])
def test_no_reference_is_lost(spark, first):
    columns = random_columns(first)
    distinct = {c: {str(v) for v in vs} for c, vs in columns.items()}
    all_ = cells(spark, columns)
    summed = triage.summaries(all_, first).cache()
    pairs = triage.bounded_pairs(summed)
    found = {(r["child"], r["parent"]): r["bound"] for r in pairs.collect()}
    true = lambda a, b: len(distinct[a] & distinct[b]) / len(distinct[a])
    assert all(bound >= true(*p) - 1e-12 for p, bound in found.items())
    keys = {c for c, vs in columns.items() if len(distinct[c]) == len(vs) >= 8}
    # pairs left out before any bound are of different families
    number = lambda c: c not in ("names", "named", "measure")
    assert {p for p in itertools.product(distinct, keys) if p[0] != p[1] and number(p[0]) == number(p[1]) and "measure" not in p} == {p for p in found if "measure" not in p}
    exact = {(r["child"], r["parent"]): (r["containment"], r["violations"]) for r in triage.layered_keys(all_.distinct(), pairs, 0.9).collect()}
    assert exact == {(a, b): (true(a, b), len(distinct[a] - distinct[b])) for a, b in found if true(a, b) >= 0.9}
    # a threshold on the sizes first loses none either
    able = {(r["child"], r["parent"]): r["bound"] for r in triage.bounded_pairs(summed, threshold=0.9).collect()}
    assert able.items() <= found.items() and {p for p, b in found.items() if b >= 0.9} <= able.keys()
    pruned = sum(b < 0.9 for b in found.values()) / len(found)
    assert pruned > {4: 0.5, 64: 0.6, 512: 0.6}[first] and len(exact) >= 8


def test_numbers_written_in_two_ways_are_no_run_of_numbers(spark):
    # 01 and 1 are two values of one number: the ends of the child say nothing
    all_ = cells(spark, {"child": ["1", "01", "2", "02"] * 2, "parent": ["1", "01", "2", "02", "3", "4", "5", "6"]})
    r = triage.summaries(all_).filter("cid = 'child'").first()
    assert (r["low"], r["high"], r["whole"], r["n"], r["rows"]) == (None, None, True, 4, 8)
    assert [tuple(x) for x in triage.bounded_pairs(triage.summaries(all_)).select("child", "parent", "bound").collect()] == [("child", "parent", 1.0)]


def test_validated_keys_keep_pairs_without_a_hit(spark):
    sets = cells(spark, {"a": [1, 2, 3], "b": [1, 2], "c": ["x"]})
    keys = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "a")], "child string, parent string")
    assert {tuple(r) for r in match.validated_keys(sets, keys).collect()} == {("a", "b", 3, 2, 0.667), ("a", "c", 3, 0, 0.0), ("b", "a", 2, 2, 1.0)}


def test_compared_and_crossed_count_sizes_with_pairs(spark):
    columns = {"a": range(5), "b": range(3, 9), "c": range(100, 103), "d": [4]}
    sets = cells(spark, columns)
    s = {c: {str(v) for v in vs} for c, vs in columns.items()}
    want = {(a, b, len(s[a] & s[b]), len(s[a]), len(s[b])) for a in s for b in s if a != b and s[a] & s[b]}
    assert {tuple(r) for r in match.compared(sets).collect()} == want
    assert {tuple(r) for r in match.crossed(sets, sets).collect()} == want
    chosen = spark.createDataFrame([("b",), ("c",), ("no such",)], "cid string")
    assert {tuple(r) for r in match.compared(sets, chosen).collect()} == {x for x in want if x[1] in ("b", "c")}


def plain_covers(probes, domains, target, most, least):
    out = []
    for cid, values in probes.items():
        left, done = set(values), 0
        for pick in range(1, most + 1):
            gains = sorted((-len(left & d), name) for name, d in domains.items() if len(d) >= least and name != cid)
            if not gains or not gains[0][0] or done >= target * len(values):
                break
            gain, name = -gains[0][0], gains[0][1]
            left -= domains[name]
            done += gain
            out.append((cid, pick, name, gain / len(values), done / len(values)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_covers_of_all_columns(spark, seed):
    rng = np.random.default_rng(seed)
    domains = {f"d{i}": {str(v) for v in rng.choice(60, rng.integers(1, 25), replace=False)} for i in range(9)}
    probes = {f"p{i}": {str(v) for v in rng.choice(70, rng.integers(1, 50), replace=False)} for i in range(8)} | {"d1": domains["d1"], "none": {"-"}}
    for target, most, least in ((0.98, 4, 8), (0.5, 4, 2), (1.0, 2, 1)):
        got = match.domain_covers(cells(spark, probes), cells(spark, domains), target, most, least)
        assert sorted(map(tuple, got.collect())) == plain_covers(probes, domains, target, most, least)
    unions = {r["cid"]: (list(r["domains"]), r["is_union"]) for r in match.union_types(match.domain_covers(cells(spark, probes), cells(spark, domains), 1.0, 4, 1)).collect()}
    want = {}
    for cid, _, name, _, covered in plain_covers(probes, domains, 1.0, 4, 1):
        names = [*want.get(cid, ([], False))[0], name]
        want[cid] = (names, len(names) > 1 and covered >= 0.9)
    assert unions == want


HOPS = "consumer string, via_col string, producer string, confidence double"


def random_hops(seed, n=7, m=11):
    rng = np.random.default_rng(seed)
    return [(f"t{a}", f"c{i}", f"t{b}", float(rng.choice([1.0, 0.9, 0.75, 0.5]))) for i, (a, b) in enumerate(rng.integers(0, n, (m, 2)))]


@pytest.mark.parametrize("seed", range(3))
def test_best_paths(spark, seed):
    hops = random_hops(seed)
    best = {}

    def walk(path, at, met, confidence):
        for a, c, b, p in hops:
            if a == at and b not in met:
                way = [*path, f"{a}.{c}"]
                key = (-confidence * p, len(way), " > ".join(way))
                pair = (met[0], b)
                best[pair] = min(best.get(pair, key), key)
                walk(way, b, [*met, b], confidence * p)

    for t in {x for h in hops for x in (h[0], h[2])}:
        walk([], t, [t], 1.0)
    got = {(r["consumer"], r["producer"]): (-r["confidence"], r["hops"]) for r in catalog.best_paths(spark.createDataFrame(hops, HOPS)).collect()}
    assert got == {p: (pytest.approx(k[0]), k[1]) for p, k in best.items()}
    assert catalog.best_paths(spark.createDataFrame([], HOPS)).isEmpty()


@pytest.mark.parametrize("seed", range(4))
def test_join_trees_are_smallest(spark, seed):
    hops = random_hops(seed, 6, 8)
    edges = [h for h in hops if h[0] != h[2]]
    tables = sorted({x for h in edges for x in (h[0], h[2])})
    ends = tables[:: 2 if seed % 2 else 1][:4]

    def linked(chosen):
        reach = {ends[0]}
        while True:
            more = {x for a, _, b, _ in chosen if a in reach or b in reach for x in (a, b)} - reach
            if not more:
                return set(ends) <= reach
            reach |= more

    costs = [(len(c), sum(round((1 - h[3]) * 1e6) for h in c)) for k in range(len(edges) + 1) for c in itertools.combinations(edges, k) if linked(c)]
    got = [tuple(r) for r in catalog.join_tree(spark.createDataFrame(hops, HOPS), spark.createDataFrame([(t,) for t in ends], "tbl string")).collect()]
    if not costs:
        assert got == []
    else:
        assert linked(got) and (len(got), sum(round((1 - h[3]) * 1e6) for h in got)) == min(costs)
    with pytest.raises(ValueError, match="a tree of over"):
        catalog.join_tree(spark.createDataFrame(hops, HOPS), spark.createDataFrame([(f"x{i}",) for i in range(13)], "tbl string"))


def test_sources_are_the_same_domain_and_not_a_larger_one(spark):
    library = cells(spark, {"big.k": range(1000), "mid.k": range(100), "small.k": range(20)})
    slab = cells(spark, {"s.a": [*range(90), *range(90)], "s.b": range(18), "s.c": ["x"]})
    got = {r["cid"]: (r["source"], r["containment"], r["mutual"]) for r in match.sources(slab, library).collect()}
    assert got == {"s.a": ("mid.k", 1.0, 0.9), "s.b": ("small.k", 1.0, 0.9)}
