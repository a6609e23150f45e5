"""Captures over time, merged properties, hierarchies and new labels."""

import os
import random

import pytest

from valprint.operators import chunked, hierarchy
from valprint.sources import store

MEMBER = "cid string, kind string, referenced string"


def sets(spark, **columns):
    return chunked.from_hashes(spark.createDataFrame([(c, h) for c, hs in columns.items() for h in hs], "cid string, h long"))


def members(spark, **kinds):
    return spark.createDataFrame([(c, k, None) for c, k in kinds.items()], MEMBER)


def read(spark, path, when, kinds=store.KINDS):
    out = {r["cid"]: set() for r in store.members_as_of(spark, path, when, kinds).collect()}
    for r in chunked.members(store.sets_as_of(spark, path, when, kinds)).collect():
        out[r["cid"]].add(r["h"])
    return out


def test_captures_over_time(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    assert store.captures(spark, path) == [] and read(spark, path, "2030-01-01") == {}
    a, b, c = set(range(0, 300_000, 7)), {1, 2, 3}, {9}
    store.capture(sets(spark, a=a, b=b, c=c), members(spark, a="pk", b="fk", c=None, empty="uk"), path, "2024-01-01")
    store.capture(sets(spark, a=a, b=b | {4}, d={5}), members(spark, a="pk", b="fk", d="uk"), path, "2024-02-01 08:00:00")
    assert read(spark, path, "2023-12-31") == {}
    assert read(spark, path, "2024-01-01") == read(spark, path, "2024-02-01 07:59:59") == {"a": a, "b": b, "empty": set()}
    assert read(spark, path, "2024-01-15", None) == {"a": a, "b": b, "c": c, "empty": set()}
    assert read(spark, path, "2024-01-15", ("fk",)) == {"b": b}
    assert read(spark, path, "2024-02-02") == {"a": a, "b": b | {4}, "d": {5}}
    held = {r["cid"]: r["held"] for r in store.members_as_of(spark, path, "2024-03-01").collect()}
    assert held == {"a": "c20240101000000", "b": "c20240201080000", "d": "c20240201080000"}
    written = {r["cid"] for r in spark.read.parquet(f"{path}/containers/capture=c20240201080000").collect()}
    assert written == {"b", "d"}  # what had not changed was not written again


def test_a_broken_capture_is_harmless(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store.capture(sets(spark, a={1}), members(spark, a="pk"), path, "2024-01-01")
    # it broke off after its containers, and again before its manifest was complete
    sets(spark, a={1, 2}).write.parquet(f"{path}/containers/capture=c20240201000000")
    store.members_as_of(spark, path, "2024-01-01").write.parquet(f"{path}/members/capture=c20240201000000")
    os.remove(f"{tmp_path}/store/members/capture=c20240201000000/_SUCCESS")
    assert read(spark, path, "2024-03-01") == {"a": {1}}
    store.capture(sets(spark, a={1, 3}), members(spark, a="pk"), path, "2024-02-01")
    assert read(spark, path, "2024-03-01") == {"a": {1, 3}} and store.captures(spark, path) == ["c20240101000000", "c20240201000000"]
    store.capture(sets(spark, a={7}), members(spark, a="pk"), path, "2024-02-01")  # a second time is no change
    assert read(spark, path, "2024-03-01") == {"a": {1, 3}}
    with pytest.raises(ValueError, match="later capture"):
        store.capture(sets(spark, a={7}), members(spark, a="pk"), path, "2024-01-15")
    with pytest.raises(ValueError, match="not a time"):
        store.members_as_of(spark, path, "yesterday")


def exact(spark, **columns):
    return chunked.exact(spark.createDataFrame([(c, v) for c, vs in columns.items() for v in vs], "cid string, val string"))


def test_values_of_one_hash_stay_apart(spark, tmp_path):
    """40186 and 797189 have one 32-bit hash; so a change from one to the other is seen, and both count."""
    path = f"file://{tmp_path}/store"
    for when, values in (("2024-01-01", ["40186", "x"]), ("2024-02-01", ["797189", "x"]), ("2024-03-01", ["40186", "797189", "x", "y"])):
        store.capture(exact(spark, a=values), members(spark, a="pk"), path, when)
    got = [[(r["n"], r["held"][:7]) for r in store.members_as_of(spark, path, w).collect()] for w in ("2024-01-15", "2024-02-15", "2024-03-15")]
    assert got == [[(2, "c202401")], [(2, "c202402")], [(4, "c202403")]]
    assert chunked.common(exact(spark, p=["40186", "y"]), store.sets_as_of(spark, path, "2024-02-15")).count() == 0
    assert chunked.common(exact(spark, p=["40186", "y"]), store.sets_as_of(spark, path, "2024-03-15")).first()["inter"] == 2


def test_digests_follow_members_alone(spark):
    one, two, other = (sets(spark, a=x) for x in (range(70_000), reversed(range(70_000)), range(1, 70_001)))
    d = [s.transform(store.digests).first() for s in (one, two.repartition(3), other)]
    assert d[0] == d[1] and d[0]["n"] == d[2]["n"] and d[0]["digest"] != d[2]["digest"]


def test_merged_and_faceted_properties(spark):
    schema = "object string, column string, property string, value string"
    target = spark.createDataFrame([("t", "a", "s.class", "key"), ("t", None, "s.note", "whole"), ("t", "b", "s.class", "measure"), ("t", "b", "x.class", "no")], schema)
    source = spark.createDataFrame([("t", "a", "s.class", None), ("t", None, "s.note", "again"), ("u", "c", "s.rows", "7")], schema)
    got = {tuple(r) for r in store.merged_rows(target, source, ["object", "column", "property"]).select(*target.columns).collect()}
    assert got == {("t", "a", "s.class", None), ("t", None, "s.note", "again"), ("t", "b", "s.class", "measure"), ("t", "b", "x.class", "no"), ("u", "c", "s.rows", "7")}
    faced = {tuple(r) for r in store.faceted(store.merged_rows(target, source, ["object", "column", "property"]), "s", ["class", "rows"]).collect()}
    assert faced == {("t", "a", None, None), ("t", "b", "measure", None), ("u", "c", None, "7")}


NODE = "id string, parent string, label string"


def plain_paths(rows):
    nodes = {i: (p, x) for i, p, x in rows}
    out = {}
    for i in nodes:
        labels, at, met = [], i, set()
        while at in nodes and at not in met:
            met.add(at)
            labels.append(nodes[at][1])
            root, at = at, nodes[at][0]
        out[i] = (None, None, None) if at in met else (" > ".join(x for x in reversed(labels) if x is not None), len(labels) - 1, root)
    return out


def test_paths_of_a_deep_chain_and_of_random_trees(spark):
    chain = [(f"n{i}", f"n{i - 1}" if i else None, f"l{i}") for i in range(300)]
    rng = random.Random(3)
    tree = [(f"t{i}", f"t{rng.randrange(i)}" if i and rng.random() < 0.95 else "no such", rng.choice(["x", "y", None])) for i in range(300)]
    loops = [("a", "b", "a"), ("b", "c", "b"), ("c", "a", "c"), ("self", "self", "s"), ("under", "a", "u"), ("far", "under", "f")]
    rows = chain + tree + loops
    rng.shuffle(rows)
    got = {r["id"]: (r["path"], r["depth"], r["root"]) for r in hierarchy.label_paths(spark.createDataFrame(rows, NODE)).collect()}
    assert got == plain_paths(rows) and got["n299"][1] == 299 and got["far"] == (None, None, None)


def test_paths_of_odd_nodes(spark):
    rows = [("a", None, "first"), ("a", None, "second"), (None, "a", "lost"), ("b", "a", "x")]
    got = {r["id"]: r["path"] for r in hierarchy.label_paths(spark.createDataFrame(rows, NODE)).collect()}
    assert got == {"a": "first", "b": "first > x"}
    assert hierarchy.label_paths(spark.createDataFrame([], NODE)).count() == 0


def test_new_labels_whatever_the_case(spark):
    df = lambda *x: spark.createDataFrame([(v,) for v in x], "label string")
    got = sorted(r[0] for r in hierarchy.new_labels(df("Acme", "ACME", "Bolt", "bolt", None, "Bolt", "New"), df("acme", None)).collect())
    assert got == ["Bolt", "New", "bolt"]
