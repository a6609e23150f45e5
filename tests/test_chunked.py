"""Chunked sets against Python sets, with dense and sparse containers."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from valprint.functions import codec, containers, sketch
from valprint.functions.hashing import value_hash
from valprint.operators import chunked

SETS = {
    "small": {0, 1, 63, 64, 65535, 65536, (1 << 32) - 1},
    "dense": set(range(0, 130_000, 3)) | set(range(7 << 16, (7 << 16) + 5000)),
    "edge": set(range(3 << 16, (3 << 16) + 4096)),
    "over": set(range(3 << 16, (3 << 16) + 4097)),
    "sparse": {i * 2_654_435_761 % (1 << 32) for i in range(3000)},
    "apart": {5_000_001},
}


def table(spark, sets=SETS):
    """The sets with each member twice, a null and a number beyond 32 bits."""
    rows = [(c, h) for c, hs in sets.items() for h in [*hs, *hs]] + [("apart", None), ("apart", (1 << 32) + 5_000_001)]
    return chunked.from_hashes(spark.createDataFrame(rows, "cid string, h long").repartition(3))


def read(df):
    out = {}
    for r in chunked.members(df).collect():
        assert r["h"] not in out.setdefault(r["cid"], set())
        out[r["cid"]].add(r["h"])
    return out


@pytest.fixture(scope="module")
def built(spark):
    return table(spark).cache()


def test_members_and_sizes(spark, built):
    assert read(built) == SETS
    assert {r["cid"]: r["n"] for r in chunked.cardinality(built).collect()} == {c: len(s) for c, s in SETS.items()}
    assert all(len(r["data"]) == (8192 if r["card"] > 4096 else 2 * r["card"]) for r in built.collect())


def test_common_members_of_pairs(spark, built):
    found = {(r["ca"], r["cb"]): (r["inter"], r["containment"], r["jaccard"]) for r in chunked.measures(built, built, F.col("ca") < F.col("cb")).collect()}
    want = {(a, b): (len(x & y), len(x & y) / len(x), len(x & y) / len(x | y)) for a, x in SETS.items() for b, y in SETS.items() if a < b}
    assert found == want
    assert {(r["ca"], r["cb"]) for r in chunked.common(built, built).collect()} == {(a, b) for a in SETS for b in SETS if SETS[a] & SETS[b]}


@pytest.mark.parametrize(("how", "op"), [("intersect", set.intersection), ("union", set.union), ("difference", set.difference)])
def test_algebra(spark, built, how, op):
    others = {"small": SETS["sparse"] | {63, 1}, "dense": SETS["over"] | set(range(0, 130_000, 2)), "edge": {3 << 16}, "new": {9}}
    b = table(spark, others | {"apart": set()})
    want = {c: op(SETS.get(c, set()), others.get(c, {5_000_001} if c == "apart" else set())) for c in SETS.keys() | others.keys()}
    if how == "difference":
        want.pop("new", None)
    assert read(chunked.combined(built, b, how)) == {c: s for c, s in want.items() if s}


def test_states_of_a_set_merge(spark, built):
    more = table(spark, {"dense": set(range(130_000)), "small": {2, 63}})
    assert read(chunked.merged(built.unionByName(more))) == SETS | {"dense": SETS["dense"] | set(range(130_000)), "small": SETS["small"] | {2, 63}}


def test_bytes_go_out_and_come_back(spark, built):
    sent = chunked.exported(built)
    for r in sent.collect():
        assert bytes(r["data"]) == codec.encode(np.array(sorted(SETS[r["cid"]]))), r["cid"]
    wrong = spark.createDataFrame([("none", bytearray(b"no set")), ("null", None), ("empty", bytearray(codec.encode(np.array([]))))], "cid string, data binary")
    assert read(chunked.imported(sent.unionByName(wrong))) == SETS


def test_sets_that_hold_a_hash(spark, built):
    probes = [0, 1, 3, 64, 4095 + (3 << 16), 4096 + (3 << 16), 12345, None, 0, (1 << 32) - 1]
    found = {(r["cid"], r["h"]) for r in chunked.holding(built, spark.createDataFrame([(p,) for p in probes], "h long")).collect()}
    assert found == {(c, p) for c, s in SETS.items() for p in probes if p in s}


def test_values_equal_the_sets_of_one_row(spark):
    values = spark.createDataFrame([("a", x) for x in ["x", "y", "x", "É", "é", None]] + [("b", "x")], "cid string, val string")
    for fold in (False, True):
        want = {r["cid"]: set(r["s"]) for r in values.groupBy("cid").agg(sketch.build("val", fold).alias("s")).collect()}
        assert read(chunked.build(values, fold)) == want


def test_registry_filters_hold_folded_labels(spark):
    import base64

    from valprint.operators import registry

    rows = spark.createDataFrame([("d", "Été"), ("d", "ete"), ("d", "x"), ("d", None), ("e", "X")], "domain_name string, label string")
    got = {r["domain_name"]: r for r in registry.enumerations(rows).collect()}
    hashes = {r["h"] for r in spark.sql("select 'x' v union all select 'ete'").select(value_hash("v").alias("h")).collect()}
    assert got["d"]["member_count"] == 2 and set(codec.decode(base64.b64decode(got["d"]["filter_b64"])).tolist()) == hashes and got["e"]["member_count"] == 1


#: Values of one 32-bit hash: two pairs of whole numbers, one of texts.
COLLIDING = ["40186", "797189", "40187", "797188", "346d78d6", "6ed765a8"]


def test_exact_sets_of_any_values(spark):
    odd = ["0", "-0", "+7", "7", "007", "-1", "-65536", "-65537", str(2**63 - 1), str(-(2**63)), str(2**63), "4294967303", "7.0", "1e3", "é", "e", "a,b", "41,42", " ", "", "\x00"]
    dense = [str(i) for i in range(-70_000, 70_000)]
    sets = {"a": {*COLLIDING, *odd}, "b": {*COLLIDING[::2], *odd[::3], "more"}, "c": {*dense, "x"}, "d": {*dense[::2], *odd[1::2], "6ed765a8"}}
    df = lambda s: spark.createDataFrame([(c, v) for c, vs in s.items() for v in [*vs, *vs]] + [("a", None), ("none", None)], "cid string, val string").repartition(3)
    one = chunked.exact(df(sets)).cache()
    assert {r["cid"]: r["n"] for r in chunked.cardinality(one).collect()} == {c: len(s) for c, s in sets.items()}
    assert {(r["ca"], r["cb"]): r["inter"] for r in chunked.common(one, one).collect()} == {(a, b): len(x & y) for a, x in sets.items() for b, y in sets.items() if x & y}
    again = chunked.exact(df({c: reversed(sorted(s)) for c, s in sets.items()}).repartition(5))
    assert sorted(map(repr, one.collect())) == sorted(map(repr, again.collect()))  # the same rows whatever the order
    assert one.filter("cid = 'c' and card = 65536").count() == 2 and one.filter("cid = 'c'").count() == 5


def test_exact_numbers_take_part_in_algebra_and_texts_are_refused(spark):
    df = lambda *vs: chunked.exact(spark.createDataFrame([("a", v) for v in vs], "cid string, val string"))
    one, two = df("-1", "5", str(1 << 40)), df("5", "6")
    assert read(chunked.combined(one, two, "union")) == read(chunked.merged(one.unionByName(two))) == {"a": {-1, 5, 6, 1 << 40}}
    assert read(chunked.combined(one, two, "difference")) == {"a": {-1, 1 << 40}}
    for made in (chunked.members(df("x")), chunked.merged(df("x")), chunked.combined(df("x"), two, "union"), chunked.exported(df("x")), chunked.exported(one)):
        with pytest.raises(Exception, match="sets of texts have no numbers|only 32-bit numbers have portable bytes"):
            made.collect()


def test_no_sets(spark, built):
    none = built.filter("cid = 'no such'")
    assert chunked.merged(none).count() == chunked.exported(none).count() == chunked.common(none, built).count() == chunked.members(none).count() == 0
    assert read(chunked.combined(none, built, "union")) == SETS


def test_no_task_holds_a_set(spark):
    """Two million members: the largest group of any shuffle is a container's words, whatever the set."""
    h = spark.range(2_000_000).select(F.lit("big").alias("cid"), (F.col("id") * 2_654_435_761 % (1 << 32)).alias("h"))
    sets = chunked.from_hashes(h)
    assert chunked.cardinality(sets).first()["n"] == 2_000_000
    assert sets.agg(F.max("card")).first()[0] < 65536 / 1000 and sets.count() == 65536


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 65535), max_size=30), min_size=1, max_size=5), st.lists(st.sets(st.integers(0, 65535), max_size=30), min_size=5, max_size=5), st.booleans())
def test_containers(xs, ys, dense):
    n = len(xs)
    if dense:
        xs[0] = xs[0] | set(range(100, 5000))
    sides = []
    for side in (xs, ys[:n]):
        keys = np.array(sorted((i << 16) | v for i, s in enumerate(side) for v in s), np.int64)
        cards, data = containers.pack(keys, n)
        assert containers.expand(cards, data).tolist() == keys.tolist() and cards.tolist() == [len(s) for s in side]
        both = pa.concat_arrays([data, data]).slice(n)
        assert containers.expand(cards, both).tolist() == keys.tolist()
        sides.append(keys)
    for how, op in (("intersect", set.intersection), ("union", set.union), ("difference", set.difference)):
        want = sorted((i << 16) | v for i, (x, y) in enumerate(zip(xs, ys[:n], strict=True)) for v in op(x, y))
        assert containers.combine(how, *sides).tolist() == want
