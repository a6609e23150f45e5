"""Relational operators on small tables, with values from hand or from plain Python."""

import pytest
from pyspark.sql import functions as F

from valprint.operators import catalog, cells, match, pages, registry
from valprint.streaming import sketches


def sets(spark, **columns):
    return spark.createDataFrame([(c, str(v)) for c, vs in columns.items() for v in vs], "cid string, val string").distinct()


def test_cells_drop_null_and_blank(spark):
    df = spark.createDataFrame([(1, " x "), (2, None), (None, "  ")], "a int, b string")
    assert sorted(map(tuple, cells.cells(df, "t").collect())) == [("t.a", "1"), ("t.a", "2"), ("t.b", "x")]


def test_canonical(spark):
    df = spark.createDataFrame([("008",), ("8",), ("0",), ("ab1",), ("00000000000000000000000000012",)], "v string")
    assert [r[0] for r in df.select(cells.canonical("v")).collect()] == ["8", "8", "0", "AB1", "12"]


def test_families(spark):
    df = spark.createDataFrame([("i", "1"), ("i", "-2"), ("n", "1.5"), ("n", "2"), ("s", "x"), ("s", "1"), ("e", None)], "c string, v string")
    found = {r[0]: r[1] for r in df.groupBy("c").agg(cells.family(F.col("v"))).collect()}
    assert found == {"i": "integer", "n": "numeric", "s": "string", "e": "string"}


def test_probe_keeps_domains_without_hits(spark):
    domains = sets(spark, states=["AL", "CA", "NY"], money=["USD", "EUR"])
    probe = spark.createDataFrame([("CA",), ("CA",), ("NY",), ("??",), (None,)], "val string")
    found = {r["domain"]: (r["hits"], round(r["containment"], 4), r["jaccard"]) for r in match.probe(probe, domains).collect()}
    assert found == {"states": (2, 0.6667, 0.5), "money": (0, 0.0, 0.0)}


def test_matrix_and_matches(spark):
    s = sets(spark, a=range(50), b=range(77), c=range(1000, 1010))
    m = match.containment_matrix(s)
    got = {(r["ca"], r["cb"]): r["containment"] for r in m.collect()}
    assert got == {("a", "b"): 1.0, ("b", "a"): 0.649}
    assert {r["source_column"]: r["best_match"] for r in match.best_match(m).collect()} == {"a": "b", "b": "a"}
    assert match.mutual(m).filter("ca = 'a'").first()["mc"] == pytest.approx(50 / 77)


def test_discovered_keys(spark):
    s = sets(spark, child=range(10), parent=range(50), tiny=range(3))
    keys = spark.createDataFrame([("parent",), ("tiny",)], "cid string")
    assert [tuple(r) for r in match.discovered_keys(s, keys).filter("child = 'child'").collect()] == [("child", "parent", 1.0, 50)]


def test_cover_of_a_union(spark):
    s = sets(spark, region=range(1, 51), currency=["USD", "EUR", "GBP", "JPY"])
    v = spark.createDataFrame([("3",), ("7",), ("USD",), ("EUR",)], "val string")
    found = [(r["domain"], r["marginal"], r["coverage"]) for r in match.domain_cover(v, s, least=2).orderBy("pick").collect()]
    assert found == [("currency", 0.5, 0.5), ("region", 0.5, 1.0)]
    assert match.domain_cover(v.limit(0), s).count() == 0


def test_leader_clusters(spark):
    s = sets(spark, region=range(1, 51), sheet=[*range(1, 49), 999], other=["x", "y"])
    found = {r["cid"]: (r["leader"], round(r["jaccard"], 2)) for r in match.leader_clusters(s).collect()}
    assert found == {"region": ("region", 1.0), "sheet": ("region", 0.94), "other": ("other", 1.0)}


def test_leader_clusters_follow_a_chain(spark):
    # b resembles a, c resembles b alone, so c leads itself
    s = sets(spark, a=range(100), b=range(10, 109), c=range(20, 118))
    found = {r["cid"]: r["leader"] for r in match.leader_clusters(s).collect()}
    jac = lambda x, y: len(x & y) / len(x | y)
    assert jac(set(range(100)), set(range(20, 118))) < 0.8 <= jac(set(range(100)), set(range(10, 109)))
    assert found == {"a": "a", "b": "a", "c": "c"}


def test_components_and_labels(spark):
    s = sets(spark, a=range(100), b=range(5, 105), c=range(10, 110), z=["p", "q"])
    c = match.induced_domains(s, 0.9)
    assert {r["cid"]: r["component"] for r in c.collect()} == {"a": "a", "b": "a", "c": "a", "z": "z"}
    labels = match.labelled(c, s, sets(spark, numbers=range(200)))
    assert {r["induced_domain"]: (r["best_authority"], r["verdict"]) for r in labels.collect()} == {"a": ("numbers", "labelled"), "z": ("(no authority)", "unlabelled")}


def test_slab(spark):
    library = sets(spark, region=range(1, 51), product=range(1000, 1100), currency=["USD", "EUR", "GBP", "JPY"])
    families = spark.createDataFrame([("region", "integer"), ("product", "integer"), ("currency", "string")], "cid string, family string")
    slab = sets(spark, c0=[3, 7, 9, 11], c1=[1001, 1002, 1050, 1099], c2=["17.5", "2.25", "8", "9"])
    found = {r["cid"]: (r["role"], r["domain"]) for r in match.recognised_columns(slab, library, families).filter("place = 1 or place is null").collect()}
    assert found == {"c0": ("key", "region"), "c1": ("key", "product"), "c2": ("measure", None)}


def test_pages(spark):
    tokens = spark.createDataFrame([(p, t) for p, ts in {1: ["x"], 2: ["CA", "a"], 3: ["NY"], 5: ["CA"], 6: [""]}.items() for t in ts], "page_id int, text string")
    m = pages.page_domains(tokens, sets(spark, states=["CA", "NY"]))
    assert {r["page_id"]: r["hits"] for r in m.collect()} == {2: 1, 3: 1, 5: 1}
    assert sorted(tuple(r) for r in pages.page_runs(m).collect()) == [(2, 3, 2, "states"), (5, 5, 1, "states")]


def test_step_classes(spark):
    rows = [("a", 5.0, 0.0, 0.0, 1.0)] * 3 + [("b", 200.0, 0.0, 0.0, 1.0)] * 3 + [("c", 1.0, 9.0, 9.0, 1.0)] * 3
    f = catalog.step_features(spark.createDataFrame(rows, "g string, equal_rows double, range_rows double, distinct_range_rows double, average_range_rows double"), ["g"])
    got = {r["g"]: r["c"] for r in f.select("g", catalog.step_class(F.lit(False), F.lit(0)).alias("c")).collect()}
    assert got == {"a": "ambiguous", "b": "low-cardinality dimension", "c": "measure"}
    keyed = f.select(catalog.step_class(F.lit(True), F.lit(1)), catalog.step_class(F.lit(False), F.lit(2)), catalog.step_class(F.lit(False), F.lit(1))).first()
    assert list(keyed) == ["dimension key", "degenerate dimension", "surrogate key"]


COMPOSITES = {
    "money": "has_dollar & has_digit", "clean_zip": "all_digits & len_5", "zip_no_dirt": "len_5 & !(has_upper)", "money_or_zip": "money | clean_zip", "flagged": "money_or_zip & !has_space",
    "postal5": "all_digits & len_5", "typo": "all_digits & len_55", "a": "b & has_digit", "b": "a | has_upper",
}
SYMBOLS = ["60661", "60614", "90210", "10001", "INDIA", "H3P3C", "M1B5N", "JMCJS", "$9.50", "CHICAGO"]


def test_composites(spark):
    c = registry.composites(COMPOSITES)
    assert {n for n, x in c.items() if not x["valid"]} == {"typo", "a", "b"}
    assert c["a"]["problem"] == "cycle" and c["typo"]["problem"] == "undefined: len_55"
    found = {r["name"]: (r["surrogate"], r["matched"]) for r in registry.composite_matches(spark.createDataFrame([(s,) for s in SYMBOLS], "sym string"), COMPOSITES).collect()}
    assert found["clean_zip"] == found["postal5"] and found["clean_zip"][1] == "10001, 60614, 60661, 90210"
    assert found["money"][1] == "$9.50" and found["zip_no_dirt"][1] == "$9.50, 10001, 60614, 60661, 90210" == found["flagged"][1]


def test_envelope_report(spark):
    members = spark.createDataFrame([("us_state", x) for x in ("AL", "CA", "NY")] + [("small_int", str(i)) for i in range(1, 101)], "domain string, m string")
    declared = spark.createDataFrame([("us_state", x) for x in ("all_upper", "len_2", "single_token", "title_case", "is_all_caps")] + [("small_int", "all_digits"), ("small_int", "single_token")], "domain string, feature_name string")
    assert [tuple(r) for r in registry.broken_features(declared).collect()] == [("us_state", "is_all_caps")]
    got = {r["domain"]: (set(r["underdeclared"].split(",")), r["overdeclared"]) for r in registry.envelope_report(members, declared).collect()}
    assert got["us_state"] == ({"has_upper", "all_alpha", "alnum_only", "leads_alpha", "code_shaped"}, "title_case")
    assert got["small_int"] == ({"has_digit", "alnum_only", "leads_digit"}, "")


def test_stragglers(spark):
    s = spark.createDataFrame([(x,) for x in ("60661", "60614", "90210", "10001", "33101", "INDIA", "H3P3C", "M1B5N", "JMCJS")], "sym string")
    assert list(registry.refined_counts(s, "len_5", "len_5 & !(has_upper)", "all_digits").first()) == [9, 5, 4, 0, 0]
    perfect = {r["term"] for r in registry.discriminators(s, "len_5", "all_digits").collect() if (r["pct_in_stragglers"], r["pct_in_keepers"]) == (100.0, 0.0)}
    assert perfect == {"has_upper", "leads_alpha", "code_shaped"}


def test_registry_forms(spark):
    df = spark.createDataFrame([("7", "wheat", ["corn ", "", "wheat"])], "code string, d string, alt array<string>")
    got = df.select(registry.code_forms(F.col("code"), F.col("d"), 4), registry.labels_of(F.col("d"), F.col("alt"))).first()
    assert list(got[0]) == ["7", "0007", "wheat", "7 wheat"] and list(got[1]) == ["wheat", "corn"]
    old = spark.createDataFrame([("x", 1), ("y", 2)], "domain_name string, n int")
    new = spark.createDataFrame([("y", 3)], "domain_name string, n int")
    assert sorted(map(tuple, registry.refreshed(old, new).collect())) == [("x", 1), ("y", 3)]


def test_boxes_beside_each_other(spark):
    rows = [(1, 200.0, 10.0, "model"), (1, 50.0, 14.0, "maker"), (1, 50.0, 15.5, "far"), (2, 50.0, 10.0, "other page")]
    df = spark.createDataFrame(rows, "page_id int, x double, y double, text string")
    assert [tuple(r) for r in registry.near_boxes(df, (140, 350), (20, 130), 5).collect()] == [(1, "model", "maker")]


def test_catalog_questions(spark):
    found = spark.createDataFrame([("t.a", "d", 0.9), ("u.b", "d", 0.8), ("v.c", "d", 0.4)], "cid string, domain string, containment double")
    assert [tuple(r) for r in catalog.shared_domains(found).collect()] == [("d", "t.a", "u.b")]
    assert sorted(map(tuple, catalog.join_graph(found).collect())) == [("t", "u", "a"), ("u", "t", "b")]
    assert [tuple(r) for r in catalog.aliases(found).collect()] == [("d", "a")]


def test_streamed_windows_equal_the_batch(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", "k", "a"), ("2024-01-01 00:02:00", "k", "b"), ("2024-01-01 01:30:00", "k", "a"), ("2024-01-01 09:00:00", "k", "z")]
    df = spark.createDataFrame(rows, "ts string, d string, v string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = sketches.windowed_sets(stream, "d", "v", "ts").writeStream.format("memory").queryName("windowed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r["start"].hour, len(r["members"])) for r in spark.table("windowed").collect())
    assert got[:2] == [(0, 2), (1, 1)]


def test_overlaps_of_a_value_in_very_many_columns(spark):
    from valprint.operators import match

    rows = [(f"c{i:04}", "0") for i in range(400)] + [("c0000", "1"), ("c0001", "1")]
    sets = spark.createDataFrame(rows, "cid string, val string")
    got = match.overlaps(sets, sets)
    assert got.count() == 400 * 399 and got.filter("inter = 2").count() == 2


def test_reference_paths_end_in_cycles(spark):
    hops = spark.createDataFrame([("a", "x", "b", 1.0), ("b", "y", "c", 0.5), ("c", "z", "a", 1.0), ("d", "me", "d", 1.0)], "consumer string, via_col string, producer string, confidence double")
    got = {(r["consumer"], r["producer"], r["path"], r["hops"], r["confidence"]) for r in catalog.reference_paths(hops).collect()}
    assert got == {("a", "b", "a.x", 1, 1.0), ("b", "c", "b.y", 1, 0.5), ("c", "a", "c.z", 1, 1.0), ("a", "c", "a.x > b.y", 2, 0.5), ("b", "a", "b.y > c.z", 2, 0.5), ("c", "b", "c.z > a.x", 2, 1.0)}
    assert catalog.reference_paths(hops.limit(0)).isEmpty()


def test_declared_family_strips_sizes_and_case(spark):
    rows = spark.createDataFrame([("DECIMAL(15, 2)",), (" Int ",), ("blob",), (None,)], "kind string")
    got = [r[0] for r in rows.select(catalog.declared_family(F.col("kind"), {"decimal": "numeric", "INT": "integer"})).collect()]
    assert got == ["numeric", "integer", None, None]


def test_composite_symbols_are_rows(spark):
    symbols = spark.createDataFrame([("AB",), ("A-B",), ("ab",), (None,)], "sym string")
    got = {(r["name"], r["sym"]) for r in registry.composite_symbols(symbols, {"up": "has_upper & !has_lower", "dashed": "up & has_dash", "loop": "loop"}).collect()}
    assert got == {("up", "AB"), ("up", "A-B"), ("dashed", "A-B")}
