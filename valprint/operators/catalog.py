"""Questions to a catalog of columns and the domains found in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valprint.sources.scratch import dropped, written


def shared_domains(found: DataFrame, threshold: float = 0.5) -> DataFrame:
    """domain, col_a, col_b of pairs of columns with a domain over the threshold in both. found: cid, domain, containment."""
    strong = found.filter(F.col("containment") > threshold)
    return strong.select("domain", F.col("cid").alias("col_a")).join(strong.select("domain", F.col("cid").alias("col_b")), "domain").filter("col_a < col_b")


def join_graph(found: DataFrame, threshold: float = 0.7) -> DataFrame:
    """left_table, right_table, join_column: tables with columns of one domain. Column ids are `table.column`."""
    strong = found.filter(F.col("containment") > threshold).select("domain", F.substring_index("cid", ".", 1).alias("tbl"), F.substring_index("cid", ".", -1).alias("col"))
    right = strong.select("domain", F.col("tbl").alias("right_table")).distinct()
    return strong.join(right, "domain").filter(F.col("tbl") != F.col("right_table")).select(F.col("tbl").alias("left_table"), "right_table", F.col("col").alias("join_column")).distinct()


def aliases(found: DataFrame, threshold: float = 0.8, measure: str = "containment") -> DataFrame:
    """domain and alias: names of columns that hold a domain. measure may be a mutual containment."""
    return found.filter(F.col(measure) > threshold).select("domain", F.substring_index("cid", ".", -1).alias("alias")).distinct()


def sample_class(domain: Column, containment: Column, ratio: Column) -> Column:
    """What a sampled column is, from its best domain and its distinct values over rows."""
    return F.when(containment > 0.8, F.concat(F.lit("dimension (domain: "), domain, F.lit(")"))).when(ratio > 0.9, "measure (high cardinality)").when(ratio < 0.05, "dimension (low cardinality)").otherwise("ambiguous")


def step_features(steps: DataFrame, by: list[str]) -> DataFrame:
    """Features of the statistics steps (equal_rows, range_rows, distinct_range_rows, average_range_rows) of a column."""
    f = steps.groupBy(*by).agg(
        F.count("*").alias("step_count"), F.sum("equal_rows").alias("total_equal_rows"), F.sum("range_rows").alias("total_range_rows"), F.sum("distinct_range_rows").alias("total_distinct_range"),
        F.avg("equal_rows").alias("avg_equal_rows"), F.avg("average_range_rows").alias("avg_avg_range_rows"), F.count_if(F.col("range_rows") == 0).alias("zero_range_steps"),
    )
    return f.withColumn("total_rows", F.col("total_equal_rows") + F.col("total_range_rows"))


def step_class(is_fk: Column, pk_columns: Column) -> Column:
    """What a column of step_features() is. Keys go first, foreign before composite before single."""
    some = F.col("total_rows") > 0
    ratio = F.when(some, (F.col("step_count") + F.col("total_distinct_range")) / F.col("total_rows"))
    return (
        F.when(is_fk, "dimension key")
        .when(pk_columns > 1, "degenerate dimension")
        .when(pk_columns == 1, "surrogate key")
        .when(some & (ratio < 0.1) & (F.col("avg_equal_rows") > 100), "low-cardinality dimension")
        .when(some & (F.col("zero_range_steps") / F.col("step_count") > 0.5) & (F.col("avg_equal_rows") > 5), "dimension")
        .when(some & (ratio > 0.5) & (F.col("avg_equal_rows") < 2), "measure")
        .otherwise("ambiguous")
    )


def type_tag(pk_ord: Column, table: Column, target: Column, declared: Column) -> Column:
    """The type of a column in a relation's arrow from its key to its other columns."""
    kind = F.upper(declared)
    return F.when(pk_ord > 0, F.concat(F.lit("DET domain:"), table)).when(target.isNotNull(), F.concat(F.lit("domain:"), target)).when(kind.rlike("INT|NUMERIC|REAL|DEC|DOUBLE|FLOAT"), "measure").when(kind.rlike("DATE|TIME"), "temporal").otherwise("text")


def arrows(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """relvar, d, c: key columns and typed other columns. columns: tbl, col, ord, pk_ord, decl_type; keys: tbl, from_col, target_tbl."""
    typed = columns.join(keys.toDF("tbl", "col", "target_tbl"), ["tbl", "col"], "left").withColumn("tag", type_tag(F.col("pk_ord"), F.col("tbl"), F.col("target_tbl"), F.col("decl_type")))
    listed = lambda keep, text: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(keep, F.struct("ord", text.alias("x"))))), lambda s: s["x"]), ", ")
    braces = lambda x: F.concat(F.lit("{ "), x, F.lit(" }"))
    return typed.groupBy(F.col("tbl").alias("relvar")).agg(braces(listed(F.col("pk_ord") > 0, F.col("col"))).alias("d"), braces(listed(F.col("pk_ord") == 0, F.concat("col", F.lit(":"), "tag"))).alias("c"))


def target_popularity(keys: DataFrame) -> DataFrame:
    """target_tbl and n, how many columns refer to it. keys: tbl, from_col, target_tbl."""
    return keys.groupBy("target_tbl").agg(F.count("*").alias("n"))


def declared_family(kind: Column, families: dict[str, str]) -> Column:
    """The family of a declared type without its sizes in parentheses and without case; null if families lacks it."""
    name = F.lower(F.trim(F.substring_index(kind, "(", 1)))
    return F.element_at(F.create_map(*[F.lit(x) for n, f in families.items() for x in (n.lower(), f)]), name)


def reference_paths(hops: DataFrame) -> DataFrame:
    """consumer, producer, path, hops, confidence: every way from a table to another along references.

    hops has consumer, via_col, producer and confidence, a row a reference; a path's confidence is the product of its
    hops'. No path meets a table twice, so cycles end. Each round is a join of tables as small as the catalog, written
    once; there are as many rounds as the longest path has hops. In a dense catalog ways are very many: best_paths()
    has the surest of each pair alone.
    """
    step = F.concat("consumer", F.lit("."), "via_col")
    hops = written(hops.filter("consumer <> producer"), "hops")
    ends = hops.select("consumer", "producer", step.alias("path"), F.lit(1).alias("hops"), "confidence", F.array("consumer", "producer").alias("met"))
    found = [ends]
    nexts = hops.select(F.col("consumer").alias("producer"), step.alias("step"), F.col("producer").alias("to"), F.col("confidence").alias("more"))
    while not ends.isEmpty():
        longer = ends.join(nexts, "producer").filter(~F.array_contains("met", F.col("to")))
        ends = written(longer.select("consumer", F.col("to").alias("producer"), F.concat_ws(" > ", "path", "step").alias("path"), (F.col("hops") + 1).alias("hops"), (F.col("confidence") * F.col("more")).alias("confidence"), F.concat("met", F.array("to")).alias("met")), "ways")
        found.append(ends)
    whole = found[0]
    for f in found[1:]:
        whole = whole.unionByName(f)
    return whole.drop("met")


def best_paths(hops: DataFrame) -> DataFrame:
    """consumer, producer, path, hops, confidence: the surest way from each table to each other along references.

    hops has consumer, via_col, producer and confidence (at most 1). Of equally sure ways the one of fewest hops
    counts, then the first by name. There is one row a pair at any time: each round joins the ways found so far with
    each other and keeps the best, so ways of twice as many hops are found each round until none gets better.
    """
    step = F.concat("consumer", F.lit("."), "via_col")
    rank = F.struct((-F.col("confidence")).alias("doubt"), F.col("hops"), F.col("path"))
    best = lambda ways: ways.groupBy("consumer", "producer").agg(F.min(rank).alias("best")).select("consumer", "producer", "best.path", "best.hops", (-F.col("best.doubt")).alias("confidence"))
    known = written(best(hops.filter("consumer <> producer").select("consumer", "producer", step.alias("path"), F.lit(1).alias("hops"), "confidence")), "ways")
    while True:
        after = known.toDF("producer", "to", "more_path", "more_hops", "more")
        longer = known.join(after, "producer").filter("consumer <> to").select("consumer", F.col("to").alias("producer"), F.concat_ws(" > ", "path", "more_path").alias("path"), (F.col("hops") + F.col("more_hops")).alias("hops"), (F.col("confidence") * F.col("more")).alias("confidence"))
        was = known.select("consumer", "producer", F.col("path").alias("was"))
        better = best(known.unionByName(longer)).join(was, ["consumer", "producer"], "left")
        found = written(better, "ways")
        dropped(known)
        known = found.drop("was")
        if found.filter("was is null or was <> path").isEmpty():
            return known


#: Tables that join_tree() links, at most: it keeps a row for each table and each subset of these.
MOST_ENDS = 12


def join_tree(hops: DataFrame, ends: DataFrame) -> DataFrame:
    """consumer, via_col, producer, confidence: the references of the smallest tree that links all tables of ends (tbl).

    References count in both directions. The tree has the fewest joins; of equals the least doubt (in millionths),
    then the first by name. Trees grow by relaxation: for each table and subset of ends the best tree known that holds
    them gets a reference more, or meets another tree at the same table, until none gets better. Tables that no tree
    links, or less than two, give no rows.
    """
    ends = ends.select("tbl").distinct()
    spark = hops.sparkSession
    names = sorted(r["tbl"] for r in ends.limit(MOST_ENDS + 1).collect())
    if len(names) > MOST_ENDS:
        raise ValueError(f"a tree of over {MOST_ENDS} tables")
    doubt = F.round((1 - F.col("confidence")) * 1_000_000).cast("long")
    edges = written(hops.filter("consumer <> producer").groupBy("consumer", "via_col", "producer").agg(F.max("confidence").alias("confidence")).withColumn("edge", F.concat("consumer", F.lit("."), "via_col", F.lit(" > "), "producer")).withColumn("doubt", doubt), "references")
    steps = edges.select(F.col("consumer").alias("tbl"), F.col("producer").alias("to"), "edge", F.col("doubt").alias("more")).union(edges.select("producer", "consumer", "edge", "doubt"))
    state = "tbl string, mask long, joins int, doubt long, edges array<string>"
    trees = written(spark.createDataFrame([(t, 1 << i, 0, 0, []) for i, t in enumerate(names)], state), "trees")
    best = lambda t: t.groupBy("tbl", "mask").agg(F.min(F.struct("joins", "doubt", "edges")).alias("b")).select("tbl", "mask", "b.joins", "b.doubt", "b.edges")
    together = lambda a, b: F.array_sort(F.array_union(a, b)).alias("edges")
    while True:
        grown = trees.join(steps, "tbl").select(F.col("to").alias("tbl"), "mask", (F.col("joins") + 1).alias("joins"), (F.col("doubt") + F.col("more")).alias("doubt"), together(F.col("edges"), F.array("edge")))
        other = trees.toDF("tbl", "mask2", "joins2", "doubt2", "edges2")
        met = trees.join(other, "tbl").filter("mask < mask2 and mask & mask2 = 0").select("tbl", F.col("mask").bitwiseOR(F.col("mask2")).alias("mask"), (F.col("joins") + F.col("joins2")).alias("joins"), (F.col("doubt") + F.col("doubt2")).alias("doubt"), together(F.col("edges"), F.col("edges2")))
        was = trees.select("tbl", "mask", F.struct("joins", "doubt", "edges").alias("was"))
        after = written(best(trees.unionByName(grown).unionByName(met)).join(was, ["tbl", "mask"], "left").withColumn("changed", F.col("was").isNull() | (F.col("was") > F.struct("joins", "doubt", "edges"))).drop("was"), "trees")
        dropped(trees)
        trees = after.drop("changed")
        if after.filter("changed").isEmpty():
            break
    whole = trees.filter(F.col("mask") == (1 << len(names)) - 1).agg(F.min(F.struct("joins", "doubt", "edges")).alias("b")).select(F.explode("b.edges").alias("edge"))
    return edges.join(whole, "edge").select("consumer", "via_col", "producer", "confidence")
