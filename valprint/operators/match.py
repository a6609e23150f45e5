"""Overlap of value sets at scale: probes, containment matrices, keys, clusters, covers and labels.

Sets are exact and relational: a row (cid, val) for each member. Overlaps come from one shuffle by value that gathers
the columns of each value, so no task ever holds a set and no pair without a common value is made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from valprint.sources.scratch import dropped, written


def _counted(pairs: DataFrame) -> DataFrame:
    """ca, cb, inter, na, nb from a row (ca, cb) for each common value, (ca, null) for each value of ca, (null, cb) of cb."""
    n = pairs.groupBy("ca", "cb").agg(F.count("*").alias("inter"))
    size = lambda of, other: F.max(F.when(F.col(other).isNull(), F.col("inter"))).over(Window.partitionBy(of))
    return n.select("ca", "cb", "inter", size("ca", "cb").alias("na"), size("cb", "ca").alias("nb")).filter("ca is not null and cb is not null and ca <> cb")


def _met(values: DataFrame) -> DataFrame:
    """The rows for _counted() of the columns cas and cbs of each value; what has no partner only counts for its size."""
    other = lambda c: F.explode(F.array_append(c, F.lit(None).cast("string")))
    return values.select(other("cas").alias("ca"), "cbs").select("ca", other("cbs").alias("cb")).filter("ca is not null or cb is not null")


def crossed(a: DataFrame, b: DataFrame) -> DataFrame:
    """ca, cb, inter, na, nb of the columns of a and those of b that share a value; a column is not paired with itself.

    Both tables go through one shuffle by value. A value's columns are gathered once, as many as there are columns and
    not rows; its pairs are as many rows as it adds to the result's counts. Sizes are counted with them, so nothing
    is read twice.
    """
    none = F.lit(None).cast("string")
    both = a.select("val", F.col("cid").alias("ca"), none.alias("cb")).unionByName(b.select("val", none.alias("ca"), F.col("cid").alias("cb")))
    return _counted(_met(both.groupBy("val").agg(F.collect_set("ca").alias("cas"), F.collect_set("cb").alias("cbs"))))


def compared(sets: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """crossed() of all columns with those of chosen (cid), or of all pairs; sets are read and shuffled once."""
    if chosen is not None:
        marked = sets.join(chosen.select("cid").distinct().withColumn("is_chosen", F.lit(True)), "cid", "left")
        values = marked.groupBy("val").agg(F.collect_set("cid").alias("cas"), F.collect_set(F.when(F.col("is_chosen"), F.col("cid"))).alias("cbs"))
        return _counted(_met(values))
    # each pair is counted once, by name, and turned round in the small result
    values = sets.groupBy("val").agg(F.collect_set("cid").alias("cas")).select(F.explode("cas").alias("ca"), "cas")
    once = values.select("ca", F.explode(F.filter("cas", lambda c: c >= F.col("ca"))).alias("cb"))
    n = once.groupBy("ca", "cb").agg(F.count("*").alias("inter"))
    turned = n.select(F.explode(F.array_distinct(F.array(F.struct("ca", "cb"), F.struct(F.col("cb").alias("ca"), F.col("ca").alias("cb"))))).alias("p"), "inter").select("p.ca", "p.cb", "inter")
    size = lambda of: F.max(F.when(F.col("ca") == F.col("cb"), F.col("inter"))).over(Window.partitionBy(of))
    return turned.select("ca", "cb", "inter", size("ca").alias("na"), size("cb").alias("nb")).filter("ca <> cb")


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """ca, cb and inter, the number of common values, for sets that share any. A set is not paired with itself."""
    return (compared(a) if a is b else crossed(a, b)).select("ca", "cb", "inter")


def sizes(sets: DataFrame) -> DataFrame:
    return sets.groupBy("cid").agg(F.count("*").alias("n"))


def _shares() -> dict[str, Column]:
    return {"containment": F.col("inter") / F.col("na"), "jaccard": F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))}


def containment_matrix(sets: DataFrame, digits: int | None = 3) -> DataFrame:
    """ca, cb, inter, na, nb, containment (of ca in cb), jaccard for pairs of columns that share a value."""
    c = compared(sets).withColumns(_shares())
    return c.withColumn("containment", F.round("containment", digits)) if digits is not None else c


def against(sets: DataFrame, chosen: DataFrame, least: int = 1) -> DataFrame:
    """containment_matrix() of all columns in those of chosen (cid) that have least or more values, and in no others."""
    return compared(sets, chosen).filter(F.col("nb") >= least).withColumns(_shares())


def best_match(matrix: DataFrame, score: str = "containment") -> DataFrame:
    """The column that each column matches best, the first by name of equals."""
    w = Window.partitionBy("ca").orderBy(F.desc(score), "cb")
    return matrix.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select(F.col("ca").alias("source_column"), F.col("cb").alias("best_match"), F.col(score).alias("score"))


def mutual(matrix: DataFrame) -> DataFrame:
    """ca, cb, mc: the smaller of both containments, high only for the same domain."""
    share = F.col("inter") / F.greatest("na", "nb")
    return matrix.select("ca", "cb", share.alias("mc"))


def probe(values: DataFrame, domains: DataFrame) -> DataFrame:
    """domain, domain_size, probe_size, hits, containment, jaccard of distinct probe values (val) in each domain.

    domains has cid and val. Domains without a hit stay, with zeros.
    """
    p = values.select("val").filter("val is not null").distinct()
    hits = domains.join(p, "val").groupBy("cid").agg(F.count("*").alias("hits"))
    size = p.agg(F.count("*").alias("probe_size"))
    all_ = sizes(domains).join(hits, "cid", "left").crossJoin(F.broadcast(size)).withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))
    whole = F.col("n") + F.col("probe_size") - F.col("hits")
    return all_.select(
        F.col("cid").alias("domain"), F.col("n").alias("domain_size"), "probe_size", "hits",
        F.when(F.col("probe_size") == 0, 0.0).otherwise(F.col("hits") / F.col("probe_size")).alias("containment"),
        F.when(whole == 0, 1.0).otherwise(F.col("hits") / whole).alias("jaccard"),
    )


def evidence_of(pairs: DataFrame, level: str = "raw", grain: str = "column") -> DataFrame:
    """Evidence rows of pairs (ca, cb, inter, na, nb): one for each of three metrics.

    probe, domain, canon_level, grain, metric, value, fidelity, probe_size, domain_size; metrics are containment,
    reverse_containment and jaccard.
    """
    metric = lambda name, x: F.struct(F.lit(name).alias("metric"), x.alias("value"))
    shares = _shares()
    rows = F.explode(F.array(metric("containment", shares["containment"]), metric("reverse_containment", F.col("inter") / F.col("nb")), metric("jaccard", shares["jaccard"])))
    return pairs.select("ca", "cb", "na", "nb", rows.alias("m")).select(F.col("ca").alias("probe"), F.col("cb").alias("domain"), F.lit(level).alias("canon_level"), F.lit(grain).alias("grain"), "m.metric", "m.value", F.lit("exact").alias("fidelity"), F.col("na").alias("probe_size"), F.col("nb").alias("domain_size"))


def evidence(sets: DataFrame, domains: DataFrame, level: str = "raw", grain: str = "column") -> DataFrame:
    """evidence_of() every column against every domain that shares a value with it."""
    return evidence_of(crossed(sets, domains), level, grain)


def evidence_table(rows: DataFrame) -> DataFrame:
    """Evidence with a column for each metric instead of a row."""
    keys = ["probe", "domain", "canon_level", "grain", "fidelity", "probe_size", "domain_size"]
    return rows.groupBy(*keys).pivot("metric", ["containment", "reverse_containment", "jaccard"]).agg(F.first("value"))


def nested(matrix: DataFrame, inside: float = 0.95, same: float = 0.7) -> DataFrame:
    """Pairs where ca lies in cb without being the same domain: what containment alone would take for a match."""
    return matrix.withColumn("mutual", F.col("inter") / F.greatest("na", "nb")).filter((F.col("inter") / F.col("na") >= inside) & (F.col("mutual") < same))


def residue(values: DataFrame, domains: DataFrame) -> DataFrame:
    """The probe values that no domain holds."""
    return values.select("val").distinct().join(domains.select("val"), "val", "left_anti")


def validated_keys(sets: DataFrame, keys: DataFrame, digits: int | None = 3) -> DataFrame:
    """child, parent, fk_card, inter, containment of each declared key pair (child, parent); pairs without a hit stay.

    The columns that occur in keys are read and shuffled by value once, and each value of a child looks for its
    parents among the columns that share it.
    """
    used = keys.select(F.col("child").alias("cid")).union(keys.select("parent")).distinct()
    values = sets.join(used, "cid", "left_semi").groupBy("val").agg(F.collect_set("cid").alias("cids"))
    each = values.select(F.explode("cids").alias("child"), "cids").join(keys.select("child", "parent").distinct(), "child")
    n = each.groupBy("child", "parent").agg(F.count("*").alias("fk_card"), F.count_if(F.array_contains("cids", F.col("parent"))).alias("inter"))
    share = F.col("inter") / F.col("fk_card")
    return n.select("child", "parent", "fk_card", "inter", (F.round(share, digits) if digits is not None else share).alias("containment"))


def discovered_keys(sets: DataFrame, keys: DataFrame, threshold: float = 0.95, least: int = 8) -> DataFrame:
    """child, parent, containment, parent_distinct of columns nearly contained in a key column (keys: cid) of least or more values."""
    found = against(sets, keys, least).filter(F.col("containment") >= threshold)
    return found.select(F.col("ca").alias("child"), F.col("cb").alias("parent"), "containment", F.col("nb").alias("parent_distinct"))


def induced_domains(sets: DataFrame, threshold: float = 0.7) -> DataFrame:
    """cid and component, the smallest column that links of mutual containment reach, the column's own included.

    Labels pass along links until none changes; the tables have a row a column and are written each round.
    """
    pairs = written(mutual(containment_matrix(sets, None)).filter(F.col("mc") >= threshold).select("ca", "cb"), "links")
    labels = written(sets.select("cid").distinct().withColumn("component", F.col("cid")), "labels")
    while True:
        near = pairs.join(labels, pairs["cb"] == labels["cid"]).groupBy("ca").agg(F.min("component").alias("low"))
        lower = F.coalesce(F.col("low") < F.col("component"), F.lit(False))
        after = written(labels.join(near, labels["cid"] == near["ca"], "left").select("cid", F.least("component", F.coalesce("low", "component")).alias("component"), lower.alias("changed")), "labels")
        dropped(labels)
        labels = after.drop("changed")
        if after.filter("changed").isEmpty():
            dropped(pairs)
            return labels


def labelled(components: DataFrame, sets: DataFrame, authorities: DataFrame, threshold: float = 0.9) -> DataFrame:
    """induced_domain, cluster_card, best_authority, containment, verdict of each component against authorities (cid, val)."""
    members = components.join(sets, "cid").select(F.col("component").alias("cid"), "val").distinct()
    card = sizes(members).toDF("induced_domain", "cluster_card")
    hit = members.toDF("induced_domain", "val").join(authorities.select(F.col("cid").alias("auth"), "val").distinct(), "val").groupBy("induced_domain", "auth").agg(F.count("*").alias("inter"))
    best = hit.withColumn("rn", F.row_number().over(Window.partitionBy("induced_domain").orderBy(F.desc("inter"), "auth"))).filter("rn = 1")
    share = F.coalesce("inter", F.lit(0)) / F.col("cluster_card")
    return card.join(best, "induced_domain", "left").select("induced_domain", "cluster_card", F.coalesce("auth", F.lit("(no authority)")).alias("best_authority"), F.round(share, 3).alias("containment"), F.when(share >= threshold, "labelled").otherwise("unlabelled").alias("verdict"))


def domain_covers(values: DataFrame, domains: DataFrame, target: float = 0.98, most: int = 4, least: int = 8) -> DataFrame:
    """cid, pick, domain, marginal, coverage: for each column of values the domains that cover it best, chosen greedily.

    values and domains have cid and val; a column is not covered by itself. Only domains of least or more values
    count, of equals the first by name; a column is done once its coverage reaches the target. Values meet domains in
    one join; each of the most rounds is, for all columns together, a count, a best row a column and an anti join.
    """
    probes = values.select("cid", "val").filter("val is not null").distinct()
    total = sizes(probes).toDF("cid", "total")
    able = sizes(domains).filter(F.col("n") >= least)
    usable = domains.join(able, "cid", "left_semi").select(F.col("cid").alias("domain"), "val")
    open_ = written(probes.join(usable, "val").filter("cid <> domain").select("cid", "val", "domain"), "cover-hits")
    done = written(total.select("cid", "total", F.lit(0).cast("long").alias("covered")), "covered")
    picks = []
    for pick in range(1, most + 1):
        gains = open_.groupBy("cid", "domain").agg(F.count("*").alias("gain"))
        best = gains.groupBy("cid").agg(F.min(F.struct((-F.col("gain")).alias("gain"), F.col("domain"))).alias("best"))
        chosen = written(best.join(done, "cid").select("cid", F.lit(pick).alias("pick"), "best.domain", (-F.col("best.gain")).alias("gain"), "total", (F.col("covered") - F.col("best.gain")).alias("covered")), "cover-picks")
        if chosen.isEmpty():
            dropped(chosen)
            break
        picks.append(chosen)
        if pick < most:
            unfinished = chosen.filter(F.col("covered") < F.col("total") * target).select("cid", "domain")
            taken = open_.join(unfinished, ["cid", "domain"], "left_semi").select("cid", "val")
            left = written(open_.join(unfinished.select("cid"), "cid", "left_semi").join(taken, ["cid", "val"], "left_anti"), "cover-hits")
            dropped(open_, *([done] if pick == 1 else []))
            open_, done = left, chosen.select("cid", "total", "covered")
    dropped(open_)
    if not picks:
        return values.sparkSession.createDataFrame([], "cid string, pick int, domain string, marginal double, coverage double")
    whole = picks[0]
    for p in picks[1:]:
        whole = whole.unionByName(p)
    return whole.select("cid", "pick", "domain", (F.col("gain") / F.col("total")).alias("marginal"), (F.col("covered") / F.col("total")).alias("coverage"))


def union_types(covers: DataFrame, least: float = 0.9) -> DataFrame:
    """cid, domains, coverage, residual of domain_covers(), and is_union: two or more domains cover least or more of the column."""
    each = covers.groupBy("cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pick", "domain"))), lambda p: p["domain"]).alias("domains"), F.max("coverage").alias("coverage"))
    return each.select("cid", "domains", "coverage", (1 - F.col("coverage")).alias("residual"), ((F.size("domains") > 1) & (F.col("coverage") >= least)).alias("is_union"))


def domain_cover(values: DataFrame, domains: DataFrame, target: float = 0.98, most: int = 4, least: int = 8) -> DataFrame:
    """pick, domain, marginal, coverage: domain_covers() of one column of values (val).

    A union type shows as two or more picks that cover 0.9 or more.
    """
    one = values.select(F.lit("").alias("cid"), F.col("val"))
    return domain_covers(one, domains, target, most, least).select("pick", "domain", "marginal", "coverage")


def leader_clusters(sets: DataFrame, threshold: float = 0.8) -> DataFrame:
    """cid, leader, jaccard: columns in the order of size join the first leader they resemble, or lead themselves.

    The similar pairs are made by Spark; each round settles every column all of whose larger similar columns are
    settled, so the loop follows the longest chain and not the columns.
    """
    n = written(sizes(sets), "sizes")
    m = containment_matrix(sets, None).filter(F.col("jaccard") >= threshold)
    place = lambda c, size: F.struct((-F.col(size)).alias("n"), F.col(c).alias("cid"))
    before = written(m.select("ca", "cb", place("ca", "na").alias("oa"), place("cb", "nb").alias("ob"), "jaccard").filter("ob < oa").select("ca", "cb", "ob", "jaccard"), "before")
    known = written(n.select("cid").join(before.select(F.col("ca").alias("cid")), "cid", "left_anti").select("cid", F.col("cid").alias("leader"), F.lit(1.0).alias("jaccard")), "known")
    while True:
        seen = before.join(known.select(F.col("cid").alias("cb"), "leader"), "cb", "left").join(known.select(F.col("cid").alias("ca"), F.lit(True).alias("done")), "ca", "left").filter("done is null")
        leads = F.when(F.col("leader") == F.col("cb"), F.struct("ob", "cb", "jaccard"))
        # a column is settled by its first leader once all columns before that one are settled
        each = seen.groupBy("ca").agg(F.min(leads).alias("first"), F.min(F.when(F.col("leader").isNull(), F.col("ob"))).alias("open"))
        ready = each.filter("open is null or first.ob < open")
        new = written(ready.select(F.col("ca").alias("cid"), F.coalesce("first.cb", "ca").alias("leader"), F.coalesce("first.jaccard", F.lit(1.0)).alias("jaccard")), "known")
        if new.isEmpty():
            dropped(n, before, new)
            return known
        after = written(known.unionByName(new), "known")
        dropped(known, new)
        known = after


def recognised_columns(slab: DataFrame, library: DataFrame, families: DataFrame, threshold: float = 0.6, top: int = 5) -> DataFrame:
    """cid, family, role, domain, containment, place: the best library domains of each column of an unnamed table.

    slab and library have cid and val, families gives each library column's family. Only columns of the same or an
    unknown family are compared. The role is `key` from the threshold on, `measure` for other numbers, else `unknown`.
    """
    from valprint.operators.cells import family

    kinds = slab.groupBy("cid").agg(family(F.col("val")).alias("family"))
    c = crossed(slab.distinct(), library).join(kinds.toDF("ca", "family"), "ca").join(families.toDF("cb", "their"), "cb", "left").filter("their is null or their = family").withColumn("containment", F.col("inter") / F.col("na"))
    c = c.withColumn("place", F.row_number().over(Window.partitionBy("ca").orderBy(F.desc("containment"), "cb"))).filter(F.col("place") <= top)
    best = c.filter("place = 1").select(F.col("ca").alias("cid"), F.col("containment").alias("best"))
    role = F.when(F.coalesce("best", F.lit(0.0)) >= threshold, "key").when(F.col("family").isin("integer", "numeric"), "measure").otherwise("unknown")
    return kinds.join(best, "cid", "left").withColumn("role", role).join(c.select(F.col("ca").alias("cid"), F.col("cb").alias("domain"), "containment", "place"), "cid", "left").select("cid", "family", "role", "domain", "containment", "place")


def sources(slab: DataFrame, library: DataFrame, least: float = 0.5) -> DataFrame:
    """cid, source, containment, mutual: the library column that each column of an unnamed table most likely is.

    That is the one of the largest mutual containment, if it reaches least; containment alone would take any long
    run of numbers for every shorter one. slab and library have cid and val.
    """
    pairs = crossed(slab.distinct(), library).withColumns({"containment": F.col("inter") / F.col("na"), "mutual": F.col("inter") / F.greatest("na", "nb")})
    best = pairs.withColumn("place", F.row_number().over(Window.partitionBy("ca").orderBy(F.desc("mutual"), F.desc("containment"), "cb")))
    return best.filter((F.col("place") == 1) & (F.col("mutual") >= least)).select(F.col("ca").alias("cid"), F.col("cb").alias("source"), "containment", "mutual")


def candidate_tables(recognised: DataFrame) -> DataFrame:
    """tbl and columns: the tables that hold the best match of each key column of recognised_columns()."""
    best = recognised.filter("role = 'key' and place = 1")
    return best.groupBy(F.substring_index("domain", ".", 1).alias("tbl")).agg(F.sort_array(F.collect_set("cid")).alias("columns"))
