"""Domains on pages and runs of pages with the same domains."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from valprint.sources.scratch import written


def page_domains(tokens: DataFrame, domains: DataFrame) -> DataFrame:
    """page_id, domain, domain_size, probe_size, hits, containment, jaccard for domains with a hit on a page.

    tokens has page_id and text, domains cid and val.
    """
    sets = tokens.filter(F.col("text") != "").select("page_id", F.col("text").alias("val")).distinct()
    probe = sets.groupBy("page_id").agg(F.count("*").alias("probe_size"))
    size = domains.groupBy("cid").agg(F.count("*").alias("domain_size"))
    hits = sets.join(domains, "val").groupBy("page_id", "cid").agg(F.count("*").alias("hits"))
    both = hits.join(probe, "page_id").join(size, "cid")
    return both.select("page_id", F.col("cid").alias("domain"), "domain_size", "probe_size", "hits", (F.col("hits") / F.col("probe_size")).alias("containment"), (F.col("hits") / (F.col("domain_size") + F.col("probe_size") - F.col("hits"))).alias("jaccard"))


#: Pages of a range, and ranges of the next larger one.
SPAN = 4096


def _joined(runs: DataFrame, low: int, size: int) -> DataFrame:
    """Runs (signature, start, end, pages) that follow each other within a range of so many pages, as one."""
    place = F.floor((F.col("start") - low) / size).alias("place")
    order = Window.partitionBy("signature", "place").orderBy("start")
    begins = F.coalesce(F.lag("end").over(order) + 1 < F.col("start"), F.lit(True)).cast("int")
    islands = runs.withColumn("place", place).withColumn("begins", begins).withColumn("island", F.sum("begins").over(order))
    return islands.groupBy("signature", "place", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("pages").alias("pages")).drop("island")


def runs_of(signed: DataFrame, span: int = SPAN) -> DataFrame:
    """signature, start, end, pages of consecutive pages of one signature; signed has page_id and signature, a row a page.

    Runs are found within ranges of span pages. Of each range only those that touch its ends, two a signature at
    most, go on to ranges of span times as many pages, until one range holds all pages. So a signature on every page
    is the work of as many tasks as there are ranges, and none sees over twice span rows of one signature.
    """
    ends = signed.agg(F.min("page_id"), F.max("page_id")).first()
    runs = signed.select("signature", F.col("page_id").cast("long").alias("start"), F.col("page_id").cast("long").alias("end"), F.lit(1).cast("long").alias("pages"))
    if ends[0] is None:
        return runs
    low, size, closed = int(ends[0]), span, []
    while True:
        joined = _joined(runs, low, size)
        if size > int(ends[1]) - low:
            closed.append(joined.drop("place"))
            break
        first = F.lit(low) + F.col("place") * size
        level = written(joined.withColumn("open", (F.col("start") == first) | (F.col("end") == first + (size - 1))), "runs")
        closed.append(level.filter("not open").drop("place", "open"))
        runs = level.filter("open").drop("place", "open")
        size *= span
    return reduce(DataFrame.unionByName, closed)


def page_runs(matches: DataFrame, threshold: float = 0.05, span: int = SPAN) -> DataFrame:
    """start_page, end_page, page_count, signature of consecutive pages with the same domains over the threshold."""
    signed = matches.filter(F.col("containment") > threshold).groupBy("page_id").agg(F.array_join(F.sort_array(F.collect_set("domain")), "|").alias("signature"))
    kind = dict(signed.dtypes)["page_id"]
    return runs_of(written(signed, "signed"), span).select(F.col("start").cast(kind).alias("start_page"), F.col("end").cast(kind).alias("end_page"), F.col("pages").alias("page_count"), "signature")
