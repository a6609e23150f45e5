"""A store of column fingerprints over time: captures that hold what changed, read as of any time.

A capture is a manifest, a row a column with its key kind, size and digest, and the containers of the columns whose
digest no earlier manifest row has. The manifest is written last and counts only once Spark has marked it complete, so
a capture that breaks off leaves nothing that a reader sees, and can be done again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valprint.sources.scratch import dropped, written

#: Kinds of key that fingerprints are kept for: primary, foreign and unique.
KINDS = ("pk", "fk", "uk")


def _name(when: str) -> str:
    """The name of a capture, in the order of time, from a time as yyyy-mm-dd with or without hh:mm:ss."""
    digits = "".join(c for c in when if c.isdigit())
    if len(digits) not in (8, 14):
        raise ValueError(f"not a time: {when}")
    return f"c{digits.ljust(14, '0')}"


def captures(spark: SparkSession, path: str) -> list[str]:
    """The names of the complete captures of a store, the earliest first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/members")
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not files.exists(folder):
        return []
    found = [s.getPath() for s in files.listStatus(folder) if s.isDirectory()]
    return sorted(p.getName().removeprefix("capture=") for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def digests(sets: DataFrame) -> DataFrame:
    """cid, n, digest of chunked sets: a sum over containers, so no task sees a whole set and their order is of no account."""
    each = F.xxhash64("hi", "card", "data").cast("decimal(20,0)")
    return sets.groupBy("cid").agg(F.sum("card").alias("n"), F.sum(each).cast("decimal(38,0)").alias("digest"))


MEMBER = "cid string, kind string, referenced string, n long, digest decimal(38,0), held string"


def capture(sets: DataFrame, members: DataFrame, path: str, when: str) -> None:
    """Adds a capture of members (cid, kind, referenced) and their chunked sets to the store at path.

    Only containers of columns that the capture before lacks, or had with another digest, are written. A column that
    members no longer has is gone from then on. A member without a value has n 0. If a complete capture of that time
    is there already, nothing happens; times before the last complete one are refused.
    """
    spark, name = sets.sparkSession, _name(when)
    done = captures(spark, path)
    if name in done:
        return
    if done and name < done[-1]:
        raise ValueError(f"the store has a later capture: {done[-1]}")
    sets = written(sets.select("cid", F.col("hi").cast("long").alias("hi"), "card", "data"), "capture-sets")
    now = members.select("cid", "kind", "referenced").dropDuplicates(["cid"]).join(digests(sets), "cid", "left").withColumns({"n": F.coalesce("n", F.lit(0).cast("long")), "digest": F.coalesce("digest", F.lit(0).cast("decimal(38,0)"))})
    before = _manifest(spark, path, done[-1]) if done else spark.createDataFrame([], MEMBER)
    rows = written(now.join(before.select("cid", "digest", "held"), ["cid", "digest"], "left").select("cid", "kind", "referenced", "n", "digest", F.coalesce("held", F.lit(name)).alias("held")), "capture")
    changed = rows.filter(F.col("held") == name).select("cid")
    sets.join(changed, "cid", "left_semi").write.mode("overwrite").parquet(f"{path}/containers/capture={name}")
    rows.write.mode("overwrite").parquet(f"{path}/members/capture={name}")
    dropped(rows, sets)


def _manifest(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.schema(MEMBER).parquet(f"{path}/members/capture={name}")


def members_as_of(spark: SparkSession, path: str, when: str, kinds: tuple[str, ...] | None = KINDS) -> DataFrame:
    """cid, kind, referenced, n, digest, held of the latest complete capture up to a time; kinds None gives all columns."""
    upto = [c for c in captures(spark, path) if c <= _name(when)]
    rows = _manifest(spark, path, upto[-1]) if upto else spark.createDataFrame([], MEMBER)
    return rows if kinds is None else rows.filter(F.col("kind").isin(*kinds))


def sets_as_of(spark: SparkSession, path: str, when: str, kinds: tuple[str, ...] | None = KINDS) -> DataFrame:
    """The chunked sets of members_as_of(), each from the capture that holds it; only those captures are read."""
    members = members_as_of(spark, path, when, kinds)
    schema = "cid string, hi long, card int, data binary"
    held = [r["held"] for r in members.select("held").distinct().collect()]
    parts = [spark.read.schema(schema).parquet(f"{path}/containers/capture={h}").withColumn("held", F.lit(h)) for h in sorted(held)]
    whole = spark.createDataFrame([], f"{schema}, held string")
    for p in parts:
        whole = whole.unionByName(p)
    return whole.join(members.select("cid", "held"), ["cid", "held"], "left_semi").select("cid", "hi", "card", "data")


def merged_rows(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """target with the rows of source put in, by keys, null keys being equal: source's values replace target's, new rows are added.

    Both have the same columns and no key twice. It is one full join, whose result replaces the target.
    """
    rest = [c for c in target.columns if c not in keys]
    a = target.select(*keys, F.struct(F.lit(True).alias("here"), *rest).alias("old"))
    b = source.select(*[F.col(k).alias(f"__{k}") for k in keys], F.struct(F.lit(True).alias("here"), *rest).alias("new"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    put = F.col("new").isNotNull()
    key = lambda k: F.when(put, F.col(f"__{k}")).otherwise(F.col(k)).alias(k)
    return a.join(b, on, "full").select(*[key(k) for k in keys], *[F.when(put, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in rest])


def faceted(properties: DataFrame, prefix: str, names: list[str]) -> DataFrame:
    """object, column and a column for each name of properties (object, column, property, value) of a prefix; columns without any are left out."""
    mine = properties.filter(F.col("column").isNotNull() & F.col("property").isin([f"{prefix}.{n}" for n in names]))
    each = [F.max(F.when(F.col("property") == f"{prefix}.{n}", F.col("value"))).alias(n) for n in names]
    return mine.groupBy("object", "column").agg(*each)
