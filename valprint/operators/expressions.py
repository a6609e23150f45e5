"""Registries of named expressions kept as rows: references resolved, checked and evaluated by joins.

A definition is a row (name, expr) over features and other definitions. Nothing of it is compiled on the driver:
references are rows whose closure shows cycles, texts are put together round by round, and an expression is evaluated
as pairs of masks that meet the signatures of values.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valprint.functions import charclass
from valprint.functions.hashing import sha256
from valprint.sources.scratch import dropped, written

_NAME = "[A-Za-z_][A-Za-z0-9_]*"


def _pieces(definitions: DataFrame) -> DataFrame:
    """name, pos, token: each expression cut into names and what stands between them."""
    tokens = F.regexp_extract_all("expr", F.lit(f"({_NAME}|[^A-Za-z_]+)"), 1)
    return definitions.select("name", F.posexplode(tokens).alias("pos", "token"))


def references(definitions: DataFrame) -> DataFrame:
    """name and ref, a row for each other definition that a definition's expression names."""
    return _pieces(definitions).select("name", F.col("token").alias("ref")).distinct().join(definitions.select(F.col("name").alias("ref")), "ref", "left_semi")


def reachable(pairs: DataFrame) -> DataFrame:
    """name and ref of everything that is reached along pairs; each round doubles the length of the ways looked at."""
    known = written(pairs.select("name", "ref").distinct(), "reach")
    n = known.count()
    while True:
        on = known.select(F.col("name").alias("ref"), F.col("ref").alias("to"))
        more = written(known.unionByName(known.join(on, "ref").select("name", F.col("to").alias("ref"))).distinct(), "reach")
        dropped(known)
        known, was, n = more, n, more.count()
        if n == was:
            return known


def unresolvable(definitions: DataFrame) -> DataFrame:
    """name of the definitions that refer to themselves by any way, or reach one that does."""
    reach = reachable(references(definitions))
    looped = reach.filter("name = ref").select("name")
    return looped.union(reach.join(looped.select(F.col("name").alias("ref")), "ref", "left_semi").select("name")).distinct()


def expanded(definitions: DataFrame) -> DataFrame:
    """name, expanded, depth: expressions with every reference replaced by what it stands for, in parentheses.

    depth counts the levels of references. Unresolvable definitions are left out. Each round finishes the
    definitions all of whose references are finished, so there are as many rounds as levels.
    """
    definitions = written(definitions.groupBy("name").agg(F.min("expr").alias("expr")), "definitions")
    refs = written(references(definitions), "refs")
    left = written(definitions.join(unresolvable(definitions), "name", "left_anti"), "open")
    done = None
    while True:
        known = done if done is not None else definitions.select("name", F.col("expr").alias("expanded"), F.lit(0).alias("depth")).limit(0)
        waiting = refs.join(known.select(F.col("name").alias("ref")), "ref", "left_anti").select("name").distinct()
        ready = left.join(waiting, "name", "left_anti")
        put = _pieces(ready).join(known.select(F.col("name").alias("token"), "expanded", "depth"), "token", "left").select("name", F.struct("pos", F.coalesce(F.concat(F.lit("("), "expanded", F.lit(")")), "token").alias("text")).alias("p"), "depth")
        texts = put.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["text"]), "").alias("expanded"), (F.coalesce(F.max("depth"), F.lit(-1)) + 1).alias("depth"))
        new = written(texts, "expanded")
        if new.isEmpty():
            dropped(new, left, refs)
            return known
        done, before = (new if done is None else written(done.unionByName(new), "expanded")), done
        after = written(left.join(new.select("name"), "name", "left_anti"), "open")
        dropped(left, *([new, before] if before is not None else []))
        left = after


def registry(definitions: DataFrame) -> DataFrame:
    """name, expanded, depth, problem, mask, surrogate of each definition (name, expr).

    problem is null, `cycle`, or `undefined: ` and the names that are neither features nor definitions; mask has the
    bits of all features that the expression reads; surrogate is the SHA-256 of the expression without blanks, the
    same for definitions of one meaning written alike. A definition in a cycle has neither text nor surrogate. Of
    rows of one name the first expression counts.
    """
    spark = definitions.sparkSession
    features = charclass.vocabulary(spark).select(F.col("name").alias("id"), "bit")
    texts = written(expanded(definitions), "texts")
    ids = texts.select("name", F.explode(F.array_distinct(F.regexp_extract_all("expanded", F.lit(f"({_NAME})"), 1))).alias("id")).join(features, "id", "left")
    checked = ids.groupBy("name").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("mask"), F.array_sort(F.collect_set(F.when(F.col("bit").isNull(), F.col("id")))).alias("unknown"))
    whole = definitions.select("name").distinct().join(texts, "name", "left").join(checked, "name", "left")
    problem = F.when(F.col("expanded").isNull(), "cycle").when(F.size("unknown") > 0, F.concat(F.lit("undefined: "), F.array_join("unknown", ", ")))
    return whole.select("name", "expanded", "depth", problem.alias("problem"), F.coalesce("mask", F.lit(0).cast("long")).alias("mask"), F.when(F.col("expanded").isNotNull(), sha256(F.regexp_replace("expanded", r"\s+", ""))).alias("surrogate"))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("need", T.LongType()), T.StructField("lack", T.LongType())])))
def _clauses(texts: pd.Series) -> pd.Series:
    def read(text: str | None):
        try:
            return None if text is None else [{"need": n, "lack": x} for n, x in charclass.clauses(text)]
        except ValueError:
            return None

    return texts.map(read)


def masks(registered: DataFrame) -> DataFrame:
    """name, need, lack: the alternatives of each definition of a registry() without a problem.

    Expressions that cannot be read, or have too many alternatives, have no rows.
    """
    return registered.filter("problem is null").select("name", F.explode(_clauses("expanded")).alias("c")).select("name", "c.need", "c.lack")


def satisfied(signatures: DataFrame, alternatives: DataFrame) -> DataFrame:
    """name and sig of each different signature (sig) and expression that it satisfies by one of its masks().

    A signature meets the alternatives by one bit that they need, so those of bits it lacks are never looked at;
    alternatives that need none meet every signature.
    """
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.expr("sig").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b)) != 0)
    sigs = signatures.select("sig").filter("sig is not null").distinct().select("sig", F.explode(F.array_append(bits, F.lit(-1))).alias("bit"))
    # the highest needed bit is the rarest of a kind: it tells a shape, not a character
    rows = alternatives.withColumn("bit", F.when(F.col("need") == 0, -1).otherwise(F.length(F.bin("need")) - 1))
    hit = sigs.join(rows, "bit").filter("sig & need = need and sig & lack = 0")
    return hit.select("name", "sig").distinct()


def matched(symbols: DataFrame, definitions: DataFrame) -> DataFrame:
    """name, surrogate, sym: a row for each sound definition and each symbol (sym) that satisfies it."""
    registered = written(registry(definitions), "registry")
    signed = written(symbols.select("sym").distinct().select("sym", charclass.signature("sym").alias("sig")), "signed")
    return satisfied(signed, masks(registered)).join(signed, "sig").join(registered.select("name", "surrogate"), "name").select("name", "surrogate", "sym")


def report(symbols: DataFrame, definitions: DataFrame) -> DataFrame:
    """registry() with members, how many symbols (sym) satisfy each definition, and first, the smallest of them."""
    registered = written(registry(definitions), "registry")
    signed = charclass.signatures(symbols.select("sym").distinct(), "sym")
    hit = satisfied(signed, masks(registered)).join(signed, "sig").groupBy("name").agg(F.sum("n").alias("members"))
    return registered.join(hit, "name", "left").withColumn("members", F.coalesce("members", F.lit(0).cast("long")))
