"""Registries: domains with their members, and named expressions over features."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valprint.functions import charclass
from valprint.functions.hashing import normalized, sha256
from valprint.operators import chunked


def enumerations(members: DataFrame) -> DataFrame:
    """domain_name, member_count, filter_b64 of members (domain_name, label), one for each label without case and accents."""
    folded = members.filter(F.col("label").isNotNull()).select("domain_name", normalized("label").alias("label")).distinct()
    sent = chunked.exported(chunked.build(folded.select(F.col("domain_name").alias("cid"), F.col("label").alias("val"))))
    text = F.translate(F.base64("data"), "\r\n", "").alias("filter_b64")
    return folded.groupBy("domain_name").agg(F.count("*").alias("member_count")).join(sent.withColumnRenamed("cid", "domain_name"), "domain_name").select("domain_name", "member_count", text)


def refreshed(registry: DataFrame, new: DataFrame) -> DataFrame:
    """registry with the rows of domains in new replaced by new's."""
    return registry.join(new.select("domain_name").distinct(), "domain_name", "left_anti").unionByName(new)


def labels_of(row_label: Column, others: Column) -> Column:
    """A label and its other labels as one array without repeats or blanks."""
    return F.filter(F.array_distinct(F.transform(F.concat(F.array(row_label), F.coalesce(others, F.array().cast("array<string>"))), lambda x: F.trim(x))), lambda x: x != "")


def code_forms(code: Column, description: Column, width: int) -> Column:
    """A code plain and padded with zeros, its description, and both together."""
    return F.array_distinct(F.array(code, F.lpad(code, width, "0"), description, F.concat_ws(" ", code, description)))


def near_boxes(boxes: DataFrame, left: tuple[float, float], right: tuple[float, float], reach: float) -> DataFrame:
    """page_id, text, other: texts with x in left beside texts with x in right whose y differs by less than reach.

    boxes has page_id, x, y and text. A band join: both sides meet in buckets of y, one of them in three.
    """
    cell = F.floor(F.col("y") / reach)
    a = boxes.filter(F.col("x").between(*left)).select("page_id", "text", F.col("y").alias("ya"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    b = boxes.filter(F.col("x").between(*right)).select("page_id", F.col("text").alias("other"), F.col("y").alias("yb"), cell.alias("cell"))
    return a.join(b, ["page_id", "cell"]).filter(F.abs(F.col("ya") - F.col("yb")) < reach).select("page_id", "text", "other")


_name = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
#: Rounds of replacing names by their expressions; a name still left then is in a cycle.
ROUNDS = 8


def composites(defined: dict[str, str]) -> dict[str, dict]:
    """For each named expression: inlined text, whether it is valid, its problem, surrogate and participation mask.

    Composites are a handful of definitions by hand, so this is plain Python; they apply to rows as columns.
    """
    out = {}
    for name, text in defined.items():
        for _ in range(ROUNDS):
            if not any(n in defined for n in _name.findall(text)):
                break
            text = _name.sub(lambda m: f"({defined[m[0]]})" if m[0] in defined else m[0], text)
        names = set(_name.findall(text))
        cycle = sorted(names & defined.keys())
        unknown = sorted(names - defined.keys() - charclass.BITS.keys())
        out[name] = {
            "expanded": text,
            "valid": not cycle and not unknown,
            "problem": "cycle" if cycle else f"undefined: {', '.join(unknown)}" if unknown else None,
            "mask": sum(1 << charclass.BITS[n] for n in names if n in charclass.BITS),
            "canonical": re.sub(r"\s+", "", text),
        }
    return out


def composite_symbols(symbols: DataFrame, defined: dict[str, str]) -> DataFrame:
    """name, surrogate, sym: a row for each valid composite and each symbol (sym) that it matches."""
    sig = symbols.select("sym", charclass.signature("sym").alias("sig"))
    rows = F.array(*[F.struct(F.lit(n).alias("name"), sha256(F.lit(c["canonical"])).alias("surrogate"), charclass.matches(F.col("sig"), c["expanded"]).alias("hit")) for n, c in composites(defined).items() if c["valid"]])
    return sig.select("sym", F.explode(rows).alias("r")).filter("r.hit").select("r.name", "r.surrogate", "sym")


def composite_matches(symbols: DataFrame, defined: dict[str, str]) -> DataFrame:
    """name, surrogate and matched, the symbols (sym) of each valid composite in one text: for a few symbols to look at."""
    valid = [(n, c["canonical"]) for n, c in composites(defined).items() if c["valid"]]
    names = symbols.sparkSession.createDataFrame(valid, "name string, canonical string").select("name", sha256("canonical").alias("surrogate"))
    listed = composite_symbols(symbols, defined).groupBy("name").agg(F.array_join(F.sort_array(F.collect_list("sym")), ", ").alias("matched"))
    return names.join(listed, "name", "left").select("name", "surrogate", F.coalesce("matched", F.lit("")).alias("matched"))


def envelope_report(members: DataFrame, declared: DataFrame) -> DataFrame:
    """domain, underdeclared, overdeclared: features that all members (domain, m) have against declared ones (domain, feature_name)."""
    need = members.groupBy("domain").agg(charclass.necessary(charclass.signature("m")).alias("need"))
    claim = declared.withColumn("bit", charclass.feature_bit(F.col("feature_name"))).filter("bit is not null").groupBy("domain").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("claim"))
    both = need.join(claim, "domain", "left").withColumn("claim", F.coalesce("claim", F.lit(0).cast("long")))
    has = lambda c, n: charclass.has_feature(F.col(c), n)
    only = lambda a, b: F.array_join(F.filter(F.array(*[F.when(has(a, n) & ~has(b, n), F.lit(n)) for n in charclass.FEATURES.values()]), lambda x: x.isNotNull()), ",")
    return both.select("domain", only("need", "claim").alias("underdeclared"), only("claim", "need").alias("overdeclared"))


def broken_features(declared: DataFrame) -> DataFrame:
    """domain and broken_fk: declared names that the vocabulary lacks."""
    return declared.filter(charclass.feature_bit(F.col("feature_name")).isNull()).select("domain", F.col("feature_name").alias("broken_fk"))


def discriminators(symbols: DataFrame, admitted: str, kept: str) -> DataFrame:
    """term, pct_in_stragglers, pct_in_keepers: features more frequent in what an expression admits but should not keep."""
    s = charclass.signatures(symbols, "sym").filter(charclass.matches(F.col("sig"), admitted)).withColumn("keep", charclass.matches(F.col("sig"), kept))
    part = lambda n, who: F.sum(F.when(who & charclass.has_feature(F.col("sig"), n), F.col("n")).otherwise(0)) / F.nullif(F.sum(F.when(who, F.col("n")).otherwise(0)), F.lit(0))
    sums = s.agg(*[part(n, ~F.col("keep")).alias(f"s_{n}") for n in charclass.FEATURES.values()], *[part(n, F.col("keep")).alias(f"k_{n}") for n in charclass.FEATURES.values()])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("term"), F.round(100 * F.col(f"s_{n}"), 1).alias("pct_in_stragglers"), F.round(100 * F.col(f"k_{n}"), 1).alias("pct_in_keepers")) for n in charclass.FEATURES.values()]))
    return sums.select(rows.alias("r")).select("r.*").filter(F.coalesce("pct_in_stragglers", F.lit(0.0)) > F.coalesce("pct_in_keepers", F.lit(0.0)))


def refined_counts(symbols: DataFrame, old: str, new: str, clean: str) -> DataFrame:
    """What a refined expression drops, and how much of that it should not have."""
    sig = F.col("sig")
    r = charclass.signatures(symbols, "sym").select(charclass.matches(sig, old).alias("o"), charclass.matches(sig, new).alias("k"), charclass.matches(sig, clean).alias("c"), "n")
    many = lambda x: F.coalesce(F.sum(F.when(x, F.col("n"))), F.lit(0).cast("long"))
    o, k, c = F.col("o"), F.col("k"), F.col("c")
    return r.agg(many(o).alias("old_syms"), many(k).alias("new_syms"), many(o & ~k).alias("dropped"), many(k & ~c).alias("dirt_wrongly_kept"), many(o & ~k & c).alias("clean_wrongly_dropped"))


#: The shapes of the coverage report.
SHAPES = {"email": "email_shaped", "date": "date_shaped", "decimal": "decimal_shaped", "all_digits": "all_digits", "code": "code_shaped", "all_upper": "all_upper", "all_alpha": "all_alpha", "has_letters": "has_upper | has_lower", "multi_token": "multi_token", "has_paren": "has_paren"}


def shape_coverage(weighted: DataFrame, shapes: dict[str, str] | None = None) -> DataFrame:
    """cid, shape, pct: the part of each column's weight on values of each shape, and `none` for what has no shape.

    weighted has cid, val and freq. Shapes overlap, so parts may add up to over 100.
    """
    shapes = shapes or SHAPES
    rows = charclass.signatures(weighted.filter(F.col("val") != ""), "val", ["cid"], F.col("freq")).withColumnRenamed("n", "freq")
    hits = {n: charclass.matches(F.col("sig"), e) for n, e in shapes.items()}
    any_ = F.lit(False)
    for h in hits.values():
        any_ = any_ | h
    sums = rows.groupBy("cid").agg(F.sum("freq").alias("w"), *[F.sum(F.when(h, F.col("freq")).otherwise(0.0)).alias(n) for n, h in hits.items()], F.sum(F.when(~any_, F.col("freq")).otherwise(0.0)).alias("none"))
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("shape"), F.round(100 * F.col(n) / F.col("w"), 2).alias("pct")) for n in [*shapes, "none"]]))
    return sums.select("cid", each.alias("s")).select("cid", "s.shape", "s.pct").filter("pct > 0")
