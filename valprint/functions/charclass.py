"""Shapes of values as 64-bit signatures, boolean expressions over features, profiles and envelopes."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The feature vocabulary, version 1. Bits keep their meaning for good.
VERSION = 1
FEATURES: dict[int, str] = {
    0: "has_digit", 1: "has_upper", 2: "has_lower", 3: "has_space", 4: "has_dot", 5: "has_comma", 6: "has_dash",
    7: "has_slash", 8: "has_colon", 9: "has_dollar", 10: "has_percent", 11: "has_at", 12: "has_paren", 13: "has_plus",
    14: "has_under", 15: "has_apos", 16: "has_other",
    20: "all_digits", 21: "all_alpha", 22: "all_upper", 23: "all_lower", 24: "title_case", 25: "alnum_only",
    26: "digit_and_alpha", 27: "leads_digit", 28: "leads_alpha", 29: "single_token", 30: "multi_token",
    32: "len_0", 33: "len_1", 34: "len_2", 35: "len_3", 36: "len_4", 37: "len_5", 38: "len_6_10", 39: "len_11_20", 40: "len_gt20",
    44: "money_shaped", 45: "date_shaped", 46: "decimal_shaped", 47: "code_shaped", 48: "email_shaped", 49: "year_shaped",
}
#: The pattern that the vocabulary publishes for each feature; signatures follow byte rules instead.
PATTERNS: dict[str, str] = {
    "has_digit": "[0-9]",
    "has_upper": "[A-Z]",
    "has_lower": "[a-z]",
    "has_space": r"\s",
    "has_dot": r"\.",
    "has_comma": ",",
    "has_dash": "-",
    "has_slash": "/",
    "has_colon": ":",
    "has_dollar": r"\$",
    "has_percent": "%",
    "has_at": "@",
    "has_paren": "[()]",
    "has_plus": r"\+",
    "has_under": "_",
    "has_apos": r"[\x27\x60]",
    "has_other": r"[^\x20-\x7e]",
    "all_digits": "^[0-9]+$",
    "all_alpha": "^[A-Za-z]+$",
    "all_upper": "^[A-Z]+$",
    "all_lower": "^[a-z]+$",
    "title_case": "^[A-Z].*[a-z]",
    "alnum_only": "^[A-Za-z0-9]+$",
    "digit_and_alpha": "^([A-Za-z0-9]*[0-9][A-Za-z0-9]*[A-Za-z]|[A-Za-z0-9]*[A-Za-z][A-Za-z0-9]*[0-9])[A-Za-z0-9]*$",
    "leads_digit": "^[0-9]",
    "leads_alpha": "^[A-Za-z]",
    "single_token": r"^\s*\S+\s*$",
    "multi_token": r"\S\s+\S",
    "len_0": "^$",
    "len_1": "^.$",
    "len_2": "^.{2}$",
    "len_3": "^.{3}$",
    "len_4": "^.{4}$",
    "len_5": "^.{5}$",
    "len_6_10": "^.{6,10}$",
    "len_11_20": "^.{11,20}$",
    "len_gt20": "^.{21,}$",
    "money_shaped": r"(\$.*[0-9])|([0-9].*\$)",
    "date_shaped": r"((\D*[0-9]){4}.*[-/])|([-/].*(\D*[0-9]){4})|([0-9]+[-/][0-9]+[-/][0-9]+)",
    "decimal_shaped": r"^[^A-Za-z]*[0-9][^A-Za-z]*\.[^A-Za-z]*$|^[^A-Za-z]*\.[^A-Za-z]*[0-9][^A-Za-z]*$",
    "code_shaped": "^[A-Z0-9]*[A-Z][A-Z0-9]*$",
    "email_shaped": r"(@.*\.)|(\..*@)",
    "year_shaped": "^[12][0-9]{3}$",
}
#: The features that the vocabulary also gives as expressions.
EXPRESSIONS: dict[str, str] = {
    "digit_and_alpha": "alnum_only & has_digit & (has_upper | has_lower)",
    "money_shaped": "has_dollar & has_digit",
    "decimal_shaped": "has_digit & has_dot & !has_upper & !has_lower & !has_other",
    "code_shaped": "alnum_only & has_upper & !has_lower & single_token",
    "email_shaped": "has_at & has_dot",
}
BITS: dict[str, int] = {name: bit for bit, name in FEATURES.items()}

SPACE = " \t\n\x0b\f\r"


def _predicates(v: Column) -> dict[str, Column]:
    """Each feature of a non-null value. Lengths count bytes; patterns see ASCII classes only."""
    n = F.octet_length(v)
    digits = F.length(F.regexp_replace(v, "[^0-9]", ""))
    has = {name: v.contains(c) for name, c in (("has_dot", "."), ("has_comma", ","), ("has_dash", "-"), ("has_slash", "/"), ("has_colon", ":"), ("has_dollar", "$"), ("has_percent", "%"), ("has_at", "@"), ("has_plus", "+"), ("has_under", "_"))}
    has |= {"has_digit": digits > 0, "has_upper": v.rlike("[A-Z]"), "has_lower": v.rlike("[a-z]"), "has_space": v.rlike(f"[{SPACE}]"), "has_paren": v.rlike("[()]"), "has_apos": v.rlike("['`]"), "has_other": v.rlike(f"[^\\x20-\\x7e{SPACE}]")}
    alnum = v.rlike(r"\A[A-Za-z0-9]+\z")
    many = v.rlike(f"[^{SPACE}][{SPACE}]+[^{SPACE}]")
    some = v.rlike(f"[^{SPACE}]")
    alpha = has["has_upper"] | has["has_lower"]
    out = dict(has)
    out |= {
        "all_digits": v.rlike(r"\A[0-9]+\z"),
        "all_alpha": v.rlike(r"\A[A-Za-z]+\z"),
        "all_upper": v.rlike(r"\A[A-Z]+\z"),
        "all_lower": v.rlike(r"\A[a-z]+\z"),
        "title_case": v.rlike(r"\A[A-Z]") & has["has_lower"],
        "alnum_only": alnum,
        "digit_and_alpha": alnum & has["has_digit"] & alpha,
        "leads_digit": v.rlike(r"\A[0-9]"),
        "leads_alpha": v.rlike(r"\A[A-Za-z]"),
        "single_token": some & ~many,
        "multi_token": many,
        **{f"len_{k}": n == k for k in range(6)},
        "len_6_10": n.between(6, 10),
        "len_11_20": n.between(11, 20),
        "len_gt20": n > 20,
        "money_shaped": has["has_dollar"] & has["has_digit"],
        "date_shaped": (digits >= 4) & (has["has_dash"] | has["has_slash"]),
        "decimal_shaped": has["has_digit"] & has["has_dot"] & ~alpha,
        "code_shaped": alnum & has["has_upper"] & ~has["has_lower"],
        "email_shaped": has["has_at"] & has["has_dot"],
        "year_shaped": v.rlike(r"\A[12][0-9]{3}\z"),
    }
    return out


def signature(value: Column | str) -> Column:
    """The features of a value as bits of a long; null stays null."""
    v = F.col(value) if isinstance(value, str) else value
    total = F.lit(0).cast("long")
    for name, p in _predicates(v).items():
        total = total + F.when(p, F.lit(1 << BITS[name])).otherwise(F.lit(0).cast("long"))
    return F.when(v.isNotNull(), total)


def feature_name(bit: Column) -> Column:
    """The name of a bit, null if it has none."""
    return F.element_at(F.create_map(*[F.lit(x) for b, n in FEATURES.items() for x in (b, n)]), bit.cast("int"))


def feature_bit(name: Column) -> Column:
    """The bit of a name, null if it is unknown."""
    return F.element_at(F.create_map(*[F.lit(x) for b, n in FEATURES.items() for x in (n, b)]), name)


def vocabulary(spark: SparkSession) -> DataFrame:
    """bit, name, regexp and expr of all features."""
    return spark.createDataFrame([(b, n, PATTERNS[n], EXPRESSIONS.get(n)) for b, n in FEATURES.items()], "bit int, name string, regexp string, expr string")


def vocabulary_json() -> Column:
    """The vocabulary as JSON text with its version."""
    features = F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(EXPRESSIONS.get(n)).cast("string").alias("expr"), F.lit(n).alias("name"), F.lit(PATTERNS[n]).alias("regexp")) for b, n in FEATURES.items()])
    return F.to_json(F.struct(features.alias("features"), F.lit(VERSION).alias("version")), {"ignoreNullFields": "false"})


def has_feature(sig: Column, name: str) -> Column:
    return F.shiftright(sig, BITS[name]).bitwiseAND(F.lit(1).cast("long")) == 1


def matches(sig: Column, expression: str) -> Column:
    """Whether a signature satisfies an expression of feature names with ! ~ & ^ | and parentheses.

    ! binds tightest, then &, ^ and |. An unknown name or a wrong expression gives null for every row.
    """
    join = {"|": lambda a, b: a | b, "^": lambda a, b: a != b, "&": lambda a, b: a & b}
    try:
        return _read(expression, lambda name: has_feature(sig, name), lambda a: ~a, join)
    except ValueError:
        return F.lit(None).cast("boolean")


#: Clauses that one expression may have, at most.
MOST_CLAUSES = 1024


def clauses(expression: str) -> list[tuple[int, int]]:
    """The expression as alternatives of two masks, bits that a signature must have and bits that it must lack.

    A signature satisfies it if it does one of them. Alternatives that another one covers are left out. A wrong
    expression, or one of over MOST_CLAUSES alternatives, gives a ValueError.
    """

    def least(found: set) -> frozenset:
        kept: list[tuple[int, int]] = []
        for need, lack in sorted(found, key=lambda c: (c[0].bit_count() + c[1].bit_count(), c)):
            if not any(n & need == n and x & lack == x for n, x in kept):
                kept.append((need, lack))
        if len(kept) > MOST_CLAUSES:
            raise ValueError("too many alternatives")
        return frozenset(kept)

    def both(a: frozenset, b: frozenset) -> frozenset:
        if len(a) * len(b) > MOST_CLAUSES * MOST_CLAUSES:
            raise ValueError("too many alternatives")
        return least({(n | m, x | y) for n, x in a for m, y in b if not (n | m) & (x | y)})

    # each part is known by what makes it true and what makes it false
    join = {
        "&": lambda a, b: (both(a[0], b[0]), least(a[1] | b[1])),
        "|": lambda a, b: (least(a[0] | b[0]), both(a[1], b[1])),
        "^": lambda a, b: (least(both(a[0], b[1]) | both(a[1], b[0])), least(both(a[0], b[0]) | both(a[1], b[1]))),
    }
    leaf = lambda name: (frozenset({(1 << BITS[name], 0)}), frozenset({(0, 1 << BITS[name])}))
    return sorted(_read(expression, leaf, lambda a: (a[1], a[0]), join)[0])


def _read(expression: str, leaf: Callable, invert: Callable, join: dict[str, Callable]):
    """What an expression makes of its names by leaf, invert and join; a ValueError if it is wrong."""
    spans = list(re.finditer(r"\s*([A-Za-z0-9_]+|[!~&^|()])", expression))
    if not spans or "".join(m[0] for m in spans) != expression.rstrip():
        raise ValueError("not an expression")
    value, rest = _level([m[1] for m in spans], 0, leaf, invert, join)
    if rest:
        raise ValueError("something follows the expression")
    return value


#: Binary operators from the loosest to the tightest.
_BINARY = "|^&"


def _level(tokens: list[str], depth: int, leaf: Callable, invert: Callable, join: dict[str, Callable]) -> tuple:
    again = lambda t, d: _level(t, d, leaf, invert, join)
    if depth < len(_BINARY):
        sign = _BINARY[depth]
        value, tokens = again(tokens, depth + 1)
        while tokens[:1] == [sign]:
            other, tokens = again(tokens[1:], depth + 1)
            value = join[sign](value, other)
        return value, tokens
    if not tokens:
        raise ValueError("an operand is missing")
    first, tokens = tokens[0], tokens[1:]
    if first in ("!", "~"):
        value, tokens = again(tokens, depth)
        return invert(value), tokens
    if first == "(":
        value, tokens = again(tokens, 0)
        if tokens[:1] != [")"]:
            raise ValueError("a parenthesis is open")
        return value, tokens[1:]
    if first not in BITS:
        raise ValueError(f"unknown feature {first}")
    return leaf(first), tokens


def signatures(df: DataFrame, value: str, by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """The different signatures of each group with n, how many values (or how much weight) have each.

    Each distinct value is signed once. Columns hold few shapes, so what follows looks at a few rows a group.
    """
    by = by or []
    each = df.groupBy(*by, F.col(value).alias("__val")).agg(F.sum(F.lit(1).cast("long") if weight is None else weight).alias("n"))
    return each.select(*by, signature("__val").alias("sig"), "n").groupBy(*by, "sig").agg(F.sum("n").alias("n"))


def profile(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """bit, name, n, count, pct of each feature that values of a group have; nulls are left out."""
    by = by or []
    sig = signatures(df.filter(F.col(value).isNotNull()), value, by)
    wide = sig.groupBy(*by).agg(F.sum("n").alias("n"), *[F.sum(F.when(has_feature(F.col("sig"), n), F.col("n")).otherwise(0)).alias(n) for n in FEATURES.values()])
    rows = F.explode(F.array(*[F.struct(F.lit(b).alias("bit"), F.lit(n).alias("name"), F.col(n).alias("count")) for b, n in FEATURES.items()]))
    return wide.select(*by, "n", rows.alias("f")).select(*by, "f.bit", "f.name", "n", F.col("f.count").alias("count"), F.round(100 * F.col("f.count") / F.col("n"), 2).alias("pct")).filter("count > 0")


def profile_json(value: Column | str) -> Column:
    """Aggregate: the profile of a group as JSON text; features that no value has are left out."""
    v = F.col(value) if isinstance(value, str) else value
    sig = signature(v)
    n = F.count(v)
    each = [F.when(F.sum(has_feature(sig, name).cast("long")) > 0, F.struct(F.lit(b).alias("bit"), F.sum(has_feature(sig, name).cast("long")).alias("count"), F.lit(name).alias("name"), F.round(100 * F.sum(has_feature(sig, name).cast("long")) / n, 2).alias("pct"))) for b, name in FEATURES.items()]
    return F.to_json(F.struct(F.filter(F.array(*each), lambda x: x.isNotNull()).alias("features"), n.alias("n")))


def necessary(sig: Column | str) -> Column:
    """Aggregate: the features that all values have."""
    return F.bit_and(sig)


def envelope(sig: Column | str) -> Column:
    """Aggregate: the features that any value has."""
    return F.bit_or(sig)


def plausible(sig: Column, need: Column, allow: Column) -> Column:
    """Whether a value has all necessary features and none beyond the envelope."""
    return (sig.bitwiseAND(need) == need) & (sig.bitwiseAND(F.bitwise_not(allow)) == 0)
