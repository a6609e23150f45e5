"""Spreadsheet formulas by structure: skeletons, clones, popular shapes and similar formulas.

A formula is cut into tokens by one pattern and compared by its tokens, so all of this is columns and groupings; no
formula is parsed into a tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from valprint.sources.scratch import dropped, written

_CELL = r"\$?[A-Z]{1,3}\$?[0-9]{1,7}"
_TOKEN = rf'"[^"]*"|{_CELL}:{_CELL}|{_CELL}|[0-9]+(?:\.[0-9]+)?|[A-Z_][A-Z0-9_.]*|<=|>=|<>|[-+*/^&=<>(),%;:]'


def _is(token: Column, pattern: str) -> Column:
    return token.rlike(rf"\A(?:{pattern})\z")


def tokens(formula: Column | str) -> Column:
    """The tokens of a formula without its leading sign; letters outside strings count as upper case."""
    f = F.col(formula) if isinstance(formula, str) else formula
    return F.regexp_extract_all(F.regexp_replace(F.upper(f), r"\A\s*=", ""), F.lit(f"({_TOKEN})"), 1)


def skeleton(formula: Column | str, indexed: bool = False, literals: bool = True) -> Column:
    """The tokens joined, with cells and ranges as holes, numbered by first place if indexed; literals as # if asked."""
    t = tokens(formula)
    holes = F.array_distinct(F.filter(t, lambda x: _is(x, f"{_CELL}(?::{_CELL})?")))

    def shown(x: Column) -> Column:
        hole = F.concat(F.lit("@"), F.array_position(holes, x).cast("string")) if indexed else F.lit("@")
        kept = F.when(_is(x, f"{_CELL}(?::{_CELL})?"), hole)
        return (kept.when(_is(x, '"[^"]*"|[0-9]+(?:\\.[0-9]+)?'), "#") if literals else kept).otherwise(x)

    return F.array_join(F.transform(t, shown), "")


def functions_of(formula: Column | str) -> Column:
    """The functions that a formula calls, in order of name."""
    f = F.col(formula) if isinstance(formula, str) else formula
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(f), F.lit(r"([A-Z_][A-Z0-9_.]*)\s*\("), 1)))


def depth(formula: Column | str) -> Column:
    """How deep parentheses nest."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(a: Column, x: Column) -> Column:
        now = a["now"] + F.when(x == "(", 1).when(x == ")", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    return F.aggregate(tokens(formula), start, step, lambda a: a["most"])


def arity(formula: Column | str) -> Column:
    """How many different cells and ranges a formula reads."""
    return F.size(F.array_distinct(F.filter(tokens(formula), lambda x: _is(x, f"{_CELL}(?::{_CELL})?"))))


def _flat(formula: Column | str) -> Column:
    """The tokens with cells and ranges as @ and literals as #."""
    return F.transform(tokens(formula), lambda x: F.when(_is(x, f"{_CELL}(?::{_CELL})?"), "@").when(_is(x, '"[^"]*"|[0-9]+(?:\\.[0-9]+)?'), "#").otherwise(x))


def _runs(form: Column | str) -> Column:
    """The set of runs of three tokens of an array; it is bound once, as a lambda evaluates all that it holds each time."""
    t = F.col(form) if isinstance(form, str) else form
    ends = F.concat(F.array(F.lit("^")), t, F.array(F.lit("$")))
    runs = lambda e: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(e) - 2, F.lit(1))), lambda i: F.array_join(F.slice(e, i, 3), " ")))
    return F.element_at(F.transform(F.array(ends), runs), 1)


def shapes(formula: Column | str) -> Column:
    """The set of runs of three skeleton tokens, for comparing formulas as sets."""
    return _runs(_flat(formula))


def clones(formulas: DataFrame) -> DataFrame:
    """skeleton, n and one cell of each group of formulas (sheet, cell, formula) with one indexed skeleton; n = 1 is an anomaly."""
    return formulas.groupBy(skeleton("formula", indexed=True).alias("skeleton")).agg(F.count("*").alias("n"), F.min(F.struct("sheet", "cell")).alias("first"))


def popular(formulas: DataFrame, support: int = 2) -> DataFrame:
    """skeleton and n of flat skeletons that come support times or more."""
    return formulas.groupBy(skeleton("formula").alias("skeleton")).agg(F.count("*").alias("n")).filter(F.col("n") >= support)


def similar(formulas: DataFrame, library: DataFrame, threshold: float = 0.5) -> DataFrame:
    """formula, match, jaccard of formulas and library formulas with the same in_domains and out_domain.

    Both sides have formula, in_domains and out_domain. Formulas of one flat form have the same shapes, so what is
    compared is the distinct forms of each domains, by one common shape; forms that share none never meet. Formulas take
    their matches by their form.
    """
    keys = ["in_domains", "out_domain"]
    a = written(formulas.select("formula", *keys).distinct().withColumn("form", _flat("formula")), "formulas")
    b = written(library.select(F.col("formula").alias("match"), *keys).distinct().withColumn("like", _flat("match")), "library")
    # explode() would have a filter on the runs of every formula
    ways = lambda df, form: df.select(*keys, form).distinct().withColumn("shapes", _runs(form)).select(*keys, form, F.size("shapes").alias("size"), F.explode_outer("shapes").alias("s"))
    met = ways(a, "form").join(ways(b, "like").withColumnRenamed("size", "other"), [*keys, "s"])
    each = met.groupBy(*keys, "form", "like").agg(F.count("*").alias("common"), F.first(F.col("size") + F.col("other")).alias("both"))
    near = each.withColumn("jaccard", F.col("common") / (F.col("both") - F.col("common"))).filter(F.col("jaccard") >= threshold)
    # few forms have many formulas each, which a table of known size spares a shuffle by form
    found = written(near.join(b, [*keys, "like"]).select(*keys, "form", "match", "jaccard"), "forms")
    dropped(b)
    return a.join(found, [*keys, "form"]).select("formula", "match", "jaccard")


def _tokens_of(skeletons: DataFrame) -> DataFrame:
    """skeleton, pos, token, depth of each token; depth is that inside the parentheses that it opens or closes."""
    token = rf'(@[0-9]*|#|"[^"]*"|[0-9]+(?:\.[0-9]+)?|[A-Z_][A-Z0-9_.]*|<=|>=|<>|[-+*/^&=<>(),%;:])'
    each = skeletons.select("skeleton", F.posexplode(F.regexp_extract_all("skeleton", F.lit(token), 1)).alias("pos", "token"))
    order = Window.partitionBy("skeleton").orderBy("pos")
    opens, closes = (F.col("token") == "(").cast("int"), (F.col("token") == ")").cast("int")
    before = F.coalesce(F.sum(opens - closes).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return each.withColumn("depth", before + opens)


def calls(skeletons: DataFrame) -> DataFrame:
    """skeleton, pos, depth, call of each call in skeletons (skeleton), with the text from its name to its closing parenthesis.

    The parentheses of one depth open and close in turn, so a call ends at the next one of its depth. Windows hold one
    skeleton's tokens. Parentheses without a name before them are no calls, and one that never closes has no end.
    """
    tokens = _tokens_of(skeletons.select("skeleton").distinct())
    order = Window.partitionBy("skeleton").orderBy("pos")
    named = tokens.withColumns({"name": F.lag("token").over(order), "at": F.lag("pos").over(order)})
    marks = named.filter("token in ('(', ')')").withColumn("end", F.lead(F.struct("token", "pos")).over(Window.partitionBy("skeleton", "depth").orderBy("pos")))
    spans = marks.filter(F.col("token") == "(").filter(F.col("name").rlike(r"\A[A-Z_]") & (F.col("end.token") == ")")).select("skeleton", F.col("at").alias("first"), F.col("end.pos").alias("last"), "depth")
    inside = spans.join(tokens.select("skeleton", "pos", "token"), "skeleton").filter("pos between first and last")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda t: t["token"]), "")
    return inside.groupBy("skeleton", F.col("first").alias("pos"), "depth").agg(text.alias("call"))


def call_support(formulas: DataFrame) -> DataFrame:
    """call and n, how often each call comes in formulas (formula), in flat skeletons; repeats in one formula count.

    A skeleton is cut up once, however many formulas have it.
    """
    weights = formulas.groupBy(skeleton("formula").alias("skeleton")).agg(F.count("*").alias("w"))
    return calls(weights).join(weights, "skeleton").groupBy("call").agg(F.sum("w").alias("n"))


def guided_cuts(formulas: DataFrame, support: int = 2, known: DataFrame | None = None) -> DataFrame:
    """sheet, cell, pos, call, n: the calls of formulas (sheet, cell, formula) that are popular, where they stand.

    A call is popular with support or more in known (call, n), by default in the formulas themselves. Calls that are
    not are left out, with what only they hold.
    """
    popular_calls = (known if known is not None else call_support(formulas)).filter(F.col("n") >= support)
    flat = formulas.select("sheet", "cell", skeleton("formula").alias("skeleton"))
    cuts = calls(flat).join(popular_calls.select("call", "n"), "call")
    return flat.join(cuts, "skeleton").select("sheet", "cell", "pos", "call", "n")


def measured(formulas: DataFrame) -> DataFrame:
    """skeleton, n, nodes, operators, functions, reads, depth of the flat skeletons of formulas (formula).

    nodes counts calls, operators, cells, ranges and literals; reads counts different cells and ranges of the first
    formula by text.
    """
    each = formulas.groupBy(skeleton("formula").alias("skeleton")).agg(F.count("*").alias("n"), F.min("formula").alias("first"))
    t = F.regexp_extract_all("skeleton", F.lit(r"(@|#|[A-Z_][A-Z0-9_.]*|<=|>=|<>|[-+*/^&=<>(),%;:])"), 1)
    many = lambda pattern: F.size(F.filter(t, lambda x: x.rlike(rf"\A(?:{pattern})\z")))
    operators, names = r"<=|>=|<>|[-+*/^&=<>%]", r"[A-Z_][A-Z0-9_.]*"
    return each.select("skeleton", "n", many(rf"@|#|{names}|{operators}").alias("nodes"), many(operators).alias("operators"), F.size(functions_of("skeleton")).alias("functions"), arity("first").alias("reads"), depth("skeleton").alias("depth"))
