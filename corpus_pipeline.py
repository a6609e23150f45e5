"""The corpus pipeline: toxicity, language, near copies, benchmark leaks, then packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from valprint.llm import backoff_language, best_fit, near_copies, noisy_or, template_leaks
from valprint.llm.shared import dropped, small_batches, table, written

#: Least language score of a document that stays.
LEAST_SCORE = 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows that the noisy-or model, fitted on labels and these documents, does not call toxic.

    Each row is judged by its own text, with or without doc_id and whatever others share it. A null or empty text is
    not toxic. Without labels nothing is. All columns stay; an empty table gives no rows.
    """
    return noisy_or.without_toxic(docs, noisy_or.learn(docs, table(spark, sf_dir, "labels")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows whose language is found with a score of at least one half.

    Each row is judged by its own text. A text that is null or has no letters goes; so do all if no document has a
    lang to learn from. All columns stay; an empty table gives no rows.
    """
    return backoff_language.of_known_language(docs, backoff_language.learn(docs), LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first row of each group of similar texts: that of the smallest doc_id, rows without one last.

    Operator 7 links texts by their fingerprints and each link is checked exactly; similar texts that it does not reach
    are found by their rare shingles.
    Repeated rows are copies of each other; different texts under one doc_id are not. Null and empty texts are equal.
    All columns stay; an empty table gives no rows.
    """
    return near_copies.first_of_groups(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows that repeat no benchmark item, each judged by its own text; null and empty texts stay.

    All columns stay; an empty table gives no rows, an empty benchmark drops none.
    """
    return template_leaks.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 1024 tokens; a null text counts as empty, repeated rows each."""
    small_batches(spark)
    return best_fit.pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Models and tokenizers are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents. Each stage's rows are written to the shared folder and deleted once the next has read them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        after = written(stage(spark, docs, sf_dir), f"stage-{name}")
        dropped(docs)
        docs = after
    packed = STAGES[-1][1](spark, docs, sf_dir)  # has written its pieces
    dropped(docs)
    return packed
