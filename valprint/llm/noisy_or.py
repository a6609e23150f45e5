"""Toxicity by multiple-instance learning: noisy-or over sentence scores (operator 8)."""

from __future__ import annotations

import functools
import itertools
import re
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valprint.llm.shared import held_out, kept, kept_rows, slices

#: Labelled doc_ids that the model learns from, at most; characters of their texts that the driver holds at most; a
#: single text has at most a hundredth of them; and rows for each of these doc_ids on average, at most.
SAMPLE, CHARS, ROWS = 8_000, 64_000_000, 2
#: Documents in which a feature must occur.
LEAST = 3
STEPS, RATE, DECAY = 300, 0.1, 2e-5
#: Log odds of a sentence without evidence.
BIAS = -8.0
#: What a toxic document weighs in the loss; they are the fewer.
POSITIVE = 2.0
#: A document is toxic from this score on, a sentence offends from that.
TOXIC, OFFENDS = 0.7, 0.5
MEMO = 200_000

words_of = re.compile(r"[^\W_]+").findall
ends = re.compile(r"[.!?]\W*\Z").search


def features_of(word: str) -> list[str]:
    """A word and its beginnings, which stand for its other forms."""
    return [word, *(f"{word[:n]}*" for n in range(3, min(len(word), 8)))]


@dataclass
class Model:
    """Weights of features; a sentence's log odds are BIAS plus the weights of the words in its distinct chunks.

    What a sentence without evidence would add is taken off, so the length of a text alone makes no score.
    """

    weights: dict[str, float]
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def of_word(self, word: str) -> float:
        return sum(self.weights.get(f, 0.0) for f in features_of(word))


def sentences_of(text: str) -> list[list[str]]:
    """Chunks between blanks of each sentence: it ends after a chunk with a full stop, ! or ? at its end, or a line."""
    out: list[list[str]] = []
    for line in text.split("\n"):
        open_: list[str] = []
        for chunk in line.split():
            open_.append(chunk)
            if ends(chunk):
                out.append(open_)
                open_ = []
        if open_:
            out.append(open_)
    return out


def fit(texts: list[str], toxic: np.ndarray, least: int = LEAST, steps: int = STEPS) -> Model:
    """Learns weights from whole documents (bags) whose sentences have no labels.

    All features get a weight whose share of toxic documents differs from that of others by more standard errors than
    chance alone gives the largest of so many features, sqrt(2 ln features). P(toxic) is one minus the product
    of the sentences' 1 - p; its log loss falls by Adam over all bags.
    """
    seen = [Counter(), Counter()]
    for text, y in zip(texts, toxic.tolist(), strict=True):
        seen[y].update(set(itertools.chain.from_iterable(map(features_of, set(words_of(text.lower()))))))
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    able = sorted(f for f in seen[1].keys() | seen[0].keys() if seen[1][f] + seen[0][f] >= least)
    chance = (2 * np.log(max(2, len(able)))) ** 0.5
    names = []
    for f in able:
        a, b = seen[1][f], seen[0][f]
        p = (a + b + 1) / (n1 + n0 + 2)
        if abs(a / n1 - b / n0) > chance * (p * (1 - p) * (1 / n1 + 1 / n0)) ** 0.5:
            names.append(f)
    index = {f: i for i, f in enumerate(names)}

    @functools.lru_cache(maxsize=1 << 16)
    def cols_of(word: str) -> tuple[int, ...]:
        return tuple(index[f] for f in features_of(word) if f in index)

    col, row, bag_of = array("i"), array("i"), array("i")
    for d, text in enumerate(texts):
        for s in sentences_of(text):
            for chunk in set(s):
                for w in words_of(chunk.lower()):
                    cols = cols_of(w)
                    col.extend(cols)
                    row.extend([len(bag_of)] * len(cols))
            bag_of.append(d)
    del seen
    col, row, bag_of = (np.frombuffer(x, np.int32) if len(x) else np.zeros(0, np.int32) for x in (col, row, bag_of))
    w, sentences, rest = np.zeros(len(names)), len(bag_of), np.logaddexp(0, BIAS)
    m, v = np.zeros(len(names)), np.zeros(len(names))
    y = toxic.astype(np.float64)
    for t in range(1, steps + 1):
        z = np.bincount(row, w[col], minlength=sentences) + BIAS
        a = np.bincount(bag_of, np.logaddexp(0, z) - rest, minlength=len(y))  # -log of P(not toxic)
        slope = np.where(y > 0, -POSITIVE / np.expm1(np.clip(a, 1e-2, 50)), 1.0) / max(1, len(y))
        dz = slope[bag_of] / (1 + np.exp(-np.clip(z, -30, 30)))
        grad = np.bincount(col, dz[row], minlength=len(names)) + DECAY * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if abs(x) > 1e-2})


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = CHARS) -> Model:
    """Fits a model on the documents of at most sample labelled doc_ids, chosen by a hash of doc_id.

    labels has doc_id and toxic (0, 1; null teaches nothing; of several rows the largest counts). Rows that
    held_out() marks teach nothing, nor do null texts. The driver holds the sample's texts: at most twice as many
    rows as doc_ids and at most chars characters. In the order of the hash, a text that no longer fits, or is longer
    than a hundredth of chars, is left out of the sample whole; all bounds are on labelled rows that teach, no others.
    Without a toxic one among them the model calls nothing toxic.
    """
    spark = docs.sparkSession
    able = labels.filter(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(8))
    chosen = able.orderBy(order, "doc_id").limit(sample).toPandas()
    # from Arrow, as rows of Python's would start a second set of workers, whose server stays on each executor
    ids = spark.createDataFrame(pa.table({"doc_id": pa.array(chosen["doc_id"].tolist(), pa.int64()), "toxic": pa.array(chosen["toxic"].tolist(), pa.int32())}))
    found = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(ids), "doc_id").select("doc_id", "toxic", "text", F.length("text").alias("n"), order.alias("h"))
    # what fits is decided from lengths alone, before any text reaches the driver
    fits = found.filter(F.col("n") <= chars // 100)
    sizes = fits.select("doc_id", "n", "h").orderBy("h", "doc_id", "n").limit(ROWS * sample).toPandas()
    sizes = sizes[sizes["n"].cumsum() <= chars]
    fitting = spark.createDataFrame(pa.table({"doc_id": pa.array(sorted(set(sizes["doc_id"].tolist())), pa.int64())}))
    rows = fits.join(F.broadcast(fitting), "doc_id").select("toxic", "text").orderBy("h", "doc_id", "n").limit(len(sizes)).toPandas()
    return fit(rows["text"].tolist(), (rows["toxic"] > 0).to_numpy().astype(np.int64))


class Scorer:
    """Sentence and document scores of whole texts; remembers the chunks that it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.memo: dict[str, int] = {}
        self.table = np.zeros((1 << 16, 2))  # of each chunk its weight, and 1 if it ends a sentence
        self.by_word: dict[str, float] = {}

    def _learn(self, chunks: set[str]) -> None:
        if len(self.by_word) > MEMO:
            self.by_word.clear()
        while len(self.memo) + len(chunks) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        for chunk in chunks:
            total = 0.0
            for word in words_of(chunk.lower()):
                x = self.by_word.get(word)
                if x is None:
                    x = self.by_word[word] = self.model.of_word(word)
                total += x
            at = self.memo[chunk] = len(self.memo)
            self.table[at] = total, ends(chunk) is not None

    def sentences(self, texts: list[str]) -> list[np.ndarray]:
        """The probability of each sentence of each text, as sentences_of() cuts it."""
        lines = [[line.split() for line in t.split("\n")] for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        self._learn(set().union(*(chunks for doc in lines for chunks in doc)) - self.memo.keys())
        get, out = self.memo.__getitem__, []
        for doc in lines:
            doc = [chunks for chunks in doc if chunks]
            if not doc:
                out.append(np.zeros(0))
                continue
            at = np.fromiter(map(get, itertools.chain.from_iterable(doc)), np.int64)
            last = self.table[at, 1] > 0
            last[np.cumsum([len(c) for c in doc]) - 1] = True
            sentence = np.cumsum(last) - last
            once = np.unique(sentence << 32 | at)
            z = np.bincount(once >> 32, self.table[once & 0xFFFFFFFF, 0]) + BIAS
            out.append(-np.expm1(np.minimum(0, np.logaddexp(0, BIAS) - np.logaddexp(0, z))))
        return out


def noisy_or(each: list[np.ndarray]) -> np.ndarray:
    """The probability that any sentence of a text is toxic, from those of its sentences."""
    return np.array([1 - np.exp(np.log1p(-np.minimum(p, 1 - 1e-13)).sum()) for p in each])


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that score() does not call toxic, each judged by its own text, with all columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def decider():
        known = sent.value
        scorer = kept(("toxicity", known.key), lambda: Scorer(known))
        return lambda texts: noisy_or(scorer.sentences(texts)) < TOXIC

    return kept_rows(docs, decider)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, sentences, offending of each row of docs (doc_id, text), whole texts.

    score is the noisy-or of the sentence scores and 0 for a text that is null or has no sentence. offending lists
    the numbers (from 0) of the sentences that score 0.5 or more, as sentences_of() counts them. A null doc_id is not
    held out. Repeated rows get a row each, an empty table none; further columns are left out.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        scorer = kept(("toxicity", known.key), lambda: Scorer(known))
        for batch, texts in slices(batches):
            each = scorer.sentences(texts)
            total = noisy_or(each)
            bad = [np.flatnonzero(p >= OFFENDS).tolist() for p in each]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(total), pa.array((total >= TOXIC).astype(np.int32)), pa.array([len(p) for p in each], pa.int32()), pa.array(bad, pa.list_(pa.int32()))],
                ["doc_id", "held_out", "score", "predicted", "sentences", "offending"],
            )

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, sentences int, offending array<int>")
