"""Languages of texts by known words, backing off to shorter character n-grams (operator 3)."""

from __future__ import annotations

import itertools
import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valprint.llm.shared import dropped, forgetful, held_out, kept, kept_rows, slices, written

#: Labelled documents that the model learns from, about, and bytes of them at most, about; it keeps all words and n-grams of theirs.
SAMPLE, BYTES = 8_000, 64_000_000
#: Characters of the longest n-gram, with the marks at a word's ends.
LONGEST = 5
#: Words whose evidence makes a score; longer texts are scored as so many words like their average.
EVIDENCE = 10
#: Words or chunks that a worker remembers; it starts anew beyond them.
MEMO = 200_000

_runs = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    """The runs of letters in a text; signs like ² or ½ are none."""
    found = _runs(text)
    if all(map(str.isalpha, found)):
        return found
    return [w for x in found for w in "".join(c if c.isalpha() else " " for c in x).split()]


def hash_of(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode())


def grams_of(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    """Log frequencies by language (columns, in the order of langs) of words (size 0) and of n-grams of each size.

    They are held by sorted 64-bit hashes.
    """

    langs: list[str]
    tables: dict[int, tuple[np.ndarray, np.ndarray]]
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def find(self, size: int, hashes: np.ndarray) -> np.ndarray:
        """The row of each hash in the table of a size, -1 if it is unknown."""
        known, _ = self.tables.get(size, (np.zeros(0, np.uint64), None))
        if not len(known):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        return np.where(known[at] == hashes, at, -1)

    def of_words(self, words: list[str]) -> np.ndarray:
        """A row of logs for each word: its own if it is known, else the mean of its longest known n-grams, else zeros."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        at = self.find(0, np.fromiter(map(hash_of, words), np.uint64, len(words)))
        known = np.flatnonzero(at >= 0)
        if len(known):
            out[known] = self.tables[0][1][at[known]]
        open_ = np.flatnonzero(at < 0)
        for size in range(LONGEST, 0, -1):
            if not len(open_):
                break
            grams = [grams_of(words[i], size) for i in open_]
            owner = np.repeat(np.arange(len(open_)), np.fromiter(map(len, grams), np.int64, len(grams)))
            at = self.find(size, np.fromiter(map(hash_of, itertools.chain.from_iterable(grams)), np.uint64, len(owner)))
            owner, at = owner[at >= 0], at[at >= 0]
            if len(at):
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                of = owner[first]
                out[open_[of]] = np.add.reduceat(self.tables[size][1][at], first, axis=0) / np.diff(np.append(first, len(at)))[:, None]
                open_ = np.delete(open_, of)
        return out


class Scorer:
    """Sums of a model's word scores for whole texts; remembers the words and the chunks between blanks it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.width = len(model.langs) + 1
        self._forget()

    def _forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.by_word: dict[str, int] = {}
        self.table = np.zeros((1 << 16, self.width), np.float32)  # of each chunk its sums, and its words
        self.word_table = np.zeros((1 << 16, self.width - 1), np.float32)

    @staticmethod
    def _room(table: np.ndarray, rows: int) -> np.ndarray:
        return table if rows <= len(table) else np.concatenate([table, np.zeros((max(len(table), rows - len(table)), table.shape[1]), table.dtype)])

    def _learn(self, chunks: set[str]) -> None:
        if not chunks:
            return
        split = [words_of(c.lower()) for c in chunks]
        new = list(set().union(*split) - self.by_word.keys())
        first = len(self.by_word)
        self.word_table = self._room(self.word_table, first + len(new))
        self.word_table[first : first + len(new)] = self.model.of_words(new)
        self.by_word.update(zip(new, range(first, first + len(new)), strict=True))
        first = len(self.memo)
        self.table = self._room(self.table, first + len(chunks))
        self.memo.update(zip(chunks, range(first, first + len(chunks)), strict=True))
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        some = np.flatnonzero(sizes)
        if len(some):
            flat = np.fromiter(map(self.by_word.__getitem__, itertools.chain.from_iterable(split)), np.int64, int(sizes.sum()))
            self.table[first + some, :-1] = np.add.reduceat(self.word_table[flat], (np.cumsum(sizes) - sizes)[some], axis=0)
        self.table[first : first + len(split), -1] = sizes

    def __call__(self, texts: list[str]) -> np.ndarray:
        """For each text the sum of logs of each language, and its words."""
        split = [t.split() for t in texts]
        if max(len(self.memo), len(self.by_word)) > MEMO:
            self._forget()
        self._learn(set().union(*split) - self.memo.keys())
        get = self.memo.__getitem__
        out = np.zeros((len(texts), self.width))
        for i, chunks in enumerate(split):
            out[i] = self.table[np.fromiter(map(get, chunks), np.int64, len(chunks))].sum(axis=0, dtype=np.float64)
        return out


COUNTED = "lang string, size int, hash long, n long"


def learn(docs: DataFrame, sample: int = SAMPLE, octets: int = BYTES) -> Model:
    """Fits a model on about sample labelled documents (doc_id, text, lang), of about octets bytes at most, chosen by chance.

    The choice is by a hash of a row's doc_id, text and place, so rows that share a doc_id, have none, or repeat each
    other are each chosen or not by themselves; the same table gives the same choice.
    Rows without text or lang and those that held_out() marks teach nothing; a table without any that teach gives a
    model without languages. All words and n-grams of the chosen documents are counted on executors, and all are kept
    as hashes with a count for each language.
    """
    able = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    found, whole = able.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    share = min(1, sample / max(1, found), octets / max(1, whole))
    chosen = able.withColumn("chance", F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(1 << 40))).filter(F.col("chance") < math.ceil(share * (1 << 40)))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, chars=16_000_000):
            counts: Counter = Counter()
            langs = batch.column(1).to_pylist()
            for lang in set(langs):
                of_lang = Counter(itertools.chain.from_iterable(words_of(t.lower()) for t, x in zip(texts, langs, strict=True) if x == lang))
                counts.update({(lang, w): n for w, n in of_lang.items()})
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])

    def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts[lang, 0, hash_of(word)] += n
                for size in range(1, LONGEST + 1):
                    for g in grams_of(word, size):
                        counts[lang, size, hash_of(g)] += n
            lang, size, key = zip(*counts, strict=True) if counts else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(size, pa.int32()), pa.array(np.array(key, np.uint64).view(np.int64)), pa.array(list(counts.values()), pa.int64())], ["lang", "size", "hash", "n"])

    words = chosen.select("text", "lang").mapInArrow(forgetful(count_words), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = written(words.mapInArrow(forgetful(count_grams), COUNTED).groupBy("lang", "size", "hash").agg(F.sum("n").alias("n")), "language-counts")
    totals = {(r[0], r[1]): r[2] for r in counted.groupBy("lang", "size").agg(F.sum("n")).collect()}
    langs = sorted({lang for lang, _ in totals})
    each = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(langs)]
    rows = counted.groupBy("size", "hash").agg(F.lit(0), *each).toArrow()
    size, key = rows.column("size").to_numpy(), rows.column("hash").to_numpy().view(np.uint64)
    counts = np.stack([rows.column(f"n{i}").to_numpy() for i in range(len(langs))], axis=1) if langs else np.zeros((len(key), 0))
    tables = {}
    for s in range(LONGEST + 1):
        mine = np.flatnonzero(size == s)
        mine = mine[np.argsort(key[mine])]
        total = np.array([totals.get((x, s), 0) for x in langs], np.float64)
        # smoothed log frequency of each word or n-gram in each language
        tables[s] = key[mine], np.log((counts[mine] + 0.5) / (total + 0.5 * max(1, len(mine) if s == 0 else 1 << 10))).astype(np.float32)
    dropped(counted)
    return Model(langs, tables)


def _judge(known: Model):
    """What gives of texts, in a task, the number of the language (past the last: undetermined) and its score."""
    scorer = kept(("language", known.key), lambda: Scorer(known))

    def judge(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sums = scorer(texts)
        n = sums[:, -1]
        if not known.langs:
            return np.zeros(len(texts), np.int64), np.zeros(len(texts))
        logs = sums[:, :-1] * (EVIDENCE / np.maximum(n, EVIDENCE))[:, None]
        score = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        return np.where(n > 0, logs.argmax(axis=1), len(known.langs)), np.where(n > 0, score, 0.0)

    return judge


def of_known_language(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs whose language identify() finds with a score of least or more, each by its own text, with all columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def decider():
        judge, many = _judge(sent.value), len(sent.value.langs)

        def decide(texts: list[str]) -> np.ndarray:
            best, score = judge(texts)
            return (best < many) & (score >= least)

        return decide

    return kept_rows(docs, decider)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs (doc_id, text), whole texts.

    A known word adds its log frequency in each language; an unknown one adds the mean of its longest n-grams that
    the model knows, from 5 characters down to 1. The language of the largest sum wins, the first by name in a tie.
    score is its share when the sums are scaled to ten words. A text that is null or has no letters is `und` with
    score 0, and so is every text if the model knows no language. A null doc_id is not held out. Repeated rows get a row
    each, an empty table none; further columns are left out.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge, names = _judge(sent.value), [*sent.value.langs, "und"]
        for batch, texts in slices(batches):
            best, score = judge(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([names[i] for i in best], pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
