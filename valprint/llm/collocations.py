"""Phrases of words that belong together, counted exactly behind hashed bucket bitmaps (operator 13)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from valprint.llm.shared import dropped, written

#: Binary logarithm of the number of buckets, and of the ranges in which their counts are added up.
BITS, RANGES = 22, 6
#: Bytes of text handled at once, and distinct phrases that a task holds before it gives them out.
CHARS, HELD = 4_000_000, 400_000
_STEP, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Lower case for A-Z, a line feed for what ends a piece, a blank for a tab.
_PLAIN = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_COUNTS = "lang string, phrase string, n long, span int, data binary"


def _powers(base: int, n: int) -> np.ndarray:
    """base^0 to base^(n-1) modulo 2^64."""
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, base, np.uint64)]))


#: A word's hash is the sum of its bytes times powers of an odd base modulo 2^64, so all words' hashes come from one
#: running sum; powers are products of those of two halves of their exponent.
_BASE, _HALF = 0xD6E8FEB86659FD93, 16
_BACK = pow(_BASE, -1, 1 << 64)
_LOW, _LOW_BACK = _powers(_BASE, 1 << _HALF), _powers(_BACK, 1 << _HALF)


class _Words:
    """The words of texts joined by line feeds: where they begin and end, their piece, language and hash."""

    def __init__(self, langs: list[int], texts: list[bytes]):
        joined = b"\n".join(texts)
        self.bytes = joined
        data = np.frombuffer(joined + bytes(16), np.uint8)
        text = data[: len(joined)]
        #: at each byte the number that it and the next seven make
        self.eights = np.ndarray(len(joined) + 8, "<u8", data, strides=(1,))
        line = text == 10
        gap = np.concatenate([[True], line | (text == 32), [True]])
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        self.start, self.end = edge[::2], edge[1::2]
        self.piece = np.cumsum(line, dtype=np.int64)[self.start]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.lang = np.repeat(np.array(langs, np.int64), np.diff(np.searchsorted(self.start, np.append(0, np.cumsum(sizes)))))
        high = len(joined) // len(_LOW) + 1
        step = pow(_BASE, len(_LOW), 1 << 64)
        powers = (_powers(step, high)[:, None] * _LOW).ravel()[: len(joined)]
        upto = np.append(np.zeros(1, np.uint64), np.cumsum(powers * text, dtype=np.uint64))
        back = _LOW_BACK[self.start & (len(_LOW) - 1)] * _powers(pow(step, -1, 1 << 64), high)[self.start >> _HALF]
        self.hash = (upto[self.end] - upto[self.start]) * back

    def same(self, a: np.ndarray, b: np.ndarray) -> bool:
        """Whether each word of a has the bytes of the word at the same place in b."""
        size = self.end[a] - self.start[a]
        if (size != self.end[b] - self.start[b]).any():
            return False
        at = 0
        while len(a):
            apart = self.eights[self.start[a] + at] ^ self.eights[self.start[b] + at]
            if (apart << (8 * np.maximum(8 - (size - at), 0)).astype(np.uint64)).any():
                return False
            at += 8
            more = size > at
            a, b, size = a[more], b[more], size[more]
        return True

    def phrases(self, at: np.ndarray, length: int) -> list[bytes]:
        """The phrases of so many words that begin at these words."""
        parts = [[self.bytes[x:y] for x, y in zip(self.start[at + j].tolist(), self.end[at + j].tolist(), strict=True)] for j in range(length)]
        return parts[0] if length == 1 else [b" ".join(p) for p in zip(*parts, strict=True)]


def _longer(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases with a word added."""
    return hashes * _STEP + words


def _bucket(hashes: np.ndarray, langs: np.ndarray, bits: int) -> np.ndarray:
    mixed = (hashes ^ langs) * _SPREAD
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _STEP
    return (mixed >> np.uint64(64 - bits)).astype(np.int64)


def _set(bitmap: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return (bitmap[buckets >> 3] >> (buckets & 7).astype(np.uint8)) & 1 > 0


def _width(bits: int) -> int:
    """Buckets of a range: a whole number of bytes of the bitmap."""
    return 1 << (bits - min(RANGES, bits - 3))


def _bitmap(rows: DataFrame, least: int, bits: int) -> np.ndarray:
    """The buckets that reach the threshold, from rows (span, data) of counts that are cut off at it.

    Counts cut off at the threshold reach it together if and only if the whole counts do. Each range of buckets is
    added up by one task as the counts come in; the driver gets a bit a bucket.
    """
    width, kind = _width(bits), np.min_scalar_type(least)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for span, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = np.frombuffer(data.as_buffer(), kind).astype(np.int64)
                sums[span] = np.minimum(sums[span] + counts, least) if span in sums else counts
        yield pa.RecordBatch.from_pydict({"span": pa.array(list(sums), pa.int32()), "data": pa.array([np.packbits(x >= least, bitorder="little").tobytes() for x in sums.values()], pa.binary())})

    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in rows.select("span", "data").repartition("span").mapInArrow(add, "span int, data binary").collect():
        at = r["span"] * width // 8
        out[at : at + width // 8] = np.frombuffer(r["data"], np.uint8)
    return out


class _Buckets:
    """A task's counts of buckets, cut off at the threshold."""

    def __init__(self, bits: int, least: int):
        self.bits, self.least, self.counts = bits, least, np.zeros(1 << bits, np.min_scalar_type(least))

    def add(self, buckets: np.ndarray) -> None:
        if len(buckets):
            more = np.bincount(buckets, minlength=1 << self.bits)
            self.counts = np.minimum(more + self.counts, self.least).astype(self.counts.dtype)

    def rows(self) -> Iterator[tuple[int, bytes]]:
        width = _width(self.bits)
        for span in range((1 << self.bits) // width):
            part = self.counts[span * width : (span + 1) * width]
            if part.any():
                yield span, part.tobytes()


def _batch(counts: list[tuple[str, str, int]], buckets: list[tuple[int, bytes]] = ()) -> pa.RecordBatch:
    a, b = len(counts), len(buckets)
    columns = [[c[i] for c in counts] + [None] * b for i in range(3)] + [[None] * a + [x[i] for x in buckets] for i in range(2)]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.binary()), strict=True)], [x.split()[0] for x in _COUNTS.split(", ")])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[bytes]]]:
    """Languages and plain bytes of texts, in parts of about CHARS bytes. A longer text is cut where a piece ends."""
    langs: list[str] = []
    texts: list[bytes] = []
    held = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = text.as_buffer().to_pybytes().translate(_PLAIN) if text.is_valid else b""
            at = 0
            while at < len(data):
                to = len(data) if len(data) - at <= CHARS else (data.rfind(b"\n", at, at + CHARS) + 1 or data.find(b"\n", at) + 1 or len(data))
                if held and held + to - at > CHARS:
                    yield langs, texts
                    langs, texts, held = [], [], 0
                langs.append(lang)
                texts.append(data[at:to])
                held += to - at
                at = to
    if texts:
        yield langs, texts


class _Counter:
    """A task's exact counts of the phrases of one length, given out once they are many."""

    def __init__(self, length: int):
        self.length, self.found = length, Counter()
        self.langs: dict[str, int] = {}

    @property
    def voices(self) -> np.ndarray:
        return np.array([xxhash.xxh64_intdigest(x.encode(), 1) for x in self.langs], np.uint64)

    def add(self, words: _Words, hashes: np.ndarray, at: np.ndarray) -> None:
        """Counts the phrases that begin at these words. Phrases of one hash are held against each other's bytes."""
        lang = words.lang[at]
        _, first, inverse, n = np.unique(hashes[at] ^ self.voices[lang], return_index=True, return_inverse=True, return_counts=True)
        head = at[first]
        if (lang != lang[first][inverse]).any() or not all(words.same(at + j, head[inverse] + j) for j in range(self.length)):
            head, n, lang = at, np.ones(len(at), np.int64), lang
        else:
            lang = lang[first]
        for key, count in zip(zip(lang.tolist(), words.phrases(head, self.length), strict=True), n.tolist(), strict=True):
            self.found[key] += count

    def rows(self) -> list[tuple[str, str, int]]:
        langs = list(self.langs)
        out = [(langs[lang], phrase.decode(), n) for (lang, phrase), n in self.found.items()]
        self.found = Counter()
        return out


def _pass(docs: DataFrame, length: int, longest: int, least: int, bits: int, frequent: np.ndarray | None, hopeful: np.ndarray | None) -> DataFrame:
    """One pass over docs (lang, text): counts of phrases of a length, and bucket counts of those a word longer.

    frequent marks the buckets of the frequent phrases a word shorter, hopeful those of this length whose bucket
    count reached the threshold. A place counts if its bucket is hopeful and its first and last words but one are
    frequent; no phrase that reaches the threshold is left out by either. Longer phrases go into buckets only where
    both their parts count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(length)
        buckets = _Buckets(bits, least) if length < longest else None
        for langs, texts in _texts(batches):
            words = _Words([counter.langs.setdefault(x, len(counter.langs)) for x in langs], texts)
            voice = counter.voices[words.lang]
            size = max(0, len(words.hash) - length + 1)  # places with so many words from there on
            hashes, shorter = words.hash, None
            for k in range(1, length):
                shorter, hashes = hashes, _longer(hashes[:-1], words.hash[k:])
            counts = words.piece[:size] == words.piece[length - 1 :]
            if length > 1 and size:
                near = _set(frequent, _bucket(shorter, voice[: len(shorter)], bits))
                at = np.flatnonzero(counts & near[:-1] & near[1:])
                counts[:] = False
                counts[at[_set(hopeful, _bucket(hashes[at], voice[at], bits))]] = True
            if size:
                counter.add(words, hashes, np.flatnonzero(counts))
            if buckets is not None and size > 1:
                at = np.flatnonzero(counts[:-1] & counts[1:] & (words.piece[: size - 1] == words.piece[length:]))
                buckets.add(_bucket(_longer(hashes[at], words.hash[at + length]), voice[at], bits))
            if len(counter.found) > HELD:
                yield _batch(counter.rows())
        yield _batch(counter.rows())
        for row in buckets.rows() if buckets is not None else ():
            yield _batch([], [row])

    return docs.mapInArrow(run, _COUNTS)


def _marked(frequent: DataFrame, least: int, bits: int) -> np.ndarray:
    """The bitmap of the buckets of frequent phrases (lang, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = np.zeros(1 << bits, np.min_scalar_type(least))
        for batch in batches:
            langs = np.array([xxhash.xxh64_intdigest(x.encode(), 1) for x in batch.column(0).to_pylist()], np.uint64)
            words = _Words([0] * batch.num_rows, [x.encode() for x in batch.column(1).to_pylist()])
            first = np.flatnonzero(np.diff(words.piece, prepend=-1))
            hashes, length = words.hash[first], np.diff(np.append(first, len(words.hash)))
            for k in range(1, int(length.max(initial=1))):
                more = length > k
                hashes[more] = _longer(hashes[more], words.hash[first[more] + k])
            buckets[_bucket(hashes, langs, bits)] = least
        held = _Buckets(bits, least)
        held.counts = buckets
        for span, data in held.rows():
            yield pa.RecordBatch.from_arrays([pa.array([span], pa.int32()), pa.array([data], pa.binary())], ["span", "data"])

    return _bitmap(frequent.select("lang", "phrase").mapInArrow(run, "span int, data binary"), least, bits)


def frequent_phrases(docs: DataFrame, longest: int = 5, least: int = 100, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, size, f of all phrases of at most longest words that come least times or more, and lang, n of all words.

    docs has lang and text. Words are counted in a first pass, phrases of k words in the k-th. Each pass also counts
    phrases a word longer in 2^bits hashed buckets. The next one counts exactly only where the bucket and, by a
    bitmap of the frequent phrases' buckets, both parts reach the threshold. Both bitmaps have a fixed size, so what
    is broadcast does not grow with the corpus; with few buckets more is counted and nothing is lost.
    """
    if longest < 1 or least < 1 or not 3 <= bits <= 30:
        raise ValueError("longest and least must be at least 1, bits from 3 to 30")
    docs = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), "text")
    found, words, frequent, hopeful = [], None, None, None
    for k in range(1, longest + 1):
        passed = written(_pass(docs, k, longest, least, bits, frequent, hopeful), "phrases")
        counts = passed.filter("phrase is not null")
        if k == 1:
            words = written(counts.groupBy("lang").agg(F.sum("n").alias("n")), "words")
        mine = written(counts.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter(F.col("f") >= least).select("lang", "phrase", F.lit(k).alias("size"), "f"), "frequent")
        found.append(mine)
        if k < longest and not mine.isEmpty():
            frequent, hopeful = _marked(mine, least, bits), _bitmap(passed.filter("span is not null"), least, bits)
        dropped(passed)
        if mine.isEmpty():
            break
    whole = found[0]
    for f in found[1:]:
        whole = whole.unionByName(f)
    return whole, words


def scored(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """lang, phrase, size, a, l, r, n, score of each phrase of two or more words by its lowest-scoring cut.

    phrases and words come from frequent_phrases(). A cut's score is floor(1000 * a * n / (l * r)), exact in decimals
    of 38 digits; of equals the cut after the fewest words counts. Both parts of a frequent phrase are frequent, so
    they are found by two equi-joins.
    """
    several = phrases.filter("size > 1").withColumnRenamed("f", "a")
    cut = several.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    each = F.split("phrase", " ", -1)
    halves = cut.withColumns({"left": F.array_join(F.slice(each, F.lit(1), F.col("k")), " "), "right": F.array_join(F.slice(each, F.col("k") + 1, F.col("size") - F.col("k")), " ")})
    part = lambda name, f: phrases.select("lang", F.col("phrase").alias(name), F.col("f").alias(f))
    met = halves.join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(words, "lang")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    product = (whole("a") * whole("n")).cast("decimal(34,0)") * F.lit(1000).cast("decimal(4,0)")
    met = met.withColumns({"x": product.cast("decimal(38,0)"), "y": (whole("l") * whole("r")).cast("decimal(38,0)")}).withColumn("score", F.expr("x div y"))
    first = F.min(F.struct("score", "k", "l", "r")).alias("low")
    low = met.groupBy("lang", "phrase", "size", "a", "n").agg(first)
    return low.select("lang", "phrase", "size", "a", "low.l", "low.r", "n", "low.score")


def maximal(phrases: DataFrame, percent: int = 100) -> DataFrame:
    """The phrases (lang, phrase, size, a) of two or more words that lie in no longer one with percent or more of their count.

    A longer phrase that holds one with so many counts does so through phrases one word longer, which have at least
    as many; so each phrase is only held against the two it has when its first or last word is left out.
    """
    long = phrases.filter("size > 2")
    each = F.split("phrase", " ", -1)
    inner = F.explode(F.array(F.array_join(F.slice(each, F.lit(1), F.col("size") - 1), " "), F.array_join(F.slice(each, F.lit(2), F.col("size") - 1), " ")))
    above = long.select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("above"))
    return phrases.join(above, ["lang", "phrase"], "left").filter(f"above is null or 100 * above < {int(percent)} * a").drop("above")


def top_collocations(docs: DataFrame, longest: int = 5, least: int = 100, percent: int = 100, most: int = 2000, bits: int = BITS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first phrases of each lang by score, then count, then bytes.

    Texts lose the case of A-Z and fall into pieces at . , ; : ! ? and line ends, and into words at blanks and tabs;
    other characters, of other scripts or controls, are parts of words. A null text is empty, a null lang is `und`.
    Repeated rows count as often as they come; rows of a null doc_id count like others. An empty table gives no rows;
    further columns, whatever their names, are not read. Ranks are made in two levels, so that no task sorts more
    than its share of a lang's phrases and the first of each share.
    """
    phrases, words = frequent_phrases(docs, longest, least, bits)
    left = maximal(scored(phrases, words), percent)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    shares = left.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    first = shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("rank") <= most)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= most)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
