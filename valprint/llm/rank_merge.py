"""Token counts by rank-synchronous merging of ragged arrays (operator 5)."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from valprint.llm.shared import kept, slices

#: Entries of a worker's memory of counted chunks; it starts anew beyond them. Longer chunks are not remembered.
MEMO, REMEMBERED = 600_000, 4096
#: Symbols from which on a sequence is merged by looking only at what a merge has touched.
LONG = 512


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def merge_counts(ids: np.ndarray, starts: np.ndarray, pairs: np.ndarray, ranks: np.ndarray, made: np.ndarray, width: int) -> np.ndarray:
    """Symbols that survive in each sequence when no known pair is left.

    ids holds all sequences back to back, starts where each begins (none is empty). pairs are the sorted keys
    left * width + right of known merges, with their rank and the symbol they make. In each round every sequence
    merges all occurrences of its own lowest-ranked pair; finished sequences leave the arrays. Sequences of many
    symbols go through merge_long(), with the same result.
    """
    none = np.iinfo(np.int64).max
    total = np.zeros(len(starts), np.int64)
    sizes = np.diff(np.append(starts, len(ids)))
    owner = np.arange(len(starts))
    if (long := sizes > LONG).any():
        seq = np.repeat(long, sizes)
        total[long] = merge_long(ids[seq], sizes[long], pairs, ranks, made, width)
        ids, sizes, owner = ids[~seq], sizes[~long], owner[~long]
    while len(ids):
        seq = np.repeat(np.arange(len(sizes)), sizes)
        first = np.cumsum(sizes) - sizes
        rank = np.full(len(ids), none)
        key = ids[:-1] * width + ids[1:]
        at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
        known = (pairs[at] == key) & (seq[:-1] == seq[1:])
        rank[:-1][known] = ranks[at[known]]
        lowest = np.minimum.reduceat(rank, first)
        done = lowest == none
        total[owner[done]] = sizes[done]
        hit = (rank == lowest[seq]) & (rank != none)
        # of neighbouring hits in a run (a pair of equal symbols), every second one merges
        index = np.flatnonzero(hit)
        if len(index):
            run = np.concatenate([[True], np.diff(index) != 1])
            begin = index[run][np.cumsum(run) - 1]
            index = index[(index - begin) % 2 == 0]
            ids = ids.copy()
            ids[index] = made[at[index]]
        keep = ~done[seq]
        keep[index + 1] = False
        ids = ids[keep]
        sizes = np.bincount(seq[keep], minlength=len(sizes))[~done]
        owner = owner[~done]
    return total


def merge_long(ids: np.ndarray, sizes: np.ndarray, pairs: np.ndarray, ranks: np.ndarray, made: np.ndarray, width: int) -> np.ndarray:
    """merge_counts() of sequences of many symbols, back to back, in time that follows the merges.

    Symbols are linked to their neighbours. The lowest rank that any sequence has is the lowest of each that has it,
    so all sequences merge it together; then only the pairs beside merged ones are looked up again.
    """
    n = len(ids)
    ids, seq = ids.copy(), np.repeat(np.arange(len(sizes)), sizes)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[np.cumsum(sizes) - 1] = n  # no neighbour
    before[np.cumsum(sizes) - sizes] = n
    now = np.full(n + 1, -1)  # place in pairs of the pair that begins at a symbol
    waiting: dict[int, list[np.ndarray]] = {}
    order: list[int] = []

    def look(at: np.ndarray) -> None:
        now[at] = -1
        at = at[after[at] < n]
        key = ids[at] * width + ids[after[at]]
        found = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
        known = pairs[found] == key
        at, found = at[known], found[known]
        now[at] = found
        by = np.argsort(ranks[found], kind="stable")
        at, of = at[by], ranks[found[by]]
        cut = np.flatnonzero(np.diff(of, prepend=-1))
        for rank, part in zip(of[cut].tolist(), np.split(at, cut[1:]), strict=True) if len(at) else ():
            if rank not in waiting:
                waiting[rank] = []
                heapq.heappush(order, rank)
            waiting[rank].append(part)

    alive = np.ones(n, bool)
    look(np.arange(n))
    while order:
        rank = heapq.heappop(order)
        at = np.unique(np.concatenate(waiting.pop(rank)))
        at = at[alive[at] & (now[at] >= 0)]
        at = at[ranks[now[at]] == rank]
        if not len(at):
            continue
        # of neighbouring hits in a run (a pair of equal symbols), every second one merges
        run = np.append(True, after[at[:-1]] != at[1:])
        place = np.arange(len(at))
        at = at[(place - place[run][np.cumsum(run) - 1]) % 2 == 0]
        gone = after[at]
        ids[at] = made[now[at]]
        alive[gone] = False
        next_ = after[gone]
        after[at] = next_
        some = next_ < n
        before[next_[some]] = at[some]
        left = before[at]
        look(np.unique(np.concatenate([at, left[left < n]])))
    return np.bincount(seq[alive], minlength=len(sizes))


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


class WordCounter:
    """Counts tokens of whole texts for a vocabulary of words with an end mark, as its library does by default."""

    #: Characters whose class no Unicode version changes; other chunks are split by the library.
    _plain = re.compile("[\x01-\u024f]*").fullmatch

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        vocab, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        symbols, end = byte_symbols(), spec["model"]["end_of_word_suffix"]
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + end] for s in symbols], np.int64)
        self.byte = {s: b for b, s in enumerate(symbols)}
        self.width = max(vocab.values()) + 1
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], np.int64)
        # of a pair listed twice the library knows the last rank
        keys, last = np.unique(keys[::-1], return_index=True)
        self.pairs, self.ranks = keys, len(merges) - 1 - last
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)[self.ranks]
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.memo: dict[str, int] = {}
        self.by_word: dict[bytes, int] = {}

    def split(self, chunk: str) -> list[bytes]:
        """The pre-tokens of a normalised chunk, as bytes."""
        if self._plain(chunk):
            return [w.encode() for w in self.words(chunk)]
        return [bytes(map(self.byte.__getitem__, w)) for w, _ in self.splitter.pre_tokenize_str(chunk)]

    def learn(self, chunks: list[str]) -> None:
        """Counts chunks that stand between blanks, all at once."""
        alone = [c for c in chunks if "\0" in c]
        chunks = [c for c in chunks if "\0" not in c] if alone else chunks
        texts = self.normalizer.normalize_str("\0".join(chunks)).split("\0") if chunks else []
        split = [self.split(t) for t in [*texts, *map(self.normalizer.normalize_str, alone)]]
        if len(self.by_word) > MEMO:
            self.by_word.clear()
        new = [w for w in set().union(*split) - self.by_word.keys() if w] if split else []
        if new:
            sizes = np.fromiter(map(len, new), np.int64, len(new))
            starts = np.cumsum(sizes) - sizes
            flat = np.frombuffer(b"".join(new), np.uint8)
            ids = self.inner[flat]
            ends = starts + sizes - 1
            ids[ends] = self.last[flat[ends]]
            self.by_word.update(zip(new, merge_counts(ids, starts, self.pairs, self.ranks, self.made, self.width).tolist(), strict=True))
        get = self.by_word.__getitem__
        self.memo.update((c, sum(map(get, words))) for c, words in zip([*chunks, *alone], split, strict=True))
        for word in [w for w in new if len(w) > REMEMBERED]:
            del self.by_word[word]

    def count(self, texts: list[str]) -> list[int]:
        pieces: list[list[str]] = []
        extra = [0] * len(texts)
        for i, text in enumerate(texts):
            if self.cut is not None and self.cut.search(text):
                parts = self.cut.split(text)
                extra[i] = len(parts) - 1
                pieces.append([c for part in parts for c in part.split(" ")])
            else:
                pieces.append(text.split(" "))
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = set().union(*pieces) - self.memo.keys()
        if new:
            self.learn(list(new))
        get = self.memo.__getitem__
        counts = [n + sum(map(get, p)) for n, p in zip(extra, pieces, strict=True)]
        for chunk in [c for c in new if len(c) > REMEMBERED]:
            del self.memo[chunk]
        return counts


def token_counts(docs: DataFrame, limit: int = 2048, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row of docs (doc_id, text), whole texts.

    A blank (U+0020) never joins two tokens of this vocabulary, so a worker merges each distinct chunk between
    blanks once and adds up the counts. A null text counts as empty: 0 bytes, 0 tokens. A null doc_id stays null; repeated
    rows are counted as often as they come; an empty table gives no rows; further columns are left out. vocabulary is the path of a tokenizers file with an
    end-of-word mark, word_bpe_49k.json if not given; every executor must have it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary or word_vocabulary()
        counter = kept(("words", path), lambda: WordCounter(path))
        for part, texts in slices(batches):
            n = np.array(counter.count(texts), np.int64)
            size = pa.compute.fill_null(pa.compute.binary_length(part.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
