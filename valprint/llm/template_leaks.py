"""Benchmark leaks by windows of template tokens with slot checks (operator 1)."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valprint.llm.shared import kept, kept_rows, slices

#: Tokens of a window; plain words that it must hold, so that placeholders alone match nothing.
WINDOW, PLAIN = 8, 4
#: A leak covers so many tokens of an item in one run, or the whole item if it is shorter.
RUN = 13
#: Benchmark texts' bytes that one broadcast holds, about; a larger benchmark goes out in several.
BLOCK = 32_000_000
MEMO = 200_000
#: Factor of a window's hash; hashes of windows with openers that are made together, about.
POWER, FORMS = 0x9E3779B97F4A7C15, 500_000

UNITS = frozenset("mm cm m km inch inches ft feet yard yards mile miles mg g kg ton tons oz lb lbs ml l liter liters litre litres gallon gallons second seconds sec minute minutes min hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents usd eur degree degrees celsius fahrenheit mph kmh watt watts volt volts joule joules byte bytes kb mb gb tb".split())
#: English words that count, with their numbers; "one" is a pronoun more often and stays a word.
COUNTS = dict(zip("zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split(), [0, *range(2, 21)], strict=True))
COUNTS |= dict(zip("thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split(), [*range(30, 100, 10), 100, 10**3, 10**6, 10**9], strict=True))
#: Words in capitals in a row that are no names but a loud sentence.
LOUD = 3
#: Characters of scripts that write words without blanks; each is a token.
_LONE = "\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff"
_token = re.compile(rf"\d+(?:[.,:/]\d+)*|[{_LONE}]|[^\W\d_{_LONE}]+(?:['’][^\W\d_{_LONE}]+)*")
_plain = re.compile(rf"([^\W\d_{_LONE}]+)([^\w'’]*)").fullmatch
_end = re.compile(r"[.!?:;\n]\W*\Z").search
NUMBER, NAME, UNIT = (xxhash.xxh64_intdigest(x, 1) for x in ("<number>", "<name>", "<unit>"))
#: Kinds of tokens: a plain word, or a slot for one of three kinds of value.
WORD, NUM, NAM, UNI = 0, 1, 2, 3
#: A capitalised word that begins a sentence, which may be either a plain word or a name.
OPENER = 4
#: No tokens: a lone stop between sentences, and the end of a text.
STOP, END = 9, 8
#: A word in capitals, an opener or in a row of LOUD a plain word; a word that counts, which may be a plain word or a number.
CAPS, COUNT = 5, 6


def _kind(word: str, low: str) -> int:
    """The kind of a word by itself, which what stands around it may change."""
    if low in COUNTS:
        return COUNT
    if low in UNITS:
        return UNI
    if low == word or not word[0].isupper():
        return WORD
    if len(word) > 1 and word.isupper():
        return CAPS
    return NAM if len(word) > 1 else WORD


def _value(low: str) -> int:
    """The hash of a lower-case word; that of its digits, of a word that counts."""
    return xxhash.xxh64_intdigest(str(COUNTS.get(low, low)))


class Canon:
    """Turns texts into arrays of template tokens; remembers the chunks between blanks that it has met.

    A number is a slot; so is a unit after one, and a capitalised word that begins no sentence, as a name, with capitals
    inside or not. A word that counts may be a word or a number, and has its number's value. One that begins a sentence is an opener, with the hash of its
    word; so is a word in capitals wherever it stands, but not three in a row, which are words. Further capitalised words with but a blank before them
    belong to the name or the opener, so a name of two words is one token. All else is a lower-case word, a character
    of scripts without blanks by itself. Signs between tokens are left out.
    """

    def __init__(self) -> None:
        self.memo: dict[str | None, int] = {None: 0}  # numbers of chunks, the end of a text first
        self.first, self.size = np.zeros(1, np.int64), np.ones(1, np.int64)  # of each chunk its rows of the table
        self.table = np.array([(0, END, 2)], np.uint64)  # hash of the word, kind at most, 1 if signs follow and 2 if they end a sentence

    def _learn(self, chunks: set[str]) -> None:
        if not chunks:
            return
        values, kinds, afters, sizes = [], [], [], []
        for chunk in chunks:
            one = _plain(chunk)
            if one:  # nearly all are a word with signs after it
                word, after = one.groups()
                low = word.lower()
                values.append(_value(low))
                kinds.append(_kind(word, low))
                afters.append((2 if _end(after) else 1) if after else 0)
                sizes.append(1)
                continue
            found = list(_token.finditer(chunk))
            for i, m in enumerate(found):
                word, after = m[0], chunk[m.end() : found[i + 1].start() if i + 1 < len(found) else None]
                low = word.lower()
                values.append(_value(low))
                kinds.append(NUM if word[0].isdigit() else _kind(word, low))
                afters.append((2 if _end(after) else 1) if after else 0)
            if not found and chunk and _end(chunk):
                values.append(0)
                kinds.append(STOP)
                afters.append(2)
                sizes.append(1)
            else:
                sizes.append(len(found))
        self.memo.update(zip(chunks, range(len(self.memo), len(self.memo) + len(chunks)), strict=True))
        size = np.array(sizes, np.int64)
        self.first = np.concatenate([self.first, len(self.table) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.table = np.concatenate([self.table, np.stack([np.array(x, np.uint64) for x in (values, kinds, afters)], axis=1)])

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Template hash, kind and value of the tokens of all texts, with an END after each text, and where these are."""
        split = [t.replace("\n", "\n ").split(" ") for t in texts]
        if len(self.memo) > MEMO:
            self.__init__()
        self._learn(set().union(*split) - self.memo.keys())
        end = [None]
        at = np.fromiter(map(self.memo.__getitem__, itertools.chain.from_iterable(itertools.chain(s, end) for s in split)), np.int64)
        size = self.size[at]
        rows = self.table[np.repeat(self.first[at] - np.cumsum(size) + size, size) + np.arange(size.sum())]
        value, kind, after = rows[:, 0], rows[:, 1].astype(np.int64), rows[:, 2]
        begins = np.append(True, after[:-1] == 2)[: len(rows)]
        real = kind != STOP
        begins, value, kind, after = begins[real], value[real], kind[real], after[real]
        kind[(kind == NAM) & begins] = OPENER
        caps = kind == CAPS
        if caps.any():
            kind[caps] = OPENER
            for begin, end in _stretches(caps):
                if end - begin >= LOUD:
                    kind[begin:end] = WORD
        before = np.append(0, kind[:-1])[: len(kind)]
        kind[(kind == UNI) & (before != NUM) & (before != COUNT)] = WORD
        named = (kind == NAM) | (kind == OPENER)
        joins = np.append(False, (kind[1:] == NAM) & named[:-1] & (after[:-1] == 0))[: len(kind)]
        if joins.any():
            value, at = value.copy(), np.flatnonzero(joins)
            head = np.maximum.accumulate(np.where(joins, 0, np.arange(len(joins))))[at]
            for k in range(1, int((at - head).max()) + 1):
                on = at - head == k
                value[head[on]] = value[head[on]] * np.uint64(POWER) + value[at[on]]
            kind, value = kind[~joins], value[~joins]
        code = value.copy()
        for k, h in ((NUM, NUMBER), (NAM, NAME), (UNI, UNIT)):
            code[kind == k] = h
        return code, kind, value, np.flatnonzero(kind == END)


def window_hashes(code: np.ndarray, kind: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes of windows of size tokens, where they begin, and how many words each takes as slots; in several parts.

    A window has a hash for each way to take its openers, as words or as names, and its words that count, as words or as
    numbers. No window spans two texts.
    """
    n = len(code) - size + 1
    if n <= 0:
        return
    h = np.zeros(n, np.uint64)
    for j in range(size):
        h = h * np.uint64(POWER) + code[j : j + n]
    ends = np.append(0, np.cumsum(kind == END, dtype=np.int32))
    either = (kind == OPENER) | (kind == COUNT)
    before = np.append(0, np.cumsum(either, dtype=np.int32))
    whole, ways = ends[size:] == ends[:n], before[size:] - before[:n]
    at = np.flatnonzero(whole & (ways == 0))
    yield _mixed(h[at]), at, np.zeros(len(at), np.int8)
    at = np.flatnonzero(whole & (ways > 0))
    for part in np.split(at, np.flatnonzero(np.diff(np.cumsum(1 << ways[at]) // FORMS)) + 1):
        f, at, named = h[part], part, np.zeros(len(part), np.int8)
        for j in range(size):
            on = np.flatnonzero(either[at + j])
            slot = np.where(kind[at[on] + j] == COUNT, np.uint64(NUMBER), np.uint64(NAME))
            other = f[on] + (slot - code[at[on] + j]) * np.uint64(pow(POWER, size - 1 - j, 1 << 64))
            f, at, named = np.concatenate([f, other]), np.concatenate([at, at[on]]), np.concatenate([named, named[on] + np.int8(1)])
        yield _mixed(f), at, named


def _mixed(h: np.ndarray) -> np.ndarray:
    return h ^ (h >> np.uint64(29))


def _low(hashes: list[np.ndarray]) -> np.ndarray:
    low = np.zeros(int(LOW) + 1, bool)
    for h in hashes:
        low[h & LOW] = True
    return low


@dataclass
class Index:
    """Windows of benchmark items, sorted by hash; items with their tokens."""

    items: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]  # item_id, code, kind, value
    windows: dict[tuple[bool, int], tuple[np.ndarray, np.ndarray, np.ndarray]]  # by whether of values, and size: hash, item, place
    low: dict[bool, np.ndarray]  # of the low bits of a hash, whether any window has them


#: Low bits of a hash by which most windows are passed over.
LOW = np.uint64((1 << 20) - 1)


def _needed(kind: np.ndarray, window: int) -> int:
    """Plain words that a window of an item must hold: PLAIN, or all but one of a shorter item's, 2 at least."""
    return PLAIN if len(kind) >= window else min(PLAIN, max(2, int(_wordlike(kind).sum()) - 1))


def _wordlike(kind: np.ndarray) -> np.ndarray:
    return (kind == WORD) | (kind == OPENER) | (kind == COUNT)


def index(rows: list[tuple[int, str]], window: int = WINDOW) -> Index:
    """Items shorter than a window have one window of their own size; items without 3 plain words have none.

    Windows with too few plain words are found by the values of their tokens instead of the template.
    """
    canon = Canon()
    code, kind, value, ends = canon([t or "" for _, t in rows])
    items = [(i, *(x[a:b] for x in (code, kind, value))) for (i, _), a, b in zip(rows, np.append(0, ends + 1)[: len(ends)], ends, strict=True)]
    found: dict[tuple[bool, int], list] = {}
    for at, (_, code, kind, value) in enumerate(items):
        if _wordlike(kind).sum() < 3:
            continue
        size, need = min(window, len(code)), _needed(kind, window)
        plain = np.append(0, np.cumsum(_wordlike(kind)))
        plain = plain[size:] - plain[:-size]
        few = np.zeros(len(plain), bool)
        for h, place, named in window_hashes(code, kind, size):
            enough = plain[place] - named >= need
            few[place[~enough]] = True
            found.setdefault((False, size), []).append((h[enough], np.full(int(enough.sum()), at), place[enough]))
        if few.any():
            for h, place, _ in window_hashes(value, np.zeros_like(kind), size):
                found.setdefault((True, size), []).append((h[few[place]], np.full(int(few[place].sum()), at), place[few[place]]))
    windows = {}
    for key, parts in found.items():
        h, item, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        if len(h):
            order = np.lexsort((place, item, h))
            windows[key] = (h[order], item[order], place[order])
    return Index(items, windows, {v: _low([h for (of, _), (h, _, _) in windows.items() if of == v]) for v in (False, True)})


def met(ix: Index, code: np.ndarray, kind: np.ndarray, value: np.ndarray) -> list[tuple[tuple[bool, int], np.ndarray, np.ndarray]]:
    """By window size, where the tokens hold windows of the benchmark, and the first of these in the index."""
    found = []
    for key, (hashes, _, _) in ix.windows.items():
        of_values, size = key
        for h, at, _ in window_hashes(value, np.where(kind == END, END, WORD), size) if of_values else window_hashes(code, kind, size):
            maybe = np.flatnonzero(ix.low[of_values][h & LOW])
            h, at = h[maybe], at[maybe]
            first = np.searchsorted(hashes, h)
            same = hashes[np.minimum(first, len(hashes) - 1)] == h
            if same.any():
                found.append((key, at[same], first[same]))
    return found


def _consistent(kind: np.ndarray, ours: np.ndarray, theirs: np.ndarray) -> tuple[bool, bool]:
    """Whether equal slots of an item have equal values in the text and unequal ones unequal; whether any changed."""
    slots = kind != WORD
    there: dict = {}
    back: dict = {}
    for k, a, b in zip(kind[slots].tolist(), ours[slots].tolist(), theirs[slots].tolist(), strict=True):
        if there.setdefault((k, a), b) != b or back.setdefault((k, b), a) != a:
            return False, True
    return True, bool((ours[slots] != theirs[slots]).any())


def _longest(kind: np.ndarray, ours: np.ndarray, theirs: np.ndarray, least: int, need: int) -> tuple[int, int, bool] | None:
    """The longest stretch of consistent slots, as begin and end, and whether any changed.

    It has least tokens, and if any changed need plain words.
    """
    same = (kind == WORD) | (ours == theirs)
    plain, other = (np.append(0, np.cumsum(x)).tolist() for x in (kind == WORD, ~same))
    there: dict = {}  # of each value what it stands for, and in how many places of the stretch
    back: dict = {}
    best, left = None, 0
    kinds, ours, theirs = kind.tolist(), ours.tolist(), theirs.tolist()
    for right, k in enumerate(kinds):
        if k != WORD:
            a, b = (k, ours[right]), (k, theirs[right])
            while there.get(a, (b, 0))[0] != b or back.get(b, (a, 0))[0] != a:
                if kinds[left] != WORD:
                    for way, x in ((there, (kinds[left], ours[left])), (back, (kinds[left], theirs[left]))):
                        y, n = way.pop(x)
                        if n > 1:
                            way[x] = (y, n - 1)
                left += 1
            there[a], back[b] = (b, there.get(a, (b, 0))[1] + 1), (a, back.get(b, (a, 0))[1] + 1)
        size = right + 1 - left
        if size >= least and plain[right + 1] - plain[left] >= need and (best is None or size > best[1] - best[0]):
            best = (left, right + 1, other[right + 1] > other[left])
    for begin, end in _stretches(same):
        if end - begin >= least and (best is None or end - begin > best[1] - best[0]):
            best = (begin, end, False)
    return best


def _stretches(on: np.ndarray) -> list[list[int]]:
    """Begin and end of each stretch of True."""
    return np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]]))).reshape(-1, 2).tolist()


def _fits(ours: tuple[np.ndarray, np.ndarray, np.ndarray], theirs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Whether each token of an item (code, kind, value) and of a text can be one, and the kind as which they are.

    An opener is a word to a word or an opener like it, and a name to a name or to another opener. A word that counts is
    a word to itself, and a number to a number or to another.
    """
    (icode, ikind, ivalue), (code, kind, value) = ours, theirs
    opener = (ikind == OPENER) | (kind == OPENER)
    word = opener & (ivalue == value) & (_wordlike(ikind) | (ikind == NAM)) & (_wordlike(kind) | (kind == NAM))
    name = opener & ((ikind == OPENER) | (ikind == NAM)) & ((kind == OPENER) | (kind == NAM))
    counts = (ikind == COUNT) | (kind == COUNT)
    word |= (ikind == COUNT) & (kind == COUNT) & (ivalue == value)
    number = counts & ((ikind == COUNT) | (ikind == NUM)) & ((kind == COUNT) | (kind == NUM))
    fits = word | name | number | (~opener & ~counts & (icode == code) & (ikind == kind))
    return fits, np.where(word, WORD, np.where(name, NAM, np.where(number, NUM, ikind)))


def find(ix: Index, hits: set[tuple[int, int]], code: np.ndarray, kind: np.ndarray, value: np.ndarray, run: int = RUN, window: int = WINDOW) -> list[tuple[int, int, int, int, bool, bool]]:
    """For each item that a text leaks: item_id, first token, tokens covered, item tokens, changed, whole.

    hits are items and by how much later the text has a window of theirs.
    """
    best: dict[int, tuple] = {}
    for at, shift in sorted(hits):
        item_id, icode, ikind, ivalue = ix.items[at]
        lo, hi = max(0, -shift), min(len(icode), len(code) - shift)
        part = slice(lo + shift, hi + shift)
        fits, both = _fits((icode[lo:hi], ikind[lo:hi], ivalue[lo:hi]), (code[part], kind[part], value[part]))
        least, need = min(run, len(icode)), _needed(ikind, window)
        for begin, end in _stretches(fits):
            if end - begin < least or (at in best and end - begin <= best[at][2]):
                continue
            slots = both[begin:end], ivalue[lo + begin : lo + end], value[part][begin:end]
            whole, changed = _consistent(*slots)
            if whole and (not changed or (slots[0] == WORD).sum() >= need):
                found = (0, end - begin, changed)
            else:
                found = _longest(*slots, least, need)
            if found and (at not in best or found[1] - found[0] > best[at][2]):
                length = found[1] - found[0]
                best[at] = (item_id, lo + shift + begin + found[0], length, len(icode), found[2], length == len(icode))
    return list(best.values())


def found_in(ix: Index, canon: Canon, texts: list[str], run: int = RUN, window: int = WINDOW) -> list[tuple[int, int, int, int, int, bool]]:
    """Number of the text, item_id, first token, tokens covered, item tokens and changed of each leak in texts."""
    code, kind, value, ends = canon(texts)
    hits: dict[int, set[tuple[int, int]]] = {}
    for key, at, first in met(ix, code, kind, value):
        hashes, item, place = ix.windows[key]
        d = np.searchsorted(ends, at)
        last = np.searchsorted(hashes, hashes[first], "right")
        for doc, i, a, b in zip(d.tolist(), (at - np.append(0, ends + 1)[d]).tolist(), first.tolist(), last.tolist(), strict=True):
            hits.setdefault(doc, set()).update(zip(item[a:b].tolist(), (i - place[a:b]).tolist(), strict=True))
    rows = []
    for d in sorted(hits):
        part = slice(ends[d - 1] + 1 if d else 0, ends[d])
        rows += [(d, item, first, n, size, changed) for item, first, n, size, changed, _ in find(ix, hits[d], code[part], kind[part], value[part], run, window)]
    return rows


def _indexes(spark: SparkSession, benchmark: DataFrame, window: int, block: int) -> Iterator:
    """The benchmark's index in broadcasts of about block bytes of text."""
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block))
    for b in range(blocks):
        part = benchmark.filter(F.col("text").isNotNull() & (F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b))
        yield spark.sparkContext.broadcast(index(sorted({(r[0], r[1]) for r in part.select("item_id", "text").collect()}, key=lambda r: (r[0] is None, r)), window))


def without_leaks(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of docs that leaks() finds nothing in, each judged by its own text, with all columns."""
    for sent in _indexes(docs.sparkSession, benchmark, WINDOW, block):

        def decider(sent=sent):
            ix, canon = sent.value, kept(("templates",), Canon)

            def decide(texts: list[str]) -> np.ndarray:
                clean = np.ones(len(texts), bool)
                clean[[x[0] for x in found_in(ix, canon, texts)]] = False
                return clean

            return decide

        docs = kept_rows(docs, decider)
    return docs


LEAK = "doc_id long, item_id long, first_token int, covered_tokens int, item_tokens int, reparameterised boolean"


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, run: int = RUN, block: int = BLOCK) -> DataFrame:
    """A row for each document (doc_id, text) and benchmark item (item_id, text) that the document repeats.

    Both become template tokens: numbers in digits or words, units after numbers and names are typed slots. A document leaks an item
    if 13 or more tokens in a row (all, of a shorter item) have the item's template and slots are filled
    consistently, one value for one value; the longest such stretch is given. A capitalised word that opens a
    sentence, and a word in capitals, pass as the word and as a name. reparameterised says that some value differs from the item's. The
    windows of 8 tokens with 4 plain words (of a shorter item all but one of its plain words, 2 at least) join by hash
    against the benchmark's, which goes out in broadcasts of about 32 MB of text; windows with fewer join by their
    values, so passages of hardly any words are found if some window of 8 tokens is as in the item. Each broadcast is
    joined with all documents, so no window is shuffled and a passage that many documents share stays in their tasks. A null or empty text leaks nothing and is leaked by none, nor are items with fewer
    than 3 plain words. Repeated rows get rows of their own.
    """
    found = None
    for sent in _indexes(docs.sparkSession, benchmark, window, block):

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ix, canon = sent.value, kept(("templates",), Canon)
            for batch, texts in slices(batches):
                doc_ids = batch.column(0)
                rows = [(doc_ids[d].as_py(), item, first, n, size, changed) for d, item, first, n, size, changed in found_in(ix, canon, texts, run, window)]
                names, kinds = zip(*(x.strip().split(" ") for x in LEAK.split(",")), strict=True)
                types = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], types[k]) for i, k in enumerate(kinds)], list(names))

        one = docs.select("doc_id", "text").mapInArrow(search, LEAK)
        found = one if found is None else found.unionByName(one)
    return found
