"""Operators 11 to 13 against the tokenizers library, numpy and plain counts, with hard rows."""

import collections
import itertools
import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from valprint.llm import binary_pieces, collocations, tiled_covariance
from valprint.llm.queries import LLM_ORACLES, LLM_QUERIES

SF = "/root/testdata/sf0.001"
EXTRA = "bucket long, part string, place long, f string, phrase string, x long, component string, __row int"
HARD = ["", " ", "a  b", "x\n\n y  z\n", "A<|endoftext|>b", "İstanbul ΣΑΣ ß", "日本語 テキスト 🙂🙂", "a" * 9000, "word " * 30_000, "zero\0byte", None, "b", "b"]


def hard_docs(spark):
    rows = [(i, t, None if i == 2 else "en", 7, "x", 7, "x", "x", 7, "x", 7) for i, t in enumerate(HARD)]
    return spark.createDataFrame([*rows, rows[3], (None, *rows[4][1:])], f"doc_id long, text string, lang string, {EXTRA}")


def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


# 11


def tokens_of(docs):
    rows = docs.select("doc_id", "text").collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [(r["doc_id"], np.array([*e.ids, 1], "<u4")) for r, e in zip(rows, t.encode_batch([r["text"] or "" for r in rows], add_special_tokens=False), strict=True)]


def expected_pieces(docs, capacity):
    want = collections.Counter()
    for doc_id, ids in tokens_of(docs):
        at = 0
        while at < len(ids):
            n = min(capacity, 1 << (len(ids) - at).bit_length() - 1)
            want[doc_id, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids)] += 1
            at += n
    return want


@pytest.mark.parametrize("capacity", [2048, 8, 1])
def test_pieces_equal_the_binary_digits_of_each_document(spark, capacity):
    docs = [hard_docs(spark)] if capacity < 2048 else [hard_docs(spark), spark.read.parquet(f"{SF}/documents.parquet")]
    for d in docs:
        rows = binary_pieces.pack(d.repartition(3), capacity).collect()
        assert collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == expected_pieces(d, capacity)
        assert len({r["sequence_id"] for r in rows}) == len(rows) and all(r["offset"] == 0 for r in rows)
        for b, each in itertools.groupby(sorted(rows, key=lambda r: (r["bucket"], r["slot"])), key=lambda r: r["bucket"]):
            each = list(each)
            assert [r["slot"] for r in each] == list(range(len(each))) and {r["length"] for r in each} == {1 << b}


def test_batches_hold_equal_lengths_and_tokens(spark):
    packed = binary_pieces.pack(spark.read.parquet(f"{SF}/documents.parquet"))
    found = binary_pieces.batches(packed, 4096).groupBy("bucket", "batch").agg(F.count("*").alias("n"), F.count_distinct("length").alias("kinds"), F.sum("length").alias("tokens")).collect()
    last = {b: max(r["batch"] for r in found if r["bucket"] == b) for b in {r["bucket"] for r in found}}
    assert all(r["kinds"] == 1 for r in found) and all(r["tokens"] == 4096 for r in found if r["batch"] < last[r["bucket"]])
    assert sorted(r["batch"] for r in found if r["bucket"] == 11) == list(range(last[11] + 1))


def test_ids_of_very_long_runs():
    from valprint.llm.byte_ids import encoder

    texts = ["a" * 300_000, " " * 1_500_000 + "x", "^" * 300_000, "\n" * 300_000 + " y", "é" * 100_000, "12" * 100_000, "  ab" * 60_000, "x \u3000" * 60_000]
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text, ids in zip(texts, encoder().encode(texts), strict=True):
        assert ids == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text[:3]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 70_000), min_size=1, max_size=20), st.integers(0, 12))
def test_decompose(sizes, log):
    n, lengths = binary_pieces.decompose(np.array(sizes), 1 << log)
    at = 0
    for size, k in zip(sizes, n.tolist(), strict=True):
        mine = lengths[at : at + k].tolist()
        assert sum(mine) == size and all(x & (x - 1) == 0 and x <= 1 << log for x in mine) and mine == sorted(mine, reverse=True)
        assert len({x for x in mine if x < 1 << log}) == sum(x < 1 << log for x in mine)
        at += k
    assert at == len(lengths)


def test_no_documents_give_no_pieces(spark):
    assert binary_pieces.pack(no_docs(spark)).count() == 0
    with pytest.raises(ValueError, match="power of two"):
        binary_pieces.pieces(no_docs(spark), 1000)


# 12


def plain_whitening(vectors, components=4):
    """n, and for each vector deviation and whitened values, by numpy and Python numbers."""
    x = [[math.floor(256 * float(c)) for c in v] for v in vectors]
    unique = [list(t) for t in dict.fromkeys(map(tuple, x))]
    n, sums = len(unique), [sum(c) for c in zip(*unique, strict=True)]
    away = np.array([[(c * n - s) / n for c, s in zip(r, sums, strict=True)] for r in unique])
    e, v = np.linalg.eigh(away.T @ away / n)
    e, v = e[::-1], v[:, ::-1]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
    w = np.array([[(c * n - s) / n for c, s in zip(r, sums, strict=True)] for r in x]) @ v[:, :components] / np.sqrt(e[:components])
    return n, deviation, w, e[:components] / e.sum()


def whitened_rows(spark, vectors, **how):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, x long, component string")
    return tiled_covariance.whitened(df.repartition(3), **how).collect()


@pytest.mark.parametrize(("d", "tile", "rows"), [(7, 3, 10), (4, 32, 4096), (33, 32, 64), (2, 1, 1)])
def test_whitening_equals_numpy(spark, d, tile, rows):
    rng = np.random.default_rng(d)
    base = rng.normal(size=(90, d)) * np.arange(1, d + 1) + 1e6  # far from zero, so centring matters
    vectors = [*base.tolist(), base[3].tolist(), base[3].tolist()]
    n, deviation, w, share = plain_whitening(vectors)
    found = whitened_rows(spark, vectors, tile=tile, rows=rows)
    assert len(found) == len(vectors) * min(4, d) and {r["n"] for r in found} == {n}
    signs = {}
    for r in found:
        i, k = r["vec_id"], r["component"] - 1
        assert r["deviation"] == deviation[i]
        s = signs.setdefault(k, math.copysign(1, r["whitened"] * w[i, k]) if abs(w[i, k]) > 1e-3 else 1)
        assert r["whitened"] == pytest.approx(s * w[i, k], rel=1e-7, abs=1e-7)
        assert r["explained"] == pytest.approx(share[k], rel=1e-9) and r["identity_error"] < 1e-9


def test_whitening_of_odd_rows(spark):
    rows = [[1.0, 2.0, 0.5], [2.0, 1.0, 0.5], [3.0, 4.0, 0.5], [3.0, 4.0, 0.5], None, [1.0, None, 2.0], [1.0, float("nan"), 2.0], [1.0, float("inf"), 2.0], [1.0], []]
    found = whitened_rows(spark, rows)
    assert sorted({r["vec_id"] for r in found}) == [0, 1, 2, 3] and {r["n"] for r in found} == {3}
    # the third dimension never changes: two components have variance
    assert all((r["whitened"] is None) == (r["component"] == 3) for r in found) and all(r["identity_error"] < 1e-9 for r in found)
    one = whitened_rows(spark, [[1.0, 2.0]] * 3)
    assert len(one) == 6 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 and r["n"] == 1 for r in one)
    assert whitened_rows(spark, [None, []]) == [] and tiled_covariance.whitened(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    huge = whitened_rows(spark, [[1e15, 1.0], [-1e15, 2.0], [5e14, 7.0]])
    assert all(r["deviation"] is None for r in huge) and all(r["identity_error"] < 1e-9 for r in huge)


def test_whitening_of_a_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    vectors = {r["vec_id"]: r["embedding"] for r in table.collect()}
    n, deviation, w, share = plain_whitening(list(vectors.values()))
    place = {v: i for i, v in enumerate(vectors)}
    found = LLM_QUERIES["op12_tiled_whitening"](spark, SF).collect()
    assert len(found) == 4 * len(vectors)
    assert all(r["deviation"] == deviation[place[r["vec_id"]]] and abs(abs(r["whitened"]) - abs(w[place[r["vec_id"]], r["component"] - 1])) < 1e-8 for r in found)
    assert {round(r["explained"], 12) for r in found} == {round(float(s), 12) for s in share}


# 13


def plain_collocations(docs, longest=5, least=100, percent=100, most=2000):
    """The rows of top_collocations() by counting everything."""
    count, n = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = lang or "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    count[lang, tuple(words[i : i + k])] += 1
    often = {p: f for p, f in count.items() if f >= least}
    out = []
    for (lang, p), a in often.items():
        if len(p) == 1:
            continue
        cuts = [(1000 * a * n[lang] // (often[lang, p[:k]] * often[lang, p[k:]]), k, often[lang, p[:k]], often[lang, p[k:]]) for k in range(1, len(p))]
        longer = (q for (other, q), f in often.items() if other == lang and len(q) > len(p) and 100 * f >= percent * a)
        if not any(q[i : i + len(p)] == p for q in longer for i in range(len(q) - len(p) + 1)):
            score, _, l, r = min(cuts)
            out.append((lang, " ".join(p), a, l, r, n[lang], score))
    rows = []
    for lang in n:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:most]
        rows += [(lang, i + 1, *x[1:]) for i, x in enumerate(mine)]
    return sorted(rows)


def collocation_rows(spark, docs, **how):
    df = spark.createDataFrame([(i, t, lang, 1, "x") for i, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string, n long, phrase string")
    return sorted(map(tuple, collocations.top_collocations(df.repartition(3), **how).collect()))


def test_collocations_of_random_texts(spark):
    rng = np.random.default_rng(5)
    words = ["a", "B", "ab", "É", "é", "x\x00y", "ﬁ", "the", "of", "日本"]
    seps = [" ", "  ", "\t", ". ", ",", "\n", "!x? ", "\x0b", " ", " "]
    docs = [(str(rng.choice(["en", "fr"])), "".join(str(rng.choice(words, p=[0.3, 0.2, *[0.0625] * 8])) + str(rng.choice(seps, p=[0.6, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05, 0.02, 0.03, 0.05])) for _ in range(rng.integers(0, 120)))) for _ in range(60)]
    docs += [(None, "one two three. One two three! one two three four"), ("und", "one two three"), ("en", None), (None, ""), ("en", docs[0][1]), ("en", docs[0][1])]
    for how in ({"least": 3}, {"least": 2, "most": 4}, {"least": 5, "percent": 60}, {"least": 4, "longest": 2}, {"least": 300}, {"least": 3, "longest": 1}):
        assert collocation_rows(spark, docs, **how) == plain_collocations(docs, **how), how
    # few buckets let more through to the exact count, with the same result
    assert collocation_rows(spark, docs, least=3, bits=3) == plain_collocations(docs, least=3)
    assert len(plain_collocations(docs, least=3)) > 100


def test_long_texts_are_cut_at_pieces(spark, monkeypatch):
    monkeypatch.setattr(collocations, "CHARS", 50)
    docs = [("en", " ".join(f"w{i % 7} w{i % 5} w{i % 3} tail" + "." * (i % 4 == 0) for i in range(300))), ("fr", "x" * 500), ("fr", "y" * 500 + ". a b"), ("en", "w1 w1")]
    batch = pa.RecordBatch.from_pydict({"lang": [x for x, _ in docs], "text": [x for _, x in docs]})
    parts = list(collocations._texts(iter([batch])))
    assert len(parts) > 50 and sum(len(t) for _, ts in parts for t in ts) == sum(len(t) for _, t in docs)
    counted = collections.Counter()
    for langs, texts in parts:
        for lang, text in zip(langs, texts, strict=True):
            for piece in text.decode().split("\n"):
                w = piece.split()
                counted.update((lang, *w[i : i + 2]) for i in range(len(w) - 1))
    whole = collections.Counter()
    for lang, text in docs:
        for piece in text.lower().split("."):
            w = piece.split()
            whole.update((lang, *w[i : i + 2]) for i in range(len(w) - 1))
    assert counted == whole


def test_equal_hashes_are_told_apart():
    words = collocations._Words([0], [b"a b longerword1 a b longerword2 a b longerword1"])
    counter = collocations._Counter(1)
    counter.langs["en"] = 0
    counter.add(words, np.zeros(9, np.uint64), np.arange(9))
    assert sorted(counter.rows()) == [("en", "a", 3), ("en", "b", 3), ("en", "longerword1", 2), ("en", "longerword2", 1)]
    assert words.same(np.array([0, 2]), np.array([3, 8])) and not words.same(np.array([0, 2]), np.array([3, 5])) and not words.same(np.array([0]), np.array([2]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab \n", max_size=30), min_size=1, max_size=5))
def test_words_of_texts(texts):
    words = collocations._Words(list(range(len(texts))), [t.encode() for t in texts])
    want = [(i, w.encode()) for i, t in enumerate(texts) for w in t.replace("\n", " ").split(" ") if w]
    assert list(zip(words.lang.tolist(), words.phrases(np.arange(len(words.hash)), 1), strict=True)) == want
    assert {w: h for (_, w), h in zip(want, words.hash.tolist(), strict=True)}.items() >= set(zip((w for _, w in want), words.hash.tolist(), strict=True))


def test_scores_beyond_64_bits_are_exact(spark):
    a, n, l, r = 3_000_000_007, 9_000_000_000_000_011, 4_000_000_009, 3_100_000_011
    phrases = spark.createDataFrame([("en", "x", 1, l), ("en", "y", 1, r), ("en", "x y", 2, a)], "lang string, phrase string, size int, f long")
    words = spark.createDataFrame([("en", n)], "lang string, n long")
    assert collocations.scored(phrases, words).first()["score"] == 1000 * a * n // (l * r)


def test_collocations_of_no_documents(spark):
    assert collocations.top_collocations(no_docs(spark)).count() == 0


def test_collocations_of_a_table_equal_the_sql(spark):
    folder = SF.replace("0.001", "0.01")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.sql(LLM_ORACLES["op13_hashed_collocations"])
    got = LLM_QUERIES["op13_hashed_collocations"](spark, folder).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
