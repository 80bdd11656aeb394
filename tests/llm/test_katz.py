"""Operator 11 against a model of plain dictionaries, evaluated token by token."""

import math
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from llm_helpers import TEXTS, edge_docs, no_docs, sample_docs
from pyspark.sql import functions as F

from crease.llm import katz

COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", low), None]


def discount(counts):
    of = Counter(counts.values())
    best = {}
    for k in range(1, 6):
        if all(of[r] for r in range(1, k + 2)):
            rest = (k + 1) * of[k + 1] / of[1]
            d = {r: ((r + 1) * of[r + 1] / (of[r] * r) - rest) / (1 - rest) for r in range(1, k + 1)} if rest < 1 else {}
            if d and all(0 < x < 1 for x in d.values()):
                best = d
    return lambda n: n * best[n] if n in best else n - 0.5


class Plain:
    def __init__(self, texts):
        self.words, self.pairs = Counter(), Counter()
        self.starts = len(texts)
        for t in texts:
            w = tokens(t)
            self.words.update(w)
            self.pairs.update(zip(["<s>", *w], w, strict=False))
        self.n, self.d1, self.d2 = self.words.total(), discount(self.words), discount(self.pairs)
        self.other = 1 - sum(map(self.d1, self.words.values())) / self.n if self.n else 1.0
        self.after = defaultdict(list)
        for v, w in self.pairs:
            self.after[v].append(w)

    def p1(self, w):
        return self.d1(self.words[w]) / self.n if self.words[w] else self.other

    def total(self, v):
        return self.starts if v == "<s>" else self.words[v]

    def weight(self, v):
        if v not in self.after:
            return 1.0
        left = 1 - sum(self.d2(self.pairs[v, w]) for w in self.after[v]) / self.total(v)
        return left / (1 - sum(map(self.p1, self.after[v])))

    def p2(self, v, w):
        return self.d2(self.pairs[v, w]) / self.total(v) if self.pairs[v, w] else self.weight(v) * self.p1(w)

    def row(self, text):
        w = tokens(text)
        base = sum(math.log10((self.words[x] + 0.5) / (self.n + 0.5 * (len(self.words) + 1))) for x in w)
        return len(w), sum(x in self.words for x in w), self.n, base, sum(math.log10(self.p2(v, x)) for v, x in zip(["<s>", *w], w, strict=False))


def same(df, rows, learn):
    assert df.columns == COLUMNS
    model = Plain([t for i, t in rows if learn(i)])
    memo = {}
    of = lambda t: memo.setdefault(t, model.row(t))
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], round(r[5], 6))
    expected = sorted(((i, not learn(i), *of(t)) for i, t in rows), key=key)
    got = sorted(map(tuple, df.collect()), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in expected]
    for a, b in zip(got, expected, strict=True):
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9), a
    return model, got


learned = lambda i: crc32(("" if i is None else str(i)).encode()) % 5 != 1


def test_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in sample_docs(spark, sf_dir).collect()]
    model, got = same(katz.op11_katz_scores(spark, sf_dir), rows, learned)
    held = [r for r in got if r[1]]
    assert len(held) > 20 and sum(r[6] for r in held) > 1.05 * sum(r[5] for r in held)  # better than single words


def test_probabilities_sum_to_one():
    texts = ["a b c a b d", "a b c", "c c c a", "e f a b", "a b c a x y z", None, "e e e e e e f e f e f e f e f e f"] * 2 + ["q r s"]
    model = Plain(texts)
    for v in ["<s>", *filter(None, model.words), "never"]:
        assert math.isclose(sum(model.p2(v, w) for w in [*model.words, "unknown"]), 1)


@pytest.mark.parametrize("small", [False, True])
def test_edges(spark, small, monkeypatch):
    """Odd documents; then with few frequent words, small partitions and slices, so that every way is taken."""
    if small:
        for name, value in (("HOT_WORDS", 40), ("HOT_PAIRS", 20), ("SLICE", 20_000), ("BUCKET", 100_000)):
            monkeypatch.setattr(katz, name, value)
    docs = edge_docs(spark).unionByName(spark.createDataFrame([(100 + i, f"w{i % 7} w{i % 11} w{i % 5} x{i} the end" * (i % 3), None, None, None) for i in range(300)], "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    number = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    same(katz.katz_scores(docs, number % 5 != 1), rows, learned)


def test_hot_rare_unknown(spark, monkeypatch):
    """Frequent words before unseen ones, frequent pairs, many unknown words, with lists of frequent words of every size."""
    rows = [(i, " ".join(["the", f"a{i % 13}", "the", f"b{i}", "of the", f"c{i // 3}", "very common pair"] * (1 + i % 3))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(katz, "BUCKET", 5_000)
    monkeypatch.setattr(katz, "SLICE", 3_000)
    for words, pairs in ((1, 1), (10, 20), (65_536, 10)):
        monkeypatch.setattr(katz, "HOT_WORDS", words)
        monkeypatch.setattr(katz, "HOT_PAIRS", pairs)
        same(katz.katz_scores(docs, F.col("doc_id") % 4 != 0), rows, lambda i: i % 4 != 0)


def test_nothing_to_learn_from(spark):
    assert katz.katz_scores(no_docs(spark), F.lit(True)).count() == 0
    rows = [(1, "a b"), (2, None), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    _, got = same(katz.katz_scores(docs, F.lit(False)), rows, lambda _: False)
    assert all(r[6] == 0 for r in got)
    same(katz.katz_scores(docs, F.lit(None).cast("boolean")), rows, lambda _: True)


def test_packing():
    x = np.array([3, 5, 5, 2**63, 2**64 - 1], np.uint64)
    assert (katz.unpack(katz.pack(x, True), True) == x).all() and (katz.unpack(katz.pack(x)) == x).all()
    assert len(katz.unpack(katz.pack(x[:0], True), True)) == 0 and katz.unpack(katz.pack(np.array([1, 255]))).dtype == np.uint8
    hot = katz.Frequent(x[:2], np.array([1, 2]))
    assert (katz.decoded(katz.encoded(x[::-1], hot), hot) == x[::-1]).all()
    w, v = np.array([9, 9, 1, 9, 1, 9], np.uint64), np.array([1, 2, 1, 1, 1, 2], np.uint64)
    a, b, n, place = katz.merge_pairs(w, v, np.arange(6))
    assert sorted(zip(a.tolist(), b.tolist(), n.tolist())) == [(1, 1, 6), (9, 1, 3), (9, 2, 6)] and (a[place] == w).all() and (b[place] == v).all()


def test_tokens_equal_a_plain_split():
    odd = ["", " ", "A b\tC\n\x0b\x0c\r d ", "É À\x1c\x85\xa0x", "\n\na  b", "İSTANBUL ẞ", "x" * 1000, *[t or "" for t in TEXTS]]
    t = katz.tokenised(pa.table({"text": odd}))
    kinds = sorted({w for x in odd for w in tokens(x)[:-1]})
    names = dict(zip(katz.word_hashes(kinds), kinds, strict=True))
    names = {int(h): w for h, w in names.items()} | {int(katz.END_HASH): None}
    found = [[] for _ in odd]
    for d, w in zip(t.doc.tolist(), t.hashes[t.words].tolist()):
        found[d].append(names[w])
    assert found == [tokens(x) for x in odd]
    firsts = np.flatnonzero(np.diff(t.doc, prepend=-1))
    assert (t.hashes[t.before[firsts]] == katz.BEGIN_HASH).all() and (np.delete(t.before, firsts) == np.delete(np.roll(t.words, 1), firsts)).all()


def test_rare_words_are_sent_once():
    """Pairs name the rare second words by their places in the list that the slice's words have sent to the partition."""
    buckets, rng = 8, np.random.default_rng(1)
    words = np.unique(rng.integers(0, 2**63, 20_000, dtype=np.uint64))
    hot = katz.Frequent(words[::10], np.ones(len(words[::10]), np.int64))
    rare = np.setdiff1d(words, hot.words)
    w, v = np.concatenate([rare, hot.words]), np.concatenate([hot.words[: len(rare) % 7 + 1].repeat(len(words))[: len(rare)], hot.words])
    home = katz.pair_buckets(w, v, katz.find(hot.words, w)[1], buckets)
    for b, i in katz.by_bucket(home):
        sent = rare[katz.bucket_of(rare, buckets) == b // katz.PARTS]
        row = katz.pairs_out(w[i], v[i], hot, told=True)
        back = katz.pairs_in(row, hot, katz.words_of_part(sent, b % katz.PARTS, buckets))
        assert (back[0] == w[i]).all() and (back[1] == v[i]).all()
        assert len(row["a"]) < len(katz.pairs_out(w[i], v[i], hot)["a"]) / 2
