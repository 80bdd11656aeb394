"""Operator 12 against brute force over all pairs of words."""

import re
from collections import Counter
from zlib import crc32

import pytest
from helpers import duck
from llm_helpers import edge_docs, no_docs, sample_docs

from crease.llm import variants


def plain_counts(rows):
    total = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                total[run] += 1
    return total


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain(counts):
    """Words with a common hole or letter less are compared; holes are tried at every place."""
    holes = {}
    for w in counts:
        for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            holes.setdefault(k, set()).add(w)
    around = {w: set() for w in counts}
    for w in counts:
        for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            around[w] |= {x for x in holes[k] if near(w, x)}
    form = {}
    for w, n in counts.items():
        best = min(around[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(around[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=str)


def found(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()), key=str)


def test_documents(spark):
    for sf_dir in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        counts = {w: n for w, n in plain_counts((r.doc_id, r.text) for r in sample_docs(spark, sf_dir).collect()).items() if n >= 3}
        expected = plain(counts)
        assert found(variants.op12_spelling_variants(spark, sf_dir)) == expected
        assert sorted(duck(sf_dir).sql(variants.OP12_SQL).fetchall(), key=str) == expected
        assert sum(r[4] for r in expected) > 100 and any(r[2] not in (r[0], r[1]) for r in expected)


def test_edge_documents(spark):
    docs = edge_docs(spark)
    counts = {r.word: r.n for r in variants.word_counts(docs, damaged=True).collect()}
    assert counts == plain_counts((r.doc_id, r.text) for r in docs.collect())
    assert found(variants.spelling_variants(variants.word_counts(docs))) == plain({r.word: r.n for r in variants.word_counts(docs).collect()})
    assert variants.spelling_variants(variants.word_counts(no_docs(spark))).count() == 0
    whole = {r.word: r.n for r in variants.word_counts(docs.select("doc_id", "text")).collect()}
    assert whole["words"] == 2 * 20_000 + 1


def test_words(spark):
    """Anagrams, every kind of edit at every place, one letter repeated, chains of forms, ties, long words."""
    base = "abcdé"
    words = {base: 100, "edcba": 40, "bacdé": 7, "baced": 7, "aaaaa": 9, "aaaaaa": 3, "aaaaaaa": 20, "zzzzz": 1, "ÿÿÿÿÿ": 1, "x" * 3000: 8, "x" * 3001: 4, "x" * 1500 + "y" + "x" * 1499: 2}
    for i in range(6):
        words[base[:i] + "q" + base[i:]] = 10 + i
        if i < 5:
            words[base[:i] + "w" + base[i + 1 :]] = 50
            words[base[:i] + base[i + 1 :]] = i + 1
    chain = "m" * 12
    for i in range(12):
        words[chain[:i] + "n" * (12 - i)] = 3 * 2**i
    df = spark.createDataFrame([(w, n, "own", 1) for w, n in words.items()], "word string, n long, key string, m long")
    assert found(variants.spelling_variants(df)) == plain(words)
    with pytest.raises(ValueError):
        variants.spelling_variants(df, 1)


def test_dense_family(spark):
    """Ninety words that all differ at one place, and all orders of some letters."""
    from itertools import permutations

    words = {f"wor{chr(c)}d": c for c in [*range(97, 123), *range(0xC0, 0x100)]} | {"".join(p): 5 for p in permutations("abcdef")}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert found(variants.spelling_variants(df)) == plain(words)


def test_anagram_key():
    assert variants.anagram_key("listen") == variants.anagram_key("silent") != variants.anagram_key("listens")
    assert variants.anagram_key("abc") == sum(x**5 for x in (97, 98, 99))
