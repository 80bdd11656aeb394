"""Operator 3 against all pairs, and the classes it must and must not make."""

import numpy as np
import pytest
from llm_helpers import edge_docs, no_docs, sample_docs, texts

from crease.llm import neardup
from crease.llm.bpe import Cache

CACHE = Cache(neardup.word_hash)


def classes(rows, similarity=0.8):
    """Smallest id of each id's class, by exact similarities of all pairs of different texts."""
    ids = [i for i, _ in rows]
    sets = [frozenset(neardup.shingles(t, CACHE).tolist()) for _, t in rows]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if rows[a][1] == rows[b][1] or x and len(x & y) >= similarity * len(x | y):
                parent[find(a)] = find(b)
    least = {}
    for a, i in enumerate(ids):
        least[find(a)] = min(least.get(find(a), i), i)
    return sorted((i, least[find(a)], i == least[find(a)]) for a, i in enumerate(ids))


def got(df):
    return sorted(tuple(r) for r in df.select("doc_id", "class_id", "kept").collect())


def test_table(spark, sf_dir):
    rows = texts(sample_docs(spark, sf_dir))
    want = classes(rows)
    assert got(neardup.op3_near_duplicates(spark, sf_dir)) == want
    assert sum(not k for _, _, k in want) > 0
    kept = neardup.drop_near_duplicates(sample_docs(spark, sf_dir))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c, _ in want if i == c)


def test_chains_hubs_and_large_groups(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 3000)
    rng = np.random.default_rng(11)
    word = lambda: f"w{rng.integers(0, 10**9)}"
    rows, base = [], [word() for _ in range(120)]
    for i in range(40):  # a chain: each differs from the one before in one word, the ends are unlike
        base = [*base]
        base[3 * i] = word()
        rows.append((i, " ".join(base)))
    hub = [word() for _ in range(100)]
    for i in range(100, 220):  # near copies of one text
        own = [*hub]
        own[int(rng.integers(100))] = word()
        rows.append((i, " ".join(own)))
    rows += [(i, " ".join(hub)) for i in range(300, 340)]
    rows += [(i, " ".join(word() for _ in range(60))) for i in range(400, 450)]
    half = [word() for _ in range(40)]
    rows += [(i, " ".join(half + [word() for _ in range(20)])) for i in range(500, 540)]  # a shared passage alone
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = got(neardup.near_duplicates(df))
    assert found == classes(rows)
    assert sum(k for i, _, k in found if i < 400) < 4 and all(k for i, _, k in found if i >= 400)


def test_edges(spark):
    docs = edge_docs(spark)
    rows = neardup.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows if r.doc_id not in (4, 7)}
    assert by[None].class_id is None and by[None].kept is None
    assert (by[0].class_id, by[1].class_id, by[2].class_id, by[3].class_id) == (0, 0, 2, 3)
    assert by[5].class_id == 4 and by[14].class_id == 13 and by[10].kept
    kept = neardup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([None, 0, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12, 13], key=str)
    assert neardup.near_duplicates(no_docs(spark)).count() == neardup.drop_near_duplicates(no_docs(spark)).count() == 0


@pytest.mark.parametrize("shared, of", [(90, 110), (50, 150), (30, 60)])
def test_registers_estimate_similarity(shared, of):
    rng = np.random.default_rng(shared)
    every = rng.integers(0, 2**63, of).astype(np.uint64)
    own = (of - shared) // 2
    a, b = every[: shared + own], np.concatenate([every[:shared], every[shared + own :]])
    n = 2000
    signed = neardup.prob_minhash(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), np.ones(len(a) + len(b)), 2, n)
    assert abs((signed[0] == signed[1]).mean() - shared / of) < 0.05


def test_weights_count():
    e = np.arange(1, 5, dtype=np.uint64) * np.uint64(0x1234567890ABCDE)
    e = np.concatenate([e, e])
    weights = np.array([1, 2, 3, 4, 4, 3, 2, 1.0])
    signed = neardup.prob_minhash(np.repeat([0, 1], 4), e, weights, 2, 2000)
    p, q = weights[:4] / 10, weights[4:] / 10
    want = sum(1 / np.maximum(p / p[i], q / q[i]).sum() for i in range(4))
    assert abs((signed[0] == signed[1]).mean() - want) < 0.05


def test_registers_are_checked():
    one = np.ones(1, np.uint64)
    with pytest.raises(ValueError, match="registers"):
        neardup.prob_minhash(np.zeros(1, int), one, np.ones(1), 1, 0)
    assert (neardup.prob_minhash(np.zeros(1, int), one, np.ones(1), 1, 4000) == 1).all()


def test_hosts_that_are_not_in_the_block(spark, monkeypatch):
    """Copies of one shingle set fill several blocks; hosts of similarity 0.6 to 0.79 must stay apart in each."""
    monkeypatch.setattr(neardup, "BLOCK", 3000)
    rng = np.random.default_rng(5)
    word = lambda: f"w{rng.integers(0, 10**9)}"
    base = [word() for _ in range(204)]
    rows = [(i, " ".join(base) + "." * i) for i in range(60)]
    for i, n in enumerate(np.linspace(24, 110, 40).astype(int)):  # 176 of 200 shingles are shared, n are its own
        rows.append((100 + i, " ".join(base[:180] + [word() for _ in range(n)])))
    for i in range(20):  # links that must stay
        rows.append((200 + i, " ".join(base[: 170 + i])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(neardup.near_duplicates(df)) == classes(rows)


def test_block_counts_only_shared_shingles():
    import pyarrow as pa

    hosts = np.arange(0, 2000, 2)
    sets = [hosts, hosts[:600]]
    table = lambda host, guest: pa.table(
        {"id": [1, 2], "host": host, "guest": guest, "shingles": pa.array(sets, pa.list_(pa.int64()))}
    )
    assert neardup.join_block(table([True, False], [False, True]), 0.8).num_rows == 0
    assert neardup.join_block(table([True, False], [False, True]), 0.6).to_pylist() == [{"id": 2, "pivot": 1}]
    sets = [hosts, hosts + 1]
    assert neardup.join_block(table([True, False], [False, True]), 0.1).num_rows == 0
    sets = [hosts, hosts[np.arange(1000) % 5 < 3]]
    assert neardup.join_block(table([True, False], [False, True]), 0.8).num_rows == 0
    assert neardup.join_block(table([True, False], [False, False]), 0.1).num_rows == 0


def test_copies_with_other_repeats_meet(spark):
    rng = np.random.default_rng(17)
    word = lambda: f"w{rng.integers(0, 10**9)}"
    rows = []
    for i in range(60):  # 196 shingles, and a copy with 34 more of which 30 stand 300 times
        base, passage = [word() for _ in range(200)], [word() for _ in range(30)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base + passage * 300))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = got(neardup.near_duplicates(df))
    assert found == classes(rows) and [c for _, c, _ in found] == [i - i % 2 for i in range(120)]


def test_one_key_with_different_texts(spark):
    rng = np.random.default_rng(23)
    new = lambda: " ".join(f"w{rng.integers(0, 10**9)}" for _ in range(80))
    a, b, x, y = new(), new(), new(), new()
    rows = [(6, a), (7, a + "!"), (7, b), (1, x), (1, y), (2, x + " end"), (3, y + " end"), (1, x)]
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    found = got(neardup.near_duplicates(df))
    assert found == sorted([(6, 6, True), (7, 6, False), (7, 7, True), *[(1, 1, True)] * 3, (2, 1, False), (3, 1, False)])
    kept = neardup.drop_near_duplicates(df)
    assert kept.schema == df.schema
    assert sorted(map(tuple, kept.collect())) == sorted([(6, a), (7, b), (1, x), (1, y)])
