"""Operators 1 and 9 against brute force."""

import math

import numpy as np
import pytest
from llm_helpers import with_extras

from crease.llm.topk import op1_top_k, top_k
from crease.llm.vecdup import op9_vector_links, vector_links

NAN, INF = float("nan"), float("inf")
ODD = [None, [], [1.0, None], [NAN, 1.0], [INF, 0.0], [-INF, 0.0], [0.0, 0.0]]


def brute_top(rows, asks, k):
    """rows, asks: (key, vector)."""
    usable = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if good(i, v)]
    out = []
    for q, v in {(q, tuple(v)) for q, v in asks if good(q, v)}:
        w = [math.floor(1024 * x) for x in v]
        best = sorted((-sum(a * b for a, b in zip(w, u)), i) for i, u in usable if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def good(i, v):
    return i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)


def got_top(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_top_k_of_the_table(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    assert got_top(op1_top_k(spark, sf_dir)) == brute_top(rows, [x for x in rows if x[0] % 100 == 0], 10)


def test_top_k_with_many_trees_and_equal_vectors(spark, monkeypatch):
    from crease.llm import topk

    monkeypatch.setattr(topk, "LEAST", 100)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 4]) for i in range(600)] + [(i, [0.5, 0.5, 0.0, 0.25]) for i in range(600, 900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asks = [x for x in rows if x[0] % 50 == 0]
    assert got_top(top_k(df, df.filter("vec_id % 50 = 0"), 10)) == brute_top(rows, asks, 10)


def test_top_k_of_odd_rows(spark):
    rows = [(i, v) for i, v in enumerate(ODD)] + [(10, [1.0, 2.0]), (11, [1.0, 2.0]), (12, [-3.0, 0.5]), (None, [1.0, 1.0])]
    df = with_extras(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    twice = df.unionByName(df.filter("vec_id = 12"))
    whole = [x for x in rows if x[1] != []]
    asks = [x for x in whole if x[0] in (6, 10)]
    found = [x for x in got_top(top_k(df, df.filter("vec_id in (6, 10)"), 10)) if x[2] != 1]
    assert [x[:1] + x[2:] for x in found] == [x[:1] + x[2:] for x in brute_top(whole, asks, 10)]
    assert sum(x[2] == 12 for x in got_top(top_k(twice, twice.filter("vec_id = 10"), 10))) == 2
    assert got_top(top_k(df.limit(0), df, 10)) == []
    assert got_top(top_k(df, df.limit(0), 10)) == []


def test_top_k_of_large_components(spark):
    rows = [(i, [1e6 + i / 1024, -1e6 + (i * 7 % 5) / 1024]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = [(q, n, i) for q, n, i, _ in got_top(top_k(df, df.filter("vec_id = 0"), 3))]
    assert found == [(q, n, i) for q, n, i, _ in brute_top(rows, rows[:1], 3)]


def test_top_k_of_large_components_over_many_pages(spark):
    """Distances of 1e9 and more, more rows than pages hold, many of them nearly equal: only the tree decides what is skipped."""
    rng = np.random.default_rng(8)
    base = rng.integers(-(10**6), 10**6, (12, 3))
    rows = [(i, [float(b) + float(e) / 1024 for b, e in zip(base[i % 12], rng.integers(-3, 4, 3), strict=True)]) for i in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asks = [x for x in rows if x[0] % 90 == 0]
    assert got_top(top_k(df, df.filter("vec_id % 90 = 0"), 10)) == brute_top(rows, asks, 10)


def test_copies_stay_bounded_as_vectors_grow():
    """Cells and copies a vector for 1,000 to 100,000 made vectors in groups: ten times the rows, no more copies each."""
    from crease.llm import vecdup

    rng = np.random.default_rng(4)
    centers = vecdup.unit(rng.normal(size=(150, 64)))
    reach, copies = math.sqrt(0.1), []
    for n in (1_000, 10_000, 100_000):
        x = vecdup.unit(centers[rng.integers(0, len(centers), n)] + rng.normal(size=(n, 64)) * 0.02)
        pivots = vecdup.spread(x[: vecdup.SAMPLE], -(-n // vecdup.CELL))
        home, away = vecdup.homes(x, pivots)
        radii = np.array([away[home == c].max(initial=-10.0) for c in range(len(pivots))])
        copies.append(1 + np.concatenate([vecdup.boundary(x[i : i + 4096], home[i : i + 4096], pivots, radii, reach).sum(1) for i in range(0, n, 4096)]).mean())
        print(n, "vectors,", len(pivots), "cells,", round(copies[-1], 2), "copies a vector")
    assert max(copies) < 10


def test_spread_pivots_on_few_places():
    from crease.llm import vecdup

    sample = vecdup.unit(np.repeat(np.eye(3), 10, 0))
    assert len(vecdup.spread(sample, 8)) == 3 and len(vecdup.spread(sample[:1], 5)) == 1


def brute_links(rows, threshold=0.95):
    """(key, links, component, kept) by all pairs."""
    n = len(rows)
    use = [v is not None and len(v) > 0 and good(0, v) and any(v) and i is not None for i, v in rows]
    links, parent = [0] * n, list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(n):
        for b in range(a):
            if use[a] and use[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if x @ y / (math.sqrt(x @ x) * math.sqrt(y @ y)) >= threshold:
                    links[a] += 1
                    links[b] += 1
                    parent[find(a)] = find(b)
    least = {}
    for a in range(n):
        if use[a]:
            least[find(a)] = min(least.get(find(a), rows[a][0]), rows[a][0])
    out = []
    for a, (i, _) in enumerate(rows):
        c = least[find(a)] if use[a] else i
        out.append((i, links[a], c, None if i is None else i == c))
    return sorted(out, key=str)


def got_links(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def test_links_of_the_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert got_links(op9_vector_links(spark, sf_dir)) == brute_links(rows)


@pytest.mark.parametrize("threshold", [0.95, 0.8])
def test_links_over_many_cells_and_blocks(spark, monkeypatch, threshold):
    from crease.llm import vecdup

    monkeypatch.setattr(vecdup, "CELL", 20)
    monkeypatch.setattr(vecdup, "BLOCK", 16)
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(6, 5))
    points = centers[rng.integers(0, 6, 260)] + rng.normal(size=(260, 5)) * 0.25
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(points)] + [(300 + i, [1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got_links(vector_links(df, threshold)) == brute_links(rows, threshold)


def test_links_of_odd_rows(spark):
    rows = [(i, v) for i, v in enumerate(ODD)] + [(10, [1.0, 2.0]), (11, [1.0, 2.0]), (12, [1.0, 2.1]), (13, [1.0, 2.0, 0.0]), (None, [1.0, 2.0])]
    df = with_extras(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert got_links(vector_links(df)) == brute_links(rows)
    assert got_links(vector_links(df.limit(0))) == []
