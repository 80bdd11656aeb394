"""Operator 10: every token once, no overlap, few sequences."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_helpers import WIDE, edge_docs, no_docs, sample_docs, texts
from tokenizers import Tokenizer

from crease.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, docs, capacity):
    """rows: pieces of docs, pairs of key and text."""
    tokenizer = Tokenizer.from_file(PATH)
    coded = [(i, np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")) for i, t in docs]
    want = []
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    assert sum(len(c) for _, c in coded) == sum(r.length for r in rows)
    for i, ids in coded:
        if sum(k == i for k, _ in coded) == 1:
            own = sorted(by_doc[i], key=lambda r: r.piece)
            assert [r.piece for r in own] == list(range(len(own))) and [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
            assert all(r.length == capacity for r in own[1:])
            for r in own:
                assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for x in bins.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), want


def test_table(spark, sf_dir):
    rows = packing.op10_packing(spark, sf_dir).collect()
    n, _ = check(rows, texts(sample_docs(spark, sf_dir)), 2048)
    least = -(-sum(r.length for r in rows) // 2048)
    assert n <= least + 2 or n <= 1.02 * max(least, sum(2 * r.length > 2048 for r in rows))


def test_edges(spark):
    docs = edge_docs(spark)
    for capacity in (64, 2048):
        check(packing.pack(docs, PATH, capacity).collect(), texts(docs), capacity)
    assert packing.pack(no_docs(spark), PATH).count() == 0
    with_ids = packing.pack(docs, PATH, with_ids=True).collect()
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in with_ids)


def test_millions_of_white_space(spark):
    """Texts that the fast encoder gives up on have the library's ids, alone and as a stage of the pipeline."""
    import corpus_pipeline

    docs = spark.createDataFrame([*enumerate(WIDE), (9, "some words")], "doc_id long, text string")
    for rows in (packing.pack(docs, PATH), corpus_pipeline.packing(spark, docs, "")):
        check(rows.collect(), texts(docs), 2048)


def test_ranks_across_ranges(spark, monkeypatch, sf_dir):
    monkeypatch.setattr(packing, "RANGE", 7)
    docs = sample_docs(spark, sf_dir).repartition(3)
    check(packing.pack(docs, PATH, 300).collect(), texts(docs), 300)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), max_size=20), st.just(60))
def test_plan_places_everything(counts, capacity):
    fill, taken, placed = defaultdict(int), defaultdict(list), defaultdict(int)
    for length, first_rank, pieces, bins, first, offset in packing.plan(counts, capacity):
        assert first_rank == placed[length]
        placed[length] += pieces
        for k in range(pieces):
            b = first + k % bins
            taken[b].append((offset + k // bins * length, length))
            fill[b] += length
    assert dict(placed) == {n: c for n, c in counts.items() if c}
    for b, x in taken.items():
        assert fill[b] <= capacity
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
    assert set(taken) == set(range(len(taken)))
    # large ones stand at most twice in a sequence; what is over the bound of total size is little
    assert all(sum(3 * n > capacity for _, n in x) <= 2 for x in taken.values())


@pytest.mark.parametrize("capacity", [0, -1])
def test_capacity_is_checked(spark, capacity):
    with pytest.raises(ValueError, match="capacity"):
        packing.pack(edge_docs(spark), PATH, capacity)
