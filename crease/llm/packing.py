"""Operator 10: best-fit packing of token sequences, planned on the histogram of lengths."""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crease.llm.bpe import byte_letters, read_byte_bpe
from crease.llm.common import held, map_batches, materialize, read_table, texts_of

#: Pieces that share a number range; ranks within it are counted while the tokens are made.
RANGE = 20_000

#: Fixed value: how the byte-level vocabulary cuts a text into words.
CUT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Token ids of texts as bytes of little-endian uint32, as the tokenizers library gives them for a .json file.

    A plain byte-level BPE whose ids rise with its merges is encoded by tiktoken, which makes the same ids some eight
    times faster; any other file goes through the tokenizers library itself, and so does a text that tiktoken's
    expressions give up on, such as a run of a million spaces. Nothing is kept between texts.
    """

    def __init__(self, path: str):
        self.path, self.fast = path, None
        try:
            spec = read_byte_bpe(path)
        except (KeyError, TypeError, ValueError):
            spec = None
        vocabulary = spec and spec["model"]["vocab"]
        pairs = [x.split(" ") if isinstance(x, str) else x for x in spec["model"]["merges"]] if spec else []
        ids = [vocabulary[a + b] for a, b in pairs]
        if spec and all(a < b for a, b in zip(ids, ids[1:])):
            import tiktoken

            byte = byte_letters()
            special = {t["content"]: t["id"] for t in spec["added_tokens"]}
            ranks = {bytes(map(byte.__getitem__, x)): i for x, i in vocabulary.items() if x not in special}
            self.fast = tiktoken.Encoding(path, pat_str=CUT, mergeable_ranks=ranks, special_tokens=special)

    @cached_property
    def slow(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode_one(self, text: str) -> bytes:
        if self.fast:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
            except ValueError:  # "Max stack size exceeded for backtracking"
                pass
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        return list(map(self.encode_one, texts))


def token_pieces(
    docs: DataFrame, path: str, capacity: int, separator: int = 0, with_ids: bool = False, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces of at most capacity tokens: key, piece, start, length, ids_crc32, range, rank (and ids).

    A document is its ids and the separator; a longer one is cut into pieces of capacity, the first of which takes the
    rest. rank counts the pieces of one length in one range, from 0; a range is a task's next RANGE pieces.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start long, length int, ids_crc32 long, range long, rank long"
    schema += ", ids array<int>" if with_ids else ""

    def start():
        enc = held(("encoder", path), lambda: Encoder(path))
        first = TaskContext.get().partitionId() << 32
        seen: dict[int, int] = defaultdict(int)
        made = 0
        end = np.array([separator], "<u4").tobytes()

        def each(batch: pa.RecordBatch):
            nonlocal made
            rows, ids = [], []
            keys = batch.column(key)
            for row, coded in enumerate(enc.encode(texts_of(batch, text))):
                raw = coded + end
                n, at = len(raw) // 4, 0
                for piece in range(-(-n // capacity)):
                    length = min(n, capacity) if piece else (n - 1) % capacity + 1
                    if made % RANGE == 0:
                        seen.clear()
                    part = raw[4 * at : 4 * (at + length)]
                    rows.append((row, piece, at, length, zlib.crc32(part), first + made // RANGE, seen[length]))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<i4"))
                    seen[length] += 1
                    made += 1
                    at += length
            at, *rest = zip(*rows, strict=True)
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            arrays = [keys.take(pa.array(at, pa.int32())), *map(pa.array, rest, kinds)]
            names = [key, "piece", "start", "length", "ids_crc32", "range", "rank"]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

        return each

    return map_batches(docs.select(key, text), schema, start)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Where the pieces of each length go: segments (length, first rank, pieces, bins, first bin, offset).

    The k-th piece of a segment goes to bin first bin + k % bins, at offset + k // bins * length. Only counts matter,
    so the plan is as small for any number of pieces. Lengths above a third of the capacity stand at most twice in a
    bin: the largest left pairs with the largest left that fits it. Shorter ones then go, longest first, each into
    the fullest bin that it fits: that is best fit decreasing, done for all bins of one gap at once.
    """
    segments: list[tuple[int, int, int, int, int, int]] = []
    left = {n: c for n, c in counts.items() if c > 0}
    used: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first bin, bins)
    bins = 0

    def put(length: int, pieces: int, m: int, first: int, offset: int) -> None:
        segments.append((length, used[length], pieces, m, first, offset))
        used[length] += pieces
        left[length] -= pieces

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        length = large[-1]
        n = left[length]
        if n == 0:
            large.pop()
            continue
        at = bisect_left(large, capacity - length + 1) - 1
        while at >= 0 and left[large[at]] < 1 + (large[at] == length):
            at -= 1
        if at < 0:
            put(length, n, n, bins, 0)
            gaps[capacity - length].append((bins, n))
            bins += n
            continue
        partner = large[at]
        n = n // 2 if partner == length else min(n, left[partner])
        put(length, n, n, bins, 0)
        put(partner, n, n, bins, length)
        gaps[capacity - length - partner].append((bins, n))
        bins += n

    order = sorted(g for g in gaps if g)
    for length in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while (c := left[length]) > 0:
            at = bisect_left(order, length)
            if at == len(order):
                per = capacity // length
                m = -(-c // per)
                gap, first = capacity, bins
                bins += m
            else:
                gap = order[at]
                first, m = gaps[gap].pop()
                if not gaps[gap]:
                    del order[at]
            per = gap // length
            full = min(m, c // per)
            kept = [(gap - per * length, first, full)]
            if full:
                put(length, full * per, full, first, capacity - gap)
            if full < m:
                some = left[length] if left[length] < per else 0
                if some:
                    put(length, some, 1, first + full, capacity - gap)
                    kept.append((gap - some * length, first + full, 1))
                kept.append((gap, first + full + bool(some), m - full - bool(some)))
            for g, f, k in kept:
                if k and g:
                    if not gaps[g]:
                        insort(order, g)
                    gaps[g].append((f, k))
    return segments


def pack(
    docs: DataFrame, path: str, capacity: int = 2048, separator: int = 0, with_ids: bool = False, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pack all documents into as few sequences as it can of at most capacity tokens; one row per piece.

    Returns key, piece, start, length, ids_crc32, sequence_id, offset (and ids with with_ids). The pieces are written
    to shared storage once; what the driver sees is the histogram of their lengths, at most capacity counts. Pieces
    get their number among those of equal length from ranks within ranges and the ranges' running totals, so a hot
    length is dealt over many tasks. A null text is empty (the separator alone); keys may be null or repeat; other
    columns are left out; no documents give no rows.
    """
    if capacity < 1:
        raise ValueError("capacity must be 1 or more")
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, path, capacity, separator, with_ids, key, text))
    ranges = materialize(pieces.groupBy("length", "range").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in ranges.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    segments = spark.createDataFrame(
        plan(counts, capacity), "length int, first_rank long, pieces long, bins long, first_bin long, at int"
    )
    before = F.sum("n").over(W.partitionBy("length").orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    ranges = ranges.select("length", "range", F.coalesce(before, F.lit(0)).alias("before"))
    k = F.col("all_rank") - F.col("first_rank")
    # the table of ranges grows with the pieces, however small its files are: never broadcast it
    numbered = pieces.join(ranges.hint("merge"), ["length", "range"]).withColumn("all_rank", F.col("before") + F.col("rank"))
    # at most a few segments a length, whatever the number of pieces: see plan
    placed = numbered.join(
        F.broadcast(segments),
        (numbered["length"] == segments["length"])
        & (F.col("all_rank") >= F.col("first_rank"))
        & (F.col("all_rank") < F.col("first_rank") + F.col("pieces")),
    )
    return placed.select(
        key,
        "piece",
        "start",
        numbered["length"].cast("long").alias("length"),
        "ids_crc32",
        (F.col("first_bin") + k % F.col("bins")).alias("sequence_id"),
        (F.col("at") + F.floor(k / F.col("bins")) * numbered["length"]).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
