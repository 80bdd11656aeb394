"""Operator 3: near-duplicate documents by ProbMinHash signatures, banding and exact verification."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.llm.bpe import Cache
from crease.llm.common import (
    connected_components,
    discard,
    held,
    hook,
    map_batches,
    materialize,
    merged_components,
    read_table,
    texts_of,
)

#: Words of a shingle; least similarity; bands and registers of a band. A pair of similarity 0.8 meets in no band with
#: probability (1 - 0.8^4)^20 = 3e-5, one of 0.85 with 4e-7, however often the shingles of either text are repeated.
WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 20, 4

#: Members of a bucket's largest class that the others are compared with in the second round.
SAMPLE = 2
#: Shingles on one side of a block in the last round.
BLOCK = 2_000_000
#: Bytes of the word hashes that a Python worker keeps.
WORD_BYTES = 48 << 20

WORD = re.compile(r"\w+")
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")


def shingles(text: str, words: Cache) -> np.ndarray:
    """Hashes of all runs of WORDS lower-cased words, with repeats; of all words if there are fewer; of none if none."""
    found = WORD.findall(text.lower())
    ids = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    n = min(WORDS, len(ids))
    if not n:
        return ids
    total = np.full(len(ids) - n + 1, n, np.uint64)
    for k in range(n):
        total = mix(total + GOLDEN) ^ ids[k : len(ids) - n + 1 + k]
    return mix(total)


def word_cache() -> Cache:
    """One cache of word hashes for all tasks of a Python worker."""
    return held(("words",), lambda: Cache(word_hash, WORD_BYTES))


def prob_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """ProbMinHash signatures, n_docs x registers: the element that arrives first in each register.

    Each element of a document sends arrivals as a Poisson process of the rate of its weight, seeded by the element
    alone, and each arrival falls into a random register. Registers of two documents agree with the probability
    Jaccard similarity of their weights. An element stops once its next arrival is later than the latest first arrival
    in all of its document's registers. doc is sorted; every document has an element.
    """
    if registers < 1:
        raise ValueError("registers must be 1 or more")
    first = np.full(n_docs * registers, np.inf)
    by_doc = first.reshape(n_docs, registers)
    signature = np.zeros(n_docs * registers, np.uint64)
    time = np.zeros(len(element))
    turn = 0
    while len(element):
        turn += 1
        random = mix(element + np.uint64(turn * int(GOLDEN) % 2**64))
        time = time - np.log1p(-((random >> np.uint64(11)) * 2.0**-53)) / weight
        if registers <= 2048:  # the bits that the time leaves are enough
            place = (random & np.uint64(2047)) * np.uint64(registers) >> np.uint64(11)
        else:
            place = (mix(random) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)
        slot = doc * registers + place.astype(np.int64)
        np.minimum.at(first, slot, time)
        won = first[slot] == time
        signature[slot[won]] = element[won]
        present = doc[np.flatnonzero(np.diff(doc, prepend=-1))]
        latest = np.zeros(n_docs)
        latest[present] = by_doc[present].max(1)
        go_on = time < latest[doc]
        doc, element, weight, time = doc[go_on], element[go_on], weight[go_on], time[go_on]
    return signature.reshape(n_docs, registers)


def bands_of(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash of each band of each signature."""
    total = np.tile(np.arange(bands, dtype=np.uint64), (len(signature), 1))
    for k in range(rows):
        total = mix(total + GOLDEN) ^ signature[:, k::rows]
    return mix(total).view(np.int64)


def digest(text: str) -> Column:
    """What tells texts apart; null is read as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def signatures(docs: DataFrame, key: str, text: str, bands: int, rows: int) -> DataFrame:
    """id, content (digest of the text) and bands (none for texts without words) of each row with a key.

    Weights are 1 + ln(count), so that one shingle repeated over and over does not outweigh the rest. As links are
    defined by distinct shingles, a text with repeats has the bands of its signature of equal weights too; without
    repeats both signatures are the same.
    """

    def start():
        words = word_cache()

        def signed(parts: list) -> np.ndarray:
            if not parts:
                return np.zeros((0, bands), np.int64)
            found = prob_minhash(
                np.repeat(np.arange(len(parts)), [len(s) for s, _ in parts]),
                np.concatenate([s for s, _ in parts]),
                1 + np.log(np.concatenate([n for _, n in parts])),
                len(parts),
                bands * rows,
            )
            return bands_of(found, bands, rows)

        def each(batch: pa.RecordBatch):
            texts = texts_of(batch, "text")
            parts = [np.unique(shingles(x, words), return_counts=True) for x in texts]
            full = [i for i, (s, _) in enumerate(parts) if len(s)]
            out: list = [[]] * len(texts)
            for i, b in zip(full, signed([parts[i] for i in full]), strict=True):
                out[i] = b
            repeats = [i for i in full if parts[i][1].max() > 1]
            for i, b in zip(repeats, signed([(parts[i][0], np.ones(len(parts[i][0]))) for i in repeats]), strict=True):
                out[i] = np.union1d(out[i], b)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("content"), pa.array(out, pa.list_(pa.int64()))], ["id", "content", "bands"]
            )

        return each

    rows_in = docs.filter(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("id"), digest(text).alias("content"), F.col(text).alias("text")
    )
    return map_batches(rows_in, "id long, content binary, bands array<long>", start)


def shingle_sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id and the distinct shingle hashes of each row."""

    def start():
        words = word_cache()

        def each(batch: pa.RecordBatch):
            sets = [np.unique(shingles(x, words)).view(np.int64) for x in texts_of(batch, text)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"]
            )

        return each

    return map_batches(docs.select(key, text), "id long, shingles array<long>", start)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (id, pivot) whose shingle sets have at least this Jaccard similarity."""
    left = sets.withColumnRenamed("shingles", "own")
    right = sets.select(F.col("id").alias("pivot"), F.col("shingles").alias("other"))
    both = pairs.join(left, "id").join(right, "pivot")
    same = F.size(F.array_intersect("own", "other"))
    alike = same / (F.size("own") + F.size("other") - same)
    return both.filter(alike >= similarity).select("id", "pivot")


def labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets with the label of their class so far."""
    return members.join(labels.withColumnRenamed("v", "id"), "id", "left").withColumn("label", F.coalesce("label", "id"))


def classes_of_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members other than the pivot of buckets where these are in several classes so far: with label and main class."""
    named = labelled(members, labels).filter("id <> pivot")
    sizes = named.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("most"), F.count("*").alias("k"))
    # written, as are other tables with a row a bucket: AQE splits a hot bucket only where a join reads plain tables
    return named.join(materialize(largest.filter("k > 1").select("bucket", F.col("most.label").alias("main"))), "bucket")


def sampled_pairs(split: DataFrame) -> DataFrame:
    """Each member outside its bucket's main class with SAMPLE members of that class, the same for all of a bucket."""
    order = lambda k: F.min(F.struct(F.xxhash64("id", F.lit(k)), "id"))["id"]
    chosen = split.filter("label = main").groupBy("bucket").agg(F.array(*map(order, range(SAMPLE))).alias("chosen"))
    outside = split.filter("label <> main").join(materialize(chosen), "bucket")
    return outside.select("id", F.explode("chosen").alias("pivot")).distinct()


def join_block(table: pa.Table, similarity: float) -> pa.Table:
    """Links of the hosts of a block with its other rows: for each linked row its id and the smallest id it reaches.

    The rows' shingles make an inverted index; a host's shared shingles with all rows are counted at once.
    """
    ids = table.column("id").to_numpy()
    host, guest = (table.column(c).to_numpy(zero_copy_only=False) for c in ("host", "guest"))
    sets = table.column("shingles").combine_chunks()
    sizes = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    flat = sets.flatten().to_numpy()
    row = np.repeat(np.arange(len(ids)), sizes)
    indexed = guest[row]
    order = np.argsort(flat[indexed], kind="stable")
    postings = row[indexed][order]
    words, first, count = np.unique(flat[indexed][order], return_index=True, return_counts=True)
    node_ids, node = np.unique(ids, return_inverse=True)
    parent = np.arange(len(node_ids))
    for h in np.flatnonzero(host):
        own = flat[ends[h] - sizes[h] : ends[h]]
        at = np.searchsorted(words, own)
        inside = at < len(words)
        at, own = at[inside], own[inside]
        at = at[words[at] == own]
        n = count[at]
        places = np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        same = np.bincount(postings[places], minlength=len(ids))
        linked = np.flatnonzero((same > 0) & guest & (same >= similarity * (sizes + sizes[h] - same)))
        hook(parent, np.full(len(linked), node[h]), node[linked])
    moved = np.flatnonzero(parent != np.arange(len(parent)))
    return pa.table({"id": node_ids[moved], "pivot": node_ids[parent[moved]]})


def linked_in_blocks(split: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between members outside their bucket's main class and all members: spanning edges (id, pivot).

    A bucket is compared in blocks of at most about BLOCK shingles a side, each in a task of its own.
    """
    rows = split.select("bucket", "id", (F.col("label") != F.col("main")).alias("host"))
    sized = rows.join(sets.select("id", F.size("shingles").alias("n")), "id")
    blocks = sized.groupBy("bucket").agg(
        F.ceil(F.sum(F.when(F.col("host"), F.col("n")).otherwise(0)) / BLOCK).cast("int").alias("hosts"),
        F.ceil(F.sum("n") / BLOCK).cast("int").alias("all"),
    )
    placed = rows.join(materialize(blocks), "bucket")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    at = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    one = F.col("all") == 1
    guests = placed.select(
        "bucket", "id", (F.col("host") & one).alias("host"), F.lit(True).alias("guest"), every("hosts").alias("i"), at("all").alias("j")
    )
    hosts = placed.filter(F.col("host") & ~one).select(
        "bucket", "id", F.lit(True).alias("host"), F.lit(False).alias("guest"), at("hosts").alias("i"), every("all").alias("j")
    )
    return (
        guests.unionByName(hosts)
        .join(sets, "id")
        .groupBy("bucket", "i", "j")
        .applyInArrow(lambda table: join_block(table, similarity), "id long, pivot long")
    )


def classified(docs: DataFrame, similarity: float, bands: int, rows: int, key: str, text: str) -> DataFrame:
    """id (the key), content, class_id and kept of each row with a key.

    Vertices are the different texts, numbered, as keys may repeat: key is the smallest key of a text.
    """
    signed = materialize(signatures(docs, key, text, bands, rows))
    contents = signed.groupBy("content").agg(F.min("id").alias("key"), F.first("bands").alias("bands"))
    contents = materialize(contents.withColumn("id", F.monotonically_increasing_id()))
    entries = contents.select("id", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("n"), F.min("id").alias("pivot")).filter("n > 1")
    shared = materialize(shared.select("bucket", "pivot"))
    members = materialize(entries.join(shared, "bucket").select("bucket", "id", "pivot"))
    discard(shared)
    needed = contents.select("id", "key", "content").join(members.select("id").distinct(), "id")
    keyed = docs.select(F.col(key).cast("long").alias("key"), digest(text).alias("content"), F.col(text).alias("text"))
    sets = shingle_sets(keyed.join(needed, ["key", "content"]), "id", "text")
    sets = materialize(sets.distinct())

    as_edges = lambda pairs: pairs.select(F.col("id").alias("a"), F.col("pivot").alias("b"))
    pairs = members.filter("id <> pivot").select("id", "pivot").distinct()
    links = materialize(verified(pairs, sets, similarity))
    labels = connected_components(as_edges(links))
    discard(links)
    for compare in (lambda split: verified(sampled_pairs(split), sets, similarity), lambda split: linked_in_blocks(split, sets, similarity)):
        split = materialize(classes_of_buckets(members, labels))
        if split.isEmpty():
            discard(split)
            break
        links = materialize(compare(split))
        before, labels = labels, merged_components(labels, as_edges(links))
        discard(before, links, split)
    discard(members, sets)

    linked = labels.withColumnRenamed("v", "id").join(contents.select("id", "key", "content"), "id")
    least = materialize(linked.groupBy("label").agg(F.min(F.struct("key", "content")).alias("least")))
    of = linked.select("id", "label").join(least, "label").select("id", "least")
    classes = contents.join(of, "id", "left").select(
        "content",
        F.coalesce("least.key", "key").alias("class_id"),
        F.coalesce(F.col("least.content") == F.col("content"), F.lit(True)).alias("first"),
    )
    return signed.join(classes, "content").select(
        "id", "content", "class_id", ((F.col("id") == F.col("class_id")) & F.col("first")).alias("kept")
    )


def near_duplicates(
    docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The class of each document: key, class_id (smallest key of the class), kept; a row per row.

    Words are runs of word characters, lower-cased; shingles are runs of five words (all words of a shorter text).
    Two texts link if they share a band of their signatures and the Jaccard similarity of their distinct shingles,
    computed exactly, is at least `similarity`; classes are the connected components. Equal texts are one before the
    signatures are banded and link always, empty and null texts among them; other texts without words link with
    nothing. The key is an integer; rows with a null key take no part (class_id and kept null); of rows with
    one key and different texts, each is in the class of its own text. Kept are the rows with the class's smallest
    key, of its different texts under that key only one. Where such texts are in different classes, these have one
    class_id but a kept text each. Other columns are left out.

    Within a band's bucket pairs are not all compared. First every member is compared with the smallest one; then the
    members outside the bucket's largest class with two members of that class; at last those that are still outside
    are compared, block by block inside tasks, with all members. What is left untested lies within one class, so no
    link that could join two classes is lost; a bucket of thousands of near copies costs a few comparisons a member.
    """
    found = classified(docs, similarity, bands, rows, key, text).select("id", "class_id", "kept")
    absent = docs.filter(F.col(key).isNull()).select(
        F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("class_id"), F.lit(None).cast("boolean").alias("kept")
    )
    return found.unionByName(absent).select(F.col("id").cast(docs.schema[key].dataType).alias(key), "class_id", "kept")


def drop_near_duplicates(
    docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """docs with one row of each class: the one with the smallest key.

    Of rows with one key and text, the one whose other columns come first as JSON. Rows with a null key stay.
    """
    kept = classified(docs, similarity, bands, rows, key, text).filter("kept").select("id", "content").distinct()
    keyed = docs.select(F.col(key).cast("long").alias("id"), digest(text).alias("content"), F.struct(*docs.columns).alias("row"))
    others = F.to_json(F.struct(F.lit(0), *[F.col(f"row.`{c}`") for c in docs.columns if c != text]))
    one = keyed.join(kept, ["id", "content"], "left_semi").groupBy("id", "content").agg(F.min_by("row", others).alias("row"))
    return one.select("row.*").unionByName(docs.filter(F.col(key).isNull()))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
