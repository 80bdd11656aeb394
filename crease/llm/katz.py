"""Operator 11: log probabilities of texts under a Katz backoff model of the corpus."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import batched
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from crease.llm.common import SLICE_ROWS, discard, let_go, materialize, read_table, slices

#: Documents whose crc32 of the key has this remainder modulo FOLDS are scored but not learned from.
FOLDS, HELD_OUT = 5, 1
#: Counts up to this have Good-Turing discounts; larger ones lose this much of an occurrence.
DISCOUNTED, TAKEN = 5, 0.5
#: What the history before the first word is called, and the token after the last; neither can be a word.
BEGIN, END = " ", "\n"
#: Words and pairs of at least one so-manieth of all training tokens are sent to every task: at most so many, whatever the corpus.
HOT_WORDS, HOT_PAIRS = 262_144, 65_536
#: Bytes of text that a task counts at once, and that a partition of the model stands for; parts in which it is worked on.
SLICE, BUCKET, PARTS = 4 << 20, 16 << 20, 4
#: Documents of a slice, so that slice * SLICE_DOCS + place names a document.
SLICE_DOCS = 65_536

#: What tasks send each other. Of a slice for a partition: words `a`, for pairs how many of them have each as second word
#: (m) and the first words `b`, how often training texts have each pair (learned), how many texts have each word or pair
#: (k), which (doc) and how often (n). Sums of some texts: doc and sums, WIDTH numbers a text. The texts of a slice: ids,
#: held, tokens, sums.
FIELDS = pa.schema(
    [("bucket", pa.int32()), ("part", pa.int32()), ("kind", pa.int32()), ("slice", pa.int64())]
    + [(c, pa.binary()) for c in ("a", "m", "b", "learned", "k", "doc", "n", "sums", "words", "word_n", "held", "tokens")]
    + [("ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))]
)
ROW = ", ".join(f"{f.name} {({'int32': 'int', 'int64': 'long', 'binary': 'binary'}).get(str(f.type), 'array<long>')}" for f in FIELDS)
PAIRS, WORDS, DOCUMENTS, SUMS, UNSEEN, MODEL = range(6)
#: Places in a text's sums: base score, log10 of the model without discounts, tokens of known words, pairs that occur 1 to DISCOUNTED times.
BASE, SCORE, KNOWN, RARE = 0, 1, 2, 3
WIDTH = 3 + DISCOUNTED


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def plain(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def pack(x: np.ndarray, rising: bool = False) -> bytes:
    """Whole numbers from 0 in the smallest type that holds them, rising ones as differences.

    The size of the type, then all lowest bytes, and so on, as what the numbers have in common then compresses.
    """
    if rising and len(x):
        x = np.diff(x, prepend=x.dtype.type(0))
    x = x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))
    return squeezed(bytes([x.dtype.itemsize]) + x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes())


def unpack(data: bytes, rising: bool = False) -> np.ndarray:
    """The numbers of pack(): rising ones of 64 bits, others of the type they were packed in."""
    data = plain(data)
    size = data[0]
    x = np.ascontiguousarray(np.frombuffer(data, np.uint8, offset=1).reshape(size, -1).T).view(f"<u{size}").ravel()
    return np.cumsum(x, dtype=np.uint64) if rising else x


def counts_in(data: bytes) -> np.ndarray:
    return unpack(data).astype(np.int64)


def floats(x: np.ndarray) -> bytes:
    return squeezed(np.ascontiguousarray(x).tobytes())


def floats_in(data: bytes, rows: int = 1) -> np.ndarray:
    x = np.frombuffer(plain(data)).reshape(rows, -1)
    return x if rows > 1 else x[0]


def table_of(rows: list[dict] | tuple[dict, ...]) -> pa.Table:
    return pa.Table.from_pylist(list(rows), FIELDS)


def runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the length of x."""
    return np.concatenate([np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])), [len(x)]]) if len(x) else np.zeros(1, np.int64)


def find(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of asked values in the rising known ones, and whether they are there."""
    if not len(known):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return at, known[at] == asked


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


BEGIN_HASH, END_HASH = word_hashes([BEGIN, END])


class Texts(NamedTuple):
    """The tokens of some texts: rising hashes of their words, each token's word, the word before it, and its text."""

    hashes: np.ndarray
    words: np.ndarray
    before: np.ndarray
    doc: np.ndarray


def tokenised(rows: pa.Table) -> Texts:
    """Words are runs of characters other than ASCII white space, with A-Z lower-cased; every text ends with END."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(rows["text"].combine_chunks()))
    coded = split.flatten().dictionary_encode()
    sizes, word, names = split.value_lengths().to_numpy(), coded.indices.to_numpy(), coded.dictionary.to_pylist()
    del split, coded
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    if "" in names:  # white space at the ends of a text
        real = word != names.index("")
        word, doc = word[real], doc[real]
    sizes = np.bincount(doc, minlength=len(sizes)) + 1
    ends = np.cumsum(sizes) - 1
    hashes = word_hashes([*names, BEGIN, END])
    order = np.argsort(hashes)
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    words = np.full(len(word) + len(sizes), rank[-1])
    words[np.arange(len(word)) + doc] = rank[word]
    before = np.roll(words, 1)
    before[ends - sizes + 1] = rank[-2]
    return Texts(hashes[order], words, before, np.repeat(np.arange(len(sizes), dtype=np.int32), sizes))


def map_texts(df: DataFrame, each: Callable[[pa.Table, int], Iterator[dict]]) -> DataFrame:
    """Rows of FIELDS of slices of some SLICE bytes; each slice has a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, room, rows, number = [], 0, 0, TaskContext.get().partitionId() << 20
        parts = (part for batch in batches for part in slices(batch))
        while True:
            part = next(parts, None)
            if part is not None:
                held.append(part)
                room, rows = room + part.nbytes, rows + part.num_rows
            if rows and (part is None or room >= SLICE or rows + SLICE_ROWS > SLICE_DOCS):
                for some in batched(each(pa.Table.from_batches(held), number), 64):
                    yield from table_of(some).to_batches()
                held, room, rows, number = [], 0, 0, number + 1
            if part is None:
                return

    return df.mapInArrow(run, ROW)


def discounted(counts: list[int]) -> np.ndarray:
    """What the counts 0 to DISCOUNTED are taken for: r times the Good-Turing factor in Katz's form; counts[r]: n-grams that occur r times.

    The largest k is used for which the factors of 1 to k lie between 0 and 1; other counts lose TAKEN of an occurrence.
    """
    out = np.maximum(np.arange(DISCOUNTED + 1) - TAKEN, 0)
    for k in range(DISCOUNTED, 0, -1):
        n = [0, *counts[1 : k + 2]]
        if min(n[1:]) > 0 and (rest := (k + 1) * n[k + 1] / n[1]) < 1:
            found = [((r + 1) * n[r + 1] / (r * n[r]) - rest) / (1 - rest) for r in range(1, k + 1)]
            if all(0 < d < 1 for d in found):
                out[1 : k + 1] = np.arange(1, k + 1) * found
                break
    return out


def taken_for(n: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """The discounted counts: rare[n] up to DISCOUNTED, n - TAKEN above."""
    return np.where(n <= DISCOUNTED, rare[np.minimum(n, DISCOUNTED)], n - TAKEN)


class Unigrams(NamedTuple):
    """The lowest order: training tokens, different ones, discounted counts, probability of all other words together."""

    tokens: int
    kinds: int
    rare: np.ndarray
    other: float

    @classmethod
    def of(cls, tokens: int, kinds: int, counts: list[int]) -> Unigrams:
        rare = discounted(counts)
        few = sum(counts[: DISCOUNTED + 1])
        left = sum(c * (r - rare[r]) for r, c in enumerate(counts[: DISCOUNTED + 1])) + TAKEN * (kinds - few)
        return cls(tokens, kinds, rare, left / tokens if tokens else 1.0)

    def p(self, n: np.ndarray) -> np.ndarray:
        """The probability of words that occur n times; of all words that never do, together."""
        return np.where(n > 0, taken_for(n, self.rare) / max(self.tokens, 1), self.other)


class Frequent(NamedTuple):
    """Rising hashes of words with training counts: of a partition, or the frequent ones with BEGIN and END, and their frequent pairs (w, v, n)."""

    words: np.ndarray
    n: np.ndarray
    pairs: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64))


NONE = Frequent(np.zeros(0, np.uint64), np.zeros(0, np.int64))


def bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    return (x % np.uint64(buckets)).astype(np.int64)


def pair_buckets(w: np.ndarray, v: np.ndarray, frequent_w: np.ndarray, buckets: int) -> np.ndarray:
    """The partition of the pair (v, w), with its part: that of w, but for frequent w one by both words."""
    x = np.where(frequent_w, mixed(w, v), w)
    return bucket_of(x, buckets) * PARTS + bucket_of(x // np.uint64(buckets), PARTS)


def mixed(w: np.ndarray, v: np.ndarray) -> np.ndarray:
    both = (w ^ (v * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
    return both ^ (both >> np.uint64(32))


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each partition with the places that go there, in order."""
    if not len(bucket):
        return
    order = np.argsort(bucket.astype(np.min_scalar_type(int(bucket.max()))), kind="stable")
    at = runs(bucket[order])
    for i, j in zip(at[:-1], at[1:], strict=True):
        yield int(bucket[order[i]]), order[i:j]


def counts_of(w: np.ndarray, *tables: Frequent) -> np.ndarray:
    """The training counts of words that are in one of the tables; of others 0."""
    out = np.zeros(len(w), np.int64)
    for table in tables:
        at, there = find(table.words, w)
        out[there] = table.n[at[there]]
    return out


def joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *parts]).astype(kind)


def encoded(x: np.ndarray, hot: Frequent, told: bool = False) -> bytes:
    """Hashes of words: places of the frequent ones in their list, of the others behind it in a list of their own; told: who reads it has that list."""
    at, known = find(hot.words, x)
    own = np.unique(x[~known])
    codes = np.where(known, at, len(hot.words) + np.searchsorted(own, x))
    own = b"" if told else pack(own, True)
    return len(own).to_bytes(8, "little") + own + pack(codes)


def decoded(data: bytes, hot: Frequent, own: np.ndarray | None = None) -> np.ndarray:
    """The hashes of encoded(); own: the list of others where it has been told."""
    size = int.from_bytes(data[:8], "little")
    own = unpack(data[8 : 8 + size], True) if own is None else own
    return np.concatenate([hot.words, own])[unpack(data[8 + size :])]


def pairs_in(row: dict, hot: Frequent, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a row as hashes w and v; they stand together by w."""
    return np.repeat(decoded(row["a"], hot, own), unpack(row["m"])), decoded(row["b"], hot)


def pairs_out(w: np.ndarray, v: np.ndarray, hot: Frequent, told: bool = False) -> dict:
    at = runs(w)
    return {"a": encoded(w[at[:-1]], hot, told), "m": pack(np.diff(at)), "b": encoded(v, hot)}


def words_of_part(words: np.ndarray, part: int, buckets: int) -> np.ndarray:
    """Of a slice's rare words in a partition those whose pairs are in this part: every word is the second of some pair."""
    return np.unique(words[bucket_of(words // np.uint64(buckets), PARTS) == part])


def counts_of_counts(n: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(n, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[: DISCOUNTED + 2].tolist()


def merge_pairs(w: np.ndarray, v: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs, together by w, with the sums of n; and the place of each given pair among them."""
    both = mixed(w, v)
    order = np.argsort(both)
    both, w, v = both[order], w[order], v[order]
    new = np.concatenate([[True], (w[1:] != w[:-1]) | (v[1:] != v[:-1])])[: len(w)]
    if (new[1:] & (both[1:] == both[:-1])).any():  # two pairs of one hash: sort by the words themselves
        again = np.lexsort((v, w))
        order, w, v = order[again], w[again], v[again]
        new = np.concatenate([[True], (w[1:] != w[:-1]) | (v[1:] != v[:-1])])[: len(w)]
    place = np.empty(len(w), np.int64)
    place[order] = np.cumsum(new) - 1
    w, v = w[new], v[new]
    by_w = np.argsort(w, kind="stable")
    rank = np.empty(len(w), np.int64)
    rank[by_w] = np.arange(len(w))
    place = rank[place]
    return w[by_w], v[by_w], np.bincount(place, n, len(w)).astype(np.int64), place


def vocabulary(docs: DataFrame, buckets: int) -> DataFrame:
    """The training words by partition: bucket, words, word_n, counts: how many occur 0, 1, ... times, then tokens and words. BEGIN has an n only."""

    def count(rows: pa.Table, _: int) -> Iterator[dict]:
        t = tokenised(rows)
        n = np.bincount(t.words, minlength=len(t.hashes))
        n[np.searchsorted(t.hashes, BEGIN_HASH)] = rows.num_rows
        hashes, n = t.hashes[n > 0], n[n > 0]
        for b, i in by_bucket(bucket_of(hashes, buckets)):
            yield {"bucket": b, "words": pack(hashes[i], True), "word_n": pack(n[i])}

    def merge(rows: pa.Table) -> pa.Table:
        words, place = np.unique(joined([unpack(x, True) for x in rows["words"].to_pylist()], np.uint64), return_inverse=True)
        n = np.bincount(place, joined([unpack(x) for x in rows["word_n"].to_pylist()], np.int64)).astype(np.int64)
        real = n[words != BEGIN_HASH]
        counts = [*counts_of_counts(real), int(real.sum()), len(real)]
        return table_of([{"bucket": rows["bucket"][0].as_py(), "words": pack(words, True), "word_n": pack(n), "counts": counts}])

    found = map_texts(docs.filter("learn").select("text"), count).groupBy("bucket").applyInArrow(merge, ROW)
    return found.select("bucket", "words", "word_n", "counts")


def summed(table: DataFrame, size: int) -> list[int]:
    """The sums of the places of `counts`."""
    return list(table.agg(*[F.coalesce(F.sum(F.get("counts", F.lit(k))), F.lit(0)) for k in range(size)]).first())


def frequent_words(table: DataFrame, least: float, with_sums: bool = False) -> list[np.ndarray]:
    """Of rows of words with word_n (and sums): the words of an n of `least` or more, BEGIN and END, rising; at most HOT_WORDS + 2 reach the driver."""
    columns = ["words", "word_n", "sums"][: 2 + with_sums]

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                words, n = unpack(r["words"], True), counts_in(r["word_n"])
                keep = (n >= least) | (words == BEGIN_HASH) | (words == END_HASH)
                found = [words[keep].view(np.int64), n[keep], *([floats_in(r["sums"])[keep].view(np.int64)] if with_sums else [])]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], columns)

    found = table.select(*columns).mapInArrow(pick, ", ".join(f"{c} long" for c in columns)).toArrow()
    x = [found[c].to_numpy().view(kind) for c, kind in zip(columns, (np.uint64, np.int64, np.float64), strict=False)]
    order = np.argsort(x[0])
    return [v[order] for v in x]


def frequent_pairs(docs: DataFrame, hot: Frequent, least: float, buckets: int) -> list[np.ndarray]:
    """w, v, n of the pairs that occur so often in training texts, rising; both of their words are frequent."""

    def count(rows: pa.Table, _: int) -> Iterator[dict]:
        t = tokenised(rows)
        known = find(hot.words, t.hashes)[1]
        both = known[t.words] & known[t.before]
        pair, n = np.unique(t.words[both].astype(np.int64) * len(t.hashes) + t.before[both], return_counts=True)
        w, v = t.hashes[pair // len(t.hashes)], t.hashes[pair % len(t.hashes)]
        for b, i in by_bucket(pair_buckets(w, v, np.True_, buckets)):
            yield {"bucket": b // PARTS, "n": pack(n[i])} | pairs_out(w[i], v[i], hot)

    def merge(rows: pa.Table) -> pa.Table:
        w, v = (joined(x, np.uint64) for x in zip(*(pairs_in(r, hot) for r in rows.to_pylist()), strict=True))
        w, v, n, _ = merge_pairs(w, v, joined([unpack(x) for x in rows["n"].to_pylist()], np.int64))
        keep = n >= least
        return pa.table([pa.array(x[keep].view(np.int64)) for x in (w, v, n)], ["w", "v", "n"])

    found = map_texts(docs.filter("learn").select("text"), count).groupBy("bucket").applyInArrow(merge, "w long, v long, n long").toArrow()
    w, v, n = found["w"].to_numpy().view(np.uint64), found["v"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.lexsort((v, w))
    return [w[order], v[order], n[order]]


def asked(kind: int, number: int, bucket: np.ndarray, place: np.ndarray, text: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, dict]]:
    """For each partition (and part), the words or pairs that go there and their row with the texts that have them; place is rising."""
    k = np.bincount(place, minlength=len(bucket))
    first = np.cumsum(k) - k
    for b, i in by_bucket(bucket):
        j = np.repeat(first[i] - np.cumsum(k[i]) + k[i], k[i]) + np.arange(k[i].sum())
        yield i, {"bucket": b // PARTS, "part": b % PARTS, "kind": kind, "slice": number, "k": pack(k[i]), "doc": pack(text[j]), "n": pack(n[j])}


def counted_by_text(x: np.ndarray, t: Texts, kinds: int, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different values of x (one a token, below kinds), and of each with each text, by value: place, text, times."""
    if kinds * texts < 2**63:
        both = x.astype(np.int64)
        both *= texts
        both += t.doc
        both.sort()
        first = runs(both)
        both, n = both[first[:-1]], np.diff(first).astype(np.int32)
        text = (both % texts).astype(np.int32)
        both //= texts
        first = runs(both)
        return both[first[:-1]], np.repeat(np.arange(len(first) - 1, dtype=np.int32), np.diff(first)), text, n
    values, place = np.unique(x, return_inverse=True)  # a text of very many different words
    both, n = np.unique(place * texts + t.doc, return_counts=True)
    return values, both // texts, both % texts, n


def word_sums(n: np.ndarray, tokens: np.ndarray) -> list[np.ndarray]:
    """What words that occur n times give as tokens and as histories."""
    known = n > 0
    return [np.log10(n + 0.5), np.where(known & tokens, -np.log10(np.maximum(n, 1)), 0), known.astype(float)]


def counted(docs: DataFrame, words: DataFrame, hot: Frequent, unigrams: Unigrams, buckets: int) -> DataFrame:
    """One pass over all texts: the model's partitions (MODEL), sums by text (SUMS), histories of unseen pairs (UNSEEN), texts (DOCUMENTS).

    The different pairs and words of a slice go to their partitions together with the texts that have them; there the
    counts of all slices are summed, and each text gets what its pairs and words of this partition give. Frequent words
    and pairs are counted in the same way, but the texts that have them are not sent: their counts are known already.
    """

    def ask(rows: pa.Table, number: int) -> Iterator[dict]:
        t, texts = tokenised(rows), rows.num_rows
        learn = np.array(rows["learn"].to_pylist(), bool)
        size = len(t.hashes)
        sums = np.zeros((WIDTH, texts))
        is_hot = find(hot.words, t.hashes)[1]
        # words: the frequent ones here, the others at home
        kinds, place, text, n = counted_by_text(t.words, t, size, texts)
        hashes, known = t.hashes[kinds], is_hot[kinds]
        here = known[place]
        for c, value in enumerate(word_sums(counts_of(hashes, hot), hashes != END_HASH)):
            sums[c] += np.bincount(text[here], value[place[here]] * n[here], texts)
        sums[SCORE] += word_sums(counts_of(np.array([BEGIN_HASH]), hot), np.True_)[SCORE]
        hashes, place = hashes[~known], (np.cumsum(~known) - 1)[place[~here]]
        for i, row in asked(WORDS, number, bucket_of(hashes, buckets) * PARTS, place, text[~here], n[~here]):
            yield row | {"words": pack(hashes[i], True)}
        del kinds, place, text, n, here
        # pairs: the texts of the frequent ones stay here
        pair, place, text, n = counted_by_text(t.words.astype(np.int64) * size + t.before, t, size * size, texts)
        learned = np.bincount(place, n * learn[text], len(pair)).astype(np.int64)
        (at_w, there_w), (at_v, there_v) = find(t.hashes, hot.pairs[0]), find(t.hashes, hot.pairs[1])
        both = there_w & there_v
        at, known = find(at_w[both] * size + at_v[both], pair)
        here = known[place]
        if known.any():
            add_pairs(sums, text[here], n[here], hot.pairs[2][both][at][place[here]])
        w, v = pair // size, pair % size
        home = pair_buckets(t.hashes[w], t.hashes[v], is_hot[w], buckets)
        w, v = t.hashes[w], t.hashes[v]
        for i, row in asked(PAIRS, number, home, place[~here], text[~here], n[~here]):
            yield row | {"learned": pack(learned[i])} | pairs_out(w[i], v[i], hot, told=True)
        own = {"ids": rows["id"].to_pylist(), "held": pack(~learn), "tokens": pack(np.bincount(t.doc, minlength=texts)), "sums": floats(sums)}
        yield {"bucket": number % buckets, "kind": DOCUMENTS, "slice": number} | own

    def answer(rows: pa.Table, own: pa.Table) -> pa.Table:
        bucket = (rows if rows.num_rows else own)["bucket"][0].as_py()
        mine = Frequent(unpack(own["words"][0].as_py(), True), counts_in(own["word_n"][0].as_py())) if own.num_rows else NONE
        out = rows.filter(pc.equal(rows["kind"], DOCUMENTS)).to_pylist()
        found: dict[int, np.ndarray] = {}
        words, told = rows.filter(pc.equal(rows["kind"], WORDS)), {}
        for i in range(words.num_rows):
            r = words.slice(i, 1).to_pylist()[0]
            k, doc, n = unpack(r["k"]), unpack(r["doc"]), unpack(r["n"])
            sums = room(found, r["slice"], doc)
            told[r["slice"]] = unpack(r["words"], True)
            for c, value in enumerate(word_sums(counts_of(told[r["slice"]], mine), np.True_)):
                sums[c] += np.bincount(doc, np.repeat(value, k) * n, sums.shape[1])
        unseen = []
        for part in range(PARTS):
            pairs = rows.filter(pc.and_(pc.equal(rows["kind"], PAIRS), pc.equal(rows["part"], part))).to_pylist()
            if pairs or not part:
                out.append(model_part(pairs, part, bucket, mine, told, found, unseen))
        out += [sums_row(number, sums) for number, sums in found.items()]
        if unseen:
            out += unseen_rows(*(np.concatenate(x) for x in zip(*unseen, strict=True)), hot, buckets)
        return table_of(out)

    def model_part(pairs: list[dict], part: int, bucket: int, mine: Frequent, told: dict[int, np.ndarray], found: dict[int, np.ndarray], unseen: list) -> dict:
        """The model's row of these pairs; their texts' sums go to found, the histories of unseen ones to unseen. told: each slice's rare words."""
        both = [pairs_in(r, hot, words_of_part(told.get(r["slice"], NONE.words), part, buckets)) for r in pairs]
        given_v = joined([v for _, v in both], np.uint64)
        learned = joined([unpack(r["learned"]) for r in pairs], np.int64)
        w, v, n, place = merge_pairs(joined([w for w, _ in both], np.uint64), given_v, learned)
        del both, learned
        new = n == 0
        lower = np.zeros(len(w))
        lower[new] = np.log10(unigrams.p(counts_of(w[new], mine, hot)))
        end = 0
        for r in pairs:
            k, doc, times = unpack(r["k"]), unpack(r["doc"]), unpack(r["n"])
            each = np.repeat(place[end : end + len(k)], k)
            sums = room(found, r["slice"], doc)
            add_pairs(sums, doc, times, n[each])
            sums[SCORE] += np.bincount(doc, lower[each] * times, sums.shape[1])
            left = new[each]
            unseen.append((np.repeat(given_v[end : end + len(k)], k)[left], r["slice"] * SLICE_DOCS + doc[left].astype(np.int64), times[left].astype(np.int64)))
            end += len(k)
        seen = ~new
        row = {"bucket": bucket, "part": part, "kind": MODEL, "n": pack(n[seen]), "counts": counts_of_counts(n[seen])} | pairs_out(w[seen], v[seen], hot)
        return row | {"words": pack(mine.words, True), "word_n": pack(mine.n)}

    found = map_texts(docs.select("id", "text", "learn"), ask)
    return found.groupBy("bucket").cogroup(words.select("bucket", "words", "word_n").groupBy("bucket")).applyInArrow(answer, ROW)


def room(found: dict[int, np.ndarray], number: int, doc: np.ndarray) -> np.ndarray:
    """The sums of a slice's texts, with room for these."""
    texts = int(doc.max()) + 1 if len(doc) else 0
    sums = found.get(number, np.zeros((WIDTH, 0)))
    if sums.shape[1] < texts:
        sums = np.pad(sums, ((0, 0), (0, texts - sums.shape[1])))
    found[number] = sums
    return sums


def add_pairs(sums: np.ndarray, text: np.ndarray, n: np.ndarray, counts: np.ndarray) -> None:
    """Add what pairs with these training counts give their texts; those of unseen pairs give nothing."""
    often = counts > DISCOUNTED
    sums[SCORE] += np.bincount(text[often], np.log10(counts[often] - TAKEN) * n[often], sums.shape[1])
    for r in range(1, DISCOUNTED + 1):
        sums[RARE + r - 1] += np.bincount(text[counts == r], n[counts == r], sums.shape[1])


def sums_row(number: int, sums: np.ndarray) -> dict:
    present = np.flatnonzero(sums.any(0))
    return {"kind": SUMS, "slice": number, "doc": pack(present, True), "sums": floats(sums[:, present])}


def unseen_rows(v: np.ndarray, doc: np.ndarray, n: np.ndarray, hot: Frequent, buckets: int) -> Iterator[dict]:
    """Histories by partition with their texts; frequent histories go by text, as all tasks know them."""
    spread = np.where(find(hot.words, v)[1], doc.astype(np.uint64), v)
    for b, i in by_bucket(bucket_of(spread, buckets)):
        i = i[np.argsort(v[i], kind="stable")]
        at = runs(v[i])
        yield {"bucket": b, "kind": UNSEEN, "a": encoded(v[i][at[:-1]], hot), "k": pack(np.diff(at)), "doc": pack(doc[i]), "n": pack(n[i])}


def histories(model: DataFrame, unigrams: Unigrams, rare: np.ndarray, hot: Frequent, buckets: int) -> DataFrame:
    """The words by partition with their counts (word_n) and log10 of their backoff weights (sums).

    A weight is what the discounts leave after the word, divided by what the words not seen after it have at the lower
    order, so that the probabilities after each word sum to one.
    """

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                mine = Frequent(unpack(r["words"], True), counts_in(r["word_n"]))
                v, n, kinds = decoded(r["b"], hot), counts_in(r["n"]), decoded(r["a"], hot)
                order = np.argsort(v)
                v = v[order]
                first = runs(v)[:-1]
                p = np.repeat(unigrams.p(counts_of(kinds, mine, hot)), unpack(r["m"]))
                p, left = (np.add.reduceat(x[order], first) if len(v) else x for x in (p, n - taken_for(n, rare)))
                v = v[first]
                rows = [{"bucket": b, "a": encoded(v[j], hot), "sums": floats(np.stack([p[j], left[j]]))} for b, j in by_bucket(bucket_of(v, buckets))]
                yield from table_of(rows).to_batches()

    def weigh(parts: pa.Table, words: pa.Table) -> pa.Table:
        if not words.num_rows:
            return table_of([])
        own = words.to_pylist()[0]
        known, n = unpack(own["words"], True), counts_in(own["word_n"])
        sums = np.zeros((2, len(known)))
        for i in range(parts.num_rows):
            r = parts.slice(i, 1).to_pylist()[0]
            sums[:, np.searchsorted(known, decoded(r["a"], hot))] += floats_in(r["sums"], 2)
        p, left = sums
        followed = left > 0  # all but END
        weights = np.zeros(len(known))
        weights[followed] = np.log10(left[followed] / n[followed] / (1 - p[followed]))
        return table_of([{"bucket": own["bucket"], "words": own["words"], "word_n": own["word_n"], "sums": floats(weights)}])

    found = model.select("a", "m", "b", "n", "words", "word_n").mapInArrow(shares, ROW).select("bucket", "a", "sums")
    words = model.filter("part = 0").select("bucket", "words", "word_n")
    return found.groupBy("bucket").cogroup(words.groupBy("bucket")).applyInArrow(weigh, ROW).select("bucket", "words", "word_n", "sums")


def backed_off(unseen: DataFrame, weights: DataFrame, hot: Frequent, common: list[np.ndarray]) -> DataFrame:
    """Sums by text of the backoff weights of the known histories of unseen pairs, in place of the histories' totals."""

    def answer(rows: pa.Table, own: pa.Table) -> pa.Table:
        tables = [common]
        if own.num_rows:
            tables.append([unpack(own["words"][0].as_py(), True), counts_in(own["word_n"][0].as_py()), floats_in(own["sums"][0].as_py())])
        out = []
        for i in range(rows.num_rows):
            r = rows.slice(i, 1).to_pylist()[0]
            v, k, doc, n = decoded(r["a"], hot), unpack(r["k"]), counts_in(r["doc"]), unpack(r["n"])
            value = np.zeros(len(v))
            for words, counts, logs in tables:
                at, there = find(words, v)
                value[there] = logs[at[there]] + np.log10(counts[at[there]])
            texts, place = np.unique(doc, return_inverse=True)
            score = np.bincount(place, np.repeat(value, k) * n)
            at = runs(texts // SLICE_DOCS)
            for a, b in zip(at[:-1], at[1:], strict=True):
                sums = np.zeros((WIDTH, b - a))
                sums[SCORE] = score[a:b]
                out.append({"kind": SUMS, "slice": int(texts[a]) // SLICE_DOCS, "doc": pack(texts[a:b] % SLICE_DOCS, True), "sums": floats(sums)})
        return table_of(out)

    return unseen.groupBy("bucket").cogroup(weights.groupBy("bucket")).applyInArrow(answer, ROW)


def katz_scores(docs: DataFrame, learn: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every text's log10 probability under a Katz model of the texts with `learn`: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are runs of characters other than ASCII white space, A-Z lower-cased, and one end for each text; a null text
    is empty. The model is of order two: a pair of words seen in training has its discounted count divided by that of
    the first word; else the first word's backoff weight times the second word's own probability, or that alone if the
    first word is unknown; all unknown words share what the discounts of single words leave. Counts up to DISCOUNTED
    have Good-Turing discounts, larger ones lose TAKEN of an occurrence, so that something is left after every word.
    base_score is the add-half unigram score, n_known the tokens seen in training, held_out NOT learn (null: learned
    from). Without training texts every score is 0. The key is an integer or null; each row gives a row; other columns
    are left out. Words are known by hashes of 64 bits.

    docs are read four times, so they are a table or as good as one.

    Counts of words, pairs and histories are tables of partitions, a row each, of some BUCKET bytes of text. A word or
    pair that is frequent anywhere is in a list of at most HOT_WORDS or HOT_PAIRS that all tasks get; the rest are rare, so no partition is
    much larger than others.
    """
    learned = F.coalesce(learn, F.lit(True))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), learned.alias("learn"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 + size // BUCKET
    words = materialize(vocabulary(rows, buckets))
    *counts, tokens, kinds = summed(words, DISCOUNTED + 4)
    unigrams = Unigrams.of(tokens, kinds, counts)
    least = max(tokens / HOT_WORDS, 1)
    hot = Frequent(*frequent_words(words, least))
    hot = hot._replace(pairs=tuple(frequent_pairs(rows, hot, max(tokens / HOT_PAIRS, 1), buckets)))
    let_go(docs.sparkSession)  # the shuffles of both counts, before the largest one
    found = materialize(counted(rows, words, hot, unigrams, buckets))
    discard(words)
    let_go(docs.sparkSession)
    model = found.filter(F.col("kind") == MODEL)
    rare = discounted(summed(model, DISCOUNTED + 2))
    weights = materialize(histories(model, unigrams, rare, hot, buckets))
    let_go(docs.sparkSession)
    common = frequent_words(weights, least, with_sums=True)
    added = materialize(backed_off(found.filter(F.col("kind") == UNSEEN).select("bucket", "a", "k", "doc", "n"), weights, hot, common))
    discard(weights)
    kept = found.filter(F.col("kind").isin(SUMS, DOCUMENTS)).unionByName(added)

    def finish(parts: pa.Table) -> pa.Table:
        rows = parts.to_pylist()
        own = next(r for r in rows if r["kind"] == DOCUMENTS)
        n = counts_in(own["tokens"])
        sums = floats_in(own["sums"], WIDTH).copy()
        for r in rows:
            if r["kind"] == SUMS:
                sums[:, unpack(r["doc"], True).astype(np.int64)] += floats_in(r["sums"], WIDTH)
        score = sums[SCORE] + np.log10(rare[1:]) @ sums[RARE:]
        base = sums[BASE] - n * np.log10(tokens + 0.5 * (kinds + 1))
        columns = [own["ids"], unpack(own["held"]).astype(bool), n, sums[KNOWN].astype(np.int64), np.full(len(n), tokens), base, score]
        kinds_of = [pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds_of, strict=True)], NAMES)

    out = kept.select("slice", "kind", "ids", "held", "tokens", "doc", "sums").groupBy("slice")
    scored = out.applyInArrow(finish, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.select(F.col("id").cast(docs.schema[key].dataType).alias(key), *NAMES[1:])


NAMES = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def op11_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    return katz_scores(read_table(spark, sf_dir, "documents"), number % FOLDS != HELD_OUT)
