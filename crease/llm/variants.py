"""Operator 12: spelling variants by anagram hashing."""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.llm.common import discard, map_batches, materialize, read_table, texts_of

#: Fewest code points and occurrences of a word; a form is so many times as frequent as its variant.
SHORTEST, LEAST, RATIO = 5, 3, 2
#: Of the words of a corpus, one in so many loses a letter before it is counted, where a query asks for misspellings.
DAMAGED = 97
#: An anagram key is the sum of this power of the code points of a word, modulo 2^64.
POWER = 5


def anagram_key(word: str) -> int:
    """A number that words of the same letters share, in any order."""
    return sum(ord(c) ** POWER for c in word) & (2**64 - 1)


def lowered(text: str) -> str:
    """The text with A-Z, and no other letter, in lower case."""
    return text.encode().lower().decode()


def damage(run: str, prefix: int) -> str:
    """The run without one of its letters if its crc32 after a prefix of this crc32 is a multiple of DAMAGED."""
    h = crc32(run.encode(), prefix)
    if h % DAMAGED:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, damaged: bool = False, shortest: int = SHORTEST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: how often each word of at least `shortest` code points stands in all documents.

    Words are the longest runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased. damaged: words lose a letter by
    damage(), after the key and a colon. A null text has no words, a null key is an empty text; repeated rows count
    each. The words of a slice of documents are counted before the shuffle, so no word gathers in one task.
    """
    run = re.compile("[a-zÀ-ÿ]{%d,}" % shortest)

    def start():
        def each(batch: pa.RecordBatch):
            total: Counter = Counter()
            for name, whole in zip(batch.column(0).to_pylist(), texts_of(batch, text), strict=True):
                found = run.findall(lowered(whole))
                if not damaged:
                    total.update(found)
                    continue
                prefix = crc32(f"{'' if name is None else name}:".encode())
                for word, n in Counter(found).items():
                    if len(word := damage(word, prefix)) >= shortest:
                        total[word] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        return each

    return map_batches(docs.select(key, text), "word string, n long", start).groupBy("word").agg(F.sum("n").alias("n"))


def with_keys(words: DataFrame) -> DataFrame:
    """word, n, key (its anagram key) and removed (the keys of the word without one letter, for each of its letters)."""

    def start():
        def signed(x: int) -> int:
            x &= 2**64 - 1
            return x - 2**64 if x >> 63 else x

        def each(batch: pa.RecordBatch):
            found = batch.column("word").to_pylist()
            keys = [anagram_key(w) for w in found]
            removed = [[signed(k - ord(c) ** POWER) for c in sorted(set(w))] for w, k in zip(found, keys, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(map(signed, keys), pa.int64()), pa.array(removed, pa.list_(pa.int64()))], ["word", "n", "key", "removed"]
            )

        return each

    return map_batches(words.select("word", F.col("n").cast("long").alias("n")), "word string, n long, key long, removed array<long>", start, rows=8192)


def near_pairs(keyed: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: each two words of with_keys(), a before b, that differ by one inserted, deleted or replaced letter, once.

    Two words of one length that differ by an exchange have a common key once a letter is taken from each; two that
    differ by an addition, once it is taken from the longer one. Either the first half or the last half of the letters
    that are left stands unchanged in both words, so key, number of letters and a half are joined as one hash, and the
    order of letters is verified. Only the words of a rare key and half meet, whatever the size of the corpus; the
    pairs themselves are bounded by the alphabet: a word has at most 90 exchanges a letter.
    """
    whole = F.struct(F.col("key"), F.length("word").alias("m"), F.lit(True).alias("whole"))
    without = F.transform("removed", lambda k: F.struct(k.alias("key"), (F.length("word") - 1).alias("m"), F.lit(False).alias("whole")))
    rows = keyed.select("word", "n", F.explode(F.concat(F.array(whole), without)).alias("e")).select("word", "n", "e.*")
    half = F.floor(F.col("m") / 2).cast("int")
    first, last = F.left("word", half), F.right("word", half)
    ends = F.array(F.struct(F.lit(True).alias("front"), first.alias("half")), F.struct(F.lit(False).alias("front"), last.alias("half")))
    rows = rows.select("word", "n", "key", "m", "whole", F.explode(ends).alias("end"))
    entries = rows.select(F.xxhash64("key", "m", "end.front", "end.half").alias("h"), "word", "n", "m", "whole", F.col("end.front").alias("front"))
    a, b = entries.alias("a"), entries.alias("b")
    same_front = F.left("a.word", F.floor(F.col("a.m") / 2).cast("int")) == F.left("b.word", F.floor(F.col("a.m") / 2).cast("int"))
    met = (
        (F.col("a.h") == F.col("b.h"))
        & (F.col("a.word") < F.col("b.word"))
        & ~(F.col("a.whole") & F.col("b.whole"))
        & (F.col("a.m") == F.col("b.m"))
        & (F.col("a.front") == F.col("b.front"))
        & (F.col("a.front") | ~same_front)  # met at the front already
        & (F.levenshtein("a.word", "b.word", 1) == 1)
    )
    return a.join(b, met).select(F.col("a.word").alias("a"), F.col("a.n").alias("n_a"), F.col("b.word").alias("b"), F.col("b.n").alias("n_b"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of each (word, form): the last form that forms lead to (a written table).

    A form is at least twice as frequent as its word, so ways have no cycles and at most 63 steps; each round doubles
    the steps taken.
    """
    table = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        above = table.select(F.col("word").alias("root"), F.col("root").alias("top"))
        new = materialize(table.join(above, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")))
        moved = not new.filter("moved").isEmpty()
        discard(table)
        table = new
        if not moved:
            return table.select("word", "root")


def spelling_variants(words: DataFrame, ratio: float = RATIO) -> DataFrame:
    """The words with their variants: word, form, root, n, n_near, form_n.

    words: word (each once, not null) and n. n_near: the words that differ by one code point inserted, deleted or
    replaced. form: of these the one of largest n, of several the smallest in code-point order, if that n is at least
    `ratio` times the word's; form_n its n; else both null. root: the last of the forms of forms, or the word itself.
    ratio is above 1. No words give no rows. Any letters are taken; other columns are left out.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1, else forms may lead in a circle")
    keyed = materialize(with_keys(words))
    pairs = near_pairs(keyed)
    sides = F.array(
        F.struct(F.col("a").alias("word"), F.col("n_a").alias("n"), F.col("b").alias("near"), F.col("n_b").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("near"), F.col("n_a").alias("near_n")),
    )
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    near = pairs.select(F.explode(sides).alias("s")).select("s.*").groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"), F.first("n").alias("n"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    near = materialize(near.select("word", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")))
    last = roots(near.filter("form IS NOT NULL"))
    found = keyed.select("word", "n").join(near, "word", "left").join(last, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = word_counts(read_table(spark, sf_dir, "documents"), damaged=True)
    return spelling_variants(counts.filter(F.col("n") >= LEAST))


#: op12's result for DuckDB; the crc32 goes bit by bit over the bytes of a text.
OP12_SQL = f"""
WITH RECURSIVE low AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS k, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
runs AS (SELECT k, run, count(*) AS c FROM (SELECT k, unnest(regexp_extract_all(t, '[a-zÀ-ÿ]{{{SHORTEST},}}')) AS run FROM low) GROUP BY ALL),
coded AS (SELECT run, c, hex(encode(k || ':' || run)) AS x FROM runs),
hashed AS (
  SELECT run, c, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(1, length(x), 2), lambda i: CAST('0x' || substr(x, i, 2) AS BIGINT)),
    lambda a, b: list_reduce([xor(a, b)] || range(8), lambda y, i: xor(y >> 1, 3988292384 * (y & 1))))) AS h FROM coded),
damaged AS (SELECT c, CASE WHEN h % {DAMAGED} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
counts AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM damaged WHERE length(word) >= {SHORTEST} GROUP BY word HAVING sum(c) >= {LEAST}),
holes AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS hole FROM (SELECT word, n, unnest(range(length(word))) AS i FROM counts)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM holes a JOIN holes b ON a.hole = b.hole AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM counts a JOIN holes b ON b.hole = a.word
  UNION SELECT b.word, a.word, a.n FROM counts a JOIN holes b ON b.hole = a.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
first AS (SELECT b.word, n_near, b.m, min(other) AS other FROM best b JOIN near x ON x.word = b.word AND x.m = b.m GROUP BY ALL),
judged AS (
  SELECT c.word, c.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {RATIO} * n THEN other END AS form, CASE WHEN m >= {RATIO} * n THEN m END AS form_n
  FROM counts c LEFT JOIN first f ON f.word = c.word),
ways(word, root) AS (SELECT word, word FROM judged UNION ALL SELECT w.word, j.form FROM ways w JOIN judged j ON j.word = w.root WHERE j.form IS NOT NULL),
ends AS (SELECT w.word, w.root FROM ways w JOIN judged j ON j.word = w.root WHERE j.form IS NULL)
SELECT j.word, form, root, n, n_near, form_n FROM judged j JOIN ends e ON e.word = j.word
"""
