"""Operator 13: the trie of conversation prefixes, by polynomial prefix fingerprints and verification turn by turn."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from crease.llm.common import discard, materialize, read_table

#: Two primes below 2^31 and the bases of their polynomials: a fingerprint has some 62 bits.
PRIMES, BASES = (2147483647, 2147483629), (1103515245, 1812433253)
#: Of each hundred conversations, the first lends its first turns, up to so many, to the others.
FAMILY, SHARED = 100, 6
NO_IDS = hashlib.sha256(b"").hexdigest()


def powers(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    """base ** exponents modulo prime, all below 2^31."""
    out = np.ones(len(exponents), np.int64)
    left, square = exponents.astype(np.int64), base % prime
    while left.any():
        out = np.where(left & 1, out * square % prime, out)
        square = square * square % prime
        left = left >> 1
    return out


def scan(df: DataFrame, key: str, order: list[str], values: Callable[[pa.RecordBatch], dict[str, np.ndarray]], names: list[str]) -> DataFrame:
    """df with the running sums `names` of values() over the rows of each key in this order, a row's own included, and own_*.

    values(batch) gives arrays of int64 that are not negative. The rows are sorted over all tasks by key and order, so a
    key of any size is spread; each task scans its rows with numpy, and what the earlier tasks have of a key that
    crosses their edges (at most two keys a task, which bounds what is broadcast) is added.
    """
    schema = df.withColumns({"part": F.lit(0)} | {x + c: F.lit(0).cast("long") for c in names for x in ("", "own_")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, carried = None, dict.fromkeys(names, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            first = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
            run_of = np.repeat(np.arange(len(first)), np.diff(first, append=len(keys)))
            own, out = values(batch), {}
            for name, x in own.items():
                total = np.cumsum(x)
                before = (total - x)[first]
                if keys[0] == last:
                    before[0] -= carried[name]
                out[name] = total - before[run_of]
                carried[name] = int(out[name][-1])
            last = keys[-1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(keys), part, np.int32)), *(pa.array(x[c]) for c in names for x in (out, own))],
                schema.names,
            )

    ranged = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    local = materialize(ranged.mapInArrow(run, schema))
    edges = local.groupBy("part").agg(F.array(F.min(key), F.max(key)).alias("ends")).select(F.explode("ends").alias(key)).distinct()
    sums = local.join(F.broadcast(edges), key, "left_semi").groupBy(key, "part").agg(*[F.max(c).alias(c) for c in names])
    earlier = W.partitionBy(key).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select(key, "part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in names])
    whole = local.join(F.broadcast(carried), [key, "part"], "left")
    out = whole.withColumns({c: F.col(c) + F.coalesce(f"{c}_before", F.lit(0)) for c in names}).drop("part", *[f"{c}_before" for c in names])
    out.written = [local]
    return out


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos (from 1), role, text: the turns of each conversation in order.

    Null turns come first; equal turns stand by role and then text; a null role or text is empty; rows without a
    conversation are left out; repeated rows stay.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text")
    )
    ones = lambda batch: {"pos": np.ones(batch.num_rows, np.int64)}
    placed = scan(rows, "conv_id", ["turn", "role", "text"], ones, ["pos"])
    out = placed.select("conv_id", "pos", "role", "text")
    out.written = placed.written
    return out


def with_shared_starts(turns: DataFrame) -> DataFrame:
    """conv_id, d (from 1), role, text: numbered() turns of conversations whose starts are those of their family.

    Conversation c starts with the first h turns of the conversation c - c % FAMILY (all, if it has fewer; none, if
    there is none) and goes on with its own turns after the first h; h is the unsigned crc32 of the decimal c modulo
    SHARED, and c % FAMILY is not negative.
    """
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED
    rows = turns.withColumns({"h": shared, "base": F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))})
    starts = materialize(turns.filter((F.col("pos") < SHARED) & (F.pmod("conv_id", F.lit(FAMILY)) == 0)).withColumnRenamed("conv_id", "base"))
    given = rows.filter("pos = 1").select("conv_id", "h", "base").join(starts, "base").filter("pos <= h")
    lengths = starts.groupBy("base").agg(F.max("pos").alias("most"))
    own = rows.filter("pos > h").join(lengths, "base", "left")
    place = F.col("pos") - F.col("h") + F.least("h", F.coalesce("most", F.lit(0)))
    out = given.select("conv_id", F.col("pos").alias("d"), "role", "text").unionByName(own.select("conv_id", place.alias("d"), "role", "text"))
    out.written = [starts]
    return out


def fingerprinted(rows: DataFrame, primes: tuple[int, int]) -> DataFrame:
    """Rows (conv_id, d, role, text) with fp, the fingerprint of the first d turns, and above, that of the first d - 1 (a written table).

    A prefix's fingerprint is, for each of two primes p, the sum over its turns of hash * base^d modulo p, so one scan
    of running sums gives those of all prefixes.
    """
    turn = lambda k, p: F.when(F.col("d") > 0, F.pmod(F.xxhash64(F.lit(k), "role", "text"), F.lit(p))).otherwise(0)
    hashed = rows.withColumns({f"t{k}": turn(k, p) for k, p in enumerate(primes)})

    def terms(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        d = batch.column("d").to_numpy()
        return {f"s{k}": batch.column(f"t{k}").to_numpy() * powers(BASES[k], d, p) % p for k, p in enumerate(primes)}

    found = scan(hashed, "conv_id", ["d"], terms, ["s0", "s1"])
    code = lambda s0, s1: F.pmod(s0, F.lit(primes[0])) * 2**31 + F.pmod(s1, F.lit(primes[1]))
    s0, s1 = F.col("s0"), F.col("s1")
    out = materialize(
        found.select("conv_id", "d", "role", "text", code(s0, s1).alias("fp"), code(s0 - F.col("own_s0"), s1 - F.col("own_s1")).alias("above"))
    )
    discard(*found.written)
    return out


def verified_classes(rows: DataFrame) -> DataFrame:
    """conv_id, d, rep, n of fingerprinted() rows: the smallest conversation with the same first d turns, and how many have them.

    Rows of one depth and fingerprint are candidates. Each is compared with the smallest of them: role, text and the
    class of the turn above must be the same. Then, by induction over the depth, equal classes are equal prefixes. Rows
    that differ get a class of their own and all are compared again, until none differs; without collisions that is one
    round. (A written table.)
    """
    same = ["role", "text", "above", "above_label"]
    zero = F.lit(0).cast("long")
    state = rows.withColumns({"label": zero, "above_label": zero})
    turn = 0
    while True:
        turn += 1
        reps = state.groupBy("d", "fp", "label").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n"))
        of_rep = state.select(F.col("conv_id").alias("rep"), "d", *[F.col(c).alias(f"rep_{c}") for c in same])
        alike = F.forall(F.array(*[F.col(c).eqNullSafe(F.col(f"rep_{c}")) for c in same]), lambda x: x)
        compared = state.join(reps, ["d", "fp", "label"]).join(of_rep, ["rep", "d"])
        classes = materialize(compared.select("conv_id", "d", "rep", "n", alike.alias("same")))
        if classes.filter("NOT same").isEmpty():
            if turn > 1:
                discard(state)
            return classes.select("conv_id", "d", "rep", "n")
        new = F.when(F.col("same"), F.col("label")).otherwise(F.xxhash64("label", F.lit(turn)))
        labels = state.select("conv_id", "d", "label").join(classes, ["conv_id", "d"]).select("conv_id", "d", new.alias("label"))
        above = labels.select("conv_id", (F.col("d") + 1).alias("d"), F.col("label").alias("above_label"))
        moved = rows.join(labels, ["conv_id", "d"]).join(above, ["conv_id", "d"], "left").withColumn("above_label", F.coalesce("above_label", zero))
        before, state = state, materialize(moved)
        discard(classes, *([before] if turn > 1 else []))


def ends_hashed(ends: DataFrame) -> DataFrame:
    """rep, d, ends_sha256 of (rep, d, conv_id): the hash of the ascending conversations of each node, joined by commas.

    A hash is one sequence, so a node's conversations pass through one task; they are sorted on disk if need be and
    streamed, never held together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        row = lambda: {"rep": node[0], "d": node[1], "ends_sha256": state.hexdigest()}
        for batch in batches:
            done = []
            for *here, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here != node:
                    if node is not None:
                        done.append(row())
                    node, state = here, hashlib.sha256(str(conv).encode())
                else:
                    state.update(f",{conv}".encode())
            yield pa.RecordBatch.from_pylist(done, found)
        if node is not None:
            yield pa.RecordBatch.from_pylist([row()], found)

    found = pa.schema([("rep", pa.int64()), ("d", pa.int64()), ("ends_sha256", pa.string())])
    ranged = ends.select("rep", "d", "conv_id").repartition("rep", "d").sortWithinPartitions("rep", "d", "conv_id")
    return ranged.mapInArrow(run, "rep long, d long, ends_sha256 string")


def prefix_trie(rows: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """The nodes of the trie of conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    rows: conv_id, d (0 with empty role and text for each conversation, then 1, 2, ... for its turns), role, text. A
    node is a sequence of turns that conversations start with; conv_id is the smallest of them, so (conv_id, depth)
    names a node; the other columns are as in the contract of op13. Without conversations there is no node.

    Sums over subtrees need no walk by depth: a node's subtree is made of later turns of its own conversations, so a
    scan gives each conversation's sums from a turn on, and a node adds those of its conversations up. Turns that
    conversations share with their class count once, for its smallest conversation. primes: below 2^31.
    """
    prints = fingerprinted(rows, primes)
    classes = verified_classes(prints)
    with_up = classes.join(classes.select("conv_id", (F.col("d") + 1).alias("d"), F.col("rep").alias("parent")), ["conv_id", "d"], "left")
    lengths = prints.select("conv_id", "d", F.length("text").cast("long").alias("chars"))
    named = materialize(with_up.join(lengths, ["conv_id", "d"]))
    discard(prints)
    nodes = named.filter("conv_id = rep").select("conv_id", "d", "parent", "n")
    children = materialize(
        nodes.filter("d > 0").groupBy(F.col("parent").alias("conv_id"), (F.col("d") - 1).alias("d")).agg(F.count("*").alias("n_children"))
    )
    first = F.col("conv_id") == F.col("rep")
    weighed = named.join(children, ["conv_id", "d"], "left").select(
        "conv_id", "d", "rep", F.when(first, 0).otherwise(F.col("chars")).cast("long").alias("saved"), (first & F.col("n_children").isNull()).cast("long").alias("leaf")
    )
    ahead = lambda batch: {"saved_to": batch.column("saved").to_numpy(), "leaves_to": batch.column("leaf").to_numpy()}
    scanned = scan(weighed, "conv_id", ["d"], ahead, ["saved_to", "leaves_to"])
    totals = weighed.groupBy("conv_id").agg(F.sum("saved").alias("saved_all"), F.sum("leaf").alias("leaves_all"), F.max("d").alias("last"))
    rest = materialize(
        scanned.join(totals, "conv_id").select(
            "conv_id",
            "d",
            "rep",
            (F.col("saved_all") - F.col("saved_to") + F.col("saved")).alias("saved"),
            (F.col("leaves_all") - F.col("leaves_to") + F.col("leaf")).alias("leaves"),
            (F.col("d") == F.col("last")).alias("ends"),
        )
    )
    discard(*scanned.written)
    sums = rest.groupBy(F.col("rep").alias("conv_id"), "d").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ends = ends_hashed(rest.filter("ends")).withColumnRenamed("rep", "conv_id")
    found = nodes.join(children, ["conv_id", "d"], "left").join(sums, ["conv_id", "d"]).join(ends, ["conv_id", "d"], "left")
    return found.select(
        "conv_id",
        F.col("d").alias("depth"),
        F.col("parent").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_IDS)).alias("ends_sha256"),
    )


def with_roots(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """conv_id, d, role, text: the turns and a turn 0 without text for each conversation of convs."""
    return turns.unionByName(convs.select("conv_id", F.lit(0).cast("long").alias("d"), F.lit("").alias("role"), F.lit("").alias("text")))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = numbered(read_table(spark, sf_dir, "conversations"))
    whole = with_shared_starts(turns)
    rebuilt = materialize(with_roots(whole, turns.filter("pos = 1")))
    discard(*turns.written, *whole.written)
    return prefix_trie(rebuilt)


#: The unsigned crc32 of a text's bytes, bit by bit, and op13's result for DuckDB.
CRC32 = """xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST({} AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
  lambda a, b: list_reduce([xor(a, b)] || range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""

OP13_SQL = f"""
WITH ranked AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, {CRC32.format("conv_id")} % {SHARED} AS h FROM (SELECT DISTINCT conv_id FROM ranked)),
parts AS (
  SELECT c.conv_id, 0 AS own, r.pos, r.role, r.text FROM convs c JOIN ranked r ON r.conv_id = c.base AND r.pos <= c.h
  UNION ALL SELECT c.conv_id, 1, r.pos, r.role, r.text FROM convs c JOIN ranked r ON r.conv_id = c.conv_id AND r.pos > c.h),
whole AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY own, pos) AS turns FROM parts GROUP BY conv_id),
every AS (SELECT c.conv_id, coalesce(w.turns, []) AS turns FROM convs c LEFT JOIN whole w USING (conv_id)),
prefixes AS (SELECT conv_id, len(turns) AS n, d, list_slice(turns, 1, d) AS seq FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM every)),
nodes AS (
  SELECT seq, d, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM prefixes GROUP BY seq, d),
linked AS (
  SELECT c.seq, c.d, p.conv_id AS parent_conv_id FROM nodes c JOIN nodes p ON p.d = c.d - 1 AND p.seq = list_slice(c.seq, 1, c.d - 1)),
counted AS (
  SELECT n.*, l.parent_conv_id, (SELECT count(*) FROM linked k WHERE k.d = n.d + 1 AND k.parent_conv_id = n.conv_id) AS n_children
  FROM nodes n LEFT JOIN linked l ON l.seq = n.seq AND l.d = n.d),
paths AS (SELECT *, unnest(range(d + 1)) AS up FROM counted),
below AS (
  SELECT list_slice(seq, 1, up) AS seq, up AS d, count(*) FILTER (n_children = 0) AS n_leaves,
    sum((n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE length(seq[d].text) END) AS saved_tokens
  FROM paths GROUP BY 1, 2)
SELECT c.conv_id, CAST(c.d AS BIGINT) AS depth, c.parent_conv_id, c.n_convs, c.n_children, b.n_leaves,
  CAST(b.saved_tokens AS BIGINT) AS saved_tokens, c.ends_sha256
FROM counted c JOIN below b ON b.seq = c.seq AND b.d = c.d
"""
