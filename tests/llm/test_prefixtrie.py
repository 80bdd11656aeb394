"""Operator 13 against DuckDB and a trie of plain dictionaries."""

from hashlib import sha256
from zlib import crc32

import pytest
from helpers import duck, same
from llm_helpers import with_extras

from crease.llm import prefixtrie

TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_turns(rows):
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    own = {}
    for r in sorted((r for r in rows if r[0] is not None), key=order):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    out = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def plain(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for seq, convs_of in members.items():
        below = [s for s in members if s[: len(seq)] == seq]
        childless = [s for s in below if not any(len(t) == len(s) + 1 and t[: len(s)] == s for t in below)]
        out.append((
            min(convs_of), len(seq), min(members[seq[:-1]]) if seq else None, len(convs_of), sum(len(s) == len(seq) + 1 for s in below), len(childless),
            sum((len(members[s]) - 1) * len(s[-1][1]) for s in below if s), sha256(",".join(map(str, sorted(c for c in convs_of if len(convs[c]) == len(seq)))).encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def found(df):
    assert df.columns == TRIE
    return sorted(map(tuple, df.collect()), key=str)


def built(df, primes=prefixtrie.PRIMES):
    turns = prefixtrie.numbered(df)
    return prefixtrie.prefix_trie(prefixtrie.with_roots(prefixtrie.with_shared_starts(turns), turns.filter("pos = 1")), primes)


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_table(spark, sf_dir):
    ours = prefixtrie.op13_prefix_trie(spark, sf_dir)
    same(ours.toPandas(), duck(sf_dir).sql(prefixtrie.OP13_SQL).df())
    if sf_dir.endswith("001"):
        rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
        assert found(ours) == plain(plain_turns([tuple(r) for r in rows]))


SCHEMA = "conv_id long, turn long, role string, text string"


def edge_rows():
    rows = [(c, t, "user" if t % 2 else "bot", f"t{t % 3}" * (1 + c % 2)) for c in (0, 1, 2, 3, 5, 99, 100, 101, 150, 205, 206) for t in range(c % 9 + 1)]
    rows += [(7, None, None, None), (7, 3, "user", None), (7, 3, "user", None), (7, 2, None, "x"), (None, 1, "user", "lost"), (-5, 1, "a", "b"), (-100, 1, "a", "c"), (-5, 9, "a", "é🙂")]
    rows += [(300 + k, t, "user", "same") for k in range(40) for t in range(6)]
    return [*rows, (400, 0, "long", "y" * 200_000), (401, 0, "long", "y" * 200_000)]


@pytest.mark.parametrize("primes", [prefixtrie.PRIMES, (2, 3), (1, 1)])
def test_edges_and_collisions(spark, primes):
    """Null, repeated and textless turns, absent first conversations; small primes make prefixes collide, prime 1 all of them."""
    df = with_extras(spark.createDataFrame(edge_rows(), SCHEMA)).withColumn("rep", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("own"))
    assert found(built(df.repartition(3), primes)) == plain(plain_turns(edge_rows()))


def test_no_rows(spark):
    assert built(spark.createDataFrame([], SCHEMA)).count() == 0
    assert built(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA)).count() == 0


def test_hot_conversation(spark):
    """One conversation with most of the turns crosses many tasks; its numbers and sums go on over their edges."""
    rows = [(8, t, "r", str(t)) for t in range(3000)] + [(9, t, "r", str(t if t < 1500 else -t)) for t in range(2000)] + [(c, t, "r", "z") for c in range(10, 60) for t in range(3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = prefixtrie.numbered(df)
        assert {(r.conv_id, r.pos, r.text) for r in placed.collect()} == {(c, t + 1, x) for c, t, _, x in rows}
        assert placed.written[0].filter("conv_id = 8").select("part").distinct().count() > 1
        trie = {(r.conv_id, r.depth): r for r in prefixtrie.prefix_trie(prefixtrie.with_roots(placed.withColumnRenamed("pos", "d"), placed.filter("pos = 1"))).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert trie[8, 0].n_convs == 52 and trie[8, 0].n_leaves == 3 and trie[8, 1500].n_convs == 2 and trie[8, 1500].n_children == 2
    assert trie[8, 1500].saved_tokens == 4 and trie[8, 1].saved_tokens == sum(len(str(t)) for t in range(1500))
    assert trie[9, 2000].n_leaves == 1 and trie[9, 1501].parent_conv_id == 8 and trie[10, 3].saved_tokens == 49
