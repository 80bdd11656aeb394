"""Operator 9: near-duplicate vectors by an exact metric range join over pivot cells."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crease.llm.common import connected_components, discard, hook, materialize, read_table, slices

#: Vectors that a cell should have, and most cells: pivots are what the driver and every task hold. Beyond that many
#: cells they grow, and are compared in more blocks each.
CELL, MAX_CELLS = 1000, 4096
#: Vectors that the pivots are chosen from.
SAMPLE = 16_384
#: Rows of one side of a block; a crowded cell is compared block by block in many tasks.
BLOCK = 8192
#: Rows that one matrix product takes at a time; pairs this near the threshold are computed again one by one.
STEP, NEAR = 256, 1e-9


def unit(raw: np.ndarray) -> np.ndarray:
    return raw / np.sqrt((raw * raw).sum(1, keepdims=True))


def matrix(column: pa.ChunkedArray | pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as doubles, padded with zeros to one width, and their lengths."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        return flat.reshape(-1, width), sizes
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out, sizes


def spread(sample: np.ndarray, cells: int, seed: int = 1) -> np.ndarray:
    """Pivots among unit vectors: each next one is drawn by the squared distance to the nearest pivot so far.

    Dense regions get one pivot before any gets a second; fewer pivots than `cells` if the sample has fewer places.
    """
    rng = np.random.default_rng(seed)
    chosen = [int(rng.integers(len(sample)))]
    gap = np.maximum(0, 2 - 2 * (sample @ sample[chosen[0]]))
    while len(chosen) < cells and gap.sum() > 1e-9:
        chosen.append(int(np.searchsorted(np.cumsum(gap), rng.random() * gap.sum()).clip(0, len(sample) - 1)))
        gap = np.minimum(gap, np.maximum(0, 2 - 2 * (sample @ sample[chosen[-1]])))
        gap[chosen[-1]] = 0
    return sample[chosen]


def homes(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell (nearest pivot) of each unit vector, and the distance to its pivot."""
    near = x @ pivots.T
    return near.argmax(1), np.sqrt(np.maximum(0, 2 - 2 * near.max(1)))


def boundary(x: np.ndarray, home: np.ndarray, pivots: np.ndarray, radii: np.ndarray, reach: float) -> np.ndarray:
    """A mask of the other cells that each unit vector of cell `home` goes to as a guest.

    A segment from x in cell i to y in cell j crosses the bisector of their pivots at some z, and by the triangle
    inequality |x - y| = |x - z| + |z - y| is at least the sum of both distances to the bisector. So if |x - y| <= r,
    one of the two lies within r / 2 of it, and a guest in the other's cell: the pair meets there. And a cell whose
    members are at most R from their pivot has no member within r of a vector that is farther than R + r from it.
    """
    near = x @ pivots.T
    own = near[np.arange(len(x)), home]
    apart = np.sqrt(np.maximum(0, 2 - 2 * pivots[home] @ pivots.T))
    guest = own[:, None] - near <= (reach / 2) * apart + 1e-9
    guest &= np.sqrt(np.maximum(0, 2 - 2 * near)) <= radii + reach + 1e-9
    guest[np.arange(len(x)), home] = False
    return guest


def join_block(table: pa.Table, width: int, threshold: float) -> pa.Table:
    """Links of the hosts (side 0) of a block with its other rows (side 1: hosts again, and guests).

    Returns id, links (weighted by copies) and root, the smallest id that the row's links in this block reach.
    """
    side = table.column("side").to_numpy()
    ids, homes, copies = (table.column(c).to_numpy() for c in ("id", "home", "copies"))
    raw, sizes = matrix(table.column("embedding"), width)
    x = unit(raw)
    cell = table.column("cell")[0].as_py() if table.num_rows else 0
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    guests = table.column("guests").combine_chunks()
    going = np.zeros((len(left), MAX_CELLS), bool)
    lists = guests.take(pa.array(left))
    going[np.repeat(np.arange(len(left)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy()] = True
    node_ids, node = np.unique(ids, return_inverse=True)
    parent = np.arange(len(node_ids))
    links = np.zeros(len(node_ids), np.int64)
    guest = homes[right] != cell
    for at in range(0, len(left), STEP):
        rows = left[at : at + STEP]
        cos = x[rows] @ x[right].T
        for i, j in zip(*np.nonzero(np.abs(cos - threshold) < NEAR), strict=True):
            a, b = raw[rows[i]], raw[right[j]]
            cos[i, j] = float(a @ b) / (math.sqrt(float(a @ a)) * math.sqrt(float(b @ b)))
        found = (cos >= threshold) & (sizes[rows][:, None] == sizes[right])
        found &= guest | (node[rows][:, None] != node[right])
        # both are guests of each other's cell: the smaller cell has the link
        found &= ~(guest & going[at : at + STEP][:, homes[right]] & (homes[right] < cell))
        i, j = np.nonzero(found)
        np.add.at(links, node[rows[i]], copies[right[j]])
        out = guest[j]
        np.add.at(links, node[right[j[out]]], copies[rows[i[out]]])
        hook(parent, node[rows[i]], node[right[j]])
    linked = np.flatnonzero(links)
    return pa.table({"id": node_ids[linked], "links": links[linked], "root": node_ids[parent[linked]]})


def vector_links(vectors: DataFrame, threshold: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each vector's links and component: key, n_links, component_id, kept; one row per row of vectors.

    Two vectors link if their cosine, in double precision, is at least `threshold` (above -1). Vectors that are null,
    empty, zero, or hold null or non-finite components link with nothing, nor do vectors of different lengths.
    n_links counts the other rows linked directly, component_id is the smallest key reachable, kept is key =
    component_id. Equal vectors are one in the join and counted by their copies. The key is an integer; a row with a
    null key links with nothing (component_id and kept null). Other columns are left out.

    Pivots, spread over a sample, partition the vectors into cells by the nearest one; the triangle inequality, by the
    bisector and by the cell's covering radius, says which vectors go to a cell as guests too; then cells are joined independently, a crowded one in blocks. A block
    returns one row per linked vector, its count and one spanning edge, however many links it has.
    """
    if not -1 < threshold <= 1:
        raise ValueError("threshold must be above -1 and at most 1")
    v = F.col(vector)
    usable = (
        F.col(key).isNotNull()
        & v.isNotNull()
        & (F.size(v) > 0)
        & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
        & F.exists(v, lambda e: e != 0)
    )
    # single precision stays as it is on the way and becomes double, exactly, inside the tasks
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    # equal vectors are told by 256 bits of digest, so the joins carry no vector
    rows = materialize(
        vectors.select(
            F.col(key).cast("long").alias("id"),
            F.when(usable, v.cast(kind)).alias("embedding"),
            F.when(usable, F.unhex(F.sha2(F.array_join(v.cast("array<double>"), " "), 256))).alias("content"),
        )
    )
    distinct = materialize(
        rows.filter("content is not null")
        .groupBy("content")
        .agg(F.min("id").alias("id"), F.count("*").cast("long").alias("copies"), F.first("embedding").alias("embedding"))
    )
    n, width = distinct.agg(F.count("*"), F.max(F.size("embedding"))).first()
    width = width or 1
    # pivots come from a bounded sample; every vector is placed and compared
    cells = max(1, min(MAX_CELLS, -(-n // CELL)))
    chosen = distinct.orderBy(F.xxhash64("content"), "id").limit(SAMPLE).select("embedding").toArrow()
    pivots = spread(unit(matrix(chosen.column("embedding"), width)[0]), cells) if n else np.zeros((1, width))
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))

    def measure(batches):
        widest = np.full(len(pivots), -1.0)
        for batch in batches:
            for part in slices(batch):
                home, away = homes(unit(matrix(part.column("embedding"), width)[0]), pivots)
                np.maximum.at(widest, home, away)
        full = np.flatnonzero(widest >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(widest[full])], ["cell", "radius"])

    measured = distinct.select("embedding").mapInArrow(measure, "cell int, radius double")
    radii = np.full(len(pivots), -10.0)
    for cell, radius in measured.groupBy("cell").agg(F.max("radius")).collect():  # a row per cell
        radii[cell] = radius

    def place(batches):
        for batch in batches:
            for part in slices(batch):
                x = unit(matrix(part.column("embedding"), width)[0])
                home, _ = homes(x, pivots)
                guest = boundary(x, home, pivots, radii, reach)
                offsets = np.concatenate([[0], np.cumsum(guest.sum(1))])
                guests = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.nonzero(guest)[1], pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*map(part.column, ("id", "copies", "embedding")), pa.array(home, pa.int32()), guests],
                    ["id", "copies", "embedding", "home", "guests"],
                )

    kinds = f"id long, copies long, embedding {kind}, home int, guests array<int>"
    placed = materialize(distinct.select("id", "copies", "embedding").mapInArrow(place, kinds))
    visits = placed.select("home", F.explode(F.concat(F.array("home"), "guests")).alias("cell"))
    sizes = visits.groupBy("cell").agg(F.sum(F.when(F.col("home") == F.col("cell"), 1).otherwise(0)).alias("hosts"), F.count("*").alias("all"))
    # one row per cell, at most MAX_CELLS
    sizes = F.broadcast(
        sizes.select(
            "cell", F.ceil(F.col("hosts") / BLOCK).cast("int").alias("host_blocks"), F.ceil(F.col("all") / BLOCK).cast("int").alias("all_blocks")
        ).filter("host_blocks > 0")
    )
    at = lambda blocks: F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    none = F.array().cast("array<int>")
    hosts = (
        placed.withColumn("cell", F.col("home"))
        .join(sizes, "cell")
        .select("*", at("host_blocks").alias("host_block"), every("all_blocks").alias("block"))
        .select("cell", "host_block", "block", F.lit(0).alias("side"), "id", "copies", "embedding", "home", "guests")
    )
    others = (
        placed.select("*", F.explode(F.concat(F.array("home"), "guests")).alias("cell"))
        .join(sizes, "cell")
        .select("*", every("host_blocks").alias("host_block"), at("all_blocks").alias("block"))
        .select("cell", "host_block", "block", F.lit(1).alias("side"), "id", "copies", "embedding", "home", none.alias("guests"))
    )
    found = materialize(
        hosts.unionByName(others)
        .groupBy("cell", "host_block", "block")
        .applyInArrow(lambda table: join_block(table, width, threshold), "id long, links long, root long")
    )
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    discard(placed)
    labels = connected_components(found.filter("root <> id").select(F.col("id").alias("a"), F.col("root").alias("b")))
    result = (
        distinct.select("content", "id", "copies").join(counts, "id", "left")
        .join(labels.withColumnRenamed("v", "id"), "id", "left")
        .select(
            "content",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("label", "id").alias("component_id"),
        )
    )
    alone = rows.filter("content is null").select("id", F.lit(0).alias("n_links"), F.col("id").alias("component_id"))
    out = rows.select("id", "content").join(result, "content").drop("content").unionByName(alone)
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").cast(vectors.schema[key].dataType).alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        (F.col("id") == component).alias("kept"),
    )


def op9_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(read_table(spark, sf_dir, "embeddings"))
