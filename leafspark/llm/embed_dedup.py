"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine c or more are at squared distance 2 - 2c or less. They are rotated by random signs and a
Walsh-Hadamard transform, which spreads length evenly, and split into ``blocks`` blocks of few coordinates. A pair within
the whole budget is within a ``blocks``-th of it in at least one block, so a range join of every block under that share
finds every such pair; nothing is approximate. Candidates are verified by the exact cosine of the given vectors in double
precision, and a pair counts in the block in which it is closest only, so that the union over blocks needs no table of
pairs: tasks give each vector's number of links, and a forest of links by union-find for the components.

The range join of a block runs in tiles, by bitmaps: each coordinate is cut into ``LEVELS`` levels, and each level has a
bitmap of the vectors within reach of it. The bitmaps of a vector's levels, one for each coordinate of the block, are
intersected, 64 vectors to an operation; distances are computed only for what is left (``join_tile`` returns how many),
which for vectors without structure is a few in a thousand of all pairs. Tests of bits do grow with the square of
the number of different vectors: in many dimensions, cells or trees would copy each vector to most of its neighbours
before they part anything, and cost more than this.

Vectors equal in every component are one class, weighted by its rows: copies are counted, never paired. A class is known by
128 bits of hash. Classes are dealt to chunks of at most ``CHUNK_FLOATS`` numbers and each two chunks meet in a tile, with the
vectors themselves and all blocks together, so no task holds more than two chunks and a vector moves as often as there
are chunks, not once for each block and cell.

Defined results: a null or zero vector, and one with a null or non-finite component, links with nothing and is its own
component; vectors of different length aren't compared; rows that share a vec_id count as vectors of their own; a
missing vec_id is never the least; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .npbytes import runs
from .store import materialize

BLOCKS = 4
LEVELS = 128
#: Numbers in the vectors of one side of a tile, and the least number of chunks, so that tiles are enough for many tasks.
CHUNK_FLOATS = 1 << 19
LEAST_CHUNKS = 8
_SLACK = 1e-9
_ROWS = 256
_PAIRS = 1 << 16


def rotate(unit: np.ndarray, seed: int = 0) -> np.ndarray:
    """Random signs and a normalised Walsh-Hadamard transform, padded to a power of two. Each row's result depends on
    that row only, to the last bit, as it is made of elementwise steps."""
    dims = unit.shape[1]
    width = 1 << max(0, dims - 1).bit_length()
    out = np.zeros((len(unit), width))
    out[:, :dims] = unit * np.random.default_rng(seed).choice([-1.0, 1.0], dims)
    step = 1
    while step < width:
        pairs = out.reshape(len(out), -1, 2, step)
        low, high = pairs[:, :, 0].copy(), pairs[:, :, 1].copy()
        pairs[:, :, 0], pairs[:, :, 1] = low + high, low - high
        step *= 2
    return out / math.sqrt(width)


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _reach_bitmaps(right: np.ndarray, low: float, step: float, radius: float) -> np.ndarray:
    """For each level of one coordinate, 64 to a long, the ``right`` values within reach of some value of that level."""
    edges = low + np.arange(LEVELS + 1) * step
    near = (right[None] >= edges[:-1, None] - radius) & (right[None] <= edges[1:, None] + radius)
    bits = np.zeros((LEVELS, -(-len(right) // 64) * 8), np.uint8)
    packed = np.packbits(near, axis=1, bitorder="little")
    bits[:, : packed.shape[1]] = packed
    return bits.view("<u8")


def _range_join(left: np.ndarray, right: np.ndarray, limit: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(left rows, right rows) of all pairs that may be within the squared distance ``limit``, a slice of left rows at a time."""
    radius = math.sqrt(limit)
    maps, levels = [], []
    for axis in range(left.shape[1]):
        x, y = left[:, axis], right[:, axis]
        low = float(x.min())
        step = max((float(x.max()) - low) / LEVELS, 1e-12) * (1 + 1e-9)
        maps.append(_reach_bitmaps(y, low, step, radius + 1e-12))
        levels.append(np.minimum(((x - low) / step).astype(np.int64), LEVELS - 1))
    for at in range(0, len(left), _ROWS):
        met = maps[0][levels[0][at : at + _ROWS]]
        for bits, level in zip(maps[1:], levels[1:], strict=True):
            met &= bits[level[at : at + _ROWS]]
        row, word = np.nonzero(met)
        for a in range(0, len(row), _PAIRS // 16):
            some = met[row[a : a + _PAIRS // 16], word[a : a + _PAIRS // 16]]
            k, bit = np.nonzero(np.unpackbits(some[:, None].view(np.uint8), axis=1, bitorder="little"))
            yield row[a + k] + at, word[a + k] * 64 + bit


def join_tile(unit: np.ndarray, left: np.ndarray, right: np.ndarray | None, cosine: float, blocks: int = BLOCKS) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(a, b, distances computed) for the pairs of rows of ``unit`` with that cosine or more: of ``left`` with ``right``, or
    of ``left`` with itself if that is None. Each pair comes once."""
    squared = 2 - 2 * cosine
    turned = rotate(unit)
    blocks = min(blocks, turned.shape[1])
    turned = turned.reshape(len(unit), blocks, -1)
    limit = squared / blocks + _SLACK
    other = left if right is None else right
    for block in range(blocks):
        own = np.ascontiguousarray(turned[:, block])
        for i, j in _range_join(own[left], own[other], limit):
            a, b = left[i], other[j]
            if right is None:
                a, b = a[a < b], b[a < b]
            for at in range(0, len(a), _PAIRS):
                x, y = a[at : at + _PAIRS], b[at : at + _PAIRS]
                tested = len(x)
                near = ((own[x] - own[y]) ** 2).sum(axis=1) <= limit
                x, y = x[near], y[near]
                like = (unit[x] * unit[y]).sum(axis=1) >= cosine
                x, y = x[like], y[like]
                mine = ((turned[x] - turned[y]) ** 2).sum(axis=2).argmin(axis=1) == block
                yield x[mine], y[mine], tested


def _united(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Union-find on arrays: roots are hooked to lesser roots until no pair (x, y) has two; every label is a root then."""
    while True:
        while (label != (up := label[label])).any():
            label = up
        p, q = label[x], label[y]
        apart = p != q
        if not apart.any():
            return label
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))


def _tile(run: pa.RecordBatch, cosine: float, blocks: int) -> pa.RecordBatch:
    """Each linked vector's weighted number of links in the tile, and the one that names its component there."""
    node, weight, side = (run.column(c).to_numpy(zero_copy_only=False) for c in ("node", "weight", "side"))
    unit = unit_vectors(run.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(len(node), -1))
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    inside = run.column("left")[0].as_py() == run.column("right")[0].as_py()
    links = np.zeros(len(node), np.int64)
    label = np.arange(len(node))
    if len(left) and (inside or len(right)):
        for x, y, _ in join_tile(unit, left, None if inside else right, cosine, blocks):
            np.add.at(links, x, weight[y])
            np.add.at(links, y, weight[x])
            label = _united(label, x, y)
    keep = links > 0
    return pa.RecordBatch.from_pydict({"node": pa.array(node[keep]), "links": pa.array(links[keep]), "top": pa.array(node[label][keep])})


def _compare(cosine: float, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in runs(batches, 3):
            yield _tile(tile, cosine, blocks)

    return run


def embedding_groups(vectors: DataFrame, cosine: float = 0.95, blocks: int = BLOCKS, chunk_floats: int = CHUNK_FLOATS, least_chunks: int = LEAST_CHUNKS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id bigint, embedding array<float> or array<double>)."""
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    good = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    zero = F.lit(0.0).cast(kind[6:-1])
    rows = rows.withColumn("embedding", F.when(F.col("good"), F.transform("embedding", lambda x: x + zero)))  # no -0
    rows = materialize(rows.withColumn("h", F.when(F.col("good"), F.struct(F.xxhash64("embedding").alias("a"), F.xxhash64(F.lit(1), "embedding").alias("b")))))
    classes = rows.where("good").groupBy("h").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"))
    classes = materialize(classes.withColumns({"node": F.monotonically_increasing_id(), "dims": F.size("embedding")}))

    # A row for each length of vectors: how many chunks those are dealt to.
    sizes = classes.groupBy("dims").agg(F.expr(f"cast(greatest({least_chunks}, ceil(count(*) * dims / {chunk_floats})) as int)").alias("chunks"))
    dealt = classes.join(sizes, "dims").withColumn("chunk", F.expr("cast(pmod(xxhash64(node), chunks) as int)"))
    dealt = dealt.withColumn("to", F.explode(F.expr("sequence(0, chunks - 1)")))
    tile = ["dims", "left", "right"]
    dealt = dealt.select("dims", F.least("chunk", "to").alias("left"), F.greatest("chunk", "to").alias("right"), F.expr("cast(chunk > to as int)").alias("side"), "node", "weight", "embedding")
    dealt = dealt.repartition(*tile).sortWithinPartitions(*tile)
    found = materialize(dealt.mapInArrow(_compare(cosine, blocks), "node long, links long, top long"))

    groups = connected_components(found.where("node <> top").select(F.col("node").alias("a"), F.col("top").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("h", "node", "vec_id", "weight").join(links, "node", "left").join(groups, "node", "left")
    named = named.select("h", "vec_id", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    named = named.join(least, "component").select("h", "n_links", "component_id")
    out = rows.select("vec_id", "good", "h").join(named, "h", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("good"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
