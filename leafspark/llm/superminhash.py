"""Near-duplicate groups by SuperMinHash (Ertl, 2017), banding, verification on full sets, and union-find.

Texts are lower-cased (A-Z) and cut into words at 0x20 and 0x09-0x0D. A text's set is its distinct k-word shingles,
or its whole sequence if it has fewer words. Defined results: a null, empty or blank text has an empty set and is
linked with nothing; rows with one set are one node (copies are never paired), so repeated rows, and rows that share
a doc_id, cost nothing more; the least doc_id of a component names it (null ids come last); an empty table gives no
rows; other columns are ignored, whatever their names. A text is held whole, with about 16 bytes for each of its bytes.

A signature draws, for each shingle, a random permutation of the slots and lowers slot p(j) to j + u_j. The ranks of
one shingle are correlated, which lowers the variance of the similarity estimate, and most shingles stop after a
few levels: once every slot holds a value below j, level j can't change any. Levels are vectorised over all texts
of a slice. With 240 slots in 40 bands of 6, a pair at similarity 0.8 shares no band with probability 0.738**40,
about 5e-6. A candidate pair goes on to be confirmed on both full sets if the lowest bits of the slots differ no more
often than 5.3 standard deviations above what similarity 0.8 gives, which loses less than 1e-6 of such pairs.

Candidates are stars, not all pairs: each bucket ties its members to the one that shares most buckets with others, the
likely original. Where a bucket then still holds several components, its members are compared in tiles: of all that share
a hub, those outside the hub's largest component visit every chunk of the others, ``CHUNK`` by ``CHUNK`` nodes at a time, first on
sketches and sizes, which only tells which nodes have a possible partner in another component, then those nodes on full
sets. A tile gives a forest of its links, never its pairs, so no cap applies. A hub with n nodes, m of them outside its
largest component, makes n * ceil(m / CHUNK) + m * ceil(n / CHUNK) rows: in proportion to n where stars have linked most.

A set is known by 128 bits of hash, so that different sets are not taken for copies in any corpus. Small tables that are
joined back to the rows that they were counted from are written first: then Spark can split the joins' hot keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .npbytes import U64, giving_back, mix, runs, shingle_sets, text_slices
from .store import materialize

SLOTS = 240
BANDS = 40
#: Standard deviations by which a true pair's sketch may differ more than expected.
MARGIN = 5.3
#: Nodes on one side of a tile.
CHUNK = 512
#: Partners of one node that are verified in a task's group; more go to further groups.
BLOCK = 256

_LOW = U64(0xFFFFFFFF)
_SIGN_BYTES = 1 << 20


def _draw(elements: np.ndarray, level: int) -> np.ndarray:
    return mix(elements + U64((level * 2 + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))


def signatures(elements: np.ndarray, offsets: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """One row of ``slots`` values (level in the high half, fraction in the low half) per set; empty sets get the largest value."""
    sets = len(offsets) - 1
    out = np.full((sets, slots), U64(0xFFFFFFFFFFFFFFFF))
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(sets), np.diff(offsets))
    order = None
    for level in range(slots):
        draw = _draw(elements, level)
        pick = level + ((draw >> U64(32)) * U64(slots - level) >> U64(32)).astype(np.int64)
        if order is not None:
            rows = np.arange(len(elements))
            slot = order[rows, pick]
            order[rows, pick] = order[:, level]
            order[:, level] = slot
        else:
            slot = pick
        np.minimum.at(flat, owner * slots + slot, (draw & _LOW) | U64(level << 32))
        going = (out.max(axis=1) >> U64(32)) > level
        stay = going[owner]
        if not stay.any():
            break
        if order is None:
            order = np.tile(np.arange(slots, dtype=np.uint8), (int(stay.sum()), 1))
            first = pick[stay]
            order[np.arange(len(first)), first] = 0
            order[:, 0] = first
        elif not stay.all():
            order = order[stay]
        if not stay.all():
            elements, owner = elements[stay], owner[stay]
    return out


def _bands(signature: np.ndarray, bands: int) -> np.ndarray:
    rows = signature.shape[1] // bands
    out = np.zeros((len(signature), bands), U64)
    for i in range(rows):
        out = mix(out ^ signature[:, i::rows][:, :bands]) + U64(i + 1)
    return mix(out + np.arange(1, bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def _sketches(signature: np.ndarray) -> np.ndarray:
    """The lowest bit of each slot, 60 slots to a long."""
    sets, slots = signature.shape
    longs = -(-slots // 60)
    bits = np.zeros((sets, longs * 60), U64)
    bits[:, :slots] = mix(signature) & U64(1)
    return (bits.reshape(sets, longs, 60) << np.arange(60, dtype=U64)).sum(axis=2, dtype=U64)


def most_different(slots: int, percent: int) -> int:
    """Sketch bits in which a pair of the least similarity may differ."""
    p = (1 - percent / 100) / 2
    return int(slots * p + MARGIN * (slots * p * (1 - p)) ** 0.5) + 1


def _fingerprints(elements: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """128 bits of hash of each set: sums of four hashes of its elements, and its size."""
    seeds = (0x5851F42D4C957F2D, 0x14057B7EF767814F, 0x2545F4914F6CDD1D, 0x369DEA0F31A53F85)
    sums = [np.concatenate([[U64(0)], np.cumsum(mix(elements ^ U64(seed)), dtype=U64)]) for seed in seeds]
    a, b, c, d = (s[offsets[1:]] - s[offsets[:-1]] for s in sums)
    size = np.diff(offsets).astype(U64)
    return tuple(pa.array(mix(mix(x + size) + y).view(np.int64)) for x, y in ((a, b), (c, d)))


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.reshape(-1).view(np.int64)))


def _sign(k: int, slots: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, end, data, offsets in text_slices(batch.column(1), _SIGN_BYTES):
                elements, at = shingle_sets(data, offsets, k)
                signature = signatures(elements, at, slots)
                f, g = _fingerprints(elements, at)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)[row:end], "mark": batch.column(2)[row:end], "n": pa.array(np.diff(at)), "f": f, "g": g, "bands": _lists(_bands(signature, bands)), "sketch": _lists(_sketches(signature))})

    return giving_back(run)


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column(1)):
                elements, at = shingle_sets(data, offsets, k)
                values = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(elements.view(np.int64)))
                f, g = _fingerprints(elements, at)
                yield pa.RecordBatch.from_pydict({"f": f, "g": g, "items": values})

    return giving_back(run)


def _possible(run: pa.RecordBatch, percent: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The nodes of a tile, their groups, and the places (visitor, resident) of pairs in different groups that sizes and
    sketches allow."""
    side, node, group, n = (run.column(c).to_numpy(zero_copy_only=False) for c in ("side", "node", "group", "n"))
    sketch = run.column("sketch")
    sketch = sketch.flatten().to_numpy(zero_copy_only=False).reshape(len(node), -1)
    here, there = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
    apart = np.zeros((len(here), len(there)), np.int16)
    for k in range(sketch.shape[1]):
        apart += np.bitwise_count(sketch[here, k][:, None] ^ sketch[there, k][None])
    a, b = n[here][:, None], n[there][None]
    fits = (apart <= most) & (group[here][:, None] != group[there][None]) & (100 * np.minimum(a, b) >= percent * np.maximum(a, b))
    i, j = np.nonzero(fits)
    return node, group, here[i], there[j]


def _flag(percent: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hubs, nodes = [], []
        for tile in runs(batches, 3):
            if tile.num_rows > 1:
                node, _, i, j = _possible(tile, percent, most)
                found = np.unique(np.concatenate([i, j]))
                if len(found):
                    hubs.append(np.full(len(found), tile.column("hub")[0].as_py(), np.int64))
                    nodes.append(node[found])
            if len(hubs) > 2000:
                yield pa.RecordBatch.from_pydict({"hub": np.concatenate(hubs), "node": np.concatenate(nodes)})
                hubs, nodes = [], []
        if hubs:
            yield pa.RecordBatch.from_pydict({"hub": np.concatenate(hubs), "node": np.concatenate(nodes)})

    return giving_back(run)


def _compare(percent: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple[int, int]] = []
        for tile in runs(batches, 3):
            if tile.num_rows < 2:
                continue
            node, group, i, j = _possible(tile, percent, most)
            items = tile.column("items")
            start = items.offsets.to_numpy()
            start = start - start[0]
            _, values = np.unique(items.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
            size = np.diff(start)
            known = np.zeros(values.max() + 1 if len(values) else 1, bool)
            parent = {int(g): int(g) for g in group}

            def root(x: int, parent: dict[int, int] = parent) -> int:
                while parent[x] != x:
                    parent[x] = parent[parent[x]]
                    x = parent[x]
                return x

            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            for x, a, b in zip(*np.unique(i, return_index=True), np.append(np.unique(i, return_index=True)[1][1:], len(i)), strict=True):
                with_ = j[a:b]
                known[values[start[x] : start[x + 1]]] = True
                lengths = size[with_]
                ends = np.cumsum(lengths)
                at = np.repeat(start[with_] - (ends - lengths), lengths) + np.arange(ends[-1])
                common = np.add.reduceat(known[values[at]].astype(np.int64), ends - lengths)
                known[values[start[x] : start[x + 1]]] = False
                for y in with_[100 * common >= percent * (size[x] + lengths - common)].tolist():
                    p, q = root(int(group[x])), root(int(group[y]))
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        links.append((int(node[x]), int(node[y])))
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return giving_back(run)


def _tiles(members: DataFrame) -> DataFrame:
    """Rows (hub, node, group, ...) dealt to tiles: every node resides in a chunk of its hub, and those outside the hub's largest
    group also visit all chunks, in chunks themselves; sorted for runs()."""
    groups = materialize(members.groupBy("hub", "group").agg(F.count("*").alias("k")))
    hubs = groups.groupBy("hub").agg(F.max_by("group", F.struct("k", "group")).alias("largest"), F.sum("k").alias("k"), F.max("k").alias("inside"))
    hubs = materialize(hubs.select("hub", "largest", F.expr(f"cast(ceil(k / {CHUNK}) as int)").alias("homes"), F.expr(f"cast(ceil((k - inside) / {CHUNK}) as int)").alias("guests")))
    dealt = members.join(hubs, "hub").withColumn("home", F.expr("cast(pmod(xxhash64(node), homes) as int)"))
    rest = [c for c in members.columns if c != "hub"]
    residents = dealt.select("hub", "home", F.explode(F.expr("sequence(0, guests - 1)")).alias("guest"), F.lit(0).alias("side"), *rest)
    visitors = dealt.where("group <> largest").withColumn("guest", F.expr("cast(pmod(xxhash64(node, 1), guests) as int)"))
    visitors = visitors.select("hub", F.explode(F.expr("sequence(0, homes - 1)")).alias("home"), "guest", F.lit(1).alias("side"), *rest)
    keys = ["hub", "home", "guest"]
    return residents.unionByName(visitors).repartition(*keys).sortWithinPartitions(*keys)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) whose sets have 100 * intersection >= percent * union. b is the hub of a star: its partners are
    split into blocks of about BLOCK, so that no task gets all of a hub's rows."""
    hubs = materialize(pairs.groupBy("b").agg(F.expr(f"cast(ceil(count(*) / {BLOCK}) as int)").alias("blocks")))
    left = pairs.join(hubs, "b").select("a", "b", F.expr("cast(pmod(xxhash64(a, b), blocks) as int)").alias("block"))
    left = left.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
    right = hubs.join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b").select("b", "y", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"))
    both = left.join(right, ["b", "block"]).select("a", "b", F.expr("size(array_intersect(x, y))").alias("common"), F.expr("size(x) + size(y)").alias("total"))
    return both.where(f"100 * common >= {percent} * (total - common)").select("a", "b")


def _mark() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def _grouped(docs: DataFrame, k: int = 5, percent: int = 80, slots: int = SLOTS, bands: int = BANDS) -> DataFrame:
    """(doc_id, mark, n, component, component_id) for each row of ``docs``: a hash of its text, the size of its set, and
    the component's number and least doc_id, which are null for an empty set."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), _mark().alias("mark"))
    signed = materialize(texts.mapInArrow(_sign(k, slots, bands), "doc_id long, mark long, n long, f long, g long, bands array<long>, sketch array<long>"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("least")
    nodes = signed.where("n > 0").groupBy("f", "g").agg(least, F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = materialize(nodes.select(F.monotonically_increasing_id().alias("node"), "f", "g", "least.doc_id", "least.mark", "n", "bands", "sketch"))
    places = nodes.select("node", F.explode("bands").alias("bucket"))
    buckets = materialize(places.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"))
    shared = materialize(places.join(buckets, "bucket").select("bucket", "node", "members"))
    degree = shared.groupBy("node").agg(F.sum("members").alias("degree"))
    hubs = shared.join(degree, "node").groupBy("bucket").agg(F.max(F.struct("degree", "node")).alias("top")).select("bucket", F.col("top.node").alias("hub"))
    shared = materialize(shared.join(materialize(hubs), "bucket").select("bucket", "node", "hub"))
    stars = shared.where("node <> hub").groupBy("node", "hub").agg(F.lit(1).alias("x"))
    sketches = nodes.select("node", "sketch")
    stars = stars.join(sketches, "node").join(sketches.select(F.col("node").alias("hub"), F.col("sketch").alias("hub_sketch")), "hub")
    most = most_different(slots, percent)
    apart = "+".join(f"bit_count({{0}}[{i}] ^ {{1}}[{i}])" for i in range(-(-slots // 60)))
    stars = materialize(stars.where(f"{apart.format('sketch', 'hub_sketch')} <= {most}").select(F.col("node").alias("a"), F.col("hub").alias("b")))

    def full_sets(wanted: DataFrame) -> DataFrame:
        """The sets of some nodes, made again from their texts. Their keys grow with the corpus: never broadcast."""
        keys = materialize(wanted.join(nodes.select("node", "f", "g", "doc_id", "mark"), "node"))
        of = keys.select(F.col("doc_id").alias("id"), F.col("mark").alias("key")).distinct().hint("merge")
        rows = texts.join(of, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("key")), "left_semi").select("doc_id", "text")
        sets = rows.mapInArrow(_sets(k), "f long, g long, items array<long>").groupBy("f", "g").agg(F.first("items").alias("items"))
        return materialize(sets.join(keys.select("node", "f", "g"), ["f", "g"]).select("node", "items"))

    in_stars = stars.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = materialize(_verified(stars, full_sets(in_stars), percent))
    groups = connected_components(links)
    # What stars may miss: members of one bucket in different components.
    placed = materialize(shared.join(groups, "node", "left").select("bucket", "hub", "node", F.coalesce("component", "node").alias("group")))
    split = materialize(placed.groupBy("bucket").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("bucket"))
    rest = materialize(placed.where("node <> hub").join(split, "bucket").groupBy("hub", "node").agg(F.first("group").alias("group")))
    mixed = materialize(rest.groupBy("hub").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("hub"))
    rest = materialize(rest.join(mixed, "hub").join(nodes.select("node", "n", "sketch"), "node"))
    flagged = materialize(_tiles(rest).mapInArrow(_flag(percent, most), "hub long, node long").distinct())
    if not flagged.isEmpty():
        sets = full_sets(flagged.select("node").distinct())
        open_ = materialize(rest.join(flagged, ["hub", "node"]).join(sets, "node").select("hub", "node", "group", "n", "sketch", "items"))
        more = materialize(_tiles(open_).mapInArrow(_compare(percent, most), "a long, b long"))
        if not more.isEmpty():
            groups = connected_components(groups.select(F.col("node").alias("a"), F.col("component").alias("b")).unionAll(more))

    named = nodes.select("node", "f", "g", "doc_id").join(groups, "node", "left").select("f", "g", "doc_id", F.coalesce("component", "node").alias("component"))
    least = materialize(named.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    named = named.join(least, "component").select("f", "g", "component", "component_id")
    own = [F.when(F.col("n") > 0, F.col(c)).alias(c) for c in ("f", "g")]
    return signed.select("doc_id", "mark", "n", *own).join(named, ["f", "g"], "left").drop("f", "g")


def minhash_groups(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id bigint, text string); options: k, percent,
    slots and bands."""
    found = _grouped(docs, **options)
    found = found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row of each component, with all columns: of the rows with its least doc_id (null last) one with the least hash
    of its text, whatever other rows have that doc_id; of equal rows one. Rows with empty sets are linked with nothing and
    all stay."""
    found = materialize(_grouped(docs, **options))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    linked = found.where("n > 0").groupBy("component", "doc_id", "mark").agg(F.count("*").alias("rows"))
    best = linked.groupBy("component").agg(F.min(F.struct(key.alias("key"), "rows")).alias("best"))
    keys = best.select("best.key.doc_id", "best.key.mark", "best.rows")
    keys = materialize(keys.unionAll(found.where("n = 0").select("doc_id", "mark", F.lit(1).cast("long")).distinct()))

    def rows_of(some: DataFrame) -> DataFrame:
        kept = F.col("kept.doc_id")
        same = F.col("doc.doc_id").cast("long").eqNullSafe(kept) & (F.xxhash64(F.col("doc.text").cast("string")) == F.col("kept.mark"))
        return docs.alias("doc").join(some.select("doc_id", "mark").hint("merge").alias("kept"), same, "left_semi")

    repeated = keys.where("rows > 1")
    if repeated.isEmpty():
        return rows_of(keys)
    return rows_of(keys.where("rows = 1")).unionAll(rows_of(repeated).dropDuplicates(["doc_id", "text"]))
