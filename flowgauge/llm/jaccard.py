"""N-gram Jaccard join with count vectors in R-trees.

The shingles of a document are hashed into groups, and the numbers per group make a
point. What two documents share is at most the sum over coordinates of the smaller
number, and for tree nodes the same with the largest numbers below them; pairs that this
bound leaves are verified on their sets.

A tree over all documents would compare nearly everything: points of unrelated
documents lie equally far apart. So trees are built inside cells. Documents that are
similar enough share at least one of the first few of their shingles in any fixed order,
so each of these shingles is a cell, and no pair is lost. The order puts shingles that
many documents hold last, by counts in a table of fixed size, which keeps cells small.

Each set knows the place of the cell's shingle in its order. A pair whose first common
shingle this is has no other before it, so what follows in the shorter rest must suffice;
a pair is compared only in cells where it does. Texts of one template whose own parts are
too large to link share only what comes after these parts, and are never compared.

Only components are asked for, so a cell is read in two steps. First every document of a
cell is compared with one of them; then only pairs of documents that are not yet in one
component go through the cell's tree. A group of thousands of near copies costs one
comparison per copy and cell, not all its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.chars import mix
from flowgauge.llm.common import components, with_marks
from flowgauge.llm.words import WordReader, chunks, shingles
from flowgauge.runtime import cut_lineage, scratch_path

GROUPS = 128
#: Numbers of a point are one byte each; a group with so many shingles or more bounds nothing.
MANY = 255
#: Slots of the table of counts that orders shingles: rows times columns, whatever the corpus.
SLOT_ROWS, SLOT_COLUMNS = 4096, 64
SLOTS = SLOT_ROWS * SLOT_COLUMNS
LEAF = 32


def needed(total: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap of two sets with ``total`` elements together: 100 * i >= percent * (total - i)."""
    return -(-percent * total // (100 + percent))


def _needed(total: str, percent: int) -> str:
    """The same as an SQL expression."""
    return f"(({percent} * ({total}) + {99 + percent}) div {100 + percent})"


def _slot_counts(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, reader = np.zeros(SLOTS, dtype=np.int64), WordReader()
        for batch in batches:
            for _, texts in chunks(batch.column(0)):
                words, at = reader.read(texts)
                for i in range(len(texts)):
                    found = np.unique(shingles(words[at[i] : at[i + 1]], n))
                    np.add.at(counts, (found % np.uint64(SLOTS)).astype(np.int64), 1)
        table = counts.reshape(SLOT_ROWS, SLOT_COLUMNS)
        used = np.nonzero(table.any(axis=1))[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), *[pa.array(table[used, c], pa.int64()) for c in range(SLOT_COLUMNS)]],
            names=["row", *[f"c{c}" for c in range(SLOT_COLUMNS)]],
        )

    return run


def frequency_levels(texts: DataFrame, n: int) -> np.ndarray:
    """How common the shingles of a slot are, in steps of a thirty-second of a doubling.

    Every document counts. Tasks sum their slots first and Spark sums the tables row by
    row; what reaches the driver has the size of the table.
    """
    columns = [f"c{c}" for c in range(SLOT_COLUMNS)]
    schema = ", ".join(["row int", *[f"{c} long" for c in columns]])
    rows = texts.mapInArrow(_slot_counts(n), schema).groupBy("row").agg(*[F.sum(c).alias(c) for c in columns]).collect()
    counts = np.zeros((SLOT_ROWS, SLOT_COLUMNS))
    for r in rows:
        counts[r["row"]] = r[1:]
    return np.rint(32 * np.log2(counts.ravel() + 1)).astype(np.int16)


def _set_hash(found: np.ndarray) -> int:
    """One number for a set; equal sets have equal numbers, others differ but for one chance in 2**64."""
    return int(mix(found ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64).view(np.int64))


def _described(n: int, percent: int, levels: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = WordReader()
        for batch in batches:
            for start, texts in chunks(batch.column(1)):
                words, at = reader.read(texts)
                sizes, nodes, keys = [], [], []
                for i in range(len(texts)):
                    found = np.unique(shingles(words[at[i] : at[i + 1]], n))
                    size = len(found)
                    first = size - -(-percent * size // 100) + 1 if size else 0
                    level = levels[(found % np.uint64(SLOTS)).astype(np.int64)]
                    sizes.append(size)
                    nodes.append(_set_hash(found) if size else None)
                    keys.append(found[np.lexsort((found, level))[:first]].view(np.int64))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc": batch.column(0).slice(start, len(texts)),
                        "text_hash": batch.column(2).slice(start, len(texts)),
                        "size": pa.array(sizes, pa.int64()),
                        "node": pa.array(nodes, pa.int64()),
                        "keys": pa.array(keys, pa.list_(pa.int64())),
                    }
                )

    return run


def _located(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows ``node, text`` whose text has the set of the node, with its size and point."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = WordReader()
        seen: set[int] = set()  # repeated rows come to one task, but for rare splits, which do no harm
        for batch in batches:
            for start, texts in chunks(batch.column(1)):
                wanted = batch.column(0).slice(start, len(texts)).to_pylist()
                words, at = reader.read(texts)
                rows = []
                for i, node in enumerate(wanted):
                    found = np.unique(shingles(words[at[i] : at[i + 1]], n))
                    if len(found) and node not in seen and _set_hash(found) == node:
                        seen.add(node)
                        group = ((found >> np.uint64(40)) % np.uint64(GROUPS)).astype(np.int64)
                        point = np.minimum(np.bincount(group, minlength=GROUPS), MANY).astype(np.uint8).tobytes()
                        rows.append((node, len(found), point, texts[i]))
                node, size, point, text = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield pa.RecordBatch.from_pydict(
                    {
                        "node": pa.array(node, pa.int64()),
                        "size": pa.array(size, pa.int64()),
                        "point": pa.array(point, pa.binary()),
                        "text": pa.array(text, pa.string()),
                    }
                )

    return run


def _points(column: pa.Array) -> np.ndarray:
    found = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, GROUPS).astype(np.int32)
    found[found == MANY] = 1 << 22
    return found


def _within_bound(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = batch.column("size_a").to_numpy(), batch.column("size_b").to_numpy()
                most = np.minimum(_points(batch.column("point_a")), _points(batch.column("point_b"))).sum(axis=1)
                yield batch.select(["a", "b"]).filter(pa.array(most >= needed(a + b, percent)))

    return run


class CountTree:
    """An R-tree over count vectors, packed from the bottom: each node has the largest number of
    every coordinate and the smallest set below it."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        # Packed along the size first, then along coordinates, slab by slab.
        order = np.lexsort((*points.T[:4], sizes))
        self.order, self.points, self.sizes = order, points[order], sizes[order]
        self.levels = [(self.points, self.sizes)]
        while len(self.levels[-1][1]) > 1:
            top, least = self.levels[-1]
            at = np.arange(0, len(least), LEAF)
            self.levels.append((np.maximum.reduceat(top, at, axis=0), np.minimum.reduceat(least, at)))

    def pairs(self, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places in the given arrays that the bound leaves, each pair once."""
        waiting = [(len(self.levels) - 1, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
        while waiting:
            level, a, b = waiting.pop()
            if len(a) > 65536:
                half = len(a) // 2
                waiting += [(level, a[:half], b[:half]), (level, a[half:], b[half:])]
                continue
            top, least = self.levels[level]
            keep = np.minimum(top[a], top[b]).sum(axis=1) >= needed(least[a] + least[b], percent)
            a, b = a[keep], b[keep]
            if level == 0:
                yield self.order[a], self.order[b]
            elif len(a):
                n = len(self.levels[level - 1][1])
                for at in range(0, len(a), 1024):
                    i, j = np.broadcast_arrays(
                        a[at : at + 1024, None, None] * LEAF + np.arange(LEAF)[:, None],
                        b[at : at + 1024, None, None] * LEAF + np.arange(LEAF),
                    )
                    i, j = i.ravel(), j.ravel()
                    real = (i < n) & (j < n) & ((i <= j) if level > 1 else (i < j))
                    waiting.append((level - 1, i[real], j[real]))


def _tree_join(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of rows ``key, band, home, doc, component, size, reach, point``, sorted by key and band.

    Cells that fit into one leaf, most of them, are read many at a time; a larger one gets
    its tree.
    """

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, band = table.column("key").to_numpy(), table.column("band").to_numpy()
        doc, component = table.column("doc").to_numpy(), table.column("component").to_numpy()
        home, size = table.column("home").to_numpy(), table.column("size").to_numpy()
        reach = table.column("reach").to_numpy()
        points = np.concatenate([_points(c) for c in table.column("point").chunks])

        def kept(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            # A pair belongs to the upper of its bands; it is met there once.
            near = 100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b])
            near &= np.minimum(reach[a], reach[b]) >= needed(size[a] + size[b], percent)
            return near & (component[a] != component[b]) & (home[a] | home[b])

        def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            low, high = np.minimum(doc[a], doc[b]), np.maximum(doc[a], doc[b])
            return pa.RecordBatch.from_pydict({"a": pa.array(low, pa.int64()), "b": pa.array(high, pa.int64())})

        begin = np.nonzero(np.append(True, (key[1:] != key[:-1]) | (band[1:] != band[:-1])))[0]
        length = np.diff(np.append(begin, len(key)))
        cell = np.repeat(np.arange(len(begin)), length)
        small = np.repeat(length <= LEAF, length)
        for apart in range(1, min(LEAF, length.max())):
            a = np.nonzero((cell[:-apart] == cell[apart:]) & small[:-apart])[0]
            b = a + apart
            keep = kept(a, b)
            a, b = a[keep], b[keep]
            keep = np.minimum(points[a], points[b]).sum(axis=1) >= needed(size[a] + size[b], percent)
            if keep.any():
                yield out(a[keep], b[keep])
        for at, n in zip(begin[length > LEAF], length[length > LEAF], strict=True):
            if (component[at : at + n] != component[at]).any():
                for a, b in CountTree(points[at : at + n], size[at : at + n]).pairs(percent):
                    keep = kept(a + at, b + at)
                    yield out(a[keep] + at, b[keep] + at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the cell that the last batch ended in
        for batch in batches:
            if not batch.num_rows:
                continue
            key, band = batch.column("key").to_numpy(), batch.column("band").to_numpy()
            new = np.nonzero((key[1:] != key[:-1]) | (band[1:] != band[:-1]))[0] + 1
            last = held and (held[0].column("key")[0].as_py(), held[0].column("band")[0].as_py())
            if held and last != (key[0], band[0]):
                yield from pairs(pa.Table.from_batches(held))
                held = []
            if len(new):
                yield from pairs(pa.Table.from_batches([*held, batch.slice(0, new[-1])]))
                held = [batch.slice(new[-1])]
            else:
                held.append(batch)
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return run


def _verifier(n: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = WordReader()
        known: dict[int, np.ndarray] = {}

        def sets(ids: list[int], texts: pa.Array) -> None:
            fresh = {d: i for i, d in enumerate(ids) if d not in known}
            if sum(map(len, known.values())) > 1 << 21:
                known.clear()
                fresh = {d: i for i, d in enumerate(ids)}
            held = list(fresh.items())
            for at in range(0, len(held), 128):
                some = held[at : at + 128]
                words, begin = reader.read([texts[i].as_py() or "" for _, i in some])
                for k, (d, _) in enumerate(some):
                    known[d] = np.unique(shingles(words[begin[k] : begin[k + 1]], n))

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                known_a: dict[int, np.ndarray] = {}
                sets(a, part.column("text_a"))
                known_a.update({d: known[d] for d in a})
                sets(b, part.column("text_b"))
                keep = []
                for x, y in zip(a, b, strict=True):
                    p, q = known_a[x], known[y]
                    both = len(p) + len(q) - len(np.union1d(p, q))
                    keep.append(100 * both >= percent * (len(p) + len(q) - both))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 4, percent: int = 85, per_text: bool = False
) -> DataFrame:
    """``id_col, n_shingles, component_id`` of every row.

    A document's set holds its distinct shingles of ``words`` words; a shorter text is one
    shingle. Two documents link when ``100 * intersection >= percent * union``;
    ``component_id`` is the smallest id reachable by links, its own included. Empty and
    NULL texts have no shingles and link with nothing. Rows with a NULL id link with
    nothing and have no component. Equal texts and repeated rows are one set. Long texts are
    read whole; a set is held in one task, with its shingles as numbers.

    With ``per_text`` also ``text_hash`` and ``group``, the same for the rows whose sets are
    linked and NULL without shingles, for ids that several texts share.
    """
    spark = docs.sparkSession

    def stored(df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(spark, f"jaccard-{label}")
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    levels = frequency_levels(rows.select("text"), words)
    schema = "doc long, text_hash long, size long, node long, keys array<long>"
    hashed = rows.select("doc", "text", F.xxhash64("text").alias("text_hash"))
    described = stored(hashed.mapInArrow(_described(words, percent, levels), schema), "sets")
    known = described.where("doc IS NOT NULL AND node IS NOT NULL")
    # One document stands for all with the same set.
    classes = cut_lineage(known.groupBy("node").agg(F.min("doc").alias("doc")))
    # What a set has left from a shingle on, with it.
    keyed = known.select("node", "size", F.posexplode("keys").alias("pos", "key"))
    # Size and rest travel as one number, which keeps the rows of cells short.
    keyed = keyed.select("node", "key", F.expr("shiftleft(size, 31) | (size - pos)").alias("at"))
    size, reach = F.shiftright("at", 31), F.col("at").bitwiseAND(F.lit((1 << 31) - 1))
    shared = keyed.groupBy("key").agg(F.min("node").alias("n0"), F.max("node").alias("n1")).where("n0 < n1")
    # Sides of joins by key are written first, so that adaptive execution can split hot keys.
    shared = cut_lineage(shared.select("key"))
    # A cell is a key and a band of sizes. Bands are a little wider than the sizes of a linked
    # pair can differ, so partners are one band apart at most: a set is in its own band, its
    # home, and in the next.
    own = F.floor(F.log(size.cast("double")) / F.lit(float(np.log(100 / percent)) * 1.001)).cast("int")
    banded = cut_lineage(
        keyed.join(shared, "key")
        .select("key", "node", "at")
        .distinct()
        .select("key", "node", "at", F.explode(F.array(own, own + 1)).alias("band"))
    )
    home = F.col("band") == own
    met = banded.groupBy("key", "band").agg(
        F.min("node").alias("n0"), F.max("node").alias("n1"), F.max(home).alias("met"), F.min(size).alias("least")
    )
    met = cut_lineage(met.where("n0 < n1 AND met").select("key", "band", "least"))
    # A set stays where it could link with one as small as the least of the cell.
    cells = banded.join(met, ["key", "band"]).select(
        "key", "band", home.alias("home"), "node", size.cast("int").alias("size"), reach.cast("int").alias("reach"), "least"
    )
    cells = stored(cells.where(f"reach >= {_needed('size + least', percent)}").drop("least"), "cells")

    # Only texts that share a cell with another set are moved.
    wanted = classes.join(cells.select("node").distinct(), "node")
    located = rows.join(wanted, "doc").select("node", "text").mapInArrow(
        _located(words), "node long, size long, point binary, text string"
    )
    nodes = stored(located, "nodes")

    def side(x: str, *columns: str, of: DataFrame = nodes) -> DataFrame:
        return of.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in columns])

    def verified(pairs: DataFrame) -> DataFrame:
        # Of the texts only those of a pair are moved.
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
        own = with_marks(nodes.select("node", "text"), ends, ["node"]).where("marked")
        both = pairs.join(side("a", "text", of=own), "a").join(side("b", "text", of=own), "b").select("a", "b", "text_a", "text_b")
        # Both texts of every pair go to Python, a few pairs at a time: a hub's text comes with each of its copies.
        name = "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = spark.conf.get(name)
        spark.conf.set(name, "500")
        try:
            return cut_lineage(both.mapInArrow(_verifier(words, percent), "a long, b long"))
        finally:
            spark.conf.set(name, before)

    # Every document of a cell against the one that shares most of its cells: in a family of
    # copies that is the text they were made from, or the one closest to it.
    weights = cells.groupBy("node").agg(F.count("*").alias("n"))
    hubs = (
        cells.join(weights, "node")
        .groupBy("key", "band")
        .agg(F.max(F.struct("n", "node", "home", "size", "reach")).alias("hub"), F.count("*").alias("members"))
        .where("members > 1")
        .select("key", "band", "hub")
    )
    stars = (
        cells.join(cut_lineage(hubs), ["key", "band"])
        .where("hub.node != node AND (home OR hub.home)")
        .where(f"least(reach, hub.reach) >= {_needed('size + hub.size', percent)}")
        .withColumn("hub", F.col("hub.node"))
        .select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
        .distinct()
    )
    near = (
        stars.join(side("a", "size", "point"), "a")
        .join(side("b", "size", "point"), "b")
        .where(f"100 * least(size_a, size_b) >= {percent} * greatest(size_a, size_b)")
        .mapInArrow(_within_bound(percent), "a long, b long")
    )
    links = verified(cut_lineage(near))
    parts = cut_lineage(components(links))

    # Documents of a cell that are still apart, through the cell's tree.
    placed = cells.join(parts, "node", "left").select(
        "key", "band", "home", "node", "reach", F.coalesce("component", "node").alias("component")
    )
    apart = placed.groupBy("key", "band").agg(F.min("component").alias("c0"), F.max("component").alias("c1"))
    left = (
        placed.join(cut_lineage(apart.where("c0 < c1").select("key", "band")), ["key", "band"])
        .join(nodes.select("node", "size", "point"), "node")
        .select("key", "band", "home", F.col("node").alias("doc"), "component", "size", "reach", "point")
    )
    pairs = left.repartition("key", "band").sortWithinPartitions("key", "band").mapInArrow(_tree_join(percent), "a long, b long")
    more = verified(cut_lineage(pairs.distinct()))
    final = cut_lineage(components(links.unionByName(more)))

    joined = classes.join(final, "node", "left").select("node", "doc", F.coalesce("component", "node").alias("component"))
    smallest = joined.groupBy("component").agg(F.min("doc").alias("smallest"))
    reached = joined.join(smallest, "component").select("node", "smallest", F.col("component").alias("group"))
    more = ["text_hash", "group"] if per_text else []
    return described.join(reached, "node", "left").select(
        F.col("doc").alias(id_col),
        F.col("size").alias("n_shingles"),
        F.when(F.col("doc").isNotNull(), F.coalesce("smallest", "doc")).alias("component_id"),
        *more,
    )
