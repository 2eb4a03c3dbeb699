"""Near-duplicate vectors by sorted projection passes.

In each pass every vector gets a key, the concatenated signs of its products with random
directions, and the vectors are put in the order of their keys. Each is compared with a
bounded window of the next ones; close vectors share a long beginning of the key in some
pass. Pairs that reach the cosine are united over all passes.

The windows find the components. The links inside a component are then counted without
any window: all vectors in a ball of half the angle around one of them are linked with
each other, and the rest of a component is compared with all of it, block by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgauge.llm.common import components
from flowgauge.runtime import cut_lineage, scratch_path

PASSES, WINDOW = 16, 128
#: Passes that are sorted in one job; more need more disk at once.
AT_ONCE = 4
BLOCK = 256
_DIRECTIONS = 63


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors as bytes of doubles; NULL where a vector can link with nothing."""
    for batch in batches:
        found = []
        for value in batch.column(1):
            unit = None
            if value.is_valid and not value.values.null_count and len(value.values):
                v = value.values.to_numpy(zero_copy_only=False).astype(np.float64)
                top = np.abs(v).max()
                if np.isfinite(top) and top > 0:
                    v = v / top  # so that no square over- or underflows
                    unit = (v / np.sqrt(v @ v)).astype("<f8").tobytes()
            found.append(unit)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["id", "unit"])


def _directions(number: int, dim: int) -> np.ndarray:
    return np.random.default_rng([number, dim]).normal(size=(dim, _DIRECTIONS))


def _keys(numbers: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(_DIRECTIONS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            units = batch.column(1).to_pylist()
            length = np.array([len(u) for u in units], dtype=np.int64)
            for size in np.unique(length):
                own = np.nonzero(length == size)[0]
                x = np.frombuffer(b"".join([units[i] for i in own]), dtype="<f8").reshape(len(own), -1)
                for number in numbers:
                    key = ((x @ _directions(number, x.shape[1]) > 0) * weights).sum(axis=1)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(own), number), pa.int32()),
                            pa.array(np.full(len(own), x.shape[1]), pa.int32()),
                            pa.array(key, pa.int64()),
                            batch.column(0).take(pa.array(own)),
                            batch.column(1).take(pa.array(own)),
                        ],
                        names=["pass", "dim", "key", "node", "unit"],
                    )

    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place that each of ``n`` places reaches by the links ``a - b``."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root[root]


def _linked(x: np.ndarray, window: int, least: float, split: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked pairs at most ``window`` apart; with ``split`` only pairs across that place."""
    found_a, found_b = [], []
    step = max(window, 512)
    for at in range(0, len(x), step):
        end = min(len(x), at + step + window)
        cos = x[at : at + step] @ x[at:end].T
        i, j = np.nonzero(cos >= least)
        keep = (j > i) & (j - i <= window)
        if split is not None:
            keep &= (i + at < split) & (j + at >= split)
        found_a.append(i[keep] + at)
        found_b.append(j[keep] + at)
    return np.concatenate([*found_a, np.zeros(0, dtype=np.int64)]), np.concatenate([*found_b, np.zeros(0, dtype=np.int64)])


def _links(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One link to its root for every node, so a crowd of copies gives a link each, not all pairs."""
    root = _roots(len(node), a, b)
    own = np.nonzero(root != np.arange(len(node)))[0]
    return node[own], node[root[own]]


_FOUND = "kind int, pass int, dim int, border int, place long, a long, b long, unit binary"


def _windows(window: int, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links of sorted rows (kind 0), and the first and last rows of the partition (kind 1) for its borders."""

    def rows(kind: int, number: int, dim: int, border: int, place: list, a: np.ndarray, b: np.ndarray, unit: list) -> pa.RecordBatch:
        n = len(a)
        return pa.RecordBatch.from_arrays(
            [
                *[pa.array(np.full(n, v), pa.int32()) for v in (kind, number, dim, border)],
                pa.array(place, pa.int64()),
                pa.array(a, pa.int64()),
                pa.array(b, pa.int64()),
                pa.array(unit, pa.binary()),
            ],
            names=["kind", "pass", "dim", "border", "place", "a", "b", "unit"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, node, unit = None, np.zeros(0, dtype=np.int64), []
        first = True

        def border(begin: bool) -> pa.RecordBatch:
            n = node[:window] if begin else node[-window:]
            u = unit[:window] if begin else unit[-window:]
            place = list(range(len(n))) if begin else list(range(-len(n), 0))
            return rows(1, *last, part - begin, place, n, n, u)

        for batch in batches:
            number, dim = batch.column("pass").to_numpy(), batch.column("dim").to_numpy()
            nodes, units = batch.column("node").to_numpy(), batch.column("unit").to_pylist()
            cut = np.nonzero((number[1:] != number[:-1]) | (dim[1:] != dim[:-1]))[0] + 1
            for a, b in zip([0, *cut], [*cut, len(number)], strict=True):
                if a == b:
                    continue
                if last != (int(number[a]), int(dim[a])):
                    last, node, unit = (int(number[a]), int(dim[a])), node[:0], []
                # the rows before that still have a window to look into
                node, unit = np.concatenate([node[-window:], nodes[a:b]]), [*unit[-window:], *units[a:b]]
                x = np.frombuffer(b"".join(unit), dtype="<f8").reshape(len(node), -1)
                p, q = _links(node, *_linked(x, window, least))
                yield rows(0, *last, 0, [None] * len(p), p, q, [None] * len(p))
                if first:
                    yield border(True)
                    first = False
        if last:
            yield border(False)

    return run


def _across(window: int, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links over a border, from rows sorted by pass, dimension, border and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # at most two windows for each border dealt here
        if not held:
            return
        table = pa.Table.from_batches(held)
        keys = np.stack([table.column(c).to_numpy() for c in ("pass", "dim", "border")], axis=1)
        place, node, unit = table.column("place").to_numpy(), table.column("a").to_numpy(), table.column("unit").to_pylist()
        cut = np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1
        for a, b in zip([0, *cut], [*cut, len(node)], strict=True):
            x = np.frombuffer(b"".join(unit[a:b]), dtype="<f8").reshape(b - a, -1)
            p, q = _links(node[a:b], *_linked(x, window, least, split=int((place[a:b] < 0).sum())))
            yield pa.RecordBatch.from_pydict({"a": pa.array(p, pa.int64()), "b": pa.array(q, pa.int64())})

    return run


def _pass_links(units: DataFrame, numbers: list[int], window: int, least: float) -> DataFrame:
    order = ["pass", "dim", "key", "node"]
    keyed = units.mapInArrow(_keys(numbers), "pass int, dim int, key long, node long, unit binary")
    sorted_rows = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    found = cut_lineage(sorted_rows.mapInArrow(_windows(window, least), _FOUND))
    at_border = ["pass", "dim", "border"]
    crossing = (
        found.where("kind = 1")
        .repartition(*at_border)
        .sortWithinPartitions(*at_border, "place")
        .select(*at_border, "place", "a", "unit")
        .mapInArrow(_across(window, least), "a long, b long")
    )
    return cut_lineage(found.where("kind = 0").select("a", "b").unionByName(crossing).distinct())


def _inside(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    limit = np.sqrt((1 + least) / 2) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("unit").to_pylist(), batch.column("pivot").to_pylist()
            near = [
                len(p) == len(q) and bool(np.frombuffer(p, dtype="<f8") @ np.frombuffer(q, dtype="<f8") >= limit)
                for p, q in zip(a, b, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("component", "node", "n", "unit")], pa.array(near, pa.bool_())],
                names=["component", "node", "n", "unit", "inside"],
            )

    return run


def _block_links(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Linked vectors of each node, from rows that pair a block of the outside with a block of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                left, right = batch.column("left")[k].as_py(), batch.column("right")[k].as_py()
                p = np.frombuffer(b"".join([r["unit"] for r in left]), dtype="<f8").reshape(len(left), -1)
                q = np.frombuffer(b"".join([r["unit"] for r in right]), dtype="<f8").reshape(len(right), -1)
                a, b = np.array([r["node"] for r in left]), np.array([r["node"] for r in right])
                linked = (p @ q.T >= least) & (a[:, None] != b)
                of_left = linked @ np.array([r["n"] for r in right])
                of_right = (np.array([r["n"] for r in left]) @ linked) * np.array([r["inside"] for r in right])
                yield pa.RecordBatch.from_pydict(
                    {
                        "node": pa.array(np.concatenate([a, b]), pa.int64()),
                        "more": pa.array(np.concatenate([of_left, of_right]), pa.int64()),
                    }
                )

    return run


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    *,
    least: float = 0.95,
    passes: int = PASSES,
    window: int = WINDOW,
) -> DataFrame:
    """``id_col, n_links, component_id, kept`` of every row.

    Vectors of cosine ``least`` or more are linked. NULL, empty and zero vectors, vectors with
    a NULL or non-finite component and rows with a NULL id link with nothing; vectors of
    different length do not link. Equal vectors and repeated rows are linked with each other;
    in the passes one stands for all. A row's component is the smallest id it reaches, NULL
    without an id.

    A pair is missed if it lies further apart than the window in every pass; a pair of cosine
    0.95 shares each sign with probability 0.9. Within components nothing is missed.
    """
    spark = vectors.sparkSession

    def stored(df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(spark, f"vectors-{label}")
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = stored(rows.mapInArrow(_units, "id long, unit binary").withColumn("node", F.xxhash64("unit")), "units")
    good = rows.where("id IS NOT NULL AND unit IS NOT NULL")
    classes = stored(good.groupBy("node").agg(F.first("unit").alias("unit"), F.count("*").alias("n"), F.min("id").alias("id")), "classes")
    links = None
    for first in range(0, passes, AT_ONCE):
        found = _pass_links(classes.select("node", "unit"), list(range(first, min(passes, first + AT_ONCE))), window, least)
        links = found if links is None else links.unionByName(found)
    parts = cut_lineage(components(links))
    members = stored(parts.join(classes, "node").select("component", "node", "n", "unit"), "members")

    pivots = members.where("node = component").select("component", F.col("unit").alias("pivot"))
    placed = stored(
        members.join(pivots, "component").mapInArrow(
            _inside(least), "component long, node long, n long, unit binary, inside boolean"
        ),
        "placed",
    )
    sums = placed.groupBy("component").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("ball"),
        F.count("*").alias("size"),
        F.sum(F.when(F.col("inside"), 0).otherwise(1)).alias("out"),
    )
    sums = cut_lineage(sums)

    def blocks(which: DataFrame, count: str, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64(F.lit(name), "node"), F.ceil(F.col(count) / BLOCK))
        one = F.collect_list(F.struct("node", "n", "unit", "inside"))
        return (
            which.join(sums.where("out > 0"), "component").withColumn("block", block).groupBy("component", "block").agg(one.alias(name))
        )

    outside = blocks(placed.where(~F.col("inside")), "out", "left").select("component", "left")
    everyone = blocks(placed, "size", "right").select("component", "right")
    more = (
        outside.join(everyone, "component")
        .select("left", "right")
        .mapInArrow(_block_links(least), "node long, more long")
        .groupBy("node")
        .agg(F.sum("more").alias("more"))
    )
    counted = (
        placed.join(sums, "component")
        .join(more, "node", "left")
        .select(
            "node",
            "component",
            (F.when(F.col("inside"), F.col("ball")).otherwise(F.col("n")) - 1 + F.coalesce("more", F.lit(0))).alias("n_links"),
        )
    )
    described = classes.select("node", "n", "id").join(counted, "node", "left").select(
        "node",
        "id",
        F.coalesce("component", "node").alias("component"),
        F.coalesce("n_links", F.col("n") - 1).alias("n_links"),
    )
    described = cut_lineage(described)
    smallest = described.groupBy("component").agg(F.min("id").alias("smallest"))
    reached = described.join(smallest, "component").select("node", "n_links", "smallest")
    linked = F.col("id").isNotNull() & F.col("unit").isNotNull()
    return rows.join(reached, "node", "left").select(
        F.col("id").alias(id_col),
        F.when(linked, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
        F.when(linked, F.col("smallest")).otherwise(F.col("id")).alias("component_id"),
        F.coalesce(F.col("id") == F.when(linked, F.col("smallest")).otherwise(F.col("id")), F.lit(False)).alias("kept"),
    )
