"""Similarity join of vectors in epsilon grid order.

On the unit sphere a cosine of at least c means a distance of at most
sqrt(2 - 2c), epsilon. Vectors are sorted by the cells, epsilon wide, that they take in the
leading principal dimensions, and cut into blocks. Blocks form a tree of
sequence intervals, each with its bounding box in these dimensions and in the length of
what they leave over. From the root down, pairs of intervals whose boxes are
more than epsilon apart are skipped with all below; what remains at the bottom are pairs of blocks, and
inside these, pairs of short runs. Only these are multiplied, in double precision.

Equal vectors are one vector with a count. A pair of blocks gives each vector's
number of links and a spanning forest of the links, not the links, so that output
grows with the vectors of a block and not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import hashed_sample, written
from .components import components

COSINE = 0.98
#: About so many vectors, by a hash, give the principal dimensions; these steer the order only.
FIT_ROWS = 5000
DIMENSIONS, CELLS = 8, 5
BLOCK, RUN, FAN = 1024, 64, 8
#: Keeps rounding from skipping a pair at the very threshold.
SLACK = 1e-9

BLOCKS = (
    "label long, size int, part long, place long, ids array<long>, copies array<long>, vectors binary, spots binary,"
    " low array<double>, high array<double>"
)


def _usable(vectors: DataFrame) -> DataFrame:
    """Vectors that may link, with a 128-bit hash."""
    e = F.col("embedding")
    fine = ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))) & F.exists(e, lambda x: x != 0)
    return vectors.select(
        F.col("vec_id").cast("long"), F.col("label").cast("long").alias("label"), e.cast("array<double>").alias("embedding")
    ).filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull() & fine).withColumns(
        {"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), "embedding")}
    )


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    raw = raw / np.abs(raw).max(1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(1, keepdims=True))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return unit(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size))


def principal(rows: DataFrame) -> dict[int, np.ndarray]:
    """By vector length, the leading principal directions of a bounded sample, as columns."""
    sample = hashed_sample(rows, FIT_ROWS, "h1").select("embedding").toArrow()["embedding"]
    sizes: dict[int, list] = {}
    for v in sample.to_pylist():
        sizes.setdefault(len(v), []).append(v)
    out = {}
    for size, vectors in sizes.items():
        x = unit(np.array(vectors))
        out[size] = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][:DIMENSIONS].T
    return out


def _blocks(reps: DataFrame, axes: dict[int, np.ndarray], epsilon: float) -> DataFrame:
    def axis(size: int) -> np.ndarray:
        return axes[size] if size in axes else np.eye(size, min(size, DIMENSIONS))

    def spot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x) for x in batch["embedding"]])
            for size in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                cells = np.floor(_matrix(part["embedding"], size) @ axis(size)[:, :CELLS] / epsilon).astype(np.int32)
                cell = pa.array(list(cells), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, cell], [*part.schema.names, "cell"])

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            nonlocal held, place
            label, size = held[0][0], held[0][1]
            x = np.concatenate([h[4] for h in held])
            near = x @ axis(size)
            rest = np.sqrt(np.maximum((x * x).sum(1) - (near * near).sum(1), 0))
            spots = np.column_stack([near, rest])
            values = [
                [label], [size], [part], [place], [np.concatenate([h[2] for h in held])], [np.concatenate([h[3] for h in held])],
                [x.tobytes()], [spots.tobytes()], [spots.min(0)], [spots.max(0)],
            ]
            held, place = [], place + 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(values, kinds, strict=True)], [f.split()[0] for f in BLOCKS.split(", ")]
            )

        for batch in batches:
            labels, ids, copies = (batch[k].to_numpy() for k in ("label", "id", "copies"))
            sizes = np.array([len(x) for x in batch["embedding"]], np.int64)
            change = np.flatnonzero((np.diff(labels) != 0) | (np.diff(sizes) != 0)) + 1
            edges = [0, *change.tolist(), len(labels)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                x = _matrix(batch["embedding"].slice(a, b - a), int(sizes[a]))
                while a < b:
                    if held and (held[0][0], held[0][1]) != (labels[a], sizes[a]):
                        yield close()
                    n = min(b - a, BLOCK - sum(len(h[2]) for h in held))
                    held.append((int(labels[a]), int(sizes[a]), ids[a : a + n], copies[a : a + n], x[len(x) - (b - a) :][:n]))
                    a += n
                    if sum(len(h[2]) for h in held) == BLOCK:
                        yield close()
        if held:
            yield close()

    cells = reps.select("label", "id", "copies", "embedding").mapInArrow(
        spot, "label long, id long, copies long, embedding array<double>, cell array<int>"
    )
    order = ["label", F.size("embedding"), "cell", "id"]
    return cells.repartitionByRange(*order).sortWithinPartitions(*order).drop("cell").mapInArrow(block, BLOCKS)


def _candidates(blocks: DataFrame, epsilon: float) -> DataFrame:
    """Pairs of blocks (one, two: part and place) that may hold a link, from the root of the interval tree down."""
    leaves = written(blocks.select("label", "size", "part", "place", "low", "high"), "block-boxes")
    top = leaves.agg(F.max("part"), F.max("place")).first()
    parts, places = (top[0] or 0) + 1, (top[1] or 0) + 1
    # An interval is (part div FAN^i, place div FAN^j): first the parts split, then the places inside one.
    steps, up = [(0, 0)], 1
    while FAN**up < places * FAN:
        steps.append((0, up))
        up += 1
    down = 1
    while FAN**down < parts * FAN:
        steps.append((down, up - 1))
        down += 1

    def level(i: int, j: int) -> DataFrame:
        keys = [F.expr(f"part div {FAN**i}").alias("p"), F.expr(f"place div {FAN**j}").alias("q")]
        box = leaves.select("label", "size", *keys, F.posexplode(F.arrays_zip("low", "high")).alias("d", "b"))
        sides = box.groupBy("label", "size", "p", "q", "d").agg(F.min("b.low").alias("low"), F.max("b.high").alias("high"))
        return sides.groupBy("label", "size", "p", "q").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("d", "low", "high"))), lambda s: F.struct(s["low"].alias("low"), s["high"].alias("high"))).alias("box")
        )

    i, j = steps[-1]
    nodes = level(i, j).select("label", "size", F.col("p").alias("p1"), F.col("q").alias("q1"))
    # The topmost interval is one for each label and size.
    pairs = nodes.withColumns({"p2": F.col("p1"), "q2": F.col("q1")})
    for (pi, pj), (i, j) in zip(reversed(steps), list(reversed(steps))[1:], strict=False):
        child = level(i, j).withColumns(
            {"up": F.expr(f"p div {FAN ** (pi - i)}"), "uq": F.expr(f"q div {FAN ** (pj - j)}")}
        )
        one = child.toDF("label", "size", "c1", "d1", "box1", "p1", "q1")
        two = child.toDF("label", "size", "c2", "d2", "box2", "p2", "q2")
        gap = F.aggregate(
            F.zip_with("box1", "box2", lambda a, b: F.greatest(F.lit(0.0), a["low"] - b["high"], b["low"] - a["high"])),
            F.lit(0.0), lambda s, g: s + g * g,
        )
        in_order = (F.col("c1") < F.col("c2")) | ((F.col("c1") == F.col("c2")) & (F.col("d1") <= F.col("d2")))
        pairs = (
            pairs.join(one, ["label", "size", "p1", "q1"])
            .join(two, ["label", "size", "p2", "q2"])
            .filter(in_order & (gap <= epsilon * epsilon + SLACK))
            .select("label", "size", F.col("c1").alias("p1"), F.col("d1").alias("q1"), F.col("c2").alias("p2"), F.col("d2").alias("q2"))
        )
    return pairs.select("label", "size", "p1", "q1", "p2", "q2")


def _forest(mask: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the masked pairs of ids connect: each id with the least of its component."""
    rows, columns = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    mask, one, two = mask[np.ix_(rows, columns)], one[rows], two[columns]
    top = np.iinfo(np.int64).max
    a, b = one.copy(), two.copy()
    while True:
        new_a = np.minimum(a, np.where(mask, b, top).min(1))
        new_b = np.minimum(b, np.where(mask.T, new_a, top).min(1))
        if (new_a == a).all() and (new_b == b).all():
            break
        a, b = new_a, new_b
    return np.concatenate([one, two]), np.concatenate([a, b])


def join_blocks(x: np.ndarray, xs: np.ndarray, y: np.ndarray, ys: np.ndarray, cosine: float, epsilon: float) -> np.ndarray:
    """Which rows of x and y link. Runs whose boxes (of xs, ys) are too far apart are not multiplied."""
    a, b = np.arange(0, len(x), RUN), np.arange(0, len(y), RUN)
    low_x, high_x = np.minimum.reduceat(xs, a), np.maximum.reduceat(xs, a)
    low_y, high_y = np.minimum.reduceat(ys, b), np.maximum.reduceat(ys, b)
    gap = np.maximum(0, np.maximum(low_x[:, None] - high_y, low_y - high_x[:, None]))
    near = (gap * gap).sum(2) <= epsilon * epsilon + SLACK
    out = np.zeros((len(x), len(y)), bool)
    of = np.repeat(np.arange(len(b)), RUN)[: len(y)]
    for i, start in enumerate(a):
        columns = np.flatnonzero(near[i][of])
        if len(columns):
            rows = slice(start, start + RUN)
            out[rows, columns] = x[rows] @ y[columns].T >= cosine
    return out


def vector_links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector (vec_id, embedding, label).

    Vectors link when their labels are equal and their cosine is at least ``cosine``.
    A vector that is null, empty or zero, holds a null or non-finite component, or has no
    label or vec_id links with nothing; vectors of different lengths do not link. Rows that repeat a
    vec_id are compared each; their links all count for that vec_id's component, and of different
    vectors with one smallest vec_id the larger number of links is given. Further columns are ignored.
    """
    epsilon = float(np.sqrt(2 - 2 * cosine))
    usable = _usable(vectors)
    key = ["label", "h1", "h2"]
    reps = written(
        usable.groupBy(*key).agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")),
        "vectors",
    )
    blocks = written(_blocks(reps, principal(reps), epsilon), "blocks")
    pairs = written(_candidates(blocks, epsilon), "block-pairs")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x, y = (np.frombuffer(row[k], float).reshape(-1, row["size"]) for k in ("v1", "v2"))
                xs, ys = (np.frombuffer(row[k], float).reshape(len(v), -1) for k, v in (("s1", x), ("s2", y)))
                mask = join_blocks(x, xs, y, ys, cosine, epsilon)
                one, two = np.array(row["i1"], np.int64), np.array(row["i2"], np.int64)
                m1, m2 = np.array(row["n1"], np.int64), np.array(row["n2"], np.int64)
                same = (row["p1"], row["q1"]) == (row["p2"], row["q2"])
                if same:
                    mask |= mask.T
                    np.fill_diagonal(mask, False)
                if not mask.any():
                    continue
                at1, at2 = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
                ids, n = one[at1], mask[at1] @ m2
                block, slot = np.full(len(at1), row["p1"] << 24 | row["q1"]), at1
                if not same:
                    ids, n = np.append(ids, two[at2]), np.append(n, m1 @ mask[:, at2])
                    block = np.append(block, np.full(len(at2), row["p2"] << 24 | row["q2"]))
                    slot = np.append(slot, at2)
                a, b = _forest(mask, one, two)
                none = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([pa.array(ids), pa.array(a)]), pa.concat_arrays([pa.array(block * BLOCK + slot), none]),
                        pa.concat_arrays([pa.array(n.astype(np.int64)), none]),
                        pa.concat_arrays([pa.nulls(len(ids), pa.int64()), pa.array(b)]),
                    ],
                    ["id", "slot", "n", "other"],
                )

    data = {"ids": "i", "copies": "n", "vectors": "v", "spots": "s"}
    sides = [
        blocks.select(F.col("part").alias(f"p{k}"), F.col("place").alias(f"q{k}"), *(F.col(c).alias(f"{n}{k}") for c, n in data.items()))
        for k in (1, 2)
    ]
    joined = pairs.join(sides[0], ["p1", "q1"]).join(sides[1], ["p2", "q2"])
    found = written(joined.mapInArrow(verify, "id long, slot long, n long, other long"), "vector-links")
    counts = found.filter("n is not null").groupBy("slot", "id").agg(F.sum("n").alias("n"))
    # A block of one label holds an id once, unless its vec_id repeats.
    counts = counts.groupBy("id").agg(F.max("n").alias("n"))
    classes = components(found.filter("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    known = reps.select(*key, "id", "copies").join(counts, "id", "left").join(classes, "id", "left")
    known = known.select(
        *key, (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component_id", "id").alias("c")
    )
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    hashed = every.select(
        "vec_id", "label", F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")
    )
    # Unusable vectors have no equal among the usable; those without id must not inherit links either.
    out = hashed.join(known, key, "left")
    links = F.when(F.col("vec_id").isNotNull(), F.col("n"))
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("c", "vec_id"))
    return out.select(
        "vec_id", F.coalesce(links, F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )
