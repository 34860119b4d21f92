"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are scaled to unit length, turned to principal axes and ordered by
leading dimensions into tiles. For a pair of tiles the product over the leading
dimensions is accumulated first; the rest of each product is at most the product
of the two suffix norms, so a pair stops as soon as that bound cannot reach the
threshold, and a tile pair stops when no pair of it is left. Tile pairs whose
bounding boxes lie too far apart are never formed. The search is exact, but for
cosines that lie within 1e-6 of the threshold.

Plan: products for the axes are one small aggregate; vectors that are equal bit by
bit become one, counted; tiles of TILE of them, BLOCK tiles to a block, are written
once. Boxes of blocks are joined by the cells of a grid over the leading two
dimensions, then by their distance; only tiles of blocks that lie near each other
move, once for each such pair. A pair of blocks gives one row for each vector that
has a match, with the number of matches and a link to the least of those that it is
joined with, so no list of pairs is ever held or moved.

Defined results: one row for each row of the table. ``n_links`` is the number of
other rows within the threshold, copies and rows of the same id too; ``class_id`` is
the least id of all rows that a chain of links reaches, its own id where there is no
link. Vectors of different lengths never match, each length is compared by itself. Null
vectors, empty ones, and ones with a null, infinite or NaN entry or without length
have no link. Rows without id have no link and no class. Repeated rows and rows that
repeat an id with another vector are rows of their own; ties need no rule, since
nothing is chosen; very long vectors are compared like others, but their moments,
of the square of the length, must fit the driver; an empty table gives no rows;
input columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .components import components

THRESHOLD, TILE, STEP, BLOCK = 0.95, 1024, 8, 8
#: Slack of the bounds for float32 products of unit vectors.
SLACK = 1e-5


def _unit(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are usable, their unit vectors in float64)."""
    lengths = np.array([0 if x is None else x for x in column.value_lengths().to_pylist()])
    usable = np.flatnonzero(lengths == dims)
    if not len(usable):
        return usable, np.zeros((0, dims))
    taken = column.take(pa.array(usable)).flatten()
    full = taken.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    norms = np.sqrt((full * full).sum(1))
    good = np.isfinite(norms) & (norms > 0)
    return usable[good], full[good] / norms[good, None]


def _moments(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((dims, dims)), 0
        for batch in batches:
            _, x = _unit(batch.column(0), dims)
            total += x.T @ x
            n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.ravel()], pa.list_(pa.float64()))], names=["n", "s"])

    return run


def principal_axes(vectors: DataFrame, column: str, dims: int) -> np.ndarray:
    """Axes as columns, by falling second moment of the unit vectors."""
    parts = vectors.select(F.col(f"`{column}`").cast("array<double>").alias("v")).mapInArrow(_moments(dims), "n bigint, s array<double>")
    # One row per task; sums over positions keep what reaches the driver at dims * dims numbers.
    sums = parts.select(F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()
    total = np.zeros(dims * dims)
    for r in sums:
        total[r.i] = r.x
    _, axes = np.linalg.eigh(total.reshape(dims, dims))
    return axes[:, ::-1]


def _project(axes: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _unit(batch.column(1), len(axes))
            y = x @ axes
            v: list[bytes | None] = [None] * batch.num_rows
            for k, row in zip(at.tolist(), y.astype("<f4"), strict=True):
                v[k] = row.tobytes()
            lead = np.zeros((batch.num_rows, 3))
            lead[at, : min(3, len(axes))] = y[:, :3]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(v, pa.binary()), *[pa.array(lead[:, k]) for k in range(3)]], names=["id", "v", "p0", "p1", "p2"])

    return run


def _tiles(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        done = TaskContext.get().partitionId() << 32

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal done
            table = pa.Table.from_batches(held)
            nodes, counts = table.column(0).to_numpy(), table.column(1).to_numpy()
            x = np.frombuffer(b"".join(table.column(2).to_pylist()), "<f4").reshape(-1, dims)
            for part in _split(x, np.arange(len(nodes))):
                ends = [f(x[part][:, k]) for k in range(min(STEP, dims)) for f in (np.min, np.max)]
                columns = [pa.array([done // BLOCK]), *[pa.array([y[part].astype(kind).tobytes()], pa.binary()) for y, kind in ((nodes, "<i8"), (counts, "<i8"), (x, "<f4"))], *[pa.array([float(e)]) for e in ends]]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "nodes", "counts", "vectors", *_ends(dims)])
                done += 1

        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 64 * TILE:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return run


def _ends(dims: int) -> list[str]:
    return [f"{k}{i}" for i in range(min(STEP, dims)) for k in ("low", "high")]


def _split(x: np.ndarray, part: np.ndarray) -> Iterator[np.ndarray]:
    """Halve at the median of the widest leading dimension until no part is over TILE."""
    if len(part) <= TILE:
        yield part
        return
    lead = x[part][:, :STEP]
    k = int(np.argmax(lead.max(0) - lead.min(0)))
    order = np.argsort(lead[:, k], kind="stable")
    for half in np.array_split(part[order], 2):
        yield from _split(x, half)


def tile_matches(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, cosine) of all pairs that reach the threshold."""
    dims = a.shape[1]
    fa, fb = a.astype(np.float32, copy=False), b.astype(np.float32, copy=False)
    tail = lambda x: np.sqrt(np.maximum(0, (x[:, ::-1] ** 2).cumsum(1)[:, ::-1])).astype(np.float32)
    ta, tb = tail(a), tail(b)
    lead = min(dims, 2 * STEP)
    part = fa[:, :lead] @ fb[:, :lead].T
    if lead < dims:
        i, j = np.nonzero(part + np.outer(ta[:, lead], tb[:, lead]) >= threshold - SLACK)
    else:
        i, j = np.nonzero(part >= threshold - SLACK)
    got = part[i, j]
    for at in range(lead, dims, STEP):
        if not len(i):
            break
        end = min(dims, at + STEP)
        got = got + np.einsum("ij,ij->i", fa[i, at:end], fb[j, at:end])
        stay = got >= threshold - SLACK if end == dims else got + ta[i, end] * tb[j, end] >= threshold - SLACK
        i, j, got = i[stay], j[stay], got[stay]
    exact = np.einsum("ij,ij->i", a[i].astype(np.float64), b[j].astype(np.float64))
    stay = exact >= threshold - 1e-7
    return i[stay], j[stay], exact[stay]


def unite(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels after joining the sets of u[k] and v[k]; each label is the least place of its set."""
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def _compare(dims: int, threshold: float):
    """For each vector of a pair of blocks that has a match: the number of rows it matches and a vector it is joined with."""
    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        nodes, counts = ([np.frombuffer(x, "<i8") for x in table.column(c).to_pylist()] for c in ("nodes", "counts"))
        x = [np.frombuffer(v, "<f4").reshape(-1, dims) for v in table.column("vectors").to_pylist()]
        lead = [v[:, :STEP] for v in x]
        low, high = [v.min(0) for v in lead], [v.max(0) for v in lead]
        at = np.concatenate([[0], np.cumsum([len(n) for n in nodes])])
        label, links = np.arange(at[-1]), np.zeros(at[-1], np.int64)
        same = not (side == 1).any()
        for a in np.flatnonzero(side == 0).tolist():
            for b in (range(a, len(nodes)) if same else np.flatnonzero(side == 1).tolist()):
                gap = np.maximum(0, np.maximum(low[a] - high[b], low[b] - high[a])).astype(np.float64)
                if (gap * gap).sum() > 2 - 2 * threshold + SLACK:
                    continue
                i, j, _ = tile_matches(x[a], x[b], threshold)
                if a == b:
                    i, j = i[i != j], j[i != j]
                links[at[a] : at[a + 1]] += np.bincount(i, counts[b][j], len(nodes[a])).astype(np.int64)
                if a != b:
                    links[at[b] : at[b + 1]] += np.bincount(j, counts[a][i], len(nodes[b])).astype(np.int64)
                label = unite(label, at[a] + i, at[b] + j)
        hit, every = np.flatnonzero(links), np.concatenate(nodes)
        return pa.table({"node": pa.array(every[hit], pa.int64()), "other": pa.array(every[label[hit]], pa.int64()), "links": pa.array(links[hit], pa.int64())})

    return run


def _near_blocks(tiles: DataFrame, names: list[str], threshold: float) -> DataFrame:
    """(x, y): pairs of blocks, x <= y, whose boxes lie within the distance that the threshold allows."""
    reach = 2 - 2 * threshold + SLACK  # squared distance of unit vectors that match
    width = float(np.sqrt(reach))
    boxes = materialise(tiles.groupBy("block").agg(*[(F.min if c.startswith("low") else F.max)(c).alias(c) for c in names]))

    def celled(name: str, margin: float) -> DataFrame:
        made = boxes.select(F.col("block").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in names])
        for k in range(min(2, len(names) // 2)):
            cells = F.sequence(F.floor((F.col(f"{name}_low{k}") - margin) / width), F.floor((F.col(f"{name}_high{k}") + margin) / width))
            made = made.withColumn(f"cell{k}", F.explode(cells))
        return made

    on = [f"cell{k}" for k in range(min(2, len(names) // 2))]
    gaps = [F.greatest(F.lit(0.0), F.col(f"x_low{k}") - F.col(f"y_high{k}"), F.col(f"y_low{k}") - F.col(f"x_high{k}")) for k in range(len(names) // 2)]
    met = celled("x", 0.0).join(celled("y", width * 1.001), on)
    return met.where((F.col("x") <= F.col("y")) & (sum(g * g for g in gaps) <= reach)).select("x", "y").distinct()


def _classes(rows: DataFrame, dims: int, threshold: float) -> DataFrame:
    """(vec_id, class_id, n_links) of rows (id, v) whose vectors have ``dims`` entries."""
    axes = principal_axes(rows, "v", dims) if dims > 1 else np.eye(1)
    placed = materialise(rows.mapInArrow(_project(axes), "id bigint, v binary, p0 double, p1 double, p2 double"))
    # Equal vectors become one; written with its number, so that the number never changes.
    one = placed.where("v is not null").groupBy("v").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), *[F.first(f"p{k}").alias(f"p{k}") for k in range(3)])
    one = materialise(one.withColumn("node", F.monotonically_increasing_id()))
    names = _ends(dims)
    ordered = one.repartitionByRange("p0", "p1", "p2").select("node", "n", "v")
    tiles = materialise(ordered.mapInArrow(_tiles(dims), "block bigint, nodes binary, counts binary, vectors binary, " + ", ".join(f"{c} double" for c in names)))
    pairs = materialise(_near_blocks(tiles, names, threshold))
    blocks = tiles.select("block", "nodes", "counts", "vectors")
    sides = pairs.join(blocks, F.col("x") == F.col("block")).withColumn("side", F.lit(0)).unionAll(pairs.where("x != y").join(blocks, F.col("y") == F.col("block")).withColumn("side", F.lit(1)))
    found = materialise(sides.select("x", "y", "side", "nodes", "counts", "vectors").groupBy("x", "y").applyInArrow(_compare(dims, threshold), "node bigint, other bigint, links bigint"))
    roots = components(found, "node", "other")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    whole = one.select("node", "v", "first", "n").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = whole.where("links is not null").groupBy("root").agg(F.min("first").alias("least"))
    known = whole.join(least, "root", "left").select("v", F.coalesce("least", "first").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    alone = F.coalesce("n_links", F.lit(0)).cast("bigint")
    return placed.select("id", "v").join(known, "v", "left").select(F.col("id").alias("vec_id"), F.coalesce("class_id", "id").alias("class_id"), alone.alias("n_links"))


def vector_classes(vectors: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, class_id, n_links): for each row its class of near vectors and how many rows are near it."""
    rows = vectors.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), F.col(f"`{vector_column}`").cast("array<double>").alias("v"))
    size = F.when(F.col("id").isNotNull(), F.nullif(F.size("v"), F.lit(-1))).alias("d")
    # As many rows as there are lengths of vectors.
    lengths = sorted(r.d for r in rows.select(size).where("d > 0").distinct().collect())
    none = rows.where(F.col("id").isNull() | F.col("v").isNull() | (F.size("v") == 0)).select(F.col("id").alias("vec_id"), F.col("id").alias("class_id"), F.lit(0).cast("bigint").alias("n_links"))
    return reduce(DataFrame.unionAll, [_classes(rows.where(F.col("id").isNotNull() & (F.size("v") == d)), d, threshold) for d in lengths], none)
