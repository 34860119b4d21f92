"""Hilbert-curve sharding.

Each row's metadata is quantised to a cell per dimension, the cells become an
index on a Hilbert curve, and the rows in curve order are cut into runs of a
given number of bytes. Rows of one run are close in every dimension, so the
minimum and maximum that a run keeps of each column prune it for filters on any
of them.

Plan: the statistics are small aggregates; one shuffle moves the rows, by range of
the index. The number of bytes before each cell of the curve comes from an aggregate
of at most 2**COARSE_BITS cells, and a cell of more than CELL_BYTES is cut by ranges
of its ids into as many parts as that takes, so neither a running total over the
data nor a sort of one crowded cell falls to a single task.

Defined results: a null metadata value lies in cell 0; rows with equal cells are
ordered by id (none first), then by text; identical rows may swap places; a null or
empty text counts 0 bytes; a text longer than a run has a run of its own or ends
one, and is never cut; an empty table gives an empty table; input columns that are
called like an added one are replaced, others may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, replace_columns

#: The running totals are of so many cells at most (24 bytes each, broadcast), and of the parts of crowded ones.
COARSE_BITS, CELL_BYTES = 20, 256 << 20
#: Dictionaries of at most so many values are broadcast; larger ones are joined by a shuffle.
BROADCAST_VALUES = 100_000


@lru_cache
def curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """(digit, next state) for state * 2**dims + cell digit.

    A state is entry corner * dims + direction, as in Hamilton's description of
    compact Hilbert indices.
    """
    size = 1 << dims
    full = size - 1
    rotl = lambda x, k: ((x << k % dims) | (x >> (dims - k % dims))) & full if k % dims else x
    digit, following = [], []
    for state in range(size * dims):
        entry, direction = divmod(state, dims)
        for cell in range(size):
            g = rotl(cell ^ entry, dims - (direction + 1) % dims)
            w, shift = g, g >> 1
            while shift:
                w ^= shift
                shift >>= 1
            gray = (2 * ((w - 1) // 2)) if w else 0
            corner = gray ^ (gray >> 1)
            if w == 0:
                step = 0
            else:
                x = w if w & 1 else w - 1
                step = (len(bin(x)) - len(bin(x).rstrip("1"))) % dims
            digit.append(w)
            following.append((entry ^ rotl(corner, direction + 1)) * dims + (direction + step + 1) % dims)
    return digit, following


def curve_index(cells: list[Column], bits: int) -> Column:
    """The index of a cell on the curve: ``bits`` steps of a table-driven automaton."""
    dims = len(cells)
    digit, following = (F.array(*[F.lit(x) for x in t]) for t in curve_tables(dims))
    state, index = F.lit(0), F.lit(0).cast("bigint")
    for level in range(bits - 1, -1, -1):
        corner = reduce(lambda a, b: a + b, [F.shiftleft(F.shiftright(c, level).bitwiseAND(1), d) for d, c in enumerate(cells)])
        at = state * (1 << dims) + corner + 1
        index = index * (1 << dims) + F.element_at(digit, at)
        state = F.element_at(following, at)
    return index


@dataclass(frozen=True)
class Dim:
    """One dimension: ``kind`` is "depth" (values in order, equal rows a cell), "log" or "width"."""

    column: str
    kind: str


def _cells(df: DataFrame, dims: list[Dim], bits: int) -> tuple[DataFrame, list[str]]:
    size, names = 1 << bits, []
    widths = [d.column for d in dims if d.kind == "width"]
    if widths:
        ends = df.agg(*[f(F.col(f"`{c}`").cast("bigint")).alias(f"{c}{k}") for c in widths for k, f in (("<", F.min), (">", F.max))]).first()
    for i, d in enumerate(dims):
        col, name = F.col(f"`{d.column}`"), free_name(df, f"__cell{i}")
        if d.kind == "depth":
            key, before = free_name(df, f"__key{i}"), Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
            ranks = df.where(col.isNotNull()).groupBy(col.alias("v")).agg(F.count(F.lit(1)).alias("n"))
            ranks = ranks.select(F.col("v").alias(key), "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("b"), F.sum("n").over(Window.partitionBy()).alias("t"))
            ranks = ranks.select(key, F.expr(f"cast(b * {size} div t as int)").alias(name))
            small = df.agg(F.approx_count_distinct(col, 0.05)).first()[0] <= BROADCAST_VALUES
            df = df.join(F.broadcast(ranks) if small else ranks, col == F.col(key), "left").drop(key).withColumn(name, F.coalesce(name, F.lit(0)))
        elif d.kind == "log":
            v = F.greatest(col.cast("bigint"), F.lit(1))
            e = F.length(F.bin(v)) - 1
            half = F.when(e == 0, 0).otherwise(F.substring(F.bin(v), 2, 1).cast("int"))
            df = df.withColumn(name, F.least(F.coalesce(2 * e + half, F.lit(0)), F.lit(size - 1)).cast("int"))
        else:
            low, high = ends[f"{d.column}<"], ends[f"{d.column}>"]
            width = 1 if low is None else (high - low) // size + 1
            df = df.withColumn(name, F.coalesce(F.expr(f"cast((cast(`{d.column}` as decimal(20,0)) - {low or 0}) div {width} as int)"), F.lit(0)))
        names.append(name)
    return df, names


def hilbert_shards(df: DataFrame, dims: list[Dim], *, id_column: str, payload: str, bits: int = 5, target_bytes: int = 128 << 20, cell_bytes: int = CELL_BYTES) -> DataFrame:
    """``df`` in curve order with ``hilbert_index`` and ``shard_id`` (0, 1, ... along the curve)."""
    df = replace_columns(df)
    keep = [c for c in df.columns if c.lower() not in ("hilbert_index", "shard_id")]
    df = df.select(*[F.col(f"`{c}`") for c in keep])
    full, cells = _cells(df, dims, bits)
    index, coarse, part, size, offset, run, low, width = (free_name(full, x) for x in ("__index", "__coarse", "__part", "__bytes", "__offset", "__run", "__low", "__width"))
    shift = max(0, bits * len(dims) - COARSE_BITS)
    full = full.withColumn(index, curve_index([F.col(c) for c in cells], bits)).withColumn(coarse, F.shiftright(index, shift))
    full = full.withColumn(size, F.coalesce(F.octet_length(F.col(f"`{payload}`")), F.lit(0)).cast("bigint")).drop(*cells)
    # Inside a cell of one index rows are in order of id, so ranges of the id keep it. Doubles do: they only have to rise with the id.
    place = F.col(f"`{id_column}`").try_cast("double") if shift == 0 else F.lit(None).cast("double")
    crowded = full.groupBy(coarse).agg(F.sum(size).alias("b"), F.min(place).alias(low), F.max(place).alias("high")).where((F.col("b") > cell_bytes) & (F.col("high") > F.col(low)))
    # At most total bytes / cell_bytes rows.
    crowded = crowded.select(coarse, low, ((F.col("high") - F.col(low)) / F.ceil(F.col("b") / F.lit(cell_bytes))).alias(width))
    full = full.join(F.broadcast(crowded), coarse, "left").withColumn(part, F.coalesce(F.floor((place - F.col(low)) / F.col(width)), F.lit(-1))).drop(low, width)
    sums = full.groupBy(coarse, part).agg(F.sum(size).alias("b"))
    before = Window.orderBy(coarse, part).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(coarse, part, F.coalesce(F.sum("b").over(before), F.lit(0)).alias(offset))
    inside = Window.partitionBy(coarse, part).orderBy(index, f"`{id_column}`", f"`{payload}`").rowsBetween(Window.unboundedPreceding, -1)
    moved = full.repartitionByRange(F.col(coarse), F.col(part)).withColumn(run, F.coalesce(F.sum(size).over(inside), F.lit(0)))
    moved = moved.join(F.broadcast(sums), [coarse, part])
    return moved.select(*[F.col(f"`{c}`") for c in keep], F.col(index).alias("hilbert_index"), F.expr(f"(`{offset}` + `{run}`) div {target_bytes}").alias("shard_id"))


def shard_manifest(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """One row per run: row count and the minimum and maximum of each column, for pruning."""
    ends = [f(F.col(f"`{c}`")).alias(f"{k}_{c}") for c in columns for k, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n_rows"), F.min("hilbert_index").alias("first_index"), F.max("hilbert_index").alias("last_index"), *ends)


def prune(manifest: DataFrame, **ranges) -> DataFrame:
    """Runs that can hold a row with every named column in its (low, high) range; None leaves a side open."""
    for column, (low, high) in ranges.items():
        if low is not None:
            manifest = manifest.where(F.col(f"max_{column}") >= F.lit(low))
        if high is not None:
            manifest = manifest.where(F.col(f"min_{column}") <= F.lit(high))
    return manifest
