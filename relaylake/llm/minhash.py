"""Near-duplicate documents by b-bit MinHash.

The signature of a text has PERMUTATIONS minima over its word shingles. Bands of
whole minima give candidates. Of each minimum only BITS low bits are kept, packed
into 64-bit words; equal fields are counted by XOR and bit counts, and the share
that chance makes equal is taken out of the estimate.

Plan: one map over the texts makes the signatures, which are all that is written
and shuffled. Texts with equal minima, by a 128-bit digest of them, become one at
once. Band keys are shuffled with a number; only where two texts meet does the
packed signature follow. Within a bucket a search over unvisited members joins a
group of m copies in about m comparisons, and an unlike bucket is compared whole;
one above BUCKET members is compared in pairs of blocks, so that no task holds it.
A bucket passes on a spanning forest of its matches, which has the same components.

Defined results: null and empty texts, texts without a word and rows without an
id are in no group; a very long text is signed whole; rows that repeat an id and
a text are one member and do not match themselves; rows that repeat an id with
another text are members of their own, told apart by ``text_key``; the member kept
of a component is that of the smallest id, then the smallest key; an empty table
gives no rows; input columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import free_name, materialise, strings, text_batches
from .components import components
from .textscan import chunks, lowered, mix, shingles, words

#: BANDS * ROWS of the minima make the bands; all of them make the estimate, whose standard deviation is 0.04 at 0.5.
PERMUTATIONS, BITS, ROWS, BANDS, SHINGLE, THRESHOLD = 256, 2, 4, 40, 3, 0.5
#: The most members of a bucket that one task compares; block pairs of half as many beyond that.
BUCKET = 1 << 18
LANES = PERMUTATIONS * BITS // 64
LOW = sum(1 << (k * BITS) for k in range(64 // BITS))

_seeds = mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_FACTORS, _ADDENDS = (_seeds[:PERMUTATIONS] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (_seeds[PERMUTATIONS:] >> np.uint64(32)).astype(np.uint32)


def minima(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(PERMUTATIONS, texts) minima of 32-bit permuted shingle hashes; every text has a shingle."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    out, room = np.empty((PERMUTATIONS, len(starts)), np.uint32), np.empty_like(x)
    for k in range(PERMUTATIONS):
        np.multiply(x, _FACTORS[k], out=room)
        np.add(room, _ADDENDS[k], out=room)
        out[k] = np.minimum.reduceat(room, starts)
    return out


def pack(low: np.ndarray) -> np.ndarray:
    """(texts, LANES) 64-bit words of the BITS low bits of scrambled minima."""
    fields = (mix(low.astype(np.uint64)) & np.uint64((1 << BITS) - 1)).reshape(LANES, 64 // BITS, -1)
    return np.stack([reduce(np.bitwise_or, [fields[lane, k] << np.uint64(k * BITS) for k in range(64 // BITS)]) for lane in range(LANES)], 1)


def equal_fields(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal fields, along the last axis."""
    x = a ^ b
    for k in (2, 1) if BITS == 4 else (1,) if BITS == 2 else ():
        x = x | (x >> np.uint64(k))
    return PERMUTATIONS - np.bitwise_count(x & np.uint64(LOW)).sum(-1, dtype=np.int64)


def needed(threshold: float) -> int:
    """The least number of equal fields whose corrected estimate reaches ``threshold``."""
    chance = 1 / (1 << BITS)
    return int(np.ceil(PERMUTATIONS * (threshold * (1 - chance) + chance) - 1e-9))


def _signer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        for first, last, data, offsets in chunks(lowered(strings(batch.column(2)))):
            hashes, _, _, bounds = words(data, offsets)
            hashes, bounds = shingles(hashes, bounds, SHINGLE)
            have = np.flatnonzero(np.diff(bounds))
            if not len(have):
                continue
            low = minima(hashes, bounds[have])
            wide = low.astype(np.uint64)
            bands = np.zeros((len(have), BANDS), np.uint64)
            for k in range(BANDS):
                key = np.full(len(have), k, np.uint64)
                for row in range(ROWS):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + wide[k * ROWS + row])
                bands[:, k] = key
            columns = np.ascontiguousarray(low.T)
            whole = np.frombuffer(b"".join([blake2b(row.tobytes(), digest_size=16).digest() for row in columns]), np.int64).reshape(-1, 2)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(have) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[first:last][have], pa.int64()), pa.array(texts[first:last][have], pa.int64()), pa.array(whole[:, 0]), pa.array(whole[:, 1]), lists(pack(low)), lists(bands)],
                names=["id", "text_key", "whole", "again", "sig", "bands"],
            )


def _rows(docs: DataFrame, id_column: str, text_column: str) -> tuple[Column, Column]:
    return F.col(f"`{id_column}`").cast("bigint"), F.xxhash64(F.col(f"`{text_column}`"))


def signatures(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, text_key, whole, again, sig, bands) of each text that has a word."""
    key, text = _rows(docs, id_column, text_column)
    rows = docs.where(F.col(f"`{id_column}`").isNotNull()).select(key.alias("id"), text.alias("text_key"), F.col(f"`{text_column}`").alias("text"))
    return rows.mapInArrow(_signer, "id bigint, text_key bigint, whole bigint, again bigint, sig array<bigint>, bands array<bigint>")


def forest(ids: np.ndarray, sigs: np.ndarray, need: int) -> Iterator[tuple[int, np.ndarray]]:
    """Spanning forest of one bucket: (id, ids joined to it)."""
    left = np.arange(len(ids))
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            hit = equal_fields(sigs[at], sigs[left]) >= need
            if hit.any():
                yield int(ids[at]), ids[left[hit]]
                todo.extend(left[hit].tolist())
                left = left[~hit]


def _bucketer(need: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def emit(keys: np.ndarray, ids: np.ndarray, sigs: np.ndarray) -> Iterator[pa.RecordBatch]:
            edge = np.flatnonzero(np.diff(keys)) + 1
            starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(keys)]])
            size = ends - starts
            two = starts[size == 2]
            a, b = [], []
            if len(two):
                hit = two[equal_fields(sigs[two], sigs[two + 1]) >= need]
                a.append(ids[hit])
                b.append(ids[hit + 1])
            for k in np.flatnonzero(size > 2):
                for one, others in forest(ids[starts[k] : ends[k]], sigs[starts[k] : ends[k]], need):
                    a.append(np.full(len(others), one))
                    b.append(others)
            if a and sum(map(len, a)):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.int64()), pa.array(np.concatenate(b), pa.int64())], names=["a", "b"])

        def join(parts):
            return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            sigs = batch.column(2).flatten().to_numpy().view(np.uint64).reshape(-1, LANES)
            held.append((keys, batch.column(1).to_numpy(), sigs))
            if keys[-1] == held[0][0][0]:
                continue  # one bucket so far: it may go on
            keys, ids, sigs = join(held)
            cut = int(np.searchsorted(keys, keys[-1]))
            yield from emit(keys[:cut], ids[:cut], sigs[:cut])
            held = [(keys[cut:], ids[cut:], sigs[cut:])]
        if held:
            yield from emit(*join(held))

    return run


def estimate(a: Column, b: Column) -> Column:
    """The corrected similarity of two packed signatures, by bit counts in the JVM."""
    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        for k in (2, 1) if BITS == 4 else (1,) if BITS == 2 else ():
            z = z.bitwiseOR(F.shiftrightunsigned(z, k))
        return F.bit_count(z.bitwiseAND(F.lit(LOW if LOW < 1 << 63 else LOW - (1 << 64))))

    unequal = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda acc, x: acc + x)
    chance = 1 / (1 << BITS)
    return ((1 - unequal / F.lit(PERMUTATIONS)) - chance) / (1 - chance)


def _groups(signed: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, text_key, keep_id, keep_text_key, similarity) of written signatures."""
    whole = ["whole", "again"]
    # Written with its number, so that the number of a row never changes.
    firsts = signed.groupBy(*whole).agg(F.min(F.struct("id", "text_key")).alias("me"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    firsts = materialise(firsts.withColumn("node", F.monotonically_increasing_id()))
    # Most keys have one text: only (key, node) is shuffled for those, and signatures follow where texts meet.
    keyed = firsts.select(F.explode("bands").alias("key"), "node").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(BUCKET // 2)).cast("bigint")
    own = F.pmod(F.xxhash64("node"), blocks)
    other = F.explode(F.when(F.col("n") <= BUCKET, F.array(F.lit(-1).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    split = keyed.select("key", "node", own.alias("own"), other.alias("other"))
    members = split.select(F.when(F.col("other") < 0, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).alias("key"), "node")
    pairs = members.join(firsts.select("node", "sig"), "node").select("key", "node", "sig").repartition("key").sortWithinPartitions("key").mapInArrow(_bucketer(needed(threshold)), "a bigint, b bigint")
    found = components(materialise(pairs), "a", "b")
    # The least row of each component, over its nodes and the node that names it.
    placed = firsts.select("node", "me", "sig").join(found, "node", "left").select("node", "me", "sig", F.coalesce("root", "node").alias("root"))
    keep = placed.join(found.select("root").distinct(), "root", "left_semi").groupBy("root").agg(F.min(F.struct("me", "sig")).alias("keep"))
    known = placed.join(keep, "root", "left").select("node", "me", "sig", F.coalesce("keep", F.struct("me", "sig")).alias("keep"))
    # Copies of a first follow it, so the graph of the rounds held distinct texts only.
    copies = signed.select(*whole, F.struct("id", "text_key").alias("mine")).join(firsts.select(*whole, "me"), whole).where("mine != me").select("mine", "me").distinct()
    of_copies = copies.join(known.select("me", "sig", "keep"), "me").select("mine", "sig", "keep")
    out = known.where("keep.me != me").select(F.col("me").alias("mine"), "sig", "keep").unionAll(of_copies)
    return out.select(
        F.col("mine.id").alias("doc_id"), F.col("mine.text_key").alias("text_key"), F.col("keep.me.id").alias("keep_id"), F.col("keep.me.text_key").alias("keep_text_key"),
        F.round(estimate(F.col("sig"), F.col("keep.sig")), 4).alias("similarity"),
    )


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_key, keep_id, keep_text_key, similarity): each document to remove, the one kept of its group, and their estimated similarity."""
    text_batches(docs.sparkSession)
    return _groups(materialise(signatures(docs, id_column, text_column)), threshold)


def without_near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each group; of rows that repeat an id and a text with words, one stays."""
    text_batches(docs.sparkSession)
    signed = materialise(signatures(docs, id_column, text_column))
    gone = _groups(signed, threshold).select("doc_id", "text_key", F.lit(True).alias("gone"))
    often = materialise(signed.groupBy(F.col("id").alias("doc_id"), "text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "text_key"))
    doc, key, names = free_name(docs, "__doc"), free_name(docs, "__key"), [F.col(f"`{c}`") for c in docs.columns]
    key_of, text_of = _rows(docs, id_column, text_column)
    at = lambda marks: marks.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key))
    same = (key_of == F.col(doc)) & (text_of == F.col(key))
    left = docs.join(at(gone), same, "left_anti")
    if often.isEmpty():
        return left
    # Where such rows differ in other columns, any of them may stay.
    whole, rows = free_name(docs, "__row"), left.join(at(often), same, "left_semi")
    one = rows.groupBy(key_of.alias(doc), text_of.alias(key)).agg(F.first(F.struct(*names)).alias(whole)).select(f"`{whole}`.*")
    return left.join(at(often), same, "left_anti").unionAll(one)
