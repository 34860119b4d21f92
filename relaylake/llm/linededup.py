"""Repeated and nearly repeated lines, by a segment-partition edit join.

Two lines within TAU edits share one of TAU + 1 segments of the shorter one, at a
place that differs by few bytes. Each line therefore puts hashes of its segments
into an index, and probes the index of every length from its own down to TAU
less with the substrings that the multi-match-aware rule leaves. Pairs that meet
are verified by a banded bit-parallel edit distance. A segment that many lines
share is not paired out: its lines meet again by a segment of what remains of
them besides the shared one, which leaves few.

Lines are compared as UTF-8 bytes, lower-cased and without white space at either
end; lines of fewer than LEAST bytes are never touched, since their segments would
be of less than 4 bytes. Lines are the same text where their 128-bit BLAKE2b
digests are equal; shorter hashes only find candidates, whose bytes are compared.

Plan: the scan emits 20 bytes for each probe, not text; keys are shuffled and
sorted once. Texts are fetched for lines that met another one only. Pairs of
distinct lines are then settled in rounds, each written to the shared folder:
lines without an earlier open neighbour stay and their neighbours go.

Defined results: lines are ordered by document id, then a hash of the text where
an id has several texts, then line number. A line goes if an equal one comes
first anywhere, or if an earlier line that itself stays is within TAU edits of
it; the line kept is the earliest such line, so every line that goes has a
surviving line within TAU edits, and in a chain of neighbours every other one
stays. Rows without id are left alone; rows that repeat an id and a text count as
one document; rows that repeat an id with another text are separate; null, empty,
one-line and very long texts are ordinary cases; an empty table gives no rows;
input columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, free_name, materialise, strings, text_batches
from .textscan import chunks, digests, lowered, mix, prefix, range_hash

TAU, LEAST = 2, 12
#: Candidate lines up to this number (8 bytes each) are looked up by a broadcast; more by a shuffled join.
BROADCAST_LINES = 2_000_000
#: Segments with more lines are split by a second segment; a task holds at most HELD rows of one.
HOT, HELD = 128, 1 << 16

_BLANK = np.zeros(256, bool)
_BLANK[[9, 11, 12, 13, 32]] = True


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, number, start, end) of every line of every text, without white space at its ends."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    text = np.searchsorted(offsets[1:], start, "right")
    # A break that ends a text begins a line that is empty and still in that text; empty texts keep one line.
    counts = np.diff(np.searchsorted(breaks, offsets)) + 1
    text = np.repeat(np.arange(n), counts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    end = np.empty(len(text), np.int64)
    start = np.empty(len(text), np.int64)
    first, last = number == 0, np.append(number[1:] == 0, True)[: len(text)]
    start[first], end[last] = offsets[:-1], offsets[1:]
    start[~first], end[~last] = breaks + 1, breaks
    if len(data):
        solid = np.flatnonzero(~_BLANK[data] & (data != 10))
        a, b = np.searchsorted(solid, start), np.searchsorted(solid, end)
        has = b > a
        start[has], end[has] = solid[a[has]], solid[b[has] - 1] + 1
        end[~has] = start[~has]
    return text, number, start, end


def segments(length: np.ndarray, tau: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start, size) of the tau + 1 even segments of lines of each length; later ones take the remainder."""
    parts = tau + 1
    small, rest = length // parts, length % parts
    return [(i * small + np.maximum(0, i - (parts - rest)), small + (i >= parts - rest)) for i in range(parts)]


def shifts(i: int, delta: int, budget: int) -> range:
    """Places, relative to segment ``i``, where a text longer by ``delta`` can hold it within ``budget`` edits."""
    return range(max(-i, delta - (budget - i)), min(i, delta + budget - i) + 1)


def probe_keys(sums: np.ndarray, start: np.ndarray, end: np.ndarray, tau: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool, int]]:
    """(key, which lines, whether it is also an index entry, how) for all segments and substrings."""
    n = end - start
    for delta in range(tau + 1):
        for i, (at, size) in enumerate(segments(n - delta, tau)):
            for shift in shifts(i, delta, tau):
                begin = at + shift
                fits = np.flatnonzero((begin >= 0) & (begin + size <= n))
                s = start[fits] + begin[fits]
                salt = ((n[fits] - delta) * (tau + 1) + i).astype(np.uint64)
                how = (delta * (tau + 1) + i) * (2 * tau + 1) + shift + tau
                yield mix(range_hash(sums, s, s + size[fits]) + salt * np.uint64(0x9E3779B97F4A7C15)), fits, delta == 0 and shift == 0, how


def second_keys(sums: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, how: int, tau: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(key, which lines, whether it can be an index entry) of lines that share the segment ``first``, met by ``how``.

    Two lines that meet by segment i are within i edits before it and tau - i after
    it, so what lies on one side is partitioned again, by its own number of edits.
    """
    place, shift = divmod(how, 2 * tau + 1)
    (delta, i), shift = divmod(place, tau + 1), shift - tau
    n = end - start
    at, size = segments(n - delta, tau)[i]
    if i == tau:
        begin, n, budget, delta = start, at + shift, tau, shift
    else:
        begin = start + at + shift + size
        n, budget, delta = end - begin, tau - i, delta - shift
    entry = how == i * (2 * tau + 1) + tau
    for j, (at, size) in enumerate(segments(n - delta, budget)):
        for move in shifts(j, delta, budget):
            fits = np.flatnonzero((n >= delta) & (at + move >= 0) & (at + move + size <= n))
            s = begin[fits] + at[fits] + move
            salt = ((n[fits] - delta) * (tau + 1) + j).astype(np.uint64)
            yield mix(mix(range_hash(sums, s, s + size[fits]) + salt * np.uint64(0x9E3779B97F4A7C15)) + first[fits]), fits, entry and move == 0


def line_names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Identity of each line's text, as two numbers; the low bit of the first is left free."""
    both = digests(data, start, end)
    return both[:, 0] & ~np.int64(1), both[:, 1]


def _scan(column: pa.Array, least: int):
    """For each run of texts: (first text, data, text, number, start, end) of the lines that count."""
    for first, _, data, offsets in chunks(lowered(strings(column))):
        text, number, start, end = lines(data, offsets)
        keep = end - start >= least
        if keep.any():
            yield first, data, text[keep], number[keep], start[keep], end[keep]


def _distinct(column: pa.Array, least: int):
    """For each run of texts: (data, h, g, start, end) of its distinct lines."""
    for _, data, _, _, start, end in _scan(column, least):
        h, g = line_names(data, start, end)
        order = np.lexsort((g, h))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(h[order]) != 0) | (np.diff(g[order]) != 0)
        once = order[new]
        yield data, h[once], g[once], start[once], end[once]


def _occurrences(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, rows = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, data, text, number, start, end in _scan(batch.column(2), least):
                h, g = line_names(data, start, end)
                at = first + text
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), pa.array(docs[at]), pa.array(rows[at]), pa.array(number)], names=["h", "g", "doc", "row", "line"])

    return run


def _keys(tau: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, h, _, start, end in _distinct(batch.column(0), least):
                for key, which, index, how in probe_keys(prefix(data), start, end, tau):
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(h[which] | int(index)), pa.array(np.full(len(which), how, np.int16))], names=["key", "h", "how"])

    return run


def _second(tau: int):
    """Keys of the second segment, from rows (first key, h with its index bit, how, line)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, h, how = (batch.column(k).to_numpy() for k in range(3))
            column = batch.column(3).cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
            start, end, sums = offsets[:-1] - offsets[0], offsets[1:] - offsets[0], prefix(data)
            for way in np.unique(how).tolist():
                own = np.flatnonzero(how == way)
                for key, which, entry in second_keys(sums, start[own], end[own], first[own].view(np.uint64), way, tau):
                    mine = h[own[which]]
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(mine if entry else mine & ~np.int64(1)), pa.array(np.zeros(len(which), np.int16))], names=["key", "h", "how"])

    return run


PAIR, HOT_ROW = -1, 0


def _meet(split: bool):
    """Pairs (a, b, -1) of lines that share a key, from rows sorted by key and line; bit 0 marks index entries.

    With ``split`` the rows (key, h, how) of a key with more than HOT lines are passed on instead.
    """
    def batch_of(a: np.ndarray, b: np.ndarray, how: np.ndarray | int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.broadcast_to(np.asarray(how, np.int16), a.shape).copy())], names=["a", "b", "how"])

    def emit(key: np.ndarray, h: np.ndarray, how: np.ndarray, hot: int | None) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        edge = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
        if split:
            big = (ends - starts > HOT) | (key[starts] == hot if hot is not None else False)
            if big.any():
                on = np.repeat(big, ends - starts)
                yield batch_of(key[on], h[on], how[on])
                yield from emit(key[~on], h[~on], how[~on], None)
                return
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1])
        key, h = key[new], h[new]
        edge = np.flatnonzero(np.diff(key)) + 1
        starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
        size = ends - starts
        two = starts[size == 2]
        x, y = h[two], h[two + 1]
        good = ((x | y) & 1 == 1) & (x >> 1 != y >> 1)
        a, b = [x[good] & ~1], [y[good] & ~1]
        for k in np.flatnonzero(size > 2):
            mine = h[starts[k] : ends[k]]
            entry = np.unique(mine[mine & 1 == 1] & ~1)
            every = np.unique(mine & ~1)
            for part in range(0, len(entry), 256):
                for other in range(0, len(every), 1 << 14):
                    p, q = np.repeat(entry[part : part + 256], len(every[other : other + (1 << 14)])), np.tile(every[other : other + (1 << 14)], len(entry[part : part + 256]))
                    apart = p != q
                    low, high = np.minimum(p[apart], q[apart]), np.maximum(p[apart], q[apart])
                    if len(low) > 4096:
                        yield batch_of(low, high, PAIR)
                    else:
                        a.append(low)
                        b.append(high)
        low, high = np.concatenate(a), np.concatenate(b)
        if len(low):
            yield batch_of(np.minimum(low, high), np.maximum(low, high), PAIR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        hot, count = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(batch.column(k).to_numpy() for k in range(3)))
            count += batch.num_rows
            if held[-1][0][-1] == held[0][0][0]:
                if split and count > HELD:  # one key so far, of many lines: nothing of it need be held
                    hot = int(held[0][0][0])
                    for rows in held:
                        yield batch_of(*rows)
                    held, count = [], 0
                continue
            rows = tuple(np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            yield from emit(*(x[:cut] for x in rows), hot)
            held = [tuple(x[cut:] for x in rows)]
            hot, count = (hot if rows[0][-1] == hot else None), len(held[0][0])
        if held:
            yield from emit(*(np.concatenate(x) for x in zip(*held, strict=True)), hot)

    return run


def banded_distance(xs: list[bytes], ys: list[bytes], tau: int) -> np.ndarray:
    """Edit distance of each pair, or tau + 1 where it is more; bit-parallel in a band, for all pairs at once.

    Column by column, the band of 2 * tau + 1 diagonals is one word of vertical
    differences (Hyyro's banded form of Myers' algorithm); pairs leave when the
    band has no value within tau left.
    """
    count = len(xs)
    nx, ny = np.array([len(x) for x in xs], np.int64), np.array([len(y) for y in ys], np.int64)
    out = np.full(count, tau + 1, np.int64)
    live = np.flatnonzero(np.abs(nx - ny) <= tau)
    if not len(live):
        return out
    # Text x lies tau bytes in, so that the window of column j starts at byte j.
    width = int(max(nx.max(), ny.max())) + 2 * tau + 2
    grid = np.full((width, count), 256, np.uint16)
    other = np.full((width, count), 257, np.uint16)
    for k, (x, y) in enumerate(zip(xs, ys, strict=True)):
        grid[tau : tau + len(x), k] = np.frombuffer(x, np.uint8)
        other[: len(y), k] = np.frombuffer(y, np.uint8)
    band = 2 * tau + 1
    top, full = np.uint64(1) << np.uint64(band - 1), np.uint64((1 << band) - 1)
    # Before the first column the differences are +1 in the rows from 1 on, which are the bits from tau on.
    vp = np.full(len(live), ((1 << band) - 1) & ~((1 << tau) - 1), np.uint64)
    vn = np.zeros(len(live), np.uint64)
    score = np.full(len(live), tau, np.int64)  # value at the bottom of the band
    one = np.uint64(1)
    grid, other = grid[:, live], other[:, live]
    for j in range(int(ny[live].max())):
        match = np.zeros(len(live), np.uint64)
        for d in range(band):
            match |= (grid[j + d] == other[j]).astype(np.uint64) << np.uint64(d)
        d0 = ((((match & vp) + vp) ^ vp) | match | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        inside = j < ny[live]
        # The bottom diagonal grows unless its cell is a match step.
        score = np.where(inside, score + ((d0 & top) == 0), score)
        x = d0 >> one
        vp, vn = np.where(inside, (hn | ~(x | hp)) & full, vp), np.where(inside, x & hp, vn)
        if j % 16 == 15:
            stay = score <= 3 * tau + 1
            if not stay.all():
                live, vp, vn, score, grid, other = live[stay], vp[stay], vn[stay], score[stay], grid[:, stay], other[:, stay]
                if not len(live):
                    return out
    # From the bottom of the band in the last column up to row len(x).
    rows = np.minimum(nx[live] - ny[live] + tau, band - 1)
    value = score.copy()
    for d in range(band - 1, 0, -1):
        up = rows < d
        bit = np.uint64(d - 1)
        value -= np.where(up, ((vp >> bit) & one).astype(np.int64) - ((vn >> bit) & one).astype(np.int64), 0)
    out[live] = np.minimum(value, tau + 1)
    return out


def _texts(wanted, least: int):
    """(h, g, line) of the lines whose h is in the sorted broadcast ``wanted``, or of all lines where it is None."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sought = None if wanted is None else wanted.value
        for batch in batches:
            for data, h, g, start, end in _distinct(batch.column(0), least):
                if sought is not None:
                    hit = sought[np.minimum(np.searchsorted(sought, h), len(sought) - 1)] == h
                    h, g, start, end = h[hit], g[hit], start[hit], end[hit]
                if len(h):
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), pa.array([data[a:b].tobytes() for a, b in zip(start, end, strict=True)], pa.binary())], names=["h", "g", "line"])

    return run


def _verify(tau: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs, ys = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            # Pairs of like length go together, in lots that keep the byte grids small.
            order = np.argsort([len(x) for x in xs], kind="stable")
            d, at = np.full(len(xs), tau + 1, np.int64), 0
            while at < len(order):
                reach, most = at, 0
                while reach < len(order) and (reach == at or (reach - at + 1) * max(most, len(xs[order[reach]])) <= 4_000_000):
                    most = max(most, len(xs[order[reach]]))
                    reach += 1
                lot = order[at:reach]
                d[lot] = banded_distance([xs[i] for i in lot], [ys[i] for i in lot], tau)
                at = reach
            out = pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(4)], pa.array(d)], names=["ah", "ag", "bh", "bg", "d"])
            yield out.filter(pa.array(d <= tau))

    return run


PAIRS = "ah bigint, ag bigint, bh bigint, bg bigint, d bigint"


def near_pairs(docs: DataFrame, text_column: str, tau: int, least: int) -> DataFrame:
    """(ah, ag, bh, bg, d): names of distinct lines within ``tau`` edits, each pair once."""
    spark = docs.sparkSession
    texts = docs.select(F.col(f"`{text_column}`").alias("text"))
    sort = lambda keys: keys.repartition("key").sortWithinPartitions("key", "h")
    met = "a bigint, b bigint, how smallint"
    first = materialise(sort(texts.mapInArrow(_keys(tau, least), "key bigint, h bigint, how smallint")).mapInArrow(_meet(True), met).distinct())
    hot, pairs = first.where(F.col("how") != PAIR), first.where(F.col("how") == PAIR).select("a", "b")
    name = F.col("b").bitwiseAND(~1)
    sought = pairs.select(F.explode(F.array("a", "b")).alias("h")).unionAll(hot.select(name.alias("h"))).distinct()
    if sought.count() <= BROADCAST_LINES:
        wanted = np.sort(sought.toArrow().column(0).to_numpy())
        if not len(wanted):
            return spark.createDataFrame([], PAIRS)
        lines_of = texts.mapInArrow(_texts(spark.sparkContext.broadcast(wanted), least), "h bigint, g bigint, line binary")
    else:
        lines_of = texts.mapInArrow(_texts(None, least), "h bigint, g bigint, line binary").join(sought, "h", "left_semi")
    lines_of = materialise(lines_of.dropDuplicates(["h", "g"]))
    if not hot.isEmpty():
        again = hot.join(lines_of.select("h", "line"), name == F.col("h")).select("a", "b", "how", "line").mapInArrow(_second(tau), "key bigint, h bigint, how smallint")
        pairs = pairs.unionAll(sort(again).mapInArrow(_meet(False), met).select("a", "b")).distinct()
    sides = [lines_of.select(F.col("h").alias(x), F.col("g").alias(f"{x}g"), F.col("line").alias(f"{x}line")) for x in ("a", "b")]
    return pairs.join(sides[0], "a").join(sides[1], "b").select("a", "ag", "b", "bg", "aline", "bline").mapInArrow(_verify(tau), PAIRS)


def settle(edges: DataFrame) -> DataFrame:
    """(hi, near.lo, near.d) for pairs (lo, hi, d): the ends that go, each with the earliest neighbour before it that stays.

    In order of the ends, one stays if no neighbour before it stays. Each round
    decides all ends that have no undecided neighbour before them.
    """
    edges = left = materialise(edges)
    gone = None
    while True:
        blocked = left.select(F.col("hi").alias("x")).distinct()
        stay = left.select(F.col("lo").alias("x")).distinct().join(blocked, "x", "left_anti")
        out = materialise(left.join(stay, F.col("lo") == F.col("x"), "left_semi").select(F.col("hi").alias("x")).distinct())
        if out.isEmpty():
            break
        gone = out if gone is None else gone.unionAll(out)
        before = left
        left = materialise(left.join(out, F.col("lo") == F.col("x"), "left_anti").join(out, F.col("hi") == F.col("x"), "left_anti"))
        if before is not edges:
            discard(before)
    if gone is not None:
        edges = edges.join(gone, F.col("lo") == F.col("x"), "left_anti")
    return edges.groupBy("hi").agg(F.min(F.struct("lo", "d")).alias("near"))


def text_key(text: Column) -> Column:
    """Tells the texts of one id apart."""
    return F.xxhash64(text)


def repeated_lines(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", tau: int = TAU, least: int = LEAST) -> DataFrame:
    """(doc_id, text_key, line_no, kept_doc_id, kept_text_key, kept_line_no, distance) of every line to remove.

    Line numbers count from 0 at line feeds; ``text_key`` tells rows apart that repeat an id.
    """
    text_batches(docs.sparkSession)
    text = F.col(f"`{text_column}`")
    docs = docs.where(F.col(f"`{id_column}`").isNotNull() & text.isNotNull())
    rows = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("doc"), text_key(text).alias("row"), text.alias("text"))
    found = materialise(rows.mapInArrow(_occurrences(least), "h bigint, g bigint, doc bigint, row bigint, line bigint"))
    place = F.struct("doc", "row", "line")
    firsts = found.groupBy("h", "g").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    of = lambda x: firsts.select(F.col("h").alias(f"{x}h"), F.col("g").alias(f"{x}g"), F.col("first").alias(f"f{x}"))
    ends = near_pairs(docs, text_column, tau, least).join(of("a"), ["ah", "ag"]).join(of("b"), ["bh", "bg"])
    before = F.col("fa") < F.col("fb")
    near = settle(ends.select(F.when(before, F.col("fa")).otherwise(F.col("fb")).alias("lo"), F.when(before, F.col("fb")).otherwise(F.col("fa")).alias("hi"), "d"))
    # Lines with one occurrence and no neighbour take no further part.
    touched = materialise(firsts.join(near, F.col("first") == F.col("hi"), "left").where("near is not null or first != last").select("h", "g", "first", "near"))
    every = found.join(touched, ["h", "g"]).where(F.col("near").isNotNull() | (place != F.col("first")))
    kept = F.coalesce(F.col("near.lo"), F.col("first"))
    return every.select(
        F.col("doc").alias("doc_id"), F.col("row").alias("text_key"), F.col("line").alias("line_no"), kept["doc"].alias("kept_doc_id"), kept["row"].alias("kept_text_key"), kept["line"].alias("kept_line_no"),
        F.coalesce(F.col("near.d"), F.lit(0)).alias("distance"),
    ).distinct()


def without_repeated_lines(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", length_column: str | None = None, tau: int = TAU, least: int = LEAST) -> DataFrame:
    """``docs`` without the repeated lines; a document that is left without any character but white space goes.

    Documents that lose no line stay as they are, null and empty ones too. ``length_column``
    names a column that gets the new length in characters where a text changes.
    """
    gone = repeated_lines(docs, id_column=id_column, text_column=text_column, tau=tau, least=least)
    doc, key, cut, short, split = (free_name(docs, x) for x in ("__doc", "__key", "__cut", "__short", "__split"))
    # Written, so that the join below can split a document that is repeated very often.
    cuts = materialise(gone.groupBy(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).agg(F.collect_set("line_no").alias(cut)))
    text = F.col(f"`{text_column}`")
    parts = F.col(split)  # a column of its own, so that it is made once for each text
    left = F.array_except(F.sequence(F.lit(0).cast("bigint"), F.size(parts).cast("bigint") - 1), F.col(cut))
    shorter = F.array_join(F.transform(left, lambda i: F.element_at(parts, (i + 1).cast("int"))), "\n")
    joined = docs.join(cuts, (F.col(f"`{id_column}`").cast("bigint") == F.col(doc)) & (text_key(text) == F.col(key)), "left")
    joined = joined.withColumn(split, F.when(F.col(cut).isNotNull(), F.split(text, "\n", -1)))
    out = joined.withColumn(short, F.when(F.col(cut).isNull(), text).otherwise(shorter)).where(F.col(cut).isNull() | F.col(short).rlike(r"\S"))
    made = {text_column.lower(): F.col(short)}
    if length_column is not None:
        made[length_column.lower()] = F.when(F.col(cut).isNull(), F.col(f"`{length_column}`")).otherwise(F.length(short).cast("bigint"))
    return out.select(*[made.get(c.lower(), F.col(f"`{c}`")).alias(c) for c in docs.columns])
