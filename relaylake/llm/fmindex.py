"""Benchmark decontamination with an FM-index per training shard.

Each task cuts its texts into shards of about SHARD_WORDS words. A shard becomes
a sequence of word numbers with an end mark after each text; its suffix array
gives the Burrows-Wheeler transform, kept as a wavelet matrix with rank blocks,
and a sample of suffix positions. All test phrases are searched backward at
once; occurrences are located by walking to the next sampled position, and the
spans found in a text are merged and cut out.

Plan: a map over the scan without any shuffle. The words of the items are
broadcast; a benchmark beyond PHRASE_BYTES is searched in several passes over the
texts, each written to the shared folder, so one lot at a time is held anywhere.

Defined results: case and punctuation do not matter; a test item of fewer words
than ``window`` is searched whole, one of fewer than ``least`` words is left
out, since such short phrases stand in clean texts too; items without id or text
are left out; null and empty texts never match; a very long text is a shard of
its own and is searched whole; repeated rows each get the same result; equal items
and items that repeat an id are all reported; spans that touch or overlap become
one; empty tables give no rows; input columns called like an added one give way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, materialise, strings, text_batches
from .textscan import buffers, chunks, lowered, words

SHARD_WORDS = 1_000_000
#: Bytes of benchmark text to a lot; what is broadcast of it is 8 bytes a word, and the windows are made WINDOWS at a time.
PHRASE_BYTES, WINDOWS = 16 << 20, 1 << 18
SAMPLE = 16


def suffix_array(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Suffix order of ``text``; the end marks, at ``ends``, are smaller than all else and ordered by place.

    Prefix doubling that starts from three symbols and goes on with tied suffixes only.
    """
    n = len(text)
    rank = text.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    bits = max(1, int(rank.max()).bit_length())
    step = min(n, max(1, 62 // bits))
    key = rank.copy()
    for k in range(1, step):
        key <<= bits
        key[: n - k] |= rank[k:]
    order = np.argsort(key)
    key = key[order]
    new = np.ones(n, bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = group
    tied = ~new
    tied[:-1] |= ~new[1:]
    slots = np.flatnonzero(tied)
    while len(slots):
        at = order[slots]
        key = (rank[at] << 32) | rank[np.minimum(at + step, n - 1)]
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[slots] = at
        new = np.ones(len(slots), bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        tied = ~new
        tied[:-1] |= ~new[1:]
        slots = slots[tied]
        step *= 2
    return order


class Bits:
    """A bit vector with constant-time rank: 64-bit words and the ones before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words)
        self.before = np.concatenate([[0], np.cumsum(ones, dtype=np.int64)[:-1]])
        self.zeros = len(bits) - int(ones.sum())

    def rank(self, i: np.ndarray) -> np.ndarray:
        block = i >> 6
        return self.before[block] + np.bitwise_count(self.words[block] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class FMIndex:
    """Index of the words of some texts; text i has the word hashes hashes[bounds[i]:bounds[i+1]]."""

    def __init__(self, hashes: np.ndarray, bounds: np.ndarray):
        count = np.diff(bounds)
        self.vocabulary, symbol = np.unique(hashes, return_inverse=True)
        docs = len(count)
        self.starts = bounds[:-1] + np.arange(docs)
        ends = self.starts + count
        text = np.zeros(len(hashes) + docs, np.int64)
        text[np.arange(len(hashes)) + np.repeat(np.arange(docs), count)] = symbol + 1
        order = suffix_array(text, ends)
        self.total = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(self.vocabulary) + 1))])
        left = text[order - 1].astype(np.uint32)
        sampled = (order & (SAMPLE - 1) == 0) | (left == 0)
        self.sampled, self.positions = Bits(sampled), order[sampled]
        self.depth = max(1, int(len(self.vocabulary)).bit_length())
        self.levels = []
        for level in range(self.depth - 1, -1, -1):
            ones = (left & np.uint32(1 << level)) != 0
            self.levels.append(Bits(ones))
            left = np.concatenate([left[~ones], left[ones]])

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Symbol of each word, 0 where the shard does not have it."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bits in zip(range(self.depth - 1, -1, -1), self.levels, strict=True):
            ones = bits.rank(i)
            i = np.where((symbol >> level) & 1 == 1, bits.zeros + ones, i - ones)
        return i

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of phrases (rows of symbols, right-aligned); empty where a word is missing."""
        n, width = phrases.shape
        low, high = np.zeros(n, np.int64), np.full(n, self.total[-1])
        used = np.arange(width)[None, :] >= width - lengths[:, None]
        live = np.flatnonzero(((phrases > 0) | ~used).all(1))
        dead = np.ones(n, bool)
        dead[live] = False
        for k in range(width - 1, -1, -1):
            live = live[used[live, k]]
            if not len(live):
                break
            c = phrases[live, k]
            zero = self._down(c, np.zeros(len(live), np.int64))
            low[live] = self.total[c] + self._down(c, low[live]) - zero
            high[live] = self.total[c] + self._down(c, high[live]) - zero
            lost = low[live] >= high[live]
            dead[live[lost]] = True
            live = live[~lost]
        high[dead] = low[dead]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks."""
        found, walked, at = np.zeros(len(rows), np.int64), 0, rows.copy()
        todo = np.arange(len(rows))
        while len(todo):
            here = self.sampled.get(at)
            done = todo[here]
            found[done] = self.positions[self.sampled.rank(at[here])] + walked
            todo, i = todo[~here], at[~here]
            zero, symbol = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
            for bits in self.levels:
                one, ones, zeros = bits.get(i), bits.rank(i), bits.rank(zero)
                i = np.where(one, bits.zeros + ones, i - ones)
                zero = np.where(one, bits.zeros + zeros, zero - zeros)
                symbol = symbol * 2 + one
            at = self.total[symbol] + i - zero
            walked += 1
        return found

    def occurrences(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word within all words, phrase) of every occurrence."""
        low, high = self.search(phrases, lengths)
        hits = high - low
        which = np.repeat(np.arange(len(hits)), hits)
        rows = np.arange(len(which)) - np.repeat(np.cumsum(hits) - hits, hits) + np.repeat(low, hits)
        at = self.locate(rows)
        text = np.searchsorted(self.starts, at, "right") - 1
        return text, at - text, which


def item_words(items: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, bounds, item ids) of rows (item, text): 8 bytes for each word."""
    hashes, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, _, data, offsets in chunks(lowered(strings(items.column(1)))):
        h, _, _, bounds = words(data, offsets)
        hashes.append(h)
        counts.append(np.diff(bounds))
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64), items.column(0).to_numpy().astype(np.int64)


def phrase_windows(hashes: np.ndarray, bounds: np.ndarray, ids: np.ndarray, window: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(right-aligned word hashes, lengths, item ids) of the windows of all items, WINDOWS at a time; equal ones once for each item."""
    count = np.diff(bounds)
    size = np.minimum(window, count)
    n = np.where(size >= least, count - size + 1, 0)
    item = np.repeat(np.arange(len(count)), n)
    start = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n) + bounds[:-1][item]
    for k in range(0, len(item), WINDOWS):
        which, first = item[k : k + WINDOWS], start[k : k + WINDOWS]
        place = np.arange(window)[None, :] - (window - size[which])[:, None]
        rows = np.where(place >= 0, hashes[np.maximum(first[:, None] + place, 0)], np.uint64(0))
        yield rows, size[which], ids[which]


def merged(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Union of word ranges [first, last), as sorted disjoint ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(first.tolist(), last.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _shard_spans(texts: list[pa.Array], phrases: tuple[np.ndarray, np.ndarray, np.ndarray], window: int, least: int) -> dict[int, tuple[list[tuple[int, int]], list[int]]]:
    """For each text with a match: merged byte ranges and the items found."""
    parts, size = [], 0
    for column in texts:
        for _, _, data, offsets in chunks(column):
            h, s, e, b = words(data, offsets)
            begin = np.repeat(offsets[:-1], np.diff(b))
            parts.append((h, s - begin, e - begin, b[:-1] + size))
            size += len(h)
    if not size or not len(phrases[0]):
        return {}
    hashes, start, end = (np.concatenate([p[k] for p in parts]) for k in range(3))
    bounds = np.concatenate([*[p[3] for p in parts], [size]])
    index = FMIndex(hashes, bounds)
    hits = [[np.zeros(0, np.int64)] * 4]
    for windows, lengths, ids in phrase_windows(*phrases, window, least):
        text, word, which = index.occurrences(index.symbols(windows.ravel()).reshape(windows.shape), lengths)
        hits.append([text, word, word + lengths[which], ids[which]])
    text, word, last, item = (np.concatenate(x) for x in zip(*hits, strict=True))
    by = np.argsort(text, kind="stable")
    text, word, last, item = text[by], word[by], last[by], item[by]
    out = {}
    for i in np.unique(text):
        mine = slice(np.searchsorted(text, i), np.searchsorted(text, i, "right"))
        spans = merged(word[mine], last[mine])
        out[int(i)] = ([(int(start[a]), int(end[b - 1])) for a, b in spans], sorted(set(item[mine].tolist())))
    return out


def _cut(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text without byte spans, and the spans in characters."""
    raw, kept, at, chars = text.encode(), [], 0, []
    for a, b in spans:
        kept.append(raw[at:a].decode())
        chars.append((len(raw[:a].decode()), len(raw[:b].decode())))
        at = b
    return "".join([*kept, raw[at:].decode()]), chars


def _lots(benchmark: DataFrame, item_column: str, text_column: str) -> int:
    """In how many lots of about PHRASE_BYTES the items are searched."""
    size = benchmark.where(F.col(f"`{item_column}`").isNotNull()).agg(F.sum(F.octet_length(F.col(f"`{text_column}`")).cast("bigint"))).first()[0] or 0
    return int(size // PHRASE_BYTES) + 1


def _lot(benchmark: DataFrame, item_column: str, text_column: str, k: int, lots: int) -> pa.Table:
    rows = benchmark.select(F.col(f"`{item_column}`").cast("bigint").alias("i"), F.col(f"`{text_column}`").alias("t")).where("i is not null and t is not null")
    return (rows if lots == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(lots)) == k)).toArrow()


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text_column: str = "text", item_column: str = "item_id", item_text: str = "text", window: int = 8, least: int = 5, only_hits: bool = True, added: tuple[str, str, str] = ("item_ids", "spans", "clean_text")) -> DataFrame:
    """``docs`` with the ``added`` columns: found items, spans (start and end in characters) and the text without them.

    Only texts with a match are returned, or with ``only_hits=False`` all of them.
    Input columns that are called like an added one are replaced.
    """
    text_batches(docs.sparkSession)
    gone = [c.lower() for c in added]
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in gone])
    names, hidden = list(docs.columns), free_name(docs, "__found")
    found_type = T.StructType([T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("items", T.ArrayType(T.LongType()))])
    spark = docs.sparkSession
    fields = [*docs.schema.fields]
    at = names.index(next(c for c in names if c.lower() == text_column.lower()))
    lots = _lots(benchmark, item_column, item_text)
    for k in range(lots):
        phrases = spark.sparkContext.broadcast(item_words(_lot(benchmark, item_column, item_text, k, lots)))
        search = _searcher(phrases, at, len(names), k > 0, only_hits and lots == 1, window, least, hidden)
        if k + 1 < lots:
            # Written, so that one lot of phrases at a time is in memory.
            docs = materialise(docs.mapInArrow(search, T.StructType([*fields, T.StructField(hidden, found_type)])))
            phrases.destroy()
    item_ids, spans, clean = added
    extra = [T.StructField(item_ids, T.ArrayType(T.LongType())), T.StructField(spans, T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField(clean, T.StringType())]
    cut = _cutter(at, len(names), only_hits, added)
    # The last search and the cut share a worker.
    return docs.mapInArrow(lambda batches: cut(search(batches)), T.StructType([*fields, *extra]))


def _searcher(phrases, at: int, width: int, again: bool, only_hits: bool, window: int, least: int, hidden: str):
    def flush(batches: list[pa.RecordBatch], low: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        spans, base = _shard_spans(low, phrases.value, window, least), 0
        for batch in batches:
            found = [spans.get(base + i) for i in range(batch.num_rows)]
            base += batch.num_rows
            old = batch.column(width).to_pylist() if again else [None] * batch.num_rows
            rows = []
            for new, was in zip(found, old, strict=True):
                if was is None:
                    rows.append(None if new is None else {"spans": [list(s) for s in new[0]], "items": new[1]})
                else:
                    rows.append(was if new is None else {"spans": was["spans"] + [list(s) for s in new[0]], "items": was["items"] + new[1]})
            kind = pa.struct([("spans", pa.list_(pa.list_(pa.int64()))), ("items", pa.list_(pa.int64()))])
            out = pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(width)], pa.array(rows, kind)], names=[*batch.schema.names[:width], hidden])
            if only_hits:
                out = out.filter(pa.array([r is not None for r in rows], pa.bool_()))
            if out.num_rows:
                yield out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, low, size = [], [], 0
        for whole in batches:
            sizes = np.diff(buffers(strings(whole.column(at)))[1])
            first, reach = 0, np.cumsum(sizes)
            while first < whole.num_rows:  # a batch is cut so that no shard is much over SHARD_WORDS
                limit = (reach[first - 1] if first else 0) + max(1, SHARD_WORDS * 6 - size)
                last = max(first + 1, int(np.searchsorted(reach, limit, "right")))
                batch = whole.slice(first, last - first)
                held.append(batch)
                low.append(lowered(strings(batch.column(at))))
                size += int(sizes[first:last].sum())
                first = last
                if size >= SHARD_WORDS * 6:
                    yield from flush(held, low)
                    held, low, size = [], [], 0
        if held:
            yield from flush(held, low)

    return run


def _cutter(at: int, width: int, only_hits: bool, added: tuple[str, str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, texts = batch.column(width), batch.column(at)
            if only_hits:
                keep = found.is_valid()
                batch = batch.filter(keep)
                found, texts = batch.column(width), batch.column(at)
            items, spans, clean = [None] * batch.num_rows, [None] * batch.num_rows, None
            hits = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
            if len(hits):
                clean = texts.to_pylist()
                for i in hits.tolist():
                    row = found[i].as_py()
                    joined = merged(np.array([s[0] for s in row["spans"]]), np.array([s[1] for s in row["spans"]]))
                    clean[i], cut = _cut(clean[i], joined)
                    items[i], spans[i] = sorted(set(row["items"])), [{"start": a, "end": b} for a, b in cut]
            columns = [batch.column(k) for k in range(width)]
            columns += [pa.array(items, pa.list_(pa.int64())), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), texts if clean is None else pa.array(clean, pa.string())]
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:width], *added])

    return run
