"""Lexical retrieval packing.

A BM25 inverted index over all documents, cut into shards, answers a query for each
seed document; the unused documents that it returns fill the seed's window in order
of score, each that still fits. Document counts, document frequencies and the mean
length are those of the whole corpus.

There are two kinds of seeds. Every document whose id is divisible by STRIDE is a
query against all shards: its NEIGHBOURS best documents over the whole corpus are
found exactly, and a document that several of these seeds return is offered to the
one that scores it highest. What room is left there, and all other documents, are
packed within placement shards, where the first unused document seeds the next
window and all unused ones of the shard are scored against it.

A document is placed by the least hash of its longer words, so documents with a
common vocabulary tend to meet; a place above twice its size in bytes is split by
a second such hash, and what copies keep together even then by a hash of the row.
Offered documents are placed with their seed.

Plan: one scan makes a narrow profile of each document, the terms of the seeds and
partial document frequencies. The seeds are broadcast in lots of LOT_BYTES of text. For
each lot, one of SAMPLE documents is searched first: the score that a seed's last
neighbour there has is reached by its last one in the corpus too. One more scan builds
an index of each run of texts and searches it for the seeds of the lot; only what
reaches those scores is shuffled, about SAMPLE * NEIGHBOURS rows for each seed however
many tasks there are. Texts move by shard once, after a join with their
places. Terms of a shard (not of a document) are shuffled for their frequencies, and
only those that two documents of the shard share. The search of the seeds is a
hundredth of all pairs and so grows faster than the table; STRIDE sets it.

Defined results: a document of more than ``window`` words is cut into pieces of
that many and a rest that is packed like other documents; no word is lost; null
and empty texts, and texts without a word, are in no window; rows without an id are
packed too and are no queries; equal scores go to the smaller id (none first), then
the earlier row; repeated rows are packed each; a document without any term in
common with the seed is no neighbour of it; the pieces of a document, put together,
are its exact text; an empty table gives no rows; input columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, strings, text_batches
from .textscan import Lookup, chunks, distinct_words, lowered, mix, words

WINDOW, SHARD_BYTES, K1, B = 4096, 16 << 20, 1.2, 0.75
#: Ids divisible by STRIDE are queries against the whole corpus, which return NEIGHBOURS documents.
STRIDE, NEIGHBOURS = 100, 32
#: Stands for a missing id while scores are ranked.
NOTHING = -(1 << 63)
#: Bytes of seed texts that are searched at once; their terms, 8 bytes each, are less.
LOT_BYTES = 48 << 20
#: Seeds searched together, and terms of more than so small a share of the documents are multiplied as a matrix.
SEEDS, COMMON = 64, 1 / 16
#: Products of single precision are this near to the sums.
ROUGH = 5e-3
#: One of SAMPLE documents is searched first, for scores that the best must reach; fewer than FEW documents are searched at once.
SAMPLE, FEW = 32, 20_000
#: Bytes of text that are indexed and searched together; a longer text by itself.
SEARCH_BYTES = 8 << 20
#: So many neighbours are ranked before the others.
HEAD = 128
#: Places of so many rows (32 bytes each) are looked up by a broadcast; more by a shuffled join.
BROADCAST_PLACES = 1_000_000

PACKED = "shard_id bigint, window_no bigint, seed_doc_id bigint, doc_ids array<bigint>, pieces array<struct<doc_id: bigint, first_word: bigint, last_word: bigint, score: double>>, n_words bigint, text string"
TERMS = "shard bigint, term bigint"
PROFILE = "id bigint, row bigint, least bigint, second bigint, size bigint, words bigint, terms array<bigint>, term bigint, n bigint"
FOUND = "seed bigint, doc bigint, doc_id bigint, score double"


def _runs(texts: pa.ChunkedArray, order: np.ndarray):
    """(place, bytes, offsets) of runs of lower-cased texts, taken in ``order`` a few at a time."""
    for at in range(0, len(order), 512):
        some = lowered(strings(texts.take(pa.array(order[at : at + 512]))))
        for first, _, data, offsets in chunks(some):
            yield at + first, data, offsets


def _pairs(texts: pa.ChunkedArray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(term hash, document, count) of each distinct pair, by document, and the documents' lengths in words.

    Documents are numbered by ``order``. Works through the texts in small runs,
    so that only distinct pairs are held.
    """
    parts, length = [], np.zeros(len(order), np.int64)
    for first, data, offsets in _runs(texts, order):
        hashes, _, _, bounds = words(data, offsets)
        length[first : first + len(offsets) - 1] = np.diff(bounds)
        some, doc, count = distinct_words(hashes, bounds)
        parts.append((some, doc + np.int32(first), count))
    joined = []
    for k, kind in enumerate((np.uint64, np.int32, np.int32)):
        joined.append(np.concatenate([np.zeros(0, kind), *[x[k] for x in parts]]))
        parts = [tuple(None if j == k else v for j, v in enumerate(x)) for x in parts]
    return *joined, length


def _shard_terms(table: pa.Table) -> pa.Table:
    """The terms that two or more documents of the shard have."""
    hashes, _, _, _ = _pairs(table.column("text"), np.arange(table.num_rows))
    terms, n = np.unique(hashes, return_counts=True)
    terms = terms[n > 1]
    return pa.table({"shard": pa.array(np.full(len(terms), table.column("shard")[0].as_py()), pa.int64()), "term": pa.array(terms.view(np.int64))})


class ShardIndex:
    """BM25 weights of the terms that two or more documents share, for searches over unused documents.

    The arrays are sorted by term. Terms of many documents are rows of a matrix as well.
    """

    def __init__(self, size: int, term: np.ndarray, doc: np.ndarray, weight: np.ndarray):
        self.size, self.terms = size, int(term.max()) + 1 if len(term) else 0
        self.term, self.doc, self.weight = term, doc, weight
        self.alive = np.arange(size)
        self._build()

    def _build(self) -> None:
        n = len(self.alive)
        df = np.bincount(self.term, minlength=self.terms)
        common = np.flatnonzero(df * 4 > n)
        self.row = np.full(self.terms, -1)
        self.row[common] = np.arange(len(common))
        self.ends, self.counts = np.cumsum(df), df
        self.matrix = np.zeros((len(common), n), np.float32)
        for k, t in enumerate(common):
            own = slice(self.ends[t] - df[t], self.ends[t])
            self.matrix[k, self.doc[own]] = self.weight[own]

    def shrink(self, used: np.ndarray) -> None:
        """Drop used documents from the lists."""
        keep = ~used[self.alive]
        place = np.cumsum(keep) - 1
        live = keep[self.doc]
        self.term, self.doc, self.weight = self.term[live], place[self.doc[live]], self.weight[live]
        self.alive = self.alive[keep]
        self._build()

    def scores(self, query: np.ndarray) -> np.ndarray:
        """Score of each document in ``alive`` for distinct terms."""
        row = self.row[query]
        out = np.zeros(len(self.alive))
        for k in row[row >= 0].tolist():
            out += self.matrix[k]
        rare = query[row < 0]
        n = self.counts[rare]
        total = int(n.sum())
        if total:
            at = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.ends[rare] - n, n)
            out += np.bincount(self.doc[at], self.weight[at], len(out))
        return out


def bm25_weights(count: np.ndarray, length: np.ndarray, df: np.ndarray, docs: int, mean: float) -> np.ndarray:
    return np.log1p((docs - df + 0.5) / (df + 0.5)) * count * (K1 + 1) / (count + K1 * (1 - B + B * length / mean))


def pack_shard(n: int, pairs: list[np.ndarray], df_terms: np.ndarray, df: np.ndarray, docs: int, mean: float, window: int, offers: list[tuple[int, list[tuple[int, float]]]]):
    """Windows of one shard of ``n`` documents, as lists of (document, first word, last word, score); documents come in order of id.

    ``pairs`` is what ``_pairs`` gives; it is emptied, to free memory early.
    ``df_terms`` has every term of two or more of the documents, and ``df`` their document counts.
    ``offers`` are seeds with the documents, best first, that are put into their windows before anything else.
    """
    hashes, doc, count, length = pairs
    pairs.clear()
    out = []
    for d in np.flatnonzero(length >= window):
        out += [[(int(d), k * window, (k + 1) * window, 0.0)] for k in range(int(length[d]) // window)]
    rest = length % window
    used = rest == 0
    if used.all():
        return out
    order = np.argsort(df_terms)
    df_terms, df = df_terms[order], df[order]
    if len(df_terms):
        keep, term = Lookup(df_terms).find(hashes)
        doc, count = doc[keep], count[keep]
        del keep
    else:
        term, doc, count = (np.zeros(0, np.int32) for _ in range(3))
    del hashes
    query_terms, query_ends = term, np.searchsorted(doc, np.arange(n + 1))
    by = np.argsort(term, kind="stable")
    term, doc, count = term[by], doc[by], count[by]
    weight = np.empty(len(term), np.float32)
    for at in range(0, len(term), 1 << 18):
        part = slice(at, at + (1 << 18))
        weight[part] = bm25_weights(count[part], length[doc[part]], df[term[part]], docs, mean)
    index = ShardIndex(n, term, doc, weight)
    offers = [(seed, given) for seed, given in offers if not used[seed]]
    used[[seed for seed, _ in offers]] = True
    index.shrink(used)
    left = len(index.alive)

    def take(made: list, d: int, score: float) -> int:
        nonlocal left
        made.append((d, int(length[d] - rest[d]), int(length[d]), score))
        used[d] = True
        left -= 1
        return int(rest[d])

    def start(seed: int) -> tuple[list, int]:
        return [(seed, int(length[seed] - rest[seed]), int(length[seed]), 0.0)], window - int(rest[seed])

    def fill(seed: int, made: list, room: int) -> None:
        if left and room:
            score = index.scores(query_terms[query_ends[seed] : query_ends[seed + 1]])
            open_ = np.flatnonzero(~used[index.alive] & (score > 0) & (rest[index.alive] <= room))
            # Alive documents are in order of id, so a stable sort breaks ties by id. The best come first; the rest is ranked only if it is needed.
            if len(open_) > 4 * HEAD:
                high = score[open_] >= np.partition(score[open_], len(open_) - HEAD)[len(open_) - HEAD]
                parts = [open_[high], open_[~high]]
            else:
                parts = [open_]
            for part in parts:
                ranked = part[np.argsort(-score[part], kind="stable")]
                need, at = rest[index.alive[ranked]], 0
                while at < len(ranked):
                    fits = need[at:] <= room
                    step = int(fits.argmax())
                    if not fits[step]:
                        break
                    at += step
                    room -= take(made, int(index.alive[ranked[at]]), float(score[ranked[at]]))
                    at += 1
                if not room:
                    break
                # Only what still fits is worth ranking.
                if part is not parts[-1]:
                    parts[-1] = parts[-1][rest[index.alive[parts[-1]]] <= room]
        out.append(made)
        if left and left * 2 < len(index.alive):
            index.shrink(used)

    begun = []
    for seed, given in offers:
        made, room = start(seed)
        for d, score in given:
            if not used[d] and rest[d] <= room:
                room -= take(made, d, score)
        begun.append((seed, made, room))
    for window_so_far in begun:
        fill(*window_so_far)
    for seed in range(n):
        if not used[seed]:
            used[seed] = True
            left -= 1
            fill(seed, *start(seed))
    return out


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, with the terms of seeds, and rows for the terms of the task with their document counts."""
    names, lists = [c.split()[0] for c in PROFILE.split(", ")], pa.list_(pa.int64())
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def counted() -> pa.RecordBatch:
        unique, place = np.unique(np.concatenate([u for u, _ in held]), return_inverse=True)
        n = np.bincount(place, np.concatenate([c for _, c in held]), len(unique)).astype(np.int64)
        none = lambda kind: pa.nulls(len(unique), kind)
        return pa.RecordBatch.from_arrays([*[none(pa.int64())] * 6, none(lists), pa.array(unique.view(np.int64)), pa.array(n)], names=names)

    for batch in batches:
        rows, seeds = batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
        least = mix(rows.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        second, count, size = mix(least.copy()), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        own: list[np.ndarray | None] = [None] * len(rows)
        terms = []
        for first, last, data, offsets in chunks(lowered(strings(batch.column(3)))):
            hashes, start, end, bounds = words(data, offsets)
            count[first:last], size[first:last] = np.diff(bounds), np.diff(offsets)
            long = end - start >= 8
            ends = np.concatenate([[0], np.cumsum(long)])[bounds]
            have = np.flatnonzero(np.diff(ends))
            if len(have):
                least[first + have] = np.minimum.reduceat(hashes[long], ends[have])
                second[first + have] = np.minimum.reduceat(mix(hashes[long] + np.uint64(0xD6E8FEB86659FD93)), ends[have])
            for d in np.flatnonzero(seeds[first:last] & (np.diff(bounds) > 0)).tolist():
                own[first + d] = np.unique(hashes[bounds[d] : bounds[d + 1]]).view(np.int64)
            terms.append(distinct_words(hashes, bounds)[0])
        held.append(np.unique(np.concatenate([np.zeros(0, np.uint64), *terms]), return_counts=True))
        none = lambda kind: pa.nulls(len(rows), kind)
        halves = [pa.array((mix(x.copy()) >> np.uint64(1)).view(np.int64)) for x in (least, second)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *halves, pa.array(size), pa.array(count), pa.array(own, lists), none(pa.int64()), none(pa.int64())], names=names)
        if sum(len(u) for u, _ in held) > 4_000_000:
            yield counted()
            held.clear()
    if held:
        yield counted()


class Lot:
    """Some seeds as queries: their rows, and their terms as places in a sorted vocabulary with document frequencies."""

    def __init__(self, rows: np.ndarray, bounds: np.ndarray, terms: np.ndarray, df_terms: np.ndarray, df: np.ndarray, docs: int, mean: float, k: int):
        self.rows, self.docs, self.mean, self.k = rows, docs, mean, k
        by = np.argsort(df_terms)
        self.vocabulary, self.df = df_terms[by], df[by]
        place = np.searchsorted(self.vocabulary, terms)
        # Common terms are columns of a matrix, the others lists.
        common = np.flatnonzero(self.df > COMMON * docs)
        self.column = np.full(len(df), -1)
        self.column[common] = np.arange(len(common))
        query = np.repeat(np.arange(len(rows)), np.diff(bounds))
        at = self.column[place]
        self.width = len(common)
        self.query, self.place = query[at >= 0].astype(np.int32), at[at >= 0].astype(np.int32)
        rare = at < 0
        self.rare, self.ends = place[rare].astype(np.int32), np.searchsorted(query[rare], np.arange(len(rows) + 1))

    @cached_property
    def ready(self) -> tuple[Lookup, np.ndarray]:
        """The vocabulary and the matrix, made once in each worker."""
        matrix = np.zeros((len(self.rows), self.width), np.float32)
        matrix[self.query, self.place] = 1
        return Lookup(self.vocabulary), matrix


def _word_runs(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, last + 1, word hashes, bounds) of runs of about SEARCH_BYTES, made of smaller ones."""
    begun, size, hashes, counts = 0, 0, [], []
    for _, last, data, offsets in chunks(lowered(texts)):
        h, _, _, bounds = words(data, offsets)
        hashes.append(h)
        counts.append(np.diff(bounds))
        size += len(data)
        if size >= SEARCH_BYTES or last == len(texts):
            yield begun, last, np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(counts))])
            begun, size, hashes, counts = last, 0, [], []


def search_lot(lot: Lot, batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]], window: int, reach: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(query, document row, document id, score) of the best ``lot.k`` documents of each query among (row, id, seed, text) batches.

    ``reach``: scores that ``lot.k`` documents of the corpus are known to have; lower ones are left out.
    """
    best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    floor = np.zeros(len(lot.rows)) if reach is None else reach.copy()
    (look, dense), pending = lot.ready, []

    def settle() -> None:
        nonlocal best
        query, doc, name, score = (np.concatenate(x) for x in zip(best, *pending, strict=True))
        pending.clear()
        order = np.lexsort((doc, name, -score, query))
        new = np.ones(len(order), bool)  # a row that is repeated counts once
        new[1:] = (np.diff(query[order]) != 0) | (np.diff(doc[order]) != 0)
        order = order[new]
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        order = order[rank < lot.k]
        best = [query[rank < lot.k], doc[order], name[order], score[order]]
        full = np.flatnonzero(np.bincount(best[0], minlength=len(floor)) >= lot.k)
        floor[full] = np.maximum(floor[full], best[3][np.searchsorted(best[0], full, "right") - 1])

    for rows, names, seeds, texts in batches:
        for first, last, hashes, bounds in _word_runs(texts):
            length, n = np.diff(bounds), last - first
            at, term = look.find(hashes)
            key = term.astype(np.int64) * n + (np.searchsorted(bounds, at, "right") - 1)
            key.sort()
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            count = np.diff(np.append(new, len(key)))
            term, doc = np.divmod(key[new], n)
            weight = bm25_weights(count, length[doc], lot.df[term], lot.docs, lot.mean)
            column = lot.column[term]
            wide = np.zeros((n, lot.width))
            wide[doc[column >= 0], column[column >= 0]] = weight[column >= 0]
            narrow = np.ascontiguousarray(wide.T, np.float32)
            size = np.bincount(term, minlength=len(lot.df))
            begin, size = (np.cumsum(size) - size)[lot.rare], size[lot.rare]
            closed = seeds[first:last] | (length % window == 0)
            again = np.ones(n, bool)  # a row that is repeated counts once
            again[np.unique(rows[first:last], return_index=True)[1]] = False
            closed |= again
            for q in range(0, len(lot.rows), SEEDS):
                queries = min(SEEDS, len(lot.rows) - q)
                low = lot.ends[q]
                met = low + np.flatnonzero(size[low : lot.ends[q + queries]])
                hits = size[met]
                total = int(hits.sum())
                if total:
                    which = np.searchsorted(lot.ends, met, "right") - 1 - q
                    place = np.arange(total) + np.repeat(begin[met] - np.cumsum(hits) + hits, hits)
                    rare = np.bincount(np.repeat(which * n, hits) + doc.take(place), weight.take(place), queries * n).reshape(queries, n)
                else:
                    rare = np.zeros((queries, n))
                rough = rare + dense[q : q + queries] @ narrow
                rough[:, closed] = 0
                least = np.maximum(floor[q : q + queries] - ROUGH, 1e-9)
                over = rough > least[:, None]
                many = np.flatnonzero(np.count_nonzero(over, 1) > 2 * lot.k)
                if len(many):
                    floor[q + many] = np.maximum(floor[q + many], np.partition(rough[many], n - lot.k, 1)[:, n - lot.k] - ROUGH)
                    over[many] = rough[many] > (floor[q + many] - ROUGH)[:, None]
                i, j = np.divmod(np.flatnonzero(over), n)
                if len(i):
                    # The product is of single precision: what may be among the best is summed again.
                    common = [np.einsum("ab,ab->a", dense[q + i[at : at + 4096]], wide[j[at : at + 4096]]) for at in range(0, len(i), 4096)]
                    score = np.round(rare[i, j] + np.concatenate(common), 4)
                    good = score > floor[q + i] - 1e-5
                    pending.append([i[good] + q, rows[first + j[good]], names[first + j[good]], score[good]])
            if sum(len(x[0]) for x in pending) > 4 * lot.k * len(lot.rows):
                settle()
    settle()
    return tuple(best)


def _searcher(shared, reach, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot = shared.value

        def given():
            for b in batches:
                yield b.column(1).to_numpy(), b.column(0).fill_null(NOTHING).to_numpy(), b.column(2).to_numpy(zero_copy_only=False), strings(b.column(3))

        query, doc, name, score = search_lot(lot, given(), window, reach and reach.value)
        if len(query):
            yield pa.RecordBatch.from_arrays([pa.array(lot.rows[query]), pa.array(doc), pa.array(name), pa.array(score)], names=["seed", "doc", "doc_id", "score"])

    return run


def _packer(window: int, docs: int, mean: float):
    def run(texts: pa.Table, frequencies: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({k: [] for k in ("shard_id", "window_no", "seed_doc_id", "doc_ids", "pieces", "n_words", "text")})
        pa.default_memory_pool().release_unused()
        shard = texts.column("shard")[0].as_py()
        order = pc.sort_indices(texts, [("id", "ascending"), ("text", "ascending")], null_placement="at_start").to_numpy()
        ids, raw = texts.column("id").take(pa.array(order)).to_pylist(), texts.column("text")
        pairs = list(_pairs(raw, order))
        length = pairs[3]
        row, seed, score = (texts.column(c).take(pa.array(order)).to_pylist() for c in ("row", "seed", "score"))
        place: dict[int, int] = {}
        for k, r in enumerate(row):
            place.setdefault(r, k)
        offers: dict[int, list[tuple[int, float]]] = {}
        for k, r in enumerate(seed):
            if r is not None:
                offers.setdefault(place[r], []).append((k, score[k]))
        given = [(k, sorted(offers[k], key=lambda x: (-x[1], x[0]))) for k in sorted(offers)]
        term, df = frequencies.column("term").to_numpy().view(np.uint64), frequencies.column("n").to_numpy()
        windows = pack_shard(len(ids), pairs, term, df, docs, mean, window, given)

        def cut(d: int, first: int, last: int) -> bytes:
            text = raw[int(order[d])].as_buffer().to_pybytes()
            if first == 0 and last == length[d]:
                return text
            starts = words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[1]
            return text[0 if first == 0 else starts[first] : len(text) if last == length[d] else starts[last]]

        def joined(some: list) -> pa.Array:
            return pa.array([b"\n\n".join(cut(*p[:3]) for p in w) for w in some], pa.binary()).cast(pa.string())

        kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64())]))
        return pa.table(
            {
                "shard_id": pa.array([shard] * len(windows), pa.int64()),
                "window_no": pa.array(range(len(windows)), pa.int64()),
                "seed_doc_id": pa.array([ids[w[0][0]] for w in windows], pa.int64()),
                "doc_ids": pa.array([[ids[p[0]] for p in w] for w in windows], pa.list_(pa.int64())),
                "pieces": pa.array([[{"doc_id": ids[d], "first_word": a, "last_word": b, "score": s} for d, a, b, s in w] for w in windows], kind),
                "n_words": pa.array([sum(p[2] - p[1] for p in w) for w in windows], pa.int64()),
                "text": pa.chunked_array([joined(windows[k : k + 32]) for k in range(0, len(windows), 32)], pa.string()),
            }
        )

    return run


def _rows(docs: DataFrame, id_column: str, text_column: str, stride: int) -> DataFrame:
    """(id, row, seed, text): ``row`` is a hash of both, ``seed`` says that the id is divisible by ``stride``."""
    key, text = F.col(f"`{id_column}`").cast("bigint"), F.col(f"`{text_column}`")
    return docs.where(text.isNotNull()).select(key.alias("id"), F.xxhash64(key, text).alias("row"), F.coalesce(key % stride == 0, F.lit(False)).alias("seed"), text.alias("text"))


def _shards(profiles: DataFrame, size: int, shard_bytes: int) -> DataFrame:
    """(row, shard) of each distinct row."""
    shards = max(1, -(-size // shard_bytes))
    rows = profiles.select("row", F.pmod("least", F.lit(shards)).alias("bucket"), "second", "size").dropDuplicates(["row"])

    def parts(df: DataFrame, by: list[str], name: str) -> DataFrame:
        heavy = df.groupBy(*by).agg(F.sum("size").alias("b")).where(F.col("b") > 2 * shard_bytes)
        return df.join(heavy.select(*by, F.ceil(F.col("b") / F.lit(shard_bytes)).cast("bigint").alias(name)), by, "left")

    rows = parts(rows, ["bucket"], "p").withColumn("sub", F.when(F.col("p").isNull(), 0).otherwise(F.pmod("second", "p")))
    rows = parts(rows, ["bucket", "sub"], "q").withColumn("part", F.when(F.col("q").isNull(), 0).otherwise(F.pmod("row", "q")))
    apart = F.when(F.col("p").isNull(), F.col("bucket")).otherwise(F.pmod(F.xxhash64("bucket", "sub", "part"), F.lit(1 << 62)) + shards)
    return rows.select("row", apart.alias("shard"))


def _neighbours(rows: DataFrame, profile: DataFrame, df: DataFrame, docs: int, mean: float, window: int, k: int) -> DataFrame:
    """(seed, seed_id, doc, doc_id, score): rows of seeds with the ``k`` best documents that are no seeds."""
    spark = rows.sparkSession
    seeds = materialise(profile.where("terms is not null").select(F.col("row").alias("seed"), F.col("id").alias("seed_id"), "terms", "size").dropDuplicates(["seed"]))
    total = seeds.agg(F.sum("size")).first()[0] or 0
    lots = int(total // LOT_BYTES) + 1
    parts, order = [], Window.partitionBy("seed").orderBy(F.desc("score"), "doc_id", "doc")

    def ranked(found: DataFrame) -> DataFrame:
        """With the place ``n`` of each document; a row that is repeated has one place."""
        return found.withColumn("n", F.dense_rank().over(order))

    for n in range(lots if total else 0):
        mine = seeds.where(F.pmod(F.xxhash64("seed"), F.lit(lots)) == n)
        got = mine.select("seed", "terms").orderBy("seed").toArrow().combine_chunks()
        if not got.num_rows:
            continue
        known = mine.select(F.explode("terms").alias("term")).distinct().join(df, "term").toArrow()
        lists = got.column("terms").combine_chunks()
        bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
        lot = Lot(got.column("seed").to_numpy(), bounds, lists.flatten().to_numpy().view(np.uint64), known.column("term").to_numpy().view(np.uint64), known.column("n").to_numpy(), docs, mean, k)
        shared, reach = spark.sparkContext.broadcast(lot), None
        if docs >= FEW:
            first = rows.where(F.pmod("row", F.lit(SAMPLE)) == 0).coalesce(2 * spark.sparkContext.defaultParallelism)
            least = ranked(first.mapInArrow(_searcher(shared, None, window), FOUND)).where(F.col("n") == k).select("seed", "score").distinct().toArrow()
            known_scores = np.zeros(len(lot.rows))
            known_scores[np.searchsorted(lot.rows, least.column("seed").to_numpy())] = least.column("score").to_numpy()
            reach = spark.sparkContext.broadcast(known_scores)
        part = rows.mapInArrow(_searcher(shared, reach, window), FOUND)
        # Written where there are more, so that one lot at a time is in memory.
        parts.append(part if lots == 1 else materialise(part))
    found = reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], FOUND)
    best = ranked(found).where(F.col("n") <= k).select("seed", "doc", "doc_id", "score").distinct()
    return best.join(seeds.select("seed", "seed_id"), "seed").select("seed", "seed_id", "doc", F.nullif("doc_id", F.lit(NOTHING)).alias("doc_id"), "score")


def _profiles(rows: DataFrame) -> tuple[DataFrame, DataFrame, int, int, float]:
    """(profile of each document, document frequencies, bytes, documents with words, their mean length)."""
    made = materialise(rows.mapInArrow(_profile, PROFILE))
    profile = made.where("term is null").drop("term", "n")
    df = materialise(made.where("term is not null").groupBy("term").agg(F.sum("n").alias("n")))
    whole = profile.agg(F.sum("size").alias("size"), F.sum("words").alias("words"), F.count_if(F.col("words") > 0).alias("docs")).first()
    return profile, df, int(whole["size"] or 0), int(whole["docs"]), (whole["words"] or 0) / max(1, whole["docs"])


def neighbours(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, stride: int = STRIDE, k: int = NEIGHBOURS) -> DataFrame:
    """(seed_id, doc_id, score): what the search over the whole corpus returns for each seed."""
    text_batches(docs.sparkSession)
    rows = _rows(docs, id_column, text_column, stride)
    profile, df, _, n, mean = _profiles(rows)
    return _neighbours(rows, profile, df, n, mean, window, k).select("seed_id", "doc_id", "score")


def pack_documents(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW, shard_bytes: int = SHARD_BYTES, stride: int = STRIDE, k: int = NEIGHBOURS) -> DataFrame:
    """Windows (shard_id, window_no, seed_doc_id, doc_ids, pieces, n_words, text) of at most ``window`` words."""
    text_batches(docs.sparkSession)
    rows = _rows(docs, id_column, text_column, stride)
    profile, df, size, n, mean = _profiles(rows)
    shards = materialise(_shards(profile, size, shard_bytes))
    found = _neighbours(rows, profile, df, n, mean, window, k)
    # A document goes to the seed that scores it highest, of equal ones to the smaller id.
    best = F.max_by(F.struct("seed", "score"), F.struct("score", -F.col("seed_id"), "seed"))
    offers = found.groupBy("doc").agg(best.alias("to")).select("doc", F.col("to.seed").alias("seed"), F.col("to.score").alias("score"))
    offers = offers.join(shards.select(F.col("row").alias("seed"), F.col("shard").alias("to")), "seed")
    places = materialise(shards.join(offers, F.col("row") == F.col("doc"), "left").select("row", F.coalesce("to", "shard").alias("shard"), "seed", "score"))
    known = F.broadcast(places) if places.count() <= BROADCAST_PLACES else places
    moved = rows.select("id", "row", "text").join(known, "row").select("shard", "id", "row", "seed", "score", "text").repartition("shard")
    terms = moved.groupBy("shard").applyInArrow(_shard_terms, TERMS)
    return moved.groupBy("shard").cogroup(terms.join(df, "term").groupBy("shard")).applyInArrow(_packer(window, n, mean), PACKED)
