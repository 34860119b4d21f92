"""Vector pairs, MinHash groups, line pairs, the FM-index and packing, against brute force."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import awkward, frame, prose, words_of
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as fn

from relaylake.llm import components, embeddings, fmindex, linededup, minhash, packing, textscan
from relaylake.llm.common import strings


def test_words_and_lines_equal_plain_python():
    rng = random.Random(3)
    texts = ["", "a", " a b ", "É é-x\nß", "\n", "a\n\nb \n", prose(rng, 500), "İx", "x" * 2_000_000]
    low = textscan.lowered(strings(pa.array(texts)))
    seen = {}
    for first, last, data, offsets in textscan.chunks(low):
        hashes, start, end, bounds = textscan.words(data, offsets)
        for i in range(last - first):
            mine = [data[a:b].tobytes() for a, b in zip(start[bounds[i] : bounds[i + 1]], end[bounds[i] : bounds[i + 1]], strict=True)]
            if "İ" not in texts[first + i]:
                assert [m.decode() for m in mine] == words_of(texts[first + i])
            for m, h in zip(mine, hashes[bounds[i] : bounds[i + 1]].tolist(), strict=True):
                assert seen.setdefault(m, h) == h
        text, number, start, end = linededup.lines(data, offsets)
        for i in range(last - first):
            got = [data[a:b].tobytes().decode().strip() for a, b in zip(start[text == i], end[text == i], strict=True)]
            assert got == [x.strip() for x in low[first + i].as_py().split("\n")]
    assert len(set(seen.values())) == len(seen)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v) for i, v in rows], "vec_id bigint, embedding array<float>")


def plain_classes(rows, threshold=0.95):
    """[(id, class, links)] of every row, by all pairs."""
    unit = []
    for i, v in rows:
        x = None if i is None or not v or any(e is None for e in v) else np.array(v, np.float32).astype(float)
        norm = 0.0 if x is None else math.sqrt((x * x).sum())
        unit.append(x / norm if norm > 0 and math.isfinite(norm) else None)
    near = [[k for k, y in enumerate(unit) if k != n and x is not None and y is not None and len(x) == len(y) and x @ y >= threshold] for n, x in enumerate(unit)]
    out = []
    for n, (i, _) in enumerate(rows):
        seen, todo = {n}, [n]
        while todo:
            for k in near[todo.pop()]:
                if k not in seen:
                    seen.add(k)
                    todo.append(k)
        out.append((i, None if i is None else min(rows[k][0] for k in seen), len(near[n])))
    return Counter(out)


def classes(df):
    return Counter(map(tuple, embeddings.vector_classes(df).collect()))


@pytest.mark.parametrize("tile", [7, 1024])
def test_vector_classes_equal_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(embeddings, "TILE", tile)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 24))
    x = np.concatenate([base, base[:20] + 0.15 * rng.normal(size=(20, 24)), base[:20] - 0.15 * rng.normal(size=(20, 24)), base[:5], base[:5], base[:1], base[:1], 3 * base[:3]])
    rows = [(int(i), r.tolist()) for i, r in zip(rng.integers(0, 90, len(x)), x, strict=True)]
    rows += [(200 + k, r[:7].tolist()) for k, r in enumerate(base[:5])] + [(300 + k, r[:7].tolist()) for k, r in enumerate(base[:5])]
    want = plain_classes(rows)
    assert sum(links > 0 for _, _, links in want) > 30
    assert classes(vectors(spark, rows).withColumn("id", fn.lit(1)).withColumn("v", fn.lit(2)).repartition(3)) == want


def test_vector_classes_follow_sql(spark):
    import duckdb

    from relaylake.llm import oracles

    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 16)).astype(np.float32)
    x = np.concatenate([base, base[:15] + 0.1 * rng.normal(size=(15, 16)).astype(np.float32), base[:4]])
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(90, None), (91, [0.0] * 16), (None, base[0].tolist())]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert classes(vectors(spark, rows)) == Counter(con.execute(oracles.NEAR_VECTORS).fetchall()) == plain_classes(rows)


def test_a_hub_joins_its_class(spark):
    turned = lambda degrees: [math.cos(math.radians(degrees)), math.sin(math.radians(degrees)), 0.0]
    rows = [(1, turned(0)), (2, turned(30)), (3, turned(15))]
    assert classes(vectors(spark, rows)) == Counter([(1, 1, 1), (2, 1, 1), (3, 1, 2)])
    hot = [(5, [1.0, 1.0])] + [(k, [2.0, 1.0, 0.0, 1.0]) for k in range(10, 300)] + [(4, [1.0, 1.0])]
    assert classes(vectors(spark, hot)) == Counter([(5, 4, 1), (4, 4, 1)] + [(k, 10, 289) for k in range(10, 300)])
    # Rows that repeat an id with other vectors are compared each.
    assert classes(vectors(spark, [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.01, 0.0]), (2, [0.0, 1.0, 0.0])])) == Counter([(1, 1, 1), (2, 1, 1), (2, 2, 0)])


def test_vector_classes_of_awkward_rows(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    rows = [(1, v), (2, v), (2, v), (3, None), (4, []), (5, [0.0] * 4), (6, [float("nan")] * 4), (7, [1.0, 2.0]), (None, v), (8, [float("inf"), 1.0, 1.0, 1.0]), (9, [-1.0, 5.0, 0.0, 0.0]), (10, [2.0]), (11, [1.0]), (12, [1.0, None]), (13, [1.0] * 900)]
    assert classes(vectors(spark, rows)) == plain_classes(rows)
    assert embeddings.vector_classes(vectors(spark, [])).collect() == []


def test_estimates_follow_jaccard():
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    errors = []
    for share in (0.0, 0.02, 0.1, 0.3, 1.0):
        other = [w if rng.random() > share else f"v{rng.randrange(10**6)}" for w in base]
        sets = [set(zip(t, t[1:], t[2:])) for t in (base, other)]
        low = textscan.lowered(strings(pa.array([" ".join(base), " ".join(other)])))
        hashes, _, _, bounds = textscan.words(*textscan.buffers(low))
        hashes, bounds = textscan.shingles(hashes, bounds, 3)
        assert list(np.diff(bounds)) == [398, 398]
        packed = minhash.pack(minhash.minima(hashes, bounds[:-1]))
        same = minhash.equal_fields(packed[0], packed[1]) / minhash.PERMUTATIONS
        chance = 1 / (1 << minhash.BITS)
        errors.append((same - chance) / (1 - chance) - len(sets[0] & sets[1]) / len(sets[0] | sets[1]))
    assert max(map(abs, errors)) < 0.15


def test_minhash_groups(spark):
    rng = random.Random(6)
    rows, want, key = [], {}, 0
    for g in range(40):
        text = prose(rng, 120, 4000).split(" ")
        first = key
        for c in range(rng.choice([1, 1, 2, 5, 30])):
            mine = list(text)
            for _ in range(0 if c % 3 == 0 else 3):
                mine[rng.randrange(len(mine))] = f"z{rng.randrange(10**6)}"
            rows.append((key, " ".join(mine)))
            if c:
                want[key] = first
            key += 1
    got = {r.doc_id: r.keep_id for r in minhash.near_duplicates(frame(spark, rows, clash=True)).collect()}
    assert got == want


def test_minhash_of_awkward_rows(spark):
    rows = minhash.near_duplicates(frame(spark, awkward(random.Random(7)), clash=True)).collect()
    assert {(r.doc_id, r.keep_id) for r in rows} == {(2, 1), (9, 6)} and all(r.similarity == 1 for r in rows)
    left = minhash.without_near_duplicates(frame(spark, awkward(random.Random(7)), clash=True))
    assert left.columns == frame(spark, [], clash=True).columns
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in left.collect()) == [-1, 1, 3, 4, 5, 6, 7, 8]
    assert minhash.near_duplicates(frame(spark, [])).collect() == []


def plain_groups(rows, threshold):
    """Groups by the Jaccard similarity of all pairs of texts: {row: least row of its group}."""
    sets = {}
    for i, t in rows:
        w = words_of(t)
        if i is not None and w:
            sets[i, t] = set(zip(w, w[1:], w[2:])) if len(w) > 2 else {tuple(w)}
    nodes = sorted(sets)
    root = {n: n for n in nodes}

    def up(n):
        while root[n] != n:
            n = root[n]
        return n

    for k, a in enumerate(nodes):
        for b in nodes[:k]:
            if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((up(a), up(b)))
                root[y] = x
    return {n: up(n) for n in nodes if up(n) != n}


@pytest.mark.parametrize("bucket", [1 << 18, 4])
def test_minhash_groups_equal_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(minhash, "BUCKET", bucket)
    rng = random.Random(61)
    rows = []
    for g in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(150)]
        for c in range(rng.choice([1, 2, 3, 12])):
            # Similarities of at least 0.8 with the base, or near 0: the estimate is certain there.
            mine = list(base)
            for _ in range(rng.randrange(4)):
                mine[rng.randrange(150)] = f"z{rng.randrange(10**6)}"
            rows.append((rng.randrange(40), " ".join(mine)))
    rows += [rows[3], rows[3], (rows[5][0], rows[9][1]), (None, rows[0][1]), (7, "")]
    df = frame(spark, rows, clash=True)
    want = plain_groups(rows, 0.5)
    got = minhash.near_duplicates(df).collect()
    texts = {(r.doc_id, r.k): r.text for r in df.select("doc_id", fn.xxhash64("text").alias("k"), "text").collect()}
    name = lambda i, k: (i, texts[i, k])
    groups = {}
    for n, r in want.items():
        groups.setdefault(r, set()).add(n)
    mine = {}
    for r in got:
        mine.setdefault(name(r.keep_id, r.keep_text_key), set()).add(name(r.doc_id, r.text_key))
    assert len(got) == len(want) and {frozenset(v | {k}) for k, v in mine.items()} == {frozenset(v | {k}) for k, v in groups.items()}
    assert all(k[0] == min(n[0] for n in v | {k}) for k, v in mine.items())
    left = [(r.doc_id, r.text) for r in minhash.without_near_duplicates(df).collect()]
    assert len(left) == len(set(left)) and len(left) == len({(i, t) for i, t in rows}) - len(want)


def test_rows_of_one_id_with_other_texts_are_members_of_their_own(spark):
    rng = random.Random(62)
    one, two, three = (prose(rng, 80, 4000) for _ in range(3))
    rows = [(1, one), (2, two), (2, one), (3, three), (3, two)]
    assert {(r.doc_id, r.keep_id) for r in minhash.near_duplicates(frame(spark, rows)).collect()} == {(2, 1), (3, 2)}
    assert sorted((r.doc_id, r.text) for r in minhash.without_near_duplicates(frame(spark, rows)).collect()) == sorted([(1, one), (2, two), (3, three)])


def test_components(spark):
    edges = [(1, 2), (3, 2), (3, 4), (9, 8), (7, 7), (None, 3), *[(100 + i, 101 + i) for i in range(40)]]
    got = {(r.node, r.root) for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {(2, 1), (3, 1), (4, 1), (9, 8), *[(101 + i, 100) for i in range(40)]}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=40), st.text("abc", max_size=40), st.integers(1, 3))
def test_banded_distance(a, b, tau):
    a, b = a.encode(), b.encode()
    assert linededup.banded_distance([a], [b], tau)[0] == min(tau + 1, edits(a, b))


def plain_repeated(rows, tau, least):
    """By hand: in order of place, a line stays unless an equal or near one before it stays. (doc, text, line) name a place."""
    from relaylake.llm.linededup import text_key

    texts = sorted({r[:2] for r in rows if r[0] is not None and r[1] is not None})
    spark = __import__("pyspark").sql.SparkSession.getActiveSession()
    keys = {r.t: r.k for r in spark.createDataFrame([(t,) for _, t in texts], "t string").select("t", text_key(fn.col("t")).alias("k")).collect()}
    first, places = {}, []
    for doc, key, text in sorted((i, keys[t], t) for i, t in texts):
        for n, line in enumerate(text.lower().split("\n")):
            line = line.strip().encode()
            if len(line) >= least:
                first.setdefault(line, (doc, key, n))
                places.append(((doc, key, n), line))
    order, near, stay = sorted(first.items(), key=lambda x: x[1]), {}, []
    for line, _ in order:
        for other in stay:
            d = edits(line, other) if abs(len(line) - len(other)) <= tau else tau + 1
            if d <= tau:
                near[line] = (first[other], d)
                break
        else:
            stay.append(line)
    return {(*at, *near.get(line, (first[line], 0))[0], near.get(line, (None, 0))[1]) for at, line in places if line in near or first[line] != at}


@pytest.mark.parametrize(("broadcast", "hot"), [(2_000_000, 128), (0, 1), (2_000_000, 0)])
def test_repeated_lines_equal_brute_force(spark, monkeypatch, broadcast, hot):
    monkeypatch.setattr(linededup, "BROADCAST_LINES", broadcast)
    monkeypatch.setattr(linededup, "HOT", hot)
    monkeypatch.setattr(linededup, "HELD", 4 if hot == 0 else 1 << 16)
    rng = random.Random(8)
    pool = ["".join(rng.choice("abcdé ") for _ in range(rng.randrange(10, 60))) for _ in range(30)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rng.randrange(6)):
            line = list(rng.choice(pool))
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(line))
                line[k : k + rng.randrange(2)] = rng.choice(["x", "", "yé"])
            text.append("".join(line).upper() if rng.random() < 0.2 else "".join(line))
        rows.append((i // 2 if i % 7 == 0 else i, "\n".join(text)))
    rows += [rows[3], (None, rows[4][1]), (99, None), (98, ""), (97, "\n\n")]
    got = {tuple(r) for r in linededup.repeated_lines(frame(spark, rows, clash=True)).collect()}
    want = plain_repeated(rows, linededup.TAU, linededup.LEAST)
    assert len(want) > 40 and got == want


def test_a_chain_of_near_lines_keeps_every_other_one(spark):
    a = "the quick brown fox jumps over it"
    chain = [a, a[:-2] + "XX", "YY" + a[2:-2] + "XX", "YYZZ" + a[4:-2] + "XX", "YYZZQQ" + a[6:-2] + "XX"]
    rows = [(k, line) for k, line in enumerate(chain)]
    got = {(r.doc_id, r.kept_doc_id) for r in linededup.repeated_lines(frame(spark, rows)).collect()}
    assert got == {(1, 0), (3, 2)}
    assert {r.doc_id for r in linededup.without_repeated_lines(frame(spark, rows)).collect()} == {0, 2, 4}


def test_rows_of_one_id_lose_their_own_lines_only(spark):
    shared, own = "this line stands in two documents", "this other line stands in only one of them all"
    rows = [(1, f"{shared}\nfirst"), (2, f"{shared}\nsecond"), (2, f"{own}\nthird")]
    assert {r.text for r in linededup.without_repeated_lines(frame(spark, rows)).collect()} == {rows[0][1], "second", rows[2][1]}


def thue_morse(a, b, n=11):
    x, y = a, b
    for _ in range(n):
        x, y = x + y, y + x
    return x, y


def test_lines_and_words_with_colliding_polynomials_are_told_apart(spark):
    x, y = thue_morse("a", "b")
    data = np.frombuffer((x + y).encode(), np.uint8)
    at = np.array([0, len(x)])
    assert len(set(textscan.range_hash(textscan.prefix(data), at, at + len(x)).tolist())) == 1
    assert linededup.repeated_lines(frame(spark, [(1, x), (2, y)])).collect() == []
    assert len(set(textscan.words(*textscan.buffers(strings(pa.array([f"{x} {y}"]))))[0].tolist())) == 2


def test_many_lines_with_one_opening(spark):
    rng = random.Random(88)
    opening = "Posted by the administrator of this forum in the general section on "
    rows = [(k, opening + "".join(rng.choice("abcdefghij") for _ in range(30))) for k in range(700)]
    rows += [(1000 + k, rows[k][1][:-1] + "#") for k in range(0, 700, 50)] + [(2000 + k, rows[k][1]) for k in range(3)]
    got = {(r.doc_id, r.kept_doc_id, r.distance) for r in linededup.repeated_lines(frame(spark, rows)).collect()}
    assert got == {(1000 + k, k, 1) for k in range(0, 700, 50)} | {(2000 + k, k, 0) for k in range(3)}


def test_line_dedup_rewrites(spark):
    rng = random.Random(9)
    line = " ".join(f"word{rng.randrange(999)}" for _ in range(60))
    near = line[:100] + "X" + line[101:]
    rows = [(1, f"one\n{line}\nshort"), (2, line), (3, f"two\n{near}\nshort\n"), (4, None), (5, ""), (6, "   "), (7, "short")]
    got = {r.doc_id: r.text for r in linededup.without_repeated_lines(frame(spark, rows, clash=True)).collect()}
    assert got == {1: rows[0][1], 3: "two\nshort\n", 4: None, 5: "", 6: "   ", 7: "short"}
    assert linededup.without_repeated_lines(frame(spark, [])).collect() == []
    kept = linededup.without_repeated_lines(frame(spark, awkward(random.Random(10)), clash=True))
    assert kept.columns == frame(spark, [], clash=True).columns and kept.count() == 11
    rows = awkward(random.Random(10))
    assert {tuple(r) for r in linededup.repeated_lines(frame(spark, rows[:6] + rows[8:10], clash=True)).collect()} == plain_repeated(rows[:6] + rows[8:10], linededup.TAU, linededup.LEAST)


def test_short_lines_that_repeat_go(spark):
    notice, other = "Share this page with a friend", "All rights are reserved."
    rows = [(1, f"{notice}\nfirst text\n{other}"), (2, f"{notice}\n{other}"), (3, f"{notice.upper()}!\nthird text stays")]
    got = {(r.doc_id, r.line_no, r.kept_doc_id, r.kept_line_no, r.distance) for r in linededup.repeated_lines(frame(spark, rows)).collect()}
    assert got == {(2, 0, 1, 0, 0), (2, 1, 1, 2, 0), (3, 0, 1, 0, 1)}
    # A later exact copy goes whole; no fragment of its short lines is left.
    assert {r.doc_id: r.text for r in linededup.without_repeated_lines(frame(spark, rows)).collect()} == {1: rows[0][1], 3: "third text stays"}


def test_suffix_array_and_search_equal_naive():
    rng = random.Random(11)
    texts = [[rng.randrange(4) for _ in range(rng.randrange(40))] for _ in range(30)] + [[1] * 50, [1] * 50, []]
    hashes = np.array([x * 7 + 1 for t in texts for x in t], np.uint64)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    index = fmindex.FMIndex(hashes, bounds)
    phrases, lengths = [], []
    for size in (1, 2, 3, 5):
        for _ in range(20):
            p = [rng.randrange(5) for _ in range(size)]
            phrases.append([0] * (5 - size) + index.symbols(np.array([x * 7 + 1 for x in p], np.uint64)).tolist())
            lengths.append(size)
    text, word, which = index.occurrences(np.array(phrases), np.array(lengths))
    got = Counter(zip(text.tolist(), (word - bounds[text]).tolist(), which.tolist(), strict=True))
    want = Counter()
    for k, (p, n) in enumerate(zip(phrases, lengths, strict=True)):
        sought = [int(index.vocabulary[s - 1] // 7) if s else -1 for s in p[5 - n :]]
        for i, t in enumerate(texts):
            for a in range(len(t) - n + 1):
                if t[a : a + n] == sought:
                    want[i, a, k] += 1
    assert got == want


def plain_contamination(rows, items, window=8, least=5):
    found = {}
    for n, (_, text) in enumerate(rows):
        own, hits, ids = words_of(text), [False] * len(words_of(text)), set()
        for item, t in items:
            w = words_of(t)
            size = min(window, len(w))
            for k in range(len(w) - size + 1) if size >= least else ():
                for a in range(len(own) - size + 1):
                    if own[a : a + size] == w[k : k + size]:
                        hits[a : a + size] = [True] * size
                        ids.add(item)
        if ids:
            found[n] = (sorted(ids), [w for w, h in zip(own, hits, strict=True) if not h])
    return found


@pytest.mark.parametrize("lot", [32 << 20, 300])
def test_contamination_equals_brute_force(spark, monkeypatch, lot):
    monkeypatch.setattr(fmindex, "PHRASE_BYTES", lot)
    monkeypatch.setattr(fmindex, "SHARD_WORDS", 300)
    rng = random.Random(12)
    items = [(i, prose(rng, rng.choice([3, 6, 20, 30]))) for i in range(12)] + [(50, None), (51, "")]
    items.append((60, items[3][1]))
    rows = []
    for i in range(60):
        text = prose(rng, rng.randrange(1, 80))
        if i % 3 == 0:
            w = rng.choice(items[:12])[1].upper()
            text = text[: len(text) // 2] + " " + w + " é, " + text[len(text) // 2 :]
        rows.append((i, text))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {r.doc_id: (r.item_ids, words_of(r.clean_text)) for r in fmindex.find_contamination(frame(spark, rows, clash=True), bench).collect()}
    want = plain_contamination(rows, [(i, t or "") for i, t in items])
    assert len(want) > 10 and {i: v[0] for i, v in got.items()} == {i: v[0] for i, v in want.items()}
    assert {i: len(v[1]) for i, v in got.items()} == {i: len(v[1]) for i, v in want.items()}
    full = fmindex.find_contamination(frame(spark, rows), bench, only_hits=False).collect()
    assert len(full) == len(rows) and all(r.clean_text == r.text for r in full if r.item_ids is None)


def test_contamination_of_awkward_rows(spark):
    rng = random.Random(13)
    rows = awkward(rng)
    bench = spark.createDataFrame([(1, " ".join(rows[0][1].split()[5:25])), (2, None)], "item_id bigint, text string")
    got = fmindex.find_contamination(frame(spark, rows, clash=True), bench).collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 2]
    assert fmindex.find_contamination(frame(spark, []), bench).collect() == []
    assert fmindex.find_contamination(frame(spark, rows), bench.limit(0)).collect() == []


def plain_bm25(rows):
    docs = sorted((i is not None, i or 0, t) for i, t in rows if words_of(t))
    docs = [(i if has else None, t) for has, i, t in docs]
    terms = [Counter(words_of(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in terms]
    df = Counter(w for c in terms for w in c)
    mean = sum(sizes) / len(sizes)
    idf = {w: math.log1p((len(docs) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
    return docs, sizes, lambda q, d: sum(idf[w] * terms[d][w] * 2.2 / (terms[d][w] + 1.2 * (0.25 + 0.75 * sizes[d] / mean)) for w in terms[q] if w in terms[d])


def plain_neighbours(rows, window, stride, k):
    docs, sizes, score = plain_bm25(rows)
    seed = lambda d: docs[d][0] is not None and docs[d][0] % stride == 0
    free = [d for d in range(len(docs)) if not seed(d) and sizes[d] % window]
    return docs, sizes, score, {q: sorted([(-round(score(q, d), 4), d) for d in free if score(q, d) > 0])[:k] for q in range(len(docs)) if seed(q)}


def plain_packing(rows, window, stride=100, k=32):
    docs, sizes, score, best = plain_neighbours(rows, window, stride, k)
    offers = {}
    for q, found in best.items():
        for s, d in found:
            offers[d] = min(offers.get(d, (s, q)), (s, q))
    out = []
    for d, n in enumerate(sizes):
        out += [[(docs[d][0], j * window, (j + 1) * window)] for j in range(n // window)]
    left = {d: n % window for d, n in enumerate(sizes) if n % window}
    given = {q: sorted((s, d) for d, (s, to) in offers.items() if to == q) for q in best if q in left}
    given = {q: v for q, v in given.items() if v}
    own = {q: left.pop(q) for q in given}

    begun = []
    for q in sorted(given):
        room, made = window - own[q], [(docs[q][0], sizes[q] - own[q], sizes[q])]
        for _, d in given[q]:
            if left[d] <= room:
                room -= left[d]
                made.append((docs[d][0], sizes[d] - left.pop(d), sizes[d]))
        begun.append((q, room, made))

    def fill(seed, room, made):
        for _, d in sorted((-round(score(seed, d), 5), d) for d in left if score(seed, d) > 0):
            if left[d] <= room:
                room -= left[d]
                made.append((docs[d][0], sizes[d] - left.pop(d), sizes[d]))
        out.append(made)

    for some in begun:
        fill(*some)
    while left:
        seed = min(left)
        size = left.pop(seed)
        fill(seed, window - size, [(docs[seed][0], sizes[seed] - size, sizes[seed])])
    return out


@pytest.mark.parametrize("stride", [100, 7])
def test_packing_equals_brute_force(spark, stride):
    rng = random.Random(14)
    rows = [(i, prose(rng, rng.choice([5, 30, 60, 130, 260]), 3000)) for i in range(70)] + [(None, prose(rng, 40, 3000))]
    got = [[(p.doc_id, p.first_word, p.last_word) for p in r.pieces] for r in packing.pack_documents(frame(spark, rows, clash=True), window=128, stride=stride, k=5).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_packing(rows, 128, stride, 5)))


@pytest.mark.parametrize("lot", [16 << 20, 4000])
def test_seeds_find_their_neighbours_in_all_shards(spark, monkeypatch, lot):
    monkeypatch.setattr(packing, "LOT_BYTES", lot)
    monkeypatch.setattr(packing, "SEEDS", 3)
    rng = random.Random(141)
    rows = [(i, prose(rng, rng.choice([5, 30, 60, 130, 260]), 3000)) for i in range(150)]
    df = frame(spark, rows, clash=True).repartition(5)
    docs, _, _, best = plain_neighbours(rows, 4096, 10, 8)
    want = {(docs[q][0], docs[d][0]) for q, found in best.items() for _, d in found}
    assert {(r.seed_id, r.doc_id) for r in packing.neighbours(df, stride=10, k=8).collect()} == want
    # Cut into many shards, what a seed is offered still comes from all of them, and nothing is lost.
    made = packing.pack_documents(df, window=4096, shard_bytes=8_000, stride=10, k=8).collect()
    assert len({r.shard_id for r in made}) > 5
    assert Counter(i for r in made for i in r.doc_ids) == Counter(i for i, _ in rows)
    offered = {}
    for q, found in best.items():
        for s, d in found:
            offered[d] = min(offered.get(d, (s, q)), (s, q))
    placed = {p.doc_id: r.seed_doc_id for r in made for p in r.pieces}
    assert all(placed[docs[d][0]] == docs[q][0] for d, (_, q) in offered.items())


def test_tasks_hand_on_what_may_be_among_the_best(spark, monkeypatch):
    for name, value in (("LOT_BYTES", 20_000), ("FEW", 100), ("SAMPLE", 4)):
        monkeypatch.setattr(packing, name, value, raising=False)
    handed, materialise = [], packing.materialise

    def counted(df):
        made = materialise(df)
        if made.columns == ["seed", "doc", "doc_id", "score"]:
            handed.append(made.count())
        return made

    monkeypatch.setattr(packing, "materialise", counted)
    rng = random.Random(143)
    rows = [(i, prose(rng, rng.choice([30, 60, 130, 260]), 3000)) for i in range(600)]
    rows += [rows[k] for k in range(1, 600, 7)]  # repeated rows raise no bound
    got = packing.neighbours(frame(spark, rows).repartition(40), stride=10, k=8).collect()
    docs, _, _, best = plain_neighbours(rows, 4096, 10, 1000)
    want = {}
    for q, found in best.items():
        want[docs[q][0]] = {(docs[d][0], -s) for s, d in found}
        eighth = sorted((-x, i) for i, x in want[docs[q][0]])[:8][-1]
        want[docs[q][0]] = {(i, x) for i, x in want[docs[q][0]] if (-x, i) <= eighth}
    assert {(r.seed_id, r.doc_id, r.score) for r in got} == {(q, i, x) for q, found in want.items() for i, x in found}
    # Forty tasks that each return their best eight would hand on up to 320 rows for each of the sixty seeds.
    assert len(handed) > 1 and sum(handed) < 60 * 8 * 4 * 2


def test_a_shard_of_copies_is_split(spark):
    rng = random.Random(142)
    text = prose(rng, 100, 3000)
    rows = [(i, text) for i in range(101, 400) if i % 100] + [(i, prose(rng, 100, 3000)) for i in range(1001, 1100) if i % 100]
    made = packing.pack_documents(frame(spark, rows), window=512, shard_bytes=10_000).collect()
    sizes = Counter()
    for r in made:
        sizes[r.shard_id] += sum(len(r.text) for _ in [0])
    assert max(sizes.values()) < 40_000 and Counter(i for r in made for i in r.doc_ids) == Counter(i for i, _ in rows)


def test_packing_keeps_every_word(spark):
    rows = awkward(random.Random(15))
    rows = [*rows, rows[0], (100, rows[0][1]), (100, rows[0][1])]
    for size in (packing.SHARD_BYTES, 20_000):
        made = packing.pack_documents(frame(spark, rows, clash=True), window=512, shard_bytes=size).collect()
        assert all(sum(p.last_word - p.first_word for p in r.pieces) == r.n_words <= 512 for r in made)
        assert sum(r.n_words for r in made) == sum(len(words_of(t)) for _, t, *_ in rows)
        long = sorted(((p.first_word, r.text) for r in made for p in r.pieces if p.doc_id == 6 and len(r.pieces) == 1), key=lambda x: x[0])
        assert rows[7][1].startswith("".join(t for _, t in long))
    assert packing.pack_documents(frame(spark, [])).collect() == []
