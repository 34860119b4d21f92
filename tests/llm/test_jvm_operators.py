"""Hilbert sharding, the archive, chat expansion and licence rules."""

import itertools
import random

import duckdb
import pytest
from helpers import CLASH, awkward, frame, prose
from pyspark.sql import functions as F

from relaylake.llm import chat, hilbert, licences, oracles, warc

DIMS = [hilbert.Dim("lang", "depth"), hilbert.Dim("source", "depth"), hilbert.Dim("n_chars", "log"), hilbert.Dim("doc_id", "width")]


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_curve_visits_each_cell_once_in_unit_steps(dims, bits):
    digit, following = hilbert.curve_tables(dims)
    at = {}
    for cell in itertools.product(range(1 << bits), repeat=dims):
        state = index = 0
        for level in range(bits - 1, -1, -1):
            k = state * (1 << dims) + sum(((cell[d] >> level) & 1) << d for d in range(dims))
            index, state = index * (1 << dims) + digit[k], following[k]
        at[index] = cell
    assert sorted(at) == list(range(1 << bits * dims))
    assert all(sum(abs(a - b) for a, b in zip(at[i], at[i + 1], strict=True)) == 1 for i in range(len(at) - 1))


def shards(df, **kw):
    return hilbert.hilbert_shards(df, DIMS, id_column="doc_id", payload="text", **kw)


@pytest.mark.parametrize("cell", [hilbert.CELL_BYTES, 3000])
def test_shards_equal_sql_and_prune(spark, cell):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randrange(1, 90)), rng.choice(["en", "de", None]), f"s{rng.randrange(5)}", rng.randrange(9000)) for i in range(300)]
    # A third of the bytes lie in one cell.
    rows += [(rng.randrange(100), prose(rng, 60), "en", "s1", 500) for _ in range(100)] + [(None, "x" * 9000, "en", "s1", 500)]
    df = frame(spark, rows)
    got = shards(df, target_bytes=4096, cell_bytes=cell)
    con = duckdb.connect()
    documents = df.toArrow()
    con.register("documents", documents)
    want = con.execute(oracles.hilbert(target_bytes=4096)).fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    manifest = hilbert.shard_manifest(got, ["n_chars", "doc_id"])
    kept = hilbert.prune(manifest, n_chars=(8000, None), doc_id=(0, 40))
    assert 0 < kept.count() < manifest.count()
    assert {r.shard_id for r in kept.collect()} >= {r.shard_id for r in got.where("n_chars >= 8000 and doc_id <= 40").collect()}


def test_shards_of_awkward_rows(spark):
    rows = awkward(random.Random(2))
    got = shards(frame(spark, rows, clash=True), target_bytes=1000).collect()
    assert len(got) == len(rows) and len({c.lower() for c in got[0].asDict()}) == len(got[0])
    assert all(isinstance(r.shard_id, int) and r.hilbert_index >= 0 for r in got)
    assert [r["__run"] for r in got] == [CLASH["__run"]] * len(rows)
    assert shards(frame(spark, []), target_bytes=1000).collect() == []


PAGES = "page_id bigint, url string, html string"
PARTS = {"id_column": "page_id", "url_column": "url", "payload_column": "html"}


def test_archive_round_trip(spark, tmp_path):
    rows = [(1, "http://a/é", "<p>é\r\n\r\nx"), (2, "http://b", "<p>é\r\n\r\nx"), (2, "http://b", "<p>é\r\n\r\nx"), (3, None, ""), (4, "u", None), (None, "v", "z" * 300_000)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("payload", F.lit("clash")).withColumn("record", F.lit(1))
    warc.write_archive(pages, str(tmp_path / "a"), **PARTS)
    assert spark.read.parquet(str(tmp_path / "a" / "payloads")).count() == 3
    got = warc.read_archive(spark, str(tmp_path / "a")).collect()
    assert sorted(repr((r.record_id, r.url, r.payload)) for r in got) == sorted(map(repr, rows))
    assert all(r.intact for r in got)
    for r in got:
        head, _, rest = r.record.partition("\r\n\r\n")
        assert head + "\r\n\r\n" == r.record_header and rest == (r.payload or "") + "\r\n\r\n"
        assert f"Content-Length: {len((r.payload or '').encode())}" in head
    empty = spark.createDataFrame([], PAGES)
    assert warc.reconstruct(warc.record_headers(empty, **PARTS), warc.payload_store(empty, payload_column="html")).collect() == []


def test_archive_notices_damage(spark):
    pages = spark.createDataFrame([(1, "u", "abc")], PAGES)
    store = warc.payload_store(pages, payload_column="html").withColumn("payload", F.lit("abd"))
    assert [r.intact for r in warc.reconstruct(warc.record_headers(pages, **PARTS), store).collect()] == [False]


def test_prefix_targets_equal_a_plain_loop(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "user", "hi"), (1, 2, "assistant", "a\nb"), (1, 2, "assistant", "a\nb"), (1, 3, None, None), (1, 4, "assistant", None), (2, 0, "assistant", "first"), (3, 0, "user", "only"), (None, 1, "assistant", "x"), (None, 0, "user", "w"), (None, 1, "assistant", "x"), (4, None, "user", "early"), (4, 0, "assistant", "y" * 50_000), (4, 0, "assistant", "é")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("prompt", F.lit(1)).withColumn("i", F.lit(2))
    want = []
    for conv, mine in [(c, [r for r in rows if r[0] == c]) for c in {r[0] for r in rows} - {None}] + [(None, [r]) for r in rows if r[0] is None]:
        turns = sorted(((-1 if t is None else t, r or "unknown", x or "") for c, t, r, x in mine))
        for k, (t, role, text) in enumerate(turns):
            if role == "assistant":
                prompt = "".join(f"<|{r}|>\n{x}<|end|>\n" for _, r, x in turns[:k]) + "<|assistant|>\n"
                want.append((conv, None if t == -1 else t, k + 1, k, prompt, text + "<|end|>\n", len(prompt), len(prompt) + len(text) + 8))
    got = [tuple(r) for r in chat.prefix_targets(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert chat.prefix_targets(df.limit(0)).collect() == []


def plain_licences(text):
    known, out = licences.known_sentences(), []
    for s in licences.split_python(text or ""):
        if licences.normal_python(s) in known:
            out.append(known[licences.normal_python(s)])
        else:
            out += [known[licences.normal_python(x)] for x in s.split("\n") if licences.normal_python(x) in known]
    return "".join(f"<{x}>" for x in out)


def test_licences(spark):
    mit = " ".join(licences.SENTENCES[k][0] for k in ("MIT-grant", "MIT-notice", "asis", "no-liability"))
    bsd = "\n".join(licences.SENTENCES[k][0] for k in ("BSD-grant", "BSD-source", "BSD-binary"))
    rows = [
        (1, "Prose here.\nReleased under the MIT License.\nMore", None), (2, "Copyright 2020. " + mit.replace(" of this ", "\nof this "), None), (3, bsd + "\n" + licences.SENTENCES["BSD-endorse"][0], None), (4, bsd, None),
        (5, "junk without end\nLicensed under CC BY-NC 4.0.\n", None), (6, "Licensed under the Apache License, Version 2.0. Licensed under the Apache License, Version 2.0.", None), (7, None, None), (8, "", None),
        (9, "This mentions a license only.", None), (11, "Copyright. All rights\nreserved. More", None), (12, "All rights  reserved.", None), (13, "SPDX-License-Identifier: LGPL-2.1-or-later\ncode", None), (14, "Licensed under the ISC License.", None), (10, "x. " * 50_000 + "All rights reserved.", None), (1, "Prose here.\nReleased under the MIT License.\nMore", None),
    ]
    rows = [r[:2] for r in rows]
    got = licences.recognise(frame(spark, rows, clash=True)).collect()
    found = {r.doc_id: r for r in got}
    assert {i: found[i].licences for i in found} == {1: "MIT", 2: "MIT", 3: "BSD-3-Clause", 4: "BSD-2-Clause", 5: "CC-BY-NC-4.0", 6: "Apache-2.0", 10: "all-rights-reserved", 11: "all-rights-reserved", 12: "all-rights-reserved", 13: "LGPL-2.1-or-later", 14: "ISC"}
    assert sum(r.doc_id == 1 for r in got) == 2
    assert all(found[i].sentence_ids == plain_licences(t) for i, t in rows if i in found)
    assert licences.recognise(frame(spark, [])).collect() == []
    odd = awkward(random.Random(3))
    assert licences.recognise(frame(spark, odd, clash=True)).collect() == []


def test_whole_licence_texts(spark):
    """Each rule's own sentences give its licence, and spelling, case and line ends don't matter."""
    rows, want = [], {}
    for k, (name, sequence) in enumerate(licences.RULES):
        text = " ".join(licences.SENTENCES[x][0] + ("" if licences.SENTENCES[x][0][-1] in ".:" else "\n\n") for x in sequence)
        rows.append((k, f"A title.\n\n{text.upper()} And more.".replace(", ", ",\n\t")))
        want[k] = name
    got = {r.doc_id: r.licences for r in licences.recognise(frame(spark, rows)).collect()}
    assert got == want


def test_licence_sql_follows(spark):
    rows = [(k, t) for k, t in enumerate(x for texts in licences.SENTENCES.values() for x in texts)] + [(900, None), (901, ""), (902, "All rights\nreserved. " * 3)]
    df = frame(spark, rows)
    con = duckdb.connect()
    documents = df.toArrow()
    con.register("documents", documents)
    assert sorted(map(tuple, licences.recognise(df).collect())) == sorted(con.execute(licences.oracle()).fetchall())
