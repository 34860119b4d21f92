"""What moves, and how often: plans and state of the steps that larger tables go through."""

import os
import random

import pytest
from pyspark.sql import functions as F
from test_relay import NOW, history, log, model, plain

from relaylake.filters import Filter
from relaylake.functions import bip340
from relaylake.operators import negentropy, query, state
from relaylake.schema import EVENT_COLUMNS
from relaylake.sources import catalog
from relaylake.streaming import live

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.exists(f"{SF}/events.parquet"), reason="no tables here")


def exchanges(df, column):
    """How many shuffles of the plan carry that column."""
    def walk(node):
        children = node.children()
        own = node.nodeName() == "Exchange" and f"{column}#" in node.output().mkString(",")
        return own + sum(walk(children.apply(k)) for k in range(children.size()))

    return walk(df._jdf.queryExecution().executedPlan().initialPlan())


@tables
@pytest.mark.parametrize("extended", [False, True])
def test_larger_tables_are_not_cached(spark, monkeypatch, tmp_path, extended):
    kept = {tuple(r) for r in catalog.seen(spark, SF, extended=extended).select("seq", "id", "content").collect()}
    monkeypatch.setattr(catalog, "_kept", {})
    monkeypatch.setattr(catalog, "KEEP_BYTES", 0)
    (tmp_path / "again").symlink_to(SF)  # another path, else Spark finds the cached plan
    found = catalog.seen(spark, str(tmp_path / "again"), extended=extended)
    assert all(not df.storageLevel.useMemory for df in catalog._kept.values()) and catalog._kept
    assert exchanges(found.select("seq", "id", "pubkey", "created_at", "kind", "content"), "content") <= 1
    assert {tuple(r) for r in found.select("seq", "id", "content").collect()} == kept


def test_whole_rows_move_once_to_what_hides_them(spark):
    rng = random.Random(5)
    events = log(spark, history(rng))
    assert exchanges(state.visible(events, NOW), "content") == 1
    assert exchanges(state.visible(events, NOW, hide_vanished_62=True), "content") == 1


@pytest.mark.parametrize("most", [0, 2, 100])
def test_side_tables_of_any_size_give_the_same_visible_set(spark, monkeypatch, most):
    monkeypatch.setattr(state, "HELD", most)
    rng = random.Random(6)
    for _ in range(4):
        events = list({e["id"]: e for e in history(rng)}.values())
        events += rng.sample(events, 3) + [plain(1000, 1, 62, 3), plain(1001, 1, 1, 4), plain(1002, 2, 62, 3)]
        accepted = state.accepted(log(spark, events))
        ids = [r.id for r in accepted.select("id").collect()]
        assert len(ids) == len(set(ids))
        assert {r.id for r in state.visible(accepted, NOW).select("id").collect()} == model(events, NOW)


def test_differences_move_each_row_once(spark):
    side = lambda *ids: spark.createDataFrame([(n, f"{n:064x}") for n in ids], "created_at bigint, id string")
    found = negentropy.difference(side(1, 2, 3), side(3, 4))
    assert exchanges(found, "id") == 1
    assert sorted((r.side, r.created_at) for r in found.collect()) == [("have", 1), ("have", 2), ("need", 4)]
    assert negentropy.difference(side(1), side(1)).count() == 0


def test_version_status_has_running_frames_only(spark):
    events = [plain(n, 1, 0, (n * 7) % 11) for n in range(20)]
    found = state.version_status(log(spark, events))
    assert "unboundedfollowing" not in found._jdf.queryExecution().executedPlan().toString().lower()
    best, want = None, {}
    for n, e in enumerate(events):
        rank = (e["created_at"], -int(e["id"], 16))
        want[n] = "rejected" if best is not None and best[0] >= rank else "current"
        if want[n] == "current":
            if best is not None:
                want[best[1]] = "superseded"
            best = (rank, n)
    assert {r.seq: r.version_status for r in found.collect()} == want


def arrive(spark, path, lots):
    """A stream in which each lot of events comes as one batch."""
    for n, lot in enumerate(lots):
        log(spark, lot).select(*EVENT_COLUMNS).withColumn("seq", F.col("seq") + 1000 * n).coalesce(1).write.mode("append").parquet(path)
    return live.storable(live.read_events(spark, path))


def test_current_versions_are_kept_by_bucket(spark, tmp_path):
    rng = random.Random(7)
    lots = [[plain(1000 * lot + n, rng.randrange(400), rng.choice([0, 30001]), rng.randrange(9), [["d", rng.choice("xy")]]) for n in range(500)] for lot in range(3)]
    progress = live.drain(live.latest_versions(arrive(spark, str(tmp_path / "in"), lots)), str(tmp_path / "out"))
    keys, changes = {}, []
    for lot in lots:
        before = dict(keys)
        for e in lot:
            key = (e["pubkey"], e["kind"], e["tags"][0][1] if e["kind"] else "")
            rank = (e["created_at"], -int(e["id"], 16))
            if key not in keys or rank > keys[key][0]:
                keys[key] = (rank, e["id"])
        changes += [("set", k, v[1]) for k, v in keys.items() if before.get(k) != v] + [("drop", k, v[1]) for k, v in before.items() if keys[k] != v]
    got = [(r.op, (r.pubkey, r.kind, r.d_value), r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert sorted(got) == sorted(changes)
    # One row of state, and so one call of Python, a bucket.
    assert len(keys) > 2 * live.BUCKETS and progress["stateOperators"][0]["numRowsTotal"] <= live.BUCKETS


def test_deletions_meet_their_targets_without_python(spark, tmp_path):
    ask = lambda n, author, target: plain(n, author, 5, 1, [["e", f"{target:064x}"]])
    lots = [
        [plain(1, 1, 1, 1), ask(2, 1, 3), ask(3, 2, 1), ask(4, 1, 9), plain(5, 1, 7, 1)],
        [ask(10, 1, 1), ask(11, 1, 1), ask(12, 2, 9), plain(9, 1, 1, 1)],
        [ask(20, 1, 1), ask(21, 1, 5), plain(22, 3, 1, 1), ask(23, 1, 2), plain(9, 1, 1, 1)],
    ]
    found = live.deletions_by_id(arrive(spark, str(tmp_path / "in"), lots))
    assert "InPandas" not in found._jdf.queryExecution().analyzed().toString()
    live.drain(found, str(tmp_path / "out"))
    assert sorted((int(r.target_id, 16), int(r.pubkey, 16)) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, 1), (5, 1), (9, 1)]


@tables
def test_arrivals_are_files_of_bounded_size(spark, monkeypatch):
    from relaylake.plans import registry

    monkeypatch.setattr(registry, "FILE_EVENTS", 50)
    monkeypatch.setattr(registry, "fresh_path", lambda spark, prefix, _f=registry.fresh_path: paths.append(_f(spark, prefix)) or paths[-1])
    paths = []
    assert registry.QUERIES["stream_subscribe"](spark, SF).count() > 0
    files = spark.read.parquet(paths[-1]).groupBy(F.input_file_name()).count().collect()
    assert len(files) == 20 and max(r["count"] for r in files) < 150


def test_products_by_digits_and_signatures_of_frequent_keys(monkeypatch):
    rng, g = random.Random(8), (*bip340.G, 1)
    table = bip340.digits(g, 4)
    for n in [0, 1, 15, 16, 17, 2**255, bip340.N - 1, *(rng.randrange(bip340.N) for _ in range(5))]:
        want = bip340.multiply(n, 0, bip340._G16)
        for got in (bip340.times_g(n), bip340.add_digits((1, 1, 0), n, table, 4)):
            assert bool(got[2]) == bool(want[2]) and (not want[2] or bip340.affine(got) == bip340.affine(want))
    # Equal points are doubled, opposite ones cancel.
    assert bip340.affine(bip340.add_digits(g, 1, table, 4)) == bip340.affine(bip340.double(g))
    assert not bip340.add_digits(g, bip340.N - 1, table, 4)[2]
    key, messages = bip340.public_key(77), [rng.randbytes(32) for _ in range(40)]
    signatures = [bip340.sign(77, m) for m in messages]
    assert all(bip340.verify(key, m, s) for m, s in zip(messages, signatures, strict=True))
    bad = [(s[:63] + bytes([s[63] ^ 1])) for s in signatures]
    assert not any(bip340.verify(key, m, s) for m, s in zip(messages, bad, strict=True))
    monkeypatch.setattr(bip340, "double", lambda p: pytest.fail("a frequent key needs no doubling"))
    assert bip340.verify(key, messages[0], signatures[0]) and bip340.sign(77, messages[1]) == signatures[1]


def test_batched_requests_read_tags_only_where_a_filter_has_them(spark):
    events = log(spark, [plain(1, 1, 1, 1, [["t", "x"]]), plain(2, 1, 1059, 2, [["p", f"{1:064x}"]]), plain(3, 2, 7, 3)])
    untagged = query.request_batch(events, {"a": Filter(authors=[f"{1:064x}"]), "k": Filter(kinds=[7, 1059]), "all": Filter()}).select("sub_id", "seq")
    assert {tuple(r) for r in untagged.collect()} == {("a", 0), ("k", 2), ("all", 0), ("all", 2)}
    reads_tags = lambda df: any(name in df._jdf.queryExecution().optimizedPlan().toString() for name in ("filter(tags#", "exists(tags#"))
    assert not reads_tags(untagged)
    tagged = query.request_batch(events, {"t": Filter(tags={"t": ["x"]}), "a": Filter(authors=[f"{1:064x}"])}, auth_pubkeys=[f"{1:064x}"]).select("sub_id", "seq")
    assert reads_tags(tagged)
    assert {tuple(r) for r in tagged.collect()} == {("t", 0), ("a", 0), ("a", 1)}
