"""The relay engine against hand-made scenarios, a sequential model and protocol rules."""

import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from relaylake import protocol
from relaylake.config import Limits
from relaylake.filters import Filter, Invalid
from relaylake.functions import bip340, scalars
from relaylake.operators import compact, negentropy, query, state
from relaylake.operators.fanout import Subscription, deliver
from relaylake.schema import EVENT
from relaylake.sources import based, jsonl

NOW = 1_705_276_800
KEYS = {s: bip340.public_key(s).hex() for s in (1, 2, 3)}


def signed(secret, kind, created_at, tags=(), content=None):
    e = {"pubkey": KEYS[secret], "created_at": created_at, "kind": kind, "tags": [list(t) for t in tags], "content": f"k={kind} t={created_at}" if content is None else content}
    e["id"] = protocol.event_id(e)
    e["sig"] = bip340.sign(secret, bytes.fromhex(e["id"])).hex()
    return e


def log(spark, events):
    rows = [(n, e["id"], e["pubkey"], e.get("sig", ""), e["created_at"], e["kind"], e["tags"], e["content"]) for n, e in enumerate(events)]
    return scalars.with_derived(spark.createDataFrame(rows, EVENT))


def plain(n, author, kind, created_at, tags=()):
    return {"id": f"{n:064x}", "pubkey": f"{author:064x}", "created_at": created_at, "kind": kind, "tags": [list(t) for t in tags], "content": str(n)}


def model(events, now):
    """Visible ids by a sequential run of the rules."""
    stored, tombs, pending, live, gone = {}, set(), {}, {}, set()
    for seq, e in enumerate(events):
        if e["id"] in stored or e["pubkey"] in gone or 20000 <= e["kind"] < 30000:
            continue
        k = e["kind"]
        versioned = k in (0, 3) or 10000 <= k < 20000 or 30000 <= k < 40000
        if versioned:
            d = next((t[1] for t in e["tags"] if t[0] == "d" and len(t) > 1), "") if k >= 30000 else ""
            key = (e["pubkey"], k, d)
            if key in live:
                old = live[key]
                if not (e["created_at"] > old["created_at"] or (e["created_at"] == old["created_at"] and e["id"] < old["id"])):
                    continue
                tombs.add(old["id"])
            live[key] = e
        stored[e["id"]] = (seq, e)
        if k == 5:
            for t in e["tags"]:
                if t[0] == "e":
                    if t[1] in stored:
                        target = stored[t[1]][1]
                        if target["pubkey"] == e["pubkey"] and target["kind"] != 5:
                            tombs.add(t[1])
                    else:
                        pending.setdefault(t[1], set()).add(e["pubkey"])
                if t[0] == "a":
                    kind, owner, d = t[1].split(":", 2)
                    if owner == e["pubkey"]:
                        for i, (_, x) in stored.items():
                            if x["kind"] == int(kind) and x["pubkey"] == owner and next((y[1] for y in x["tags"] if y[0] == "d"), "") == d:
                                tombs.add(i)
        elif e["pubkey"] in pending.pop(e["id"], set()):
            tombs.add(e["id"])
        if k == 62:
            gone.add(e["pubkey"])
            tombs |= {i for i, (_, x) in stored.items() if x["pubkey"] == e["pubkey"] and x["kind"] != 62}
    return {i for i, (_, e) in stored.items() if i not in tombs and not any(t[0] == "expiration" and int(t[1]) <= now for t in e["tags"])}


def history(rng):
    out = []
    for n in range(rng.randrange(5, 40)):
        author, kind = rng.randrange(3), rng.choice([0, 1, 1, 5, 5, 7, 30001, 30001, 62 if rng.random() < 0.1 else 1, 20001])
        tags = []
        if kind == 30001:
            tags = [["d", rng.choice("xy")]]
        if kind == 5:
            tags = [["e", f"{rng.randrange(40):064x}"]] if rng.random() < 0.6 else [["a", f"30001:{rng.randrange(3):064x}:{rng.choice('xy')}"]]
        if kind == 1 and rng.random() < 0.3:
            tags = [["expiration", str(NOW + rng.choice([-5, 0, 5]))]]
        out.append(plain(n if rng.random() < 0.9 else rng.randrange(n + 1), author, kind, rng.randrange(5), tags))
    rng.shuffle(out)
    return out


def test_visible_set_equals_a_sequential_model(spark):
    rng = random.Random(1)
    for _ in range(12):
        events = history(rng)
        # Ids stand for one event each.
        events = list({e["id"]: e for e in events}.values()) + events[:2][:0]
        events += rng.sample(events, 2)
        got = {r.id for r in state.visible(state.accepted(log(spark, events)), NOW).select("id").collect()}
        assert got == model(events, NOW)


def test_version_status_and_compaction(spark):
    events = [plain(1, 1, 0, 10), plain(2, 1, 0, 5), plain(3, 1, 0, 20), plain(4, 1, 0, 20), plain(5, 2, 30001, 1, [["d", "x"]]), plain(6, 2, 30001, 2, [["d", "y"]])]
    stored = log(spark, events)
    assert {r.seq: r.version_status for r in state.version_status(stored).collect()} == {0: "superseded", 1: "rejected", 2: "current", 3: "rejected", 4: "current", 5: "current"}
    assert {r.seq for r in compact.retained(stored, NOW).collect()} == {2, 4, 5}
    assert compact.due(stored, Limits(compaction_tombstones=1)) and not compact.due(stored, Limits(compaction_interval=0, compaction_tombstones=1))


def test_compact_writes_the_retained_log(spark, tmp_path):
    stored = log(spark, [plain(1, 1, 0, 10), plain(2, 1, 0, 20), plain(3, 1, 1, 1, [["expiration", "1"]])])
    assert compact.compact(stored, str(tmp_path / "c"), NOW) == 1


def test_request_takes_last_arrivals_then_sorts_by_time(spark):
    seen = log(spark, [plain(n, 1, 1, t) for n, t in enumerate([3000, 1000, 5000, 2000])])
    assert [r.created_at for r in query.request(seen, [Filter(limit=3)]).collect()] == [5000, 2000, 1000]
    assert [r.created_at for r in query.request(seen, [Filter(since=2000), Filter(since=5000)]).collect()] == [5000, 5000, 3000, 2000]
    assert query.request(seen, [Filter(limit=0)]).count() == 0 and query.request(seen, []).count() == 0
    assert query.request(seen, [Filter()], limits=Limits(max_limit=2)).count() == 2
    assert query.count(seen, [Filter(limit=1), Filter(kinds=[1])]).first()[0] == 4


def test_gift_wraps_show_to_their_recipients(spark):
    seen = log(spark, [plain(1, 1, 1059, 1, [["p", KEYS[1]]]), plain(2, 1, 1059, 2, [["p", KEYS[2]]]), plain(3, 1, 1, 3)])
    assert [r.seq for r in query.request(seen, [Filter()]).collect()] == [2]
    assert [r.seq for r in query.request(seen, [Filter()], auth_pubkeys=[KEYS[2]]).collect()] == [2, 1]
    assert query.count(seen, [Filter(kinds=[1059])], auth_pubkeys=list(KEYS.values())).first()[0] == 2


def test_each_subscription_gets_an_event_once(spark):
    events = log(spark, [plain(1, 1, 1, 1, [["t", "a"]]), plain(2, 2, 7, 2, [["expiration", "5"]])])
    subs = {"s": Subscription([Filter(kinds=[1]), Filter(tags={"t": ["a"]})]), "n": Subscription([Filter(ids=[])]), "all": Subscription([Filter()])}
    assert sorted((r.sub_id, r.seq) for r in deliver(events, subs, NOW).collect()) == [("all", 0), ("s", 0)]


def test_filters_push_down(spark, tmp_path):
    log(spark, [plain(1, 1, 1, 1)]).write.parquet(str(tmp_path / "log"))
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    f = Filter(kinds=[1], authors=["00" * 4], since=0, until=5)
    plan = spark.read.parquet(str(tmp_path / "log")).where(f.predicate())._jdf.queryExecution().executedPlan().toString()
    assert all(x in plan for x in ("StringStartsWith(pubkey", "EqualTo(kind,1)", "GreaterThanOrEqual(created_at,0)", "LessThanOrEqual(created_at,5)"))


@pytest.mark.parametrize(
    ("given", "reason"),
    [
        ({"ids": ["abc"]}, "invalid: ids entry odd-length hex prefix"), ({"ids": [""]}, "invalid: ids entry empty string"), ({"authors": ["AB"]}, "invalid: authors entry not lowercase hex"), ({"ids": ["ab" * 33]}, "invalid: ids entry too long"),
        ({"kinds": [70000]}, "invalid: kind out of range for u16"), ({"kinds": [-1]}, "invalid: kind not a non-negative integer"), ({"kinds": list(range(257))}, "invalid: too many values in kinds"), ({"since": "1"}, "invalid: since not an integer"),
        ({"limit": -1}, "invalid: limit not a non-negative integer"), ({"#t": "x"}, "invalid: tag filter not an array"), ({"#t": [1]}, "invalid: tag filter value not a string"), ({"ids": [1]}, "invalid: id in ids not a string"), ([], "invalid: filter not an object"),
    ],
)
def test_filter_faults(given, reason):
    with pytest.raises(Invalid, match="^" + reason.replace("(", "\\(") + "$"):
        Filter.parse(given)


def test_filter_grammar():
    f = Filter.parse('{"ids":[],"#e":["x"],"#ab":["y"],"#é":["z"],"other":1,"limit":3}')
    assert f.ids == [] and f.tags == {"e": ["x"]} and f.authors is None and f.clamped(2) == 2


def test_messages():
    e = signed(1, 1, 1_700_000_000, content='a"\\\n\t\x08\x1f')
    assert protocol.parse_message(json.dumps(["EVENT", e | {"extra": 1}])).event == e
    m = protocol.parse_message('["REQ","s",{"kinds":[1]},{}]')
    assert m.sub_id == "s" and len(m.filters) == 2
    assert protocol.parse_message('["NEG-OPEN","s",{},"61"]').payload == b"a"
    for raw, reason in [
        ("{", "invalid: not valid JSON"), ("{}", "invalid: message is not a JSON array"), ("[]", "invalid: empty array"), ("[1]", "invalid: verb not a string"), ('["X"]', "unknown message type"), ('["REQ","s"]', "invalid: REQ requires sub_id and at least one filter"),
        ('["CLOSE"]', "invalid: CLOSE missing sub_id"), ('["CLOSE",""]', "invalid: subscription ID must not be empty"), ('["EVENT",1]', "invalid: EVENT payload not an object"), ('["NEG-MSG","s","6"]', "invalid: NEG-MSG message not valid hex"),
        (json.dumps(["REQ", "x" * 65, {}]), "invalid: subscription ID too long (max 64 characters)"),
    ]:
        with pytest.raises(Invalid) as info:
            protocol.parse_message(raw)
        assert str(info.value) == reason
    assert protocol.ok_message("ab", True) == '["OK","ab",true,""]' and protocol.count_message("s", 3) == '["COUNT","s",{"count":3}]'
    assert protocol.eose_message('a"') == '["EOSE","a\\""]' and protocol.neg_message("s", b"a", 5) == '["NEG-MSG","s","61",5]'
    assert json.loads(protocol.event_message("s", e))[2] == e and '\\u0008\\u001f' in protocol.event_json(e)
    assert set(protocol.relay_information()["limitation"]) >= {"max_limit", "auth_required"}


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({"id": "ab"}, "invalid: id wrong length"), ({"id": "AB" * 32}, "invalid: id not lowercase hex"), ({"sig": None}, "invalid: sig missing or not a string"), ({"created_at": "1"}, "invalid: created_at missing or not an integer"),
        ({"kind": 65536}, "invalid: kind out of range for u16"), ({"tags": {}}, "invalid: tags not an array"), ({"tags": [[]]}, "invalid: tag inner array is empty"), ({"tags": [[1]]}, "invalid: tag field not a string"), ({"content": 1}, "invalid: content missing or not a string"),
    ],
)
def test_event_faults(change, reason):
    with pytest.raises(Invalid) as info:
        protocol.parse_event(signed(1, 1, 1) | change)
    assert str(info.value) == reason


def test_validation_and_authentication():
    e = signed(1, 1, NOW)
    assert protocol.validate(e, NOW) == ""
    assert protocol.validate(e | {"content": "x"}, NOW) == "invalid: bad event id"
    assert protocol.validate(e | {"sig": "00" * 64}, NOW) == "invalid: bad signature"
    assert protocol.validate(signed(1, 1, NOW + 172_801), NOW) == "invalid: created_at too far in the future"
    assert protocol.validate(signed(1, 1, -1), NOW) == "invalid: created_at negative"
    s = protocol.AuthSession("wss://relay.example:8080/x")
    tags = [["relay", "ws://relay.example:8080"], ["challenge", s.challenge]]
    assert s.authenticate(signed(2, 22242, NOW, tags), NOW) == "" and s.pubkeys == [KEYS[2]]
    assert s.authenticate(signed(2, 1, NOW, tags), NOW) == "auth-required: wrong event kind"
    assert s.authenticate(signed(2, 22242, NOW - 601, tags), NOW) == "auth-required: created_at out of range"
    assert s.authenticate(signed(2, 22242, NOW, tags[:1]), NOW) == "auth-required: bad challenge"
    assert s.authenticate(signed(2, 22242, NOW, [["relay", "ws://relay.example"], tags[1]]), NOW) == "auth-required: bad relay URL"


def test_published_signature_vector():
    key = bytes.fromhex("F9308A019258C31049344F85F89D5229B531C845836F99B08601F113BCE036F9")
    sig = bytes.fromhex("E907831F80848D1069A5371B402410364BDF1C5F8307B0084C55F1CE2DCA821525F66A4A85EA8B71E482A74F382D2CE5EBEEE8FDB2172F477DF4900D310536C0")
    assert bip340.public_key(3) == key and bip340.sign(3, bytes(32)) == sig and bip340.verify(key, bytes(32), sig)
    assert not bip340.verify(key, bytes(31) + b"\x01", sig) and not bip340.verify(b"\xff" * 32, bytes(32), sig)


def test_scalar_columns(spark):
    text = "".join(map(chr, range(128))) + "é\U0001f600"
    df = spark.createDataFrame([(text, [["expiration", " 12"], ["expiration", "+7"], ["expiration", "9"]], "ws://h:80/a/b")], "t string, tags array<array<string>>, u string")
    row = df.select(scalars.json_string(F.col("t")), scalars.expiry(F.col("tags")), scalars.url_domain(F.col("u")), scalars.hex_decode(F.lit("AB")), scalars.hex_decode(F.lit("00ff"))).first()
    assert row[0] == protocol.quote(text) and row[1] == 7 and row[2] == "h:80" and row[3] is None and bytes(row[4]) == b"\x00\xff"
    assert df.select(scalars.json_string(F.col("t"), True)).first()[0] == protocol.quote(text).replace("\\u0008", "\\b").replace("\\u000c", "\\f")
    good = "30001:" + "ab" * 32 + ":x:y"
    rows = spark.createDataFrame([(good,), ("1:" + "ab" * 32 + ":x",), ("30001:AB:x",), ("30001:x",)], "v string").select(scalars.coordinate(F.col("v")).alias("c")).collect()
    assert [r.c and r.c.d for r in rows] == ["x:y", None, None, None]


def test_import_and_policy(spark, tmp_path):
    old, new = signed(1, 0, 100), signed(1, 0, 200)
    note, eph, protected, dead = signed(2, 1, 150), signed(2, 20001, 150), signed(2, 1, 151, [["-"]]), signed(2, 1, 152, [["expiration", "1"]])
    vanish, after = signed(3, 62, 10), signed(3, 1, 11)
    lines = [json.dumps(new), "", json.dumps(["EVENT", note]), json.dumps(note), json.dumps(old), json.dumps(eph), json.dumps(protected), json.dumps(dead), json.dumps(vanish), json.dumps(after), "{bad", json.dumps(note | {"sig": "0" * 128, "id": note["id"]})[:-1]]
    (tmp_path / "in.jsonl").write_text("\n".join(lines))
    got = jsonl.import_jsonl(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "log"), NOW).first()
    assert tuple(got) == (6, 1, 4)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6
    # The same file again, with a newer and an older profile and a line of blanks: what is stored is known.
    newer = signed(1, 0, 300)
    (tmp_path / "more.jsonl").write_text("\n".join([*lines, " \t\u00a0 ", json.dumps(signed(1, 0, 250)), json.dumps(newer), json.dumps(newer)]))
    assert tuple(jsonl.import_jsonl(spark, str(tmp_path / "more.jsonl"), str(tmp_path / "log"), NOW).first()) == (2, 8, 4)
    kept = spark.read.parquet(str(tmp_path / "log")).collect()
    assert len({r.id for r in kept}) == len({r.seq for r in kept}) == len(kept) == 8
    parsed = jsonl.parse_lines(jsonl.numbered_lines(spark, str(tmp_path / "in.jsonl")), NOW)
    by = {(r.id, r.seq): (r.status, r.reason) for r in jsonl.with_status(parsed, NOW).collect()}
    of = lambda e: sorted(v for (i, _), v in by.items() if i == e["id"])
    assert of(note) == [("accepted", ""), ("duplicate", "duplicate: already have this event")]
    assert of(old) == [("rejected", "duplicate: older version")] and of(eph) == [("ephemeral", "")]
    assert of(protected) == [("rejected", "auth-required: protected event")] and of(dead) == [("rejected", "error: internal store error")]
    assert of(after) == [("rejected", "blocked: pubkey vanished")] and of(vanish) == [("accepted", "")]
    small = jsonl.parse_lines(jsonl.numbered_lines(spark, str(tmp_path / "in.jsonl")), NOW, limits=Limits(max_event_tags=0, content_bytes_by_kind={1: 3}), signatures=False, size_limits=True)
    assert {r.reason for r in small.collect()} >= {"invalid: too many tags", "invalid: content too long", "invalid: not valid JSON"}


def plain_outcomes(events, now, stored=()):
    """The relay's answers, one event after another."""
    known, best, gone, out = set(), {}, set(), []
    rank = lambda e: (e["created_at"], [-int(x, 16) for x in e["id"]])
    key = lambda e: (e["pubkey"], e["kind"])
    for old in stored:
        known.add(old["id"])
        best[key(old)] = max(best.get(key(old), rank(old)), rank(old))
        if old["kind"] == 62:
            gone.add(old["pubkey"])
    for e in events:
        expiry = next((int(t[1]) for t in e["tags"] if t[0] == "expiration"), None)
        if e["pubkey"] in gone:
            out.append("blocked: pubkey vanished")
        elif ["-"] in e["tags"]:
            out.append("auth-required: protected event")
        elif expiry is not None and expiry <= now:
            out.append("error: internal store error")
        elif e["id"] in known:
            out.append("duplicate: already have this event")
        elif e["kind"] == 0 and best.get(key(e), rank(e)) > rank(e):
            out.append("duplicate: older version")
        else:
            known.add(e["id"])
            best[key(e)] = rank(e)
            if e["kind"] == 62:
                gone.add(e["pubkey"])
            out.append("")
    return out


def test_outcomes_equal_a_sequential_relay(spark):
    rng = random.Random(77)
    rows = []
    for _ in range(300):
        tags = rng.choice([[], [], [], [["-"]], [["expiration", "1"]]])
        e = {"pubkey": f"{rng.randrange(6):064x}", "created_at": rng.randrange(8), "kind": rng.choice([0, 0, 0, 1, 62]) if rng.random() < 0.9 else 1, "tags": tags, "content": str(rng.randrange(3))}
        rows.append({"id": protocol.event_id(e), "sig": "0" * 128} | e)
    for before in (0, 100):
        stored = [e for e, said in zip(rows[:before], plain_outcomes(rows[:before], NOW), strict=True) if said == ""]
        df = log(spark, rows[before:]).select(*EVENT.fieldNames()).withColumn("reason", F.lit(""))
        old = log(spark, stored).select(*EVENT.fieldNames()) if before else None
        got = [r.reason for r in jsonl.with_status(df, NOW, stored=old).orderBy("seq").collect()]
        assert got == plain_outcomes(rows[before:], NOW, stored)


def test_index_record_and_frames():
    e = signed(3, 1, 1234, [["expiration", "99"], ["t", 'a"b\n']], "hi\u0001")
    record = based.index_record(e, 4)
    assert len(record) == 92 and record[:8] == (4).to_bytes(8, "little") and record[8:16] == (1234).to_bytes(8, "little") and record[16:24] == (99).to_bytes(8, "little")
    assert record[24:28] == b"\x01\0\0\0" and record[28:60].hex() == e["id"] and record[60:].hex() == e["pubkey"]
    for compress in (True, False):
        name, sub, said = json.loads(based.frame_of(based.serialize(e, compress), 'x"y'))
        assert (name, sub) == ("EVENT", 'x"y') and said == e


def test_many_filters_by_key_equal_their_predicates(spark):
    rng = random.Random(78)
    hexes = [f"{k:02x}" * 32 for k in range(12)]
    rows = []
    for n in range(250):
        tags = [[rng.choice("etp"), rng.choice(["x", "y", *hexes[:4]])] for _ in range(rng.randrange(4))] + rng.choice([[], [["long", "x"]], [["e"]]])
        rows.append({"id": f"{rng.randrange(16):x}{n:063x}", "pubkey": rng.choice(hexes), "created_at": rng.randrange(50), "kind": rng.choice([1, 7, 1059]), "tags": tags, "content": ""})
    events = log(spark, rows).cache()
    made = {}
    for k in range(130):
        f = {}
        for key, value in (("ids", [rng.choice(rows)["id"], rng.choice(["0a", rows[3]["id"]])]), ("authors", [rng.choice(hexes), rng.choice(hexes)[: rng.choice([2, 64])]]), ("kinds", [rng.choice([1, 7, 1059]) for _ in range(rng.randrange(3))]), ("since", rng.randrange(50)), ("until", rng.randrange(50)), ("#e", ["x", hexes[0]]), ("#t", ["y", "x"])):
            if rng.random() < 0.3:
                f[key] = value
        if rng.random() < 0.5:
            f["limit"] = rng.randrange(4)
        made[f"s{k}"] = Filter.parse(f)
    auth = [hexes[1]]
    every = {name: sorted(r.seq for r in events.where(f.predicate() & __import__("relaylake.filters", fromlist=["x"]).gift_wrap_visible(auth)).select("seq").collect()) for name, f in made.items()}
    assert sum(map(len, every.values())) > 200
    got = {}
    for r in query.request_batch(events, made, auth_pubkeys=auth).collect():
        got.setdefault(r.sub_id, []).append(r.seq)
    assert {k: sorted(v) for k, v in got.items()} == {k: v[-made[k].clamped(500) :] for k, v in every.items() if v and made[k].clamped(500)}
    subs = {f"{k}": Subscription([made[f"s{k}"], made[f"s{k + 1}"]], auth) for k in range(0, 130, 2)} | {f"n{k}": Subscription([made[f"s{k}"]]) for k in range(20)}
    many = sorted((r.sub_id, r.seq) for r in deliver(events, subs).collect())
    few = sorted((r.sub_id, r.seq) for part in (dict(list(subs.items())[:50]), dict(list(subs.items())[50:])) for r in deliver(events, part).collect())
    assert many == few and request_empty(spark, events)


def request_empty(spark, events):
    return query.request_batch(events, {}).count() == 0 and query.request_batch(events, {"a": Filter(ids=[])}).count() == 0


def test_batched_requests_limit_before_the_shuffle(spark):
    rows = log(spark, [signed(1, 1, k) for k in range(12)])
    found = query.request_batch(rows, {"a": Filter(kinds=[1], limit=2), "b": Filter(limit=5), "c": Filter(limit=0)})
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.sub_id, r.seq) for r in found.collect()) == [("a", 10), ("a", 11), ("b", 7), ("b", 8), ("b", 9), ("b", 10), ("b", 11)]


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text(max_size=200), min_size=1, max_size=4), max_size=5), st.text(max_size=300), st.integers(-(2**63), 2**63 - 1), st.integers(0, 65535))
def test_binary_codec_round_trip(tags, content, created_at, kind):
    e = {"id": "ab" * 32, "pubkey": "cd" * 32, "sig": "ef" * 64, "created_at": created_at, "kind": kind, "tags": tags + [["e", "0f" * 32]], "content": content}
    for compress in (True, False):
        blob = based.serialize(e, compress)
        assert based.deserialize(blob) == e and based.created_at_of(blob) == created_at
    assert len(based.serialize(e)) < len(based.serialize(e, False))


def test_varints():
    for n in (0, 1, 127, 128, 300, 2**63):
        assert based.decode_varint(based.encode_varint(n), 0) == (n, len(based.encode_varint(n)))
    with pytest.raises(based.CodecError):
        based.decode_varint(b"\xff" * 11, 0)
    with pytest.raises(based.CodecError):
        based.decode_varint(b"\x80", 0)


def test_binary_source_and_sink(spark, tmp_path):
    spark.dataSource.register(based.BinaryEvents)
    rows = log(spark, [signed(1, k % 3, k, [["t", "x" * k]]) for k in range(20)]).select(*EVENT.fieldNames())
    rows.repartition(3).write.format("relay_binary").mode("append").option("path", str(tmp_path / "b")).save()
    back = spark.read.format("relay_binary").option("path", str(tmp_path / "b")).load()
    assert sorted(map(repr, back.collect())) == sorted(map(repr, rows.collect()))


def sync(ours, theirs):
    a, b = negentropy.Session(ours, initiator=True), negentropy.Session(theirs)
    message = a.initiate()
    for _ in range(20):
        message = a.reconcile(b.reconcile(message))
        if message is None:
            return a.have, a.need
    raise AssertionError("no end")


def test_reconciliation(spark):
    rng = random.Random(2)
    every = [(rng.randrange(1000), f"{rng.getrandbits(256):064x}") for _ in range(700)]
    ours, theirs = every[:500], every[200:]
    have, need = sync(ours, theirs)
    assert have == {i for _, i in every[:200]} and need == {i for _, i in every[500:]}
    assert sync(every, every) == (set(), set()) and sync([], every[:3])[1] == {i for _, i in every[:3]}
    a, b = (spark.createDataFrame(x, "created_at bigint, id string") for x in (ours, theirs))
    rows = negentropy.difference(a, b).collect()
    assert {r.id for r in rows if r.side == "have"} == have and {r.id for r in rows if r.side == "need"} == need
    want = negentropy.fingerprint_of(sum(int.from_bytes(bytes.fromhex(i), "little") for _, i in ours), len(ours)).hex()
    assert negentropy.fingerprint(a) == want
    assert query.over_cap(a, 499) and not query.over_cap(a, 500)


def test_sessions_of_a_connection(spark):
    rows = spark.createDataFrame([(k, f"{k:064x}") for k in range(5)], "created_at bigint, id string")
    first = negentropy.Session([(9, "ff" * 32)], initiator=True).initiate()
    some = negentropy.Sessions(max_records=5, most=1)
    assert some.message("s", first) == (None, "session not found")
    payload, reason = some.open("s", rows, first)
    assert payload and not reason and some.open("t", rows, first) == (None, "too many subscriptions")
    assert some.message("s", b"\x10") == (None, "unsupported negentropy protocol version") and some.message("s", first)[1] == "session not found"
    assert negentropy.Sessions(max_records=4).open("s", rows, first) == (None, "too many records for negentropy session")


def test_requests_beyond_the_limits():
    m = protocol.parse_message('["REQ","s",{},{},{}]')
    assert protocol.refuse_request(m, {"s"}, Limits(max_subscriptions=1)) == ""
    assert protocol.refuse_request(m, {"t"}, Limits(max_subscriptions=1)) == "too many subscriptions"
    assert protocol.refuse_request(m, set(), Limits(max_filters=2)) == "too many filters"


def test_limits_from_the_environment():
    got = Limits.from_env({"RELAY_MAX_LIMIT": "7", "RELAY_MAX_FILTERS": "x", "RELAY_MAX_SUBID_LENGTH": "900", "RELAY_CONTENT_BYTES_BY_KIND": "1:5,30001:9"})
    assert (got.max_limit, got.max_filters, got.max_subid_length, got.content_limit(30001), got.content_limit(2)) == (7, 10, 64, 9, 51_200)
    with pytest.raises(ValueError, match="malformed"):
        Limits.from_env({"RELAY_CONTENT_BYTES_BY_KIND": "1=5"})


def test_connection_limits_and_replaces():
    from relaylake.streaming.live import Connection

    class Q:
        stopped = False

        def stop(self):
            self.stopped = True

    a, b = Q(), Q()
    c = Connection(most=1)
    assert c.open("s", lambda: a) and c.open("s", lambda: b) and a.stopped and not c.open("t", Q)
    c.disconnect()
    assert b.stopped and not c.queries


def test_latency_summary(spark):
    df = spark.createDataFrame([(x,) for x in range(1, 101)], "us bigint")
    assert tuple(query.latency_summary(df, "us").first()) == (51, 100, 50.5)
