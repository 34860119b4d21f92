"""Registered queries: each a Spark plan and, where SQL can say it, its DuckDB twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..filters import Filter
from ..functions import bip340, scalars
from ..operators import compact, negentropy, query, state
from ..operators.fanout import Subscription, deliver
from ..sources import catalog
from ..sources.catalog import NOW
from ..schema import EVENT_COLUMNS
from ..storage import fresh_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SHOWN = ["seq", "id", "pubkey", "created_at", "kind", "content"]


def sha_text(n) -> str:
    import hashlib

    return hashlib.sha256(str(n).encode()).hexdigest()


U1, U2, U3 = sha_text(1), sha_text(2), sha_text(3)


def register(sql: str | None = None, *, extended: bool = False, name: str | None = None):
    """Add a query; ``sql`` follows the common table expressions of the catalog."""
    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = catalog.sql_prelude(extended) + sql
        return f

    return add


def _req(key: str, filters: list[dict], sql: str, *, auth: tuple[str, ...] = (), extended: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        parsed = [Filter.parse(f) for f in filters]
        return query.request(catalog.seen(spark, sf_dir, extended=extended), parsed, auth_pubkeys=auth).select(*SHOWN)

    register(sql, extended=extended, name=key)(run)


def _top(condition: str, limit: int = 500, open_: str = "kind <> 1059") -> str:
    return f"(SELECT {', '.join(SHOWN)} FROM vis WHERE {open_} AND ({condition}) ORDER BY seq DESC LIMIT {limit})"


def _tagged(name: str, *values: str) -> str:
    return f"seq IN (SELECT seq FROM tg WHERE name = '{name}' AND value IN ({', '.join(repr(v) for v in values)}))"


_req("req_kind_limit", [{"kinds": [1], "limit": 100}], _top("kind = 1", 100))
_req("req_kinds_multi", [{"kinds": [0, 7, 30001], "limit": 300}], _top("kind IN (0, 7, 30001)", 300))
_req("req_ids_exact", [{"ids": [sha_text(n) for n in range(3, 60)]}], _top("id IN (" + ", ".join(f"'{sha_text(n)}'" for n in range(3, 60)) + ")"))
_req("req_ids_prefix", [{"ids": ["ab", "1234", "0f"]}], _top("id LIKE 'ab%' OR id LIKE '1234%' OR id LIKE '0f%'"))
_req("req_authors_exact", [{"authors": [U1, U2]}], _top(f"pubkey IN ('{U1}', '{U2}')"))
_req("req_authors_prefix", [{"authors": ["4e", "6b86"]}], _top("pubkey LIKE '4e%' OR pubkey LIKE '6b86%'"))
_req("req_since", [{"since": 1_705_000_000}], _top("created_at >= 1705000000"))
_req("req_until", [{"until": 1_704_200_000}], _top("created_at <= 1704200000"))
_req("req_window", [{"since": 1_704_300_000, "until": 1_704_600_000, "kinds": [1, 7]}], _top("created_at BETWEEN 1704300000 AND 1704600000 AND kind IN (1, 7)"))
_req("req_empty_ids", [{"ids": []}], _top("false"))
_req("req_limit_zero", [{"kinds": [1], "limit": 0}], _top("kind = 1", 0))
_req("req_limit_clamped", [{"kinds": [7], "limit": 100_000}], _top("kind = 7", 500))
_req("req_arrival_vs_time", [{"kinds": [1, 7], "limit": 50}], _top("kind IN (1, 7)", 50))
_req("req_tag_e", [{"#e": [sha_text(n) for n in range(100, 180)]}], _top(_tagged("e", *[sha_text(n) for n in range(100, 180)])))
_req("req_tag_p", [{"#p": [U1]}], _top(_tagged("p", U1)))
_req("req_tag_t_or", [{"#t": ["topic3", "topic5"]}], _top(_tagged("t", "topic3", "topic5")))
_req("req_tags_and", [{"#t": ["topic3"], "#p": [sha_text(n) for n in range(40)]}], _top(_tagged("t", "topic3") + " AND " + _tagged("p", *[sha_text(n) for n in range(40)])))
_req("req_tag_empty_values", [{"#t": []}], _top("false"))
_req("req_multi_filter_dups", [{"kinds": [1], "limit": 60}, {"#t": ["topic1", "topic2"], "limit": 60}], _top("kind = 1", 60) + " UNION ALL " + _top(_tagged("t", "topic1", "topic2"), 60))
_req("req_kind_author_tag_combo", [{"kinds": [1, 7], "authors": ["4e", "d4", "ef"], "#p": [sha_text(n) for n in range(60)], "since": 1_704_100_000}], _top("kind IN (1, 7) AND (pubkey LIKE '4e%' OR pubkey LIKE 'd4%' OR pubkey LIKE 'ef%') AND created_at >= 1704100000 AND " + _tagged("p", *[sha_text(n) for n in range(60)])))
_GIFT = "kind <> 1059 OR " + "seq IN (SELECT seq FROM tg WHERE name = 'p' AND value IN ({}))"
_req("giftwrap_unauth", [{"kinds": [1059]}], _top("kind = 1059"))
_req("giftwrap_auth_one", [{"kinds": [1059, 7], "limit": 400}], _top("kind IN (7, 1059)", 400, "(" + _GIFT.format(f"'{U1}'") + ")"), auth=(U1,))
_req("giftwrap_auth_many", [{"kinds": [1059]}], _top("kind = 1059", 500, "(" + _GIFT.format(f"'{U1}', '{U2}', '{U3}', '{sha_text(4)}'") + ")"), auth=(U1, U2, U3, sha_text(4)))


@register("SELECT DISTINCT " + ", ".join(SHOWN) + f" FROM acc WHERE kind <> 1059 AND (kind = 0 OR {_tagged('t', 'topic1')} OR pubkey = '{U1}') AND (expiry IS NULL OR expiry > {NOW})")
def live_match_once(spark, sf_dir):
    """An event that several filters of a subscription take is delivered once."""
    subs = {"s": Subscription([Filter(kinds=[0]), Filter(tags={"t": ["topic1"]}), Filter(authors=[U1])])}
    return deliver(catalog.stored(spark, sf_dir), subs, NOW).select(*SHOWN)


_SUBS = {
    "kinds": Subscription([Filter(kinds=[1, 7])]),
    "topic": Subscription([Filter(tags={"t": ["topic2"]}), Filter(kinds=[0], until=1_704_500_000)]),
    "wraps": Subscription([Filter(kinds=[1059])], [U1, U2]),
    "nobody": Subscription([Filter(ids=[])]),
    "late": Subscription([Filter(since=1_705_200_000)]),
}


@register(
    f"""SELECT 'kinds' AS sub_id, seq FROM acc WHERE kind IN (1, 7) AND (expiry IS NULL OR expiry > {NOW})
UNION ALL SELECT 'topic', seq FROM acc WHERE kind <> 1059 AND ({_tagged('t', 'topic2')} OR (kind = 0 AND created_at <= 1704500000)) AND (expiry IS NULL OR expiry > {NOW})
UNION ALL SELECT 'wraps', seq FROM acc WHERE kind = 1059 AND {_tagged('p', U1, U2)}
UNION ALL SELECT 'late', seq FROM acc WHERE kind <> 1059 AND created_at >= 1705200000 AND (expiry IS NULL OR expiry > {NOW})"""
)
def fanout_match_matrix(spark, sf_dir):
    return deliver(catalog.stored(spark, sf_dir), _SUBS, NOW).select("sub_id", "seq")


@register(
    """, named AS (SELECT 'k' || kind AS sub_id, seq, row_number() OVER (PARTITION BY kind ORDER BY seq DESC) AS r FROM vis WHERE kind IN (0, 1, 5, 7, 30001)
UNION ALL SELECT 'author' || a, seq, row_number() OVER (PARTITION BY a ORDER BY seq DESC) FROM vis JOIN (SELECT range AS a FROM range(20)) ON pubkey = sha256(CAST(a AS VARCHAR)) WHERE kind <> 1059)
SELECT sub_id, seq FROM named WHERE r <= 40"""
)
def req_many_filters(spark, sf_dir):
    """Many requests answered by one job."""
    named = {f"k{k}": Filter(kinds=[k], limit=40) for k in (0, 1, 5, 7, 30001)} | {f"author{a}": Filter(authors=[sha_text(a)], limit=40) for a in range(20)}
    return query.request_batch(catalog.seen(spark, sf_dir), named).select("sub_id", "seq")


# State resolution


@register("SELECT seq, id FROM (SELECT seq, id, row_number() OVER (PARTITION BY id ORDER BY seq) AS r FROM (SELECT seq, id FROM ev UNION ALL SELECT seq + 10000000, id FROM ev WHERE k % 3 = 0)) WHERE r = 1")
def dedup_by_id(spark, sf_dir):
    log = catalog.log(spark, sf_dir)
    again = log.join(catalog.protocol_events(spark, sf_dir).select("seq"), "seq", "left_semi").where(F.regexp_extract("content", '"(\\d+)"', 1).cast("int") % 3 == 0).withColumn("seq", F.col("seq") + 10_000_000)
    return state.first_by_id(log.select("seq", "id").unionAll(again.select("seq", "id")))


@register("SELECT pubkey, kind, id, created_at FROM ranked WHERE kind_class = 'replaceable' AND version_rank = 1")
def replaceable_latest(spark, sf_dir):
    return state.with_version_rank(catalog.stored(spark, sf_dir)).where("kind_class = 'replaceable' and version_rank = 1").select("pubkey", "kind", "id", "created_at")


@register("SELECT pubkey, kind, d_value, id, created_at FROM ranked WHERE kind_class = 'addressable' AND version_rank = 1")
def addressable_latest(spark, sf_dir):
    return state.with_version_rank(catalog.stored(spark, sf_dir)).where("kind_class = 'addressable' and version_rank = 1").select("pubkey", "kind", "d_value", "id", "created_at")


@register(
    """, v AS (SELECT seq, id, created_at, pubkey, kind, coalesce(d_value, '') AS d, kind_class FROM acc WHERE kind_class IN ('replaceable', 'addressable')),
older AS (SELECT a.seq FROM v a JOIN v b ON a.pubkey = b.pubkey AND a.kind = b.kind AND a.d = b.d AND b.seq < a.seq AND (b.created_at > a.created_at OR (b.created_at = a.created_at AND b.id <= a.id)) GROUP BY a.seq),
replaced AS (SELECT a.seq FROM v a JOIN v b ON a.pubkey = b.pubkey AND a.kind = b.kind AND a.d = b.d AND b.seq > a.seq AND (b.created_at > a.created_at OR (b.created_at = a.created_at AND b.id < a.id)) GROUP BY a.seq)
SELECT seq, id, CASE WHEN seq IN (SELECT seq FROM older) THEN 'rejected' WHEN seq IN (SELECT seq FROM replaced) THEN 'superseded' ELSE 'current' END AS version_status FROM v"""
)
def superseded_versions(spark, sf_dir):
    rows = catalog.stored(spark, sf_dir).where(F.col("kind_class").isin("replaceable", "addressable"))
    return state.version_status(rows).select("seq", "id", "version_status")


@register("SELECT target_seq, target_id, deletion_seq FROM del_e")
def delete_e_confirmed(spark, sf_dir):
    return state.deleted_by_id(catalog.stored(spark, sf_dir))


@register("SELECT d.deletion_seq, d.target_id, a.seq AS target_seq FROM dq d JOIN acc a ON a.id = d.target_id WHERE a.pubkey <> d.pubkey")
def delete_e_cross_author_ignored(spark, sf_dir):
    log = catalog.stored(spark, sf_dir)
    target = log.select(F.col("id").alias("target_id"), F.col("seq").alias("target_seq"), F.col("pubkey").alias("owner"))
    return state.deletions(log).join(target, "target_id").where("owner != pubkey").select("deletion_seq", "target_id", "target_seq")


@register("SELECT d.deletion_seq, d.target_id, a.seq AS target_seq FROM dq d JOIN acc a ON a.id = d.target_id WHERE a.pubkey = d.pubkey AND a.kind = 5")
def delete_of_kind5_ignored(spark, sf_dir):
    log = catalog.stored(spark, sf_dir)
    target = log.where("kind = 5").select(F.col("id").alias("target_id"), F.col("seq").alias("target_seq"), "pubkey")
    return state.deletions(log).join(target, ["target_id", "pubkey"]).select("deletion_seq", "target_id", "target_seq")


@register("SELECT target_seq, target_id, deletion_seq FROM del_a")
def delete_a_confirmed(spark, sf_dir):
    return state.deleted_by_address(catalog.stored(spark, sf_dir))


@register("SELECT target_seq, target_id, deletion_seq FROM del_e WHERE deletion_seq < target_seq")
def delete_preemptive(spark, sf_dir):
    return state.deleted_by_id(catalog.stored(spark, sf_dir)).where("deletion_seq < target_seq")


@register("SELECT DISTINCT target_id, pubkey FROM dq WHERE target_id NOT IN (SELECT id FROM acc WHERE seq < (SELECT total // 2 FROM n)) AND deletion_seq < (SELECT total // 2 FROM n)")
def delete_pending(spark, sf_dir):
    """Deletions that wait for their target when half of the events have come."""
    log = catalog.stored(spark, sf_dir)
    half = catalog.log(spark, sf_dir).count() // 2
    return state.pending_deletions(log.where(F.col("seq") < half))


@register("SELECT seq, expiry FROM ev WHERE expiry IS NOT NULL")
def expiry_values(spark, sf_dir):
    return catalog.log(spark, sf_dir).where("expiry is not null").select("seq", "expiry")


@register(f"SELECT seq, id FROM ev WHERE kind = 1 AND (expiry IS NULL OR expiry > {NOW})")
def expiry_visible(spark, sf_dir):
    return catalog.log(spark, sf_dir).where((F.col("kind") == 1) & (F.col("expiry").isNull() | (F.col("expiry") > NOW))).select("seq", "id")


@register("SELECT a.seq, a.id FROM acc a JOIN van v ON a.pubkey = v.pubkey WHERE a.kind <> 62", extended=True)
def vanish_hidden(spark, sf_dir):
    log = catalog.stored(spark, sf_dir, extended=True)
    return log.where("kind != 62").join(state.vanished(log), "pubkey").select("seq", "id")


@register("SELECT e.seq, e.id FROM ev e JOIN van v ON e.pubkey = v.pubkey WHERE e.seq > v.vanish_seq AND e.kind_class <> 'ephemeral'", extended=True)
def vanish_blocked(spark, sf_dir):
    log = catalog.log(spark, sf_dir, extended=True).where("kind_class != 'ephemeral'")
    return log.join(state.vanished(log), "pubkey").where("seq > vanish_seq").select("seq", "id")


@register("SELECT seq, id FROM vis WHERE kind = 62", extended=True)
def vanish_kind62_kept(spark, sf_dir):
    return catalog.seen(spark, sf_dir, extended=True).where("kind = 62").select("seq", "id")


@register("SELECT CASE WHEN kind_class = 'ephemeral' THEN 'live' ELSE 'stored' END AS path, kind, count(*) AS count FROM ev GROUP BY ALL", extended=True)
def ephemeral_split(spark, sf_dir):
    path = F.when(F.col("kind_class") == "ephemeral", "live").otherwise("stored")
    return catalog.log(spark, sf_dir, extended=True).groupBy(path.alias("path"), "kind").agg(F.count(F.lit(1)).alias("count"))


@register("SELECT seq, id FROM ev WHERE seq IN (SELECT seq FROM tg WHERE name = '-')")
def protected_events(spark, sf_dir):
    return catalog.log(spark, sf_dir).where("is_protected").select("seq", "id")


@register("SELECT seq, id, pubkey, created_at, kind, content FROM vis")
def visible_events(spark, sf_dir):
    return catalog.seen(spark, sf_dir).select(*SHOWN)


@register("SELECT seq, id, pubkey, created_at, kind, content FROM vis", extended=True)
def visible_events_extended(spark, sf_dir):
    return catalog.seen(spark, sf_dir, extended=True).select(*SHOWN)


# Counts and reports


def _count(key: str, filters: list[dict], condition: str, *, auth: tuple[str, ...] = (), extended: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query.count(catalog.counted(spark, sf_dir, extended=extended), [Filter.parse(f) for f in filters], auth_pubkeys=auth)

    shown = "kind <> 1059" if not auth else "(" + _GIFT.format(", ".join(f"'{a}'" for a in auth)) + ")"
    register(f"SELECT count(*) AS count FROM cnt WHERE {shown} AND ({condition})", extended=extended, name=key)(run)


_count("count_kind", [{"kinds": [1, 7, 7]}], "kind IN (1, 7)")
_count("count_tag", [{"#t": ["topic4"]}], _tagged("t", "topic4"))
_count("count_union", [{"kinds": [1]}, {"#p": [U2]}, {"authors": ["4e"]}], f"kind = 1 OR {_tagged('p', U2)} OR pubkey LIKE '4e%'")
_count("count_no_filters", [], "false")
_count("count_empty_filter", [{"ids": []}], "false")
_count("count_everything", [{}], "true")
_count("count_kind_author", [{"kinds": [0, 1], "authors": [U1, U2, U3]}], f"kind IN (0, 1) AND pubkey IN ('{U1}', '{U2}', '{U3}')")
_count("count_giftwrap_auth", [{"kinds": [1059]}], "kind = 1059", auth=(U1, U2))
_count("count_vanished", [{"kinds": [62, 1]}], "kind IN (62, 1)", extended=True)


@register("SELECT kind, count(*) AS count FROM cnt GROUP BY kind", extended=True)
def report_by_kind(spark, sf_dir):
    return query.by_kind(catalog.counted(spark, sf_dir, extended=True))


@register("SELECT pubkey, count(*) AS count FROM cnt GROUP BY pubkey", extended=True)
def report_by_author(spark, sf_dir):
    return query.by_author(catalog.counted(spark, sf_dir, extended=True))


@register("SELECT (SELECT count(*) FROM dead) AS confirmed, (SELECT count(DISTINCT target_id) FROM dq WHERE target_id NOT IN (SELECT id FROM acc)) AS pending")
def tombstone_stats(spark, sf_dir):
    log = catalog.stored(spark, sf_dir)
    confirmed = state.tombstones(log).agg(F.count(F.lit(1)).alias("confirmed"))
    return confirmed.crossJoin(state.pending_deletions(log).agg(F.count_distinct("target_id").alias("pending")))


@register("SELECT count(*) AS count FROM acc", extended=True)
def event_count(spark, sf_dir):
    return catalog.stored(spark, sf_dir, extended=True).agg(F.count(F.lit(1)).alias("count"))


@register("SELECT kind, kind_class, count(*) AS count FROM ev GROUP BY ALL", extended=True)
def kind_classes(spark, sf_dir):
    return catalog.log(spark, sf_dir, extended=True).groupBy("kind", "kind_class").agg(F.count(F.lit(1)).alias("count"))


@register("SELECT seq, pos, name, value, CAST(2 AS INT) AS nfields FROM tg WHERE strlen(name) = 1")
def tag_index(spark, sf_dir):
    return state.event_tags(catalog.log(spark, sf_dir))


@register("SELECT deletion_seq, pubkey, kind, d FROM aq")
def deletion_coordinates(spark, sf_dir):
    return state.address_deletions(catalog.stored(spark, sf_dir))


@register("SELECT page_id, url, string_split(CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE url END, '/')[1] AS domain FROM pages")
def url_domains(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", scalars.url_domain(F.col("url")).alias("domain"))


# Functions

_ESC = "replace(replace(replace(replace(replace({}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
_TAGJ = "coalesce((SELECT string_agg('[\"' || name || '\",\"' || value || '\"]', ',' ORDER BY pos) FROM tg WHERE tg.seq = ev.seq), '')"
_CANON = f"""'[0,"' || pubkey || '",' || created_at || ',' || kind || ',[' || {_TAGJ} || '],"' || {_ESC.format('content')} || '"]'"""


@register(f"SELECT seq, {_CANON} AS canonical FROM ev")
def canonical_json(spark, sf_dir):
    c = F.col
    return catalog.log(spark, sf_dir).select("seq", scalars.canonical_json(c("pubkey"), c("created_at"), c("kind"), c("tags"), c("content")).alias("canonical"))


@register(f"SELECT seq, sha256({_CANON}) AS computed_id, sha256({_CANON}) = id AS valid FROM ev")
def event_id_recomputed(spark, sf_dir):
    c = F.col
    computed = scalars.event_id(c("pubkey"), c("created_at"), c("kind"), c("tags"), c("content"))
    return catalog.log(spark, sf_dir).select("seq", computed.alias("computed_id"), (computed == c("id")).alias("valid"))


@register(f"""SELECT seq, '["EVENT","sub \\"1\\"",{{"id":"' || id || '","pubkey":"' || pubkey || '","created_at":' || created_at || ',"kind":' || kind || ',"tags":[' || {_TAGJ} || '],"content":"' || {_ESC.format('content')} || '","sig":"' || sha256(id || 'r') || sha256(id || 's') || '"}}]' AS frame FROM ev""")
def event_frames(spark, sf_dir):
    return catalog.log(spark, sf_dir).select("seq", scalars.event_frame(F.lit('sub "1"')).alias("frame"))


@register(f"SELECT doc_id, {_ESC.format('text')} AS escaped FROM documents")
def escaped_texts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", scalars.json_escape(F.col("text")).alias("escaped"))


@register("SELECT seq, lower(hex(unhex(id))) AS hex, octet_length(unhex(id)) AS bytes FROM ev")
def hex_round_trip(spark, sf_dir):
    decoded = scalars.hex_decode(F.col("id"))
    return catalog.log(spark, sf_dir).select("seq", scalars.hex_encode(decoded).alias("hex"), F.octet_length(decoded).cast("bigint").alias("bytes"))


# Reconciliation, compaction, import, streams


@register("SELECT created_at, id FROM cnt WHERE kind IN (1, 7)", extended=True)
def neg_items(spark, sf_dir):
    return query.items(catalog.counted(spark, sf_dir, extended=True), Filter(kinds=[1, 7]))


@register(
    """, ours AS (SELECT * FROM cnt WHERE kind IN (1, 7) AND k % 10 < 7), theirs AS (SELECT * FROM cnt WHERE kind IN (1, 7) AND k % 10 > 3)
SELECT 'have' AS side, created_at, id FROM ours WHERE id NOT IN (SELECT id FROM theirs) UNION ALL SELECT 'need', created_at, id FROM theirs WHERE id NOT IN (SELECT id FROM ours)"""
)
def neg_have_need(spark, sf_dir):
    rows = catalog.counted(spark, sf_dir).where("kind in (1, 7)").withColumn("k", F.regexp_extract("content", '"(\\d+)"', 1).cast("int"))
    return negentropy.difference(rows.where("k % 10 < 7"), rows.where("k % 10 > 3"))


@register("SELECT count(*) > 1000 AS over_cap FROM cnt WHERE kind IN (1, 7)")
def neg_over_cap(spark, sf_dir):
    found = query.items(catalog.counted(spark, sf_dir), Filter(kinds=[1, 7]))
    return spark.createDataFrame([(query.over_cap(found, 1000),)], "over_cap boolean")


@register()
def neg_fingerprint(spark, sf_dir):
    found = query.items(catalog.counted(spark, sf_dir), Filter(kinds=[1, 7]))
    return spark.createDataFrame([(negentropy.fingerprint(found),)], "fingerprint string")


@register("SELECT seq, id FROM alive WHERE kind = 62 OR pubkey NOT IN (SELECT pubkey FROM van)", extended=True)
def compact_retained(spark, sf_dir):
    return compact.retained(catalog.stored(spark, sf_dir, extended=True), NOW).select("seq", "id")


_ARRIVED = """, arrived AS (SELECT seq, id, pubkey, created_at, kind, expiry, kind_class, k, coalesce(d_value, '') AS d FROM ev UNION ALL SELECT seq + 10000000, id, pubkey, created_at, kind, expiry, kind_class, k, coalesce(d_value, '') FROM ev WHERE seq % 4 = 0),
live AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq) AS nth FROM arrived WHERE {live}),
older AS (SELECT DISTINCT a.id FROM live a JOIN live b ON a.pubkey = b.pubkey AND a.kind = b.kind AND a.d = b.d AND b.seq < a.seq AND (b.created_at > a.created_at OR (b.created_at = a.created_at AND b.id < a.id)) WHERE a.kind_class IN ('replaceable', 'addressable') AND a.nth = 1),
stored AS (SELECT * FROM live WHERE nth = 1 AND id NOT IN (SELECT id FROM older))"""
_IMPORT_NOW = 1_704_500_000
_OPEN = f"(expiry IS NULL OR expiry > {_IMPORT_NOW})"


@register(
    _ARRIVED.format(live=_OPEN)
    + """
SELECT (SELECT count(*) FROM stored) AS imported, (SELECT count(*) FROM live WHERE nth > 1 AND id NOT IN (SELECT id FROM older)) AS duplicates,
  (SELECT count(*) FROM arrived) - (SELECT count(*) FROM live) + (SELECT count(*) FROM live WHERE id IN (SELECT id FROM older)) AS failures"""
)
def import_tallies(spark, sf_dir):
    """Tallies of an import in which every fourth event comes again: expired and outdated ones fail each time."""
    from ..sources.jsonl import tallies, with_status

    events = catalog.protocol_events(spark, sf_dir).withColumn("reason", F.lit(""))
    again = events.where("seq % 4 = 0").withColumn("seq", F.col("seq") + 10_000_000)
    return tallies(with_status(events.unionAll(again), _IMPORT_NOW, policy="import"))


@register(
    _ARRIVED.format(live=_OPEN)
    + """
SELECT CASE WHEN e.id IN (SELECT id FROM stored) THEN 'duplicate' ELSE 'rejected' END AS status,
  CASE WHEN e.id IN (SELECT id FROM stored) THEN 'duplicate: already have this event' WHEN e.id IN (SELECT id FROM older) THEN 'duplicate: older version' ELSE 'error: internal store error' END AS reason, count(*) AS count
FROM ev e GROUP BY ALL"""
)
def import_twice(spark, sf_dir):
    """What becomes of a file that is imported into a log that holds it already."""
    from ..sources.jsonl import with_status
    from ..storage import materialise

    events = catalog.protocol_events(spark, sf_dir).withColumn("reason", F.lit(""))
    log = materialise(with_status(events, _IMPORT_NOW, policy="import").where("status = 'accepted'").select(*EVENT_COLUMNS))
    second = with_status(events.withColumn("seq", F.col("seq") + 10_000_000), _IMPORT_NOW, policy="import", stored=log)
    return second.groupBy("status", "reason").agg(F.count(F.lit(1)).alias("count"))


_SHUT = "kind = 1 AND k % 25 = 0"


@register(
    _ARRIVED.format(
        live=f"{_OPEN} AND kind_class <> 'ephemeral' AND NOT ({_SHUT}) AND NOT EXISTS (SELECT 1 FROM (SELECT pubkey AS p, min(seq) AS v FROM ev WHERE kind = 62 GROUP BY pubkey) WHERE p = arrived.pubkey AND arrived.seq > v)"
    )
    + f""", late AS (SELECT a.seq FROM arrived a JOIN van v ON a.pubkey = v.pubkey WHERE a.seq > v.vanish_seq)
SELECT status, reason, count(*) AS count FROM (
  SELECT CASE WHEN a.seq IN (SELECT seq FROM late) OR {_SHUT} THEN 'rejected' WHEN kind_class = 'ephemeral' THEN 'ephemeral' WHEN NOT {_OPEN} OR id IN (SELECT id FROM older) THEN 'rejected'
    WHEN a.seq IN (SELECT seq FROM stored) THEN 'accepted' ELSE 'duplicate' END AS status,
  CASE WHEN a.seq IN (SELECT seq FROM late) THEN 'blocked: pubkey vanished' WHEN {_SHUT} THEN 'auth-required: protected event' WHEN kind_class = 'ephemeral' THEN '' WHEN NOT {_OPEN} THEN 'error: internal store error'
    WHEN id IN (SELECT id FROM older) THEN 'duplicate: older version' WHEN a.seq IN (SELECT seq FROM stored) THEN '' ELSE 'duplicate: already have this event' END AS reason
  FROM arrived a) GROUP BY ALL""",
    extended=True,
)
def policy_outcomes(spark, sf_dir):
    """How the relay answers each event, every fourth coming again: by status and reason."""
    from ..sources.jsonl import with_status

    events = catalog.protocol_events(spark, sf_dir, extended=True).withColumn("reason", F.lit(""))
    again = events.where("seq % 4 = 0").withColumn("seq", F.col("seq") + 10_000_000)
    return with_status(events.unionAll(again), _IMPORT_NOW).groupBy("status", "reason").agg(F.count(F.lit(1)).alias("count"))


#: The events come in so many batches, each of files of up to so many events.
BATCHES, FILE_EVENTS = 4, 250_000


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream from a folder of files that come one after another."""
    from ..streaming import live

    path = fresh_path(spark, "arrivals")
    each = max(1, -(-catalog.total(spark, sf_dir) // (BATCHES * FILE_EVENTS)))
    catalog.protocol_events(spark, sf_dir, ranges=BATCHES * each).write.parquet(path)
    return live.read_events(spark, path, files_per_trigger=each)


@register(f"SELECT 'topic' AS sub_id, seq, id FROM ev WHERE kind <> 1059 AND ({_tagged('t', 'topic2')} OR kind = 0) AND seq > 500 AND (expiry IS NULL OR expiry > {NOW})")
def stream_subscribe(spark, sf_dir):
    from ..streaming import live

    out = fresh_path(spark, "live")
    subs = {"topic": Subscription([Filter(tags={"t": ["topic2"]}), Filter(kinds=[0])])}
    live.drain(live.subscribe(_arrivals(spark, sf_dir), subs, now=NOW, after_seq=500).select("sub_id", "seq", "id"), out)
    return spark.read.schema("sub_id string, seq bigint, id string").parquet(out)


@register("SELECT pubkey, kind, coalesce(d_value, '') AS d_value, created_at, id FROM ranked WHERE kind_class IN ('replaceable', 'addressable') AND version_rank = 1")
def stream_latest_wins(spark, sf_dir):
    """What is current after all changes: set and not dropped."""
    from ..streaming import live

    out = fresh_path(spark, "versions")
    live.drain(live.latest_versions(live.storable(_arrivals(spark, sf_dir))), out)
    changes = spark.read.schema("op string, pubkey string, kind int, d_value string, created_at bigint, id string").parquet(out)
    return changes.groupBy("pubkey", "kind", "d_value", "created_at", "id").agg(F.sum(F.when(F.col("op") == "set", 1).otherwise(-1)).alias("n")).where("n > 0").drop("n")


@register("SELECT target_id, (SELECT pubkey FROM acc WHERE id = target_id) AS pubkey FROM del_e")
def stream_preemptive_delete(spark, sf_dir):
    from ..streaming import live

    out = fresh_path(spark, "deletions")
    live.drain(live.deletions_by_id(live.storable(_arrivals(spark, sf_dir))), out)
    return spark.read.schema("target_id string, pubkey string").parquet(out)


@register("SELECT seq, id FROM (SELECT seq, id, row_number() OVER (PARTITION BY id ORDER BY seq) AS r FROM ev) WHERE r = 1")
def stream_dedup(spark, sf_dir):
    from ..streaming import live

    out = fresh_path(spark, "first")
    live.drain(live.first_arrivals(_arrivals(spark, sf_dir)).select("seq", "id"), out)
    return spark.read.schema("seq bigint, id string").parquet(out)


@register("SELECT CAST(i // 2 + 1 AS INT) AS secret, sha256(CAST(i // 2 + 1 AS VARCHAR)) AS id, i % 2 = 0 AS valid FROM range(32) r(i)")
def schnorr_verify_vectors(spark, sf_dir):
    """Signatures by 16 keys over event ids, each also with one bit turned; the second of each pair is not valid."""
    rows = []
    for secret in range(1, 17):
        message = bytes.fromhex(sha_text(secret))
        key, sig = bip340.public_key(secret), bip340.sign(secret, message)
        rows += [(secret, key.hex(), message.hex(), sig.hex()), (secret, key.hex(), message.hex(), (sig[:-1] + bytes([sig[-1] ^ 1])).hex())]
    df = spark.createDataFrame(rows, "secret int, pubkey string, id string, sig string")
    return df.withColumn("valid", bip340.verify_udf()("pubkey", "id", "sig")).select("secret", "id", "valid")


#: Signed lines of a task.
SIGNED = 4096


@register("SELECT seq % 5 <> 4 AS valid, CASE WHEN seq % 5 = 4 THEN 'invalid: bad signature' ELSE '' END AS reason, count(*) AS count FROM ev WHERE seq % 16 = 0 AND created_at >= 0 GROUP BY ALL")
def signed_lines_validated(spark, sf_dir):
    """JSON lines of one event in sixteen, truly signed by 16 keys, every fifth by a wrong one: parsed, ids made anew, signatures verified."""
    from ..sources.jsonl import parse_lines

    c = F.col
    # Signing is long work on short rows, so tasks are formed by their number and not by bytes.
    events = catalog.protocol_events(spark, sf_dir).where("seq % 16 = 0")
    events = events.repartition(max(1, -(-catalog.total(spark, sf_dir) // (16 * SIGNED)))).withColumn("pubkey", bip340.key_udf()(c("seq")))
    events = events.withColumn("id", scalars.event_id(c("pubkey"), c("created_at"), c("kind"), c("tags"), c("content"))).withColumn("sig", bip340.sign_udf()(c("seq"), c("id")))
    lines = events.select("seq", F.regexp_extract(scalars.event_frame(F.lit("x")), r'(?s)^\["EVENT","x",(.*)\]$', 1).alias("line"))
    done = parse_lines(lines, 2 * NOW)
    return done.groupBy((F.col("reason") == "").alias("valid"), "reason").agg(F.count(F.lit(1)).alias("count"))
