"""A protocol data set derived from the driver's ``events`` table, and its twin as DuckDB SQL.

Arrival order is the event number; ids and keys are hashes of numbers, so they
are not signed. ``extended`` adds vanish requests of three users half-way, and
turns some clicks into ephemeral events.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import with_derived
from ..operators.state import accepted, visible
from ..schema import EVENT_COLUMNS

NOW = 1_705_276_800


def _sha(column):
    return F.sha2(column.cast("string"), 256)


def total(spark: SparkSession, sf_dir: str) -> int:
    return spark.read.parquet(f"{sf_dir}/events.parquet").count()


def protocol_events(spark: SparkSession, sf_dir: str, *, extended: bool = False, ranges: int | None = None) -> DataFrame:
    """The events of the table; with ``ranges`` in so many partitions by arrival, formed before ids, signatures and tags are made."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("seq"), "user_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    totals = raw.agg(F.count_distinct("user_id").alias("users"), F.count(F.lit(1)).alias("total")).first()
    own = Window.partitionBy("user_id").orderBy("seq")
    kind = (
        F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", F.when(F.col("k") % 10 == 0, 1059).otherwise(7)).when(F.col("event_type") == "signup", 0)
        .when(F.col("event_type") == "purchase", 30001).otherwise(5)
    )
    rows = raw.select("*", F.lag("seq").over(own).alias("prev_own"), F.lead("seq").over(own).alias("next_own"))
    if ranges is not None:
        rows = rows.repartitionByRange(ranges, "seq")
    if extended:
        # Three rows at most, so the kind is an expression over the row and needs no window.
        half = raw.where(F.col("user_id").isin(1, 2, 3) & (F.col("seq") >= totals.total // 2)).groupBy("user_id").agg(F.min("seq").alias("vs")).collect()
        leaves = reduce(lambda a, b: a | b, [(F.col("user_id") == r.user_id) & (F.col("seq") == r.vs) for r in half], F.lit(False))
        kind = F.when(leaves, 62).when((F.col("event_type") == "click") & (F.col("k") % 10 == 1), 20001).otherwise(kind)
    rows = rows.select("*", kind.cast("int").alias("kind"), _sha(F.col("seq")).alias("id"), _sha(F.col("user_id")).alias("pubkey"), (F.col("t") - 7200 * (F.col("k") % 3)).alias("created_at"))
    c, k = F.col, F.col("k")
    tag = lambda when, name, value: F.when(when & value.isNotNull(), F.array(F.lit(name), value))
    tags = F.array_compact(
        F.array(
            tag(c("kind").isin(1, 7) & (c("seq") > 0), "e", _sha(c("seq") - 1)),
            tag(c("kind").isin(1, 7, 1059), "p", _sha((c("user_id") + 1) % totals.users)),
            tag(c("kind") == 1, "t", F.concat(F.lit("topic"), (k % 8).cast("string"))),
            tag(c("kind") == 30001, "d", F.concat(F.lit("d"), (k % 5).cast("string"))),
            tag((c("kind") == 1) & (k % 6 == 0), "expiration", (c("created_at") + 86400 * (1 + k % 20)).cast("string")),
            tag((c("kind") == 1) & (k % 25 == 0), "-", F.lit("")),
            tag((c("kind") == 5) & (k % 4 == 0), "e", _sha(c("prev_own"))),
            tag((c("kind") == 5) & (k % 4 == 1), "a", F.concat(F.lit("30001:"), c("pubkey"), F.lit(":d"), (k % 5).cast("string"))),
            tag((c("kind") == 5) & (k % 4 == 2), "e", _sha(c("seq") - 1)),
            tag((c("kind") == 5) & (k % 4 == 3), "e", _sha(c("next_own"))),
        )
    )
    content = F.concat(c("event_type"), F.lit(' "'), k.cast("string"), F.lit('"\n\t\\'))
    sig = F.concat(F.sha2(F.concat(c("id"), F.lit("r")), 256), F.sha2(F.concat(c("id"), F.lit("s")), 256))
    return rows.select("seq", "id", "pubkey", sig.alias("sig"), "created_at", "kind", tags.alias("tags"), content.alias("content")).select(*EVENT_COLUMNS)


#: Events of up to so many bytes of Parquet are cached with their derived tables, whole rows of each.
#: From larger ones each query makes the columns that it needs, so no copy takes the memory of shuffles.
KEEP_BYTES = 8 << 20
_kept: dict[tuple[str, str, str, bool], DataFrame] = {}


def _keep(spark: SparkSession, sf_dir: str, name: str, extended: bool, make) -> DataFrame:
    """One table per session, folder and kind of table: nearly all queries read the same few."""
    key = (spark.sparkContext.applicationId, sf_dir, name, extended)
    if key not in _kept:
        made = make()
        size = spark.read.parquet(f"{sf_dir}/events.parquet")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        _kept[key] = made.cache() if int(str(size)) <= KEEP_BYTES else made
    return _kept[key]


def log(spark: SparkSession, sf_dir: str, *, extended: bool = False) -> DataFrame:
    """The events with derived columns, before any rule."""
    return _keep(spark, sf_dir, "log", extended, lambda: with_derived(protocol_events(spark, sf_dir, extended=extended)))


def stored(spark: SparkSession, sf_dir: str, *, extended: bool = False) -> DataFrame:
    """The accepted log."""
    return _keep(spark, sf_dir, "stored", extended, lambda: accepted(log(spark, sf_dir, extended=extended)))


def seen(spark: SparkSession, sf_dir: str, *, extended: bool = False) -> DataFrame:
    """What requests can see."""
    return _keep(spark, sf_dir, "visible", extended, lambda: visible(stored(spark, sf_dir, extended=extended), NOW))


def counted(spark: SparkSession, sf_dir: str, *, extended: bool = False) -> DataFrame:
    """What counts and reconciliation see: vanished authors are hidden whole."""
    return _keep(spark, sf_dir, "counted", extended, lambda: visible(stored(spark, sf_dir, extended=extended), NOW, hide_vanished_62=True))


def sql_prelude(extended: bool = False) -> str:
    """CTEs ev, tg (tags), acc (accepted), latest, del_e, del_a, dead, vis (visible), cnt (for counts)."""
    basic = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN CASE WHEN k % 10 = 0 THEN 1059 ELSE 7 END WHEN 'signup' THEN 0 WHEN 'purchase' THEN 30001 ELSE 5 END"
    kind = f"CASE WHEN user_id IN (1, 2, 3) AND seq = vs THEN 62 WHEN event_type = 'click' AND k % 10 = 1 THEN 20001 ELSE {basic} END" if extended else basic
    sha = lambda x: f"sha256(CAST({x} AS VARCHAR))"
    return f"""WITH n AS (SELECT count(DISTINCT user_id) AS users, count(*) AS total FROM events),
b0 AS (SELECT event_id AS seq, user_id, event_type, CAST(props->>'$.k' AS INT) AS k, CAST(floor(epoch(ts)) AS BIGINT) AS t,
         lag(event_id) OVER w AS prev_own, lead(event_id) OVER w AS next_own,
         min(CASE WHEN event_id >= (SELECT total // 2 FROM n) THEN event_id END) OVER (PARTITION BY user_id) AS vs
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
b AS (SELECT *, {sha('seq')} AS id, {sha('user_id')} AS pubkey, t - 7200 * (k % 3) AS created_at, {kind} AS kind, event_type || ' "' || k || '"' || chr(10) || chr(9) || '\\' AS content FROM b0),
tq AS (
  SELECT seq, 0 AS o, 'e' AS name, {sha('seq - 1')} AS value FROM b WHERE kind IN (1, 7) AND seq > 0
  UNION ALL SELECT seq, 1, 'p', {sha('(user_id + 1) % (SELECT users FROM n)')} FROM b WHERE kind IN (1, 7, 1059)
  UNION ALL SELECT seq, 2, 't', 'topic' || (k % 8) FROM b WHERE kind = 1
  UNION ALL SELECT seq, 3, 'd', 'd' || (k % 5) FROM b WHERE kind = 30001
  UNION ALL SELECT seq, 4, 'expiration', CAST(created_at + 86400 * (1 + k % 20) AS VARCHAR) FROM b WHERE kind = 1 AND k % 6 = 0
  UNION ALL SELECT seq, 5, '-', '' FROM b WHERE kind = 1 AND k % 25 = 0
  UNION ALL SELECT seq, 6, 'e', {sha('prev_own')} FROM b WHERE kind = 5 AND k % 4 = 0 AND prev_own IS NOT NULL
  UNION ALL SELECT seq, 7, 'a', '30001:' || pubkey || ':d' || (k % 5) FROM b WHERE kind = 5 AND k % 4 = 1
  UNION ALL SELECT seq, 8, 'e', {sha('seq - 1')} FROM b WHERE kind = 5 AND k % 4 = 2
  UNION ALL SELECT seq, 9, 'e', {sha('next_own')} FROM b WHERE kind = 5 AND k % 4 = 3 AND next_own IS NOT NULL),
tg AS (SELECT seq, CAST(row_number() OVER (PARTITION BY seq ORDER BY o) - 1 AS INT) AS pos, name, value FROM tq),
ev AS (SELECT seq, id, pubkey, created_at, kind, content, user_id, k,
         CASE WHEN kind = 5 THEN 'deletion' WHEN kind = 62 THEN 'vanish' WHEN kind IN (0, 3) OR kind BETWEEN 10000 AND 19999 THEN 'replaceable'
              WHEN kind BETWEEN 20000 AND 29999 THEN 'ephemeral' WHEN kind BETWEEN 30000 AND 39999 THEN 'addressable' ELSE 'regular' END AS kind_class,
         CASE WHEN kind = 30001 THEN 'd' || (k % 5) END AS d_value,
         CASE WHEN kind = 1 AND k % 6 = 0 THEN created_at + 86400 * (1 + k % 20) END AS expiry FROM b),
van AS (SELECT pubkey, min(seq) AS vanish_seq FROM ev WHERE kind = 62 GROUP BY pubkey),
acc AS (SELECT e.* FROM ev e LEFT JOIN van v ON e.pubkey = v.pubkey WHERE kind_class <> 'ephemeral' AND (v.vanish_seq IS NULL OR e.seq <= v.vanish_seq)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY pubkey, kind, coalesce(d_value, ''), CASE WHEN kind_class IN ('replaceable', 'addressable') THEN '' ELSE id END ORDER BY created_at DESC, id) AS version_rank FROM acc),
dq AS (SELECT a.seq AS deletion_seq, a.pubkey, t.value AS target_id FROM acc a JOIN tg t ON a.seq = t.seq WHERE a.kind = 5 AND t.name = 'e' AND regexp_full_match(t.value, '[0-9a-f]{{64}}')),
del_e AS (SELECT a.seq AS target_seq, a.id AS target_id, min(d.deletion_seq) AS deletion_seq FROM acc a JOIN dq d ON a.id = d.target_id AND a.pubkey = d.pubkey WHERE a.kind <> 5 GROUP BY a.seq, a.id),
aq AS (SELECT a.seq AS deletion_seq, a.pubkey, CAST(string_split(t.value, ':')[1] AS INT) AS kind, string_split(t.value, ':')[3] AS d, string_split(t.value, ':')[2] AS owner FROM acc a JOIN tg t ON a.seq = t.seq WHERE a.kind = 5 AND t.name = 'a'),
del_a AS (SELECT a.seq AS target_seq, a.id AS target_id, max(d.deletion_seq) AS deletion_seq FROM acc a JOIN aq d ON a.pubkey = d.pubkey AND d.owner = d.pubkey AND a.kind = d.kind AND a.d_value = d.d WHERE a.seq < d.deletion_seq GROUP BY a.seq, a.id),
dead AS (SELECT target_id FROM del_e UNION SELECT target_id FROM del_a),
alive AS (SELECT * FROM ranked WHERE version_rank = 1 AND (expiry IS NULL OR expiry > {NOW}) AND id NOT IN (SELECT target_id FROM dead)),
vis AS (SELECT * FROM alive WHERE kind = 62 OR pubkey NOT IN (SELECT pubkey FROM van)),
cnt AS (SELECT * FROM alive WHERE pubkey NOT IN (SELECT pubkey FROM van))
"""
