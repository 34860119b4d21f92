"""Requests, counts and reports over a visible set."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Limits
from ..filters import FILTER_ROW, Filter, any_of, event_keys, filter_row, gift_wrap_visible, meets, probe_keys


def request(visible: DataFrame, filters: Sequence[Filter], *, auth_pubkeys: Sequence[str] = (), limits: Limits | None = None) -> DataFrame:
    """Stored rows of a REQ: each filter takes its last arrivals up to its limit, an event that
    several filters take comes several times, and all are ordered newest first."""
    limits = limits or Limits()
    open_ = visible.where(gift_wrap_visible(auth_pubkeys)) if any(f.may_hold_gift_wraps for f in filters) else visible
    parts = []
    for f in filters:
        n = f.clamped(limits.max_limit)
        rows = open_.where(f.predicate())
        parts.append(rows.where(F.lit(False)) if n == 0 else rows.orderBy(F.desc("seq")).limit(n))
    if not parts:
        return visible.where(F.lit(False))
    return reduce(DataFrame.unionAll, parts).orderBy(F.desc("created_at"), "id")


#: Filters up to this number are looked up by a broadcast; more by a shuffled join.
BROADCAST_FILTERS = 100_000


def ranked(events: DataFrame, wanted: list[tuple[str, Filter, int, Sequence[str]]]) -> DataFrame:
    """(f, event...): each event with each filter (name, filter, limit, authenticated keys) that it meets, once.

    Both sides have keys (an id, an author, a tag or a kind) by which they are joined;
    the whole filter is tested on what meets. An event that shares several keys with a
    filter keeps the pair of the first one.
    """
    spark = events.sparkSession
    rows = [filter_row(name, f, n, auth) + (sorted(set(probe_keys(f))),) for name, f, n, auth in wanted]
    filters = spark.createDataFrame(rows, f"{FILTER_ROW}, keys array<string>")
    probes = filters.select(F.explode("keys").alias("key"), F.struct(*filters.columns).alias("f"))
    small = sum(len(r[-1]) for r in rows) <= BROADCAST_FILTERS
    # Only keys of kinds that some filter has are made into rows.
    used = sorted({k[0] for r in rows for k in r[-1]})
    tagged = any(f.tags or auth for _, f, _, auth in wanted)
    keyed = events.withColumn("__keys", event_keys(used)).withColumn("__key", F.explode("__keys"))
    met = keyed.join(F.broadcast(probes) if small else probes, F.col("__key") == F.col("key"))
    once = F.col("__key") == F.get(F.array_intersect("__keys", "f.keys"), F.lit(0))
    return met.where(once & meets("f", tagged)).select("f", *events.columns)


def request_batch(visible: DataFrame, named: Mapping[str, Filter], *, auth_pubkeys: Sequence[str] = (), limits: Limits | None = None) -> DataFrame:
    """(sub_id, event...) for many filters in one job: events and filters are joined by key.

    A top-k of each filter runs in each task before the shuffle, so what moves is
    bounded by filters x limit x tasks.
    """
    limits = limits or Limits()
    top = ranked(visible, [(name, f, f.clamped(limits.max_limit), auth_pubkeys) for name, f in named.items()])
    w = Window.partitionBy("f.sub_id").orderBy(F.desc("seq"))
    # A constant bound first: Spark turns it into a limit of each task, before the shuffle.
    most = max([f.clamped(limits.max_limit) for f in named.values()], default=0)
    top = top.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= F.lit(most)).where("__n <= f.n")
    return top.select("f.sub_id", *visible.columns)


def count(visible_for_counts: DataFrame, filters: Sequence[Filter], *, auth_pubkeys: Sequence[str] = ()) -> DataFrame:
    """One row (count): events that meet any filter, each once; limits do not apply, no filters count 0."""
    rows = visible_for_counts.where(any_of(filters)) if filters else visible_for_counts.where(F.lit(False))
    return rows.where(gift_wrap_visible(auth_pubkeys)).agg(F.count(F.lit(1)).alias("count"))


def by_kind(visible: DataFrame) -> DataFrame:
    return visible.groupBy("kind").agg(F.count(F.lit(1)).alias("count"))


def by_author(visible: DataFrame) -> DataFrame:
    return visible.groupBy("pubkey").agg(F.count(F.lit(1)).alias("count"))


def items(visible_for_counts: DataFrame, f: Filter, *, auth_pubkeys: Sequence[str] = ()) -> DataFrame:
    """(created_at, id) in order, for set reconciliation; the filter's limit is ignored."""
    rows = visible_for_counts.where(f.predicate()).where(gift_wrap_visible(auth_pubkeys))
    return rows.select("created_at", "id").orderBy("created_at", "id")


def over_cap(found: DataFrame, cap: int) -> bool:
    """Whether a reconciliation set has more than ``cap`` records; stops counting there."""
    return found.limit(cap + 1).count() > cap


def latency_summary(samples: DataFrame, column: str) -> DataFrame:
    """p50, p99 and mean, by the element at length * p / 100."""
    # Counted by value, so one row a distinct latency is ranked, and no list of samples is made.
    counts = samples.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    upto = counts.select("v", "n", F.sum("n").over(Window.orderBy("v")).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("total"))
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("total") * p / 100), F.col("total") - 1), F.col("v")))
    return upto.agg(at(50).alias("p50"), at(99).alias("p99"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"))
