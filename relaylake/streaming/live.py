"""Live subscriptions and stateful resolution with Structured Streaming.

A deletion takes back rows that were sent before, which an append stream cannot;
the stateful operators therefore emit changes, and the state of a moment is what
the latest change of each key says.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..config import CREATED_AT_WINDOW
from ..functions.scalars import AUTH_KIND, DELETION, with_derived
from ..operators.fanout import Subscription, deliver
from ..schema import EVENT


def read_events(spark: SparkSession, path: str, *, files_per_trigger: int = 1) -> DataFrame:
    """A stream of events from a folder of Parquet files, with derived columns."""
    return with_derived(spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(path))


def admissible(events: DataFrame, now: int) -> DataFrame:
    """The time bound on arrival: not negative and not more than two days ahead; there is no lower bound on age."""
    return events.where(F.col("created_at").between(0, now + CREATED_AT_WINDOW))


def storable(events: DataFrame) -> DataFrame:
    return events.where((F.col("kind_class") != "ephemeral") & (F.col("kind") != AUTH_KIND))


def broadcastable(events: DataFrame) -> DataFrame:
    """What goes to subscribers: ephemeral events too, authentication never."""
    return events.where(F.col("kind") != AUTH_KIND)


def first_arrivals(events: DataFrame) -> DataFrame:
    """Drop ids that came before; the state is unbounded, as the log's own set of known ids is."""
    return events.dropDuplicates(["id"])


def subscribe(events: DataFrame, subscriptions: Mapping[str, Subscription], *, now: int, after_seq: int | None = None) -> DataFrame:
    """Live deliveries. ``after_seq`` starts behind the snapshot that answered the stored part, so nothing falls between."""
    live = broadcastable(events)
    if after_seq is not None:
        live = live.where(F.col("seq") > after_seq)
    return deliver(live, subscriptions, now)


def _wins(a: tuple[int, str], b: tuple[int, str]) -> bool:
    """Whether version a replaces version b."""
    return a[0] > b[0] or (a[0] == b[0] and a[1] < b[1])


#: Keys of versions are kept together in so many buckets; a checkpoint is bound to their number.
BUCKETS = 256


def latest_versions(events: DataFrame) -> DataFrame:
    """Changes (op, pubkey, kind, d_value, created_at, id): "set" when a version becomes current, "drop" for the one it replaces.

    The state of a bucket is the list of its current versions, so Python is called once
    a bucket and batch and not once a key.
    """
    names = ["pubkey", "kind", "d_value", "created_at", "id"]

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current = {(p, k, d): (t, i) for p, k, d, t, i in json.loads(state.get[0])} if state.exists else {}
        before: dict[tuple, tuple | None] = {}
        for batch in batches:
            for *key, t, i in zip(*(batch[n].tolist() for n in names), strict=True):
                old = current.get(key := tuple(key))
                if old is None or _wins((t, i), old):
                    before.setdefault(key, old)
                    current[key] = (t, i)
        if before:
            state.update((json.dumps([(*key, *v) for key, v in current.items()]),))
            rows = [("set", *key, *current[key]) for key in before] + [("drop", *key, *old) for key, old in before.items() if old]
            yield pd.DataFrame(rows, columns=["op", *names])

    versioned = events.where(F.col("kind_class").isin("replaceable", "addressable")).withColumn("d_value", F.coalesce("d_value", F.lit("")))
    bucket = F.pmod(F.xxhash64("pubkey", "kind", "d_value"), F.lit(BUCKETS)).alias("bucket")
    out = "op string, pubkey string, kind int, d_value string, created_at bigint, id string"
    return versioned.select(bucket, *names).groupBy("bucket").applyInPandasWithState(run, out, "current string", "append", GroupStateTimeout.NoTimeout)


def deletions_by_id(events: DataFrame) -> DataFrame:
    """(target_id, pubkey) of each e-tag deletion, when both it and its target have come, in either order.

    Stored events and deletions are joined by a 128-bit digest of id and author, all that
    the state keeps of an event; of a deletion it keeps its target and author. No row runs
    in Python.
    """
    named = lambda i: F.substring(F.unhex(F.sha2(F.concat_ws(":", i, "pubkey"), 256)), 1, 16)
    targets = events.where(F.col("kind") != DELETION).select(named(F.col("id")).alias("__target"))
    tags = events.where(F.col("kind") == DELETION).select("pubkey", F.explode("tags").alias("t"))
    asked = tags.where((F.get("t", F.lit(0)) == "e") & F.get("t", F.lit(1)).rlike("^[0-9a-f]{64}$")).select(F.get("t", F.lit(1)).alias("target_id"), "pubkey")
    met = asked.withColumn("__asked", named(F.col("target_id"))).join(targets, F.col("__asked") == F.col("__target"))
    return met.dropDuplicates(["target_id", "pubkey"]).select("target_id", "pubkey")


#: State lies in RocksDB, on disk and within a bound of memory, and not in the heap.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


def kind_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("kind").agg(F.count(F.lit(1)).alias("count"))


def drain(stream: DataFrame, path: str, *, mode: str = "append") -> dict | None:
    """Run a stream over what its source has now, into Parquet under ``path``; returns the progress of its last batch."""
    conf = stream.sparkSession.conf
    before = {k: conf.get(k, None) for k in STATE}
    try:
        for k, v in STATE.items():
            conf.set(k, v)
        query: StreamingQuery = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{path}-state").option("path", path).trigger(availableNow=True).start()
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    query.awaitTermination()
    return query.lastProgress


class Connection:
    """The subscriptions of one client: opened, replaced and closed by name, within a limit."""

    def __init__(self, most: int = 20):
        self.most, self.queries = most, {}

    def open(self, sub_id: str, start) -> bool:
        """Start a query for ``sub_id`` in place of an earlier one; False where the limit is reached."""
        if sub_id not in self.queries and len(self.queries) >= self.most:
            return False
        self.close(sub_id)
        self.queries[sub_id] = start()
        return True

    def close(self, sub_id: str) -> None:
        if query := self.queries.pop(sub_id, None):
            query.stop()

    def disconnect(self) -> None:
        for sub_id in list(self.queries):
            self.close(sub_id)
