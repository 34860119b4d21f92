"""Compaction: rewrite the log without what can never be seen again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Limits
from ..functions.scalars import VANISH
from .state import tombstones, vanished, with_version_rank


def superseded(log: DataFrame) -> DataFrame:
    return with_version_rank(log.where(F.col("kind_class").isin("replaceable", "addressable"))).where("version_rank > 1").select(F.col("id").alias("target_id"))


def confirmed(log: DataFrame) -> DataFrame:
    """Ids with a confirmed tombstone: deleted, replaced, or of a vanished author (kind 62 apart)."""
    gone = log.where(F.col("kind") != VANISH).join(vanished(log).select("pubkey"), "pubkey", "left_semi").select(F.col("id").alias("target_id"))
    return tombstones(log).unionAll(superseded(log)).unionAll(gone).distinct()


def retained(log: DataFrame, now: int) -> DataFrame:
    """The log without tombstoned, expired and vanished events."""
    alive = log.where(F.coalesce(F.col("expiry") > now, F.lit(True)))
    return alive.join(confirmed(log).withColumnRenamed("target_id", "id"), "id", "left_anti").select(*log.columns)


def compact(log: DataFrame, path: str, now: int) -> int:
    """Write the retained log to ``path``, ranged by arrival; returns the number of events kept."""
    retained(log, now).repartitionByRange("seq").sortWithinPartitions("seq").write.mode("overwrite").parquet(path)
    return log.sparkSession.read.parquet(path).count()


def due(log: DataFrame, limits: Limits) -> bool:
    """Whether compaction is worth a run: enabled, and more confirmed tombstones than the threshold."""
    return limits.compaction_interval > 0 and confirmed(log).limit(limits.compaction_tombstones + 1).count() > limits.compaction_tombstones
