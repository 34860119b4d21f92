"""Delivery of events to subscriptions: events and filters are joined by keys, then tested."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..filters import Filter, any_of, gift_wrap_visible
from .query import ranked

#: A stream has few subscriptions a query and needs a plan without an aggregate.
FEW = 64


@dataclass(frozen=True)
class Subscription:
    filters: Sequence[Filter]
    auth_pubkeys: Sequence[str] = ()


def deliver(events: DataFrame, subscriptions: Mapping[str, Subscription], now: int | None = None) -> DataFrame:
    """(sub_id, event...): each event once for each subscription with a matching filter.

    Expired events and ones hidden from the subscriber are not delivered; limits do not
    apply. Up to FEW subscriptions are one expression over the event; more are a join by
    key, whose plan does not grow with them. Both have the same result.
    """
    if now is not None:
        events = events.where(F.col("expiry").isNull() | (F.col("expiry") > now))
    if len(subscriptions) > FEW:
        wanted = [(name, f, 0, s.auth_pubkeys) for name, s in subscriptions.items() for f in s.filters]
        met = ranked(events, wanted).groupBy("seq", "id").agg(F.collect_set("f.sub_id").alias("subs"), F.first(F.struct(*events.columns)).alias("e"))
        return met.select(F.explode("subs").alias("sub_id"), "e.*")
    met = [F.when(any_of(s.filters) & gift_wrap_visible(s.auth_pubkeys), F.lit(name)) for name, s in subscriptions.items()]
    if not met:
        return events.where(F.lit(False)).select(F.lit("").alias("sub_id"), *events.columns)
    return events.select(F.explode(F.array_compact(F.array(*met))).alias("sub_id"), *events.columns)
