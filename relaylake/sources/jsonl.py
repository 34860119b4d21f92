"""Events from JSON lines: parsing, validation, policy and import tallies."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..config import Limits
from ..filters import Invalid
from ..functions.scalars import AUTH_KIND, with_derived
from ..operators.state import newer_before, vanished, version_rank
from ..protocol import parse_event, validate
from ..schema import EVENT

PARSED = T.StructType([*EVENT.fields, T.StructField("reason", T.StringType())])


def numbered_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(seq, line) of the lines of text files that are not blank, without white space at their ends.

    ``seq`` counts all lines from 0, by file name, then place in the file. Lines of one
    block of a file stand in one task, in order, so only counts of blocks are added up.
    """
    rows = spark.read.option("wholetext", False).text(path).select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("m"))
    # One row a block, so one task holds the running total.
    blocks = rows.groupBy("f", "b").agg(F.min("m").alias("low"), (F.max("m") - F.min("m") + 1).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("f", "b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(blocks.select("f", "b", "low", before.alias("before")), ["f", "b"])
    line = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    return placed.select((F.col("before") + F.col("m") - F.col("low")).alias("seq"), line.alias("line")).where("line != ''")


def parse_lines(lines: DataFrame, now: int, *, limits: Limits | None = None, signatures: bool = True, size_limits: bool = False) -> DataFrame:
    """Events of (seq, line), with ``reason``: "" for good ones, else the first fault.

    A line is an event object or ["EVENT", object]. ``size_limits`` applies the
    relay's limits on tags and content, before validation.
    """
    limits = limits or Limits()

    def one(line: str) -> tuple[dict | None, str]:
        try:
            said = json.loads(line)
        except ValueError:
            return None, "invalid: not valid JSON"
        if isinstance(said, list):
            if len(said) < 2 or said[0] != "EVENT":
                return None, "invalid: not an EVENT message"
            said = said[1]
        if not isinstance(said, dict):
            return None, "invalid: event not an object"
        try:
            event = parse_event(said)
        except Invalid as e:
            return None, str(e)
        if size_limits and len(event["tags"]) > limits.max_event_tags:
            return event, "invalid: too many tags"
        if size_limits and len(event["content"].encode()) > limits.content_limit(event["kind"]):
            return event, "invalid: content too long"
        return event, validate(event, now, signatures=signatures)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for seq, line in zip(batch["seq"], batch["line"], strict=True):
                event, reason = one(line)
                rows.append({"seq": seq, "reason": reason} | (event or {}))
            columns = {c: pd.Series([r.get(c) for r in rows], dtype=object) for c in PARSED.fieldNames()}
            yield pd.DataFrame(columns).astype({"created_at": "Int64", "kind": "Int32"})

    return lines.select("seq", "line").mapInPandas(run, PARSED)


def with_status(parsed: DataFrame, now: int, *, policy: str = "relay", auth_pubkeys: Sequence[str] = (), stored: DataFrame | None = None) -> DataFrame:
    """Add ``status`` (accepted, ephemeral, duplicate, rejected) and its ``reason``, as if rows came one by one in order of ``seq``.

    Checks run in the order: faults of the event, vanished author, protection, ephemeral
    kinds, expiry, known id, newer version. Only an accepted vanish request vanishes its
    author, and only a stored id is known. ``stored`` is the log that was there before.
    The policy "import" applies no relay rules: it stores ephemeral kinds, and a
    vanish request does not vanish its author.
    """
    rows = with_derived(parsed)
    good, old = F.col("reason") == "", None if stored is None else with_derived(stored)
    expired = F.col("expiry").isNotNull() & (F.col("expiry") <= now)
    passing = F.lit(False)
    if policy == "relay":
        closed = F.col("is_protected") & ~F.col("pubkey").isin(list(auth_pubkeys)) if auth_pubkeys else F.col("is_protected")
        gone = vanished(rows.where(good & ~closed & ~expired))
        if old is not None:
            gone = gone.unionAll(vanished(old).select("pubkey", F.lit(-1).cast("bigint"))).groupBy("pubkey").agg(F.min("vanish_seq").alias("vanish_seq"))
        rows = rows.join(gone.withColumnRenamed("pubkey", "__gone"), F.col("pubkey") == F.col("__gone"), "left")
        late = F.coalesce(F.col("seq") > F.col("vanish_seq"), F.lit(False))
        rows = rows.withColumn("reason", F.when(~good, F.col("reason")).when(late, "blocked: pubkey vanished").when(closed, "auth-required: protected event").otherwise("")).drop("__gone", "vanish_seq")
        passing = (F.col("kind_class") == "ephemeral") | (F.col("kind") == AUTH_KIND)
    fine = rows.where(good & ~passing & ~expired).withColumn("__newer", newer_before())
    known = F.lit(False)
    if old is not None:
        fine = fine.join(old.select("id", F.lit(True).alias("__known")), "id", "left")
        best = old.where(F.col("kind_class").isin("replaceable", "addressable")).groupBy(F.col("pubkey").alias("__p"), F.col("kind").alias("__k"), F.coalesce("d_value", F.lit("")).alias("__d")).agg(F.max(version_rank()).alias("__best"))
        versioned = F.col("kind_class").isin("replaceable", "addressable")
        fine = fine.join(best, versioned & (F.col("pubkey") == F.col("__p")) & (F.col("kind") == F.col("__k")) & (F.coalesce("d_value", F.lit("")) == F.col("__d")), "left")
        fine = fine.withColumn("__newer", F.col("__newer") | F.coalesce(F.col("__best") > version_rank(), F.lit(False)))
        known = F.coalesce("__known", F.lit(False))
    # A repeated id is known if its first arrival was stored; if that was too old, so is each repeat.
    w = Window.partitionBy("id").orderBy("seq")
    fine = fine.withColumn("__nth", F.row_number().over(w)).withColumn("__refused", F.first("__newer").over(w))
    status = F.when(known, "duplicate").when(F.col("__refused"), "rejected").when(F.col("__nth") > 1, "duplicate").otherwise("accepted")
    fine = fine.withColumn("status", status).withColumn("reason", F.when(status == "duplicate", "duplicate: already have this event").when(status == "rejected", "duplicate: older version").otherwise(""))
    names = [*rows.columns, "status"]
    dead = rows.where(good & ~passing & expired).withColumn("status", F.lit("rejected")).withColumn("reason", F.lit("error: internal store error"))
    bad = rows.where(~good).withColumn("status", F.lit("rejected"))
    short = rows.where(good & passing).withColumn("status", F.lit("ephemeral"))
    return reduce(DataFrame.unionAll, [x.select(*names) for x in (fine, dead, bad, short)])


def tallies(statuses: DataFrame) -> DataFrame:
    """One row (imported, duplicates, failures)."""
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("bigint")
    s = F.col("status")
    return statuses.agg(n(s == "accepted").alias("imported"), n(s == "duplicate").alias("duplicates"), n(~s.isin("accepted", "duplicate")).alias("failures"))


def stored_log(spark: SparkSession, target: str) -> DataFrame | None:
    """The Parquet log at ``target``, or None where nothing is stored yet."""
    try:
        return spark.read.schema(EVENT).parquet(target)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def import_jsonl(spark: SparkSession, source: str | Sequence[str], target: str, now: int, *, signatures: bool = True) -> DataFrame:
    """Append the events of JSON-lines files that the log at ``target`` accepts; returns the tallies.

    Ids and versions that are stored there count, and arrival numbers go on from its last.
    """
    from ..storage import materialise

    before = stored_log(spark, target)
    last = None if before is None else before.agg(F.max("seq")).first()[0]
    lines = numbered_lines(spark, source).withColumn("seq", F.col("seq") + F.lit(0 if last is None else last + 1))
    done = materialise(with_status(parse_lines(lines, now, signatures=signatures), now, policy="import", stored=before))
    done.where("status = 'accepted'").select(*EVENT.fieldNames()).write.mode("append").parquet(target)
    return tallies(done)
