"""Content-addressed web archive.

Payload bytes are stored once under their SHA-256; each record keeps its exact
header block, which names the digest; a join puts records together again.

Plan: payloads shuffle once, by digest, for the store; the join back finds the
store partitioned by digest already and moves only the narrow header rows.

Defined results: a record with a null payload has no digest and comes back with
a null payload; an empty payload is stored like any other; null ids and addresses are
left out of the header block; repeated rows and rows that repeat an id stay separate
records, in no order, so ties need no rule; very long payloads are stored whole; a
digest under which payloads of other length or other second digest arrive stops the
job rather than losing bytes; an empty table gives no rows; input columns besides the
three named ones are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADERS = "record_id url record_header payload_digest payload_length payload_check".split()


def header_block(record_id: Column, url: Column, payload: Column) -> Column:
    """The header block of a WARC/1.1 resource record, with its closing empty line."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\n"),
        line("WARC-Record-ID", F.concat(F.lit("<urn:relaylake:page:"), record_id.cast("string"), F.lit(">"))),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.sha2(payload, 256))),
        F.lit("Content-Type: text/html\r\n"),
        line("Content-Length", F.coalesce(F.octet_length(payload), F.lit(0)).cast("string")),
        F.lit("\r\n"),
    )


def record_headers(records: DataFrame, *, id_column: str, url_column: str, payload_column: str) -> DataFrame:
    """One row per record: its header block, the digest, and length and second digest to verify by."""
    rid, url, payload = (F.col(f"`{c}`") for c in (id_column, url_column, payload_column))
    return records.select(
        rid.alias("record_id"), url.alias("url"), header_block(rid, url, payload).alias("record_header"),
        F.sha2(payload, 256).alias("payload_digest"), F.octet_length(payload).cast("bigint").alias("payload_length"), F.md5(payload).alias("payload_check"),
    )


def payload_store(records: DataFrame, *, payload_column: str) -> DataFrame:
    """One row per distinct payload: (payload_digest, payload, n_records)."""
    payload = F.col(f"`{payload_column}`")
    rows = records.where(payload.isNotNull()).select(F.sha2(payload, 256).alias("payload_digest"), payload.alias("payload"), F.md5(payload).alias("c"), F.octet_length(payload).alias("l"))
    same = (F.min("c") == F.max("c")) & (F.min("l") == F.max("l"))
    stored = rows.groupBy("payload_digest").agg(F.first("payload").alias("payload"), F.count(F.lit(1)).alias("n_records"), same.alias("same"))
    sound = F.when(F.col("same"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payloads differ under digest "), F.col("payload_digest"))))
    return stored.select("payload_digest", sound.alias("payload"), "n_records")


def reconstruct(headers: DataFrame, store: DataFrame) -> DataFrame:
    """Whole records; ``intact`` says that the stored payload has the record's digest, length and second digest."""
    kept = headers.select(*HEADERS).join(store.select("payload_digest", "payload"), "payload_digest", "left")
    payload = F.col("payload")
    intact = F.when(F.col("payload_digest").isNull(), payload.isNull()).otherwise(
        F.coalesce((F.sha2(payload, 256) == F.col("payload_digest")) & (F.octet_length(payload) == F.col("payload_length")) & (F.md5(payload) == F.col("payload_check")), F.lit(False))
    )
    record = F.concat(F.col("record_header"), F.coalesce(payload, F.lit("")), F.lit("\r\n\r\n"))
    return kept.select("record_id", "url", "payload_digest", "record_header", "payload", record.alias("record"), intact.alias("intact"))


def write_archive(records: DataFrame, path: str, *, id_column: str, url_column: str, payload_column: str) -> None:
    """Write ``path``/payloads and ``path``/headers."""
    payload_store(records, payload_column=payload_column).write.mode("overwrite").parquet(f"{path}/payloads")
    record_headers(records, id_column=id_column, url_column=url_column, payload_column=payload_column).write.mode("overwrite").parquet(f"{path}/headers")


def read_archive(spark, path: str) -> DataFrame:
    return reconstruct(spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads"))
