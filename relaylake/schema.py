"""Column types of the event log and its side tables."""

from pyspark.sql import types as T

TAGS = T.ArrayType(T.ArrayType(T.StringType()))
EVENT = T.StructType(
    [
        T.StructField("seq", T.LongType()), T.StructField("id", T.StringType()), T.StructField("pubkey", T.StringType()), T.StructField("sig", T.StringType()),
        T.StructField("created_at", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("tags", TAGS), T.StructField("content", T.StringType()),
    ]
)
EVENT_COLUMNS = EVENT.fieldNames()
