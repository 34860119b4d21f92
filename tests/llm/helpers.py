import random
import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use for results or inside.
CLASH = {"shard_id": "1", "hilbert_index": "2", "similarity": "3", "keep_id": "4", "toxicity": "5", "spans": "6", "item_ids": "7", "clean_text": "8", "line_no": "9", "id": "10", "a": "11", "b": "12", "key": "13", "h": "14", "term": "15", "n": "16", "c": "17", "text_key": "18", "root": "19", "node": "20", "x": "21", "lo": "22", "hi": "23", "licences": "24", "sentence_ids": "25", "ss": "26"}
CLASH |= {f"__{name}": str(30 + k) for k, name in enumerate("run gone doc text old toxicity found key cut short split row bucket id shard full parts index coarse bytes offset cell0 key0 sub seed score own".split())}


def words_of(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def prose(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    made, rows = [], []
    for k in range(n):
        made.append("w" + "".join(rng.choice("abcdefgh") for _ in range(2 + rng.randrange(vocabulary) % 7)))
        if rng.random() < 0.06 or k == n - 1:
            rows.append(" ".join(made).capitalize() + ".")
            made = []
    return "\n".join(rows)


def frame(spark, rows, clash=False):
    from pyspark.sql import functions as F

    full = [(r + (None,) * 5)[:5] for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    return df.select("*", *[F.lit(v).alias(k) for k, v in CLASH.items()]) if clash else df


def awkward(rng: random.Random):
    """Rows with nulls everywhere, empty and very long texts, ties and repeated rows."""
    same = prose(rng, 60)
    long = prose(rng, 30_000)
    return [
        (1, same, "en", "s", len(same)), (2, same, "en", "s", len(same)), (2, same, "en", "s", len(same)), (3, None, None, None, None), (4, "", "", "", 0), (None, prose(rng, 50), "en", "s", 10),
        (5, " \n\n \t", "de", None, None), (6, long, None, "s", None), (7, "Word", "fr", "t", 4), (8, "éİẞ ß\U0001f600 \x00\x0b", "fr", "t", -5), (9, long, "en", "s", 2**62),
    ]
