import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns that operators use inside or return; inputs may have them too.
CLASHING = ["size", "taken", "target", "key", "bucket", "copies", "shard", "slot", "n_words", "kept", "score", "label", "node", "digest", "n", "word", "row"]


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def documents(spark, rows, *, clash=True):
    """rows: doc_id, text, source."""
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    more = CLASHING if clash else []
    schema = T.StructType(fields + [T.StructField(c, T.StringType()) for c in more])
    data = [(i, t, "en", s, None if t is None else len(t), *("x" for _ in more)) for i, t, s in rows]
    return spark.createDataFrame(data, schema)


LONG = " ".join(f"w{i % 977} tail{i}" for i in range(15_000))
ODD = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one", "b"), (None, "no id here", "b"), (None, None, None), (5, LONG, "a"),
    (6, "same same same", "a"), (6, "same same same", "a"), (6, "same same same", "a"), (7, "é ß 日本語 \U0001f600", None), (8, "x" * 5_000, "c"), (9, "a\x00b \x1c c", "c"),
]


def collected(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=str)
