"""Plain-Python versions of what the text operators compute, and small tables."""

import random
import re

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()), T.StructField("kept", T.StringType())])
# Nulls, empty texts, ties, repeated rows, a null id, odd separators, and a column named like a result.
EDGES = [
    (1, None, None, "x"), (2, "", "a", "x"), (3, " \t\n", "a", "x"), (4, "One two", "b", None), (4, "One two", "b", None),
    (5, "onetwo", "b", "x"), (6, "One\x0btwo ", "b", "x"), (None, "One two", None, "x"), (7, "é ü x", "c", "x"), (8, "THE THE THE THE THE THE THE", "c", "x"),
]


def words(text, lower=False):
    text = (text or "").translate(LOWER) if lower else (text or "")
    return WORD.findall(text)


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def random_text(draw: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{int(vocabulary * draw.random() ** 2)}" for _ in range(n)]


def components(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            root[n] = root[root[n]]
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
