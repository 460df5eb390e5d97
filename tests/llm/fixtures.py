"""Small document tables with every awkward case: nulls, blanks, ties, repeated rows, near copies, shared lines, long texts."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("count", T.StringType()), T.StructField("_tk", T.LongType()), T.StructField("key", T.LongType())])


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    """(doc_id, text, lang, source) with extra columns whose names clash with those that operators use inside."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("aeioustrn") for _ in range(r.randint(1, 9))) for _ in range(300)] + ["Ünï", "日本", "x" * 40]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    line = "This Line stands in many documents"
    out = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randint(1, 120))]
        text = " ".join(words)
        if i % 3 == 0:
            text = text[: len(text) // 2] + "\n  " + (line if i % 2 else line.upper()) + "\t\n" + text[len(text) // 2 :]
        if i % 4 == 1:
            text += " " + passage
        if i % 10 == 5:
            text = (line + "\n") * 3 + text
        out.append((i, text, "en", f"s{i % 3}" if i % 7 else None))
    near = out[1][1].split(" ")
    for j in range(6):
        near[j] = "changed"
        out.append((n + j, " ".join(near), "en", "s0"))
    out += [(n + 10, None, None, None), (n + 11, "", "en", "s1"), (n + 12, " \n\t ", "en", "s1"), (n + 13, "one", "en", "s2"), (n + 14, out[2][1], "en", "s2"), out[3][:4], (None, "a null id", "en", "s0"), (n + 15, " ".join(r.choice(vocabulary) for _ in range(6000)), "de", "s0"), (n + 16, "z" * 20000, "en", "s1"), (n + 17, "a b a b a b a b a b a b " * 20, "en", "s1")]
    return [(*x, len(x[1] or ""), "extra", 7, 8) for x in out]


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)
