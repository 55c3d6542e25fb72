"""Awkward documents that every operator has to take."""

import random

from pyspark.sql import types as T

FIELDS = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()),
          # names that operators use for columns of their own
          *[(n, T.StringType()) for n in ("rest", "kept", "_spans", "_id", "_later", "class_id", "spans", "block", "windows", "rid")]]
SCHEMA = T.StructType([T.StructField(n, k) for n, k in FIELDS])


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def texts():
    rng = random.Random(5)
    long = prose(rng, 9000)
    base = prose(rng, 120)
    near = base.split()
    near[60] = "changed"
    passage = prose(rng, 70)
    return [None, "", "   \n\t ", "one", "one", "two words", base, base, " ".join(near), long, long + " tail",
            prose(rng, 40) + " " + passage + " " + prose(rng, 30), prose(rng, 55) + " " + passage, passage,
            "same " * 200, "same " * 150, "é ü 日本 😀 " * 20, 'password = "hunter22hunter" x', 'token: abc', "AKIA" + "A1" * 8,
            "key deadbeefdeadbeefdeadbeef end", "a" * 5000, "<|endoftext|> mid <|endoftext|>", "x\x0by\x0cz\x1cq"]


def rows():
    out = [(i, t, "en", f"src{i % 3}", None if t is None else len(t), *(f"{n}{i}" for n, _ in FIELDS[5:])) for i, t in enumerate(texts())]
    out.append(out[6])  # a row that repeats
    out.append((None, texts()[6], None, None, None, *[None] * (len(FIELDS) - 5)))  # a null id
    out.append((90, texts()[9], None, None, None, *[None] * (len(FIELDS) - 5)))
    out.append((90, "another text of the same id", None, None, None, *[None] * (len(FIELDS) - 5)))
    return out


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(4)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
