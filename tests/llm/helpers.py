"""Tables that try an operator's edges."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns named like what operators add.
CLASHING = ["size", "target", "taken", "component_id", "fingerprint", "lang_pred", "score", "ambiguous", "n_entities", "text2"]


def prose(rng, n, words=400):
    return " ".join(rng.choice("aeiou") * rng.randint(1, 3) + str(rng.randrange(words)) for _ in range(n))


def edge_rows(seed=1):
    rng = random.Random(seed)
    long = prose(rng, 20_000, 5_000)
    a = prose(rng, 120)
    return [
        (0, None, None, None, None), (1, "", "en", "s", 0), (2, " \t\n ", "en", None, 3), (3, a, "en", "s", 1), (4, a, "en", "s", 1), (4, a, "en", "s", 1),
        (5, long, "de", "t", 9), (6, "one", None, "t", 3), (None, a, "en", "s", 1), (None, None, None, None, None), (7, a.upper(), "fr", "u", 1),
        (8, "Ünïcödé ẞ 日本語 \U0001f600   x\u0000y", "de", "u", 5), (9, prose(rng, 49), "de", "u", 5), (10, a + " " + prose(rng, 30), "en", "s", 2),
    ]


def edge_table(spark, clashing=False):
    df = spark.createDataFrame(edge_rows(), SCHEMA)
    if clashing:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit("x") for c in CLASHING})
    return df


def empty_table(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
