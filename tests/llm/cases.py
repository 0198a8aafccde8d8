"""Documents with everything that may come: missing values, empty and long texts, ties, repeats, odd columns."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# names that the operators use for columns of their own
CLASHES = ("size", "label", "score", "key", "blob", "spans", "rate", "copy", "n_words", "row_key", "x", "run", "target")


def prose(seed, words, vocabulary=300):
    rng = random.Random(seed)
    names = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(vocabulary)]
    return " ".join(rng.choice(names) for _ in range(words))


def odd_rows():
    long = "word " * 60_000
    return [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "   \n\t ", None, None, 1), (None, prose(1, 60), "en", "b", 5),
        (5, prose(2, 80), "en", None, 5), (5, prose(2, 80), "en", None, 5), (6, prose(2, 80), "en", "b", 5),
        (7, long, "en", "b", len(long)), (8, "x" * 200_000, "en", "c", 200_000), (9, "Ünï çödé 🙂 text", "de", "c", 15),
        (10, "one", "en", "c", 3), (11, "one two", "en", "c", 7), (12, prose(3, 40) + "\n" + prose(4, 40), "en", "a", 1),
    ]


def frame(spark, rows, clashes=False):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    if clashes:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit("taken").alias(c) for c in CLASHES])
    return df


def fold(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
