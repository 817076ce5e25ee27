"""Small awkward documents: nulls, empty and long texts, repeated rows, columns with names that operators use."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, fp string, tk int, item string, score string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def texts(seed=3):
    rng = random.Random(seed)
    base = words(rng, 300)
    passage = words(rng, 70)
    out = [base, base, base + " tail", "", "   \n ", None, "one", "two words", "ÉCOLE école Straße 漢字 ok", base.replace("w1", "W1")]
    out += [words(rng, 40) + " " + passage + " " + words(rng, 30) for _ in range(6)]
    out += [passage, "x " * 400, words(rng, 20_000), words(rng, 49), words(rng, 50)]
    near = base.split(" ")
    for _ in range(6):
        near = list(near)
        near[rng.randrange(300)] = "changed"
        out.append(" ".join(near))
    return out


def documents(spark, extra=()):
    rows = [(i, t, "en", f"s{i % 7}" if i % 11 else None, len(t or ""), "x", "y", 1, "z", "s") for i, t in enumerate([*texts(), *extra])]
    rows += [rows[0], rows[0], (5, "another text under a used id", None, "s1", None, None, None, None, None, None), (None, "no id here", "en", "s2", 3, None, None, None, None, None), (None, texts()[0], "en", "s3", 3, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
