"""Toxicity and quality: folding, exceptions, held-out accuracy on generated text, awkward rows."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from movelytics.llm import quality, queries, toxicity
from movelytics.llm.common import share_of_hash

from .data import documents, empty, words


def auc(y, s):
    y, r = np.array(y), np.argsort(np.argsort(s)) + 1
    return (r[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def labelled(spark, n=300, bad="scumbag"):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        toxic = i % 5 == 0
        w = words(rng, 60).split()
        for _ in range(3 if toxic else 0):
            w[rng.randrange(60)] = rng.choice([bad, "ScumBag", "5cumb4g", "ѕcumbag"])
        junk = i % 7 == 0
        rows.append((i, " ".join(f"{x}$$$" if junk else x for x in w)))
        labels.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_folding():
    assert toxicity.fold("ID1OT! ｉｄｉｏｔ іdiоt 1d10t") == " idiot idiot idiot idiot "
    assert toxicity.fold(None) == toxicity.fold("") == toxicity.fold("...") == " "


def test_exception_phrases():
    lex = toxicity.Lexicon({" trash ": (50, 1)}, 100, 100, ("trash can",), curve=(-2, 1, 1, 1))
    assert lex.features("take it to the trash can")[2] == 0
    assert lex.features("you are trash")[2] > 0 and lex.features("trashy")[2] == 0


def test_matches_equal_a_naive_scan():
    rng = random.Random(9)
    vocabulary = ["trash", "trashy", "scum", "pond", "can", "the", "you", "scummer"]
    entries = {" trash ": (50, 1), " scum": (40, 2), " scumm": (45, 1), " you ": (1, 50)}
    lex = toxicity.Lexicon(entries, 100, 100, ("trash can", "pond scum", "trash can the", "scum pond"))
    for _ in range(300):
        ws = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 14))]
        folded = toxicity.fold(" ".join(ws))
        want, at = {}, 0
        phrases = [toxicity.fold(p) for p in lex.exceptions]
        places = [(i, i + len(p) - 1) for p in phrases for i in range(len(folded)) if folded.startswith(p, i)]
        for w in ws:
            hit = max((lex.weight(n) for t, n in entries.items() if folded.startswith(t, at)), default=0)
            if hit > 0 and not any(lo <= at < hi for lo, hi in places):
                want[at] = hit
            at += len(w) + 1
        assert lex.matches(folded) == want, folded


def test_long_texts_take_linear_time():
    lex = toxicity.Lexicon({" trash ": (50, 1)}, 100, 100, ("trash can",))
    took = []
    for k in (20_000, 80_000):
        text = "you trash and the trash can " * k
        began = time.process_time()
        assert lex.features(text)[2] > 0
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 0.2


def test_exceptions_are_learned(spark):
    """A lexicon word that is harmless beside another word: that pair is an exception."""
    rng = random.Random(2)
    rows = [(i, f"{words(rng, 30)} {'you scumbag' if i % 4 == 0 else 'pond scumbag lily' if i % 8 == 1 else 'x'} {words(rng, 10)}") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(800)], "doc_id bigint, toxic int")
    lex = toxicity.fit(docs, labels, F.lit(True))
    assert {"pond scumbag", "scumbag lily"} <= set(lex.exceptions) and "you scumbag" not in lex.exceptions


def test_samples_of_a_vast_table(spark):
    """A share far below a millionth is still that share."""
    n = spark.range(1 << 22).where(share_of_hash(10_000 / 1e11 * 1e5, "id")).count()
    assert 0.5 < n / ((1 << 22) * 0.01) < 1.5
    plan = spark.range(10).where(share_of_hash(10_000 / 1e11, "id"))._jdf.queryExecution().optimizedPlan().toString()
    assert str(round(1e-7 * (1 << 62))) in plan
    assert spark.range(100).where(share_of_hash(1.0, "id")).count() == 100 and spark.range(100).where(share_of_hash(0.0, "id")).count() == 0


def test_queries_of_scores(spark, tmp_path):
    """held_out and predicted as the queries return them; learning never sees a held-out label."""
    import zlib

    docs, labels = labelled(spark)
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for lie in (0, 1):  # held-out labels turned round change nothing
        for name, f, n, r in (("toxic", queries.op2_toxicity, 3, 1), ("quality", queries.op3_quality, 4, 2)):
            where = tmp_path / f"{name}{lie}"
            held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n)) == r
            docs.coalesce(1).write.parquet(f"{where}/documents.parquet")
            labels.withColumn(name, F.when(held & (F.lit(lie) == 1), 1 - F.col(name)).otherwise(F.col(name))).coalesce(1).write.parquet(f"{where}/labels.parquet")
    for name, f, n, r in (("toxic", queries.op2_toxicity, 3, 1), ("quality", queries.op3_quality, 4, 2)):
        a, b = ({x["doc_id"]: x for x in f(spark, str(tmp_path / f"{name}{lie}")).collect()} for lie in (0, 1))
        assert all(x["held_out"] == (zlib.crc32(str(i).encode()) % n == r) and x["predicted"] == int(x["score"] >= 0.7) for i, x in a.items())
        assert all(abs(a[i]["score"] - b[i]["score"]) < 1e-9 for i in a)


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark)
    lex = toxicity.fit(docs, labels, F.col("doc_id") % 3 != 1)
    out = toxicity.scores(docs, lex).toPandas().sort_values("id")
    y = [int(i % 5 == 0) for i in out.id]
    held = out.id % 3 == 1
    assert auc(np.array(y)[held], out.score[held]) > 0.98
    kept = toxicity.without_toxic(docs, lex)
    assert kept.columns == docs.columns and kept.where("doc_id % 5 = 0").count() <= 6 and kept.where("doc_id % 5 <> 0").count() >= 235


def test_toxicity_awkward(spark):
    docs = documents(spark)
    _, labels = labelled(spark)
    lex = toxicity.fit(docs, labels, F.lit(True))
    out = toxicity.scores(docs, lex).toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all()
    none = toxicity.fit(empty(spark), labels.limit(0), F.lit(True))
    assert none.entries == {} and toxicity.scores(empty(spark), none).count() == 0
    assert toxicity.without_toxic(docs, none).count() == docs.count()


def test_quality_held_out(spark):
    docs, labels = labelled(spark, 600)
    model = quality.fit(docs, labels, F.col("doc_id") % 4 != 2)
    out = quality.scores(docs, model).toPandas()
    held = out.id % 4 == 2
    assert auc((out.id[held] % 7 != 0).astype(int), out.score[held]) > 0.95
    assert 0.7 < model.prior < 0.98


def test_quality_awkward(spark):
    docs = documents(spark)
    _, labels = labelled(spark)
    out = quality.scores(docs, quality.fit(docs, labels, F.lit(True))).toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all()
    none = quality.fit(empty(spark), labels.limit(0), F.lit(True))
    assert none.net is None and quality.scores(docs, none).where("score = 0.5").count() == docs.count()


def test_risk_is_not_negative():
    """The unlabelled part alone pulls no score below what the prior allows."""
    rng = np.random.default_rng(0)
    p, u = rng.normal(1, 0.3, (400, 4)), np.vstack([rng.normal(1, 0.3, (320, 4)), rng.normal(-1, 0.3, (80, 4))])
    first = quality.Model(0.5, np.zeros(4), np.ones(4), quality._train(p, u, 0.5, 20))
    prior = quality.estimate_prior(first.logits(p), first.logits(u))
    assert 0.7 < prior < 0.95
    m = quality.Model(prior, np.zeros(4), np.ones(4), quality._train(p, u, prior, 40))
    s = m.score(u)
    assert s[:320].mean() > 0.8 and s[320:].mean() < 0.3
