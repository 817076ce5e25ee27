"""Trees of many groups against the same trees grown one group at a time with numpy; experts never score what they saw."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from movelytics.ml import grouped
from movelytics.plans.models import keeper

ROUNDS, DEPTH, RATE, LEAST, RIDGE = 3, 2, 0.5, 3, 1.0
OPTIONS = {"rounds": ROUNDS, "depth": DEPTH, "rate": RATE, "least": LEAST, "ridge": RIDGE}


def data(spark, n=400):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        a, kind = rng.choice([None, rng.randrange(50), float(rng.randrange(9))]), rng.choice(["x", "y", "z", None])
        y = (a or 5) * (2 if kind == "x" else -1) + rng.random()
        # Two thirds of the rows are one group's; one group has two rows, one has equal labels, one has no key.
        g = ["hot"] * 8 + ["b", "c", None, "flat"]
        g = "tiny" if i < 2 else rng.choice(g)
        rows.append((i, g, float(a) if a is not None else None, kind, 7.0 if g == "flat" else None if i % 41 == 40 else y, 1.0 + i % 3, i % 3))
    return spark.createDataFrame(rows, "id int, grp string, a double, kind string, y double, w double, fold int")


def grown(bins, y, w):
    """Predictions of boosted trees, grown by trying every cut of every node."""
    out = np.full(len(y), (y * w).sum() / w.sum())
    for _ in range(ROUNDS):
        r, node, value = y - out, np.ones(len(y), int), np.zeros(len(y))
        for level in range(DEPTH):
            for k in range(1 << level, 2 << level):
                here = node == k
                best = None
                for f in range(bins.shape[1]):
                    for c in sorted(set(bins[here, f])):
                        low, high = here & (bins[:, f] <= c), here & (bins[:, f] > c)
                        if min(low.sum(), high.sum()) < LEAST:
                            continue
                        part = lambda m: (w * r)[m].sum() ** 2 / (w[m].sum() + RIDGE)  # noqa: B023, E731
                        gain = part(low) + part(high) - part(here)
                        key = (round(gain, 6), -f, -c)
                        if gain > 1e-9 and (best is None or key > best[0]):
                            best = (key, low, high)
                if best:
                    for side, m in enumerate(best[1:]):
                        value[m] = (w * r)[m].sum() / (w[m].sum() + RIDGE)
                        node[m] = 2 * k + side
        out = out + RATE * value
    return out


def test_groups_equal_single_fits(spark):
    keep = keeper(spark, "test-grouped")
    df = data(spark)
    df = df.withColumn("bins", grouped.learn_bins(df, ["a"], ["kind"], 8).column())
    models = keep(grouped.fit_groups(df, "grp", "y", "bins", keep, weight="w", **OPTIONS))
    got = df.join(models.drop("n"), "grp", "left").select("id", "grp", "y", "w", "bins", grouped.predicted(F.col("base"), F.col("trees"), F.col("bins"), DEPTH, RATE).alias("p")).toPandas()
    assert len(got) == 400 and set(models.toPandas().grp) == {"hot", "b", "c", "flat", "tiny"}
    assert got[got.grp.isna()].p.isna().all() and (got[got.grp == "flat"].p == 7).all()
    for _, rows in got[got.grp.notna()].groupby("grp"):
        rows = rows.reset_index(drop=True)
        fit = rows.y.notna().to_numpy()
        bins = np.array(rows.bins.tolist())
        assert np.allclose(grown(bins[fit], rows.y[fit].to_numpy(), rows.w[fit].to_numpy()), rows.p[fit], atol=1e-6)
    hot = got[(got.grp == "hot") & got.y.notna()]
    assert ((hot.p - hot.y) ** 2).mean() < 0.3 * hot.y.var()


def test_passes_do_not_follow_the_groups(spark):
    """As many tables are written for two groups as for forty."""
    counts = []
    for n in (2, 40):
        calls, keep = [], keeper(spark, "test-passes")
        df = spark.range(200).selectExpr("id", f"concat('g', id % {n}) as grp", "array(cast(id % 7 as int)) as bins", "cast(id % 5 as double) as y")
        grouped.fit_groups(df, "grp", "y", "bins", lambda d, c=calls, k=keep: (c.append(1), k(d))[1], **OPTIONS).count()
        counts.append(len(calls))
    assert counts[0] == counts[1] == 2 + ROUNDS * DEPTH


def test_bins(spark):
    df = spark.createDataFrame([(None, None), (float("nan"), "q"), (1.0, "q"), (2.0, "r"), (9.0, "s")], "a double, kind string")
    bins = grouped.Bins({"a": [1.0, 2.0]}, {"kind": ["q", "r"]})
    assert [tuple(r[0]) for r in df.select(bins.column()).collect()] == [(0, 0), (0, 1), (1, 1), (2, 2), (3, 0)]
    none = grouped.learn_bins(df.limit(0), ["a"], ["kind"])
    assert none == grouped.Bins({"a": []}, {"kind": []})
    keep = keeper(spark, "test-empty")
    assert grouped.fit_groups(data(spark).limit(0).withColumn("bins", F.array(F.lit(1))), "grp", "y", "bins", keep, **OPTIONS).count() == 0


def test_experts_hold_their_fold_out(spark):
    """Changing a fold's labels changes no prediction of that fold; a registry that has seen the fold is refused."""
    keep = keeper(spark, "test-registry")
    df = data(spark)
    df = keep(df.withColumn("bins", grouped.learn_bins(df, ["a"], ["kind"], 8).column()))
    experts = [grouped.Expert("plain", "y"), grouped.Expert("of_x", "y * 2", "kind = 'x'", "w")]
    names = [e.name for e in experts]
    scores = lambda d, r: d.transform(grouped.score_held, "fold", r, names, "bins", depth=DEPTH, rate=RATE).select("id", "fold", *names).toPandas().set_index("id").sort_index()
    registry = keep(grouped.cross_fit(df, "fold", [0, 1, 2], experts, "bins", keep, **OPTIONS))
    base = scores(df, registry)
    assert len(base) == 400 and base.notna().all().all()
    changed = df.withColumn("y", F.when(F.col("fold") == 1, F.lit(1e4)).otherwise(F.col("y")))
    after = scores(df, keep(grouped.cross_fit(changed, "fold", [0, 1, 2], experts, "bins", keep, **OPTIONS)))
    same = (base[names] - after[names]).abs().max(axis=1) < 1e-9
    assert same[base.fold == 1].all() and not same[base.fold != 1].any()
    # One expert and fold equals a fit of its own.
    alone = df.where("fold <> 2 and kind = 'x'").withColumns({"g": F.lit(1), "label": F.col("y") * 2})
    m = grouped.fit_groups(alone, "g", "label", "bins", keep, weight="w", **OPTIONS).first()
    n = registry.where("held = 2").first()["experts"]["of_x"]
    assert n["n"] == m["n"] and abs(n["base"] - m["base"]) < 1e-9
    leaked = registry.withColumn("learned", F.array(F.lit(0), F.lit(1), F.lit(2)))
    with pytest.raises(Exception, match="has seen the fold"):
        scores(df, leaked)


def test_features_are_made_once(spark, capsys):
    """Fits look at their rows many times: the windows behind the features are worked out once, and all fits read the written table."""
    from movelytics.plans.models import kept_features

    for part in kept_features(spark, "/root/testdata/sf0.001"):
        part.explain()
    plan = capsys.readouterr().out
    assert plan.count("model-features") == 2 and "Window" not in plan


def test_a_row_that_teaches_several_groups_is_written_once(spark):
    """Models of groups in an array equal those of rows repeated for each group; rows stand in blocks, not in a row each, and a block is cut at BLOCK rows."""
    df = data(spark, 900).withColumn("bins", grouped.Bins({"a": [2.0, 5.0, 9.0]}, {"kind": ["x", "y"]}).column()).withColumn("of", F.array("grp", F.lit("all"), F.concat(F.lit("f"), F.col("fold"))))
    kept, keep = [], keeper(spark, "test-several")
    noted = lambda d: (kept.append(keep(d)), kept[-1])[1]
    fits = lambda d, g, k: sorted(grouped.fit_groups(d, g, "y", "bins", k, weight="w", **OPTIONS).withColumnRenamed(g, "g").collect())
    one, many = fits(df, "of", noted), fits(df.withColumn("each", F.explode("of")), "each", keep)
    assert [(r["g"], r["n"]) for r in one] == [(r["g"], r["n"]) for r in many] and len(one) == 9
    for a, b in zip(one, many, strict=True):
        assert abs(a["base"] - b["base"]) < 1e-9
        assert [t["feature"] for t in a["trees"]] == [t["feature"] for t in b["trees"]] and np.allclose([t["value"] for t in a["trees"]], [t["value"] for t in b["trees"]])
    assert kept[0].count() < 900 / 4 and kept[0].selectExpr("sum(length(y)) / 8").first()[0] == df.where("y is not null").count()
