import pytest
from pyspark.sql import functions as F

from movelytics.operators.estimates import Policy, compose, simplex, simplex_weights
from movelytics.operators.quality import exact_ids, schema_fingerprint
from movelytics.sources import tables
from movelytics.sources.maps import read_map


def test_publish(spark, tmp_path):
    template = spark.createDataFrame([(3, 0), (1, 1), (2, 2)], "id int, pos int")
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 3.0)], "id int, v double")
    out = tables.publish(df, template, "id", "v", str(tmp_path / "a"))
    assert out.count() == 3
    with pytest.raises(Exception, match="already exists"):
        tables.publish(df, template, "id", "v", str(tmp_path / "a"))
    with pytest.raises(ValueError, match="missing"):
        tables.publish(df.where("id < 3"), template, "id", "v", str(tmp_path / "b"))


def test_guards(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0)], "id int, taxi_time double")
    with pytest.raises(ValueError, match="label"):
        tables.refuse_labels(df, ("taxi",))
    with pytest.raises(ValueError, match="allow-list"):
        tables.refuse_labels(df, (), ["taxi_time", "id"])
    df.write.parquet(str(tmp_path / "t"))
    with pytest.raises(ValueError, match="missing columns"):
        tables.scan(spark, [str(tmp_path / "t")], ["id", "other"])


def test_month_files(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    for m in range(1, 13):
        pq.write_table(pa.table({"x": [m]}), tmp_path / f"training_2025-{m:02d}-01.parquet")
    pq.write_table(pa.table({"x": [99]}), tmp_path / "training_2025-01-01 (1).parquet")
    assert tables.month_files(spark, str(tmp_path)).agg(F.sum("x")).first()[0] == 78
    with pytest.raises(ValueError, match="12 month files"):
        tables.month_files(spark, str(tmp_path), expected=11)


def test_csv_and_map(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ident,gps\nX1,007\n")
    assert tables.read_strings(spark, str(tmp_path / "a.csv"), ["ident", "gps"]).first()["gps"] == "007"
    (tmp_path / "m.json").write_text('{"elements": [{"type": "node", "lat": 1.5, "lon": 2.0, "tags": {"ref": "A1"}}]}')
    assert read_map(spark, str(tmp_path / "m.json")).first()["tags"] == {"ref": "A1"}


def test_exact_ids(spark):
    a = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id int")
    b = spark.createDataFrame([(2,), (3,)], "id int")
    assert exact_ids(a, b, "id").first().asDict() == {"only_a": 2, "only_b": 1, "null_ids": 1, "repeated": 1}


def test_policies(spark):
    df = spark.createDataFrame([(1, 10.0), (2, -5.0), (3, None)], "id int, estimate double")
    out = {r["id"]: r["estimate"] for r in compose(df, [Policy(F.col("id") == 1, F.lit(7.0)), Policy(F.col("estimate") > 100, F.lit(0.0))]).collect()}
    assert out == {1: 7.0, 2: 0.0, 3: 0.0}


def faces(gram):
    """Brute force: the best weights over every face of the simplex."""
    import numpy as np

    k, best = len(gram), (np.inf, None)
    for mask in range(1, 1 << k):
        idx = [i for i in range(k) if mask >> i & 1]
        a = np.ones((len(idx) + 1, len(idx) + 1))
        a[:-1, :-1], a[-1, -1] = gram[np.ix_(idx, idx)], 0
        w = np.zeros(k)
        w[idx] = np.linalg.lstsq(a, np.eye(len(idx) + 1)[-1], rcond=None)[0][:-1]
        if (w >= -1e-9).all() and abs(w.sum() - 1) < 1e-6 and w @ gram @ w < best[0] - 1e-12:
            best = (w @ gram @ w, w)
    return best


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_simplex(spark, k):
    import numpy as np

    rng = np.random.default_rng(k)
    grams = []
    for n in range(20):
        e = rng.normal(size=(30, k)) * rng.uniform(0.1, 9, k) + rng.normal(size=(30, 1)) * rng.uniform(0, 4) + rng.normal(size=k)
        if n == 7:
            e[:, 0] = 0  # an expert without fault
        if n == 8:
            e[:, -1] = e[:, 0]  # two experts alike
        grams.append(e.T @ e / 30)
    grams.append(np.zeros((k, k)))
    df = spark.createDataFrame([(i, g.tolist()) for i, g in enumerate(grams)] + [(99, None)], "id int, g array<array<double>>")
    got = {r["id"]: r["w"] for r in df.select("id", simplex_weights("g", k).alias("w")).collect()}
    assert got.pop(99) is None
    for i, g in enumerate(grams):
        w = np.array(got[i])
        cost = faces(g)[0]
        assert (w >= -1e-9).all() and abs(w.sum() - 1) < 1e-9 and abs(w @ g @ w - cost) <= 1e-9 * (1 + cost)


def test_group_simplex(spark):
    """A group's own weights, drawn to those of all; rows without the target or an expert are left out."""
    import numpy as np

    rng = np.random.default_rng(1)
    rows = []
    for k, truth in (("a", [0.3, 0, 0.7]), ("b", [0, 1, 0])):
        x = rng.normal(size=(200, 3))
        rows += [(k, *v, float(v @ np.array(truth))) for v in x]
    rows += [("a", None, 1.0, 1.0, 5.0), ("b", 1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame([(r[0], *(None if v is None else float(v) for v in r[1:])) for r in rows], "k string, p double, q double, r double, y double")
    free = {r["k"]: r for r in simplex(df, ["p", "q", "r"], "y", "k", 0.0).collect()}
    assert np.allclose([free["a"][f"w_{i}"] for i in range(3)], [0.3, 0, 0.7], atol=1e-6) and np.allclose([free["b"][f"w_{i}"] for i in range(3)], [0, 1, 0], atol=1e-6)
    assert free["a"]["n"] == free["b"]["n"] == 200
    drawn = {r["k"]: r for r in simplex(df, ["p", "q", "r"], "y", "k", 1e12).collect()}
    assert np.allclose([drawn["a"][f"w_{i}"] for i in range(3)], [drawn["b"][f"w_{i}"] for i in range(3)], atol=1e-6)
    assert simplex(df.where("false"), ["p", "q", "r"], "y", "k", 1.0).count() == 0


def test_streaming_counts(spark, tmp_path):
    from movelytics.streaming.hourly import hourly_counts

    df = spark.sql("select 'a' as k, timestamp'2025-01-01 10:05:00' as t union all select 'a', timestamp'2025-01-01 10:50:00' union all select 'b', timestamp'2025-01-01 13:00:00'")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = hourly_counts(stream, "t", "k", "1 hour").writeStream.format("memory").queryName("hours").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["k"], r["n"]) for r in spark.sql("select * from hours").collect()}
    assert ("a", 2) in got
    assert {(r["k"], r["n"]) for r in hourly_counts(df, "t", "k").collect()} == {("a", 2), ("b", 1)}


def test_period_folders(spark, tmp_path):
    df = spark.createDataFrame([(i, f"2025-01-{i % 5 + 1:02d}") for i in range(40)] + [(99, "2025-01-01 (1)")], "id bigint, period string")
    tables.write_periods(df, str(tmp_path / "p"), "period")
    back = tables.period_files(spark, str(tmp_path / "p"), "id bigint", "period", 5)
    assert sorted(r["id"] for r in back.collect()) == list(range(40))
    with pytest.raises(ValueError, match="5 periods"):
        tables.period_files(spark, str(tmp_path / "p"), "id bigint", "period", 4)


def test_ordered_digest_tells_the_order(spark):
    """Equal whatever the partitions, other after a swap of two rows' values; the order-free digest can't tell the swap."""
    from pyspark.sql import functions as F

    from movelytics.operators.quality import digest, ordered_digest

    rows = [(i, f"v{i * 7 % 50}", "a" if i % 3 else None) for i in range(300)]
    swapped = [(i, {10: rows[20][1], 20: rows[10][1]}.get(i, v), k) for i, v, k in rows]
    frame = lambda r, n: spark.createDataFrame(r, "id long, v string, k string").repartition(n)
    tree = lambda df: {(r["k"], r["n"], r["ordered"]) for r in ordered_digest(df, ["v"], "id", ["k"], chunk=8).collect()}
    assert tree(frame(rows, 1)) == tree(frame(rows, 5)) and len(tree(frame(rows, 1))) == 2
    assert tree(frame(rows, 3)) != tree(frame(swapped, 3))
    assert digest(frame(rows, 2), ["v"]).collect() == digest(frame(swapped, 2), ["v"]).collect()
    assert ordered_digest(frame(rows, 2).where(F.lit(False)), ["v"], "id", ["k"]).count() == 0


def test_fingerprints_in_ranges(spark, tmp_path):
    """Files in byte ranges against a tree built here: one range, exact multiples, a sparse one; a changed byte and swapped ranges show."""
    import hashlib

    chunk, fan = 1 << 16, 3
    sha = lambda b: hashlib.sha256(b).hexdigest()
    content = {"empty": b"", "small file": b"abc", "whole": bytes(range(256)) * 256, "two": b"x" * chunk + b"y" * chunk, "swapped": b"y" * chunk + b"x" * chunk, "odd": b"z" * (7 * chunk + 5)}
    for name, b in content.items():
        (tmp_path / name).write_bytes(b)
    with open(tmp_path / "sparse", "wb") as f:
        f.truncate(40 << 20)

    def tree(b):
        if len(b) <= chunk:
            return sha(b)
        leaves = [sha(b[i : i + chunk]) for i in range(0, len(b), chunk)]
        return sha("".join(sha("".join(leaves[i : i + fan]).encode()) for i in range(0, len(leaves), fan)).encode())

    got = {r["file"].replace("%20", " "): r for r in tables.fingerprints(spark, [str(tmp_path)], chunk, fan).collect()}
    del content["empty"]  # Spark lists no empty files
    assert {n: r["sha256"] for n, r in got.items()} == {**{n: tree(b) for n, b in content.items()}, "sparse": tree(bytes(40 << 20))}
    assert got["odd"]["bytes"] == 7 * chunk + 5 and got["two"]["sha256"] != got["swapped"]["sha256"]


def test_station_years(spark, tmp_path):
    obs = spark.range(60).select(F.concat(F.lit("ST"), (F.col("id") % 3).cast("string")).alias("station"), (F.col("id") * 86400_000_000 * 30).alias("t_us"), *[F.col("id").cast("double").alias(c) for c in tables.OBSERVATION[1:11]], *[F.lit("SN").alias(c) for c in tables.OBSERVATION[11:]])
    path = str(tmp_path / "stations")
    tables.write_station_years(obs, path)
    got = tables.station_years(spark, path, ["ST1"], [1971], {"rh": (0.0, 15.0)})
    rows = got.collect()
    want = [i for i in range(60) if i % 3 == 1 and 365 <= i * 30 < 730]
    assert sorted(r["temperature"] for r in rows) == want and {r["temperature"]: r["rh"] for r in rows} == {i: i if i <= 15 else None for i in want}
    scan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [station" in scan.replace("isnotnull(station#", "station#") or "PartitionFilters: [(station" in scan
    assert tables.station_years(spark, path).count() == 60
    spark.read.parquet(path).drop("gust").write.partitionBy("station", "year").parquet(str(tmp_path / "less"))
    with pytest.raises(ValueError, match="gust"):
        tables.station_years(spark, str(tmp_path / "less"))


def test_schema_fingerprint(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, None), ("a", None, None)], "k string, v int, w string")
    base = schema_fingerprint(df, ["k", "w"]).collect()
    by = {r["column"]: r for r in base}
    assert [by[c]["n_values"] for c in ("k", "v", "w")] == [2, None, 0] and len({r["schema"] for r in base}) == 1
    for other in (df.select("v", "k", "w"), df.withColumn("v", F.col("v").cast("long")), df.withColumnRenamed("v", "u")):
        assert schema_fingerprint(other, ["k", "w"]).first()["schema"] != base[0]["schema"]
    more = {r["column"]: r for r in schema_fingerprint(df.union(spark.createDataFrame([("c", 1, None)], df.schema)), ["k", "w"]).collect()}
    assert more["k"]["digest"] != by["k"]["digest"] and more["k"]["schema"] == base[0]["schema"]


def test_batches_are_bounded_and_compared(spark, monkeypatch):
    """Batches hold BATCH rows but for the last, follow each other in id order, and files hold a batch's rows at most."""
    import glob
    import os

    import pyarrow.parquet as pq

    from movelytics.plans import audits

    from .compare import SF

    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    paths = []
    monkeypatch.setattr(audits, "BATCH", 100)
    monkeypatch.setattr(audits, "shared", lambda s, n, f=audits.shared: paths.append(f(s, n)) or paths[-1])
    rows = sorted(audits.s07_batches(spark, SF).collect(), key=lambda r: r["batch"])
    assert len(rows) > 5 and [r["batch"] for r in rows] == list(range(len(rows)))
    assert all(r["n"] == 100 for r in rows[:-1]) and all(r["same"] for r in rows)
    assert all(a["last_id"] <= b["first_id"] for a, b in zip(rows, rows[1:], strict=False))
    files = glob.glob(paths[0].removeprefix("file://") + "/*.parquet")
    assert files and max(pq.read_metadata(f).num_rows for f in files) <= 100
