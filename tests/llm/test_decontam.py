"""Decontamination against brute force, and that it stays native."""

import hashlib
import re
from collections import Counter

from movelytics.llm import decontam

from .data import documents, empty, texts


def tokens(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window=10, within=20):
    out = []
    wins = [(i, tuple(w[s : s + window])) for i, t in items if (w := tokens(t)) for s in range(max(1, len(w) - window + 1))]
    n = Counter(x for _, t in docs for x in tokens(t))
    rare = [(i, sorted(set(w), key=lambda x: (n[x], x.encode()))[:3]) for i, t in items if (w := tokens(t))]
    for d, t in docs:
        w, hit, found, near = tokens(t), set(), set(), set()
        for i, x in wins:
            for s in range(len(w) - len(x) + 1):
                if tuple(w[s : s + len(x)]) == x:
                    hit.update(range(s, s + len(x)))
                    if i is not None:
                        found.add(str(i))
        for i, x in rare:
            if i is not None and any(y == x[0] and set(x) <= set(w[max(0, p - within) : p + within + 1]) for p, y in enumerate(w)):
                near.add(str(i))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit), len(near)))
    return out


def cases(spark):
    t = texts()
    items = [(1, " ".join(t[0].split()[5:25])), (2, "two words"), (10, "TWO; words!"), (3, None), (4, ""), (5, "w1 w2"), (6, " ".join(t[10].split()[60:69])), (7, "x x x x x x x x x x x"), (8, "École"), (None, "one"), (9, " ".join(t[0].split()[:9]) + " otherword"), (2, "two words")]
    extra = ["start " + t[0].split()[5] + " " + " ".join(t[0].split()[5:16]) + " end", "no two, WORDS! here two words", "x " * 30]
    return documents(spark, extra=extra), spark.createDataFrame(items, "item_id bigint, text string"), items


def test_decontamination(spark):
    docs, items, raw = cases(spark)
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], raw)
    got = decontam.report(docs, items)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)
    kept = decontam.without_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not x[-2] for x in want)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", -1)
    docs, items, raw = cases(spark)
    assert Counter(tuple(r) for r in decontam.report(docs, items).collect()) == Counter(brute([(r["doc_id"], r["text"]) for r in docs.collect()], raw))


def test_empty_tables(spark):
    docs, items, _ = cases(spark)
    assert decontam.report(empty(spark), items).count() == 0
    assert decontam.report(docs, items.limit(0)).where("contaminated").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red fox " + "and " * 8 + "jumped high"), (2, "red " + "and " * 60 + "jumped"), (3, "nothing here")], "doc_id bigint, text string")
    items = spark.createDataFrame([("q", "jumped red fox")], "item_id string, text string")
    assert {r["id"] for r in decontam.proximity_matches(decontam.index(docs, items)).collect()} == {1}
