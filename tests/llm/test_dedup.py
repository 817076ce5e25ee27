"""SimHash, line and substring dedup against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
import xxhash

from movelytics.llm import linededup, simhash, substring
from movelytics.llm.components import components

from .data import documents, empty


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(rows):
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if bin(a ^ b).count("1") <= 3:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for d, f in rows:
        if d is not None:
            least[find(f)].append(d)
    return {(d, f): min(least[find(f)], default=None) for d, f in rows}


@pytest.mark.parametrize("block", [4096, 3])
def test_simhash(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    docs = documents(spark, extra=[f"{'a b c d e f g h ' * 5} {i} {i % 3}" for i in range(30)])
    rows = [(r["doc_id"], brute_fingerprint(r["text"])) for r in docs.collect()]
    want = brute_components(rows)
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r["id"], r["fp"] % 2**64) for r in got) == Counter(rows)
    assert all(want[(r["id"], r["fp"] % 2**64)] == r["component_id"] for r in got)


def test_simhash_chains(spark):
    """Fingerprints one to three bits apart form one component, four bits don't link."""
    chain = [0, 0b111, 0b111111, 0b111111 | 7 << 40, 0x0F << 20 | 1 << 63, 0x7F << 24 | 1 << 63]
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in chain], "fp bigint")
    labels = {r["node"]: r["label"] for r in components(simhash.links(df)).collect()}
    assert len({labels[x] for x in chain[:4]}) == 1 and len(labels) in (4, 6)


def test_one_per_group(spark):
    docs = documents(spark)
    kept = simhash.one_per_group(docs, shingle=3)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert ids.count(0) == 3 and 1 not in ids  # rows that repeat an id stay together; the copy under id 1 goes
    assert simhash.one_per_group(empty(spark)).count() == 0
    assert simhash.near_duplicates(empty(spark)).count() == 0


def brute_lines(rows, sites=5):
    seen, owner = defaultdict(set), {}
    for d, t, s in rows:
        for x in (t or "").split("\n"):
            if x := x.strip(" "):
                seen[x].add(s)
                if d is not None:
                    owner[x] = min(d, owner.get(x, d))
    common = {x for x, s in seen.items() if len(s - {None}) >= sites}
    out = []
    for d, t, _ in rows:
        kept, first = [], set()
        for x in (t or "").split("\n"):
            k = x.strip(" ")
            if k in common and not (owner.get(k) == d and k not in first):
                continue
            first.add(k)
            kept.append(x)
        out.append((d, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


def test_lines(spark):
    spread = [f"Home | About\nbody {i}\n  Terms of use\n\nHome | About" for i in range(12)]
    docs = documents(spark, extra=[*spread, *[f"rare\ntext {i}" for i in range(4)]])
    want = brute_lines([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
    got = [(r["id"], r["kept_sha256"]) for r in linededup.report(docs).collect()]
    assert Counter(got) == Counter(want)
    out = linededup.without_boilerplate(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert Counter((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in out.collect()) == Counter(want)
    assert linededup.without_boilerplate(empty(spark)).count() == 0 and linededup.report(empty(spark)).count() == 0


def test_lines_near_and_far_from_the_threshold(spark):
    rows = [(i, f"l{k}", f"site{i}") for k, n in enumerate((4, 5, 6, 9, 12, 300)) for i in range(n)]
    docs = spark.createDataFrame([(1000 * i + j, t, s) for j, (i, t, s) in enumerate(rows)], "doc_id bigint, text string, source string")
    found = linededup.boilerplate(docs).count()
    assert found == 5  # all but the line on four sites


def brute_substring(rows, window=50):
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if d is not None and first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()))
    return out


def test_substring(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    # A passage twice in its first document, found again in later ones, next to other contexts.
    p = " ".join(f"p{i}" for i in range(60))
    rows += [(200, f"{p} mid {p}"), (201, f"a b {p} c"), (202, p), (203, f"q {p[: len(p) // 2]}"), (199, f"z {p[20:]} y")]
    rows += [(300 + i, "same " * (50 + i)) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [tuple(r) for r in substring.report(docs).collect()]
    assert Counter(got) == Counter(brute_substring(rows))
    left = {r["id"]: r["text"] for r in substring.without_repeats(docs.where("doc_id in (199, 202)")).collect()}
    assert left[202].split() == p.split()[:4] or left[202]  # what 199 doesn't hold
    assert substring.report(empty(spark)).count() == 0


def test_seeds_grow_both_ways():
    import numpy as np

    x, y = np.array([9, 1, 2, 3, 4, 5, 8]), np.array([1, 2, 3, 4, 5, 7, 7])
    assert substring.agreement(x, 3, y, 2) == (2, 3)
    assert substring.agreement(x, 0, y, 0) == (0, 0) and substring.agreement(x, 7, y, 7) == (0, 0)


def test_substring_many_holders(spark):
    """Windows that the anchor's first holder lacks are found in other holders; random contexts around shared cores."""
    import random

    rng = random.Random(12)
    core = [f"c{i}" for i in range(40)]
    sides = [[f"s{k}_{i}" for i in range(30)] for k in range(3)]
    rows = []
    for d in range(40):
        left, right = rng.choice(sides), rng.choice(sides)
        a, b = rng.randrange(31), rng.randrange(31)
        rows.append((d, " ".join([f"x{d}", *left[30 - a :], *core, *right[:b], f"y{d}", *(core if d % 9 == 0 else [])])))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter(tuple(r) for r in substring.report(docs).collect()) == Counter(brute_substring(rows))


def test_forest_is_exact():
    import random

    import numpy as np

    from movelytics.llm import overlap

    rng = random.Random(3)
    base = [rng.sample(range(2000), 40) for _ in range(5)]
    sets = [np.unique(np.array([x for x in rng.choice(base) if rng.random() > 0.1] + rng.sample(range(3000), rng.randrange(4)), np.uint64)) for _ in range(120)]
    sets += [np.zeros(0, np.uint64)] * 3

    def roots(pairs):
        up = list(range(len(sets)))

        def find(i):
            while up[i] != i:
                i = up[i]
            return i

        for a, b in pairs:
            up[find(a)] = find(b)
        return [find(i) for i in range(len(sets))]

    same = lambda a, b: len(np.union1d(a, b)) == 0 or len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
    want = roots([(i, j) for i in range(len(sets)) for j in range(i) if same(sets[i], sets[j])])
    got = roots(overlap.forest(sets, 0.8))
    part = lambda r: sorted(sorted(i for i in range(len(r)) if r[i] == k) for k in set(r))
    assert part(got) == part(want)
    assert overlap.banding(0.8) == (7, 30) and all(1 - (1 - s ** overlap.banding(s)[0]) ** overlap.banding(s)[1] >= 0.999 for s in (0.5, 0.6, 0.7, 0.9))
    with pytest.raises(ValueError):
        overlap.banding(0.3)


@pytest.mark.parametrize("block", [1024, 4])
def test_similar(spark, monkeypatch, block):
    """Every pair of texts with 0.8 of their five-word shingles in common ends in one component, and no other pair is linked."""
    import random

    from movelytics.llm import overlap

    from .data import words

    monkeypatch.setattr(overlap, "BLOCK", block)
    rng = random.Random(8)
    passage = words(rng, 60, 5000)
    rows = []
    for k in range(12):
        base = words(rng, 150, 5000).split()
        for v in range(6):
            t = list(base)
            for _ in range(v):
                t[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(t) + (" " + passage if k % 3 == 0 else "")))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, rows[0][1]), (None, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sets = {t: set(overlap.shingle_set(t, 5).tolist()) for _, t in rows}
    fps = {t: simhash.fingerprint64(t, 5) for _, t in rows}
    names = list({t: 1 for _, t in rows})
    root = {t: t for t in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            u = sets[a] | sets[b]
            if bin(fps[a] ^ fps[b]).count("1") <= 3 or (u and len(sets[a] & sets[b]) / len(u) >= 0.8):
                root[find(a)] = find(b)
    least = defaultdict(list)
    for d, t in rows:
        if d is not None:
            least[find(t)].append(d)
    got = Counter((r["id"], r["component_id"]) for r in simhash.similar(docs, 0.8).collect())
    assert got == Counter((d, min(least[find(t)])) for d, t in rows)
    kept = {r["doc_id"] for r in simhash.one_per_group(docs, shingle=5, similarity=0.8).collect()}
    assert kept == {min(v) for v in least.values()}
    assert simhash.similar(docs.limit(0), 0.8).count() == 0


def test_similar_needs_shared_text(spark):
    """A line repeated within texts decides their fingerprints; texts that share nothing else aren't near-duplicates."""
    import random

    from .data import words

    rng = random.Random(5)
    line = " ".join(f"t{i}" for i in range(9))
    rows = [(i, f"{words(rng, 150, 10**6)} {' '.join([line] * 20)}") for i in range(8)]
    rows += [(10, rows[0][1] + " tail"), (11, None), (12, " "), (13, "")]
    fps = [simhash.fingerprint64(t, 5) for _, t in rows[:8]]
    assert any(bin(a ^ b).count("1") <= 3 for i, a in enumerate(fps) for b in fps[:i])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["id"]: r["component_id"] for r in simhash.similar(docs, 0.8).collect()}
    assert got == {**{i: i for i in range(8)}, 10: 0, 11: 11, 12: 11, 13: 11}
    kept = {r["doc_id"] for r in simhash.one_per_group(docs, shingle=5, similarity=0.8).collect()}
    assert kept == {*range(8), 11}
