"""Merkle fingerprints and packing."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from movelytics.llm import merkle, packing

from .data import documents, empty, texts, words

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_merkle_next(spark, parts):
    docs = documents(spark)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    got = merkle.compare_next(docs, partitions=parts).collect()
    want = Counter()
    for k, (i, a) in enumerate(rows):
        b = rows[(k + 1) % len(rows)][1]
        q = len(a) // 4
        e = a[: len(a) - q] + b[:q]
        want[(i, len(a), hashlib.sha256(e.encode()).hexdigest(), brute_root(a), brute_root(e), round(brute_likeness(a, e), 12), round(brute_likeness(a, b), 12))] += 1
    root = lambda fp: fp.partition("/")[0]
    assert Counter((r["id"], r["n_chars"], r["edited_sha256"], root(r["fingerprint"]), root(r["edited_fingerprint"]), round(r["near_edited"], 12), round(r["near_next"], 12)) for r in got) == want


def brute_leaves(text):
    return [x for line in text.split("\n") for x in re.findall(r"\s*\S+\s*|\s+", line)]


def brute_likeness(a, b):
    x, y = Counter(brute_leaves(a)), Counter(brute_leaves(b))
    return 1.0 if a == b else 2 * sum(min(n, y[k]) for k, n in x.items()) / max(1, sum(x.values()) + sum(y.values()))


def brute_root(text):
    """The root from the definition: leaves, paragraphs of lines, sections up to a blank line or 16 paragraphs."""
    h = lambda x: hashlib.blake2b(x, digest_size=16).digest()
    sections = [[]]
    for line in text.split("\n"):
        words = brute_leaves(line)
        if len(sections[-1]) == 16 or (not words and sections[-1]):
            sections.append([])
        sections[-1].append(h(b"".join(h(w.encode()) for w in words)))
    return h(b"".join(h(b"".join(s)) for s in sections)).hex()


def test_merkle_tree(spark):
    rng = random.Random(1)
    lines = [words(rng, 20) for _ in range(60)]
    a = "\n".join(lines)
    b = "\n".join([*lines[:33], words(rng, 20), *lines[34:]])
    fa, fb = merkle.tree(a), merkle.tree(b)
    assert merkle.differing(fa, fa) == [] and merkle.differing(fa, fb) == [(2, 1)]
    assert merkle.fingerprint(a) == fa.spelled() and merkle.likeness(fa, fa) == 1 and 0.9 < merkle.likeness(fa, fb) < 1
    assert [x.digest == y.digest for x, y in zip(fa.sections, fb.sections, strict=True)] == [True, True, False, True]
    assert merkle.likeness(fa, merkle.tree("entirely other text")) == 0
    assert merkle.fingerprint(None) == merkle.fingerprint("") and merkle.edited("", "abc") == ""
    assert merkle.compare_next(empty(spark)).count() == 0


def test_merkle_edits():
    """Applied to the first text's paragraphs, edits give the second's; a line put in marks itself alone."""
    rng = random.Random(8)
    for trial in range(200):
        a = [rng.choice(["", "x", words(rng, 6)]) for _ in range(rng.randrange(1, 60))]
        b = list(a)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(b) + 1)
            b[k : k + rng.randrange(3)] = [rng.choice(["", "x", words(rng, 5)]) for _ in range(rng.randrange(3))]
        b = b or [""]
        got, done, at = merkle.edits(merkle.tree("\n".join(a)), merkle.tree("\n".join(b))), [], 0
        for low, high, new_low, new_high in got:
            done += a[at:low] + b[new_low:new_high]
            at = high
        assert done + a[at:] == b, trial
    lines = [words(rng, 9) for _ in range(90)]
    put = [*lines[:37], "one more line", *lines[37:]]
    assert merkle.edits(merkle.tree("\n".join(lines)), merkle.tree("\n".join(put))) == [(37, 37, 37, 38)]
    assert merkle.edits(merkle.tree("\n".join(put)), merkle.tree("\n".join(lines))) == [(37, 38, 37, 37)]
    blank = merkle.edits(merkle.tree("\n" * 30000), merkle.tree("x\n" + "\n" * 30000))
    assert len(blank) == 1 and blank[0][3] - blank[0][2] <= 2


def test_merkle_fingerprints_are_smaller_than_texts():
    text = "\n".join(words(random.Random(k), 40, 10**6) for k in range(50))
    assert len(merkle.fingerprint(text)) < 0.5 * len(text)


def test_merkle_leaves_at_every_length():
    """Likeness doesn't depend on the side of some length that a text lies on, and short texts keep what an edit left."""
    rng = random.Random(4)
    long = words(rng, 300, 10**6)
    for n in (40, 200, 398, 399, 400, 402, 533, 1200):
        a = long[:n]
        assert merkle.likeness(merkle.tree(a), merkle.tree(a + " tail")) > 0.7, n
        short = merkle.edited(a, "zz")
        assert merkle.likeness(merkle.tree(a), merkle.tree(short)) > 0.6, n


def test_tokens():
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    enc = packing.encoder(VOCABULARY)
    rng = random.Random(2)
    odd = [" a", "a  b", "a \n b", "a\n\nb c ", "tab\tx y", "don't we'll  ", "  x", "x  y", "\r\n a", "１２ 34 ab12", "emoji 😀 x", "a " * 50]
    mixed = ["".join(rng.choice("ab \n.,'s1é\t" if k % 2 else "ab \n.,'s1é") for _ in range(80)) for k in range(400)]
    every = [*[t or "" for t in texts()], *odd, *mixed]
    for _ in range(2):  # the second time from memory
        for t, ids in zip(every, enc.encode(every), strict=True):
            assert list(np.frombuffer(ids, "<u4")) == tk.encode(t, add_special_tokens=False).ids, repr(t)
    assert enc.encode([]) == [] and enc.encode([""]) == [b""]


def test_plain_words_are_asked_of_the_model(monkeypatch):
    """Words of Latin letters with marks behind, in lines too, have the ids of whole texts; the pre-tokenizer sees only what is left."""
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tk.encode_special_tokens = True
    rng = random.Random(6)
    draw = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(1, 12)))
    marks = ["", "", ".", ",", "...", "_", "!?", "'", "$$$", ".\n", "\n", ",\n"]
    plain = [" ".join(draw("abcdefghijklmnopqrstuvwxyzABCéèäößñªµĀɏ") + rng.choice(marks) + draw("eta") for _ in range(60)) for _ in range(40)]
    plain = [t if k % 2 else t.replace("\n", "") for k, t in enumerate(plain)]
    odd = [" ".join(draw(letters) + rng.choice(marks) + draw(letters) for _ in range(30)) for letters in ("ɐaб", "漢a", "1a", "²aⅧ", "'sta", "a\u0301", "<|endoftxa>") for _ in range(20)]
    enc = packing.Encoder(VOCABULARY)
    every = [*plain, *odd, "<|endoftext|> a<|endoftext|> <|endoftext|>", "\nab c", "ab\n\ncd e", "ab \ncd e", "ab\n cd e"]
    for size in (packing._CACHE, 20):
        monkeypatch.setattr(packing, "_CACHE", size)
        for t, ids in zip(every, packing.Encoder(VOCABULARY).encode(every), strict=True):
            assert list(np.frombuffer(ids, "<u4")) == tk.encode(t, add_special_tokens=False).ids, repr(t)
    seen = []
    pipeline = enc.bpe

    class Counted:
        def encode_batch_fast(self, given, **how):
            seen.extend(given)
            return pipeline.encode_batch_fast(given, **how)

    enc.bpe = Counted()
    enc.encode([f"{a} {b}, {c}.\n{d}" for a, b, c, d in (["".join(rng.choice("etaoin") for _ in range(9)) for _ in range(4)] for _ in range(100))])
    assert sum(map(len, seen)) < 10


def check_packing(spark, docs, rows):
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = rows.toPandas()
    ids = {}
    for r in docs.collect():
        x = np.array([*tk.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        ids.setdefault(r["doc_id"] if r["doc_id"] is not None else -1, []).append(x)
    total = sum(len(x) for xs in ids.values() for x in xs)
    assert got.length.sum() == total
    for r in got.itertuples():
        options = ids[-1 if r.id is None or r.id != r.id else int(r.id)]
        assert any(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in options)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= packing.LENGTH
    assert ((got.length == packing.LENGTH) | (got.piece == 0)).all()
    return got, total


def test_packing(spark):
    docs = documents(spark)
    got, total = check_packing(spark, docs, packing.pack_documents(docs, VOCABULARY))
    assert got.sequence_id.nunique() <= -(-total // packing.LENGTH) + 1
    assert packing.pack_documents(empty(spark), VOCABULARY).count() == 0


def test_packing_on_islands(spark, monkeypatch):
    monkeypatch.setattr(packing, "ISLAND", 64)
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, words(rng, rng.randrange(1, 500))) for i in range(400)], "doc_id bigint, text string")
    got, total = check_packing(spark, docs, packing.pack_documents(docs, VOCABULARY))
    assert got.sequence_id.nunique() <= 1.02 * total / packing.LENGTH + 2


def sound(bins, size):
    assert sorted(i for b in bins for i in b) == list(range(len(size))) and all(sum(size[i] for i in b) <= packing.LENGTH for b in bins)


def test_genetic_steps(monkeypatch):
    rng = random.Random(4)
    size = [rng.choice([700, 690, 680, 1000, 340, 1020, 1030]) for _ in range(300)]
    bred = []
    whole = packing.crossover
    monkeypatch.setattr(packing, "crossover", lambda *a: bred.append(1) or whole(*a))
    bins = packing.evolve(size, 1)
    sound(bins, size)
    first = packing._pack(sorted(range(300), key=lambda i: -size[i]), size)
    assert len(bins) <= len(first) and bred
    # Also where the first packing can't be bettered, LEAST generations of several children are bred.
    bred.clear()
    sound(packing.evolve([1024] * 10, 1), [1024] * 10)
    assert len(bred) == packing.LEAST * (packing.POPULATION // 2)
    for n in (1, 2):
        sound(packing.evolve([5] * n, 1), [5] * n)


def test_crossover_injects_whole_bins():
    size = [1500, 500, 1200, 800, 1000, 1000]
    a, b = [[0, 1], [2], [3, 4], [5]], [[0], [2, 3], [1, 4], [5]]
    child = packing.crossover(a, b, size, [0, 2, 4, 5, 3, 1], 0.25)
    sound(child, size)
    assert [0, 1] in child and [2, 3] in child  # injected, and untouched by it


def test_migrants_join():
    """An elite packing that an island would not find takes over its population."""
    rng = random.Random(7)
    size = [x for _ in range(60) for x in (lambda p, q: (p, q, packing.LENGTH - p - q))(rng.randrange(300, 800), rng.randrange(300, 800))]
    perfect = [[3 * k, 3 * k + 1, 3 * k + 2] for k in range(60)]
    alone = packing.evolve(size, 3)
    assert len(packing.evolve(size, 3, [alone, perfect])) == 60 <= len(alone)


def test_exchange_fills_places():
    size = [1000, 900, 1048, 600, 448]
    bins, loose = packing.exchange([[0, 1]], [2, 3, 4], size)
    assert bins == [[0, 2]] and sorted(loose) == [1, 3, 4]  # the better fit of all swaps; what gave way is loose
    assert packing.exchange([[0, 2]], [3], size) == ([[0, 2]], [3])  # a full bin stays


def test_mutation_keeps_all_pieces():
    rng = random.Random(5)
    size = [rng.randrange(1, 2048) for _ in range(200)]
    down = sorted(range(200), key=lambda i: -size[i])
    bins = packing._pack(down, size)
    for seed in range(5):
        sound(packing.mutate(bins, size, down, np.random.default_rng(seed)), size)
    sound(packing.mutate([[0]], [7], [0], np.random.default_rng(0)), [7])


def test_genetic_beats_best_fit():
    """Triplets that fill bins exactly: the winners need at least a tenth fewer bins than best fit by falling size, in every group."""
    rng = random.Random(8)
    for k in range(10):
        size = []
        for _ in range(40):
            a = rng.randrange(780, 1000)
            b = rng.randrange(512, (packing.LENGTH - a) // 2 + 1)
            size += [a, b, packing.LENGTH - a - b]
        rng.shuffle(size)
        first = packing._pack(sorted(range(120), key=lambda i: -size[i]), size)
        best = packing.evolve(size, k)
        sound(best, size)
        assert len(best) <= 0.9 * len(first)
    for k in range(10):  # never more
        size = [rng.randrange(350, 900) for _ in range(90)]
        best = packing.evolve(size, k)
        sound(best, size)
        assert len(best) <= len(packing._pack(sorted(range(90), key=lambda i: -size[i]), size))


def test_pieces():
    ids = bytes(4 * 5000)
    p = packing.pieces_of(ids)
    assert [x[:2] for x in p] == [(0, 904), (904, 2048), (2952, 2048)]
    assert [x[:2] for x in packing.pieces_of(bytes(4 * 2048))] == [(0, 2048)]
