"""Document fingerprints: a Merkle tree over sections and paragraphs.

Leaves are the words of a paragraph (a line), in texts of every length; a paragraph's digest is taken over its leaves'
digests, a section is a run of paragraphs up to a blank line or SECTION_PARAGRAPHS of them and its digest is taken over its
paragraphs' digests, and the root's over the sections'. All digests have 16 bytes. Leaves start afresh at each paragraph,
so an edit changes its own leaves, one paragraph, one section and the root only. Leaf digests keep the white space around
words, so equal roots mean equal texts (up to hash collisions).
The fingerprint string spells the tree out: "root/section=paragraph:leaves,paragraph:.../...", the root in full as hex and
below it the first BRANCH_BYTES of a branch's digest and LEAF_BYTES of each leaf's, in the URL-safe base64 alphabet without
padding. Two trees are compared from the root down: equal roots end it, equal sections
and then equal paragraphs are taken as wholes, and leaves are only counted in branches that differ.
Edits are located by aligning the paragraphs of branches that differ: paragraphs that either tree has once are anchors,
the longest chain of them in both orders and the equal runs around it are the same, and what lies between was edited; so a
line put in marks itself and none of those behind it.

Nulls and empty texts: a null text is an empty one: one section with one paragraph without leaves. Order: rows with null ids
come first, rows that repeat an id follow each other in order of their texts; the next document is the next row in that
order. A single row is its own next document; an empty table gives an empty result. Ties: equal branches are counted as
often as both trees have them. A very long text is one tree. Other columns, whatever their names, are never read.
"""

from __future__ import annotations

import hashlib
import re
from base64 import urlsafe_b64encode
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

SECTION_PARAGRAPHS = 16
BRANCH_BYTES, LEAF_BYTES = 3, 2  # of digests that the string shows below the root
_LEAF = re.compile(r"\s*\S+\s*|\s+")


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


@lru_cache(1 << 16)
def _word_digest(word: str) -> bytes:
    return _digest(word.encode("utf-8", "surrogatepass"))


def _leaf_digest(word: str) -> bytes:
    return _word_digest(word) if len(word) < 64 else _word_digest.__wrapped__(word)


@dataclass(slots=True)
class Branch:
    """A section (children: paragraphs) or a paragraph (leaves: its leaves' digests)."""

    digest: bytes
    size: int
    children: list[Branch] = field(default_factory=list)
    leaves: list[bytes] = field(default_factory=list)


@dataclass(slots=True)
class Tree:
    root: bytes
    sections: list[Branch]

    @property
    def size(self) -> int:
        return sum(s.size for s in self.sections)

    def spelled(self) -> str:
        one = lambda p: f"{_spelled(p.digest[:BRANCH_BYTES])}:{_spelled(b''.join([x[:LEAF_BYTES] for x in p.leaves]))}"
        return "/".join([self.root.hex(), *(f"{_spelled(s.digest[:BRANCH_BYTES])}={','.join(map(one, s.children))}" for s in self.sections)])


def _spelled(data: bytes) -> str:
    return urlsafe_b64encode(data).rstrip(b"=").decode()


def tree(text: str | None) -> Tree:
    groups: list[list[Branch]] = [[]]
    for line in (text or "").split("\n"):
        leaves = [_leaf_digest(x) for x in _LEAF.findall(line)]
        if len(groups[-1]) >= SECTION_PARAGRAPHS or (not leaves and groups[-1]):
            groups.append([])
        groups[-1].append(Branch(_digest(b"".join(leaves)), len(leaves), leaves=leaves))
    sections = [Branch(_digest(b"".join(p.digest for p in g)), sum(p.size for p in g), children=g) for g in groups]
    return Tree(_digest(b"".join(s.digest for s in sections)), sections)


def fingerprint(text: str | None) -> str:
    return tree(text).spelled()


def _unmatched(a: list[Branch], b: list[Branch]) -> tuple[int, list[Branch], list[Branch]]:
    """Leaves under branches that both have, and the branches of either that are left."""
    spare = Counter(x.digest for x in b)
    same, rest, used = 0, [], Counter()
    for x in a:
        if used[x.digest] < spare[x.digest]:
            used[x.digest] += 1
            same += x.size
        else:
            rest.append(x)
    other = []
    for x in b:
        if used[x.digest] > 0:
            used[x.digest] -= 1
        else:
            other.append(x)
    return same, rest, other


def likeness(a: Tree, b: Tree) -> float:
    """1 for equal roots, else the leaves in common as a share of the leaves of either (Dice, with repeats), found by descending into differing branches only."""
    if a.root == b.root:
        return 1.0
    same, x, y = _unmatched(a.sections, b.sections)
    below, x, y = _unmatched([p for s in x for p in s.children], [p for s in y for p in s.children])
    at_leaves = (Counter(l for p in x for l in p.leaves) & Counter(l for p in y for l in p.leaves)).total() if x and y else 0
    return 2 * (same + below + at_leaves) / max(1, a.size + b.size)


def differing(a: Tree, b: Tree) -> list[tuple[int, int]]:
    """(section, paragraph) positions at which two trees differ; equal branches are skipped by their digests."""
    if a.root == b.root:
        return []
    at = lambda xs, i: xs[i] if i < len(xs) else Branch(b"", 0)
    out = []
    for i in range(max(len(a.sections), len(b.sections))):
        x, y = at(a.sections, i), at(b.sections, i)
        if x.digest != y.digest:
            out += [(i, j) for j in range(max(len(x.children), len(y.children))) if at(x.children, j).digest != at(y.children, j).digest]
    return out


def edits(a: Tree, b: Tree) -> list[tuple[int, int, int, int]]:
    """(low, high, new_low, new_high): paragraphs low to high of the first text (counted from 0, high excluded) that became new_low to new_high of the second."""
    if a.root == b.root:
        return []
    x, y = ([p.digest for s in t.sections for p in s.children] for t in (a, b))
    lo = 0
    for s, r in zip(a.sections, b.sections, strict=False):
        if s.digest != r.digest:
            break
        lo += len(s.children)
    end, new_end = len(x), len(y)
    while min(end, new_end) > lo and x[end - 1] == y[new_end - 1]:
        end, new_end = end - 1, new_end - 1
    in_x, in_y = Counter(x[lo:end]), Counter(y[lo:new_end])
    place = {d: j for j, d in enumerate(y[lo:new_end], lo) if in_y[d] == 1}
    anchors = _chain([(i, place[d]) for i, d in enumerate(x[lo:end], lo) if in_x[d] == 1 and d in place])
    i, j, out = lo, lo, []
    for p, q in [*anchors, (end, new_end)]:
        while i < p and j < q and x[i] == y[j]:
            i, j = i + 1, j + 1
        e, f = p, q
        while e > i and f > j and x[e - 1] == y[f - 1]:
            e, f = e - 1, f - 1
        if e > i or f > j:
            out.append((i, e, j, f))
        i, j = p + 1, q + 1
    return out


def _chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence of pairs, sorted by the first, whose second numbers rise."""
    ends: list[int] = []  # smallest last number of a chain of each length
    at: list[int] = []  # and where it stands
    before = [-1] * len(pairs)
    for k, (_, q) in enumerate(pairs):
        n = bisect_left(ends, q)
        before[k] = at[n - 1] if n else -1
        ends[n : n + 1], at[n : n + 1] = [q], [k]
    out, k = [], at[-1] if at else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def edited(text: str, following: str) -> str:
    """text whose last quarter of code points is replaced by the first as many of the following text."""
    q = len(text) // 4
    return text[: len(text) - q] + following[:q] if q else text


COLUMNS = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edits array<struct<low:int,high:int,new_low:int,new_high:int>>"


_EDIT = ("low", "high", "new_low", "new_high")


def _row(text: str, this: Tree, after: str, following: Tree):
    new = edited(text, after)
    other = this if new == text else tree(new)
    return len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), this.spelled(), other.spelled(), likeness(this, other), likeness(this, following), [dict(zip(_EDIT, e, strict=True)) for e in edits(this, other)]


def _firsts(ids: DataFrame, n: int) -> list:
    """Smallest id of each of n ranges, from the ids alone."""
    ranged = ids.where("id is not null").repartitionByRange(n, "id")
    return sorted(r["first"] for r in ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min("id").alias("first")).collect())


def compare_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, edits) per row.

    Ids are cut into ranges of equal size; a range's rows are streamed in order with one row of look-ahead, and the
    first row of the following range is sent along as the last look-ahead. Texts cross one exchange. Only the ranges'
    smallest ids, a few for each partition, come to the driver.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    firsts = _firsts(src.select("id"), partitions or 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = spark.sparkContext.broadcast(firsts[1:])

    @F.arrow_udf("int")
    def part_of(ids: pa.Array) -> pa.Array:
        cuts = bounds.value
        if pa.types.is_integer(ids.type):
            at = np.searchsorted(np.array(cuts, np.int64), pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), side="right")
            return pc.if_else(pc.is_null(ids), pa.scalar(0, pa.int32()), pa.array(at, pa.int32()))
        return pa.array([0 if x is None else bisect_right(cuts, x) for x in ids.to_pylist()], pa.int32())

    rows = src.select(part_of("id").alias("part"), F.lit(False).alias("ahead"), "id", "text")
    starts = spark.createDataFrame([(x, i) for i, x in enumerate(firsts[1:])], f"first {kind}, part int")
    ahead = src.join(F.broadcast(starts), src["id"] == starts["first"]).select("part", F.lit(True).alias("ahead"), "id", "text")
    head = src.where(F.col("id").isNull() | F.col("id").isin(firsts[:1])).orderBy(F.col("id").asc_nulls_first(), "text").limit(1)
    wrap = head.select(F.lit(max(0, len(firsts) - 1)).alias("part"), F.lit(True).alias("ahead"), "id", "text")

    def run(batches):
        held = None
        for b in batches:
            out = []
            for part, ahead, key, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                this = tree(text)
                if held is not None and held[0] == part and not held[1]:
                    out.append((held[2], *_row(held[3], held[4], text, this)))
                held = (part, ahead, key, text, this)
            yield pa.record_batch([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edits"]
    types = [to_arrow_type(src.schema["id"].dataType), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.struct([(n, pa.int32()) for n in _EDIT]))]
    dealt = rows.union(ahead).union(wrap).repartition("part").sortWithinPartitions("part", "ahead", F.col("id").asc_nulls_first(), "text")
    return dealt.mapInArrow(run, f"id {kind}, {COLUMNS}")
