"""Transcript parsing: roles by a hidden Markov model, decoded by Viterbi, then rendered as canonical turns.

The unit is a line; states are a role's first line and its further lines; a line's observation is the kind of speaker
marker it starts with (a known name of one of the roles, or a name that no table has), whether it ends with a question
mark, its length class, and whether it opens a segment. Segments may be turns, lines or whole transcripts, so the last one
is weak evidence only (TORN), which a marker outweighs. A conversation's segments are sorted by ranges and cut into blocks of BLOCK segments by count.
Max-plus products are associative, so a block is summed up by a states x states matrix; FAN blocks are summed up by one
matrix, FAN of those by another, and so on to one for a conversation. From there the best states at borders are found on
the way down, and each block is decoded between its borders: the same path as Viterbi over the whole, with at most BLOCK
segments or FAN matrices in one group.

A marker with a known name is cut off. One that no table has may be part of the text ("Note: ..."), so it is cut off where
it is shown to be a speaker's: in a conversation where two turns or more begin with it, and at least MOST of the turns of the roles that use it most,
and in every turn that begins with a name that two conversations or more show so, or have before a role's only turn while
they show another role's name. Elsewhere it stays in the text.
Segments are ordered by seq within a conversation. Nulls and empty texts: a null text is an empty line; a null conversation
id is a conversation of its own; null seqs come first. Ties and repeated rows: segments that repeat a seq follow each other
in order of their texts. A very long text is one segment of many lines. An empty table gives an empty result, and a model
fitted on it knows only its smoothing. Other columns, whatever their names, are never read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import _changes, scan_groups, stash

ROLES = ("system", "user", "assistant")
BLOCK, FAN = 64, 64
STATES = 2 * len(ROLES)  # 2r: first line of role r, 2r + 1: further line
# Names that speaker markers use for each role.
NAMES = {"system": ("system", "instructions", "context", "setup"), "user": ("user", "human", "q", "question", "customer", "me", "you"), "assistant": ("assistant", "ai", "a", "answer", "bot", "model", "agent")}
_ROLE_OF = {n: r for r, role in enumerate(ROLES) for n in NAMES[role]}
_MARKER = re.compile(r"^\s*(?:[#>*\[(<|]+\s*)?([A-Za-z]{1,12})\s*(?:[\])>|*]+\s*:?|:|\s[-—–])\s*")
UNKNOWN = len(ROLES) + 1  # the kind of a marker whose name no table has
OBSERVATIONS = (UNKNOWN + 1) * 2 * 3
TORN = 0.05  # the share of turns taken to begin inside a segment, and of segments to begin inside a turn
MOST = 0.8


def marker(line: str) -> tuple[int, str]:
    """(0 without a marker, role + 1, or UNKNOWN; the line, without its marker if the name is known)."""
    m = _MARKER.match(line)
    if m is None:
        return 0, line
    role = _ROLE_OF.get(m[1].lower())
    return (UNKNOWN, line) if role is None else (role + 1, line[m.end() :])


def observe(line: str) -> int:
    kind, rest = marker(line)
    return kind * 6 + (3 if rest.rstrip().endswith("?") else 0) + min(2, len(rest) // 120)


def observed(segments: list[str]) -> list[int]:
    """Observations of the lines of segments; those of a segment's first line come after the others'."""
    return [observe(x) + OBSERVATIONS * (i == 0) for s in segments for i, x in enumerate(s.split("\n"))]


@dataclass
class Model:
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray

    def matrix(self, obs: list[int], first: bool) -> np.ndarray:
        """Max-plus product over a block: entry state before it (row) to state of its last line."""
        m = np.where(np.eye(STATES, dtype=bool), 0.0, -np.inf)
        for i, o in enumerate(obs):
            move = np.tile(self.start, (STATES, 1)) if first and i == 0 else self.step
            m = (m[:, :, None] + move[None]).max(axis=1) + self.emit[:, o][None]
        return m

    def path(self, obs: list[int], first: bool, enter: int, leave: int) -> list[int]:
        """Best states of a block's lines, given the state before it and that of its last line."""
        score, back = np.where(np.arange(STATES) == enter, 0.0, -np.inf), []
        for i, o in enumerate(obs):
            move = np.tile(self.start, (STATES, 1)) if first and i == 0 else self.step
            total = score[:, None] + move
            back.append(total.argmax(axis=0))
            score = total.max(axis=0) + self.emit[:, o]
        states, at = [], leave
        for b in reversed(back):
            states.append(at)
            at = int(b[at])
        return states[::-1]


def _blocks(segments: DataFrame, conv: str, seq: str, text: str, role: str | None = None) -> tuple[DataFrame, int]:
    """((conv, idx, at, role, text), levels): segments in blocks idx = 0, 1, ... of a conversation; levels of FAN to hold them all.

    Ranges of (conversation, seq, start of the text) are sorted and numbered where they lie; a conversation has as many
    rows in the table of their sizes as it has ranges.
    """
    src = segments.select(F.col(conv).alias("conv"), F.col(seq).alias("seq"), F.coalesce(F.col(text), F.lit("")).alias("text"), (F.col(role) if role else F.lit(None).cast("string")).alias("role"))
    kind = src.schema["conv"].dataType.simpleString()
    parts = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = src.repartitionByRange(parts, "conv", "seq", F.substring("text", 1, 32)).sortWithinPartitions("conv", "seq", "text")

    def number(batches):
        part, last, count = TaskContext.get().partitionId(), None, 0
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            key = b.column(0)
            fresh = np.concatenate(([True], _changes(pa.chunked_array([key])).to_numpy(zero_copy_only=False))) if n > 1 else np.ones(1, bool)
            starts = np.flatnonzero(fresh)
            k = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n)))
            if count and key[0].as_py() == last:
                k[: starts[1] if len(starts) > 1 else n] += count
            last, count = key[n - 1].as_py(), int(k[-1]) + 1
            yield pa.record_batch([key, pa.array(np.full(n, part, np.int32)), pa.array(k // BLOCK), pa.array(k % BLOCK), b.column(3), b.column(2)], names=["conv", "part", "blk", "at", "role", "text"])

    found = stash(ranged.mapInArrow(number, f"conv {kind}, part int, blk bigint, at bigint, role string, text string"), "segments")
    sizes = found.groupBy("conv", "part").agg((F.max("blk") + 1).alias("n"))
    before = sizes.select(F.col("conv").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    out = found.join(before, found["conv"].eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).select("conv", (F.col("before") + F.col("blk")).alias("idx"), "at", "role", "text")
    most, levels = out.agg(F.max("idx")).first()[0] or 0, 1
    while FAN**levels <= most:
        levels += 1
    return out, levels


def _group() -> Column:
    return F.floor(F.col("idx") / FAN).cast("long")


def _beside(child: DataFrame, parent: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """child with columns of the parent row of its conversation whose idx is child's `on`."""
    p = parent.select(F.col("conv").alias("__c"), F.col("idx").alias("__i"), *columns)
    return child.join(p, child["conv"].eqNullSafe(F.col("__c")) & (child[on] == F.col("__i"))).drop("__c", "__i")


def fit(turns: DataFrame, conv: str = "conv_id", seq: str = "turn", role: str = "role", text: str = "text") -> Model:
    """Counts of observations and role changes over all labelled turns, smoothed; changes over block borders are counted too."""
    blocks, _ = _blocks(turns.where(F.col(role).isin(*ROLES)), conv, seq, text, role)
    kind, arrow = blocks.schema["conv"].dataType.simpleString(), to_arrow_type(blocks.schema["conv"].dataType)

    def run(t: pa.Table):
        n, before, first = {}, None, None
        opening = t.column("idx")[0].as_py() == 0
        for r, x in zip(t.column("role").to_pylist(), t.column("text").to_pylist(), strict=True):
            k = ROLES.index(r)
            for i, line in enumerate(x.split("\n")):
                now = 2 * k + (i > 0)
                first = now if first is None else first
                for key in [("emit", now, observe(line))] + ([("step", before, now)] if before is not None else [("start", 0, now)] if opening else []):
                    n[key] = n.get(key, 0) + 1
                before = now
        rows = [(*k, c) for k, c in n.items()] + [("border", first, before, 1)]
        cols = [pa.array([t.column(c)[0].as_py()] * len(rows), ty) for c, ty in (("conv", arrow), ("idx", pa.int64()))]
        yield pa.record_batch(cols + [pa.array([r[i] for r in rows], ty) for i, ty in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int64()))], names=["conv", "idx", "what", "a", "b", "n"])

    found = stash(scan_groups(blocks, ["conv", "idx"], ["at"], run, f"conv {kind}, idx bigint, what string, a int, b int, n bigint"), "role-counts")
    borders = found.where("what = 'border'")
    over = _beside(borders.withColumn("nextidx", F.col("idx") + 1).select("conv", "nextidx", F.col("b").alias("left")), borders, "nextidx", ["a"]).select(F.lit("step").alias("what"), F.col("left").alias("a"), F.col("a").alias("b"), F.lit(1).cast("long").alias("n"))
    counted = found.where("what <> 'border'").select("what", "a", "b", "n").union(over).groupBy("what", "a", "b").agg(F.sum("n").alias("n")).collect()
    tables = {"start": np.full((1, STATES), 0.5), "step": np.full((STATES, STATES), 0.5), "emit": np.full((STATES, OBSERVATIONS), 0.5)}
    for r in counted:
        tables[r["what"]][r["a"], r["b"]] += r["n"]
    tables["start"][0, 1::2] = 1e-6  # a transcript can't open inside a turn
    for k in range(len(ROLES)):  # nor can a turn go on as another role's
        tables["step"][:, 2 * k + 1] = np.where(np.arange(STATES) // 2 == k, tables["step"][:, 2 * k + 1], 1e-6)
    norm = {k: np.log(v / v.sum(axis=1, keepdims=True)) for k, v in tables.items()}
    further = np.arange(STATES) % 2 == 1
    inside, opens = (np.log(np.where(further == x, TORN, 1 - TORN))[:, None] for x in (False, True))
    return Model(norm["start"][0], norm["step"], np.hstack([norm["emit"] + inside, norm["emit"] + opens]))


def _up(summed: DataFrame, levels: int, kind: str, arrow: pa.DataType) -> list[DataFrame]:
    """Tables of matrices (conv, idx, m), from the blocks' to one for a conversation."""

    def combine(t: pa.Table):
        m = None
        for x in t.column("m").to_pylist():
            x = np.array(x).reshape(STATES, STATES)
            m = x if m is None else (m[:, :, None] + x[None]).max(axis=1)
        yield pa.record_batch([pa.array([t.column("conv")[0].as_py()], arrow), pa.array([t.column("g")[0].as_py()], pa.int64()), pa.array([m.ravel().tolist()], pa.list_(pa.float64()))], names=["conv", "idx", "m"])

    out = [stash(summed, "matrices")]
    for _ in range(levels):
        out.append(stash(scan_groups(out[-1].withColumn("g", _group()), ["conv", "g"], ["idx"], combine, f"conv {kind}, idx bigint, m array<double>"), "matrices"))
    return out


def _down(tables: list[DataFrame], kind: str) -> DataFrame:
    """(conv, idx, enter, leave): the best states before and at the end of every block."""

    def ends(t: pa.Table):
        best = [int(np.array(x).reshape(STATES, STATES)[0].argmax()) for x in t.column("m").to_pylist()]
        yield pa.record_batch([t.column("conv").combine_chunks(), t.column("idx").combine_chunks(), pa.array([0] * len(best), pa.int32()), pa.array(best, pa.int32())], names=["conv", "idx", "enter", "leave"])

    def borders(t: pa.Table):
        score, back = np.where(np.arange(STATES) == t.column("enter")[0].as_py(), 0.0, -np.inf), []
        for x in t.column("m").to_pylist():
            total = score[:, None] + np.array(x).reshape(STATES, STATES)
            back.append(total.argmax(axis=0))
            score = total.max(axis=0)
        leave = [t.column("leave")[0].as_py()]
        for b in reversed(back):
            leave.append(int(b[leave[-1]]))
        leave = leave[::-1]
        yield pa.record_batch([t.column("conv").combine_chunks(), t.column("idx").combine_chunks(), pa.array(leave[:-1], pa.int32()), pa.array(leave[1:], pa.int32())], names=["conv", "idx", "enter", "leave"])

    schema = f"conv {kind}, idx bigint, enter int, leave int"
    at = scan_groups(tables[-1], ["conv"], ["idx"], ends, schema)
    for t in reversed(tables[:-1]):
        at = stash(scan_groups(_beside(t.withColumn("g", _group()), at, "g", ["enter", "leave"]), ["conv", "g"], ["idx"], borders, schema), "borders")
    return at


def _offsets(counts: DataFrame, levels: int) -> DataFrame:
    """(conv, idx, before): the sum of n over a conversation's blocks before each, by way of FAN blocks, FAN of those, ..."""
    tables = [stash(counts, "turn-counts")]
    for _ in range(levels):
        tables.append(stash(tables[-1].groupBy("conv", _group().alias("idx")).agg(F.sum("n").alias("n")), "turn-counts"))
    at = tables[-1].select("conv", "idx", F.lit(0).cast("long").alias("before"))
    for t in reversed(tables[:-1]):
        inner = F.coalesce(F.sum("n").over(Window.partitionBy("conv", "g").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        at = _beside(t.withColumn("g", _group()).withColumn("inner", inner), at, "g", ["before"]).select("conv", "idx", (F.col("before") + F.col("inner")).alias("before"))
    return at


def _without_names(turns: DataFrame) -> DataFrame:
    """(conv, turn_no, role, text): turns without the markers that are shown to be names.

    Counts per (conversation, role, marker) are summed before the exchange; only turns that begin with an unlisted name are joined with them.
    """
    name = F.trim("mark")
    counts = turns.groupBy("conv", "role", name.alias("name")).agg(F.count("*").alias("k"))
    per_role = counts.groupBy("conv", "role").agg(F.sum("k").alias("n"), F.max_by("name", F.when(F.col("name").isNotNull(), F.col("k"))).alias("name"), F.max(F.when(F.col("name").isNotNull(), F.col("k"))).alias("k"))
    per_name = per_role.where("name is not null").groupBy("conv", "name").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    shown = stash(per_name.where((F.col("k") >= 2) & (F.col("k") >= MOST * F.col("n"))).select(F.col("conv").alias("__c"), F.col("name").alias("__n")), "names")
    once = per_role.where("n = 1 and name is not null").select("conv", F.col("name").alias("__n"))
    beside = once.join(shown.select("__c"), once["conv"].eqNullSafe(F.col("__c")), "left_semi").withColumnRenamed("conv", "__c")
    common = shown.select("__c", "__n").union(beside.select("__c", "__n")).groupBy(F.col("__n").alias("__m")).agg(F.count_distinct(F.coalesce(F.xxhash64("__c"), F.lit(0))).alias("__k")).where("__k >= 2").select("__m")
    marked = turns.where("mark is not null").withColumn("__name", name)
    own = marked.join(shown, marked["conv"].eqNullSafe(F.col("__c")) & (F.col("__name") == F.col("__n")), "left").join(common, F.col("__name") == F.col("__m"), "left")
    cut = F.when(F.col("__n").isNotNull() | F.col("__m").isNotNull(), F.substring("text", F.length("mark") + 1, F.length("text"))).otherwise(F.col("text"))
    return own.select("conv", "turn_no", "role", cut.alias("text")).union(turns.where("mark is null").select("conv", "turn_no", "role", "text"))


def parse(segments: DataFrame, model: Model, conv: str = "conv_id", seq: str = "turn", text: str = "text") -> DataFrame:
    """(conv, turn_no, role, text, rendered): the recovered turns of every conversation."""
    blocks, levels = _blocks(segments, conv, seq, text)
    kind, arrow = blocks.schema["conv"].dataType.simpleString(), to_arrow_type(blocks.schema["conv"].dataType)
    shared = segments.sparkSession.sparkContext.broadcast(model)
    one = lambda t, name: t.column(name)[0].as_py()
    lines_of = lambda t: [x for s in t.column("text").to_pylist() for x in s.split("\n")]

    def sums(t: pa.Table):
        m = shared.value.matrix(observed(t.column("text").to_pylist()), one(t, "idx") == 0)
        yield pa.record_batch([pa.array([one(t, "conv")], arrow), pa.array([one(t, "idx")], pa.int64()), pa.array([m.ravel().tolist()], pa.list_(pa.float64()))], names=["conv", "idx", "m"])

    def decode(t: pa.Table):
        lines = lines_of(t)
        states = shared.value.path(observed(t.column("text").to_pylist()), one(t, "idx") == 0, one(t, "enter"), one(t, "leave"))
        rows: list[list] = []
        for line, s in zip(lines, states, strict=True):
            begins = s % 2 == 0
            if begins or not rows:
                kind, rest = marker(line)
                mark = _MARKER.match(line)[0] if kind == UNKNOWN and begins else None
                rows.append([s // 2, begins, [rest if begins else line], mark])
            else:
                rows[-1][2].append(line)
        k = np.cumsum([r[1] for r in rows])
        yield pa.record_batch(
            [pa.array([one(t, "conv")] * len(rows), arrow), pa.array([one(t, "idx")] * len(rows), pa.int64()), pa.array(k, pa.int64()), pa.array([ROLES[r[0]] for r in rows]), pa.array(["\n".join(r[2]) for r in rows]), pa.array([r[3] for r in rows], pa.string())],
            names=["conv", "idx", "k", "role", "text", "mark"],
        )

    summed = scan_groups(blocks, ["conv", "idx"], ["at"], sums, f"conv {kind}, idx bigint, m array<double>")
    ends = _down(_up(summed, levels, kind, arrow), kind)
    parts = stash(scan_groups(_beside(blocks, ends, "idx", ["enter", "leave"]), ["conv", "idx"], ["at"], decode, f"conv {kind}, idx bigint, k bigint, role string, text string, mark string"), "turn-parts")
    before = _offsets(parts.groupBy("conv", "idx").agg(F.max("k").alias("n")), levels)
    numbered = _beside(parts, before, "idx", ["before"]).select("conv", (F.col("before") + F.col("k") - 1).alias("turn_no"), "idx", "role", "text", "mark")
    # A turn that runs over a block border comes in parts.
    whole = numbered.groupBy("conv", "turn_no").agg(F.first("role").alias("role"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"]), "\n").alias("text"), F.max("mark").alias("mark"))
    whole = _without_names(stash(whole, "turns"))
    return whole.withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("<|end|>\n")))


# The markers of the transcript styles that the query writes; None leaves a role unmarked.
STYLES = (("System: ", "User: ", "Assistant: "), ("### Instructions: ", "### Human: ", "### AI: "), ("[system] ", "Q: ", "A: "), ("System — ", "User: ", None), ("Notice: ", "Alice: ", "Bob: "))
#: Styles of held-out conversations: names that the model has not met, and roles without a marker.
UNSEEN = (("[admin] ", "Client> ", "Desk> "), ("Host: ", "** Visitor ** ", None), ("setup: ", "Customer: ", "Agent: "))


def transcripts(turns: DataFrame, conv: str = "conv_id", seq: str = "turn", role: str = "role", text: str = "text", styles: tuple = STYLES) -> DataFrame:
    """Raw transcript segments of labelled turns, each conversation in one of the styles by a hash of its id."""
    style = F.pmod(F.xxhash64(F.lit("style"), conv), F.lit(len(styles)))
    mark = F.lit("")
    for s, names in enumerate(styles):
        for r, m in zip(ROLES, names, strict=True):
            mark = F.when((style == s) & (F.col(role) == r), F.lit(m or "")).otherwise(mark)
    return turns.withColumn(text, F.concat(mark, F.coalesce(F.col(text), F.lit(""))))
