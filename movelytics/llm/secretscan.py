"""Secrets in texts: fixed patterns, and a character convolutional network over every other candidate and its context.

Candidates are runs of token characters of 12 or more, and values of 6 or more after a name and `:` or `=`. What the
patterns find is labelled a finding, and candidates of texts without any finding are labelled clean; the network is
trained on all distinct ones (with copies of the findings under other names, in other alphabets and without a name), its
logits are calibrated on held-out ones (Platt's logistic curve), and for keyed and bare candidates apart the threshold is
the largest that keeps RECALL of the held-out findings of each kind. A candidate that overlaps no pattern's match and
reaches its threshold adds a span of the kind `model`.

The distinct candidates are dealt to shards of about SHARD. In an epoch every shard goes on from the shared weights and
moments in minibatches of its own, and the mean of the shards' results, weighted by their rows, is shared in the next
epoch; a table of one shard is trained as by one process. Only those sums, the calibration's counts per hundredth of a
logit and a threshold for each kind come to the driver.

Nulls and empty texts: no spans, digests of the empty text. Very long texts are looked at whole; a long candidate goes
through the network in pieces that overlap by a kernel, in the fit as in the scan, so its score does not depend on them. Ties: equal candidates
in equal contexts have equal scores. Repeated rows: one result each. Without 10 distinct findings and clean candidates, an empty
table among them, there is no network and no span is added. Other columns, whatever their names, are never read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.order import running
from .common import scan_groups, stash

KINDS = ("assign", "access", "hex", "model")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_NAMES = ("passw", "secret", "token", "api")
_ACCESS = re.compile("AKIA[A-Z0-9]{16,}")
_HEX = re.compile("[0-9a-f]{24,}")  # leftmost matches are whole runs, so this equals runs of 24 or more
_TOKEN = bytes(c in b"+/_.=-" or bytes([c]).isalnum() for c in range(256))
_VALUE = re.compile(r"""[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})""")
LEFT, RIGHT = 24, 8
#: Distinct candidates of a shard, about, if they have 64 characters with their context; of fewer if they are longer.
SHARD = 8_192
RECALL = 0.98
#: Findings and clean candidates that a fit needs, and copies that are made of each in a shard.
LEAST, VARIANTS = 10, 500
PIECE, PLACES, AT_ONCE = 4_096, 65_536, 8_192
SEED, EPOCHS, BATCH = 13, 8, 64
KERNEL, DEPTH, FILTERS = 5, 12, 32
#: Places that batches are planned for at a time, places of a character whose gradients are added up at a time, and shards that a task trains at a time.
AHEAD, SPAN, IN_STEP = 65_536, 8, 2


def tokens(text: str) -> list[tuple[int, int]]:
    """(start, end) of runs of 12 or more token characters, which are all ASCII: one byte a character tells them."""
    inside = np.frombuffer(b"\0" + text.encode("latin-1", "replace").translate(_TOKEN) + b"\0", np.uint8)
    turns = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)
    return turns[turns[:, 1] - turns[:, 0] >= 12].tolist()


def patterns(text: str, runs: list[tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the fixed patterns find, by start, then kind. Texts that lack what a pattern needs are not searched for it."""
    found = []
    runs = tokens(text) if runs is None else runs
    low = text.lower() if ":" in text or "=" in text else ""
    if any(name in low for name in _NAMES):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    for s, e in runs:  # hexadecimal digits are token characters, so each match lies in a run
        if e - s >= 24:
            found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text, s, e)]
    return sorted(found)


def candidates(text: str, runs: list[tuple[int, int]] | None = None) -> list[tuple[int, int, bool]]:
    """(start, end, keyed): values after a name, and token runs that hold no such value."""
    keyed = [(m.start(1), m.end(1), True) for m in _VALUE.finditer(text)] if ":" in text or "=" in text else []
    out, k = [], 0
    for s, e in tokens(text) if runs is None else runs:
        while k < len(keyed) and keyed[k][1] <= s:
            out.append(keyed[k])
            k += 1
        if k == len(keyed) or keyed[k][0] >= e:
            out.append((s, e, False))
    return out + keyed[k:]


def touched(found: list[tuple[int, int, bool]], base: list[tuple[int, int, int]]) -> list[int]:
    """For each candidate, in order of start, the largest kind whose match it overlaps, or -1. Matches of one kind never overlap, so each kind is one merge."""
    out = [-1] * len(found)
    for kind in range(3):
        mine, i = [(s, e) for s, k, e in base if k == kind], 0
        for j, (s, e, _) in enumerate(found):
            while i < len(mine) and mine[i][1] <= s:
                i += 1
            if i < len(mine) and mine[i][0] < e:
                out[j] = kind
    return out


def spell(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


_CANDIDATE = "struct<start:int,end:int,keyed:boolean,left:string,value:string,right:string,kind:int>"


def _looked(batches):
    """One row a text: what the patterns find, and the candidates with their context; kind is the pattern that a candidate lies in, or -1."""
    for b in batches:
        counts: list[list[int]] = [[], [], []]
        spans, cands = [[0], *([] for _ in _SPAN)], [[0], *([] for _ in _CAND)]
        for t in b.column(1).to_pylist():
            t = t or ""
            runs = tokens(t)
            base, found = patterns(t, runs), candidates(t, runs)
            _append(spans, base)
            _append(cands, [(s, e, keyed, t[max(0, s - LEFT) : s], t[s:e], t[e : e + RIGHT], kind) for (s, e, keyed), kind in zip(found, touched(found, base), strict=True)])
            for k, c in enumerate(counts):
                c.append(sum([x[1] == k for x in base]))
        made = [b.column(0), _lists(spans, _SPAN), *[pa.array(c, pa.int64()) for c in counts], _lists(cands, _CAND)]
        yield pa.record_batch(made, names=["id", "spans", "n_assign", "n_access", "n_hex", "cands"])


_SPAN = {"start": pa.int32(), "kind": pa.int32(), "end": pa.int32()}
_CAND = {"start": pa.int32(), "end": pa.int32(), "keyed": pa.bool_(), "left": pa.string(), "value": pa.string(), "right": pa.string(), "kind": pa.int32()}


def _append(columns: list[list], rows: list[tuple]) -> None:
    """One text's rows; the first column holds where each text's rows end."""
    for column, values in zip(columns[1:], zip(*rows, strict=True), strict=False):
        column += values
    columns[0].append(columns[0][-1] + len(rows))


def _flat(lists: pa.ListArray) -> list[np.ndarray]:
    """The row that each struct in lists is of, and the structs' fields."""
    return [x.to_numpy(zero_copy_only=False) for x in (pc.list_parent_indices(lists), *lists.flatten().flatten())]


def _lists(columns: list[list], kinds: dict[str, pa.DataType]) -> pa.Array:
    fields = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns[1:], kinds.values(), strict=True)], names=list(kinds))
    return pa.ListArray.from_arrays(pa.array(columns[0], pa.int32()), fields)


def look(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans, n_assign, n_access, n_hex, cands), one row a text; written once, so that texts are read once."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    schema = f"id {kind}, spans array<struct<start:int,kind:int,end:int>>, n_assign bigint, n_access bigint, n_hex bigint, cands array<{_CANDIDATE}>"
    return stash(src.mapInArrow(_looked, schema), "secret-candidates")


_CLASS = np.array([c - 31 if 32 <= c < 127 else 96 if 9 <= c <= 13 else 97 for c in range(128)], np.uint8)


class Rows(Sequence):
    """Encoded candidates, (classes, tags) of each, which lie one behind another."""

    def __init__(self, ids: np.ndarray, tags: np.ndarray, sizes: np.ndarray):
        self.ids, self.tags, self.sizes, self.ends = ids, tags, sizes, np.cumsum(sizes)

    @staticmethod
    def joined(parts: list[Rows]) -> Rows:
        return Rows(*[np.concatenate([getattr(x, c) for x in parts]) for c in ("ids", "tags", "sizes")])

    @staticmethod
    def of(rows: Sequence[tuple[np.ndarray, np.ndarray]]) -> Rows:
        if isinstance(rows, Rows):
            return rows
        ids, tags = (np.concatenate([np.zeros(0, np.uint8), *[r[k] for r in rows]]) for k in (0, 1))
        return Rows(ids, tags, np.array([len(r[0]) for r in rows], int))

    def __len__(self) -> int:
        return len(self.sizes)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.ends[i] - self.sizes[i], self.ends[i])
        return self.ids[at], self.tags[at]


def encode(left: str, value: str, right: str) -> tuple[np.ndarray, np.ndarray]:
    """Character classes (1-95 printable ASCII, 96 white space, 97 other) and place tags (1 left, 2 value, 3 right)."""
    return encode_all([left], [value], [right])[0]


def encode_all(left: list[str], value: list[str], right: list[str]) -> Rows:
    """Each candidate's classes and tags, found for all of them together."""
    parts = [x for of in zip(left, value, right, strict=True) for x in of]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ids = _CLASS[np.minimum(np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4"), 127)]
    tags = np.repeat(np.tile(np.array([1, 2, 3], np.uint8), len(left)), sizes)
    return Rows(ids, tags, sizes.reshape(-1, 3).sum(1))


SHAPES = [(98, DEPTH), (4, DEPTH), (KERNEL * DEPTH, FILTERS), (FILTERS,), (2 * FILTERS,), (1,)]
#: Place tags, characters by tags, and what a window beyond its row's last one is worth.
TAGS, CODES, _FAR = SHAPES[1][0], SHAPES[0][0] * SHAPES[1][0], -1e9
_ENDS = np.cumsum([int(np.prod(shape)) for shape in SHAPES])


def _views(flat: np.ndarray) -> list[np.ndarray]:
    return [x.reshape(shape) for x, shape in zip(np.split(flat, _ENDS[:-1]), SHAPES, strict=True)]


@dataclass
class Network:
    """Characters and tags embedded and added up, one convolution, largest and mean activation over the places, a linear unit; then calibration and thresholds."""

    weights: list[np.ndarray]
    slope: float = 1.0
    offset: float = 0.0
    thresholds: tuple[float, float] = (0.5, 0.5)  # bare, keyed

    @staticmethod
    def fresh(rng: np.random.Generator) -> Network:
        spreads = [0.3, 0.3, (2 / (KERNEL * DEPTH)) ** 0.5, 0.0, 0.1, 0.0]
        return Network([rng.normal(0, s, shape) if s else np.zeros(shape) for shape, s in zip(SHAPES, spreads, strict=True)])

    def forward(self, ids: np.ndarray, tags: np.ndarray, lengths: np.ndarray) -> dict:
        """ids and tags (row, place) padded with 0; lengths of the rows. Windows that begin beyond a row's last whole one are not looked at.

        The rows' places follow each other along the last axis, without the padding beyond KERNEL. A window has two values
        more: 1, which the bias goes by, and 1 if it is not looked at, by which it ends far below 0.
        """
        e, g, w, b, v, c = self.weights
        both = (e[:, None] + g).reshape(-1, DEPTH)
        both[: len(g)] = 0
        size = np.maximum(KERNEL, lengths)
        codes = (ids * len(g) + tags)[np.arange(ids.shape[1]) < size[:, None]]
        ends = np.cumsum(size)
        x = np.ascontiguousarray(both.take(codes, axis=0).T)
        windows = np.empty((KERNEL * DEPTH + 2, len(codes)), w.dtype)
        for k in range(KERNEL):
            windows[k * DEPTH : (k + 1) * DEPTH, : len(codes) - k] = x[:, k:]
            windows[k * DEPTH : (k + 1) * DEPTH, len(codes) - k :] = 0
        windows[-2:] = [[1], [0]]
        windows[-1, (ends[:, None] - np.arange(1, KERNEL)).ravel()] = 1
        z = np.vstack([w, b, np.full_like(b, _FAR)]).T @ windows
        np.maximum(z, 0, out=z)
        most, total = np.maximum.reduceat(z, ends - size, axis=1), np.add.reduceat(z, ends - size, axis=1)
        return {"windows": windows, "codes": codes, "z": z, "size": size, "max": most.T, "sum": total.T, "n": size - KERNEL + 1}

    def logits(self, most: np.ndarray, mean: np.ndarray) -> np.ndarray:
        return np.hstack([most, mean]) @ self.weights[4] + self.weights[5]

    def pooled(self, rows: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """Largest and mean activations of encoded candidates, AT_ONCE places at a time; long ones are cut into pieces that overlap by a kernel less one."""
        keep_memory()
        cut = Rows.of(rows)
        if cut.sizes.max(initial=0) > PIECE:
            pieces = _pieces(rows)
            of, cut = np.array([p[0] for p in pieces]), Rows.of([p[1:] for p in pieces])
        size = np.maximum(KERNEL, cut.sizes)
        order = np.argsort(-size, kind="stable")
        at = (np.cumsum(size[order]) - 1) // min(PLACES, AT_ONCE)
        picks = np.split(order, np.flatnonzero(np.diff(at)) + 1) if len(rows) else []
        most, total = np.empty((2, len(cut), FILTERS), self.weights[2].dtype)
        tables = None
        for plan in _plans(cut, [[(0, pick)] for pick in picks], 1, False):
            if tables is None:
                _, tables = _tables([w[None] for w in self.weights], plan.alphabet)
            most[plan.of], total[plan.of] = _pool(_activations(tables, plan.seen), plan.ranks)
        count = size - KERNEL + 1.0
        if len(cut) > len(rows):
            first = np.flatnonzero(np.diff(of, prepend=-1))
            most, total, count = np.maximum.reduceat(most, first), np.add.reduceat(total, first), np.add.reduceat(count, first)
        return most, total / count.astype(total.dtype)[:, None]

    def raw(self, rows: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Logits of encoded candidates."""
        return self.logits(*self.pooled(rows))

    def cut(self, logits: list[float]) -> float:
        """The threshold that keeps the least of the logits, a hair below it, as its sums end otherwise in another batch; a half without one."""
        return float(1 / (1 + np.exp(-np.clip(self.slope * min(logits) + self.offset, -40, 40)))) * (1 - 1e-9) if len(logits) else 0.5

    def probabilities(self, rows: Sequence[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(rows) + self.offset, -40, 40)))


def _pieces(rows: Sequence[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    return [(i, ids[at : at + PIECE + KERNEL - 1], tags[at : at + PIECE + KERNEL - 1]) for i, (ids, tags) in enumerate(rows) for at in range(0, max(1, len(ids) - KERNEL + 1), PIECE)]


def chunks(rows: Sequence[tuple[np.ndarray, np.ndarray]]):
    """(rows that they are of, padded places) of pieces of like length, about AT_ONCE places at a time; long rows are cut into pieces that overlap by a kernel less one, so that each window is seen once."""
    pieces = sorted(_pieces(rows), key=lambda p: len(p[1]))
    at = 0
    while at < len(pieces):
        end = at + 1
        while end < len(pieces) and (end + 1 - at) * len(pieces[end][1]) <= min(PLACES, AT_ONCE):
            end += 1
        yield np.array([p[0] for p in pieces[at:end]]), padded([p[1:] for p in pieces[at:end]])
        at = end


def keep_memory() -> None:
    """Freed arrays of up to this size stay with the process, which else gives them back and faults them in anew for every batch."""
    np.empty(1 << 24, np.uint8)


def padded(rows: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.array([len(r[0]) for r in rows])
    ids = np.zeros((len(rows), max(KERNEL, lengths.max())), np.int64)
    tags = np.zeros_like(ids)
    real = np.arange(ids.shape[1]) < lengths[:, None]
    ids[real], tags[real] = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    return ids, tags, lengths


def balance(y: np.ndarray) -> np.ndarray:
    """Weights of labels 0 and 1 that give both classes half of the whole."""
    return np.array([0.5 * len(y) / max(1, (y == k).sum()) for k in (0, 1)])


def train(rows: Sequence[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = EPOCHS) -> Network:
    """Logistic loss by Adam, classes of equal weight."""
    state, steps = fresh_state()
    for epoch in range(epochs):
        state, steps = one_epoch(state, steps, rows, y, balance(y), epoch, epochs)
    return Network([w.astype(float) for w in _views(state[0])])


def fresh_state() -> tuple[np.ndarray, int]:
    """(weights and Adam's two moments, steps made)."""
    flat = np.concatenate([w.ravel() for w in Network.fresh(np.random.default_rng(SEED)).weights])
    return np.stack([flat, np.zeros_like(flat), np.zeros_like(flat)]), 0


def one_epoch(state: np.ndarray, steps: float, rows: Sequence[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weights: np.ndarray, epoch: int, epochs: int, shard: int = 0) -> tuple[np.ndarray, float]:
    """The state after an epoch over the rows, in single precision."""
    return next(shard_epochs(state, steps, [(shard, rows, y)], weights, epoch, epochs))


def shard_epochs(state: np.ndarray, steps: float, shards: list[tuple[int, Sequence[tuple[np.ndarray, np.ndarray]], np.ndarray]], weights: np.ndarray, epoch: int, epochs: int) -> Iterator[tuple[np.ndarray, float]]:
    """The states of shards after an epoch, each from the same state by batches of its own; they go in step, so that a call of numpy serves all of them."""
    keep_memory()
    order = sorted(range(len(shards)), key=lambda k: -len(shards[k][1]))  # those that still have batches come first
    rows, y = Rows.joined([Rows.of(shards[k][1]) for k in order]), np.concatenate([shards[k][2] for k in order])
    lengths = rows.sizes
    picks, at = [], 0
    for shard, of, _ in (shards[k] for k in order):
        mixed = at + np.random.default_rng([SEED, epoch, shard]).permutation(len(of))
        picks.append([mixed[i : i + BATCH] for i in range(0, len(of), BATCH)])
        at += len(of)
    turns = [[(k, x[i]) for k, x in enumerate(picks) if i < len(x)] for i in range(len(picks[0]))]
    long = [[(k, pick) for k, pick in turn if not _short(lengths[pick])] for turn in turns]
    plans = _plans(rows, [[x for x in turn if all(x[0] != k for k, _ in apart)] for turn, apart in zip(turns, long, strict=True)], len(shards))
    p, m1, m2 = state.astype(np.float32)[:, None].repeat(len(shards), axis=1)
    rate = 4e-3 * 0.5 * (1 + np.cos(np.pi * epoch / epochs)) + 1e-4
    share = weights[y]
    for pick in (pick for turn in turns for _, pick in turn):
        share[pick] /= len(pick)
    for i, (turn, apart, plan) in enumerate(zip(turns, long, plans, strict=True), 1):
        n = len(turn)
        net = [x.reshape(n, *shape) for x, shape in zip(np.split(p[:n], _ENDS[:-1], axis=1), SHAPES, strict=True)]
        g = np.zeros((n, p.shape[1]), p.dtype) if plan is None else np.hstack([x.reshape(n, -1) for x in _short_gradients(net, plan, y[plan.of], share[plan.of])]).astype(p.dtype)
        for k, pick in apart:
            g[k] = np.concatenate([x.ravel() for x in _long_gradients(Network([x[k] for x in net]), [rows[r] for r in pick], y[pick], share[pick])])
        m1[:n] += 0.1 * (g - m1[:n])
        m2[:n] += 0.001 * (g * g - m2[:n])
        p[:n] -= np.float32(rate / (1 - 0.9 ** (steps + i))) * m1[:n] / (np.sqrt(m2[:n] / np.float32(1 - 0.999 ** (steps + i))) + np.float32(1e-8))
    for k in np.argsort(order):
        yield np.stack([p[k], m1[k], m2[k]]).astype(float), steps + len(picks[k])


def _batch_gradients(net: Network, rows: Sequence[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Gradients of the weighted loss of a batch."""
    if not _short(np.array([len(r[0]) for r in rows])):
        return _long_gradients(net, rows, y, weight)
    plan = next(_plans(rows, [[(0, np.arange(len(rows)))]], 1))
    return [g[0] for g in _short_gradients([w[None] for w in net.weights], plan, y[plan.of], weight[plan.of])]


def _long_gradients(net: Network, rows: Sequence[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Gradients of a batch whose rows are long, which is gone through twice, in chunks of bounded size."""
    most, total = np.zeros((2, len(rows), FILTERS), net.weights[2].dtype)
    count = np.zeros(len(rows), most.dtype)
    for of, places in chunks(rows):
        f = net.forward(*places)
        np.maximum.at(most, of, f["max"])
        np.add.at(total, of, f["sum"])
        np.add.at(count, of, f["n"].astype(most.dtype))
    mean = total / np.maximum(1, count)[:, None]
    d, v = _slopes(net.logits(most, mean), y, weight), net.weights[4]
    sums = [np.zeros_like(w) for w in net.weights[:4]]
    missing = np.ones(most.shape, bool)  # the largest activation is of one piece
    for of, (ids, tags, lengths) in chunks(rows):  # as before, so that the largest activations are met again
        f = net.forward(ids, tags, lengths)
        own = np.zeros(f["max"].shape, bool)
        for j, i in enumerate(of):
            own[j] = missing[i] & (f["max"][j] == most[i])
            missing[i] &= ~own[j]
        part = _back(net, f, d[of, None] * v[:FILTERS] * own, d[of, None] * v[FILTERS:] / count[of, None])
        sums = [a + b for a, b in zip(sums, part, strict=True)]
    return [*sums, np.hstack([most, mean]).T @ d, np.array([d.sum()])]


def _slopes(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The weighted loss's gradient by the logits."""
    return ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight).astype(z.dtype)


@dataclass
class Plan:
    """Where the windows and characters of batches lie, of one for each network that is trained, which go through numpy as one.

    Rows are dealt to pieces of equally many windows, every n-th window to one of a row's n pieces; windows beyond the
    row's last one see no character. The rows' first pieces stand first, then the second ones of those that have one, and so on.
    """

    alphabet: np.ndarray  # character by tag, of these rows and of others; a network's last one is none
    of: np.ndarray  # the rows, in falling order of length
    nets: np.ndarray  # networks of the rows
    seen: np.ndarray  # (place in the kernel, window of a piece, piece): the character that is seen there, counted through the networks
    rows: np.ndarray  # of the pieces
    ranks: list[int]  # how many rows have a first piece, a second one, ...
    counts: np.ndarray  # windows of the rows
    chars: np.ndarray | None = None  # characters, once for each SPAN places they stand at
    cuts: list[int] | None = None  # where each network's chars end
    windows: np.ndarray | None = None  # (SPAN, those characters by places in the kernel from the last): windows that see them there, a number beyond all windows for none


def _short(lengths: np.ndarray) -> bool:
    return lengths.max() <= PIECE and lengths.max() * len(lengths) <= PLACES


def _plans(rows: Sequence[tuple[np.ndarray, np.ndarray]], turns: list[list[tuple[int, np.ndarray]]], nets: int, back: bool = True) -> Iterator[Plan | None]:
    """The plan of each turn's batches, (network, rows), worked out for AHEAD places at a time; None for none. Without the way back it has no chars, cuts and windows."""
    rows = Rows.of(rows)
    if rows.sizes.min(initial=KERNEL) < KERNEL:
        rows = Rows.of([r if len(r[0]) >= KERNEL else tuple(np.pad(x, (0, KERNEL - len(x))) for x in r) for r in rows])
    size = rows.sizes
    codes = rows.ids * np.intp(TAGS) + rows.tags
    used = np.bincount(codes, minlength=CODES) > 0
    alphabet, codes = np.flatnonzero(used), (np.cumsum(used) - 1).take(codes)
    start, held, places = np.cumsum(size) - size, [], 0
    for k, turn in enumerate(turns):
        held.append(turn)
        places += sum(size[pick].sum() for _, pick in turn)
        if places >= AHEAD or (len(held) + 1) * nets * (len(alphabet) + 1) > 1 << 16 or k + 1 == len(turns):
            planned = iter(_planned(alphabet, codes, start, size, [x for x in held if x], nets, back) if any(held) else [])
            yield from [next(planned) if x else None for x in held]
            held, places = [], 0


def _planned(alphabet: np.ndarray, codes: np.ndarray, start: np.ndarray, size: np.ndarray, turns: list[list[tuple[int, np.ndarray]]], nets: int, back: bool) -> list[Plan]:
    none = len(alphabet)  # no character
    of = np.concatenate([pick for turn in turns for _, pick in turn])
    sizes = [len(pick) for turn in turns for _, pick in turn]
    turn = np.repeat(np.repeat(np.arange(len(turns)), [len(x) for x in turns]), sizes)  # of the rows
    net = np.repeat([k for x in turns for k, _ in x], sizes)
    by = np.lexsort((-size[of], turn))
    of, net = of[by], net[by]
    start, size = start[of], size[of]
    begin, far = np.cumsum(size) - size, int(size.sum())
    codes = codes[np.repeat(start - begin, size) + np.arange(far)]
    if nets > 1:
        codes += np.repeat(net * (none + 1), size)
    codes = np.append(codes, np.full(KERNEL, none))
    counts = size - KERNEL + 1
    width = min(range(8, 33), key=lambda n: (-(-counts // n)).sum() * (n + 1))
    pieces = -(-counts // width)
    rows = np.repeat(np.arange(len(of)), pieces)
    rank = np.arange(len(rows)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    by = np.lexsort((rank, turn[rows]))
    rows, rank = rows[by], rank[by]
    place = np.arange(width)[:, None]
    at = place * pieces[rows] + rank
    at = np.where(at < counts[rows], begin[rows] + at, far)
    seen = codes.take(at + np.arange(KERNEL)[:, None, None])

    ends = np.cumsum(np.bincount(turn[rows]))  # of the turns' pieces
    first = np.append(0, ends[:-1])
    row = np.searchsorted(turn, np.arange(len(turns) + 1)).tolist()
    out = []
    for a, b, c, d in zip(first.tolist(), ends.tolist(), row[:-1], row[1:], strict=True):
        out.append(Plan(alphabet, of[c:d], net[c:d], seen[:, :, a:b], rows[a:b] - c, np.bincount(rank[a:b]).tolist(), counts[c:d]))
    if not back:
        return out
    window = np.full(far + 2 * KERNEL - 1, 1 << 40)  # that begins at a place
    window[at + KERNEL - 1] = place * (ends - first)[turn[rows]] + np.arange(len(rows)) - first[turn[rows]]
    window[far + KERNEL - 1 :] = 1 << 40
    key = np.repeat(turn * (nets * (none + 1)), size) + codes[:far]
    order = np.append(np.argsort(key.astype(np.uint16), kind="stable"), far + KERNEL - 1)
    key = key[order[:-1]]
    runs = np.flatnonzero(np.diff(key, prepend=-1))
    length = np.diff(runs, append=far)
    spans = -(-length // SPAN)
    inside = (np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)) * SPAN + np.arange(SPAN)[:, None]
    where = order[np.where(inside < np.repeat(length, spans), np.repeat(runs, spans) + inside, -1)]
    windows = sliding_window_view(window, KERNEL).take(where, axis=0)
    key = np.repeat(key[runs], spans)
    cuts = np.searchsorted(key, np.arange(len(turns) * nets + 1) * (none + 1)).tolist()
    for i, plan in enumerate(out):
        a, *ends = cuts[i * nets : (i + 1) * nets + 1]
        plan.chars, plan.cuts, plan.windows = key[a : ends[-1]] - i * nets * (none + 1), [x - a for x in ends], windows[:, a : ends[-1]].reshape(SPAN, -1)
    return out


def _tables(weights: list[np.ndarray], alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings of the alphabet and of no character for each network, and for each place in the kernel what they add to a window there."""
    e, g, w, b, _, _ = weights
    both = np.zeros((len(w), len(alphabet) + 1, DEPTH), w.dtype)
    np.add(e.take(alphabet // TAGS, axis=1), g.take(alphabet % TAGS, axis=1), out=both[:, :-1])
    both[:, :-1][:, alphabet < TAGS] = 0
    tables = np.matmul(both, w.reshape(-1, KERNEL, DEPTH, FILTERS).swapaxes(0, 1))
    tables[0] += b[:, None]
    tables[0, :, -1] = _FAR
    return both.reshape(-1, DEPTH), tables.reshape(KERNEL, -1, FILTERS)


def _activations(tables: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """(window of a piece, piece, filter): sums over the places in the kernel, if above 0."""
    z, other = np.empty((2, *seen.shape[1:], FILTERS), tables.dtype)
    tables[0].take(seen[0], axis=0, out=z, mode="clip")
    for table, codes in zip(tables[1:], seen[1:], strict=True):
        z += table.take(codes, axis=0, out=other, mode="clip")
    other.fill(0)
    return np.maximum(z, other, out=z)  # an array's maximum with an array is faster than with a number


def _pool(z: np.ndarray, ranks: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Largest and summed activations of the rows."""
    flat = z.reshape(len(z), -1)
    largest, sums = flat.max(0).reshape(z.shape[1:]), flat.sum(0).reshape(z.shape[1:])
    most, total, at = largest[: ranks[0]], sums[: ranks[0]], ranks[0]
    for n in ranks[1:]:
        np.maximum(most[:n], largest[at : at + n], out=most[:n])
        total[:n] += sums[at : at + n]
        at += n
    return most, total


def _short_gradients(weights: list[np.ndarray], plan: Plan, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Gradients of the six weights of each network for its planned batch.

    A window's value is the sum of its characters' entries in one table a place of the kernel, and gradients are added up
    by character, SPAN at a time, before they are multiplied: no window's inputs are written down.
    """
    w, v = weights[2], weights[4].take(plan.nets, axis=0)
    both, tables = _tables(weights, plan.alphabet)
    z = _activations(tables, plan.seen)
    most, mean = _pool(z, plan.ranks)
    count = plan.counts.astype(w.dtype)[:, None]
    mean /= count
    pooled = np.hstack([most, mean])
    d = _slopes(np.einsum("rf,rf->r", pooled, v) + weights[5].take(plan.nets), y, weight)
    to_all = d[:, None] * v
    dz = np.empty((z.size // FILTERS + 1, FILTERS), w.dtype)
    dz[-1] = 0
    np.multiply(z > 0, (to_all[:, FILTERS:] / count).take(plan.rows, axis=0), out=dz[:-1].reshape(z.shape))
    equal = z == np.where(most > 0, most, np.nan).take(plan.rows, axis=0)
    eights = np.flatnonzero(equal.reshape(-1).view(np.uint64) != 0)
    bits = np.flatnonzero(equal.reshape(-1, 8).take(eights, axis=0))
    hits = (eights.take(bits >> 3) * 8 + (bits & 7))[::-1]
    first = np.full(most.size, -1)  # of a row's equally large activations the first counts: it is written last
    first[(plan.rows[:, None] * FILTERS + np.arange(FILTERS)).ravel().take(hits % (z.size // len(z)))] = hits
    has = np.flatnonzero(first >= 0)
    dz.ravel()[first[has]] += to_all[:, :FILTERS].ravel()[has]

    sums, other = np.empty((2, plan.windows.shape[1], FILTERS), w.dtype)
    dz.take(plan.windows[0], axis=0, out=sums, mode="clip")
    for i in plan.windows[1:]:
        sums += dz.take(i, axis=0, out=other, mode="clip")
    sums = sums.reshape(-1, KERNEL * FILTERS)
    x, dx = both.take(plan.chars, axis=0), np.empty((len(sums), DEPTH), w.dtype)
    dw, db = np.empty((len(w), DEPTH, KERNEL, FILTERS), w.dtype), np.empty((len(w), FILTERS), w.dtype)
    to_x = w.reshape(-1, KERNEL, DEPTH, FILTERS)[:, ::-1].swapaxes(2, 3).reshape(-1, KERNEL * FILTERS, DEPTH)
    a = 0
    for k, b in enumerate(plan.cuts[: len(w)]):
        np.matmul(x[a:b].T, sums[a:b], out=dw[k].reshape(DEPTH, -1))
        np.matmul(sums[a:b], to_x[k], out=dx[a:b])
        np.matmul(np.ones(b - a, w.dtype), sums[a:b, -FILTERS:], out=db[k])  # each window begins at one character
        a = b
    place = (np.arange(len(w))[:, None] * CODES + np.append(plan.alphabet, 0)).ravel().take(plan.chars)
    by_char = np.bincount((place[:, None] * DEPTH + np.arange(DEPTH)).ravel(), dx.ravel(), len(w) * CODES * DEPTH).reshape(len(w), -1, TAGS, DEPTH)
    by_char[:, 0] = 0
    own = (plan.nets == np.arange(len(w))[:, None]) * d
    return [np.einsum("kegd->ked", by_char), by_char.sum(1), dw[:, :, ::-1].swapaxes(1, 2).reshape(w.shape), db, own @ pooled, own.sum(1)[:, None]]


def _gradients(net: Network, f: dict, d: np.ndarray, mean: np.ndarray, ids: np.ndarray, tags: np.ndarray) -> list[np.ndarray]:
    """Gradients of the six weights, for d the loss's gradient by the logits."""
    v = net.weights[4]
    each = d[:, None] * v[FILTERS:] / f["n"].astype(v.dtype)[:, None]
    return [*_back(net, f, d[:, None] * v[:FILTERS], each), np.hstack([f["max"], mean]).T @ d, np.array([d.sum()])]


def _back(net: Network, f: dict, to_top: np.ndarray, to_each: np.ndarray) -> list[np.ndarray]:
    """Gradients of embeddings and convolution, for those of each row's largest activations and of all its activations."""
    e, g, w = net.weights[:3]
    z, codes, size = f["z"], f["codes"], f["size"]
    dz = np.multiply(z > 0, to_each.T.repeat(size, axis=1), dtype=w.dtype)
    at = np.flatnonzero(z == np.where(f["max"] > 0, f["max"], np.nan).T.repeat(size, axis=1))
    of = at // len(codes) * len(size) + np.arange(len(size)).repeat(size)[at % len(codes)]
    first = np.diff(of, prepend=-1) != 0  # of a row's equally large activations the first counts
    dz.ravel()[at[first]] += to_top.T.ravel()[of[first]]
    dw = f["windows"] @ dz.T
    dwindows = w @ dz
    dx = dwindows[:DEPTH]
    for k in range(1, KERNEL):
        dx[:, k:] += dwindows[k * DEPTH : (k + 1) * DEPTH, : len(codes) - k]
    size = len(e) * len(g)
    both = np.bincount((codes + size * np.arange(DEPTH)[:, None]).ravel(), dx.ravel(), DEPTH * size).reshape(DEPTH, len(e), len(g))
    both[:, 0] = 0
    return [both.sum(2).T, both.sum(1).T, dw[:-2], dw[-2]]


def platt(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset of Platt's curve by Newton steps, for n rows of each logit and label."""
    n1, n0 = max(1, n[y == 1].sum()), max(1, n[y == 0].sum())
    goal = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + c, -40, 40)))
        h, off = n * np.maximum(p * (1 - p), 1e-9), n * (p - goal)
        grad = np.array([(off * z).sum() + 1e-3 * (a - 1), off.sum()])
        step = np.linalg.solve(np.array([[(h * z * z).sum() + 1e-3, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-9]]), grad)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        a, c = max(1e-3, a - step[0]), c - step[1]
    return float(a), float(c)


def calibrate(net: Network, rows: list, y: np.ndarray, keyed: np.ndarray, kinds: np.ndarray, recall: float) -> Network:
    """Platt's curve and thresholds from the held-out findings of each kind with 20 or more, of rows in this process."""
    z = net.raw(rows)
    net.slope, net.offset = platt(z, y, np.ones(len(z)))
    cuts = []
    for form in (False, True):
        mine = [np.sort(z[(y == 1) & (keyed == form) & (kinds == k)]) for k in np.unique(kinds)]
        cuts.append([x[int(np.floor((1 - recall) * len(x)))] for x in mine if len(x) >= 20])
    net.thresholds = net.cut(cuts[0]), net.cut(cuts[1])
    return net


#: Names that secrets go by beside those of the patterns, and names of ordinary values.
OTHER_NAMES = ("auth", "bearer", "credential", "passphrase", "private_key", "pwd", "signature", "access_key")
PLAIN_NAMES = ("author", "category", "city", "file", "language", "name", "subject", "title")
ALPHABETS = {
    "lower hex": "0123456789abcdef",
    "upper hex": "0123456789ABCDEF",
    "letters and digits": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/",
    "capitals and digits": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
}


def enlarged(found: list[dict], clean: list[dict], rng: np.random.Generator) -> list[tuple[str, str, str, int, bool, int]]:
    """(left, value, right, label, keyed, kind) of a shard's candidates, and of copies of them.

    Findings are respelled in other alphabets, renamed, and put bare into clean places, until there are VARIANTS of each
    at least; clean values stand in capitals and under plain names, and numbers and dotted numbers in their places.
    """
    pick = lambda xs: xs[rng.integers(len(xs))]
    draw = lambda xs, n: "".join([xs[k] for k in rng.integers(len(xs), size=n).tolist()])
    signs = [' = "', ": ", "=", ' : "', "='"]
    rows = [(x["left"], x["value"], x["right"], 1, x["keyed"], x["kind"]) for x in found] + [(x["left"], x["value"], x["right"], 0, x["keyed"], -1) for x in clean]

    def keyed(home: dict, name: str, value: str, label: int, kind: int):
        return (home["left"] + name + pick(signs))[-LEFT:], value, (pick(['"', "'", ""]) + home["right"])[:RIGHT], label, True, kind

    if not found or not clean:
        return rows
    for x in found * -(-VARIANTS // len(found)):
        value = x["value"]
        if len(value) >= 16 and any(c.isdigit() for c in value):
            chars = ALPHABETS[pick(sorted(ALPHABETS))]
            other = draw(chars, int(rng.integers(20, 65)))
            home = pick(clean)
            rows.append((home["left"], pick([value, other]), home["right"], 1, False, 10))
            rows.append(keyed(pick(clean), pick([*OTHER_NAMES, "token", "secret"]), other, 1, 11))
    for x in clean[: 2 * VARIANTS]:
        digits = draw("0123456789", int(rng.integers(12, 21)))
        dotted = ".".join(map(str, rng.integers(256, size=4).tolist()))
        plain = pick([x["value"].upper(), x["value"].title(), digits, digits, dotted, x["value"] + digits[:2]])
        rows.append((x["left"], plain, x["right"], 0, False, -1))
        rows.append(((x["left"].upper(), x["value"].upper(), x["right"].upper(), 0, x["keyed"], -1)))
        rows.append(keyed(pick(clean), pick(PLAIN_NAMES), x["value"], 0, -1))
    return rows


_EXAMPLES = "shard int, held boolean, y binary, keyed binary, kinds binary, lengths binary, ids binary, tags binary"


def _examples(t: pa.Table):
    """A shard's candidates and their copies, encoded: a row of those that teach, and one of those held out. By value, so that no value is in both."""
    shard = t.column("shard")[0].as_py()
    names = ["left", "value", "right", "kind", "keyed"]
    of = [dict(zip(names, x, strict=True)) for x in zip(*[t.column(c).to_numpy().tolist() for c in names], strict=True)]
    rows = enlarged([x for x in of if x["kind"] >= 0], [x for x in of if x["kind"] < 0], np.random.default_rng([SEED, shard]))
    held = np.array([hashlib.sha256(r[1].encode("utf-8", "surrogatepass")).digest()[3] % 4 == 0 for r in rows])
    for part in (False, True):
        mine = [r for r, h in zip(rows, held, strict=True) if h == part]
        coded = encode_all(*[[r[k] for r in mine] for k in range(3)])
        made = [np.array([r[i] for r in mine], np.uint8) for i in (3, 4)] + [np.array([r[5] for r in mine], "<i2"), coded.sizes.astype("<i4"), coded.ids, coded.tags]
        cols = [pa.array([shard], pa.int32()), pa.array([part]), *[pa.array([x.tobytes()], pa.binary()) for x in made]]
        yield pa.record_batch(cols, names=[c.split()[0] for c in _EXAMPLES.split(", ")])


def _decoded(batch: pa.RecordBatch):
    """(shard, encoded rows, y, keyed, kinds) of each row of examples."""
    kinds = {"y": np.uint8, "keyed": np.uint8, "kinds": "<i2", "lengths": "<i4", "ids": np.uint8, "tags": np.uint8}
    for i, shard in enumerate(batch.column("shard").to_pylist()):
        x = {c: np.frombuffer(batch.column(c)[i].as_buffer(), k) for c, k in kinds.items()}
        yield shard, Rows(x["ids"], x["tags"], x["lengths"].astype(int)), x["y"].astype(int), x["keyed"], x["kinds"]


def examples(looked: DataFrame) -> DataFrame | None:
    """All distinct findings and clean candidates with their copies, encoded, in shards; None with under LEAST findings or clean candidates.

    A candidate is clean if its text holds no finding. Equal windows count once. Where findings (or clean candidates) are so few
    that shards would lack them, each is dealt to several shards.
    """
    one = looked.select(F.size("spans").alias("n"), F.inline("cands")).where((F.col("kind") >= 0) | (F.col("n") == 0))
    window = ["left", "value", "right"]
    distinct = stash(one.groupBy(*window).agg(F.max("kind").alias("kind"), F.max("keyed").alias("keyed")), "secret-windows")
    found = F.col("kind") >= 0
    sizes = {r["found"]: r for r in distinct.groupBy(found.alias("found")).agg(F.count("*").alias("n"), F.sum(F.length("value") + LEFT + RIGHT).alias("places")).collect()}
    if any(k not in sizes or sizes[k]["n"] < LEAST for k in (False, True)):
        return None
    n, places = (sum(r[c] for r in sizes.values()) for c in ("n", "places"))
    shards = max(-(-n // SHARD), -(-places // (64 * SHARD)))
    times = [min(shards, max(1, -(-4 * LEAST * shards // sizes[k]["n"]))) for k in (False, True)]
    copy = F.explode(F.sequence(F.lit(0), F.when(found, times[1]).otherwise(times[0]) - 1))
    dealt = distinct.select("*", copy.alias("copy")).withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), *window) + F.col("copy"), F.lit(shards)).cast("int"))
    return stash(scan_groups(dealt, ["shard"], window, _examples, _EXAMPLES, min(shards, 2_000)), "secret-examples")


def _epoch(taught: DataFrame, state: np.ndarray, steps: float, weights: np.ndarray, epoch: int, epochs: int) -> tuple[np.ndarray, float]:
    """The mean of the states that the shards reach from the shared one; summed in whole numbers, a row for each value and task, so that it does not depend on the order."""
    shared = taught.sparkSession.sparkContext.broadcast((state, steps))

    def run(batches):
        sums = np.zeros((2, state.size + 2), np.int64)
        for b in batches:
            shards = (x[:3] for x in _decoded(b) if x[1])
            while some := list(islice(shards, IN_STEP)):
                for (_, rows, _), (to, made) in zip(some, shard_epochs(*shared.value, some, weights, epoch, epochs), strict=True):
                    values = len(rows) * np.append(np.append(to.ravel(), made), 1) * 2.0**20
                    whole = np.floor(values)
                    sums += np.stack([whole, np.rint((values - whole) * 2.0**40)]).astype(np.int64)
        yield pa.record_batch([pa.array(np.arange(sums.shape[1], dtype=np.int32)), *map(pa.array, sums)], names=["i", "whole", "rest"])

    sums = taught.mapInArrow(run, "i int, whole bigint, rest bigint").groupBy("i").agg(F.sum("whole").alias("whole"), F.sum("rest").alias("rest")).collect()
    values = np.empty(state.size + 2)
    for r in sums:
        values[r["i"]] = ((r["whole"] << 40) + r["rest"]) / 2**60
    shared.destroy()
    return (values[:-2] / values[-1]).reshape(state.shape), values[-2] / values[-1]


def fit(looked: DataFrame, recall: float = RECALL) -> Network | None:
    """The network of all distinct findings and clean candidates; None with under LEAST of either."""
    rows = examples(looked)
    if rows is None:
        return None
    taught, held = rows.where("not held"), rows.where("held")
    count = F.length("y")
    n, ones = taught.select(F.sum(count), F.sum(F.length(F.translate(F.hex("y"), "0", "")))).first()
    weights = np.array([0.5 * n / max(1, k) for k in (n - ones, ones)])
    state, steps = fresh_state()
    for epoch in range(EPOCHS):
        state, steps = _epoch(taught, state, steps, weights, epoch, EPOCHS)
    net = Network(_views(state[0]))
    shared = looked.sparkSession.sparkContext.broadcast(net)

    def scored(batches):
        for b in batches:
            for _, rows, y, keyed, kinds in _decoded(b):
                cols = [pa.array(shared.value.raw(rows), pa.float64()), pa.array(y, pa.int32()), pa.array(keyed.astype(bool)), pa.array(kinds, pa.int32())]
                yield pa.record_batch(cols, names=["z", "y", "keyed", "kind"])

    z = stash(held.mapInArrow(scored, "z double, y int, keyed boolean, kind int"), "secret-logits")
    bins = z.groupBy(F.round("z", 2).alias("bin"), "y").agg(F.count("*").alias("n"), F.sum(F.col("z").cast("decimal(28,18)")).cast("double").alias("sum")).orderBy("bin", "y").collect()
    m = np.array([r["n"] for r in bins], float)
    net.slope, net.offset = platt(np.array([r["sum"] for r in bins]) / m, np.array([r["y"] for r in bins]), m)
    form = ["keyed", "kind"]
    counts = z.where("y = 1").groupBy(*form, "z").agg(F.count("*").alias("c"))
    placed = running(counts, form, "z", [], F.col("c"), "before").join(counts.groupBy(*form).agg(F.sum("c").alias("n")).where("n >= 20"), form)
    place = F.floor(F.lit(1 - recall) * F.col("n"))
    least = placed.where((F.col("before") <= place) & (place < F.col("before") + F.col("c"))).groupBy("keyed").agg(F.min("z").alias("z")).collect()
    net.thresholds = tuple(net.cut([r["z"] for r in least if r["keyed"] == k]) for k in (False, True))
    return net


def scan(looked: DataFrame, net: Network | None) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, scores) of each text: all spans, and the probabilities of the added ones."""
    shared = looked.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        net = shared.value
        for b in batches:
            base: list[list[tuple]] = [[] for _ in range(b.num_rows)]
            for i, *span in zip(*[x.tolist() for x in _flat(b.column("spans"))], strict=True):
                base[i].append(tuple(span))
            added: list[list[tuple]] = [[] for _ in base]
            scores: list[list[float]] = [[] for _ in base]
            cands = b.column("cands")
            held = pa.table([pc.list_parent_indices(cands), *cands.flatten().flatten()], names=["row", *_CAND])
            held = held.filter(pc.less(held["kind"], 0))
            if net is not None and len(held):
                p = net.probabilities(encode_all(*[held[c].to_numpy().tolist() for c in ("left", "value", "right")]))
                for k in np.flatnonzero(p >= np.array(net.thresholds)[held["keyed"].to_numpy().astype(int)]):
                    i = held["row"][k].as_py()
                    added[i].append((held["start"][k].as_py(), 3, held["end"][k].as_py()))
                    scores[i].append(float(p[k]))
            digests = [hashlib.sha256(spell(x).encode()).hexdigest() for x in base]
            spans = [spell(sorted(x + y)) for x, y in zip(base, added, strict=True)]
            made = [b.column("id"), *[b.column(c) for c in ("n_assign", "n_access", "n_hex")], pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(scores, pa.list_(pa.float64()))]
            yield pa.record_batch(made, names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "scores"])

    kind = looked.schema["id"].dataType.simpleString()
    return looked.mapInArrow(run, f"id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, scores array<double>")


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All secrets of docs, by the patterns and by a network that is trained on what they find in docs."""
    looked = look(docs, id_col, text_col)
    return scan(looked, fit(looked))
