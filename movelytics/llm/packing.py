"""Best-fit packing into fixed-length sequences by a grouping genetic algorithm on islands.

Documents are tokenized (byte-level BPE, id 0 at the end); longer ones are cut so that only the first piece may be short,
and full pieces are sequences of their own. The short pieces are dealt to groups of bounded size, and each group is packed
by SIBLINGS islands that start from different populations of whole packings. Crossover injects well-filled bins of one
parent into the other, drops bins that hold duplicates and re-inserts displaced pieces by best fit; mutation empties a few bins
of a child. While a packing could still have fewer bins, a displaced piece may first take a smaller one's place in a bin that it
fills better. The best of parents and children live on for GENERATIONS, or until the bound is met after LEAST of them. Migration: an island's elite, its
best packing, travels to the next island of its group, joins the population there and takes part in further generations;
then the group's best packing wins. After each epoch the winners' bins that are nearly full settle, and the pieces of the
other bins are dealt to merged groups, where they meet others' leftovers; the last epoch packs what is left.

Nulls and empty texts: a null text is an empty document (id 0 alone). Rows with null or repeated ids are packed like any
other, every row once. Ties: of equally good packings the first island's wins; which pieces share a sequence may depend on
how the rows are stored. A very long text is cut into as many pieces as it needs. An empty table gives an empty result.
Other columns, whatever their names, are never read.
"""

from __future__ import annotations

import os
import string
import zlib
from bisect import bisect_left, insort
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scan_groups, stash

LENGTH = 2048
ISLAND = 4096
SIBLINGS = 2
ELITE = 0.995
POPULATION, GENERATIONS, LEAST = 6, 8, 2
MUTATED = 0.05
EPOCHS = 3
_CACHE = 400_000
_BATCH = 1 << 22
_encoders: dict[str, "Encoder"] = {}
#: What byte-level vocabularies write for each byte, and the end of the Latin letters, which are letters in every version of Unicode.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SPELT = {b: 256 + k for k, b in enumerate(sorted({*range(256)}.difference(_PRINTED)))}
_LATIN_END = "\u0250"


class _Memory(dict):
    """What a function gives for strings; the first _CACHE of them that are not long are remembered."""

    def __init__(self, of):
        super().__init__()
        self.of = of

    def __missing__(self, key: str) -> bytes:
        value = self.of(key)
        if len(self) < _CACHE and len(key) < 64:
            self[key] = value
        return value


class Encoder:
    """Byte-level BPE ids, as little-endian 32-bit numbers, of whole texts, by the tokenizer of a vocabulary file.

    The pre-tokenizer never joins a space that stands alone with what precedes it, so a text without double or final
    spaces is a sequence of space-delimited chunks, whose ids are remembered. Most chunks are words of Latin letters with
    ASCII punctuation behind, alone or as lines. The pre-tokenizer parts them just there, so the model alone is asked for such a
    word; anything else is encoded as a text.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.bpe = Tokenizer.from_file(vocabulary)
        self.bpe.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model, parts = self.bpe.model, self.bpe.pre_tokenizer
        self.parted = isinstance(self.model, models.BPE) and self.bpe.normalizer is None and isinstance(parts, pre_tokenizers.ByteLevel) and parts.use_regex and not parts.add_prefix_space
        self.number = [i.to_bytes(4, "little") for i in range(max(self.bpe.get_vocab().values()) + 1)]
        self.known, self.words, self.others = _Memory(self._chunk), _Memory(self._word), _Memory(lambda text: self._whole([text])[0])

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.bpe.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        """Ids of letters with or without a space before them, which the pre-tokenizer never parts."""
        spelt = word.replace(" ", "Ġ") if word.isascii() else word.encode().decode("latin-1").translate(_SPELT)
        return b"".join([self.number[t.id] for t in self.model.tokenize(spelt)])

    def _plain(self, line: str, before: str) -> bytes | None:
        """Ids of a word of Latin letters and the ASCII punctuation behind it; None if the line is anything else."""
        word = line.rstrip(string.punctuation)
        if not word.isalpha() or not word.isascii() and max(word) >= _LATIN_END:
            return None
        ids = self.words[before + word]
        return ids if len(word) == len(line) else ids + self.others[line[len(word) :]]

    def _chunk(self, chunk: str, before: str = " ") -> bytes:
        """Ids of a chunk with a space before it."""
        if self.parted:
            if "\n" not in chunk:
                ids = self._plain(chunk, before)
            else:
                lines = [self._plain(x, "" if k else before) for k, x in enumerate(chunk.split("\n"))]
                ids = None if None in lines else self.others["\n"].join(lines)
            if ids is not None:
                return ids
        return self._whole([before + chunk])[0]

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for text in texts:
            if "  " in text or text[-1:].isspace() or not text.isprintable() and any(c.isspace() and c not in " \n" for c in set(text)):
                out += self._whole([text])
            else:
                head, *chunks = text.split(" ")
                out.append(self._chunk(head, "") + b"".join(map(self.known.__getitem__, chunks)))
        return out


def encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def pieces_of(ids: bytes, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, crc32) of the pieces of one document's ids: all but the first are full."""
    n = len(ids) // 4
    cuts = [0, *range(n % length or length, n + 1, length)]
    return [(a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _batched(column: pa.Array):
    """(first row, texts) of runs of rows with some _BATCH characters together, so that a batch of long texts is never encoded at once."""
    held, size, first = [], 0, 0
    for i in range(len(column)):
        held.append(column[i].as_py() or "")
        size += len(held[-1])
        if size >= _BATCH:
            yield first, held
            held, size, first = [], 0, i + 1
    yield first, held


def pieces(docs: DataFrame, vocabulary: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): one row per piece."""

    def run(batches):
        enc = encoder(vocabulary)
        for b in batches:
            out, rows = [], []
            for first, texts in _batched(b.column(1)):
                for i, ids in enumerate(enc.encode(texts), first):
                    got = pieces_of(ids + b"\0\0\0\0", length)
                    rows += [i] * len(got)
                    out += [(k, *p) for k, p in enumerate(got)]
            cols = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([b.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["id", "piece", "start", "length", "ids_crc32"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(order: list[int], size: list[int], bins: list[list[int]], room: list[int]) -> None:
    """Put each piece into the open bin with the least room that holds it, or into a new one."""
    free = sorted((r, k) for k, r in enumerate(room) if r > 0)
    for i in order:
        at = bisect_left(free, (size[i], -1))
        if at < len(free):
            r, k = free.pop(at)
            bins[k].append(i)
        else:
            k, r = len(bins), LENGTH
            bins.append([i])
            room.append(r)
        room[k] = r - size[i]
        if room[k]:
            insort(free, (room[k], k))


def _fills(bins: list[list[int]], size: list[int]) -> list[int]:
    return [sum([size[i] for i in b]) for b in bins]


def _pack(order: list[int], size: list[int], keep: list[list[int]] = ()) -> list[list[int]]:
    bins = [list(b) for b in keep]
    best_fit(order, size, bins, [LENGTH - f for f in _fills(bins, size)])
    return bins


def _fitness(bins: list[list[int]], size: list[int]) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    return len(bins), -sum([f * f for f in _fills(bins, size)]) / LENGTH**2


def exchange(bins: list[list[int]], loose: list[int], size: list[int]) -> tuple[list[list[int]], list[int]]:
    """Bins made fuller by loose pieces: one or two pieces of a bin give way to a loose one, or to two, that fit their place better.

    Of all such swaps of a bin the one that leaves the least room is made. The pieces that gave way are loose then.
    """
    free = sorted((size[i], i) for i in loose)
    out = []
    for b in bins:
        room, best = LENGTH - sum([size[i] for i in b]), None
        places = [(room + sum([size[i] for i in old]), old) for old in [*combinations(b, 1), *combinations(b, 2)]] if room else []
        for place, old in places:  # the largest loose piece that has a place
            at = bisect_left(free, (place + 1, -1)) - 1
            if at >= 0 and (best is None or place - free[at][0] < best[0]):
                best = place - free[at][0], old, (at,)
                if best[0] == 0:
                    break
        for place, old in places:  # two loose pieces with the greatest sum that has a place
            if best is not None and best[0] == 0:
                break
            low, high = 0, bisect_left(free, (place - free[0][0] + 1, -1)) - 1 if free else -1
            while low < high:
                left = place - free[low][0] - free[high][0]
                if left >= 0 and (best is None or left < best[0]):
                    best = left, old, (low, high)
                    if left == 0:
                        break
                low, high = (low + 1, high) if left > 0 else (low, high - 1)
        if best is not None and best[0] < room:
            new = [free[k][1] for k in best[2]]
            for k in reversed(best[2]):
                free.pop(k)
            for i in best[1]:
                insort(free, (size[i], i))
            b = [i for i in b if i not in best[1]] + new
        out.append(b)
    return out, [i for _, i in free]


def _settle(bins: list[list[int]], loose: set[int], size: list[int], down: list[int], least: int) -> list[list[int]]:
    """Loose pieces back into bins by best fit, largest first; after exchanges if the packing has more than the least number of bins then."""
    packed = _pack([i for i in down if i in loose], size, bins)
    if len(packed) <= least:
        return packed
    better, left = exchange(bins, sorted(loose), size)
    better = _pack(sorted(left, key=lambda i: -size[i]), size, better)
    return min(packed, better, key=lambda p: _fitness(p, size))


def crossover(a: list[list[int]], b: list[list[int]], size: list[int], down: list[int], share: float, least: int = 0) -> list[list[int]]:
    """The best-filled bins of a, then the bins of b that hold none of their pieces; what is displaced goes back into bins."""
    fills = _fills(a, size)
    injected = [a[k] for k in sorted(range(len(a)), key=lambda k: -fills[k])[: int(len(a) * share)]]
    taken = {i for x in injected for i in x}
    whole = [x for x in b if taken.isdisjoint(x)]
    return _settle(injected + whole, set(down).difference(taken, *whole), size, down, least)


def mutate(bins: list[list[int]], size: list[int], down: list[int], rng: np.random.Generator, least: int = 0) -> list[list[int]]:
    """The emptiest bin and a few others at random are emptied; their pieces go back into bins."""
    fills = _fills(bins, size)
    gone = {min(range(len(bins)), key=lambda k: fills[k]), *rng.choice(len(bins), max(1, int(len(bins) * MUTATED))).tolist()}
    return _settle([b for k, b in enumerate(bins) if k not in gone], {i for k in gone for i in bins[k]}, size, down, least)


def evolve(size: list[int], seed: int, elites: list[list[list[int]]] = (), population: int = POPULATION, generations: int = GENERATIONS, least_generations: int = LEAST) -> list[list[int]]:
    """Pack one group: bins as lists of positions in size. elites: packings that join the population at the start.

    A generation breeds half as many children as the population has members, one of them mutated. least_generations are bred
    whatever the packings are worth; further ones only while a packing could still have fewer bins.
    """
    down = sorted(range(len(size)), key=lambda i: -size[i])
    least = -(-sum(size) // LENGTH)
    rng = np.random.default_rng(seed)
    people = [list(e) for e in elites] or [_pack(down, size)]
    while len(people) < population:  # the same rule on orders that are only nearly by size
        noise = rng.normal(1, 0.15, len(size))
        people.append(_pack(np.argsort(-np.array(size) * noise, kind="stable").tolist(), size))
    ranked = sorted(((_fitness(p, size), k, p) for k, p in enumerate(people)))
    born = len(ranked)
    for generation in range(generations):
        if generation >= least_generations and ranked[0][0][0] <= least:
            break
        goal = least if ranked[0][0][0] > least else len(size)  # exchanges only where they can still save a bin
        for child in range(max(2, population // 2)):
            i, j = rng.choice(population, 2, replace=False)
            made = crossover(ranked[i][2], ranked[j][2], size, down, rng.uniform(0.2, 0.7), goal)
            if child == 0:
                made = mutate(made, size, down, rng, goal)
            ranked.append((_fitness(made, size), born, made))
            born += 1
        ranked = sorted(ranked)[:population]
    return ranked[0][2]


_PACKING = "row bigint, length bigint, grp bigint, island int, bin bigint, offset bigint, done boolean, bins bigint, fill double"


def _island(migrants: bool):
    """Evolve one island; with migrants, from the elites that have arrived (column origin), else from new packings."""

    def run(t: pa.Table):
        group, island = t.column("grp")[0].as_py(), t.column("island")[0].as_py()
        elites = []
        if migrants:  # each packing comes with all pieces of the group, in order of their rows
            origin = t.column("origin").to_numpy()
            for o in np.unique(origin):
                own = t.filter(pa.array(origin == o))
                held: dict[int, list[int]] = {}
                for i, k in enumerate(own.column("bin").to_pylist()):
                    held.setdefault(k, []).append(i)
                elites.append(list(held.values()))
            t = own
        size = t.column("length").to_pylist()
        bins = evolve(size, (group * 31 + island * 7 + migrants) % (1 << 32), elites)
        bin_of, offset, done = np.empty(len(size), np.int64), np.empty(len(size), np.int64), np.empty(len(size), bool)
        for k, b in enumerate(bins):
            at = 0
            for i in b:
                bin_of[i], offset[i] = k, at
                at += size[i]
            done[b] = at >= ELITE * LENGTH
        n = len(size)
        fit = _fitness(bins, size)
        cols = [t.column("row").combine_chunks(), t.column("length").combine_chunks(), np.full(n, group), np.full(n, island, np.int32), bin_of, offset, done, np.full(n, fit[0]), np.full(n, fit[1])]
        yield pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=["row", "length", "grp", "island", "bin", "offset", "done", "bins", "fill"])

    return run


def pack(found: DataFrame) -> DataFrame:
    """found: pieces. Adds sequence_id and offset; sequences are gapless from offset 0 and at most LENGTH long.

    Only (row number, length) of the short pieces travels between islands.
    """
    rows = stash(found.withColumn("row", F.monotonically_increasing_id()), "pieces")
    left = rows.where(F.col("length") < LENGTH).select("row", "length")
    placed, base = [], 0
    siblings = F.sequence(F.lit(0), F.lit(SIBLINGS - 1))
    for epoch in range(EPOCHS):
        n = left.count()
        if not n:
            break
        last = epoch == EPOCHS - 1 or n <= ISLAND
        groups = -(-n // ISLAND)
        dealt = left.withColumn("grp", F.lit(base) + F.pmod(F.xxhash64(F.lit(epoch), "row"), F.lit(groups))).withColumn("island", F.explode(siblings))
        first = stash(scan_groups(dealt, ["grp", "island"], ["row"], _island(False), _PACKING), f"islands{epoch}")
        # Elites stay on their island and migrate to the next one.
        to = F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(SIBLINGS)).cast("int"))
        travel = first.select("row", "length", "grp", F.col("island").alias("origin"), "bin", F.explode(F.array_distinct(to)).alias("island"))
        second = stash(scan_groups(travel, ["grp", "island"], ["origin", "row"], _island(True), _PACKING), f"epoch{epoch}")
        best = second.groupBy("grp").agg(F.min(F.struct("bins", "fill", "island")).alias("b")).select("grp", F.col("b.island").alias("island"))
        won = stash(second.join(best, ["grp", "island"]).select("row", "length", (F.col("grp") * (2 * ISLAND * 2) + F.col("bin")).alias("sequence_id"), "offset", (F.col("done") | F.lit(last)).alias("done")), f"won{epoch}")
        placed.append(won.where("done").select("row", "sequence_id", "offset"))
        left, base = won.where("not done").select("row", "length"), base + groups
        if last:
            break
    full = rows.where(F.col("length") == LENGTH).select("row", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for p in placed:
        full = full.union(p)
    return rows.join(full, "row").drop("row")


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of all documents."""
    return pack(pieces(docs, vocabulary, LENGTH, id_col, text_col))
