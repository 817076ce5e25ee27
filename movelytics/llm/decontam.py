"""Benchmark decontamination with a distributed positional inverted index. DataFrame operations only.

The training texts are tokenized once, and the postings (term, document, position) of all terms that any benchmark item has
are stored; everything below reads that index. Each benchmark window names its SEEDS rarest terms, by their frequency in
the index. Intersection: a posting of an item's term at item position q and document position p lies on the diagonal p - q;
a window can only occur on a diagonal on which all of its seeds have postings. On diagonals that pass, the postings of all
words of the item are looked up, and a run of consecutive hits as long as a window is an occurrence, which makes the result
exact. Proximity: the rarest terms of an item within NEAR words of each other, in any order.

Words: A-Z lower-cased, runs of [0-9a-z] and of characters beyond ASCII. Nulls and empty texts: a null text has no words, in
documents and in items alike. A document's words are hit per row; rows that repeat an id and a text get equal results.
Ties: terms of one frequency are ranked by their text. Items with null or repeated ids are matched by their texts and listed
by their distinct non-null ids. A very long text is a list of postings like any other. An empty table, of documents or of
items, gives no match. Other columns, whatever their names, are never read; without_contaminated keeps them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, stash, text_key

WINDOW = 10
SEEDS = 3
#: Words on either side of an item's rarest term within which its next rarest ones must stand.
NEAR = 20
#: Bytes (written as JSON) of a table that may be broadcast; beyond it Spark joins by shuffling.
BROADCAST_BYTES = 32_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The posting that stands behind a document's last word; no word is empty.
_END = ""


def words(text: Column) -> Column:
    """Array of words; lower() is the A-Z rule on pure ASCII and cheaper than translate()."""
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), _GAP), "")


def _small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if all its values together are under BROADCAST_BYTES."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))).alias("n")).first()["n"]
    return F.broadcast(df) if (size or 0) <= BROADCAST_BYTES else df


@dataclass
class Index:
    """postings: (term, id, tk, pos) with one row of term _END a document; freq: (term, n); phrases: (item, words, item_ids)."""

    postings: DataFrame
    freq: DataFrame
    phrases: DataFrame


def index(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> Index:
    """Tokenize docs once and store the postings of the benchmark's terms."""
    # Items with one text are one phrase; the ids are kept beside it.
    named = items.select(F.col(item_col).cast("string").alias("item_id"), words(F.col(item_text)).alias("words"))
    phrases = stash(named.groupBy("words").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids")).withColumn("item", F.xxhash64("words", F.lit(1))), "phrases")
    vocabulary = stash(phrases.select(F.explode("words").alias("term")).distinct(), "vocabulary")
    wanted = vocabulary.union(vocabulary.sparkSession.range(1).select(F.lit(_END).alias("term")))
    src = docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("tk"), words(F.col(text_col)).alias("w"))
    tokens = src.select("id", "tk", F.posexplode(F.concat("w", F.array(F.lit(_END)))).alias("pos", "term"))
    postings = stash(tokens.join(_small(wanted), "term", "left_semi").select("term", "id", "tk", "pos"), "postings")
    freq = stash(postings.where(F.col("term") != _END).groupBy("term").agg(F.count("*").alias("n")), "frequencies")
    return Index(postings, freq, phrases)


def _ranked(terms: DataFrame, freq: DataFrame, keys: list[str], seeds: int) -> DataFrame:
    """terms with n and rank, the rarest first, at most `seeds` for each of keys."""
    known = terms.join(freq, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return known.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("n", "term"))).where(F.col("rank") <= seeds)


def _seeds(phrases: DataFrame, freq: DataFrame, window: int, seeds: int) -> DataFrame:
    """(item, s, q, term): the rarest distinct terms of every window that can occur, at their first place in it."""
    n = F.size("words")
    spans = phrases.where(n > 0).select("item", F.explode(F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)))).alias("s"), F.least(n, F.lit(window)).alias("size"))
    at = phrases.select("item", F.posexplode("words").alias("q", "term"))
    terms = spans.join(at, "item").where("q >= s and q < s + size").groupBy("item", "s", "term").agg(F.min("q").alias("q"))
    asked = stash(_ranked(terms, freq, ["item", "s"], seeds), "seeds")
    # A window whose rarest term is nowhere in the training data occurs nowhere.
    dead = asked.where("n = 0").select("item", "s").distinct()
    return asked.join(dead, ["item", "s"], "left_anti").select("item", "s", "q", "term")


def diagonals(ix: Index, window: int = WINDOW, seeds: int = SEEDS) -> DataFrame:
    """(id, tk, item, diag): document diagonals on which all seeds of some window of the item have postings."""
    asked = stash(_seeds(ix.phrases, ix.freq, window, seeds), "alive")
    # A window spans fewer than 64 positions, so its seeds are bits of one number.
    bit = F.expr("shiftleft(1L, cast(pmod(q, 64) as int))")
    needs = asked.groupBy("item", "s").agg(F.bit_or(bit).alias("need")).groupBy("item").agg(F.collect_set("need").alias("needs"))
    needs = stash(needs.withColumn("least", F.array_min(F.transform("needs", lambda x: F.bit_count(x)))), "needs")
    places = asked.select("item", "q", "term").distinct().join(needs.select("item", "least"), "item")
    hits = ix.postings.join(_small(places), "term").select("id", "tk", "item", (F.col("pos") - F.col("q")).alias("diag"), "least", bit.alias("bit"))
    on = hits.groupBy("id", "tk", "item", "diag").agg(F.bit_or("bit").alias("bits"), F.max("least").alias("least")).where(F.bit_count("bits") >= F.col("least"))
    full = on.join(_small(needs.select("item", "needs")), "item").where(F.exists("needs", lambda need: F.col("bits").bitwiseAND(need) == need))
    return full.select("id", "tk", "item", "diag")


def phrase_matches(ix: Index, window: int = WINDOW, seeds: int = SEEDS) -> DataFrame:
    """(id, tk, item_ids, start, end): exact occurrences, as maximal word ranges [start, end) of a document."""
    found = stash(diagonals(ix, window, seeds), "diagonals")
    # Postings of the documents found, and of them those that an item's words would have on its diagonal.
    held = _small(found.select("id", "tk").distinct()).toDF("__id", "__tk")
    near = ix.postings.where(F.col("term") != _END).join(held, F.col("id").eqNullSafe(F.col("__id")) & (F.col("tk") == F.col("__tk")), "left_semi")
    each = _small(ix.phrases.select("item", F.size("words").alias("size"), F.posexplode("words").alias("q", "term")))
    asked = found.join(each, "item").select(F.col("id").alias("__id"), F.col("tk").alias("__tk"), "item", "diag", "size", "q", F.col("term").alias("__term"))
    same = F.col("id").eqNullSafe(F.col("__id")) & (F.col("tk") == F.col("__tk")) & (F.col("pos") == F.col("diag") + F.col("q")) & (F.col("term") == F.col("__term"))
    agree = asked.join(near, same).groupBy("id", "tk", "item", "diag", "size").agg(F.sort_array(F.collect_set("q")).alias("qs"))
    # Consecutive positions differ from their ranks by a constant: runs of agreement.
    flat = agree.select("id", "tk", "item", "diag", "size", F.posexplode("qs").alias("i", "q"))
    runs = flat.groupBy("id", "tk", "item", "diag", "size", (F.col("q") - F.col("i")).alias("run")).agg(F.min("q").alias("lo"), F.max("q").alias("hi"))
    long = runs.where(F.col("hi") - F.col("lo") + 1 >= F.least("size", F.lit(window)))
    named = long.join(_small(ix.phrases.select("item", "item_ids")), "item")
    return named.select("id", "tk", "item_ids", (F.col("diag") + F.col("lo")).alias("start"), (F.col("diag") + F.col("hi") + 1).alias("end"))


def proximity_matches(ix: Index, within: int = NEAR, seeds: int = SEEDS) -> DataFrame:
    """(id, tk, item_ids, start): places of an item's rarest term that have its next rarest ones (of `seeds` in all) within `within` words, in any order.

    One pass over the sorted postings of a document and an item: a frame looks `within` words back and ahead.
    """
    terms = ix.phrases.select("item", F.explode(F.array_distinct("words")).alias("term"))
    asked = stash(_ranked(terms, ix.freq, ["item"], seeds), "rarest")
    dead = asked.where("n = 0").select("item").distinct()
    alive = asked.join(dead, "item", "left_anti")
    places = alive.join(alive.groupBy("item").agg(F.count("*").alias("need")), "item").select("item", "term", "rank", "need")
    hits = ix.postings.join(_small(places), "term").select("id", "tk", "item", "rank", "need", F.col("pos").cast("long").alias("pos"))
    # Documents that lack one of the terms go first, by bits that are merged before the shuffle.
    whole = hits.groupBy("id", "tk", "item").agg(F.bit_or(F.expr("shiftleft(1, rank)")).alias("bits"), F.max("need").alias("need")).where(F.bit_count("bits") == F.col("need"))
    cands = stash(whole.select(F.col("id").alias("__id"), F.col("tk").alias("__tk"), F.col("item").alias("__item")), "near-candidates")
    kept = hits.join(_small(cands), F.col("id").eqNullSafe(F.col("__id")) & (F.col("tk") == F.col("__tk")) & (F.col("item") == F.col("__item")), "left_semi")
    frame = Window.partitionBy("id", "tk", "item").orderBy("pos").rangeBetween(-within, within)
    about = [F.max((F.col("rank") == r).cast("int")).over(frame).alias(f"r{r}") for r in range(2, seeds + 1)]
    beside = kept.select("id", "tk", "item", "rank", "need", "pos", *about).where("rank = 1")
    full = beside.where(sum((F.coalesce(F.col(f"r{r}"), F.lit(0)) for r in range(2, seeds + 1)), F.lit(1)) == F.col("need"))
    return full.join(_small(ix.phrases.select("item", "item_ids")), "item").select("id", "tk", "item_ids", F.col("pos").cast("int").alias("start")).distinct()


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, seeds: int = SEEDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, n_near) per row; n_near counts items with a proximity match."""
    ix = index(docs, items, id_col, text_col, item_col, item_text)
    exact = hits_by_document(phrase_matches(ix, window, seeds)).toDF("__id", "__tk", "n_hit", "items")
    near = proximity_matches(ix, NEAR, seeds).groupBy("id", "tk").agg(F.size(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("n_near")).toDF("__id2", "__tk2", "n_near")
    base = ix.postings.where(F.col("term") == _END).select("id", "tk", F.col("pos").cast("long").alias("n_words"))
    both = base.join(exact, F.col("id").eqNullSafe(F.col("__id")) & (F.col("tk") == F.col("__tk")), "left").join(near, F.col("id").eqNullSafe(F.col("__id2")) & (F.col("tk") == F.col("__tk2")), "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return both.select(
        "id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ",").cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def hits_by_document(found: DataFrame) -> DataFrame:
    """(id, tk, n_hit, items): number of words inside occurrences, overlaps counted once, and the sorted item ids."""
    order = Window.partitionBy("id", "tk").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))
    cover = found.withColumn("fresh", fresh)
    return cover.groupBy("id", "tk").agg(F.sum("fresh").alias("n_hit"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("items"))


def without_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that hold an occurrence of any benchmark window, all columns kept."""
    i, k = free_name(docs, "__id"), free_name(docs, "__tk")
    bad = phrase_matches(index(docs, items, id_col, text_col), window).select(F.col("id").alias(i), F.col("tk").alias(k)).distinct()
    return docs.join(bad, docs[id_col].eqNullSafe(bad[i]) & (text_key(text_col) == bad[k]), "left_anti")


ORACLE_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select cast(item_id as varchar) as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bw as (select distinct item, least(len(w), 10) as size, array_to_string(w[s : s + 9], ' ') as win from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s from b where len(w) > 0)),
dw as (select doc_id, s, size, array_to_string(w[s : s + size - 1], ' ') as win
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as s from d, (select distinct size from bw) where len(w) >= size)),
hit as (select doc_id, s, dw.size, item from dw join bw on dw.win = bw.win and dw.size = bw.size),
cover as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + size)) as p from (select distinct doc_id, s, size from hit)) group by doc_id),
found as (select doc_id, count(distinct item) as n_items, array_to_string(list_sort(list(distinct item)), ',') as items from hit group by doc_id),
tok as (select doc_id, unnest(w) as term, generate_subscripts(w, 1) as pos from d),
freq as (select term, count(*) as n from tok group by term),
ranked as (select item, t.term, coalesce(n, 0) as n, row_number() over (partition by item order by coalesce(n, 0), t.term) as rank
  from (select distinct item, unnest(w) as term from b) t left join freq on t.term = freq.term),
seed as (select item, term, rank, count(*) over (partition by item) as need, min(n) over (partition by item) as least from ranked where rank <= 3),
place as (select doc_id, item, rank, need, pos from tok join seed on tok.term = seed.term where least > 0),
beside as (select item, doc_id, rank, need,
  1 + coalesce(max(cast(rank = 2 as int)) over f, 0) + coalesce(max(cast(rank = 3 as int)) over f, 0) as got
  from place window f as (partition by doc_id, item order by pos range between 20 preceding and 20 following)),
near as (select doc_id, count(distinct item) as n_near from beside where rank = 1 and got = need group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near, 0) as n_near
from d left join cover on d.doc_id = cover.doc_id left join found on d.doc_id = found.doc_id left join near on d.doc_id = near.doc_id
"""
