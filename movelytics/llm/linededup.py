"""Cross-site boilerplate removal: distinct-site spread of each line by mergeable HyperLogLog sketches.

A line's sketch of sites is built map-side per line hash and merged by the aggregation, so a line that stands in a third
of all documents costs a task one sketch. Lines whose estimate is clear of the threshold are decided by it; lines within
MARGIN of it get exact distinct counts. Of a boilerplate line one occurrence stays, the first in the document with the
smallest id, so no content leaves the corpus entirely.

Lines are what stands between line feeds, compared after trimming spaces (U+0020) and nothing else: a line that ends in a
tab or a carriage return is another line. Blank lines are never boilerplate. Nulls: a null site is no site; a null text has
no lines and stays null; rows with a null id lose their boilerplate lines like others, but never hold the occurrence that
stays unless no other row has the line. Ties and repeated rows: rows that repeat an id and text are treated alike; within
the document that keeps a line its first occurrence stays. A very long text costs time in proportion to its lines. An empty
table gives an empty result. Other columns, whatever their names, are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, stash, text_key

SITES = 5
MARGIN = 2.0
LG_K = 8


def _clean(line: Column) -> Column:
    return F.trim(line)


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """One row per non-blank line: id, tk, site, pos, and 128 bits of hash."""
    return (
        docs.select(F.col(id_col).alias("id"), text_key(text_col).alias("tk"), F.col(site_col).alias("site"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
        .withColumn("line", _clean(F.col("line")))
        .where("line <> ''")
        .select("id", "tk", "site", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"))
    )


def boilerplate(docs: DataFrame, sites: int = SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(h1, h2, owner): hashes of lines on at least `sites` distinct sites; owner is the smallest id that has the line."""
    lines = _lines(docs, id_col, text_col, site_col)
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg(F.col("site").cast("string"), F.lit(LG_K)).alias("sketch"), F.min("id").alias("owner"), F.count("*").alias("n"))
    # A line met fewer than `sites` times can't be on as many sites.
    spread = stash(spread.where(F.col("n") >= sites).select("h1", "h2", "owner", F.hll_sketch_estimate("sketch").alias("est")).where(F.col("est") >= sites / MARGIN), "line-spread")
    sure = spread.where(F.col("est") > sites * MARGIN)
    near = spread.where(F.col("est") <= sites * MARGIN)
    exact = lines.select("h1", "h2", "site").join(near.select("h1", "h2"), ["h1", "h2"], "left_semi").distinct().groupBy("h1", "h2").agg(F.count("site").alias("exact"))
    counted = near.join(exact.where(F.col("exact") >= sites), ["h1", "h2"])
    return sure.select("h1", "h2", "owner").union(counted.select("h1", "h2", "owner"))


def removals(docs: DataFrame, sites: int = SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(id, tk, gone): positions of the lines to remove, for rows that have any."""
    common = stash(boilerplate(docs, sites, id_col, text_col, site_col), "boilerplate")
    hits = _lines(docs, id_col, text_col, site_col).drop("site").join(common, ["h1", "h2"])
    # Within the owner the first occurrence stays.
    per = hits.groupBy("id", "tk", "h1", "h2").agg(F.min("pos").alias("first"), F.collect_set("pos").alias("all"), F.first("owner").alias("owner"))
    gone = per.select("id", "tk", F.when(F.col("id").eqNullSafe(F.col("owner")), F.array_remove("all", F.col("first"))).otherwise(F.col("all")).alias("gone"))
    return gone.groupBy("id", "tk").agg(F.flatten(F.collect_list("gone")).alias("gone")).where(F.size("gone") > 0)


def _kept(text: Column, gone: Column) -> Column:
    """text without the lines at positions gone (a set difference of positions: one step a line, however many go)."""
    left = lambda parts: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), gone), lambda i: F.get(parts, i)), "\n")
    return F.when(gone.isNull(), text).otherwise(F.get(F.transform(F.array(F.split(text, "\n")), left), F.lit(0)))


def without_boilerplate(docs: DataFrame, sites: int = SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """docs with boilerplate lines cut out of their texts; every row and column stays, also a row left without lines.

    A column n_chars, if there is one, is set to the new length.
    """
    i, k, g = (free_name(docs, x) for x in ("__id", "__tk", "__gone"))
    gone = removals(docs, sites, id_col, text_col, site_col).toDF(i, k, g)
    both = docs.join(gone, docs[id_col].eqNullSafe(gone[i]) & (text_key(text_col) == gone[k]), "left")
    out = both.withColumn(text_col, _kept(F.col(text_col), F.col(g)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(g).isNull(), F.col("n_chars")).otherwise(F.length(text_col)).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def report(docs: DataFrame, sites: int = SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """(id, n_lines, n_removed, kept_sha256) per row; n_lines counts non-blank lines, a null text is hashed as empty."""
    gone = removals(docs, sites, id_col, text_col, site_col).toDF("__id", "__tk", "__gone")
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    both = src.join(gone, src["id"].eqNullSafe(F.col("__id")) & (text_key("text") == F.col("__tk")), "left")
    filled = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: _clean(x) != ""))
    return both.select(
        "id",
        filled.cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(F.coalesce(_kept(F.col("text"), F.col("__gone")), F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


ORACLE_SQL = """
with lines as (
  select doc_id, source, pos, trim(line, ' ') as line from (
    select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents)
), common as (
  select line, min(doc_id) as owner from lines where line <> '' group by line having count(distinct source) >= 5
), marked as (
  select l.*, c.line is not null and not (l.doc_id = c.owner and l.pos = min(l.pos) over (partition by l.doc_id, l.line)) as gone
  from lines l left join common c on l.line = c.line
), raw as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from documents
)
select r.doc_id, count(*) filter (m.line <> '') as n_lines, count(*) filter (m.gone) as n_removed,
  sha256(coalesce(string_agg(r.line, chr(10) order by r.pos) filter (not m.gone), '')) as kept_sha256
from raw r join marked m on r.doc_id = m.doc_id and r.pos = m.pos group by r.doc_id
"""
