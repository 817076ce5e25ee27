"""The registered queries of this subpackage, one per operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, codes, decontam, linededup, merkle, packing, quality, secretscan, simhash, substring, toxicity, warc, whitening
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles; classes over links of at most three bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _fold(n: int, held: int):
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(n)) == held, F.lit(False))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels of rows with crc32(doc_id) mod 3 = 1 are held out. A null id is in no held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    lex = toxicity.fit(docs, labels, ~_fold(3, 1))
    return toxicity.scores(docs, lex).withColumnRenamed("id", "doc_id").select("doc_id", _fold(3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels of rows with crc32(doc_id) mod 4 = 2 are held out. A null id is in no held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels, ~_fold(4, 2))
    return quality.scores(docs, model).withColumnRenamed("id", "doc_id").select("doc_id", _fold(4, 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines on five sites or more go, but for one occurrence: counts and the digest of what is left."""
    return linededup.report(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle trees of each text and its edited text, and their likeness; the next document by doc_id follows the last one round."""
    return merkle.compare_next(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 50 words that a document with a smaller doc_id holds: counts and the digest of what is left."""
    return substring.report(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op7_packing(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """One row per piece. vocabulary: place of byte_bpe_50k.json."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary).withColumnRenamed("id", "doc_id")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact occurrences of ten-word windows of benchmark items, and the number of items with a proximity match."""
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of all conversations, written as transcripts. Conversations with crc32(conv_id) mod 3 = 1 are held out of the fit and written in other styles."""
    turns = table(spark, sf_dir, "conversations")
    held = F.coalesce(F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    seen, unseen = chat.transcripts(turns.where(~held)), chat.transcripts(turns.where(held), styles=chat.UNSEEN)
    return chat.parse(seen.union(unseen), chat.fit(seen)).withColumnRenamed("conv", "conv_id").withColumn("held_out", held)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives and read back; files are held against the manifest, records against their headers."""
    pages = table(spark, sf_dir, "pages")
    path, manifest = warc.write_archives(pages)
    warc.verify_files(spark, path, manifest)
    kind = pages.schema["page_id"].dataType
    found = warc.read_archives(spark, path)
    sound = F.when(F.col("error").isNull(), F.col("record_type")).otherwise(F.raise_error(F.col("error")))
    return found.select(F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", sound.alias("record_type"), F.col("refers_to").cast(kind).alias("refers_to"))


COMPONENTS = 4


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of each embedding, fitted on the distinct whole-number vectors. A deviation beyond a long raises."""
    vectors = table(spark, sf_dir, "embeddings")
    found = whitening.whiten(vectors, whitening.fit(vectors, COMPONENTS))
    parts = found.select(F.col("id").alias("vec_id"), "n", F.col("deviation").cast("long").alias("deviation"), "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "of"))
    return parts.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", F.col("of.whitened").alias("whitened"), F.col("of.explained").alias("explained"), "identity_error")


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of each embedding: 16 parts, 64 entries, two rounds."""
    return codes.codes(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id").select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of each text: the patterns' spans and those that the network adds."""
    return secretscan.secrets(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("scores")


QUERIES = {f.__name__: f for f in (op1_simhash, op2_toxicity, op3_quality, op4_linededup, op5_merkle, op6_substring, op7_packing, op8_decontamination, op9_chat, op10_warc, op11_whitening, op12_codes, op13_secrets)}
ORACLES: dict[str, str] = {"op4_linededup": linededup.ORACLE_SQL, "op8_decontamination": decontam.ORACLE_SQL, "op10_warc": warc.ORACLE_SQL}
