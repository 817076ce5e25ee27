"""WARC archives in Zstandard: a shared dictionary in the leading skippable frame, one frame per record.

write_archives deduplicates payloads (revisit records), writes `.warc.zst` files into a folder that all executors share,
and returns their manifest. read_archives reads such files with Spark's binaryFile source, loads the dictionary, walks
the frames by their block headers, decodes one record per frame and validates header syntax, lengths and digests; a
record that fails has `error` set instead of ending the job.

Each task writes to a temporary name and renames it to a name made of the partition number, so a repeated task leaves the
same files; verify_files holds the folder against the manifest. Nulls and empty texts: a null html is an empty payload, a
null url is written as urn:x-none, a null id as an empty one (read back as null). Ties: of equal payloads of at least
MIN_BYTES the row with the largest id is the response; rows that repeat that id stay responses, and if all ids of a group
are null so do all its rows. Repeated rows give a record each; record ids are made of page ids, so they are unique only
where page ids are. A very long page is one record of one frame, held in memory once. An empty table gives an empty folder
and no records. Other columns, whatever their names, are never read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import share_of_hash, shared_dir, stash

MIN_BYTES = 1000
FILE_BYTES = 8 << 20
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 32_768, 65_536
# Fixed values of the formats.
DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2026-01-01T00:00:00Z"


def train_dictionary(pages: DataFrame, payload: str = "html") -> bytes:
    """Dictionary from some SAMPLE_PAGES payloads, chosen by a hash of the payload, SAMPLE_BYTES of each; empty if there is too little to train on."""
    large = pages.where(F.length(payload) > 0)
    n = large.count()
    drawn = large.where(share_of_hash(min(1.0, SAMPLE_PAGES / max(1, n)), F.lit("dictionary"), payload))
    rows = drawn.select(F.substring(payload, 1, SAMPLE_BYTES).alias("t")).distinct().orderBy(F.xxhash64("t"), "t").limit(2 * SAMPLE_PAGES).collect()
    samples = [r["t"].encode("utf-8", "surrogatepass") for r in rows]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 10 + 256), samples).as_bytes() if len(samples) >= 8 else b""
    except zstandard.ZstdError:
        return b""


def plan(pages: DataFrame, id_col: str = "page_id", payload: str = "html", url: str = "url", min_bytes: int = MIN_BYTES) -> DataFrame:
    """(id, url, body, digest, record_type, refers_to) per row."""
    src = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("body"))
    src = src.withColumn("digest", F.sha1(F.col("body").cast("binary")))
    columns = ["id", "url", "body", "digest"]
    size = F.octet_length("body")
    large, small = src.where(size >= min_bytes), src.where(size < min_bytes)
    keep = large.groupBy("digest").agg(F.max("id").alias("keep"))
    again = F.coalesce(F.col("keep").isNotNull() & ~F.col("id").eqNullSafe(F.col("keep")), F.lit(False))
    twice = large.join(keep, "digest").select(*columns, F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("keep")).alias("refers_to"))
    # Small payloads are never revisits and stay where they are.
    return twice.union(small.select(*columns, F.lit("response"), F.lit(None).cast(src.schema["id"].dataType)))


def record(key, url: str | None, body: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit carries the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + body
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:x-page:{'' if key is None else quote(str(key))}>",
        f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~') if url else 'urn:x-none'}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if kind == "revisit":
        head[2:2] = [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:x-page:{quote(str(refers_to))}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, path: str | None = None, id_col: str = "page_id", payload: str = "html", url: str = "url", min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> tuple[str, DataFrame]:
    """Write all rows; returns the folder and its manifest (file, records, bytes)."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    where, root = _open(path)
    where.create_dir(root, recursive=True)  # also where there is no row to write
    dictionary = spark.sparkContext.broadcast(train_dictionary(pages, payload))

    def run(batches):
        fs, root = _open(path)
        fs.create_dir(root, recursive=True)
        c = TaskContext.get()
        raw = dictionary.value
        pack = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None, write_checksum=True)
        out, size, count, files, names = None, 0, 0, 0, []

        def close():
            out.close()
            fs.move(temp, final)
            names.append((final.rpartition("/")[2], count, size))

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if out is None:
                    final = f"{root}/{c.partitionId():05d}-{files:05d}.warc.zst"
                    temp = f"{final}.{c.taskAttemptId()}.tmp"
                    out, size, count, files = fs.open_output_stream(temp), 0, 0, files + 1
                    lead = DICTIONARY_MAGIC + len(raw).to_bytes(4, "little") + raw if raw else b""
                    out.write(lead)
                    size += len(lead)
                frame = pack.compress(record(row[0], row[1], row[2].encode("utf-8", "surrogatepass"), *row[3:]))
                out.write(frame)
                size, count = size + len(frame), count + 1
                if size >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.record_batch([pa.array([n[i] for n in names], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["file", "records", "bytes"])

    planned = plan(pages, id_col, payload, url, min_bytes).sortWithinPartitions("id", "digest")
    return path, stash(planned.mapInArrow(run, "file string, records bigint, bytes bigint"), "warc-manifest")


def verify_files(spark: SparkSession, path: str, manifest: DataFrame) -> None:
    """Raise if a file of the manifest is missing in the folder, has another size, or is there without being in the manifest."""
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"))
    wrong = there.join(manifest.select("file", F.col("bytes").alias("said")), "file", "full").where("bytes is null or said is null or bytes <> said").limit(5).collect()
    if wrong:
        raise RuntimeError(f"archive files differ from the manifest: {[r['file'] for r in wrong]}")


def _open(path: str):
    return pafs.FileSystem.from_uri(path if re.match(r"\w+:", path) else f"file://{path}" if path.startswith("/") else path)


def frame_end(buf: memoryview, at: int) -> int:
    """End of the Zstandard frame at `at`, from its block headers."""
    p = zstandard.get_frame_parameters(buf[at : at + 18])
    pos = at + zstandard.frame_header_size(buf[at : at + 18])
    last = False
    while not last:
        if pos + 3 > len(buf):
            raise ValueError("truncated frame")
        h = int.from_bytes(buf[pos : pos + 3], "little")
        last, kind, size = bool(h & 1), (h >> 1) & 3, h >> 3
        if kind == 3:
            raise ValueError("reserved block type")
        pos += 3 + (1 if kind == 1 else size)
    pos += 4 if p.has_checksum else 0
    if pos > len(buf):
        raise ValueError("truncated frame")
    return pos


def frames(content: bytes):
    """(offset, record bytes, None) of each frame, or (offset, None, error); the dictionary is loaded first."""
    buf, at, use = memoryview(content), 0, None
    while at < len(buf):
        magic = bytes(buf[at : at + 4])
        if len(magic) == 4 and magic[0] >> 4 == 5 and magic[1:] == DICTIONARY_MAGIC[1:]:
            size = int.from_bytes(buf[at + 4 : at + 8], "little")
            if at + 8 + size > len(buf):
                yield at, None, "truncated skippable frame"
                return
            if at == 0 and magic == DICTIONARY_MAGIC:
                raw = bytes(buf[8 : 8 + size])
                if raw[:4] == FRAME_MAGIC:  # the dictionary itself may be compressed
                    raw = zstandard.ZstdDecompressor().decompress(raw)
                use = zstandard.ZstdCompressionDict(raw)
            at += 8 + size
            continue
        try:
            end = frame_end(buf, at)
        except (ValueError, zstandard.ZstdError) as e:
            yield at, None, f"frame: {e}"
            return
        try:
            yield at, zstandard.ZstdDecompressor(dict_data=use).decompressobj().decompress(bytes(buf[at:end])), None
        except zstandard.ZstdError as e:
            yield at, None, f"frame: {e}"
        at = end


def parse(raw: bytes) -> dict:
    """Headers and payload of one record; ValueError where syntax, lengths or digest are wrong."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError("no WARC header")
    fields = {}
    for x in lines[1:]:
        name, colon, value = x.partition(":")
        if not colon:
            raise ValueError(f"header line {x[:40]!r}")
        fields[name.strip().lower()] = value.strip()
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in fields:
            raise ValueError(f"no {need}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("content-length")
    http, sep, payload = rest[:-4].partition(b"\r\n\r\n")
    said = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
    if not sep or not said:
        raise ValueError("HTTP header")
    size, kind = int(said[1]), fields["warc-type"]
    digest = base64.b32decode(fields.get("warc-payload-digest", "sha1:").partition(":")[2]).hex()
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError("payload length or digest")
    if kind == "revisit" and payload:
        raise ValueError("revisit with a payload")
    page = lambda name: (m := re.fullmatch(r"<urn:x-page:(.*)>", fields.get(name, ""))) and m[1] or None
    return {"id": page("warc-record-id"), "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": page("warc-refers-to"), "payload": payload if kind == "response" else None}


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """(id string, payload_bytes, payload_digest, record_type, refers_to string, payload, file, offset, error) per record."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("path", "content")
    kinds = {"id": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.string(), "payload": pa.binary(), "file": pa.string(), "offset": pa.int64(), "error": pa.string()}

    def flush(rows):
        return pa.record_batch([pa.array([r.get(k) for r in rows], t) for k, t in kinds.items()], names=list(kinds))

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                rows, name = [], b.column(0)[i].as_py()
                for at, raw, error in frames(b.column(1)[i].as_py()):
                    row = {"file": name, "offset": at, "error": error}
                    if raw is not None:
                        try:
                            row |= parse(raw)
                        except ValueError as e:
                            row["error"] = f"record: {e}"
                    if not with_payload:
                        row.pop("payload", None)
                    rows.append(row)
                    if len(rows) >= 500:
                        yield flush(rows)
                        rows = []
                if rows:
                    yield flush(rows)

    return files.mapInArrow(run, "id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, payload binary, file string, offset bigint, error string")


ORACLE_SQL = """
with p as (select page_id, strlen(coalesce(html, '')) as n, sha1(coalesce(html, '')) as d from pages),
k as (select d, max(page_id) as keep from p where n >= 1000 group by d)
select p.page_id, p.n as payload_bytes, p.d as payload_digest, case when k.keep is null or k.keep = p.page_id then 'response' else 'revisit' end as record_type,
  case when k.keep is null or k.keep = p.page_id then null else k.keep end as refers_to
from p left join k on p.d = k.d
"""
