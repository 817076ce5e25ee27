"""Shared helpers: table access, lineage cuts in the shared folder, sorted group scans."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark removes an execution's shuffle files when it ends, and not only when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all tasks run in this process.

    On a cluster an unset spark.checkpoint.dir is an error: executors would write to disks that no other machine reads.
    """
    jsc = spark.sparkContext._jsc.sc()
    where = spark.conf.get("spark.checkpoint.dir", None)
    if jsc.getCheckpointDir().isEmpty():
        if where is None:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            where = "file://" + tempfile.mkdtemp(prefix="movelytics-")
        spark.sparkContext.setCheckpointDir(where)
    return where or jsc.getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors, and Spark's cleaner removes it once unreferenced."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: a lineage cut that stays compressed and columnar."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.select("*").write.parquet(path)  # a plan made under the setting
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def share_of_hash(share: float, *of: str | Column) -> Column:
    """True for about `share` of the rows, by 62 bits of a hash: as fine as any table needs, so that a small share is never rounded to none."""
    return F.shiftrightunsigned(F.xxhash64(*of), 2) < F.lit(min(1 << 62, max(0, round(share * (1 << 62)))))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def text_key(text: str = "text") -> Column:
    """Tells apart rows that repeat an id with another text (null counts as its own text)."""
    return F.xxhash64(F.col(text).isNull(), F.col(text))


def _changes(col: pa.ChunkedArray) -> pa.Array:
    """True where a value differs from the one before (null equals null)."""
    arr = col.combine_chunks()
    a, b = arr[1:], arr[:-1]
    same = pc.fill_null(pc.equal(a, b), False)
    return pc.invert(pc.or_(same, pc.and_(pc.is_null(a), pc.is_null(b))))


def scan_groups(df: DataFrame, keys: list[str], order: list[str], fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, parts: int | None = None) -> DataFrame:
    """Hash-partition by keys, sort, and hand each group to fn as one Arrow table.

    With parts the first key is a number from 0, and its remainder is the partition: costly groups are spread evenly.

    Like applyInPandas, but many small groups share one Arrow batch, so the cost is by row and not by group.
    Callers bound the size of a group beforehand (blocks, islands).
    """

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            held.append(batch)
            t = pa.Table.from_batches(held)
            cuts = _cuts(t)
            for lo, hi in zip(cuts[:-2], cuts[1:-1], strict=True):
                yield from fn(t.slice(lo, hi - lo))
            held = t.slice(cuts[-2]).to_batches()
        if held:
            yield from fn(pa.Table.from_batches(held))

    def _cuts(t: pa.Table) -> list[int]:
        if t.num_rows == 1:
            return [0, 1]
        change = _changes(t.column(keys[0]))
        for k in keys[1:]:
            change = pc.or_(change, _changes(t.column(k)))
        return [0, *(i + 1 for i in pc.indices_nonzero(change).to_pylist()), t.num_rows]

    spread = df.repartition(*keys) if parts is None else df.repartitionById(parts, F.pmod(keys[0], F.lit(parts)).cast("int"))
    return spread.sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
