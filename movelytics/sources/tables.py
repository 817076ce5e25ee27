"""Scans and derived views.

The driver's tables hold no movements, so `movements` derives them from `events` with integer arithmetic that any SQL
engine evaluates alike; MOVEMENTS_SQL is the one text for both ({US}: the event time in microseconds, {events}: the table).
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOVEMENTS_SQL = """
select event_id as mvt_id,
 case when event_type in ('click','view','signup') then 'DEP' else 'ARR' end as phase,
 concat('A', cast(user_id % 5 as varchar(9))) as airport,
 case when event_id % 7 = 0 then null when event_id % 7 = 1 then '?'
      else concat('0', cast(event_id % 3 as varchar(9))) end as runway,
 concat('S', cast(event_id % 8 as varchar(9))) as stand,
 concat('AB', cast(user_id as varchar(9))) as flight,
 concat('A', cast((user_id*3+1) % 5 as varchar(9))) as dest,
 concat('T', cast(user_id % 4 as varchar(9))) as ac_type,
 case when event_id % 10 = 0 then null else event_id - event_id % 2 end as flight_id,
 t_us,
 case when event_id % 11 = 0 then null when event_id % 97 = 1 then t_us + 60000000
      when event_id % 89 = 2 then t_us else t_us - cents*200000 end as aobt_us,
 case when event_id % 22 = 0 then null
      else t_us - cents*200000 + ((event_id % 9) - 4)*300000000 end as lobt_us,
 t_us - ((event_id*37) % 9000 - 1800)*1000000 as sched_us,
 case when event_type in ('click','view','signup') then null else t_us + cents*100000 end as block_us,
 case when event_type in ('click','view','signup')
      then cast(cents*2 + ((event_id % 13) - 6)*150 as double)/10
      else cast(cents as double)/10 end as taxi_sec
from (select event_id, user_id, event_type, cents,
        case when event_id % 5 = 0 then us - us % 600000000 else us end as t_us
      from (select event_id, user_id, event_type,
              cast(round(value*100) as bigint) as cents, {US} as us from {events}) a) b
"""

WEATHER_SQL = """
select event_id as obs_id, concat('A', cast(user_id % 5 as varchar(9))) as airport, us as t_us,
 value - 20 as temperature, value - 25 as dew, value as rh, value / 10 as wind_speed, (event_id * 53) % 400 as wind_dir,
 value / 5 as gust, value / 100 as precip, event_id % 50 as snow_depth, value / 8 as visibility, value * 40 as ceiling,
 case event_id % 9 when 0 then 'SN' when 1 then '-FZRA' when 2 then 'fg' when 3 then 'BR' when 4 then 'DZ' else null end as code
from (select event_id, user_id, value, {US} as us from {events}) a
"""

SPARK_US = "unix_micros(cast(ts as timestamp))"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MOVEMENTS_SQL.replace("{US}", SPARK_US), events=table(spark, sf_dir, "events"))


def weather_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(WEATHER_SQL.replace("{US}", SPARK_US), events=table(spark, sf_dir, "events"))


def shared(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; without one, on this machine if all tasks run here, else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="movelytics-")
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def scan(spark: SparkSession, paths: list[str], required: list[str]) -> DataFrame:
    """Multi-file Parquet scan; raises before any job if a required column is missing."""
    df = spark.read.parquet(*paths)
    if missing := sorted(set(required) - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")
    return df.select(*required)


def month_files(spark: SparkSession, folder: str, expected: int = 12, pattern: str = r"_(\d{4}-\d{2})(-\d{2})?\.parquet$") -> DataFrame:
    """Rows of the canonical month files of a folder; copies like 'x (1).parquet' are ignored, another count is an error."""
    df = spark.read.option("pathGlobFilter", "*.parquet").parquet(folder).where(F.col("_metadata.file_name").rlike(pattern) & ~F.col("_metadata.file_name").contains("("))
    n = df.select(F.col("_metadata.file_name").alias("f")).distinct().count()
    if n != expected:
        raise ValueError(f"{n} month files instead of {expected}")
    return df


def write_periods(df: DataFrame, folder: str, period: str) -> None:
    """Every period that the table holds in one write: a folder for each, of as many files as it needs."""
    df.write.partitionBy(period).parquet(folder)


def period_files(spark: SparkSession, folder: str, schema: str, period: str, expected: int, pattern: str = r"^\d{4}-\d{2}-\d{2}$") -> DataFrame:
    """Rows of the canonical period folders; copies like 'x (1)' are pruned before the scan, another count of periods is an error."""
    df = spark.read.schema(f"{schema}, {period} string").parquet(folder).where(F.col(period).rlike(pattern))
    n = df.agg(F.countDistinct(period)).first()[0]
    if n != expected:
        raise ValueError(f"{n} periods instead of {expected}")
    return df


def refuse_labels(df: DataFrame, labels: tuple[str, ...], allowed: list[str] | None = None) -> DataFrame:
    """df unless it has a label-derived column, or columns other than the allow-list (order counts)."""
    bad = [c for c in df.columns if any(x in c.lower() for x in labels)]
    if bad or (allowed is not None and df.columns != allowed):
        raise ValueError(f"label columns {bad}" if bad else "columns differ from the allow-list")
    return df


def read_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV dimension with a header, every column a string."""
    return spark.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in columns))


def cached(df: DataFrame, path: str, key: str) -> DataFrame:
    """Write a feature table, reload it, and check by key that both hold the same ids."""
    df.write.mode("errorifexists").parquet(path)
    back = df.sparkSession.read.parquet(path)
    if back.schema.names != df.schema.names or back.groupBy(key).count().where("count > 1").limit(1).count() or back.count() != df.count():
        raise ValueError("reloaded features don't match")
    return back


def publish(df: DataFrame, template: DataFrame, key: str, value: str, path: str) -> DataFrame:
    """Checked publishing in the template's order: every template id, values finite and at least 0, no overwrite, read back equal."""
    numbered = template.select(key, "pos")
    out = numbered.join(df.select(key, value), key, "left").orderBy("pos").select(key, value)
    bad = out.agg(F.count_if(F.col(value).isNull() | F.isnan(value) | (F.col(value) < 0)).alias("n")).first()["n"]
    if bad:
        raise ValueError(f"{bad} values are missing, not finite or negative")
    out.write.mode("errorifexists").parquet(path)
    back = df.sparkSession.read.parquet(path)
    if back.exceptAll(out).limit(1).count() or out.exceptAll(back).limit(1).count():
        raise ValueError("read-back differs")
    return back


#: Columns of a station-year file: time, ten measures, three present-weather codes.
OBSERVATION = ("t_us", "temperature", "dew", "rh", "wind_speed", "wind_dir", "gust", "precip", "snow_depth", "visibility", "ceiling", "mw", "au", "aw")


def write_station_years(obs: DataFrame, folder: str) -> None:
    """Observations with a station and t_us: a folder for each station and year, in one write."""
    year = F.year(F.timestamp_micros("t_us"))
    obs.withColumn("year", year).select("station", "year", *OBSERVATION).write.partitionBy("station", "year").parquet(folder)


def station_years(spark: SparkSession, folder: str, stations: list[str] | None = None, years: list[int] | None = None, bounds: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """(station, year, the 14 columns) of station-year files.

    Stations and years are pruned before the scan. A missing column is an error before any job; a measure outside its bounds becomes
    null, as does one that is not a number; the row stays.
    """
    df = spark.read.parquet(folder)
    if missing := sorted({"station", "year", *OBSERVATION} - set(df.columns)):
        raise ValueError(f"missing columns: {missing}")
    if stations is not None:
        df = df.where(F.col("station").isin(stations))
    if years is not None:
        df = df.where(F.col("year").isin(years))
    within = {c: F.when(F.col(c).between(*b), F.col(c)) for c, b in (bounds or {}).items()}
    return df.select("station", "year", *[within[c].alias(c) if c in within else c for c in OBSERVATION])


def fingerprints(spark: SparkSession, paths: list[str], chunk: int = 64 << 20, fan: int = 4096) -> DataFrame:
    """(file, bytes, sha256) of the files below the paths, read in byte ranges by as many tasks as there are ranges.

    A file of one range has its content's SHA-256; a larger one that of its nodes' digests in order, a node that of up to `fan`
    ranges' digests (hex, joined). No task holds more than a few MB of a file. An empty file has no row: Spark lists none.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length")
    last = F.greatest(F.ceil(F.col("length") / chunk) - 1, F.lit(0)).cast("long")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("i")).repartition("path", "i")
    leaves = ranges.mapInArrow(lambda batches: _hashed(batches, chunk), "path string, length bigint, i bigint, h string")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "h"))), lambda x: x["h"]), "")
    one = F.max("h")
    nodes = leaves.groupBy("path", "length", F.floor(F.col("i") / fan).cast("long").alias("node")).agg(F.when(F.col("length") <= chunk, one).otherwise(F.sha2(joined, 256)).alias("h"))
    roots = nodes.withColumnRenamed("node", "i").groupBy("path", "length").agg(F.when(F.col("length") <= chunk, one).otherwise(F.sha2(joined, 256)).alias("sha256"))
    return roots.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), "sha256")


def _hashed(batches, chunk: int, step: int = 4 << 20):
    """Digests of byte ranges; a file that has shrunk since it was listed is an error."""
    import hashlib
    import re
    from urllib.parse import unquote

    import pyarrow as pa
    from pyarrow import fs

    for b in batches:
        out = []
        for path, length, i in zip(*(c.to_pylist() for c in b.columns[:3]), strict=True):
            if local := re.match(r"file:/+", path):
                store, name = fs.LocalFileSystem(), "/" + unquote(path[local.end() :])
            else:
                store, name = fs.FileSystem.from_uri(path)
            h, left = hashlib.sha256(), min(chunk, length - i * chunk)
            with store.open_input_file(name) as f:
                f.seek(i * chunk)
                while left > 0:
                    got = f.read(min(step, left))
                    if not got:
                        raise OSError(f"{path} ends before byte {length}")
                    h.update(got)
                    left -= len(got)
            out.append(h.hexdigest())
        yield pa.record_batch([*b.columns[:3], pa.array(out, pa.string())], names=["path", "length", "i", "h"])
