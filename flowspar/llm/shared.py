"""Durable intermediate tables, hash-seeded numbers, exact selection and connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []

ARROW_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Has Spark send at most ARROW_BYTES at a time to Python workers (long texts make batches of 10,000 rows huge)."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)


#: texts of nothing but white space (null counts as such)
BLANK = r"coalesce(text, '') not rlike '\\S'"


def numbered(docs: DataFrame, column: str = "doc_id") -> DataFrame:
    """docs, after a check that its ids are integers: results carry them as such, so other types are refused at once."""
    kind = dict(docs.dtypes)[column]
    if kind not in ("bigint", "int", "smallint", "tinyint", "void"):
        raise TypeError(f"{column} must be an integer column, not {kind}")
    return docs


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Only where it is unset (local tests) is a
    temporary one made and set; a cluster without the setting is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get()
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="flowspar-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df into the shared folder and reads it back: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, as a URI, for files that operators write themselves. It is deleted at the end
    of the program, like the tables of ``table``."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    folder = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    _written.append((spark, folder))
    return folder


def forget(df: DataFrame) -> None:
    """Deletes the files of a table made by ``table`` that nothing lazy reads any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # the JVM is gone: the folder's owner cleans up
            return


def uniform(seed: str, *columns: Column | str) -> Column:
    """A number in (0, 1) from the MD5 of seed and columns: the same on every engine, run and retry.
    52 bits, shifted by half a step, so that 0 and 1 never occur. Null counts as an empty string."""
    parts = [F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns]
    return (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *parts)), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def top_k(df: DataFrame, key: str, ties: list[str], k: int) -> DataFrame:
    """Exactly the k rows with the largest key (ties: ascending), without a global sort: an approximate
    quantile gives a narrow band, rows above it are taken, and only the band is sorted. df: a written table."""
    n = df.count()
    if k >= n:
        return df
    if k <= 0:
        return df.limit(0)
    width = 4e-4
    while True:
        low, high = max(0.0, 1 - k / n - width), min(1.0, 1 - k / n + width)
        a, b = df.agg(F.percentile_approx(key, [low, high], 20_000).alias("q")).first()["q"]
        a = float("-inf") if low == 0 else a
        b = float("inf") if high == 1 else b
        above, within = df.agg(F.count_if(F.col(key) > b), F.count_if(F.col(key).between(a, b))).first()
        if above <= k <= above + within:
            break
        width *= 8
    band = df.where(F.col(key).between(a, b)).orderBy(F.desc(key), *ties).limit(k - above)
    return df.where(F.col(key) > b).unionByName(band)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of edges(a, b): (node, root) for every node that has an edge to another node; root is
    the smallest node. Alternating large-star and small-star rounds: O(log n) rounds, each a written table."""
    current = table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = F.least(F.min("b").over(Window.partitionBy("a")), F.col("a"))
        large = both.select("a", "b", least.alias("m")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = F.min("b").over(Window.partitionBy("a"))
        star = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).select("a", "b", low.alias("m"))
        small = star.select("a", F.col("m").alias("b")).unionByName(star.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        after = table(small, name)
        now = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        forget(current)
        current = after
        if now == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now
