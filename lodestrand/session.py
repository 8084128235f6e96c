"""Session helpers: table loading and durable intermediate tables."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"

_written: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Hands the package to the Python workers of this application, wherever they run; once for each context."""
    sc = spark.sparkContext
    if getattr(sc, "_lodestrand_shipped", False):
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="lodestrand-")) / f"{root.name}.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(to))
    sc._lodestrand_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table as it stands on disk."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it. Without one a local master gets a temporary folder; a
    cluster is an error, as each executor would write to a disk of its own."""
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a shared folder on {master}")
    own = getattr(spark, "_lodestrand_dir", None)
    if own is None:
        own = spark._lodestrand_dir = "file://" + tempfile.mkdtemp(prefix="lodestrand-")
    return own


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: it is computed once, its lineage is cut,
    and the loss of an executor costs nothing already written. Removed when the process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope() -> Iterator[None]:
    """Tables staged within are removed at its end; what is needed longer must be written elsewhere before. For
    streams, whose batches would otherwise fill the folder."""
    before = len(_written)
    try:
        yield
    finally:
        _remove(_written[before:])
        del _written[before:]


def discard(df: DataFrame) -> None:
    """Removes a staged table that nothing reads any more."""
    files = {f.rsplit("/", 1)[0].split(":", 1)[-1].lstrip("/") for f in df.inputFiles()}
    gone = [x for x in _written if x[1].split(":", 1)[-1].lstrip("/") in files]
    _remove(gone)
    for x in gone:
        _written.remove(x)


def file_state(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files at ``path``: a table read again is the same while this is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found))


@atexit.register
def _remove_staged() -> None:
    _remove(_written)


def _remove(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        try:
            jvm = spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the JVM may have gone first
            return


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many parts as there are cores, if its files make fewer, as those of small tables do: work on texts
    takes long for their bytes. Larger inputs stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def parts(spark: SparkSession) -> int:
    """As many parts as a shuffle makes, and one for each core: rows that take long for their bytes aren't joined to fewer."""
    return max(partitions(spark), spark.sparkContext.defaultParallelism)


#: A key is hot if it holds over LEAST_HOT rows and a HOT_PARTS-th of all; there are under HOT_PARTS of them.
HOT_PARTS, LEAST_HOT = 10_000, 100_000


def spread_join(many: DataFrame, few: DataFrame, keys: list[str], least: int = LEAST_HOT) -> DataFrame:
    """Inner join of ``many``, a key of which may hold a third of all rows, with ``few``. The rows of a hot key are parted
    by their hash, so many a part that none is hot, and the rows of ``few`` with that key are repeated for each part; so
    no task takes a large share. ``many`` is read twice and should be staged. Neither has a column ``_part``."""
    total = many.count()
    if total <= least:
        return many.join(few, keys)
    limit = max(least, total // HOT_PARTS)
    hot = many.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
    hot = stage(hot.select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_parts")), "hot-keys")
    if hot.isEmpty():
        return many.join(few, keys)
    hot, parts = F.broadcast(hot), F.coalesce("_parts", F.lit(1))
    one = many.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*many.columns), parts).cast("int")).drop("_parts")
    two = few.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return one.join(two, [*keys, "_part"]).drop("_part")
