"""What the corpus operators share: the shared folder, written tables, ASCII lower-casing."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_APPS: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the session may have ended before; the folder is then the cluster's to clean
        pass


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir, which every executor can read.

    Where the setting is empty (tests in local mode) a temporary folder takes its place."""
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/tidemark-{sc.applicationId}"
    if path not in _APPS:
        _APPS.add(path)
        atexit.register(_at_exit, spark, path)
    return path


class _Scopes(threading.local):
    """Each thread's open scopes, innermost last."""

    def __init__(self):
        self.paths: list[list[str]] = []


_SCOPES = _Scopes()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end, but for those written with ``keep``, which the scope around
    this one owns. Frames that read the others must not be used afterwards."""
    _SCOPES.paths.append([])
    try:
        yield
    finally:
        for path in _SCOPES.paths.pop():
            _delete(spark, path)


def new_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    owners = _SCOPES.paths[:-1] if keep else _SCOPES.paths
    if owners:
        owners[-1].append(path)
    return path


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage, and outlives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name, keep)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, spread: list[str]) -> DataFrame:
    """rows joined with the columns of their group, a row of ``groups`` for each value of ``keys`` (never null), which
    has the number of its rows in ``size``. total: the rows of all groups.

    A group of more than a task's share is dealt to as many tasks as it has shares, by a hash of the columns
    ``spread``, and its row goes to each of them. Such groups are fewer than there are partitions, so the list of
    them that is broadcast has a bound whatever the data."""
    share = max(64, total // partitions(rows.sparkSession))
    groups = written(groups, "groups")
    salts = F.ceil(F.col(size) / share).cast("int")
    large = groups.filter(F.col(size) > share).select(*keys, salts.alias("_salts"))
    tagged = rows.join(F.broadcast(large), keys, "left")
    tagged = tagged.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_salts")), F.lit(0)).cast("int")).drop("_salts")
    dealt = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return tagged.join(dealt.hint("merge"), [*keys, "_salt"]).drop("_salt")


BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lets Arrow batches to Python hold at most BATCH_BYTES (or one row): whole texts travel in them, and their
    buffers are outside the heap of the executors. The session's own smaller bound stays. The setting is read when a
    frame runs, which is after the operator returned, so it stays set for the session."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(key, "67108864").rstrip("b"))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def whole_row(df: DataFrame) -> Column:
    """All columns of df as one struct column, out of the way of working columns' names."""
    return F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row")


def fields_of_row(df_columns: list[str], but: tuple[str, ...] = (), **instead: Column) -> list[Column]:
    """The columns inside ``row`` again, without those that new columns replace; ``instead`` gives some anew."""
    lower = {b.lower() for b in but}
    return [instead[c].alias(c) if c in instead else F.col("row").getField(c).alias(c) for c in df_columns if c.lower() not in lower]


def release() -> None:
    """Gives this Python worker's freed memory back to the system: workers are reused from stage to stage."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. A text of ASCII only takes the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
