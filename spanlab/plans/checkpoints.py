"""Written tables that sessions over the same input share, and their release.

A table's name is a digest of its input files (path, size, time of change), of the modules that make
it and of the number of buckets; so a second session, or a second query, finds what the first has written, and other
input or other rules never meet a stale table.  Every session that uses a table leaves a lease beside it; ``release`` drops
the session's leases, its catalog tables and the files of tables without any lease.

The files lie in the folder that the session names in ``spark.checkpoint.dir``.  A table counts as written
once Spark has committed it (``_SUCCESS``), so one that was begun by a lost session is written anew.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import taxonomy, text
from ..operators import align, aligned, lexer, predict
from ..session import ensure_checkpoint_dir, shuffle_partitions
from ..sources import corpus

_HELD: dict[tuple[str, str], dict[str, str]] = {}  # (application, input folder): table name to path


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Digest of the ``documents`` files and of the rules that the written tables depend on."""
    # one row a file, listed by Spark; contents aren't read
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{sf_dir}/documents.parquet")
    h = F.xxhash64("path", "length", "modificationTime")
    files = listed.select(h.alias("h")).agg(F.count(F.lit(1)), F.bit_xor("h"), F.sum(F.col("h") % (1 << 31))).first()
    from . import lineage

    rules = [m.__loader__.get_source(m.__name__) for m in (taxonomy, text, align, aligned, lexer, predict, corpus, lineage)]
    return hashlib.sha256(repr((tuple(files), shuffle_partitions(spark), rules)).encode()).hexdigest()[:24]


def _place(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, str]:
    table = f"spanlab_{name}_{fingerprint(spark, sf_dir)}"
    return table, f"{ensure_checkpoint_dir(spark).rstrip('/')}/{table}"


@contextmanager
def _set(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """Settings of the session while the block runs."""
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def bucketed(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame], keys: list[str]) -> DataFrame:
    """``build()`` as a table bucketed on ``keys`` (none: as it lies), written unless a session has written it before."""
    app = spark.sparkContext.applicationId
    held = _HELD.setdefault((app, sf_dir), {})
    table, path = _place(spark, sf_dir, name)
    fs, n = _fs(spark, path), shuffle_partitions(spark)
    if table not in held:
        fs.mkdirs(_path(spark, f"{path}.leases"))
        fs.create(_path(spark, f"{path}.leases/{app}"), True).close()
        held[table] = path
    if spark.catalog.tableExists(table):
        return spark.table(table)
    if fs.exists(_path(spark, f"{path}/_SUCCESS")):
        schema = spark.read.parquet(path).schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        placed = f"CLUSTERED BY ({', '.join(keys)}) INTO {n} BUCKETS" if keys else ""
        spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet {placed} LOCATION '{path}'")
    elif not keys:
        build().write.mode("overwrite").option("path", path).saveAsTable(table)
    else:
        # Every task holds the rows of one bucket, in order: with a writer at hand they needn't be sorted by bucket.
        with _set(spark, {"spark.sql.optimizer.plannedWrite.enabled": "false", "spark.sql.maxConcurrentOutputFileWriters": "2"}):
            build().write.mode("overwrite").option("path", path).bucketBy(n, *keys).saveAsTable(table)
    return spark.table(table)


def release(spark: SparkSession, sf_dir: str) -> list[str]:
    """Give up this session's tables over ``sf_dir``; returns the paths whose files were removed."""
    app, removed = spark.sparkContext.applicationId, []
    for table, path in _HELD.pop((app, sf_dir), {}).items():
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        fs = _fs(spark, path)
        fs.delete(_path(spark, f"{path}.leases/{app}"), False)
        if not fs.listStatus(_path(spark, f"{path}.leases")):
            fs.delete(_path(spark, path), True)
            fs.delete(_path(spark, f"{path}.leases"), True)
            removed.append(path)
    return removed


def discard(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = ("tokens", "aligned", "places", "marks", "words")) -> None:
    """Remove the tables over ``sf_dir`` whoever holds a lease: those of lost sessions, or before a cold run."""
    release(spark, sf_dir)
    for name in names:
        table, path = _place(spark, sf_dir, name)
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        for p in (path, f"{path}.leases"):
            _fs(spark, p).delete(_path(spark, p), True)
