"""Scans, sinks and text-serialised list columns.

Sinks write under the session's shared checkpoint directory (or a path the
caller gives) and hand back a DataFrame read from what was written, so a
write is always checked by a read.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from ..functions.text import normalise_literal
from ..session import ensure_checkpoint_dir
from .corpus import DOC_KEY, MASK_TYPE_B


def scan_split(docs: DataFrame, split: str) -> DataFrame:
    """One split of a dataset (``ds[split]``)."""
    return docs.where(F.col("split") == split)


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Read an intermediate Parquet dataset; nested lists stay nested."""
    return spark.read.parquet(path)


def output_path(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "out", f"{name}-{uuid.uuid4().hex[:12]}")


def sink_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write a dataset as Parquet (optionally partitioned) and read it back."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return df.sparkSession.read.parquet(path)


def to_text_lists(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nested columns -> JSON text (CSV cannot hold arrays)."""
    return df.select(*[F.to_json(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def sink_csv(df: DataFrame, path: str, nested: list[str]) -> DataFrame:
    """Write with list columns as JSON text; returns the raw read-back."""
    (to_text_lists(df, nested).write.mode("overwrite").option("header", True)
     .option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))
    return scan_csv(df.sparkSession, path)


def scan_csv(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .csv(path))


def restore_lists(df: DataFrame, column: str, schema: str = MASK_TYPE_B) -> DataFrame:
    """List column stored as text (JSON or Python literal) -> array of structs; a
    column that holds lists already stays as it is."""
    if not isinstance(df.schema[column].dataType, StringType):
        return df
    return df.withColumn(column, parse_literal(F.col(column), schema))


def python_literal(mask: Column) -> Column:
    """Render an annotation array the way Python's ``str(list_of_dicts)`` does."""
    def s(v):
        esc = F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
        return F.concat(F.lit("'"), esc, F.lit("'"))

    def item(a):
        li = F.coalesce(a["label_index"].cast("string"), F.lit("None"))
        return F.concat(F.lit("{'value': "), s(a["value"]), F.lit(", 'start': "), a["start"].cast("string"),
                        F.lit(", 'end': "), a["end"].cast("string"), F.lit(", 'label': "), s(a["label"]),
                        F.lit(", 'label_index': "), li, F.lit("}"))
    return F.concat(F.lit("["), F.array_join(F.transform(mask, item), ", "), F.lit("]"))


def parse_literal(text: Column, schema: str = MASK_TYPE_B) -> Column:
    """Python-literal (or JSON) annotation text -> array of structs.

    ``None``/``True``/``False`` are rewritten first: a bare ``None`` would
    otherwise turn the whole value null.
    """
    return F.from_json(normalise_literal(text), schema,
                       {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"})


def describe_schema(docs: DataFrame) -> list[tuple[str, str]]:
    """``(column, type)`` of every column, fields of nested structs by their path."""
    out: list[tuple[str, str]] = []

    def walk(path, dt):
        out.append((path, dt.simpleString()))
        inner = dt.elementType if isinstance(dt, ArrayType) else dt
        if isinstance(inner, StructType):
            for f in inner.fields:
                walk(f"{path}.{f.name}", f.dataType)
    for f in docs.schema.fields:
        walk(f.name, f.dataType)
    return out


def describe_dataset(docs: DataFrame) -> DataFrame:
    """The schema walk and the counts as one table: ``section`` is ``schema`` (``name`` a path, ``type`` its type)
    or ``counts`` (``name`` corpus and split, ``n_rows``, ``n_annotations``)."""
    none, text = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    counts = docs.groupBy("origin", "split").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.sum(F.size("privacy_mask")).cast("bigint").alias("n_annotations"))
    schema = docs.sparkSession.createDataFrame(describe_schema(docs), "name string, type string")
    return schema.select(F.lit("schema").alias("section"), "name", "type", none.alias("n_rows"), none.alias("n_annotations")).unionByName(
        counts.select(F.lit("counts").alias("section"), F.concat_ws("/", "origin", "split").alias("name"), text.alias("type"),
                      "n_rows", "n_annotations"))


#: Most rows that a head sample takes: its keys are broadcast.
MAX_HEAD = 10_000


def head_keys(docs: DataFrame, n: int) -> DataFrame:
    """Keys of the first ``n`` rows in key order: a bounded top-n, no sort of the corpus."""
    if not 0 <= n <= MAX_HEAD:
        raise ValueError(f"a head sample takes 0 to {MAX_HEAD} rows, not {n}")
    return docs.select(*DOC_KEY).orderBy(*DOC_KEY).limit(n)


def sample_rows(docs: DataFrame, n: int, keys: DataFrame | None = None) -> DataFrame:
    """The first ``n`` rows in key order (the reference's ``--sample``).

    The keys are chosen first (``head_keys``), so that what ``docs`` computes from a text, such as its annotations, is
    computed for the chosen rows only: apply this before it.
    """
    return docs.join(F.broadcast(head_keys(docs, n) if keys is None else keys), DOC_KEY, "left_semi")


def sample_random(docs: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """A real random sample, as the option's help text promises: every row is taken or left by 32 bits of a
    digest of the seed and its key, so that a task run again takes the same rows."""
    if not 0 <= fraction <= 1:
        raise ValueError(f"a fraction is 0 to 1, not {fraction}")
    draw = F.conv(F.substring(F.md5(F.concat_ws(",", F.lit(str(seed)), *[F.col(c).cast("string") for c in DOC_KEY]).cast("binary")), 1, 8), 16, 10)
    return docs.where(draw.cast("bigint") < F.lit(int(fraction * (1 << 32))))
