"""What the operators of this subpackage share: scratch tables, hashing rules and Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: blank and the ASCII controls tab to carriage return.
BLANKS = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``; a temporary one only where that is unset (tests, one machine)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="variorum-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/variorum-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus).cast("long"))


def is_held_out(doc_id: Column, modulus: int, residue: int) -> Column:
    """A null id is never held out."""
    return F.coalesce(remainder(doc_id, modulus) == residue, F.lit(False))


def text_keys(text: Column) -> list[Column]:
    """Two 64-bit hashes of a text, null as empty, that together tell texts apart."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that df doesn't have, case aside."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name = "_" + name
        held.add(name.lower())
        out.append(name)
    return out


def keep_listed(docs: DataFrame, listed: DataFrame, keys: list[Column]) -> DataFrame:
    """Rows of docs that ``listed`` names, one for each of its rows; all columns as they were.

    listed: columns key (an array of strings), in the order of ``keys``, and copies, how many rows of docs have it. A null
    key matches a null. Of rows that have all keys alike one stays, whichever; only keys with copies are sorted out.
    """
    key, mark = fresh(docs, "_key", "_copies")
    listed = listed.select(F.to_json(F.struct("key")).alias(key), F.col("copies").alias(mark))
    named = docs.withColumn(key, F.to_json(F.struct(F.array(*[k.cast("string") for k in keys]).alias("key"))))
    kept = named.join(listed, key)
    single = kept.filter(F.col(mark) == 1).drop(key, mark)
    repeated = kept.filter(F.col(mark) > 1).dropDuplicates([key]).drop(key, mark)
    return single.unionByName(repeated)


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts: one scan of one column, summed in the JVM."""
    return df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def slices(batches: Iterator[pa.RecordBatch], text_col: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most about ``limit`` bytes of text, or a single row."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(text_col)), 0)).astype(np.int64)
        ends = np.cumsum(size)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def tidy() -> None:
    """Give memory that a Python worker no longer uses back to the system: workers outlive the stage."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def hash_sample(rows: DataFrame, keys: list[str], n: int, most: int) -> list:
    """At most ``most`` of n rows, those first in the order of a hash of their keys, brought to the driver.

    Rows whose hash is above what a third more than ``most`` would need are left where they are, so neither a task nor
    the driver gets more than a bounded number.
    """
    share = min(1.0, (1.34 * most + 100) / max(1, n))
    h = F.xxhash64(F.lit(77), *keys)
    bound = int(share * (1 << 64)) - (1 << 63) - 1
    return rows.filter(h <= F.lit(bound)).orderBy(h, *keys).limit(most).collect()


def join_unique(rows: DataFrame, unique: DataFrame, key: str, copies: str, bound: int = 2048) -> DataFrame:
    """Left join of rows with a table that has each key once and says in ``copies`` how many rows have it.

    Keys with more than 1/bound of all rows are at most ``bound``: those are broadcast, so that a hot key
    stays where its rows are. All other keys go through an ordinary shuffle, where none is hot.
    """
    total = unique.agg(F.sum(copies)).first()[0] or 0
    hot = unique.filter(F.col(copies) > total / bound)
    cold = unique.filter(F.col(copies) <= total / bound)
    ids = F.broadcast(hot.select(key))
    return rows.join(F.broadcast(hot), key, "inner").unionByName(rows.join(ids, key, "left_anti").join(cold, key, "left"))
