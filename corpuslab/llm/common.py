"""What the operators of this subpackage share: tables on the shared store."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java's form of "a run of anything but ASCII white space".
WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a sieve: for each key, and at most (8 MB).
SIEVE_KEY, SIEVE = 16, 1 << 26


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset and Spark runs on this machine alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="corpuslab-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def bounded_batches(spark: SparkSession, megabytes: int = 4) -> None:
    """Arrow batches of a few megabytes from now on in this session: a Python worker then holds little at a time, whatever the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def release() -> None:
    """Give freed memory back to the system: Python workers outlive their batches beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and the rows outlive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sieved(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """``rows`` that may have a partner in ``wanted`` by the columns ``keys``, so that a join that follows need not shuffle the others.

    Each key of ``wanted``, a written table, sets two of at most ``SIEVE`` bits, which are broadcast. Every row that has a partner
    passes; so do some that have none (under 1 in 30, more where the bits don't suffice), so the join must follow.
    """
    spark = rows.sparkSession
    n = 1 << min(SIEVE.bit_length() - 1, max(6, (SIEVE_KEY * wanted.count() - 1).bit_length()))

    def places(df: DataFrame) -> list[Column]:
        h = F.xxhash64(*[df[k] for k in keys])
        return [x.bitwiseAND(F.lit(n - 1)) for x in (h, F.shiftrightunsigned(h, 32))]

    at = wanted.select(F.explode(F.array(*places(wanted))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(n >> 6, dtype=np.int64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    sieve = spark.createDataFrame(pa.table({"__bits": pa.array([bits], pa.list_(pa.int64()))}))
    hit = [F.getbit(F.get("__bits", F.shiftright(x, 6).cast("int")), x.bitwiseAND(F.lit(63)).cast("int")) == 1 for x in places(rows)]
    return rows.join(F.broadcast(sieve), hit[0] & hit[1]).drop("__bits")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__d`` and ``__f``, never null, which name a row by its id and text.

    ``__f`` hashes the text in 64 bits. Rows without id, of which there may be many, have another hash in place of the id.
    """
    kind = docs.schema["doc_id"].dataType
    text = F.coalesce("text", F.lit(""))
    other = F.xxhash64(F.lit("id"), text)
    if kind.simpleString() not in ("bigint", "string"):
        other = F.lit("0")
    return docs.select("*", F.coalesce("doc_id", other.cast(kind)).alias("__d"), F.xxhash64(F.col("doc_id").isNull(), text).alias("__f"))
