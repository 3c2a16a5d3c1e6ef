"""Helpers shared by the training-data operators: written intermediate tables and word splitting."""

from __future__ import annotations

import gc
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.session import ensure_checkpoint_dir

# ASCII upper case to lower case, and everything in ASCII that is neither a digit nor a letter to a blank.
ALNUM_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder of this application."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def scratch_table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    This cuts lineage and fixes row identities: a lost executor costs a reread of shared files, never a
    second run of the work above.  The files live as long as the checkpoint folder; ``drop_scratch``
    removes them once no result that reads them is needed any more."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def free_tables(*tables: DataFrame) -> None:
    """Delete tables that ``scratch_table`` returned.  Only for tables all of whose readers are written themselves: then a
    lost executor needs them no more."""
    for t in tables:
        path = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settled_table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``scratch_table``; after it the driver forgets what it holds of finished jobs, so that Spark's cleaner drops their
    shuffle files now and not at some later collection of garbage.  For steps whose shuffles are large."""
    out = scratch_table(df, name, **options)
    del df
    gc.collect()
    out.sparkSession.sparkContext._jvm.System.gc()
    return out


def drop_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm")
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


BROADCAST_ROWS = 100_000


def is_small(df: DataFrame, rows: int | None = None) -> bool:
    """Whether a written table has fixed-width columns only and, by a count, at most ``rows`` rows
    (``BROADCAST_ROWS`` if not given: a few MB)."""
    fixed = all(f.dataType.simpleString() in ("bigint", "int", "boolean", "double") for f in df.schema)
    return fixed and df.count() <= (BROADCAST_ROWS if rows is None else rows)


def small_side(df: DataFrame) -> DataFrame:
    """Mark a table for broadcast if it ``is_small``; beyond that it is returned as it is, and the join shuffles."""
    return F.broadcast(df) if is_small(df) else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alnum_words(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: A-Z lowered, runs of ASCII digits, ASCII letters and non-ASCII characters."""
    return text.translate(ALNUM_FOLD).split()


def span_hashes(joined: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of the byte spans [start, end) of ``joined``, all computed from one prefix sum.

    hash(s) = sum(byte[j] * M^(j - start)) mod 2^64 with odd M, then a final mix.  Equal spans have equal
    hashes wherever they stand; callers verify the bytes of what they find."""
    n = len(joined)
    if n == 0:
        return np.zeros(len(starts), np.uint64)
    power, inverse = _powers(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(joined, np.uint8).astype(np.uint64) + np.uint64(1)) * power[:n], out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * inverse[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


_MULTIPLIER = 0xD1342543DE82EF95
_TABLE: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse mod 2^64, at least n of each; grown by doubling."""
    if not _TABLE or len(_TABLE[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        pair = []
        for base in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)):
            p = np.ones(1, np.uint64)
            while len(p) < size:
                p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
            pair.append(p)
        _TABLE[:] = pair
    return _TABLE[0], _TABLE[1]
