"""Shared helpers: width folding, white space, shared folder, session set-up."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources.store import scratch

# Full-width forms U+FF01..U+FF5E and the ideographic space, by rule.
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "
SPACES = r"(?U)\s+"


def fold_width(c: Column) -> Column:
    """Full-width characters become half-width."""
    return F.translate(c, WIDE, NARROW)


def sql_fold_width(expr: str) -> str:
    """The same folding as a SQL expression."""
    q = "'" + WIDE.replace("'", "''") + "'", "'" + NARROW.replace("'", "''") + "'"
    return f"translate({expr}, {q[0]}, {q[1]})"


def normal_term(c: Column) -> Column:
    """Half width, lower case, trimmed, each run of white space one space."""
    return F.lower(F.trim(F.regexp_replace(fold_width(c), SPACES, " ")))


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False, most_bytes: int = 1 << 30) -> DataFrame:
    """A table of the data folder; with ``spread`` one of at most ``most_bytes`` that comes in fewer partitions than half
    the cores is spread over all (a larger one is read as it lies, its shuffle would cost more than it gains)."""
    path = f"{sf_dir}/{name}.parquet"
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    if not spread or df.rdd.getNumPartitions() * 2 > cores:
        return df
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return df.repartition(cores) if size <= most_bytes else df


def shared_file(spark: SparkSession, what: str, data: bytes) -> str:
    """Write bytes to the shared folder and have every executor fetch them once; the name for ``SparkFiles.get``."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{scratch(spark, what)}.bin")
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    for i in range(0, len(data), 1 << 24):
        out.write(bytearray(data[i : i + (1 << 24)]))
    out.close()
    spark.sparkContext.addFile(at.toString())
    return at.getName()


def stored(df: DataFrame, path: str, block: int = 128 << 20) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors. ``block``: bytes of a
    row group, which each writing and reading task holds."""
    df.write.mode("overwrite").option("parquet.block.size", block).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SHARE = 2.0**-23  # of all that is counted: what is rarer is as good as unseen, at every size


def usual(counts: DataFrame, what: str, share: float = SHARE) -> DataFrame:
    """The rows of a table with counts ``n`` that occur more than once and make up ``share`` of all such at
    least. ``n`` are sums over all tasks, so partitioning doesn't decide what is kept, and no more than 1 / share
    rows are, however large the collection (8 million of 16 bytes; natural text has far fewer)."""
    kept = stored(counts.where("n > 1"), scratch(counts.sparkSession, what))
    total = kept.agg(F.sum("n")).first()[0] or 0
    return kept.where(F.col("n") >= share * total)


def bloom_bits(h: np.ndarray, log_bits: int) -> np.ndarray:
    """Three places of each 64-bit hash in a filter of 2**log_bits bits."""
    u, s = h.view(np.uint64), np.uint64(64 - log_bits)
    return np.stack([(u >> s), (u * np.uint64(0x9E3779B97F4A7C15)) >> s, (u * np.uint64(0xC2B2AE3D27D4EB4F)) >> s]).astype(np.int64)


def key_filter(keys: DataFrame, log_bits: int, log_cell: int = 16) -> np.ndarray:
    """Bloom filter, of 2**log_bits bits, of the hashes in a column ``h`` ARRAY<BIGINT>.

    Each partition hands on the cells of its filter (2**log_cell bytes) that have a bit set, compressed; these are
    shuffled by number and united as they arrive in order, so no task holds more than a filter and two cells."""
    log_cell = min(log_cell, log_bits - 3)
    size, width = 1 << (log_bits - 3), 1 << log_cell

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, np.uint8)
        for b in batches:
            at = bloom_bits(np.unique(b.column(0).flatten().to_numpy()), log_bits).ravel()
            np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))
        some = np.flatnonzero(bits.reshape(-1, width).any(1))
        for i in range(0, len(some), 64):
            pick = some[i : i + 64].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(pick, pa.int64()), pa.array([zlib.compress(bits[c * width : (c + 1) * width].tobytes(), 1) for c in pick], pa.binary())], ["cell", "b"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give = lambda c, b: pa.RecordBatch.from_arrays([pa.array([c], pa.int64()), pa.array([zlib.compress(b.tobytes(), 1)], pa.binary())], ["cell", "b"])
        now, bits = None, None
        for batch in batches:
            for cell, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b = np.frombuffer(zlib.decompress(b), np.uint8)
                if cell == now:
                    bits = bits | b
                    continue
                if now is not None:
                    yield give(now, bits)
                now, bits = cell, b
        if now is not None:
            yield give(now, bits)

    out = np.zeros(size, np.uint8)
    for r in keys.select("h").mapInArrow(fill, "cell long, b binary").repartition("cell").sortWithinPartitions("cell").mapInArrow(unite, "cell long, b binary").toLocalIterator():
        out[r["cell"] * width : (r["cell"] + 1) * width] = np.frombuffer(zlib.decompress(r["b"]), np.uint8)
    return out


def may_hold(bits: np.ndarray, h: np.ndarray, log_bits: int) -> np.ndarray:
    """Which of the hashes the filter may hold."""
    hit = np.ones(len(h), bool)
    for at in bloom_bits(h, log_bits):
        hit &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
    return hit


def pieces(texts: list, rows: int = 512, chars: int = 1_500_000) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts, of so many rows or characters at most (a longer text is a run of its own)."""
    a = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > a and (i - a >= rows or total + n > chars):
            yield a, i
            a, total = i, 0
        total += n
    if a < len(texts):
        yield a, len(texts)
