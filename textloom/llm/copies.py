"""Copies hidden by formatting (problem 6): canonical form, Bloom pre-filter, exact grouping."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import fold_width, scratch

DASHES = "‐‑‒–—―−﹣"
# Marks between field=value entries; a slash only where another entry follows (not in m/s).
ENTRY_ENDS = r"[;,|、，；\n\r]+|/(?=[^/=:;,|、，；\n\r]*[=:])"

# Punctuation, symbols and control characters, but for a point between digits and a minus that begins a value.
NOT_VALUE = r"(?<!\d)\.|\.(?!\d)|(?<![=:])-|-(?!\.?\d)|[\p{P}\p{S}\p{C}&&[^.\-]]"


def canonical(c: Column) -> Column:
    """The form in which copies agree.

    Half width, lower case, no white space; then no punctuation or symbols, but a point between
    digits and a minus right after ``=`` or ``:`` stay. Where every one of two or more entries
    has a ``=`` or ``:``, the entries are put in order. Null stays null.
    """
    s = F.lower(F.translate(fold_width(c), DASHES, "-" * len(DASHES)))
    kept = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", ""), NOT_VALUE, "")
    parts = F.filter(F.split(s, ENTRY_ENDS), lambda x: F.length(kept(x)) > 0)
    entries = (F.size(parts) > 1) & F.forall(parts, lambda x: x.rlike("[=:]"))
    return F.when(entries, F.array_join(F.array_sort(F.transform(parts, kept)), "|")).otherwise(kept(s))


def copy_key(*cols: str) -> Column:
    """128 bits of the canonical forms; a null is a value of its own."""
    forms = F.concat_ws("~", *[F.coalesce(F.concat(F.lit("="), canonical(F.col(c))), F.lit("0")) for c in cols])
    return F.md5(forms)


def _bits(h: np.ndarray, log_bits: int, hashes: int) -> np.ndarray:
    a, b = h.astype(np.uint64), (h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    mask, shift = np.uint64((1 << log_bits) - 1), np.uint64(64 - log_bits)
    return np.stack([((a * np.uint64(2 * i + 1) + np.uint64(i) * b) >> shift) & mask for i in range(hashes)]).astype(np.int64)


def _set(bits: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bits, at >> 3, (1 << (at & 7)).astype(np.uint8))


def _all_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).all(0) if at.size else np.zeros(at.shape[-1], bool)


def repeat_filter(keys: DataFrame, log_bits: int, key: str = "h", hashes: int = 3, log_cell: int = 16) -> bytes:
    """Bloom filter, of 2**log_bits bits, of the 64-bit keys that may occur more than once.

    Each partition fills one filter of keys seen and one of keys seen again and hands them on in cells of 2**log_cell
    bytes, only those with a bit set, compressed. The cells are shuffled by number and merged as they arrive in
    order, (A1|A2, B1|B2|(A1&A2)), so no task holds more than two cells; what reaches the driver are the merged
    cells, at most 2**log_bits bits. A fuller filter lets more singles through, never loses a repeat.
    """
    log_cell = min(log_cell, log_bits - 3)
    size, width = 1 << (log_bits - 3), 1 << log_cell

    def fill(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        once, twice = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        for p in parts:
            u, n = np.unique(p[key].to_numpy(np.int64), return_counts=True)
            at = _bits(u, log_bits, hashes)
            again = (n > 1) | _all_set(once, at)
            _set(twice, at[:, again].ravel())
            _set(once, at.ravel())
        some = np.flatnonzero(once.reshape(-1, width).any(1))
        for i in range(0, len(some), 64):
            pick = some[i : i + 64].tolist()
            pack = lambda f: [zlib.compress(f[c * width : (c + 1) * width].tobytes(), 1) for c in pick]  # noqa: E731, B023
            yield pd.DataFrame({"cell": pick, "a": pack(once), "b": pack(twice)})

    def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, a, b = None, None, None
        for p in parts:
            for cell, x, y in zip(p["cell"], p["a"], p["b"], strict=True):
                x, y = np.frombuffer(zlib.decompress(x), np.uint8), np.frombuffer(zlib.decompress(y), np.uint8)
                if cell == now:
                    b, a = b | y | (a & x), a | x
                    continue
                if now is not None and b.any():
                    yield pd.DataFrame({"cell": [now], "b": [zlib.compress(b.tobytes(), 1)]})
                now, a, b = cell, x, y
        if now is not None and b.any():
            yield pd.DataFrame({"cell": [now], "b": [zlib.compress(b.tobytes(), 1)]})

    merged = (keys.select(key).mapInPandas(fill, "cell long, a binary, b binary").repartition("cell").sortWithinPartitions("cell")
              .mapInPandas(merge, "cell long, b binary"))
    out = np.zeros(size, np.uint8)
    for r in merged.toLocalIterator():
        out[r["cell"] * width : (r["cell"] + 1) * width] = np.frombuffer(zlib.decompress(r["b"]), np.uint8)
    return out.tobytes()


def collapse_copies(nodes: DataFrame, id_col: str = "node_no", cols: tuple[str, ...] = ("name", "entity_type"),
                    max_log_bits: int = 27, hashes: int = 3) -> DataFrame:
    """Every row's group: ``id_col``, keep_no (smallest id of the group), copies (rows of the group).

    The hashes are cut into as many slices as keep the Bloom filter of each at ten bits a row and below
    2**max_log_bits bits (16 MB, what is broadcast at a time), so the filter works alike for thousands and for
    billions of rows: the rows are stored once by slice, and each slice gets its own filter. Keys a filter has seen
    once only are emitted as groups of one without a shuffle; the possible repeats are shuffled as (key, id) and
    grouped exactly. A group's rows are never gathered: size and smallest id are partial aggregates, and joined back
    by key with the hot keys split by adaptive execution. Repeated rows of one id count once; rows whose columns
    are null agree with each other only in being null in the same columns; an empty table gives an empty result.
    """
    flagged = flag_repeats(nodes, id_col, cols, max_log_bits, hashes)
    single = flagged.where(~F.col("again")).select(id_col, F.col(id_col).alias("keep_no"), F.lit(1).cast("long").alias("copies"))
    rows = flagged.where("again").select("key", id_col).distinct()
    groups = rows.groupBy("key").agg(F.min(id_col).alias("keep_no"), F.count(F.lit(1)).alias("copies"))
    many = rows.join(groups.where("copies > 1"), "key").select(id_col, "keep_no", "copies")
    one = groups.where("copies = 1").select(F.col("keep_no").alias(id_col), "keep_no", "copies")
    return single.unionByName(many).unionByName(one)


def flag_repeats(nodes: DataFrame, id_col: str, cols: tuple[str, ...], max_log_bits: int = 27, hashes: int = 3) -> DataFrame:
    """id, key, again: whether some other row may have the row's key, told by the Bloom filter of its slice."""
    spark = nodes.sparkSession
    rows = nodes.count()
    slices = max(1, math.ceil(10 * rows / (1 << max_log_bits)))
    log_bits = int(min(max_log_bits, max(12, np.ceil(np.log2(max(1, 10 * rows / slices))))))
    path, out = scratch(spark, "keys"), scratch(spark, "flagged")
    keyed = nodes.select(F.col(id_col), copy_key(*cols).alias("key")).withColumn("h", F.xxhash64("key"))
    schema = keyed.schema
    keyed.withColumn("slice", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(slices))).write.partitionBy("slice").parquet(path)
    for i in range(slices) if rows else ():
        try:
            part = spark.read.schema(schema).parquet(f"{path}/slice={i}")
        except AnalysisException:  # no key fell into the slice
            continue
        sent = spark.sparkContext.broadcast(repeat_filter(part, log_bits, "h", hashes))

        @F.pandas_udf("boolean")
        def maybe(h: pd.Series) -> pd.Series:
            return pd.Series(_all_set(np.frombuffer(sent.value, np.uint8), _bits(h.to_numpy(np.int64), log_bits, hashes)))  # noqa: B023

        part.select(id_col, "key", maybe("h").alias("again")).write.mode("append").parquet(out)
        sent.destroy()
    return spark.read.schema(schema.add("again", "boolean")).parquet(out).drop("h") if rows else spark.createDataFrame([], schema.add("again", "boolean"))
