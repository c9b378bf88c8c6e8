"""Freely typed names mapped to a reference list (problem 5).

The symmetric-delete dictionary (every name with up to two characters left out) is built once, as sorted hashes
with name numbers in one file that the workers of a machine map into memory. A value's own deletes are looked
up in it; the names they hit are ranked by weighted Damerau-Levenshtein distance and by how often they occur.
"""

from __future__ import annotations

import mmap
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import fold_width, shared_file
from textloom.llm.script import simplified

MISS = -1
_BRACKETED = re.compile(r"[(\[{（【「『<《]([^)\]}）】」』>》]*)[)\]}）】」』>》]")
_TYPE_OF = re.compile(r"^(.+?)\s+of\s+(.+?)(?:\s+type)?$")
_BASE = 0x9E3779B97F4A7C15


def squeeze(s: str, variants: dict[int, int] | None = None) -> str:
    """Letters and digits only, in compatibility form, lower case and (by ``variants``) simplified script."""
    out = "".join(c for c in unicodedata.normalize("NFKC", s).lower() if c.isalnum())
    return out.translate(variants) if variants and not out.isascii() else out


def delete_hashes(s: str, depth: int) -> Iterator[np.ndarray]:
    """64-bit hashes of the string and of all it becomes by leaving out up to ``depth`` (at most two) characters,
    in arrays no longer than the string: with the hashes of all prefixes and suffixes each takes a few operations."""
    n = len(s)
    with np.errstate(over="ignore"):
        x = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(31)
        power = np.ones(n + 1, np.uint64)
        power[1:] = np.multiply.accumulate(np.full(n, _BASE, np.uint64))
        tail = np.concatenate([np.cumsum((x * power[n - 1 :: -1] if n else x)[::-1])[::-1], np.zeros(1, np.uint64)])  # hash of s[i:]
        whole = tail[0]
        yield whole[None]
        if depth < 1 or not n:
            return
        # Of s without character i: what stands before it moves one power down.
        inverse = np.uint64(pow(_BASE, -1, 1 << 64))
        one = (whole - tail[:n]) * inverse + tail[1:]
        yield one
        for i in range(n - 1) if depth > 1 else ():
            head, between = (whole - tail[i]) * inverse * inverse, (tail[i + 1] - tail[i + 1 : n]) * inverse
            yield head + between + tail[i + 2 :]


def depth_of(k: str) -> int:
    """Names in letters of ten or more allow two edits, others of five or more one; in a shorter name one
    character makes another word."""
    return 2 if k.isascii() and len(k) >= 10 else int(len(k) >= 5)


def edit_distance(a: str, b: str, limit: float) -> float:
    """Weighted Damerau-Levenshtein distance (optimal alignment), or infinity beyond ``limit``.

    A doubled character costs 0.7, a swap of neighbours 0.8, any other step 1.
    """
    if abs(len(a) - len(b)) * 0.7 > limit:
        return float("inf")
    before, row = None, [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [float(i)]
        for j, y in enumerate(b, 1):
            drop = 0.7 if i > 1 and a[i - 2] == x else 1.0
            best = min(row[j] + drop, new[j - 1] + 1.0, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                best = min(best, before[j - 2] + 0.8)
            new.append(best)
        if min(new) > limit:
            return float("inf")
        before, row = row, new
    return row[-1] if row[-1] <= limit else float("inf")


class Deletes:
    """Sorted hashes of all deletes of the names, each with its name's number; one block of bytes."""

    def __init__(self, buf):
        n = int(np.frombuffer(buf, np.int64, 1)[0])
        self.hash, self.name = np.frombuffer(buf, np.uint64, n, 8), np.frombuffer(buf, np.int32, n, 8 + 8 * n)

    @staticmethod
    def build(names: list[str], most: int = 1 << 27) -> bytes:
        """``most``: the entries allowed (12 bytes each); more raise an error."""
        size = sum(1 + len(k) + (len(k) * (len(k) - 1) // 2 if depth_of(k) > 1 else 0) for k in names)
        if size > most:
            raise ValueError(f"the delete dictionary would have {size} entries; split the reference list")
        parts = [np.unique(np.concatenate([*delete_hashes(k, depth_of(k))])) for k in names]
        h = np.concatenate([np.zeros(0, np.uint64), *parts])
        at = np.repeat(np.arange(len(names), dtype=np.int32), [len(p) for p in parts])
        order = np.argsort(h, kind="stable")
        return np.int64(len(h)).tobytes() + h[order].tobytes() + at[order].tobytes()

    @classmethod
    def mapped(cls, path: str) -> Deletes:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def near(self, k: str, depth: int) -> set[int]:
        """Numbers of the names that have a delete in common with ``k``."""
        out: set[int] = set()
        for h in delete_hashes(k, depth):
            a, z = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
            for i in np.flatnonzero(z > a):
                out.update(self.name[a[i] : z[i]].tolist())
        return out


class ReferenceIndex:
    """Exact names, abbreviations and the delete dictionary of a reference list.

    ``entries``: (ref_id, canonical, name_en, abbrev); any of the names may be null. Abbreviations allow no edit.
    ``seen``: how often each entry was written exactly, to rank entries at the same distance; then the smaller id.
    """

    def __init__(self, entries: list[tuple], seen: dict[int, int] | None = None, variants: dict[int, int] | None = None, deletes: Deletes | None = None):
        self.exact: dict[str, int] = {}
        self.short: dict[str, int] = {}
        self.names: list[tuple[str, int]] = []
        self.seen, self.variants = seen or {}, variants or {}
        for ref, canonical, name_en, abbrev in sorted(entries, key=lambda e: (-self.seen.get(e[0], 0), e[0])):
            for name in (canonical, name_en):
                if name and (k := squeeze(name, self.variants)):
                    self.exact.setdefault(k, ref)
                    self.names.append((k, ref))
            if abbrev and (k := squeeze(abbrev, self.variants)):
                self.short.setdefault(k, ref)
        self.lengths = sorted({len(k) for k, _ in self.names})
        self.deletes = Deletes(Deletes.build([k for k, _ in self.names])) if deletes is None else deletes

    def forms(self, value: str) -> Iterator[str]:
        """The readings of a value, from plain to stripped of decoration."""
        v = unicodedata.normalize("NFKC", value).strip()
        yield v
        if _BRACKETED.search(v):
            yield _BRACKETED.sub(" ", v)
            for inner in _BRACKETED.findall(v):
                yield inner
        parts = [p for p in re.split(r"[,，、;；]", v) if p.strip()]
        if len(parts) == 2:
            yield f"{parts[1]} {parts[0]}"
        if m := _TYPE_OF.match(v.lower().replace("_", " ").replace("-", " ")):
            yield f"{m[2]} {m[1]}"

    def _contained(self, k: str) -> int:
        """The longest whole name inside the value, if little is left over; else MISS."""
        least = max(4, len(k) // 2)
        for n in reversed(self.lengths):
            if n >= len(k) or n < least:
                continue
            if len(k) - n > (10 if k.isascii() else 5):
                break
            for i in range(len(k) - n + 1):
                if (ref := self.exact.get(k[i : i + n])) is not None:
                    return ref
        return MISS

    def _fuzzy(self, k: str) -> tuple[float, int]:
        """The nearest name: distance, then the more frequent entry, then the smaller id."""
        rank = (float("inf"), 0, MISS)
        if not self.lengths or len(k) > self.lengths[-1] + 2:  # longer than any name with its edits
            return rank[0], MISS
        # A name that allows two edits may be shorter than ten letters itself once they are left out.
        for at in self.deletes.near(k, 2 if k.isascii() and len(k) >= 8 else 1):
            name, ref = self.names[at]
            if k.isascii() == name.isascii():
                d = edit_distance(k, name, float(depth_of(name)))
                rank = min(rank, (d, -self.seen.get(ref, 0), ref)) if d < float("inf") else rank
        return rank[0], rank[2]

    def lookup(self, value: str | None) -> int:
        """The entry meant, or MISS. Null and blank give MISS."""
        if value is None or not value.strip():
            return MISS
        keys = list(dict.fromkeys(k for f in self.forms(value) if (k := squeeze(f, self.variants))))
        for known in (self.exact, self.short):
            for k in keys:
                if k in known:
                    return known[k]
        for k in keys:
            if (ref := self._contained(k)) != MISS:
                return ref
        return min((self._fuzzy(k) for k in keys if len(k) >= 4), default=(float("inf"), MISS))[1]


def map_names(values: DataFrame, reference: DataFrame, id_col: str, value_col: str) -> DataFrame:
    """id, ref_id: for each ``id_col`` whose value is neither null nor blank the entry of
    ``reference`` (ref_id, canonical, name_en, abbrev) that it means, or -1.

    Ids written again count once (of differing values the smallest); values of any length are compared whole; an
    empty reference list gives -1 throughout. The list's rows, characters and deletes are checked before they are
    sent. Each distinct value is looked up once (distinct with partial aggregation, so a hot value arrives once a
    task) and joined back; adaptive execution splits the rows of a hot value, as the other side has each value once.
    """
    spark = values.sparkSession
    rows = values.groupBy(F.col(id_col)).agg(F.min(value_col).alias("v")).where("v is not null and length(regexp_replace(v, '(?U)\\\\s', '')) > 0")
    names = ("canonical", "name_en", "abbrev")
    size = reference.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.length(c)).alias(c) for c in names]).first()
    if size["n"] > 100_000 or sum(size[c] or 0 for c in names) > 20_000_000:
        raise ValueError("the reference list is too long to broadcast; split it")
    entries = [tuple(e) for e in reference.select("ref_id", *names).collect()]
    plain = lambda c: F.regexp_replace(F.lower(fold_width(F.col(c))), r"[^\p{L}\p{N}]", "")
    keys = (reference.select("ref_id", F.explode(F.array(plain("canonical"), plain("name_en"))).alias("k")).where("k <> ''")
            .groupBy("k").agg(F.min("ref_id").alias("ref_id")))
    counted = values.select(plain(value_col).alias("k")).groupBy("k").count().join(F.broadcast(keys), "k").groupBy("ref_id").agg(F.sum("count").alias("n"))
    seen = {r["ref_id"]: r["n"] for r in counted.collect()}
    variants = simplified(spark)
    order = ReferenceIndex(entries, seen, variants, deletes=Deletes(np.int64(0).tobytes()))
    file = shared_file(spark, "deletes", Deletes.build([k for k, _ in order.names]))
    sent = spark.sparkContext.broadcast((entries, seen, variants))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = ReferenceIndex(*sent.value, deletes=Deletes.mapped(SparkFiles.get(file)))
        for p in parts:
            yield p.assign(ref_id=[index.lookup(v) for v in p["v"]])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    mapped = rows.select("v").distinct().repartition(n).mapInPandas(run, "v string, ref_id long")
    return rows.join(mapped, "v").select(F.col(id_col).alias("id"), "ref_id")
