"""Evaluation texts inside a corpus (problem 9).

Latent semantic retrieval. The terms of the evaluation items (runs of letters) are looked up in all documents once
and stored as hits. Over the hits' TF-IDF passages a randomised SVD is distributed: a sketch of the range, its
orthonormal basis, the projected second moments, their decomposition, truncated. A cosine search of item passages
in the latent space gives the candidates; for each a longest common subsequence within a stretch of twice the
item decides, and where words were changed throughout (so that runs of letters break) the words in order and the
answers, the item's numbers and codes.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from textloom.llm.common import pieces, scratch, stored
from textloom.llm.script import simplified

SEP = "\x1e"
HAN_GRAM, OTHER_GRAM = 4, 9
_COMBINING = re.compile("[\u0300-\u036f\u3099\u309a]")
_WORD = re.compile(r"[^\W_]+")
_HAN_RUN = re.compile("[\u3005-\u9fff]+")


@lru_cache(maxsize=2)
def _fold_table(variants: tuple[tuple[int, int], ...] = ()) -> np.ndarray:
    """Each character's folded form, 0 for all but letters and digits."""
    to = dict(variants)
    out = np.zeros(0x10000, np.uint32)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isalnum():
            n = unicodedata.normalize("NFKC", ch).lower()
            out[c] = to.get(ord(n), ord(n)) if len(n) == 1 else c
    out[0x1E] = 0x1E
    return out


def folded(texts: list[str], table: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits of all texts in one array, in compatibility form, lower case and simplified
    script; and where each text begins in it."""
    if not texts:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    table = _fold_table() if table is None else table
    clean = [unicodedata.normalize("NFKC", t) if _COMBINING.search(t) else t for t in texts]
    c = np.frombuffer((SEP.join(t.replace(SEP, " ") for t in clean) + SEP).encode("utf-32-le", "surrogatepass"), np.uint32)
    f = np.where(c < 0x10000, table[np.minimum(c, 0xFFFF)], c)
    f = f[f > 0]
    ends = np.flatnonzero(f == 0x1E)
    return f, np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.zeros(0, np.int64)


def grams(f: np.ndarray) -> np.ndarray:
    """For each position a hash of the term that begins there: four characters of Han and kana texts, nine
    of others; -1 where it would cross the end of a text."""
    han = (f >= 0x3005) & (f <= 0x9FFF)
    x = f.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    h = np.zeros(len(f), np.uint64)
    for i in range(min(OTHER_GRAM, len(f))):
        if i == HAN_GRAM:
            short = h.copy()
        now = h[: len(f) - i]
        now += x[i:]
        now *= np.uint64(0xD6E8FEB86659FD93)
    if len(f) > HAN_GRAM:
        np.copyto(h, short, where=han)
    h ^= h >> np.uint64(29)
    h >>= np.uint64(2)
    h = h.view(np.int64)
    sep = np.flatnonzero(f == 0x1E)
    if len(sep):
        h[sep[-1] :] = -1
    else:
        sep = np.array([len(f)])
    end = np.repeat(sep, OTHER_GRAM)
    near = end - np.tile(np.arange(OTHER_GRAM), len(sep))
    end, near = end[ok := (near >= 0) & (near < len(f))], near[ok]
    h[near[near + np.where(han[near], HAN_GRAM, OTHER_GRAM) > end]] = -1
    return h


def words_of(text: str, table: np.ndarray) -> tuple[list[str], list[int], list[int]]:
    """A text's words (two neighbouring characters of Han and kana runs, else runs of letters and digits) in folded
    form, the letters each stands for, and where each begins among the text's letters."""
    out, size, at, n = [], [], [], 0
    for m in _WORD.finditer(text):
        w = m.group()
        f = table[np.minimum(np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF)]
        w = "".join(map(chr, f[f > 0].tolist()))
        i = 0
        for run in _HAN_RUN.finditer(w):
            if run.start() > i:
                out.append(w[i : run.start()])
                size.append(run.start() - i)
                at.append(n + i)
            r = run.group()
            for j in range(max(1, len(r) - 1)):
                out.append(r[j : j + 2])
                size.append(1 if j or len(r) < 2 else 2)
                at.append(n + run.start() + j)
            i = run.end()
        if i < len(w):
            out.append(w[i:])
            size.append(len(w) - i)
            at.append(n + i)
        n += len(w)
    return out, size, at


class Items:
    """The evaluation items: their terms, the terms' numbers, which items have each, blocks of them as query passages."""

    def __init__(self, ids: list[int], texts: list[str], block: int = 120, log_slots: int = 20, variants: dict[int, int] | None = None):
        self.block, self.variants = block, tuple(sorted((variants or {}).items()))
        f, starts = folded(texts, self.table)
        h = grams(f)
        ends = np.concatenate([starts[1:] - 1, [len(f) - 1]]) if len(starts) else np.zeros(0, np.int64)
        self.vocabulary = np.unique(h[h >= 0])
        self.ids, self.size, self.terms, self.texts, self.tiny = [], [], [], [], []
        for i, t, a, z in zip(ids, texts, starts, ends, strict=True):
            g = h[a:z]
            if (g >= 0).any():
                self.ids.append(i)
                self.size.append(int(z - a))
                self.terms.append(np.searchsorted(self.vocabulary, g[g >= 0]).astype(np.int32))
                self.texts.append(t)
            elif z > a:  # shorter than a term: only the whole of it can be found
                self.tiny.append((i, f[a:z].astype("<u4").tobytes().decode("utf-32-le", "replace")))
        while (1 << log_slots) < 8 * max(1, len(self.vocabulary)):
            log_slots += 1
        self.log_slots = log_slots
        self.slot = np.full((2, 1 << log_slots), -1, np.int32)
        todo = np.arange(len(self.vocabulary))
        for t in (0, 1):
            s = self._place(self.vocabulary[todo], t)
            self.slot[t][s] = todo
            todo = todo[self.slot[t][s] != todo]
        self.rest = {int(self.vocabulary[i]): int(i) for i in todo}
        self.passages = [(k, t[a : a + block]) for k, t in enumerate(self.terms) for a in range(0, max(1, len(t) - block // 3), block)]
        # Which items have each term, once for each place, as one list with its bounds by term.
        pairs = np.sort(np.concatenate([np.zeros(0, np.int64), *[(t.astype(np.int64) << 32) | k for k, t in enumerate(self.terms)]]))
        self.owner = (pairs & 0xFFFFFFFF).astype(np.int32)
        self.owned = np.searchsorted(pairs >> 32, np.arange(len(self.vocabulary) + 1))
        self._masks: dict[int, dict[int, int]] = {}
        self._words: dict[int, tuple] = {}
        self._own: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    @property
    def table(self) -> np.ndarray:
        return _fold_table(self.variants)

    def choose(self, count: np.ndarray, part: float) -> np.ndarray:
        """The terms that span the latent space: of each passage's different terms that documents have at all the ``part`` that
        the fewest have, so that a passage keeps coordinates however often it leaked."""
        out = np.zeros(len(self.vocabulary), bool)
        for _, t in self.passages:
            u = np.unique(t)
            u = u[count[u] > 0]
            out[u[np.argsort(count[u], kind="stable")[: math.ceil(part * len(u))]]] = True
        return out

    def _place(self, h: np.ndarray, t: int) -> np.ndarray:
        y = h.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F if t == 0 else 0x165667B19E3779F9)
        y >>= np.uint64(64 - self.log_slots)
        return y.view(np.int64)

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where terms of items stand among terms, and the numbers of these. A term that isn't in the first table lost its
        place there to another one, so an empty place means no item's term."""
        if not len(self.vocabulary):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        a = self.slot[0][self._place(h, 0)]
        at = np.flatnonzero(a >= 0)
        term, h = a[at], h[at]
        other = np.flatnonzero(self.vocabulary[term] != h)
        h = h[other]
        b = self.slot[1][self._place(h, 1)]
        b[self.vocabulary[b] != h] = -1
        for value, i in self.rest.items():
            b[h == value] = i
        term[other] = b
        some = term >= 0
        return at[some], term[some]

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each term, -1 for terms of no item."""
        out = np.full(len(h), -1, np.int32)
        at, term = self.places(h)
        out[at] = term
        return out

    @property
    def number(self) -> np.dtype:
        """The type of a stored term's number."""
        return np.dtype(np.uint16 if len(self.vocabulary) <= 1 << 16 else np.int32)

    def held(self, term: np.ndarray) -> np.ndarray:
        """How many places of each item have one of these (different) terms: no common subsequence is longer."""
        return np.bincount(self.owner[self.posting(term)[1]], minlength=len(self.ids))

    def posting(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many places of items have each term, and where their owners stand in the list of owners."""
        n = self.owned[term + 1] - self.owned[term]
        return n, np.repeat(self.owned[term] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))

    def has(self, k: int) -> np.ndarray:
        """The numbers of item k's different terms, in order."""
        return self._counted(k)[0]

    def _counted(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self._own:
            self._own[k] = np.unique(self.terms[k], return_counts=True)
        return self._own[k]

    def at_most(self, k: int, seq: np.ndarray) -> int:
        """A bound of the common subsequence of item k and a sequence of its terms: its places that have one of them."""
        own, times = self._counted(k)
        there = np.zeros(len(own), bool)
        there[np.searchsorted(own, seq)] = True
        return int(times[there].sum())

    def common(self, k: int, seq: np.ndarray) -> int:
        """Length of the longest common subsequence of item k's terms and a sequence of terms (bit-parallel)."""
        masks = self._masks.get(k)
        if masks is None:
            masks = {}
            for i, t in enumerate(self.terms[k].tolist()):
                masks[t] = masks.get(t, 0) | (1 << i)
            self._masks[k] = masks
        v = full = (1 << len(self.terms[k])) - 1
        for m in map(masks.get, seq.tolist(), repeat(0)):
            u = v & m
            if u:
                v = ((v + u) | (v - u)) & full
        return len(self.terms[k]) - v.bit_count()

    def reworded(self, k: int, text: tuple[list[str], list[int], list[int]], start: int) -> float:
        """The share of item k's letters whose words stand in order in the stretch of a text (its ``words_of``) from letter
        ``start`` on, twice the item long; 0 below one half, and if fewer than four in five of its answers (numbers and
        codes) stand there."""
        if k not in self._words:
            words, size, _ = words_of(self.texts[k], self.table)
            weight: dict[str, int] = {}
            for w, n in zip(words, size, strict=True):
                weight[w] = weight.get(w, 0) + n
            self._words[k] = words, size, weight, {w for w in words if any(c.isdigit() for c in w)}
        words, size, weight, answers = self._words[k]
        got = text[0][bisect_left(text[2], start) : bisect_left(text[2], start + 2 * self.size[k])]
        there, total = set(got), sum(size)
        if len(answers & there) < 0.8 * len(answers) or sum(weight[w] for w in there if w in weight) < 0.5 * total:
            return 0.0
        best = [0] * (len(words) + 1)  # heaviest common subsequence with the words of the stretch so far
        for w in got:
            if w in weight:
                before = 0
                for j, x in enumerate(words):
                    old = best[j + 1]
                    best[j + 1] = max(old, best[j], before + size[j] if x == w else 0)
                    before = old
        return best[-1] / total if best[-1] >= 0.5 * total else 0.0


def windows(starts: np.ndarray, ends: np.ndarray, size: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start and end of the passages of all texts."""
    n = np.maximum(1, np.ceil((ends - starts - size) / step).astype(np.int64) + 1)
    doc = np.repeat(np.arange(len(starts)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    a = starts[doc] + k * step
    return doc, a, np.minimum(a + size, ends[doc])


def _distinct(x: np.ndarray) -> np.ndarray:
    """The different numbers in order; by sorting, which is faster here than by hashing."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _sums(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Sum of rows[lo:hi] for each pair."""
    if not len(rows):
        return np.zeros((len(lo), rows.shape[1]), np.float32)
    total = np.add.reduceat(np.concatenate([rows, np.zeros((1, rows.shape[1]), rows.dtype)]), np.stack([lo, hi], 1).ravel().clip(max=len(rows)), axis=0)[::2]
    total[lo >= hi] = 0
    return total


HITS, NAMES = "what string, number array<int>, times array<int>, text string, at binary, term binary", ["d", "what", "number", "times", "text", "at", "term"]


def _packed(x: np.ndarray, first: np.ndarray) -> pa.Array:
    """An array, cut before each of ``first``, as the bytes of its pieces: lists of numbers pass through Spark number by
    number, bytes as they are."""
    cut = (np.append(first, len(x)) * x.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(cut), pa.py_buffer(x)])


def _unpacked(c: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all pieces, and where each begins and the last ends."""
    _, cut, data = c.buffers()
    cut = np.frombuffer(cut, np.int32)[c.offset : c.offset + len(c) + 1].astype(np.int64)
    return np.frombuffer(data, kind, int(cut[-1] - cut[0]) // kind.itemsize, int(cut[0])), (cut - cut[0]) // kind.itemsize


def item_hits(docs: DataFrame, id_col: str, text_col: str, sent, doubtful: float) -> DataFrame:
    """d, what, number, times, text, at, term. A row ``hits`` has a document's places (among its letters, each as the
    distance from the one before) at which a term of an item begins and the terms' numbers, both as bytes, of the documents
    that have any; ``text`` goes with those that have terms of ``doubtful`` of some item's places, for the check of words.
    A row ``tiny`` has the numbers of tiny items that stand in the document whole. A row ``count``, one a task, has how
    many documents (times) have each term (number)."""
    kind, id_type = docs.schema[id_col].dataType.simpleString(), to_arrow_type(docs.schema[id_col].dataType)
    ints, no_hits = pa.list_(pa.int32()), [pa.nulls(1, pa.string()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = sent.value
        n_terms, n_items = len(items.vocabulary), len(items.ids)
        most, count = np.array([len(t) for t in items.terms]), np.zeros(n_terms, np.int64)
        for batch in (b.slice(a, 512) for b in batches for a in range(0, b.num_rows, 512)):
            every = batch.column(1).to_pylist()
            for i, j in pieces(every, chars=500_000):
                rows = np.array([n for n in range(i, j) if every[n]], np.int64)
                f, starts = folded([every[n] for n in rows], items.table)
                if not len(f):
                    continue
                ends = np.concatenate([starts[1:] - 1, [len(f) - 1]])
                at, term = items.places(grams(f))
                if len(at):
                    cut = np.searchsorted(at, np.append(starts, len(f)))
                    size = np.diff(cut)
                    pair = _distinct(np.repeat(np.arange(len(rows)), size) << 32 | term)  # each term once a document
                    d, t = pair >> 32, pair & 0xFFFFFFFF
                    count += np.bincount(t, minlength=n_terms)
                    n, place = items.posting(t)
                    held = np.bincount(np.repeat(d * n_items, n) + items.owner[place], minlength=len(rows) * n_items).reshape(len(rows), n_items)
                    carry = (held >= doubtful * most).any(1)
                    some = np.flatnonzero(size)
                    first, gap = cut[some], np.diff(at, prepend=0)
                    gap[first] = at[first] - starts[some]
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(rows[some])), pa.array(["hits"] * len(some)), pa.nulls(len(some), ints), pa.nulls(len(some), ints),
                        pa.array([every[rows[x]] if carry[x] else None for x in some.tolist()], pa.string()), _packed(gap.astype(np.int32), first), _packed(term.astype(items.number), first)], NAMES)
                if items.tiny:
                    for n, a, z in zip(rows.tolist(), starts, ends, strict=True):
                        letters = f[a:z].astype("<u4").tobytes().decode("utf-32-le", "replace")
                        found = [m for m, (_, w) in enumerate(items.tiny) if w in letters]
                        if found:
                            yield pa.RecordBatch.from_arrays([batch.column(0).slice(n, 1), pa.array(["tiny"]), pa.array([found], ints), pa.nulls(1, ints), *no_hits], NAMES)
        seen = np.flatnonzero(count).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, id_type), pa.array(["count"]), pa.array([seen], ints), pa.array([count[seen].astype(np.int32)], ints), *no_hits], NAMES)

    return docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).where("t is not null").mapInArrow(run, f"d {kind}, {HITS}")


def _batches(parts: Iterator[pa.RecordBatch], number: np.dtype, hits: int = 150_000) -> Iterator[tuple]:
    """Of runs of documents: the batch's rows a to z, places and terms of all one after the other, and where each
    document begins and ends among the places. The last two columns are at and term, none of them empty."""
    for p in parts:
        if not p.num_rows:
            continue
        (gap, cut), (term, _) = _unpacked(p.column(p.num_columns - 2), np.dtype(np.int32)), _unpacked(p.column(p.num_columns - 1), number)
        a = 0
        while a < p.num_rows:
            z = max(a + 1, int(np.searchsorted(cut, cut[a] + hits, "right")) - 1)
            first, at = cut[a:z] - cut[a], gap[cut[a] : cut[z]].astype(np.int64)
            into = at[first]
            at[first[1:]] += 2  # a document begins two places after the last of the one before
            at = np.cumsum(at)
            yield p, a, z, at, term[cut[a] : cut[z]].astype(np.int64), at[first] - into, at[np.append(first[1:], len(at)) - 1] + 1
            a = z


def sketch(hits: DataFrame, sent, spans: np.ndarray, dims: int, seed: int = 11, width: int = 256) -> tuple[np.ndarray, np.ndarray, int]:
    """Passages that hold each term that ``spans`` the space, the summed sketch T'(T R) over all passages for a random
    matrix R, and the number of passages. A task hands on the rows of the terms it has seen, in blocks of ``width`` terms; the
    blocks are shuffled by number and summed one by one as they arrive in order, so nothing is gathered."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = sent.value
        n_terms = len(items.vocabulary)
        r = np.random.default_rng(seed).standard_normal((n_terms, dims)).astype(np.float32)
        df, g, n = np.zeros(n_terms + width, np.int64), np.zeros((n_terms + width, dims), np.float32), 0
        size = 2 * items.block
        for _, _, _, at, term, starts, ends in _batches(parts, items.number):
            _, a, z = windows(starts, ends, size, size)
            n += len(a)
            at, term = at[spans[term]], term[spans[term]]
            w = np.searchsorted(a, at, "right") - 1
            key = _distinct(w << 32 | term)  # each term once a passage
            w, term = key >> 32, key & 0xFFFFFFFF
            lo = np.searchsorted(w, np.arange(len(a)))
            y = _sums(r[term], lo, np.append(lo[1:], len(w)))
            order = np.argsort(term, kind="stable")
            t, first, count = np.unique(term[order], return_index=True, return_counts=True)
            df[t] += count
            g[t] += np.add.reduceat(y[w[order]], first, axis=0)
        some = [-1, *np.unique(np.flatnonzero(df) // width).tolist()]
        for i in range(0, len(some), 32):
            cuts = [(b, slice(b * width, (b + 1) * width)) for b in some[i : i + 32]]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in cuts], pa.int32()), pa.array([df[c].tobytes() if b >= 0 else np.int64(n).tobytes() for b, c in cuts], pa.binary()),
                                              pa.array([g[c].tobytes() if b >= 0 else b"" for b, c in cuts], pa.binary())], ["b", "df", "g"])

    def add(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, d, g = None, None, None
        for p in parts:
            for b, x, y in zip(p["b"], p["df"], p["g"], strict=True):
                x, y = np.frombuffer(x, np.int64), np.frombuffer(y, np.float32)
                if b == now:
                    d, g = d + x, g + y
                    continue
                if now is not None:
                    yield pd.DataFrame({"b": [now], "df": [d.tobytes()], "g": [g.tobytes()]})
                now, d, g = b, x, y
        if now is not None:
            yield pd.DataFrame({"b": [now], "df": [d.tobytes()], "g": [g.tobytes()]})

    schema = "b int, df binary, g binary"
    n_terms, n = len(sent.value.vocabulary), 0
    df, g = np.zeros(n_terms + width, np.int64), np.zeros((n_terms + width, dims), np.float32)
    partial = hits.select("at", "term").mapInArrow(run, schema)
    for r in partial.repartition("b").sortWithinPartitions("b").mapInPandas(add, schema).collect():
        if r["b"] < 0:
            n = int(np.frombuffer(r["df"], np.int64)[0])
        else:
            cut = slice(r["b"] * width, (r["b"] + 1) * width)
            df[cut], g[cut] = np.frombuffer(r["df"], np.int64), np.frombuffer(r["g"], np.float32).reshape(-1, dims)
    return df[:n_terms], g[:n_terms], n


def decompose(hits: DataFrame, sent, spans: np.ndarray, df: np.ndarray, g: np.ndarray, n: int, rank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term weights, the ``rank`` right singular vectors and the singular values of the TF-IDF passages.

    With X = T diag(idf), the range of X'X W for the random W = diag(1/idf) R is that of diag(idf) T'T R, the
    sketch; Q is its orthonormal basis. A second pass over the hits sums the small matrix (X Q)'(X Q), whose
    eigenvectors turn Q into the singular vectors; those beyond ``rank`` (the oversampling) are cut off.
    """
    idf = np.log((1.0 + n) / (1.0 + df)).astype(np.float32) + 1e-3
    q, _ = np.linalg.qr((g * idf[:, None]).astype(np.float64))
    basis = hits.sparkSession.sparkContext.broadcast((q * idf[:, None]).astype(np.float32))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = sent.value
        qs = basis.value
        size = 2 * items.block
        total = np.zeros((qs.shape[1],) * 2)
        for _, _, _, at, term, starts, ends in _batches(parts, items.number):
            _, a, _ = windows(starts, ends, size, size)
            at, term = at[spans[term]], term[spans[term]]
            w = np.searchsorted(a, at, "right") - 1
            key = _distinct(w << 32 | term)
            lo = np.searchsorted(key >> 32, np.arange(len(a)))
            y = _sums(qs[key & 0xFFFFFFFF], lo, np.append(lo[1:], len(key))).astype(np.float64)
            total += y.T @ y
        i, j = np.divmod(np.arange(total.size), total.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], ["i", "j", "v"])

    moments = np.zeros((q.shape[1],) * 2)
    for r in hits.select("at", "term").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        moments[r["i"], r["j"]] = r["v"]
    values, turn = np.linalg.eigh(moments)
    keep = np.argsort(-values)[:rank]
    keep = keep[values[keep] > 1e-9 * max(1e-300, values.max(initial=0))]
    return idf, (q @ turn[:, keep]).astype(np.float32), np.sqrt(values[keep])


def _best(items: Items, k: int, seq: np.ndarray, reach: np.ndarray, need: float, least: float) -> int:
    """The common subsequence of item k and the first stretch seq[s : reach[s]] found to have ``need`` terms of it,
    or the best one below ``need`` that has ``least``: the fullest stretch is tried first, then all from left to right.
    A start adds no terms but those its stretch reaches further, so starts that can't make up for what lacks are skipped."""
    held = reach - np.arange(len(reach))
    s = int(held.argmax())
    best = items.common(k, seq[s : reach[s]]) if items.at_most(k, seq[s : reach[s]]) >= least else 0
    s = 0
    while best < need and s < len(seq):
        aim = need if best >= least else least
        if held[s] < aim:
            s += int(np.argmax(held[s:] >= aim)) or len(seq)
            continue
        got = items.at_most(k, seq[s : reach[s]])  # no fewer than the common ones
        if got >= aim:
            got = items.common(k, seq[s : reach[s]])
            best = max(best, got)
        aim = need if best >= least else least
        s = max(s + 1, int(np.searchsorted(reach, reach[s] + math.ceil(aim - got))))
    return best


def search(hits: DataFrame, sent, space, kind: str, item_kind: str, item_type, share: float, cosine: float, doubtful: float) -> DataFrame:
    """d, k, share of the pairs the cosine search finds and the checks confirm."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it: Items = sent.value
        spans, weights, qs, own = space.value
        size, need_of = 2 * it.block, np.array([len(t) for t in it.terms])
        holds, there, mine = np.zeros(0, np.int64), *np.zeros((2, len(it.vocabulary)), bool)
        for batch, row, _, at, term, starts, ends in _batches(parts, it.number):
            ids, texts, found = batch.column(0), batch.column(2), []
            doc, a, z = windows(starts, ends, size, it.block)
            at_l, term_l = at[spans[term]], term[spans[term]]
            lo, hi = np.searchsorted(at_l, a), np.searchsorted(at_l, z)
            some = np.flatnonzero(hi > lo)
            pairs: list[np.ndarray] = []
            for s in range(0, len(some), 4096):
                pick = some[s : s + 4096]
                b0, b1 = int(lo[pick].min()), int(hi[pick].max())
                v = _sums(weights[term_l[b0:b1]], lo[pick] - b0, hi[pick] - b0)
                v /= np.linalg.norm(v, axis=1, keepdims=True) + 1e-9
                w, c = np.nonzero(v @ qs.T >= cosine)
                pairs.append(_distinct(doc[pick[w]].astype(np.int64) << 32 | own[c]))
            bounds, of, read = np.searchsorted(at, np.stack([starts, ends])), -1, (-1, None)
            for pair in _distinct(np.concatenate([np.zeros(0, np.int64), *pairs])).tolist():
                d, k = pair >> 32, pair & 0xFFFFFFFF
                x0, x1 = bounds[:, d]
                if of != d:
                    there[holds] = False
                    of, holds, text = d, term[x0:x1], texts[row + d].as_py()
                    there[holds] = True
                need, n = share * need_of[k], int(need_of[k])
                least = need if text is None else doubtful * n
                if np.count_nonzero(there[it.terms[k]]) < least:  # no common subsequence is longer
                    continue
                mine[it.has(k)] = True
                inside = mine[term[x0:x1]]
                mine[it.has(k)] = False
                pos, seq = at[x0:x1][inside], term[x0:x1][inside]
                reach = np.searchsorted(pos, pos + 2 * it.size[k])
                full = reach - np.arange(len(reach))
                best = _best(it, k, seq, reach, need, least) if full.max() >= least else 0
                if best >= need:
                    found.append((row + d, k, best / n))
                elif best >= doubtful * n:  # words in order, around each stretch that is as full as any near it
                    if read[0] != d:
                        read = d, words_of(text, it.table)
                    tops = np.flatnonzero(full >= doubtful * n)
                    same, last = 0.0, -it.size[k]
                    for s in tops.tolist():
                        first = int(pos[s] - starts[d])
                        if first - last >= it.size[k] // 2:
                            last = first
                            same = max(same, *(it.reworded(k, read[1], max(0, first - back)) for back in (0, it.size[k] // 2)))
                    if same:
                        found.append((row + d, k, same))
            if found:
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([x[0] for x in found])), pa.array([it.ids[x[1]] for x in found], item_type), pa.array([float(x[2]) for x in found])], ["d", "k", "share"])

    def tiny(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it: Items = sent.value
        for p in parts:
            lists = p.column(1).to_pylist()
            rows, which = [i for i, x in enumerate(lists) for _ in x], [it.tiny[m][0] for x in lists for m in x]
            yield pa.RecordBatch.from_arrays([p.column(0).take(pa.array(rows, pa.int64())), pa.array(which, item_type), pa.array([1.0] * len(rows))], ["d", "k", "share"])

    schema = f"d {kind}, k {item_kind}, share double"
    got = hits.where("what = 'hits'").select("d", "what", "text", "at", "term").mapInArrow(run, schema)
    return got.unionByName(hits.where("what = 'tiny'").select("d", "number").mapInArrow(tiny, schema)) if sent.value.tiny else got


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               share: float = 0.4, cosine: float = 0.5, rank: int = 64, oversampling: int = 16, part: float = 1 / 3, doubtful: float = 0.3,
               block_chars: int = 1_000_000) -> DataFrame:
    """``id_col``, ``item_col`` and share (of the item's terms in order, in one stretch of twice the item).

    ``share`` of the terms stands for half of the letters: a changed character breaks several terms. Pairs with less
    than that, but ``doubtful`` of the terms, are compared by words and answers. ``part`` of each passage's terms, the
    rarest, span the latent space (of ``rank`` dimensions); the subsequences are of all terms.
    Null and empty texts hold nothing; items without a letter are no items, items shorter than one term are found
    where they stand whole; repeated rows and copies each come out; an empty table gives an empty result. Items are
    taken in blocks of about ``block_chars`` characters, which bounds what is broadcast (terms x rank numbers);
    documents are read where they are and never shuffled, so no source or group of copies is hot.
    """
    spark = docs.sparkSession
    wanted = items.where(F.col(text_col).isNotNull()).select(F.col(item_col), F.col(text_col).alias("t")).distinct()
    total = wanted.agg(F.sum(F.length("t"))).first()[0] or 0
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    variants, blocks, found = simplified(spark), max(1, math.ceil(total / block_chars)), []
    for b in range(blocks):
        got = sorted(map(tuple, (wanted.where(F.pmod(F.xxhash64(item_col), F.lit(blocks)) == b) if blocks > 1 else wanted).collect()))
        index = Items([r[0] for r in got], [r[1] for r in got], variants=variants)
        if not index.ids and not index.tiny:
            continue
        sent = spark.sparkContext.broadcast(index)
        hits = stored(item_hits(docs, id_col, text_col, sent, doubtful), scratch(spark, "hits"), block=16 << 20)
        count = np.zeros(len(index.vocabulary), np.int64)
        for r in hits.where("what = 'count'").select(F.explode(F.arrays_zip("number", "times")).alias("x")).groupBy("x.number").agg(F.sum("x.times").alias("n")).collect():
            count[r["number"]] = r["n"]
        spans, long = index.choose(count, part), hits.where("what = 'hits'")
        df, g, n = sketch(long, sent, spans, rank + oversampling)
        idf, vectors, _ = decompose(long, sent, spans, df, g, n, rank)
        weighted = np.where(spans[:, None], vectors * idf[:, None], np.float32(0))
        queries = np.stack([weighted[np.unique(t)].sum(0) for _, t in index.passages]) if index.passages else np.zeros((0, weighted.shape[1]), np.float32)
        queries /= np.linalg.norm(queries, axis=1, keepdims=True) + 1e-9
        space = spark.sparkContext.broadcast((spans, weighted, queries.astype(np.float32), np.array([k for k, _ in index.passages], np.int64)))
        found.append(stored(search(hits, sent, space, kind, item_kind, to_arrow_type(items.schema[item_col].dataType), share, cosine, doubtful), scratch(spark, "leaks")))
    if not found:
        return spark.createDataFrame([], f"{id_col} {kind}, {item_col} {item_kind}, share double")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.select(F.col("d").alias(id_col), F.col("k").alias(item_col), "share")
