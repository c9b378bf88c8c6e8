"""A corpus as token ids of a public byte-level BPE (problem 8).

Frequent words are compiled with their ids into a minimal acyclic transducer: states with equal
futures are shared, and the ids sit as outputs on the arcs (the ordinal of a word is the sum of
the arc counts on its path, and the ordinal selects its ids). The arrays are one file that the
workers of a machine map into memory. Words outside the lexicon are merged exactly.
"""

from __future__ import annotations

import base64
import mmap
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import shared_file

# The split of the public byte-level BPE vocabularies into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_word(ranks: dict[bytes, int], word: bytes) -> list[int]:
    """Ids of one word: the neighbouring pair of lowest rank is merged until none is left."""
    if word in ranks:
        return [ranks[word]]
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        if not found:
            break
        r, _ = min(found)
        out, i = [], 0
        while i < len(parts):
            if i + 1 < len(parts) and ranks.get(parts[i] + parts[i + 1]) == r:
                out.append(parts[i] + parts[i + 1])
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return [ranks[p] for p in parts]


class Lexicon:
    """Minimal acyclic transducer over bytes, as a double array.

    The arc of state s with byte c is at slot ``base[s] + c`` if ``check`` there is s; ``target`` is
    the next state and ``skip`` how many words of s come before the arc. ``final[s]`` tells whether
    a word ends in s; the sum of the skips is the word's number, ``start`` has where its ids begin.
    The last state is the root.
    """

    NAMES = ("base", "check", "target", "skip", "final", "start", "ids")

    def __init__(self, buf):
        self.buf = memoryview(buf)
        sizes = self.buf[: 8 * len(self.NAMES)].cast("q").tolist()
        at, self.views = 8 * len(self.NAMES), []
        for size in sizes:
            self.views.append(self.buf[at : at + 4 * size].cast("i"))
            at += 4 * size
        self.base, self.check, self.target, self.skip, self.final, self.start, self.ids = self.views
        self.root = len(self.base) - 1

    @classmethod
    def build(cls, words: Iterable[tuple[bytes, list[int]]]) -> Lexicon:
        """From words in byte order, each once (incremental construction with a register)."""
        register: dict[tuple, int] = {}
        states: list[tuple] = []  # (final, ((label, target), ...)), children before parents
        count: list[int] = []
        starts, ids = [0], []
        path: list[list] = [[False, []]]  # of the last word: final flag and frozen arcs
        last = b""

        def freeze(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if (s := register.get(key)) is None:
                s = register[key] = len(states)
                states.append(key)
                count.append(int(node[0]) + sum(count[t] for _, t in node[1]))
            return s

        for word, out in words:
            if starts[-1] and word <= last:
                raise ValueError("words must ascend")
            keep = 0
            while keep < min(len(word), len(last)) and word[keep] == last[keep]:
                keep += 1
            while len(path) - 1 > keep:
                node = path.pop()
                path[-1][1].append((last[len(path) - 1], freeze(node)))
            for _ in word[keep:]:
                path.append([False, []])
            path[-1][0] = True
            last = word
            ids.extend(out)
            starts.append(len(ids))
        while len(path) > 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(node)))
        register.clear()
        freeze(path[0])
        size = 2 * (sum(len(arcs) for _, arcs in states) + 512)
        check, target, skip, base, low = [-1] * size, [0] * size, [0] * size, [0] * len(states), 256
        tried: dict[int, int] = {}  # where the search for that many arcs has come to
        for s in sorted(range(len(states)), key=lambda s: -len(states[s][1])):  # wide states first
            final, arcs = states[s]
            if not arcs:
                break
            f = tried.get(len(arcs), low)
            while check[f] >= 0 or any(check[f - arcs[0][0] + c] >= 0 for c, _ in arcs):
                f += 1
                if f + 512 > len(check):
                    check += [-1] * size
                    target += [0] * size
                    skip += [0] * size
            tried[len(arcs)] = f
            base[s] = f - arcs[0][0]
            before = int(final)
            for c, t in arcs:
                check[base[s] + c], target[base[s] + c], skip[base[s] + c] = s, t, before
                before += count[t]
        made = (base, check, target, skip, [int(s[0]) for s in states], starts, ids)
        head = np.asarray([len(x) for x in made], np.int64).tobytes()
        return cls(head + b"".join(np.asarray(x, np.int32).tobytes() for x in made))

    def find(self, word: bytes) -> list[int] | None:
        base, check, target, skip = self.base, self.check, self.target, self.skip
        s, n = self.root, 0
        for c in word:
            i = base[s] + c
            if check[i] != s:
                return None
            n += skip[i]
            s = target[i]
        if not self.final[s]:
            return None
        return self.ids[self.start[n] : self.start[n + 1]].tolist()

    def __len__(self) -> int:
        return len(self.start) - 1

    def to_bytes(self) -> bytes:
        return bytes(self.buf)

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))


def word_counts(texts: DataFrame, text_col: str = "text", per_task: int = 100_000) -> DataFrame:
    """word, n: how often each word occurs that is frequent in some task's share of the texts.

    Counted as the texts are read; a task hands on its ``per_task`` most frequent words, so a
    shuffle carries at most that many a task, however large the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = regex.compile(PATTERN), {}
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    for w in split.findall(t):
                        seen[w] = seen.get(w, 0) + 1
            if len(seen) > 20 * per_task:
                seen = dict(sorted(seen.items(), key=lambda x: -x[1])[: 10 * per_task])
        best = sorted((x for x in seen.items() if x[1] > 1), key=lambda x: -x[1])[:per_task]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in best], pa.string()), pa.array([n for _, n in best], pa.int64())], ["word", "n"])

    return (texts.select(F.col(text_col).alias("t")).mapInArrow(run, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def build_lexicon(texts: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, size: int = 50_000, longest: int = 48) -> Lexicon:
    """The ``size`` most frequent words of the texts (at most ``longest`` bytes) with their ids."""
    ranks = load_ranks(vocabulary)
    top = (word_counts(texts, text_col).where(F.octet_length("word") <= longest)
           .orderBy(F.col("n").desc(), "word").limit(size).select("word").collect())
    words = sorted(r["word"].encode() for r in top)
    return Lexicon.build((w, merge_word(ranks, w)) for w in words)


def encode(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
           lexicon: Lexicon | None = None, memo: int = 400_000) -> DataFrame:
    """``id_col`` and ids ARRAY<INT>: every row's text by the byte-level BPE of ``vocabulary``.

    No special tokens: strings that look like one are ordinary text. Null and empty texts give an
    empty list. Whole texts; a very long one is one list. Repeated rows are encoded again each.
    The lexicon file (a few MB, by its ``size``) goes to each executor once and is memory-mapped;
    each worker remembers up to ``memo`` words. ``vocabulary`` must be readable on the executors.
    """
    spark: SparkSession = texts.sparkSession
    lexicon = build_lexicon(texts, text_col, vocabulary) if lexicon is None else lexicon
    name = shared_file(spark, "lexicon", lexicon.to_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = load_ranks(vocabulary)
        merge = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        lex, split, known = Lexicon.mapped(SparkFiles.get(name)), regex.compile(PATTERN), {}

        def ids_of(word: str) -> list[int]:
            raw = word.encode("utf-8", "replace")
            hit = lex.find(raw)
            return merge(raw) if hit is None else hit

        for b in batches:
            ids, at = b.column(0), 0
            flat: list[int] = []
            ends = [0]
            for i, t in enumerate(b.column(1).to_pylist()):
                for w in split.findall(t) if t else ():
                    if (x := known.get(w)) is None:
                        x = known[w] = ids_of(w)
                    flat += x
                ends.append(len(flat))
                if i + 1 == b.num_rows or i + 1 - at >= 512 or len(flat) > 1_000_000:  # very long texts go out at once
                    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.int32)))
                    yield pa.RecordBatch.from_arrays([ids.slice(at, i + 1 - at), lists], ["id", "ids"])
                    at, flat, ends = i + 1, [], [0]
                    if len(known) > memo:
                        known.clear()

    kind = texts.schema[id_col].dataType.simpleString()
    return (texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col))
