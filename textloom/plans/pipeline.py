"""The stages from documents to a graph, each a table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import documents as D
from textloom.operators import graph as G
from textloom.operators import ner as N
from textloom.operators import relations as R
from textloom.operators import terms as T
from textloom.profile import ZH, Profile
from textloom.sources import io
from textloom.sources.store import stored

STAGES = ("preprocess", "terms", "finalize", "extract", "relation", "kg")


def dictionary(docs: DataFrame, p: Profile, k: int, id_col: str = "doc_id") -> DataFrame:
    """term, entity_type: the k best candidate terms of the documents that no rule rejects."""
    return finalized(T.extract_terms(docs, p, id_col), p, k)


def finalized(raw: DataFrame, p: Profile, k: int, replies: DataFrame | None = None) -> DataFrame:
    """term, entity_type: the k best rows of a raw term table that no rule rejects (and a review, if there is one, has)."""
    kept = T.finalize_terms(raw, p, replies).where("reject_reason is null") if p.final_noise or replies is not None else raw
    return T.top_terms(kept, k).select("term", "entity_type")


def graph(sentences: DataFrame, terms: DataFrame, p: Profile, canonical: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from sentences and a dictionary by rules; the mentions, which both need, are stored."""
    clean = stored(N.clean_mentions(N.find_mentions(sentences, terms, p), p), "mentions")
    return G.nodes(clean, canonical), G.edges(R.clean_relations(R.raw_relations(clean, p), p))


class Versions:
    """A table kept as versions below a folder: one is read until the next is written whole."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.files = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """The finished versions, the oldest first."""
        if not self.files.exists(self._path(self.root)):
            return []
        names = [x.getPath().getName() for x in self.files.listStatus(self._path(self.root))]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and self.files.exists(self._path(f"{self.root}/{n}/_SUCCESS")))

    def read(self) -> DataFrame | None:
        n = self.numbers()
        return self.spark.read.parquet(f"{self.root}/v{n[-1]}") if n else None

    def write(self, df: DataFrame) -> DataFrame:
        """A further version; the one before stays for readers that have begun, older ones go."""
        n = self.numbers()
        at = f"{self.root}/v{n[-1] + 1 if n else 0}"
        df.write.mode("overwrite").parquet(at)
        for old in n[:-1]:
            self.files.delete(self._path(f"{self.root}/v{old}"), True)
        return self.spark.read.parquet(at)


META = "id string, name string, description string, status string, entities long, relations long, documents long, error string"


@dataclass
class Catalog:
    """Graphs below a folder, with their stages' tables; a stage whose table exists is kept unless forced.

    A graph is ``empty``, then ``processing`` while it is built, then ``ready``, or ``error`` with what failed."""

    spark: SparkSession
    root: str
    profile: Profile = ZH
    dictionary_size: int = 3000
    progress: list[str] = field(default_factory=list)

    def _path(self, name: str, table: str) -> str:
        return f"{self.root}/{name}/{table}"

    def _stage(self, name: str, table: str, make: Callable[[], DataFrame], force: bool) -> DataFrame:
        io.write_once(make(), self._path(name, table), force)
        self.progress.append(table)
        return self.spark.read.parquet(self._path(name, table))

    def _set(self, name: str, **changed) -> None:
        meta = Versions(self.spark, self._path(name, "meta"))
        old = meta.read()
        row = old.first().asDict() if old is not None else {"id": name, "name": name, "description": "", "status": "empty", "entities": 0, "relations": 0, "documents": 0, "error": None}
        row = {k: v for k, v in (row | changed).items() if k not in ("created_at", "updated_at")}
        created = F.lit(old.first()["created_at"]) if old is not None else F.current_timestamp()
        meta.write(self.spark.createDataFrame([tuple(row[c.split()[0]] for c in META.split(", "))], META).coalesce(1).withColumn("created_at", created).withColumn("updated_at", F.current_timestamp()))

    def create(self, name: str, description: str = "", docs: DataFrame | None = None) -> None:
        """A graph without documents, or built from docs at once."""
        self._set(name, description=description, status="empty")
        if docs is not None:
            self.add(name, docs)

    def build(self, name: str, docs: DataFrame, force: bool = True) -> tuple[DataFrame, DataFrame]:
        """All stages over docs (doc_id, text): sentences, dictionary, mentions, relations, graph. A stage that fails leaves
        the status ``error`` and is raised."""
        p = self.profile
        self._set(name, status="processing", error=None)
        try:
            s = self._stage(name, "sentences", lambda: D.sentences(docs, p), force)
            raw = self._stage(name, "terms_raw", lambda: T.extract_terms(docs, p), force)
            terms = self._stage(name, "terms", lambda: finalized(raw, p, self.dictionary_size), force)
            m = self._stage(name, "mentions", lambda: N.clean_mentions(N.find_mentions(s, terms, p), p), force)
            r = self._stage(name, "relations", lambda: R.clean_relations(R.raw_relations(m, p), p), force)
            n = self._stage(name, "nodes", lambda: G.nodes(m), force)
            e = self._stage(name, "edges", lambda: G.edges(r), force)
            self._set(name, status="ready", error=None, **G.stats(n, e).first().asDict())
        except Exception as x:
            self._set(name, status="error", error=f"{type(x).__name__}: {x}"[:2000])
            raise
        return n, e

    def add(self, name: str, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Add documents to a graph: only those not yet in it are taken, then all stages run anew. The documents are kept as
        versions, so a crash loses none."""
        kept = Versions(self.spark, self._path(name, "documents"))
        known, new = kept.read(), docs.select("doc_id", "text")
        every = new if known is None else known.select("doc_id", "text").unionByName(new.join(known.select("doc_id"), "doc_id", "left_anti"))
        return self.build(name, kept.write(every))

    def has(self, name: str) -> bool:
        return bool(Versions(self.spark, self._path(name, "meta")).numbers())

    def meta(self, name: str) -> dict:
        """What is known of a graph; KeyError if there is none of that name."""
        got = Versions(self.spark, self._path(name, "meta")).read()
        if got is None:
            raise KeyError(name)
        return got.first().asDict()

    def list(self) -> DataFrame:
        """All graphs with status and counters, the one updated last first."""
        try:
            every = self.spark.read.parquet(f"{self.root}/*/meta/v*")
        except AnalysisException:
            return self.spark.createDataFrame([], META + ", created_at timestamp, updated_at timestamp")
        columns = [c for c in every.columns if c != "id"]
        last = every.groupBy("id").agg(F.max_by(F.struct(*columns), "updated_at").alias("x")).select("id", "x.*")
        return last.orderBy(F.col("updated_at").desc(), "name")

    def get(self, name: str) -> tuple[DataFrame, DataFrame]:
        return io.load_graph(self.spark, f"{self.root}/{name}")

    def delete(self, name: str) -> None:
        v = Versions(self.spark, f"{self.root}/{name}")
        v.files.delete(v._path(v.root), True)
