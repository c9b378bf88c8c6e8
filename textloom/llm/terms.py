"""Term statistics of a collection (problems 1 and 3).

``TermLedger`` keeps per-term counts that grow by signed deltas; ``distinctive_terms``
weighs the terms of each record against the rest of the collection.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import normal_term, scratch, stored

ROWS = T.StructType([
    T.StructField("term_id", T.LongType()), T.StructField("doc_id", T.StringType()),
    T.StructField("term", T.StringType()), T.StructField("freq", T.LongType()),
])


def term_rows(terms: DataFrame) -> DataFrame:
    """One row per ``term_id`` with its term in normal form.

    Repeated rows count once (of differing ones the earliest loaded, then the smallest), null or
    blank terms are left out, a null freq counts 1, a null doc_id stays a file of its own.
    An empty table gives an empty result; further columns are ignored.
    """
    first = F.struct(*[F.col(c) for c in ("loaded_at",) if c in terms.columns], "doc_id", "term", "freq")
    return (
        terms.select("term_id", first.alias("r"))
        .groupBy("term_id").agg(F.min("r").alias("r"))
        .select("term_id", F.coalesce("r.doc_id", F.lit("")).alias("doc_id"),
                normal_term(F.col("r.term")).alias("term"),
                F.coalesce(F.col("r.freq"), F.lit(1)).cast("long").alias("freq"))
        .where("term is not null and term <> ''")
    )


class TermLedger:
    """Persistent counts of every distinct term, kept up by signed deltas.

    Layout below ``path``: ``rows`` (the records as last counted), ``pairs`` (term and file) and ``counts`` (term),
    each cut into buckets by a hash of its whole key (so the pairs of a term that every file has spread evenly), one
    folder per version and bucket; ``manifest`` says which version of a bucket holds. ``apply`` aggregates only the
    records that were added, changed or deleted, merges the signed changes into the buckets they touch and writes
    these; all other buckets stay as they are. The number of buckets follows the ledger's size: once one would hold
    more than ``bucket_rows`` rows on average, the next apply writes all of it in four times as many. A version counts
    once its manifest is written, so a failed apply changes nothing and can be repeated.
    """

    KEYS = {"rows": ["term_id"], "pairs": ["term", "doc_id"], "counts": ["term"]}
    SCHEMAS = {
        "rows": "term_id long, doc_id string, term string, freq long",
        "pairs": "term string, doc_id string, occ long, n_rows long",
        "counts": "term string, freq long, files long",
    }
    MANIFEST = "kind string, bucket int, version int, filled boolean, buckets int, size long"

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, bucket_rows: int = 1_000_000):
        self.spark, self.path, self.first, self.bucket_rows = spark, path.rstrip("/"), buckets, bucket_rows

    def _bucket(self, kind: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.KEYS[kind]), F.lit(buckets)).cast("int")

    def _manifest(self) -> tuple[int, int, int, dict[tuple[str, int], int]]:
        """The last version, the number of buckets, the rows in the largest bucket and (table, bucket) -> version of the filled ones."""
        try:
            m = self.spark.read.schema(self.MANIFEST).parquet(f"{self.path}/manifest")
            last = m.groupBy("kind", "bucket").agg(F.max(F.struct("version", "filled", "buckets", "size")).alias("v")).collect()
        except AnalysisException:
            last = []
        if not last:
            return -1, self.first, 0, {}
        top = max(last, key=lambda r: r.v.version)
        live = [r for r in last if r.v.buckets == top.v.buckets]
        return top.v.version, top.v.buckets, max(r.v["size"] for r in live), {(r.kind, r.bucket): r.v.version for r in live if r.v.filled}

    def _read(self, kind: str, live: dict[tuple[str, int], int], only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/{kind}/v{v}/bucket={b}" for (k, b), v in live.items() if k == kind and (only is None or b in only)]
        if not paths:
            return self.spark.createDataFrame([], self.SCHEMAS[kind])
        return self.spark.read.schema(self.SCHEMAS[kind]).parquet(*paths)

    def apply(self, records: DataFrame | None = None, deleted: DataFrame | None = None) -> None:
        """Count added and changed ``records`` (columns of terms_clean) and forget ``deleted`` (term_id); a record that is
        both is forgotten. An empty ledger is no special case."""
        version, buckets, largest, live = self._manifest()
        version, grown = version + 1, buckets
        while largest > self.bucket_rows:
            grown, largest = 4 * grown, largest // 4
        anew = grown != buckets or not live  # all buckets are written

        def touched(df: DataFrame, *kinds: str) -> list[set[int] | None]:
            if anew:
                return [None] * len(kinds)
            both = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), self._bucket(k, buckets).alias("b")) for k in kinds])).alias("x")
            got = [(r.k, r.b) for r in df.select(both).select("x.*").distinct().collect()]
            return [{b for k, b in got if k == kind} for kind in kinds]

        ids = self.spark.createDataFrame([], "term_id long")
        new = self.spark.createDataFrame([], ROWS)
        if records is not None:
            new, ids = term_rows(records), records.select(F.col("term_id").cast("long")).distinct()
        if deleted is not None:
            gone = deleted.select(F.col("term_id").cast("long")).distinct()
            new, ids = new.join(gone, "term_id", "left_anti"), ids.union(gone).distinct()
        (touched_r,) = touched(ids, "rows")
        before = self._read("rows", live, touched_r)
        signed = (before.join(ids, "term_id", "left_semi").withColumn("sign", F.lit(-1).cast("long"))
                  .unionByName(new.withColumn("sign", F.lit(1).cast("long"))))
        delta = signed.groupBy("term", "doc_id").agg(F.sum(F.col("sign") * F.col("freq")).alias("occ"), F.sum("sign").alias("n_rows")).where("occ <> 0 or n_rows <> 0")
        delta = stored(delta, f"{self.path}/delta/v{version}")
        touched_p, touched_c = touched(delta, "pairs", "counts")
        zero = F.lit(0).cast("long")
        both = (
            self._read("pairs", live, touched_p).select("term", "doc_id", "occ", "n_rows", zero.alias("o"), zero.alias("r"))
            .unionByName(delta.select("term", "doc_id", zero.alias("occ"), zero.alias("n_rows"), F.col("occ").alias("o"), F.col("n_rows").alias("r")))
            .groupBy("term", "doc_id").agg(*[F.sum(c).alias(c) for c in ("occ", "n_rows", "o", "r")])
        )
        has = lambda c: (c > 0).cast("long")
        after = both.select("term", "doc_id", (F.col("occ") + F.col("o")).alias("occ"), (F.col("n_rows") + F.col("r")).alias("n_rows"),
                            "o", (has(F.col("n_rows") + F.col("r")) - has(F.col("n_rows"))).alias("file"))
        self._write("pairs", after.where("n_rows > 0").select("term", "doc_id", "occ", "n_rows"), version, grown)
        change = after.where("o <> 0 or file <> 0").groupBy("term").agg(F.sum("o").alias("freq"), F.sum("file").alias("files"))
        merged = (
            self._read("counts", live, touched_c).unionByName(change)
            .groupBy("term").agg(F.sum("freq").alias("freq"), F.sum("files").alias("files")).where("files > 0")
        )
        self._write("counts", merged, version, grown)
        self._write("rows", before.join(ids, "term_id", "left_anti").unionByName(new), version, grown)
        self._commit(version, grown, {"pairs": touched_p, "counts": touched_c, "rows": touched_r})

    def _write(self, kind: str, df: DataFrame, version: int, buckets: int) -> None:
        """Each bucket is written by one task, as large as ``bucket_rows`` at most."""
        (df.withColumn("bucket", self._bucket(kind, buckets)).repartition("bucket").write.mode("overwrite")
         .partitionBy("bucket").parquet(f"{self.path}/{kind}/v{version}"))

    def _commit(self, version: int, buckets: int, touched: dict[str, set[int] | None]) -> None:
        sizes, out = None, []
        for kind in self.KEYS:
            at = self.spark.read.schema(self.SCHEMAS[kind] + ", bucket int").parquet(f"{self.path}/{kind}/v{version}").select(F.lit(kind).alias("kind"), "bucket")
            sizes = at if sizes is None else sizes.union(at)
        size = {(r["kind"], r["bucket"]): r["count"] for r in sizes.groupBy("kind", "bucket").count().collect()}
        for kind, some in touched.items():
            for b in range(buckets) if some is None else some | {b for k, b in size if k == kind}:
                out.append((kind, b, version, (kind, b) in size, buckets, size.get((kind, b), 0)))
        if out:
            self.spark.createDataFrame(out, self.MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def counts(self) -> DataFrame:
        """term, freq (summed), files (distinct doc_id)."""
        return self._read("counts", self._manifest()[3])

    def n_files(self) -> int:
        return self._read("pairs", self._manifest()[3]).select("doc_id").distinct().count()

    def verdicts(self, common_share: float = 0.1, rare_below: int = 3) -> DataFrame:
        """All counts with verdict ``common`` (in more than that share of files), ``rare`` (one file,
        fewer than ``rare_below`` occurrences) or ``kept``."""
        n = self.n_files()
        return self.counts().withColumn(
            "verdict",
            F.when(F.col("files") > common_share * n, "common")
            .when((F.col("files") == 1) & (F.col("freq") < rare_below), "rare").otherwise("kept"))


def distinctive_terms(terms: DataFrame, prior_mass: float = 1000.0) -> DataFrame:
    """Each file's terms with what tells them from the collection.

    Columns: doc_id, term, f (occurrences in the file), d (files), n (all files), tfidf =
    f*(ln((1+n)/(1+d))+1) to 6 decimals, and z: the log-odds ratio of the file against all other
    files under a Dirichlet prior of ``prior_mass`` occurrences spread as the collection's counts,
    divided by its standard error. A term that is the whole collection has z 0.
    Rows as in ``term_rows``. Counts are pre-aggregated before each shuffle, so a file or term
    that holds a third of the rows arrives as partial sums.
    """
    f = term_rows(terms).groupBy("doc_id", "term").agg(F.sum("freq").alias("f"))
    f = stored(f, scratch(terms.sparkSession, "term-counts"))  # read four times below
    whole = f.groupBy("term").agg(F.sum("f").alias("y"), F.count(F.lit(1)).alias("d"))
    size = f.groupBy("doc_id").agg(F.sum("f").alias("n_doc"))
    total = f.agg(F.countDistinct("doc_id").alias("n"), F.sum("f").alias("all")).first()
    n, everything = int(total["n"]), float(total["all"] or 0) or 1.0
    a, a0 = F.lit(prior_mass / everything) * F.col("y"), F.lit(prior_mass)
    here, rest = F.col("f") + a, F.col("y") - F.col("f") + a
    here_not = F.col("n_doc") + a0 - here
    rest_not = F.lit(everything) - F.col("n_doc") + a0 - rest
    odds = F.ln(here) - F.ln(here_not) - F.ln(rest) + F.ln(rest_not)
    z = odds / F.sqrt(1 / here + 1 / rest)
    return (
        f.join(whole, "term").join(size, "doc_id")
        .select("doc_id", "term", "f", "d", F.lit(n).alias("n"),
                F.round(F.col("f") * (F.ln(F.lit(1.0 + n) / (1 + F.col("d"))) + 1), 6).alias("tfidf"),
                F.when((here_not > 0) & (rest_not > 0), z).otherwise(F.lit(0.0)).alias("z"))
    )


def top_terms(weighted: DataFrame, by: str = "tfidf", k: int = 3, least_files: int = 2) -> DataFrame:
    """The k highest-weighted terms of each file, ties by term in code-point order."""
    w = Window.partitionBy("doc_id").orderBy(F.col(by).desc(), F.col("term"))
    return (weighted.where(F.col("d") >= least_files)
            .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))
