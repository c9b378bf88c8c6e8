"""The graph as two tables, and the queries on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import text as X
from textloom.sources.store import stored

# Colours of the entity types.
TYPE_COLORS = {
    "Aircraft": "#2563eb", "Structure": "#16a34a", "Mechanism": "#d97706", "ControlMethod": "#7c3aed", "Performance": "#dc2626",
    "Mission": "#0891b2", "Parameter": "#db2777", "Document": "#64748b", "Concept": "#374151",
}


def nodes(mentions: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """id, name, entity_type, source_doc: of each id the first mention by document, sentence and place.

    ``aliases`` (alias, canonical): names are replaced by their canonical one first.
    """
    m = mentions.where("entity is not null")
    if aliases is not None:
        a = aliases.where("canonical is not null and alias is not null").groupBy(F.col("alias").alias("entity")).agg(F.min("canonical").alias("c"))
        m = m.join(a, "entity", "left").withColumn("entity", F.coalesce("c", "entity")).drop("c")
    first = F.struct("doc_id", "sentence_id", "start_pos", "end_pos", F.col("entity").alias("name"), "entity_type")
    return (m.groupBy(X.entity_id(F.col("entity")).alias("id")).agg(F.min(first).alias("x"))
            .select("id", "x.name", F.col("x.entity_type").alias("entity_type"), F.col("x.doc_id").alias("source_doc")))


def edges(relations: DataFrame) -> DataFrame:
    """source, relation, target, doc_id, sentence_id, evidence: one per triple and sentence."""
    return (relations.groupBy(X.entity_id(F.col("head")).alias("source"), "relation", X.entity_id(F.col("tail")).alias("target"), "doc_id", "sentence_id")
            .agg(F.min("evidence").alias("evidence")))


def triples(n: DataFrame, e: DataFrame) -> DataFrame:
    """The graph as a set of RDF triples (s, p, o, kind); evidence hangs on the source node."""
    t = lambda df, s, p, o, kind: df.select(F.col(s).alias("s"), p.alias("p"), F.col(o).alias("o"), F.lit(kind).alias("kind"))
    return (t(n, "id", F.lit("rdf:type"), "entity_type", "iri").union(t(n, "id", F.lit("rdfs:label"), "name", "literal"))
            .union(t(e, "source", F.col("relation"), "target", "iri")).union(t(e, "source", F.lit("hasEvidence"), "evidence", "literal")).distinct())


def turtle_lines(n: DataFrame, e: DataFrame) -> DataFrame:
    """The graph as plain lines: no evidence, double quotes as single ones, duplicates kept."""
    label = F.regexp_replace(F.coalesce("name", F.lit("")), '"', "'")
    a = n.select(F.concat(F.lit("ex:"), "id", F.lit(" a ex:"), F.coalesce("entity_type", F.lit("")), F.lit(" ; rdfs:label \""), label, F.lit("\" .")).alias("line"))
    b = e.select(F.concat(F.lit("ex:"), "source", F.lit(" ex:"), "relation", F.lit(" ex:"), "target", F.lit(" .")).alias("line"))
    return a.union(b)


def upsert(base: DataFrame, updates: DataFrame, keys: list[str], order: str) -> DataFrame:
    """base with the updates merged in by key: of several updates of a key the last by ``order`` holds."""
    columns = [c for c in base.columns if c not in keys]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("u")).select(*keys, *[F.col(f"u.{c}").alias(c) for c in columns])
    return base.join(last.select(*keys), keys, "left_anti").select(*keys, *columns).unionByName(last)


def matched_edges(e: DataFrame, n: DataFrame) -> DataFrame:
    """Edges both ends of which are nodes."""
    ids = n.select("id").distinct()
    return e.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*e.columns)


def degrees(e: DataFrame) -> DataFrame:
    """id, degree: both ends count, so an edge to itself counts twice."""
    return e.select(F.explode(F.array("source", "target")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def stats(n: DataFrame, e: DataFrame) -> DataFrame:
    """entities, relations and documents of the graph, in one row."""
    a = n.agg(F.count(F.lit(1)).alias("entities"), F.countDistinct(F.when(F.col("source_doc") != "", F.col("source_doc"))).alias("documents")).withColumn("k", F.lit(1))
    b = e.agg(F.count(F.lit(1)).alias("relations")).withColumn("k", F.lit(1))
    return a.join(b, "k").select("entities", "relations", "documents")


def color(kind: Column) -> Column:
    out = F.lit("#374151")
    for k, v in reversed(TYPE_COLORS.items()):
        out = F.when(kind == k, v).otherwise(out)
    return out


MENU = 20  # hits a search box shows of those it is given


def search(n: DataFrame, query: str, limit: int = 60) -> DataFrame:
    """Nodes whose name contains the query, whatever the case, the shortest names first, then by id."""
    q = query.strip().lower()
    hits = n.where(F.lower("name").contains(q)) if q else n.limit(0)
    return hits.orderBy(F.length("name"), "id").limit(limit)


def entity_detail(n: DataFrame, e: DataFrame, entity: str, cap: int = 80) -> DataFrame:
    """Edges out of and into a node with the names of both ends, at most ``cap`` each way (ordered by relation,
    other end, document and sentence)."""
    own = e.where((F.col("source") == entity) | (F.col("target") == entity))
    way = F.explode(F.filter(F.array(F.when(F.col("source") == entity, "out"), F.when(F.col("target") == entity, "in")), lambda x: x.isNotNull()))
    w = Window.partitionBy("direction").orderBy("relation", "source", "target", "doc_id", "sentence_id")
    some = own.withColumn("direction", way).withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= cap)
    name = lambda end: n.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name"))
    got = some.join(name("source"), "source", "left").join(name("target"), "target", "left")
    return got.select("direction", "source", F.coalesce("source_name", "source").alias("source_name"), "relation", "target",
                      F.coalesce("target_name", "target").alias("target_name"), "doc_id", "sentence_id")


def neighbourhood(e: DataFrame, entity: str, hops: int, budget: int = 200) -> DataFrame:
    """id of the nodes within ``hops`` edges of a node, whatever their direction; the search stops after a
    step with more than ``budget`` nodes, which all stay. Each hop is one join of a frontier; what was reached is
    stored, so a hop is computed once."""
    spark = e.sparkSession
    both = e.select(F.col("source").alias("id"), F.col("target").alias("next")).union(e.select("target", "source"))
    seen = spark.createDataFrame([(entity,)], "id string")
    frontier, n = seen, 1
    for i in range(hops):
        frontier = both.join(frontier, "id", "left_semi").select(F.col("next").alias("id")).distinct().join(seen, "id", "left_anti")
        if i + 1 < hops:
            frontier = stored(frontier, "frontier")
            n += frontier.count()
        seen = seen.union(frontier)
        if n > budget:
            break
    return seen


def subgraph(n: DataFrame, e: DataFrame, entity: str, hops: int = 1, budget: int = 200) -> DataFrame:
    """Nodes around a node with degree inside the subgraph and how they are drawn: size, colour, border, label."""
    ids = stored(neighbourhood(e, entity, hops, budget), "reached")
    inner = induced(e, ids)
    centre = F.col("id") == entity
    size = F.when(centre, F.lit(28.0)).otherwise(F.greatest(F.lit(10.0), F.least(F.lit(22.0), 8 + F.sqrt(F.col("degree")) * 2)))
    got = n.join(ids, "id", "left_semi").join(degrees(inner), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return got.select("id", "name", "entity_type", "degree", F.round(size, 4).alias("symbol_size"), color(F.col("entity_type")).alias("color"),
                      F.when(centre, "#ffffff").otherwise("transparent").alias("border_color"), F.when(centre, 3).otherwise(0).alias("border_width"), F.lit(True).alias("labelled"))


def subgraph_edges(e: DataFrame, entity: str, hops: int = 1, budget: int = 200) -> DataFrame:
    """The edges among the nodes around a node, with relation and evidence."""
    return induced(e, neighbourhood(e, entity, hops, budget)).select("source", "target", "relation", "evidence", "doc_id", "sentence_id")


def induced(e: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges both ends of which are among ids."""
    i = ids.select("id").distinct()
    return e.join(i.withColumnRenamed("id", "source"), "source", "left_semi").join(i.withColumnRenamed("id", "target"), "target", "left_semi").select(*e.columns)


def _top(n: DataFrame, e: DataFrame, limit: int) -> DataFrame:
    got = n.join(degrees(e), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return got.orderBy(F.col("degree").desc(), (F.coalesce("entity_type", F.lit("Concept")) != "Concept").desc(), "id").limit(limit)


def overview(n: DataFrame, e: DataFrame, limit: int = 2000) -> DataFrame:
    """The nodes of highest degree, typed ones first among equals, then by id, with their drawn size and label."""
    size = F.greatest(F.lit(6.0), F.least(F.lit(26.0), 6 + F.sqrt(F.col("degree")) * 1.8))
    return _top(n, e, limit).select("id", "name", "entity_type", "degree", F.round(size, 4).alias("symbol_size"), (size > 12).alias("labelled"), color(F.col("entity_type")).alias("color"))


def overview_edges(n: DataFrame, e: DataFrame, limit: int = 2000) -> DataFrame:
    """The edges among the nodes of the overview."""
    return induced(e, _top(n, e, limit)).select("source", "target", "relation", "doc_id", "sentence_id")


def legend(n: DataFrame) -> DataFrame:
    """Each entity type with its nodes, place (the most frequent first, equals by name) and colour."""
    kinds = n.groupBy(F.coalesce("entity_type", F.lit("Concept")).alias("entity_type")).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("n").desc(), "entity_type"))  # one row a type
    return kinds.select("entity_type", "n", place.alias("place"), color(F.col("entity_type")).alias("color"))


def of_types(n: DataFrame, e: DataFrame, types: list[str]) -> DataFrame:
    """Edges left when only nodes of some types are shown."""
    return induced(e, n.where(F.col("entity_type").isin(*types)).select("id"))
