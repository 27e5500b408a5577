"""Parent matching, root walks and amendment chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pactum.functions.text import processed_key, title_similarity
from pactum.functions.vocabulary import REPRESENTATIVE
from pactum.operators import store
from pactum.sources.shared import materialize

HYBRID, STRUCTURAL, TITLE = 0.60, 0.25, 0.15
THRESHOLD = 0.7


def prefer(current: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """What is on its way, and of what is stored the rows whose keys are not among it."""
    return current.unionByName(stored.join(current.select(*keys).distinct(), keys, "left_anti"))


def parent_clauses(parents: DataFrame, versions: DataFrame, documents: DataFrame, artefacts: DataFrame) -> DataFrame:
    """The clauses of each document's parent: those of its latest version that has a classification.

    parents: doc_id, parent_id; versions: doc_id, version_number, classification_key;
    documents: doc_id, tenant_id; artefacts: artefact_key and a clause's columns.
    Where that artefact can't be found, or no version names one, the one of the
    conventional key under the parent's tenant counts; a parent without either has
    no clauses.
    """
    last = store.latest(versions.filter("classification_key is not null"), ["doc_id"], "version_number").select(F.col("doc_id").alias("parent_id"), "classification_key")
    there = artefacts.select("artefact_key").distinct()
    owner = documents.select(F.col("doc_id").alias("parent_id"), processed_key(F.col("tenant_id"), F.col("doc_id"), "classification.json").alias("_conventional"))
    rows = parents.join(last, "parent_id", "left").join(owner, "parent_id", "left")
    rows = rows.join(there.select(F.col("artefact_key").alias("_there")), F.col("classification_key") == F.col("_there"), "left")
    chosen = rows.select("doc_id", "parent_id", F.coalesce("_there", "_conventional").alias("artefact_key"))
    return chosen.join(artefacts, "artefact_key")


def representative(clauses: DataFrame) -> DataFrame:
    """Each document's first clause of a preferred category with a body, else its longest, first ones at ties."""
    body = F.coalesce("body", F.lit(""))
    preferred = F.coalesce(F.col("category").isin(REPRESENTATIVE), F.lit(False)) & (body != "")
    order = W.partitionBy("doc_id").orderBy(F.desc(preferred), F.when(preferred, 0).otherwise(-F.length(body)), "pos")
    return clauses.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def combine(hybrid: DataFrame, structural: DataFrame, children: DataFrame, parents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The best parent candidate of each child and whether it is linked.

    hybrid: child_id, doc_id, score; structural: child_id, doc_id; children:
    doc_id, title; parents: doc_id, title. Candidates that score 0 are none.
    """
    found = hybrid.select("child_id", "doc_id", F.col("score").alias("hybrid")).join(structural.select("child_id", "doc_id").distinct().withColumn("structural", F.lit(1.0)), ["child_id", "doc_id"], "full_outer")
    found = found.join(parents.select("doc_id", F.col("title").alias("_p")), "doc_id", "left").join(children.select(F.col("doc_id").alias("child_id"), F.col("title").alias("_c")), "child_id")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    found = found.select("child_id", "doc_id", zero("hybrid"), zero("structural"), title_similarity(F.col("_c"), F.col("_p")).alias("title_sim"))
    found = found.withColumn("score", F.round(HYBRID * F.col("hybrid") + STRUCTURAL * F.col("structural") + TITLE * F.col("title_sim"), 9)).filter("score > 0")
    two = lambda c: F.format_string("%.2f", F.round(F.col(c), 2))
    signals = F.array_compact(F.array(F.when(F.col("hybrid") != 0, F.concat(F.lit("hybrid="), two("hybrid"))), F.when(F.col("structural") != 0, F.lit("structural-hash")), F.when(F.col("title_sim") != 0, F.concat(F.lit("title-sim="), two("title_sim")))))
    best = found.withColumn("reason", F.array_join(signals, " + ")).withColumn("_n", F.row_number().over(W.partitionBy("child_id").orderBy(F.desc("score"), "doc_id"))).filter("_n = 1")
    all_ = children.select(F.col("doc_id").alias("child_id")).join(best, "child_id", "left")
    linked = F.coalesce(F.col("score") >= threshold, F.lit(False))
    below = F.concat(F.lit("best candidate "), F.col("doc_id").cast("string"), F.lit(" below threshold ("), two("score"), F.lit(")"))
    return all_.select(
        F.col("child_id").alias("doc_id"), F.when(linked, F.col("doc_id")).alias("parent_doc_id"), F.round(F.coalesce("score", F.lit(0.0)), 4).alias("match_confidence"),
        F.when(linked, F.col("reason")).when(F.col("score").isNotNull(), below).otherwise("no candidates found").alias("match_reason"),
    )


def roots(edges: DataFrame, documents: DataFrame, cycles: str = "raise") -> DataFrame:
    """doc_id, root_id, hops: where following the least parent of each document ends.

    A node without a parent is its own root. Pointers double at every step, so h
    hops take about log2(h) joins, however deep; each step is written to the shared
    folder. A path has no more hops than there are documents, so a pointer that
    still moves then is on a cycle. Such edges raise a ValueError, or, with cycles
    "entry", a path ends at the first node that is on the cycle (a node on it at
    itself).
    """
    if cycles not in ("raise", "entry"):
        raise ValueError('cycles must be "raise" or "entry"')
    first = edges.filter("parent_id <> child_id").groupBy("child_id").agg(F.min("parent_id").alias("parent_id"))
    step = documents.select("doc_id").join(first.withColumnRenamed("child_id", "doc_id"), "doc_id", "left")
    state = step.select("doc_id", F.coalesce("parent_id", "doc_id").alias("root_id"), F.when(F.col("parent_id").isNull(), 0).otherwise(1).cast("long").alias("hops"))
    n, most = 1, None
    while True:
        state = materialize(state, "roots")
        if state.filter("hops >= %d" % n).isEmpty():
            return state
        most = state.count() if most is None else most
        if n > most:
            if cycles == "raise":
                raise ValueError("the edges have a cycle")
            # Where pointers stand after so many hops are just the nodes of cycles: those become roots.
            on = materialize(state.filter("hops >= %d" % n).select(F.col("root_id").alias("child_id")).distinct(), "cycles")
            return roots(edges.join(on, "child_id", "left_anti"), documents)
        ahead = state.select(F.col("doc_id").alias("_d"), F.col("root_id").alias("_r"), F.col("hops").alias("_h"))
        state = state.join(ahead, F.col("root_id") == F.col("_d"), "left").select("doc_id", F.coalesce("_r", "root_id").alias("root_id"), (F.col("hops") + F.coalesce("_h", F.lit(0))).alias("hops"))
        n *= 2


def roots_sql(spark, edges: DataFrame, documents: DataFrame) -> DataFrame:
    """The same by a recursive query that keeps the path, for hierarchies with cycles and of at most 100 levels."""
    edges.groupBy("child_id").agg(F.min("parent_id").alias("parent_id")).createOrReplaceTempView("pactum_edges")
    documents.select("doc_id").createOrReplaceTempView("pactum_nodes")
    return spark.sql(
        """
        WITH RECURSIVE walk(doc_id, at, seen) AS (
            SELECT doc_id, doc_id, array(doc_id) FROM pactum_nodes
            UNION ALL
            SELECT w.doc_id, e.parent_id, array_append(w.seen, e.parent_id) FROM walk w JOIN pactum_edges e ON e.child_id = w.at
            WHERE e.parent_id <> w.at AND NOT array_contains(slice(w.seen, 1, size(w.seen) - 1), w.at))
        SELECT doc_id, max_by(at, size(seen)) AS root_id, max(size(seen)) - 1 AS hops FROM walk GROUP BY doc_id"""
    )


def edges_of(matches: DataFrame, now) -> DataFrame:
    """An edge row (parent_id, child_id, created_at) for each match (doc_id, parent_doc_id) that has a parent; one row serves both directions."""
    found = matches.filter("parent_doc_id is not null")
    return found.select(F.col("parent_doc_id").alias("parent_id"), F.col("doc_id").alias("child_id"), now.alias("created_at"))


def append_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """edges and new ones; an edge that comes again keeps its first date."""
    return edges.unionByName(new).groupBy("parent_id", "child_id").agg(F.min("created_at").alias("created_at"))


def chain(edges: DataFrame, documents: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """root_id, seq and the members of each root's chain: its direct children by date (undated first), then id.

    Children without a record count as draft amendments. current: documents on
    their way (root_id, doc_id, doc_type, lifecycle, effective_date, title); its
    amendments are members of their root's chain, edge or not, and its records
    take the place of stored ones.
    """
    links = edges.select(F.col("parent_id").alias("root_id"), F.col("child_id").alias("doc_id"))
    if current is not None:
        links = links.unionByName(current.filter("doc_type = 'AMENDMENT'").select("root_id", "doc_id"))
        documents = prefer(current.drop("root_id"), documents.select(*[c for c in current.columns if c != "root_id"]), ["doc_id"])
    members = links.distinct().join(documents.select("doc_id", "doc_type", "lifecycle", "effective_date", "title"), "doc_id", "left")
    members = members.withColumns({"doc_type": F.coalesce("doc_type", F.lit("AMENDMENT")), "lifecycle": F.coalesce("lifecycle", F.lit("draft")), "title": F.coalesce("title", F.lit(""))})
    order = W.partitionBy("root_id").orderBy(F.coalesce("effective_date", F.lit("")), "doc_id")
    return members.select("root_id", F.row_number().over(order).alias("seq"), "doc_id", "doc_type", "lifecycle", "effective_date", "title")
