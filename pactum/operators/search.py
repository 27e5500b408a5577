"""Clause search: exact k-NN, BM25, their fusion, retrieval for answers.

Queries and clauses meet on the tenant (and on terms), never in a cross join.
Where the queries are few by count, they are broadcast and no clause is shuffled;
else the clause side of a tenant is dealt over salts and the queries are repeated
for each, so a large tenant is spread over tasks. Conditions are tested on a pair
before it is scored, a pair carries what they and the result need, and only the k
best of each partition are shuffled for the ranks. Scores are rounded before
ranks are taken, and ties go to the lesser clause id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pactum.functions.text import analyzed, cosine, terms
from pactum.sources.shared import materialize

K1, B = 1.2, 0.75
DIGITS = 6
ALPHA = 0.6
#: Queries, or query terms, of at most so many rows may be broadcast.
FEW = 20_000
SALTS = 16
_CARRIED = ("doc_type", "structural_hash")
_CONDITIONS = ("exclude_doc_id", "doc_types", "doc_id", "hash_prefix")


def _carried(clauses: DataFrame) -> list[str]:
    return ["clause_id", "tenant_id", "doc_id", *(c for c in _CARRIED if c in clauses.columns)]


def _asked(queries: DataFrame, *columns) -> DataFrame:
    """query_id, tenant_id and conditions under names of their own, written once, as they are counted and read again."""
    conditions = [F.col(c).alias(f"_{c}") for c in _CONDITIONS if c in queries.columns]
    return materialize(queries.select("query_id", "tenant_id", *conditions, *columns), "queries")


def _allowed(pairs: DataFrame) -> DataFrame:
    """Pairs of a query and a clause that meet the query's own conditions."""
    tests = {
        "_exclude_doc_id": lambda: F.col("_exclude_doc_id").isNull() | (F.col("doc_id") != F.col("_exclude_doc_id")),
        "_doc_types": lambda: F.col("_doc_types").isNull() | F.coalesce(F.array_contains("_doc_types", F.col("doc_type")), F.lit(False)),
        "_doc_id": lambda: F.col("_doc_id").isNull() | (F.col("doc_id") == F.col("_doc_id")),
        "_hash_prefix": lambda: F.col("_hash_prefix").isNull() | F.startswith(F.col("structural_hash"), F.col("_hash_prefix")),
    }
    for c, test in tests.items():
        if c in pairs.columns:
            pairs = pairs.filter(test())
    return pairs


def _meet(rows: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with what is asked: broadcast if that is little, else over salts."""
    if asked.count() <= FEW:
        return rows.join(F.broadcast(asked), keys)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("clause_id"), F.lit(SALTS)).cast("int"))
    return salted.join(asked.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [*keys, "_salt"]).drop("_salt")


def postings(clauses: DataFrame, asked: DataFrame | None = None, analyzer=terms) -> DataFrame:
    """(field, term, clause_id, tenant_id, doc_id, conditions' columns, field_length, tf) of title and text.

    asked: a table of the terms (term) that queries have; others are left out before
    anything is shuffled. Lengths are those of whole fields all the same. Clauses are
    dealt by their id before their terms are taken apart, so terms are counted where
    they are and it is texts that are shuffled, not terms.
    """
    made = F.array(*(F.struct(F.lit(f).alias("field"), analyzer(F.col(f)).alias("t")) for f in ("title", "text")))
    rows = clauses.select(*_carried(clauses), "title", "text").repartition("clause_id").select(*_carried(clauses), F.explode(made).alias("f"))
    rows = rows.select(*_carried(clauses), "f.field", F.size("f.t").alias("field_length"), F.explode("f.t").alias("term"))
    if asked is not None:
        rows = rows.join(F.broadcast(asked) if asked.count() <= FEW else asked, "term", "left_semi")
    return rows.groupBy("field", "term", *_carried(clauses), "field_length").agg(F.count("*").alias("tf"))


def fields(clauses: DataFrame, analyzer=terms) -> DataFrame:
    """Of the clauses that have a field: field, n_clauses, mean_length. Two rows, from one pass without a shuffle of clauses."""
    n = {f: F.size(analyzer(F.col(f))) for f in ("title", "text")}
    sizes = clauses.select(*(n[f].alias(f) for f in n))
    found = sizes.agg(*(x for f in n for x in (F.count_if(F.col(f) > 0).alias(f"{f}_n"), F.avg(F.when(F.col(f) > 0, F.col(f))).alias(f"{f}_mean"))))
    return found.select(F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"{f}_n").alias("n_clauses"), F.col(f"{f}_mean").alias("mean_length")) for f in n))).alias("f")).select("f.*")


def index(clauses: DataFrame, asked: DataFrame | None = None, analyzer=terms) -> DataFrame:
    """Postings, written once: look-ups and frequencies read them, and a common term lies in many files."""
    salt = F.pmod(F.xxhash64("clause_id"), F.lit(SALTS))
    return materialize(postings(clauses, asked, analyzer).repartition("term", salt), "postings")


def asked_terms(queries: DataFrame, analyzer=terms) -> DataFrame:
    """The distinct terms of queries, written once."""
    return materialize(queries.select(F.explode(analyzer(F.col("text"))).alias("term")).distinct(), "terms")


def bm25(queries: DataFrame, index: DataFrame, clauses: DataFrame, k: int | None = 10, analyzer=terms, where: Column | None = None) -> DataFrame:
    """query_id, clause_id, doc_id, score, rank: best of twice the title's and the text's BM25.

    queries: query_id, tenant_id, text and optionally exclude_doc_id, doc_types
    (an array), doc_id, hash_prefix. Frequencies are those of the whole index,
    whatever the tenant. index: postings of the clauses, of all terms or of those
    that the queries have; clauses give the fields' mean lengths. where: what holds
    for every clause that any query may find; frequencies count the others too.
    """
    known = materialize(fields(clauses, analyzer), "fields")
    asked = _asked(queries, F.explode(F.array_distinct(analyzer(F.col("text")))).alias("term"))
    words = asked.select("term").distinct()
    df = index.join(F.broadcast(words) if asked.count() <= FEW else words, "term", "left_semi").groupBy("field", "term").agg(F.count("*").alias("df"))
    # The weight of a term belongs to what is asked; the table of fields has two rows.
    weight = F.log1p((F.col("n_clauses") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = asked.join(df, "term").join(F.broadcast(known), "field").withColumn("idf", weight).drop("df", "n_clauses")
    hits = _allowed(_meet(index if where is None else index.filter(where), materialize(asked, "asked"), ["tenant_id", "term", "field"]))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("field_length") / F.col("mean_length")))
    by_field = hits.groupBy("query_id", "clause_id", "doc_id").agg(F.sum(F.when(F.col("field") == "title", part)).alias("title"), F.sum(F.when(F.col("field") == "text", part)).alias("text"))
    scored = by_field.select("query_id", "clause_id", "doc_id", F.round(F.greatest(2 * F.coalesce("title", F.lit(0.0)), F.coalesce("text", F.lit(0.0))), DIGITS).alias("score"))
    return _top(scored, k)


def _dot(a: Column, b: Column, dimensions: int) -> Column:
    return reduce(lambda s, x: s + x, (F.get(a, F.lit(i)).cast("double") * F.get(b, F.lit(i)).cast("double") for i in range(dimensions)))


def knn(queries: DataFrame, clauses: DataFrame, k: int | None = 10, dimensions: int | None = None) -> DataFrame:
    """query_id, clause_id, doc_id, score, rank: exact nearest vectors by cosine, as 1 / (2 - cosine).

    Conditions apply before the k nearest are taken, so there are k where k qualify.
    With ``dimensions`` the products are one compiled expression, and vectors of
    fewer elements are near to none.
    """
    own = clauses.select(*_carried(clauses), F.col("vector").alias("_v")).filter("_v is not null")
    asked = _asked(queries.filter("vector is not null"), F.col("vector").alias("_q"))
    if dimensions is None:
        value = cosine(F.col("_q"), F.col("_v"))
    else:
        own = own.withColumn("_vn", F.sqrt(_dot(F.col("_v"), F.col("_v"), dimensions))).filter("_vn > 0")
        asked = asked.withColumn("_qn", F.sqrt(_dot(F.col("_q"), F.col("_q"), dimensions))).filter("_qn > 0")
        value = _dot(F.col("_q"), F.col("_v"), dimensions) / (F.col("_qn") * F.col("_vn"))
    pairs = _allowed(_meet(own, asked, ["tenant_id"]))
    scored = pairs.select("query_id", "clause_id", "doc_id", F.round(1 / (2 - value), DIGITS).alias("score")).filter("score is not null")
    return _top(scored, k)


def _top(hits: DataFrame, k: int | None, key: str = "clause_id") -> DataFrame:
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), key)))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def channel(hits: DataFrame) -> DataFrame:
    """query_id, doc_id, best clause_id and min-max score over the fetched hits of each query.

    Where all hits score alike the span counts as 1, so they all get 0.
    """
    w = W.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    span = F.when(high == low, 1.0).otherwise(high - low)
    rows = hits.withColumn("normed", (F.col("score") - low) / span)
    best = F.row_number().over(W.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "clause_id"))
    return rows.withColumn("_n", best).filter("_n = 1").select("query_id", "doc_id", "clause_id", "normed")


def fuse(near: DataFrame, keyword: DataFrame, k: int | None = 10, alpha: float = ALPHA) -> DataFrame:
    """query_id, doc_id, clause_id (of the vector channel if it has one), both scores, score, rank."""
    a = channel(near).select("query_id", "doc_id", F.col("clause_id").alias("_a"), F.col("normed").alias("knn_score"))
    b = channel(keyword).select("query_id", "doc_id", F.col("clause_id").alias("_b"), F.col("normed").alias("bm25_score"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    rows = a.join(b, ["query_id", "doc_id"], "full_outer").select(
        "query_id", "doc_id", F.coalesce("_a", "_b").alias("clause_id"), F.round(zero("knn_score"), DIGITS).alias("knn_score"), F.round(zero("bm25_score"), DIGITS).alias("bm25_score"),
        F.round(alpha * zero("knn_score") + (1 - alpha) * zero("bm25_score"), DIGITS).alias("score"),
    )
    return _top(rows, k, "doc_id")


def hybrid(queries: DataFrame, index: DataFrame, clauses: DataFrame, k: int = 10, alpha: float = ALPHA, dimensions: int | None = None, where: Column | None = None) -> DataFrame:
    """Documents by both channels, 2k hits fetched from each; where: as in ``bm25``."""
    near = knn(queries, clauses if where is None else clauses.filter(where), 2 * k, dimensions)
    near, keyword = (materialize(x, "hits") for x in (near, bm25(queries, index, clauses, 2 * k, where=where)))
    return fuse(near, keyword, k, alpha)


def retrieve(near: DataFrame, keyword: DataFrame, k: int = 8) -> DataFrame:
    """Clauses for an answer: the nearest, then, if fewer than k, keyword hits that are not among them."""
    rest = keyword.join(near.select("query_id", "clause_id"), ["query_id", "clause_id"], "left_anti")
    both = near.select("query_id", "clause_id", "doc_id", F.lit(0).alias("channel"), F.col("rank").alias("r")).unionByName(rest.select("query_id", "clause_id", "doc_id", F.lit(1).alias("channel"), F.col("rank").alias("r")))
    return both.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("channel", "r"))).filter(F.col("rank") <= k).drop("r")


def context(hits: DataFrame, clauses: DataFrame, chars: int = 1200, by_document: bool = False) -> DataFrame:
    """query_id, context, citations: the hits' texts in rank order, cut, with their clause numbers."""
    rows = hits.join(clauses.select("clause_id", "clause_number", "text", "category"), "clause_id")
    body = F.left(F.coalesce("text", F.lit("")), F.lit(chars))
    mark = F.concat(F.lit("[doc="), F.col("doc_id").cast("string"), F.lit("] §"), F.col("clause_number"), F.lit("\n")) if by_document else F.concat(F.lit("[§"), F.col("clause_number"), F.lit("] "))
    listed = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.concat(mark, body).alias("block"), F.struct("clause_number", "doc_id", "category").alias("citation")))).alias("l"))
    return listed.select("query_id", F.array_join("l.block", "\n\n---\n\n" if by_document else "\n").alias("context"), F.col("l.citation").alias("citations"))


#: Said where no clause is found. Fixed value.
NOTHING_FOUND = "I couldn't find any clauses relevant to that question in this document. Try rephrasing, or ask about a specific clause or topic."


def answer(queries: DataFrame, contexts: DataFrame) -> DataFrame:
    """Extractive answers: the first block of the context, or the fixed text where nothing was found."""
    said = F.coalesce(F.split_part("context", F.lit("\n"), F.lit(1)), F.lit(NOTHING_FOUND))
    return queries.join(contexts, "query_id", "left").select("query_id", said.alias("answer"), "citations")


def top_k(asked: Column, default: int = 8) -> Column:
    """A requested number of hits, within 1 and 20."""
    return F.greatest(F.lit(1), F.least(F.coalesce(asked, F.lit(default)), F.lit(20)))


def hashed_embedding(text: Column, dimensions: int = 16) -> Column:
    """The default embedder: term counts by a hash of the term, an array of doubles."""
    if dimensions == 16:  # the slot is one hexadecimal digit, so a text's slots are a string
        digits = F.array_join(F.transform(terms(text), lambda t: F.substring(F.md5(t), 4, 1)), "")
        one = F.transform(F.array(digits), lambda own: F.array(*((F.length(own) - F.length(F.replace(own, F.lit(f"{d:x}"), F.lit("")))).cast("double") for d in range(16))))
        return F.element_at(one, 1)
    slots = F.transform(terms(text), lambda t: (F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int") % dimensions))
    # As an array's only element the slots are computed once, not again for each dimension.
    counted = F.transform(F.array(slots), lambda own: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.size(F.filter(own, lambda s: s == d)).cast("double")))
    return F.element_at(counted, 1)
