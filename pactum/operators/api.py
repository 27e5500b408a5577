"""The read and write requests of the document API, each over a whole table of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.functions.text import media_type
from pactum.operators import search, store, validation
from pactum.sources.shared import materialize

#: Fixed values.
NOT_FOUND = "Document not found"
NO_VERSIONS = "No processed versions found"
#: What is said where the latest version lacks an artefact. Fixed values.
MISSING = {
    "classification_key": "Classification not yet available",
    "diff_key": "Diff not available — this is the first version or no parent was found",
    "timeline_key": "Timeline not yet available",
}


def tenant(jwt_claim: Column, rest_claim: Column, header: Column) -> Column:
    """The first of the claims and the header that is not empty, else "default"."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in (jwt_claim, rest_claim, header)), F.lit("default"))


def list_documents(documents: DataFrame, limit: int = 200) -> DataFrame:
    """A tenant's first documents by id, with their count."""
    listed = store.listing(documents, limit)
    return listed.groupBy("tenant_id").agg(F.count("*").alias("count"), F.array_sort(F.collect_list("doc_id")).alias("doc_ids"))


def detail(requests: DataFrame, documents: DataFrame, versions: DataFrame) -> DataFrame:
    """request_id, found, title, versions (ascending) of requests (request_id, tenant_id, doc_id).

    A document of another tenant is not found.
    """
    shelf = versions.groupBy("doc_id").agg(F.array_sort(F.collect_list("version_number")).alias("versions"))
    own = documents.select("doc_id", "tenant_id", "title").withColumn("found", F.lit(True))
    rows = requests.join(own, ["doc_id", "tenant_id"], "left").join(shelf, "doc_id", "left")
    found = F.coalesce("found", F.lit(False))
    none = F.array().cast("array<int>")
    return rows.select("request_id", found.alias("found"), "title", F.when(found, F.coalesce("versions", none)).otherwise(none).alias("versions"))


def latest_artefact(requests: DataFrame, documents: DataFrame, versions: DataFrame, key: str) -> DataFrame:
    """request_id, version_number and the artefact key of the latest version, or the reason why there is none."""
    last = store.latest(versions, ["doc_id"], "version_number").select("doc_id", "version_number", F.col(key).alias("artefact"))
    own = documents.select("doc_id", "tenant_id").withColumn("found", F.lit(True))
    rows = requests.join(own, ["doc_id", "tenant_id"], "left").join(last, "doc_id", "left")
    error = F.when(F.col("found").isNull(), NOT_FOUND).when(F.col("version_number").isNull(), NO_VERSIONS).when(F.col("artefact").isNull(), MISSING[key])
    good = error.isNull()
    return rows.select("request_id", F.when(good, F.col("version_number")).alias("version_number"), F.when(good, F.col("artefact")).alias("artefact"), error.alias("error"))


def version_list(versions: DataFrame) -> DataFrame:
    """Versions as a response shows them: numbers as integers, empty texts for what is missing, null for artefacts that may be absent."""
    known = set(versions.columns)
    text = lambda c: (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in known else F.lit("")).alias(c)
    maybe = lambda c: (F.col(c) if c in known else F.lit(None).cast("string")).alias(c)
    number = F.coalesce(F.col("version_number").cast("int"), F.lit(0)).alias("version_number")
    return versions.select("doc_id", number, *(text(c) for c in ("extraction_method", "created_at", "parsed_key", "classification_key")), *(maybe(c) for c in ("timeline_key", "diff_key")))


def graph_documents(documents: DataFrame, statuses: DataFrame) -> DataFrame:
    """Documents under the query language's names, with their last error."""
    rows = documents.join(statuses.select("doc_id", F.col("error").alias("errorMessage")), "doc_id", "left")
    return rows.select(
        F.col("doc_id").alias("id"), F.col("tenant_id").alias("tenantId"), F.col("doc_type").alias("type"), "title", "status", F.coalesce("latest_version", F.lit(0)).alias("currentVersion"),
        F.col("created_at").alias("uploadedAt"), F.col("parent_doc_id").alias("parentDocId"), F.col("raw_key").alias("rawS3Uri"), F.nullif("processed_prefix", F.lit("")).alias("processedS3Uri"), "errorMessage", F.col("updated_at").alias("updatedAt"),
    )


def graph_changes(changes: DataFrame) -> DataFrame:
    """Changes under the query language's names; each leads from the version before to its own, scores are held within 1 and 100."""
    v = F.col("version_number")
    return changes.select(
        F.col("change_id").alias("id"), F.col("doc_id").alias("documentId"), F.greatest(v - 1, F.lit(0)).alias("fromVersion"), v.alias("toVersion"), F.col("clause_number").alias("clauseNumber"), "field", "before", "after",
        F.greatest(F.lit(1), F.least(F.lit(100), F.coalesce("impact_score", F.lit(1)))).alias("impactScore"), F.col("impact_rationale").alias("aiRationale"),
    )


def graph_versions(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """Versions with their number of changes and a summary of them."""
    n = changes.groupBy("doc_id", "version_number").agg(F.count("*").alias("n"))
    rows = versions.join(n, ["doc_id", "version_number"], "left")
    many = F.coalesce("n", F.lit(0))
    return rows.select(F.col("doc_id").alias("documentId"), F.col("version_number").alias("version"), F.col("created_at").alias("createdAt"), many.alias("changes"), F.when(many > 0, F.concat(many.cast("string"), F.lit(" change(s)"))).alias("summary"))


def search_clauses(hits: DataFrame, clauses: DataFrame, chars: int = 200) -> DataFrame:
    """Hits as search results: document, clause number, text, score, and the text's beginning as highlight."""
    rows = hits.select("query_id", "clause_id", "score", "rank").join(clauses.select("clause_id", "doc_id", "clause_number", "text"), "clause_id")
    return rows.select("query_id", "rank", F.col("doc_id").alias("documentId"), F.col("clause_number").alias("clauseNumber"), "text", "score", F.array(F.left("text", F.lit(chars))).alias("highlights"))


def upload(requests: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(an answer for each request, a PENDING document for each valid one).

    requests: request_id, tenant_id, filename, doc_type. A document's id is a hash
    of its request, so a request that comes again makes no second one.
    """
    rows = requests.withColumn("v", validation.upload(F.col("filename"), F.col("doc_type")))
    doc_id = F.sha2(F.concat_ws("|", F.col("tenant_id"), F.col("request_id").cast("string"), F.col("v.filename")), 256)
    rows = rows.withColumn("doc_id", F.when(F.col("v.valid"), doc_id)).withColumn("key", F.when(F.col("v.valid"), F.concat_ws("/", F.lit("tenants"), "tenant_id", F.lit("uploads"), "doc_id", "v.filename")))
    answers = rows.select("request_id", F.when(F.col("v.valid"), 200).otherwise(400).alias("status"), "doc_id", "key", F.col("v.reason").alias("error"))
    none, nothing = F.lit(None).cast("string"), F.lit("")
    pending = rows.filter("v.valid").select(
        "doc_id", "tenant_id", F.col("v.title").alias("title"), F.col("v.doc_type").alias("doc_type"), F.lit("draft").alias("lifecycle"), F.lit("PENDING").alias("status"), F.array().cast("array<string>").alias("parties"),
        none.alias("effective_date"), none.alias("parent_doc_id"), F.col("key").alias("raw_key"), nothing.alias("processed_prefix"), nothing.alias("structural_hash"), nothing.alias("checksum"), F.lit(0).alias("latest_version"), now.alias("created_at"),
    )
    return answers, pending


#: Said where a document's file is gone. Fixed values.
NO_FILE = "Original file is not available for this document"
NO_UPLOAD = "Original upload is no longer available to re-analyze"


def file_link(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """request_id, status, path, filename and media type of the original file, or why there is none."""
    rows = requests.join(documents.select("doc_id", "tenant_id", "raw_key").withColumn("found", F.lit(True)), ["doc_id", "tenant_id"], "left")
    error = F.when(F.col("found").isNull(), NOT_FOUND).when(F.coalesce("raw_key", F.lit("")) == "", NO_FILE)
    name = F.element_at(F.split("raw_key", "/"), -1)
    good = error.isNull()
    return rows.select("request_id", F.when(good, 200).otherwise(404).alias("status"), F.when(good, F.col("raw_key")).alias("path"), F.when(good, name).alias("filename"), F.when(good, media_type(name)).alias("content_type"), error.alias("error"))


def update(requests: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(an answer for each request, documents with the valid changes).

    requests: request_id, tenant_id, doc_id, body; at most one a document.
    """
    rows = requests.join(documents.select("doc_id", "tenant_id").withColumn("found", F.lit(True)), ["doc_id", "tenant_id"], "left").withColumn("v", validation.patch(F.col("body")))
    found = F.col("found").isNotNull()
    answers = rows.select("request_id", "doc_id", F.when(found, F.col("v.status")).otherwise(404).alias("status"), F.when(found, F.col("v.error")).otherwise(NOT_FOUND).alias("error"))
    good = rows.filter(found & F.col("v.error").isNull())
    fields = ["title", "lifecycle", "doc_type"]
    changes = good.select("doc_id", *(F.col(f"v.{f}").alias(f) for f in fields), *(F.col(f"v.{f}").isNotNull().alias(f"set_{f}") for f in fields))
    return answers, store.patch(documents, changes, "doc_id", fields)


def delete_version(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """What each deletion of a version does: the document goes with its only version, else the latest rolls back.

    requests: doc_id, version_number. Gives doc_id, action, latest_version (null where the document goes).
    """
    n = versions.groupBy("doc_id").agg(F.count("*").alias("n"))
    asked = requests.join(n, "doc_id")
    rolled = store.delete_versions(versions, requests.select("doc_id", "version_number"), asked.select("doc_id", "n"))
    whole = F.col("n") <= 1
    return rolled.select("doc_id", F.when(whole, "document").otherwise("version").alias("action"), F.when(~whole, F.col("latest_version")).alias("latest_version"))


def reprocess(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """Upload events to run again and the status that their documents get; without a stored file an error."""
    rows = requests.join(documents.select("doc_id", "tenant_id", "raw_key").withColumn("found", F.lit(True)), ["doc_id", "tenant_id"], "left")
    error = F.when(F.col("found").isNull(), NOT_FOUND).when(F.coalesce("raw_key", F.lit("")) == "", NO_UPLOAD)
    return rows.select("request_id", "doc_id", F.when(error.isNull(), F.col("raw_key")).alias("path"), F.when(error.isNull(), "PENDING").alias("status"), error.alias("error"))


def ask(questions: DataFrame, index: DataFrame, clauses: DataFrame, k: int = 8, embedder=search.hashed_embedding, dimensions: int | None = 16) -> DataFrame:
    """Extractive answers with citations: query_id, answer, citations. An empty question has no row.

    clauses without a vector get one by the embedder. A question may name its number of hits in
    ``top_k``; it is held within 1 and 20, and ``k`` stands where there is none.
    """
    asked = questions.filter(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("vector", embedder(F.col("text")))
    if "vector" not in clauses.columns:
        clauses = materialize(clauses.withColumn("vector", embedder(F.col("text"))), "clauses")
    most = search.top_k(F.col("top_k"), k) if "top_k" in questions.columns else F.lit(k)
    fetched = 20 if "top_k" in questions.columns else k
    near = materialize(search.knn(asked, clauses, fetched, dimensions), "hits")
    hits = search.retrieve(near, search.bm25(asked, index, clauses, fetched), fetched)
    hits = hits.join(asked.select("query_id", most.alias("_most")), "query_id").filter("rank <= _most").drop("_most")
    return search.answer(asked, search.context(hits, clauses))
