"""Checks of upload names and document updates, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactum.functions.vocabulary import DOC_TYPES, LIFECYCLES

# The messages below are fixed values: callers compare with them.
_TYPES, _CYCLES = ", ".join(sorted(DOC_TYPES)), ", ".join(sorted(LIFECYCLES))


def upload(filename: Column, doc_type: Column) -> Column:
    """valid, reason, filename (its last path part), title (without suffix), doc_type of an upload request."""
    raw = F.trim(F.coalesce(filename, F.lit("")))
    name = F.element_at(F.split(F.replace(raw, F.lit("\\"), F.lit("/")), "/"), -1)
    kind = F.upper(F.trim(F.coalesce(doc_type, F.lit("OTHER"))))
    reason = (
        F.when(raw == "", "Missing required query parameter: filename")
        .when(name.isin("", ".", "..") | ~name.rlike(r"\A[A-Za-z0-9._ -]{1,200}\z"), "Invalid filename")
        .when(~F.lower(name).rlike(r"\.(pdf|docx|doc|txt)\z"), "Unsupported file type. Allowed: pdf, docx, doc, txt")
        .when(~kind.isin(DOC_TYPES), F.concat(F.lit("Invalid docType '"), kind, F.lit(f"'. Must be one of: {_TYPES}")))
    )
    good = reason.isNull()
    stem = F.regexp_replace(name, r"\.[^.]*\z", "")
    return F.struct(
        good.alias("valid"), reason.alias("reason"), F.when(good, name).alias("filename"), F.when(good, F.coalesce(F.nullif(stem, F.lit("")), name)).alias("title"), F.when(good, kind).alias("doc_type")
    )


def patch(body: Column) -> Column:
    """status, error and the fields to set of a JSON update."""
    text = F.coalesce(body, F.lit(""))
    parsed = F.try_parse_json(text)
    kind = F.schema_of_variant(parsed)
    fields = F.from_json(text, "map<string,string>")
    unknown = F.array_sort(F.array_except(F.map_keys(fields), F.array(F.lit("title"), F.lit("lifecycle"), F.lit("docType"))))
    has = lambda k: F.coalesce(F.map_contains_key(fields, k), F.lit(False))
    value = lambda k: F.coalesce(F.try_element_at(fields, F.lit(k)), F.lit(""))
    title = F.trim(value("title"))
    error = (
        F.when(text == "", "Request body is required")
        .when(parsed.isNull(), "Invalid JSON body")
        .when(~kind.startswith("OBJECT"), "Body must be a JSON object")
        .when(F.size(fields) == 0, "No fields to update")
        .when(F.size(unknown) > 0, F.concat(F.lit("Unknown field(s): "), F.array_join(unknown, ", ")))
        .when(has("lifecycle") & ~value("lifecycle").isin(LIFECYCLES), f"Invalid lifecycle. Must be one of: {_CYCLES}")
        .when(has("docType") & ~value("docType").isin(DOC_TYPES), f"Invalid docType. Must be one of: {_TYPES}")
        .when(has("title") & (title == ""), "title cannot be empty")
        .when(has("title") & (F.length(title) > 500), "title is too long (max 500 characters)")
    )
    good = error.isNull()
    return F.struct(
        F.when(good, 200).otherwise(400).alias("status"), error.alias("error"), F.when(good & has("title"), title).alias("title"),
        F.when(good & has("lifecycle"), value("lifecycle")).alias("lifecycle"), F.when(good & has("docType"), value("docType")).alias("doc_type"),
    )
