"""Enumerations of the contract model.

Fixed values: they must equal what existing consumers of contract records expect.
"""

from __future__ import annotations

DOC_TYPES = ["SOW", "MSA", "AMENDMENT", "NDA", "OTHER"]
LIFECYCLES = ["draft", "review", "negotiation", "approval", "signed", "active", "renewal", "expired"]
EXTRACTION_METHODS = ["pdfplumber", "textract", "docx"]
STATUSES = ["PENDING", "PARSING", "CLASSIFYING", "EMBEDDING", "GRAPHING", "DIFFING", "TIMELINING", "PERSISTING", "READY", "FAILED"]
CLAUSE_CATEGORIES = [
    "Definitions", "ScopeOfWork", "Deliverables", "Fees", "Payment", "Term",
    "Termination", "IP", "Liability", "Indemnity", "Warranty", "Confidentiality",
    "DataProtection", "Compliance", "ChangeControl", "Acceptance", "ForceMajeure",
    "DisputeResolution", "GoverningLaw", "Notices", "Assignment", "Subcontracting",
    "Insurance", "Other",
]
RISK_LEVELS = ["low", "medium", "high", "critical"]
FINDING_SEVERITIES = ["info", "low", "medium", "high", "critical"]
PRICING_MODELS = ["fixed", "time_and_materials", "milestone", "retainer", "mixed", "unknown"]
AMENDMENT_TYPES = ["amendment", "change_order", "addendum", "side_letter", "none"]
CHANGE_TYPES = ["replacement", "addition", "deletion", "modification"]
CHANGE_CATEGORIES = ["scope", "value", "timeline", "payment", "personnel", "term", "sla", "other"]
CONFIDENCES = ["high", "medium", "low"]
#: Clause categories whose changes weigh more, and those that stand for a document.
HIGH_IMPACT = ["Liability", "IP", "Indemnity", "Termination"]
REPRESENTATIVE = ["ScopeOfWork", "Definitions", "Term", "Fees"]
PARENT_TYPES = ["SOW", "MSA"]


def one_of(column, values):
    """Whether a column's value is among an enumeration's; null is not."""
    from pyspark.sql import functions as F

    return F.coalesce(column.isin(values), F.lit(False))
