"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pactum.llm.chat_tree import OP10_SQL, op10_chat_tree
from pactum.llm.decontamination import OP5_SQL, op5_decontamination
from pactum.llm.licenses import op7_licenses
from pactum.llm.media import op1_media
from pactum.llm.minhash_forest import OP3_SQL, op3_minhash_join
from pactum.llm.packing import op8_packing
from pactum.llm.quality import op9_quality
from pactum.llm.token_counts import op2_token_counts
from pactum.llm.token_files import op6_token_files
from pactum.llm.toxicity import op4_toxicity

QUERIES = {
    "op1_media": op1_media,
    "op2_token_counts": op2_token_counts,
    "op3_minhash_join": op3_minhash_join,
    "op4_toxicity": op4_toxicity,
    "op5_decontamination": op5_decontamination,
    "op6_token_files": op6_token_files,
    "op7_licenses": op7_licenses,
    "op8_packing": op8_packing,
    "op9_quality": op9_quality,
    "op10_chat_tree": op10_chat_tree,
}
ORACLE_SQL = {"op3_minhash_join": OP3_SQL, "op5_decontamination": OP5_SQL, "op10_chat_tree": OP10_SQL}
