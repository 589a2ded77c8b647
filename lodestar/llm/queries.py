"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from lodestar.llm import bpe, exact_dedup, html_text, langid, mixing, secrets, simhash, token_files, topk, toxicity

QUERIES = {
    "op8_mixing": mixing.op8_mixing,
    "op7_html": html_text.op7_html,
    "op10_topk": topk.op10_topk,
    "op9_secrets": secrets.op9_secrets,
    "op1_toxicity": toxicity.op1_toxicity,
    "op6_langid": langid.op6_langid,
    "op4_bpe": bpe.op4_bpe,
    "op5_token_files": token_files.op5_token_files,
    "op2_simhash": simhash.op2_simhash,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
}
SQL = {
    "op8_mixing": mixing.SQL,
    "op10_topk": topk.SQL,
    "op3_exact_dedup": exact_dedup.SQL,
}
