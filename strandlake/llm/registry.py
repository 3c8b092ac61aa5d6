"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from strandlake.llm import chat, cosine, decontaminate, html, jaccard, licences, oracles, packing, personal, quality, secrets

QUERIES = {
    f.__name__: f
    for f in (
        chat.op1_chat_format,
        secrets.op2_secret_scan,
        packing.op3_pack_sequences,
        cosine.op4_cover_tree,
        licences.op5_licence_scan,
        jaccard.op6_ngram_jaccard,
        decontaminate.op7_benchmark_leaks,
        personal.op8_personal_data,
        quality.op9_quality,
        html.op10_main_text,
    )
}
ORACLE_SQL = {"op1_chat_format": chat.OP1_SQL, "op2_secret_scan": oracles.OP2_SQL, "op4_cover_tree": oracles.OP4_SQL, "op6_ngram_jaccard": oracles.OP6_SQL, "op8_personal_data": oracles.OP8_SQL}
