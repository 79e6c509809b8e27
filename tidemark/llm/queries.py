"""Registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from . import chat, convrepair, decontam, hosts, mix, negatives, pagetext, pii, simhash, substring, tokenfiles, toxicity, vectors

QUERIES = {
    "op1_mix": mix.op1_mix,
    "op2_substring": substring.op2_substring,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_decontam": decontam.op4_decontam,
    "op5_simhash": simhash.op5_simhash,
    "op6_pagetext": pagetext.op6_pagetext,
    "op7_pii": pii.op7_pii,
    "op8_hosts": hosts.op8_hosts,
    "op9_vectors": vectors.op9_vectors,
    "op10_chat": chat.op10_chat,
    "op11_negatives": negatives.op11_negatives,
    "op12_tokenfiles": tokenfiles.op12_tokenfiles,
    "op13_convrepair": convrepair.op13_convrepair,
}
#: A learned score (op3), template matches (op4), XXH64 (op5), page structure (op6) and learned patterns (op7) have
#: no SQL form; tests hold them against brute force or held-out labels.
ORACLES = {
    "op1_mix": mix.ORACLE,
    "op2_substring": substring.ORACLE,
    "op8_hosts": hosts.ORACLE,
    "op9_vectors": vectors.ORACLE,
    "op10_chat": chat.ORACLE,
    "op11_negatives": negatives.ORACLE,
    "op13_convrepair": convrepair.ORACLE,
}
