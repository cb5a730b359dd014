"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from . import decontaminate, html_extract, lexical, mixing, near_join, near_vectors, pii, quality, repeats, resample, tokens, toxicity, warc

QUERIES = {
    "op1_html": html_extract.query,
    "op2_quality": quality.query,
    "op3_warc": warc.query,
    "op4_near_join": near_join.query,
    "op5_tokens": tokens.query,
    "op6_mixing": mixing.query,
    "op7_near_vectors": near_vectors.query,
    "op8_decontaminate": decontaminate.query,
    "op9_repeats": repeats.query,
    "op10_toxicity": toxicity.query,
    "op11_lexical": lexical.query,
    "op12_pii": pii.query,
    "op13_resample": resample.query,
}

ORACLES = {
    "op3_warc": warc.ORACLE,
    "op4_near_join": near_join.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op7_near_vectors": near_vectors.ORACLE,
    "op8_decontaminate": decontaminate.ORACLE,
    "op11_lexical": lexical.ORACLE,
    "op13_resample": resample.ORACLE,
}
