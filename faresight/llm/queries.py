"""Queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from faresight.llm import (decontaminate, divergence, embeddings, html_extract, licenses, minhash, mixing, quality, resampling,
                           token_counts, token_ids, toxicity, warc)

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_licenses": licenses.op2_licenses,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_near_duplicates": minhash.op4_near_duplicates,
    "op5_warc": warc.op5_warc,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_html_extract": html_extract.op7_html_extract,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_embeddings": embeddings.op9_embeddings,
    "op10_quality": quality.op10_quality,
    "op11_resampling": resampling.op11_resampling,
    "op12_divergence": divergence.op12_divergence,
    "op13_token_ids": token_ids.op13_token_ids,
}


def _sql(text: str) -> str:
    for t in ("documents", "benchmark", "pages", "embeddings", "labels"):
        text = text.replace("{" + t + "}", t)
    return text.strip()


ORACLES = {
    "op1_decontaminate": _sql(decontaminate.SQL),
    "op2_licenses": _sql(licenses.SQL),
    "op3_mix_sources": _sql(mixing.SQL),
    "op4_near_duplicates": _sql(minhash.SQL),
    "op5_warc": _sql(warc.SQL),
    "op9_embeddings": _sql(embeddings.SQL),
    "op11_resampling": _sql(resampling.SQL),
    "op12_divergence": _sql(divergence.SQL),
}
