"""Registry of the queries over this subpackage's operators, and of their SQL where there is one."""

from __future__ import annotations

import corpus_pipeline
from ledgerloom.llm import audit, decontam, exact, fim, htmltext, langid, minhash, mixing, pii, quality, ring, secrets, vectors


def queries() -> dict:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_personal_data": pii.op1_personal_data,
        "op2_near_duplicates": minhash.op2_near_duplicates,
        "op3_secret_scan": secrets.op3_secret_scan,
        "op4_exact_dedup": exact.op4_exact_dedup,
        "op5_quality_resampling": quality.op5_quality_resampling,
        "op6_mix_sources": mixing.op6_mix_sources,
        "op7_decontaminate": decontam.op7_decontaminate,
        "op8_page_text": htmltext.op8_page_text,
        "op9_language_id": langid.op9_language_id,
        "op10_ring_sharding": ring.op10_ring_sharding,
        "op11_filter_audit": audit.op11_filter_audit,
        "op12_fill_in_middle": fim.op12_fill_in_middle,
        "op13_near_vectors": vectors.op13_near_vectors,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": exact.OP4_SQL, "op7_decontaminate": decontam.OP7_SQL, "op11_filter_audit": audit.OP11_SQL, "op12_fill_in_middle": fim.OP12_SQL}
