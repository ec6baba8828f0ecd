"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from inkstone.llm import ann, decontaminate, language_id, license_scan, mixing, quality, repeats, simhash, toxicity, warc


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": _pipeline,
        "op1_license_scan": license_scan.op1_license_scan,
        "op2_warc_bundles": warc.op2_warc_bundles,
        "op3_repeats": repeats.op3_repeats,
        "op4_mix_sources": mixing.op4_mix_sources,
        "op5_language_id": language_id.op5_language_id,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_nearest": ann.op7_nearest,
        "op8_simhash": simhash.op8_simhash,
        "op9_decontaminate": decontaminate.op9_decontaminate,
        "op10_quality": quality.op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_bundles": warc.OP2_SQL, "op4_mix_sources": mixing.OP4_SQL}
