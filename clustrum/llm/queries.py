"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, jaccard, language, licenses, manifest, maxent, mixing, quality, repeats, runs, secrets, toxicity, vectors


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_quality_rules": quality.op1_query,
        "op2_lm_scores": maxent.op2_query,
        "op3_language_id": language.op3_query,
        "op4_license_scan": licenses.op4_query,
        "op5_jaccard_join": jaccard.op5_query,
        "op6_source_mixing": mixing.op6_query,
        "op7_near_vectors": vectors.op7_query,
        "op8_bpe_round_trip": bpe.op8_query,
        "op9_secret_scan": secrets.op9_query,
        "op10_toxicity": toxicity.op10_query,
        "op11_repeated_bytes": repeats.op11_query,
        "op12_periodic_runs": runs.op12_query,
        "op13_merkle_manifest": manifest.op13_query,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_license_scan": licenses.oracle(),
        "op5_jaccard_join": jaccard.ORACLE,
        "op6_source_mixing": mixing.ORACLE,
        "op7_near_vectors": vectors.ORACLE,
        "op11_repeated_bytes": repeats.ORACLE,
        "op12_periodic_runs": runs.ORACLE,
        "op13_merkle_manifest": manifest.ORACLE,
    }
