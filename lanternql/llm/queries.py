"""The registered queries of the training-data operators, and their DuckDB equivalents."""

from . import classifier, decontaminate, licenses, mixing, oracle, pii, quality_rules, rollup, simhash, token_file, url_templates

QUERIES = {
    "op1_template_leaks": decontaminate.op1_template_leaks,
    "op2_divergence_quality": quality_rules.op2_divergence_quality,
    "op3_license_dice": licenses.op3_license_dice,
    "op4_mix_to_weights": mixing.op4_mix_to_weights,
    "op5_simhash_covering": simhash.op5_simhash_covering,
    "op6_elias_fano": token_file.op6_elias_fano,
    "op7_subword_classifier": classifier.op7_subword_classifier,
    "op8_pii_disclosure": pii.op8_pii_disclosure,
    "op9_url_templates": url_templates.op9_url_templates,
    "op10_token_rollup": rollup.op10_token_rollup,
}

ORACLES = {
    "op2_divergence_quality": oracle.quality(),
    "op4_mix_to_weights": mixing.OP4_SQL,
    "op8_pii_disclosure": oracle.personal_data(),
    "op9_url_templates": oracle.urls(),
    "op10_token_rollup": rollup.OP10_SQL,
}
