"""The registered queries of this subpackage and the SQL that DuckDB can hold them against."""

from . import chat, decontaminate, exact_dedup, licenses, merkle, mixing, packing, periodic, quality, secrets, simhash, tokens, toxicity

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_quality": quality.op4_quality,
    "op5_token_counts": tokens.op5_token_counts,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_packing": packing.op7_packing,
    "op8_simhash": simhash.op8_simhash,
    "op9_chat_format": chat.op9_chat_format,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_mixture": mixing.op11_mixture,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}
ORACLE_SQL = {
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op9_chat_format": chat.OP9_SQL,
}
