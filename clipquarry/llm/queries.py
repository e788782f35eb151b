"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from . import bpe, exact_dedup, host_rules, kneser_ney, mixing, near_dedup, passage_dedup, secret_scan, toxicity, url_rules

QUERIES = {
    "op1_kneser_ney": kneser_ney.op1_kneser_ney,
    "op2_pareto_mix": mixing.op2_pareto_mix,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_url_rules": url_rules.op5_url_rules,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_host_rules": host_rules.op7_host_rules,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_passage_dedup": passage_dedup.op10_passage_dedup,
}

ORACLE_SQL = {
    "op2_pareto_mix": mixing.SQL,
    "op3_near_dedup": near_dedup.SQL,
    "op4_exact_dedup": exact_dedup.SQL,
    "op7_host_rules": host_rules.SQL,
}
