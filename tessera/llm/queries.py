"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, decontaminate, exact_dedup, langid, license_scan, line_dedup, minhash, sharding, toxicity, url_filter

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_exact_dedup": exact_dedup.query,
    "op3_minhash_near_dedup": minhash.query,
    "op4_license_scan": license_scan.query,
    "op5_toxicity": toxicity.query,
    "op6_sharding": sharding.query,
    "op7_bpe": bpe.query,
    "op8_langid": langid.query,
    "op9_url_filter": url_filter.query,
    "op10_decontamination": decontaminate.query,
}

ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op3_minhash_near_dedup": minhash.ORACLE,
    "op10_decontamination": decontaminate.ORACLE,
}
