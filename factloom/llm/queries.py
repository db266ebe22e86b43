"""The corpus operators' registered queries and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocation, decontam, divergence, line_dedup, near_dedup, packing, quality_rules, secret_ledger, sharding, token_output, top_k, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_output": token_output.op1,
    "op2_toxicity": toxicity.op2,
    "op3_quality_rules": quality_rules.op3,
    "op4_secret_ledger": secret_ledger.op4,
    "op5_decontamination": decontam.op5,
    "op6_packing": packing.op6,
    "op7_stratified_shards": sharding.op7,
    "op8_warc_revisits": warc.op8,
    "op9_line_dedup": line_dedup.op9,
    "op10_near_dedup": near_dedup.op10,
    "op11_top_k": top_k.op11,
    "op12_collocations": collocation.op12,
    "op13_source_divergence": divergence.op13,
}

ORACLES: dict[str, str] = {
    "op3_quality_rules": quality_rules.SQL,
    "op5_decontamination": decontam.SQL,
    "op8_warc_revisits": warc.SQL,
    "op10_near_dedup": near_dedup.SQL,
    "op11_top_k": top_k.SQL,
    "op12_collocations": collocation.SQL,
    "op13_source_divergence": divergence.SQL,
}
