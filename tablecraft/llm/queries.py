"""Registered queries of this package, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablecraft.llm import decontamination, fingerprints, jaccard, language, licences, onepass, packing, pseudo_likelihood, repair, secrets, spelling, tokencount, toxicity
from tablecraft.llm.common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.digest(licences.scan(documents(spark, sf_dir)))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find(documents(spark, sf_dir)))


QUERIES["op1_toxicity"] = toxicity.op1_toxicity
QUERIES["op2_language_id"] = language.op2_language_id
QUERIES["page_languages"] = language.page_languages
QUERIES["op3_secret_scan"] = op3_secret_scan
QUERIES["op4_pattern_packing"] = packing.op4_pattern_packing
QUERIES["op5_license_scan"] = op5_license_scan
QUERIES["op6_document_fingerprints"] = fingerprints.op6
QUERIES["op7_decontamination"] = decontamination.op7_decontamination
QUERIES["op8_lm_scoring"] = pseudo_likelihood.op8_lm_scoring
QUERIES["op9_jaccard_join"] = jaccard.op9_jaccard_join
ORACLES["op9_jaccard_join"] = jaccard.OP9_SQL
QUERIES["op10_token_counts"] = tokencount.op10_token_counts
QUERIES["op11_conversation_repair"] = repair.op11_conversation_repair
ORACLES["op11_conversation_repair"] = repair.OP11_SQL
QUERIES["op12_minhash_near_dedup"] = onepass.op12_minhash_near_dedup
ORACLES["op12_minhash_near_dedup"] = onepass.OP12_SQL
QUERIES["op13_spelling_variants"] = spelling.op13_spelling_variants
ORACLES["op13_spelling_variants"] = spelling.OP13_SQL
