"""Registered queries of the training-data operators, each over whole tables, and their SQL counterparts."""

from __future__ import annotations

from strandloom.llm import conversations, decontaminate, exact_dedup, html_text, jaccard_join, language_id, line_dedup, manifest, packing, quality, secrets, substring_dedup, toxicity
from strandloom.session import table


def op1_quality_classifier(spark, sf_dir):
    return quality.report(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op2_substring_dedup(spark, sf_dir):
    return substring_dedup.repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_benchmark_decontamination(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_language_id(spark, sf_dir):
    return language_id.report(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op7_line_dedup(spark, sf_dir):
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_jaccard_join(spark, sf_dir):
    return jaccard_join.join(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("group_rows")


def op10_toxicity(spark, sf_dir):
    return toxicity.report(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))


def op11_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op12_merkle_manifest(spark, sf_dir):
    return manifest.report(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark, sf_dir):
    return conversations.report(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_quality_classifier, op2_substring_dedup, op3_benchmark_decontamination, op4_exact_dedup, op5_packing, op6_language_id, op7_line_dedup, op8_secret_scan, op9_jaccard_join, op10_toxicity, op11_html_text, op12_merkle_manifest, op13_conversation_repair)}
ORACLES = {"op2_substring_dedup": substring_dedup.ORACLE, "op3_benchmark_decontamination": decontaminate.ORACLE, "op4_exact_dedup": exact_dedup.ORACLE, "op7_line_dedup": line_dedup.ORACLE, "op8_secret_scan": secrets.ORACLE, "op9_jaccard_join": jaccard_join.ORACLE, "op12_merkle_manifest": manifest.ORACLE, "op13_conversation_repair": conversations.ORACLE}
