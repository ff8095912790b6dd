"""The operators over their whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnbeck.functions.shipping import ship
from tarnbeck.llm import clusters, conversations, decontam, html_text, licenses, lines, near_dups, packing, pseudo_lm, quality, records, substrings, token_counts
from tarnbeck.llm.common import table


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _of(run):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return run(lambda name: table(spark, sf_dir, name))

    return query


QUERIES = {
    "op1_packing": _of(lambda t: packing.pack(t("documents"), tokenizer("word_bpe_49k.json"))),
    "op2_token_counts": _of(lambda t: token_counts.token_counts(t("documents"), tokenizer("piece_bpe_32k.model"))),
    "op3_suffix_dedup": _of(lambda t: substrings.remove_repeats(t("documents"))),
    "op4_decontamination": _of(lambda t: decontam.leaked_items(t("documents"), t("benchmark"))),
    "op5_minhash_dedup": _of(lambda t: near_dups.near_duplicates(t("documents"))),
    "op6_html_extraction": _of(lambda t: html_text.extract(t("pages"))),
    "op7_license_scan": _of(lambda t: licenses.scan_licenses(t("documents"))),
    "op8_lm_scoring": _of(lambda t: pseudo_lm.score(t("documents"))),
    "op9_quality_rules": _of(lambda t: quality.quality_rules(t("documents"), t("labels"))),
    "op10_line_dedup": _of(lambda t: lines.line_digest(t("documents"))),
    "op11_centroid_clustering": _of(lambda t: clusters.cluster(t("embeddings"))),
    "op12_conversation_repair": _of(lambda t: conversations.repair_digest(t("conversations"))),
    "op13_binary_records": _of(lambda t: records.record_digest(t("documents"), tokenizer("word_bpe_49k.json"))),
}
#: Where SQL can express the result; the others are tested against brute force.
ORACLE_SQL = {
    "op4_decontamination": decontam.ORACLE,
    "op10_line_dedup": lines.ORACLE,
    "op11_centroid_clustering": clusters.ORACLE,
    "op12_conversation_repair": conversations.ORACLE,
}
