"""The operators, each over its whole table, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import binout, chat, decontam, exact_dedup, langid, merkle, mixing, ngram_join, search, suffix_dedup, tokens, toxicity, urlfilter


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES = {
    "op1_mixing": lambda s, d: mixing.op1(_t(s, d, "documents")),
    "op2_token_counts": lambda s, d: tokens.op2(_t(s, d, "documents")),
    "op3_ngram_jaccard_join": lambda s, d: ngram_join.op3(_t(s, d, "documents")),
    "op4_suffix_dedup": lambda s, d: suffix_dedup.op4(_t(s, d, "documents")),
    "op5_language_id": lambda s, d: langid.op5(_t(s, d, "documents")),
    "op6_decontamination": lambda s, d: decontam.op6(_t(s, d, "documents"), _t(s, d, "benchmark")),
    "op7_toxicity": lambda s, d: toxicity.op7(_t(s, d, "documents"), _t(s, d, "labels")),
    "op8_url_filters": lambda s, d: urlfilter.op8(_t(s, d, "pages")),
    "op9_token_binary": lambda s, d: binout.op9(_t(s, d, "documents")),
    "op10_exact_dedup": lambda s, d: exact_dedup.op10(_t(s, d, "documents")),
    "op11_chat_formatting": lambda s, d: chat.op11(_t(s, d, "conversations")),
    "op12_merkle_manifest": lambda s, d: merkle.op12(_t(s, d, "documents")),
    "op13_ranked_search": lambda s, d: search.op13(_t(s, d, "documents"), _t(s, d, "benchmark")),
}

ORACLE_SQL = {"op8_url_filters": urlfilter.SQL, "op10_exact_dedup": exact_dedup.SQL, "op11_chat_formatting": chat.SQL, "op12_merkle_manifest": merkle.SQL, "op13_ranked_search": search.SQL}
