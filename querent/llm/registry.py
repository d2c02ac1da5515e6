"""Names of the corpus queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from querent.llm import bpe, egojoin, flac, mixing, ngramlm, paragraphs, secrets, simhash, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_flac_media": flac.query,
        "op2_ngram_lm": ngramlm.query,
        "op3_simhash_near_dedup": simhash.query,
        "op4_paragraph_dedup": paragraphs.query,
        "op5_embedding_near_dedup": egojoin.query,
        "op6_byte_bpe": bpe.query,
        "op7_secret_scan": secrets.query,
        "op8_toxicity": toxicity.query,
        "op9_source_mixing": mixing.query,
        "op10_warc_writer": warc.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op9_source_mixing": mixing.ORACLE_SQL,
        "op10_warc_writer": warc.ORACLE_SQL,
    }
