"""The queries opN_<name> over the driver's tables; thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm import urls

    pages, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("pages", "labels"))
    return urls.judge(pages, urls.page_labels(pages, labels), urls.RULES)


def op2_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.outliers import judge

    return judge(_docs(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm import mixing
    from gridloom.llm.common import stored

    text, dims = F.col("text"), ["source", "lang", "topic"]
    # the texts are read once; numbers, categories and a hash of each go on
    rows = stored(_docs(spark, sf_dir).select("doc_id", F.xxhash64("text").alias("text_hash"), "source", "lang", mixing.topic(text).alias("topic"), mixing.n_tokens(text).alias("n_tokens")), "mixed")
    cells = mixing.tally(rows, dims)
    mixed = mixing.mix(rows, mixing.natural(cells, dims, temperature=1.5), budget_share=0.5, by=("doc_id", "text_hash"), cells=cells)
    return mixed.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "kept")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gridloom.llm.packing import packed

    return packed(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), spaced=True, end_id=0, max_tokens=2048)


def op5_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm import transcripts as t

    raw = t.transcripts(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return t.render(t.parse(raw)).select("conv_id", "block", "n_turns", "n_lines", "roles", F.sha2("rendered", 256).alias("rendered_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.simhash import near_duplicates

    found = near_duplicates(_docs(spark, sf_dir), shingle=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from gridloom.llm.streamvbyte import round_trip

    return round_trip(_docs(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), spaced=False, end_id=1)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.fingerprints import compare_neighbours

    return compare_neighbours(_docs(spark, sf_dir))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm import language

    docs = _docs(spark, sf_dir)
    found = language.identify(docs, language.fit(docs))
    return found.select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridloom.llm.substring import remove_repeats

    kept = remove_repeats(_docs(spark, sf_dir).select("doc_id", "text"), width=20, joined=True)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from gridloom.llm import substring, urls

    return {"op1_urls": urls.sql(), "op10_substring": substring.sql()}
