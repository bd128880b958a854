"""A pipeline over the documents table; each stage calls one operator of gridloom.llm on all that the stage before kept.

1. language: documents without a letter, or of no language that the network is at all sure of, go;
2. near_duplicates: texts link if their sets of five-word shingles have a Jaccard index of 0.8 or more. Candidates are
   what the SimHash operator links (64 bits, radius 3, exclusive-or and bit counts in tiles) and, for pairs beyond that
   radius, sets that share a key of least hashes; all are decided by the sets. Of each connected group one row stays,
   that of the least id, null last, and of the least text hash within an id; rows of null or repeated ids go only if
   their own text has a group with another row that stays;
3. substrings: words in 20-word windows that also start earlier are cut out, and documents left empty by it go;
4. mixing: documents are sampled by probabilities raked to tempered source, language and topic shares;
5. packing: the pieces of all documents with their places in sequences of 2048 tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import language, mixing
from gridloom.llm.common import stored
from gridloom.llm.jaccard import near_duplicates, text_key
from gridloom.llm.packing import packed
from gridloom.llm.substring import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least pooled probability of the predicted language.
LEAST_SCORE = 0.5
#: Words that a worker remembers in a stage: fewer than an operator alone would, as the stages' heaps add up.
MEMO = 150_000


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = language.identify(docs, language.fit(docs), *COLUMNS[1:])
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = near_duplicates(docs)
    # null ids last; of rows that share id and text any one stays, as they are one document
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("_null"), F.col("doc_id").alias("_id"), F.col("text_key").alias("_text"))).alias("least")).select("least.*")
    keyed = docs.select(*COLUMNS, F.col("doc_id").cast("long").alias("_id"), text_key().alias("_text"))
    chosen = keyed.alias("k").join(first.alias("f"), F.col("k._id").eqNullSafe(F.col("f._id")) & (F.col("k._text") == F.col("f._text")), "left_semi")
    return chosen.dropDuplicates(["_id", "_text"]).select(*COLUMNS)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = remove_repeats(docs.select(*COLUMNS), width=20, size_mb=5.0)
    whole = F.col("n_removed") == 0
    return cut.where(whole | (F.col("n_removed") < F.col("n_words"))).select("doc_id", F.when(whole, F.col("text")).otherwise(F.col("kept_text")).alias("text"), "lang", "source", F.when(whole, F.col("n_chars")).otherwise(F.char_length("kept_text")).cast("long").alias("n_chars"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    dims = ["source", "lang", "topic"]
    rows = docs.select(*COLUMNS, mixing.topic(F.col("text")).alias("topic"), mixing.n_tokens(F.col("text")).alias("n_tokens"))
    cells = mixing.tally(rows, dims)
    mixed = mixing.mix(rows, mixing.natural(cells, dims, temperature=1.1), budget_share=0.95, cells=cells)
    return mixed.where("kept").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(docs, public_tokenizers.path("byte_bpe_50k.json"), spaced=True, end_id=0, max_tokens=2048, memo=MEMO)


STAGES = [("language", language_stage), ("near_duplicates", near_duplicate_stage), ("substrings", substring_stage), ("mixing", mixing_stage), ("packing", packing_stage)]
#: Networks, fingerprints and packing are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
