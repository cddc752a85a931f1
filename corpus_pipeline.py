"""The corpus pipeline: five stages over documents, each a Parquet table that the next one reads.

run(spark, sf_dir) applies STAGES to documents. SQL expresses none of the learned stages, so ORACLE_SQL
is None. Tests hold the toxicity, near-duplicates and mixing stages against brute force on small tables, the language
stage against texts of learned and unlearned languages, the last against the tokenizers library.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lamina.llm import bpe_codec, common, language_id, mixing, near_dedup, toxicity

#: Columns of documents, which all stages but the last return.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes that has no letter, or has MIN_LETTERS or more and is less like every learned language than
#: MIN_COSINE, which is over three standard deviations of the cosine of unrelated profiles of 1024 dimensions.
#: Shorter texts say too little about their language to go by the cosine. Languages that share letters are alike by
#: chance up to about 0.2, so a text of MIN_GRAMS or more distinct trigrams goes below MIN_COSINE_LONG; a text of fewer,
#: such as a word repeated, can lie as low in its own language.
MIN_COSINE, MIN_LETTERS, MIN_COSINE_LONG, MIN_GRAMS = 0.1, 40, 0.25, 150
#: A document goes whose toxicity score reaches this.
MAX_TOXICITY = 0.3

ORACLE_SQL = None


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose profile is near a language's prototype; null texts, texts without letters and texts unlike
    every learned language go. All go where no language was learned."""
    docs = docs.select(*COLUMNS)
    names, prototypes = language_id.train(docs.where(~common.held_out("doc_id", 4, 2)))
    found = language_id.identify(docs, names, prototypes)
    letters = F.regexp_count("text", F.lit(r"\p{L}"))
    least = F.when(F.col("grams") >= MIN_GRAMS, MIN_COSINE_LONG).otherwise(MIN_COSINE)
    near = (F.col("score") >= least) | (letters < MIN_LETTERS)
    return found.where((F.col("lang_pred") != language_id.UNDETERMINED) & near).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the multiple-instance model finds toxic."""
    docs = docs.select(*COLUMNS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~common.held_out("doc_id", 4, 2))
    found = toxicity.score(docs, toxicity.train(docs, labels), MAX_TOXICITY)
    return found.where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least doc_id of each class of near-duplicates; of that id's texts in the class, the first
    by a hash. An id whose texts are in several classes may stay more than once. Rows of null id stay."""
    return near_dedup.first_of_classes(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it as a whole, 0 to 3 times.

    Rows of equal id and text share their copies evenly."""
    docs = docs.select(*COLUMNS)
    taken = mixing.mix_sources(docs).groupBy(F.col("doc_id").alias("_id"), "order").agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows")).where("_copies > 0")
    rows = docs.withColumn("_order", mixing.shuffling(docs))
    rows = rows.join(taken, rows["doc_id"].eqNullSafe(taken["_id"]) & (rows["_order"] == taken["order"]))
    rows = rows.withColumn("_n", F.row_number().over(W.partitionBy("_id", "order").orderBy("doc_id")))
    own = F.floor(F.col("_copies") / F.col("_rows")) + F.when(F.col("_n") <= F.col("_copies") % F.col("_rows"), 1).otherwise(0)
    rows = rows.withColumn("_own", own.cast("int")).where("_own > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_own"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    return bpe_codec.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", keep_languages), ("toxicity", drop_toxic), ("near-duplicates", drop_near_duplicates), ("mixing", mix), ("encoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to shared storage and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            common.discard(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
