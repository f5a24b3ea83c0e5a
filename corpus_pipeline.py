"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir), where docs has the columns of documents,
and works on all that the stage before it kept.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import langid, mixing, packing, simhash, suffixes
from lodestream.llm.common import ship_package, wide_key
from lodestream.session import fresh_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words of a repeated passage.
PASSAGE_WORDS = 51
#: Share of the deduplicated tokens that the mixture may have.
MIX_RATE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, under the one predicted from their text.

    Rejected are texts that are null or without letters. The labels of docs
    train the model; where there are none, languages stay as they are.
    """
    ship_package(spark)
    pieces = langid.sample(docs)
    found = langid.identify(docs.select(*COLUMNS), pieces)
    if not pieces:
        return docs.select(*COLUMNS).filter(r"text RLIKE '\\p{L}'")
    return found.filter("lang_pred <> 'und'").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the one with the smallest id, by its values if ids repeat."""
    ship_package(spark)
    key = wide_key(*COLUMNS)
    groups = simhash.simhash_groups(docs, key=key)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("first")).select("first.key")
    kept = docs.select(*COLUMNS).withColumn("__key", key).join(first.withColumnRenamed("key", "__key"), "__key", "left_semi")
    return kept.dropDuplicates(["__key"]).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of PASSAGE_WORDS words and more that occur elsewhere."""
    ship_package(spark)
    cleaned = suffixes.remove_repeated_words(docs.select(*COLUMNS), PASSAGE_WORDS)
    return cleaned.withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture: sources at their target weights, none more than once."""
    ship_package(spark)
    key = wide_key("doc_id", "text", "lang", "source")
    chosen = mixing.select_mix(mixing.prepared(docs), MIX_RATE, max_epochs=1).select(F.col("mix_key").alias("__key")).distinct()
    return docs.select(*COLUMNS).withColumn("__key", key).join(chosen, "__key", "left_semi").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences."""
    ship_package(spark)
    return packing.pack_texts(docs, limits=packing.FULL_LIMITS, special=True)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("mixing", mixture),
    ("packing", packed),
]

#: Automata, fingerprints and byte windows are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
