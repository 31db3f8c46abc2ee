"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns
of documents; their decisions are in the rows and texts that they return.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.line_dedup import line_dedup
from attestry.llm.mixing import mix
from attestry.llm.ngram_join import keep_one
from attestry.llm.packing import pack
from attestry.llm.quality import quality_rules
from attestry.llm.queries import MIX, domain_labels
from attestry.llm.shared import materialise


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, n_chars in step with the text."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    return docs.select(*columns)


# All stages: an empty table gives an empty one; columns keep their names, whatever they are, and their values but for
# text and n_chars where a stage changes the text; rows without an id are documents like others.


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. A null or empty text has no words and goes; repeated rows stay together."""
    own = F.struct(*[F.col(c) for c in docs.columns])
    kept = quality_rules(docs.select(own.alias("_docs"), "text")).where("kept")
    return kept.select(*[F.col("_docs")[c].alias(c) for c in docs.columns])


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many share; one document keeps each such line. A null text stays null; a
    document without an id holds no line for others and loses none; rows that repeat an id are one holder."""
    return _counted(line_dedup(docs, bitmap_col=None), docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more of its five-word shingles: the one of the least
    id, one without an id last. Texts without words are linked with nothing; rows alike in id and text become one."""
    return keep_one(docs, n=5, threshold=(80, 100))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights ask for; good documents stay once each, the other domains shrink to their
    weights. A null or empty text has no tokens and stays once; rows alike in id and text are kept or dropped together."""
    return mix(docs, domain_labels(spark, sf_dir), MIX, anchor="good")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences. A null text is the end id alone; each row is packed for itself."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: SQL can express neither the classifier and its fitted rates nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what each keeps is written to the shared folder and read again. A stage's table
    goes when the next one's is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), docs)
    return STAGES[-1][1](spark, docs, sf_dir)
