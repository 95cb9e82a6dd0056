"""A corpus pipeline of five llm operators, each stage working on what the one before kept.

Every stage takes (spark, docs, sf_dir); ``run`` writes each result as Parquet into the shared folder
and reads it back as the next one's documents. All but the last return the columns of ``documents``.

Defined results, for every stage: columns of ``docs`` beyond these five are ignored, so their names
can't clash; an empty table gives an empty result; texts of any length are read whole; repeated rows,
ids among them, are treated alike. What nulls give is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factlake.llm import mixing, toxicity
from factlake.llm.near_dedup import near_duplicates
from factlake.llm.queries import MODEL
from factlake.llm.sentencepiece_sampling import sample_encode
from factlake.llm.substring_dedup import remove_repeated_spans
from factlake.storage import written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score, learned from the labelled ones among them, is below 0.5.

    Null and empty texts score what the bias gives; a null id never trains; where no labelled document
    can train, nothing is known to be toxic and every document stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~toxicity.held_out())
    model = toxicity.fit(docs, labels, "doc_id", "text", "toxic", toxicity.Settings())
    if not len(model.index) and not model.bias:
        return docs.select(*COLUMNS)
    scored = toxicity.score(docs.select(*COLUMNS), model, score_col="score")
    return scored.filter("score < 0.5").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates.

    Null and wordless texts and rows without an id are in no group and stay.
    """
    gone = near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the spans that an earlier one has; untouched texts stay as they are.

    A null text stays null; a row without an id keeps all its words.
    """
    out = remove_repeated_spans(docs, carry=["text", "lang", "source", "n_chars"])
    same = F.col("n_removed") == 0
    text = F.when(same, F.col("carried.text")).otherwise(F.col("text"))
    chars = F.when(same, F.col("carried.n_chars")).otherwise(F.length("text").cast("long"))
    return out.select(
        F.col("id").alias("doc_id"), text.alias("text"), "carried.lang", "carried.source", chars.alias("n_chars")
    )


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, in the order of its slots; the last one of a source may be cut.

    A document stands where its first words do, so rows in order, part file by part file, hold each
    source in nearly its proportion. Null and wordless texts have no words to take and go; a null source
    is one of its own; documents without an id stand where a hash of their text puts them.
    """
    documents, pieces = mixing.mix_sources(docs, carry=["text", "lang", "n_chars"])
    copies = pieces.groupBy("row", "epoch").agg(F.sum("n_words").alias("taken"), F.min("slot").alias("slot"))
    taken = documents.join(copies, "row")
    words = F.split(F.btrim("carried.text", F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+")
    head = F.array_join(F.slice(words, F.lit(1), F.col("taken").cast("int")), " ")
    whole = F.col("taken") == F.col("size")
    text = F.when(whole, F.col("carried.text")).otherwise(head)
    cut = taken.select(F.col("id").alias("doc_id"), text.alias("text"), "carried.lang", "source", "carried.n_chars", whole.alias("whole"), "slot", "row", "epoch")
    chars = F.when(F.col("whole"), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return cut.withColumn("n_chars", chars).orderBy("slot", "row", "epoch").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document left, in one row: the first, and the other in ``more``.

    Null texts have one empty segmentation; rows with one id use the same random numbers.
    """
    return sample_encode(docs, MODEL, k=2, together=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("near duplicates", drop_near_duplicates),
    ("substring dedup", drop_repeated_spans),
    ("mixing", mix),
    ("sentencepiece", encode),
]

#: Scores and sampled segmentations can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
