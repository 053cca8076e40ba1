"""From raw documents to packed training sequences: five stages, each one operator over all rows its predecessor kept."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeworks.llm import classifier, decontaminate, lines, near, packing
from gaugeworks.llm.frames import kept_table, table
from gaugeworks.llm.queries import crc_mod
from gaugeworks.session import prepare

KEEP_FROM = 0.3


def aside(docs: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and all columns in the struct `_doc`, where no operator's own column can replace them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *needed)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the classifier rejects go; it learns from the labels whose crc32(doc_id) mod 5 is not 0."""
    model = classifier.fit(docs, table(spark, sf_dir, "labels").where(crc_mod(5) != 0))
    return classifier.score(aside(docs, "text"), model).where(F.col("_score") >= KEEP_FROM).select("_doc.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the lines that at least three documents hold, except in the last of these; every document stays."""
    own = "_lines"
    while own in docs.columns:  # a column of that name keeps its values under a free one meanwhile
        own += "_"
    out = lines.dedup_lines(docs.withColumnRenamed("_lines", own), batches=4)
    new = {"text": F.col("_lines.kept"), "n_chars": F.char_length("_lines.kept").cast(docs.schema["n_chars"].dataType), "_lines": F.col(own)}
    return out.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every class of near copies stays. Rows that repeat an id and its text are one
    document; rows with a null id stay, as nothing tells them apart."""
    known = docs.where("doc_id is not null")
    first = near.near_classes(known).where("id = class_id").select(F.col("id").alias("doc_id")).distinct()
    return known.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id is null")).select(docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth of the words or more go."""
    return decontaminate.decontaminate(aside(docs, "text"), table(spark, sf_dir, "benchmark")).where(~F.col("_scan.contaminated")).select("_doc.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences of all documents that are left, with their tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).withColumnRenamed("id", "doc_id")


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("n-gram Jaccard join", one_of_each), ("benchmark decontamination", decontaminated), ("packing", packed)]

#: The classifier can't be stated in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result but the last is written to the shared folder and read again."""
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
