"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes what a stage returns
as Parquet in the shared folder and reads it again as the next stage's documents.  All stages but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import decontaminate, jaccard_join, packing, quality, toxicity
from tidewell.llm._util import read, spread, without, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: rows whose text's probability of the highest grade is under one half go.

    The labels of one fold in five are not used to fit.  Rows are judged by their whole texts alone, so equal texts
    share one fate, a null text is judged as the empty one and a null doc_id changes nothing; a probability of one half
    stays; extra columns, whatever their names, are kept; an empty table gives an empty table.
    """
    return quality.selected(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxicity: rows whose text is predicted toxic (a score of one half or more) go.

    Rows are judged by their whole texts alone, as in ``keep_good``.
    """
    return toxicity.civil(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of the documents that links connect (five words, 0.8), the one with the smallest doc_id stays.

    Every row is judged by its own text, so a unique text stays whatever other rows of its doc_id hold.  Of linked
    texts under one doc_id the one with the smallest hash stays; of rows with equal doc_id and text one stays.
    Texts without words (null and empty ones, too) and rows with a null doc_id link with nothing and stay.  Extra
    columns, whatever their names, are kept; an empty table gives an empty table.
    """
    found = written(jaccard_join.labelled(docs, width=5, percent=80).filter("doc_id is not null").select("doc_id", "text_hash", "root"), "groups")
    counted = written(found.groupBy("doc_id", "text_hash", "root").agg(F.count(F.lit(1)).alias("n")), "counted")
    linked = counted.filter("root is not null")
    first = linked.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    other = spread(linked, first, ["root"]).filter("first.doc_id <> doc_id or first.text_hash <> text_hash")
    gone = other.select("doc_id", "text_hash")
    own = {"doc_id": F.col("doc_id").cast("long"), "text_hash": F.xxhash64("text")}
    repeated = counted.join(gone.hint("merge"), counted["doc_id"].eqNullSafe(gone["doc_id"]) & counted["text_hash"].eqNullSafe(gone["text_hash"]), "left_anti").filter("n > 1").select("doc_id", "text_hash")
    if repeated.isEmpty():
        return without(docs, own, gone)
    once = docs.withColumns({"_id_of_row": own["doc_id"], "_text_of_row": own["text_hash"]})
    twice = once.join(repeated.select(F.col("doc_id").alias("_id_of_row"), F.col("text_hash").alias("_text_of_row")).hint("merge"), ["_id_of_row", "_text_of_row"], "left_semi")
    return without(docs, own, gone.unionByName(repeated)).unionByName(twice.dropDuplicates(["_id_of_row", "_text_of_row"]).select(*(F.col(f"`{c}`") for c in docs.columns)))


def keep_unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: rows whose text holds an item, or nearly, go.

    Every row is judged by its own text, so a clean text stays whatever other rows of its doc_id hold.  Null and empty
    texts hold nothing and stay; extra columns, whatever their names, are kept; an empty table gives an empty table.
    """
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"), by_text=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: the pieces of all documents, with their places in the sequences.

    Every row is a document of its own, also one with a null or repeated doc_id; a null or empty text is a piece that
    holds the end alone; other columns are left out; an empty table gives an empty table.
    """
    return packing.packed(docs, room=4096)


STAGES = [("quality classifier", keep_good), ("toxicity", keep_civil), ("n-gram Jaccard join", keep_distinct), ("benchmark decontamination", keep_unleaked), ("best-fit packing", pack)]

#: SQL can express neither the fitted models nor the tokenizer; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
