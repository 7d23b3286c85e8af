"""From raw documents to packed training sequences: five stages, each by one operator of tallyloom.llm.

A stage gets all rows that the one before it kept, and all but the last return the columns of documents. Stages on an empty
table return an empty one. Columns besides doc_id, text, lang and n_chars pass through unseen, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontam, langid, line_dedup, packing, simhash
from tallyloom.llm.common import drop, save
from tallyloom.llm.queries import table, word_bpe


def held(docs: DataFrame) -> DataFrame:
    """docs as a column row, and its text: no name of an operator's new columns can clash."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is found (null, empty, or without a letter) go. Those without a lang get the predicted one; a stated lang stays."""
    model = langid.train_on_folds(docs.select("doc_id", "text", "lang"))
    found = langid.identify(held(docs), model).where("lang_pred <> 'und'")
    return found.select(*((F.coalesce(F.col("row.lang"), F.col("lang_pred")) if c == "lang" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; every document stays, its text and n_chars changed."""
    out = line_dedup.dedup_lines(held(docs), min_docs=10)
    changed = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return out.select(*(changed[c].alias(c) if c in changed else F.col(f"row.`{c}`") for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar documents (shingles of five words, similarity 0.8) stays."""
    return simhash.keep_one(docs, words=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their places in sequences of 4096 tokens."""
    return packing.pack_documents(docs, word_bpe(), capacity=4096)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup), ("decontamination", decontaminate), ("packing", pack)]

#: No SQL: the stages learn, hash with XXH64 and tokenise. tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = save(docs, f"stage-{name}")
            if before is not None:
                drop(before)
            before = docs
    return docs
