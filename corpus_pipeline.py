"""A corpus pipeline over `documents`: language ID, line dedup, near-dedup, decontamination, mixing. Counted as part of lodestrata.llm.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import decontam, langid, lines, mixing, neardup
from lodestrata.llm.common import drop_stored, stored, table, word_count

#: A document is rejected without letters, or if it is less like the language found than this: natural texts of a learned language are above -0.4, of others below -0.8.
LEAST_LIKENESS = -0.6
#: Up to so many rows (16 bytes each) a list of documents to drop is broadcast; a longer one is shuffled.
MOST_BROADCAST = 1_000_000


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less the rows whose (doc_id, hash of the text) is listed in gone (id, th)."""
    gone = F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone
    # whatever the columns of docs are called, they travel as one
    left = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("text").alias("_th"))
    return left.join(gone, F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("_th") == F.col("th")), "left_anti").select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay; those without letters, or like no learned language, go. Null texts go, an empty table stays empty, equal rows share their fate, columns of any name stay. With no labelled row nothing can be learned, and all documents with a letter stay."""
    model = langid.fit(docs)
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    told = langid.identify(docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), "text"), model, keep=["id", "th"])
    gone = stored(told.where((F.col("lang_pred") == "und") | (F.col("likeness") < LEAST_LIKENESS)).select("id", "th"), "language-gone")  # read twice: counted, and dropped
    return _without(docs, gone)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later near-copies of a line go from the texts; a document that loses its last word goes. n_chars follows the text. Null texts stay null; ties in doc_id go by the hash of the text; columns of any name stay."""
    out = lines.dedup_lines(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text"))
    fields = [F.col("text") if c == "text" else F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"row.{c}") for c in docs.columns]
    return out.where((F.col("lines_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*fields)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays (of several linked texts with that id the one with the smallest hash), of rows with equal id and text one. Other rows stay, whatever their ids."""
    told = neardup.near_duplicates(docs.select("doc_id", "text"))  # a table
    per = stored(told.where("kept").groupBy("class_id", F.col("doc_id").alias("id"), F.col("text_hash").alias("th")).count(), "near-dedup-kept")
    first = per.where("class_id IS NOT NULL").groupBy("class_id").agg(F.min("th").alias("first"), F.count("*").alias("n")).where("n > 1")
    linked = per.join(first, "class_id").where("th <> first").select("id", "th")
    left = _without(docs, told.where(~F.col("kept")).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("th")).distinct().unionByName(linked))
    again = per.where("count > 1").select("id", "th")
    if not again.limit(1).count():
        return left
    rows = left.select(F.struct(*left.columns).alias("row"), F.xxhash64("text").alias("_th"))
    same = F.col("row.doc_id").eqNullSafe(F.col("id")) & (F.col("_th") == F.col("th"))
    once = rows.join(again, same, "left_semi").groupBy(F.col("row.doc_id").alias("id"), "_th").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
    return rows.join(again, same, "left_anti").select("row.*").unionByName(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; null and empty texts hold none and stay, equal rows share their fate, a null doc_id is an id like others."""
    found = decontam.decontaminate(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return _without(docs, found.select(F.col("doc").alias("id"), "th"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is mixed to the target weights; documents of which no word is taken go. mix_taken counts words, repeats included. Null and empty texts have none, and go; columns called mix_size or mix_taken are replaced."""
    mixed, _ = mixing.mix(docs, word_count(F.col("text")), F.array("source"))
    return mixed.where("mix_taken > 0").drop("mix_in")


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("mixing sources", mixing_sources)]

#: Language ID is learned, which SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), "pipeline-" + name.lower().replace(" ", "-"))
        drop_stored(before)  # nothing for the documents themselves
    return docs
