"""From documents to training rows: quality rules, near and substring dedup, mixing, encoding.

Every stage takes nulls in any column, empty and very long texts, repeated rows and empty tables, with the results that its
operator's docstring states; the columns of docs come back under their own names, whatever these are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoreach.llm.mixing import poisson_mix
from isoreach.llm.neardup import near_duplicates
from isoreach.llm.pieces import encode
from isoreach.llm.quality import quality_rules
from isoreach.llm.shared import Stash, table
from isoreach.llm.substrings import repeated_substrings


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the outlier bound keep. Null, empty and short texts go; a null lang or
    source is a group of its own; repeated rows stay or go together; a distance on the bound stays."""
    return quality_rules(docs).where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each class of near duplicates. Rows with a null doc_id and empty texts stay; repeated
    rows of the doc_id that stays all stay, and the next stage removes their texts as copies of one another."""
    return near_duplicates(docs).where("kept").select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that are found twice; a text of which nothing is left goes, one that was null or
    empty before stays. n_chars is that of what is left. Characters cut in two go from the text."""
    left = repeated_substrings(docs).where("n_removed = 0 or kept_text <> ''")
    text, n = F.col("kept_text"), F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    cut = F.col("n_removed") > 0
    return left.select(*[F.when(cut, {"text": text, "n_chars": n}[c]).otherwise(F.col(c)).alias(c) if c in ("text", "n_chars") else F.col(c) for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents that bring every source to the same share, globally shuffled. A null source is a source;
    a null doc_id draws as the empty string; repeated rows draw alike."""
    return poisson_mix(docs).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the whole texts; a null or empty text has none."""
    return encode(docs.select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", "n_tokens", "round_trip", "ids")


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mix_sources", mix), ("encode", tokens)]

#: SQL cannot express four stages; tests compare near_dedup, substring_dedup and the rows, copies and ids of run() with brute
#: force, and the verdicts of quality with exact concentration steps on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = Stash(stage(spark, docs, sf_dir), name).df
    return docs
