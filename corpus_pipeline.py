"""Training corpus from raw documents: quality, near duplicates, benchmark leaks, source mix, token ids.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows it is given. All but the last
return the columns of ``documents``; ``run`` writes each result and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.decontamination import contamination
from tallyloom.llm.jaccard import similarity_classes
from tallyloom.llm.mixing import mix_sources, word_count
from tallyloom.llm.quality import learn_quality, quality_score
from tallyloom.llm.settings import GOOD, VOCABULARY, fold_of, word_vocabulary
from tallyloom.llm.token_output import token_output
from tallyloom.session import frozen, scratch
from tallyloom.sources.tables import Tables

#: Fitted models and hash orders are not SQL.
ORACLE_SQL = None


def _keyed(docs: DataFrame) -> DataFrame:
    """Whole rows packed beside what names a document, so that no column of ``docs`` can clash."""
    text_hash = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    return docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_id"), text_hash.alias("_hash"))


def _names(found: DataFrame) -> DataFrame:
    return found.select(F.col("doc_id").alias("_rid"), F.col("text_hash").alias("_rhash"))


_ON_DOCUMENT = "_id <=> _rid and _hash = _rhash"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    labels = Tables(spark, sf_dir).labels
    model = learn_quality(docs, labels, learn=lambda c: fold_of(c) != 0)
    return docs.filter(quality_score(model, "text") >= GOOD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: the smallest id, then the smallest text hash.

    Of rows equal in id and text one stays. Documents without words are similar to nothing and stay.
    """
    classes = similarity_classes(docs, words=5, percent=75).filter("group is not null")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    chosen = _names(classes.groupBy("group").agg(F.min(order).alias("first")).select("first.*"))
    single = _keyed(docs).join(chosen, F.expr(_ON_DOCUMENT), "left_semi").dropDuplicates(["_id", "_hash"]).select("row.*")
    wordless = docs.filter(~F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)))
    return single.unionByName(wordless)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no ten words of a benchmark item, nor a whole shorter item."""
    found = contamination(docs, Tables(spark, sf_dir).benchmark, span=10)
    leaks = _names(found.filter(F.size("hits") > 0)).distinct()
    return _keyed(docs).join(leaks, F.expr(_ON_DOCUMENT), "left_anti").select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    mixed = mix_sources(docs, doc_id="doc_id", source="source", size=word_count("text"))
    return mixed.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("_copy")).select("row.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token ids of the corpus in document order; returns what the files hold per document."""
    return token_output(docs, scratch(spark, "token-blocks"), tokenizer=word_vocabulary(), vocabulary=VOCABULARY, end_id=1)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Tables(spark, sf_dir).documents
    for name, stage in STAGES[:-1]:
        docs = frozen(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
