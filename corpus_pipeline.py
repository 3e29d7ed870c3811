"""A corpus pipeline of five stages, each by one of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lakelens.llm.common import stash, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    from lakelens.llm.toxicity import fit, score

    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).filter("predicted = 0").select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or a calibrated cutoff rejects go."""
    from lakelens.llm.quality import judge

    return judge(docs, table(spark, sf_dir, "labels")).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by links (five-word shingles, a similarity of 0.8 or more) the one with the smallest id stays."""
    from lakelens.llm.jaccard_join import jaccard_components

    gone = jaccard_components(docs, 80, 100, 5).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced; n_chars follows the text."""
    from lakelens.llm.pii import replace_pii
    from lakelens.llm.queries import PII_KEY

    return replace_pii(docs, PII_KEY).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence."""
    from lakelens.llm.packing import pack
    from lakelens.llm.queries import PACK_TOKENIZER, PACK_VOCABULARY

    return pack(docs, PACK_TOKENIZER, PACK_VOCABULARY)


STAGES = [("toxicity", toxicity), ("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("pii", pii), ("packing", packing)]

#: Learned and iterative stages have no SQL form; tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = stash(docs, f"pipeline-{n}")
    return docs
