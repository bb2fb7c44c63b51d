"""The corpus pipeline: raw documents to token files, one operator a stage.

Every stage takes what its predecessor kept, as a written table, and returns a DataFrame; all but the last
return the columns of documents. Stages keep clean documents: language ID drops texts without a letter or without a
language that explains them, near-dedup all but one document of a group, decontamination documents that hold a test item.

Defined results: null, empty and wordless texts go with language ID; null ids, sources and langs are kept as null (a null
source is a source of its own in the mix); an equal row is a copy like any other, so near-dedup keeps one; a null or empty benchmark item matches nothing;
texts pass whole, but for the last block of a source, which the mix ends inside its document; columns beside those of documents pass through to the
last stage whatever their names; empty tables give no rows, and an empty benchmark removes nothing.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluice.llm import decontam, langid, mixing, simhash, tokens
from sluice.llm.queries import table, tokenizer_path
from sluice.llm.tables import Tables


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.write_and_read(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("simhash_near_dedup", simhash_near_dedup), ("benchmark_decontamination", benchmark_decontamination),
          ("source_mixing", source_mixing), ("token_output", token_output)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's table is dropped once the next one is written."""
    docs, tables, last = table(spark, sf_dir, "documents"), Tables(spark, "pipeline"), None
    for name, stage in STAGES:
        docs = tables.write(stage(spark, docs, sf_dir), name)
        if last:
            tables.drop(last)
        last = name
    return docs


QUERIES = {"pipeline": run}
#: Code lengths, 64-bit fingerprints and entropy-coded files are not expressible in SQL; tests/llm holds the brute-force version.
ORACLE_SQL = None
ORACLES: dict[str, str] = {}
