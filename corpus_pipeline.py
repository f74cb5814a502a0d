"""From raw documents to shards of training text, in five stages; each works on all that the one before kept.

1. quality: documents predicted to be of low quality go;
2. near_duplicates: one document of each group of near copies stays (five-word shingles, similarity 0.8);
3. decontamination: documents that contain a benchmark item go;
4. mixing: sources are taken in proportion to their weights, some documents more than once, others not at all;
5. sharding: what is left is put into shards of nearly equal bytes.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession

from playtrace.llm import decontamination, jaccard, mixing, quality, sharding
from playtrace.llm.common import table
from playtrace.session import drop_tables, durable, ship, tables_in


_tables: dict[int, str] = {}  # by the number of a stage, the folder of its intermediate tables


def stage(number: int):
    """A stage, which begins by dropping the intermediate tables of the one before: its result has been written by then."""

    def wrap(fn):
        @functools.wraps(fn)
        def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            ship(spark)
            if number - 1 in _tables:
                drop_tables(spark, _tables.pop(number - 1))
            _tables[number] = f"stage-{number}-{uuid.uuid4().hex}"
            with tables_in(_tables[number]):
                return fn(spark, docs, sf_dir)

        return call

    return wrap


@stage(1)
def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


@stage(2)
def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


@stage(3)
def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


@stage(4)
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


@stage(5)
def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.sharded_documents(docs)


STAGES = [("quality", good), ("near_duplicates", unique), ("decontamination", clean), ("mixing", mixed), ("sharding", sharded)]

#: A trained classifier and word shingles have no SQL; tests/llm/test_queries.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, apply) in enumerate(STAGES):
        docs = apply(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = durable(docs)
    return docs
