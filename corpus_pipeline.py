"""From raw documents to token ids: five stages, each by one operator of ``formweave.llm``.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  All
but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formweave.llm import bpe, language, mixing, ngram_join, secrets
from formweave.llm.catalog import vocabulary
from formweave.llm.common import cut, documents, relieve, remove, semi_join, shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose language is clear; a null lang becomes the one found.

    Null and empty texts, and texts without a letter, have no language and go.  Without any
    language to learn from (no lang is given) nothing can be judged, and all rows stay; with
    a single one every text with a letter is taken for it.  Repeated rows and rows without an
    id are judged like any other; an empty table stays empty.
    """
    relieve(spark)
    model = language.fit(docs)
    if not model:
        return docs.select(*COLUMNS)
    found = language.classify(docs, model).filter("accepted")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near duplicates (five words, 0.8): that of the
    smallest doc_id, of rows that share it the one whose columns have the least hash.

    Rows are known by their columns and not by their id alone, so rows that share an id
    stay if their texts differ.  Null and empty texts, texts without words, and rows
    without an id are in no class and stay, repeated or not.
    """
    relieve(spark)
    docs = docs.select(*COLUMNS)
    row = F.xxhash64(*[F.struct(F.col(c).alias("v"), F.lit(i).alias("i")) for i, c in enumerate(COLUMNS)])
    keyed = docs.withColumn("row_key", row)
    classes = cut(ngram_join.classes(keyed, k=5, num=80, den=100, carry=("row_key",)))
    first = classes.filter("class_key IS NOT NULL").groupBy("class_key").agg(F.min(F.struct("doc_id", "row_key"))["row_key"].alias("row_key"))
    # of rows that are equal in all columns one stays, so these few are told apart
    equal = classes.filter("class_key IS NOT NULL").groupBy("row_key").count()
    kept = cut(first.join(equal, "row_key"))
    free = cut(classes.filter("class_key IS NULL").select("row_key").distinct())
    out = semi_join(keyed, kept.filter("count = 1").select("row_key").unionByName(free), "row_key")
    repeated = kept.filter("count > 1").select("row_key")
    if repeated.take(1):
        out = out.unionByName(semi_join(keyed, repeated, "row_key").dropDuplicates(["row_key"]))
    return out.select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts ``[SECRET]`` in the place of every span that the scan reports; n_chars follows.

    All rows stay, repeated ones too; a null text stays null and has no n_chars.
    """
    relieve(spark)
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row for each pass over a document that it takes.

    Null texts and texts without words have nothing to take and go.  A null source is a
    source.  Rows that share an id are rows of their own; an empty table stays empty.
    """
    relieve(spark)
    return mixing.mixed(docs.select(*COLUMNS)).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text: doc_id, n_tokens, ids.

    A null text is the empty text and has no ids.  Rows that repeat an id stay; an empty
    table stays empty.
    """
    relieve(spark)
    return bpe.encode(docs, vocabulary())


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: SQL can express neither compression nor the pseudorandom mix nor BPE; the tests hold
#: the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet and read again.  What a
    stage has read is deleted when its own rows are written; the last stage's rows stay."""
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
        docs = spark.read.parquet(f"{base}/{i}")
        if i:
            remove(spark, f"{base}/{i - 1}")
    return docs
