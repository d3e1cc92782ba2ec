"""From raw documents to encoded training text in five stages.

Each stage reads what its predecessor wrote. All but the last return the columns of `documents`:

1. language ID: documents that the model rejects go, that is those without a letter (`und`) and those whose best
   language is less likely than half of the least that held-out documents of that language have;
2. MinHash near-dedup: of each group of near-duplicates the document with the smallest id stays, one text of it where an
   id names several, the row without an id only where no other is in the group;
3. PII: spans become the name of their kind in brackets;
4. mixing: sources are brought to their target weights; a document stands as often as the mix takes it, and the one at
   the budget's edge is cut after its last word;
5. BPE: documents become token ids.

Defined cases: null and empty texts have no letter and go in the first stage; a null lang teaches nothing; a null source
is a source; rows with one id are documents of their own throughout; equal rows are one document from the second stage
on, before the mix repeats some; ties go to the smaller id, then to the text of smaller hash; texts of any length are
kept whole; other columns are kept, but by the last stage; an empty table passes all stages.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession

from spanforge.llm import bpe, langid, minhash, mixing, pii
from spanforge.llm.durable import remove, shared_folder
from spanforge.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents that have a letter and a language that is likely enough."""
    return langid.filter_documents(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.one_of_each(docs)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents with personal data replaced by its kind; a null text stays null."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """documents as often as the mix takes them; those without words are not taken."""
    return mixing.expand(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of each document; a null text counts as empty."""
    return bpe.encode_documents(docs, tokenizer_path())


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("pii", redact_pii),
    ("mix", mix_sources),
    ("bpe", encode),
]

#: The learned stages have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each written as Parquet to the shared checkpoint folder and read again. A
    stage's folder goes when the next one is written; the last one holds the result."""
    folder = os.path.join(shared_folder(spark), f"corpus-pipeline-{uuid.uuid4().hex}")
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if done:
            remove(spark, f"{folder}/{done}")
        done = name
    return docs
