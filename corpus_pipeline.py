"""A corpus pipeline over `documents`: each stage takes what the one before kept, written as Parquet and read again.

Defined cases, for all stages: a null text counts as empty and stays null until the last stage; rows without a doc_id are judged by
themselves and stay; no rows give no rows; columns of any name beside doc_id and text pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from steadyframes.llm import bpe, decontaminate, jaccard, pii, toxicity
from steadyframes.llm.components import new_folder


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects, by their language's threshold, go; equal texts of a language share a verdict."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    plain = docs.withColumnsRenamed(names := {c: f"__{c}" for c in docs.columns if c in ("score", "threshold", "toxic")})
    kept = toxicity.score(plain, model).where("not toxic").drop("score", "threshold", "toxic")
    return kept.withColumnsRenamed({b: a for a, b in names.items()}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest doc_id: shingles of five words, similarity 0.8 or
    more. Documents without words are nobody's duplicates; a row that repeats an id and text stays once."""
    return jaccard.keep_first(docs, words=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items are cut out; documents that are mostly such passages go. Repeated rows fare alike."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become [KIND]. Repeated rows fare alike."""
    return pii.redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids, with a digest of the text that they decode to: doc_id, lang and source, n_tokens, token_ids and
    decoded_sha256 only, as ids take the place of the text and its other columns. A null text has no ids."""
    return bpe.encode_table(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxic),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("PII", personal_data),
    ("byte-level BPE", token_ids),
]

#: The classifier and the field have no SQL form; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Between stages the rows lie as Parquet in the shared checkpoint folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
