"""From raw documents to token counts: quality rules, near duplicates, benchmark text, personal data, tokens.

Each stage takes the documents its predecessor kept and returns documents with the same columns; the last one
returns what the token encoding has to say about each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import public_tokenizers

from panelspark.llm import bayes_jaccard, cgk_decontam, crf_pii, decision_list, shared_viterbi
from panelspark.llm.common import read
from panelspark.operators.keys import cut_lineage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned list reject."""
    rules = decision_list.learn(decision_list.labelled(docs, read(spark, sf_dir, "labels")))
    return decision_list.quality_rules(docs, rules).where("_kept").select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar documents, the one with the smallest id."""
    return bayes_jaccard.one_per_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return cgk_decontam.clean_documents(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    out = crf_pii.redacted(docs, crf_pii.train(crf_pii.training_runs(docs, "doc_id", "text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: number and checksum of its piece ids, and whether they decode to the text."""
    return shared_viterbi.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality rules", quality), ("near duplicates", near_duplicates), ("benchmark decontamination", decontamination),
          ("personal data", personal_data), ("sentencepiece", tokens)]

# learning, a random walk and a tokenizer have no counterpart in SQL; tests hold each stage against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut_lineage(docs)
    return docs
