"""Corpus preparation in five stages: quality rules, near duplicates, benchmark, mixing, token files.

Every stage takes (spark, docs, sf_dir) and works on all documents that its
predecessor kept.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import decontaminate, jaccard_join, mixing, quality_rules, token_files
from strata.llm.common import folded, materialise, unfolded
from strata.llm.queries import WORD_END_ID, word_tokenizer
from strata.session import scratch_path

#: Similarity search, a fitted classifier and a tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None
#: Posterior of the clean domain from which a document is certain to stay in the mix.
SURE_CLEAN = 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that policy ``v2`` of the rule ledger keeps."""
    ledger = quality_rules.rule_ledger(folded(docs, text=F.col("text")))
    return unfolded(quality_rules.apply_policy(ledger, "v2").where("kept"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return jaccard_join.one_per_class(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any 10-word window of a benchmark item."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at the rates that give the domains their target shares of the kept tokens.

    Rates go from 0 to 1 and no document is repeated.  Those of clean posterior ``SURE_CLEAN`` or more all stay; the
    others are thinned out as far as the shares ask for it (a domain with too few tokens beside them stays whole).
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = mixing.fit_domains(mixing.domain_labels(docs, labels), mixing.DOMAINS)
    rows = folded(docs, doc_id=F.col("doc_id"), text_hash=F.xxhash64("text"), text=F.col("text"))
    scored = materialise(spark, mixing.memberships(rows, model).drop("text"), "members")  # texts are scored once
    shares = [mixing.WEIGHTS[d] for d in mixing.DOMAINS]
    sure = F.col("posterior")[mixing.DOMAINS.index("clean")] >= SURE_CLEAN
    fit = mixing.fit_shares(scored.select("tokens", "posterior"), shares, sure)
    rated = mixing.with_rates(scored.withColumn("_gap", mixing.share_gaps(shares)), fit.steps, posterior="_gap",
                              keys=("doc_id", "text_hash"), upper=1.0, held=sure)
    return unfolded(rated.where("copies > 0"), docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the remaining documents, and their index (doc_id, start, n_tokens, ids_crc32)."""
    path = scratch_path(spark, "corpus")
    token_files.write_token_files(docs, path, word_tokenizer(), WORD_END_ID, word_by_word=True)
    return token_files.token_index(spark, path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("mixing to target weights", mix),
    ("token files", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; each is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(spark, docs, f"stage{k + 1}")
    return docs
