"""One registered query per operator: ``op<N>_<name>(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import (chosen_path, decontaminate, hard_negatives, jaccard_join, line_dedup, merkle, mixing, pii, pitman_yor,
               quality_rules, token_counts, token_files, toxicity)
from .common import materialise


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WORD_END_ID = 2


def word_tokenizer() -> str:
    """Path of the public word tokenizer (49k ids); it drops white space and never joins across it."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words inside 10-word benchmark windows and the items they come from."""
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        (F.col("n_hit") > 0).alias("contaminated"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per line of every document: its tokens, from one encoding of the whole text."""
    counted = token_counts.line_tokens(_table(spark, sf_dir, "documents"), word_tokenizer(), rule="most", word_by_word=True)
    return counted.select("doc_id", "n_tokens", F.col("section").alias("line"), "start", "stop",
                          F.col("tokens").cast("bigint").alias("line_tokens"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: probabilities of the severity grades, expected severity, and toxic from grade 1."""
    docs = _table(spark, sf_dir, "documents")
    graded = materialise(spark, toxicity.graded_labels(docs, _table(spark, sf_dir, "labels")), "graded")
    model = toxicity.fit_severity(graded, toxicity.GRADES)
    scored = toxicity.severity(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", F.col("at_least")[0].alias("p_toxic"), F.col("at_least")[1].alias("p_severe"),
                         "expected_severity", "grade", (F.col("at_least")[0] >= 0.5).alias("toxic"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its near-duplicate class and its number of links (5 words, similarity 0.8)."""
    return jaccard_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, read back from the written ORC files: start, number and checksum of its token ids."""
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path, word_tokenizer(), WORD_END_ID,
                                  word_by_word=True)
    return token_files.token_index(spark, path)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: domain posteriors, fitted rate and copies at the target token weights."""
    docs = _table(spark, sf_dir, "documents")
    labelled = mixing.domain_labels(docs, _table(spark, sf_dir, "labels"))
    model = mixing.fit_domains(labelled, mixing.DOMAINS)
    members = materialise(spark, mixing.memberships(docs.select("doc_id", "text"), model)
                          .select("doc_id", F.xxhash64("text").alias("text_hash"), "tokens", "posterior"), "members")
    total = members.agg(F.sum("tokens")).first()[0] or 0
    fit = mixing.fit_rates(members, [mixing.WEIGHTS[d] * total for d in mixing.DOMAINS])
    rated = mixing.with_rates(members, fit.steps, keys=("doc_id", "text_hash"))
    return rated.select("doc_id", "tokens", *[F.col("posterior")[k].alias(f"p_{d}")
                                              for k, d in enumerate(mixing.DOMAINS)], "rate", "copies",
                        F.lit(fit.met).alias("targets_met"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: measurements, failure bits and the verdict of policy ``v2``."""
    ledger = quality_rules.rule_ledger(_table(spark, sf_dir, "documents"))
    base = F.col("fail_bits").bitwiseAND(F.lit(quality_rules.mask_of("v1"))) != 0
    return (quality_rules.apply_policy(ledger, "v2")
            .select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    base.alias("base_failed"), "kept", "fail_bits"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, those dropped as copies or near copies of earlier ones, and the kept line numbers."""
    report = line_dedup.line_report(_table(spark, sf_dir, "documents"))
    return report.select("doc_id", "n_lines", "n_exact", "n_near", "n_kept",
                         F.array_join(F.col("kept").cast("array<string>"), ",").alias("kept_lines"))


#: The key of the registered query; a production run passes a secret of its own.
SURROGATE_KEY = "registered query"


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the text with surrogates in place of personal data, and where they are."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, SURROGATE_KEY).select(
        "doc_id", F.size("entities").cast("bigint").alias("n_entities"), "entities", "text")


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: base and model log10 probability; learned from the documents that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    model = pitman_yor.train(docs.where(~held_out))
    return pitman_yor.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        "base_score", "score", F.lit(model.settled).alias("settled"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its leaf, digests up to the root, its proof, and whether a copy with some texts lowered verifies."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    docs = _table(spark, sf_dir, "documents")
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    own = merkle.leaf(*rest, F.col("text"))
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    claimed = F.when(tampered, merkle.leaf(*rest, F.translate("text", upper, lower))).otherwise(own)
    proved = merkle.manifest(docs, F.col("lang"), F.col("doc_id"), own, claimed=claimed)
    folded = proved.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root",
                           merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
                           merkle.folded_root(F.col("claimed"), F.col("proof")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its near-duplicate component (4 words, similarity 0.8) and whether it is the one that stays."""
    return chosen_path.near_duplicates(_table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per anchor and positive: the ten best rows of other labels with 30 to 90 % of the positive's score."""
    vec_id, label = F.col("vec_id"), F.col("label")
    moved = F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), vec_id % 100 == 0, label=moved)


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_token_counts, op3_toxicity, op4_jaccard_join, op5_token_files, op6_mixing,
                                  op7_quality_rules, op8_line_dedup, op9_pii, op10_lm_score,
                                  op11_merkle_manifest, op12_chosen_path, op13_hard_negatives)}
