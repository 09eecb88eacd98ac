"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, for every operator."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strata.llm import (decontaminate, jaccard_join, line_dedup, mixing, pii, pitman_yor, quality_rules, token_counts,
                        token_files, toxicity)
from strata.llm.queries import QUERIES, WORD_END_ID, word_tokenizer
from strata.session import scratch_path

LONG = " ".join(f"word{k % 5000} of" for k in range(40_000))
ROWS = [(1, None), (2, ""), (3, "same text here"), (3, "same text here"), (None, "a null id"), (None, None),
        (7, LONG), (8, " \n\t\n "), (9, "é 中文 \U0001f600 \x00 end"), (10, "Mail a@b.example.com now")]
CLASH = ("row", "doc", "tokens", "posterior", "rate", "copies", "fail_bits", "n_words", "kept", "entities", "content",
         "class_id", "word", "n_tokens", "grade", "text_hash", "place", "label", "_hash", "_v_kept", "_stay_id", "_i", "_some")


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    for c in CLASH:
        df = df.withColumn(c, F.lit("x"))
    return df.withColumn("a b`c".replace("`", ""), F.lit(1))


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.where("false")


def items(spark):
    return spark.createDataFrame([(1, "same text here"), (None, None), (2, ""), (2, "word3 of word4 of")],
                                 "item_id long, text string")


def test_decontamination(spark, odd, nothing):
    got = decontaminate.contamination(odd, items(spark)).collect()
    assert len(got) == len(ROWS)
    assert sorted((r["n_hit"], r["items"]) for r in got if r["doc_id"] == 3) == [(3, ["1"])] * 2
    assert all(r["n_words"] == 0 for r in got if r["doc_id"] in (1, 2, 8))
    assert decontaminate.contamination(nothing, items(spark)).count() == 0
    assert decontaminate.contamination(odd, items(spark).where("false")).where("n_hit > 0").count() == 0
    clean = decontaminate.clean_documents(odd, items(spark))
    assert clean.columns == odd.columns and clean.where("doc_id IN (3, 7)").count() == 0 and clean.count() == len(ROWS) - 3


def test_near_duplicates(spark, odd, nothing):
    got = jaccard_join.near_duplicates(odd).collect()
    assert len(got) == len(ROWS)
    assert [(r["class_id"], r["n_links"], r["n_copies"]) for r in got if r["doc_id"] == 3] == [(3, 1, 2)] * 2
    assert all((r["class_id"], r["n_links"]) == (r["doc_id"], 0) for r in got if r["doc_id"] != 3)
    assert jaccard_join.near_duplicates(nothing).count() == 0
    kept = jaccard_join.one_per_class(odd)
    assert kept.columns == odd.columns and kept.count() == len(ROWS) - 1 and kept.where("doc_id = 3").count() == 1
    assert jaccard_join.one_per_class(nothing).count() == 0


def test_token_files(spark, odd, nothing):
    path = scratch_path(spark, "odd")
    token_files.write_token_files(odd, path, word_tokenizer(), WORD_END_ID, word_by_word=True)
    got = token_files.token_index(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted([r[0] for r in ROWS], key=lambda x: (x is not None, x))
    assert sorted(r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 8)) == [1, 1, 1]
    assert [b["start"] for b in got[1:]] == [a["start"] + a["n_tokens"] for a in got[:-1]]
    path = scratch_path(spark, "none")
    token_files.write_token_files(nothing, path, word_tokenizer(), WORD_END_ID, word_by_word=True)
    assert token_files.token_index(spark, path).count() == 0


def test_quality_rules(spark, odd, nothing):
    got = quality_rules.apply_policy(quality_rules.rule_ledger(odd), "v1")
    assert got.count() == len(ROWS) and "label" in got.columns
    assert got.where("text IS NULL AND NOT kept AND n_words = 0").count() == 2
    assert quality_rules.rule_ledger(nothing).count() == 0 and quality_rules.ablations(quality_rules.rule_ledger(nothing)).count() == 0


def test_line_dedup(spark, odd, nothing):
    got = line_dedup.line_report(odd).collect()
    assert len(got) == len(ROWS) and {r["n_lines"] for r in got if r["doc_id"] in (1, 2, 8)} == {0}
    clean = line_dedup.dedup_lines(odd)
    assert clean.columns == odd.columns and clean.count() == len(ROWS)
    assert line_dedup.line_report(nothing).count() == 0 and line_dedup.dedup_lines(nothing).count() == 0


def test_personal_data(spark, odd, nothing):
    got = pii.pseudonymise(odd, "k")
    assert got.count() == len(ROWS) and set(got.columns) == set(odd.columns)
    assert got.where("size(entities) > 0").count() == 1
    assert pii.pseudonymise(nothing, "k").count() == 0


def test_language_model(spark, odd, nothing):
    model = pitman_yor.train(odd)
    got = pitman_yor.score(odd, model).collect()
    assert len(got) == len(ROWS) and {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 8)} == {1}
    assert all(r["score"] < 0 for r in got)
    empty = pitman_yor.train(nothing)
    assert (empty.tokens, empty.vocabulary) == (0, 0)
    assert all(r["n_known"] == 0 and r["base_score"] == 0 for r in pitman_yor.score(odd, empty).collect())
    assert pitman_yor.score(nothing, model).count() == 0


def test_token_counts(spark, odd, nothing):
    count = lambda d: token_counts.section_tokens(d, word_tokenizer(), token_counts.line_sections(F.col("text")))
    got = count(odd).collect()
    assert len(got) == len(ROWS)
    assert all(sum(s["tokens"] for s in r["section_tokens"]) == r["n_tokens"] for r in got)
    assert count(nothing).count() == 0


def test_classifiers(spark, odd, nothing):
    labelled = spark.createDataFrame([("good words here", "clean", 0), ("bad vile words", "toxic", 1), (None, "low", 2)],
                                     "text string, domain string, grade int")
    for rows in (labelled, labelled.where("false")):
        model = mixing.fit_domains(rows, mixing.DOMAINS)
        got = mixing.memberships(odd, model)
        assert got.count() == len(ROWS) and got.where("tokens = 0").count() == 4
        assert mixing.memberships(nothing, model).count() == 0
        fit = mixing.fit_rates(got, [10.0, 1.0, 1.0])
        assert mixing.with_rates(got, fit.steps).where("rate >= 0 AND copies >= 0").count() == len(ROWS)
        severity = toxicity.severity(odd, toxicity.fit_severity(rows, 3))
        assert severity.where("expected_severity BETWEEN 0 AND 2").count() == len(ROWS)
        assert toxicity.severity(nothing, toxicity.fit_severity(rows, 3)).count() == 0


def test_pipeline_stages(spark, odd, nothing, sf):
    for docs in (odd, nothing):
        now = docs
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = scratch_path(spark, "stage")
            stage(spark, now, sf).write.parquet(path)
            now = spark.read.parquet(path)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert now.columns == odd.columns


def test_pipeline_takes_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes, now = [docs.count()], docs
    for _, stage in corpus_pipeline.STAGES:
        path = scratch_path(spark, "stage")
        stage(spark, now, sf).write.parquet(path)
        now = spark.read.parquet(path)
        sizes.append(now.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[0] > sizes[1] > sizes[2] and sizes[4] == sizes[5]
    run = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, now.collect()))


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
