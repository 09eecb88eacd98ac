"""Registered relational model queries: KNN, SMOTE, naive Bayes, threshold, voting (2.4, 2.12, 2.14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..cohort import Cohort
from ..operators import balance as B
from ..operators import batched as BT
from ..operators import folds as FO
from ..operators import grids as G
from ..operators import learners as L
from ..operators import prep as PR
from ..operators.foldstats import leave_fold_out_median
from ..operators.knn import knn_join, knn_out_of_folds, votes_out_of_folds
from ..operators.search import fit_fold_preparations
from ..sources import fixtures as X
from .registry import finish, register

SEED = 42
K_NEIGHBOURS = 5


def emb_folded(spark, sf):
    v = X.emb_vectors(spark, sf)
    k = FO.resolve_fold_count(v, "target")
    return FO.stratified_folds(v, "id", "target", k, SEED), k


def emb_rows(spark, sf):
    """Every embedding in its fold, components in single precision if the table has them so."""
    e = emb_folded(spark, sf)[0]
    kind = X.scan_parquet(spark, sf, "embeddings").schema["embedding"].dataType
    return e.withColumn("vec", F.col("vec").cast(kind)).checkpoint(eager=True)


def doc_folded(spark, sf):
    c = X.doc_cohort(spark, sf)
    k = FO.resolve_fold_count(c.df, c.target_col)
    return c.with_df(FO.stratified_folds(c.df, c.id_col, c.target_col, k, SEED)), k


@register("knn_join")
def q_knn_join(spark, sf):
    """The 5 nearest training embeddings of every embedding, for every fold."""
    return finish(knn_out_of_folds(emb_rows(spark, sf), K_NEIGHBOURS).withColumnRenamed("grp", "fold"))


@register("knn")
def q_knn(spark, sf):
    """KNN classifier (k = 5, uniform weights): out-of-fold share of label 1 among the neighbours of every embedding."""
    is_one = emb_rows(spark, sf).withColumn("target", (F.col("target") == 1).cast("int"))
    return finish(votes_out_of_folds(is_one, [(K_NEIGHBOURS, "uniform")]).drop("candidate").withColumnRenamed("grp", "fold"))


@register("minority_nn_join")
def q_minority_nn_join(spark, sf):
    """Nearest other minority row of every minority ``doc`` row (raw features)."""
    c = X.doc_cohort(spark, sf)
    lab, _, _, _ = B.class_sizes(c)
    feats = ["n_chars", "n_spaces", "is_en", "is_toxic"]
    m = c.df.where(F.col("target") == lab).select("id", F.array(*[F.col(x).cast("double") for x in feats]).alias("vec"))
    return finish(knn_join(m, m, 1, exclude_self=True).select("qid", "rid", "dist"))


@register("smote_k1")
def q_smote_k1(spark, sf):
    """SMOTE with one neighbour on ``doc``: original rows plus synthetic minority rows."""
    c = X.doc_cohort(spark, sf)
    feats = ["n_chars", "n_spaces", "is_en", "is_toxic"]
    return finish(B.smote(c, feats, seed=SEED))


@register("gaussian_nb")
def q_gaussian_nb(spark, sf):
    """Out-of-fold Gaussian NB scores (label 1 against the rest) of standardized embeddings, for all smoothing values of the light grid."""
    e, k = emb_folded(spark, sf)
    dims = len(e.select("vec").first()[0])
    wide = e.select("id", *[F.col("vec")[i].alias(f"e{i}") for i in range(dims)],
                    (F.col("target") == 1).cast("int").alias("target"), "fold").checkpoint(eager=True)
    c = Cohort.from_frame(wide.drop("fold")).with_df(wide)
    preps = fit_fold_preparations(c, "fold", k, PR.split_feature_types(c))
    rows = BT.raw_rows(wide, {(f, -1): p for f, p in preps.items()}, "target", keep=[F.col("id")])
    smoothings = G.LIGHT_GRIDS[G.NAIVE_BAYES]["var_smoothing"]
    keys = [BT.ModelKey(f, i) for f in range(k) for i in range(len(smoothings))]
    found = BT.margins(rows, BT.fit_bayes(rows, keys, smoothings))
    return finish(found.select("fold", "candidate", "id", (1.0 / (1.0 + F.exp(-F.col("margin")))).alias("score"),
                               (F.col("margin") > 0).cast("int").alias("prediction")))


@register("threshold_classifier")
def q_threshold_classifier(spark, sf):
    """Median-threshold learner on ``doc.n_chars`` cross-validated: out-of-fold predictions, no scores."""
    c, k = doc_folded(spark, sf)
    thr = leave_fold_out_median(c.df, "n_chars", "fold", k)
    # one threshold per fold: at most 10 rows
    out = c.df.join(F.broadcast(thr), "fold").select(
        "fold", "id", F.col("target").alias("label"),
        (F.col("n_chars") >= F.col("median")).cast("int").alias("prediction"))
    return finish(out)


@register("voting_soft")
def q_voting_soft(spark, sf):
    return finish(L.voting_soft(X.scores_frame(spark, sf), ["price", "lines"]))


@register("voting_hard")
def q_voting_hard(spark, sf):
    return finish(L.voting_hard(X.scores_frame(spark, sf), ["price", "lines"]))
