"""DuckDB texts for the registered queries (the correctness oracle).

Each text runs on DuckDB with the given tables registered as views.  Cohort
views are written once here as CTEs; every double output is rounded to 6
places, the same convention ``registry.finish`` applies on the Spark side.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORD_FEATURES = ("n_lines", "sum_qty", "sum_price", "avg_disc", "total_price", "acctbal", "is_urgent")
ORD_INTEGRAL = ("n_lines", "is_urgent")

ORD_VIEW = """
SELECT o.o_orderkey AS id, l.n_lines, l.sum_qty, l.sum_price, l.avg_disc,
       o.o_totalprice AS total_price, c.c_acctbal AS acctbal,
       CAST(CASE WHEN o.o_orderpriority IN ('1-URGENT','2-HIGH') THEN 1 ELSE 0 END AS INT) AS is_urgent,
       CAST(CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS INT) AS target,
       CAST(CASE WHEN COALESCE(l.sum_price, 0e0) + 1e3*((o.o_orderkey*7919) % 200 - 100) > 260000
                 THEN 1 ELSE 0 END AS INT) AS target_signal
FROM orders o
LEFT JOIN (SELECT l_orderkey, CAST(COUNT(*) AS INT) AS n_lines, SUM(l_quantity) AS sum_qty,
                  SUM(l_extendedprice) AS sum_price, AVG(l_discount) AS avg_disc
           FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
LEFT JOIN customer c ON c.c_custkey = o.o_custkey
"""

ORDC_VIEW = f"SELECT id, {', '.join(ORD_FEATURES)}, target FROM ord"

ORDL_VIEW = "\nUNION ALL\n".join(
    f"SELECT id, {i} AS ordinal, '{c}' AS variable, CAST({c} AS DOUBLE) AS value FROM ordc"
    for i, c in enumerate(ORD_FEATURES)
)

VC_VIEW = """
SELECT ordinal, variable, value, COUNT(*) AS cnt, MIN(id) AS first_id
FROM ordl GROUP BY ordinal, variable, value
"""

_integral_case = " ".join(f"WHEN {i} THEN {'TRUE' if c in ORD_INTEGRAL else 'FALSE'}"
                          for i, c in enumerate(ORD_FEATURES))
STATS_VIEW = f"""
SELECT ordinal, variable, CAST(SUM(cnt) AS BIGINT) AS n_rows,
       CAST(COALESCE(SUM(CASE WHEN value IS NULL THEN cnt END), 0) AS BIGINT) AS n_missing,
       CAST(COUNT(value) AS BIGINT) AS n_distinct, MIN(value) AS min_value, MAX(value) AS max_value,
       COUNT(*) FILTER (WHERE value IS NOT NULL AND value NOT IN (0, 1)) AS n_non_binary,
       CAST(SUM(cnt) - COALESCE(SUM(CASE WHEN value IS NULL THEN cnt END), 0) AS BIGINT) AS n_present,
       CASE ordinal {_integral_case} END AS is_integral
FROM vc GROUP BY ordinal, variable
"""

TYPE_EXPR = """CASE WHEN n_non_binary = 0 THEN 'Binary'
     WHEN n_distinct <= 15 AND is_integral AND n_missing = 0 THEN 'Categorical (Low Cardinality)'
     ELSE 'Continuous' END"""

QUART_VIEW = """
SELECT ordinal, variable, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
       quantile_cont(value, 0.75) AS q3
FROM ordl WHERE value IS NOT NULL GROUP BY ordinal, variable
"""

FENCE_VIEW = """
SELECT q.ordinal, q.variable, q.q1, q.q3, q.q1 - 1.5 * (q.q3 - q.q1) AS lower_bound,
       q.q3 + 1.5 * (q.q3 - q.q1) AS upper_bound
FROM quart q JOIN stats s ON s.ordinal = q.ordinal
WHERE s.n_distinct > 15 AND q.q3 - q.q1 <> 0
"""

OUTID_VIEW = """
SELECT l.ordinal, l.variable, l.id FROM ordl l JOIN fences f ON f.ordinal = l.ordinal
WHERE l.value < f.lower_bound OR l.value > f.upper_bound
"""

OUTINFO_VIEW = """
SELECT f.ordinal, f.variable, CAST(COUNT(*) AS BIGINT) AS count, f.lower_bound, f.upper_bound
FROM fences f JOIN outid o ON o.ordinal = f.ordinal
GROUP BY f.ordinal, f.variable, f.lower_bound, f.upper_bound
"""

BOX_VIEW = """
SELECT q.ordinal, q.variable, q.median, q.q1, q.q3, q.q1 - 1.5 * (q.q3 - q.q1) AS lower_whisker,
       q.q3 + 1.5 * (q.q3 - q.q1) AS upper_whisker,
       CAST(COALESCE((SELECT COUNT(*) FROM outid o WHERE o.ordinal = q.ordinal), 0) AS BIGINT) AS n_outliers
FROM quart q JOIN stats s ON s.ordinal = q.ordinal WHERE s.n_distinct > 1
"""

HIST_VIEW = """
SELECT s.ordinal, s.variable, s.min_value AS lo, s.max_value AS hi,
       CAST(LEAST(20, s.n_distinct) AS INTEGER) AS nb
FROM stats s WHERE s.n_distinct > 1
"""

HIST_BODY = """
, hb AS (
  SELECT v.ordinal, v.cnt, h.lo, h.hi, h.nb,
         CAST(FLOOR((v.value - h.lo) * (h.nb / (h.hi - h.lo))) AS INTEGER) AS raw, v.value
  FROM vc v JOIN hst h ON h.ordinal = v.ordinal WHERE v.value IS NOT NULL
), hd AS (
  SELECT *, CASE WHEN value < (CASE WHEN raw >= nb THEN hi ELSE raw * ((hi - lo) / nb) + lo END)
                 THEN raw - 1 ELSE raw END AS dec FROM hb
), hi_ AS (
  SELECT ordinal, cnt, LEAST(GREATEST(
           CASE WHEN value >= (CASE WHEN dec + 1 >= nb THEN hi ELSE (dec + 1) * ((hi - lo) / nb) + lo END)
                     AND dec <> nb - 1 THEN dec + 1 ELSE dec END, 0), nb - 1) AS bin
  FROM hd
), hc AS (
  SELECT ordinal, bin, CAST(SUM(cnt) AS BIGINT) AS count FROM hi_ GROUP BY ordinal, bin
), hall AS (
  SELECT h.ordinal, h.variable, b.b AS bin,
         CASE WHEN b.b >= h.nb THEN h.hi ELSE b.b * ((h.hi - h.lo) / h.nb) + h.lo END AS bin_lo,
         CASE WHEN b.b + 1 >= h.nb THEN h.hi ELSE (b.b + 1) * ((h.hi - h.lo) / h.nb) + h.lo END AS bin_hi,
         CAST(COALESCE(c.count, 0) AS BIGINT) AS count
  FROM hst h CROSS JOIN LATERAL (SELECT CAST(unnest(range(0, h.nb)) AS INTEGER) AS b) b
  LEFT JOIN hc c ON c.ordinal = h.ordinal AND c.bin = b.b
)
"""


def _corr_view(features, view="ordc"):
    parts = []
    for i in range(len(features)):
        for j in range(i + 1, len(features)):
            a, b = features[i], features[j]
            both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
            parts.append(
                f"SELECT {i} AS i, {j} AS j, '{a}' AS var_a, '{b}' AS var_b, "
                f"covar_pop(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) / NULLIF("
                f"stddev_pop(CASE WHEN {both} THEN CAST({a} AS DOUBLE) END) * "
                f"stddev_pop(CASE WHEN {both} THEN CAST({b} AS DOUBLE) END), 0) AS r FROM {view}")
    return "\nUNION ALL\n".join(parts)


CORR_VIEW = f"SELECT * FROM ({_corr_view(ORD_FEATURES)}) WHERE r IS NOT NULL AND NOT isnan(r)"

BASE_VIEWS = {
    "ord": ORD_VIEW,
    "ordc": ORDC_VIEW,
    "ordl": ORDL_VIEW,
    "vc": VC_VIEW,
    "stats": STATS_VIEW,
    "quart": QUART_VIEW,
    "fences": FENCE_VIEW,
    "outid": OUTID_VIEW,
    "hst": HIST_VIEW,
    "corr": CORR_VIEW,
}


def with_views(body: str, *names: str, extra: str = "") -> str:
    ctes = ",\n".join(f"{n} AS ({BASE_VIEWS[n]})" for n in names)
    return f"WITH {ctes}\n{extra}\n{body}"


def rounded(inner: str, cols: list[str] | tuple[str, ...]) -> str:
    """Round the named double columns of a query to 6 places."""
    if not cols:
        return inner
    rep = ", ".join(f"ROUND({c}, 6) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({inner})"


PROFILE_CHAIN = ("ord", "ordc", "ordl", "vc", "stats", "quart", "fences", "outid")


def _profile_oracles() -> None:
    o = ORACLE
    o["table_shape"] = with_views(
        f"SELECT CAST(COUNT(*) AS BIGINT) AS total_rows, CAST({len(ORD_FEATURES) + 2} AS BIGINT) AS total_cols "
        "FROM ordc", "ord", "ordc")
    cols = ("id",) + ORD_FEATURES + ("target",)
    miss = "\nUNION ALL\n".join(
        f"SELECT {i} AS ordinal, '{c}' AS variable, CAST(COUNT(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_missing,"
        f" COUNT(*) FILTER (WHERE {c} IS NULL) * 100e0 / COUNT(*) AS missing_pct FROM ordc"
        for i, c in enumerate(cols))
    o["missing_pct"] = with_views(rounded(miss, ["missing_pct"]), "ord", "ordc")
    o["missing_info"] = with_views(rounded(
        "SELECT ordinal, variable, n_missing * 100e0 / n_rows AS percentage FROM stats WHERE n_missing > 0",
        ["percentage"]), "ord", "ordc", "ordl", "vc", "stats")
    o["distinct_count"] = with_views("SELECT variable, n_distinct FROM stats", "ord", "ordc", "ordl", "vc", "stats")
    o["example_values"] = with_views(rounded(
        "SELECT variable, pos, value FROM (SELECT variable, value, CAST(ROW_NUMBER() OVER "
        "(PARTITION BY ordinal ORDER BY first_id, value) AS INTEGER) AS pos FROM vc WHERE value IS NOT NULL) "
        "WHERE pos <= 3", ["value"]), "ord", "ordc", "ordl", "vc")
    o["variable_type"] = with_views(f"SELECT ordinal, variable, {TYPE_EXPR} AS type FROM stats",
                                    "ord", "ordc", "ordl", "vc", "stats")
    nf = len(ORD_FEATURES)
    o["variable_info"] = with_views(rounded(f"""
        SELECT 0 AS ordinal, 'id' AS name, 'ID' AS type, COUNT(*) FILTER (WHERE id IS NULL) * 100e0 / COUNT(*)
               AS missing, CAST(COUNT(DISTINCT id) AS BIGINT) AS distinct_values,
               (SELECT string_agg(CAST(v AS VARCHAR), ', ' ORDER BY v) FROM (SELECT DISTINCT id AS v FROM ordc ORDER BY v LIMIT 3))
               AS examples FROM ordc
        UNION ALL
        SELECT ordinal + 1, stats.variable, {TYPE_EXPR}, n_missing * 100e0 / n_rows, n_distinct, COALESCE(x.examples, '')
        FROM stats LEFT JOIN (SELECT variable, string_agg(CASE WHEN value = floor(value) THEN printf('%.0f', value)
                     ELSE rtrim(printf('%.6f', value), '0') END, ', ' ORDER BY first_id, value) AS examples
              FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY variable ORDER BY first_id, value) AS r FROM vc WHERE value IS NOT NULL)
              WHERE r <= 3 GROUP BY variable) x ON x.variable = stats.variable
        UNION ALL
        SELECT {nf + 1}, 'target', 'Target', COUNT(*) FILTER (WHERE target IS NULL) * 100e0 / COUNT(*),
               CAST(COUNT(DISTINCT target) AS BIGINT), (SELECT string_agg(CAST(v AS VARCHAR), ', ' ORDER BY v)
               FROM (SELECT DISTINCT target AS v FROM ordc WHERE target IS NOT NULL ORDER BY v LIMIT 3)) FROM ordc""", ["missing"]),
        "ord", "ordc", "ordl", "vc", "stats")
    o["target_distribution"] = with_views("""
        SELECT class0, class1, CAST(LEAST(class0, class1) * 1e0 /
               (CASE WHEN class0 + class1 = 0 THEN 1 ELSE class0 + class1 END) < 0.47 AS INTEGER) AS imbalance
        FROM (SELECT CAST(COUNT(*) FILTER (WHERE target = 0) AS BIGINT) AS class0,
                     CAST(COUNT(*) FILTER (WHERE target = 1) AS BIGINT) AS class1 FROM ordc)""", "ord", "ordc")
    o["class_distribution"] = with_views("""
        SELECT COALESCE(c.label, b.label) AS label, CAST(COALESCE(c.count, 0) AS BIGINT) AS count
        FROM (SELECT COALESCE(CAST(target AS VARCHAR), 'nan') AS label, COUNT(*) AS count FROM ordc GROUP BY 1) c
        FULL JOIN (VALUES ('0'), ('1')) b(label) ON b.label = c.label""", "ord", "ordc")
    o["positive_pct"] = with_views("SELECT ROUND(100 * AVG(CAST(target AS DOUBLE)), 1) AS positive_pct FROM ordc",
                                   "ord", "ordc")
    o["quartiles"] = with_views(rounded("SELECT * FROM quart", ["q1", "median", "q3"]), *PROFILE_CHAIN[:6])
    o["iqr_fences"] = with_views(rounded("SELECT * FROM fences", ["q1", "q3", "lower_bound", "upper_bound"]),
                                 *PROFILE_CHAIN[:7])
    o["outlier_ids"] = with_views("SELECT * FROM outid", *PROFILE_CHAIN)
    o["filter_outliers"] = with_views("SELECT DISTINCT id FROM outid", *PROFILE_CHAIN)
    o["outlier_info"] = with_views(rounded(OUTINFO_VIEW, ["lower_bound", "upper_bound"]), *PROFILE_CHAIN)
    o["box_plot"] = with_views(rounded(BOX_VIEW, ["median", "q1", "q3", "lower_whisker", "upper_whisker"]),
                               *PROFILE_CHAIN)
    o["histogram"] = with_views(rounded("SELECT * FROM hall", ["bin_lo", "bin_hi"]),
                                "ord", "ordc", "ordl", "vc", "stats", "hst", extra=HIST_BODY)
    o["histogram_labels"] = with_views(
        "SELECT variable, bin, printf('%.2f - %.2f', ROUND(bin_lo, 2), ROUND(bin_hi, 2)) AS label, count FROM hall",
        "ord", "ordc", "ordl", "vc", "stats", "hst", extra=HIST_BODY)
    o["correlation_matrix"] = with_views(rounded("SELECT * FROM corr", ["r"]), "ord", "ordc", "corr")
    o["correlated_pairs"] = with_views(rounded(
        "SELECT i, j, var_a, var_b, r, var_b AS drop_column FROM corr WHERE ABS(r) >= 0.8", ["r"]),
        "ord", "ordc", "corr")
    o["issue_count"] = with_views(f"""
        SELECT CAST((SELECT COUNT(*) FROM stats WHERE n_missing > 0)
                  + (SELECT COUNT(*) FROM ({OUTINFO_VIEW}))
                  + (SELECT COUNT(*) FROM corr WHERE ABS(r) >= 0.8) AS BIGINT) AS issues,
               CAST({nf} AS BIGINT) AS n_features""", *PROFILE_CHAIN, "corr")
    o["chart_subset"] = with_views("""
        SELECT b.ordinal, b.variable, b.chart_pos, i.id, i.id_pos, 'box' AS chart, NULL AS bin, NULL AS bin_lo, NULL AS bin_hi,
               NULL AS count
        FROM (SELECT ordinal, variable, CAST(ROW_NUMBER() OVER (ORDER BY ordinal) AS INTEGER) AS chart_pos
              FROM quart q WHERE (SELECT n_distinct FROM stats s WHERE s.ordinal = q.ordinal) > 1
              QUALIFY chart_pos <= 4) b
        LEFT JOIN (SELECT ordinal, id, CAST(ROW_NUMBER() OVER (PARTITION BY ordinal ORDER BY id) AS INTEGER) AS id_pos
                   FROM outid QUALIFY id_pos <= 5) i ON i.ordinal = b.ordinal
        UNION ALL
        SELECT ordinal, variable, chart_pos, NULL, NULL, 'histogram', bin, ROUND(bin_lo, 6), ROUND(bin_hi, 6), count
        FROM (SELECT *, CAST(DENSE_RANK() OVER (ORDER BY ordinal) AS INTEGER) AS chart_pos FROM hall) WHERE chart_pos <= 4""",
        *PROFILE_CHAIN, "hst", extra=HIST_BODY)


_profile_oracles()


# ---------------------------------------------------------------- evaluation
SCORES_VIEW = """
SELECT m.model, f.fold, f.id, f.label,
       CASE WHEN m.model = 'none' THEN NULL
            WHEN m.model = 'price' THEN ROUND(f.total_price / 500000e0, 2)
            ELSE ROUND(COALESCE(f.sum_price, 0e0) / 1000000e0, 2) END AS score,
       CAST(CASE WHEN m.model = 'none' THEN f.is_urgent
                 WHEN m.model = 'price' AND f.total_price >= 250000 THEN 1
                 WHEN m.model = 'lines' AND f.sum_price >= 260000 THEN 1 ELSE 0 END AS INT) AS prediction
FROM (SELECT id, target_signal AS label, total_price, sum_price, is_urgent,
             CAST((ROW_NUMBER() OVER (PARTITION BY target_signal
                   ORDER BY MD5(CONCAT('137:', CAST(id AS VARCHAR))), id) - 1) % 10 AS INT) AS fold
      FROM ord) f
CROSS JOIN (SELECT 'price' AS model UNION ALL SELECT 'lines' UNION ALL SELECT 'none') m
"""

CM_VIEW = """
WITH cmf AS (
  SELECT model, fold, COUNT(*) FILTER (WHERE label = 1 AND prediction = 1) AS tp,
         COUNT(*) FILTER (WHERE label = 0 AND prediction = 1) AS fp,
         COUNT(*) FILTER (WHERE label = 0 AND prediction = 0) AS tn,
         COUNT(*) FILTER (WHERE label = 1 AND prediction = 0) AS fn
  FROM scores GROUP BY model, fold)
SELECT model, CAST(fold AS INTEGER) AS fold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn, CAST(tp + fp + tn + fn AS BIGINT) AS n FROM cmf
UNION ALL
SELECT model, -1, CAST(SUM(tp) AS BIGINT), CAST(SUM(fp) AS BIGINT), CAST(SUM(tn) AS BIGINT),
       CAST(SUM(fn) AS BIGINT), CAST(SUM(tp + fp + tn + fn) AS BIGINT) FROM cmf GROUP BY model
"""


def _r(num, den):
    return f"COALESCE(({num}) * 1e0 / NULLIF({den}, 0), 0e0)"


RATES_VIEW = f"""
SELECT *, {_r('tp', 'tp + fn')} AS sensitivity, {_r('tn', 'tn + fp')} AS specificity,
       {_r('tp', 'tp + fp')} AS vpp, {_r('tn', 'tn + fn')} AS vpn,
       {_r('tp + tn', 'tp + fp + tn + fn')} AS accuracy, {_r('2 * tp', '2 * tp + fp + fn')} AS f1_score
FROM cm
"""

SC_VIEW = """
WITH f AS (
  SELECT model, fold, score, COUNT(*) FILTER (WHERE label = 1) AS pos, COUNT(*) FILTER (WHERE label = 0) AS neg
  FROM scores WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY model, fold, score)
SELECT model, CAST(fold AS INTEGER) AS fold, score, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg FROM f
UNION ALL
SELECT model, -1, score, CAST(SUM(pos) AS BIGINT), CAST(SUM(neg) AS BIGINT) FROM f GROUP BY model, score
"""

AUC_VIEW = """
WITH scb AS (
  SELECT *, COALESCE(SUM(neg) OVER (PARTITION BY model, fold ORDER BY score
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_before
  FROM sc),
part AS (
  SELECT model, fold, SUM(pos * (neg_before + 0.5e0 * neg)) AS num, SUM(pos) AS p, SUM(neg) AS n
  FROM scb GROUP BY model, fold),
badf AS (
  SELECT model, fold, COUNT(*) FILTER (WHERE score IS NULL OR isnan(score)) AS n_bad FROM scores GROUP BY model, fold),
bad AS (
  SELECT model, CAST(fold AS INTEGER) AS fold, n_bad FROM badf
  UNION ALL SELECT model, -1, SUM(n_bad) FROM badf GROUP BY model)
SELECT b.model, b.fold,
       CASE WHEN p > 0 AND n > 0 AND b.n_bad = 0 THEN num / (p * 1e0 * n) END AS auc
FROM bad b LEFT JOIN part a ON a.model = b.model AND a.fold = b.fold
"""

USABLE_VIEW = """
SELECT model, CAST(bool_and(score IS NOT NULL AND NOT isnan(score)) AS INTEGER) AS usable
FROM scores GROUP BY model
"""

FM_VIEW = """
SELECT r.*, a.auc FROM rates r LEFT JOIN auc a ON a.model = r.model AND a.fold = r.fold WHERE r.fold <> -1
"""

_std_cols = ", ".join(
    f"CASE WHEN COUNT({m}) >= 2 THEN stddev_samp({m}) END AS {m}_std"
    for m in ("sensitivity", "specificity", "vpp", "vpn", "accuracy", "f1_score", "auc"))
FSTD_VIEW = f"SELECT model, {_std_cols} FROM fm GROUP BY model"

MT_VIEW = """
SELECT r.model, r.tp, r.fp, r.tn, r.fn, r.sensitivity, r.specificity, r.vpp, r.vpn, r.accuracy, r.f1_score,
       a.auc, s.sensitivity_std, s.specificity_std, s.vpp_std, s.vpn_std, s.accuracy_std, s.f1_score_std, s.auc_std
FROM rates r LEFT JOIN auc a ON a.model = r.model AND a.fold = -1
LEFT JOIN fstd s ON s.model = r.model
WHERE r.fold = -1
"""

BASE_VIEWS.update({
    "scores": SCORES_VIEW, "cm": CM_VIEW, "rates": RATES_VIEW, "sc": SC_VIEW, "auc": AUC_VIEW,
    "usable": USABLE_VIEW, "fm": FM_VIEW, "fstd": FSTD_VIEW, "mt": MT_VIEW,
})
EVAL_CHAIN = ("ord", "scores", "cm", "rates", "sc", "auc", "usable", "fm", "fstd", "mt")
MT_DOUBLES = ["sensitivity", "specificity", "vpp", "vpn", "accuracy", "f1_score", "auc", "sensitivity_std",
              "specificity_std", "vpp_std", "vpn_std", "accuracy_std", "f1_score_std", "auc_std"]


def _fmt(expr, digits):
    scale = f"{10 ** digits}e0"
    return f"printf('%.{digits}f', FLOOR(({expr}) * {scale} + 0.5) / {scale})"


def _fin(expr):
    return f"({expr} IS NOT NULL AND NOT isnan({expr}))"


def _fmt_metric(v, s, percent=False):
    if percent:
        fv, fs = f"{_fmt(f'{v} * 100', 1)} || '%'", f"{_fmt(f'{s} * 100', 1)} || '%'"
    else:
        fv, fs = _fmt(v, 3), _fmt(s, 3)
    return (f"CASE WHEN NOT COALESCE({_fin(v)}, FALSE) THEN 'N/A' WHEN NOT COALESCE({_fin(s)}, FALSE) THEN {fv} "
            f"ELSE {fv} || ' ± ' || {fs} END")


def _eval_oracles() -> None:
    o = ORACLE
    o["scan_parquet"] = with_views("SELECT * FROM scores", "ord", "scores")
    o["confusion_matrix"] = with_views("SELECT * FROM cm", "ord", "scores", "cm")
    for key, col in (("sensitivity", "sensitivity"), ("specificity", "specificity"), ("ppv", "vpp"),
                     ("npv", "vpn"), ("accuracy", "accuracy"), ("f1", "f1_score")):
        o[key] = with_views(rounded(f"SELECT model, fold, {col} FROM rates", [col]), "ord", "scores", "cm", "rates")
    o["auc_exact"] = with_views(rounded("SELECT * FROM auc", ["auc"]), "ord", "scores", "sc", "auc")
    o["usable_scores"] = with_views("SELECT * FROM usable", "ord", "scores", "usable")
    o["roc_curve"] = with_views(rounded("""
        WITH p AS (SELECT * FROM sc WHERE fold = -1),
        c AS (SELECT model, score, pos, neg,
                     CAST(ROW_NUMBER() OVER (PARTITION BY model ORDER BY score DESC) - 1 AS BIGINT) AS idx,
                     SUM(pos) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tps,
                     SUM(neg) OVER (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fps,
                     LEAD(pos) OVER (PARTITION BY model ORDER BY score DESC) AS pos_next,
                     LEAD(neg) OVER (PARTITION BY model ORDER BY score DESC) AS neg_next
              FROM p),
        ok AS (SELECT u.model, SUM(p.pos) AS P, SUM(p.neg) AS N FROM usable u JOIN p ON p.model = u.model
               WHERE u.usable = 1 GROUP BY u.model HAVING SUM(p.pos) > 0 AND SUM(p.neg) > 0)
        SELECT ok.model, CAST(0 AS BIGINT) AS point, 0e0 AS fpr, 0e0 AS tpr FROM ok
        UNION ALL
        SELECT c.model, c.idx + 1, c.fps * 1e0 / ok.N, c.tps * 1e0 / ok.P FROM c JOIN ok ON ok.model = c.model
        WHERE c.idx = 0 OR c.pos_next IS NULL OR c.pos_next <> c.pos OR c.neg_next <> c.neg""", ["fpr", "tpr"]),
        "ord", "scores", "sc", "usable")
    o["minmax_scores"] = with_views(rounded("""
        SELECT s.model, s.fold, s.id, (s.score - l.lo) / (l.hi - l.lo + 1e-9) AS score
        FROM scores s JOIN (SELECT model, fold, MIN(score) AS lo, MAX(score) AS hi FROM scores GROUP BY model, fold) l
        ON l.model = s.model AND l.fold = s.fold WHERE s.model <> 'none'""", ["score"]), "ord", "scores")
    chain = EVAL_CHAIN
    o["fold_std"] = with_views(rounded("SELECT * FROM fstd", [f"{m}_std" for m in (
        "sensitivity", "specificity", "vpp", "vpn", "accuracy", "f1_score", "auc")]), *chain[:-1])
    o["metrics_table"] = with_views(rounded("SELECT * FROM mt", MT_DOUBLES), *chain)
    req = "CASE model WHEN 'price' THEN 0 WHEN 'lines' THEN 1 WHEN 'none' THEN 2 END"
    o["best_model"] = with_views(rounded(
        f"SELECT model, auc, {req} AS request_pos FROM mt WHERE auc IS NOT NULL AND NOT isnan(auc) "
        "ORDER BY auc DESC, request_pos LIMIT 1", ["auc"]), *chain)
    o["filter_metrics_present"] = with_views(rounded(
        "SELECT model, auc FROM mt WHERE auc IS NOT NULL AND NOT isnan(auc)", ["auc"]), *chain)
    o["format_metric"] = with_views(f"""
        SELECT model, {_fmt_metric('auc', 'auc_std')} AS auc_text,
               {_fmt_metric('accuracy', 'accuracy_std', True)} AS accuracy_text,
               {_fmt_metric('f1_score', 'f1_score_std')} AS f1_text,
               {_fmt_metric('sensitivity', 'sensitivity_std')} AS sensitivity_text,
               {_fmt_metric('specificity', 'specificity_std')} AS specificity_text,
               {_fmt_metric('vpp', 'vpp_std')} AS vpp_text,
               {_fmt_metric('vpn', 'vpn_std')} AS vpn_text
        FROM mt""", *chain)
    o["comparison_lines"] = with_views(f"""
        SELECT model, 'Model: ' || model || ' | AUC: ' || {_fmt('auc', 3)} || ' | Accuracy: '
               || {_fmt('accuracy * 100', 1)} || '%' || ' | Sensitivity (Recall): ' || {_fmt('sensitivity', 3)}
               || ' | Specificity: ' || {_fmt('specificity', 3)} || ' | F1-Score: ' || {_fmt('f1_score', 3)} AS line
        FROM mt WHERE auc IS NOT NULL AND NOT isnan(auc)""", *chain)
    cells = []
    for label, key in (("AUC", "auc"), ("Accuracy", "accuracy"), ("Sensitivity", "sensitivity"),
                       ("Specificity", "specificity"), ("VPP", "vpp"), ("VPN", "vpn"), ("F1", "f1_score")):
        for suffix, col in (("", key), ("_SD", f"{key}_std")):
            cells.append(f"CASE WHEN COALESCE({_fin(col)}, FALSE) THEN {_fmt(col, 4)} ELSE 'N/A' END "
                         f"AS {label}{suffix}")
    o["export_metrics_csv"] = with_views(
        f"SELECT model AS Model, {', '.join(cells)}, CAST(tp AS VARCHAR) AS TP, CAST(fp AS VARCHAR) AS FP, "
        "CAST(tn AS VARCHAR) AS TN, CAST(fn AS VARCHAR) AS FN, 'N/A' AS Hyperparameters FROM mt WHERE tp IS NOT NULL",
        *chain)
    o["order_results"] = with_views(rounded("""
        SELECT r.model, r.request_pos, r.is_clustering, mt.auc FROM (VALUES ('price', 0, 0), ('lines', 1, 0), ('none', 2, 0),
               ('K-Means Clustering', 3, 1)) r(model, request_pos, is_clustering) LEFT JOIN mt ON mt.model = r.model""", ["auc"]), *chain)
    o["grid_rank"] = with_views(rounded("""
        SELECT candidate, COALESCE(a, -1e0) AS mean_auc,
               CAST(ROW_NUMBER() OVER (ORDER BY COALESCE(a, -1e0) DESC, candidate) AS INTEGER) AS rank
        FROM (SELECT CASE model WHEN 'price' THEN 0 WHEN 'lines' THEN 1 ELSE 2 END AS candidate, AVG(auc) AS a
              FROM auc WHERE fold <> -1 GROUP BY 1)""", ["mean_auc"]), "ord", "scores", "sc", "auc")


_eval_oracles()


# ---------------------------------------------------------------- validation, sources, cleaning
NUMERIC_RE = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(inf|infinity|nan)$"
ORD_DOUBLES = ["sum_qty", "sum_price", "avg_disc", "total_price", "acctbal"]


def _coerce(expr):
    return (f"CASE WHEN regexp_matches(lower(trim({expr})), '{NUMERIC_RE}') "
            f"THEN (CASE WHEN isnan(TRY_CAST(lower(trim({expr})) AS DOUBLE)) THEN NULL "
            f"ELSE TRY_CAST(lower(trim({expr})) AS DOUBLE) END) END")


BASE_VIEWS.update({
    "bad_id_null": f"SELECT CASE WHEN n_lines IS NOT NULL THEN id END AS id, {', '.join(ORD_FEATURES)}, target FROM ord",
    "bad_target": f"SELECT id, {', '.join(ORD_FEATURES)}, n_lines AS target FROM ord",
    "bad_target_null": f"SELECT id, {', '.join(ORD_FEATURES)}, CASE WHEN is_urgent = 0 THEN target END AS target FROM ord",
    "bad_feature": f"SELECT ord.id, {', '.join('ord.' + c for c in ORD_FEATURES)}, o.o_orderpriority, ord.target "
                   "FROM ord JOIN orders o ON o.o_orderkey = ord.id",
    "bad_dup": "SELECT l_orderkey AS id, l_quantity, l_extendedprice, l_discount, "
               "CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INT) AS target FROM lineitem",
    "mixed": "SELECT id, sum_qty, CASE WHEN is_urgent = 1 THEN 'x' ELSE CAST(total_price AS VARCHAR) END AS mixed, "
             "target FROM ord",
})


def _report(view, feats, text_feats=()):
    rows = [
        "SELECT 0 AS pos, 'min_columns' AS \"check\", CAST(NULL AS VARCHAR) AS \"column\", CAST(0 AS BIGINT) AS n_bad",
        f"SELECT 1, 'id_not_null', 'id', CAST(COUNT(*) FILTER (WHERE id IS NULL) AS BIGINT) FROM {view}",
        f"SELECT 2, 'id_unique', 'id', CAST(COALESCE(SUM(n - 1) FILTER (WHERE n > 1), 0) AS BIGINT) "
        f"FROM (SELECT id, COUNT(*) AS n FROM {view} WHERE id IS NOT NULL GROUP BY id)",
        f"SELECT 3, 'target_binary', 'target', CAST(COUNT(*) FILTER (WHERE target IS NOT NULL AND "
        f"CAST(target AS DOUBLE) NOT IN (0, 1)) AS BIGINT) FROM {view}",
        f"SELECT 4, 'target_not_null', 'target', CAST(COUNT(*) FILTER (WHERE target IS NULL) AS BIGINT) FROM {view}",
    ]
    for i, c in enumerate(feats):
        ok = (f"COUNT({_coerce(c)})" if c in text_feats else f"COUNT({c})")
        rows.append(f"SELECT {5 + i}, 'feature_numeric', '{c}', CAST(CASE WHEN {ok} = 0 AND COUNT({c}) > 0 "
                    f"THEN COUNT({c}) ELSE 0 END AS BIGINT) FROM {view}")
    body = "\nUNION ALL\n".join(rows)
    return f"SELECT *, CAST(n_bad = 0 AS INTEGER) AS passed FROM ({body})"


CLEAN_VIEWS = {
    "sugg": f"""
SELECT CAST(ordinal AS BIGINT) AS pos, 'missing-' || variable AS suggestion_id, 'missing' AS type,
       'Remove rows with missing values in ''' || variable || ''' (' || {_fmt('pct', 2)} || '% missing).'
         AS description, variable, CAST(NULL AS VARCHAR) AS var_a, CAST(NULL AS VARCHAR) AS var_b, pct AS value,
       CAST(NULL AS VARCHAR) AS drop_column,
       'Missing values can bias model training and need explicit handling.' AS reason
FROM (SELECT ordinal, variable, n_missing * 100e0 / n_rows AS pct FROM stats WHERE n_missing > 0)
UNION ALL
SELECT CAST(ordinal + 10000 AS BIGINT), 'outlier-' || variable, 'outlier',
       'Remove ' || CAST(count AS VARCHAR) || ' outlier(s) in ''' || variable || ''' (IQR-based detection).',
       variable, NULL, NULL, CAST(count AS DOUBLE), NULL,
       'Extreme values may distort model coefficients and should be reviewed.'
FROM ({OUTINFO_VIEW})
UNION ALL
SELECT CAST(i * 100000 + j + 20000 AS BIGINT), 'corr-' || var_a || '-' || var_b, 'correlation',
       'Remove ''' || var_b || ''' due to high correlation with ''' || var_a || ''' (|r|=' || {_fmt('ABS(r)', 2)}
         || ').',
       NULL, var_a, var_b, r, var_b, 'Highly correlated variables can introduce multicollinearity.'
FROM corr WHERE ABS(r) >= 0.8
""",
    "rem": """
SELECT DISTINCT id FROM (
  SELECT id FROM ordl WHERE value IS NULL AND variable IN (SELECT variable FROM sugg WHERE type = 'missing')
  UNION ALL
  SELECT id FROM outid WHERE variable IN (SELECT variable FROM sugg WHERE type = 'outlier'))
WHERE id IS NOT NULL
""",
    "dropcols": "SELECT DISTINCT var_b AS \"column\" FROM sugg WHERE type = 'correlation'",
    "keptcols": "SELECT c.name, c.orig FROM (VALUES " + ", ".join(
        f"('{c}', {i})" for i, c in enumerate(("id",) + ORD_FEATURES + ("target",)))
        + ") c(name, orig) WHERE c.name NOT IN (SELECT \"column\" FROM dropcols)",
    "kept": "SELECT * FROM ordc WHERE id NOT IN (SELECT id FROM rem)",
}
BASE_VIEWS.update(CLEAN_VIEWS)
CLEAN_CHAIN = PROFILE_CHAIN + ("corr", "sugg", "rem", "dropcols", "keptcols", "kept")


def _clean_oracles() -> None:
    o = ORACLE
    o["id_not_null"] = with_views(
        f"SELECT \"check\", \"column\", n_bad, passed FROM ({_report('bad_id_null', ORD_FEATURES)}) "
        "WHERE \"check\" = 'id_not_null'", "ord", "bad_id_null")
    o["target_binary"] = with_views(
        f"SELECT \"check\", \"column\", n_bad, passed FROM ({_report('bad_target', ORD_FEATURES)}) "
        "WHERE \"check\" = 'target_binary'", "ord", "bad_target")
    o["target_not_null"] = with_views(
        f"SELECT \"check\", \"column\", n_bad, passed FROM ({_report('bad_target_null', ORD_FEATURES)}) "
        "WHERE \"check\" = 'target_not_null'", "ord", "bad_target_null")
    bf = ORD_FEATURES + ("o_orderpriority",)
    o["feature_numeric"] = with_views(
        f"SELECT \"check\", \"column\", n_bad, passed FROM ({_report('bad_feature', bf, ('o_orderpriority',))}) "
        "WHERE \"check\" = 'feature_numeric'", "ord", "bad_feature")
    o["validation_report"] = with_views(_report("bad_feature", bf, ("o_orderpriority",)), "ord", "bad_feature")
    o["id_unique"] = with_views(
        "SELECT id, CAST(COUNT(*) AS BIGINT) AS occurrences FROM bad_dup WHERE id IS NOT NULL GROUP BY id "
        "HAVING COUNT(*) > 1 ORDER BY id LIMIT 5", "bad_dup")
    o["coerce_numeric"] = with_views(rounded(
        f"SELECT id, sum_qty, {_coerce('mixed')} AS mixed, CAST(CAST(target AS DOUBLE) AS INTEGER) AS target "
        "FROM mixed", ["sum_qty", "mixed"]), "ord", "mixed")
    o["cast_target"] = with_views("SELECT id, CAST(CAST(target AS DOUBLE) AS INTEGER) AS target FROM bad_target_null",
                                  "ord", "bad_target_null")
    o["read_csv"] = with_views(rounded(
        "SELECT id, CAST(n_lines AS BIGINT) AS n_lines, sum_qty, sum_price, avg_disc, total_price, acctbal, "
        "CAST(is_urgent AS BIGINT) AS is_urgent, CAST(target AS BIGINT) AS target FROM ordc", ORD_DOUBLES),
        "ord", "ordc")
    o["read_workbooks"] = o["read_csv"]
    o["preview"] = with_views(rounded("SELECT * FROM ordc ORDER BY id LIMIT 10", ORD_DOUBLES), "ord", "ordc")
    o["dataset_summary"] = with_views(
        f"SELECT CAST(COUNT(*) AS BIGINT) AS rows, CAST({len(ORD_FEATURES) + 2} AS BIGINT) AS cols, "
        f"'id' AS id_column, 'target' AS target_column, '{','.join(ORD_FEATURES)}' AS feature_columns, "
        "CAST(COUNT(*) FILTER (WHERE target = 0) AS BIGINT) AS class_0, "
        "CAST(COUNT(*) FILTER (WHERE target = 1) AS BIGINT) AS class_1 FROM ordc", "ord", "ordc")
    sugg_cols = ["value"]
    o["suggest_missing"] = with_views(rounded("SELECT * FROM sugg WHERE type = 'missing'", sugg_cols),
                                      *CLEAN_CHAIN[:10])
    o["suggest_outliers"] = with_views(rounded("SELECT * FROM sugg WHERE type = 'outlier'", sugg_cols),
                                       *CLEAN_CHAIN[:10])
    o["suggest_correlation"] = with_views(rounded("SELECT * FROM sugg WHERE type = 'correlation'", sugg_cols),
                                          *CLEAN_CHAIN[:10])
    o["union_suggestions"] = with_views(rounded("SELECT * FROM sugg", sugg_cols), *CLEAN_CHAIN[:10])
    o["select_suggestions"] = with_views(
        "SELECT suggestion_id, type FROM sugg WHERE suggestion_id <> 'missing-n_lines'", *CLEAN_CHAIN[:10])
    sel = ", ".join(f"'{s}'" for s in ("missing-sum_qty", "outlier-avg_disc", "corr-n_lines-sum_qty",
                                       "no-such-suggestion"))
    o["filter_in_set"] = with_views(f"SELECT suggestion_id, type FROM sugg WHERE suggestion_id IN ({sel})",
                                    *CLEAN_CHAIN[:10])
    o["filter_missing"] = with_views(
        "SELECT variable, id FROM ordl WHERE value IS NULL AND variable IN (SELECT variable FROM stats "
        "WHERE n_missing > 0)", "ord", "ordc", "ordl", "vc", "stats")
    o["union_removed_ids"] = with_views("SELECT id FROM rem", *CLEAN_CHAIN[:11])
    o["removed_columns"] = with_views("SELECT * FROM dropcols", *CLEAN_CHAIN[:12])
    o["anti_join_removed"] = with_views("SELECT id FROM kept", *CLEAN_CHAIN)
    o["drop_columns"] = with_views(
        "SELECT CAST(ROW_NUMBER() OVER (ORDER BY orig) - 1 AS INTEGER) AS pos, name AS \"column\" FROM keptcols",
        *CLEAN_CHAIN)
    long_kept = ("SELECT l.id, l.variable, ROUND(l.value, 6) AS value FROM ordl l "
                 "WHERE l.id IN (SELECT id FROM kept) AND l.variable IN (SELECT name FROM keptcols)")
    o["select_features"] = with_views(long_kept, *CLEAN_CHAIN)
    o["write_cleaned"] = with_views(long_kept, *CLEAN_CHAIN)
    o["apply_cleaning"] = with_views(
        long_kept + " UNION ALL SELECT id, 'target', CAST(target AS DOUBLE) FROM kept", *CLEAN_CHAIN)
    o["cleaning_summary"] = with_views("""
        SELECT CAST((SELECT COUNT(*) FROM ordc) - (SELECT COUNT(*) FROM kept) AS BIGINT) AS rows_removed,
               CAST((SELECT COUNT(*) FROM dropcols) AS BIGINT) AS cols_removed,
               CAST((SELECT COUNT(*) FROM kept) AS BIGINT) AS final_rows,
               CAST((SELECT COUNT(*) FROM keptcols) - 2 AS BIGINT) AS final_cols,
               CASE WHEN (SELECT COUNT(*) FROM rem) > 0
                    THEN 'Removed ' || CAST((SELECT COUNT(*) FROM rem) AS VARCHAR)
                         || ' rows based on selected cleaning suggestions.'
                    WHEN (SELECT COUNT(*) FROM dropcols) > 0
                    THEN 'Removed highly correlated columns based on selected suggestions.' END AS notes""",
        *CLEAN_CHAIN)


_clean_oracles()


# ---------------------------------------------------------------- folds, preparation, balancing
def _draw(seed, stream, j):
    return f"(('0x' || substr(md5('{seed}:{stream}:' || CAST({j} AS VARCHAR)), 1, 8))::BIGINT / 4294967296e0)"


BASE_VIEWS.update({
    "ords": f"SELECT id, {', '.join(ORD_FEATURES)}, target_signal AS target FROM ord",
    "f42": "SELECT *, CAST((ROW_NUMBER() OVER (ORDER BY target, MD5('42:' || CAST(id AS VARCHAR)), id) - 1) % 10 "
           "AS INTEGER) AS fold FROM ords",
    "trl": "SELECT g.fold AS hold, f.id, f.ordinal, f.variable, f.value FROM (" + "\nUNION ALL\n".join(
        f"SELECT fold, id, {i} AS ordinal, '{c}' AS variable, CAST({c} AS DOUBLE) AS value FROM f42"
        for i, c in enumerate(ORD_FEATURES)) + ") f JOIN (SELECT DISTINCT fold FROM f42) g ON g.fold <> f.fold",
    "kinds": """
SELECT ordinal, variable, CASE WHEN COUNT(value) = 0 THEN 'empty'
       WHEN COUNT(*) FILTER (WHERE value IS NOT NULL AND value NOT IN (0, 1)) = 0 THEN 'binary'
       ELSE 'continuous' END AS kind
FROM (""" + "\nUNION ALL\n".join(
        f"SELECT {i} AS ordinal, '{c}' AS variable, CAST({c} AS DOUBLE) AS value FROM ords"
        for i, c in enumerate(ORD_FEATURES)) + ") GROUP BY ordinal, variable",
    "med": "SELECT t.hold, t.variable, t.ordinal, quantile_cont(t.value, 0.5) AS median FROM trl t "
           "JOIN kinds k ON k.ordinal = t.ordinal WHERE k.kind = 'continuous' AND t.value IS NOT NULL "
           "GROUP BY t.hold, t.variable, t.ordinal",
    "mode_": "SELECT hold, variable, ordinal, value AS mode FROM (SELECT t.hold, t.variable, t.ordinal, t.value, "
             "ROW_NUMBER() OVER (PARTITION BY t.hold, t.ordinal ORDER BY COUNT(*) DESC, t.value) AS r FROM trl t "
             "JOIN kinds k ON k.ordinal = t.ordinal WHERE k.kind = 'binary' AND t.value IS NOT NULL "
             "GROUP BY t.hold, t.variable, t.ordinal, t.value) WHERE r = 1",
    "stdz": "SELECT t.hold, t.variable, t.ordinal, AVG(COALESCE(t.value, m.median)) AS mean, "
            "CASE WHEN stddev_pop(COALESCE(t.value, m.median)) = 0 THEN 1e0 "
            "ELSE stddev_pop(COALESCE(t.value, m.median)) END AS scale "
            "FROM trl t JOIN med m ON m.ordinal = t.ordinal AND m.hold = t.hold GROUP BY t.hold, t.variable, t.ordinal",
    "prm": """
SELECT h.hold AS fold, CAST(ROW_NUMBER() OVER (PARTITION BY h.hold ORDER BY CASE WHEN k.kind = 'continuous' THEN 0 ELSE 1 END,
         k.ordinal) - 1 AS INTEGER) AS pos, k.variable, COALESCE(m.median, d.mode) AS fill, s.mean, s.scale, k.ordinal
FROM kinds k CROSS JOIN (SELECT DISTINCT fold AS hold FROM f42) h
LEFT JOIN med m ON m.ordinal = k.ordinal AND m.hold = h.hold LEFT JOIN mode_ d ON d.ordinal = k.ordinal AND d.hold = h.hold
LEFT JOIN stdz s ON s.ordinal = k.ordinal AND s.hold = h.hold WHERE k.kind <> 'empty'
""",
})
PREP_CHAIN = ("ord", "ords", "f42", "trl", "kinds", "med", "mode_", "stdz", "prm")


def _prep_oracles() -> None:
    o = ORACLE
    o["stratified_folds"] = with_views("SELECT id, target, fold FROM f42", "ord", "ords", "f42")
    o["fold_count"] = with_views("""
        SELECT CAST(MIN(n) AS BIGINT) AS smallest_class, CAST(SUM(n) AS BIGINT) AS n_rows,
               CAST(COUNT(*) AS BIGINT) AS n_classes, CAST(LEAST(MIN(n), SUM(n), 10) AS INTEGER) AS k,
               CAST(LEAST(MIN(n), SUM(n), 10) >= 2 AND COUNT(*) >= 2 AS INTEGER) AS ok
        FROM (SELECT target, COUNT(*) AS n FROM ords GROUP BY target)""", "ord", "ords")
    o["fold_split"] = with_views("SELECT fold, id, target FROM f42", "ord", "ords", "f42")
    o["split_feature_types"] = with_views("SELECT ordinal, variable, kind FROM kinds", "ord", "ords", "kinds")
    o["impute_median"] = with_views(rounded("SELECT hold AS fold, variable, median FROM med", ["median"]), *PREP_CHAIN[:6])
    o["impute_mode"] = with_views(rounded("SELECT hold AS fold, variable, mode FROM mode_", ["mode"]), *PREP_CHAIN[:7])
    o["standardize"] = with_views(rounded("SELECT fold, pos, variable, fill, mean, scale FROM prm",
                                          ["fill", "mean", "scale"]), *PREP_CHAIN)
    cells = "\nUNION ALL\n".join(
        f"SELECT f.fold, f.id, '{c}' AS variable, (COALESCE(CAST(f.{c} AS DOUBLE), p.fill) - COALESCE(p.mean, 0e0)) "
        f"/ COALESCE(p.scale, 1e0) AS value FROM f42 f JOIN prm p ON p.fold = f.fold WHERE p.variable = '{c}'"
        for c in ORD_FEATURES)
    o["assemble"] = with_views(rounded(cells, ["value"]), *PREP_CHAIN)
    o["random_oversample"] = with_views("""
        SELECT id, target, CAST(-1 AS BIGINT) AS draw FROM doc
        UNION ALL
        SELECT i.id, i.target, dr.draw FROM dr JOIN idx i ON i.idx = dr.idx""", "doc", extra=f"""
        , cls AS (SELECT target, COUNT(*) AS n FROM doc GROUP BY target),
        mn AS (SELECT target AS lab, n AS m FROM cls ORDER BY n, target LIMIT 1),
        mx AS (SELECT MAX(n) AS big FROM cls),
        idx AS (SELECT d.*, ROW_NUMBER() OVER (ORDER BY d.id) - 1 AS idx FROM doc d, mn WHERE d.target = mn.lab),
        dr AS (SELECT r.range AS draw, CAST(FLOOR({_draw(42, 'pick', 'r.range')} * mn.m) AS BIGINT) AS idx
               FROM mn, mx, range(mx.big - mn.m) r)""")


BASE_VIEWS["doc"] = """
SELECT d.doc_id AS id, CAST(d.n_chars AS DOUBLE) AS n_chars,
       CAST(LENGTH(d.text) - LENGTH(REPLACE(d.text, ' ', '')) AS DOUBLE) AS n_spaces,
       CAST(CASE WHEN d.lang = 'en' THEN 1 ELSE 0 END AS INT) AS is_en,
       l.toxic AS is_toxic, l.quality AS target
FROM documents d JOIN labels l ON l.doc_id = d.doc_id
"""
_prep_oracles()


# ---------------------------------------------------------------- relational models
BASE_VIEWS.update({
    "embv": "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec, label AS target "
            "FROM embeddings",
    "embf": "SELECT *, CAST((ROW_NUMBER() OVER (ORDER BY target, MD5('42:' || CAST(id AS VARCHAR)), id) - 1) % "
            "(SELECT LEAST(MIN(n), SUM(n), 10) FROM (SELECT COUNT(*) AS n FROM embv GROUP BY target)) AS INTEGER) "
            "AS fold FROM embv",
    "docf": "SELECT *, CAST((ROW_NUMBER() OVER (ORDER BY target, MD5('42:' || CAST(id AS VARCHAR)), id) - 1) % "
            "(SELECT LEAST(MIN(n), SUM(n), 10) FROM (SELECT COUNT(*) AS n FROM doc GROUP BY target)) AS INTEGER) "
            "AS fold FROM doc",
    "knn5": "SELECT q.fold, q.id AS qid, r.id AS rid, list_distance(q.vec, r.vec) AS dist, "
            "CAST(ROW_NUMBER() OVER (PARTITION BY q.id ORDER BY list_distance(q.vec, r.vec), r.id) AS INTEGER) AS rank "
            "FROM embf q JOIN embf r ON r.fold <> q.fold QUALIFY rank <= 5",
    "mino": "SELECT d.* FROM doc d WHERE d.target = (SELECT target FROM (SELECT target, COUNT(*) AS n FROM doc "
            "GROUP BY target) ORDER BY n, target LIMIT 1)",
    "mnn": "SELECT a.id AS qid, b.id AS rid, sqrt((a.n_chars - b.n_chars)^2 + (a.n_spaces - b.n_spaces)^2 "
           "+ (a.is_en - b.is_en)^2 + (a.is_toxic - b.is_toxic)^2) AS dist FROM mino a, mino b WHERE a.id <> b.id "
           "QUALIFY ROW_NUMBER() OVER (PARTITION BY a.id ORDER BY dist, b.id) = 1",
})


def _model_oracles() -> None:
    o = ORACLE
    o["knn_join"] = with_views(rounded("SELECT fold, qid, rank, rid, dist FROM knn5", ["dist"]), "embv", "embf", "knn5")
    o["knn"] = with_views(rounded(
        "SELECT k.fold, k.qid AS id, AVG(CAST(e.target = 1 AS DOUBLE)) AS score, CAST(AVG(CAST(e.target = 1 AS DOUBLE)) > 0.5 "
        "AS INTEGER) AS prediction FROM knn5 k JOIN embf e ON e.id = k.rid GROUP BY k.fold, k.qid", ["score"]),
        "embv", "embf", "knn5")
    o["minority_nn_join"] = with_views(rounded("SELECT qid, rid, dist FROM mnn", ["dist"]), "doc", "mino", "mnn")
    o["smote_k1"] = with_views(rounded("""
        SELECT id, n_chars, n_spaces, CAST(is_en AS DOUBLE) AS is_en, CAST(is_toxic AS DOUBLE) AS is_toxic,
               target, CAST(-1 AS BIGINT) AS draw, CAST(NULL AS BIGINT) AS base_id, CAST(NULL AS BIGINT) AS rid
        FROM doc
        UNION ALL
        SELECT NULL, b.n_chars + dr.gap * (n.n_chars - b.n_chars), b.n_spaces + dr.gap * (n.n_spaces - b.n_spaces),
               b.is_en + dr.gap * (n.is_en - b.is_en), b.is_toxic + dr.gap * (n.is_toxic - b.is_toxic),
               b.target, dr.draw, b.id, n.id
        FROM dr JOIN idx b ON b.idx = dr.idx JOIN mnn ON mnn.qid = b.id JOIN mino n ON n.id = mnn.rid""",
        ["n_chars", "n_spaces", "is_en", "is_toxic"]), "doc", "mino", "mnn", extra=f"""
        , cls AS (SELECT target, COUNT(*) AS n FROM doc GROUP BY target),
        mn AS (SELECT MIN(n) AS m FROM cls), mx AS (SELECT MAX(n) AS big FROM cls),
        idx AS (SELECT *, ROW_NUMBER() OVER (ORDER BY id) - 1 AS idx FROM mino),
        dr AS (SELECT r.range AS draw, CAST(FLOOR({_draw(42, 'pick', 'r.range')} * mn.m) AS BIGINT) AS idx,
                      {_draw(42, 'gap', 'r.range')} AS gap FROM mn, mx, range(mx.big - mn.m) r)""")
    o["gaussian_nb"] = with_views(rounded("""
        SELECT fold, candidate, id, CASE WHEN diff >= 0 THEN 1 / (1 + exp(-diff)) ELSE exp(diff) / (1 + exp(diff)) END AS score,
               CAST(diff > 0 AS INTEGER) AS prediction
        FROM (SELECT hold AS fold, candidate, id, MAX(jll) FILTER (WHERE target = 1) - MAX(jll) FILTER (WHERE target = 0) AS diff
              FROM jll GROUP BY hold, candidate, id)""", ["score"]), "embv", "embf", extra="""
        , embl AS (SELECT e.id, CAST(e.target = 1 AS INTEGER) AS target, e.fold, r.range AS d, e.vec[r.range + 1] AS value
                   FROM embf e, range(64) r),
        holds AS (SELECT DISTINCT fold AS hold FROM embf),
        zst AS (SELECT hold, d, AVG(value) AS mu, CASE WHEN stddev_pop(value) = 0 THEN 1e0 ELSE stddev_pop(value) END AS sd
                FROM embl JOIN holds ON hold <> fold GROUP BY hold, d),
        z AS (SELECT s.hold, l.id, l.target, l.fold, l.d, (l.value - s.mu) / s.sd AS value FROM embl l JOIN zst s ON s.d = l.d),
        nbp AS (SELECT hold, target, d, AVG(value) AS mean, var_pop(value) AS var0 FROM z WHERE fold <> hold
                GROUP BY hold, target, d),
        sm AS (SELECT * FROM (VALUES (0, 1e-9), (1, 1e-8), (2, 1e-7)) t(candidate, smoothing)),
        eps AS (SELECT hold, candidate, smoothing * MAX(v) AS eps FROM (SELECT hold, var_pop(value) AS v FROM z WHERE fold <> hold
                GROUP BY hold, d), sm GROUP BY hold, candidate, smoothing),
        pri AS (SELECT hold, target, LN(n * 1e0 / SUM(n) OVER (PARTITION BY hold)) AS lp
                FROM (SELECT hold, CAST(target = 1 AS INTEGER) AS target, COUNT(*) AS n FROM embf JOIN holds ON hold <> fold
                      GROUP BY hold, CAST(target = 1 AS INTEGER))),
        jll AS (SELECT z.hold, eps.candidate, z.id, p.target, SUM(-0.5 * (LN(2 * PI()) + LN(p.var0 + eps.eps)
                       + (z.value - p.mean) ^ 2 / (p.var0 + eps.eps))) + MAX(pri.lp) AS jll
                FROM z JOIN nbp p ON p.d = z.d AND p.hold = z.hold JOIN eps ON eps.hold = z.hold
                JOIN pri ON pri.target = p.target AND pri.hold = z.hold
                WHERE z.fold = z.hold GROUP BY z.hold, eps.candidate, z.id, p.target)""")
    o["oof_assemble"] = with_views(rounded("""
        SELECT fold, id, label, CASE WHEN diff >= 0 THEN 1 / (1 + exp(-diff)) ELSE exp(diff) / (1 + exp(diff)) END AS score,
               CAST(diff > 0 AS INTEGER) AS prediction
        FROM (SELECT fold, id, label, MAX(jll) FILTER (WHERE target = 1) - MAX(jll) FILTER (WHERE target = 0) AS diff
              FROM jll GROUP BY fold, id, label)""", ["score"]), *PREP_CHAIN, extra="""
        , cells AS (SELECT f.id, f.fold, f.target, x.ordinal, x.value FROM f42 f JOIN (""" + "\nUNION ALL\n".join(
            f"SELECT id, {i} AS ordinal, CAST({c} AS DOUBLE) AS value FROM f42" for i, c in enumerate(ORD_FEATURES)) + """) x
                  ON x.id = f.id),
        z AS (SELECT p.fold AS hold, c.id, c.fold, c.target, c.ordinal,
                     (COALESCE(c.value, p.fill) - COALESCE(p.mean, 0e0)) / COALESCE(p.scale, 1e0) AS v
              FROM cells c JOIN prm p ON p.ordinal = c.ordinal),
        nbp AS (SELECT hold, target, ordinal, AVG(v) AS mean, var_pop(v) AS var0, COUNT(*) AS n FROM z WHERE fold <> hold
                GROUP BY hold, target, ordinal),
        eps AS (SELECT hold, 1e-9 * MAX(x) AS eps FROM (SELECT hold, var_pop(v) AS x FROM z WHERE fold <> hold
                GROUP BY hold, ordinal) GROUP BY hold),
        tot AS (SELECT hold, ordinal, SUM(n) AS n FROM nbp GROUP BY hold, ordinal),
        jll AS (SELECT z.fold, z.id, z.target AS label, p.target, SUM(-0.5 * (LN(2 * PI()) + LN(p.var0 + eps.eps)
                       + (z.v - p.mean) ^ 2 / (p.var0 + eps.eps))) + MAX(LN(p.n * 1e0 / tot.n)) AS jll
                FROM z JOIN nbp p ON p.hold = z.hold AND p.ordinal = z.ordinal JOIN eps ON eps.hold = z.hold
                JOIN tot ON tot.hold = z.hold AND tot.ordinal = z.ordinal
                WHERE z.fold = z.hold GROUP BY z.fold, z.id, z.target, p.target)""")
    o["status_row"] = with_views(rounded("""
        SELECT 'Threshold' AS model, CAST(NULL AS DOUBLE) AS auc, AVG(CAST(CAST(d.n_chars >= t.thr AS INTEGER) = d.target AS DOUBLE))
               AS accuracy, 'Threshold does not expose probability estimates; AUC and ROC curves are unavailable for this model.'
               AS status_message
        FROM docf d JOIN (SELECT f.fold, quantile_cont(x.n_chars, 0.5) AS thr FROM (SELECT DISTINCT fold FROM docf) f
                          JOIN docf x ON x.fold <> f.fold GROUP BY f.fold) t ON t.fold = d.fold""", ["accuracy"]), "doc", "docf")
    fixed = """
        , kmed AS (SELECT ordinal, quantile_cont(value, 0.5) AS med FROM ordl WHERE value IS NOT NULL GROUP BY ordinal),
        kst AS (SELECT l.ordinal, AVG(COALESCE(l.value, m.med)) AS mu, CASE WHEN stddev_pop(COALESCE(l.value, m.med)) = 0 THEN 1e0
                       ELSE stddev_pop(COALESCE(l.value, m.med)) END AS sd FROM ordl l JOIN kmed m ON m.ordinal = l.ordinal GROUP BY l.ordinal),
        kz AS (SELECT l.id, l.ordinal, (COALESCE(l.value, m.med) - s.mu) / s.sd AS z FROM ordl l JOIN kmed m ON m.ordinal = l.ordinal
               JOIN kst s ON s.ordinal = l.ordinal),
        kc AS (SELECT * FROM (VALUES (0, -1e0), (1, 0e0), (2, 1e0), (3, 2e0), (4, -2e0), (5, 0.5e0)) t(j, c)),
        kd AS (SELECT kz.id, kc.j, SUM((z - c) * (z - c)) AS d FROM kz, kc GROUP BY kz.id, kc.j),
        ka AS (SELECT t.id, t.target, k.cluster FROM ordc t JOIN (SELECT id, CAST(arg_min(j, (d, j)) AS INTEGER) AS cluster FROM kd
               WHERE j < 3 GROUP BY id) k ON k.id = t.id),
        ke AS (SELECT CAST(k AS INTEGER) AS k, SUM(d) AS inertia FROM (SELECT n.range AS k, kd.id, MIN(kd.d) AS d FROM range(1, 7) n
               JOIN kd ON kd.j < n.range GROUP BY n.range, kd.id) GROUP BY k)"""
    chain = ("ord", "ordc", "ordl")
    o["attach_cluster"] = with_views("SELECT id, target, cluster FROM ka", *chain, extra=fixed)
    o["cluster_members"] = with_views("SELECT cluster, id FROM ka", *chain, extra=fixed)
    o["export_clusters_csv"] = with_views('SELECT CAST(cluster AS VARCHAR) AS "Cluster", CAST(id AS VARCHAR) AS "ID" FROM ka', *chain,
                                          extra=fixed)
    o["cluster_analysis"] = with_views(rounded("""
        SELECT CAST(r.range AS INTEGER) AS cluster, COUNT(ka.id) AS count, COALESCE(AVG(CAST(ka.target AS DOUBLE)), 0e0) AS positive_rate
        FROM range(3) r LEFT JOIN ka ON ka.cluster = r.range GROUP BY r.range""", ["positive_rate"]), *chain, extra=fixed)
    o["one_cluster_inertia"] = with_views(rounded("SELECT 1 AS k, SUM(v) AS inertia FROM (SELECT var_pop(z) * COUNT(*) AS v FROM kz "
                                                  "GROUP BY ordinal)", ["inertia"]), *chain, extra=fixed)
    o["fixed_elbow"] = with_views(rounded("SELECT k, inertia FROM ke", ["inertia"]), *chain, extra=fixed)
    o["suggest_k"] = with_views("""
        SELECT COALESCE((SELECT k FROM (SELECT k, (LAG(inertia) OVER (ORDER BY k) - inertia) - (inertia - LEAD(inertia) OVER (ORDER BY k))
               AS diff FROM ke) WHERE diff > 0 ORDER BY diff DESC, k LIMIT 1), 2) AS suggested_k""", *chain, extra=fixed)
    o["threshold_classifier"] = with_views("""
        SELECT d.fold, d.id, d.target AS label, CAST(d.n_chars >= t.thr AS INTEGER) AS prediction
        FROM docf d JOIN (SELECT f.fold, quantile_cont(x.n_chars, 0.5) AS thr FROM (SELECT DISTINCT fold FROM docf) f
                          JOIN docf x ON x.fold <> f.fold GROUP BY f.fold) t ON t.fold = d.fold""", "doc", "docf")
    o["voting_soft"] = with_views(rounded("""
        SELECT fold, id, label, AVG(score) AS score, CAST(AVG(score) > 0.5 AS INTEGER) AS prediction
        FROM scores WHERE model IN ('price', 'lines') GROUP BY fold, id, label""", ["score"]), "ord", "scores")
    o["voting_hard"] = with_views(rounded("""
        SELECT fold, id, label, AVG(CAST(prediction AS DOUBLE)) AS score,
               CAST(AVG(CAST(prediction AS DOUBLE)) > 0.5 AS INTEGER) AS prediction
        FROM scores WHERE model IN ('price', 'lines') GROUP BY fold, id, label""", ["score"]), "ord", "scores")


_model_oracles()
