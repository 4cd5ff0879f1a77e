"""Queries of joins, statistics, evaluation, scoring and streams, each with its SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from trackyard.functions import columns as C
from trackyard.operators import evaluate, joins, scoring, stats, tensors
from trackyard.plans import views as V
from trackyard.plans.event_queries import BAD, CAP, CUTS, REGIONS, bad_values, r6
from trackyard.plans.register import register
from trackyard.sources import tables
from trackyard.streaming.multiplicity import fold_multiplicity, multiplicity_state, multiplicity_stream

JETS, EV, PER, TGT, SC, MET = V.JETS, V.EV, V.PER, V.TGT, V.SC, V.MET

# --- joins

PRED = """pa AS (SELECT *, CASE WHEN event_id % 7 = 0 THEN b1 + 1 WHEN event_id % 5 = 0 THEN b2 ELSE b1 END AS p1, CASE WHEN event_id % 7 <> 0 AND event_id % 5 = 0 THEN b1 ELSE b2 END AS p2 FROM tgt)"""


def _truth(spark, d):
    return tensors.assign_targets(V.nested(spark, d), 99).select("event_id", F.col("targets").alias("true"))


def _pred(spark, d):
    t = tensors.assign_targets(V.nested(spark, d), 99).select("event_id", "targets")
    seven, five = F.col("event_id") % 7 == 0, F.col("event_id") % 5 == 0
    b1, b2 = F.col("targets.h.b1"), F.col("targets.h.b2")
    h = F.struct(F.when(seven, b1 + 1).when(five, b2).otherwise(b1).alias("b1"), F.when(~seven & five, b1).otherwise(b2).alias("b2"))
    return t.select("event_id", F.struct(h.alias("h"), F.col("targets.t1").alias("t1"), F.col("targets.t2").alias("t2")).alias("pred"))


@register("j1_join_predictions", V.sql("SELECT event_id, CAST(b1 AS BIGINT) AS b1, CAST(p1 AS BIGINT) AS p1 FROM pa", JETS, EV, TGT, PRED))
def j1(spark, d):
    return joins.join_predictions(_truth(spark, d), _pred(spark, d)).select("event_id", F.col("true.h.b1").alias("b1"), F.col("pred.h.b1").alias("p1"))


@register("j2_attach_scores", V.sql("SELECT event_id, event_id % 10 <> 3 AS has_score, CASE WHEN event_id % 10 <> 3 THEN ROUND(tthbb, 7) END AS tthbb FROM wide", EV, SC))
def j2(spark, d):
    slices = V.scored(spark, d).where("event_id % 10 <> 3").select("event_id", "scores")
    return joins.attach_scores(V.events(spark, d), slices).select("event_id", "has_score", r6(F.get("scores", F.lit(1)), "tthbb"))


@register("j2_complete_scores", V.sql("SELECT event_id, TRUE AS has_score, ROUND(tthbb, 7) AS tthbb, ROUND(weight, 7) AS weight FROM wide", EV, SC))
def j2_complete(spark, d):
    """Every event has its scores once, else the query is an error."""
    rows = V.scored(spark, d).select("event_id", "scores")
    both = joins.attach_scores(V.events(spark, d), rows.where("event_id % 10 <> 3").union(rows.where("event_id % 10 = 3")), complete=True)
    return both.select("event_id", "has_score", r6(F.get("scores", F.lit(1)), "tthbb"), r6("weight"))


@register("j2_missing_scores", V.sql("SELECT event_id FROM ev WHERE event_id % 10 = 3", EV))
def j2_missing(spark, d):
    return joins.missing_scores(V.events(spark, d), V.scored(spark, d).where("event_id % 10 <> 3")).select("event_id")


@register("j3_dataset_dimension", V.sql("SELECT event_id, ROUND(total, 7) AS total FROM ev JOIN (SELECT sample, sum(abs(weight)) AS total FROM ev GROUP BY sample) USING (sample)", EV))
def j3(spark, d):
    e = V.events(spark, d)
    return joins.dataset_dimension(e, e.groupBy("sample").agg(F.sum(F.abs("weight")).alias("total"))).select("event_id", r6("total"))


@register("j4_resolve_sample", V.sql("SELECT c_custkey AS dataset, p_partkey AS sample FROM (SELECT c_custkey, CAST(c_acctbal AS BIGINT) AS a FROM customer) c, (SELECT p_partkey, CAST(p_retailprice * 4 AS BIGINT) AS b FROM part) p WHERE abs(a - b) <= 5 + 1e-5::DOUBLE * abs(b)"))
def j4(spark, d):
    return joins.resolve_sample(*_counts_and_flow(spark, d)).select("dataset", "sample")


def _counts_and_flow(spark, d):
    counts = V.table(spark, d, "customer").select(F.col("c_custkey").alias("dataset"), F.rint("c_acctbal").cast("long").alias("n_events"))
    flow = V.table(spark, d, "part").select(F.col("p_partkey").alias("sample"), F.rint(F.col("p_retailprice") * 4).cast("long").alias("n"))
    return counts, flow


@register("j4_unresolved", "SELECT c_custkey AS dataset FROM customer WHERE NOT EXISTS (SELECT 1 FROM part WHERE abs(CAST(c_acctbal AS BIGINT) - CAST(p_retailprice * 4 AS BIGINT)) <= 5 + 1e-5::DOUBLE * abs(CAST(p_retailprice * 4 AS BIGINT)))")
def j4_unresolved(spark, d):
    return joins.without_sample(*_counts_and_flow(spark, d)).select("dataset")


@register("j5_steps_to_epochs", V.sql("SELECT event_id, epoch FROM asofm", MET))
def j5(spark, d):
    return joins.steps_to_epochs(V.metrics(spark, d), V.epoch_marks(spark, d)).select("event_id", "epoch")


RATIO = """ratio AS (SELECT mask, n AS njet, sum(weight) FILTER (dctr = 1) / sum(weight) FILTER (dctr = 0) AS ratio FROM
  (SELECT 'all' AS mask, least(njet, 7) AS n, * FROM per WHERE njet >= 4 UNION ALL SELECT 'btag', least(njet, 7), * FROM per WHERE njet >= 4 AND nb >= 2) GROUP BY mask, n)"""


def _masked(spark, d):
    return V.counted(spark, d).withColumns({"mask_all": F.lit(True), "mask_btag": F.col("nb") >= 2})


MASKS = {"all": "mask_all", "btag": "mask_btag"}


@register("j6_apply_reweighting", V.sql("""SELECT p.event_id, ROUND(coalesce(a.ratio, 1), 7) AS weight_all, ROUND(CASE WHEN nb >= 2 THEN coalesce(b.ratio, 1) ELSE 1 END, 7) AS weight_btag FROM per p
  LEFT JOIN ratio a ON a.mask = 'all' AND least(p.njet, 7) = a.njet LEFT JOIN ratio b ON b.mask = 'btag' AND least(p.njet, 7) = b.njet""", JETS, EV, PER, RATIO))
def j6(spark, d):
    m = _masked(spark, d)
    return joins.apply_reweighting(m, stats.njet_ratios(m, MASKS), MASKS).select("event_id", r6("weight_all"), r6("weight_btag"))


# --- statistics

HIST = "hist AS (SELECT sample, njet AS n, count(*) AS events FROM per GROUP BY sample, njet)"


def stats_sql(source: str, keys: str) -> str:
    """SQL of the multiplicity figures over a histogram (keys, n, events)."""
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    tiles = ", ".join(f"CAST(coalesce(min(n) FILTER (cum > {q} * (total - 1) AND n <= 40), greatest(40, max(n))) AS DOUBLE) AS {name}" for name, q in stats.QUANTILES.items())
    return f"""SELECT {k}CAST(sum(events) AS BIGINT) AS n_events, min(n) AS n_min, max(n) AS n_max, ROUND(sum(n * events) / CAST(sum(events) AS DOUBLE), 7) AS mean, ROUND(coalesce(sum(events) FILTER (n >= 16), 0) / CAST(sum(events) AS DOUBLE), 7) AS frac_ge16,
  ROUND(coalesce(sum(events) FILTER (n > 16), 0) / CAST(sum(events) AS DOUBLE), 7) AS frac_gt16, CAST(coalesce(sum(events) FILTER (n > 40), 0) AS BIGINT) AS overflow, {tiles}
  FROM (SELECT *, sum(events) OVER ({part} ORDER BY n) AS cum, sum(events) OVER ({part}) AS total FROM {source}) {group}"""


def _rounded(df, *keys):
    return df.select(*keys, "n_events", "n_min", "n_max", r6("mean"), r6("frac_ge16"), r6("frac_gt16"), "overflow", *stats.QUANTILES)


def _hist(spark, d):
    return stats.multiplicity(V.jet_counts(spark, d), ["sample"], F.col("njet"))


@register("a1_multiplicity_stats", V.sql(stats_sql("hist", "sample"), JETS, EV, PER, HIST))
def a1(spark, d):
    return _rounded(stats.multiplicity_stats(_hist(spark, d), ["sample"]), "sample")


@register("a2_multiplicity_hist", V.sql("SELECT s.sample, CAST(b AS INT) AS n, coalesce(events, 0) AS events FROM (SELECT DISTINCT sample FROM ev) s CROSS JOIN (SELECT unnest(range(41)) AS b) LEFT JOIN hist h ON h.sample = s.sample AND h.n = b", JETS, EV, PER, HIST))
def a2(spark, d):
    return stats.multiplicity_hist(_hist(spark, d), ["sample"])


@register("a3_overall_and_per_chunk", V.sql(stats_sql("both_", "sample"), JETS, EV, PER, HIST, "both_ AS (SELECT * FROM hist UNION ALL SELECT NULL, n, sum(events) FROM hist GROUP BY n)"))
def a3(spark, d):
    return _rounded(stats.multiplicity_stats(stats.overall_and_per_chunk(_hist(spark, d), "sample"), ["sample"]), "sample")


@register("a4_discrete_percentile", V.sql("SELECT sample, CAST(min(n) AS DOUBLE) AS lowest, CAST(coalesce(min(n) FILTER (cum > 0.25 * (total - 1)), 40) AS DOUBLE) AS quarter, CAST(max(n) AS DOUBLE) AS highest FROM (SELECT *, sum(events) OVER (PARTITION BY sample ORDER BY n) AS cum, sum(events) OVER (PARTITION BY sample) AS total FROM hist) GROUP BY sample", JETS, EV, PER, HIST))
def a4(spark, d):
    return stats.discrete_percentiles(_hist(spark, d), ["sample"], 40, {"lowest": 0.0, "quarter": 0.25, "highest": 1.0})


@register("a5_exact_quantiles", V.sql("SELECT sample, ROUND(quantile_cont(njet, 0.25), 7) AS q25, ROUND(quantile_cont(njet, 0.5), 7) AS q50, ROUND(quantile_cont(njet, 0.99), 7) AS q99 FROM per GROUP BY sample", JETS, EV, PER))
def a5(spark, d):
    n = stats.exact_quantiles(_hist(spark, d), ["sample"], {"q25": 0.25, "q50": 0.5, "q99": 0.99})
    return n.select("sample", r6("q25"), r6("q50"), r6("q99"))


@register("a6_masked_multiplicity", V.sql(f"SELECT least(njet, {CAP}) AS n, coalesce(m, 0) AS matched, count(*) AS events FROM per LEFT JOIN (SELECT event_id AS e, CAST(count(*) AS INT) AS m FROM jets WHERE prov > 0 GROUP BY event_id) ON per.event_id = e GROUP BY ALL", JETS, EV, PER))
def a6(spark, d):
    mask = C.count_true(C.mask_from_pt(C.pad_clip(F.col("jets.pt"), CAP, 0.0)))
    n = V.nested(spark, d).withColumn("matched", F.size(F.filter("jets.prov", lambda p: p > 0)))
    return stats.multiplicity(n, ["matched"], mask)


@register("a7_event_fractions", V.sql("SELECT s AS signal, label, count(event_id) AS events, ROUND(100.0::DOUBLE * count(event_id) / (SELECT count(*) FROM ev), 7) AS percent FROM (SELECT unnest([1,2,3,4,5,6]) AS s, unnest(['tthbb','qcd','ttlf','ttcc','ttbb','singletop']) AS label) LEFT JOIN ev ON signal = s GROUP BY s, label", EV))
def a7(spark, d):
    names = {k: tensors.CLASSES[k] for k in range(1, 7)}
    return stats.event_fractions(V.events(spark, d), names, "signal").select("signal", "label", "events", r6("percent"))


@register("a8_njet_ratio_map", V.sql("SELECT mask, njet, ROUND(ratio, 7) AS ratio FROM ratio", JETS, EV, PER, RATIO))
def a8(spark, d):
    return stats.njet_ratios(_masked(spark, d), MASKS).select("mask", "njet", r6("ratio"))


# --- evaluation

COUNTS = "cm AS (SELECT signal AS t, predicted AS p, sum(weight) AS w FROM wide GROUP BY signal, predicted)"
CLS = "cls AS (SELECT CAST(unnest(range(1, 10)) AS INT) AS c)"
PE = """pe AS (SELECT c AS class, coalesce((SELECT sum(w) FROM cm WHERE t = c AND p = c), 0) AS hit, coalesce((SELECT sum(w) FROM cm WHERE p = c), 0) AS n_region, coalesce((SELECT sum(w) FROM cm WHERE t = c), 0) AS n_target FROM cls),
pf AS (SELECT *, CASE WHEN n_region > 0 THEN hit / n_region ELSE 0 END AS purity, CASE WHEN n_target > 0 THEN hit / n_target ELSE 0 END AS efficiency FROM pe)"""


def _cm(spark, d):
    return evaluate.confusion_counts(V.wide(spark, d), weight=F.col("weight"))


@register("a9_weighted_composition", V.sql('SELECT region, signal AS "true", ROUND(sum(weight), 7) AS w FROM regions GROUP BY region, signal HAVING sum(weight) > 0', EV, SC, REGIONS))
def a9(spark, d):
    from trackyard.operators.select import cut_regions

    return evaluate.weighted_composition(cut_regions(V.wide(spark, d), CUTS), "region").select("region", "true", r6("w"))


@register("a10_argmax_purity_efficiency", V.sql("SELECT class, ROUND(purity, 7) AS purity, ROUND(efficiency, 7) AS efficiency, ROUND(n_region, 7) AS n_region, ROUND(n_target, 7) AS n_target FROM pf", EV, SC, COUNTS, CLS, PE))
def a10(spark, d):
    return evaluate.argmax_purity_efficiency(_cm(spark, d)).select("class", r6("purity"), r6("efficiency"), r6("n_region"), r6("n_target"))


@register("a11_region_purity_efficiency", V.sql("""SELECT region, target, ROUND(CASE WHEN sum(weight) > 0 THEN sum(CASE WHEN signal = target THEN weight ELSE 0 END) / sum(weight) ELSE 0 END, 7) AS purity,
  ROUND(CASE WHEN any_value(n_target) > 0 THEN sum(CASE WHEN signal = target THEN weight ELSE 0 END) / any_value(n_target) ELSE 0 END, 7) AS efficiency, ROUND(sum(weight), 7) AS n_region, ROUND(any_value(n_target), 7) AS n_target
  FROM regions JOIN (SELECT signal AS s, sum(weight) AS n_target FROM wide GROUP BY signal) ON target = s GROUP BY region, target""", EV, SC, REGIONS))
def a11(spark, d):
    from trackyard.operators.select import cut_regions

    w = V.wide(spark, d)
    return evaluate.region_purity_efficiency(cut_regions(w, CUTS), w).select("region", "target", r6("purity"), r6("efficiency"), r6("n_region"), r6("n_target"))


FULL = "fullcm AS (SELECT a.c AS t, b.c AS p, coalesce(w, 0) AS w FROM cls a CROSS JOIN cls b LEFT JOIN cm ON t = a.c AND p = b.c)"


def _norm_sql(expression: str) -> str:
    return V.sql(f'SELECT t AS "true", p AS pred, ROUND({expression}, 7) AS value FROM fullcm', EV, SC, COUNTS, CLS, FULL)


@register("a12_confusion_matrix", _norm_sql("w"))
def a12(spark, d):
    return evaluate.confusion_matrix(_cm(spark, d)).select("true", "pred", r6("value"))


@register("a12_confusion_matrix_true", _norm_sql("CASE WHEN sum(w) OVER (PARTITION BY t) <> 0 THEN w / sum(w) OVER (PARTITION BY t) ELSE 0 END"))
def a12_true(spark, d):
    return evaluate.confusion_matrix(_cm(spark, d), "true").select("true", "pred", r6("value"))


@register("a12_confusion_matrix_pred", _norm_sql("CASE WHEN sum(w) OVER (PARTITION BY p) <> 0 THEN w / sum(w) OVER (PARTITION BY p) ELSE 0 END"))
def a12_pred(spark, d):
    return evaluate.confusion_matrix(_cm(spark, d), "pred").select("true", "pred", r6("value"))


@register("a13_classification_report", V.sql("SELECT class, ROUND(purity, 7) AS precision, ROUND(efficiency, 7) AS recall, ROUND(CASE WHEN purity + efficiency > 0 THEN 2 * purity * efficiency / (purity + efficiency) ELSE 0 END, 7) AS f1, ROUND(n_target, 7) AS support FROM pf", EV, SC, "cm AS (SELECT signal AS t, predicted AS p, CAST(count(*) AS DOUBLE) AS w FROM wide GROUP BY signal, predicted)", CLS, PE))
def a13(spark, d):
    return evaluate.classification_report(evaluate.confusion_counts(V.wide(spark, d))).select("class", r6("precision"), r6("recall"), r6("f1"), r6("support"))


@register("a14_score_histogram", V.sql("SELECT signal, CAST(least(floor(tthbb / (1.0::DOUBLE / 50)), 49) AS INT) AS bin, ROUND(sum(weight), 7) AS value FROM wide GROUP BY ALL", EV, SC))
def a14(spark, d):
    return evaluate.score_histogram(V.wide(spark, d), "tthbb", "signal").select("signal", "bin", r6("value"))


@register("a14_score_density", V.sql("SELECT signal, bin, ROUND(v * 50 / sum(v) OVER (PARTITION BY signal), 7) AS value FROM (SELECT signal, CAST(least(floor(tthbb / (1.0::DOUBLE / 50)), 49) AS INT) AS bin, sum(abs(weight)) AS v FROM wide GROUP BY ALL)", EV, SC))
def a14_density(spark, d):
    w = V.wide(spark, d).withColumn("weight", F.abs("weight"))
    return evaluate.score_histogram(w, "tthbb", "signal", density=True).select("signal", "bin", r6("value"))


@register("a15_njet_nbjet_hist", V.sql("SELECT 'njet' AS what, least(njet, 15) AS bin, ROUND(sum(weight), 7) AS value FROM per WHERE njet BETWEEN 6 AND 16 GROUP BY ALL UNION ALL SELECT 'nbjet', least(nb, 7), ROUND(sum(weight), 7) FROM per WHERE nb BETWEEN 0 AND 8 GROUP BY ALL", JETS, EV, PER))
def a15(spark, d):
    n = V.counted(spark, d)
    njet = F.size(F.filter("jets.pt", lambda x: x > 0))
    both = evaluate.count_histogram(n, njet, 6, 16).withColumn("what", F.lit("njet")).unionByName(evaluate.count_histogram(n, F.col("nb"), 0, 8).withColumn("what", F.lit("nbjet")))
    return both.select("what", "bin", r6("value"))


@register("a16_score_2d_hist", V.sql("SELECT a AS bin_a, b AS bin_b, CASE WHEN v >= 1e-5::DOUBLE THEN ROUND(v, 7) END AS value FROM (SELECT CAST(least(floor(tthbb / (1.0::DOUBLE / 10)), 9) AS INT) AS a, CAST(least(floor(qcd / (1.0::DOUBLE / 10)), 9) AS INT) AS b, sum(weight) AS v FROM wide GROUP BY ALL)", EV, SC))
def a16(spark, d):
    return evaluate.score_2d_hist(V.wide(spark, d), "tthbb", "qcd").select("bin_a", "bin_b", r6("value"))


@register("a17_score_correlation", V.sql("SELECT signal, 'tthbb' AS a, 'qcd' AS b, ROUND(corr(tthbb, qcd), 7) AS corr FROM wide GROUP BY signal UNION ALL SELECT signal, 'tthbb', 'ttlf', ROUND(corr(tthbb, ttlf), 7) FROM wide GROUP BY signal UNION ALL SELECT signal, 'qcd', 'ttlf', ROUND(corr(qcd, ttlf), 7) FROM wide GROUP BY signal", EV, SC))
def a17(spark, d):
    return evaluate.score_correlation(V.wide(spark, d), ["tthbb", "qcd", "ttlf"], "signal").where("a <> b").select("signal", "a", "b", r6("corr"))


TRUTH = 'truth AS (SELECT CAST(i AS INT) AS class, signal = i AS is_true, ROUND(s, 9) AS score, abs(weight) AS w FROM sc WHERE i BETWEEN 1 AND 5)'
ROC = """dist AS (SELECT class, score, sum(CASE WHEN is_true THEN w ELSE 0 END) AS p, sum(CASE WHEN is_true THEN 0 ELSE w END) AS n FROM truth GROUP BY class, score),
roc AS (SELECT *, sum(p) OVER (PARTITION BY class ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY class ORDER BY score DESC) AS fp, sum(p) OVER (PARTITION BY class) AS pos, sum(n) OVER (PARTITION BY class) AS neg FROM dist)"""


def _truth_rows(spark, d):
    return tensors.truth_prediction(V.scored(spark, d)).where("class <= 5").select("class", "is_true", F.round("score", 9).alias("score"), F.abs("weight").alias("weight"))


@register("t19_binary_heads", V.sql("SELECT event_id, 'b' AS class, signal = 5 AS is_true, ROUND(ttbb, 7) AS score FROM wide UNION ALL SELECT event_id, 'c', signal = 4, ROUND(ttcc, 7) FROM wide", EV, SC))
def binary(spark, d):
    w = V.wide(spark, d).select("event_id", *[F.array(1 - F.col(c), F.col(c)).alias(f"head_{c}") for c in ("ttbb", "ttcc")], (F.col("signal") == 5).cast("int").alias("is_b"), (F.col("signal") == 4).cast("int").alias("is_c"))
    w = w.withColumnsRenamed({"head_ttbb": "b", "head_ttcc": "c"})
    return tensors.binary_heads(w, {"b": "is_b", "c": "is_c"}).select("event_id", "class", "is_true", r6("score"))


@register("a18_roc_curve", V.sql("SELECT class, ROUND(score, 9) AS score, ROUND(fp / neg, 7) AS fpr, ROUND(tp / pos, 7) AS tpr FROM roc", EV, SC, TRUTH, ROC))
def a18(spark, d):
    return evaluate.roc_points(_truth_rows(spark, d), "class").select("class", F.round("score", 9).alias("score"), r6("fpr"), r6("tpr"))


@register("a18_auc", V.sql("SELECT class, ROUND(sum(n / neg * (tp - p / 2) / pos), 7) AS auc FROM roc GROUP BY class", EV, SC, TRUTH, ROC))
def a18_auc(spark, d):
    return evaluate.auc(evaluate.roc_points(_truth_rows(spark, d), "class"), "class").select("class", r6("auc"))


#: Two classes only: events of either, by the share of one in both. Then the signal by each derived score.
TWO = "truth AS (SELECT CAST(1 AS INT) AS class, signal = 1 AS is_true, ROUND(tthbb / (tthbb + ttbb), 9) AS score, abs(weight) AS w FROM wide WHERE signal IN (1, 5))"
DERIVED = """truth AS (SELECT k AS class, signal = 1 AS is_true, ROUND(CASE k WHEN 'tthbb_vs_ttbb' THEN tthbb / (tthbb + ttbb + 1e-6::DOUBLE) WHEN 'tthbb_vs_qcd_ttbb' THEN tthbb / (tthbb + ttbb + qcd + 1e-6::DOUBLE)
  ELSE tthbb / (tthbb + ttbb + qcd + ttlf + ttcc + 1e-6::DOUBLE) END, 9) AS score, abs(weight) AS w FROM wide, (SELECT unnest(['tthbb_vs_ttbb', 'tthbb_vs_qcd_ttbb', 'tthbb_vs_qcd_ttbar']) AS k))"""


@register("a18_restricted_roc", V.sql("SELECT ROUND(score, 9) AS score, ROUND(fp / neg, 7) AS fpr, ROUND(tp / pos, 7) AS tpr FROM roc", EV, SC, TWO, ROC))
def a18_two(spark, d):
    rows = evaluate.two_classes(V.wide(spark, d).withColumn("weight", F.abs("weight")), {1: "tthbb", 5: "ttbb"})
    points = evaluate.roc_points(rows.withColumn("score", F.round("score", 9)))
    return points.select(F.round("score", 9).alias("score"), r6("fpr"), r6("tpr"))


@register("a18_derived_auc", V.sql("SELECT class AS score_name, ROUND(sum(n / neg * (tp - p / 2) / pos), 7) AS auc FROM roc GROUP BY class", EV, SC, DERIVED, ROC))
def a18_derived(spark, d):
    rows = evaluate.named_scores(tensors.derived_scores(V.wide(spark, d)).withColumn("weight", F.abs("weight")), ["tthbb_vs_ttbb", "tthbb_vs_qcd_ttbb", "tthbb_vs_qcd_ttbar"], F.col("signal") == 1)
    points = evaluate.roc_points(rows.withColumn("score", F.round("score", 9)), "score_name")
    return evaluate.auc(points, "score_name").select("score_name", r6("auc"))


@register("a19_binned_significance", V.sql("SELECT bin, ROUND(CASE WHEN b > 0 THEN s / sqrt(b) ELSE 0 END, 7) AS value FROM (SELECT CAST(least(floor(tthbb * 30), 29) AS INT) AS bin, sum(CASE WHEN signal = 1 THEN weight ELSE 0 END) AS s, sum(CASE WHEN signal = 1 THEN 0 ELSE weight END) AS b FROM wide GROUP BY 1)", EV, SC))
def a19(spark, d):
    return evaluate.binned_significance(V.wide(spark, d), "tthbb", F.col("signal") == 1).select("bin", r6("value"))


CUM = """SELECT CAST(k AS INT) AS k, ROUND(k / 99.0::DOUBLE, 7) AS threshold, ROUND(CASE WHEN sum(CASE WHEN signal <> 1 THEN weight ELSE 0 END) > 0 THEN sum(CASE WHEN signal = 1 THEN weight ELSE 0 END) / sqrt(sum(CASE WHEN signal <> 1 THEN weight ELSE 0 END)) ELSE 0 END, 7) AS value
  FROM (SELECT unnest(range(100)) AS k) LEFT JOIN {0} ON tthbb > k / 99.0::DOUBLE GROUP BY k"""


@register("a20_cumulative_significance", V.sql(CUM.format("wide"), EV, SC))
def a20(spark, d):
    return evaluate.cumulative_significance(V.wide(spark, d), "tthbb", F.col("signal") == 1).select("k", r6("threshold"), r6("value"))


@register("a20_cumulative_significance_predicted", V.sql(CUM.format("(SELECT * FROM wide WHERE predicted = 1)"), EV, SC))
def a20_predicted(spark, d):
    return evaluate.cumulative_significance(V.wide(spark, d).where("predicted = 1"), "tthbb", F.col("signal") == 1).select("k", r6("threshold"), r6("value"))


@register("a21_assignment_efficiency", V.sql("SELECT ROUND(avg(CAST(b1 = p1 AND b2 = p2 AS INT)), 7) AS h, CAST(1 AS DOUBLE) AS t1 FROM pa", JETS, EV, TGT, PRED))
def a21(spark, d):
    both = joins.join_predictions(_truth(spark, d), _pred(spark, d))
    return evaluate.assignment_efficiency(both, {"h": ["b1", "b2"], "t1": ["q1", "q2", "b"]}).select(r6("h"), "t1")


@register("a22_swap_counts", V.sql("SELECT count(*) FILTER (b1 = p2 AND b2 = p1) AS swapped, count(*) FILTER (b1 <> p1) AS first_differs, count(*) FILTER (b2 <> p2) AS second_differs, ROUND(avg(CAST((b1 = p1 AND b2 = p2) OR (b1 = p2 AND b2 = p1) AS INT)), 7) AS either_way FROM pa", JETS, EV, TGT, PRED))
def a22(spark, d):
    return evaluate.swap_counts(joins.join_predictions(_truth(spark, d), _pred(spark, d)), "h", "b1", "b2").select("swapped", "first_differs", "second_differs", r6("either_way"))


# --- data quality


def _long_bad(spark, d):
    return bad_values(spark, d).withColumn("dataset", F.when(F.col("pos") == 0, "leading").otherwise("others"))


LONG = "lng AS (SELECT *, CASE WHEN pos = 0 THEN 'leading' ELSE 'others' END AS dataset FROM bad)"


@register("a23_nonfinite_report", V.sql("""SELECT dataset, count(*) AS total, count(*) FILTER (isnan(value)) AS n_nan, count(*) FILTER (isinf(value) AND value > 0) AS n_posinf, count(*) FILTER (isinf(value) AND value < 0) AS n_neginf,
  count(*) FILTER (NOT isnan(value) AND NOT isinf(value)) AS n_finite, ROUND(100.0::DOUBLE * count(*) FILTER (isnan(value) OR isinf(value)) / count(*), 7) AS bad_percent FROM lng GROUP BY dataset""", JETS, BAD, LONG))
def a23(spark, d):
    return stats.nonfinite_report(_long_bad(spark, d)).select("dataset", "total", "n_nan", "n_posinf", "n_neginf", "n_finite", r6("bad_percent"))


@register("k4_examples_top_k", V.sql("SELECT dataset, CAST(k AS INT) AS k, event_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY event_id, pos) AS k FROM lng WHERE isnan(value) OR isinf(value)) WHERE k <= 16", JETS, BAD, LONG))
def k4(spark, d):
    return stats.examples_top_k(_long_bad(spark, d))


@register("a24_ordering_check", V.sql("SELECT (SELECT count(*) FROM ev) AS events, count(DISTINCT a.event_id) AS bad FROM jets a JOIN jets b ON a.event_id = b.event_id AND b.pos = a.pos + 1 AND b.btag > a.btag", JETS, EV))
def a24(spark, d):
    n = V.nested(spark, d).withColumn("jets", F.transform("jets", lambda j: F.struct(j["btag"].alias("pt"))))
    return stats.ordering_check(n)


@register("a25_clipping_risk", V.sql("SELECT sample, ROUND(avg(coalesce(r, 0)), 7) AS risk FROM ev LEFT JOIN (SELECT event_id AS e, 1 AS r FROM jets WHERE pos > 5 AND prov >= 0 GROUP BY event_id) ON event_id = e GROUP BY sample", JETS, EV))
def a25(spark, d):
    return stats.clipping_risk(V.nested(spark, d), ["sample"], 5).select("sample", r6("risk"))


@register("a26_feature_hist_by_rank", V.sql("""SELECT 'btag' AS feature, pos AS rank, bin, n AS count, ROUND(n / (sum(n) OVER (PARTITION BY pos) * w), 7) AS density FROM
  (SELECT pos, CASE WHEN btag >= 0.8::DOUBLE THEN 2 WHEN btag >= 0.4::DOUBLE THEN 1 ELSE 0 END AS bin, CASE WHEN btag >= 0.8::DOUBLE THEN 1.0::DOUBLE - 0.8::DOUBLE WHEN btag >= 0.4::DOUBLE THEN 0.8::DOUBLE - 0.4::DOUBLE ELSE 0.4::DOUBLE END AS w, count(*) AS n FROM jets WHERE pos < 8 AND btag BETWEEN 0 AND 1 GROUP BY ALL)
  UNION ALL SELECT 'btag_M', pos, btag_M, count(*), ROUND(count(*) / CAST(sum(count(*)) OVER (PARTITION BY pos) AS DOUBLE), 7) FROM jets WHERE pos < 8 GROUP BY pos, btag_M""", JETS))
def a26(spark, d):
    return stats.feature_hist_by_rank(V.nested(spark, d), {"btag": [0.0, 0.4, 0.8, 1.0], "btag_M": [0, 1, 2]}).select("feature", "rank", "bin", "count", r6("density"))


@register("a27_epoch_mean", V.sql("SELECT tag, epoch, ROUND(avg(value), 7) AS value FROM asofm GROUP BY tag, epoch", MET))
def a27(spark, d):
    return stats.epoch_mean(joins.steps_to_epochs(V.metrics(spark, d), V.epoch_marks(spark, d))).select("tag", "epoch", r6("value"))


@register("a28_metric_summary", V.sql("SELECT tag, count(*) AS n, min(step) AS min_step, max(step) AS max_step, ROUND(min(value), 7) AS min_value, ROUND(max(value), 7) AS max_value FROM met GROUP BY tag", MET))
def a28(spark, d):
    return stats.metric_summary(V.metrics(spark, d)).select("tag", "n", "min_step", "max_step", r6("min_value"), r6("max_value"))


@register("a28_missing_tags", V.sql("SELECT t AS tag, EXISTS (SELECT 1 FROM met WHERE met.tag = t) AS present FROM (SELECT unnest(['click', 'validation/loss']) AS t)", MET))
def a28_missing(spark, d):
    return stats.missing_tags(V.metrics(spark, d), ["click", "validation/loss"])


@register("a29_best_value", V.sql("SELECT tag, ROUND(CASE WHEN contains(lower(tag), 'loss') THEN min(value) FILTER (NOT isnan(value)) ELSE max(value) FILTER (NOT isnan(value)) END, 7) AS best FROM (SELECT CASE WHEN event_id % 2 = 0 THEN tag || '/Loss' ELSE tag END AS tag, CASE WHEN event_id % 9 = 0 THEN 'nan'::DOUBLE ELSE value END AS value FROM met) GROUP BY tag", MET))
def a29(spark, d):
    e = F.col("event_id")
    m = V.metrics(spark, d).withColumns({"tag": F.when(e % 2 == 0, F.concat("tag", F.lit("/Loss"))).otherwise(F.col("tag")), "value": F.when(e % 9 == 0, F.lit(float("nan"))).otherwise(F.col("value"))})
    return stats.best_value(m).select("tag", r6("best"))


@register("a30_plot_bounds", V.sql("SELECT tag, ROUND(greatest(0, a - 0.05::DOUBLE * (b - a)), 7) AS lower, ROUND(least(150, b + 0.05::DOUBLE * (b - a)), 7) AS upper FROM (SELECT tag, quantile_cont(value, 0.01) AS a, quantile_cont(value, 0.99) AS b FROM met GROUP BY tag)", MET))
def a30(spark, d):
    return stats.plot_bounds(V.metrics(spark, d), ["tag"], 0.0, 150.0).select("tag", r6("lower"), r6("upper"))


@register("a31_unmatched_fraction", V.sql("SELECT sample, ROUND(avg(CASE WHEN prov = -1 THEN 1.0::DOUBLE ELSE 0 END), 7) AS unmatched, (SELECT ROUND(avg(weight), 7) FROM ev e WHERE weight > 0 AND e.sample = ev.sample) AS mean_weight FROM ev JOIN jets USING (event_id) GROUP BY sample", JETS, EV))
def a31(spark, d):
    return stats.unmatched_fraction(V.nested(spark, d), ["sample"]).select("sample", r6("unmatched"), r6("mean_weight"))


@register("a31_weight_histogram", V.sql("""SELECT sample, bin, CASE WHEN bin >= 0 THEN ROUND(-1 + bin * (2 / 50.0::DOUBLE), 7) END AS low, CASE WHEN bin < 50 THEN ROUND(-1 + (bin + 1) * (2 / 50.0::DOUBLE), 7) END AS high, count(*) AS events
  FROM (SELECT sample, CAST(CASE WHEN weight < -1 THEN -1 WHEN weight > 1 THEN 50 ELSE least(floor((CAST(weight AS DOUBLE) + 1) / (2 / 50.0::DOUBLE)), 49) END AS INT) AS bin FROM ev) GROUP BY sample, bin""", EV))
def a31_weights(spark, d):
    return stats.weight_histogram(V.events(spark, d), ["sample"]).select("sample", "bin", r6("low"), r6("high"), "events")


QUANT = """dist AS (SELECT ROUND(tthbb, 9) AS x, sum(abs(weight)) AS w FROM wide GROUP BY 1), cum AS (SELECT x, sum(w) OVER (ORDER BY x) / sum(w) OVER () AS sh FROM dist),
qt AS (SELECT k, k / 50.0::DOUBLE AS p, CASE WHEN k = 50 THEN (SELECT max(x) FROM cum) ELSE (SELECT min(x) FROM cum WHERE sh > k / 50.0::DOUBLE) END AS hi, (SELECT max(sh) FROM cum WHERE sh <= k / 50.0::DOUBLE) AS lsh, (SELECT max(x) FROM cum WHERE sh <= k / 50.0::DOUBLE) AS lo, (SELECT min(sh) FROM cum WHERE sh > k / 50.0::DOUBLE) AS hsh FROM (SELECT unnest(range(51)) AS k)),
qv AS (SELECT CAST(k AS INT) AS k, p, CASE WHEN k = 50 OR lo IS NULL THEN hi ELSE lo + (hi - lo) * (p - lsh) / (hsh - lsh) END AS quantile FROM qt)"""


def _quantiles(wide):
    w = wide.select(F.round("tthbb", 9).alias("x"), F.abs("weight").alias("w"))
    return evaluate.weighted_quantiles(w, "x", "w", 51)


@register("a32_weighted_quantiles", V.sql("SELECT k, ROUND(quantile, 7) AS quantile, ROUND(p, 7) AS reference FROM qv", EV, SC, QUANT))
def a32(spark, d):
    return _quantiles(V.wide(spark, d)).select("k", r6("quantile"), r6("reference"))


THROUGH = """tr AS (SELECT event_id, weight, x, CASE WHEN x <= (SELECT min(quantile) FROM qv) THEN 0 WHEN x >= (SELECT max(quantile) FROM qv) THEN 1 ELSE a.p + (b.p - a.p) * (x - a.quantile) / (b.quantile - a.quantile) END AS u
  FROM (SELECT event_id, abs(weight) AS weight, tthbb AS x FROM wide) e LEFT JOIN qv a ON a.quantile <= e.x AND e.x < (SELECT n.quantile FROM qv n WHERE n.k = a.k + 1) LEFT JOIN qv b ON b.k = a.k + 1)"""


def _through(spark, d):
    wide = V.wide(spark, d)
    table = tables.cut(_quantiles(wide))
    return scoring.quantile_transform(wide.withColumn("weight", F.abs("weight")), table, "tthbb", "u")


@register("a33_uniformity_check", V.sql('SELECT ROUND(max(v) / (sum(v) / 10) - 1, 4) AS "over", ROUND(1 - min(v) / (sum(v) / 10), 4) AS under, count(*) AS filled FROM (SELECT CAST(least(floor(u / (1.0::DOUBLE / 10)), 9) AS INT) AS bin, sum(weight) AS v FROM tr GROUP BY 1)', EV, SC, QUANT, THROUGH))
def a33(spark, d):
    h = evaluate.score_histogram(_through(spark, d).withColumn("all", F.lit(1)), "u", "all", bins=10)
    return evaluate.uniformity(h, 10).select(F.round("over", 4).alias("over"), F.round("under", 4).alias("under"), "filled")


@register("a34_array_shape_report", V.sql(f"SELECT 'pt' AS dataset, {CAP} AS least, {CAP} AS most, TRUE AS even UNION ALL SELECT 'raw', min(njet), max(njet), min(njet) = max(njet) FROM per", JETS, EV, PER))
def a34(spark, d):
    n = V.nested(spark, d).select(C.pad_clip(F.col("jets.pt"), CAP, 0.0).alias("pt"), F.col("jets.pt").alias("raw"))
    return stats.array_shape_report(n, ["pt", "raw"]).select("dataset", "least", "most", "even")


@register("a35_weight_invariant", V.sql("SELECT CAST(sum(dctr) AS BIGINT) AS data_rows, CAST(0 AS BIGINT) AS changed FROM ev", EV))
def a35(spark, d):
    m = _masked(spark, d).withColumns({"is_data": F.col("dctr") == 1, "weight_original": F.col("weight"), "mask_all": F.col("dctr") == 0})
    m = joins.apply_reweighting(m, stats.njet_ratios(_masked(spark, d), {"all": "mask_all"}), {"all": "mask_all"})
    return stats.weight_invariant(m.withColumn("weight", F.col("weight") * F.col("weight_all")))


@register("a35_changed_weights", V.sql("SELECT CAST(sum(dctr) AS BIGINT) AS data_rows, count(*) FILTER (dctr = 1 AND njet >= 4 AND weight <> 0) AS changed FROM per", JETS, EV, PER))
def a35_changed(spark, d):
    """A mask that also holds data: the check counts the rows that it must not have touched."""
    m = _masked(spark, d).withColumns({"is_data": F.col("dctr") == 1, "weight_original": F.col("weight")})
    m = joins.apply_reweighting(m, stats.njet_ratios(_masked(spark, d), {"all": "mask_all"}), {"all": "mask_all"})
    return stats.weight_invariant(m.withColumn("weight", F.col("weight") * F.col("weight_all")))


# --- scoring and streams

W, B = np.array([[0.5, -0.25, 0.0], [0.0, 0.125, -0.5]]), np.array([0.0, 0.25, 0.5])


@register("x1_score_events", V.sql("SELECT event_id, ROUND(exp(a) / (exp(a) + exp(b) + exp(c)), 7) AS first, ROUND(exp(c) / (exp(a) + exp(b) + exp(c)), 7) AS last FROM (SELECT event_id, 0.5::DOUBLE * njet AS a, -0.25::DOUBLE * njet + 0.125::DOUBLE * nb + 0.25::DOUBLE AS b, -0.5::DOUBLE * nb + 0.5::DOUBLE AS c FROM per)", JETS, EV, PER))
def x1(spark, d):
    n = V.counted(spark, d).select("event_id", F.array(F.col("njet").cast("double"), F.col("nb").cast("double")).alias("v"))
    return scoring.score_events(n, scoring.linear_softmax(W, B), "v").select("event_id", r6(F.col("scores")[0], "first"), r6(F.col("scores")[2], "last"))


#: Of jets (pt, eta, btag) and of events (njet, nb), for three classes.
WJ, WE, BE = np.array([[0.001, 0.0, -0.001], [0.25, -0.5, 0.0], [0.0, 0.5, 1.0]]), np.array([[0.125, 0.0, -0.125], [-0.25, 0.25, 0.5]]), np.array([0.0, 0.25, -0.5])


def _inputs(spark, d):
    """Padded jets with their mask and event features, as a network takes them."""
    n = V.counted(spark, d).select("event_id", "njet", "nb", "jets")
    pads = {f: C.pad_clip(F.col(f"jets.{f}").cast("array<double>"), CAP, 0.0) for f in ("pt", "eta", "btag")}
    parts = n.select("event_id", F.struct(F.struct(*[c.alias(f) for f, c in pads.items()], C.mask_from_pt(pads["pt"]).alias("MASK")).alias("Jet"), F.struct(F.col("njet").cast("double").alias("njet"), F.col("nb").cast("double").alias("nb")).alias("Event")).alias("inputs"))
    stacked = tensors.stack_features(parts, {"Jet": ["pt", "eta", "btag"]}, {"Event": ["njet", "nb"]})
    return stacked.select("event_id", "Jet_data", "Jet_mask", F.element_at("Event_data", 1).alias("Event_data"))


FEED = {"jets": "Jet_data", "mask": "Jet_mask", "event": "Event_data"}
NET = scoring.masked_linear(WJ, WE, BE, "jets", "mask", "event")
PADDED = f"""seen AS (SELECT event_id, avg(CAST(pt AS DOUBLE)) AS pt, avg(CAST(eta AS DOUBLE)) AS eta, avg(CAST(btag AS DOUBLE)) AS btag FROM jets WHERE pos < {CAP} AND pt <> 0 GROUP BY event_id),
x AS (SELECT per.event_id, coalesce(pt, 0) AS pt, coalesce(eta, 0) AS eta, coalesce(btag, 0) AS btag, njet, nb FROM per LEFT JOIN seen ON per.event_id = seen.event_id),
z AS (SELECT event_id, 0.001::DOUBLE * pt + 0.25::DOUBLE * eta + 0.125::DOUBLE * njet - 0.25::DOUBLE * nb AS a, -0.5::DOUBLE * eta + 0.5::DOUBLE * btag + 0.25::DOUBLE * nb + 0.25::DOUBLE AS b,
  -0.001::DOUBLE * pt + btag - 0.125::DOUBLE * njet + 0.5::DOUBLE * nb - 0.5::DOUBLE AS c FROM x),
net AS (SELECT event_id, 1 / (1 + exp(b - a) + exp(c - a)) AS first, 1 / (1 + exp(a - c) + exp(b - c)) AS last FROM z)"""


@register("x1_score_inputs", V.sql("SELECT event_id, ROUND(first, 7) AS first, ROUND(last, 7) AS last FROM net", JETS, EV, PER, PADDED))
def x1_inputs(spark, d):
    found = scoring.score_inputs(_inputs(spark, d), NET, FEED, batch=500)
    return found.select("event_id", r6(F.col("scores")[0], "first"), r6(F.col("scores")[2], "last"))


@register("x1_resumed_slices", V.sql("SELECT event_id, CAST((row_number() OVER (ORDER BY event_id) * 6 - 1) // (SELECT count(*) FROM ev) AS INT) AS slice, ROUND(first, 7) AS first, ROUND(last, 7) AS last FROM net", JETS, EV, PER, PADDED))
def x1_slices(spark, d):
    """Scored in two runs: the second takes up what the first has left."""
    rows, path = tables.cut(_inputs(spark, d)), tables.workspace(spark)
    scoring.score_slices(rows, NET, FEED, path, 6, most=3)
    scoring.score_slices(rows, NET, FEED, path, 6)
    return scoring.merged_slices(spark, path).select("event_id", "slice", r6(F.col("scores")[0], "first"), r6(F.col("scores")[2], "last"))


@register("x2_quantile_transform", V.sql("SELECT event_id, ROUND(u, 7) AS u FROM tr", EV, SC, QUANT, THROUGH))
def x2(spark, d):
    return _through(spark, d).select("event_id", r6("u"))


#: A normal target is infinite at both ends, and so up to the next quantile.
NORMAL = "SELECT event_id, u < 1 / 50.0::DOUBLE AS low, u > 49 / 50.0::DOUBLE AS high, ROUND(u, 7) AS u FROM tr"


@register("x2_merged_quantiles", V.sql(NORMAL, EV, SC, QUANT, THROUGH))
def x2_merged(spark, d):
    """The same through the merge that tables above the bound take, with the ends of a normal target."""
    wide = V.wide(spark, d)
    table, rows = tables.cut(_quantiles(wide)), wide.select("event_id", "tthbb")
    both = scoring.quantile_transform(scoring.merge_quantiles(rows, table, "tthbb", "u"), table, "tthbb", "z", "normal", most=1)
    inf = float("inf")
    return both.select("event_id", (F.col("z") == -inf).alias("low"), (F.col("z") == inf).alias("high"), r6("u"))


COUNTED = "SELECT sample, njet AS n, count(*) AS events FROM per GROUP BY sample, njet"


def _arrive(rows, most, path, mode="errorifexists"):
    """Nested events as files that arrive under ``path``: those of the tasks that nest them, of at most ``most`` rows; the number of files there."""
    rows.write.mode(mode).option("maxRecordsPerFile", max(1, most)).parquet(path)
    return len(rows.sparkSession.read.schema(rows.schema).parquet(path).inputFiles())


@register("r1_multiplicity_stream", V.sql(COUNTED, JETS, EV, PER))
def r1(spark, d):
    """Three files at least, in three micro-batches at most, however many files there are."""
    n = V.nested(spark, d).select("event_id", "sample", "jets")
    path = tables.workspace(spark)
    files = _arrive(n, -(-V.events(spark, d).count() // 3), path)
    return multiplicity_stream(spark, path, n.schema, ["sample"], F.size("jets.pt"), tables.workspace(spark), -(-files // 3))


@register("r1_resumed_stream", V.sql("SELECT c.*, r.rows AS second_read FROM (" + COUNTED + ") c, (SELECT count(*) AS rows FROM ev WHERE event_id % 3 = 0) r", JETS, EV, PER))
def r1_resumed(spark, d):
    """Files of a second call are added to the state of the first; ``second_read`` counts the rows that it reads."""
    n = V.nested(spark, d).select("event_id", "sample", "jets")
    path, state = tables.workspace(spark), tables.workspace(spark)
    _arrive(n.where("event_id % 3 > 0"), V.events(spark, d).count() // 3, path)
    multiplicity_stream(spark, path, n.schema, ["sample"], F.size("jets.pt"), state)
    _arrive(n.where("event_id % 3 = 0"), V.events(spark, d).count() // 6, path, "append")
    second = fold_multiplicity(spark, path, n.schema, ["sample"], F.size("jets.pt"), state)
    return multiplicity_state(spark, state).withColumn("second_read", F.lit(second).cast("long"))
