"""Classifier-evaluation queries."""

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import classifier as C
from .catalog import query, r6


def _r(df, *names):
    return df.select(*[r6(c).alias(c) if c in names else F.col(c) for c in df.columns])


@query("keep_confident", "SELECT doc_id, probability FROM pred WHERE probability>=0.5")
def _(v):
    return C.keep_confident(v.pred).select("doc_id", "probability")


CONF = """c AS (SELECT {by} count(CASE WHEN label=1 AND probability>=0.5 THEN 1 END) AS tp, count(CASE WHEN label=0 AND probability>=0.5 THEN 1 END) AS fp,
 count(CASE WHEN label=0 AND probability<0.5 THEN 1 END) AS tn, count(CASE WHEN label=1 AND probability<0.5 THEN 1 END) AS fn FROM pred {group})"""
CONF_OUT = """tp, fp, tn, fn, round(coalesce(tp/nullif(tp+fp,0),0),6) AS precision, round(coalesce(tp/nullif(tp+fn,0),0),6) AS recall,
 round(coalesce(2*tp/nullif(2*tp+fp+fn,0),0),6) AS f1, round((tp+tn)/(tp+fp+tn+fn),6) AS accuracy,
 round((coalesce(tp/nullif(tp+fn,0),0)+coalesce(tn/nullif(tn+fp,0),0))/
   ((CASE WHEN tp+fn>0 THEN 1 ELSE 0 END)+(CASE WHEN tn+fp>0 THEN 1 ELSE 0 END)),6) AS balanced_accuracy"""
RATES = ("precision", "recall", "f1", "accuracy", "balanced_accuracy", "specificity")


@query("confusion_at", "WITH " + CONF.format(by="", group="") + f" SELECT {CONF_OUT} FROM c")
def _(v):
    return _r(C.confusion_at(v.pred), *RATES)


@query("confusion_by_sample", "WITH " + CONF.format(by="sample_id,", group="GROUP BY 1") + f" SELECT sample_id, {CONF_OUT} FROM c")
def _(v):
    return _r(C.confusion_at(v.pred, by=["sample_id"]), *RATES)


@query("threshold_sweep", """
WITH c AS (SELECT th AS threshold, CAST(sum(CASE WHEN label=1 AND probability>=th THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN label=0 AND probability>=th THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN label=0 AND probability<th THEN 1 ELSE 0 END) AS BIGINT) AS tn,
  CAST(sum(CASE WHEN label=1 AND probability<th THEN 1 ELSE 0 END) AS BIGINT) AS fn
  FROM pred CROSS JOIN (SELECT unnest([0.05,0.10,0.15,0.20,0.25,0.30,0.35,0.40,0.45,0.50,0.55,0.60,0.65,0.70,0.75,0.80,0.85,0.90,0.95]::DOUBLE[]) AS th)
  GROUP BY 1),
r AS (SELECT *, tp/nullif(tp+fp,0) AS precision, tp/nullif(tp+fn,0) AS recall, tn/nullif(tn+fp,0) AS specificity,
  CASE WHEN tp>0 THEN 2*(tp/(tp+fp))*(tp/(tp+fn))/((tp/(tp+fp))+(tp/(tp+fn))) END AS f1 FROM c)
SELECT threshold, tp, fp, tn, fn, round(precision,6) AS precision, round(recall,6) AS recall, round(specificity,6) AS specificity,
  round(f1,6) AS f1, row_number() OVER (ORDER BY f1 DESC NULLS LAST, threshold)=1 AND f1 IS NOT NULL AS is_best FROM r""")
def _(v):
    return _r(C.threshold_sweep(v.pred), *RATES)


AUC = """(SELECT {by} count(DISTINCT CASE WHEN a.label=1 THEN a.doc_id END) AS n_positive,
   count(DISTINCT CASE WHEN a.label=0 THEN a.doc_id END) AS n_negative FROM pred a {g}) n"""


@query("roc_auc", """SELECT round(avg(CASE WHEN p.probability>n.probability THEN 1.0::DOUBLE WHEN p.probability=n.probability THEN 0.5 ELSE 0 END),6) AS roc_auc
FROM pred p JOIN pred n ON p.label=1 AND n.label=0""")
def _(v):
    return C.discrimination(v.pred).select(r6("roc_auc").alias("roc_auc"))


AP = """(SELECT {by} sum(CASE WHEN label=1 THEN tp/(tp+fp) ELSE 0 END)/nullif(count(CASE WHEN label=1 THEN 1 END),0) AS pr_auc
 FROM (SELECT *, count(CASE WHEN label=1 THEN 1 END) OVER w AS tp, count(CASE WHEN label=0 THEN 1 END) OVER w AS fp FROM pred
   WINDOW w AS ({part} ORDER BY probability DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) {g})"""


@query("pr_auc", "SELECT round(pr_auc,6) AS pr_auc FROM " + AP.format(by="", part="", g=""))
def _(v):
    return C.discrimination(v.pred).select(r6("pr_auc").alias("pr_auc"))


PER_SAMPLE = "ps AS (SELECT b.sample_id, b.n, b.n_positive, b.n_negative, b.mean_positive, b.mean_negative, r.roc_auc, a.pr_auc " \
    "FROM (SELECT sample_id, count(*) AS n, count(CASE WHEN label=1 THEN 1 END) AS n_positive, count(CASE WHEN label=0 THEN 1 END) AS n_negative, " \
    "avg(CASE WHEN label=1 THEN probability END) AS mean_positive, avg(CASE WHEN label=0 THEN probability END) AS mean_negative FROM pred GROUP BY 1) b " \
    "LEFT JOIN (SELECT p.sample_id, avg(CASE WHEN p.probability>n.probability THEN 1.0::DOUBLE WHEN p.probability=n.probability THEN 0.5 ELSE 0 END) AS roc_auc " \
    "FROM pred p JOIN pred n ON p.label=1 AND n.label=0 AND p.sample_id=n.sample_id GROUP BY 1) r ON r.sample_id=b.sample_id LEFT JOIN " \
    + AP.format(by="sample_id,", part="PARTITION BY sample_id", g="GROUP BY 1") + " a ON a.sample_id=b.sample_id)"


@query("per_sample_discrimination", f"""WITH {PER_SAMPLE} SELECT sample_id, n, n_positive, n_negative, round(mean_positive,6) AS mean_positive,
 round(mean_negative,6) AS mean_negative, round(roc_auc,6) AS roc_auc, round(pr_auc,6) AS pr_auc FROM ps""")
def _(v):
    return _r(C.per_sample_discrimination(v.pred), "mean_positive", "mean_negative", "roc_auc", "pr_auc")


@query("reproduce_check", f"""WITH {PER_SAMPLE}, l AS (SELECT sample_id, 'roc_auc' AS metric, roc_auc AS value FROM ps UNION ALL
 SELECT sample_id, 'pr_auc', pr_auc FROM ps UNION ALL SELECT sample_id, 'mean_positive', mean_positive FROM ps)
SELECT sample_id, metric, round(value,6) AS value, round(value,2) AS recorded FROM l WHERE abs(value-round(value,2))>0.001""")
def _(v):
    ps = C.per_sample_discrimination(v.pred)
    m = ps.selectExpr("sample_id", "stack(3,'roc_auc',roc_auc,'pr_auc',pr_auc,'mean_positive',mean_positive) AS (metric, value)")
    return _r(C.reproduce_check(m, m.withColumn("value", F.round("value", 2))), "value", "recorded")


@query("probability_profile", """SELECT round(count(CASE WHEN label=1 THEN 1 END)*100.0/count(*),6)::DOUBLE AS prevalence_pct,
 round(avg(CASE WHEN label=1 THEN probability END),6) AS positive_mean, round(avg(CASE WHEN label=0 THEN probability END),6) AS negative_mean,
 round(quantile_cont(CASE WHEN label=1 THEN probability END, 0.5),6) AS positive_median, round(quantile_cont(CASE WHEN label=0 THEN probability END, 0.5),6) AS negative_median,
 """ + ", ".join(f"round(quantile_cont(probability, {q/100}),6) AS p{q}" for q in (5, 25, 50, 75, 90, 95)) + " FROM pred")
def _(v):
    out = C.probability_profile(v.pred)
    return _r(out, *out.columns)


MATCHED = """mm AS (SELECT p.sample_id, p.doc_id, p.probability, n.probability AS np, n.contrast AS nc,
   row_number() OVER (PARTITION BY p.doc_id ORDER BY abs(n.contrast-p.contrast), {side} n.doc_id) AS rn
   FROM pred p JOIN pred n ON p.label=1 AND n.label=0 {same}),
 mc AS (SELECT sample_id, doc_id, probability, avg(np) AS matched_mean, quantile_cont(np,0.5) AS matched_median, count(*) AS k_used,
   min(nc) AS matched_low, max(nc) AS matched_high, probability-avg(np) AS diff_mean, probability-quantile_cont(np,0.5) AS diff_median,
   probability>avg(np) AS beats_mean, probability>quantile_cont(np,0.5) AS beats_median FROM mm WHERE rn<=20 GROUP BY 1,2,3)"""
POOLED = MATCHED.format(side="CASE WHEN n.contrast<p.contrast THEN 0 ELSE 1 END,", same="")
OWN = MATCHED.format(side="", same="AND n.sample_id=p.sample_id")
MC_OUT = """SELECT sample_id, doc_id, probability, round(matched_mean,6) AS matched_mean, round(matched_median,6) AS matched_median, k_used,
 matched_low, matched_high, round(diff_mean,6)+0.0 AS diff_mean, round(diff_median,6)+0.0 AS diff_median FROM mc"""
MC_NUM = ("matched_mean", "matched_median", "diff_mean", "diff_median")


@query("matched_contrast", f"WITH {POOLED} {MC_OUT}")
def _(v):
    return _r(C.matched_contrast(v.pred, "doc_id").drop("beats_mean", "beats_median"), *MC_NUM)


@query("matched_contrast_by_sample", f"WITH {OWN} {MC_OUT}")
def _(v):
    return _r(C.matched_contrast(v.pred, "doc_id", by_sample=True).drop("beats_mean", "beats_median"), *MC_NUM)


@query("contrast_summary", f"""WITH {POOLED} SELECT count(*) AS n_positives, round(avg(CASE WHEN beats_mean THEN 1.0::DOUBLE ELSE 0 END)*100,6) AS win_mean_pct,
 round(avg(CASE WHEN beats_median THEN 1.0::DOUBLE ELSE 0 END)*100,6) AS win_median_pct, round(avg(probability),6) AS mean_positive,
 round(avg(matched_mean),6) AS mean_matched, round(avg(diff_mean),6) AS diff_avg, round(stddev_pop(diff_mean),6) AS diff_std,
 round(min(diff_mean),6) AS diff_min, round(max(diff_mean),6) AS diff_max, round(quantile_cont(diff_mean,0.25),6) AS diff_p25,
 round(quantile_cont(diff_mean,0.5),6) AS diff_median, round(quantile_cont(diff_mean,0.75),6) AS diff_p75,
 round(quantile_cont(probability,0.5),6) AS median_positive, round(quantile_cont(matched_median,0.5),6) AS median_matched FROM mc""")
def _(v):
    out = C.contrast_summary(C.matched_contrast(v.pred, "doc_id"))
    return _r(out, *out.columns[1:])


@query("rank_by_delta", f"""WITH {POOLED}, d AS (SELECT doc_id, round(diff_mean,9) AS diff_mean FROM mc)
(SELECT doc_id, round(diff_mean,6)+0.0 AS diff_mean, 'worst' AS which FROM d ORDER BY d.diff_mean, doc_id LIMIT 10) UNION ALL
(SELECT doc_id, round(diff_mean,6)+0.0 AS diff_mean, 'best' FROM d ORDER BY d.diff_mean DESC, doc_id DESC LIMIT 10)""")
def _(v):
    m = C.matched_contrast(v.pred, "doc_id").select("doc_id", F.round("diff_mean", 9).alias("diff_mean"))
    return _r(C.rank_by_delta(m, "doc_id"), "diff_mean")


@query("correlation", """WITH r AS (SELECT probability, contrast, rank() OVER (ORDER BY probability)+(count(*) OVER (PARTITION BY probability)-1)/2 AS rp,
 rank() OVER (ORDER BY contrast)+(count(*) OVER (PARTITION BY contrast)-1)/2 AS rc FROM pred)
SELECT round(corr(probability, contrast),6) AS pearson, round(corr(rp, rc),6) AS spearman FROM r""")
def _(v):
    return _r(C.correlation(v.pred, "probability", "contrast"), "pearson", "spearman")


@query("eps_amplification", """WITH q AS (SELECT quantile_cont(contrast,0.05) AS cut FROM pred)
SELECT sample_id, label, count(*) AS n, round(avg(50.0::DOUBLE/(contrast+50.0)),6) AS mean_eps_share, round(avg(CASE WHEN contrast<=cut THEN 1.0::DOUBLE ELSE 0 END),6) AS low_share,
 round(max(cut),6) AS cut, round(avg(probability),6) AS prob_mean,
 round(CASE WHEN count(*)>1 AND stddev_pop(contrast)>0 AND stddev_pop(probability)>0 THEN corr(contrast, probability) END,6) AS corr_std,
 round(CASE WHEN count(*)>1 AND stddev_pop(doc_id)>0 AND stddev_pop(probability)>0 THEN corr(doc_id::DOUBLE, probability) END,6) AS corr_mean,
 round(quantile_cont(contrast,0.25),6) AS std_p25, round(quantile_cont(contrast,0.5),6) AS std_p50, round(quantile_cont(contrast,0.75),6) AS std_p75,
 round(quantile_cont(probability,0.5),6) AS prob_median FROM pred CROSS JOIN q GROUP BY 1,2""")
def _(v):
    p = v.pred.withColumn("raw_std", F.col("contrast")).withColumn("raw_mean", F.col("doc_id").cast("double"))
    out = C.eps_amplification(p, 50.0)
    return _r(out, *out.columns[3:])


@query("losses", """WITH z AS (SELECT label, probability*8-4 AS z FROM pred), b AS (SELECT greatest(z,0)-z*label+ln(1+exp(-abs(z))) AS bce FROM z)
SELECT round(avg(bce),6) AS bce, round(avg(0.25*pow(1-exp(-bce),2)*bce),6) AS focal FROM b""")
def _(v):
    return _r(C.losses(v.pred.withColumn("logit", F.col("probability") * 8 - 4)), "bce", "focal")


@query("top_false_positives", """WITH s AS (SELECT sample_id, count(CASE WHEN probability>=0.5 THEN 1 END) AS sample_fp, count(*) AS n FROM pred WHERE label=0 GROUP BY 1),
 t AS (SELECT CAST(sum(sample_fp) AS BIGINT) AS n_fp, round((sum(sample_fp)*100.0::DOUBLE/sum(n)),6) AS fp_rate_pct FROM s),
 p AS (SELECT sample_id, doc_id, probability FROM pred WHERE label=0 ORDER BY probability DESC, doc_id LIMIT 25)
SELECT p.*, t.*, s.sample_fp FROM p CROSS JOIN t JOIN s ON s.sample_id=p.sample_id""")
def _(v):
    return _r(C.top_false_positives(v.pred, "doc_id"), "fp_rate_pct")


@query("stratified_cases", """WITH t AS (SELECT * FROM pred WHERE label=0 ORDER BY probability DESC, doc_id LIMIT 30),
 s AS (SELECT doc_id, probability, contrast/10 AS distance FROM t WHERE probability<0.99),
 r AS (SELECT *, CASE WHEN distance<60 THEN 'near' WHEN distance<100 THEN 'intermediate' ELSE 'far' END AS stratum FROM s)
SELECT doc_id, probability, round(distance,6) AS distance, stratum, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY
  CASE WHEN stratum='far' THEN -probability ELSE distance END, doc_id) AS rank FROM r) WHERE rank<=4""")
def _(v):
    p = v.pred.withColumn("distance", F.col("contrast") / 10)
    out = C.stratified_cases(p, "doc_id", p.where("probability >= 0.99"))
    return _r(out.select("doc_id", "probability", "distance", "stratum", "rank"), "distance")


DOCS = """m AS (SELECT d.doc_id, d.lang AS sample_id, CASE WHEN length(d.source)=4 THEN 'test' ELSE 'train' END AS split,
  CASE WHEN l.toxic=1 THEN 'ambiguous' WHEN l.quality=1 THEN 'positive' ELSE 'negative' END AS label
  FROM documents d JOIN labels l ON l.doc_id=d.doc_id),
 sp AS (SELECT lang AS sample_id, CASE WHEN lang IN ('en','fr') THEN 'test' ELSE 'train' END AS split FROM documents GROUP BY 1),
 p AS (SELECT doc_id, CASE WHEN source='src3' THEN 'xx' ELSE lang END AS sample_id, CASE WHEN n_chars>2000 THEN 0 ELSE 1 END AS label FROM documents)"""


def _manifest(v):
    d, l = v.table("documents").select("doc_id", "lang", "source"), v.table("labels")
    return d.join(l, "doc_id").select(
        "doc_id", F.col("lang").alias("sample_id"), F.when(F.length("source") == 4, "test").otherwise("train").alias("split"),
        F.when(F.col("toxic") == 1, "ambiguous").when(F.col("quality") == 1, "positive").otherwise("negative").alias("label"))


def _split(v):
    return v.table("documents").select(F.col("lang").alias("sample_id")).distinct().withColumn(
        "split", F.when(F.col("sample_id").isin("en", "fr"), "test").otherwise("train"))


def _documents(v):
    return v.table("documents").select("doc_id", F.when(F.col("source") == "src3", "xx").otherwise(F.col("lang")).alias("sample_id"),
                                       F.when(F.col("n_chars") > 2000, 0).otherwise(1).alias("label"))


@query("cross_validate", f"""WITH {DOCS}, j AS (SELECT p.doc_id, p.label, p.sample_id, m.doc_id AS md, m.sample_id AS ms, m.split AS msp, m.label AS ml, sp.split AS tsp
 FROM p LEFT JOIN m ON m.doc_id=p.doc_id LEFT JOIN sp ON sp.sample_id=m.sample_id)
SELECT doc_id, 'not_in_manifest' AS problem FROM j WHERE md IS NULL UNION ALL
SELECT doc_id, 'label' FROM j WHERE md IS NOT NULL AND (CASE ml WHEN 'positive' THEN 1 WHEN 'negative' THEN 0 END) IS DISTINCT FROM label UNION ALL
SELECT doc_id, 'split' FROM j WHERE md IS NOT NULL AND msp<>'test' UNION ALL SELECT doc_id, 'sample' FROM j WHERE md IS NOT NULL AND ms<>sample_id UNION ALL
SELECT doc_id, 'split_table' FROM j WHERE md IS NOT NULL AND tsp IS DISTINCT FROM 'test'""")
def _(v):
    return C.cross_validate(_documents(v), _manifest(v), _split(v), key="doc_id")


@query("matched_set_checks", f"""WITH {DOCS}, pp AS (SELECT doc_id FROM p UNION ALL SELECT doc_id FROM p WHERE sample_id='xx'),
 k AS (SELECT DISTINCT * FROM m WHERE doc_id IN (SELECT doc_id FROM pp)), known AS (SELECT sample_id FROM sp WHERE split='test'),
 r AS (SELECT 'duplicate_predictions' AS "check", (SELECT count(*)-count(DISTINCT doc_id) FROM pp) AS n UNION ALL
 SELECT 'missing_in_manifest', (SELECT count(DISTINCT doc_id) FROM pp WHERE doc_id NOT IN (SELECT doc_id FROM m)) UNION ALL
 SELECT 'count_gap', (SELECT abs((SELECT count(*) FROM pp)-(SELECT count(*) FROM k))) UNION ALL
 SELECT 'wrong_split', (SELECT count(*) FROM k WHERE split<>'test') UNION ALL
 SELECT 'foreign_sample', (SELECT count(*) FROM k WHERE sample_id NOT IN (SELECT * FROM known)) UNION ALL
 SELECT 'sample_set_gap', (SELECT count(*) FROM (SELECT DISTINCT sample_id FROM k) a FULL JOIN known b ON a.sample_id=b.sample_id WHERE a.sample_id IS NULL OR b.sample_id IS NULL))
SELECT "check", CAST(n AS BIGINT) AS n FROM r WHERE n>0""")
def _(v):
    p = _documents(v)
    return C.matched_set_checks(p.union(p.where("sample_id = 'xx'")), _manifest(v), _split(v).where("split = 'test'"), key="doc_id")


@query("gt_contamination", """SELECT count(*) AS n, count(b.n_inside) AS n_joined, count(CASE WHEN b.n_inside>0 THEN 1 END) AS n_contaminated
FROM det d LEFT JOIN (SELECT * FROM boxes WHERE label<>'ambiguous') b ON b.sample_id=d.sample_id AND b.t=d.t AND b.det_id=d.det_id""")
def _(v):
    return C.gt_contamination(v.det, v.boxes.where("label <> 'ambiguous'"), ["sample_id", "t", "det_id"])


@query("join_distance", """SELECT det_id, sample_id, t AS frame_idx, CAST(floor(y) AS INT) AS candidate_y, CAST(floor(x) AS INT) AS candidate_x,
 round(min(distance) OVER (PARTITION BY sample_id, t, floor(y), floor(x)),6) AS distance FROM manifest""")
def _(v):
    yx = [F.floor("y").cast("int").alias("candidate_y"), F.floor("x").cast("int").alias("candidate_x")]
    named = v.manifest.select("det_id", "sample_id", F.concat(
        F.concat_ws("_", F.col("sample_id"), F.col("t").cast("string"), *[c.cast("string") for c in yx]), F.lit(".npy")).alias("filename"))
    table = v.manifest.select("sample_id", F.col("t").alias("frame_idx"), *yx, "distance").groupBy(
        "sample_id", "frame_idx", "candidate_y", "candidate_x").agg(F.min("distance").alias("distance"))
    return _r(C.join_distance(named, table).drop("filename"), "distance")


RUN = """(SELECT l_suppkey AS sample_id, avg(l_discount) AS precision, avg(l_tax) AS recall, CASE WHEN count(*)>{n} THEN avg(l_discount*l_tax) END AS f1,
  count(*) AS tp FROM lineitem WHERE l_returnflag='{f}' GROUP BY 1)"""
BASE, CAND = RUN.format(n=90, f="A"), RUN.format(n=95, f="R")
METRICS = ("precision", "recall", "f1")


def _mean(value, digits=12):
    """Mean summed in decimals: the order of rows cannot tip a difference of zero or a half at the last digit."""
    return F.round(F.avg((F.col(value) if isinstance(value, str) else value).cast("decimal(18,8)")), digits).cast("double")


def _run(v, flag, n):
    return v.table("lineitem").where(F.col("l_returnflag") == flag).groupBy(F.col("l_suppkey").alias("sample_id")).agg(
        _mean("l_discount").alias("precision"), _mean("l_tax").alias("recall"),
        F.when(F.count(F.lit(1)) > n, _mean(F.col("l_discount") * F.col("l_tax"))).alias("f1"), F.count(F.lit(1)).alias("tp"))


def _compared(v):
    return C.compare_runs(_run(v, "A", 90), _run(v, "R", 95), "sample_id", METRICS)


@query("compare_runs", f"""SELECT b.sample_id, {", ".join(f"round(b.{m},6) AS baseline_{m}, round(c.{m},6) AS candidate_{m}, round(c.{m}-b.{m},6)+0.0 AS delta_{m}" for m in METRICS)}
FROM {BASE} b JOIN {CAND} c ON b.sample_id=c.sample_id""")
def _(v):
    out = _compared(v)
    return _r(out, *out.columns[1:])


@query("delta_summary", " UNION ALL ".join(f"""SELECT '{m}' AS metric, count(CASE WHEN c.{m}-b.{m}>0 THEN 1 END) AS improved,
 count(CASE WHEN c.{m}-b.{m}<0 THEN 1 END) AS worsened, count(CASE WHEN c.{m}-b.{m}=0 THEN 1 END) AS unchanged, round(avg(c.{m}-b.{m}),6)+0.0 AS mean_delta
 FROM {BASE} b JOIN {CAND} c ON b.sample_id=c.sample_id""" for m in METRICS))
def _(v):
    return _r(C.delta_summary(_compared(v), METRICS), "mean_delta")


@query("weighted_mean_error", f"SELECT round(sum(f1*tp)/sum(CASE WHEN f1 IS NOT NULL THEN tp END),6) AS weighted_mean_error FROM {BASE}")
def _(v):
    return _r(C.weighted_mean_error(_run(v, "A", 90), "f1"), "weighted_mean_error")


@query("run_comparison", """WITH v AS (SELECT l_returnflag AS run, 'discount' AS metric, l_linestatus AS sample_id, avg(l_discount) AS value FROM lineitem GROUP BY 1,3
  UNION ALL SELECT l_returnflag, 'tax', NULL, avg(l_tax) FROM lineitem GROUP BY 1),
 w AS (SELECT metric, sample_id, max(CASE WHEN run='A' THEN value END) AS a, max(CASE WHEN run='R' THEN value END) AS b FROM v WHERE run IN ('A','R') GROUP BY 1,2
  UNION ALL SELECT 'discount_spread', NULL, max(CASE WHEN run='A' THEN s END), max(CASE WHEN run='R' THEN s END)
   FROM (SELECT run, CASE WHEN count(*)>=2 THEN max(value)-min(value) END AS s FROM v WHERE metric='discount' GROUP BY 1))
SELECT metric, sample_id, round(a,6) AS a, round(b,6) AS b, round(b-a,6)+0.0 AS delta,
 CASE metric WHEN 'tax' THEN b-a>0 WHEN 'discount_spread' THEN a-b>0 END AS met FROM w""")
def _(v):
    li = v.table("lineitem")
    per = li.groupBy(F.col("l_returnflag").alias("run"), F.col("l_linestatus").alias("sample_id")).agg(F.avg("l_discount").alias("value")).withColumn("metric", F.lit("discount"))
    whole = li.groupBy(F.col("l_returnflag").alias("run")).agg(F.avg("l_tax").alias("value")).withColumn(
        "metric", F.lit("tax")).withColumn("sample_id", F.lit(None).cast("string"))
    out = C.run_comparison(per.unionByName(whole), "A", "R", {"tax": ("up", 0.0), "discount_spread": ("down", 0.0)}, spread_of="discount")
    return _r(out, "a", "b", "delta")


EPOCHS = """e AS (SELECT l_suppkey AS run, CAST(year(l_shipdate)*12+month(l_shipdate) AS INT) AS epoch, round(avg(l_discount),6) AS val_loss,
 round(avg(l_tax),3) AS val_pr_auc FROM lineitem GROUP BY 1,2)"""


def _epochs(v):
    return v.table("lineitem").groupBy(F.col("l_suppkey").alias("run"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("epoch")).agg(
        _mean("l_discount", 6).alias("val_loss"), _mean("l_tax", 3).alias("val_pr_auc"))


@query("best_epoch", f"""WITH {EPOCHS} SELECT run, epoch, val_pr_auc FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY val_pr_auc DESC, epoch) AS rn FROM e) WHERE rn=1""")
def _(v):
    return C.best_epoch(_epochs(v))


@query("early_stop", f"""WITH {EPOCHS}, g AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS i,
  min(val_loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM e),
 h AS (SELECT *, i-max(CASE WHEN best IS NULL OR val_loss<best THEN i END) OVER (PARTITION BY run ORDER BY epoch) AS gap FROM g)
SELECT run, min(CASE WHEN gap>=8 THEN epoch END) AS stop_epoch FROM h GROUP BY 1""")
def _(v):
    return C.early_stop(_epochs(v), 8)


@query("early_stop_pr_auc", f"""WITH {EPOCHS}, g AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS i,
  max(val_pr_auc) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM e),
 h AS (SELECT *, i-max(CASE WHEN best IS NULL OR val_pr_auc>best THEN i END) OVER (PARTITION BY run ORDER BY epoch) AS gap FROM g)
SELECT run, min(CASE WHEN gap>=8 THEN epoch END) AS stop_epoch FROM h GROUP BY 1""")
def _(v):
    return C.early_stop(_epochs(v), 8, "val_pr_auc", larger=True)
