"""Audit queries over labelled candidates."""

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import audits as A, graph, spatial
from .catalog import query, r6


def _r(df, *names):
    return df.select(*[r6(c).alias(c) if c in names else F.col(c) for c in df.columns])


MATCH = "(SELECT sample_id, t, gt_id, sqrt((y-yy)*(y-yy)+(x-xx)*(x-xx))*(1+xx/10) AS distance FROM (SELECT g.*, d.y AS yy, d.x AS xx FROM gt g JOIN det d ON d.det_id=g.gt_id))"


def _matches(v):
    d = v.det.select(F.col("det_id").alias("gt_id"), F.col("y").alias("yy"), F.col("x").alias("xx"))
    return v.gt.join(d, "gt_id").select("sample_id", "t", "gt_id", (
        scalar.euclidean("y", "x", "yy", "xx") * (1 + F.col("xx") / 10)).alias("distance"))


FRAMES = f"""fr AS (SELECT coalesce(p.sample_id,g.sample_id) AS sample_id, coalesce(p.t,g.t) AS t, coalesce(g.n,0) AS n_gt, coalesce(p.n,0) AS n_pred
  FROM (SELECT sample_id, t, count(*) AS n FROM gt GROUP BY 1,2) g FULL JOIN (SELECT sample_id, t, count(*) AS n FROM det GROUP BY 1,2) p
  ON p.sample_id=g.sample_id AND p.t=g.t), m AS {MATCH}"""
SCORE = """SELECT '{lv}' AS level, {s} AS sample_id, {t} AS t, n_gt, n_pred, tp, n_pred-tp AS fp, n_gt-tp AS fn, round(tp/nullif(n_pred,0),6) AS precision,
 round(tp/nullif(n_gt,0),6) AS recall, round(CASE WHEN tp>0 THEN 2*tp/(n_pred+n_gt) END,6) AS f1, round(mean_error,6) AS mean_error,
 round(s5,6) AS share_le_5, round(s10,6) AS share_le_10, round(s15,6) AS share_le_15, round(median_error,6) AS median_error
FROM (SELECT {k} CAST(sum(n_gt) AS BIGINT) AS n_gt, CAST(sum(n_pred) AS BIGINT) AS n_pred FROM fr {g}) a LEFT JOIN
 (SELECT {k} count(*) AS tp, avg(distance) AS mean_error, avg(CASE WHEN distance<=5 THEN 1.0::DOUBLE ELSE 0 END) AS s5, avg(CASE WHEN distance<=10 THEN 1.0::DOUBLE ELSE 0 END) AS s10,
  avg(CASE WHEN distance<=15 THEN 1.0::DOUBLE ELSE 0 END) AS s15, quantile_cont(distance,0.5) AS median_error FROM m {g}) b {on}"""


@query("detection_scores", f"WITH {FRAMES} " + " UNION ALL ".join([
    SCORE.format(lv="frame", s="a.sample_id", t="a.t", k="sample_id, t,", g="GROUP BY 1,2", on="ON a.sample_id=b.sample_id AND a.t=b.t"),
    SCORE.format(lv="sample", s="a.sample_id", t="NULL", k="sample_id,", g="GROUP BY 1", on="ON a.sample_id=b.sample_id"),
    SCORE.format(lv="all", s="NULL", t="NULL", k="", g="", on="ON true")]))
def _(v):
    out = A.detection_scores(_matches(v), v.gt, v.det)
    return _r(out, *out.columns[8:])


GATES = (1.0, 2.0, 5.0, 10.0)


@query("gate_sweep", f"""WITH {FRAMES}, g AS (SELECT unnest([1.0,2.0,5.0,10.0]::DOUBLE[]) AS gate),
 h AS (SELECT sample_id, t, gate, count(*) AS n FROM m JOIN g ON distance<=gate GROUP BY 1,2,3),
 f AS (SELECT fr.*, g.gate, coalesce(h.n,0) AS n_matched FROM fr CROSS JOIN g LEFT JOIN h ON h.sample_id=fr.sample_id AND h.t=fr.t AND h.gate=g.gate),
 u AS (SELECT sample_id, t, gate, n_gt, n_pred, n_matched FROM f UNION ALL
   SELECT NULL, NULL, gate, CAST(sum(n_gt) AS BIGINT), CAST(sum(n_pred) AS BIGINT), CAST(sum(n_matched) AS BIGINT) FROM f GROUP BY gate)
SELECT *, round(n_matched/nullif(n_pred,0),6) AS precision, round(n_matched/nullif(n_gt,0),6) AS recall FROM u""")
def _(v):
    return _r(A.gate_sweep(_matches(v), v.gt, v.det, GATES), "precision", "recall")


DIST = "count(*) AS n, round(min({c}),6) AS min, round(avg({c}),6) AS mean, round(max({c}),6) AS max, " + ", ".join(
    f"round(quantile_cont({{c}},{p}),6) AS {n}" for n, p in A.PERCENTILES.items())


@query("distribution", f"SELECT {DIST.format(c='distance')} FROM manifest")
def _(v):
    out = A.distribution(v.manifest, "distance")
    return _r(out, *out.columns[1:])


@query("distribution_by_sample", f"SELECT sample_id, {DIST.format(c='distance')} FROM manifest GROUP BY 1")
def _(v):
    out = A.distribution(v.manifest, "distance", ["sample_id"])
    return _r(out, *out.columns[2:])


@query("distribution_of_prices", f"SELECT o_orderpriority, {DIST.format(c='o_totalprice')} FROM orders GROUP BY 1")
def _(v):
    out = A.distribution(v.table("orders").select("o_orderpriority", "o_totalprice"), "o_totalprice", ["o_orderpriority"])
    return _r(out, *out.columns[2:])


@query("radius_bins", """WITH c AS (SELECT unnest([3,5,7,10,15]::DOUBLE[]) AS radius, unnest([-1,3,5,7,10]::DOUBLE[]) AS lo)
SELECT radius, count(CASE WHEN distance>lo AND distance<=radius THEN 1 END) AS n_bin, count(CASE WHEN distance<=radius THEN 1 END) AS n_cumulative,
 round(count(CASE WHEN distance<=radius THEN 1 END)*100.0::DOUBLE/count(*),6) AS share_pct FROM manifest CROSS JOIN c GROUP BY radius, lo UNION ALL
SELECT NULL, count(CASE WHEN distance>15 THEN 1 END), count(*), round(count(CASE WHEN distance>15 THEN 1 END)*100.0::DOUBLE/count(*),6) FROM manifest""")
def _(v):
    return _r(A.radius_bins(v.manifest), "share_pct")


@query("label_matrix", """WITH p AS (SELECT unnest([3,5,7]::DOUBLE[]) AS positive), n AS (SELECT unnest([5,10,15,20]::DOUBLE[]) AS negative),
 c AS (SELECT positive, negative, count(CASE WHEN distance<=positive THEN 1 END) AS n_pos, count(CASE WHEN distance>negative THEN 1 END) AS n_neg, count(*) AS n
  FROM manifest CROSS JOIN p CROSS JOIN n WHERE negative>positive GROUP BY 1,2)
SELECT positive, negative, n_pos, n_neg, n-n_pos-n_neg AS n_ambiguous, round(n_pos*100.0::DOUBLE/n,6) AS pos_pct, round(n_neg*100.0::DOUBLE/n,6) AS neg_pct,
 round((n-n_pos-n_neg)*100.0::DOUBLE/n,6) AS ambiguous_pct, round(n_neg/n_pos,6) AS imbalance FROM c""")
def _(v):
    return _r(A.label_matrix(v.manifest, (3, 5, 7), (5, 10, 15, 20)), "pos_pct", "neg_pct", "ambiguous_pct", "imbalance")


@query("gt_cluster_shares", f"""WITH c AS (SELECT g.gt_id, r.radius, count(CASE WHEN sqrt((d.y-g.y)*(d.y-g.y)+(d.x-g.x)*(d.x-g.x))<=r.radius THEN 1 END) AS c
  FROM gt g CROSS JOIN (SELECT unnest([3,5,7,10,15]) AS radius) r LEFT JOIN det d ON d.sample_id=g.sample_id AND d.t=g.t GROUP BY 1,2)
SELECT CAST(radius AS INT) AS radius, count(CASE WHEN c=0 THEN 1 END) AS n_none, count(CASE WHEN c=1 THEN 1 END) AS n_one, count(CASE WHEN c>=2 THEN 1 END) AS n_more,
 round(count(CASE WHEN c=0 THEN 1 END)*100.0::DOUBLE/count(*),6) AS none_pct, round(count(CASE WHEN c=1 THEN 1 END)*100.0::DOUBLE/count(*),6) AS one_pct,
 round(count(CASE WHEN c>=2 THEN 1 END)*100.0::DOUBLE/count(*),6) AS more_pct FROM c GROUP BY 1""")
def _(v):
    return _r(A.gt_cluster_shares(spatial.radius_counts(v.gt, v.det)), "none_pct", "one_pct", "more_pct")


@query("gt_in_patch_histogram", "WITH c AS (SELECT split, label, count(*) AS n, " + ", ".join(
    f"count(CASE WHEN {c} THEN 1 END) AS n{i}" for i, c in enumerate(("n_inside=0", "n_inside=1", "n_inside=2", "n_inside>=3")))
    + " FROM boxes GROUP BY 1,2) SELECT *, " + ", ".join(f"round(n{i}*100.0::DOUBLE/n,6) AS n{i}_pct" for i in range(4)) + " FROM c")
def _(v):
    return _r(A.gt_in_patch_histogram(v.boxes), *[f"n{i}_pct" for i in range(4)])


BUCKETS = ", ".join(f"round(avg(CASE WHEN distance>={lo}{f' AND distance<{hi}' if hi else ''} THEN 1.0::DOUBLE ELSE 0 END)*100,6) AS from_{lo}"
                    for lo, hi in A.NEGATIVE_BUCKETS)


@query("distance_buckets", f"SELECT sample_id, count(*) AS n, {BUCKETS} FROM manifest WHERE label='negative' GROUP BY GROUPING SETS ((sample_id), ())")
def _(v):
    out = A.distance_buckets(v.manifest.where("label = 'negative'"))
    return _r(out, *out.columns[2:])


@query("centering_stats", """SELECT label, count(*) AS n, round(avg(distance),6) AS mean, round(max(distance),6) AS max, """ + ", ".join(
    f"round(avg(CASE WHEN distance<={k} THEN 1.0::DOUBLE ELSE 0 END)*100,6) AS le_{k}_pct" for k in A.CENTRING_LIMITS) + """,
 count(local_y) AS n_with_gt, round(avg(local_y),6) AS mean_local_y, round(avg(local_x),6) AS mean_local_x,
 round(avg(sqrt((local_y-16)*(local_y-16)+(local_x-16)*(local_x-16))),6)+0.0 AS mean_radial, round(quantile_cont(distance,0.25),6) AS p25,
 round(quantile_cont(distance,0.5),6) AS median, round(quantile_cont(distance,0.75),6) AS p75, round(quantile_cont(distance,0.9),6) AS p90,
 round(quantile_cont(distance,0.95),6) AS p95, round(quantile_cont(sqrt((local_y-16)*(local_y-16)+(local_x-16)*(local_x-16)),0.5),6)+0.0 AS median_radial
FROM boxes GROUP BY 1""")
def _(v):
    out = A.centering_stats(v.boxes)
    return _r(out, *[c for c in out.columns if c not in ("label", "n", "n_with_gt")])


@query("conflict_shares", """SELECT round(avg(CASE WHEN label='positive' THEN CASE WHEN n_inside>1 THEN 1.0::DOUBLE ELSE 0 END END)*100,6) AS positive_many_pct,
 round(avg(CASE WHEN label='negative' THEN CASE WHEN n_inside>=1 THEN 1.0::DOUBLE ELSE 0 END END)*100,6) AS negative_any_pct,
 round(avg(CASE WHEN label='negative' THEN CASE WHEN n_inside>=2 THEN 1.0::DOUBLE ELSE 0 END END)*100,6) AS negative_many_pct FROM boxes""")
def _(v):
    out = A.conflict_shares(v.boxes)
    return _r(out, *out.columns)


@query("sample_overview", """SELECT sample_id, count(CASE WHEN label='positive' THEN 1 END) AS n_pos, count(CASE WHEN label='negative' THEN 1 END) AS n_neg,
 round(avg(CASE WHEN label='positive' THEN distance END),6) AS pos_mean_distance, round(avg(CASE WHEN label='negative' THEN distance END),6) AS neg_mean_distance,
 round(avg(CASE WHEN label='negative' THEN CASE WHEN n_inside>0 THEN 1.0::DOUBLE ELSE 0 END END)*100,6) AS neg_with_gt_pct FROM boxes GROUP BY 1""")
def _(v):
    out = A.sample_overview(v.boxes)
    return _r(out, *out.columns[3:])


@query("box_disagreement", "SELECT count(CASE WHEN distance<16 AND n_inside=0 THEN 1 END) AS n_flagged FROM boxes")
def _(v):
    return A.box_disagreement(v.boxes)


FIT = "(CAST(trunc(y) AS INT)-16>=0 AND CAST(trunc(x) AS INT)-16>=0 AND CAST(trunc(y) AS INT)+16<256 AND CAST(trunc(x) AS INT)+16<256)"
STATUS = f"CASE WHEN NOT {FIT} THEN 'edge_excluded' WHEN label='ambiguous' THEN 'not_saved' ELSE 'train_saved' END"


def _with_status(v):
    m = v.manifest.withColumn("fits", scalar.fits_frame("y", "x", F.lit(256), F.lit(256)))
    return m.withColumn("patch_status", scalar.edge_status("label", "fits"))


@query("fits_frame", f"SELECT det_id, {FIT} AS fits FROM det")
def _(v):
    return v.det.select("det_id", scalar.fits_frame("y", "x", F.lit(256), F.lit(256)).alias("fits"))


@query("edge_status", f"SELECT det_id, {STATUS} AS patch_status FROM manifest")
def _(v):
    return _with_status(v).select("det_id", "patch_status")


@query("in_patch", """SELECT d.det_id, (d.y>=40-16 AND d.y<40+16 AND d.x>=50-16 AND d.x<50+16) AS inside FROM det d""")
def _(v):
    return v.det.select("det_id", scalar.in_patch("y", "x", F.lit(40.0), F.lit(50.0)).alias("inside"))


@query("label_by_distance", "SELECT det_id, label FROM manifest")
def _(v):
    return v.manifest.select("det_id", "label")


def _training(v):
    """Candidates of all days against the truth of the next day: the first day has none, so its rows stay unlabelled."""
    gt = v.gt.withColumn("t", (F.col("t") + 1).cast("int"))
    near = spatial.nearest_in_frame(v.det, gt, key="det_id")
    lab = F.when(F.col("distance").isNotNull(), scalar.label_by_distance("distance"))
    fits = scalar.fits_frame("y", "x", F.lit(256), F.lit(256))
    return near.withColumn("label", lab).withColumn("fits", fits).withColumn(
        "patch_status", F.when(F.col("label").isNotNull(), scalar.edge_status("label", "fits"))), gt


TRAIN = f"""g1 AS (SELECT sample_id, t+1 AS t, gt_id, y, x FROM gt),
 n1 AS (SELECT d.det_id, min(sqrt((d.y-g.y)*(d.y-g.y)+(d.x-g.x)*(d.x-g.x))) AS distance FROM det d JOIN g1 g ON g.sample_id=d.sample_id AND g.t=d.t GROUP BY 1),
 tr AS (SELECT d.*, n.distance, CASE WHEN n.distance IS NULL THEN NULL WHEN n.distance<=5 THEN 'positive' WHEN n.distance>10 THEN 'negative' ELSE 'ambiguous' END AS label
  FROM det d LEFT JOIN n1 n ON n.det_id=d.det_id), ts AS (SELECT *, CASE WHEN label IS NOT NULL THEN {STATUS} END AS patch_status FROM tr)"""


@query("build_counts", f"""WITH {TRAIN}, f AS (SELECT DISTINCT sample_id, t FROM g1 UNION SELECT DISTINCT sample_id, t FROM det)
SELECT count(*) AS n_candidates, count(CASE WHEN label IS NULL THEN 1 END) AS zero_gt_excluded, """ + ", ".join(
    f"count(CASE WHEN label='{k}' THEN 1 END) AS n_{k}, count(CASE WHEN label='{k}' AND patch_status='edge_excluded' THEN 1 END) AS {k}_edge" for k in ("positive", "ambiguous", "negative"))
    + ", " + ", ".join(f"count(CASE WHEN label='{k}' AND patch_status='train_saved' THEN 1 END) AS {k}_saved" for k in ("positive", "negative"))
    + """, (SELECT count(*) FROM f) AS n_frames, (SELECT count(*) FROM g1) AS n_gt,
 round(count(CASE WHEN label='negative' AND patch_status='train_saved' THEN 1 END)/count(CASE WHEN label='positive' AND patch_status='train_saved' THEN 1 END),6) AS neg_pos_ratio FROM ts""")
def _(v):
    cands, gt = _training(v)
    return _r(A.build_counts(cands, gt), "neg_pos_ratio")


@query("training_set", f"WITH {TRAIN} SELECT det_id, label, patch_status, round(distance,6) AS distance FROM ts WHERE label IS NOT NULL")
def _(v):
    return _training(v)[0].where("label IS NOT NULL").select("det_id", "label", "patch_status", r6("distance").alias("distance"))


def _points(v):
    return v.det.select("sample_id", F.col("t").alias("frame_idx"), F.floor(F.col("y") / 4).cast("double").alias("gt_y"),
                        F.when(F.col("x") < 98, F.floor(F.col("x") / 4).cast("double")).alias("gt_x"))


POINTS = "(SELECT sample_id, t AS frame_idx, floor(y/4) AS gt_y, CASE WHEN x<98 THEN floor(x/4) END AS gt_x FROM det)"


@query("duplicate_audit", f"""WITH g AS (SELECT sample_id, frame_idx, gt_y, gt_x, count(*) AS n FROM {POINTS} GROUP BY 1,2,3,4)
SELECT CAST(sum(CASE WHEN gt_x IS NULL THEN n ELSE 0 END) AS BIGINT) AS n_missing, CAST(sum(CASE WHEN n>1 THEN n-1 ELSE 0 END) AS BIGINT) AS n_extra_rows,
 count(CASE WHEN n>1 THEN 1 END) AS n_duplicate_groups FROM g""")
def _(v):
    return A.duplicate_audit(_points(v))


@query("per_sample_counts", f"""SELECT sample_id, count(*) AS n, min(frame_idx) AS first_frame, max(frame_idx) AS last_frame,
 (SELECT count(*) FROM det)-9000 AS off_total FROM {POINTS} GROUP BY 1""")
def _(v):
    return A.per_sample_counts(_points(v), 9000)


@query("threshold_stats", """SELECT sample_id, round(avg(m),6) AS mean_threshold, round(stddev_pop(m),6) AS std_threshold
FROM (SELECT sample_id, t, max(y) AS m FROM det GROUP BY 1,2) GROUP BY GROUPING SETS ((sample_id), ())""")
def _(v):
    frames = v.det.groupBy("sample_id", "t").agg(F.max("y").alias("threshold"))
    return _r(A.threshold_stats(frames), "mean_threshold", "std_threshold")


@query("parameter_sweep")
def _(v):
    grid = F.explode(F.array(*[F.lit(k) for k in (0.0, 20.0, 60.0)]))
    det = v.det.withColumnRenamed("det_id", "idx").withColumn("threshold", grid).where("y >= threshold")
    return A.parameter_sweep(det, v.gt, ["threshold"])


# detections one pixel off every cell that the setting lets through; setting 1 finds nothing in the later sample
@query("parameter_sweep_grid", """WITH c AS (SELECT CASE WHEN t < 3 THEN 'early' ELSE 'late' END AS sample_id, t, cell FROM cells), s AS (SELECT unnest([0,1]) AS s),
 d AS (SELECT * FROM c, s WHERE s = 0 AND cell % 4 <> 0 OR s = 1 AND sample_id = 'early'),
 f AS (SELECT s.s, c.sample_id, c.t, count(*) AS n_gt, (SELECT count(*) FROM d WHERE d.s=s.s AND d.t=c.t) AS n_pred FROM c, s GROUP BY ALL)
SELECT CAST(s AS VARCHAR) AS setting, round(avg(n_pred),6) AS mean_detections, CAST(sum(n_pred) AS BIGINT) AS matches, CAST(sum(n_pred) AS BIGINT) AS n_pred, CAST(sum(n_gt) AS BIGINT) AS n_gt,
 1.0::DOUBLE AS "precision", round(sum(n_pred)/sum(n_gt),6) AS recall FROM f GROUP BY s""")
def _(v):
    cells = v.cells.withColumn("sample_id", F.when(F.col("t") < 3, "early").otherwise("late"))
    gt = cells.withColumnRenamed("cell", "gt_id")
    det = cells.withColumn("setting", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("x", F.col("x") + 1).withColumnRenamed("cell", "idx")
    found = det.where("(setting = 0 AND idx % 4 <> 0) OR (setting = 1 AND sample_id = 'early')")
    out = A.parameter_sweep(found, gt, ["setting"])
    return out.select("setting", r6("mean_detections").alias("mean_detections"), "matches", "n_pred", "n_gt", "precision", r6("recall").alias("recall"))


@query("leakage", """SELECT sample_id, 'two_splits' AS problem FROM (SELECT l_suppkey AS sample_id, min(l_returnflag) AS a, max(l_returnflag) AS b FROM lineitem GROUP BY 1) WHERE a<>b
UNION ALL SELECT DISTINCT l_suppkey, 'unknown_split' FROM lineitem WHERE l_returnflag NOT IN ('A','R')""")
def _(v):
    s = v.table("lineitem").select(F.col("l_suppkey").alias("sample_id"), F.col("l_returnflag").alias("split"))
    return A.leakage(s, ("A", "R"))


@query("coverage_gap", "SELECT DISTINCT c_custkey AS sample_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus='P')")
def _(v):
    return A.coverage_gap(v.table("customer").select(F.col("c_custkey").alias("sample_id")),
                          v.table("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("sample_id")))


@query("common_keys", """SELECT (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_returnflag='A') AS n_a, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_returnflag='R') AS n_b,
 (SELECT count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_returnflag='A' INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag='R')) AS n_common""")
def _(v):
    li = v.table("lineitem")
    return graph.common_keys(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R'"), "l_partkey")


@query("frozen_set_equal", """SELECT (SELECT count(*) FROM (SELECT l_suppkey FROM lineitem EXCEPT SELECT s_suppkey FROM supplier))
 +(SELECT count(*) FROM (SELECT s_suppkey FROM supplier EXCEPT SELECT l_suppkey FROM lineitem))=0 AS equal""")
def _(v):
    return A.frozen_set_equal(v.table("lineitem").select(F.col("l_suppkey").alias("sample_id")),
                              v.table("supplier").select(F.col("s_suppkey").alias("sample_id")))


@query("union_strata", """SELECT det_id, 'near' AS stratum FROM manifest WHERE distance<2 UNION ALL SELECT det_id, 'far' FROM manifest WHERE distance>=12""")
def _(v):
    part = lambda cond, name: v.manifest.where(cond).select("det_id", F.lit(name).alias("stratum"))
    return graph.union_tables(part("distance < 2", "near"), part("distance >= 12", "far"))


@query("file_manifest_audit", """WITH m AS (SELECT d.doc_id AS filename, d.lang AS sample_id, CASE WHEN l.toxic=1 THEN 'ambiguous' WHEN l.quality=1 THEN 'positive' ELSE 'negative' END AS label,
  CASE WHEN d.lang='de' THEN 'val' ELSE 'train' END AS split FROM documents d JOIN labels l ON l.doc_id=d.doc_id),
 f AS (SELECT doc_id AS filename, CASE WHEN n_chars>1500 THEN 'negative' ELSE 'positive' END AS dir_label, CASE WHEN lang IN ('de','es') THEN 'val' ELSE 'train' END AS dir_split FROM documents),
 s AS (SELECT DISTINCT lang AS sample_id, CASE WHEN lang IN ('de','es') THEN 'val' WHEN lang='en' THEN 'train' END AS split FROM documents),
 j AS (SELECT f.*, m.filename AS known, m.label, m.split, s.split AS ts FROM f LEFT JOIN m ON m.filename=f.filename LEFT JOIN s ON s.sample_id=m.sample_id)
SELECT filename, 'no_row' AS problem FROM j WHERE known IS NULL UNION ALL SELECT filename, 'label' FROM j WHERE label<>dir_label UNION ALL
SELECT filename, 'ambiguous' FROM j WHERE label='ambiguous' UNION ALL SELECT filename, 'split' FROM j WHERE split<>dir_split UNION ALL
SELECT filename, 'sample_split' FROM j WHERE known IS NOT NULL AND (ts IS NULL OR ts<>dir_split)""")
def _(v):
    docs = v.table("documents").select("doc_id", "lang", "n_chars")
    m = docs.join(v.table("labels"), "doc_id").select(
        F.col("doc_id").alias("filename"), F.col("lang").alias("sample_id"),
        F.when(F.col("toxic") == 1, "ambiguous").when(F.col("quality") == 1, "positive").otherwise("negative").alias("label"),
        F.when(F.col("lang") == "de", "val").otherwise("train").alias("split"))
    val = F.when(F.col("lang").isin("de", "es"), "val")
    f = docs.select(F.col("doc_id").alias("filename"), F.when(F.col("n_chars") > 1500, "negative").otherwise("positive").alias("dir_label"),
                    val.otherwise("train").alias("dir_split"))
    s = docs.select(F.col("lang").alias("sample_id"), val.when(F.col("lang") == "en", "train").alias("split")).distinct()
    return A.file_manifest_audit(f, m, s)


@query("inspection_set", """SELECT det_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY sample_id, t, det_id) AS rn FROM manifest)
WHERE rn<=CASE label WHEN 'positive' THEN 20 WHEN 'negative' THEN 15 ELSE 10 END""")
def _(v):
    caps = {"positive": 20, "negative": 15, "ambiguous": 10}
    return A.inspection_set(v.manifest, caps, ("sample_id", "t", "det_id")).select("det_id", "label")
