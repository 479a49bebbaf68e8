"""Frame and patch queries: the 8x8 vectors read as small images."""

from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import frames as J, patches as P
from .catalog import query, r6


def _r(df, *names):
    return df.select(*[r6(c).alias(c) if c in names else F.col(c) for c in df.columns])


def _px(v):
    return v.pixels.withColumn("t", F.col("vec_id").cast("int")).select("sample_id", "t", "y", "x", "v")


def _frames(v):
    return v.patches.select("sample_id", F.col("vec_id").cast("int").alias("t"), F.lit(8).alias("height"), F.lit(8).alias("width"), "pix")


def _patches(v):
    return v.patches.withColumn("label", (F.col("sample_id").cast("int") >= 5).cast("int")).withColumn(
        "split", F.when(F.col("sample_id").isin("0", "1"), "test").otherwise("train"))


FR = "SELECT sample_id, CAST(vec_id AS INT) AS t, y, x, v FROM pixels"
LONG = "SELECT sample_id, vec_id, i, round({e},6)+0.0 AS v FROM (SELECT *, y*8+x AS i FROM pixels)"


def _long(df, pix="pix"):
    return df.select("sample_id", "vec_id", F.posexplode(pix).alias("i", "v")).select("sample_id", "vec_id", "i", r6("v").alias("v"))


@query("max_project", "SELECT sample_id, CAST(vec_id AS INT) AS t, CAST((y*8+x)%16//4 AS INT) AS y, CAST((y*8+x)%4 AS INT) AS x, max(v) AS v FROM pixels GROUP BY 1,2,3,4")
def _(v):
    i = F.col("y") * 8 + F.col("x")
    vol = _px(v).select("sample_id", "t", F.floor(i / 16).cast("int").alias("z"), F.floor(i % 16 / 4).cast("int").alias("y"),
                        (i % 4).cast("int").alias("x"), "v")
    return J.max_project(vol)


SMOOTH = """WITH p AS (SELECT * FROM (@F)), k AS (SELECT k, exp(-0.5*k*k)/(SELECT sum(exp(-0.5*j*j)) FROM (SELECT unnest(range(-4,5)) AS j)) AS w FROM (SELECT unnest(range(-4,5)) AS k)),
 o AS (SELECT unnest(range(0,8)) AS o), m AS (SELECT CAST(o AS INT) AS o, w, CAST(CASE WHEN o+k<0 THEN -1-(o+k) WHEN o+k>7 THEN 15-(o+k) ELSE o+k END AS INT) AS s FROM o CROSS JOIN k),
 a AS (SELECT p.sample_id, p.t, m.o AS y, p.x, sum(p.v*m.w) AS v FROM p JOIN m ON m.s=p.y GROUP BY 1,2,3,4)
SELECT a.sample_id, a.t, a.y, m.o AS x, round(sum(a.v*m.w),6)+0.0 AS v FROM a JOIN m ON m.s=a.x GROUP BY 1,2,3,4""".replace("@F", FR)


@query("gaussian_smooth", SMOOTH)
def _(v):
    return _r(J.gaussian_smooth(_px(v), 1.0), "v")


@query("local_maxima", f"""WITH p AS ({FR}) SELECT p.sample_id, p.t, p.y, p.x, round(p.v,6) AS v FROM p JOIN p q ON p.sample_id=q.sample_id AND p.t=q.t
 AND abs(p.y-q.y)<=2 AND abs(p.x-q.x)<=2 WHERE p.v>0.1 AND p.y BETWEEN 2 AND 5 AND p.x BETWEEN 2 AND 5 GROUP BY 1,2,3,4,p.v HAVING p.v=max(q.v)""")
def _(v):
    return _r(J.local_maxima(_px(v), 2, 0.1), "v")


@query("detect", f"""WITH s AS (SELECT sample_id, t, y, x, v FROM ({SMOOTH.replace('round(sum(a.v*m.w),6)+0.0', 'sum(a.v*m.w)')}))
SELECT p.sample_id, p.t, CAST(p.y AS DOUBLE) AS y, CAST(p.x AS DOUBLE) AS x FROM s p JOIN s q ON p.sample_id=q.sample_id AND p.t=q.t AND abs(p.y-q.y)<=2 AND abs(p.x-q.x)<=2
WHERE p.v>0.02 AND p.y BETWEEN 2 AND 5 AND p.x BETWEEN 2 AND 5 GROUP BY 1,2,p.y,p.x,p.v HAVING p.v>=max(q.v)""")
def _(v):
    return J.detect(_frames(v), 1.0, 0.02, 2).select("sample_id", "t", "y", "x")


def _peaks(smooth, sigma, threshold, d):
    return f"""SELECT p.sample_id, p.t, {sigma}::DOUBLE AS sigma, {threshold}::DOUBLE AS threshold, {d} AS min_distance, CAST(p.y AS DOUBLE) AS y, CAST(p.x AS DOUBLE) AS x
 FROM {smooth} p JOIN {smooth} q ON p.sample_id=q.sample_id AND p.t=q.t AND abs(p.y-q.y)<={d} AND abs(p.x-q.x)<={d}
 WHERE p.v>{threshold} AND p.y BETWEEN {d} AND {7 - d} AND p.x BETWEEN {d} AND {7 - d} GROUP BY p.sample_id, p.t, p.y, p.x, p.v HAVING p.v>=max(q.v)"""


_WIDE = SMOOTH.replace('round(sum(a.v*m.w),6)+0.0', 'sum(a.v*m.w)')
_HALF = _WIDE.replace("range(-4,5)", "range(-2,3)").replace("-0.5*k*k", "-2.0*k*k").replace("-0.5*j*j", "-2.0*j*j")


@query("detect_grid", f"WITH s1 AS MATERIALIZED ({_WIDE}), s05 AS MATERIALIZED ({_HALF}) " + " UNION ALL ".join(
    _peaks(s, g, t, d) for s, g in (("s05", 0.5), ("s1", 1.0)) for t in (0.02, 0.05) for d in (1, 2)))
def _(v):
    return J.detect(_frames(v), grid=[(s, t, d) for s in (0.5, 1.0) for t in (0.02, 0.05) for d in (1, 2)]).drop("idx")


@query("detect_adaptive", f"""WITH s AS MATERIALIZED ({_WIDE}), h AS (SELECT sample_id, t, greatest(quantile_cont(v,0.8),0.02) AS threshold FROM ({FR}) GROUP BY 1,2)
SELECT p.sample_id, p.t, round(h.threshold,6) AS threshold, CAST(p.y AS DOUBLE) AS y, CAST(p.x AS DOUBLE) AS x FROM s p JOIN h ON h.sample_id=p.sample_id AND h.t=p.t
 JOIN s q ON p.sample_id=q.sample_id AND p.t=q.t AND abs(p.y-q.y)<=1 AND abs(p.x-q.x)<=1
 WHERE p.v>h.threshold AND p.y BETWEEN 1 AND 6 AND p.x BETWEEN 1 AND 6 GROUP BY p.sample_id, p.t, h.threshold, p.y, p.x, p.v HAVING p.v>=max(q.v)""")
def _(v):
    px = _px(v)  # pixels to frames, each with a threshold of its own
    levels = J.frame_threshold(px, "percentile", percentile=80.0, floor=0.02).drop("raw").withColumnRenamed("threshold", "level")
    found = J.detect(J.frames_of_pixels(px).join(levels, ["sample_id", "t"]), 1.0, "level", 1)
    return found.select("sample_id", "t", r6("threshold").alias("threshold"), "y", "x")


@query("detect_with_user_detector", f"""SELECT sample_id, t, 1.0::DOUBLE AS sigma, 0.1::DOUBLE AS threshold, 1 AS min_distance, 0 AS idx, CAST(y AS DOUBLE) AS y, CAST(x AS DOUBLE) AS x
FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, t ORDER BY v DESC, y, x) AS rn FROM ({FR})) WHERE rn=1 AND v>0.1""")
def _(v):
    import numpy as np

    def brightest(image, sigma, threshold, d):
        return [np.unravel_index(image.argmax(), image.shape)] if image.max() > threshold else []

    return J.detect(_frames(v), 1.0, 0.1, 1, detector=brightest)


@query("frame_threshold_percentile", f"SELECT sample_id, t, round(quantile_cont(v,0.99),6) AS raw, round(greatest(quantile_cont(v,0.99),0.25),6) AS threshold FROM ({FR}) GROUP BY 1,2")
def _(v):
    return _r(J.frame_threshold(_px(v), "percentile", floor=0.25), "raw", "threshold")


@query("frame_threshold_robust", f"""SELECT p.sample_id, p.t, round(max(m)+3*quantile_cont(abs(v-m),0.5),6) AS raw, round(greatest(max(m)+3*quantile_cont(abs(v-m),0.5),0.2),6) AS threshold
FROM ({FR}) p JOIN (SELECT sample_id, t, quantile_cont(v,0.5) AS m FROM ({FR}) GROUP BY 1,2) q ON q.sample_id=p.sample_id AND q.t=p.t GROUP BY 1,2""")
def _(v):
    return _r(J.frame_threshold(_px(v), "robust", floor=0.2), "raw", "threshold")


@query("frame_threshold_otsu", f"""WITH p AS ({FR}), e AS (SELECT sample_id, t, min(v) AS lo, max(v) AS hi FROM p GROUP BY 1,2),
 h AS (SELECT p.sample_id, p.t, lo, hi, CAST(least(floor((v-lo)*256/(hi-lo)),255) AS INT) AS bin, CAST(count(*) AS DOUBLE) AS n FROM p JOIN e ON e.sample_id=p.sample_id AND e.t=p.t GROUP BY 1,2,3,4,5),
 c AS (SELECT *, lo+(bin+0.5)*((hi-lo)/256) AS c FROM h),
 w AS (SELECT *, sum(n) OVER u AS w1, sum(n*c) OVER u AS s1, sum(n) OVER d AS w2, sum(n*c) OVER d AS s2 FROM c
  WINDOW u AS (PARTITION BY sample_id, t ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), d AS (PARTITION BY sample_id, t ORDER BY bin ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
 r AS (SELECT *, row_number() OVER (PARTITION BY sample_id, t ORDER BY round(w1*w2*(s1/w1-s2/w2)*(s1/w1-s2/w2),9) DESC NULLS LAST, bin) AS rn FROM w)
SELECT sample_id, t, round(c,6)+0.0 AS raw, round(greatest(c,0.0),6)+0.0 AS threshold FROM r WHERE rn=1""")
def _(v):
    return _r(J.frame_threshold(_px(v), "otsu", floor=0.0), "raw", "threshold")


@query("frame_profile", f"""SELECT sample_id, t, round(min(v),6) AS min, round(max(v),6) AS max, round(avg(v),6)+0.0 AS mean, round(quantile_cont(v,0.01),6) AS p1,
 round(quantile_cont(v,0.99),6) AS p99, round(quantile_cont(v,0.995),6) AS p995, round(quantile_cont(v,0.999),6) AS p999 FROM ({FR}) WHERE y>=1 AND y<7 AND x>=2 AND x<8 GROUP BY 1,2""")
def _(v):
    out = J.frame_profile(_px(v), (1, 2, 7, 8))
    return _r(out, *out.columns[2:])


@query("region_candidates", f"""WITH RECURSIVE b AS (SELECT sample_id, t, y, x, v FROM ({FR}) WHERE v>0.08),
 walk AS (SELECT sample_id, t, y, x, y*8+x AS root FROM b UNION SELECT b.sample_id, b.t, b.y, b.x, w.root FROM walk w JOIN b
   ON b.sample_id=w.sample_id AND b.t=w.t AND abs(b.y-w.y)+abs(b.x-w.x)=1),
 l AS (SELECT sample_id, t, y, x, min(root) AS root FROM walk GROUP BY 1,2,3,4)
SELECT l.sample_id, l.t, round(avg(l.y),6) AS y, round(avg(l.x),6) AS x, count(*) AS area, round(max(b.v),6) AS max_v
FROM l JOIN b ON b.sample_id=l.sample_id AND b.t=l.t AND b.y=l.y AND b.x=l.x GROUP BY l.sample_id, l.t, l.root HAVING count(*) BETWEEN 2 AND 12""")
def _(v):
    return _r(J.region_candidates(_px(v), 0.08, 2, 12).drop("region"), "y", "x", "max_v")


@query("extract_patches", f"""WITH c AS (SELECT sample_id, t, y AS cy, x AS cx FROM ({FR}) WHERE v>0.15)
SELECT c.sample_id, c.t, c.cy, c.cx, CAST((p.y-c.cy+2)*4+(p.x-c.cx+2) AS INT) AS i, round(p.v,6)+0.0 AS v FROM c JOIN ({FR}) p ON p.sample_id=c.sample_id AND p.t=c.t
 AND p.y>=c.cy-2 AND p.y<c.cy+2 AND p.x>=c.cx-2 AND p.x<c.cx+2 WHERE c.cy-2>=0 AND c.cx-2>=0 AND c.cy+2<8 AND c.cx+2<8""")
def _(v):
    out = P.extract_patches(_frames(v), _px(v).where("v > 0.15").select("sample_id", "t", "y", "x"), 4)
    return out.select("sample_id", "t", F.col("y").alias("cy"), F.col("x").alias("cx"), F.posexplode("pix").alias("i", "v")).withColumn("v", r6("v"))


@query("crop_resize", """WITH g AS (SELECT CAST(k AS INT) AS i, k//8*3.0::DOUBLE/7 AS sy, k%8*3.0::DOUBLE/7 AS sx FROM (SELECT unnest(range(0,64)) AS k)),
 q AS (SELECT i, CAST(least(floor(sy),2) AS INT) AS y, CAST(least(floor(sx),2) AS INT) AS x, sy-least(floor(sy),2) AS fy, sx-least(floor(sx),2) AS fx FROM g)
SELECT a.sample_id, a.vec_id, q.i, round(CAST((1-fy)*((1-fx)*a.v+fx*b.v)+fy*((1-fx)*c.v+fx*d.v) AS FLOAT)::DOUBLE,5)+0.0 AS v
FROM q JOIN pixels a ON a.y=q.y+2 AND a.x=q.x+2 JOIN pixels b ON b.vec_id=a.vec_id AND b.y=a.y AND b.x=a.x+1
 JOIN pixels c ON c.vec_id=a.vec_id AND c.y=a.y+1 AND c.x=a.x JOIN pixels d ON d.vec_id=a.vec_id AND d.y=a.y+1 AND d.x=a.x+1""")
def _(v):
    out = v.patches.withColumn("pix", arrays.crop_resize("pix", 8, 2))
    return out.select("sample_id", "vec_id", F.posexplode("pix").alias("i", "v")).withColumn("v", F.round(F.col("v").cast("double"), 5) + F.lit(0.0))


@query("normalise_patch", "WITH s AS (SELECT vec_id, avg(v) AS m, stddev_pop(v) AS d FROM pixels GROUP BY 1) SELECT p.sample_id, p.vec_id, p.y*8+p.x AS i, round((p.v-m)/(d+0.000001),6)+0.0 AS v FROM pixels p JOIN s ON s.vec_id=p.vec_id")
def _(v):
    return _long(P.normalise(v.patches, "patch"))


ROBUST = """md AS (SELECT sample_id, quantile_cont(v,0.5) AS m FROM pixels GROUP BY 1),
 st AS (SELECT p.sample_id, any_value(m) AS m, quantile_cont(abs(v-m),0.5) AS mad FROM pixels p JOIN md ON md.sample_id=p.sample_id GROUP BY 1)"""


@query("normalise_sample", f"WITH {ROBUST} SELECT p.sample_id, p.vec_id, p.y*8+p.x AS i, round((v-m)/(1.4826*mad+0.001),6)+0.0 AS v FROM pixels p JOIN st ON st.sample_id=p.sample_id")
def _(v):
    return _long(P.normalise(v.patches, "sample", 0.001, P.robust_stats(v.patches)))


@query("normalise_global", """WITH s AS (SELECT avg(v) AS m, stddev_pop(v) AS d FROM pixels WHERE sample_id NOT IN ('0','1'))
SELECT p.sample_id, p.vec_id, p.y*8+p.x AS i, round((v-m)/(d+0.00000001),6)+0.0 AS v FROM pixels p CROSS JOIN s""")
def _(v):
    stats = v.pixels.where("sample_id NOT IN ('0','1')").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return _long(P.normalise(v.patches, "global", stats=stats))


@query("patch_stats", "SELECT sample_id, vec_id, round(avg(v),6)+0.0 AS mean, round(stddev_pop(v),6) AS std FROM pixels GROUP BY 1,2")
def _(v):
    return _r(P.patch_stats(v.patches).drop("pix"), "mean", "std")


@query("validate_patches", """SELECT CAST(label AS VARCHAR) AS sample_id, vec_id, CASE WHEN label=3 THEN 'wrong_size' WHEN label=4 THEN 'nan' ELSE 'inf' END AS violation
FROM embeddings WHERE label IN (3,4) OR (label=5 AND list_contains(list_transform(embedding, lambda x: x>0.2), true))""")
def _(v):
    three = F.when(F.col("sample_id") == "3", F.slice("pix", 1, 60)).when(
        F.col("sample_id") == "4", F.concat(F.slice("pix", 1, 63), F.array(F.lit(float("nan")).cast("float")))).when(
        F.col("sample_id") == "5", F.transform("pix", lambda x: F.when(x > 0.2, F.lit(float("inf")).cast("float")).otherwise(x))).otherwise(F.col("pix"))
    return P.validate_patches(v.patches.withColumn("pix", three), 64)


@query("pixel_distribution", """SELECT sample_id, count(DISTINCT vec_id) AS n_patches, count(DISTINCT CASE WHEN sample_id>='5' THEN vec_id END) AS n_positive,
 count(DISTINCT CASE WHEN sample_id<'5' THEN vec_id END) AS n_negative, CASE WHEN sample_id>='5' THEN 1.0::DOUBLE ELSE 0 END AS positive_ratio, round(avg(v),6)+0.0 AS mean,
 round(stddev_pop(v),6) AS std, round(min(v),6) AS min, round(max(v),6) AS max FROM pixels GROUP BY 1""")
def _(v):
    return _r(P.pixel_distribution(_patches(v)), "positive_ratio", "mean", "std", "min", "max")


@query("robust_stats", f"""WITH {ROBUST} SELECT st.sample_id, n AS n_patches, round(m,6)+0.0 AS median, round(mad,6) AS mad, round(1.4826*mad,6) AS scale, n<20 AS few_patches
FROM st JOIN (SELECT sample_id, count(DISTINCT vec_id) AS n FROM pixels GROUP BY 1) c ON c.sample_id=st.sample_id""")
def _(v):
    return _r(P.robust_stats(v.patches), "median", "mad", "scale")


@query("robust_eps", """SELECT round(quantile_cont(d,0.5),6) AS median_std, round(greatest(0.000001,0.02*quantile_cont(d,0.5)),6) AS eps
FROM (SELECT vec_id, stddev_pop(v) AS d FROM pixels WHERE sample_id NOT IN ('0','1') GROUP BY 1)""")
def _(v):
    return _r(P.robust_eps(_patches(v)), "median_std", "eps")


_DRAW = "CAST('0x' || substr(md5({}),1,12) AS BIGINT)"


@query("split_samples", f"""WITH o AS (SELECT c_name AS sample_id, row_number() OVER (ORDER BY {_DRAW.format("'11|' || c_name")}, c_name)-1 AS r, count(*) OVER () AS n
 FROM (SELECT DISTINCT c_name FROM customer))
SELECT sample_id, CASE WHEN r<round_even(0.7*n,0) THEN 'train' WHEN r<round_even(0.7*n,0)+round_even(0.15*n,0) THEN 'val' ELSE 'test' END AS split FROM o""")
def _(v):
    return P.split_samples(v.table("customer").select(F.col("c_name").alias("sample_id")), seed=11)


_LABELLED = "SELECT vec_id, CAST(label>=5 AS INT) AS label FROM embeddings"


@query("holdout", f"""SELECT vec_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {_DRAW.format("'3|' || vec_id")}, vec_id)-1
 < round_even(0.2*count(*) OVER (PARTITION BY label),0) THEN 'val' ELSE 'train' END AS part FROM ({_LABELLED})""")
def _(v):
    return P.holdout(_patches(v), "vec_id", 0.2, seed=3).select("vec_id", "label", "part")


@query("balanced_sample", f"""WITH p AS ({_LABELLED}), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id)-1 AS k FROM p),
 s AS (SELECT label, count(*) AS n FROM p GROUP BY 1),
 d AS (SELECT id AS draw, CAST({_DRAW.format("id || '|5|class'")}%2 AS INT) AS label, {_DRAW.format("id || '|5|row'")} AS u FROM (SELECT unnest(range(0,(SELECT count(*) FROM p))) AS id))
SELECT d.draw, d.label, r.vec_id FROM d JOIN s ON s.label=d.label JOIN r ON r.label=d.label AND r.k=d.u%s.n""")
def _(v):
    return P.balanced_sample(_patches(v), "vec_id", seed=5).select("draw", "label", "vec_id")


@query("augment")
def _(v):
    return P.augment(_patches(v), "vec_id", 8, copies=2, seed=9).select("vec_id", "copy", "split", "pix")


@query("score_patches", """SELECT vec_id, round(1/(1+exp(-10*avg(v)*64)),6) AS probability FROM pixels GROUP BY 1 HAVING 1/(1+exp(-10*avg(v)*64))>=0.5""")
def _(v):
    def model():
        import numpy as np

        return lambda x: 1.0 / (1.0 + np.exp(-10.0 * x.reshape(len(x), -1).sum(axis=1)))

    return P.score_patches(v.patches, model, 8).select("vec_id", r6("probability").alias("probability"))
