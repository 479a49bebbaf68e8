"""Matching and linking queries."""

from pyspark.sql import functions as F

from ..operators import lineage, matching
from .catalog import query, r6

FAR = 5.0


def _cells(v):
    return v.cells.withColumnRenamed("cell", "idx")


@query("match_global_grid", """
SELECT a.t, a.cell AS a_id, b.cell AS b_id, round(sqrt(2.0),6) AS distance
FROM cells a JOIN cells b ON a.cell=b.cell AND b.t=a.t+1""")
def _(v):
    prev, curr = matching.frame_steps(_cells(v))
    got = matching.match_global(prev, curr, 5.0, max_pairs=1_000_000)  # crowded-frame path
    return got.select(
        (F.col("t") - 1).alias("t"), "a_id", "b_id", r6("distance").alias("distance"))


@query("match_gated_grid", """
SELECT a.t, a.cell AS gt_id, b.cell AS pred_id, round(sqrt(2.0),6) AS distance
FROM cells a JOIN cells b ON a.cell=b.cell AND b.t=a.t+1""")
def _(v):
    prev, curr = matching.frame_steps(_cells(v))
    return matching.match_gated(prev, curr, 15.0, gt_id="a_id", pred_id="b_id").select(
        (F.col("t") - 1).alias("t"), F.col("a_id").alias("gt_id"), F.col("b_id").alias("pred_id"),
        r6("distance").alias("distance"))


@query("match_greedy_grid", """
SELECT a.t, a.cell AS a_id, b.cell AS b_id FROM cells a JOIN cells b ON a.cell=b.cell AND b.t=a.t+1""")
def _(v):
    prev, curr = matching.frame_steps(_cells(v))
    return matching.match_greedy(prev, curr, 10.0).select((F.col("t") - 1).alias("t"), "a_id", "b_id")


@query("link_frames_grid", """
SELECT b.t, a.cell AS prev_idx, b.cell AS curr_idx FROM cells a JOIN cells b ON a.cell=b.cell AND b.t=a.t+1""")
def _(v):
    return matching.link_frames(_cells(v), 25.0).select("t", "prev_idx", "curr_idx")


@query("build_lineage_grid", """
SELECT t*(SELECT count(*) FROM part)+cell AS node_id, t, round(y,6) AS y, round(x,6) AS x, cell+1 AS track_id,
  CASE WHEN t>0 THEN (t-1)*(SELECT count(*) FROM part)+cell END AS parent_node_id FROM cells""")
def _(v):
    det = _cells(v)
    links = matching.build_links(det, 25.0, 30.0)
    return lineage.build_lineage(det, links).select(
        "node_id", "t", r6("y").alias("y"), r6("x").alias("x"), "track_id", "parent_node_id")


@query("link_plain_grid", """
SELECT (t-1)*(SELECT count(*) FROM part)+cell AS src, t*(SELECT count(*) FROM part)+cell AS dst FROM cells WHERE t>0""")
def _(v):
    det = _cells(v)
    _, edges = lineage.link_plain(det, matching.link_frames(det, 25.0, "greedy"))
    return edges.select("src", "dst")


def _squares(v, name: str, turned: int):
    """Two points at opposite corners of a unit square in every cell: all distances to the other two corners are 1."""
    k = F.explode(F.array(F.lit(0), F.lit(1)))
    two = v.cells.withColumn("k", k)
    x = F.col("x") + (F.abs(F.col("k") - turned)).cast("double")
    return two.select("sample_id", "t", (F.col("cell") * 2 + F.col("k")).alias(name), (F.col("y") + F.col("k")).alias("y"), x.alias("x"))


TIES = "SELECT t, 2*cell+k AS a_id, 2*cell+k AS b_id, 1.0::DOUBLE AS distance FROM cells, (VALUES (0),(1)) AS s(k)"


def _told(pairs):
    return pairs.select("t", "a_id", "b_id", r6("distance").alias("distance"))


# each square can be matched in two ways of equal cost: the lower id takes the lower one, on both paths
@query("match_global_ties", TIES)
def _(v):
    return _told(matching.match_global(_squares(v, "a_id", 0), _squares(v, "b_id", 1), 5.0))


@query("match_global_ties_in_pieces", TIES)
def _(v):
    return _told(matching.match_global(_squares(v, "a_id", 0), _squares(v, "b_id", 1), 5.0, max_pairs=0))


@query("match_gated_ties", TIES)
def _(v):
    return _told(matching.match_gated(_squares(v, "a_id", 0), _squares(v, "b_id", 1), 5.0, "a_id", "b_id", max_pairs=0))


# two orphans left and right of every cell, which has room for two, one or none: the lower id is taken first
@query("attach_orphans_grid", """SELECT t, cell AS a_id, 2*cell+k AS b_id, 1.0::DOUBLE AS distance
FROM cells, (VALUES (0),(1)) AS s(k) WHERE k < 2 - cell % 3""")
def _(v):
    both = v.cells.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    orphans = both.select("sample_id", "t", (F.col("cell") * 2 + F.col("k")).alias("b_id"), "y", (F.col("x") + 1 - 2 * F.col("k")).alias("x"))
    prev = v.cells.withColumnRenamed("cell", "a_id")
    used = both.where("k < cell % 3").select("sample_id", "t", F.col("cell").alias("a_id"))
    return _told(matching.attach_orphans(orphans, prev, used, 30.0))


def _dividing(v):
    """The grid, with a second point 8 px below every fifth cell from frame 1 on."""
    det = _cells(v)
    n = v.table("part").count()
    more = det.where("t > 0 AND idx % 5 = 0").select("sample_id", "t", (F.col("idx") + 2 * n).alias("idx"), (F.col("y") + 8).alias("y"), "x")
    return det.unionByName(more)


# daughters appear in frame 1 and attach to their cells; later they are linked like any other point
@query("build_links_grid", """WITH n AS (SELECT count(*) AS n FROM part), d AS (SELECT t, cell AS idx, y, x FROM cells
  UNION ALL SELECT t, cell + 2*n, y+8, x FROM cells, n WHERE t > 0 AND cell % 5 = 0)
SELECT b.t, a.idx AS prev_idx, b.idx AS curr_idx, CASE WHEN a.idx=b.idx THEN 0 ELSE 1 END AS step, round(sqrt((a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x)),6) AS distance
FROM d a JOIN d b ON b.t=a.t+1 AND (a.idx=b.idx OR (b.t=1 AND b.idx=a.idx+2*(SELECT n FROM n)))""")
def _(v):
    return matching.build_links(_dividing(v), 25.0, 30.0).select("t", "prev_idx", "curr_idx", "step", r6("distance").alias("distance"))


# frame by frame: linked points by their parent's place, the link before the attached daughter
@query("canonical_ids_grid", """WITH n AS (SELECT count(*) AS n FROM part), d AS (SELECT t, cell AS idx FROM cells UNION ALL SELECT t, cell + 2*n FROM cells, n WHERE t > 0 AND cell % 5 = 0),
 f AS (SELECT t, idx, CASE WHEN t=1 AND idx >= 2*(SELECT n FROM n) THEN idx - 2*(SELECT n FROM n) ELSE idx END AS major0, CASE WHEN t=1 AND idx >= 2*(SELECT n FROM n) THEN 1 ELSE 0 END AS step FROM d)
SELECT t, idx, prev_idx, row_number() OVER (ORDER BY t, prev_rank, step, idx) - 1 AS node_id FROM (
 SELECT t, idx, step, CASE WHEN t > 0 THEN major0 END AS prev_idx, major0 AS prev_rank FROM f)""")
def _(v):
    det = _dividing(v)
    links = matching.build_links(det, 25.0, 30.0)
    ids = lineage.canonical_ids(det, links)
    parents = ids.select("sample_id", F.col("node_id").alias("parent_node_id"), F.col("idx").alias("prev_idx"))
    return ids.join(parents, ["sample_id", "parent_node_id"], "left").select("t", "idx", "prev_idx", "node_id")


def _det(v):
    return v.det.withColumnRenamed("det_id", "idx")


@query("match_gated")
def _(v):
    return matching.match_gated(v.gt, v.det, 15.0, pred_id="det_id")


@query("match_global")
def _(v):
    return matching.match_global(v.det, v.gt, 7.0, a_id="det_id", b_id="gt_id")


@query("match_greedy")
def _(v):
    return matching.match_greedy(v.det, v.gt, 7.0, a_id="det_id", b_id="gt_id")


@query("link_frames")
def _(v):
    return matching.link_frames(_det(v), 25.0)


@query("build_links")
def _(v):
    return matching.build_links(_det(v), 25.0, 30.0)


@query("attach_orphans")
def _(v):
    # every point of a day is an orphan looking for a parent among the annotated points
    gt = v.gt.withColumnRenamed("gt_id", "a_id")
    used = gt.select("sample_id", "t", "a_id")
    return matching.attach_orphans(v.det.withColumnRenamed("det_id", "b_id"), gt, used, 30.0)


@query("build_lineage")
def _(v):
    det = _det(v)
    return lineage.build_lineage(det, matching.build_links(det, 25.0, 30.0))


@query("canonical_ids")
def _(v):
    det = _det(v)
    return lineage.canonical_ids(det, matching.build_links(det, 25.0, 30.0))


@query("link_with_user_matcher", """WITH p AS (SELECT b.sample_id, b.t, a.det_id AS i, b.det_id AS j, sqrt((a.y-b.y)*(a.y-b.y)+(a.x-b.x)*(a.x-b.x)) AS d
 FROM det a JOIN det b ON a.sample_id=b.sample_id AND b.t=a.t+1),
 r AS (SELECT *, row_number() OVER (PARTITION BY sample_id, t, i ORDER BY d, j) AS ri, row_number() OVER (PARTITION BY sample_id, t, j ORDER BY d, i) AS rj FROM p)
SELECT sample_id, t, i AS prev_idx, j AS curr_idx, round(d,6) AS distance FROM r WHERE ri=1 AND rj=1 AND d<=25""")
def _(v):
    import numpy as np

    def nearest_mutual(prev, curr):
        d = np.sqrt(((prev[:, None, :] - curr[None, :, :]) ** 2).sum(axis=2))
        back = d.argmin(axis=0)
        return [(i, j) for i, j in enumerate(d.argmin(axis=1)) if back[j] == i and d[i, j] <= 25.0]

    return matching.link_frames(_det(v), matcher=nearest_mutual).withColumn("distance", r6("distance"))
