"""Lineage and motion queries over the forest of tracks."""

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import graph, lineage, motion
from .catalog import query, r6

SPEEDS = """speeds AS (
  SELECT n.sample_id, n.node_id, n.track_id, n.t, sqrt((n.y-p.y)*(n.y-p.y)+(n.x-p.x)*(n.x-p.x))/(n.t-p.t) AS speed
  FROM lineage n JOIN lineage p ON p.node_id=n.parent_node_id
  WHERE n.track_id=p.track_id OR p.node_id IN (SELECT parent_node_id FROM divs))"""
# a first node counts only when its parent divided in exactly two


def _divs(v):
    return lineage.divisions(v.lineage)


@query("node_speeds", f"WITH {SPEEDS} SELECT sample_id, node_id, round(speed,6)+0.0 AS speed FROM speeds")
def _(v):
    return motion.node_speeds(v.lineage).select("sample_id", "node_id", r6("speed").alias("speed"))


@query("node_speeds_calibrated", f"""WITH {SPEEDS}
SELECT sample_id, node_id, round(speed*0.4/2.5,6)+0.0 AS speed FROM speeds""")
def _(v):
    return motion.node_speeds(v.lineage, 0.4, 2.5).select("sample_id", "node_id", r6("speed").alias("speed"))


@query("track_summary", f"""WITH {SPEEDS}
SELECT f.sample_id, f.track_id, f.parent_track_id, f.start_t AS birth_frame, f.end_t AS death_frame,
  CAST(f.end_t-f.start_t+1 AS INT) AS track_length, round(s.avg_speed,6)+0.0 AS avg_speed,
  CASE WHEN d.track_a IS NULL THEN '' ELSE d.track_a || ',' || d.track_b END AS children
FROM forest f LEFT JOIN (SELECT track_id, avg(speed) AS avg_speed FROM speeds GROUP BY 1) s ON s.track_id=f.track_id
LEFT JOIN divs d ON d.parent_track_id=f.track_id""")
def _(v):
    out = motion.track_summary(v.lineage, v.forest, _divs(v), motion.node_speeds(v.lineage))
    return out.select("sample_id", "track_id", "parent_track_id", "birth_frame", "death_frame", "track_length",
                      r6("avg_speed").alias("avg_speed"),
                      F.concat_ws(",", F.col("children_track_ids").cast("array<string>")).alias("children"))


@query("dataset_stats", f"""WITH {SPEEDS}
SELECT (SELECT count(*) FROM lineage) AS n_cells, (SELECT count(*) FROM forest) AS n_tracks,
  (SELECT count(*) FROM divs) AS n_divisions,
  round((SELECT avg(end_t-start_t+1) FROM forest)*2.5,6) AS avg_lifetime,
  round((SELECT avg(speed) FROM speeds)*0.4/2.5,6) AS avg_velocity, 'um/min' AS units""")
def _(v):
    out = motion.dataset_stats(v.lineage, v.forest, _divs(v), motion.node_speeds(v.lineage, 0.4, 2.5), 2.5, "um/min")
    return out.withColumn("avg_lifetime", r6("avg_lifetime")).withColumn("avg_velocity", r6("avg_velocity"))


@query("cells_per_frame", "SELECT sample_id, t, count(*) AS n_cells FROM lineage GROUP BY 1, 2")
def _(v):
    return motion.cells_per_frame(v.lineage)


@query("divisions_per_frame", """
WITH d AS (SELECT d.sample_id, n.t FROM divs d JOIN lineage n ON n.node_id=d.child_a)
SELECT s.sample_id, CAST(s.t AS INT) AS t, count(d.t) AS n_divisions
FROM (SELECT sample_id, unnest(range(min(t), max(t)+1)) AS t FROM d GROUP BY 1) s
LEFT JOIN d ON d.sample_id=s.sample_id AND d.t=s.t GROUP BY 1, 2""")
def _(v):
    return motion.divisions_per_frame(_divs(v))


@query("cumulative_divisions", """
SELECT d.sample_id, d.parent_node_id, n.t,
  row_number() OVER (PARTITION BY d.sample_id ORDER BY n.t, d.parent_node_id) AS n_so_far
FROM divs d JOIN lineage n ON n.node_id=d.child_a""")
def _(v):
    return motion.cumulative_divisions(_divs(v))


@query("speed_histogram", f"""WITH {SPEEDS},
b AS (SELECT sample_id, min(speed) AS lo, max(speed) AS hi, least(20, greatest(5, count(*)//2)) AS bins FROM speeds GROUP BY 1),
bb AS (SELECT sample_id, bins, CASE WHEN lo=hi THEN lo-0.5 ELSE lo END AS lo, CASE WHEN lo=hi THEN hi+0.5 ELSE hi END AS hi FROM b)
SELECT s.sample_id, CAST(s.bin AS INT) AS bin, round(s.lo+s.bin*(s.hi-s.lo)/s.bins,6)+0.0 AS left_edge, count(p.node_id) AS n
FROM (SELECT *, unnest(range(0, bins)) AS bin FROM bb) s
LEFT JOIN (SELECT p.sample_id, p.node_id, least(floor((p.speed-bb.lo)*bb.bins/(bb.hi-bb.lo)), bb.bins-1) AS bin
           FROM speeds p JOIN bb ON bb.sample_id=p.sample_id) p ON p.sample_id=s.sample_id AND p.bin=s.bin
GROUP BY s.sample_id, s.bin, s.lo, s.hi, s.bins""")
def _(v):
    return motion.speed_histogram(motion.node_speeds(v.lineage)).select("sample_id", "bin", r6("left_edge").alias("left_edge"), "n")


@query("cell_details", f"""WITH {SPEEDS}
SELECT n.sample_id, n.node_id, n.track_id, round(n.y,6)+0.0 AS y, round(n.x,6)+0.0 AS x, n.parent_node_id, f.parent_track_id,
  f.start_t AS birth_frame, f.end_t AS death_frame, CAST(f.end_t-f.start_t+1 AS INT) AS track_length,
  CASE WHEN k.track_a IS NULL THEN '' ELSE k.track_a || ',' || k.track_b END AS children, round(s.speed,6)+0.0 AS speed,
  d.parent_node_id IS NOT NULL AS is_division
FROM lineage n JOIN forest f ON f.track_id=n.track_id LEFT JOIN divs k ON k.parent_track_id=n.track_id
LEFT JOIN divs d ON d.parent_node_id=n.node_id LEFT JOIN speeds s ON s.node_id=n.node_id WHERE n.t=49""")
def _(v):
    out = motion.cell_details(v.lineage, v.forest, _divs(v), motion.node_speeds(v.lineage), 49)
    return out.select("sample_id", "node_id", "track_id", r6("y").alias("y"), r6("x").alias("x"), "parent_node_id",
                      "parent_track_id", "birth_frame", "death_frame", "track_length",
                      F.concat_ws(",", F.col("children_track_ids").cast("array<string>")).alias("children"),
                      r6("speed").alias("speed"), "is_division")


@query("find_divisions", "SELECT sample_id, parent_node_id, child_a, child_b FROM divs")
def _(v):
    return graph.find_divisions(v.lineage_edges)


@query("gt_division_count", """
SELECT sample_id, count(CASE WHEN n>=2 THEN 1 END) AS n_divisions
FROM (SELECT sample_id, src, count(*) AS n FROM lineage_edges GROUP BY 1, 2) GROUP BY 1""")
def _(v):
    return graph.gt_division_count(v.lineage_edges)


@query("components", """
SELECT n.sample_id, n.node_id AS node, min(m.node_id) OVER (PARTITION BY n.sample_id) AS component
FROM lineage n JOIN (SELECT sample_id, min(node_id) AS node_id FROM lineage GROUP BY 1) m ON m.sample_id=n.sample_id""")
def _(v):
    return graph.components(v.lineage_edges)  # each tree is one component


@query("descendants", """
WITH RECURSIVE below AS (
  SELECT sample_id, track_id AS root, track_id FROM forest WHERE parent_track_id IS NULL
  UNION ALL SELECT f.sample_id, b.root, f.track_id FROM forest f JOIN below b ON f.parent_track_id=b.track_id)
SELECT sample_id, root, track_id FROM below""")
def _(v):
    return graph.descendants(v.forest, v.forest.where("parent_track_id IS NULL"))


@query("descendant_nodes", """
WITH RECURSIVE below AS (
  SELECT sample_id, parent_track_id AS root, track_id FROM forest WHERE parent_track_id IN (4, 5)
  UNION ALL SELECT f.sample_id, b.root, f.track_id FROM forest f JOIN below b ON f.parent_track_id=b.track_id)
SELECT n.sample_id, b.root, n.node_id FROM below b JOIN lineage n ON n.track_id=b.track_id""")
def _(v):
    roots = v.forest.where("track_id IN (4, 5)")
    return graph.descendant_nodes(v.lineage, v.forest, roots, include_self=False)


@query("lineage_layout", """WITH RECURSIVE c AS (SELECT sample_id, parent_track_id AS p, count(*) AS n FROM forest WHERE parent_track_id IS NOT NULL GROUP BY 1,2),
 walk AS (SELECT sample_id, track_id, [track_id] AS path FROM forest WHERE parent_track_id IS NULL
  UNION ALL SELECT f.sample_id, f.track_id, list_append(w.path, f.track_id) FROM walk w JOIN forest f ON f.sample_id=w.sample_id AND f.parent_track_id=w.track_id),
 leaf AS (SELECT w.sample_id, w.track_id, row_number() OVER (PARTITION BY w.sample_id ORDER BY path)-1 AS slot FROM walk w LEFT JOIN c ON c.sample_id=w.sample_id AND c.p=w.track_id WHERE c.p IS NULL),
 up AS (SELECT sample_id, slot, track_id AS node, 1.0::DOUBLE AS w FROM leaf
  UNION ALL SELECT u.sample_id, u.slot, f.parent_track_id, u.w/c.n FROM up u JOIN forest f ON f.sample_id=u.sample_id AND f.track_id=u.node
   JOIN c ON c.sample_id=f.sample_id AND c.p=f.parent_track_id)
SELECT sample_id, node AS track_id, round(sum(slot*w),6)+0.0 AS slot FROM up GROUP BY 1,2""")
def _(v):
    return graph.lineage_layout(v.forest).withColumn("slot", r6("slot"))


@query("rebuild_tracks", """
SELECT sample_id, track_id, min(t) AS start_t, max(t) AS end_t, any_value(parent_track_id) AS parent_track_id
FROM lineage GROUP BY 1, 2""")
def _(v):
    return lineage.rebuild_from_nodes(_flagged(v))[0]


def _flagged(v):
    return lineage.flag_division_parents(v.lineage.drop("parent_track_id"), _divs(v), v.forest)


@query("rebuild_edges", "SELECT sample_id, src, dst FROM lineage_edges")
def _(v):
    return lineage.rebuild_from_nodes(_flagged(v))[1]


@query("rebuild_divisions", """
SELECT d.sample_id, d.parent_node_id, d.parent_track_id, d.child_a || ',' || d.child_b AS child_nodes,
  d.track_a || ',' || d.track_b AS child_tracks, n.t FROM divs d JOIN lineage n ON n.node_id=d.child_a""")
def _(v):
    return lineage.rebuild_from_nodes(_flagged(v))[2].select(
        "sample_id", "parent_node_id", "parent_track_id",
        F.concat_ws(",", F.col("children_node_ids").cast("array<string>")).alias("child_nodes"),
        F.concat_ws(",", F.col("children_track_ids").cast("array<string>")).alias("child_tracks"), "t")


@query("flag_division_parents", """
SELECT n.sample_id, n.node_id, n.track_id, n.parent_node_id, n.parent_track_id,
  d.parent_node_id IS NOT NULL AS is_division_parent
FROM lineage n LEFT JOIN divs d ON d.parent_node_id=n.node_id""")
def _(v):
    return _flagged(v).drop("t", "y", "x")


@query("division_report", """
SELECT d.sample_id, d.parent_node_id, d.parent_track_id, n.t, c.track_id AS child_track_id,
  p.start_t AS parent_start, p.end_t AS parent_end, c.start_t AS child_start, c.end_t AS child_end,
  CAST(c.end_t-c.start_t+1 AS INT) AS child_length
FROM divs d JOIN lineage n ON n.node_id=d.child_a JOIN forest p ON p.track_id=d.parent_track_id
JOIN forest c ON c.track_id IN (d.track_a, d.track_b)""")
def _(v):
    return lineage.division_report(_divs(v), v.forest)


@query("neighbours", """
WITH asked AS (SELECT parent_node_id AS node_id FROM divs),
o AS (SELECT e.sample_id, e.dst AS node_id, 'parent' AS role, e.src AS other_id FROM lineage_edges e JOIN asked a ON a.node_id=e.dst
  UNION ALL SELECT e.sample_id, e.src, 'child', e.dst FROM lineage_edges e JOIN asked a ON a.node_id=e.src)
SELECT o.sample_id, o.node_id, o.role, o.other_id, n.t AS other_t, n.node_id IS NOT NULL AS resolved
FROM o LEFT JOIN (SELECT * FROM lineage WHERE t<60) n ON n.node_id=o.other_id""")
def _(v):
    wanted = graph.find_divisions(v.lineage_edges).select("sample_id", F.col("parent_node_id").alias("node_id"))
    return graph.neighbours(v.lineage.where("t < 60"), v.lineage_edges, wanted).drop("other_y", "other_x")


@query("trail", """
SELECT sample_id, track_id, count(*) AS n, round(sum(y),6) AS sum_y, min(t) AS first_t, max(t) AS last_t
FROM lineage WHERE t BETWEEN 43 AND 48 GROUP BY 1, 2""")
def _(v):
    path = F.col("path")
    return lineage.trail(v.lineage, 48, 5).select(
        "sample_id", "track_id", F.size(path).cast("bigint").alias("n"),
        r6(F.aggregate(path, F.lit(0.0), lambda a, p: a + p["y"])).alias("sum_y"),
        path[0]["t"].alias("first_t"), F.element_at(path, -1)["t"].alias("last_t"))


@query("limit_frames", """
SELECT e.sample_id, e.src, e.dst FROM lineage_edges e JOIN lineage a ON a.node_id=e.src JOIN lineage b ON b.node_id=e.dst
WHERE a.t<40 AND b.t<40""")
def _(v):
    return lineage.limit_frames(v.lineage, v.lineage_edges, 40)[1]


@query("consecutive_only", """
SELECT e.sample_id, e.src, e.dst FROM (SELECT sample_id, src, dst FROM lineage_edges
  UNION ALL SELECT sample_id, parent_track_id*16+8, track_id*16 FROM forest WHERE parent_track_id IS NOT NULL
  UNION ALL SELECT sample_id, track_id*16+9, -1 FROM forest) e
JOIN lineage a ON a.node_id=e.src JOIN lineage b ON b.node_id=e.dst WHERE b.t=a.t+1""")
def _(v):
    skip = v.forest.where("parent_track_id IS NOT NULL").select(
        "sample_id", (F.col("parent_track_id") * 16 + 8).alias("src"), (F.col("track_id") * 16).alias("dst"))
    lost = v.forest.select("sample_id", (F.col("track_id") * 16 + 9).alias("src"), F.lit(-1).cast("bigint").alias("dst"))
    return lineage.consecutive_only(graph.union_tables(v.lineage_edges, skip, lost), v.lineage)


@query("to_ctc_tracks", """
SELECT sample_id, track_id, start_t, end_t, coalesce(parent_track_id, 0) AS parent_track_id FROM forest""")
def _(v):
    return lineage.to_ctc_tracks(v.forest)


@query("calibrate", """
SELECT user_id, event_id, CASE WHEN known THEN px ELSE 1.0 END AS scale, CASE WHEN known THEN mins ELSE 1.0 END AS dt,
  CASE WHEN known THEN 'um/min' ELSE 'px/frame' END AS units
FROM (SELECT *, px IS NOT NULL AND mins IS NOT NULL AS known FROM
 (SELECT user_id, event_id, CASE WHEN value>20 THEN round(value/100,6) END AS px,
  CASE WHEN event_type<>'error' THEN 2.5::DOUBLE END AS mins FROM events))""")
def _(v):
    e = v.table("events").select("user_id", "event_id", F.when(F.col("value") > 20, r6(F.col("value") / 100)).alias("px"),
                                 F.when(F.col("event_type") != "error", F.lit(2.5)).alias("mins"))
    c = scalar.calibration("px", "mins")
    return e.select("user_id", "event_id", *[x.alias(n) for n, x in c.items()])
