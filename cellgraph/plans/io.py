"""Source and sink queries. Files are written from the given tables into the checkpoint folder and read back."""

import uuid

from pyspark.sql import functions as F

from ..operators import lineage, motion
from ..schemas import MANIFEST, SPLIT
from ..session import ensure_checkpoint_dir
from ..sources import files as S
from .catalog import query, r6

RECORDS_PER_FILE = 100_000


def _place(v) -> str:
    return f"{ensure_checkpoint_dir(v.spark)}/files-{uuid.uuid4().hex}"


@query("read_write_tracks", """SELECT n.node_id, n.t, round(n.y,6)+0.0 AS y, round(n.x,6)+0.0 AS x, n.track_id, n.parent_node_id, n.parent_track_id,
 d.parent_node_id IS NOT NULL AS is_division_parent FROM lineage n LEFT JOIN divs d ON d.parent_node_id=n.node_id""")
def _(v):
    place = _place(v)
    S.write_tracks(lineage.flag_division_parents(v.lineage.drop("parent_track_id"), lineage.divisions(v.lineage), v.forest), place)
    return S.read_tracks(v.spark, place).withColumn("y", r6("y")).withColumn("x", r6("x"))


@query("read_ctc_tracks", """SELECT CAST(track_id AS INT) AS track_id, start_t, end_t, CAST(coalesce(parent_track_id,0) AS INT) AS parent_track_id FROM forest""")
def _(v):
    place = _place(v)
    line = F.concat_ws("  ", *[F.col(c).cast("string") for c in ("track_id", "start_t", "end_t", "parent_track_id")])
    lineage.to_ctc_tracks(v.forest).select(F.concat(line, F.when(F.col("track_id") == 5, F.lit("\n\n")).otherwise(F.lit(""))).alias("value")).write.text(place)
    return S.read_ctc_tracks(v.spark, place)


def _xml(v):
    place = _place(v)
    spot = F.array(F.struct(F.col("node_id").alias("_ID"), F.col("y").alias("_POSITION_Y"), F.col("x").alias("_POSITION_X")))
    for tag, df in (("SpotsInFrame", v.lineage.select(F.col("t").alias("_frame"), spot.alias("Spot"))),
                    ("Edge", v.lineage_edges.select(F.col("src").alias("_SPOT_SOURCE_ID"), F.col("dst").alias("_SPOT_TARGET_ID")))):
        df.write.format("xml").option("rootTag", "Model").option("rowTag", tag).option(
            "maxRecordsPerFile", RECORDS_PER_FILE).save(f"{place}/{tag}")  # one task reads a whole export
    return S.read_trackmate_xml(v.spark, f"{place}/*")


@query("read_trackmate_nodes", "SELECT node_id, t, round(y,6)+0.0 AS y, round(x,6)+0.0 AS x FROM lineage")
def _(v):
    return _xml(v)[0].select("node_id", "t", r6("y").alias("y"), r6("x").alias("x"))


@query("read_trackmate_edges", "SELECT src, dst FROM lineage_edges")
def _(v):
    return _xml(v)[1].select("src", "dst")


def _geff(v):
    """One small graph per track, so that no array grows with the data."""
    n = v.lineage.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "t", "y", "x"))).alias("n"),
                                          F.array_compact(F.collect_list(F.when(F.col("parent_node_id").isNotNull(), F.struct(
                                              F.col("parent_node_id").alias("src"), F.col("node_id").alias("dst"))))).alias("edges"))
    return n.select(F.concat(F.lit("k"), F.col("track_id").cast("string")).alias("sample_id"), F.col("n.node_id").alias("ids"), "n.t", "n.y", "n.x", "edges")


@query("explode_geff_nodes", "SELECT 'k' || track_id AS sample_id, node_id, t, round(y,6)+0.0 AS y, round(x,6)+0.0 AS x FROM lineage")
def _(v):
    return S.explode_geff(_geff(v))[0].withColumn("y", r6("y")).withColumn("x", r6("x"))


@query("explode_geff_edges", "SELECT 'k' || track_id AS sample_id, parent_node_id AS src, node_id AS dst FROM lineage WHERE parent_node_id IS NOT NULL")
def _(v):
    return S.explode_geff(_geff(v))[1]


@query("gt_coordinates", "SELECT 'k' || track_id AS sample_id, t AS frame_idx, round(y,6)+0.0 AS gt_y, round(x,6)+0.0 AS gt_x FROM lineage")
def _(v):
    return S.gt_coordinates(_geff(v)).withColumn("gt_y", r6("gt_y")).withColumn("gt_x", r6("gt_x"))


@query("mask_centroids", """SELECT sample_id, vec_id AS t, label, round(avg(y),6) AS y, round(avg(x),6) AS x, label || '_' || vec_id AS node_id
FROM (SELECT *, CASE WHEN v>0.1 THEN 2 WHEN v>0 THEN 1 ELSE 0 END AS label FROM pixels) WHERE label<>0 GROUP BY 1,2,3""")
def _(v):
    px = v.pixels.withColumnRenamed("vec_id", "t").withColumn("label", F.when(F.col("v") > 0.1, 2).when(F.col("v") > 0, 1).otherwise(0))
    return S.mask_centroids(px).withColumn("y", r6("y")).withColumn("x", r6("x"))


@query("ctc_edges", """WITH n AS (SELECT sample_id, track_id AS label, t+t//5 AS t, node_id FROM lineage),
 e AS (SELECT sample_id, label, min(node_id) AS first, max(node_id) AS last FROM n GROUP BY 1,2)
SELECT sample_id, src, dst FROM (SELECT sample_id, node_id AS src, lead(node_id) OVER (PARTITION BY sample_id, label ORDER BY t) AS dst FROM n) WHERE dst IS NOT NULL
UNION ALL SELECT f.sample_id, p.last, c.first FROM forest f JOIN e c ON c.label=f.track_id JOIN e p ON p.label=f.parent_track_id""")
def _(v):
    # a frame is left out after every fifth
    nodes = v.lineage.select("sample_id", F.col("track_id").alias("label"), F.expr("t + t DIV 5").alias("t"), "node_id")
    return S.ctc_edges(nodes, lineage.to_ctc_tracks(v.forest))


@query("read_checked_split", "SELECT DISTINCT sample_id, CASE sample_id WHEN 'click' THEN 'test' WHEN 'error' THEN 'val' ELSE 'train' END AS split FROM det")
def _(v):
    place = _place(v)
    split = F.when(F.col("sample_id") == "click", "test").when(F.col("sample_id") == "error", "val").otherwise("train")
    S.write_once(v.det.select("sample_id").distinct().withColumn("split", split).withColumn("note", F.lit("x")), place, "csv", header="true")
    return S.read_checked(v.spark, place, SPLIT)


@query("manifest_sink", "SELECT split, label, count(*) AS n, CAST(sum(t) AS BIGINT) AS sum_frame FROM manifest GROUP BY 1,2")
def _(v):
    place = _place(v)
    S.manifest_sink(v.manifest.select("sample_id", F.col("t").alias("frame_idx"), "label", "split", "det_id"), place)
    back = v.spark.read.schema("sample_id string, frame_idx int, det_id bigint, split string, label string").parquet(place)
    return back.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("frame_idx").alias("sum_frame"))


@query("read_checked_manifest", """SELECT sample_id, t AS frame_idx, CAST(trunc(y) AS INT) AS candidate_y, CAST(trunc(x) AS INT) AS candidate_x,
 round(distance,6)+0.0 AS nearest_gt_distance_px, label, split FROM manifest""")
def _(v):
    place = _place(v)
    need = ["sample_id", "frame_idx", "candidate_y", "candidate_x", "nearest_gt_distance_px", "label", "split"]
    S.write_once(v.manifest.select("sample_id", F.col("t").alias("frame_idx"), F.col("y").cast("int").alias("candidate_y"),
                                   F.col("x").cast("int").alias("candidate_x"), F.col("distance").alias("nearest_gt_distance_px"), "label", "split"), place, "csv", header="true")
    return S.read_checked(v.spark, place, MANIFEST, need).withColumn("nearest_gt_distance_px", r6("nearest_gt_distance_px"))


@query("submission", """SELECT n.sample_id, n.node_id, n.t, 0 AS z, round(n.y,6)+0.0 AS y, round(n.x,6)+0.0 AS x, coalesce(e.src,-1) AS parent_id FROM lineage n LEFT JOIN
 (SELECT dst, arg_max(src, ord) AS src FROM (SELECT src, dst, 1 AS ord FROM lineage_edges UNION ALL SELECT src-16, dst, 2 FROM lineage_edges WHERE src>dst-9) GROUP BY 1) e ON e.dst=n.node_id""")
def _(v):
    e = v.lineage_edges.withColumn("ord", F.lit(1))
    again = v.lineage_edges.where("src > dst - 9").withColumn("src", F.col("src") - 16).withColumn("ord", F.lit(2))
    return S.submission(v.lineage, e.unionByName(again)).withColumn("y", r6("y")).withColumn("x", r6("x"))


@query("list_samples", "SELECT DISTINCT source AS sample_id FROM documents ORDER BY 1 LIMIT 5")
def _(v):
    return S.list_samples(v.table("documents").select(F.col("source").alias("sample_id")), 5)


@query("run_summary", """SELECT (SELECT max(t)+1 FROM lineage) AS n_frames, (SELECT count(*) FROM lineage) AS n_cells, (SELECT count(*) FROM forest) AS n_tracks,
 (SELECT count(*) FROM divs) AS n_divisions""")
def _(v):
    stats = motion.dataset_stats(v.lineage, v.forest, lineage.divisions(v.lineage), motion.node_speeds(v.lineage))
    place = _place(v)
    S.write_summary(S.run_summary(v.lineage, stats), place)
    return v.spark.read.schema("n_frames int, n_cells bigint, n_tracks bigint, n_divisions bigint").json(place)
