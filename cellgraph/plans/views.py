"""Domain tables derived from the given Parquet tables, as DataFrames and as matching SQL text.

Every view exists twice: ``Views.<name>`` for Spark and ``SQL[<name>]`` for the checking
engine. ``with_views`` prefixes a query with the common table expressions it needs.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import broadcast_by_measured_size

SQL = {
    # detections: the sample is the event kind, the frame is the day
    "det": """SELECT event_type AS sample_id, CAST(day(ts)-1 AS INT) AS t, event_id AS det_id, value AS y,
        CAST(regexp_extract(props,'([0-9]+)',1) AS DOUBLE) AS x FROM events""",
    # sparse ground truth: only the field of view left of x = 86 is annotated; at most 1 px off
    "gt": """SELECT sample_id, t, det_id AS gt_id, y+((det_id%5)-2)*0.5 AS y, x+((det_id%3)-1)*0.5 AS x
        FROM det WHERE x < 86""",
    # classifier output
    "pred": """SELECT d.doc_id, d.lang AS sample_id, d.source AS split_key, l.quality AS label,
        ((d.doc_id*7919+l.quality*211)%1000)/1000.0::DOUBLE AS probability, CAST(d.n_chars AS DOUBLE) AS contrast
        FROM documents d JOIN labels l ON d.doc_id=l.doc_id""",
    # binary forest of tracks with three roots; one sample per tree
    "forest": """SELECT CASE WHEN k=1 THEN 'f1' ELSE 'f' || CAST(CAST(floor(k/pow(2,lv-1)) AS INT) AS VARCHAR) END
        AS sample_id, k AS track_id,
        CASE WHEN k<4 THEN NULL ELSE CAST(floor(k/2) AS BIGINT) END AS parent_track_id,
        CAST(lv*10 AS INT) AS start_t, CAST(lv*10+9 AS INT) AS end_t
        FROM (SELECT p_partkey+1 AS k, floor(ln(p_partkey+1)/ln(2)+1e-9) AS lv FROM part)""",
    # nodes of that forest: ten per track, the first hangs on the last node of the parent track
    "lineage": """SELECT sample_id, track_id*16+(t-start_t) AS node_id, CAST(t AS INT) AS t,
        track_id%97+(t-start_t)*((track_id%5)+1)*0.5::DOUBLE AS y, track_id%89+((t*t)%7)*0.25::DOUBLE AS x, track_id,
        CASE WHEN t>start_t THEN track_id*16+(t-start_t)-1 WHEN parent_track_id IS NOT NULL
             THEN parent_track_id*16+9 END AS parent_node_id, parent_track_id
        FROM (SELECT *, unnest(range(start_t, end_t+1)) AS t FROM forest)""",
    "lineage_edges": "SELECT sample_id, parent_node_id AS src, node_id AS dst FROM lineage WHERE parent_node_id IS NOT NULL",
    # one row per dividing node
    "divs": """SELECT sample_id, src AS parent_node_id, CAST(floor(src/16) AS BIGINT) AS parent_track_id,
        min(dst) AS child_a, max(dst) AS child_b, CAST(floor(min(dst)/16) AS BIGINT) AS track_a,
        CAST(floor(max(dst)/16) AS BIGINT) AS track_b
        FROM lineage_edges GROUP BY sample_id, src HAVING count(DISTINCT dst)=2""",
    # cells 40 px apart drifting 1 px per frame: the best assignment is the identity
    "cells": """SELECT 'g' AS sample_id, f.t AS t, p_partkey AS cell, 40.0::DOUBLE*floor(p_partkey/10)+f.t AS y,
        40.0::DOUBLE*(p_partkey%10)+f.t AS x
        FROM part CROSS JOIN (VALUES (0),(1),(2),(3),(4),(5)) AS f(t)""",
    "runs": """SELECT o_orderkey AS run_id, o_custkey AS experiment_id,
        CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'processing' ELSE 'error' END AS status,
        o_orderdate AS started_at FROM orders""",
    "timeline": "SELECT event_id, user_id AS experiment_id, event_type, ts AS created_at FROM events",
    # candidates with their nearest ground truth (the labelled manifest)
    "manifest": """SELECT sample_id, t, det_id, y, x, gt_id, gt_y, gt_x, distance,
        CASE WHEN distance<=5 THEN 'positive' WHEN distance>10 THEN 'negative' ELSE 'ambiguous' END AS label,
        CASE sample_id WHEN 'click' THEN 'test' WHEN 'error' THEN 'val' ELSE 'train' END AS split
        FROM (SELECT d.sample_id, d.t, d.det_id, d.y, d.x, g.gt_id, g.y AS gt_y, g.x AS gt_x,
              sqrt((d.y-g.y)*(d.y-g.y)+(d.x-g.x)*(d.x-g.x)) AS distance,
              row_number() OVER (PARTITION BY d.det_id
                ORDER BY sqrt((d.y-g.y)*(d.y-g.y)+(d.x-g.x)*(d.x-g.x)), g.gt_id) AS rn
              FROM det d JOIN gt g ON d.sample_id=g.sample_id AND d.t=g.t) WHERE rn=1""",
    # candidates with the ground truth found inside their box
    "boxes": """SELECT m.sample_id, m.t, m.det_id, any_value(m.label) AS label, any_value(m.split) AS split,
        any_value(m.distance) AS distance,
        CAST(count(g.gt_id) AS BIGINT) AS n_inside, min(g.dist) AS nearest_inside,
        min(CASE WHEN g.rn=2 THEN g.dist END) AS second_inside,
        min(CASE WHEN g.rn=1 THEN g.gy-(m.y-16) END) AS local_y, min(CASE WHEN g.rn=1 THEN g.gx-(m.x-16) END) AS local_x
        FROM manifest m LEFT JOIN
          (SELECT d.det_id, gg.gt_id, gg.y AS gy, gg.x AS gx,
             sqrt((d.y-gg.y)*(d.y-gg.y)+(d.x-gg.x)*(d.x-gg.x)) AS dist,
             row_number() OVER (PARTITION BY d.det_id ORDER BY
               sqrt((d.y-gg.y)*(d.y-gg.y)+(d.x-gg.x)*(d.x-gg.x)), gg.gt_id) AS rn
           FROM det d JOIN gt gg ON d.sample_id=gg.sample_id AND d.t=gg.t
             AND gg.y>=d.y-16 AND gg.y<d.y+16 AND gg.x>=d.x-16 AND gg.x<d.x+16) g
        ON m.det_id=g.det_id GROUP BY m.sample_id, m.t, m.det_id""",
    # 8x8 patches: long form, one row per pixel
    "pixels": """SELECT CAST(label AS VARCHAR) AS sample_id, vec_id, CAST(floor(i/8) AS INT) AS y,
        CAST(i%8 AS INT) AS x, CAST(v AS DOUBLE) AS v
        FROM (SELECT label, vec_id, unnest(embedding) AS v, unnest(range(0,64)) AS i FROM embeddings)""",
}


def _needs(text: str) -> list[str]:
    """Views a query mentions, dependencies first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for other in SQL:
            if other != name and re.search(rf"\b(?:FROM|JOIN)\s+{other}\b", SQL[name]):
                visit(other)
        if name not in ordered:
            ordered.append(name)

    for name in SQL:
        if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
            visit(name)
    return ordered


def with_views(text: str) -> str:
    names = _needs(text)
    body = text.strip()
    if not names:
        return body
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({SQL[n]})" for n in names)
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


TRACKS_PER_TASK = 100_000  # a track has ten nodes


class Views:
    """Lazy DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        broadcast_by_measured_size(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def parts(self) -> DataFrame:
        """Keys of ``part``, spread over tasks by their number: one small file stands for many nodes and points."""
        keys = self.table("part").select("p_partkey")
        tasks = -(-keys.count() // TRACKS_PER_TASK)
        return keys.repartition(tasks, "p_partkey") if tasks > 1 else keys

    @cached_property
    def det(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_type").alias("sample_id"),
            (F.dayofmonth("ts") - 1).cast("int").alias("t"),
            F.col("event_id").alias("det_id"),
            F.col("value").alias("y"),
            F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("x"),
        )

    @cached_property
    def gt(self) -> DataFrame:
        return self.det.where("x < 86").select(
            "sample_id", "t", F.col("det_id").alias("gt_id"),
            (F.col("y") + (F.col("det_id") % 5 - 2) * F.lit(0.5)).alias("y"),
            (F.col("x") + (F.col("det_id") % 3 - 1) * F.lit(0.5)).alias("x"),
        )

    @cached_property
    def pred(self) -> DataFrame:
        docs = self.table("documents").select("doc_id", "lang", "source", "n_chars")
        labels = self.table("labels").select("doc_id", "quality")
        return docs.join(labels, "doc_id").select(
            "doc_id", F.col("lang").alias("sample_id"), F.col("source").alias("split_key"),
            F.col("quality").alias("label"),
            (((F.col("doc_id") * 7919 + F.col("quality") * 211) % 1000) / F.lit(1000.0)).alias("probability"),
            F.col("n_chars").cast("double").alias("contrast"),
        )

    @cached_property
    def forest(self) -> DataFrame:
        k = F.col("p_partkey") + 1
        level = F.floor(F.ln(k) / F.ln(F.lit(2.0)) + F.lit(1e-9))
        return self.parts.select(k.alias("k"), level.alias("lv")).select(
            F.when(F.col("k") == 1, F.lit("f1"))
            .otherwise(F.concat(F.lit("f"), F.floor(F.col("k") / F.pow(F.lit(2.0), F.col("lv") - 1)).cast("string")))
            .alias("sample_id"),
            F.col("k").alias("track_id"),
            F.when(F.col("k") >= 4, F.floor(F.col("k") / 2).cast("bigint")).alias("parent_track_id"),
            (F.col("lv") * 10).cast("int").alias("start_t"),
            (F.col("lv") * 10 + 9).cast("int").alias("end_t"),
        )

    @cached_property
    def lineage(self) -> DataFrame:
        step = F.col("t") - F.col("start_t")
        node = F.col("track_id") * 16 + step
        return self.forest.withColumn("t", F.explode(F.sequence("start_t", "end_t"))).select(
            "sample_id", node.alias("node_id"), "t",
            (F.col("track_id") % 97 + step * (F.col("track_id") % 5 + 1) * F.lit(0.5)).alias("y"),
            (F.col("track_id") % 89 + (F.col("t") * F.col("t")) % 7 * F.lit(0.25)).alias("x"),
            "track_id",
            F.when(step > 0, node - 1)
            .when(F.col("parent_track_id").isNotNull(), F.col("parent_track_id") * 16 + 9).alias("parent_node_id"),
            "parent_track_id",
        )

    @cached_property
    def lineage_edges(self) -> DataFrame:
        return self.lineage.where("parent_node_id IS NOT NULL").select(
            "sample_id", F.col("parent_node_id").alias("src"), F.col("node_id").alias("dst"))

    @cached_property
    def cells(self) -> DataFrame:
        row, column = F.floor(F.col("p_partkey") / 10), F.col("p_partkey") % 10
        return self.parts.select(
            F.lit("g").alias("sample_id"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("t"),
            F.col("p_partkey").alias("cell"), row.alias("r"), column.alias("c"),
        ).select("sample_id", "t", "cell", (F.lit(40.0) * F.col("r") + F.col("t")).alias("y"),
                 (F.lit(40.0) * F.col("c") + F.col("t")).alias("x"))

    @cached_property
    def runs(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("experiment_id"),
            F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "processing")
            .otherwise("error").alias("status"),
            F.col("o_orderdate").alias("started_at"))

    @cached_property
    def timeline(self) -> DataFrame:
        return self.table("events").select(
            "event_id", F.col("user_id").alias("experiment_id"), "event_type", F.col("ts").alias("created_at"))

    @cached_property
    def manifest(self) -> DataFrame:
        from ..functions.scalar import label_by_distance
        from ..operators.spatial import nearest_in_frame

        near = nearest_in_frame(self.det, self.gt, key="det_id")
        return near.where("gt_id IS NOT NULL").select(
            "sample_id", "t", "det_id", "y", "x", "gt_id", "gt_y", "gt_x", "distance",
            label_by_distance("distance").alias("label"),
            F.when(F.col("sample_id") == "click", "test").when(F.col("sample_id") == "error", "val")
            .otherwise("train").alias("split"))

    @cached_property
    def boxes(self) -> DataFrame:
        from ..operators.spatial import gt_in_patch

        return gt_in_patch(self.manifest, self.gt, key="det_id", carry=["label", "split", "distance"])

    @cached_property
    def patches(self) -> DataFrame:
        return self.table("embeddings").select(
            F.col("label").cast("string").alias("sample_id"), "vec_id", F.col("embedding").alias("pix"))

    @cached_property
    def pixels(self) -> DataFrame:
        return self.patches.select("sample_id", "vec_id", F.posexplode("pix").alias("i", "v")).select(
            "sample_id", "vec_id", F.floor(F.col("i") / 8).cast("int").alias("y"),
            (F.col("i") % 8).cast("int").alias("x"), F.col("v").cast("double").alias("v"))
