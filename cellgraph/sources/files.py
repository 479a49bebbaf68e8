"""Readers and writers. Schemas are explicit, bad rows fail, existing output is never replaced."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import schemas


def write_once(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), **options) -> None:
    """Write to a new place; an existing one is an error."""
    writer = df.write.mode("errorifexists").format(fmt).options(**options)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def manifest_sink(df: DataFrame, path: str, partition_by: Sequence[str] = ("split", "label")) -> None:
    """Patches laid out by split and label; rows of one folder are gathered so that files stay large."""
    # the salt spreads a dominant folder over many writers
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    spread = df.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in df.columns if c != "pix"]), F.lit(max(1, tasks // 8))))
    write_once(spread.repartition(*partition_by, "_salt").drop("_salt"), path, partition_by=partition_by)


def write_tracks(table: DataFrame, path: str) -> None:
    """Track file as CSV, columns in their fixed order; the header is kept when there are no rows."""
    write_once(table.select(*schemas.TRACK_FILE.fieldNames()), path, "csv", header="true")


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Track file. Nullable ids may have been stored with a fraction (``3.0``), so they are read as numbers."""
    loose = T.StructType([T.StructField(f.name, T.DoubleType() if f.name.startswith("parent_") else f.dataType) for f in schemas.TRACK_FILE])
    raw = spark.read.schema(loose).option("header", "true").option("enforceSchema", "false").option("mode", "FAILFAST").csv(path)
    return raw.select(*[F.col(f.name).cast(f.dataType) for f in schemas.TRACK_FILE])


def require_columns(found: Iterable[str], required: Iterable[str], where: str) -> None:
    missing = sorted(set(required) - set(found))
    if missing:
        raise ValueError(f"{where} lacks required column(s): {missing}; found {sorted(found)}")


def read_checked(spark: SparkSession, path: str, schema: T.StructType, required: Sequence[str] | None = None) -> DataFrame:
    """CSV whose header must hold the required columns; extra ones are ignored, bad values fail."""
    header = spark.read.option("header", "true").csv(path).columns  # reads the header line only
    require_columns(header, required or schema.fieldNames(), path)
    known = {f.name: f for f in schema}
    full = T.StructType([known.get(c, T.StructField(c, T.StringType())) for c in header])
    raw = spark.read.schema(full).option("header", "true").option("enforceSchema", "false").option("mode", "FAILFAST").csv(path)
    return raw.select(*[c for c in schema.fieldNames() if c in header])


def read_ctc_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Four integers per line, any white space between; blank lines skipped, another count is an error."""
    parts = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    lines = spark.read.text(path).where(F.length(F.trim(F.regexp_replace("value", r"\s+", " "))) > 0).select(
        F.when(F.size(parts) == 4, parts).otherwise(F.raise_error(F.concat(F.lit("expected 4 numbers: "), F.col("value"))).cast("array<string>")).alias("p"))
    return lines.select(*[F.col("p")[i].cast("int").alias(f.name) for i, f in enumerate(schemas.CTC_TRACKS)])


_SPOTS = "_frame int, Spot array<struct<_ID:bigint,_POSITION_Y:double,_POSITION_X:double>>"
_LINKS = "_SPOT_SOURCE_ID bigint, _SPOT_TARGET_ID bigint"


def read_trackmate_xml(spark: SparkSession, path: str, sample_id: str = "xml") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a tracking export, with the built-in XML source; files are split by row tag."""
    xml = lambda tag, ddl: spark.read.format("xml").option("rowTag", tag).option("mode", "FAILFAST").schema(ddl).load(path)
    spots = xml("SpotsInFrame", _SPOTS).select(F.col("_frame").alias("t"), F.explode("Spot").alias("s"))
    nodes = spots.select(F.lit(sample_id).alias("sample_id"), F.col("s._ID").alias("node_id"), "t",
                         F.col("s._POSITION_Y").alias("y"), F.col("s._POSITION_X").alias("x"))
    edges = xml("Edge", _LINKS).select(
        F.lit(sample_id).alias("sample_id"), F.col("_SPOT_SOURCE_ID").alias("src"), F.col("_SPOT_TARGET_ID").alias("dst"))
    return nodes, edges


def explode_geff(geff: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge rows of graphs stored as parallel arrays; unequal lengths are an error."""
    same = (F.size("ids") == F.size("t")) & (F.size("ids") == F.size("y")) & (F.size("ids") == F.size("x"))
    zipped = F.when(same, F.arrays_zip("ids", "t", "y", "x")).otherwise(
        F.raise_error(F.concat(F.lit("array lengths differ in "), F.col("sample_id"))))
    nodes = geff.select("sample_id", F.explode(zipped).alias("n")).select(
        "sample_id", F.col("n.ids").alias("node_id"), F.col("n.t").alias("t"), F.col("n.y").alias("y"), F.col("n.x").alias("x"))
    edges = geff.select("sample_id", F.explode("edges").alias("e")).select("sample_id", "e.src", "e.dst")
    return nodes, edges


def gt_coordinates(geff: DataFrame) -> DataFrame:
    """Every node, copies included."""
    nodes, _ = explode_geff(geff)
    return nodes.select("sample_id", F.col("t").alias("frame_idx"), F.col("y").alias("gt_y"), F.col("x").alias("gt_x"))


def mask_centroids(pixels: DataFrame) -> DataFrame:
    """Centroid of every label in every frame; label 0 is background. Node id is ``label_t``."""
    return pixels.where("label <> 0").groupBy("sample_id", "t", "label").agg(F.avg("y").alias("y"), F.avg("x").alias("x")).withColumn(
        "node_id", F.concat_ws("_", F.col("label").cast("string"), F.col("t").cast("string")))


def ctc_edges(nodes: DataFrame, tracks: DataFrame) -> DataFrame:
    """Edges between consecutive present frames of a label, and from a parent's last node to a child's first.

    ``nodes``: sample_id, label, t, node_id; ``tracks``: sample_id, track_id, parent_track_id (0 = none).
    """
    from pyspark.sql import Window as W

    nxt = F.lead("node_id").over(W.partitionBy("sample_id", "label").orderBy("t"))
    inside = nodes.select("sample_id", F.col("node_id").alias("src"), nxt.alias("dst")).where("dst IS NOT NULL")
    ends = nodes.groupBy("sample_id", "label").agg(F.min_by("node_id", "t").alias("first"), F.max_by("node_id", "t").alias("last"))
    born = tracks.where("parent_track_id <> 0").select("sample_id", F.col("track_id").alias("label"), F.col("parent_track_id").alias("up"))
    first = born.join(ends.select("sample_id", "label", "first"), ["sample_id", "label"])
    last = ends.select("sample_id", F.col("label").alias("up"), "last")
    across = first.join(last, ["sample_id", "up"]).select("sample_id", F.col("last").alias("src"), F.col("first").alias("dst"))
    return inside.unionByName(across)


def submission(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node rows with their parent (-1 if none) and z = 0. If a target repeats, the edge listed last wins.

    ``edges`` may carry ``ord``, the list position; without it the greatest source wins.
    """
    order = "ord" if "ord" in edges.columns else "src"
    up = edges.groupBy("sample_id", F.col("dst").alias("node_id")).agg(F.max_by("src", order).alias("parent"))
    return nodes.join(up, ["sample_id", "node_id"], "left").select(
        "sample_id", "node_id", "t", F.lit(0).alias("z"), "y", "x", F.coalesce("parent", F.lit(-1)).alias("parent_id"))


def list_samples(df: DataFrame, limit: int | None = None) -> DataFrame:
    ids = df.select("sample_id").distinct().orderBy("sample_id")
    return ids.limit(limit) if limit is not None else ids


def run_summary(nodes: DataFrame, stats: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    """One record: number of frames, headline numbers, and scores when there are any."""
    frames = nodes.agg(F.coalesce(F.max("t") + 1, F.lit(0)).alias("n_frames"))
    out = stats.join(F.broadcast(frames))  # one row each
    return out.join(F.broadcast(scores)) if scores is not None else out


def write_summary(summary: DataFrame, path: str) -> None:
    write_once(summary.coalesce(1), path, "json")  # a single record
