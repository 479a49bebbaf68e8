"""Explicit schemas. Nothing in the library infers one from data."""

from __future__ import annotations

from pyspark.sql import types as T

STRING, INT, LONG, DOUBLE, BOOL = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_FLOATS = T.ArrayType(T.FloatType())

NODES = _schema(sample_id=STRING, node_id=STRING, t=INT, y=DOUBLE, x=DOUBLE)
EDGES = _schema(sample_id=STRING, src=STRING, dst=STRING)
# column order of the track file is part of its format
TRACK_FILE = _schema(node_id=LONG, t=INT, y=DOUBLE, x=DOUBLE, track_id=LONG, parent_node_id=LONG,
                     parent_track_id=LONG, is_division_parent=BOOL)
CTC_TRACKS = _schema(track_id=INT, start_t=INT, end_t=INT, parent_track_id=INT)
FRAMES = _schema(sample_id=STRING, t=INT, height=INT, width=INT, pix=_FLOATS)
# fixed column names of the candidate manifest
MANIFEST = _schema(
    sample_id=STRING, frame_idx=INT, candidate_y=INT, candidate_x=INT, nearest_gt_y=DOUBLE, nearest_gt_x=DOUBLE,
    nearest_gt_distance_px=DOUBLE, label=STRING, split=STRING, patch_status=STRING, patch_path=STRING, sigma=DOUBLE,
    threshold_method=STRING, threshold_floor=DOUBLE, min_distance=INT, d_max_px=DOUBLE, patch_size=INT,
    detector_class=STRING, adaptive_detector_sha256=STRING, run_timestamp_utc=STRING)
SPLIT = _schema(sample_id=STRING, split=STRING)
EPOCHS = _schema(run=STRING, epoch=INT, train_loss=DOUBLE, train_accuracy=DOUBLE, val_loss=DOUBLE, val_accuracy=DOUBLE,
                 val_roc_auc=DOUBLE, val_pr_auc=DOUBLE, learning_rate=DOUBLE)
