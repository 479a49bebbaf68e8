"""Run records as append-only change logs, and the reads over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import micros

# Fixed values.
FIELDS = ("gaussian_sigma", "detection_threshold", "cell_radius", "tracking_max_distance", "division_max_distance",
          "pixel_size_um", "frame_interval_min")
FINISHED = ("done", "error")
RUNNING = ("queued", "processing")
DELETED_NAME = "(deleted experiment)"
DEFAULTS_NAME = "Defaults"


def current_state(log: DataFrame, key: str, ts: str = "changed_at", deleted: str = "deleted", tie: str | None = None) -> DataFrame:
    """Last write per key; created_at is the first change, updated_at the last; deleted keys vanish.

    Grouping keeps one row per key on the map side, so a key with a long history is no hot spot.
    """
    order = F.struct(ts, tie) if tie else F.col(ts)
    rest = [c for c in log.columns if c not in (key, ts)]
    g = log.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r"), F.min(ts).alias("created_at"), F.max(ts).alias("updated_at"))
    return g.where(~F.col(f"_r.{deleted}")).select(
        key, *[F.col(f"_r.{c}").alias(c) for c in rest if c != deleted], "created_at", "updated_at")


def latest_per(log: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(ts, tie)).alias("_r")).select(key, "_r.*")


def run_status(changes: DataFrame) -> DataFrame:
    """Per run: last status, start, end (only when finished), seconds taken, and whether the record is consistent."""
    done = F.col("status").isin(*FINISHED)
    g = changes.groupBy("run_id").agg(
        F.max_by("status", F.struct("changed_at", "seq")).alias("status"), F.min("changed_at").alias("started_at"),
        F.min(F.when(done, F.col("changed_at"))).alias("_end"))
    finished = F.col("status").isin(*FINISHED)
    end = F.when(finished, F.col("_end"))
    return g.select("run_id", "status", "started_at", end.alias("finished_at"),
                    ((micros(end) - micros("started_at")) / F.lit(1e6)).alias("seconds"),
                    (finished | F.col("_end").isNull()).alias("consistent"))


def configuration_of_run(runs: DataFrame, configs: DataFrame) -> DataFrame:
    named = configs.withColumnRenamed("name", "_name")
    return runs.join(named, "config_id", "left").withColumn("config_name", F.coalesce("_name", F.lit(DEFAULTS_NAME))).drop("_name")


def resolve_parameters(configs: DataFrame, defaults: dict[str, float | None]) -> DataFrame:
    """Each field of the configuration, or the default where it is missing."""
    def pick(name: str) -> Column:
        value = defaults.get(name)
        return F.coalesce(F.col(name), F.lit(value).cast("double")).alias(name)

    return configs.select(*[pick(c) if c in defaults else F.col(c) for c in configs.columns])


def orphans(log: DataFrame, parents: DataFrame, key: str = "experiment_id") -> DataFrame:
    return log.join(parents.select(key), key, "left_anti")


def latest_with_name(log: DataFrame, experiments: DataFrame, n: int, ts: str = "created_at", tie: str = "event_id") -> DataFrame:
    """Newest n records, then their experiment's name; the limit runs before the join."""
    top = log.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)
    names = experiments.select("experiment_id", F.col("name").alias("_n"))
    return top.join(names, "experiment_id", "left").withColumn("experiment_name", F.coalesce("_n", F.lit(DELETED_NAME))).drop("_n")


def recent_events(log: DataFrame, n: int = 10) -> DataFrame:
    return log.orderBy(F.col("created_at").desc(), F.col("event_id").desc()).limit(n)


def timeline(log: DataFrame, experiment) -> DataFrame:
    """One experiment's events, oldest first; the filter reaches the scan."""
    return log.where(F.col("experiment_id") == experiment).orderBy("created_at", "event_id")


def undeletable_configs(experiments: DataFrame) -> DataFrame:
    return experiments.where(F.col("config_id").isNotNull()).groupBy("config_id").agg(F.count(F.lit(1)).alias("n_uses"))


def single_default(configs: DataFrame) -> DataFrame:
    """Keep the newest default flag only; ``n_flagged`` tells how many rows claimed it."""
    flagged = configs.where("is_default").agg(
        F.max_by("config_id", F.struct("created_at", "config_id")).alias("_keep"), F.count(F.lit(1)).alias("n_flagged"))
    return configs.join(F.broadcast(flagged)).withColumn(  # one row
        "is_default", F.coalesce(F.col("config_id") == F.col("_keep"), F.lit(False))).drop("_keep")


def unknown_fields(log: DataFrame, fields: str = "fields", allowed: Sequence[str] = FIELDS) -> DataFrame:
    """Keys of a change that are not settings: (change_id, field)."""
    return log.select("change_id", F.explode(F.map_keys(fields)).alias("field")).where(~F.col("field").isin(*allowed))


def experiment_cards(experiments: DataFrame, datasets: DataFrame, stats: DataFrame, reports: DataFrame) -> DataFrame:
    """One row per experiment; statistics stay NULL, not 0, without a result."""
    n = reports.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("_n"))
    return (experiments.join(datasets.select("dataset_id", "filename"), "dataset_id", "left").join(stats, "experiment_id", "left")
            .join(n, "experiment_id", "left").withColumn("n_reports", F.coalesce("_n", F.lit(0)).cast("bigint")).drop("_n"))


def dashboard_totals(experiments: DataFrame, stats: DataFrame, reports: DataFrame) -> DataFrame:
    """Headline counts; unfinished experiments add no cells or divisions. Each input is reduced on its own."""
    head = experiments.agg(
        F.count(F.lit(1)).alias("n_experiments"), F.count_if(F.col("status") == "done").alias("n_done"),
        F.count_if(F.col("status").isin(*RUNNING)).alias("n_running"))
    done = stats.join(experiments.where("status = 'done'").select("experiment_id"), "experiment_id", "left_semi").agg(
        F.coalesce(F.sum("n_cells"), F.lit(0)).alias("n_cells"), F.coalesce(F.sum("n_divisions"), F.lit(0)).alias("n_divisions"))
    return head.join(F.broadcast(done)).join(F.broadcast(reports.agg(F.count(F.lit(1)).alias("n_reports"))))  # one row each


def method_vs_baseline(bench: DataFrame, metric: str, ts: str = "created_at", tie: str = "bench_id") -> DataFrame:
    """Per dataset: newest own against newest baseline result, the difference, and a verdict."""
    newest = bench.groupBy("dataset", "is_baseline").agg(F.max_by(F.struct("method", metric, ts), F.struct(ts, tie)).alias("r"))
    pick = lambda flag, c: F.max(F.when(F.col("is_baseline") == flag, F.col(f"r.{c}")))
    g = newest.groupBy("dataset").agg(
        pick(False, "method").alias("own_method"), pick(False, metric).alias("own"), pick(True, "method").alias("baseline_method"),
        pick(True, metric).alias("baseline"), F.max(F.col(f"r.{ts}")).alias("newest"))
    d = F.col("own") - F.col("baseline")
    return g.withColumn("delta", d).withColumn("verdict", F.when(d > 0, "ahead").when(d < 0, "behind").when(d == 0, "tied"))


def cascade_delete(gone: DataFrame, experiments: DataFrame, reports: DataFrame, events: DataFrame, runs: DataFrame,
                   key: str = "experiment_id") -> dict[str, DataFrame]:
    """What stays of the four dependent tables; datasets and configurations are never touched."""
    ids = gone.select(key).distinct()
    tables = {"experiments": experiments, "reports": reports, "events": events, "runs": runs}
    return {name: df.join(ids, key, "left_anti") for name, df in tables.items()}


def fingerprint(names: DataFrame, ordinal: str, name: str, limit: int = 1_000_000) -> DataFrame:
    """SHA-256 of the count and the ordered names, newline-separated.

    One hash over one text cannot be split, so the list is bounded: beyond ``limit`` names it is refused.
    """
    n = names.limit(limit + 1).count()
    if n > limit:
        raise ValueError(f"a fingerprint covers at most {limit} names")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(ordinal, name))), lambda s: s[name])
    return names.agg(F.sha2(F.concat_ws("\n", F.lit(str(n)), ordered), 256).alias("fingerprint"), F.count(F.lit(1)).alias("n"))
