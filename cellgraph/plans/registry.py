"""Registry queries: orders as runs, events as the activity log."""

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import digests, registry as K
from .catalog import query, r6

# experiments are customers
EXP = """ex AS (SELECT c_custkey AS experiment_id, c_name AS name, c_nationkey AS dataset_id, CASE WHEN c_acctbal>0 THEN c_nationkey%7 END AS config_id,
 CASE c_mktsegment WHEN 'BUILDING' THEN 'queued' WHEN 'MACHINERY' THEN 'processing' WHEN 'HOUSEHOLD' THEN 'error' ELSE 'done' END AS status FROM customer)"""


def _ex(v):
    seg = F.col("c_mktsegment")
    return v.table("customer").select(
        F.col("c_custkey").alias("experiment_id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("dataset_id"),
        F.when(F.col("c_acctbal") > 0, F.col("c_nationkey") % 7).alias("config_id"),
        F.when(seg == "BUILDING", "queued").when(seg == "MACHINERY", "processing").when(seg == "HOUSEHOLD", "error").otherwise("done").alias("status"))


LOG = """lg AS (SELECT user_id AS experiment_id, event_type AS status, value AS note, event_type='purchase' AND value>120 AS deleted, ts AS changed_at, event_id FROM events)"""


def _log(v):
    e = v.table("events")
    return e.select(F.col("user_id").alias("experiment_id"), F.col("event_type").alias("status"), F.col("value").alias("note"),
                    ((F.col("event_type") == "purchase") & (F.col("value") > 120)).alias("deleted"), F.col("ts").alias("changed_at"), "event_id")


@query("current_state", f"""WITH {LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY experiment_id ORDER BY changed_at DESC, event_id DESC) AS rn,
 min(changed_at) OVER (PARTITION BY experiment_id) AS created_at FROM lg)
SELECT experiment_id, status, note, event_id, epoch_us(created_at) AS created_us, epoch_us(changed_at) AS updated_us FROM r WHERE rn=1 AND NOT deleted""")
def _(v):
    out = K.current_state(_log(v), "experiment_id", tie="event_id")
    return out.select("experiment_id", "status", "note", "event_id", scalar.micros("created_at").alias("created_us"), scalar.micros("updated_at").alias("updated_us"))


CH = """ch AS (SELECT o_custkey AS run_id, o_orderkey AS seq, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'processing' ELSE 'error' END AS status, o_orderdate AS changed_at FROM orders)"""


@query("run_status", f"""WITH {CH}, g AS (SELECT run_id, arg_max(status, (changed_at, seq)) AS status, min(changed_at) AS s, min(CASE WHEN status IN ('done','error') THEN changed_at END) AS e FROM ch GROUP BY 1)
SELECT run_id, status, epoch_us(s) AS started_us, CASE WHEN status IN ('done','error') THEN epoch_us(e) END AS finished_us,
 CASE WHEN status IN ('done','error') THEN (epoch_us(e)-epoch_us(s))/1000000.0::DOUBLE END AS seconds, status IN ('done','error') OR e IS NULL AS consistent FROM g""")
def _(v):
    ch = v.runs.select(F.col("experiment_id").alias("run_id"), F.col("run_id").alias("seq"), "status", F.col("started_at").alias("changed_at"))
    return K.run_status(ch).select("run_id", "status", scalar.micros("started_at").alias("started_us"), scalar.micros("finished_at").alias("finished_us"), "seconds", "consistent")


CFG = """cf AS (SELECT s_suppkey AS config_id, s_name AS name, CASE WHEN s_acctbal>2000 THEN s_acctbal END AS detection_threshold, CASE WHEN s_nationkey>5 THEN s_nationkey*0.1::DOUBLE END AS gaussian_sigma,
 s_acctbal>5000 AS is_default, s_nationkey AS created_at FROM supplier)"""


def _cfg(v):
    return v.table("supplier").select(
        F.col("s_suppkey").alias("config_id"), F.col("s_name").alias("name"), F.when(F.col("s_acctbal") > 2000, F.col("s_acctbal")).alias("detection_threshold"),
        F.when(F.col("s_nationkey") > 5, F.col("s_nationkey") * F.lit(0.1)).alias("gaussian_sigma"), (F.col("s_acctbal") > 5000).alias("is_default"),
        F.col("s_nationkey").alias("created_at"))


@query("configuration_of_run", f"""WITH {CFG} SELECT o_orderkey AS run_id, coalesce(cf.name,'Defaults') AS config_name, cf.detection_threshold
FROM orders LEFT JOIN cf ON cf.config_id=o_custkey""")
def _(v):
    runs = v.table("orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("config_id"))
    return K.configuration_of_run(runs, _cfg(v)).select("run_id", "config_name", "detection_threshold")


@query("resolve_parameters", f"WITH {CFG} SELECT config_id, coalesce(detection_threshold,10.0) AS detection_threshold, round(coalesce(gaussian_sigma,1.0),6) AS gaussian_sigma FROM cf")
def _(v):
    out = K.resolve_parameters(_cfg(v), {"detection_threshold": 10.0, "gaussian_sigma": 1.0})
    return out.select("config_id", "detection_threshold", r6("gaussian_sigma").alias("gaussian_sigma"))


@query("orphans", f"WITH {EXP} SELECT event_id, user_id AS experiment_id FROM events WHERE user_id NOT IN (SELECT experiment_id FROM ex WHERE status='done')")
def _(v):
    return K.orphans(v.timeline, _ex(v).where("status = 'done'")).select("event_id", "experiment_id")


@query("latest_with_name", f"""WITH {EXP} SELECT e.event_id, e.event_type, coalesce(x.name,'(deleted experiment)') AS experiment_name
FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 50) e LEFT JOIN ex x ON x.experiment_id=e.user_id AND x.status='done'""")
def _(v):
    return K.latest_with_name(v.timeline, _ex(v).where("status = 'done'"), 50).select("event_id", "event_type", "experiment_name")


@query("recent_events", "SELECT event_id, user_id AS experiment_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 10")
def _(v):
    return K.recent_events(v.timeline).drop("created_at")


@query("timeline", "SELECT event_id, event_type, epoch_us(ts) AS created_us FROM events WHERE user_id=42 ORDER BY ts, event_id")
def _(v):
    return K.timeline(v.timeline, 42).select("event_id", "event_type", scalar.micros("created_at").alias("created_us"))


@query("latest_per", """SELECT o_custkey AS experiment_id, o_orderkey AS report_id FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn=1""")
def _(v):
    return K.latest_per(v.runs, "experiment_id", "started_at", "run_id").select("experiment_id", F.col("run_id").alias("report_id"))


@query("undeletable_configs", f"WITH {EXP} SELECT config_id, count(*) AS n_uses FROM ex WHERE config_id IS NOT NULL GROUP BY 1")
def _(v):
    return K.undeletable_configs(_ex(v))


@query("single_default", f"""WITH {CFG} SELECT config_id, config_id=(SELECT config_id FROM cf WHERE is_default ORDER BY created_at DESC, config_id DESC LIMIT 1) AS is_default,
 (SELECT count(*) FROM cf WHERE is_default) AS n_flagged FROM cf""")
def _(v):
    return K.single_default(_cfg(v)).select("config_id", "is_default", "n_flagged")


_NAMES = "gaussian_sigma,detection_threshold,cell_radius,tracking_max_distance,division_max_distance,pixel_size_um,frame_interval_min,max_link_distance".split(",")


@query("unknown_fields", f"""SELECT l_orderkey*10+l_linenumber AS change_id, f AS field FROM (SELECT *, unnest([{_NAMES}[1+l_suppkey%8], l_returnflag, CASE WHEN l_linestatus='F' THEN 'Cell_radius' ELSE 'colour' END]) AS f FROM lineitem)
WHERE f NOT IN ({', '.join(f"'{n}'" for n in _NAMES[:-1])})""")
def _(v):
    first = F.get(F.array(*map(F.lit, _NAMES)), (F.col("l_suppkey") % 8).cast("int"))
    second = F.when(F.col("l_linestatus") == "F", "Cell_radius").otherwise("colour")
    changes = v.table("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("change_id"), F.create_map(
        first, F.lit("1"), F.col("l_returnflag"), F.lit("1"), second, F.lit("1")).alias("fields"))
    return K.unknown_fields(changes)


STATS = """st AS (SELECT o_custkey AS experiment_id, count(*) AS n_cells, count(CASE WHEN o_orderstatus='P' THEN 1 END) AS n_divisions FROM orders WHERE o_totalprice>50000 GROUP BY 1)"""


def _stats(v):
    return v.table("orders").where("o_totalprice > 50000").groupBy(F.col("o_custkey").alias("experiment_id")).agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_if(F.col("o_orderstatus") == "P").alias("n_divisions"))


def _reports(v):
    return v.timeline.where("event_type = 'signup'")


@query("experiment_cards", f"""WITH {EXP}, {STATS} SELECT ex.experiment_id, ex.name, ex.status, n.n_name AS filename, st.n_cells, st.n_divisions, coalesce(r.n,0) AS n_reports
FROM ex LEFT JOIN nation n ON n.n_nationkey=ex.dataset_id LEFT JOIN st ON st.experiment_id=ex.experiment_id
LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type='signup' GROUP BY 1) r ON r.user_id=ex.experiment_id""")
def _(v):
    data = v.table("nation").select(F.col("n_nationkey").alias("dataset_id"), F.col("n_name").alias("filename"))
    return K.experiment_cards(_ex(v), data, _stats(v), _reports(v)).drop("dataset_id", "config_id")


@query("dashboard_totals", f"""WITH {EXP}, {STATS} SELECT (SELECT count(*) FROM ex) AS n_experiments, (SELECT count(*) FROM ex WHERE status='done') AS n_done,
 (SELECT count(*) FROM ex WHERE status IN ('queued','processing')) AS n_running, CAST(sum(n_cells) AS BIGINT) AS n_cells, CAST(sum(n_divisions) AS BIGINT) AS n_divisions,
 (SELECT count(*) FROM events WHERE event_type='signup') AS n_reports FROM st WHERE experiment_id IN (SELECT experiment_id FROM ex WHERE status='done')""")
def _(v):
    return K.dashboard_totals(_ex(v), _stats(v), _reports(v))


BENCH = """b AS (SELECT l_partkey AS dataset, l_returnflag AS method, l_linestatus='F' AS is_baseline, l_discount AS score, l_shipdate AS created_at, l_orderkey*10+l_linenumber AS bench_id FROM lineitem)"""


@query("method_vs_baseline", f"""WITH {BENCH}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset, is_baseline ORDER BY created_at DESC, bench_id DESC, method DESC) AS rn FROM b),
 w AS (SELECT dataset, max(CASE WHEN NOT is_baseline THEN score END) AS own, max(CASE WHEN is_baseline THEN score END) AS baseline, max(created_at) AS newest FROM r WHERE rn=1 GROUP BY 1)
SELECT dataset, own, baseline, round(own-baseline,6)+0.0 AS delta, CASE WHEN own>baseline THEN 'ahead' WHEN own<baseline THEN 'behind' WHEN own=baseline THEN 'tied' END AS verdict, epoch_us(newest) AS newest_us FROM w""")
def _(v):
    li = v.table("lineitem")
    bench = li.select(F.col("l_partkey").alias("dataset"), F.col("l_returnflag").alias("method"), (F.col("l_linestatus") == "F").alias("is_baseline"),
                      F.col("l_discount").alias("score"), F.col("l_shipdate").alias("created_at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("bench_id"))
    out = K.method_vs_baseline(bench, "score")
    return out.select("dataset", "own", "baseline", r6("delta").alias("delta"), "verdict", scalar.micros("newest").alias("newest_us"))


@query("cascade_delete", f"""WITH {EXP}, gone AS (SELECT experiment_id FROM ex WHERE status='error')
SELECT 'experiments' AS name, count(*) AS n FROM ex WHERE experiment_id NOT IN (SELECT * FROM gone) UNION ALL
SELECT 'reports', count(*) FROM events WHERE event_type='signup' AND user_id NOT IN (SELECT * FROM gone) UNION ALL
SELECT 'events', count(*) FROM events WHERE user_id NOT IN (SELECT * FROM gone) UNION ALL SELECT 'runs', count(*) FROM orders WHERE o_custkey NOT IN (SELECT * FROM gone)""")
def _(v):
    kept = K.cascade_delete(_ex(v).where("status = 'error'"), _ex(v), _reports(v), v.timeline, v.runs)
    out = None
    for name, df in kept.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out


@query("fingerprint", """SELECT sha256(CAST(count(*) AS VARCHAR) || chr(10) || string_agg(source, chr(10) ORDER BY source)) AS fingerprint, count(*) AS n FROM (SELECT DISTINCT source FROM documents)""")
def _(v):
    names = v.table("documents").select(F.col("source").alias("ordinal"), F.col("source").alias("name")).distinct()
    return K.fingerprint(names, "ordinal", "name")


@query("hash_files")
def _(v):
    return digests.hash_files(v.spark, f"{v.folder}/*.parquet").select(scalar.basename("path").alias("file"), "length", "sha256")


# scalar functions over whole tables

@query("relative_time", """WITH d AS (SELECT event_id, ts, (epoch_us(now_)-epoch_us(ts))/1000000 AS s FROM events CROSS JOIN (SELECT TIMESTAMP '2024-01-20 12:00:00' AS now_)),
 u AS (SELECT *, CASE WHEN s<60 THEN 0 WHEN s<3600 THEN 60 WHEN s<86400 THEN 3600 WHEN s<604800 THEN 86400 ELSE 604800 END AS unit FROM d)
SELECT event_id, CASE WHEN unit=0 THEN 'just now' ELSE CAST(CAST(floor(s/unit) AS BIGINT) AS VARCHAR) || CASE unit WHEN 60 THEN ' minute' WHEN 3600 THEN ' hour' WHEN 86400 THEN ' day' ELSE ' week' END
 || CASE WHEN floor(s/unit)=1 THEN '' ELSE 's' END || ' ago' END AS ago FROM u""")
def _(v):
    return v.table("events").select("event_id", scalar.relative_time("ts", F.lit("2024-01-20 12:00:00").cast("timestamp")).alias("ago"))


@query("relative_time_old", """SELECT o_orderkey AS run_id, strftime(o_orderdate,'%Y-%m-%d') AS ago FROM orders""")
def _(v):
    return v.table("orders").select(F.col("o_orderkey").alias("run_id"), scalar.relative_time("o_orderdate", F.lit("2030-01-01").cast("timestamp")).alias("ago"))


@query("parse_patch_name", """SELECT p_partkey, replace(p_name,' ','_') AS sample_id, p_size AS frame_idx, CAST(p_partkey%256 AS INT) AS candidate_y, CAST(p_partkey%199 AS INT) AS candidate_x FROM part""")
def _(v):
    named = v.table("part").select("p_partkey", F.concat(F.concat_ws(
        "_", F.translate("p_name", " ", "_"), F.col("p_size").cast("string"), (F.col("p_partkey") % 256).cast("string"), (F.col("p_partkey") % 199).cast("string")), F.lit(".npy")).alias("f"))
    return named.select("p_partkey", *[c.alias(n) for n, c in scalar.parse_patch_name("f").items()])


@query("basename", r"""SELECT page_id, regexp_extract(url,'([^/]*)$',1) AS name FROM pages""")
def _(v):
    path = F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.translate("url", "/", "\\"))
    return v.table("pages").select("page_id", scalar.basename(path).alias("name"))


@query("euclidean", "SELECT event_id, round(sqrt((value-40)*(value-40)+(user_id-50)*(user_id-50)),6) AS d FROM events")
def _(v):
    return v.table("events").select("event_id", r6(scalar.euclidean("value", "user_id", F.lit(40.0), F.lit(50))).alias("d"))


@query("sigmoid", "SELECT event_id, round(1/(1+exp(-(value-40)/20)),6) AS p FROM events")
def _(v):
    return v.table("events").select("event_id", r6(scalar.sigmoid((F.col("value") - 40) / 20)).alias("p"))


@query("shape_json", """SELECT p_partkey, '[' || p_size || ',' || p_partkey%64 || ',256]' AS shape, CAST(p_size*(p_partkey%64)*256 AS BIGINT) AS n_voxels FROM part""")
def _(v):
    text = F.concat(F.lit("[ "), F.col("p_size").cast("string"), F.lit(", "), (F.col("p_partkey") % 64).cast("string"), F.lit(", 256 ]"))
    p = v.table("part").select("p_partkey", scalar.shape_from_json(text).alias("s"))
    return p.select("p_partkey", scalar.shape_to_json("s").alias("shape"), F.aggregate("s", F.lit(1).cast("bigint"), lambda a, b: a * b).alias("n_voxels"))
