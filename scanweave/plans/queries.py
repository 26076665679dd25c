"""Queries on the driver's tables, each with the SQL that must give the same rows.

``embeddings`` serves as detector frames of 8 by 8 pixels with ``label`` as the
motor, ``events`` as pump-probe shots and as curves over days, ``orders`` as the
table of scans and ``lineitem`` as cells on a grid.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanweave import model
from scanweave.functions import crystal, physics
from scanweave.operators import combine, curves, fitting, imaging, processing, pumpprobe, reductions, scans, scattering
from scanweave.streaming import sessions, windowed
from scanweave.tables import dealt

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
ROIS = {"a": (0, 4, 0, 4), "b": (2, 8, 3, 8), "c": (5, 6, 0, 8)}
GEOMETRY = scattering.Geometry(distance_mm=100.0, centre_y=3.2, centre_x=3.7, pixel_um=5000.0, energy_kev=10.0)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, *but: str) -> DataFrame:
    """Doubles to so many digits, without a negative zero."""
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if kind == "double" and c not in but else F.col(c) for c, kind in df.dtypes])


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts, each of which stands for a curve, a frame or a crystal: rows of some bytes that make much work, so they are dealt over tasks."""
    return dealt(t(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey")


def pixels(spark: SparkSession, sf_dir: str, square: bool = False) -> DataFrame:
    out = model.cells(t(spark, sf_dir, "embeddings"), "embedding", 8, ("vec_id", "label"))
    return out.withColumn("v", F.col("v") * F.col("v")) if square else out


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curve of each event type: the day's number and its sum of values."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01")).cast("double")
    return t(spark, sf_dir, "events").groupBy("event_type", day.alias("x")).agg(F.sum("value").alias("y"))


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as shots: click is laser on, view is off, the others neither; k is the delay and user_id mod 7 + 1 the monitor."""
    e = t(spark, sf_dir, "events")
    flag = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "view", 0)
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select("event_id", "ts", "event_type", flag.alias("flag"), k.alias("k"), "value", (F.col("user_id") % 7 + 1).cast("double").alias("i0"), "user_id")


def scan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for x in ("F", "complete", "O", "running", "P", "aborted")])
    return t(spark, sf_dir, "orders").withColumn("status", names[F.col("o_orderstatus")])


def r(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0"


CELLS = """cells AS (SELECT vec_id, label, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, v, v * v AS w FROM (
    SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS i FROM embeddings))"""
DAILY = """daily AS (SELECT event_type, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS DOUBLE) AS x, sum(value) AS y
    FROM events GROUP BY ALL)"""
SHOTS = """shots AS (SELECT event_id, ts, event_type, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 0 END AS flag,
    CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, value, CAST(user_id % 7 + 1 AS DOUBLE) AS i0, user_id,
    CASE event_type WHEN 'click' THEN 'on' WHEN 'view' THEN 'off' END AS laser FROM events)"""
ROIS_SQL = "rois(roi, y0, y1, x0, x1) AS (VALUES ('a', 0, 4, 0, 4), ('b', 2, 8, 3, 8), ('c', 5, 6, 0, 8))"
IN_ROI = "c.y >= y0 AND c.y < y1 AND c.x >= x0 AND c.x < x1"


# Reductions of frames


@query(f"""WITH {CELLS} SELECT y, x, {r('sum(v)')} AS sum, {r('avg(v)')} AS mean, max(v) AS max, min(v) AS min, {r('stddev_pop(v)')} AS std,
    {r('median(v)')} AS median FROM cells GROUP BY y, x""")
def image_reductions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six images from one aggregation."""
    made = [reductions.ACCUMULATORS[n]() for n in ("sum", "mean", "max", "min", "std", "median")]
    return rounded(reductions.reduce(pixels(spark, sf_dir), made)[("y", "x")], 6, "max", "min")


@query(f"""WITH {CELLS} SELECT vec_id, {r('sum(w)')} AS sum, {r('avg(w)')} AS mean, {r('max(w)')} AS max,
    {r('sum(w * y) / greatest(sum(w), 1e-30)')} AS com_y, {r('sum(w * x) / greatest(sum(w), 1e-30)')} AS com_x FROM cells GROUP BY vec_id""")
def frame_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reductions.frame_stats(pixels(spark, sf_dir, True), "vec_id"))


@query(f"""WITH {CELLS}, c AS (SELECT vec_id, sum(w * y) / sum(w) AS cy, sum(w * x) / sum(w) AS cx, sum(w) AS total, max(w) AS max FROM cells GROUP BY vec_id)
    SELECT vec_id, {r('any_value(cy)')} AS com_y, {r('any_value(cx)')} AS com_x, {r('any_value(total)')} AS total, {r('any_value(max)')} AS max,
    {r('sum(w * (y - cy) ** 2) / sum(w)')} AS m2_y, {r('sum(w * (x - cx) ** 2) / sum(w)')} AS m2_x,
    {r('sum(w * (y - cy) ** 3) / sum(w)')} AS m3_y, {r('sum(w * (x - cx) ** 3) / sum(w)')} AS m3_x
    FROM cells JOIN c USING (vec_id) GROUP BY vec_id""")
def frame_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reductions.frame_moments(pixels(spark, sf_dir, True), "vec_id"))


@query(f"""WITH {CELLS}, s AS (SELECT y, x, sum(greatest(w, 1e-10)) AS s0, sum(greatest(w, 1e-10) * (label - 4.5)) AS s1,
    sum(greatest(w, 1e-10) * (label - 4.5) ** 2) AS s2, sum(greatest(w, 1e-10) * (label - 4.5) ** 3) AS s3, sum(greatest(w, 1e-10) * (label - 4.5) ** 4) AS s4
    FROM cells GROUP BY y, x), m AS (SELECT y, x, s0, s1 / s0 AS a, s2 / s0 AS b, s3 / s0 AS c, s4 / s0 AS d, s2 / s0 - (s1 / s0) ** 2 AS var FROM s)
    SELECT y, x, {r('a + 4.5')} AS com, {r('sqrt(greatest(var, 0))')} AS width, {r('(c - 3 * a * b + 2 * a ** 3) / greatest(sqrt(greatest(var, 0)) ** 3, 1e-30)')} AS skew,
    {r('(d - 4 * a * c + 6 * a * a * b - 3 * a ** 4) / greatest(var * var, 1e-30) - 3')} AS kurtosis, {r('s0')} AS total FROM m""")
def motor_com(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centre of mass, width, skewness and kurtosis of the motor per pixel."""
    return rounded(reductions.com_map(pixels(spark, sf_dir, True), "label", 4.5))


@query(f"""WITH {CELLS}, s AS (SELECT y, x, sum(greatest(v, 0)) AS s0, sum(greatest(v, 0) * label) AS s1, sum(greatest(v, 0) * label ** 2) AS s2 FROM cells GROUP BY y, x)
    SELECT y, x, {r('CASE WHEN s0 > 1e-10 THEN s1 / s0 END')} AS com, {r('CASE WHEN s0 > 1e-10 THEN sqrt(greatest(s2 / s0 - (s1 / s0) ** 2, 0)) END')} AS width,
    {r('s0')} AS total FROM s""")
def energy_com(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reductions.energy_com(pixels(spark, sf_dir), "label"))


@query(f"""WITH {CELLS}, a AS (SELECT y, x, sum(greatest(w, 1e-10) * label) / sum(greatest(w, 1e-10)) AS com, sum(greatest(w, 1e-10)) AS total FROM cells GROUP BY y, x),
    m AS (SELECT y, x, any_value(com) AS com, any_value(total) AS total, sum(greatest(w, 1e-10) * (label - com) ** 2) / any_value(total) AS m2,
    sum(greatest(w, 1e-10) * (label - com) ** 3) / any_value(total) AS m3, sum(greatest(w, 1e-10) * (label - com) ** 4) / any_value(total) AS m4
    FROM cells JOIN a USING (y, x) GROUP BY y, x)
    SELECT y, x, {r('com')} AS com, {r('sqrt(m2)')} AS std, {r('sqrt(m2) * 2.3548200450309493')} AS fwhm, {r('m3 / sqrt(m2) ** 3')} AS skew,
    {r('m4 / (m2 * m2) - 3')} AS kurtosis, {r('total')} AS total FROM m""")
def central_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reductions.central_moments(pixels(spark, sf_dir, True), "label"))


@query(f"""WITH {CELLS}, o AS (SELECT y, x, label, v, row_number() OVER (PARTITION BY y, x ORDER BY v DESC, vec_id) AS n FROM cells)
    SELECT y, x, label AS argmax, v AS peak FROM o WHERE n = 1""")
def argmax_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = reductions.ACCUMULATORS["argmax_motor"]("label", frame="vec_id")
    return reductions.reduce(pixels(spark, sf_dir), [made])[("y", "x")]


@query("""WITH s AS (SELECT l_returnflag, l_quantity, sum(l_extendedprice) AS w FROM lineitem GROUP BY ALL),
    c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS run, sum(w) OVER (PARTITION BY l_returnflag) AS total FROM s)
    SELECT l_returnflag, min(l_quantity) AS quantile FROM c WHERE run >= 0.25 * total GROUP BY l_returnflag""")
def weighted_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reductions.weighted_quantile(t(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", 0.25, ("l_returnflag",))


@query(f"""SELECT l_returnflag, l_linestatus, {r('avg(l_extendedprice)', 4)} AS mean, count(l_extendedprice) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def reduce_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reductions.reduce_dims(t(spark, sf_dir, "lineitem"), ("l_returnflag", "l_linestatus"), "mean", "l_extendedprice"), 4)


@query(f"""WITH {CELLS}, c AS (SELECT label, vec_id % 4 AS m, y, x, v FROM cells)
    SELECT label, m, y, x, CAST(GROUPING(label, m, y, x) AS BIGINT) AS grouping, {r('sum(v)')} AS sum, count(v) AS n FROM c
    GROUP BY GROUPING SETS ((y, x), (label, y), (label, x), (m, y), (m, x), (label, m))""")
def projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pair projections of two motors from one shuffle."""
    own = pixels(spark, sf_dir).withColumn("m", F.col("vec_id") % 4)
    return rounded(reductions.projections(own, ("label", "m")))


@query(f"""WITH {CELLS}, {ROIS_SQL} SELECT roi, label, {r('sum(v)')} AS sum, count(v) AS pixels FROM cells c JOIN rois ON {IN_ROI} GROUP BY roi, label""")
def roi_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reductions.roi_integral(pixels(spark, sf_dir), ROIS, ("label",)))


@query(f"""WITH {CELLS}, {ROIS_SQL} SELECT roi, count(w) AS pixels, {r('sum(w)')} AS sum, {r('avg(w)')} AS mean, {r('stddev_pop(w)')} AS std, {r('min(w)')} AS min,
    {r('max(w)')} AS max, {r('sum(w * c.y) / sum(w)')} AS centre_y, {r('sum(w * c.x) / sum(w)')} AS centre_x FROM cells c JOIN rois ON {IN_ROI} GROUP BY roi""")
def roi_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reductions.roi_statistics(pixels(spark, sf_dir, True), ROIS))


@query(f"""WITH {CELLS}, {ROIS_SQL}, s AS (SELECT roi, label, sum(w) AS s, count(w) AS n FROM cells c JOIN rois ON {IN_ROI} GROUP BY roi, label),
    b AS (SELECT label, sum(w) AS b, count(w) AS nb FROM cells WHERE y >= 6 AND x >= 6 GROUP BY label)
    SELECT roi, label, {r('s - n / nb * b')} AS value, {r('sqrt(abs(s) + (n / nb) ** 2 * abs(b))')} AS sigma FROM s JOIN b USING (label)""")
def roi_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reductions.roi_curves(pixels(spark, sf_dir, True), ROIS, (6, 8, 6, 8), ("label",)))


@query(f"""WITH {CELLS} SELECT label, CAST(y // 3 AS INTEGER) AS yb, CAST(x // 3 AS INTEGER) AS xb, {r('avg(v)')} AS v FROM cells WHERE y < 6 AND x < 6 GROUP BY ALL""")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of three by three pixels; the remainder is trimmed."""
    return rounded(model.bin_pixels(pixels(spark, sf_dir), ("label",), 3, 8, 8))


@query(f"""SELECT CAST(least(floor(value / 5.0), 19) AS INTEGER) AS bin, least(floor(value / 5.0), 19) * 5.0 AS low, count(*) AS n, {r('sqrt(count(*))')} AS sigma
    FROM events WHERE value BETWEEN 0 AND 100 GROUP BY ALL""")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reductions.histogram(t(spark, sf_dir, "events"), "value", 20, 0.0, 100.0))


@query(f"""WITH {CELLS}, m AS (SELECT y, x, avg(v) AS mean, stddev_pop(v) AS std FROM cells GROUP BY y, x),
    o AS (SELECT y, x, label, mean, std, row_number() OVER (PARTITION BY y, x ORDER BY abs(v - mean), vec_id) AS n FROM cells JOIN m USING (y, x))
    SELECT y, x, {r('mean')} AS mean, {r('std')} AS std, label AS nearest FROM o WHERE n = 1""")
def stat_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reductions.stat_images(pixels(spark, sf_dir), "label", frame="vec_id"))


@query(f"""WITH {CELLS}, p AS (SELECT vec_id, quantile_cont(v, 0.1) AS a, quantile_cont(v, 0.9) AS b FROM cells GROUP BY vec_id)
    SELECT vec_id, {r('any_value(a)')} AS low, {r('any_value(b)')} AS high, {r('avg(v)')} AS mean, {r('sum(v)')} AS sum FROM cells JOIN p USING (vec_id)
    WHERE v >= a AND v <= b GROUP BY vec_id""")
def rocking_curve_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reductions.rocking_curve_stats(pixels(spark, sf_dir), "vec_id", 10, 90))


@query(f"""WITH {CELLS} SELECT vec_id, {r('sum(w)')} AS total FROM cells GROUP BY vec_id ORDER BY sum(w) DESC, vec_id LIMIT 5""")
def brightest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reductions.brightest(pixels(spark, sf_dir, True), "vec_id", 5))


@query(f"""WITH {CELLS} SELECT label, {r('avg(v)')} AS mean, {r('stddev_pop(v)')} AS std, {r('median(v)')} AS median, min(v) AS min, max(v) AS max, count(v) AS n
    FROM cells GROUP BY label""")
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(reductions.cluster_stats(pixels(spark, sf_dir), "label", "v"), 6, "min", "max")


@query(f"""WITH {CELLS}, m AS (SELECT y, x, max(v) - max(v) FILTER (label IN (0, 9)) AS rise FROM cells GROUP BY y, x)
    SELECT y, x, {r('rise')} AS rise FROM m WHERE rise > 0 AND rise >= 0.3 * (SELECT max(rise) FROM m)""")
def prominence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels that rise within the scan well above its first and last points."""
    edge = F.max(F.when(F.col("label").isin(0, 9), F.col("v")))
    rise = pixels(spark, sf_dir).groupBy("y", "x").agg((F.max("v") - edge).alias("rise"))
    return rounded(reductions.prominent(rise, "rise", 0.3))


# Pump-probe


@query(f"""SELECT CASE event_type WHEN 'click' THEN 'on' ELSE 'off' END AS laser, user_id, {r('sum(value)')} AS sum, count(*) AS n FROM events GROUP BY ALL""")
def on_off_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = (F.sum("value").alias("sum"), F.count("*").alias("n"))
    return rounded(reductions.on_off_split(shots(spark, sf_dir), F.col("flag"), ("user_id",), columns))


@query(f"""WITH {SHOTS} SELECT k, {r("avg(value) FILTER (laser = 'on')")} AS "on", {r("avg(value) FILTER (laser = 'off')")} AS off,
    {r("100 * (avg(value) FILTER (laser = 'on') - avg(value) FILTER (laser = 'off')) / avg(value) FILTER (laser = 'off')")} AS percent
    FROM shots WHERE laser IS NOT NULL GROUP BY k""")
def differential(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = pumpprobe.split_on_off(shots(spark, sf_dir), F.col("flag"))
    return rounded(pumpprobe.differential(split, ("k",), "value", "percent"))


@query(f"""SELECT {r('avg(value)')} AS value, {r('avg(user_id)')} AS user_id, count(*) AS n FROM events GROUP BY round_even(value * 10, 0)""")
def bin_by_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pumpprobe.bin_by_axis(t(spark, sf_dir, "events"), "value", ("user_id",), 1))


@query(f"""WITH {SHOTS}, k AS (SELECT * FROM shots WHERE laser IS NOT NULL AND value BETWEEN 1 AND 60), m AS (SELECT min(k) AS low, (max(k) - min(k)) / 10.0 AS w FROM k)
    SELECT laser, CAST(least(floor((k - low) / w), 9) AS INTEGER) AS bin, {r('low + (least(floor((k - low) / w), 9) + 0.5) * w')} AS centre, {r('sum(value)')} AS value,
    count(*) AS n_shots, {r('sum(i0)')} AS sum_i0 FROM k, m GROUP BY ALL""")
def bin_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pumpprobe.bin_events(shots(spark, sf_dir), "k", F.col("flag"), "i0", ("value",), 10, {"value": (1.0, 60.0)}))


@query(f"""WITH {SHOTS}, k AS (SELECT *, CASE WHEN k < 20 THEN 0 WHEN k < 50 THEN 1 ELSE 2 END AS bin FROM shots WHERE laser IS NOT NULL AND k BETWEEN 5 AND 80)
    SELECT laser, bin, [12.5, 35.0, 65.0][bin + 1] AS centre, {r('sum(value)')} AS value, count(*) AS n_shots, {r('sum(i0)')} AS sum_i0 FROM k GROUP BY ALL""")
def bin_events_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pumpprobe.bin_events(shots(spark, sf_dir), "k", F.col("flag"), "i0", ("value",), [5, 20, 50, 80]))


@query(f"""SELECT {r('avg(CAST(user_id AS DOUBLE) / 8)')} AS user, {r('avg(value)')} AS value, count(*) AS n FROM events
    GROUP BY round_even(CAST(user_id AS DOUBLE) / 8 * 10, 0)""")
def combine_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs, of which one has a column more, binned together."""
    own = t(spark, sf_dir, "events").withColumn("user", F.col("user_id").cast("double") / 8)
    first = own.filter("ts < TIMESTAMP '2024-01-10'").select("user", "value", "event_type")
    second = own.filter("ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'").select("user", "value")
    third = own.filter("ts >= TIMESTAMP '2024-01-20'").select("value", "user")
    return rounded(pumpprobe.combine_runs([first, second, third], "user", 1))


@query(f"""SELECT l_returnflag, {r('regr_slope(l_extendedprice, l_quantity)', 4)} AS slope, {r('regr_intercept(l_extendedprice, l_quantity)', 4)} AS intercept,
    {r('regr_r2(l_extendedprice, l_quantity)')} AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY l_returnflag""")
def linearity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pumpprobe.linearity(t(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity", ("l_returnflag",))
    return rounded(rounded(out, 4, "r2"), 6, "slope", "intercept")


@query(f"""WITH {SHOTS} SELECT user_id, {r('median(value)')} AS value, {r('median(k)')} AS k, {r("avg(value / i0) FILTER (laser = 'on')")} AS signal_on,
    {r("avg(value / i0) FILTER (laser = 'off')")} AS signal_off FROM shots GROUP BY user_id""")
def reduce_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pumpprobe.reduce_point(shots(spark, sf_dir), "user_id", F.col("flag"), "value", "i0", ("value", "k")))


@query(f"""SELECT l_quantity, {r('sum(l_extendedprice / l_discount)', 2)} AS "on", {r('sum(l_quantity / l_tax)', 2)} AS off, count(*) AS n_shots,
    {r('sum(l_discount)')} AS i0_on, {r('sum(l_tax)')} AS i0_off FROM lineitem WHERE l_discount <> 0 AND l_tax <> 0 GROUP BY l_quantity""")
def bin_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of shots with a dark monitor on either side go."""
    own = t(spark, sf_dir, "lineitem").withColumn("other", F.col("l_quantity"))
    out = pumpprobe.bin_shots(own, "l_quantity", "l_extendedprice", "other", "l_discount", "l_tax")
    return rounded(rounded(out, 2, "i0_on", "i0_off", "l_quantity"), 6, "on", "off")


# The table of scans


@query("""SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice BETWEEN 100000 AND 200000
    AND o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def scan_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished scans in a range and a list."""
    found = scans.select(scan_rows(spark, sf_dir), {"o_totalprice": (100000, 200000), "o_orderpriority": ["1-URGENT", "2-HIGH"]})
    return found.select("o_orderkey", "o_totalprice", "o_orderpriority")


@query(f"""SELECT o_orderpriority, count(*) AS scans, {r('avg(o_totalprice)', 3)} AS mean FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY o_orderpriority""")
def scan_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scans.groups(scan_rows(spark, sf_dir), ("o_orderpriority",), F.avg("o_totalprice").alias("mean")), 3)


@query(""" SELECT 'l_quantity' AS "column", max(l_quantity) - min(l_quantity) AS range, count(DISTINCT l_quantity) AS values FROM lineitem
    UNION ALL SELECT 'l_linenumber', CAST(max(l_linenumber) - min(l_linenumber) AS DOUBLE), count(DISTINCT l_linenumber) FROM lineitem""")
def varying(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity and line number vary by enough; the tax does not."""
    return scans.varying(t(spark, sf_dir, "lineitem"), {"l_quantity": 1.0, "l_linenumber": 1.0, "l_tax": 0.5})


@query(f"""WITH c AS (SELECT o_totalprice AS v, count(*) AS n FROM orders GROUP BY 1),
    g AS (SELECT v, n, CASE WHEN v - lag(v) OVER (ORDER BY v) > 40 THEN 1 ELSE 0 END AS new FROM c),
    h AS (SELECT v, n, CAST(sum(new) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "group" FROM g)
    SELECT "group", {r('sum(v * n) / sum(n)', 7)} AS centre, min(v) AS low, max(v) AS high, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY "group" """)
def cluster_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gap clustering of a column's values."""
    return rounded(curves.cluster_values(t(spark, sf_dir, "orders"), "o_totalprice", 40.0), 7, "low", "high")


@query("""SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')
    AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def pending_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found, neither processed nor skipped, and among those asked for."""
    orders, customers = t(spark, sf_dir, "orders"), t(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    done = orders.filter("o_orderstatus = 'P'").select("o_custkey")
    skipped = customers.filter("c_acctbal < 0").select("o_custkey")
    only = customers.filter("c_mktsegment = 'BUILDING'").select("o_custkey")
    return scans.pending(orders.filter("o_orderstatus = 'O'"), done, skipped, "o_custkey", only)


@query(f"""WITH p AS (SELECT DISTINCT user_id, value FROM events), d AS (SELECT user_id, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY value) AS d FROM p),
    s AS (SELECT user_id, median(d) AS step, min(value) AS low, max(value) AS high FROM d GROUP BY user_id)
    SELECT {r('min(low)')} AS low, {r('max(high)')} AS high, {r('min(CASE WHEN step > 0 THEN step END)')} AS step FROM s""")
def common_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scans.common_grid(t(spark, sf_dir, "events"), "user_id", "value"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag
    ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1""")
def first_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of frames at the same grid position the first."""
    own = t(spark, sf_dir, "lineitem").withColumn("frame", F.struct("l_orderkey", "l_linenumber"))
    kept = model.first_frame_per_point(own, ("l_suppkey", "l_returnflag"), "frame")
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_suppkey")


@query("""WITH i AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem), n AS (SELECT *, l_orderkey - row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS g FROM i)
    SELECT l_suppkey, min(l_orderkey) AS start, max(l_orderkey) + 1 AS stop FROM n GROUP BY l_suppkey, g""")
def contiguous_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.contiguous_runs(t(spark, sf_dir, "lineitem"), "l_orderkey", ("l_suppkey",))


@query("""SELECT o_orderkey, CAST(floor(o_orderkey / 7) AS INTEGER) AS slow, CAST(CASE WHEN floor(o_orderkey / 7) % 2 = 1 THEN 6 - o_orderkey % 7 ELSE o_orderkey % 7 END AS INTEGER) AS fast
    FROM orders""")
def snake_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    slow, fast = scans.snake_index(F.col("o_orderkey"), 7)
    return t(spark, sf_dir, "orders").select("o_orderkey", slow.alias("slow"), fast.alias("fast"))


# Curves


@query(f"""WITH {DAILY}, n AS (SELECT *, x - lag(x) OVER w AS a, lead(x) OVER w - x AS b, lag(y) OVER w AS p, lead(y) OVER w AS q FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY x))
    SELECT event_type, x, {r('y', 4)} AS y, {r('CASE WHEN a IS NULL THEN (q - y) / b WHEN b IS NULL THEN (y - p) / a ELSE (a * a * q - b * b * p + (b * b - a * a) * y) / (a * b * (a + b)) END', 4)} AS dy FROM n""")
def derivative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.derivative(daily(spark, sf_dir), ("event_type",)), 4)


@query(f"""WITH {DAILY}, n AS (SELECT *, coalesce(0.5 * (x - lag(x) OVER w) * (y + lag(y) OVER w), 0) AS s FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY x))
    SELECT event_type, x, {r('y', 4)} AS y, {r('sum(s) OVER (PARTITION BY event_type ORDER BY x ROWS UNBOUNDED PRECEDING)', 4)} AS integral FROM n""")
def cumulative_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.cumulative_integral(daily(spark, sf_dir), ("event_type",)), 4)


@query(f"""WITH {DAILY}, n AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY x) AS i, count(*) OVER (PARTITION BY event_type) AS n,
    first_value(y) OVER (PARTITION BY event_type ORDER BY x) AS f, first_value(y) OVER (PARTITION BY event_type ORDER BY x DESC) AS l,
    sum(y) OVER (PARTITION BY event_type ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM daily)
    SELECT event_type, x, {r('y', 4)} AS y, {r('(s + greatest(3 - i, 0) * f + greatest(i + 2 - n, 0) * l) / 5', 4)} AS smooth FROM n""")
def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.moving_average(daily(spark, sf_dir), 2, ("event_type",)), 4)


@query(f"""WITH {DAILY} SELECT event_type, arg_max(x, y) AS peak, {r('max(y)', 4)} AS height FROM daily GROUP BY event_type""")
def peak_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.peak_position(daily(spark, sf_dir), by=("event_type",)), 4)


@query(f"""WITH {DAILY}, n AS (SELECT *, lag(x) OVER w - x AS a, lead(x) OVER w - x AS b, lag(y) OVER w - y AS p, lead(y) OVER w - y AS q,
    row_number() OVER (PARTITION BY event_type ORDER BY y DESC, x) AS i FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY x)),
    f AS (SELECT *, (a * q - b * p) / (a * b * (b - a)) AS c, (b * b * p - a * a * q) / (a * b * (b - a)) AS s FROM n WHERE i = 1)
    SELECT event_type, {r('CASE WHEN c < 0 THEN x - s / (2 * c) ELSE x END')} AS peak, {r('y')} AS height FROM f""")
def peak_parabola(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.peak_position(daily(spark, sf_dir), "parabola", ("event_type",)))


@query(f"""WITH {DAILY}, n AS (SELECT *, y - min(y) OVER (PARTITION BY event_type) AS w, max(y) OVER (PARTITION BY event_type) - min(y) OVER (PARTITION BY event_type) AS h FROM daily)
    SELECT event_type, {r('sum(x * w) / sum(w)')} AS peak, {r('max(y)')} AS height FROM n WHERE w >= 0.5 * h GROUP BY event_type""")
def peak_com(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.peak_position(daily(spark, sf_dir), "com", ("event_type",)))


@query(f"""WITH {DAILY}, p AS (SELECT event_type, arg_max(x, y) AS p, (min(y) + max(y)) / 2 AS h FROM daily GROUP BY event_type),
    n AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY x)),
    c AS (SELECT *, x + (h - y) * (x2 - x) / nullif(y2 - y, 0) AS c FROM n JOIN p USING (event_type))
    SELECT event_type, {r('min(c) FILTER (x >= p AND y >= h AND y2 < h) - max(c) FILTER (x2 <= p AND y < h AND y2 >= h)')} AS fwhm FROM c GROUP BY event_type""")
def fwhm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.fwhm(daily(spark, sf_dir), ("event_type",)))


@query(f"""WITH {DAILY}, e AS (SELECT event_type, min(x) AS a, max(x) AS b FROM daily GROUP BY event_type),
    f AS (SELECT event_type, regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM daily JOIN e USING (event_type) WHERE x <= a + 0.1 * (b - a) OR x >= b - 0.1 * (b - a) GROUP BY event_type)
    SELECT event_type, x, {r('y', 4)} AS y, {r('i + s * x', 4)} AS background, {r('y - (i + s * x)', 4)} AS net FROM daily JOIN f USING (event_type)""")
def background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.linear_background(daily(spark, sf_dir), ("event_type",)), 4)


@query(f"""WITH {DAILY}, n AS (SELECT *, lag(y) OVER w AS p, lead(y) OVER w AS q FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY x)),
    m AS (SELECT event_type, x, y, row_number() OVER (PARTITION BY event_type ORDER BY y DESC, x) AS rank FROM n WHERE y > p AND y > q)
    SELECT event_type, x, {r('y', 4)} AS y, CAST(rank AS INTEGER) AS rank FROM m WHERE rank <= 3""")
def local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.local_maxima(daily(spark, sf_dir), 3, ("event_type",)), 4)


@query(f"""WITH {DAILY}, w AS (SELECT event_type, unnest(range(CAST(2 * min(x) AS BIGINT) - 2, CAST(2 * max(x) AS BIGINT) + 3)) * 0.5 AS x FROM daily GROUP BY event_type),
    n AS (SELECT w.event_type, w.x, max(d.x) FILTER (d.x <= w.x) AS a, min(d.x) FILTER (d.x >= w.x) AS b FROM w JOIN daily d USING (event_type) GROUP BY w.event_type, w.x)
    SELECT n.event_type, n.x, {r('CASE WHEN n.a = n.b THEN p.y ELSE p.y + (n.x - n.a) / (n.b - n.a) * (q.y - p.y) END', 4)} AS y
    FROM n LEFT JOIN daily p ON p.event_type = n.event_type AND p.x = n.a LEFT JOIN daily q ON q.event_type = n.event_type AND q.x = n.b""")
def interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half days within and beyond the curve; null outside."""
    curve = daily(spark, sf_dir)
    ends = curve.groupBy("event_type").agg((2 * F.min("x")).cast("long").alias("low"), (2 * F.max("x")).cast("long").alias("high"))
    wanted = ends.select("event_type", F.explode(F.expr("sequence(low - 2, high + 2)")).alias("g")).select("event_type", (F.col("g") * 0.5).alias("x"))
    return rounded(curves.interpolate_onto(curve, wanted, ("event_type",)), 4)


@query(f"""WITH g AS (SELECT user_id, value, k, CASE WHEN value - lag(value) OVER (PARTITION BY user_id ORDER BY value) > 0.5 THEN 1 ELSE 0 END AS new FROM
    (SELECT user_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)),
    h AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY value) AS grp FROM g)
    SELECT user_id, {r('avg(value)')} AS x, {r('avg(k)')} AS y FROM h GROUP BY user_id, grp""")
def merge_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = shots(spark, sf_dir).select("user_id", F.col("value").alias("x"), F.col("k").cast("double").alias("y"))
    return rounded(curves.merge_points(own, 0.5, ("user_id",)))


@query(f"""WITH {DAILY}, p AS (SELECT event_type, arg_max(x, y) AS peak FROM daily GROUP BY event_type)
    SELECT event_type, {r('x + 10 - peak')} AS x, {r('y', 4)} AS y FROM daily JOIN p USING (event_type)""")
def align_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.align_peaks(daily(spark, sf_dir), "event_type", 10.0), 4)


# Combining


YEARS = "years AS (SELECT o_orderpriority AS p, CAST(year(o_orderdate) AS INTEGER) AS yr, sum(o_totalprice) AS value, sqrt(sum(o_totalprice)) AS sigma FROM orders GROUP BY ALL)"


def yearly(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = t(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("p"), F.year("o_orderdate").alias("yr")).agg(F.sum("o_totalprice").alias("value"))
    return own.withColumn("sigma", F.sqrt("value"))


@query(f"""WITH {YEARS} SELECT a.p, yr, {r('a.value / b.value')} AS value, {r('abs(a.value / b.value) * sqrt((a.sigma / a.value) ** 2 + (b.sigma / b.value) ** 2)')} AS sigma
    FROM years a JOIN (SELECT * FROM years WHERE p = '5-LOW') b USING (yr)""")
def arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every priority's years over those of one reference, with uncertainties."""
    y = yearly(spark, sf_dir)
    return rounded(combine.arithmetic(y, y.filter("p = '5-LOW'").drop("p"), "/", ("p", "yr")))


def priorities(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    y = yearly(spark, sf_dir)
    return [y.filter(F.col("p").startswith(f"{k}-")).drop("p") for k in range(1, 6)]


@query(f"""WITH {YEARS} SELECT yr, {r('sum(value / sigma ** 2) / sum(1 / sigma ** 2)', 3)} AS value, {r('1 / sqrt(sum(1 / sigma ** 2))', 3)} AS sigma FROM years
    WHERE p IS NOT NULL GROUP BY yr""")
def average_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(combine.average(priorities(spark, sf_dir), ("yr",), "weighted"), 3)


@query(f"""WITH {YEARS} SELECT yr, {r('avg(value)', 3)} AS value, {r('sqrt(sum(sigma ** 2)) / 5', 3)} AS sigma FROM years WHERE p IS NOT NULL GROUP BY yr""")
def average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(combine.average(priorities(spark, sf_dir), ("yr",)), 3)


@query(f"""WITH v AS (SELECT c_nationkey, c_mktsegment, sum(c_acctbal) AS value FROM customer GROUP BY ALL)
    SELECT n.n_nationkey AS c_nationkey, s.c_mktsegment, {r('v.value', 3)} AS value FROM nation n CROSS JOIN (SELECT DISTINCT c_mktsegment FROM customer) s
    LEFT JOIN v ON v.c_nationkey = n.n_nationkey AND v.c_mktsegment = s.c_mktsegment""")
def stack_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values on the full grid, null where a scan is missing."""
    customers = t(spark, sf_dir, "customer")
    values = customers.groupBy("c_nationkey", "c_mktsegment").agg(F.sum("c_acctbal").alias("value"))
    outer = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"))
    return rounded(combine.stack_grid(values, outer, customers.select("c_mktsegment").distinct(), ("c_nationkey", "c_mktsegment")), 3)


@query(f"""WITH {CELLS}, i AS (SELECT label, y, x, sum(w) AS v FROM cells GROUP BY ALL)
    SELECT CAST(y + label // 5 * 6 AS INTEGER) AS y, CAST(x + label % 5 * 6 AS INTEGER) AS x, {r('avg(v)')} AS v FROM i GROUP BY ALL""")
def mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten tiles in two rows with two pixels of overlap."""
    tiles = pixels(spark, sf_dir, True).groupBy("label", "y", "x").agg(F.sum("v").alias("v"))
    offsets = tiles.select("label").distinct().select("label", F.expr("int(label div 5 * 6)").alias("dy"), F.expr("int(label % 5 * 6)").alias("dx"))
    return rounded(combine.mosaic(tiles, offsets, "label"))


@query(f"""WITH {DAILY}, a AS (SELECT x AS i, y AS v FROM daily WHERE event_type = 'click'), b AS (SELECT event_type, x AS i, y AS v FROM daily),
    s AS (SELECT event_type, k, avg(abs(a.v - b.v)) AS score, count(*) AS n FROM range(-5, 6) r(k), b, a WHERE a.i = b.i + k GROUP BY event_type, k)
    SELECT event_type, CAST(k AS INTEGER) AS k, {r('score', 4)} AS score, n FROM s WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY s.score, abs(k), k) = 1""")
def overlap_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shift of every daily curve that fits one reference curve best."""
    both = daily(spark, sf_dir).select("event_type", F.col("x").alias("i"), F.col("y").alias("v"))
    return rounded(combine.overlap_offset(both.filter("event_type = 'click'").drop("event_type"), both, range(-5, 6), by=("event_type",)), 4)


# Images


IMAGE = f"{CELLS}, image AS (SELECT label, y, x, sum(w) AS v FROM cells GROUP BY ALL)"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir, True).groupBy("label", "y", "x").agg(F.sum("v").alias("v"))


@query(f"""WITH {IMAGE} SELECT a.label, a.y, a.x, {r('avg(abs(a.v - b.v))')} AS kam FROM image a JOIN image b ON a.label = b.label AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1
    AND (a.y <> b.y OR a.x <> b.x) GROUP BY a.label, a.y, a.x""")
def kam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(imaging.kam(images(spark, sf_dir), "v", by=("label",)))


@query(f"""WITH {IMAGE}, n AS (SELECT *, lag(v) OVER a AS u, lead(v) OVER a AS d, lag(v) OVER b AS l, lead(v) OVER b AS q FROM image
    WINDOW a AS (PARTITION BY label, x ORDER BY y), b AS (PARTITION BY label, y ORDER BY x))
    SELECT label, y, x, {r('v')} AS v, {r('CASE WHEN u IS NULL THEN d - v WHEN d IS NULL THEN v - u ELSE (d - u) / 2 END')} AS dy,
    {r('CASE WHEN l IS NULL THEN q - v WHEN q IS NULL THEN v - l ELSE (q - l) / 2 END')} AS dx FROM n""")
def gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(imaging.gradients(images(spark, sf_dir), "v", ("label",)))


@query(f"""WITH {IMAGE}, s AS (SELECT a.label, a.y, a.x, median(b.v) AS med FROM (SELECT label, y, x, least(greatest(y + dy, 0), 7) AS yy, least(greatest(x + dx, 0), 7) AS xx
    FROM image, range(-1, 2) p(dy), range(-1, 2) q(dx)) a JOIN image b ON a.label = b.label AND a.yy = b.y AND a.xx = b.x GROUP BY ALL),
    j AS (SELECT i.label, i.y, i.x, i.v, s.med FROM image i JOIN s USING (label, y, x)), m AS (SELECT label, median(abs(v - med)) AS mad FROM j GROUP BY label)
    SELECT label, y, x, {r('CASE WHEN v - med > 2 * (1.4826 * mad + sqrt(abs(med)) + 1e-12) THEN med ELSE v END')} AS v,
    v - med > 2 * (1.4826 * mad + sqrt(abs(med)) + 1e-12) AS hot FROM j JOIN m USING (label)""")
def remove_hot_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(imaging.remove_hot_pixels(images(spark, sf_dir), 8, 8, 2.0, by=("label",)))


@query(f"""WITH {IMAGE}, t AS (SELECT y, x, max(v) AS top, avg(label) AS m FROM image GROUP BY y, x),
    u AS (SELECT y, x, m, label - m AS d, v * v AS g, ln(v) AS z FROM image JOIN t USING (y, x) WHERE v > 0.1 * top AND v > 0),
    s AS (SELECT y, x, m, count(*) AS n, sum(g) AS a0, sum(g * d) AS a1, sum(g * d ** 2) AS a2, sum(g * d ** 3) AS a3, sum(g * d ** 4) AS a4,
    sum(g * z) AS b0, sum(g * z * d) AS b1, sum(g * z * d ** 2) AS b2 FROM u GROUP BY y, x, m),
    w AS (SELECT *, a0 * (a2 * a4 - a3 * a3) - a1 * (a1 * a4 - a3 * a2) + a2 * (a1 * a3 - a2 * a2) AS det FROM s),
    f AS (SELECT y, x, m, n, (b0 * (a2 * a4 - a3 * a3) - a1 * (b1 * a4 - a3 * b2) + a2 * (b1 * a3 - a2 * b2)) / det AS a,
    (a0 * (b1 * a4 - a3 * b2) - b0 * (a1 * a4 - a3 * a2) + a2 * (a1 * b2 - b1 * a2)) / det AS b,
    (a0 * (a2 * b2 - b1 * a3) - a1 * (a1 * b2 - b1 * a2) + b0 * (a1 * a3 - a2 * a2)) / det AS c FROM w)
    SELECT y, x, {r('CASE WHEN c < 0 AND n >= 3 THEN m - b / (2 * c) END', 3)} AS centre, {r('CASE WHEN c < 0 AND n >= 3 THEN sqrt(-1 / (2 * c)) END', 3)} AS sigma,
    {r('CASE WHEN c < 0 AND n >= 3 THEN exp(a - b * b / (4 * c)) END', 3)} AS amplitude FROM f""")
def gaussian_peak_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(imaging.gaussian_peak_maps(images(spark, sf_dir), "label"), 3)


@query(f"""WITH {IMAGE}, c AS (SELECT y, x, sum(v * label) / sum(v) AS com FROM image GROUP BY y, x), m AS (SELECT median(com) AS ref FROM c)
    SELECT y, x, {r('com')} AS com, {r('-radians(com - ref) / tan(radians(10.0))')} AS strain FROM c, m""")
def strain_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    com = images(spark, sf_dir).groupBy("y", "x").agg((F.sum(F.col("v") * F.col("label")) / F.sum("v")).alias("com"))
    return rounded(imaging.strain_map(com, "com", 10.0))


@query(f"""WITH {IMAGE}, c AS (SELECT y, x, sum(v * label) / sum(v) AS a, sum(v * label ** 2) / sum(v) AS b FROM image GROUP BY y, x),
    m AS (SELECT median(a) AS ma, median(b) AS mb FROM c) SELECT y, x, {r('a')} AS a, {r('b')} AS b, {r('atan2(b - mb, a - ma)')} AS angle,
    {r('sqrt((a - ma) ** 2 + (b - mb) ** 2)')} AS magnitude FROM c, m""")
def vector_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, m = F.col("v"), F.col("label")
    maps = images(spark, sf_dir).groupBy("y", "x").agg((F.sum(v * m) / F.sum("v")).alias("a"), (F.sum(v * m * m) / F.sum("v")).alias("b"))
    return rounded(imaging.vector_field(maps, "a", "b"))


@query(f"""WITH {CELLS} SELECT vec_id, y, x, {r('(row_number() OVER (PARTITION BY vec_id ORDER BY v, y, x) - 1) / 63.0')} AS v FROM cells""")
def equalize_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(imaging.equalize_histogram(pixels(spark, sf_dir).drop("label"), ("vec_id",)))


@query(f"""WITH {IMAGE} SELECT label, {r('v')} AS v, CAST(7 - x AS INTEGER) AS y, y AS x FROM image""")
def rotate_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(imaging.transform(images(spark, sf_dir), "rot90", 8, 8))


@query(f"""WITH {IMAGE}, d AS (SELECT y, x, v AS d FROM image WHERE label = 0) SELECT label, y, x, {r('greatest(v - 0.5 * d, 0)')} AS v FROM image JOIN d USING (y, x)""")
def subtract_dark(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = images(spark, sf_dir)
    out = imaging.subtract_dark(own, own.filter("label = 0"), 0.5, True)
    return rounded(out.select("label", "y", "x", "v"))


@query(f"""WITH {IMAGE}, f AS (SELECT y, x, v / avg(v) OVER () AS f FROM image WHERE label = 0) SELECT label, y, x, {r('CASE WHEN f > 0.05 THEN v / f END')} AS v FROM image JOIN f USING (y, x)""")
def flat_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = images(spark, sf_dir)
    return rounded(imaging.flat_field(own, own.filter("label = 0")).select("label", "y", "x", "v"))


# Scattering


RANGE = (2.0, 11.0)
PLACE = f"{IMAGE}, place AS (SELECT label, v, (y - 3.2e0) * 5e0 AS dy, (x - 3.7e0) * 5e0 AS dx FROM image), ring AS (SELECT *, degrees(atan2(sqrt(dy * dy + dx * dx), 100e0)) AS tt FROM place)"


@query(f"""WITH {PLACE}, c AS (SELECT *, cos(radians(tt)) ** 3 AS c, CAST(floor((tt - 2e0) / 1.5e0) AS INTEGER) AS bin FROM ring WHERE tt >= 2e0 AND tt < 11e0)
    SELECT label, bin, {r('avg(v / c)')} AS intensity, {r('sqrt(sum(greatest(v, 0) / (c * c))) / count(*)')} AS sigma, count(*) AS n,
    {r('2e0 + (bin + 0.5e0) * 1.5e0')} AS two_theta FROM c WHERE bin < 6 GROUP BY label, bin""")
def integrate_powder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scattering.integrate_1d(images(spark, sf_dir), GEOMETRY, 8, 8, 6, ("label",), RANGE))


@query(f"""WITH {PLACE}, c AS (SELECT v, CAST(floor((degrees(atan2(dy, dx)) + 180) / 45) AS INTEGER) AS chi_bin, CAST(floor((tt - 2e0) / 2.25e0) AS INTEGER) AS bin FROM ring)
    SELECT chi_bin, bin, {r('avg(v)')} AS intensity, count(*) AS n FROM c WHERE bin >= 0 AND bin < 4 AND chi_bin < 8 GROUP BY chi_bin, bin""")
def cake(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scattering.cake(images(spark, sf_dir), GEOMETRY, 8, 8, 4, 8, RANGE))


CRYSTALS = "crystals AS (SELECT p_partkey, 3 + p_size / 10e0 AS a, 8 + p_partkey % 7 AS energy FROM part WHERE p_size IS NOT NULL)"
INDICES = "indices AS (SELECT h, k, l FROM range(-2, 3) a(h), range(-2, 3) b(k), range(-2, 3) c(l) WHERE (h <> 0 OR k <> 0 OR l <> 0) AND abs(h + k) % 2 = 0 AND abs(k + l) % 2 = 0)"


def crystals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a cubic crystal whose edge follows its size, in a beam whose energy follows its key."""
    edge = 3 + F.col("p_size") / 10.0
    right = [F.lit(90.0).alias(x) for x in ("alpha", "beta", "gamma")]
    energy = (8 + F.col("p_partkey") % 7).cast("double").alias("energy")
    return parts(spark, sf_dir).filter("p_size IS NOT NULL").select("p_partkey", *[edge.alias(x) for x in "abc"], *right, energy)


@query(f"""WITH {CRYSTALS}, {INDICES}, d AS (SELECT p_partkey, energy, h, k, l, 1 / sqrt((h * h + k * k + l * l) / a ** 2) AS d FROM crystals CROSS JOIN indices
    WHERE h > 0 OR (h = 0 AND k > 0) OR (h = 0 AND k = 0 AND l > 0))
    SELECT p_partkey, h, k, l, {r('d')} AS d, {r('degrees(2 * asin(12.398419843320026 / energy / (2 * d)))')} AS two_theta FROM d WHERE 12.398419843320026 / energy / (2 * d) <= 1""")
def reflections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowed reflections of a face-centred cubic cell for each part."""
    return rounded(physics.reflections(crystals(spark, sf_dir), ("p_partkey",), "F", 2))


@query(f"""SELECT p_partkey, {r('12.398419843320026 / p_retailprice')} AS wavelength, {r('degrees(2 * asin(12.398419843320026 / 12.0 / (2 * p_size)))')} AS two_theta,
    {r('4 * pi() * sin(radians(p_size / 2.0)) / (12.398419843320026 / 12.0)')} AS q, {r('p_size * 1e-6 / (12e3 * 1.602176634e-19) / 1e9', 3)} AS giga_photons,
    {r('exp(-p_size / 50.0)')} AS transmission FROM part""")
def unit_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    own = t(spark, sf_dir, "part").select(
        "p_partkey", physics.wavelength(F.col("p_retailprice")).alias("wavelength"), physics.two_theta(size, 12.0).alias("two_theta"),
        physics.q_from_two_theta(size, 12.0).alias("q"), (physics.photons(size, 12.0) / 1e9).alias("giga_photons"),
        physics.transmission(size, F.lit(50.0)).alias("transmission"),
    )
    return rounded(rounded(own, 6, "giga_photons"), 3, "wavelength", "two_theta", "q", "transmission")


@query(f"""WITH {DAILY} SELECT event_type, x, {r('4 * pi() * sin(radians(x)) / (12.398419843320026 / 10.0)')} AS q, {r('y / 2.0 / least(1.0, sin(radians(x)) * 20 / 0.1)', 4)} AS r
    FROM daily WHERE x > 0""")
def reflectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every daily curve, its day taken as the angle in degrees."""
    found = scattering.reflectivity(daily(spark, sf_dir), 10.0, 0.1, 20.0, 2.0, "rectangular", ("event_type",))
    return rounded(rounded(found, 4, "q"), 6, "r")


# Event time


@query(f"""SELECT time_bucket(INTERVAL '1 day', ts) AS start, time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS "end", event_type, count(*) AS n, {r('sum(value)', 4)} AS total
    FROM events GROUP BY ALL""")
def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windowed(t(spark, sf_dir, "events"), "ts", ("event_type",), (F.count("*").alias("n"), F.sum("value").alias("total")), "1 day")
    return rounded(out, 4)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '12 hours' THEN 0 ELSE 1 END AS new FROM events),
    h AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
    SELECT min(ts) AS start, max(ts) + INTERVAL '12 hours' AS "end", user_id, count(*) AS n FROM h GROUP BY user_id, s""")
def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(t(spark, sf_dir, "events"), "ts", ("user_id",), (F.count("*").alias("n"),), "12 hours")


# Iterative operators, tested on planted signals


@query()
def fit_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Gaussian fitted to each frame's row sums."""
    rows = pixels(spark, sf_dir, True).groupBy("vec_id", "y").agg(F.sum("v").alias("s"))
    frames = rows.groupBy("vec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "s"))), lambda e: e["s"]).alias("y"))
    return fitting.fit_peaks(frames, "vec_id", [float(i) for i in range(8)])


@query()
def kmeans_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels in four clusters by centre of mass and width."""
    maps = reductions.com_map(pixels(spark, sf_dir, True), "label", 4.5)
    return fitting.kmeans(maps.select("y", "x", "com", "width"), ("com", "width"), 4).select("y", "x", "cluster")



# Processing and crystals


@query(f"""WITH {YEARS} SELECT p, yr, {r('log10(value)')} AS value, {r('sigma / (value * ln(10e0))', 9)} AS sigma FROM years""")
def apply_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = processing.apply_function(yearly(spark, sf_dir), "log10")
    return rounded(rounded(out, 6, "sigma"), 9, "value")


@query(f"""WITH {DAILY} SELECT event_type, x, {r('(y - min(y) OVER w) / (max(y) OVER w - min(y) OVER w) * 100')} AS y FROM daily WINDOW w AS (PARTITION BY event_type)""")
def normalize_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(processing.normalize(daily(spark, sf_dir), "y", "range", ("event_type",), 100.0))


@query("""SELECT event_id, CASE WHEN value < 5 OR value > 50 THEN -1.0 ELSE value END AS value FROM events""")
def clip_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return processing.clip_values(t(spark, sf_dir, "events").select("event_id", "value"), "value", 5.0, 50.0, -1.0)


@query(f"""WITH {CELLS}, f AS (SELECT label, quantile_cont(v, 0.1) AS f FROM cells GROUP BY label) SELECT label, vec_id, y, x, {r('greatest(v, f)')} AS v FROM cells JOIN f USING (label)""")
def threshold_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(processing.threshold_floor(pixels(spark, sf_dir), "v", 10.0, ("label",)))


@query(f"""WITH {CELLS}, b AS (SELECT * FROM cells WHERE y >= 1 AND y < 5 AND x >= 2 AND x < 8), p AS (SELECT vec_id, quantile_cont(v, 0.9) AS p, median(v) AS m FROM b GROUP BY vec_id),
    c AS (SELECT vec_id, CASE WHEN v > p THEN m ELSE v END AS v FROM b JOIN p USING (vec_id)), q AS (SELECT vec_id, quantile_cont(v, 0.1) AS p, median(v) AS m FROM c GROUP BY vec_id)
    SELECT vec_id, {r('avg(CASE WHEN v < p THEN m ELSE v END)')} AS mean FROM c JOIN q USING (vec_id) GROUP BY vec_id""")
def box_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(processing.box_mean(pixels(spark, sf_dir), (1, 5, 2, 8), "vec_id", True))


@query(f"""WITH {DAILY}, e AS (SELECT event_type, min(x) AS a, max(x) AS b FROM daily GROUP BY event_type),
    w AS (SELECT event_type, CASE WHEN g = 12 THEN b ELSE a + (b - a) * g / 12e0 END AS x FROM e, range(13) r(g)),
    n AS (SELECT w.event_type, w.x, max(d.x) FILTER (d.x <= w.x) AS a, min(d.x) FILTER (d.x >= w.x) AS b FROM w JOIN daily d USING (event_type) GROUP BY w.event_type, w.x)
    SELECT n.event_type, {r('n.x')} AS x, {r('CASE WHEN n.a = n.b THEN p.y ELSE p.y + (n.x - n.a) / (n.b - n.a) * (q.y - p.y) END', 4)} AS y
    FROM n JOIN daily p ON p.event_type = n.event_type AND p.x = n.a JOIN daily q ON q.event_type = n.event_type AND q.x = n.b""")
def resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rounded(processing.resample(daily(spark, sf_dir), 13, ("event_type",)), 4, "x"), 6, "y")


@query(f"""SELECT p_partkey, {r('4 * pi() * sin(asin(12.398419843320026 / 12e0 / (2 * p_size))) / (12.398419843320026 / 12e0)')} AS q FROM part""")
def convert_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = processing.convert_axis(F.col("p_size").cast("double"), "d", "q", 12.0)
    return rounded(t(spark, sf_dir, "part").select("p_partkey", q.alias("q")))


@query(f"""WITH {IMAGE}, n AS (SELECT a.label, a.y, a.x, any_value(a.v) AS v, count(*) AS n, sum(b.v * (b.x - a.x) * (2 - abs(b.y - a.y))) AS gx, sum(b.v * (b.y - a.y) * (2 - abs(b.x - a.x))) AS gy
    FROM image a JOIN image b ON a.label = b.label AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.label, a.y, a.x)
    SELECT label, y, x, {r('v')} AS v, {r('CASE WHEN n = 9 THEN sqrt(gx * gx + gy * gy) END')} AS edge FROM n""")
def edge_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(processing.edge_strength(images(spark, sf_dir), "v", ("label",)))


@query(f"""WITH {IMAGE} SELECT a.label, a.y, a.x, {r('any_value(a.v)')} AS v, {r('stddev_pop(b.v)')} AS local_std FROM image a JOIN image b ON a.label = b.label AND abs(a.y - b.y) <= 1
    AND abs(a.x - b.x) <= 1 GROUP BY a.label, a.y, a.x""")
def smoothness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(processing.smoothness(images(spark, sf_dir), "v", 3, ("label",)))


STRAINS = f"{IMAGE}, e AS (SELECT label, y, x, v, v * v AS e FROM image)"


def strains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images(spark, sf_dir).select("label", "y", "x", "v", (F.col("v") * F.col("v")).alias("e"))


@query(f"""WITH {STRAINS}, s AS (SELECT *, sum(v) OVER (PARTITION BY label, x ORDER BY y) AS s FROM e), k AS (SELECT label, y, s + e AS k FROM s WHERE x = 7)
    SELECT s.label, s.y, s.x, {r('s.v')} AS v, {r('s.e')} AS e, {r('s.s - k.k')} AS dfdy FROM s JOIN k ON s.label = k.label AND s.y = k.y""")
def integrate_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(processing.integrate_displacement(strains(spark, sf_dir), "v", "e", ("label",)))


@query(f"""WITH {STRAINS}, s AS (SELECT *, sum(v) OVER (PARTITION BY label, x ORDER BY y) AS f1, sum(e) OVER (PARTITION BY label, y ORDER BY x) AS f2 FROM e),
    k AS (SELECT label, y, f2 - f1 AS k FROM s WHERE x = 0)
    SELECT s.label, s.y, s.x, {r('s.v')} AS v, {r('s.e')} AS e, {r('s.f1')} AS f1, {r('s.f2')} AS f2, {r('s.f1 + k.k')} AS f FROM s JOIN k ON s.label = k.label AND s.y = k.y""")
def integrate_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(processing.integrate_second(strains(spark, sf_dir), "v", "e", ("label",)))


@query(f"""WITH {STRAINS}, g AS (SELECT a.label, a.y, a.x, (d.v - u.v) / (d.y - u.y) AS eyz_py, (q.v - p.v) / (q.x - p.x) AS eyz_px, (d.e - u.e) / (d.y - u.y) AS ezx_py,
    (q.e - p.e) / (q.x - p.x) AS ezx_px FROM e a JOIN e u ON u.label = a.label AND u.x = a.x AND u.y = greatest(a.y - 1, 0) JOIN e d ON d.label = a.label AND d.x = a.x AND d.y = least(a.y + 1, 7)
    JOIN e p ON p.label = a.label AND p.y = a.y AND p.x = greatest(a.x - 1, 0) JOIN e q ON q.label = a.label AND q.y = a.y AND q.x = least(a.x + 1, 7))
    SELECT label, y, x, {r('eyz_py')} AS eyz_py, {r('eyz_px')} AS eyz_px, {r('ezx_py')} AS ezx_py, {r('ezx_px')} AS ezx_px, {r('(ezx_py - eyz_px) / 2')} AS dev2nd FROM g""")
def compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(imaging.compatibility(strains(spark, sf_dir), "v", "e", ("label",)).drop("v", "e"))


@query(f"""WITH h AS (SELECT p_partkey, p_size / 50e0 AS h, 0.8e0 AS s, p_retailprice / 2100e0 AS v FROM part), k AS (SELECT *, floor(h * 6) % 6 AS i, h * 6 - floor(h * 6) AS f FROM h),
    m AS (SELECT *, v * (1 - s) AS p, v * (1 - f * s) AS q, v * (1 - (1 - f) * s) AS t FROM k)
    SELECT p_partkey, {r('CASE WHEN i IN (0, 5) THEN v WHEN i = 1 THEN q WHEN i = 4 THEN t ELSE p END')} AS red,
    {r('CASE WHEN i IN (1, 2) THEN v WHEN i = 0 THEN t WHEN i = 3 THEN q ELSE p END')} AS green, {r('CASE WHEN i IN (3, 4) THEN v WHEN i = 2 THEN t WHEN i = 5 THEN q ELSE p END')} AS blue FROM m""")
def hsv_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    colours = imaging.hsv_to_rgb(F.col("p_size") / 50.0, F.lit(0.8), F.col("p_retailprice") / 2100.0)
    return rounded(t(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for c, n in zip(colours, ("red", "green", "blue"), strict=True)]))


@query(f"""WITH {DAILY}, p AS (SELECT event_type, x, log10(y) AS f FROM daily WHERE y > 0), l AS (SELECT *, row_number() OVER w - 1 AS k, x - lag(x) OVER w AS hs, lead(x) OVER w - x AS hd,
    lag(f) OVER w AS fs, lead(f) OVER w AS fd, count(*) OVER (PARTITION BY event_type) AS n FROM p WINDOW w AS (PARTITION BY event_type ORDER BY x)),
    g AS (SELECT *, CASE WHEN hs IS NULL THEN (fd - f) / hd WHEN hd IS NULL THEN (f - fs) / hs ELSE (hs ** 2 * fd + (hd ** 2 - hs ** 2) * f - hd ** 2 * fs) / (hs * hd * (hd + hs)) END AS slope FROM l),
    m AS (SELECT event_type, greatest(arg_max(k, f), 1) AS start FROM g GROUP BY event_type)
    SELECT event_type, arg_min(x, slope) AS x_c FROM g JOIN m USING (event_type) WHERE k >= start AND k < greatest(start + 3, floor(n * 0.6e0)) GROUP BY event_type""")
def critical_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scattering.critical_angle(daily(spark, sf_dir), ("event_type",))


@query(f"""WITH e AS (SELECT p_partkey, 5 + p_size / 2e0 AS e FROM part) SELECT p_partkey, {r('2 * pi() * e / 12.398419843320026')} AS wavevector,
    {r('degrees(asin(12.398419843320026 / (2 * 3.1356e0 * e)))')} AS angle, {r('e * 2 * sqrt(2 * ln(2e0))')} AS fwhm, {r('e / (2 * sqrt(2 * ln(2e0)))')} AS sigma FROM e""")
def more_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = 5 + F.col("p_size") / 2.0
    return rounded(
        t(spark, sf_dir, "part").select(
            "p_partkey", physics.wavevector(e).alias("wavevector"), physics.mono_angle(e).alias("angle"), physics.fwhm_of_sigma(e).alias("fwhm"), physics.sigma_of_fwhm(e).alias("sigma")
        )
    )


@query(f"""WITH s AS (SELECT p_partkey, radians(p_size + 0e0) AS t, radians(p_size / 4e0) AS d FROM part), q AS (SELECT p_partkey, t, cos(d) * cos(t) - 1 AS a, cos(d) * sin(t) AS b, sin(d) AS c FROM s)
    SELECT p_partkey, {r('2 * pi() * 12e0 / 12.398419843320026 * (a * cos(t) - b * sin(t))')} AS qx, {r('2 * pi() * 12e0 / 12.398419843320026 * (a * sin(t) + b * cos(t))')} AS qy, {r('2 * pi() * 12e0 / 12.398419843320026 * c')} AS qz,
    {r('2 * pi() * 12e0 / 12.398419843320026 * sqrt(a * a + b * b + c * c)')} AS q FROM q""")
def scattering_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    v = crystal.scattering_vector(size, size / 4, 12.0)
    turned = crystal.rotated(v, (0, 0, 1), size)
    return rounded(t(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for c, n in zip(turned, ("qx", "qy", "qz"), strict=True)], crystal.norm(v).alias("q")))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'cubic' WHEN p_size % 4 = 1 THEN 'tetragonal' WHEN p_size % 4 = 2 THEN 'hexagonal' ELSE 'monoclinic' END AS system,
    round(CASE WHEN p_size % 4 = 0 THEN 27e0 WHEN p_size % 4 = 1 THEN 45e0 WHEN p_size % 4 = 2 THEN 45e0 * sqrt(0.75e0) ELSE 60e0 * sin(radians(100e0)) END, 6) + 0.0 AS volume FROM part""")
def crystal_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    which = F.col("p_size") % 4
    pick = lambda *v: F.element_at(F.array(*[F.lit(float(x)) for x in v]), which + 1)
    cell = (pick(3, 3, 3, 3), pick(3, 3, 3, 4), pick(3, 5, 5, 5), pick(90, 90, 90, 90), pick(90, 90, 90, 100), pick(90, 90, 120, 90))
    return rounded(t(spark, sf_dir, "part").select("p_partkey", crystal.crystal_system(*cell).alias("system"), crystal.cell_volume(*cell).alias("volume")))


@query(f"""SELECT p_partkey, {r('12.398419843320026 / (2 * 3.1356e0 * sin(radians(p_size)))')} AS energy, {r('sin(0.5e0 + p_size / 200e0) / sin(0.5e0 - p_size / 200e0)')} AS magnification,
    {r('p_size / 200e0')} AS miscut, CAST(p_size // gcd(gcd(p_size, 12), 18) AS BIGINT) AS h, CAST(12 // gcd(gcd(p_size, 12), 18) AS BIGINT) AS k, CAST(18 // gcd(gcd(p_size, 12), 18) AS BIGINT) AS l FROM part""")
def crystal_optics(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("double")
    mag = crystal.magnification(size / 200, 0.5)
    h, k, l = crystal.reduce_indices(F.col("p_size").cast("long"), F.lit(12).cast("long"), F.lit(18).cast("long"))  # noqa: E741
    own = t(spark, sf_dir, "part").select(
        "p_partkey", crystal.mono_energy(size).alias("energy"), mag.alias("magnification"), crystal.miscut(mag, 0.5).alias("miscut"), h.alias("h"), k.alias("k"), l.alias("l")
    )
    return rounded(own)


@query(f"""WITH {CRYSTALS}, {INDICES}, d AS (SELECT p_partkey, energy, h, k, l, 1 / sqrt((h * h + k * k + l * l) / a ** 2) AS e FROM crystals CROSS JOIN indices),
    n AS (SELECT *, round(e, 6) AS d, row_number() OVER (PARTITION BY p_partkey, round(e, 6) ORDER BY h DESC, k DESC, l DESC) AS o, count(*) OVER (PARTITION BY p_partkey, round(e, 6)) AS multiplicity FROM d)
    SELECT p_partkey, d, h, k, l, multiplicity, {r('degrees(2 * asin(12.398419843320026 / energy / (2 * e)))')} AS two_theta FROM n WHERE o = 1 AND 12.398419843320026 / energy / (2 * e) <= 1""")
def reflection_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's reflections by spacing."""
    return rounded(crystal.families(physics.reflections(crystals(spark, sf_dir), ("p_partkey",), "F", 2), ("p_partkey",)))


RANKED = "ranked AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY x) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM daily)"


@query(f"""WITH {DAILY}, {RANKED}, k AS (SELECT j, exp(-0.5 * (j / 2e0) ** 2) AS g FROM range(-8, 9) t(j))
    SELECT a.event_type, a.x, {r('sum(b.y * g) / sum(g)')} AS smooth FROM ranked a CROSS JOIN k JOIN ranked b ON b.event_type = a.event_type AND b.i = least(greatest(a.i + j, 1), a.n) GROUP BY ALL""")
def smooth_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.smooth(daily(spark, sf_dir), "gaussian", 2.0, by=("event_type",)).select("event_type", "x", "smooth"))


@query(f"""WITH {DAILY}, {RANKED} SELECT a.event_type, a.x, {r('median(b.y)')} AS smooth FROM ranked a CROSS JOIN range(-2, 3) t(j)
    JOIN ranked b ON b.event_type = a.event_type AND b.i = least(greatest(a.i + j, 1), a.n) GROUP BY ALL""")
def smooth_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.smooth(daily(spark, sf_dir), "median", 4.0, by=("event_type",)).select("event_type", "x", "smooth"))


@query(f"""WITH {DAILY}, {RANKED}, k(p, c) AS (VALUES (0, [31, 9, -3, -5, 3]), (1, [9, 13, 12, 6, -5]), (2, [-3, 12, 17, 12, -3]), (3, [-5, 6, 12, 13, 9]), (4, [3, -5, -3, 9, 31])),
    f AS (SELECT *, least(greatest(i - 2, 1), n - 4) AS s FROM ranked)
    SELECT a.event_type, a.x, {r('sum(b.y * c[b.i - s + 1]) / 35')} AS smooth FROM f a JOIN k ON p = a.i - s JOIN ranked b ON b.event_type = a.event_type AND b.i BETWEEN s AND s + 4 GROUP BY ALL""")
def smooth_polynomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.smooth(daily(spark, sf_dir), "savitzky-golay", 5.0, 2, by=("event_type",)).select("event_type", "x", "smooth"))


@query(f"""WITH {DAILY}, {RANKED}, b AS (SELECT * FROM ranked WHERE i <= greatest(n // 10, 2) OR i > n - greatest(n // 10, 2)), c AS (SELECT event_type, avg(x) AS c FROM b GROUP BY ALL),
    m AS (SELECT event_type, any_value(c) AS c, count(*) AS a, sum((x - c) ** 2) AS s2, sum((x - c) ** 3) AS s3, sum((x - c) ** 4) AS s4, sum(y) AS t0, sum(y * (x - c)) AS t1, sum(y * (x - c) ** 2) AS t2 FROM b JOIN c USING (event_type) GROUP BY event_type),
    d AS (SELECT *, a * (s2 * s4 - s3 * s3) - s2 * s2 * s2 AS det FROM m),
    p AS (SELECT event_type, c, (t0 * (s2 * s4 - s3 * s3) + s2 * (t1 * s3 - s2 * t2)) / det AS p0, (a * (t1 * s4 - s3 * t2) + s2 * (t0 * s3 - t1 * s2)) / det AS p1, (a * (s2 * t2 - s3 * t1) - s2 * s2 * t0) / det AS p2 FROM d)
    SELECT event_type, x, {r('p0 + p1 * (x - c) + p2 * (x - c) ** 2', 4)} AS background, {r('y - (p0 + p1 * (x - c) + p2 * (x - c) ** 2)', 4)} AS net FROM daily JOIN p USING (event_type)""")
def background_polynomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.polynomial_background(daily(spark, sf_dir), 2, by=("event_type",)).select("event_type", "x", "background", "net"), 4)


@query(f"""WITH {DAILY}, b AS (SELECT event_type, avg(y) AS b FROM daily WHERE x BETWEEN 0 AND 4 OR x BETWEEN 20 AND 26 GROUP BY ALL) SELECT event_type, x, {r('b')} AS background, {r('y - b')} AS net FROM daily JOIN b USING (event_type)""")
def background_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.polynomial_background(daily(spark, sf_dir), 0, ((0, 4), (26, 20)), ("event_type",)).select("event_type", "x", "background", "net"))


@query(f"""WITH {DAILY}, {RANKED}, l AS (SELECT *, lag(y) OVER w AS a, lead(y) OVER w AS b, x - lag(x) OVER w AS dx FROM ranked WINDOW w AS (PARTITION BY event_type ORDER BY x)),
    s AS (SELECT event_type, median(dx) AS step FROM l GROUP BY ALL), m AS (SELECT * FROM l WHERE y > a AND y > b),
    e AS (SELECT m.event_type, m.i, any_value(m.x) AS x, any_value(m.y) AS y, coalesce(max(r.i) FILTER (r.i < m.i AND r.y > m.y), 0) AS low, coalesce(min(r.i) FILTER (r.i > m.i AND r.y > m.y), any_value(m.n) + 1) AS high
        FROM m JOIN ranked r USING (event_type) GROUP BY m.event_type, m.i),
    p AS (SELECT e.event_type, e.i, any_value(e.x) AS x, any_value(e.y) AS y, any_value(e.y) - greatest(min(r.y) FILTER (r.i <= e.i AND r.i > low), min(r.y) FILTER (r.i >= e.i AND r.i < high)) AS prominence
        FROM e JOIN ranked r USING (event_type) GROUP BY e.event_type, e.i),
    f AS (SELECT *, y - prominence / 2 AS level, row_number() OVER (PARTITION BY event_type ORDER BY prominence DESC, x) AS o FROM p),
    j AS (SELECT f.event_type, f.i, any_value(f.x) AS x, any_value(f.y) AS height, any_value(prominence) AS prominence, any_value(level) AS level, max(r.i) FILTER (r.i < f.i AND r.y <= level) AS l, min(r.i) FILTER (r.i > f.i AND r.y <= level) AS h
        FROM f JOIN ranked r USING (event_type) WHERE o <= 5 GROUP BY f.event_type, f.i)
    SELECT j.event_type, j.x, {r('height')} AS height, {r('prominence')} AS prominence, {r('((h - (level - c.y) / (d.y - c.y)) - (l + (level - a.y) / (b.y - a.y))) * step')} AS fwhm FROM j JOIN s USING (event_type)
    JOIN ranked a ON a.event_type = j.event_type AND a.i = l JOIN ranked b ON b.event_type = j.event_type AND b.i = l + 1 JOIN ranked c ON c.event_type = j.event_type AND c.i = h JOIN ranked d ON d.event_type = j.event_type AND d.i = h - 1""")
def prominent_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.prominent_peaks(daily(spark, sf_dir), 5, ("event_type",)))


@query(f"""WITH {DAILY}, g AS (SELECT *, exp(-0.5 * ((x - 12) / 5) ** 2) AS g FROM daily), a AS (SELECT *, 0.5 * (x - lag(x) OVER w) * (g + lag(g) OVER w) AS t FROM g WINDOW w AS (PARTITION BY event_type ORDER BY x))
    SELECT event_type, x, {r('g / sum(t) OVER (PARTITION BY event_type)')} AS profile FROM a""")
def unit_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(curves.unit_gaussian(daily(spark, sf_dir), 5.0, 12.0, ("event_type",)).select("event_type", "x", "profile"))


MOTORS = """motors AS (SELECT l_quantity AS mu, 2 * l_quantity + 1 AS encoder, l_discount AS phi, 100 * l_discount AS steps, l_tax AS chi, 7e0 AS energy, l_tax * 1e-6 AS drift FROM lineitem)"""


def motor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with motors, an encoder, a unit of steps, a fixed energy and a drift."""
    return t(spark, sf_dir, "lineitem").selectExpr(
        "l_quantity AS mu", "2 * l_quantity + 1 AS encoder", "l_discount AS phi", "100 * l_discount AS steps", "l_tax AS chi", "7d AS energy", "l_tax * 1e-6 AS drift"
    )


@query(f"""WITH {MOTORS}, u AS (UNPIVOT motors ON mu, phi, chi, energy, drift INTO NAME motor VALUE v) SELECT motor, min(v) AS low, max(v) AS high FROM u GROUP BY motor
    HAVING max(v) - min(v) > CASE motor WHEN 'phi' THEN 0.5 ELSE 1e-6 END""")
def moving_motors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.moving(motor_rows(spark, sf_dir), {"mu": 0.0, "phi": 0.5, "chi": 0.0, "energy": 0.0, "drift": 0.0})


@query(f"""WITH {MOTORS}, c AS (SELECT count(DISTINCT mu) AS a, count(DISTINCT encoder) AS b, count(DISTINCT (mu, encoder)) AS ab, count(DISTINCT phi) AS p, count(DISTINCT steps) AS s, count(DISTINCT (phi, steps)) AS ps FROM motors)
    SELECT unnest(['mu', 'encoder', 'phi', 'steps', 'chi']) AS motor, unnest(['mu', CASE WHEN a = ab AND b = ab THEN 'mu' ELSE 'encoder' END, 'phi', CASE WHEN p = ps AND s = ps THEN 'phi' ELSE 'steps' END, 'chi']) AS leader FROM c""")
def lockstep_motors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.lockstep(motor_rows(spark, sf_dir), ("mu", "encoder", "phi", "steps", "chi"))


@query(f"""WITH {CELLS} SELECT vec_id, x, {r('avg(v)')} AS v FROM cells WHERE y >= 1 AND y < 6 AND x >= 2 GROUP BY vec_id, x""")
def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(imaging.profile(pixels(spark, sf_dir), "v", "x", (1, 6, 2, 8), "mean", ("vec_id",)))


@query(f"""WITH {CELLS}, s AS (SELECT CAST(k AS INTEGER) AS point, k / 9e0 * sqrt(5.5e0 ** 2 + 5 ** 2) AS distance, least(greatest(1 + k / 9e0 * 5 + o * 5.5e0 / sqrt(5.5e0 ** 2 + 5 ** 2), 0), 7) AS ys,
    least(greatest(0.5e0 + k / 9e0 * 5.5e0 - o * 5 / sqrt(5.5e0 ** 2 + 5 ** 2), 0), 7) AS xs FROM range(10) a(k), range(-1, 2) b(o))
    SELECT vec_id, point, {r('distance')} AS distance, {r('sum(v * (1 - abs(ys - y)) * (1 - abs(xs - x))) / 3')} AS v FROM cells JOIN s ON abs(ys - y) < 1 AND abs(xs - x) < 1 GROUP BY vec_id, point, distance""")
def line_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(imaging.line_profile(pixels(spark, sf_dir), "v", (1.0, 0.5), (6.0, 6.0), 8, 8, 3, 10, ("vec_id",)))


@query(f"""WITH {CELLS}, m AS (SELECT vec_id, avg(w) AS m FROM cells WHERE y >= 1 AND y < 5 AND x >= 2 AND x < 8 GROUP BY vec_id) SELECT vec_id, y, x, {r('w / m')} AS v FROM cells JOIN m USING (vec_id)""")
def normalize_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(processing.normalize_box(pixels(spark, sf_dir, True), (1, 5, 2, 8), "vec_id").select("vec_id", "y", "x", "v"))


@query(f"""WITH e(i, e, m) AS (VALUES (1, 5000e0, 140e0), (2, 7112e0, 53e0), (3, 7112e0, 407e0), (4, 20000e0, 25.7e0), (5, 30000e0, 8.2e0)), p AS (SELECT p_partkey, (p_size + 1) * 1e3 AS u FROM part),
    n AS (SELECT p_partkey, u, count(*) FILTER (e <= u) AS k FROM p, e GROUP BY ALL), v AS (SELECT p_partkey, CASE WHEN k = 0 THEN 140e0 WHEN k = 5 THEN 8.2e0 ELSE exp(ln(a.m) + ln(u / a.e) / ln(b.e / a.e) * ln(b.m / a.m)) END AS mass
        FROM n LEFT JOIN e a ON a.i = k LEFT JOIN e b ON b.i = k + 1)
    SELECT p_partkey, {r('mass')} AS mass, {r('1e4 / (mass * 7.874e0)')} AS length FROM v""")
def attenuation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = [(5000.0, 140.0), (7112.0, 53.0), (7112.0, 407.0), (20000.0, 25.7), (30000.0, 8.2)]
    e = F.col("p_size").cast("double") + 1
    return rounded(t(spark, sf_dir, "part").select("p_partkey", physics.mass_attenuation(e, entries).alias("mass"), physics.attenuation_length(e, entries, 7.874).alias("length")))


@query(f"""WITH g AS (SELECT k, 2 * sqrt(2 * ln(2e0)) AS f FROM range(21) t(k)), e AS (SELECT p_partkey, 8 + p_partkey % 7 + (k - 10) / 10e0 * 3 * (p_size / 100e0) / f AS energy,
    exp(-0.5 * ((k - 10) / 10e0 * 3) ** 2) * CASE WHEN k IN (0, 20) THEN 0.5e0 ELSE 1e0 END AS w FROM g CROSS JOIN part WHERE p_size IS NOT NULL)
    SELECT p_partkey, {r('energy')} AS energy, {r('w / sum(w) OVER (PARTITION BY p_partkey)')} AS weight FROM e""")
def energy_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spectrum of a beam for each part, whose width follows its size."""
    beams = crystals(spark, sf_dir).select("p_partkey", F.col("energy").alias("e0"), ((F.col("a") - 3) / 10).alias("fwhm"))
    return rounded(physics.energy_grid(beams, ("p_partkey",)))


@query(f"""SELECT p_partkey, {r('p_size ** 0.3e0')} AS first, {r('p_size ** 0.7e0')} AS second FROM part""")
def magnification_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = crystal.mag_split(F.col("p_size").cast("double"), 0.3)
    return rounded(t(spark, sf_dir, "part").select("p_partkey", first.alias("first"), second.alias("second")))


def two_peaks(spark: SparkSession, sf_dir: str, shape: str) -> DataFrame:
    """For each part the curve of two peaks on a sloping line at x = 0, 0.5, ... 40, with parameters from the part's size and key."""
    size, key = F.col("p_size") / 50.0, (F.col("p_partkey") % 20) / 20.0

    def peak(centre, width, height):
        return lambda x: height * (F.exp(-4 * math.log(2) * F.pow((x - centre) / width, F.lit(2))) if shape == "gaussian" else 1 / (1 + 4 * F.pow((x - centre) / width, F.lit(2))))

    a, b = peak(10 + 2 * size, 3 + key, 50 + 10 * size), peak(26 + 2 * key, 4 + size, 30 + 10 * key)
    x = F.sequence(F.lit(0), F.lit(80))
    y = F.transform(x, lambda i: a(i / 2.0) + b(i / 2.0) + 5 + 0.1 * (i / 2.0 - 20))
    return parts(spark, sf_dir).select("p_partkey", y.alias("y"))


TWO_PEAKS = """WITH p AS (SELECT p_partkey, p_size / 50e0 AS s, (p_partkey % 20) / 20e0 AS k FROM part)
    SELECT p_partkey, round(10 + 2 * s, 3) AS p0_centre, round(3 + k, 3) AS p0_fwhm, round(50 + 10 * s, 3) AS p0_height, round(26 + 2 * k, 3) AS p1_centre, round(4 + s, 3) AS p1_fwhm, round(30 + 10 * k, 3) AS p1_height,
    5e0 AS c0, 0.1e0 AS c1, true AS success FROM p"""


@query(TWO_PEAKS)
def fit_two_gaussians(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = fitting.fit_models(two_peaks(spark, sf_dir, "gaussian"), "p_partkey", [i / 2 for i in range(81)], ("gaussian", "gaussian"), "linear")
    return rounded(fitted.select([c for c in fitted.columns if not c.endswith("_err") and c != "r2"]), 3)


@query(TWO_PEAKS)
def fit_two_lorentzians(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = fitting.fit_models(two_peaks(spark, sf_dir, "lorentzian"), "p_partkey", [i / 2 for i in range(81)], ("lorentzian", "lorentzian"), "linear")
    return rounded(fitted.select([c for c in fitted.columns if not c.endswith("_err") and c != "r2"]), 3)
