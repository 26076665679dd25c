"""Queries of grids, density clusters, registration and stitching, each with the SQL that must give the same rows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanweave import model
from scanweave.operators import clusters, curves, fitting, grids, imaging, omega, powder, registration, scan_tables, scans, spots, stitching
from scanweave.plans.queries import CELLS, DAILY, IMAGE, daily, images, parts, pixels, query, r, rounded, t
from scanweave.sources import formats
from scanweave.streaming import runs

V = F.col

# Grids from readbacks that jitter


MOTORS = """frames AS (SELECT l_suppkey AS scan, (l_orderkey * 8 + l_linenumber) * 10000000 + CAST(round(l_extendedprice * 100) AS BIGINT) AS frame,
    l_quantity + (l_orderkey * 7919 + l_linenumber * 104729) % 1000 / 50021.0 AS slow,
    round(l_discount * 100) + (l_orderkey * 7907 + l_linenumber * 104723) % 1000 / 250007.0 AS fast FROM lineitem)"""
#: The grid points of all motors, then the frames with both indices.
AXES = """long AS (SELECT scan, frame, 'slow' AS motor, slow AS value FROM frames UNION ALL SELECT scan, frame, 'fast', fast FROM frames),
    tols AS (SELECT scan, motor, CASE WHEN max(value) > min(value) THEN (max(value) - min(value)) * 1e-3 ELSE 1e-6 END AS tol FROM long GROUP BY ALL),
    steps AS (SELECT scan, frame, motor, value, CASE WHEN value - lag(value) OVER (PARTITION BY scan, motor ORDER BY value) > tol THEN 1 ELSE 0 END AS new
        FROM long JOIN tols USING (scan, motor)),
    labels AS (SELECT scan, frame, motor, value, CAST(sum(new) OVER (PARTITION BY scan, motor ORDER BY value) AS INTEGER) AS i FROM steps),
    axes AS (SELECT scan, motor, i AS "index", avg(value) AS centre, count(*) AS n FROM labels GROUP BY ALL),
    points AS (SELECT s.scan, s.frame, s.i AS slow_index, f.i AS fast_index FROM labels s JOIN labels f ON s.scan = f.scan AND s.frame = f.frame
        AND s.motor = 'slow' AND f.motor = 'fast')"""
CHANGES = """moved AS (SELECT scan, slow_index <> lag(slow_index) OVER w AS s, fast_index <> lag(fast_index) OVER w AS f FROM points WINDOW w AS (PARTITION BY scan ORDER BY frame)),
    changed AS (SELECT scan, 'slow' AS motor, 1 AS given, CAST(count_if(s) AS BIGINT) AS changes FROM moved GROUP BY scan UNION ALL SELECT scan, 'fast', 2, CAST(count_if(f) AS BIGINT) FROM moved GROUP BY scan)"""


def jittery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two motors for each line item: a supplier's items are a scan, quantity and discount the motors, with an encoder's noise."""
    a, b = V("l_orderkey"), V("l_linenumber")
    frame = (a * 8 + b) * 10000000 + F.round(V("l_extendedprice") * 100).cast("long")
    slow = V("l_quantity") + (a * 7919 + b * 104729) % 1000 / 50021.0
    fast = F.round(V("l_discount") * 100) + (a * 7907 + b * 104723) % 1000 / 250007.0
    return t(spark, sf_dir, "lineitem").select(V("l_suppkey").alias("scan"), frame.alias("frame"), slow.alias("slow"), fast.alias("fast"))


def supplier_grids(spark: SparkSession, sf_dir: str) -> grids.Grid:
    return grids.detect(jittery(spark, sf_dir), ("slow", "fast"), "frame", by=("scan",))


@query(f"WITH {MOTORS}, {AXES} SELECT scan, motor, \"index\", {r('centre')} AS centre, n FROM axes")
def grid_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coordinates of each supplier's grid."""
    return rounded(supplier_grids(spark, sf_dir).axes)


@query(f"""WITH {MOTORS}, {AXES}, {CHANGES} SELECT scan, motor, CAST(row_number() OVER (PARTITION BY scan ORDER BY changes, given) - 1 AS INTEGER) AS dim, size, changes
    FROM changed JOIN (SELECT scan, motor, CAST(count(*) AS INTEGER) AS size FROM axes GROUP BY ALL) USING (scan, motor)""")
def grid_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which motor is slow, by how often each changes."""
    return supplier_grids(spark, sf_dir).dims


@query(f"WITH {MOTORS}, {AXES} SELECT scan, slow_index, fast_index, min(frame) AS frame, count(*) AS n FROM points GROUP BY ALL")
def grid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first frame at each grid point."""
    return supplier_grids(spark, sf_dir).positions()


@query(f"""WITH {MOTORS}, {AXES} SELECT s.scan, s."index" AS slow_index, f."index" AS fast_index FROM axes s JOIN axes f ON s.scan = f.scan AND s.motor = 'slow' AND f.motor = 'fast'
    WHERE NOT EXISTS (SELECT 1 FROM points p WHERE p.scan = s.scan AND p.slow_index = s."index" AND p.fast_index = f."index")""")
def grid_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid points without a frame."""
    return supplier_grids(spark, sf_dir).holes()


@query(f"""WITH {MOTORS}, {AXES}, taken AS (SELECT scan, slow_index, fast_index, count(*) AS n FROM points GROUP BY ALL),
    a AS (SELECT scan, count(*) AS occupied, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM taken GROUP BY scan),
    s AS (SELECT scan, count(*) FILTER (motor = 'slow') * count(*) FILTER (motor = 'fast') AS size FROM axes GROUP BY scan)
    SELECT scan, size, occupied, size - occupied AS missing, duplicates FROM a JOIN s USING (scan)""")
def grid_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_grids(spark, sf_dir).summary()


@query(f"""WITH frames AS (SELECT 0 AS scan, event_id AS frame, event_id // 100 + event_id * 7919 % 1000 / 100003.0 AS slow, event_id % 100 + event_id * 7907 % 1000 / 100003.0 AS fast FROM events),
    {AXES}, {CHANGES}, d AS (SELECT motor, CAST(row_number() OVER (ORDER BY changes, given) - 1 AS INTEGER) AS dim, changes FROM changed)
    SELECT motor, "index", {r('centre')} AS centre, n, dim, changes FROM axes JOIN d USING (motor)""")
def grid_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan of all events; tolerances are given, and changes are counted in blocks of frames."""
    e = V("event_id")
    frames = t(spark, sf_dir, "events").select(
        e.alias("frame"), (F.floor(e / 100) + e * 7919 % 1000 / 100003.0).alias("slow"), (e % 100 + e * 7907 % 1000 / 100003.0).alias("fast")
    )
    grid = grids.detect(frames, ("fast", "slow"), "frame", block=1000)
    return rounded(grid.axes.join(grid.dims.select("motor", "dim", "changes"), "motor"))


@query("""SELECT o_orderkey AS frame, CAST(o_orderkey // 50 // 20 AS INTEGER) AS z_index, CAST(o_orderkey // 20 % 50 AS INTEGER) AS y_index,
    CAST(CASE WHEN o_orderkey // 20 % 2 = 1 THEN 19 - o_orderkey % 20 ELSE o_orderkey % 20 END AS INTEGER) AS x_index FROM orders""")
def grid_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series of frames as the serpentine raster that it was."""
    series = t(spark, sf_dir, "orders").select(V("o_orderkey").alias("frame"), V("o_orderkey").alias("frame_index"))
    return grids.split(series, "frame", {"z": 1 << 30, "y": 50, "x": 20}, snake=True)


# Density clusters


@query("""WITH RECURSIVE m AS (SELECT avg(p_retailprice) AS am, stddev_pop(p_retailprice) AS asd, avg(p_size) AS bm, stddev_pop(p_size) AS bsd FROM part),
    p AS (SELECT p_partkey AS id, (p_retailprice - am) / asd AS a, (p_size - bm) / bsd AS b FROM part, m),
    near AS (SELECT p.id, q.id AS other FROM p JOIN p q ON q.a BETWEEN p.a - 0.081 AND p.a + 0.081 AND q.b BETWEEN p.b - 0.081 AND p.b + 0.081
        AND (p.a - q.a) ** 2 + (p.b - q.b) ** 2 <= 0.08 ** 2),
    core AS (SELECT id FROM near GROUP BY id HAVING count(*) >= 4),
    edges AS (SELECT id, other FROM near WHERE id IN (FROM core) AND other IN (FROM core)),
    reach AS (SELECT id, id AS root FROM core UNION SELECT e.other, reach.root FROM reach JOIN edges e ON e.id = reach.id WHERE reach.root < e.other),
    rooted AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
    SELECT p.id AS p_partkey, coalesce(any_value(own.root), min(r.root), -1) AS cluster FROM p LEFT JOIN rooted own ON own.id = p.id
    LEFT JOIN near ON near.id = p.id LEFT JOIN rooted r ON r.id = near.other GROUP BY p.id""")
def dbscan_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters of the parts by price and size, both standardised."""
    return clusters.dbscan(t(spark, sf_dir, "part"), "p_partkey", "p_retailprice", "p_size", eps=0.08, min_samples=4)


# Stitching


CURVES = f"""{DAILY}, ranked AS (SELECT event_type, x, y, dense_rank() OVER (ORDER BY event_type) - 1 AS k FROM daily),
    c AS (SELECT k % 2 AS series, k, x + 20 * k AS x, y * (k + 1) AS y, sqrt(abs(y)) AS sigma FROM ranked UNION ALL
        SELECT 2, k, x + 20 * k + 0.25, y / (k + 2), sqrt(abs(y)) FROM ranked),
    ends AS (SELECT series, k, min(x) AS first, max(x) AS last FROM c GROUP BY ALL)"""
SHIFTED = f"""{CURVES},
    links AS (SELECT b.series, b.k, arg_max(a.k, a.last) AS ref, max(a.last) AS reach FROM ends b JOIN ends a ON a.series = b.series AND a.first < b.first GROUP BY ALL),
    near AS (SELECT l.series, l.k, p.x, p.y, max(q.x) FILTER (q.x <= p.x) AS xa, min(q.x) FILTER (q.x >= p.x) AS xb, l.ref FROM links l
        JOIN c p ON p.series = l.series AND p.k = l.k AND p.x <= l.reach JOIN c q ON q.series = l.series AND q.k = l.ref GROUP BY ALL),
    ratios AS (SELECT n.series, n.k, n.ref, avg(CASE WHEN n.xa = n.xb THEN a.y ELSE a.y + (n.x - n.xa) / (n.xb - n.xa) * (b.y - a.y) END) / avg(n.y) AS ratio
        FROM near n JOIN c a ON a.series = n.series AND a.k = n.ref AND a.x = n.xa JOIN c b ON b.series = n.series AND b.k = n.ref AND b.x = n.xb
        GROUP BY ALL),
    factors AS (SELECT series, k, 1.0::DOUBLE AS f FROM ends e WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.series = e.series AND l.k = e.k)
        UNION ALL SELECT l.series, l.k, coalesce(f.f * r.ratio, 1) FROM factors f JOIN links l ON l.series = f.series AND l.ref = f.k
        LEFT JOIN ratios r ON r.series = l.series AND r.k = l.k)"""


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily curves of all event types as scans of neighbouring ranges, in three series: two whose curves don't meet, one whose do."""
    own = daily(spark, sf_dir)
    kinds = own.select("event_type").distinct().select("event_type", (F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("event_type")) - 1).alias("k"))
    ranked = own.join(kinds, "event_type").withColumn("sigma", F.sqrt(F.abs("y")))
    x = V("x") + 20 * V("k")
    apart = ranked.select((V("k") % 2).alias("series"), "k", x.alias("x"), (V("y") * (V("k") + 1)).alias("y"), "sigma")
    return apart.unionByName(ranked.select(F.lit(2).alias("series"), "k", (x + 0.25).alias("x"), (V("y") / (V("k") + 2)).alias("y"), "sigma"))


@query(f"WITH RECURSIVE {SHIFTED} SELECT CAST(series AS INTEGER) AS series, CAST(k AS INTEGER) AS k, {r('f', 7)} AS factor FROM factors")
def stitch_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each curve is multiplied by, along the chain of overlaps."""
    return rounded(stitching.curve_factors(neighbours(spark, sf_dir), "k", ("series",)).select("series", "k", "factor"), 7)


@query(f"""WITH RECURSIVE {SHIFTED} SELECT CAST(series AS INTEGER) AS series, x, {r('avg(y * f)', 4)} AS y, {r('sqrt(sum((sigma * abs(f)) ** 2)) / count(*)', 4)} AS sigma
    FROM c JOIN factors USING (series, k) GROUP BY series, x""")
def stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One curve from those of all event types, overlaps averaged."""
    return rounded(stitching.stitch(neighbours(spark, sf_dir), "k", ("series",)), 4)


@query(f"""WITH RECURSIVE {SHIFTED} SELECT CAST(series AS INTEGER) AS series, x, {r('y * f', 4)} AS y, {r('sigma * abs(f)', 4)} AS sigma FROM c JOIN factors USING (series, k)
    LEFT JOIN links USING (series, k) WHERE reach IS NULL OR x > reach""")
def stitch_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stitching.stitch(neighbours(spark, sf_dir), "k", ("series",), overlap="first"), 4)


@query(f"""WITH {CURVES}
    SELECT CAST(c.series AS INTEGER) AS series, c.x, {r('y')} AS y, {r('sigma')} AS sigma FROM c
    WHERE NOT EXISTS (SELECT 1 FROM ends e JOIN ends o ON o.series = e.series AND o.k = c.k WHERE e.series = c.series AND e.first > o.first AND e.first <= c.x)""")
def stitch_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where curves overlap, the later one's points, unscaled."""
    return rounded(stitching.stitch(neighbours(spark, sf_dir), "k", ("series",), scale=False, overlap="last"))


VOLUMES = """volumes AS (SELECT CAST(vec_id % 5 AS INTEGER) AS scan, vec_id // 5 AS i, CAST(p // 8 AS INTEGER) AS y, CAST(p % 8 AS INTEGER) AS x, v FROM
    (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS p FROM embeddings)),
    placed AS (SELECT scan, i + scan * 37 AS i, y, x, v FROM volumes)"""


def volumes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Five scans of frames, and where each begins."""
    own = pixels(spark, sf_dir).select((V("vec_id") % 5).cast("int").alias("scan"), F.floor(V("vec_id") / 5).alias("i"), "y", "x", "v")
    offsets = own.select("scan").distinct().withColumn("offset", V("scan").cast("long") * 37)
    return own, offsets


@query(f"WITH {VOLUMES} SELECT i, y, x, {r('avg(v)')} AS v FROM placed GROUP BY ALL")
def stitch_frames_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stitching.stitch_along_axis(*volumes(spark, sf_dir), "scan", "i", "mean"))


@query(f"WITH {VOLUMES} SELECT i, y, x, max(v) AS v FROM placed GROUP BY ALL")
def stitch_frames_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stitching.stitch_along_axis(*volumes(spark, sf_dir), "scan", "i", "max")


@query(f"""WITH {VOLUMES}, totals AS (SELECT scan, i, sum(v) AS total FROM placed GROUP BY ALL), best AS (SELECT i, arg_max(scan, total) AS scan FROM totals GROUP BY i)
    SELECT i, y, x, v FROM placed JOIN best USING (scan, i)""")
def stitch_frames_brightest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At each place the frame of the scan that is brightest there."""
    return stitching.stitch_along_axis(*volumes(spark, sf_dir), "scan", "i", "brightest")


AXIS = """points AS (SELECT CAST(l_suppkey AS BIGINT) AS scan, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS i FROM lineitem),
    axis AS (SELECT scan, i, 5 + 0.25 * ((scan * 7 + 3) % 11 + i) AS a FROM points)"""


@query(f"""WITH {AXIS}, s AS (SELECT scan, min_by(a, i) AS start FROM axis GROUP BY scan), f AS (SELECT start AS origin FROM s ORDER BY scan LIMIT 1),
    o AS (SELECT scan, CAST(round_even((start - origin) / 0.25, 0) AS BIGINT) AS k FROM s, f) SELECT scan, k - min(k) OVER () AS "offset" FROM o""")
def overlap_by_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each supplier's scan begins on the first one's axis."""
    order = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_extendedprice"))
    own = t(spark, sf_dir, "lineitem").select(V("l_suppkey").cast("long").alias("scan"), order.alias("i"))
    axis = own.withColumn("a", 5 + 0.25 * ((V("scan") * 7 + 3) % 11 + V("i")))
    return stitching.overlap_by_axis(axis, "scan", "i", "a", tolerance=0.01)


# Registration


SCORES = """own AS (SELECT label, vec_id, [CAST(v AS DOUBLE) FOR v IN embedding] AS p, min(vec_id) OVER (PARTITION BY label) AS first,
        lag([CAST(v AS DOUBLE) FOR v IN embedding]) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings),
    pairs AS (SELECT a.label, a.vec_id, a.p, {against} AS q FROM own a JOIN own f ON f.label = a.label AND f.vec_id = a.first WHERE a.vec_id <> a.first),
    scores AS (SELECT label, vec_id, dy, dx, list_sum([q[i + 1] * p[((i // 8 - dy + 8) % 8) * 8 + (i % 8 - dx + 8) % 8 + 1] FOR i IN range(64)]) AS score
        FROM pairs, (SELECT unnest(range(-3, 4)) AS dy), (SELECT unnest(range(-3, 4)) AS dx)),
    found AS (SELECT label, vec_id, arg_max(dy, score) AS dy, arg_max(dx, score) AS dx FROM scores GROUP BY ALL)"""


def stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "embeddings").select("label", "vec_id", V("embedding").cast("array<double>").alias("pixels"))


@query(f"""WITH {SCORES.format(against='f.p')} SELECT own.label, own.vec_id, CAST(coalesce(dy, 0) AS INTEGER) AS dy, CAST(coalesce(dx, 0) AS INTEGER) AS dx
    FROM own LEFT JOIN found USING (label, vec_id)""")
def stack_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shift that moves each frame onto the first of its label, of at most three pixels."""
    return registration.stack_shifts(stacks(spark, sf_dir), "vec_id", ("label",), 8, 8, 3)


@query(f"""WITH {SCORES.format(against='a.before')} SELECT own.label, own.vec_id, CAST(coalesce(sum(dy) OVER w, 0) AS INTEGER) AS dy, CAST(coalesce(sum(dx) OVER w, 0) AS INTEGER) AS dx
    FROM own LEFT JOIN found USING (label, vec_id) WINDOW w AS (PARTITION BY own.label ORDER BY own.vec_id)""")
def stack_shifts_chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shifts against the frame before, added up."""
    return registration.stack_shifts(stacks(spark, sf_dir), "vec_id", ("label",), 8, 8, 3, chained=True)


@query(f"""WITH {SCORES.format(against='f.p')}, whole AS (SELECT own.vec_id, own.p, coalesce(dy, 0) AS dy, coalesce(dx, 0) AS dx, unnest(range(64)) AS i
        FROM own LEFT JOIN found USING (label, vec_id))
    SELECT vec_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x,
        CASE WHEN i // 8 - dy BETWEEN 0 AND 7 AND i % 8 - dx BETWEEN 0 AND 7 THEN p[(i // 8 - dy) * 8 + i % 8 - dx + 1] ELSE 0 END AS v FROM whole""")
def align_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames moved onto the first of their label."""
    return registration.unpacked(registration.align_stack(stacks(spark, sf_dir), "vec_id", ("label",), 8, 8, 3), ("vec_id",), 8)


@query(f"""WITH own AS (SELECT vec_id, [CAST(v AS DOUBLE) FOR v IN embedding] AS p, unnest(range(64)) AS i FROM embeddings),
    shifted AS MATERIALIZED (SELECT vec_id, p, i, i // 8 - 1.25 AS sy, i % 8 + 0.5 AS sx, CAST(floor(i // 8 - 1.25) AS INTEGER) AS y, i % 8 AS x FROM own)
    SELECT vec_id, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, {r('CASE WHEN sy >= 0 AND sx <= 7 THEN 0.25 * (0.5 * p[y * 8 + x + 1] + 0.5 * p[y * 8 + x + 2]) + 0.75 * (0.5 * p[y * 8 + x + 9] + 0.5 * p[y * 8 + x + 10]) END')} AS v
    FROM shifted""")
def shift_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame moved down by one and a quarter pixels and left by half of one; null where that uncovers."""
    out = registration.shift_frames(stacks(spark, sf_dir), 8, 8, 1.25, -0.5)
    return rounded(registration.unpacked(out, ("vec_id",), 8))


@query(f"""WITH scene AS (SELECT (max(vec_id) + 1) // 25 * 8 AS h FROM embeddings), tiles AS (SELECT unnest(range((h - 44) // 32 + 1)) AS row FROM scene),
    p AS (SELECT CAST(row * 5 + col AS INTEGER) AS tile, row * 32 + 2 AS y0, col * 32 + 2 AS x0, (row * 5 + col) * 7 % 5 - 2 AS dy, (row * 5 + col) * 11 % 13 % 5 - 2 AS dx
        FROM tiles, (SELECT unnest(range(5)) AS col))
    SELECT tile, {r('y0 + dy - avg(dy) OVER ()')} AS y0, {r('x0 + dx - avg(dx) OVER ()')} AS x0 FROM p""")
def mosaic_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles cut from one scene a pixel or two beside the stage's positions; their overlaps tell where they were."""
    vectors = t(spark, sf_dir, "embeddings")
    height = vectors.agg(((F.floor((F.max("vec_id") + 1) / 25) * 8 - 44) / 32).cast("int").alias("last"))
    rows = height.select(F.explode(F.sequence(F.lit(0), V("last"))).alias("row"))
    stage = rows.select("row", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("col")).withColumn("tile", V("row") * 5 + V("col"))
    stage = registration.grid_positions(stage, "row", "col", 32, 32).select(F.lit(0).alias("mosaic"), "tile", (V("y0") + 2).alias("y0"), (V("x0") + 2).alias("x0"))
    cut = stage.select("mosaic", "tile", (V("y0") + V("tile") * 7 % 5 - 2).cast("long").alias("ty"), (V("x0") + V("tile") * 11 % 13 % 5 - 2).cast("long").alias("tx"))
    # each tile meets the frames of the scene that it touches, not their pixels one by one; its rows are made, so their number is unknown to Spark
    frames = lambda c: F.explode(F.sequence(F.floor(V(c) / 8), F.floor((V(c) + 39) / 8)))
    met = cut.withColumn("i", frames("ty")).withColumn("j", frames("tx")).filter("i >= 0 AND j BETWEEN 0 AND 24").withColumn("vec_id", V("i") * 25 + V("j"))
    touched = met.hint("merge").join(vectors.select("vec_id", "embedding"), "vec_id")
    seen = model.cells(touched, "embedding", 8, ("mosaic", "tile", "ty", "tx", "i", "j"))
    cells = seen.withColumns({"y": (V("i") * 8 + V("y") - V("ty")).cast("int"), "x": (V("j") * 8 + V("x") - V("tx")).cast("int")}).filter("y BETWEEN 0 AND 39 AND x BETWEEN 0 AND 39")
    tiles = registration.packed(cells.select("mosaic", "tile", "y", "x", "v"), ("mosaic", "tile"), 40)
    return rounded(registration.refined_positions(tiles, stage, "mosaic", "tile", 40, 40, 4).select("tile", "y0", "x0"))


# Tilted detectors and spots


TILTED = powder.TiltedGeometry(100.0, 3.2, 3.7, 5000.0, 10.0, tilt_deg=12.0, tilt_plane_deg=30.0)
TILT = """turn AS (SELECT radians(12e0) AS t, cos(radians(30e0)) AS ux, sin(radians(30e0)) AS uy),
    plane AS (SELECT label, v, (y - 3.2e0) * 5e0 AS py, (x - 3.7e0) * 5e0 AS px, t, ux, uy FROM image, turn),
    lab AS (SELECT label, v, px * (cos(t) + (1 - cos(t)) * ux * ux) + py * (1 - cos(t)) * ux * uy AS lx, px * (1 - cos(t)) * ux * uy + py * (cos(t) + (1 - cos(t)) * uy * uy) AS ly,
        100 + sin(t) * (py * ux - px * uy) AS lz, sin(t) * uy AS nx, -sin(t) * ux AS ny, cos(t) AS nz FROM plane),
    seen AS (SELECT label, v, lz / sqrt(lx * lx + ly * ly + lz * lz) AS cos_tt, atan2(ly, lx) AS chi,
        abs(lx * nx + ly * ny + lz * nz) / sqrt(lx * lx + ly * ly + lz * lz) * 1e4 / (lx * lx + ly * ly + lz * lz) AS solid FROM lab)"""
WAVELENGTH = "(12.398419843320026 / 10e0)"


@query(f"""WITH {IMAGE}, {TILT}, c AS (SELECT label, v, 4 * pi() * sin(acos(cos_tt) / 2) / {WAVELENGTH} AS q,
        solid * 0.5 * (1 + cos_tt ** 2 - 0.95 * cos(2 * chi) * (1 - cos_tt ** 2)) AS c FROM seen),
    e AS (SELECT min(q) AS low, (max(q) - min(q)) / 6 AS step, max(q) AS high FROM c),
    b AS (SELECT label, v, c, CAST(least(floor((q - low) / step), 5) AS INTEGER) AS bin, low, step FROM c, e WHERE q < high)
    SELECT label, bin, {r('any_value(low + (bin + 0.5e0) * step)')} AS x, {r('avg(v / c)')} AS intensity, {r('sqrt(sum(greatest(v, 0) / (c * c))) / count(*)')} AS sigma, count(*) AS n
    FROM b GROUP BY label, bin""")
def integrate_tilted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Powder patterns in q on a tilted detector, with polarisation."""
    return rounded(powder.integrate(images(spark, sf_dir), TILTED, 8, 8, 6, ("label",), "q", polarization_factor=0.95))


@query(f"""WITH {IMAGE}, {TILT}, c AS (SELECT label, v, degrees(acos(cos_tt)) AS tt, degrees(chi) AS chi, solid * 0.5 * (1 + cos_tt ** 2) AS c FROM seen),
    b AS (SELECT label, v / c AS v, CAST(floor((tt - 1.5e0) / 2.5e0) AS INTEGER) AS bin, CAST(least(floor((chi + 180) / 45), 7) AS INTEGER) AS chi_bin FROM c WHERE tt >= 1.5 AND tt < 11.5)
    SELECT label, chi_bin, bin, (chi_bin + 0.5e0) * 45 - 180 AS chi, 1.5e0 + (bin + 0.5e0) * 2.5e0 AS x, {r('avg(v)')} AS intensity, count(*) AS n FROM b GROUP BY label, chi_bin, bin""")
def cake_tilted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images by azimuth and ring, on a tilted detector."""
    return rounded(powder.cake(images(spark, sf_dir), TILTED, 8, 8, 4, 8, ("label",), x_range=(1.5, 11.5)))


SPOT = {"amplitude": "5 + p_size / 10.0", "x0": "5 + p_partkey % 7 / 4.0", "y0": "4 + p_partkey % 11 / 5.0", "sigma_x": "1.2 + p_size % 5 / 8.0", "sigma_y": "0.9 + p_size % 3 / 6.0", "offset": "p_retailprice / 100.0"}


@query(f"SELECT p_partkey, {', '.join(f'{r(e, 5)} AS {n}' for n, e in SPOT.items())}, true AS success FROM part")
def fit_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elliptical Gaussians found again in frames that are drawn from each part's numbers."""
    own = parts(spark, sf_dir).select("p_partkey", *[F.expr(f"CAST({e} AS DOUBLE)").alias(n) for n, e in SPOT.items()])
    value = lambda i: V("amplitude") * F.exp(
        -0.5 * (F.pow((i % 14 - V("x0")) / V("sigma_x"), F.lit(2)) + F.pow((F.floor(i / 14) - V("y0")) / V("sigma_y"), F.lit(2)))
    ) + V("offset")
    drawn = own.select("p_partkey", F.transform(F.sequence(F.lit(0), F.lit(12 * 14 - 1)), value).alias("pixels"))
    return rounded(spots.fit_stack(drawn, ("p_partkey",), 12, 14), 5)


# Layouts of folders, and runs


LAYOUTS = [
    formats.Rule("numbered", files=("[0-9]*",)),
    formats.Rule("dated", files=("*?page=*",), only=("*page=*", "*#*", "[0-9]*")),
    formats.Rule("plain", only=("*",)),
    formats.Rule("mixed", files=("*ref=?", "*#top"), around=("??",)),
]
ENTRIES = """whole AS (SELECT split_part(url, '//', 2) AS p FROM pages), entries AS (SELECT regexp_replace(p, '/[^/]*$', '') AS folder, regexp_extract(p, '[^/]*$') AS name, false AS is_folder FROM whole
    UNION ALL SELECT DISTINCT split_part(p, '/', 1), split_part(p, '/', 2), true FROM whole WHERE len(string_split(p, '/')) > 2)"""


@query(f"""WITH {ENTRIES}, f AS (SELECT folder, bool_or(regexp_full_match(name, '[0-9].*') AND NOT is_folder) AS numbered, bool_or(regexp_full_match(name, '.*.page=.*') AND NOT is_folder) AS paged,
        bool_and(is_folder OR regexp_full_match(name, '.*page=.*|.*#.*|[0-9].*')) AS dated, bool_or(regexp_full_match(name, '.*ref=.') AND NOT is_folder) AS ref,
        bool_or(regexp_full_match(name, '.*#top') AND NOT is_folder) AS top, bool_or(length(name) = 2) AS two FROM entries GROUP BY folder),
    u AS (SELECT f.folder, f.numbered, f.paged, f.dated, f.ref, f.top, bool_or(p.two) AS near FROM f JOIN f p ON p.folder = f.folder OR starts_with(f.folder, p.folder || '/') GROUP BY ALL),
    s AS (SELECT folder, unnest([{{'rule': 'numbered', 'score': numbered::INT::DOUBLE, 'specificity': 1}}, {{'rule': 'dated', 'score': (paged::INT + dated::INT) / 2, 'specificity': 4}},
        {{'rule': 'plain', 'score': 1, 'specificity': 1}}, {{'rule': 'mixed', 'score': ((ref AND top)::INT + near::INT) / 2, 'specificity': 3}}], recursive := true) FROM u)
    SELECT folder, rule, score, CAST(specificity AS INTEGER) AS specificity, CAST(row_number() OVER (PARTITION BY folder ORDER BY score DESC, specificity DESC, rule DESC) AS INTEGER) AS rank FROM s""")
def match_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each web folder's score for four layouts, by the names in it and above it."""
    return formats.scores(web_entries(spark, sf_dir), LAYOUTS)


def web_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' addresses as files in folders, and the hosts' first folders."""
    whole = t(spark, sf_dir, "pages").select(F.split_part("url", F.lit("//"), F.lit(2)).alias("p"))
    files = whole.select(F.regexp_replace("p", "/[^/]*$", "").alias("folder"), F.regexp_extract("p", "[^/]*$", 0).alias("name"), F.lit(False).alias("is_folder"))
    deep = whole.filter(F.size(F.split("p", "/")) > 2)
    return files.unionByName(deep.select(F.split_part("p", F.lit("/"), F.lit(1)).alias("folder"), F.split_part("p", F.lit("/"), F.lit(2)).alias("name"), F.lit(True).alias("is_folder")).distinct())


@query("""SELECT user_id, CASE WHEN min(value) < 0.25 THEN 'failed' ELSE 'ok' END AS status, CAST(CASE WHEN min(value) < 0.25 THEN 3 ELSE 1 END AS INTEGER) AS attempts,
    CASE WHEN min(value) >= 0.25 THEN CAST(count(*) AS VARCHAR) || ' events, ' || CAST(count(DISTINCT event_type) AS VARCHAR) || ' kinds' END AS output,
    CASE WHEN min(value) < 0.25 THEN 'ValueError: too dark' END AS error FROM events GROUP BY user_id""")
def run_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events processed as a run; runs with too faint an event fail after three attempts, the others go on."""

    def work(run):
        if run["value"].min() < 0.25:
            raise ValueError("too dark")
        return f"{len(run)} events, {run['event_type'].nunique()} kinds"

    return runs.attempted(t(spark, sf_dir, "events").select("user_id", "value", "event_type"), "user_id", work, retries=2)


# Motors with encoders, and bounded fits


@query("""WITH m AS (SELECT l_quantity AS mu, 2 * l_quantity + 1 + (l_orderkey * 7919 + l_linenumber * 104729) % 1000 / 50021.0 AS encoder, l_discount AS phi,
        100 * l_discount + (l_orderkey * 7907 + l_linenumber * 104723) % 1000 / 500007.0 AS steps, l_tax AS chi FROM lineitem),
    long AS (SELECT row_number() OVER () AS f, * FROM m), u AS (UNPIVOT long ON mu, encoder, phi, steps, chi INTO NAME motor VALUE v),
    tols AS (SELECT motor, (max(v) - min(v)) * 1e-3 AS tol FROM u GROUP BY motor),
    g AS (SELECT f, motor, v, CASE WHEN v - lag(v) OVER (PARTITION BY motor ORDER BY v) > tol THEN 1 ELSE 0 END AS new FROM u JOIN tols USING (motor)),
    n AS (SELECT f, motor, sum(new) OVER (PARTITION BY motor ORDER BY v) AS i FROM g),
    pairs AS (SELECT a.motor AS motor, b.motor AS other, count(DISTINCT a.i) AS x, count(DISTINCT b.i) AS y, count(DISTINCT (a.i, b.i)) AS xy FROM n a JOIN n b USING (f) GROUP BY ALL)
    SELECT motor, arg_min(other, list_position(['mu', 'encoder', 'phi', 'steps', 'chi'], other)) AS leader FROM pairs WHERE x = xy AND y = xy GROUP BY motor""")
def lockstep_encoders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which motors step together although their encoders jitter."""
    a, b = V("l_orderkey"), V("l_linenumber")
    frames = t(spark, sf_dir, "lineitem").select(
        V("l_quantity").alias("mu"), (2 * V("l_quantity") + 1 + (a * 7919 + b * 104729) % 1000 / 50021.0).alias("encoder"), V("l_discount").alias("phi"),
        (100 * V("l_discount") + (a * 7907 + b * 104723) % 1000 / 500007.0).alias("steps"), V("l_tax").alias("chi"),
    )
    return scans.lockstep(frames, ("mu", "encoder", "phi", "steps", "chi"))


@query("""WITH p AS (SELECT p_partkey, p_size / 50e0 AS s, (p_partkey % 20) / 20e0 AS k FROM part)
    SELECT p_partkey, round(16 + 2 * s, 3) AS p0_centre, round(3 + k, 3) AS p0_fwhm, round(50 + 10 * s, 3) AS p0_height, round(5 + s, 3) AS c0, round(4 + 2 * k, 3) AS a, 11e0 AS decay, true AS success FROM p""")
def fit_on_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Gaussian on an exponential background, between x = 4 and 36 only: beyond there the curves are spoilt."""
    s, k = V("p_size") / 50.0, (V("p_partkey") % 20) / 20.0
    x = lambda i: i / 2.0
    bell = lambda i: (50 + 10 * s) * F.exp(-4 * math.log(2) * F.pow((x(i) - (16 + 2 * s)) / (3 + k), F.lit(2)))
    y = F.transform(F.sequence(F.lit(0), F.lit(80)), lambda i: F.when((i < 8) | (i > 72), 999.0).otherwise(bell(i) + 5 + s + (4 + 2 * k) * F.exp(-(x(i) - 20) / 11.0)))
    drawn = parts(spark, sf_dir).select("p_partkey", y.alias("y"))
    fitted = fitting.fit_models(drawn, "p_partkey", [i / 2 for i in range(81)], ("gaussian",), "exponential", x_range=(4.0, 36.0), bounds={"p0_fwhm": (0.5, 12.0), "decay": (1.0, 200.0)})
    return rounded(fitted.select([c for c in fitted.columns if not c.endswith("_err") and c != "r2"]), 3)


# Rotations at which two reflections coincide


BEAM = "(2 * pi() * 17e0 / 12.398419843320026)"
HITS = f"""{{name}} AS (SELECT *, degrees(turn) + 180 - 360 * floor((degrees(turn) + 180) / 360) - 180 AS mu FROM (
        SELECT *, unnest([atan2(wv, vb) + acos(target / radius), atan2(wv, vb) - acos(target / radius)]) AS turn FROM (
        SELECT *, sqrt(vb * vb + wv * wv) AS radius FROM (SELECT *, cos(radians(omega)) * wb - sin(radians(omega)) * wh AS vb, sin(radians(omega)) * wb + cos(radians(omega)) * wh AS vh,
            -(wb * wb + wh * wh + wv * wv) / (2 * {BEAM}) AS target FROM {{source}})) WHERE radius >= abs(target))),
    {{name}}_seen AS (SELECT *, degrees(atan2(vh, -sin(radians(mu)) * vb + cos(radians(mu)) * wv)) AS eta FROM {{name}} WHERE mu BETWEEN -60 AND 60),
    {{name}}_near AS (SELECT {{keys}}, omega, mu - lag(mu) OVER w AS gap, lag(j) OVER w AS j1, j AS j2, lag(eta) OVER w AS e1, eta AS e2 FROM {{name}}_seen
        WHERE eta BETWEEN -180 AND 180 WINDOW w AS (PARTITION BY {{keys}} ORDER BY mu, j)),
    {{name}}_best AS (SELECT {{keys}}, omega, min((gap, j1, j2, e1, e2)) AS b FROM {{name}}_near WHERE j1 <> j2 GROUP BY ALL)"""


@query(f"""WITH e AS (SELECT unnest(range(6)) AS j), p AS (SELECT p_partkey, 4 * pi() / (3.6 + p_size / 40e0) AS g, 0.3e0 + p_partkey % 100 / 1000e0 AS t FROM part),
    u AS (SELECT p_partkey, j, t, g * ((j = 0)::INT - (j = 1)::INT) AS x, g * ((j = 2)::INT - (j = 3)::INT) AS y, g * ((j = 4)::INT - (j = 5)::INT) AS z FROM p, e),
    v AS (SELECT p_partkey, j, x * cos(0.2e0) + (y * sin(t) + z * cos(t)) * sin(0.2e0) AS wb, y * cos(t) - z * sin(t) AS wh, -x * sin(0.2e0) + (y * sin(t) + z * cos(t)) * cos(0.2e0) AS wv FROM u),
    grid AS (SELECT *, -90e0 + i * 2e0 AS omega FROM v, (SELECT unnest(range(90)) AS i)), {HITS.format(name='c', source='grid', keys='p_partkey, i')},
    s AS (SELECT p_partkey, i, omega, b[1] AS gap, CASE WHEN lag(i) OVER w = i - 1 THEN lag(b[1]) OVER w END AS l, CASE WHEN lead(i) OVER w = i + 1 THEN lead(b[1]) OVER w END AS r
        FROM c_best WINDOW w AS (PARTITION BY p_partkey ORDER BY i)),
    close AS (SELECT v.*, s.i, m, s.omega - 2 + m * (4e0 / 40) AS omega FROM s JOIN v USING (p_partkey), (SELECT unnest(range(41)) AS m)
        WHERE s.i BETWEEN 1 AND 88 AND coalesce(gap <= l, true) AND coalesce(gap <= r, true)), {HITS.format(name='f', source='close', keys='p_partkey, i, m')},
    one AS (SELECT p_partkey, i, min((b[1], m, omega, b[4], b[5])) AS b FROM f_best GROUP BY ALL),
    listed AS (SELECT p_partkey, list([{{'omega': b[3], 'gap': b[1], 'e1': b[4], 'e2': b[5]}}] ORDER BY b[3]) AS c FROM one GROUP BY p_partkey),
    folded AS (SELECT p_partkey, unnest(list_reduce(c, lambda d, n: CASE WHEN abs(n[1].omega - d[-1].omega) < 0.3 THEN CASE WHEN n[1].gap < d[-1].gap THEN d[:-2] || n ELSE d END ELSE d || n END)) AS o
        FROM listed),
    ranked AS (SELECT p_partkey, o.omega AS omega, o.gap AS gap, row_number() OVER (PARTITION BY p_partkey ORDER BY round(o.gap, 4), -least(o.e1 + 180, 180 - o.e1, o.e2 + 180, 180 - o.e2)) AS rank FROM folded)
    SELECT p_partkey, CAST(rank AS INTEGER) AS rank, {r('omega', 4)} AS omega, {r('gap', 5)} AS gap FROM ranked WHERE rank <= 3""")
def omega_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part's crystal the rotations at which two of its six reflections come closest in mu."""
    own = parts(spark, sf_dir).select("p_partkey", (4 * math.pi / (3.6 + V("p_size") / 40.0)).alias("g"), (0.3 + V("p_partkey") % 100 / 1000.0).alias("t"))
    six = own.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(5))))
    x, y, z = (V("g") * ((V("j") == 2 * d).cast("int") - (V("j") == 2 * d + 1).cast("int")) for d in range(3))
    up = y * F.sin("t") + z * F.cos("t")
    c, s = F.lit(math.cos(0.2)), F.lit(math.sin(0.2))
    vectors = six.select("p_partkey", "j", (x * c + up * s).alias("wb"), (y * F.cos("t") - z * F.sin("t")).alias("wh"), (-x * s + up * c).alias("wv"))
    found = omega.find_offsets(vectors, ("p_partkey",), 17.0, (-90.0, 90.0), 2.0, 41, 3, {"mu": (-60.0, 60.0), "eta": (-180.0, 180.0)})
    return rounded(rounded(found.select("p_partkey", "rank", "omega", "gap"), 4, "gap"), 5, "omega")


# Curves with uncertainties, other grids, colours and counters


@query(f"""WITH {DAILY}, s AS (SELECT *, sqrt(y) AS sigma FROM daily), n AS (SELECT *, lag(x) OVER w AS xa, lead(x) OVER w AS xb, lag(y) OVER w AS ya, lead(y) OVER w AS yb,
        lag(sigma) OVER w AS sa, lead(sigma) OVER w AS sb FROM s WINDOW w AS (PARTITION BY event_type ORDER BY x))
    SELECT event_type, x, {r('CASE WHEN xa IS NULL THEN (yb - y) / (xb - x) WHEN xb IS NULL THEN (y - ya) / (x - xa) ELSE ((x - xa) ** 2 * yb - (xb - x) ** 2 * ya + ((xb - x) ** 2 - (x - xa) ** 2) * y) / ((x - xa) * (xb - x) * (xb - xa)) END', 4)} AS dy,
    {r('sqrt(coalesce(sa, sigma) ** 2 + coalesce(sb, sigma) ** 2) / (coalesce(xb, x) - coalesce(xa, x))', 5)} AS dy_sigma,
    {r('sum(coalesce((x - xa) * (y + ya) / 2, 0)) OVER o', 4)} AS integral, {r('sqrt(sum((0.5e0 * (coalesce(xb, x) - coalesce(xa, x)) * sigma) ** 2) OVER o)', 4)} AS integral_sigma
    FROM n WINDOW o AS (PARTITION BY event_type ORDER BY x)""")
def curve_uncertainties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes and running integrals of the daily curves with the uncertainties of counted values."""
    own = daily(spark, sf_dir).withColumn("sigma", F.sqrt("y"))
    both = curves.cumulative_integral(curves.derivative(own, ("event_type",)), ("event_type",))
    return rounded(rounded(both.select("event_type", "x", "dy", "dy_sigma", "integral", "integral_sigma"), 4, "dy_sigma"), 5, "dy", "integral", "integral_sigma")


@query(f"""WITH {IMAGE}, t AS (SELECT -0.5e0 + 0.75e0 * a AS y, 0.25e0 + 0.5e0 * b AS x FROM range(12) u(a), range(16) w(b)), k AS (SELECT DISTINCT label FROM image),
    n AS (SELECT label, t.y, t.x, CAST(floor(t.y) AS INT) AS y0, CAST(floor(t.x) AS INT) AS x0 FROM k, t)
    SELECT n.label, n.y, n.x, {r('sum(i.v * (1 - abs(n.y - i.y)) * (1 - abs(n.x - i.x))) FILTER (n.y BETWEEN 0 AND 7 AND n.x BETWEEN 0 AND 7)', 5)} AS value
    FROM n LEFT JOIN image i ON i.label = n.label AND abs(n.y - i.y) < 1 AND abs(n.x - i.x) < 1 GROUP BY n.label, n.y, n.x""")
def regrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images on a finer grid, between their pixels; null beyond their edges."""
    own = images(spark, sf_dir).withColumnRenamed("v", "value")
    targets = {"y": [-0.5 + 0.75 * a for a in range(12)], "x": [0.25 + 0.5 * b for b in range(16)]}
    return rounded(curves.regrid(own, targets, ("y", "x"), ("label",)), 5)


@query(f"""WITH {CELLS}, m AS (SELECT label, y, x, avg(v) AS a, stddev_pop(v) AS b, sum(w) AS i FROM cells GROUP BY ALL), c AS (SELECT label, median(a) AS ca, median(b) AS cb FROM m GROUP BY label),
    d AS (SELECT label, y, x, i, a - ca AS da, b - cb AS db, sqrt((a - ca) ** 2 + (b - cb) ** 2) AS r FROM m JOIN c USING (label)),
    e AS (SELECT label, quantile_cont(r, 0.95) AS reach, quantile_cont(i, 0.01) AS low, quantile_cont(i, 0.99) AS high FROM d GROUP BY label),
    h AS (SELECT label, y, x, least(r / reach, 1) AS s, greatest(least((i - low) / (high - low), 1), 0) AS v, atan2(db, da) / (2 * pi()) + CASE WHEN atan2(db, da) < 0 THEN 1 ELSE 0 END AS hue FROM d JOIN e USING (label)),
    k AS (SELECT *, (5 + hue * 6) - 6 * floor((5 + hue * 6) / 6) AS kr, (3 + hue * 6) - 6 * floor((3 + hue * 6) / 6) AS kg, (1 + hue * 6) - 6 * floor((1 + hue * 6) / 6) AS kb FROM h)
    SELECT label, y, x, {r('v - v * s * greatest(0, least(kr, 4 - kr, 1))')} AS red, {r('v - v * s * greatest(0, least(kg, 4 - kg, 1))')} AS green, {r('v - v * s * greatest(0, least(kb, 4 - kb, 1))')} AS blue FROM k""")
def orientation_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's mean and spread per pixel as a tilt in colours, as bright as the pixel."""
    maps = pixels(spark, sf_dir).groupBy("label", "y", "x").agg(F.avg("v").alias("a"), F.stddev_pop("v").alias("b"), F.sum(V("v") * V("v")).alias("i"))
    return rounded(imaging.orientation_rgb(maps, "a", "b", ("label",), intensity="i").select("label", "y", "x", "red", "green", "blue"))


@query(f"""WITH c AS (SELECT l_suppkey, CAST(l_orderkey AS DOUBLE) * 8 + l_linenumber AS x, l_partkey, l_extendedprice AS det, l_quantity AS ion, l_quantity - 0.437e0 * (l_linenumber + 20) AS beam FROM lineitem)
    SELECT l_suppkey, l_partkey, 'det' AS channel, x, {r('CASE WHEN beam > 0 THEN det / beam END', 5)} AS value FROM c UNION ALL SELECT l_suppkey, l_partkey, 'ion', x, ion FROM c""")
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's recorded channels against a motor, over the ion chamber less its dark counts."""
    own = t(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_partkey", (V("l_orderkey").cast("double") * 8 + V("l_linenumber")).alias("motor"), V("l_extendedprice").alias("det"), V("l_quantity").alias("ion"), (V("l_linenumber") + 20).alias("sec"),
    )
    return rounded(scans.counters(own, "motor", ("det", "ion"), ("l_suppkey", "l_partkey"), "ion", 0.437), 5)


# Tables of scans that recorded different motors

NAMES = tuple(f"m{k}" for k in range(1, 8))
#: Another name of m1, a motor that m2 drives, and steps below which a motor only drifts.
POSITIONERS: dict = {"aliases": {"legacy": ("m1",), "m6": ("m7",)}, "followers": {"m2": ("encoder",)}, "least": {"drift": 1e-3, "m3": 1.0}}
TABLE = """recorded AS (SELECT l_orderkey AS scan, 'm' || l_linenumber AS name, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, 'legacy', l_quantity FROM lineitem WHERE l_linenumber = 1
    UNION ALL SELECT l_orderkey, 'encoder', l_quantity * 2 FROM lineitem WHERE l_linenumber = 2 UNION ALL SELECT o_orderkey, 'drift', (o_orderkey % 7) * 1e-5 FROM orders UNION ALL SELECT l_orderkey, 'still', 4.0 FROM lineitem),
    scans AS (SELECT o_orderkey AS scan, CASE WHEN o_orderstatus = 'F' THEN 'complete' WHEN o_orderstatus = 'O' THEN 'running' ELSE 'aborted' END AS status, CAST(0 AS INTEGER) AS missing FROM orders),
    wide AS (SELECT scan, """ + ", ".join(f"max(value) FILTER (name = '{n}') AS {n}" for n in (*NAMES, "legacy", "encoder", "drift", "still")) + """ FROM recorded GROUP BY scan),
    scan_tab AS (SELECT * FROM scans LEFT JOIN wide USING (scan))"""


def scan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scans, each with the motors that its line items recorded."""
    orders, items = t(spark, sf_dir, "orders"), t(spark, sf_dir, "lineitem")
    status = F.when(V("o_orderstatus") == "F", "complete").when(V("o_orderstatus") == "O", "running").otherwise("aborted")
    own = orders.select(V("o_orderkey").alias("scan"), status.alias("status"), F.lit(0).alias("missing"))
    row = lambda name, value, when=True: F.when(F.lit(True) if when is True else when, F.struct(F.lit(name).alias("name") if isinstance(name, str) else name.alias("name"), value.cast("double").alias("value")))
    number, q = V("l_linenumber"), V("l_quantity")
    rows = F.array_compact(F.array(row(F.concat(F.lit("m"), number.cast("string")), q), row("legacy", q, number == 1), row("encoder", q * 2, number == 2), row("still", F.lit(4.0))))
    recorded = items.select(V("l_orderkey").alias("scan"), F.inline(rows))
    drift = orders.select(V("o_orderkey").alias("scan"), F.lit("drift").alias("name"), (V("o_orderkey") % 7 * 1e-5).alias("value"))
    return scan_tables.scan_table(own, recorded.unionByName(drift), (*NAMES, "legacy", "encoder", "drift", "still"))


@query(f"WITH {TABLE} SELECT * FROM scan_tab")
def scan_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each scan, whatever motors it recorded."""
    return rounded(scan_rows(spark, sf_dir), 9, "drift")


#: What each positioner tells, then the rules in their order.
TOLD = ", ".join(f"('{n}', (SELECT min({n}) FROM scan_tab), (SELECT max({n}) FROM scan_tab))" for n in (*NAMES, "legacy", "encoder", "drift", "still"))


@query(f"""WITH {TABLE}, told AS (SELECT * FROM (VALUES {TOLD}) v(name, low, high)), still AS (SELECT name FROM told WHERE low IS NULL OR low = high),
    twins AS (SELECT 'legacy' AS name WHERE NOT EXISTS (SELECT 1 FROM scan_tab WHERE legacy IS DISTINCT FROM m1) UNION ALL SELECT 'm6' WHERE NOT EXISTS (SELECT 1 FROM scan_tab WHERE m6 IS DISTINCT FROM m7)),
    led AS (SELECT 'encoder' AS name WHERE 'm2' NOT IN (SELECT name FROM still UNION ALL SELECT name FROM twins)),
    small AS (SELECT name FROM told WHERE (name = 'drift' AND high - low < 1e-3) OR (name = 'm3' AND high - low < 1)),
    gone AS (SELECT name FROM still UNION SELECT name FROM twins UNION SELECT name FROM led UNION SELECT name FROM small
        UNION SELECT 'missing' WHERE NOT EXISTS (SELECT 1 FROM scan_tab WHERE missing > 0) UNION SELECT 'status' WHERE NOT EXISTS (SELECT 1 FROM scan_tab WHERE status <> 'complete')),
    cells AS (UNPIVOT (SELECT scan, status, {", ".join(f"CAST(CAST({n} AS DOUBLE) AS VARCHAR) AS {n}" for n in NAMES)} FROM scan_tab) ON COLUMNS(* EXCLUDE scan) INTO NAME name VALUE value)
    SELECT name AS "column", count(*) AS "cells" FROM cells WHERE name NOT IN (SELECT name FROM gone) GROUP BY name""")
def compact_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the table of scans that tell something, with the number of their values."""
    own = scan_rows(spark, sf_dir)
    shown = scan_tables.compact(own, (*NAMES, "legacy", "encoder", "drift", "still"), **POSITIONERS)
    counted = shown.agg(*[F.count(c).alias(c) for c in shown.columns if c != "scan"])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), V(c).alias("cells")) for c in counted.columns])))


@query(f"""WITH {TABLE}, inner_ AS (SELECT 'price' AS motor, l_extendedprice AS value, 3 AS place FROM lineitem UNION ALL SELECT 'tax', l_tax, 4 FROM lineitem UNION ALL SELECT 'flat', 1.0, 5 FROM lineitem UNION ALL SELECT 'm4', l_discount, 6 FROM lineitem),
    within_ AS (SELECT motor, count(DISTINCT round(value, 9)) AS "values", 'scan' AS "where", false AS chosen, CAST(any_value(place) AS INTEGER) AS place FROM inner_ GROUP BY motor
        HAVING max(value) - min(value) >= CASE WHEN motor = 'tax' THEN 0.5 ELSE 1e-9 END),
    outer_ AS (SELECT unnest([{", ".join(f"{{'motor': '{n}', 'value': {n}, 'place': {k}}}" for k, n in enumerate(("m5", *[m for m in NAMES if m != "m5"], "encoder", "drift", "still"), 7))}], recursive := true) FROM scan_tab),
    between_ AS (SELECT motor, count(DISTINCT value) AS "values", 'stack' AS "where", motor = 'm5' AS chosen, CAST(any_value(place) AS INTEGER) AS place FROM outer_ GROUP BY motor
        HAVING count(DISTINCT value) > 1 AND max(value) - min(value) >= CASE WHEN motor = 'drift' THEN 1e-3 WHEN motor = 'm3' THEN 1 ELSE 0 END)
    SELECT 'slow' AS motor, 10 AS "values", 'scan' AS "where", true AS chosen, 1 AS place UNION ALL SELECT 'fast', 12, 'scan', true, 2
    UNION ALL SELECT * FROM within_ UNION ALL SELECT * FROM between_ WHERE motor NOT IN (SELECT motor FROM within_)""")
def motor_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The motors that may be axes: the scan's own, channels that moved in it, positioners that differ between scans."""
    items = t(spark, sf_dir, "lineitem")
    frames = items.select(V("l_extendedprice").alias("price"), V("l_tax").alias("tax"), F.lit(1.0).alias("flat"), V("l_discount").alias("m4"))
    least = {"tax": 0.5, **POSITIONERS["least"]}
    return scan_tables.motor_candidates(
        frames, scan_rows(spark, sf_dir), {"slow": 10, "fast": 12}, ("price", "tax", "flat", "m4"), (*NAMES, "legacy", "encoder", "drift", "still"), ("m5",), {"legacy": ("m1",)}, least
    )


@query(f"""WITH {MOTORS}, {AXES} SELECT frames.scan, frames.frame, slow_index AS index_slow, fast_index AS index_fast, {r('slow', 6)} AS slow, {r('fast', 6)} AS fast
    FROM frames LEFT JOIN points ON points.scan = frames.scan AND points.frame = frames.frame""")
def positions_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame with its indices on its scan's grid and its readbacks."""
    found = supplier_grids(spark, sf_dir)
    return rounded(scan_tables.positions(jittery(spark, sf_dir), found.points, ("slow", "fast"), ("slow", "fast"), "frame", ("scan",)), 6, "slow", "fast")
