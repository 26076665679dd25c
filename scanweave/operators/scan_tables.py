"""Tables with one row for each scan and a column for each positioner that some scan recorded; what of them is worth showing; which motors may be axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave.tables import tasks_for

#: Positioners that a table may have as columns; a beamline has some hundreds.
MOST_COLUMNS = 4096
#: Channels whose values differ by less have not moved, whatever their own least step. Fixed value.
LEAST = 1e-9
#: Decimals to which values count as different ones. Fixed value.
DECIMALS = 9


def col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def scan_table(scans: DataFrame, positioners: DataFrame, names: tuple[str, ...] | None = None, scan: str = "scan") -> DataFrame:
    """``scans`` with a column for each name of ``positioners(scan, name, value)``, in order of the names.

    Scans need not have the same positioners: what a scan lacks is null, and a scan without any, one that
    can't be read yet for example, keeps its row. Of several values of one name the largest stays.
    Without ``names`` those that occur are taken, of which there may be ``MOST_COLUMNS``; a name that is a column of
    ``scans`` already is left to that. Null names are left out.
    """
    if names is None:
        found = positioners.select("name").filter("name IS NOT NULL").distinct().limit(MOST_COLUMNS + 1).collect()
        if len(found) > MOST_COLUMNS:
            raise ValueError(f"more than {MOST_COLUMNS} names of positioners; give those wanted")
        names = tuple(sorted(r["name"] for r in found))
    taken = {c.lower() for c in scans.columns}
    names = tuple(n for n in names if n.lower() not in taken)
    if not names:
        return scans
    wide = positioners.groupBy(scan).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])
    return scans.join(wide, scan, "left").select(*[col(c) for c in scans.columns], *map(col, names))


def dropped_columns(
    table: DataFrame,
    positioners: tuple[str, ...],
    aliases: dict[str, tuple[str, ...]] | None = None,
    followers: dict[str, tuple[str, ...]] | None = None,
    least: dict[str, float] | None = None,
) -> list[str]:
    """The columns that tell nothing, in order, found in one pass over ``table``.

    These are positioners that never change, ``aliases`` (name: names) that equal one of theirs in every row, ``followers`` of a
    leader that is a positioner and stays, positioners that differ by less than their ``least`` step, ``missing`` if no scan has
    missing frames, and ``status`` if all are complete. An empty table has no positioner that changes.
    """
    aliases, followers, least = aliases or {}, followers or {}, least or {}
    own = [p for p in positioners if p in table.columns]
    asked = {("low", p): F.min(col(p)) for p in own} | {("high", p): F.max(col(p)) for p in own}
    for name, others in aliases.items():
        for other in others:
            if name in own and other in own:
                asked["same", name, other] = F.bool_and(col(name).eqNullSafe(col(other)))
    if "missing" in table.columns:
        asked["missing",] = F.coalesce(F.max("missing"), F.lit(0)) > 0
    if "status" in table.columns:
        asked["status",] = F.coalesce(F.bool_and(F.coalesce(F.col("status") == "complete", F.lit(False))), F.lit(True))
    if not asked:
        return []
    row = table.agg(*[c.alias(f"c{k}") for k, c in enumerate(asked.values())]).first()
    told = dict(zip(asked, row, strict=True))
    out = {p for p in own if told["low", p] is None or told["low", p] == told["high", p]}
    out |= {key[1] for key, same in told.items() if key[0] == "same" and same}
    for leader, names in followers.items():
        if leader in own and leader not in out:
            out |= set(names) & set(own)
    for name, step in least.items():
        if name in own and name not in out and float(told["high", name]) - float(told["low", name]) < step:
            out.add(name)
    if told.get(("missing",)) is False:
        out.add("missing")
    if told.get(("status",)):
        out.add("status")
    return sorted(out)


def compact(table: DataFrame, positioners: tuple[str, ...], **rules: object) -> DataFrame:
    """``table`` without its ``dropped_columns``."""
    gone = set(dropped_columns(table, positioners, **rules))
    return table.select(*[col(c) for c in table.columns if c not in gone])


def _long(rows: DataFrame, names: tuple[str, ...]) -> DataFrame:
    each = F.array(*[F.struct(F.lit(n).alias("motor"), col(n).cast("double").alias("value")) for n in names])
    finite = ~F.isnan("value") & (F.abs("value") < float("inf"))
    return rows.select(F.inline(each)).filter(finite)


def motor_candidates(
    frames: DataFrame,
    table: DataFrame,
    axes: dict[str, int],
    channels: tuple[str, ...],
    positioners: tuple[str, ...],
    chosen: tuple[str, ...] = (),
    aliases: dict[str, tuple[str, ...]] | None = None,
    least: dict[str, float] | None = None,
) -> DataFrame:
    """``motor, values, where, chosen, place``: what moves within a scan or differs between scans, so may be an axis.

    First the scan's own ``axes`` (name: number of points), chosen; then the ``channels`` of its ``frames`` that move by their
    least step, not chosen; then the ``positioners`` of ``table`` that differ between scans by theirs, those named in ``chosen`` first,
    in that order. A name counts where it is met first; an alias that equals one of its names in every scan is left out. Missing
    and infinite values don't count, and values equal to nine decimals are one, within a scan.
    """
    spark, aliases, least = frames.sparkSession, aliases or {}, least or {}
    gone = set()
    pairs = [(a, b) for a, names in aliases.items() for b in names if a in positioners and b in positioners]
    if pairs:
        same = table.agg(*[F.bool_and(col(a).eqNullSafe(col(b))).alias(f"c{k}") for k, (a, b) in enumerate(pairs)]).first()
        gone = {a for (a, _), equal in zip(pairs, same, strict=True) if equal}
    inner = tuple(c for c in dict.fromkeys(channels) if c not in axes)
    outer = tuple(p for p in dict.fromkeys((*[c for c in chosen if c in positioners], *positioners)) if p not in axes and p not in gone)

    def step(names: tuple[str, ...], floor: float) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for n in names for x in (n, max(float(least.get(n, 0.0)), floor))]), F.col("motor"))

    def moved(rows: DataFrame, names: tuple[str, ...], where: str, floor: float, decimals: int | None, first: int, more_than_one: bool) -> DataFrame:
        value = F.col("value") if decimals is None else F.round("value", decimals)
        distinct = _long(rows, names).groupBy("motor", (value + F.lit(0.0)).alias("as")).agg(F.min("value").alias("low"), F.max("value").alias("high"))
        stats = distinct.groupBy("motor").agg(F.count("*").alias("values"), F.min("low").alias("low"), F.max("high").alias("high"))
        kept = stats.filter((F.col("high") - F.col("low") >= step(names, floor)) & (F.col("values") > (1 if more_than_one else 0)))
        place = F.array_position(F.lit(list(names)), F.col("motor")).cast("int") + first
        picked = F.col("motor").isin(list(chosen)) if where == "stack" else F.lit(False)
        return kept.select("motor", "values", F.lit(where).alias("where"), picked.alias("chosen"), place.alias("place"))

    out = spark.createDataFrame(
        [(n, k, "scan", True, at) for at, (n, k) in enumerate(axes.items(), 1)], "motor string, values long, where string, chosen boolean, place int"
    )
    if inner:
        out = out.unionByName(moved(frames, inner, "scan", LEAST, DECIMALS, len(axes), False))
    if outer:
        between = moved(table, outer, "stack", 0.0, None, len(axes) + len(inner), True)
        out = out.unionByName(between.join(F.broadcast(out.select("motor")), "motor", "left_anti") if inner else between)  # a row a channel
    return out


def positions(frames: DataFrame, points: DataFrame, motors: tuple[str, ...], channels: tuple[str, ...], frame: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``by, frame, index_<motor>…, channels…``: a row for each of ``frames``, with its indices on the grid ``points`` (``<motor>_index``).

    A frame that has no place on the grid has null indices. ``frame`` is distinct within a scan, a scan being one key of ``by``.
    """
    at = points.select(*map(col, by), col(frame), *[col(f"{m}_index").alias(f"index_{m}") for m in motors])
    own = frames.select(*map(col, by), col(frame), *map(col, channels))
    keys, tasks = [col(c) for c in (*by, frame)], tasks_for(own, own.count())
    own, at = own.repartition(tasks, *keys), at.repartition(tasks, *keys)
    return own.join(at, [*by, frame], "left").select(*map(col, by), col(frame), *[col(f"index_{m}") for m in motors], *map(col, channels))
