"""Reference line, projection onto it, marshal sectors, speed profile and pit lane.

Reference points lie a few metres apart, so a cell of the plane holds a bounded number of them.
Nearest-point search looks cells up with an equi-join: every cell carries the reference points of
its 3x3 neighbourhood as one array, a position joins exactly one cell, and the choice is made
inside the row. Positions further away than a cell retry with larger cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trackguard.functions.ring import circ
from trackguard.functions.timeline import (chunk_of, in_chunk, interval_join, own_rows, with_history)
from trackguard.operators.fold import fold_in_time
from trackguard.session import is_small, stored

REF_STEP_M = 5.0
SPEED_BIN_M = 10.0
QUICK_FACTOR = 1.07
CELL_LEVELS = 5             # cell sizes tried before a position is compared with the whole line
PIT_NEAR_M, PIT_MIN_LAT_M, PIT_ROAD_S, PIT_LANE_S = 4.0, 7.0, 8.0, 60.0
PATH_K, PATH_EXTRA_M, PATH_SPREAD_M, PATH_RESET_TICKS = 8, 20.0, 50.0, 8


def _far(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


# ---- reference laps and line

def clean_laps(laps: DataFrame, by: list[str], strict: bool = True) -> DataFrame:
    """Green-flag laps without a pit stop, within 107% of the fastest of them."""
    ok = (F.col("lap_s").isNotNull() & F.col("pit_in").isNull() & F.col("pit_out").isNull()
          & (F.col("track_status") == "1"))
    if strict and "accurate" in laps.columns:
        ok = ok & F.coalesce("accurate", F.lit(False))
    kept = laps.filter(ok)
    best = kept.groupBy(*by).agg(F.min("lap_s").alias("_best"))
    return kept.join(best, by).filter(F.col("lap_s") <= F.col("_best") * QUICK_FACTOR).drop("_best")


def reference_laps(laps: DataFrame, by: list[str]) -> DataFrame:
    """Strict clean laps; sessions with fewer than 3 of them fall back to laps without the accuracy test."""
    strict = clean_laps(laps, by).withColumn("_n", F.lit(1))
    enough = strict.groupBy(*by).agg(F.count(F.lit(1)).alias("_c")).filter("_c >= 3").select(*by)
    loose = clean_laps(laps, by, strict=False).join(enough, by, "left_anti")
    return strict.drop("_n").join(enough, by, "left_semi").unionByName(loose)


def fastest_lap(laps: DataFrame, by: list[str]) -> DataFrame:
    """The quickest reference lap of each session (ties: car, then lap)."""
    best = F.min_by(F.struct("drv", "lap", "lap_s"), F.struct("lap_s", "drv", "lap")).alias("_b")
    return reference_laps(laps, by).groupBy(*by).agg(best).select(*by, "_b.*")


def resample_line(points: DataFrame, by: list[str], order: str, step: float = REF_STEP_M) -> DataFrame:
    """A polyline resampled every `step` metres: (by, i, dist, x, y). Each segment emits the grid
    points it covers, so nothing is joined. One polyline is one lap, a bounded group."""
    w = W.partitionBy(*by).orderBy(order)

    def length_to(fn) -> Column:
        return _far(F.col("x") - fn("x").over(w), F.col("y") - fn("y").over(w))

    p = points.withColumn("_seg", length_to(F.lag)).filter("_seg is null or _seg > 1e-6")
    p = p.withColumn("_seg", F.coalesce(length_to(F.lag), F.lit(0.0)))
    p = p.withColumn("_cum", F.sum("_seg").over(w))
    p = p.withColumns({"_c1": F.lead("_cum").over(w), "_x1": F.lead("x").over(w), "_y1": F.lead("y").over(w)})
    first, last = F.ceil(F.col("_cum") / step), F.ceil(F.col("_c1") / step) - 1
    p = p.filter("_c1 is not null").withColumn("i", F.explode(F.when(first <= last, F.sequence(first, last))))
    share = (F.col("i") * step - F.col("_cum")) / (F.col("_c1") - F.col("_cum"))
    return p.select(*by, F.col("i").cast("int").alias("i"), (F.col("i") * step).cast("double").alias("dist"),
                    (F.col("x") + share * (F.col("_x1") - F.col("x"))).alias("x"),
                    (F.col("y") + share * (F.col("_y1") - F.col("y"))).alias("y"))


def closed_length(ref: DataFrame, by: list[str]) -> DataFrame:
    """Lap length: the last reference distance plus the way back to the first point."""
    a, z = F.min_by(F.struct("x", "y"), "i").alias("a"), F.max_by(F.struct("dist", "x", "y"), "i").alias("z")
    gap = _far(F.col("a.x") - F.col("z.x"), F.col("a.y") - F.col("z.y"))
    return ref.groupBy(*by).agg(a, z).select(*by, (F.col("z.dist") + gap).alias("length"))


def with_next(ref: DataFrame, by: list[str]) -> DataFrame:
    """Reference points with the following point, the last one closing the ring."""
    w = W.partitionBy(*by).orderBy("i")
    return ref.withColumns({f"n{c}": F.coalesce(F.lead(c).over(w), F.first(c).over(w)) for c in ("x", "y")})


# ---- nearest reference point

def _cells(ref: DataFrame, by: list[str], cell: float) -> DataFrame:
    """One row per cell: every reference point of the cell and its eight neighbours."""
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    near = ref.withColumn("_n", around).withColumns({
        "_cx": chunk_of("x", cell) + F.col("_n.a"), "_cy": chunk_of("y", cell) + F.col("_n.b")}).drop("_n")
    cols = [c for c in ref.columns if c not in by]
    return near.groupBy(*by, "_cx", "_cy").agg(F.collect_list(F.struct(*cols)).alias("_cands"))


def nearest(points: DataFrame, ref: DataFrame, by: list[str], cell: float = 16.0, k: int = 1, slack: float = 0.0,
            growth: float = 8.0) -> DataFrame:
    """Adds `_near`: the k nearest reference points as structs (d, i, ...), nearest first. Exact: a
    position keeps its answer only when the nearest point (plus `slack`) lies inside the searched
    block, otherwise it goes on to cells `growth` times larger. Positions that are unknown, or whose track
    has no reference points, come back with NULL and are not searched. What is still open after CELL_LEVELS
    sizes lies far off the track and is compared with every point of its line (one lap, a bounded group)."""
    cols = [c for c in ref.columns if c not in (*by, "i")]
    mapped = ref.select(*by).distinct().withColumn("_mapped", F.lit(True))
    known = F.coalesce(F.abs("x") + F.abs("y") < float("inf"), F.lit(False)) & F.col("_mapped").isNotNull()
    points = points.join(F.broadcast(mapped) if is_small(ref) else mapped, by, "left").withColumn("_known", known).drop("_mapped")
    done, todo = None, points.filter("_known").drop("_known")
    lost = points.filter("not _known").drop("_known")
    points = points.drop("_known")
    for level in range(CELL_LEVELS + 1):
        last = level == CELL_LEVELS
        if last:
            cells = stored(ref.groupBy(*by).agg(F.collect_list(F.struct(*[c for c in ref.columns if c not in by])).alias("_cands")))
            cells = cells.withColumns({"_cx": F.lit(0), "_cy": F.lit(0)})
            at = todo.withColumns({"_cx": F.lit(0), "_cy": F.lit(0)})
        else:
            cells = stored(_cells(ref, by, cell))
            at = todo.withColumns({"_cx": chunk_of("x", cell), "_cy": chunk_of("y", cell)})
        at = at.join(F.broadcast(cells) if is_small(cells) else cells, [*by, "_cx", "_cy"], "left")
        found = F.transform("_cands", lambda c: F.struct(
            _far(c["x"] - F.col("x"), c["y"] - F.col("y")).alias("d"), c["i"].alias("i"), *[c[n].alias(n) for n in cols]))
        best = F.when(F.col("_cands").isNotNull(), F.array(F.array_min(found))) if k == 1 else F.slice(F.array_sort(found), 1, k)
        at = at.withColumn("_near", best).drop("_cands", "_cx", "_cy")
        exact = F.coalesce(F.get("_near", F.lit(0))["d"] + slack <= cell, F.lit(False)) | F.lit(last)
        at = stored(at.withColumn("_exact", exact))
        good = at.filter("_exact").drop("_exact")
        done = good if done is None else done.unionByName(good)
        todo = at.filter("not _exact").select(*points.columns)
        if todo.isEmpty():
            break
        cell *= growth
    return done.unionByName(lost, allowMissingColumns=True)


def _onto(near: Column, length: Column) -> tuple[Column, Column]:
    """Distance along the lap and signed lateral offset of (x, y) from one reference point."""
    tx, ty = near["nx"] - near["x"], near["ny"] - near["y"]
    norm = _far(tx, ty) + 1e-9
    rx, ry = F.col("x") - near["x"], F.col("y") - near["y"]
    along, lat = (rx * tx + ry * ty) / norm, (tx * ry - ty * rx) / norm
    return F.pmod(near["dist"] + along, length), lat


def project(points: DataFrame, ref: DataFrame, by: list[str], length: Column, cell: float = 16.0) -> DataFrame:
    """Adds dist and lat_off: the position on the nearest piece of the reference line."""
    out = nearest(points, with_next(ref, by), by, cell)
    dist, lat = _onto(F.get("_near", F.lit(0)), length)
    return out.withColumns({"dist": dist, "lat_off": lat}).drop("_near")


def project_path(points: DataFrame, ref: DataFrame, length: float, cell: float = 40.0, chunk: int = 4096) -> DataFrame:
    """Projection along each car's path. Where two parts of the track run close together, a position
    takes the candidate nearest along the lap to the car's previous choice (within 2 s). Only such
    ambiguous positions depend on the previous one; the others are settled row by row."""
    by, car = ["race"], ["race", "drv"]
    out = nearest(points, with_next(ref, by), by, cell, PATH_K, PATH_EXTRA_M)
    first = F.get("_near", F.lit(0))
    near = F.filter("_near", lambda c: c["d"] <= first["d"] + PATH_EXTRA_M)
    spread = F.array_max(F.transform(near, lambda c: F.abs(circ(c["dist"] - first["dist"], F.lit(length)))))
    out = out.withColumns({"_near": near, "_amb": F.coalesce(spread > PATH_SPREAD_M, F.lit(False))})
    seen = with_history(out.filter("x is not null").select(*car, "tick", "_near", "_amb"), PATH_RESET_TICKS, chunk)
    last = F.lag(F.struct("tick", "_amb", F.get("_near", F.lit(0))["dist"].alias("dist"))).over(in_chunk(car))
    seen = own_rows(seen.withColumn("_last", last), chunk).filter("_amb")
    asked = seen.select(*car, "tick", F.col("_last.tick").alias("p_tick"), F.col("_last.dist").alias("p_dist"),
                        F.col("_last._amb").alias("p_amb"), F.transform("_near", lambda c: c["dist"]).alias("cands"),
                        F.transform("_near", lambda c: c["i"]).alias("ids"))

    def step(state: dict, rows: list[dict]) -> tuple[dict, list[dict]]:
        made, prev, end = [], state.get("dist"), 0
        for r in rows:
            cands, pick, end = list(r["cands"]), 0, r["tick"]
            fresh = r["p_tick"] is not None and r["p_tick"] == r["p_tick"] and r["tick"] - r["p_tick"] <= PATH_RESET_TICKS
            if fresh:
                before = prev if r["p_amb"] and prev is not None else r["p_dist"]
                jump = [abs((c - before + length / 2) % length - length / 2) for c in cands]
                pick = jump.index(min(jump))
            prev = cands[pick]
            made.append({"tick": r["tick"], "_pick": int(list(r["ids"])[pick])})
        edge = (end // chunk + 1) * chunk
        return ({"dist": float(prev)} if edge - end <= PATH_RESET_TICKS else {}), made

    picks = fold_in_time(asked, car, ["tick"], step, "tick int, _pick int", size=chunk)
    out = out.join(picks, [*car, "tick"], "left")
    chosen = F.coalesce(F.get(F.filter("_near", lambda c: c["i"] == F.col("_pick")), F.lit(0)), first)
    dist, lat = _onto(chosen, F.lit(length))
    return out.withColumns({"dist": dist, "lat_off": lat}).drop("_near", "_amb", "_pick")


# ---- marshal sectors

def marshal_sectors(markers: DataFrame, by: list[str]) -> DataFrame:
    """Sector k spans from its marker to the next one along the lap; the last wraps to the first.
    Markers (by, id, dist) number a few dozen per track."""
    w = W.partitionBy(*by).orderBy("dist", "id")
    after = F.coalesce(F.lead("dist").over(w), F.first("dist").over(w))
    return markers.select(*by, F.col("id").cast("int").alias("id"), F.round("dist", 1).alias("start_dist"),
                          F.round(after, 1).alias("end_dist"))


def sectors_in_order(sectors: DataFrame, by: list[str]) -> DataFrame:
    """True per track when sector ids rise along the lap, allowing one wrap at the line."""
    w = W.partitionBy(*by).orderBy("start_dist", "id")
    after = F.coalesce(F.lead("id").over(w), F.first("id").over(w))
    return (sectors.withColumn("_down", F.when(after <= F.col("id"), 1).otherwise(0))
            .groupBy(*by).agg((F.sum("_down") <= 1).alias("in_order")))


def sector_at(df: DataFrame, sectors: DataFrame, by: list[str], dist: str = "dist") -> DataFrame:
    """Adds msector, 0 where unknown. A track's sectors travel as one short array per track."""
    packed = sectors.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("id", "start_dist", "end_dist"))).alias("_s"))
    out = df.join(F.broadcast(packed) if is_small(packed) else packed, by, "left")
    d = F.col(dist)
    hit = F.filter("_s", lambda s: F.when(s["start_dist"] <= s["end_dist"], (d >= s["start_dist"]) & (d < s["end_dist"]))
                   .otherwise((d >= s["start_dist"]) | (d < s["end_dist"])))
    return out.withColumn("msector", F.coalesce(F.try_element_at(F.transform(hit, lambda s: s["id"]), F.lit(-1)), F.lit(0))).drop("_s")


# ---- speed profile

def speed_profile(samples: DataFrame, by: list[str], length: float, bin_m: float = SPEED_BIN_M) -> DataFrame:
    """Median speed per bin of the lap; empty bins are filled on a line between their neighbours,
    at the ends with the nearest one."""
    bins = int(-(-length // bin_m))
    ok = samples.filter("dist is not null and speed is not null")
    med = ok.groupBy(*by, F.least(chunk_of("dist", bin_m), F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.percentile("speed", 0.5).alias("v"))
    full = med.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = full.join(med, [*by, "bin"], "left")
    w = W.partitionBy(*by).orderBy("bin")          # one row per bin of one track
    known = F.when(F.col("v").isNotNull(), F.struct("bin", "v"))
    full = full.withColumns({
        "_a": F.last(known, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)),
        "_z": F.last(known, ignorenulls=True).over(
            W.partitionBy(*by).orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0))})
    share = (F.col("bin") - F.col("_a.bin")) / (F.col("_z.bin") - F.col("_a.bin"))
    line = F.col("_a.v") + share * (F.col("_z.v") - F.col("_a.v"))
    return full.select(*by, "bin", F.coalesce("v", line, "_a.v", "_z.v").alias("ref_speed"))


def reference_speed(df: DataFrame, profile: DataFrame, by: list[str], length: float, bin_m: float = SPEED_BIN_M) -> DataFrame:
    """Adds ref_speed by bin, NULL without a distance."""
    bins = int(-(-length // bin_m))
    at = F.when(F.col("dist").isNotNull(), F.least(F.greatest(chunk_of("dist", bin_m), F.lit(0)), F.lit(bins - 1)).cast("int"))
    side = F.broadcast(profile) if is_small(profile) else profile
    return df.withColumn("bin", at).join(side, [*by, "bin"], "left").drop("bin")


# ---- pit lane

def pit_lane_points(pos: DataFrame, laps: DataFrame, ref: DataFrame, length: Column) -> DataFrame:
    """Distinct whole-metre positions driven around pit entries and exits, well off the racing line."""
    car = ["race", "drv"]
    ins = laps.filter("pit_in is not null").select(*car, (F.col("pit_in") - PIT_ROAD_S).alias("lo"),
                                                   (F.col("pit_in") + PIT_LANE_S).alias("hi"))
    outs = laps.filter("pit_out is not null").select(*car, (F.col("pit_out") - PIT_LANE_S).alias("lo"),
                                                     (F.col("pit_out") + PIT_ROAD_S).alias("hi"))
    near = interval_join(pos, ins.unionByName(outs), car, "t", "lo", "hi", 64.0, how="left_semi")
    off = project(near, ref, ["race"], length).filter(F.abs("lat_off") > PIT_MIN_LAT_M)
    return off.select("race", F.rint("x").alias("x"), F.rint("y").alias("y")).distinct()


def near_pit(df: DataFrame, pit: DataFrame, by: list[str]) -> DataFrame:
    """Adds near_pit: closer than 4 m to a pit lane point and more than 7 m off the line."""
    cells = stored(_cells(pit, by, PIT_NEAR_M))
    side = F.broadcast(cells) if is_small(cells) else cells
    at = df.withColumns({"_cx": chunk_of("x", PIT_NEAR_M), "_cy": chunk_of("y", PIT_NEAR_M)})
    at = at.join(side, [*by, "_cx", "_cy"], "left")
    close = F.exists("_cands", lambda c: _far(c["x"] - F.col("x"), c["y"] - F.col("y")) < PIT_NEAR_M)
    hit = F.coalesce(close & (F.abs("lat_off") > PIT_MIN_LAT_M), F.lit(False))
    return at.withColumn("near_pit", hit).drop("_cands", "_cx", "_cy")


def corners(raw: DataFrame, scale: float = 0.1) -> DataFrame:
    """Corner numbers and positions in metres."""
    return raw.withColumns({c: F.round(F.col(c) * scale, 1) for c in ("x", "y")})
