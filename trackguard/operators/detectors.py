"""Incident detectors: dense rows through windows, the few rows left through one small fold.

Every rule is a run ("slow for 1.5 s"), a latch ("once until recovered") or a cooldown. Runs need the
whole time line of a car and are running windows cut into chunks (`running(starts=...)`); whatever looks
back a second or two is an ordinary window over chunks with that much history. Both only mark rows:
where a run is long enough, where a latch opens, where an impact may begin or be confirmed. Those rows
are few. One fold per car (`car_fold`) applies latches, the impact's wait and the cooldowns to them.

How a row counts for a car's rules (rows after the chequered flag are left out):
  frozen   live, on track, but the field is on the grid: rules skip the row, timers keep running
  active   live, on track, racing
  anything else ends a run, except where a rule says otherwise
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Callable, Collection, Iterable, Sequence
from dataclasses import replace
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from trackguard.functions.text import fixed
from trackguard.functions.timeline import CHUNK_TICKS, chunk_of, in_chunk, own_rows, running, with_history
from trackguard.operators.fold import fold_in_time
from trackguard.operators.gates import race_gates
from trackguard.operators.params import SWEPT, DetectorParams
from trackguard.session import is_small, stored

TICKS_PER_S = 4
CRASH_TYPES = ("STOPPED", "IMPACT", "SPIN")
CAR = ["race", "drv"]
RANK = {"DROPOUT": 0, "STOPPED": 1, "IMPACT": 2, "SPIN": 3, "ANOMALY": 5}
NEAR_TRIGGER = 8                 # ticks; a confirming row further away follows an inactive stretch
INPUT = ["speed", "rel_ratio", "lap_ratio", "dspeed_1s", "dspeed_min_2s", "brake", "lat_off", "msector", "in_pit", "heading_err",
         "ref_speed", "track_status", "suspended", "anomaly_score", "x"]


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def conditions(have: Collection[str], p: DetectorParams, anomaly_threshold: float | None = None) -> dict[str, Column]:
    """What a row says by itself, before any look back. Batch and stream start from these same columns."""
    ratio, lap, speed, drop = F.col("rel_ratio"), F.col("lap_ratio"), F.col("speed"), -F.col("dspeed_1s")
    heading = F.col("heading_err") if "heading_err" in have else F.lit(None).cast("double")
    live = speed.isNotNull() & (F.col("x").isNotNull() if "x" in have else F.lit(True))
    slower = F.lit(True) if p.anomaly_slow_ratio is None else _true(F.least(ratio, F.coalesce(lap, F.lit(9.0))) < p.anomaly_slow_ratio)
    return {
        "on_track": live & ~F.col("in_pit") & ~F.col("suspended"), "pit": live & F.col("in_pit") & ~F.col("suspended"),
        "hard": _true(drop >= p.impact_hard_kmh), "fell": _true(drop >= p.impact_drop_kmh), "weak": _true(ratio < p.impact_end_ratio),
        "slow": _true((ratio < p.stop_ratio) & (lap.isNull() | (lap < p.stop_lap_ratio))), "creeping": _true(speed < p.stop_max_kmh),
        "fast": _true(ratio > p.recover_ratio), "turned": _true((heading > p.spin_heading_deg) & (speed > p.spin_min_kmh) & (drop >= p.spin_loss_kmh)),
        "off": _true(F.abs("lat_off") > p.spin_lat_m), "low": F.lit(False) if p.slowdown_lap_ratio is None else _true((lap < p.slowdown_lap_ratio) & (ratio < p.slowdown_rel_ratio)),
        "sank": _true(-F.col("dspeed_min_2s") >= p.slowdown_loss_kmh), "green": _true(F.col("track_status").isin("1", "2")),
        "odd": F.lit(False) if anomaly_threshold is None else slower & _true(F.col("anomaly_score") >= anomaly_threshold)}


#: The settings that may differ between the settings of a sweep, by the marks that depend on them.
DROP, STOP, LOW, FADE = ("impact_drop_kmh",), ("stop_ratio",), ("slowdown_lap_ratio", "slowdown_rel_ratio"), ("slowdown_lap_ratio", "slowdown_rel_ratio", "slowdown_sustain_s")


def differing(settings: Sequence[DetectorParams], names: tuple[str, ...]) -> tuple[list[DetectorParams], list[str]]:
    """One setting for each combination of these values, and for every setting the suffix of its combination's columns (none for the first)."""
    seen: dict[tuple, int] = {}
    of = [seen.setdefault(tuple(getattr(q, n) for n in names), len(seen)) for q in settings]
    return [settings[of.index(i)] for i in range(len(seen))], [_suffix(i) for i in of]


def _suffix(i: int) -> str:
    return f"_{i}" if i else ""


def car_timeline(df: DataFrame, p: DetectorParams | None = None, anomaly_threshold: float | None = None, chunk: int = CHUNK_TICKS,
                 settings: Sequence[DetectorParams] | None = None) -> DataFrame:
    """Dense car rows with what looks back: whether the car was braking, how long each run has lasted, when it was last seen. Settings share
    a row: what depends on them is a column for each combination of the values it depends on."""
    p, keys = p or DetectorParams(), CAR
    settings = settings or [p]
    drops, stops, lows = (differing(settings, names)[0] for names in (DROP, STOP, LOW))
    have = [c for c in INPUT if c in df.columns]
    gate_rows = race_gates(df, p, chunk).select("race", "tick", "grid", "live_share")
    rows = df.select(*keys, "tick", *have)
    rows = rows.join(F.broadcast(gate_rows) if is_small(gate_rows) else gate_rows, ["race", "tick"])
    speed = F.col("speed")
    c = conditions(have, p, anomaly_threshold)

    # what looks back a bounded time, in one pass
    second = int(p.impact_brake_window_s * TICKS_PER_S)
    rows = rows.withColumns({"active": c["on_track"] & ~F.col("grid"), "pit": c["pit"], "frozen": c["on_track"] & F.col("grid")})
    rows = with_history(rows, second + NEAR_TRIGGER, chunk)
    w = in_chunk(keys)
    rows = rows.withColumn("braked", F.max(F.when(F.col("active") & F.col("brake"), 1)).over(w.rangeBetween(-second, 0)).isNotNull())
    hard, soft = c["hard"], ~F.col("braked") | c["weak"]
    rows = rows.withColumns({"hard": hard} | {f"trigger{_suffix(i)}": F.col("active") & (hard | (conditions(have, q)["fell"] & soft)) for i, q in enumerate(drops)})
    away = F.col("grid") | F.col("suspended") | (F.col("live_share") < p.field_live_min)
    near = {f"_near{_suffix(i)}": F.max(F.when(F.col(f"trigger{_suffix(i)}"), 1)).over(w.rangeBetween(-NEAR_TRIGGER, -1)).isNotNull() for i in range(len(drops))}
    rows = rows.withColumns(near | {
        "_resumed": F.col("active") & ~_true(F.lag("active").over(w)),
        "_voided": (F.col("pit") | F.col("suspended")) & ~_true(F.lag(F.col("pit") | F.col("suspended")).over(w)),
        "_fast_before": _true(F.lag(speed).over(w) >= p.stop_max_kmh),
        "_away_before": F.coalesce(F.lag(away).over(w), F.lit(True)),
        "_back": speed.isNotNull() & ~F.col("suspended") & F.coalesce(F.lag(speed.isNull() | F.col("suspended")).over(w), F.lit(True))})
    rows = own_rows(rows, chunk, keep_chunk=True)

    # runs over the whole time line
    never = F.lit(None).cast("boolean")
    active, pit = F.col("active"), F.col("pit")
    starts = {"spin_since": F.when(F.col("frozen"), never).otherwise(active & (c["turned"] | c["off"])), "fast_since": F.when(active, c["fast"])}
    for i, q in enumerate(stops):
        starts[f"slow_since{_suffix(i)}"] = F.when(F.col("frozen"), never).otherwise(active & conditions(have, q)["slow"])
    for i, q in enumerate(lows):
        starts[f"fade_since{_suffix(i)}"] = F.when(active & conditions(have, q)["low"], F.when(c["sank"], F.lit(True))).when(active | pit, F.lit(False))
    racing = active & c["green"]
    if anomaly_threshold is not None:
        starts["odd_since"] = F.when(racing, c["odd"]).when(pit, F.lit(False))
    here = F.struct(F.col("tick"), speed.alias("speed"), F.col("in_pit"), F.col("msector"))
    return running(rows, keys, F.col("_chunk"), ["tick"], starts=starts,
                   lasts={"seen": F.when(speed.isNotNull() & ~F.col("suspended"), here)}).drop("_chunk")


def car_events(df: DataFrame, p: DetectorParams | None = None, anomaly_threshold: float | None = None, chunk: int = CHUNK_TICKS,
               settings: Sequence[DetectorParams] | None = None) -> DataFrame:
    """Dense car rows reduced to the rows on which a rule may fire, a latch may open or an impact may be settled, under any of the settings.
    `matters` and the near columns say under which of them."""
    p = p or DetectorParams()
    settings = settings or [p]
    have = [c for c in INPUT if c in df.columns]
    rows = car_timeline(df, p, anomaly_threshold, chunk, settings)
    speed, active = F.col("speed"), F.col("active")
    heading = F.col("heading_err") if "heading_err" in have else F.lit(None).cast("double")
    c = conditions(have, p, anomaly_threshold)
    turned, off, racing = c["turned"], c["off"], active & c["green"]
    away = F.col("grid") | F.col("suspended") | (F.col("live_share") < p.field_live_min)
    age = lambda n: (F.col("tick") - F.col(n)) / TICKS_PER_S
    gap = (F.col("tick") - F.col("seen.tick")) / TICKS_PER_S

    # a run that is long enough matters on its first such row: one tick old enough, or just resumed
    def first_of(a: Column, least) -> Column:
        return _true(a >= least) & (_true(a < least + 1.0 / TICKS_PER_S) | F.col("_resumed"))

    def long_slow(a: Column) -> Column:
        return _true(a >= p.stop_sustain_s) & c["creeping"] & (_true(a < p.stop_sustain_s + 1.0 / TICKS_PER_S) | F.col("_resumed") | F.col("_fast_before"))
    fire = {
        "c_recover": active & first_of(age("fast_since"), F.lit(p.recover_s)),
        "c_spin": active & (turned | off) & _true(age("spin_since") >= p.spin_sustain_s),
        "c_lost": speed.isNull() & ~away & _true(
            ~F.col("seen.in_pit") & (gap >= p.dropout_s) & (F.col("seen.speed") >= p.dropout_min_kmh)
            & ((gap < p.dropout_s + 1.0 / TICKS_PER_S) | F.col("_away_before"))),
        "c_odd": racing & _true(F.col("tick") - F.col("odd_since") + 1 >= p.anomaly_sustain) if anomaly_threshold is not None else F.lit(False),
        "turned": turned}
    drops, stops = differing(settings, DROP)[0], differing(settings, STOP)[0]
    fades, since = differing(settings, FADE)[0], dict(zip(settings, differing(settings, LOW)[1]))
    triggers, nears = [f"trigger{_suffix(i)}" for i in range(len(drops))], [f"near{_suffix(i)}" for i in range(len(drops))]
    by_setting = {n: active & F.col(f"_{n}") for n in nears}
    by_setting |= {f"c_stop{_suffix(i)}": active & long_slow(age(f"slow_since{_suffix(i)}")) for i in range(len(stops))}
    by_setting |= {f"c_fade{_suffix(i)}": active & conditions(have, q)["low"] & _true(age(f"fade_since{since[q]}") >= q.slowdown_sustain_s)
                   for i, q in enumerate(fades)}
    rows = rows.withColumns(fire | by_setting)
    any_of = lambda names: reduce(lambda a, b: a | b, [F.col(n) for n in names])
    rows = rows.withColumn("matters", (active & F.col("_resumed")) | any_of(["_voided", "_back", "c_recover", "c_spin", "c_lost", "c_odd"]))
    absent = F.lit(None).cast("double")
    return rows.filter(any_of(["matters", *triggers, *by_setting])).select(
        *CAR, "tick", "active", "pit", "suspended", "hard", "braked", "turned", "c_recover", "c_spin", "c_lost", "c_odd", "matters", *triggers,
        *by_setting, "speed", "ref_speed", "rel_ratio", "lap_ratio", "lat_off", F.col("msector").cast("int").alias("msector"), "dspeed_1s",
        heading.alias("heading_err"), (F.col("anomaly_score") if "anomaly_score" in have else absent).alias("anomaly_score"),
        F.col("seen.tick").alias("seen_tick"), F.col("seen.speed").alias("seen_speed"), F.col("seen.msector").cast("int").alias("seen_msector"))


DETECTED = "tick int, kind string, rank int, msector int, severity double, evidence string"


def car_step(p: DetectorParams, anomaly_threshold: float | None = None, edge: Callable[[int], float] = lambda t: t + 1):
    """Latches, the impact's wait and cooldowns over marked rows: `step(state, rows) -> (state, detections)`. `edge` is the tick from which
    the next call goes on; the state forgets what no longer matters there."""
    wait, gap, hit_span = p.impact_confirm_s * TICKS_PER_S, p.cooldown_s * TICKS_PER_S, 10 * TICKS_PER_S

    def below(v, limit) -> bool:
        return v is not None and v < limit

    def step(state: dict, rows: list[dict]) -> tuple[dict, list[dict]]:
        stopped, lost, pending, last = state.get("stopped", False), state.get("lost", False), state.get("pending"), dict(state.get("last", {}))
        made, t = [], 0

        def fire(kind: str, sector: int, severity: float, evidence: str, again: float = 0.0) -> None:
            """Says it, unless the last one of its kind is less than `again` ago."""
            if t - last.get(kind, -1e18) >= again:
                last[kind] = t
                made.append({"tick": int(t), "kind": kind, "rank": RANK[kind], "msector": int(sector), "severity": round(min(1.0, max(0.0, severity)), 2),
                             "evidence": evidence})

        for r in rows:
            t = r["tick"]
            if r["suspended"]:
                pending = None
                continue
            if r["speed"] is None and r["c_lost"] and not lost:
                fire("DROPOUT", r["seen_msector"], 0.5, f"no data for {(t - r['seen_tick']) / TICKS_PER_S + 1:.1f} s, last seen at {r['seen_speed']:.0f} km/h")
            lost = r["speed"] is None and (lost or r["c_lost"])
            if r["pit"]:
                stopped, pending = False, None
            if not r["active"]:
                continue
            speed, ratio, lap = r["speed"], r["rel_ratio"], r["lap_ratio"]
            side = None if r["lat_off"] is None else abs(r["lat_off"])
            close, crawling = below(side, p.on_line_m), below(ratio, p.stop_ratio)
            if not stopped and r["c_stop"]:
                where = "near the line" if close else "place unknown" if side is None else f"{side:.0f} m away from the line"
                fire("STOPPED", r["msector"], 0.45 + 0.25 * close + 0.15 * (speed < 5) + 0.15 * (t - last.get("IMPACT", -1e18) < hit_span),
                     f"{speed:.0f} of {0.0 if r['ref_speed'] is None else r['ref_speed']:.0f} km/h, {where}")
                stopped = True
            elif stopped:
                stopped = not r["c_recover"]
            if pending is None:
                if r["trigger"]:
                    pending = [t, -r["dspeed_1s"], speed - r["dspeed_1s"], r["hard"], r["braked"]]
            elif t - pending[0] >= wait:
                _, fell, before, hard, braked = pending
                pending = None
                if below(ratio, p.impact_hard_confirm_ratio if hard else 0.6) and (lap is None or lap < p.impact_lap_ratio):
                    how = "harder than brakes can" if hard else "brakes on" if braked else "no brakes"
                    fire("IMPACT", r["msector"], 0.5 + min(fell, 250) / 500 + 0.2 * crawling, f"{before:.0f} to {speed:.0f} km/h, {fell:.0f} lost within 1 s, {how}", gap)
            if r["c_spin"]:
                how = f"heading {r['heading_err']:.0f} deg off, {-r['dspeed_1s']:.0f} km/h lost within 1 s" if r["turned"] else f"{side:.0f} m beside the line"
                fire("SPIN", r["msector"], 0.4 + 0.2 * close + 0.2 * crawling + 0.1 * r["turned"], how, gap)
            if r["c_fade"] and not stopped:
                fire("SPIN", r["msector"], 0.4 + 0.3 * (1 - lap), f"{speed:.0f} km/h here, {lap:.0%} of the last lap", gap)
            if r["c_odd"]:
                fire("ANOMALY", r["msector"], 0.3 + min(0.5, (r["anomaly_score"] - anomaly_threshold) * 5), f"score {r['anomaly_score']:.2f} over {anomaly_threshold:.2f}", gap)
        held = {"IMPACT": max(gap, hit_span), "SPIN": gap, "ANOMALY": gap}
        kept = {"stopped": stopped, "lost": lost, "pending": pending, "last": {k: v for k, v in last.items() if edge(t) - v < held.get(k, 0)}}
        return {k: v for k, v in kept.items() if v}, made
    return step


def car_fold(events: DataFrame, p: DetectorParams | None = None, anomaly_threshold: float | None = None, chunk: int = CHUNK_TICKS,
             settings: Sequence[DetectorParams] | None = None) -> DataFrame:
    """(race, drv, tick, kind, rank, msector, severity, evidence): `car_step` over the marked rows; with settings once for each of them, whose
    number is the column cand."""
    edge = lambda t: (t // chunk + 1) * chunk
    if settings is None:
        return fold_in_time(events, CAR, ["tick"], car_step(p or DetectorParams(), anomaly_threshold, edge), DETECTED, size=chunk)
    steps = [car_step(q, anomaly_threshold, edge) for q in settings]
    names = list(zip(*(differing(settings, n)[1] for n in (DROP, STOP, FADE))))

    def step(state: dict, rows: list[dict]) -> tuple[dict, list[dict]]:
        ends, out = {}, []
        for cand, (one, (drop, stop, fade)) in enumerate(zip(steps, names)):
            marks = {"trigger": f"trigger{drop}", "near": f"near{drop}", "c_stop": f"c_stop{stop}", "c_fade": f"c_fade{fade}"}
            own = [r for r in rows if r["matters"] or any(r[n] for n in marks.values())]
            end, made = one(state.get(str(cand), {}), [{**r, **{n: r[of] for n, of in marks.items()}} for r in own]) if own else (state.get(str(cand), {}), [])
            if end:
                ends[str(cand)] = end
            out += [{"cand": cand, **m} for m in made]
        return ends, out

    return fold_in_time(events, CAR, ["tick"], step, f"cand int, {DETECTED}", size=chunk)


class Crowd:
    """Crashes of the last `span` ticks and the groups said within `hold` ticks, indexed by car and sector: a crash looks up whether a
    group that is out covers it, so that it costs the same however many cars crash with it. Crashes come in order."""

    def __init__(self, span: int, hold: int, n_sectors: int, recent: Iterable[dict] = (), said: Iterable[list] = ()) -> None:
        self.span, self.hold, self.n = span, hold, n_sectors
        self.recent, self.said, self.made = deque(), {}, 0
        self.crashes, self.where = Counter(), {}       # crashes of a sector, and of a car by sector
        self.groups, self.touched = {}, {}             # groups of a car, and those with a car that crashed in a sector
        for e in recent:
            self.enter(e)
        for m in said:
            self.say(m)

    def beside(self, sector: int) -> set[int]:
        return {(sector + d) % self.n for d in (-1, 0, 1)}

    def _touch(self, sector: int, group: int, by: int) -> None:
        at = self.touched.setdefault(sector, Counter())
        at[group] += by
        if not at[group]:
            del at[group]

    def enter(self, e: dict) -> None:
        sector, at = e["msector"] % self.n, self.where.setdefault(e["drv"], Counter())
        self.recent.append(e)
        self.crashes[sector] += 1
        at[sector] += 1
        if at[sector] == 1:
            for g in self.groups.get(e["drv"], ()):
                self._touch(sector, g, 1)

    def _leave(self) -> None:
        e = self.recent.popleft()
        sector, at = e["msector"] % self.n, self.where[e["drv"]]
        self.crashes[sector] -= 1
        at[sector] -= 1
        if not at[sector]:
            del at[sector]
            for g in self.groups.get(e["drv"], ()):
                self._touch(sector, g, -1)
        if not at:
            del self.where[e["drv"]]

    def say(self, m: list) -> None:
        """A group [tick, sector, cars] is out."""
        self.made += 1
        self.said[self.made] = m
        for car in m[2]:
            self.groups.setdefault(car, set()).add(self.made)
            for sector in self.where.get(car, ()):
                self._touch(sector, self.made, 1)

    def _forget(self, g: int) -> None:
        for car in self.said.pop(g)[2]:
            for sector in self.where.get(car, ()):
                self._touch(sector, g, -1)
            self.groups[car].discard(g)
            if not self.groups[car]:
                del self.groups[car]

    def new_group(self, tick: int, drv: str, msector: int) -> list[dict]:
        """The earlier crashes of other cars that make a new group with this one; none, if there are none or a group covers one of the cars."""
        while self.recent and self.recent[0]["tick"] < tick - self.span:
            self._leave()
        while self.said and tick - self.said[first := next(iter(self.said))][0] >= self.hold:
            self._forget(first)
        near, own = self.beside(msector), self.where.get(drv, {})
        if sum(self.crashes[s] - own.get(s, 0) for s in near) == 0:
            return []
        out = chain(self.groups.get(drv, ()), *(self.touched.get(s, ()) for s in near))
        if any(self.said[g][1] % self.n in near for g in out):
            return []
        return [e for e in self.recent if e["drv"] != drv and e["msector"] % self.n in near]


def multi_car(dets: DataFrame, p: DetectorParams | None = None, n_sectors: int = 1000, keys: list[str] = ["race"],
              chunk: int = CHUNK_TICKS) -> DataFrame:
    """MULTI: two or more cars with crash detections within `multi_window_s` in the same or adjacent
    sectors, unless a MULTI nearby already covers one of the cars. One fold over the crashes of a race in the order they
    arrive; a chunk also gets the crashes of the last seconds before it, so that its state is the MULTIs alone."""
    p = p or DetectorParams()
    span, hold = int(p.multi_window_s * TICKS_PER_S), int(p.cooldown_s * TICKS_PER_S)
    crash = dets.filter(F.col("kind").isin(*CRASH_TYPES)).select(
        *keys, "tick", "drv", "rank", F.col("msector").cast("int").alias("msector"), F.col("severity").cast("double").alias("severity"))
    crash = with_history(crash, span, chunk).withColumn("_at", F.greatest(F.col("tick"), F.col("_chunk") * chunk)).drop("_chunk")

    def step(state: dict, rows: list[dict]) -> tuple[dict, list[dict]]:
        crowd, made, end = Crowd(span, hold, n_sectors, said=state.get("live", [])), [], 0
        for r in rows:
            end = r["_at"]
            if r["tick"] == end:
                near = crowd.new_group(r["tick"], r["drv"], r["msector"])
                if near:
                    cars, sectors = sorted({r["drv"], *(e["drv"] for e in near)}), [r["msector"], *(e["msector"] for e in near)]
                    crowd.say([int(r["tick"]), int(r["msector"]), cars])
                    made.append({k: r[k] for k in ("tick", "drv", "rank", "msector")} | {
                        "worst": max([r["severity"], *(e["severity"] for e in near)]), "lo": min(sectors), "hi": max(sectors), "drivers": cars})
            crowd.enter(r)
        edge = (end // chunk + 1) * chunk
        live = [m for m in crowd.said.values() if edge - m[0] < hold]
        return ({"live": live} if live else {}), made

    found = fold_in_time(crash, keys, ["_at", "tick", "drv", "rank"], step,
                         "tick int, drv string, rank int, msector int, worst double, lo int, hi int, drivers array<string>",
                         on="_at", size=chunk)
    return found.select(
        *keys, "tick", F.lit("MULTI").alias("kind"), F.lit(9).alias("rank"), "drv", "msector", "drivers",
        F.round(F.least(F.lit(1.0), F.col("worst") + 0.15), 2).alias("severity"),
        F.format_string("%s together, sectors %d to %d, %s s", F.concat_ws(" and ", "drivers"), "lo", "hi",
                        fixed(F.lit(float(p.multi_window_s)))).alias("evidence"))


def detect(df: DataFrame, p: DetectorParams | None = None, n_sectors: int = 1000, anomaly_threshold: float | None = None,
           settings: Sequence[dict] | None = None, chunk: int = CHUNK_TICKS) -> DataFrame:
    """The whole suite over feature rows: (race, id, t, tick, drivers, msector, type, severity, evidence). With `settings`, overrides of p in
    the values of `params.SWEPT`, once for each of them, whose number is the column cand; the rows are marked and folded once for all."""
    p = p or DetectorParams()
    assert all(set(g) <= set(SWEPT) for g in settings or []), SWEPT
    lead, sets = ([], None) if settings is None else (["cand"], [replace(p, **g) for g in settings])
    cars = stored(car_fold(car_events(df, p, anomaly_threshold, chunk, sets), p, anomaly_threshold, chunk, sets))
    multi = multi_car(cars, p, n_sectors, [*lead, "race"], chunk)
    both = cars.withColumn("drivers", F.array("drv")).unionByName(multi.select(*cars.columns, "drivers"))
    return numbered_ids(both, [*lead, "race"], "det", chunk)


def numbered_ids(dets: DataFrame, keys: list[str], prefix: str, chunk: int = CHUNK_TICKS) -> DataFrame:
    """Detections in order of (tick, multi last, car, rule) with running ids per race."""
    ordered = dets.withColumn("_multi", (F.col("kind") == "MULTI").cast("int"))
    order = ["tick", "_multi", "drv", "rank"]
    ordered = running(ordered, keys, chunk_of("tick", chunk), order, sums={"_n": F.lit(1).cast("bigint")})
    return ordered.select(*keys, F.format_string(f"{prefix}-%06d", "_n").alias("id"),
                          (F.col("tick") / F.lit(float(TICKS_PER_S))).alias("t"), "tick", "drivers",
                          F.col("msector").cast("int").alias("msector"), F.col("kind").alias("type"), "severity", "evidence")


def naive(df: DataFrame, kmh: float | Sequence[float] = 50.0, sustain_s: float = 1.0, hold_s: float = 15.0, crawl_share: float = 0.5,
          chunk: int = CHUNK_TICKS) -> DataFrame:
    """The baseline: a car below a fixed speed outside the pit lane for `sustain_s`, once until it
    does 30 km/h more; nothing while suspended or within `hold_s` of a crawling field. Several speeds share the rows until a latch may
    change; the number of the speed is the column cand."""
    lead, limits = ([], [float(kmh)]) if isinstance(kmh, (int, float)) else (["cand"], [float(v) for v in kmh])
    keys, hold = [*lead, *CAR], int(hold_s * TICKS_PER_S)
    ticks = df.filter(~F.col("suspended")).groupBy("race", "tick").agg(F.first("field_slow").alias("_fs"))
    ticks = with_history(ticks, hold, chunk)
    crawl = F.max(F.when(F.col("_fs") >= crawl_share, F.col("tick"))).over(in_chunk(["race"]).rangeBetween(-hold, 0))
    ticks = own_rows(ticks.withColumn("_hold", _true(F.col("tick") < crawl + hold)), chunk).select("race", "tick", "_hold")
    cars = df.filter(~F.col("suspended")).join(F.broadcast(ticks) if is_small(ticks) else ticks, ["race", "tick"])
    speed = F.col("speed")
    slow = [_true(speed < v) & ~F.col("in_pit") & ~F.col("_hold") for v in limits]
    cars = running(cars.select(*CAR, "tick", "speed", "msector", "in_pit", "_hold"), CAR, chunk_of("tick", chunk), ["tick"],
                   starts={f"_since{i}": c for i, c in enumerate(slow)})
    marks = {}
    for i, v in enumerate(limits):
        marks[f"_cand{i}"] = slow[i] & _true(F.col("tick") - F.col(f"_since{i}") >= sustain_s * TICKS_PER_S)
        marks[f"_free{i}"] = ~slow[i] & _true(speed > v + 30)
    # a latch changes on the first row of a stretch only; an unknown row before counts as another state
    w = in_chunk(CAR)
    cars = with_history(cars.withColumns(marks).select(*CAR, "tick", "speed", "msector", *marks), 1, chunk)
    cars = own_rows(cars.withColumns({c: F.col(c) & ~_true(F.lag(c).over(w)) for c in marks}), chunk)
    each = F.array(*[F.struct(F.lit(i).alias("cand"), F.lit(v).alias("_kmh"), F.col(f"_cand{i}").alias("_cand"), F.col(f"_free{i}").alias("_free"))
                     for i, v in enumerate(limits)])
    cars = cars.withColumn("_at", F.explode(F.filter(each, lambda m: m["_cand"] | m["_free"])))
    few = stored(cars.select(*CAR, "tick", "speed", "msector", "_at.*"))
    state = F.when(F.col("_cand"), F.lit(True)).when(F.col("_free"), F.lit(False))
    hits = running(few, keys, chunk_of("tick", chunk), ["tick"], starts={"_at": state}).filter("_cand and _at = tick")
    hits = hits.select(*keys, "tick", F.lit("STOPPED").alias("kind"), F.lit(1).alias("rank"),
                       F.col("msector").cast("int").alias("msector"), F.lit(0.5).alias("severity"),
                       F.format_string("speed %s km/h < %s km/h", fixed("speed"), fixed("_kmh")).alias("evidence"),
                       F.array("drv").alias("drivers"))
    return numbered_ids(hits, [*lead, "race"], "base", chunk)
