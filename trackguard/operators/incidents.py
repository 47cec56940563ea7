"""Official messages grouped into incidents, and what matches them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from trackguard.functions.ring import sector_matches
from trackguard.functions.timeline import asof_join, interval_join
from trackguard.operators.fold import fold_in_time

INCIDENT_FLAGS = ["YELLOW", "DOUBLE_YELLOW", "VSC", "SC", "RED"]
ESCALATIONS = ["VSC", "SC", "RED"]
JOIN_S, JOIN_SECTORS = 120.0, 2
MATCH_BEFORE_S, MATCH_AFTER_S = 60.0, 10.0
BUCKET_S = 1024.0


def severity(flag: Column) -> Column:
    """Place of an incident flag in the order of severity, 0 for a yellow."""
    return F.array_position(F.array(*[F.lit(f) for f in INCIDENT_FLAGS]), flag) - 1


def suspended_at(rows: DataFrame, df: DataFrame, t: str = "t") -> DataFrame:
    """Adds suspended as of t (the first tick's state before it)."""
    ticks = df.groupBy("race", "tick").agg(F.first("t").alias("_tt"), F.first("suspended").alias("_susp"))
    first = ticks.groupBy("race").agg(F.min_by("_susp", "_tt").alias("_first"))
    out = asof_join(rows, ticks, ["race"], t, "_tt", ["_susp"], BUCKET_S)
    return out.join(first, "race", "left").withColumn("suspended", F.coalesce("_susp", "_first")).drop("_susp", "_first")


def build_incidents(official: DataFrame, df: DataFrame, n_sectors: int, window: DataFrame | None = None,
                    join_s: float = JOIN_S, size: float = 4096.0) -> DataFrame:
    """Messages (race, t, event_id, flag, msector) with the incident each belongs to: `incident` is the
    event_id of its first message. Messages outside the race window or during a suspension are left
    out. The grouping is a fold over the messages: a flag stays shown until race control clears it."""
    if window is not None:
        official = official.join(window, "race").filter("t between t_start and t_end").drop("t_start", "t_end")
    clears = F.col("flag") == "CLEAR"
    msgs = suspended_at(official.filter(clears | F.col("flag").isin(INCIDENT_FLAGS)), df)
    msgs = msgs.filter(clears | ~F.coalesce("suspended", F.lit(False))).select("race", "t", "event_id", "flag", "msector")
    half = n_sectors // 2

    def step(state: dict, rows: list[dict]) -> tuple[dict, list[dict]]:
        shown = {int(k): v for k, v in state.get("shown", {}).items()}      # sector -> incident
        last = {int(k): v for k, v in state.get("last", {}).items()}        # incident -> its last message
        made, now = [], 0.0
        for r in rows:
            now, sector = r["t"], None if r["msector"] != r["msector"] or r["msector"] is None else int(r["msector"])
            if r["flag"] == "CLEAR":
                shown = {} if sector is None else {k: v for k, v in shown.items() if k != sector}
                continue
            recent = [i for i in last if now - last[i] <= join_s]
            home = None
            if sector is not None and sector in shown:
                home = shown[sector]
            elif sector is None and shown:
                home = max(shown.values(), key=lambda i: (last[i], list(last).index(i)))
            elif sector is None:
                home = recent[-1] if recent else None
            else:
                for i in reversed(recent):
                    if any(abs((sector - a + half) % n_sectors - half) <= JOIN_SECTORS for a, v in shown.items() if v == i):
                        home = i
                        break
            if home is None:
                home = int(r["event_id"])
            last[home] = now
            if sector is not None:
                shown[sector] = home
            made.append({"t": now, "event_id": int(r["event_id"]), "flag": r["flag"], "msector": sector, "incident": home})
        edge = (now // size + 1) * size
        alive = set(shown.values())
        # the order of `last` is the order incidents began in; keep it as a list
        kept = [[i, t] for i, t in last.items() if i in alive or edge - t <= join_s]
        out = {}
        if shown:
            out["shown"] = {str(k): v for k, v in shown.items()}
        if kept:
            out["kept"] = kept
        return out, made

    def with_order(state: dict, rows: list[dict]) -> tuple[dict, list[dict]]:
        return step({"shown": state.get("shown", {}), "last": {i: t for i, t in state.get("kept", [])}}, rows)

    return fold_in_time(msgs, ["race"], ["t", "event_id"], with_order,
                        "t double, event_id bigint, flag string, msector int, incident bigint", on="t", size=size)


def incident_table(msgs: DataFrame) -> DataFrame:
    """One row per incident: (race, incident, t, t_last, top_flag, sectors, track_wide, messages)."""
    return msgs.groupBy("race", "incident").agg(
        F.min("t").alias("t"), F.max("t").alias("t_last"), F.max_by("flag", severity(F.col("flag"))).alias("top_flag"),
        F.array_sort(F.collect_set("msector")).alias("sectors"), (F.count("msector") == 0).alias("track_wide"),
        F.count(F.lit(1)).alias("messages"))


def in_sectors(msector: Column, sectors: Column, n: int) -> Column:
    """The sector fits one of the incident's; a track-wide incident fits any."""
    return (F.size(sectors) == 0) | F.exists(sectors, lambda s: sector_matches(msector, s, n))


def match_incidents(incidents: DataFrame, hits: DataFrame, n: int, before: float = MATCH_BEFORE_S,
                    after: float = MATCH_AFTER_S, hi: str = "t", bucket: float = 256.0) -> DataFrame:
    """Hits (race, t_hit, hit_sector, ...) joined to the incidents whose window and sectors they fit."""
    spans = incidents.withColumns({"lo": F.col("t") - before, "hi": F.col(hi) + after})
    return interval_join(hits, spans, ["race"], "t_hit", "lo", "hi", bucket,
                         extra=in_sectors(F.col("hit_sector"), F.col("sectors"), n)).drop("lo", "hi")
