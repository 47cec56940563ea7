"""SQL sub-tables the oracles are composed of."""

from trackguard.sources.adapter import GRID_SQL, LAPS_SQL, MESSAGES_SQL, OFFICIAL_SQL, RING_SQL

PARTS = {
    "grid": GRID_SQL,
    "official": OFFICIAL_SQL,
    "laps": LAPS_SQL,
    "messages": MESSAGES_SQL,
    "gridxy": f"SELECT *, {RING_SQL} FROM grid",
    # a row's own features, gaps to the neighbours on track, state of the field
    "gaps": """
        SELECT g.*, CASE WHEN ok AND n >= 2 THEN (((coalesce(nxt, fst) - dist) % 1000) + 1000) % 1000 END AS gap_ahead_m,
               CASE WHEN ok AND n >= 2 THEN (((dist - coalesce(prv, lst)) % 1000) + 1000) % 1000 END AS gap_behind_m,
               CASE WHEN ok AND n >= 2 THEN coalesce(nxt_drv, fst_drv) END AS ahead_drv
        FROM (SELECT grid.*, NOT in_pit AS ok, count(*) OVER p AS n, lead(dist) OVER w AS nxt, lag(dist) OVER w AS prv,
                     first_value(dist) OVER a AS fst, last_value(dist) OVER a AS lst,
                     lead(drv) OVER w AS nxt_drv, first_value(drv) OVER a AS fst_drv
              FROM grid WINDOW p AS (PARTITION BY race, tick, in_pit), w AS (PARTITION BY race, tick, in_pit ORDER BY dist, drv),
                   a AS (PARTITION BY race, tick, in_pit ORDER BY dist, drv ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) g""",
    "rowfeat": """
        SELECT *, speed - ref_speed AS speed_dev, speed / greatest(ref_speed, 30) AS speed_ratio, abs(lat_off) AS lat_off_abs,
               CASE WHEN brake AND throttle > 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS brake_throttle,
               CASE WHEN speed IS NOT NULL THEN gap_ahead_m / greatest(speed / 3.6, 1) END AS gap_ahead_s,
               CASE WHEN speed IS NOT NULL THEN gap_behind_m / greatest(speed / 3.6, 1) END AS gap_behind_s
        FROM gaps""",
    "field": """
        SELECT race, tick, avg(CASE WHEN speed IS NOT NULL THEN in_pit::INT::DOUBLE END) AS field_in_pit,
               coalesce(avg(CASE WHEN speed IS NOT NULL AND NOT in_pit THEN (speed < 30)::INT::DOUBLE END), 0) AS field_slow,
               coalesce(quantile_cont(CASE WHEN speed IS NOT NULL AND NOT in_pit THEN speed_ratio END, 0.5), 1) AS field_ratio,
               avg((speed IS NOT NULL)::INT::DOUBLE) AS live_share
        FROM rowfeat GROUP BY race, tick""",
    "fieldrows": """
        SELECT r.*, f.field_in_pit, f.field_slow, f.field_ratio, f.live_share,
               r.track_status = '5' OR coalesce(f.field_in_pit >= 0.5, false) AS suspended,
               r.speed_ratio / least(greatest(f.field_ratio, 0.2), 1.0) AS rel_ratio
        FROM rowfeat r JOIN field f USING (race, tick)""",
    # one lap of forward progress is 1000 m; every tick moves 60 m
    "dist1": """
        SELECT *, sum(CASE WHEN s > 0 AND s < 150 THEN s ELSE 0 END) OVER (PARTITION BY race, drv ORDER BY tick) AS race_dist
        FROM (SELECT *, (((dist - lag(dist) OVER (PARTITION BY race, drv ORDER BY tick) + 500) % 1000) + 1000) % 1000 - 500 AS s
              FROM fieldrows) q""",
    "samples": """
        SELECT race, drv, race_dist AS d0, speed AS v0, lead(race_dist) OVER w AS d1, lead(speed) OVER w AS v1
        FROM dist1 WHERE speed IS NOT NULL WINDOW w AS (PARTITION BY race, drv ORDER BY tick)""",
    "laprows": """
        SELECT q.*, CASE WHEN speed IS NOT NULL AND prev_lap_speed IS NOT NULL
                         THEN least(speed / greatest(prev_lap_speed, 20), 1.1) END AS lap_ratio
        FROM (SELECT a.* EXCLUDE (s), CASE WHEN b.d1 > b.d0 THEN (b.v1 - b.v0) / (b.d1 - b.d0) * (a.race_dist - 1000 - b.d0) + b.v0
                     ELSE b.v0 END AS prev_lap_speed
              FROM dist1 a ASOF LEFT JOIN samples b ON a.race = b.race AND a.drv = b.drv AND b.d0 <= a.race_dist - 1000) q""",
    "diffs": """
        SELECT *, speed - lag(speed, 4) OVER w AS dspeed_1s,
               CASE WHEN ahead_drv = lag(ahead_drv, 4) OVER w AND abs(lag(gap_ahead_m, 4) OVER w - gap_ahead_m) <= 100
                    THEN lag(gap_ahead_m, 4) OVER w - gap_ahead_m END AS closing_rate
        FROM laprows WINDOW w AS (PARTITION BY race, drv ORDER BY tick)""",
    "features": """
        SELECT *,
          CASE WHEN count(lat_off) OVER w8 >= 4 THEN stddev_samp(lat_off) OVER w8 END AS lat_off_std_2s,
          CASE WHEN count(throttle) OVER w8 >= 4 THEN stddev_samp(throttle) OVER w8 END AS throttle_std_2s,
          CASE WHEN count(speed_ratio) OVER w8 >= 2 THEN min(speed_ratio) OVER w8 END AS ratio_min_2s,
          CASE WHEN count(dspeed_1s) OVER w8 >= 2 THEN min(dspeed_1s) OVER w8 END AS dspeed_min_2s,
          CASE WHEN count(lat_off_abs) OVER w8 >= 2 THEN max(lat_off_abs) OVER w8 END AS lat_abs_max_2s,
          CASE WHEN count(brake_throttle) OVER w8 >= 2 THEN avg(brake_throttle) OVER w8 END AS brake_throttle_2s,
          CASE WHEN count(lap_ratio) OVER w8 >= 2 THEN min(lap_ratio) OVER w8 END AS lap_ratio_min_2s,
          CASE WHEN count(rel_ratio) OVER w8 >= 2 THEN min(rel_ratio) OVER w8 END AS rel_ratio_min_2s,
          CASE WHEN count(rel_ratio) OVER w20 >= 2 THEN min(rel_ratio) OVER w20 END AS rel_ratio_min_5s,
          CASE WHEN count(lap_ratio) OVER w20 >= 2 THEN avg(lap_ratio) OVER w20 END AS lap_ratio_mean_5s,
          CASE WHEN count(lap_ratio) OVER w20 >= 2 THEN min(lap_ratio) OVER w20 END AS lap_ratio_min_5s,
          CASE WHEN count(lat_off) OVER w20 >= 2 THEN stddev_samp(lat_off) OVER w20 END AS lat_off_std_5s,
          CASE WHEN count(throttle) OVER w20 >= 2 THEN stddev_samp(throttle) OVER w20 END AS throttle_std_5s,
          CASE WHEN count(brake_throttle) OVER w20 >= 2 THEN avg(brake_throttle) OVER w20 END AS brake_throttle_5s,
          CASE WHEN count(dspeed_1s) OVER w20 >= 2 THEN min(dspeed_1s) OVER w20 END AS dspeed_min_5s,
          CASE WHEN count(closing_rate) OVER w20 >= 2 THEN max(closing_rate) OVER w20 END AS closing_rate_max_5s
        FROM diffs WINDOW w8 AS (PARTITION BY race, drv ORDER BY tick ROWS BETWEEN 7 PRECEDING AND CURRENT ROW),
                          w20 AS (PARTITION BY race, drv ORDER BY tick ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""",
}

PARTS |= {
    # one row per tick of a race, with the scaled grid gate of the tests
    "ticks": """
        SELECT race, tick, min(t) AS t, min(track_status) AS track_status, bool_or(suspended) AS suspended,
               min(field_slow) AS field_slow, min(field_ratio) AS field_ratio, min(field_in_pit) AS field_in_pit,
               min(live_share) AS live_share
        FROM fieldrows GROUP BY race, tick""",
    "gates": """
        SELECT *, NOT suspended AND (coalesce(tick < crawl + 2, false)
                   OR coalesce(resumed > coalesce(crawl, -1) AND tick < resumed + 4, false)) AS grid
        FROM (SELECT *, max(CASE WHEN NOT suspended AND (field_slow >= 0.7 OR field_ratio < 0.1) THEN tick END) OVER w AS crawl,
                     max(CASE WHEN NOT suspended AND was AND tick - susp_from >= 1 THEN tick END) OVER w AS resumed
              FROM (SELECT *, lag(suspended) OVER w AS was, coalesce(max(CASE WHEN NOT suspended THEN tick END) OVER (
                           PARTITION BY race ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1,
                           min(tick) OVER (PARTITION BY race)) AS susp_from
                    FROM ticks WINDOW w AS (PARTITION BY race ORDER BY tick)) q
              WINDOW w AS (PARTITION BY race ORDER BY tick)) q""",
    # the baseline detector: below 30 km/h for 0.5 s, once until above 60 km/h; held for 0.5 s after a crawl
    "naiverows": """
        SELECT f.*, coalesce(f.speed < 30, false) AND NOT f.in_pit AND NOT coalesce(f.tick < h.crawl + 2, false) AS slow
        FROM fieldrows f JOIN (SELECT race, tick, max(CASE WHEN field_slow >= 0.7 THEN tick END)
                                        OVER (PARTITION BY race ORDER BY tick) AS crawl
                               FROM ticks WHERE NOT suspended) h USING (race, tick)
        WHERE NOT f.suspended""",
    "naivecands": """
        SELECT *, slow AND tick - min(CASE WHEN slow THEN tick END) OVER (PARTITION BY race, drv, b ORDER BY tick) >= 2 AS cand,
               NOT slow AND coalesce(speed > 60, false) AS freed
        FROM (SELECT *, sum(CASE WHEN slow THEN 0 ELSE 1 END) OVER (PARTITION BY race, drv ORDER BY tick) AS b FROM naiverows) q""",
    "naive": """
        SELECT race, 'base-' || lpad(CAST(row_number() OVER (PARTITION BY race ORDER BY tick, drv) AS VARCHAR), 6, '0') AS id,
               tick / 4.0::DOUBLE AS t, tick, drv, msector, speed
        FROM (SELECT *, row_number() OVER (PARTITION BY race, drv, g, cand ORDER BY tick) AS nth
              FROM (SELECT *, sum(CASE WHEN freed THEN 1 ELSE 0 END) OVER (PARTITION BY race, drv ORDER BY tick) AS g
                    FROM naivecands WHERE cand OR freed) q) q
        WHERE cand AND nth = 1""",
    "nalerts": """
        SELECT * FROM (SELECT *, lag(t) OVER (PARTITION BY race, drv ORDER BY t, id) AS p FROM naive) q
        WHERE p IS NULL OR t - p >= 5""",
    # official flags in groups without a pause of more than half a second
    "gapmsgs": """
        SELECT race, t, event_id, flag, msector, min(event_id) OVER (PARTITION BY race, isl) AS incident
        FROM (SELECT *, sum(brk) OVER (PARTITION BY race ORDER BY t, event_id) AS isl
              FROM (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY race ORDER BY t, event_id) <= 0.5 THEN 0 ELSE 1 END AS brk
                    FROM official WHERE flag <> 'CLEAR') q) q""",
    "gapinc": """
        SELECT race, incident, min(t) AS t, max(t) AS t_last, count(msector) = 0 AS wide, count(*) AS messages,
               arg_max(flag, list_position(['YELLOW', 'DOUBLE_YELLOW', 'VSC', 'SC', 'RED'], flag)) AS top_flag
        FROM gapmsgs GROUP BY race, incident""",
    # sectors an incident accepts: the flagged one, up to 2 downstream, 1 upstream; any when it is track-wide
    "gapsec": """
        SELECT DISTINCT race, incident, (((msector - 1 + d) % 10) + 10) % 10 + 1 AS msector
        FROM gapmsgs, (SELECT unnest([-1, 0, 1, 2]) AS d) k WHERE msector IS NOT NULL
        UNION SELECT race, incident, s FROM gapinc, (SELECT unnest(range(1, 11)) AS s) k WHERE wide""",
    "held": """
        SELECT n.race, n.id, n.msector, n.t AS t0, coalesce(min(CASE WHEN f.speed > 60 OR f.in_pit OR f.speed IS NULL THEN f.t END),
               least(max(f.t), n.t + 3), n.t) AS t1
        FROM naive n LEFT JOIN grid f ON f.race = n.race AND f.drv = n.drv AND f.t > n.t AND f.t <= n.t + 3
        GROUP BY n.race, n.id, n.msector, n.t""",
    "scores": """
        SELECT i.race, i.incident, i.t AS t_official, i.top_flag AS flag, h.hit IS NOT NULL OR coalesce(w.held, false) AS matched,
               h.hit IS NULL AND coalesce(w.held, false) AS held, round(i.t - h.hit.t, 2) AS lead_s, h.hit.id AS our_id
        FROM gapinc i
        LEFT JOIN (SELECT i.race, i.incident, min({t: n.t, id: n.id}) AS hit FROM gapinc i JOIN gapsec s USING (race, incident)
                   JOIN naive n ON n.race = i.race AND n.msector = s.msector AND n.t BETWEEN i.t - 1 AND i.t + 0.25
                   GROUP BY ALL) h USING (race, incident)
        LEFT JOIN (SELECT DISTINCT i.race, i.incident, true AS held FROM gapinc i JOIN gapsec s USING (race, incident)
                   JOIN held d ON d.race = i.race AND d.msector = s.msector AND i.t BETWEEN d.t0 AND d.t1) w USING (race, incident)""",
    "marked": """
        SELECT a.*, NOT EXISTS (SELECT 1 FROM gapinc i JOIN gapsec s USING (race, incident)
                                WHERE i.race = a.race AND s.msector = a.msector AND a.t BETWEEN i.t - 1 AND i.t_last + 0.5) AS false_alarm
        FROM nalerts a""",
    "hours": """
        SELECT race, sum(CASE WHEN suspended THEN 0 ELSE coalesce(nxt, t) - t END) / 3600 AS hours
        FROM (SELECT *, lead(t) OVER (PARTITION BY race ORDER BY tick) AS nxt FROM ticks) q GROUP BY race""",
    # calls standing in for recommendations where SQL has to know them
    "calls": """
        SELECT race, t, event_id, 'c' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS id, msector,
               ['YELLOW', 'DOUBLE_YELLOW', 'VSC', 'SC', 'RED', 'CLEAR'][CAST(event_id // 37 % 6 AS INT) + 1] AS flag,
               CASE WHEN event_id // 37 % 6 = 5 AND event_id // 37 % 12 < 6 THEN 'TRACK CLEAR' ELSE 'call' END AS message
        FROM grid WHERE event_id % 37 = 0""",
    "levels": """
        SELECT *, CASE flag WHEN 'VSC' THEN 0 WHEN 'SC' THEN 1 WHEN 'RED' THEN 2 ELSE -1 END AS lvl FROM calls
        WHERE flag IN ('VSC', 'SC', 'RED') OR message = 'TRACK CLEAR'""",
    "escs": """
        SELECT * FROM (SELECT *, lag(lvl) OVER (PARTITION BY race ORDER BY t, id) AS was FROM levels) q WHERE lvl >= 0 AND lvl >= coalesce(was, -1)""",
    # laps fit for a reference, their profiles and every car's own normal speed, with the scaled lap rules of the tests
    "lapok": """
        SELECT race, drv, drv_lap FROM fieldrows GROUP BY race, drv, drv_lap
        HAVING bool_and(track_status = '1' AND NOT in_pit AND NOT suspended) AND count(speed) >= 4 AND drv_lap >= 2""",
    "lapsamples": """
        SELECT f.race, f.drv, f.drv_lap, f.tick, f.dist, f.speed, lead(f.dist) OVER w AS nd, lead(f.speed) OVER w AS nv, lag(f.dist) OVER w AS pd
        FROM fieldrows f SEMI JOIN lapok USING (race, drv, drv_lap) WHERE f.speed IS NOT NULL
        WINDOW w AS (PARTITION BY f.race, f.drv, f.drv_lap ORDER BY f.dist, f.tick)""",
    "cleanlaps": """
        SELECT race, drv, drv_lap, row_number() OVER (PARTITION BY race, drv ORDER BY drv_lap) AS r FROM (
            SELECT race, drv, drv_lap FROM lapsamples GROUP BY ALL HAVING sum(CASE WHEN nd - dist <= 300 THEN nd - dist END) / 1000 >= 0.5) q""",
    "profiles": """
        SELECT race, drv, drv_lap, b::INT AS bin, CASE WHEN nd IS NULL OR b * 10 + 5 <= dist THEN speed
               ELSE speed + (b * 10 + 5 - dist) / (nd - dist) * (nv - speed) END AS v
        FROM lapsamples SEMI JOIN cleanlaps USING (race, drv, drv_lap), (SELECT unnest(range(100)) AS b) k
        WHERE (b * 10 + 5 >= dist OR pd IS NULL) AND (b * 10 + 5 < nd OR nd IS NULL)""",
    "lapbefore": """
        SELECT l.race, l.drv, l.drv_lap, count(c.r) AS before FROM (SELECT DISTINCT race, drv, drv_lap FROM fieldrows) l
        LEFT JOIN cleanlaps c ON c.race = l.race AND c.drv = l.drv AND c.drv_lap < l.drv_lap GROUP BY ALL""",
    "ownref": """
        SELECT l.race, l.drv, l.drv_lap, p.bin, median(p.v) AS own_ref FROM lapbefore l
        JOIN cleanlaps c ON c.race = l.race AND c.drv = l.drv AND c.r > l.before - 3 AND c.r <= l.before
        JOIN profiles p ON p.race = c.race AND p.drv = c.drv AND p.drv_lap = c.drv_lap GROUP BY ALL""",
    "own": """
        SELECT f.*, o.own_ref, f.speed / o.own_ref AS own_ratio FROM fieldrows f
        LEFT JOIN ownref o ON o.race = f.race AND o.drv = f.drv AND o.drv_lap = f.drv_lap AND o.bin = least(floor(f.dist / 10), 99)""",
    "onsets": """
        SELECT race, drv, s.tick AS tick, s.t AS t, s.dist AS dist, s.msector AS msector
        FROM (SELECT *, bool_and(hit) OVER (PARTITION BY race, drv ORDER BY tick ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AND
                     lag(mv, 2) OVER w AS run, lag({tick: tick, t: t, dist: dist, msector: msector}, 1) OVER w AS s
              FROM (SELECT o.*, coalesce(speed IS NOT NULL AND NOT in_pit AND NOT suspended AND track_status IN ('1', '2')
                                         AND own_ratio < 0.6 AND fm >= 0.5, false) AS hit, coalesce(own_ratio >= 0.6, false) AS mv
                    FROM own o LEFT JOIN (SELECT race, tick, median(own_ratio) AS fm FROM own WHERE speed IS NOT NULL AND NOT in_pit
                                          AND NOT suspended AND track_status IN ('1', '2') GROUP BY ALL) m USING (race, tick)) q
              WINDOW w AS (PARTITION BY race, drv ORDER BY tick)) q
        WHERE coalesce(run, false)""",
    "onsetcands": """
        SELECT i.race, i.incident, i.t, o.drv, o.t AS t_hit, o.dist, o.msector FROM gapinc i JOIN gapsec s USING (race, incident)
        JOIN onsets o ON o.race = i.race AND o.msector = s.msector AND o.t BETWEEN i.t - 5 AND i.t + 2""",
    "chains": """
        SELECT *, sum(brk) OVER (PARTITION BY race, incident ORDER BY t_hit, drv) AS chain
        FROM (SELECT *, CASE WHEN t_hit - lag(t_hit) OVER (PARTITION BY race, incident ORDER BY t_hit, drv) < 1 THEN 0 ELSE 1 END AS brk
              FROM onsetcands) q""",
    "picked": """
        SELECT c.race, c.incident, c.t, c.t_hit AS t_onset, c.drv AS onset_drv, c.dist AS onset_dist, c.msector AS onset_sector
        FROM chains c JOIN (SELECT race, incident, coalesce(max(CASE WHEN t_hit <= t THEN chain END), 1) AS want FROM chains GROUP BY ALL) w
          USING (race, incident)
        WHERE c.chain = w.want AND c.brk = 1""",
    "onsetcars": """
        SELECT p.race, p.incident, string_agg(DISTINCT c.drv, ',' ORDER BY c.drv) AS cars FROM picked p
        JOIN onsetcands c ON c.race = p.race AND c.incident = p.incident AND c.t_hit >= p.t_onset - 10 GROUP BY ALL""",
    # how each row counts for the rules, with the scaled settings of the tests
    "rulerows": """
        SELECT f.*, g.grid, g.live_share AS ls, f.speed IS NOT NULL AND NOT f.in_pit AND NOT f.suspended AND NOT g.grid AS act,
               f.speed IS NOT NULL AND NOT f.in_pit AND NOT f.suspended AND g.grid AS frozen,
               f.speed IS NOT NULL AND f.in_pit AND NOT f.suspended AS pit,
               coalesce(f.rel_ratio < 0.3 AND (f.lap_ratio IS NULL OR f.lap_ratio < 0.5), false) AS slow,
               coalesce(abs(f.lat_off) > 6, false) AS wide,
               coalesce(f.lap_ratio < 0.6 AND f.rel_ratio < 0.6, false) AS low,
               coalesce(-f.dspeed_min_2s >= 40, false) AS lost
        FROM features f JOIN gates g USING (race, tick)""",
    "rulestates": """
        SELECT *, CASE WHEN frozen THEN NULL ELSE act AND slow END AS s1, CASE WHEN frozen THEN NULL ELSE act AND wide END AS s2,
               CASE WHEN act AND low THEN CASE WHEN lost THEN true END WHEN act OR pit THEN false END AS s3,
               CASE WHEN act THEN coalesce(rel_ratio > 0.6, false) END AS s4
        FROM rulerows""",
    "rulebreaks": """
        SELECT *, sum((s1 IS NOT NULL AND NOT s1)::INT) OVER w AS b1, sum((s2 IS NOT NULL AND NOT s2)::INT) OVER w AS b2,
               sum((s3 IS NOT NULL AND NOT s3)::INT) OVER w AS b3, sum((s4 IS NOT NULL AND NOT s4)::INT) OVER w AS b4,
               last_value(CASE WHEN speed IS NOT NULL AND NOT suspended THEN tick END IGNORE NULLS) OVER w AS seen_tick,
               last_value(CASE WHEN speed IS NOT NULL AND NOT suspended THEN speed END IGNORE NULLS) OVER w AS seen_speed,
               last_value(CASE WHEN speed IS NOT NULL AND NOT suspended THEN in_pit END IGNORE NULLS) OVER w AS seen_pit,
               last_value(CASE WHEN speed IS NOT NULL AND NOT suspended THEN msector END IGNORE NULLS) OVER w AS seen_sector
        FROM rulestates WINDOW w AS (PARTITION BY race, drv ORDER BY tick)""",
    "cands": """
        SELECT *, act AND coalesce(tick - min(CASE WHEN s1 THEN tick END) OVER (PARTITION BY race, drv, b1 ORDER BY tick) >= 2, false)
                    AND speed < 60 AS c_stop,
               act AND coalesce(tick - min(CASE WHEN s4 THEN tick END) OVER (PARTITION BY race, drv, b4 ORDER BY tick) >= 2, false) AS c_recover,
               act AND wide AND coalesce(tick - min(CASE WHEN s2 THEN tick END) OVER (PARTITION BY race, drv, b2 ORDER BY tick) >= 2, false) AS c_spin,
               act AND low AND coalesce(tick - min(CASE WHEN s3 THEN tick END) OVER (PARTITION BY race, drv, b3 ORDER BY tick) >= 2, false) AS c_fade,
               speed IS NULL AND NOT suspended AND NOT grid AND coalesce(NOT seen_pit AND tick - seen_tick >= 1 AND seen_speed >= 30
                    AND ls >= 0.6, false) AS c_lost
        FROM rulebreaks""",
    "latches": """
        SELECT *, c_stop AND row_number() OVER (PARTITION BY race, drv, g1, c_stop ORDER BY tick) = 1 AS f_stop,
               max(CASE WHEN c_stop THEN 1 ELSE 0 END) OVER (PARTITION BY race, drv, g1 ORDER BY tick) = 1 AS stopped,
               c_lost AND row_number() OVER (PARTITION BY race, drv, g2, c_lost ORDER BY tick) = 1 AS f_lost
        FROM (SELECT *, sum((NOT c_stop AND (pit OR c_recover))::INT) OVER w AS g1,
                     sum((speed IS NOT NULL AND NOT suspended)::INT) OVER w AS g2
              FROM cands WINDOW w AS (PARTITION BY race, drv ORDER BY tick)) q""",
    "spincands": "SELECT * FROM latches WHERE c_spin OR (c_fade AND NOT stopped)",
    "spinpicks": """
        SELECT race, drv, min(tick) AS tick FROM spincands GROUP BY race, drv
        UNION ALL
        SELECT p.race, p.drv, (SELECT min(c.tick) FROM spincands c WHERE c.race = p.race AND c.drv = p.drv AND c.tick >= p.tick + 20)
        FROM spinpicks p WHERE p.tick IS NOT NULL""",
}

FEATURES = ["grid", "gaps", "rowfeat", "field", "fieldrows", "dist1", "samples", "laprows", "diffs", "features"]
TICKS = ["grid", "gaps", "rowfeat", "field", "fieldrows", "ticks"]
NAIVE = TICKS + ["naiverows", "naivecands", "naive"]
RULES = FEATURES + ["ticks", "gates", "rulerows", "rulestates", "rulebreaks", "cands", "latches"]
INC = ["official", "gapmsgs", "gapinc", "gapsec"]
SCORES = NAIVE + ["nalerts"] + INC + ["held", "scores", "marked", "hours"]
OWN = TICKS + ["lapok", "lapsamples", "cleanlaps", "profiles", "lapbefore", "ownref", "own"]
ONSETS = OWN + INC + ["onsets", "onsetcands", "chains", "picked", "onsetcars"]
