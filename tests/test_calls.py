"""The call log against its definition, looked up row by row over everything before."""

import random

from trackguard.operators import live as LI

SECTORS = 10


def races(seed, n_races=4):
    rng, recs, offs, dets = random.Random(seed), [], [], []
    for race in (f"R{i}" for i in range(n_races)):
        for k in range(40):
            flag = rng.choice(["YELLOW", "DOUBLE_YELLOW", "VSC", "SC", "RED", "CLEAR", "CLEAR", "BLUE"])
            found = [f"det-{k:03d}{i}" for i in range(rng.randrange(0, 3))]
            dets += [(race, d, [str(rng.randrange(1, 30)) for _ in range(2)], rng.choice(["STOPPED", "ANOMALY", "SPIN"])) for d in found]
            text = ("TRACK CLEAR" if rng.random() < 0.4 else "CLEAR") if flag == "CLEAR" else flag
            recs.append((race, rng.randrange(0, 2400) / 4, f"rec-{k:06d}", flag, rng.randrange(1, 8), text,
                         rng.choice(["advisory: stays", "stop", "stop", None]), found))
        for k in range(30):
            wide = rng.random() < 0.5
            flag = rng.choice(["VSC", "SC", "RED", "CLEAR"] if wide else ["YELLOW", "DOUBLE_YELLOW", "CLEAR"])
            offs.append((race, rng.randrange(0, 2400) / 4, k, flag, None if wide else rng.randrange(1, 8)))
    return recs, offs, dets


def near(ours, flagged):
    return any((flagged + d) % SECTORS == ours % SECTORS for d in (-1, 0, 1, 2))


def by_definition(recs, offs, dets):
    types = {(d[0], d[1]): d for d in dets}
    out = []
    for race in sorted({r[0] for r in recs}):
        rows = sorted((r for r in recs if r[0] == race and r[3] in LI.RANKS), key=lambda r: (r[1], r[2]))
        rank = [LI.RANKS[r[3]] for r in rows]
        scope = ["TRACK" if r[5] == "TRACK CLEAR" or r[3] in LI.WIDE else str(r[4]) for r in rows]

        def level(i):                        # of the row's scope, before the row
            since = max([j for j in range(i) if scope[j] == scope[i] and rank[j] == 0], default=-1)
            return max([rank[j] for j in range(since + 1, i) if scope[j] == scope[i]], default=0)
        lifts = [i for i in range(len(rows)) if rank[i] > level(i)]
        drops = [i for i in range(len(rows)) if rank[i] == 0 and level(i)]
        loud = [i for i in lifts if "advisory" not in (rows[i][6] or "")]
        for i in loud:
            zone = str(rows[i][4])
            since = max([j for j in drops if j < i and scope[j] == zone], default=-1)
            why = [j for j in range(since + 1, i + 1) if rank[j] and str(rows[j][4]) == zone and rows[j][7]]
            cars, kind = [], None
            if why:
                behind = [types[race, d] for d in rows[why[-1]][7]]
                cars = sorted({c for d in behind for c in d[2]}, key=int)
                kind = max(behind, key=lambda d: (d[3] != "ANOMALY", d[1]))[3]
            out.append((race, rows[i][1], "raise", rows[i][3], scope[i], ",".join(cars), kind, None))
        out += [(race, rows[i][1], "clear", "CLEAR", scope[i], None, None, None) for i in drops]

        told, said = set(), sorted((o for o in offs if o[0] == race and LI.RANKS[o[3]]), key=lambda o: (o[1], o[2]))
        for _, t, _, flag, sector in said:
            starts = []
            for s in {"TRACK"} if sector is None else {s for s in map(str, range(1, 8)) if near(int(s), sector)}:
                notes = [i for i in range(len(rows)) if rows[i][1] < t and (
                    (i in lifts and scope[i] == s) or (i in loud and scope[i] == "TRACK" and str(rows[i][4]) == s))]
                if notes:
                    ends = [j for j in drops if scope[j] == s and rows[j][1] < t]
                    before_last = max([j for j in ends if j < notes[-1]], default=-1)
                    mine = [i for i in notes if i > before_last]
                    if not any(j > notes[-1] for j in ends) or rows[mine[0]][1] >= t - LI.CONFIRM_WINDOW_S:
                        starts.append((rows[mine[0]][1], max(rank[i] for i in mine)))
            if not starts:
                continue
            start, reached = min(starts)
            first = any(start - LI.CONFIRM_WINDOW_S <= o[1] < start and (o[4] is None or (sector is not None and near(sector, o[4]))) for o in said)
            if first or (sector is None and reached < LI.RANKS[flag]) or t - start < LI.MIN_LEAD_S or (sector is None, start) in told:
                continue
            told.add((sector is None, start))
            out.append((race, t, "confirm", flag, "TRACK" if sector is None else str(sector), None, None, round(t - start, 2)))
    return sorted(map(str, out))


def test_call_log_equals_its_definition(spark):
    recs, offs, dets = races(11)
    r = spark.createDataFrame(recs, "race string, t double, id string, flag string, msector int, message string, reason string, source_detections array<string>")
    o = spark.createDataFrame(offs, "race string, t double, event_id bigint, flag string, msector int")
    d = spark.createDataFrame(dets, "race string, id string, drivers array<string>, type string")
    want = by_definition(recs, offs, dets)
    assert {"raise", "clear", "confirm"} <= {w.split("'")[3] for w in want}
    for size in (32.0, 4096.0):
        got = sorted(str(tuple(x)) for x in LI.call_log(r, o, d, SECTORS, size).collect())
        assert got == want, (size, set(got) ^ set(want))


def test_call_log_of_nothing(spark):
    r = spark.createDataFrame([], "race string, t double, id string, flag string, msector int, message string, reason string, source_detections array<string>")
    o = spark.createDataFrame([("R", 1.0, 1, "SC", None)], "race string, t double, event_id bigint, flag string, msector int")
    d = spark.createDataFrame([], "race string, id string, drivers array<string>, type string")
    assert LI.call_log(r, o, d, SECTORS).count() == 0
