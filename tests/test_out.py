"""Cars out of the race, against the definition looked up at every asked time."""

import random

from trackguard.operators import live as LI

SCHEMA = "race string, drv string, tick int, t double, speed double, in_pit boolean, msector int, suspended boolean, field_slow double, field_in_pit double"


def race_rows(seed):
    rng, rows = random.Random(seed), []
    for race in "ABC":
        mode, halted = {}, 0
        for k in range(300):
            halted = rng.randrange(4, 60) if rng.random() < 0.02 else max(0, halted - 1)
            field = (halted > 0 and rng.random() < 0.3, 0.8 if halted else 0.1, 0.7 if race == "B" and halted % 7 < 2 else 0.1)
            for d in "123456":
                if rng.random() < 0.02:
                    mode[d] = rng.choice(["go", "still", "gone", "pit"])
                m = mode.get(d, "go")
                if (d == "5" and k < 40) or (m == "gone" and rng.random() < 0.5):
                    continue
                speed = None if m == "gone" or (d == "6" and race == "C") else 5.0 if halted or m in ("still", "pit") else 150.0
                rows.append((race, d, k, k / 4, speed, m == "pit", 1 + (k // 50) % 4, *field))
    return rows


def by_definition(rows, asked, after):
    out = []
    for race, at in asked:
        own = [r for r in rows if r[0] == race]
        if not own:
            continue
        now = max([r[3] for r in own if r[4] is not None and r[3] <= at], default=at)
        field = {r[3]: r for r in own}
        for drv in sorted({r[1] for r in own}):
            seen = [r for r in own if r[1] == drv and r[4] is not None and r[3] <= at]
            if now - (seen[-1][3] if seen else min(field)) >= after:
                out.append((race, at, drv, "no data", seen[-1][3] if seen else None, seen[-1][6] if seen else None))
            elif seen and seen[-1][4] < LI.MOVE_KMH:
                first = max([i for i, r in enumerate(seen) if r[4] >= LI.MOVE_KMH], default=-1) + 1
                since, pit = seen[first][3], seen[-1][5]
                stops = [t for t, r in field.items() if since <= t < at and (r[7] or r[8] >= 0.5) and (pit or (r[8] >= 0.5 and r[9] < 0.5 and not r[7]))]
                cuts = sorted([since, *stops, at])
                if max(b - a for a, b in zip(cuts, cuts[1:])) >= after:
                    out.append((race, at, drv, "in the pit lane" if pit else "stopped", since, seen[-1][6]))
    return sorted(map(str, out))


def test_cars_out_equals_its_definition(spark):
    rows = race_rows(3)
    asked = [(r, k / 4 + 0.125 * (k % 3)) for r in "ABC" for k in range(0, 300, 7)] + [("A", -1.0), ("A", 500.0), ("Q", 3.0)]
    df, at = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(asked + asked[:5], "race string, t_at double")
    for after in (1.0, 12.0):
        want = by_definition(rows, asked, after)
        got = sorted(str(tuple(r)) for r in LI.cars_out(df, at, after).collect())
        assert len({w.split("'")[5] for w in want}) >= 2 and got == want, set(got) ^ set(want)


def test_spans_do_not_depend_on_chunks(spark):
    """Spans may be cut where a chunk begins, but cover the same times."""
    df = spark.createDataFrame(race_rows(5), SCHEMA)
    def covered(spans):
        return {(r["race"], r["drv"], r["why"], r["since"], k) for r in spans.collect() for k in range(1200)
                if r["t0"] <= k / 16 and (r["t1"] is None or k / 16 < r["t1"])}
    assert covered(LI.out_spans(df, 3.0, chunk=16)) == covered(LI.out_spans(df, 3.0))
