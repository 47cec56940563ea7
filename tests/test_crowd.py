"""Many cars that crash together."""

import random

from trackguard.operators import detectors as DE
from trackguard.plans.q_detect import SCALED


def plainly(crashes, span, hold, n):
    """The rule over all pairs of crashes."""
    apart = lambda a, b: abs((a - b + n // 2) % n - n // 2)
    said, out = [], []
    for i, (tick, drv, sector) in enumerate(crashes):
        near = [e for e in crashes[:i] if e[0] >= tick - span and e[1] != drv and apart(e[2], sector) <= 1]
        cars = sorted({drv, *(e[1] for e in near)})
        if near and not any(tick - m[0] < hold and apart(m[1], sector) <= 1 and set(m[2]) & set(cars) for m in said):
            said.append([tick, sector, cars])
            out.append((tick, drv, cars))
    return out


def test_the_index_gives_what_all_pairs_give():
    for seed in range(30):
        rng = random.Random(seed)
        n, cars = rng.choice([1, 2, 3, 10]), rng.choice([4, 20, 300])
        crashes = sorted((rng.randrange(60), str(rng.randrange(cars)), rng.randint(1, n)) for _ in range(200))
        crowd, got = DE.Crowd(4, 12, n), []
        for tick, drv, sector in crashes:
            near = crowd.new_group(tick, drv, sector)
            if near:
                together = sorted({drv, *(e["drv"] for e in near)})
                crowd.say([tick, sector, together])
                got.append((tick, drv, together))
            crowd.enter({"tick": tick, "drv": drv, "msector": sector})
        assert got == plainly(crashes, 4, 12, n)


def test_a_crash_does_not_carry_the_others(spark):
    rows = [("R", k % 3, str(k), "STOPPED", 1, 1 + k % 2, 0.5) for k in range(3000)]
    dets = spark.createDataFrame(rows, "race string, tick int, drv string, kind string, rank int, msector int, severity double")
    seen, fold = [], DE.fold_in_time

    def watched(rows, *args, **kw):
        seen.append(rows)
        return fold(rows, *args, **kw)
    DE.fold_in_time = watched
    try:
        made = DE.multi_car(dets, SCALED, 10).collect()
    finally:
        DE.fold_in_time = fold
    assert len(made) == 1 and len(made[0]["drivers"]) == 2
    assert all(f.dataType.simpleString().startswith("array") is False for f in seen[0].schema.fields)
