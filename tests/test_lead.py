"""Our first call for an official flag, against every pair of them."""

import random

from trackguard.operators import live as LI


def test_first_calls_equal_those_of_all_pairs_and_no_join_makes_pairs(spark):
    rng, n = random.Random(5), 6
    flags = ["YELLOW", "DOUBLE_YELLOW", "VSC", "SC", "RED", "CLEAR"]
    off = [(r, rng.randrange(1200) / 4, k, f, rng.randint(1, n) if f in flags[:2] else None) for k in range(300) for r, f in [(rng.choice("AB"), rng.choice(flags))]]
    recs = [(r, rng.randrange(1200) / 4, f"c{k}", f, rng.choice([None, *range(1, n + 1)])) for k in range(120) for r, f in [(rng.choice("AB"), rng.choice(flags))]]
    official = spark.createDataFrame(off, "race string, t double, event_id long, flag string, msector int")
    got = LI.our_match(official, spark.createDataFrame(recs, "race string, t double, id string, flag string, msector int"), n, 5.0, 2.0)
    want = set()
    for race, t, event, flag, sector in off:
        if flag != "CLEAR":
            begin = [s for r, s, _, f, m in off if sector is None and r == race and f != "CLEAR" and m is not None and t - 120 <= s < t]
            start = min(begin, default=t)
            fits = [s for r, s, _, f, m in recs if r == race and f != "CLEAR" and start - 5 <= s <= t + 2
                    and (f in LI.WIDE if sector is None else f not in LI.WIDE and m is not None and (m - sector) % n in (0, 1, n - 1))]
            want.add((event, start, min(fits, default=None)))
    assert {(r.event_id, r.start, r.t_ours) for r in got.collect()} == want and any(w[2] is not None for w in want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join " in line and (" >= " in line or " <= " in line)]
