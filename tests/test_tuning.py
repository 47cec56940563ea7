"""The tuning run: 36 detector settings and 4 baselines scored on every race, and the choice made from those scores."""

from dataclasses import replace

from trackguard.operators import detectors as DE, scoring as SC
from trackguard.operators.params import BASELINE_KMH, candidate_grid
from trackguard.plans import q_eval as Q, tables as T
from trackguard.plans.catalog import QUERIES


def best(rows, budget):
    """The reference's choice among (cand, matched, false alarms, hours)."""
    sums = {}
    for r in rows:
        m, fa, h = sums.get(r.cand, (0, 0, 0.0))
        sums[r.cand] = (m + r.matched, fa + r.false_alarms, h + r.hours)
    ok = [(-m, fa / h, c) for c, (m, fa, h) in sums.items() if fa / h <= budget]
    return min(ok)[2] if ok else min((fa / h, c) for c, (m, fa, h) in sums.items())[1]


def test_every_setting_has_its_scores_on_every_race(spark, sf):
    rows = QUERIES["h12_baseline_grid"](spark, sf).collect()
    races = {r.race for r in T.features(spark, sf).select("race").distinct().collect()}
    want = {("detectors", i, r) for i in range(len(candidate_grid())) for r in races} | {("baseline", i, r) for i in range(len(BASELINE_KMH)) for r in races}
    assert len(rows) == len(want) and {(r.system, r.cand, r.race) for r in rows} == want
    for cand in (0, 14):                # the suite run with that setting alone
        dets = SC.rule_alerts(DE.detect(T.features(spark, sf), replace(T.SCALED, **candidate_grid()[cand]), T.N))
        inc = T.gap_incidents(spark, sf)
        s = SC.incident_scores(T.features(spark, sf), inc, dets, T.N, max_hold=3.0, **Q.SPAN)
        one = SC.race_summary(s, SC.false_alarms(SC.alerts(dets, gap=5.0), inc, T.N, before=1.0, after=0.5), SC.race_hours(T.features(spark, sf)))
        names = ["race", "incidents", "matched", "held", "alerts", "false_alarms", "median_lead_s"]
        assert sorted(tuple(r[n] for n in names) for r in one.collect()) == sorted(tuple(r[n] for n in names) for r in rows if (r.system, r.cand) == ("detectors", cand))


def test_settings_are_chosen_from_the_scores(spark, sf):
    rows = QUERIES["h12_baseline_grid"](spark, sf).collect()
    own = {s: [r for r in rows if r.system == s] for s in ("detectors", "baseline")}
    got = {(r.system, r.budget): r.cand for r in QUERIES["h13_tuned_setting"](spark, sf).collect()}
    assert got == {(s, b): best(own[s], b) for s in own for b in Q.BUDGETS}
    left = {(r.system, r.budget, r.race): (r.cand, r.matched) for r in QUERIES["h14_tuned_leave_one_race_out"](spark, sf).collect()}
    races = {r.race for r in rows}
    assert set(left) == {(s, b, race) for s in own for b in Q.BUDGETS for race in races}
    for (s, b, race), (cand, matched) in left.items():
        assert cand == best([r for r in own[s] if r.race != race], b)
        assert matched == next(r.matched for r in own[s] if (r.race, r.cand) == (race, cand))
