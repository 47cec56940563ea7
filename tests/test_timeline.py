"""Chunked windows, joins and folds against plain Python on random data, with chunks small enough to matter."""

import random

from pyspark.sql import functions as F

from trackguard.functions.stats import exact_quantiles
from trackguard.functions.timeline import asof_join, chunk_of, gap_islands, interval_join, numbered, running
from trackguard.operators.fold import cooldown


def series(seed, n=120, keys=("a", "b")):
    rnd = random.Random(seed)
    return [(k, i, rnd.choice([True, False, None]), rnd.choice([None, rnd.randint(0, 9)])) for k in keys for i in range(n)]


def test_running_values_cross_chunks(spark):
    rows = series(1)
    df = spark.createDataFrame(rows, "k string, tick int, s boolean, v int")
    got = running(df, ["k"], chunk_of("tick", 7), ["tick"], starts={"since": F.col("s")}, lasts={"last": F.col("v")},
                  lasts_before={"before": F.col("v")}, nexts={"after": F.col("v")}, sums={"total": F.col("v")}, maxs={"top": F.col("v")})
    got = {(r["k"], r["tick"]): r for r in got.collect()}
    for k in ("a", "b"):
        mine = [r for r in rows if r[0] == k]
        since, last, total, top = None, None, 0, None
        for i, (_, t, s, v) in enumerate(mine):
            before = last
            if s is True:
                since = t if since is None else since
            elif s is False:
                since = None
            last = v if v is not None else last
            total += v or 0
            top = v if top is None else max(top, v) if v is not None else top
            nxt = next((x[3] for x in mine[i + 1:] if x[3] is not None), None)
            r = got[k, t]
            assert (r["since"], r["last"], r["before"], r["after"], r["total"], r["top"]) == (since, last, before, nxt, total, top), (k, t)


def test_numbering_and_islands(spark):
    rnd = random.Random(2)
    times = sorted(rnd.sample(range(1000), 90))
    df = spark.createDataFrame([("a", float(t)) for t in times], "k string, t double")
    got = numbered(df, ["k"], chunk_of("t", 50), ["t"], "n").orderBy("t").collect()
    assert [r["n"] for r in got] == list(range(1, 91))
    isl = gap_islands(df, ["k"], chunk_of("t", 50), ["t"], 10.0).orderBy("t").collect()
    want, n = [], 0
    for i, t in enumerate(times):
        n += i == 0 or t - times[i - 1] > 10
        want.append(n)
    assert [r["island"] for r in isl] == want


def test_asof_join_with_and_without_staleness(spark):
    rnd = random.Random(3)
    left = [("a", i / 4) for i in range(200)]
    right = sorted({("a", rnd.uniform(0, 50)) for _ in range(15)})
    l, r = spark.createDataFrame(left, "k string, t double"), spark.createDataFrame([(k, t, t * 10) for k, t in right], "k string, rt double, v double")
    for stale in (None, 1.0):
        got = {x["t"]: x["v"] for x in asof_join(l, r, ["k"], "t", "rt", ["v"], 4.0, stale).collect()}
        for _, t in left:
            past = [rt for _, rt in right if rt <= t]
            want = None if not past or (stale is not None and t - past[-1] > stale) else past[-1] * 10
            assert got[t] == want, (stale, t)


def test_interval_join_equals_nested_loop(spark):
    rnd = random.Random(4)
    pts = [("a", i, rnd.uniform(0, 100)) for i in range(80)]
    spans = [("a", i, lo, lo + rnd.uniform(0, 30)) for i, lo in enumerate(rnd.uniform(0, 100) for _ in range(20))]
    p, s = spark.createDataFrame(pts, "k string, p int, t double"), spark.createDataFrame(spans, "k string, s int, lo double, hi double")
    got = {(r["p"], r["s"]) for r in interval_join(p, s, ["k"], "t", "lo", "hi", 8.0).collect()}
    assert got == {(a[1], b[1]) for a in pts for b in spans if b[2] <= a[2] <= b[3]}


def test_cooldown_is_the_serial_result_whatever_the_chunks(spark):
    rnd = random.Random(5)
    ticks = sorted(rnd.sample(range(400), 150))
    df = spark.createDataFrame([("a", t) for t in ticks] + [("b", 10 * t) for t in range(30)], "k string, tick int")
    want, last = [], None
    for t in ticks:
        if last is None or t - last >= 20:
            want.append(t)
            last = t
    for size in (64, 4096):
        got = cooldown(df, ["k"], 20, size=size)
        assert sorted(r["tick"] for r in got.filter("k = 'a'").collect()) == want
        assert sorted(r["tick"] for r in got.filter("k = 'b'").collect()) == list(range(0, 300, 20))


def test_quantiles_are_exact(spark, monkeypatch):
    import statistics

    import trackguard.functions.stats as stats
    monkeypatch.setattr(stats, "SMALL", 10)
    monkeypatch.setattr(stats, "SLOTS", 16)
    rnd = random.Random(6)
    values = [round(rnd.expovariate(1), 3) for _ in range(2001)] + [5.0] * 500
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = exact_quantiles(df, "v", [0.0, 0.5, 0.9, 1.0])
    assert got[0] == min(values) and got[3] == max(values) and got[1] == statistics.median(values)
    s = sorted(values)
    k = (len(s) - 1) * 0.9
    assert abs(got[2] - (s[int(k)] + (s[int(k) + 1] - s[int(k)]) * (k - int(k)))) < 1e-12
