"""Many settings over one copy of the rows: the rows of a sweep are those of every setting alone."""

from dataclasses import replace

import pytest

from trackguard.operators import detectors as DE
from trackguard.operators.params import BASELINE_KMH, candidate_grid
from trackguard.plans import tables as T

NAMES = ["race", "id", "tick", "drivers", "msector", "type", "severity", "evidence"]


def rows(df):
    return sorted(tuple(r) for r in df.select(NAMES).collect())


def test_a_sweep_is_every_setting_alone(spark, sf):
    grid = [candidate_grid()[i] for i in (0, 14, 22, 35)]
    for chunk in (4096, 16):
        swept = DE.detect(T.features(spark, sf), T.SCALED, T.N, settings=grid, chunk=chunk).cache()
        for cand, g in enumerate(grid):
            alone = rows(DE.detect(T.features(spark, sf), replace(T.SCALED, **g), T.N, chunk=chunk))
            assert alone and rows(swept.filter(f"cand = {cand}")) == alone


def test_marked_rows_are_not_copied_per_setting(spark, sf):
    sets = [replace(T.SCALED, **g) for g in candidate_grid()]
    f = T.features(spark, sf)
    marked = DE.car_events(f, T.SCALED, settings=sets)
    assert marked.count() == marked.select("race", "drv", "tick").distinct().count() <= f.count()


def test_speeds_of_the_baseline_share_rows(spark, sf):
    swept = DE.naive(T.features(spark, sf), **{**T.NAIVE_SET, "kmh": BASELINE_KMH}).cache()
    for cand, kmh in enumerate(BASELINE_KMH):
        alone = rows(DE.naive(T.features(spark, sf), **{**T.NAIVE_SET, "kmh": kmh}))
        assert alone and rows(swept.filter(f"cand = {cand}")) == alone


def test_a_sweep_refuses_settings_that_it_does_not_vary(spark, sf):
    with pytest.raises(AssertionError):
        DE.detect(T.features(spark, sf), T.SCALED, T.N, settings=[{"cooldown_s": 1.0}])
