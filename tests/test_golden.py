"""Numbers that other programs publish for small data."""

import pytest
from pyspark.sql import functions as F

from braggframe.functions.symmetry import spacegroup
from braggframe.operators import alignment, reflections

# Twelve published observations (h, k, l, intensity, deviation).
TWELVE = [
    (2, 0, 0, 915.6, 3.686), (0, 2, 0, 558.4, 3.093), (0, 0, 2, 630.1, 24.05), (2, 0, 0, 925.6, 3.686), (0, 2, 0, 258.4, 3.093), (0, 0, 2, 730.1, 24.05),
    (1, 1, 2, 23.95, 89.32), (1, 2, 1, 90.65, 7.407), (2, 1, 1, 59.81, 9.125), (1, 1, 2, 33.95, 89.32), (1, 2, 1, 90.65, 7.407), (2, 1, 1, 16.08, 22.15),
]


@pytest.fixture(scope="module")
def observations(spark):
    df = spark.createDataFrame(TWELVE, "h int, k int, l int, value double, sigma double")
    return reflections.prepared(df, spacegroup("P 2 3")).withColumn("shell", F.lit(0))


@pytest.mark.parametrize("weights, merge, meas, pim, digits", [("Y", 0.3214, 0.3520, 0.1437, 5e-5), ("X", 0.312, 0.342, 0.139, 5e-4)])
def test_merging_statistics(observations, weights, merge, meas, pim, digits):
    s = reflections.merging_statistics(reflections.merging_sums(observations, ["h", "k", "l", "isign"], "shell", weights)).first()
    assert (s.all_refl, s.unique_refl, s.stats_refl) == (12, 2, 2)
    assert abs(s.r_merge - merge) < digits and abs(s.r_meas - meas) < digits and abs(s.r_pim - pim) < digits


def test_cc_half(observations):
    s = reflections.merging_statistics(reflections.merging_sums(observations, ["h", "k", "l", "isign"], "shell", "U")).first()
    assert abs(s.cc_half - 0.94582) < 5e-6


def test_merged(observations):
    assert reflections.merged(observations, ["h", "k", "l"]).count() == 2


def test_alignment_of_days():
    assert alignment.align("Saturday", "Sunday", match=0, mismatch=-1, gap_open=0, gap_extend=-1) == (-3, "1M2I5M")
