"""Tail expressions against published critical values and identities."""

import math

import pytest
from liftlake.functions import tails


def test_normal_tail_matches_erfc(spark):
    zs = [-3.0, -0.5, 0.0, 0.3, 1.0, 1.96, 3.5, 8.0, 20.0, 35.0]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select("z", tails.normal_sf("z").alias("p"))
    for z, p in rows.collect():
        assert p == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=1e-9)


def test_student_t(spark):
    table = [
        (12.706204736, 1, 0.05), (4.302652730, 2, 0.05), (2.570581836, 5, 0.05), (2.228138852, 10, 0.05), (2.042272456, 30, 0.05),
        (3.169272673, 10, 0.01), (1.962339081, 1000, 0.05), (1.959966356, 1e6, 0.05), (0.0, 7, 1.0),
    ]
    rows = spark.createDataFrame([(float(t), float(d), p) for t, d, p in table], "t double, df double, p double")
    for r in rows.withColumn("got", tails.student_t_two_sided("t", "df")).collect():
        assert r["got"] == pytest.approx(r["p"], rel=2e-7)


def test_missing_statistics_stay_missing(spark):
    row = spark.sql("select cast(null as double) t, 5D df").select(
        tails.student_t_two_sided("t", "df"), tails.normal_two_sided("t"), tails.chi_square_sf("t", "3"), tails.f_sf("t", "2", "9")
    ).first()
    assert list(row) == [None] * 4


def test_critical_values(spark):
    table = [(1.0, 12.706204736), (2.0, 4.302652730), (3.0, 3.182446305), (10.0, 2.228138852), (41.0, 2.019540970), (1000.0, 1.962339081)]
    rows = spark.createDataFrame(table, "df double, c double")
    for r in rows.withColumn("got", tails.student_t_critical("df")).collect():
        assert r["got"] == pytest.approx(r["c"], rel=1e-8)


def test_chi_square(spark):
    table = [(3.841458821, 1, 0.05), (5.991464547, 2, 0.05), (7.814727903, 3, 0.05), (11.070497694, 5, 0.05), (18.307038053, 10, 0.05), (6.634896601, 1, 0.01)]
    rows = spark.createDataFrame(table, "x double, k int, p double")
    for r in rows.withColumn("got", tails.chi_square_sf("x", "k")).collect():
        assert r["got"] == pytest.approx(r["p"], rel=1e-7)


def test_f_tail(spark):
    table = [
        (4.964602744, 1, 10.0, 0.05), (4.102821016, 2, 10.0, 0.05), (3.708264819, 3, 10.0, 0.05), (3.478049691, 4, 10.0, 0.05),
        (3.325834530, 5, 10.0, 0.05), (2.978237016, 10, 10.0, 0.05), (3.0717794, 2, 120.0, 0.05),
    ]
    rows = spark.createDataFrame(table, "f double, a int, b double, p double")
    for r in rows.withColumn("got", tails.f_sf("f", "a", "b")).collect():
        assert r["got"] == pytest.approx(r["p"], rel=2e-6)

