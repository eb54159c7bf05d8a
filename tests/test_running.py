"""Totals and windows kept over batches, against the same over all rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidewire.streaming.running import ClosingWindows, Totals


def at(hour, minute=0):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hour, minutes=minute)


def test_totals(spark, tmp_path):
    batches = [[("a", 1, 2.0), ("b", 1, None)], [("a", 1, 3.0), (None, 2, 1.0)], []]
    totals = Totals(spark, f"{tmp_path}/t", ["k"], ["x", "y"])
    assert totals.state() is None
    frames = [spark.createDataFrame(b, "k string, x int, y double") for b in batches]
    assert [totals.add(f, n) for n, f in enumerate(frames)] == [True] * 3
    assert not totals.add(frames[0], 2) and not totals.add(frames[1], 0)
    assert {tuple(r) for r in totals.state().collect()} == {("a", 2, 2, 5.0), ("b", 1, 1, 0.0), (None, 1, 2, 1.0)}


@pytest.fixture
def windows(spark, tmp_path):
    return ClosingWindows(spark, f"{tmp_path}/w", "ts", ["k"], window="1 hour", late="10 minutes")


def put(spark, windows, number, rows):
    return windows.add(spark.createDataFrame(rows, "ts timestamp, k string"), number)


def test_windows_close(spark, windows):
    assert windows.counts() is None and windows.late() is None
    put(spark, windows, 0, [(at(0, 5), "a"), (at(0, 50), "a"), (at(1, 5), "b")])
    assert windows.closed().count() == 0  # the watermark is at 0:55
    put(spark, windows, 1, [(at(0, 59), "a"), (at(2, 30), "a")])
    assert {(r.window_start, r.k, r.n) for r in windows.closed().collect()} == {(at(0), "a", 3), (at(1), "b", 1)}
    assert windows.state().count() == 1
    put(spark, windows, 2, [(at(1, 59), "b"), (at(2, 1), "a"), (None, "c")])
    assert {(r.ts, r.k, r.batch) for r in windows.late().collect()} == {(at(1, 59), "b", 2), (None, "c", 2)}
    assert {(r.window_start, r.k, r.n) for r in windows.counts().collect()} == {(at(0), "a", 3), (at(1), "b", 1), (at(2), "a", 2)}


def test_a_batch_counts_once(spark, windows):
    first, second = [(at(0, 5), "a"), (at(3), "a")], [(at(0, 6), "a"), (at(3, 1), "a")]
    put(spark, windows, 0, first)
    assert not put(spark, windows, 0, first)
    put(spark, windows, 1, second)
    assert not put(spark, windows, 1, second) and not put(spark, windows, 0, second)
    assert windows.late().count() == 1
    assert sorted((r.window_start, r.n) for r in windows.counts().collect()) == [(at(0), 1), (at(3), 2)]


def test_state_stays_small(spark, windows):
    for n in range(6):
        put(spark, windows, n, [(at(2 * n + h, m), "a") for h in (0, 1) for m in (1, 2)])
        assert windows.state().count() <= 2
    assert windows.closed().agg(F.sum("n")).first()[0] + windows.state().agg(F.sum("n")).first()[0] == 24
