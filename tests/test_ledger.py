"""Tracks are asked once: over trips, over runs, and after a run that was killed."""

import os
import time
import uuid

import pytest

from ampflow.operators import mapmatch

TRACK = "device_id string, trip_id string, points array<struct<lat:double,lon:double>>"


def tracks(spark, n=40):
    rows = [("d", f"d_{i}", [(50.0 + i % 30, 8.0), (50.0 + i % 30, 8.1)]) for i in range(n)]
    return spark.createDataFrame([*rows, ("d", "short", [(1.0, 1.0)]), ("d", "none", [])], TRACK).repartition(3)


def service(folder, fails=lambda lat: False, status="ok"):
    """A matcher that leaves a file for each request."""

    def ask(points):
        lat = int(points[0][0])
        if fails(lat):
            if status == "ok":
                raise RuntimeError("killed")
            return None, 0.0, status
        open(os.path.join(folder, f"{lat}-{uuid.uuid4()}"), "w").close()
        return float(lat), 0.5, "ok"

    return ask


def asked(folder):
    return sorted(int(f.split("-")[0]) for f in os.listdir(folder))


def key(row):
    return tuple(str(x) for x in row)


def test_equal_tracks_are_asked_once_and_never_again(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    ledger = mapmatch.Ledger(str(tmp_path / "ledger"), parts=3, askers=2)
    ask = service(str(calls))
    want = sorted(mapmatch.match(tracks(spark), lambda p: (float(int(p[0][0])), 0.5, "ok")).collect(), key=key)
    got = mapmatch.match_once(tracks(spark), ask, ledger)
    assert sorted(got.collect(), key=key) == want
    assert asked(calls) == list(range(50, 80))
    assert mapmatch.match_once(tracks(spark, 45), ask, ledger).count() == 47
    assert asked(calls) == list(range(50, 80))


def test_a_killed_run_goes_on_where_it_stopped(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    ledger = mapmatch.Ledger(str(tmp_path / "ledger"), parts=10, askers=1)
    with pytest.raises(Exception, match="killed"):
        mapmatch.match_once(tracks(spark), service(str(calls), lambda lat: lat == 63), ledger)
    settled = {r.match_status for r in ledger.answers(spark).collect()}
    kept = ledger.answers(spark).count()
    assert settled <= {"ok"}
    before = asked(calls)
    assert 0 < kept <= len(set(before)) < 30
    got = mapmatch.match_once(tracks(spark), service(str(calls)), ledger)
    assert got.where("match_status = 'ok'").count() == 40
    assert len(asked(calls)) - len(before) == 30 - kept


def test_failures_of_the_service_show_and_are_asked_again(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    ledger = mapmatch.Ledger(str(tmp_path / "ledger"), parts=2)
    first = mapmatch.match_once(tracks(spark), service(str(calls), lambda lat: lat > 75, "http_503:x"), ledger)
    assert first.where("match_status = 'http_503:x'").count() == 4
    again = mapmatch.match_once(tracks(spark), service(str(calls)), ledger)
    assert again.where("match_status = 'ok'").count() == 40 and asked(calls) == list(range(50, 80))


def test_requests_keep_the_pace_of_all_tasks(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    begun = time.monotonic()
    ledger = mapmatch.Ledger(str(tmp_path / "ledger"), parts=1, askers=2, per_second=20.0)
    mapmatch.match_once(tracks(spark), service(str(calls)), ledger)
    assert len(asked(calls)) == 30 and time.monotonic() - begun > 1.0
