import random
from datetime import datetime, timedelta

import pytest

from meshquill.sources import tables


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Three files of events, out of order, with nulls in users, types and times."""
    rng, start = random.Random(3), datetime(2024, 1, 1)
    rows = [(k, start + timedelta(minutes=rng.randrange(4 * 24 * 60)), rng.randrange(40), rng.choice(["view", "click", None])) for k in range(600)]
    rows += [(600, None, 3, "view"), (601, None, 4, "view"), (602, None, None, "view"), (603, start, None, "click"), (604, start, 5, "click")]
    rng.shuffle(rows)
    folder = tmp_path_factory.mktemp("events")
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string").repartition(3).write.parquet(f"{folder}/events.parquet")
    return folder, rows


def test_steps_are_all_hand_offs(spark, events):
    folder, rows = events
    days, expected = {}, []
    for id_, ts, user, kind in sorted(rows, key=lambda r: (r[1] is not None, r[1] or datetime.min, r[0])):
        days.setdefault(ts and ts.date(), []).append((user, kind, ts, id_))
    for day in days.values():
        expected += [(a[0], b[0], *a[1:]) for a, b in zip(day, day[1:]) if None not in (a[0], b[0]) and a[0] != b[0]]
    found = [(r["src"], r["dst"], r["event_type"], *r["at"]) for r in tables.steps(spark, folder).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_steps_are_dealt_narrow(spark, events):
    """One exchange, without a column of the day, of rows in the order of time."""
    plan = tables.steps(spark, events[0])._jdf.queryExecution().executedPlan().toString().split("\n")
    (at,) = [k for k, line in enumerate(plan) if "Exchange" in line]
    assert "as date)" in plan[at] and "Sort [ts" in plan[at + 1] and not any("as date)" in line for line in plan[at + 1 :])

