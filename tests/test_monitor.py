import random
from datetime import datetime, timedelta

import pytest

from millrace.streaming import ingest, monitor

SCHEMA = "kind string, event_id long, ts timestamp, ms double, failed boolean"


@pytest.fixture
def stored_state(spark):
    spark.conf.set(*monitor.STORE)
    yield
    spark.conf.unset(monitor.STORE[0])


def run(spark, folder, batches, **how):
    """All rows that the monitor gives for these batches of events, one after another."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/b{i}")
        events = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(f"{folder}/in")
        out = monitor.monitored(events, **how).writeStream.option("checkpointLocation", f"{folder}/known").trigger(availableNow=True).outputMode("update")
        out.foreachBatch(lambda df, batch: ingest.write_batch(df, batch, f"{folder}/out")).start().awaitTermination()
    return ingest.taken(spark, f"{folder}/out").collect()


def test_late_and_repeated_events(spark, stored_state, tmp_path):
    rng, start = random.Random(1), datetime(2024, 1, 1)
    events = [(rng.choice("ab"), i, start + timedelta(seconds=rng.randrange(5000)), float(rng.randrange(1, 9000)), rng.random() < 0.2) for i in range(300)]
    batches = [events[:120] + events[:20], events[100:220], events[220:] + [("a", 9000, start, None, False)]]  # out of order, some twice, one without a time of work
    rows = run(spark, str(tmp_path), batches, late="2 hours", slow=4000, most_errors=0.15)
    for kind in "ab":
        own = sorted((e for e in events if e[0] == kind), key=lambda e: (e[2], e[1]))
        last = max((r for r in rows if r.kind == kind and r.what == "state"), key=lambda r: r.n)
        mean = lambda k: int(sum(e[3] for e in own[-k:]) / k)
        errors = sum(e[4] for e in own)
        assert (last.n, last.errors, last.error_rate, last.mean_long, last.mean_short, last.at) == (len(own), errors, round(errors / len(own), 3), mean(50), mean(10), own[-1][2])
        alerts = {r.what for r in rows if r.kind == kind and r.n == last.n} - {"silent"}
        assert alerts == {"state"} | ({"slow"} if mean(10) > 4000 else set()) | ({"errors"} if errors / len(own) > 0.15 else set())


def test_silent_kinds_end(spark, stored_state, tmp_path):
    start = datetime(2024, 1, 1)
    batches = [[("quiet", 1, start, 5.0, True), ("busy", 2, start, 5.0, False)], [("busy", 3, start + timedelta(hours=30), 7.0, False)], [("quiet", 4, start + timedelta(hours=30, minutes=1), 9.0, False)]]
    rows = run(spark, str(tmp_path), batches, late="1 minute", silence=3_600_000)
    assert [(r.n, r.errors, r.mean_long) for r in rows if r.kind == "quiet" and r.what == "silent"] == [(1, 1, None)]
    assert [(r.n, r.errors, r.mean_short) for r in rows if r.kind == "quiet" and r.what == "state"][-1] == (1, 0, 9)  # begun anew
