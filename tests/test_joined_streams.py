"""Streams joined with each other."""

from datetime import datetime, timedelta

from manyview.streaming import activity

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string"
START = datetime(2024, 1, 1)


def test_outer_rows_come_late(spark, tmp_path):
    """A view that a click follows in time comes with it; one that none follows comes once, when none can any more."""
    at = lambda minutes: START + timedelta(minutes=minutes)
    runs = [
        [(1, at(0), 7, "view"), (2, at(5), 7, "view"), (3, at(30), 7, "click"), (4, at(0), 8, "view")],
        [(5, at(61), 7, "click"), (6, at(200), 9, "view"), (7, at(200), 9, "click")],
        [(8, at(9000), 1, "view"), (9, at(9000), 2, "click")],
    ]
    seen = []
    for i, rows in enumerate(runs):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/in/{i}")
        stream = lambda kind: spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in").where(f"event_type = '{kind}'")
        out = activity.followed_by(stream("view"), stream("click"), "60 minutes", "10 minutes")
        activity.to_files(out, f"{tmp_path}/out", f"{tmp_path}/c", "append").awaitTermination()
        seen.append(sorted(((r["event_id"], r["next_id"]) for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()), key=str))
    assert seen[0] == [(1, 3), (2, 3)]
    assert seen[-1] == sorted([(1, 3), (2, 3), (2, 5), (4, None), (6, 7)], key=str)
