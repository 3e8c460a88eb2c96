"""Streaks and insights that are followed reader by reader."""

import random
from datetime import UTC, datetime

from manyview.sources.keyed import KeyedTable
from manyview.streaming import stateful

HOUR = 3_600_000_000


def at(micros):
    return datetime.fromtimestamp(micros / 1e6, UTC).replace(tzinfo=None)


def test_days_in_any_order(spark, tmp_path):
    """Days that come between two streaks join them; another run of the stream goes on with its state."""
    rng = random.Random(9)
    days = {7: [10, 12, 14, 16, 11, 15, 13], 8: [31, 33, 32, 63, 64, 65, 66, 96], 9: [5]} | {u: rng.sample(range(20_000, 20_030), 18) for u in range(20, 26)}
    rows = [(u, d) for u, ds in days.items() for d in ds]
    table = KeyedTable(spark, f"{tmp_path}/t", stateful.STREAK, ["userId"], buckets=2)
    for i, part in enumerate([rows[::2], [*rows[1::2], *rows[:5], (None, 3), (9, None)]]):
        made = [(u, None if d is None else at(d * stateful.DAY + rng.randrange(stateful.DAY))) for u, d in part]
        spark.createDataFrame(made, "user_id long, ts timestamp").write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema("user_id LONG, ts TIMESTAMP").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        stateful.follow_streaks(stream, table, f"{tmp_path}/c").awaitTermination()

    def runs(ds):
        out = []
        for d in sorted(set(ds)):
            out.append(out.pop() + [d]) if out and out[-1][-1] == d - 1 else out.append([d])
        return out

    want = {u: (len(set(ds)), max(ds), len(runs(ds)[-1]), max(map(len, runs(ds)))) for u, ds in days.items()}
    assert {r["userId"]: (r["days"], r["last"], r["run"], r["longest"]) for r in table.read().collect()} == want
    assert {r["userId"]: (r["currentStreak"], r["longestStreak"]) for r in stateful.current(table.read(), 17 * 86_400_000.0).collect()}[7] == (7, 7)


def outcomes(rows, valid, pause):
    out, state = [], {}
    for u, t, made in sorted(rows, key=lambda r: (r[0], r[1], not r[2])):
        expires, told = state.get(u, (None, None))
        if expires is not None and expires <= t:
            out.append((u, "expired", expires))
            expires = None
        if made:
            expires, told = t + valid, None
        elif expires is not None and (told is None or t - told >= pause):
            told = t
            out.append((u, "notified", t))
        state[u] = (expires, told)
    return sorted(out + [(u, "expired", e) for u, (e, _) in state.items() if e is not None])


def test_each_outcome_once(spark, tmp_path):
    """In whatever order parts of the log come, if not too late; what is too late is left out."""
    rng = random.Random(5)
    rows = [(u, rng.randrange(200) * HOUR // 2, rng.random() < 0.25) for u in range(5) for _ in range(40)]
    rows = list({(u, t): (u, t, m) for u, t, m in rows}.values())
    early, late = [r for r in rows if r[1] < 50 * HOUR], [r for r in rows if r[1] >= 50 * HOUR]
    rng.shuffle(early)
    rng.shuffle(late)
    parts = [early, late, [(99, 10_000 * HOUR, False)], [(0, 60 * HOUR, True)]]
    for i, part in enumerate(parts):
        spark.createDataFrame([(u, at(t), m) for u, t, m in part], "user_id long, ts timestamp, made boolean").write.parquet(f"{tmp_path}/in/{i}")
        stream = spark.readStream.schema("user_id LONG, ts TIMESTAMP, made BOOLEAN").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        stateful.follow_insights(stream, f"{tmp_path}/out", f"{tmp_path}/c", 12 * HOUR, 5 * HOUR, "2 hours").awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == outcomes(rows, 12 * HOUR, 5 * HOUR)


def forget(checkpoint):
    """As if the stream was cut off after its last batch, before it noted that."""
    last = max((p for p in (checkpoint / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    last.with_name(f".{last.name}.crc").unlink(missing_ok=True)


def test_insights_ask_no_state_by_rows(spark, tmp_path):
    """Outcomes follow from tables kept from batch to batch; a batch that is done again gives none again."""
    rows = [(u, t * HOUR, m) for u, t, m in [(1, 0, True), (1, 1, False), (2, 3, True), (1, 30, False), (2, 200, False), (9, 400, False)]]
    spark.createDataFrame([(u, at(t), m) for u, t, m in rows], "user_id long, ts timestamp, made boolean").write.parquet(f"{tmp_path}/in/0")
    for _ in range(2):
        stream = spark.readStream.schema("user_id LONG, ts TIMESTAMP, made BOOLEAN").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        query = stateful.follow_insights(stream, f"{tmp_path}/out", f"{tmp_path}/c", 12 * HOUR, 5 * HOUR, "2 hours")
        query.awaitTermination()
        assert not any(p["stateOperators"] for p in query.recentProgress)
        assert sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == outcomes(rows, 12 * HOUR, 5 * HOUR)
        forget(tmp_path / "c")


def test_streaks_ask_no_state_by_rows(spark, tmp_path):
    table = KeyedTable(spark, f"{tmp_path}/t", stateful.STREAK, ["userId"], buckets=2)
    for i, days in enumerate([[1, 2, 4], [3, 9], []]):
        if days:
            spark.createDataFrame([(5, at(d * stateful.DAY)) for d in days], "user_id long, ts timestamp").write.parquet(f"{tmp_path}/in/{i}")
        else:
            forget(tmp_path / "c")
        stream = spark.readStream.schema("user_id LONG, ts TIMESTAMP").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        query = stateful.follow_streaks(stream, table, f"{tmp_path}/c")
        query.awaitTermination()
        assert not any(p["stateOperators"] for p in query.recentProgress)
    assert [tuple(r) for r in table.read().collect()] == [(5, 5, 9, 1, 4)]
