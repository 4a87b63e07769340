"""Streams give the batch results, drop late rows, and resume from their checkpoint."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from aeroweave.operators import assemble_conflict
from aeroweave.plans import advise
from aeroweave.schemas import MESSAGE
from aeroweave.session import scratch_path
from aeroweave.sources import (
    decode_advisories,
    decode_conflict_group,
    part_key,
    read_messages,
    read_stream,
    split_conflict_groups,
    write_messages,
)
from aeroweave.streaming import advise_stream, close_ingest, ingest_stream, late_reports, open_windows, start_advise, start_ingest

NOON = dt.datetime(2024, 1, 1, 12, 0, 0)


def status(flight, seconds, lat=0.0):
    value = f'{{"flightId":"{flight}","lat":"{lat}","lon":"0","speed":"10","heading":"0"}}'
    return (None, value, NOON + dt.timedelta(seconds=seconds))


def publish(spark, root, topic, rows):
    write_messages(spark.createDataFrame(rows, MESSAGE).coalesce(1), topic, "json", {"path": root})


late: list[int] = []


def run_ingest(spark, root, **options):
    query = start_ingest(
        read_stream(spark, "status", "json", {"path": root}), f"{root}/checkpoint", format="json",
        options={"path": root}, trigger={"availableNow": True}, **options,
    )
    query.awaitTermination()
    late.append(late_reports(query))
    messages = read_messages(spark, "conflict", "json", {"path": root})
    decoded = decode_conflict_group(split_conflict_groups(messages.select("key", "value"), key="key"))
    millis = int(NOON.timestamp() * 1000)
    return {((int(r.conflict_id) - millis) // 1000, r.flight_id): r.lat for r in decoded.collect()}


def test_windows_latest_reports_late_rows_and_resume(spark, monkeypatch):
    monkeypatch.setenv("TZ", "UTC")
    root = scratch_path(spark, "ingest-test")
    publish(spark, root, "status", [
        status("a", 0.1, 1.0), status("a", 0.9, 2.0), status("a", 0.5, 3.0), status("b", 0.2),
        status("a", 1.2), ("k", "{broken", NOON), status("z", 20),
    ])
    got = run_ingest(spark, root)
    shift = min(k[0] for k in got)
    assert {(k[0] - shift, k[1]): v for k, v in got.items()} == {(0, "a"): 2.0, (0, "b"): 0.0, (1, "a"): 0.0}
    # the end of the stream: what the watermark has not passed is read from the state
    assert {(r.flight_id, r.lat) for r in open_windows(spark, f"{root}/checkpoint").collect()} == {("z", 0.0)}
    # the restarted query continues: second 20 closes, the report for second 0 comes too late
    publish(spark, root, "status", [status("late", 0.3), status("c", 20.5), status("z", 40)])
    again = run_ingest(spark, root)
    new = {(k[0] - shift, k[1]) for k in again} - {(k[0] - shift, k[1]) for k in got}
    assert new == {(20, "z"), (20, "c")}
    assert late == [0, 1]
    for _ in range(2):  # closing is repeatable
        close_ingest(spark, f"{root}/checkpoint", format="json", options={"path": root})
    messages = read_messages(spark, "conflict", "json", {"path": root})
    assert messages.count() == 4 and messages.where("value like 'z%'").count() == 1


def test_ingest_state_is_keyed_by_aircraft(spark):
    batch = spark.createDataFrame([status("a", 0), status("b", 0)], MESSAGE)
    plan = ingest_stream(batch)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(window" in plan and "flight_id" in plan.split("hashpartitioning(window")[1][:40]


def test_advise_stream_equals_batch(spark, make_flights, policy):
    root = scratch_path(spark, "advise-test")
    rows = [(f"g{g}", 300 * i, -200 * i, i, 10 + i) for g in range(5) for i in range(g + 1)]
    flights = make_flights(rows)
    strings = assemble_conflict(flights).select(F.col("conflict_id").alias("key"), "value")
    write_messages(strings, "conflict", "json", {"path": root})
    for _ in range(2):  # the second run finds nothing new
        start_advise(
            read_stream(spark, "conflict", "json", {"path": root}), policy, f"{root}/checkpoint", format="json",
            options={"path": root}, trigger={"availableNow": True},
        ).awaitTermination()
    names = ["flight_id", "clear_of_conflict", "turn_rate", "period_s"]
    got = decode_advisories(read_messages(spark, "advisory", "json", {"path": root})).select(*names)
    want = decode_advisories(advise(flights, policy)).select(*names)
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 2 + 3 + 4 + 5


def keyed(parts):
    return parts.select(part_key(*(F.col(c) for c in ("conflict_id", "part", "n_parts", "first"))).alias("key"), "value")


def actions(messages):
    rows = decode_advisories(messages).select("flight_id", "clear_of_conflict", "turn_rate").collect()
    return sorted((r.flight_id, r.clear_of_conflict, round(r.turn_rate, 9)) for r in rows)


def test_parts_and_repeats_do_not_change_the_answer(make_flights, policy):
    flights = make_flights([("g", 37 * (i * 7 % 40), -23 * (i * 3 % 40), i, 10 + i % 9) for i in range(40)])
    want = actions(advise(flights, policy))
    parts = keyed(assemble_conflict(flights, 7))
    assert parts.count() == 6 and actions(advise_stream(parts, policy)) == want
    assert actions(advise_stream(parts.unionByName(parts), policy)) == want
    assert [r.key for r in advise_stream(parts, policy).collect()] == ["g"]


def test_messages_with_one_key_stay_apart(make_flights, policy):
    groups = make_flights([("g", 100 * i, 50 * i, i, 12) for i in range(4)] + [("h", 90 * i, -70 * i, i, 11) for i in range(3)])
    named = keyed(assemble_conflict(groups)).withColumn("key", F.lit("k"))
    got = advise_stream(named, policy)
    assert [r.key for r in got.collect()] == ["k", "k"] and actions(got) == actions(advise(groups, policy))


def test_parts_over_two_batches_wait_for_each_other(spark, make_flights, policy):
    root = scratch_path(spark, "torn")
    flights = make_flights([("g", 41 * (i * 7 % 20), -29 * (i * 3 % 20), i, 10 + i % 9) for i in range(20)])
    parts = keyed(assemble_conflict(flights, 6)).orderBy("key").collect()
    for some in (parts[:3], parts[3:], parts[:1]):
        write_messages(spark.createDataFrame(some, "key string, value string"), "conflict", "json", {"path": root})
        start_advise(
            read_stream(spark, "conflict", "json", {"path": root}), policy, f"{root}/checkpoint", format="json",
            options={"path": root}, trigger={"availableNow": True},
        ).awaitTermination()
    assert actions(read_messages(spark, "advisory", "json", {"path": root})) == actions(advise(flights, policy))


def advise_some(spark, root, rows, policy, **options):
    write_messages(spark.createDataFrame(rows, "key string, value string"), "conflict", "json", {"path": root})
    start_advise(
        read_stream(spark, "conflict", "json", {"path": root}), policy, f"{root}/checkpoint", format="json",
        options={"path": root}, trigger={"availableNow": True}, rejects="rejects", **options,
    ).awaitTermination()
    return sorted(r.key for r in read_messages(spark, "advisory", "json", {"path": root}).collect())


def test_a_message_delivered_again_in_a_later_batch_is_dropped(spark, make_flights, policy):
    root = scratch_path(spark, "again")
    groups = make_flights([("g", 100 * i, 50 * i, i, 12) for i in range(4)] + [("h", 90 * i, -70 * i, i, 11) for i in range(9)])
    whole = keyed(assemble_conflict(groups.where("conflict_id = 'g'"))).collect()
    parts = keyed(assemble_conflict(groups.where("conflict_id = 'h'"), 4)).orderBy("key").collect()
    assert len(parts) == 3
    assert advise_some(spark, root, whole + parts[:2], policy) == ["g"]
    assert advise_some(spark, root, whole + parts[2:], policy) == ["g", "h"]
    assert advise_some(spark, root, whole + parts[1:2], policy) == ["g", "h"]
    assert advise_some(spark, root, [("g", whole[0].value.replace("g-3", "g-9"))], policy) == ["g", "g", "h"]  # another message of that key


def test_parts_that_never_complete_are_given_up(spark, make_flights, policy):
    root = scratch_path(spark, "orphan")
    parts = keyed(assemble_conflict(make_flights([("h", 90 * i, -70 * i, i, 11) for i in range(9)]), 4)).orderBy("key").collect()
    whole = keyed(assemble_conflict(make_flights([("g", 100 * i, 50 * i, i, 12) for i in range(4)]))).collect()
    assert advise_some(spark, root, parts[:2], policy, patience=0.001) == []
    assert advise_some(spark, root, whole, policy, patience=0.001) == ["g"]
    lost = read_messages(spark, "rejects", "json", {"path": root}).select("key", "value").collect()
    assert sorted(lost) == sorted(parts[:2])
    assert advise_some(spark, root, parts[2:], policy, patience=0.001) == ["g"]  # too late


def test_a_repeated_batch_is_published_once(spark):
    root = scratch_path(spark, "replay")
    rows = spark.createDataFrame([("k", "v")], "key string, value string")
    for batch in (0, 1, 1):
        write_messages(rows, "out", "json", {"path": root}, batch_id=batch)
    assert read_messages(spark, "out", "json", {"path": root}).count() == 2


def test_stream_sink_needs_a_checkpoint(spark):
    root = scratch_path(spark, "sink")
    publish(spark, root, "in", [("k", "v", NOON)])
    stream = read_stream(spark, "in", "json", {"path": root})
    with pytest.raises(ValueError):
        write_messages(stream, "out", "json", {"path": root})
    writer = write_messages(stream, "out", "json", {"path": root}, f"{root}/c", {"availableNow": True})
    writer.start().awaitTermination()
    assert read_messages(spark, "out", "json", {"path": root}).count() == 1
