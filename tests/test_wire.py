"""Wire formats: decoding, encoding, rejects, splitting of large groups, sources and sinks."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeroweave import queries
from aeroweave.fixtures import synthetic_utility
from aeroweave.operators import assemble_conflict, encode_advisories, encode_status
from aeroweave.plans import advise, advisory_rows, default_policy
from conftest import SF_DIR
from aeroweave.session import checkpoint_root, scratch_path
from aeroweave.sources import (
    advisory_rejects,
    conflict_rejects,
    decode_advisories,
    decode_advisory,
    decode_conflict_group,
    decode_operations_xml,
    decode_positions_xml,
    decode_status,
    load_utility,
    operation_message_rejects,
    operation_rejects,
    position_rejects,
    read_messages,
    read_operation_message_rejects,
    read_operation_messages_xml,
    read_operation_rejects,
    read_operations_xml,
    read_position_rejects,
    read_positions_xml,
    split_conflict_groups,
    status_rejects,
    to_planar,
    write_messages,
)
from aeroweave.sources.utility import UtilityShapeError


def values(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_status_strings_numbers_and_rejects(spark):
    good = '{"flightId":"a","lat":"1.5","lon":"2","speed":"10","heading":"0.1"}'
    numeric = '{"flightId":"b","lat":-63.060318,"lon":56.4,"alt":234.0,"speed":45,"heading":100}'
    bad = ["{", '{"flightId":"c","lat":"x","lon":"2","speed":"1","heading":"0"}',
           '{"flightId":"d","lat":"NaN","lon":"2","speed":"1","heading":"0"}',
           '{"lat":"1","lon":"2","speed":"1","heading":"0"}', "", None]
    df = values(spark, good, numeric, *bad)
    got = {r.flight_id: (r.lat, r.lon, r.speed, r.heading) for r in decode_status(df).collect()}
    assert got == {"a": (1.5, 2.0, 10.0, 0.1), "b": (-63.060318, 56.4, 45.0, 100.0)}
    assert status_rejects(df).count() == len(bad)


def test_status_encoding_keeps_three_decimals(spark):
    df = spark.createDataFrame([("a", 0.5, 2.0, -1234.56789, 1e7)],
                               "flight_id string, lat double, lon double, speed double, heading double")
    got = json.loads(encode_status(df).first().value)
    assert got == {"flightId": "a", "lat": "0.5", "lon": "2", "speed": "-1234.568", "heading": "10000000"}


def test_conflict_message_is_split_and_decoded(spark):
    message = "a%1%2%3%4,b%5%6%7%8, solo%1%1%1%1, c%1%2%3,d%1%2%x%4,e%120.03%32.01%123.0%10.3,,"
    df = spark.createDataFrame([("k", message)], "key string, value string")
    groups = split_conflict_groups(df, key="key")
    assert {r.conflict_id for r in groups.collect()} == {"k-0", "k-1", "k-2"}
    got = {(r.conflict_id, r.ord): (r.flight_id, r.lat, r.lon, r.heading, r.speed)
           for r in decode_conflict_group(groups).collect()}
    assert got == {
        ("k-0", 0): ("a", 1.0, 2.0, 3.0, 4.0),
        ("k-0", 1): ("b", 5.0, 6.0, 7.0, 8.0),
        ("k-1", 0): ("solo", 1.0, 1.0, 1.0, 1.0),
        ("k-2", 2): ("e", 120.03, 32.01, 123.0, 10.3),
    }
    assert {r.record for r in conflict_rejects(groups).collect()} == {"c%1%2%3", "d%1%2%x%4"}


def test_unkeyed_messages_do_not_mix(spark):
    df = values(spark, "a%1%1%1%1,b%1%1%1%1,", "a%1%1%1%1,b%1%1%1%1,")
    assert split_conflict_groups(df).select("conflict_id").distinct().count() == 2


def test_messages_that_share_a_key_stay_apart(spark):
    rows = [("k", "a%1%1%1%1,b%2%2%2%2,"), ("k", "c%1%1%1%1,d%2%2%2%2,"), ("k", "a%1%1%1%1,b%2%2%2%2,"), ("j", "e%1%1%1%1,"),
            (None, "f%1%1%1%1,"), (None, "f%1%1%1%1,"), ("k", None)]
    df = spark.createDataFrame(rows, "key string, value string")
    got = [(r.conflict_id, r.flight_id) for r in decode_conflict_group(split_conflict_groups(df, key="key")).collect()]
    named = sorted((i.partition("~")[0], f) for i, f in got if f != "f")
    assert named == [("j", "e"), ("k", "a"), ("k", "b"), ("k", "c"), ("k", "d")]
    group = {f: i for i, f in got}
    assert group["a"] == group["b"] != group["c"] == group["d"] and group["e"] == "j"
    assert len({i for i, f in got if f == "f"}) == 2
    stream = spark.readStream.format("rate").load().selectExpr("'k' as key", "'a' as value")
    with pytest.raises(ValueError):
        split_conflict_groups(stream, key="key")
    assert split_conflict_groups(stream, key="key", unique=True).isStreaming


def test_group_string_round_trip_and_parts(make_flights):
    flights = make_flights([("g", i, -i, 0.25 * i, 10 + i / 3) for i in range(40)])
    for limit, parts in ((1000, 1), (7, 6)):
        strings = assemble_conflict(flights, limit)
        assert strings.count() == parts
        assert {r.n_parts for r in strings.collect()} == {parts}
        back = decode_conflict_group(
            split_conflict_groups(strings.select(F.col("conflict_id").alias("key"), "value"), key="key", unique=True)
        )
        names = ["conflict_id", "flight_id", "lat", "lon", "heading", "speed"]
        assert sorted(back.select(*names).collect()) == sorted(flights.select(*names).collect())
    single = assemble_conflict(flights).first().value
    assert single.endswith(",") and single.startswith("g-0%0.0%0.0%0.0%10.0,g-1%1.0%-1.0%0.25%")


SAMPLE = (
    '{"advisories":['
    '{"gufi":"uas-7","clearOfConflict":"false","waypoints":[{"lat":"-12.5","lon":"40.25","speed":"17.5",'
    '"heading":"1.25","period":"4.0","turn":"-0.31"}]},'
    '{"gufi":"uas-9","clearOfConflict":"true","waypoints":[{"lat":"88.0","lon":"-3.0","speed":"21.0",'
    '"heading":"0.5","period":"6.5","turn":"0.0"}]}]}'
)


def test_advisory_sample(spark):
    got = {r.flight_id: r for r in decode_advisories(values(spark, SAMPLE)).collect()}
    assert (got["uas-7"].turn_rate, got["uas-9"].turn_rate) == (-0.31, 0.0)
    assert got["uas-9"].period_s == 6.5 and got["uas-9"].clear_of_conflict and not got["uas-7"].clear_of_conflict
    assert (got["uas-7"].lat, got["uas-7"].heading) == (-12.5, 1.25)


def test_advisory_flag_is_strict(spark):
    one = '{"gufi":"a","clearOfConflict":"%s","waypoints":[{"period":"5","turn":"0"}]}'
    bare = values(spark, one % "true", one % "TRUE", one % "", "{", '{"gufi":"b","clearOfConflict":"true","waypoints":[]}')
    assert [r.clear_of_conflict for r in decode_advisory(bare).collect()] == [True]
    lists = values(spark, '{"advisories":[%s,%s]}' % (one % "true", one % "maybe"), "junk")
    assert decode_advisories(lists).count() == 1
    assert advisory_rejects(lists).count() == 2


def test_advise_round_trip_in_parts(make_flights, policy):
    rows = [("g", 150 * i, -90 * i, i, 10 + i % 9) for i in range(12)] + [("h", 0, 0, 0, 0), ("h", 50, 0, 3, 0)]
    flights = make_flights(rows)
    want = {
        (r.conflict_id, r.flight_id): (r.clear_of_conflict, r.turn_rate)
        for r in advisory_rows(flights, policy.resolve(flights)).collect()
    }
    for limit in (100, 5):
        messages = advise(flights, policy, limit)
        assert messages.where("conflict_id = 'g'").count() == (1 if limit == 100 else 3)
        got = {(r.conflict_id, r.flight_id): (r.clear_of_conflict, r.turn_rate)
               for r in decode_advisories(messages).collect()}
        assert got == want
    whole = json.loads(advise(flights, policy).where("conflict_id = 'g'").first().value)
    assert [a["gufi"] for a in whole["advisories"]] == [f"g-{i}" for i in range(12)]
    assert {a["waypoints"][0]["period"] for a in whole["advisories"]} == {"5"}


def test_zero_speed_has_no_turn_rate(spark):
    rows = spark.createDataFrame(
        [("g", "a", 0, False, 0.0, 0.0, 0.0, 0.0, 5, None)],
        "conflict_id string, flight_id string, ord bigint, clear_of_conflict boolean, lat double, lon double,"
        " speed double, heading double, period_s int, turn_rate double",
    )
    message = encode_advisories(rows)
    assert "turn" not in json.loads(message.first().value)["advisories"][0]["waypoints"][0]
    back = decode_advisories(message).first()
    assert back.turn_rate is None and back.clear_of_conflict is False and back.period_s == 5


def write_utility(spark, table, files=3):
    path = scratch_path(spark, "utility-test")
    rows = spark.createDataFrame([(i, ",".join(map(repr, map(float, r)))) for i, r in enumerate(table)], "i int, v string")
    rows.repartitionByRange(files, "i").sortWithinPartitions("i").select("v").write.text(path)
    return path


def test_utility_line_order_over_files_and_splits(spark):
    table = np.arange(3000 * 2, dtype=float).reshape(3000, 2)
    path = write_utility(spark, table)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        got = load_utility(spark, path, 3000, 2).orderBy("state_idx").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.state_idx for r in got] == list(range(3000))
    assert np.array_equal(np.array([r.u for r in got]), table)


def test_utility_shape_is_enforced(spark):
    path = write_utility(spark, np.zeros((4, 3)))
    assert load_utility(spark, path, 4, 3).count() == 4
    for states, actions in ((5, 3), (4, 36)):
        with pytest.raises(UtilityShapeError):
            load_utility(spark, path, states, actions)
    broken = scratch_path(spark, "broken")
    values(spark, "1,2,x").write.text(broken)
    with pytest.raises(UtilityShapeError):
        load_utility(spark, broken, 1, 3)
    with pytest.raises(UtilityShapeError):
        default_policy(spark, path)


def test_default_policy_equals_the_table(spark, make_flights, policy):
    loaded = default_policy(spark, write_utility(spark, synthetic_utility()))
    assert np.array_equal(loaded.table(spark).value, synthetic_utility())


HEAD = (
    '<wfs:Transaction service="WFS" xmlns:wfs="http://www.opengis.net/wfs" '
    'xmlns:gml="http://www.opengis.net/gml" xmlns:utm="http://opengeo.org/utm"><wfs:Insert>'
)
TAIL = "</wfs:Insert></wfs:Transaction>"
POSITION = (
    "<utm:positions><utm:gufi>fid-1</utm:gufi><utm:heading>90</utm:heading><utm:location>"
    '<gml:Point srsName="x"><gml:coordinates decimal="." cs="," ts=" ">\n -1.5,2.25\n</gml:coordinates></gml:Point>'
    "</utm:location><utm:speed>71</utm:speed><utm:time_received>2015-09-21T16:43:00Z</utm:time_received>"
    "<utm:time_measured>2014-09-21T16:43:00Z</utm:time_measured></utm:positions>"
)


def operation(begin, end):
    return (
        "<utm:operations_proposed><utm:unmanned>true</utm:unmanned><utm:flight_number>N1</utm:flight_number>"
        f"<utm:effective_time_begin>{begin}</utm:effective_time_begin><utm:effective_time_end>{end}</utm:effective_time_end>"
        '<utm:flight_geography><gml:LineString srsName="x"><gml:coordinates>\n 1.5,2.5\n  3.5,4.5 </gml:coordinates>'
        "</gml:LineString></utm:flight_geography><utm:min_altitude>50</utm:min_altitude></utm:operations_proposed>"
    )


def write_xml(spark, *documents):
    """One file per document."""
    root = scratch_path(spark, "xml")
    for i, d in enumerate(documents):
        values(spark, HEAD + d + TAIL).coalesce(1).write.text(f"{root}/{i}")
    return f"{root}/*"


def test_broken_xml_is_rejected(spark):
    broken = ["", "no xml", POSITION[: len(POSITION) // 2], "<utm:positions></utm:positions>"]
    df = values(spark, POSITION, *broken)
    assert decode_positions_xml(df).count() == 1
    assert sorted(r.reject for r in position_rejects(df).collect()) == sorted(broken)
    assert operation_message_rejects(values(spark, *broken)).count() == len(broken)


def test_xml_files(spark):
    got = read_positions_xml(spark, write_xml(spark, POSITION)).first()
    assert (got.gufi, got.heading, got.lon, got.lat, got.speed) == ("fid-1", 90.0, -1.5, 2.25, 71.0)
    assert got.time_received.year == 2015 and got.time_measured.year == 2014
    path = write_xml(spark, operation("2015-09-22T13:30:00Z", "2015-09-23T21:00:00Z") * 2,
                     operation("2015-09-28T22:06:06.208Z", "2015-09-23T21:00:00Z"))
    rows = read_operations_xml(spark, path).collect()
    assert len(rows) == 2 and rows[0].unmanned is True
    assert [tuple(p) for p in rows[0].flight_geography] == [(1.5, 2.5), (3.5, 4.5)]
    message = "<utm:operation_messages><utm:gufi>fid-1</utm:gufi><utm:message_id>30</utm:message_id></utm:operation_messages>"
    assert [tuple(r) for r in read_operation_messages_xml(spark, write_xml(spark, message)).collect()] == [("fid-1", 30)]


def write_text(spark, *files):
    root = scratch_path(spark, "xml")
    for i, text in enumerate(files):
        values(spark, text).coalesce(1).write.option("lineSep", " ").text(f"{root}/{i}")
    return f"{root}/*"


def test_xml_documents_in_one_file_cut_off_or_broken(spark):
    one = lambda i: POSITION.replace("fid-1", f"fid-{i}")
    spaced = one(4).replace("<utm:positions>", '<utm:positions xmlns:utm="u"\n>', 1)
    cut, nested, unnamed = one(5)[:90], one(6)[:-25], one(7).replace("fid-7", "")
    other = "<utm:positions_other><utm:gufi>no</utm:gufi></utm:positions_other>"
    path = write_text(
        spark, HEAD + one(1) + one(2) + "\n" + one(3) + TAIL + HEAD + spaced + TAIL, cut + one(8) + nested, one(9) + unnamed + other, "", "no xml",
        "<utm:positions/>", "\n" + one(10),
    )
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for limit in (old, "256"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
        try:
            got = sorted(r.gufi for r in read_positions_xml(spark, path).collect())
            rejects = sorted(r.reject.strip() for r in read_position_rejects(spark, path).collect())
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert got == sorted(f"fid-{i}" for i in (1, 2, 3, 4, 8, 9, 10))
        assert rejects == sorted([cut, nested, unnamed, "<utm:positions/>"])
    assert read_operation_message_rejects(spark, path).count() == 0
    assert read_operation_rejects(spark, write_text(spark, operation("?", "?"))).count() == 1


def test_xml_messages_and_rejects(spark):
    spaces = ' xmlns:gml="http://www.opengis.net/gml" xmlns:utm="http://opengeo.org/utm">'
    position = POSITION.replace(">", spaces, 1)
    planar = to_planar(decode_positions_xml(values(spark, position)), lon0=-1.5, lat0=1.25).first()
    assert (planar.lat, planar.lon, planar.heading) == pytest.approx((111111.0, 0.0, np.pi / 2))
    texts = [operation(b, "2015-09-23T21:00:00Z").replace(">", spaces, 1) for b in ("2015-09-22T13:30:00Z", "2016-01-01T00:00:00Z", "?")]
    df = values(spark, *texts)
    assert decode_operations_xml(df).count() == 1 and operation_rejects(df).count() == 2


def test_messages_to_files_and_back(spark):
    root = scratch_path(spark, "topic")
    df = spark.createDataFrame([("k", "v")], "key string, value string")
    write_messages(df, "t", "json", {"path": root})
    got = read_messages(spark, "t", "json", {"path": root}).first()
    assert (got.key, got.value) == ("k", "v") and got.timestamp is not None
    write_messages(df, "u", "json", {"path": root})
    assert read_messages(spark, "t,u", "json", {"path": root}).count() == 2
    with pytest.raises(ValueError):
        write_messages(df, None, "json", {"path": root})


def test_scratch_lives_below_the_named_folder(spark):
    assert spark.conf.get("spark.checkpoint.dir") == checkpoint_root(spark)
    assert scratch_path(spark, "x").startswith(checkpoint_root(spark))


@pytest.mark.parametrize("query", ["split_conflict_groups", "decode_conflict_group"])
@pytest.mark.parametrize("limit", [1, 2])
def test_wire_groups_do_not_depend_on_the_size_of_a_message(spark, monkeypatch, query, limit):
    rows = lambda: sorted(map(tuple, queries.QUERIES[query](spark, SF_DIR).collect()))
    want = rows()
    monkeypatch.setattr(queries, "assemble_conflict", lambda flights: assemble_conflict(flights, limit))
    assert want and rows() == want
