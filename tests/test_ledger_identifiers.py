from __future__ import annotations

import hashlib
import json

import cohorts
import pytest
from pyspark.sql import functions as F

from cohortgate.functions import digest, numbers
from cohortgate.operators import identifiers, ledger
from cohortgate.plans.driver_views import DEPLOYMENT


def plain_root(leaves: list[str]) -> str:
    if not leaves:
        return hashlib.sha256(b"\x01").hexdigest()
    level = list(leaves)
    while len(level) > 1:
        level += level[-1:] if len(level) % 2 else []
        level = [
            hashlib.sha256(b"\x01" + bytes.fromhex(a) + bytes.fromhex(b)).hexdigest()
            for a, b in zip(level[::2], level[1::2], strict=True)
        ]
    return level[0]


def leaf_table(spark, n):
    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    return leaves, cohorts.table(spark, list(enumerate(leaves)), "seq bigint, leaf string")


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 1024, 1025, 2500, 3073])
def test_root_equals_pairwise_hashing(spark, n):
    leaves, frame = leaf_table(spark, n)
    assert ledger.hash_root(frame, n).collect()[0]["root"] == plain_root(leaves)


@pytest.mark.parametrize("n", [1, 2, 37, 1100])
def test_parent_roots_equal_prefix_roots(spark, n):
    leaves, frame = leaf_table(spark, n)
    rows = {r["seq"]: r["parent_root"] for r in ledger.parent_roots(frame, n).collect()}
    assert sorted(rows) == list(range(n))
    for seq in {0, 1, 2, 3, 5, 30, 36, 512, 1023, 1024, 1025, n - 1} & set(rows):
        assert rows[seq] == plain_root(leaves[:seq])


def test_event_leaf_is_canonical_json(spark):
    event = {"b": "é \U0001f600", "a": {"z": "1", "y": "2"}}
    frame = cohorts.table(
        spark, [(0, event["b"], list(event["a"].items()))], "seq bigint, b string, a map<string,string>"
    )
    text = json.dumps(event, sort_keys=True, separators=(",", ":"))
    assert frame.select(ledger.event_json(frame).alias("t")).collect()[0]["t"] == text
    leaf = ledger.event_leaves(frame, ledger.event_json(frame)).collect()[0]["leaf"]
    assert leaf == hashlib.sha256(b"\x00" + text.encode()).hexdigest()


def test_canonical_json_at_all_levels(spark):
    ddl = "seq bigint, b struct<z:int,a:array<struct<y:string,x:int>>>, m map<string,struct<q:int,p:int>>, airlock map<string,string>"
    rows = [
        (0, (1, [("u", 2), None]), {"k": (1, 2), "c": (3, None)}, None),
        (1, None, None, {"z": "1", "b": "2"}),
    ]
    frame = spark.createDataFrame(rows, ddl)
    got = [json.loads(r["t"]) for r in frame.orderBy("seq").select(ledger.event_json(frame).alias("t")).collect()]
    texts = [r["t"] for r in frame.orderBy("seq").select(ledger.event_json(frame).alias("t")).collect()]
    assert "airlock" not in got[0] and got[1]["airlock"] == {"b": "2", "z": "1"} and got[1]["b"] is None
    assert texts == [json.dumps(g, sort_keys=True, separators=(",", ":")) for g in got]


@pytest.mark.parametrize("seqs", [[0, 1, 3], [0, 1, 1, 2], [0, 1]])
def test_root_refuses_gaps_and_repeats(spark, seqs):
    frame = spark.createDataFrame([(s, "00" * 32) for s in seqs], "seq bigint, leaf string")
    with pytest.raises(Exception, match="without gaps or repeats"):
        ledger.hash_root(frame, 3).collect()


def test_number_texts(spark):
    values = [0.0005, 0.9995, 1e-5, 2e-6, 5e-7, 1e-7, 1e-9, 0.5, 1.0, 0.0, -0.25, 1234567.0, 1e6, 123456.0, 2.5e7, 1e15, 1e16, 1.5e300, 0.1 + 0.2, 100.0, -3e-8]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate([*values, None])], "i int, v double")
    rows = frame.select("v", numbers.decimal_text(F.col("v")).alias("d"), numbers.significant(F.col("v")).alias("s")).orderBy("i").collect()
    assert [(r["d"], r["s"]) for r in rows[:-1]] == [(repr(v), f"{v:.6g}") for v in values]
    assert (rows[-1]["d"], rows[-1]["s"]) == (None, None)


def test_broken_chain_is_found(spark):
    leaves, frame = leaf_table(spark, 9)
    events = ledger.parent_roots(frame, 9).withColumn(
        "parent_root", F.when(F.col("seq") == 4, "0" * 64).otherwise(F.col("parent_root"))
    )
    assert [r["seq"] for r in ledger.broken_chain(events, frame, 9).collect()] == [4]
    assert ledger.verify_root(frame, 9, plain_root(leaves)).collect()[0]["verified"]
    assert ledger.lost_or_changed(frame, frame.filter("seq < 8")).count() == 1


def test_run_id_text(spark):
    payload = {"study_id": 'S "1"', "cpra": cohorts.CPRA, "config_sha256": "ab", "input_sha256": {"y": "2", "x": "1"}}
    expected = "RUN-" + hashlib.sha256(json.dumps(payload, sort_keys=True).encode()).hexdigest()[:12]
    got = spark.range(1).select(digest.run_id(
        F.lit(payload["study_id"]), F.lit(payload["cpra"]), F.lit("ab"),
        F.create_map(F.lit("y"), F.lit("2"), F.lit("x"), F.lit("1")),
    ).alias("r")).collect()[0]["r"]
    assert got == expected


def test_identifier_scan(spark):
    cases = {
        '{"a":{"Participant_ID":1}}': True,
        '{"a":["x PSU-00ABCD y"]}': True,
        '{"a":"P1234"}': True,
        '{"a":"call 123 456 7890"}': True,
        '{"input_sha256":{"f":"PSU-00ABCD"},"git_commit":"1234567890"}': False,
        '{"note":"the \\"pseudo_id\\": column"}': False,
        '{"a":"APSU-00ABCD"}': False,
        '{"a":"éP1234"}': False,
        '{"a":1}': False,
        r'{"a":"seen\nPSU-00AB12"}': True,
        r'{"a":"id\tP000000001"}': True,
        r'{"a":"\u0050SU-00AB12"}': True,
        r'{"participant\u005fid":1}': True,
        r'{"a":"tail\\"}': False,
        '{"input_sha256":{"f":{"g":["PSU-00ABCD",{"h":"P1234"}]}},"b":"x"}': False,
        '{"input_sha256":{"f":{"g":["PSU-00ABCD"]}},"b":"P1234"}': True,
        '{"input_sha256":[["PSU-00ABCD"]],"output_sha256":"P1234"}': False,
        '{"input_sha256":{"pseudo_id":1}}': True,
        '["P1234"]': True,
        '{"a":"' + "x" * 20_000 + ' P1234"}': True,
    }
    frame = cohorts.table(spark, [(t,) for t in cases], "t string")
    rows = frame.select("t", identifiers.has_forbidden_content(F.col("t"), DEPLOYMENT).alias("hit")).collect()
    assert {r["t"]: r["hit"] for r in rows} == cases


def test_run_events_append_and_verify(spark, tmp_path):
    """Two appended runs: the second one's parent root is the root of the first."""
    from cohortgate.operators import finalize
    from cohortgate.sources import tables

    ddl = (
        "request_id string, cpra string, timestamp string, config_sha256 string, "
        "input_sha256 map<string,string>, output_sha256 map<string,string>, sdc map<string,string>, "
        "airlock map<string,string>"
    )
    path = f"{tmp_path}/ledger"
    for seq in range(2):
        ledger_now = tables.read_ledger(spark, path)
        leaves = ledger.event_leaves(ledger_now, ledger.event_json(ledger_now))
        parent = ledger.hash_root(leaves, seq).collect()[0]["root"]
        runs = spark.createDataFrame(
            [(f"R{seq}", cohorts.CPRA, "2026-01-01T00:00:00+00:00", "ab", {"x": "1"}, {"y": "2"},
              {"client_total": "<10"}, None)], ddl,
        )
        event = ledger.run_events(runs, F.lit(seq), F.lit(parent), "unknown")
        tables.append_json_lines(event, path)
    stored = tables.read_ledger(spark, path)
    leaves = ledger.event_leaves(stored, ledger.event_json(stored))
    assert ledger.broken_chain(stored, leaves, 2).count() == 0
    assert ledger.sequence_faults(stored).collect()[0]["dense"]
    scan = stored.select(
        identifiers.has_forbidden_content(ledger.event_json(stored), DEPLOYMENT).alias("hit")
    )
    assert not any(r["hit"] for r in scan.collect())
    files = tables.file_digests(spark, path)
    assert files.filter("path like '%.json'").count() >= 2
    note = finalize.notifications(
        spark.createDataFrame([("S", cohorts.CPRA, "RUN-1")], "study_id string, cpra string, run_id string"),
        "sent_to_epi",
    ).collect()[0]
    assert note["workflow_state"] == "sent_to_epi" and note["received_timestamp"].endswith("+00:00")
