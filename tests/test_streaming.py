import json
import os

import pytest
from conftest import row_set
from pyspark.sql import functions as F

from emberlog.operators.aggregate import aggregate_logs, merge_rollup, rollup_batch
from emberlog.operators.identity import INDEX_BITS
from emberlog.operators.validate import check_entries
from emberlog.plans.auto_aggregate import aggregate_table
from emberlog.sources.commits import last_measure
from emberlog.sources.envelopes import explode_all, number_envelopes, read_envelopes, stream_envelopes
from emberlog.sources.tables import committed_batch, read_logs, read_rejected, read_rollup, read_summary
from emberlog.streaming import ingest
from emberlog.streaming.ingest import flush_batch, ingest_files, start_ingest, stop_ingest
from emberlog.streaming.live_rollup import stream_rollup

BASE = {"level": "info", "service": "payments", "message": "m"}


@pytest.fixture
def arriving(tmp_path):
    """Write a file of envelopes; files get rising modification times in the order they are written."""
    folder = tmp_path / "incoming"
    folder.mkdir()
    written = []

    def write(*envelopes):
        path = folder / f"{100 - len(written):03d}.json"
        path.write_text("".join((e if isinstance(e, str) else json.dumps({"logs": e})) + "\n" for e in envelopes))
        os.utime(path, (1_700_000_000 + len(written), 1_700_000_000 + len(written)))
        written.append(path)
        return str(folder)

    return write


def entries(prefix, number, **extra):
    return [
        {**BASE, "timestamp": f"2026-08-0{1 + i % 2}T12:{i % 60:02d}:00Z", "message": f"{prefix}{i}", **extra}
        for i in range(number)
    ]


def run(spark, folder, tmp_path, **params):
    root = str(tmp_path / "table")
    query = start_ingest(spark, folder, root, str(tmp_path / "checkpoint"), interval=None, **params)
    query.awaitTermination()
    return root


def test_ids_follow_arrival(spark, arriving, tmp_path):
    arriving(entries("a", 3), "not an envelope", entries("b", 2))
    folder = arriving([*entries("c", 2), 5, *entries("d", 2)])
    root = run(spark, folder, tmp_path)
    rows = read_logs(spark, f"{root}/logs").orderBy("id").collect()
    assert [r.message for r in rows] == ["a0", "a1", "a2", "b0", "b1", "c0", "c1", "d0", "d1"]
    assert len({r.id for r in rows}) == 9 and max(r.id for r in rows) < 1 << INDEX_BITS


def test_ids_follow_arrival_across_splits(spark, arriving, tmp_path):
    folder = arriving(*[entries(f"{n:03d}-", 5) for n in range(40)])
    arriving(*[entries(f"{n:03d}-", 5) for n in range(40, 80)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        root = str(tmp_path / "table")
        ingest_files(spark, folder, root, 2)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    rows = read_logs(spark, f"{root}/logs").orderBy("id").collect()
    assert [r.message for r in rows] == [f"{n:03d}-{i}" for n in range(80) for i in range(5)]
    assert [r.id for r in rows] == list(range(2 << INDEX_BITS, (2 << INDEX_BITS) + 400))


def test_micro_batches(spark, arriving, tmp_path):
    for n in range(4):
        folder = arriving(entries(f"{n}-", 6), entries(f"{n}+", 2, level="bad"))
    root = run(spark, folder, tmp_path, max_files=1)
    logs = read_logs(spark, f"{root}/logs")
    assert logs.count() == 24
    assert logs.select("batch_id").distinct().count() == 4 and committed_batch(spark, root) == 3
    assert row_set(merge_rollup(read_rollup(spark, f"{root}/rollup"))) == row_set(rollup_batch(logs))
    assert read_rejected(spark, f"{root}/rejected").count() == 8
    summary = read_summary(spark, f"{root}/summary").groupBy("status").agg(F.sum("accepted"), F.count("*"))
    assert {tuple(r) for r in summary.collect()} == {(200, 24, 4), (400, 0, 4)}
    # Resuming the same stream picks up only what is new, and late rows join their old minute.
    arriving(entries("late", 6))
    run(spark, folder, tmp_path, max_files=1)
    logs = read_logs(spark, f"{root}/logs")
    assert logs.count() == 30 and committed_batch(spark, root) == 4
    assert row_set(merge_rollup(read_rollup(spark, f"{root}/rollup"))) == row_set(rollup_batch(logs))


def test_a_backlog_is_cut_by_bytes_without_a_number_of_files(spark, arriving, tmp_path, monkeypatch):
    for n in range(3):
        folder = arriving(entries(f"{n}-", 6))
    monkeypatch.setattr("emberlog.sources.envelopes.BATCH_BYTES", 1)
    root = run(spark, folder, tmp_path)
    logs = read_logs(spark, f"{root}/logs")
    assert logs.count() == 18 and logs.select("batch_id").distinct().count() == 3


def test_refused_envelope_is_reported(spark, arriving, tmp_path):
    root = run(spark, arriving('{"logs":[]}', entries("a", 1)), tmp_path)
    rejected = read_rejected(spark, f"{root}/rejected").select("index", "reason").collect()
    assert [tuple(r) for r in rejected] == [(None, "request body must be an object with a non-empty 'logs' array")]
    rows = read_summary(spark, f"{root}/summary").orderBy("status").collect()
    assert [(r.accepted, r.rejected, r.status) for r in rows] == [(1, [], 200), (0, [], 400)]


def test_replayed_batch_changes_nothing(spark, arriving, tmp_path, monkeypatch):
    folder, root = arriving(entries("a", 20), entries("b", 5, level="x")), str(tmp_path / "table")
    envelopes = read_envelopes(spark, folder)

    def fail(*_):
        raise RuntimeError("lost")

    for step in ("append_rollup", "append_summary"):
        with monkeypatch.context() as patched:
            patched.setattr(ingest, step, fail)
            with pytest.raises(RuntimeError):
                flush_batch(envelopes, root, 0)
        assert committed_batch(spark, root) is None
    flush_batch(envelopes, root, 0)
    first = row_set(read_logs(spark, f"{root}/logs").drop("attr_text"))
    flush_batch(envelopes, root, 0)
    assert row_set(read_logs(spark, f"{root}/logs").drop("attr_text")) == first and len(first) == 20
    assert merge_rollup(read_rollup(spark, f"{root}/rollup")).agg(F.sum("count")).first()[0] == 20
    assert read_rejected(spark, f"{root}/rejected").count() == 5


def test_new_checkpoint_over_old_table_is_refused(spark, arriving, tmp_path):
    folder = arriving(entries("a", 2))
    root = run(spark, folder, tmp_path)
    with pytest.raises(ValueError, match="first_batch=1"):
        start_ingest(spark, folder, root, str(tmp_path / "other"), interval=None)
    query = start_ingest(spark, folder, root, str(tmp_path / "other"), interval=None, first_batch=1)
    query.awaitTermination()
    assert read_logs(spark, f"{root}/logs").count() == 4


def test_aggregate_over_the_table_waits_for_the_commit(spark, arriving, tmp_path):
    folder = arriving(entries("a", 30))
    root = run(spark, folder, tmp_path)
    ranges = ("2026-08-01T12:03:30Z", "2026-08-02T12:21:30Z")
    logs = read_logs(spark, f"{root}/logs")
    expected = aggregate_logs(logs, *ranges, "1m").collect()
    assert aggregate_table(spark, root, *ranges, "1m").collect() == expected
    # Rows of a batch that is not committed are in neither part.
    ingest.append_logs(logs.drop("event_date", "batch_id"), f"{root}/logs", 1)
    assert aggregate_table(spark, root, *ranges, "1m").collect() == expected


def test_continuous_stream_drains_on_stop(spark, arriving, tmp_path):
    folder, root = arriving(entries("a", 3)), str(tmp_path / "table")
    query = start_ingest(spark, folder, root, str(tmp_path / "checkpoint"), interval="1 second")
    arriving(entries("b", 4))
    stop_ingest(query)
    assert not query.isActive
    assert read_logs(spark, f"{root}/logs").count() == 7


def test_whole_files(spark, arriving):
    pretty = json.dumps({"logs": entries("a", 2)}, indent=2)
    assert explode_all(read_envelopes(spark, arriving(pretty), whole_files=True)).count() == 2


def test_live_rollup(spark, arriving, tmp_path):
    folder = arriving(entries("a", 10), entries("b", 5, level="bad"))
    stream = check_entries(explode_all(stream_envelopes(spark, folder)), F.col("received_at"))
    counts = stream_rollup(stream.where(F.col("reason").isNull()), "1 hour")
    query = (
        counts.writeStream.outputMode("complete").format("memory").queryName("live_counts")
        .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    batch = check_entries(explode_all(number_envelopes(read_envelopes(spark, folder).drop("envelope_id"))), F.current_timestamp())
    assert row_set(spark.table("live_counts")) == row_set(rollup_batch(batch.where(F.col("reason").isNull())))


def test_admission_by_entries(spark, arriving, tmp_path):
    for n in range(8):
        folder = arriving(entries(f"{n}-", 50))
    root = run(spark, folder, tmp_path, max_entries=120)
    first = read_logs(spark, f"{root}/logs").groupBy("batch_id").count().collect()
    assert sum(r["count"] for r in first) == 400 and len(first) >= 2
    size = last_measure(spark, root, ingest.ENTRY_BYTES)
    assert 60 < size < 150
    # From now on the limit goes by that size: two files of fifty are less than 120 entries, three are more.
    for n in range(8, 16):
        arriving(entries(f"{n}-", 50))
    run(spark, folder, tmp_path, max_entries=120)
    later = [r["count"] for r in read_logs(spark, f"{root}/logs").where(F.col("batch_id") >= len(first)).groupBy("batch_id").count().collect()]
    assert sum(later) == 400 and max(later) <= 150 and len(later) >= 3
