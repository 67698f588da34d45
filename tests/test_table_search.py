"""Pages over a committed table, files skipped by their bitmaps, the manifest and the commit log."""

import random
from datetime import date

import pytest
from conftest import row_set
from pyspark.sql import functions as F

from emberlog.functions.variants import attribute_text_of_json
from emberlog.operators.paging import log_page
from emberlog.operators.search import search_logs
from emberlog.plans import table_search
from emberlog.plans.skip_index import index_files
from emberlog.plans.storage import append_logs, compact_day, vacuum_table
from emberlog.plans.table_search import search_table, walk_table
from emberlog.sources import skipping
from emberlog.sources.commits import claim_writer, commit, committed_batch
from emberlog.sources.envelopes import read_envelopes
from emberlog.sources.files import child_names, delete, put_if_absent, read_text
from emberlog.sources.manifest import generations, publish, read_manifest
from emberlog.sources.tables import covered_bounds, read_logs, stored_days
from emberlog.streaming.ingest import flush_batch, ingest_files, start_ingest

DAYS = [date(2026, 8, d) for d in (1, 2, 3, 4)]
WORDS = ["Payment", "declined", "cache", "MISS", "50%", "a_b", "back\\slash", "Ümlaut", "straße", "Σίσυφος", "日本語", "\U0001f600", "line\nbreak"]


def batch_rows(make_logs, number, rows=120):
    draw = random.Random(number)
    data = [
        (
            f"2026-08-0{1 + i % 4}T{draw.randrange(24):02d}:{draw.randrange(60):02d}:00Z",
            draw.choice(["info", "error"]),
            f"s{i % 3}",
            " ".join(draw.sample(WORDS, 3)) + f" req-{number}-{i}",
            {"request": f"r{number}-{i}", "k": i % 5, "flag": i % 2 == 0},
        )
        for i in range(rows)
    ]
    logs = make_logs(data).withColumn("id", F.col("id") + number * 1000)
    return logs.withColumn("attr_text", attribute_text_of_json("attributes"))


@pytest.fixture
def root(spark, make_logs, tmp_path):
    root = str(tmp_path / "table")
    for number in range(3):
        append_logs(batch_rows(make_logs, number), f"{root}/logs", number, index=True)
        commit(spark, root, number)
    return root


def ids(page):
    return [row.id for row in page.rows.collect()]


def expected_ids(spark, root, upto=2, **params):
    logs = read_logs(spark, f"{root}/logs", upto)
    return [row.id for row in search_logs(logs, limit=1000, **params).select("id").collect()]


def test_a_walk_gives_every_row_once(spark, root):
    for params in ({}, {"level": "error"}, {"service": "s1", "since": "2026-08-02T05:00:00Z"}, {"until": "2026-08-03T05:00:00Z"}):
        pages = list(walk_table(spark, root, limit=100, **params))
        found = [i for page in pages for i in ids(page)]
        assert found == expected_ids(spark, root, **params)
        assert all(page.next_cursor for page in pages[:-1]) and pages[-1].next_cursor is None


def test_an_unfiltered_page_reads_one_day(spark, root, monkeypatch):
    asked = []
    monkeypatch.setattr(table_search, "read_logs", lambda *args: asked.append(args[3]) or read_logs(*args))
    first = search_table(spark, root, limit=20)
    assert asked == [[DAYS[3]], [DAYS[3]]]
    asked.clear()
    # The cursor resumes on its own day, without a look at the newer ones.
    later = search_table(spark, root, limit=20, cursor=search_table(spark, root, limit=80, cursor=first.next_cursor).next_cursor)
    assert asked[-1] == [DAYS[2]] and DAYS[3] not in asked[-2]
    assert ids(later) == expected_ids(spark, root)[100:120]


def test_a_walk_reads_the_table_a_constant_number_of_times(spark, root, monkeypatch):
    asked = []
    monkeypatch.setattr(table_search, "read_logs", lambda *args: asked.append(args[3]) or read_logs(*args))
    pages = list(walk_table(spark, root, limit=12))
    # The first page, the instants to cut at, and one run.
    assert len(pages) == 30 and len(asked) <= 4
    assert [i for page in pages for i in ids(page)] == expected_ids(spark, root)


@pytest.mark.parametrize("ahead", [20, 1000])
def test_a_walk_gives_the_pages_of_single_searches(spark, root, make_logs, monkeypatch, ahead):
    """Runs of any length, with every row twice and many rows at one instant."""
    hot = batch_rows(make_logs, 3).withColumn("timestamp", F.to_timestamp(F.lit("2026-08-02T07:00:00Z")))
    for number, rows in enumerate([hot, hot, batch_rows(make_logs, 0)], 3):
        append_logs(rows, f"{root}/logs", number)
        commit(spark, root, number)
    monkeypatch.setattr(table_search, "READ_AHEAD", ahead)
    expected, cursor = [], None
    while True:
        page = search_table(spark, root, limit=45, cursor=cursor, service="s1")
        expected.append((ids(page), cursor := page.next_cursor))
        if cursor is None:
            break
    assert len(expected) > 3
    assert [(ids(page), page.next_cursor) for page in walk_table(spark, root, limit=45, service="s1")] == expected


def test_uncommitted_rows_are_not_shown(spark, root, make_logs):
    before = expected_ids(spark, root)
    append_logs(batch_rows(make_logs, 3), f"{root}/logs", 3)
    assert ids(search_table(spark, root, limit=1000)) == before
    commit(spark, root, 3)
    assert len(ids(search_table(spark, root, limit=1000))) == len(before) + 120


def test_pages_of_a_walk_belong_together(spark, root, make_logs):
    """Ingestion, compaction and deletion of what was replaced long ago do not disturb a walk."""
    before = expected_ids(spark, root)
    first = search_table(spark, root, limit=150)
    append_logs(batch_rows(make_logs, 3), f"{root}/logs", 3)
    commit(spark, root, 3)
    for day in DAYS:
        compact_day(spark, f"{root}/logs", day, 3)
    vacuum_table(spark, f"{root}/logs")
    second = search_table(spark, root, limit=150, cursor=first.next_cursor)
    assert ids(first) + ids(second) == before[:300]
    # A new walk on the compacted table, and one that goes on after another batch.
    third = search_table(spark, root, limit=300)
    append_logs(batch_rows(make_logs, 4), f"{root}/logs", 4)
    commit(spark, root, 4)
    rest = search_table(spark, root, limit=1000, cursor=third.next_cursor)
    assert sorted(ids(third) + ids(rest)) == sorted([*before, *(row.id for row in batch_rows(make_logs, 3).select("id").collect())])


def test_a_walk_goes_on_live_when_its_snapshot_is_gone(spark, root, make_logs):
    first = search_table(spark, root, limit=150)
    for day in DAYS:
        compact_day(spark, f"{root}/logs", day, 2)
    vacuum_table(spark, f"{root}/logs", 0)
    assert 0 not in generations(spark, f"{root}/logs")
    second = search_table(spark, root, limit=1000, cursor=first.next_cursor)
    assert ids(first) + ids(second) == expected_ids(spark, root)
    # Tokens without a snapshot, and with one that the table never had.
    plain = search_logs(read_logs(spark, f"{root}/logs"), limit=10)
    token = log_page(plain, limit=9).next_cursor
    assert ids(search_table(spark, root, limit=5, cursor=token)) == expected_ids(spark, root)[9:14]


def test_empty_tables(spark, tmp_path):
    page = search_table(spark, str(tmp_path / "none"))
    assert page.rows.collect() == [] and page.next_cursor is None
    with pytest.raises(ValueError, match="limit"):
        search_table(spark, str(tmp_path / "none"), limit=0)
    with pytest.raises(ValueError, match="invalid cursor"):
        search_table(spark, str(tmp_path / "none"), cursor="?")


def test_a_running_reader_keeps_its_files(spark, root):
    path = f"{root}/logs"
    planned = read_logs(spark, path)
    expected = row_set(planned.select("id", "message"))
    planned = read_logs(spark, path)
    for day in DAYS:
        compact_day(spark, path, day, 2)
    assert row_set(planned.select("id", "message")) == expected == row_set(read_logs(spark, path).select("id", "message"))
    vacuum_table(spark, path, 0)
    assert row_set(read_logs(spark, path).select("id", "message")) == expected
    assert {name for day in DAYS for name in child_names(spark, f"{path}/event_date={day}")} == {"batch_id=-3"}


def test_planning_a_read_starts_no_job(spark, root):
    compact_day(spark, f"{root}/logs", DAYS[0], 2)
    context = spark.sparkContext
    context.setJobGroup("planning", "reads")
    try:
        read_logs(spark, f"{root}/logs")
        assert stored_days(spark, f"{root}/logs") == DAYS and covered_bounds(spark, f"{root}/logs") == {"2026-08-01": 2}
        assert list(context.statusTracker().getJobIdsForGroup("planning")) == []
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)


def files_read(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = (plan.finalPhysicalPlan() if "Adaptive" in plan.getClass().getName() else plan).collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size()))


PATTERNS = ["declined", "CACHE miss", "50\\%", "a\\_b", "a_b", "50%", "p%t%req-1", "req-2-11", "req_1_7", "back\\\\slash", "\\c\\ache", "ümlaut",
            "ÜMLAUT", "STRASSE", "straße", "σίσυφοσ", "日本", "\U0001f600", "line\nbreak", "xy", "q", "%", "_", "nowhere-to-be-found", "\\"]


@pytest.mark.parametrize("compacted", [False, True])
def test_no_file_with_a_match_is_skipped(spark, root, compacted):
    path, skipped = f"{root}/logs", 0
    if compacted:
        compact_day(spark, path, DAYS[0], 2)
    logs = read_logs(spark, path)
    names = logs.select("id", F.col("_metadata.file_path").alias("file"))
    place = dict(map(tuple, names.collect()))
    for q in PATTERNS:
        excluded = set(skipping.excluded_files(spark, path, None, q, {}))
        matching = {row.id for row in search_logs(logs, q=q, limit=1000).select("id").collect()}
        assert not {place[i] for i in matching} & excluded, q
        assert [row.id for row in search_logs(logs, q=q, limit=1000).select("id").collect()] == ids(search_table(spark, root, q=q, limit=1000))
        skipped += len(excluded)
    assert skipped > 40
    for attrs in ({"request": "r1-7"}, {"k": 3}, {"flag": True, "k": 4}, {"request": "r9"}, {"request": "r2-8", "k": 3}, {"absent": "x"}):
        texts = {key: str(value).lower() if isinstance(value, bool) else str(value) for key, value in attrs.items()}
        excluded = set(skipping.excluded_files(spark, path, None, None, texts))
        matching = expected_ids(spark, root, attrs=attrs)
        assert not {place[i] for i in matching} & excluded
        assert matching == ids(search_table(spark, root, attrs=attrs, limit=1000))
    everything = len(set(place.values()))
    rare = set(skipping.excluded_files(spark, path, None, None, {"request": "r1-7"}))
    assert len(rare) >= everything - 2
    assert files_read(read_logs(spark, path, without_files=sorted(rare)).select("id")) == len(set(place.values()) - rare) < everything


def test_files_without_bitmaps_are_read(spark, root, make_logs):
    path = f"{root}/logs"
    append_logs(batch_rows(make_logs, 3), path, 3)
    commit(spark, root, 3)
    assert ids(search_table(spark, root, q="req-3-5", limit=1000)) == expected_ids(spark, root, 3, q="req-3-5") != []
    index_files(spark, path, batch_id=3)
    index_files(spark, path)
    assert ids(search_table(spark, root, attrs={"request": "r3-5"})) == expected_ids(spark, root, 3, attrs={"request": "r3-5"}) != []
    delete(spark, skipping.skip_path(path))
    assert skipping.excluded_files(spark, path, None, "req-3-5", {}) == []


def test_only_one_writer_creates_a_generation(spark, tmp_path):
    path = str(tmp_path / "t")
    publish(spark, path, lambda m, at: m.__class__(covered={"2026-08-01": [1]}))
    assert read_manifest(spark, path).covered == {"2026-08-01": [1]} and read_manifest(spark, path, 0).covered == {}
    raced = []

    def change(now, at):
        if not raced:
            raced.append(publish(spark, path, lambda m, at: m.__class__(covered=m.covered | {"2026-08-02": [1]})))
        return now.__class__(covered=now.covered | {"2026-08-03": [1, 2]})

    publish(spark, path, change)
    assert read_manifest(spark, path).covered == {"2026-08-01": [1], "2026-08-02": [1], "2026-08-03": [1, 2]}
    assert read_manifest(spark, path, 99) is None


def test_small_files(spark, tmp_path):
    path = f"{tmp_path}/a/b"
    assert read_text(spark, path) is None
    assert put_if_absent(spark, path, "é\n") and not put_if_absent(spark, path, "other")
    assert read_text(spark, path) == "é\n" and child_names(spark, f"{tmp_path}/a") == ["b"]


def test_commit_log(spark, tmp_path):
    root = str(tmp_path / "t")
    assert committed_batch(spark, root) is None
    commit(spark, root, 5)
    with pytest.raises(ValueError, match="batch 6 is missing"):
        commit(spark, root, 7)
    for number in range(5, 40):
        commit(spark, root, number)
    assert committed_batch(spark, root) == 39 and len(child_names(spark, f"{root}/commits")) == 16
    # An entry that was lost hides what follows it.
    delete(spark, f"{root}/commits/37")
    assert committed_batch(spark, root) == 36


def envelopes_folder(tmp_path, name, rows):
    folder = tmp_path / name
    folder.mkdir()
    entry = '{"timestamp":"2026-08-01T12:00:00Z","level":"info","service":"s","message":"m%d"}'
    (folder / "a.json").write_text('{"logs":[' + ",".join(entry % i for i in range(rows)) + "]}\n")
    return str(folder)


def test_a_missing_batch_is_refused(spark, tmp_path):
    folder, root = envelopes_folder(tmp_path, "in", 3), str(tmp_path / "t")
    ingest_files(spark, folder, root, 2)
    with pytest.raises(ValueError, match="batch 3 is missing"):
        ingest_files(spark, folder, root, 4)
    ingest_files(spark, folder, root, 3)
    assert committed_batch(spark, root) == 3 and read_logs(spark, f"{root}/logs").count() == 6


def test_a_replaced_writer_stops(spark, tmp_path):
    folder, root = envelopes_folder(tmp_path, "in", 3), str(tmp_path / "t")
    first = claim_writer(spark, root)
    flush_batch(read_envelopes(spark, folder), root, 0, first)
    second = claim_writer(spark, root)
    with pytest.raises(RuntimeError, match="was replaced by writer"):
        flush_batch(read_envelopes(spark, folder), root, 1, first)
    flush_batch(read_envelopes(spark, folder), root, 1, second)
    start_ingest(spark, folder, root, str(tmp_path / "checkpoint"), interval=None, first_batch=2).awaitTermination()
    assert committed_batch(spark, root) == 2 and claim_writer(spark, root) == 4
