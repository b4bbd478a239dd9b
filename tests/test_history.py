"""Merge, replay and the stream against a fold that handles one scan after the other."""

import json
import os
import random
import shutil
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rolewatch.operators import outbox, replay, snapshot
from rolewatch.schemas import CHANGE, DELIVERY, LANDED, POSTING, SNAPSHOT
from rolewatch.streaming import arrivals, discovery_stream, tables, views
from rolewatch.streaming import tables as tables_of

START = datetime(2026, 8, 1)


def posting(company, url, source, at, mark="m0", key=None):
    return {
        "id": key or f"{company}/{url}", "company_id": company, "source_id": source, "source_url": "https://s.example", "canonical_url": url,
        "application_url": url, "title": f"Intern {mark}", "description": "", "locations": ["Austin, TX"], "employment_type": "INTERNSHIP",
        "first_seen_at": at, "last_seen_at": at, "content_fingerprint": mark, "extraction_confidence": 0.9,
    }


def fold(state, changes, jobs, scanned):
    """One scan on a plain dictionary: strikes first, then upserts."""
    for source in scanned:
        seen = {j["canonical_url"] for j in jobs if j["source_id"] == source}
        for row in state.values():
            if row["source_id"] == source and row["active"] and row["canonical_url"] not in seen:
                row["missed_scans"] += 1
                row["active"] = row["missed_scans"] < 2
    for job in jobs:
        key = (job["company_id"], job["canonical_url"])
        old = state.get(key)
        kind = "NEW" if old is None else "UPDATED" if old["content_fingerprint"] != job["content_fingerprint"] else None
        if kind:
            changes.append((*key, kind, job["last_seen_at"]))
        state[key] = {**job, "active": True, "missed_scans": 0}
        if old:
            state[key] |= {"id": old["id"], "first_seen_at": old["first_seen_at"]}


def random_history(seed, sources=6, scans=30):
    """Scans in which sources fail, postings come and go, and two sources of a company compete."""
    rng = random.Random(seed)
    for n in range(scans):
        at = START + timedelta(hours=7 * n)
        scanned = [f"s{i}" for i in range(sources) if rng.random() > 0.25]
        jobs = {}
        for source in scanned:
            company = f"c{int(source[1:]) // 2}"
            for url in range(8):
                if rng.random() < 0.45:
                    jobs[company, url] = posting(company, f"https://j.example/{url}", source, at, f"m{rng.randrange(3)}")
        yield at, scanned, list(jobs.values())


def frame(spark, rows, schema=POSTING):
    names = [f.name for f in spark.createDataFrame([], schema).schema.fields]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)


def scan_frame(spark, pairs):
    return spark.createDataFrame(pairs, "source_id string, scanned_at timestamp")


def as_state(df):
    return {(r.company_id, r.canonical_url): r.asDict() for r in df.collect()}


def as_changes(df):
    return sorted((r.company_id, r.canonical_url, r.kind, r.created_at) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_replay_equals_fold(spark, seed):
    state, changes, sightings, scans = {}, [], [], []
    for at, scanned, jobs in random_history(seed):
        fold(state, changes, jobs, scanned)
        sightings += jobs
        scans += [(s, at) for s in scanned]
    seen, done = frame(spark, sightings), scan_frame(spark, scans)
    assert as_changes(replay.replay_changes(seen)) == sorted(changes)
    assert as_state(replay.replay_snapshot(seen, done)) == state
    assert any(not r["active"] for r in state.values()) and any(r["missed_scans"] == 1 for r in state.values())


@pytest.mark.parametrize("cut", [3, 17])
def test_replay_continues_a_snapshot(spark, cut):
    state, changes, sightings, scans = {}, [], [], []
    stored = []
    for n, (at, scanned, jobs) in enumerate(random_history(5)):
        if n == cut:
            stored = [dict(r) for r in state.values()]
            changes, sightings, scans = [], [], []
        fold(state, changes, jobs, scanned)
        sightings += jobs
        scans += [(s, at) for s in scanned]
    seen, done, before = frame(spark, sightings), scan_frame(spark, scans), frame(spark, stored, SNAPSHOT)
    assert as_changes(replay.replay_changes(seen, before)) == sorted(changes)
    assert as_state(replay.replay_snapshot(seen, done, before)) == state


def test_reactivations_equal_fold(spark):
    state, sightings, scans, expected = {}, [], [], set()
    for at, scanned, jobs in random_history(9):
        for j in jobs:
            old = state.get((j["company_id"], j["canonical_url"]))
            if old and not old["active"]:
                expected.add((j["company_id"], j["canonical_url"], at))
        fold(state, [], jobs, scanned)
        sightings += jobs
        scans += [(s, at) for s in scanned]
    got = replay.reactivations(frame(spark, sightings), scan_frame(spark, scans)).collect()
    assert {(r.company_id, r.canonical_url, r.reopened_at) for r in got} == expected and expected


def test_merge_sequence(spark):
    """Scans merged one by one, with a stored id that differs from the scan's."""
    state, before = {}, frame(spark, [], SNAPSHOT)
    for at, scanned, jobs in list(random_history(3, scans=6)):
        changes = []
        jobs = [{**j, "id": f"{j['id']}@{at.isoformat()}"} for j in jobs]
        fold(state, changes, jobs, scanned)
        merged = snapshot.merge_scan(before, frame(spark, jobs), scan_frame(spark, [(s, at) for s in scanned]))
        rows = merged.collect()
        got = sorted((r.company_id, r.canonical_url, r.change_kind, r.last_seen_at) for r in rows if r.change_kind)
        assert got == sorted(changes)
        plain = [{k: v for k, v in r.asDict().items() if k != "change_kind"} for r in rows]
        assert {(r["company_id"], r["canonical_url"]): r for r in plain} == state
        before = frame(spark, plain, SNAPSHOT)


def test_strikes_and_updates(spark):
    at = [START + timedelta(hours=h) for h in range(5)]
    job = posting("c", "u", "s", at[0], "one", key="job-1")
    ticked, nobody = scan_frame(spark, [("s", at[0])]), scan_frame(spark, [])
    state = frame(spark, [], SNAPSHOT)

    def step(jobs, scanned):
        nonlocal state
        rows = snapshot.merge_scan(state, frame(spark, jobs), scanned).collect()
        state = frame(spark, [r.asDict() for r in rows], SNAPSHOT)
        return [r.change_kind for r in rows], [(r.active, r.missed_scans, r.title) for r in rows]

    assert step([job], ticked) == (["NEW"], [(True, 0, "Intern one")])
    assert step([job], ticked) == ([None], [(True, 0, "Intern one")])
    changed = {**job, "title": "Engineering Intern", "content_fingerprint": "two", "last_seen_at": at[1]}
    assert step([changed], ticked) == (["UPDATED"], [(True, 0, "Engineering Intern")])
    assert step([], nobody)[1] == [(True, 0, "Engineering Intern")]
    assert step([], ticked)[1] == [(True, 1, "Engineering Intern")]
    assert step([], ticked)[1] == [(False, 2, "Engineering Intern")]
    assert step([], ticked)[1] == [(False, 2, "Engineering Intern")]
    assert step([{**changed, "last_seen_at": at[4]}], ticked) == ([None], [(True, 0, "Engineering Intern")])
    (row,) = state.collect()
    assert (row.id, row.first_seen_at) == ("job-1", at[0])


def test_change_ids_are_stable(spark):
    jobs = frame(spark, [posting("c", "u", "s", START)])
    merged = snapshot.merge_scan(frame(spark, [], SNAPSHOT), jobs, scan_frame(spark, [("s", START)]))
    first, second = snapshot.changes_of(merged).collect(), snapshot.changes_of(merged).collect()
    assert first == second and len(first[0].id) == 32
    assert replay.replay_changes(jobs).collect()[0].id == first[0].id


def test_late_sightings_are_set_aside(spark):
    stored = frame(spark, [{**posting("c", "u", "s", START + timedelta(days=1)), "active": True, "missed_scans": 0}], SNAPSHOT)
    rows = [posting("c", "u", "s", START), posting("c", "u", "s", START + timedelta(days=2)), posting("c", "v", "s", START)]
    fresh, late = replay.split_late(frame(spark, rows), stored)
    assert sorted((r.canonical_url, r.last_seen_at.day) for r in fresh.collect()) == [("u", 3), ("v", 1)]
    assert [(r.canonical_url, r.last_seen_at.day) for r in late.collect()] == [("u", 1)]


# ---- stream ----------------------------------------------------------------------------------


def landed_rows(n, at, ashby_jobs, page_titles):
    """One scan of a board source and a page source of the same company, plus a source that always fails."""
    ashby = json.dumps({"jobs": [{"title": t, "jobUrl": f"https://jobs.example.com/acme/{u}", "location": "Austin, TX"} for u, t in ashby_jobs]})
    records = [{"@type": "JobPosting", "title": t, "url": f"https://jobs.example.com/acme/{u}", "jobLocation": {"address": {"addressCountry": "US"}}} for u, t in page_titles]
    html = f'<script type="application/ld+json">{json.dumps(records)}</script>'
    scan = f"scan-{n}"
    return [
        (scan, "acme", "board", "https://acme.example/b", "ASHBY", None, None, 0, 1, at, ashby),
        (scan, "acme", "page", "https://acme.example/p", "GENERIC_HTML", None, None, 0, 1, at, html),
        (scan, "other", "shell", "https://other.example/p", "GENERIC_HTML", None, None, 0, 1, at, "<div id=app></div>"),
        (scan, None, None, None, "SCAN_END", None, None, 0, 3, at, None),
    ]


SCANS = [
    ([("a1", "Software Intern"), ("a2", "Data Intern")], [("a2", "Data Intern"), ("p1", "Web Intern")]),
    ([("a1", "Software Intern II")], [("p1", "Web Intern")]),
    ([], [("p1", "Web Intern"), ("a1", "Software Intern II")]),
    ([("a2", "Data Intern")], [("p2", "Mobile Intern"), ("x", "Senior Accountant")]),
    ([("a2", "Data Intern")], [("p2", "Mobile Intern")]),
]


def run_stream(spark, tmp_path, groups, name):
    """Scans land group by group; each group is one run of the stream."""
    folder, root, checkpoint = (str(tmp_path / name / x) for x in ("landed", "root", "checkpoint"))
    watched = [("acme", []), ("other", [])]

    def targets(session):
        return session.createDataFrame(watched, "id string, role_keywords array<string>")

    for group in groups:
        rows = [r for n in group for r in landed_rows(n, START + timedelta(hours=n), *SCANS[n])]
        spark.createDataFrame(rows, LANDED).coalesce(1).write.mode("append").parquet(folder)
        query = discovery_stream.start_discovery(spark, folder, root, checkpoint, targets)
        query.awaitTermination()
    state = discovery_stream.current_snapshot(spark, root)
    tables = {t: spark.read.parquet(f"{root}/{t}") for t in ("changes", "deliveries", "scan_runs", "source_results", "late")}
    return as_state(state), tables, (folder, root, targets)


def test_stream_in_batches_equals_all_at_once(spark, tmp_path):
    apart, tables, (folder, root, targets) = run_stream(spark, tmp_path, [[0, 1], [2], [3, 4]], "apart")
    together, whole, _ = run_stream(spark, tmp_path, [[0, 1, 2, 3, 4]], "together")
    assert apart == together

    def log(t):
        return sorted((r.job_id, r.kind, r.created_at) for r in t["changes"].collect())

    assert log(tables) == log(whole)
    kinds = [k for _, k, _ in log(tables)]
    assert kinds.count("NEW") == 4 and kinds.count("UPDATED") >= 1
    assert tables["deliveries"].count() == len(kinds)
    assert tables["late"].count() == 0
    failed = tables["source_results"].where("status = 'FAILED'").select("source_id").distinct().collect()
    assert [r.source_id for r in failed] == ["shell"]
    runs = {r.id: (r.target_count, r.failure_count) for r in tables["scan_runs"].collect()}
    assert runs["scan-0"] == (2, 1) and len(runs) == 5

    # Counts and the log grow by what batches change, and equal a recount.
    batches = tables_of.committed(spark, root)
    now = discovery_stream.current_snapshot(spark, root)
    counted = views.counts(spark, root, batches)
    assert counted == {
        "postings": now.count(), "active_postings": now.where("active").count(), "unread": len(kinds), "scan_runs": 5,
        "new_changes": kinds.count("NEW"), "updated_changes": kinds.count("UPDATED"),
    }
    whole_log = [r.id for r in tables["changes"].orderBy(F.col("created_at").desc(), "id").collect()]
    page = views.newest(spark, root, CHANGE, 3).collect()
    after = views.newest(spark, root, CHANGE, 100, (page[-1].created_at, page[-1].id)).collect()
    assert [r.id for r in page] == whole_log[:3] and [r.id for r in after] == whole_log[3:]

    # Running the last batch again changes nothing.
    rows = [r for n in (3, 4) for r in landed_rows(n, START + timedelta(hours=n), *SCANS[n])]
    last = spark.read.parquet(f"{root}/changes").agg(F.max("batch")).first()[0]
    discovery_stream.process_batch(spark.createDataFrame(rows, LANDED), last, root, targets)
    assert as_state(discovery_stream.current_snapshot(spark, root, last + 1)) == apart
    assert spark.read.parquet(f"{root}/changes").count() == len(kinds)
    assert views.counts(spark, root, batches) == counted and [r.id for r in views.newest(spark, root, CHANGE, 100).collect()] == whole_log


def test_newest_changes_read_the_newest_days_only(spark, tmp_path):
    root = str(tmp_path / "days")
    for batch in range(4):
        rows = [(f"c{batch}-{n}", "j", "a", "NEW", START + timedelta(days=2 * batch + n % 2, minutes=n), None) for n in range(10)]
        views.append_log(spark.createDataFrame(rows, CHANGE), root, batch)
    page = views.newest(spark, root, CHANGE, 7)
    assert [r.id for r in page.collect()] == [f"c3-{n}" for n in (9, 7, 5, 3, 1, 8, 6)]
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "day" in plan.partition("PartitionFilters")[2].split("]")[0] and "2026-08-07" not in plan.partition("PushedFilters")[2]
    assert {str(r.d) for r in views.newest(spark, root, CHANGE, 5).select(F.to_date("created_at").alias("d")).collect()} == {"2026-08-08"}
    assert views.newest(spark, root, CHANGE, 1000).count() == 40
    assert views.first_day(spark.createDataFrame([], views.DAY_COUNT), 3) is None


def test_changed_rows_are_merged_on_read(spark, tmp_path):
    root, now = str(tmp_path / "deltas"), START
    rows = [(f"d{n}", f"c{n}", "DISCORD", "SENDING", 1, now, None, None, now, now) for n in range(6)]
    views.append_changed(spark.createDataFrame(rows, DELIVERY), root, "deliveries", 0)
    answers = spark.createDataFrame([("d1", "m1", None), ("d2", None, "down"), ("x", None, None)], "id string, external_id string, error string")
    for version in (1, 2):
        stored = views.merged(spark, root, "deliveries", DELIVERY)
        changed = outbox.settled(stored, answers, F.lit(now))
        assert changed.count() == (2 if version == 1 else 0)
        views.append_changed(changed, root, "deliveries", version)
    after = sorted(views.merged(spark, root, "deliveries", DELIVERY).collect())
    assert [(r.id, r.status) for r in after] == [("d0", "SENDING"), ("d1", "SENT"), ("d2", "FAILED"), ("d3", "SENDING"), ("d4", "SENDING"), ("d5", "SENDING")]
    views.compact(spark, root, "deliveries", DELIVERY, 2)
    assert sorted(views.merged(spark, root, "deliveries", DELIVERY).collect()) == after
    views.append_changed(spark.createDataFrame([rows[0][:3] + ("FAILED",) + rows[0][4:]], DELIVERY), root, "deliveries", 3)
    assert {r.id: r.status for r in views.merged(spark, root, "deliveries", DELIVERY).collect()}["d0"] == "FAILED"


def test_stream_sets_late_scans_aside(spark, tmp_path):
    state, tables, _ = run_stream(spark, tmp_path, [[0], [2], [1]], "late")
    assert tables["late"].count() == 2
    assert {r["title"] for r in state.values()} == {"Software Intern II", "Data Intern", "Web Intern"}


def land_and_run(spark, tmp_path, name, batches, watched=(("acme", []),)):
    """Each list of landed rows is one run of the stream; gives the root."""
    folder, root, checkpoint = (str(tmp_path / name / x) for x in ("landed", "root", "checkpoint"))

    def targets(session):
        return session.createDataFrame(list(watched), "id string, role_keywords array<string>")

    for rows in batches:
        spark.createDataFrame(rows, LANDED).coalesce(1).write.mode("append").parquet(folder)
        discovery_stream.start_discovery(spark, folder, root, checkpoint, targets).awaitTermination()
    return root


def board_page(scan, page, at, total, *jobs, source="eight"):
    body = json.dumps({"status": 200, "data": {"count": total, "positions": [{"name": f"Data Intern {j}", "positionUrl": f"/careers/job/{j}", "locations": ["Austin, TX"]} for j in jobs]}})
    return (scan, "acme", source, f"https://{source}.example", "EIGHTFOLD", "https://jobs.nvidia.com", None, 0, page, at, body)


def end_of(scan, rows, at):
    return (scan, None, None, None, "SCAN_END", None, None, 0, rows, at, None)


def test_first_batch_without_any_posting(spark, tmp_path):
    shell = ("s0", "acme", "page", "https://acme.example/p", "GENERIC_HTML", None, None, 0, 1, START, "<div id=app></div>")
    later = START + timedelta(hours=1)
    batches = [[shell, end_of("s0", 1, START)], [board_page("s1", 1, later, 1, 7), end_of("s1", 1, later)]]
    root = land_and_run(spark, tmp_path, "shell", batches)
    assert discovery_stream.current_snapshot(spark, root, 1).count() == 0
    assert [r.title for r in discovery_stream.current_snapshot(spark, root).collect()] == ["Data Intern 7"]


def test_scan_over_two_batches_equals_one(spark, tmp_path):
    five = timedelta(seconds=5)
    pages = [board_page("s", 1, START, 4, 1, 2), board_page("s", 2, START + five, 4, 3, 4)]
    other = board_page("s", 1, START + five, 1, 1, source="second")
    end = end_of("s", 3, START + five)
    whole = land_and_run(spark, tmp_path, "whole", [[*pages, other, end]])
    split = land_and_run(spark, tmp_path, "split", [[pages[0], end], [pages[1]], [other]])
    one, two = discovery_stream.current_snapshot(spark, whole), discovery_stream.current_snapshot(spark, split)
    assert as_state(one) == as_state(two) and one.count() == 4
    assert {r.last_seen_at for r in two.collect()} == {START}
    assert spark.read.parquet(f"{split}/late").count() == 0 and spark.read.parquet(f"{split}/incomplete").count() == 0
    found = {r.source_id: r.discovered_count for r in spark.read.parquet(f"{split}/source_results").collect()}
    assert found == {"eight": 4, "second": 1}
    done = spark.read.parquet(f"{split}/extracted").agg(F.min("batch")).first()[0]
    assert discovery_stream.current_snapshot(spark, split, done).count() == 0


def test_state_is_read_from_one_folder_however_long_the_history(spark, tmp_path):
    root = str(tmp_path / "long")
    for n in range(200):
        tables.append(spark.createDataFrame([("s", START)], discovery_stream.SCANS).coalesce(1), root, "last_scans", n) if n in (0, 198, 199) else None
    last = tables.read_version(spark, root, "last_scans", discovery_stream.SCANS, 199)
    assert len(last.inputFiles()) == 1


def test_pages_landed_twice_and_end_first(spark, tmp_path):
    one, two = board_page("s", 1, START, 4, 1, 2), board_page("s", 2, START, 4, 3, 4)
    whole = land_and_run(spark, tmp_path, "once", [[one, two, end_of("s", 2, START)]])
    again = land_and_run(spark, tmp_path, "with space", [[end_of("s", 2, START), one], [one, one], [two, one], [two]])
    assert as_state(discovery_stream.current_snapshot(spark, again)) == as_state(discovery_stream.current_snapshot(spark, whole))
    assert discovery_stream.current_snapshot(spark, again).count() == 4
    assert [r.discovered_count for r in spark.read.parquet(f"{again}/source_results").collect()] == [4]
    assert spark.read.parquet(f"{again}/changes").count() == 4
    assert spark.read.parquet(f"{again}/incomplete").count() == 0


def landed_files(spark, folder, files):
    """Each list of rows becomes one file that arrived at the given hour."""
    for n, (hour, rows) in enumerate(files):
        part = f"{folder}-parts/{n}"
        spark.createDataFrame(rows, LANDED).coalesce(1).write.parquet(part)
        (name,) = [x for x in os.listdir(part) if x.endswith(".parquet")]
        os.makedirs(folder, exist_ok=True)
        shutil.copyfile(f"{part}/{name}", f"{folder}/{n}.parquet")
        os.utime(f"{folder}/{n}.parquet", (1_700_000_000 + 3600 * hour,) * 2)


def test_scans_that_never_end_are_given_up_and_state_stays_flat(spark, tmp_path):
    folder = str(tmp_path / "arrivals")
    files = [(0, [board_page("never", 1, START, 9, 1), board_page("short", 1, START, 9, 1), end_of("short", 2, START)])]
    for n in range(50):
        rows = [board_page(f"s{n}", 1, START, 2, 1), board_page(f"s{n}", 2, START, 2, 2), end_of(f"s{n}", 2, START)]
        repeated = [board_page(f"s{n - 1}", 2, START, 2, 2)] if n else []
        files.append((n, rows + rows[:1] + repeated))
    files.append((60, [board_page("never", 2, START, 9, 2), end_of("z", 0, START)]))
    files.append((90, [end_of("zz", 0, START)]))
    landed_files(spark, folder, files)
    arrivals.use_state_store(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        stream = spark.readStream.schema(LANDED).option("maxFilesPerTrigger", 1).parquet(folder)
        found = arrivals.finished_scans(stream, "5 hours", F.col("_metadata.file_modification_time"))
        query = found.writeStream.format("parquet").option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start(f"{folder}-out")
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    rows = spark.read.schema(arrivals.FINISHED).parquet(f"{folder}-out").groupBy("scan_id", "status").count().collect()
    assert {(r.scan_id, r.status): r["count"] for r in rows} == {
        **{(f"s{n}", "complete"): 2 for n in range(50)}, ("short", "incomplete"): 1, ("never", "incomplete"): 2
    }
    sizes = [sum(o["numRowsTotal"] for o in json.loads(p.json)["stateOperators"]) for p in query.recentProgress]
    assert len(sizes) >= 50 and max(sizes[30:50]) <= max(sizes[12:30])


def test_results_of_a_scan_whose_pages_differ_in_time(spark):
    from rolewatch.plans import discovery

    five = timedelta(seconds=5)
    broken = board_page("s", 3, START, 6, 9, source="bad")[:-1] + ('{"error":"busy"}',)
    rows = [
        board_page("s", 1, START, 4, 1, 2), board_page("s", 2, START + five, 4, 3, 4), board_page("s", 1, START + five, 1, 1, source="second"),
        board_page("s", 1, START, 6, 11, 12, source="bad"), board_page("s", 2, START, 6, 13, 14, source="bad"), broken,
        board_page("t", 1, START + 2 * five, 1, 1),
    ]
    targets = spark.createDataFrame([("acme", [])], "id string, role_keywords array<string>")
    outcome = discovery.scan(spark.createDataFrame(rows, LANDED), targets)
    got = {(r.scan_id, r.source_id): (r.status, r.discovered_count) for r in outcome.results.collect()}
    assert got == {("s", "eight"): ("SUCCESS", 4), ("s", "second"): ("SUCCESS", 1), ("s", "bad"): ("FAILED", None), ("t", "eight"): ("SUCCESS", 1)}
    posts = outcome.postings.collect()
    assert len({(p.scan_id, p.company_id, p.canonical_url) for p in posts}) == len(posts) == 5
    assert {p.last_seen_at for p in posts if p.scan_id == "s"} == {START}
    assert "bad" not in {p.source_id for p in posts}


def test_many_landed_pages_are_all_kept_and_no_body_is_shuffled(spark):
    from rolewatch.plans import discovery

    rows = [board_page("s", n + 1, START, 1000, *range(10 * n, 10 * n + 10)) for n in range(100)]
    landed = spark.createDataFrame(rows, LANDED)
    targets = spark.createDataFrame([("acme", [])], "id string, role_keywords array<string>")
    found = discovery.extract(landed, targets)
    assert found.count() == 1000
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window" in line or "Join" in line:
            assert "body#" not in line
