import json
import os

import pytest
from pyspark.sql import functions as F

from batchtally.operators import extend as U
from batchtally.operators import rollup as M
from batchtally.plans.published import current
from batchtally.plans.storage import fresh_path
from batchtally.sources import catalog as C
from batchtally.sources import files as S
from batchtally.sources import queue as Q


def test_rollup_and_totals(spark):
    outs = spark.createDataFrame(
        [("a", 1, 10, True, False), ("a", 2, 20, True, True), ("b", 1, 5, False, False)],
        "dataset string, out_index int, nevents bigint, output_exists boolean, is_on_queue boolean",
    )
    ds = spark.createDataFrame([("a", 25), ("b", 3), ("c", 0)], "dataset string, queried_nevents bigint")
    r = M.dataset_rollup(M.with_done(outs), ds)
    got = {x.dataset: (x.njobs_total, x.njobs_done, x.nevents_total, x.nevents_done, x.missing_events) for x in r.collect()}
    assert got == {"a": (2, 1, 25, 10, 15), "b": (1, 0, 3, 0, 3), "c": (0, 0, 0, 0, 0)}
    t = M.grand_totals(r).first()
    assert (t.nevents_total, t.nevents_done, t.njobs_total, t.njobs_running) == (28, 10, 3, 2)
    assert (t.pct_events, t.pct_jobs) == (35.71, 33.33)
    assert M.grand_totals(r.filter("dataset = 'c'")).first().pct_events is None
    assert [(x.dataset, x.label) for x in M.sort_datasets(r, "progress").collect()] == [("b", 0), ("c", 0), ("a", 50)]
    assert [x.dataset for x in M.sort_datasets(r).collect()] == ["a", "b", "c"]
    g = M.general_record(r).first()
    assert (g.status, g.type) == ("running", "CMSSW")
    assert {x.ts for x in M.history_points(r, 1_000_001).collect()} == {999_900}


def test_bad_jobs(spark):
    outs = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("a", 3, False)], "dataset string, out_index int, done boolean")
    mapping = spark.createDataFrame([("a", 2, 5), ("a", 2, 6), ("a", 3, 1)], "dataset string, out_index int, in_nevents bigint")
    att = spark.createDataFrame(
        [("a", 1, 1, 10), ("a", 1, 2, 11), ("a", 2, 1, 20), ("a", 2, 3, 22), ("a", 2, 4, 23), ("a", 3, 1, 30)],
        "dataset string, out_index int, attempt_no int, cluster_id bigint",
    )
    text = lambda kind: f"x\n----- Begin Fatal Exception now -----\nAn exception of category '{kind}' occurred while\nreading\n----- End Fatal Exception -----\n"
    logs = spark.createDataFrame([(20, "l20", text("A")), (22, "l22", text("B")), (23, "l23", text("C")), (99, "l99", text("D"))], "cluster_id bigint, log string, err string")
    got = M.bad_jobs(outs, mapping, att, logs).collect()
    assert [tuple(r)[:5] for r in got] == [("a", 2, 2, 2, 11)] and got[0].last_log == "l22" and got[0].last_error.startswith("[B]")
    # the text of a log that no failed attempt asks for is never looked into
    strict = F.when(F.col("cluster_id") == 22, F.col("err")).otherwise(F.raise_error(F.lit("read")).cast("string"))
    assert M.bad_jobs(outs, mapping, att, logs, body=strict).collect() == got


def test_histories(spark):
    schema = "dataset string, ts bigint, nevents_total bigint, nevents_done bigint, njobs_total bigint, njobs_done bigint"
    old = spark.createDataFrame([("a", 300, 1, 1, 1, 1), ("gone", 300, 9, 9, 9, 9)], schema)
    new = spark.createDataFrame([("a", 300, 2, 2, 2, 2), ("b", 600, 3, 3, 3, 3)], schema)
    m = M.merge_history(old, new)
    assert sorted((r.dataset, r.ts, r.njobs_total) for r in m.collect()) == [("a", 300, 1), ("a", 300, 2), ("b", 600, 3)]
    assert M.merge_history(old, new, keep=False).count() == 2
    assert [(r.ts, r.njobs_done, r.njobs_total) for r in M.chart_series(M.history_totals(m)).collect()] == [(300, 3, 3), (600, 3, 3)]
    assert sorted(r.dataset for r in M.carry_over(old, new).collect()) == ["a", "b", "gone"]
    a_old = spark.createDataFrame([("a", [1], [7])], "dataset string, timestamps array<bigint>, extra array<bigint>")
    a_new = spark.createDataFrame([("a", [2], [5]), ("b", [3], [6])], "dataset string, timestamps array<bigint>, njobs_done array<bigint>")
    got = {r.dataset: (r.timestamps, r.njobs_done) for r in M.merge_history_arrays(a_old, a_new).collect()}
    assert got == {"a": ([1, 2], [5]), "b": ([3], [6])}
    arr = spark.createDataFrame([("a", [1, 2], [5, 6])], "dataset string, timestamps array<bigint>, njobs_done array<bigint>")
    assert [(r.ts, r.njobs_done) for r in M.explode_history(arr, ["njobs_done"]).collect()] == [(1, 5), (2, 6)]
    s = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "dataset string, poll_ts bigint, v string")
    assert [(r.dataset, r.v) for r in M.latest_summaries(s).collect()] == [("a", "y")]


def test_grid_status(spark):
    jobs = spark.createDataFrame(
        [("t", 1, "idle", 1), ("t", 1, "finished", 2), ("t", 2, "odd", 3), ("t", 3, None, 4)], "task string, jobid int, status string, seq int"
    )
    b = M.status_breakdown(jobs).first().asDict()
    assert (b["idle"], b["finished"], b["running"], b["unknown"]) == (1, 1, 0, 2)
    assert {(r.jobid, r.status) for r in M.job_info(jobs).collect()} == {(1, "finished"), (2, "odd"), (3, "UNKNOWN")}
    polls = spark.createDataFrame([("t", 1, 1, None), ("t", 2, 2, "ok"), ("t", 3, 3, None), ("u", 1, 4, None)], "task string, poll_ts int, poll_id int, status string")
    for bound in (100, 2):
        got = {(r.task, r.poll_ts): r.shown for r in M.last_good_status(polls, max_group_rows=bound).collect()}
        assert got == {("t", 1): "UNKNOWN", ("t", 2): "ok", ("t", 3): "ok", ("u", 1): "UNKNOWN"}
    assert {(r.task, r.shown) for r in M.current_status(polls).collect()} == {("t", "ok"), ("u", "UNKNOWN")}
    r = M.minutes_since_submit(spark.createDataFrame([("700102_000000:u",)], "request string"), 86400 * 3 + 90).first()
    assert (r.minutes, r.elapsed) == (1.5, 2881.5)
    maps = spark.createDataFrame([({"a": 1, "b": 2},), ({"a": 3},)], "m map<string,int>")
    assert {(r.key, r.total) for r in M.sum_maps(maps, "m").collect()} == {("a", 4), ("b", 2)}
    types = spark.createDataFrame([("a", "BABY"), ("b", None), ("c", "CMSSW")], "dataset string, type string")
    assert sorted(r.dataset for r in M.visible_types(types).collect()) == ["b", "c"]


CATALOG = "dataset string, sample_type string, analysis string, tag string, status string, gtag string, location string, timestamp bigint, id int"


def test_catalog(spark):
    rows = [
        ("/A/b/C", "CMS3", "x", "v1", "valid", "g1", "/loc1/", None, 1), ("/A/b/C", "CMS3", "y", "v1", "valid", "g2", "/loc2", 5, 2),
        ("/A/b/C", "CMS3", "y", "v1", "invalid", "g3", "/loc3", 9, 3), ("/A/z/C", "BABY", "x", "v1", "valid", "g4", "/loc4", 1, 4),
        ("/A/z/C", "BABY", "y", "v2", "valid", "g5", "/loc5", 2, 5),
    ]
    cat = spark.createDataFrame(rows, CATALOG)
    assert [r.gtag for r in C.catalog_lookup(cat, "CMS3", tie="id", dataset="/A/b/C").collect()] == ["g2"]
    assert [r.gtag for r in C.catalog_lookup(cat, "BABY", tie="id", analysis="x").collect()] == ["g4"]
    assert C.catalog_lookup(cat, "BABY", tie="id", analysis="x", tag="v9").count() == 0
    with pytest.raises(ValueError):
        C.catalog_lookup(cat, "BABY", tie="id")
    named = cat.select("*", F.concat(F.lit("t"), F.col("id").cast("string")).alias("word")).withColumn("timestamp", F.lit(1))
    assert sorted(r.word for r in C.latest_records(named, ["dataset"], "word").collect()) == ["t1", "t4"]
    assert [r.id for r in C.sort_by_timestamp(cat, "id").collect()] == [3, 2, 5, 4, 1]
    assert [tuple(r) for r in C.catalog_search(cat, "/A/*/C", {"status": "valid", "tag": "v2"}, ["dataset", "gtag"]).collect()] == [("/A/z/C", "g5")]
    assert C.catalog_search(cat, "/A/?/C.").count() == 0
    listing = spark.createDataFrame([("/loc2/f1.root",), ("/loc2/sub/f2.root",), ("/loc1/f3.root",)], "path string")
    found = C.located_files(C.catalog_lookup(cat, "CMS3", tie="id"), listing)
    assert [(r.dataset, r.path) for r in found.collect()] == [("/A/b/C", "/loc2/f1.root")]
    assert C.located_files(C.catalog_lookup(cat, "CMS3", tie="id"), listing, "f?.txt").count() == 0

    files = spark.createDataFrame([("d", "f_10", "7", "1.5"), ("d", "f_2", "3", None)], "dataset string, name string, nevents string, size_gb string")
    m = C.catalog_manifest(files)
    assert sorted((r.seq, r.name, r.nevents) for r in m.collect()) == [(1, "f_10", 7), (2, "f_2", 3)]
    assert C.dataset_totals(m).first().nevents == 10
    ds = spark.createDataFrame([("a", "mine", ""), ("b", "", None), ("c", None, "r")], "dataset string, gtag string, release string")
    conf = spark.createDataFrame([("a", "ga", "ra"), ("b", "gb", "rb")], "dataset string, gtag string, release string")
    got = {r.dataset: (r.gtag, r.release) for r in C.fill_config(ds, conf).collect()}
    assert got == {"a": ("mine", "ra"), "b": ("gb", "rb"), "c": ("dummy_gtag", "r")}
    names = C.dataset_product(spark.createDataFrame([("MET",), ("EG",)], "primary string"), [("2017A", "v1"), ("2017A", "v2")], "/%s/Run%s-%s/X")
    assert sorted(r.dataset for r in names.collect())[0] == "/EG/Run2017A-v1/X" and names.count() == 4


def test_upsert_round_trip(spark):
    path = fresh_path(spark, "catalog")
    row = spark.createDataFrame([("/A/b/C", "CMS3", "v1", "/old", 1)], "dataset string, sample_type string, tag string, location string, id int")
    store = C.CatalogStore(path, "id")
    store.upsert(row, 100)
    store.upsert(row.withColumn("location", F.lit("/new")), 200)
    assert [r.location for r in store.read(spark).collect()] == ["/new"]


def test_payload_union(spark):
    a = spark.createDataFrame([("x", 1)], "name string, n int")
    b = spark.createDataFrame([("a much longer name", "k")], "name string, other string")
    u = C.payload_union(a, b)
    assert sorted(tuple(r) for r in u.select("name", "n", "other").collect()) == [("a much longer name", "", "k"), ("x", "1", "")]
    assert [r.name for r in C.sort_by_widest(u).collect()] == ["a much longer name", "x"]
    nested = spark.createDataFrame([([("f", 1)],)], "files array<struct<name:string,n:int>>")
    assert [tuple(r) for r in C.payload_files(nested).collect()] == [("f", 1)]


def test_listings(spark, tmp_path):
    root = tmp_path / "tasks"
    std = root / "T1" / "logs" / "std_logs"
    std.mkdir(parents=True)
    (std / "1e.5.0.out").write_text("hello\nworld")
    (std / "1e.5.0.err").write_text("bad")
    (root / "T1" / "logs" / "a.log").write_text("x")
    (root / "summary.json").write_text("{}")
    (root / "plots").mkdir()
    assert [r.path for r in S.log_listing(spark, str(root), ".out").collect()] == [str(std / "1e.5.0.out")]
    assert S.log_listing(spark, str(root), ".log").count() == 1
    logs = S.read_logs(spark, f"{root}/*/logs/std_logs", "*.out").collect()
    assert [(r.log, r.body) for r in logs] == [(str(std / "1e.5.0.out"), "hello\nworld")]
    m = S.dir_manifest(spark, "/d", str(std), "*.out").collect()
    assert [(r.dataset, r.nevents, r.name.endswith("1e.5.0.out")) for r in m] == [("/d", 0, True)]
    assert S.dir_manifest(spark, "/d", str(tmp_path / "nowhere")).count() == 0
    empty = tmp_path / "empty"
    empty.mkdir()
    assert S.dir_manifest(spark, "/d", str(empty)).count() == 0
    with pytest.raises(ValueError):
        S.dir_manifest(spark, "", "/x")
    att = spark.createDataFrame([("/u/area/tasks/T1/x.out",), (None,), ("/other/y.out",)], "logfile_out string")
    assert [r.log for r in S.log_paths(att, ".out", "area/tasks", "/new").collect()] == ["/new/T1/x.out"]


def test_summaries_and_snapshots(spark, tmp_path):
    path = str(tmp_path / "web")
    df = spark.createDataFrame([("a", {"z": 1, "b": None})], "name string, general struct<z:int,b:int>")
    S.write_summary(df, path)
    folder = current(spark, path)
    assert spark.read.text(folder).first().value == '{"general":{"b":null,"z":1},"name":"a"}'
    (tmp_path / "web" / os.path.basename(folder) / "part-x.json").write_text("{broken\n")
    assert S.read_summary(spark, path, "name string, general struct<b:int,z:int>").filter("name is not null").count() == 1
    assert S.read_summary(spark, str(tmp_path / "none"), "name string").count() == 0
    meta = str(tmp_path / "meta")
    S.write_metadata(spark.createDataFrame([("/A/b", 3)], "dataset string, n int"), meta)
    assert json.loads(spark.read.text(meta).first().value) == {"dataset": "/A/b", "n": 3}
    snap = str(tmp_path / "snap")
    saved = spark.createDataFrame([("t", 1, 2)], "task string, a int, b int")
    S.save_snapshot(saved, ["task"], ["a", "b"], snap)
    cur = spark.createDataFrame([("t", 3, 4), ("u", 5, 6)], "task string, a int, b int")
    got = S.overlay_snapshot(cur, S.read_snapshot(spark, snap, saved.schema), ["task"], ["a", "b"])
    assert sorted(tuple(r) for r in got.collect()) == [("t", 1, 2), ("u", 5, 6)]
    doc = {"d": {"queried_nevents": 9, "open_dataset": False, "jobs": {"3": {
        "output": ["/o/x_3.root", 12], "output_exists": True, "inputs": [["i1", 5], ["i2", 7.0]], "is_on_condor": False,
        "condor_jobs": [{"cluster_id": 8, "logfile_err": "e", "logfile_out": "o"}], "current_job": {"JobStatus": "R", "HoldReason": None}}, "4": {}},
        "cmssw_version": "R9", "executable": "x.sh", "pset": "p.py", "note": {"b": [1, "x"]}}, "empty": {"jobs": {}}, "odd": 3}
    (tmp_path / "summary.json").write_text(json.dumps(doc, indent=2))
    rows = {x.out_index: x for x in S.read_task_summaries(spark, str(tmp_path / "summary.json")).collect()}
    assert sorted(rows) == [3, 4] and rows[4].output_exists is None and rows[4].inputs is None
    r = rows[3]
    assert (r.cmssw_version, r.executable, r.global_tag, r.out_name) == ("R9", "x.sh", None, "/o/x_3.root")
    assert r.current_job == {"JobStatus": "R", "HoldReason": None} and r.extra == {"pset": "p.py", "note": '{"b":[1,"x"]}'}
    assert S.task_summary_rows(spark.createDataFrame([("{broken",), (None,), ("[]",), ("{}",)], "value string")).count() == 0
    assert (r.dataset, r.out_index, r.nevents, r.output_exists, r.queried_nevents) == ("d", 3, 12, True, 9)
    assert [(x.name, x.nevents) for x in r.inputs] == [("i1", 5), ("i2", 7)] and r.attempts[0].cluster_id == 8


def test_queue_snapshot(spark):
    def line(cid, code, task="t", num="1"):
        return "\t".join([cid, code, "100", "c", "a", "o", "e", "why", task, num])

    text = [line("5", "2"), line("6", "3"), line("7", "9"), line("8", "x"), "too\tshort", line("9", "5", "u", "2")]
    df = spark.createDataFrame([(x,) for x in text], "value string")
    rows = Q.queue_snapshot(df, extra=["taskname", "jobnum"])
    assert {(r.ClusterId, r.JobStatus) for r in rows.collect()} == {("5", "R"), ("7", "U"), ("8", "U"), ("9", "H")}
    assert Q.queue_snapshot(df, extra=["taskname", "jobnum"], equals={"taskname": "u"}).count() == 1
    assert Q.queue_snapshot(df, extra=["taskname", "jobnum"], cluster_id=5).count() == 1
    t = Q.typed_queue(rows).filter("task = 'u'").first()
    assert (t.jobnum, t.cluster_id, t.status, t.entered) == (2, 9, "H", 100)


def test_catalog_store_touches_its_buckets_only(spark):
    store = C.CatalogStore(fresh_path(spark, "catalog"), "id", buckets=8, deltas=3)
    schema = "dataset string, sample_type string, tag string, value bigint, id bigint"
    rows = [(f"/d{i}", "T", f"t{i % 3}", 0, i) for i in range(40)]
    store.upsert(spark.createDataFrame(rows, schema), 1)
    want = {r[:3]: (0, 1) for r in rows}
    first, _ = store._folders(spark)
    assert len(first) > 4
    for now in range(2, 9):  # one dataset again and again: its bucket is rewritten, the others stay
        store.upsert(spark.createDataFrame([("/d7", "T", "t1", now, 7), ("/d7", "T", f"n{now}", now, 7)], schema), now)
        want |= {("/d7", "T", "t1"): (now, now), ("/d7", "T", f"n{now}"): (now, now)}
    held, _ = store._folders(spark)
    changed = [b for b in held if held[b] != first[b]]
    assert len(changed) == 1 and len(held[changed[0]]) <= 3
    key = lambda r: (r.dataset, r.sample_type, r.tag)
    assert {key(r): (r.value, r.timestamp) for r in store.read(spark).collect()} == want
    found = store.lookup(spark, "/d7")
    assert {key(r): (r.value, r.timestamp) for r in found.collect()} == {k: v for k, v in want.items() if k[0] == "/d7"}
    assert all(f"_bucket={changed[0]}/" in f for f in found.inputFiles())
    assert store.lookup(spark, "/none").count() == 0


def test_a_failed_upsert_leaves_the_catalog(spark, monkeypatch):
    store = C.CatalogStore(fresh_path(spark, "catalog"), "id", buckets=4, deltas=1)
    schema = "dataset string, sample_type string, tag string, id bigint"
    row = lambda i: spark.createDataFrame([("/a", "T", f"t{i}", i)], schema)
    store.upsert(row(1), 1)

    def stop(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(C, "write_pointer", stop)
        with pytest.raises(RuntimeError):
            store.upsert(row(2), 2)
    assert [r.tag for r in store.read(spark).collect()] == ["t1"]
    store.upsert(row(2), 2)
    assert sorted(r.tag for r in store.read(spark).collect()) == ["t1", "t2"]


def test_a_failed_write_leaves_the_old_version(spark):
    """Readers see a whole version at every moment, and one more version stays for those that have begun."""
    schema = "task string, a int"
    for write, read in (
        (lambda df, p: S.write_summary(df, p), lambda p: S.read_summary(spark, p, schema)),
        (lambda df, p: S.save_snapshot(df, ["task"], ["a"], p), lambda p: S.read_snapshot(spark, p, schema)),
    ):
        path = fresh_path(spark, "sink")
        version = lambda i: spark.createDataFrame([("t", i)], schema)
        fails = spark.range(4, numPartitions=4).selectExpr("'t' as task", "if(id = 3, cast(raise_error('lost') as int), 9) as a")
        assert read(path).count() == 0
        with pytest.raises(Exception, match="lost"):
            write(fails, path)
        assert read(path).count() == 0
        write(version(1), path)
        begun = read(path)
        with pytest.raises(Exception, match="lost"):
            write(fails, path)
        assert [r.a for r in read(path).collect()] == [1]
        write(version(2), path)
        assert [r.a for r in begun.collect()] == [1] and [r.a for r in read(path).collect()] == [2]
        write(version(3), path)
        assert [r.a for r in read(path).collect()] == [3]


def test_user_code(spark):
    df = spark.range(20).selectExpr("'d' as dataset", "id % 3 as out_index", "id")

    def total(key, batches):
        import pandas as pd

        yield pd.DataFrame({"out_index": [key[1]], "total": [sum(int(b.id.sum()) for b in batches)]})

    got = {r.out_index: r.total for r in U.process_chunks(df, total, "out_index long, total long").collect()}
    assert got == {i: sum(x for x in range(20) if x % 3 == i) for i in range(3)}


def test_user_aggregate_of_a_huge_chunk(spark):
    """One output of many rows is worked on by several tasks and gives what one task gives."""
    df = spark.range(0, 30_000, 1, 6).selectExpr("if(id < 20, null, 'd') as dataset", "if(id % 100 = 0, 2, 1) as out_index", "id % 997 as v")
    tasks = spark.sparkContext.accumulator(0)

    def lift(frame):
        tasks.add(1)
        return {"n": len(frame), "best": int(frame["v"].max()), "text": str(frame["v"].min())}

    def merge(states):
        return {"n": int(states["n"].sum()), "best": int(states["best"].max()), "text": str(states["text"].astype(int).min())}

    aggregate = U.ChunkAggregate("n bigint, best bigint, text string", lift, merge)
    row = lambda r: (r.dataset, r.out_index, r.n, r.best, r.text)
    many = sorted(map(row, U.aggregate_chunks(df, aggregate).collect()), key=str)
    assert tasks.value >= 12  # six tasks, two chunks each at least
    assert many == sorted(map(row, U.aggregate_chunks(df.coalesce(1), aggregate, lanes=1).collect()), key=str)
    want = df.groupBy("dataset", "out_index").agg(F.count("*").alias("n"), F.max("v").alias("best"), F.min("v").cast("string").alias("text"))
    assert many == sorted(map(row, want.collect()), key=str)
    assert U.aggregate_chunks(df.limit(0), aggregate).count() == 0


def test_user_aggregate_of_scattered_records(spark):
    """Every task holds some records of every chunk, but the user's code runs about once a chunk, and nulls are a key."""
    df = spark.range(0, 6000, 1, 6).selectExpr("if(id % 5 = 0, null, 'd') as dataset", "if(id % 7 = 0, null, id % 300) as out_index", "id as v")
    lifts = spark.sparkContext.accumulator(0)

    def lift(frame):
        lifts.add(1)
        return {"n": len(frame), "top": int(frame["v"].max())}

    aggregate = U.ChunkAggregate("n bigint, top bigint", lift, lambda s: {"n": int(s["n"].sum()), "top": int(s["top"].max())})
    row = lambda r: (r.dataset, r.out_index, r.n, r.top)
    got = sorted(map(row, U.aggregate_chunks(df, aggregate, scattered=True).collect()), key=str)
    want = df.groupBy("dataset", "out_index").agg(F.count("*").alias("n"), F.max("v").alias("top")).collect()
    assert got == sorted(map(row, want), key=str) and len(got) > 300
    assert lifts.value <= 1.2 * len(got)  # six times as many where the records lie
    again = sorted(map(row, U.aggregate_chunks(df, aggregate).collect()), key=str)
    assert again == got


def test_extra_members_of_summaries(spark):
    """Members without a column keep their text, whatever their kind, and the jobs are not turned into text."""
    doc = '{"d": {"jobs": {"1": {"output": ["x", 1]}}, "tag": "t", "a": "say \\"x\\"", "b": 1.50, "c": null, "e": [1, {"f": "g h"}], "h": true, "i": 12345678901234567890, "j": {}}}'
    rows = S.task_summary_rows(spark.createDataFrame([(doc,)], "value string"))
    assert "from_json" not in rows._jdf.queryExecution().optimizedPlan().toString()
    old = F.from_json(F.to_json(F.parse_json(F.get_json_object("value", "$.d"))), "map<string,string>")
    want = spark.createDataFrame([(doc,)], "value string").select(old.alias("m")).first().m
    assert rows.first().extra == {k: v for k, v in want.items() if k not in ("jobs", "tag")}


def test_record_defaults(spark):
    rows = spark.createDataFrame([(1, None, "old", None, "invalid"), (2, "new", "old", ["s"], None)], "id int, tag string, cms3tag string, siblings array<string>, status string")
    one, two = C.with_record_defaults(rows).orderBy("id").collect()
    assert (one.tag, one.siblings, one.status, one.version, one.filter_name, one.files, one.comments) == ("old", [], "invalid", "v1.0", "NoFilter", [], "")
    assert (two.tag, two.siblings, two.status, two.analysis, two.twiki_name, two.assigned_to) == ("new", ["s"], "valid", "", "", "")
