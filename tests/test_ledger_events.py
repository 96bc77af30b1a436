from pyspark.sql import functions as F

from batchtally.functions import paths as P
from batchtally.functions import values as V
from batchtally.operators import events as E
from batchtally.operators import ledger as L


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first().v


def test_paths(spark):
    n = F.lit("/tmp/does_not_exist_1.root")
    assert one(spark, P.extension(n)) == "root"
    assert one(spark, P.basepath(n)) == "/tmp"
    assert one(spark, P.basepath(F.lit("x.root"))) == "."
    assert one(spark, P.basename(n)) == "does_not_exist_1.root"
    assert one(spark, P.basename_noext(n)) == "does_not_exist_1"
    assert one(spark, P.file_index(n)) == 1
    assert one(spark, P.file_index(F.lit("nodot_1"))) is None
    assert one(spark, P.file_index(F.lit("a_x.root"))) is None
    assert one(spark, P.dataset_slug(F.lit("/A/B-C/D"))) == "A_B-C_D"
    assert one(spark, P.join_basepath(F.lit("/a/"), F.lit("b"))) == "/a/b"
    assert one(spark, P.join_basepath(F.lit("/a"), F.lit("/b"))) == "/b"
    assert one(spark, P.strip_store_prefix(F.lit("/x/hadoop/cms/y"))) == "/x/y"
    assert one(spark, P.strip_store_prefix(F.lit("/x/hadoop/cms/y"), anchored=True)) == "/x/hadoop/cms/y"
    for raw, want in {
        "/a//b/./c/../d/": "/a/b/d", "//a": "//a", "///a": "/a", "": ".", "../x/..": "..", "/..": "/", "a/b": "a/b", "a/..": ".",
    }.items():
        assert one(spark, P.normpath(F.lit(raw))) == want, raw


def test_values(spark):
    assert one(spark, V.floor_to_history(F.lit(1001))) == 900
    assert one(spark, V.try_number(F.lit("1.5e3"))) == 1500.0
    assert one(spark, V.try_number(F.lit("05-11 08:40:12"))) is None
    assert one(spark, V.try_number(F.lit("1d"))) is None
    assert one(spark, V.round_half_up(F.lit(-2.5))) == -2
    assert one(spark, V.status_name(F.lit(1))) == "DONE"
    assert one(spark, V.status_name(F.lit(77))) is None


def test_existence_and_actions(spark):
    now = 1_000_000
    outs = spark.createDataFrame(
        [("t", i, f"o{i}", i in (1, 8)) for i in range(1, 9)], "task string, out_index int, name string, fake boolean"
    )
    listing = spark.createDataFrame([("o2",)], "name string")
    q = spark.createDataFrame(
        [
            ("t", 2, 20, "R", now - 100), ("t", 3, 30, "R", now - 24 * 3600), ("t", 4, 40, "R", now - 24 * 3600 - 1),
            ("t", 5, 50, "H", now - 5 * 3600 - 1), ("t", 6, 60, None, now - 900000), ("t", 7, 70, "U", now), ("t", 5, 51, "R", now),
        ],
        "task string, jobnum int, cluster_id bigint, status string, entered bigint",
    )
    rows = L.job_actions(L.with_queue(L.with_existence(outs, listing), q), now).collect()
    got = {r.out_index: (r.action, r.state, r.done) for r in rows}
    assert got == {
        1: ("none", None, True), 2: ("wait", "R", False), 3: ("wait", "R", False), 4: ("remove", "R", False),
        5: ("remove", "H", False), 6: ("wait", "I", False), 7: ("wait", "U", False), 8: ("none", None, True),
    }
    assert len(rows) == 8


def test_completion_variants(spark):
    outs = spark.createDataFrame([("a", True, True), ("a", True, False), ("b", True, True)], "dataset string, exists boolean, done boolean")
    units = spark.createDataFrame([("a",), ("b",), ("c",)], "dataset string")
    got = {r.dataset: r for r in L.completion(outs, units).collect()}
    assert (got["a"].queue_fraction, got["a"].queue_complete, got["a"].base_complete) == (0.5, False, True)
    assert got["b"].queue_complete and got["b"].move_complete
    c = got["c"]
    assert (c.queue_fraction, c.queue_complete, c.base_fraction, c.base_complete, c.move_fraction) == (0.0, False, 1.0, True, None)
    half = {r.dataset: r.queue_complete for r in L.completion(outs, units, min_fraction=0.5).collect()}
    assert half["a"]


def test_requirements(spark):
    tasks = spark.createDataFrame([("p", 1, "t1"), ("p", 2, "t2"), ("p", 3, "t3")], "path string, position int, task string")
    chain = L.chain_requirements(tasks)
    assert {(r.task, r.requires) for r in chain.collect()} == {("t1", None), ("t2", "t1"), ("t3", "t2")}
    edges = spark.createDataFrame([("t3", "t1"), ("t3", "t2")], "task string, requires string")
    for done1, done2 in ((False, False), (True, False), (True, True)):
        state = spark.createDataFrame([("t1", done1), ("t2", done2), ("t3", False)], "task string, complete boolean")
        r = {x.task: x for x in L.readiness(tasks, edges, state).collect()}
        assert r["t3"].satisfied == (done1 and done2) and r["t1"].satisfied
        assert r["t1"].ready == (not done1)
    got = L.path_status(tasks, state).first()
    assert (got.complete, got.n_tasks, got.n_complete) == (False, 3, 2)
    assert [r.complete for r in L.complete_list(tasks, state).orderBy("pos").collect()] == [True, True, False]


def test_attempts_and_summary(spark):
    att = spark.createDataFrame([("d", 1, 1, 11), ("d", 1, 2, 12), ("d", 2, 1, 21)], "dataset string, out_index int, attempt_no int, cluster_id bigint")
    sub = spark.createDataFrame([("d", 1, 99), ("d", 3, 31)], "dataset string, out_index int, cluster_id bigint")
    got = {(r.out_index, r.attempt_no): r.cluster_id for r in L.append_attempts(att, sub).collect()}
    assert got == {(1, 1): 11, (1, 2): 12, (2, 1): 21, (1, 3): 99, (3, 1): 31}
    outs = spark.createDataFrame([("d", 1), ("d", 2), ("d", 3)], "dataset string, out_index int")
    queue = spark.createDataFrame([(12, "R", 5), (-1, "R", 5)], "cluster_id bigint, status string, entered bigint")
    s = {r.out_index: r for r in L.task_summary(outs, att, queue).collect()}
    assert (s[1].last_cluster, s[1].is_on_queue, s[1].n_attempts, s[1].job_status) == (12, True, 2, "R")
    assert (s[3].last_cluster, s[3].is_on_queue, s[3].n_attempts) == (-1, False, 0)


def test_counts(spark):
    ev = spark.createDataFrame([("a", -1.0), ("a", 0.0), ("a", 2.0), ("b", 1.0)], "file string, weight double")
    c = E.event_counts(ev)
    assert {r.file: (r.n, r.n_negative, r.n_nonpositive) for r in c.collect()} == {"a": (3, 1, 2), "b": (1, 0, 0)}
    stored = spark.createDataFrame(
        [("a", None, 7), ("b", None, None), ("gone", 5, 2), ("empty", 4, None)], "file string, n bigint, n_negative bigint"
    )
    assert {r.file for r in E.lacking_counts(stored).collect()} == {"a", "b", "empty"}
    got = {r.file: (r.n, r.n_negative, r.n_nonpositive) for r in E.prefer_stored(stored, c).collect()}
    assert got == {"a": (3, 7, 2), "b": (1, 0, 0), "gone": (5, 2, None), "empty": (4, 0, 0)}
    m = spark.createDataFrame(
        [("a", 3, 9, False), ("x_Run2017B", 5, 4, False), ("f", 100, 10, True)],
        "name string, nevents bigint, nevents_negative bigint, fake boolean",
    )
    assert {r.name: r.neg for r in E.negative_events(m, c).collect()} == {"a": 1, "x_Run2017B": 0, "f": 10}
    assert [r.name for r in E.needs_scan(m).collect()] == ["a"]
    assert one(spark, E.positive_count(F.lit(100), F.lit(10))) == 90
    assert one(spark, E.effective_count(F.lit(100), F.lit(10))) == 80
    assert one(spark, E.effective_count(F.lit(100), F.lit(10), is_tree=False)) == -100


def test_skim_and_slices(spark):
    ev = spark.createDataFrame([(1, [1.0, 40.0]), (2, [50.0, 60.0]), (3, [])], "id int, pt array<double>")
    kept = E.skim(ev, [E.count_matching("pt", lambda x: x > 30) >= 1, E.count_matching("pt", lambda x: x > 30) <= 1], ["id"])
    assert [r.id for r in kept.collect()] == [1]
    rows = spark.createDataFrame([(1, 1.0), (1, 40.0), (2, 50.0), (2, 60.0)], "id int, pt double")
    assert [r.id for r in E.skim_rows(rows, ["id"], {"hard": (F.col("pt") > 30, 1, 1)}).collect()] == [1]
    flat = spark.range(25).withColumn("d", F.lit("d"))
    for first, count, want in ((-1, -1, list(range(25))), (0, 3, [0, 1, 2]), (4, 3, [3, 4, 5]), (24, 10, [23, 24])):
        for bound in (1000, 6):
            got = E.event_slice(flat, ["d"], ["id"], first, count, max_group_rows=bound)
            assert sorted(r.id for r in got.collect()) == want
    got = E.event_ranges_of(flat, ["d"], ["id"], 10).groupBy("range_no").count().collect()
    assert {(r.range_no, r["count"]) for r in got} == {(1, 10), (2, 10)}
    assert E.event_ranges_of(flat, [], ["id"], 10).count() == 20


def test_validation(spark):
    plan = spark.createDataFrame([(1, 5), (2, 5), (3, -1), (4, 5)], "out_index int, expected bigint")
    actual = spark.createDataFrame([(1, 5), (2, 4), (3, 9), (7, 1)], "out_index int, actual bigint")
    got = {r.out_index: (r.accepted, r.reason) for r in E.check_counts(plan, actual, ["out_index"]).collect()}
    assert got == {1: (True, ""), 2: (False, "count mismatch"), 3: (True, ""), 4: (False, "count mismatch"), 7: (False, "unplanned")}
    rec = spark.createDataFrame([(1, True), (1, False), (2, False), (3, None)], "out_index int, broken boolean")
    bad = E.bad_outputs(rec, ["out_index"], F.col("broken"))
    assert sorted(r.out_index for r in bad.collect()) == [1, 3]
    outs = spark.createDataFrame([(1, True), (2, True)], "out_index int, exists boolean")
    re = E.drop_rejected(outs, bad.withColumn("reason", F.lit("bad record")), ["out_index"])
    assert {r.out_index: r["exists"] for r in re.collect()} == {1: False, 2: True}
    files = spark.createDataFrame([("a",), ("b",)], "name string")
    assert [r.name for r in E.missing_files(files, files.filter("name = 'a'")).collect()] == ["b"]


def test_metadata_documents_come_in_parts(spark):
    outputs = [("a", i, 10 * i, i, i != 3) for i in range(1, 8)] + [("b", 1, 5, 0, False)]
    mapping = [("a", i, 2 - j, f"f{i}_{j}") for i in range(1, 8) for j in range(2)] + [("b", 1, 1, "g")]
    datasets = spark.createDataFrame([("a", False, 1, "t"), ("b", True, 99, "t"), ("c", False, 1, None)], "dataset string, open boolean, live_nevents bigint, tag string")
    docs = E.metadata_documents(
        spark.createDataFrame(outputs, "dataset string, out_index bigint, nevents bigint, neg bigint, done boolean"),
        spark.createDataFrame(mapping, "dataset string, out_index bigint, in_seq bigint, in_name string"),
        datasets, per_part=3,
    )
    got = {(r.dataset, r.part): r for r in docs.collect()}
    assert sorted(got) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("c", 0)]
    assert list(got["a", 0].ijob_to_miniaod.items()) == [("1", ["f1_1", "f1_0"]), ("2", ["f2_1", "f2_0"])]
    assert got["a", 1].ijob_to_nevents == {str(i): [10 * i, 8 * i] for i in (4, 5, 6)} and list(got["a", 2].ijob_to_nevents) == ["7"]
    assert all(got["a", p].nevents_merged == 250 and got["a", p].n_outputs == 6 and got["a", p].tag == "t" for p in range(3))
    assert (got["b", 0].nevents_das, got["b", 0].ijob_to_miniaod, got["c", 0].nevents_das) == (99, {}, 0)
