import numpy as np
import pytest
from pyspark.sql import functions as F

from batchtally.operators import logs as G
from batchtally.operators import telemetry as T

HEAD = '"usr","sys","read","writ","when","used","free","read","used","free","epoch"'
OUT = f"""
--- begin header output ---
NAME: first
hostname: node-7: blue
NAME: second
no colon here
--- end header output ---
outside: x
--- begin dstat output ---

"Host:","node-7.local",,,,"User:","u"
{HEAD}
8.0,0.5,40.0,1.0,05-11 08:40:12,300.0,2.0,3.0,4.0,6.0,700.0
6.0,0.25,50.0,2.0,05-11 08:40:42,310.0,2.0,3.5,4.5,6.0,730.0
9.0,oops,60.0,3.0,05-11 08:41:32,320.0,2.0,4.0,5.0,6.0,780.0

--- end dstat output ---
1,2,3
"""
ERR = """starting
----- Begin Fatal Exception at noon -----
An exception of category 'DiskFull' occurred while
   writing block 12
      [b] Fatal error: no space on volume seven
store://box/out.dat could not grow.
----- End Fatal Exception -----
----- Begin Fatal Exception again
An exception of category 'Later' occurred
----- End Fatal Exception
stopped
"""


@pytest.fixture(scope="module")
def logs(spark):
    return spark.createDataFrame([("a.out", OUT), ("b.out", "nothing here")], "log string, body string")


def test_header(logs):
    got = {r.key: r.val for r in G.header_args(logs).collect()}
    assert got == {"NAME": "second", "hostname": "node-7: blue"}


def test_sections_toggle(spark):
    body = "begin header output\nk: 1\nend header output\nk: 2\nbegin header output\nk: 3\nbegin dstat output\nk: 4"
    df = spark.createDataFrame([("x", body)], "log string, body string")
    lines = G.section_lines(df, "header", ["log"]).first()._lines
    assert lines == ["begin header output", "k: 1", "begin header output", "k: 3", "begin dstat output", "k: 4"]
    assert G.section_lines(df, "dstat", ["log"]).first()._lines == ["begin dstat output", "k: 4"]


def test_telemetry(logs):
    rows = G.telemetry(logs).collect()
    assert {r.metric for r in rows} == {"usr", "sys", "read", "writ", "when", "used", "free", "epoch"}
    assert len(rows) == 24
    by = {(r.metric, r.row_no): r for r in rows}
    assert [by[("read", i)].value for i in range(3)] == [40.0, 50.0, 60.0]
    assert by[("when", 0)].raw == "05-11 08:40:12" and by[("when", 0)].value is None and not by[("when", 0)].bad
    assert by[("sys", 2)].bad and by[("sys", 2)].value is None
    assert [by[("usr", i)].since_start for i in range(3)] == [0.0, 30.0, 80.0]
    cols = {r.metric: r.cells for r in G.telemetry_columns(logs).collect()}
    assert cols["used"] == ["300.0", "310.0", "320.0"] and len(cols) == 8


def test_short_row_cuts_columns(spark):
    body = 'begin dstat output\n"usr","sys","epoch"\n1,2,3\n4,5\n'
    df = spark.createDataFrame([("x.out", body)], "log string, body string")
    assert {r.metric for r in G.telemetry(df).collect()} == {"usr", "sys"}
    none = spark.createDataFrame([("x.out", 'begin dstat output\n"usr","sys"\n')], "log string, body string")
    assert G.telemetry(none).count() == 0 and G.telemetry_columns(none).count() == 0


def test_time_starts_at_the_first_readable_one(spark):
    body = 'begin dstat output\n"usr","epoch"\n1,n/a\n2,50\n3,65\n'
    tel = G.telemetry(spark.createDataFrame([("x.out", body)], "log string, body string"))
    assert sorted((r.row_no, r.since_start) for r in tel.filter("metric = 'usr' and since_start is not null").collect()) == [(1, 0.0), (2, 15.0)]
    assert sorted((r.x, r.y) for r in T.pair_metrics(tel, "epoch", "usr").collect()) == [(0.0, 2.0), (15.0, 3.0)]


def test_legacy(logs):
    rows = G.telemetry_legacy(logs.replace("oops", "9", subset=["body"])).collect()
    metrics = {}
    for r in sorted(rows, key=lambda r: (r.row_no, r.col_no)):
        metrics.setdefault(r.metric, []).append(r.value)
        assert r.host == "node-7.local"
    assert metrics["used_mem"][:2] == [300.0, 310.0] and metrics["used_swp"][:2] == [4.0, 4.5]
    assert metrics["read"][:4] == [40.0, 3.0, 50.0, 3.5]
    assert "when" not in metrics
    assert {(r.log, r.host, r.valid) for r in G.log_validity(logs).collect()} == {("a.out", "node-7.local", True), ("b.out", None, False)}


def test_errors(spark):
    df = spark.createDataFrame([("a", ERR), ("b", "fine"), ("c", None), ("d", ERR)], "log string, body string")
    got = {r.log: r.e for r in df.select("log", G.error_signature("body").alias("e")).collect()}
    assert got["a"] == "[DiskFull] [b] Fatal error: no space on volume seven, store://box/out.dat could not grow."
    assert got["b"] == "" and got["c"] == ""
    assert {(r.category, r.n) for r in G.error_counts(df).collect()} == {("DiskFull", 2), ("", 2)}
    long = "----- Begin Fatal Exception\nAn exception of category 'X'\n" + "y" * 500
    got = spark.createDataFrame([(long,)], "body string").select(G.error_signature("body").alias("e")).first().e
    assert got == ("[X] An exception of category 'X', " + "y" * 500)[: 4 + 300]
    one = spark.range(1).select(G.err_name_of(F.lit("/x/1e.5.0.out")).alias("a"), G.out_name_of(F.lit("/x/1e.5.0.err")).alias("b")).first()
    assert (one.a, one.b) == ("/x/1e.5.0.err", "/x/1e.5.0.out")


def test_request_name(spark):
    bodies = {"x\nSuccess: ok\nTask name: 170101_000000:u\nTask name: other": "170101_000000:u", "Success Task name: here": "here",
              "Success\n\nTask name: late": None, "Task name: none": None}
    df = spark.createDataFrame([(b, w) for b, w in bodies.items()], "body string, want string")
    for r in df.select("want", G.request_name("body").alias("got")).collect():
        assert r.got == r.want


def points(spark, seed=5):
    rnd = np.random.default_rng(seed)
    data = [("a" if i % 3 else "b", float(x), float(y)) for i, (x, y) in enumerate(zip(rnd.normal(5, 2, 500), rnd.integers(0, 9, 500)))]
    return data, spark.createDataFrame(data, "k string, x double, y double")


def test_histograms_match_numpy(spark):
    data, df = points(spark)
    x, y = np.array([r[1] for r in data]), np.array([r[2] for r in data])
    want, _ = np.histogram(x, 20)
    got = {r.bin: r.n for r in T.hist_1d(df, "x", 20).collect()}
    assert [got.get(i, 0) for i in range(20)] == want.tolist()
    for k in ("a", "b"):
        sel = np.array([r[1] for r in data if r[0] == k])
        got = {r.bin: r.n for r in T.hist_1d(df, "x", 7, ["k"]).filter(F.col("k") == k).collect()}
        assert [got.get(i, 0) for i in range(7)] == np.histogram(sel, 7)[0].tolist()
    want, _, _ = np.histogram2d(x / max(x.max(), 1), y * 0.5, bins=10)
    got = {(r.xbin, r.ybin): r.n for r in T.hist_2d(df, "x", "y", 10, scale_y=0.5).collect()}
    assert [[got.get((i, j), 0) for j in range(10)] for i in range(10)] == want.astype(int).tolist()
    flat = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert [(r.bin, r.n) for r in T.hist_1d(flat, "x", 10).collect()] == [(5, 2)]


def test_profile_and_mean(spark):
    data, df = points(spark)
    x, y = np.array([r[1] for r in data]), np.array([r[2] for r in data])
    edges = np.linspace(x.min(), x.max(), 6)
    which = np.clip(np.searchsorted(edges, x, side="right") - 1, 0, 4)
    for r in T.profile(df, "x", "y", 5).collect():
        mine = y[which == r.bin]
        assert r.n == len(mine) and r.mean == pytest.approx(mine.mean()) and r.spread == pytest.approx(mine.std())
        assert r.centre == pytest.approx((edges[r.bin] + edges[r.bin + 1]) / 2)
    zero = spark.createDataFrame([(-1.0, 2.0), (0.0, 4.0)], "x double, y double")
    assert sum(r.n for r in T.profile(zero, "x", "y", 2, norm_x=True).collect()) == 2
    assert T.mean(df, "y").first().mean == pytest.approx(y.mean())


def test_times_pairs_panels(spark, logs):
    tel = G.telemetry(logs)
    pairs = sorted((r.row_no, r.x, r.y) for r in T.pair_metrics(tel, "epoch", "usr").collect())
    assert pairs == [(0, 0.0, 8.0), (1, 30.0, 6.0), (2, 80.0, 9.0)]
    assert sorted(r.value for r in T.flatten_metric(tel, "sys").collect()) == [0.25, 0.5]
    samples = spark.createDataFrame([("l", 2, 12.0), ("l", 1, 10.0), ("l", 0, None), ("m", 1, None)], "log string, row_no int, epoch double")
    assert sorted((r.row_no, r.x) for r in T.zeroed_time(samples).collect()) == [(1, 0.0), (2, 2.0)]
    panels = T.panel_hists(tel.withColumn("dataset", F.lit("d"))).collect()
    totals = {}
    for r in panels:
        totals[r.metric] = totals.get(r.metric, 0) + r.n
    assert totals == {"usr": 3, "sys": 2, "read": 3, "writ": 3, "used": 3}
    x = np.array([0, 30, 80.0])
    want, _, _ = np.histogram2d(x / x.max(), np.array([8.0, 6.0, 9.0]), bins=50)
    got = {(r.xbin, r.ybin): r.n for r in panels if r.metric == "usr"}
    assert got == {(i, j): 1 for i, j in zip(*np.nonzero(want))}


def test_wide_table_keeps_first_of_repeated_names(spark):
    names = [  # fixed values: columns of the wide table
        "usr", "sys", "idl", "wai", "hiq", "siq", "read", "writ", "recv", "send", "in", "out", "int", "csw", "date/time",
        "1m", "5m", "15m", "used", "buff", "cach", "free", "read", "writ", "used", "free", "epoch",
    ]
    rows = [",".join("05-11 08:40:12" if n == "date/time" else str(100 * r + i) for i, n in enumerate(names)) for r in range(3)]
    body = "\n".join(["--- begin dstat output ---", ",".join(f'"{n}"' for n in names), *rows, "--- end dstat output ---"])
    df = spark.createDataFrame([("x.out", body)], "log string, body string")
    got = {r.metric: r.cells for r in G.telemetry_columns(df).collect()}
    assert len(names) == 27 and len(got) == 23
    for n, cells in got.items():
        first = names.index(n)
        assert cells == (["05-11 08:40:12"] * 3 if n == "date/time" else [str(100 * r + first) for r in range(3)])
