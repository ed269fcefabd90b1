"""Resolution, reads, replay, layout, store, sources and streaming against plain Python replays."""

import random
import struct

import pytest

from tidemark.dsl import Shell
from tidemark.functions import bloom
from tidemark.operators import layout, reads, replay, resolve
from tidemark.plans.catalog import CATALOG
from tidemark.sources import commands, runs, workload
from tidemark.store import Store
from tidemark.streaming import latest as streaming

LOG = "seq long, key int, value int, tombstone boolean"


def random_log(n, keys, seed):
    rng = random.Random(seed)
    return [(i, rng.randint(-keys, keys), rng.randint(-999, 999), rng.random() < 0.3) for i in range(n)]


def replayed(rows):
    state = {}
    for _, k, v, dead in sorted(rows):
        state.pop(k, None) if dead else state.__setitem__(k, v)
    return state


def pairs(df):
    return {r["key"]: r["value"] for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    return random_log(2000, 60, 1)


@pytest.fixture(scope="module")
def log(spark, rows):
    return spark.createDataFrame(random.Random(2).sample(rows, len(rows)), LOG).repartition(3)


def test_resolution(log, rows):
    assert pairs(resolve.live(log)) == replayed(rows)
    assert pairs(resolve.as_of(log, 700)) == replayed([r for r in rows if r[0] <= 700])
    dead = {r["key"] for r in resolve.deleted(log).collect()}
    assert dead == {r[1] for r in rows} - set(replayed(rows))
    assert resolve.live(log.where("false")).count() == 0


def test_point_predicate_reaches_the_scan(spark, log, tmp_path):
    log.write.parquet(f"file://{tmp_path}/log")
    plan = reads.get(spark.read.parquet(f"file://{tmp_path}/log"), 5)._jdf.queryExecution().toString()
    assert "EqualTo(key,5)" in plan and "SortAggregate" not in plan


def test_reads(spark, log, rows):
    state = replayed(rows)
    wanted = spark.createDataFrame([(k,) for k in range(-80, 80, 7)], "key int")
    assert pairs(reads.multi_get(log, wanted)) == {k: state.get(k) for k in range(-80, 80, 7)}
    for low, high, open_ in ((-10, 10, False), (-10, 10, True), (10, -10, False), (-999, 999, False), (3, 3, False)):
        want = {k: v for k, v in state.items() if low <= k and (k < high if open_ else k <= high)}
        assert pairs(reads.range_pairs(log, low, high, open_)) == want
        assert reads.range_count(log, low, high, open_).first()["size"] == len(want)
    rng = random.Random(7)
    asked = [(i, rng.randint(-90, 90), rng.randint(-90, 90)) for i in range(60)] + [(60, -10**6, 10**6), (61, 500, 600), (62, -600, -500)]
    got = {r["range_id"]: r["size"] for r in reads.multi_range_counts(log, spark.createDataFrame(asked, "range_id int, low int, high int"), buckets=9).collect()}
    assert got == {i: sum(a <= k <= b for k in state) for i, a, b in asked}


def test_numbering_is_gapless(spark):
    df = spark.createDataFrame([(i * i,) for i in range(300)], "x long").repartition(5)
    assert [r["n"] for r in reads.numbered(df, "x", "n", buckets=17).orderBy("x").collect()] == list(range(300))


def test_replay(spark):
    rng = random.Random(3)
    ops = [(i, rng.choice("ppgd"), rng.randint(0, 30), rng.randint(0, 99)) for i in range(1500)]
    state, want = {}, {}
    for seq, op, k, v in ops:
        if op == "p":
            want[seq], state[k] = ("put", v), v
        elif op == "g":
            want[seq] = ("hit", state[k]) if k in state else ("miss", None)
        else:
            want[seq] = ("effective" if k in state else "noop", None)
            state.pop(k, None)
    df = spark.createDataFrame(ops, "seq long, op string, key int, value int")
    assert {r["seq"]: (r["outcome"], r["value"]) for r in replay.replay(df).collect()} == want


def test_range_counts_as_of(spark, log, rows):
    asked = [(s, a, a + w) for s, a, w in ((10, -20, 40), (500, -60, 120), (1999, 0, 0), (0, -60, 120), (900, 5, -3), (5000, -60, 120), (77, -(2**31), 2**32 - 1), (1200, -5, 70))]
    got = {r["seq"]: r["size"] for r in replay.range_counts(log, spark.createDataFrame(asked, "seq long, low long, high long"), buckets=7).collect()}
    assert got == {s: sum(a <= k <= b for k in replayed([r for r in rows if r[0] <= s])) for s, a, b in asked}


def test_positional_zip(spark):
    ops = [(0, "p", 9, 1), (1, "g", 5, None), (2, "p", 8, 2), (3, "g", 6, None), (4, "p", 7, 3), (5, "d", 1, None)]
    got = sorted(tuple(r) for r in replay.positional_zip(spark.createDataFrame(ops, "seq long, op string, key int, value int")).collect())
    assert got == [(0, "p", 5, 1), (2, "p", 6, 2), (4, "p", 7, 3), (5, "d", 1, None)]


@pytest.mark.parametrize("n", [0, 9, 10, 99, 100, 260, 1270])
def test_layout_follows_synchronous_merges(spark, n):
    levels, batches = {i: [] for i in range(1, 5)}, []
    for f in range(n // 10):
        levels[1].append([f])
        for level in range(1, 4):
            if len(levels[level]) == 5:
                levels[level + 1].append(sum(levels[level], []))
                levels[level] = []
    for level, runs in levels.items():
        batches += [(f, level) for run in runs for f in run]
    df = spark.createDataFrame([(i, i % 7, i, False) for i in range(n)], LOG)
    got = layout.placed(df, capacity=10, ratio=5, levels=4).where("level > 0").select("batch", "level").distinct().collect()
    assert {tuple(r) for r in got} == set(batches)


def test_exact_fences_of_many_parts(spark):
    rng = random.Random(21)
    rows = [(1, r, k, rng.choice([None, 5, 10**6]), rng.random() < 0.3) for r in range(3) for k in sorted(rng.sample(range(-(10**5), 10**5), 400))]
    df = spark.createDataFrame(rows, "level int, run long, key int, value int, tombstone boolean")
    for block in (1, 60, 1024, 10**6):
        want, since, at = set(), 0, None
        for level, run, k, v, t in rows:
            if run != at or since >= block:
                want.add((level, run, k))
                since, at = 0, run
            since += len(f"{k} {'' if v is None else v} {int(t)}") + 1
        assert {tuple(r) for r in layout.fences(df, block, buckets=9).collect()} == want


def test_exact_fences_restart_their_sum(spark):
    keys = [(1, 0, k, 10**6, False) for k in range(1000, 1400)]
    size = len("1000 1000000 0") + 1
    got = [r["key"] for r in layout.fences(spark.createDataFrame(keys, "level int, run long, key int, value int, tombstone boolean")).orderBy("key").collect()]
    step = -(-1024 // size)
    assert got == list(range(1000, 1400, step))


def test_bloom_has_no_false_negatives(spark):
    assert bloom.size_of(333) == (3192, 7) and bloom.size_of(1665) == (15960, 7)
    rng = random.Random(5)
    keys = [-(2**31), 2**31 - 1, 0, *(rng.randint(-(2**31), 2**31 - 1) for _ in range(300))]
    bits, probes = bloom.size_of(333)

    def positions(k):
        h2 = struct.unpack("<i", struct.pack("<I", k * 2654435769 & 0xFFFFFFFF))[0]
        return [((k + i * h2) & (1 << 64) - 1) % bits for i in range(probes)]

    df = spark.createDataFrame([(k,) for k in keys], "key int")
    assert {r["bit"] for r in bloom.build(df, 333).collect()} == {p for k in keys for p in positions(k)}
    others = spark.createDataFrame([(k,) for k in range(10**6, 10**6 + 2000)], "key int")
    built = bloom.build(df, 333)
    assert bloom.may_contain(df, built, 333).where("not maybe").count() == 0
    assert bloom.may_contain(others, built, 333).where("maybe").count() < 60
    assert bloom.may_contain(others, built.where("false"), 333).where("maybe").count() == 0


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("p 1 10", ("p", 1, 10, None)),
        ("p1 20", ("p", 1, 20, None)),
        ("p 12", ("p", 12, None, commands.USAGE["p"])),
        ("p 12-3", ("p", 12, -3, None)),
        ("p 2 2.5", ("p", 2, 2, None)),
        ("p 1 2 junk", ("p", 1, 2, None)),
        ("put 3 4", ("p", None, None, commands.USAGE["p"])),
        ("p 99999999999 1", ("p", None, 1, commands.USAGE["p"])),
        ("x 1", ("x", 1, None, "Unknown command: x")),
        ("   ", ("", None, None, "Error: Invalid command format.")),
        ("  # note", ("#", None, None, "Unknown command: #")),
        ("s", ("s", None, None, None)),
    ],
)
def test_command_grammar(spark, line, want):
    r = commands.parse(spark.createDataFrame([(line,)], "line string")).first()
    assert (r["op"], r["a"], r["b"], r["error"]) == want


def test_skipped_lines_long_form_and_files(spark, tmp_path):
    assert commands.parse(spark.createDataFrame([("",), ("# p 1 2",)], "line string")).count() == 0
    got = commands.parse_long(spark.createDataFrame([("PUT 1 2",), ("GET 3",), ("DELETE 4",), ("RANGE -5 6",), ("p 1 2",)], "line string")).collect()
    assert [(r["op"], r["a"], r["b"]) for r in got] == [("p", 1, 2), ("g", 3, None), ("d", 4, None), ("r", -5, 6), (None, None, None)]
    (tmp_path / "x.txt").write_text("p 1 2\ng 1\n")
    assert [tuple(r) for r in commands.read_lines(spark, f"file://{tmp_path}/x.txt").orderBy("seq").collect()] == [(0, "p 1 2"), (1, "g 1")]
    (tmp_path / "x.dat").write_bytes(struct.pack("<4i", 7, -8, 2**31 - 1, 0))
    assert [tuple(r)[1:] for r in commands.read_pairs(spark, f"file://{tmp_path}/x.dat").orderBy("at").collect()] == [(0, 7, -8), (1, 2**31 - 1, 0)]


def test_workload(spark):
    w = workload.Workload(puts=200, gets=100, ranges=20, deletes=30, miss=0.0, skew=0.5, gaussian=True)
    ops = workload.generate(spark, w).orderBy("seq").collect()
    assert [r["seq"] for r in ops] == list(range(350)) and ops[0]["op"] == "p"
    keys, asked, again = set(), set(), 0
    for r in ops:  # gets and deletes take keys of the puts before them
        assert r["op"] not in "gd" or r["a"] in keys
        again += r["op"] == "g" and r["a"] in asked
        (keys if r["op"] == "p" else asked if r["op"] == "g" else set()).add(r["a"])
    assert again > 30 and all(r["a"] <= r["b"] for r in ops if r["op"] == "r")
    assert ops == workload.generate(spark, w).orderBy("seq").collect()
    with pytest.raises(ValueError, match="put"):
        workload.Workload(puts=0)


def put(store, spark, rows):
    store.put(spark.createDataFrame(rows, LOG))


def test_deleted_key_stays_deleted_through_merges(spark, tmp_path):
    """A tombstone merged above an older run of its key has to stay: the key must not come back."""
    store = Store(spark, f"file://{tmp_path}/s", ratio=2, levels=4)
    batches = [[(0, 7, 1, False)], [(1, 8, 1, False)], [(2, 7, 0, True)], [(3, 9, 1, False)]]
    for b in batches:
        put(store, spark, b)
    assert store.get(7) is None and pairs(store.live()) == {8: 1, 9: 1}


def test_store_equals_replay_after_each_batch_and_restart(spark, tmp_path):
    rows = random_log(240, 15, 9)
    path = f"file://{tmp_path}/s"
    for i in range(0, 240, 40):
        store = Store(spark, path, ratio=3, levels=3)  # opened anew each time
        put(store, spark, rows[i : i + 40])
        want = replayed(rows[: i + 40])
        assert pairs(store.live()) == want
        assert [r["key"] for r in store.range(-5, 5).collect()] == sorted(k for k in want if -5 <= k <= 5)
    assert store.stats()["logical_pairs"] == len(want) and store.get(10**6) is None
    assert all(r["min_key"] <= r["max_key"] for r in store.manifest()["runs"])
    store.cleanup()
    assert store.live() is None
    put(store, spark, [(999, 1, 2, False)])
    assert store.get(1) == 2


def test_text_runs_are_ordered_by_number(spark, tmp_path):
    files = {"L1/run_9.txt": "1 10 0\n2 20 0\n", "L1/run_10.txt": "1 11 0\n3 0 1\n", "L2/run_8.txt": "3 30 0\n4 40 0\nbroken\n", "L1/other.txt": "9 9 0\n"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = runs.read_runs(spark, f"file://{tmp_path}")
    assert pairs(resolve.live(got)) == {1: 11, 2: 20, 4: 40}
    assert [tuple(r) for r in runs.run_metadata(got).collect()] == [(1, 10, 1, 3, 2), (1, 9, 1, 2, 2), (2, 8, 3, 4, 2)]
    assert [r["value"] for r in runs.to_lines(got.where("run = 10")).collect()] == ["1 11 0", "3 0 1"]


def test_runs_of_tombstones_only_leave_no_run(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", ratio=2, levels=3)
    put(store, spark, [(0, 1, 0, True)])
    put(store, spark, [(1, 1, 0, True)])
    assert store.manifest()["runs"] == []


def test_shell(spark, tmp_path):
    (tmp_path / "load.txt").write_text("p 5 50\nd 1\n")
    lines = ["p 1 10", "# x", "g 1", "g 2", "d 2", "p 1 11", "g 1", "r 0 9", f"l {tmp_path}/load.txt", "r 5 1", "r 0 9", "q", "c", "g 5"]
    got = Shell(spark, f"file://{tmp_path}/s").run(lines)
    assert got == ["OK", "10", "", "OK", "OK", "11", "Range (0 to 9):  SIZE: 1", "OK", "OK", "Range (5 to 1):  SIZE: 0", "Range (0 to 9):  SIZE: 1", "Unknown command: q", "Cleanup initiated.", ""]


def test_shell_reads_what_is_not_flushed(spark, tmp_path):
    (tmp_path / "a.txt").write_text("p 1 5\nl a.txt\n")
    shell = Shell(spark, f"file://{tmp_path}/s", capacity=3)
    assert shell.run(["p 1 1", "p 2 2", "d 1", "g 1", "g 2", "s"]) == ["OK", "OK", "OK", "", "2", "logical_pairs: 1", *[f"LVL{i}: 0" for i in range(1, 11)], "2:2:M"]
    assert shell.store.manifest()["version"] == 0  # two keys are held, so nothing was written
    got = shell.run(["p 3 3", "p 1 9", "d 2", "g 1", "g 2", "g 3", "r 0 9", "s"])
    assert got[:7] == ["OK", "OK", "OK", "9", "", "3", "Range (0 to 9):  SIZE: 2"] and got[-2:] == ["1:9:M", "3:3:L1"]
    assert shell.run([f"l {tmp_path}/a.txt", f"l {tmp_path}/a.txt 33", "l", f"l {tmp_path}/none.txt", "g 1"]) == ["OK", "Error: A loaded file cannot load files.", "Error: The number of threads must be from 1 to 32.", "Error: Invalid load format.", f"Error: No such file: {tmp_path}/none.txt", "5"]
    assert len(shell.loads) == 1


def test_store_reads_survive_merges_until_vacuum(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", ratio=2, levels=4)
    put(store, spark, [(0, 1, 1, False)])
    before = store.live()
    for i in range(1, 6):
        put(store, spark, [(i, i % 3, i, False)])
    assert pairs(before) == {1: 1} and pairs(store.live()) == {0: 3, 1: 4, 2: 5}
    assert store.vacuum(keep=100) == 0 and store.vacuum() > 3 and store.vacuum() == 0
    assert pairs(store.live()) == {0: 3, 1: 4, 2: 5}


def test_store_keys_of_any_type(spark, tmp_path):
    from datetime import date, datetime
    from decimal import Decimal

    for kind, keys in (("date", [date(2020, 1, i) for i in (1, 5, 9)]), ("timestamp_ntz", [datetime(2020, 1, i, 3) for i in (1, 5, 9)]), ("decimal(9,2)", [Decimal("1.50"), Decimal("2.25"), Decimal("9.00")]), ("string", ["a", "b", "é"]), ("binary", [b"a", b"b", b"\xff"])):
        store = Store(spark, f"file://{tmp_path}/{kind[:4]}", ratio=5)
        store.put(spark.createDataFrame([(i, k, i, False) for i, k in enumerate(keys)], f"seq long, key {kind}, value int, tombstone boolean"))
        run = Store(spark, store.path).manifest()["runs"][0]
        assert (run["min_key"], run["max_key"]) == (keys[0], keys[2])
        assert store.get(keys[1]) == 1 and [r["value"] for r in store.range(keys[1], keys[2]).collect()] == [1, 2]


def test_command_stream_of_many_clients(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / f"in/{i}.txt").write_text(f"p {i} {i}0\ng {i}\nd {i}\ng {i}\np {i} {i}1")
    said, shell = [], Shell(spark, f"file://{tmp_path}/s")
    lines = streaming.command_stream(spark, f"file://{tmp_path}/in", files_per_trigger=1)
    streaming.answer_stream(lines, shell, f"file://{tmp_path}/c", said.extend).awaitTermination()
    assert sorted(said) == sorted(["OK", "0", "OK", "", "OK", "OK", "10", "OK", "", "OK", "OK", "20", "OK", "", "OK"])
    assert {k: w[2] for k, w in shell.held.items()} == {0: 1, 1: 11, 2: 21}


def test_stream_in_any_order_and_restart(spark, tmp_path):
    rows = random_log(300, 20, 11)
    for part in (2, 0, 1):  # files arrive out of order
        spark.createDataFrame(rows[part * 100 : part * 100 + 100], LOG).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = streaming.read_log(spark, f"file://{tmp_path}/in", LOG, files_per_trigger=1)
    assert pairs(streaming.live_table(stream, Store(spark, f"file://{tmp_path}/t", ratio=3), f"file://{tmp_path}/c1")) == replayed(rows)
    store = Store(spark, f"file://{tmp_path}/s", ratio=3)
    streaming.flush_stream(stream, store, f"file://{tmp_path}/c2").awaitTermination()
    more = [(1000 + i, i, i, False) for i in range(10)]
    spark.createDataFrame(more, LOG).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    streaming.flush_stream(stream, store, f"file://{tmp_path}/c2").awaitTermination()
    assert pairs(store.live()) == replayed(rows + more)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in CATALOG.items() if sql))
def test_catalogue_against_sql(spark, name):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("customer", "supplier", "orders", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    query, sql = CATALOG[name]
    df = query(spark, d)
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    assert sorted(df.columns) == sorted(names)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((tuple(r) for r in df.select(*names).collect()), key=key) == sorted(out.fetchall(), key=key)


