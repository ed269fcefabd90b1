"""The shell on frames of commands, against a plain Python one; the driver gets counts, not commands or answers."""

import random

import pytest

from tidemark import dsl
from tidemark.plans.catalog import shell_answers
from tidemark.sources.commands import USAGE


class Plain:
    """One command after the other, in dictionaries."""

    def __init__(self, capacity):
        self.capacity, self.held, self.stored, self.flushed = capacity, {}, {}, []

    def live(self):
        return {k: v for k, v in (self.stored | self.held).items() if v is not None}

    def run(self, lines):
        return [x for line in lines for x in self.answer(line)]

    def answer(self, line):
        op, *rest = line.split()
        if op in "pd":
            self.held[int(rest[0])] = int(rest[1]) if op == "p" else None
            if len(self.held) >= self.capacity:
                self.flushed.append((len(self.held), min(self.held), max(self.held)))
                self.stored, self.held = self.stored | self.held, {}
            return ["OK"]
        if op == "g":
            return [str(self.live().get(int(rest[0]), ""))] if rest else [USAGE["g"]]
        if op == "r":
            return [f"Range ({rest[0]} to {rest[1]}):  SIZE: {sum(int(rest[0]) <= k <= int(rest[1]) for k in self.live())}"]
        if op == "s":
            return [f"{k}:{v}:{'M' if k in self.held else 'L1'}" for k, v in sorted(self.live().items())]
        if op == "l":
            return self.run(open(rest[0]).read().splitlines())
        self.held, self.stored, self.flushed = {}, {}, []
        return ["Cleanup initiated."]


def commands(n, keys, seed, ranges):
    rng = random.Random(seed)
    for _ in range(n):
        k, op = rng.randint(-keys, keys), rng.choices("pdgr!", (9, 3, 9, ranges, 1))[0]
        yield {"p": f"p {k} {rng.randint(-99, 99)}", "d": f"d {k}", "g": f"g {k}", "r": f"r {k} {k + rng.randint(-9, 40)}", "!": "g"}[op]


def framed(spark, lines):
    rows = [(i * 1000 + (1 << 40) * (i > len(lines) // 2), x) for i, x in enumerate(lines)]
    return spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "at long, line string").repartition(3)


def said(df):
    rows = sorted(tuple(r) for r in df.collect())
    assert [n for n, _ in rows] == list(range(len(rows)))
    return [x for _, x in rows if not x.startswith(("logical_pairs", "LVL"))]


def state(shell):
    return {k: w[2] for k, w in shell.held.items()}, [(r["rows"], r["min_key"], r["max_key"]) for r in shell.store.manifest()["runs"]]


@pytest.mark.parametrize("capacity, ranges", [(1000, 0), (35, 0.3), (40, 9)])
def test_frames_are_answered_as_one_by_one(spark, tmp_path, capacity, ranges):
    shell, plain = dsl.Shell(spark, f"file://{tmp_path}/s", capacity), Plain(capacity)
    for seed in (1, 2):  # the second sees what the first left in the memtable and in runs
        lines = list(commands(150, 40, seed, ranges))
        assert (sum(x[0] == "r" for x in lines) > dsl.FEW) == (ranges > 1)
        assert said(shell.answers(framed(spark, lines))) == plain.run(lines)
        # one by one again, on what a frame left
        assert shell.run(["p 3 5", "d 4", "g 3", "g 7", "r -9 9"]) == plain.run(["p 3 5", "d 4", "g 3", "g 7", "r -9 9"])
    assert state(shell) == (plain.held, plain.flushed) and (len(plain.flushed) > 1) == (capacity < 1000)
    assert shell.answers(framed(spark, [])).count() == 0 and state(shell)[0] == plain.held


def test_frames_with_commands_that_stand_alone(spark, tmp_path):
    (tmp_path / "load.txt").write_text("p 1 7\ng 1\nr 0 9\n")
    lines = ["s", "p 1 1", "p 2 2", "s", f"l {tmp_path}/load.txt", "g 1", "d 2", "p 3 3", "p 4 4", "s", "c", "s", "g 1", "p 5 5", "r 0 9"]
    shell, plain = dsl.Shell(spark, f"file://{tmp_path}/s", 3), Plain(3)
    assert said(shell.answers(framed(spark, lines))) == plain.run(lines)
    assert state(shell) == (plain.held, plain.flushed) == ({5: 5}, [])


def test_where_the_memtable_is_full(spark, tmp_path):
    rng, last, rows = random.Random(3), {}, []
    for seq in range(100, 1100):
        key = rng.randint(0, 4 if seq < 600 else 400)  # few keys first, so that stretches must grow
        rows.append((seq, last.get(key)))
        last[key] = seq
    shell, frame = dsl.Shell(spark, f"file://{tmp_path}/s", 20), spark.createDataFrame(rows, "seq long, before long")
    for begin, parts in ((100, 4), (100, 1024), (640, 3), (1090, 4)):
        new = [seq for seq, before in rows if seq >= begin and (before is None or before < begin)]
        assert shell._full(frame, begin, 1099, parts) == (new[19] if len(new) > 19 else None)


def test_driver_gets_no_commands_and_no_answers(spark, monkeypatch):
    kind, got = type(spark.range(1)), []
    collect, iterate = kind.collect, kind.toLocalIterator
    monkeypatch.setattr(kind, "collect", lambda self: [got.append(r) or r for r in collect(self)])
    monkeypatch.setattr(kind, "toLocalIterator", lambda self, *a, **k: (got.append(r) or r for r in iterate(self, *a, **k)))
    answers = shell_answers(spark, "/root/testdata/sf0.01")
    assert len(got) < 100 and answers.count() == 10_003
