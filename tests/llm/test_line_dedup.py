"""Line dedup against brute force on edit similarity alone."""

import random

import numpy as np
import pyarrow as pa
from support import edit_groups, frame, line_words, words

from tidemark.llm import line_dedup
from tidemark.llm.words import Splitter, chunked


def test_similar_lines_equal_edit_similarity_alone(spark, odd, none, monkeypatch):
    rng = random.Random(8)
    common = words(12, 5).split()
    lines = []
    for k in range(60):
        line = [rng.choice(common) if rng.random() < 0.4 else words(1, rng.random()) for _ in range(rng.choice([5, 6, 8, 10, 14, 15, 20, 25, 60, 160]))]
        lines.append(line)
        for share in (0.1, 0.2, 0.2, 0.3):  # edited just within the rule, and beyond it
            new = list(line)
            for e in range(int(share * len(line))):
                at = rng.randrange(len(new))
                new[at : at + 1] = rng.choice([["neu"], [], [new[at], f"x{e}"]])
            lines.append(new)
    rng.shuffle(lines)
    docs = frame(spark, ["\n".join(map(" ".join, lines[i : i + 5])) for i in range(0, len(lines), 5)], 100)
    want = edit_groups([(r["doc_id"], r["text"]) for r in docs.collect()])
    for all_pairs, few in ((line_dedup.ALL_PAIRS, line_dedup.FEW), (3, 2)):  # the second time, nearly all buckets are crowded
        monkeypatch.setattr(line_dedup, "ALL_PAIRS", all_pairs)
        monkeypatch.setattr(line_dedup, "FEW", few)
        got = {(r["doc_id"], r["line"]): (r["kept_doc_id"], r["kept_line"]) for r in line_dedup.similar_lines(docs.unionByName(odd)).collect()}
        assert {k: v for k, v in got.items() if k[0] >= 100} == want and len(want) > 80
        assert {k: v for k, v in got.items() if k[0] < 100} == {(9, 0): (8, 0)}
    assert line_dedup.similar_lines(none).count() == 0


def test_blocks_are_dealt_by_segment_and_none_is_lost(spark, monkeypatch):
    docs = frame(spark, ["\n".join(words(4 + (i + j) % 30, 100 * i + j) for j in range(20)) for i in range(40)]).repartition(2)
    table = line_dedup.stage(line_dedup.line_table(docs, 16), "lines")
    dealt = table.where("segment is not null").select("segment", "rows").toArrow().sort_by("segment")
    assert table.where("segment is null").count() == 800 and 16 <= dealt.num_rows <= 2 * 16  # a row a task and segment, not one a block
    want = []
    for r in docs.collect():
        hashes, of_word, _ = Splitter()([r["text"]])
        blocks, of = line_dedup.blocks_of(hashes, np.bincount(of_word))
        want += zip(blocks.tolist(), of.tolist())
    for held in (line_dedup.HELD, 50):
        monkeypatch.setattr(line_dedup, "HELD", held)
        got = [b["bucket"].to_pylist() for b in line_dedup.unpacked(iter(dealt.to_batches()))]
        assert sorted(sum(got, [])) == sorted(b for b, _ in want) and all(b == sorted(b) for b in got)
        assert (len(got) > 1) == (held == 50) and len({x for b in got for x in set(b)}) == sum(len(set(b)) for b in got)  # whole buckets


def test_only_shared_blocks_are_sorted(monkeypatch):
    rng = np.random.default_rng(2)
    bucket = np.sort(np.concatenate([rng.choice(1 << 40, 5000, replace=False), np.repeat([7, 1 << 39, 1 << 41], [2, 40, 3])]))
    key = rng.integers(0, 30, len(bucket))
    cols = [bucket, key, *rng.integers(0, 1 << 62, (3, 30))[:, key]]  # equal lines have equal signatures
    want = {(b, k) for b, k in zip(bucket.tolist(), cols[1].tolist()) if b in (7, 1 << 39, 1 << 41)}
    want = {x for x in want if len({k for b, k in want if b == x[0]}) > 1}
    sizes, lexsort = [], np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: sizes.append(len(keys[0])) or lexsort(keys))
    for rows in (50, 1000, len(bucket)):  # batches end anywhere, also inside a bucket
        sizes.clear()
        batches = pa.table([pa.array(c) for c in cols], ["bucket", "key", *line_dedup.SIGNATURE]).to_batches(rows)
        got = [x for run in line_dedup.whole_runs(iter(batches)) for x in zip(run["bucket"].tolist(), run["key"].tolist())]
        assert set(got) == want and len(got) == len(want)
        assert sum(sizes) <= 45 + 2 * len(batches)  # all but the first and last row of a batch, if alone


def test_words_travel_as_bytes_and_single_lines_join_no_group(spark, monkeypatch):
    n = np.array([0, 3, 1, 0, 4])
    packed, want = line_dedup.as_bytes(np.arange(8, dtype=np.int32) - 2, n), [[], [-2, -1, 0], [1], [], [2, 3, 4, 5]]
    assert line_dedup.as_lists(packed).to_pylist() == want and line_dedup.as_lists(packed.slice(1, 3)).to_pylist() == want[1:4]
    assert line_dedup.as_lists(packed.slice(5)).to_pylist() == [] and line_dedup.as_lists(packed.slice(3, 1)).to_pylist() == [[]]
    staged, stage = {}, line_dedup.stage
    monkeypatch.setattr(line_dedup, "stage", lambda df, tag: staged.setdefault(tag, stage(df, tag)))
    near = words(20, 1)
    texts = [f"{near}\n{words(20, 2)}\n{words(20, 3)}", f"{near} more\nall rights", f"All Rights\n{words(9, 4)}"]
    drops = line_dedup.similar_lines(frame(spark, texts)).collect()
    assert sorted(tuple(r) for r in drops) == [(1, 0, 0, 0, False), (2, 0, 1, 1, True)]
    assert dict(staged["texts"].dtypes)["words"] == "binary" and staged["texts"].count() == 2
    assert staged["keys"].count() == 6 and staged["grouped"].count() == 3  # the two near lines and the repeated one


def test_short_lines_and_scripts_without_blanks(spark):
    han, thai = "版权所有未经许可不得转载本网站内容", "สงวนลิขสิทธิ์ทุกประการ"
    texts = ["All rights reserved\n!!\nOf.", f"all rights reserved.\n!!\n\n{han}\nall rights", f"{han[:-1]}物\nof\n{thai}\n版权", f"{thai}\nall rights deserved\n版权"]
    drops = line_dedup.similar_lines(frame(spark, texts)).collect()
    got = {(r["doc_id"], r["line"]): (r["kept_doc_id"], r["kept_line"], r["exact"]) for r in drops}
    assert got == {(1, 0): (0, 0, True), (2, 0): (1, 3, False), (2, 1): (0, 2, True), (3, 0): (2, 2, True), (3, 2): (2, 3, True)}


def test_splitter_equals_plain_words():
    split = Splitter()
    texts = ["", "\n\n", "a_b c", "日本語 text กา\nก่า", "İstanbul ΟΔΟΣ ß", "x\U0001f600y \U00020001\U00020002z \U0001d49c\U0001d4b7", "a" * 100_000 + " b", words(20_000, 3), "ab ba aab", words(400, 4) + "\n" + words(300, 4)]
    for some in (texts, texts[::-1], texts[2:3]):
        hashes, line, firsts = split(some)
        want = [(firsts[k] + i, w) for k, t in enumerate(some) for i, ws in line_words(t) for w in ws]
        assert [x for x, _ in want] == line.tolist()
        by_word = {w: h for (_, w), h in zip(want, hashes.tolist())}
        assert [by_word[w] for _, w in want] == hashes.tolist() and len(set(by_word.values())) == len(by_word)
    assert len(split([""])[0]) == 0 and chunked([]) is not None and [s.stop for s in chunked(["ab", None, "c" * 500, "d"], 100)] == [2, 3, 4]


def test_distances_of_many_pairs_equal_one_by_one():
    rng = np.random.default_rng(4)
    pairs = []
    for n in [0, 1, 4, 5, 9, 20, 60, 150, 700] * 12:
        a = rng.integers(0, 9, n)
        b = np.delete(a, rng.integers(0, max(n, 1), n // 9)) if n else a
        b = b.copy()
        b[rng.random(len(b)) < rng.choice([0, 0.1, 0.3])] = 77
        pairs += [(a, b), (b, a), (a, rng.integers(0, 9, n + int(rng.integers(0, 3))))]
    x, y = (pa.array([p[i].tolist() for p in pairs], pa.list_(pa.int32())) for i in (0, 1))
    want = [line_dedup.edit_distance(a.tolist(), b.tolist()) <= int(0.2 * max(len(a), len(b)) + 1e-9) for a, b in pairs]
    assert line_dedup.similar_pairs(x, y, 0.8).tolist() == want and 50 < sum(want) < len(want) - 50
    assert line_dedup.similar_pairs(x.slice(40, 100), y.slice(40, 100), 0.8).tolist() == want[40:140]
