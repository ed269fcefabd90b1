"""Fuzzy line deduplication: SimHashes of lines, joined on blocks of words, edit similarity over words, one occurrence a group.

A line is what stands between line feeds; normalised, it is its words (letters and digits, lower case), or its characters
where a script sets no blanks. Lines without a word stay. Equal normalised lines are one node. At edit similarity 0.8 a line
of fewer than four words has no fuzzy partner, since not even one edit is allowed.

An edit breaks at most three of a line's blocks of three words, so lines that are d edits apart and of which the longer one
has m words share m - 2 - 3d blocks at least (five words also have the block of all but the middle one, four that of all).
Each line is dealt to its ``BLOCKS`` smallest block hashes. That is a prefix filter: it misses no pair of which the longer
line has fewer than 15 words, and of longer ones it misses a pair only if none of the shared blocks is among them, which for
half of all blocks shared is one in a few thousand. SimHashes over pigeonhole blocks of *bits* cannot do it: at similarity 0.8
they are 13 of 64 bits apart, so that blocks wide enough to tell lines apart are hardly ever equal.

In a bucket, pairs whose 64-bit SimHashes are more than ``RADIUS`` bits apart go, and those that a parity sketch proves too
far apart; the rest are verified by edit similarity over words (31 bits of their hashes). Groups are the connected
components of verified links; the occurrence with the smallest (doc_id, line) stays.

In a bucket with very many lines or pairs, lines are first held against a few central ones; only what is in different
components after that is compared further, by length class. So thousands of variants of one line cost a star, and no link
between components is lost.

Defined cases: null texts and ids take no part and stay as they are; repeated rows count as one document; an empty
table gives an empty result; other columns are carried. Documents that lose every line are dropped by ``apply``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLOOM_BITS, bloom_words, by_value, connected_components, in_bloom, map_arrow, slices, stage
from .words import Splitter, chunked, runs_of

by_value(__name__)

BLOCK, BLOCKS, RADIUS, PARITY_BITS = 3, 8, 26, 112
FEW, MANY, HUBS, ALL_PAIRS, MOST, LONG = 8, 3, 8, 1024, 65535, 600
#: Segments that blocks are dealt to, at least, and how many rows a task puts together for that.
SEGMENTS, HELD = 1024, 500_000
SIGNATURE = ["s0", "s1", "s2"]
#: A larger parity sketch, for lines of crowded buckets only.
SKETCH = ["t0", "t1", "t2", "t3"]
#: Columns of a line's crowded blocks.
ALL = [f"b{i}" for i in range(BLOCKS)]
#: Fewer words allow no edit.
FUZZY = 4

ODD = np.uint64(0x9E3779B97F4A7C15)
#: The bits of a byte, each in a lane of eight bits.
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64).ravel()


def simhashes(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """int64 SimHashes of the segments of uint64 word hashes that begin at starts; a bit is set if most hashes have it."""
    n = np.diff(starts, append=len(hashes))
    most = int(n.max())
    # lanes hold up to 255, so longer segments are added up in parts
    many = -(-n // 255)
    at = np.cumsum(many) - many
    cuts = np.repeat(starts - 255 * at, many) + 255 * np.arange(int(many.sum())) if most > 255 else starts
    parts = np.add.reduceat(LANES[hashes.view(np.uint8).reshape(-1, 8)], cuts, axis=0).view(np.uint8).reshape(len(cuts), 64)
    ones = np.add.reduceat(parts, at, axis=0, dtype=np.int32) if most > 255 else parts.astype(np.int32)
    return np.packbits(2 * ones > n[:, None], axis=1).view(np.int64).ravel()


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values, sorted; faster than np.unique, which hashes them first."""
    values = np.sort(values)
    return values[np.flatnonzero(np.diff(values, prepend=~values[:1]))]


def blocks_of(hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block, line), by line: the smallest hashes of each line's blocks, BLOCKS of them at most, as 44 bits (2 ** 20 lines at
    most)."""
    line = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    starts = np.cumsum(n) - n
    fours, fives = starts[n == 4], starts[n == 5]

    def mixed(*words: np.ndarray) -> np.ndarray:
        out = words[0] * ODD
        for w in words[1:]:
            out = (out ^ (out >> np.uint64(29))) * ODD + w
        out = (out ^ (out >> np.uint64(31))) * ODD
        return (out ^ (out >> np.uint64(32))) >> np.uint64(20)

    whole = [line[fives] << np.uint64(44) | mixed(*(hashes[fives + i] for i in (4, 3, 1, 0))), line[fours] << np.uint64(44) | mixed(*(hashes[fours + i] for i in (3, 2, 1, 0)))]
    of, block = line[: -BLOCK + 1], mixed(*(hashes[i : len(hashes) - BLOCK + 1 + i] for i in range(BLOCK)))
    inside = of == line[BLOCK - 1 :]
    # long lines sort the blocks below a bound only, unless that leaves too few
    bound = (2.5 * BLOCKS / np.maximum(n - BLOCK + 1, 2.5 * BLOCKS) * (1 << 44)).astype(np.uint64)
    low = inside & (block <= np.repeat(bound, n)[: -BLOCK + 1])
    code = distinct(np.concatenate([of[low] << np.uint64(44) | block[low], *whole]))
    few = np.bincount((code >> np.uint64(44)).astype(np.int64), minlength=len(n)) < BLOCKS
    rest = inside & ~low & np.repeat(few, n)[: -BLOCK + 1]
    if rest.any():
        code = np.sort(np.concatenate([code, distinct(of[rest] << np.uint64(44) | block[rest])]), kind="stable")
    of = (code >> np.uint64(44)).astype(np.int64)
    many = np.bincount(of, minlength=len(n))
    first = np.arange(len(of)) - (np.cumsum(many) - many)[of] < BLOCKS
    return (code[first] & np.uint64((1 << 44) - 1)).astype(np.int64), of[first]


def edits(n: np.ndarray, similarity: float) -> np.ndarray:
    """How many edits two lines may be apart, of which the longer one has n words."""
    return np.floor((1 - similarity) * n + 1e-9).astype(np.int64)


def signatures(hashes: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Three int64 a line: the SimHash; then PARITY_BITS bits, each the parity of the number of words dealt to it, and the
    number of words.

    A word put in or taken out turns one parity bit over and a word replaced two at most, so many different bits rule a pair out.
    """
    found = parity(hashes >> np.uint64(8), n, PARITY_BITS, 128)
    found.view(np.uint16)[:, 7] = np.minimum(n, MOST)
    return np.concatenate([simhashes(hashes, np.cumsum(n) - n)[:, None], found], axis=1)


def parity(hashes: np.ndarray, n: np.ndarray, bits: int, room: int) -> np.ndarray:
    """int64 by line: ``bits`` parities, and zeros up to ``room`` bits."""
    at = np.repeat(np.arange(len(n)), n) * room + (hashes % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=room * len(n)) & 1).astype(np.uint8)).view(np.int64).reshape(len(n), room // 64)


def words_in(s: np.ndarray) -> np.ndarray:
    return s[:, 2] >> 48 & MOST


def may_be_near(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of signatures may be of lines as similar as that."""
    x = (a ^ b).view(np.uint64)
    bits = np.bitwise_count(x[:, 1]).astype(np.int64) + np.bitwise_count(x[:, 2] & np.uint64((1 << 48) - 1))
    p, q = words_in(a), words_in(b)
    most, apart = np.maximum(p, q), np.abs(p - q)
    top = edits(most, similarity)
    more = np.bitwise_count(x[:, 3:]).sum(axis=1, dtype=np.int64)
    return (np.bitwise_count(x[:, 0]) <= RADIUS) & ((most == MOST) | (apart <= top) & (np.maximum(bits, more) <= 2 * top - apart))


def packed(rows: np.ndarray, segments: int) -> tuple[pa.Array, pa.Array]:
    """(segment, bytes): rows of int64, of which the first says the segment, put together by segment."""
    of = rows[:, 0] % segments
    order = np.argsort(of.astype(np.uint16) if segments <= 1 << 16 else of, kind="stable")  # 16 bits are sorted by radix
    of = of[order]
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    ends = (np.append(starts, len(of)) * rows.shape[1] * 8).astype(np.int32)
    return pa.array(of[starts]), pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(rows[order])])


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, key, s0, s1, s2) of whole segments, by bucket, from (segment, rows) by segment."""
    held: list[np.ndarray] = []
    last, many = None, 0

    def ordered() -> pa.RecordBatch:
        rows = np.concatenate(held)
        return pa.record_batch([pa.array(c) for c in rows[np.argsort(rows[:, 0].copy())].T.copy()], ["bucket", "key", *SIGNATURE])

    for batch in batches:
        for segment, rows in zip(batch["segment"].to_pylist(), batch["rows"]):
            if segment != last and many > HELD:
                yield ordered()
                held.clear()
                many = 0
            held.append(np.frombuffer(rows.as_buffer(), np.int64).reshape(-1, 2 + len(SIGNATURE)).copy())
            last, many = segment, many + len(held[-1])
    if held:
        yield ordered()


def line_table(docs: DataFrame, segments: int) -> DataFrame:
    """(doc_id, line, key, null, null) of every line with a word, and (null, null, null, segment, rows) of their blocks, in one
    pass over the texts. ``rows`` are (block, key, s0, s1, s2) as bytes, those of one segment together; lines of fewer than
    FUZZY words have none and, mostly, lines that the task has met before."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter()
        seen: set[int] = set()
        held: list[np.ndarray] = []
        names = ["doc_id", "line", "key", "segment", "rows"]

        def dealt() -> pa.RecordBatch:
            segment, rows = packed(np.concatenate(held), segments)
            return pa.record_batch([*(pa.nulls(len(segment), pa.int64()) for _ in range(3)), segment, rows], names)

        for batch in slices(batches):
            texts = batch["text"].to_pylist()
            for part in chunked(texts):
                hashes, of_word, firsts = split(texts[part])
                begin, n = runs_of(of_word)
                if not len(n):
                    continue
                line = of_word[begin]
                doc = np.searchsorted(firsts, line, "right") - 1
                keys = split.sequences(hashes, begin, n)
                new = np.zeros(len(n), bool)
                fuzzy = np.flatnonzero(n >= FUZZY)
                for i, key in zip(fuzzy.tolist(), keys[fuzzy].tolist()):
                    if key not in seen:
                        seen.add(key)
                        new[i] = True
                if len(seen) > 200_000:
                    seen.clear()
                if new.any():
                    some = hashes[np.repeat(new, n)]
                    blocks, of = blocks_of(some, n[new])
                    held.append(np.concatenate([blocks[:, None], keys[new][of, None], signatures(some, n[new])[of]], axis=1))
                ids = batch["doc_id"].slice(part.start, part.stop - part.start).take(pa.array(doc))
                yield pa.record_batch([ids, pa.array(line - firsts[doc]), pa.array(keys), pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.binary())], names)
                if sum(map(len, held)) > HELD:
                    yield dealt()
                    held.clear()
        if held:
            yield dealt()

    rows = texts_with_id(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(rows, found, "doc_id long, line long, key long, segment long, rows binary")


def texts_with_id(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and text is not null")


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The columns of whole buckets of two keys or more, by the number of words in each; ``s`` is the signature, one row a line."""
    held: list[dict[str, np.ndarray]] = []

    def ordered() -> dict[str, np.ndarray]:
        cols = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
        order = np.lexsort((cols["key"], words_in(cols["s"]), cols["bucket"]))
        bucket, key = cols["bucket"][order], cols["key"][order]
        once = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (key[1:] != key[:-1])])
        order, bucket = order[once], bucket[once]
        same = bucket[1:] == bucket[:-1]
        order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        return {c: x[order] for c, x in cols.items()}

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {c: batch[c].to_numpy(zero_copy_only=False) for c in batch.schema.names}
        # most buckets have one row: inside a batch, those go before anything is sorted
        bucket = cols["bucket"]
        other = bucket[1:] != bucket[:-1]
        shared = ~(np.concatenate([[False], other]) & np.concatenate([other, [False]]))
        cols = {c: x[shared] for c, x in cols.items()}
        part = {"s": np.stack([cols[c] for c in SIGNATURE + SKETCH if c in cols], axis=1)} | {c: x for c, x in cols.items() if c not in SIGNATURE + SKETCH}
        # the rows of the last bucket wait for the next batch
        bucket = part["bucket"]
        cut = np.searchsorted(bucket, bucket[-1])
        if cut or held and held[-1]["bucket"][0] != bucket[-1]:
            held.append({c: x[:cut] for c, x in part.items()})
            yield ordered()
            held.clear()
        held.append({c: x[cut:] for c, x in part.items()})
    if held:
        yield ordered()


def near_pairs(bucket: np.ndarray, s: np.ndarray, comp: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of rows with one bucket and different comp that may be near, a few million compared at a time."""
    run = np.cumsum(np.concatenate([[0], bucket[1:] != bucket[:-1]])) << 17
    n = words_in(s)
    ends = np.searchsorted(run + n, run + np.minimum(np.floor(n / similarity + 1e-9), MOST).astype(np.int64), side="right")
    many = ends - np.arange(len(n)) - 1
    before = np.cumsum(many) - many
    start = 0
    while start < len(n):
        stop = max(start + 1, int(np.searchsorted(before, before[start] + 1_000_000)))
        m = many[start:stop]
        i = np.repeat(np.arange(start, stop), m)
        j = i + 1 + np.arange(len(i)) - np.repeat(before[start:stop] - before[start], m)
        other = comp[i] != comp[j]
        i, j = i[other], j[other]
        near = may_be_near(s[i], s[j], similarity)
        yield i[near], j[near]
        start = stop


def star(s: np.ndarray, key: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a few central rows with those that may be near them."""
    left, us, vs = np.arange(len(key)), [], []
    for _ in range(HUBS):
        bits = np.unpackbits(s[left].view(np.uint8), axis=1)
        hub = left[np.argmin((bits != (bits.mean(axis=0) > 0.5)).sum(axis=1))]
        near = np.flatnonzero(may_be_near(s, np.broadcast_to(s[hub], s.shape), similarity))
        us.append(np.full(len(near), key[hub])), vs.append(key[near])
        left = np.setdiff1d(left, near, assume_unique=True)
        if not len(left):
            break
    u, v = np.concatenate(us), np.concatenate(vs)
    return u[u != v], v[u != v]


def edit_distance(a: list, b: list) -> int:
    """Levenshtein distance of two sequences: common ends are cut, the rest is done in bit vectors (Myers, Hyyrö)."""
    start, end = 0, 0
    top = min(len(a), len(b))
    while start < top and a[start] == b[start]:
        start += 1
    while end < top - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return max(len(a), len(b))
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for x in b:
        eq = places.get(x, 0)
        d0 = (((eq & plus) + plus) ^ plus) | eq | minus
        hp, hn = minus | (full & ~(d0 | plus)), d0 & plus
        score += bool(hp & last) - bool(hn & last)
        hp, hn = (hp << 1 | 1) & full, (hn << 1) & full
        plus, minus = hn | (full & ~(d0 | hp)), d0 & hp
    return score


def distances(x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray, most: int) -> np.ndarray:
    """Edit distances of pairs of sequences, the columns of x and y, of lengths p and q; right where they are up to ``most``.

    The band of Ukkonen, row by row, over all pairs at once.
    """
    band = 2 * most + 1
    step = np.arange(band, dtype=np.int16)[:, None]
    far = np.int16(20_000)
    padded = np.full((x.shape[0] + y.shape[0] + band, x.shape[1]), -1, y.dtype)
    padded[most : most + y.shape[0]] = y
    row = np.where(step >= most, step - np.int16(most), far) + np.zeros((1, x.shape[1]), np.int16)
    out = np.full(x.shape[1], far, np.int16)
    order = np.argsort(p, kind="stable")
    ends = np.searchsorted(p[order], np.arange(x.shape[0] + 2))
    for i in range(x.shape[0] + 1):
        if i:
            # place k of the band is column i + k - most of the table
            new = row + (padded[i - 1 : i - 1 + band] != x[i - 1])
            np.minimum(new[:-1], row[1:] + np.int16(1), out=new[:-1])
            new[: max(0, most - i)] = far
            new -= step
            np.minimum.accumulate(new, axis=0, out=new)
            row = new + step
        done = order[ends[i] : ends[i + 1]]
        if len(done):
            at = q[done] - i + most
            inside = (at >= 0) & (at < band)
            out[done[inside]] = row[at[inside], done[inside]]
    return out


def surplus(words: np.ndarray, n: np.ndarray, others: np.ndarray, m: np.ndarray, bins: int = 512) -> np.ndarray:
    """A lower bound of the edit distance of pairs of sequences, given one after another: words that one has and the other lacks."""
    most, few = (np.bincount(np.repeat(np.arange(len(k)), k) * bins + (w & (bins - 1)), minlength=bins * len(k)) for w, k in ((words, n), (others, m)))
    apart = (most - few).reshape(len(n), bins)
    return np.maximum(np.maximum(apart, 0).sum(axis=1), np.maximum(-apart, 0).sum(axis=1))


def one_place(x: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """An upper bound of the edit distance of pairs of sequences, columns as for :func:`distances`: the least if words are put
    in or left out in one place only."""
    n, both = min(x.shape[0], y.shape[0]), np.minimum(p, q)
    i = np.arange(n)[:, None]
    inside, column = i < both, np.arange(len(p))
    zero = np.zeros((1, len(p)), np.int32)
    from_start = np.concatenate([zero, np.cumsum((x[:n] != y[:n]) & inside, axis=0, dtype=np.int32)])
    from_end = np.concatenate([zero, np.cumsum((x[np.maximum(p - 1 - i, 0), column] != y[np.maximum(q - 1 - i, 0), column]) & inside, axis=0, dtype=np.int32)])
    at = np.arange(n + 1)[:, None]
    together = np.where(at <= both, from_start + from_end[np.maximum(both - at, 0), column], MOST)
    return together.min(axis=0) + np.abs(p - q)


def similar_pairs(x: pa.Array, y: pa.Array, similarity: float) -> np.ndarray:
    """Which pairs of lists of int32 have that edit similarity. Bounds settle most of them."""
    (xs, p, at), (ys, q, bt) = ((a.flatten().to_numpy(), n, np.cumsum(n) - n) for a in (x, y) for n in [np.diff(a.offsets.to_numpy())])
    top = edits(np.maximum(p, q), similarity)
    out = np.zeros(len(p), bool)
    many = np.maximum(p, q)
    maybe = (np.abs(p - q) <= top) & (surplus(xs, p, ys, q) <= top)
    for i in np.flatnonzero(maybe & (many > LONG)):
        out[i] = edit_distance(xs[at[i] : at[i] + p[i]].tolist(), ys[bt[i] : bt[i] + q[i]].tolist()) <= top[i]
    todo = np.flatnonzero(maybe & (many <= LONG))
    todo = todo[np.argsort(many[todo], kind="stable")]

    def table(values: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        place = np.arange(max(1, n.max(initial=0)))[:, None]
        return np.where(place < n, values[np.minimum(first + place, len(values) - 1)], -2) if len(values) else np.full((1, len(n)), -2)

    start = 0
    while start < len(todo):
        # pairs of like length, so that the band fits all, some hundred thousand cells a row
        stop = start + int(np.searchsorted(many[todo[start:]], 1.1 * many[todo[start]] + 4, "right"))
        some = todo[start : min(stop, start + max(1, 200_000 // (2 * int(top[todo[stop - 1]]) + 1)))]
        start += len(some)
        left, right = table(xs, at[some], p[some]), table(ys, bt[some], q[some])
        sure = one_place(left, right, p[some], q[some]) <= top[some]
        out[some[sure]] = True
        if not sure.all():
            rest = some[~sure]
            out[rest] = distances(left[:, ~sure], right[:, ~sure], p[rest], q[rest], int(top[rest].max())) <= top[rest]
    return out


def as_bytes(words: np.ndarray, n: np.ndarray) -> pa.Array:
    """The runs of n int32, one after another, as bytes: Spark and Parquet take a list one number at a time, bytes at once."""
    ends = np.concatenate([[0], 4 * np.cumsum(n)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(words)])


def as_lists(words: pa.Array) -> pa.Array:
    """What :func:`as_bytes` was given, as lists of int32."""
    _, ends, values = words.buffers()
    ends = np.frombuffer(ends, np.int32, len(words) + 1, 4 * words.offset) // 4 if len(words) else np.zeros(1, np.int32)
    values = np.frombuffer(values, np.int32, ends[-1] - ends[0], 4 * int(ends[0])) if ends[-1] > ends[0] else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends - ends[0]), pa.array(values))


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            keep = pa.array(similar_pairs(as_lists(batch["x"]), as_lists(batch["y"]), similarity))
            yield pa.record_batch([batch["u"].filter(keep), batch["v"].filter(keep)], ["u", "v"])

    first = pairs.join(texts.select(F.col("key").alias("v"), F.col("words").alias("y")), "v")
    both = first.join(texts.select(F.col("key").alias("u"), F.col("words").alias("x")), "u").select("u", "v", "x", "y")
    return map_arrow(both, similar, "u long, v long")


def texts_of(docs: DataFrame, keys: DataFrame, lines: DataFrame) -> DataFrame:
    """(key, words, t0, t1, t2, t3) of the lines in ``keys``, read again where they are first: 31 bits of each word's hash,
    as bytes. Only the lines at those places are split again."""
    place = F.xxhash64("first.doc_id").bitwiseXOR(F.col("first.line")).bitwiseXOR(F.shiftleft("first.line", BLOOM_BITS))
    wanted = stage(lines.join(keys, "key", "left_semi").select("key", place.alias("place")), "wanted")
    cast = docs.sparkSession.sparkContext.broadcast((bloom_words(wanted, "place"), bloom_words(wanted, "key")))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_place, by_key = cast.value
        split = Splitter()
        seen: set[int] = set()
        for batch in slices(batches):
            cut = [t.split("\n") for t in batch["text"].to_pylist()]
            many = np.array([len(c) for c in cut], np.int64)
            line = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            at = in_bloom(by_place, np.repeat(batch["doc"].to_numpy(), many) ^ line ^ (line << BLOOM_BITS))
            texts = list(compress(chain.from_iterable(cut), at.tolist()))
            for part in chunked(texts):
                hashes, of_word, _ = split(texts[part])
                begin, n = runs_of(of_word)
                keys = split.sequences(hashes, begin, n)
                new = (n >= FUZZY) & in_bloom(by_key, keys)
                for i in np.flatnonzero(new):
                    new[i] = keys[i] not in seen
                    seen.add(int(keys[i]))
                if len(seen) > 200_000:
                    seen.clear()
                if new.any():
                    some = hashes[np.repeat(new, n)]
                    words = as_bytes((some >> np.uint64(33)).astype(np.int32), n[new])
                    yield pa.record_batch([pa.array(keys[new]), words, *(pa.array(c) for c in parity(some >> np.uint64(40), n[new], 256, 256).T)], ["key", "words", *SKETCH])

    rows = texts_with_id(docs).select(F.xxhash64(F.col("doc_id").cast("long")).alias("doc"), "text")
    return map_arrow(rows, found, "key long, words binary, t0 long, t1 long, t2 long, t3 long").join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])


def drops_of(seen: DataFrame, lines: DataFrame, comps: DataFrame) -> DataFrame:
    # a line that stands once and has no link is a group of its own, of which nothing goes
    repeated = lines.join(comps.withColumnRenamed("node", "key"), "key", "left").where("n > 1 or comp is not null")
    grouped = stage(repeated.select("key", "first", F.coalesce("comp", "key").alias("comp")), "grouped")
    groups = grouped.groupBy("comp").agg(F.min("first").alias("kept"))
    named = grouped.join(groups, "comp").select("key", "kept", (F.col("first") == F.col("kept")).alias("exact"))
    return (
        seen.join(named, "key")
        .where(~((F.col("doc_id") == F.col("kept.doc_id")) & (F.col("line") == F.col("kept.line"))))
        .select("doc_id", "line", F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.line").alias("kept_line"), "exact")
    )


def block_pairs(rows: DataFrame, similarity: float) -> DataFrame:
    """(bucket, u, v, s1, s2, mark) from (segment, rows) by segment: pairs of lines with a common block that may be near; for
    each line of a bucket that has very many lines or pairs, (bucket, key, s0, s1, s2, true) and only the pairs with central
    lines."""

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, s, key in ((run["bucket"], run["s"], run["key"]) for run in whole_runs(unpacked(batches))):
            if not len(bucket):
                continue
            starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            size = np.diff(starts, append=len(bucket))
            run = np.repeat(np.arange(len(size)), size)
            few = np.flatnonzero(size[run] <= ALL_PAIRS)
            got = [(few[i], few[j]) for i, j in near_pairs(bucket[few], s[few], key[few], similarity)] if len(few) else []
            i, j = (np.concatenate(c) for c in zip(*got)) if got else (few, few)
            full = (size > ALL_PAIRS) | (size > FEW) & (np.bincount(run[i], minlength=len(size)) > MANY * size)
            i, j = i[~full[run[i]]], j[~full[run[i]]]
            out = [(np.zeros(len(i), np.int64), key[i], key[j], np.zeros((len(i), 2), np.int64), np.zeros(len(i), bool))]
            for k in np.flatnonzero(full):
                at = slice(starts[k], starts[k] + size[k])
                u, v = star(s[at], key[at], similarity)
                out.append((np.zeros(len(u), np.int64), u, v, np.zeros((len(u), 2), np.int64), np.zeros(len(u), bool)))
                out.append((bucket[at], key[at], s[at, 0], s[at, 1:], np.ones(size[k], bool)))
            b, u, v, more, mark = (np.concatenate(c) for c in zip(*out))
            if len(b):
                yield pa.record_batch([pa.array(c) for c in (b, u, v, *more.T, mark)], ["bucket", "u", "v", "s1", "s2", "mark"])

    return map_arrow(rows, paired, "bucket long, u long, v long, s1 long, s2 long, mark boolean")


def pairs_across(rows: DataFrame, similarity: float) -> DataFrame:
    """(u, v): pairs that may be near of lines (bucket, key, s0 to s2, t0 to t3, comp, guest, of, b0 ...) in one bucket and in
    different components; two guests are no pair. ``of`` is the block that the bucket is part of and b0 ... are all blocks of
    the line that are crowded and mixed: a pair comes from the smallest that both have."""

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in whole_runs(batches):
            key, guest, blocks = run["key"], run["guest"], np.stack([run[b] for b in ALL], axis=1)
            for i, j in near_pairs(run["bucket"], run["s"], run["comp"], similarity):
                own = ~(guest[i] & guest[j])
                i, j = i[own], j[own]
                for k in range(0, len(i), 100_000):
                    x, y = blocks[i[k : k + 100_000]], blocks[j[k : k + 100_000]]
                    both = ((x[:, :, None] == y[:, None, :]) & (x[:, :, None] >= 0)).any(axis=2)
                    first = np.where(both, x, np.iinfo(np.int64).max).min(axis=1) == run["of"][i[k : k + 100_000]]
                    if first.any():
                        yield pa.record_batch([pa.array(key[i[k : k + 100_000]][first]), pa.array(key[j[k : k + 100_000]][first])], ["u", "v"])

    return map_arrow(rows, paired, "u long, v long")


def similar_lines(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(doc_id, line, kept_doc_id, kept_line, exact): every line occurrence to drop, and the occurrence that stays for it."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    table = stage(line_table(docs, n * -(-SEGMENTS // n)), "lines")
    seen = table.where("segment is null").select("doc_id", "line", "key")
    lines = stage(seen.groupBy("key").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("n")), "keys")
    dealt = table.where("segment is not null").select("segment", "rows").repartitionById(n, (F.col("segment") % n).cast("int")).sortWithinPartitions("segment")
    found = stage(block_pairs(dealt, similarity), "found")
    ends = F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")
    pairs = stage(found.where("not mark").select(*ends).distinct(), "pairs")
    crowded = found.where("mark").select("bucket", F.col("u").alias("key"), F.col("v").alias("s0"), "s1", "s2")
    keys = pairs.select(F.explode(F.array("u", "v")).alias("key")).union(crowded.select("key")).distinct()
    texts = stage(texts_of(docs, keys, lines), "texts")
    links = stage(verified(pairs, texts, similarity), "links")
    comps = connected_components(links)
    if crowded.head(1):
        rows = crowded.join(comps.withColumnRenamed("node", "key"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
        mixed = rows.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
        rows = stage(rows.join(mixed, "bucket", "left_semi"), "mixed")
        lists = rows.groupBy("key").agg(F.collect_set("bucket").alias("all")).select("key", *[F.coalesce(F.get("all", F.lit(i)), F.lit(-1)).alias(b) for i, b in enumerate(ALL)])
        # lines of similar length are in one length class or in neighbouring ones; each class is a bucket, with the class below as guests
        size = F.floor(F.log(F.expr("shiftrightunsigned(s2, 48)").cast("double")) / float(-np.log(similarity)) + 1e-9)
        both = F.explode(F.array(F.struct(F.lit(0).alias("up"), F.lit(False).alias("guest")), F.struct(F.lit(1).alias("up"), F.lit(True).alias("guest"))))
        rows = rows.join(texts.select("key", *SKETCH).join(lists, "key"), "key").select("*", both.alias("as"))
        rows = rows.select(F.xxhash64("bucket", size + F.col("as.up")).alias("bucket"), "key", *SIGNATURE, *SKETCH, "comp", "as.guest", F.col("bucket").alias("of"), *ALL).repartition(n, "bucket").sortWithinPartitions("bucket")
        more = stage(pairs_across(rows, similarity).select(*ends).distinct().join(pairs, ["u", "v"], "left_anti"), "more")
        if more.head(1):
            # what is known to be connected is a star by now
            links = stage(verified(more, texts, similarity), "links")
            comps = connected_components(links.union(comps.select(F.col("node").alias("u"), F.col("comp").alias("v"))))
    return drops_of(seen, lines, comps)


def apply(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """``docs`` without the lines in ``drops`` (doc_id, line); n_chars, where there is such a column, is counted again.

    Documents without such lines are untouched; those that lose all their lines go.
    """
    lists = drops.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set("line").alias("_drop"))
    joined = docs.join(lists, F.col("doc_id") == F.col("_id"), "left")
    left = F.expr("filter(split(text, '\\n', -1), (x, i) -> not array_contains(_drop, cast(i as bigint)))")
    joined = joined.withColumn("_left", F.when(F.col("_drop").isNotNull(), left)).where("_left is null or size(_left) > 0")
    text = F.when(F.col("_left").isNotNull(), F.array_join("_left", "\n")).otherwise(F.col("text"))
    new = {"text": text} | ({"n_chars": F.when(F.col("_left").isNotNull(), F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])
