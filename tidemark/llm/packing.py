"""Packing documents into sequences of ``window`` tokens by best-fit decreasing.

Documents are tokenized once and cut: overlong ones first into full windows, what is left into one piece. Best fit needs
only how many pieces of each length there are, at most ``window`` numbers, whatever the input: equal lengths are placed
together, a segment tree over remaining capacities giving the tightest open windows. The placement is the one that
item-by-item best-fit decreasing gives, as runs (length, ranks) -> (windows, offset). Pieces get their rank among equal
lengths from counts by (length, bucket), so that a length of many rows is numbered by many tasks, and look their
run up. Two narrow exchanges; neither texts nor ids are shuffled unless ids are asked for.

Defined cases: a null text is empty and packs as the closing id alone; repeated rows are packed each; an empty table
gives an empty result; other columns are not read. A text with the written form of a special token goes through the
tokenizer's own encoding as a whole, as do texts with control characters or capital sigma.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value, map_arrow, slices, stage

if TYPE_CHECKING:
    from tokenizers import Tokenizer

by_value(__name__)

WINDOW, CLOSING, BUCKETS, CACHE_WORDS = 2048, 1, 256, 150_000
SPACE, LETTER, NUMBER, OTHER, ODD = range(5)
LIMIT, MOST_LETTERS = 0x3000, 1000


#: The letters that a byte-level tokenizer writes for bytes: printable ones as they are, others from 256 on. Blanks stay.
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in SHOWN) if b != 32}


def by_bytes(text: str) -> str:
    return text if text.isascii() else text.encode().decode("latin-1").translate(LETTERS)


class Encoder:
    """Token ids of whole texts as little-endian uint32 arrays, remembered by word.

    The tokenizer splits a text before it merges, so the ids of a text are those of its words. Texts are split many at a
    time, by classes of their characters; a word is known by a 64-bit hash of its characters, and only words not met before
    go through the tokenizer. Texts with anything that this leaves open (characters from ``LIMIT`` on or without a class, special
    tokens, very long words) go through the tokenizer as a whole. Words are kept in arrays, by hash, not as objects, and in
    two generations: once there are CACHE_WORDS in the young one it becomes the old one, and what is still in use moves back.
    """

    def __init__(self, definition: str):
        from tokenizers import pre_tokenizers

        # the whole tokenizer is made for the first text that needs it
        self.definition, self.tokenizer = definition, None
        # the same merges for words that are cut, normalised and written by their bytes already
        self.bare = self.made()
        self.bare.normalizer, self.bare.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        self.last = np.zeros(self.bare.get_vocab_size(), bool)
        self.last[[i for token, i in self.bare.get_vocab().items() if token.endswith("</w>")]] = True
        # words by hash, ascending; a word's ids are the ``many`` from ``first`` on in ``flat``
        self.keys, self.flat = np.zeros(0, np.uint64), np.zeros(0, "<u4")
        self.first, self.many = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.young = np.zeros(0, bool)
        kinds = {"L": LETTER, "N": NUMBER}
        self.kind = np.array([SPACE if chr(i).isspace() else kinds.get(c[0], ODD if c in ("Cc", "Cn", "Cs", "Co") else OTHER) for i in range(LIMIT) for c in [unicodedata.category(chr(i))]] + [ODD], np.uint8)
        self.kind[[*range(9), *range(11, 32), *range(127, 160)]] = ODD
        rng = np.random.default_rng(5)
        self.mix = rng.integers(0, 1 << 64, LIMIT + 1, np.uint64)
        self.place = rng.integers(0, 1 << 63, MOST_LETTERS, np.uint64) * np.uint64(2) + np.uint64(1)

    def made(self) -> Tokenizer:
        from tokenizers import Tokenizer

        out = Tokenizer.from_str(self.definition)
        # its own cache of words outlives it, in every thread that filled it, and a worker makes one tokenizer a task
        if resize := getattr(out.model, "_resize_cache", None):
            resize(0)
        return out

    def whole(self, text: str) -> np.ndarray:
        if self.tokenizer is None:
            self.tokenizer = self.made()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def words(self, code: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words begin and end: runs of letters, single numbers, runs of others, and an apostrophe with a short ending."""
        first = kind != np.concatenate([[SPACE], kind[:-1]])
        last = kind != np.concatenate([kind[1:], [SPACE]])
        first, last = (first | (kind == NUMBER)) & (kind != SPACE), (last | (kind == NUMBER)) & (kind != SPACE)
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        lone = np.flatnonzero((code[begin] == ord("'")) & (end - begin == 1) & (kind[np.minimum(end, len(kind) - 1)] == LETTER))
        lone = lone[lone + 1 < len(begin)]
        if len(lone):
            at = begin[lone] + 1
            one, two = code[at], code[np.minimum(at + 1, len(code) - 1)]
            pair = np.zeros(len(at), bool)
            for x, y in ("re", "ve", "ll"):
                pair |= (one == ord(x)) & (two == ord(y))
            more = np.where(pair, 2, np.isin(one, [ord(x) for x in "stmd"]))
            end[lone] += more
            begin[lone + 1] += more
            some = begin < end
            begin, end = begin[some], end[some]
        return begin, end

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        plain = [None if "<|" in t or "Σ" in t else (t if t.isascii() else unicodedata.normalize("NFC", t)).lower() for t in texts]
        joined = " ".join(t or "" for t in plain)
        code = np.frombuffer((joined + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        n = np.array([len(t or "") for t in plain], np.int64)
        starts = np.cumsum(n + 1) - n - 1
        code = np.minimum(code, LIMIT)
        kind = self.kind[code]
        begin, end = self.words(code, kind)
        odd = np.bincount(np.searchsorted(starts, np.concatenate([np.flatnonzero(kind == ODD), begin[end - begin > MOST_LETTERS]]), "right") - 1, minlength=len(texts)) > 0
        if odd.any():
            kind = np.where(np.repeat(odd, n + 1), SPACE, kind)
            begin, end = self.words(code, kind)
        ids, ends = self.ids_of(joined, code, kind, begin, end)
        cuts = np.searchsorted(begin, starts)
        firsts = np.concatenate([[0], ends])[cuts]
        lasts = np.concatenate([firsts[1:], [len(ids)]])
        return [self.whole(t) if p is None or o else ids[a:b] for t, p, o, a, b in zip(texts, plain, odd, firsts, lasts)]

    def ids_of(self, joined: str, code: np.ndarray, kind: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and where each word's ids end."""
        if not len(begin):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        n = end - begin
        starts = np.cumsum(n) - n
        of = np.arange(int(n.sum()), dtype=np.int32) - np.repeat(starts.astype(np.int32), n)
        # words hold all that is not space
        mixed = self.mix[code[kind != SPACE]]
        mixed *= self.place[of]
        hashes = np.add.reduceat(mixed, starts)
        keys, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if np.count_nonzero(self.young) > CACHE_WORDS:
            self.drop_old()
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        new = np.flatnonzero(~known)
        if len(new):
            words = [joined[a:b] for a, b in zip(begin[where[new]].tolist(), end[where[new]].tolist())]
            self.learn(keys[new], at[new], words)
            at += np.cumsum(~known) - ~known
        self.young[at] = True
        each = self.many[at][inverse]
        ends = np.cumsum(each, dtype=np.int64)
        return self.flat[np.arange(ends[-1]) + np.repeat(self.first[at][inverse] - (ends - each), each)], ends

    def learn(self, keys: np.ndarray, at: np.ndarray, words: list[str]) -> None:
        """Puts words not met before, of ascending hashes ``keys``, in at the places ``at``."""
        ids = np.array(self.bare.encode_batch_fast([by_bytes(" ".join(words))], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):
            raise AssertionError("a word has no end")
        many = np.diff(ends, prepend=0)
        self.first = np.insert(self.first, at, len(self.flat) + ends - many)
        self.many, self.keys = np.insert(self.many, at, many), np.insert(self.keys, at, keys)
        self.young, self.flat = np.insert(self.young, at, True), np.concatenate([self.flat, ids])

    def drop_old(self) -> None:
        """Leaves out the words of the old generation; the young one becomes the old one."""
        first, many = self.first[self.young], self.many[self.young]
        ends = np.cumsum(many)
        self.flat = self.flat[np.arange(ends[-1]) + np.repeat(first - (ends - many), many)]
        self.first, self.many, self.keys = (ends - many).astype(np.int32), many, self.keys[self.young]
        self.young = np.zeros(len(many), bool)


def chunks(ids: list, texts: list, letters: int = 300_000) -> Iterator[tuple[list, list[str]]]:
    """Rows with some ``letters`` characters together; a longer text is alone."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t or "") > letters:
            yield ids[start:i], [t or "" for t in texts[start:i]]
            start, held = i, 0
        held += len(t or "") + 1
    if held:
        yield ids[start:], [t or "" for t in texts[start:]]


def pieces(docs: DataFrame, tokenizer_path: str, window: int, with_ids: bool) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]) of every document, cut."""
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, closing = Encoder(definition.value), np.array([CLOSING], "<u4")
        rows: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in slices(batches):
            for ids, texts in chunks(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                for doc_id, got in zip(ids, coder.encode(texts)):
                    got = np.concatenate([got, closing])
                    for start in range(0, len(got), window):
                        part = got[start : start + window]
                        rows.append((doc_id, start, len(part), zlib.crc32(part), len(got)) + ((part.view("<i4"),) if with_ids else ()))
                        if len(rows) >= (200 if with_ids else 20_000):
                            yield batch_of()
                            rows = []
        if rows:
            yield batch_of()

    kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())] * with_ids
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), cut, schema)


class Capacities:
    """Open windows by remaining capacity, under a segment tree that finds the smallest capacity not below a length."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = bytearray(2 * self.size)
        self.open: dict[int, list[tuple[int, int]]] = {}

    def add(self, capacity: int, first: int, count: int) -> None:
        if not capacity or not count:
            return
        self.open.setdefault(capacity, []).append((first, count))
        i = capacity + self.size
        while i and not self.tree[i]:
            self.tree[i] = 1
            i >>= 1

    def take(self, capacity: int) -> tuple[int, int]:
        groups = self.open[capacity]
        got = groups.pop()
        if not groups:
            i = capacity + self.size
            self.tree[i] = 0
            while i > 1:
                i >>= 1
                self.tree[i] = self.tree[2 * i] | self.tree[2 * i + 1]
        return got

    def tightest(self, length: int) -> int | None:
        i = length + self.size
        if self.tree[i]:
            return length
        while i > 1:
            if not i & 1 and self.tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit_decreasing(counts: dict[int, int], window: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, first sequence, pieces a sequence, offset of the first piece), in order of rank by length.

    Pieces of one length follow each other: the tightest window takes as many as fit before the next one is looked for,
    which is what placing them one by one does, since a window just used is the tightest there is while it still fits.
    """
    runs, spaces, made = [], Capacities(window), 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            capacity = spaces.tightest(length)
            if capacity is None:
                capacity, each = window, window // length
                first, count = made, -(-left // each)
                made += count
            else:
                each = capacity // length
                first, count = spaces.take(capacity)
            used = min(count, -(-left // each))
            spaces.add(capacity, first + used, count - used)
            runs.append((length, rank, first, each, window - capacity))
            placed = min(left, used * each)
            full, last = placed // each, placed % each
            spaces.add(capacity - each * length, first, full)
            if last:
                spaces.add(capacity - last * length, first + full, 1)
            left, rank = left - placed, rank + placed
    return runs


def pack(docs: DataFrame, tokenizer_path: str | None = None, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]), one row a piece."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    # any order within a length will do; the partition's number also parts rows that are equal in all columns
    bucket = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.spark_partition_id()), F.lit(BUCKETS))
    cut = stage(pieces(docs, tokenizer_path, window, with_ids).withColumn("bucket", bucket), "pieces")
    counts = stage(cut.groupBy("length", "bucket").agg(F.count("*").alias("n")), "piece-counts")
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = np.array(sorted(best_fit_decreasing(by_length, window)), np.int64).reshape(-1, 5)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    nth = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32"))
    ranked = cut.withColumn("nth", nth)
    ranked = ranked.join(offsets, ["length", "bucket"]).withColumn("rank", F.col("ahead") + F.col("nth") - 1)
    cast = docs.sparkSession.sparkContext.broadcast(runs)

    @F.pandas_udf(T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        r, length, rank = cast.value, length.to_numpy(), rank.to_numpy()
        run = r[np.searchsorted((r[:, 0] << 44) + r[:, 1], (length << 44) + rank, "right") - 1]
        j = rank - run[:, 1]
        return pd.DataFrame({"sequence_id": run[:, 2] + j // run[:, 3], "offset": run[:, 4] + j % run[:, 3] * length})

    placed = ranked.withColumn("_at", place("length", "rank"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "_at.sequence_id", "_at.offset", *["ids"] * with_ids)
