"""Near-duplicate documents: improved consistent weighted sampling (Ioffe 2010) over TF-IDF shingles, banded, verified.

Shingles are five words (letters and digits, lower case, a character where a script sets no blanks; a text of one to four
words is one shingle); a shingle's weight is its count in the text times ln(1 + N / max(df, N * min_rate)). The inverse
document frequency is thus level below ``min_rate`` of all documents: what the members of a group of copies share is common
because of the group, and a weight that fell with the group's size would take its members apart. So only shingles above that
rate need counts, which are exact over all documents: counts by 2 ** SIEVE_BITS slots leave few slots of that rate (their sum
by slot is the same however rows are split into tasks), and only shingles of those slots are counted by themselves. The
driver gets the shingles of that rate, mean length / min_rate at most, and the slots.

The texts are read once, into a table of shingles and counts. Each text gets ``BANDS * ROWS`` samples (shingle, t). Texts that
share a band are candidates, dropped if their total weights forbid the similarity or if not even ``floor`` of all samples
agree (at similarity 0.8 that happens once in 10 ** 8), then verified by exact weighted Jaccard similarity. Equal texts are
one node throughout. In a bucket of many texts all are first held against the most central one; what is in one
component after that needs no pair, and the rest are compared across components, unless too much of a text's weight is in
shingles that no other text has: a pair can share no more than what either shares with any text. So a group of thousands
of copies costs a star, not all pairs, and no link between components is lost.

Defined cases: a null text is alone; texts without words match equal texts only; repeated rows share their class; the
class id is the smallest doc_id of the class (null if all are null). Only doc_id and text are read; other columns stay
out. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bloom_words, by_value, connected_components, map_arrow, passing, slices, small, stage
from .words import Splitter, chunked

by_value(__name__)

WORDS, BANDS, ROWS, TABLE_BITS, LANE_BITS = 5, 16, 4, 14, 15
SAMPLES = BANDS * ROWS
SMALL, FLOOR = 48, 0.5
PLANE_BITS, SIEVE_BITS, SEGMENTS = 26, 20, 256
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
CHUNK = 300_000


def shingles(h: np.ndarray) -> np.ndarray:
    """uint64 hashes of the shingles of a text with these word hashes, in text order."""
    n = len(h) - WORDS + 1
    if n < 1:
        out = np.array([(h * ODD[: len(h)]).sum(dtype=np.uint64) + np.uint64(len(h))], np.uint64) if len(h) else h
    else:
        out = h[:n] * ODD[0]
        for i in range(1, WORDS):
            out = (out ^ (out >> np.uint64(29))) * ODD[i] + h[i : n + i]
    out = (out ^ (out >> np.uint64(31))) * ODD[4]
    return out ^ (out >> np.uint64(32))


def bag(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a text as 32 bits of their hashes, ascending, and their counts."""
    return np.unique((shingles(h) >> np.uint64(32)).astype(np.uint32), return_counts=True)


def bags(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, node, h array<int>, n array<int>): the texts' shingles and counts; node is a hash of the words in
    order, or of the text if there are none, and null for a null text. n is empty where all counts are one."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter()
        for batch in slices(batches):
            texts = batch["text"].to_pylist()
            for part in chunked(texts):
                some = texts[part]
                hashes, line, firsts = split([t or "" for t in some])
                cuts = np.searchsorted(line, np.append(firsts, np.iinfo(np.int64).max))
                size = np.diff(cuts)
                full = np.flatnonzero(size)
                nodes = np.zeros(len(some), np.int64)
                nodes[full] = split.sequences(hashes, cuts[full], size[full])
                for i in np.flatnonzero(size == 0):
                    nodes[i] = np.uint64(xxhash.xxh64_intdigest("\0" + (some[i] or ""))).view(np.int64)
                hs, ns = zip(*(bag(hashes[a:b]) for a, b in zip(cuts[:-1], cuts[1:])))
                ns = [n if n.max(initial=1) > 1 else n[:0] for n in ns]
                lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)], dtype=np.int32)), pa.array(np.concatenate(x).astype(np.uint32).view(np.int32))) for x in (hs, ns)]
                same = [batch[c].slice(part.start, part.stop - part.start) for c in ("doc_id", "text_key")]
                yield pa.record_batch([*same, pa.array(nodes, mask=np.array([t is None for t in some])), *lists], ["doc_id", "text_key", "node", "h", "n"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("text_key"), "text")
    return map_arrow(rows, found, "doc_id long, text_key long, node long, h array<int>, n array<int>")


def flat_bags(h: pa.Array, n: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, counts, sizes) of lists of both."""
    size, counted = (np.diff(x.offsets.to_numpy()) for x in (h, n))
    hashes = h.flatten().to_numpy().view(np.uint32)
    counts = np.ones(len(hashes), np.int64)
    counts[np.repeat(counted > 0, size)] = n.flatten().to_numpy()
    return hashes, counts, size


def in_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of some CHUNK shingles."""
    for batch in batches:
        held = np.cumsum(np.diff(batch["h"].offsets.to_numpy())) if batch.num_rows else np.zeros(0, np.int64)
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(held, (held[start - 1] if start else 0) + CHUNK, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def frequent(found: DataFrame, min_rate: float) -> tuple[int, np.ndarray, np.ndarray]:
    """(documents, short hashes ascending, document frequencies) of the shingles in at least ``min_rate`` of all documents."""
    total = found.count()
    least = max(1.0, min_rate * total)
    part = (1 << SIEVE_BITS) // SEGMENTS

    def sieved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(1 << SIEVE_BITS, np.int64)
        for batch in in_chunks(batches):
            slots += np.bincount(batch["h"].flatten().to_numpy().view(np.uint32) >> np.uint32(32 - SIEVE_BITS), minlength=len(slots))
        for i, x in enumerate(slots.reshape(SEGMENTS, part)):
            if some := np.flatnonzero(x).tolist():
                yield pa.record_batch([pa.array([i]), pa.array([some], pa.list_(pa.int32())), pa.array([x[some].tolist()], pa.list_(pa.int64()))], ["segment", "slot", "n"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, slot, n in zip(batch["segment"].to_pylist(), batch["slot"], batch["n"]):
                sums.setdefault(i, np.zeros(part, np.int64))[slot.values.to_numpy()] += n.values.to_numpy()
        for i, x in sums.items():
            some = np.flatnonzero(x >= least)
            yield pa.record_batch([pa.array(i * part + some)], ["slot"])

    slots = map_arrow(found.select("h"), sieved, "segment long, slot array<int>, n array<long>")
    parts = min(SEGMENTS, int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    heavy = np.sort(map_arrow(slots.repartition(parts, "segment"), summed, "slot long").toArrow()["slot"].to_numpy())
    if not len(heavy):
        return total, np.zeros(0, np.uint32), np.zeros(0)
    chosen = np.zeros(1 << SIEVE_BITS, bool)
    chosen[heavy] = True
    cast = found.sparkSession.sparkContext.broadcast(np.packbits(chosen))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.unpackbits(cast.value).astype(bool)
        for batch in in_chunks(batches):
            h = batch["h"].flatten().to_numpy().view(np.uint32)
            h, n = np.unique(h[mine[h >> np.uint32(32 - SIEVE_BITS)]], return_counts=True)
            yield pa.record_batch([pa.array(h.astype(np.int64)), pa.array(n)], ["h", "n"])

    got = map_arrow(found.select("h"), counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).orderBy("h").toArrow()
    return total, got["h"].to_numpy().astype(np.uint32), got["n"].to_numpy().astype(float)


class Weights:
    """Weights by short hash and count."""

    def __init__(self, total: int, h: np.ndarray, df: np.ndarray, min_rate: float):
        self.h, self.level = h, float(np.log1p(1 / min_rate))
        self.idf = np.minimum(self.level, np.log1p(max(1, total) / np.maximum(df, 1)))

    def __call__(self, h: np.ndarray, n: np.ndarray) -> np.ndarray:
        w = np.full(len(h), self.level)
        if len(self.h):
            at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
            w = np.where(self.h[at] == h, self.idf[at], w)
        return w * n


class Sampler:
    """The random numbers of improved consistent weighted sampling by (sample, hash slot), and what they give at the usual weight."""

    def __init__(self, level: float):
        rng = np.random.default_rng(20_10)
        size = (SAMPLES, 1 << TABLE_BITS)
        self.r, self.c = (rng.gamma(2.0, 1.0, size).astype(np.float32) for _ in "rc")
        self.b = rng.random(size, np.float32)
        self.odd = rng.integers(1 << 31, 1 << 32, SAMPLES, np.uint32) | np.uint32(1)
        self.level, self.usual = level, [self.at(k, slice(None), np.log(level)) for k in range(SAMPLES)]

    def at(self, k: int, slots, log_w) -> tuple[np.ndarray, np.ndarray]:
        """(a as ordered bits in the upper half, a mix of t)"""
        r, c, b = self.r[k][slots].astype(float), self.c[k][slots], self.b[k][slots]
        t = np.floor(log_w / r + b)
        a = (c * np.exp(-r * (t - b) - r)).astype(np.float32)
        return a.view(np.uint32).astype(np.uint64) << np.uint64(32), t.astype(np.int64).astype(np.uint32) * np.uint32(0x85EBCA6B)

    def __call__(self, h: np.ndarray, w: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """uint64 samples by (segment, sample) for short hashes h of weights w in segments that begin at starts."""
        odd_ones = np.flatnonzero(w != self.level)
        log_w = np.log(np.maximum(w[odd_ones], 1e-9))
        out = np.empty((len(starts), SAMPLES), np.uint64)
        for k in range(SAMPLES):
            at = (h * self.odd[k]) >> np.uint32(32 - TABLE_BITS)
            a, t = self.usual[k]
            key = a[at] | (h ^ t[at]).astype(np.uint64)
            if len(odd_ones):
                a, t = self.at(k, at[odd_ones], log_w)
                key[odd_ones] = a | (h[odd_ones] ^ t).astype(np.uint64)
            out[:, k] = np.minimum.reduceat(key, starts)
        return out


def signatures(found: DataFrame, weights: Weights) -> DataFrame:
    """(doc_id, text_key, node, total, bands array<long>, lanes array<long>); bands and lanes are null for texts without words."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(weights.level)
        for batch in in_chunks(batches):
            h, n, size = flat_bags(batch["h"], batch["n"])
            full = size > 0
            bands: list = [None] * len(size)
            lanes: list = [None] * len(size)
            total = np.zeros(len(size))
            if full.any():
                starts, w = (np.cumsum(size) - size)[full], weights(h, n)
                total[full] = np.add.reduceat(w, starts)
                got = (sampler(h, w, starts) & np.uint64(0xFFFFFFFF)) * ODD[0]
                mixed = got ^ (got >> np.uint64(29))
                b = np.zeros((len(starts), BANDS), np.uint64)
                for i in range(ROWS):
                    b = (b ^ (b >> np.uint64(31)) ^ mixed[:, i::ROWS]) * ODD[i + 1]
                small = mixed >> np.uint64(64 - LANE_BITS)
                x = sum(small[:, i::4] << np.uint64(LANE_BITS * i) for i in range(4))
                for i, bb, ll in zip(np.flatnonzero(full), b.view(np.int64), x.view(np.int64)):
                    bands[i], lanes[i] = bb, ll
            yield pa.record_batch([batch["doc_id"], batch["text_key"], batch["node"], pa.array(total), pa.array(bands, pa.list_(pa.int64())), pa.array(lanes, pa.list_(pa.int64()))], ["doc_id", "text_key", "node", "total", "bands", "lanes"])

    return map_arrow(found, signed, "doc_id long, text_key long, node long, total double, bands array<long>, lanes array<long>")


def agreeing(a: str, b: str) -> Column:
    """How many samples of two rows' lanes are equal; exact, by lane-wise zero tests on the XOR."""
    low = sum(((1 << (LANE_BITS - 1)) - 1) << (LANE_BITS * i) for i in range(4))
    top = sum(1 << (LANE_BITS * i + LANE_BITS - 1) for i in range(4))
    one = lambda i: f"bit_count((~((((({a}[{i}] ^ {b}[{i}]) & {low}L) + {low}L)) | ({a}[{i}] ^ {b}[{i}]))) & {top}L)"
    return F.expr(" + ".join(one(i) for i in range(SAMPLES // 4)))


def verified(pairs: DataFrame, held: DataFrame, weights: Weights, threshold: float) -> DataFrame:
    """(u, v, similarity) of the pairs (u, v) whose bags (node, h, n) have weighted Jaccard similarity ``threshold`` or more."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for whole in batches for b in in_chunks([whole.rename_columns(["u", "v", "h", "n", "g", "m"])])):
            (h, n, p), (g, m, q) = flat_bags(batch["h"], batch["n"]), flat_bags(batch["g"], batch["m"])
            w, z = weights(h, n), weights(g, m)
            # one sorted column of (pair, hash) on either side
            a, b = ((np.repeat(np.arange(len(x), dtype=np.uint64), x) << np.uint64(32)) | y for x, y in ((p, h), (q, g)))
            at = np.minimum(np.searchsorted(b, a), max(len(b) - 1, 0))
            same = np.flatnonzero(b[at] == a) if len(b) else np.zeros(0, np.int64)
            row = lambda x, v: np.bincount(np.repeat(np.arange(len(x)), x), v, len(x))
            both = np.bincount((a[same] >> np.uint64(32)).astype(np.int64), np.minimum(w[same], z[at[same]]), len(p))
            s = both / np.maximum(row(p, w) + row(q, z) - both, 1e-12)
            ok = pa.array(s >= threshold - 1e-9)
            yield pa.record_batch([batch["u"].filter(ok), batch["v"].filter(ok), pa.array(s).filter(ok)], ["u", "v", "similarity"])

    first = pairs.join(held.select(F.col("node").alias("v"), F.col("h").alias("g"), F.col("n").alias("m")), "v")
    both = first.join(held.select(F.col("node").alias("u"), "h", "n"), "u").select("u", "v", "h", "n", "g", "m")
    return map_arrow(both, similar, "u long, v long, similarity double")


def repeated_plane(held: DataFrame) -> np.ndarray:
    """Packed bits by the top ``PLANE_BITS`` of a shingle's hash: whether two or more of the distinct texts have it.

    The size is fixed. Two shingles in one place look repeated, which only weakens the bound made of it.
    """
    n = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = (1 << PLANE_BITS) // SEGMENTS

    def locally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = np.zeros(1 << PLANE_BITS, bool), np.zeros(1 << PLANE_BITS, bool)
        for batch in in_chunks(batches):
            h, _, size_ = flat_bags(batch["h"], batch["n"])
            places = np.unique((np.repeat(np.arange(len(size_), dtype=np.uint64), size_) << np.uint64(PLANE_BITS)) | (h >> np.uint32(32 - PLANE_BITS)))
            at, n_ = np.unique(places & np.uint64((1 << PLANE_BITS) - 1), return_counts=True)
            at = at.astype(np.int64)
            again[at[once[at] | (n_ > 1)]] = True
            once[at] = True
        for i in range(SEGMENTS):
            part = slice(i * size, (i + 1) * size)
            if once[part].any():
                yield pa.record_batch([pa.array([i]), *(pa.array([np.packbits(x[part]).tobytes()]) for x in (once, again))], ["segment", "once", "again"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, once, again = -1, np.zeros(0, np.uint8), np.zeros(0, np.uint8)
        for batch in batches:
            for i, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                if i != at:
                    if at >= 0:
                        yield pa.record_batch([pa.array([at]), pa.array([again.tobytes()])], ["segment", "again"])
                    at, once, again = i, x, y
                else:
                    once, again = once | x, again | y | (once & x)
        if at >= 0:
            yield pa.record_batch([pa.array([at]), pa.array([again.tobytes()])], ["segment", "again"])

    parts = map_arrow(held.select("h", "n"), locally, "segment long, once binary, again binary")
    parts = map_arrow(parts.repartition(min(n, SEGMENTS), "segment").sortWithinPartitions("segment"), merged, "segment long, again binary")
    plane = np.zeros((SEGMENTS, size // 8), np.uint8)
    for r in parts.collect():
        plane[r["segment"]] = np.frombuffer(bytes(r["again"]), np.uint8)
    return plane.ravel()


def shared_weights(held: DataFrame, weights: Weights) -> DataFrame:
    """(node, shared): the weight of each text's shingles that another of the texts may have too."""
    plane = held.sparkSession.sparkContext.broadcast(repeated_plane(held))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_chunks(batches):
            h, n, size = flat_bags(batch["h"], batch["n"])
            at = (h >> np.uint32(32 - PLANE_BITS)).astype(np.int64)
            again = plane.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1
            yield pa.record_batch([batch["node"], pa.array(np.bincount(np.repeat(np.arange(len(size)), size), weights(h, n) * again, len(size)))], ["node", "shared"])

    return map_arrow(held.select("node", "h", "n"), weighed, "node long, shared double")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, min_rate: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """(classes, links): classes has (doc_id, text_key, class_id, kept) for every row of ``docs``, links (u, v, similarity)
    between the texts' hashes. ``kept`` marks the row that stands for its class, the one of smallest (doc_id, text_key)."""
    found = stage(bags(docs.select("doc_id", "text")), "bags")
    weights = Weights(*frequent(found, min_rate), min_rate)
    sig = stage(signatures(found, weights), "sig")
    nodes = sig.where("node is not null").groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.first("total").alias("total"), F.first("bands").alias("bands"), F.first("lanes").alias("lanes"))
    members = nodes.where("bands is not null").select("node", F.posexplode("bands").alias("i", "band")).select(F.xxhash64("i", "band").alias("bucket"), "i", "node")
    shared = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = stage(members.join(shared, "bucket"), "members")
    central = members.groupBy("node").agg(F.sum("size").alias("central"))
    lanes = stage(central.join(nodes.select("node", "total", "bands", "lanes"), "node"), "lanes")

    full = members.join(lanes.select("node", "central", "total", "lanes"), "node")
    side = lambda df, x: df.select("bucket", *[F.col(c).alias(f"{x}_{c}") for c in df.columns if c != "bucket"])
    # no pair shares more weight than the lighter text has
    near = (F.least("a_total", "b_total") >= threshold * F.greatest("a_total", "b_total") - 1e-6) & (agreeing("a_lanes", "b_lanes") >= int(FLOOR * SAMPLES))
    ordered = F.col("a_node") < F.col("b_node")
    few, many = full.where(F.col("size") <= SMALL), full.where(F.col("size") > SMALL)
    few_pairs = side(few, "a").join(side(few, "b"), "bucket").where(ordered & near).select("a_node", "b_node")
    hubs = members.where(F.col("size") > SMALL).join(central, "node").groupBy("bucket").agg(F.max(F.struct("central", "node")).alias("hub")).select("bucket", F.col("hub.node").alias("node"))
    stars = side(hubs.join(lanes.select("node", "total", "lanes"), "node"), "a").join(side(many.select("bucket", "node", "total", "lanes"), "b"), "bucket").where((F.col("a_node") != F.col("b_node")) & near)
    stars = stars.select(F.least("a_node", "b_node").alias("a_node"), F.greatest("a_node", "b_node").alias("b_node"))
    pairs = stage(few_pairs.union(stars).distinct().toDF("u", "v"), "pairs")

    wanted = lanes.select("node")
    # texts of a node have one bag
    held = stage(passing(found.where("node is not null").select("node", "h", "n"), "node", bloom_words(wanted, "node")).join(wanted, "node", "left_semi").dropDuplicates(["node"]), "held")
    links = stage(verified(pairs, held, weights, threshold), "links")

    comps = connected_components(links)
    grouped = many.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = grouped.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    rest = stage(grouped.select("bucket", "i", "node", "comp", "total", "lanes").join(mixed, "bucket", "left_semi"), "rest")
    if rest.head(1):
        # what two texts have in common is at most what either shares with any text, so a similar pair needs that much
        weighed = stage(shared_weights(held.join(rest.select("node").distinct(), "node", "left_semi"), weights), "weighed")
        rest = rest.join(weighed, "node").where(F.col("shared") >= threshold * F.col("total") - 1e-6).join(lanes.select("node", "bands"), "node")
        enough = F.least("a_shared", "b_shared") >= threshold / (1 + threshold) * (F.col("a_total") + F.col("b_total")) - 1e-6
        first = F.expr("forall(zip_with(slice(a_bands, 1, a_i), slice(b_bands, 1, a_i), (x, y) -> x <> y), t -> t)")  # a pair comes from the first band it shares
        more = side(rest, "a").join(side(rest, "b"), "bucket").where(ordered & (F.col("a_comp") != F.col("b_comp")) & enough & near & first)
        more = more.select(F.col("a_node").alias("u"), F.col("b_node").alias("v")).distinct().join(pairs, ["u", "v"], "left_anti")
        new = stage(verified(stage(more, "more"), held, weights, threshold), "links")
        # what is known to be connected is a star by now
        comps = connected_components(new.select("u", "v").union(comps.select(F.col("node").alias("u"), F.col("comp").alias("v"))))
        links = links.union(new)

    of = nodes.select("node", "rep").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    named = stage(of.join(of.groupBy("comp").agg(F.min("rep").alias("best")), "comp").select("node", "best"), "named")
    classes = sig.select("doc_id", "text_key", "node").join(named, "node", "left")
    class_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id"))
    kept = F.col("node").isNull() | F.coalesce((F.col("doc_id") == F.col("best.doc_id")) & (F.col("text_key") == F.col("best.text_key")), F.lit(False))
    return classes.select("doc_id", "text_key", class_id.alias("class_id"), kept.alias("kept")), links


def one_of_each(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one row of each class: the one of the smallest doc_id (rows without an id, or without a text, stay)."""
    classes, _ = near_duplicates(docs, threshold)
    marked = classes.where("doc_id is not null and text_key is not null").groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(F.max("kept").alias("_kept"), F.count("*").alias("_rows"))
    out = stage(marked.where("not _kept or _rows > 1"), "not-kept")
    same = (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_key"))
    once = docs.join(small(out), same, "left_anti")
    repeated = out.where("_kept and _rows > 1")
    if not repeated.head(1):
        return once
    return once.unionByName(docs.join(small(repeated), same, "left_semi").dropDuplicates(["doc_id", "text"]))
