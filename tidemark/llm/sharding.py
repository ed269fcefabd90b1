"""Sharding by histogram sort: shards of near equal bytes, cut from the order (text hash, doc_id). DataFrame functions only.

Rounds of exact counting refine candidate boundaries: the key range is split at equally wide probes, bytes and rows
between them are counted over all partitions, and only cells that hold a splitter without a boundary within
``tolerance`` of its target are split again. Equal texts are neighbours, and a splitter falls between texts if that is
within ``group_tolerance``; otherwise it cuts the group of copies by doc_id, so that a text that a third of all rows hold
does not unbalance a shard. Cells with many rows are split the same way. Each row then finds its cell in a small table,
and one exchange by cell numbers the rows of each shard without gaps.

What the driver holds is bounded by the number of probes, not by the data. The counting rounds read a staged narrow table
of (hash, doc_id, size).

Defined cases: a null text has size 1 and is not equal to an empty one; null ids sort as 0; repeated rows with one id and
text stay in one cell and are numbered in it; an empty table gives an empty result. Other columns are carried, but for
those of an output's name, which are replaced.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

FIRST_PROBES, PROBES, CELLS = 4096, 64, 1024
OUTPUT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def key_columns() -> dict[str, Column]:
    return {
        "_k": F.shiftrightunsigned(F.xxhash64("text", F.col("text").isNull()), 2),
        "_d": F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)")),
        "size": (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long"),
    }


class Cell:
    """Rows of an interval of keys: counted bytes and rows, and the smallest and largest key parts there."""

    def __init__(self, root: int, size: int, rows: int, k0: int, k1: int, d0: int, d1: int):
        self.root, self.size, self.rows, self.k, self.d = root, size, rows, (k0, k1), (int(d0), int(d1))

    @property
    def one_text(self) -> bool:
        return self.k[0] == self.k[1]

    @property
    def whole(self) -> bool:
        return self.one_text and self.d[0] == self.d[1]


def counted(keys: DataFrame, cells: list[Cell], probes: int) -> list[list[Cell]]:
    """Each of the cells, split at equally wide probes; one pass over the keys, cells * probes rows at most to the driver."""
    which, part = F, F
    for i, c in enumerate(cells):
        inside = F.col("_k").between(*c.k)
        if c.one_text:
            inside &= F.col("_d").between(*c.d)
            low, width, key = c.d[0], (c.d[1] - c.d[0]) // probes + 1, F.col("_d")
        else:
            low, width, key = c.k[0], (c.k[1] - c.k[0]) // probes + 1, F.col("_k").cast("decimal(20,0)")
        at = F.floor((key - F.lit(low).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)")) if c.one_text else F.expr(f"(_k - {low}L) div {width}L")
        which, part = which.when(inside, i), part.when(inside, at.cast("int"))
    rows = keys.select(which.alias("cell"), part.alias("part"), "*").where("cell is not null")
    got = rows.groupBy("cell", "part").agg(F.sum("size").alias("size"), F.count("*").alias("rows"), F.min("_k").alias("k0"), F.max("_k").alias("k1"), F.min("_d").alias("d0"), F.max("_d").alias("d1")).collect()
    out: list[list[Cell]] = [[] for _ in cells]
    for r in sorted(got, key=lambda r: (r["cell"], r["part"])):
        root = cells[r["cell"]].root if cells[r["cell"]].root >= 0 else r["part"]
        out[r["cell"]].append(Cell(root, r["size"], r["rows"], r["k0"], r["k1"], r["d0"], r["d1"]))
    return out


def refined(keys: DataFrame, shards: int, tolerance: float, group_tolerance: float) -> tuple[list[Cell], list[int], tuple[int, int]]:
    """(cells in key order, index of the first cell of each shard, (lowest key, width) of the first split)."""
    whole = keys.agg(F.sum("size").alias("size"), F.count("*").alias("rows"), F.min("_k").alias("k0"), F.max("_k").alias("k1"), F.min("_d").alias("d0"), F.max("_d").alias("d1")).first()
    if not whole["rows"]:
        return [], [0] * shards, (0, 1)
    total, ideal = whole["size"], whole["size"] / shards
    base = whole["k0"], (whole["k1"] - whole["k0"]) // FIRST_PROBES + 1
    root = Cell(-1, total, whole["rows"], whole["k0"], max(whole["k1"], whole["k0"] + 1), whole["d0"], whole["d1"])
    cells = counted(keys, [root], FIRST_PROBES)[0]
    most_rows = max(200, 4 * whole["rows"] // CELLS)
    while True:
        ends, at = [], 0
        for c in cells:
            at += c.size
            ends.append(at)
        firsts, again = [0], set()
        for s in range(1, shards):
            target = s * ideal
            i = next(j for j, e in enumerate(ends) if e >= target - 1e-9)
            before = ends[i] - cells[i].size
            nearest = min(target - before, ends[i] - target)
            firsts.append(i if target - before < ends[i] - target else i + 1)
            allowed = group_tolerance if cells[i].one_text else tolerance
            if nearest > allowed * ideal and not cells[i].whole:
                again.add(i)
        again |= {i for i, c in enumerate(cells) if c.rows > most_rows and not c.whole}
        if not again:
            return cells, firsts, base
        split = dict(zip(sorted(again), counted(keys, [cells[i] for i in sorted(again)], PROBES)))
        cells = [x for i, c in enumerate(cells) for x in split.get(i, [c])]


def shard_by_bytes(docs: DataFrame, shards: int = 8, tolerance: float = 0.001, group_tolerance: float = 0.01) -> DataFrame:
    """``docs`` plus size, text_crc32, law ('bytes'), shard, slot (gapless from 0 in each shard) and grown_shard (null)."""
    docs = docs.drop(*OUTPUT)
    keyed = docs.withColumns(key_columns())
    keys = stage(keyed.select("_k", "_d", "size"), "shard-keys")
    cells, firsts, (low, width) = refined(keys, shards, tolerance, group_tolerance)
    rows, shard, slot = [], 0, 0
    for i, c in enumerate(cells):
        while shard + 1 < shards and firsts[shard + 1] <= i:
            shard, slot = shard + 1, 0
        rows.append({"root": c.root, "cell": i, "k0": c.k[0], "k1": c.k[1], "d0": c.d[0], "d1": c.d[1], "by_doc": c.one_text, "to": shard, "ahead": slot})
        slot += c.rows
    kind = "array<struct<root:int,cell:int,k0:bigint,k1:bigint,d0:decimal(20,0),d1:decimal(20,0),by_doc:boolean,to:int,ahead:bigint>>"
    table = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), F.lit(kind)))).select(*[F.col(c).alias(f"_{c}") for c in ("root", "cell", "k0", "k1", "d0", "d1", "by_doc", "to", "ahead")])
    placed = keyed.join(
        F.broadcast(table),  # at most a few thousand rows: FIRST_PROBES, and PROBES for each cell split again
        (F.expr(f"cast((_k - {low}L) div {width}L as int)") == F.col("_root")) & F.col("_k").between(F.col("_k0"), F.col("_k1")) & (~F.col("_by_doc") | F.col("_d").between(F.col("_d0"), F.col("_d1"))),
    )
    nth = F.row_number().over(Window.partitionBy("_cell").orderBy("_k", "_d"))
    return placed.select(
        *docs.columns,
        "size",
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_to").alias("shard"),
        (F.col("_ahead") + nth - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
