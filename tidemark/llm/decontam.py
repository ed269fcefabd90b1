"""Benchmark decontamination by templates: numbers, names and units become typed placeholders, windows are hash-joined,
and the values in the slots must map one to one. DataFrame functions only.

A token is a run of letters, or a number with its decimal and thousands marks. Lower-cased, it is itself in the template,
but for ``num`` (any number), ``unit`` (a unit word right after a number) and ``name`` (a capitalised word that does not
begin a sentence, or a common given name anywhere). Windows are ``window`` tokens; an item with fewer, but at least
``min_tokens``, is one window. Windows with fewer than four literal tokens (or all but one, if shorter) say nothing and
are left out.

Documents are matched inside their own row: window hashes are probed in a bitmap literal whose size follows the
benchmark (and is bounded), and only windows that hit are exploded and joined to the benchmark's. No text is shuffled.
For each document, item and alignment the slot values must map one to one; the windows of all consistent alignments count
together, and a document is contaminated by an item if they cover ``min_coverage`` of the item's windows.

Defined cases: null or empty texts and items match nothing; null ids are kept as null; repeated rows give one result row;
an empty benchmark or table gives an empty result. Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fence, small, stage

WINDOW, MIN_TOKENS, MIN_COVERAGE = 8, 4, 0.3
MOST_BITS, BROADCAST_ROWS = 1 << 22, 500_000

#: A token, after the mark that ends a sentence before it, if any.
TOKEN = r"(?:[.!?:;\n\r\"“”¿¡|(\[][^\p{L}\p{N}]*)?(?:\p{N}+(?:[.,]\p{N}+)*|\p{L}+)"
UNITS = (
    "mm cm dm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters "
    "millimeter millimeters mg g kg t lb lbs oz gram grams kilogram kilograms ton tons tonne tonnes pound pounds ounce ounces ml cl l liter liters litre litres gallon gallons quart "
    "quarts pint pints cup cups s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years decade decades century centuries "
    "hz khz mhz ghz w kw mw watt watts v volt volts amp amps j kj joule joules cal kcal calorie calories n newton newtons pa kpa bar k c f degree degrees kelvin celsius fahrenheit "
    "percent pct usd eur gbp dollar dollars cent cents euro euros yen penny pence bit bits byte bytes kb mb gb tb kmh mph km2 m2 m3 acre acres hectare hectares dozen mol moles "
    "tag tage stunde stunden jahr jahre meter grad jour jours heure heures an ans dia dias hora horas año años metro metros grado grados"
).split()
NAMES = (
    "Alice Bob Carol Dave David Eve Frank Grace Heidi Ivan Judy Mallory Oscar Peggy Trent Victor Walter John Mary James Robert Michael William Richard Joseph Thomas Charles "
    "Christopher Daniel Matthew Anthony Donald Steven Paul Andrew Joshua Kenneth Kevin Brian George Edward Ronald Timothy Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan "
    "Stephen Larry Justin Scott Brandon Benjamin Samuel Gregory Alexander Patrick Jack Dennis Jerry Tyler Aaron Jose Adam Nathan Henry Zachary Douglas Peter Kyle Noah Ethan Jeremy "
    "Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Betty Sandra Margaret Ashley Kimberly Emily Donna Michelle Amanda Melissa Deborah Stephanie "
    "Rebecca Sharon Laura Cynthia Dorothy Amy Kathleen Angela Shirley Emma Brenda Pamela Nicole Anna Samantha Katherine Christine Helen Debra Rachel Carolyn Janet Maria Catherine "
    "Heather Diane Olivia Julie Joyce Victoria Ruth Virginia Lauren Kelly Christina Joan Evelyn Andrea Hannah Megan Cheryl Jacqueline Martha Madison Teresa Gloria Sara Janice Ann "
    "Kathryn Abigail Sophia Frances Jean Judith Isabella Julia Denise Amber Danielle Brittany Diana Jane Natalie Tom Tim Jim Joe Mike Sam Ben Max Leo Luis Carlos Juan Pedro Pablo "
    "Ana Sofia Lucia Pierre Marie Jean Louis Claude Hans Klaus Anke Jürgen Ahmed Ali Fatima Omar Wei Li Ming Chen Raj Priya Anil Yuki Kenji"
).split()


def template_rows(df: DataFrame, key: str) -> DataFrame:
    """(key, raw array<string>, tokens array<string>): raw tokens, and their lower case or placeholder."""
    rows = df.select(F.col(key).alias(key), F.regexp_extract_all(F.col("text"), F.lit(TOKEN), F.lit(0)).alias("raw"))
    units, names = (", ".join(f"'{x}'" for x in dict.fromkeys(words)) for words in (UNITS, NAMES))
    core = r"regexp_extract(x, '[\\p{L}\\p{N}].*$', 0)"
    number = "({x} >= '0' and {x} < ':')"
    # most tokens are plain lower-case words: they are settled by the first branch
    named = "when {x} in ({names}) then '\x01name'".format(x="{x}", names=names)
    typed = f"""
        transform(raw, (x, i) -> case
          when x >= 'a' and x = lower(x) and x not in ({units}) then x
          when {number.format(x='x')} then '\x01num'
          when i > 0 and lower(x) in ({units}) and {number.format(x="regexp_replace(raw[greatest(i - 1, 0)], '^[^\\\\p{L}\\\\p{N}]+', '')")} then '\x01unit'
          {named.format(x='x')}
          when substr(x, 1, 1) rlike '\\\\p{{L}}' then
            case when i > 0 and length(x) > 1 and substr(x, 1, 1) <> lower(substr(x, 1, 1)) and substr(x, 2) = lower(substr(x, 2)) then '\x01name' else lower(x) end
          when {number.format(x=core)} then '\x01num'
          {named.format(x=core)}
          else lower({core}) end)"""
    return rows.withColumn("raw", fence(F.col("raw"))).withColumn("tokens", fence(F.expr(typed)))


def windows_of(rows: DataFrame, key: str, lengths: list[int], kept: Callable[[Column], Column] | None, whole_if_short: bool) -> DataFrame:
    """(key, pos, h, slots, n): windows of the given lengths, their hash, and the raw values of their placeholders.

    ``kept`` says which hashes are wanted; ``whole_if_short`` makes one window of a row that is
    shorter than the longest.
    """
    longest = max(lengths)
    made = []
    for size in lengths:
        need = size if not whole_if_short or size == longest else None
        span = f"case when size(tokens) >= {size} then sequence(0, size(tokens) - {size}) else array() end" if need else f"case when size(tokens) = {size} then array(0) else array() end"
        made.append(f"transform({span}, i -> named_struct('pos', i, 'size', {size}, 'h', xxhash64(slice(tokens, i + 1, {size}))))")
    spans = made[0] if len(made) == 1 else f"concat({', '.join(made)})"
    if kept is None:
        found = F.expr(spans)
    else:
        found = F.filter(F.expr(spans), lambda w: kept(w["h"]))
    rows = rows.withColumn("found", fence(found))
    slots = "transform(filter(sequence(w.pos, w.pos + w.size - 1), j -> startswith(tokens[j], '\x01')), j -> concat(tokens[j], '\x01', lower(regexp_replace(raw[j], '^[^\\\\p{L}\\\\p{N}]+', ''))))"
    full = f"transform(found, w -> named_struct('pos', w.pos, 'size', w.size, 'h', w.h, 'slots', {slots}))"
    literal = f"filter({full}, w -> w.size - size(w.slots) >= least(4, w.size - 1))"
    return rows.select(F.col(key), F.explode(fence(F.expr(literal))).alias("w")).select(key, "w.pos", "w.size", "w.h", "w.slots")


def bitmap(hashes: np.ndarray) -> tuple[Column, int]:
    """A literal array of longs in which two bits are set for each hash, and its number of bits."""
    bits = 1 << int(np.clip(np.ceil(np.log2(max(1, len(hashes)) * 64)), 10, np.log2(MOST_BITS)))
    words = np.zeros(bits // 64, np.uint64)
    for shift in (0, 32):
        p = (hashes >> shift) & (bits - 1)
        np.bitwise_or.at(words, p >> 6, np.uint64(1) << (p & 63).astype(np.uint64))
    return F.split(F.lit(",".join(map(str, words.view(np.int64).tolist()))), ",").cast("array<bigint>"), bits


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_tokens: int = MIN_TOKENS, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, item_id, windows, item_windows, coverage, slots, reworded): the items that contaminate each document.

    ``slots`` counts distinct slot values; ``reworded`` says that some of them differ from the item's.
    """
    items = stage(template_rows(benchmark.select("item_id", "text"), "item_id"), "templates")
    sizes = [r[0] for r in items.where(F.size("tokens") >= min_tokens).select(F.least(F.lit(window), F.size("tokens"))).distinct().collect()]
    lengths = sorted({*sizes, window})
    known = stage(windows_of(items, "item_id", lengths, None, True).dropDuplicates(["item_id", "pos", "h"]), "item-windows")
    count = known.count()
    probe = None  # above the bound every window is exploded and joined by shuffle
    if count <= BROADCAST_ROWS:
        words, bits = bitmap(np.array([r["h"] for r in known.select("h").distinct().collect()], np.int64))
        bit = lambda h: F.getbit(F.element_at(words, (F.shiftright(h.bitwiseAND(bits - 1), 6) + 1).cast("int")), h.bitwiseAND(63)) == 1
        probe = lambda h: bit(h) & bit(F.shiftright(h, 32))
    hits = windows_of(template_rows(docs.select("doc_id", "text"), "doc_id"), "doc_id", lengths, probe, False)
    of_item = known.select("item_id", F.col("pos").alias("item_pos"), "size", "h", F.col("slots").alias("item_slots"))
    joined = hits.join(F.broadcast(of_item) if count <= BROADCAST_ROWS else of_item, ["h", "size"])
    total = known.groupBy("item_id").agg(F.count_distinct("pos").alias("item_windows"))
    aligned = joined.groupBy("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(
        F.collect_set("item_pos").alias("at"), F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("item_slots", "slots")))).alias("pairs")
    )
    distinct = lambda name: F.size(F.array_distinct(F.col(f"pairs.{name}")))
    consistent = aligned.where((F.size("pairs") == distinct("item_slots")) & (F.size("pairs") == distinct("slots")))
    merged = consistent.groupBy("doc_id", "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("windows"),
        F.max(F.size("pairs")).alias("slots"),
        F.max(F.exists("pairs", lambda p: p["item_slots"] != p["slots"])).alias("reworded"),
    )
    out = merged.join(F.broadcast(total) if count <= BROADCAST_ROWS else total, "item_id")
    coverage = F.col("windows") / F.col("item_windows")
    return out.where(coverage >= min_coverage).select("doc_id", "item_id", "windows", "item_windows", coverage.alias("coverage"), "slots", "reworded")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose document is contaminated by any item; rows without an id stay."""
    bad = stage(contaminated(docs, benchmark).select(F.col("doc_id").alias("_bad")).distinct(), "contaminated")
    return docs.join(small(bad), F.col("doc_id") == F.col("_bad"), "left_anti")
