"""License scan by ordered signature rules (:mod:`.license_rules`). DataFrame functions only; map-only, no shuffle.

Words are what ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` matches once A-Z are lower-cased. A text with nothing that
any rule needs is only counted. The others are written as their words, each between two blanks, so that patterns meet whole words
and neighbours share no character; a rule runs where its keyword occurs. A detection is a span of words. It is suppressed
where a detection of the same or a higher priority contains it (of two equal spans of one priority the earlier rule
stays): one pass over the spans in order, keeping the furthest end by priority.

Base labels are those of the phrases ``mit license``, ``apache license`` and ``general public license`` at any place;
suppression takes none of them away.

Defined cases: a null text is empty; repeated rows give a row each; an empty table an empty result; only doc_id and text
are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fence
from .license_rules import rules

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CONFIDENCE = {1: 0.6, 2: 0.9, 3: 1.0}


def spaced(pattern: str) -> str:
    """The pattern over words of which each stands between two blanks."""
    return " " + pattern.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(  )?") + " "


def gate(listed: list[tuple[str, int, str, str]]) -> list[str]:
    """Stems of which lower-case text holds at least one wherever any rule matches: a general stem, where the pattern
    always has it, or else the longest word of the keyword."""
    general = ["licen", "gpl", "copyright", "spdx", "warrant"]
    return list(dict.fromkeys([*general, *(max(k.split(), key=len) for _, _, k, p in listed if not always(p, general))]))


def always(pattern: str, stems_: list[str]) -> bool:
    """Whether every match holds one of the stems: it stands in the pattern outside optional and alternative parts."""
    depth, kept = 0, []
    for c in pattern:
        depth += c == "("
        if not depth:
            kept.append(c)
        depth -= c == ")"
    plain = "".join(kept)
    return "|" not in plain and any(s in plain for s in stems_)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections).

    ``detections`` has every span (first word, word after the last, priority, rule, label), suppressed or not, in order.
    """
    listed = rules()
    base_ids = {i + 1: label for i, (label, _, _, p) in enumerate(listed) if BASE.get(p) == label}
    table = ", ".join(f"named_struct('kw', '{k.replace(' ', '  ')}', 'rx', '{spaced(p)}', 'p', {pr}, 'i', {i + 1}, 'label', '{label}')" for i, (label, pr, k, p) in enumerate(listed))
    count = lambda s: f"cast((length({s}) - length(replace({s}, ' ', ''))) div 2 as int)"
    span = "struct<s:int,ne:int,np:int,i:int,label:string>"
    per_rule = f"""
        aggregate(sequence(0, size(h.m) - 1), named_struct('at', 0, 'out', cast(array() as array<{span}>)),
          (a, k) -> named_struct('at', a.at + {count('h.g[k]')} + {count('h.m[k]')},
            'out', concat(a.out, array(named_struct('s', a.at + {count('h.g[k]')}, 'ne', -(a.at + {count('h.g[k]')} + {count('h.m[k]')}), 'np', -h.p, 'i', h.i, 'label', h.label)))),
          a -> a.out)"""
    hits = f"""filter(transform(filter(array({table}), r -> contains(norm, r.kw)),
          r -> named_struct('m', regexp_extract_all(norm, r.rx, 0), 'g', split(norm, r.rx, -1), 'p', r.p, 'i', r.i, 'label', r.label)), h -> size(h.m) > 0)"""
    found = f"case when norm is null then cast(array() as array<{span}>) else array_sort(flatten(transform({hits}, h -> {per_rule}))) end"
    # furthest ends so far of spans of priority 1, 2 and 3 or higher
    sweep = """
        aggregate(spans, named_struct('e1', -1, 'e2', -1, 'e3', -1, 'labels', cast(array() as array<string>), 'best', 0),
          (a, d) -> named_struct(
            'e1', greatest(a.e1, -d.ne),
            'e2', case when -d.np >= 2 then greatest(a.e2, -d.ne) else a.e2 end,
            'e3', case when -d.np >= 3 then greatest(a.e3, -d.ne) else a.e3 end,
            'labels', case when (case -d.np when 1 then a.e1 when 2 then a.e2 else a.e3 end) >= -d.ne then a.labels else array_union(a.labels, array(d.label)) end,
            'best', case when (case -d.np when 1 then a.e1 when 2 then a.e2 else a.e3 end) >= -d.ne then a.best else greatest(a.best, -d.np) end))"""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", fence(F.lower("text")).alias("low"), fence(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"))
    gated = reduce(Column.__or__, [F.contains("low", F.lit(x)) for x in gate(listed)])
    rows = rows.select("doc_id", gated.alias("gated"), "words")
    norm = F.concat(F.lit(" "), F.translate(F.array_join("words", "  "), UPPER, LOWER), F.lit(" "))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), fence(F.when(F.col("gated") & (F.size("words") > 0), norm)).alias("norm"))
    rows = rows.select("doc_id", "n_words", fence(F.expr(found)).alias("spans"))
    base = f"filter(spans, d -> d.i in ({', '.join(map(str, base_ids))}))"
    rows = rows.select("*", fence(F.expr(sweep)).alias("kept"), fence(F.expr(base)).alias("base"))
    labels = F.array_sort(F.array_distinct(F.col("base.label")))
    best = F.col("kept.best")
    score = F.when(best == 3, CONFIDENCE[3]).when(best == 2, CONFIDENCE[2]).when(best == 1, CONFIDENCE[1]).otherwise(0.0)
    return rows.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.s").cast("long").alias("first_word"),
        F.array_max("base.s").cast("long").alias("last_word"),
        F.array_join(labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(labels, F.col("kept.labels"))), ",").alias("labels"),
        score.alias("score"),
        F.transform("spans", lambda d: F.struct(d["s"].alias("first"), (-d["ne"]).alias("end"), (-d["np"]).alias("priority"), d["i"].alias("rule"), d["label"].alias("label"))).alias("detections"),
    )
