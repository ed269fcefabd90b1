"""Language identification by compression: the language whose zstandard raw-content dictionary encodes a text shortest.

Fitting takes a bounded sample: at most ``per_lang`` labelled rows a language, each at most ``row_chars`` characters, and
``dict_bytes`` bytes of dictionary. Prediction reads every whole text in chunks of ``chunk`` bytes, each encoded on its
own with each dictionary, so that a long text cannot become its own dictionary. Map-only: no shuffle after fitting.

Defined cases: a null text, or one without letters, is ``und`` with score 0 and is rejected; equal sizes (very short
texts) go to the language whose dictionary holds the text's letter triples most often, then to the smaller name;
without any labelled row every text is ``und``. Repeated rows stay; other columns are carried, but for those of an
output's name, which ``predict`` replaces.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value

by_value(__name__)

LEVEL, SEPARATOR, CHUNK, MIN_MARGIN = 6, b" ", 4096, 0.01


def letters_of(text: str) -> bytes:
    """Lower-cased runs of letters, joined by spaces."""
    import regex

    return " ".join(regex.findall(r"\p{L}+", text.lower())).encode("utf-8", "ignore")


def fit(rows: DataFrame, per_lang: int = 100, row_chars: int = 16384, dict_bytes: int = 112_000) -> dict[str, bytes]:
    """Dictionaries by language from columns (doc_id, text, lang); rows without id, text or language are ignored.

    The rows with the smallest hashes of doc_id are chosen from ids alone, then read again by id: the driver gets at most
    ``per_lang`` texts a language, and no text is shuffled but those.
    """
    rows = rows.where("doc_id is not null and lang is not null and text is not null")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = rows.select("lang", "doc_id").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= per_lang).select("doc_id").collect()
    chosen = sorted({r["doc_id"] for r in ids})
    sample = rows.where(F.col("doc_id").isin(chosen)).groupBy("lang", "doc_id").agg(F.min(F.substring("text", 1, row_chars)).alias("text"))
    out: dict[str, bytes] = {}
    for r in sorted(sample.collect(), key=lambda r: (r["lang"], r["doc_id"])):
        have, more = out.get(r["lang"], b""), letters_of(r["text"])
        if more and len(have) < dict_bytes:
            out[r["lang"]] = have + SEPARATOR + more[: dict_bytes - len(have)]
    return out


class Coders:
    """Compressors of all dictionaries; made once a task."""

    def __init__(self, dictionaries: dict[str, bytes], chunk: int):
        self.chunk, self.raw = chunk, dict(sorted(dictionaries.items()))
        self.by = {}
        for lang, content in self.raw.items():
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.by[lang] = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, margin): the margin is 1 - smallest / second smallest size."""
        data = letters_of(text) if text else b""
        if not data or not self.by:
            return "und", 0.0
        parts = [data[i : i + self.chunk] for i in range(0, len(data), self.chunk)]
        sizes = sorted((sum(len(c.compress(p)) for p in parts), lang) for lang, c in self.by.items())
        if len(sizes) == 1:
            return sizes[0][1], 1.0
        tied = [lang for size, lang in sizes if size == sizes[0][0]]
        if len(tied) > 1:
            triples = {data[i : i + 3] for i in range(max(1, len(data) - 2))}
            share = {lang: sum(min(self.raw[lang].count(t), 50) for t in triples) for lang in tied}
            best = sorted(tied, key=lambda x: (-share[x], x))
            return best[0], 0.5 * (share[best[0]] - share[best[1]]) / max(1, share[best[0]])
        return sizes[0][1], 1 - sizes[0][0] / sizes[1][0]


def guessed(docs: DataFrame, dictionaries: dict[str, bytes], chunk: int) -> DataFrame:
    """``docs`` plus _guess struct(lang_pred, margin)."""

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("margin", T.DoubleType())]))
    def guess(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coders = Coders(dictionaries, chunk)
        for batch in texts:
            yield pd.DataFrame([coders.predict(x) for x in batch], columns=["lang_pred", "margin"])

    return docs.withColumn("_guess", guess("text"))


def narrow(min_margin: float) -> Column:
    return (F.col("_guess.lang_pred") == "und") | (F.col("_guess.margin") < min_margin)


def predict(docs: DataFrame, dictionaries: dict[str, bytes], chunk: int = CHUNK, min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` plus lang_pred string, score double (0 to 1) and rejected boolean (margin under ``min_margin`` or ``und``)."""
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_guess.margin")))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    return guessed(docs, dictionaries, chunk).select(*kept, F.col("_guess.lang_pred").alias("lang_pred"), score.alias("score"), narrow(min_margin).alias("rejected"))


def keep_sure(docs: DataFrame, dictionaries: dict[str, bytes], chunk: int = CHUNK, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns."""
    return guessed(docs, dictionaries, chunk).where(~narrow(min_margin)).select(*docs.columns)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that fitting must not see: crc32 of the id's text mod 3 is 1 (null ids: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))
