"""The pipeline against a brute-force version of every stage."""

import re
import zlib
from collections import Counter

import numpy as np
from support import edit_groups
from test_operators import brute_classes

import corpus_pipeline
from tidemark.llm import decontam, language_id
from tidemark.llm.common import table

SF = "/root/testdata/sf0.01"


def brute_lines(rows):
    drop = edit_groups(list(rows.items()))
    out = {}
    for d, t in rows.items():
        lines = t.split("\n")
        left = [x for i, x in enumerate(lines) if (d, i) not in drop]
        if left:
            out[d] = t if len(left) == len(lines) else "\n".join(left)
    return out


def brute_template(text):
    """(literal or placeholder) tokens; names, numbers and units are rare here, so only their kind is compared."""
    raw = re.findall(r"(?:[.!?:;\n\r\"“”¿¡|(\[][\W_]*)?(?:\d+(?:[.,]\d+)*|[^\W\d_]+)", text)
    out = []
    for i, x in enumerate(raw):
        core = re.search(r"[^\W_].*$", x)[0]
        before = re.sub(r"^[\W_]+", "", raw[i - 1])[:1] if i else ""
        if core[0].isdigit():
            out.append("#n")
        elif core == x and core.lower() in decontam.UNITS and before.isdigit():
            out.append("#u")
        elif core in decontam.NAMES or (i and core == x and len(x) > 1 and x[0] != x[0].lower() and x[1:] == x[1:].lower()):
            out.append("#a")
        else:
            out.append(core.lower())
    return out


def brute_contaminated(rows, items):
    bad = set()
    known = {}
    for k, t in items.items():
        w = brute_template(t)
        known[k] = {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
    for d, t in rows.items():
        w = brute_template(t)
        have = {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
        if any(v and len(v & have) >= 0.3 * len(v) for v in known.values()):
            bad.add(d)
    return bad


def test_stages_equal_brute_force(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = table(spark, SF, "documents").where("doc_id < 260")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    frame, columns = docs, docs.columns
    coders = language_id.Coders(language_id.fit(docs.where(~language_id.held_out())), language_id.CHUNK)
    rows = {d: t for d, t in rows.items() if (g := coders.predict(t))[0] != "und" and g[1] >= language_id.MIN_MARGIN}
    items = {r["item_id"]: r["text"] for r in table(spark, SF, "benchmark").collect()}
    for name, function in corpus_pipeline.STAGES[:4]:
        if name == "line_dedup":
            rows = brute_lines(rows)
        elif name == "near_dedup":
            classes = brute_classes(list(rows.items()))
            rows = {d: t for d, t in rows.items() if classes[d] == d}
        elif name == "decontamination":
            bad = brute_contaminated(rows, items)
            rows = {d: t for d, t in rows.items() if d not in bad}
            assert bad
        frame = corpus_pipeline.stage(function(spark, frame, SF), name)
        assert frame.columns == columns
        got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in frame.collect()}
        assert {d: x[0] for d, x in got.items()} == rows, name
        assert all(n == len(t) for t, n in got.values())
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for d, x in rows.items():
        ids = [*t.encode(x, add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), 2048):
            want[d, s, zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())] += 1
    packed = corpus_pipeline.STAGES[4][1](spark, frame, SF).collect()
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in packed) == want
    assert max(Counter({s: sum(r["length"] for r in packed if r["sequence_id"] == s) for s in {r["sequence_id"] for r in packed}}).values()) <= 2048


def test_stages_with_odd_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows, no rows, and columns beyond those of documents."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, node long"
    line = "some words of the first line stand here and go on for a while"
    rows = [(1, None), (2, ""), (3, line), (3, line), (None, line), (4, f"{line}\nand another one that is not like it at all"), (5, "12 34 !!"), (6, "word " * 5000)]
    docs = spark.createDataFrame([(a, b, "en", "s", len(b or ""), 0.5, 1) for a, b in rows], schema)
    for frame in (docs, docs.where("false")):
        for name, function in corpus_pipeline.STAGES[:4]:
            out = function(spark, frame, SF)
            assert out.columns == docs.columns, name
            out.collect()
            frame = out if name == "language_id" else frame
        corpus_pipeline.STAGES[4][1](spark, frame, SF).collect()
