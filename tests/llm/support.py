"""Small tables and the brute-force version of line groups."""

import random
import re
from collections import defaultdict

from tidemark.llm import line_dedup

UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3041-\u309f\u30a1-\u30fa\u30fc-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
SCHEMA = "doc_id long, text string, lang string, node long, size string, key int, score string"


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(n))


def frame(spark, texts, first=0):
    """Documents with columns whose names clash with inner ones."""
    return spark.createDataFrame([(first + i, t, "en", 1, "x", 2, "y") for i, t in enumerate(texts)], SCHEMA)


def line_words(text):
    """(line, words) of the lines with a word."""
    for i, line in enumerate(text.split("\n")):
        words = re.findall(f"[{UNSPACED}]|[^\\W_{UNSPACED}]+", line.lower())
        if words:
            yield i, words


def edit_groups(rows):
    """The occurrences to drop by edit similarity alone: every pair of lines is compared."""
    seen = [(d, i, w) for d, t in rows if d is not None and t is not None for i, w in line_words(t)]
    sets = [set(w) for _, _, w in seen]
    up = list(range(len(seen)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(seen)):
        for j in range(i):
            a, b = seen[i][2], seen[j][2]
            most = max(len(a), len(b))
            # each word of one that the other lacks costs an edit
            if abs(len(a) - len(b)) <= 0.2 * most and len(sets[i] - sets[j]) <= 0.2 * most and top(i) != top(j) and line_dedup.edit_distance(a, b) <= 0.2 * most:
                up[top(i)] = top(j)
    groups = defaultdict(set)
    for i, (d, line, _) in enumerate(seen):
        groups[top(i)].add((d, line))
    return {x: min(g) for g in groups.values() for x in g if x != min(g)}
