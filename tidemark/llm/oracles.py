"""DuckDB SQL for the queries that SQL can express; written from the contracts, apart from the Spark code."""

from __future__ import annotations

from .decontam import MIN_COVERAGE, MIN_TOKENS, NAMES, TOKEN, UNITS, WINDOW
from .license_rules import rules
from .license_scan import CONFIDENCE, spaced


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in dict.fromkeys(words))


def decontamination() -> str:
    number = "({0} >= '0' AND {0} < ':')".format
    core = r"regexp_extract(x, '[\p{L}\p{N}].*$')"
    strip = r"regexp_replace(raw[i - 1], '^[^\p{L}\p{N}]+', '')"
    typed = f"""CASE WHEN {number('x')} THEN chr(1) || 'num'
      WHEN i > 1 AND lower(x) IN ({_quoted(UNITS)}) AND {number(strip)} THEN chr(1) || 'unit'
      WHEN {core} IN ({_quoted(NAMES)}) THEN chr(1) || 'name'
      WHEN {number(core)} THEN chr(1) || 'num'
      WHEN i > 1 AND regexp_matches(x[1:1], '\\p{{L}}') AND length(x) > 1 AND x[1:1] <> lower(x[1:1]) AND x[2:] = lower(x[2:]) THEN chr(1) || 'name'
      ELSE lower({core}) END"""
    tokens = f"list_transform(raw, lambda x, i: {typed})"
    slots = r"list_transform(list_filter(range(pos, pos + size), lambda j: starts_with(tokens[j + 1], chr(1))), lambda j: tokens[j + 1] || chr(1) || lower(regexp_replace(raw[j + 1], '^[^\p{L}\p{N}]+', '')))"
    raw = f"regexp_extract_all(text, '{TOKEN}')"
    return f"""
    WITH d AS (SELECT doc_id, {raw} AS raw FROM documents), dt AS (SELECT doc_id, raw, {tokens} AS tokens FROM d),
    b AS (SELECT item_id, {raw} AS raw FROM benchmark), bt AS (SELECT item_id, raw, {tokens} AS tokens FROM b),
    sizes AS (SELECT DISTINCT least({WINDOW}, len(tokens)) AS size FROM bt WHERE len(tokens) >= {MIN_TOKENS}),
    bp AS (SELECT *, unnest(range(0, len(tokens) - size + 1)) AS pos FROM (SELECT *, least({WINDOW}, len(tokens)) AS size FROM bt WHERE len(tokens) >= {MIN_TOKENS})),
    bw AS (SELECT item_id, pos AS item_pos, size, array_to_string(tokens[pos + 1 : pos + size], ' ') AS h, {slots} AS item_slots FROM bp),
    known AS (SELECT * FROM bw WHERE size - len(item_slots) >= least(4, size - 1)),
    dp AS (SELECT *, unnest(range(0, len(tokens) - size + 1)) AS pos FROM dt, sizes WHERE len(tokens) >= size),
    dw AS (SELECT *, array_to_string(tokens[pos + 1 : pos + size], ' ') AS h FROM dp),
    hits AS (SELECT doc_id, pos, item_id, item_pos, item_slots, {slots.replace("size)", "dw.size)")} AS slots FROM dw JOIN known ON known.h = dw.h AND known.size = dw.size),
    pairs AS (SELECT doc_id, item_id, pos - item_pos AS shift, item_pos, unnest(CASE WHEN len(item_slots) = 0 THEN [NULL] ELSE item_slots END) AS a, unnest(CASE WHEN len(slots) = 0 THEN [NULL] ELSE slots END) AS b FROM hits),
    aligned AS (SELECT doc_id, item_id, shift, count(DISTINCT (a, b)) FILTER (a IS NOT NULL) AS n, count(DISTINCT a) AS na, count(DISTINCT b) AS nb, list(DISTINCT item_pos) AS spots, coalesce(bool_or(a <> b), false) AS reworded FROM pairs GROUP BY ALL),
    merged AS (SELECT doc_id, item_id, len(list_distinct(flatten(list(spots)))) AS windows, max(n) AS slots, bool_or(reworded) AS reworded FROM aligned WHERE n = na AND n = nb GROUP BY ALL),
    total AS (SELECT item_id, count(DISTINCT item_pos) AS item_windows FROM known GROUP BY ALL)
    SELECT doc_id, item_id, CAST(windows AS INTEGER) AS windows, item_windows, windows / item_windows AS coverage, CAST(slots AS INTEGER) AS slots, reworded
    FROM merged JOIN total USING (item_id) WHERE windows / item_windows >= {MIN_COVERAGE}"""


def license_labels() -> str:
    listed = ", ".join(f"({i}, '{label}', {p}, '{kw.replace(' ', '  ')}', '{spaced(rx)}')" for i, (label, p, kw, rx) in enumerate(rules()))
    count = "((length({0}) - length(replace({0}, ' ', ''))) / 2)".format
    score = " ".join(f"WHEN {p} THEN {c}" for p, c in CONFIDENCE.items())
    phrases = "('mit  license', 'mit'), ('apache  license', 'apache'), ('general  public  license', 'gpl')"
    spans = "regexp_extract_all(norm, {rx}) AS m, string_split_regex(norm, {rx}) AS g"
    start = f"list_sum(list_transform(g[1:k], lambda x: {count('x')})) + coalesce(list_sum(list_transform(m[1 : k - 1], lambda x: {count('x')})), 0)"
    return f"""
    WITH rules(i, label, p, kw, rx) AS (VALUES {listed}), phrases(phrase, label) AS (VALUES {phrases}),
    d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
    n AS (SELECT doc_id, len(words) AS n_words, ' ' || array_to_string(words, '  ') || ' ' AS norm FROM d),
    hit AS (SELECT doc_id, i, label, p, {spans.format(rx='rx')} FROM n JOIN rules ON contains(norm, kw)),
    each AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM hit WHERE len(m) > 0),
    found AS (SELECT doc_id, i, label, p, {start} AS s, {start} + {count('m[k]')} AS e FROM each),
    kept AS (SELECT doc_id, label, p FROM found f WHERE NOT EXISTS (SELECT 1 FROM found o WHERE o.doc_id = f.doc_id AND o.s <= f.s AND o.e >= f.e
      AND (o.p > f.p OR (o.p = f.p AND (o.e - o.s > f.e - f.s OR (o.s = f.s AND o.e = f.e AND o.i < f.i)))))),
    bhit AS (SELECT doc_id, label, {spans.format(rx="' ' || phrase || ' '")} FROM n JOIN phrases ON contains(norm, ' ' || phrase || ' ')),
    beach AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM bhit),
    base AS (SELECT doc_id, label, {start} AS s FROM beach),
    labels AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM kept) GROUP BY doc_id),
    best AS (SELECT doc_id, max(p) AS p FROM kept GROUP BY doc_id),
    bases AS (SELECT doc_id, count(*) AS n_base, min(s) AS first_word, max(s) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels,
      coalesce(labels, '') AS labels, CAST(CASE p {score} ELSE 0 END AS DOUBLE) AS score
    FROM n LEFT JOIN bases USING (doc_id) LEFT JOIN labels USING (doc_id) LEFT JOIN best USING (doc_id)"""


def revisits() -> str:
    return r"""
    WITH c AS (SELECT page_id, html, regexp_replace(trim(url), '#.*$', '') AS c FROM pages),
    parts AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(c, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)', 1)), ':(80|443)?$', ''), '^www\.', '') AS host,
      regexp_replace(regexp_extract(c, '^[^:]*://[^/?]*([^?]*)', 1), '/+$', '') AS path,
      array_to_string(list_sort(list_filter(string_split(regexp_extract(c, '\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '(?i)^(utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid)(=.*)?$'))), '&') AS query FROM c),
    k AS (SELECT page_id, html, CASE WHEN coalesce(host, '') = '' THEN '' ELSE host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS url_key, '"' || md5(coalesce(html, '')) || '"' AS tag FROM parts),
    ask AS (SELECT page_id * 2 + 1 AS record_id, url_key, page_id * 10 + 5005 AS date, page_id % 8 AS kind, tag, 'day ' || page_id AS day FROM k),
    have AS (SELECT page_id * 2 AS response_id, url_key, page_id * 10 AS date, tag AS stored, 'day ' || page_id AS stored_day, html FROM k WHERE url_key <> ''),
    j AS (SELECT ask.*, response_id, stored, stored_day, html FROM ask ASOF LEFT JOIN have ON ask.url_key = have.url_key AND ask.date > have.date),
    o AS (SELECT *, CASE WHEN response_id IS NULL THEN 'missing' WHEN kind = 6 THEN 'unchecked' WHEN kind = 5 THEN CASE WHEN day = stored_day THEN 'resolved' ELSE 'mismatch' END
      WHEN kind <> 4 AND tag = stored THEN 'resolved' ELSE 'mismatch' END AS outcome FROM j),
    h AS (SELECT *, outcome IN ('resolved', 'unchecked') AS done FROM o)
    SELECT record_id, url_key, CASE WHEN done THEN response_id END AS response_id, outcome, CAST(CASE WHEN done THEN 200 ELSE 304 END AS INTEGER) AS status,
      array_to_string(list_sort(CASE WHEN done THEN ['content-type=text/html',
          'cache-control=' || CASE WHEN kind IN (3, 5, 6) THEN 'max-age=60' ELSE 'no-cache' END,
          'etag=' || CASE WHEN kind = 3 THEN 'W/' || tag WHEN kind IN (5, 6) THEN stored ELSE tag END,
          'last-modified=' || CASE WHEN kind = 5 THEN day ELSE stored_day END] || CASE kind WHEN 5 THEN ['expires=never'] WHEN 6 THEN ['date=today'] ELSE [] END
        WHEN kind = 3 THEN ['etag=W/' || tag, 'content-length=0'] WHEN kind = 4 THEN ['etag="outdated"'] WHEN kind = 5 THEN ['last-modified=' || day, 'expires=never'] WHEN kind = 6 THEN ['date=today']
        ELSE ['etag=' || tag, 'cache-control=no-cache', 'server=x'] END), ';') AS headers,
      CASE WHEN done THEN md5(html) END AS payload_md5 FROM h"""
