"""SQL of DuckDB with the same results as the queries, where SQL can say them.

Fingerprints by XXH64, trained models, histograms by Unicode class and files are beyond it. Rules, phrases and
templates are put in from the operators' own lists. License templates are compared with every run of words here, without
the filters.
"""

from __future__ import annotations

import math
import re

from strata.llm import licenses, mixing, secrets

WORDS = r"regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strings(items) -> str:
    return "[" + ", ".join(map(quoted, items)) + "]"


def mixing_sql(targets: dict[str, float], otherwise: float) -> str:
    """The mixture to these weights."""
    whens = " ".join(f"WHEN {quoted(k)} THEN {v}" for k, v in targets.items())
    return f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
weighed AS (SELECT source, n, CASE source {whens} ELSE {otherwise} END::DOUBLE AS weight FROM counts),
rates AS (SELECT source, weight / (SELECT sum(weight) FROM weighed) * (SELECT sum(n) FROM weighed) / n AS rate FROM weighed),
means AS (SELECT source, ceil(rate / {mixing.LARGEST_MEAN})::INT AS draws, rate / ceil(rate / {mixing.LARGEST_MEAN}) AS mean FROM rates),
steps AS (
    SELECT source, mean, 0 AS k, exp(-mean) AS term, exp(-mean) AS total FROM means
    UNION ALL
    SELECT source, mean, k + 1, term * mean / (k + 1), total + term * mean / (k + 1) FROM steps WHERE k < ceil(mean + 12 * sqrt(mean) + 40)
),
cdf AS (SELECT source, list(total) AS totals FROM steps GROUP BY source),
rows AS (SELECT *, row_number() OVER () AS row_no FROM documents),
draws AS (
    SELECT row_no, source, ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || d), 1, 13))::BIGINT / {1 << 52}.0::DOUBLE AS u
    FROM (SELECT r.row_no, r.doc_id, r.source, unnest(range(1, m.draws + 1)) AS d FROM rows r JOIN means m ON r.source IS NOT DISTINCT FROM m.source)
),
times AS (
    SELECT row_no, sum(len(list_filter(totals, lambda x: x <= u)))::BIGINT AS n
    FROM draws JOIN cdf ON draws.source IS NOT DISTINCT FROM cdf.source GROUP BY row_no
),
copies AS (SELECT rows.* EXCLUDE (row_no), unnest(range(1, n + 1))::INT AS copy FROM rows JOIN times USING (row_no))
SELECT *, md5('{mixing.SEED}:order:' || coalesce(doc_id::VARCHAR, '') || ':' || copy) AS shuffle_key FROM copies
"""


#: Target weights of the registered mixture: three sources are raised or lowered, all others have one part each.
TARGETS, OTHERWISE = {"src0": 4.0, "src1": 0.25, "src2": 2.5}, 1.0
MIXING = mixing_sql(TARGETS, OTHERWISE)


def in_either_case(pattern: str) -> str:
    """A Java pattern's ``((?i)a|b)`` spelled as classes of two letters, which mean the same everywhere."""
    return re.sub(r"\(\(\?i\)([^)]*)\)", lambda m: "(" + re.sub("[a-z]", lambda c: f"[{c[0]}{c[0].upper()}]", m[1]) + ")", pattern)


def rule_sql(rank: int, kind: str, pattern: str, group: int, least: int) -> str:
    """The spans of one rule: each begins where the pieces and matches before it end."""
    p = quoted(in_either_case(pattern))
    return f"""
    SELECT row_no, {rank} AS rank, {quoted(kind)} AS kind, stop - length(found) AS start, stop FROM (
        SELECT row_no, found, counted, sum(length(gap) + length(found)) OVER (PARTITION BY row_no ORDER BY place)::BIGINT AS stop FROM (
            SELECT row_no, generate_subscripts(m, 1) AS place, unnest(m) AS found, unnest(c) AS counted, unnest(g[1:len(m)]) AS gap
            FROM (SELECT row_no, regexp_extract_all(body, {p}) AS m, regexp_extract_all(body, {p}, {group}) AS c, regexp_split_to_array(body, {p}) AS g
                  FROM rows WHERE regexp_matches(body, {p}))
        )
    ) WHERE length(counted) >= {least}"""


def of_spans(condition: str) -> str:
    return f"coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER ({condition}), '')"


SECRETS = f"""
WITH rows AS (SELECT row_number() OVER () AS row_no, doc_id, coalesce(text, '') AS body FROM documents),
spans AS ({" UNION ALL ".join(rule_sql(i, *rule) for i, rule in enumerate(secrets.RULES))})
SELECT any_value(doc_id) AS doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in secrets.BASE)},
    sha256({of_spans(f"kind IN {secrets.BASE}")}) AS base_sha256, {of_spans("kind IS NOT NULL")} AS spans
FROM rows LEFT JOIN spans USING (row_no) GROUP BY row_no
"""

DECONTAMINATION = f"""
WITH items AS (SELECT item_id, w, least(13, len(w)) AS size FROM (SELECT item_id, {WORDS.format("text")} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(w[i:i + size - 1], ' ') AS line FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS i FROM items)),
rows AS (SELECT row_number() OVER () AS row_no, doc_id, {WORDS.format("text")} AS w FROM documents),
words_at AS (SELECT row_no, generate_subscripts(w, 1) AS i, unnest(w) AS word, len(w) AS n FROM rows),
places AS (SELECT * FROM (
    SELECT row_no, i, size, n, string_agg(word, ' ') OVER (PARTITION BY row_no, size ORDER BY i ROWS BETWEEN CURRENT ROW AND size - 1 FOLLOWING) AS line
    FROM words_at, (SELECT DISTINCT size FROM windows)) WHERE i + size - 1 <= n),
hits AS (SELECT row_no, i, size, item_id FROM places JOIN windows USING (size, line)),
words AS (SELECT row_no, count(DISTINCT place) AS n_hit FROM (SELECT row_no, unnest(range(i, i + size)) AS place FROM hits) GROUP BY row_no),
found AS (SELECT row_no, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY row_no)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM rows LEFT JOIN words USING (row_no) LEFT JOIN found USING (row_no)
"""


def template_rows() -> str:
    each = [(label, licenses.tokens_of(t), licenses.length_of(t), must, never) for t, label, must, never in licenses.TEMPLATES]
    need = lambda t: math.ceil(licenses.THRESHOLD * len(t) - 1e-9)
    return ", ".join(f"({quoted(label)}, {strings(t)}, {size}, {need(t)}, {strings(must)}, {strings(never)}::VARCHAR[])" for label, t, size, must, never in each)


LICENSES = f"""
WITH rows AS (SELECT row_number() OVER () AS row_no, doc_id, text, {WORDS.format("text")} AS w FROM documents),
templates(label, tokens, size, need, must, never) AS (VALUES {template_rows()}),
likely AS (SELECT row_no, w, t.* FROM rows JOIN templates t ON list_has_all(w, must) AND len(list_intersect(w, tokens)) >= need),
places AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM likely),
runs AS (SELECT row_no, label, tokens, need, must, never, w[i:i + size - 1] AS run FROM places WHERE list_contains(tokens, w[i])),
pairs AS (SELECT row_no, label, tokens, run, list_filter(tokens, lambda x: list_contains(run, x)) AS held FROM runs
    WHERE list_has_all(run, must) AND NOT list_has_any(run, never) AND len(list_intersect(run, tokens)) >= need),
found AS (SELECT row_no, list(DISTINCT label) AS labels, max(len(held) / len(tokens)::DOUBLE) AS containment FROM pairs
    WHERE len(held) < 2 OR len(list_filter(range(1, len(held)), lambda i: list_position(run, held[i]) < list_position(run, held[i + 1]))) >= {licenses.THRESHOLD} * (len(held) - 1) - 1e-9
    GROUP BY row_no),
phrases(label, words) AS (VALUES {", ".join(f"({quoted(label)}, {strings(p.split())})" for p, label in licenses.BASE_PHRASES)}),
spots AS (SELECT row_no, label, i - 1 AS spot FROM (SELECT row_no, w, unnest(range(1, len(w) + 1)) AS i FROM rows) JOIN phrases ON w[i] = words[1] WHERE w[i:i + len(words) - 1] = words),
based AS (SELECT row_no, any_value(doc_id) AS doc_id, any_value(len(w)) AS n_words, count(spot) AS n_base, min(spot) AS first_word, max(spot) AS last_word,
    coalesce(list(DISTINCT label) FILTER (label IS NOT NULL), []) AS base FROM rows LEFT JOIN spots USING (row_no) GROUP BY row_no)
SELECT doc_id, n_words, n_base, first_word, last_word,
    array_to_string(list_sort(base), ',') AS base_labels,
    array_to_string(list_sort(list_distinct(base || coalesce(labels, []))), ',') AS labels,
    CASE WHEN len(base) > 0 THEN 1.0::DOUBLE ELSE coalesce(containment, 0.0::DOUBLE) END AS score
FROM based LEFT JOIN found USING (row_no)
"""

SQL: dict[str, str] = {"op1_mixing": MIXING, "op2_secrets": SECRETS, "op5_decontamination": DECONTAMINATION, "op8_licenses": LICENSES}
