"""SQL for DuckDB of the queries that it can express."""

from __future__ import annotations

from .common import WORD
from .licenses import TEMPLATES, _key_at, rarest

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}')"


def decontamination(size: int = 10) -> str:
    return f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item, least(len(w), {size}) AS n, w[i + 1 : i + {size}] AS x FROM (SELECT *, unnest(range(0, greatest(1, len(w) - {size - 1}))) AS i FROM items WHERE len(w) > 0)),
places AS (SELECT doc_id, i, n, w[i + 1 : i + n] AS x FROM (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM windows))),
hits AS (SELECT doc_id, i, n, item FROM places JOIN windows USING (n, x)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)"""


def licenses(least: float = 0.5) -> str:
    idf, _ = rarest(TEMPLATES)
    rows = []
    for t in TEMPLATES:
        w, key = t.words.split(), t.key.split()
        at = _key_at(w, key)
        total = sum(idf[x] for x in w)
        weights = ", ".join(f"{idf[x] / total:.6f}::DOUBLE" for x in w)
        rows.append(f"('{t.label}', {w!r}, [{weights}], {key!r}, {at}, {t.base})")
    return f"""WITH templates(label, tw, weights, keys, key_at, base) AS (VALUES {', '.join(rows)}),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
spots AS (SELECT doc_id, i FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d) WHERE w[i + 1] IN (SELECT keys[1] FROM templates)),
found AS (SELECT doc_id, label, base, i AS start, round(list_sum(list_transform(range(1, len(tw) + 1), lambda j: CASE WHEN i - key_at + j >= 1 AND w[greatest(i - key_at + j, 1)] = tw[j] THEN weights[j] ELSE 0.0 END)), 6) AS s
  FROM spots JOIN d USING (doc_id) JOIN templates ON w[i + 1 : i + len(keys)] = keys),
kept AS (SELECT * FROM found WHERE s >= {least}),
sums AS (SELECT doc_id, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
  list_sort(list(DISTINCT label) FILTER (WHERE base)) AS b, list_sort(list(DISTINCT label)) AS l, least(max(s), 1.0) AS score FROM kept GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(b, ','), '') AS base_labels, coalesce(array_to_string(l, ','), '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN sums USING (doc_id)"""
