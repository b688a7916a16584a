"""Registered queries of the operators on training text, and their SQL where SQL can express them."""

from __future__ import annotations

from . import (
    collocations, decontaminate, exact_dedup, licenses, line_dedup, merkle, pieces, quality, secrets, sharding, simhash, suffix_dedup, unit_dedup,
)

QUERIES = {
    "op1_license_scans": licenses.op1,
    "op2_line_dedup": line_dedup.op2,
    "op3_sentencepiece": pieces.op3,
    "op4_substring_dedup": unit_dedup.op4,
    "op5_simhash": simhash.op5,
    "op6_sharding": sharding.op6,
    "op7_quality_rules": quality.op7,
    "op8_secret_scans": secrets.op8,
    "op9_decontamination": decontaminate.op9,
    "op10_suffix_array": suffix_dedup.op10,
    "op11_phrase_collocations": collocations.op11,
    "op12_merkle_manifest": merkle.op12,
    "op13_exact_dedup": exact_dedup.op13,
}

WORDS = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    "'[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
)

#: The other operators use hashes, random orders, tests or models that SQL lacks; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op7_quality_rules": quality.SQL,
    "op11_phrase_collocations": collocations.SQL,
    "op12_merkle_manifest": merkle.SQL,
    "op13_exact_dedup": exact_dedup.SQL,
    "op9_decontamination": f"""
WITH items AS (SELECT item_id, {WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS id, array_to_string(list_slice(w, k, k + 12), ' ') AS win,
    least(len(w), 13) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, coalesce({WORDS}, []) AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM docs),
ahead AS (
  SELECT doc_id, pos, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS l
  FROM words),
found AS (
  SELECT a.doc_id, a.pos, x.n, x.id
  FROM (SELECT a.doc_id, a.pos, s.n, array_to_string(list_slice(a.l, 1, s.n), ' ') AS said
        FROM ahead a JOIN (SELECT DISTINCT n FROM windows) s ON len(a.l) >= s.n) a
  JOIN windows x ON x.n = a.n AND x.win = a.said),
hits AS (
  SELECT doc_id, count(DISTINCT k) AS n_hit
  FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS k FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(DISTINCT id) AS n_items, string_agg(DISTINCT id, ',' ORDER BY id) AS ids
  FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
  sha256(coalesce(i.ids, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN hits h ON h.doc_id = d.doc_id LEFT JOIN named i ON i.doc_id = d.doc_id""",
}
