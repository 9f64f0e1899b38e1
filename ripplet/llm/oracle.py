"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from ripplet.llm import oracle_tables
from ripplet.llm.decontam import LEAST, LITERALS, NUMBER_WORDS, UNITS, WINDOW

PUNCTUATION = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"


def _list(words: frozenset[str]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in sorted(words)) + ")"


def _windows(name: str, table: str, key: str, lengths: str) -> str:
    """Windows ``(key, place, length, k, slots)``: the template as a text, and the values of its placeholders."""
    return f"""{name}_w AS (SELECT {key} AS id, unnest(string_split_regex(text, '\\s+')) AS word, generate_subscripts(string_split_regex(text, '\\s+'), 1) AS pos FROM {table} WHERE text IS NOT NULL),
 {name}_b AS (SELECT *, trim(word, '{PUNCTUATION}') AS bare, coalesce(regexp_matches(lag(word) OVER (PARTITION BY id ORDER BY pos), '[.!?]$'), true) AS opens FROM {name}_w WHERE word <> ''),
 {name}_k AS (SELECT *, lower(bare) AS low, CASE WHEN regexp_full_match(bare, '[+-]?[0-9][0-9.,:/]*[A-Za-z%]{{0,2}}') OR lower(bare) IN {_list(NUMBER_WORDS)} THEN 'number'
   WHEN lower(bare) IN {_list(UNITS)} THEN 'unit' WHEN bare[1] <> lower(bare[1]) AND NOT (bare = upper(bare) AND NOT contains(bare, 'ß')) AND NOT opens THEN 'name' ELSE 'literal' END AS kind FROM {name}_b WHERE bare <> ''),
 {name}_u AS (SELECT id, pos, low, CASE WHEN kind = 'unit' AND coalesce(lag(kind) OVER o, '') <> 'number' THEN 'literal' ELSE kind END AS kind FROM {name}_k WINDOW o AS (PARTITION BY id ORDER BY pos)),
 {name}_r AS (SELECT *, CASE WHEN kind = 'name' AND coalesce(lag(kind) OVER o, '') = 'name' THEN 0 ELSE 1 END AS starts FROM {name}_u WINDOW o AS (PARTITION BY id ORDER BY pos)),
 {name}_g AS (SELECT *, sum(starts) OVER (PARTITION BY id ORDER BY pos) AS tok FROM {name}_r),
 {name}_t AS (SELECT id, tok, min(kind) AS kind, CASE WHEN min(kind) = 'literal' THEN min(low) ELSE '<' || min(kind) || '>' END AS template, string_agg(low, ' ' ORDER BY low) AS value FROM {name}_g GROUP BY id, tok),
 {name}_d AS (SELECT id, list(template ORDER BY tok) AS t, list(kind ORDER BY tok) AS k, list(value ORDER BY tok) AS v, count(*) AS n FROM {name}_t GROUP BY id),
 {name}_l AS (SELECT id, t, k, v, n, unnest({lengths}) AS length FROM {name}_d),
 {name}_s AS (SELECT id, length, place, t[place + 1:place + length] AS t, k[place + 1:place + length] AS k, v[place + 1:place + length] AS v FROM (SELECT *, unnest(range(n - length + 1)) AS place FROM {name}_l WHERE n >= length)),
 {name} AS (SELECT id, place, length, CASE WHEN length >= {LEAST} AND len([x for x in k if x = 'literal']) >= {LITERALS} THEN array_to_string(t, ' ') ELSE array_to_string(t, ' ') || ' with ' || array_to_string(v, ', ') END AS k,
   [p for p in list_zip(v, k) if p[2] <> 'literal'] AS slots FROM {name}_s)"""


LEAKS = f"""WITH {_windows('item', 'benchmark', 'item_id', f'[least({WINDOW}, n)]')},
 {_windows('doc', 'documents', 'doc_id', '(SELECT list(DISTINCT length) FROM item)')},
 met AS (SELECT d.id AS doc_id, i.id AS item_id, i.place AS item_place, d.place - i.place AS along, i.slots AS i_slots, d.slots AS d_slots FROM doc d JOIN item i ON d.k = i.k AND d.length = i.length),
 pairs AS (SELECT DISTINCT doc_id, item_id, along, i_slots[s + 1][1] AS i, d_slots[s + 1][1] AS d FROM (SELECT *, unnest(range(len(i_slots))) AS s FROM met)),
 lanes AS (SELECT doc_id, item_id, along, max(n) AS n, bool_and(same) AS same FROM (SELECT doc_id, item_id, along, i, count(*) AS n, bool_and(i = d) AS same FROM pairs GROUP BY ALL) GROUP BY ALL),
 good AS (SELECT m.doc_id, m.item_id, m.item_place, coalesce(l.same, true) AS same FROM met m LEFT JOIN lanes l ON m.doc_id = l.doc_id AND m.item_id = l.item_id AND m.along = l.along WHERE l.n IS NULL OR l.n = 1 OR len(m.i_slots) = 0),
 sizes AS (SELECT id AS item_id, count(*) AS item_windows FROM item GROUP BY id),
 covered AS (SELECT doc_id, item_id, count(DISTINCT item_place) AS n_windows, bool_and(same) AS same_slots FROM good GROUP BY ALL)
 SELECT doc_id, item_id, n_windows, item_windows, n_windows / item_windows AS coverage, same_slots FROM covered JOIN sizes USING (item_id) WHERE n_windows >= 0.5 * item_windows"""

SQL = {"op3_template_decontamination": LEAKS} | oracle_tables.SQL
