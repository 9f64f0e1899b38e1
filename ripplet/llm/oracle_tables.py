"""DuckDB SQL for the queries on manifests, archives and ranked search."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _crc32(text: str) -> str:
    """The unsigned crc32 of an ASCII text, bit by bit."""
    byte = "list_reduce([xor(crc, ord(sign))] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, unused: xor(c >> 1, 3988292384 * (c & 1)))"
    return f"xor(list_reduce([4294967295] || list_transform(string_split({text}, ''), lambda x: ord(x)::BIGINT), lambda crc, sign: {byte.replace('ord(sign)', 'sign')}), 4294967295)"


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


def _climb(name: str, groups: str, depth: int) -> str:
    """Levels of the trees of ``{name}0(g, pos, h)``; ``{name}{depth}`` has the roots. A level's rows carry what stands before and after them."""
    out = []
    for k in range(depth):
        run = f"PARTITION BY {groups}, pos // 16 ORDER BY pos ROWS BETWEEN"
        out.append(f"""{name}{k}s AS (SELECT *, count(*) OVER (PARTITION BY {groups}) = 1 AS lone, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
 coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM {name}{k})""")
        out.append(f"{name}{k + 1} AS (SELECT {groups}, pos // 16 AS pos, CASE WHEN bool_or(lone) THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {name}{k}s GROUP BY {groups}, pos // 16)")
    return ", ".join(out)


def _folds(name: str, depth: int, cols: str, groups: str) -> tuple[str, str]:
    """``{name}p``: a row of ``{name}`` folded over all levels, with its siblings."""
    out, last = [], f"{name}p0"
    for k in range(depth):
        out.append(f"""{name}p{k + 1} AS (SELECT {cols}, CASE WHEN s.lone THEN p.found ELSE sha256(s.before || p.found || s.after) END AS found, p.proof || s.before || s.after AS proof
 FROM {last} p JOIN {name}{k}s s ON {' AND '.join(f'p.{g} IS NOT DISTINCT FROM s.{g}' for g in groups.split(', '))} AND s.pos = p.at // {16**k})""")
        last = f"{name}p{k + 1}"
    return ", ".join(out), last


_TREES, _TOPS = _folds("l", 5, "p.doc_id, p.leaf, p.g, p.at", "g")
_ABOVE, _LAST = _folds("t", 4, "p.doc_id, p.leaf, p.subroot, p.one, p.at", "one")
TAMPERED = f"CASE WHEN {_crc32('doc_id::VARCHAR')} % 5 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END"
MERKLE = f"""WITH d AS (SELECT doc_id, source AS g, {_leaf('text')} AS h, {_leaf('t')} AS found FROM (SELECT *, {TAMPERED} AS t FROM documents)),
 r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM d), l0 AS (SELECT g, pos, h FROM r), {_climb('l', 'g', 5)},
 t0 AS (SELECT 1 AS one, g, row_number() OVER (ORDER BY encode(g) NULLS FIRST) - 1 AS pos, h FROM l5), {_climb('t', 'one', 4)},
 lp0 AS (SELECT doc_id, h AS leaf, g, pos AS at, found, '' AS proof FROM r), {_TREES},
 tp0 AS (SELECT p.doc_id, p.leaf, t.h AS subroot, 1 AS one, t.pos AS at, p.found, p.proof FROM {_TOPS} p JOIN t0 t ON p.g IS NOT DISTINCT FROM t.g), {_ABOVE}
 SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, found AS folded_root, found = h AS verified FROM {_LAST}, t4"""

_PART = "('0x' || substr(sha, 5 * k + 1, 5))::BIGINT"
_SIGNS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (({_PART} >> {s}) & 31)::INTEGER + 1, 1)" for s in (15, 10, 5, 0))
WARC = f"""WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
 b AS (SELECT sha, string_agg({_SIGNS}, '' ORDER BY k) AS payload_digest FROM (SELECT DISTINCT sha FROM p), (SELECT unnest(range(8)) AS k) GROUP BY sha),
 o AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS owner FROM p)
 SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < owner THEN owner END AS refers_to FROM o JOIN b USING (sha)"""

def _terms(table: str, key: str) -> str:
    sign = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    return f"SELECT {key}, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{sign}')) AS term FROM {table}"


SEARCH = f"""WITH d AS ({_terms('documents', 'doc_id')}), q AS (SELECT item_id, term, count(*) AS times FROM ({_terms('benchmark', 'item_id')}) GROUP BY ALL),
 n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY ALL), g AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM n),
 tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL),
 w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, g),
 m AS (SELECT doc_id, 100 - 75 + (75 * n * big_n) // big_l AS m FROM n, g),
 s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL)
 SELECT * FROM (SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0) WHERE rank <= 10"""

SQL = {"op11_geometric_block_search": SEARCH, "op12_slot_merkle_manifest": MERKLE, "op13_two_level_warc": WARC}
