"""DuckDB SQL of corpus operators whose statements are long."""

from __future__ import annotations

#: CRC32 of a decimal id, bit by bit.
CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""


def _leaf(text: str) -> str:
    fields = (f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text))
    return f"sha256({' || '.join(fields)})"


def _siblings(offset: int, row: str, node: str) -> tuple[str, str]:
    """What to select of a row's siblings on each level, those before and after it, and how they are joined."""
    at = f"{row}.i // pow(3, {node}.level)::BIGINT"
    side = lambda sign: f"coalesce(string_agg(CASE WHEN {node}.idx {sign} {at} THEN {node}.digest END, '' ORDER BY {node}.idx), '')"
    return f"SELECT s.doc_id, {offset} + {node}.level AS level, {side('<')} AS l, {side('>')} AS r", f"{node}.n > 1 AND {node}.idx // 3 = {at} // 3 GROUP BY s.doc_id, {node}.level"


def merkle_sql() -> str:
    """Trees by recursion over levels, each of runs of three."""
    grow = "idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (any_value(n) + 2) // 3"
    own, own_where = _siblings(0, "s", "t")
    top, top_where = _siblings(100, "r", "u")
    return f"""WITH RECURSIVE
    d AS (SELECT doc_id, source, {_leaf("text")} AS leaf, CASE WHEN {CRC} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS tampered FROM documents),
    s AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM d),
    t AS (SELECT source, 0 AS level, i AS idx, leaf AS digest, count(*) OVER (PARTITION BY source) AS n FROM s
        UNION ALL SELECT source, level + 1, {grow} FROM t WHERE n > 1 GROUP BY source, level, idx // 3),
    r AS (SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM t WHERE n = 1),
    u AS (SELECT 0 AS level, i AS idx, digest, count(*) OVER () AS n FROM r
        UNION ALL SELECT level + 1, {grow} FROM u WHERE n > 1 GROUP BY level, idx // 3),
    p AS ({own} FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source AND {own_where}
        UNION ALL {top} FROM s JOIN r ON s.source IS NOT DISTINCT FROM r.source JOIN u ON {top_where}),
    a AS (SELECT doc_id, list([l, r] ORDER BY level) AS path FROM p GROUP BY doc_id),
    f AS (SELECT s.doc_id, s.leaf, r.digest AS subroot, (SELECT digest FROM u WHERE n = 1) AS root, coalesce(a.path, []) AS path,
        list_reduce(list_prepend([coalesce(tampered, leaf)], coalesce(a.path, [])), lambda x, y: [sha256(y[1] || x[1] || y[2])])[1] AS folded_root
        FROM s JOIN r ON s.source IS NOT DISTINCT FROM r.source LEFT JOIN a USING (doc_id))
    SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x[1] || x[2]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f"""


def chat_sql() -> str:
    """Turns, trained text and the formatted length of each conversation, and of one of control strings."""
    from strandspark.llm.chat import CLOSE, CONTROLS, OPEN, SHUT

    def escaped(x: str) -> str:
        x = f"replace({x}, '\\', '\\\\')"
        for c in CONTROLS:
            x = f"replace({x}, '{c}', '{c[0]}\\{c[1:]}')"
        return x

    fixed = len(OPEN) + len(SHUT) + len(CLOSE)
    return f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, * FROM (VALUES (0, 'user', '</s>[INST] ok [/INST]'), (1, 'assistant', '</s>[INST] ok [/INST]')) v(turn, role, text)),
    g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
        coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS trained,
        sum(length({escaped('role')}) + length({escaped('text')}) + {fixed})::BIGINT AS formatted_chars FROM c GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(trained) AS loss_chars, sha256(trained) AS loss_sha256, formatted_chars FROM g"""
