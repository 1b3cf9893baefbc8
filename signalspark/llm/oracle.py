"""DuckDB SQL of the registered queries that SQL can express.

The others have no SQL: their models, min-hashes, tokenizers or removals cannot be
written in it at whole tables; tests compare them with brute force.
"""

from __future__ import annotations

from signalspark.llm import mixing, sharding

DOCS = "SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents"


def _feistel(source: str, number: str, keep: str) -> str:
    """Rows of ``source`` with ``number`` replaced by its image, one subquery per round."""
    inner = f"SELECT {keep}, {number} // side AS l, {number} % side AS r FROM {source}"
    for multiplier, offset in sharding.round_keys(sharding.SEED):
        p = sharding.PRIME
        inner = f"SELECT {keep}, l, r, (r * {multiplier} + {offset}) % {p} AS t FROM ({inner})"
        inner = f"SELECT {keep}, r AS l, (l + (t * t % {p} + t // 65536) % side) % side AS r FROM ({inner})"
    return f"SELECT {keep}, l * side + r AS p FROM ({inner})"


KEEP = "doc_id, size, text_crc32, n, side"
CRC_TABLE = """bits AS (
  SELECT range AS i, 0 AS k, range::BIGINT AS c FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8)"""
SHARDS = f"""
WITH RECURSIVE {CRC_TABLE},
bytes AS (
  SELECT doc_id, strlen(text) + 1 AS size,
    list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT) AS b FROM ({DOCS})),
sums AS (
  SELECT doc_id, size, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, b),
    lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8))) AS text_crc32 FROM bytes, crc),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS x, count(*) OVER () AS n FROM sums),
sided AS (SELECT *, ceil(sqrt(n))::BIGINT AS side FROM numbered),
walk AS ({_feistel('sided', 'x', KEEP)}
  UNION ALL ({_feistel('(SELECT * FROM walk WHERE p >= n)', 'p', KEEP)}))
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (p % {sharding.SHARDS})::INTEGER AS shard,
  p // {sharding.SHARDS} AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM walk WHERE p < n"""


def _mix(budget: float, rounds: int = 40) -> str:
    """Raking unrolled: more rounds than any table here needs to converge."""
    dims = mixing.ALPHAS
    ctes = [f"""tokens AS (
  SELECT doc_id, source, lang, CASE WHEN contains(text, 'License') THEN 'legal' WHEN regexp_matches(text, '[0-9]') THEN 'figures'
    WHEN regexp_matches(text, '[#*$%&|<>!]') THEN 'markup' WHEN length(text) < 1500 THEN 'short' ELSE 'long' END AS topic,
    len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS tokens FROM ({DOCS}))""",
            "cells AS (SELECT source, lang, topic, sum(tokens) AS tokens FROM tokens GROUP BY ALL HAVING sum(tokens) > 0)",
            "w0 AS (SELECT *, tokens / sum(tokens) OVER () AS weight FROM cells)"]
    own = ", ".join(f"sum(weight) OVER (PARTITION BY {d}) AS own_{d}" for d in dims)
    ctes.append(f"owned AS (SELECT *, {own} FROM w0)")
    to = ", ".join(f"own_{d} ** {a} / sum(own_{d} ** {a} * weight / own_{d}) OVER () AS to_{d}" for d, a in dims.items())
    ctes.append(f"m0 AS (SELECT source, lang, topic, tokens, weight, {to} FROM owned)")
    keep, k = "source, lang, topic, tokens, " + ", ".join(f"to_{d}" for d in dims), 0
    for _ in range(rounds):
        for d in dims:
            ctes.append(f"m{k + 1} AS MATERIALIZED (SELECT {keep}, weight * to_{d} / sum(weight) OVER (PARTITION BY {d}) AS weight FROM m{k})")
            k += 1
    down = "ORDER BY rate DESC, tokens DESC, source, lang, topic"
    ctes += [f"rated AS (SELECT *, weight / tokens AS rate FROM m{k})",
             f"""scaled AS (SELECT *, row_number() OVER ({down}) AS rank, ({budget} * sum(tokens) OVER ()
  - coalesce(sum(tokens) OVER ({down} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER ({down} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c FROM rated)""",
             "scale AS (SELECT arg_min(c, rank) AS c FROM scaled WHERE c > 0 AND c * rate <= 1)",
             """mix AS (SELECT source, lang, topic, weight, round(least(1.0, coalesce((SELECT c FROM scale), 1e300) * rate), 9) AS p
  FROM rated)"""]
    same = " AND ".join(f"t.{d} IS NOT DISTINCT FROM m.{d}" for d in dims)
    return f"""WITH {', '.join(ctes)}
SELECT doc_id, t.source, t.lang, t.topic, tokens::BIGINT AS tokens, round(coalesce(weight, 0), 7) AS weight,
  round(coalesce(p, 0), 6) AS probability,
  ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT / 281474976710656.0 < coalesce(p, 0) AS sampled
FROM tokens t LEFT JOIN mix m ON {same}"""


def _climb(name: str, nodes: str) -> str:
    """All levels of the trees of ``nodes`` (tree, pos, node, n), by runs of three."""
    return f"""{name}_up AS (SELECT tree, 0 AS lvl, pos, node, n FROM {nodes}
  UNION ALL SELECT tree, lvl + 1, pos // 3, sha256(string_agg(node, '' ORDER BY pos)), (n + 2) // 3 FROM {name}_up
  WHERE n > 1 GROUP BY tree, lvl, n, pos // 3),
{name}_runs AS (SELECT tree, lvl, pos // 3 AS run, list(node ORDER BY pos) AS nodes FROM {name}_up WHERE n > 1 GROUP BY ALL),
{name}_paths AS (SELECT l.tree, l.pos, list(array_to_string(nodes[1:k], '') || '|' || array_to_string(nodes[k + 2:], '') ORDER BY lvl) AS path
  FROM (SELECT l.tree, l.pos, r.lvl, r.nodes, (l.pos // (3 ** r.lvl)::BIGINT) % 3 AS k FROM {nodes} l JOIN {name}_runs r
        ON r.tree = l.tree AND r.run = l.pos // (3 ** (r.lvl + 1))::BIGINT) l GROUP BY l.tree, l.pos)"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


MERKLE = f"""
WITH RECURSIVE {CRC_TABLE},
sums AS (
  SELECT *, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT)),
    lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8))) AS crc32 FROM documents, crc),
hashed AS (
  SELECT doc_id, coalesce('=' || source, '-') AS tree, {_leaf('text')} AS node,
    {_leaf("CASE WHEN crc32 % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")} AS tampered FROM sums),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS pos,
  count(*) OVER (PARTITION BY tree) AS n FROM hashed),
{_climb('low', 'leaves')},
subroots AS (SELECT '' AS tree, tree AS source, node, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n
  FROM low_up WHERE n = 1),
{_climb('top', 'subroots')},
proven AS (
  SELECT doc_id, l.node AS leaf, s.node AS subroot, (SELECT node FROM top_up WHERE n = 1) AS root, tampered,
    list_concat(coalesce(p.path, []), coalesce(t.path, [])) AS path
  FROM leaves l JOIN subroots s ON s.source = l.tree LEFT JOIN low_paths p ON p.tree = l.tree AND p.pos = l.pos
  LEFT JOIN top_paths t ON t.pos = s.pos),
folds AS (
  SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(path, ''), '|', '')) AS proof_sha256,
    list_reduce(list_prepend(tampered, path), lambda a, b: sha256(split_part(b, '|', 1) || a || split_part(b, '|', 2))) AS folded_root
  FROM proven)
SELECT *, folded_root = root AS verified FROM folds"""


LLM_SQL: dict[str, str] = {"op7_feistel_shards": SHARDS, "op9_raked_mix": _mix(budget=0.5), "op13_merkle_manifest": MERKLE}
