"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from quillmark.llm.common import LOWER, UPPER
from quillmark.llm.fingerprints import HIGH, LOW, SUBSETS

_SPACE = r"[\x20\x09-\x0D]+"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex(coalesce({text}, ''), '{_SPACE}'), lambda w: w <> '')"


_LOW = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_words(_LOW)} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN [array_to_string(ws[i : i + 3], ' ') for i in range(1, len(ws) - 2)] WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

_PIECES = "[" + ", ".join(["h", *[f"list_filter(h, lambda t: substring(t, {k}, {len(m)}) < '{m}')" for k, m in SUBSETS]]) + "]"


def _fingerprint(text: str) -> str:
    low = f"translate({text}, '{UPPER}', '{LOWER}')"
    return f"""SELECT doc_id, array_to_string(list_transform({_PIECES}, lambda s: CASE WHEN len(s) > 0 THEN substring(md5(array_to_string(s, ' ')), 1, 8) ELSE '-' END), '.') AS f
FROM (SELECT doc_id, list_sort(list_transform(CASE WHEN len(inside) > 0 THEN inside ELSE mine END, lambda t: md5(t))) AS h
FROM (SELECT doc_id, mine, list_intersect(mine, (SELECT list(term) FROM lex)) AS inside FROM (SELECT doc_id, list_distinct({_words(low)}) AS mine FROM pairs)))"""


def _likeness(a: str, b: str) -> str:
    z = f"list_zip(string_split({a}, '.'), string_split({b}, '.'))"
    return f"CASE WHEN {a} = {b} THEN 1.0 ELSE coalesce(CAST(len(list_filter({z}, lambda p: p[1] <> '-' AND p[1] = p[2])) AS DOUBLE) / nullif(len(list_filter({z}, lambda p: p[1] <> '-' OR p[2] <> '-')), 0), 0.0) END"


FINGERPRINTS = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lex AS (SELECT term FROM (SELECT unnest(list_distinct({_words(_LOW)})) AS term FROM documents) GROUP BY term
  HAVING count(*) >= greatest(2, {LOW} * (SELECT count(*) FROM documents)) AND count(*) <= {HIGH} * (SELECT count(*) FROM documents)),
o AS (SELECT doc_id, text, coalesce(lead(doc_id) OVER (ORDER BY doc_id), (SELECT min(doc_id) FROM t)) AS next_id FROM t),
pairs AS (SELECT o.doc_id, o.next_id, o.text, substring(o.text, 1, length(o.text) - length(o.text) // 2) || substring(n.text, 1, length(o.text) // 2) AS edited FROM o JOIN t n ON n.doc_id = o.next_id),
fp AS ({_fingerprint('text')}), fe AS ({_fingerprint('edited')})
SELECT p.doc_id, length(p.text) AS n_chars, sha256(edited) AS edited_sha256, a.f AS fingerprint, e.f AS edited_fingerprint,
  CAST({_likeness('a.f', 'e.f')} AS DOUBLE) AS near_edited, CAST({_likeness('a.f', 'b.f')} AS DOUBLE) AS near_next
FROM pairs p JOIN fp a ON a.doc_id = p.doc_id JOIN fe e ON e.doc_id = p.doc_id JOIN fp b ON b.doc_id = p.next_id
"""

PASSAGES = f"""
WITH w AS (SELECT doc_id, {_words('text')} AS ws FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
first AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM win JOIN first USING (h), (SELECT unnest(range(0, 50)) AS k) WHERE m < doc_id),
word AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
left_ AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN left_ USING (doc_id)
"""

DIVERGENCE = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {_LOW} AS t FROM documents),
o AS MATERIALIZED (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS ln FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
kl AS (SELECT lang, sum(ln) AS lt, count(*) AS v FROM k GROUP BY lang),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN k USING (lang, term) GROUP BY ALL),
e AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.ln FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
gs AS (SELECT lang, source, sum(n) AS gt FROM e GROUP BY lang, source),
p AS MATERIALIZED (SELECT e.lang, e.source, term, n, CAST(1 + CAST(1000000000 AS HUGEINT) * (n + 2) // (gt + 2 * v) AS BIGINT) AS p, CAST(1 + CAST(1000000000 AS HUGEINT) * (ln + 2) // (lt + 2 * v) AS BIGINT) AS q
  FROM e JOIN gs ON gs.lang = e.lang AND gs.source = e.source JOIN kl ON kl.lang = e.lang),
s AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q),
w AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM w WHERE part = 'pair' OR rank <= 10
"""

EXACT = f"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g') AS t FROM documents),
w AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM w
"""


def _tree(name: str, start: str, levels: int) -> str:
    """CTEs name_0, name_1, ... (tree, pos, n, h): the nodes of every level; a tree of one node stays as it is.
    Up to 3 ** levels leaves a tree, as a query without recursion has a fixed number of levels."""
    out = [f"{name}_0 AS MATERIALIZED ({start})"]
    for k in range(levels):
        out.append(f"{name}_{k + 1} AS MATERIALIZED (SELECT tree, pos // 3 AS pos, (any_value(n) + 2) // 3 AS n, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {name}_{k} GROUP BY tree, pos // 3)")
    return ", ".join(out)


def _fold(name: str, source: str, tree: str, pos: str, levels: int, first: str) -> str:
    """CTEs that fold ``claim`` of ``source`` up the trees of ``name``, and gather the siblings in ``proof``."""
    out, last = [], source
    for k in range(levels):
        at = f"{pos} // {3 ** k}"
        sib = lambda side: f"coalesce((SELECT string_agg(x.h, '' ORDER BY x.pos) FROM {name}_{k} x WHERE x.tree = f.{tree} AND x.pos // 3 = f.{at} // 3 AND x.pos {side} f.{at}), '')"
        out.append(f"{first}_{k} AS MATERIALIZED (SELECT f.* EXCLUDE (claim, proof), proof || b || a AS proof, CASE WHEN m > 1 THEN sha256(b || claim || a) ELSE claim END AS claim FROM (SELECT f.*, {sib('<')} AS b, {sib('>')} AS a, (SELECT any_value(x.n) FROM {name}_{k} x WHERE x.tree = f.{tree}) AS m FROM {last} f) f)".replace("f.* EXCLUDE (claim, proof)", "* EXCLUDE (claim, proof, b, a, m)"))
        last = f"{first}_{k}"
    return ", ".join(out)


def _leaf(text: str) -> str:
    one = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    return "sha256(" + " || ".join(map(one, ("doc_id", "source", "lang", "n_chars", text))) + ")"


#: DuckDB has no crc32; its table-driven form over the digits of an id, eight shifts a byte.
_CRC = "list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substring(CAST(doc_id AS VARCHAR), CAST(i AS INTEGER), 1)) AS BIGINT))), lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END))"
_UP, _TOP = 10, 4
MERKLE = f"""
WITH l AS MATERIALIZED (SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS tree, {_leaf('text')} AS leaf,
  CASE WHEN doc_id IS NOT NULL AND xor({_CRC}, 4294967295) % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf('text')} END AS claim, '' AS proof FROM documents),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, claim) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM l),
{_tree('t', 'SELECT tree, pos, n, leaf AS h FROM r', _UP)},
q AS MATERIALIZED (SELECT tree AS source_key, h, row_number() OVER (ORDER BY tree) - 1 AS top_pos, '' AS top FROM t_{_UP}),
{_tree('u', 'SELECT top AS tree, top_pos AS pos, count(*) OVER () AS n, h FROM q', _TOP)},
{_fold('t', 'r', 'tree', 'pos', _UP, 'f')},
m AS MATERIALIZED (SELECT f.*, q.h AS subroot, q.top, q.top_pos FROM f_{_UP - 1} f JOIN q ON q.source_key = f.tree),
{_fold('u', 'm', 'top', 'top_pos', _TOP, 'v')}
SELECT doc_id, leaf, subroot, u_{_TOP}.h AS root, sha256(proof) AS proof_sha256, claim AS folded_root, claim = u_{_TOP}.h AS verified FROM v_{_TOP - 1}, u_{_TOP}
"""

ORACLES = {"op1_minhash": NEAR_DUPLICATES, "op2_fingerprints": FINGERPRINTS, "op6_passages": PASSAGES, "op11_divergence": DIVERGENCE, "op12_exact": EXACT, "op13_merkle": MERKLE}
