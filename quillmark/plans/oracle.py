"""SQL of the fixture views, for the oracles."""

from __future__ import annotations

NORM = r"lower(trim(regexp_replace(regexp_replace({0}, '[.·•_‐-―\-]{{3,}}', ' ', 'g'), '\s+', ' ', 'g')))"


def norm(c: str) -> str:
    return NORM.format(c)


def runs(c: str) -> str:
    """As ``shingles``, usable inside lambdas."""
    w = f"string_split({c}, ' ')"
    return f"list_distinct(list_transform(range(1, greatest(len({w}) - 1, 1)), lambda i: array_to_string({w}[i : i + 2], ' ')))"


def cover(parts: str, hay: str, hs: str) -> str:
    """Percent of parts that stand in hay, word for word or by 88 percent of their runs."""
    return f"coalesce(100.0 * len(list_filter({parts}, lambda s: contains({hay}, s) OR (len({runs('s')}) > 0 AND CAST(len(list_intersect({runs('s')}, {hs})) AS DOUBLE) / len({runs('s')}) >= 0.88))) / nullif(len({parts}), 0), 0)"


def share(a: str, b: str) -> str:
    return f"coalesce(100.0 * CAST(len(list_intersect({a}, {b})) AS DOUBLE) / nullif(len({a}), 0), 0)"


def single(c: str) -> str:
    """Lower-case text with a byte a character: this engine's edit distance counts bytes. Accented letters
    take the places of the capitals, which the text no longer has, and of some control characters."""
    accented = "".join(map(chr, range(0xDF, 0x100)))
    return f"translate({c}, '{accented}', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(1) || chr(2) || chr(3) || chr(4) || chr(5) || chr(6) || chr(7))"


def token_set(a: str, b: str) -> str:
    """Likeness of two word sets, as the text functions define it."""
    sq = lambda c: f"list_distinct(string_split(lower(trim(regexp_replace({c}, '\\s+', ' ', 'g'))), ' '))"
    x, y = sq(a), sq(b)
    join = lambda e: f"array_to_string(list_sort({e}), ' ')"
    both, ra, rb = join(f"list_intersect({x}, {y})"), join(f"list_filter({x}, lambda z: NOT list_contains({y}, z))"), join(f"list_filter({y}, lambda z: NOT list_contains({x}, z))")
    n, la, lb = f"length({both})", f"length({ra})", f"length({rb})"
    close = lambda m: f"CASE WHEN {n} > 0 THEN 200.0 * {n} / ({n} + {n} + (CASE WHEN {m} > 0 THEN 1 ELSE 0 END) + {m}) ELSE 0 END"
    return f"CASE WHEN {n} > 0 AND ({la} = 0 OR {lb} = 0) THEN 100.0 ELSE greatest({close(la)}, {close(lb)}, 100.0 * (1 - levenshtein({single(ra)}, {single(rb)}) / CAST(greatest({la}, {lb}, 1) AS DOUBLE))) END"


SEGS = "list_filter(list_transform(string_split(regexp_replace(regexp_replace({0}, '[\\n;]+|\\.\\.\\.+|…', chr(1), 'g'), '([.:!?])\\s+([A-Z(])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: " + norm("s") + "), lambda s: length(s) >= 18)"


def shingles(c: str, n: int = 3) -> str:
    w = f"string_split({c}, ' ')"
    parts = " || ' ' || ".join(f"{w}[i + {k}]" for k in range(n))
    return f"list_distinct([{parts} for i in range(1, len({w}) - {n - 2})])"


VIEWS = {
    "lines": "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents",
    "doc_pages": "SELECT doc_id, CAST(i // 4 + 1 AS INT) AS page_no, string_agg(line, chr(10) ORDER BY i) AS text FROM lines GROUP BY doc_id, i // 4",
    "pn": f"SELECT doc_id, page_no, {norm('text')} AS hay FROM doc_pages",
    "hit": f"SELECT item_id, doc_id, page_no, b.text AS quote FROM benchmark b JOIN pn ON contains(hay, {norm('b.text')})",
    "quotes0": "SELECT b, h.doc_id, item_id, h.page_no, quote, array_to_string(string_split(n.text, ' ')[1 : 10], ' ') AS go_on, (7 * item_id + 3 * h.doc_id + 5 * b) % 10 AS r FROM hit h LEFT JOIN doc_pages n ON n.doc_id = h.doc_id AND n.page_no = h.page_no + 1, (SELECT unnest([0, 1, 2]) AS b)",
    "quotes": "SELECT b, doc_id, item_id, r <> 0 AS present, CASE WHEN r = 0 THEN NULL WHEN r = 2 THEN page_no + 1 ELSE page_no END AS page, CASE WHEN r IN (0, 1) THEN NULL WHEN r = 3 THEN reverse(quote) WHEN r = 4 THEN regexp_replace(quote, '\\S+$', 'altered') WHEN r = 5 THEN concat_ws(' ', quote, go_on) ELSE quote END AS quote FROM quotes0",
    "qn": f"SELECT *, {norm('quote')} AS needle FROM quotes",
    "exact0": "SELECT b, doc_id, item_id, page, coalesce(max(CASE WHEN page_no = page THEN page_no END), max(page_no)) AS found FROM qn JOIN pn USING (doc_id) WHERE length(needle) >= 12 AND contains(hay, needle) GROUP BY ALL",
    "open0": f"SELECT DISTINCT q.b, q.doc_id, q.item_id, coalesce(q.page, -1) AS page, needle, {runs('needle')} AS qs, CASE WHEN length(needle) > 300 OR regexp_matches(quote, '\\.\\.\\.|…') THEN {SEGS.replace('{0}', 'quote')} ELSE [] END AS segs FROM qn q LEFT JOIN exact0 e ON q.b = e.b AND q.doc_id = e.doc_id AND q.item_id = e.item_id AND q.page IS NOT DISTINCT FROM e.page WHERE length(needle) >= 12 AND found IS NULL",
    "ps": f"SELECT doc_id, page_no, hay, {runs('hay')} AS hs, lead(hay) OVER w AS nxt FROM pn WHERE doc_id IN (SELECT doc_id FROM open0) WINDOW w AS (PARTITION BY doc_id ORDER BY page_no)",
    "fuzzy0": f"SELECT b, doc_id, item_id, page, max(score) AS best, min(CASE WHEN score >= 90 THEN page_no END) AS fuzzy_page FROM (SELECT b, doc_id, item_id, page, page_no, greatest(round({share('qs', 'hs')}, 6), round({cover('segs', 'hay', 'hs')}, 6)) AS score FROM open0 JOIN ps USING (doc_id)) GROUP BY ALL",
    "pairs0": f"SELECT b, doc_id, item_id, page, arg_min(start_page, page_no) AS start_page, arg_min(score, page_no) AS pair_score FROM (SELECT b, doc_id, item_id, page, page_no, page_no + CASE WHEN contains(nxt, parts[1]) AND NOT contains(hay, parts[1]) THEN 1 ELSE 0 END AS start_page, round(greatest({share('qs', 'bs')}, {cover('parts', 'two', 'bs')}), 6) AS score FROM (SELECT o.*, page_no, hay, nxt, hay || ' ' || nxt AS two, {runs("(hay || ' ' || nxt)")} AS bs, CASE WHEN len(segs) > 0 THEN segs ELSE [needle] END AS parts FROM open0 o JOIN fuzzy0 f ON f.b = o.b AND f.doc_id = o.doc_id AND f.item_id = o.item_id AND f.page = o.page AND fuzzy_page IS NULL JOIN ps ON ps.doc_id = o.doc_id WHERE nxt IS NOT NULL)) WHERE score >= 90 GROUP BY ALL",
    "found0": "SELECT q.b, q.doc_id, q.item_id, coalesce(q.page, -1) AS page, max(coalesce(e.found, fuzzy_page, start_page)) AS found, max(CASE WHEN e.found IS NOT NULL THEN 100.0 ELSE coalesce(greatest(best, pair_score), 0) END) AS score FROM qn q LEFT JOIN exact0 e ON q.b = e.b AND q.doc_id = e.doc_id AND q.item_id = e.item_id AND q.page IS NOT DISTINCT FROM e.page LEFT JOIN fuzzy0 f ON f.b = q.b AND f.doc_id = q.doc_id AND f.item_id = q.item_id AND f.page = coalesce(q.page, -1) LEFT JOIN pairs0 p ON p.b = q.b AND p.doc_id = q.doc_id AND p.item_id = q.item_id AND p.page = coalesce(q.page, -1) GROUP BY ALL",
    "evidence": "SELECT q.*, found, CASE WHEN NOT present THEN 'absent' WHEN coalesce(trim(quote), '') = '' THEN 'no_quote' WHEN found IS NULL THEN 'unverified' WHEN found = q.page THEN 'verified' ELSE 'wrong_page' END AS status, round(score, 1) AS best_score FROM qn q LEFT JOIN found0 e ON q.b = e.b AND q.doc_id = e.doc_id AND q.item_id = e.item_id AND coalesce(q.page, -1) = e.page",
    "truth": "SELECT doc_id, 'quality' AS field_key, quality = 1 AS v, doc_id % 7 <> 0 AS present, CASE doc_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'hard' END AS difficulty FROM labels",
    "answers": "SELECT backend, doc_id, 'quality' AS field_key, (quality = 1) <> ((doc_id + backend) % 5 = 0) AS a, (doc_id + backend) % 13 <> 0 AS a_present FROM labels, (SELECT unnest([0, 1, 2]) AS backend) WHERE (3 * doc_id + backend) % 11 <> 0",
    "truth2": "SELECT doc_id, 'quality' AS field_key, quality = 1 AS v, doc_id % 7 <> 0 AS present, CASE doc_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'hard' END AS difficulty FROM labels UNION ALL SELECT doc_id, 'toxic', toxic = 1, doc_id % 5 <> 0, CASE doc_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'hard' END FROM labels",
    "answers2": "SELECT backend, doc_id, field_key, a, a_present, CAST(NULL AS DOUBLE) AS likeness FROM answers UNION ALL SELECT backend, doc_id, 'toxic', (toxic = 1) <> ((doc_id + backend) % 7 = 0), (doc_id + backend) % 6 <> 0, CAST((11 * doc_id + 17 * backend) % 100 AS DOUBLE) FROM labels, (SELECT unnest([0, 1, 2]) AS backend) WHERE (doc_id + 2 * backend) % 4 <> 0",
    "graded": "SELECT r.backend, t.doc_id, t.field_key, coalesce(t.difficulty, 'medium') AS difficulty, v, a, CASE WHEN a.a_present IS NULL THEN 'missing' WHEN NOT t.present THEN CASE WHEN a_present THEN 'wrong' ELSE 'correct' END WHEN NOT a_present AND (t.doc_id + r.backend) % 4 <> 0 THEN 'wrong' WHEN t.field_key = 'toxic' THEN CASE WHEN likeness >= 70 THEN 'correct' WHEN likeness >= 40 THEN 'partial' ELSE 'wrong' END WHEN v = a THEN 'correct' ELSE 'wrong' END AS verdict, CASE t.doc_id % 4 WHEN 0 THEN 'wrong_page' WHEN 1 THEN 'unverified' ELSE 'verified' END AS status FROM truth2 t JOIN (SELECT DISTINCT backend, doc_id FROM answers2) r USING (doc_id) LEFT JOIN answers2 a ON a.backend = r.backend AND a.doc_id = t.doc_id AND a.field_key = t.field_key",
    "calls": "SELECT l_returnflag AS backend, l_orderkey AS doc_id, l_linenumber AS cluster, CAST(l_quantity AS DOUBLE) AS tokens, CAST(l_extendedprice AS DOUBLE) AS cost, l_tax <> 0 AS ok FROM lineitem",
    "served": "SELECT backend, doc_id, a_present AS present, CAST(a AS VARCHAR) AS value, (37 * doc_id % 101) / 100.0 AS confidence, CASE doc_id % 4 WHEN 0 THEN 'wrong_page' WHEN 1 THEN 'unverified' ELSE 'verified' END AS evidence, CASE WHEN doc_id % 2 = 0 THEN 'deadline' ELSE 'scope' END AS category, 'Field ' || doc_id AS label FROM answers",
    "served2": "SELECT *, CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS bucket FROM served",
    "served3": "SELECT *, CASE WHEN NOT present THEN 'not_found' WHEN evidence = 'verified' AND bucket <> 'low' THEN 'found' ELSE 'needs_review' END AS status FROM served2",
    "fields": "SELECT * FROM (VALUES {fields}) AS f(field_key, number, type, cluster)",
    "kw": "SELECT * FROM (VALUES {kw}) AS k(field_key, cluster, keyword)",
    "kscore": "SELECT doc_id, field_key, cluster, page_no, sum((CASE WHEN contains(keyword, ' ') THEN 3.0 ELSE 1.0 END) * least((length(lower(text)) - length(replace(lower(text), keyword, ''))) // length(keyword), 5)) AS score FROM doc_pages, kw WHERE trim(text) <> '' GROUP BY ALL HAVING score > 0",
    "krank": "SELECT *, row_number() OVER (PARTITION BY doc_id, field_key ORDER BY score DESC, page_no) - 1 AS rank FROM kscore",
    "page_vec": "SELECT CAST(vec_id // 10 AS BIGINT) AS doc_id, CAST(vec_id % 10 + 1 AS INT) AS page_no, embedding AS v FROM embeddings",
    "field_vec": "SELECT CAST(label AS VARCHAR) AS field_key, arg_min(embedding, vec_id) AS q FROM embeddings GROUP BY label",
    "vscore": "SELECT doc_id, field_key, page_no, list_sum(list_transform(list_zip(CAST(v AS DOUBLE[]), CAST(q AS DOUBLE[])), lambda x: x[1] * x[2])) / sqrt(list_sum(list_transform(CAST(v AS DOUBLE[]), lambda x: x * x))) / sqrt(list_sum(list_transform(CAST(q AS DOUBLE[]), lambda x: x * x))) AS score FROM page_vec, field_vec",
    "vrank": "SELECT *, row_number() OVER (PARTITION BY doc_id, field_key ORDER BY score DESC, page_no) - 1 AS rank FROM vscore",
    "krank2": "SELECT doc_id, v.field_key, page_no, row_number() OVER (PARTITION BY doc_id, v.field_key ORDER BY score DESC, page_no) - 1 AS rank FROM (SELECT doc_id, page_no, score FROM kscore WHERE field_key = 'opening') k, (SELECT field_key FROM field_vec) v",
    "dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CAST(d AS VARCHAR) ELSE strftime(d, '%B %-d, %Y') END AS truth, CASE WHEN o_orderkey % 3 = 0 THEN CAST(a AS VARCHAR) ELSE strftime(a, '%B %-d, %Y') END || CASE WHEN o_orderkey % 5 = 0 THEN ' 2.00 PM MST' ELSE '' END AS answer, d, a FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CAST(CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END AS DATE) AS a FROM orders)",
}
NEEDS = {
    "doc_pages": ["lines"], "pn": ["doc_pages"], "hit": ["pn"], "quotes": ["quotes0"], "qn": ["quotes"], "exact0": ["qn", "pn"], "open0": ["exact0", "qn"], "ps": ["pn", "open0"], "fuzzy0": ["open0", "ps"], "pairs0": ["fuzzy0"], "found0": ["pairs0"], "evidence": ["found0"], "quotes0": ["hit", "doc_pages"], "answers2": ["answers"],
    "graded": ["truth2", "answers2"], "served": ["answers"], "served2": ["served"], "served3": ["served2"], "kscore": ["doc_pages", "kw"], "krank": ["kscore"],
    "vscore": ["page_vec", "field_vec"], "vrank": ["vscore"], "krank2": ["kscore", "field_vec"],
}


def sql(body: str, *views: str) -> str:
    """The body with the views that it needs, in order, before it."""
    from quillmark.plans.fixtures import FIELDS

    order: list[str] = []

    def add(v: str) -> None:
        for x in NEEDS.get(v, ()):
            add(x)
        if v not in order:
            order.append(v)

    for v in views:
        add(v)
    lit = lambda x: str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    fill = {
        "fields": ", ".join("(" + ", ".join(map(lit, f[:4])) + ")" for f in FIELDS),
        "kw": ", ".join(f"({lit(f[0])}, {lit(f[3])}, {lit(k)})" for f in FIELDS for k in f[4]),
    }
    text = {v: VIEWS[v].replace("{" + v + "}", fill.get(v, "")) for v in order}
    return ("WITH " + ",\n".join(f"{v} AS ({text[v]})" for v in order) + "\n" if order else "") + body
