"""DuckDB SQL for the registered queries."""

from __future__ import annotations

PATTERN = r"｟[^｠]*｠|\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"
_TOK = f"regexp_extract_all(%s, '{PATTERN}')"

LINES = """
ln0 AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
ln AS (SELECT doc_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS line_no FROM ln0)"""
TOKENS = LINES + f""",
tok AS (SELECT doc_id, line_no, line, {_TOK % 'line'} AS norm FROM ln)"""
SEGMENTS = TOKENS + """,
seg AS (SELECT row_number() OVER (ORDER BY doc_id, line_no) - 1 AS s_id, doc_id || ':' || line_no AS id, norm, len(norm) AS len FROM tok WHERE len(norm) BETWEEN 1 AND 300),
form AS (SELECT min(s_id) AS form, count(*) AS n, norm, len(norm) AS len FROM seg GROUP BY norm)"""
_VOCAB = """,
occ AS (SELECT form, n, unnest(norm) AS word, unnest(range(1, len + 1)) AS pos FROM form),
word1 AS (SELECT word, form, min(n) AS n, min(pos) AS pos FROM occ GROUP BY word, form),
word AS (SELECT word, sum(n)::BIGINT AS sfreq, min({'form': form, 'pos': pos}) AS first FROM word1 GROUP BY word),
vocab AS (SELECT word, row_number() OVER (ORDER BY first) + 1 AS wid, sfreq FROM word UNION ALL SELECT '', 0, 0 UNION ALL SELECT '｟unk｠', 1, 0)"""
VOCAB = SEGMENTS + _VOCAB
#: The exact tokenizer with case, number and tag penalties, on text of one script in a word and without joiners or marks apart.
_CASE = """CASE WHEN starts_with(t, '｟') OR lower(t) = upper(t) THEN 'N' WHEN t = lower(t) THEN 'L' WHEN t[1] <> lower(t[1]) AND substring(t, 2) = lower(substring(t, 2)) THEN 'C' WHEN t = upper(t) THEN 'U' ELSE 'M' END"""
_NORM = r"lambda t: CASE WHEN starts_with(t, '｟') THEN t WHEN regexp_matches(t, '^\p{N}') THEN '｟num｠' ELSE lower(t) END"
_REAL = f"lambda t: CASE WHEN {_CASE} = 'N' THEN t ELSE {_CASE} END"
EXACT = LINES + f""",
tok AS (SELECT doc_id, line_no, {_TOK % 'nfc_normalize(line)'} AS raw FROM ln),
seg AS (SELECT row_number() OVER (ORDER BY doc_id, line_no) - 1 AS s_id, doc_id || ':' || line_no AS id, list_transform(raw, {_NORM}) AS norm, list_transform(raw, {_REAL}) AS real, len(raw) AS len FROM tok WHERE len(raw) BETWEEN 1 AND 300),
form AS (SELECT min(s_id) AS form, count(*) AS n, norm, real, len(norm) AS len FROM seg GROUP BY norm, real)"""
#: Benchmark items with their tokens, and the text in pieces, spaces too.
_PIECES = PATTERN.replace(r"|[^\s", r"|\s+|[^\s")
EXACT_QUERIES = f""",
q0 AS (SELECT item_id AS q_id, nfc_normalize(coalesce(text, '')) AS t, {_TOK % "nfc_normalize(coalesce(text, ''))"} AS raw FROM benchmark),
q AS (SELECT q_id, t, list_transform(raw, {_NORM}) AS qn, list_transform(raw, {_REAL}) AS qr, len(raw) AS p, greatest(CASE WHEN len(raw) = 1 THEN 1 ELSE 2 END, least(3, len(raw))) AS k FROM q0 WHERE len(raw) BETWEEN 1 AND 300),
piece0 AS (SELECT q_id, unnest(regexp_extract_all(t, '{_PIECES}')) AS piece, generate_subscripts(regexp_extract_all(t, '{_PIECES}'), 1) AS i FROM q),
piece AS (SELECT *, sum(CASE WHEN trim(piece, ' ' || chr(9) || chr(10) || chr(13)) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY q_id ORDER BY i) AS tok FROM piece0)"""
#: Unit costs by the recurrence; equal tokens of other case or number cost by what differs. `pair` has qn, qr, norm, real, p and len.
EXACT_COST = """,
w AS (SELECT *, CAST(CAST(100 AS FLOAT) / CAST(greatest(p, len) AS FLOAT) AS FLOAT) AS dw FROM pair),
first AS (SELECT *, list_reduce(range(1, p + 1), lambda a, j: list_append(a, CAST(a[-1] + dw AS FLOAT)), [CAST(0 AS FLOAT)]) AS row0 FROM w),
cost AS (SELECT *, list_reduce(range(1, len + 1), lambda row, i: list_reduce(range(1, p + 1), lambda a, j: list_append(a, least(CAST(row[j + 1] + dw AS FLOAT), CAST(a[-1] + dw AS FLOAT), CAST(row[j] + (
  CASE WHEN qn[j] <> norm[i] THEN dw WHEN qr[j] = real[i] THEN CAST(0 AS FLOAT) WHEN real[i] IN ('', 'L', 'U', 'M', 'C') THEN CAST(1 AS FLOAT) ELSE CAST(2 AS FLOAT) END) AS FLOAT))), [CAST(row[1] + dw AS FLOAT)]), row0)[-1] AS cost FROM first)"""


def _queries(ratio: float = 0.0, run: int = 3, source: str = "SELECT item_id AS q_id, text FROM benchmark") -> str:
    return f""",
q0 AS (SELECT q_id, {_TOK % "coalesce(text, '')"} AS qn FROM ({source})),
q AS (SELECT q_id, qn, len(qn) AS p, greatest(CASE WHEN len(qn) = 1 THEN 1 ELSE 2 END, least({run}, len(qn)), CAST(trunc(CAST({ratio} AS FLOAT) * CAST(len(qn) AS FLOAT)) AS INTEGER)) AS k FROM q0 WHERE len(qn) BETWEEN 1 AND 300)"""


def _runs(norm: str = "1::FLOAT", near: str = "true") -> str:
    """Longest common runs by n-grams of the shortest run that counts, compared as lists."""
    return f""",
qg AS (SELECT q_id, p, k, i, qn[i : i + k - 1] AS g FROM (SELECT q_id, qn, p, k, unnest(range(1, p - k + 2)) AS i FROM q)),
ks AS (SELECT DISTINCT k FROM q),
sg AS (SELECT form, len, k, j, norm[j : j + k - 1] AS g FROM (SELECT form, norm, len, k, unnest(range(1, len - k + 2)) AS j FROM form, ks WHERE k <= len)),
hit AS (SELECT q_id, form, qg.k AS k, j - i AS d, i FROM qg JOIN sg ON qg.k = sg.k AND qg.g = sg.g WHERE {near}),
isl AS (SELECT q_id, form, k, d, i - row_number() OVER (PARTITION BY q_id, form, d ORDER BY i) AS island FROM hit),
run AS (SELECT q_id, form, max(c + k - 1)::INTEGER AS run FROM (SELECT q_id, form, k, count(*) AS c FROM isl GROUP BY q_id, form, k, d, island) GROUP BY q_id, form)"""


def _near(fuzzy: float, ins: float = 1, dele: float = 1, rep: float = 1, p: str = "p", s: str = "len") -> tuple[str, str]:
    """Normaliser, and the length condition."""
    f = lambda x: f"CAST({x} AS FLOAT)"
    if ins + dele <= rep:
        n = f"({f(ins)} * {f(p)} + {f(dele)} * {f(s)})"
    else:
        n = f"(CASE WHEN {p} <= {s} THEN {f(rep - dele)} * {f(p)} + {f(dele)} * {f(s)} ELSE {f(rep - ins)} * {f(s)} + {f(ins)} * {f(p)} END)"
    rest = f"(CASE WHEN {p} >= {s} THEN {f(ins)} ELSE {f(dele)} END)"
    bound = f"CAST({f(1)} - {rest} * abs({f(p)} - {f(s)}) / {n} AS FLOAT)"
    return n, f"CAST({bound} AS DOUBLE) + 0.000005 >= CAST({f(fuzzy)} AS DOUBLE)"


def _pairs(fuzzy: float, ins: float = 1, dele: float = 1, rep: float = 1) -> str:
    n, near = _near(fuzzy, ins, dele, rep)
    f = lambda x: f"CAST({x} AS FLOAT)"
    short = f"greatest({f('least(p, len)')} - {f('cover')}, {f(0)})"
    bound = f"CAST({f(1)} - ({f(rep)} * {short} + (CASE WHEN p > len THEN {f(ins)} ELSE {f(dele)} END) * ({f('greatest(p, len)')} - {f('least(p, len)')})) / {n} AS FLOAT)"
    return _runs(near=near) + f""",
pair0 AS (SELECT q_id, form, run, p, len, n, qn, norm, CASE WHEN run >= p THEN p ELSE len(list_filter(qn, lambda w: list_contains(norm, w))) END::INTEGER AS cover FROM run JOIN q USING (q_id) JOIN form USING (form)),
pair AS (SELECT * FROM pair0 WHERE CAST({bound} AS DOUBLE) + 0.000005 >= CAST({f(fuzzy)} AS DOUBLE))"""


#: Unit cost: every token is one byte, its first place in the query (all others share one), and the costs of the edits are added up in single precision.
_UNIT = """,
dist AS (SELECT *, levenshtein(array_to_string(list_transform(qn, lambda w: chr((list_position(qn, w) + 1)::INTEGER)), ''), array_to_string(list_transform(norm, lambda w: chr((coalesce(list_position(qn, w), 0) + 1)::INTEGER)), '')) AS steps FROM pair),
cost AS (SELECT *, CASE WHEN steps = 0 THEN CAST(0 AS FLOAT) ELSE list_reduce(list_transform(range(0, steps + 1), lambda x: CASE WHEN x = 0 THEN CAST(0 AS FLOAT) ELSE CAST(CAST(100 AS FLOAT) / CAST(greatest(p, len) AS FLOAT) AS FLOAT) END), lambda a, b: CAST(a + b AS FLOAT)) END AS cost FROM dist)"""
_SCORE = """,
scored AS (SELECT *, CAST(trunc(CAST(10000 AS FLOAT) - cost * CAST(100 AS FLOAT)) / 10000.0 AS FLOAT) AS score FROM cost)"""


def _dp(ins: float, dele: float, rep: float, idf: float = 0.0) -> str:
    """The recurrence as a list fold, row by row. With idf, a query token that is missing costs x[j] more."""
    n, _ = _near(0, ins, dele, rep)
    more = lambda cost: f"CAST({cost} + x[j] AS FLOAT)" if idf else cost
    x = ""
    if idf:
        x = f""",
big AS (SELECT count(*)::DOUBLE AS n_seg FROM seg),
qw AS (SELECT q_id, unnest(qn) AS word, unnest(range(1, p + 1)) AS i FROM q),
idfs AS (SELECT q_id, list(CASE WHEN sfreq > 0 THEN CAST(ln(n_seg / sfreq) AS FLOAT) ELSE CAST(0 AS FLOAT) END ORDER BY i) AS idf FROM qw LEFT JOIN vocab USING (word), big GROUP BY q_id)"""
    own = f"list_transform(idf, lambda v: CAST(v * CAST(CAST(dw * CAST({idf} AS FLOAT) AS FLOAT) / CAST(ln(n_seg) AS FLOAT) AS FLOAT) AS FLOAT)) AS x, " if idf else ""
    return x + f""",
dw AS (SELECT *, CAST(CAST(100 AS FLOAT) / {n} AS FLOAT) AS dw FROM pair{' JOIN idfs USING (q_id), big' if idf else ''}),
w AS (SELECT *, {own}CAST({ins} AS FLOAT) * dw AS wi, CAST({dele} AS FLOAT) * dw AS wd, CAST({rep} AS FLOAT) * dw AS wr FROM dw),
first AS (SELECT *, list_reduce(range(1, p + 1), lambda a, j: list_append(a, {more("CAST(a[-1] + wi AS FLOAT)")}), [CAST(0 AS FLOAT)]) AS row0 FROM w),
cost AS (SELECT *, list_reduce(norm, lambda row, tok: list_reduce(range(1, p + 1), lambda a, j: list_append(a, least(CAST(row[j + 1] + wd AS FLOAT), {more("CAST(a[-1] + wi AS FLOAT)")}, CAST(row[j] + (CASE WHEN qn[j] = tok THEN CAST(0 AS FLOAT) ELSE {more("wr")} END) AS FLOAT))), [CAST(row[1] + wd AS FLOAT)]), row0)[-1] AS cost FROM first)"""


def _ranked(fuzzy: float, more: str = "true", same: str = "seg.norm = form.norm") -> str:
    return f""",
hits AS (SELECT q_id, form, score, run, len FROM scored WHERE score >= CAST({fuzzy} AS FLOAT) AND {more}),
each AS (SELECT q_id, score, run AS max_subseq, s_id, id, hits.len AS length FROM hits JOIN form USING (form) JOIN seg ON {same}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, s_id) AS rank FROM each)"""


def _top(fuzzy: float, n: int, more: str = "true") -> str:
    keep = f"WHERE rank <= {n}" if n else ""
    return _ranked(fuzzy, more) + f"""
SELECT q_id, rank::INTEGER AS rank, round(CAST(score AS DOUBLE), 4) AS score, max_subseq, s_id, id, length::INTEGER AS length FROM ranked {keep}"""


_MATCH5 = "WITH " + SEGMENTS + _queries() + _pairs(0.2) + _UNIT + _SCORE
_PUNCT = r"NOT starts_with(t, '｟') AND NOT regexp_matches(t, '^[\p{L}\p{N}]')"

ORACLES = {
    "src_lines": f"WITH {LINES} SELECT doc_id, line_no::INTEGER AS line_no, line FROM ln",
    "id_policy": """
WITH a AS (SELECT conv_id, turn, role || chr(9) || text AS line FROM conversations),
b AS (SELECT conv_id, turn, string_split(line, chr(9))[1] AS source, CASE WHEN instr(line, chr(9)) > 0 THEN substring(line, instr(line, chr(9)) + 1) ELSE '' END AS target, (conv_id * 1000 + turn)::VARCHAR AS id FROM a)
SELECT conv_id, turn, source, target, id, id || '=' || target AS id_target, target AS id_only FROM b""",
    "bitext_zip": """
WITH a AS (SELECT row_number() OVER (ORDER BY page_id) AS line_no, url FROM pages), b AS (SELECT row_number() OVER (ORDER BY item_id) AS line_no, text FROM benchmark)
SELECT line_no::INTEGER AS line_no, url AS line, coalesce(text, '') AS target FROM a LEFT JOIN b USING (line_no)""",
    "nfc_text": f"WITH {LINES} SELECT doc_id, line_no::INTEGER AS line_no, nfc_normalize(line) AS text FROM ln",
    "tokenize": f"WITH {TOKENS} SELECT doc_id, line_no::INTEGER AS line_no, array_to_string(norm, ' ') AS norm, len(norm)::INTEGER AS n_tokens FROM tok",
    "case_feature": f"""WITH {TOKENS}, t AS (SELECT unnest(norm) AS token FROM tok), c AS (SELECT token, count(*) AS n FROM t GROUP BY token)
SELECT token, n, CASE WHEN starts_with(token, '｟') OR lower(token) = upper(token) THEN 'N' WHEN token = lower(token) THEN 'L'
  WHEN token[1] <> lower(token[1]) AND substring(token, 2) = lower(substring(token, 2)) THEN 'C' WHEN token = upper(token) THEN 'U' ELSE 'M' END AS feature FROM c""",
    "number_fold": f"""WITH {TOKENS}, t AS (SELECT unnest(norm) AS token FROM tok)
SELECT CASE WHEN regexp_matches(token, '^\\p{{N}}') THEN '｟num｠' ELSE token END AS norm, count(*) AS n, count(DISTINCT token) AS n_forms FROM t GROUP BY 1""",
    "placeholder_fold": """SELECT page_id, CASE WHEN length(url) % 2 = 0 THEN '｟it｠' ELSE '｟' || string_split(string_split('ent' || substring(url, 9, 3), '＃')[1], '｠')[1] || '｠' END AS norm FROM pages""",
    "punct_strip": f"""
WITH {TOKENS}, e AS (SELECT doc_id, line_no, unnest(norm) AS t, unnest(range(1, len(norm) + 1)) AS i FROM tok),
f AS (SELECT *, {_PUNCT} AS gone FROM e),
g AS (SELECT *, coalesce(sum(CASE WHEN gone THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, line_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS slot FROM f),
s AS (SELECT doc_id, line_no, slot, coalesce(string_agg(t, '' ORDER BY i) FILTER (WHERE gone), '') AS itok FROM g GROUP BY ALL),
k AS (SELECT doc_id, line_no, coalesce(string_agg(t, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS norm, count(*) FILTER (WHERE NOT gone) AS n FROM g GROUP BY ALL),
r AS (SELECT doc_id, line_no, coalesce(k.norm, '') AS norm, unnest(range(0, coalesce(n, 0) + 1)) AS slot FROM ln LEFT JOIN k USING (doc_id, line_no))
SELECT doc_id, line_no::INTEGER AS line_no, r.norm AS norm, string_agg(coalesce(itok, ''), '|' ORDER BY slot) AS itoks FROM r LEFT JOIN s USING (doc_id, line_no, slot) GROUP BY doc_id, line_no, r.norm""",
    "segment_admission": f"WITH {SEGMENTS} SELECT s_id, id, seg.len::INTEGER AS n_tokens, form, n AS n_same FROM seg JOIN form USING (norm)",
    "segment_decode": f"WITH {SEGMENTS} SELECT s_id, '> ' || array_to_string(norm, ' ') AS decoded FROM seg",
    "vocab_ids": f"WITH {VOCAB} SELECT word, wid, sfreq FROM vocab",
    "vocab_idf": f"WITH {VOCAB} SELECT word, sfreq, round(ln((SELECT count(*) FROM seg)::DOUBLE / sfreq), 6) AS idf, (SELECT count(*) FROM seg) AS n_segments FROM vocab WHERE sfreq > 0",
    "query_encode": f"""WITH {VOCAB}{_queries()}, e AS (SELECT q_id, unnest(qn) AS word, unnest(range(1, p + 1)) AS i FROM q)
SELECT q_id, string_agg(coalesce(wid, 1)::VARCHAR, ' ' ORDER BY i) AS wids FROM e LEFT JOIN vocab USING (word) GROUP BY q_id""",
    "word_decode": f"WITH {VOCAB}, r AS (SELECT unnest(range(0, 2 * (SELECT count(*) FROM seg))) AS wid) SELECT wid, coalesce(word, '｟unk｠') AS word FROM r LEFT JOIN vocab USING (wid)",
    "suffix_order": f"""WITH {SEGMENTS}, e AS (SELECT s_id, norm[i :] AS suffix, i AS pos FROM (SELECT s_id, norm, unnest(range(1, len + 1)) AS i FROM seg))
SELECT s_id, pos::INTEGER AS pos, suffix[1] AS word, row_number() OVER (PARTITION BY suffix[1] ORDER BY suffix, s_id, pos)::INTEGER AS place FROM e""",
    "ngram_lookup": f"""WITH {SEGMENTS}{_queries()}, qg AS (SELECT q_id, i, qn[i : i + 2] AS g FROM (SELECT q_id, qn, unnest(range(1, p - 1)) AS i FROM q)),
sg AS (SELECT norm[j : j + 2] AS g, count(*) AS n FROM (SELECT norm, unnest(range(1, len - 1)) AS j FROM seg) GROUP BY 1)
SELECT q_id, (i - 1)::INTEGER AS q_pos, n AS n_suffixes FROM qg JOIN sg USING (g)""",
    "longest_run": "WITH " + SEGMENTS + _queries() + _runs() + " SELECT q_id, form, run FROM run",
    "length_band": "WITH " + SEGMENTS + _queries() + _runs(near=_near(0.2)[1]) + " SELECT q_id, form, run FROM run",
    "cover_filter": "WITH " + SEGMENTS + _queries() + _pairs(0.2) + " SELECT q_id, form, run, cover FROM pair",
    "edit_unit": _MATCH5 + " SELECT q_id, form, greatest(p, len)::DOUBLE AS normalizer, round(CAST(cost AS DOUBLE), 3) AS cost, round(CAST(score AS DOUBLE), 4) AS score FROM scored WHERE score >= CAST(0.2 AS FLOAT)",
    "match_top5": _MATCH5 + _top(0.2, 5),
    "match_all": "WITH " + SEGMENTS + _queries() + _pairs(0.1) + _UNIT + _SCORE + _top(0.1, 0),
    "match_no_perfect": _MATCH5 + _top(0.2, 5, "NOT (steps = 0 AND p = len)"),
    "match_coverage": "WITH " + SEGMENTS + _queries() + _pairs(0.2, 1, 0, 1) + _dp(1, 0, 1) + _SCORE + _top(0.2, 5),
    "match_weighted": "WITH " + SEGMENTS + _queries() + _pairs(0.2, 1.0, 0.5, 1.25) + _dp(1.0, 0.5, 1.25) + _SCORE + _top(0.2, 5),
    "match_exists": _MATCH5 + ", m AS (SELECT DISTINCT q_id FROM scored WHERE score >= CAST(0.2 AS FLOAT)) SELECT item_id AS q_id, m.q_id IS NOT NULL AS matched FROM benchmark LEFT JOIN m ON m.q_id = item_id",
    "match_stats": _MATCH5 + " SELECT (SELECT count(*) FROM benchmark) AS n_queries, count(DISTINCT q_id) AS n_matched FROM scored WHERE score >= CAST(0.2 AS FLOAT)",
    "match_turns": "WITH " + SEGMENTS + _queries(0.1, 3, "SELECT conv_id * 1000 + turn AS q_id, text FROM conversations") + _pairs(0.25) + _dp(1, 1, 1) + _SCORE + _top(0.25, 5),
}
ORACLES["stream_match"] = ORACLES["match_top5"]
_LINE = "format('{:.9g}', CAST(score AS DOUBLE))"
ORACLES["match_lines"] = _MATCH5 + _ranked(0.2) + f""",
l AS (SELECT q_id, string_agg({_LINE} || chr(9) || id, chr(9) ORDER BY rank) AS line FROM ranked WHERE rank <= 5 GROUP BY q_id)
SELECT item_id AS q_id, coalesce(line, '') AS line FROM benchmark LEFT JOIN l ON q_id = item_id"""
ORACLES["match_idf"] = "WITH " + VOCAB + _queries() + _pairs(0.1) + _dp(1, 1, 1, 0.5) + _SCORE + _top(0.1, 5)


def _subsequence(weight: str = "size::DOUBLE", keep: str = "true", start: str = "", cost: str = "", more: str = "", span: str = "array_to_string(qn[w.head : w.head + w.size - 1], ' ')") -> str:
    return "WITH " + (start or VOCAB + _queries()) + _runs() + f""",
big AS (SELECT count(*)::DOUBLE AS n_seg FROM seg),
qw AS (SELECT q_id, i, coalesce(CAST(CAST(ln(n_seg / nullif(sfreq, 0)) AS FLOAT) AS DOUBLE), 0) AS idf FROM (SELECT q_id, unnest(qn) AS word, unnest(range(1, p + 1)) AS i FROM q) LEFT JOIN vocab USING (word), big),
cum AS (SELECT q_id, i, sum(idf) OVER (PARTITION BY q_id ORDER BY i) AS upto FROM qw UNION ALL SELECT q_id, 0, 0 FROM q),
spans0 AS (SELECT q_id, form, d, k, i0, (c + k - 1) AS size FROM (SELECT q_id, form, d, k, min(i) AS i0, count(*) AS c FROM (SELECT *, i - row_number() OVER (PARTITION BY q_id, form, d ORDER BY i) AS island FROM hit) GROUP BY q_id, form, d, k, island)),
spans AS (SELECT s.q_id, s.form, s.d, s.i0, s.size, {weight} AS weight FROM spans0 s JOIN q ON q.q_id = s.q_id JOIN form ON form.form = s.form JOIN cum a ON a.q_id = s.q_id AND a.i = s.i0 - 1 JOIN cum b ON b.q_id = s.q_id AND b.i = s.i0 + s.size - 1 WHERE {keep}),
best AS (SELECT q_id, max({{'weight': weight, 'back': -i0, 'size': size}}) AS b FROM spans GROUP BY q_id),
inside AS (SELECT s.q_id, s.form, -b.back AS head, b.size AS size, -b.back + s.d AS f FROM spans s JOIN best USING (q_id) WHERE s.i0 <= -b.back AND s.i0 + s.size >= b.size - b.back),
words AS (SELECT q_id, form, head, size, f, unnest(norm[f:]) AS word, unnest(range(f, len + 1)) AS pos FROM inside JOIN form USING (form)),
tails AS (SELECT q_id, form, head, size, min(tail) AS tail FROM (SELECT q_id, form, head, size, f, list(wid ORDER BY pos) AS tail FROM words JOIN vocab USING (word) GROUP BY ALL) GROUP BY ALL),
tried AS (SELECT *, row_number() OVER z AS turn, coalesce(sum(n) OVER (PARTITION BY q_id ORDER BY tail, form ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM tails JOIN form USING (form) WINDOW z AS (PARTITION BY q_id ORDER BY tail, form)),
pair AS (SELECT tried.*, qn, p{more} FROM tried JOIN q USING (q_id) WHERE seen < 5)""" + (cost or _UNIT) + _SCORE + f""",
won AS (SELECT q_id, min({{'cost': cost, 'turn': turn, 'form': form, 'score': score, 'size': size, 'head': head}}) AS w FROM scored GROUP BY q_id),
sub AS (SELECT won.q_id, w.score AS score, w.size::INTEGER AS max_subseq, s_id, id, {span} AS span FROM won JOIN seg ON s_id = w.form JOIN q ON q.q_id = won.q_id)"""


_SHOWN = " SELECT q_id, round(CAST(score AS DOUBLE), 4) AS score, max_subseq, s_id, id, span FROM sub"
ORACLES["subseq_best"] = _subsequence() + _SHOWN
ORACLES["subseq_idf"] = _subsequence("round(b.upto - a.upto, 6)") + _SHOWN
ORACLES["subseq_no_perfect"] = _subsequence(keep="norm <> qn") + _SHOWN
ORACLES["subseq_lines"] = _subsequence() + f""", l AS (SELECT q_id, {_LINE} || chr(9) || max_subseq || chr(9) || id || chr(9) || span AS line FROM sub)
SELECT item_id AS q_id, coalesce(line, '') AS line FROM benchmark LEFT JOIN l ON q_id = item_id"""


def _contrast(reduce: str) -> str:
    """The first three picks, one after the other, from the 20 best of each query."""
    f = lambda x: f"CAST({x} AS FLOAT)"
    worth = lambda pen: f"{f('c.score')} - {f(0.7)} * {f(pen)}"
    both = {"max": "greatest(x.sim, y.sim)", "mean": f"{f(f('x.sim') + ' + ' + f('y.sim'))} / {f(2)}"}[reduce]
    return "WITH " + SEGMENTS + _queries() + _pairs(0.1) + _UNIT + _SCORE + _ranked(0.1) + f""",
c AS (SELECT q_id, rank, score, ranked.s_id, norm, ranked.length AS len FROM ranked JOIN seg ON seg.s_id = ranked.s_id WHERE rank <= 20),
two AS (SELECT a.q_id, a.rank AS r1, b.rank AS r2, a.norm AS n1, b.norm AS n2, greatest(a.len, b.len) AS m,
  list_reduce(a.norm, lambda row, tok: list_reduce(range(1, b.len + 1), lambda l, j: list_append(l, least(row[j + 1] + 1, l[-1] + 1, row[j] + CASE WHEN b.norm[j] = tok THEN 0 ELSE 1 END)), [row[1] + 1]), range(0, b.len + 1))[-1] AS steps
  FROM c a JOIN c b ON a.q_id = b.q_id AND a.rank < b.rank),
paid AS (SELECT q_id, r1, r2, CASE WHEN steps = 0 THEN {f(0)} ELSE list_reduce(list_transform(range(0, steps + 1), lambda x: CASE WHEN x = 0 THEN {f(0)} ELSE {f(f(100) + ' / ' + f('m'))} END), lambda a, b: {f('a + b')}) END AS cost FROM two),
sim0 AS (SELECT q_id, r1, r2, trunc({f(10000)} - cost * {f(100)}) / 10000.0 AS sim FROM paid),
sim AS (SELECT * FROM sim0 UNION ALL SELECT q_id, r2, r1, sim FROM sim0),
p1 AS (SELECT q_id, rank, score, s_id FROM c WHERE rank = 1),
w2 AS (SELECT c.q_id, c.rank, c.score, c.s_id, x.sim AS penalty, row_number() OVER (PARTITION BY c.q_id ORDER BY {worth('x.sim')} DESC, c.rank) AS turn FROM c JOIN sim x ON x.q_id = c.q_id AND x.r1 = c.rank AND x.r2 = 1),
p2 AS (SELECT * FROM w2 WHERE turn = 1),
w3 AS (SELECT c.q_id, c.rank, c.score, c.s_id, {both} AS penalty, row_number() OVER (PARTITION BY c.q_id ORDER BY {worth(both)} DESC, c.rank) AS turn
  FROM c JOIN p2 ON p2.q_id = c.q_id JOIN sim x ON x.q_id = c.q_id AND x.r1 = c.rank AND x.r2 = 1 JOIN sim y ON y.q_id = c.q_id AND y.r1 = c.rank AND y.r2 = p2.rank WHERE c.rank <> p2.rank),
picks AS (SELECT q_id, 1 AS rank, score, 0.0::DOUBLE AS penalty, s_id FROM p1 UNION ALL SELECT q_id, 2, score, penalty::DOUBLE, s_id FROM p2 UNION ALL SELECT q_id, 3, score, penalty::DOUBLE, s_id FROM w3 WHERE turn = 1)
SELECT q_id, rank::INTEGER AS rank, round(CAST(score AS DOUBLE), 4) AS score, round(penalty, 4) AS penalty, s_id FROM picks"""


ORACLES["contrast_mean"], ORACLES["contrast_max"] = _contrast("mean"), _contrast("max")
ORACLES["match_penalties"] = "WITH " + EXACT + EXACT_QUERIES + _pairs(0.2).replace("cover FROM run JOIN", "cover, qr, real FROM run JOIN") + EXACT_COST + _SCORE + _ranked(0.2, same="seg.norm = form.norm AND seg.real = form.real") + """
SELECT q_id, rank::INTEGER AS rank, round(CAST(score AS DOUBLE), 4) AS score, max_subseq, s_id, id, length::INTEGER AS length FROM ranked WHERE rank <= 5"""
_SPAN = "(SELECT trim(string_agg(piece, '' ORDER BY i)) FROM piece WHERE piece.q_id = won.q_id AND tok BETWEEN w.head AND w.head + w.size - 1 AND (tok < w.head + w.size - 1 OR trim(piece, ' ' || chr(9) || chr(10) || chr(13)) <> ''))"
ORACLES["subseq_text"] = _subsequence(start=EXACT + _VOCAB + EXACT_QUERIES, cost=EXACT_COST, more=", qr", span=_SPAN) + _SHOWN
