"""The queries' results in SQL. Word lists and patterns are stated apart from the library's, in sql_values."""

from __future__ import annotations

from lexloom import sql_values as V


def _list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _tokens(text: str) -> str:
    """Retrieval tokens of a text as a list."""
    return f"list_filter(string_split(trim(regexp_replace(lower(coalesce({text}, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: length(t) > 1 AND t NOT IN ({_list(V.RETRIEVAL_STOP)}) AND NOT regexp_matches(t, '^[0-9]{{1,4}}$'))"


_REPEALED = r"regexp_matches(coalesce(title, '') || ' ' || coalesce(text, '')[1:80], '(?i)\brepealed\b|\[repealed\]|^\s*rep\.\s+by')"
_SCORES = f"""
WITH docs AS (SELECT * FROM statute_supplements WHERE NOT regexp_matches(coalesce(title, '') || ' ' || coalesce(text, '')[1:80], '(?i)\\brepealed\\b|\\[repealed\\]|^\\s*rep\\.\\s+by')),
b AS (SELECT row_id, code, list_distinct({_tokens("concat_ws(' ', section, title, text, array_to_string(keywords, ' '))")}) AS body, {_tokens("title")} AS head FROM docs),
d AS (SELECT row_id, code, token, list_contains(head, token) AS in_title FROM (SELECT row_id, code, head, unnest(body) AS token FROM b)),
f AS (SELECT token, count(*) AS df FROM d GROUP BY token),
w AS (SELECT token, df, ln(((SELECT count(*) FROM docs) + 1)::DOUBLE / (df + 1)) + 1 AS idf FROM f),
q AS (SELECT item_id, unnest(list_distinct({_tokens("text")})) AS token FROM eval_items),
s AS (SELECT item_id, d.row_id, any_value(d.code) AS code, round(sum(idf + CASE WHEN in_title THEN 8.0 ELSE 0.0 END), 6) AS score FROM q JOIN w USING (token) JOIN d USING (token) GROUP BY item_id, d.row_id)
"""

def _sections(group: int) -> str:
    return rf"regexp_extract_all(coalesce(facts, ''), '(?i)\b(?:(ipc|bns)\s*(?:section\s*)?|section\s+)([0-9]{{1,3}}[a-z]{{0,3}})\b', {group})"



def _date_rows() -> str:
    """Every date of every case: form, place in its form, value, raw text."""
    parts = []
    months = " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(V.MONTHS, 1))
    for k, (pattern, (y, m, d)) in enumerate(zip(V.PATTERNS, V.GROUPS)):
        get = lambda g, p=pattern: f"regexp_extract_all(coalesce(facts, ''), '{p}', {g})"
        month = "try_cast(m AS INTEGER)" if k < 2 else f"CASE lower(m) {months} END"
        parts.append(f"SELECT row_id, facts, {k} AS form, i, format('{{}}-{{:02d}}-{{:02d}}', y, {month}, try_cast(d AS INTEGER)) AS value, raw FROM (SELECT row_id, facts, unnest({get(y)}) AS y, unnest({get(m)}) AS m, unnest({get(d)}) AS d, unnest({get(0)}) AS raw, generate_subscripts({get(0)}, 1) AS i FROM candidate_cases)")
    return " UNION ALL ".join(parts)


_HINTS = " + ".join(f"contains(around, '{h}')::INTEGER" for h in V.OFFENCE_HINTS)
_ROUTES = f"""
WITH every AS (SELECT * FROM ({_date_rows()}) WHERE try_strptime(value, '%Y-%m-%d') IS NOT NULL),
one AS (SELECT row_id, any_value(facts) AS facts, value, min(form * 100000 + i) AS place, arg_max(raw, form * 100000 + i) AS raw FROM every GROUP BY row_id, value),
near AS (SELECT *, lower(facts[greatest(1, instr(facts, raw) - 45) : instr(facts, raw) + length(raw) + 44]) AS around FROM one),
ranked AS (SELECT row_id, value, hints, row_number() OVER (PARTITION BY row_id ORDER BY hints DESC, place) AS r FROM (SELECT row_id, value, place, {_HINTS} AS hints FROM near)),
by_case AS (SELECT row_id, count(*) AS n, min(value) AS low, max(value) AS high, max(CASE WHEN r = 1 THEN value END) AS best, max(CASE WHEN r = 1 THEN hints END) AS h1, max(CASE WHEN r = 2 THEN hints END) AS h2 FROM ranked GROUP BY row_id),
c AS (SELECT c.row_id, c.case_id, regexp_matches(lower(coalesce(facts, '')), '{V.CONTINUING}') AS going_on, coalesce(n, 0) AS n_dates, low, high, CASE WHEN n > 1 AND h1 = h2 AND regexp_matches(lower(facts), '{V.UNDECIDED}') THEN NULL ELSE best END AS offence FROM candidate_cases c LEFT JOIN by_case USING (row_id)),
routes AS (SELECT row_id, case_id, offence, going_on, n_dates, CASE WHEN going_on AND n_dates > 1 AND low < '{V.CUTOFF}' AND high >= '{V.CUTOFF}' THEN 'MULTI_PERIOD_REVIEW' WHEN offence IS NULL THEN 'CLARIFY' WHEN offence < '{V.CUTOFF}' THEN 'IPC_ONLY' ELSE 'BNS_PRIMARY' END AS route FROM c)
"""

_PAGES = """
WITH p AS (SELECT row_id, source.file AS file, source.page AS page, coalesce(sum(coalesce(length(text), 0) + 2) OVER (PARTITION BY source.file ORDER BY source.page, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS page_start FROM statute_supplements WHERE source.page IS NOT NULL)
"""
_TOKEN = "[\\p{L}\\p{M}\\x{200C}\\x{200D}]+(?:[''’][\\p{L}\\p{M}]+)?|\\p{N}+(?:[.,:/-]\\p{N}+)*|[^\\s\\p{L}\\p{M}\\p{N}]"
_EN_TOKENS = f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_TOKEN}')) AS token FROM documents WHERE lang = 'en'),
k AS (SELECT doc_id, token, lower(token) AS word, CASE WHEN regexp_matches(token, '^\\p{{N}}') THEN 'number' WHEN regexp_matches(token, '^[\\p{{L}}\\p{{M}}\\x{{200C}}\\x{{200D}}]') THEN 'word' ELSE 'punct' END AS kind FROM t)
"""
_ARMS = "WITH a AS (SELECT l_suppkey, l_returnflag, sum(l_quantity) AS errors, round(avg(l_extendedprice), 4) AS cost FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL), p AS (SELECT l_suppkey, max(errors) FILTER (l_returnflag = 'A') AS be, max(errors) FILTER (l_returnflag = 'R') AS ce, max(cost) FILTER (l_returnflag = 'A') AS bc, max(cost) FILTER (l_returnflag = 'R') AS cc FROM a GROUP BY l_suppkey HAVING count(*) = 2)"
_VISITS = "WITH v AS (SELECT DISTINCT user_id, epoch_us(ts) // 3600000000 * 3600 AS s FROM events WHERE ts IS NOT NULL), iv AS (SELECT user_id, s AS start, s + 3600 AS \"end\" FROM v)"
_LABELS = "l AS (SELECT case_id, max(applicable_law) AS law, max(concat_ws(' ', correct_top1_provision.code, correct_top1_provision.section)) AS top1 FROM gold_labels GROUP BY case_id)"
_DIGITS = "translate(coalesce({c}, ''), '" + "".join(chr(b + k) for b in V.DIGIT_BLOCKS for k in range(10)) + "', '" + "0123456789" * len(V.DIGIT_BLOCKS) + "')"


def _numbers(c: str) -> str:
    return f"regexp_extract_all({_DIGITS.format(c=c)}, '[0-9]+(?:[.,][0-9]+)*')"


def _delimited() -> str:
    return _list(sorted((set(V.ENGLISH_STOP) - set(V.ENGLISH_NEGATIONS)) | set(V.PHRASE_NOISE) | set(V.MONTHS) | set(V.MONTHS_SHORT)))


_P, _N, _M = "IPC_ONLY", "BNS_PRIMARY", "MULTI_PERIOD_REVIEW"
#: Rules by cue: provision, points, routes.
_RULES = {
    "retained theft": ("IPC-378:30:PNM", "IPC-379:30:PNM", "BNS-303:30:PNM"), "theft": ("IPC-378:35:PM", "IPC-379:40:PM", "BNS-303:35:NM"), "retention": ("IPC-403:35:PNM", "BNS-314:35:PNM"),
    "death": ("IPC-299:35:PNM", "IPC-300:35:PNM", "BNS-100:35:PNM", "BNS-101:35:PNM"), "stalking": ("IPC-354D:35:PNM", "BNS-78:35:PNM"), "cheating": ("BNS-318:35:NM", "IPC-420:35:PM", "IPC-415:25:PM"),
    "grievous hurt": ("BNS-117:45:NM", "BNS-116:38:NM", "IPC-322:45:PM", "IPC-320:38:PM", "IPC-325:35:PM"), "serious hurt": ("BNS-117:24:NM", "BNS-116:20:NM", "IPC-322:24:PM", "IPC-320:20:PM"),
    "hurt": ("BNS-115:40:NM", "BNS-114:36:NM", "BNS-117:26:NM", "BNS-116:22:NM", "IPC-321:40:PM", "IPC-319:36:PM", "IPC-322:26:PM", "IPC-320:22:PM", "IPC-323:25:PM"),
}


def _rules() -> str:
    """Rules as rows: cue, family, order, code, section, route, points."""
    rows = []
    for order, (cue, provisions) in enumerate(_RULES.items()):
        for provision in provisions:
            name, points, routes = provision.split(":")
            code, section = name.split("-")
            rows += [f"('{cue}', '{cue.split()[-1]}', {order}, '{code}', '{section}', '{ {'P': _P, 'N': _N, 'M': _M}[r] }', {points}.0)" for r in routes]
    return f"(VALUES {', '.join(rows)}) AS rules(cue, family, ord, code, section, route, points)"


def _cue(text: str) -> str:
    """The cues of a text as a list; those that need more than words and phrases (retention, deaths, stalking) are left out."""
    words = f"string_split(regexp_replace(lower(coalesce({text}, '')), '[^a-z0-9]+', ' ', 'g'), ' ')"
    said = lambda some: f"list_has_any({words}, [{_list(some.split())}])"
    told = lambda *labels: "(" + " OR ".join(f"regexp_matches(lower(coalesce({text}, '')), '{p}')" for label, p in V.PHRASES if label in labels) + ")"
    owned = f"({told('movable property', 'mobile phone', 'phone property')} OR {said('property')})"
    theft = f"({said('theft')} OR {told('victim property stolen')} OR regexp_matches(trim(lower(coalesce({text}, ''))), '^(?:20[0-9]{{2}}[-/.][0-9]{{1,2}}[-/.][0-9]{{1,2}}\\s+)?(?:it\\s+(?:was|is)\\s+)?stolen[.!?\\s]*$') OR {owned} AND ({said('steal steals stealing stole')} OR {told('without consent', 'without permission')} AND ({said('stolen take took taking taken takes moved moves dishonest dishonestly')} OR {told('out of possession', 'from possession')})))"
    handed = f"({said('deliver delivered delivering delivers delivery give gave giving hand handed transfer transferred transferring transfers sell sold selling')} OR {told('deliver property', 'give property', 'hand over property', 'transfer property', 'sell property', 'delivery of property', 'deceived into property transfer', 'led to property transfer')})"
    misled = f"({said('deceive deceived deceiving deception deceptive trick tricked cheated defraud defrauded defrauding defrauds fraud fraudulent fraudulently')} OR {told('deceived person', 'tricked person', 'deceived into property transfer')})"
    cheating = f"({said('cheating')} OR {misled} AND ({said('property')} OR {handed}) AND ({handed} OR {said('dishonest dishonestly unjustly unfairly unfaithfully treasonfully disloyalty')}))"
    grievous = f"({said('grievous')} OR {told('grievous hurt')})"
    serious = f"({said('serious seriously')} OR {told('seriously injured', 'serious injury')})"
    harmed = f"({grievous} OR {serious} OR {said('hurt hurts injure injured injures injury injuries wound wounded bodily pain')} OR {told('caused hurt', 'caused injury', 'physical injury', 'physical harm', 'bodily pain')})"
    parts = (("theft", theft), ("cheating", cheating), ("grievous hurt", grievous), ("serious hurt", serious), ("hurt", harmed))
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{name}' END" for name, c in parts) + "], lambda x: x IS NOT NULL)"


def _ranked() -> str:
    labels = ", ".join(f"CASE WHEN regexp_matches(lower(facts), '{p}') THEN '{label}' END" for label, p in V.PHRASES)
    return _ROUTES + f"""
, q AS (SELECT c.row_id, c.facts, r.route, CASE r.route WHEN 'BNS_PRIMARY' THEN 'BNS' ELSE 'IPC' END AS prim, {_sections(1)} AS rc, {_sections(2)} AS rs, {_cue('facts')} AS cues FROM (SELECT * FROM candidate_cases QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY row_id DESC) = 1) c JOIN routes r USING (row_id) WHERE facts IS NOT NULL AND r.route <> 'CLARIFY'),
docs AS (SELECT * FROM statute_supplements WHERE NOT {_REPEALED}),
b AS (SELECT row_id, list_distinct({_tokens("concat_ws(' ', section, title, text, array_to_string(keywords, ' '))")}) AS body, {_tokens("title")} AS head FROM docs),
d AS (SELECT row_id AS doc, token, list_contains(head, token) AS in_title FROM (SELECT row_id, head, unnest(body) AS token FROM b)),
w AS (SELECT token, ln(((SELECT count(*) FROM docs) + 1)::DOUBLE / (count(*) + 1)) + 1 AS idf FROM d GROUP BY token),
qt AS (SELECT row_id, unnest(list_distinct({_tokens(f"concat_ws(' ', facts, {labels})")})) AS token FROM q),
s AS (SELECT qt.row_id, d.doc, sum(idf + CASE WHEN in_title THEN 8.0 ELSE 0.0 END) AS score FROM qt JOIN w USING (token) JOIN d USING (token) GROUP BY ALL),
rf AS (SELECT row_id, route, prim, upper(unnest(rc)) AS rcode, upper(unnest(rs)) AS rsec FROM q),
ex AS (SELECT DISTINCT rf.row_id, docs.row_id AS doc, 50.0 AS points FROM rf JOIN docs ON upper(docs.section) = rsec AND (rcode = '' OR rcode IS NULL OR rcode = docs.code)),
mp AS (SELECT DISTINCT rf.row_id, docs.row_id AS doc, 30.0 AS points FROM rf JOIN docs ON rcode <> '' AND rcode <> docs.code AND (route = 'MULTI_PERIOD_REVIEW' OR docs.code = prim) AND list_contains([string_split(m, '-r')[1] FOR m IN coalesce(maps_to, [])], lower(rcode) || '-' || lower(rsec))),
cu AS (SELECT row_id, route, len(rs) AS n_refs, unnest(cues) AS cue FROM q),
ru AS (SELECT cu.row_id, docs.row_id AS doc, family, ord, points FROM cu JOIN {_rules()} ON cu.cue = rules.cue AND cu.route = rules.route JOIN docs ON docs.code = rules.code AND upper(docs.section) = rules.section WHERE NOT (n_refs > 0 AND family IN ('hurt', 'death', 'stalking')) QUALIFY row_number() OVER (PARTITION BY cu.row_id, docs.row_id, family ORDER BY ord) = 1),
al AS (SELECT row_id, doc, sum(x) AS score FROM (SELECT row_id, doc, score AS x FROM s UNION ALL SELECT row_id, doc, points FROM ex UNION ALL SELECT row_id, doc, points FROM mp UNION ALL SELECT row_id, doc, points FROM ru) GROUP BY ALL),
f AS (SELECT q.row_id, doc, docs.code, q.route, prim, round(score + CASE WHEN q.route = 'MULTI_PERIOD_REVIEW' THEN 1 WHEN docs.code = prim THEN 2 ELSE 0 END, 3) AS score, coalesce((SELECT max(1) FROM rf WHERE rf.row_id = q.row_id AND rcode = docs.code AND rsec = upper(docs.section) AND docs.code = prim), 0) AS cited FROM al JOIN q USING (row_id) JOIN docs ON docs.row_id = doc WHERE NOT (q.route = 'IPC_ONLY' AND docs.code <> 'IPC') AND docs.code IN ('IPC', 'BNS')),
g AS (SELECT *, (route = 'BNS_PRIMARY' AND code = 'BNS')::INTEGER AS fc, row_number() OVER (PARTITION BY row_id, code ORDER BY cited DESC, (route = 'BNS_PRIMARY' AND code = 'BNS') DESC, score DESC, doc) AS k FROM f WHERE score > 0),
h AS (SELECT *, (route = 'MULTI_PERIOD_REVIEW' AND k = 1) AS lead FROM g)
SELECT row_id, doc AS statute_row, code, score, cited::INTEGER AS cited, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY lead DESC, CASE WHEN lead THEN (code <> prim)::INTEGER END, cited DESC, fc DESC, score DESC, doc) AS rank FROM h) WHERE rank <= 3"""


_GROUNDED = """WITH rk AS ({ranked}), rt AS ({routes}SELECT row_id, route FROM routes),
ci AS (SELECT DISTINCT rk.row_id FROM rk JOIN statute_supplements s ON s.row_id = rk.statute_row WHERE s.section IS NOT NULL),
w AS (SELECT route AS warning FROM rt WHERE route IN ('CLARIFY', 'MULTI_PERIOD_REVIEW') UNION ALL SELECT 'nothing was retrieved' FROM rt WHERE row_id NOT IN (SELECT row_id FROM ci))
SELECT warning, count(*) AS n FROM w GROUP BY warning"""
_METRICS = """WITH rk AS ({ranked}), rt AS ({routes}SELECT row_id, route FROM routes),
ca AS (SELECT row_id, case_id FROM candidate_cases QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY row_id DESC) = 1),
fo AS (SELECT case_id, list(concat_ws('-', rk.code, nullif(regexp_extract(replace(s.section, ' ', ''), '^[0-9]{{1,3}}[A-Z]*'), '')) ORDER BY rk.rank) AS found FROM rk JOIN ca USING (row_id) JOIN statute_supplements s ON s.row_id = rk.statute_row GROUP BY case_id),
go AS (SELECT case_id, max(applicable_law) AS law, nullif(max(concat_ws('-', correct_top1_provision.code, correct_top1_provision.section)), '') AS one, coalesce(max([concat_ws('-', x.code, x.section) FOR x IN correct_top3_provisions]), []) AS three FROM gold_labels GROUP BY case_id),
a AS (SELECT route, law, one, three, coalesce(found, []) AS found, len(list_intersect(three, coalesce(found, []))) AS hits, len(three) AS wanted FROM go JOIN ca USING (case_id) JOIN rt USING (row_id) LEFT JOIN fo USING (case_id))
SELECT count(*) AS cases, round(count(*) FILTER (law IS NOT NULL AND route = law) * 100.0 / count(*) FILTER (law IS NOT NULL), 2) AS law_accuracy, round(count(*) FILTER (found[1] IS NOT DISTINCT FROM one) * 100.0 / count(*), 2) AS first_accuracy,
round(count(*) FILTER (one IS NOT NULL AND found[1] = one) * 100.0 / count(*) FILTER (one IS NOT NULL), 2) AS named_first_accuracy, round(count(*) FILTER (hits = wanted) * 100.0 / count(*), 2) AS all_of_three,
round(count(*) FILTER (wanted > 0 AND hits > 0) * 100.0 / count(*) FILTER (wanted > 0), 2) AS any_of_three, round(sum(hits) * 100.0 / sum(wanted), 2) AS recall_of_three FROM a"""
_SPOKEN = """SELECT * FROM (VALUES
(0, 'Under section 379 he paid 520,000 rupees.', 'section>379|amount>520,000'), (1, 'on 21 June 2024', 'date>21 June 2024'), (2, 'IPC 420 and BNS 302', 'section>420|section>302'),
(3, 'grievous hurt under the Bharatiya Nyaya Sanhita', 'lexicon>grievous hurt|lexicon>Bharatiya Nyaya Sanhita'), (4, 'the Indian Penal Code and criminal breach of trust', 'lexicon>Indian Penal Code|lexicon>criminal breach of trust'),
(5, 'no one may march in May', ''), (6, 'extortion of movable property', 'lexicon>extortion|lexicon>movable property'), (7, '5 July 2023', 'date>5 July 2023'), (8, NULL, ''), (9, '', '')) AS t(id, text, log)"""
_REPAIRED = """SELECT id, page, letters, dates, acronyms, log FROM (VALUES
(0, 'ab' || chr(10) || chr(10) || 'kept', 'a' || chr(173) || 'b' || chr(13) || chr(10) || '____' || repeat(chr(10), 3) || '12 THE GAZETTE OF X' || chr(10) || 'kept', NULL, NULL, ''),
(1, 'T H E F T of a B O A T', 'THEFT of a BOAT', 'T H E F T of a B O A T', 'T H E F T of a B O A T', ''),
(2, 'on 5 July 2024he left, 2024-07-05 ના રોજ.', 'on 5 July 2024he left, 2024-07-05 ના રોજ.', 'on 5 July 2024 he left, 2024-07-05 .', 'on 5 July 2024he left, 2024-07-05 ના રોજ.', ''),
(3, 'आईपीसी 302 और बीएनएस 303', 'आईपीसी 302 और बीएनएस 303', 'आईपीसी 302 और बीएनएस 303', 'IPC 302 और BNS 303', 'आईपीसी>IPC|बीएनएस>BNS'), (4, NULL, NULL, NULL, NULL, '')) AS t(id, page, letters, d, a, log), LATERAL (SELECT CASE WHEN id = 0 THEN letters ELSE d END AS dates, CASE WHEN id = 0 THEN letters ELSE a END AS acronyms)"""


def oracle_sql() -> dict[str, str]:
    low = "list_distinct(string_split(regexp_replace(lower(coalesce(facts, '')), '[^a-z0-9]+', ' ', 'g'), ' '))"
    phrases = " UNION ALL ".join(f"SELECT '{label}' AS label, count(*) AS n FROM candidate_cases WHERE regexp_matches(lower(coalesce(facts, '')), '{p}')" for label, p in V.PHRASES)
    suffix = " ".join(f"WHEN suffix(word, '{s}') AND length(word) - {len(s)} >= 3 THEN word[1 : length(word) - {len(s)}]" for s in V.ENGLISH_SUFFIXES)
    letters = lambda c: f"regexp_replace(lower(coalesce({c}, '')), '[^a-z]', '', 'g')"
    scripts = " ".join(f"WHEN regexp_matches(theft, '{p}') THEN '{n}'" for n, p in V.SCRIPT_BLOCKS)
    hourly = "SELECT epoch_us(date_trunc('hour', ts)) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL"
    pairs = "WITH e AS (SELECT user_id, ts, event_type, lag(event_type) OVER w AS was, lag(ts) OVER w AS opened FROM events WHERE event_type IN ('view', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, epoch_us(opened) AS opened, epoch_us(ts) AS closed FROM e WHERE event_type = 'purchase' AND was = 'view'"
    ascii_only = "regexp_full_match(theft, '[\\x00-\\x7F]*', 's')"
    has_script = " ".join(f"WHEN '{c}' THEN regexp_matches(theft, '[\\x{{{b.split('-')[0]}}}-\\x{{{b.split('-')[1]}}}]')" for c, b in V.SCRIPTS.items())
    hindi = "जनवरी फ़रवरी मार्च अप्रैल मई जून जुलाई अगस्त सितंबर अक्तूबर नवंबर दिसंबर".split()  # fixed values: the months
    hindi_cases = " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(hindi, 1))
    hindi_get = lambda g: rf"unnest(regexp_extract_all(text, '([0-9]{{1,2}})\s+({'|'.join(hindi)}),?\s+(20[0-9]{{2}})', {g}))"
    base = "nullif(regexp_extract(replace(section, ' ', ''), '^[0-9]{1,3}[A-Z]*'), '')"
    html = "'<' || title || '> & ''it'''"
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        html = f"replace({html}, '{a}', '{b}')"
    more = {
        "crosswalk_benchmark": "WITH a AS (SELECT concat_ws('-', 'ipc', ipc, bns) AS qid, 'IPC' AS code, ipc AS section FROM crosswalk_edges UNION ALL SELECT concat_ws('-', 'bns', ipc, bns), 'BNS', bns FROM crosswalk_edges), "
        f"d AS (SELECT row_id AS doc, code, {base} AS base, maps_to FROM statute_supplements WHERE section IS NOT NULL AND NOT {_REPEALED}), x AS (SELECT qid, doc, 50 AS points FROM a JOIN d ON a.code = d.code AND a.section = base), "
        "m AS (SELECT qid, doc, 30 AS points FROM (SELECT doc, code, split_part(unnest(maps_to), '-r', 1) AS name FROM d) n JOIN a ON name = lower(a.code) || '-' || lower(a.section) AND a.code <> n.code), s AS (SELECT qid, doc, sum(points) AS score FROM (SELECT * FROM x UNION ALL SELECT * FROM m) GROUP BY ALL), "
        "r AS (SELECT s.*, x.doc IS NOT NULL AS hit, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc) AS rank FROM s LEFT JOIN (SELECT DISTINCT qid, doc FROM x) x USING (qid, doc)), h AS (SELECT qid, bool_or(rank = 1 AND hit) AS t1, bool_or(hit) AS t3 FROM r WHERE rank <= 3 GROUP BY qid) "
        "SELECT count(*) AS queries, count(*) FILTER (t1) AS top1, count(*) FILTER (t3) AS top3, round(count(*) FILTER (t1) * 100.0 / count(*), 2) AS top1_percent FROM a LEFT JOIN h USING (qid)",
        "localized_dates": f"SELECT item_id, format('{{}}-{{:02d}}-{{:02d}}', y, CASE m {hindi_cases} END, d::INTEGER) AS value FROM (SELECT item_id, {hindi_get(1)} AS d, {hindi_get(2)} AS m, {hindi_get(3)} AS y FROM eval_items WHERE lang = 'hi')",
        "eligible_cases": "SELECT row_id, case_id FROM candidate_cases WHERE station IS NOT NULL AND submitted_at IS NOT NULL AND length(facts) >= 50 AND case_id NOT IN (SELECT case_id FROM gold_labels) AND case_id NOT IN (SELECT case_id FROM candidate_cases GROUP BY case_id HAVING count(*) > 1)",
        "provisions_without_text": f"WITH w AS (SELECT DISTINCT concat_ws(' ', p.code, p.section) AS provision FROM (SELECT unnest(correct_top3_provisions) AS p FROM gold_labels)) SELECT provision FROM w WHERE provision NOT IN (SELECT concat_ws(' ', code, {base}) FROM statute_supplements WHERE section IS NOT NULL)",
        "aligned_deliveries": "WITH r AS (SELECT section, code, row_number() OVER (PARTITION BY section, code ORDER BY row_id) AS k FROM statute_supplements WHERE section IS NOT NULL AND code IN ('IPC', 'BNS')) SELECT section, count(*) FILTER (code = 'IPC') AS ipc, count(*) FILTER (code = 'BNS') AS bns, max(k) AS places FROM r GROUP BY section",
        "code_bounds": "SELECT w.code, count(s.row_id) AS n, least, count(s.row_id) >= least AS kept FROM (VALUES ('IPC', 450), ('BNS', 358), ('CRPC', 1)) AS w(code, least) LEFT JOIN statute_supplements s ON s.code = w.code GROUP BY w.code, least",
        "lost_numbers": f"SELECT row_id, unnest(list_filter(list_distinct({_numbers('theft')}), lambda x: list_contains({_numbers('injury')}, x) AND NOT list_contains({_numbers('cheating')}, x))) AS cue FROM multilingual_completion WHERE theft IS NOT NULL AND injury IS NOT NULL AND cheating IS NOT NULL",
        "doubtful_segments": "SELECT * FROM (SELECT user_id, concat_ws(' ', event_type, event_id) AS text, round(value / 100, 6) AS p, row_number() OVER (PARTITION BY user_id ORDER BY value / 100, concat_ws(' ', event_type, event_id)) AS rank FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND value / 100 < 0.6) WHERE rank <= 5",
        "case_periods": _ROUTES + "SELECT r.row_id, coalesce(offence, CASE WHEN r.n_dates > 1 THEN low || ' to ' || high END, 'an unspecified date') AS period FROM routes r LEFT JOIN by_case USING (row_id)",
        "escaped_titles": f"SELECT row_id, {html} AS html FROM statute_supplements WHERE title IS NOT NULL",
    }
    collapsed = r"regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^[ .\-]+|[ .\-]+$', '', 'g')"
    first = rf"regexp_replace({collapsed}, '^(.*?[.;:])\s.*$', '\1')"
    title = f"regexp_replace(array_to_string(string_split({first}, ' ')[1:14], ' '), '[.,;:]+$', '')"
    tidy = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(theft, '[\x{200B}\x{200E}\x{200F}\x{2060}\x{FEFF}]', '', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F]', ' ', 'g'), '[ \t\x{00A0}]+', ' ', 'g'), '\s+([,.;:!?।۔])', '\1', 'g'))"
    anchor = f"list_min(list_filter(list_transform(list_filter({_tokens('q')}, lambda t: length(t) > 3), lambda t: instr(lower(text), t)), lambda p: p > 0))"
    more |= {
        "derived_titles": f"SELECT row_id, CASE WHEN coalesce({title}, '') = '' THEN 'Statutory provision' ELSE {title} END AS derived, {base} AS base FROM statute_supplements",
        "tidied": f"SELECT row_id, {tidy} AS tidy FROM multilingual_completion WHERE theft IS NOT NULL",
        "excerpts": _SCORES + f", t AS (SELECT item_id, row_id FROM s QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, row_id) = 1), x AS (SELECT t.item_id, t.row_id, i.text AS q, d.text FROM t JOIN eval_items i USING (item_id) JOIN statute_supplements d USING (row_id)), y AS (SELECT *, greatest(1, coalesce({anchor}, 1) - 80) AS a FROM x) SELECT item_id, row_id, CASE WHEN length(text) <= 560 THEN text ELSE CASE WHEN a > 1 THEN '...' ELSE '' END || trim(text[a : a + 559]) || '...' END AS excerpt FROM y",
        "citations": "SELECT row_id, to_json(struct_pack(id := id, citation := code || ' ' || section || ': ' || title || ' (' || source.authority || ', ' || source.file || coalesce(', p. ' || source.page, '') || ')'))::VARCHAR AS json FROM statute_supplements WHERE source.file IS NOT NULL AND section IS NOT NULL AND title IS NOT NULL",
    }
    return more | {
        "streamed_windows": hourly,
        "streamed_pairs": pairs,
        "english_like_texts": f"SELECT {ascii_only} AND len(regexp_extract_all(theft, '{V.ENGLISH_MARKERS}')) >= 2 AS english, count(*) AS n FROM multilingual_completion WHERE theft IS NOT NULL GROUP BY 1",
        "script_mismatches": f"SELECT row_id, code FROM (SELECT row_id, theft, lower(split_part(language, '-', 1)) AS code FROM multilingual_completion WHERE theft IS NOT NULL) WHERE NOT CASE code WHEN 'en' THEN {ascii_only} {has_script} END",
        "invented_numbers": f"SELECT row_id, unnest(list_filter(list_distinct({_numbers('cheating')}), lambda x: NOT list_contains({_numbers('theft')}, x))) AS number FROM multilingual_completion WHERE theft IS NOT NULL AND cheating IS NOT NULL",
        "repaired_once": "SELECT row_id, nfc_normalize(title) AS composed FROM statute_supplements",
        "composed_texts": "SELECT row_id, nfc_normalize(theft) AS nfc FROM multilingual_completion WHERE theft IS NOT NULL",
        "retrieval_topk": _SCORES + "SELECT item_id, row_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, row_id) AS rank FROM s) WHERE rank <= 3",
        "retrieval_by_code": _SCORES + "SELECT item_id, code, row_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id, code ORDER BY score DESC, row_id) AS rank FROM s) WHERE rank <= 3",
        "retrieval_diversified": _SCORES + ", g AS (SELECT *, row_number() OVER (PARTITION BY item_id, code ORDER BY score DESC, row_id) AS k FROM s), o AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY k <> 1, CASE WHEN k = 1 THEN code END NULLS FIRST, score DESC, row_id) AS rank FROM g) SELECT item_id, code, row_id, score, rank FROM o WHERE rank <= 3",
        "idf_table": _SCORES + "SELECT token, df, round(idf, 6) AS idf FROM w",
        "reference_matches": f"WITH r AS (SELECT DISTINCT row_id AS case_row, nullif(upper(unnest({_sections(1)})), '') AS ref_code, upper(unnest({_sections(2)})) AS ref_section FROM candidate_cases) SELECT DISTINCT case_row, s.row_id FROM r JOIN statute_supplements s ON upper(s.section) = ref_section AND (ref_code IS NULL OR ref_code = s.code)",
        "section_refs": f"SELECT row_id, unnest(range(0, len(r))) AS pos, upper(unnest(r)) AS section FROM (SELECT row_id, {_sections(2)} AS r FROM candidate_cases)",
        "case_dates": _ROUTES + "SELECT row_id, value FROM one",
        "case_routes": _ROUTES + "SELECT row_id, offence, going_on, n_dates, route FROM routes",
        "route_counts": _ROUTES + "SELECT route, count(*) AS n, count(offence) AS dated FROM routes GROUP BY route",
        "grounding_warnings": _ROUTES + "SELECT * FROM (SELECT 'review' AS warning, count(*) AS n FROM routes WHERE route IN ('CLARIFY', 'MULTI_PERIOD_REVIEW') UNION ALL SELECT 'no date', count(*) FROM routes WHERE route = 'CLARIFY' AND n_dates = 0 UNION ALL SELECT 'continuing', count(*) FROM routes WHERE going_on) WHERE n > 0",
        "route_accuracy": _ROUTES + f", {_LABELS}, last AS (SELECT case_id, max(row_id) AS row_id FROM candidate_cases GROUP BY case_id), b AS (SELECT route, law, top1 FROM last JOIN routes USING (row_id) JOIN l ON l.case_id = last.case_id) SELECT count(*) AS cases, round(count(*) FILTER (route = law) * 100.0 / nullif(count(law), 0), 2) AS law_accuracy, round(count(*) FILTER (route = law AND law <> 'CLARIFY') * 100.0 / nullif(count(*) FILTER (law <> 'CLARIFY'), 0), 2) AS dated_accuracy, coalesce(round(count(*) FILTER (top1 <> '') * 100.0 / nullif(count(*), 0), 2), 0.0) AS with_top1 FROM b",
        "vocabulary_counts": f"SELECT word, count(*) AS n FROM (SELECT unnest({low}) AS word FROM candidate_cases) WHERE word IN ({_list(V.VOCABULARY)}) GROUP BY word",
        "phrase_counts": f"SELECT * FROM ({phrases}) WHERE n > 0",
        "keywords_top16": f"WITH w AS (SELECT row_id, unnest(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(text, '')), '[a-z][a-z-]{{3,}}')) AS keyword FROM statute_supplements), c AS (SELECT row_id, keyword, count(*) AS n FROM w WHERE keyword NOT IN ({_list(V.KEYWORD_STOP)}) GROUP BY ALL) SELECT * FROM (SELECT row_id, keyword, n, row_number() OVER (PARTITION BY row_id ORDER BY n DESC, keyword) AS rank FROM c) WHERE rank <= 16",
        "record_counts": "SELECT code, record_type, count(*) AS n, grouping(code, record_type) AS level FROM statute_supplements GROUP BY CUBE (code, record_type)",
        "overlaid_titles": "WITH x AS (SELECT id, arg_max(struct_pack(t := title), row_id).t AS title FROM statute_supplements WHERE record_type = 'primary-statute-supplement' GROUP BY id) SELECT s.row_id, s.id, CASE WHEN x.id IS NULL THEN s.title ELSE x.title END AS title FROM statute_supplements s LEFT JOIN x USING (id) WHERE record_type = 'primary-statute'",
        "latest_records": "SELECT id, row_id, code, record_type FROM statute_supplements QUALIFY row_number() OVER (PARTITION BY id ORDER BY row_id DESC) = 1",
        "crosswalk_adjacency": "WITH e AS (SELECT 'ipc-' || lower(ipc) AS a, 'bns-' || lower(bns) AS b FROM crosswalk_edges) SELECT id, list_sort(list(DISTINCT x)) AS maps_to FROM (SELECT a AS id, b AS x FROM e UNION ALL SELECT b, a FROM e) GROUP BY id",
        "mapping_only_records": "WITH e AS (SELECT 'IPC ' || ipc AS provision, offence FROM crosswalk_edges UNION ALL SELECT 'BNS ' || bns, offence FROM crosswalk_edges), k AS (SELECT concat_ws(' ', code, nullif(regexp_extract(replace(section, ' ', ''), '^[0-9]{1,3}[A-Z]*'), '')) AS provision FROM statute_supplements WHERE section IS NOT NULL) SELECT provision, min(offence) AS offence FROM e WHERE provision NOT IN (SELECT provision FROM k) GROUP BY provision",
        "eligible_mappings": "SELECT ipc, bns FROM crosswalk_edges WHERE ipc IN (SELECT section FROM statute_supplements WHERE code = 'IPC' AND section IS NOT NULL) AND bns IN (SELECT section FROM statute_supplements WHERE code = 'BNS' AND section IS NOT NULL)",
        "page_starts": _PAGES + "SELECT * FROM p",
        "page_as_of": _PAGES + ", l AS (SELECT file, page_start, max(page) AS page FROM p GROUP BY ALL), t AS (SELECT file, unnest(range(0, max(page_start) + 1, 10000)) AS at FROM p GROUP BY file) SELECT t.file, t.at, l.page FROM t ASOF JOIN l ON t.file = l.file AND t.at >= l.page_start",
        "page_spans": _PAGES + "SELECT row_id, page_start, lead(page_start) OVER (PARTITION BY file ORDER BY page, row_id) AS span_end FROM p",
        "repealed_records": "SELECT regexp_matches(coalesce(title, '') || ' ' || coalesce(text, '')[1:80], '(?i)\\brepealed\\b|\\[repealed\\]|^\\s*rep\\.\\s+by') AS repealed, count(*) AS n FROM statute_supplements GROUP BY 1",
        "token_stats": _EN_TOKENS + f"SELECT doc_id, count(*) AS tokens, count(*) FILTER (kind = 'word') AS words, count(DISTINCT word) FILTER (kind = 'word') AS unique_words, count(*) FILTER (kind = 'number') AS numbers, count(*) FILTER (kind = 'word' AND word IN ({_list(V.ENGLISH_STOP)})) AS stop_words FROM k GROUP BY doc_id",
        "stem_counts": _EN_TOKENS + f"SELECT word, CASE WHEN length(word) <= 4 OR word IN ({_list(V.ENGLISH_STOP + V.ENGLISH_NEGATIONS)}) THEN word {suffix} ELSE word END AS stem, count(*) AS n FROM k WHERE kind = 'word' AND regexp_matches(token, '^[A-Za-z]+$') GROUP BY word",
        "negation_counts": _EN_TOKENS + f"SELECT word, count(*) AS n FROM k WHERE kind = 'word' AND word IN ({_list(V.ENGLISH_NEGATIONS)}) GROUP BY word",
        "rake_top8": f"WITH r AS (SELECT item_id, regexp_extract_all(text, '{_TOKEN}') AS l FROM eval_items WHERE lang = 'en'), t AS (SELECT item_id, lower(unnest(l)) AS word, generate_subscripts(l, 1) AS pos FROM r), c AS (SELECT *, (NOT regexp_matches(word, '^[\\p{{L}}\\p{{M}}\\x{{200C}}\\x{{200D}}]') OR word IN ({_delimited()})) AS cut FROM t), g AS (SELECT *, sum(cut::INTEGER) OVER (PARTITION BY item_id ORDER BY pos) AS run FROM c), p AS (SELECT item_id, run, min(pos) AS first, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS phrase FROM g WHERE NOT cut GROUP BY item_id, run), e AS (SELECT g.item_id, p.first, p.n, g.word FROM g JOIN p USING (item_id, run) WHERE NOT cut), w AS (SELECT item_id, word, sum(n)::DOUBLE / count(*) AS weight FROM e GROUP BY ALL), s AS (SELECT item_id, first, sum(weight) AS score FROM e JOIN w USING (item_id, word) WHERE n <= 4 GROUP BY ALL), o AS (SELECT item_id, phrase, round(max(score), 2) AS score, max(n) AS words, count(*) AS occurrences, min(first) AS f FROM p JOIN s USING (item_id, first) WHERE n <= 4 GROUP BY item_id, phrase) SELECT item_id, phrase, score, words, occurrences, rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, occurrences DESC, f) AS rank FROM o) WHERE rank <= 8",
        "script_counts": f"SELECT CASE {scripts} ELSE 'other' END AS script, count(*) AS n FROM multilingual_completion WHERE theft IS NOT NULL GROUP BY 1",
        "ascii_numbers": f"SELECT row_id, array_to_string({_numbers('theft')}, '|') AS numbers FROM multilingual_completion WHERE theft IS NOT NULL",
        "kept_numbers": f"SELECT row_id, list_sort({_numbers('theft')}) = list_sort({_numbers('cheating')}) AS same FROM multilingual_completion WHERE theft IS NOT NULL AND cheating IS NOT NULL",
        "label_codes": "SELECT lower(split_part(language, '-', 1)) AS code, count(*) AS n FROM multilingual_completion GROUP BY 1",
        "duplicate_texts": "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1",
        "label_problems": "WITH g AS (SELECT applicable_law AS law, correct_top1_provision AS f, coalesce(correct_top3_provisions, []) AS t FROM gold_labels) SELECT * FROM (SELECT 'route' AS problem, count(*) AS n FROM g WHERE law IS NULL OR law NOT IN ('IPC_ONLY', 'BNS_PRIMARY', 'MULTI_PERIOD_REVIEW', 'CLARIFY') UNION ALL SELECT 'count', count(*) FROM g WHERE law <> 'CLARIFY' AND len(t) NOT BETWEEN 1 AND 3 UNION ALL SELECT 'distinct', count(*) FROM g WHERE len(t) <> len(list_distinct(t)) UNION ALL SELECT 'first', count(*) FROM g WHERE f IS NOT NULL AND NOT list_contains(t, f)) WHERE n > 0",
        "repeated_labels": "SELECT case_id, count(*) AS n FROM gold_labels GROUP BY case_id HAVING count(*) > 1",
        "label_coverage": "WITH a AS (SELECT case_id, count(*) AS na FROM candidate_cases GROUP BY 1), b AS (SELECT case_id, count(*) AS nb FROM gold_labels GROUP BY 1) SELECT CASE WHEN nb IS NULL THEN 'left_only' WHEN na IS NULL THEN 'right_only' ELSE 'repeated' END AS problem, count(*) AS n FROM a FULL JOIN b USING (case_id) WHERE na IS NULL OR nb IS NULL OR na > 1 OR nb > 1 GROUP BY 1",
        "band_ordinals": "SELECT rater, count(*) AS labels, round(sum(v) * 100.0 / nullif(count(v) * 2, 0), 2) AS percent FROM (SELECT rater, CASE band WHEN 'basic' THEN 0 WHEN 'middle' THEN 1 WHEN 'advanced' THEN 2 END AS v FROM reading_labels) GROUP BY rater",
        "character_errors": f"WITH e AS (SELECT levenshtein({letters('theft')}, {letters('cheating')}) AS edits, length({letters('theft')}) AS size FROM multilingual_completion WHERE theft IS NOT NULL AND cheating IS NOT NULL) SELECT count(*) FILTER (size > 0) AS rows, sum(edits) FILTER (size > 0) AS edits, sum(size) AS size, round(sum(edits) FILTER (size > 0) / sum(size), 6) AS micro, round(avg(edits / size) FILTER (size > 0), 6) AS mean, count(*) FILTER (size = 0) AS left_out FROM e",
        "value_quantiles": "SELECT event_type, count(*) AS n, round(median(value), 6) AS median, quantile_disc(value, 0.95) AS p95 FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY event_type",
        "composite_summary": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY ALL",
        "paired_gate": _ARMS + " SELECT count(*) AS pairs, count(*) FILTER (ce > be) AS regressions, median(bc) AS baseline_median, median(cc) AS candidate_median, coalesce(count(*) > 0 AND count(*) FILTER (ce > be) = 0 AND median(cc) <= median(bc) * 0.9, false) AS accepted FROM p",
        "gain_gate": _ARMS + " SELECT sum(be) AS baseline_errors, sum(ce) AS candidate_errors, count(*) FILTER (ce > be) AS worse, round(sum(bc), 2) AS baseline_cost, round(sum(cc), 2) AS candidate_cost, coalesce(sum(ce) < sum(be) AND count(*) FILTER (ce > be) = 0 AND sum(cc) <= sum(bc) * 1.25, false) AS accepted FROM p",
        "completeness_report": "WITH e AS (SELECT DISTINCT case_id FROM candidate_cases), r AS (SELECT case_id, max((applicable_law IS NULL)::INTEGER) AS bad FROM gold_labels GROUP BY 1), x AS (SELECT e.case_id AS e, r.case_id AS r, bad FROM e FULL JOIN r USING (case_id)) SELECT count(e) AS expected, count(*) FILTER (r IS NULL) AS missing, count(*) FILTER (e IS NULL) AS unexpected, count(*) FILTER (bad = 1) AS failed, count(*) FILTER (r IS NULL OR e IS NULL OR bad = 1) = 0 AS complete FROM x",
        "unlabelled_cases": "SELECT DISTINCT case_id FROM candidate_cases WHERE case_id NOT IN (SELECT case_id FROM gold_labels)",
        "buyers_without_orders": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
        "buyers_with_orders": "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
        "sealed_labels": "SELECT doc_id, sha256(concat_ws(chr(31), doc_id::VARCHAR, coalesce(rater, chr(0)), coalesce(band, chr(0)))) AS seal FROM (SELECT DISTINCT * FROM reading_labels)",
        "redelivery_diff": "WITH k AS (SELECT case_id, sha256(coalesce(facts, '')) AS digest, row_number() OVER (PARTITION BY case_id ORDER BY row_id) AS n FROM candidate_cases), x AS (SELECT a.case_id, CASE WHEN b.digest IS NULL THEN 'removed' WHEN a.digest <> b.digest THEN 'changed' END AS status FROM (SELECT * FROM k WHERE n = 1) a LEFT JOIN (SELECT * FROM k WHERE n = 2) b USING (case_id)) SELECT status, count(*) AS n FROM x WHERE status IS NOT NULL GROUP BY status",
        "vocabulary_conflicts": "WITH w AS (SELECT code, lower(trim(k)) AS word FROM (SELECT code, unnest(keywords) AS k FROM statute_supplements) WHERE trim(k) <> ''), r AS (SELECT code, word, row_number() OVER (PARTITION BY code ORDER BY count(*) DESC, word) AS place FROM w GROUP BY code, word), a AS (SELECT word, place AS ipc_place FROM r WHERE code = 'IPC'), b AS (SELECT word, place AS bns_place FROM r WHERE code = 'BNS') SELECT word, ipc_place, bns_place FROM a FULL JOIN b USING (word) WHERE ipc_place IS DISTINCT FROM bns_place",
        "chosen_cases": "WITH m AS (SELECT row_id, station, coalesce(length(facts) >= 50, false) AS ok, row_number() OVER (PARTITION BY station, case_id ORDER BY row_id) > 1 AS again FROM candidate_cases WHERE station IS NOT NULL), n AS (SELECT *, sum((ok AND NOT again)::INTEGER) OVER (PARTITION BY station ORDER BY row_id) AS k FROM m) SELECT row_id, CASE WHEN NOT ok THEN 'ineligible' WHEN again THEN 'repeated' WHEN k <= 3 THEN 'chosen' ELSE 'reserve' END AS choice FROM n",
        "scenario_matrix": "WITH l AS (SELECT coalesce(lower(split_part(language, '-', 1)), '') AS code, field, text FROM (SELECT language, unnest(['theft', 'injury', 'cheating']) AS field, unnest([theft, injury, cheating]) AS text FROM multilingual_completion)) SELECT code, field, count(*) FILTER (text <> '') AS n FROM l GROUP BY code, field",
        "event_gaps": _VISITS + ", b AS (SELECT min(start) AS lo, max(\"end\") AS hi FROM iv), g AS (SELECT user_id, coalesce(lag(\"end\") OVER (PARTITION BY user_id ORDER BY start), lo) AS gap_start, start AS gap_end FROM iv, b UNION ALL SELECT user_id, max(\"end\"), any_value(hi) FROM iv, b GROUP BY user_id) SELECT * FROM g WHERE gap_start < gap_end",
        "retained_share": _VISITS + " SELECT user_id, round(sum(\"end\" - start) / (30 * 86400), 6) AS retained FROM iv GROUP BY user_id",
        "event_pairs": pairs,
        "contiguous_visits": _VISITS + " SELECT user_id, bool_and(coalesce(n = \"end\", true)) AS contiguous, min(start) AS low, max(\"end\") AS high FROM (SELECT *, lead(start) OVER (PARTITION BY user_id ORDER BY start) AS n FROM iv) GROUP BY user_id",
        "rising_values": "SELECT user_id, coalesce(bool_and(was IS NULL OR value > was), true) AS increasing FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) GROUP BY user_id",
        "filled_quota": "SELECT * FROM (SELECT l_suppkey, l_orderkey, l_linenumber, coalesce(sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS filled FROM lineitem) WHERE filled < 100",
        "late_deliveries": "WITH w AS (SELECT submitted_at IS NULL AS err, epoch_us(ingested_at) - epoch_us(submitted_at) AS wait FROM candidate_cases) SELECT CASE WHEN err THEN 'worker-error' WHEN wait IS NULL OR wait < 0 THEN 'invalid-timing' WHEN wait > 86400000000 THEN 'elapsed-budget-exceeded' ELSE 'none' END AS fault, count(*) AS n, count(*) FILTER (abs(wait) <= 3600000000) AS within_hour FROM w GROUP BY 1",
        "hourly_windows": hourly,
        "user_sessions": "WITH l AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOURS, true) AS opens FROM events WHERE ts IS NOT NULL), s AS (SELECT *, sum(opens::INTEGER) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM l) SELECT user_id, epoch_us(min(ts)) AS session_start, count(*) AS n FROM s GROUP BY user_id, k",
        "doubtful_words": "WITH e AS (SELECT user_id, lower(event_type) AS word, min(value / 100) AS p FROM events WHERE value IS NOT NULL AND NOT isnan(value) AND value / 100 < CASE WHEN regexp_matches(event_type, '[0-9]') THEN 0.75 ELSE 0.5 END GROUP BY ALL) SELECT * FROM (SELECT user_id, word, round(p, 6) AS p, row_number() OVER (PARTITION BY user_id ORDER BY e.p, word) AS rank FROM e) WHERE rank <= 8",
        "mean_confidence": "SELECT user_id, round(sum(value * length(event_type)) / sum(length(event_type)), 3) AS weighted, round(avg(value), 3) AS plain FROM events WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY user_id",
        "top_dimensions": "WITH x AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS place FROM embeddings) SELECT vec_id, rank, place FROM (SELECT vec_id, place, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, place) - 1 AS rank FROM x WHERE place <> 0 AND isfinite(v)) WHERE rank < 5",
        "phrase_runs": "WITH s AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents WHERE lang = 'en' AND text IS NOT NULL), r AS (SELECT doc_id, array_to_string(w[i : i + 2], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM s)) SELECT doc_id, run, count(*) AS n FROM r GROUP BY ALL HAVING count(*) > 1",
        "ranked_statutes": _ranked(),
        "rule_points_by_route": f"SELECT route, family, count(*) AS rules, sum(points)::DOUBLE AS points FROM {_rules()} GROUP BY ALL",
        "cue_counts": f"SELECT cue, count(*) AS n FROM (SELECT unnest({_cue('t')}) AS cue FROM (SELECT facts AS t FROM candidate_cases UNION ALL SELECT injury FROM multilingual_completion UNION ALL SELECT theft FROM multilingual_completion) WHERE t IS NOT NULL) GROUP BY cue",
        "spoken_samples": _SPOKEN,
        "repaired_text": _REPAIRED,
        "checked_translations": "SELECT language, variant, variant < 2 AS role_changed, language <> 'mr' AND variant > 0 AS intent_lost, language IN ('hi', 'mr') AND variant = 1 AS flipped FROM (SELECT unnest(['hi', 'mr', 'gu', 'bn', 'ta', 'te', 'kn', 'ml', 'pa', 'ur']) AS language), (SELECT unnest([0, 1, 2]) AS variant)",
        "guessed_languages": "WITH t AS (SELECT unnest([theft, injury, cheating]) AS t FROM multilingual_completion), g AS (SELECT " + "CASE " + " ".join(f"WHEN regexp_matches(t, '[\\x{{{b.split('-')[0]}}}-\\x{{{b.split('-')[1]}}}]') THEN '{c}'" for c, b in (("gu", "0A80-0AFF"), ("bn", "0980-09FF"), ("ta", "0B80-0BFF"), ("te", "0C00-0C7F"), ("kn", "0C80-0CFF"), ("ml", "0D00-0D7F"), ("pa", "0A00-0A7F"), ("ur", "0600-06FF"))) + " WHEN regexp_matches(t, '[\\x{0900}-\\x{097F}]') THEN CASE WHEN m > h THEN 'mr' WHEN h > m THEN 'hi' END END AS language FROM (SELECT t, regexp_matches(t, 'आहे|आहेत|झाला|झाली|केला|केली|मध्ये|त्याने|नाही')::INTEGER + contains(t, 'ळ')::INTEGER + contains(t, 'ऱ')::INTEGER AS m, regexp_matches(t, 'है|हैं|हुआ|हुई|किया|में|उसने|नहीं')::INTEGER + regexp_matches(t, 'ड़|ढ़')::INTEGER AS h FROM t WHERE t IS NOT NULL)) SELECT language, count(*) AS n FROM g GROUP BY language",
        "rescored_pairs": "WITH r AS (SELECT CASE WHEN row_id % 10 = 0 THEN 'unexpected' WHEN trim(theft, ' ') = theft THEN 'same' ELSE 'changed' END AS status FROM multilingual_completion WHERE theft IS NOT NULL) SELECT status, count(*) AS n FROM r GROUP BY status",
        "checked_events": "SELECT CASE WHEN n > 70 THEN 'too-many' WHEN NOT kinds THEN 'kind' WHEN NOT inside THEN 'outside' ELSE 'none' END AS fault, count(*) AS users FROM (SELECT user_id, count(*) AS n, bool_and(coalesce(event_type IN ('view', 'purchase', 'click', 'signup', 'error'), false)) AS kinds, bool_and(coalesce(ts BETWEEN TIMESTAMP '2024-01-01 06:00:00' AND TIMESTAMP '2024-01-30 18:00:00', false)) AS inside FROM events GROUP BY user_id) GROUP BY fault",
        "sentence_counts": r"""WITH x AS (SELECT row_id, regexp_replace(coalesce(facts, ''), '(?i)\\b(rs|no|sec|dr|mr|mrs|ms|vs|ltd|co|st|smt|shri|adv)\\.', '\\1', 'g') AS t FROM candidate_cases), y AS (SELECT row_id, t, '[।॥!?؟۔]["'')\\]”’]*|\\.(?:\\s|$)' AS p FROM x) SELECT row_id, (len(regexp_extract_all(t, p)) + (trim(list_last(string_split_regex(t, p)), ' ' || chr(9) || chr(10)) <> '')::INTEGER)::INTEGER AS sentences FROM y""".replace("\\\\", "\\"),
        "written_numbers": "SELECT row_id, facts AS text, 0 AS corrections FROM candidate_cases",  # the tables hold no spoken number; spoken_samples has them
        "grounded_answers": _GROUNDED.format(ranked=_ranked(), routes=_ROUTES),
        "label_metrics": _METRICS.format(ranked=_ranked(), routes=_ROUTES),
    }
