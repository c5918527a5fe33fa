"""The same results in SQL, where SQL can say them."""

from __future__ import annotations

from lexloom.llm import uniform

_TERMS = r"""
WITH r AS (SELECT id, keywords, text FROM statute_supplements WHERE id IS NOT NULL),
k AS (SELECT 'keywords' AS field, id, lower(trim(v)) AS term FROM (SELECT id, unnest(keywords) AS v FROM r) WHERE v IS NOT NULL AND trim(v) <> ''),
w AS (SELECT 'text' AS field, id, lower(v) AS term FROM (SELECT id, unnest(regexp_extract_all(text, '\p{L}+')) AS v FROM r)),
n AS (SELECT count(DISTINCT id) AS n FROM r),
c AS (SELECT field, term, count(*) AS n_occurrences, count(DISTINCT id) AS n_records FROM (SELECT * FROM k UNION ALL SELECT * FROM w) GROUP BY field, term),
t AS (SELECT field, term, n_occurrences, n_records, CASE WHEN n_records < 3 THEN 'rare' WHEN n_records > 0.2 * n THEN 'common' END AS mark FROM c, n)
"""
_GRAMS = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k : k + 11], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM iw)),
dg AS (SELECT doc_id, array_to_string(w[k : k + 11], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM dw))
"""


def _form(text: str) -> str:
    """The uniform form, for the characters that these tables hold: look-alikes, full-width forms, spaces, invisible characters, Latin ligatures, composition."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    seen = uniform.LIKE + wide + uniform.SPACES
    reads = uniform.LATIN + "".join(chr(ord(c) - 0xFEE0) for c in wide) + " " * len(uniform.SPACES)
    out = f"translate(regexp_replace({text}, '[\\x{{00AD}}\\x{{200B}}-\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2060}}-\\x{{2064}}\\x{{FEFF}}]', '', 'g'), '{seen}', '{reads.replace(chr(39), chr(39) * 2)}')"
    for ligature, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        out = f"replace({out}, '{ligature}', '{letters}')"
    return f"nfc_normalize({out})"


def _pairs(table: str, field: str) -> str:
    own = f"(SELECT row_id, {field} AS t, {_form(field)} AS f FROM {table} WHERE {field} <> '')"
    return f"SELECT '{table}' AS tbl, '{field}' AS field, a.row_id AS id_a, b.row_id AS id_b FROM {own} a JOIN {own} b ON a.f = b.f AND a.row_id < b.row_id AND a.t <> b.t"


def oracle_sql() -> dict[str, str]:
    return {
        "p1_terms": _TERMS + "SELECT * FROM t",
        "p1_found": _TERMS + "SELECT field, term, mark FROM t WHERE mark IS NOT NULL",
        "p5_found": " UNION ALL ".join(_pairs(t, f) for t, f in (("multilingual_completion", "theft"), ("multilingual_completion", "cheating"), ("statute_supplements", "text"))),
        "p5_classes": f"SELECT row_id, min(row_id) OVER (PARTITION BY {_form('text')}) AS class_id FROM statute_supplements WHERE text <> ''",
        "p8_mostly": _GRAMS.replace("SELECT DISTINCT item_id, array", "SELECT item_id, k, array") + "SELECT doc_id, item_id FROM (SELECT DISTINCT doc_id, item_id, k + unnest(range(12)) AS at FROM (SELECT DISTINCT doc_id, gram FROM dg) JOIN ig USING (gram)) JOIN iw USING (item_id) GROUP BY doc_id, item_id, len(w) HAVING count(*) >= 0.5 * len(w)",
        "p8_found": _GRAMS + "SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (gram)",
    }
