import random

from lexloom.llm import ocr as O
from lexloom.llm import pages

CLEAN = "Whoever keeps a boundary-hedge pays a fine within seven years. The section includes every imprisonment and detention. Whoever keeps a boundary-hedge pays the fine. official record consented"
SCAN = "3. Keeping of boat.—Whoever keeps a boun-\ndary-hedge pays a fme within 5even years. The sec-\n- 12 -\nRIVER TRADES ACT    12\ntion includcs every imprison¬\nment.\nFee in rupees:\n13\nThe official boundary-\nhedge.\n[13]\nRIVER TRADES ACT    13\nrecord"
FACTS = {"page": "page", "end_page": "end_page", "title": "title", "document": "document"}
SCHEMA = "row_id long, text string, kind string, page int, end_page int, title string, document string"


def scans(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as item", "'z' as rest", "2 as shape")
    return O.Scans(df, "row_id", "text", "kind = 'scan'", FACTS)


def clean(k):
    return (k, CLEAN, None, None, None, None, None)


def test_findings(spark):
    s = scans(spark, [clean(1), clean(2), (3, SCAN, "scan", 11, 13, None, "River Trades Act, 1936"), (4, None, "scan", 1, 1, None, None), (5, "", "scan", 1, 1, None, None)])
    got = {(r.kind, r.item) for r in s.findings().collect() if r.row_id == 3}
    assert got == {
        ("hyphen", "boundary-hedge"), ("hyphen", "section"), ("hyphen", "imprisonment"), ("misread", "fine"), ("misread", "seven"), ("misread", "includes"),
        ("pagenum", "- 12 -"), ("pagenum", "[13]"), ("header", "RIVER TRADES ACT    12"), ("header", "RIVER TRADES ACT    13"),
    }
    text = " ".join(s.repaired().where("row_id = 3").first().paragraphs)
    assert "pays a fine within seven years. The section includes every imprisonment." in text and "RIVER" not in text and "[13]" not in text


def test_recurring_header_without_facts(spark):
    body = "THE CODE OF MARROW\nWhoever keeps\nthe fine"
    s = scans(spark, [clean(1), clean(2), (3, body, "scan", None, None, None, None), (4, body, "scan", None, None, None, None), (5, body.replace("CODE", "C0DE"), "scan", None, None, None, None), (6, "Whoever keeps\nthe boat\nTHE ONLY ONE HERE\nand so", "scan", None, None, None, None)])
    got = {(r.row_id, r.item) for r in s.findings().where("kind = 'header'").collect()}
    assert got == {(3, "THE CODE OF MARROW"), (4, "THE CODE OF MARROW"), (5, "THE C0DE OF MARROW")}


def page(text, first, last, *heads):
    own = pages.Page(text, first, last, [pages.Head(pages.key(h)) for h in heads])
    return own.mark_heads(own.repeated()).marks


def test_numbers_on_lines():
    mark = lambda text, first, last: page(text, first, last)
    assert mark("a\n12\nb", 11, 12)[1] == "pagenum" and mark("a\n99\nb", 11, 12)[1] is None
    assert mark("Fee in rupees:\n12\nb", 11, 12)[1] is None and mark("Fee in rupees:\n- 12 -\nb", 11, 12)[1] == "pagenum"
    assert mark("a\n7\nb\n8\nc", None, None) == [None, "pagenum", None, "pagenum", None]


def test_heads_repeat_at_page_tops_whatever_their_case():
    text = "the river trades act\nWhoever keeps a boat\npays ten.\n- 12 -\nthe river tradcs act\nand so it\n- 13 -\nthe river trades act\nis."
    assert page(text, 11, 13) == ["header", None, None, "pagenum", "header", None, "pagenum", "header", None]
    inside = "Whoever keeps\nthe river trades act\nand\n- 12 -\nmore of it\nthe river trades act\nis."
    assert page(inside, 11, 12) == [None, None, None, "pagenum", None, None, None]


def test_heads_by_facts():
    assert page("a\nSec. 9] New Code of Marr0w\nb", 1, 2, "New Code of Marrow")[1] == "header"
    assert page("a\nKEEPING OF BOAT OR FER    12\nb", 1, 2, "Keeping of boat or ferry")[1] == "header"
    assert page("12. Keeping of boat or ferry.\nb", 1, 2, "Keeping of boat or ferry")[0] is None


def test_banded_comparison():
    def brute(pattern, text, most):
        row = list(range(len(text) + 1))
        for i, c in enumerate(pattern, 1):
            new = [i]
            for j, d in enumerate(text, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
            row = new
        return min(row) <= most

    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in range(2))
        for most in range(4):
            assert pages.begins_like(a, b, most) == brute(a, b, most)


def test_misreadings_are_told_by_rates(spark):
    rows = [(k, "boat", None, None, None, None, None) for k in range(30)] + [(k, "hoat", None, None, None, None, None) for k in range(30, 33)] + [(k, "coat", None, None, None, None, None) for k in range(40, 60)]
    s = scans(spark, [*rows, (99, "a boat, a hoat", "scan", 1, 1, None, None), (98, "a bcat ccat", "scan", 1, 1, None, None)])
    assert not s.findings().where("kind = 'misread' and item = 'hoat'").count()


def test_undone():
    assert O.undone("fme")["fine"] == 1 and O.undone("5ociefy")["society"] == 2 and O.undone("546") == {}


def test_no_scans(spark):
    s = scans(spark, [clean(1)])
    assert s.findings().count() == 0 and s.repaired().count() == 0
    s = scans(spark, [(3, "thc boat", "scan", 1, 1, None, None)])
    assert s.findings().count() == 0
