import random

import pyarrow as pa
import pytest

from lexloom.llm import pieces as P

SECTION = "12. Wrongful keeping of ferry.—(1) Whoever keeps a ferry under sub-section (3) of section 4 pays: Provided that no ferry is small. (2) A person shall show it.\nExplanation.—A boat is a ferry. Exception 1. — It is not (b). Illustrations.—(a) A keeps a ferry. B does not.\n(b) B, a man, errs under sub-section (2). (3) Where it is so, pay. [Subs. by G.N. 1]"


def test_units():
    got = [SECTION[a : a + 12] for a in P.starts_in(SECTION)]
    assert got == ["Provided tha", "(2) A person", "Explanation.", "Exception 1.", "Illustration", "(3) Where it"]


def test_units_in_scans_and_lookalikes():
    scan = "6. Keeping.—1) Whoever keeps a boat pays.\n- 12 -\nRIVER ACT    12\n2) A person shall. Expla-\nnation.—A boat.\nNumber of entries:\n458\n3) Where so. Prov1ded that it is."
    got = [scan[a : a + 5] for a in P.starts_in(scan, 11, 12, None, "River Act, 1936", True)]
    assert got == ["2) A ", "Expla", "3) Wh", "Prov1"]
    odd = "1. K.—(1) Whoever. Prоvіdеd that. （２） A person. Ｅxcеption.—It"
    assert [odd[a] for a in P.starts_in(odd)] == ["P", "（", "Ｅ"]


def check(text, spans, limit=P.LIMIT, overlap=P.OVERLAP):
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(b - a <= limit for a, b in spans)
    assert all(after[0] == before[1] - overlap for before, after in zip(spans, spans[1:]))


@pytest.mark.parametrize("text", [SECTION * 9, "x" * 20_000, "word " * 5000, "a. " * 3000, "short", "x" * 1500])
def test_pieces_cover_with_overlap(text):
    check(text, P.pieces_of(text, P.starts_in(text)))


def test_cuts_at_units():
    text = SECTION * 9
    units = set(P.starts_in(text))
    spans = P.pieces_of(text, sorted(units))
    assert all(b in units for _, b in spans[:-1])


def test_table(spark):
    long = (SECTION + " ") * 9
    rows = [(1, long), (1, long), (2, None), (3, ""), (4, "tiny")]
    df = spark.createDataFrame(rows, "row_id long, text string").selectExpr("*", "1 as piece_no", "'x' as t", "2 as start_char")
    got = P.pieces(df, "row_id", "text", {}).collect()
    assert len([r for r in got if r.row_id == 1]) == 2 * len(P.pieces_of(long, P.starts_in(long)))
    assert [(r.start_char, r.end_char) for r in got if r.row_id == 4] == [(0, 4)]
    assert {r.row_id for r in got} == {1, 4}
    assert {r.start_char for r in P.unit_table(df, "row_id", "text", {}).collect()} == set(P.starts_in(long))
    assert P.pieces(df.limit(0), "row_id", "text", {}).count() == 0


SCANNED = "6. Keeping of a boat.—(1) Whoever keeps a boat pays.\n- 12 -\nKEEPING OF A BOAT    12\n2) A person shall. Expla-\nnation.—A boat. Number of entries:\n458\n3) Where so. Prov1ded that it is.\n"


def scanned(n):
    return "".join(SCANNED.replace("12", str(12 + k)) for k in range(n))


@pytest.mark.parametrize("size", [7, 500, 1500, 20_000])
@pytest.mark.parametrize("kind", ["plain", "scan", "scan without pages", "no spaces", "odd"])
def test_ranges_of_any_size_agree_with_the_whole(size, kind):
    rng = random.Random(3)
    plain = (SECTION + " ") * 30
    text = {"plain": plain, "scan": scanned(30), "scan without pages": scanned(30), "no spaces": "ab" * 2000 + " c " + "d" * 4000, "odd": "".join(rng.choice(["(2) ", "A", ". ", "\n", "\u200b", "é", "Explanation.—", "Provided that it", " e\u0301", ": "]) for _ in range(3000))}[kind]
    text = text[: 9000 if size > 10 else 900]
    facts = (12, 42, "Keeping of a boat", None) if kind == "scan" else (None, None, None, None)
    batch = pa.RecordBatch.from_pylist([{"row_key": 1, "t": text, "page": facts[0], "end_page": facts[1], "title": facts[2], "document": facts[3], "scanned": kind.startswith("scan")}] * 2)
    units = P.starts_in(text, *facts, kind.startswith("scan"))
    got = next(iter(P._units(size)(iter([batch]))))
    assert sorted(got.column(1).to_pylist()) == sorted(units * 2)
    assert kind == "no spaces" or units or size < 10
    limit, overlap = (1500, 150) if size > 10 else (300, 40)
    spans = next(iter(P._spans(size, limit, overlap)(iter([batch])))).to_pylist()
    want = P.pieces_of(text, units, limit, overlap)
    check(text, want, limit, overlap)
    assert [(r["piece_no"], r["start_char"], r["end_char"]) for r in spans] == [(k, a, b) for k, (a, b) in enumerate(want)] * 2


def test_files(spark, tmp_path):
    text = "".join(f"({k}) Whoever keeps नाव no. {k} pays. Explanation.—So. " for k in range(2, 900))
    (tmp_path / "a.txt").write_bytes(text.encode())
    (tmp_path / "b.txt").write_bytes(b"")
    got = P.file_pieces(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")], range_bytes=9000).orderBy("piece_no").collect()
    assert [(r.start_char, r.end_char) for r in got] == P.pieces_of(text, P.starts_in(text)) and [r.piece_no for r in got] == list(range(len(got)))
    assert all(r.piece == text[r.start_char : r.end_char] for r in got)
