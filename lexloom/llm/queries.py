"""The queries of this package, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.llm import languages, leaks, ocr, pieces, reading, sentences, terms, tokens, uniform
from lexloom.llm.base import table

SCAN = "record_type = 'scan-extract'"
PAGE_FACTS = {"page": "source.page", "end_page": "source.end_page", "title": "title", "document": "source.document"}


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct keyword and text term of the statutes with its counts and mark."""
    return terms.term_counts(table(spark, sf_dir, "statute_supplements"), "id", "keywords", "text")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_terms(spark, sf_dir).where("mark is not null").select("field", "term", "mark")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.unit_table(table(spark, sf_dir, "statute_supplements"), "row_id", "text", PAGE_FACTS | {"scanned": SCAN})


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every statute text, with what the record keeps."""
    statutes = table(spark, sf_dir, "statute_supplements")
    cut = pieces.pieces(statutes, "row_id", "text", PAGE_FACTS | {"scanned": SCAN})
    kept = statutes.select("row_id", "id", "section", "text")
    out = cut.join(kept, "row_id")
    return out.select("row_id", "id", "section", "piece_no", "start_char", "end_char", F.substring("text", F.col("start_char") + 1, F.col("end_char") - F.col("start_char")).alias("piece"))


def _sentence_tables(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame, str]]:
    statutes = table(spark, sf_dir, "statute_supplements", "row_id", "text", "record_type").where("record_type is null or record_type <> 'scan-extract'")
    return [("candidate_cases", table(spark, sf_dir, "candidate_cases", "row_id", "facts"), "facts"), ("multilingual_completion", table(spark, sf_dir, "multilingual_completion", "row_id", "injury"), "injury"), ("statute_supplements", statutes, "text")]


def p3_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of the three tables, scan extracts apart, which the contract of problem 3 leaves out."""
    tables = _sentence_tables(spark, sf_dir)
    tagger = sentences.train([(df, "row_id", text) for _, df, text in tables])
    parts = [sentences.sentences(df, "row_id", text, tagger).withColumn("tbl", F.lit(name)) for name, df, text in tables]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).select("tbl", "row_id", "start_char", "end_char")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_sentences(spark, sf_dir).select("tbl", "row_id", "start_char")


def _languages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "multilingual_completion", "row_id", "language", "theft", "injury", "cheating")
    tagger = sentences.train([(rows, "row_id", field) for field in ("theft", "injury", "cheating")], limit=480)
    model = languages.train(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), "doc_id", "text", "lang", rows, "row_id", "language", ("theft", "injury", "cheating"), tagger)
    return rows, languages.segments(rows, "row_id", "theft", tagger, model)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, parts = _languages(spark, sf_dir)
    label = rows.select("row_id", languages.language_expr("language").alias("label"))
    return parts.where("language is not null").select("row_id", "language").distinct().join(label, "row_id").where("label is null or label <> language").select("row_id", "language")


def p4_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of `theft` with its language and confidence."""
    return _languages(spark, sf_dir)[1]


def p4_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row's main language, with a confidence and its share of the text."""
    return languages.document_languages(_languages(spark, sf_dir)[1], "row_id")


#: The fields of problem 5.
ALIKE = (("multilingual_completion", "theft"), ("multilingual_completion", "cheating"), ("statute_supplements", "text"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name, field in ALIKE:
        pairs = uniform.differing_pairs(table(spark, sf_dir, name, "row_id", field), "row_id", field)
        parts.append(pairs.select(F.lit(name).alias("tbl"), F.lit(field).alias("field"), "id_a", "id_b"))
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def p5_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of equal reading of every statute text."""
    return uniform.classes(table(spark, sf_dir, "statute_supplements", "row_id", "text"), "row_id", "text").select("row_id", "class_id")


def p5_field_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of equal reading of every value of all three fields; a class holds values of one field."""
    parts = [uniform.classes(table(spark, sf_dir, name, "row_id", field), "row_id", field).select(F.lit(name).alias("tbl"), F.lit(field).alias("field"), "row_id", "class_id") for name, field in ALIKE]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def p5_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The uniform form of every value of all three fields; null stays null."""
    parts = [uniform.uniform(table(spark, sf_dir, name, "row_id", field), field, "row_id").select(F.lit(name).alias("tbl"), F.lit(field).alias("field"), "row_id", "uniform_text") for name, field in ALIKE]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def _scans(spark: SparkSession, sf_dir: str) -> ocr.Scans:
    return ocr.Scans(table(spark, sf_dir, "statute_supplements", "row_id", "text", "source", "title", "record_type"), "row_id", "text", SCAN, PAGE_FACTS)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scans(spark, sf_dir).findings()


def p6_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scans(spark, sf_dir).repaired()


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text")


def _leaks(spark: SparkSession, sf_dir: str, coverage: float = 0.0) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", table(spark, sf_dir, "eval_items", "item_id", "text"), "item_id", "text", coverage=coverage)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of whose words tiles hold at least 12, by document."""
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tiles and how much of each leaked item a document holds."""
    return _leaks(spark, sf_dir)


def p8_mostly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items at least half of whose words a document holds in tiles, in whatever order."""
    return _leaks(spark, sf_dir, 0.5).select("doc_id", "item_id")


def _graded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source"), table(spark, sf_dir, "reading_labels", "doc_id", "band")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = _graded(spark, sf_dir)
    grader = reading.train(documents, "doc_id", "text", "source", labels, "doc_id", "band")
    return reading.levels(documents.where("lang = 'en'"), "doc_id", "text", grader).select("doc_id", "band")


def p9_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grade of every text, whatever its language and length, with a flag where the labels don't speak for it."""
    documents, labels = _graded(spark, sf_dir)
    graders = reading.train_both(documents, "doc_id", "text", "source", labels, "doc_id", "band")
    return reading.every_level(documents, "doc_id", "text", "lang", graders)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit() and callable(f)}
    return dict(sorted(found.items()))
