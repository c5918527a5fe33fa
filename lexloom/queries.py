"""The queries of the library, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import checks as C
from lexloom.functions import dates as D
from lexloom.functions import grammar as G
from lexloom.functions import profiles as P
from lexloom.functions import text as T
from lexloom.functions import words
from lexloom.operators import corpus, evaluation, intervals, keyphrases, ordered, retrieval, review, validation
from lexloom.plans import analysis, ranking
from lexloom.session import shared_folder, ship, spread
from lexloom.streaming import events as stream


#: Tables of texts, whose rows cost far more to handle than to deal out.
TEXTS = ("statute_supplements", "candidate_cases", "documents", "multilingual_completion")


def _t(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    df = df.select(*columns) if columns else df
    return spread(df) if name in TEXTS else df


def _micros(name: str):
    """Microseconds of a time with or without a zone; sessions run in UTC."""
    return F.unix_micros(F.col(name).cast("timestamp"))


# Retrieval


def _documents(spark, sf_dir):
    docs = _t(spark, sf_dir, "statute_supplements", "row_id", "code", "section", "title", "text", "keywords", "maps_to")
    return docs.where(~retrieval.repealed(F.col("title"), F.col("text")))


def _doc_tokens(docs):
    return retrieval.document_tokens(docs, "row_id", "title", F.col("section"), F.col("title"), F.col("text"), F.array_join("keywords", " "))


def _item_scores(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    asked = retrieval.query_tokens(_t(spark, sf_dir, "eval_items", "item_id", "text"), "item_id", "text")
    return docs, retrieval.scores(asked, _doc_tokens(docs), retrieval.counted(docs))


def _named(ranked):
    return ranked.select(F.col("qid").alias("item_id"), F.col("doc").alias("row_id"), F.round("score", 6).alias("score"), "rank")


def retrieval_topk(spark, sf_dir):
    """The three best statutes for every evaluation item."""
    return _named(retrieval.top(_item_scores(spark, sf_dir)[1].withColumn("score", F.round("score", 6))))


def retrieval_by_code(spark, sf_dir):
    """The three best of each code (the preview without a date)."""
    docs, scored = _item_scores(spark, sf_dir)
    both = scored.withColumn("score", F.round("score", 6)).join(docs.select(F.col("row_id").alias("doc"), "code"), "doc")
    return retrieval.top(both, by=("qid", "code")).select(F.col("qid").alias("item_id"), "code", F.col("doc").alias("row_id"), "score", "rank")


def retrieval_diversified(spark, sf_dir):
    """Each code's best first, then the best of the rest."""
    docs, scored = _item_scores(spark, sf_dir)
    both = scored.withColumn("score", F.round("score", 6)).join(docs.select(F.col("row_id").alias("doc"), "code"), "doc")
    return retrieval.diversified(both, "code").select(F.col("qid").alias("item_id"), "code", F.col("doc").alias("row_id"), "score", "rank")


def idf_table(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return retrieval.document_frequency(_doc_tokens(docs)).crossJoin(F.broadcast(retrieval.counted(docs))).select("token", "df", F.round(retrieval.idf(F.col("df"), F.col("n")), 6).alias("idf"))


def excerpts(spark, sf_dir):
    """What each item's best statute shows."""
    best = _named(retrieval.top(_item_scores(spark, sf_dir)[1].withColumn("score", F.round("score", 6)), 1))
    items = _t(spark, sf_dir, "eval_items", "item_id", F.col("text").alias("q"))
    texts = _t(spark, sf_dir, "statute_supplements", "row_id", "text")
    both = best.join(items, "item_id").join(texts, "row_id")
    return both.select("item_id", "row_id", T.excerpt("text", T.retrieval_tokens("q")).alias("excerpt"))


def reference_matches(spark, sf_dir):
    """Statutes that a case cites by number."""
    cases = _t(spark, sf_dir, "candidate_cases", "row_id", "facts").select(F.col("row_id").alias("case_row"), F.explode(T.section_references("facts")).alias("r"))
    cited = cases.select("case_row", F.col("r.code").alias("ref_code"), F.col("r.section").alias("ref_section")).distinct()
    docs = _t(spark, sf_dir, "statute_supplements", "row_id", "code", "section").where("section is not null").withColumn("ref_section", F.upper("section"))
    return cited.join(docs, "ref_section").where("ref_code is null or ref_code = code").select("case_row", "row_id").distinct()


# Facts


def section_refs(spark, sf_dir):
    rows = _t(spark, sf_dir, "candidate_cases", "row_id", "facts").select("row_id", F.posexplode(T.section_references("facts")).alias("pos", "r"))
    return rows.select("row_id", "pos", F.col("r.section").alias("section"))


def _dated(spark, sf_dir):
    cases = _t(spark, sf_dir, "candidate_cases", "row_id", "case_id", "facts")
    return cases.withColumn("dates", D.dates("facts")).withColumn("going_on", D.continuing("facts")).withColumn("offence", D.offence_date("facts", F.col("dates")))


def case_dates(spark, sf_dir):
    return _dated(spark, sf_dir).select("row_id", F.explode("dates").alias("d")).select("row_id", F.col("d.value").alias("value"))


def case_routes(spark, sf_dir):
    own = _dated(spark, sf_dir)
    return own.select("row_id", "offence", "going_on", F.size("dates").alias("n_dates"), D.period_route(F.col("dates"), F.col("going_on"), F.col("offence")).alias("route"))


def route_counts(spark, sf_dir):
    return case_routes(spark, sf_dir).groupBy("route").agg(F.count("*").alias("n"), F.count("offence").alias("dated"))


def vocabulary_counts(spark, sf_dir):
    return _t(spark, sf_dir, "candidate_cases", "facts").select(F.explode(T.vocabulary_hits("facts")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def phrase_counts(spark, sf_dir):
    return _t(spark, sf_dir, "candidate_cases", "facts").select(F.explode(T.phrase_labels("facts")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


# Corpus building


def keywords_top16(spark, sf_dir):
    return corpus.keyword_lists(_t(spark, sf_dir, "statute_supplements", "row_id", "title", "text"), "row_id", "title", "text")


def record_counts(spark, sf_dir):
    return corpus.manifest(_t(spark, sf_dir, "statute_supplements", "code", "record_type"), "code", "record_type")


def overlaid_titles(spark, sf_dir):
    """Primary records, each with the title of its record's latest supplement if it has one."""
    every = _t(spark, sf_dir, "statute_supplements", "row_id", "id", "title", "record_type")
    extra = corpus.latest(every.where("record_type = 'primary-statute-supplement'"), "id", "row_id").select("id", "title")
    return corpus.overlay(every.where("record_type = 'primary-statute'").select("row_id", "id", "title"), extra, "id")


def latest_records(spark, sf_dir):
    return corpus.latest(_t(spark, sf_dir, "statute_supplements", "id", "row_id", "code", "record_type"), "id", "row_id")


def crosswalk_adjacency(spark, sf_dir):
    edges = _t(spark, sf_dir, "crosswalk_edges").select(F.concat(F.lit("ipc-"), F.lower("ipc")).alias("a"), F.concat(F.lit("bns-"), F.lower("bns")).alias("b"))
    return corpus.adjacency(edges, "a", "b")


def mapping_only_records(spark, sf_dir):
    edges = _t(spark, sf_dir, "crosswalk_edges")
    ends = edges.select(F.concat(F.lit("IPC "), "ipc").alias("provision"), "offence").unionAll(edges.select(F.concat(F.lit("BNS "), "bns").alias("provision"), "offence"))
    known = _t(spark, sf_dir, "statute_supplements", "code", "section").where("section is not null").select(F.concat_ws(" ", "code", T.section_base("section")).alias("provision"))
    return corpus.mapping_only(ends.groupBy("provision").agg(F.min("offence").alias("offence")), known, "provision", "provision")


def eligible_mappings(spark, sf_dir):
    """Edges both of whose ends the corpus has."""
    sections = _t(spark, sf_dir, "statute_supplements", "code", "section").where("section is not null").distinct()
    edges = _t(spark, sf_dir, "crosswalk_edges", "ipc", "bns")
    has = lambda df, code, column: df.join(sections.where(F.col("code") == code).select(F.col("section").alias(column)).distinct(), column, "left_semi")
    return has(has(edges, "IPC", "ipc"), "BNS", "bns").select("ipc", "bns")


def page_starts(spark, sf_dir):
    rows = _t(spark, sf_dir, "statute_supplements").where("source.page is not null").select("row_id", F.col("source.file").alias("file"), F.col("source.page").alias("page"), "text")
    return corpus.page_offsets(rows, "file", ["page", "row_id"], "text").select("row_id", "file", "page", "page_start")


def page_as_of(spark, sf_dir):
    """The page on which each 10,000th character of a book stands."""
    starts = page_starts(spark, sf_dir)
    ends = starts.groupBy("file").agg(F.max("page_start").alias("top"))
    points = ends.select("file", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top"), F.lit(10_000).cast("long"))).alias("at"))
    last = starts.groupBy("file", "page_start").agg(F.max("page").alias("page"))
    return corpus.as_of(points, last, "file", "at", "page_start", "page")


def page_spans(spark, sf_dir):
    return corpus.spans(page_starts(spark, sf_dir), "file", ["page", "row_id"], "page_start").select("row_id", "page_start", "span_end")


def derived_titles(spark, sf_dir):
    return _t(spark, sf_dir, "statute_supplements", "row_id", "text", "section").select("row_id", T.derived_title("text").alias("derived"), T.section_base("section").alias("base"))


def repealed_records(spark, sf_dir):
    rows = _t(spark, sf_dir, "statute_supplements", "row_id", "title", "text")
    return rows.groupBy(retrieval.repealed(F.col("title"), F.col("text")).alias("repealed")).agg(F.count("*").alias("n"))


# Text analytics


def _english(spark, sf_dir):
    """Documents labelled as English: the word lists of these queries are English; `profile_counts` covers five languages."""
    return _t(spark, sf_dir, "documents", "doc_id", "text", "lang").where("lang = 'en'").select("doc_id", "text")


def _words(spark, sf_dir):
    return _english(spark, sf_dir).select("doc_id", F.explode(T.tokens("text")).alias("token")).withColumn("kind", T.token_kind("token"))


def token_stats(spark, sf_dir):
    """Counts of tokens in each English document; a document is a row, so nothing is shuffled."""
    own = _english(spark, sf_dir).select("doc_id", T.tokens("text").alias("t"))
    words_only = F.filter("t", lambda t: T.token_kind(t) == "word")
    own = own.where(F.size("t") > 0).withColumn("w", F.transform(words_only, lambda t: F.lower(t)))
    return own.select("doc_id", F.size("t").alias("tokens"), F.size("w").alias("words"), F.size(F.array_distinct("w")).alias("unique_words"), F.size(F.filter("t", lambda t: T.token_kind(t) == "number")).alias("numbers"), F.size(F.filter("w", lambda t: T.is_stop(t))).alias("stop_words"))


def stem_counts(spark, sf_dir):
    own = _words(spark, sf_dir).where("kind = 'word'").where(F.col("token").rlike("^[A-Za-z]+$"))
    return own.groupBy(F.lower("token").alias("word")).agg(F.count("*").alias("n")).select("word", F.lower(T.stem("word")).alias("stem"), "n")


def negation_counts(spark, sf_dir):
    return _words(spark, sf_dir).where((F.col("kind") == "word") & T.is_negation("token")).groupBy(F.lower("token").alias("word")).agg(F.count("*").alias("n"))


def rake_top8(spark, sf_dir):
    items = _t(spark, sf_dir, "eval_items", "item_id", "text", "lang").where("lang = 'en'")
    return keyphrases.keyphrases(items, "item_id", "text")


def script_counts(spark, sf_dir):
    own = _t(spark, sf_dir, "multilingual_completion", "theft").where("theft is not null")
    return own.groupBy(T.script("theft").alias("script")).agg(F.count("*").alias("n"))


def ascii_numbers(spark, sf_dir):
    own = _t(spark, sf_dir, "multilingual_completion", "row_id", "theft").where("theft is not null")
    return own.select("row_id", F.array_join(T.number_literals("theft"), "|").alias("numbers"))


def kept_numbers(spark, sf_dir):
    """Whether `cheating` names the same numbers as `theft`, each as often."""
    own = _t(spark, sf_dir, "multilingual_completion", "row_id", "theft", "cheating").where("theft is not null and cheating is not null")
    return own.select("row_id", T.same_numbers("theft", "cheating").alias("same"))


def tidied(spark, sf_dir):
    own = _t(spark, sf_dir, "multilingual_completion", "row_id", "theft").where("theft is not null")
    return own.select("row_id", T.tidy("theft").alias("tidy"))


def label_codes(spark, sf_dir):
    return _t(spark, sf_dir, "multilingual_completion", "language").groupBy(T.language_code("language").alias("code")).agg(F.count("*").alias("n"))


def duplicate_texts(spark, sf_dir):
    own = _t(spark, sf_dir, "documents", "doc_id", "text").where("text is not null")
    return own.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def sentence_counts(spark, sf_dir):
    ship(spark)
    own = _t(spark, sf_dir, "candidate_cases", "row_id", "facts")
    return own.select("row_id", F.size(G.sentences_udf()("facts")).alias("sentences"))


def entity_rows(spark, sf_dir):
    ship(spark)
    own = _t(spark, sf_dir, "candidate_cases", "row_id", "facts")
    return own.select("row_id", F.explode(G.entities_udf()("facts")).alias("e")).select("row_id", "e.*")


def written_numbers(spark, sf_dir):
    ship(spark)
    own = _t(spark, sf_dir, "candidate_cases", "row_id", "facts").withColumn("r", G.numbers_udf()("facts"))
    return own.select("row_id", F.col("r.text").alias("text"), F.size("r.corrections").alias("corrections"))


def lexicon_repairs(spark, sf_dir):
    ship(spark)
    own = _t(spark, sf_dir, "candidate_cases", "row_id", "facts").withColumn("r", G.lexicon_udf()("facts"))
    return own.select("row_id", F.explode("r.corrections").alias("c")).select("row_id", F.col("c.from").alias("heard"), F.col("c.to").alias("term"))


def protected_spans(spark, sf_dir):
    ship(spark)
    own = _t(spark, sf_dir, "statute_supplements", "row_id", "text").withColumn("p", G.parts_udf()("text"))
    return own.select("row_id", F.size("p").alias("parts"), F.size(F.filter("p", lambda x: x["literal"])).alias("literals"), (F.coalesce("text", F.lit("")) == F.array_join(F.transform("p", lambda x: x["text"]), "")).alias("whole"))


def composed_texts(spark, sf_dir):
    ship(spark)
    own = _t(spark, sf_dir, "multilingual_completion", "row_id", "theft").where("theft is not null")
    return own.select("row_id", G.normal_udf("NFC")("theft").alias("nfc"))


# Evaluation


def _cases(spark, sf_dir):
    """One row per case: the last delivered."""
    return corpus.latest(_t(spark, sf_dir, "candidate_cases", "case_id", "row_id", "facts"), "case_id", "row_id")


def _labels(spark, sf_dir):
    rows = _t(spark, sf_dir, "gold_labels")
    return rows.groupBy("case_id").agg(F.max("applicable_law").alias("law"), F.max(F.concat_ws(" ", "correct_top1_provision.code", "correct_top1_provision.section")).alias("top1"))


def label_problems(spark, sf_dir):
    rows = _t(spark, sf_dir, "gold_labels")
    bad = evaluation.label_violations(F.col("applicable_law"), F.col("correct_top1_provision"), F.col("correct_top3_provisions"))
    return rows.select(F.explode(bad).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


def repeated_labels(spark, sf_dir):
    return evaluation.repeated_keys(_t(spark, sf_dir, "gold_labels", "case_id"), "case_id")


def label_coverage(spark, sf_dir):
    pairs = evaluation.one_to_one(_t(spark, sf_dir, "candidate_cases", "case_id"), _t(spark, sf_dir, "gold_labels", "case_id"), "case_id")
    return pairs.groupBy("problem").agg(F.count("*").alias("n"))


def route_accuracy(spark, sf_dir):
    """Routes of labelled cases against their labels: rates with their own denominators."""
    cases = _cases(spark, sf_dir).withColumn("dates", D.dates("facts"))
    routed = cases.select("case_id", D.period_route(F.col("dates"), D.continuing("facts"), D.offence_date("facts", F.col("dates"))).alias("route"))
    both = routed.join(_labels(spark, sf_dir), "case_id")
    hit, dated = F.col("route") == F.col("law"), F.col("law") != "CLARIFY"
    return both.agg(F.count("*").alias("cases"), evaluation.masked_rate(hit, F.col("law").isNotNull()).alias("law_accuracy"), evaluation.masked_rate(hit, dated).alias("dated_accuracy"), evaluation.percent(F.count_if(F.col("top1") != ""), F.count("*"), 0.0).alias("with_top1"))


def band_ordinals(spark, sf_dir):
    own = _t(spark, sf_dir, "reading_labels", "rater", "band")
    level = F.when(F.col("band") == "basic", 0).when(F.col("band") == "middle", 1).when(F.col("band") == "advanced", 2)
    return own.groupBy("rater").agg(F.count("*").alias("labels"), evaluation.ordinal_percent(level, 2).alias("percent"))


def character_errors(spark, sf_dir):
    """Character error rates, of the letters a-z, of `cheating` against `theft`: micro, mean, and what is left out."""
    own = _t(spark, sf_dir, "multilingual_completion", "theft", "cheating").where("theft is not null and cheating is not null")
    a, b = T.speech_form("theft", "letters"), T.speech_form("cheating", "letters")
    own = own.select(F.levenshtein(a, b).alias("edits"), F.length(a).alias("size"))
    good = own.where("size > 0")
    left_out = own.where("size = 0").agg(F.count("*").alias("left_out"))
    return good.agg(F.count("*").alias("rows"), F.sum("edits").alias("edits"), F.sum("size").alias("size"), F.round(evaluation.micro_rate(F.col("edits"), F.col("size")), 6).alias("micro"), F.round(evaluation.mean_rate(F.col("edits"), F.col("size")), 6).alias("mean")).crossJoin(F.broadcast(left_out))


def word_errors(spark, sf_dir):
    """Word edits of `cheating` against `theft`, words as the public variant forms them."""
    ship(spark)
    own = _t(spark, sf_dir, "multilingual_completion", "row_id", "theft", "cheating").where("theft is not null and cheating is not null")
    form = G.normal_udf(T.SPEECH["public"][0])
    own = own.select("row_id", T.speech_words(form("theft")).alias("r"), T.speech_words(form("cheating")).alias("h"))
    scored = own.select("row_id", T.word_edits(F.col("r"), F.col("h")).alias("edits"), F.size("r").alias("words"))
    return scored.withColumn("wer", F.round(F.try_divide("edits", "words"), 6))


def value_quantiles(spark, sf_dir):
    own = _t(spark, sf_dir, "events", "event_type", "value").where("value is not null and not isnan(value)")
    return own.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.median("value"), 6).alias("median"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"))


def composite_summary(spark, sf_dir):
    own = _t(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount")
    return own.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"))


def _arms(spark, sf_dir):
    own = _t(spark, sf_dir, "lineitem", "l_suppkey", "l_returnflag", "l_quantity", "l_extendedprice").where("l_returnflag in ('A', 'R')")
    return own.groupBy("l_suppkey", "l_returnflag").agg(F.sum("l_quantity").cast("double").alias("errors"), F.round(F.avg("l_extendedprice"), 4).alias("cost"))


def paired_gate(spark, sf_dir):
    return evaluation.regression_gate(evaluation.paired(_arms(spark, sf_dir), "l_suppkey", "l_returnflag", "A", "R", "errors", "cost"), "errors", "cost")


def gain_gate(spark, sf_dir):
    out = evaluation.gain_gate(evaluation.paired(_arms(spark, sf_dir), "l_suppkey", "l_returnflag", "A", "R", "errors", "cost"), "errors", "cost")
    return out.select(*(F.round(c, 2).alias(c) if c.endswith("cost") else c for c in out.columns))


def completeness_report(spark, sf_dir):
    cases = _t(spark, sf_dir, "candidate_cases", "case_id")
    return evaluation.completeness(cases, _t(spark, sf_dir, "gold_labels", "case_id", "applicable_law"), "case_id", F.col("applicable_law").isNull())


def unlabelled_cases(spark, sf_dir):
    return _t(spark, sf_dir, "candidate_cases", "case_id").distinct().join(_t(spark, sf_dir, "gold_labels", "case_id"), "case_id", "left_anti")


def buyers_without_orders(spark, sf_dir):
    return _t(spark, sf_dir, "customer", "c_custkey").join(_t(spark, sf_dir, "orders", F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


def buyers_with_orders(spark, sf_dir):
    return _t(spark, sf_dir, "customer", "c_custkey", "c_nationkey").join(_t(spark, sf_dir, "orders", F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


def sealed_labels(spark, sf_dir):
    return _t(spark, sf_dir, "reading_labels").distinct().select("doc_id", evaluation.seal("doc_id", "rater", "band").alias("seal"))


def redelivery_diff(spark, sf_dir):
    """First against last delivery of each case: what changed, and what came only once (new)."""
    own = _t(spark, sf_dir, "candidate_cases", "case_id", "row_id", "facts").withColumn("digest", F.sha2(F.coalesce("facts", F.lit("")), 256))
    n = Window.partitionBy("case_id").orderBy("row_id")
    ranked = own.withColumn("k", F.row_number().over(n))
    last = ranked.where("k > 1").groupBy("case_id").agg(F.max_by("digest", "k").alias("digest"))
    diff = evaluation.snapshot_diff(ranked.where("k = 1"), last, "case_id", "digest")
    return diff.groupBy("status").agg(F.count("*").alias("n"))


def vocabulary_conflicts(spark, sf_dir):
    """Keywords whose frequency rank differs between the two codes, and those of one code only."""
    own = _t(spark, sf_dir, "statute_supplements", "code", "keywords").select("code", F.explode("keywords").alias("w")).select("code", F.lower(F.trim("w")).alias("word")).where("word <> ''")
    counted = own.groupBy("code", "word").agg(F.count("*").alias("n"))
    less = counted.withColumn("less", -F.col("n"))
    ranked = ordered.running(less, ["code"], ["less", "word"], F.lit(1), "before").withColumn("place", F.coalesce("before", F.lit(0)) + 1)
    a = ranked.where("code = 'IPC'").select("word", F.col("place").alias("ipc_place"))
    b = ranked.where("code = 'BNS'").select("word", F.col("place").alias("bns_place"))
    return a.join(b, "word", "full").where(~F.col("ipc_place").eqNullSafe(F.col("bns_place")))


def chosen_cases(spark, sf_dir):
    """The first three eligible cases of each station, in a frozen order; why the rest were passed over."""
    own = _t(spark, sf_dir, "candidate_cases", "case_id", "row_id", "station", "facts").where("station is not null")
    out = evaluation.reserves(own, "station", ["row_id"], "case_id", F.length("facts") >= 50, 3)
    return out.select("row_id", "choice")


def scenario_matrix(spark, sf_dir):
    """Every language by every field, with how many rows fill it; combinations without rows too."""
    own = _t(spark, sf_dir, "multilingual_completion", "language", "theft", "injury", "cheating")
    long = own.select(F.coalesce(T.language_code("language"), F.lit("")).alias("code"), F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in ("theft", "injury", "cheating")))).alias("x"))
    filled = long.where("x.text is not null and x.text <> ''").groupBy("code", F.col("x.field").alias("field")).agg(F.count("*").alias("n"))
    codes, fields = long.select("code").distinct(), spark.createDataFrame([("theft",), ("injury",), ("cheating",)], "field string")
    return codes.join(F.broadcast(fields), F.lit(True)).join(filled, ["code", "field"], "left").fillna({"n": 0})


# Intervals and events


def _visits(spark, sf_dir):
    """Hours in which a user has events, as [start, end) intervals of the month's seconds."""
    own = _t(spark, sf_dir, "events", "user_id", "ts").where("ts is not null")
    hour = (F.floor(F.unix_timestamp("ts") / 3600) * 3600).cast("long")
    return own.select("user_id", hour.alias("start")).distinct().withColumn("end", F.col("start") + 3600)


def event_gaps(spark, sf_dir):
    own = _visits(spark, sf_dir)
    bounds = own.agg(F.min("start").alias("lo"), F.max("end").alias("hi")).first()
    if bounds.lo is None:
        return own.select("user_id", F.col("start").alias("gap_start"), F.col("end").alias("gap_end"))
    return intervals.gaps(own, "user_id", "start", "end", F.lit(bounds.lo), F.lit(bounds.hi))


def retained_share(spark, sf_dir):
    own = _visits(spark, sf_dir)
    return intervals.retained(own, "user_id", "start", "end", F.lit(30 * 86400)).select("user_id", F.round("retained", 6).alias("retained"))


def event_pairs(spark, sf_dir):
    own = _t(spark, sf_dir, "events", "user_id", "ts", "event_id", "event_type")
    return intervals.pairs(own, "user_id", "ts", "event_id", "event_type", "view", "purchase").select("user_id", _micros("opened").alias("opened"), _micros("closed").alias("closed"))


def contiguous_visits(spark, sf_dir):
    return intervals.contiguous(_visits(spark, sf_dir), "user_id", "start", "end")


def rising_values(spark, sf_dir):
    return intervals.increasing(_t(spark, sf_dir, "events", "user_id", "ts", "event_id", "value"), "user_id", ["ts", "event_id"], "value")


def filled_quota(spark, sf_dir):
    own = _t(spark, sf_dir, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return intervals.fill_up_to(own, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"], "l_quantity", 100.0).select("l_suppkey", "l_orderkey", "l_linenumber", "filled")


def late_deliveries(spark, sf_dir):
    """How cases' delays compare with a day's budget."""
    own = _t(spark, sf_dir, "candidate_cases", "submitted_at", "ingested_at")
    wait = _micros("ingested_at").cast("double") - _micros("submitted_at").cast("double")
    fault = intervals.timing_fault(wait, F.col("submitted_at").isNull(), 86_400e6)
    return own.groupBy(F.coalesce(fault, F.lit("none")).alias("fault")).agg(F.count("*").alias("n"), F.count_if(intervals.drift(wait, F.lit(0.0), 3600e6)).alias("within_hour"))


def hourly_windows(spark, sf_dir):
    own = _t(spark, sf_dir, "events", "ts", "event_type", "value")
    out = own.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(_micros("w.start").alias("window_start"), "event_type", "n", "total")


def user_sessions(spark, sf_dir):
    own = _t(spark, sf_dir, "events", "ts", "user_id")
    out = own.groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", _micros("w.start").alias("session_start"), "n")


# Confidence, arrays, presentation


def doubtful_words(spark, sf_dir):
    own = _t(spark, sf_dir, "events", "user_id", "event_type", "value").where("value is not null and not isnan(value)")
    return review.doubtful_words(own.withColumn("p", F.col("value") / 100), "user_id", "event_type", "p").select("user_id", "word", F.round("p", 6).alias("p"), "rank")


def mean_confidence(spark, sf_dir):
    own = _t(spark, sf_dir, "events", "user_id", "event_type", "value").where("value is not null and not isnan(value)")
    return own.groupBy("user_id").agg(review.weighted_confidence(F.col("value"), F.col("event_type")).alias("weighted"), F.round(F.avg("value"), 3).alias("plain"))


def top_dimensions(spark, sf_dir):
    """Places of the five greatest components of each vector, but for place 0."""
    own = _t(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return own.select("vec_id", F.posexplode(review.top_indices(F.col("embedding"), 5, (0,))).alias("rank", "place"))


def citations(spark, sf_dir):
    """Citation lines of each book, as one JSON object."""
    own = _t(spark, sf_dir, "statute_supplements").where("source.file is not null and section is not null and title is not null")
    line = F.concat("code", F.lit(" "), "section", F.lit(": "), "title", F.lit(" ("), "source.authority", F.lit(", "), "source.file", F.coalesce(F.concat(F.lit(", p. "), "source.page"), F.lit("")), F.lit(")"))
    return own.select("row_id", F.to_json(F.struct(F.col("id"), line.alias("citation"))).alias("json"))


def grounding_warnings(spark, sf_dir):
    """Warnings of each route's answers."""
    own = case_routes(spark, sf_dir)
    warn = F.array_compact(F.array(F.when(F.col("route").isin("CLARIFY", "MULTI_PERIOD_REVIEW"), "review"), F.when((F.col("route") == "CLARIFY") & (F.col("n_dates") == 0), "no date"), F.when(F.col("going_on"), "continuing")))
    return own.select(F.explode(warn).alias("warning")).groupBy("warning").agg(F.count("*").alias("n"))


def phrase_runs(spark, sf_dir):
    """How often runs of three words recur in an English document, overlapping ones counted. Runs are sorted within the row; equal ones stand together."""
    own = _english(spark, sf_dir)
    w = F.split(F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")), " ")
    own = own.select("doc_id", w.alias("w")).where(F.size("w") >= 3)
    runs = F.array_sort(F.zip_with(F.zip_with(F.slice("w", F.lit(1), F.size("w") - 2), F.slice("w", F.lit(2), F.size("w") - 2), lambda a, b: F.concat_ws(" ", a, b)), F.slice("w", F.lit(3), F.size("w") - 2), lambda a, b: F.concat_ws(" ", a, b)))
    own = own.select("doc_id", runs.alias("r"))
    own = own.select("doc_id", "r", F.filter(F.sequence(F.lit(1), F.size("r") + 1), lambda i: (i == 1) | (i > F.size("r")) | (F.element_at("r", F.greatest(i - 1, F.lit(1))) != F.element_at("r", F.least(i, F.size("r"))))).alias("first"))
    ends = F.zip_with(F.slice("first", F.lit(1), F.size("first") - 1), F.slice("first", F.lit(2), F.size("first") - 1), lambda a, b: F.struct(a.alias("a"), (b - a).alias("n")))
    each = own.select("doc_id", "r", F.explode(F.filter(ends, lambda x: x["n"] > 1)).alias("x"))
    return each.select("doc_id", F.element_at("r", F.col("x.a")).alias("run"), F.col("x.n").cast("long").alias("n"))


# Checks, plans and streams


def english_like_texts(spark, sf_dir):
    own = _t(spark, sf_dir, "multilingual_completion", "theft").where("theft is not null")
    return own.groupBy(C.english_like(F.col("theft")).alias("english")).agg(F.count("*").alias("n"))


def script_mismatches(spark, sf_dir):
    """Rows whose text has no character of the script of the language that they name."""
    own = _t(spark, sf_dir, "multilingual_completion", "row_id", "language", "theft").where("theft is not null").withColumn("code", T.language_code("language"))
    return own.where(~C.expected_script(F.col("theft"), F.col("code"))).select("row_id", "code")


def invented_numbers(spark, sf_dir):
    """Numbers of `cheating` that `theft` lacks."""
    own = _t(spark, sf_dir, "multilingual_completion", "row_id", "theft", "cheating").where("theft is not null and cheating is not null")
    return own.select("row_id", F.explode(C.invented_numbers(F.col("theft"), F.col("cheating"))).alias("number"))


def item_analysis(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return analysis.analysis(_t(spark, sf_dir, "eval_items", "item_id", "text"), "item_id", "text", docs)


def repaired_once(spark, sf_dir):
    """Composed forms of titles, each distinct title handled once."""
    ship(spark)
    own = _t(spark, sf_dir, "statute_supplements", "row_id", "title")
    return analysis.once_per_value(own, "title", "composed", G.normal_udf("NFC")("title")).select("row_id", "composed")


def crosswalk_benchmark(spark, sf_dir):
    """A query for either end of every edge: whether a statute of that provision stands first, or among three, by exact and mapped references."""
    edges = _t(spark, sf_dir, "crosswalk_edges", "ipc", "bns")
    asked = edges.select(F.concat_ws("-", F.lit("ipc"), "ipc", "bns").alias("qid"), F.lit("IPC").alias("code"), F.col("ipc").alias("section")).unionAll(edges.select(F.concat_ws("-", F.lit("bns"), "ipc", "bns"), F.lit("BNS"), "bns"))
    docs = _documents(spark, sf_dir).where("section is not null").select(F.col("row_id").alias("doc"), F.col("code").alias("doc_code"), T.section_base("section").alias("base"), F.transform(F.coalesce("maps_to", F.array().cast("array<string>")), lambda m: F.element_at(F.split(m, "-r"), 1)).alias("maps_to"))
    exact = asked.join(docs, (F.col("code") == F.col("doc_code")) & (F.col("section") == F.col("base"))).select("qid", "doc", F.lit(50).alias("points"))
    names = docs.select("doc", "doc_code", F.explode("maps_to").alias("name"))
    mapped = asked.withColumn("name", F.concat_ws("-", F.lower("code"), F.lower("section"))).join(names, "name").where("code <> doc_code").select("qid", "doc", F.lit(30).alias("points"))
    ranked = retrieval.top(exact.unionAll(mapped).groupBy("qid", "doc").agg(F.sum("points").alias("score")), 3)
    right = exact.select("qid", "doc").distinct().withColumn("hit", F.lit(True))
    hits = ranked.join(right, ["qid", "doc"], "left").groupBy("qid").agg(F.coalesce(F.bool_or((F.col("rank") == 1) & F.col("hit")), F.lit(False)).alias("top1"), F.coalesce(F.bool_or("hit"), F.lit(False)).alias("top3"))
    return asked.join(hits, "qid", "left").agg(F.count("*").alias("queries"), F.count_if("top1").alias("top1"), F.count_if("top3").alias("top3"), evaluation.percent(F.count_if("top1"), F.count("*"), 0.0).alias("top1_percent"))


def ranked_statutes(spark, sf_dir):
    """The three best statutes of every case with a date that settles its codes: tokens, references, rules and ranks."""
    cases = _cases(spark, sf_dir).select("row_id", "facts").where("facts is not null")
    out = ranking.ranked(cases, "row_id", "facts", _documents(spark, sf_dir))
    return out.select(F.col("qid").alias("row_id"), F.col("doc").alias("statute_row"), "code", "score", "cited", "rank")


def rule_points_by_route(spark, sf_dir):
    """Rules of the table that each route has, and their points."""
    return ranking.rule_table(spark).groupBy("route", "family").agg(F.count("*").alias("rules"), F.sum("points").alias("points"))


def cue_counts(spark, sf_dir):
    """How many cases and scenarios give each cue of the rules."""
    both = _t(spark, sf_dir, "candidate_cases", F.col("facts").alias("t")).unionAll(_t(spark, sf_dir, "multilingual_completion", "injury")).unionAll(_t(spark, sf_dir, "multilingual_completion", "theft")).where("t is not null")
    seen = both.select("t", T.vocabulary_hits("t").alias("keywords"), T.phrase_labels("t").alias("phrases"))
    found = seen.select(ranking.cues(F.col("t"), F.col("keywords"), F.col("phrases"), F.lit("IPC_ONLY")).alias("c"))
    return found.select(F.explode_outer("c").alias("cue")).where("cue is not null").groupBy("cue").agg(F.count("*").alias("n"))  # an inner explode would first filter by the whole expression


def profile_counts(spark, sf_dir):
    """Words, function words, negations and distinct stems of the documents of the five languages that have a profile."""
    docs = _t(spark, sf_dir, "documents", "text", "lang").where("lang in ('en', 'hi', 'mr', 'gu', 'ur')")
    own = docs.select("lang", F.explode(T.tokens("text")).alias("w")).where(T.token_kind("w") == "word")
    counted = own.groupBy("lang", "w").agg(F.count("*").alias("n"))  # each distinct word is looked up once
    n = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0))
    return counted.groupBy("lang").agg(F.sum("n").alias("words"), n(P.is_stop(F.col("w"), F.col("lang"))).alias("stop_words"), n(P.is_negation(F.col("w"), F.col("lang"))).alias("negations"), F.countDistinct(P.stem(F.col("w"), F.col("lang"))).alias("stems"))


def guessed_languages(spark, sf_dir):
    """Languages that script and marker words tell, of all three fields."""
    rows = _t(spark, sf_dir, "multilingual_completion", "theft", "injury", "cheating").select(F.explode(F.array("theft", "injury", "cheating")).alias("t")).where("t is not null")
    return rows.groupBy(P.guessed_language(F.col("t")).alias("language")).agg(F.count("*").alias("n"))


def localized_dates(spark, sf_dir):
    """Dates written with Hindi month names."""
    ship(spark)
    months = G.locale_months(spark, ("hi",))
    own = _t(spark, sf_dir, "eval_items", "item_id", "text", "lang").where("lang = 'hi'")
    return own.select("item_id", F.explode(G.localized_dates_udf(months)("text")).alias("value"))


def named_dates(spark, sf_dir):
    """Dates written with month names of the five languages, in all documents, evaluation items and cases of whatever language."""
    ship(spark)
    found = G.named_dates_udf(G.locale_months(spark, ("en", "hi", "mr", "gu", "ur")))
    sources = (("documents", "doc_id", "text"), ("eval_items", "item_id", "text"), ("candidate_cases", "row_id", "facts"))
    parts = [_t(spark, sf_dir, name, key, text).where(F.col(text).isNotNull()).select(F.lit(name).alias("tbl"), F.col(key).alias("row_id"), F.explode(found(text)).alias("value")) for name, key, text in sources]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def eligible_cases(spark, sf_dir):
    """Dated, long enough cases of known stations that have no label and were not sent again."""
    cases = _t(spark, sf_dir, "candidate_cases", "row_id", "case_id", "station", "submitted_at", "facts")
    again = evaluation.repeated_keys(cases, "case_id")
    condition = F.col("station").isNotNull() & F.col("submitted_at").isNotNull() & (F.length("facts") >= 50)
    return validation.eligible(cases, condition, (_t(spark, sf_dir, "gold_labels", "case_id"), "case_id"), (again, "case_id")).select("row_id", "case_id")


def provisions_without_text(spark, sf_dir):
    """Labelled provisions that a mandatory join with the corpus would lose."""
    wanted = _t(spark, sf_dir, "gold_labels", "correct_top3_provisions").select(F.explode("correct_top3_provisions").alias("p")).select(F.concat_ws(" ", "p.code", "p.section").alias("provision")).distinct()
    known = _t(spark, sf_dir, "statute_supplements", "code", "section").where("section is not null").select(F.concat_ws(" ", "code", T.section_base("section")).alias("provision"))
    return validation.unmatched(wanted, known, "provision")


def aligned_deliveries(spark, sf_dir):
    """Records of the two codes with the same section, side by side in order: how many places each fills."""
    own = _t(spark, sf_dir, "statute_supplements", "row_id", "code", "section").where("section is not null")
    both = validation.aligned(own.where("code = 'IPC'"), own.where("code = 'BNS'"), "section", "row_id", "row_id")
    return both.groupBy("section").agg(F.count("row_id_a").alias("ipc"), F.count("row_id_b").alias("bns"), F.count("*").alias("places"))


def code_bounds(spark, sf_dir):
    return validation.bounds_kept(_t(spark, sf_dir, "statute_supplements", "code"), "code", {"IPC": 450, "BNS": 358, "CRPC": 1})


def lost_numbers(spark, sf_dir):
    """Numbers of `theft` that `injury` keeps and `cheating` loses."""
    own = _t(spark, sf_dir, "multilingual_completion", "row_id", "theft", "injury", "cheating").where("theft is not null and injury is not null and cheating is not null")
    return own.select("row_id", F.explode(validation.lost_cues(F.col("theft"), F.col("injury"), F.col("cheating"))).alias("cue"))


def doubtful_segments(spark, sf_dir):
    own = _t(spark, sf_dir, "events", "user_id", "event_id", "event_type", "value").where("value is not null and not isnan(value)")
    own = own.select("user_id", F.concat_ws(" ", "event_type", "event_id").alias("segment"), (F.col("value") / 100).alias("p"))
    return review.doubtful_segments(own, "user_id", "segment", "p").select("user_id", "text", F.round("p", 6).alias("p"), "rank")


def case_periods(spark, sf_dir):
    own = _dated(spark, sf_dir)
    return own.select("row_id", T.period(F.transform("dates", lambda d: d["value"]), F.col("offence")).alias("period"))


def escaped_titles(spark, sf_dir):
    return _t(spark, sf_dir, "statute_supplements", "row_id", "title").where("title is not null").select("row_id", T.escaped(F.concat(F.lit("<"), "title", F.lit("> & 'it'"))).alias("html"))


SPOKEN = (
    "Under section three seventy nine he paid five lakh twenty thousand rupees.", "on the twenty first of June two thousand twenty four", "IPC four twenty and BNS three oh two", "grievious hurt under the Bharatiya Nyay Sanhada",
    "the Indian Peenal Code and criminal breech of trust", "no one may march in May", "extorsion of mov able property", "the fifth of July, twenty twenty three", None, "",
)


def spoken_samples(spark, sf_dir):
    """Number words and the lexicon over a fixed table of transcripts, since the tables hold none."""
    ship(spark)
    own = spark.createDataFrame([(k, t) for k, t in enumerate(SPOKEN)], "id long, t string").withColumn("r", G.transcript_udf()("t"))
    return own.select("id", F.col("r.text").alias("text"), F.array_join(F.transform("r.corrections", lambda c: F.concat_ws(">", c["kind"], c["to"])), "|").alias("log"))


def checked_translations(spark, sf_dir):
    """Role, intent and offence checks over a fixed table of texts of ten languages and their English."""
    texts = [("hi", "आरोपी ने बेईमानी से चोरी की"), ("mr", "आरोपीने चोरी केली"), ("gu", "આરોપીએ બેઈમાનીથી"), ("bn", "অভিযুক্ত অসৎ"), ("ta", "குற்றம் சாட்டப்பட்ட நேர்மையற்ற"), ("te", "నిందిత నిజాయితీ లేకుండా"), ("kn", "ಆರೋಪಿ ಅಪ್ರಾಮಾಣಿಕ"), ("ml", "പ്രതി സത്യസന്ധതയില്ലാതെ"), ("pa", "ਦੋਸ਼ੀ ਬੇਈਮਾਨ"), ("ur", "ملزم بے ایمانی")]
    english = ["The accused and the defendant were dishonest.", "The accuser was killed.", "The accused took it."]
    own = spark.createDataFrame([(c, k, s, e) for c, s in texts for k, e in enumerate(english)], "language string, variant int, source string, english string")
    a = (F.col("source"), F.col("english"), F.col("language"))
    return own.select("language", "variant", C.role_changed(*a).alias("role_changed"), C.intent_lost(*a).alias("intent_lost"), F.coalesce(C.offence_flipped(*a), F.lit(False)).alias("flipped"))


def repaired_text(spark, sf_dir):
    """Page cleaning, letters set apart, dates run into words, acronyms and their log, over a fixed table."""
    rows = ["a\u00adb\r\n____\n\n\n12 THE GAZETTE OF X\nkept", "T H E F T of a B O A T", "on 5 July 2024he left, 2024-07-05 ના રોજ.", "आईपीसी 302 और बीएनएस 303", None]
    own = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "id long, t string")
    return own.select("id", T.cleaned_page("t").alias("page"), T.unspaced_letters("t").alias("letters"), T.spaced_dates("t").alias("dates"), T.acronyms("t").alias("acronyms"), F.array_join(F.transform(T.acronym_log("t"), lambda x: F.concat_ws(">", x["from"], x["to"])), "|").alias("log"))


def grounded_answers(spark, sf_dir):
    """Warnings of conclusions that name their statutes, or don't: for each case's best statutes and route."""
    cases = corpus.marked_latest(_t(spark, sf_dir, "candidate_cases", "case_id", "row_id", "facts"), "case_id", "latest", "row_id")
    routes, best = ranking.routed_and_ranked(cases, "row_id", "facts", "latest", _documents(spark, sf_dir))
    cited = best.where("section is not null").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("code", "section", F.lit(None).cast("string").alias("exception")))).alias("cited"), F.min_by(F.concat_ws(" ", "code", "section"), "rank").alias("first"))
    own = routes.join(cited, "qid", "left").withColumn("cited", F.coalesce("cited", F.array().cast("array<struct<code:string,section:string,exception:string>>")))
    review = F.when(F.col("route").isin("CLARIFY", "MULTI_PERIOD_REVIEW"), F.col("route"))
    warned = own.select(F.explode(C.grounding_warnings(F.concat(F.lit("This falls under "), F.coalesce("first", F.lit("nothing"))), F.col("cited"), review, F.array().cast("array<string>"))).alias("warning"))
    return warned.groupBy("warning").agg(F.count("*").alias("n"))


def label_metrics(spark, sf_dir):
    """Ratios of the ranked statutes against the labels, each over its own denominator: law, first provision, all and any of three, recall of three."""
    cases = _cases(spark, sf_dir)
    routes = case_routes(spark, sf_dir).join(cases.select("row_id", "case_id"), "row_id").select("case_id", "route")
    best = ranked_statutes(spark, sf_dir).join(cases.select("row_id", "case_id"), "row_id").join(_t(spark, sf_dir, "statute_supplements", F.col("row_id").alias("statute_row"), T.section_base("section").alias("section")), "statute_row")
    found = best.groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.concat_ws("-", "code", "section").alias("p")))), lambda x: x["p"]).alias("found"))
    gold = _t(spark, sf_dir, "gold_labels").groupBy("case_id").agg(F.max("applicable_law").alias("law"), F.max(F.concat_ws("-", "correct_top1_provision.code", "correct_top1_provision.section")).alias("first"), F.max(F.transform("correct_top3_provisions", lambda p: F.concat_ws("-", p["code"], p["section"]))).alias("three"))
    return evaluation.label_metrics(gold.join(routes, "case_id").join(found, "case_id", "left"), "route", "found", "law", "first", "three")


def rescored_pairs(spark, sf_dir):
    """Saved results against their fixtures by name and digest: what is missing on either side, and whether texts agree."""
    saved = _t(spark, sf_dir, "multilingual_completion", "row_id", F.col("theft").alias("t")).where("t is not null").select("row_id", F.sha2("t", 256).alias("digest"), "t")
    again = saved.where("row_id % 10 <> 0").select("row_id", "digest", F.trim("t").alias("t"))
    return evaluation.rescored(saved, again, ["row_id", "digest"], "t").groupBy("status").agg(F.count("*").alias("n"))


def checked_events(spark, sf_dir):
    """Events of each user within the allowed kinds, number and time."""
    own = _t(spark, sf_dir, "events", "user_id", "ts", "event_type")
    return intervals.event_faults(own, "user_id", "ts", "event_type", ("view", "purchase", "click", "signup", "error"), "2024-01-01 06:00:00", "2024-01-30 18:00:00", 70).groupBy("fault").agg(F.count("*").alias("users"))


def quiet_cuts(spark, sf_dir):
    """Where long signals are cut into windows: at the quietest frame near each window's end. The vectors stand for signals."""
    ship(spark)
    own = _t(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return own.select("vec_id", F.posexplode(G.quiet_cuts_udf(40, 16, 4, 4)("embedding")).alias("pos", "cut"))


def repaired_transcripts(spark, sf_dir):
    ship(spark)
    own = _t(spark, sf_dir, "documents", "doc_id", "text", "lang").where("lang = 'en'").withColumn("r", G.transcript_udf()("text"))
    return own.select("doc_id", F.length("r.text").alias("length"), F.size("r.corrections").alias("corrections"))


def streamed_windows(spark, sf_dir):
    """The hourly windows, by a stream."""
    events = stream.stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = stream.run(stream.windowed(events, "ts", ["event_type"], "1 hour", "400 days", value="value"), shared_folder(spark, "stream"), "complete")
    return out.select(F.unix_micros("w.start").alias("window_start"), "event_type", "n", "total")


def streamed_pairs(spark, sf_dir):
    """The event pairs, by a stream that carries state."""
    events = stream.stream(spark, f"{sf_dir}/events.parquet")
    out = stream.run(stream.paired(events, "user_id", "ts", "event_id", "event_type", "view", "purchase"), shared_folder(spark, "stream"))
    return out.select(F.col("key").alias("user_id"), "opened", "closed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query above by its name."""
    return {name: f for name, f in globals().items() if callable(f) and not name.startswith("_") and name != "queries" and name != "oracle_sql" and getattr(f, "__module__", "") == __name__}


def oracle_sql() -> dict[str, str]:
    from lexloom.sql import oracle_sql as sql

    return sql()
