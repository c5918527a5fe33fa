"""Scored retrieval whole: tokens, references, a table of rules, and the ranks that references and the primary code have before the score.

A query's facts are columns; rules are rows of a table (what must be seen, which provision, on which routes, how many points). A query meets
a document by a shared token, a reference or a rule; what these give is added up, in blocks of documents, before anything is ranked (`blocks`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexloom.functions import dates as D
from lexloom.functions import text as T
from lexloom.functions import words
from lexloom.operators import retrieval
from lexloom.plans import blocks
from lexloom.session import cut

EXACT, MAPPED, PRIMARY, BOTH = 50.0, 30.0, 2.0, 1.0
#: Codes that a route allows, the primary one first.
ALLOWED = {"IPC_ONLY": ("IPC",), "BNS_PRIMARY": ("BNS", "IPC"), "MULTI_PERIOD_REVIEW": ("IPC", "BNS"), "CLARIFY": ()}

# Fixed values: (cue, provision, routes, points, whether a cited section turns it off); P, N and M are the routes before, after and across the cutoff.
RULES = (
    ("retained theft", "ipc-378 ipc-379 bns-303", "PNM", 30, False), ("theft", "ipc-378", "PM", 35, False), ("theft", "ipc-379", "PM", 40, False), ("theft", "bns-303", "NM", 35, False),
    ("retention", "ipc-403 bns-314", "PNM", 35, False), ("death", "ipc-299 ipc-300 bns-100 bns-101", "PNM", 35, True), ("stalking", "ipc-354d bns-78", "PNM", 35, True),
    ("cheating", "bns-318", "NM", 35, False), ("cheating", "ipc-420", "PM", 35, False), ("cheating", "ipc-415", "PM", 25, False),
    ("grievous hurt", "bns-117", "NM", 45, True), ("grievous hurt", "bns-116", "NM", 38, True), ("grievous hurt", "ipc-322", "PM", 45, True), ("grievous hurt", "ipc-320", "PM", 38, True), ("grievous hurt", "ipc-325", "PM", 35, True),
    ("serious hurt", "bns-117", "NM", 24, True), ("serious hurt", "bns-116", "NM", 20, True), ("serious hurt", "ipc-322", "PM", 24, True), ("serious hurt", "ipc-320", "PM", 20, True),
    ("hurt", "bns-115", "NM", 40, True), ("hurt", "bns-114", "NM", 36, True), ("hurt", "bns-117", "NM", 26, True), ("hurt", "bns-116", "NM", 22, True),
    ("hurt", "ipc-321", "PM", 40, True), ("hurt", "ipc-319", "PM", 36, True), ("hurt", "ipc-322", "PM", 26, True), ("hurt", "ipc-320", "PM", 22, True), ("hurt", "ipc-323", "PM", 25, True),
)
# Groups of vocabulary words and of phrase labels that the cues are made of.
GROUPS = {
    "taking": "stolen take took taking taken takes moved moves", "stealing": "steal steals stealing stole", "dishonesty": "dishonest dishonestly",
    "deceit": "deceive deceived deceiving deception deceptive trick tricked cheated defraud defrauded defrauding defrauds", "fraud": "fraud fraudulent fraudulently", "bad faith": "dishonest dishonestly unjustly unfairly unfaithfully treasonfully disloyalty",
    "inducing": "induce induced induces inducement", "handing over": "deliver delivered delivering delivers delivery give gave giving hand handed transfer transferred transferring transfers sell sold selling",
    "harm": "hurt hurts injure injured injures injury injuries wound wounded bodily pain", "gravity": "serious seriously",
}
LABELS = {
    "property": ("movable property", "mobile phone", "phone property"), "possession": ("out of possession", "from possession"), "consent": ("without consent", "without permission"), "deceived": ("deceived person", "tricked person", "deceived into property transfer"),
    "induced": ("dishonestly induced", "led to property transfer", "deceived into property transfer"), "delivered": ("deliver property", "give property", "hand over property", "transfer property", "sell property", "delivery of property"),
    "harmed": ("seriously injured", "serious injury", "caused hurt", "caused injury", "physical injury", "physical harm", "bodily pain"), "seriously": ("seriously injured", "serious injury"),
}
RETAINED = r"(?s)\b(?:kept|keep|retained|left)\b.{0,100}\b(?:with\s+(?:him|her|them)|(?:own|his|her|their)\s+possession)\b"
REPORTED = r"\A(?:20[0-9]{2}[-/.][0-9]{1,2}[-/.][0-9]{1,2}\s+)?(?:it\s+(?:was|is)\s+)?stolen[.!?\s]*\z"
DEATH = r"\b(?:caus(?:e|ed|es|ing)\b.{0,80}\bdeath|kill(?:ed|ing|s)?\b.{0,40}\b(?:person|man|woman|him|her))"
MEANT, DENIED = r"\b(?:intentionally|deliberately|intention\s+(?:of|to))\b", r"\b(?:not|never|didn't|did\s+not)\s+(?:(?:intentionally|deliberately)\s+)?(?:cause|caused|kill|killed)\b"
FOLLOWED, UNWANTED = r"\b(?:follow(?:s|ed|ing)?|contact(?:s|ed|ing)?)\b", r"\b(?:unwanted|disinterest|unwelcome|despite\b.{0,30}\b(?:refusal|refused)|without\s+consent)\b"
AGAIN, WATCHED = r"\b(?:repeated(?:ly)?|persistent(?:ly)?|again\s+and\s+again)\b", r"\bmonitor(?:s|ed|ing)?\b.{0,80}\b(?:electronic|internet|e-?mail|communication)\b"


def cues(text: Column, keywords: Column, phrases: Column, route: Column) -> Column:
    """Array of the cues that a text gives, of `RULES`' names. keywords, phrases: what `text.vocabulary_hits` and `text.phrase_labels` found."""
    said = lambda *groups: F.arrays_overlap(keywords, T.literals(w for g in groups for w in GROUPS[g].split()))
    told = lambda *groups: F.arrays_overlap(phrases, T.literals(p for g in groups for p in LABELS[g]))
    word = lambda w: F.array_contains(keywords, w)
    low = F.lower(F.coalesce(text, F.lit("")))
    sentences = F.split(low, "[.!?]")
    retained = F.array_contains(phrases, "phone property") & told("consent") & ~said("taking", "stealing") & low.rlike(RETAINED)
    owned = told("property") | word("property")
    theft = word("theft") | retained | F.trim(low).rlike(REPORTED) | F.array_contains(phrases, "victim property stolen") | owned & (said("stealing") | told("consent") & (said("taking", "dishonesty") | told("possession")))
    handed = said("handing over") | told("delivered")
    moved = handed | F.arrays_overlap(phrases, T.literals(("deceived into property transfer", "led to property transfer")))
    misled = said("deceit") | told("deceived")
    concept = (misled | said("fraud")) & (word("property") | moved) & (moved | said("bad faith"))
    given = handed | word("property")
    cheating = word("cheating") | concept | misled & given & ((route == "MULTI_PERIOD_REVIEW") | said("bad faith", "fraud") & (said("inducing") | told("induced")))
    grievous, serious = word("grievous") | F.array_contains(phrases, "grievous hurt"), said("gravity") | told("seriously")
    harmed = grievous | serious | said("harm") | told("harmed")
    death = F.exists(sentences, lambda s: s.rlike(DEATH) & s.rlike(MEANT) & ~s.rlike(DENIED))
    stalking = F.exists(sentences, lambda s: s.rlike(FOLLOWED) & s.rlike(UNWANTED) & s.rlike(AGAIN) | s.rlike(WATCHED) & (s.rlike(UNWANTED) | s.rlike(AGAIN)))
    found = (("retained theft", theft & retained), ("theft", theft), ("retention", retained), ("death", death), ("stalking", stalking), ("cheating", cheating), ("grievous hurt", grievous), ("serious hurt", serious), ("hurt", harmed))
    return F.array_compact(F.array(*(F.when(condition, name) for name, condition in found)))


def rule_table(spark: SparkSession) -> DataFrame:
    """`cue`, `family`, `order`, `code`, `section`, `route`, `points`, `cited_off`: the rules, one provision and route a row."""
    routes = {"P": "IPC_ONLY", "N": "BNS_PRIMARY", "M": "MULTI_PERIOD_REVIEW"}
    rows = []
    for order, (cue, provisions, where, points, off) in enumerate(RULES):
        for provision in provisions.split():
            code, section = provision.upper().split("-")
            rows += [(cue, cue.rpartition(" ")[2], order, code, section, routes[r], float(points), off) for r in where]
    return spark.createDataFrame(rows, "cue string, family string, order int, code string, section string, route string, points double, cited_off boolean")


def _found(queries: DataFrame, query_id: str, text: str, asked: Column) -> DataFrame:
    """`qid`, `t`, `keywords`, `phrases`, `refs`, `route`, `asked` of each query; what is costly to find only where asked, which may name `route`."""
    own = queries.withColumn("qid", F.col(query_id)).withColumn("t", F.col(text)).withColumn("dates", D.dates("t")).withColumn("going_on", D.continuing("t")).withColumn("offence", D.offence_date("t", F.col("dates")))
    own = own.withColumn("route", D.period_route(F.col("dates"), F.col("going_on"), F.col("offence"))).withColumn("asked", asked)
    wanted = lambda c: F.when(F.col("asked"), c)  # noqa: E731  # a filter here would make the dates again for each mention of them
    own = own.select("qid", wanted(F.col("t")).alias("t"), wanted(T.vocabulary_hits("t")).alias("keywords"), wanted(T.phrase_labels("t")).alias("phrases"), wanted(T.section_references("t")).alias("refs"), "route", "asked")
    return cut(own)  # what follows is cheap and read several times; a filter on it must not search the texts again


def _facts(found: DataFrame) -> DataFrame:
    allowed = F.element_at(F.create_map(*(x for r, codes in ALLOWED.items() for x in (F.lit(r), F.array(*map(F.lit, codes)).cast("array<string>")))), F.col("route"))
    own = found.drop("asked").withColumn("allowed", allowed).withColumn("primary", F.get("allowed", F.lit(0)))
    return own.withColumn("cues", cues(F.col("t"), F.col("keywords"), F.col("phrases"), F.col("route")))


def facts(queries: DataFrame, query_id: str, text: str, routed: bool = False) -> DataFrame:
    """`qid`, `t`, `keywords`, `phrases`, `refs`, `route`, `allowed`, `primary`, `cues` of each query; routed: of those with a route only."""
    return _facts(_found(queries, query_id, text, F.col("route") != "CLARIFY" if routed else F.lit(True)).where("asked"))


def ranked(queries: DataFrame, query_id: str, text: str, docs: DataFrame, k: int = 3) -> DataFrame:
    """`qid`, `doc`, `code`, `section`, `score`, `cited`, `rank`: the k best documents (row_id, code, section, title, text, keywords, maps_to) of each query."""
    return _ranked(facts(queries, query_id, text, routed=True), docs, k)  # a query without a route has no result


def routed_and_ranked(queries: DataFrame, query_id: str, text: str, asked: str, docs: DataFrame, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """`qid`, `route` of all queries, and what `ranked` gives those of which the column `asked` is true; the texts are searched once."""
    found = _found(queries, query_id, text, F.col(asked) & (F.col("route") != "CLARIFY"))
    return found.select("qid", "route"), _ranked(_facts(found.where("asked")), docs, k)


def _ranked(asked: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    searched = F.concat_ws(" ", "t", F.array_join("keywords", " "), F.array_join("phrases", " "), F.array_join(F.transform("refs", lambda r: r["section"]), " "))
    seen = asked.select("qid", "route", (F.size("refs") > 0).alias("has_refs"), F.explode_outer("cues").alias("cue")).where("cue is not null")
    met = seen.join(F.broadcast(rule_table(docs.sparkSession)), ["cue", "route"]).where("not (cited_off and has_refs)")
    first = Window.partitionBy("qid", "family", "code", "section").orderBy("order")
    met = met.withColumn("n", F.row_number().over(first)).where("n = 1").groupBy("qid").agg(F.collect_list(F.struct("code", "section", "points")).alias("points"))
    tokens = lambda c: F.array_join(F.array_distinct(T.retrieval_tokens(c)), " ")
    wanted = asked.select("qid", "route", "primary", F.array_distinct("refs").alias("refs"), tokens(searched).alias("words")).join(met, "qid", "left")
    names = F.transform(F.coalesce("maps_to", F.array().cast("array<string>")), lambda m: F.element_at(F.split(m, "-r"), 1))
    body = F.concat_ws(" ", F.col("section"), F.col("title"), F.col("text"), F.array_join("keywords", " "))
    where = docs.select(F.col("row_id").alias("doc"), "code", F.upper("section").alias("section"), tokens(body).alias("words"), tokens("title").alias("title"), names.alias("maps"))
    points = {"title": retrieval.TITLE_BONUS, "exact": EXACT, "mapped": MAPPED, "primary": PRIMARY, "both": BOTH}
    full = blocks.best(wanted, where, retrieval.idf, k, points, ALLOWED).repartition("qid")
    full = full.withColumn("first_code", ((F.col("route") == "BNS_PRIMARY") & (F.col("code") == "BNS")).cast("int"))
    own = (F.col("cited").desc(), F.col("first_code").desc(), F.col("score").desc(), "doc")
    best = F.row_number().over(Window.partitionBy("qid", "code").orderBy(*own)) == 1
    full = full.withColumn("lead", (best & (F.col("route") == "MULTI_PERIOD_REVIEW")).cast("int"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("lead").desc(), F.when(F.col("lead") == 1, F.col("code") != F.col("primary")), *own))
    return full.withColumn("rank", place).where(F.col("rank") <= k).select("qid", "doc", "code", "section", "score", "cited", "rank")
