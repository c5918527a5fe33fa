"""Text as column expressions; nothing here leaves the JVM. Null in gives null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import words

Col = str | Column


def _c(x: Col) -> Column:
    return F.col(x) if isinstance(x, str) else x


def literals(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def retrieval_tokens(text: Col) -> Column:
    """Lower-case runs of a-z and 0-9 without single characters, stop-words and numbers of up to four digits; null gives none."""
    parts = F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(_c(text), F.lit(""))), "[^a-z0-9]+", " ")), " ")
    return F.filter(parts, lambda t: (F.length(t) > 1) & ~t.isin(*words.RETRIEVAL_STOP) & ~t.rlike("^[0-9]{1,4}$"))


def excerpt(text: Col, tokens: Column, size: int = 560) -> Column:
    """A window from 80 characters before the first occurrence of a token of over 3 letters; a short text whole."""
    text = _c(text)
    at = F.array_min(F.filter(F.transform(F.filter(tokens, lambda t: F.length(t) > 3), lambda t: F.position(t, F.lower(text))), lambda p: p > 0))
    start = F.greatest(F.lit(1), F.coalesce(at, F.lit(1)) - 80)
    cut = F.concat(F.when(start > 1, "...").otherwise(""), F.trim(F.substring(text, start, F.lit(size))), F.lit("..."))
    return F.when(F.length(text) <= size, text).otherwise(cut)


def tidy(text: Col) -> Column:
    """Without invisible characters and controls, with single spaces and none before punctuation."""
    out = F.regexp_replace(_c(text), r"[\x{200B}\x{200E}\x{200F}\x{2060}\x{FEFF}]", "")
    out = F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", " ")
    out = F.regexp_replace(out, r"[ \t\x{00A0}]+", " ")
    return F.trim(F.regexp_replace(out, r"\s+([,.;:!?।۔])", "$1"))


def ascii_digits(text: Col) -> Column:
    """Digits of other scripts as ASCII digits, character by character."""
    source = "".join(chr(b + k) for b in words.DIGIT_BLOCKS for k in range(10))
    return F.translate(_c(text), source, "0123456789" * len(words.DIGIT_BLOCKS))


def acronyms(text: Col) -> Column:
    """Acronyms written in other scripts or letter by letter, as their Latin form."""
    out = _c(text)
    for short, forms in words.ACRONYMS:
        out = F.regexp_replace(out, r"(?<![\p{L}\p{M}])(?:" + "|".join(f.replace(".", r"\.") for f in forms) + r")(?![\p{L}\p{M}])", short)
    for short in ("BNSS", "BNS", "IPC"):
        out = F.regexp_replace(out, r"(?i)(?<![A-Za-z0-9_])" + r"[\s.]+".join(short) + r"(?![A-Za-z0-9_])", short)
    return out


def acronym_log(text: Col) -> Column:
    """Array of (from, to) of what `acronyms` changes: the spellings that a text has, in the rules' order."""
    out = []
    for short, forms in words.ACRONYMS:
        found = F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(r"(?<![\p{L}\p{M}])(?:" + "|".join(f.replace(".", r"\.") for f in forms) + r")(?![\p{L}\p{M}])"), F.lit(0))
        out.append(F.arrays_zip(found.alias("from"), F.array_repeat(F.lit(short), F.size(found)).alias("to")))
    return F.concat(*out)


def unspaced_letters(text: Col) -> Column:
    """Capitals that were set apart ("T H E F T") as one word; three letters or more."""
    return F.regexp_replace(_c(text), r"(?<=(?<![A-Za-z])[A-Z]) (?=[A-Z](?![A-Za-z]) [A-Z](?![A-Za-z]))|(?<=(?<![A-Za-z])[A-Z] [A-Z]) (?=[A-Z](?![A-Za-z]))", "")


def cleaned_page(text: Col) -> Column:
    """Page text without soft hyphens, carriage returns, ruled lines and gazette heads, with at most one blank line."""
    out = F.regexp_replace(_c(text), "[\u00ad\r]", "")
    for line in (r"_+", r"\s*[0-9]+\s+THE\s+GAZETTE.+", r"\s*Sec\.\s*1\].+"):
        out = F.regexp_replace(out, f"(?mi)^{line}$", "")
    return F.trim(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def spaced_dates(text: Col) -> Column:
    """A space where a written date runs into the next word; and none of the connectives that other languages put behind an ISO date."""
    out = F.regexp_replace(_c(text), r"\b([0-3]?[0-9]\s+(?:January|February|March|April|May|June|July|August|September|October|November|December),?\s+20[0-9]{2})(?=[A-Za-z])", "$1 ")
    for connective in (r"ના\s+રોજ", "ರಂದು"):
        out = F.regexp_replace(out, rf"\b(20[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}})\s+{connective}(?=\s|[।,.!?]|$)", "$1 ")
    return out


def has_word(text: Col, word: str) -> Column:
    """Whether a lower-case text has the word with neither letter nor digit beside it."""
    return _c(text).rlike(rf"(^|[^a-z0-9]){word}([^a-z0-9]|$)")


def vocabulary_hits(text: Col) -> Column:
    """The words of the vocabulary that a text has, in the vocabulary's order. One pass over the text, not one per word."""
    found = F.split(F.regexp_replace(F.lower(F.coalesce(_c(text), F.lit(""))), "[^a-z0-9]+", " "), " ")
    return F.array_intersect(literals(words.VOCABULARY), found)


def phrase_labels(text: Col) -> Column:
    """Labels of the phrases that a text has, in the rules' order."""
    low = F.lower(F.coalesce(_c(text), F.lit("")))
    return F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(label)) for label, p in words.PHRASES)))


def section_references(text: Col) -> Column:
    """Array of (code, section) of "ipc 302", "bns section 103" and "section 379", in upper case, repeats kept; code is null where none stands."""
    pattern = r"(?i)\b(?:(ipc|bns)\s*(?:section\s*)?|section\s+)([0-9]{1,3}[a-z]{0,3})\b"
    text = F.coalesce(_c(text), F.lit(""))
    codes, sections = F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.transform(F.arrays_zip(codes.alias("c"), sections.alias("s")), lambda x: F.struct(F.when(x["c"] != "", F.upper(x["c"])).alias("code"), F.upper(x["s"]).alias("section")))


def collapse(text: Col) -> Column:
    return F.regexp_replace(F.regexp_replace(_c(text), r"\s+", " "), r"^[ .\-]+|[ .\-]+$", "")


def derived_title(text: Col) -> Column:
    """The first 14 words of the first sentence, without closing punctuation."""
    first = F.regexp_replace(collapse(text), r"^(.*?[.;:])\s.*$", "$1")
    title = F.regexp_replace(F.array_join(F.slice(F.split(first, " "), 1, 14), " "), r"[.,;:]+$", "")
    return F.when(F.coalesce(title, F.lit("")) == "", F.lit("Statutory provision")).otherwise(title)


def section_base(section: Col) -> Column:
    return F.nullif(F.regexp_extract(F.regexp_replace(_c(section), " ", ""), r"^[0-9]{1,3}[A-Z]*", 0), F.lit(""))


def keyword_words(title: Col, text: Col) -> Column:
    found = F.regexp_extract_all(F.lower(F.concat_ws(" ", F.coalesce(_c(title), F.lit("")), F.coalesce(_c(text), F.lit("")))), F.lit("[a-z][a-z-]{3,}"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*words.KEYWORD_STOP))


TOKEN = r"[\p{L}\p{M}\x{200C}\x{200D}]+(?:['’][\p{L}\p{M}]+)?|\p{N}+(?:[.,:/-]\p{N}+)*|[^\s\p{L}\p{M}\p{N}]"


def tokens(text: Col) -> Column:
    """Array of words (with their marks), numbers and single punctuation marks."""
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(TOKEN), F.lit(0))


def token_kind(token: Col) -> Column:
    return F.when(_c(token).rlike(r"^\p{N}"), "number").when(_c(token).rlike(r"^[\p{L}\p{M}\x{200C}\x{200D}]"), "word").otherwise("punct")


def script(text: Col) -> Column:
    """The first of Gujarati, Arabic, Devanagari and Latin script that a text has."""
    out = F
    for name, block in words.SCRIPT_BLOCKS:
        out = out.when(_c(text).rlike(block), name)
    return out.otherwise("other")


def is_stop(word: Col) -> Column:
    return F.lower(_c(word)).isin(*words.ENGLISH_STOP)


def is_negation(word: Col) -> Column:
    return F.lower(_c(word)).isin(*words.ENGLISH_NEGATIONS)


def stem(word: Col) -> Column:
    """One suffix, the longest that leaves three letters, taken off an English content word; words of up to four letters stay."""
    w = _c(word)
    low = F.lower(w)
    out = F.when((F.length(w) <= 4) | is_stop(w) | is_negation(w), w)
    for suffix in words.ENGLISH_SUFFIXES:
        out = out.when(low.endswith(suffix) & (F.length(low) - len(suffix) >= 3), F.substring(low, F.lit(1), F.length(low) - len(suffix)))
    return out.otherwise(low)


def language_code(label: Col) -> Column:
    return F.lower(F.element_at(F.split(_c(label), "-"), 1))


def number_literals(text: Col) -> Column:
    """Number literals in order, digits of any script as ASCII."""
    return F.regexp_extract_all(ascii_digits(F.coalesce(_c(text), F.lit(""))), F.lit(r"[0-9]+(?:[.,][0-9]+)*"), F.lit(0))


def same_numbers(a: Col, b: Col) -> Column:
    """Whether two texts have the same number literals, each as often."""
    return F.array_sort(number_literals(a)) == F.array_sort(number_literals(b))


def letters_only(text: Col) -> Column:
    return F.regexp_replace(F.lower(_c(text)), "[^a-z]", "")


def skeleton(text: Col) -> Column:
    return F.regexp_replace(letters_only(text), "[aeiouy]", "")


def similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def phrase_similarity(a: Col, b: Col) -> Column:
    """The better of the similarities of the letters and of the consonants."""
    return F.greatest(similarity(letters_only(a), letters_only(b)), similarity(skeleton(a), skeleton(b)))


def speech_form(text: Col, variant: str = "spaced") -> Column:
    """Lower-case text for edit rates: punctuation and symbols become spaces ("spaced"), or vanish ("deleted"), or only a-z stay ("letters")."""
    low = F.lower(F.coalesce(_c(text), F.lit("")))
    if variant == "letters":
        return F.regexp_replace(low, "[^a-z]", "")
    out = F.regexp_replace(low, r"[\p{P}\p{S}]", " " if variant == "spaced" else "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


#: Normal form and steps of each variant of words for edit rates: what is deleted, and what becomes a space.
SPEECH = {"report": ("NFC", "", r"[\p{P}\p{S}\p{Cf}]"), "study": ("NFC", r"\p{P}", ""), "public": ("NFKC", "", r"[\p{P}\p{S}\p{Cf}]"), "legacy": ("", r"[^\p{L}\p{M}\p{N}_\s]", "")}


def speech_words(text: Col, variant: str = "public") -> Column:
    """Array of lower-case words of a text in its variant's normal form; null gives none."""
    _, deleted, spaced = SPEECH[variant]
    out = F.lower(F.coalesce(_c(text), F.lit("")))
    out = F.regexp_replace(out, deleted, "") if deleted else out
    out = F.regexp_replace(out, spaced, " ") if spaced else out
    return F.filter(F.split(F.trim(F.regexp_replace(out, r"\s+", " ")), " "), lambda w: w != "")


def word_edits(reference: Column, hypothesis: Column) -> Column:
    """Edits between two arrays of words: each distinct word of both becomes one character of its own, then strings are compared."""
    known = F.array_distinct(F.concat(reference, hypothesis))
    one = lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, w) + 0xFFFF), 8, "0")), "UTF-32")
    return F.levenshtein(F.array_join(F.transform(reference, one), ""), F.array_join(F.transform(hypothesis, one), ""))


def escaped(text: Col) -> Column:
    """Text safe inside HTML."""
    out = _c(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def period(values: Column, offence: Column) -> Column:
    """The offence date, or the span of the dates, or that there is none."""
    span = F.when(F.size(values) > 1, F.concat(F.array_min(values), F.lit(" to "), F.array_max(values)))
    return F.coalesce(offence, span, F.lit("an unspecified date"))


def media_type(header: Col) -> Column:
    return F.lower(F.trim(F.element_at(F.split(_c(header), ";"), 1)))


def detection_status(p: Column, supported: Column) -> Column:
    return F.when(~supported, "unsupported").when(p >= 0.8, "detected").otherwise("uncertain")


def relative_path(path: Col) -> Column:
    """A path with forward slashes and without a leading "./"."""
    return F.regexp_replace(F.replace(_c(path), F.lit("\\"), F.lit("/")), r"^(\./)+", "")
