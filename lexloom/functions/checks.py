"""Checks of texts against each other and of measurements, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions import text as T

# Words by which ASCII text counts as English, the scripts of languages, and words for a role and for dishonesty.
ENGLISH_MARKERS = r"(?i)\b(?:the|on|of|a|person|theft|cheating|offence|offense|happened|property|under|consent|law|act|IPC|BNS)\b"
SCRIPTS = {"hi": "0900-097F", "mr": "0900-097F", "gu": "0A80-0AFF", "bn": "0980-09FF", "ta": "0B80-0BFF", "te": "0C00-0C7F", "kn": "0C80-0CFF", "ml": "0D00-0D7F", "pa": "0A00-0A7F", "ur": "0600-06FF"}
ACCUSED = {"hi": "आरोपी|अभियुक्त", "mr": "आरोपी", "gu": "આરોપી", "bn": "অভিযুক্ত", "ta": r"குற்றம்\s*சாட்டப்பட்ட", "te": "నిందిత", "kn": "ಆರೋಪಿ", "ml": "പ്രതി", "pa": "ਦੋਸ਼ੀ", "ur": "ملزم"}
DISHONEST = {"hi": "बेईमान", "mr": "अप्रामाणिक", "gu": "બેઈમાન", "bn": "অসৎ", "ta": "நேர்மையற்ற", "te": r"నిజాయితీ\s*లేకుండా", "kn": "ಅಪ್ರಾಮಾಣಿಕ", "ml": "സത്യസന്ധതയില്ലാതെ", "pa": "ਬੇਈਮਾਨ", "ur": r"بے\s*ایمانی"}
# What alone is English, and words of theft and of killing.
LONE_ENGLISH = r"(?i)\A(?:theft|cheating|(?:IPC|BNS)\s+(?:Section\s+)?[0-9]{1,3}[A-Za-z]*(?:\([0-9]+\))?)\z"
THEFT, KILLING, ENGLISH_KILLING = r"(?<!\p{L})चोरी(?:ला|ची|चा|चे|च्या|ने)?(?!\p{L})", r"(?<!\p{L})(?:हत्या|खून|ख़ून)(?!\p{L})", r"(?i)\b(?:murder|homicide|kill(?:ed|ing)?)\b"


def english_like(text: Column) -> Column:
    """ASCII text with two marker words, or a lone offence or reference."""
    return text.rlike(LONE_ENGLISH) | text.rlike(r"\A[\x00-\x7F]*\z") & (F.regexp_count(text, F.lit(ENGLISH_MARKERS)) >= 2)


def expected_script(text: Column, language: Column) -> Column:
    """Whether a text has a character of its language's script; English has none but ASCII; null for languages not listed."""
    out = F.when(language == "en", text.rlike(r"\A[\x00-\x7F]*\z"))
    for code, block in SCRIPTS.items():
        low, high = block.split("-")
        out = out.when(language == code, text.rlike(rf"[\x{{{low}}}-\x{{{high}}}]"))
    return out


def role_changed(source: Column, target: Column, language: Column) -> Column:
    """Whether an English target names the accused more often than the source, or not at all but an accuser."""
    count = F.lit(0)
    for code, pattern in ACCUSED.items():
        count = F.when(language == code, F.regexp_count(source, F.lit(pattern))).otherwise(count)
    named = F.regexp_count(target, F.lit(r"(?i)\b(?:accused|defendant)\b"))
    return (count > 0) & ((named > count) | ((named == 0) & target.rlike(r"(?i)\baccuser\b")))


def intent_lost(source: Column, target: Column, language: Column) -> Column:
    """Whether a source's word for dishonesty has no counterpart in an English target."""
    has = F.lit(False)
    for code, pattern in DISHONEST.items():
        has = F.when(language == code, source.rlike(pattern)).otherwise(has)
    return has & ~target.rlike(r"(?i)\b(?:dishonest|fraud|unjust|unfair|disloyal|unfaithful)|without\s+(?:being\s+)?honest")


def offence_flipped(source: Column, target: Column, language: Column) -> Column:
    """Whether a Hindi or Marathi source that tells of theft only has become a killing in an English target."""
    return language.isin("hi", "mr") & source.rlike(THEFT) & ~source.rlike(KILLING) & target.rlike(ENGLISH_KILLING)


def grounding_warnings(conclusion: Column, cited: Column, review: Column, notes: Column) -> Column:
    """Array of what a conclusion lacks. cited: array of (code, section, exception) of what was retrieved; review: the route's message, null if none;
    notes: further messages that the facts call for. A section is named if its text occurs, so that "3" is named by "303"."""
    low = F.lower(conclusion)
    named = F.exists(cited, lambda c: F.contains(low, F.lower(c["code"])) & F.contains(low, F.lower(c["section"])))
    own = F.array(F.when((F.size(cited) > 0) & ~named, "no retrieved section is named"), review, F.when(F.size(cited) == 0, "nothing was retrieved"))
    exceptions = F.transform(F.filter(cited, lambda c: c["exception"].isNotNull()), lambda c: F.concat_ws(" ", c["code"], F.concat(c["section"], F.lit(":")), c["exception"]))
    return F.concat(F.array_compact(own), exceptions, F.coalesce(notes, F.array().cast("array<string>")))


def invented_numbers(source: Column, target: Column) -> Column:
    """Number literals of a target that its source lacks."""
    return F.array_except(T.number_literals(target), T.number_literals(source))


def invented_words(source: Column, target: Column, words: tuple[str, ...]) -> Column:
    """Of given words (weekdays, for one), those that a target has and its source lacks."""
    return F.array_compact(F.array(*(F.when(T.has_word(F.lower(target), w) & ~T.has_word(F.lower(source), w), F.lit(w)) for w in words)))


def markup(text: Column) -> Column:
    return text.rlike(r"(?m)\*\*|__|`|[\[\]\r\n]|^\s*(?:#{1,6}\s|[-+*]\s|\d+[.)]\s)")


def bounded_exp(mean_log: Column) -> Column:
    """exp of a mean log-probability kept within -10 and 0, three decimals."""
    return F.round(F.exp(F.greatest(F.lit(-10.0), F.least(F.lit(0.0), mean_log))), 3)


def step_bound(most: Column, prompt: Column) -> Column:
    return F.least(F.floor(most / 2), most - prompt + 1)


def window_risk(tokens: Column, bound: Column, ending: Column, silence: Column, mean_log: Column, ratio: Column) -> Column:
    """A window's risk: at its bound without an ending token; with the evidence that supports it."""
    at_bound = (F.size(tokens) >= bound) & ~F.array_contains(tokens, ending)
    evidence = F.array_compact(F.array(F.when(silence > 0.6, "silence"), F.when(mean_log < -1.0, "low probability"), F.when(ratio > 2.4, "repetition")))
    return F.struct(F.coalesce(at_bound, F.lit(False)).alias("at_risk"), evidence.alias("evidence"))


def skipped(silence: Column, mean_log: Column, floor: float | None, threshold: float | None) -> Column:
    """Whether a decoder would skip a segment; a threshold of None is off."""
    quiet = silence > floor if floor is not None else F.lit(False)
    return quiet & (~(mean_log > threshold) if threshold is not None else F.lit(True))


def stripped_markers(tokens: Column, markers: tuple[int, ...]) -> Column:
    """An integer array without its terminal markers."""
    n = F.size(tokens)
    keep = F.coalesce(F.array_max(F.transform(tokens, lambda t, i: F.when(~t.isin(*markers), i + 1))), F.lit(0))
    return F.when(n > 0, F.slice(tokens, F.lit(1), keep)).otherwise(tokens)


def rising(values: Column) -> Column:
    """Whether an array strictly rises."""
    return ~F.exists(F.zip_with(F.slice(values, F.lit(1), F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0))), lambda a, b: a >= b), lambda x: x)


def close(a: Column, b: Column, by: float = 1e-9) -> Column:
    return F.abs(a - b) <= by
