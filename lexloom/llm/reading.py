"""Problem 9: how demanding a text is to read.

Gradient-boosted regression trees, fitted here in numpy on labelled documents, over distributions of lengths, vocabulary, syntax and
cohesion. Grades are cross-validated by source: every fold leaves whole sources out, and its predictions place the cuts between the bands
and measure the accuracy. Labels that the folds contradict by far (wrong labels) leave the final fit.

Labels are English. `levels` grades texts in English; `every_level` grades texts of all languages and lengths and flags those that the labels
don't speak for. Texts in other languages are graded by a second model, fitted on the same labels over the features that don't depend on
English (lengths of sentences, vocabulary, commas, cohesion) alone.

Defined results: null texts give no row, and in `levels` neither do texts under `least` words; a text without a word has no grade; a text of any
length is read whole; a missing or unknown label is not used; repeated rows give repeated results; an empty table gives an empty table; fewer
than MIN_LABELS usable labels is an error.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm import base

BANDS = ("basic", "middle", "advanced")
LEAST_WORDS = 60
#: Labelled documents used to fit at most; which of more is decided by a hash of the id.
MAX_LABELS, MIN_LABELS = 4000, 6
TREES, DEPTH, RATE, BINS, FOLDS, LEAF = 60, 3, 0.15, 32, 5, 3

WORD = regex.compile(r"\p{L}+(?:['’-]\p{L}+)*")
END = regex.compile(r"[.!?]+[\"'”’)\]]*(?:\s+|$)|\n+")
# Words and sentence ends of any script; where words aren't spaced, about as many characters as they have on average count as one.
ANY_WORD = regex.compile(r"\p{Han}{1,2}|[\p{Hiragana}\p{Katakana}ー]{1,3}|[\p{Thai}--\p{N}]{1,5}|[\p{L}\p{M}\u200c\u200d--\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]+(?:['’-][\p{L}\p{M}]+)*", regex.V1)
ANY_END = regex.compile(r"[.!?]+[\"'”’)\]]*(?:\s+|$)|[।॥۔؟。！？]+[\"'”’)\]」』]*\s*|\n+")
COMMA, SEMICOLON = regex.compile("[,،、，]"), regex.compile("[;؛；]")
LATIN, LETTER = regex.compile(r"\p{Latin}"), regex.compile(r"\p{L}")
VOWELS = regex.compile(r"[aeiouy]+")
# Function words by what they do in a sentence.
LINKS = frozenset("because although though while whereas since unless until if when before after so but however moreover therefore thus hence notwithstanding inasmuch insofar considering whereby wherein".split())
PRONOUNS = frozenset("i you he she it we they me him her us them his hers its their this that these those who whom which".split())
BASIC_VERBS = frozenset("is was are were be been has had have do did does can could may might must shall should will would".split())
NOMINAL = regex.compile(r"(?:tion|sion|ment|ness|ity|ance|ence|ency|ancy|ism|ure)s?$")
LEARNED = regex.compile(r"(?:al|ary|ory|ive|ous|ible|able|ate|ise|ize|ially|ively|ably)$")
PASSIVE = regex.compile(r"\b(?:is|was|are|were|be|been|being)\s+\p{L}+(?:ed|en)\b")
NAMES = ("words", "sentence_mean", "sentence_sd", "sentence_q1", "sentence_q3", "sentence_max", "word_mean", "word_sd", "word_q3", "word_q9", "syllables", "polysyllables", "short_words", "long_words", "types", "hapax", "nominal", "learned", "links", "pronouns", "verbs", "passive", "commas", "semicolons", "digits", "capitals", "overlap", "overlap_sd", "repeats")
#: The features that don't depend on English, by their places in NAMES.
SHARED = [NAMES.index(n) for n in ("words", "sentence_mean", "sentence_sd", "sentence_q1", "sentence_q3", "sentence_max", "types", "hapax", "commas", "semicolons", "overlap", "overlap_sd", "repeats")]
#: Why a grade isn't one that the labels speak for.
FLAGS = ("no-words", "other-language", "unknown-language", "short")


#: Words whose traits a worker keeps; a full store starts anew.
STORE = 1 << 17
_store: dict[str, tuple] = {}


def _traits(word: str) -> tuple:
    """Length, syllables, and whether a word is nominal, learned, a link, a pronoun, a basic verb."""
    if len(_store) >= STORE:
        _store.clear()
    n = len(word)
    out = _store[word] = (n, max(1, len(VOWELS.findall(word))), n > 5 and NOMINAL.search(word) is not None, n > 6 and LEARNED.search(word) is not None, word in LINKS, word in PRONOUNS, word in BASIC_VERBS)
    return out


def _quantiles(values: list, *shares: float) -> list[float]:
    """Linear quantiles of sorted values."""
    out, last = [], len(values) - 1
    for q in shares:
        at = q * last
        low = int(at)
        out.append(values[low] + (values[min(low + 1, last)] - values[low]) * (at - low))
    return out


def _spread(total: float, squares: float, n: int) -> tuple[float, float]:
    mean = total / n
    return mean, math.sqrt(max(0.0, squares / n - mean * mean))


def features(text: str, english: bool = True) -> list[float]:
    """One value for each of NAMES; without `english` words and marks are those of any script, and only SHARED have a meaning."""
    end, word = (END, WORD) if english else (ANY_END, ANY_WORD)
    sentences = [w for part in end.split(text.lower()) if (w := word.findall(part))]
    counts = Counter(w for s in sentences for w in s)
    n = counts.total()
    if not n:
        return [0.0] * len(NAMES)
    get = _store.get
    traits = [(k, *(get(w) or _traits(w))) for w, k in counts.items()]
    once = total = squares = syllables = many = short = long = 0
    marks = [0, 0, 0, 0, 0]
    for k, size, sounds, *flags in traits:
        once += k == 1
        total += k * size
        squares += k * size * size
        syllables += k * sounds
        many += k * (sounds >= 3)
        short += k * (size <= 4)
        long += k * (size >= 10)
        for i, flag in enumerate(flags):
            if flag:
                marks[i] += k
    lengths = sorted(chain.from_iterable([t[1]] * t[0] for t in traits))
    sizes = sorted(map(len, sentences))
    content = [{w for w in s if len(w) > 3} for s in sentences]
    shared = [len(a & b) / max(1, min(len(a), len(b))) for a, b in zip(content, content[1:])] or [0.0]
    chars = max(1, len(text))
    if not english:
        text = SEMICOLON.sub(";", COMMA.sub(",", text))
    raw = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    return [
        math.log1p(n), *_spread(sum(sizes), sum(x * x for x in sizes), len(sizes)), *_quantiles(sizes, 0.25, 0.75), float(sizes[-1]), *_spread(total, squares, n), *_quantiles(lengths, 0.75, 0.9),
        syllables / n, many / n, short / n, long / n, len(counts) / n**0.7, once / n, *(m / n for m in marks),
        len(PASSIVE.findall(text)) / n, float(raw[44]) / n, float(raw[59]) / n, float(raw[48:58].sum()) / chars, float(raw[65:91].sum()) / chars,
        *_spread(sum(shared), sum(x * x for x in shared), len(shared)), sum(x > 0.5 for x in shared) / len(shared),
    ]


class Boosted:
    """Regression trees of fixed depth over binned features, boosted on squared error."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE):
        self.trees, self.depth, self.rate = trees, depth, rate

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        b = self.binned(x)
        self.start, self.nodes = float(y.mean()), []
        now = np.full(len(y), self.start)
        for _ in range(self.trees):
            tree = self.grow(b, y - now)
            now += self.rate * self.walk(tree, b)
            self.nodes.append(tree)
        return self

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, "right") for e, c in zip(self.edges, x.T)], axis=1).astype(np.int16)

    def grow(self, b: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A full tree as arrays: feature (-1: leaf), greatest bin to the left, value; children of k are 2k+1 and 2k+2."""
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
        where = np.zeros(len(rest), int)
        for k in range(size):
            mine = np.flatnonzero(where == k)
            if not len(mine):
                continue
            r = rest[mine]
            value[k] = r.mean()
            if k >= size // 2 or len(mine) < 2 * LEAF:
                continue
            best = (1e-9, -1, 0)
            for f in range(b.shape[1]):
                n = np.cumsum(np.bincount(b[mine, f], minlength=BINS + 1))[:-1]
                s = np.cumsum(np.bincount(b[mine, f], r, BINS + 1))[:-1]
                fits = (n >= LEAF) & (len(mine) - n >= LEAF)
                if fits.any():
                    gain = np.where(fits, s**2 / np.maximum(n, 1) + (r.sum() - s) ** 2 / np.maximum(len(mine) - n, 1), -1) - r.sum() ** 2 / len(mine)
                    at = int(gain.argmax())
                    if gain[at] > best[0]:
                        best = (gain[at], f, at)
            if best[1] >= 0:
                feature[k], cut[k] = best[1], best[2]
                where[mine] = np.where(b[mine, best[1]] <= best[2], 2 * k + 1, 2 * k + 2)
        return feature, cut, value

    def walk(self, tree, b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at = np.zeros(len(b), int)
        for _ in range(self.depth):
            f = feature[at]
            at = np.where(f < 0, at, np.where(b[np.arange(len(b)), f] <= cut[at], 2 * at + 1, 2 * at + 2))
        return value[at]

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        return self.start + self.rate * sum((self.walk(t, b) for t in self.nodes), np.zeros(len(b)))


class Grader:
    """A fitted model, the cuts between its grades, and what cross-validation by source measured: `accuracy`, None if the labels have one source only (folds are of rows then)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, source: np.ndarray):
        if len(y) < MIN_LABELS:
            raise ValueError(f"{len(y)} labelled documents; at least {MIN_LABELS} are needed")
        names = np.unique(source)
        fold = {s: i % FOLDS for i, s in enumerate(names[np.argsort([-(source == s).sum() for s in names], kind="stable")])} if len(names) > 1 else None
        of = np.array([fold[s] for s in source]) if fold else np.arange(len(y)) % FOLDS
        left_out = np.full(len(y), float(y.mean()))
        for k in range(FOLDS):
            if (of == k).any() and (of != k).any():
                left_out[of == k] = Boosted().fit(x[of != k], y[of != k]).predict(x[of == k])
        self.cuts = [self.best_cut(left_out, y, k) for k in range(len(BANDS) - 1)]
        self.accuracy = self._measured(left_out, y, of) if fold else None
        good = np.abs(left_out - y) < 1.25
        self.model = Boosted().fit(x[good], y[good])

    def _measured(self, left_out: np.ndarray, y: np.ndarray, of: np.ndarray) -> float:
        """Share of labels met, each fold's with the cuts that the other folds' left-out grades place: no label judges a cut that it placed."""
        right = 0
        for k in np.unique(of):
            here, rest = of == k, of != k
            cuts = [self.best_cut(left_out[rest], y[rest], b) for b in range(len(BANDS) - 1)]
            right += int((np.searchsorted(np.sort(cuts), left_out[here]) == y[here]).sum())
        return right / len(y)

    @staticmethod
    def best_cut(grades: np.ndarray, y: np.ndarray, k: int) -> float:
        """The middle of the widest of the cuts between bands k and k + 1 that misplace the fewest left-out labels."""
        order = np.argsort(grades)
        g, above = np.concatenate([[-1.0], grades[order], [len(BANDS)]]), y[order] > k
        wrong = np.concatenate([[0], np.cumsum(above)]) + np.concatenate([np.cumsum(~above[::-1])[::-1], [0]])
        gap = np.where(wrong == wrong.min(), np.diff(g), -1)
        at = int(gap.argmax())
        return float((g[at] + g[at + 1]) / 2)

    def bands(self, grades: np.ndarray) -> np.ndarray:
        return np.searchsorted(np.sort(self.cuts), grades)

    def grades(self, x: np.ndarray) -> np.ndarray:
        return self.model.predict(x)


def _own(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.select(F.col(doc_id).alias("doc_key"), F.col(text).cast("string").alias("t")).where("t is not null")


def _measure(batches):
    for batch in base.slices(batches, 1):
        rows = [features(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_key", "x"])


def _labelled(documents: DataFrame, doc_id: str, text: str, source: str, labels: DataFrame, label_id: str, band: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and sources of the labelled documents, at most MAX_LABELS of them; a document with several labels counts by their mean."""
    grade = F.element_at(F.create_map(*(x for i, b in enumerate(BANDS) for x in (F.lit(b), F.lit(float(i))))), F.col(band))
    known = labels.where(F.col(band).isin(*BANDS)).groupBy(F.col(label_id).alias("doc_key")).agg(F.avg(grade).alias("y"))
    known = base.sampled(known, "doc_key", MAX_LABELS)
    rows = documents.select(F.col(doc_id).alias("doc_key"), F.col(text).cast("string").alias("t"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source")).where("t is not null")
    sample = base.cut(rows.join(F.broadcast(known), "doc_key").select("doc_key", "t", "y", "source"))
    measured = base.map_arrow(base.spread(sample.select("doc_key", "t")), _measure, f"doc_key {sample.schema['doc_key'].dataType.simpleString()}, x array<double>")
    got = measured.join(sample.select("doc_key", "y", "source"), "doc_key").orderBy("doc_key").select("x", "y", "source").collect()
    return np.array([r.x for r in got]).reshape(-1, len(NAMES)), np.array([r.y for r in got]), np.array([r.source for r in got])


def train(documents: DataFrame, doc_id: str, text: str, source: str, labels: DataFrame, label_id: str, band: str) -> Grader:
    """Fits on the labelled documents."""
    return Grader(*_labelled(documents, doc_id, text, source, labels, label_id, band))


def train_both(documents: DataFrame, doc_id: str, text: str, source: str, labels: DataFrame, label_id: str, band: str) -> tuple[Grader, Grader]:
    """The same grader, and one that knows only the SHARED features."""
    x, y, names = _labelled(documents, doc_id, text, source, labels, label_id, band)
    return Grader(x, y, names), Grader(x[:, SHARED], y, names)


def _grade(grader):
    def work(batches):
        model: Grader = grader.value
        for batch in base.slices(batches, 1):
            x = np.array([features(t) for t in batch.column(1).to_pylist()]).reshape(-1, len(NAMES))
            grades = model.grades(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grades), pa.array([BANDS[k] for k in model.bands(grades)])], ["doc_key", "grade", "band"])

    return work


#: Unicode white space, no-break spaces with it.
SPLIT = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def _words() -> Column:
    return F.size(F.filter(F.split("t", SPLIT), lambda w: w != ""))


def levels(documents: DataFrame, doc_id: str, text: str, grader: Grader, least: int = LEAST_WORDS) -> DataFrame:
    """`doc_id`, `grade` (0 to 2), `band` of every text of at least `least` words separated by white space."""
    own = _own(documents, doc_id, text)
    own = own.where(_words() >= least)
    shared = documents.sparkSession.sparkContext.broadcast(grader)
    out = base.map_arrow(base.spread(own), _grade(shared), f"doc_key {own.schema['doc_key'].dataType.simpleString()}, grade double, band string")
    return out.withColumnRenamed("doc_key", doc_id)


def _is_english(text: str, lang: str | None) -> bool:
    """What the language says; where none is named, whether most letters are Latin."""
    if lang:
        return lang == "en"
    return 2 * len(LATIN.findall(text)) > len(LETTER.findall(text))


def _grade_all(graders):
    def work(batches):
        english, shared = graders.value
        for batch in base.slices(batches, 1):
            texts, langs, flags = (batch.column(i).to_pylist() for i in (1, 2, 3))
            own = np.array([_is_english(t, lang) for t, lang in zip(texts, langs)], bool)
            x = np.array([features(t, e) for t, e in zip(texts, own.tolist())]).reshape(-1, len(NAMES))
            other = shared.grades(x[:, SHARED])
            grades = np.where(own, english.grades(x), other)
            bands = np.where(own, english.bands(grades), shared.bands(other))
            none = x[:, 0] == 0
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grades, mask=none), pa.array([None if w else BANDS[k] for k, w in zip(bands, none)], pa.string()), pa.array([FLAGS[0] if w else f for f, w in zip(flags, none)], pa.string())], ["doc_key", "grade", "band", "flag"])

    return work


def every_level(documents: DataFrame, doc_id: str, text: str, lang: str, graders: tuple[Grader, Grader], least: int = LEAST_WORDS) -> DataFrame:
    """`doc_id`, `grade`, `band` and `flag` of every text that isn't null.

    flag: null for English texts of at least `least` words, else the first of FLAGS that holds; only the first comes without a grade.
    """
    own = documents.select(F.col(doc_id).alias("doc_key"), F.col(text).cast("string").alias("t"), F.nullif(F.trim(F.col(lang).cast("string")), F.lit("")).alias("lang")).where("t is not null")
    own = own.withColumn("flag", F.when(F.col("lang").isNull(), FLAGS[2]).when(F.col("lang") != "en", FLAGS[1]).when(_words() < least, FLAGS[3]))
    shared = documents.sparkSession.sparkContext.broadcast(graders)
    out = base.map_arrow(base.spread(own), _grade_all(shared), f"doc_key {own.schema['doc_key'].dataType.simpleString()}, grade double, band string, flag string")
    return out.withColumnRenamed("doc_key", doc_id)
