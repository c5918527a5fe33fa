"""Problem 4: the language of a text and of each of its sentences, with a confidence.

A sentence is the average of the embeddings of its hashed character n-grams, followed by a linear softmax; both are trained here by
stochastic gradient descent in numpy. Training uses bounded samples of labelled rows; sentences whose label the first fit rejects strongly
are left out of the second (rows are labelled wrongly, and texts mix languages). Confidences are calibrated on held-out rows by a
temperature, and sentences under the confidence that keeps the held-out precision are rejected.

Defined results: null, empty and blank texts and sentences without letters give no row; a text of any length is read whole; repeated rows
give repeated results; an unknown, null or empty label names no language; an empty table gives an empty table; without training rows there is an error.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import base
from lexloom.llm.sentences import LONGEST, Tagger
from lexloom.llm.uniform import fold_column as _uniform_list

# The languages, and the names by which labels give them.
NAMES = {
    "en": "en eng english", "hi": "hi hin hindi हिन्दी हिंदी", "mr": "mr mar marathi मराठी", "gu": "gu guj gujarati ગુજરાતી", "bn": "bn ben bengali bangla বাংলা", "ta": "ta tam tamil தமிழ்", "te": "te tel telugu తెలుగు",
    "kn": "kn kan kannada ಕನ್ನಡ", "ml": "ml mal malayalam മലയാളം", "pa": "pa pan punjabi panjabi ਪੰਜਾਬੀ", "ur": "ur urd urdu اردو", "zh": "zh zho chi chinese mandarin 中文", "ja": "ja jpn japanese 日本語", "th": "th tha thai ไทย",
}
CODES = tuple(NAMES)
BUCKETS, WIDTH, GRAMS = 1 << 15, 16, (1, 2, 3, 4)
EPOCHS, STEP, BATCH = 5, 2.0, 64
DOUBT = 0.6
SHARE = 0.05
#: Labelled documents of each language, and labelled rows, to train on at most.
DOCUMENTS, ROWS = 80, 1800
PRECISION = 0.998
LETTER = regex.compile(r"\p{L}")
MIX = np.uint64(0x9E3779B97F4A7C15)


def named_language(label: str | None) -> str | None:
    """The language a label names, in whatever spelling."""
    word = regex.split(r"[-_\s(]", (label or "").strip().lower())[0]
    return next((code for code, names in NAMES.items() if word and word in names.split()), None)


def language_expr(label: str):
    """`named_language` as a column expression."""
    word = F.element_at(F.split(F.lower(F.trim(F.col(label))), r"[-_\s(]"), 1)
    return F.element_at(F.create_map(*(F.lit(x) for code, names in NAMES.items() for name in names.split() for x in (name, code))), F.coalesce(word, F.lit("")))


def reading_form(text: str) -> str:
    """Lower-case letters and marks with single spaces for all else."""
    return " " + regex.sub(r"[^\p{L}\p{M}]+", " ", text.lower()).strip() + " "


def grams(texts: list[str], chunk: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of each text and where each text's begin; made over one array of all characters of a chunk of texts."""
    if len(texts) > chunk:
        parts = [grams(texts[at : at + chunk]) for at in range(0, len(texts), chunk)]
        sizes = np.concatenate([np.diff(ends) for _, ends in parts])
        return np.concatenate([flat for flat, _ in parts]), np.append(0, np.cumsum(sizes))
    points, offsets = base.code_points(pa.array([reading_form(t) for t in texts], pa.string()))
    n = len(points)
    end = np.repeat(offsets[1:], np.diff(offsets))
    at, parts, own = np.arange(n), [], []
    row = np.repeat(np.arange(len(texts)), np.diff(offsets))
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(max(GRAMS)):
            fits = at + k < end
            at, end, row, h = at[fits], end[fits], row[fits], h[fits]
            h = (h + points[at + k].astype(np.uint64) + np.uint64(k + 1)) * MIX
            h ^= h >> np.uint64(31)
            if k + 1 in GRAMS:
                parts.append((h >> np.uint64(20)) % np.uint64(BUCKETS))
                own.append(row)
    rows = np.concatenate(own)
    by = np.argsort(rows, kind="stable")
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.bincount(rows, minlength=len(texts)), out=ends[1:])
    return np.concatenate(parts)[by].astype(np.int32), ends


class Identifier:
    def __init__(self):
        rng = np.random.default_rng(3)
        self.table = (rng.random((BUCKETS, WIDTH), np.float32) - 0.5) * (2 / WIDTH)
        self.out, self.bias = np.zeros((WIDTH, len(CODES)), np.float32), np.zeros(len(CODES), np.float32)
        self.temperature, self.floor = 1.0, 0.5

    def hidden(self, flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.table[flat], ends[:-1], axis=0) / np.diff(ends)[:, None]

    def logits(self, flat, ends) -> np.ndarray:
        return self.hidden(flat, ends) @ self.out + self.bias

    def probabilities(self, texts: list[str]) -> np.ndarray:
        z = self.logits(*grams(texts)) / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def fit(self, texts: list[str], labels: np.ndarray, weights: np.ndarray) -> Identifier:
        flat, ends = grams(texts)
        rng = np.random.default_rng(5)
        steps, done = EPOCHS * max(1, len(texts) // BATCH), 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                sizes = ends[rows + 1] - ends[rows]
                stop = np.cumsum(sizes)
                inside = np.arange(stop[-1]) - np.repeat(stop - sizes, sizes) + np.repeat(ends[rows], sizes)
                buckets = flat[inside]
                edge = np.append(0, stop)
                h = np.add.reduceat(self.table[buckets], edge[:-1], axis=0) / sizes[:, None]
                z = h @ self.out + self.bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p = (p / p.sum(axis=1, keepdims=True)).astype(np.float32)
                p[np.arange(len(rows)), labels[rows]] -= 1
                p *= (weights[rows] / weights[rows].mean() * STEP * max(0.05, 1 - done / steps))[:, None].astype(np.float32)
                back = (p @ self.out.T) / sizes[:, None].astype(np.float32)
                self.out -= (h.T @ p / len(rows) * 20).astype(np.float32)
                self.bias -= p.mean(axis=0).astype(np.float32)
                by = np.argsort(buckets, kind="stable")
                sorted_buckets = buckets[by]
                lead = np.flatnonzero(np.append(True, np.diff(sorted_buckets) > 0))
                self.table[sorted_buckets[lead]] -= np.add.reduceat(np.repeat(back, sizes, axis=0)[by], lead, axis=0).astype(np.float32)
                done += 1
        return self

    def calibrate(self, texts: list[str], labels: np.ndarray) -> Identifier:
        """Temperature of least held-out loss; the least confidence over which the held-out precision is kept."""
        z = self.logits(*grams(texts))
        best = None
        for t in np.geomspace(0.25, 8, 41):
            s = z / t
            loss = float((np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)) + s.max(axis=1) - s[np.arange(len(labels)), labels]).mean())
            if best is None or loss < best[0]:
                best = (loss, float(t))
        self.temperature = best[1]
        p = self.probabilities(texts)
        top, right = p.max(axis=1), p.argmax(axis=1) == labels
        order = np.argsort(-top)
        kept = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(kept >= PRECISION)
        self.floor = float(min(0.7, max(0.35, top[order][good[-1]]))) if len(good) else 0.7
        self.accuracy = float(right.mean())
        return self


def _parts(tagger: Tagger, text: str) -> list[tuple[int, int]]:
    at = tagger.starts(text)
    return [(a, a + len(text[a:b].rstrip())) for a, b in zip(at, [*at[1:], len(text)])]


def _script(text: str) -> str:
    """The script of most letters, by the Unicode names of all of them."""
    found = Counter(unicodedata.name(c, "?").split()[0] for c in LETTER.findall(text))
    return found.most_common(1)[0][0] if found else "?"


def _plausible(labelled: list[tuple]) -> list[tuple]:
    """Labelled sentences without those whose label fewer than SHARE of the sentences in their script have: such labels are mostly wrong."""
    scripts = [_script(t) for _, t, _ in labelled]
    total, of = Counter(scripts), Counter((s, y) for s, (_, _, y) in zip(scripts, labelled))
    return [x for s, x in zip(scripts, labelled) if of[s, x[2]] >= SHARE * total[s]]


def train(documents: DataFrame, doc_id: str, text: str, lang: str, rows: DataFrame, row_id: str, label: str, fields: tuple[str, ...], tagger: Tagger) -> Identifier:
    """Fits on sentences of at most DOCUMENTS documents a language and of at most ROWS labelled rows, chosen by hashes of the ids.

    Labels that are rare in a sentence's script are left out. A first fit is on the rest; sentences that it gives to another language with a confidence of DOUBT leave the second, since few
    labels are wrong and a language that is written in several scripts has most of its sentences labelled rightly in each.
    """
    own = documents.select(F.col(doc_id).alias("k"), F.col(text).cast("string").alias("t"), language_expr(lang).alias("y")).where("t is not null and t <> '' and y is not null")
    own = own.where(F.length("t") < LONGEST)
    docs = [(r.k, r.t, r.y) for r in base.sampled(own, "k", DOCUMENTS, "y").orderBy("k", "t").collect()]
    if not docs:
        raise ValueError("no labelled document to learn from")
    extra = rows.select(F.col(row_id).alias("k"), language_expr(label).alias("y"), F.array(*(F.col(f).cast("string") for f in fields)).alias("t")).where("y is not null")
    more = [(r.k, t, r.y) for r in base.sampled(extra, "k", ROWS).orderBy("k", "t").collect() for t in r.t if t]

    def split(source):
        """Distinct sentences; of those that read the same, one, with the commonest of their labels."""
        seen: dict[str, tuple] = {}
        votes: dict[str, Counter] = defaultdict(Counter)
        for at in range(0, len(source), 256):
            part = source[at : at + 256]
            for (k, _, y), t in zip(part, _uniform_list(pa.array([t for _, t, _ in part], pa.string()))[0]):
                for a, b in _parts(tagger, t):
                    if len(LETTER.findall(t[a:b])) >= 4:
                        form = reading_form(t[a:b])
                        seen.setdefault(form, (k, t[a:b]))
                        votes[form][CODES.index(y)] += 1
        return [(*seen[form], votes[form].most_common(1)[0][0]) for form in sorted(seen)]

    first, second = split(docs), _plausible(split(more)) if more else []
    balance = lambda y: (np.bincount(y, minlength=len(CODES)).clip(1) ** -0.5)[y]
    both = first + second
    y = np.array([c for _, _, c in both])
    texts = [t for _, t, _ in both]
    p = Identifier().fit(texts, y, balance(y)).probabilities(texts)
    keep = np.flatnonzero((p.argmax(axis=1) == y) | (p.max(axis=1) < DOUBT))
    both, y = [both[i] for i in keep], y[keep]
    held = np.array([crc32(str(k).encode()) % 8 == 0 for k, _, _ in both])
    if held.all() or not held.any():
        held = np.arange(len(both)) % 8 == 0
    learn = np.flatnonzero(~held) if (~held).any() else np.arange(len(both))
    model = Identifier().fit([both[i][1] for i in learn], y[learn], balance(y)[learn])
    again = model.probabilities([t for _, t, _ in both])
    sure = (again.argmax(axis=1) == y) | (again.max(axis=1) < 0.9)  # labels that the second fit rejects too
    test = np.flatnonzero(held & sure)
    return model.calibrate([both[i][1] for i in test], y[test]) if len(test) else model


def _identify(shared):
    def work(batches):
        tagger, model = shared.value
        for batch in base.slices(batches, 1):
            texts, places = _uniform_list(batch.column(1))
            spans = [(i, a, b) for i, t in enumerate(texts) for a, b in _parts(tagger, t) if LETTER.search(t, a, b)]
            p = model.probabilities([texts[i][a:b] for i, a, b in spans]) if spans else np.zeros((0, len(CODES)))
            best, top = p.argmax(axis=1), p.max(axis=1)
            columns = [pa.array([int(places[i][a]) for i, a, _ in spans], pa.int32()), pa.array([int(places[i][b - 1]) + 1 for i, _, b in spans], pa.int32())]
            language = [CODES[k] if c >= model.floor and len(LETTER.findall(texts[i], a, b)) >= 4 else None for k, c, (i, a, b) in zip(best, top, spans)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _, _ in spans], pa.int64())), *columns, pa.array(language, pa.string()), pa.array(top, pa.float64())], ["row_key", "start_char", "end_char", "language", "confidence"])

    return work


def segments(df: DataFrame, row_id: str, text: str, tagger: Tagger, model: Identifier) -> DataFrame:
    """`row_id`, `start_char`, `end_char`, `language` (null: rejected), `confidence` of every sentence with letters."""
    own = df.select(F.col(row_id).alias("row_key"), F.col(text).cast("string").alias("t")).where("t is not null and t <> ''")
    both = df.sparkSession.sparkContext.broadcast((tagger, model))
    out = base.map_arrow(base.spread(own), _identify(both), f"row_key {own.schema['row_key'].dataType.simpleString()}, start_char int, end_char int, language string, confidence double")
    return out.withColumnRenamed("row_key", row_id)


def document_languages(parts: DataFrame, row_id: str) -> DataFrame:
    """`row_id`, `language` of most of the text's characters, its `confidence` (mean by length) and `share`; ties go to the code that sorts first."""
    size = F.col("end_char") - F.col("start_char")
    by = parts.where("language is not null").groupBy(row_id, "language").agg(F.sum(size).alias("n"), (F.sum(F.col("confidence") * size) / F.sum(size)).alias("confidence"))
    return by.groupBy(row_id).agg(F.min_by(F.struct("language", "confidence", "n"), F.struct(-F.col("n"), F.col("language"))).alias("b"), F.sum("n").alias("all")).select(row_id, "b.language", "b.confidence", (F.col("b.n") / F.col("all")).alias("share"))
