"""Problem 3: sentences in every language and script.

A linear-chain tagger marks each character as the first of a sentence or as inside one; Viterbi decoding finds the best tags of a text. In
scripts that part words by spaces, a character within a word or after a plain space has minus infinity for the first tag; all others are scored:
those after a closing mark, a line break or a change of script by what is seen around them, and every character of a script without spaces by the
characters around it, so that sentences that run on without any mark are told apart too. A character whose score can't outweigh what the
neighbours' tags add is inside a sentence on every best path and leaves the lattice, which changes no result.

The tagger is an averaged structured perceptron over hashed features, fitted on a bounded sample of the very texts. Its labels are read from
statistics of all rows: how often a word is followed by a full stop, and how often a word stands where a sentence opens. It also learns from
copies of those texts whose closing marks are stripped and whose lines are wrapped at other places, so that it can find the sentences
of scripts without full stops and of careless writing from words alone. The list of abbreviations is one feature among others and labels nothing.

Defined results: null, empty and blank texts have no sentence; a text of any length is read whole; repeated rows give repeated results; an
empty table gives an empty table, and without any text to learn from every text is one sentence.
"""

from __future__ import annotations

import random
from bisect import bisect_right
from collections import Counter
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm import base
from lexloom.llm.uniform import fold_column as _uniform_list

SIZE = 1 << 17
#: Texts of each field in Latin script that the tagger is fitted on at most; which, is decided by a hash of the row.
SAMPLE = 2000
ROUNDS = 4
#: By how much the right tags must win in training.
MARGIN = 2.0
COPIES = 2
#: Longer texts are tagged like all others, but aren't fitted on: characters.
LONGEST = 20_000
#: Sizes of the table of weights of characters around a place.
PLAIN_SIZE, PLAIN = 1 << 16, 8
#: Rates at which a word counts as standing before a full stop mostly, and always; as opening sentences; at which enough words after its full stops do, where it
#: stands otherwise too, and where it doesn't; and at which one word alone does; with fewer occurrences nothing is known of it. Words of so many letters before a full stop end sentences, as a prior.
DOTTED, ALWAYS, OPENING, SOME, MOSTLY, SURELY, SEEN, LONG_WORD = 0.5, 0.97, 0.5, 0.3, 0.8, 0.85, 3, 5
#: How much more a text's first word, or one after a stronger mark, tells than one after a full stop.
HEADS = 2

# Abbreviations, by what may follow them. Titles and labels introduce something; others may also end a sentence. Seen as a feature only.
BEFORE = frozenset("""rs dr mr mrs ms prof insp adv smt shri sri st no nos sec secs art ref vs viz subs ins omit fig vol pp cf i.e e.g g.n w.e.f pvt messrs capt
रु डॉ क्र नं कि कि.मी श्री सौ পৃ নং কি কি.মি ডা ডাঃ રૂ ડૉ નં ક્ર કિ કિ.મી ரூ டாக்டர் கி கி.மீ எண் రూ డా నం కి కి.మీ సం ರೂ ಡಾ ಸಂ ನಂ ಕಿ ಕಿ.ಮೀ രൂ ഡോ നം കി കി.മീ ਰੁ ਡਾ ਨੰ ਕਿ ਕਿ.ਮੀ मी મી மீ మీ ಮೀ മീ ਮੀ মি""".split())
EITHER = frozenset("a.m p.m co ltd inc jr sr etc bros corp".split())
MARKS = ".!?।॥۔。！？؟…"
STRONG = "!?।॥۔。！？؟"
CLOSERS = "\"'”’»」』)]"
PAIRS = {"“": "”", "「": "」", "『": "』", "«": "»"}
CANDIDATE = regex.compile(
    rf"(?P<mark>[{MARKS}](?:[ ]?[{MARKS}])*)(?P<close>[{regex.escape(CLOSERS)}]*)(?P<gap>\s*)(?=\S)|(?P<line>[^\S\n]*\n\s*)(?=\S)"
    r"|(?<=[฀-๿຀-໿က-႟ក-៿][^\S\n]{0,3}|[฀-๿຀-໿က-႟ក-៿] [\d,.]{1,12})(?P<wide>[^\S\n]+)(?=\S)|(?<=[ɐ-᷿Ⰰ-퟿])(?P<turn>[^\S\n]+)(?=[A-Za-z])|(?<=[A-Za-z\d])(?P<back>[^\S\n]+)(?=[ɐ-᷿Ⰰ-퟿])"
)
LAST_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:\.[\p{L}\p{M}\p{N}]+)*$")
NEXT_WORDS = regex.compile(r"([\p{L}\p{M}\p{N}'’&-]+)(?:[^\S\n]*[\n]?[^\S\n]*([\p{L}\p{M}\p{N}'’&-]+))?")
#: What a text begins with up to a mark that closes only its section's number or heading.
HEADING = regex.compile(r"(\s*(?:[Ss]ec(?:tion|\.)?\s*)?\d{1,4}[A-Z]*)(\s*[.:][^.:;!?]*)?")
#: Characters of scripts that part neither words nor, always, sentences.
UNSPACED = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}々ー]+")
#: Scripts that use no closing marks: any beginning of a text is known there, however rare.
UNMARKED = regex.compile(r"[฀-๿຀-໿က-႟ក-៿]")
DIGITS = regex.compile(r"\p{N}+")
BLANK, BEFORE_CAPITAL = regex.compile(r"(?<=[\w,]) (?=\w)"), regex.compile(r"(?<=[\w,]) (?=\p{Lu})")
QUOTES = regex.compile(r"[\"“”「」『』«»]")


def _script(ch: str) -> str:
    """A rough class of a character: case, digit, mark, or block of a script."""
    if ch.isupper():
        return "U"
    if ch.islower():
        return "l"
    if ch.isdigit():
        return "d"
    if ch.isalpha():
        return f"o{ord(ch) >> 7}"
    return ch


def quoted(text: str) -> list[tuple[int, int]]:
    """Spans between quotation marks, of any length. A straight mark that stands as an opening one while another is open opens anew; one without a partner opens nothing."""
    out, at = [], -1
    for m in QUOTES.finditer(text):
        ch, i = m[0], m.start()
        opens = ch in PAIRS or ch == '"' and text[i + 1 : i + 2].strip() != "" and (i == 0 or text[i - 1].isspace() or text[i - 1] in "(—–-,:")
        if at >= 0 and ch == PAIRS.get(text[at], '"') and not (ch == '"' and opens):
            out.append((at, i))
            at = -1
        elif opens or at < 0 and ch == '"':
            at = i
    return out


class Chain:
    """The places of a text that may begin a sentence: those with marks and breaks, with what is seen there, and the plain ones, within scripts without spaces."""

    def __init__(self, text: str):
        self.text, self.at, self.seen, self.plain = text, [], [], []
        first = len(text) - len(text.lstrip())
        self.first = first if first < len(text) else None
        if self.first is None:
            return
        h = HEADING.match(text)
        self.heading = (h.end(1), h.start(2) + len(h[2]) - len(h[2].lstrip()) + 1, h.end(2)) if h and h[2] else (h.end(1), -1, -1) if h else (-1, -1, -1)
        spans = quoted(text)
        opens, closes = [a for a, _ in spans], [b for _, b in spans]
        last = -1
        self.plain = [k for m in UNSPACED.finditer(text, first) for k in range(m.start() + 1, m.end())]
        for m in CANDIDATE.finditer(text, first + 1):
            at = m.end()
            if at == last or at >= len(text):
                continue
            last = at
            k = bisect_right(opens, at - 1) - 1
            inside = k >= 0 and closes[k] >= at
            self.at.append(at)
            self.seen.append(self.look(m, at, inside))

    def look(self, m, at: int, inside: bool) -> tuple:
        """(mark, closing quote, gap, word before, its kind, next character's class, next word, next two words, characters around, in quotation, in heading)"""
        text, start = self.text, m.start()
        mark = m["mark"] or ""
        head = text[max(0, start - 28) : start].rstrip()
        w = LAST_WORD.search(head)
        before = w[0] if w else head[-1:]
        if "." in before and before.lower() not in BEFORE and before.lower() not in EITHER:
            before = before.rpartition(".")[2]  # a sentence that ended without a space before this word
        low = before.lower()
        if mark[:1] == "." and len(mark) == 1 or not mark:
            kind = "B" if low in BEFORE else "E" if low in EITHER else "1" if len(before) == 1 and before.isupper() else "d" if low.isdigit() else "m" if len(low) <= 2 and low[-1:] > "\x7f" else "w"
        else:
            kind = "w"
        gap = m["gap"] if mark else m[0]
        close = m["close"] or "" if mark else ""
        n = NEXT_WORDS.match(text, at)
        one, two = (n[1].lower()[:16], (n[2] or "").lower()[:12]) if n else (text[at], "")
        plain = mark.replace(" ", "")
        name = "" if not plain else "…" if plain in ("...", "…") else plain[-1] if len(set(plain)) == 1 and len(plain) == 1 else "+" + plain[-1]
        number, low_end, high_end = self.heading
        heading = start == number or low_end <= start <= high_end
        return (name, '"' in close or any(c in "”」』»" for c in close), "n" if "\n" in gap else "s" if gap else "", DIGITS.sub("0", low)[-14:], kind, _script(text[at]), DIGITS.sub("0", one), DIGITS.sub("0", two), text[max(0, start - 3) : start], text[at : at + 5], inside, heading, not mark)


#: Feature lists that a process keeps; a full store starts anew.
STORE = 1 << 16
_store: dict[tuple, list[int]] = {}


def features(seen: tuple) -> list[int]:
    """Hashes of what is seen at a place. After a closing mark they depend on the mark's surroundings only, which recur."""
    if seen[-1]:
        return _hashes(seen)
    key = (*seen[:5], seen[5][0], *seen[10:12])
    out = _store.get(key)
    if out is None:
        if len(_store) >= STORE:
            _store.clear()
        out = _store[key] = _hashes(seen)
    return out


def _hashes(seen: tuple) -> list[int]:
    mark, quote, gap, before, kind, cls, one, two, left, right, inside, heading, bare = seen
    frame = f"{mark}|{quote}|{gap}"
    was, turned = _script(left.rstrip()[-1:] or " "), _turned(left, cls)
    if not bare:
        cls = cls[0]  # after a closing mark all uncased scripts are alike
    names = [f"a{frame}|{cls}|{kind}|{inside}|{heading}", f"b{mark}|{kind}|{cls}|{inside}", f"c{mark}|{kind}|{gap}", f"d{mark}|{kind}|{before}", f"e{mark}|{gap}|{cls}|{quote}", f"f{inside}", f"g{heading}|{mark}|{cls}", f"h{mark}|{kind}"]
    if bare:  # without a closing mark the words decide
        names += [f"i{gap}|{cls}|{one}", f"j{cls}|{one} {two}", f"k{right}", f"l{right[:3]}", f"m{left[-2:]}|{gap}", f"n{left}|{right[:2]}", f"o{before}", f"p{before}|{cls}", f"y{was}|{cls}|{gap}", f"z{turned}|{gap}"]
    else:
        names += ["q", f"r{quote}|{cls}", f"s{before}|{cls}", f"t{gap}|{kind}|{cls}", f"u{quote}|{gap}", f"v{inside}|{mark}", f"w{heading}|{kind}", f"x{mark}|{cls}", "y", "z"]
    return [crc32(x.encode("utf-8", "surrogatepass")) & (SIZE - 1) for x in names]


def _turned(left: str, cls: str) -> bool:
    """Whether the script changes between uncased letters (kana and Han, which mix, lie in several blocks from U+3000 on)."""
    was = _script(left.rstrip()[-1:] or " ")
    return was[0] == cls[0] == "o" and was != cls and not (int(was[1:]) >= 96 and int(cls[1:]) >= 96)


def plain_features(text: str, places: np.ndarray) -> np.ndarray:
    """Hashes of the characters around plain places, a row of PLAIN for each; of all places at once."""
    points = np.frombuffer(("\0\0\0" + text + "\0\0\0").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    at = lambda k: points[places + 3 + k]
    block = lambda k: at(k) >> np.uint64(7)
    groups = ((at(-1), at(0)), (at(0), at(1)), (at(0), at(1), at(2)), (at(-2), at(-1)), (at(-3), at(-2), at(-1)), (block(-1), block(0)), (block(0),), (at(-1), at(0), at(1)))
    out = np.zeros((len(places), PLAIN), np.int32)
    with np.errstate(over="ignore"):
        for k, group in enumerate(groups):
            h = np.full(len(places), k + 1, np.uint64)
            for g in group:
                h = (h + g) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            out[:, k] = (h >> np.uint64(20)) % np.uint64(PLAIN_SIZE)
    return out


#: A number that a full stop before it belongs to as often as not.
NUMBER = regex.compile(r"\p{N}+[)\]]")
AMOUNT = regex.compile(r"\p{N}[\p{N},.]*[,.;:]?\Z")
#: What is taken off a word's outside.
OUTSIDE = "\"'“”‘’«»「」『』()[]{},;:" + MARKS


def word_key(token: str) -> str:
    """A word as it is counted: without what stands around it, numbers alike."""
    return DIGITS.sub("0", token.strip(OUTSIDE))[:24]


def opener_key(token: str) -> str:
    """A word as it is counted where a sentence may open: brackets before it belong to it, and so does the full stop of an initial or abbreviation."""
    lead = token[: len(token) - len(token.lstrip("([{"))]
    return lead + word_key(token) + (")" if NUMBER.match(token) else "." if token.rstrip(CLOSERS + ",;:").endswith(".") and len(token) < 8 else "")


def head_keys(text: str) -> list[str]:
    """What a text begins with: two words, and five characters where they aren't ASCII."""
    first = len(text) - len(text.lstrip())
    n = NEXT_WORDS.match(text, first)
    out = [f"{DIGITS.sub('0', n[1].lower()[:16])} {DIGITS.sub('0', (n[2] or '').lower()[:12])}"] if n else []
    return out + ([text[first : first + 5]] if first < len(text) and ord(text[first]) > 0x7F else [])


def _counted(batches):
    """Of a slice of texts: words, how often and how often before a full stop (kind w); words with what follows their full stop (p); words that
    begin a text or follow a stronger mark (s); beginnings (h)."""
    for batch in base.slices(batches, 0):
        words, openers, heads, pairs = Counter(), Counter(), Counter(), Counter()
        for text in batch.column(0).to_pylist():
            tokens = text.split()
            words.update(tokens)
            heads.update(head_keys(text))
            openers.update(tokens[:1])
            stops = [(a, b) for a, b in zip(tokens, tokens[1:]) if a[-1] in STRONG or a[-1] == "."]
            openers.update(b for a, b in stops if a[-1] != ".")
            pairs.update(s for s in stops if s[0][-1] == ".")
        rows: dict[tuple[str, str, str], list[int]] = {}

        def add(key: tuple[str, str, str], n: int, some: int = 0) -> None:
            row = rows.setdefault(key, [0, 0])
            row[0] += n
            row[1] += some

        for token, n in words.items():
            add(("w", word_key(token), ""), n, n if token.rstrip(CLOSERS + ",;:").endswith(".") else 0)
        for token, n in openers.items():
            add(("s", "", opener_key(token)), n)
        for (a, b), n in pairs.items():
            add(("p", word_key(a), opener_key(b)), n)
        for key, n in heads.items():
            add(("h", key, ""), n)
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in rows], pa.string()) for i in (0, 1, 2)), *(pa.array([v[i] for v in rows.values()], pa.int64()) for i in (0, 1))], ["kind", "key", "other", "n", "some"])


class Counts:
    """What all rows say of words and beginnings; of those that the sample has."""

    def __init__(self, rows=()):
        self.of = {(kind, key): (n, some) for kind, key, n, some in rows}

    def rate(self, kind: str, key: str) -> float | None:
        n, some = self.of.get((kind, key), (0, 0))
        return some / n if n >= SEEN else None

    def begins(self, *keys: str) -> bool:
        """Whether texts begin so; of scripts without closing marks any beginning is known, however rare."""
        return any(n >= SEEN or n and UNMARKED.match(k) and " " not in k for k in keys for n in [self.of.get(("h", k), (0, 0))[0]])

    def ends_at_stop(self, before: str, following: str) -> bool:
        """Whether a full stop between two words ends a sentence: after a word that often stands without one, or whose stops mostly come before
        words that open sentences; else before a word that opens sentences itself."""
        word = word_key(before)
        dotted, opened = self.rate("w", word), self.rate("p", word)
        free = dotted is not None and dotted < DOTTED
        if AMOUNT.match(following):
            return free and len(word) >= LONG_WORD
        if len(word) > 1 and (free or (opened or 0.0) >= (MOSTLY if dotted is None or dotted >= ALWAYS else SOME) or dotted is None and len(word) >= LONG_WORD) or word[:1].isdigit():
            return True
        return (self.rate("x", opener_key(following)) or 0.0) >= SURELY


def certain(chain: Chain, counts: Counts) -> list[bool]:
    """The labels to learn from: what closing marks and the counts of all rows say of each place."""
    out = []
    for at, (mark, quote, gap, before, kind, cls, one, two, left, right, inside, heading, bare) in zip(chain.at, chain.seen):
        known = counts.begins(f"{one} {two}", right)
        if inside or heading or cls in "—–-,;:)]%/&" or cls in MARKS or cls in CLOSERS and cls not in "\"'":
            label = False
        elif bare and gap == "s" and _turned(left, cls):
            label = True
        elif bare:
            label = known and cls not in "ld" and not (left[-1:] == "." or before.isdigit() or len(before) == 1 and before.isupper())
        elif quote:
            label = cls == "U" or gap == "n" and known
        elif mark == ".":
            last = chain.text[: chain.text.rfind(".", 0, at)][-24:].split()
            word = last[-1] if last else ""
            following = chain.text[at : at + 24].split()
            if not gap:
                ordinary = counts.rate("w", before)
                label = cls in "U[(\"" and len(before) > 1 or cls[0] == "o" and len(before) > 2 and (ordinary is None or ordinary < DOTTED)
            else:
                label = counts.ends_at_stop(word, following[0] if following else "")
        elif mark == "…":
            label = cls == "U"
        else:
            label = True
        out.append(label)
    return out


class Tagger:
    """Weights of the features for the tag 'first of a sentence' (the other tag scores nothing) and of pairs of neighbouring tags."""

    def __init__(self):
        self.weights, self.pairs, self.plain = np.zeros(SIZE, np.float32), np.zeros((2, 2), np.float32), np.zeros(PLAIN_SIZE, np.float32)

    def fit(self, chains: list[tuple[np.ndarray, list[bool], Chain, set[int]]], rounds: int = ROUNDS, seed: int = 7) -> Tagger:
        """chains: features and labels of the places with marks and breaks, the chain, and the plain places where a sentence begins."""
        w, t, plain = [0.0] * SIZE, [[0.0, 0.0], [0.0, 0.0]], np.zeros(PLAIN_SIZE)
        sums, pair_sums, plain_sums, clock = {}, [[0.0, 0.0], [0.0, 0.0]], np.zeros(PLAIN_SIZE), 1
        order, rng = list(range(len(chains))), random.Random(seed)
        known = {k: (places := np.array(chain.plain), plain_features(chain.text, places), np.isin(places, list(true))) for k, (_, _, chain, true) in enumerate(chains) if chain.plain}
        for _ in range(rounds):
            rng.shuffle(order)
            for k in order:
                table, labels, chain, _ = chains[k]
                feats = table.tolist()
                scores = [sum(w[f] for f in fs) + (-MARGIN if y else MARGIN) for fs, y in zip(feats, labels)]
                around, gold = None, labels
                at, gaps = chain.at, [0] * (len(scores) + 1)
                if chain.plain:
                    places, around, right = known[k]
                    own = plain[around].sum(axis=1) + np.where(right, -MARGIN, MARGIN)
                    scores, at, gaps, which = merged(scores, chain.at, own, places, t, keep=right)
                    gold = [labels[i] if i >= 0 else bool(right[-1 - i]) for i in which]
                guess = viterbi(scores, t, gaps)
                if guess != gold:
                    was = now = 1
                    for i, (g, y) in enumerate(zip(guess, gold)):
                        if g != y:
                            step = 1.0 if y else -1.0
                            if around is not None and which[i] < 0:
                                row = around[-1 - which[i]]
                                plain[row] += step
                                plain_sums[row] += step * clock
                            else:
                                for f in feats[i if around is None else which[i]]:
                                    w[f] += step
                                    sums[f] = sums.get(f, 0.0) + step * clock
                        if gaps[i]:
                            was = now = 0
                        for tag_was, tag, step in ((was, y, 1.0), (now, g, -1.0)):
                            t[tag_was][tag] += 0.1 * step
                            pair_sums[tag_was][tag] += 0.1 * step * clock
                        was, now = int(y), int(g)
                clock += 1
        for f, s in sums.items():
            self.weights[f] = w[f] - s / clock
        self.plain = (plain - plain_sums / clock).astype(np.float32)
        self.pairs = np.array([[t[a][b] - pair_sums[a][b] / clock for b in (0, 1)] for a in (0, 1)], np.float32)
        return self

    def starts(self, text: str) -> list[int]:
        """Places of the first characters of the sentences of a uniform text."""
        chain = Chain(text)
        if chain.first is None:
            return []
        if not chain.at and not chain.plain:
            return [chain.first]
        scores, at, gaps = self.weights[_table(chain)].sum(axis=1).tolist() if chain.at else [], chain.at, None
        pairs = self.pairs.tolist()
        if chain.plain:
            places = np.array(chain.plain)
            scores, at, gaps, _ = merged(scores, chain.at, self.plain[plain_features(text, places)].sum(axis=1), places, pairs)
        tags = viterbi(scores, pairs, gaps)
        return [chain.first, *(p for p, tag in zip(at, tags) if tag)]


def merged(scores: list[float], at: list[int], own: np.ndarray, places: np.ndarray, pairs: list[list[float]], keep: np.ndarray | None = None) -> tuple[list[float], list[int], list[int], list[int]]:
    """Both kinds of places in order, without those plain ones that no best path can have as a first: scores, places, how many left out before
    each (and after the last), and which place each is (a plain one k as -1 - k). keep: plain places to keep all the same."""
    most = max(pairs[a][1] + pairs[1][b] - pairs[a][0] - pairs[0][b] for a in (0, 1) for b in (0, 1))
    live = np.flatnonzero((own + max(most, 0.0, pairs[0][1] - pairs[0][0], pairs[1][1] - pairs[1][0]) >= 0) | (keep if keep is not None else False))
    every = np.concatenate([np.array(at, np.int64), places[live]])
    kind = np.concatenate([np.arange(len(at)), -1 - live])
    by = np.argsort(every, kind="stable")
    rank = np.searchsorted(places, every[by], "left") + np.searchsorted(np.array(at, np.int64), every[by], "left")  # places before each
    gaps = np.diff(np.concatenate([[-1], rank, [len(places) + len(at)]])) - 1
    value = np.concatenate([np.array(scores, np.float64), own[live]])[by]
    return value.tolist(), every[by].tolist(), gaps.tolist(), kind[by].tolist()


def viterbi(scores: list[float], pairs: list[list[float]], gaps: list[int] | None = None) -> list[bool]:
    """The best tags of a chain whose place before the first is the first of a sentence. gaps: how many places that are inside a sentence
    stand, left out, before each."""
    inside, first, back = None, 0.0, []
    for k, s in enumerate(scores):
        gap = gaps[k] if gaps else 0
        skipped = None
        if gap:  # the places left out are inside
            skipped = inside is not None and inside + pairs[0][0] >= first + pairs[1][0]
            inside, first = (inside + pairs[0][0] if skipped else first + pairs[1][0]) + (gap - 1) * pairs[0][0], None
        a, b = None if inside is None else inside + pairs[0][0], None if first is None else first + pairs[1][0]
        c, d = None if inside is None else inside + pairs[0][1], None if first is None else first + pairs[1][1]
        up, down = a is None or b is not None and b > a, c is None or d is not None and d > c
        back.append((up, down, skipped))
        inside, first = b if up else a, (d if down else c) + s
    if not scores:
        return []
    gap = gaps[len(scores)] if gaps and len(gaps) > len(scores) else 0
    tag, out = first + (pairs[1][0] if gap else 0.0) > inside + (pairs[0][0] if gap else 0.0), []
    for up, down, skipped in reversed(back):
        out.append(tag)
        tag = down if tag else up
        if skipped is not None:
            tag = not skipped
    return out[::-1]


def _learn(texts: list[str], counts: Counts, chains: list[Chain] | None = None) -> Tagger:
    """Fits on uniform texts and on their stripped and wrapped copies. chains: the texts' own, where they are made already."""
    rng = random.Random(11)
    chains = [c for c in chains or map(Chain, texts) if c.first is not None]
    data = []
    for c in chains:
        labels = certain(c, counts)
        if c.at or c.plain:
            data.append((_table(c), labels, c, set()))
        for _ in range(COPIES):
            copy, true = _careless(c, labels, rng)
            if copy is not None and (copy.at or copy.plain):
                data.append((_table(copy), [at in true for at in copy.at], copy, true))
    unmarked = [c for c in chains if UNMARKED.match(c.text, c.first)]
    for k in range(2 * min(400, len(chains)) + 2 * min(300, len(unmarked))):
        a, b = (rng.choice(unmarked), rng.choice(unmarked)) if k >= 2 * min(400, len(chains)) else (rng.choice(chains), rng.choice(chains))
        head = a.text.rstrip()
        if k < min(400, len(chains)):  # texts one after the other, whatever their scripts
            runs = head[-1:] in MARKS
        else:  # texts of two scripts, and of one that has no closing marks, run together without a mark
            head = head.rstrip(MARKS + CLOSERS + " ")
            runs = head[-1:].isalpha() and _turned(head[-1:], _script(b.text[b.first])) or UNMARKED.match(head[-1:]) and UNMARKED.match(b.text, b.first)
        if not runs:
            continue
        both = Chain(head + " " + b.text[b.first :])
        join = len(head) + 1
        if join in both.at:
            known = dict(zip((at for at in a.at if at < len(head)), certain(a, counts))) | {join: True} | {join + at - b.first: y for at, y in zip(b.at, certain(b, counts))}
            data.append((_table(both), [known.get(at, False) for at in both.at], both, set()))
    return Tagger().fit(data)


def _table(chain: Chain) -> np.ndarray:
    return np.array([features(s) for s in chain.seen], np.int32) if chain.seen else np.zeros((0, 18), np.int32)


def _careless(chain: Chain, labels: list[bool], rng: random.Random):
    """A copy of a text in which closing marks are stripped before line breaks and lines break elsewhere; and the places of its sentences."""
    text, out, true, at = chain.text, [], set(), 0
    firsts = [p for p, y in zip(chain.at, labels) if y]
    size = 0
    for p in [*firsts, len(text)]:
        part = text[at:p]
        body = part.rstrip()
        if p < len(text) and rng.random() < 0.5 and body[-1:] in MARKS and body[-2:-1].isalpha():
            body = body.rstrip(MARKS + " ")
            part = body + ("" if UNSPACED.match(body[-1:]) and UNSPACED.match(text, p) and rng.random() < 0.7 else "\n")
        if rng.random() < 0.4 and (blanks := [m.start() for m in BLANK.finditer(part)]):
            names = [m.start() for m in BEFORE_CAPITAL.finditer(part)]
            b = rng.choice(names if names and rng.random() < 0.6 else blanks)
            part = part[:b] + "\n" + part[b + 1 :]
        out.append(part)
        size += len(part)
        if p < len(text):
            true.add(size)
        at = p
    return (Chain("".join(out)), true) if len(out) > 1 or rng.random() < 0.3 else (None, true)


def sample(fields: list[tuple[DataFrame, str, str]], limit: int = SAMPLE) -> list[str]:
    """Uniform texts to learn from: of each (table, row id, text) at most `limit` distinct ones in Latin script and an eighth of that in
    each other block of letters, so that a rare script is learnt too."""
    texts: list[str] = []
    for df, row_id, text in fields:
        own = df.select(F.col(row_id).alias("k"), F.col(text).cast("string").alias("t")).where("t is not null and t <> ''").where(F.length("t") < LONGEST)
        own = own.withColumn("block", F.floor(F.ascii(F.regexp_extract("t", r"\p{L}", 0)) / 128))
        chosen = base.sampled(own, "k", F.when(F.col("block") == 0, limit).otherwise(max(1, limit // 8)), "block")
        texts += dict.fromkeys(r.t for r in chosen.orderBy("k", "t").select("t").collect())
    out: list[str] = []
    for at in range(0, len(texts), 512):
        out += _uniform_list(pa.array(texts[at : at + 512], pa.string()))[0]
    return out


def counted(fields: list[tuple[DataFrame, str, str]], texts: list[str], chains: list[Chain] | None = None) -> Counts:
    """Counts over all rows of the words and beginnings that given texts have. chains: the texts' own, where they are made already."""
    if not texts:
        return Counts()
    keys = {("h", k) for t in texts for k in head_keys(t)}
    for t, c in zip(texts, chains or map(Chain, texts)):
        keys |= {("h", k) for seen in c.seen for k in (f"{seen[6]} {seen[7]}", seen[9])}
        tokens = t.split()
        keys |= {(kind, word_key(x)) for x in tokens if "." in x for kind in "wp"} | {("w", seen[3]) for seen in c.seen}
        keys |= {("x", opener_key(t[at : at + 24].split()[0])) for at in c.at}
    spark = fields[0][0].sparkSession
    own = None
    for df, _, text in fields:
        part = df.select(F.col(text).cast("string").alias("t")).where("t is not null and t <> ''")
        own = part if own is None else own.unionAll(part)
    asked = spark.createDataFrame(sorted(keys), "kind string, key string")
    found = base.map_arrow(base.spread(own), _counted, "kind string, key string, other string, n long, some long")
    rows = base.cut(found.groupBy("kind", "key", "other").agg(F.sum("n").alias("n"), F.sum("some").alias("some")))
    plain = (F.col("some") < DOTTED * F.col("n")) & (F.length("key") > 1) | (F.length("key") >= LONG_WORD) & ~F.contains("key", F.lit(".")) | F.col("key").startswith("0")
    words = rows.where("kind = 'w'").select("key", plain.alias("plain"))
    pairs = rows.where("kind = 'p'").select("key", "other", "n")
    after = pairs.join(words, "key").select("other", "n", F.when(F.col("plain"), F.col("n")).otherwise(0).alias("some"))
    after = after.unionAll(rows.where("kind = 's'").select("other", "n", (HEADS * F.col("n")).alias("some"))).groupBy("other").agg(F.sum("n").alias("n"), F.sum("some").alias("some"))
    opens = (F.col("o.n") >= SEEN) & (F.col("o.some") >= OPENING * F.col("o.n"))
    opened = pairs.alias("p").join(after.alias("o"), "other").groupBy("p.key").agg(F.sum("p.n").alias("n"), F.sum(F.when(opens, F.col("p.n")).otherwise(0)).alias("some"))
    every = rows.where("kind in ('w', 'h')").select("kind", "key", "n", "some").unionAll(after.select(F.lit("x"), "other", "n", "some")).unionAll(opened.select(F.lit("p"), "key", "n", "some"))
    return Counts(tuple(r) for r in every.join(F.broadcast(asked), ["kind", "key"], "left_semi").collect())


def train(fields: list[tuple[DataFrame, str, str]], limit: int = SAMPLE) -> Tagger:
    texts = sample(fields, limit)
    chains = [Chain(t) for t in texts]
    return _learn(texts, counted(fields, texts, chains), chains)


def _tag(tagger):
    def work(batches):
        model: Tagger = tagger.value
        for batch in base.slices(batches, 1):
            keys, starts, ends = [], [], []
            texts, places = _uniform_list(batch.column(1))
            for i, (text, place) in enumerate(zip(texts, places)):
                found = model.starts(text)
                for a, b in zip(found, [*found[1:], len(text)]):
                    b = a + len(text[a:b].rstrip())
                    keys.append(i)
                    starts.append(int(place[a]))
                    ends.append(int(place[b - 1]) + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["row_key", "start_char", "end_char"])

    return work


def sentences(df: DataFrame, row_id: str, text: str, tagger: Tagger) -> DataFrame:
    """`row_id`, `start_char`, `end_char` of every sentence of every text."""
    own = df.select(F.col(row_id).alias("row_key"), F.col(text).cast("string").alias("t")).where("t is not null and t <> ''")
    shared = df.sparkSession.sparkContext.broadcast(tagger)
    out = base.map_arrow(base.spread(own), _tag(shared), f"row_key {own.schema['row_key'].dataType.simpleString()}, start_char int, end_char int")
    return out.withColumnRenamed("row_key", row_id)
