"""Toxicity scores from a weighted lexicon matched by Aho-Corasick over folded text.

Texts and lexicon are folded alike: lower case, homoglyphs to their Latin look-alikes, digits and signs that stand for
letters to those letters.  One automaton finds every entry and every exception phrase; an entry counts as a whole word
outside exception phrases.  Entries that end in * are stems: words that begin with them count, whatever their ending.
The sum of weights is normalised by the text's length and mapped to a probability.

Entries, weights, exceptions and the mapping are learned from labelled rows, of which a sample of at most SAMPLE is
used, drawn by a hash of the key.  Only the text is an input of a score.  Defined results: a null text counts as empty
and scores as a text without hits; repeated rows each give a row; unlabelled or null label rows teach nothing; without
any toxic label the score is 0 everywhere; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled rows that the lexicon is learned from, at most.
SAMPLE = 8_000
#: Score from which a text counts as toxic.
THRESHOLD = 0.3
#: An entry is in at least so many toxic texts of the sample that no entry before it covers, and in this share of them.
MIN_GAIN, MIN_SHARE = 3, 0.01
#: At least this share of the texts that hold an entry (a stem: twice or more) are toxic.
MIN_PRECISION = 0.8
#: Lengths of stems.
STEMS = range(4, 10)

#: Look-alikes of Latin letters in Cyrillic, Greek and phonetic script, and digits that stand for letters (fixed values).
HOMOGLYPHS = dict(zip("авсԁеғһіјкӏмопрԛѕтցѵѡхуᴢαβεηικνορτυχωℓıɑɡʟɴʀꜱ", "abcdefhijklmonpqstgvwxyzabenikvoptuxwliaglnrs", strict=False))
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g"}
#: Everyday phrases in which an entry isn't meant as an insult.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "take out the trash", "pond scum", "clown fish", "idiot proof", "loser bracket", "class clown act", "dutch oven")

_SIGN = re.compile(r"[@$](?=\w)")


def _table() -> dict[int, str]:
    out = {ord(k): v for k, v in (HOMOGLYPHS | DIGITS).items()}
    for c in range(0xC0, 0x250):  # accented Latin letters: the letter below the accent
        base = unicodedata.normalize("NFKD", chr(c))[0]
        if base.isascii() and base.isalpha():
            out[c] = base.lower()
    out |= {c: chr(c - 0xFEE0).lower() for c in range(0xFF21, 0xFF5B)} | {0xFF10 + d: DIGITS.get(str(d), str(d)) for d in range(10)}
    out |= {0x200B: "", 0x200C: "", 0x200D: "", 0xAD: "", 0x2060: ""}
    return {k: v.replace("l", "i") for k, v in out.items()} | {ord("l"): "i"}  # 1 stands for either: both letters share one form


_FOLD = _table()


def fold(text: str) -> str:
    text = text.lower()
    if "@" in text or "$" in text:
        text = _SIGN.sub(lambda m: "a" if m[0] == "@" else "s", text)
    return text.translate(_FOLD)


@dataclass
class Lexicon:
    """Folded entries with weights, folded exception phrases, and the logistic mapping of the normalised sum."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    slope: float = 0.0
    bias: float = -20.0
    _automaton: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"} | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            a = ahocorasick.Automaton()
            entries: dict[str, tuple[float | None, float | None]] = dict.fromkeys(self.exceptions, (None, None))
            for w, v in self.weights.items():
                whole, stem = entries.get(w.rstrip("*"), (None, None))
                entries[w.rstrip("*")] = (whole, v) if w.endswith("*") else (v, stem)
            for w, (whole, stem) in entries.items():
                a.add_word(w, (len(w), whole, stem))
            a.make_automaton()
            self._automaton = a
        return self._automaton

    def hits(self, text: str) -> list[tuple[int, int, float]]:
        """Places in the folded text and weights of the entries that count."""
        if not self.weights:
            return []
        folded, found, excused = fold(text), [], []
        end_of = len(folded)
        for end, (size, whole, stem) in self.automaton().iter(folded):
            start, end = end - size + 1, end + 1
            if start and folded[start - 1].isalnum():
                continue
            if whole is None and stem is None:
                excused.append((start, end))
            elif end == end_of or not folded[end].isalnum() or folded[end] in "sz" and (end + 1 == end_of or not folded[end + 1].isalnum()):
                found.append((start, end, stem if whole is None else whole))
            elif stem is not None:
                found.append((start, end, stem))
        return [h for h in found if not any(s <= h[0] and h[1] <= e for s, e in excused)]

    def density(self, text: str) -> float:
        """Sum of weights over the square root of the text's length in words: long texts need more hits for the same score."""
        return sum(w for _, _, w in self.hits(text)) / math.sqrt(20 + len(text) / 6)

    def score(self, text: str) -> float:
        x = self.slope * self.density(text) + self.bias
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


_WORD = re.compile(r"[^\W_]+")


def _items(text: str) -> set[str]:
    """Words of a folded text, and stems that begin two of its words or more."""
    words = Counter(_WORD.findall(fold(text)))
    stems: Counter[str] = Counter()
    for w, c in words.items():
        for k in STEMS:
            if k > len(w):
                break
            stems[w[:k]] += c
    return words.keys() | {p + "*" for p, c in stems.items() if c > 1}


def learn(texts: list[str], toxic: list[int], exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Entries by greedy cover: the word or stem that is in most toxic texts not yet covered and hardly in others comes next."""
    n_bad = sum(toxic)
    if not n_bad or n_bad == len(toxic):
        return Lexicon()
    bags = [_items(t) if y else None for t, y in zip(texts, toxic, strict=True)]
    bad, good = Counter(), Counter()
    where = defaultdict(list)
    for i, (bag, y) in enumerate(zip(bags, toxic, strict=True)):
        if y:
            bad.update(bag)
            for w in bag:
                where[w].append(i)
    least = max(MIN_GAIN, MIN_SHARE * n_bad)
    often = {w for w, c in bad.items() if c >= least and len(w) > 2}
    for t, y in zip(texts, toxic, strict=True):
        if not y:
            good.update(_items(t) & often)
    words = {w for w in often if bad[w] >= MIN_PRECISION * (bad[w] + good[w])}
    weight = lambda w: math.log((bad[w] + 0.5) / (n_bad + 1)) - math.log((good[w] + 0.5) / (len(toxic) - n_bad + 1))
    open_, weights = {i for i, y in enumerate(toxic) if y}, {}
    gain = {w: bad[w] for w in words}
    strong = max((bad[w] for w in words), default=0) / 3
    while gain:
        w = max(gain, key=lambda w: (gain[w], bad[w], len(w), w))
        if gain[w] < least:
            break
        weights[w] = weight(w)
        gone = open_ & set(where[w])
        open_ -= gone
        del gain[w]
        for i in gone:
            for x in bags[i] & gain.keys():
                gain[x] -= 1
    weights |= {w: weight(w) for w in words if bad[w] >= strong and not w.endswith("*")}  # words as common as the first ones, though covered
    lex = Lexicon(weights, tuple(fold(p) for p in exceptions))
    x, y = np.array([lex.density(t) for t in texts]), np.array(toxic, float)
    lex.slope, lex.bias = _logistic(x, y)
    return lex


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias by Newton's method with a slight ridge, so that separable data stay finite."""
    scale = x.std() or 1.0
    a, w = np.stack([x / scale, np.ones_like(x)], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (y - p) - 1e-2 * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2), grad)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(0.0, w[0]) / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """Lexicon of at most `sample` labelled rows, drawn by a hash of the key; of several labels of a key the highest holds."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label_col).isNotNull()).groupBy(key).agg(F.max(label_col).cast("int").alias("\0y"))
    drawn = known.withColumn("\0h", F.xxhash64(F.col(key))).orderBy("\0h", key).limit(sample)
    texts = docs.select(key, F.col(text_col).cast("string").alias("\0t"))
    rows = texts.join(F.broadcast(drawn.select(key, "\0y")), key).groupBy(key, "\0y").agg(F.min("\0t").alias("\0t"))  # `sample` rows at most, however often a key repeats
    got = sorted((r[0], r[1], r[2] or "") for r in rows.toLocalIterator())
    return learn([t for _, _, t in got], [int(y == 1) for _, y, _ in got], exceptions)


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep columns (all but the text by default), score, n_hits and density of each whole text."""
    made = ("score", "n_hits", "density")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made and c != text_col]

    def run(batches):
        for b in batches:
            scores, hits, dens = [], [], []
            for t in b.column(len(kept)).to_pylist():
                found = lexicon.hits(t or "")
                d = sum(w for _, _, w in found) / math.sqrt(20 + len(t or "") / 6)
                x = lexicon.slope * d + lexicon.bias
                scores.append(1 / (1 + math.exp(-x)) if x > -700 else 0.0)
                hits.append(len(found))
                dens.append(d)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(scores, pa.float64()), pa.array(hits, pa.int64()), pa.array(dens, pa.float64())], names=[*kept, *made])

    schema = T.StructType([docs.schema[c] for c in kept] + [T.StructField("score", T.DoubleType()), T.StructField("n_hits", T.LongType()), T.StructField("density", T.DoubleType())])
    return docs.select(*kept, F.col(text_col).cast("string").alias("\0text")).mapInArrow(run, schema)
