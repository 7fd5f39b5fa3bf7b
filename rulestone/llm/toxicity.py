"""Toxicity by noisy-channel deobfuscation.

A disguised word (leetspeak, letters spaced out, letters repeated) is a lattice: each of its characters may stand for
itself, for a letter that it looks like, for nothing, or for a shorter run. The path that is likeliest under a character
language model of the corpus, times the channel's costs, is found by Viterbi search and replaces the word; then the
restored text is scored. Words without such characters have one path, themselves.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache
from math import exp, lgamma, log, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import begin, checkpoint, few_rows, fresh, give_back, held_out, text_or_empty

#: Letters that a character may stand for, besides itself.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "¡": "i", "£": "l",
}
#: Signs that may stand between letters and mean nothing.
FILLER = ".-_*~'`,:;·•^=/\\%&#?!$@+|()[]{}<>\""
#: Natural logarithms of the channel's chances: a stand-in for a letter, a sign meant as nothing, one that could be a
#: stand-in, a letter of a run dropped.
STAND_IN, DROPPED_SIGN, DROPPED_STAND_IN, DROPPED_REPEAT = -1.5, -0.7, -2.5, -0.7
#: Of an edge of a word between letters that stand spaced out, as readers may set it; the words of all are taken.
EDGES = (0.0, -2.0, -4.0)
#: Prefixes of words that are features, by length; a word itself is one too.
STEMS = (4, 5, 6)
#: Most labelled documents, and texts of these, that the scorer is fitted on: those of least hash. The language model takes all.
SAMPLE = 10_000
#: Lower bound of a proportion: standard deviations below.
SURE = 1.64
THRESHOLD = 0.7
#: Tokens whose weights a worker remembers.
REMEMBERED = 150_000
#: Most features that chance alone may have made, as a share.
FALSE = 0.25
#: Lower bound of the share of toxic documents from which on a feature is sure.
SURELY = 0.93
#: Odd factors that make four orders of one hash.
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)

#: Three or more letters, digits or stand-ins (or runs of one) with white space or signs between any two of them. A run
#: that begins with a stand-in doesn't begin within others, so that each start is tried once.
_SPACED = re.compile(
    r"(?:(?<![^\W_])(?=[^\W_])|(?<![^\W_@$!|+€(¡£])(?=[@$!|+€(¡£]))"
    r"([^\W_]|[@$!|+€(¡£])\1*(?:[\s._*~'`,:;·•^=/\\%&#?)\[\]{}<>\"\-]+([^\W_]|[@$!|+€(¡£])\2*){2,}(?![^\W_])"
)
#: Two such pieces in a row behind a sign or white space, as in every run of three; looked for first, as it is cheap.
_SPACED_PAIR = re.compile(
    r"[\s._*~'`,:;·•^=/\\%&#?)\[\]{}<>\"\-]([^\W_]|[@$!|+€(¡£])\1*[\s._*~'`,:;·•^=/\\%&#?)\[\]{}<>\"\-]+([^\W_]|[@$!|+€(¡£])\2*(?![^\W_])"
)
_PIECE = re.compile(r"([^\W_]|[@$!|+€(¡£])\1*")
_LETTER, _BETWEEN = re.compile(r"[^\W\d_]"), re.compile(r"[\d@$!|+€(¡£._*~\-%&#]")
_ODD = re.compile(r"[\d@$!|+€(¡£][^\W\d_]|[^\W\d_][\d@$€]|(.)\1\1", re.S)
#: Three or more of one sign at an end are decoration.
_DECOR = re.compile(r"^([^\w\s])\1\1+|([^\w\s])\2\2+$")
_EDGES = "".join(FILLER) + "…“”«»¿–—’‘"

# The language model's 28 symbols: 0 the edge of a word and anything else, 1-26 letters without accents, 27 other letters.
_SYMBOLS = np.zeros(256, np.uint8)
for _k in range(26):
    _SYMBOLS[ord("a") + _k] = _SYMBOLS[ord("A") + _k] = _k + 1
for _letters, _plain in (("àáâãäåÀÁÂÃÄÅ", "a"), ("èéêëÈÉÊË", "e"), ("ìíîïÌÍÎÏ", "i"), ("òóôõöÒÓÔÕÖ", "o"), ("ùúûüÙÚÛÜ", "u"), ("çÇ", "c"), ("ñÑ", "n"), ("ß", "s")):
    for _c in _letters:
        _SYMBOLS[ord(_c)] = ord(_plain) - ord("a") + 1
_SYMBOLS[[b for b in range(0xC0, 0x100) if not _SYMBOLS[b] and b not in (0xD7, 0xF7)]] = 27
SIZE = 28


def symbol(character: str) -> int:
    code = ord(character)
    return int(_SYMBOLS[code]) if code < 256 else 27 * character.isalpha()


@cache
def _symbols() -> np.ndarray:
    """symbol() of every code point."""
    return np.fromiter((symbol(chr(code)) for code in range(0x110000)), np.uint8, 0x110000)


def symbols(text: str) -> np.ndarray:
    """symbol() of each character."""
    if text.isascii():
        return _SYMBOLS[np.frombuffer(text.encode(), np.uint8)]
    return _symbols()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def count_trigrams(texts: Iterable[str]) -> np.ndarray:
    """Counts of all runs of three symbols, by first * SIZE**2 + second * SIZE + third; each text begins and ends with
    edges."""
    found = np.zeros(SIZE**3, np.int64)
    for text in texts:
        own = symbols(f"  {text}  ").astype(np.int32)
        runs = (own[:-2] * SIZE + own[1:-1]) * SIZE + own[2:]
        if len(runs) > SIZE**3 // 8:
            found += np.bincount(runs, minlength=SIZE**3)
        else:
            np.add.at(found, runs, 1)
    return found


class LanguageModel:
    """Interpolated trigram model of characters."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(SIZE, SIZE, SIZE).astype(float)
        two, one = three.sum(0), three.sum((0, 1))
        p1 = (one + 1) / (one.sum() + SIZE)
        p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
        p3 = (three + 5 * p2) / (three.sum(2, keepdims=True) + 5)
        self.log = np.log(p3).tolist()


def _runs(word: str) -> list[tuple[str, int]]:
    runs: list[tuple[str, int]] = []
    for c in word:
        if runs and runs[-1][0] == c:
            runs[-1] = (c, runs[-1][1] + 1)
        else:
            runs.append((c, 1))
    return runs


def _choices(character: str, length: int) -> list[tuple[str, float]]:
    """What a run of one character may stand for, with the log of its chance."""
    found: list[tuple[str, float]] = []
    if character.isalpha():
        # a run may be meant as written, as one letter or as two
        for meant in {length, 1, min(2, length)}:
            found.append((character * meant, DROPPED_REPEAT * (meant < length)))
    else:
        for letter in LOOKS_LIKE.get(character, ""):
            for meant in {1, min(2, length), length if length <= 2 else 1}:
                found.append((letter * meant, STAND_IN * meant + DROPPED_REPEAT * (meant < length)))
        if character in FILLER:
            found.append(("", DROPPED_STAND_IN if character in LOOKS_LIKE else DROPPED_SIGN))
        if character.isdigit() or not found:
            found.append((character * length, 0.0))
    return found


def _best(steps: Iterable[list[tuple[str, float]]], model: LanguageModel) -> str:
    """The likeliest reading of what each step may stand for: Viterbi search; a state is the last two symbols."""
    lm = model.log
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for choices in steps:
        then: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, read) in states.items():
            for meant, cost in choices:
                x, y, s = a, b, score + cost
                for c in meant:
                    z = symbol(c)
                    s += lm[x][y][z] if z or not c.isdigit() else -7.0  # a digit kept among letters is rare
                    x, y = y, z
                if (x, y) not in then or s > then[x, y][0]:
                    then[x, y] = (s, (read, meant))
        states = then
    read = max(((s + lm[a][b][0], read) for (a, b), (s, read) in states.items()), key=lambda found: found[0])[1]
    parts = []
    while read is not None:
        read, meant = read
        parts.append(meant)
    return "".join(reversed(parts))


def decode(word: str, model: LanguageModel) -> str:
    """The likeliest reading of a lower-case word; steps are its runs."""
    return _best((_choices(character, length) for character, length in _runs(word)), model)


def decode_spaced(spaced: str, model: LanguageModel, edge: float) -> list[str]:
    """The words of the likeliest reading of lower-case letters that stand spaced out: what stands between two of them is
    the edge of a word or means nothing."""
    steps: list[list[tuple[str, float]]] = []
    for piece in _PIECE.finditer(spaced):
        if steps:
            steps.append([(" ", edge), ("", 0.0)])
        steps.append(_choices(piece[1], len(piece[0])))
    return _best(steps, model).split()


def is_odd(word: str) -> bool:
    """In time linear in the word's length, as a token may be a whole text."""
    if _ODD.search(word):
        return True
    first = _LETTER.search(word)
    if first is None:
        return sum(c in LOOKS_LIKE for c in word) > 2
    return _BETWEEN.search(word, first.end(), len(word) - _LETTER.search(word[::-1]).end()) is not None


class Restorer:
    """Tokens of a text as features: words and stems of the restored text."""

    def __init__(self, model: LanguageModel):
        self.model = model

    def restore(self, token: str) -> list[str]:
        """The words that a token may be, in lower case and without signs at its ends: as written and as decoded."""
        token = _DECOR.sub("", token)
        word = token.lower().strip(_EDGES)
        if not is_odd(token):
            return [word] if word else []
        # a sign at either end may be a letter, as in "a$$", so the token is decoded with them as well
        whole = dict.fromkeys([word, token.lower().lstrip(_EDGES), token.lower()])
        readings = dict.fromkeys([word, *(decode(w, self.model) for w in whole)])
        return [r for r in readings if r]

    def features(self, token: str) -> tuple[str, ...]:
        return tuple(dict.fromkeys(f for word in self.restore(token) for f in (word, *(f"{word[:n]}-" for n in STEMS if len(word) > n))))

    def tokens(self, text: str) -> set[str]:
        """Tokens, and letters that stand spaced out put together: all of a run, and as the language model divides it."""
        found = set(text.split())
        if not _SPACED_PAIR.search(text):
            return found
        for spaced in _SPACED.finditer(text):
            joined = "".join(piece[0] for piece in _PIECE.finditer(spaced[0]))
            if len(set(joined.lower())) > 1:
                found.add(joined)
                # an end sign may be a letter or none
                for own in {spaced[0].lower(), spaced[0].lower().strip(_EDGES + " \t\n\r")}:
                    for edge in EDGES:
                        found.update(decode_spaced(own, self.model, edge))
        return found


@dataclass
class Scorer:
    """weights: of features, -log(1 - p) where p is a lower bound of the share of toxic documents among those with it."""

    counts: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    base: float = 0.02

    def __post_init__(self) -> None:
        self.restorer = Restorer(LanguageModel(self.counts))
        self.by_token: dict[str, float] = {}

    def __getstate__(self):
        return self.counts, self.weights, self.base

    def __setstate__(self, state):
        self.counts, self.weights, self.base = state
        self.__post_init__()

    def token(self, token: str) -> float:
        found = self.by_token.get(token)
        if found is None:
            found = max((self.weights.get(f, 0.0) for f in self.restorer.features(token)), default=0.0)
            if len(self.by_token) >= REMEMBERED:
                self.by_token.clear()
            self.by_token[token] = found
        return found

    def score(self, text: str) -> float:
        """Chance that at least one of the text's features is one that makes it toxic."""
        known = self.by_token.get
        total = 0.0
        for token in self.restorer.tokens(text):
            weight = known(token)
            total += self.token(token) if weight is None else weight
        return 1.0 - (1.0 - self.base) * exp(-total)


def features_of(texts: DataFrame, counts: np.ndarray) -> DataFrame:
    """texts: key, label, text. Returns key, label, marks (four minima of hashes over five-word shingles), features
    (hashes of the text's) and names (the same features by name, of toxic texts only)."""
    model = texts.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("toxicity")
        restorer = Restorer(LanguageModel(model.value))
        for batch in few_rows(batches):
            marks, features, names = [], [], []
            for label, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own = {xxhash.xxh64_intdigest(f): f for token in restorer.tokens(text) for f in restorer.features(token)}
                features.append(np.fromiter(own, np.uint64, len(own)).view(np.int64))
                names.append(list(own.values()) if label else None)
                marks.append(marks_of(text).view(np.int64))
            columns = [pa.array(marks, pa.list_(pa.int64())), pa.array(features, pa.list_(pa.int64())), pa.array(names, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["key", "label", "marks", "features", "names"])

    return texts.select("key", "label", "text").mapInArrow(run, "key long, label int, marks array<long>, features array<long>, names array<string>")


def marks_of(text: str) -> np.ndarray:
    """The least of each of four hashes over a text's five-word shingles."""
    words = text.lower().split()
    shingles = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    hashes = np.fromiter((xxhash.xxh64_intdigest(s) for s in shingles), np.uint64, len(shingles))
    return np.array([(hashes * np.uint64(m)).min() for m in _MIX], np.uint64)


def without_copies(found: DataFrame) -> DataFrame:
    """Rows of features_of() but those that share a mark with one of their label and smaller key, so that a group of near
    copies counts about once. Groups are pre-aggregated to their least key."""
    each = found.select("key", "label", F.posexplode("marks").alias("which", "mark"))
    least = each.groupBy("label", "which", "mark").agg(F.min("key").alias("least"))
    later = each.join(least, ["label", "which", "mark"]).filter(F.col("key") > F.col("least")).select("key").distinct()
    return found.join(later, "key", "left_anti")


def chance_of(n: int, t: int, share: float) -> float:
    """Of t or more toxic documents among n, if each is with chance share."""
    return sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(share) + (n - k) * log(1 - share)) for k in range(t, n + 1))


def weights_of(number: dict[int, int], toxic: dict[int, dict[int, list[int]]], share: float) -> dict[int, float]:
    """number: how many features occur in n documents; toxic: of these, features by how many toxic documents have them.
    Features that occur in n documents are compared with each other: of those with t or more toxic ones, the share that
    chance alone would give is false. A feature counts if that share is under FALSE; its weight follows the lower bound of
    its share of toxic documents."""
    weights: dict[int, float] = {}
    for n, by_count in toxic.items():
        reached = 0
        for t in sorted(by_count, reverse=True):
            if t < 2 or t <= max(0.5, share) * n:
                break
            reached += len(by_count[t])
            false = min(1.0, number[n] * chance_of(n, t, share) / reached)
            if false < FALSE:
                p, z = t / n, SURE
                low = (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
                weights |= dict.fromkeys(by_count[t], -log(1 - min(low * (1 - false), 0.999)))
    return weights


def weigh(found: DataFrame, sure: list[int]) -> dict[int, float]:
    """Weights of the features that count, by the texts without any of the sure ones. Features are counted in Spark; what
    comes to the driver are numbers of features by number of documents, and those that most often stand in toxic ones."""
    left = found.filter(~F.arrays_overlap("features", F.lit(sure).cast("array<long>"))) if sure else found
    n, toxic = left.agg(F.count("*"), F.sum("label")).first()
    if not toxic:
        return {}
    share = (toxic + 0.5) / (n + 1)
    counted = checkpoint(left.select("label", F.explode("features").alias("feature")).groupBy("feature").agg(F.count("*").alias("n"), F.sum("label").alias("t")))
    number = {r.n: r.number for r in counted.groupBy("n").agg(F.count("*").alias("number")).collect()}
    often: dict[int, dict[int, list[int]]] = {}
    for r in counted.filter((F.col("t") > 1) & (F.col("t") > max(0.5, share) * F.col("n"))).toLocalIterator():
        often.setdefault(r.n, {}).setdefault(r.t, []).append(r.feature)
    return weights_of(number, often, share)


def fit(texts: DataFrame, counts: np.ndarray) -> Scorer:
    """texts: key, label, text. Features that make a document toxic almost surely are taken first; the others are weighed
    on the documents that have none of them, so that company of sure ones doesn't count for them."""
    found = checkpoint(without_copies(checkpoint(features_of(texts, counts))))
    sure = {f: w for f, w in weigh(found, []).items() if w >= -log(1 - SURELY)}
    weights = weigh(found, sorted(sure)) | sure
    if not weights:
        return Scorer(counts, {})
    named = found.filter("names is not null").select(F.explode(F.arrays_zip("features", "names")).alias("f")).select("f.features", "f.names")
    names = named.filter(F.array_contains(F.lit(sorted(weights)).cast("array<long>"), F.col("features"))) if len(weights) < 64 else named.join(
        F.broadcast(found.sparkSession.createDataFrame([(f,) for f in weights], "features long")), "features", "left_semi"
    )
    return Scorer(counts, {r.names: weights[r.features] for r in names.distinct().toLocalIterator()})


def gather_trigrams(docs: DataFrame) -> np.ndarray:
    """Trigram counts of all documents; what comes to the driver has at most SIZE**3 (21952) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("toxicity")
        found = np.zeros(SIZE**3, np.int64)
        for batch in few_rows(batches):
            found += count_trigrams(t.as_py() for t in batch.column(0))
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(found[at])], names=["at", "n"])

    rows = docs.select(text_or_empty().alias("text")).mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n"))
    counts = np.zeros(SIZE**3, np.int64)
    for at, n in rows.collect():
        counts[at] = n
    return counts


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """labels: doc_id, toxic. Rows that held_out() marks are never learnt from; the language model takes all texts. The
    scorer is fitted on at most sample texts, those of least hash, whatever the number of rows that share an id; texts
    themselves don't come to the driver."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    picked = known.select(F.col("doc_id").cast("long").alias("_of"), F.col("toxic").cast("int").alias("_toxic"))
    picked = F.broadcast(checkpoint(picked.orderBy(F.xxhash64("_of"), "_of", "_toxic").limit(sample)))  # sample rows at most
    text = text_or_empty()
    joined = docs.join(picked, docs["doc_id"] == picked["_of"]).select(F.xxhash64(text, picked["_toxic"]).alias("key"), picked["_toxic"].alias("label"), text.alias("text"))
    texts = checkpoint(joined.dropDuplicates(["key"]))
    if texts.count() > sample:
        least = texts.select(F.col("key").alias("_key")).orderBy("_key").limit(sample)
        texts = texts.join(F.broadcast(least), F.col("key") == F.col("_key"), "left_semi")
    return fit(texts, gather_trigrams(docs))


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """docs with toxicity (0 to 1) of the whole text; a null or empty text has the base score, and a very long one counts
    by all its distinct tokens, which a worker holds one text at a time. Repeated rows get the same score each. Other columns are passed
    on, but for one named toxicity; the score looks at the text alone. One pass over the texts without a shuffle."""
    model = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        begin("toxicity")
        own = model.value
        give_back()  # of the batch before
        return pa.array([own.score(t.as_py()) for t in texts], pa.float64())

    return docs.withColumn("toxicity", scored(text_or_empty()))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with a score under threshold, columns as given."""
    names = docs.columns
    (aside,) = fresh(names, "_toxicity")
    scorer = train(docs, labels)
    hidden = docs.withColumnRenamed("toxicity", aside)
    kept = score(hidden, scorer).filter(F.col("toxicity") < threshold).drop("toxicity")
    return kept.withColumnRenamed(aside, "toxicity").select(*names)
