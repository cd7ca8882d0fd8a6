"""Language ID by interpolated Kneser-Ney character models.

For each language the n-grams of characters inside words (up to ``ORDER``, with marks where a word
begins and ends) are counted on the executors over a sample of labelled documents of about
``SAMPLE_ROWS`` for each language, chosen by a hash of the id; every language that a label names gets a model.
One task for each language turns its counts into interpolated Kneser-Ney probabilities, held as sorted arrays of
64-bit hashes beside their logarithms; all n-grams of the sample stay, so that a model's probabilities sum to one.
The driver sees the arrays only: 12 bytes for each n-gram, which the sample bounds.

A text's cross-entropy in a language is the sum over its letters' log-probabilities divided by their
number; the lowest wins.  As n-grams stay inside words, a word's sums are looked up once and
kept for the next time in a bounded cache; all words of a text count.

Calibration: a fifth of the sample is not counted but scored, whole and in pieces of 1, 2, 4, .. words from
either end, so that texts of every length are represented.  It gives the sharpness with which differences in
cross-entropy turn into a probability, and for each language and length class (powers of two of letters) the
cross-entropy above which a text is rejected as no text of any learned language: where an exponential tail that is
fitted to the highest tenth of the class leaves a share of ``REJECTED`` of true texts.  ``REJECTED`` is thus the
expected rate of false rejections.  The score is the probability, lowered by how far above the limit a text lies.

Defined results: a null text, or one without letters, is ``und`` with score 0 and rejected; without
labelled documents every text is ``und``; ties go to the first language by code point; repeated rows
and null ids keep their rows; very long texts are read whole; other columns are never looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import documents, short_batches, slices

ORDER = 5
SAMPLE_ROWS = 2000
WORDS_KEPT = 150_000
#: Models whose arrays are searched together.
MODELS_AT_ONCE = 4
BEGIN, END = "^", "$"
NONE = "und"
#: Of a text's letters so many count towards certainty: beyond them, evidence is taken as repeated.
CERTAIN_AT = 60
#: The share of true texts that may be rejected, and the share of a length class whose tail is fitted.
REJECTED, TAIL = 1e-6, 0.1
#: Length classes: the floor of log2 of the letters, the last one for all longer texts.  A class with fewer held-out texts takes the next shorter one's limit.
CLASSES, CLASS_LEAST = 20, 30
HOLD = 5
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
CONTEXT = np.uint64(0xC2B2AE3D27D4EB4F)


def parts(word: str) -> list[str]:
    """The runs of letters of a lower-case word."""
    return [word] if word.isalpha() else "".join(c if c.isalpha() else " " for c in word).split()


def _grams(words: Counter) -> Counter:
    """Counts of the longest n-gram that ends at each character (shorter ones begin a word)."""
    found: Counter = Counter()
    for word, n in words.items():
        for part in parts(word):
            s = BEGIN + part + END
            for i in range(1, len(s)):
                found[s[max(0, i - ORDER + 1) : i + 1]] += n
    return found


@dataclass
class Model:
    """One language: sorted hashes of n-grams and of contexts, their logarithms, and the last resort."""

    keys: np.ndarray
    logs: np.ndarray
    unseen: float


@dataclass
class Identifier:
    """All languages with their calibration."""

    languages: list[str]
    models: list[Model]
    sharpness: float
    limits: np.ndarray  # a row for each language, a column for each length class


def _hash(codes: np.ndarray) -> np.ndarray:
    """One hash for each row of character codes."""
    h = np.zeros(len(codes), np.uint64)
    for k in range(codes.shape[1]):
        h = h * MULTIPLIER + codes[:, k].astype(np.uint64) + np.uint64(1)
    return h


def kneser_ney(grams: dict[str, int]) -> Model:
    """Interpolated Kneser-Ney over counts of longest n-grams, as back-off tables of logarithms.

    N-grams are rows of character codes and are told apart by their hashes, as in the finished model, so that a
    model is made in little more memory than it takes.
    """
    names = np.array(list(grams), f"<U{ORDER}")
    number = np.fromiter(grams.values(), np.int64, len(grams))
    every = names.view(np.uint32).reshape(len(names), -1) if len(names) else np.zeros((0, ORDER), np.uint32)
    sizes = np.char.str_len(names)
    levels: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    codes, counts = np.zeros((0, ORDER), np.uint32), np.zeros(0, np.int64)
    for k in range(ORDER, 0, -1):  # of shorter n-grams it counts how many different characters stand before them
        own = sizes == k
        codes = np.concatenate((every[own, :k], codes[:, :k]))
        _, first, place = np.unique(_hash(codes), return_index=True, return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate((number[own], counts)), minlength=len(first))
        levels[k] = codes[first], counts
        codes, counts = codes[first][:, 1:], np.ones(len(first), np.int64)
    alphabet = len(levels[1][1]) + 1
    keys, logs = [], []
    below_keys, below = np.zeros(1, np.uint64), np.full(1, 1.0 / alphabet)
    for k in range(1, ORDER + 1):
        codes, n = levels[k]
        ones, twos = int((n == 1).sum()), int((n == 2).sum())
        cut = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
        contexts, of = np.unique(_hash(codes[:, :-1]), return_inverse=True)
        total, kinds = np.bincount(of, weights=n, minlength=len(contexts)), np.bincount(of, minlength=len(contexts))
        back = cut * kinds / total
        lower = below[np.searchsorted(below_keys, _hash(codes[:, 1:]))]  # every n-gram's end is an n-gram of the level below
        prob = np.maximum(n - cut, 0.0) / total[of] + back[of] * lower
        own = _hash(codes)
        keys += [own, contexts ^ CONTEXT]
        logs += [np.log(prob), np.log(back)]
        order = np.argsort(own)
        below_keys, below = own[order], prob[order]
    flat = np.concatenate(keys)
    order = np.argsort(flat)
    return Model(flat[order], np.concatenate(logs)[order].astype(np.float32), float(np.log(1.0 / alphabet)))


class Tables:
    """The sorted hash arrays of a few models as one: a row of logarithms for each hash, NaN where a model lacks it."""

    def __init__(self, models: list[Model]):
        self.keys = np.unique(np.concatenate([m.keys for m in models]))
        self.logs = np.full((len(self.keys), len(models)), np.nan, np.float32)
        for j, m in enumerate(models):
            self.logs[np.searchsorted(self.keys, m.keys), j] = m.logs
        self.unseen = np.array([m.unseen for m in models])

    def find(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where((self.keys[at] == hashes)[:, None], self.logs[at], np.nan)

    def score(self, hashes: list[np.ndarray], place: np.ndarray) -> np.ndarray:
        """A row of log-probabilities for each character but the first of a run; ``hashes`` by the n-gram's length."""
        log = np.zeros((len(place), len(self.unseen)))
        open_ = np.repeat((place > 0)[:, None], len(self.unseen), axis=1)  # of which models a shorter n-gram is still looked for
        for k in range(ORDER, 0, -1):
            rows = np.flatnonzero((place >= max(1, k - 1)) & open_.any(axis=1))
            values, wanted = self.find(hashes[k][rows]), open_[rows]
            missed = wanted & np.isnan(values)
            log[rows] += np.where(wanted & ~missed, values, 0.0)
            short = missed.any(axis=1)
            again = rows[short]
            contexts = hashes[k - 1][again - 1] if k > 1 else np.zeros(len(again), np.uint64)
            log[again] += np.where(missed[short], np.nan_to_num(self.find(contexts ^ CONTEXT)), 0.0)
            open_[rows] = missed
        return log + open_ * self.unseen


def tables(models: list[Model]) -> list[Tables]:
    return [Tables(models[k : k + MODELS_AT_ONCE]) for k in range(0, len(models), MODELS_AT_ONCE)]


def score_words(words: list[str], known: list[Tables]) -> np.ndarray:
    """For each word: log-probabilities summed, a column for each model, and last the number of characters."""
    runs, owner = [], []
    for i, w in enumerate(words):
        for p in parts(w):
            runs.append(BEGIN + p + END), owner.append(i)
    out = np.zeros((len(words), sum(len(t.unseen) for t in known) + 1))
    if not runs:
        return out
    sizes = np.fromiter(map(len, runs), np.int64, len(runs))
    chars = np.frombuffer("".join(runs).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    place = np.arange(len(chars)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    hashes = [np.zeros(len(chars), np.uint64)]
    for _ in range(ORDER):
        before = np.concatenate((np.zeros(1, np.uint64), hashes[-1][:-1]))
        hashes.append(before * MULTIPLIER + chars)
    who = np.repeat(np.array(owner), sizes)
    column = 0
    for t in known:
        for logs in t.score(hashes, place).T:
            out[:, column] = np.bincount(who, weights=logs, minlength=len(words))
            column += 1
    out[:, -1] = np.bincount(who, weights=place > 0, minlength=len(words))
    return out


class Scorer:
    """Cross-entropies of texts, with a bounded cache of words."""

    def __init__(self, models: list[Model], kept: int = WORDS_KEPT):
        self.models, self.kept = tables(models), kept
        self.place: dict[str, int] = {}
        self.table = np.zeros((kept // 8, len(models) + 1))

    def totals(self, texts: list[str]) -> np.ndarray:
        """One row a text: the sums of log-probabilities and the number of characters."""
        return np.concatenate([np.zeros((0, self.table.shape[1])), *map(self._totals, slices(texts))])

    def _totals(self, texts: list[str]) -> np.ndarray:
        if len(self.place) > self.kept:
            self.place = dict(islice(self.place.items(), self.kept // 2))  # the oldest words are the most frequent ones
        cut = [t.lower().split() for t in texts]
        new = set()
        for words in cut:
            new.update(words)
        fresh = [w for w in new if w not in self.place]
        if fresh:
            base = len(self.place)
            while base + len(fresh) > len(self.table):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            for k in range(0, len(fresh), 20_000):
                some = fresh[k : k + 20_000]
                self.table[base + k : base + k + len(some)] = score_words(some, self.models)
            self.place.update(zip(fresh, range(base, base + len(fresh)), strict=True))
        get = self.place.__getitem__
        out = np.zeros((len(texts), self.table.shape[1]))
        for i, words in enumerate(cut):
            if words:
                at = np.fromiter(map(get, words), np.int64, len(words))
                out[i] = np.take(self.table, at, axis=0).sum(axis=0)
        return out


def length_class(letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(np.int64), CLASSES - 1)


def decide(totals: np.ndarray, known: Identifier) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, rejected) for rows of ``Scorer.totals``."""
    n = totals[:, -1]
    some = (n > 0) & bool(known.models)
    if not known.models:
        return [NONE] * len(totals), np.zeros(len(totals)), np.ones(len(totals), bool)
    entropy = -totals[:, :-1] / np.maximum(n, 1)[:, None]
    best = entropy.argmin(axis=1)
    low = entropy[np.arange(len(n)), best]
    sure = np.minimum(n, CERTAIN_AT) * known.sharpness
    p = 1 / np.exp(-np.minimum(700, (entropy - low[:, None]) * sure[:, None])).sum(axis=1)
    above = np.maximum(0, low - known.limits[best, length_class(n)])
    score = np.where(some, p * np.exp(-2 * above), 0.0)
    names = [known.languages[b] if s else NONE for b, s in zip(best, some, strict=True)]
    return names, np.clip(score, 0, 1), ~some | (above > 0)


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 3: rows of remainder 1 are held out of all learning."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Identifier:
    """Models and calibration from the labelled documents that are not held out."""
    spark = docs.sparkSession
    short_batches(spark)
    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(id_col) != 1)).select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sizes = labelled.groupBy("lang").count().collect()
    if not sizes:
        return Identifier([], [], 1.0, np.zeros((0, CLASSES)))
    rates = spark.createDataFrame([(r["lang"], min(1.0, sample_rows / r["count"])) for r in sizes], "of string, rate double")
    draw = F.pmod(F.xxhash64(F.lit(4), "id"), F.lit(1 << 30)) / float(1 << 30)
    # a number for each language, where the models that all workers get hold some 10,000 n-grams: so no text is shuffled
    sample = labelled.join(F.broadcast(rates), F.col("lang") == F.col("of")).filter(draw < F.col("rate")).select("id", "text", "lang")
    held = F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(HOLD)) == 0

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, part in b.groupby("lang"):
                words: Counter = Counter()
                for t in part["text"]:
                    words.update(t.lower().split())
                grams = _grams(words)
                yield pd.DataFrame({"lang": lang, "gram": list(grams), "n": list(grams.values())})

    def model(frame: pd.DataFrame) -> pd.DataFrame:
        m = kneser_ney(dict(zip(frame["gram"], frame["n"].tolist(), strict=True)))
        return pd.DataFrame({"lang": [frame["lang"].iloc[0]], "keys": [m.keys.tobytes()], "logs": [m.logs.tobytes()], "unseen": [m.unseen]})

    counted = sample.filter(~held).mapInPandas(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    made = sorted(counted.groupBy("lang").applyInPandas(model, "lang string, keys binary, logs binary, unseen double").collect(), key=lambda r: r["lang"])
    models = [Model(np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["logs"], np.float32), r["unseen"]) for r in made]
    languages = [r["lang"] for r in made]
    return _calibrated(Identifier(languages, models, 1.0, np.full((len(languages), CLASSES), np.inf)), sample.filter(held))


def pieces(text: str) -> list[str]:
    """The text and its first and last 1, 2, 4, .. words."""
    words = text.split()
    cuts = [2**k for k in range(len(words).bit_length()) if 2**k < len(words)]
    return [text, *[" ".join(words[:k]) for k in cuts], *[" ".join(words[-k:]) for k in cuts]]


def tail_limit(values: np.ndarray, rejected: float = REJECTED, tail: float = TAIL) -> float:
    """The value that a share ``rejected`` exceeds, by an exponential tail over the highest ``tail`` of the values."""
    start = float(np.quantile(values, 1 - tail))
    over = values[values > start] - start
    return start + (float(over.mean()) if len(over) else 0.0) * float(np.log(tail / rejected))


def class_limits(entropy: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """A limit for each length class from the cross-entropies of one language's true texts."""
    classes = length_class(letters)
    limits = np.full(CLASSES, np.inf)
    for k in range(CLASSES):
        own = entropy[classes == k]
        limits[k] = tail_limit(own) if len(own) >= CLASS_LEAST else limits[k - 1] if k else np.inf
    return limits


def _calibrated(known: Identifier, held: DataFrame) -> Identifier:
    spark = held.sparkSession
    shared = spark.sparkContext.broadcast(known)

    def totals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value.models)
        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                found = scorer.totals(pieces(text))
                yield pd.DataFrame({"lang": lang, "whole": np.arange(len(found)) == 0, "totals": list(found)})

    rows = held.mapInPandas(totals, "lang string, whole boolean, totals array<double>").filter("totals[size(totals) - 1] > 0").collect()
    if not rows or not known.models:
        return known
    place = {x: i for i, x in enumerate(known.languages)}
    rows = [r for r in rows if r["lang"] in place]
    table = np.array([r["totals"] for r in rows]).reshape(-1, len(known.models) + 1)
    true = np.array([place[r["lang"]] for r in rows], np.int64)
    whole = np.array([r["whole"] for r in rows], bool)
    n = table[:, -1]
    entropy = -table[:, :-1] / n[:, None]
    mine = entropy[np.arange(len(true)), true]
    limits = np.stack([class_limits(mine[true == i], n[true == i]) for i in range(len(known.languages))])
    gap = ((entropy - entropy.min(axis=1, keepdims=True)) * np.minimum(n, CERTAIN_AT)[:, None])[whole]
    losses = {}
    for sharp in np.geomspace(0.05, 2.0, 20):
        logp = -gap * sharp
        logp -= np.log(np.exp(logp).sum(axis=1, keepdims=True))
        losses[float(sharp)] = -float(logp[np.arange(len(gap)), true[whole]].mean()) if len(gap) else 0.0
    return Identifier(known.languages, known.models, min(losses, key=losses.get), limits)


def identify(docs: DataFrame, known: Identifier, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, lang_pred, score, rejected; and the columns in ``keep``."""
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(known)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("seen"), *[F.col(k).alias(f"in_{k}") for k in keep])
    fields = [f for f in narrow.schema.fields if f.name != "seen"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", lang_pred string, score double, rejected boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value.models)
        for b in batches:
            names, score, rejected = decide(scorer.totals(b["seen"].fillna("").tolist()), shared.value)
            yield b.drop(columns="seen").assign(lang_pred=names, score=score, rejected=rejected)

    return narrow.mapInPandas(run, schema)


def op4_query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = identify(docs, train(docs))
    return found.select(F.col("id").alias("doc_id"), (fold("id") == 1).alias("held_out"), "lang_pred", "score", "rejected")


def accepted(docs: DataFrame) -> DataFrame:
    """The documents whose language is not rejected.

    Only texts go to Python, and only the verdict comes back: all columns of the documents stay in the JVM.
    """
    known = train(docs)
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(known)

    @F.pandas_udf("boolean")
    def rejected(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value.models)
        for texts in batches:
            yield pd.Series(decide(scorer.totals(texts.fillna("").tolist()), shared.value)[2])

    return docs.filter(~rejected(F.col("text").cast("string")))
