"""Toxicity by Levenshtein automata intersected with a lexicon trie, and context windows.

Lexicon.  Terms are words, and beginnings of words, that labelled toxic documents hold far more often
than the others; they are counted on the executors over at most about ``SAMPLE_ROWS`` labelled
documents chosen by a hash of the id.  All terms that pass the tests are kept: as each must be in a
share of ``LEAST_SHARE`` of the toxic documents, their number is at most a document's terms over that share.

Matching.  The trie of terms is intersected with the Levenshtein automaton of each term: a state is a
set of (trie node, edits so far), made deterministic as words are read and kept for the next
word.  Terms of ``FUZZY_FROM`` letters or more may be ``EDITS`` insertions, deletions or substitutions off.
A word's answer (term and edits) is kept in a bounded cache.

Context.  Each hit is weighed by the ``WINDOW`` words around it: quotation marks that are open at the
hit or words that report speech count as quotation.  Exact, misspelled and quoted
hits are separate features of a document, beside the share of its words that are hits; a logistic regression over
them, fitted to the sample's labels, gives the score.

Defined results: null and empty texts score like any text without hits; without labels, or with one
class only, the lexicon is empty and the score is the share of toxic labels (0.5 of none); repeated rows
and null ids keep their rows; very long texts are read whole; other columns are never looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import documents, short_batches
from .language_id import fold

SAMPLE_ROWS = 20_000
#: A term must be in this share of toxic documents at least, in so many of them, and so much likelier there.
LEAST_SHARE, LEAST_DOCS, LEAST_RATIO = 0.004, 5, 12.0
STEMS = (4, 5, 6, 7)
EDITS = 1
FUZZY_FROM = 5
WINDOW = 6
STATES_KEPT = 200_000
WORDS_KEPT = 400_000
THRESHOLD = 0.7
OPENING, CLOSING = "\"“«„‘'(", "\"”»“’')"
#: Words that report what somebody said or wrote.
REPORTING = frozenset("said says say wrote writes quoted quote called calls word term phrase sagte sagt schrieb zitat wort dijo dice escribió cita palabra dit écrit mot citation".split())
STRIP = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum()) + "“”«»„‘’…–—¿¡"


@dataclass
class Lexicon:
    """Terms with their weights; a term that ends in ``*`` stands for all words that begin with it."""

    weights: dict[str, float]


class Matcher:
    """The deterministic product of the terms' trie with their Levenshtein automata, made on demand."""

    def __init__(self, lexicon: Lexicon):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]  # the whole word that ends at the node
        self.begun: list[str | None] = [None]  # the stem that ends there; a node can have both
        self.fuzzy: list[bool] = [False]  # whether a term that may be misspelled lies at or below the node
        for term in sorted(lexicon.weights):
            stem, whole = term.rstrip("*"), not term.endswith("*")
            node, path = 0, [0]
            for c in stem:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({}), self.ends.append(None), self.begun.append(None), self.fuzzy.append(False)
                node = self.children[node][c]
                path.append(node)
            (self.ends if whole else self.begun)[node] = term
            if len(stem) >= FUZZY_FROM and whole:
                for x in path:
                    self.fuzzy[x] = True
        self.words: dict[str, tuple[str, int] | None] = {}
        self.clear()

    def clear(self):
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.stems: list[str | None] = []
        self.start = self._state(self._closed({(0, 0)}))

    def _closed(self, pairs: set) -> frozenset:
        """With letters of the trie that the word leaves out; of two states at a node the one with fewer edits."""
        best: dict[int, int] = {}
        todo = sorted(pairs, key=lambda x: x[1])
        while todo:
            node, edits = todo.pop(0)
            if best.get(node, 99) <= edits:
                continue
            best[node] = edits
            if edits < EDITS:
                todo += [(child, edits + 1) for child in self.children[node].values() if self.fuzzy[child]]
        return frozenset(best.items())

    def _state(self, pairs: frozenset) -> int:
        if pairs in self.ids:
            return self.ids[pairs]
        # a stem is matched to the letter, and any letters may follow
        stem = next((self.begun[node] for node, edits in pairs if edits == 0 and self.begun[node] is not None), None)
        words = ((edits, self.ends[node]) for node, edits in pairs if self.ends[node] is not None)
        word = min(((e, t) for e, t in words if e == 0 or len(t) >= FUZZY_FROM), default=None)
        self.ids[pairs] = len(self.sets)
        self.sets.append(pairs), self.steps.append({})
        self.accepts.append((word[1], word[0]) if word else None)
        self.stems.append(stem)
        return self.ids[pairs]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, edits in self.sets[state]:
            child = self.children[node].get(c)
            if child is not None and (edits == 0 or self.fuzzy[child]):
                out.add((child, edits))
            if edits < EDITS and self.fuzzy[node]:
                out.add((node, edits + 1))
                out.update((x, edits + 1) for x in self.children[node].values() if self.fuzzy[x])
        to = self._state(self._closed(out)) if out else -1
        self.steps[state][c] = to
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        """The best term for a lower-case word, with its edits; None if there is none."""
        state, stem = self.start, None
        for c in word:
            stem = self.stems[state] or stem
            to = self.steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if state < 0:
                return (stem, 0) if stem else None
        found, stem = self.accepts[state], self.stems[state] or stem
        # a whole word to the letter, then the longest stem, then a misspelled word
        return (stem, 0) if stem and (found is None or found[1]) else found

    def of(self, token: str) -> tuple[str, int] | None:
        """The answer for a token as it stands in a text, from the cache where it is known."""
        if token in self.words:
            return self.words[token]
        if len(self.words) > WORDS_KEPT:
            self.words.clear()
        if len(self.sets) > STATES_KEPT:
            self.clear()
        found = self.match(token.strip(STRIP).lower())
        self.words[token] = found
        return found


def _quoted(tokens: list[str], at: int) -> bool:
    """Whether a hit stands in quotation marks or beside a word that reports speech."""
    token = tokens[at]
    before, after = tokens[max(0, at - WINDOW) : at], tokens[at + 1 : at + 1 + WINDOW]
    if any(t.strip(STRIP).lower() in REPORTING for t in before + after):
        return True
    opened = token[:1] in OPENING or any(t[:1] in OPENING and t[-1:] not in CLOSING for t in before)
    closed = token.rstrip(".,;:!?")[-1:] in CLOSING or any(t.rstrip(".,;:!?")[-1:] in CLOSING and t[:1] not in OPENING for t in after)
    return opened and closed


FEATURES = 5


def features(text: str, matcher: Matcher, lexicon: Lexicon) -> np.ndarray:
    """1, exact hits, misspelled hits, quoted hits (weights, damped), share of words that are hits."""
    tokens = text.split()
    out = np.zeros(FEATURES)
    out[0] = 1.0
    answer, words = matcher.of, matcher.words
    hits = [i for i, t in enumerate(tokens) if (words[t] if t in words else answer(t)) is not None]
    for i in hits:
        term, edits = answer(tokens[i])
        weight = lexicon.weights[term]
        out[3 if _quoted(tokens, i) else 2 if edits else 1] += weight
    out[1:4] = np.log1p(out[1:4])
    out[4] = math.log1p(100.0 * len(hits) / len(tokens)) if tokens else 0.0
    return out


def _terms(text: str) -> set[str]:
    found = set()
    for t in set(text.split()):
        w = t.strip(STRIP).lower()
        if len(w) >= 3:
            found.add(w)
            found.update(w[:k] + "*" for k in STEMS if len(w) > k)
    return found


def learn_lexicon(sample: DataFrame, toxic: int, clean: int) -> Lexicon:
    """(text, toxic) rows -> the terms that stand out in toxic ones."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen = [Counter(), Counter()]
            for text, label in zip(b["text"], b["toxic"], strict=True):
                seen[int(label)].update(_terms(text))
            # a term of clean documents alone never stands out
            for part in range(0, len(seen[1]), 100_000):
                terms = list(seen[1])[part : part + 100_000]
                yield pd.DataFrame({"term": terms, "bad": [seen[1][t] for t in terms], "good": [seen[0][t] for t in terms]})
            rest = [t for t in seen[0] if t not in seen[1]]
            for part in range(0, len(rest), 100_000):
                terms = rest[part : part + 100_000]
                yield pd.DataFrame({"term": terms, "bad": 0, "good": [seen[0][t] for t in terms]})

    least = max(LEAST_DOCS, LEAST_SHARE * toxic)
    ratio = ((F.col("bad") + 0.5) / (toxic + 1.0)) / ((F.col("good") + 0.5) / (clean + 1.0))
    counts = sample.mapInPandas(count, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    rows = counts.filter(F.col("bad") >= least).withColumn("ratio", ratio).filter(F.col("ratio") >= LEAST_RATIO).collect()
    return Lexicon({r["term"]: math.log(r["ratio"]) for r in rows})


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps, with a penalty on all weights but the first."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - penalty * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Detector:
    lexicon: Lexicon
    weights: np.ndarray


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> Detector:
    """Lexicon and weights from labelled documents that are not held out."""
    spark = docs.sparkSession
    short_batches(spark)
    open_labels = labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & (fold(id_col) != 1)).select(F.col(id_col).alias("l_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    n = open_labels.count()
    rate = min(1.0, sample_rows / max(1, n))
    # at most about sample_rows labels: small enough to send to all executors, so that no text is shuffled
    drawn = open_labels.filter(F.pmod(F.xxhash64(F.lit(7), "l_id"), F.lit(1 << 30)) < int(rate * (1 << 30))).groupBy("l_id").agg(F.max("toxic").alias("toxic"))
    known = drawn.collect()
    toxic = sum(r["toxic"] for r in known)
    if not toxic or toxic == len(known):
        share = toxic / len(known) if known else 0.5
        return Detector(Lexicon({}), np.array([math.log((share + 1e-3) / (1 - share + 1e-3)), *[0.0] * (FEATURES - 1)]))
    small = spark.createDataFrame([(r["l_id"], r["toxic"]) for r in known], drawn.schema)
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).filter("text is not null").join(F.broadcast(small), F.col("id") == F.col("l_id")).select("text", "toxic")
    lexicon = learn_lexicon(sample, toxic, len(known) - toxic)
    shared = spark.sparkContext.broadcast(lexicon)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(shared.value)
        for b in batches:
            yield pd.DataFrame({"toxic": b["toxic"], "x": [features(t, matcher, shared.value) for t in b["text"]]})

    rows = sample.mapInPandas(measure, "toxic int, x array<double>").collect()
    x, y = np.array([r["x"] for r in rows]).reshape(-1, FEATURES), np.array([r["toxic"] for r in rows], float)
    return Detector(lexicon, fit(x, y) if len(y) else np.zeros(FEATURES))


def score_documents(docs: DataFrame, known: Detector, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, score."""
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, weights = shared.value.lexicon, shared.value.weights
        matcher = Matcher(lexicon)
        for b in batches:
            x = np.array([features(t, matcher, lexicon) for t in b["text"].fillna("")]).reshape(-1, FEATURES)
            yield pd.DataFrame({"id": b["id"].array, "score": 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))})

    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInPandas(run, "id long, score double").withColumnRenamed("id", id_col)


def op5_query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    known = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_documents(docs, known)
    return scored.select("doc_id", (fold("doc_id") == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
