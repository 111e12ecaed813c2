"""Toxicity by a learned lexicon, Levenshtein automata and context windows.

Terms (words, and beginnings of words) that stand out in toxic training texts form a trie. The Levenshtein automaton of one
edit runs on all branches of the trie at once; its product is determinised as words ask for it, so misspelled terms are found
in one pass over each distinct word. Words of at least ``FUZZY`` letters may differ by an edit, beginnings by none. Around
each hit a window of characters tells whether it stands in a quotation, beside words of reporting, or addresses someone;
what each of these is worth is learned: a logistic regression joins the sums of all hits and those of each context.

Training sees at most ``SAMPLE`` labelled documents of each class (those with the smallest hashes of their ids); with fold
selection, only rows whose crc32(doc_id) mod 3 is not 1. Of rows that repeat a doc_id one text teaches. Labels other than 0 and 1 are left out; of several labels of one
document the highest counts. Text is the only input of a score. Null and empty texts get the score of a text without hits.
Without labels of both classes every score is the rate of toxic labels, or 0. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import load, stage

WORDS = re.compile(r"[^\W_]+")
#: Most labelled documents of a class, most terms, fewest training texts with a term, letters from which one edit is allowed.
SAMPLE, TERMS, LEAST, FUZZY = 4000, 400, 4, 5
STEMS = range(4, 9)
NEAR = 40
#: Coefficients before training, in the order of the features: terms, beginnings, misspelled terms, the best, distinct words,
#: density, whether any term or beginning, and the sums in quotations, beside reporting and in address.
PRIOR = (1.0, 1.0, 0.5, 0.0, 0.0, 0.0, 0.0, 0.0, -0.3, -0.2, 0.2)
CACHE = 500_000
#: Cues of the context windows.
OPEN, CLOSE, EITHER = "“«„", "”»", '"'
REPORT = {"said", "says", "called", "word", "term", "quote", "quoted", "wrote", "dit", "mot", "sagte", "wort", "dijo", "palabra"}
ADDRESS = {"you", "your", "youre", "u", "tu", "toi", "vous", "du", "dich", "dein", "usted", "eres"}


def train_fold(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 != 1, F.lit(True))


# ------------------------------------------------------------------ automaton


class Lexicon:
    """A trie of weighted terms; a term that ends in ``*`` is the beginning of a word."""

    def __init__(self, weights: dict[str, float]):
        self.children, self.word, self.stem = [{}], [None], [None]
        for term, weight in weights.items():
            node = 0
            for c in term.rstrip("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.word.append(None)
                    self.stem.append(None)
                node = self.children[node][c]
            (self.stem if term.endswith("*") else self.word)[node] = (weight, len(term))
        self.sets: list[frozenset] = []
        self.ids: dict[frozenset, int] = {}
        self.stems: list[float] = []
        self.ends: list[tuple] = []
        self.steps: dict[tuple[int, str], int] = {}
        self.start = self._state({(0, 0)})

    def _state(self, items: set) -> int:
        todo = list(items)
        while todo:  # a letter of the term may be missing in the word
            node, edits = todo.pop()
            if edits == 0:
                for child in self.children[node].values():
                    if (child, 1) not in items:
                        items.add((child, 1))
        items = frozenset(x for x in items if x[1] == 0 or (x[0], 0) not in items)
        if items not in self.ids:
            self.ids[items] = len(self.sets)
            self.sets.append(items)
            self.stems.append(max((self.stem[n][0] for n, e in items if e == 0 and self.stem[n]), default=0.0))
            exact = max((self.word[n][0] for n, e in items if e == 0 and self.word[n]), default=0.0)
            fuzzy = max((self.word[n][0] for n, e in items if e == 1 and self.word[n] and self.word[n][1] >= FUZZY), default=0.0)
            self.ends.append((exact, fuzzy))
        return self.ids[items]

    def _step(self, state: int, c: str) -> int:
        out = set()
        for node, edits in self.sets[state]:
            child = self.children[node].get(c)
            if child is not None:
                out.add((child, edits))
            if edits == 0:
                out.add((node, 1))
                out.update((x, 1) for x in self.children[node].values())
        to = self.steps[state, c] = self._state(out) if out else -1
        return to

    def match(self, word: str) -> tuple[int, float] | None:
        """(kind, weight): 0 a term, 1 a beginning, 2 a misspelled term."""
        state, stem = self.start, 0.0
        steps = self.steps
        for c in word:
            to = steps.get((state, c))
            state = self._step(state, c) if to is None else to
            if state < 0:
                break
            if self.stems[state] > stem:
                stem = self.stems[state]
        exact, fuzzy = self.ends[state] if state >= 0 else (0.0, 0.0)
        if exact:
            return 0, exact
        if stem:
            return 1, stem
        return (2, fuzzy) if fuzzy else None


class _Known(dict):
    def __init__(self, lexicon: Lexicon):
        self.lexicon = lexicon

    def __missing__(self, word: str):
        if len(self) > CACHE:
            self.clear()
        self[word] = found = self.lexicon.match(word)
        return found


def context(text: str, start: int, end: int) -> tuple[bool, bool, bool]:
    """Whether the hit stands in a quotation, beside words of reporting, beside words that address someone.

    A quotation has begun in the window before the hit and ends in the one after it. Apostrophes are no quotation marks.
    """
    before, after = text[max(0, start - NEAR) : start], text[end : end + NEAR]
    begun = max(map(before.rfind, OPEN)) > max(map(before.rfind, CLOSE)) and any(c in after for c in (*CLOSE, "“"))
    quoted = begun or (before.count(EITHER) % 2 == 1 and EITHER in after)
    around = set(WORDS.findall(before)) | set(WORDS.findall(after))
    return quoted, bool(around & REPORT), bool(around & ADDRESS)


def features(text: str | None, known: _Known) -> np.ndarray:
    text = (text or "").lower()
    words = WORDS.findall(text)
    sums, near, best, distinct = [0.0, 0.0, 0.0], [0.0, 0.0, 0.0], 0.0, set()
    if any(map(known.__getitem__, set(words))):
        for m in WORDS.finditer(text):
            hit = known[m.group()]
            if hit:
                kind, weight = hit
                sums[kind] += weight
                for i, holds in enumerate(context(text, m.start(), m.end())):
                    near[i] += weight * holds
                best = max(best, weight)
                distinct.add(m.group())
    return np.array([*np.log1p(sums), best, np.log1p(len(distinct)), 100 * sum(sums) / (len(words) + 20), float(sums[0] > 0), float(sums[1] > 0), *np.log1p(near)])


# ------------------------------------------------------------------ learning


def _count(frames):
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for f in frames:
        for text, toxic in zip(f["text"], f["toxic"], strict=True):
            own = set()
            for w in set(WORDS.findall((text or "").lower())):
                own.add(w)
                own.update(f"{w[:k]}*" for k in STEMS if k < len(w))
            counts[int(toxic)].update(own)
    terms = list(counts[0].keys() | counts[1].keys())
    for i in range(0, len(terms), 100_000):
        some = terms[i : i + 100_000]
        yield pd.DataFrame({"term": some, "pos": [counts[1][t] for t in some], "neg": [counts[0][t] for t in some]})


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge regression towards ``PRIOR``: what training texts do not show keeps a sensible sign."""
    x = np.hstack([x, np.ones((len(x), 1))])
    prior = np.array([*PRIOR, 0.0])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6

    def loss(w):
        return np.logaddexp(0, x @ w).sum() - y @ (x @ w) + (penalty * (w - prior) ** 2).sum() / 2

    w, now = np.zeros(x.shape[1]), loss(np.zeros(x.shape[1]))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, x.T @ (y - p) - penalty * (w - prior))
        while (new := loss(w + step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        w, gain, now = w + step, now - new, new
        if gain < 1e-9:
            break
    return w


class Model:
    def __init__(self, weights: dict[str, float], coefficients: np.ndarray):
        self.weights, self.coefficients = weights, coefficients

    def scorer(self):
        known = _Known(Lexicon(self.weights))
        return lambda text: float(1 / (1 + np.exp(-np.clip(features(text, known) @ self.coefficients[:-1] + self.coefficients[-1], -30, 30))))


def learn(docs: DataFrame, labels: DataFrame, folds: bool = True) -> Model:
    clean = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter("doc_id is not null and toxic in (0, 1)")
    if folds:
        clean = clean.filter(train_fold())
    clean = clean.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    some = [clean.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for c in (0, 1)]
    sample = some[0].union(some[1])  # at most 2 * SAMPLE rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    # of rows that repeat a doc_id one text teaches, so the sample keeps its bound
    texts = texts.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    texts = stage(texts.select("text", "toxic"), "toxic").repartition(8)
    sizes = {r[0]: r[1] for r in texts.groupBy("toxic").count().collect()}
    n, p = sizes.get(0, 0), sizes.get(1, 0)
    rate = p / (n + p) if n + p else 0.0
    flat = Model({}, np.array([0.0] * len(PRIOR) + [np.log(rate / (1 - rate)) if 0 < rate < 1 else 30.0 if rate else -30.0]))
    if not n or not p:
        return flat
    counts = texts.mapInPandas(_count, "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    a, b = F.col("pos") / p, (F.col("neg") + 0.5) / n
    both = (F.col("pos") + F.col("neg")) / (n + p)
    strength = (F.col("pos") / p - F.col("neg") / n) / F.sqrt(both * (1 - both) * (1 / n + 1 / p) + F.lit(1e-12))
    found = counts.filter((F.col("pos") >= LEAST) & (a >= 5 * b)).withColumn("odds", F.log(a / b)).withColumn("z", strength).filter("z >= 4").orderBy(F.desc("z"), F.col("term").endswith("*"), "term").limit(TERMS)
    weights: dict[str, float] = {}
    seen: dict[str, int] = {}
    for r in found.collect():
        body = r["term"].rstrip("*")
        if body != r["term"] and any(n == r["pos"] and w.startswith(body) for w, n in seen.items()):
            continue  # the beginning of one word only: the word itself also catches its misspellings
        seen[r["term"]] = r["pos"]
        if not any(f"{body[:k]}*" in weights for k in STEMS if k <= len(body)):
            weights[r["term"]] = float(r["odds"])
    if not weights:
        return flat

    def measure(frames):
        known = _Known(Lexicon(weights))
        for f in frames:
            x = np.array([features(t, known) for t in f["text"]]).reshape(-1, len(PRIOR))
            yield pd.DataFrame({"x": list(x), "toxic": f["toxic"].astype("int32")})

    rows = texts.mapInPandas(measure, "x array<double>, toxic int").toPandas()  # at most 2 * SAMPLE rows of a few numbers
    return Model(weights, _logistic(np.stack(rows["x"].to_numpy()), rows["toxic"].to_numpy(float)))


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the score of each text as another column."""
    held = []

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not held:
            held.append(model.scorer())
        return texts.map(held[0], na_action=None).astype(float) if len(texts) else pd.Series([], dtype=float)

    return docs.withColumn(name, score(F.col("text").cast("string")))


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``doc_id, held_out, score, predicted``, a row for each row of ``docs``."""
    scored = with_score(docs.select("doc_id", "text"), learn(docs, labels))
    return scored.select("doc_id", (~train_fold()).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
