"""Benchmark decontamination by latent semantic retrieval, longest common subsequences and answer checks.

1. Items are words (lower-cased, cut at blanks and ASCII punctuation); their vocabulary is the space. Document frequencies
   over the passages (``PASSAGE`` words) of all documents give the idf weights.
2. A distributed randomised SVD of the TF-IDF passages finds the latent space: workers send each term's row of A'AG for a
   random matrix G, taken over the items and the passages of all documents; the driver takes the left singular vectors.
3. Windows of each document, about as long as the items (one size for each power of two, a quarter apart), are compared with
   the items by cosine in the latent space. Windows hold sums of word vectors, so one running sum serves all sizes.
   Beside it, whatever the weights, every window that has enough of an item's words to pass step 4 is a candidate.
4. Candidates are checked by the longest common subsequence of words, bit-parallel, in the window and a quarter around it.
   A share of ``SURE`` of the item's words decides; from ``LIKELY`` on (paraphrases) half of the answer, the item's last
   fifth, must be there too. Items of fewer than ``FEW`` words need all their words.

Items of null or blank text are never found. Null and empty documents are clean. Equal scores go to the smaller item_id.
Repeated items count once each; repeated documents give repeated rows. The items' vocabulary goes to every worker, so items
are taken in blocks of ``BLOCK`` words and a document's results are joined. Empty tables give no rows, or clean documents.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WHITESPACE, doc_slices, hash_words, load, separators, utf8, word_bounds

SEP = separators(*WHITESPACE, *range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127))
PASSAGE, RANK, OVER = 64, 96, 16
#: Least weight of a term in the search.
FLOOR = 0.01
COSINE, CONTAINS = 0.45, 0.4
SURE, LIKELY, FEW = 0.8, 0.65, 4
BLOCK = 500_000
#: Terms of passages whose vectors are summed at once, few enough for a core's cache.
HELD = 4096
#: Bits of a word's hash that are looked up before the vocabulary is searched.
PREFIX = 20


class Index:
    """Items, their vocabulary and the latent vectors of both."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = items
        self.vocabulary = np.unique(np.concatenate([w for _, w in items]))
        self.vectors = np.zeros((len(self.vocabulary), 1), np.float32)
        # most words of a text are in no item: a table over some bits of the hash tells at once
        self.maybe = np.zeros(1 << PREFIX, bool)
        self.maybe[self.vocabulary >> np.uint64(64 - PREFIX)] = True

    def terms(self, words: np.ndarray) -> np.ndarray:
        """The place of each word in the vocabulary, or -1."""
        out = np.full(len(words), -1, np.int64)
        some = np.flatnonzero(self.maybe[words >> np.uint64(64 - PREFIX)])
        at = np.minimum(np.searchsorted(self.vocabulary, words[some]), len(self.vocabulary) - 1)
        hit = self.vocabulary[at] == words[some]
        out[some[hit]] = at[hit]
        return out

    def fit(self, df: np.ndarray, passages: int, sketch: np.ndarray, test: np.ndarray) -> None:
        idf = np.maximum(FLOOR, np.log((passages + 1) / (df + 1.0)))
        own = np.zeros_like(sketch)
        for _, w in self.items:
            t, n = np.unique(self.terms(w), return_counts=True)
            own[t] += n[:, None] * (n @ test[t])
        # items weigh as much as the documents do
        ratio = np.linalg.norm(sketch) / max(np.linalg.norm(own), 1e-9)
        y = idf[:, None] * (sketch + max(1.0, ratio) * own)
        basis, s, _ = np.linalg.svd(y, full_matrices=False)
        rank = int(min(RANK, (s > 1e-9 * max(s[0], 1e-9)).sum()))
        self.vectors = (idf[:, None] * basis[:, : max(1, rank)]).astype(np.float32)
        self.sizes: dict[int, list] = {}
        for i, (_, w) in enumerate(self.items):
            y = self.vectors[self.terms(w)].sum(axis=0)
            if len(w) < FEW:
                self.sizes.setdefault(0, []).append((i, y))
            else:
                self.sizes.setdefault(1 << (len(w) - 1).bit_length(), []).append((i, y))
        self.groups = {k: (np.array([i for i, _ in v]), np.stack([y for _, y in v])) for k, v in self.sizes.items()}
        self._postings()
        self.masks = []
        for _, w in self.items:
            m: dict[int, int] = {}
            for i, x in enumerate(w.tolist()):
                m[x] = m.get(x, 0) | 1 << i
            self.masks.append(m)
        self.often = [{x: m.bit_count() for x, m in own.items()} for own in self.masks]

    def _postings(self) -> None:
        """For each term the items that have it, how often, and the words that a match of each item takes."""
        own = [np.unique(self.terms(w), return_counts=True) for _, w in self.items]
        term = np.concatenate([t for t, _ in own])
        order = np.argsort(term, kind="stable")
        self.own = [t for t, _ in own]
        self.holders = np.repeat(np.arange(len(own)), [len(t) for t in self.own])[order]
        self.times = np.concatenate([n for _, n in own])[order]
        self.first = np.searchsorted(term[order], np.arange(len(self.vocabulary) + 1))
        self.need = np.array([np.ceil(LIKELY * len(w) - 1e-9) if len(w) >= FEW else np.inf for _, w in self.items])
        self.size = [1 << (len(w) - 1).bit_length() for _, w in self.items]

    def holding(self, terms: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Items with the starts of all windows that hold enough of their words."""
        here = np.unique(terms[at])
        n = self.first[here + 1] - self.first[here]
        rows = np.repeat(self.first[here] - np.cumsum(n) + n, n) + np.arange(n.sum())
        have = np.bincount(self.holders[rows], self.times[rows], len(self.items))
        for i in np.flatnonzero(have >= self.need):
            places = at[np.isin(terms[at], self.own[i])]
            size = self.size[i]
            step = max(1, size // 4)
            starts = np.arange(0, max(1, len(terms) - size + step), step)
            inside = np.searchsorted(places, starts + size + size // 4) - np.searchsorted(places, starts - size // 4)
            yield int(i), starts[inside >= self.need[i]]

    def score(self, item: int, words: list[int]) -> float:
        """The item's share that the words hold in order; 0 if it does not decide."""
        n, masks = len(self.items[item][1]), self.masks[item]
        full = (1 << n) - 1
        v = full
        for w in words:
            m = masks.get(w, 0)
            if m:
                u = v & m
                v = ((v + u) | (v - u)) & full
        found = n - bin(v).count("1")
        share = found / n
        if n < FEW:
            return share if share == 1.0 else 0.0
        if share >= SURE:
            return share
        if share < LIKELY:
            return 0.0
        tail = self.items[item][1][-max(1, n // 5) :].tolist()
        have = set(words)
        return share if 2 * sum(x in have for x in tail) >= len(tail) else 0.0

    def search(self, words: np.ndarray) -> dict[int, float]:
        """Item -> score of those that one document holds."""
        terms = self.terms(words)
        found: dict[int, float] = {}
        at = np.flatnonzero(terms >= 0)
        if not len(at):
            return found
        listed = None
        done: set[tuple[int, int]] = set()
        # no other words have a part in a subsequence
        held_words, held_at = words[at].tolist(), at.tolist()

        def check(i: int, s: int) -> None:
            if found.get(i) == 1.0 or (i, s) in done:
                return
            done.add((i, s))
            size = self.size[i]
            window = held_words[bisect_left(held_at, s - size // 4) : bisect_left(held_at, s + size + size // 4)]
            own = self.often[i]
            if sum(own[w] for w in own.keys() & set(window)) < self.need[i]:  # no subsequence is longer
                return
            score = self.score(i, window)
            if score > found.get(i, 0.0):
                found[i] = score

        held = [(i, starts) for i, starts in self.holding(terms, at) if len(starts)]
        for i, starts in held:
            for s in starts.tolist():
                check(i, s)
        sums = None
        for size, (items, vectors) in self.groups.items():
            if size == 0:
                wanted = [i for i in items if np.isin(self.items[i][1], words).all()]
                for i in wanted:
                    n = len(self.items[i][1])
                    listed = listed if listed is not None else words.tolist()
                    own = self.items[i][1].tolist()
                    if n and any(listed[s : s + n] == own for s in np.flatnonzero(words == self.items[i][1][0])):
                        found[int(i)] = 1.0
                continue
            if not held:  # no window has the words that a score takes
                continue
            if sums is None:
                sums = np.zeros((len(at) + 1, self.vectors.shape[1]), np.float32)
                np.cumsum(self.vectors[terms[at]], axis=0, out=sums[1:])
            step = max(1, size // 4)
            starts = np.arange(0, max(1, len(words) - size + step), step)
            a, b = np.searchsorted(at, starts), np.searchsorted(at, starts + size)
            few = b > a
            starts, a, b = starts[few], a[few], b[few]
            norms = np.linalg.norm(vectors, axis=1)
            for lo in range(0, len(starts), 2048):
                x = sums[b[lo : lo + 2048]] - sums[a[lo : lo + 2048]]
                length = np.linalg.norm(x, axis=1)
                long = np.flatnonzero(length >= CONTAINS * norms.min())
                if not len(long):
                    continue
                dot = x[long] @ vectors.T
                hits = np.argwhere((dot >= COSINE * length[long, None] * norms) & (dot >= CONTAINS * norms * norms))
                for row, column in hits:
                    check(int(items[column]), int(starts[lo + long[row]]))
        return found


def documents(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The word hashes of each row."""
    for lo, hi in doc_slices(offsets):
        part, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, words = word_bounds(part, off, SEP)
        h = hash_words(part, starts, ends)
        for a, b in zip(words[:-1], words[1:], strict=True):
            yield h[a:b]


def _statistics(index: Index, test: np.ndarray):
    """Rows (term, df, z0 ...): a worker's document frequencies and its share of A'AG."""
    names = ["term", "df", *(f"z{i}" for i in range(test.shape[1]))]
    own = test.astype(np.float32)

    def add(z: np.ndarray, keys: list[np.ndarray], counts: list[np.ndarray]) -> None:
        """Adds A'AG of some passages; keys (passage * terms + term) rise."""
        key, n = np.concatenate(keys), len(index.vocabulary)
        count, term, passage = np.concatenate(counts).astype(np.float32)[:, None], key % n, key // n
        new = np.concatenate([[True], passage[1:] != passage[:-1]])
        sums = np.add.reduceat(count * own[term], np.flatnonzero(new), axis=0)
        order = np.argsort(term, kind="stable")
        term, at = term[order], (np.cumsum(new) - 1)[order]
        cuts = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
        z[term[cuts]] += np.add.reduceat(count[order] * sums[at], cuts, axis=0)

    def run(batches):
        n = len(index.vocabulary)
        df, z, total = np.zeros(n, np.int64), np.zeros((n, test.shape[1])), 0
        for batch in batches:
            met = [np.zeros(0, np.int64)]
            keys, counts, held = [], [], 0
            for words in documents(*utf8(batch.column("text"))):
                t = index.terms(words)
                at = np.flatnonzero(t >= 0)
                first, total = total, total + -(-len(words) // PASSAGE)
                if not len(at):
                    continue
                key, count = np.unique((first + at // PASSAGE) * n + t[at], return_counts=True)
                met.append(key % n)
                keys.append(key)
                counts.append(count)
                held += len(key)
                if held >= HELD:
                    add(z, keys, counts)
                    keys, counts, held = [], [], 0
            if held:
                add(z, keys, counts)
            df += np.bincount(np.concatenate(met), minlength=n)
        rows = np.flatnonzero(df)
        sums = np.concatenate([z[rows], np.zeros((1, test.shape[1]))])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(rows, -1)), pa.array(np.append(df[rows], total)), *map(pa.array, sums.T.copy())], names)

    return run, ", ".join(["term long", "df long", *(f"{x} double" for x in names[2:])])


def build(docs: DataFrame, items: list[tuple[int, np.ndarray]]) -> Index:
    """Statistics come back as one row for each term of the items, whatever the corpus."""
    index = Index(items)
    k = min(RANK + OVER, max(2, 2 * len(items)))
    test = np.random.default_rng(7).standard_normal((len(index.vocabulary), k))
    run, schema = _statistics(index, test)
    rows = docs.select("text").mapInArrow(run, schema)
    sums = rows.groupBy("term").agg(F.sum("df").alias("df"), *(F.sum(f"z{i}").alias(f"z{i}") for i in range(k))).toPandas()
    passages = int(sums.loc[sums["term"] < 0, "df"].sum())
    sums = sums[sums["term"] >= 0]
    df, z = np.zeros(len(index.vocabulary), np.int64), np.zeros(test.shape)
    df[sums["term"].to_numpy()] = sums["df"].to_numpy()
    z[sums["term"].to_numpy()] = sums[[f"z{i}" for i in range(k)]].to_numpy()
    index.fit(df, passages, z, test)
    return index


def blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Items as word hashes, in blocks of at most ``BLOCK`` words (or one item), by id."""
    held, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("item_id is not null and text is not null").orderBy("item_id", "text").toLocalIterator():
        words = next(documents(*utf8(pa.array([r[1]], pa.large_string()))), np.zeros(0, np.uint64))
        if not len(words):
            continue
        if held and size + len(words) > BLOCK:
            yield held
            held, size = [], 0
        held.append((r[0], words))
        size += len(words)
    if held:
        yield held


def with_matches(docs: DataFrame, benchmark: DataFrame, name: str = "matches") -> DataFrame:
    """``docs`` with one more column, for each row the (item_id, score) that its text holds, best first."""
    texts = docs.select(F.col("text").cast("string").alias("text")).filter("text is not null")
    columns = []
    for items in blocks(benchmark):
        columns.append(_searcher(build(texts, items))(F.col("text").cast("string")))
    empty = F.array().cast("array<struct<item_id:bigint,score:double>>")
    return docs.withColumn(name, F.concat(empty, *columns) if columns else empty)


def _searcher(index: Index):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64())]))

    @F.arrow_udf("array<struct<item_id:bigint,score:double>>")
    def search(texts: pa.Array) -> pa.Array:
        out = []
        for words in documents(*utf8(texts)):
            found = index.search(words)
            out.append([{"item_id": index.items[i][0], "score": s} for i, s in sorted(found.items(), key=lambda x: (-x[1], index.items[x[0]][0]))])
        return pa.array(out, kind)

    return search


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, contaminated, item_id, score, n_items``, a row for each row of ``docs``."""
    found = with_matches(docs.select("doc_id", "text"), benchmark)
    # the best match, ties to the smaller item
    best = F.array_max(F.transform("matches", lambda m: F.struct(m["score"].alias("score"), (-m["item_id"]).alias("minus"))))
    found = found.select("doc_id", F.size("matches").cast("long").alias("n_items"), best.alias("best"))
    return found.select("doc_id", (F.col("n_items") > 0).alias("contaminated"), (-F.col("best.minus")).alias("item_id"), F.coalesce("best.score", F.lit(0.0)).alias("score"), "n_items")


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    return decontaminate(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
