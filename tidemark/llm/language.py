"""Language by a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

A text's letters (Unicode letters and their marks), lower-cased, with one blank for whatever stands between two words, are
read as UTF-8 bytes from both ends, across words. The network gives every byte position a probability for each language; a
document's probabilities are the mean over all its positions. States start anew every ``SPAN`` bytes, so that windows of one
length, of any texts, run as one batch; whole texts are read.

Training sees texts of about ``SAMPLE`` documents of each language, by hash of the id, and at most ``WINDOWS`` pieces of
``PIECES`` bytes of each language, by hash of the piece, so no language crowds out another; with fold selection, only
documents whose crc32(doc_id) mod 3 is not 1. Null and empty languages teach nothing. Without any language, every prediction
is ``und``. ``und`` with score 0 is also the prediction for null texts and texts without letters. At most ``MOST`` languages
are learned; more raise an error. Repeated rows give repeated results. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import load, sampled, stage
from .toxicity import train_fold

LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
#: Sampled documents and training pieces of a language, most languages, bytes of a window, bytes of training pieces.
SAMPLE, WINDOWS, MOST, SPAN, PIECES = 400, 6000, 256, 64, (64, 24, 12)
HIDDEN, EMBED, STEPS, BATCH = 12, 12, 400, 192
#: Bytes that are read at a time, and floats of one batch's probabilities.
SLICE, CELLS = 4 << 20, 1 << 22


class Network:
    """Two gated recurrent layers, one for each direction, and a softmax at every position."""

    def __init__(self, classes: int, seed: int = 1):
        r = np.random.default_rng(seed)
        w = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": w(256, EMBED) * 4, "b": np.zeros(classes, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": w(EMBED, 3 * HIDDEN), f"U{d}": w(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32), f"O{d}": w(HIDDEN, classes)}

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool):
        """States (time, row, hidden) in reading order of direction d."""
        n, t = x.shape
        u, k = self.p[f"U{d}"], HIDDEN
        table = self.p["E"] @ self.p[f"W{d}"] + self.p[f"c{d}"]
        h = np.zeros((n, k), np.float32)
        out, saved = np.zeros((t, n, k), np.float32), []
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            a, g = table[x[:, i]], h @ u
            zr = 1 / (1 + np.exp(-(a[:, : 2 * k] + g[:, : 2 * k])))
            z, r = zr[:, :k], zr[:, k:]
            c = np.tanh(a[:, 2 * k :] + r * g[:, 2 * k :])
            m = mask[:, i, None]
            new = h + m * (1 - z) * (c - h)
            if keep:
                saved.append((i, h, z, r, c, g[:, 2 * k :], m))
            h = out[i] = new
        return out, saved

    def _states(self, d: str, x: np.ndarray):
        """States of direction d over windows of equal length (time, row), in reading order, one step at a time."""
        t, n = x.shape
        u, k = self.p[f"U{d}"], HIDDEN
        table = self.p["E"] @ self.p[f"W{d}"] + self.p[f"c{d}"]
        h = np.zeros((n, k), np.float32)
        a, g = np.empty((n, 3 * k), np.float32), np.empty((n, 3 * k), np.float32)
        for i in range(t) if d == "f" else range(t - 1, -1, -1):
            np.take(table, x[i], axis=0, out=a, mode="clip")
            np.matmul(h, u, out=g)
            zr = a[:, : 2 * k] + g[:, : 2 * k]
            np.negative(zr, out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            c = g[:, 2 * k :] * zr[:, k:]
            c += a[:, 2 * k :]
            np.tanh(c, out=c)
            h = c + zr[:, :k] * (h - c)
            yield i, h

    def positions(self, x: np.ndarray) -> np.ndarray:
        """(time, row, class): probabilities at every position of windows of equal length, given as (time, row) bytes."""
        s = np.empty((*x.shape, len(self.p["b"])), np.float32)
        for i, h in self._states("f", x):
            np.matmul(h, self.p["Of"], out=s[i])
        for i, h in self._states("b", x):
            s[i] += h @ self.p["Ob"]
        s += self.p["b"]
        s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(axis=2, keepdims=True)
        return s

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Mean loss over the positions, and its gradient by backpropagation through time."""
        runs = {d: self._run(d, x, mask, True) for d in "fb"}
        s = sum(runs[d][0] @ self.p[f"O{d}"] for d in "fb") + self.p["b"]
        s = np.exp(s - s.max(axis=2, keepdims=True))
        s /= s.sum(axis=2, keepdims=True)
        weight = mask.T[:, :, None] / mask.sum()
        loss = float(-(np.log(s[:, np.arange(len(y)), y] + 1e-9) * weight[:, :, 0]).sum())
        delta = s.copy()
        delta[:, np.arange(len(y)), y] -= 1
        delta *= weight
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["b"] = delta.sum(axis=(0, 1))
        k = HIDDEN
        for d in "fb":
            states, saved = runs[d]
            u = self.p[f"U{d}"]
            g[f"O{d}"] = np.tensordot(states, delta, ((0, 1), (0, 1)))
            back = delta @ self.p[f"O{d}"].T
            dh = np.zeros((len(y), k), np.float32)
            table = np.zeros((256, 3 * k), np.float32)
            for i, h, z, r, c, gn, m in reversed(saved):
                dh = dh + back[i]
                dc = dh * m * (1 - z) * (1 - c * c)
                dz = dh * m * (h - c) * z * (1 - z)
                dr = dc * gn * r * (1 - r)
                da = np.concatenate([dz, dr, dc], axis=1)
                dg = np.concatenate([dz, dr, dc * r], axis=1)
                np.add.at(table, x[:, i], da)
                g[f"U{d}"] += h.T @ dg
                dh = dh * (1 - m * (1 - z)) + dg @ u.T
            g[f"W{d}"] = self.p["E"].T @ table
            g[f"c{d}"] = table.sum(axis=0)
            g["E"] = g["E"] + table @ self.p[f"W{d}"].T
        return loss, g

    def train(self, runs: list[bytes], labels: np.ndarray, weights: np.ndarray, steps: int = STEPS, seed: int = 2) -> list[float]:
        r = np.random.default_rng(seed)
        chance = weights / weights.sum()
        m, v, losses = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, []
        for i in range(1, steps + 1):
            at = r.choice(len(runs), min(BATCH, len(runs)), p=chance)
            x, mask = padded([runs[j] for j in at])
            loss, g = self.gradients(x, mask, labels[at])
            losses.append(loss)
            rate = 0.02 * min(1, i / 30) * (1 - i / (steps + 1)) + 1e-4
            for k, gk in g.items():
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.99 * v[k] + 0.01 * gk * gk
                self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-7)).astype(np.float32)
        return losses


def padded(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, runs))
    x = np.frombuffer(b"".join(b.ljust(t, b"\0") for b in runs), np.uint8).reshape(len(runs), t)
    return x, (np.arange(t) < np.array([len(b) for b in runs])[:, None]).astype(np.float32)


def letters(text: str | None) -> bytes:
    """The bytes that the network reads of a text."""
    return " ".join(LETTERS.findall(text.lower())).encode("utf-8", "replace") if text else b""


def pool(network: Network, texts: list[bytes]) -> np.ndarray:
    """(text, class): for each text the sum of its positions' probabilities."""
    classes = len(network.p["b"])
    out = np.zeros((len(texts), classes))
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = -(-sizes // SPAN)
    of = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.repeat(np.cumsum(sizes) - sizes, counts) + place * SPAN
    lengths = np.minimum(SPAN, np.repeat(sizes, counts) - place * SPAN)
    for t in np.unique(lengths):
        rows = np.flatnonzero(lengths == t)
        step = max(1, min(2048, CELLS // (int(t) * classes)))
        for i in range(0, len(rows), step):
            some = rows[i : i + step]
            x = data[starts[some] + np.arange(t)[:, None]]
            np.add.at(out, of[some], network.positions(x).sum(axis=0))
    return out


def label_positions(network: Network, langs: list[str], text: str) -> list[str]:
    """The language of every byte position of ``letters(text)``."""
    data = np.frombuffer(letters(text), np.uint8)
    return [langs[k] for i in range(0, len(data), SPAN) for k in network.positions(data[i : i + SPAN, None])[:, 0].argmax(axis=1)]


def read(network: Network, texts: list[str | None]):
    """For each text the mean probabilities of its positions, or None without letters."""
    found = [letters(t) for t in texts]
    at = 0
    while at < len(found):
        end, size = at, 0
        while end < len(found) and (end == at or size + len(found[end]) <= SLICE):
            size += len(found[end])
            end += 1
        for b, p in zip(found[at:end], pool(network, found[at:end]), strict=True):
            yield p / len(b) if b else None
        at = end


def _pieces(frames):
    """Rows (lang, piece): texts cut into pieces of each length in turn."""
    for f in frames:
        for text, lang in zip(f["text"], f["lang"], strict=True):
            b, at, out = letters(text), 0, []
            while at < len(b):
                size = PIECES[len(out) % len(PIECES)]
                out.append(b[at : at + size])
                at += size
            if out:
                yield pd.DataFrame({"lang": lang, "piece": out})


def learn(docs: DataFrame, folds: bool = True) -> tuple[Network | None, list[str]]:
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter("text is not null and lang is not null and lang <> ''")
    if folds:
        rows = rows.filter(train_fold("id"))
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().limit(MOST + 1).collect()}
    if len(sizes) > MOST:
        raise ValueError(f"more than {MOST} languages")
    langs = sorted(sizes)
    if not langs:
        return None, []
    share = F.create_map(*(F.lit(x) for k in langs for x in (k, min(1.0, SAMPLE / sizes[k]))))
    some = stage(rows.filter(sampled(share[F.col("lang")], "id")).select("text", "lang"), "languages").repartition(8)
    own = Window.partitionBy("lang").orderBy(F.xxhash64("piece"), "piece")
    pieces = some.mapInPandas(_pieces, "lang string, piece binary").withColumn("_n", F.row_number().over(own)).filter(F.col("_n") <= WINDOWS).select("lang", "piece").collect()  # MOST * WINDOWS short rows at most
    if not pieces:
        return None, []
    labels = np.array([langs.index(lang) for lang, _ in pieces])
    weights = 1.0 / np.bincount(labels, minlength=len(langs))[labels]  # languages count alike
    network = Network(len(langs))
    network.train([bytes(b) for _, b in pieces], labels, weights)
    return network, langs


def identify_language(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``, a row for each row of ``docs``."""
    network, langs = learn(docs)

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found, scores = [], []
            for p in read(network, texts) if network else [None] * len(texts):
                found.append("und" if p is None else langs[int(p.argmax())])
                scores.append(0.0 if p is None else float(min(1.0, p.max())))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(found, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~train_fold()).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    return identify_language(load(spark, sf_dir, "documents"))
