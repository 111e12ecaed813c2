"""Removal of byte strings that an earlier document also has, by difference-cover suffix sorting.

A byte goes if it lies in a string of ``length`` bytes that also starts in a document with a smaller doc_id. Sorting every
suffix of the corpus would shuffle many times its size, so the strings that can repeat are found first, exactly:

1. The smallest k-gram hash of a window of ``length`` bytes depends on the window alone (its anchor), and neighbouring
   windows mostly share it. Anchors that only one distinct text has cannot belong to a repeated window.
2. For the other anchors each text gives the stretches of windows with that anchor. Equal stretches are one entry with their
   smallest doc_id, so a passage that a third of all documents holds is one row for each task.
3. Stretches with one anchor meet. Where they differ, the difference-cover algorithm sorts their suffixes: triples of the
   sample positions are sorted and named, the names are sorted by recursion, the other suffixes merged in, and neighbouring
   suffixes are compared over ``length`` bytes. Each run of equal prefixes takes its smallest doc_id.
   An anchor with ``HOT`` stretches or more, as a passage in very many different surroundings has, goes window by window
   instead: windows meet by 128 bits of hash in partial minima, so no task holds the anchor's stretches.
4. Windows whose smallest doc_id is below their document's go; documents are joined with their ranges.

Copies of a whole text need none of this: all but the smallest doc_id lose every byte, if the text has ``length`` bytes.

Null and empty texts have no bytes. Rows with a null doc_id take no part and stay whole. Rows that repeat a doc_id are not
earlier than each other. Strings are judged on the input. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import _BYTES, bucket_labels, by_bucket, doc_slices, load, mix, parts, planes, sampled, stage, unplanes, utf8

_U = np.uint64
#: Bytes of a k-gram; windows may be at most GRAM + 63 bytes long.
GRAM = 24
CHUNK = 12 << 20
PIECE = 4 << 20
#: Ids of at most so many bytes are broadcast to narrow a scan; beyond, the join shuffles.
SMALL = 8 << 20
#: Stretches of an anchor from which its windows are spread over all tasks.
HOT = 50_000
#: Stretches of an anchor that show whether it has ``HOT``.
LOOK = 1000


# ------------------------------------------------------------------ suffix array


def suffix_array(s: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Positions of the suffixes of s (integers of at least 1) in ascending order.

    With ``depth``, suffixes that agree on so many symbols may stand in any order.
    """
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    p = np.concatenate([s.astype(np.int64), np.zeros(4, np.int64)])
    i1 = np.arange(1, n + (n % 3 == 1), 3)
    i2 = np.arange(2, n + (n % 3 == 1), 3)
    sample = np.concatenate([i1, i2])
    names, count = _names(p, sample)
    if count == len(sample) or depth is not None and depth <= 3:
        order = np.argsort(names, kind="stable")
    else:
        order = suffix_array(names, None if depth is None else -(-depth // 3))
    rank = np.zeros(n + 4, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    i0 = np.arange(0, n, 3)
    big = np.int64(len(sample) + 2)
    a0 = i0[np.argsort(p[i0] * big + rank[i0 + 1])]
    both = sample[order]
    both = both[both < n]
    a1, a2 = both[both % 3 == 1], both[both % 3 == 2]
    # suffixes in any order among their like leave keys that are not quite sorted
    count_below = lambda theirs, mine: np.maximum.accumulate(np.searchsorted(np.sort(theirs), mine)) if len(mine) else np.zeros(0, np.int64)
    below1 = count_below(p[a1] * big + rank[a1 + 1], p[a0] * big + rank[a0 + 1])
    top = np.int64(p.max() + 1)
    _, pair = np.unique(np.concatenate([p[a2] * top + p[a2 + 1], p[a0] * top + p[a0 + 1]]), return_inverse=True)
    below2 = count_below(pair[: len(a2)] * big + rank[a2 + 2], pair[len(a2) :] * big + rank[a0 + 2])
    out = np.empty(n, np.int64)
    at = np.arange(len(a0)) + below1 + below2
    rest = np.ones(n, bool)
    rest[at] = False
    out[at] = a0
    out[rest] = both
    return out


def _names(p: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks, from 1, of the triples that start at these positions."""
    top = np.int64(p.max() + 1)
    if top <= 1 << 8:
        key = (p[at] * top + p[at + 1]) * top + p[at + 2]
        there = np.zeros(int(top) ** 3, bool)
        there[key] = True
        rank = np.cumsum(there)
        return rank[key], int(rank[-1])
    if top < 1 << 20:
        key = (p[at] * top + p[at + 1]) * top + p[at + 2]
    else:
        key = np.unique(p[at] * top + p[at + 1], return_inverse=True)[1] * top + p[at + 2]
    found, names = np.unique(key, return_inverse=True)
    return names + 1, len(found)


def window_minima(texts: list[bytes], owners: np.ndarray, length: int) -> list[np.ndarray]:
    """For each text, the smallest owner of each of its windows, over all texts that hold the same window."""
    sizes = np.array([len(t) for t in texts])
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    raw = np.frombuffer(b"\x00".join(texts) + b"\x00", np.uint8)
    used = np.bincount(raw, minlength=256) > 0
    s = (np.cumsum(used) + 1)[raw]
    ends = starts[1:] - 1
    s[ends] = 1
    owner = np.repeat(owners, sizes + 1)
    left = np.repeat(ends, sizes + 1) - np.arange(len(s))
    sa = suffix_array(s, length)
    sa = sa[left[sa] >= length]
    new = np.ones(len(sa), bool)
    view = np.lib.stride_tricks.sliding_window_view(raw, length)
    for a in range(1, len(sa), 1 << 16):
        b = min(len(sa), a + (1 << 16))
        new[a:b] = (view[sa[a:b]] != view[sa[a - 1 : b - 1]]).any(axis=1)
    best = np.zeros(len(s), np.int64)
    if len(sa):
        heads = np.flatnonzero(new)
        best[sa] = np.repeat(np.minimum.reduceat(owner[sa], heads), np.diff(np.concatenate([heads, [len(sa)]])))
    return [best[a : a + max(0, n - length + 1)] for a, n in zip(starts, sizes, strict=False)]


# ------------------------------------------------------------------ anchors


def anchors(data: np.ndarray, length: int, places: bool = False) -> np.ndarray:
    """For each window, the smallest hash (48 bits) of its k-grams; with ``places`` also where that k-gram starts."""
    if len(data) < length:
        return (np.zeros(0, _U), np.zeros(0, np.int64)) if places else np.zeros(0, _U)
    gram = min(GRAM, length)
    base, size, at = _BYTES[data], 1, 0
    radix = 0x9E3779B97F4A7C15
    h = None
    left, step = gram, base
    while left:
        if left & 1:
            if h is None:
                h = step
            else:
                n = len(data) - (at + size) + 1
                h = h[:n] * _U(pow(radix, size, 1 << 64)) + step[at : at + n]
            at += size
        left >>= 1
        if left:
            step = step[:-size] * _U(pow(radix, size, 1 << 64)) + step[size:]
            size *= 2
    h = h[: len(data) - gram + 1]
    h = (h ^ (h >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    width, have = length - gram + 1, 1
    if places:  # the low bits, which the hash leaves out, carry the place
        h = (h & ~_U(63)) | (np.arange(len(h), dtype=_U) & _U(63))
    while have < width:
        step = min(have, width - have)
        h = np.minimum(h[:-step], h[step:])
        have += step
    if not places:
        return h >> _U(16)
    at = np.arange(len(h))
    return h >> _U(16), at + (((h & _U(63)).astype(np.int64) - at) & 63)


def pieces(data: np.ndarray, offsets: np.ndarray, length: int):
    """(first row, bytes, offsets, start in the row) of stretches that hold every window once."""
    for lo, hi in doc_slices(offsets, 1 << 19):
        a, b = int(offsets[lo]), int(offsets[hi])
        if hi - lo > 1 or b - a <= PIECE:
            yield lo, data[a:b], offsets[lo : hi + 1] - a, 0
            continue
        for at in range(0, max(1, b - a - length + 1), PIECE):
            part = data[a + at : min(b, a + at + PIECE + length - 1)]
            yield lo, part, np.array([0, len(part)]), at


def _valid(offsets: np.ndarray, length: int) -> np.ndarray:
    """Whether a window that starts here ends in the same row."""
    n = int(offsets[-1])
    ok = np.ones(n + 1, np.int8)
    for b in offsets[1:]:
        ok[max(0, b - length + 1) : b] = 0
    return ok[: max(0, n - length + 1)].astype(bool)


def text_id(b: bytes) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(b)).astype(np.int64))


FACTS = "doc_id long, jid long, tid long, n_bytes long, sha string"


def _facts(batches):
    for batch in batches:
        data, offsets = utf8(batch.column("text"))
        rows = []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            text = data[a:b].tobytes()
            rows.append((text_id(text), len(text), hashlib.sha256(text).hexdigest()))
        t, n, s = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("jid"), pa.array(t, pa.int64()), pa.array(n, pa.int64()), pa.array(s, pa.string())], ["doc_id", "jid", "tid", "n_bytes", "sha"])


def _blobs(kind: int, bucket: np.ndarray, h: np.ndarray, t: np.ndarray):
    for pid, at in by_bucket(bucket):
        ids, which = np.unique(t[at], return_inverse=True)
        head = np.array([kind, len(at), len(ids)], np.int64).tobytes()
        yield pid, b"".join([head, planes(h[at]), planes(which.astype(np.uint32)), planes(ids)])


def _entries(length: int, pids: int):
    """Rows (pid, blob): anchors that one text of a chunk has, with the text, by anchor; shared ones also by text."""

    def flush(h, t):
        h, t = np.concatenate(h), np.concatenate(t)
        order = np.lexsort((t, h))
        h, t = h[order], t[order]
        fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])])
        h, t = h[fresh], t[fresh]
        heads = np.concatenate([[True], h[1:] != h[:-1]])
        alone = heads & np.concatenate([heads[1:], [True]])
        shared = ~alone
        by_anchor = lambda x: (x >> _U(24)).astype(np.int64) % pids
        labels = bucket_labels(pids)
        rows = list(_blobs(0, by_anchor(h[alone]), h[alone], t[alone]))
        first = heads & shared
        rows += _blobs(1, by_anchor(h[first]), h[first], t[first])
        rows += _blobs(2, t[shared] % pids, h[shared], t[shared])
        return pa.RecordBatch.from_arrays([pa.array([labels[r[0]] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["pid", "blob"])

    def run(batches):
        hs, ts, held = [], [], 0
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            tids = np.array([text_id(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.int64)
            for lo, part, off, _ in pieces(data, offsets, length):
                m = anchors(part, length)
                at = np.flatnonzero(_valid(off, length)) if len(m) else np.zeros(0, int)
                if not len(at):
                    continue
                m = m[at]
                keep = np.concatenate([[True], (m[1:] != m[:-1]) | (at[1:] != at[:-1] + 1)])
                at = at[keep]
                hs.append(m[keep])
                ts.append(tids[lo + np.searchsorted(off, at, "right") - 1])
                held += len(part)
                if held >= CHUNK:
                    yield flush(hs, ts)
                    hs, ts, held = [], [], 0
        if hs:
            yield flush(hs, ts)

    return run


def _repeated(pids: int):
    """Of a partition's entries, the anchors that more than one text has, with their texts, packed by text."""

    def run(batches):
        cols = {0: ([], []), 1: ([], []), 2: ([], [])}
        for batch in batches:
            for blob in batch.column("blob"):
                b = memoryview(blob.as_buffer())
                kind, n, k = (int(x) for x in np.frombuffer(b, np.int64, 3))
                ids = unplanes(b, np.int64, k, 24 + 12 * n)
                cols[kind][0].append(unplanes(b, _U, n, 24))
                cols[kind][1].append(ids[unplanes(b, np.uint32, n, 24 + 8 * n)])
        (h, t), (hm, _), (hl, tl) = ((np.concatenate(x) if x else np.zeros(0, d) for x, d in zip(c, (_U, np.int64), strict=True)) for c in cols.values())
        order = np.lexsort((t, h))
        h, t = h[order], t[order]
        if len(h):
            fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (t[1:] != t[:-1])])
            h, t = h[fresh], t[fresh]
            same = h[1:] == h[:-1]
            keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            hm = np.unique(hm)
            if len(hm):
                at = np.minimum(np.searchsorted(hm, h), len(hm) - 1)
                keep |= hm[at] == h
            h, t = h[keep], t[keep]
        hs, ts = np.concatenate([h, hl]), np.concatenate([t, tl])
        labels, rows = bucket_labels(pids), []
        for pid, at in by_bucket((mix(ts.view(_U)) >> _U(1)).astype(np.int64) % pids):
            rows.append((labels[pid], b"".join([np.array([len(at)], np.int64).tobytes(), planes(hs[at]), planes(ts[at])])))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["pid", "blob"])

    return run


def _known(batches):
    """One row for each text with all its repeated anchors."""
    hs, ts = [], []
    for batch in batches:
        for blob in batch.column("blob"):
            b = memoryview(blob.as_buffer())
            n = int(np.frombuffer(b, np.int64, 1)[0])
            hs.append(unplanes(b, _U, n, 8))
            ts.append(unplanes(b, np.int64, n, 8 + 8 * n))
    if not hs:
        return
    hs, ts = np.concatenate(hs), np.concatenate(ts)
    order = np.lexsort((hs, ts))
    hs, ts = hs[order], ts[order]
    fresh = np.ones(len(hs), bool)
    fresh[1:] = (hs[1:] != hs[:-1]) | (ts[1:] != ts[:-1])
    hs, ts = hs[fresh], ts[fresh]
    first = np.ones(len(ts), bool)
    first[1:] = ts[1:] != ts[:-1]
    heads = np.flatnonzero(first)
    ends = np.concatenate([heads[1:], [len(ts)]])
    for i in range(0, len(heads), 5000):
        yield pa.RecordBatch.from_arrays([pa.array(ts[heads[i : i + 5000]]), pa.array([hs[a:b].tobytes() for a, b in zip(heads[i : i + 5000], ends[i : i + 5000], strict=True)], pa.binary())], ["tid", "hs"])


# ------------------------------------------------------------------ stretches

STRETCHES = "kind int, anchor long, k int, doc_id long, nth int, tid long, body binary, places binary"


def _ranges(starts: np.ndarray, length: int) -> np.ndarray:
    """Window starts, ascending, as disjoint byte ranges: pairs of start and end."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    cut = np.flatnonzero(np.concatenate([[True], starts[1:] > starts[:-1] + length]))
    return np.stack([starts[cut], np.concatenate([starts[cut[1:] - 1], starts[-1:]]) + length], axis=1).astype(np.int64)


def _stretches(length: int):
    """Rows of kind 0, a document with the ranges that its own chunk decides, and kind 1, a stretch of the chunk's smallest doc_id."""

    def flush(docs, held):
        local: dict[int, list] = {}
        rows = ([], [], [], [], [], [], [], [])

        def put(*row):
            for col, x in zip(rows, row, strict=True):
                col.append(x)

        for (anchor, k, body), (doc, places, others) in held.items():
            put(1, anchor, k, docs[doc][0], docs[doc][1], None, body, np.array(places, np.int64).tobytes())
            for d, at in others:
                local.setdefault(d, []).append((at, at + len(body)))
        for d, (doc_id, nth, tid, text) in enumerate(docs):
            put(0, None, None, doc_id, nth, tid, text, np.array(local.get(d, []), np.int64).tobytes())
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], [x.split()[0] for x in STRETCHES.split(", ")])

    def run(batches):
        docs, held, size = [], {}, 0
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            ids, nths, tids = (batch.column(c).to_pylist() for c in ("doc_id", "nth", "tid"))
            for row, blobs in enumerate(batch.column("hs")):
                own = data[offsets[row] : offsets[row + 1]]
                if text_id(own.tobytes()) != tids[row]:  # another text under the same doc_id
                    continue
                known = np.frombuffer(blobs.as_buffer(), _U)
                d = len(docs)
                docs.append((ids[row], nths[row], tids[row], own.tobytes()))
                for _, part, _, start in pieces(own, np.array([0, len(own)]), length):
                    m, place = anchors(part, length, places=True)
                    if not len(m):
                        continue
                    heads = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
                    at = np.minimum(np.searchsorted(known, m[heads]), len(known) - 1)
                    hit = np.repeat(known[at] == m[heads], np.diff(np.concatenate([heads, [len(m)]])))
                    hit = np.flatnonzero(hit)
                    if not len(hit):
                        continue
                    width = length - min(GRAM, length) + 1
                    fresh = np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (m[hit[1:]] != m[hit[:-1]])])
                    run_at = np.arange(len(hit)) - np.maximum.accumulate(np.where(fresh, np.arange(len(hit)), 0))
                    cut = np.flatnonzero(fresh | (run_at % width == 0))
                    raw = part.tobytes()
                    marks = m.view(np.int64)
                    for a, b in zip(hit[cut].tolist(), hit[np.concatenate([cut[1:] - 1, [len(hit) - 1]]).astype(int)].tolist(), strict=True):
                        body, k = raw[a : b + length], int(place[a]) - a
                        # more than one place for the anchor: equal windows need not agree on it
                        k = -1 if body.find(body[k : k + GRAM]) != k or body.find(body[k : k + GRAM], k + 1) >= 0 else k
                        key = (int(marks[a]), k, body)
                        entry = held.get(key)
                        if entry is None:
                            held[key] = [d, [start + a], []]
                        elif docs[entry[0]][0] == ids[row]:
                            entry[1].append(start + a)
                        elif docs[entry[0]][0] > ids[row]:
                            entry[2] += [(entry[0], x) for x in entry[1]]
                            entry[0], entry[1] = d, [start + a]
                        else:
                            entry[2].append((d, start + a))
                size += len(own)
                if size >= CHUNK // 2:
                    yield flush(docs, held)
                    docs, held, size = [], {}, 0
        if docs:
            yield flush(docs, held)

    return run


def _agreement(parts_: list[bytes], width: int) -> list[int]:
    """For each string the longest beginning, up to ``width`` bytes, that another one shares."""
    values = [int.from_bytes(x[:width].ljust(width, b"\x00"), "big") for x in parts_]
    order = sorted(range(len(values)), key=values.__getitem__)
    out = [0] * len(values)
    for i, j in zip(order, order[1:], strict=False):
        same = width - ((values[i] ^ values[j]).bit_length() + 7) // 8
        if same > out[i]:
            out[i] = same
        out[j] = same
    return [min(n, len(x)) for n, x in zip(out, parts_, strict=True)]


def _decide(length: int, pids: int):
    """Stretches of a partition, whole anchors: the ranges that other chunks' documents take away.

    Windows with one place for the anchor are equal only if they agree around it, so stretches that differ are first
    trimmed to what they share with another one on either side; those without a whole window left are done.
    """
    gram = min(GRAM, length)

    def run(batches):
        groups: dict[int, dict[tuple, list]] = {}
        for batch in batches:
            for anchor, k, doc, nth, body, places in zip(*(batch.column(c).to_pylist() for c in ("anchor", "k", "doc_id", "nth", "body", "places")), strict=True):
                groups.setdefault(anchor, {}).setdefault((k, body), []).append((doc, nth, places))
        out: dict[tuple[int, int], list] = {}

        def settle(rows, a, b):
            """A stretch has fewer windows than a window has bytes, so those that go are one range of it."""
            for doc, nth, places in rows:
                own = out.setdefault((doc, nth), [])
                for (at,) in struct.iter_unpack("<q", places):
                    own.append(at + a)
                    own.append(at + b)

        mixed, owners, rows_of = [], [], []
        for bodies in groups.values():
            if len(bodies) == 1 and len(next(iter(bodies.values()))) == 1:
                continue
            keys = list(bodies)
            cuts = [(0, len(body)) for _, body in keys]
            if len(keys) > 1 and all(k >= 0 for k, _ in keys):
                left = _agreement([body[:k][::-1] for k, body in keys], length)
                right = _agreement([body[k + gram :] for k, body in keys], length)
                cuts = [(k - x, k + gram + y) for (k, _), x, y in zip(keys, left, right, strict=True)]
            # equal stretches lose nothing to trimming
            cuts = [(0, len(key[1])) if len(bodies[key]) > 1 else c for key, c in zip(keys, cuts, strict=True)]
            trimmed: dict[bytes, list] = {}
            for key, (lo, hi) in zip(keys, cuts, strict=True):
                if hi - lo >= length:
                    trimmed.setdefault(key[1][lo:hi], []).append((bodies[key], lo))
            for body, held in trimmed.items():
                owner = min(r[0] for rows, _ in held for r in rows)
                if len(trimmed) == 1:
                    for rows, lo in held:
                        settle([r for r in rows if owner < r[0]], lo, lo + len(body))
                else:
                    mixed.append(body)
                    owners.append(owner)
                    rows_of.append(held)
        groups.clear()
        if mixed:
            for held, best in zip(rows_of, window_minima(mixed, np.array(owners, np.int64), length), strict=True):
                for rows, lo in held:
                    for row in rows:
                        lost = np.flatnonzero(best < row[0])
                        if len(lost):
                            settle([row], lo + int(lost[0]), lo + int(lost[-1]) + length)
        if out:
            keys = np.array(list(out), np.int64).reshape(-1, 2)
            found = [np.array(x, np.int64).reshape(-1, 2) for x in out.values()]
            labels, rows = bucket_labels(pids), []
            for pid, at in by_bucket(mix(keys[:, 0].view(_U)).view(np.int64) % pids):
                counts = np.array([len(found[i]) for i in at], np.int64)
                body = np.concatenate([found[i] for i in at]).ravel()
                rows.append((labels[pid], b"".join([np.array([len(at), len(body)], np.int64).tobytes(), *(planes(x) for x in (keys[at, 0], keys[at, 1], counts, body))])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["pid", "blob"])

    return run


def _gather(batches):
    """One row for each document with all its ranges."""
    held: dict[tuple[int, int], list] = {}
    for batch in batches:
        for blob in batch.column("blob"):
            b = memoryview(blob.as_buffer())
            n, size = (int(x) for x in np.frombuffer(b, np.int64, 2))
            docs, nths, counts = (unplanes(b, np.int64, n, 16 + 8 * n * i) for i in range(3))
            ranges = unplanes(b, np.int64, size, 16 + 24 * n).reshape(-1, 2)
            ends = np.cumsum(counts)
            for doc, nth, a, e in zip(docs.tolist(), nths.tolist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                held.setdefault((doc, nth), []).append(ranges[a:e])
    keys = list(held)
    for i in range(0, len(keys), 5000):
        some = keys[i : i + 5000]
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in some], pa.int64()), pa.array([k[1] for k in some], pa.int32()), pa.array([np.concatenate(held[k]).tobytes() for k in some], pa.binary())], ["doc_id", "nth", "lost"])


def _cut(batches):
    """Documents with their ranges: what is removed and the hash of what stays."""
    for batch in batches:
        rows = []
        for text, own, more in zip(*(batch.column(c).to_pylist() for c in ("body", "places", "lost")), strict=True):
            r = np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in (own, more or b"")])
            r = r[np.argsort(r[:, 0], kind="stable")]
            keep, at, removed, spans = hashlib.sha256(), 0, 0, 0
            if len(r):
                ends = np.maximum.accumulate(r[:, 1])
                heads = np.flatnonzero(np.concatenate([[True], r[1:, 0] > ends[:-1]]))
                for a, b in zip(r[heads, 0].tolist(), ends[np.concatenate([heads[1:] - 1, [len(r) - 1]]).astype(int)].tolist(), strict=True):
                    keep.update(text[at:a])
                    at, removed, spans = b, removed + b - a, spans + 1
            keep.update(text[at:])
            rows.append((removed, spans, keep.hexdigest()))
        n, s, k = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tid"), pa.array(n, pa.int64()), pa.array(s, pa.int64()), pa.array(k, pa.string())], ["doc_id", "tid", "gone", "runs", "kept"])


def _windows(length: int):
    """Rows (w, doc_id, nth, at): the hash of each window of a stretch and each place where it starts."""

    def run(batches):
        for batch in batches:
            rows = []
            for doc, nth, body, places in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "nth", "body", "places")), strict=True):
                own = [xxhash.xxh3_128_digest(body[i : i + length]) for i in range(len(body) - length + 1)]
                rows += [(w, doc, nth, int(at) + i) for at in np.frombuffer(places, np.int64) for i, w in enumerate(own)]
            for i in range(0, len(rows), 100_000):
                w, d, n, at = zip(*rows[i : i + 100_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(d, pa.int64()), pa.array(n, pa.int32()), pa.array(at, pa.int64())], ["w", "doc_id", "nth", "at"])

    return run


def _lost_windows(length: int, pids: int):
    """Lost windows (doc_id, nth, at) as packed ranges, as ``_decide`` gives them."""

    def run(batches):
        labels = bucket_labels(pids)
        for batch in batches:
            doc, nth, at = (batch.column(c).to_numpy() for c in ("doc_id", "nth", "at"))
            order = np.lexsort((at, nth, doc))
            doc, nth, at = doc[order].astype(np.int64), nth[order].astype(np.int64), at[order].astype(np.int64)
            if not len(doc):
                continue
            heads = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (nth[1:] != nth[:-1])]))
            found = [_ranges(at[a:b], length) for a, b in zip(heads, [*heads[1:], len(doc)], strict=True)]
            rows = []
            for pid, some in by_bucket(mix(doc[heads].view(_U)).view(np.int64) % pids):
                counts = np.array([len(found[i]) for i in some], np.int64)
                body = np.concatenate([found[i] for i in some]).ravel()
                rows.append((labels[pid], b"".join([np.array([len(some), len(body)], np.int64).tobytes(), *(planes(x) for x in (doc[heads][some], nth[heads][some], counts, body))])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["pid", "blob"])

    return run


def _by_window(shared: DataFrame, length: int, pids: int) -> DataFrame:
    """What ``_decide`` gives, for anchors whose stretches are too many for a task."""
    windows = stage(shared.mapInArrow(_windows(length), "w binary, doc_id long, nth int, at long"), "windows")
    least = windows.groupBy("w").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("last > first").select("w", "first")
    lost = windows.join(least, "w").filter("doc_id > first").select("doc_id", "nth", "at")
    return lost.mapInArrow(_lost_windows(length, pids), "pid int, blob binary")


def suffix_dedup(docs: DataFrame, length: int = 50, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256``, a row for each row of ``docs``. ``hot`` changes no result."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # two hashes of a text: the one that Python takes, and the JVM's, by which texts join without being hashed again
    facts = stage(docs.withColumn("jid", F.xxhash64("text")).mapInArrow(_facts, FACTS), "facts")
    first = facts.filter(f"doc_id is not null and n_bytes >= {length}").groupBy("tid").agg(F.min("doc_id").alias("first"), F.min("jid").alias("jid"))

    p = parts(spark)
    entries = docs.filter("doc_id is not null").select("text").mapInArrow(_entries(length, p), "pid int, blob binary").repartition(p, "pid")
    lists = entries.mapInArrow(_repeated(p), "pid int, blob binary").repartition(p, "pid").mapInArrow(_known, "tid long, hs binary")
    wanted = lists.join(first, "tid").withColumnRenamed("first", "doc_id")
    wanted = stage(wanted.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("tid"))), "wanted")

    some = docs.filter(f"octet_length(text) >= {length}")
    ids = wanted.select("doc_id").distinct()
    if ids.count() * 16 <= SMALL:
        some = some.join(F.broadcast(ids), "doc_id", "left_semi")
    found = some.withColumn("jid", F.xxhash64("text")).join(wanted, ["doc_id", "jid"]).select("doc_id", "nth", "tid", "text", "hs")
    stretches = stage(found.mapInArrow(_stretches(length), STRETCHES), "stretches")

    shared = stretches.filter("kind = 1").select("anchor", "k", "doc_id", "nth", "body", "places")
    # the way an anchor goes changes no result, so a part of its stretches is enough to choose it
    part = min(1.0, LOOK / hot)
    often = shared.filter(sampled(part, "anchor", "doc_id", "k")).groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") >= max(1, int(hot * part)))
    often = stage(often.select("anchor"), "often")
    pieces_ = None
    if not often.isEmpty():
        pieces_ = _by_window(shared.join(often, "anchor", "left_semi"), length, p)
        shared = shared.join(often, "anchor", "left_anti")
    lost = shared.repartition(p, "anchor").mapInArrow(_decide(length, p), "pid int, blob binary")
    if pieces_ is not None:
        lost = lost.unionByName(pieces_)
    lost = lost.repartition(p, "pid").mapInArrow(_gather, "doc_id long, nth int, lost binary")
    pending = stretches.filter("kind = 0").select("doc_id", "nth", "tid", "body", "places")
    cut = pending.join(lost, ["doc_id", "nth"], "left").mapInArrow(_cut, "doc_id long, tid long, gone long, runs long, kept string").dropDuplicates(["doc_id", "tid"])

    rows = facts.join(first, "tid", "left").join(cut, ["doc_id", "tid"], "left")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("gone", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(load(spark, sf_dir, "documents"))
