"""Exact similarity join on word n-grams by universe partitioning.

A document is the set of its distinct n-gram fingerprints (64 bits). Two sets with Jaccard similarity of at least
``num/den`` differ in at most H fingerprints, where H follows from the smaller size. The fingerprint universe is cut into m
segments for each band of sizes. Each segment's content gets a key; if the band uses one-deletion neighbourhoods, so does
the content without any one fingerprint, and an unmatched segment then stands for two differences instead of one. By the
pigeonhole principle it is enough that the smaller document probes any segments with a total weight above H:

* per band, ``allocate`` takes exact or one-deletion segments, whichever costs less by its cost model;
* a similar pair agrees in at least m - H segments, so a document with fewer segments that any other one has is left out;
* per document, the probes are the segments with the shortest lists. A segment that no other document has costs nothing,
  so most documents need no probe.

Equal sets collapse into a class first. Every probed bucket names one member as its hub, the same one in most buckets of a
group of copies, and the members of a hub's buckets meet in its group, so the texts travel once for each hub instead of
once for each pair. ``forest`` verifies a group on whole fingerprint sets and returns a spanning forest: pairs are never
rows. Groups beyond ``TOKENS`` fingerprints are cut into cells that also get the hub; afterwards only members outside
the group's largest component are compared with the other cells.

Nulls and empty texts give empty sets, linked with nothing (their component is their own doc_id). Fewer than n words form
one n-gram. Repeated rows are copies of each other; rows that share a doc_id but not the text, and rows without doc_id, are
linked by their own texts like all others (component_id is null only where no linked row has a doc_id). Other columns of
the input are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import bucket_labels, by_bucket, doc_slices, freeing, hash_words, load, mix, parts, planes, stage, unplanes, unstage, utf8, word_bounds
from .graph import components

_U = np.uint64
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_UPPER = {c: c + 32 for c in range(65, 91)}
#: Cost model: an index row, a useless candidate, and the share of fingerprints that unrelated texts have in common.
ROW_COST, PAIR_COST, SHARED = 1.0, 80.0, 0.1
#: Segments as multiples of the fewest that the pigeonhole principle needs: more make index rows, but fewer useless candidates.
SLACKS = (1.0, 1.1, 1.25, 1.5, 2.0, 3.0)
FLUSH = 1 << 20
#: Bytes of a key within its partition. Equal bytes of different keys only add candidates.
KEY = 5
#: The fingerprints that are verified together.
TOKENS = 2_000_000


# ------------------------------------------------------------------ sets


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int):
    """For each row its sorted distinct fingerprints."""
    for lo, hi in doc_slices(offsets):
        part, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, words = word_bounds(part, off)
        w = hash_words(part, starts, ends)
        if len(w) >= n:
            s = np.zeros(len(w) - n + 1, _U)
            for k in range(n):
                s = s * _U(0x9FB21C651E98DF25) + w[k : len(w) - n + 1 + k]
            s = mix(s)
        for a, b in zip(words[:-1], words[1:], strict=True):
            if b - a >= n:
                yield np.unique(s[a : b - n + 1])
            elif b > a:
                short = np.array([b - a], _U)
                for x in w[a:b, None]:
                    short = short * _U(0x9FB21C651E98DF25) + x
                yield mix(short ^ _U(0x5851F42D4C957F2D))
            else:
                yield np.zeros(0, _U)


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit id of the set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def word_set(text: str | None, n: int) -> set:
    words = WORD.findall((text or "").translate(_UPPER))
    if len(words) < n:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(n)), strict=False))


# ------------------------------------------------------------------ bands


def at_least(m: int, p: float, k: int) -> float:
    """Chernoff's bound of the chance of k or more hits among m of chance p."""
    x = k / m
    if x <= p:
        return 1.0
    if x >= 1:
        return p**m
    return math.exp(-m * (x * math.log(x / p) + (1 - x) * math.log((1 - x) / (1 - p))))


class Scheme:
    """Bands of sizes, and how many segments of which weight each has. ``counts``: the sets of each band, as measured."""

    def __init__(self, num: int, den: int, counts: tuple[int, ...] = (), growth: float = 1.5, top: int = 1 << 31):
        self.num, self.den = num, den
        self.lo, self.hi = [], []
        lo = 1
        while lo <= top:
            hi = max(lo, int(lo * growth))
            self.lo.append(lo)
            self.hi.append(hi)
            lo = hi + 1
        self.his = np.array(self.hi)
        # a band also holds sets of the next one
        self.kinds = [self.allocate(a, b, sum(counts[i : i + 2])) for i, (a, b) in enumerate(zip(self.lo, self.hi, strict=True))]

    def differ(self, s: int) -> int:
        """The most fingerprints in which a set of this size and a similar one that is no smaller can differ."""
        return (self.den - self.num) * (s + self.den * s // self.num) // (self.den + self.num)

    def least(self, t: int) -> int:
        """The size of the smallest set that can be similar to one of this size."""
        return -(-self.num * t // self.den)

    def band(self, s: int) -> int:
        return int(np.searchsorted(self.his, s))

    def most(self, t: int, band: int) -> int:
        """The most fingerprints in which a set of size t and a similar, smaller one of the band can differ."""
        return (self.den - self.num) * (min(self.hi[band], t) + t) // (self.den + self.num)

    def allocate(self, lo: int, hi: int, others: int) -> tuple[int, int]:
        """(segments, weight of each): the exact or one-deletion segments with the least index rows and useless candidates."""
        h, size = self.differ(hi), (lo + hi) // 2
        found = []
        for slack in SLACKS:
            for weight in (1, 2):
                m = math.ceil(slack * math.ceil((h + 1) / weight))
                miss = 1 - (1 - SHARED) / m
                match = miss**size + (weight - 1) * (1 - SHARED) * size / m * miss ** (size - 1)
                rows = m + (weight - 1) * size
                found.append((ROW_COST * rows + PAIR_COST * others * at_least(m, match, m - h // weight), weight, m))
        return min(found)[:0:-1]

    @lru_cache(maxsize=4096)  # noqa: B019
    def plans(self, s: int) -> tuple[tuple[int, bool], ...]:
        """The bands in which a set of this size is indexed, and whether it probes there."""
        out = []
        b = self.band(s)
        if self.differ(s) > 0:
            out.append((b, True))
        if s > 1 and self.least(s) < s:
            if not out:
                out.append((b, False))
            low = self.band(self.least(s))
            out += [(x, False) for x in range(low, b)]
        return tuple(out)


def segment_keys(s: np.ndarray, band: int, m: int, weight: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the segments of a sorted set, and the number of each key's segment."""
    own = mix(s ^ _U((band + 1) * 0xA24BAED4963EE407 & (2**64 - 1)))
    total = np.zeros(len(s) + 1, _U)
    np.cumsum(own, out=total[1:])
    seg = (s >> _U(32)) * _U(m) >> _U(32)
    cuts = np.searchsorted(seg, np.arange(m + 1, dtype=_U))
    content = total[cuts[1:]] - total[cuts[:-1]]
    salt = mix(np.arange(1, m + 1, dtype=_U) * _U(0xC2B2AE3D27D4EB4F) + _U(band << 40))
    if weight == 1:
        return mix(content ^ salt), np.arange(m, dtype=np.int32)
    at = seg.astype(np.int64)
    less = content[at] - own
    keys = np.concatenate([mix(content ^ salt), mix(less ^ salt[at])])
    return keys, np.concatenate([np.arange(m), at]).astype(np.int32)


# ------------------------------------------------------------------ index


def _sets(n: int):
    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            sizes, ids = [], []
            for s in shingle_sets(data, offsets, n):
                sizes.append(len(s))
                ids.append(set_id(s))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tid"), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64())], ["doc_id", "tid", "n_shingles", "sid"])

    return run


def _index(n: int, scheme: Scheme, pids: int):
    """Rows (pid, blob): the keys of one bucket from some documents, packed."""

    def flush(keys, docs, segs, sids, sizes):
        keys, docs, segs = np.concatenate(keys), np.concatenate(docs), np.concatenate(segs)
        sids, sizes = np.array(sids, np.int64), np.array(sizes, np.int64)
        out_p, out_b, labels = [], [], bucket_labels(pids)
        for pid, at in by_bucket((keys >> _U(40)).astype(np.int64) % pids):
            used, doc = np.unique(docs[at], return_inverse=True)
            head = np.array([len(at), len(used)], np.int64).tobytes()
            out_p.append(labels[pid])
            out_b.append(b"".join([head, planes(keys[at])[: KEY * len(at)], planes(doc.astype(np.uint32)), planes(segs[at]), planes(sids[used >> 8]), planes((sizes[used >> 8] << 8) | (used & 255))]))
        return pa.RecordBatch.from_arrays([pa.array(out_p, pa.int32()), pa.array(out_b, pa.binary())], ["pid", "blob"])

    def run(batches):
        seen: set[int] = set()
        keys, docs, segs, sids, sizes, held = [], [], [], [], [], 0
        for batch in batches:
            for s in shingle_sets(*utf8(batch.column("text")), n):
                plans = scheme.plans(len(s)) if len(s) else ()
                if not plans or (sid := set_id(s)) in seen:
                    continue
                seen.add(sid)
                for band, probes in plans:
                    k, g = segment_keys(s, band, *scheme.kinds[band])
                    keys.append(k)
                    segs.append(g)
                    docs.append(np.full(len(k), (len(sids) << 8) | (band << 1) | probes, np.int64))
                    held += len(k)
                sids.append(sid)
                sizes.append(len(s))
                if held >= FLUSH:
                    yield flush(keys, docs, segs, sids, sizes)
                    keys, docs, segs, sids, sizes, held = [], [], [], [], [], 0
        if held:
            yield flush(keys, docs, segs, sids, sizes)

    return run


SHARED_ROWS = "key long, sid long, n long, band int, seg int, probe boolean, base int, weight int, least int"


def _shared(scheme: Scheme):
    """Of a partition's index rows, those with keys that several sets have and at least one of them probes.

    ``base`` plus the weight of its shared segments is what a prober has to probe, ``least`` the shared segments that any
    similar pair with this set needs.
    """

    def run(batches):
        cols = ([], [], [], [], [])
        for batch in batches:
            for label, blob in zip(batch.column("pid").to_numpy(), batch.column("blob"), strict=True):
                b = memoryview(blob.as_buffer())
                nk, nd = (int(x) for x in np.frombuffer(b, np.int64, 2))
                at = 16
                key = np.zeros((nk, 8), np.uint8)
                key[:, :KEY] = np.frombuffer(b, np.uint8, KEY * nk, at).reshape(KEY, nk).T
                key = key.view(_U).ravel() | _U(int(label) << 8 * KEY)
                doc = unplanes(b, np.uint32, nk, at := at + KEY * nk)
                seg = unplanes(b, np.int32, nk, at := at + 4 * nk)
                sid = unplanes(b, np.int64, nd, at := at + 4 * nk)
                size = unplanes(b, np.int64, nd, at + 8 * nd)
                for col, x in zip(cols, (key, sid[doc], size[doc], seg, (size[doc] & 1).astype(bool)), strict=True):
                    col.append(x)
        if not cols[0]:
            return
        key, sid, size, seg, probe = (np.concatenate(c) for c in cols)
        del cols
        # keys that stand once are most; find the others by the sorted keys alone
        order = np.argsort(key, kind="stable")
        k = key[order]
        same = k[1:] == k[:-1]
        order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        key, sid, size, seg, probe = key[order], sid[order], size[order], seg[order], probe[order]
        order = np.lexsort((~probe, sid, key))
        key, sid, size, seg, probe = key[order], sid[order], size[order], seg[order], probe[order]
        if len(key):
            first = np.concatenate([[True], (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])])
            key, sid, size, seg, probe = key[first], sid[first], size[first], seg[first], probe[first]
        if not len(key):
            return
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        count = np.diff(np.concatenate([heads, [len(key)]]))
        rows = np.repeat((count > 1) & np.logical_or.reduceat(probe, heads), count)
        if not rows.any():
            return
        band, size = (size & 255) >> 1, size >> 8

        def table(s: int, b: int, probes: bool) -> tuple[int, int, int]:
            m, w = scheme.kinds[b]
            return scheme.differ(s) + 1 - m * w, w, max(1, m - (scheme.differ(s) if probes else scheme.most(s, b)) // w)

        tables = {(s, b, p): table(s, b, p) for s, b, p in set(zip(size[rows].tolist(), band[rows].tolist(), probe[rows].tolist(), strict=True))}
        signed = key.view(np.int64)
        for at in np.array_split(np.flatnonzero(rows), max(1, int(rows.sum()) // 100_000)):
            own = np.array([tables[x] for x in zip(size[at].tolist(), band[at].tolist(), probe[at].tolist(), strict=True)], np.int32)
            arrays = [signed[at], sid[at], size[at], band[at].astype(np.int32), seg[at], probe[at], own[:, 0], own[:, 1], own[:, 2]]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], [x.split()[0] for x in SHARED_ROWS.split(", ")])

    return run


def _hub_members(shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``hub, sid, n``: for each probed bucket its members, under the bucket's hub; and a staged table that is no longer needed."""
    # a set of a band needs enough segments that any other set has
    enough = shared.groupBy("sid", "band").agg(F.count_distinct("seg").alias("segs"), F.max("least").alias("least")).filter("segs >= least").select("sid", "band")
    rows = stage(shared.join(enough, ["sid", "band"], "left_semi"), "rows")
    buckets = rows.groupBy("key").agg(F.count("*").alias("cnt"), F.min_by("sid", F.xxhash64("sid")).alias("hub"))
    probers = rows.filter("probe").join(buckets.filter("cnt > 1").select("key", "cnt", "hub"), "key")
    # the cheapest segments whose weights, with those of unshared ones, exceed H
    segs = probers.groupBy("sid", "base", "weight", "seg").agg(F.sum("cnt").alias("cost"), F.collect_list(F.struct("key", "hub")).alias("keys"))
    own = Window.partitionBy("sid")
    segs = segs.withColumn("need", F.col("base") + F.col("weight") * F.count("*").over(own)).withColumn("rank", F.row_number().over(own.orderBy("cost", "seg")))
    picked = segs.filter((F.col("need") > 0) & (F.col("weight") * (F.col("rank") - 1) < F.col("need"))).select(F.inline("keys")).distinct()
    members = stage(rows.select("key", "sid", "n").join(picked, "key").select("hub", "sid", "n").distinct(), "members")
    return members, rows


# ------------------------------------------------------------------ verification


def forest(sets: list, labels: np.ndarray, pivots: np.ndarray, num: int, den: int, main: int | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that join the components of the sets, as far as ``labels`` do not.

    Every pair with at least one of ``pivots`` counts. A pivot is compared with all sets at once. One that is in the component
    ``main`` needs no comparison, as any link to a set outside is found from that set's side, here or in another cell. Without
    ``main`` all sets are pivots, and the largest component takes its place.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    tokens, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, ids, count = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = count > 1
    keep = shared[ids]
    ids, doc = (np.cumsum(shared) - 1)[ids[keep]], doc[keep]
    lens = count[shared]
    starts = np.cumsum(lens) - lens
    postings = doc[np.argsort(ids, kind="stable")]
    cuts = np.searchsorted(doc, np.arange(len(sets) + 1))
    _, label = np.unique(np.append(labels, labels[:1] if main is None else main), return_inverse=True)
    done, label = -1 if main is None else int(label[-1]), label[:-1].copy()
    todo, links = pivots.copy(), []
    while True:
        left = np.flatnonzero(todo & (label != done))
        if not len(left):
            return links
        i = int(left[0])
        todo[i] = False
        own = ids[cuts[i] : cuts[i + 1]]
        if len(own):
            k = lens[own]
            at = np.repeat(starts[own] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            both = np.bincount(postings[at], minlength=len(sets))
            near = np.flatnonzero(den * both >= num * (sizes[i] + sizes - both))
            for j in near:
                if (other := label[j]) != label[i]:
                    links.append((i, int(j)))
                    label[label == other] = label[i]
                    if other == done:
                        done = int(label[i])
        if main is None:
            done = int(np.argmax(np.bincount(label)))


def _verify(n: int, num: int, den: int):
    """Links ``a, b`` of each cell. Rows come sorted by ``hub, cell``."""

    def run(batches):
        now, main, sets, sids, roots, pivots, out = None, None, [], [], [], [], []

        def close():
            if len(sets) > 1:
                order = np.argsort(np.array(sids) != now[0], kind="stable")  # the hub first
                found = forest([sets[x] for x in order], np.array(roots)[order], np.array(pivots)[order], num, den, main)
                out.extend((sids[order[i]], sids[order[j]]) for i, j in found)
            for x in (sets, sids, roots, pivots):
                x.clear()

        def flush():
            a = np.array(out, np.int64).reshape(-1, 2)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a.min(axis=1)), pa.array(a.max(axis=1))], ["a", "b"])

        for batch in batches:
            hub, cell, sid, root, pivot, mains = (batch.column(c).to_pylist() for c in ("hub", "cell", "sid", "root", "pivot", "main"))
            for i, s in enumerate(shingle_sets(*utf8(batch.column("text")), n)):
                if (hub[i], cell[i]) != now:
                    close()
                    now, main = (hub[i], cell[i]), mains[i]
                sets.append(s)
                sids.append(sid[i])
                roots.append(root[i])
                pivots.append(pivot[i])
            if len(out) > 10_000:
                yield flush()
        close()
        if out:
            yield flush()

    return run


def _links(rows: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links among ``rows(hub, cell, sid, root, pivot, main)``; main is null where every row is a pivot."""
    cells = rows.join(texts, "sid").repartition("hub", "cell").sortWithinPartitions("hub", "cell")
    return stage(cells.select("hub", "cell", "sid", "root", "pivot", "main", "text").mapInArrow(freeing(_verify(n, num, den)), "a long, b long"), "links")


def ngram_jaccard_join(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, tokens: int = TOKENS) -> DataFrame:
    """``doc_id, n_shingles, component_id``: documents whose n-gram sets have similarity num/den or more are linked.

    ``docs`` needs ``doc_id`` (long) and ``text``. component_id is the smallest doc_id that links reach. ``tokens`` bounds the
    fingerprints that one task compares at a time; it changes no result.
    """
    sets, final = _joined(docs, n, num, den, tokens)
    out = sets.join(final, "sid", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each_group(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest doc_id stays.

    Of rows that are equal in doc_id and text one stays. A null doc_id comes after all others. Rows without words are nobody's
    near-duplicates and stay.
    """
    sets, final = _joined(docs, n, num, den, TOKENS)
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("k_doc"), F.col("tid").alias("k_tid"))
    kept = sets.join(final, "sid").groupBy("root").agg(F.min(order).alias("k")).select("k.k_doc", "k.k_tid")
    tid = "_tidemark_tid"
    rows = docs.withColumn(tid, F.xxhash64(F.col("text").cast("string")))
    found = rows.join(kept, (F.col(tid) == F.col("k_tid")) & F.col("doc_id").cast("long").eqNullSafe(F.col("k_doc")), "left_semi")
    wordless = docs.filter(F.col("text").isNull() | ~F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return found.dropDuplicates(["doc_id", tid]).select(*docs.columns).unionByName(wordless)


def _joined(docs: DataFrame, n: int, num: int, den: int, tokens: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, tid, n_shingles, sid`` of each row, and ``sid, component_id, root`` of each set."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tid", F.xxhash64("text"))
    sets = stage(docs.mapInArrow(freeing(_sets(n)), "doc_id long, tid long, n_shingles long, sid long"), "sets")
    # one row of each set stands for it: the one with the smallest doc_id
    classes = sets.filter("n_shingles > 0").groupBy("sid").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("rep"), F.col("tid").alias("tid"))).alias("r")).select("sid", "r.rep", "r.tid")

    pids = 2 * parts(spark)  # a task holds its keys in memory
    bands = Scheme(num, den).hi
    band = F.size(F.filter(F.lit(bands), lambda hi: hi < F.col("n_shingles")))
    counts = {r["band"]: r["count"] for r in sets.filter("n_shingles > 0").groupBy(band.alias("band")).count().collect()}  # one row a band
    scheme = Scheme(num, den, tuple(counts.get(i, 0) for i in range(len(bands))))
    rows = docs.select("text").mapInArrow(freeing(_index(n, scheme, pids)), "pid int, blob binary").repartition(pids, "pid")
    shared = stage(rows.mapInArrow(freeing(_shared(scheme)), SHARED_ROWS), "shared")
    members, kept = _hub_members(shared)
    unstage(shared, kept)

    groups = members.groupBy("hub").agg(F.count("*").alias("c"), F.ceil(F.sum("n") / F.lit(tokens)).cast("int").alias("cells")).filter("c > 1")
    members = members.join(groups.select("hub", "cells"), "hub")
    wanted = members.select("sid").distinct().join(classes, "sid").select(F.col("sid"), F.col("rep").alias("w_rep"), F.col("tid").alias("w_tid"))
    texts = docs.join(wanted, (docs["tid"] == wanted["w_tid"]) & docs["doc_id"].eqNullSafe(wanted["w_rep"])).select("sid", "text")
    texts = stage(texts.dropDuplicates(["sid"]), "texts")

    cell = F.when(F.col("sid") == F.col("hub"), F.sequence(F.lit(0), F.col("cells") - 1)).otherwise(F.array(F.pmod(F.xxhash64("sid"), F.col("cells")).cast("int")))
    first = members.select("hub", "sid", F.explode(cell).alias("cell"), F.col("sid").alias("root"), F.lit(True).alias("pivot"), F.lit(None).cast("long").alias("main"))
    links = _links(first, texts, n, num, den)
    labels = components(links)
    large = groups.filter("cells > 1").select("hub")
    if not large.isEmpty():
        # cells of a large group meet in the members that are not in its main component
        rooted = stage(members.join(large, "hub", "left_semi").join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid")), "rooted")
        main = rooted.groupBy("hub", "root").agg(F.count("*").alias("c")).groupBy("hub").agg(F.max_by("root", F.struct("c", "root")).alias("main"))
        rooted = rooted.join(main, "hub").withColumn("pivot", F.col("root") != F.col("main"))
        strays = rooted.filter("pivot").groupBy("hub").agg(F.ceil(F.sum("n") / F.lit(tokens)).cast("int").alias("blocks"))
        rooted = rooted.join(strays, "hub")
        block = F.pmod(F.xxhash64("sid", F.lit(1)), F.col("blocks")).cast("int")
        place = F.pmod(F.xxhash64("sid"), F.col("cells")).cast("int")
        cells = "hub", "sid", "root", "main", "pivot"
        left = rooted.filter("pivot").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).select(*cells, (block * F.col("cells") + F.col("i")).alias("cell"))
        right = rooted.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("own", F.col("pivot") & (F.col("j") == block)).filter("not own").select("hub", "sid", "root", "main", F.lit(False).alias("pivot"), (F.col("j") * F.col("cells") + place).alias("cell"))
        more = _links(left.unionByName(right), texts, n, num, den)
        if not more.isEmpty():
            labels = components(links.union(more))
    unstage(texts, members)

    named = classes.join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    return sets, named.join(least, "root").select("sid", "component_id", "root")


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(load(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END) + 1)) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(min(r.y), w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN r ON r.x = w.doc_id GROUP BY 1, 2
"""
