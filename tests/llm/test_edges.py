"""Nulls in any column, repeated rows and ids, very long and empty texts, empty tables, clashing columns, and brute force where SQL cannot help."""

import gzip
import hashlib
import io
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemark.llm import decontaminate, language, mixing, ngram_jaccard, pii, suffix_dedup, token_files, topk, toxicity, warc

#: Names that operators use inside.
CLASH = "doc_id long, text string, lang string, source string, sid long, tid long, hub long, cell int, root long, size long, hash long, w string, jid long, hs string, chosen boolean, matches string, score double, _tidemark_tid long"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, 2, 3, 4, 5, 6, 7, "w", 8, "h", True, "m", 0.5, 9) for i, t, s in rows], CLASH).repartition(3)


def prose(rng, n, vocabulary=300):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """Null ids, an id with two texts, repeated rows, empty and long texts."""
    rng = random.Random(21)
    a, b = prose(rng, 80), prose(rng, 90)
    near = lambda t, k: " ".join("x" if i == k else w for i, w in enumerate(t.split()))
    return [
        (5, a, "s"), (5, b, "s"), (7, near(a, 3), "t"), (8, near(b, 4), "t"), (None, near(a, 50), None), (None, "alone in the world of words", "t"), (None, None, None), (9, "", "s"), (10, None, "s"), (11, " \t ", "s"),
        (12, a, "s"), (12, a, "s"), (13, prose(rng, 40_000, 5000), "u"), (14, "ünï çödé " * 60, "u"), (15, "short", "u"), (16, "short", "u"),
    ]


def linked(rows, n, num, den):
    """(doc_id, size, component) of each row."""
    sets = [ngram_jaccard.word_set(t, n) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _, _) in enumerate(rows)]


def groups(rows, n, num, den):
    """The group of each row, by the row that stands for it."""
    sets = [ngram_jaccard.word_set(t, n) for _, t, _ in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    return dict(enumerate(root))


def plain(rows):
    return sorted([tuple(r) for r in rows], key=repr)


@pytest.mark.parametrize("tokens", [ngram_jaccard.TOKENS, 200])
def test_jaccard_odd_rows(spark, odd, tokens):
    want = plain(linked(odd, 4, 85, 100))
    for rows in (odd, odd[::-1]):
        assert plain(ngram_jaccard.ngram_jaccard_join(clashing(spark, rows), tokens=tokens).collect()) == want
    assert ngram_jaccard.ngram_jaccard_join(clashing(spark, [])).count() == 0


def test_jaccard_group_of_half_similar_copies(spark):
    """A large group most of whose pairs are not similar enough, cut into many cells."""
    rng = random.Random(22)
    base = prose(rng, 60, 4000).split()
    rows = []
    for i in range(120):
        w = [*base]
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(w), "s"))
    for tokens in (ngram_jaccard.TOKENS, 600):
        assert plain(ngram_jaccard.ngram_jaccard_join(clashing(spark, rows), tokens=tokens).collect()) == plain(linked(rows, 4, 85, 100))


def test_cells_of_a_group_find_every_component():
    """Cells, and then strays against all cells, as the join deals them out, against all pairs."""
    rng = np.random.default_rng(31)
    for trial in range(300):
        n = int(rng.integers(6, 40))
        kinds = [rng.integers(0, 2**60, 40).astype(np.uint64) for _ in range(3)]
        kinds[1][:35] = kinds[0][:35]  # kinds that are nearly similar: few pairs link them
        kinds[2][2:37] = kinds[1][2:37]
        sets = []
        for _ in range(n):
            s = kinds[int(rng.integers(0, 3))].copy()
            s[rng.choice(40, int(rng.integers(0, 5)), replace=False)] = rng.integers(0, 2**60, 1)
            sets.append(np.unique(s))
        links = [(i, j) for i in range(n) for j in range(i) if 100 * (b := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - b)]

        def parts(edges):
            root = list(range(n))
            for i, j in edges:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
            return root

        cells, blocks = int(rng.integers(1, 5)), int(rng.integers(1, 4))
        place, block = rng.integers(0, cells, n), rng.integers(0, blocks, n)
        found = []
        for c in range(cells):
            at = np.array([0, *(i for i in range(1, n) if place[i] == c)])  # the hub is everywhere
            found += [(at[i], at[j]) for i, j in ngram_jaccard.forest([sets[x] for x in at], at, np.ones(len(at), bool), 85, 100)]
        root = np.array(parts(found))
        main = int(np.bincount(root).argmax())
        stray = root != main
        more = []
        for j in range(blocks):
            for c in range(cells):
                own = stray & (block == j)
                at = np.flatnonzero(own | (place == c))
                if len(at) and own.any():
                    more += [(at[a], at[b]) for a, b in ngram_jaccard.forest([sets[x] for x in at], root[at], own[at], 85, 100, main)]
        assert parts([*found, *more]) == parts(links), trial


def test_strays_that_outnumber_the_main_component_in_a_cell():
    """Only the last of a chain of strays is similar to the one member of the main component that the cell has."""
    sets = [np.arange(5 * k, 5 * k + 100, dtype=np.uint64) for k in range(6)]
    labels, pivots = np.array([0] * 5 + [9]), np.array([True] * 5 + [False])
    assert ngram_jaccard.forest(sets, labels, pivots, 85, 100, 9) == [(4, 5)]


def test_scheme_takes_both_kinds_of_segments():
    scheme = ngram_jaccard.Scheme(85, 100, (1000,) * 60)
    kinds = {lo: k for lo, k in zip(scheme.lo, scheme.kinds, strict=True)}
    assert kinds[4][1] == 2 and kinds[209][1] == 1
    more = ngram_jaccard.Scheme(85, 100, (10**9,) * 60)
    assert all(b[0] >= a[0] for a, b in zip(scheme.kinds, more.kinds, strict=True) if a[1] == b[1])


def test_pigeonhole():
    """Every similar pair agrees in a segment that the smaller set probes, for exact and one-deletion segments."""
    rng = np.random.default_rng(3)
    scheme = ngram_jaccard.Scheme(80, 100, (10**6,) * 60)
    for size in (4, 5, 6, 12, 40, 200):
        for _ in range(30):
            x = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
            gone = rng.choice(len(x), rng.integers(0, len(x) // 8 + 1), replace=False)
            y = np.unique(np.concatenate([np.delete(x, gone), rng.integers(0, 2**63, rng.integers(0, len(x) // 8 + 1)).astype(np.uint64)]))
            small, large = sorted((x, y), key=len)
            both = len(np.intersect1d(x, y))
            if 100 * both < 80 * (len(x) + len(y) - both):
                continue
            band = scheme.band(len(small))
            assert band in [b for b, _ in scheme.plans(len(large))] or len(small) == len(large) == both
            m, weight = scheme.kinds[band]
            (kx, sx), (ky, _) = (ngram_jaccard.segment_keys(s, band, m, weight) for s in (small, large))
            agree = len(set(sx[np.isin(kx, ky)].tolist()))
            assert agree >= m - (len(x) + len(y) - 2 * both) // weight and agree >= m - scheme.differ(len(small)) // weight and agree >= m - scheme.most(len(large), band) // weight


def test_one_of_each_group(spark, odd):
    kept = plain((r["doc_id"], r["text"]) for r in ngram_jaccard.one_of_each_group(clashing(spark, odd), 4, 85, 100).collect())
    first = {}
    for (d, t, _), (_, size, c) in zip(odd, linked(odd, 4, 85, 100), strict=True):
        if size and (d == c or c is None):
            first[c if c is not None else t] = (d, t)
    blank = [(d, t) for d, t, _ in odd if not (t or "").split()]
    # both texts of document 5 stay: they are of two groups
    two = [(5, t) for d, t, _ in odd if d == 5]
    assert kept == plain({*first.values(), *two}) + [] if not blank else kept == plain([*{*first.values(), *two}, *blank])
    assert ngram_jaccard.one_of_each_group(clashing(spark, [])).count() == 0


def test_mix_odd_rows(spark, odd):
    rows = [r for r in odd if len(r[1] or "") < 10_000]
    got = mixing.mix_sources(clashing(spark, rows)).toPandas()
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    want = con.sql(mixing.SQL).df()
    cells = lambda df: plain(tuple(None if pd.isna(x) else round(float(x), 6) for x in r) for r in df[["doc_id", "size", "source_size", "target", "taken"]].itertuples(index=False))
    assert cells(got) == cells(want) and len(got) == len(rows)
    assert mixing.mix_sources(clashing(spark, [])).count() == 0 and mixing.mixed_documents(clashing(spark, [])).count() == 0
    assert mixing.mixed_documents(clashing(spark, rows)).columns == clashing(spark, rows).columns


def test_mix_with_a_source_for_each_document(spark):
    rows = [(i, prose(random.Random(i), 1 + i % 7), f"s{i:03d}") for i in range(80)]
    got = mixing.mix_sources(clashing(spark, rows)).toPandas()
    assert abs(got.target.sum() - 1.5 * got["size"].sum()) < 1e-3 and (got.taken <= 2 * got["size"]).all()


def test_topk_large_scores(spark):
    rng = np.random.default_rng(5)
    v = {i: (rng.integers(-(2**17), 2**17, 8) * 4096.0).tolist() for i in range(60)}
    rows = [(i, x, "clash", 3) for i, x in v.items()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string, rank int")
    whole = {i: [int(a) for a in x] for i, x in v.items()}
    want = []
    for q in (0, 50):
        best = sorted((-sum(a * b for a, b in zip(whole[q], whole[j], strict=True)), j) for j in whole if j != q)[:5]
        want += [(q, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    assert max(abs(w[3]) for w in want) > 2**53 and plain(topk.topk_search(df, scale=1).collect()) == plain(want)
    with pytest.raises(Exception, match="does not fit"):
        topk.topk_search(spark.createDataFrame([(0, [3e7] * 900), (1, [3e7] * 900)], "vec_id long, embedding array<double>"), scale=65536).collect()
    assert topk.topk_search(df.limit(0)).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0]), (0, [9.0, 9.0]), (50, [1.0, 2.0]), (50, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in topk.topk_search(one).filter("query_id = 50").collect()] == [0]


def test_toxicity_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 40) + (" moron" if i % 4 == 0 else ""), "s") for i in range(200)] + [(None, "a moron", "s"), (None, None, None), (1, "another text", "s"), (900, "moron " * 50_000, "s"), (901, prose(rng, 60_000), "s")]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)] + [(None, 1, 1), (5, None, 7)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(clashing(spark, rows), labels).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all() and list(got[got.doc_id == 900].predicted) == [1] and list(got[got.doc_id == 901].predicted) == [0]
    assert toxicity.with_score(clashing(spark, rows), toxicity.learn(clashing(spark, rows), labels), "new").columns[-1] == "new"


def test_contexts():
    hit = lambda text: toxicity.context(text, text.index("moron"), text.index("moron") + 5)
    assert hit("don't be a moron, you're done") == (False, False, True)
    assert hit('he said "what a moron" to them') == (True, True, False)
    assert hit("“a moron” is a word") == (True, True, False) and hit("„so ein moron“") == (True, False, False)
    assert hit("«named» and then a moron came") == (False, False, False) and hit('a "name" for a moron "here"') == (False, False, False)


def test_contexts_are_learned(spark):
    rng = random.Random(6)
    rows = []
    for i in range(600):
        toxic = i % 2 == 0
        rows.append((i, f"{prose(rng, 12)} {'you moron' if toxic else chr(34) + 'moron' + chr(34)} {prose(rng, 12)}" if i % 3 else prose(rng, 25) + (" you moron" if toxic else ""), "s"))
    labels = spark.createDataFrame([(i, 1, int(i % 2 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(clashing(spark, rows), labels).toPandas()
    held = got[got.held_out]
    p, n = held[held.doc_id % 2 == 0].score.to_numpy(), held[held.doc_id % 2 == 1].score.to_numpy()
    assert ((p[:, None] > n).mean() + (p[:, None] == n).mean() / 2) > 0.95


def test_pii_odd_rows(spark, odd):
    got = pii.find_pii(clashing(spark, odd)).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == len(odd) and all(r["base_sha256"] == empty for r in got if r["doc_id"] in (9, 10, 11)) and pii.find_pii(clashing(spark, [])).count() == 0
    key = "k" + "0123456789abcdef" * 6
    for text in (f"API_KEY={key} end", f"ApI_kEy: {key}", f"secret = '{key}'"):
        (span,) = pii.find_spans(text)["account"]
        assert text[slice(*span)] == key
    long = "é" * 300_000 + " a@b.co " + "1.2.3.4 " * 1000
    assert len(pii.find_spans(long)["email"]) == 1 and len(pii.find_spans(long)["ip"]) == 1000


# ------------------------------------------------------------------ archives


def expected_records(rows, least=0):
    first = {}
    for i, _, html in rows:
        body = (html or "").encode()
        if i is not None and len(body) >= least:
            first[body] = min(i, first.get(body, i))
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        to = first.get(body) if len(body) >= least else None
        to = None if to == i else to
        out.append((i, len(body), warc.digest(body), "response" if to is None else "revisit", to))
    return plain(out)


@pytest.mark.parametrize("hot", [2, 1000])
def test_warc_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(warc, "HOT", hot)
    rng = random.Random(8)
    rows = [(rng.choice([None, *range(40)]) if i % 9 == 0 else 100 + i, f"http://x/{i}" if i % 5 else None, rng.choice(["", None, "<p>same</p>", "ü" * 40, f"<p>{i}</p>", "z" * 200_000])) for i in range(90)]
    rows += [(7, "u", "twice"), (7, "u", "twice"), (8, "u", "twice"), (3, "u\r\nX-Bad: 1", "break")]
    pages = spark.createDataFrame([(*r, "clash", 1, "x") for r in rows], "page_id long, url string, html string, sha string, refers_to int, payload string").repartition(4)
    for least in (0, 6):
        assert plain(warc.warc_round_trip(pages, least).collect()) == expected_records(rows, least)


def foreign(kind, content_type, block, extra=""):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:0>\r\n{extra}Content-Type: {content_type}\r\nContent-Length: {len(block)}\r\n\r\n"
    return head.encode() + block + b"\r\n\r\n"


def test_foreign_records():
    records = [
        foreign("warcinfo", "application/warc-fields", b"software: x"), foreign("resource", "text/plain", b"no blank line"), foreign("metadata", "text/plain", b"a\r\n\r\nb" * 3),
        foreign("response", "application/http; msgtype=response", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n<p>hello</p>", "WARC-Target-URI: http://h/\r\n"), foreign("response", "application/http", b"HTTP/1.1 204 no head end"),
    ]
    for body in (b"".join(records), b"".join(map(gzip.compress, records)), gzip.compress(b"".join(records))):
        got = list(warc.read_archive(io.BytesIO(body), lambda row: True, True))
        assert [r[2] for r in got] == ["warcinfo", "resource", "metadata", "response", "response"] and [r[4] for r in got] == [11, 13, 18, 12, 24]
        assert got[3][6] == b"<p>hello</p>" and got[3][1] == "http://h/" and got[0][6] is None


def test_unwanted_payloads_are_not_inflated():
    rng = np.random.default_rng(1)
    bodies = [rng.integers(0, 256, 400_000).astype(np.uint8).tobytes() for _ in range(6)]
    data = b"".join(warc.record(i, None, b, None) for i, b in enumerate(bodies))
    assert gzip.decompress(data).count(b"WARC/1.1") == 6

    class Counted(warc._Stream):
        made = []

        def __init__(self, raw):
            super().__init__(raw)
            self.made.append(self)

    keep = warc._Stream
    try:
        warc._Stream = Counted
        rows = list(warc.read_archive(io.BytesIO(data), lambda row: row["page_id"] == 4, True))
        assert [(r[0], r[6]) for r in rows] == [(4, bodies[4])] and Counted.made[-1].inflated < 700_000
        assert len(list(warc.read_archive(io.BytesIO(data), lambda row: True, False))) == 6 and Counted.made[-1].inflated < 500_000
    finally:
        warc._Stream = keep


# ------------------------------------------------------------------ the others


def test_suffix_dedup_odd_rows(spark, odd):
    rows = [r for r in odd if len(r[1] or "") < 10_000] + [(40, "pq" * 30_000, "s"), (41, "x" + "pq" * 20_000, "s")]
    got = plain(suffix_dedup.suffix_dedup(clashing(spark, rows)).collect())
    first = {}
    texts = [(d, (t or "").encode()) for d, t, _ in rows]
    for d, t in texts:
        if d is not None:
            for i in range(len(t) - 49):
                first[t[i : i + 50]] = min(d, first.get(t[i : i + 50], d))
    want = []
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        if d is not None:
            for i in range(len(t) - 49):
                if first[t[i : i + 50]] < d:
                    gone[i : i + 50] = True
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0
        want.append((d, len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    assert got == plain(want) and suffix_dedup.suffix_dedup(clashing(spark, [])).count() == 0


def test_tokens_odd_rows_and_random_access(spark, odd):
    from tokenizers import Tokenizer

    path = token_files.default_tokenizer()
    model = Tokenizer.from_file(path)
    ids = lambda t: [*(model.encode(t, add_special_tokens=False).ids if t else []), 0]
    manifest = token_files.write_tokens(clashing(spark, odd), path)
    got = token_files.read_tokens(manifest).collect()
    crc = lambda t: zlib.crc32(np.array(ids(t), "<u4").tobytes())
    assert plain((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == plain((d, len(ids(t)), crc(t)) for d, t, _ in odd)
    assert sorted(r["start"] for r in got) == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in sorted(got, key=lambda r: r["start"])])[:-1]]).tolist()
    row = max(manifest.collect(), key=lambda r: r["n_tokens"])
    store, name = token_files.open_fs(row["path"])
    with store.open_input_file(name) as f:
        reads = []

        class Source:
            def read_at(self, n, offset):
                reads.append(n)
                return f.read_at(n, offset)

        file = token_files.TokenFile(Source())
        docs, nulls, starts = file.documents()
        k = int(np.argmax(np.diff(starts)))
        want = ids(next(t for d, t, _ in odd if d == int(docs[k]) and not nulls[k] and len(ids(t)) == starts[k + 1] - starts[k]))
        reads.clear()
        assert [file.token(int(starts[k]) + i) for i in (0, 1, 700, len(want) - 1)] == [want[i] for i in (0, 1, 700, len(want) - 1)]
        assert max(reads) <= 64  # no block of the file is read for a token
    assert token_files.token_files(clashing(spark, [])).count() == 0


def similarity(item, words):
    """Share of the item's words that stand in the words in order, by the plain recursion."""
    row = [0] * (len(words) + 1)
    for x in item:
        old, row = row, [0] * (len(words) + 1)
        for j, y in enumerate(words):
            row[j + 1] = old[j] + 1 if x == y else max(old[j + 1], row[j])
    return row[-1] / len(item)


def test_decontaminate_recall(spark):
    """Changed, cut and padded items against brute force: every document whose words hold 80 % of an item in order, close together."""
    rng = random.Random(14)
    items = [prose(rng, rng.randrange(15, 50), 2000).split() for _ in range(40)]
    rows, want = [], {}
    for d in range(240):
        words = prose(rng, rng.randrange(40, 200), 2000).split()
        if d % 2:
            i = rng.randrange(40)
            own = [*items[i]]
            for _ in range(rng.randrange(len(own) // 4)):
                at = rng.randrange(len(own))
                own[at : at + 1] = rng.choice([["other"], [], [own[at], "more"]])
            at = rng.randrange(len(words))
            words[at:at] = own
            if similarity(items[i], own) >= 0.8:
                want[d] = i
        rows.append((d, " ".join(words), "s"))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(clashing(spark, rows), bench).collect()}
    found = sum(got[d]["contaminated"] and got[d]["item_id"] == i for d, i in want.items())
    assert len(want) > 80 and found >= 0.9 * len(want)
    assert not any(got[d]["contaminated"] for d in range(0, 240, 2))
    for d, r in got.items():  # what is found holds as much of the item as it says
        if r["contaminated"]:
            assert similarity(items[r["item_id"]], rows[d][1].split()) >= r["score"] - 1e-9


def test_decontaminate_answer_check(spark):
    rng = random.Random(15)
    item = prose(rng, 30, 2000).split()
    body = lambda keep: [w if i in keep else f"z{i}" for i, w in enumerate(item)]
    with_answer = body({*range(16), *range(24, 30)})  # 22 of 30 words, the last fifth among them
    without = body({*range(22)})  # as many words, but nothing of the last fifth
    rows = [(1, " ".join([*prose(rng, 30).split(), *with_answer, *prose(rng, 30).split()]), "s"), (2, " ".join([*prose(rng, 30).split(), *without, *prose(rng, 30).split()]), "s")]
    rows += [(i, prose(rng, 80, 2000), "s") for i in range(10, 60)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r["contaminated"] for r in decontaminate.decontaminate(clashing(spark, rows), bench).collect()}
    assert got[1] and not got[2]


def test_decontaminate_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, " ".join(odd[0][1].split()[:30])), (None, "x"), (2, None)], "item_id long, text string")
    got = decontaminate.decontaminate(clashing(spark, odd), bench).collect()
    # of the row without id word 50 was changed, which is beyond the item
    assert len(got) == len(odd) and sorted(r["doc_id"] or 0 for r in got if r["contaminated"]) == [0, 5, 7, 12, 12]
    assert decontaminate.decontaminate(clashing(spark, []), bench).count() == 0
    assert decontaminate.with_matches(clashing(spark, odd), bench, "new").columns == [*clashing(spark, []).columns, "new"]


def test_sampled_shares(spark):
    from pyspark.sql import functions as F

    from tidemark.llm._common import sampled

    ids = spark.range(200_000)
    count = lambda share: ids.filter(sampled(share, "id")).count()
    assert count(1.0) == 200_000 and count(0.0) == 0 and 1700 < count(0.01) < 2300 and count(F.lit(1.0)) == 200_000
    # a share of less than a millionth still takes rows of a table that is large enough
    assert ids.filter(sampled(1e-7, F.col("id") * 0 + 1)).count() in (0, 200_000)


def test_language_pools_positions():
    """Batches of equal windows give what reading each window alone gives."""
    net = language.Network(3, seed=4)
    rng = random.Random(1)
    texts = ["", "a", "Ünï çode", "12 ½ ② ⅷ", "words " * 40, "".join(rng.choice("abc éß中") for _ in range(500)), None]
    got = list(language.read(net, texts))
    for text, p in zip(texts, got, strict=True):
        b = language.letters(text)
        if not b:
            assert p is None
            continue
        sums, mask = np.zeros(3), None
        for i in range(0, len(b), language.SPAN):
            x, mask = language.padded([b[i : i + language.SPAN]])
            states = net._run("f", x, mask, False)[0] @ net.p["Of"] + net._run("b", x, mask, False)[0] @ net.p["Ob"] + net.p["b"]
            e = np.exp(states - states.max(axis=2, keepdims=True))
            sums += (e / e.sum(axis=2, keepdims=True))[:, 0].sum(axis=0)
        assert np.abs(p - sums / len(b)).max() < 1e-5
        assert len(language.label_positions(net, ["a", "b", "c"], text)) == len(b)
    assert language.letters("12 ½ ② ⅷ") == b"" and language.letters("A1b,  C") == b"a b c"


def test_language_reads_across_words():
    net = language.Network(2, seed=5)
    p = lambda t: net.positions(np.frombuffer(t, np.uint8)[:, None])[:, 0]
    assert np.abs(p(b"the cat")[4:] - p(b"une cat")[4:]).max() > 1e-4


def test_language_odd_rows(spark):
    rng = random.Random(2)
    words = {"aa": ["the", "and", "with", "house"], "bb": ["und", "das", "nicht", "haus"], "cc": ["кот", "дом", "это", "нет"]}
    rows = []
    for i in range(300):
        k = ("aa", "bb", "cc")[i % 3]
        rows.append((i, " ".join(rng.choice(words[k]) for _ in range(30)), k))
    rows += [(None, "the and house", "aa"), (None, None, None), (500, "", "aa"), (501, "½ ②", "bb"), (502, "das haus " * 60_000, None), (503, "кот", ""), (1, "und das nicht", None)]
    df = spark.createDataFrame([(i, t, k, "s", 1.0, "x") for i, t, k in rows], "doc_id long, text string, lang string, source string, score double, lang_pred string")
    got = language.identify_language(df).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    one = got.set_index("doc_id")
    assert list(one.lang_pred[[500, 501]]) == ["und", "und"] and one.lang_pred[502] == "bb" and one.lang_pred[503] == "cc"
    held = got[got.held_out & (got.doc_id < 300)]
    assert (held.lang_pred == held.doc_id.map(lambda i: ("aa", "bb", "cc")[int(i) % 3])).mean() >= 0.97
    assert set(language.identify_language(df.filter("lang is null")).toPandas().lang_pred) == {"und"} and language.identify_language(df.limit(0)).count() == 0


def test_pipeline_stages(spark, odd):
    """Each stage on rows with nulls, repeated ids and clashing columns, against brute force."""
    from collections import Counter

    from tokenizers import Tokenizer

    import corpus_pipeline as c

    sf = "/root/testdata/sf0.001"
    rows = [*odd[:12], *odd[14:], *((i, r["text"], r["source"]) for i, r in ((r["doc_id"] + 1000, r) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()))]
    docs = clashing(spark, rows).cache()
    names = docs.columns
    kept = c.reject_toxic(spark, docs, sf)
    assert kept.columns == names and 0.8 * len(rows) < kept.count() <= len(rows)
    one = c.keep_one_of_each_group(spark, docs, sf)
    want = linked(rows, 5, 80, 100)
    # groups may share their smallest doc_id, as document 5 has two texts: count them by their rows
    group = [find for _, find in sorted(groups(rows, 5, 80, 100).items())]
    assert one.columns == names and one.count() == len({g for g, (_, size, _) in zip(group, want, strict=True) if size}) + sum(not size for _, size, _ in want)
    clean = c.drop_benchmark(spark, docs, sf)
    assert clean.columns == names
    mixed = c.mix(spark, docs, sf)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame([r[:3] for r in rows], columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    taken = con.sql(mixing.SQL).df()
    times = Counter()
    for r in taken.itertuples(index=False):
        if r.size:
            times[None if pd.isna(r.doc_id) else int(r.doc_id)] += int(r.taken // r.size)
    got = Counter(r["doc_id"] for r in mixed.filter("regexp_count(coalesce(text, ''), '[^ \\t-\\r]+') > 0").collect())
    assert {k: n for k, n in times.items() if n} == dict(got) and mixed.columns == names
    tokens = c.write_tokens(spark, mixed, sf).collect()
    model = Tokenizer.from_file(token_files.default_tokenizer())
    crc = lambda t: zlib.crc32(np.array([*(model.encode(t, add_special_tokens=False).ids if t else []), 0], "<u4").tobytes())
    assert plain((r["doc_id"], r["ids_crc32"]) for r in tokens) == plain((r["doc_id"], crc(r["text"])) for r in mixed.collect())
    docs.unpersist()


def test_latent_space_takes_every_document(spark, monkeypatch):
    """A'AG over the passages of all documents, more than the 20,000 that were once enough."""
    from tidemark.llm import decontaminate as dc

    words = ["ant", "bee", "cat", "dog", "elk", "fox"]
    (own,) = dc.documents(*dc.utf8(dc.pa.array([" ".join(words)], dc.pa.large_string())))
    seen = []
    monkeypatch.setattr(dc.Index, "fit", lambda self, *a: seen.append((self, *a)))
    texts = [" ".join(words[j] for j in range(6) if (i * 7 + 3) >> j & 1) + (" zzz" * 70 + " ant bee" if i % 5 == 0 else "") for i in range(22_000)]
    dc.build(spark.createDataFrame([(t,) for t in texts], "text string"), [(1, own)])
    index, df, passages, sketch, test = seen[0]
    place = {w: int(index.terms(own)[i]) for i, w in enumerate(words)}
    rows = []
    for t in texts:
        w = t.split()
        for lo in range(0, len(w), dc.PASSAGE):
            rows.append([0.0] * 6)
            for x in w[lo : lo + dc.PASSAGE]:
                if x in place:
                    rows[-1][place[x]] += 1
    a = dc.np.array(rows)
    assert passages == len(rows) and df.tolist() == (a > 0).sum(axis=0).tolist()
    assert dc.np.allclose(sketch, a.T @ (a @ test), rtol=1e-4, atol=1e-4 * abs(sketch).max())
