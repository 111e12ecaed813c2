"""Operators against brute force on small tables, with nulls, empty and repeated rows, ties, and columns that clash."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest

from tidemark.llm import decontaminate, language, mixing, ngram_jaccard, pii, suffix_dedup, token_files, topk, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, node long, size long"


def docs(spark, rows):
    full = [(i, t, "en", s, None if t is None else len(t), 0.5, 1, 2) for i, t, s in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = [words(rng, 120) for _ in range(8)]
    rows = []
    for i in range(90):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((1000 - 3 * i, " ".join(w), f"s{i % 4}" if i % 9 else None))
    rows += [(5, None, "s1"), (6, "", "s1"), (7, "one two", "s2"), (8, "One TWO", "s2"), (9, "é ü x", "s3"), (9, "é ü x", "s3"), (11, "a " * 30_000, "s0"), (12, " \t\n", None)]
    return rows


def components(rows, n, num, den):
    sets = [(i, ngram_jaccard.word_set(t, n)) for i, t, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and den * both >= num * (len(sets[a][1]) + len(sets[b][1]) - both):
                root[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(i, least.get(find(a), i))
    return sorted((i, len(s), least[find(a)]) for a, (i, s) in enumerate(sets))


@pytest.mark.parametrize(("n", "num"), [(4, 85), (5, 80)])
def test_jaccard(spark, corpus, n, num):
    got = sorted(map(tuple, ngram_jaccard.ngram_jaccard_join(docs(spark, corpus), n, num, 100).collect()))
    assert got == components(corpus, n, num, 100)


def test_jaccard_small_sets(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{(s + k) % 30}" for k in range(rng.randrange(4, 16))), "a") for i, s in enumerate(rng.choices(range(30), k=80))]
    assert sorted(map(tuple, ngram_jaccard.ngram_jaccard_join(docs(spark, rows)).collect())) == components(rows, 4, 85, 100)


def test_mix(spark, corpus):
    d = docs(spark, corpus)
    a = mixing.mix_sources(d).toPandas()
    assert len(a) == len(corpus) and (a.taken <= 2 * a["size"]).all()
    assert sorted(map(tuple, a.values.tolist())) == sorted(map(tuple, mixing.mix_sources(d).toPandas().values.tolist()))
    source = {i: s for i, _, s in corpus}
    assert abs(a.assign(source=[str(source[i]) for i in a.doc_id]).drop_duplicates("source").target.sum() - 1.5 * a["size"].sum()) < 1e-3
    mixed = mixing.mixed_documents(d)
    assert mixed.columns == d.columns


def test_topk(spark):
    rng = np.random.default_rng(2)
    v = {i: rng.normal(size=16).tolist() for i in range(200)} | {3: [0.5] * 16, 4: [0.5] * 16, 5: [0.5] * 16}
    rows = list(v.items()) + [(300, None), (301, [1.0, None] + [0.0] * 14), (302, [float("nan")] * 16), (None, [1.0] * 16), (4, [0.5] * 16), (350, [])]
    got = sorted(map(tuple, topk.topk_search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()))
    q = {i: np.floor(256 * np.array(x)).astype(int) for i, x in v.items()}
    want = []
    for i in range(0, 200, 50):
        best = sorted((-(q[i] @ q[j]), j) for j in q if j != i)[:5]
        want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    assert got == sorted(want)


def test_levenshtein():
    terms = {"scum": 1.0, "moron": 2.0, "abc*": 0.5}
    lexicon = toxicity.Lexicon(terms)
    assert lexicon.match("moron") == (0, 2.0) and lexicon.match("abcdef") == (1, 0.5) and lexicon.match("scim") is None
    rng = random.Random(3)

    def edits(w):
        letters = "abcmnorsu1"
        return {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for c in letters for k in (0, 1)}

    near = edits("moron") - {"moron"}
    assert all(lexicon.match(w) == (2, 2.0) for w in near)
    for _ in range(300):
        w = "".join(rng.choice("mornx") for _ in range(5))
        if w != "moron" and w not in near and not w.startswith("abc"):
            assert lexicon.match(w) is None


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = toxicity.op4_toxicity(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = got[got.held_out]
    p, n = held[held.toxic == 1].score.to_numpy(), held[held.toxic == 0].score.to_numpy()
    assert ((p[:, None] > n).mean() + (p[:, None] == n).mean() / 2) > 0.85


def test_toxicity(spark):
    rng = random.Random(4)
    rows = [(i, words(rng, 40) + (" moron" if i % 4 == 0 else ""), "s") for i in range(400)] + [(900, None, "s"), (901, "", "s"), (902, "mor0n here", "s")]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(1, None, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs(spark, rows), labels).toPandas().set_index("doc_id")
    assert len(got) == len(rows) and all(got.predicted[i] == (i % 4 == 0) for i in range(400)) and got.predicted[900] == 0 and got.score[902] > got.score[901]
    assert all(got.held_out[i] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(400))
    none = toxicity.score_toxicity(docs(spark, rows), labels.limit(0)).toPandas()
    assert (none.score < 0.01).all() and toxicity.score_toxicity(docs(spark, []), labels).count() == 0


def test_pii(spark):
    text = "a@b.co x@y@z.com,q 1.2.3.4.5 999.1.1.1 +1 (555) 010-1234 4111 1111 1111 1111 4111111111111112 +12 é@ü.de 0001.002.3.4 a@b account: 12345678 http://x.org/y. IBAN: GB82 WEST 1234 5698 7654 32"
    rng = random.Random(6)
    noise = ["".join(rng.choice("0123456789.+-@ (a)é") for _ in range(300)) for _ in range(60)]
    rows = [(i, t, "s") for i, t in enumerate([text, None, "", *noise])]
    got = {r["doc_id"]: r for r in pii.find_pii(docs(spark, rows)).collect()}
    for i, t, _ in rows:
        base = []
        for kind, pattern in (("email", pii.EMAIL), ("ip", pii.IP), ("card", pii.CARD), ("phone", pii.PHONE)):
            for m in pattern.finditer(t or ""):
                digits = re.sub("[^0-9]", "", m.group())
                ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
                if ok:
                    base.append(f"{kind}:{m.start()}:{m.end()}")
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(got[i]["spans"].split(",")) or not base
    assert all(k in got[0]["spans"] for k in ("url:", "iban:", "account:"))


def test_warc(spark):
    rows = [(4, "u4", "<a>é</a>"), (2, "u2", "<a>é</a>"), (3, None, None), (9, "u9", ""), (7, "u7", "x" * 300_000), (None, "n", "<a>é</a>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.warc_round_trip(pages).collect()}
    assert len(got) == 6 and (got[4]["record_type"], got[4]["refers_to"]) == ("revisit", 2) and (got[9]["record_type"], got[9]["refers_to"]) == ("revisit", 3) and got[2]["record_type"] == "response"
    assert got[4]["payload_digest"] == base64.b32encode(hashlib.sha1("<a>é</a>".encode()).digest()).decode() and got[7]["payload_bytes"] == 300_000
    back = warc.read_warc(warc.write_warc(pages))
    again = back.filter("record_type = 'revisit'").collect()  # a page without id is one of the others
    assert sorted((r["page_id"] or 0, r["refers_to"]) for r in again) == [(0, 2), (4, 2), (9, 3)]
    assert warc.warc_round_trip(pages.limit(0)).count() == 0


def brute_dedup(rows, length=50):
    first, out = {}, []
    for d, t in sorted((d, (t or "").encode()) for d, t, _ in rows):
        for i in range(len(t) - length + 1):
            first.setdefault(t[i : i + length], d)
    for d, t, _ in rows:
        t = (t or "").encode()
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if first[t[i : i + length]] < d:
                gone[i : i + length] = True
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0
        out.append((d, len(t), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return sorted(out)


def test_suffix_array():
    rng = np.random.default_rng(0)
    for n in (1, 3, 4, 5, 40, 500):
        x = rng.integers(1, 4, n)
        assert suffix_dedup.suffix_array(x).tolist() == sorted(range(n), key=lambda i: x[i:].tolist())


def test_suffix_dedup(spark, corpus):
    rows = corpus[:60] + [(2000 + i, "shti " * (20 + i) + f"q{i}" * 9, "s") for i in range(8)] + corpus[90:96] + [(1, corpus[0][1], "s"), (1, corpus[0][1], "s")]
    assert sorted(map(tuple, suffix_dedup.suffix_dedup(docs(spark, rows)).collect())) == brute_dedup(rows)
    # every anchor window by window, or only those with a few stretches
    for hot in (1, 3):
        assert sorted(map(tuple, suffix_dedup.suffix_dedup(docs(spark, rows), hot=hot).collect())) == brute_dedup(rows)


def test_tokens(spark):
    from tokenizers import Tokenizer

    path = token_files.default_tokenizer()
    model = Tokenizer.from_file(path)
    rng = random.Random(9)
    texts = ["Hello  world's 123\n\n x　y", None, "", "<|endoftext|> é", *("".join(rng.choice("ab é\n1.'s中🙂") for _ in range(200)) for _ in range(40))]
    got = sorted(map(tuple, token_files.token_files(docs(spark, [(99 - i, t, "s") for i, t in enumerate(texts)])).collect()))
    start, want = 0, []
    for i in range(len(texts) - 1, -1, -1):
        ids = [*(model.encode(texts[i], add_special_tokens=False).ids if texts[i] else []), 0]
        want.append((99 - i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want)


def test_codes():
    ids = np.random.default_rng(1).choice([0, 5, 255, 256, 70_000, 50_256, 2**31], 5000).astype(np.uint32)
    f = token_files.TokenFile(token_files.pack(ids, np.array([1]), np.array([False]), np.array([0, 5000])))
    assert (f.tokens(0, 5000) == ids).all() and (f.tokens(517, 1029) == ids[517:1029]).all()
    assert [f.token(i) for i in range(0, 5000, 7)] == ids[::7].tolist()


def test_decontaminate(spark):
    rng = random.Random(10)
    items = [words(rng, n, 3000) for n in (12, 20, 33, 60, 90, 3)]
    bench = spark.createDataFrame([*enumerate(items), (90, None), (91, " "), (0, items[0])], "item_id long, text string")
    rows = [(i, words(rng, 200, 3000), "s") for i in range(60)] + [(900, None, "s"), (901, "", "s")]
    for k, item in enumerate(items):
        rows.append((100 + k, f"{words(rng, 70, 3000)} {item} {words(rng, 90, 3000)}", "s"))
    near = items[3].split()
    near[7] = near[31] = near[50] = "other"
    rows.append((200, f"{words(rng, 50, 3000)} {' '.join(near).upper()}, {words(rng, 40, 3000)}", "s"))
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(docs(spark, rows), bench).collect()}
    assert len(got) == len(rows) and {i for i, r in got.items() if r["contaminated"]} == {*range(100, 106), 200}
    assert [got[100 + k]["item_id"] for k in range(6)] == list(range(6)) and got[200]["item_id"] == 3
    assert not any(r["contaminated"] for r in decontaminate.decontaminate(docs(spark, rows[:3]), bench.limit(0)).collect())


def test_decontaminate_hot_copies_of_a_changed_item(spark):
    rng = random.Random(12)
    item = words(rng, 30, 3000).split()
    changed = [*item]
    changed[4], changed[17] = "other", "another"
    hot = f"{words(rng, 50, 3000)} {' '.join(changed)} {words(rng, 40, 3000)}"
    rows = [(i, hot if i % 3 == 0 else words(rng, 120, 3000), "s") for i in range(150)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, words(rng, 25, 3000))], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(docs(spark, rows), bench).collect()}
    assert {i for i, r in got.items() if r["contaminated"]} == {i for i in range(150) if i % 3 == 0}
    assert got[0]["item_id"] == 1 and abs(got[0]["score"] - 28 / 30) < 1e-9


def test_decontaminate_item_among_repeats(spark):
    rng = random.Random(13)
    items = [words(rng, n, 3000) for n in (17, 18, 20, 33, 36) for _ in range(12)]
    rows = [(1000 + i, words(rng, 120, 3000), "s") for i in range(600)]
    for k, item in enumerate(items):
        repeats = f"{items[(7 * k + 5) % 60].split()[3]} " * 60
        rows.append((k, f"{repeats}{item} {repeats}", "s"))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(docs(spark, rows), bench).collect()}
    assert [k for k in range(60) if (got[k]["item_id"], got[k]["score"]) != (k, 1.0)] == []


def test_gradients():
    net = language.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = language.padded([b"abc", b"de", b"fghij"])
    y = np.array([0, 1, 2])
    _, g = net.gradients(x, mask, y)
    for k, at in (("E", (ord("e"), 3)), ("Wb", (2, 5)), ("cb", (7,)), ("Of", (3, 1))):
        net.p[k][at] += 1e-3
        up = net.gradients(x, mask, y)[0]
        net.p[k][at] -= 2e-3
        down = net.gradients(x, mask, y)[0]
        net.p[k][at] += 1e-3
        assert abs((up - down) / 2e-3 - g[k][at]) < 1e-4


def test_language(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    got = language.identify_language(d).toPandas().merge(d.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert len(got) == 200 and (held.lang == held.lang_pred).mean() >= 0.95
    odd = language.identify_language(docs(spark, [(1, None, "s"), (2, "12 !", "s"), (3, "the", "s")])).toPandas().set_index("doc_id")
    assert list(odd.lang_pred[[1, 2]]) == ["und", "und"]


def test_pipeline(spark, sf):
    import corpus_pipeline as c

    table = spark.read.parquet(f"{sf}/documents.parquet")
    toxic = c.reject_toxic(spark, table, sf)
    assert toxic.columns == table.columns and 100 < toxic.count() < 200
    kept = c.keep_one_of_each_group(spark, table, sf)
    rows = [(r["doc_id"], r["text"], None) for r in table.collect()]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({g for _, _, g in components(rows, 5, 80, 100)})
    bench = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = {r["doc_id"] for r in c.drop_benchmark(spark, table, sf).collect()}
    assert not any(b in t for i, t, _ in rows if i in clean for b in bench)
    assert c.run(spark, sf).count() > 0


def test_token_encoder_keeps_whitespace_runs_and_added_tokens():
    import random

    code, draw = token_files.Encoder(token_files.default_tokenizer()), random.Random(3)
    some = ["a", "bc", "'s", "1", ".", " ", " ", "\n", "\t", " ", " ", "é", "中", "\x1c", "\x85", "'ll", "<|endoftext|>", "\U0001f600"]
    texts = [None, "", " ", "x" * 50_000, *("".join(draw.choices(some, k=draw.randint(0, 14))) for _ in range(5000))]
    got = code.encode_many(texts)
    assert all(x.tolist() == code.model.encode(t or "", add_special_tokens=False).ids for x, t in zip(got, texts, strict=True))
    assert code.encode_many([]) == []
