"""Token ids in directly addressable codes: any token or document is read without decoding a block.

Ids are split into 8-bit chunks. Level 0 holds the lowest chunk of every id and a bitmap that tells which ids go on; level 1
holds the next chunk of those, and so on. A rank directory counts the set bits before every 512th, so the place of a token's
next chunk is one lookup and at most 64 bytes of bit counting away.

File: the magic, int64 counts (documents, tokens, levels), for each level int64 number of chunks, then document ids (int64),
their null flags (uint8), their starts (int64, one more than documents), and for each level chunks (uint8), bitmap (uint8,
lowest bit first) and directory (int64). All numbers are little-endian.

Documents are written in ascending order of doc_id (nulls first), each followed by id 0. Null texts are empty: they have
the end id only. Equal doc_ids stand by a hash of the text, then by text. An empty table gives no files and no rows. Other columns are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import freeing, load, parts, shared_dir, stage

MAGIC = b"TMDAC\x00\x00\x01"
STEP = 512
#: Tokens after which a task starts its next file.
ROLL = 1 << 24
#: Characters of texts whose different words are found together, words that are encoded together, and words that are kept.
CHUNK = 1 << 23
TOGETHER = 4096
KNOWN = 600_000
_BITS = np.array([bin(x).count("1") for x in range(256)], np.int64)


# ------------------------------------------------------------------ file format


def pack(ids: np.ndarray, doc_ids: np.ndarray, nulls: np.ndarray, starts: np.ndarray) -> bytes:
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bitmap = np.packbits(more, bitorder="little")
        ones = np.concatenate([[0], np.cumsum(_BITS[bitmap])])
        levels.append(((rest & 255).astype(np.uint8), bitmap, ones[:: STEP // 8].astype(np.int64)))
        rest = rest[more] >> 8
        if not len(rest):
            break
    head = np.array([len(doc_ids), len(ids), len(levels), *(len(x[0]) for x in levels)], np.int64)
    body = [doc_ids.astype(np.int64).tobytes(), nulls.astype(np.uint8).tobytes(), starts.astype(np.int64).tobytes()]
    return b"".join([MAGIC, head.tobytes(), *body, *(x.tobytes() for level in levels for x in level)])


class TokenFile:
    """Random access to a file's ids; ``source`` has ``read_at(size, offset)`` or is the file's bytes."""

    def __init__(self, source):
        self._at = (lambda n, o: memoryview(source)[o : o + n]) if isinstance(source, bytes | memoryview) else (lambda n, o: source.read_at(n, o))
        if bytes(self._at(8, 0)) != MAGIC:
            raise ValueError("this is no token file")
        self.n_docs, self.n_tokens, n = (int(x) for x in self._array(np.int64, 3, 8))
        counts = self._array(np.int64, n, 32)
        at = 32 + 8 * n
        self._docs, self._nulls, self._starts = at, at + 8 * self.n_docs, at + 9 * self.n_docs
        at = self._starts + 8 * (self.n_docs + 1)
        self._levels = []
        for c in map(int, counts):
            b = -(-c // 8)
            self._levels.append((at, at + c, at + c + b))
            at += c + b + 8 * (b // (STEP // 8) + 1)

    def _array(self, kind, n: int, at: int) -> np.ndarray:
        return np.frombuffer(self._at(n * np.dtype(kind).itemsize, at), kind, n)

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self._array(np.int64, self.n_docs, self._docs), self._array(np.uint8, self.n_docs, self._nulls).astype(bool), self._array(np.int64, self.n_docs + 1, self._starts)

    def _rank(self, level: int, i: int) -> int:
        """Set bits before bit i."""
        _, bitmap, directory = self._levels[level]
        block = i // STEP
        base = int(self._array(np.int64, 1, directory + 8 * block)[0])
        bits = self._array(np.uint8, i // 8 - block * (STEP // 8) + (i % 8 > 0), bitmap + block * (STEP // 8))
        full = bits[: i // 8 - block * (STEP // 8)]
        return base + int(_BITS[full].sum()) + (bin(int(bits[-1]) & ((1 << i % 8) - 1)).count("1") if i % 8 else 0)

    def tokens(self, start: int, end: int) -> np.ndarray:
        """The ids from start to end."""
        out, where, shift = np.zeros(end - start, np.uint32), slice(None), 0
        positions = None
        for level, (chunks, bitmap, _) in enumerate(self._levels):
            n = end - start
            if n <= 0:
                break
            value = self._array(np.uint8, n, chunks + start).astype(np.uint32) << shift
            if positions is None:
                out[where] |= value
            else:
                out[positions] |= value
            bits = np.unpackbits(self._array(np.uint8, -(-end // 8) - start // 8, bitmap + start // 8), bitorder="little")[start % 8 : start % 8 + n].astype(bool)
            if not bits.any():
                break
            positions = np.flatnonzero(bits) if positions is None else positions[bits]
            start = self._rank(level, start)
            end = start + len(positions)
            shift += 8
        return out

    def token(self, i: int) -> int:
        return int(self.tokens(i, i + 1)[0])


# ------------------------------------------------------------------ encoding


class Encoder:
    """The tokenizer's ids of many texts, with each different word of a chunk of texts encoded once, or known from earlier ones.

    A byte-level tokenizer splits a text by a fixed pattern before any merge. A piece has one space at its start or is a run
    of whitespace, so where no run goes on behind a space, a text's ids are those of its words with the space before them.
    Different words are joined for the tokenizer, and as its tokens' bytes are the text's, the lengths tell whose they are.
    Other tokenizers, and texts with an added token or with such a run, go to the tokenizer whole.
    """

    #: A space inside or at the end of a run of whitespace.
    RUN = regex.compile(r"\s (?:\s|\Z)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        form = json.loads(self.model.to_str())
        split = form.get("pre_tokenizer") or {}
        self.by_word = form.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex") is True and not split.get("add_prefix_space") and form["model"]["type"] == "BPE"
        self.added = [x.content for x in self.model.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.model.get_vocab_size() <= 1 << 16 else "<u4")
        self._forget()
        self.n_bytes = np.zeros(max(self.model.get_vocab().values()) + 1, np.int64)
        for token, i in self.model.get_vocab().items():
            self.n_bytes[i] = len(token)  # a character of a byte-level token is a byte

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def encode_each(self, texts):
        """The ids of each text, of which a chunk is held at a time."""
        held, size = [], 0
        for text in texts:
            held.append((text.as_py() if isinstance(text, pa.Scalar) else text) or "")
            size += len(held[-1])
            if size >= CHUNK:
                yield from self._chunk(held)
                held, size = [], 0
        yield from self._chunk(held)

    def encode_many(self, texts: list[str | None]) -> list[np.ndarray]:
        return list(self.encode_each(texts))

    def _forget(self) -> None:
        """Known words, with a space before each: the words, all their ids in a row, and where each word's begin."""
        self.known, self.flat, self.begin = pa.array([], pa.string()), np.zeros(0, self.kind), np.zeros(1, np.int64)

    def _chunk(self, texts: list[str]) -> list[np.ndarray]:
        hard = [i for i, x in enumerate(texts) if not self.by_word or self.RUN.search(x) or any(a in x for a in self.added)]
        kept = dict.fromkeys(hard, "")
        words = pc.split_pattern(pa.array([kept.get(i, x) for i, x in enumerate(texts)], pa.string()), " ")
        offsets, words = words.offsets.to_numpy().astype(np.int64), words.flatten().dictionary_encode()
        which, first = words.indices.to_numpy().astype(np.int32), offsets[:-1]
        words = words.dictionary
        place = self._places(words)
        # a text's first word has no space before it
        begins: dict[int, int] = {}
        heads = np.array([begins.setdefault(w, len(words) + len(begins)) for w in which[first].tolist()], np.int32)
        bare = [self.whole(words[w].as_py()) for w in begins]
        which[first] = heads
        ids = np.concatenate([self.flat, *bare])
        # a chunk's ids are counted in 32 bits: these arrays are most of what it holds
        length = np.concatenate([self.begin[place + 1] - self.begin[place], [len(x) for x in bare]]).astype(np.int32)
        start = np.concatenate([self.begin[place], len(self.flat) + np.cumsum([0, *(len(x) for x in bare)])[:-1]]).astype(np.int32)
        n = length[which]
        ends = np.zeros(len(n) + 1, np.int32)
        np.cumsum(n, out=ends[1:])
        first = start[which]
        del which, words, place
        first -= ends[:-1]
        at = np.repeat(first, n)
        del n, first
        at += np.arange(ends[-1], dtype=np.int32)
        ids = ids[at]
        at = ends[offsets]
        found = [ids[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        for i in hard:
            found[i] = self.whole(texts[i])
        return found

    def _places(self, words: pa.Array) -> np.ndarray:
        """Where each of the different words stands among the known ones; new ones are encoded and added."""
        if len(self.known) > KNOWN:
            self._forget()
        place = pc.index_in(words, value_set=self.known)
        new = words.filter(pc.is_null(place))
        place = place.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), np.flatnonzero(pc.is_null(place).to_numpy(zero_copy_only=False))
        if len(new):
            out = self._spaced(new.to_pylist())
            place[0][place[1]] = len(self.known) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, new])
            self.flat = np.concatenate([self.flat, *out])
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum([len(x) for x in out])])
        return place[0]

    def _spaced(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word with a space before it."""
        out: list = [None] * len(words)
        plain = []
        for i, word in enumerate(words):
            if word and word == word.strip():
                plain.append(i)
            else:
                out[i] = self.whole(" " + word)
        for k in range(0, len(plain), TOGETHER):
            some = plain[k : k + TOGETHER]
            ids = self.whole(" " + " ".join([words[i] for i in some]))
            ends = np.cumsum([len(words[i].encode()) + 1 for i in some])
            at = np.cumsum(self.n_bytes[ids])
            cut = np.searchsorted(at, ends)
            if len(ids) and at[-1] == ends[-1] and (at[cut] == ends).all():
                cut = [0, *(cut + 1).tolist()]
                for i, x, y in zip(some, cut[:-1], cut[1:], strict=True):
                    out[i] = ids[x:y]
            else:  # bytes that no token has
                for i in some:
                    out[i] = self.whole(" " + words[i])
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# ------------------------------------------------------------------ Spark


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, body: bytes) -> None:
    """Files get their own names, so a repeated task leaves its first attempt's files out of the manifest."""
    store, path = open_fs(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path, compression=None) as f:
        f.write(body)


def _writer(folder: str, tokenizer: str, end_id: int):
    names = ["path", "first_doc", "n_docs", "n_tokens", "file"]

    def run(batches):
        code = encoder(tokenizer)
        ids, docs, sizes, held, file = [], [], [], 0, 0

        def flush():
            doc_ids = np.array([x or 0 for x in docs], np.int64)
            starts = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])
            path = f"{folder}/{uuid.uuid4().hex}.tok"
            write_file(path, pack(np.concatenate(ids), doc_ids, np.array([x is None for x in docs], bool), starts))
            return pa.RecordBatch.from_pydict(dict(zip(names, ([path], [docs[0]], [len(docs)], [int(starts[-1])], [file]), strict=True)), schema=pa.schema([("path", pa.string()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("file", pa.int32())]))

        end = np.array([end_id], code.kind)
        for batch in batches:
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), code.encode_each(batch.column("text")), strict=True):
                ids += [own, end]
                docs.append(doc_id)
                sizes.append(len(own) + 1)
                held += len(own) + 1
                if held >= ROLL:
                    yield flush()
                    ids, docs, sizes, held, file = [], [], [], 0, file + 1
        if docs:
            yield flush()

    return run


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Writes the files and returns their manifest: ``path, base, n_docs, n_tokens``; base counts the ids of earlier files."""
    spark = docs.sparkSession
    folder = shared_dir(spark, "tokens")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tie = F.xxhash64("text")  # ranges are found from a sample of the keys: no texts among them
    ordered = docs.repartitionByRange(max(parts(spark), 8), F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie, F.col("text"))
    ordered = ordered.mapInArrow(freeing(_writer(folder, tokenizer, end_id)), "path string, first_doc long, n_docs long, n_tokens long, file int")
    written = stage(ordered.select("*", F.spark_partition_id().alias("part")), "manifest")
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    return written.select("path", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long").alias("base"), "n_docs", "n_tokens")


def _reader(batches):
    for batch in batches:
        for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
            store, name = open_fs(path)
            with store.open_input_stream(name, compression=None) as f:
                file = TokenFile(f.read())
            doc_ids, nulls, starts = file.documents()
            crc = [zlib.crc32(file.tokens(int(a), int(b)).astype("<u4").tobytes()) for a, b in zip(starts[:-1], starts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, mask=nulls), pa.array(starts[:-1] + base), pa.array(np.diff(starts)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, from the files."""
    spread = manifest.select("path", "base").repartition(parts(manifest.sparkSession))
    return spread.mapInArrow(freeing(_reader), "doc_id long, start long, n_tokens long, ids_crc32 long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    return read_tokens(write_tokens(docs, tokenizer or default_tokenizer(), end_id))


def op8_token_ids(spark, sf_dir: str) -> DataFrame:
    return token_files(load(spark, sf_dir, "documents"))
