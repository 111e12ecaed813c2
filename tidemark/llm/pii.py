"""Personal data by anchor expansion: an Aho-Corasick automaton finds cues, local parsers expand and validate around them.

Anchors are at-signs, digits joined by a dot, digits next to each other (or one blank or hyphen apart), a plus before a
digit, ``://`` and cue words. A parser goes back from its anchor to where a match must begin, never before the end of the
kind's last match, and matches from there, so each kind's base spans equal those of a leftmost non-overlapping search.
A match that fails its check is dropped and its text is not tried again.

Base kinds: email; ip (parts at most 255); card (13 to 19 digits passing Luhn); phone (9 to 15 digits). The method adds url
(scheme, host and rest without trailing punctuation), iban (mod 97) and account (a cue word in any case, then a whole
identifier of any length with at least four digits). Spans are code points, the end exclusive; kinds are judged on their own, so spans of two kinds can overlap.

Null and empty texts have no spans. Repeated rows give repeated results. An empty table gives no rows. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import load

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "account")

#: The shapes that the base kinds are defined by.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
URL = re.compile(r"[^\s<>\"'`|{}]+")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
VALUE = re.compile(r"(?:\s{0,2}(?:number|no\.?|id))?[\s:=#\"']{1,5}([A-Za-z0-9][A-Za-z0-9-]{4,}[A-Za-z0-9])", re.IGNORECASE)
SMALL = {c: c + 32 for c in range(65, 91)}
SCHEMES = ("http", "https", "ftp", "ftps", "ssh", "ws", "wss", "mailto", "file", "s3", "git")
CUES = ("account", "acct", "passport", "ssn", "token", "api_key", "apikey", "secret", "customer", "member", "policy")


@cache
def automaton() -> ahocorasick.Automaton:
    """Cue -> (kind, length). Cues of one kind that end together stand for the longest."""
    a = ahocorasick.Automaton()
    a.add_word("@", ("email", 1))
    for x in "0123456789":
        a.add_word(f"+{x}", ("phone", 2))
        for y in "0123456789":
            a.add_word(f"{x}.{y}", ("ip", 3))
            for between in ("", " ", "-"):
                a.add_word(f"{x}{between}{y}", ("card", 2 + len(between)))
    a.add_word("://", ("url", 3))
    for cue in CUES:
        a.add_word(cue, ("account", len(cue)))
    a.add_word("iban", ("iban", 4))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return len(s) >= 15 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _back(text: str, at: int, stop: int, kind: frozenset) -> int:
    while at > stop and text[at - 1] in kind:
        at -= 1
    return at


def find_spans(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """The spans of each kind, by start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not text:
        return found
    last = dict.fromkeys(KINDS, 0)
    small = text.lower()
    if len(small) != len(text):  # a letter became two
        small = text.translate(SMALL)
    for end, (kind, size) in automaton().iter(small):  # cues in any case, at the same places
        at, stop = end + 1 - size, last[kind]
        if at < stop and kind != "ip":
            continue
        if kind == "card":
            m = CARD.match(text, at)
            last[kind] = m.end()
            digits = "".join(c for c in m.group() if c in DIGITS) if m.end() - m.start() >= 13 else ""
            if 13 <= len(digits) <= 19 and luhn(digits):
                found[kind].append(m.span())
        elif kind == "email":
            start = _back(text, at, stop, LOCAL)
            if start < at and (m := EMAIL.match(text, start)):
                last[kind] = m.end()
                found[kind].append(m.span())
        elif kind == "ip":
            if at < stop:
                continue
            start = _back(text, at + 1, stop, DIGITS)
            if m := IP.match(text, start):
                last[kind] = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                    found[kind].append(m.span())
        elif kind == "phone":
            if m := PHONE.match(text, at):
                last[kind] = m.end()
                if 9 <= sum(c in DIGITS for c in m.group()) <= 15:
                    found[kind].append(m.span())
        elif kind == "url":
            start = at
            while start > stop and start > at - 8 and text[start - 1].isascii() and text[start - 1].isalnum():
                start -= 1
            if text[start:at].lower() in SCHEMES and (m := URL.match(text, at + 3)):
                stop_at = at + 3 + len(m.group().rstrip(".,;:!?)]*#$%&"))
                if stop_at > at + 3:
                    last[kind] = stop_at
                    found[kind].append((start, stop_at))
        elif kind == "iban":
            skip = at + 4
            while skip < min(len(text), at + 9) and text[skip] in " :=#":
                skip += 1
            if (m := IBAN.match(text, skip)) and (span := _iban(m.group(), skip)):
                last[kind] = span[1]
                found[kind].append(span)
        elif (m := VALUE.match(text, at + size)) and sum(c in DIGITS for c in m.group(1)) >= 4:
            last[kind] = m.end(1)
            found[kind].append(m.span(1))
    return found


def _iban(s: str, at: int) -> tuple[int, int] | None:
    """The longest beginning that passes the check: blanks make the end open."""
    for end in range(len(s), 14, -1):
        if s[end - 1] != " " and mod97(s[:end]):
            return at, at + end
    return None


def joined(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _scan(batches):
    names = [x.split()[0] for x in OUT.split(", ")]
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            found = find_spans(text.as_py())
            rows.append((*(len(found[k]) for k in BASE), hashlib.sha256(joined(found, BASE).encode()).hexdigest(), joined(found, KINDS)))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], names)


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``, a row for each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_scan, OUT)


def op5_pii(spark, sf_dir: str) -> DataFrame:
    return find_pii(load(spark, sf_dir, "documents"))
