"""Secrets in texts: patterns of known forms, and strings that a tokenizer finds hard.

A byte-pair vocabulary writes natural words and names with few tokens. A string that
takes many tokens for its characters looks like a key or a password, unless it is a
digest of a usual length, a UUID, or an identifier made of words. The test looks at every
unbroken string and every value assigned to a secret's name, whether a pattern holds it or
not, and says what it found.
"""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_texts, text_chunks

# fixed values: the patterns of the base kinds
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs of [0-9a-f]+ with 16 or more characters
KINDS = ("assign", "access", "hex", "random")

_KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
#: High-recall candidates of the token test: unbroken strings.
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}(?![A-Za-z0-9+/_=-])")
_RUN = re.compile(rb"[A-Za-z0-9+/_=-]{12}")
_DIGIT = re.compile(r"[0-9]")
_ACCENTED = re.compile(r"[\u00c0-\u024f]")
_UUID = re.compile(r"[0-9A-Fa-f]{8}-([0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}")
_HEX_ANY = re.compile(r"[0-9A-Fa-f]+")
_WORD = re.compile(r"[A-Z]?[a-z]+")
_NUMBERS = re.compile(r"[0-9+/_=-]+")
_WORDLIKE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Shorter values assigned to a secret's name are not tested.
LEAST_VALUE = 8
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)


@dataclass(frozen=True)
class TokenTest:
    """Candidates with fewer characters a token than `ratio` are random.

    short: (below so many characters, ratio), ascending; the fewer characters, the more
    often a rare word is cut as small as a random string.
    """

    ranks_path: str
    pattern: str
    ratio: float = 2.2
    short: tuple = ((16, 1.7), (20, 1.85))
    #: the same for values behind a secret's name, which is evidence too
    assigned: tuple = ((12, 1.85), (20, 2.0))

    #: and for letters in the case of a word, of which languages the vocabulary knows little have many
    letters: tuple = ((16, 1.4), (20, 1.6))

    def limit(self, s: str, assigned: bool = False) -> float:
        limits = self.assigned if assigned else self.letters if _WORD.fullmatch(s) else self.short
        return next((ratio for below, ratio in limits if len(s) < below), self.ratio)


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def made_of_words(s: str, enc: tiktoken.Encoding, ratio: float) -> bool:
    """Parts of at most two letter or digit runs; letter runs that tokenize like words, and are half of the characters at least."""
    runs = [_WORDLIKE.findall(p) for p in re.split(r"[+/_=-]+", s) if p]
    if any(len(r) > 2 for r in runs):
        return False
    letters = [x for r in runs for x in r if not x.isdigit()]
    words = [x for x in letters if len(x) > 2]
    # one or two letters tell nothing
    return all(len(x) >= ratio * len(enc.encode_ordinary(x)) for x in words) and 2 * sum(map(len, words)) >= sum(len(x) for r in runs for x in r)


def known_form(s: str, enc: tiktoken.Encoding, ratio: float) -> str | None:
    """digest (UUIDs too) or identifier: plain numbers also with separators, and words with short numbers."""
    if _UUID.fullmatch(s) or (_HEX_ANY.fullmatch(s) and len(s) in DIGEST_LENGTHS):
        return "digest"
    if _NUMBERS.fullmatch(s) or (len([p for p in re.split(r"[+/_=-]+", s) if p]) > 1 and made_of_words(s, enc, ratio)):
        return "identifier"
    return None


def part_of_word(text: str, start: int, end: int) -> bool:
    """Letters beside an accented one: the rest of a word, not a string of its own."""
    beside = text[max(start - 1, 0) : start] + text[end : end + 1]
    return _ACCENTED.search(beside) is not None and _DIGIT.search(text, start, end) is None


def base_spans(text: str, lowered: bytes) -> list[tuple[str, int, int]]:
    found = []
    if any(k in lowered for k in _KEYWORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if b"akia" in lowered:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return found


def told_by_base(text: str, start: int, end: int, base: list, enc: tiktoken.Encoding, ratio: float) -> bool:
    """Whether base spans hold the candidate, but for words that a separator sets off (a path before a digest)."""
    rest, at = [], start
    for a, b in sorted((a, b) for _, a, b in base if a < end and start < b):
        if a > at:
            rest.append((at, a))
        at = max(at, b)
    if at == start:  # no base span overlaps it
        return False
    if at < end:
        rest.append((at, end))
    set_off = lambda a, b: (a == start or text[a] in "+/_=-") and (b == end or text[b - 1] in "+/_=-")
    return all(set_off(a, b) and made_of_words(text[a:b], enc, ratio) for a, b in rest)


def assigned_values(text: str) -> list[tuple[int, int]]:
    """What follows a secret's name, without a full stop at its end."""
    spans = (m.span(2) for m in ASSIGN.finditer(text))
    return [(a, b) for a, b in ((a, a + len(text[a:b].rstrip("."))) for a, b in spans) if b - a >= LEAST_VALUE]


def verdict_of(text: str, start: int, end: int, assigned: bool, enc: tiktoken.Encoding, test: TokenTest) -> tuple[float, str]:
    """Characters a token, and random, text, digest, identifier or word. The name before an assigned value outweighs a digest's form."""
    s = text[start:end]
    ratio = len(s) / len(enc.encode_ordinary(s))
    if ratio >= test.limit(s, assigned):
        return ratio, "text"
    known = known_form(s, enc, test.ratio)
    if known and not (assigned and known == "digest"):
        return ratio, known
    return ratio, "word" if part_of_word(text, start, end) else "random"


def examine(text: bytes, test: TokenTest) -> tuple[list, list, list]:
    """Base spans and all spans of a text, as (kind, start, end) in code points, in order; and
    what the token test looked at, as (start, end, characters a token, verdict)."""
    lowered = text.lower()
    runs = _RUN.search(text) is not None
    s = text.decode("utf-8", "replace")
    base = base_spans(s, lowered)
    base += [("hex", m.start(), m.end()) for m in HEX.finditer(s)]
    values = assigned_values(s) if any(k in lowered for k in _KEYWORDS) else []
    more, tested = [], []
    if runs or values:
        enc = _encoding(test.ranks_path, test.pattern)
        for a, b in values:
            tested.append((a, b, *verdict_of(s, a, b, True, enc, test)))
            if tested[-1][3] == "random" and not any(x <= a and b <= y for _, x, y in base):
                more.append(("random", a, b))
        for m in _CANDIDATE.finditer(s) if runs else ():
            a, b = m.span()
            if (a, b) in values:
                continue
            tested.append((a, b, *verdict_of(s, a, b, False, enc, test)))
            if tested[-1][3] == "random" and not told_by_base(s, a, b, base, enc, test.ratio):
                more.append(("random", a, b))
    order = lambda x: (x[1], KINDS.index(x[0]))
    return sorted(base, key=order), sorted(base + more, key=order), sorted(tested)


def scan(text: bytes, test: TokenTest) -> tuple[list, list]:
    """Base spans and all spans of a text."""
    return examine(text, test)[:2]


def joined(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def secret_scan(df: DataFrame, test: TokenTest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, base, spans, tested) per document; code points, end exclusive.

    base: (kind, start, end) of the patterns alone. spans: also what the token test adds,
    strings of 12 characters or more and assigned values of 8 or more, with stricter limits
    for shorter ones. tested: (start, end, ratio, verdict) of all that it looked at, held by
    a base span or not. Spans with one start stand in the order of KINDS. A null text counts
    as empty and has no spans; a text of any length is read whole, in memory in proportion
    to it. Null or repeated ids give a row each; empty input gives no rows; other columns
    are ignored.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    seen = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("ratio", pa.float64()), ("verdict", pa.string())]))

    def run(batches):
        for batch, texts in text_chunks(batches, "text"):
            found = [examine(t or b"", test) for t in texts]
            columns = (pa.array([[dict(zip(names, x)) for x in f[i]] for f in found], kind) for i, names, kind in ((0, ("kind", "start", "end"), span), (1, ("kind", "start", "end"), span), (2, ("start", "end", "ratio", "verdict"), seen)))
            yield pa.RecordBatch.from_pydict({"id": batch.column(0)} | dict(zip(("base", "spans", "tested"), columns)))

    spans = "array<struct<kind:string,start:long,end:long>>"
    return map_texts(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, base {spans}, spans {spans}, tested array<struct<start:long,end:long,ratio:double,verdict:string>>").withColumnRenamed("id", id_col)


def redact(text: str, spans: list, mark: str = "[SECRET]") -> str:
    """The text with every span replaced; overlapping spans give one mark."""
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])
