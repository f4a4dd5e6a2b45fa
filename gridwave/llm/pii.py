"""Personal data: generous candidate generators, boosted trees, calibrated thresholds.

Generators propose overlapping spans: whatever looks like a stated form, whether it passes
that form's test or not, and looser forms (national phone numbers, obfuscated addresses,
IBANs, social security numbers, IPv6). Boosted trees score every one of them by format and
context; a threshold per kind, calibrated for a precision on contexts that the trees have
not seen, selects them, the best first where they overlap. Spans that pass a stated form
(the base) always stay; what the trees select beside them is added.

The tables hold no labelled spans. The trees learn in contexts of the tables: candidates
found there, right where a stated form's test passes, and values of stated shapes, personal
or not, written into passages of documents that the fit may see.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import map_texts, text_chunks
from .boosting import BoostedTrees
from .store import Scratch

# fixed values: the patterns and order of the base kinds
BASE_KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGIT = re.compile(r"[0-9]")
KINDS = (*BASE_KINDS, "iban", "ssn", "ip6")
#: Generators of further candidates, high in recall.
GENERATORS = {
    "email": re.compile(r"(?<![\w.])[\w.]{2,40}\x20?[\[(]\x20?at\x20?[\])]\x20?[\w-]{2,40}(?:\x20?[\[(]\x20?dot\x20?[\])]\x20?[\w-]{2,20}|\.[a-z]{2,6})+", re.IGNORECASE),
    "phone": re.compile(r"(?<![\w.+-])(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20./-])[0-9]{2,8}(?:[\x20./-][0-9]{2,8}){0,4}(?![\w-])"),
    "iban": re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)", re.IGNORECASE | re.ASCII),
    "ssn": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    "ip6": re.compile(r"(?<![\w:])(?:(?:[0-9a-f]{1,4}:){4,7}[0-9a-f]{1,4}|(?:[0-9a-f]{1,4}:){1,6}(?::[0-9a-f]{1,4}){1,6})(?![\w:])", re.IGNORECASE),
}
_CUES = {
    "email": ("mail", "contact", "write", "courriel", "correo"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "ruf", "handy", "numéro", "llam"),
    "iban": ("iban", "account", "konto", "compte", "cuenta", "bank"),
    "ssn": ("ssn", "social"),
    "ip6": ("ip", "host", "address", "server"),
    "ip": ("ip", "host", "address", "server"),
    "card": ("card", "visa", "karte", "carte", "tarjeta", "pay"),
}
_AGAINST = ("version", "isbn", "order", "invoice", "page", "date", "ref", "part", "serial", "score", "model", "total", "ratio", "chapter", "release")


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def forms(text: str) -> list[tuple[str, int, int, bool]]:
    """Leftmost non-overlapping matches of the base patterns, by kind and start, and whether they pass their test."""
    found, at, end = [], text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            found.append(("email", begin, m.end(), True))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    found += [("ip", *m.span(), all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))) for m in _IP.finditer(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = _digits(m[0])
            found.append(("card", *m.span(), 13 <= len(d) <= 19 and luhn(d)))
    found += [("phone", *m.span(), 9 <= len(_digits(m[0])) <= 15) for m in _PHONE.finditer(text)]
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The matches that pass."""
    return [x[:3] for x in forms(text) if x[3]]


#: Digits of a proposed span that may be a number at all.
_LONGEST = 64


def candidates(text: str, formed: list | None = None) -> list[tuple[str, int, int]]:
    """What the generators find, each span of a kind once; those whose characters the text lacks aren't tried."""
    digits = _DIGIT.search(text) is not None
    may = {"email": "(" in text or "[" in text, "phone": digits, "iban": digits, "ssn": digits, "ip6": text.count(":") >= 2}
    found = [x[:3] for x in (forms(text) if formed is None else formed) if x[2] - x[1] <= _LONGEST]
    return list(dict.fromkeys([*found, *((k, *m.span()) for k, g in GENERATORS.items() if may[k] for m in g.finditer(text))]))


def _mod97(s: str) -> int:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def features(text: str, span: tuple[str, int, int]) -> list[float]:
    kind, a, b = span
    s, before, after = text[a:b], text[max(0, a - 24) : a].lower(), text[b : b + 12].lower()
    d = _digits(s)
    groups = [len(g) for g in re.split(r"[^0-9]+", s) if g]
    parts = s.split(".")
    return [
        *(float(kind == k) for k in KINDS),
        len(s), len(d), len(groups), max(groups, default=0), min(groups, default=0),
        float(any(c in before for c in _CUES[kind])), float(any(c in before for c in _AGAINST)),
        float(len(set(d)) <= 2), float(s[:1] == "("), float(s[:1] == "+"), float(d[:1] == "0"), s.count("."), s.count("/"), s.count("-"), s.count(" "),
        float(bool(re.match(r"(19|20)\d\d[-/.]|\d\d[-/.]\d\d[-/.](19|20)?\d\d$", s))),
        float(kind == "iban" and _mod97(s) == 1), float(kind == "ssn" and (d[:3] in ("000", "666") or d[0] == "9" or d[3:5] == "00")),
        float(13 <= len(d) <= 19 and luhn(d)), float(kind == "ip" and all(len(p) < 4 and int(p) <= 255 for p in parts)),
        sum("0" <= c <= "9" for c in before), sum("0" <= c <= "9" for c in after), float(after[:1] in ("%", "€", "$", ":")), float(bool(re.search(r"[a-z]$", before))),
    ]


#: Contexts that the fit takes from the tables at most of each sort, the examples that it
#: composes in them, its seed, the precision that it asks for, and the bytes beside a candidate.
CONTEXTS, EXAMPLES, SEED, PRECISION, BESIDE = 3000, 9000, 20240517, 0.99, 80


def compose(r: random.Random, context: tuple[str, str] | None = None) -> tuple[str, tuple[str, int, int], int]:
    """A passage with one value written into it, and whether that is personal data; without a passage, among made words."""
    word = lambda: "".join(r.choice("aeinorstlhd") for _ in range(r.randint(2, 9)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    kind = r.choice(("email", "phone", "phone", "iban", "ssn", "ip6", "ip", "card"))
    yes = r.random() < 0.5
    cue, sep = r.choice(_CUES[kind]), r.choice(" .-")
    cued = yes and r.random() < 0.5
    if kind == "email":
        form = r.choice((f"{word()} (at) {word()} (dot) com", f"{word()}.{num(2)}@{word()}.{r.choice(('com', 'org', 'de'))}")) if yes else r.choice((f"{word()} (at) {word()}.{word()[:3]}", f"{word()}@{num(1)}.{num(1)}"))
    elif kind == "phone":
        if yes:
            national = f"({num(3)}) {num(3)}{sep}{num(4)}", f"{num(3)}{sep}{num(3)}{sep}{num(4)}", f"0{num(3)} {num(3)} {num(4)}", f"0{num(1)}{sep}{num(2)}{sep}{num(2)}{sep}{num(2)}{sep}{num(2)}", f"0{num(2)}/{num(7)}"
            abroad = f"+{r.randint(1, 98)} ({num(3)}) {num(3)}-{num(4)}", f"+{r.randint(1, 98)} {num(3)} {num(3)} {num(4)}", f"+{num(11)}"
            form = r.choice(r.choice((national, abroad)))
            cued = yes and (form[0] not in "+(" or r.random() < 0.5)  # bare groups of digits tell nothing alone
        else:
            form = r.choice((f"{r.randint(1900, 2099)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{r.randint(1, 28):02d}.{r.randint(1, 12):02d}.{r.randint(1900, 2099)}", f"{num(2)}.{num(2)}", f"{num(3)} {num(3)} {num(3)}", f"{num(4)} {num(4)}", f"{num(3)}.{num(2)}.{num(2)}", f"{num(3)}-{num(2)}", f"{num(3)}{sep}{num(3)}{sep}{num(4)}", f"+{num(1)} {num(2)}", f"+{num(20)}"))
    elif kind == "iban":
        body = r.choice(("DE", "FR", "ES", "GB")) + "00" + num(18)
        form = body[:2] + f"{98 - _mod97(body):02d}" + body[4:] if yes else r.choice("QXZ") + r.choice("QXZ") + num(20)
        form = r.choice((form, form.lower(), " ".join(form[i : i + 4] for i in range(0, len(form), 4))))
    elif kind == "ssn":
        form = f"{r.randint(100, 665)}-{r.randint(10, 99)}-{num(4)}" if yes else r.choice(("000", "666", "9" + num(2))) + f"-{num(2)}-{num(4)}"
    elif kind == "ip":
        form = ".".join(str(r.randint(0, 255)) for _ in range(4)) if yes else r.choice((f"{num(1)}.{num(1)}.{r.randint(256, 9999)}.{num(2)}", f"{r.randint(1900, 2099)}.{num(2)}.{num(2)}.{num(4)}"))
    elif kind == "card":
        form = num(r.choice((12, 14, 15)))
        form += next(c for c in "0123456789" if luhn(form + c) == yes)
        form = form if r.random() < 0.5 else sep.replace(".", "-").join(form[i : i + 4] for i in range(0, len(form), 4))
    else:
        group = lambda n: [f"{r.randint(0, 65535):x}" for _ in range(n)]
        form = r.choice((":".join(group(8)), ":".join(group(2)) + "::" + ":".join(group(r.randint(1, 4))), "fe80::" + ":".join(group(4)))) if yes else r.choice((":".join(num(2) for _ in range(r.choice((5, 6)))), f"{num(1)}::{num(1)}", f"{num(2)}::{num(2)}"))
    lead = f" {cue}{r.choice((': ', ' '))}" if cued else f" {r.choice(_AGAINST)}{r.choice((': ', ' '))}" if (not yes and r.random() < 0.5) or (kind == "phone" and not yes and r.random() < 0.8) else " "
    tail = r.choice((" ", ". ", ", ", ") ")) if yes or r.random() < 0.8 else r.choice((" " + num(3) + " ", "% ", ": " + num(2) + " "))
    left, right = context or (f"{word()} {word()}", f"{word()} {word()}")
    left = left.rstrip() + lead
    return left + form + tail + right.lstrip(), (kind, len(left), len(left) + len(form)), int(yes)


class Selector:
    """Trees and thresholds; fitted once on the driver and sent with the tasks.

    passages: (text before, text after) of blanks in the tables; found: (context, span,
    label) of candidates in the tables.
    """

    def __init__(self, passages: list | None = None, found: list | None = None, examples: int = EXAMPLES, seed: int = SEED, precision: float = PRECISION):
        r = random.Random(seed)
        made = [(compose(r, passages[i % len(passages)] if passages else None), i % (len(passages) if passages else examples)) for i in range(examples)]
        made += [((text, span, label), i) for i, (text, span, label) in enumerate(found or [])]
        x, y = np.array([features(t, s) for (t, s, _), _ in made]), np.array([v for (*_, v), _ in made])
        kinds = np.array([s[0] for (_, s, _), _ in made])
        held = np.array([i for _, i in made]) % 3 == 0  # by passage, so that both parts have none in common
        self.trees = BoostedTrees().fit(x[~held], y[~held])
        p = self.trees.predict(x[held])
        self.threshold = {k: self._calibrated(p[kinds[held] == k], y[held][kinds[held] == k], precision) for k in KINDS}

    @staticmethod
    def _calibrated(p, y, precision) -> float:
        """The least score from which on the held-out precision holds; above every score if it never does."""
        order = np.argsort(-p, kind="stable")
        right = np.cumsum(y[order]) / np.arange(1, len(p) + 1)
        ok = np.flatnonzero(right >= precision)
        return max(0.5, float(p[order[ok[-1]]])) if len(ok) else 2.0

    def judge(self, texts: list[str], found: list[list]) -> list[list]:
        """Of each text its candidates as (kind, start, end, score, selected): over the threshold, and over no better one selected."""
        x = [features(t, s) for t, own in zip(texts, found) for s in own]
        p, at, out = self.trees.predict(np.array(x)) if x else np.empty(0), 0, []
        for own in found:
            score, at = p[at : at + len(own)], at + len(own)
            taken, verdicts = _Taken(), [False] * len(own)
            for i in np.argsort(-score, kind="stable"):
                k, a, b = own[i]
                if score[i] >= self.threshold[k] and not taken.meets(a, b):
                    verdicts[i] = True
                    taken.add(a, b)
            out.append([(*s, float(v), ok) for s, v, ok in zip(own, score, verdicts)])
        return out

    def choose(self, text: str, base: list, digits: bool = True) -> list:
        """What the trees select beside the base spans."""
        held = _Taken(base)
        return [x[:3] for x in self.judge([text], [candidates(text)])[0] if x[4] and not held.meets(*x[1:3])]


class _Taken:
    """Spans without overlap, in order."""

    def __init__(self, spans: list = ()):
        self.starts, self.ends = [], []
        for a, b in sorted(x[1:3] for x in spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        i = bisect_right(self.ends, a)
        return i < len(self.starts) and self.starts[i] < b

    def add(self, a: int, b: int) -> None:
        i = bisect_right(self.ends, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


@lru_cache(maxsize=1)
def default_selector() -> Selector:
    """Fitted among made words, for use without tables."""
    return Selector()


_CONTEXT = "h long, text string, kind string, start int, end int, label int"


def _contexts(every: int):
    """Candidates in some texts with what stands beside them, and a passage from one text of `every`.

    A candidate of a stated form is right if it passes; one of a looser form, clear of those
    that pass and without a word that tells of it, is taken for wrong; the rest is left out.
    """

    def run(batches):
        for batch, texts in text_chunks(batches, "text"):
            rows = []
            for raw in texts:
                h = xxhash.xxh64_intdigest(raw or b"")
                text = (raw or b"").decode("utf-8", "replace")
                formed = forms(text) if "@" in text or _DIGIT.search(text) else []
                base = _Taken([x for x in formed if x[3]])
                own = [(*x[:3], int(x[3])) for x in formed if x[2] - x[1] <= _LONGEST]
                own += [(*s, 0) for s in candidates(text, []) if not base.meets(*s[1:]) and not any(c in text[max(0, s[1] - 24) : s[1]].lower() for c in _CUES[s[0]])]
                for k, a, b, label in own:
                    left = max(0, a - BESIDE)
                    rows.append((text[left : b + BESIDE], k, a - left, b - left, label))
                if h % every == 0 and text:
                    at = text.find(" ", (h >> 20) % len(text))
                    if at >= 0:
                        rows.append((text[max(0, at - BESIDE) : at + BESIDE], None, min(at, BESIDE), min(at, BESIDE), -1))
            hashes = [xxhash.xxh64_intdigest(f"{r}".encode()) >> 2 for r in rows]
            columns = zip(*rows) if rows else [()] * 5
            names = (("text", pa.string()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("label", pa.int32()))
            yield pa.RecordBatch.from_pydict({"h": pa.array(hashes, pa.int64())} | {n: pa.array(c, t) for (n, t), c in zip(names, columns)})

    return run


def fit(df: DataFrame, text_col: str = "text", contexts: int = CONTEXTS) -> Selector:
    """A selector that has learnt in contexts of df: one scan, whose distinct contexts become a
    table; about `contexts` of each kind and label, by the smallest hashes, come to the driver.

    Null and empty texts have no contexts; copies count once; an empty table leaves made
    words. Only the text column is read.
    """
    docs = df.select(F.col(text_col).cast("string").alias("text"))
    store = Scratch(df.sparkSession, "pii")
    table = store.table(map_texts(docs, _contexts(max(1, docs.count() // contexts)), _CONTEXT).distinct(), "contexts")
    sorts = table.groupBy("kind", "label").count().collect()  # kinds x labels
    least = F.lit(None).cast("long")
    for r in sorts:
        least = F.when(F.col("kind").eqNullSafe(r.kind) & (F.col("label") == r.label), F.lit(int(min(1.0, contexts / r["count"]) * (1 << 62)))).otherwise(least)
    rows = table.where(F.col("h") < least).toArrow().to_pylist()
    got = sorted((tuple(r.values()) for r in rows), key=repr)  # the fit doesn't depend on the order of tasks
    store.release()
    passages = [(t[:a], t[a:]) for _, t, k, a, _, _ in got if k is None]
    return Selector(passages, [(t, (k, a, b), label) for _, t, k, a, b, label in got if k is not None])


def scan_all(texts: list, selector: Selector) -> list[tuple[list, list, list]]:
    """Per text the base spans, all spans, and all candidates with score and verdict; by kind and start."""
    decoded = [(t or b"").decode("utf-8", "replace") for t in texts]
    formed = [forms(t) if "@" in t or _DIGIT.search(t) else [] for t in decoded]
    judged = selector.judge(decoded, [candidates(t, f) for t, f in zip(decoded, formed)])
    order = lambda x: (KINDS.index(x[0]), x[1], x[2])
    out = []
    for own, seen in zip(formed, judged):
        base = [x[:3] for x in own if x[3]]
        held = _Taken(base)
        more = [x[:3] for x in seen if x[4] and not held.meets(*x[1:3])]
        out.append((sorted(base, key=order), sorted(base + more, key=order), sorted(seen, key=order)))
    return out


def pii_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", selector: Selector | None = None) -> DataFrame:
    """(id_col, base, spans, candidates) per document; code points, end exclusive.

    base: (kind, start, end) of the stated forms; spans: also what the trees select clear of
    them; candidates: (kind, start, end, score, selected) of all that the trees scored, base
    forms too. Of overlapping candidates the better is selected, of equal ones the first. A
    null text counts as empty and has no spans; a text of any length is read whole, in
    memory in proportion to it. Null or repeated ids give a row each; empty input gives no
    rows; other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(selector or default_selector())
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    names = ("kind", "start", "end", "score", "selected")
    types = (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
    kinds = [pa.list_(pa.struct(list(zip(names, types))[:n])) for n in (3, 3, 5)]

    def run(batches):
        for batch, texts in text_chunks(batches, "text"):
            found = scan_all(texts, shared.value)
            columns = (pa.array([[dict(zip(names, x)) for x in own[i]] for own in found], kind) for i, kind in enumerate(kinds))
            yield pa.RecordBatch.from_pydict({"id": batch.column(0)} | dict(zip(("base", "spans", "candidates"), columns)))

    span = "kind:string,start:long,end:long"
    return map_texts(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, base array<struct<{span}>>, spans array<struct<{span}>>, candidates array<struct<{span},score:double,selected:boolean>>").withColumnRenamed("id", id_col)
