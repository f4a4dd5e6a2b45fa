"""Toxicity by weak supervision.

Many voters look at each text: one per word of a stated lexicon, patterns, and word stems
that labelled rows single out. A generative label model takes their means and covariances
over all documents: for voters that are independent given the label, cov(i, j) =
pi (1 - pi) d_i d_j with d_i the difference of a voter's rates in the two classes, so
triplets of covariances give d_i. Its rate in clean texts is no lower than in labelled
clean rows. A voter without such triplets (one language may have a
single stem) keeps its rates in the labelled rows. What a pair covaries beyond the
product is its correlation, and correlated voters share one say. The model's posteriors
label a bounded sample, in which texts with a vote have a greater share and a smaller
weight; a linear classifier over hashed words and stems, and those that a text repeats,
learns them, from words that chance can't explain, and scores every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import map_texts, text_chunks, utf8
from .linear import CumulativeLink, Rows
from .sampling import by_hash, share_of
from .store import Scratch
from .words import ALNUM, FOLD, Words, mix

# fixed values: insults, one voter each
LEXICON = (
    "idiot", "moron", "stupid", "loser", "pathetic", "scum", "worthless", "trash", "clown", "disgusting",
    "dumb", "imbecile", "jerk", "bastard", "bitch", "asshole", "fool", "garbage", "ugly", "vermin",
    "hate", "filthy", "freak", "retard", "coward", "liar", "parasite", "subhuman", "shut", "kill",
    "dummkopf", "arschloch", "abschaum", "idiota", "imbécil", "basura", "estúpido", "connard", "ordure", "débile",
)
PATTERNS = {
    "second_person": rb"\b(?:you|u|your|you're)\s+(?:\w+\s+){0,3}(?:idiot|moron|loser|scum|clown|trash|fool|jerk|stupid|dumb|pathetic|worthless|disgusting)\b",
    "article": rb"\b(?:an?|the|such|what|total|complete|absolute)\s+(?:idiot|moron|loser|clown|jerk|fool|imbecile)\b",
    "shut_up": rb"\bshut\s+up\b",
    "intensified": rb"\b(?:so|very|totally|absolutely)\s+(?:stupid|pathetic|disgusting|worthless|dumb|ugly)\b",
    "censored": rb"\b[a-z][*#@$]{2,}[a-z]*\b",
    "marks": rb"[!?]{4,}",
}
BITS = 20
SIZE = 1 << BITS


#: Bytes of the stems that stand beside each whole word.
STEMS = (4, 5, 6, 7)
#: Labelled documents of each class that stems are mined from, the share of toxic texts among
#: those that a stem marks, and how many voters every labelled toxic text should have.
MINED_ROWS, LEAST_SHARE, COVER = 4000, 0.7, 3
#: Tasks that add up what all tasks have counted; the driver reads one matrix from each.
_SUMS = 32


def _slot(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - BITS)).astype(np.int64)


def _again(slot: np.ndarray) -> np.ndarray:
    """The slot of a word or stem that a text holds twice or more."""
    return (slot.astype(np.int64) * 2654435761 + 12345) & (SIZE - 1)


def _wanted(slots: np.ndarray) -> np.ndarray:
    keep = np.zeros(SIZE, bool)
    keep[slots] = True
    return keep


_LEXICON_HASH = Words([w.encode() for w in LEXICON], ALNUM, FOLD).hash
_PATTERNS = [re.compile(p) for p in PATTERNS.values()]
#: Patterns over words need a lexicon word; the last two need runs of such marks.
_MARKED = len(PATTERNS) - 2
_CENSOR, _MARKS = np.isin(np.arange(256), list(b"*#@$")), np.isin(np.arange(256), list(b"!?"))
FIXED_VOTERS = (*LEXICON, *PATTERNS)


class Features:
    """Hashed slots of the words and stems of some texts, by place; and the fixed voters."""

    def __init__(self, texts: list[bytes]):
        self.texts, self.n = texts, len(texts)
        w = Words(texts, ALNUM, FOLD)
        self.words, self.owner = w.hash, w.text_of_word()
        owners, slots = [self.owner], [_slot(w.hash)]
        folded = FOLD[w.buf]
        rows = np.flatnonzero(w.end - w.start > STEMS[0])  # words longer than the stem so far
        at, size, h = w.start[rows], (w.end - w.start)[rows], np.full(len(rows), 0x5DEECE66D, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(STEMS[-1]):
                h = (h ^ folded[at + j]) * np.uint64(0x100000001B3)
                h ^= h >> np.uint64(32)
                if j + 1 in STEMS:
                    owners.append(self.owner[rows])
                    slots.append(_slot(mix(h)))
                    longer = size > j + 2
                    rows, at, size, h = rows[longer], at[longer], size[longer], h[longer]
        self.doc, self.slot = np.concatenate(owners), np.concatenate(slots)
        self.censored, self.marked = self._runs(w, _CENSOR, 2), self._runs(w, _MARKS, 4)

    @staticmethod
    def _runs(w: Words, table: np.ndarray, size: int) -> np.ndarray:
        """The texts with so many bytes of a table in a row."""
        m = table[w.buf]
        n = max(len(m) - size + 1, 0)
        run = m[:n].copy()
        for k in range(1, size):
            run &= m[k : k + n]
        return np.unique(np.searchsorted(w.offset, np.flatnonzero(run), side="right") - 1)

    def votes(self, mined: np.ndarray) -> np.ndarray:
        """One row per text, one boolean per voter: the fixed ones, then the mined slots."""
        out = np.zeros((self.n, len(FIXED_VOTERS) + len(mined)), bool)
        order = np.argsort(_LEXICON_HASH)
        at = np.minimum(np.searchsorted(_LEXICON_HASH[order], self.words), len(order) - 1)
        hit = np.flatnonzero(_LEXICON_HASH[order][at] == self.words)
        out[self.owner[hit], order[at[hit]]] = True
        for i in np.flatnonzero(out.any(axis=1)):
            t = self.texts[i].lower()
            for k, p in enumerate(_PATTERNS[:_MARKED]):
                out[i, len(LEXICON) + k] = p.search(t) is not None
        for k, texts in enumerate((self.censored, self.marked), _MARKED):
            for i in texts:
                out[i, len(LEXICON) + k] = _PATTERNS[k].search(self.texts[i].lower()) is not None
        if len(mined):
            doc, slot = self.distinct(_wanted(mined))
            order = np.argsort(mined)
            out[doc, len(FIXED_VOTERS) + order[np.searchsorted(mined[order], slot)]] = True
        return out

    def distinct(self, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Text and slot, each pair once, with the slots of what is repeated; keep: which slots to look at."""
        doc, slot = self.doc, self.slot
        if keep is not None:
            may = (keep | keep[_again(np.arange(SIZE))])[slot]
            doc, slot = doc[may], slot[may]
        key, many = np.unique(doc * SIZE + slot, return_counts=True)
        twice = key[many > 1]
        key = np.unique(np.concatenate((key, twice // SIZE * SIZE + _again(twice % SIZE))))
        doc, slot = key // SIZE, key % SIZE
        return (doc, slot) if keep is None else (doc[keep[slot]], slot[keep[slot]])

    def by_text(self) -> list[np.ndarray]:
        doc, slot = self.distinct()
        return np.split(slot, np.searchsorted(doc, np.arange(1, self.n)))


def _telling(toxic: np.ndarray, seen: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Slots that so many toxic ones among those seen could have by chance with a probability
    under 1 % over all slots (a Chernoff bound on the rate), and the evidence of every slot."""
    share = np.clip(toxic / np.maximum(seen, 1), 1e-9, 1 - 1e-9)
    rate = float(np.clip(rate, 1e-9, 1 - 1e-9))
    evidence = seen * (share * np.log(share / rate) + (1 - share) * np.log((1 - share) / (1 - rate)))
    return np.flatnonzero(evidence > np.log(100 * max(1, int((seen > 0).sum())))), evidence


def mine(slots: list[np.ndarray], toxic: np.ndarray, weight: tuple[float, float] = (1.0, 1.0)) -> np.ndarray:
    """Slots that labelled toxic texts hold and clean ones hardly do.

    A slot in t toxic and c clean texts counts if chance would give as many with a
    probability under 1 % over all slots seen (a Chernoff bound) and LEAST_SHARE of the
    texts that it marks are toxic, by the weight of a clean and a toxic row. They are taken
    from the one with most evidence on, as long as two toxic texts gain a voter that had
    fewer than COVER; so there are at most COVER / 2 for each toxic row, in any language.
    """
    n_toxic = int(toxic.sum())
    if not n_toxic or n_toxic == len(toxic):
        return np.empty(0, np.int64)
    t, c = (np.bincount(np.concatenate([s for s, y in zip(slots, toxic) if y == k]), minlength=SIZE) for k in (1, 0))
    good, evidence = _telling(t, t + c, n_toxic / len(toxic))
    good = good[t[good] * weight[1] >= LEAST_SHARE * (t[good] * weight[1] + c[good] * weight[0])]
    good = good[t[good] > 0]
    good = good[np.argsort(-evidence[good], kind="stable")]
    place = np.full(SIZE, -1)
    place[good] = np.arange(len(good))
    marks: list[list[int]] = [[] for _ in good]
    for i, s in enumerate(s for s, y in zip(slots, toxic) if y):
        for k in place[s][place[s] >= 0]:
            marks[k].append(i)
    cover, taken = np.zeros(n_toxic, int), []
    for k, own in enumerate(marks):
        if (cover[own] < COVER).sum() >= max(2, 0.2 * len(own)):
            cover[own] += 1
            taken.append(k)
    return good[taken]


@dataclass
class LabelModel:
    """Rates of each voter in both classes, and its say among correlated voters."""

    prior: float
    toxic: np.ndarray
    clean: np.ndarray
    say: np.ndarray
    correlation: np.ndarray
    silence: tuple[float, float] = (0.1, 0.9)  # rates of texts without any vote

    @classmethod
    def fit(cls, n: int, ones: np.ndarray, both: np.ndarray, prior: float, known: np.ndarray) -> LabelModel:
        """n texts, votes per voter, votes of each pair together; known: rates of voters in labelled rows, toxic and clean."""
        v = len(ones)
        m = ones / max(n, 1)
        cov = both / max(n, 1) - np.outer(m, m)
        np.fill_diagonal(cov, 0)
        sd = np.sqrt(np.maximum(m * (1 - m), 1e-12))
        used = np.flatnonzero(ones > 0)
        # pairs that covary far more than voters do in the middle are left out of the triplets
        near = cov / np.outer(sd, sd)
        typical = np.median(near[np.ix_(used, used)][~np.eye(len(used), dtype=bool)]) if len(used) > 2 else 0.0
        apart = near < max(0.5, 3 * typical)
        spread = max(prior * (1 - prior), 1e-6)
        d = np.zeros(v)
        upper = np.triu(np.ones((len(used), len(used)), bool), 1) & apart[np.ix_(used, used)] & (cov[np.ix_(used, used)] > 1e-9)
        for a, i in enumerate(used):
            beside = apart[i, used] & (cov[i, used] > 0)
            beside[a] = False
            j, k = np.nonzero(upper & beside[:, None] & beside[None, :])
            if len(j):
                d[i] = np.sqrt(np.median(cov[i, used[j]] * cov[i, used[k]] / cov[used[j], used[k]]) / spread)
        clean = np.clip(m - prior * d, 1e-4, 1 - 1e-4)
        toxic = np.clip(m + (1 - prior) * d, 1e-4, 1 - 1e-4)
        clean = np.maximum(clean, np.minimum(known[1], 0.5))  # triplets of stems of one word see too few of its clean uses
        alone = d <= 0
        toxic[alone], clean[alone] = np.clip(known[0][alone], 1e-4, 1 - 1e-4), np.clip(known[1][alone], 1e-4, 1 - 1e-4)
        silent = (ones == 0) | (toxic <= clean)  # of which nothing is known
        toxic[silent] = clean[silent] = 0.5
        d = np.where(silent, 0, toxic - clean)
        rest = np.clip((cov - spread * np.outer(d, d)) / np.outer(sd, sd), 0, 1)
        np.fill_diagonal(rest, 0)
        rest[silent] = rest[:, silent] = 0
        return cls(prior, toxic, clean, 1 / (1 + np.where(rest > 0.1, rest, 0).sum(axis=1)), rest)

    def posterior(self, z: np.ndarray) -> np.ndarray:
        """Of being toxic. A voter that says nothing abstains: it may be of another language."""
        yes = np.log(self.toxic / self.clean) * self.say
        score = np.log(self.prior / (1 - self.prior)) + np.where(z, yes, 0).sum(axis=1)
        score += np.where(z.any(axis=1), 0, np.log(self.silence[0] / self.silence[1]))
        return 1 / (1 + np.exp(-np.clip(score, -40, 40)))


_ROWS = "n long, both binary, h long, slots binary, votes binary, part double"


def _moments(store: Scratch, docs: DataFrame, mined: np.ndarray, plain: float, voted: float) -> tuple[int, np.ndarray, np.ndarray, list[dict]]:
    """Counts over all texts: voters x voters numbers, whatever the corpus; and a sample from the
    same scan: a share `plain` of the texts, and a share `voted` of those with a vote."""
    v = len(FIXED_VOTERS) + len(mined)

    def row(n, both):
        none = {x: pa.nulls(1, t) for x, t in (("h", pa.int64()), ("slots", pa.binary()), ("votes", pa.binary()), ("part", pa.float64()))}
        return pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "both": pa.array([both.astype("<i8").tobytes()], pa.binary())} | none)

    def count(batches):
        n, both = 0, np.zeros((v, v))
        for batch, texts in text_chunks(batches, "text"):
            f = Features(utf8(texts))
            z = f.votes(mined)
            n, both = n + len(z), both + z.T.astype(np.float32) @ z.astype(np.float32)
            h = batch.column(1).to_numpy().view(np.uint64)
            part = np.where(z.any(axis=1), max(plain, voted), plain)
            at = np.flatnonzero(h < part * 2.0**64)
            if len(at):
                slots, k = f.by_text(), len(at)
                yield pa.RecordBatch.from_pydict({
                    "n": pa.nulls(k, pa.int64()), "both": pa.nulls(k, pa.binary()), "h": batch.column(1).take(pa.array(at)), "slots": pa.array([slots[i].astype("<i4").tobytes() for i in at], pa.binary()),
                    "votes": pa.array([np.packbits(z[i]).tobytes() for i in at], pa.binary()), "part": pa.array(part[at]),
                })
        yield row(n, both)

    def add(batches):
        n, both = 0, np.zeros((v, v))
        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n, both = n + k, both + np.frombuffer(x, "<i8").reshape(v, v)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "both": pa.array([both.astype("<i8").tobytes()], pa.binary())})

    found = store.table(map_texts(docs.select("text", F.xxhash64("id", "text").alias("h")), count, _ROWS), "counts")
    n, both = 0, np.zeros((v, v))
    for r in found.where("n IS NOT NULL").select("n", "both").repartition(_SUMS).mapInArrow(add, "n long, both binary").toLocalIterator():
        n, both = n + r.n, both + np.frombuffer(r.both, "<i8").reshape(v, v)
    rows = found.where("h IS NOT NULL").groupBy("h").agg(F.min(F.struct("slots", "votes", "part")).alias("row"), F.count(F.lit(1)).alias("copies")).select("copies", "row.*")
    return n, np.diag(both).copy(), both, sorted(rows.toArrow().to_pylist(), key=lambda r: (r["slots"], r["votes"]))


@dataclass
class ToxicityModel:
    labels: LabelModel
    linear: CumulativeLink

    def scores(self, texts: list[bytes]) -> np.ndarray:
        f = Features(texts)
        doc, slot = f.distinct(self.linear.weights != 0)
        return self.linear.tails(np.bincount(doc, weights=self.linear.weights[slot], minlength=f.n))[:, 0]


def _labelled(docs: DataFrame, known: DataFrame) -> list[dict]:
    """Slots and fixed votes of the documents that known (id, toxic) names, one an id, in an order that tasks don't decide."""

    def run(batches):
        for batch, texts in text_chunks(batches, "text"):
            f = Features(utf8(texts))
            z = f.votes(np.empty(0, np.int64))
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "slots": pa.array([s.astype("<i4").tobytes() for s in f.by_text()], pa.binary()), "votes": pa.array([np.packbits(x).tobytes() for x in z], pa.binary()), "toxic": batch.column(2)})

    found = map_texts(docs.join(F.broadcast(known), "id").select("id", "text", "toxic"), run, f"id {docs.schema['id'].dataType.simpleString()}, slots binary, votes binary, toxic int")
    rows = found.groupBy("id").agg(F.min(F.struct("slots", "votes", "toxic")).alias("row")).select("row.*")
    return sorted(rows.toArrow().to_pylist(), key=lambda r: (r["slots"], r["votes"], r["toxic"]))


def _unpacked(rows: list[dict]) -> tuple[list[np.ndarray], np.ndarray, int]:
    slots = [np.frombuffer(r["slots"], "<i4") for r in rows]
    bits = np.array([np.unpackbits(np.frombuffer(r["votes"], np.uint8)) for r in rows], bool)
    return slots, bits, len(rows)


def fit(df: DataFrame, labels: DataFrame, toxic: Column, id_col: str = "doc_id", text_col: str = "text", sample: int = 12000) -> ToxicityModel:
    """The model. Labels give the rate of toxic documents and the mined stems, from about
    MINED_ROWS rows of each class (the smallest id hashes); the label model gives the rest. It
    labels about `sample` documents, labelled or not, for the classifier: two thirds of them
    from all, one third from those with a vote, by the smallest hashes of id and text.

    Null and empty texts have no votes; of labels of one id the highest counts, of documents
    of one id one for mining; rows alike are one of so much weight in the sample. Without
    labels the rate is a tenth; without documents every text has the base score.
    """
    store = Scratch(df.sparkSession, "toxicity")
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(id_col).alias("id"), toxic.cast("int").alias("toxic")).where("id IS NOT NULL AND toxic IN (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    many = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    prior = float(np.clip(many.get(1, 0) / sum(many.values()), 0.005, 0.5)) if many else 0.1
    shares = [share_of(MINED_ROWS, many.get(k, 0)) for k in (0, 1)]
    rows = _labelled(docs, known.where(by_hash(F.when(F.col("toxic") == 1, shares[1]).otherwise(shares[0]), "id"))) if many else []
    mined, rates = np.empty(0, np.int64), np.zeros((2, len(FIXED_VOTERS)))
    any_vote = prior
    if rows:
        slots, bits, _ = _unpacked(rows)
        y = np.array([r["toxic"] for r in rows])
        mined = mine(slots, y, (1 / shares[0], 1 / shares[1]))
        z = np.hstack((bits[:, : len(FIXED_VOTERS)], np.array([np.isin(mined, s) for s in slots]).reshape(len(slots), -1)))
        rates = np.stack([(z[y == k].sum(axis=0) + 0.1) / ((y == k).sum() + 1) for k in (1, 0)])
        any_vote = sum(p * z[y == k].any(axis=1).mean() for k, p in ((1, prior), (0, 1 - prior)) if (y == k).any())
    n = docs.count()
    model_of = _moments(store, docs, mined, share_of(sample * 2 // 3, n), share_of(sample // 3, int(n * any_vote)))
    model = LabelModel.fit(*model_of[:3], prior, rates)
    store.release()
    if rows:
        none = ~z[:, model.toxic > model.clean].any(axis=1)
        model.silence = tuple(float((none[y == k].sum() + 0.5) / ((y == k).sum() + 1)) for k in (1, 0))
    rows = model_of[3]
    if not rows:
        return ToxicityModel(model, CumulativeLink(np.zeros(SIZE), np.zeros(1) + np.log((1 - prior) / prior)))
    slots, bits, _ = _unpacked(rows)
    p = model.posterior(bits[:, : len(model.toxic)])
    weight = np.array([r["copies"] / r["part"] for r in rows])
    features = Rows.of([(s, np.ones(len(s), np.float32)) for s in slots])
    del rows, slots, bits, model_of
    # words that chance explains get no weight
    marked = np.bincount(features.index, weights=np.repeat(p, np.diff(features.begin)), minlength=SIZE)
    telling, _ = _telling(marked, np.bincount(features.index, minlength=SIZE), p.mean())
    features = features.only(_wanted(telling))
    linear = CumulativeLink.fit(
        features, np.stack((1 - p, p), axis=1), SIZE,
        epochs=16, batch=128, rate=0.5, l1=1e-4, damping=1e-4, weight=weight / weight.mean(),
    )
    return ToxicityModel(model, linear)


def toxicity_scores(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) per document, 0 to 1.

    A null or empty text has no words and gets the base score; a text of any length is read
    whole, in memory in proportion to it. Null or repeated ids give a row each; empty input
    gives no rows; other columns are ignored.
    """
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, texts in text_chunks(batches, "text"):
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "score": pa.array(shared.value.scores(utf8(texts)))})

    return map_texts(docs, run, f"id {docs.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)
