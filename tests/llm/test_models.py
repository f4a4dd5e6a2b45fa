import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from gridwave.llm import quality_model, toxicity
from gridwave.llm.linear import CumulativeLink, Rows
from gridwave.llm.queries import grade, op4_quality_classifier, op10_toxicity
from gridwave.llm.sampling import by_hash, share_of

from .fixtures import corpus, frame

SF = "/root/testdata/sf0.01"


def test_ordinal_fit_orders_grades():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 4))
    latent = x @ np.array([2.0, -1.0, 0.5, 0.0]) + r.logistic(size=3000)
    y = (latent > -1).astype(int) + (latent > 1.5)
    rows = Rows.of([(np.arange(4), v.astype(np.float32)) for v in x])
    m = CumulativeLink.fit(rows, np.eye(3)[y], 4, epochs=40, rate=0.3, l1=0)
    assert np.allclose(m.weights, [2, -1, 0.5, 0], atol=0.25) and np.allclose(m.thresholds, [-1, 1.5], atol=0.25)
    tails = m.tails(x @ m.weights)
    assert (tails[:, 0] >= tails[:, 1]).all()


def test_quality_on_unseen_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 0
    model = quality_model.fit(docs, labels.where(~held), grade())
    rows = quality_model.quality_scores(docs, model).join(labels.where(held), "doc_id").collect()
    assert np.mean([r.selected == (r.quality == 1) for r in rows]) >= 0.95


def test_quality_cases(spark):
    rows = corpus()
    labels = spark.createDataFrame([(i, i % 2, None if i % 5 == 0 else 0) for i in range(50)] + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    df = frame(spark, rows, extra=True)
    model = quality_model.fit(df, labels, grade())
    assert quality_model.quality_scores(df, model).count() == len(rows)
    kept = quality_model.select_quality(df, model)
    assert kept.schema == df.schema
    want = {r.doc_id for r in quality_model.quality_scores(df, model).collect() if r.selected}
    assert {r.doc_id for r in kept.collect()} == want
    none = quality_model.fit(df, labels.limit(0), grade())
    assert quality_model.quality_scores(df, none).count() == len(rows)
    assert quality_model.quality_scores(frame(spark, []), none).count() == 0


def test_label_model_finds_the_rates():
    r = np.random.default_rng(5)
    y = r.random(200_000) < 0.2
    rates = np.array([[0.5, 0.05], [0.3, 0.01], [0.6, 0.2], [0.4, 0.02]])
    z = np.where(y[:, None], r.random((len(y), 4)) < rates[:, 0], r.random((len(y), 4)) < rates[:, 1])
    z = np.hstack((z, z[:, :1]))  # a voter that repeats the first
    both = z.astype(float).T @ z
    m = toxicity.LabelModel.fit(len(y), np.diag(both).copy(), both, 0.2, np.zeros((2, 5)))
    assert np.abs(m.toxic[1:4] - rates[1:, 0]).max() < 0.05 and np.abs(m.clean[1:4] - rates[1:, 1]).max() < 0.05
    assert m.correlation[0, 4] > 0.3 and m.say[0] < 0.8 and m.say[3] > 0.9


def test_toxicity_on_the_held_out_fold(spark):
    out = op10_toxicity(spark, SF)
    rows = out.join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.predicted == r.toxic for r in held]) >= 0.93
    assert all(0 <= r.score <= 1 for r in rows) and not any(r.predicted for r in held if not r.toxic)


def test_toxic_recall_by_language(spark):
    """Where labels have some dozens of toxic rows a language, held-out ones are found in each."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = op10_toxicity(spark, sf).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    for lang in ("en", "de", "fr", "es"):
        toxic = [r.predicted for r in rows if r.lang == lang and r.toxic]
        clean = [r.predicted for r in rows if r.lang == lang and not r.toxic]
        assert sum(toxic) >= 0.75 * len(toxic) and sum(clean) <= 0.02 * len(clean), lang
    toxic = [r.predicted for r in rows if r.toxic]
    assert sum(toxic) >= 0.85 * len(toxic)


def test_scores_equal_a_plain_restatement():
    """Words and stems in hashed slots, the slots of repeated ones, a weight each."""
    r = random.Random(14)
    words = ["achlich", "Achlichver", "the", "idiot", "réeuxou", "x", "12", "conversation", "conversations"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 12))).encode() for _ in range(60)]
    weights = np.random.default_rng(3).normal(size=toxicity.SIZE) * (np.random.default_rng(4).random(toxicity.SIZE) < 0.5)

    def slots(text):
        seen = []
        for w in text.split():
            low = bytes(b + 32 if 65 <= b <= 90 else b for b in w)
            seen.append(toxicity.Features([low]).slot[0])
            h = 0x5DEECE66D
            for j, b in enumerate(low[:7], 1):
                h = ((h ^ b) * 0x100000001B3) & (2**64 - 1)
                h ^= h >> 32
                if j in toxicity.STEMS and len(low) > j:
                    seen.append(toxicity._slot(toxicity.mix(np.array([h], np.uint64)))[0])
        once = set(map(int, seen))
        return once | {int(toxicity._again(np.array([x]))[0]) for x in once if sum(int(y) == x for y in seen) > 1}

    model = toxicity.ToxicityModel(None, CumulativeLink(weights, np.array([0.3])))
    for t, p in zip(texts, model.scores(texts)):
        assert np.isclose(p, 1 / (1 + np.exp(0.3 - sum(weights[k] for k in slots(t)))))


def test_quality_features_equal_a_plain_restatement():
    """Mean weights of hashed words, of shapes of three bytes and of repeated words, text by text."""
    texts = [b"", b"a", b"ab", b"abc", b"The the THE cat", b"x\n", "é ü 12.5 %".encode(), b"one two one two"]
    rows = list(quality_model.Features(texts).rows())
    for t, (index, value) in zip(texts, rows):
        words = t.split()
        n = len(words)
        shapes = max(len(t) - 2, 0)
        assert np.isclose(value[index < 1 << 17].sum(), 3.0 if n else 0) and np.isclose(value[(index >= 1 << 17) & (index < quality_model._REPEATS)].sum(), 4.0 if shapes else 0)
        low = [w.lower() for w in words]
        for k, back in enumerate((1, 2)):
            same = sum(a == b for a, b in zip(low, low[back:]))
            assert np.isclose(value[index == quality_model._REPEATS + k].sum(), 2.0 * same / max(n, 1))
        own = list(quality_model.Features([t]).rows())[0]
        assert index.tolist() == own[0].tolist() and np.allclose(value, own[1])


def test_samples_stay_bounded(spark):
    """A threshold on hashes gives about the rows asked for, and ids that repeat come once."""
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('word', id % 7, ' and more') AS text")
    docs = docs.union(spark.range(5000).selectExpr("7 AS doc_id", "concat('copy ', id) AS text"))
    labels = spark.range(20_000).selectExpr("id AS doc_id", "int(id % 2) AS quality", "0 AS toxic")
    picked = labels.where(by_hash(share_of(1000, 20_000), "doc_id")).count()
    assert 1000 <= picked <= 1300
    assert np.isfinite(quality_model.fit(docs, labels, grade(), sample=500).thresholds).all()


def test_toxicity_cases(spark):
    r = random.Random(2)
    rows = corpus() + [(1000 + i, "you are such a pathetic idiot and a " + r.choice(("clown", "loser", "moron"))) for i in range(40)]
    labels = spark.createDataFrame([(i, 0) for i in range(40)] + [(1000 + i, 1) for i in range(20)] + [(None, 1), (2, None)], "doc_id long, toxic int")
    df = frame(spark, rows, extra=True)
    model = toxicity.fit(df, labels, F.col("toxic"))
    scores = {x.doc_id: x.score for x in toxicity.toxicity_scores(df, model).collect()}
    assert all(scores[1000 + i] > 0.5 for i in range(40)) and scores[0] < 0.5 and scores[[i for i, t in rows if t is None][0]] < 0.5
    empty = toxicity.fit(frame(spark, []), labels.limit(0), F.col("toxic"))
    assert toxicity.toxicity_scores(df, empty).count() == len(rows) and toxicity.toxicity_scores(frame(spark, []), model).count() == 0


def test_op4_covers_all(spark):
    assert op4_quality_classifier(spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
