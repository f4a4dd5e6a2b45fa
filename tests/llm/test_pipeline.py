"""Stages of the pipeline on small tables, against plain restatements."""

import random

import numpy as np

import corpus_pipeline
from gridwave.llm import quality_model
from gridwave.llm.queries import ORACLE_SQL, grade, op2_ngram_jaccard_join, op5_benchmark_decontamination

from .fixtures import corpus, frame, prose
from .test_decontaminate import brute as brute_overlap
from .test_jaccard import brute as brute_components


def test_stages_keep_the_columns(spark, tmp_path):
    r = random.Random(4)
    item = prose(r, 25)
    rows = corpus() + [(700, prose(r, 40) + " " + item), (701, prose(r, 40) + " token: abcdefghijklmnop12 end")]
    docs = frame(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    kept = {x.doc_id for x in stages["near_duplicates"](spark, docs, str(tmp_path)).collect()}
    assert kept == {root for _, _, root in brute_components(rows)}
    clean = {x.doc_id for x in stages["decontamination"](spark, docs, str(tmp_path)).collect()}
    assert clean == {i for i, _, n, *_ in brute_overlap(rows, [(1, item)]) if n == 0}
    red = {x.doc_id: x for x in stages["secret_redaction"](spark, docs, str(tmp_path)).collect()}
    assert red[701].text.endswith("[SECRET] end") and red[701].n_chars == len(red[701].text)
    assert all(red[i].text == t for i, t in rows if i != 701)
    pieces = stages["packing"](spark, docs, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == {i for i, _ in rows}


def test_whole_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 100


def _tables(spark, folder, docs, labels=(), items=()):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def test_run_on_odd_tables(spark, tmp_path):
    """Null ids and texts, repeated rows, clashing columns; every text that stays is in the packed ids, whole."""
    r = random.Random(9)
    item, twin = prose(r, 20), prose(r, 50)
    rows = [(1, prose(r, 60)), (None, prose(r, 70)), (2, None), (None, None), (3, ""), (4, twin), (9, twin), (None, twin + " more"), (5, prose(r, 30) + " " + item), (6, "password: Xk29fjQpw01LmZ77 " + prose(r, 40)), (7, prose(r, 3000)), (7, prose(r, 50)), (8, prose(r, 20)), (8, prose(r, 25))]
    rows += [rows[0]]
    _tables(spark, f"{tmp_path}/a", frame(spark, rows, extra=True), [(None, 1, 0)], [(1, item), (None, item), (2, None)])
    out = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    want = [(i, t if i != 6 else "[SECRET] " + t.split(" ", 2)[2]) for i, t in rows if i not in (5, 9) and t != twin + " more"]
    got = sorted((str(p.doc_id), library_ids_text(p.ids)) for p in out if not any(q.doc_id == p.doc_id and q.piece > 0 for q in out))
    long_ = b"".join(p.ids for p in sorted((p for p in out if p.doc_id == 7 and p.length == 2048), key=lambda p: p.start))
    assert got == sorted((str(i), t or "") for i, t in want if i != 7)
    assert len(long_) == 4 * 2048 * sum(p.doc_id == 7 and p.length == 2048 for p in out) > 0
    room = {}
    for p in out:
        room[p.sequence_id] = room.get(p.sequence_id, 0) + p.length
    assert max(room.values()) <= 2048


def library_ids_text(ids):
    from .test_packing import _library

    own = np.frombuffer(ids, "<u4").tolist()
    assert own[-1] == 0
    return _library.decode(own[:-1], skip_special_tokens=False)


def test_run_on_empty_tables(spark, tmp_path):
    _tables(spark, f"{tmp_path}/a", frame(spark, []))
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() == 0
    _tables(spark, f"{tmp_path}/b", frame(spark, [(1, None), (None, "a b")]))
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 2


def test_quality_stage_equals_the_model_by_hand(spark):
    """Each document stays as its own expected tail says, whatever shares its batch."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_model.fit(docs, labels, grade())
    kept = {x.doc_id for x in corpus_pipeline.quality(spark, docs, sf).collect()}
    for x in docs.collect():
        score = sum(float((model.weights[i] * v).sum()) for i, v in quality_model.Features([(x.text or "").encode()]).rows())
        p = 1 / (1 + np.exp(model.thresholds[0] - score))
        assert (x.doc_id in kept) == (p >= 0.5) or abs(p - 0.5) < 1e-4


def test_queries_equal_their_sql(spark):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    for query in (op2_ngram_jaccard_join, op5_benchmark_decontamination):
        got = query(spark, "/root/testdata/sf0.001")
        want = db.execute(ORACLE_SQL[query.__name__])
        names = [c[0] for c in want.description]
        assert set(names) == set(got.columns)
        assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
