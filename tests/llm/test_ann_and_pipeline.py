"""Nearest neighbours by recall, and the pipeline by its stages' effects."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from helixloom.llm import ann, queries
from test_text_ops import brute_components

DATA = "/root/testdata/sf0.001"


def test_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 24))
    x = (centres[rng.integers(0, 30, 3000)] + 0.4 * rng.normal(size=(3000, 24))).astype(np.float32)
    x[100:140] = x[100]  # repeated vectors: ties go to the smaller id
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 24), (5040, [float("nan")] * 24), (5060, [1.0]), (None, x[0].tolist()), (7, x[7].tolist())]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(0))
    out = ann.nearest_neighbours(d, F.col("vec_id") % 20 == 0, 10, fit_rows=600).collect()
    got = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 20)) and all(len(v) == 10 for v in got.values())
    y, hit = x.astype(np.float64), 0
    for q, mine in got.items():
        s = y @ y[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(3000), -s))[:10]
        hit += len(set(want.tolist()) & {v for v, _ in mine})
        assert all(abs(s[v] - z) < 1e-9 for v, z in mine) and mine == sorted(mine, key=lambda m: (-m[1], m[0]))
    assert hit >= 0.9 * 10 * len(got)


def recall(spark, x, k=10, kind="float"):
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    d = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").repartition(4)
    got = {}
    for r in ann.nearest_neighbours(d, F.col("vec_id") % 20 == 0, k, fit_rows=1500).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(range(0, len(x), 20)) and all(len(v) == k for v in got.values())
    hit, y = 0, x.astype(np.float64)
    for q, mine in got.items():
        s = y @ y[q]
        s[q] = -np.inf
        hit += len(set(np.lexsort((np.arange(len(x)), -s))[:k].tolist()) & set(mine))
    return hit / k / len(got)


def test_recall_with_lengths_far_apart(spark, monkeypatch):
    """One vector many times longer than the rest, lengths with a heavy tail, and finite vectors whose squares are not."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 24))
    tail = x * np.exp(rng.normal(size=3000))[:, None]
    longer, huge = x.copy(), x.copy()
    longer[17] *= 1e6
    huge[17] *= 1e160
    assert recall(spark, longer) >= 0.95
    assert recall(spark, tail) >= 0.95
    assert recall(spark, huge, kind="double") >= 0.95
    assert recall(spark, x * 2.0**300, kind="double") >= 0.95
    monkeypatch.setattr(ann, "COARSE", 12)  # lists of two levels, and parts of few rows
    monkeypatch.setattr(ann, "PART_ROWS", 200)
    monkeypatch.setattr(ann, "CELL_ROWS", 40)
    assert recall(spark, tail) >= 0.95


def test_few_vectors(spark):
    d = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r.score) for r in ann.nearest_neighbours(d, F.col("vec_id") == 0, 20).orderBy("rank").collect()] == [(1, 0.5), (2, -1.0)]
    assert ann.nearest_neighbours(d.where("vec_id > 5"), F.lit(True), 20).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:3]):
        before = docs
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns
        counts.append(docs.count())
        if k == 2:
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert sorted(r.doc_id for r in docs.collect()) == sorted(d for d, _, c in brute_components(rows, 5, 80, 100) if d == c)
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    mixed = corpus_pipeline.mix(spark, docs, DATA)
    assert mixed.columns == columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
    assert corpus_pipeline.encode(spark, mixed, DATA).count() == mixed.count()


def test_pipeline_stages_take_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("abcdef") for _ in range(30)), "en", None, 30) for i in range(8)]
    rows += [(None, "x y z", None, None, None), (9, None, "en", "s", None), (9, None, "en", "s", None), (10, "", "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows_ in (rows, []):
        docs = spark.createDataFrame(rows_, schema)
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, DATA)
            n = out.count()
            assert n or not rows_
            docs = out if out.columns == docs.columns else docs


def test_registered():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names[:10]] == [f"op{i}" for i in range(1, 11)] and names[-1] == "pipeline"


def test_run_equals_a_plain_recomputation(spark):
    """run() from end to end against plain Python: scores by hand-held compressors, lines and near duplicates by brute force, the mix by its own copies, ids by the library."""
    from collections import Counter

    from helixloom.llm import bpe, cube, toxicity
    from helixloom.llm.tokenizer_files import tokenizer_spec
    from test_text_ops import brute_lines

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    model = toxicity.fit_model(docs, spark.read.parquet(f"{DATA}/labels.parquet"))

    def toxic(t):
        if model is None:
            return False
        x = toxicity.features(t or "", model, toxicity.compressors(model))
        return np.dot(x, model.weights[:-1]) + model.weights[-1] >= 0

    kept = [r for r in rows if not toxic(r["text"])]
    clean = brute_lines([(r["doc_id"], r["text"]) for r in kept])
    lines = []
    for r in kept:
        t = clean[r["doc_id"], r["text"]]
        if not (t == "" and r["text"]):
            lines.append({**r, "text": t, "n_chars": None if t is None else len(t)})
    heads = {d for d, _, c in brute_components([(r["doc_id"], r["text"]) for r in lines], 5, 80, 100) if d == c}
    single = spark.createDataFrame([r for r in lines if r["doc_id"] in heads], docs.schema)
    copies = {r.doc_id: r.copies for r in cube.mix_sources(single).collect()}
    tok = bpe.Tokenizer.from_str(tokenizer_spec())
    want = Counter()
    for r in lines:
        if r["doc_id"] in heads and copies[r["doc_id"]]:
            want[r["doc_id"], tuple(tok.encode(r["text"] or "", add_special_tokens=False).ids)] += copies[r["doc_id"]]
    got = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == want and sum(want.values()) > 50


def test_stages_take_clashing_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    for c in ("own_id", "often", "time", "no", "head", "_copies", "_id", "_k", "_n", "gone", "score"):
        docs = docs.withColumn(c, F.lit(c))
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and {r._id for r in out.select("_id").distinct().collect()} == {"_id"}, name


def test_near_duplicates_by_row(spark):
    """A near copy goes whatever rows share its doc_id, and 5000 repeats of two near texts are one pair."""
    a = " ".join(f"w{i}" for i in range(60))
    b = " ".join(f"v{i}" for i in range(60))
    schema = "doc_id long, text string, own_id string"
    kept = lambda rows: sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, schema), "").collect()), key=str)
    assert kept([(1, a, "x"), (None, a + " more", "x")]) == [(1, a)]
    assert kept([(1, a, "x"), (None, a + " more", "x"), (None, "", "x"), (None, "", "x"), (None, None, "x")]) == sorted([(1, a), (None, ""), (None, ""), (None, None)], key=str)
    assert kept([(1, a, "x"), (5, a + " more", "x"), (5, b, "x")]) == [(1, a), (5, b)]
    assert kept([(None, a, "x"), (None, a, "x"), (None, b, "x")]) == sorted([(None, a), (None, b)], key=str)
    assert kept([(7, a, "x")] * 5000 + [(8, a + " more", "x")] * 5000) == [(7, a)]
