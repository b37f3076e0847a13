"""Queries over every row of their tables, against brute force."""

import hashlib

import numpy as np

from plumbline.operators import similarity as S, watermark
from plumbline.plans import catalogue


def test_semantic_compare_takes_every_row(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 8)).astype(np.float32)
    x[7] = x[33]  # the best pair of two labels has no id divisible by 20
    label = [i % 3 for i in range(90)]
    label[41] = 9  # a label without an id divisible by 20
    rows = [(i, [float(v) for v in x[i]], label[i]) for i in range(90)]
    df = spark.createDataFrame([*rows, (900, None, 1)], "vec_id LONG, embedding ARRAY<FLOAT>, label INT")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    y = x.astype(np.float64)
    dots, other = y @ y.T, ~np.eye(90, dtype=bool)
    want = {}
    for k in set(label):
        of = np.array(label) == k
        some = dots[of][other[of]]
        want[k] = (some.max(), some.mean())
    got = {r.label: (r.max_cosine, r.mean_cosine) for r in catalogue.QUERIES["semantic_compare"](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=2e-9) for k in want)
    small = S.compare_groups(df.select(df.vec_id.alias("id"), "label", df.embedding.alias("v")), block=16)
    assert all(np.allclose((r.max_cosine, r.mean_cosine), want[r.label], atol=1e-9) for r in small.collect())
    assert S.compare_groups(df.where("false").select(df.vec_id.alias("id"), "label", df.embedding.alias("v"))).count() == 0


def test_document_pairs_cover_every_document(spark, tmp_path):
    text = lambda k: " ".join(f"{'abcdefgh'[k]}{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10]}" for i in range(40)) + "."
    rows = [(1, text(0), "x"), (2, text(1), "x"), (3, text(2), "x"), (4, text(3), "x"), (5, text(2) + " More was said.", "x"), (6, text(1), "x"), (7, text(2), "y"), (8, text(4), "y")]
    spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING").write.parquet(str(tmp_path / "documents.parquet"))
    d = {(r.a, r.b): r for r in catalogue.QUERIES["document_compare"](spark, str(tmp_path)).collect()}
    assert set(d) == {(1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (7, 8), (3, 5), (2, 6)}
    assert {k for k, r in d.items() if r.flagged} == {(3, 5), (2, 6)} and d[2, 6].combined == 1.0 and d[7, 8].source == "y"
    c = {(r.a, r.b): r for r in catalogue.QUERIES["compare_documents"](spark, str(tmp_path)).collect()}
    assert set(c) == set(d) and {k for k, r in c.items() if r.flagged} == {(3, 5), (2, 6)} and c[3, 5].risk == "CRITICAL"


def test_greenlist_compat_covers_documents(spark, tmp_path):
    spark.createDataFrame([(1, "alpha beta alpha beta alpha"), (2, "gamma delta"), (3, "one")], "doc_id LONG, text STRING").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(77, "alpha beta")], "item_id LONG, text STRING").write.parquet(str(tmp_path / "benchmark.parquet"))
    i = {w: int(hashlib.md5(w.encode()).hexdigest(), 16) % 50257 for w in ("alpha", "beta", "gamma", "delta")}
    green = lambda a, b: i[b] in np.flatnonzero(watermark._green_list(i[a], 50257, 0.25))
    got = {r.doc_id: r.green for r in catalogue.QUERIES["greenlist_compat"](spark, str(tmp_path)).collect()}
    assert got == {1: (green("alpha", "beta") + green("beta", "alpha")) / 2, 2: float(green("gamma", "delta"))}
