"""Steps that were made cheaper give what the plain ones gave."""

import numpy as np
from pyspark.sql import functions as F

from plumbline.functions import shingles as K, text as T
from plumbline.operators import similarity as S
from plumbline.plans import catalogue


def test_phrases_are_searched_before_they_are_matched(spark):
    rows = [("thus, thus thusly _thus x thus",), ("in contrast. in  contrast",), ("",), (None,), ("nothing here",)]
    df = spark.createDataFrame(rows, "c STRING").select(T.count_phrases(F.col("c"), ("thus", "in contrast")).alias("n"), T.count_any(F.col("c"), ("thus",)).alias("m"))
    assert [tuple(r) for r in df.collect()] == [(3, 5), (1, 0), (0, 0), (None, None), (0, 0)]
    assert "contains" in df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_syllables_of_a_text_are_those_of_its_tokens(spark):
    words = ["the", "tree", "table", "idea", "rhythm", "bcd", "made", "be", "eye", "queue", "aa", "xe", "these", "e" * 3]
    df = spark.createDataFrame([(words,), ([],), (["the"] * 3,)], "k ARRAY<STRING>")
    joined = F.concat(F.lit(" "), F.array_join("k", " "), F.lit(" "))
    got = df.select(T.total_syllables(joined).alias("a"), F.aggregate("k", F.lit(0), lambda s, w: s + T.syllables(w)).alias("b")).collect()
    assert all(r.a == r.b for r in got) and got[0].b > 14


def test_char_shingles_run_over_batches(spark, tmp_path):
    texts = ["abcde fghij", "ABCDE\t\n abcde", "", None, "Größe größe", "日本語の文章です。", "a😀b😀c😀d", "abcd"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING").write.parquet(str(tmp_path / "documents.parquet"))
    df = catalogue.QUERIES["char_shingles"](spark, str(tmp_path))
    squeezed = [None if t is None else " ".join(("x" + t.lower() + "x").split())[1:-1] for t in texts]
    assert {r.doc_id: r.n_shingles for r in df.collect()} == {i: None if t is None else len({t[k : k + 5] for k in range(len(t) - 4)}) for i, t in enumerate(squeezed)}
    assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()


def test_nearest_by_blocks_with_ties(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(120, 8)).astype(np.float32)
    x[10:40] = x[5]  # many equal vectors: the smallest ids come first
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(120)] + [(500, None)], "id LONG, v ARRAY<FLOAT>")
    q, c = df.where("id % 5 = 0").select(F.col("id").alias("q"), "v"), df.select(F.col("id").alias("c"), "v")
    y = x.astype(np.float64)
    want = {}
    for i in range(0, 120, 5):
        score = [sum(float(a) * float(b) for a, b in zip(y[i], y[j])) for j in range(120)]
        want[i] = sorted((j for j in range(120) if j != i), key=lambda j: (-score[j], j))[:5]
    for block in (4096, 16):
        got: dict = {}
        for r in sorted(S.top_k_cosine(q, c, 5, block=block).collect(), key=lambda r: (r.q, r.rank)):
            got.setdefault(r.q, []).append(r.c)
        assert got == want
    some = S.top_k_cosine(q, c, 1, 3.0).collect()
    assert all(r.score >= 3.0 and r.rank == 1 for r in some)
    small = S.compare_groups(df.where("v IS NOT NULL").select("id", (F.col("id") % 3).alias("label"), "v"))
    assert small.count() == 3


def test_verified_pairs_are_all_pairs(spark, tmp_path):
    # 100 pairs of documents with 20 of 40 shingles in common: bands of min-hashes miss some of such pairs
    word = lambda k, i: f"{'abcdefghij'[k // 10]}{'abcdefghij'[k % 10]}{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}"
    rows = [(2 * k + s, " ".join(word(k, i) for i in (range(32) if not s else [*range(22), *range(60, 70)]))) for k in range(100) for s in (0, 1)]
    spark.createDataFrame(rows, "doc_id LONG, text STRING").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalogue.QUERIES["lsh_verified"](spark, str(tmp_path)).collect()
    assert {(r.a, r.b) for r in got} == {(2 * k, 2 * k + 1) for k in range(100)} and all(r.jaccard == 0.5 for r in got)
    assert K.uniq(np.array([3, 1, 3])).tolist() == [1, 3]
