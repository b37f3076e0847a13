"""Column functions against literal expectations and plain Python."""

import re

from pyspark.sql import functions as F

from plumbline.functions import stats, text as T
from plumbline.operators import ai, coherence, style, watermark

PARA = "The harbour was quiet at dawn, and the boats were moved by the tide. Nobody spoke for an hour. We measured the water level twice; it had risen possibly a little. Then the wind came."


def one(spark, col, text=PARA):
    return spark.createDataFrame([(text,)], "t STRING").select(col(F.col("t")).alias("x")).first().x


def test_tokens_and_sentences(spark):
    assert one(spark, T.alpha_tokens, "Don't stop, été x y2 ab") == ["don", "stop", "ab"]
    assert one(spark, T.sentences, "One. Two? three. Four") == ["One.", "Two? three.", "Four"]
    assert one(spark, T.words, "  a\n b\tc ") == ["a", "b", "c"]
    assert one(spark, T.batch_words, "Don't a-b") == ["dont", "ab"]
    assert one(spark, T.letter_words, "Don't a-b") == ["don", "t", "a", "b"]


def test_shingles(spark):
    assert one(spark, lambda c: T.ngrams(T.words(c), 2), "a b c") == ["a b", "b c"]
    assert one(spark, lambda c: T.ngrams(T.words(c), 4), "a b c") == []
    assert one(spark, lambda c: T.char_ngrams(c, 5), "Abc  dé") == ["abc d", "bc dé"]
    assert one(spark, lambda c: T.char_ngrams(c, 5), "abc") == []


def test_segments(spark):
    text = " ".join(["w"] * 7)
    assert [len(x.split()) for x in one(spark, lambda c: T.segments(T.words(c), 4), text)] == [4, 3]
    assert [len(x.split()) for x in one(spark, lambda c: T.segments(T.words(c), 6), text)] == [6]


def test_counts(spark):
    assert one(spark, lambda c: T.count_of(c, "aa"), "aaaa bab") == 2
    assert one(spark, lambda c: T.count_phrases(c, ("thus", "as a result")), "thus thusly, as a result. thus") == 3
    assert [one(spark, T.syllables, w) for w in ("table", "the", "idea", "rhythm", "x")] == [1, 1, 2, 1, 1]


def test_similarities(spark):
    pairs = spark.createDataFrame([("Deep rivers run", "deep rivers run"), ("abc", "xyz"), ("", "abc"), ("a b", "c d")], "a STRING, b STRING")
    assert [r.x for r in pairs.select(T.title_similarity(F.col("a"), F.col("b")).alias("x")).collect()] == [1.0, 0.0, 0.0, 1.0]
    lists = spark.createDataFrame([(["a", "b", "c"], ["a", "c"]), ([], ["a"]), (["a"], ["a"])], "a ARRAY<STRING>, b ARRAY<STRING>")
    assert [r.x for r in lists.select(T.lcs_similarity(F.col("a"), F.col("b")).alias("x")).collect()] == [0.8, 0.0, 1.0]


def test_escape_doi_year(spark):
    assert one(spark, T.html_escape, '<a & "b">') == "&lt;a &amp; &quot;b&quot;&gt;"
    assert one(spark, T.doi, "see 10.1000/xyz12, and") == "10.1000/xyz12"
    assert one(spark, T.year, "in 1899, 1987 and 2014") == "1987"
    assert one(spark, T.ref_year, "in 1899, 1979 and 2014") == 2014
    assert one(spark, T.title_from_raw, "Marlow, K. Tidal patterns in coastal sediment. Journal, 2014.") == "Tidal patterns in coastal sediment"


def test_run_lengths_and_entropy(spark):
    df = spark.createDataFrame([(list("aabbbc"),), ([],)], "a ARRAY<STRING>")
    rows = df.select(stats.run_lengths(F.sort_array("a")).alias("c")).collect()
    assert [r.c for r in rows] == [[2, 3, 1], []]
    z = spark.createDataFrame([(0.0,), (1.6448536,), (1.959964,), (2.5758293,)], "z DOUBLE").select(stats.normal_sf(F.col("z")).alias("p")).collect()
    assert all(abs(r.p - e) < 1e-4 for r, e in zip(z, (0.5, 0.05, 0.025, 0.005)))


def test_profile(spark):
    df = spark.createDataFrame([(1, PARA), (2, "too short"), (3, None), (4, "")], "doc_id LONG, text STRING")
    rows = {r.doc_id: r for r in style.profile(df).collect()}
    assert rows[1].word_count == len(re.findall(r"\b[a-z]{2,}\b", PARA.lower()))
    assert len(rows[1].function_words) == 50 and rows[1].passive_ratio > 0 and rows[1].hedge_density > 0
    assert all(rows[i].word_count == 0 and rows[i].ttr == 0.0 for i in (2, 4))
    d = style.profile(df).where("doc_id = 1").select(style.delta(style.vector(), style.vector()).alias("d")).first()
    assert d.d == 0.0


def test_ai_rules(spark):
    v = spark.createDataFrame([(0.10,), (0.35,), (0.65,), (0.80,)], "s DOUBLE").select(ai.verdict(F.col("s"), F.lit(0.60)).alias("v")).collect()
    assert [r.v for r in v] == ["HUMAN", "UNCERTAIN", "AI_LIKELY", "AI_DETECTED"]
    m = spark.createDataFrame([("zh",), ("en",), ("xx",), (None,)], "l STRING").select(ai.multiplier(F.col("l")).alias("m")).collect()
    assert [r.m for r in m] == [0.80, 1.00, 0.90, 0.90]
    df = spark.createDataFrame([("",), (PARA,)], "text STRING")
    rows = ai.style_score(ai.burstiness(df)).collect()
    assert rows[0].style_score == 0.5 and rows[0].burstiness == 0.5 and 0 <= rows[1].burstiness <= 1


def test_coherence(spark):
    text = "# Introduction\nThus it may be so. Hence it could be that. Therefore we suggest that it often is. Furthermore it seems to be.\n# Oddities"
    r = coherence.document_scores(spark.createDataFrame([(1, text), (2, "")], "doc_id LONG, text STRING")).orderBy("doc_id").collect()
    assert r[0].connector_density > 3.5 and "discourse_connector_density" in r[0].flags and r[0].template_match == 0.5
    assert r[1].connector_density == 0.0 and r[1].verdict == "HUMAN_LIKE"
    m = coherence.mtld(spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60))), (2, "a b")], "doc_id LONG, text STRING")).orderBy("doc_id").collect()
    assert m[0].mtld == 60.0 and m[1].mtld == 0.0


def test_watermark_modes(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    df = spark.createDataFrame([(1, " ".join(words * 21)), (2, "only six words are in here"), (3, None)], "doc_id LONG, text STRING")
    r = watermark.screen(df).orderBy("doc_id").collect()
    assert r[0].tokens == 210 and r[0].verdict in ("STATISTICAL_ANOMALY", "NO_STATISTICAL_ANOMALY") and abs(r[0].entropy - 1) < 1e-9
    assert [x.verdict for x in r[1:]] == ["INSUFFICIENT_TEXT"] * 2 and not any(x.affects_overall_risk for x in r)
    assert watermark.screen(df, mode="DISABLED").first().verdict == "SKIPPED"
    assert watermark.screen(df, mode="VERIFIED_SCHEME").first().verdict == "UNSUPPORTED_CONFIGURATION"
