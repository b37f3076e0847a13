"""Joins, components, references, parsing, reports, the index and streaming."""

import io
import zipfile
from itertools import combinations

from pyspark.sql import functions as F

from plumbline.operators import batch, citations, recycling, similarity as S
from plumbline.operators.graph import connected_components
from plumbline.plans import fixtures, report
from plumbline.sources import documents as D
from plumbline.sources.index import CorpusIndex
from plumbline.streaming import ingest

A = "The ferry left the old pier before the fog had lifted from the narrow channel. Its crew counted nine crates of salted fish on the forward deck."
B = "A mild winter brought early blossom to every orchard along the southern slope. Growers feared that a late frost could ruin their harvest again."


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (7, 7), (12, 10), (5, None)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a LONG, b LONG")).collect()}
    assert {got[i] for i in (1, 2, 3, 4)} == {1} and got[12] == 10 and 7 not in got
    assert {got[100 + i] for i in range(31)} == {100}
    assert connected_components(spark.createDataFrame([], "a LONG, b LONG")).count() == 0


def test_pairs_within_matches_brute_force(spark):
    sets = {i: {(i * k + k * k) % 17 for k in range(1, 2 + i % 9)} for i in range(30)} | {90: {1, 2, 3}, 91: {1, 2, 3}, 92: set()}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "doc_id LONG, s ARRAY<LONG>")
    for t in (0.25, 0.5, 0.85):
        want = {(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] | sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}
        assert {(r.a, r.b) for r in S.pairs_within(df, "doc_id", "s", t).collect()} == want


def test_recycling(spark):
    docs = spark.createDataFrame([(1, A), (2, B), (3, A.replace("nine crates", "ten boxes")), (4, ""), (5, None)], "doc_id LONG, text STRING")
    prior = spark.createDataFrame([("old", A)], "label STRING, text STRING")
    r = {x.doc_id: x for x in recycling.summary(docs, prior).collect()}
    assert r[1].overlap_pct == 100.0 and r[1].risk == "CRITICAL" and r[1].verbatim == 2
    assert r[2].overlap_pct == 0.0 and r[2].risk == "LOW" and r[3].flagged == 2 and r[4].sentences == 0 and r[5].risk == "LOW"
    none = recycling.summary(docs, prior.where("false")).collect()
    assert all(x.risk == "LOW" for x in none)
    assert recycling.breakdown(docs.where("doc_id = 1"), prior).first().pct == 100.0


def test_batch(spark):
    docs = spark.createDataFrame([(1, A), (2, A + " Nobody else was there."), (3, B), (4, "")], "doc_id LONG, text STRING")
    p = batch.pairs(docs).collect()
    assert [(x.a, x.b) for x in p] == [(1, 2)] and "ngram" in p[0].reason
    scores = spark.createDataFrame([(i, 0.7) for i in range(1, 5)], "doc_id LONG, ai_score DOUBLE")
    s = batch.summary(docs, batch.pairs(docs), scores).first()
    assert s.clusters == 1 and s.risk == "CRITICAL" and s.high_ai == 4 and s.std_ai == 0.0
    assert batch.summary(docs, batch.pairs(docs).where("false"), scores.where("false")).first().risk == "LOW"


def test_citations(spark):
    v = {(r.doc_id, r.ref_idx): r for r in citations.verify(fixtures.refs(spark), fixtures.registry(spark)).collect()}
    want = {(1, 0): ("VALID", 1.0), (1, 1): ("MISMATCH", 0.70), (1, 2): ("MISMATCH", 0.65), (1, 3): ("MISMATCH", 0.80), (1, 4): ("MISMATCH", 0.35), (1, 5): ("HALLUCINATED", 0.15), (2, 0): ("HALLUCINATED", 0.95), (2, 1): ("UNRESOLVABLE", 0.0), (2, 2): ("VALID", 1.0), (2, 3): ("NO_DOI", 0.4)}
    assert {k: (v[k].verdict, v[k].confidence) for k in want} == want
    off = citations.verify(fixtures.refs(spark), fixtures.registry(spark), offline=True).collect()
    assert {(r.verdict, r.confidence, r.doi) for r in off} == {("NO_DOI", 0.5, None)}
    s = {r.doc_id: r for r in citations.summary(citations.verify(fixtures.refs(spark), fixtures.registry(spark))).collect()}
    assert s[1].risk == "HIGH" and s[1].hallucinated == 1 and s[3].risk == "LOW"
    n = {r.doc_id: r for r in citations.network(fixtures.authors(spark), citations.verify(fixtures.refs(spark), fixtures.registry(spark)), fixtures.works(spark)).collect()}
    assert n[2].predatory == 5 and "PREDATORY_JOURNAL:HIGH" in n[2].flags and "YEAR_CLUSTER" in n[1].flags and n[3].self_cites == 2 and "LOW_IMPACT" in n[1].flags


def test_parsing(spark):
    f = fixtures.files(spark)
    tex = f.where("format = 'latex'")
    t = tex.select(D.latex_title(F.col("raw")).alias("title"), D.latex_authors(F.col("raw")).alias("authors"), D.latex_abstract(F.col("raw")).alias("abstract")).first()
    assert (t.authors, t.abstract) == (["Ada Quill", "Ben Moor"], "We study clay rivers.")
    s = D.latex_sections(tex, "path", "raw").orderBy("pos").collect()
    assert [(r.title, r.level) for r in s] == [("Introduction", 1), ("Aim of the work", 2), ("Results", 1)]
    raw = tex.first().raw
    assert all(raw[r.start - 1] == "}" for r in s)
    refs = D.latex_references(tex, "path", "raw").orderBy("ref_idx").collect()
    assert [(r.cite_key, r.year, r.doi) for r in refs] == [("one", "2014", "10.1000/a1"), ("two", "1987", None)]
    b = D.bib_entries(f.where("format = 'bib'"), "path", "raw").orderBy("ref_idx").collect()
    assert b[0].authors == ["Marlow, Karin", "Okafor, Ben"] and b[0].doi == "10.1000/a1" and b[1].journal == "Proceedings of the Delta Workshop" and b[1].year == "2001"
    txt = f.where("path = 'c.txt'")
    secs = D.sections(txt, "path", "raw").orderBy("section").collect()
    assert [r.title for r in secs] == ["Introduction", "INTRODUCTION", "2. METHODS AND DATA", "DISCUSSION"] and secs[1].text == "Walls are old.\nThey are wet."
    assert D.sections(f.where("path = 'd.txt'"), "path", "raw").first().title == "Introduction"
    assert [r.cite_key for r in D.references(txt, "path", "raw").orderBy("ref_idx").collect()] == ["ref_0", "ref_2"]
    assert txt.select(D.abstract(F.col("raw")).alias("a")).first().a.startswith("Moss grows")


def test_scan_and_docx(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("Plain words here.")
    (tmp_path / "sub" / "b.tex").write_text(r"\title{T}\section{S} body")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "x.pdf").write_bytes(b"%PDF")
    body = io.BytesIO()
    with zipfile.ZipFile(body, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>First</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Second</w:t></w:r></w:p></w:body></w:document>')
    (tmp_path / "c.docx").write_bytes(body.getvalue())
    r = {x.label: x for x in D.parse(D.scan(spark, str(tmp_path))).collect()}
    assert r["a"].format == "txt" and r["b"].title == "T" and r["c"].full_text == "First\nSecond" and r["c"].title == "First"
    assert r["bad"].error and r["x"].error and r["a"].error is None


def test_plagiarism_score(spark):
    got = [r.s for r in fixtures.score_cases(spark).select(report.plagiarism_score(F.col("j"), F.col("c")).alias("s")).collect()]
    assert [round(x, 9) for x in got] == [0.0, 0.6, 1.0, 0.5, 0.675, 0.375]


def test_report(spark):
    docs = spark.createDataFrame([(1, A, "en", ["x"]), (2, B, "en", []), (3, "", "zz", []), (4, None, None, None)], "doc_id LONG, text STRING, lang STRING, authors ARRAY<STRING>")
    prior = spark.createDataFrame([("old", A)], "label STRING, text STRING")
    verdicts = citations.verify(fixtures.refs(spark), fixtures.registry(spark))
    r = report.analyze(docs, prior=prior, verdicts=verdicts, works=fixtures.works(spark)).cache()
    got = {x.doc_id: x for x in r.collect()}
    assert got[1].risk == "CRITICAL" and any("recycled" in f for f in got[1].flags) and len(got) == 4
    assert '"risk":"CRITICAL"' in report.to_json(r).where("doc_id = 1").first().json
    html = report.to_html(r).where("doc_id = 1").first().html
    assert html.startswith("<!doctype html>") and "CRITICAL" in html


def test_index_is_incremental(spark, tmp_path):
    ix = CorpusIndex(spark, str(tmp_path / "ix"))
    long_a, long_b = (A + " ") * 3, (B + " ") * 3
    add = lambda label, text: ix.add(spark.createDataFrame([(label, "p", text)], "label STRING, source_path STRING, text STRING"))
    add("a", long_a)
    add("b", long_b)
    assert ix.summary().first().documents == 2
    m = ix.matches(spark.createDataFrame([(1, long_a)], "doc_id LONG, text STRING")).collect()
    assert [(x.source, x.match_type, x.jaccard) for x in m] == [("a", "word_ngram", 1.0)]


def test_streaming(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "p", (A + " ") * 3)], "doc_id LONG, label STRING, source_path STRING, text STRING").withColumn("ts", F.current_timestamp())
    rows.write.parquet(str(tmp_path / "in"))
    ix = CorpusIndex(spark, str(tmp_path / "ix"))
    ingest.index_stream(ingest.fresh(ingest.inbox(spark, str(tmp_path / "in"))), ix, str(tmp_path / "ck")).awaitTermination()
    assert ix.summary().first().documents == 1
    ingest.score_stream(ingest.inbox(spark, str(tmp_path / "in")), lambda b: b.select("doc_id", F.length("text").alias("n")), str(tmp_path / "out"), str(tmp_path / "ck2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
