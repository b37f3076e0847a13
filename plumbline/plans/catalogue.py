"""Named queries over the driver tables, with the DuckDB SQL that replays each.

``documents`` has no blank lines, so queries on paragraphs take each line as one:
both sides double the line ends first.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline import tables
from plumbline.functions import constants as C, shingles as K, stats, text as T
from plumbline.operators import ai, batch, citations, coherence, pairs, recycling, similarity as S, style, watermark
from plumbline.operators.graph import connected_components
from plumbline.plans import fixtures, report
from plumbline.plans.sqlfiles import SQL
from plumbline.session import attach
from plumbline.sources import documents as D, index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable) -> Callable:
    """Registers a query under its name, and its SQL if there is any."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(lambda name: attach(spark).read.parquet(f"{sf_dir}/{name}.parquet"), spark)
        # one integer type for all results
        return df.select(*[F.col(f"`{c}`").cast("long").alias(c) if kind == "int" else F.col(f"`{c}`") for c, kind in df.dtypes])

    QUERIES[fn.__name__] = run
    if fn.__name__ in SQL:
        ORACLES[fn.__name__] = SQL[fn.__name__]
    return fn


def _lines(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))


def _digest(words: Column) -> Column:
    return F.md5(F.array_join(words, "\u0001").cast("binary"))


# ---- words, sentences, paragraphs -------------------------------------------------------------------------------


@query
def word_count(t, spark):
    return t("documents").select("doc_id", T.n_words(F.col("text")).alias("n_words"))


@query
def alpha_tokens(t, spark):
    d = T.bind(t("documents").select("doc_id", "text"), k=T.alpha_tokens(F.col("text")))
    return d.select("doc_id", F.size("k").alias("n_tokens"), F.size(F.array_distinct("k")).alias("n_distinct"), _digest(F.col("k")).alias("tokens_md5"))


@query
def sentence_split(t, spark):
    return t("documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sent_idx", "sentence"))


@query
def sentence_split_any(t, spark):
    return t("documents").select("doc_id", F.posexplode(F.filter(T.sentences_any(F.col("text")), lambda s: F.length(s) > 10)).alias("sent_idx", "sentence"))


@query
def paragraph_split(t, spark):
    rows = _lines(t("documents")).select("doc_id", F.posexplode(T.paragraphs(F.col("text"), 15)).alias("para_idx", "para"))
    return rows.select("doc_id", "para_idx", T.n_words(F.col("para")).alias("n_words"), F.md5(F.col("para").cast("binary")).alias("para_md5"))


@query
def word_segments_300(t, spark):
    d = T.bind(t("documents").select("doc_id", "text"), w=T.words(F.col("text")))
    rows = d.select("doc_id", F.posexplode(T.segments(F.col("w"), 300)).alias("seg_idx", "seg"))
    return rows.select("doc_id", "seg_idx", T.n_words(F.col("seg")).alias("n_words"), F.md5(F.col("seg").cast("binary")).alias("seg_md5"))


@query
def abbrev_sentences(t, spark):
    return D.abbreviation_sentences(t("documents"), "doc_id", "text")


@query
def clean_text(t, spark):
    return D.normalise(t("documents").select("doc_id", "text")).select("doc_id", F.length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query
def title_heuristic(t, spark):
    return t("documents").select("doc_id", D.title_heuristic(F.col("text")).alias("title"))


@query
def snippet(t, spark):
    return t("documents").select("doc_id", F.substring("text", 1, 200).alias("snippet"), T.html_escape(F.substring("text", 1, 120)).alias("escaped"))


@query
def content_hash(t, spark):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5(F.col("text").cast("binary")).alias("md5"))


@query
def page_stem(t, spark):
    return t("pages").select("page_id", T.stem(F.col("url")).alias("stem"), D.format_of(F.col("url")).alias("format"))


# ---- shingles and frequencies -----------------------------------------------------------------------------------


@query
def word_shingles(t, spark):
    d = T.bind(t("documents").select("doc_id", "text"), k=T.alpha_tokens(F.col("text")))
    d = T.bind(d, s=F.array_distinct(T.ngrams(F.col("k"), 3)))
    return d.select("doc_id", F.size("s").alias("n_shingles"), _digest(F.sort_array("s")).alias("shingles_md5"))


@query
def char_shingles(t, spark):
    docs = t("documents").select("doc_id", F.lower("text").alias("low"))

    def run(batches):
        for b in batches:
            for i, j in K.chunks(b, "low"):
                low = b.column(1).slice(i, j - i)
                n = np.diff(K.distinct(*K.char_grams(low), j - i)[1])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n, mask=low.is_null().to_numpy(zero_copy_only=False))], ["doc_id", "n_shingles"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long")


@query
def ngram_list(t, spark):
    d = T.bind(t("documents").select("doc_id", "text"), k=T.alpha_tokens(F.col("text")))
    d = T.bind(d, s=T.ngrams(F.col("k"), 2))
    return d.select("doc_id", F.size("s").alias("n"), _digest(F.col("s")).alias("list_md5"))


@query
def token_frequency(t, spark):
    tok = t("documents").select("doc_id", F.explode(T.alpha_tokens(F.col("text"))).alias("token"))
    # counts per document first: the second aggregation gets a row for each word of a document
    return tok.groupBy("doc_id", "token").agg(F.count("*").alias("c")).groupBy("token").agg(F.sum("c").alias("n"), F.count("*").alias("df"))


@query
def rare_vocab(t, spark):
    return batch.rare_vocabulary(t("documents"))


@query
def top_content_words(t, spark):
    return batch.top_words(t("documents"), C.CONTENT_STOPS)


@query
def vocabulary_richness(t, spark):
    d = T.bind(t("documents").select("doc_id", "text"), k=T.alpha_tokens(F.col("text")))
    d = T.bind(d, c=stats.run_lengths(F.sort_array("k")))
    n, v = F.size("k"), F.size("c")
    hapax = F.size(F.filter("c", lambda x: x == 1))
    return d.select("doc_id", n.alias("n"), v.alias("vocab"), F.coalesce(F.try_divide(v, n), F.lit(0.0)).alias("ttr"), F.coalesce(F.try_divide(hapax, v), F.lit(0.0)).alias("hapax_ratio"), F.round(stats.yule_k(F.col("c"), n), 6).alias("yule_k"))


@query
def function_word_vector(t, spark):
    d = T.bind(t("documents").select("doc_id", "text"), k=T.alpha_tokens(F.col("text")))
    d = T.bind(d, f=F.filter("k", lambda w: w.isin(*C.FUNCTION_WORDS)))
    rows = d.where(F.size("k") > 0).select("doc_id", F.size("k").alias("n"), "f", F.explode(F.array(*[F.lit(w) for w in C.FUNCTION_WORDS])).alias("word"))
    return rows.select("doc_id", "word", (F.size(F.filter("f", lambda x: x == F.col("word"))) / F.col("n")).alias("freq"))


# ---- style ------------------------------------------------------------------------------------------------------


def _profile(t) -> DataFrame:
    return style.profile(t("documents").select("doc_id", "text"))


@query
def style_densities(t, spark):
    return _profile(t).select("doc_id", "word_count", *[F.round(c, 6).alias(c) for c in ("punct_density", "passive_ratio", "nominalization_density", "hedge_density")])


@query
def readability(t, spark):
    return _profile(t).select("doc_id", F.round("fk_grade", 6).alias("fk_grade"))


@query
def sentence_length_stats(t, spark):
    return _profile(t).select("doc_id", F.round("avg_sentence_len", 6).alias("avg_len"), F.round("std_sentence_len", 6).alias("std_len"))


@query
def style_profile(t, spark):
    return _profile(t).select("doc_id", "word_count", *[F.round(c, 6).alias(c) for c in style.SCALARS], F.round(stats.total(F.col("function_words")), 6).alias("function_share"))


@query
def style_change_points(t, spark):
    return style.change_points(t("documents")).select("doc_id", "segment_index", F.round("delta", 6).alias("delta"), "flagged")


@query
def style_consistency(t, spark):
    return style.consistency(t("documents"))


@query
def author_deviation(t, spark):
    turns = t("conversations")
    base = turns.groupBy(F.col("role").alias("author")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("conv_id", "turn", "text"))), lambda x: x["text"]), " ").alias("text"))
    made = style.author_deviation(turns.select(F.struct("conv_id", "turn").alias("id"), F.col("role").alias("author"), "text"), base)
    return made.select("id.conv_id", "id.turn", "author", F.round("deviation", 6).alias("deviation"))


# ---- machine-written text ---------------------------------------------------------------------------------------


@query
def burstiness(t, spark):
    return ai.burstiness(t("documents").select("doc_id", "text")).select("doc_id", F.round("burstiness", 6).alias("burstiness"))


@query
def ai_style_score(t, spark):
    return ai.style_score(t("documents").select("doc_id", "text")).select("doc_id", F.round("style_score", 6).alias("style_score"))


@query
def ai_heuristic_paragraphs(t, spark):
    return ai.paragraphs_scored(_lines(t("documents"))).select("doc_id", "para_idx", F.round("score", 6).alias("score"), "flagged")


@query
def ai_verdicts(t, spark):
    return ai.document_scores(_lines(t("documents"))).select("doc_id", "paragraphs", F.round("ai_score", 6).alias("ai_score"), F.round("ai_fraction", 6).alias("ai_fraction"), F.round("threshold", 6).alias("threshold"), "verdict")


@query
def ai_by_quality(t, spark):
    made = ai.by_label(ai.document_scores(_lines(t("documents"))), t("labels"), "quality")
    return made.select("quality", "n", F.round("mean_score", 6).alias("mean_score"), "flagged_share")


@query
def ai_by_source(t, spark):
    scored = ai.document_scores(_lines(t("documents"))).join(t("documents").select("doc_id", "source"), "doc_id")
    return scored.rollup("lang", "source").agg(F.count("*").alias("n"), F.round(F.avg("ai_score"), 6).alias("mean_score"))


@query
def ai_top_paragraphs(t, spark):
    return ai.ranked(ai.paragraphs_scored(_lines(t("documents"))).withColumn("score", F.round("score", 9)), 3).select("doc_id", "para_idx", F.round("score", 6).alias("score"), "r")


@query
def lm_perplexity(t, spark):
    docs = t("documents")
    made = ai.perplexity(docs, docs.where("lang = 'en'"))
    return made.select("doc_id", "n", F.round("perplexity", 3).alias("perplexity"))


@query
def ai_ensemble(t, spark):
    """With a language model: the default one, trained on the English documents."""
    docs = t("documents")
    ppl = ai.perplexity(docs, docs.where("lang = 'en'"))
    made = ai.ensemble_scores(docs, ppl)
    # of rounded signals, so that the last digits of sums don't decide a rounding
    return made.select("doc_id", F.round(ai.ensemble(F.round("perplexity", 3), F.round("burstiness", 6), F.round("style_score", 6)), 4).alias("score"))


# ---- coherence and token statistics -----------------------------------------------------------------------------


@query
def coherence_scores(t, spark):
    return coherence.document_scores(t("documents")).select("doc_id", *[F.round(c, 6).alias(c) for c in ("connector_density", "hedging_density", "sentence_cv", "template_match", "ensemble")], "verdict", F.array_join("flags", ";").alias("flags"))


@query
def coherence_paragraphs(t, spark):
    return coherence.paragraph_scores(_lines(t("documents"))).select("doc_id", "para_idx", "preview", F.round("score", 6).alias("score"), F.round("sentence_cv", 6).alias("sentence_cv"))


@query
def mtld(t, spark):
    return coherence.mtld(t("documents")).select("doc_id", F.round("mtld", 6).alias("mtld"))


@query
def token_ids(t, spark):
    d = watermark.tokens(t("documents"))
    return d.select("doc_id", F.size("__id").alias("n"), F.md5(F.array_join("__id", ",").cast("binary")).alias("ids_md5"))


@query
def token_screen(t, spark):
    return watermark.screen(t("documents")).select("doc_id", "tokens", *[F.round(c, 6).alias(c) for c in ("green", "z", "entropy", "skew")], F.round("p", 9).alias("p"), "verdict", F.round("confidence", 6).alias("confidence"), F.round("score", 6).alias("score"))


@query
def greenlist_compat(t, spark):
    """Seeded shuffles draw a list of 50,257 ids for each distinct token that another follows, about once."""
    return watermark.greenlist_compat(t("documents"))


# ---- similarity -------------------------------------------------------------------------------------------------


def _grams(docs: DataFrame, salt: Column | None = None) -> pairs.Sets:
    """Sets of three words in a row."""
    return pairs.of_texts(docs, "doc_id", K.word_grams, salt)


@query
def pairwise_jaccard(t, spark):
    return pairs.within(_grams(t("documents")), 0.25)


@query
def lsh_verified(t, spark):
    """All pairs of 0.5 or more: bands of min-hashes missed some, which its SQL has."""
    return pairs.within(_grams(t("documents")), 0.5)


def _paragraphs(texts: DataFrame, key: str, name: str, least: int) -> DataFrame:
    p = _lines(texts).select(F.col(key).alias("k"), F.posexplode(T.paragraphs(F.col("text"), least)).alias("para_idx", "para"))
    return p.select(F.struct(F.col("k").alias("doc_id" if name == "l" else "label"), "para_idx").alias(name), "para")


@query
def benchmark_paragraph_matches(t, spark):
    made = index.paragraph_matches(_paragraphs(t("documents"), "doc_id", "l", 30), _paragraphs(t("benchmark"), "item_id", "r", 5))
    return made.select("doc_id", "para_idx", F.col("source").alias("item_id"), "source_idx", "jaccard", "match_type")


@query
def document_compare(t, spark):
    """Pairs of documents of a source compared directly: 0.6 word + 0.4 character Jaccard. For the pairs see ``_pairs``."""
    a, b = _pairs(t("documents"))
    both = T.bind(a.join(b.select("pair", F.col("text").alias("tb")), "pair"), w=T.jaccard(S.word_set(F.col("text")), S.word_set(F.col("tb"))), c=T.jaccard(S.char_set(F.col("text")), S.char_set(F.col("tb"))))
    return both.select("pair.source", "pair.a", "pair.b", F.col("w").alias("word_jaccard"), F.col("c").alias("char_jaccard"), F.round(0.6 * F.col("w") + 0.4 * F.col("c"), 6).alias("combined"), (F.col("w") >= 0.25).alias("flagged"))


def _pairs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pair, text) of either side; pair has source, a and b, a < b: each document with the next of its source, and all pairs of a source with word Jaccard of 0.25 or more."""
    ahead = docs.select("source", F.col("doc_id").alias("a"), F.lead("doc_id").over(Window.partitionBy("source").orderBy("doc_id")).alias("b")).where("b IS NOT NULL")
    # the source is hashed into the shingles: sets of different sources have none in common
    near = pairs.within(_grams(docs.where("source IS NOT NULL"), F.col("source")), 0.25).join(docs.select(F.col("doc_id").alias("a"), "source"), "a").select("source", "a", "b")
    both = tables.materialise(ahead.unionByName(near).distinct(), "document-pairs").select(F.struct("source", "a", "b").alias("pair"))
    side = lambda k: both.join(docs.select(F.col("doc_id").alias("__id"), "text"), F.col(f"pair.{k}") == F.col("__id")).select("pair", "text")
    return side("a"), side("b")


@query
def compare_documents(t, spark):
    a, b = _pairs(t("documents"))
    return recycling.compare(a, b).select("pair.source", "pair.a", "pair.b", "sentences", "flagged", "verbatim", "overlap_pct", "risk")


def _prior(t) -> DataFrame:
    return t("benchmark").select(F.col("item_id").alias("label"), "text")


@query
def recycling_passages(t, spark):
    return recycling.passages(t("documents"), _prior(t)).select("doc_id", "sent_idx", "source", "source_idx", "char_jaccard", "word_jaccard", "overlap_type", "risk")


@query
def benchmark_recycling(t, spark):
    return recycling.summary(t("documents"), _prior(t)).select("doc_id", "sentences", "flagged", "verbatim", "overlap_pct", "risk")


@query
def recycling_breakdown(t, spark):
    return recycling.breakdown(t("documents"), _prior(t))


def _vectors(t) -> tuple[DataFrame, DataFrame]:
    e = t("embeddings")
    return e.select(F.col("vec_id").alias("q"), F.col("embedding").alias("v")), e.select(F.col("vec_id").alias("c"), F.col("embedding").alias("v"))


@query
def knn_top5(t, spark):
    q, c = _vectors(t)
    return S.top_k_cosine(q.where("q % 20 = 0"), c, 5).select("q", "c", F.round("score", 9).alias("score"), "rank")


@query
def knn_threshold(t, spark):
    q, c = _vectors(t)
    return S.top_k_cosine(q.where("q % 20 = 0"), c, 1, 0.30).select("q", "c", F.round("score", 9).alias("score"))


@query
def semantic_compare(t, spark):
    """Largest and mean inner product of each label's vectors with all other rows."""
    e = t("embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").alias("v"))
    return S.compare_groups(e).select("label", F.round("max_cosine", 9).alias("max_cosine"), F.round("mean_cosine", 9).alias("mean_cosine"))


# ---- cohorts ----------------------------------------------------------------------------------------------------


@query
def batch_pairs(t, spark):
    made = batch.pairs(t("documents"))
    return made.select("a", "b", F.round("ngram", 9).alias("ngram"), F.round("vocab", 9).alias("vocab"), F.round("section", 9).alias("section"), F.round("combined", 6).alias("combined"), "reason")


@query
def batch_clusters(t, spark):
    return batch.clusters(batch.pairs(t("documents")))


@query
def batch_summary(t, spark):
    docs = t("documents")
    made = batch.summary(docs, batch.pairs(docs), ai.document_scores(_lines(docs)))
    return made.withColumns({c: F.round(c, 6) for c in ("mean_ai", "std_ai")})


@query
def jaccard_components(t, spark):
    return connected_components(pairs.within(_grams(t("documents")), 0.5)).select(F.col("id").alias("doc_id"), "component")


@query
def section_sequence_lcs(t, spark):
    rows = fixtures.sections(spark)
    h = T.headings(F.col("text"), r"[A-Z\s]{3,60}")
    a, b = rows.select(F.col("id").alias("a"), h.alias("ha")), rows.select(F.col("id").alias("b"), h.alias("hb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", T.lcs_similarity(F.col("ha"), F.col("hb")).alias("similarity"))


# ---- references -------------------------------------------------------------------------------------------------


@query
def citation_verdicts(t, spark):
    made = citations.verify(fixtures.refs(spark), fixtures.registry(spark))
    return made.select("doc_id", "ref_idx", "verdict", "confidence", F.array_join("issues", ";").alias("issues"), "doi", "resolved_title")


@query
def citation_verdicts_offline(t, spark):
    return citations.verify(fixtures.refs(spark), fixtures.registry(spark), offline=True).select("doc_id", "ref_idx", "verdict", "confidence")


@query
def citation_summary(t, spark):
    return citations.summary(citations.verify(fixtures.refs(spark), fixtures.registry(spark)))


@query
def citation_network(t, spark):
    verdicts = citations.verify(fixtures.refs(spark), fixtures.registry(spark))
    return citations.network(fixtures.authors(spark), verdicts, fixtures.works(spark))


@query
def predatory_refs(t, spark):
    return fixtures.refs(spark).select("doc_id", "ref_idx", citations.predatory_reason(F.col("raw")).alias("reason")).where("reason IS NOT NULL")


@query
def venue_hhi(t, spark):
    v = fixtures.refs(spark).select("doc_id", citations.venue(F.col("raw")).alias("venue")).where("venue IS NOT NULL").groupBy("doc_id", "venue").agg(F.count("*").alias("c"))
    return v.groupBy("doc_id").agg((F.sum(F.col("c") * F.col("c")) / (F.sum("c") * F.sum("c"))).alias("hhi"))


@query
def year_cluster(t, spark):
    y = fixtures.refs(spark).select("doc_id", T.ref_year(F.col("raw")).alias("year")).where("year IS NOT NULL")
    return batch.most_common(y, "doc_id", "year", 1).select("doc_id", "year", "n")


@query
def parse_tex(t, spark):
    f = fixtures.files(spark).where("format = 'latex'")
    return f.select("path", D.latex_title(F.col("raw")).alias("title"), F.array_join(D.latex_authors(F.col("raw")), ";").alias("authors"), D.latex_abstract(F.col("raw")).alias("abstract"), D.clean_latex(F.col("raw")).alias("full_text"))


@query
def parse_tex_sections(t, spark):
    return D.latex_sections(fixtures.files(spark).where("format = 'latex'"), "path", "raw")


@query
def parse_tex_refs(t, spark):
    return D.latex_references(fixtures.files(spark).where("format = 'latex'"), "path", "raw")


@query
def parse_bib(t, spark):
    return D.bib_entries(fixtures.files(spark).where("format = 'bib'"), "path", "raw").withColumn("authors", F.array_join("authors", ";"))


@query
def parse_sections(t, spark):
    return D.sections(fixtures.files(spark).where("format = 'txt'"), "path", "raw")


@query
def parse_abstract(t, spark):
    return fixtures.files(spark).where("format = 'txt'").select("path", D.abstract(F.col("raw")).alias("abstract"), D.title_heuristic(F.col("raw")).alias("title"))


@query
def parse_refs(t, spark):
    return D.references(fixtures.files(spark).where("format = 'txt'"), "path", "raw")


@query
def document_sections(t, spark):
    return D.sections(t("documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", "section", "title", F.length("text").alias("n"), "start", "end")


# ---- reports ----------------------------------------------------------------------------------------------------


def _report(t) -> DataFrame:
    docs = t("documents").withColumn("authors", F.array().cast("array<string>"))
    return report.analyze(docs, prior=_prior(t), matches=_matches(docs, t))


def _matches(docs: DataFrame, t) -> DataFrame:
    return index.paragraph_matches(_paragraphs(docs, "doc_id", "l", 30), _paragraphs(t("benchmark"), "item_id", "r", 5))


@query
def overall_risk(t, spark):
    return _report(t).select("doc_id", F.round("plagiarism", 6).alias("plagiarism"), F.round("ai", 6).alias("ai"), F.round("style", 6).alias("style"), F.round("coherence", 6).alias("coherence"), "recycling_risk", "risk")


@query
def risk_rules(t, spark):
    return fixtures.risk_cases(spark).select("case", report.overall_risk().alias("risk"))


@query
def plagiarism_score(t, spark):
    return fixtures.score_cases(spark).select("case", F.round(report.plagiarism_score(F.col("j"), F.col("c")), 6).alias("score"))


@query
def scan_risk_rules(t, spark):
    return fixtures.scan_cases(spark).select("case", batch.scan_risk(F.col("citation"), F.col("rate"), F.col("consistent"), F.col("ai")).alias("risk"))


@query
def report_lists(t, spark):
    """How many entries a document's lists have, and the first recycled passage."""
    docs = t("documents")
    made = report.details(docs, prior=_prior(t), matches=_matches(docs, t))
    n = lambda c: F.greatest(F.size(F.coalesce(c, F.array())), F.lit(0)).alias(c)
    first = F.get("recycled_passages", F.lit(0))
    return made.select("doc_id", n("ngram_matches"), n("recycled_passages"), n("source_breakdown"), F.coalesce(first["source"], F.lit(-1)).alias("first_source"), F.coalesce(first["overlap_type"], F.lit("")).alias("first_type"))


@query
def report_json(t, spark):
    docs = t("documents")
    return report.to_json(_report(t), report.details(docs, prior=_prior(t), matches=_matches(docs, t)))


@query
def report_html(t, spark):
    return report.to_html(_report(t))
