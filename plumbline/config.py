"""Thresholds of all detectors, as one immutable object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    word_n: int = 3
    char_n: int = 5
    word_threshold: float = 0.25
    char_threshold: float = 0.40
    num_perm: int = 128
    cosine_threshold: float = 0.82
    paraphrase_threshold: float = 0.70
    ppl_threshold: float = 45.0
    burstiness_threshold: float = 0.35
    ai_threshold: float = 0.60
    heuristic_threshold: float = 0.55
    heuristic_min_words: int = 40
    min_title_similarity: float = 0.65
    segment_words: int = 300
    style_delta: float = 0.40
    author_delta: float = 0.50
    recycle_char: float = 0.35
    recycle_word: float = 0.25
    recycle_semantic: float = 0.88
    recycle_medium_pct: float = 15.0
    recycle_high_pct: float = 30.0
    token_z: float = 4.0
    token_z_suspicious: float = 2.5
    token_min: int = 200
    token_gamma: float = 0.25
    token_vocab: int = 50257
    watermark_max_levels: int = 1
    self_citation: float = 0.30
    missing_doi: float = 0.60
    connector_density: float = 3.5
    cv_threshold: float = 0.35
    hedge_density: float = 2.5
    batch_similarity: float = 0.25
    batch_section: float = 0.70
    batch_min_ngram: float = 0.15
    batch_min_cluster: int = 3
    run_ngram: bool = True
    run_semantic: bool = True
    run_ai: bool = True
    run_citations: bool = True
    run_style: bool = True
    run_recycling: bool = True
    run_watermark: bool = True
    run_network: bool = True
    run_coherence: bool = True


DEFAULT = Config()
