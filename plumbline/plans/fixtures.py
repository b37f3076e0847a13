"""Small inline tables for operators that the driver tables don't feed: references, registries, source files, rule cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators import citations

_REFS = [
    # doc_id, ref_idx, raw, authors, year, title, doi, cite_key
    (1, 0, "Marlow, K. Tidal patterns in coastal sediment. Journal of Shore Studies, 2014.", ["Karin Marlow"], "2014", "Tidal patterns in coastal sediment", "10.1000/a1", "a1"),
    (1, 1, "Okafor, B. Heat flow in layered rock. Journal of Shore Studies, 2011.", ["Ben Okafor"], "2011", "Heat flow in layered rock", "10.1000/a2", "a2"),
    (1, 2, "Lindt, P. Moss growth on granite walls. Journal of Shore Studies, 2014.", ["Petra Lindt"], "2014", "Completely other words stand here", "10.1000/a3", "a3"),
    (1, 3, "Sato, R. Wind loads on tall masts. Journal of Shore Studies, 2014.", ["Wrong Person"], "2014", "Wind loads on tall masts", "10.1000/a4", "a4"),
    (1, 4, "Ruiz, M. Salt transport in deltas. Journal of Shore Studies, 2014.", ["Mar Ruiz"], "2001", "Unlike the entry in every word", "10.1000/a5", "a5"),
    (1, 5, "Brandt, F. Ice cover of northern lakes. Journal of Shore Studies, 2014.", ["Nobody Known"], "1999", "Unlike the entry in every word", "10.1000/a6", "a6"),
    (2, 0, "Unknown, X. A work that was never written. Global Journal of Pure Research, 2019.", ["Xaver Unknown"], "2019", "A work that was never written", "10.1000/none", "b0"),
    (2, 1, "Vale, T. Server trouble and its ends. Omics Letters, 2019.", ["Tom Vale"], "2019", "Server trouble and its ends", "10.1000/b1", "b1"),
    (2, 2, "Marlow, K. Tidal patterns in coastal sediment. International Research Journal, 2019.", ["Karin Marlow"], "2014", "Tidal patterns in coastal sediment", None, "b2"),
    (2, 3, "Hill, J. Nothing like any registered title exists. World Journal of Science, 2019.", ["June Hill"], "2019", "Nothing like any registered title exists", None, "b3"),
    (2, 4, "Short note.", [], "2019", None, None, None),
    (2, 5, "Kim, S. et al. Sparse grids in practice. American Journal of Modern Research, 2019.", [], "2019", None, "", "b5"),
    (3, 0, "Adler, Q. Paper one on rivers and dams. IEEE Transactions on Water Systems, 1998", ["Quinn Adler"], "1998", "Paper one on rivers and dams", None, "c0"),
    (3, 1, "Adler, Q. Paper two on rivers and dams. IEEE Transactions on Water Systems, 1999", ["Quinn Adler"], "1999", "Paper two on rivers and dams", None, "c1"),
    (3, 2, "Berg, O. Paper three on lakes. ACM Transactions on Lake Models, 2003", ["Ola Berg"], "2003", "Paper three on lakes", None, "c2"),
]
_REGISTRY = [
    ("10.1000/a1", 200, "Tidal patterns in coastal sediment", [("Marlow", "Karin")], "2014", "Journal of Shore Studies", None),
    ("10.1000/a2", 200, "Heat flow in layered rock", [("Okafor", "Ben")], "2012", "Journal of Shore Studies", None),
    ("10.1000/a3", 200, "Moss growth on granite walls", [("Lindt", "Petra")], "2014", "Journal of Shore Studies", None),
    ("10.1000/a4", 200, "Wind loads on tall masts", [("Sato", "Rei")], "2014", "Journal of Shore Studies", None),
    ("10.1000/a5", 200, "Salt transport in deltas", [("Ruiz", "Mar")], "2014", "Journal of Shore Studies", None),
    ("10.1000/a6", 200, "Ice cover of northern lakes", [("Brandt", "Finn")], "2014", "Journal of Shore Studies", None),
    ("10.1000/b1", 503, None, [], None, None, None),
]
_WORKS = [("10.1000/a1", 0, "journal", "Shore", False), ("10.1000/a2", 0, "journal", "Shore", False), ("10.1000/a3", 0, "journal", "Shore", True), ("10.1000/a4", 5, "journal", "Shore", True), ("10.1000/a5", 0, "repository", "Shore", True)]

_TEX = r"""\documentclass{article} % a comment
\title{Rivers of \emph{Clay}}
\author{Ada Quill}
\author[2]{Ben Moor}
\begin{document}
\begin{abstract}
We study \textbf{clay} rivers.\cite{one}
\end{abstract}
\section{Introduction}
Clay moves slowly \cite{one,two}. See \ref{fig:a}.
\begin{equation} a = b \end{equation}
\subsection*{Aim of the work}
We measure 50\% of it.
\section{Results}
It moved {very} little.
\begin{thebibliography}{9}
\bibitem{one} Marlow, K. Tidal patterns. 2014. doi 10.1000/a1.
\bibitem[Ok]{two} Okafor, B. Heat flow. 1987.
\end{thebibliography}
\end{document}
"""
_BIB = """@article{marlow14,
  author = {Marlow, Karin and Okafor, Ben},
  title = {Tidal patterns in coastal sediment},
  journal = {Journal of Shore Studies},
  year = {2014},
  doi = {10.1000/a1}
}
@inproceedings{ruiz01,
  Author = "Ruiz, Mar",
  TITLE = "Salt transport in deltas",
  booktitle = "Proceedings of the Delta Workshop",
  year = "2001",
  url = {http://example.org/x}
}
"""
_TXT = """A plain study of walls and moss

Abstract:
Moss grows on walls. It grows slowly.

INTRODUCTION
Walls are old.
They are wet.
2. METHODS AND DATA
We looked at walls.
RESULTS
DISCUSSION
Nothing moved.
References
[1] Lindt, P. Moss growth on granite walls. 2014. 10.1000/a3.
[2] too short
[3] Brandt, F. Ice cover of northern lakes. Journal of Shore Studies, 1999.
"""


def refs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(d, i, raw, a, y, t, doi, None, None, k) for d, i, raw, a, y, t, doi, k in _REFS], citations.REFS)


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_REGISTRY, citations.REGISTRY)


def works(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_WORKS, citations.WORKS)


def authors(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, ["marlow"]), (2, []), (3, ["Adler"])], "doc_id BIGINT, authors ARRAY<STRING>")


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("a.tex", "latex", _TEX), ("b.bib", "bib", _BIB), ("c.txt", "txt", _TXT), ("d.txt", "txt", "No heading here, only one line of text.")], "path STRING, format STRING, raw STRING")


def sections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, "# Start\nx\nMETHODS\ny\n## End"), (2, "# Start\nx\n## End"), (3, "no headings"), (4, "# End\n# Start")], "id BIGINT, text STRING")


_CASE = {"plagiarism": 0.0, "ai": 0.0, "citation": 0.0, "style": 0.0, "coherence": 0.0, "hallucinated": 0, "recycling_risk": "LOW", "network_risk": "LOW", "verified_watermark": False}
#: One case on each side of every cut.
_CASES = [
    {}, {"plagiarism": 0.71}, {"plagiarism": 0.70}, {"hallucinated": 1}, {"recycling_risk": "CRITICAL"}, {"plagiarism": 0.41}, {"plagiarism": 0.40}, {"ai": 0.71}, {"ai": 0.70},
    {"recycling_risk": "HIGH"}, {"citation": 0.31}, {"citation": 0.30}, {"network_risk": "HIGH"}, {"coherence": 0.76}, {"coherence": 0.75}, {"plagiarism": 0.21}, {"plagiarism": 0.20},
    {"ai": 0.51}, {"ai": 0.50}, {"recycling_risk": "MEDIUM"}, {"citation": 0.11}, {"citation": 0.10}, {"style": 0.31}, {"style": 0.30}, {"network_risk": "MEDIUM"}, {"coherence": 0.51}, {"coherence": 0.50},
    {"verified_watermark": True}, {"ai": 0.71, "verified_watermark": True}, {"hallucinated": 2, "verified_watermark": True},
]


def risk_cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *(_CASE | c).values()) for i, c in enumerate(_CASES)], "case INT, plagiarism DOUBLE, ai DOUBLE, citation DOUBLE, style DOUBLE, coherence DOUBLE, hallucinated INT, recycling_risk STRING, network_risk STRING, verified_watermark BOOLEAN")


def score_cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, None, None), (1, 0.3, None), (2, 0.9, None), (3, None, 0.9), (4, 0.3, 0.95), (5, 0.25, 0.85)], "case INT, j DOUBLE, c DOUBLE")


#: Cases of the three-signal risk: citation risk, issue rate, consistent style, AI score.
_SCAN = [("LOW", 0.0, True, 0.1), ("HIGH", 0.0, True, 0.1), ("LOW", 0.31, True, 0.1), ("LOW", 0.3, True, 0.1), ("LOW", 0.0, False, 0.1), ("MEDIUM", 0.0, True, 0.5), ("LOW", 0.0, True, 0.51), ("LOW", 0.1, True, 0.5), ("LOW", 0.11, True, 0.5)]


def scan_cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *c) for i, c in enumerate(_SCAN)], "case INT, citation STRING, rate DOUBLE, consistent BOOLEAN, ai DOUBLE")
