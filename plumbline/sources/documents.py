"""Reading document files: text, LaTeX, BibTeX and DOCX natively, PDF by a pluggable extractor.

All readers give rows of (path, format, title, authors, abstract, full_text); sections
and references are tables of their own, derived by Column functions.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline.functions import text as T

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def format_of(path: Column) -> Column:
    s = suffix(path)
    return F.when(s == "pdf", "pdf").when(s == "docx", "docx").when(s == "tex", "latex").when(s == "bib", "bib").otherwise("txt")


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(path, label, format, content) of every file below a folder, the label being the file's stem."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", T.stem(F.col("path")).alias("label"), format_of(F.col("path")).alias("format"), "content")


def docx_text(content: bytes) -> str:
    """Paragraphs of a DOCX body that aren't blank, joined by line ends."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    paras = ("".join(t.text or "" for t in p.iter(_W + "t")) for p in root.iter(_W + "p"))
    return "\n".join(p for p in paras if p.strip())


def parse(files: DataFrame, pdf: Callable[[bytes], str] | None = None) -> DataFrame:
    """(path, label, format, title, authors, abstract, full_text, error) of scanned files; what can't be read has an error instead of a text.

    ``pdf`` turns a PDF's bytes into text, pages joined by line ends; without one, PDF rows have an error.
    """

    def packed(fmt: pd.Series, content: pd.Series) -> pd.DataFrame:
        out = []
        for f, c in zip(fmt, content):
            try:
                if f == "pdf" and pdf is None:
                    raise ValueError("no PDF extractor given")
                out.append((docx_text(c) if f == "docx" else pdf(c), None))
            except Exception as e:  # one bad file must not end the scan
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["text", "error"])

    read = F.pandas_udf(packed, "text string, error string")
    plain = files.where("format NOT IN ('docx', 'pdf')").select("*", F.decode("content", "UTF-8").alias("raw"), F.lit(None).cast("string").alias("error"))
    rich = files.where("format IN ('docx', 'pdf')").withColumn("__r", read("format", "content")).select("*", F.col("__r.text").alias("raw"), F.col("__r.error").alias("error")).drop("__r")
    df = plain.unionByName(rich).drop("content")
    tex = F.col("format") == "latex"
    first = F.get(F.filter(F.split("raw", "\n"), lambda x: x != ""), F.lit(0))
    title = F.when(tex, latex_title(F.col("raw"))).when(F.col("format") == "docx", first).when(F.col("format") == "pdf", title_heuristic(F.col("raw")))
    return df.select(
        "path", "label", "format", title.alias("title"), F.when(tex, latex_authors(F.col("raw"))).otherwise(F.array().cast("array<string>")).alias("authors"),
        F.when(tex, latex_abstract(F.col("raw"))).when(F.col("format") != "bib", abstract(F.col("raw"))).alias("abstract"), F.when(tex, clean_latex(F.col("raw"))).otherwise(F.col("raw")).alias("full_text"), "raw", "error",
    )


def clean_latex(c: Column) -> Column:
    """Comments, citations, floats and commands out, arguments of formatting kept, white space squeezed."""
    env = "(?:equation|align|table|figure|tabular|array)[*]?"
    for pattern, new in (
        (r"%.*", ""),
        (r"\\(?:textbf|textit|emph|underline|texttt|textrm)\{([^}]*)\}", "$1"),
        (r"\\(?:cite|ref|label|eqref)\{[^}]*\}", ""),
        (r"(?s)\\begin\{" + env + r"\}.*?\\end\{" + env + r"\}", ""),
        (r"\\[a-zA-Z]+\*?\{([^}]*)\}", "$1"),
        (r"\\[a-zA-Z]+\*?", ""),
        (r"[{}]", ""),
        (r"\s+", " "),
    ):
        c = F.regexp_replace(c, pattern, new)
    return T.strip(c)


def latex_title(c: Column) -> Column:
    return clean_latex(T.strip(T.first_or_null(c, r"\\title\{([^}]+)\}", 1)))


def latex_authors(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"\\author(?:\[.*?\])?\{([^}]+)\}"), F.lit(1))


def latex_abstract(c: Column) -> Column:
    return clean_latex(T.first_or_null(c, r"(?s)\\begin\{abstract\}(.+?)\\end\{abstract\}", 1))


def latex_sections(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, pos, title, level, text, start, end): a mark before each heading splits the source; running lengths give the offsets."""
    head = r"\\(section|subsection|subsubsection)\*?\{([^}]+)\}"
    parts = df.select(key, F.posexplode(F.split(F.regexp_replace(F.col(col), "(" + head + ")", "\u0001$1"), "\u0001")).alias("pos", "part"))
    done = F.sum(F.length("part")).over(Window.partitionBy(key).orderBy("pos"))
    h = F.regexp_extract("part", "^" + head, 0)
    level = F.regexp_extract("part", "^" + head, 1)
    rows = parts.withColumn("end", done).where(F.col("pos") > 0)
    return rows.select(key, (F.col("pos") - 1).alias("pos"), clean_latex(F.regexp_extract("part", "^" + head, 2)).alias("title"), ((F.length(level) - 7) / 3 + 1).cast("int").alias("level"), clean_latex(F.substring(F.col("part"), F.length(h) + 1, F.length("part"))).alias("text"), (F.col("end") - F.length("part") + F.length(h)).alias("start"), "end")


def latex_references(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, ref_idx, cite_key, raw, doi, year) of \\bibitem entries."""
    item = r"(?s)\\bibitem(?:\[.*?\])?\{([^}]+)\}(.*?)(?=\\bibitem|\\end\{thebibliography\})"
    both = F.arrays_zip(F.regexp_extract_all(F.col(col), F.lit(item), F.lit(1)).alias("k"), F.regexp_extract_all(F.col(col), F.lit(item), F.lit(2)).alias("t"))
    rows = df.select(key, F.posexplode(both).alias("ref_idx", "e")).select(key, "ref_idx", T.strip(F.col("e.k")).alias("cite_key"), clean_latex(F.col("e.t")).alias("raw"))
    return rows.select("*", T.doi(F.col("raw")).alias("doi"), T.year(F.col("raw")).alias("year"))


def bib_field(body: Column, name: str) -> Column:
    """A field in braces, else in quotes; null where there is none."""
    braces, quotes = rf"(?is){name}\s*=\s*\{{([^}}]*)\}}", rf'(?is){name}\s*=\s*"([^"]*)"'
    return F.when(body.rlike(braces), T.strip(F.regexp_extract(body, braces, 1))).when(body.rlike(quotes), T.strip(F.regexp_extract(body, quotes, 1)))


def bib_entries(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, ref_idx, cite_key, raw, title, authors, year, journal, doi, url) of BibTeX entries."""
    entry = r"@\w+\{(\w+),([^@]+)"
    both = F.arrays_zip(F.regexp_extract_all(F.col(col), F.lit(entry), F.lit(1)).alias("k"), F.regexp_extract_all(F.col(col), F.lit(entry), F.lit(2)).alias("b"))
    rows = df.select(key, F.posexplode(both).alias("ref_idx", "e")).select(key, "ref_idx", F.col("e.k").alias("cite_key"), F.col("e.b").alias("raw"))
    some = lambda n: F.nullif(bib_field(F.col("raw"), n), F.lit(""))
    people = F.coalesce(F.transform(F.split(some("author"), " and "), T.strip), F.array().cast("array<string>"))
    return rows.select(key, "ref_idx", "cite_key", "raw", bib_field(F.col("raw"), "title").alias("title"), people.alias("authors"), bib_field(F.col("raw"), "year").alias("year"), F.coalesce(some("journal"), bib_field(F.col("raw"), "booktitle")).alias("journal"), bib_field(F.col("raw"), "doi").alias("doi"), bib_field(F.col("raw"), "url").alias("url"))


def sections(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, section, title, text, start, end): breaks at capital headings, by a running count of headings over the lines.

    A heading closes a section only if lines stand before it, so headings in a row keep the last; a text of headings only is one section 'Body'.
    """
    lines = df.select(key, F.col(col).alias("__whole"), F.posexplode(F.split(col, "\n")).alias("pos", "line"))
    order = Window.partitionBy(key).orderBy("pos")
    s = T.strip(F.col("line"))
    head = s.rlike(r"^(?:\d+\.?\s+)?([A-Z][A-Z\s&:/\-]{3,60})$") & (F.length(s) < 80)
    rows = lines.withColumn("head", head).withColumn("end", F.sum(F.length("line") + 1).over(order)).withColumn("block", F.sum(F.col("head").cast("int")).over(order))
    per = rows.groupBy(key, "block").agg(
        F.max(F.when(F.col("head"), T.strip(F.col("line")))).alias("title"), F.min(F.col("end") - F.length("line") - 1).alias("start"), F.max("end").alias("end"), F.count_if(~F.col("head")).alias("n"),
        F.sort_array(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line")))).alias("ls"),
    )
    made = per.where("n > 0").select(key, F.row_number().over(Window.partitionBy(key).orderBy("block")).alias("section"), F.coalesce("title", F.lit("Introduction")).alias("title"), T.strip(F.array_join(F.transform("ls", lambda x: x["line"]), "\n")).alias("text"), "start", "end")
    rest = df.join(made.select(key).distinct(), key, "left_anti").select(key, F.lit(1).alias("section"), F.lit("Body").alias("title"), F.col(col).alias("text"), F.lit(0).alias("start"), F.length(col).alias("end"))
    return made.unionByName(rest)


def body_text(secs: DataFrame, key: str) -> DataFrame:
    """(key, body): sections joined by blank lines, without reference sections."""
    keep = secs.where(~F.lower("title").rlike("reference|bibliograph"))
    return keep.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section", "text"))), lambda x: x["text"]), "\n\n").alias("body"))


def abstract(c: Column) -> Column:
    p = r"(?s)(?:Abstract|ABSTRACT)[:\s]*\n(.*?)(?:\n\n|\n[A-Z]{3,})"
    return F.when(c.rlike(p), T.strip(F.regexp_extract(c, p, 1)))


def title_heuristic(c: Column) -> Column:
    """The first of ten non-blank lines that has 11 to 199 characters and is no link."""
    lines = F.slice(F.filter(F.transform(F.split(c, "\n"), T.strip), lambda x: x != ""), 1, 10)
    return F.get(F.filter(lines, lambda x: (F.length(x) > 10) & (F.length(x) < 200) & ~F.startswith(x, F.lit("http"))), F.lit(0))


def references(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, ref_idx, cite_key, raw, doi, year) of the text behind the first reference header, split at numbers; entries under 20 characters keep their number but go."""
    block = T.first_or_null(F.col(col), r"(?is)(?:References|Bibliography|REFERENCES)\s*\n(.*)", 1)
    rows = df.select(key, F.posexplode(F.split(block, r"\n\s*(?:\[\d+\]|\(\d+\)|(?:\d+\.))\s+")).alias("ref_idx", "raw")).withColumn("raw", T.strip(F.col("raw"))).where(F.length("raw") >= 20)
    return rows.select(key, "ref_idx", F.concat(F.lit("ref_"), "ref_idx").alias("cite_key"), "raw", T.doi(F.col("raw")).alias("doi"), T.year(F.col("raw")).alias("year"))


def abbreviation_sentences(df: DataFrame, key: str, col: str) -> DataFrame:
    """(key, sent_idx, sentence, start): sentences that abbreviations don't end, of over 10 characters, with offsets by running lengths."""
    from plumbline.functions import constants as C

    shielded = F.regexp_replace(F.col(col), C.ABBREVIATIONS, "$1\u0002")
    # e.g. and i.e. hold a point inside as well
    shielded = F.regexp_replace(shielded, r"\b(e|i)\.(g|e)\u0002", "$1\u0002$2\u0002")
    marked = F.regexp_replace(shielded, r"(?<=[.!?])(\s+)(?=[A-Z])", "$1\u0001")
    rows = df.select(key, F.posexplode(F.split(marked, "\u0001")).alias("sent_idx", "part"))
    begin = F.sum(F.length("part")).over(Window.partitionBy(key).orderBy("sent_idx")) - F.length("part")
    lead = F.length("part") - F.length(F.regexp_replace("part", r"^\s+", ""))
    made = rows.withColumn("start", begin + lead).withColumn("sentence", T.strip(F.replace("part", F.lit("\u0002"), F.lit("."))))
    return made.where(F.length("sentence") > 10).select(key, "sent_idx", "sentence", "start")


def normalise(df: DataFrame, col: str = "text") -> DataFrame:
    """``df`` with the column NFKC-normalised and cleaned; NFKC has no built-in function."""
    import unicodedata

    def nfkc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    return df.withColumn(col, T.clean_control(F.pandas_udf(nfkc, "string")(F.col(col))))
