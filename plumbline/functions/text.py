"""Column functions over text: cleaning, splitting, tokens, shingles, counts. No Python runs per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from . import constants as C

_EDGE = r"[\p{L}\p{N}_]"


def bind(df: DataFrame, **cols: Column) -> DataFrame:
    """Adds columns behind a generator, so that Catalyst can't inline an expensive expression into each use of it."""
    return df.select("*", F.explode(F.array(F.struct(*[c.alias(k) for k, c in cols.items()]))).alias("__b")).select("*", "__b.*").drop("__b")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for a row: a lambda's variable can't be inlined."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def words(c: Column) -> Column:
    """White-space separated words."""
    return F.array_remove(F.split(c, r"\s+"), "")


def n_words(c: Column) -> Column:
    return F.size(words(c))


def alpha_tokens(c: Column, least: int = 2) -> Column:
    """Runs of word characters that are a-z only after lower-casing, independent of how a JDK reads \\b."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"(?<!{_EDGE})[a-z]{{{least},}}(?!{_EDGE})"), F.lit(0))


def batch_words(c: Column) -> Column:
    """Words after everything but a-z and white space is deleted."""
    return words(F.regexp_replace(F.lower(c), r"[^a-z\s]", ""))


def letter_words(c: Column) -> Column:
    """Words after everything but a-z becomes a space."""
    return words(F.regexp_replace(F.lower(c), "[^a-z]", " "))


def sentences(c: Column) -> Column:
    """Split behind . ! ? and white space where a capital A-Z follows; stripped, not empty."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+(?=[A-Z])"), strip), lambda x: x != "")


def sentences_any(c: Column) -> Column:
    """Split behind . ! ? and white space; stripped."""
    return F.transform(F.split(c, r"(?<=[.!?])\s+"), strip)


def paragraphs(c: Column, min_words: int, pattern: str = r"\n\n+") -> Column:
    return F.filter(F.transform(F.split(c, pattern), strip), lambda x: n_words(x) >= min_words)


def segments(w: Column, size: int) -> Column:
    """Tumbling runs of ``size`` words; a rest of at least half the size counts."""

    def cut(w: Column) -> Column:
        n = F.size(w)
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, size), " ")), lambda s: n_words(s) >= size // 2)

    return let(w, cut)


def ngrams(w: Column, n: int) -> Column:
    """n consecutive words joined by a space, repeats kept."""

    def cut(w: Column) -> Column:
        last = F.size(w) - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]))).otherwise(F.array().cast("array<string>"))

    return let(w, cut)


def char_ngrams(c: Column, n: int) -> Column:
    """All substrings of n characters of the lower-cased text with white space squeezed to a space."""

    def cut(chars: Column) -> Column:
        # an array of characters: a substring of UTF-8 is found by scanning from the start
        last = F.size(chars) - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.concat(*[F.get(chars, i + k) for k in range(n)]))).otherwise(F.array().cast("array<string>"))

    return let(F.split(F.regexp_replace(F.lower(c), r"\s+", " "), ""), cut)


def count_of(c: Column, part: str) -> Column:
    """Occurrences of a string that don't overlap; a text without one is only searched."""
    return F.when(F.contains(c, F.lit(part)), ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("long")).when(c.isNotNull(), F.lit(0).cast("long"))


def count_any(c: Column, parts: tuple[str, ...]) -> Column:
    return sum((count_of(c, p) for p in parts[1:]), count_of(c, parts[0]))


def count_phrases(c: Column, phrases: tuple[str, ...]) -> Column:
    """Word-bounded occurrences of each phrase (letters and spaces), summed; the pattern runs only where the phrase occurs at all."""
    each = [F.when(F.contains(c, F.lit(p)), F.regexp_count(c, F.lit(f"(?<!{_EDGE}){p}(?!{_EDGE})"))).when(c.isNotNull(), F.lit(0)) for p in phrases]
    return sum(each[1:], each[0]).cast("long")


def syllables(w: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(w, F.lit("[aeiouy]+")) - F.when(w.endswith("e"), 1).otherwise(0))


def total_syllables(c: Column) -> Column:
    """Syllables of a-z tokens with a space around each: runs of vowels without a last e, one for each token at least."""
    # tokens that come to none: those without a vowel, and those whose only run ends in a last e
    none = F.regexp_count(c, F.lit(" (?! )[^aeiouy ]*+(?:[aeiouy]*e)?(?= )"))
    return F.regexp_count(c, F.lit("[aeiouy]+")) - count_of(c, "e ") + none


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Of two arrays without repeats; ``empty`` where both are empty."""

    def of(p: Column) -> Column:
        return F.when((p["a"] == 0) & (p["b"] == 0), F.lit(empty)).otherwise(p["both"] / (p["a"] + p["b"] - p["both"]))

    return let(let(F.struct(a.alias("a"), b.alias("b")), lambda p: F.struct(F.size(p["a"]).alias("a"), F.size(p["b"]).alias("b"), F.size(F.array_intersect(p["a"], p["b"])).alias("both"))), of)


def title_similarity(a: Column, b: Column) -> Column:
    """Word-set Jaccard of words of three letters or more; 0 if a string is empty, 1 if neither has such words."""
    wa, wb = F.array_distinct(alpha_tokens(a, 3)), F.array_distinct(alpha_tokens(b, 3))
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0).otherwise(jaccard(wa, wb, 1.0))


def lcs_similarity(a: Column, b: Column) -> Column:
    """2 LCS / (m + n) of two string arrays; the table's row is folded along, 0 if either is empty."""
    zero = F.transform(b, lambda _: F.lit(0))

    def step(row: Column, x: Column) -> Column:
        up = F.concat(F.array(F.lit(0)), row)
        made = F.aggregate(
            F.arrays_zip(b.alias("y"), row.alias("old"), F.slice(up, 1, F.size(b)).alias("diag")),
            F.array(F.lit(0)),
            lambda acc, e: F.concat(acc, F.array(F.when(e["y"] == x, e["diag"] + 1).otherwise(F.greatest(e["old"], F.element_at(acc, -1))))),
        )
        return F.slice(made, 2, F.size(b))

    lcs = F.element_at(F.aggregate(a, zero, step), -1)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(2 * lcs / (F.size(a) + F.size(b)))


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def clean_control(c: Column) -> Column:
    """Control characters out, line ends as \\n, runs of blanks and of more than two line ends squeezed, stripped."""
    for pattern, new in ((r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), (r"\r\n?", "\n"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")):
        c = F.regexp_replace(c, pattern, new)
    return strip(c)


def clean_style(c: Column) -> Column:
    for pattern, new in ((r"https?://\S+", ""), (r"\[\d+\]", ""), (r"\s+", " ")):
        c = F.regexp_replace(c, pattern, new)
    return strip(c)


def headings(c: Column, capitals: str) -> Column:
    """Lower-cased headings: # to ### lines, or lines that match ``capitals`` (a class with its quantifier)."""
    pattern = r"(?m)^#{1,3}\s+(.+)$|^([A-Z]" + capitals + ")$"
    both = F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)).alias("a"), F.regexp_extract_all(c, F.lit(pattern), F.lit(2)).alias("b"))
    return F.filter(F.transform(both, lambda x: strip(F.lower(F.when(F.coalesce(x["a"], F.lit("")) != "", x["a"]).otherwise(x["b"])))), lambda x: x != "")


def first_or_null(c: Column, pattern: str, group: int = 0) -> Column:
    x = F.regexp_extract(c, pattern, group)
    return F.when(x != "", x)


def doi(c: Column) -> Column:
    return F.regexp_replace(first_or_null(c, r"10\.\d{4,}/\S+"), r"[.,;)]+$", "")


def year(c: Column) -> Column:
    return first_or_null(c, r"\b(19|20)\d{2}\b")


def ref_year(c: Column) -> Column:
    return first_or_null(c, r"\b(19[89]\d|20[012]\d)\b").cast("int")


def title_from_raw(c: Column) -> Column:
    parts = F.filter(F.transform(F.slice(F.split(c, r"\.\s+"), 2, 2), strip), lambda p: (F.length(p) > 10) & (F.length(p) < 200) & ~p.rlike(r"^(19|20)\d{2}"))
    return F.get(parts, F.lit(0))


def stem(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/\\]+?)(\.[^./\\]*)?$", 1)


def py_round(c: Column, digits: int) -> Column:
    """Half-even rounding for reports."""
    return F.bround(c, digits)
