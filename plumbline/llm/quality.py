"""Line-first quality rules in DataFrame functions only.

Each line is judged on its own by punctuation, navigation and boilerplate rules
(too many symbols or marks, short lines without an ending mark, links side by side, phrases that make
up much of the line, a few words over and over);
lines that fail are removed, and a document is rejected when its base rules
fail or when the removed lines held more than ``max_lost`` of its word characters.

Words are runs without space, \\t, \\n, \\v, \\f, \\r. Counts are exact, except
that three-word windows are compared by a 64-bit hash. Null text counts as
empty; an empty text has no words and fails the base rule; very long texts are judged whole; repeated rows are
judged alike, null ids too; an empty table gives no rows. Other columns pass through ``clean`` unchanged, and names the
operator uses itself are prefixed, so extra columns can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

_WS = r"[\x20\x09-\x0D]+"
_HAS_WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class LineRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    max_lost: float = 0.5  #: share of word characters that removed lines may hold
    symbols_per_word: float = 0.5
    marks_per_word: float = 0.5  #: of ! and ?
    separators: int = 3  #: | » • · in a line from which it counts as navigation, if few words stand between them
    words_per_link: float = 3.0
    boilerplate_words: int = 40
    boilerplate_share: float = 0.3  #: share of a line's characters that phrases of boilerplate hold
    stub_words: int = 3  #: words up to which a line without ending punctuation counts as a menu's
    stub_chars: int = 40
    repeat_words: int = 10  #: words in a line from which its vocabulary is held against its length
    min_vocabulary: float = 0.15


#: Phrases of boilerplate in English, French, German and Spanish, as one pattern.
BOILERPLATE = (
    r"(?i)\b(all rights reserved|terms of (use|service)|privacy policy|cookie (policy|settings)|we use cookies"
    r"|enable javascript|javascript is disabled|click here|read more|sign (in|up)|log ?in|subscribe (now|to)|newsletter"
    r"|share (this|on)|follow us|back to top|skip to (main )?content|lorem ipsum|page not found)\b|©"
    r"|\b(tous droits r|mentions l.gales|politique de confidentialit|en savoir plus|lire la suite|se connecter|alle rechte vorbehalten"
    r"|datenschutzerkl|nutzungsbedingungen|mehr erfahren|jetzt anmelden|todos los derechos reservados|pol.tica de privacidad|iniciar sesi)"
)
#: The end of a line of prose: a mark, with quotes or brackets behind it.
ENDING = r"[.!?…:;。！？]['\x22»”’)\]]*[\x20\x09-\x0D]*\z"


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


#: Every character that a rule of ``line_fails`` counts.
_COUNTED = r"[#*$%&<>{}=~^_\\!?|»•·]"


def line_fails(line: Column, words: Column, cfg: LineRules) -> Column:
    """Whether the rules remove a line with words; both columns are read several times, so they should be bound."""
    n = F.greatest(F.size(words), F.lit(1))
    symbols, marks, links = _count(line, r"[#*$%&<>{}=~^_\\]"), _count(line, r"[!?]"), _count(line, "[|»•·]")
    return (
        # a line without any of the characters is read once for the three rules
        (
            line.rlike(_COUNTED)
            & (
                (symbols >= cfg.symbols_per_word * n)
                | ((n >= 3) & (marks >= cfg.marks_per_word * n))
                | ((links >= cfg.separators) & ((n - links) / (links + 1) <= cfg.words_per_link))
            )
        )
        | ((n <= cfg.stub_words) & (F.length(line) < cfg.stub_chars) & ~line.rlike(ENDING))
        | ((n >= cfg.repeat_words) & (F.size(F.array_distinct(words)) < cfg.min_vocabulary * n))
        | ((n <= cfg.boilerplate_words) & (_count(line, BOILERPLATE) >= cfg.boilerplate_share * F.length(line)))
    )


def clean(docs: DataFrame, cfg: LineRules = LineRules()) -> DataFrame:
    """``docs`` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, clean_text, lost.

    Generators between the steps keep Catalyst from inlining (and so repeating)
    the word array in the lambdas above it.
    """
    own = [c for c in docs.columns]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    step = docs.select("*", F.explode(F.array(F.struct(F.array_remove(F.split(text, _WS), "").alias("w"), F.split(text, "\n").alias("l"), text.alias("t")))).alias("__q1"))
    w = F.col("__q1.w")
    n = F.size(w)
    tri = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>"))
    split = F.transform(F.filter(F.col("__q1.l"), lambda x: x.rlike(_HAS_WORD)), lambda x: F.struct(x.alias("line"), F.array_remove(F.split(x, _WS), "").alias("words")))
    lines = F.transform(split, lambda x: F.struct(x["line"].alias("line"), line_fails(x["line"], x["words"], cfg).alias("bad")))
    step = step.select("*", F.explode(F.array(F.struct(tri.alias("h"), F.size(F.array_distinct(tri)).alias("d"), lines.alias("l")))).alias("__q2"))
    h = F.col("__q2.h")
    # only texts with a window found twice pay for the sort
    pairs = F.when(F.size(h) > F.col("__q2.d"), F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).otherwise(F.array().cast("array<struct<x:bigint,i:int>>"))
    step = step.select("*", F.explode(F.array(pairs)).alias("__q3"))
    p = F.col("__q3")
    same = lambda e, i: (F.get(p, i - 1)["x"] == e["x"]) | (F.get(p, i + 1)["x"] == e["x"])
    twice = F.array_sort(F.transform(F.filter(p, lambda e, i: F.coalesce(same(e, i), F.lit(False)) | F.coalesce(F.get(p, i + 1)["x"] == e["x"], F.lit(False))), lambda e: e["i"]))
    step = step.select("*", F.explode(F.array(twice)).alias("__q4"))
    q = F.col("__q4")
    covered = F.aggregate(F.transform(q, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(q, i + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    l = F.col("__q2.l")  # noqa: E741
    bad_chars = F.length(F.regexp_replace(F.array_join(F.transform(F.filter(l, lambda x: x["bad"]), lambda x: x["line"]), ""), _WS, ""))
    word_chars = F.length(F.array_join(w, ""))
    step = step.select(
        *own,
        F.col("__q1.t").alias("__t"),
        n.cast("long").alias("__n"),
        word_chars.cast("long").alias("__c"),
        _count(F.col("__q1.t"), SYMBOLS).cast("long").alias("__s"),
        (F.size(l) - F.size(F.array_distinct(F.transform(l, lambda x: x["line"])))).cast("long").alias("__d"),
        covered.cast("long").alias("__r"),
        bad_chars.cast("long").alias("__b"),
        F.array_join(F.transform(F.filter(l, lambda x: ~x["bad"]), lambda x: x["line"]), "\n").alias("__clean"),
        F.exists(l, lambda x: x["bad"]).alias("__any"),
    )
    failed = (F.col("__n") < cfg.min_words) | (100 * F.col("__r") > cfg.max_repeat_percent * F.col("__n"))
    made = {
        "n_words": F.col("__n"), "word_chars": F.col("__c"), "n_symbols": F.col("__s"), "n_dup_lines": F.col("__d"), "n_repeat_words": F.col("__r"),
        "base_failed": failed, "lost": F.coalesce(F.try_divide(F.col("__b"), F.col("__c")), F.lit(0.0)),
        "kept": ~failed & ~(F.col("__b") > cfg.max_lost * F.col("__c")),
        "clean_text": F.when(F.col("__any"), F.col("__clean")).otherwise(F.col("__t")),
    }
    return step.select(*[F.col(c) for c in own if c not in made], *[v.alias(k) for k, v in made.items()])
