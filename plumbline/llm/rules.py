"""Quality rules: a table of thresholds, compiled into one projection of built-in functions.

A rule bounds a measure, or the ratio of two, from below or above. Bounds are whole thousandths and ratios are compared
by products of whole numbers, so no rule depends on how a division is rounded. All measures of a text come from one array
of its words, one of its lines and a few searches; there is no shuffle and no user function.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import WORD
from plumbline.llm.spans import bound

#: Runs of white space between words.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Marks that stand around words without being part of them.
MARKS = ".,;:!?\"'()"
# Frequent words of English, German, French and Spanish.
STOP_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they you were their one all we can her has there been if more when will would who so no",
    "de": "der die das und ist nicht ein eine zu den von mit sich des auf im dem es als auch aus bei wie oder wird sind",
    "fr": "le la les de des et un une est que qui dans pour pas sur au aux par plus avec ce il elle ne se son sont",
    "es": "el los las del y en una es por con para su al lo como pero sus o este se no si más",
}


@dataclass(frozen=True)
class Rule:
    """``measure``, or its ratio to the measure ``per``, must lie in [low, high], in thousandths; None bounds nothing.

    A ratio to nothing holds: a text without words has no share of anything.
    """

    name: str
    measure: str
    per: str | None = None
    low: int | None = None
    high: int | None = None

    def broken(self, m: Column) -> Column:
        value, of = m[self.measure].cast("long") * 1000, m[self.per].cast("long") if self.per else F.lit(1).cast("long")
        outside = [value < of * self.low] * (self.low is not None) + [value > of * self.high] * (self.high is not None)
        return (of > 0) & reduce(Column.__or__, outside, F.lit(False))


#: The two rules that every reading of the table has.
BASE = [Rule("few_words", "n_words", low=50_000), Rule("repeated_words", "n_repeat_words", "n_words", high=500)]
RULES = [
    *BASE,
    Rule("word_length", "word_chars", "n_words", low=2_000, high=12_000),
    Rule("symbols", "n_symbols", "n_words", high=100),
    Rule("no_letters", "n_unlettered", "n_words", high=300),
    Rule("few_stop_words", "n_stop_words", "n_words", low=10),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=500),
    Rule("bullets", "n_bullets", "n_lines", high=900),
    Rule("broken_off", "n_ellipses", "n_lines", high=300),
]


def repeat_words(words: Column, window: int = 3) -> Column:
    """How many words stand in windows of ``window`` words that occur twice or more in the array, first ones included.

    Most texts have no two windows of equal hashes, and are done with that. In others the windows themselves are sorted with
    their places; those equal to a neighbour are repeats, whose places in turn tell how many words they cover together.
    """
    starts, own = F.sequence(F.lit(0), F.size(words) - window), lambda i: [F.get(words, i + k) for k in range(window)]
    alone = bound(F.transform(starts, lambda i: F.xxhash64(*own(i))), lambda h: F.size(F.array_distinct(h)) == F.size(h))
    windows = F.sort_array(F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *own(i)).alias("t"), i.alias("i"))))
    same = lambda s, x, k: F.coalesce(F.get(s, k)["t"] == x["t"], F.lit(False))
    repeated = lambda s: F.transform(s, lambda x, k: F.when(same(s, x, k + 1) | same(s, x, k - 1), x["i"]))
    places = bound(windows, lambda s: F.sort_array(F.filter(repeated(s), lambda i: i.isNotNull())))
    covers = lambda p: F.transform(p, lambda i, k: F.least(F.lit(window), F.coalesce(F.get(p, k + 1) - i, F.lit(window))))
    covered = bound(places, lambda p: F.aggregate(covers(p), F.lit(0), lambda a, n: a + n))
    return F.when((F.size(words) < window) | alone, F.lit(0)).otherwise(covered)


def measures(text: Column) -> Column:
    """A struct of all measures of a text, as longs; a null text is an empty one."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    stop = sorted(set(" ".join(STOP_WORDS.values()).split()))
    having = lambda items, of: F.size(F.filter(items, of))

    def of(x: Column) -> Column:
        t, words, lines = x["text"], x["words"], x["lines"]
        found = {
            "n_words": F.size(words),
            "word_chars": F.char_length(F.array_join(words, "")),
            "n_symbols": F.char_length(F.regexp_replace(t, f"[^{SYMBOLS}]++", "")),
            "n_lines": F.size(lines),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": repeat_words(words),
            "n_stop_words": having(words, lambda w: F.lower(F.btrim(w, F.lit(MARKS))).isin(stop)),
            "n_unlettered": having(words, lambda w: ~w.rlike(r"\p{L}")),
            "n_bullets": having(lines, lambda s: s.rlike(r"^[\x20\x09]*[-*•]")),
            "n_ellipses": having(lines, lambda s: s.rlike(r"(\.\.\.|…)[\x20\x09\x0D]*$")),
        }
        return F.struct(*[v.cast("long").alias(k) for k, v in found.items()])

    lines = F.filter(F.split(text, "\n", -1), lambda s: s.rlike(WORD))
    return bound(F.struct(text.alias("text"), F.array_remove(F.split(text, SPACE), "").alias("words"), lines.alias("lines")), of)


def judged(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text", out: str = "rules") -> DataFrame:
    """docs with a struct column ``out``: all measures, ``failed`` (names of the broken rules, in the table's order) and ``kept``.

    Words are runs without white space, lines are split at \\n and count if they have a word. A null text has no words, as
    an empty one, and so breaks a rule on the number of words. A column of docs named ``out`` is replaced; all others, and
    all rows, stay as they are, repeated ones too. Rows are judged on their own, in any order; an empty table stays empty.
    """
    rules = RULES if rules is None else rules
    failed = lambda m: F.array_compact(F.array(*[F.when(r.broken(m), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    names = [f.strip() for f in MEASURES]
    verdict = lambda m: bound(failed(m), lambda f: F.struct(*[m[c].alias(c) for c in names], f.alias("failed"), (F.size(f) == 0).alias("kept")))
    return docs.withColumn(out, bound(measures(F.col(text_col)), verdict))


MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_unlettered", "n_bullets", "n_ellipses"]


def kept(docs: DataFrame, rules: list[Rule] | None = None, text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, that break no rule; see ``judged`` for nulls, repeats and empty tables."""
    from plumbline.llm.common import free

    own = free("rules", docs)
    return judged(docs, rules, text_col, own).where(F.col(own)["kept"]).drop(own)
