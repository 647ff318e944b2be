"""Secret scans: known shapes, and strings of high entropy, in DataFrame functions alone.

A candidate is a long run of the characters that keys are written in. A window slides over it; its Shannon entropy is
kept up to date from counts, of which each step changes two: the character that leaves and the one that comes in. The
counts are five bits each in a few numbers, so a step costs the same whatever the alphabet and a candidate's length.
Windows at or above the threshold of their own character class are joined to a span, so that a name or mark before a
secret doesn't raise it. Candidates that an allow-list knows as harmless as a whole are left out, and so are windows within
a window's size of what it knows; a secret that goes on beyond stays.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.spans import before, bound, found, ordered

# The base patterns, with letters in either case spelled out, and their least sizes.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE = ["assign", "access", "hex"]
#: Candidates, the window, and the least bits a character of a window by character class.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
BITS = {"hex": 3.0, "alnum": 3.7, "base64": 3.9}
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: UUIDs, paths and names made of words, runs of one character, alphabets, and what stands for a secret in examples.
#: Groups repeat possessively: Java's other loops over groups go one call deeper with every turn.
ALLOWED = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"^[/_=+-]*+(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]{1,4})(?:[/_=+-]++(?:[A-Z]?[a-z]++|[A-Z]++|[0-9]{1,4}))*+[/_=+-]*+$",
    r"^[0-9]+$",
)
HARMLESS = r"(?i:example|placeholder|changeme|dummy|redacted|your[_-]?(?:key|token|secret)|abcdefghij|0123456789|1234567890|qwertyuiop)|(?<c>.)\k<c>{7,}"
#: Counts of a number, and their bits.
PER, BITS_EACH = 12, 5


def masked(text: Column, around: int) -> Column:
    """The text with blanks for whatever is harmless in it and for ``around`` characters before and after, of the same length."""
    own = F.struct(F.split(text, HARMLESS, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(HARMLESS), F.lit(0)).alias("hits"))
    blank = lambda n: F.repeat(F.lit(" "), n)

    def pieces(s: Column) -> Column:
        def gap(g: Column, k: Column) -> Column:
            size = F.char_length(g)
            head = F.when(k > 0, F.least(F.lit(around), size)).otherwise(0)
            tail = F.when(k < F.size(s["hits"]), F.least(F.lit(around), size - head)).otherwise(0)
            hit = F.coalesce(blank(F.char_length(F.get(s["hits"], k))), F.lit(""))
            return F.concat(blank(head), F.substr(g, head + 1, size - head - tail), blank(tail), hit)

        return F.array_join(F.transform(s["gaps"], gap), "")

    return F.when(text.rlike(HARMLESS), bound(own, pieces)).otherwise(text)


def high_windows(text: Column, bits: Column | None = None, window: int = WINDOW) -> Column:
    """(first, last): the first and the last window, by its last character from 1, of at least ``bits``; 0 if none.

    Without ``bits``, those of the smallest class that holds all characters of the window: hex, alnum or base64; windows
    of digits alone are none, and none with a character that the alphabet lacks. The state has where the last character
    outside of each class stands.

    The entropy of n characters is log2(n) - sum(c log2 c) / n over the counts c. The state has the count of each
    character of the alphabet, and that sum in millionths, so that it stays exact; a step changes two counts.
    """
    if window >= 1 << BITS_EACH:
        raise ValueError(f"a window has {(1 << BITS_EACH) - 1} characters at most")
    words = range(-(-len(ALPHABET) // PER))
    table = F.array(*[F.lit(round(c * math.log2(c) * 1e6) if c else 0) for c in range(window + 2)])
    codes = F.transform(F.split(text, ""), lambda c: F.position(c, F.lit(ALPHABET)))
    most = lambda b: F.lit(round(window * math.log2(window) * 1e6)) - b * (window * 1e6)
    # Places in the alphabet, from 1, of: lower-case hex, upper-case hex, letters and digits, digits, any.
    digit = lambda c: c.between(53, 62)
    classes = {"known": lambda c: c > 0} | ({"low": lambda c: c.between(27, 32) | digit(c), "up": lambda c: c.between(1, 6) | digit(c), "alnum": lambda c: c <= 62, "digit": digit} if bits is None else {})
    zero = F.struct(*[F.lit(0).cast("long").alias(f"c{w}") for w in words], F.lit(0).alias("sum"), F.lit(0).alias("first"), F.lit(0).alias("last"), *[F.lit(0).alias(k) for k in classes])
    word, shift = (lambda c: F.floor((c - 1) / PER).cast("int")), (lambda c: F.pmod(c - 1, F.lit(PER)) * BITS_EACH)

    def count(s: Column, c: Column) -> Column:
        held = reduce(lambda out, w: out.when(word(c) == w, s[f"c{w}"]), words, F.when(F.lit(False), F.lit(0).cast("long")))
        return F.call_function("shiftright", held, shift(c)).bitwiseAND(F.lit((1 << BITS_EACH) - 1)).cast("int")

    # The state is copied at every step, so it holds no list.
    def pairs(c: Column) -> Column:
        return F.transform(c, lambda x, i: F.struct(x.alias("come"), F.coalesce(F.get(c, F.when(i >= window, i - window)), F.lit(0)).alias("gone"), (i + 1).alias("i")))

    def step(s: Column, x: Column) -> Column:
        return bound(F.struct(x["come"].alias("come"), x["gone"].alias("gone"), count(s, x["come"]).alias("more"), count(s, x["gone"]).alias("less")), lambda y: after(s, x["i"], y))

    def after(s: Column, i: Column, x: Column) -> Column:
        come, gone, same = x["come"], x["gone"], x["come"] == x["gone"]
        gain = F.when(come > 0, F.get(table, x["more"] + 1) - F.get(table, x["more"])).otherwise(0)
        loss = F.when(gone > 0, F.get(table, x["less"] - 1) - F.get(table, x["less"])).otherwise(0)
        total = s["sum"] + F.when(same, F.lit(0)).otherwise(gain + loss)
        one = lambda c, w: F.when((c > 0) & (word(c) == w), F.call_function("shiftleft", F.lit(1).cast("long"), shift(c))).otherwise(F.lit(0).cast("long"))
        counts = [F.when(same, s[f"c{w}"]).otherwise(s[f"c{w}"] + one(come, w) - one(gone, w)).alias(f"c{w}") for w in words]
        out = {k: F.when(of(come), s[k]).otherwise(i) for k, of in classes.items()}
        within = {k: i - v >= window for k, v in out.items()}
        if bits is None:
            least = F.when(within["low"] | within["up"], most(F.lit(BITS["hex"]))).when(within["alnum"], most(F.lit(BITS["alnum"]))).otherwise(most(F.lit(BITS["base64"])))
            high = within["known"] & ~within["digit"] & (total <= least)
        else:
            high = within["known"] & (total <= most(bits))
        first = F.when(high & (s["first"] == 0), i).otherwise(s["first"])
        return F.struct(*counts, total.alias("sum"), first.alias("first"), F.when(high, i).otherwise(s["last"]).alias("last"), *[v.alias(k) for k, v in out.items()])

    return F.aggregate(bound(codes, pairs), zero, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def entropy_spans(text: Column, window: int = WINDOW) -> Column:
    """Spans of kind ``entropy``: from the first to the last high window of each candidate that no allow-list knows."""
    allowed = lambda t: reduce(Column.__or__, [t.rlike(p) for p in ALLOWED])
    seen = F.transform(found(text, "entropy", CANDIDATE, 0, lambda s: ~allowed(s["text"])), lambda s: F.struct(s["start"].alias("at"), s["text"].alias("text"), bound(masked(s["text"], window), lambda t: high_windows(t, None, window)).alias("w")))
    seen = F.filter(seen, lambda s: s["w"]["last"] > 0)
    return F.transform(seen, lambda s: F.struct(F.lit("entropy").alias("kind"), (s["at"] + s["w"]["first"] - window).alias("start"), (s["at"] + s["w"]["last"]).alias("end"), F.substr(s["text"], s["w"]["first"] - window + 1, s["w"]["last"] - s["w"]["first"] + window).alias("text"), F.lit("").alias("near")))


def beyond(spans: Column, base: Column, window: int = WINDOW) -> Column:
    """What of the spans no base span covers, in stretches of a window or more."""

    def rest(m: Column) -> Column:
        cuts = F.array_sort(F.transform(F.filter(base, lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"])), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
        piece = lambda a, e: F.when(e - a >= window, F.struct(m["kind"].alias("kind"), a.alias("start"), e.alias("end"), F.substr(m["text"], a - m["start"] + 1, e - a).alias("text"), m["near"].alias("near")))
        ends = F.concat(F.transform(cuts, lambda c: c["start"]), F.array(m["end"]))
        # A stretch goes from the furthest end so far to the next start.
        upto = before(F.transform(cuts, lambda c: c["end"]), m["start"], lambda a, n: F.greatest(a, n))
        last = F.greatest(m["start"], F.coalesce(F.array_max(F.transform(cuts, lambda c: c["end"])), m["start"]))
        starts = F.concat(upto, F.array(last))
        return F.array_compact(F.zip_with(starts, ends, piece))

    return F.flatten(F.transform(spans, rest))


def scan(docs: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with a column ``secrets``: an array of (kind, start, end, text), by start and kind.

    Kinds: assign (a name such as password, and a value of 6 characters or more), access (20 or more), hex (24 or more),
    and entropy for what the method adds, as far as it lies beyond the others. start counts code points from 0, end is
    exclusive. Each kind takes leftmost matches that don't overlap; kinds may overlap each other. A null text has none,
    as an empty one. A column of docs named ``secrets`` is replaced; all others, and all rows, stay as they are.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    long_enough = lambda s: F.char_length(F.regexp_extract(s["text"], ASSIGN, 2)) >= 6
    base = F.concat(found(text, "assign", ASSIGN, 0, long_enough), found(text, "access", ACCESS), found(text, "hex", HEX))
    more = lambda b: beyond(entropy_spans(text, window), b, window)
    spans = bound(base, lambda b: ordered(F.concat(b, more(b)), [*BASE, "entropy"]))
    return docs.withColumn("secrets", F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"))))
