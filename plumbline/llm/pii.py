"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

DataFrame functions alone. Patterns that repeat a group without a bound do so possessively, which gives the same matches
(nothing follows that could take characters back) without deep recursion on long runs; those that start with a run look
behind for its first character or the end of the last match, so that long runs are read once. IBANs have the size of
their country.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.spans import CHUNK, NONE, before, bound, found, ordered

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
#: Runs of fewer than 12 digits are no cards; a cheap search for more comes first.
CARD_LONG = r"[0-9](?:[\x20-]?[0-9]){11}"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Characters of an IBAN by country, from the registry; what follows one is no part of it, even if it could be.
IBAN_SIZES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_OF_SIZE = "|".join(rf"(?:{'|'.join(names.split())})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}+" for n, names in IBAN_SIZES.items())
_LISTED = rf"(?:{'|'.join(' '.join(IBAN_SIZES.values()).split())})[0-9]{{2}}"
#: Of other countries, the longest run that ends at a blank or mark and before an IBAN of those above.
IBAN = rf"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{_OF_SIZE}|(?!{_LISTED})[A-Z]{{2}}[0-9]{{2}}(?:(?!\x20{_LISTED})\x20?[A-Z0-9]){{11,30}})(?![A-Za-z0-9])"
BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban"]
#: Characters on either side in which context words count, the words, and the scores.
NEAR = 40
CONTEXT = {
    "email": r"(?i)\b(e-?mail|mail|contact|write|reach|courriel|correo)\b",
    "ip": r"(?i)\b(ip|host|server|address|login|addr)\b",
    "card": r"(?i)\b(card|visa|mastercard|credit|debit|karte|carte|tarjeta|payment)\b",
    "phone": r"(?i)\b(phone|tel|call|mobile|fax|telefon|t[eé]l[eé]phone|tel[eé]fono)\b",
    "iban": r"(?i)\b(iban|bank|account|konto|compte|cuenta|transfer)\b",
}
SCORE = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.5, "iban": 0.8}
BONUS = 0.2


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(text: Column) -> Column:
    """True if the digits of a string pass Luhn's check."""
    one = F.transform(F.split(F.reverse(digits(text)), ""), lambda c, i: F.when(i % 2 == 0, F.ascii(c) - 48).otherwise((F.ascii(c) - 48) * 2))
    return F.aggregate(one, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def mod_97(text: Column) -> Column:
    """True if an IBAN's check digits are right: letters count 10 to 35, the first four characters go last."""
    plain = F.regexp_replace(text, r"\x20", "")
    moved = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    value = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    rest = F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)
    return F.char_length(plain).between(15, 34) & (rest == 1)


def _spans(text: Column, near: int) -> Column:
    """The spans of a text, as ``scan`` describes them."""
    n = lambda s: F.char_length(digits(s["text"]))
    bare = lambda p: F.ltrim(p, F.lit("0"))
    small = lambda s: F.forall(F.split(s["text"], r"\."), lambda p: (F.char_length(bare(p)) <= 3) & (F.lpad(bare(p), 3, "0") <= "255"))
    none = F.array().cast(NONE)
    card = F.when(text.rlike(CARD_LONG), found(text, "card", CARD, near, lambda s: n(s).between(12, 19) & luhn(s["text"]))).otherwise(none)
    iban = F.when(text.rlike(IBAN), found(text, "iban", IBAN, near, lambda s: mod_97(s["text"]))).otherwise(none)
    more = lambda cards: F.filter(iban, lambda m: ~F.exists(cards, lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    rest = F.concat(found(text, "email", EMAIL, near), found(text, "ip", IP, near, small), found(text, "phone", PHONE, near, lambda s: n(s).between(9, 15)))

    def scored(s: Column) -> Column:
        score = F.lit(0.0)
        for kind in KINDS:
            score = F.when(s["kind"] == kind, F.lit(SCORE[kind]) + F.when(s["near"].rlike(CONTEXT[kind]), BONUS).otherwise(0.0)).otherwise(score)
        return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), score.alias("score"))

    return F.transform(ordered(bound(card, lambda cards: F.concat(rest, cards, more(cards))), KINDS), scored)


def scan(docs: DataFrame, text_col: str = "text", near: int = NEAR) -> DataFrame:
    """docs with a column ``pii``: an array of (kind, start, end, text, score), by start and kind.

    Kinds: email, ip (each part at most 255), card (12 to 19 digits that pass Luhn's check), phone (9 to 15 digits), and
    iban, which the method adds (mod 97, and no overlap with a card). Matches that fail are dropped, not tried again in
    another place. start counts code points from 0, end is exclusive. The score is the kind's own, and more if a context
    word stands within ``near`` characters, after the span up to the second next match of the kind; no span is dropped for its score. A null text has none, as an empty one. A
    column of docs named ``pii`` is replaced; all others, and all rows, stay as they are.
    """
    return docs.withColumn("pii", _spans(F.coalesce(F.col(text_col).cast("string"), F.lit("")), near))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; a span within or across an earlier one goes with it.

    What stands between is cut from stretches of ``CHUNK`` spans, as finding a place in a long text reads all before it.
    """

    def of(s: Column) -> Column:
        ends = F.transform(s, lambda x: x["end"])
        upto = before(ends, F.lit(0), lambda a, e: F.greatest(a, e))
        runs = F.filter(F.zip_with(s, upto, lambda x, a: F.struct(a.alias("a"), x["start"].alias("b"), x["kind"].alias("kind"))), lambda r: r["a"] <= r["b"])
        parts = lambda r: F.transform(F.sequence(F.lit(0), F.floor((F.size(r) - 1) / CHUNK).cast("int")), lambda k: bound(F.slice(r, k * CHUNK + 1, CHUNK), stretch))
        return F.concat(F.array_join(bound(runs, parts), ""), F.substr(text, F.array_max(ends) + 1, F.char_length(text)))

    def stretch(r: Column) -> Column:
        low, high = F.get(r, F.lit(0))["a"], F.get(r, F.size(r) - 1)["b"]
        own = F.struct(low.alias("low"), F.substr(text, low + 1, high - low).alias("text"))
        return bound(own, lambda o: F.array_join(F.transform(r, lambda x: F.concat(F.substr(o["text"], x["a"] - o["low"] + 1, x["b"] - x["a"]), F.lit("<"), F.upper(x["kind"]), F.lit(">"))), ""))

    text = F.coalesce(text, F.lit(""))
    return F.when(F.size(spans) == 0, text).otherwise(bound(spans, of))


def masking(docs: DataFrame, text_col: str = "text", near: int = NEAR) -> DataFrame:
    """docs with every span of personal data replaced by its kind; texts without any, and null texts, stay as they are."""
    text = F.col(text_col).cast("string")
    new = bound(_spans(F.coalesce(text, F.lit("")), near), lambda s: F.when(F.size(s) > 0, masked(text, s)).otherwise(text))
    return docs.withColumn(text_col, new)
