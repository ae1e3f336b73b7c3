"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, kind by kind: leftmost, not overlapping within a kind. Validators confirm them: Luhn's sum for
cards, the remainder by 97 for account numbers, ranges for addresses and registration numbers. Words nearby adjust a span's
score: a national phone number counts beside a word for it only.

A text's matches and the gaps between them come from one expression and are zipped, so that a place is a sum of lengths and
a context is the end or the beginning of a gap. Every expression is linear in the text (possessive, anchored at the ends of runs), and
nothing is moved between tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points of a gap that count as nearby, the score from which a proposed span is kept, and what a word nearby adds.
NEAR, LEAST, BESIDE = 40, 0.5, 0.4
#: Matches whose lengths are summed together; places are summed in two steps, by block and within.
BLOCK = 128

# fixed values: length of an account number (IBAN) by country
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}


@dataclass(frozen=True)
class Kind:
    """``pattern`` proposes, ``valid`` confirms a match, ``words`` (an expression over lower-case text) are looked for nearby. ``gate``: text
    that every match holds, or an expression for it, looked for first. Base kinds are kept whatever their score."""

    name: str
    pattern: str
    valid: Callable[[Column], Column]
    words: str
    score: float
    base: bool = False
    gate: str = ""


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def luhn(c: Column) -> Column:
    """Whether a text of digits passes Luhn's check: from the right, every second digit doubled."""
    turned = F.reverse(c)
    value = lambda i: F.substr(turned, i, F.lit(1)).cast("int")
    fold = lambda v, i: F.when(i % 2 == 0, F.when(v > 4, v * 2 - 9).otherwise(v * 2)).otherwise(v)
    return F.aggregate(F.sequence(F.lit(1), F.length(c)), F.lit(0), lambda a, i: a + fold(value(i), i)) % 10 == 0


def mod97(c: Column) -> Column:
    """Whether an account number's remainder by 97 is 1: its first four characters go last, letters count from 10."""
    whole = F.concat(F.substr(c, F.lit(5)), F.substr(c, F.lit(1), F.lit(4)))
    value = lambda i: F.conv(F.substr(whole, i, F.lit(1)), 36, 10).cast("int")
    return F.aggregate(F.sequence(F.lit(1), F.length(c)), F.lit(0), lambda a, i: (a * F.when(value(i) > 9, 100).otherwise(10) + value(i)) % 97) == 1


def _between(c: Column, low: int, high: int) -> Column:
    return F.length(digits(c)).between(low, high)


def _card(c: Column) -> Column:
    return F.when(_between(c, 14, 19), luhn(digits(c))).otherwise(False)


def _iban(c: Column) -> Column:
    return mod97(F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", "")))


_BYTE = "0*+(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5]|(?<=0))"
_IBAN = "|".join(f"(?:{'|'.join(codes.split())})[0-9]{{2}}(?:[ -]?[A-Za-z0-9]){{{n - 4}}}+" for n, codes in IBAN_LENGTHS.items())
_PHONE_WORDS = r"phone|\btel|call|mobile|\bcell|\bfax|whatsapp|\bsms\b|telefon|handy|anruf|rufnummer|tél|portable|teléf|móvil|llam"
KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda c: F.lit(True), r"mail|contact|write|kontakt|contacto|correo|courriel", 0.6, True, "@"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda c: c.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"), r"\bip\b|address|host|server|login|adresse|dirección", 0.5, True, "[0-9]"),
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", _card, r"card|visa|master|amex|credit|debit|karte|carte|tarjeta", 0.6, True, "[0-9]"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda c: _between(c, 10, 15), _PHONE_WORDS, 0.6, True, "+"),
    # beyond the base: account numbers, registration numbers, cards in a longer run of numbers, national phone numbers
    Kind("iban", rf"(?i:(?<![A-Za-z0-9])(?:{_IBAN})(?![A-Za-z0-9]))", _iban, r"iban|account|bank|konto|compte|cuenta", 0.6, gate="[A-Za-z]{2}[0-9]{2}"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda c: ~c.rlike("^(?:000|666|9)|-00-|-0000$"), r"ssn|social|security|tax", 0.5, gate="[0-9]-[0-9]{2}-[0-9]"),
    Kind("card", r"(?<![0-9])[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])", _card, r"card|visa|master|amex|credit|debit|karte|carte|tarjeta", 0.3, gate="[0-9]{4}[\x20-][0-9]{4}"),
    Kind("phone", r"(?<![0-9A-Za-z+.(-])(?:\([0-9]{2,5}\)\x20?|[0-9]{2,5}[\x20./-])[0-9](?:[\x20.-]?[0-9]){5,10}+(?![0-9A-Za-z])", lambda c: _between(c, 9, 12), _PHONE_WORDS, 0.2, gate="[0-9][\x20.-]?[0-9]{2}"),
)

SPAN = "array<struct<start:int,kind:int,end:int,score:double,base:boolean>>"


def located(text: Column, pattern: str) -> Column:
    """array<struct<text, start, end, before, after>> of the matches; before and after are the ``NEAR`` code points of the gaps around."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.struct(F.char_length(g).alias("n"), F.right(g, F.lit(NEAR)).alias("tail"), F.left(g, F.lit(NEAR)).alias("head")))
    zipped = F.arrays_zip(gaps.alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    size = lambda x: x["g"]["n"] + F.coalesce(F.char_length(x["m"]), F.lit(0))
    summed = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + size(x))

    def block(own: Column, first: Column, whole: Column, at: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            end = at + summed(F.slice(own, F.lit(1), i + 1))
            return F.struct(x["m"].alias("text"), (end - F.coalesce(F.char_length(x["m"]), F.lit(0))).alias("start"), end.alias("end"), x["g"]["tail"].alias("before"), F.get(whole, first + i + 1)["g"]["head"].alias("after"))

        return F.transform(own, one)

    def places(z: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / BLOCK).cast("int")), lambda b: F.struct((b * BLOCK).alias("first"), F.slice(z, b * BLOCK + 1, F.lit(BLOCK)).alias("own")))

        def with_starts(blocks: Column) -> Column:
            before = F.aggregate(blocks, F.array(F.lit(0)), lambda a, b: F.concat(a, F.array(F.element_at(a, -1) + summed(b["own"]))))
            return F.flatten(F.zip_with(blocks, F.slice(before, F.lit(1), F.size(blocks)), lambda b, at: block(b["own"], b["first"], z, at)))

        return let(cut, with_starts)

    return F.filter(let(zipped, places), lambda x: x["text"].isNotNull())


def spans_of(text: Column, kind: Kind, order: int) -> Column:
    """The confirmed spans of a kind, with their scores."""
    beside = lambda x: F.lower(F.concat_ws(" ", x["before"], x["after"])).rlike(kind.words)
    confirmed = F.filter(located(text, kind.pattern), lambda x: kind.valid(x["text"]))
    scored = F.transform(confirmed, lambda x: F.struct(x["start"].alias("start"), F.lit(order).alias("kind"), x["end"].alias("end"), (F.lit(kind.score) + F.when(beside(x), BESIDE).otherwise(0.0)).alias("score"), F.lit(kind.base).alias("base")))
    scored = F.filter(scored, lambda s: s["base"] | (s["score"] >= LEAST)).cast(SPAN)
    gate = F.contains(text, F.lit(kind.gate)) if len(kind.gate) == 1 else text.rlike(kind.gate)
    return F.when(gate, scored).otherwise(F.array().cast(SPAN))


def find_spans(docs: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with ``out``, array<struct<start, kind, end, score, base>> in order of start, then kind (its place in ``KINDS``), code points and
    ``end`` exclusive. A column named like ``out`` is replaced; null texts are empty.

    Base kinds stay whatever stands around them, and may overlap one another. A span that the other kinds add goes where the one before or
    after it, by start, overlaps it.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    ordered = F.array_sort(F.concat(*(spans_of(whole, kind, i) for i, kind in enumerate(KINDS))))
    clear = lambda s, x: F.coalesce((x["end"] <= s["start"]) | (x["start"] >= s["end"]), F.lit(True))
    alone = lambda z: F.filter(z, lambda s, i: s["base"] | (clear(s, F.get(z, i - 1)) & clear(s, F.get(z, i + 1))))
    return docs.withColumn(out, let(ordered, alone))


def told(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    name = lambda s: F.element_at(F.array(*(F.lit(k.name) for k in KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans, top_score) of every row: base spans by kind, the SHA-256 of their
    list, the list of all spans, and the highest score, ``top_score`` (null without spans). Null and empty texts have none; repeated rows are told
    each time; other columns are left out."""
    found = find_spans(docs.select(F.col(key), F.col(text).alias("__text")), "__text", "__spans")
    base = F.filter("__spans", lambda s: s["base"])
    count = lambda i: F.size(F.filter("__spans", lambda s: s["base"] & (s["kind"] == i))).cast("long")
    counts = [count(i).alias(f"n_{k.name}") for i, k in enumerate(KINDS) if k.base]
    return found.select(key, *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("__spans")).alias("spans"), F.array_max(F.transform("__spans", lambda s: s["score"])).alias("top_score"))
