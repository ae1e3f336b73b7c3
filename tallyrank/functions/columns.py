"""Column functions of the engine. All are built-in expressions; ``as_of`` is a date literal, never the clock."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyrank.functions import constants as K


def lit_array(values) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def strip(c: Column) -> Column:
    """Without white space at both ends (trim() takes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def strip_cheap(c: Column) -> Column:
    """As ``strip``, for columns that cost little: the search is made only where a first or last character may go."""
    return F.when(F.btrim(c, F.lit(" \t\n\x0b\f\r\u0085\u2028\u2029")) == c, c).otherwise(strip(c))


def word_count(c: Column) -> Column:
    """Words between white space; null and empty have none."""
    return F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\S+"), F.lit(0)))


def tokens(c: Column) -> Column:
    """Distinct words of three or more letters a-z; a word with another letter or digit in it is none."""
    whole = r"(?<![\p{L}\p{N}_])[a-z]{3,}+(?![\p{L}\p{N}_])"  # one compiled search; a lambda would be interpreted word by word
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(whole), F.lit(0)))


def query_tokens(c: Column) -> Column:
    return F.array_except(tokens(c), lit_array(K.STOP_WORDS))


def seniority_level(title: Column) -> Column:
    out = None
    for word, level in K.TITLE_LEVELS:
        has = F.lower(title).contains(word)
        out = F.when(has, level) if out is None else out.when(has, level)
    return out.otherwise(K.DEFAULT_LEVEL)


def parse_date(c: Column, as_of: date) -> Column:
    """A date from one of eight layouts; words for today, and text that is only quotes or space, give ``as_of``."""
    x = F.regexp_replace(strip(F.regexp_replace(F.regexp_replace(strip(c), '^"+|"+$', ""), "^'+|'+$", "")), r"^\s+|\s+$", "")
    month = F.array_position(lit_array(K.MONTHS), F.lower(F.substring(F.regexp_extract(x, r"([a-zA-Z]+)[,\s]+\d{4}$", 1), 1, 3)))
    year = F.regexp_extract(x, r"(\d{4})$", 1)
    day = F.regexp_extract(x, r"^(\d{1,2})\s", 1)
    made = lambda *parts: F.try_to_date(F.concat_ws("-", *parts), "yyyy-M-d")
    layouts = (
        (r"^\d{4}-\d{1,2}-\d{1,2}$", F.try_to_date(x, "yyyy-M-d")),
        (r"^\d{4}-\d{1,2}$", F.try_to_date(F.concat(x, F.lit("-1")), "yyyy-M-d")),
        (r"^\d{4}$", F.try_to_date(F.concat(x, F.lit("-1-1")), "yyyy-M-d")),
        (r"^\d{1,2}/\d{1,2}/\d{4}$", F.try_to_date(x, "M/d/yyyy")),
        (r"^\d{4}/\d{1,2}/\d{1,2}$", F.try_to_date(x, "yyyy/M/d")),
        (r"^\d{1,2}/\d{4}$", F.try_to_date(F.concat(F.lit("1/"), x), "d/M/yyyy")),
        (r"^[a-zA-Z]+[,\s]+\d{4}$", F.when(month > 0, made(year, month.cast("string"), F.lit("1")))),
        (r"^\d{1,2}\s+[a-zA-Z]+\s+\d{4}$", F.when(month > 0, made(year, month.cast("string"), day))),
    )
    out = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-M-d"))  # most dates; nothing to strip there
    out = out.when(F.coalesce(c, F.lit("")) == "", F.lit(None).cast("date")).when(F.lower(x).isin(*K.NOW_WORDS), F.lit(as_of))
    for pattern, value in layouts:
        out = out.when(x.rlike(pattern), value)
    return out


def active_days(last_active: Column, as_of: date) -> Column:
    """Days since ``last_active``; 999 where it is null or not year-month-day."""
    return F.coalesce(F.datediff(F.lit(as_of), F.try_to_date(last_active, "yyyy-M-d")), F.lit(999))


def freshness_score(last_active: Column, as_of: date) -> Column:
    days = active_days(last_active, as_of)
    base = F.greatest(F.lit(0.0), F.lit(1.0) - days / 365.0)
    return F.when(last_active.isNull(), 0.2).when(days < 0, 1.0).when(days <= 7, F.least(F.lit(1.0), base + 0.10)).otherwise(base)


def freshness_label(days: Column) -> Column:
    return F.when(days <= 7, K.STATES[0]).when(days <= 60, K.STATES[1]).otherwise(K.STATES[2])


def staleness(last_active: Column, days: Column) -> Column:
    return F.when(last_active.isNull(), "Profile activity unknown").when(days > 730, "No activity for over two years").when(days > 365, "No activity for over a year")


def duplicate_ratio(text: Column, size: int = 200) -> Column:
    """1 - distinct / all of the stretches of ``size`` characters; 1 for an empty text."""
    text = F.coalesce(text, F.lit(""))
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))  # one walk along the text
    return F.when(text == "", 1.0).otherwise(1.0 - F.size(F.array_distinct(parts)) / F.size(parts))


def filled(template: str, **parts: Column) -> Column:
    """A template with columns in its braces."""
    import re

    cut = re.split(r"{(\w+)}", template)
    return F.concat(*(parts[x] if i % 2 else F.lit(x) for i, x in enumerate(cut) if x))


def known_sector(sector: str | None) -> str:
    """A sector as the tables know it."""
    return (sector or "").upper().strip() or "TECH"


def education_bonus(education: Column, sector: str) -> Column:
    sector = known_sector(sector)
    sector_words = K.EDUCATION.get(sector, K.EDUCATION["TECH"])
    low = F.lower(F.coalesce(education, F.lit("")))
    has = F.exists(lit_array(sector_words), lambda w: F.contains(low, w))
    if sector in K.DEGREES:
        has = has | low.rlike(K.DEGREES[sector])
    return F.when(has, 5.0).otherwise(0.0)


def valid_name(name: Column, title: Column) -> Column:
    """False for generic names, titles, and names half of whose words hold a word of a job title."""
    clean = strip(F.regexp_replace(F.regexp_replace(strip(F.coalesce(name, F.lit(""))), '^"+|"+$', ""), "^'+|'+$", ""))
    low = F.lower(clean)
    words = F.filter(F.split(F.regexp_replace(low, r"[/|\-]", " "), r"\s+"), lambda w: w != "")
    titled = F.filter(words, lambda w: F.exists(lit_array(K.TITLE_WORDS), lambda t: F.contains(w, t)))
    bad = low.isin(*K.GENERIC_NAMES) | (F.size(words) == 0) | F.coalesce((title != "") & (low == strip(F.lower(title))), F.lit(False)) | clean.rlike(r"[/|]")
    return ~bad & (F.size(titled) / F.greatest(F.size(words), F.lit(1)) < 0.5)


def name_from_file(name: Column) -> Column:
    """A person's name from a file name: two to four words, or one of over two letters, that are no noise."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/\\]+)$", 1), r"\.[^.]*$", "")
    words = F.filter(F.split(F.lower(F.regexp_replace(stem, r"[_\-.\s]+", " ")), " "), lambda w: (w != "") & ~w.rlike(r"\d") & ~w.isin("resume", "cv", "profile", "final", "updated", "copy", "new", "latest"))
    named = F.array_join(F.transform(words, lambda w: F.initcap(w)), " ")
    return F.when((F.size(words).between(2, 4)) | ((F.size(words) == 1) & (F.length(named) > 2)), named)


def role_of(title: Column) -> Column:
    low, out = F.lower(title), None
    for role, words in K.ROLES:
        has = F.exists(lit_array(words), lambda w: F.contains(low, w))
        out = F.when(has, role) if out is None else out.when(has, role)
    return out.otherwise("Other")


def experience_band(years: Column) -> Column:
    return F.when(years < 2, K.BANDS[0]).when(years < 5, K.BANDS[1]).when(years < 8, K.BANDS[2]).otherwise(K.BANDS[3])


def activity_state(last_active: Column, as_of: date) -> Column:
    days = F.datediff(F.lit(as_of), F.when(last_active.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(last_active, "yyyy-MM-dd")))
    return F.coalesce(freshness_label(F.coalesce(days, F.lit(999))), F.lit(K.STATES[2]))


def years_span(start: Column, end: Column, as_of: date) -> Column:
    a, b = parse_date(start, as_of), F.coalesce(parse_date(end, as_of), F.lit(as_of))
    return F.when(a.isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), F.datediff(b, a) / 365.25))


def mask_key(c: Column) -> Column:
    n = F.char_length(c)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(c, 1, 4), F.repeat(F.lit("*"), n - 8), F.substring(c, -4, 4)))


def strip_fences(c: Column) -> Column:
    """Text without the code fence around it."""
    return strip(F.regexp_replace(F.regexp_replace(strip(c), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def plain_ascii(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"[^\x00-\x7F]", ""))


def sector_or_default(c: Column) -> Column:
    up = F.upper(strip(F.coalesce(c, F.lit(""))))
    return F.when(up.isin(*K.SECTORS), up).otherwise("TECH")


def sector_name(c: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in K.SECTORS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, c), F.lit("Specialist Domain"))


def norm(v: Column) -> Column:
    return F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), F.lit(1e-12))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot / (norm(a) * norm(b))


def progress(done: Column, failed: Column, total: Column, skipped: Column) -> Column:
    return F.when(total - skipped <= 0, 100).otherwise(F.least(F.lit(100), F.floor((done + failed) / F.greatest(total - skipped, F.lit(1)) * 100))).cast("int")
