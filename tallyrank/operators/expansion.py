"""Query expansion and requirements without a language model, and the protocols by which models can be plugged in."""

from __future__ import annotations

import re
from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyrank.functions import columns as C
from tallyrank.functions import constants as K


class RequirementsProvider(Protocol):
    def requirements(self, text: str, sector: str) -> dict: ...


class QueryExpander(Protocol):
    def expand(self, text: str, seniority: str) -> str: ...


class ResumeParser(Protocol):
    def parse(self, texts: list[str]) -> list[dict]: ...


class OcrBackend(Protocol):
    def boxes(self, page: bytes) -> list[dict]: ...


def has_word(word: str, text: str) -> bool:
    return re.search(rf"(?<!\w){re.escape(word)}(?!\w)", text) is not None


def domains(text: str) -> list[str]:
    low = text.lower()
    return [d for d, words in K.DOMAIN_WORDS.items() if any(has_word(w, low) for w in words)] or ["Backend"]


def expand(text: str, seniority: str = "Senior") -> str:
    """Lines for each domain of a role description, for the seniority's behaviour, and for the named technologies
    (as written, once each, sorted)."""
    lines = []
    for d in domains(text):
        lines += [f"Domain: {d}", *(f"{title}: {', '.join(terms)}" for title, terms in zip(K.TERM_TITLES, K.DOMAIN_TERMS[d], strict=True))]
    level = seniority.title()
    signals = K.BEHAVIOUR["Lead"] + K.BEHAVIOUR["Senior"] if level in ("Lead", "Principal") else K.BEHAVIOUR["Senior" if level == "Senior" else "Junior"]
    lines.append(f"Behavioral & Seniority Signals ({level}): {', '.join(signals)}")
    named = sorted(set(re.findall(rf"\b({'|'.join(map(re.escape, K.TECH_STACK))})\b", text, re.IGNORECASE)))
    return "\n".join([*lines, f"Core Tech Stack: {', '.join(named)}"] if named else lines)


def requirements(text: str, sector: str, most: int = 30) -> dict:
    """The offline requirements: the text, a known sector or TECH, and its first words of three letters."""
    up = (sector or "").upper().strip()
    words = list(dict.fromkeys(w for w in re.split(r"[^\w]+", text.lower()) if re.fullmatch("[a-z]{3,}", w)))
    return {"polished_requirements": text, "sector_token": up if up in K.SECTORS else "TECH", "top_keywords": words[:most]}


def first_words(text: Column, most: int = 30) -> Column:
    return F.slice(C.tokens(text), 1, most)


def domain_flags(text: Column) -> Column:
    """The domains of a description, as a column, for many descriptions at once. A text is cut into words once; only terms that are no single
    word are searched for, and by a pattern only where they stand at all."""
    low = F.lower(text)
    found = []
    words = F.array_distinct(F.split(low, r"[^\p{L}\p{N}_]+"))
    for domain, terms in K.DOMAIN_WORDS.items():
        single = [w for w in terms if re.fullmatch("[a-z]+", w)]
        hit = F.arrays_overlap(words, C.lit_array(single))
        for w in (w for w in terms if w not in single):
            hit = hit | (F.contains(low, F.lit(w)) & low.rlike(rf"(?<![\p{{L}}\p{{N}}_]){re.escape(w)}(?![\p{{L}}\p{{N}}_])"))
        found.append(F.when(hit, F.lit(domain)))
    named = F.filter(F.array(*found), lambda d: d.isNotNull())
    return F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("Backend")))
