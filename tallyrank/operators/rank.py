"""A role description ranked over a pool in one call: requirements, expansion, prefilter, fragments, scores, order.

Models come in by the protocols of ``expansion``; without them the offline defaults are used. Nothing is collected but
the prefilter's counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyrank.functions import constants as K
from tallyrank.operators import chunking, copilot, expansion, order, vectors
from tallyrank.operators.prefilter import KEYWORD_SCORES, best_of
from tallyrank.operators.score import Request, attach_scores, prepared, score
from tallyrank.sources.store import written


#: Tells the rows of a pool apart while it is ranked.
ROW = "__row"


@dataclass(frozen=True)
class Ranked:
    """The rows by rank, the request they were scored by, the expanded query and the sector that was decided on."""

    rows: DataFrame
    request: Request
    expanded: str
    sector: str


def encoder_of(sector: str | None) -> str:
    """The encoder that fragments of a sector are routed to."""
    return K.ENCODERS.get((sector or "").upper(), K.OTHER_ENCODER)


def encoder_column(sector: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in K.ENCODERS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.upper(sector)), F.lit(K.OTHER_ENCODER))


def with_id(rows: DataFrame) -> DataFrame:
    """Adds ``id``, the other name of candidate_id."""
    return rows.withColumn("id", F.col("candidate_id"))


def find(pool: DataFrame, wanted: str) -> DataFrame:
    """The first candidate that has the id under either name; LookupError where none has."""
    names = [c for c in ("candidate_id", "id") if c in pool.columns]
    hit = F.lit(False)
    for c in names:
        hit = hit | F.coalesce(F.col(c) == wanted, F.lit(False))
    found = pool.filter(hit).orderBy(*names).limit(1)
    if not found.take(1):
        raise LookupError(f"no candidate {wanted}")
    return found


def asked(description: str) -> str:
    if not description.strip():
        raise ValueError("the role description is empty")
    return description


def semantic_scores(pool: DataFrame, query: str, embed: Callable[[Column], Column] = vectors.embed, embed_query: Callable[[str], list[float]] | None = None, key: str = "candidate_id") -> DataFrame:
    """(candidate_id, best, unified): every resume in fragments, all vectors centred, the best cosine to the query. ``key`` tells rows apart.
    Fragments are cut and embedded once; the mean and the cosines read what was written."""
    vector = embed_query(query) if embed_query else vectors.hashed_vectors([query])[0].tolist()
    parts = written(chunking.fragments(pool, key).select(key, embed(F.col("fragment")).alias("embedding")), "fragments")
    best = vectors.best_fragment(vectors.centred_cosine(parts, vector), key)
    return vectors.unified_score(pool.join(best, key)).select("candidate_id", "best", "unified")


def rank(pool: DataFrame, description: str, seniority: str = "Senior", sector: str = "TECH", as_of: date | None = None, top: int | None = None, weights: tuple[float, float, float] = (0.60, 0.25, 0.15), provider=None, expander=None, embed=vectors.embed, embed_query=None) -> Ranked:
    """The whole pool (or its ``top`` rows) scored for a description and numbered; rows carry ``id`` too.

    ``provider`` and ``expander`` stand for models (see ``expansion``). ``as_of`` must be given: the clock is not read.
    """
    if as_of is None:
        raise ValueError("as_of must be given")
    told = (provider.requirements if provider else expansion.requirements)(asked(description), sector)
    expanded = (expander.expand if expander else expansion.expand)(description, seniority)
    request = Request(f"{description} {expanded}", tuple(told["top_keywords"]), as_of, seniority, told["sector_token"], weights)
    # ids may repeat; what scores take from texts and histories is worked out once, where the pool is written
    pool = written(prepared(pool.withColumn(ROW, F.monotonically_increasing_id()), request), "rank-pool")
    chosen = written(best_of(pool), "chosen")
    pool = pool.drop(*KEYWORD_SCORES)
    scores = semantic_scores(chosen, told["polished_requirements"], embed, embed_query, ROW)
    rows = written(score(attach_scores(pool, scores), request), "scored")
    keys = order.rank_total(rows.select(ROW, "candidate_id", "final_score", "freshness_score"), top).select(ROW, "rank")
    return Ranked(with_id(rows.join(keys, ROW).drop(ROW)), request, expanded, told["sector_token"])


def similar(pool: DataFrame, wanted: str, as_of: date, most: int = 10, **how) -> tuple[DataFrame, str]:
    """(rows by rank, the description asked with): the candidates nearest to one, ranked for a description of its title and
    skills; the candidate is left out."""
    pool = written(pool, "similar-pool")  # it is searched, and then ranked
    own = find(pool, wanted)
    told = own.select("candidate_id", copilot.similar_request(F.coalesce("current_title", F.lit("Software Engineer")), F.coalesce("skills_listed", F.array().cast("array<string>"))).alias("d")).first()
    ranked = rank(pool, told["d"], as_of=as_of, top=50, **how).rows
    return ranked.filter(F.col("candidate_id") != told["candidate_id"]).orderBy("rank").limit(most), told["d"]


def compare_candidates(pool: DataFrame, ids: list[str], description: str, as_of: date, sector: str = "TECH", provider=None) -> DataFrame:
    """The candidates asked for, scored among themselves (depth 0.5 where none is known), with strengths, weaknesses, place
    and the comparison's three texts. Fewer than two ids or an empty description are a ValueError, none found a LookupError."""
    told = (provider.requirements if provider else expansion.requirements)(asked(description), sector)
    chosen = copilot.select_ids(pool, ids)
    if not chosen.take(1):
        raise LookupError("none of the candidates was found")
    depth = F.coalesce("raw_semantic_score", F.lit(0.5)) if "raw_semantic_score" in pool.columns else F.lit(0.5)
    scored = score(chosen.withColumn("raw_semantic_score", depth), Request(description, tuple(told["top_keywords"]), as_of, sector=sector))
    return copilot.compare(scored).crossJoin(F.broadcast(copilot.synthesis(scored)))  # one row


def preview(description: str, most: int = 5) -> str:
    """The first lines of a description, and dots where there are more."""
    lines = description.strip().split("\n")
    return "\n".join(lines[:most] + ["..."] * (len(lines) > most))


def console(rows: DataFrame, seniority: str, most: int = 5) -> str:
    """The best rows as plain lines for a terminal."""
    from tallyrank.functions import columns as C

    plain = lambda c: C.plain_ascii(F.col(c)).alias(c)
    best = rows.orderBy("rank").limit(most).select("rank", plain("name"), plain("current_title"), "final_score", "semantic_score", "velocity_score", "freshness_label", plain("status_label"), plain("reasoning"))
    out = [f"Best {most} for a {seniority} role"]
    for r in best.collect():
        out += [f"{r['rank']}. {r['name']} ({r['current_title']}): {r['final_score']:.1f}, depth {r['semantic_score']:.1f}, velocity {r['velocity_score']:.1f}", f"   {r['freshness_label']}, {r['status_label']}: {r['reasoning']}"]
    return "\n".join(out)
