"""The registered queries and their SQL twins. A key is an operator of the survey."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallyrank.functions import columns as C
from tallyrank.functions import constants as K
from tallyrank.operators import chunking, copilot, encoders, expansion, ocr, order, parsing, pool, postings, prefilter, rank, score, stats, vectors
from tallyrank.plans import sql as S
from tallyrank.plans.view import AS_OF, candidates, read
from tallyrank.sources.buckets import BucketStore
from tallyrank.sources.store import export_columns, export_rows, new_folder, written
from tallyrank.sources import candidates as source
from tallyrank.sources.generator import COHORTS, generate
from tallyrank.streaming import freshness as fresh
from tallyrank.streaming.progress import ProgressTable, progress_rows, until_told
from tallyrank.streaming.ingest import failures, ingest_batch, pool_of

REQUEST = score.Request(S.QUERY, S.KEYWORDS, AS_OF)
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT doc_id, len({S.tokens('text')}) AS n_tokens FROM documents")
def token_count(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", F.size(C.tokens(F.col("text"))).alias("n_tokens"))


@query(f"SELECT doc_id, {S.word_count('text')} AS n_words FROM documents")
def word_count(spark, d):
    return read(spark, d, "documents").select("doc_id", C.word_count(F.col("text")).alias("n_words"))


@query(f"SELECT doc_id, round(r, 6) AS ratio, r > 0.4 AS is_dup FROM (SELECT doc_id, {S.duplicate_ratio('text')} AS r FROM documents)")
def duplicate_content(spark, d):
    r = C.duplicate_ratio(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.round(r, 6).alias("ratio"), (r > 0.4).alias("is_dup"))


@query("SELECT doc_id, len(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}_]+'), lambda w: w = 'password')) > 0 AS has FROM documents")
def keyword_presence(spark, d):
    return read(spark, d, "documents").select("doc_id", F.lower("text").rlike(r"(?<![\p{L}\p{N}_])password(?![\p{L}\p{N}_])").alias("has"))


@query(S.over("top", "SELECT candidate_id, overlap, title_bonus, kw_bonus, kscore AS score FROM top WHERE raw > 0 OR kscore = 0 QUALIFY row_number() OVER (ORDER BY kscore DESC, candidate_id) <= (SELECT least(count(*), greatest(50, floor(0.2 * count(*)))) FROM top)"))
def keyword_prefilter(spark, d):
    scores = prefilter.keyword_scores(candidates(spark, d), REQUEST.query, list(REQUEST.keywords))
    best = prefilter.best_of(written(scores.select("candidate_id", "overlap", "title_bonus", "kw_bonus", "keyword_score"), "scores"))
    return best.select("candidate_id", "overlap", "title_bonus", "kw_bonus", F.col("keyword_score").alias("score"))


@query(S.over("cand", f"SELECT candidate_id, pos, title, {S.level('title')} AS level FROM (SELECT candidate_id, unnest(titles) AS title, unnest(range(len(titles))) AS pos FROM cand)"))
def seniority_level(spark, d):
    jobs = candidates(spark, d).select("candidate_id", F.posexplode("career_history").alias("pos", "j"))
    return jobs.select("candidate_id", "pos", F.col("j.title").alias("title"), C.seniority_level(F.col("j.title")).alias("level"))


@query(S.over("vel", "SELECT candidate_id, round(velocity_raw, 6) AS velocity_raw, round(velocity, 6) AS velocity FROM vel"))
def career_velocity(spark, d):
    raw = written(candidates(spark, d).select("candidate_id", score.velocity_raw(AS_OF).alias("velocity_raw")), "velocity")
    return score.velocity(raw, AS_OF).select("candidate_id", F.round("velocity_raw", 6).alias("velocity_raw"), F.round("career_velocity_score", 6).alias("velocity"))


@query(S.over("fresh", "SELECT candidate_id, days, round(freshness, 6) AS score, label, staleness FROM fresh"))
def freshness(spark, d):
    rows = score.freshness(candidates(spark, d), AS_OF)
    return rows.select("candidate_id", F.col("inactive_days").alias("days"), F.round("freshness_score", 6).alias("score"), F.col("freshness_label").alias("label"), F.col("staleness_warning").alias("staleness"))


@query(S.over("cand", f"SELECT candidate_id, len(skills) AS n_skills, {S.word_count('text')} AS n_words, len(skills) >= 20 AND {S.word_count('text')} < 200 AS penalised FROM cand"))
def stuffer_guardrail(spark, d):
    n, w = F.size("skills_listed"), C.word_count(F.col("resume_text"))
    return candidates(spark, d).select("candidate_id", n.alias("n_skills"), w.alias("n_words"), ((n >= 20) & (w < 200)).alias("penalised"))


@query(S.over("cand", "SELECT candidate_id, " + ", ".join(f"{S.bonus('education', s)} AS {s.lower()}" for s in K.DEGREES) + " FROM cand"))
def education_bonus(spark, d):
    return candidates(spark, d).select("candidate_id", *(C.education_bonus(F.col("education"), s).alias(s.lower()) for s in K.DEGREES))


@query(S.over("depth", "SELECT candidate_id, round(sem0, 6) AS semantic FROM depth"))
def semantic_normalised(spark, d):
    pool = written(score.prepared(candidates(spark, d), REQUEST).select("candidate_id", "keyword_score"), "depths")
    rows = score._scaled(score.keyword_depth(pool, REQUEST), ("raw_semantic_score", "semantic", None))
    return rows.select("candidate_id", F.round("semantic", 6).alias("semantic"))


def scored(spark, d, request=REQUEST):
    """The scored view. What scores need is written once, without the texts: the prefilter, the scales and the scores each read it."""
    return score.scored_pool(written(score.prepared(candidates(spark, d), request).drop("resume_text"), "view"), request)


@query(S.over("labelled", "SELECT candidate_id, final_score, semantic_score, velocity_score, status_label, capped FROM labelled"))
def composite_score(spark, d):
    return scored(spark, d).select("candidate_id", "final_score", "semantic_score", "velocity_score", "status_label", F.col("guardrail_seniority_cap_applied").alias("capped"))


@query(S.over("ranked", "SELECT rank, candidate_id, final_score, round(freshness, 6) AS freshness FROM ranked"))
def rank_total(spark, d):
    return order.rank_total(scored(spark, d).select("candidate_id", "final_score", "freshness_score")).select("rank", "candidate_id", "final_score", F.round("freshness_score", 6).alias("freshness"))


@query(S.over("ranked", "SELECT rank, candidate_id, final_score FROM ranked WHERE rank <= 50"))
def rank_top(spark, d):
    return order.rank_total(scored(spark, d).select("candidate_id", "final_score", "freshness_score"), 50).select(F.col("rank").cast("long"), "candidate_id", "final_score")


@query()
def rank_exact(spark, d):
    return order.rank_exact(scored(spark, d))


@query(S.over("top", "SELECT candidate_id, overlap, title_bonus, kw_bonus, kscore AS score FROM top WHERE raw > 0 OR kscore = 0 QUALIFY row_number() OVER (ORDER BY kscore DESC, candidate_id) <= (SELECT least(count(*), greatest(50, floor(0.2 * count(*)))) FROM top)"))
def prefilter_by_index(spark, d):
    """The prefilter from the inverted index of a bucketed pool."""
    store = BucketStore(spark, new_folder(spark, "indexed"), buckets=8)
    rows = candidates(spark, d).select("candidate_id", "resume_text", "career_history")
    at = store.snapshot()
    rows = rows.withColumn("bucket", store.bucket(F.col("candidate_id"), at))
    store.commit(at, {"pool": (rows, list(range(at.buckets)))})
    postings.refresh(store)
    best = postings.prefilter(store, REQUEST.query, list(REQUEST.keywords))
    return best.select("candidate_id", "overlap", "title_bonus", "kw_bonus", F.col("keyword_score").alias("score"))


@query(S.over("gap", "SELECT candidate_id, len(matched) AS n_matched, len(missing) AS n_missing, array_to_string(matched, ';') AS matched FROM gap"))
def skills_gap(spark, d):
    rows = score.skills_gap(candidates(spark, d), REQUEST.keywords)
    return rows.select("candidate_id", F.size("matched_skills").alias("n_matched"), F.size("missing_skills").alias("n_missing"), F.array_join("matched_skills", ";").alias("matched"))


@query(S.over("ranked", "SELECT candidate_id, reasoning FROM ranked"))
def reasoning(spark, d):
    return scored(spark, d).select("candidate_id", "reasoning")


NAMES = ("Victor Smith", "Priya Sharma", "A/B", "Engineer", "unknown", " N/A ", "Jo Lead Manager", "Maria de la Cruz")


@query(f"""SELECT c_custkey AS id, name, NOT (low IN ({S.listed(K.GENERIC_NAMES)[1:-1]}) OR len(ws) = 0 OR regexp_matches(name, '[/|]'))
  AND len(list_filter(ws, lambda w: len(list_filter({S.listed(K.TITLE_WORDS)}, lambda t: contains(w, t))) > 0)) / greatest(len(ws), 1) < 0.5 AS valid
  FROM (SELECT c_custkey, name, trim(lower(name)) AS low, list_filter(string_split_regex(regexp_replace(trim(lower(name)), '[/|\\-]', ' ', 'g'), '\\s+'), lambda w: w <> '') AS ws
  FROM (SELECT c_custkey, {S.listed(NAMES)}[(c_custkey % 8 + 1)::INT] AS name FROM customer))""")
def name_validity(spark, d):
    name = F.element_at(C.lit_array(NAMES), (F.col("c_custkey") % 8 + 1).cast("int"))
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), name.alias("name"), C.valid_name(name, F.lit("")).alias("valid"))


LAYOUTS = ("yyyy-MM-dd", "yyyy-MM", "yyyy", "M/d/yyyy", "yyyy/M/d", "M/yyyy", "MMM, yyyy", "d MMMM yyyy")


@query("""SELECT o_orderkey AS id, o_orderkey % 8 AS layout, CASE WHEN o_orderkey % 8 IN (0, 3, 4, 7) THEN CAST(o_orderdate AS DATE) WHEN o_orderkey % 8 = 2 THEN date_trunc('year', o_orderdate)::DATE ELSE date_trunc('month', o_orderdate)::DATE END AS parsed FROM orders""")
def parse_dates(spark, d):
    rows = read(spark, d, "orders").withColumn("layout", F.col("o_orderkey") % 8)
    text = None
    for i, p in enumerate(LAYOUTS):
        shown = F.date_format("o_orderdate", p)
        text = F.when(F.col("layout") == i, shown) if text is None else text.when(F.col("layout") == i, shown)
    return rows.select(F.col("o_orderkey").alias("id"), "layout", C.parse_date(text, AS_OF).alias("parsed"))


def cosines(spark, d):
    rows = read(spark, d, "embeddings")
    asked = rows.orderBy("vec_id").select("embedding").first()["embedding"]
    return vectors.centred_cosine(rows, asked)


@query(S.over("cosine", "SELECT vec_id, round(score, 6) AS score FROM cosine"))
def centered_cosine(spark, d):
    return cosines(spark, d).select("vec_id", F.round("score", 6).alias("score"))


@query(S.over("cosine", "SELECT label, round(max(score), 6) AS best FROM cosine GROUP BY label"))
def best_chunk(spark, d):
    return vectors.best_fragment(cosines(spark, d), "label").select("label", F.round("best", 6).alias("best"))


@query(S.over("cand", "SELECT candidate_id, round(100 * (0.75 * best + 0.25 * least(1.0, n_jobs / (years_experience + 1))), 6) AS unified FROM cand JOIN (" + S.over("cosine", "SELECT label, round(max(score), 6) AS best FROM cosine GROUP BY label") + ") b ON k % 10 = b.label"))
def unified_score(spark, d):
    best = vectors.best_fragment(cosines(spark, d), "label").select("label", F.round("best", 6).alias("best"))
    rows = candidates(spark, d).withColumn("label", (F.substring_index("candidate_id", "_", -1).cast("long") % 10).cast("int"))
    return vectors.unified_score(rows.join(best, "label")).select("candidate_id", F.round("unified", 6).alias("unified"))


CHUNK_UNITS = f"""RECURSIVE para AS (
    SELECT doc_id, trim(p, {S.WHITE}) AS p, pos FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS p, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents)
  ), sized AS (SELECT doc_id, pos, p, {S.word_count('p')} AS n FROM para WHERE p <> ''
  ), unit AS (
    SELECT doc_id, pos, 0 AS sub, CASE WHEN n > 300 THEN 'B' ELSE 'P' END AS kind, CASE WHEN n > 300 THEN 0 ELSE n END AS n, CASE WHEN n > 300 THEN '' ELSE p END AS text FROM sized
    UNION ALL SELECT doc_id, pos, sub + 1, 'S', {S.word_count('s')}, s FROM (SELECT doc_id, pos, trim(s, {S.WHITE}) AS s, sub FROM (SELECT doc_id, pos, unnest(string_split(replace(replace(p, '! ', '. '), '? ', '. '), '. ')) AS s, unnest(range(len(string_split(replace(replace(p, '! ', '. '), '? ', '. '), '. ')))) AS sub FROM sized WHERE n > 300)) WHERE s <> ''
  ), numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, sub) AS i FROM unit
  ), fold AS (
    SELECT doc_id, i, kind, n, text, n AS size, 0 AS c, kind <> 'B' AS open, FALSE AS closed FROM numbered WHERE i = 1
    UNION ALL SELECT x.doc_id, x.i, x.kind, x.n, x.text, CASE WHEN x.kind = 'B' OR f.size + x.n > 300 THEN x.n ELSE f.size + x.n END,
      CASE WHEN (x.kind = 'B' OR f.size + x.n > 300) AND f.open THEN f.c + 1 ELSE f.c END, x.kind <> 'B', (x.kind = 'B' OR f.size + x.n > 300) AND f.open
    FROM fold f JOIN numbered x ON x.doc_id = f.doc_id AND x.i = f.i + 1
  ), ends AS (SELECT doc_id, c, any_value(kind) AS ended FROM fold WHERE closed GROUP BY ALL
  ), frag AS (
    SELECT f.doc_id, f.c AS frag_no, CASE WHEN any_value(e.ended) = 'S' THEN string_agg(text, '. ' ORDER BY i) || '.' ELSE string_agg(text, chr(10) ORDER BY i) END AS fragment
    FROM fold f LEFT JOIN ends e ON e.doc_id = f.doc_id AND e.c = f.c + 1 WHERE kind <> 'B' GROUP BY f.doc_id, f.c)"""


@query(f"WITH {CHUNK_UNITS} SELECT doc_id, frag_no::INT AS frag_no, md5(fragment) AS digest, {S.word_count('fragment')} AS n_words FROM frag")
def chunk_resume(spark, d):
    """Every fragment of every document."""
    rows = read(spark, d, "documents").select("doc_id", F.posexplode(chunking.chunks(F.col("text"))).alias("frag_no", "c"))
    return rows.select("doc_id", "frag_no", F.md5(F.col("c").cast("binary")).alias("digest"), C.word_count(F.col("c")).alias("n_words"))


SECTOR_OF_LANG = "CASE lang WHEN 'en' THEN 'TECH' WHEN 'de' THEN 'FIN' WHEN 'fr' THEN 'HEALTH' ELSE 'LEGAL' END"
ENCODER_OF = "CASE sector " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.ENCODERS.items()) + f" ELSE '{K.OTHER_ENCODER}' END"


@query(f"""WITH hashed AS (SELECT doc_id, encoder, ('0x' || substr(md5(encoder || ':' || w), 1, 15))::BIGINT AS h FROM (SELECT doc_id, {ENCODER_OF} AS encoder, unnest(words[1:512]) AS w FROM
    (SELECT doc_id, {SECTOR_OF_LANG} AS sector, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') AS words FROM documents)))
  SELECT doc_id, encoder, (h % 64)::INT AS pos, sum(CASE WHEN h // 64 % 2 = 1 THEN 1 ELSE -1 END)::DOUBLE AS x FROM hashed GROUP BY ALL HAVING sum(CASE WHEN h // 64 % 2 = 1 THEN 1 ELSE -1 END) <> 0""")
def encoded_by_sector(spark, d):
    """Documents as fragments of four sectors, each embedded by its sector's encoder."""
    parts = read(spark, d, "documents").select("doc_id", F.col("text").alias("fragment"), F.expr(SECTOR_OF_LANG).alias("sector"))
    rows = encoders.embed_fragments(parts).select("doc_id", "encoder", F.posexplode("embedding").alias("pos", "x"))
    return rows.filter("x <> 0").withColumn("x", F.col("x").cast("double"))


TWIN = "twin"


def _hashed(words: str, keys: str, source: str) -> str:
    """Signed word counts by place of a text's first 512 words, as ``encoders.HashedWords`` makes them."""
    spelled = f"SELECT {keys} ('0x' || substr(md5('{TWIN}:' || w), 1, 15))::BIGINT AS h FROM (SELECT {keys} unnest(list_filter(string_split_regex(lower({words}), '\\s+'), lambda x: x <> '')[1:512]) AS w FROM {source})"
    return f"SELECT {keys} h % 64 AS pos, sum(CASE WHEN h // 64 % 2 = 1 THEN 1 ELSE -1 END) AS x FROM ({spelled}) GROUP BY ALL"


def _by_fragments(select: str, query: str = S.QUERY, keywords: tuple[str, ...] = S.KEYWORDS) -> str:
    """``select`` over the ranked view whose raw score is the best fragment's centred cosine to S.QUERY."""
    best = f"""chosen AS (SELECT k, candidate_id FROM kw QUALIFY row_number() OVER (ORDER BY kscore DESC, candidate_id) <= least(count(*) OVER (), greatest(50, floor(0.2 * count(*) OVER ())))),
      piece AS MATERIALIZED (SELECT candidate_id, coalesce(frag_no, 0) AS frag_no, coalesce(fragment, '') AS fragment FROM chosen LEFT JOIN frag ON frag.doc_id = k),
      dense AS (SELECT candidate_id, frag_no, pos, coalesce(x, 0)::DOUBLE AS x FROM (SELECT candidate_id, frag_no, unnest(range(64)) AS pos FROM piece) LEFT JOIN ({_hashed("fragment", "candidate_id, frag_no,", "(SELECT DISTINCT * FROM piece)")}) USING (candidate_id, frag_no, pos)),
      mean AS (SELECT pos, avg(x) AS m FROM dense GROUP BY pos),
      asked AS (SELECT pos, coalesce(x, 0)::DOUBLE AS q FROM (SELECT unnest(range(64)) AS pos) LEFT JOIN ({_hashed("t", "", f"(SELECT '{S.QUERY}' AS t)")}) USING (pos)),
      near AS (SELECT candidate_id, frag_no, (sum((x - m) * (q - m)) / (greatest(sqrt(sum((x - m) * (x - m))), 1e-12) * greatest(sqrt(sum((q - m) * (q - m))), 1e-12)) + 1) / 2 AS score FROM dense JOIN mean USING (pos) JOIN asked USING (pos) GROUP BY ALL),
      top AS (SELECT kw.*, coalesce(best, 0.0) AS raw FROM kw LEFT JOIN (SELECT candidate_id, max(score) AS best FROM near GROUP BY 1) USING (candidate_id))"""
    chain = S.over("ranked", select)[len("WITH ") :].replace(f"top AS ({S.PARTS['top']})", best)
    words = lambda text: S.listed(prefilter.words_of(text))
    chain = chain.replace(S.listed(S.ASKED), words(query)).replace(S.listed(S.WANTED), words(" ".join(keywords)))
    return f"WITH {CHUNK_UNITS}, {chain}"


def _twin_embed(text):
    return encoders.embed_by()(text, F.lit(TWIN))


def _twin_query(text: str) -> list[float]:
    return encoders.HashedWords(TWIN).encode([text])[0].tolist()


@query(_by_fragments("SELECT candidate_id, round(raw, 6) AS raw_semantic_score FROM ranked"))
def semantic_rank(spark, d):
    """Fragments, an embedder that SQL can follow, centring, the best fragment: the evaluated candidates' raw scores."""
    pool = written(prefilter.keyword_scores(candidates(spark, d), REQUEST.query, list(REQUEST.keywords)), "view")
    chosen = written(prefilter.best_of(pool), "chosen")
    scores = rank.semantic_scores(chosen, REQUEST.query, _twin_embed, _twin_query)
    return score.attach_scores(pool, scores).select("candidate_id", F.round("raw_semantic_score", 6).alias("raw_semantic_score"))


def _buckets(part: str, case: str, names=()) -> str:
    counted = f"SELECT {case} AS bucket, count(*) AS n FROM cand GROUP BY 1"
    if names:
        counted = f"SELECT b.bucket, coalesce(x.n, 0) AS n FROM (SELECT unnest({S.listed(names)}) AS bucket) b LEFT JOIN ({counted}) x ON x.bucket = b.bucket"
    return S.over(part, counted)


ROLE_TITLES = ("React Native Lead", "Frontend Dev", "API Engineer", "Distributed Systems", "HTML Writer", "Data Scientist", "Maintenance", "NLP Lead", "SRE", "Cloud Architect", "DevOps and Backend", "Nurse")


@query(f"SELECT CASE {' '.join(f'WHEN {" OR ".join(f"contains(lower(t), '{w}')" for w in ws)} THEN {chr(39)}{r}{chr(39)}' for r, ws in K.ROLES)} ELSE 'Other' END AS bucket, count(*) AS n FROM (SELECT {S.listed(ROLE_TITLES)}[(c_custkey % {len(ROLE_TITLES)} + 1)::INT] AS t FROM customer) GROUP BY 1")
def statistics_roles(spark, d):
    titles = F.element_at(C.lit_array(ROLE_TITLES), (F.col("c_custkey") % len(ROLE_TITLES) + 1).cast("int"))
    return stats.role_counts(read(spark, d, "customer").select(titles.alias("current_title")))


@query(_buckets("cand", f"CASE WHEN years_experience < 2 THEN '{K.BANDS[0]}' WHEN years_experience < 5 THEN '{K.BANDS[1]}' WHEN years_experience < 8 THEN '{K.BANDS[2]}' ELSE '{K.BANDS[3]}' END", K.BANDS))
def statistics_bands(spark, d):
    return stats.band_counts(candidates(spark, d))


@query(_buckets("cand", f"CASE WHEN date_diff('day', last_active, {S.AS_OF}) <= 7 THEN 'Active Now' WHEN date_diff('day', last_active, {S.AS_OF}) <= 60 THEN 'Recent' ELSE 'Dormant' END", K.STATES))
def statistics_activity(spark, d):
    return stats.activity_counts(candidates(spark, d), AS_OF)


ROLE_CASE = " ".join("WHEN " + " OR ".join(f"contains(lower(current_title), '{w}')" for w in ws) + f" THEN '{r}'" for r, ws in K.ROLES)
BAND_CASE = f"CASE WHEN years_experience < 2 THEN '{K.BANDS[0]}' WHEN years_experience < 5 THEN '{K.BANDS[1]}' WHEN years_experience < 8 THEN '{K.BANDS[2]}' ELSE '{K.BANDS[3]}' END"
STATE_CASE = f"CASE WHEN date_diff('day', last_active, {S.AS_OF}) <= 7 THEN 'Active Now' WHEN date_diff('day', last_active, {S.AS_OF}) <= 60 THEN 'Recent' ELSE 'Dormant' END"


@query(S.over("cand", f"""SELECT part, bucket, sum(n)::BIGINT AS n FROM (
    SELECT 'role' AS part, CASE {ROLE_CASE} ELSE 'Other' END AS bucket, count(*) AS n FROM cand GROUP BY 2 UNION ALL SELECT 'band', {BAND_CASE}, count(*) FROM cand GROUP BY 2
    UNION ALL SELECT 'state', {STATE_CASE}, count(*) FROM cand GROUP BY 2 UNION ALL SELECT 'total', 'all', count(*) FROM cand
    UNION ALL SELECT 'band', unnest({S.listed(K.BANDS)}), 0 UNION ALL SELECT 'state', unnest({S.listed(K.STATES)}), 0) GROUP BY part, bucket"""))
def statistics(spark, d):
    return stats.statistics(candidates(spark, d), AS_OF)


@query("SELECT count(*) AS rows, count(*) FILTER (c_custkey % 3 > 0) AS with_file, count(DISTINCT CASE WHEN c_custkey % 3 > 0 THEN c_nationkey END) AS files, count(DISTINCT CASE WHEN c_custkey % 3 > 0 AND c_nationkey IN (1, 2, 77) THEN c_nationkey END) AS known FROM customer")
def source_report(spark, d):
    rows = read(spark, d, "customer").select(F.when(F.col("c_custkey") % 3 > 0, F.format_string("in/x/%d.pdf", "c_nationkey")).alias("source_file"))
    return stats.source_report(rows, {"first": ("1.pdf", "77.pdf"), "second": ("2.pdf",)})


@query("SELECT 'first' AS \"end\", row_number() OVER (ORDER BY c_custkey)::INT AS place, c_name FROM customer QUALIFY place <= 5 UNION ALL SELECT 'last', row_number() OVER (ORDER BY c_custkey)::INT, c_name FROM (SELECT * FROM customer ORDER BY c_custkey DESC LIMIT 5)")
def first_and_last(spark, d):
    return stats.first_and_last(read(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey").select("end", "place", "c_name")


JOBS_OF = "SELECT o_custkey AS k, o_orderkey AS ok, {company} AS company, CASE WHEN o_orderkey % 2 = 0 THEN 'Lead' ELSE ' lead ' END AS title, strftime(o_orderdate, '%Y') AS start_date, o_orderpriority AS end_date FROM orders"


@query(f"""WITH both_lists AS (
    SELECT *, row_number() OVER (PARTITION BY k ORDER BY list, ok) AS pos FROM (SELECT 1 AS list, * FROM ({JOBS_OF.format(company="o_orderstatus")}) WHERE ok % 3 > 0 UNION ALL SELECT 2, * FROM ({JOBS_OF.format(company="lower(o_orderstatus)")}) WHERE ok % 3 < 2)),
  keyed AS (SELECT *, lower(trim(company)) || '|' || lower(trim(title)) || '|' || trim(start_date) AS job FROM both_lists),
  once AS (SELECT k, job, min(pos) AS first, arg_max(company, pos) AS company, arg_max(title, pos) AS title, arg_max(start_date, pos) AS start_date, arg_max(end_date, pos) AS end_date FROM keyed GROUP BY k, job)
  SELECT k, (row_number() OVER (PARTITION BY k ORDER BY first) - 1)::INT AS pos, company, title, start_date, end_date FROM once""")
def history_union(spark, d):
    """Two lists of jobs of each customer, made of its orders, as one: each job where it first stood, as it was last given."""
    orders = read(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("ok"), "o_orderstatus", F.when(F.col("o_orderkey") % 2 == 0, "Lead").otherwise(" lead ").alias("title"), F.date_format("o_orderdate", "yyyy").alias("start_date"), F.col("o_orderpriority").alias("end_date"))
    job = lambda company: F.struct("ok", F.struct("title", company.alias("company"), "start_date", "end_date").alias("j"))
    listed = lambda keep, company: F.transform(F.array_sort(F.collect_list(F.when(keep, job(company)))), lambda x: x["j"])
    rows = orders.groupBy("k").agg(listed(F.col("ok") % 3 > 0, F.col("o_orderstatus")).alias("a"), listed(F.col("ok") % 3 < 2, F.lower("o_orderstatus")).alias("b"))
    return rows.select("k", F.posexplode(pool.union_history(F.col("a"), F.col("b"))).alias("pos", "j")).select("k", "pos", "j.company", "j.title", "j.start_date", "j.end_date")


@query("SELECT 'user ' || user_id AS candidate_id, CASE WHEN days <= 7 THEN 'Active Now' WHEN days <= 60 THEN 'Recent' ELSE 'Dormant' END AS label FROM (SELECT user_id, date_diff('day', max(ts), (SELECT max(ts) FROM events WHERE event_type = 'purchase')) AS days FROM events WHERE event_type = 'purchase' GROUP BY user_id)")
def freshness_stream(spark, d):
    """Purchases as signs of life: the label that each user's state has when the stream is through, by timers."""
    base = new_folder(spark, "fresh")
    before = spark.conf.get(fresh.ROCKSDB[0], None)
    spark.conf.set(*fresh.ROCKSDB)
    try:
        stream = spark.readStream.schema(read(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
        seen = stream.filter("event_type = 'purchase'").select(F.concat(F.lit("user "), "user_id").alias("candidate_id"), F.col("ts").cast("timestamp").alias("seen"))
        fresh.freshness_changes(seen).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(fresh.ROCKSDB[0]) if before is None else spark.conf.set(fresh.ROCKSDB[0], before)
    return spark.read.parquet(f"{base}/out").groupBy("candidate_id").agg(F.max_by("label", "at").alias("label"))


@query("SELECT n_nationkey % 5 AS part, count(*) AS rows FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def stream_progress(spark, d):
    """Customers streamed from five files, a batch each: the rows of the progress table's batches, in the order of the files."""
    base = new_folder(spark, "progress")
    for part in range(5):
        read(spark, d, "customer").filter(F.col("c_nationkey") % 5 == part).coalesce(1).write.mode("append").parquet(f"{base}/in")
    table = ProgressTable(spark, f"{base}/events")
    spark.streams.addListener(table)
    try:
        stream = spark.readStream.schema(read(spark, d, "customer").schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        run = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/check").trigger(availableNow=True).start()
        run.awaitTermination()
        until_told(spark, f"{base}/events", run.id)
    finally:
        spark.streams.removeListener(table)
    rows = progress_rows(spark, f"{base}/events", run.id).filter("batch is not null and rows > 0")
    return rows.select(F.col("batch").cast("int").alias("part"), "rows")


@query(S.over("labelled", "SELECT status_label, count(*) AS n FROM labelled GROUP BY status_label"))
def label_counts(spark, d):
    return stats.label_counts(scored(spark, d))


FREQUENT = ["the", "tion", "license", "password", "nowhere to be found"]


@query(f"SELECT keyword, (SELECT count(*) FROM documents WHERE contains(lower(text), keyword)) AS n_docs FROM (SELECT unnest({S.listed(FREQUENT)}) AS keyword)")
def keyword_df(spark, d):
    return stats.keyword_frequency(read(spark, d, "documents"), FREQUENT)


@query("SELECT category, count(*) AS n FROM (SELECT CASE WHEN source IN ('src0', 'src1') THEN 'first' WHEN source IN ('src2') THEN 'second' ELSE 'Unknown' END AS category FROM documents WHERE source IS NOT NULL) GROUP BY category")
def source_categories(spark, d):
    rows = read(spark, d, "documents").withColumn("file", F.concat(F.lit("/in/"), F.col("source")))
    return stats.source_counts(rows, {"first": ("src0", "src1"), "second": ("src2",)}, "file")


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 1")
def skip_ingested(spark, d):
    docs = read(spark, d, "documents").withColumn("source_file", F.concat(F.lit("f"), F.col("doc_id")))
    return pool.skip_ingested(docs, docs.filter("doc_id % 2 = 0")).select("doc_id")


def _files(rows: DataFrame) -> DataFrame:
    return rows.withColumn("k", F.substring_index("candidate_id", "_", -1).cast("long")).withColumn("name_not_extracted", F.lit(False)).withColumn("source_file", F.concat(F.lit("f"), F.col("k")))


@query(S.over("cand", """, a AS (SELECT * FROM cand WHERE k % 3 <> 0), b AS (SELECT * FROM cand WHERE k % 3 <> 1),
  m AS (SELECT coalesce(a.name, b.name) AS name, a.candidate_id AS id, coalesce(a.text, b.text) AS text, coalesce(b.k, a.k) AS f,
    array_to_string(list_sort(list_distinct(coalesce(a.skills, []) || CASE WHEN b.k IS NULL THEN [] ELSE b.skills || ['Extra'] END)), '|') AS skills, md5(coalesce(b.text, a.text)) AS resume,
    len(list_distinct(CASE WHEN a.k IS NULL THEN b.hk ELSE a.hk END)) AS n_jobs, greatest(coalesce(a.years_experience, b.years_experience + 1), coalesce(b.years_experience + 1, a.years_experience)) AS years
    FROM (SELECT a.*, coalesce(hk, []) AS hk FROM a LEFT JOIN (SELECT k, list(title || company || start_date) AS hk FROM jobs GROUP BY k) h USING (k)) a
    FULL JOIN (SELECT b.*, coalesce(hk, []) AS hk FROM b LEFT JOIN (SELECT k, list(title || company || start_date) AS hk FROM jobs GROUP BY k) h USING (k)) b ON a.name = b.name)
  SELECT name, coalesce(id, printf('cand_%04d', nid)) AS candidate_id, skills, resume, n_jobs, years FROM (
    SELECT *, (SELECT max(CAST(substr(id, 6) AS BIGINT)) FROM m) + CASE WHEN id IS NULL THEN row_number() OVER (PARTITION BY id IS NULL ORDER BY name) END AS nid FROM m)"""))
def upsert_merge(spark, d):
    rows = written(_files(candidates(spark, d)), "view")
    new = rows.filter("k % 3 <> 1").withColumn("skills_listed", F.concat("skills_listed", F.array(F.lit("Extra")))).withColumn("years_experience", F.col("years_experience") + 1)
    merged = pool.upsert(rows.filter("k % 3 <> 0"), new)
    return merged.select("name", "candidate_id", F.array_join(F.sort_array("skills_listed"), "|").alias("skills"), F.md5(F.coalesce("resume_text", F.lit("")).cast("binary")).alias("resume"), F.size("career_history").alias("n_jobs"), F.col("years_experience").alias("years"))


@query("SELECT c_name AS name, CASE WHEN c_custkey % 4 > 0 THEN printf('cand_%04d', c_custkey) ELSE printf('cand_%04d', n + (SELECT max(c_custkey) FROM customer c2 WHERE c2.c_custkey % 4 > 0)) END AS candidate_id FROM (SELECT *, CASE WHEN c_custkey % 4 = 0 THEN row_number() OVER (PARTITION BY c_custkey % 4 = 0 ORDER BY c_name) END AS n FROM customer)")
def id_allocation(spark, d):
    rows = read(spark, d, "customer").select(F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 4 > 0, F.format_string("cand_%04d", "c_custkey")).alias("candidate_id"), F.lit("").alias("source_file"), F.lit("").alias("resume_text"))
    return pool.allocate_ids(rows).select("name", "candidate_id")


@query(S.over("ranked", "SELECT row_number() OVER (ORDER BY final_score DESC, freshness DESC, candidate_id) AS rank, candidate_id, final_score AS score FROM ranked WHERE candidate_id <> 'cand_0007' QUALIFY rank <= 10"))
def similar_candidates(spark, d):
    """Look-alikes of one candidate. The description made from it would ask for its own words; the request is fixed here so that SQL can follow."""
    rows = scored(spark, d).filter(F.col("candidate_id") != "cand_0007").select("candidate_id", "final_score", "freshness_score")
    return order.rank_total(rows, 10).select(F.col("rank").cast("long"), "candidate_id", F.col("final_score").alias("score"))


IDS = ["cand_0012", "cand_0005", "cand_0031", "cand_9999999"]
COMPARE_SQL = S.over("ranked", "SELECT * FROM ranked")
for _a, _b in ((S.PARTS["cand"], S.PARTS["cand"] + f" WHERE printf('cand_%04d', c_custkey) IN ({S.listed(IDS)[1:-1]})"), (S.PARTS["top"], "SELECT *, 0.5 AS raw FROM kw")):
    COMPARE_SQL = COMPARE_SQL.replace(_a, _b)


@query(f"SELECT list_position({S.listed(IDS)}, candidate_id) - 1 AS pos, candidate_id, final_score, row_number() OVER (ORDER BY final_score DESC, list_position({S.listed(IDS)}, candidate_id)) AS place FROM ({COMPARE_SQL})")
def compare_top2(spark, d):
    """A comparison scores the chosen rows among themselves, with equal depth."""
    chosen = copilot.select_ids(candidates(spark, d), IDS).withColumn("raw_semantic_score", F.lit(0.5))
    return copilot.compare(score.score(chosen, REQUEST)).select("pos", "candidate_id", "final_score", F.col("place").cast("long"))


@query(S.over("ranked", "SELECT " + ", ".join(f'{c} AS "{h}"' for c, h in zip(("rank", "candidate_id", "name", "current_title", "years_experience", "velocity_score", "label", "status_label", "semantic_score", "bonus", "final_score", "reasoning"), K.EXPORT_HEADERS, strict=True)) + " FROM ranked"))
def csv_brief(spark, d):
    return export_rows(order.rank_total(export_columns(scored(spark, d))))


def _guide_sql(sector: str) -> str:
    return f"""SELECT candidate_id, 'What was the most complex scaling challenge you owned in the {sector} space, and how did you solve it?' AS question1,
      'The job needs hands-on experience with ' || coalesce(missing[1], 'System Optimization') || '. How would you approach adopting it?' AS question2,
      'Another key requirement is ' || coalesce(missing[2], 'Architectural Patterns') || '. Which failure modes do you watch out for?' AS question3,
      'Which engineering standards did you define at your previous companies?' AS question4,
      'You listed ' || coalesce(matched[1], 'Python') || ' as a strength. Which non-obvious failure mode did you meet in production?' AS question5, 'sector,gap,gap,growth,strength' AS kinds FROM gap"""


@query(S.over("gap", _guide_sql("FIN")))
def question_guide(spark, d):
    rows = score.skills_gap(candidates(spark, d), REQUEST.keywords).withColumn("g", copilot.question_guide("FIN"))
    return rows.select("candidate_id", *(F.element_at("g", i)["question"].alias(f"question{i}") for i in range(1, 6)), F.array_join(F.transform("g", lambda q: q["kind"]), ",").alias("kinds"))


@query(S.over("cand", "SELECT candidate_id, 'Subject: Career opportunity: ' || current_title || chr(10) || chr(10) || 'Hi ' || name || ',' || chr(10) || chr(10) || 'I came across your profile while sourcing for a ' || current_title || ' position. Your background as a ' || current_title || ' with ' || printf('%.1f', years_experience) || ' years of experience and your expertise in ' || CASE WHEN len(skills) > 0 THEN array_to_string(skills, ', ') ELSE 'cutting-edge engineering stacks' END || ' stood out.' || chr(10) || chr(10) || 'Would you be open to a short call this week?' || chr(10) || chr(10) || 'Best regards' AS text FROM cand"))
def outreach(spark, d):
    return candidates(spark, d).select("candidate_id", copilot.outreach("casual").alias("text"))


@query("SELECT event_id % 20 AS batch_id, CASE WHEN count(*) = count(*) FILTER (event_type = 'view') THEN 100 ELSE least(100, floor((count(*) FILTER (event_type IN ('click', 'purchase', 'error')))::DOUBLE / (count(*) - count(*) FILTER (event_type = 'view')) * 100))::INT END AS percent FROM events GROUP BY 1")
def batch_progress(spark, d):
    rows = read(spark, d, "events").groupBy((F.col("event_id") % 20).alias("batch_id")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "view").alias("skipped"), F.count_if(F.col("event_type") == "error").alias("failed"), F.count_if(F.col("event_type").isin("click", "purchase")).alias("parsed"))
    return rows.select("batch_id", C.progress(F.col("parsed"), F.col("failed"), F.col("n"), F.col("skipped")).alias("percent"))


@query("SELECT c_custkey AS id, CASE WHEN length(c_name) <= 8 THEN repeat('*', length(c_name)) ELSE left(c_name, 4) || repeat('*', length(c_name) - 8) || right(c_name, 4) END AS masked FROM customer")
def masked_settings(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), C.mask_key(F.col("c_name")).alias("masked"))


@query("SELECT unnest(" + S.listed(K.SECTORS) + ") AS sector, unnest(" + S.listed(K.SECTORS.values()) + ") AS label")
def sectors(spark, d):
    return spark.createDataFrame(list(K.SECTORS.items()), "sector string, label string")


@query(f"SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:30], ' ') AS words FROM (SELECT doc_id, {S.all_tokens('text')} AS l FROM documents)")
def jd_keywords(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_join(expansion.first_words(F.col("text")), " ").alias("words"))


def _has_word(text: str, word: str) -> str:
    import re

    return rf"regexp_matches(' ' || lower({text}) || ' ', '[^\p{{L}}\p{{N}}_]{re.escape(word)}[^\p{{L}}\p{{N}}_]')"


DOMAIN_TEXT = "'we need ' || p_name || CASE p_partkey % 9 WHEN 0 THEN ' react.' WHEN 1 THEN ', Go and Redis' WHEN 2 THEN ' computer vision;' WHEN 3 THEN ' html+SRE' WHEN 4 THEN ' nlp_tools' WHEN 5 THEN ' Next.js' WHEN 6 THEN ' cloud ai ui' ELSE ' mail' END"
DOMAIN_CASES = ", ".join(f"CASE WHEN {' OR '.join(_has_word('t', w) for w in ws)} THEN '{d}' END" for d, ws in K.DOMAIN_WORDS.items())


@query(f"SELECT id, CASE WHEN len(l) > 0 THEN array_to_string(l, ',') ELSE 'Backend' END AS domains FROM (SELECT id, list_filter([{DOMAIN_CASES}], lambda x: x IS NOT NULL) AS l FROM (SELECT p_partkey AS id, {DOMAIN_TEXT} AS t FROM part UNION ALL SELECT -doc_id - 1, coalesce(text, '') FROM documents))")
def query_domains(spark, d):
    parts = read(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), F.expr(DOMAIN_TEXT).alias("t"))
    docs = read(spark, d, "documents").select((-F.col("doc_id") - 1).cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("t"))
    return parts.unionByName(docs).select("id", F.array_join(expansion.domain_flags(F.col("t")), ",").alias("domains"))


@query("""WITH boxes AS (SELECT l_orderkey AS doc, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) * 7)::DOUBLE AS y, (l_suppkey % 90)::DOUBLE AS x, CAST(l_partkey AS VARCHAR) AS t, CASE WHEN l_suppkey % 90 < 50 THEN 0 ELSE 1 END AS side FROM lineitem),
  lined AS (SELECT *, max(side) OVER (PARTITION BY doc) AS two, floor((y / 7 - 1) / 2) AS line FROM boxes),
  ls AS (SELECT doc, line, string_agg(t, ' ' ORDER BY x, t) AS text FROM lined WHERE two = 0 GROUP BY doc, line)
SELECT doc, string_agg(t, chr(10) ORDER BY side, y, x, t) AS text FROM lined WHERE two = 1 GROUP BY doc
UNION ALL SELECT doc, string_agg(text, chr(10) ORDER BY line) AS text FROM ls GROUP BY doc""")
def ocr_pages(spark, d):
    """Boxes made from order lines: the order is the document, suppliers give the place."""
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.lit(0).alias("page"), F.lit(100.0).alias("width"), (F.col("l_suppkey") % 90).cast("double").alias("x_min"), (F.col("l_suppkey") % 90 + 10).cast("double").alias("x_max"), (F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) * 7).cast("double").alias("y_min"), F.col("l_partkey").cast("string").alias("text"))
    return ocr.document_text(ocr.page_text(rows))


@query(f"""WITH boxes AS (SELECT l_orderkey AS doc, l_linenumber % 2 AS page, row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn, l_suppkey % 90 AS x, l_suppkey % 90 + CASE WHEN l_partkey % 5 = 0 THEN 70 ELSE 10 END AS x2, l_partkey::VARCHAR AS t FROM lineitem),
  paged AS (SELECT *, avg(CASE WHEN x < 40 AND x2 > 60 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY doc, page) < 0.15 AND max(x) OVER (PARTITION BY doc, page) >= 50 AS two FROM boxes),
  lined AS (SELECT doc, page, (rn - 1) // 2 AS line, string_agg(t, ' ' ORDER BY x, t) AS t FROM paged WHERE NOT two GROUP BY ALL),
  pages AS (SELECT doc, page, string_agg(t, chr(10) ORDER BY x >= 50, rn, x, t) AS t FROM paged WHERE two GROUP BY ALL UNION ALL SELECT doc, page, string_agg(t, chr(10) ORDER BY line) FROM lined GROUP BY ALL)
  SELECT doc, string_agg(t, '{ocr.PAGE_BREAK}' ORDER BY page) AS text FROM pages GROUP BY doc""")
def ocr_columns(spark, d):
    """Boxes over two pages, some so wide that they cross the middle: those pages are read by lines, the others by columns."""
    at = W.partitionBy("l_orderkey", F.col("l_linenumber") % 2).orderBy("l_linenumber", "l_partkey", "l_suppkey")
    x = F.col("l_suppkey") % 90
    wide = F.when(F.col("l_partkey") % 5 == 0, 70).otherwise(10)
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") % 2).alias("page"), F.lit(100.0).alias("width"), x.cast("double").alias("x_min"), (x + wide).cast("double").alias("x_max"), (F.row_number().over(at) * 7).cast("double").alias("y_min"), F.col("l_partkey").cast("string").alias("text"))
    return ocr.document_text(ocr.page_text(rows))


@query("SELECT count(*) AS n, count(DISTINCT c_name) AS names, count(DISTINCT c_custkey) AS files FROM customer")
def ingest_stream(spark, d):
    """The customers as a stream of files into a pool; a second run from the same checkpoint finds nothing new."""
    base = new_folder(spark, "ingest")
    store = BucketStore(spark, f"{base}/pool")
    schema = read(spark, d, "customer").schema

    def merge(batch: DataFrame, number: int) -> None:
        ingest_batch(store, batch.select(F.col("c_name").alias("name"), F.concat(F.lit("f"), F.col("c_custkey")).alias("source_file"), F.lit(None).cast("string").alias("error")), number)

    for _ in range(2):
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "customer.parquet").parquet(d)
        stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return pool_of(store).agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"), F.countDistinct("source_file").alias("files"))


MERGES = 20


@query(f"""WITH files AS (SELECT o_custkey AS k, o_orderkey AS ok, o_custkey % 20 AS b0, o_orderkey % {MERGES} AS b, o_orderpriority AS title, o_orderstatus AS company, strftime(o_orderdate, '%Y-%m-%d') AS start_date, o_totalprice AS price FROM orders),
  last AS (SELECT k, arg_max(title, b * 1000000000 + ok) AS current_title, max(price) AS years, count(DISTINCT company || '|' || title || '|' || start_date) AS n_jobs, count(DISTINCT title) AS n_skills, arg_max(ok, b * 1000000000 + ok) AS f FROM files GROUP BY k)
  SELECT c_name AS name, current_title, years AS years_experience, n_jobs, n_skills, printf('in/%09d.pdf', f) AS source_file FROM last JOIN customer ON c_custkey = k""")
def pool_merge(spark, d):
    """Orders as resumes of their customers, merged into a bucketed pool in twenty batches, the last given first once more."""
    store = BucketStore(spark, new_folder(spark, "merge"), buckets=16)
    job = F.struct(F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("company"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("start_date"), F.lit(None).cast("string").alias("end_date"))
    rows = read(spark, d, "orders").join(read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("name")), "o_custkey")
    rows = rows.select((F.col("o_orderkey") % MERGES).alias("b"), "name", F.col("o_orderpriority").alias("current_title"), F.col("o_totalprice").alias("years_experience"), F.array(job).alias("career_history"), F.array("o_orderpriority").alias("skills_listed"), F.format_string("in/%09d.pdf", "o_orderkey").alias("source_file"), F.lit(None).cast("string").alias("error"))
    rows = written(rows, "merge-rows", by=("b",))
    for batch in [*range(MERGES), 0]:
        ingest_batch(store, rows.filter(F.col("b") == batch).drop("b"))
    return pool_of(store).select("name", "current_title", "years_experience", F.size("career_history").cast("long").alias("n_jobs"), F.size("skills_listed").cast("long").alias("n_skills"), "source_file")


def _ledger(spark, d) -> BucketStore:
    """Documents as files of two archives that name them alike; one in seven can't be parsed the first time, one in fourteen ever."""
    store = BucketStore(spark, new_folder(spark, "ledger"), buckets=16)
    rows = read(spark, d, "documents").select("doc_id", F.concat(F.lit("a"), (F.col("doc_id") % 2).cast("string")).alias("archive"), F.format_string("in/%d.pdf", F.floor(F.col("doc_id") / 2)).alias("source_file"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), F.format_string("person %d", "doc_id").alias("name"))
    for n, every in enumerate((7, 7, 14)):
        ingest_batch(store, rows.withColumn("error", F.when(F.col("doc_id") % every == 0, F.format_string("try %d", F.lit(n)))).drop("doc_id"))
    return store


LEDGER_SQL = "SELECT doc_id, 'a' || doc_id % 2 AS archive, 'in/' || doc_id // 2 || '.pdf' AS source_file, sha256(coalesce(text, '')) AS digest FROM documents"


@query(f"SELECT archive, source_file, digest, CASE WHEN doc_id % 14 = 0 THEN 'failed' ELSE 'parsed' END AS state, CASE WHEN doc_id % 7 = 0 THEN 3 ELSE 1 END::BIGINT AS batch, CASE WHEN doc_id % 14 = 0 THEN 'try 2' END AS error FROM ({LEDGER_SQL})")
def ingest_ledger(spark, d):
    return _ledger(spark, d).read("ledger").drop("bucket")


@query(f"SELECT archive, source_file, digest, 3::BIGINT AS batch, 'try 2' AS error FROM ({LEDGER_SQL}) WHERE doc_id % 14 = 0")
def ingest_failures(spark, d):
    return failures(_ledger(spark, d))


@query("""SELECT b AS batch, n AS total, CASE WHEN b = 1 THEN 0 ELSE n - bad END AS skipped, CASE b WHEN 1 THEN n - bad WHEN 2 THEN 0 ELSE bad - worse END AS parsed, CASE WHEN b = 3 THEN worse ELSE bad END AS failed
  FROM (SELECT count(*) AS n, count(*) FILTER (doc_id % 7 = 0) AS bad, count(*) FILTER (doc_id % 14 = 0) AS worse FROM documents), (SELECT unnest([1::BIGINT, 2, 3]) AS b)""")
def ingest_batches(spark, d):
    return _ledger(spark, d).read("batches").drop("bucket", "percent")


TYPED = score.Request(S.QUERY, S.KEYWORDS, AS_OF, seniority="senior", sector=" fin ")
TYPED_SQL = S.over("final", "SELECT candidate_id, final_score, capped, bonus FROM final").replace(S.bonus("education"), S.bonus("education", "FIN"))


@query(TYPED_SQL)
def score_as_typed(spark, d):
    """Seniority and sector as someone types them: the cap and the sector's words hold."""
    return scored(spark, d, TYPED).select("candidate_id", "final_score", F.col("guardrail_seniority_cap_applied").alias("capped"), F.col("education_bonus").alias("bonus"))


SECTOR_INPUT = (*K.SECTORS, "fin", " health ", "none", "")


@query(f"SELECT c_custkey AS id, CASE up " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.ENCODERS.items()) + f" ELSE '{K.OTHER_ENCODER}' END AS encoder, CASE WHEN trim(up) IN ({S.listed(K.SECTORS)[1:-1]}) THEN trim(up) ELSE 'TECH' END AS sector FROM (SELECT c_custkey, upper({S.listed(SECTOR_INPUT)}[(c_custkey % {len(SECTOR_INPUT)} + 1)::INT]) AS up FROM customer)")
def encoder_routing(spark, d):
    typed = F.element_at(C.lit_array(SECTOR_INPUT), (F.col("c_custkey") % len(SECTOR_INPUT) + 1).cast("int"))
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), rank.encoder_column(typed).alias("encoder"), C.sector_or_default(typed).alias("sector"))


@query(S.over("cand", "SELECT candidate_id, candidate_id AS id, name FROM cand WHERE candidate_id = 'cand_0012'"))
def candidate_lookup(spark, d):
    return rank.find(rank.with_id(candidates(spark, d)), "cand_0012").select("candidate_id", "id", "name")


@query("SELECT c_custkey // 15 AS batch, count(*) AS n, string_agg('===== RESUME ' || (c_custkey % 15 + 1) || ' (' || c_name || ') =====' || chr(10) || c_mktsegment, chr(10) || chr(10) ORDER BY c_custkey) AS prompt FROM customer GROUP BY 1")
def batch_prompts(spark, d):
    rows = read(spark, d, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_name").alias("file"), F.col("c_mktsegment").alias("text"))
    return parsing.batch_prompts(rows)


@query("SELECT c_custkey AS pos, c_custkey // 15 AS batch, CASE WHEN c_custkey % 15 < (c_custkey // 15) % 17 THEN (c_custkey // 15) * 100 + c_custkey % 15 END AS record FROM customer")
def records_by_position(spark, d):
    """Arrays of records that are too short, empty or too long, matched to their batches by place."""
    rows = read(spark, d, "customer").select(F.col("c_custkey").alias("pos"))
    answers = rows.select(F.floor(F.col("pos") / 15).alias("batch")).distinct().filter("batch % 17 > 0")
    answers = answers.withColumn("records", F.transform(F.sequence(F.lit(0), (F.col("batch") % 17 - 1).cast("int")), lambda i: F.col("batch") * 100 + i))
    matched, rest = parsing.zip_by_position(rows, answers)
    return matched.select("pos", "batch", "record").unionByName(rest.select("pos", "batch", F.lit(None).cast("long").alias("record")))


FILES = ("/in/jane_doe_resume.pdf", "Priya.Sharma-CV-final.PDF", "resume_2024.pdf", "a\\b\\Li.pdf", "X.pdf", "anna maria de la cruz.pdf", "JOHN 3 SMITH copy.docx", "new latest.pdf")
NOISE = ("resume", "cv", "profile", "final", "updated", "copy", "new", "latest")


@query(f"""SELECT id, CASE WHEN len(ws) BETWEEN 2 AND 4 OR (len(ws) = 1 AND length(ws[1]) > 2) THEN array_to_string(list_transform(ws, lambda w: upper(w[1]) || lower(w[2:])), ' ') END AS name
  FROM (SELECT id, list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_extract(f, '([^/\\\\]+)$', 1), '\\.[^.]*$', ''), '[_\\-.\\s]+', ' ', 'g')), ' '), lambda w: w <> '' AND NOT regexp_matches(w, '\\d') AND w NOT IN ({S.listed(NOISE)[1:-1]})) AS ws
  FROM (SELECT c_custkey AS id, {S.listed(FILES)}[(c_custkey % 8 + 1)::INT] AS f FROM customer))""")
def names_from_files(spark, d):
    f = F.element_at(C.lit_array(FILES), (F.col("c_custkey") % 8 + 1).cast("int"))
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), C.name_from_file(f).alias("name"))


@query(S.over("cand", f"""SELECT candidate_id, CASE WHEN valid THEN given ELSE 'Unknown Candidate' END AS name, NOT valid AS name_not_extracted FROM (SELECT candidate_id, given,
  NOT (low IN ({S.listed(K.GENERIC_NAMES)[1:-1]}) OR len(ws) = 0 OR regexp_matches(given, '[/|]') OR low = lower(current_title)) AND len(list_filter(ws, lambda w: len(list_filter({S.listed(K.TITLE_WORDS)}, lambda t: contains(w, t))) > 0)) / greatest(len(ws), 1) < 0.5 AS valid
  FROM (SELECT candidate_id, current_title, given, trim(lower(given)) AS low, list_filter(string_split_regex(regexp_replace(trim(lower(given)), '[/|\\-]', ' ', 'g'), '\\s+'), lambda w: w <> '') AS ws FROM (SELECT *, {S.listed(NAMES)}[(k % 8 + 1)::INT] AS given FROM cand)))"""))
def names_kept(spark, d):
    """Names that are none are replaced when a pool is scored."""
    rows = candidates(spark, d).withColumn("name", F.element_at(C.lit_array(NAMES), (F.substring_index("candidate_id", "_", -1).cast("long") % 8 + 1).cast("int")))
    return score.score(rows.withColumn("raw_semantic_score", F.lit(0.0)), REQUEST).select("candidate_id", "name", "name_not_extracted")


FIRST_WORDS = r"^[^\s]+(?: [^\s]+){0,2}"


@query(f"""SELECT doc_id, given AS name, NOT (low IN ({S.listed(K.GENERIC_NAMES)[1:-1]}) OR len(ws) = 0 OR regexp_matches(given, '[/|]') OR (title <> '' AND low = lower(title)))
  AND len(list_filter(ws, lambda w: len(list_filter({S.listed(K.TITLE_WORDS)}, lambda t: contains(w, t))) > 0)) / greatest(len(ws), 1) < 0.5 AS valid
  FROM (SELECT doc_id, given, title, lower(given) AS low, list_filter(string_split_regex(regexp_replace(lower(given), '[/|\\-]', ' ', 'g'), '\\s+'), lambda w: w <> '') AS ws
  FROM (SELECT doc_id, regexp_replace(regexp_extract(coalesce(text, ''), '{FIRST_WORDS}'), '[."'']', '', 'g') AS given, source AS title FROM documents))""")
def names_in_documents(spark, d):
    """The first words of every document as a name, its source as a title."""
    given = F.regexp_replace(F.regexp_extract(F.coalesce("text", F.lit("")), FIRST_WORDS, 0), "[.\"']", "")
    return read(spark, d, "documents").select("doc_id", given.alias("name"), C.valid_name(given, F.col("source")).alias("valid"))


PART_FILE = "'in/' || replace(p_name, ' ', '_') || CASE WHEN p_size % 3 = 0 THEN '-Resume' WHEN p_size % 3 = 1 THEN ' 2024 ' || lower(p_type) ELSE '.final copy' END || '.pdf'"


@query(f"""SELECT id, CASE WHEN len(ws) BETWEEN 2 AND 4 OR (len(ws) = 1 AND length(ws[1]) > 2) THEN array_to_string(list_transform(ws, lambda w: upper(w[1]) || lower(w[2:])), ' ') END AS name
  FROM (SELECT id, list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_extract(f, '([^/]+)$', 1), '\\.[^.]*$', ''), '[_\\-.\\s]+', ' ', 'g')), ' '), lambda w: w <> '' AND NOT regexp_matches(w, '\\d') AND w NOT IN ({S.listed(NOISE)[1:-1]})) AS ws
  FROM (SELECT p_partkey AS id, {PART_FILE} AS f FROM part))""")
def names_of_part_files(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), C.name_from_file(F.expr(PART_FILE)).alias("name"))


@query("SELECT bucket, count(*) AS n FROM (SELECT CASE " + ROLE_CASE.replace("current_title", "text") + " ELSE 'Other' END AS bucket FROM documents) GROUP BY bucket")
def roles_in_documents(spark, d):
    """Whole documents as titles: the first role whose words any text holds."""
    return stats.role_counts(read(spark, d, "documents").select(F.col("text").alias("current_title")))


@query(f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 1.0::DOUBLE ELSE round(greatest(0, date_diff('day', o_orderdate, CASE WHEN o_orderkey % 3 = 1 THEN {S.AS_OF} ELSE DATE '1996-06-30' END)) / 365.25, 6)::DOUBLE END AS years FROM orders")
def years_span(spark, d):
    k = F.col("o_orderkey") % 3
    start = F.when(k > 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    end = F.when(k == 2, F.lit("June 1996")).otherwise(F.lit(None).cast("string"))
    end = F.when(k == 2, F.lit("30 June 1996")).otherwise(end)
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.round(C.years_span(start, end, AS_OF), 6).alias("years"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'tion')")
def keyword_mentions(spark, d):
    return source.mentions(read(spark, d, "documents"), "Tion").select("doc_id")


@query("SELECT c_custkey AS id, c_name AS text FROM customer")
def fences_stripped(spark, d):
    """Answers with a code fence, inside the path of a model's response."""
    k = F.col("c_custkey") % 3
    text = F.when(k == 0, F.concat(F.lit("```json\n"), "c_name", F.lit("\n```"))).when(k == 1, F.concat(F.lit("  ```\n"), "c_name", F.lit("```  "))).otherwise(F.col("c_name"))
    part = F.array(F.struct(text.alias("text")))
    answer = F.to_json(F.struct(F.array(F.struct(F.struct(part.alias("parts")).alias("content"))).alias("candidates")))
    return read(spark, d, "customer").select(F.col("c_custkey").alias("id"), parsing.answer_text(answer).alias("text"))


@query(S.over("cand", "SELECT candidate_id, coalesce(lines, '') AS lines, 'Looking for a ' || current_title || ' skilled in ' || array_to_string(skills, ', ') || '.' AS request FROM cand LEFT JOIN (SELECT k, string_agg('- ' || title || ' at ' || company || ' (' || start_date || ' to ' || end_date || ')', chr(10) ORDER BY d DESC, ok DESC) AS lines FROM jobs GROUP BY k) h USING (k)"))
def history_lines(spark, d):
    rows = candidates(spark, d)
    return rows.select("candidate_id", copilot.history_lines(F.col("career_history")).alias("lines"), copilot.similar_request(F.col("current_title"), F.col("skills_listed")).alias("request"))


@query(S.over("gap", f"""SELECT candidate_id, array_to_string(((CASE WHEN len(matched) > 0 THEN matched[1:3] ELSE ['{K.STRENGTHS[0]}'] END) || {S.listed(K.STRENGTHS[1:])})[1:3], '|') AS strengths,
  array_to_string(((CASE WHEN len(missing) > 0 THEN missing[1:2] ELSE ['{K.WEAKNESSES[0]}'] END) || {S.listed(K.WEAKNESSES[1:])})[1:2], '|') AS weaknesses FROM gap"""))
def strengths_weaknesses(spark, d):
    rows = score.skills_gap(candidates(spark, d), REQUEST.keywords)
    return rows.select("candidate_id", F.array_join(copilot.strengths(F.col("matched_skills")), "|").alias("strengths"), F.array_join(copilot.weaknesses(F.col("missing_skills")), "|").alias("weaknesses"))


@query(S.over("ranked", "SELECT candidate_id, 'Name: ' || name || chr(10) || 'Title: ' || current_title || chr(10) || 'Experience: ' || printf('%.1f', years_experience) || ' years' || chr(10) || 'Final Score: ' || printf('%.1f', final_score) || chr(10) || 'Semantic Depth: ' || printf('%.1f', semantic_score) || '%' || chr(10) || 'Velocity Score: ' || printf('%.1f', velocity_score) || '/10' || chr(10) || 'Freshness: ' || label || chr(10) || 'Skills: ' || array_to_string(skills, ', ') || chr(10) || 'Matches: ' || array_to_string(matched, ', ') || chr(10) || 'Gaps: ' || array_to_string(missing, ', ') || chr(10) || 'Pitch: ' || reasoning AS sheet FROM ranked"))
def fact_sheets(spark, d):
    return scored(spark, d).select("candidate_id", copilot.fact_sheet().alias("sheet"))


@query("SELECT l_orderkey AS id, l_linenumber AS line, round(1 / (1 + exp(-(l_discount * 100 - 5))), 9) AS p FROM lineitem")
def sigmoid(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.round(vectors.sigmoid(F.col("l_discount") * 100 - 5), 9).alias("p"))


@query("SELECT label, pos, round(sum(x * m) / greatest(sum(m), 1e-9), 6) AS x FROM (SELECT label, vec_id % 2 AS m, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS pos FROM embeddings) GROUP BY label, pos")
def mean_pooled(spark, d):
    rows = read(spark, d, "embeddings").select("label", (F.col("vec_id") % 2).alias("mask"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    return vectors.mean_pool(rows, "label").select("label", F.posexplode("vector").alias("pos", "x")).select("label", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query(f"SELECT * FROM (VALUES {', '.join(f'({chr(39)}{n}{chr(39)}, {sum(x for _, x in COHORTS[: i + 1]) * 520 // 100 - sum(x for _, x in COHORTS[:i]) * 520 // 100}::BIGINT)' for i, (n, _) in enumerate(COHORTS))}) t(cohort, n)")
def generated_cohorts(spark, d):
    return generate(spark).groupBy("cohort").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 AND c_custkey % 7 = 0 THEN 'name,resume_text' WHEN c_custkey % 5 = 0 THEN 'name' WHEN c_custkey % 7 = 0 THEN 'resume_text' ELSE '' END AS missing, CASE WHEN c_custkey % 5 > 0 AND c_custkey % 7 > 0 THEN 1.0::DOUBLE END AS years FROM customer")
def validated_records(spark, d):
    k = F.col("c_custkey")
    kind = "array<struct<title:string,company:string,start_date:string,end_date:string>>"
    rows = read(spark, d, "customer").select(k.cast("string").alias("candidate_id"), F.when(k % 5 > 0, F.col("c_name")).alias("name"), F.lit("Dev").alias("current_title"), F.lit(None).cast("double").alias("years_experience"), F.lit(None).cast("array<string>").alias("skills_listed"), F.lit(None).cast(kind).alias("career_history"), F.lit(None).cast("string").alias("last_active"), F.when(k % 7 > 0, F.lit("text")).alias("resume_text"))
    good, bad = source.validate(rows)
    good = good.select(F.col("candidate_id").cast("long").alias("id"), F.lit("").alias("missing"), F.col("years_experience").alias("years"))
    return good.unionByName(bad.select(F.col("candidate_id").cast("long").alias("id"), F.array_join("missing_fields", ",").alias("missing"), F.lit(None).cast("double").alias("years")))


TOLD = expansion.requirements(S.QUERY, "tech")
DESCRIBED = _by_fragments("SELECT rank, candidate_id, final_score, round(raw, 6) AS raw_semantic_score, status_label FROM ranked", f"{S.QUERY} {expansion.expand(S.QUERY, 'senior')}", tuple(TOLD["top_keywords"]))


@query(DESCRIBED)
def rank_description(spark, d):
    """A description ranked by its fragments' vectors, from requirements to order."""
    rows = rank.rank(candidates(spark, d), S.QUERY, "senior", "tech", AS_OF, embed=_twin_embed, embed_query=_twin_query).rows
    return rows.select("rank", "candidate_id", "final_score", F.round("raw_semantic_score", 6).alias("raw_semantic_score"), "status_label")


@query(DESCRIBED.replace(S.PARTS["cand"], f"WITH once AS ({S.PARTS['cand']}) SELECT * FROM once UNION ALL SELECT * FROM once WHERE k % 13 = 0"))
def rank_repeated_ids(spark, d):
    """A pool in which one in thirteen ids stands twice: as many rows come back."""
    twice = F.substring("candidate_id", 6, 9).cast("long") % 13 == 0
    pool = candidates(spark, d).withColumn("copy", F.explode(F.when(twice, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy")
    rows = rank.rank(pool, S.QUERY, "senior", "tech", AS_OF, embed=_twin_embed, embed_query=_twin_query).rows
    return rows.select("rank", "candidate_id", "final_score", F.round("raw_semantic_score", 6).alias("raw_semantic_score"), "status_label")


@query()
def rank_similar(spark, d):
    """The ten candidates nearest to one, for the description made of its title and skills."""
    return rank.similar(candidates(spark, d), "cand_0007", AS_OF)[0].select("rank", "candidate_id", "id", "final_score")
