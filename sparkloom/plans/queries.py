"""Queries of the ranking engine over the star-schema tables, each with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..functions.lexicons import WEIGHTS
from ..functions.order import with_place
from ..operators import behaviour, consistency, features, grading, metrics, reasoning, retrieval, sampling, scoring, sweep, text
from . import driver as D
from . import rank

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- retrieval


def aspect_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = D.table(spark, sf_dir, "embeddings").where("vec_id in (0, 1)")
    return v.select(F.when(F.col("vec_id") == 0, "a").otherwise("b").alias("query"), F.col("embedding").cast("array<double>").alias("q"))


HITS = """
aspects as (select case when vec_id = 0 then 'a' else 'b' end as query, embedding as q from embeddings where vec_id in (0, 1)),
scored as (select query, vec_id, round(list_sum(list_transform(range(1, len(q) + 1), lambda i: q[i]::double * embedding[i]::double)), 9) as score from embeddings, aspects),
hits as (select * from (select *, row_number() over (partition by query order by score desc, vec_id) as rank from scored) where rank <= {k})
"""
BLEND = "blend as (select vec_id, coalesce(0.6 * max(score) filter (query = 'a'), 0) + coalesce(0.4 * max(score) filter (query = 'b'), 0) as semantic from hits group by vec_id)"


@query(f"with {HITS.format(k=50)} select query, vec_id, round(score, 6) as score, rank::int as rank from hits")
def vector_topk(spark, sf_dir):
    x = retrieval.vector_topk(D.table(spark, sf_dir, "embeddings"), aspect_vectors(spark, sf_dir), 50)
    return x.select("query", "vec_id", F.round("score", 6).alias("score"), "rank")


def _blend(spark, sf_dir, k=200):
    return retrieval.aspect_blend(retrieval.vector_topk(D.table(spark, sf_dir, "embeddings"), aspect_vectors(spark, sf_dir), k), D.ASPECTS)


@query(f"with {HITS.format(k=200)}, {BLEND} select vec_id, round(semantic, 6) as semantic from blend")
def aspect_semantic(spark, sf_dir):
    return _blend(spark, sf_dir).select("vec_id", F.round("semantic", 6).alias("semantic"))


TOKENS = "toks as (select doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') as t from documents)"


@query(f"with {TOKENS} select doc_id, len(t)::bigint as n, len(list_distinct(t))::bigint as distinct_n from toks")
def tokenize_counts(spark, sf_dir):
    t = D.table(spark, sf_dir, "documents").select("doc_id", S.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.size(F.array_distinct("t")).cast("long").alias("distinct_n"))


BM25 = f"""
{TOKENS},
counts as (select doc_id, term, count(*) as tf from (select doc_id, unnest(t) as term from toks) group by all),
sizes as (select count(*) as n, avg(len(t)) as avg from toks),
raw as (select term, count(*) as df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) as raw from counts, sizes group by term),
idf as (select term, df, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw),
q as (select term, count(*) as times from (select unnest({D.TERMS}) as term) group by term),
bm as (select t.doc_id, coalesce(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avg))), 0) as bm25
  from toks t left join (counts join q using (term) join idf using (term)) c on t.doc_id = c.doc_id, sizes group by t.doc_id)
"""


@query(f"with {BM25} select term, df::bigint as df, round(idf, 6) as idf from idf")
def bm25_idf(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents")
    x = retrieval.bm25_idf(retrieval.term_counts(docs, "doc_id", "text"), docs.count())
    return x.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"with {BM25} select doc_id, round(bm25, 6) as bm25 from bm")
def bm25_rank(spark, sf_dir):
    x = retrieval.bm25(D.table(spark, sf_dir, "documents"), D.TERMS)
    return x.select("doc_id", F.round("bm25", 6).alias("bm25"))


LISTS = """
sem as (select vec_id as id, row_number() over (order by round(semantic, 12) desc, vec_id) as rank from blend),
lexi as (select doc_id as id, row_number() over (order by round(bm25, 12) desc, doc_id) as rank from bm where doc_id in (select id from sem)),
fused as (select id, coalesce(1.0 / (60 + l.rank), 0) + coalesce(1.0 / (60 + s.rank), 0) as rrf from sem s full join lexi l using (id))
"""


def _fused(spark, sf_dir):
    sem = retrieval.ranked(_blend(spark, sf_dir), "semantic", "vec_id").select(F.col("vec_id").alias("id"), "rank")
    docs = D.table(spark, sf_dir, "documents")
    lex = retrieval.bm25(docs, D.TERMS, only=sem.select(F.col("id").alias("doc_id"))).withColumnRenamed("doc_id", "id")
    lists = sem.withColumn("list", F.lit("semantic")).unionByName(retrieval.ranked(lex, "bm25", "id").withColumn("list", F.lit("lexical")))
    return retrieval.rrf(lists)


@query(f"with {HITS.format(k=200)}, {BLEND}, {BM25}, {LISTS} select id, round(rrf, 9) as rrf from fused")
def rrf_fuse(spark, sf_dir):
    return _fused(spark, sf_dir).select("id", F.round("rrf", 9).alias("rrf"))


@query(f"with {HITS.format(k=200)}, {BLEND}, {BM25}, {LISTS} select id, round(rrf, 9) as rrf from fused order by round(rrf, 12) desc, id limit 80")
def shortlist(spark, sf_dir):
    return retrieval.shortlist(_fused(spark, sf_dir), "rrf", "id", 80).select("id", F.round("rrf", 9).alias("rrf"))


@query("""with l as (select 'events' as list, user_id as id, row_number() over (order by event_id) as rank from events),
f as (select id, min(rank) as rank from l group by id) select id::bigint as id, round(1.0 / (60 + rank), 9) as rrf from f""")
def rrf_first_position(spark, sf_dir):
    """A list in which ids repeat: later places only take up room."""
    e = D.table(spark, sf_dir, "events")
    x = with_place(e.select(F.lit("events").alias("list"), F.col("user_id").alias("id"), "event_id"), "event_id", [])
    return retrieval.rrf(x).select("id", F.round("rrf", 9).alias("rrf"))


@query("""select c_custkey, round(case when c_acctbal >= 0 then 1 / (1 + exp(-c_acctbal / 1000)) else exp(c_acctbal / 1000) / (1 + exp(c_acctbal / 1000)) end, 9) as sig,
round(greatest(0, least(1, c_acctbal / 5000)), 9) as clamped from customer""")
def sigmoid_clamp(spark, sf_dir):
    x = D.table(spark, sf_dir, "customer")
    return x.select("c_custkey", F.round(S.sigmoid(F.col("c_acctbal") / 1000), 9).alias("sig"), F.round(S.clamp01(F.col("c_acctbal") / 5000), 9).alias("clamped"))


@query("""with h as (select doc_id, toxic::double as logit from labels where doc_id % 2 = 0), t as (select coalesce(min(logit) - 1, 0) as tail from h)
select l.doc_id, coalesce(h.logit, t.tail) as logit from labels l left join h using (doc_id), t""")
def rerank_tail(spark, sf_dir):
    rows = D.table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("double").alias("t"))
    return retrieval.rerank_all(rows.select("doc_id"), rows.where("doc_id % 2 = 0").select("doc_id", F.col("t").alias("logit")), "doc_id")


# ---------------------------------------------------------------- records in SQL

_case = lambda d, c: f"case {c} " + " ".join(f"when '{k}' then '{v}'" for k, v in d.items()) + " end"
RECORDS = f"""
roles as (select o_custkey, o_orderkey, {_case(D.TITLES, "o_orderpriority")} as title, {_case(D.DESCRIPTIONS, "o_orderstatus")} as description, o_orderdate::date as start, (o_orderkey % 40)::int as months,
  row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1 as is_current from orders),
place as (select n_nationkey, n_name as city, r_name as country from nation join region on n_regionkey = r_regionkey),
people as (select c_custkey, 'CAND_' || lpad(c_custkey::varchar, 7, '0') as candidate_id, c_name, c_mktsegment, city, country, round(c_acctbal / 1000 + 1, 1) as years from customer left join place on c_nationkey = n_nationkey),
career as (select o_custkey, count(*) as n, sum(months) as total, max(months) as longest, string_agg(title || '  ' || description, '  ' order by o_orderkey) as txt,
  count(*) filter (not is_current) as done, avg(months) filter (not is_current) as mean_done, max(title) filter (is_current) as title, max(description) filter (is_current) as description, max(start) filter (is_current) as start,
  sum((o_orderkey % 4 = 0)::int) as at_segment from roles group by o_custkey),
skill as (select o_custkey, l_orderkey, l_linenumber, l_partkey, {_case(D.SKILLS, "p_type")} as name, l_linenumber % 3 = 0 as expert, p_size % 3 as months from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey where l_linenumber <= 2 or l_linenumber = 3 and l_quantity < 10),
skills as (select o_custkey, sum((lower(name) in ('nlp', 'pytorch', 'llm', 'bert'))::int) as n_skills, sum((expert and months = 0)::int) as idle from skill group by o_custkey),
base as (select p.*, coalesce(n, 0) as n, coalesce(total, 0) as total, longest, c_name || coalesce('  ' || txt, '') as txt, coalesce(done, 0) as done, mean_done, title, description, start, coalesce(n_skills, 0) as n_skills, coalesce(idle, 0) as idle,
  case when n > 0 and c_mktsegment in ('MACHINERY', 'FURNITURE') then at_segment::double / n else 0 end as fraction from people p left join career c on c_custkey = c.o_custkey left join skills s on c_custkey = s.o_custkey),
kinds as (select *, case when title in ('ML Engineer', 'Data Scientist') then 'strong' when title = 'Sales Executive' then 'nontech' when title = 'Backend Engineer' then 'adjacent' else 'other' end as kind,
  contains(txt, 'vector search') as a1, contains(txt, 'ranking') as a2, contains(txt, 'recommender') as a3, contains(txt, 'deployed') as a4 from base),
areas as (select *, a1::int + a2::int + a3::int + a4::int as n_areas from kinds),
feat as (select *, case when done >= 2 then mean_done end as tenure,
  round(0.45 * case kind when 'strong' then 1.0 when 'adjacent' then 0.45 when 'other' then 0.25 else 0 end + 0.55 * case n_areas when 0 then 0 when 1 then 0.5 when 2 then 0.8 else 1 end, 4)::double as role_substance,
  case when n_skills < 4 then 1.0 else least(1.0, n_areas / 2) end::double as skill_corroboration,
  case when years between 6 and 8 then 1.0 else round(greatest(0, case when years < 6 then (years - 3) / 3 else (13 - years) / 5 end), 4) end::double as experience_band,
  case when a3 then 1.0 else 0.5 end::double as nlp_ir_signal,
  case when fraction >= 0.999 then 0 else round(1 - fraction, 4) end::double as product_vs_consulting,
  case when n = 0 then 0.5 when contains(description, 'built') or contains(description, 'deployed') or contains(description, 'wrote') then 1.0 else 0.6 end::double as production_recency,
  case when country = 'ASIA' then case when city in ('NATION_1', 'NATION_2', 'NATION_3') then 1.0 else 0.8 end when c_custkey % 4 = 0 then 0.45 else 0.15 end::double as location_fit from areas),
feats as (select *, case when tenure is null then 0.7 when tenure >= 24 then 1 when tenure >= 18 then 0.6 else 0.2 end::double as tenure_stability,
  case when c_custkey % 90 - 1 < 0 then 0.5 else round(0.5 + 0.5 * least(1, (c_custkey % 90 - 1) / 70.0), 4) end::double as external_validation from feat),
why as (select f.*, list_filter([
  case when years > 0 and longest > years * 12 + 6 then 'long' end, case when years > 0 and total > years * 12 * 1.5 + 24 then 'sum' end, case when idle >= 3 then 'idle' end,
  case when (select count(*) from roles r where r.o_custkey = f.c_custkey and start > date '{D.REFERENCE}') > 0 then 'future' end], lambda x: x is not null) as reasons from feats f)
"""


def records(spark, sf_dir):
    return rank.prepared(D.entities(spark, sf_dir), D.PROFILE)


@query(f"with {RECORDS} select c_custkey, kind as title_class, n_areas::int as n_areas, n_skills::int as n_skills, round(fraction, 6) as firm_fraction, round(tenure, 6) as avg_tenure from feats")
def title_area_skill_firm(spark, sf_dir):
    return records(spark, sf_dir).select("c_custkey", "title_class", F.size("areas").alias("n_areas"), "n_skills", F.round("firm_fraction", 6).alias("firm_fraction"), F.round("avg_tenure", 6).alias("avg_tenure"))


@query(f"with {RECORDS} select c_custkey, {', '.join(features.FEATURES)} from feats")
def feature_bundle(spark, sf_dir):
    return records(spark, sf_dir).select("c_custkey", *features.FEATURES)


@query(f"with {RECORDS} select c_custkey, array_to_string(reasons, ',') as reasons, len(reasons) > 0 as flagged from why")
def contradiction_reasons(spark, sf_dir):
    x = records(spark, sf_dir)
    short = F.transform("honeypot_reasons", lambda r: F.when(r.startswith("role tenure"), "long").when(r.startswith("summed"), "sum").when(r.contains("0 months used"), "idle").when(r.endswith("future"), "future").otherwise("reversed"))
    return x.select("c_custkey", F.array_join(short, ",").alias("reasons"), F.col("is_honeypot").alias("flagged"))


@query(f"with {RECORDS} select c_custkey, title, description, strftime(start, '%Y-%m-%d') as start_date, ((2001 - year(start)) * 12 + 9 - month(start))::int as held from base where n > 0")
def current_role_pick(spark, sf_dir):
    x = D.entities(spark, sf_dir).withColumn("r", features.present_role()).where("r is not null")
    held = S.calendar_months(S.iso_date(F.col("r.start_date")), F.lit(D.REFERENCE).cast("date"))
    return x.select("c_custkey", "r.title", "r.description", "r.start_date", held.alias("held"))


@query(f"with {RECORDS} select c_custkey, txt as career_text from base")
def career_text(spark, sf_dir):
    return D.entities(spark, sf_dir).select("c_custkey", text.career_text().alias("career_text"))


@query(f"""with {RECORDS}, lines as (select o_custkey, string_agg(title || ' at ' || case when o_orderkey % 4 = 0 then c_mktsegment else 'ACME' end || '. ' || description, chr(10) order by o_orderkey) as l from roles join customer on o_custkey = c_custkey group by o_custkey),
named as (select o_custkey, string_agg(name || case when expert then ' (expert)' else ' (beginner)' end, ', ' order by l_orderkey, l_linenumber, l_partkey) as k from skill where name is not null group by o_custkey)
select c_custkey, c_name || chr(10) || case when title is null then 'Current role: ' || c_mktsegment || '.' else 'Current role: ' || title || ' at ' || c_mktsegment || '.' end || coalesce(chr(10) || l, '') || coalesce(chr(10) || 'Skills: ' || k, '') as rich_text from base left join lines on c_custkey = lines.o_custkey left join named on c_custkey = named.o_custkey""")
def rich_text(spark, sf_dir):
    return D.entities(spark, sf_dir).select("c_custkey", text.rich_text().alias("rich_text"))


@query("""select conv_id, string_agg(role || ': ' || text, chr(10) order by turn) as txt, count(*)::bigint as turns from conversations group by conv_id""")
def conversation_text(spark, sf_dir):
    t = D.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"), F.count("*").alias("turns"))
    return t.select("conv_id", F.array_join(F.transform("t", lambda r: F.concat(r["role"], F.lit(": "), r["text"])), "\n").alias("txt"), "turns")


_bi = lambda x, n, hi, down, up: f"(case when {x} >= {n} then {up} * greatest(0, least(1, ({x} - {n}) / ({hi} - {n}::double))) else -{down} * greatest(0, least(1, ({n} - {x}) / {n}::double)) end)"
BEHAVIOUR = f"""
ev as (select user_id, count(*) as n from events group by user_id),
sig as (select c_custkey, case when n is not null then n * 3 / 30.44 end as m, c_custkey % 11 / 10.0 as resp, c_custkey % 7 / 6.0 as intv, (c_custkey % 150)::double as notice, c_custkey % 8 as saved, c_custkey % 10 / 10.0 as compl, c_custkey % 90 - 1 as gh from customer left join ev on c_custkey = user_id),
beh as (select c_custkey, m, greatest(0.5, least(1.15, 1.0 + case when m is null then 0 when m <= 3 then 0.04 * greatest(0, least(1, (3 - m) / 3)) else -0.20 * greatest(0, least(1, (m - 3) / 9)) end
  + {_bi("resp", 0.44, 1.0, 0.12, 0.03)} + {_bi("intv", 0.5, 1.0, 0.10, 0.02)} - 0.08 * greatest(0, least(1, (notice - 30) / 90)) + case when c_custkey % 2 = 0 then 0.02 else 0 end
  + 0.02 * least(1, saved / 5.0) + {_bi("compl", 0.7, 1.0, 0.03, 0.02).replace("(0.7 - compl) / 0.7::double", "(0.7 - compl) / 0.4::double")} + case when c_custkey % 3 = 0 then 0.01 else 0 end + case when c_custkey % 5 = 0 then 0.01 else 0 end
  + case when gh >= 0 then {_bi("gh", 25, 70, 0.02, 0.02)} else 0 end)) as mult from sig)
"""


@query(f"with {BEHAVIOUR} select c_custkey, round(mult, 6) as mult from beh")
def behaviour_multiplier(spark, sf_dir):
    x = D.entities(spark, sf_dir)
    return x.select("c_custkey", F.round(behaviour.multiplier(F.col("signals"), D.REFERENCE), 6).alias("mult"))


@query("select user_id, datediff('day', max(ts)::date, date '2024-02-01')::int as days, round(datediff('day', max(ts)::date, date '2024-02-01') / 30.44, 6) as months from events group by user_id")
def recency_months(spark, sf_dir):
    x = D.table(spark, sf_dir, "events").groupBy("user_id").agg(F.max(F.to_date("ts")).alias("d"))
    days = F.datediff(F.lit("2024-02-01").cast("date"), F.col("d"))
    return x.select("user_id", days.alias("days"), F.round(days / behaviour.DAYS_A_MONTH, 6).alias("months"))


# ---------------------------------------------------------------- scores

_names = {"semantic_sim": "sem", "ce_score": "ce"}
#: Sums in the order of WEIGHTS, so that equal records have equal floats on both sides.
_mean = lambda w, extra="": "((" + " + ".join(f"coalesce({_names.get(f, f)} * {w(f)}, 0)" for f in WEIGHTS) + ") / (" + " + ".join(f"case when {_names.get(f, f)} is null then 0 else {w(f)} end" for f in WEIGHTS) + f"){extra})"
_default = lambda f: f"{WEIGHTS[f]!r}::double"
SCORED = f"""
{RECORDS}, {BEHAVIOUR},
cand as (select w.*, mult, greatest(0, least(1, w.c_custkey % 13 / 12.0)) as sem, case when w.c_custkey % 3 = 0 then 1 / (1 + exp(-(w.c_custkey % 9 - 4.0))) end as ce from why w join beh using (c_custkey)),
scored as (select *, {_mean(_default)} as base, case when len(reasons) > 0 then -1.0 else {_mean(_default, " * mult")} end as final from cand)
"""


def scored(spark, sf_dir):
    k = F.col("c_custkey")
    x = records(spark, sf_dir).withColumns({"semantic_sim": k % 13 / 12.0, "ce_score": F.when(k % 3 == 0, S.sigmoid((k % 9 - 4.0)))})
    return scoring.with_scores(x)


@query(f"with {SCORED} select c_custkey, round(base + 1e-10, 6) as base_score, round(final + 1e-10, 6) as final_score from scored")
def combine_and_floor(spark, sf_dir):
    """Some scores lie half-way between two six-digit numbers, give or take the last bit: these go up."""
    return scored(spark, sf_dir).select("c_custkey", *[F.round(F.col(c) + 1e-10, 6).alias(c) for c in ("base_score", "final_score")])


@query(f"with {SCORED} select candidate_id, row_number() over (order by round(final, 6) desc, candidate_id)::int as rank, round(final, 6) as score from scored order by rank limit 50")
def select_top(spark, sf_dir):
    """Without the guardrail, whose rate is a query of its own: the smallest tables have too few sound records."""
    x = scored(spark, sf_dir)
    return scoring.select_top(x, 50, most_flagged=2.0).select("candidate_id", "rank", "score")


@query(f"with {SCORED}, top as (select len(reasons) > 0 as f from scored order by round(final, 6) desc, candidate_id limit 100) select count(*)::bigint as n, coalesce(sum(f::int), 0)::bigint as flagged, round(avg(f::int), 6) as rate from top")
def guardrail_rate(spark, sf_dir):
    top = scored(spark, sf_dir).orderBy(F.desc(F.round("final_score", 6)), "candidate_id").limit(100)
    return top.agg(F.count("*").alias("n"), F.sum(F.col("is_honeypot").cast("int")).alias("flagged"), F.round(F.avg(F.col("is_honeypot").cast("int")), 6).alias("rate"))


@query("""with p as (select *, row_number() over (order by doc_id) as place, count(*) over () as n from labels),
r as (select place, n, case when place % 50 = 49 then doc_id + 1 else doc_id end as id, case when place % 60 = 59 then place + 7 else place end as rank, case when place % 40 = 39 then null when place % 30 < 2 then 3.0 else (doc_id % 7)::double end as score from p),
w as (select *, lag(score) over (order by place) as b, lag(id) over (order by place) as ib, count(*) over (partition by id) as same from r)
select 'expected 9 rows, found ' || n as error from w where place = 1 and n <> 9 union all select 'rank ' || rank || ' at place ' || place from w where rank <> place
union all select 'repeated id ' || id from w where same > 1 union all select 'score of ' || id || ' is no number' from w where score is null
union all select 'score rises at rank ' || rank from w where score > b union all select 'tie out of order at rank ' || rank from w where score = b and id < ib""")
def invariant_violations(spark, sf_dir):
    """A ranking of all labelled documents with every fault there is."""
    x = D.table(spark, sf_dir, "labels").withColumn("place", F.row_number().over(Window.orderBy("doc_id")))
    at = F.col("place")
    x = x.select(at, F.when(at % 50 == 49, F.col("doc_id") + 1).otherwise(F.col("doc_id")).alias("candidate_id"), F.when(at % 60 == 59, at + 7).otherwise(at).alias("rank"), F.when(at % 40 == 39, None).when(at % 30 < 2, 3.0).otherwise((F.col("doc_id") % 7).cast("double")).alias("score"))
    return scoring.violations(x, 9, place="place")


def _clause(gap: bool) -> str:
    cells = []
    names = {"semantic_sim": "sem", "ce_score": "ce", "behavioral_mult": "mult"}
    for name, cases in reasoning.CLAUSES:
        n = names.get(name, name)
        whens = " ".join(f"when {n} {c} then " + ("'" + t.replace("'", "''") + "'" if g == gap else "null") for c, t, g in cases)
        cells.append(f"case {whens} end")
    return f"list_filter([{', '.join(cells)}], lambda x: x is not null)"


@query(f"""with {SCORED}, said as (select candidate_id, role_substance, reasons, {_clause(False)} as good, {_clause(True)} as bad from scored where len(reasons) = 0),
full_text as (select candidate_id, case when len(good) > 0 then case when role_substance >= 0.8 and len(good) >= 2 then 'Strong fit' else 'Fit' end || ': ' || array_to_string(good, '; ') else 'Limited fit' end
  || case when len(bad) > 0 then '. Gaps: ' || array_to_string(bad, '; ') else '' end || '.' as s from said)
select candidate_id, case when length(s) <= 320 then s else rtrim(regexp_replace(left(s, 319), ' [^ ]*$', ''), ',;. ') || '…' end as reasoning from full_text""")
def reasoning_text(spark, sf_dir):
    x = scored(spark, sf_dir).where("not is_honeypot")
    return x.select("candidate_id", reasoning.reasoning().alias("reasoning"))


# ---------------------------------------------------------------- metrics

GRADES = "grades as (select doc_id, (3 * quality + 1 - toxic)::double as grade from labels where quality is not null and toxic is not null)"
RANKED = f"{GRADES}, ranked as (select doc_id, row_number() over (order by n_chars desc, doc_id) as rank from documents), rows as (select doc_id, rank, coalesce(grade, 0) as rel from ranked left join grades using (doc_id))"
METRICS = """
ideal as (select *, row_number() over (order by rel desc, rank) as ir, sum((rel >= 3)::int) over (order by rank) as seen from rows),
m as (select sum((pow(2, rel) - 1) / log2(rank + 1)) filter (rank <= 10) / nullif(sum((pow(2, rel) - 1) / log2(ir + 1)) filter (ir <= 10), 0) as ndcg10,
  sum((pow(2, rel) - 1) / log2(rank + 1)) filter (rank <= 50) / nullif(sum((pow(2, rel) - 1) / log2(ir + 1)) filter (ir <= 50), 0) as ndcg50,
  avg(seen / rank) filter (rel >= 3) as map, sum((rel >= 3)::int) filter (rank <= 10) / least(10, count(*)) as p10 from ideal)
"""


def grades(spark, sf_dir):
    x = D.table(spark, sf_dir, "labels").where("quality is not null and toxic is not null")
    return x.select("doc_id", (3 * F.col("quality") + 1 - F.col("toxic")).cast("double").alias("grade"))


def ranking(spark, sf_dir):
    return with_place(D.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", ["doc_id"], descending=True).select("doc_id", "rank")


@query(f"with {RANKED}, {METRICS} select round(ndcg10, 6) as ndcg10, round(ndcg50, 6) as ndcg50, round(map, 6) as map, round(p10, 6) as p10, round(0.5 * ndcg10 + 0.3 * ndcg50 + 0.15 * map + 0.05 * p10, 6) as composite from m")
def ranking_metrics(spark, sf_dir):
    x = metrics.evaluate(ranking(spark, sf_dir), grades(spark, sf_dir), "doc_id")
    return x.select(*[F.round(c, 6).alias(c) for c in ("ndcg10", "ndcg50", "map", "p10", "composite")])


@query(f"with {RANKED} select round(sum((pow(2, rel) - 1) / log2(rank + 1)) filter (rank <= 50), 6) as dcg50 from rows")
def dcg(spark, sf_dir):
    x = metrics.graded(ranking(spark, sf_dir), grades(spark, sf_dir), "doc_id")
    return x.agg(F.round(metrics.dcg(50), 6).alias("dcg50"))


@query(f"with {GRADES}, d as (select coalesce(grade, 0)::int as grade from documents left join grades using (doc_id)) select g::int as grade, count(d.grade)::bigint as n from range(5) t(g) left join d on d.grade = g group by g")
def grade_hist(spark, sf_dir):
    return metrics.grade_histogram(D.table(spark, sf_dir, "documents").join(grades(spark, sf_dir), "doc_id", "left"))


@query(f"with {SCORED}, r as (select row_number() over (order by round(final, 6), candidate_id) as rank, len(reasons) > 0 as f from scored) select " + ", ".join(f"coalesce(sum((rank <= {k} and f)::int), 0)::bigint as top{k}" for k in (10, 50, 100)) + " from r")
def flagged_in_top(spark, sf_dir):
    """Worst first, so that there is something to count."""
    order = [F.round("final_score", 6), F.col("candidate_id")]
    x = scored(spark, sf_dir).orderBy(*order).limit(100)
    return metrics.flagged_in_top(x.withColumn("rank", F.row_number().over(Window.orderBy(*order))))


PAIRS = "pairs as (select (3 * quality + 1 - toxic)::double as a, (doc_id % 5)::double as b from labels where quality is not null and toxic is not null)"


def pairs(spark, sf_dir):
    return grades(spark, sf_dir).select(F.col("grade").alias("a"), (F.col("doc_id") % 5).cast("double").alias("b"))


@query(f"""with {PAIRS}, r as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2.0 as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2.0 as rb, a, b from pairs),
g as (select a, b, count(*)::double as n from pairs group by all),
x as (select sign(y.a - x.a) * sign(y.b - x.b) as s, x.n * y.n as n, x.a = y.a as ta, x.b = y.b as tb from g x join g y on x.a < y.a or x.a = y.a and x.b < y.b),
k as (select coalesce(sum(n) filter (s > 0), 0) as c, coalesce(sum(n) filter (s < 0), 0) as d, coalesce(sum(n) filter (ta), 0) as ta, coalesce(sum(n) filter (tb), 0) as tb from x)
select count(*)::bigint as n, round(avg((a = b)::int), 4) as exact, round(avg((abs(a - b) <= 1)::int), 4) as within_one, round(corr(ra, rb), 4) as rho, round(any_value((c - d) / sqrt((c + d + ta) * (c + d + tb))), 4) as tau from r, k""")
def agreement(spark, sf_dir):
    return metrics.agreement(pairs(spark, sf_dir))


@query("""select doc_id, case when toxic = 1 then 0 when doc_id % 4 = 0 then 3 * quality + 1 when abs(3 * quality + 1 - doc_id % 5) >= 2 then null else floor((3 * quality + 1 + doc_id % 5) / 2.0 + 0.5)::int end::int as grade,
toxic <> 1 and doc_id % 4 <> 0 and abs(3 * quality + 1 - doc_id % 5) >= 2 as needs_review from labels where quality is not null and toxic is not null""")
def reconcile(spark, sf_dir):
    x = D.table(spark, sf_dir, "labels").where("quality is not null and toxic is not null")
    g, r = metrics.reconciled(3 * F.col("quality") + 1, F.when(F.col("doc_id") % 4 != 0, (F.col("doc_id") % 5).cast("int")), F.col("toxic") == 1)
    return x.select("doc_id", g.cast("int").alias("grade"), r.alias("needs_review"))


# ---------------------------------------------------------------- grading, sampling

STRATA = "strata as (select candidate_id, c_custkey, case when len(reasons) > 0 then 'suspected_honeypot' when kind = 'nontech' and n_skills >= 4 and n_areas = 0 then 'suspected_stuffer' when kind = 'strong' then 'strong_ml' when kind = 'adjacent' and n_areas > 0 then 'adjacent_gem' end as stratum from why)"
GRADED = """
comp as (select *, case when years between 6 and 8 then 1.0 when years between 5 and 9 then 0.7 when years >= 4 and years < 5 or years > 9 and years <= 11 then 0.35 else 0 end as exp_c,
  case when fraction >= 0.999 then 0 else 1 - fraction end as prod_c, case when c_custkey % 90 - 1 <= 0 then 0.3 else 0.5 + 0.5 * least(1, (c_custkey % 90 - 1) / 70.0) end as gh_c from why),
based as (select *, round(round(35 / 90 * role_substance, 4) + round(10 / 90 * exp_c, 4) + round(10 / 90 * nlp_ir_signal, 4) + round(10 / 90 * prod_c, 4) + round(5 / 90 * production_recency, 4) + round(5 / 90 * tenure_stability, 4) + round(5 / 90 * gh_c, 4) + round(10 / 90 * location_fit, 4), 4) as s from comp),
t0 as (select *, case when s >= 0.72 then 4 when s >= 0.55 then 3 when s >= 0.38 then 2 when s >= 0.2 then 1 else 0 end as t from based),
t1 as (select *, case when t >= 4 and not (role_substance >= 0.65 and years between 5 and 9 and nlp_ir_signal >= 0.5 and prod_c > 0 and production_recency >= 0.5) then 3 else t end as g1 from t0),
t2 as (select *, case when g1 >= 3 and not (role_substance >= 0.45 and nlp_ir_signal >= 0.5 and prod_c > 0) then 2 else g1 end as g2 from t1),
t3 as (select *, least(g2, case when role_substance < 0.1 then 0 when role_substance < 0.2 then 1 when role_substance < 0.4 then 2 else 4 end, case when fraction >= 0.999 then 1 else 4 end, case when tenure < 18 and done >= 3 then 2 else 4 end, case when years < 4 or years > 12 then 2 else 4 end, case when country <> 'ASIA' and c_custkey % 4 <> 0 then 3 else 4 end) as g3 from t2),
rubric as (select *, case when len(reasons) > 0 or (kind = 'nontech' and n_skills >= 4 and n_areas = 0) then 0 else g3 end::int as grade from t3)
"""
RUBRIC = f"{RECORDS}, {GRADED}"


@query(f"with {RUBRIC} select c_custkey, round(s, 3) as base_score, grade from rubric")
def rubric_grade(spark, sf_dir):
    x = grading.graded(records(spark, sf_dir), D.PROFILE)
    return x.select("c_custkey", F.round("base_grade_score", 3).alias("base_score"), F.col("grade").cast("int").alias("grade"))


@query(f"with {RECORDS}, {STRATA} select coalesce(stratum, 'none') as stratum, count(*)::bigint as n from strata group by 1")
def strata(spark, sf_dir):
    return records(spark, sf_dir).groupBy(F.coalesce(sampling.stratum(), F.lit("none")).alias("stratum")).agg(F.count("*").alias("n"))


@query(f"""with {RECORDS}, {STRATA}, lots as (select candidate_id, coalesce(stratum, 'random_pool') as stratum, row_number() over (partition by stratum order by sha256('42:' || candidate_id), candidate_id) as n from strata),
special as (select * from lots where n <= case stratum when 'suspected_honeypot' then 30 when 'strong_ml' then 20 when 'adjacent_gem' then 10 when 'suspected_stuffer' then 10 else 0 end)
select candidate_id, stratum from special union all select candidate_id, stratum from lots where stratum = 'random_pool' and n <= 90 - (select count(*) from special)""")
def stratified_sample(spark, sf_dir):
    x = records(spark, sf_dir).select("candidate_id", sampling.stratum().alias("stratum"))
    return sampling.stratified_sample(x, targets={"suspected_honeypot": 30, "strong_ml": 20, "adjacent_gem": 10, "suspected_stuffer": 10}, total=90)


@query(f"with {GRADES}, n as (select *, row_number() over (partition by grade::int order by sha256((42 + grade::int)::varchar || ':' || doc_id), doc_id) as k, count(*) over (partition by grade::int) as c from grades) select doc_id, grade, case when k <= c // 2 then 'train' else 'val' end as part from n")
def split(spark, sf_dir):
    return sampling.split(grades(spark, sf_dir), "doc_id")


@query(f"with {GRADES}, o as (select doc_id, 4.0::double as grade from documents where doc_id % 17 = 0) select doc_id, coalesce(o.grade, g.grade) as grade from grades g full join o using (doc_id)")
def overlay(spark, sf_dir):
    from ..sources.grades import overlay as over

    o = D.table(spark, sf_dir, "documents").where("doc_id % 17 = 0").select(F.col("doc_id").alias("candidate_id"), F.lit(4.0).alias("grade"))
    return over(grades(spark, sf_dir).withColumnRenamed("doc_id", "candidate_id"), o).withColumnRenamed("candidate_id", "doc_id")


@query("select doc_id from documents where doc_id not in (select doc_id from labels) order by sha256('42:' || doc_id), doc_id limit 60")
def distractor_pool(spark, sf_dir):
    return sampling.pool_sample(D.table(spark, sf_dir, "documents"), D.table(spark, sf_dir, "labels"), 60, "doc_id").select("doc_id")


@query("""with t as (select doc_id, source, row_number() over (partition by source order by n_chars desc, doc_id) as turn from documents) select doc_id, source, turn::int as turn from t order by turn, source limit 70""")
def round_robin(spark, sf_dir):
    return sampling.round_robin(D.table(spark, sf_dir, "documents"), "source", [F.desc("n_chars"), "doc_id"], ["source"], 70).select("doc_id", "source", "turn")


@query(f"""with {RECORDS} select candidate_id, case when len(reasons) > 0 then 'honeypot' when kind = 'nontech' and n_skills >= 4 and n_areas = 0 then 'stuffer' else 'noise' end as category from why""")
def demo_category(spark, sf_dir):
    """No record is from the country that the demo's better categories ask for."""
    return records(spark, sf_dir).select("candidate_id", sampling.demo_category().alias("category"))


@query("select doc_id from documents where doc_id in (select doc_id from labels where quality = 1)")
def filtered_ids(spark, sf_dir):
    from ..sources.records import by_ids

    ids = D.table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("candidate_id"))
    return by_ids(D.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("candidate_id")), ids).withColumnRenamed("candidate_id", "doc_id")


# ---------------------------------------------------------------- sweep

_small = sum(WEIGHTS[f] for f in sweep.OTHERS)
GRID = f"""
grid as (select printf('ce=%.2f role=%.2f sem=%.2f', ce::double, role::double, sem::double) as config, ce::double as wce, role::double as wrole, sem::double as wsem, 1 - ce::double - role::double - sem::double as rest
  from unnest({sweep.CE_LEVELS}) a(ce), unnest({sweep.ROLE_LEVELS}) b(role), unnest({sweep.SEMANTIC_LEVELS}) c(sem) where 1 - ce::double - role::double - sem::double > 1e-9)
"""


@query(f"with {GRID} select config, round(wce, 9) as w_ce, round(rest * {WEIGHTS['location_fit'] / _small}, 9) as w_location from grid")
def weight_grid(spark, sf_dir):
    return sweep.weight_grid(spark).select("config", F.round("w_ce_score", 9).alias("w_ce"), F.round("w_location_fit", 9).alias("w_location"))


def _cache(spark, sf_dir):
    return scored(spark, sf_dir).select("candidate_id", "c_custkey", *WEIGHTS, "is_honeypot", "behavioral_mult", "final_score")


_grid = lambda f: {"ce_score": "wce", "role_substance": "wrole", "semantic_sim": "wsem"}.get(f) or f"(rest * {WEIGHTS[f] / _small!r}::double)"
SWEEP = f"""
{SCORED}, {GRID},
re as (select config, candidate_id, case when len(reasons) > 0 then -1.0 else {_mean(_grid, " * mult")} end as f from scored, grid),
rr as (select *, row_number() over (partition by config order by round(f, 12) desc, candidate_id) as rank from re)
"""


@query(f"with {SWEEP} select config, candidate_id, rank::int as rank from rr where rank <= 20")
def sweep_rerank(spark, sf_dir):
    """Every record under every setting; reported are each setting's best twenty."""
    return sweep.reranked(_cache(spark, sf_dir), sweep.weight_grid(spark)).where("rank <= 20").select("config", "candidate_id", "rank")


_whole = lambda k, rank: f"sum((pow(2, rel) - 1) / log2({rank} + 1)) filter ({rank} <= {k})"
BEST = f"""
{SWEEP}, {GRADED},
lots as (select candidate_id, grade, row_number() over (partition by grade order by sha256((42 + grade)::varchar || ':' || candidate_id), candidate_id) as k, count(*) over (partition by grade) as c from rubric),
halves as (select candidate_id, grade::double as rel, case when k <= c // 2 then 'train' else 'val' end as part from lots),
sides as (select config, part, rel, row_number() over (partition by config, part order by rr.rank) as rank from rr join halves using (candidate_id)),
ideals as (select *, row_number() over (partition by config, part order by rel desc, rank) as ir, sum((rel >= 3)::int) over (partition by config, part order by rank) as seen from sides),
figures as (select config, part, coalesce({_whole(10, "rank")} / nullif({_whole(10, "ir")}, 0), 0) as ndcg10, coalesce({_whole(50, "rank")} / nullif({_whole(50, "ir")}, 0), 0) as ndcg50,
  coalesce(avg(seen / rank) filter (rel >= 3), 0) as map, sum((rel >= 3)::int) filter (rank <= 10) / least(10, count(*)) as p10 from ideals group by config, part),
scores as (select config, part, round(0.5 * ndcg10 + 0.3 * ndcg50 + 0.15 * map + 0.05 * p10, 9) as composite from figures),
best as (select config, max(composite) filter (part = 'train') as train, max(composite) filter (part = 'val') as val from scores group by config order by train desc, config limit 8)
"""


@query(f"with {BEST} select config, train, val, row_number() over (order by val desc, train desc, config) = 1 as chosen from best")
def sweep_best(spark, sf_dir):
    """Best settings on train and the one chosen on val; grades are the rubric's."""
    g = grading.graded(records(spark, sf_dir), D.PROFILE).select("candidate_id", F.col("grade").cast("double").alias("grade"))
    return sweep.run_sweep(_cache(spark, sf_dir), g)


@query(f"with {SCORED}, r as (select candidate_id, row_number() over (order by round(final, 12) desc, candidate_id)::int as rank from scored) select candidate_id, rank, rank as scorer_rank from r")
def faithfulness(spark, sf_dir):
    """Each record's place after re-ranking with the default weights, and the scorer's own; the SQL has the one order that both must be."""
    c = _cache(spark, sf_dir)
    mine = sweep.reranked(c, sweep.default_weights(spark)).select("candidate_id", "rank")
    return mine.join(retrieval.ranked(c, "final_score", "candidate_id").withColumnRenamed("rank", "scorer_rank"), "candidate_id", "full")


POOL_BM25 = BM25.replace("from documents", "from pool")
HYBRID = f"""
{HITS.format(k=800)}, {BLEND}, pool as (select doc_id, text, lang, semantic from blend join documents on vec_id = doc_id), {POOL_BM25},
sem as (select doc_id as id, row_number() over (order by round(semantic, 12) desc, doc_id) as rank from pool),
lexi as (select doc_id as id, row_number() over (order by round(bm25, 12) desc, doc_id) as rank from bm),
fused as (select id as doc_id, coalesce(1.0 / (60 + l.rank), 0) + coalesce(1.0 / (60 + s.rank), 0) as rrf from sem s full join lexi l using (id)),
found as (select * from fused order by round(rrf, 12) desc, doc_id limit 800),
hit as (select doc_id, rrf, lang, greatest(0, least(1, semantic)) as sim, len(list_filter(list_distinct({D.TERMS}), lambda t: regexp_matches(lower(text), '(^|[^a-z0-9])' || t || '([^a-z0-9]|$)'))) as n from found join pool using (doc_id)),
sub as (select *, round(0.45 * case when lang = 'en' then 1.0 else 0.25 end + 0.55 * case n when 0 then 0 when 1 then 0.5 when 2 then 0.8 else 1 end, 4)::double as role from hit),
final as (select *, round((0.5 * role + 0.5 * sim) / 1.0, 6) as score from sub)
"""


@query(f"with {HYBRID} select doc_id, row_number() over (order by score desc, doc_id)::int as rank, score, role as role_substance, round(sim, 6) as semantic_sim, round(rrf, 9) as rrf from final order by rank limit 100")
def hybrid_top100(spark, sf_dir):
    """The whole way: vectors, BM25 over the semantic pool, fusion, scores, the best hundred, with reasons."""
    docs, vec = D.table(spark, sf_dir, "documents"), D.table(spark, sf_dir, "embeddings")
    hits = retrieval.vector_topk(vec, aspect_vectors(spark, sf_dir), 800)
    pool = retrieval.aspect_blend(hits, D.ASPECTS).select(F.col("vec_id").alias("doc_id"), "semantic").join(docs, "doc_id").cache()  # 800 rows an aspect at most
    lex = retrieval.bm25(pool, D.PROFILE.query_terms())
    lists = retrieval.ranked(pool, "semantic", "doc_id").withColumn("list", F.lit("semantic")).unionByName(retrieval.ranked(lex, "bm25", "doc_id").withColumn("list", F.lit("lexical")))
    top = retrieval.shortlist(retrieval.rrf(lists, ident="doc_id"), "rrf", "doc_id")
    x = pool.join(top, "doc_id")
    t = F.lower(F.col("text"))
    hit = F.array_compact(F.array(*[F.when(t.rlike(S.ascii_words([w])), F.lit(w)) for w in sorted(set(D.TERMS))]))
    sub = features.role_substance(F.when(F.col("lang") == "en", "strong").otherwise("other"), hit)
    x = x.withColumns({"role_substance": sub, "semantic_sim": S.clamp01(F.col("semantic")), "is_honeypot": F.lit(False)})
    score = S.weighted_mean([(F.col("role_substance"), 0.5), (F.col("semantic_sim"), 0.5)])
    best = scoring.select_top(x.withColumns({"candidate_id": F.col("doc_id"), "final_score": score}), 100)
    return best.select("doc_id", "rank", "score", "role_substance", F.round("semantic_sim", 6).alias("semantic_sim"), F.round("rrf", 9).alias("rrf"))
