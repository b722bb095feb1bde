"""Queries over repeated texts, plans of models, sections for prompts and labelled blocks. Inputs are written in terms that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators import chunking, folds, lookahead, presentation
from dossier.plans.registry import load, query

REPEATED = "case doc_id % 6 when 0 then repeat(left(text, 130) || ' ', 4) when 1 then left(text, 95) || '; ' || left(text, 95) || ' ' || left(text, 30) when 2 then left(text, 200) || left(text, 200) || left(text, 90) when 3 then left(text, 60) || chr(10) || chr(10) || left(text, 60) || chr(10) || chr(10) || left(text, 20) when 4 then left(text, 170) else text end"


@query(
    f"""with d as (select doc_id, {REPEATED} as s from documents), t as (select *, trim(s, ' ' || chr(9) || chr(10) || chr(13)) as t from d), p as (select *, list_filter(list_transform(string_split(s, chr(10) || chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') as parts from t),
 u as (select doc_id, t, n, rtrim(left(t, n), ' ' || chr(9) || chr(10) || chr(13)) as unit from (select *, unnest(range(80, least(400, length(t) // 2) + 1)) as n from p where len(parts) <= 1)),
 c as (select doc_id, max_by(unit, n) as unit from u where unit <> '' and length(trim(replace(substr(t, n + 1), unit, ''), ' ' || chr(9) || chr(10) || chr(13))) <= length(unit) // 2 group by doc_id)
 select p.doc_id, md5(case when len(parts) <= 1 then coalesce(c.unit, t) else array_to_string(list_transform(list_filter(range(len(parts)), lambda i: i = 0 or parts[i + 1] <> parts[i]), lambda i: parts[i + 1]), chr(10) || chr(10)) end) as digest from p left join c using (doc_id)"""

)
def repeated_openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that repeat their opening or a paragraph, without the repeats; texts that do not, as they are."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.expr(REPEATED).alias("s"))
    return d.select("doc_id", F.md5(folds.collapsed_paragraphs(F.col("s")).cast("binary")).alias("digest"))


_LOCAL = ("gemma2-2b", "phi3-mini", "llama31-8b", "mixtral-8x7b", "llama31-70b", "own-tiny", "own-huge", "own-odd", "nowhere", " ")
_ONLINE = ("GPT-4o", "gpt-4o-mini", "us.claude-sonnet-4", "gemini-2.5-pro-x", "mistral-small", "deepseek-chat", "unheard", "")


@query(
    f"""with p as (select p_partkey as k, [{", ".join(f"'{x}'" for x in _LOCAL)}][(p_partkey % 10 + 1)::int] as local, [{", ".join(f"'{x}'" for x in _ONLINE)}][(p_partkey % 8 + 1)::int] as model, case p_partkey % 3 when 0 then 'Local' when 1 then 'Online' else 'None' end as backend, case p_partkey % 7 when 0 then 'azure-openai' when 1 then 'missing' when 2 then '' else 'openai' end as provider from part),
 q as (select *, case when backend = 'Local' then case local when 'gemma2-2b' then 'compact' when 'phi3-mini' then 'small' when 'llama31-8b' then 'medium' when 'mixtral-8x7b' then 'large' when 'llama31-70b' then 'extralarge' when 'own-tiny' then 'compact' when 'own-huge' then 'extralarge' when 'own-odd' then 'small' end
  when backend = 'Online' and provider in ('azure-openai', 'openai') then case when provider = 'azure-openai' then 'medium' when model = 'gpt-4o-mini' then 'small' when model = 'mistral-small' or model = 'deepseek-chat' then 'medium' when model in ('unheard', '') then 'small' else 'large' end end as found from p)
 select k as p_partkey, coalesce(found, 'small') as profile, case when backend = 'Local' then case when found is null then 'local:unknown' else local end when found is null then 'online:unknown' else 'online:' || found end as id,
  case when backend = 'Local' and local = 'phi3-mini' then 2000 when backend = 'Local' and local = 'llama31-8b' then 5500 else case coalesce(found, 'small') when 'compact' then 1200 when 'small' then 2400 when 'medium' then 5000 when 'large' then 10000 else 16000 end end::int as max_chars from q"""
)
def model_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How texts are cut for local models of the catalogue, local ones by tier, hosted ones by name or deployment, and unknown ones."""
    k = F.col("p_partkey")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (k % n + 1).cast("int"))
    of = lambda model, deployment: F.struct(model.alias("model"), F.lit(deployment).alias("deployment"))
    settings = F.struct(
        F.when(k % 3 == 0, "Local").when(k % 3 == 1, "Online").otherwise("None").alias("backend"), pick(_LOCAL, 10).alias("local_model"), F.when(k % 7 == 0, "azure-openai").when(k % 7 == 1, "missing").when(k % 7 == 2, "").otherwise("openai").alias("provider"),
        F.create_map(F.lit("openai"), of(pick(_ONLINE, 8), "gpt-4o"), F.lit("azure-openai"), of(F.lit("gpt-4o"), "Mistral-Small-2")).alias("online"),
    )
    tiers = F.create_map(*(F.lit(x) for x in ("own-tiny", "Compact", "own-huge", "ExtraLarge", "own-odd", "Odd", "phi3-mini", "Large")))
    rows = load(spark, sf_dir, "part").select("p_partkey", F.explode(F.array(settings)).alias("s"))
    plan = rows.select("p_partkey", F.explode(F.array(chunking.plan_of(F.col("s"), tiers))).alias("plan"))
    return plan.select("p_partkey", "plan.profile", "plan.id", F.col("plan.max_chars").cast("int").alias("max_chars"))


_ENTRY = {
    "job_title": "case o_orderkey % 3 when 0 then ' ' else 'Dev ' || (o_orderkey % 5) end", "company": "case o_orderkey % 4 when 0 then '' else ' Acme ' end", "description": "case o_orderkey % 5 when 0 then '' else 'did ' || o_orderstatus end",
    "achievements": "case o_orderkey % 6 when 0 then 'won ' else '' end", "degree": "case o_orderkey % 4 when 1 then 'MSc' else '' end", "field_of_study": "case o_orderkey % 3 when 1 then 'Maths' else ' ' end", "institution": "case o_orderkey % 5 when 1 then 'MU Brno' else '' end",
    "category": "case o_orderkey % 4 when 2 then 'Tools' else '' end", "skill": "case o_orderkey % 3 when 2 then 'Go' else ' ' end", "language": "case o_orderkey % 2 when 0 then 'English' else '' end", "proficiency": "o_orderpriority", "name": "case o_orderkey % 7 when 0 then '' else 'P' || (o_orderkey % 9) end", "role": "case o_orderkey % 3 when 0 then 'Lead' else '' end",
}
_J = "array_to_string(list_filter([{0}], lambda x: x <> ''), ' — ')"


@query(
    f"""with o as (select o_custkey as cv, o_orderkey, {", ".join(f"trim({e}) as {n}" for n, e in _ENTRY.items())} from orders),
 l as (select cv, o_orderkey, unnest(['WorkExperience', 'WorkExperience', 'WorkExperience', 'Education', 'Skills', 'Languages', 'Projects', 'Projects']) as section, unnest(range(8)) as k,
  unnest([{_J.format("job_title, company")}, description, achievements, {_J.format("degree, field_of_study, institution")}, array_to_string(list_filter([category, case when skill <> '' then skill || ', x' else 'x' end], lambda x: x <> ''), ': '), {_J.format("language, proficiency")}, {_J.format("name, role")}, description]) as line from o),
 t as (select cv, section, coalesce(string_agg(line, chr(10) order by o_orderkey, k) filter (line <> ''), '') as text, count(distinct o_orderkey)::int as entries from l group by cv, section union all select distinct cv, 'Summary', case when cv % 2 = 0 then 'About ' || cv else '' end, (cv % 2 = 0)::int from o)
 select cv as c_custkey, section, text, entries, length(regexp_replace(text, '\\s', '', 'g'))::int as chars from t"""
)
def section_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The advised sections as texts for a prompt, with their numbers of entries and characters."""
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", *(F.expr(e).alias(n) for n, e in _ENTRY.items()))
    skills = F.array(F.struct(F.col("skill").alias("name")), F.struct(F.lit("x").alias("name")))
    row = F.struct("o_orderkey", F.struct("job_title", "company", "description", "achievements").alias("w"), F.struct("degree", "field_of_study", "institution").alias("e"), F.struct("category", skills.alias("skills")).alias("s"), F.struct("language", "proficiency").alias("l"), F.struct("name", "role", "description").alias("p"))
    own = o.groupBy("c_custkey").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    part = lambda f: F.transform("rows", lambda r: r[f])
    summary = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("About "), F.col("c_custkey").cast("string"), F.lit(" "))).otherwise(" ")
    cv = own.select("c_custkey", F.struct(summary.alias("summary"), part("w").alias("work"), part("e").alias("education"), part("s").alias("skills"), part("l").alias("languages"), part("p").alias("projects")).alias("cv"))
    return cv.select("c_custkey", F.explode(presentation.section_measures(F.col("cv"))).alias("m")).select("c_custkey", "m.*")


LABEL_LINE = "case o_orderkey % 11 when 0 then 'Links' when 1 then 'links ' when 2 then 'Web: x' || o_orderkey when 3 then '' when 4 then 'plain' when 5 then 'Links: y' else 'Git: z' || (o_orderkey % 6) end"


@query(
    f"""with l as (select o_custkey as cv, o_orderkey as pos, trim({LABEL_LINE}) as x from orders), b as (select cv, min(pos) as pos from l where lower(x) = 'links' group by cv),
 e as (select l.cv, min(l.pos) as pos from l join b on l.cv = b.cv and l.pos > b.pos where x <> '' and not contains(x, ':') and lower(x) <> 'links' group by l.cv)
 select l.cv as c_custkey, coalesce(string_agg(x, '|' order by l.pos) filter (contains(x, ':') and l.pos > b.pos and (e.pos is null or l.pos < e.pos)), '') as found from l left join b on l.cv = b.cv left join e on l.cv = e.cv group by l.cv"""
)
def label_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled lines that follow a heading in a text."""
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.expr(LABEL_LINE).alias("line"))
    own = o.groupBy("c_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return own.select("c_custkey", F.array_join(lookahead.labelled_block(F.col("body"), "Links"), "|").alias("found"))
