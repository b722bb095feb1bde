"""Queries over CV-shaped views of the star schema: linkage, orders, quality, validation, readers and writers.

The views stand in for CVs in shape and volume: a customer is a person, orders are jobs, line items are skills.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.functions import dates
from dossier.functions.text import ci_key
from dossier.operators import chunking, extract, layout, lines, linkage, ordering, quality, validation
from dossier.plans.registry import load, query
from dossier.sources import formats, structured, writers, xml_rows
from dossier.streaming import progress


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cv_id, pos, company, start and end, is_current, description) from orders; pos by order key."""
    o = load(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    current = F.col("o_orderstatus") == "O"
    k = F.col("o_orderkey") % 7
    return o.select(
        F.col("o_custkey").alias("cv_id"),
        (F.row_number().over(w) - 1).alias("pos"),
        F.when(k == 0, F.lit(" ")).otherwise(F.col("o_orderpriority")).alias("company"),
        F.when(k != 1, F.month("o_orderdate")).alias("start_month"),
        F.when(k != 2, F.year("o_orderdate")).alias("start_year"),
        F.when(~current, F.month("o_orderdate")).alias("end_month"),
        F.when(~current & (k != 3), F.year("o_orderdate") + 1 - (k == 4).cast("int") * 3).alias("end_year"),
        current.alias("is_current"),
        F.when(k < 3, F.lit("")).when(k < 5, F.lit("Worked on many things for the whole of the company and its clients")).otherwise(F.concat(F.lit("Led "), F.col("o_orderkey").cast("string"))).alias("description"),
    )


JOBS = """jobs as (select o_custkey as cv_id, row_number() over (partition by o_custkey order by o_orderkey) - 1 as pos, case when o_orderkey % 7 = 0 then ' ' else o_orderpriority end as company,
 case when o_orderkey % 7 <> 1 then month(o_orderdate) end as start_month, case when o_orderkey % 7 <> 2 then year(o_orderdate) end as start_year, case when o_orderstatus <> 'O' then month(o_orderdate) end as end_month,
 case when o_orderstatus <> 'O' and o_orderkey % 7 <> 3 then year(o_orderdate) + 1 - case when o_orderkey % 7 = 4 then 3 else 0 end end as end_year, o_orderstatus = 'O' as is_current,
 case when o_orderkey % 7 < 3 then '' when o_orderkey % 7 < 5 then 'Worked on many things for the whole of the company and its clients' else 'Led ' || o_orderkey end as description from orders)"""


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cv_id, gpos, spos, name) from line items and parts: an order's kinds are groups, brands its skills."""
    i, p = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    name = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(" "), F.upper("p_brand"))).otherwise(F.col("p_brand"))
    return i.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("cv_id"), (F.col("p_size") % 3).alias("gpos"), F.col("l_linenumber").alias("spos"), name.alias("name"))


SKILLS = "skills as (select l_orderkey as cv_id, p_size % 3 as gpos, l_linenumber as spos, case when l_linenumber % 2 = 0 then ' ' || upper(p_brand) else p_brand end as name from lineitem join part on l_partkey = p_partkey)"


@query(f"with {SKILLS} select cv_id, gpos, spos, name from (select *, row_number() over (partition by cv_id, lower(trim(name)) order by gpos, spos) as r from skills) where r = 1")
def skill_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.dedupe_skills(skills(spark, sf_dir))


TECH = "tech as (select distinct l_orderkey as cv_id, lower(p_brand) as k from lineitem join part on l_partkey = p_partkey where p_size > 40)"


@query(f"with {SKILLS}, {TECH} select s.cv_id, s.gpos, s.spos, s.name from skills s where not exists (select 1 from tech t where t.cv_id = s.cv_id and t.k = lower(trim(s.name)))")
def skill_minus_tech(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, p = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    tech = i.join(p.where("p_size > 40"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("cv_id"), F.col("p_brand").alias("name"))
    return linkage.skills_without(skills(spark, sf_dir), tech)


@query(
    f"with {SKILLS}, {TECH}, g as (select distinct cv_id, gpos from skills), d as (select * from (select *, row_number() over (partition by cv_id, lower(trim(name)) order by gpos, spos) as r from skills) where r = 1),"
    " k as (select d.* from d where not exists (select 1 from tech t where t.cv_id = d.cv_id and t.k = lower(trim(d.name))))"
    " select g.cv_id, g.gpos, coalesce(string_agg(k.name, ', ' order by k.spos, k.name), '') as names from g left join k on k.cv_id = g.cv_id and k.gpos = g.gpos group by g.cv_id, g.gpos"
)
def skills_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups with what is left of their skills after both steps; empty groups stay."""
    s = skills(spark, sf_dir)
    i, p = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    tech = i.join(p.where("p_size > 40"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("cv_id"), F.col("p_brand").alias("name"))
    kept = linkage.skills_without(linkage.dedupe_skills(s), tech)
    out = linkage.regroup(s.select("cv_id", "gpos").distinct(), kept)
    return out.select("cv_id", "gpos", F.array_join(F.transform("skills", lambda x: x["name"]), ", ").alias("names"))


@query(
    """with b as (select c_custkey as id, case when c_custkey % 3 = 0 then ' ' else c_name end as name, c_mktsegment as title from customer), i as (select s_suppkey + 50 as id, s_name as name, '' as title from supplier)
 select coalesce(b.id, i.id) as id, case when trim(coalesce(b.name, '')) <> '' then b.name else coalesce(i.name, '') end as name, case when trim(coalesce(b.title, '')) <> '' then b.title else coalesce(i.title, '') end as title from b full join i on b.id = i.id"""
)
def merge_fill_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, s = load(spark, sf_dir, "customer"), load(spark, sf_dir, "supplier")
    b = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_name")).alias("name"), F.col("c_mktsegment").alias("title"))
    i = s.select((F.col("s_suppkey") + 50).alias("id"), F.col("s_name").alias("name"), F.lit("").alias("title"))
    return linkage.fill_empty(b, i, "id", ["name", "title"])


@query(
    f"with {JOBS}, u as (select *, case when is_current then 1 else 0 end as src from jobs) select cv_id, pos, company, start_month, start_year, is_current from (select *, row_number() over (partition by cv_id, lower(trim(company)), start_year, start_month order by src, pos) as r from u) where src = 0 or r = 1"
)
def merge_upsert_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ended jobs as baseline, running ones as incoming."""
    j = jobs(spark, sf_dir)
    keys = [F.col("cv_id"), ci_key("company"), F.col("start_year"), F.col("start_month")]
    out = linkage.upsert(j.where("not is_current"), j.where("is_current"), keys, ["pos"])
    return out.select("cv_id", "pos", "company", "start_month", "start_year", "is_current")


@query("select o_orderkey, o_orderpriority as target from orders where o_orderpriority not in ('1-URGENT', '2-HIGH')")
def orphan_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("target"))
    known = spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("2-HIGH",)], "field_key string")
    return linkage.orphan_errors(o, known)


@query(
    f"with {JOBS}, o as (select n, f from (values (0, '1-URGENT'), (1, '3-MEDIUM')) v(n, f)), h as (select cv_id, arg_min(f, n) as f from jobs join o on company = f group by cv_id), r as (select cv_id, arg_min(company, pos) as f from jobs group by cv_id) select r.cv_id, coalesce(h.f, r.f) as field_key from r left join h on r.cv_id = h.cv_id"
)
def first_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = jobs(spark, sf_dir).select("cv_id", "pos", F.col("company").alias("field_key"))
    fields = F.array(*(F.struct(F.lit(n).alias("pos"), F.lit(f).alias("field_key")) for n, f in ((0, "1-URGENT"), (1, "3-MEDIUM"))))
    ordered = j.select("cv_id").distinct().select("cv_id", F.inline(fields))
    return linkage.first_invalid(ordered, j, "cv_id")


@query(
    """select n_name as key, case when n_nationkey % 4 = 0 then 'overlay ' || n_name when n_nationkey % 3 = 0 then 'theme ' || n_name when n_nationkey % 2 = 0 then 'base ' || n_name else n_name end as value from nation"""
)
def localize_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = load(spark, sf_dir, "nation")
    layer = lambda k, name: n.where(F.col("n_nationkey") % k == 0).select(F.col("n_name").alias("key"), F.concat(F.lit(f"{name} "), F.col("n_name")).alias("value"))
    return linkage.layered(n.select(F.col("n_name").alias("key")), layer(2, "base"), layer(3, "theme"), layer(4, "overlay"))


_MODELS = ["gpt-4o-mini", "GPT-4o", "claude-haiku-4", "us.claude-sonnet", "gpt-4.1", "gpt-4.1-nano", "gemini-2.5-pro", "mixtral-8x7b", "mistral-small", "other", " ", "llama3.3-70b", "GPT-4.1-mini-x", "claude-3-5-haiku", "claude-3-5-sonnet", "gemini-2.0-flash", "gemini-flash-8", "open-mistral-nemo", "llama-3.3-70b", "DeepSeek-Chat"]
#: Stated anew, not taken from the operator: the first fragment that a name holds gives its profile.
_PROFILE = """case when contains(lower(model), 'gpt-4o-mini') then 'small' when contains(lower(model), 'gpt-4.1-mini') then 'small' when contains(lower(model), 'gpt-4.1-nano') then 'small' when contains(lower(model), 'claude-3-5-haiku') then 'small'
 when contains(lower(model), 'claude-haiku') then 'small' when contains(lower(model), 'gemini-2.0-flash') then 'small' when contains(lower(model), 'gemini-flash') then 'small' when contains(lower(model), 'open-mistral-nemo') then 'small'
 when contains(lower(model), 'gpt-4o') then 'large' when contains(lower(model), 'gpt-4.1') then 'large' when contains(lower(model), 'claude-sonnet') then 'large' when contains(lower(model), 'claude-3-5-sonnet') then 'large'
 when contains(lower(model), 'gemini-2.5-pro') then 'large' when contains(lower(model), 'llama-3.3-70b') then 'large' when contains(lower(model), 'llama3.3-70b') then 'large' when contains(lower(model), 'mixtral-8x7b') then 'medium'
 when contains(lower(model), 'mistral-small') then 'medium' when contains(lower(model), 'deepseek-chat') then 'medium' else 'small' end"""


@query(
    f"""with m as (select *, list_extract([{", ".join(f"'{x}'" for x in _MODELS)}], (p_partkey % {len(_MODELS)} + 1)::int) || case when p_size % 2 = 0 then '-' || p_name else '' end as model from part)
 select p_partkey, case p_size % 4 when 0 then 'WorkExperience' when 1 then 'Links' when 2 then 'PersonalInformation' end as section, {_PROFILE} as profile from m"""
)
def prefix_section_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of field keys and profiles of model names."""
    p = load(spark, sf_dir, "part")
    key = F.element_at(F.array(F.lit("workExperience.1.company"), F.lit("links.0.url"), F.lit("email"), F.lit("other")), (F.col("p_size") % 4 + 1).cast("int"))
    model = F.element_at(F.array(*map(F.lit, _MODELS)), (F.col("p_partkey") % len(_MODELS) + 1).cast("int"))
    model = F.concat(model, F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("-"), F.col("p_name"))).otherwise(""))
    return p.select("p_partkey", quality.section_of(key).alias("section"), chunking.profile_of(model).alias("profile"))


@query(
    f"""with {JOBS}, s as (select *, trim(company) = '' as draft, coalesce(start_year * 100 + start_month, -1) as st, coalesce(end_year * 100 + end_month, -1) as en from jobs)
 select cv_id, pos, row_number() over (partition by cv_id order by draft, case when not draft then is_current::int end desc nulls last, case when not draft then st end desc nulls last, case when not draft then en end desc nulls last, case when not draft then pos end desc nulls last, pos)::int as rank from s"""
)
def sort_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.rank_jobs(jobs(spark, sf_dir), "cv_id", F.trim("company") == "").select("cv_id", "pos", "rank")


@query(f"with {JOBS}, s as (select *, trim(company) = '' as draft, coalesce(start_year * 100 + start_month, -1) as st from jobs) select cv_id, pos, row_number() over (partition by cv_id order by draft, case when not draft then st end desc nulls last, pos)::int as rank from s")
def sort_cert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.rank_dated(jobs(spark, sf_dir), "cv_id", "start_month", "start_year", F.trim("company") == "").select("cv_id", "pos", "rank")


@query(
    f"""with {JOBS}, n as (select *, count(*) over (partition by cv_id) as c, cv_id % 5 as src, cv_id % 7 - 1 as want from jobs), t as (select *, least(greatest(case when want > src then want - 1 else want end, 0), c - 1) as dst from n)
 select cv_id, pos, (case when src >= c then pos when pos = src then dst when src < dst and pos > src and pos <= dst then pos - 1 when src > dst and pos < src and pos >= dst then pos + 1 else pos end)::bigint as new_pos from t"""
)
def move_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job of each person moves to an index before, after or beyond the others; some persons lack the job."""
    j = jobs(spark, sf_dir).select("cv_id", "pos")
    out = ordering.moved(j, "cv_id", F.col("cv_id") % 5, F.col("cv_id") % 7 - 1)
    return out.select("cv_id", "pos", F.col("new_pos").cast("long").alias("new_pos"))


@query(
    "select user_id, event_id, rank::bigint as rank, greatest(c - 25, 0)::bigint as dropped from (select *, row_number() over (partition by user_id order by event_type, event_id) as rank, count(*) over (partition by user_id) as c from events) where rank <= 25"
)
def topk_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 25 rows of each user, by kind: a top-k report."""
    e = load(spark, sf_dir, "events").withColumn("pos", F.col("event_id"))
    code = F.element_at(F.map_from_arrays(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))), F.array(*map(F.lit, (5, 4, 3, 2, 1)))), F.col("event_type"))
    out = ordering.repair_targets(e, "user_id", code)
    return out.select("user_id", "event_id", F.col("rank").cast("long").alias("rank"), F.col("dropped").cast("long").alias("dropped"))


@query("with l as (select *, row_number() over (partition by event_type order by ts desc, event_id desc) as r from events) select event_type as path, event_id from l where r = 1 order by ts desc limit 8")
def recent_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest row of each path, the newest eight of them: a top-k report."""
    e = load(spark, sf_dir, "events").select(F.col("event_type").alias("path"), "event_id", F.struct("ts", "event_id").alias("at"))
    return ordering.recent(e, "path", "at").select("path", "event_id")


@query(
    """with r as (select p_partkey, p_size - 5 as a, p_size + (p_partkey % 60) - 5 as b from part) select p_partkey, case when a < 1 or b > 60 then 'out_of_bounds' when a > b then 'reversed' when b - a + 1 > 50 then 'too_many' end as error,
 case when a < 1 or b > 60 or a > b or b - a + 1 > 50 then -1 else b - a + 1 end::int as pages from r"""
)
def page_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    r = ordering.page_range(F.lit(60), F.col("p_size") - 5, F.col("p_size") + (F.col("p_partkey") % 60).cast("int") - 5)
    return p.select("p_partkey", r["error"].alias("error"), F.when(r["error"].isNull(), F.size(r["pages"])).otherwise(-1).alias("pages"))


def cvs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """CV views for the quality rules."""
    c = load(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    blank = F.lit("")
    url = F.concat(F.lit("https://www.example.com/"), k.cast("string"), F.lit("/"))
    personal = c.select(
        k.alias("cv_id"),
        F.when(k % 11 != 0, F.col("c_name")).otherwise(blank).alias("first_name"),
        blank.alias("last_name"),
        F.when(k % 5 == 0, blank).otherwise(F.col("c_mktsegment")).alias("title"),
        F.when(k % 11 != 0, F.lit("a@b.c")).otherwise(blank).alias("email"),
        blank.alias("phone"),
        url.alias("linkedin_url"),
        blank.alias("github_url"),
        blank.alias("portfolio_url"),
        F.repeat(F.col("c_mktsegment"), (k % 90).cast("int")).alias("summary"),
        blank.alias("additional"),
    )
    s = skills(spark, sf_dir)
    some = lambda n: c.where(k % n == 0)
    entry = [k.alias("cv_id"), F.lit(0).alias("pos")]
    return {
        "personal": personal,
        "work": jobs(spark, sf_dir).select("cv_id", "pos", "description"),
        "education": some(2).select(*entry),
        "skill": s,
        "language": some(3).select(*entry),
        "certificate": some(7).select(*entry),
        "project": some(4).select(*entry, F.when(k % 8 == 0, " ").otherwise("text").alias("description"), blank.alias("highlights")),
        "link": some(6).select(*entry, F.when(k % 12 == 0, F.concat(F.lit("example.com/"), k.cast("string"))).otherwise("https://other.org").alias("url")),
    }


HINTS = f"""{JOBS}, {SKILLS}, p as (select c_custkey as id, c_custkey % 11 <> 0 as named, c_custkey % 5 <> 0 as titled, length(c_mktsegment) * (c_custkey % 90) as n from customer),
 w as (select cv_id, count(*) as n from jobs group by cv_id), sk as (select distinct cv_id from skills),
 s as (select p.*, coalesce(w.n, 0) > 0 as work, id % 2 = 0 as edu, sk.cv_id is not null as skill, id % 3 = 0 as lang, id % 7 = 0 as cert, id % 4 = 0 as proj, id % 6 = 0 as link from p left join w on w.cv_id = id left join sk on sk.cv_id = id),
 t as (select *, named or titled or n > 0 or work or edu or skill or lang or cert or proj or link as started from s),
 hints as (select id as cv_id, 'personal.summary-too-short' as hint_id, 'shortSummary' as field_key, null::varchar as entry_id from t where n > 0 and n < 80
 union all select id, 'personal.summary-too-long', 'shortSummary', null from t where n > 600
 union all select id, 'personal.summary-missing', 'shortSummary', null from t where started and n = 0 and (work or edu)
 union all select id, 'personal.missing-title', 'professionalTitle', null from t where started and not titled
 union all select id, 'work.section-empty', null, null from t where started and not work and (edu or skill or lang or cert or proj or link or titled or named or n > 0)
 union all select id, 'education.section-empty', null, null from t where started and not edu and (work or skill or lang or cert or proj or link or titled or named or n > 0)
 union all select id, 'skills.section-empty', null, null from t where started and not skill
 union all select id, 'languages.section-empty', null, null from t where work and not lang
 union all select id, 'certificates.section-empty', null, null from t where started and not cert and (work or edu or skill or lang or proj or link or titled or named or n > 0)
 union all select id, 'projects.section-empty', null, null from t where started and not proj and (work or edu or skill or lang or cert or link or titled or named or n > 0)
 union all select cv_id, 'work.entry-missing-description', 'workExperience.' || pos || '.description', pos::varchar from jobs where description = ''
 union all select cv_id, 'work.generic-description', 'workExperience.' || pos || '.description', pos::varchar from jobs where starts_with(description, 'Worked')
 union all select cv_id, 'skills.single-large-group', null, gpos::varchar from skills group by cv_id, gpos having count(*) > 15
 union all select id, 'projects.entry-missing-description', 'projects.0.description', '0' from t where proj and id % 8 = 0
 union all select id, 'links.duplicate-personal-url', 'links.0.url', '0' from t where link and id % 12 = 0)"""


@query(f"with {HINTS} select cv_id, hint_id, field_key, entry_id from hints")
def hints_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(cvs(spark, sf_dir)).select("cv_id", "hint_id", "field_key", "entry_id")


CONF = "conf as (select cv_id, 'workExperience.' || pos || '.description' as field_key, case when pos % 2 = 0 then 'Low' else 'High' end as confidence from jobs)"


@query(
    f"with {HINTS}, {CONF}, low as (select * from conf where confidence = 'Low') select cv_id, 'import.review-section' as hint_id, 'WorkExperience' as section, null::varchar as field_key from low group by cv_id having count(*) >= 2"
    " union all select l.cv_id, 'import.review-field', 'WorkExperience', l.field_key from low l where exists (select 1 from hints h where h.cv_id = l.cv_id and h.field_key = l.field_key)"
)
def hints_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    conf = jobs(spark, sf_dir).select("cv_id", F.concat(F.lit("workExperience."), F.col("pos").cast("string"), F.lit(".description")).alias("field_key"), F.when(F.col("pos") % 2 == 0, "Low").otherwise("High").alias("confidence"))
    return quality.review_hints(quality.content_hints(cvs(spark, sf_dir)), conf).select("cv_id", "hint_id", "section", "field_key")


@query(f"with {HINTS} select cv_id, hint_id || '|' || coalesce(entry_id, '') || '|' || coalesce(field_key, '') as dismiss_key from hints where not (cv_id % 2 = 0 and hint_id = 'skills.section-empty')")
def hints_dismissed(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = load(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("cv_id"), F.lit("skills.section-empty||").alias("dismiss_key"))
    return quality.report(cvs(spark, sf_dir), dismissed=gone).select("cv_id", "dismiss_key")


@query(
    f"""with {JOBS}, v as (select cv_id, pos, 'company' as field, company as value from jobs union all select cv_id, pos, 'startMonth', start_month::varchar from jobs union all select cv_id, pos, 'endYear', (end_year + 150)::varchar from jobs
 union all select cv_id, pos, 'companyUrl', case when pos % 2 = 0 then 'http://x.y' else 'nope' end from jobs union all select cv_id, pos, 'technologies', repeat(company, 60) from jobs)
 select cv_id, pos, field, 'required' as message from v where field in ('company', 'startMonth') and trim(coalesce(value, '')) = '' union all select cv_id, pos, field, 'format' from v where field = 'endYear' and value is not null and value::int > 2100
 union all select cv_id, pos, field, 'format' from v where field = 'companyUrl' and value = 'nope' union all select cv_id, pos, field, 'too_long' from v where field = 'technologies' and length(trim(value)) > 500"""
)
def validate_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = jobs(spark, sf_dir)
    pairs = [
        ("company", F.col("company")), ("startMonth", F.col("start_month").cast("string")), ("endYear", (F.col("end_year") + 150).cast("string")),
        ("companyUrl", F.when(F.col("pos") % 2 == 0, "http://x.y").otherwise("nope")), ("technologies", F.repeat("company", 60)),
    ]
    values = F.explode(F.array(*(F.struct(F.lit(n).alias("field"), c.alias("value")) for n, c in pairs)))
    long = j.select("cv_id", "pos", values.alias("x")).select("cv_id", "pos", F.lit("work").alias("section"), "x.field", "x.value")
    return validation.violations(long, validation.rules(spark)).select("cv_id", "pos", "field", "message")


@query(f"with {SKILLS} select cv_id, gpos, spos from (select *, row_number() over (partition by cv_id, gpos, lower(trim(name)) order by spos) as r from skills) where r > 1")
def validate_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.repeats(skills(spark, sf_dir), ["cv_id", "gpos"], "name", ["spos"]).select("cv_id", "gpos", "spos")


@query(f"with {JOBS} select cv_id, pos, coalesce(not is_current and start_month between 1 and 12 and end_month between 1 and 12 and start_year * 100 + start_month > end_year * 100 + end_month, false) as wrong_order, case when not is_current and end_year is null then 'end_year_required' else '' end as missing from jobs")
def validate_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = [F.col(x) for x in ("start_month", "start_year", "end_month", "end_year", "is_current")]
    return jobs(spark, sf_dir).select("cv_id", "pos", validation.date_order(*c).alias("wrong_order"), F.array_join(validation.end_missing(c[2], c[3], c[4]), ",").alias("missing"))


@query(f"with {JOBS}, d as (select cv_id, case when pos % 2 = 0 then 'a' else 'b' end as target, company as message, min(pos) as p from jobs where trim(company) <> '' group by 1, 2, 3) select cv_id, target, string_agg(message, chr(10) order by p) as messages from d group by cv_id, target")
def message_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = jobs(spark, sf_dir).select("cv_id", "pos", F.when(F.col("pos") % 2 == 0, "a").otherwise("b").alias("target"), F.col("company").alias("message"))
    return linkage.message_map(j, "cv_id")


@query(
    "select doc_id, case when length(coalesce(text, '')) < 100 then 0 else (case when doc_id % 5 = 0 then 1 else 0 end) + (case when doc_id % 5 <> 0 and doc_id % 6 <= 2 then 2 else 0 end) + (case when doc_id % 5 <> 0 and (doc_id % 8 >= 5 or (doc_id % 2 = 0 and doc_id % 6 <= 4)) then 4 else 0 end)"
    " + (case when doc_id % 5 <> 0 and doc_id % 6 between 3 and 4 then 16 else 0 end) + (case when doc_id % 5 <> 0 and doc_id % 8 >= 1 then 32 else 0 end) end::int as flags from documents"
)
def trigger_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    long = F.length(F.coalesce("text", F.lit(""))) >= 100
    flags = chunking.trigger_flags(long, F.lit(80), k % 5 != 0, F.lit(True), k % 6, k % 8, k % 2 == 0)
    return load(spark, sf_dir, "documents").select("doc_id", flags.cast("int").alias("flags"))


@query(
    """with e as (select user_id, event_id, case when event_type in ('view', 'click') then 'engine' else 'model' end as phase, least(100, greatest(0, floor(value * 10)::bigint)) as pct from events),
 r as (select *, sum(case when phase = before then 0 else 1 end) over (partition by user_id order by event_id) as run from (select *, coalesce(lag(phase) over (partition by user_id order by event_id), '') as before from e))
 select user_id, event_id, phase, max(pct) over (partition by user_id, run order by event_id)::bigint as shown from r"""
)
def progress_running_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    phase = F.when(F.col("event_type").isin("view", "click"), "engine").otherwise("model")
    rows = e.select("user_id", "event_id", phase.alias("phase"), F.least(F.lit(100), F.greatest(F.lit(0), F.floor(F.col("value") * 10).cast("long"))).alias("pct"))
    return progress.running_max(rows, "user_id", "event_id").select("user_id", "event_id", "phase", "shown")


@query("select event_id, case when event_id % 3 = 0 then 'OwnJson' when event_id % 3 = 1 then 'JsonResume' else 'Unknown' end as flavour, case when event_id % 3 = 2 then null else (json_extract(props, '$.k'))::varchar end as k from events")
def json_flavour(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    k = F.col("event_id") % 3
    text = F.when(k == 0, F.concat(F.lit(f'{{"{formats.OWN_KEY}": 1, "p": '), F.col("props"), F.lit("}"))).when(k == 1, F.concat(F.lit('{"work": [], "p": '), F.col("props"), F.lit("}"))).otherwise(F.lit("[1, "))
    return e.select("event_id", formats.json_flavour(text).alias("flavour"), F.get_json_object(text, "$.p.k").alias("k"))


@query("select event_id, event_type as status, case when event_id % 4 <> 0 then event_id end as completed from events where event_id % 5 <> 0")
def ndjson_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    done = F.when(F.col("event_id") % 4 != 0, F.concat(F.lit(', "completed": '), F.col("event_id").cast("string"))).otherwise("")
    line = F.when(F.col("event_id") % 5 == 0, F.lit("{broken")).otherwise(F.concat(F.lit('{"status": "'), F.col("event_type"), F.lit('"'), done, F.lit("}")))
    return progress.parse_lines(e.select("event_id", line.alias("value"))).select("event_id", "status", "completed")


@query("select c_custkey as cv_id, split_part(c_name, '#', 1) || '#' || split_part(c_name, '#', 2) as first_name, 'Doe' as last_name, 'x' || c_custkey || '@example.com' as email, c_mktsegment as location, 'Hobby: Go' as extra, case when c_custkey % 2 = 0 then 'extra_rows_ignored' end as warning from customer")
def tabular_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    more = F.when(F.col("c_custkey") % 2 == 0, F.lit("\nother,row")).otherwise("")
    text = F.concat(F.lit('Full Name,"E-mail",City,Hobby\r\n'), F.col("c_name"), F.lit(" Doe, x"), F.col("c_custkey").cast("string"), F.lit("@example.com,"), F.col("c_mktsegment"), F.lit(", Go"), more)
    t = structured.tabular(c.select(F.col("c_custkey").alias("cv_id"), text.alias("text")))
    return t.select("cv_id", "first_name", "last_name", "email", "location", "extra", "warning")


@query("select c_custkey as cv_id, 'Ann' as first_name, 'van ' || c_mktsegment as last_name, 'https://linkedin.com/in/' || c_custkey as linkedin_url, 2::int as jobs, 3::int as start_month, 2019::int as start_year, true as second_current, case when c_custkey % 3 = 0 then 'unreadable' end as error from customer where c_custkey % 3 <> 0 union all select c_custkey, '', '', '', -1, null, null, null, 'unreadable' from customer where c_custkey % 3 = 0")
def json_resume_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    text = F.concat(
        F.lit('{ // comment\n"basics": {"name": "Ann van '), F.col("c_mktsegment"), F.lit('", "profiles": [{"network": "LinkedIn", "url": "https://linkedin.com/in/'), k.cast("string"),
        F.lit('"},]}, "work": [{"company": "A // B", "position": "Dev", "startDate": "2019-03", "endDate": "2020-01-31"}, {"name": "C", "startDate": "2021", "endDate": "Present"}], }'),
    )
    text = F.when(k % 3 == 0, F.lit("{")).otherwise(text)
    r = structured.json_resume(c.select(k.alias("cv_id"), text.alias("text")))
    first, second = F.get("work", F.lit(0)), F.get("work", F.lit(1))
    name = lambda f: F.coalesce(F.col(f"personal.{f}"), F.lit(""))
    return r.select("cv_id", name("first_name").alias("first_name"), name("last_name").alias("last_name"), name("linkedin_url").alias("linkedin_url"), F.coalesce(F.size("work"), F.lit(-1)).alias("jobs"), first["start_month"].alias("start_month"), first["start_year"].alias("start_year"), second["is_current"].alias("second_current"), "error")


def cv_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cv_id, text): a written CV of every customer with orders."""
    o, c = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    entry = F.concat(F.lit("Role "), F.col("o_orderstatus"), F.lit(" at Company "), F.col("o_orderpriority"), F.lit("\n"), F.date_format("o_orderdate", "MM/yyyy"), F.lit(" - "), F.when(F.col("o_orderstatus") == "O", "Present").otherwise(F.date_format(F.add_months("o_orderdate", 12), "MM/yyyy")), F.lit("\nDid work"))
    each = o.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", entry.alias("e")))), lambda x: x["e"]), "\n").alias("work"))
    joined = c.join(each, F.col("c_custkey") == F.col("o_custkey"))
    text = F.concat(
        F.lit("Jane Doe\njane"), F.col("c_custkey").cast("string"), F.lit("@example.com\n+421 900 123 456\n\nSummary:\nWorks in "), F.col("c_mktsegment"), F.lit("\n\nWork Experience\n"), F.col("work"),
        F.lit("\n\nSKILLS\nTools: Spark, "), F.col("c_mktsegment"), F.lit("\n- Python\n\nEducation\n\nLanguages\nEnglish: C1\nSlovak - Native\n\nSkills\nDocker"),
    )
    return joined.select(F.col("c_custkey").alias("cv_id"), text.alias("text"))


CV = """e as (select o_custkey, string_agg('Role ' || o_orderstatus || ' at Company ' || o_orderpriority || chr(10) || strftime(o_orderdate, '%m/%Y') || ' - ' || case when o_orderstatus = 'O' then 'Present' else strftime(o_orderdate + interval 12 month, '%m/%Y') end || chr(10) || 'Did work', chr(10) order by o_orderkey) as work, count(*) as n from orders group by o_custkey),
 cv as (select c_custkey as cv_id, c_mktsegment as seg, work, n from customer join e on c_custkey = o_custkey)"""


@query(
    f"with {CV} select cv_id, 'Header' as section, 'Jane Doe' || chr(10) || 'jane' || cv_id || '@example.com' || chr(10) || '+421 900 123 456' as body from cv union all select cv_id, 'Summary', 'Works in ' || seg from cv union all select cv_id, 'WorkExperience', work from cv"
    " union all select cv_id, 'Skills', 'Tools: Spark, ' || seg || chr(10) || '- Python' || chr(10) || chr(10) || 'Docker' from cv union all select cv_id, 'Languages', 'English: C1' || chr(10) || 'Slovak - Native' from cv"
)
def segment_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.segment(cv_texts(spark, sf_dir), "cv_id").select("cv_id", "section", "body")


@query(f"with {CV} select cv_id, n::bigint as jobs, 'Jane' as first_name, 'Doe' as last_name, 'jane' || cv_id || '@example.com' as email, 4::bigint as skills, 2::bigint as languages from cv")
def extract_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the written CVs: the whole text pipeline."""
    r = extract.import_texts(cv_texts(spark, sf_dir), "cv_id")
    n = F.aggregate("skills", F.lit(0), lambda a, g: a + F.size(g["names"]))
    return r.select("cv_id", F.size("work").cast("long").alias("jobs"), "personal.first_name", "personal.last_name", "personal.email", n.cast("long").alias("skills"), F.size("languages").cast("long").alias("languages"))


@query(f"with {CV}, w as (select o_custkey as cv_id, row_number() over (partition by o_custkey order by o_orderkey) - 1 as pos, 'Role ' || o_orderstatus as job_title, 'Company ' || o_orderpriority as company, year(o_orderdate)::int as start_year, month(o_orderdate)::int as start_month, (o_orderstatus = 'O') as is_current, 'Did work' as description from orders where o_custkey in (select c_custkey from customer)) select cv_id, pos::int as pos, job_title, company, start_year, start_month, is_current, description from w")
def extract_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = extract.import_texts(cv_texts(spark, sf_dir), "cv_id").select("cv_id", F.posexplode("work").alias("pos", "w"))
    return r.select("cv_id", "pos", "w.job_title", "w.company", "w.start_year", "w.start_month", "w.is_current", "w.description")


@query(f"with {JOBS} select cv_id, pos::int as pos, company, start_month::int as start_month, start_year::int as start_year, is_current, description from jobs")
def structured_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs written as the engine's JSON and read again."""
    j = jobs(spark, sf_dir).select("cv_id", F.struct("pos", "company", "start_month", "start_year", "is_current", "description").alias("w"))
    cv = j.groupBy("cv_id").agg(F.array_sort(F.collect_list("w")).alias("work"))
    written = cv.select("cv_id", writers.own_json(F.struct("work")).alias("text"))
    schema = "struct<work: array<struct<pos: int, company: string, start_month: int, start_year: int, is_current: boolean, description: string>>>"
    read = structured.own_json(written, schema)
    return read.select("cv_id", F.explode("cv.work").alias("w")).select("cv_id", "w.*")


_X = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
EXPORT = """k as (select c_custkey as cv_id, 'Ann' || c_custkey as first_name, case when c_custkey % 3 = 0 then '' else 'O"Neil & ' || c_mktsegment end as last_name, 'a' || c_custkey || '@x.org' as email, case when c_custkey % 2 = 0 then 'Uses <b> | 100%' else '' end as summary from customer),
 p as (select *, case when last_name = '' then first_name else first_name || ' ' || last_name end as person from k),
 x as (select *, replace(replace(person, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') as quoted from p)"""


EXPORTED = f"""{EXPORT}, e as (select cv_id, unnest(['csv', 'tsv', 'yaml', 'europass_xml', 'md', 'html', 'txt', 'json_resume']) as format, unnest([
  'firstName,lastName,email,phone,location,professionalTitle,summary' || chr(10) || first_name || ',' || case when contains(last_name, '"') then '"' || replace(last_name, '"', '""') || '"' else last_name end || ',' || email || ',,,,' || summary || chr(10),
  replace('firstName,lastName,email,phone,location,professionalTitle,summary', ',', chr(9)) || chr(10) || first_name || chr(9) || case when contains(last_name, '"') then '"' || replace(last_name, '"', '""') || '"' else last_name end || chr(9) || email || chr(9) || chr(9) || chr(9) || chr(9) || summary || chr(10),
  'basics:' || chr(10) || '  name: "' || quoted || '"' || chr(10) || '  label: ""' || chr(10) || '  email: "' || email || '"' || chr(10) || '  summary: "' || summary || '"' || chr(10),
  '<SkillsPassport><Identification><FirstName>' || first_name || '</FirstName>' || case when last_name <> '' then '<Surname>' || {_X.format("last_name")} || '</Surname>' else '' end || '<Email>' || email || '</Email></Identification></SkillsPassport>',
  '# ' || person || chr(10) || chr(10) || case when summary <> '' then '## Summary' || chr(10) || chr(10) || replace(summary, '|', chr(92) || '|') || chr(10) || chr(10) else '' end,
  '<!DOCTYPE html><html><body><h1>' || {_X.format("person")} || '</h1>' || case when summary <> '' then '<h2>Summary</h2><p>' || {_X.format("summary")} || '</p>' else '' end || '</body></html>',
  person || chr(10) || chr(10) || case when summary <> '' then 'Summary' || chr(10) || summary || chr(10) || chr(10) else '' end,
  '{{"basics":{{"name":"' || quoted || '","email":"' || email || '"' || case when summary <> '' then ',"summary":"' || summary || '"' else '' end || '}}}}']) as content from x)"""


@query(f"with {EXPORTED} select cv_id, format, content from e")
def export_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons in eight text formats: quotes, markup and empty fields are written by each format's rules."""
    return writers.export(persons(spark, sf_dir), "cv_id", ("csv", "tsv", "yaml", "europass_xml", "md", "html", "txt", "json_resume"))


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CV rows of customers that hold a person only."""
    c = load(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    blank = F.lit("")
    fields = {
        "first_name": F.concat(F.lit("Ann"), k.cast("string")), "last_name": F.when(k % 3 == 0, blank).otherwise(F.concat(F.lit('O"Neil & '), F.col("c_mktsegment"))), "title": blank,
        "email": F.concat(F.lit("a"), k.cast("string"), F.lit("@x.org")), "phone": blank, "location": blank, "linkedin_url": blank, "github_url": blank, "portfolio_url": blank,
        "summary": F.when(k % 2 == 0, "Uses <b> | 100%").otherwise(blank),
    }
    schema = spark.createDataFrame([], extract.CV).schema
    lists = [F.array().cast(f.dataType).alias(f.name) for f in schema if f.dataType.typeName() == "array"]
    return c.select(k.alias("cv_id"), F.struct(*(v.alias(n) for n, v in fields.items())).alias("personal"), *lists, blank.alias("additional"))


@query(
    """select c_custkey as cv_id, case c_custkey % 4 when 0 then 'JsonResume' when 1 then 'OwnJson' else 'Unknown' end as flavour, case when c_custkey % 4 < 3 then c_name end as name, case c_custkey % 4 when 0 then c_custkey when 1 then 2 end::bigint as years, case when c_custkey % 4 = 0 then true end as flag from customer"""
)
def yaml_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """YAML mappings with typed scalars, the engine's own key in any case, other mappings, and texts that are none."""
    c = load(spark, sf_dir, "customer")
    k, name = F.col("c_custkey"), F.col("c_name")
    j = lambda *y: F.concat(*(F.lit(z) if isinstance(z, str) else z for z in y))
    text = (
        F.when(k % 4 == 0, j('basics:\n  name: "', name, '"\nwork:\n- name: A\n  years: ', k.cast("string"), "\n  flag: true\n"))
        .when(k % 4 == 1, j(f'{formats.OWN_KEY.upper()}: 2\nbasics: {{name: "', name, '"}\n')).when(k % 4 == 2, j('who:\n  name: "', name, '"\n'))
        .otherwise(j("- ", name, "\n- : : [\n"))
    )
    r = structured.yaml_to_json(c.select(k.alias("cv_id"), text.alias("text")))
    get = lambda p: F.get_json_object("json", p)
    years = F.coalesce(get("$.work[0].years"), get(f"$.{formats.OWN_KEY.upper()}")).cast("long")
    return r.select("cv_id", "flavour", F.coalesce(get("$.basics.name"), get("$.who.name")).alias("name"), years.alias("years"), get("$.work[0].flag").cast("boolean").alias("flag"))


@query(
    """select c_custkey as cv_id, case when c_custkey % 4 < 3 then 'Ann' || case when c_custkey % 4 = 2 then ' ' || c_custkey else '' end end as first_name, case when c_custkey % 4 < 3 then c_mktsegment end as last_name,
 case c_custkey % 4 when 0 then 1 when 1 then 2 when 2 then 0 else -1 end as jobs, case when c_custkey % 4 < 2 then 2001 + c_custkey % 10 end::int as start_year, case when c_custkey % 4 = 0 then 2014 end::int as end_year, case c_custkey % 4 when 0 then false when 1 then true end as is_current, case when c_custkey % 4 = 3 then 'unreadable' end as error from customer"""
)
def xml_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XML CVs: one job, two jobs with one running, none, and texts that are refused or malformed."""
    c = load(spark, sf_dir, "customer")
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    j = lambda *y: F.concat(*(F.lit(z) if isinstance(z, str) else z for z in y))
    year = (k % 10 + 2001).cast("string")
    job = lambda span: j("<x:WorkExperience><x:Employer><x:Name>A</x:Name></x:Employer><x:Period>", span, "</x:Period></x:WorkExperience>")
    head = lambda first: j('<x:SkillsPassport xmlns:x="urn:x"><x:FirstName>', first, "</x:FirstName><x:Surname>", seg, "</x:Surname>")
    text = (
        F.when(k % 4 == 0, j(head("Ann"), job(j(year, " 2014")), "</x:SkillsPassport>"))
        .when(k % 4 == 1, j(head("Ann"), job(j(year, " present")), "<x:WorkExperience><x:Position>Dev</x:Position></x:WorkExperience></x:SkillsPassport>"))
        .when(k % 4 == 2, j(head(j(" Ann  ", k.cast("string"))), "</x:SkillsPassport>"))
        .when(k % 8 == 3, j("<!DOCTYPE a><a>", seg, "</a>")).otherwise(j("<a>", seg))
    )
    r = xml_rows.xml_cv(c.select(k.alias("cv_id"), text.alias("text")), True)
    first = F.get("work", F.lit(0))
    return r.select("cv_id", "first_name", "last_name", F.coalesce(F.size("work"), F.lit(-1)).alias("jobs"), first["start_year"].alias("start_year"), first["end_year"].alias("end_year"), first["is_current"].alias("is_current"), "error")


@query(
    """with recursive b as (select o_custkey as page_id, o_orderkey::varchar as text, (o_orderkey * 37 % 200)::int as top, (o_orderkey % 500)::int as left_, (o_orderkey % 7 + 8)::int as height from orders),
 p as (select page_id, list({'t': top, 'l': left_, 'x': text} order by top, left_, text) as boxes, ceil(1.5 * list_sort(list(height))[count(*) // 2 + 1])::int as tolerance from b group by page_id),
 g(page_id, boxes, tolerance, n, first, line) as (select page_id, boxes, tolerance, 1, boxes[1].t, 0 from p
  union all select page_id, boxes, tolerance, n + 1, case when abs(boxes[n + 1].t - first) > tolerance then boxes[n + 1].t else first end, case when abs(boxes[n + 1].t - first) > tolerance then line + 1 else line end from g where n < len(boxes)),
 r as (select page_id, line, boxes[n] as b from g)
 select page_id, line::int as pos, string_agg(b.x, ' ' order by b.l, b.t, b.x) as line from r group by page_id, line"""
)
def ocr_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pages of boxes: rows compare with their first box, and read from left to right."""
    o = load(spark, sf_dir, "orders")
    top, key = (F.col("o_orderkey") * 37 % 200).cast("int"), F.col("o_orderkey")
    boxes = o.select(F.col("o_custkey").alias("page_id"), key.cast("string").alias("text"), top.alias("top"), (key % 500).cast("int").alias("left"), (top + key % 7 + 8).cast("int").alias("bottom"), (key % 500 + 40).cast("int").alias("right"))
    return layout.reading_order(boxes)


@query(f"with {JOBS} select cv_id, pos, case when start_month is not null and start_year is not null then lpad(start_month::varchar, 2, '0') || ' / ' || start_year when start_year is not null then start_year::varchar else '-' end || ' – ' || case when is_current then 'Present' when end_month is not null and end_year is not null then lpad(end_month::varchar, 2, '0') || ' / ' || end_year when end_year is not null then end_year::varchar else '-' end as label from jobs")
def date_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = [F.col(x) for x in ("start_month", "start_year", "end_month", "end_year", "is_current")]
    return jobs(spark, sf_dir).select("cv_id", "pos", dates.range_label(*c).alias("label"))
