"""Queries over names sought outside the header, sidebar skills, presentation, gates and limits. SQL works each rule out anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators import lookahead, names, presentation
from dossier.plans.cv_queries import JOBS, jobs
from dossier.plans.entry_queries import joined
from dossier.plans.line_queries import texts
from dossier.plans.registry import load, query

NAMES = """c as (select c_custkey, c_custkey % 6 as k, 'O' || lower(c_mktsegment) as seg from customer)"""


@query(
    f"""with {NAMES} select c_custkey, case k when 0 then 'Mia' when 1 then 'Anna' when 2 then 'Jan' when 3 then seg when 4 then null else null end as first_name, case k when 0 then 'Nova ' || seg when 1 then seg when 2 then 'Novak ' || seg when 3 then 'Maier' end as last_name,
 case k when 0 then 'Contact' when 1 then 'Skills' when 2 then 'WorkExperience' when 3 then 'Summary' end as section, case k when 4 then 'tail' else case when k = 5 then '' else 'end ' || c_custkey end end as last from c"""
)
def name_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names found in other sections when the header has none, in order; the last line of a block."""
    c = load(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 6
    seg = F.concat(F.lit("O"), F.lower("c_mktsegment"))
    contact = F.when(k == 0, joined("phone 1\nMia Nova ", seg, "\nDocker Redis")).otherwise("a@b.cd")
    skills = F.when(k == 1, joined("Docker\nAnna\n", seg, "\nReact Redis")).otherwise("React\nTypeScript Redis")
    work = F.when(k == 2, joined("Senior Developer\nAl Bo\nJan Novak ", seg)).otherwise("Engineer\n2020 - 2021")
    summary = F.when(k == 3, joined("I did\n", seg, " Maier\nx")).when(k == 4, F.concat(F.repeat(F.lit("words of it\n"), 25), F.lit("Eva Mala"))).otherwise("x y")
    sections = F.create_map(*(x for s, v in (("Header", F.lit("h")), ("Contact", contact), ("Skills", skills), ("WorkExperience", work), ("Summary", summary)) for x in (F.lit(s), v)))
    block = F.when(k == 4, "a\n tail \n\n").when(k == 5, " \n").otherwise(joined("x\n\nend ", F.col("c_custkey").cast("string"), "\n "))
    # Generators work their input out once; plain columns would be made anew for every use.
    c = c.select("c_custkey", names.last_line(block).alias("last"), F.explode(F.array(sections)).alias("sections"))
    c = c.select("c_custkey", "last", F.explode(F.array(names.name_elsewhere(F.col("sections")))).alias("found"))
    return c.select("c_custkey", "found.first_name", "found.last_name", "found.section", "last")


@query(
    f"""with {NAMES} select c_custkey, case k when 0 then 'Mia' when 1 then seg when 2 then 'Jan' when 3 then 'Eva' end as first_name, case k when 0 then seg when 1 then 'Novak' when 2 then 'Maier' when 3 then seg end as last_name, case when k % 2 = 0 then 'Eva Mala,' else '' end || 'Tools ' || c_custkey as groups, k in (0, 4) as repeated, case when k = 3 then seg || '|y|z|a|b ' || c_custkey else 'x|' || seg || '|a|b ' || c_custkey end as lines from c"""
)
def sidebar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names above an address in a sidebar, groups that are only a name, repeated titles, all lines of a text in order."""
    c = load(spark, sf_dir, "customer")
    k = F.col("c_custkey") % 6
    seg = F.concat(F.lit("O"), F.lower("c_mktsegment"))
    rows = texts(k, [
        F.array(F.lit("Mia"), seg, F.lit("a@b.cd")), F.array(seg, F.lit("City: Brno"), F.lit("Novak"), F.lit("a@b.cd")), F.array(F.lit("Docker"), F.lit("Jan"), F.lit(""), F.lit("Maier"), F.lit("Phone"), F.lit("x a@b.cd")),
        F.array(F.lit("a@b.cd"), F.lit("Eva"), seg, F.lit("b@c.de")), F.array(F.lit("Eva"), F.lit("a@b.cd")), F.array(F.lit("Eva"), seg),
    ])
    found = names.name_before_email(rows, r"\S+@\S+\.\S+")
    group = lambda category, n: F.struct(category.alias("category"), F.array_repeat(F.lit("s"), n).alias("names"))
    kept = names.without_person_groups(F.array(group(F.lit("Eva Mala"), (k % 2 == 0).cast("int")), group(joined("Tools ", F.col("c_custkey").cast("string")), F.lit(0))))
    sections = F.create_map(F.lit("Skills"), joined("a\n\n b ", F.col("c_custkey").cast("string")), F.lit("Header"), F.when(k == 3, joined(seg, "\ny\n\nz")).otherwise(joined("x\n ", seg, " ")))
    return c.select(
        "c_custkey", found["first_name"].alias("first_name"), found["last_name"].alias("last_name"), F.array_join(F.transform(kept, lambda g: g["category"]), ",").alias("groups"), names.repeats_title(joined(" ", seg, " "), texts(k % 4, [F.upper(seg), joined(seg, "x"), F.lit(""), F.lit("x")])).alias("repeated"),
        F.array_join(names.personal_lines(sections), "|").alias("lines"),
    )


@query(
    """with p as (select p_partkey, p_partkey % 4 as k, p_brand, p_type from part)
 select p_partkey, case k when 0 then 'Spark|' || p_brand || '|Kafka' when 1 then p_type || '|Docker' when 2 then 'Go|' || p_brand else '' end as tokens, case k when 1 then 'general' || chr(10) || 'x' when 2 then 'Go · Expert · 5 yrs' || chr(10) || '- ' || p_brand else 'as ' || p_brand end as body from p"""
)
def sidebar_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills that a sidebar lists in four notations, and skills sections from their first mark on."""
    p = load(spark, sf_dir, "part")
    k, brand, kind = F.col("p_partkey") % 4, F.col("p_brand"), F.col("p_type")
    body = texts(k, [joined("Tools: Spark, ", brand, "\nspark, Kafka, with words\nplain"), joined("- ", kind, "\n\n- Docker\n- docker"), joined("intro\nGo · Expert · 5 yrs\n- ", brand), F.lit("plain\nNode")])
    skills = texts(k, [joined("as ", brand), F.lit("said\n general\nx").cast("string"), joined("intro\nGo · Expert · 5 yrs\n- ", brand), joined("as ", brand)])
    p = lookahead.with_skill_lines(p.select("p_partkey", F.array_join(names.sidebar_tokens(body), "|").alias("tokens"), skills.alias("skills")), "skills")
    return p.select("p_partkey", "tokens", lookahead.trimmed_skills(F.col("skills"), F.col("skill_lines")).alias("body"))


_RANGE = "case when start_month is not null and start_year is not null then lpad(start_month::varchar, 2, '0') || ' / ' || start_year when start_year is not null then start_year::varchar else '-' end || ' – ' || case when is_current then 'Now' when end_month is not null and end_year is not null then lpad(end_month::varchar, 2, '0') || ' / ' || end_year when end_year is not null then end_year::varchar else '-' end"


@query(
    f"""with {JOBS}, e as (select cv_id, pos, trim(company) as company, case when pos % 3 = 0 then '' else 'Dev ' || pos end as title, case when pos % 2 = 0 then 'Full-time' else 'Odd' end as kind, {_RANGE} as dates, description, case when pos % 4 = 0 then 'Won' else '' end as won from jobs),
 v as (select *, case when title = '' then '-' else title end || chr(10) || case when company = '' then '-' else company end || ' · ' || kind || ' · ' || dates || case when description <> '' then chr(10) || description else '' end || case when won <> '' then chr(10) || 'Achievements:' || chr(10) || won else '' end || chr(10) || 'Technologies: Go' as block,
  array_to_string(list_filter([array_to_string(list_filter([title, company], lambda x: x <> ''), ' — '), description, won], lambda x: x <> ''), chr(10)) as line from e)
 select cv_id, string_agg(block, chr(10) || chr(10) order by pos) as preview, coalesce(string_agg(line, chr(10) order by pos) filter (line <> ''), '') as said from v group by cv_id"""
)
def work_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs as a preview shows them and as a prompt describes them."""
    pos = F.col("pos")
    e = F.struct(
        F.when(pos % 3 == 0, " ").otherwise(joined("Dev ", pos.cast("string"))).alias("job_title"), "company", F.lit(" ").alias("location"), F.when(pos % 2 == 0, "FullTime").otherwise("Odd").alias("employment_type"),
        "start_month", "start_year", "end_month", "end_year", "is_current", "description", F.when(pos % 4 == 0, "Won").otherwise("").alias("achievements"), F.lit("Go").alias("technologies"), F.lit("").alias("company_url"),
    )
    cv = jobs(spark, sf_dir).groupBy("cv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", e.alias("e")))), lambda x: x["e"]).alias("work"))
    views = F.transform("work", lambda w: presentation.work_view(w, {"FullTime": "Full-time"}, "Now"))
    return cv.select("cv_id", presentation.work_preview(views).alias("preview"), presentation.describe_work(F.col("work")).alias("said"))


@query(
    """with p as (select p_partkey, p_partkey % 3 as k, p_name, p_brand, p_size from part)
 select p_partkey, case when k = 0 then '-' else p_name end as category, p_brand || ':Top' || case when p_size % 2 = 0 then ',x:Odd' else '' end as skills, case when k = 0 then '' else p_name || ': ' end || p_brand || case when p_size % 2 = 0 then ', x' else '' end as said from p"""
)
def skills_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skill groups as shown, with labels of levels and without unnamed skills, and as a prompt describes them."""
    p = load(spark, sf_dir, "part")
    skill = lambda name, level: F.struct(name.alias("name"), F.lit(level).alias("proficiency"), F.lit(None).cast("int").alias("years"))
    category = F.when(F.col("p_partkey") % 3 == 0, " ").otherwise(F.col("p_name"))
    g = F.struct(category.alias("category"), F.array(skill(F.lit(" "), "Expert"), skill(F.col("p_brand"), "Expert"), skill(F.when(F.col("p_size") % 2 == 0, "x").otherwise(""), "Odd")).alias("skills"))
    p = p.select("p_partkey", F.explode(F.array(g)).alias("g"))
    v = presentation.group_view(F.col("g"), {"Expert": "Top"})
    shown = F.array_join(F.transform(v["skills"], lambda s: F.concat(s["name"], F.lit(":"), s["level"])), ",")
    return p.select("p_partkey", v["category"].alias("category"), shown.alias("skills"), presentation.describe_skills(F.array("g")).alias("said"))


@query(
    """with p as (select p_partkey, p_partkey % 8 as k, p_size, p_name from part)
 select p_partkey, case k when 0 then p_size >= 30 when 1 then p_size % 3 > 0 and p_size > 0 when 2 then p_size % 3 > 0 and p_size > 0 else false end as offered, case k when 0 then 800 when 1 then 600 else 2000 end as longest, case k when 0 then 'ShortenProfessionalSummary' when 1 then 'DraftSkillsFromContext' when 2 then 'ImproveWorkDescription' end as task,
  case when k in (0, 1) then 'engine' else 'model' end as phase, k < 5 as job, case k when 0 then 'Modern' when 1 then 'Classic' end as template, case k when 0 then p_name when 3 then '' end as title from p"""
)
def advisor_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When advice is offered, how long answers may be, tasks of hints, phases and states of downloads, templates, JSON texts."""
    p = load(spark, sf_dir, "part")
    k, size, name = F.col("p_partkey") % 8, F.col("p_size"), F.col("p_name")
    none = F.lit(None).cast("string")
    section = texts(k, [F.lit("Summary"), F.lit("Skills"), F.lit("WorkExperience"), F.lit("Links")])
    task = texts(k, [F.lit("DraftProfessionalSummary"), F.lit("ShortenProfessionalSummary"), F.lit("DraftWorkDescription"), F.lit("Other")])
    hint = texts(k, [F.lit("personal.summary-too-long"), F.lit("skills.section-empty"), F.lit("work.generic-description"), F.lit("links.section-empty")])
    status = texts(k, [F.lit(" "), F.lit("engine.start"), F.lit("pulling"), name])
    state = texts(k, [*map(F.lit, presentation.ACTIVE_STATES), F.lit("Idle")])
    keywords = texts(k, [F.lit("cv; template:Modern"), F.lit("template:None Template:Classic"), F.lit("template:modern"), none])
    body = texts(k, [joined('{"title": "', name, '"}'), F.lit('{"title": 5}'), F.lit('{"other": "x"}'), F.lit('{"title": ""}'), F.lit("{broken"), F.lit("[1]"), F.lit('{"title": null}'), none])
    return p.select(
        "p_partkey", presentation.advisable(section, size % 3, F.repeat(F.lit("x "), size)).alias("offered"), presentation.answer_limit(task).alias("longest"), presentation.task_of_hint(hint).alias("task"),
        presentation.phase_of(status, ("engine.start",)).alias("phase"), presentation.has_job(state).alias("job"), presentation.template_of(keywords, ("Modern", "Classic")).alias("template"), presentation.json_text(body, "title").alias("title"),
    )


@query(
    f"""with {JOBS} select cv_id, count(*)::int as n, case when cv_id % 3 = 0 then null when cv_id % 3 = 1 then 'dark' else 'own "' || cv_id || '"' end as theme, 1::bigint as version, strftime(timestamp '2020-01-02 03:04:05' + to_days(cv_id::int), '%Y-%m-%dT%H:%M:%SZ') as saved_at, string_agg(company, '|' order by pos) as companies from jobs group by cv_id"""
)
def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Project files: content, settings and the time of saving, written and read again."""
    cv = jobs(spark, sf_dir).groupBy("cv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "company"))).alias("work"))
    theme = F.when(F.col("cv_id") % 3 == 1, "dark").when(F.col("cv_id") % 3 == 2, joined('own "', F.col("cv_id").cast("string"), '"'))
    saved = F.lit("2020-01-02 03:04:05").cast("timestamp") + F.make_dt_interval(F.col("cv_id").cast("int"))
    body = presentation.project_json(F.struct("work"), F.struct(theme.alias("theme")), saved)
    files = cv.select("cv_id", body.alias("text"))
    get = lambda path: F.get_json_object("text", path)
    work = F.from_json(get("$.work"), "array<struct<pos:int,company:string>>")
    companies = F.array_join(F.transform(work, lambda w: w["company"]), "|")
    return files.select("cv_id", F.size(work).alias("n"), companies.alias("companies"), get("$.projectSettings.settings.theme").alias("theme"), get("$.dossierVersion").cast("long").alias("version"), get("$.projectSettings.savedAt").alias("saved_at"))


@query("select 'left' as side, n_name from nation where n_nationkey % 3 = 0 and n_nationkey % 2 <> 0 union all select 'right', n_name from nation where n_nationkey % 2 = 0 and n_nationkey % 3 <> 0")
def table_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that two tables do not share, by the side that has them."""
    n = load(spark, sf_dir, "nation")
    return presentation.same_rows(n.where("n_nationkey % 3 = 0").select("n_name"), n.where("n_nationkey % 2 = 0").select("n_name"))
