"""Queries over rules that look at the lines around one. Each customer's orders are lines of a section; SQL works on a row a line with windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators import lookahead
from dossier.plans.registry import load, query

#: The text of an order's line, in terms that both engines read alike.
SKILL_LINE = """case o_orderkey % 19 when 0 then 'Tool' || (o_orderkey % 97) || ' · Expert · ' || (o_orderkey % 9 + 1) || ' years' when 1 then 'Go · Beginner' when 2 then 'Backend' when 3 then 'Cloud & Edge'
 when 4 then 'Tools: Spark, Kafka' || (o_orderkey % 7) when 5 then '- Item' || (o_orderkey % 11) when 6 then 'Redis, Tool' || (o_orderkey % 5) || ', with words' when 7 then 'Rust' when 8 then ''
 when 9 then 'Acme S.R.O. Brno' when 10 then 'Technologies:' when 11 then 'Mia Novak' when 12 then ' General ' when 13 then 'Designed' when 14 then 'Infrastructurework' when 15 then 'Label: '
 when 16 then 'Data and Science' when 17 then '- with care' else 'General: Perl' end"""
JOB_LINE = """case o_orderkey % 13 when 0 then 'Engineer ' || (o_orderkey % 7) when 1 then 'Acme · Brno · 03 / 2019 – 04 / 2020' when 2 then 'Dev at Firm' || (o_orderkey % 5) when 3 then '2019 - 2021' when 4 then 'built things'
 when 5 then 'Firm · FULL-TIME' when 6 then 'Lead - Unit' when 7 then ' ' when 8 then '02/2020 - Present' when 9 then 'x · y' when 10 then 'Boss at Y · 2018 - current' when 11 then 'Current' else 'Helper a.s. team' end"""


def section(spark: SparkSession, sf_dir: str, line: str) -> DataFrame:
    """(c_custkey, body): the lines of each customer's orders."""
    lines = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.expr(line).alias("line"))
    own = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))), lambda x: x["line"])
    return lines.groupBy("c_custkey").agg(F.array_join(own, "\n").alias("body"))


def said(words: str, c: str) -> str:
    return rf"regexp_matches({c}, '(?i)(^|[^\p{{L}}\p{{N}}_])({words})($|[^\p{{L}}\p{{N}}_])')"


DATE = r"regexp_matches({0}, '(^|[^0-9])(19[5-9][0-9]|20[0-9][0-9])([^0-9]|$)')"
BLEED = f"(regexp_matches({{0}}, '(?i) s\\.r\\.o\\.| a\\.s\\.|full-time|part-time') or {DATE})"
N_WORDS = "len(list_filter(string_split({0}, ' '), lambda w: w <> ''))"
_NO_SKILL = "and|with|for|the|to|in|on|of|as|at|by|from|into|leading|worked|built|uses|delivered|integrated|designed|implemented|contributed|collaborated|developed|experienced|strong|senior|full|stack|developer|project|technologies|contact|email|phone|location"
_CATEGORIES = "'general', 'backend', 'frontend', 'programming', 'devops', 'languages', 'languages & runtimes', 'backend & apis', 'data & storage', 'cloud & devops', 'observability', 'security', 'architecture', 'leadership', 'testing', 'mobile & edge', 'ai & automation'"
_SAID = "designed|implemented|built|contributed|collaborated|delivered|integrated|worked|senior|project|platforms|development|oauth|focus|high|uses"


def plausible(c: str) -> str:
    pair = rf"({N_WORDS.format(c)} = 2 and regexp_matches({c}, '^\p{{Lu}}\S*\s+\p{{Lu}}') and not regexp_matches({c}, '[.#+]'))"
    return f"(length({c}) between 2 and 48 and {N_WORDS.format(c)} <= 4 and not {DATE.format(c)} and not {pair} and not {said(_NO_SKILL, c)})"


def standalone(c: str) -> str:
    return f"({plausible(c)} and (regexp_matches({c}, '[.#+/]') or (length({c}) <= 16 and not contains({c}, ' '))))"


SKILLS = f"""l as (select o_custkey as cv, row_number() over (partition by o_custkey order by o_orderkey) as pos, trim({SKILL_LINE}) as x from orders),
 p as (select *, list_filter(list_transform(string_split(x, '·'), lambda y: trim(y)), lambda y: y <> '') as parts, {BLEED.format("x")} as bleed, lower(rtrim(x, ':')) in ('technologies', 'achievements', 'company url', 'institution url') as sub, regexp_matches(x, '^\\p{{Lu}}\\p{{L}}+ \\p{{Lu}}\\p{{L}}+$') as person from l),
 s as (select *, case when contains(x, '·') and not bleed and len(parts) in (2, 3) and {plausible("parts[1]")} then parts[1] end as skill, bleed or sub or person as other from p),
 n as (select *, count(skill) over (partition by cv) > 0 as native, count(skill) over (partition by cv order by pos rows between 1 following and 4 following) > 0 as followed,
  length(x) between 2 and 40 and (lower(x) in ({_CATEGORIES}) or not (contains(x, ' ') or contains(x, '·') or contains(x, ',') or bleed or sub or {standalone("x")} or regexp_matches(x, '(?i)^({_SAID})($|[^a-z0-9_])'))) as plain from s),
 c as (select *, case when not native then plain when regexp_matches(x, '(?i)^({_SAID}|mobile|developed)($|[^a-z0-9_])') or contains(x, '·') or contains(x, ':') or starts_with(x, '- ') or other then false
  when lower(x) in ({_CATEGORIES}) or contains(x, '&') or contains(lower(x), ' and ') then followed or plain else followed and plain and not {standalone("x")} end as category from n)"""


@query(
    f"""with {SKILLS} select cv as c_custkey, count(skill)::int as skills, coalesce(string_agg((pos - 1)::varchar, ',' order by pos) filter (category), '') as categories,
 coalesce((min(pos) filter (skill is not null or lower(x) = 'general' or category)) - 1, 0)::int as first from c group by cv"""
)
def skill_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines of skill sections open a category, by what follows them, and from which line on the section counts."""
    rows = lookahead.with_skill_lines(section(spark, sf_dir, SKILL_LINE))
    opened = lookahead.places(F.transform("skill_lines", lambda e: e["opens"]))
    kept = F.size(F.split(lookahead.trimmed_skills(F.col("body"), F.col("skill_lines")), "\n", -1))
    skills = F.size(F.filter("skill_lines", lambda e: e["skill"].isNotNull()))
    return rows.select("c_custkey", skills.alias("skills"), F.array_join(opened.cast("array<string>"), ",").alias("categories"), (F.size("skill_lines") - kept).alias("first"))


@query(
    f"""with {SKILLS}, e as (select cv, pos, x, case when x = '' or other then 0 when skill is not null then 1 when contains(x, ':') then case when trim(regexp_replace(x, '^[^:]*:', '')) = '' then 0 else 2 end when starts_with(x, '- ') then 1
  when contains(x, ',') then case when len(list_filter(string_split(x, ','), lambda y: {plausible("trim(y)")})) >= 2 then 1 else 0 end when category then 3 when not native and {standalone("x")} then 1 else 0 end as kind, skill from c),
 i as (select *, case kind when 0 then [] when 3 then [] else list_filter(list_transform(case when skill is not null then [skill] when kind = 2 then string_split(regexp_replace(x, '^[^:]*:', ''), ',') when starts_with(x, '- ') then [substr(x, 3)] when contains(x, ',') then string_split(x, ',') else [x] end, lambda y: trim(y)), lambda y: {plausible("y")}) end as names,
  case kind when 2 then trim(split_part(x, ':', 1)) when 3 then x end as category, last_value(case when kind >= 2 then pos end ignore nulls) over w as before, last_value(case when kind >= 2 then kind end ignore nulls) over w as open from e window w as (partition by cv order by pos rows unbounded preceding)),
 f as (select cv, min(pos) filter (kind = 1 and coalesce(open, 0) <> 3) as first from i group by cv),
 g as (select f.cv, first, min(pos) as there from f left join i on i.cv = f.cv and i.kind >= 2 and lower(i.category) = 'general' and i.pos < first group by f.cv, first),
 m as (select cv, pos as grp, category from i where kind >= 2 union all select cv, first, 'General' from g where first is not null and there is null),
 t as (select i.cv, case when kind >= 2 then pos when open = 3 then before else coalesce(there, first) end as grp, pos, unnest(names) as name, unnest(range(len(names))) as k from i join g using (cv) where kind > 0)
 select m.cv as c_custkey, (row_number() over (partition by m.cv order by m.grp) - 1)::int as place, category, coalesce(string_agg(name, '|' order by pos, k), '') as names from m left join t on t.cv = m.cv and t.grp = m.grp group by m.cv, m.grp, category"""
)
def skill_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of skills read from sections in five notations."""
    rows = lookahead.with_skill_lines(section(spark, sf_dir, SKILL_LINE)).select("c_custkey", F.posexplode(lookahead.skill_groups(F.col("skill_lines"))).alias("place", "g"))
    return rows.select("c_custkey", "place", "g.category", F.array_join("g.names", "|").alias("names"))


JOBS = f"""l as (select o_custkey as cv, o_orderkey, trim({JOB_LINE}) as x from orders), n as (select cv, row_number() over (partition by cv order by o_orderkey) as pos, x from l where x <> ''),
 d as (select *, {DATE.format("x")} as dated, contains(x, '·') as dotted, contains(x, '·') and (regexp_matches(x, '·[^·]*[12][0-9][0-9][0-9][^·]*$') or regexp_matches(x, '(?i) s\\.r\\.o\\.| a\\.s\\.|full-time|part-time')) as meta,
  contains(x, ' - ') or contains(lower(x), ' at ') or contains(lower(x), ' s.r.o.') or contains(lower(x), ' a.s.') as header from n),
 s as (select *, (not dotted and not dated and coalesce(lead(meta) over (partition by cv order by pos), false)) or (not dotted and header and count(*) filter (dated) over (partition by cv order by pos rows between 1 following and 3 following) > 0) as starts from d),
 b as (select *, count(*) filter (starts) over (partition by cv order by pos rows unbounded preceding) as block from s),
 c as (select cv, block, min(pos) as first, string_agg(x, chr(10) order by pos) as body from b group by cv, block)"""


@query(f"with {JOBS} select cv as c_custkey, (row_number() over (partition by cv order by first) - 1)::int as place, body from c")
def work_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of a section, told apart by what the lines after a title say."""
    rows = section(spark, sf_dir, JOB_LINE).select("c_custkey", F.posexplode(lookahead.work_blocks(F.col("body"))).alias("place", "lines"))
    return rows.select("c_custkey", "place", F.array_join("lines", "\n").alias("body"))


@query(
    f"""with {JOBS}, m as (select cv, pos, x, case when lower(x) = 'current' then case when pos > 1 or cv % 2 = 0 then 'alone' end when regexp_matches(x, '(?i)[12][0-9]{{3}} - (present|current)$') then 'range' end as how from n where pos <= 8),
 f as (select cv, min(pos) as pos from m where how is not null group by cv), o as (select distinct cv from n)
 select o.cv as c_custkey, m.how is not null as current, case when how = 'range' and contains(x, '/') then split_part(x, '/', 1)::int end as start_month, case when how = 'range' then regexp_extract(x, '([12][0-9][0-9][0-9])', 1)::int end as start_year
 from o left join f on o.cv = f.cv left join m on m.cv = f.cv and m.pos = f.pos"""
)
def present_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of a job's lines that says it goes on, and the start that it gives."""
    rows = section(spark, sf_dir, JOB_LINE).select("c_custkey", lookahead.lines_of(F.col("body")).alias("lines")).where(F.size("lines") > 0)
    mark = lookahead.present_mark(F.col("lines"), F.when(F.col("c_custkey") % 2 == 0, 2000))
    rows = rows.select("c_custkey", F.explode(F.array(mark)).alias("m"))
    return rows.select("c_custkey", F.col("m").isNotNull().alias("current"), "m.start_month", "m.start_year")


STUDY_LINE = """case o_orderkey % 13 when 0 then 'MSc Maths ' || (o_orderkey % 5) when 1 then 'University of Brno ' || (o_orderkey % 3) when 2 then '2010 - 2014' when 6 then 'and Technology' when 7 then 'Thesis on graphs' when 8 then 'School of' when 9 then 'Brno, Czechia'
 when 10 then ' Diploma work' when 11 then 'Grade: A' when 12 then 'PhD' else '' end"""
_DEGREE = "regexp_matches({0}, '(?i)bachelor|master|bsc|msc|phd|doctor|diploma|ing\\.|bc\\.')"
_TITLE = "(regexp_matches({0}, '(?i)^(MSc|BSc|PhD|MEng|MBA|Bachelor|Master|Doctor)\\b') and not regexp_matches({0}, '(?i)·|field of study:|^grade:|^institution url:|^thesis focus'))"
_SCHOOL = "regexp_matches({0}, '(?i)high school|university|college|academy|institute|gymnaz|gymnáz|stredna skola|stredná škola|electrical engineering| and training')"
_CUT = f"(not {_SCHOOL} and (ends_with(lower({{0}}), ' of') or regexp_matches({{0}}, '(?i)\\b(high school|school|university|college|academy)\\s+of\\s+[\\p{{{{L}}}}\\s]+$')))"
_PLACE = "(regexp_matches({0}, '^\\p{{L}}[^0-9.#,]*, *\\p{{L}}[^0-9.#,]*$') and not contains({0}, ' - '))"
_LINES = "list_filter(list_transform(string_split({0}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def _is(rule: str, c: str) -> str:
    return rule.format(c)


@query(
    f"""with recursive l as (select o_custkey as cv, string_agg({STUDY_LINE}, chr(10) order by o_orderkey) as body, list(trim({STUDY_LINE}) order by o_orderkey) as lines from orders group by o_custkey),
 p as (select *, list_filter(list_transform(string_split(body, chr(10) || chr(10)), lambda b: trim(b, ' ' || chr(10))), lambda b: b <> '') as paras, list_filter(lines, lambda x: x <> '') as own from l),
 v as (select *, len(paras) >= 2 and len(list_filter(paras, lambda b: len({_LINES.format("b")}) >= 2 and {_is(_SCHOOL, _LINES.format("b") + "[1]")} and ({_is(_TITLE, _LINES.format("b") + "[2]")} or {_is(_DEGREE, _LINES.format("b") + "[2]")}))) >= greatest(2, len(paras) // 2) as school_first,
  coalesce({_is(_TITLE, "list_filter(lines, lambda x: " + _is(_TITLE, "x") + " or " + DATE.format("x") + ")[1]")}, false) as degree_first, list_filter(range(len(own)), lambda i: i = 0 or {_is(_TITLE, "own[i + 1]")}) as starts from p),
 d as (select *, list_transform(range(len(starts)), lambda k: array_to_string(own[starts[k + 1] + 1:coalesce(starts[k + 2], len(own))], chr(10))) as by_degree from v),
 b as (select cv, case when not school_first and degree_first and len(starts) > 1 then by_degree else paras end as blocks from d where len(own) > 0),
 g(cv, blocks, n, done) as (select cv, blocks, 1, [blocks[1]] from b union all
  select cv, blocks, n + 1, case when not ({DATE.format("x[1]")} or {_is(_DEGREE, "x[1]")}) and (starts_with(lower(x[1]), 'and ') or {_is(_CUT, "y[-1]")} or (len(list_filter(x, lambda z: length(z) >= 80 or {DATE.format("z")} or {_is(_PLACE, "z")} or {_is(_DEGREE, "z")})) = 0 and len(list_filter(y, lambda z: {DATE.format("z")} or {_is(_SCHOOL, "z")} or {_is(_CUT, "z")})) > 0))
   then list_append(done[1:len(done) - 1], done[-1] || chr(10) || blocks[n + 1]) else list_append(done, blocks[n + 1]) end from (select *, {_LINES.format("blocks[n + 1]")} as x, {_LINES.format("done[-1]")} as y from g where n < len(blocks)))
 select cv as c_custkey, unnest(range(len(done)))::int as place, unnest(done) as body from g where n = len(blocks)"""
)
def education_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of education sections: the layout that blocks vote for, and continuations that belong to the entry before."""
    rows = section(spark, sf_dir, STUDY_LINE)
    return rows.select("c_custkey", F.posexplode(lookahead.education_section(F.col("body"))).alias("place", "body"))
