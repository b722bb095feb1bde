"""Queries over line predicates, entries and folds. Their lines are made from table columns, the rules are worked out in SQL anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions import cues, entries
from dossier.operators import folds, lines
from dossier.plans.cv_queries import JOBS, jobs
from dossier.plans.registry import load, query

LINES = "l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents)"


def any_of(words: tuple[str, ...], column: str = "line") -> str:
    """SQL: whether a text holds one of the words, in any case."""
    return "(" + " or ".join(f"contains(lower({column}), '{w}')" for w in words) + ")"


def word_of(words: tuple[str, ...], column: str = "line") -> str:
    """SQL: whether a text holds one of the words as a word, in any case."""
    return rf"regexp_matches({column}, '(?i)(^|[^\p{{L}}\p{{N}}_])({'|'.join(words)})($|[^\p{{L}}\p{{N}}_])')"


DATED = r"regexp_matches({0}, '(^|[^0-9])(19[5-9][0-9]|20[0-9][0-9])([^0-9]|$)')"
HEADER = "(contains({0}, ' - ') or contains(lower({0}), ' at ') or contains(lower({0}), ' s.r.o.') or contains(lower({0}), ' a.s.'))"
PARTS = "list_filter(list_transform(string_split({0}, ','), lambda x: trim(x)), lambda x: x <> '')"
WORDS = "len(list_filter(string_split({0}, ' '), lambda x: x <> ''))"
PAIR = "(len(parts) = 2 and regexp_matches(parts[1], '^\\p{L}[^0-9.#]*$') and regexp_matches(parts[2], '^\\p{L}[^0-9.#]*$'))"


def texts(k: Column, choices: list[Column]) -> Column:
    """One of some texts by a number."""
    out = choices[-1]
    for n, c in enumerate(choices[:-1]):
        out = F.when(k == n, c).otherwise(out)
    return out


@query(
    f"""with {LINES} select doc_id, count(*) filter (regexp_matches(line, '^[^ .,:]{{1,30}}$'))::bigint as tokens, count(*) filter ({any_of(cues.INSTITUTION)})::bigint as institutions, count(*) filter ({any_of(cues.DEGREE)})::bigint as degrees,
 count(*) filter ({HEADER.format("line")})::bigint as headers,
 count(*) filter (trim(line) <> '' and not {any_of(cues.INSTITUTION)} and (ends_with(lower(line), ' of') or (regexp_matches(line, '(?i)(^|[^\\p{{L}}\\p{{N}}_])(high school|school|university|college|academy)\\s+of\\s+[\\p{{L}}\\s]+$') and not {word_of(cues.FIELDS_OF_STUDY)})))::bigint as cut from l group by doc_id"""
)
def line_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document by what they look like."""
    found = lines.explode_lines(load(spark, sf_dir, "documents"))
    x = F.col("line")
    return found.groupBy("doc_id").agg(
        F.count_if(cues.sidebar_token(x)).alias("tokens"),
        F.count_if(cues.institution(x)).alias("institutions"),
        F.count_if(cues.degree(x)).alias("degrees"),
        F.count_if(cues.work_header(x)).alias("headers"),
        F.count_if(cues.incomplete_institution(x)).alias("cut"),
    )


PLACES = """p as (select p_partkey, case p_partkey % 9 when 0 then p_brand || ', ' || p_type when 1 then 'Spark, Kafka, ' || p_type when 2 then 'Berlin, ' || p_type when 3 then 'we used ' || p_brand || ', which was nice'
 when 4 then p_name || ', ' || p_type || ' using it' when 5 then 'Node.js, ' || p_name when 6 then '.NET, ' || p_brand when 7 then repeat(upper(p_name) || ', ', p_size % 9 + 1) || p_type else p_name end as line from part)"""


def place_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p_partkey, line): comma lists, places and prose."""
    p = load(spark, sf_dir, "part")
    brand, kind, name = F.col("p_brand"), F.col("p_type"), F.col("p_name")
    choices = [
        F.concat_ws(", ", brand, kind), F.concat(F.lit("Spark, Kafka, "), kind), F.concat(F.lit("Berlin, "), kind), F.concat(F.lit("we used "), brand, F.lit(", which was nice")),
        F.concat(name, F.lit(", "), kind, F.lit(" using it")), F.concat(F.lit("Node.js, "), name), F.concat(F.lit(".NET, "), brand),
        F.concat(F.expr("repeat(concat(upper(p_name), ', '), p_size % 9 + 1)"), kind), name,
    ]
    return p.select("p_partkey", texts(F.col("p_partkey") % 9, choices).alias("line"))


@query(
    f"""with {PLACES}, s as (select *, {PARTS.format("line")} as parts from p),
 t as (select *, length(line) > 72 or (contains(line, '.') and not contains(lower(line), '.net')) or regexp_matches(line, '^\\p{{Ll}}') or {any_of(cues.PROSE, "(' ' || line || ' ')")}
  or len(list_filter(parts, lambda x: {WORDS.format("x")} > 4 or {word_of(cues.PROSE_WORDS, "x")})) > 0 as prose from s)
 select p_partkey, prose, contains(line, ',') and len(parts) >= 2 and len(list_filter(parts, lambda x: length(x) > 40)) = 0 and not prose and not {PAIR} as technologies,
  contains(line, ',') and not {HEADER.format("line")} and not {DATED.format("line")} and {PAIR} as place from t"""
)
def list_or_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose, technology lists and places among made-up lines."""
    x = F.col("line")
    return place_lines(spark, sf_dir).select("p_partkey", cues.prose(x).alias("prose"), cues.technology_list(x).alias("technologies"), cues.location(x).alias("place"))


EDU = """h as (select p_partkey, case p_partkey % 7 when 0 then ['Bachelor of ' || p_name, 'University of ' || p_type] when 1 then ['School of', p_type] when 2 then [p_type || ' College'] when 3 then ['and ' || p_name, p_type]
  when 4 then ['Master of ' || p_name, p_type, 'Institute ' || p_brand] when 5 then [p_name, p_brand] else ['MSc ' || p_name, p_type] end as head,
 repeat(p_name || ' ', p_size % 12) || case when p_partkey % 3 = 0 then 'college' else '' end as said, case when p_partkey % 4 = 0 then 'Engineering' else p_type end as school, case when p_partkey % 5 = 0 then 'and ' || p_name when p_partkey % 5 = 1 then 'High school' else p_name end as what from part)"""


@query(
    f"""with {EDU}, j as (select *, array_to_string(head, ' ') as one, len(head) as n from h),
 k as (select *, len(list_filter(head, lambda x: starts_with(lower(x), 'and '))) > 0 as joined,
  n >= 2 and {any_of(cues.DEGREE, "head[1]")} and ((n >= 3 and {any_of(cues.INSTITUTION, "head[-1]")}) or (n = 2 and {any_of(cues.STANDALONE_INSTITUTION, "head[-1]")})) as apart,
  {any_of(cues.INSTITUTION, "one")} or (n >= 2 and not {any_of(cues.INSTITUTION, "head[1]")} and ends_with(lower(head[1]), ' of')) as named from j)
 select p_partkey, joined or (not apart and named) as single, trim(said) <> '' and (length(said) > 80 or ({WORDS.format("said")} > 12 and not {any_of(cues.INSTITUTION, "said")})) as description,
  starts_with(lower(what), 'and ') or (lower(school) = 'engineering' and not contains(lower(what), 'school')) as garbage from k"""
)
def education_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Education headers that name one institution, descriptions, and fragments."""
    p = load(spark, sf_dir, "part")
    k, name, kind, brand = F.col("p_partkey"), F.col("p_name"), F.col("p_type"), F.col("p_brand")
    c = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    heads = [
        F.array(c("Bachelor of ", name), c("University of ", kind)), F.array(F.lit("School of"), kind), F.array(c(kind, " College")), F.array(c("and ", name), kind),
        F.array(c("Master of ", name), kind, c("Institute ", brand)), F.array(name, brand), F.array(c("MSc ", name), kind),
    ]
    said = F.concat(F.expr("repeat(concat(p_name, ' '), p_size % 12)"), F.when(k % 3 == 0, "college").otherwise(""))
    school = F.when(k % 4 == 0, F.lit("Engineering")).otherwise(kind)
    what = F.when(k % 5 == 0, c("and ", name)).when(k % 5 == 1, "High school").otherwise(name)
    return p.select("p_partkey", cues.single_institution(texts(k % 7, heads)).alias("single"), cues.education_description(said).alias("description"), cues.garbage_education(school, what).alias("garbage"))


SKILL_LINES = """s as (select p_partkey, case p_partkey % 13 when 0 then p_brand when 1 then 'C' || repeat('+', p_size % 4) when 2 then p_name when 3 then 'Jane ' || upper(left(p_type, 1)) || lower(substr(p_type, 2)) when 4 then 'jane@x' || p_size || '.org'
  when 5 then 'Senior' when 6 then 'Frontend' when 7 then 'Data & Storage' when 8 then p_type || ' and ' || p_name when 9 then '0' || (p_size % 9 + 1) || '/20' || lpad((p_size % 30)::varchar, 2, '0') when 10 then 'Dev · Full-time' when 11 then 'Reading: C' || (p_size % 2 + 1) else lower(p_type) || '/' || p_size end as line from part)"""
PLAUSIBLE = f"""(length(line) between 2 and 48 and {WORDS.format("line")} <= 4 and not regexp_matches(line, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{{2,}}') and not {DATED.format("line")}
 and not ({WORDS.format("line")} = 1 and lower(line) in ({", ".join(f"'{w}'" for w in cues.SKILL_STOP_WORDS)})) and not ({WORDS.format("line")} = 2 and regexp_matches(line, '^\\p{{Lu}}\\S*\\s+\\p{{Lu}}') and not regexp_matches(line, '[.#+]')) and not {word_of(cues.NO_SKILL_WORDS)})"""
STANDALONE = f"({PLAUSIBLE} and (regexp_matches(line, '[.#+/]') or (length(line) <= 16 and not contains(line, ' '))))"
KNOWN = "(lower(line) in ({}))".format(", ".join(f"'{w}'" for w in cues.CATEGORIES))
BLEED = f"({any_of(cues.WORK_BLEED)} or {DATED.format('line')})"


@query(
    f"""with {SKILL_LINES} select p_partkey, {PLAUSIBLE} as plausible, {STANDALONE} as standalone, {KNOWN} as known, {BLEED} as bleed, lower(regexp_extract(line, '^\\s*([A-Za-z]+)\\s*:', 1)) in ('reading', 'writing', 'speaking', 'listening', 'translation') as part,
 length(line) between 2 and 40 and ({KNOWN} or not (contains(line, ' ') or contains(line, '·') or contains(line, ',') or {BLEED} or {STANDALONE} or regexp_matches(line, '(?i)^({"|".join(cues.NOT_CATEGORIES)})($|[^a-z0-9_])'))) as category from s"""
)
def skill_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills, categories and lines that are neither."""
    p = load(spark, sf_dir, "part")
    size, kind, name = F.col("p_size"), F.col("p_type"), F.col("p_name")
    two = F.lpad((size % 30).cast("string"), 2, "0")
    choices = [
        F.col("p_brand"), F.concat(F.lit("C"), F.expr("repeat('+', p_size % 4)")), name, F.concat(F.lit("Jane "), F.upper(F.left(kind, F.lit(1))), F.lower(F.substring(kind, 2, 99))), F.concat(F.lit("jane@x"), size.cast("string"), F.lit(".org")),
        F.lit("Senior"), F.lit("Frontend"), F.lit("Data & Storage"), F.concat(kind, F.lit(" and "), name), F.concat(F.lit("0"), (size % 9 + 1).cast("string"), F.lit("/20"), two), F.lit("Dev · Full-time"),
        F.concat(F.lit("Reading: C"), (size % 2 + 1).cast("string")), F.concat(F.lower(kind), F.lit("/"), size.cast("string")),
    ]
    p = p.select("p_partkey", texts(F.col("p_partkey") % 13, choices).alias("line"))
    x = F.col("line")
    return p.select("p_partkey", cues.plausible_skill(x).alias("plausible"), cues.standalone_skill(x).alias("standalone"), cues.known_category(x).alias("known"), cues.work_bleed(x).alias("bleed"), cues.language_part(x).alias("part"), cues.plausible_category(x).alias("category"))


@query(
    f"""select doc_id, coalesce(length(string_split(text, chr(10))[1]) > 60 or {any_of(cues.SUMMARY_PROSE, "replace(text, chr(10), ' ')")}, false) as prose, regexp_matches(string_split(text, chr(10))[1], '^[^ .,:]{{1,30}}$') as token from documents"""
)
def summary_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that open with running text, and those that open with one word."""
    head = F.split("text", "\n", -1)
    return load(spark, sf_dir, "documents").select("doc_id", cues.summary_prose(head).alias("prose"), cues.sidebar_token(F.get(head, F.lit(0))).alias("token"))


@query(f"with {JOBS} select cv_id, pos, is_current or start_month is not null or start_year is not null or end_month is not null or end_year is not null or trim(company) <> '' or description <> '' as has_input from jobs")
def active_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = [F.lit("").alias(f) for f in ("job_title", "location", "achievements", "technologies", "company_url")]
    e = F.struct("company", "description", "start_month", "start_year", "end_month", "end_year", "is_current", F.lit("FullTime").alias("employment_type"), *none)
    return jobs(spark, sf_dir).select("cv_id", "pos", entries.work_has_input(e).alias("has_input"))


GLUED = """c as (select c_custkey, c_custkey % 7 as k, c_mktsegment as seg, c_custkey::varchar as key from customer),
 t as (select c_custkey, unnest([1, 2, 3]) as kind, unnest([
  case k when 0 then ['https://ab.cd/-', '  ' || seg, 'next line'] when 1 then ['see https://', lower(seg) || '.org', 'tail'] when 2 then ['https://', seg || ' and more'] when 3 then ['www.x-' || seg, 'a:b', 'ab'] when 4 then ['Website URL:', 'www.' || seg, 'x'] when 5 then ['GitHub URL:', key, 'x y'] else [seg, key] end,
  case k when 0 then ['Phone: +1', key, '', seg] when 1 then ['Email: a,', 'b@' || lower(seg) || '.org', 'City: ' || key] when 2 then ['Skills:', seg] when 3 then ['Address: ' || seg, key, ' more ', 'of it'] when 4 then ['Tel 5: x', seg] else [seg || ': y', key || ':'] end,
  case k when 0 then ['Dev · ' || seg || ' ·', '01/2020 - 02/2021', seg] when 1 then ['Dev · ' || seg, '2019 - 2020'] when 2 then ['Dev · 2019 - 2020', '2021'] when 3 then [seg || ' 01/', '2020 x'] when 4 then ['A · B ·', key || '/ x', 'y'] when 5 then ['03/2019 - 04/2020', '2022'] else [seg || ' · x', key || ' y'] end]) as lines from c)"""
_RANGED = r"regexp_matches({0}, '(\\d{{1,2}}\\s*/\\s*\\d{{4}}|(^|[^0-9])(19[5-9]|20[0-9])[0-9])')"
_JOINS = f"""case kind when 1 then case when regexp_matches(last, '(?i)https?://|www\\.|linkedin\\.com|github\\.com') and (not regexp_matches(last, '(?i)https?://[^\\s<>()]+') or ends_with(rtrim(last), '-')) then not regexp_matches(trim(part), '\\s') and (not contains(part, ':') or contains(part, '://'))
   else (contains(lower(last), 'url:') and starts_with(lower(trim(part)), 'www.')) or (regexp_matches(lower(last), '(linkedin|github|portfolio) url:') and not contains(part, ':') and not regexp_matches(trim(part), '\\s')) end
  when 2 then regexp_matches(last, '^[A-Za-zÀ-ž\\s]+:\\s*.+$') and not contains(part, ':')
  else (contains(last, '·') and not {_RANGED.format("split_part(last, '·', -1)")} and {_RANGED.format("part")}) or (ends_with(rtrim(last), '·') and (contains(part, '/') or {_RANGED.format("part")}))
   or (contains(last, '/') and len(regexp_extract_all(last, '\\d{{4}}')) < 2 and regexp_matches(trim(part), '^\\d{{4}}(\\D|$)')) end"""


@query(
    f"""with recursive {GLUED}, g(c_custkey, kind, lines, n, done, last) as (select c_custkey, kind, lines, 1, '', lines[1] from t
 union all select c_custkey, kind, lines, n + 1, case when j then done else done || last || '|' end, case when j then last || case kind when 1 then '' else ' ' end || ltrim(part) else part end
  from (select *, trim(part) <> '' and ({_JOINS}) as j from (select *, lines[n + 1] as part from g where n < len(lines))))
 select c_custkey, max(case kind when 1 then done || last end) as urls, max(case kind when 2 then done || last end) as labels, max(case kind when 3 then done || rtrim(last) end) as meta from g where n = len(lines) group by c_custkey"""
)
def glued_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs, labelled lines and dotted lines that were broken over lines, and others that were not."""
    c = load(spark, sf_dir, "customer")
    k, seg, key = F.col("c_custkey") % 7, F.col("c_mktsegment"), F.col("c_custkey").cast("string")
    j = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    low = F.lower(seg)
    urls = [j("https://ab.cd/-\n  ", seg, "\nnext line"), j("see https://\n", low, ".org\ntail"), j("https://\n", seg, " and more"), j("www.x-", seg, "\na:b\nab"), j("Website URL:\nwww.", seg, "\nx"), j("GitHub URL:\n", key, "\nx y"), j(seg, "\n", key)]
    labels = [j("Phone: +1\n", key, "\n\n", seg), j("Email: a,\nb@", low, ".org\nCity: ", key), j("Skills:\n", seg), j("Address: ", seg, "\n", key, "\n more \nof it"), j("Tel 5: x\n", seg), j(seg, ": y\n", key, ":")]
    meta = [j("Dev · ", seg, " ·\n01/2020 - 02/2021\n", seg), j("Dev · ", seg, "\n2019 - 2020"), j("Dev · 2019 - 2020\n2021"), j(seg, " 01/\n2020 x"), j("A · B ·\n", key, "/ x\ny"), j("03/2019 - 04/2020\n2022"), j(seg, " · x\n", key, " y")]
    joined = lambda a: F.array_join(a, "|")
    return c.select("c_custkey", joined(folds.url_lines(texts(k, urls))).alias("urls"), joined(folds.labelled_lines(texts(k, labels))).alias("labels"), joined(folds.meta_lines(texts(k, meta))).alias("meta"))


@query(f"with {JOBS}, s as (select cv_id, case when pos % 2 = 0 then 'even' else 'odd' end as section, count(*)::bigint as n from jobs group by 1, 2), a as (select * from s where not (section = 'odd' and cv_id % 2 = 0)), b as (select cv_id, section, n - 1 as n from s where section = 'odd') select coalesce(a.cv_id, b.cv_id) as cv_id, coalesce(a.section, b.section) as section, coalesce(b.n, 0)::bigint as before, coalesce(a.n, 0)::bigint as after, coalesce(a.n, 0) > coalesce(b.n, 0) as improved from a full join b on a.cv_id = b.cv_id and a.section = b.section")
def review_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = jobs(spark, sf_dir)
    s = j.groupBy("cv_id", F.when(F.col("pos") % 2 == 0, "even").otherwise("odd").alias("section")).agg(F.count("*").alias("n"))
    after = s.where("not (section = 'odd' and cv_id % 2 = 0)")
    before = s.where("section = 'odd'").withColumn("n", F.col("n") - 1)
    return folds.review(before, after)
