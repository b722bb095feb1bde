"""Queries over entries, dates, links and small text rules. Their rows are made from table columns; SQL works each rule out anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions import dates, entries, text, urls
from dossier.operators import chunking, folds, layout, linkage, lines, ordering, trees
from dossier.plans.line_queries import texts
from dossier.plans.registry import load, query
from dossier.sources import formats
from dossier.streaming import progress


def joined(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def null(kind: str) -> Column:
    return F.lit(None).cast(kind)


#: A blank in one row of five, the text in the others.
GAP = "case when (p_partkey + {1}) % 5 = 0 then ' ' else {0} end"


def gap(c: Column, n: int) -> Column:
    return F.when((F.col("p_partkey") + n) % 5 == 0, F.lit(" ")).otherwise(c)


@query(
    """select p_partkey, k % 2 = 0 or k % 3 = 0 or k % 7 = 0 as education, k % 3 = 0 or k % 4 = 0 as skills, k % 5 <> 0 or k % 7 = 0 or k % 11 = 0 as language, k % 2 = 1 or k % 9 = 0 as certificate, k % 6 = 0 or k % 10 = 0 or k % 5 = 0 as project, k % 8 <> 0 as link
 from (select p_partkey, p_partkey as k from part)"""
)
def entry_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether entries of each kind have any input: texts, dates, levels beside the default, parts of lists."""
    k = F.col("p_partkey")
    on = lambda n, v, other="": F.when(k % n == 0, v).otherwise(F.lit(other))
    none = lambda *names: [F.lit(" ").alias(n) for n in names]
    blank = lambda kind, *names: [null(kind).alias(n) for n in names]
    education = F.struct(on(2, "x").alias("institution"), *none("degree", "field_of_study", "location", "grade", "description", "institution_url"), F.when(k % 3 == 0, 2001).alias("start_year"), *blank("int", "start_month", "end_month", "end_year"), (k % 7 == 0).alias("is_current"), F.lit("Bachelor").alias("degree_type"))
    group = F.struct(on(3, "Tools", " ").alias("category"), F.array(F.struct(on(4, "Spark").alias("name"))).alias("skills"))
    language = F.struct(F.when(k % 5 != 0, "English").otherwise(" ").alias("language"), *none("certificate"), on(7, "Native", "Intermediate").alias("proficiency"), F.when(k % 11 == 0, "C1").alias("cefr"), *blank("string", "reading", "writing", "speaking", "listening"))
    certificate = F.struct(F.when(k % 2 == 1, "AWS").otherwise("").alias("name"), *none("issuer", "credential_id", "credential_url", "description"), F.when(k % 9 == 0, 5).alias("issue_month"), *blank("int", "issue_year", "expiration_month", "expiration_year"))
    project = F.struct(*none("name", "role", "organization", "url", "highlights", "description"), *blank("int", "start_month", "start_year", "end_month", "end_year"), (k % 6 == 0).alias("is_active"), F.when(k % 10 == 0, F.array(F.lit(""), F.lit("Go"))).when(k % 5 == 0, F.array(F.lit("C"))).otherwise(F.array(F.lit(" "))).alias("technologies"))
    link = F.struct(F.when(k % 8 != 0, "Web").otherwise("").alias("label"), *none("url", "note"))
    return load(spark, sf_dir, "part").select(
        "p_partkey", entries.education_has_input(education).alias("education"), entries.skill_group_has_input(group).alias("skills"), entries.language_has_input(language).alias("language"),
        entries.certificate_has_input(certificate).alias("certificate"), entries.project_has_input(project).alias("project"), entries.link_has_input(link).alias("link"),
    )


_LANG = "['English', 'slovenčina', 'Klingon', ' ', 'Deutsch']"


@query(
    f"""with p as (select *, {GAP.format("p_name", 0)} as a, {GAP.format("p_brand", 1)} as b, {GAP.format("p_type", 2)} as c, case when p_partkey % 3 = 0 then p_size % 12 + 1 end as m, 2000 + p_size as y, p_partkey % 4 = 0 as now, trim(list_extract({_LANG}, (p_partkey % 5 + 1)::int)) as lang from part),
 q as (select *, list_filter([trim(a), trim(b), trim(c)], lambda x: x <> '') as abc, case when m is null then y::varchar else lpad(m::varchar, 2, '0') || ' / ' || y end as start_, case when now then 'Present' else (y + 1)::varchar end as end_ from p)
 select p_partkey, array_to_string(list_concat(abc, [start_ || ' – ' || end_]), ' · ') as project, array_to_string(list_concat(list_filter([trim(a), trim(b), trim(c)], lambda x: x <> ''), [start_ || ' – ' || end_]), ' · ') as work,
  array_to_string(list_concat(list_filter([trim(a), trim(b)], lambda x: x <> ''), list_filter([case when m is null then y::varchar else lpad(m::varchar, 2, '0') || ' / ' || y end, case when now then 'Valid until ' || (y + 3) end], lambda x: x is not null)), ' · ') as certificate,
  array_to_string(list_filter([case when trim(b) <> '' then 'Credential ID: ' || trim(b) end, case when trim(c) <> '' then 'Description: ' || trim(c) end], lambda x: x is not null), '|') as details,
  array_to_string(list_filter([case lang when 'English' then '🇬🇧' when 'slovenčina' then '🇸🇰' when 'Deutsch' then '🇩🇪' when '' then null else '🌐' end, array_to_string(list_filter([lang, 'Fluent', case when now then 'C1' end], lambda x: x is not null and x <> ''), ' · ')], lambda x: x is not null), ' ') as language,
  case when trim(a) <> '' then trim(a) || ': ' else '' end || p_brand || case when trim(c) <> '' then ' — ' || trim(c) else '' end as link, array_to_string(list_filter([trim(a), trim(b), case when m is not null then m || ' yrs' end], lambda x: x is not null and x <> ''), ' · ') as skill,
  case when trim(a) = '' then '-' else trim(a) end || case when p_size % 6 > 0 then ': ' || array_to_string(list_transform(range(least(p_size % 6, 3)), lambda i: 's' || i), ', ') else '' end || case when p_size % 6 > 3 then '…' else '' end as summary from q"""
)
def entry_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preview lines of entries, with what is blank left out."""
    k = F.col("p_partkey")
    a, b, c = gap(F.col("p_name"), 0), gap(F.col("p_brand"), 1), gap(F.col("p_type"), 2)
    m, y, now = F.when(k % 3 == 0, F.col("p_size") % 12 + 1), F.col("p_size") + 2000, k % 4 == 0
    span = [m.alias("start_month"), y.alias("start_year"), null("int").alias("end_month"), F.when(~now, y + 1).alias("end_year")]
    project = F.struct(a.alias("name"), b.alias("role"), c.alias("organization"), *span, now.alias("is_active"))
    work = F.struct(a.alias("company"), b.alias("location"), c.alias("employment_type"), *span, now.alias("is_current"))
    certificate = F.struct(a.alias("name"), b.alias("issuer"), m.alias("issue_month"), y.alias("issue_year"), null("int").alias("expiration_month"), F.when(now, y + 3).alias("expiration_year"), b.alias("credential_id"), F.lit("").alias("credential_url"), c.alias("description"))
    lang = F.element_at(F.array(*map(F.lit, ("English", "slovenčina", "Klingon", " ", "Deutsch"))), (k % 5 + 1).cast("int"))
    language = F.struct(lang.alias("language"), F.lit("Fluent").alias("proficiency"), F.when(now, "C1").alias("cefr"), F.lit("").alias("certificate"))
    link = F.struct(a.alias("label"), F.col("p_brand").alias("url"), c.alias("note"))
    skill = F.struct(a.alias("name"), b.alias("proficiency"), m.alias("years"))
    names = F.expr("transform(slice(sequence(0, 6), 1, p_size % 6), i -> concat('s', i))")
    return load(spark, sf_dir, "part").select(
        "p_partkey", entries.project_line(project).alias("project"), entries.work_meta(work).alias("work"), entries.certificate_line(certificate).alias("certificate"), F.array_join(entries.certificate_details(certificate), "|").alias("details"),
        entries.language_line(language).alias("language"), entries.link_line(link).alias("link"), entries.skill_line(skill).alias("skill"), entries.group_summary(a, names).alias("summary"),
    )


@query(
    """with p as (select *, list_extract(['Native speaker', 'fluent (C1)', 'b2', 'Professional', 'x', 'basic A1'], (p_partkey % 6 + 1)::int) as token from part)
 select p_partkey, case p_partkey % 6 when 0 then 'Native' when 1 then 'Fluent' when 3 then 'Advanced' when 5 then 'Basic' else 'Intermediate' end as proficiency, case p_partkey % 6 when 1 then 'C1' when 2 then 'B2' when 5 then 'A1' end as cefr,
  case when p_size % 3 = 0 then 'High' when p_size % 3 = 1 then 'Medium' else 'Low' end as confidence, case when p_size % 4 = 3 then 'complete' when p_size % 4 > 0 then 'partial' else '—' end as person,
  case when p_size % 7 = 0 then 'Small' when p_size < 8 then 'Compact' when p_size < 16 then 'Small' when p_size < 32 then 'Medium' when p_size < 64 then 'Large' else 'ExtraLarge' end as tier,
  ceil(p_size * 350000 * 2 * 2 * case p_partkey % 3 when 0 then 0.35::double + 0.4::double * p_size / 100 when 1 then 0.25::double + 0.35::double * p_size / 100 else 1.0::double end)::bigint as bytes, (p_size % 2 = 0)::int + (p_size % 3 = 0)::int as populated, case when p_size % 2 = 0 then 'M:7B' else '' end as tags from p"""
)
def entry_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels in words and codes, confidences, states, model tiers, sizes of exports, sections with data, installed tags."""
    k, size = F.col("p_partkey"), F.col("p_size")
    token = F.element_at(F.array(*map(F.lit, ("Native speaker", "fluent (C1)", "b2", "Professional", "x", "basic A1"))), (k % 6 + 1).cast("int"))
    level = entries.proficiency(token)
    have = lambda n: F.when(size % 4 >= n, "x").otherwise(" ")
    fmt = texts(k % 3, [F.lit("jpeg"), F.lit("webp"), F.lit("png")])
    tags = F.array(F.lit("mx"), F.when(size % 2 == 0, "M:7B").otherwise("n"), F.when(size % 2 == 0, "m:7b").otherwise("nm"))
    return load(spark, sf_dir, "part").select(
        "p_partkey", level["proficiency"].alias("proficiency"), level["cefr"].alias("cefr"), entries.confidence(size % 3 == 0, size % 3 == 1).alias("confidence"), entries.personal_state(have(1), have(2), have(3)).alias("person"),
        entries.memory_tier(F.when(size % 7 != 0, size.cast("long") * (1 << 30))).alias("tier"), entries.page_bytes(size, fmt, F.lit(2), size).alias("bytes"),
        entries.populated(entries.section_flags(work=size % 2 == 0, links=size % 3 == 0)).alias("populated"), F.array_join(entries.tag_matches(tags, F.lit("m")), ",").alias("tags"),
    )


@query(
    """with o as (select o_orderkey, o_orderkey % 4 as k, month(o_orderdate)::int as m, year(o_orderdate)::int as y, o_orderkey % 17 as mm, ['Bachelor', 'Master', 'Doctorate', 'Certificate', 'Odd'][(o_orderkey % 5 + 1)::int] as kind, [4, 2, 3, 1, 3][(o_orderkey % 5 + 1)::int] as years from orders),
 w as (select *, case k when 0 then null when 1 then m when 2 then null else m end as em, case k when 0 then null when 1 then y + 1 when 2 then y + 2 else null end as ey, k = 3 as now, o_orderkey % 3 <> 0 as has_month from o)
 select o_orderkey, case when now then null when ey is not null and em is null then case when has_month then m else 12 end when em is null and ey is null and has_month then m else em end::int as work_month,
  case when now then null when em is null and ey is null and has_month then y else ey end::int as work_year,
  case when k = 0 then 9 when k = 3 then case when has_month then m end when k = 2 then case when has_month then m end else case when has_month then m end end::int as study_month, case when k = 0 then y - years else y end::int as study_year, case when k = 0 then y when k = 3 then null else ey end::int as study_end, k = 0 as inferred,
  case when mm between 1 and 12 then make_date(y, mm::int, 1) end as first_day, case when mm = 0 then y::varchar else y || '-' || lpad(mm::varchar, 2, '0') end as iso, coalesce(case when mm > 0 then y * 100 + mm end, -1)::int as key, mm between 1 and 12 as valid from w"""
)
def date_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed dates of jobs and studies, first days, ISO dates, sort keys."""
    o = load(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    k, y, mm = key % 4, F.year("o_orderdate"), (key % 17).cast("int")
    has_month = key % 3 != 0
    m = F.month("o_orderdate")
    em, ey, now = F.when((k == 1) | (k == 3), m), F.when(k == 1, y + 1).when(k == 2, y + 2), k == 3
    sm = F.when(has_month, m)
    work = dates.work_dates(sm, y, em, ey, now)
    kind = F.element_at(F.array(*map(F.lit, ("Bachelor", "Master", "Doctorate", "Certificate", "Odd"))), (key % 5 + 1).cast("int"))
    parsed = F.struct(sm.alias("start_month"), y.alias("start_year"), F.when(k == 1, m).alias("end_month"), ey.alias("end_year"), now.alias("is_present"))
    study = dates.education_dates(parsed, kind)
    month = F.when(mm > 0, mm)
    return o.select(
        "o_orderkey", work["end_month"].alias("work_month"), work["end_year"].alias("work_year"), study["start_month"].alias("study_month"), study["start_year"].alias("study_year"), study["end_year"].alias("study_end"), study["inferred"].alias("inferred"),
        dates.first_of_month(month, y).alias("first_day"), dates.iso(month, y).alias("iso"), dates.sort_key(month, y).alias("key"), dates.valid_month_year(month, y).alias("valid"),
    )


@query(
    """with t as (select o_orderkey, o_orderkey % 7 as k, month(o_orderdate)::int as m, year(o_orderdate)::int as y, strftime(o_orderdate, '%Y-%m-%d') as d, strftime(o_orderdate, '%b %Y') as b from orders)
 select o_orderkey, case when k in (0, 1, 2, 3) then m end::int as month, case when k in (0, 1, 2, 3, 4) then y end::int as year,
  case k when 5 then '' else case when k = 6 then y || ',' || (y + 30) else y::varchar end end as years from t"""
)
def date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months and years of dates in several notations, and all years that a text holds."""
    o = load(spark, sf_dir, "orders")
    d, k, y = F.col("o_orderdate"), F.col("o_orderkey") % 7, F.year("o_orderdate").cast("string")
    t = texts(k, [F.date_format(d, "yyyy-MM-dd"), F.date_format(d, "yyyy-MM"), F.date_format(d, "MM/yyyy"), F.date_format(d, "MMM yyyy"), joined(" ", y, " "), F.lit("no date 12345"), joined("x ", (F.year(d) + 30).cast("string"), " ", y, " ", y)])
    ym = dates.year_month(t)
    return o.select("o_orderkey", ym["month"].alias("month"), ym["year"].alias("year"), F.array_join(dates.years_in(t, 1950, 2150), ",").alias("years"))


@query(
    """with c as (select c_custkey, c_custkey % 6 as k, lower(c_mktsegment) as seg from customer)
 select c_custkey, k in (0, 1, 3) as same, case k when 0 then 'https://www.' || seg || '.com/a/' when 1 then seg || '.com' when 2 then 'http://x.' || seg || '.org/b?q=1' when 3 then 'https://linkedin.com/in/' || c_custkey when 4 then 'see' else 'https://github.com/' || seg end as first,
  case k when 0 then upper(left(seg, 1)) || substr(seg, 2) when 2 then 'X' when 3 then 'LinkedIn' when 5 then 'GitHub' else '' end as label, case k when 3 then 'linkedin_url' when 5 then 'github_url' else 'portfolio_url' end as slot, c_custkey % 4 in (0, 1) as unsafe, k in (0, 2, 3, 5) as valid from c"""
)
def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal URLs, the first URL of a text, names and slots of links, validity, paths that leave their folder."""
    c = load(spark, sf_dir, "customer")
    key, k, seg = F.col("c_custkey"), F.col("c_custkey") % 6, F.lower("c_mktsegment")
    url = texts(k, [joined("https://www.", seg, ".com/a/"), joined(seg, ".com"), joined("http://x.", seg, ".org/b?q=1"), joined("https://linkedin.com/in/", key.cast("string")), F.lit("see"), joined("https://github.com/", seg)])
    other = texts(k, [joined("HTTPS://", seg, ".com/a#top"), joined("https://", seg, ".com/"), joined("http://x.", seg, ".org/b"), joined("linkedin.com/in/", key.cast("string"), "/"), F.lit(" "), joined("https://gitlab.com/", seg)])
    said = F.when(k == 0, joined("see ", url, " and http://other.org")).otherwise(joined(" ", url, " "))
    path = texts(key % 4, [joined("a/../", seg), joined("..\\", seg), joined("a..b/", seg), seg])
    return c.select("c_custkey", urls.same_url(url, other).alias("same"), urls.first_url(said).alias("first"), F.coalesce(urls.url_label(url), F.lit("")).alias("label"), urls.profile_slot(url).alias("slot"), urls.path_unsafe(path).alias("unsafe"), urls.url_valid(url).alias("valid"))


@query(
    """with c as (select c_custkey, c_custkey % 8 as k, c_mktsegment as seg from customer)
 select c_custkey, case when k % 2 = 0 then '-' else seg end as dash, rtrim(left(seg || ' and more of it', 11)) as cut, case when k < 4 then seg else 'x' end as first,
  case k when 0 then 'en' when 1 then 'sk' when 2 then 'zh-Hant' when 3 then 'zh-Hans' when 4 then 'de' when 5 then 'en' when 6 then 'zh-Hant' else 'sk' end as locale, case k when 1 then 'eng+slk' when 7 then 'eng+slk' when 5 then 'eng+ces' else 'eng' end as packs,
  case k % 4 when 0 then '{"a": ' || c_custkey || '}' when 1 then '{"a": 1}' end as json, k % 4 > 1 as retry, 'a,' || seg || ',b' as items, c_custkey::varchar || case when c_custkey <> 7 then ',7' else '' end as runs,
  'Printable text of ' || seg || ' number ' || c_custkey as spans from c"""
)
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dashes for blanks, bounded and first texts, locales, model answers, items, runs of digits, printable spans of dumps."""
    c = load(spark, sf_dir, "customer")
    key, k, seg = F.col("c_custkey"), F.col("c_custkey") % 8, F.col("c_mktsegment")
    id_ = key.cast("string")
    culture = texts(k, [F.lit("fr-FR"), F.lit("SK"), F.lit("zh-TW"), F.lit("zh-CN"), F.lit("de-AT"), F.lit("cs-CZ"), F.lit("zh-Hant-HK"), F.lit("sk-SK")])
    answer = texts(k % 4, [joined('Sure:\n{"a": ', id_, "} done"), F.lit('```json\n{"a": 1}\n```'), joined("{broken ", seg), seg])
    found = text.model_json(answer)
    dump = joined("\u0001\u0002ab\u0003Printable  text of\n", seg, " number ", id_, "\u0004short\u0005Printable text of ", seg, " number ", id_, "\u0006")
    return c.select(
        "c_custkey", text.or_dash(F.when(k % 2 == 0, "  ").otherwise(joined(" ", seg, "\n"))).alias("dash"),
        text.bounded(joined("  ", seg, " and more of it"), 11).alias("cut"), text.first_text(F.when(k < 4, seg), F.lit(" x ")).alias("first"),
        text.locale_of(culture, ("en", "sk", "de", "zh-Hans", "zh-Hant")).alias("locale"), text.ocr_languages(culture).alias("packs"), found["json"].alias("json"), found["retry"].alias("retry"),
        F.array_join(text.split_items(joined(" a ,", seg, "\n\n b,")), ",").alias("items"), F.array_join(text.digit_runs(joined(id_, " x7y", id_, "-7")), ",").alias("runs"), text.printable_spans(dump).alias("spans"),
    )


@query(
    """with l as (select o_orderkey as id, o_custkey as cv_id, 'https://X.org/' || (o_orderkey % 5) as url from orders), p as (select c_custkey as cv_id, 'https://x.org/' || (c_custkey % 5) as url from customer where c_custkey % 2 = 0)
 select id, l.cv_id, url from l where not exists (select 1 from p where p.cv_id = l.cv_id and lower(p.url) = lower(l.url))"""
)
def links_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links that are none of a person's own, letter by letter but for case."""
    o, c = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    links = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cv_id"), joined("https://X.org/", (F.col("o_orderkey") % 5).cast("string")).alias("url"))
    own = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("cv_id"), joined("https://x.org/", (F.col("c_custkey") % 5).cast("string")).alias("url"))
    return linkage.links_not_exactly(links, own)


@query(
    """with recursive n as (select p_partkey as id, case when p_partkey > 0 then p_partkey // 3 end as parent from part), a(id, ancestor, depth) as (select id, parent, 1 from n where parent is not null union all select a.id, n.parent, depth + 1 from a join n on n.id = a.ancestor where n.parent is not null)
 select id, ancestor, depth::int as depth from a"""
)
def tree_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ancestors of the nodes of a tree with their distance."""
    p = load(spark, sf_dir, "part")
    return trees.ancestors(p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") > 0, F.expr("p_partkey div 3")).alias("parent")))


@query(
    """select c_custkey, case c_custkey % 4 when 0 then 'Anna' when 1 then c_mktsegment when 2 then '' else 'A' end as first_name, case c_custkey % 4 when 0 then 'van ' || c_mktsegment when 3 then 'B C' else '' end as last_name, case when c_custkey % 3 = 0 then 'b' else 'a' || c_custkey end as pick,
 case c_custkey % 3 when 0 then 'Mia' when 1 then 'Anna-Lena' end as split_first, case c_custkey % 3 when 0 then 'Novak' when 1 then 'O''Neil' end as split_last from customer"""
)
def name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in one line or two, and lists that stand in for empty ones."""
    c = load(spark, sf_dir, "customer")
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    full = texts(k % 4, [joined("  Anna   van ", seg), joined(seg, " "), F.lit(" "), F.lit("A\tB C")])
    pick = linkage.whole_or_other(F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(joined("a", k.cast("string")))), F.array(F.lit("b")))
    rows = texts(k % 3, [F.array(*map(F.lit, ("a@b.cd", "Mia", "Novak", "Docker"))), F.array(*map(F.lit, ("Docker", "Anna-Lena", "O'Neil"))), F.array(*map(F.lit, ("Redis", "Mia", "2020")))])
    one, two = linkage.split_names(full), lines.split_name(rows)
    return c.select("c_custkey", one["first_name"].alias("first_name"), one["last_name"].alias("last_name"), F.get(pick, F.lit(0)).alias("pick"), two["first_name"].alias("split_first"), two["last_name"].alias("split_last"))


@query(
    """with t as (select o_custkey as cv_id, row_number() over (partition by o_custkey order by o_orderkey) as n, o_orderkey as pos, o_orderpriority as value from orders)
 select cv_id, pos, case when cv_id % 2 = 0 and n = 1 then 'fixed ' || cv_id when cv_id % 2 = 0 and n = 3 then 'third' else value end as value from t"""
)
def repaired_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields with a model's numbered answers put in their place; a missing number keeps the value."""
    o, c = load(spark, sf_dir, "orders"), load(spark, sf_dir, "customer")
    targets = o.select(F.col("o_custkey").alias("cv_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("value"))
    answers = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("cv_id"), joined("1: fixed ", F.col("c_custkey").cast("string"), "\n3) third\n99: none").alias("raw"))
    return chunking.repaired(targets, answers, "cv_id")


@query("select doc_id, '1: ' || coalesce(lang, '') || chr(10) || '2: ' || coalesce(source, '') || chr(10) || '---' || chr(10) || left(coalesce(text, ''), 600) as prompt from documents")
def repair_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered fields and the head of their source: a bounded prompt."""
    d = load(spark, sf_dir, "documents").fillna("")
    return d.select("doc_id", chunking.prompt(F.array("lang", "source"), F.col("text")).alias("prompt"))


@query(
    """with p as (select p_partkey, p_size % 4 as a, p_size % 3 as b, p_partkey % 8 as k, p_name from part)
 select p_partkey, (a >= 3 or (a >= 1 and b >= 2)) as own, case when k = 0 then 'ocr' when k = 1 then 'locked' when k in (2, 3, 4) then 'text_layer' when k in (5, 6) then 'ocr' else 'text_layer' end as strategy, case when k = 1 then null when k in (0, 5, 6) then 'scan' else p_name end as text from p"""
)
def layout_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that look like this engine's own export, and the choice between text layer and recognition."""
    p = load(spark, sf_dir, "part")
    k = F.col("p_partkey") % 8
    said = F.expr("concat('Head\n', repeat('Spark · Expert · 5 yrs\n', p_size % 4), repeat('Acme · Praha · 2019\n', p_size % 3), 'tail')")
    found = layout.fallback(F.col("p_name"), F.when(k != 7, F.lit("scan")), k.isin(2, 3, 4), k == 0, k == 1)
    return p.select("p_partkey", layout.own_export(said).alias("own"), found["strategy"].alias("strategy"), found["text"].alias("text"))


@query(
    """with w as (select o_orderkey as word, o_custkey as page_id, (o_orderkey * 13 % 200)::double as x0, (o_orderkey * 13 % 200 + 20)::double as x1, case when o_custkey % 5 = 0 then 70.0 else 220.0 end::double as width from orders),
 s as (select *, case when (x0 + x1) / 2 <= width * 0.5 then 'L' else 'R' end as s from w), n as (select *, count(*) filter (s = 'L') over (partition by page_id) as l, count(*) filter (s = 'R') over (partition by page_id) as r from s)
 select word, page_id, case when l >= 3 and r >= 3 and width >= 80 then s else 'L' end as side from n"""
)
def page_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides of the words of pages, by their centre, where both sides have enough words and the page is wide."""
    o = load(spark, sf_dir, "orders")
    x0 = (F.col("o_orderkey") * 13 % 200).cast("double")
    words = o.select(F.col("o_orderkey").alias("word"), F.col("o_custkey").alias("page_id"), x0.alias("x0"), (x0 + 20).alias("x1"), F.when(F.col("o_custkey") % 5 == 0, 70.0).otherwise(220.0).alias("width"))
    return layout.columns(words).select("word", "page_id", "side")


@query(
    """with recursive w as (select o_custkey as page_id, o_orderkey::varchar as text, (o_orderkey * 7 % 60)::double as y, (o_orderkey % 90)::double as x from orders),
 p as (select page_id, list({'y': y, 'x': x, 't': text} order by y, x, text) as b from w group by page_id),
 g(page_id, b, n, first, line) as (select page_id, b, 1, b[1].y, 0 from p union all select page_id, b, n + 1, case when abs(b[n + 1].y - first) >= 3 then b[n + 1].y else first end, case when abs(b[n + 1].y - first) >= 3 then line + 1 else line end from g where n < len(b)),
 r as (select page_id, line, b[n] as w from g) select page_id, line::int as pos, string_agg(w.t, ' ' order by w.x, w.y, w.t) as line from r group by page_id, line"""
)
def column_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of words of a text layer: a word is on a line while its baseline is within three points of the line's first."""
    o = load(spark, sf_dir, "orders")
    words = o.select(F.col("o_custkey").alias("page_id"), F.col("o_orderkey").cast("string").alias("text"), (F.col("o_orderkey") * 7 % 60).cast("double").alias("y"), (F.col("o_orderkey") % 90).cast("double").alias("x"))
    return layout.word_lines(words)


@query(
    """with m as (select p_partkey, p_name || p_partkey as name, (p_size % 4)::int as tier, (p_partkey % 3)::int as priority from part), r as (select *, row_number() over (order by tier > 2, tier desc, priority desc, name) as n from m)
 select p_partkey, n = 1 as recommended, tier <= 2 as fits from r"""
)
def model_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model of a catalogue that a machine of 24 GB should take, and those that fit."""
    p = load(spark, sf_dir, "part")
    m = p.select("p_partkey", F.concat("p_name", F.col("p_partkey").cast("string")).alias("name"), (F.col("p_size") % 4).cast("int").alias("tier"), (F.col("p_partkey") % 3).cast("int").alias("priority"))
    return ordering.best_model(m, F.lit(24)).select("p_partkey", "recommended", "fits")


@query(
    """with p as (select p_partkey, p_partkey % 5 as k, p_size % 5 as n, p_name, p_type from part)
 select p_partkey, n >= 2 and case when p_partkey % 2 = 0 then n else 0 end >= greatest(2, n // 2) as institution_first, k in (0, 1) as degree_first, case when n > 1 then n else 1 end::int as blocks,
  left(array_to_string(list_filter([case when n > 0 then 'jobs: ' || n end, case when k > 0 then 'skills: ' || k end], lambda x: x is not null), '; '), 12) as carried  from p"""
)
def fold_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes on the layout of education sections, blocks by marker or blank line, what is carried from call to call."""
    p = load(spark, sf_dir, "part")
    k, n = F.col("p_partkey") % 5, F.col("p_size") % 5
    block = F.when(F.col("p_partkey") % 2 == 0, "University of X\nBSc Maths\n2001").otherwise("Some line\nUniversity of X")
    blocks = F.array_repeat(block, n)
    head = texts(k, [F.lit("x\nMSc Maths\n2001"), F.lit("bachelor of arts\n2001"), F.lit("2001 - 2002\nMSc Maths"), F.lit("MSc · Maths\nGrade: MSc"), F.lit("a\nb")])
    chosen = folds.marker_or_blank(blocks, F.array(F.lit("all")))
    carried = folds.carried({"jobs": n, "skills": k}, 12)
    return p.select("p_partkey", folds.education_votes(blocks).alias("institution_first"), folds.degree_first(F.split(head, "\n")).alias("degree_first"), F.size(chosen).alias("blocks"), carried.alias("carried"))


@query(
    """with e as (select event_id, event_id % 9 as k, event_id % 120 as done from events)
 select event_id, case when k > 1 then least(100, greatest(0, floor(done * 100 / (k * 10)))) end::int as percent, case when k = 0 then 'none' when k % 4 = 1 then 'discard_invalid' when k % 3 = 0 then 'discard_stale' else 'offer' end as recovery from e"""
)
def progress_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentages of downloads, and what becomes of recovery files."""
    e = load(spark, sf_dir, "events")
    k, done = F.col("event_id") % 9, F.col("event_id") % 120
    state = progress.recovery(F.when(k % 3 == 0, F.lit(5)), F.when(k != 0, F.lit(4)), k % 4 != 1)
    return e.select("event_id", progress.percent(done, F.when(k > 1, k * 10).otherwise(F.lit(0))).alias("percent"), state.alias("recovery"))


@query(
    """with m as (select user_id, ts, case when ts <= lag(ts) over w + interval 59 second then 0 else 1 end as new from events window w as (partition by user_id order by ts)), r as (select *, sum(new) over (partition by user_id order by ts, new desc) as run from m)
 select user_id, max(ts) as saved_at, count(*)::bigint as changes from r group by user_id, run"""
)
def save_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last save of each burst: changes less than 59 seconds apart are one."""
    return progress.debounced(load(spark, sf_dir, "events"), "user_id", "ts").select("user_id", "saved_at", "changes")


@query(
    """with recursive e as (select user_id, date_trunc('milliseconds', ts) as ts, row_number() over (partition by user_id order by ts) as n from events where event_id % 5 <> 0 and event_id % 7 <> 0),
 r(user_id, n, first, last, held, done, held_done) as (select user_id, n, ts, ts, 1, null::timestamp, 0 from e where n = 1 union all
  select e.user_id, e.n, case when e.ts >= least(r.last + interval 1 hour, r.first + interval 4 hour) then e.ts else r.first end, e.ts, case when e.ts >= least(r.last + interval 1 hour, r.first + interval 4 hour) then 1 else r.held + 1 end,
   case when e.ts >= least(r.last + interval 1 hour, r.first + interval 4 hour) then least(r.last + interval 1 hour, r.first + interval 4 hour) end, r.held from r join e on e.user_id = r.user_id and e.n = r.n + 1),
 t as (select user_id, max(n) as n from e group by user_id)
 select user_id, done as saved_at, held_done::bigint as changes from r where done is not null union all select r.user_id, least(last + interval 1 hour, first + interval 4 hour), held::bigint from r join t on r.user_id = t.user_id and r.n = t.n"""
)
def saved_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When changes are saved: after an hour's pause, and four hours after the first one at the latest."""
    e = load(spark, sf_dir, "events")
    rows = e.select(F.col("user_id").alias("key"), "ts", (F.col("event_id") % 5 != 0).alias("dirty"), (F.col("event_id") % 7 != 0).alias("has_data"))
    return progress.saves(rows, 3600, 4 * 3600).select(F.col("key").alias("user_id"), F.col("ts").cast("timestamp_ntz").alias("saved_at"), "changes")


@query(
    """with f as (select p_partkey, p_partkey % 10 as k, p_name from part)
 select p_partkey, case k when 0 then 'Docx' when 1 then 'OwnJson' when 2 then 'JsonResume' when 3 then 'EuropassXml' when 4 then 'HrXml' when 5 then 'Unknown' when 6 then 'Unknown' when 7 then 'Csv' when 8 then 'Pdf' else 'Yaml' end as format, k in (0, 8) as text_route,
  case k % 5 when 0 then 'utf-8-sig' when 1 then 'utf-16-le' when 2 then 'utf-16-be' when 3 then 'utf-8' else 'cp1250' end as encoding from f"""
)
def file_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats by name and content, the route they take, and charsets of plain texts."""
    p = load(spark, sf_dir, "part")
    k = F.col("p_partkey") % 10
    name = F.col("p_name")
    path = joined("/in/", name, texts(k, [F.lit(".DOCX"), F.lit(formats.OWN_SUFFIX), F.lit(".json"), F.lit(".xml"), F.lit(".XML"), F.lit(".xml"), F.lit(".exe"), F.lit(".tsv"), F.lit(".pdf"), F.lit(".yml")]))
    body = texts(k, [F.lit(""), F.lit("{"), joined('{"work": [], "x": "', name, '"}'), joined("<SkillsPassport>", name, "</SkillsPassport>"), joined("<Resume>", name, "</Resume>"), joined("<!DOCTYPE x><Resume>", name, "</Resume>"), name, name, name, name])
    raw = texts(k % 5, [F.concat(F.unhex(F.lit("EFBBBF")), F.encode(name, "UTF-8")), F.concat(F.unhex(F.lit("FFFE")), F.encode(name, "UTF-8")), F.concat(F.unhex(F.lit("FEFF")), F.encode(name, "UTF-8")), F.encode(joined(name, " š"), "UTF-8"), F.concat(F.encode(name, "UTF-8"), F.unhex(F.lit("9A")))])
    fmt = formats.format_of(path, body)
    return p.select("p_partkey", fmt.alias("format"), formats.is_text_route(fmt).alias("text_route"), formats.encoding_of(raw).alias("encoding"))
