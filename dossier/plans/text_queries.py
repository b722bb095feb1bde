"""Queries over texts: normalisation, gates, signals, patterns, lines, blocks, chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.functions import dates, text, urls
from dossier.operators import chunking, lines, ordering
from dossier.plans.registry import load, query
from dossier.sources.extract import page_text

WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
TRIM = rf"regexp_replace(regexp_replace(%s, '^{WS}+', ''), '{WS}+$', '')"
NONWS = rf"length(regexp_replace(coalesce(%s, ''), '{WS}', '', 'g'))"
HAS = rf"coalesce(regexp_matches(%s, '[^\s\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]'), false)"
NORMAL = f"""case when {HAS % "t"} then {TRIM % f'''regexp_replace(array_to_string(list_transform(
  string_split(translate(regexp_replace(t, '\\r\\n?', chr(10), 'g'), '–—−', '---'), chr(10)),
  lambda x: regexp_replace({TRIM % f"regexp_replace(x, '{WS}+', ' ', 'g')"}, '^[•◦▪*\\-] {WS}*', '- ')), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')'''} else '' end"""
SIGNAL = f"""case when not {HAS % "t"} then 'en'
  when length(regexp_replace(t, '[^{text.CZECH_ONLY}{text.SLOVAK}]', '', 'g')) >= 2
   then case when regexp_matches(t, '[{text.CZECH_ONLY}]') then 'cs' else 'sk' end else 'en' end"""


@query(
    f"""with n as (select lang, {NORMAL} as t from (select lang, text as t from documents)),
 s as (select lang, {SIGNAL} as signal, {NONWS % "t"} as nonws, length(t) as chars from n)
 select lang, signal, count(*)::bigint as documents, count(*) filter (nonws < 40)::bigint as rejected, sum(nonws)::bigint as nonws_chars,
  max(case when chars <= 1200 then 1 else 1 + ceil((chars - 1200) / 1080.0) end)::bigint as most_chunks from s group by lang, signal"""
)
def document_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: normalised documents by language and signal, with those rejected, their characters and most chunks."""
    d = load(spark, sf_dir, "documents").select("lang", text.normalize("text").alias("t"))
    d = d.select(
        "lang",
        text.language_signal("t").alias("signal"),
        text.nonws_len("t").alias("nonws"),
        text.quality_reason("t").alias("reason"),
        F.size(chunking.windows(F.col("t"), 1200, True)).alias("chunks"),
    )
    return d.groupBy("lang", "signal").agg(
        F.count("*").alias("documents"),
        F.count_if(F.col("reason").isNotNull()).alias("rejected"),
        F.sum("nonws").cast("long").alias("nonws_chars"),
        F.max("chunks").cast("long").alias("most_chunks"),
    )


@query(f"select doc_id, length(n)::bigint as chars, ({NONWS % 'n'})::bigint as nonws, len(string_split(n, chr(10)))::bigint as lines, md5(n) as digest from (select doc_id, {NORMAL} as n from (select doc_id, text as t from documents))")
def normalize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id", text.normalize("text").alias("n"))
    return d.select("doc_id", F.length("n").cast("long").alias("chars"), text.nonws_len("n").cast("long").alias("nonws"), F.size(F.split("n", "\n", -1)).cast("long").alias("lines"), F.md5("n").alias("digest"))


GATE = f"case when {NONWS % 'text'} = 0 then 'empty' when {NONWS % 'text'} < 40 then 'too_short' end"


@query(f"select 'documents' as origin, doc_id as id, 0::bigint as part, {GATE} as reason from documents union all select 'conversations', conv_id, turn, {GATE} from conversations")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("part"), "text")
    c = load(spark, sf_dir, "conversations").select(F.lit("conversations").alias("origin"), F.col("conv_id").alias("id"), F.col("turn").alias("part"), "text")
    return d.unionByName(c).select("origin", "id", "part", text.quality_reason("text").alias("reason"))


@query(f"select doc_id, lang, {SIGNAL} as signal from (select doc_id, lang, text as t from documents)")
def language_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", "lang", text.language_signal("text").alias("signal"))


EMAIL, PHONE = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}", lines.PHONE


@query(
    rf"""select doc_id, regexp_extract(coalesce(text, ''), '{EMAIL}') as email, regexp_extract(coalesce(text, ''), '{PHONE}') as phone,
 regexp_extract(coalesce(text, ''), '(?i)https?://[^\s<>()]+') as url, len(regexp_extract_all(coalesce(text, ''), '{EMAIL}'))::bigint as n_email,
 len(regexp_extract_all(coalesce(text, ''), '{PHONE}'))::bigint as n_phone from documents"""
)
def contact_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.contacts(load(spark, sf_dir, "documents"))


@query(
    """with o as (select o_orderkey, month(o_orderdate) as m, year(o_orderdate) as y, (o_orderkey % 4)::int as k, case o_orderstatus when 'O' then 'Present' else (year(o_orderdate) + 1)::varchar end as e from orders)
 select o_orderkey, case k when 0 then m when 2 then m when 3 then m end::int as start_month, y::int as start_year,
  case k when 2 then m end::int as end_month, case when k = 0 then null when k = 2 then y + 2 when e = 'Present' then null else y + 1 end::int as end_year,
  (k not in (0, 2) and e = 'Present') as is_present from o"""
)
def date_range_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges in four notations, made from orders."""
    o = load(spark, sf_dir, "orders")
    m, y, k = F.month("o_orderdate"), F.year("o_orderdate"), F.col("o_orderkey") % 4
    end = F.when(F.col("o_orderstatus") == "O", "Present").otherwise((y + 1).cast("string"))
    line = (
        F.when(k == 0, F.concat(m.cast("string"), F.lit("/"), y.cast("string")))
        .when(k == 1, F.concat(F.lit("Role · Place · "), y.cast("string"), F.lit(" - "), end))
        .when(k == 2, F.format_string("%02d / %d – %02d / %d", m, y, m, y + 2))
        .otherwise(F.concat(F.date_format("o_orderdate", "MMM yyyy"), F.lit(" - "), end))
    )
    # Generators work their input out once; a plain column would be made anew for every use.
    o = o.select("o_orderkey", F.explode(F.array(line)).alias("line")).select("o_orderkey", F.explode(F.array(dates.parse_range(F.col("line")))).alias("r"))
    return o.select("o_orderkey", *(F.col("r")[f].alias(f) for f in ("start_month", "start_year", "end_month", "end_year", "is_present")))


NURL = r"""case when regexp_matches(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#:]+') then lower(regexp_extract(u, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' ||
 regexp_replace(lower(regexp_extract(u, '^[A-Za-z0-9+.-]+://([^/?#:]+)', 1)), '^www\.', '') || regexp_replace(regexp_extract(u, '^[A-Za-z0-9+.-]+://[^/?#]+([^?#]*)', 1), '/+$', '') ||
 regexp_extract(u, '^[^?#]*(\?[^#]+)', 1) else lower(regexp_replace(u, '/+$', '')) end"""


@query(f"select page_id, {NURL} as normal from (select page_id, case when contains(url, '://') then url else 'https://' || url end as u from (select page_id, trim(url) as url from pages))")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", urls.normal_url("url").alias("normal"))


@query(f"with n as (select page_id, {NURL} as normal from (select page_id, trim(url) as u from pages)), m as (select page_id * 2 as page_id, normal from n) select a.page_id, a.normal from n a where exists (select 1 from m where m.normal = a.normal and m.page_id = a.page_id)")
def url_equivalence_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose URL is another table's in normal form, for the same key."""
    p = load(spark, sf_dir, "pages").select("page_id", urls.normal_url("url").alias("normal"))
    other = p.select((F.col("page_id") * 2).alias("page_id"), "normal")
    return p.join(other, ["page_id", "normal"], "left_semi")


#: Block elements as an importer sees them, and the character references of a text.
_BLOCK = "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h1|h2|h3|h4|h5|h6|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul"
_DECODE = "x"
for _name, _char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", " "), ("copy", "©"), ("middot", "·"), ("#39", "''"), ("amp", "&")):
    _DECODE = f"regexp_replace({_DECODE}, '&{_name};?', '{_char}', 'g')"


@query(
    rf"""with a as (select page_id, html, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript)\b.*?</(script|style|noscript)>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '(?i)<!doctype[^>]*>', '', 'g') as t from pages),
 b as (select page_id, html, list_transform(regexp_split_to_array(regexp_replace(t, '(?i)</?({_BLOCK})(\s[^>]*)?/?>', chr(1), 'g'), chr(1)), lambda y: list_filter(list_transform(regexp_split_to_array(y, '<[^>]*>'), lambda x: trim(regexp_replace({_DECODE}, '[\s\x{{A0}}]+', ' ', 'g'))), lambda x: x <> '')) as p from a),
 c as (select page_id, html, array_to_string(list_transform(p, lambda x: array_to_string(x, ' ')), chr(10)) as t from b),
 d as (select page_id, html, trim(regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10) || ' ') as t from c)
 select page_id, length(t)::int as chars, md5(t) as digest, len(list_distinct(list_transform(list_filter(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1), lambda x: trim(x) <> '' and not starts_with(lower(trim(x)), 'javascript:')), lambda x: lower(x))))::int as links from d"""
)
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-body text and number of links of pages, as an importer reads them."""
    t = page_text(load(spark, sf_dir, "pages"))
    return t.select("page_id", F.length("text").alias("chars"), F.md5("text").alias("digest"), F.size("links").alias("links"))


@query(r"""select page_id, len(list_distinct(list_transform(list_filter(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1), lambda x: trim(x) <> '' and not starts_with(lower(trim(x)), 'javascript:')), lambda x: lower(x))))::bigint as links from pages""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct links of pages by pattern."""
    found = F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))
    return load(spark, sf_dir, "pages").select("page_id", F.size(urls.unique_links(found)).cast("long").alias("links"))


@query(
    r"""select p_partkey, case p_partkey % 5 when 0 then chr(10) || p_name || chr(10) || ' ' || p_type || ' and strong ' || chr(10) || '• first 5% of ' || p_name when 1 then p_name || ' ' || p_type
 when 2 then chr(10) || p_type || chr(10) || chr(10) || 'x' || chr(10) when 3 then 'deep ' || p_name || ' a' || chr(10) || 'b' else p_name || ' 100% ' || p_type end as t from part"""
)
def latex_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LaTeX sources as text: sections, nested font commands, items, comments, environments, options."""
    p = load(spark, sf_dir, "part")
    k, name, kind = F.col("p_partkey") % 5, F.col("p_name"), F.col("p_type")
    j = lambda *y: F.concat(*(F.lit(z) if isinstance(z, str) else z for z in y))
    src = (
        F.when(k == 0, j("\\section{", name, "} \\emph{", kind, "} and \\textbf{\\textit{strong}} % gone\n\\item first 5\\% of ", name))
        .when(k == 1, j("\\textbf{\\textit{\\emph{\\underline{", name, "}}}} {", kind, "}% all ", name))
        .when(k == 2, j("\\subsection*{", kind, "}\n\\begin{itemize}x\\end{itemize}\n% only this"))
        .when(k == 3, j("\\large[2pt]deep ", name, " a\n\\vspace*b")).otherwise(j(name, " 100\\% \\textbf{", kind, "}"))
    )
    return p.select("p_partkey", text.latex_to_text(src).alias("t"))


LINES = "select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1)::int - 1 as pos from documents"


@query(f"with l as ({LINES}), m as (select *, sum(case when length(line) <= 60 then 1 else 0 end) over (partition by doc_id order by pos) as block from l) select doc_id, block::bigint as block, count(*)::bigint as n_lines, md5(string_agg(line, chr(10) order by pos)) as digest from m group by doc_id, block")
def block_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that short lines open."""
    b = lines.blocks(lines.explode_lines(load(spark, sf_dir, "documents")), F.length("line") <= 60)
    return b.select("doc_id", F.col("block").cast("long").alias("block"), F.col("n_lines").cast("long").alias("n_lines"), F.md5("body").alias("digest"))


@query(f"with l as ({LINES.replace('text,', "coalesce(text, ''),")}), m as (select *, lag(line) over (partition by doc_id order by pos) as before from l) select doc_id, count(*)::bigint as lines, count(*) filter (before is null or before <> line)::bigint as kept from m group by doc_id")
def paragraph_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents, and those that differ from the line before; a null text counts as an empty one."""
    parts = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    d = load(spark, sf_dir, "documents").select("doc_id", parts.alias("p"))
    return d.select("doc_id", F.size("p").cast("long").alias("lines"), F.size(text.collapse_repeats(F.col("p"))).cast("long").alias("kept"))


@query(f"with l as ({LINES}) select doc_id, pos, min(case when length(line) <= 40 then pos end) over w as next_short, coalesce(max(case when length(line) > 200 then 1 else 0 end) over v, 0) = 1 as long_ahead from l window w as (partition by doc_id order by pos rows between 1 following and 4 following), v as (partition by doc_id order by pos rows between 1 following and 3 following)")
def line_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.explode_lines(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "pos", lines.next_position(F.length("line") <= 40, 4).alias("next_short"), lines.ahead(F.length("line") > 200, 3).alias("long_ahead"))


@query(f"with l as ({LINES}), f as (select *, length(line) <= 60 as flag from l), m as (select *, sum(case when flag then 0 else 1 end) over (partition by doc_id order by pos) as island from f), n as (select *, count(*) filter (flag) over (partition by doc_id, island) as c from m) select doc_id, pos, (case when flag and c >= 2 then c else 0 end)::bigint as run_length from n")
def short_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.runs(lines.explode_lines(load(spark, sf_dir, "documents")), F.length("line") <= 60)
    return found.select("doc_id", "pos", F.col("run_length").cast("long").alias("run_length"))


TITLES = ", ".join(f"'{w}'" for w in lines.TITLE_WORDS)
PART = r"(regexp_matches(p, '^\p{L}[\p{L}\p{M}''-]*$') and length(p) between 2 and 32 and not (length(p) <= 3 and p = lower(p)))"


@query(
    rf"""with c as (select c_custkey, unnest([c_name, 'Jane Q' || c_custkey || ' Doe', 'Anna Maria ' || chr(65 + (c_custkey % 26)::int) || 'anova', 'senior developer', 'Mia Novak', case c_custkey % 3 when 0 then 'Žofia Kis' when 1 then 'Anna-Lena Kisova' else 'With Love Redisova' end]) as line, unnest([0, 1, 2, 3, 4, 5]) as pos from customer),
 s as (select *, string_split(line, ' ') as parts from c),
 k as (select *, len(parts) between 2 and 4 and length(line) <= 60 and len(list_filter(parts, lambda p: {PART})) = len(parts) and len(list_filter(parts, lambda p: lower(p) in ({TITLES}))) = 0 as ok,
  list_sum(list_transform(parts, lambda p: (case when length(p) >= 4 then 4 else 0 end) + (case when strlen(p) > length(p) then 15 else 0 end) - (case when contains(p, '-') then 4 else 0 end) - (case when lower(p) in ('and', 'or', 'with', 'for', 'the', 'as') then 10 else 0 end))) + least(length(line), 40) as score from s)
 select c_custkey, line, score::int as score from (select *, row_number() over (partition by c_custkey order by score desc, pos) as r from k where ok) where r = 1"""
)
def name_line_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best name line of each customer's lines."""
    c = load(spark, sf_dir, "customer")
    own = F.array(
        "c_name", F.concat(F.lit("Jane Q"), F.col("c_custkey").cast("string"), F.lit(" Doe")),
        F.concat(F.lit("Anna Maria "), F.char(F.col("c_custkey") % 26 + 65), F.lit("anova")), F.lit("senior developer"), F.lit("Mia Novak"),
        F.when(F.col("c_custkey") % 3 == 0, "Žofia Kis").when(F.col("c_custkey") % 3 == 1, "Anna-Lena Kisova").otherwise("With Love Redisova"),
    )
    found = c.select("c_custkey", F.posexplode(own).alias("pos", "line")).where(lines.is_name_line(F.col("line"))).withColumn("score", lines.name_score(F.col("line")))
    best = Window.partitionBy("c_custkey").orderBy(F.col("score").desc(), "pos")
    return found.withColumn("r", F.row_number().over(best)).where("r = 1").select("c_custkey", "line", F.col("score").cast("int").alias("score"))


@query(
    f"""with w as (select doc_id, coalesce(text, '') as t, greatest(0, ceil((length(coalesce(text, '')) - 850) / 765.0))::bigint as last from documents),
 e as (select doc_id, unnest(generate_series(0, last)) as k, t from w) select doc_id, k::bigint as k, length(substr(t, k * 765 + 1, 850))::bigint as chars, md5(substr(t, k * 765 + 1, 850)) as digest from e"""
)
def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows of the compact profile over whole documents."""
    p = chunking.PROFILES["compact"]
    d = load(spark, sf_dir, "documents").fillna("", ["text"])
    e = d.select("doc_id", F.posexplode(chunking.windows(F.col("text"), p.slice_chars, p.overlap)).alias("k", "s"))
    return e.select("doc_id", F.col("k").cast("long").alias("k"), F.length("s").cast("long").alias("chars"), F.md5("s").alias("digest"))


@query(
    f"""with p as (select doc_id, list_filter(list_transform(string_split(replace(text, chr(10), chr(10) || chr(10)), chr(10) || chr(10)), lambda x: {TRIM % "x"}), lambda x: x <> '') as parts from (select doc_id, coalesce(text, '') as text from documents)),
 e as (select doc_id, parts, unnest(generate_series(0, greatest(ceil(len(parts) / 2.0)::bigint - 1, 0))) as k from p),
 s as (select doc_id, k, array_to_string(list_slice(parts, k * 2 + 1, k * 2 + 2), chr(10) || chr(10)) as s from e)
 select doc_id, k::bigint as k, length(case when length(s) <= 1900 then s else left(s, 1900) || '[...]' end)::bigint as chars from s"""
)
def chunk_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraph pairs of the small profile; every line counts as a paragraph here."""
    p = chunking.PROFILES["small"]
    d = load(spark, sf_dir, "documents").fillna("", ["text"])
    parts = text.paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n")))
    e = d.select("doc_id", F.posexplode(chunking.batches(parts, p.work, p.slice_chars)).alias("k", "s"))
    return e.select("doc_id", F.col("k").cast("long").alias("k"), F.length("s").cast("long").alias("chars"))


_HEADINGS = ", ".join(f"('{s}', '{k}', {n})" for n, (s, k) in enumerate((s, k) for s, ks in lines.HEADINGS.items() for k in ks))
_NOT = ", ".join(f"'{k}'" for k in lines.NOT_HEADINGS)
#: SQL: (doc_id, section, body) of the normalised texts in a table n (doc_id, t), the rules of headings worked out by a join with them.
SECTIONS = rf"""kw(section, k, o) as (values {_HEADINGS}), ln as (select doc_id, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as pos from n where t <> ''),
 br as (select *, regexp_replace({TRIM % "line"}, ':+$', '') as bare from ln),
 hd as (select doc_id, pos, arg_min(section, (100 - length(k)) * 1000 + o) as heading from br join kw on length(bare) between 1 and length(k) + {lines.SLACK} and length(bare) <= {lines.LONGEST} and contains(lower(bare), k)
  where lower(bare) not in ({_NOT}) and not regexp_matches(bare, '(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{{2,}}') and not regexp_matches(bare, '(?i)https?://') and not regexp_matches(bare, '(^|[^0-9])(19[5-9][0-9]|20[0-9][0-9])([^0-9]|$)') group by doc_id, pos),
 mk as (select br.doc_id, br.pos, br.line, heading, sum(case when heading is null then 0 else 1 end) over (partition by br.doc_id order by br.pos) as part from br left join hd on hd.doc_id = br.doc_id and hd.pos = br.pos),
 pt as (select doc_id, part, coalesce(max(heading), 'Header') as section, {TRIM % "coalesce(string_agg(line, chr(10) order by pos) filter (heading is null), '')"} as body from mk group by doc_id, part),
 no as (select doc_id, max(part) = 0 as none from pt group by doc_id),
 sc as (select doc_id, section, string_agg(body, chr(10) || chr(10) order by part) as body from pt where body <> '' group by doc_id, section),
 sections as (select sc.* from sc union all select sc.doc_id, 'AdditionalInformation', body from sc join no on no.doc_id = sc.doc_id where none)"""
_P = chunking.PROFILES["compact"]
_STEP = _P.slice_chars - min(120, _P.slice_chars // 10)


@query(
    rf"""with n as (select doc_id, {NORMAL} as t from (select doc_id, text as t from documents)), {SECTIONS},
 ph(o, phase, sections) as (values (0, 'Personal', ['Header', 'Contact', 'Summary']), (1, 'Work', ['WorkExperience']), (2, 'Education', ['Education']), (3, 'SkillsAndLanguages', ['Skills', 'Languages']), (4, 'Certificates', ['Certificates']), (5, 'Projects', ['Projects']), (6, 'Links', ['Links']), (7, 'Additional', ['AdditionalInformation'])),
 gl as (select n.doc_id, o, phase, coalesce(string_agg(body, chr(10) || chr(10) order by list_position(ph.sections, section)), case when o = 0 then any_value(t) end) as c from n cross join ph left join sections s on s.doc_id = n.doc_id and list_contains(ph.sections, s.section) group by n.doc_id, o, phase),
 pa as (select *, list_filter(list_transform(string_split(c, chr(10) || chr(10)), lambda x: {TRIM % "x"}), lambda x: x <> '') as parts from gl where c is not null and c <> ''),
 sl as (select doc_id, o, phase, case when len(parts) > 1 then list_transform(parts, lambda x: case when length(x) <= {_P.slice_chars} then length(x) else {_P.slice_chars} + 5 end)
  else list_transform(range(greatest(0, ceil((length(c) - {_P.slice_chars}) / {_STEP}.0))::bigint + 1), lambda i: length(substr(c, i * {_STEP} + 1, {_P.slice_chars}))) end as sizes from pa),
 ex as (select doc_id, o, phase, len(sizes) as batch_count, unnest(sizes) as chars, generate_subscripts(sizes, 1) as batch_index from sl)
 select doc_id, phase, batch_index::int as batch_index, batch_count::int as batch_count, (row_number() over (partition by doc_id order by o, batch_index) - 1)::int as step, chars::int as chars from ex"""
)
def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All calls that assisted import of each document takes, with the compact profile."""
    d = load(spark, sf_dir, "documents").select("doc_id", text.normalize("text").alias("text"))
    return chunking.plan(d, chunking.PROFILES["compact"]).select("doc_id", "phase", "batch_index", "batch_count", "step", F.length("slice").alias("chars"))


@query(
    f"select doc_id, coalesce(({NONWS % 'text'}) > 40 and not regexp_matches(text, '[0-9]|%') and not regexp_matches(text, '(?i)\\b({'|'.join(text.STRONG_VERBS)})\\b'), false) as generic from documents"
)
def generic_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text says nothing concrete; a null text counts as false."""
    return load(spark, sf_dir, "documents").select("doc_id", F.coalesce(text.is_generic("text"), F.lit(False)).alias("generic"))


@query(
    r"""with t as (select conv_id, string_agg(text, chr(10) order by turn) filter (role = 'user') as src, string_agg(text, chr(10) order by turn) filter (role <> 'user') as out from conversations group by conv_id),
 x as (select conv_id, coalesce(src, '') as src, list_concat(list_filter(list_transform(regexp_extract_all(coalesce(out, ''), '\d+(?:[.,]\d+)*\s?%?'), lambda x: trim(x)), lambda x: length(regexp_replace(x, '\D', '', 'g')) >= 2
   and not list_contains(regexp_extract_all(coalesce(src, ''), '\d+'), regexp_replace(x, '\D', '', 'g'))),
  list_filter(list_concat(regexp_extract_all(coalesce(out, ''), '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}'), regexp_extract_all(coalesce(out, ''), '[A-Z][\p{L}&]+(?:\s+[A-Z][\p{L}&]+)+')), lambda x: not contains(lower(coalesce(src, '')), lower(x)))) as every from t)
 select conv_id, array_to_string(list_slice(list_filter(every, lambda x, i: list_position(list_transform(every, lambda y: lower(y)), lower(x)) = i), 1, 6), '|') as tokens from x"""
)
def entity_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a conversation's answers that its questions do not hold."""
    c = load(spark, sf_dir, "conversations")
    said = lambda user: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("role") == "user") == user, F.struct("turn", "text")))), lambda x: x["text"]), "\n")
    t = c.groupBy("conv_id").agg(said(True).alias("src"), said(False).alias("out"))
    return t.select("conv_id", F.array_join(chunking.unsupported(F.col("src"), F.col("out")), "|").alias("tokens"))


ANSWERS = """t as (select conv_id, turn, coalesce(text, '') as x, (conv_id + turn) % 6 as k from conversations),
 r as (select conv_id, turn, case k when 0 then '```md' || chr(10) || x || chr(10) || '```' when 1 then '- first step — since ' || x when 2 then '2) do it - so' || chr(10) || x when 3 then '• a - b — c' || chr(10) || '-   ' || chr(10) || '* ' || x
  when 4 then ' ```' || chr(10) || '1. inside — it' || chr(10) || '``` ' else x end as raw from t)"""


@query(
    rf"""with {ANSWERS}, f as (select conv_id, turn, {TRIM % "raw"} as raw from r), u as (select conv_id, turn, case when starts_with(raw, '```') then regexp_replace(regexp_extract(raw, '(?s)^```[^\n]*\n(.*)$', 1), '(?s)```\s*$', '') else raw end as body from f),
 l as (select conv_id, turn, list_filter(list_transform(string_split(body, chr(10)), lambda x: {TRIM % "regexp_replace(trim(x), '^([-*•]|[0-9]+[.)])', '')"}), lambda x: x <> '') as items from u),
 s as (select *, case when strpos(items[1], ' — ') > 0 then strpos(items[1], ' — ') else strpos(items[1], ' - ') end as p from l)
 select conv_id, turn, least(len(items), 4)::bigint as items, coalesce(case when p > 0 then trim(left(items[1], p - 1)) else items[1] end, '') as first, case when p > 0 and trim(substr(items[1], p + 3)) <> '' then trim(substr(items[1], p + 3)) end as reason from s"""
)
def advice_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of list answers: fenced or not, with bullets, numbers, reasons after dashes, and none of these."""
    c = load(spark, sf_dir, "conversations").fillna("", ["text"])
    k, x = (F.col("conv_id") + F.col("turn")) % 6, F.col("text")
    j = lambda *y: F.concat(*(F.lit(z) if isinstance(z, str) else z for z in y))
    raw = (
        F.when(k == 0, j("```md\n", x, "\n```")).when(k == 1, j("- first step — since ", x)).when(k == 2, j("2) do it - so\n", x))
        .when(k == 3, j("• a - b — c\n-   \n* ", x)).when(k == 4, " ```\n1. inside — it\n``` ").otherwise(x)
    )
    out = c.select("conv_id", "turn", chunking.advice(raw).alias("a"))
    first = F.get("a", F.lit(0))
    return out.select("conv_id", "turn", F.size("a").cast("long").alias("items"), F.coalesce(first["advice"], F.lit("")).alias("first"), first["rationale"].alias("reason"))


_NUMBERED = r"^\s*(\d+)\s*[:).\-]\s*(.+?)\s*$"


@query(
    rf"""with t as (select o_orderkey, case o_orderkey % 4 when 0 then '1: first|noise| 2) z |0: none|1 - second ' || o_orderstatus when 1 then '1. v - ' || o_orderpriority || '|12: |3:' || o_orderkey when 2 then '4 - ' || o_orderstatus || '|5) a|no: b|-1: c'
  else '1: x|2:' || o_orderkey || '|' || chr(9) || '7.  tabbed  |8) 8: inner' end as raw from orders),
 l as (select o_orderkey, unnest(string_split(raw, '|')) as line, generate_subscripts(string_split(raw, '|'), 1) as pos from t),
 m as (select o_orderkey, pos, try_cast(regexp_extract(line, '{_NUMBERED}', 1) as int) as k, trim(regexp_extract(line, '{_NUMBERED}', 2)) as v from l where regexp_matches(line, '{_NUMBERED}'))
 select o_orderkey, arg_max(v, pos) filter (k = 1) as one, arg_max(v, pos) filter (k = 2) as two, (count(distinct k) filter (k >= 1))::int as n from m group by o_orderkey"""
)
def repair_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered answers; the last of a number wins, numbers below one and other lines go."""
    o = load(spark, sf_dir, "orders")
    k, status, prio, key = F.col("o_orderkey") % 4, F.col("o_orderstatus"), F.col("o_orderpriority"), F.col("o_orderkey").cast("string")
    j = lambda *y: F.concat(*(F.lit(z) if isinstance(z, str) else z for z in y))
    raw = (
        F.when(k == 0, j("1: first\nnoise\n 2) z \n0: none\n1 - second ", status))
        .when(k == 1, j("1. v - ", prio, "\n12: \n3:", key)).when(k == 2, j("4 - ", status, "\n5) a\nno: b\n-1: c"))
        .otherwise(j("1: x\n2:", key, "\n\t7.  tabbed  \n8) 8: inner"))
    )
    m = chunking.repairs(raw)
    return o.select("o_orderkey", F.element_at(m, 1).alias("one"), F.element_at(m, 2).alias("two"), F.size(m).alias("n"))


@query("select doc_id, upper(sha256(coalesce(text, '') || chr(31) || coalesce(lang, ''))) as digest from documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", text.content_hash("text", "lang").alias("digest"))


@query("select n_name, case when contains(lower(n_name), 'on_1') then 1 else 0 end as hit from nation where contains(lower(n_name), 'on_1') order by n_name limit 12")
def suggest_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twelve names that hold a text: a top-k report."""
    return ordering.suggest(load(spark, sf_dir, "nation").select("n_name", F.lit(1).alias("hit")), "n_name", "ON_1")


ESC_L = "replace(replace(replace(replace(replace(replace(replace(replace(x, '\\', '\\textbackslash{}'), '&', '\\&'), '%', '\\%'), '$', '\\$'), '#', '\\#'), '_', '\\_'), '{', '\\{'), '}', '\\}')"


@query(
    f"""with s as (select p_partkey, p_name || ' & <' || p_brand || '> "' || p_type || '" 5% | a_b,c' as x from part)
 select p_partkey, replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') as html, replace(x, '|', '\\|') as markdown, {ESC_L} as latex, '"' || replace(x, '"', '""') || '"' as csv,
 regexp_replace(regexp_replace(repeat(x, p_size % 9), '(.{{100}})', '\\1' || chr(10), 'g'), chr(10) || '$', '') as wrapped from (select s.*, p_size from s join part using (p_partkey))"""
)
def export_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    x = F.concat("p_name", F.lit(" & <"), "p_brand", F.lit('> "'), "p_type", F.lit('" 5% | a_b,c'))
    p = p.select("p_partkey", "p_size", x.alias("x"))
    return p.select("p_partkey", text.escape_html("x").alias("html"), text.escape_markdown("x").alias("markdown"), text.escape_latex("x").alias("latex"), text.escape_csv("x", ",").alias("csv"), text.wrap_plain(F.expr("repeat(x, p_size % 9)")).alias("wrapped"))


@query("select c_custkey, case when c_custkey % 5 = 0 then 'CV' else c_name || '_' || c_mktsegment end || '.pdf' as file, upper(left(c_name, 1)) || upper(left(c_mktsegment, 1)) as initials from customer")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    blank = F.col("c_custkey") % 5 == 0
    first, last = F.when(blank, F.lit(" ")).otherwise(F.col("c_name")), F.when(blank, F.lit("")).otherwise(F.col("c_mktsegment"))
    return c.select("c_custkey", text.suggested_file(first, last, ".pdf").alias("file"), text.initials("c_name", "c_mktsegment").alias("initials"))
