"""Line tables: headers, sections, blocks. One window over (document, position) serves every rule that looks around."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions import cues, dates
from dossier.functions.cues import EMAIL, PHONE
from dossier.functions.text import WS_CHARS, has_text, let, trim_ws
from dossier.functions.urls import URL

# Section headings by section, in order of preference.
HEADINGS = {
    "Contact": ["contact information", "contact", "kontakt"],
    "Summary": ["professional summary", "personal summary", "summary", "profile", "about me", "objective", "profil", "zhrnutie", "o mne"],
    "WorkExperience": ["work experience", "professional experience", "employment history", "employment", "experience", "pracovné skúsenosti", "pracovne skusenosti", "kariéra"],
    "Education": ["academic background", "education and training", "education", "vzdelanie", "štúdium", "studium"],
    "Skills": ["technical skills", "core competencies", "technologies", "skills", "zručnosti", "zrucnosti", "technológie"],
    "Languages": ["language skills", "languages", "jazykové zručnosti", "jazyky"],
    "Certificates": ["certifications", "certificates", "licenses", "certifikáty", "certifikaty"],
    "Projects": ["selected projects", "personal projects", "projects", "projekty"],
    "Links": ["online profiles", "links", "odkazy"],
    "AdditionalInformation": ["additional information", "volunteering", "publications", "interests", "hobbies", "awards", "dodatočné informácie", "dodatocne informacie", "záujmy", "zajmy"],
}
NOT_HEADINGS = ("technologies", "achievements", "company url", "institution url")
#: Characters a line may have beyond a heading it holds, and at most in all.
SLACK, LONGEST = 4, 60


def explode_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, line) of every line; a null text has none."""
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))


def bare(line: Column) -> Column:
    """A heading candidate: trimmed, without closing colons."""
    return F.rtrim(trim_ws(line), F.lit(":"))


def heading_of(line: Column) -> Column:
    """Section that a line heads, null for other lines.

    The longest heading that the line equals, or holds with few characters more, wins; of equals the first. Lines with
    an address, a URL or a date, and sub-headings of entries, head nothing. The headings are 59 literals, so the theta
    join with them is one expression.
    """
    order = [(len(k), -n, s, k) for n, (s, k) in enumerate((s, k) for s, ks in HEADINGS.items() for k in ks)]

    def named(b: Column) -> Column:
        return let(F.lower(b), lambda low: F.when(~low.isin(*NOT_HEADINGS), best(low, F.length(b))))

    def best(low: Column, size: Column) -> Column:
        found = F.lit(None).cast("string")
        for n, _, section, k in sorted(order):
            found = F.when((size <= n + SLACK) & low.contains(k), section).otherwise(found)
        return found

    def head(b: Column) -> Column:
        return let(named(b), lambda s: F.when(s.isNotNull() & ~b.rlike(EMAIL) & ~b.rlike(URL) & dates.parse_range(b).isNull(), s))

    # No heading is longer than the longest keyword with its slack, so most lines end here: without colons and spaces at
    # both ends a line is no longer than its bare form.
    longest = min(LONGEST, max(n for n, *_ in order) + SLACK)
    short = F.length(F.btrim(line, F.lit(WS_CHARS + ":"))).between(1, longest)
    return F.when(short, let(bare(line), lambda b: F.when(F.length(b).between(1, longest), head(b))))


def with_sections(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``sections``, a map of section to body with 'Header' for what stands before the first heading, and ``warning``.

    Everything happens inside a row, so nothing is shuffled and rows may repeat their keys. Repeated headings add to
    their section after a blank line. A text without headings is header and additional information alike, with a
    warning; a null or blank text has an empty map. Columns of these two names are replaced.
    """
    docs = docs.drop("sections", "warning")
    given = [F.col(c) for c in docs.columns]
    marks = F.filter(F.transform(F.col("_lines"), lambda x, i: F.struct(i.alias("at"), heading_of(x).alias("section"))), lambda m: m["section"].isNotNull())
    # A generator works its input out once; a plain column would be made anew for every part.
    split = docs.select(*given, F.explode(F.array(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1))).alias("_lines"))
    marked = split.select(*given, "_lines", F.explode(F.array(marks)).alias("_marks"))

    def part(j: Column) -> Column:
        first = F.when(j > 0, F.get("_marks", j - 1)["at"] + 1).otherwise(0)
        end = F.coalesce(F.get("_marks", j)["at"], F.size("_lines"))
        body = trim_ws(F.array_join(F.slice("_lines", first + 1, F.greatest(end - first, F.lit(0))), "\n"))
        return F.struct(F.when(j > 0, F.get("_marks", j - 1)["section"]).otherwise("Header").alias("section"), body.alias("body"))

    parts = F.filter(F.transform(F.sequence(F.lit(0), F.size("_marks")), part), lambda p: p["body"] != "")
    cut = marked.select(*given, F.explode(F.array(parts)).alias("_parts"), F.size("_marks").alias("_n"))
    names = F.array_distinct(F.transform("_parts", lambda p: p["section"]))
    joined = lambda name: F.array_join(F.transform(F.filter("_parts", lambda p: p["section"] == name), lambda p: p["body"]), "\n\n")
    found = F.map_from_arrays(names, F.transform(names, joined))
    whole = F.get("_parts", F.lit(0))["body"]
    none = (F.col("_n") == 0) & (F.size("_parts") > 0)
    sections = F.when(none, F.create_map(F.lit("Header"), whole, F.lit("AdditionalInformation"), whole)).otherwise(found)
    return cut.select(*given, sections.alias("sections"), F.when(none, "no_sections").alias("warning"))


def segment(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section, body, warning): a row per section with a body, see ``with_sections``."""
    found = with_sections(docs.select(key, F.col(text).alias("_text")), "_text")
    return found.select(key, F.explode("sections").alias("section", "body"), "warning")


def blocks(lines: DataFrame, starts: Column, key: str = "doc_id") -> DataFrame:
    """(key, block, n_lines, body): islands of lines, each opened by a start; lines before the first start are block 0."""
    w = Window.partitionBy(key).orderBy("pos")
    marked = lines.withColumn("block", F.sum(F.when(starts, 1).otherwise(0)).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    return marked.groupBy(key, "block").agg(F.count("*").alias("n_lines"), body.alias("body"))


def ahead(flag: Column, n: int, key: str = "doc_id") -> Column:
    """Whether one of the next n lines has a flag."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(1, n)
    return F.coalesce(F.max(flag.cast("int")).over(w), F.lit(0)) == 1


def next_position(flag: Column, n: int, key: str = "doc_id") -> Column:
    """Position of the first of the next n lines with a flag, null without one."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(1, n)
    return F.min(F.when(flag, F.col("pos"))).over(w)


def runs(lines: DataFrame, flag: Column, least: int = 2, key: str = "doc_id") -> DataFrame:
    """Lines with ``run_length``: the length of the run of flagged lines they are in if it has ``least`` lines, else 0."""
    w = Window.partitionBy(key).orderBy("pos")
    marked = lines.withColumn("flag", flag).withColumn("island", F.sum(F.when(F.col("flag"), 0).otherwise(1)).over(w))
    n = F.count_if(F.col("flag")).over(Window.partitionBy(key, "island"))
    return marked.withColumn("run_length", F.when(F.col("flag") & (n >= least), n).otherwise(0)).drop("flag", "island")


def work_starts(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines with ``starts``: a job header with a date in the next three lines, or a title before a dotted line with one."""
    w = Window.partitionBy(key).orderBy("pos")
    flagged = lines.withColumn("has_date", dates.parse_range(F.col("line")).isNotNull())
    dotted = F.coalesce(F.lead("line").over(w).contains("·") & F.lead("has_date").over(w), F.lit(False))
    plain = cues.work_header(F.col("line")) & ahead(F.col("has_date"), 3, key)
    return flagged.withColumn("starts", has_text("line") & ~F.col("has_date") & (dotted | plain))


def split_title_company(line: Column) -> Column:
    """struct<job_title, company>: 'title at company', 'company - title' or 'title | company'; else all is title."""
    t = trim_ws(line)
    at = F.instr(F.lower(t), F.lit(" at "))
    dash = F.instr(t, F.lit(" - "))
    bar = F.instr(t, F.lit("|"))

    def cut(n: Column, size: int) -> tuple[Column, Column]:
        return trim_ws(F.substring(t, F.lit(1), n - 1)), trim_ws(F.substring(t, n + size, F.length(t)))

    title = F.when(at > 0, cut(at, 4)[0]).when(dash > 0, cut(dash, 3)[1]).when(bar > 0, cut(bar, 1)[0]).otherwise(t)
    company = F.when(at > 0, cut(at, 4)[1]).when(dash > 0, cut(dash, 3)[0]).when(bar > 0, cut(bar, 1)[1]).otherwise("")
    return F.struct(title.alias("job_title"), company.alias("company"))


# Words that no line with a name holds, and names of technologies and headings that are no names of people.
TITLE_WORDS = (
    "developer", "engineer", "manager", "director", "years", "experience", "full", "stack", "senior", "junior", "privileged", "access", "management", "platform", "copilot",
    "excalibur", "oauth", "cybersecurity", "microservices", "integrating", "designed", "developed", "contributed", "implemented", "delivered", "building", "frontend", "backend",
    "product", "standards", "technical", "authentication",
)
TECHNOLOGY_NAMES = (
    "typescript", "javascript", "redis", "react", "reactjs", "react-native", "nestjs", "node", "nodejs", "node.js", "postgresql", "docker", "go", "php", "oauth", "copilot",
    "excalibur", "nette", "jquery", "next.js", "sharepoint", "android", "azure", "frontend", "backend", "senior", "junior", "medior", "general", "work", "contact", "design",
    "built", "developed", "implemented", "contributed", "collaborated", "delivered", "integrated", "worked", "project", "platforms", "microservices", "cybersecurity",
)


def is_name_part(token: Column) -> Column:
    """Letters, marks, apostrophes and hyphens, 2 to 32 characters; short words without a capital and technologies are none."""
    shape = token.rlike(r"^\p{L}[\p{L}\p{M}'-]*$") & F.length(token).between(2, 32)
    return shape & ~((F.length(token) <= 3) & ~token.rlike(r"\p{Lu}")) & ~F.lower(token).isin(*TECHNOLOGY_NAMES)


def is_name_line(line: Column, dated: Column | None = None) -> Column:
    """Two to four name parts in at most 60 characters, without contact data, dates or words of titles."""
    t = trim_ws(line)
    parts = F.split(F.regexp_replace(t, r"(?U)\s+", " "), " ")
    titles = t.rlike(rf"(?iU)\b({'|'.join(TITLE_WORDS)})\b")
    contact = t.rlike(EMAIL) | t.rlike(PHONE) | t.rlike(URL)
    dated = dates.parse_range(t).isNotNull() if dated is None else dated
    return F.size(parts).between(2, 4) & (F.length(t) <= 60) & F.forall(parts, is_name_part) & ~titles & ~contact & ~dated


def split_name(lines: Column) -> Column:
    """struct<first_name, last_name> of the first two neighbouring lines that are a name part each, null without such."""
    pairs = F.filter(F.sequence(F.lit(0), F.greatest(F.size(lines) - 2, F.lit(0))), lambda i: is_name_part(trim_ws(F.get(lines, i))) & is_name_part(trim_ws(F.get(lines, i + 1))))
    at = F.get(pairs, F.lit(0))
    return F.when(at.isNotNull(), F.struct(trim_ws(F.get(lines, at)).alias("first_name"), trim_ws(F.get(lines, at + 1)).alias("last_name")))


def name_score(line: Column) -> Column:
    """How much a line of a name is worth: its length up to 40, and for each part 4 if it has four characters or more, 15 if
    one is not ASCII, 4 less for a hyphen, 10 less for a small word or a technology."""
    t = trim_ws(line)
    parts = F.split(F.regexp_replace(t, r"(?U)\s+", " "), " ")
    no_name = lambda p: F.lower(p).isin(*cues.SKILL_STOP_WORDS, *TECHNOLOGY_NAMES)
    worth = lambda p: F.when(F.length(p) >= 4, 4).otherwise(0) + F.when(p.rlike(r"[^\x00-\x7F]"), 15).otherwise(0) - F.when(p.contains("-"), 4).otherwise(0) - F.when(no_name(p), 10).otherwise(0)
    return F.aggregate(parts, F.lit(0), lambda n, p: n + worth(p)) + F.least(F.length(t), F.lit(40))


def contacts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, email, phone, url, n_email, n_phone): first matches, empty without one."""
    t = F.coalesce(F.col(text), F.lit(""))
    url = "(?i)(" + URL.removeprefix("(?i)") + ")"
    return docs.select(
        key,
        F.regexp_extract(t, f"(?i)({EMAIL.removeprefix('(?i)')})", 1).alias("email"),
        F.regexp_extract(t, f"({PHONE})", 1).alias("phone"),
        F.regexp_extract(t, url, 1).alias("url"),
        F.regexp_count(t, F.lit(EMAIL)).cast("long").alias("n_email"),
        F.regexp_count(t, F.lit(PHONE)).cast("long").alias("n_phone"),
    )


def labelled(line: Column) -> Column:
    """struct<label, value> of 'label: value' lines, null otherwise."""
    shape = r"(?U)^([A-Za-zÀ-ž\s]+):\s*(.+)$"
    return F.when(line.rlike(shape), F.struct(trim_ws(F.regexp_extract(line, shape, 1)).alias("label"), trim_ws(F.regexp_extract(line, shape, 2)).alias("value")))
