"""Rules that look at the lines around one: next- and previous-occurrence arrays, and what reads jobs and skills with them.

A rule that looks ahead asks for the place of the next line of a kind. One array per kind answers that for all lines of a text:
the places of the kind, each repeated as often as there are lines for which it is the next, so it is built in linear time
inside a row, and a rule looks ahead by one access. Nothing is exploded or shuffled, and rows may repeat their keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions import cues, dates
from dossier.functions.text import has_text, let, lines_of, paragraphs, split_items, trim_ws
from dossier.operators.folds import degree_first, degree_title, education_blocks, education_votes, meta_lines, trailing_range
from dossier.operators.lines import is_name_line

#: Lines after a start in which a date has to come, and lines in which a skill has to follow its category.
DATE_WITHIN, SKILL_WITHIN = 3, 4
#: Lines of a job in which its end is sought.
HEADER_LINES = 8
#: How lines begin that are no category in an export, beside those of ``cues``.
NO_EXPORT_CATEGORIES = (*cues.NOT_CATEGORIES, "mobile", "developed")
DEFAULT_CATEGORY = "General"


def places(flags: Column) -> Column:
    """Places of the true ones."""
    return F.filter(F.transform(flags, lambda f, i: F.when(f, i)), lambda i: i.isNotNull())


def next_places(flags: Column) -> Column:
    """For each place the first one at or after it that is true, null without one."""

    def of(at: Column) -> Column:
        runs = F.transform(at, lambda x, k: F.array_repeat(x, x - F.coalesce(F.get(at, k - 1), F.lit(-1))))
        rest = F.array_repeat(F.lit(None).cast("int"), F.size(flags) - 1 - F.coalesce(F.try_element_at(at, F.lit(-1)), F.lit(-1)))
        return F.concat(F.flatten(runs), rest)

    return let(places(flags), of)


def previous_places(flags: Column) -> Column:
    """For each place the last one at or before it that is true, null without one."""

    def of(at: Column) -> Column:
        runs = F.transform(at, lambda x, k: F.array_repeat(x, F.coalesce(F.get(at, k + 1), F.size(flags)) - x))
        return F.concat(F.array_repeat(F.lit(None).cast("int"), F.coalesce(F.get(at, F.lit(0)), F.size(flags))), F.flatten(runs))

    return let(places(flags), of)


def within(following: Column, i: Column, n: int) -> Column:
    """Whether one of the n lines after line i is of the kind whose next places are given."""
    return F.coalesce(F.get(following, i + 1) <= i + n, F.lit(False))


def islands(lines: Column, starts: Column) -> Column:
    """Lines in blocks, each opened by a start; lines before the first start are a block of their own."""

    def of(at: Column) -> Column:
        return F.transform(at, lambda x, k: F.slice(lines, x + 1, F.coalesce(F.get(at, k + 1), F.size(lines)) - x))

    return F.when(F.size(lines) == 0, F.array().cast("array<array<string>>")).otherwise(let(F.array_union(F.array(F.lit(0)), places(starts)), of))


def labelled_block(body: Column, header: str) -> Column:
    """The lines with a colon that follow a heading, up to the first other line; blank lines and the heading again end nothing."""

    def of(lines: Column) -> Column:
        heads = F.transform(lines, lambda x: F.lower(x) == header.lower())
        # Once a heading has come, the first line that is neither blank, labelled nor a heading ends all.
        begun = F.get(places(heads), F.lit(0))
        other = F.transform(lines, lambda x, i: (i > begun) & (x != "") & ~x.contains(":") & (F.lower(x) != header.lower()))
        end = F.coalesce(F.get(places(other), F.lit(0)), F.size(lines))
        found = F.slice(lines, begun + 1, end - begun)
        return F.when(begun.isNull(), F.array().cast("array<string>")).otherwise(F.filter(found, lambda x: x.contains(":") & (F.lower(x) != header.lower())))

    return let(F.transform(F.split(body, "\n", -1), trim_ws), of)


def export_meta(line: Column) -> Column:
    """The line under a title in an export: parts between dots with a date at the end, a company's form or a kind of employment."""
    return line.contains("·") & (trailing_range(line).isNotNull() | cues.employment(line))


def work_starts(lines: Column) -> Column:
    """For each line whether a job starts with it: a title over an export's meta line, or a header with a date soon after."""

    def fact(x: Column) -> Column:
        dated = dates.parse_range(x).isNotNull()
        return F.struct(x.contains("·").alias("dotted"), dated.alias("dated"), export_meta(x).alias("meta"), cues.work_header(x).alias("header"))

    def of(facts: Column) -> Column:
        return let(next_places(F.transform(facts, lambda f: f["dated"])), lambda following: F.transform(facts, lambda f, i: start(facts, following, f, i)))

    def start(facts: Column, following: Column, f: Column, i: Column) -> Column:
        title = ~f["dotted"] & ~f["dated"] & F.coalesce(F.get(facts, i + 1)["meta"], F.lit(False))
        return title | (~f["dotted"] & f["header"] & within(following, i, DATE_WITHIN))

    return let(F.transform(lines, fact), of)


def work_blocks(body: Column) -> Column:
    """Jobs of a section as blocks of trimmed lines without blank ones; null for a null text."""
    return let(lines_of(body), lambda lines: islands(lines, work_starts(lines)))


def education_section(body: Column) -> Column:
    """Entries of an education section as blocks of text, each with its continuations; null for a null text.

    Blocks vote on the layout. Where institutions do not come first and a degree's line comes before any date, each degree's line
    opens an entry, if there are several; else blank lines part them.
    """

    def blocks(text: Column) -> Column:
        lines = lines_of(text)
        by_degree = F.transform(islands(lines, F.transform(lines, lambda x, i: (i == 0) | degree_title(x))), lambda b: F.array_join(b, "\n"))
        first = ~education_votes(paragraphs(text)) & degree_first(F.transform(F.split(text, "\n", -1), trim_ws))
        pick = lambda made: F.when(first & (F.size(made) > 1), made).otherwise(paragraphs(text))
        return let(let(by_degree, pick), education_blocks)

    return let(F.array_join(meta_lines(body), "\n"), blocks)


def present_mark(lines: Column, start_year: Column) -> Column:
    """struct<start_month, start_year, is_current> of the first of a job's first lines that says it goes on; null without one.

    A word for the present counts alone only below the first line or if the start is known, and leaves the start as it
    is; a range that ends in the present gives the start.
    """
    none = F.lit(None).cast("int")

    def of(x: Column, i: Column) -> Column:
        alone = dates.is_present(trim_ws(x)) & (start_year.isNotNull() | (i > 0))
        found = lambda r: F.when(r["is_present"], F.struct(r["start_month"].alias("start_month"), r["start_year"].alias("start_year"), F.lit(True).alias("is_current")))
        direct, trailing = dates.parse_range(x), trailing_range(x)
        said = F.struct(none.alias("start_month"), none.alias("start_year"), F.lit(True).alias("is_current"))
        return F.when(alone, said).otherwise(F.coalesce(let(direct, found), let(trailing, found)))

    return F.get(F.filter(F.transform(F.slice(lines, 1, HEADER_LINES), of), lambda m: m.isNotNull()), F.lit(0))


def with_skill_lines(df: DataFrame, body: str = "body") -> DataFrame:
    """``df`` with ``skill_lines``, of each trimmed line of a skill section (line, skill, opens, kind, category, names); null for a null text.

    ``skill`` is the skill of an export's line. ``opens`` tells category lines; in exports (sections that hold such a line) a
    skill has to follow a category within four lines. ``kind`` is 1 for lines with skills, 2 for groups of their own
    ('category: a, b'), 3 for groups that stay open, else 0.
    """
    given = [F.col(c) for c in df.columns]
    names = lambda *xs: F.array(*xs).cast("array<string>")
    no_names = F.array().cast("array<string>")
    listed = lambda text: F.filter(split_items(text, ","), lambda y: cues.plausible_skill(y))

    def fact(x: Column) -> Column:
        """All that does not depend on other lines."""

        def of(dated: Column) -> Column:
            label, rest, bullet = trim_ws(F.substring_index(x, ":", 1)), F.regexp_replace(x, "^[^:]*:", ""), trim_ws(F.substring(x, 3, 1_000_000_000))
            other = cues.subheading(x) | cues.work_bleed(x, dated) | is_name_line(x, dated)
            own = x.contains(":") & ~cues.subheading(label) & has_text(rest)
            said = x.rlike(rf"(?iU)^({'|'.join(NO_EXPORT_CATEGORIES)})\b")
            form = F.when((x == "") | other, "none").when(x.contains(":"), F.when(own, "own").otherwise("none")).when(x.startswith("- "), "bullet").when(x.contains(","), "list").otherwise("word")
            found = F.when(own, listed(rest)).when(x.startswith("- "), F.filter(names(bullet), lambda y: cues.plausible_skill(y))).when(x.contains(","), listed(x)).otherwise(names(x))
            return F.struct(
                x.alias("line"), cues.skill_preview(x, dated).alias("skill"), form.alias("form"), label.alias("label"), found.alias("names"), cues.plausible_category(x, dated).alias("plausible"), cues.standalone_skill(x, dated).alias("lone"),
                (~said & ~x.contains("·") & ~x.contains(":") & ~x.startswith("- ") & ~other).alias("shape"), (cues.known_category(x) | x.contains("&") | F.lower(x).contains(" and ")).alias("wide"),
            )

        return let(cues.is_dated(x), of)

    def opens(f: Column, i: Column) -> Column:
        followed = within(F.col("_next"), i, SKILL_WITHIN)
        own = F.when(f["wide"], followed | f["plausible"]).otherwise(followed & ~f["lone"] & f["plausible"])
        return F.when(F.col("_native"), f["shape"] & f["skill"].isNull() & own).otherwise(f["plausible"])

    def event(f: Column, opened: Column) -> Column:
        row = lambda kind, category, found: F.struct(F.lit(kind).alias("kind"), category.alias("category"), found.alias("names"))
        none = F.lit("")
        nothing = row(0, none, no_names)
        return (
            F.when(f["form"] == "none", nothing)
            .when(f["skill"].isNotNull(), row(1, none, names(f["skill"])))
            .when(f["form"] == "own", F.when((f["label"] == "") & (F.size(f["names"]) == 0), nothing).otherwise(row(2, f["label"], f["names"])))
            .when(f["form"] == "bullet", row(1, none, f["names"]))
            .when(f["form"] == "list", F.when(F.size(f["names"]) < 2, nothing).otherwise(row(1, none, f["names"])))
            .when(opened, row(3, f["line"], no_names))
            .when(~F.col("_native") & f["lone"], row(1, none, f["names"]))
            .otherwise(nothing)
        )

    lines = F.transform(F.split(F.col(body), "\n", -1), trim_ws)
    # Generators work their input out once; plain columns would be made anew for every use.
    df = df.select(*given, F.explode(F.array(F.transform(lines, fact))).alias("_facts"))
    skill = F.transform("_facts", lambda f: f["skill"].isNotNull())
    df = df.select(*given, "_facts", F.explode(F.array(next_places(skill))).alias("_next"), F.exists("_facts", lambda f: f["skill"].isNotNull()).alias("_native"))
    df = df.select(*given, "_facts", "_native", F.explode(F.array(F.transform("_facts", opens))).alias("_opens"))

    def joined(f: Column, opened: Column) -> Column:
        e = event(f, opened)
        return F.struct(f["line"].alias("line"), f["skill"].alias("skill"), opened.alias("opens"), e["kind"].alias("kind"), e["category"].alias("category"), e["names"].alias("names"))

    return df.select(*given, F.explode(F.array(F.zip_with("_facts", "_opens", joined))).alias("skill_lines"))


def trimmed_skills(body: Column, skill_lines: Column) -> Column:
    """A skill section from its first skill of an export, general heading or category on; whole without one or if it is the first line."""
    marks = F.transform(skill_lines, lambda e: e["skill"].isNotNull() | (F.lower(e["line"]) == DEFAULT_CATEGORY.lower()) | e["opens"])
    rest = lambda at: F.array_join(F.transform(F.slice(skill_lines, at + 1, F.size(skill_lines)), lambda e: e["line"]), "\n")
    return let(F.coalesce(F.get(places(marks), F.lit(0)), F.lit(0)), lambda at: F.when(at > 0, rest(at)).otherwise(body))


def skill_groups(skill_lines: Column) -> Column:
    """array<struct<category, names>> of a skill section's lines.

    Skills go to the group that is open, else to the general one, which is made where it is first wanted. Groups that
    are a person's name and hold nothing go.
    """
    no_names = F.array().cast("array<string>")

    def owned(before: Column) -> Column:
        """Lines with the place of the open group, null where the general one is meant."""
        open_ = lambda i: F.when(F.get(skill_lines, F.get(before, i))["kind"] == 3, F.get(before, i))
        return F.transform(skill_lines, lambda e, i: F.struct(e["kind"].alias("kind"), e["category"].alias("category"), e["names"].alias("names"), i.alias("at"), open_(i).alias("group")))

    def grouped(found: Column) -> Column:
        loose = F.filter(found, lambda e: (e["kind"] == 1) & e["group"].isNull())
        made = F.transform(F.filter(found, lambda e: e["kind"] >= 2), lambda e: F.struct(e["at"].alias("at"), e["category"].alias("category"), e["names"].alias("names")))
        first = F.get(loose, F.lit(0))["at"]
        there = F.get(F.filter(made, lambda e: (F.lower(e["category"]) == DEFAULT_CATEGORY.lower()) & (e["at"] < first)), F.lit(0))["at"]
        new = F.struct(first.alias("at"), F.lit(DEFAULT_CATEGORY).alias("category"), no_names.alias("names"))
        groups = F.when(first.isNotNull() & there.isNull(), F.array_sort(F.concat(F.array(new), made))).otherwise(made)
        more = F.flatten(F.transform(loose, lambda e: e["names"]))
        return let(F.struct(groups.alias("groups"), F.coalesce(there, first).alias("general"), more.alias("more")), lambda g: filled(found, g))

    def filled(found: Column, g: Column) -> Column:
        def of(x: Column, k: Column) -> Column:
            # Skills of an open group stand between it and the next one.
            following = F.coalesce(F.get(g["groups"], k + 1)["at"], F.size(found))
            own = F.filter(F.slice(found, x["at"] + 1, following - x["at"]), lambda e: (e["kind"] == 1) & (e["group"] == x["at"]))
            rest = F.when(x["at"] == g["general"], g["more"]).otherwise(no_names)
            return F.struct(x["category"].alias("category"), F.concat(x["names"], F.flatten(F.transform(own, lambda e: e["names"])), rest).alias("names"))

        return F.transform(g["groups"], of)

    made = let(let(previous_places(F.transform(skill_lines, lambda e: e["kind"] >= 2)), owned), grouped)
    return F.filter(made, lambda g: ~(is_name_line(g["category"]) & (F.size(g["names"]) == 0)))
