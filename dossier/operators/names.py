"""Names and skill tokens in segmented texts: where a name is sought when the header has none, and what skills a sidebar lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions import cues
from dossier.functions.text import let, lines_of, split_items, trim_ws
from dossier.operators.lines import is_name_line, is_name_part, name_score, split_name

#: Sections in which a name is sought, in order, and how many lines of running text are read.
SEARCHED, SUMMARY_LINES = ("Contact", "Skills", "WorkExperience", "Summary"), 25
#: A skill of an export: name, level and maybe years between middle dots.
SKILL_LINE = r"^([^·]+?)\s*·\s*(?:Beginner|Intermediate|Advanced|Expert)\b"


def last_line(block: Column) -> Column:
    """The last line that is not blank, empty without one."""
    return F.coalesce(F.try_element_at(lines_of(block), F.lit(-1)), F.lit(""))


def repeats_title(line: Column, title: Column) -> Column:
    return F.lower(trim_ws(line)) == F.lower(trim_ws(title))


def personal_lines(sections: Column) -> Column:
    """The lines of the header and then of all other sections of a map, without blanks."""
    header = F.coalesce(F.element_at(sections, F.lit("Header")), F.lit(""))
    rest = F.map_values(F.map_filter(sections, lambda k, _: k != "Header"))
    return F.concat(lines_of(header), F.flatten(F.transform(rest, lines_of)))


def best_name(lines: Column) -> Column:
    """The line with the best score among those that are names, the first of equals; null without one."""
    scored = F.transform(lines, lambda x, i: F.struct(F.when(is_name_line(x), name_score(x)).alias("score"), (-i).alias("at"), x.alias("line")))
    top = F.array_max(scored)  # nulls are the least
    return F.when(top["score"].isNotNull(), top["line"])


def named(lines: Column) -> Column:
    """struct<first_name, last_name> of a name line, else of two neighbouring name parts; null without either."""
    whole = lambda line: F.struct(F.split_part(line, F.lit(" "), F.lit(1)).alias("first_name"), trim_ws(F.regexp_replace(line, r"^\S+", "")).alias("last_name"))
    return let(best_name(lines), lambda line: F.when(line.isNotNull(), whole(line)).otherwise(split_name(lines)))


def name_elsewhere(sections: Column) -> Column:
    """struct<first_name, last_name, section> from the first searched section that holds a name; null without one.

    Such a name has low confidence and comes with a warning.
    """
    found = []
    for s in SEARCHED:
        lines = lines_of(F.element_at(sections, F.lit(s)))
        found.append(F.struct(F.lit(s).alias("section"), (F.slice(lines, 1, SUMMARY_LINES) if s == "Summary" else lines).alias("lines")))
    # One expression reads all sections; later ones are read only if none before held a name.
    none = F.lit(None).cast("struct<first_name:string,last_name:string,section:string>")

    def read(part: Column) -> Column:
        return let(named(part["lines"]), lambda name: F.when(name.isNotNull(), F.struct(name["first_name"].alias("first_name"), name["last_name"].alias("last_name"), part["section"].alias("section"))))

    return F.aggregate(F.array(*found), none, lambda best, part: F.coalesce(best, read(part)))


def name_before_email(lines: Column, email: str) -> Column:
    """struct<first_name, last_name>: the two nearest name parts before the first address that has two; labels do not count."""
    parts = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), trim_ws(x).alias("x"))), lambda p: ~p["x"].contains(":") & ~cues.contact_label(p["x"]) & is_name_part(p["x"]))
    at = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(email), i)), lambda i: i.isNotNull())
    before = F.transform(at, lambda i: F.transform(F.filter(parts, lambda p: p["at"] < i), lambda p: p["x"]))
    pair = F.get(F.filter(before, lambda b: F.size(b) >= 2), F.lit(0))
    return F.when(pair.isNotNull(), F.struct(F.element_at(pair, -2).alias("first_name"), F.element_at(pair, -1).alias("last_name")))


def without_person_groups(groups: Column) -> Column:
    """Skill groups (category, names) without those that are a person's name and hold nothing."""
    return F.filter(groups, lambda g: ~(is_name_line(g["category"]) & (F.size(g["names"]) == 0)))


def sidebar_tokens(body: Column) -> Column:
    """Distinct skills, ignoring case, of a sidebar's lines: 'label: a, b', bullets, export lines, comma lists."""

    def of(line: Column) -> Column:
        preview = trim_ws(F.regexp_extract(line, SKILL_LINE, 1))
        listed = F.filter(split_items(line, ","), lambda y: cues.plausible_skill(y))
        return (
            F.when(line.contains(":"), split_items(F.regexp_replace(line, "^[^:]*:", ""), ","))
            .when(line.startswith("- "), F.array(trim_ws(F.substring(line, 3, 1_000_000))))
            .when(preview != "", F.array(preview)).when(line.contains(","), listed).otherwise(F.array().cast("array<string>"))
        )

    every = F.flatten(F.transform(lines_of(body), of))
    keys = F.transform(every, F.lower)
    return F.filter(every, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)

