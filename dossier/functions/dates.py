"""Partial dates: month and year, ranges, sort keys and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, trim_ws

# The shape of a date range in running text, and the words for "until now".
TOKEN = r"\d{1,2}\s*/\s*\d{4}|[A-Za-z]{3,9}\s+\d{4}|\d{4}"
PRESENT = ("present", "current", "súčasnosť", "sucasnost")
RANGE = rf"(?iu)({TOKEN})(?:\s*[-–]\s*({TOKEN}|{'|'.join(PRESENT)}))?"
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
FIRST_YEAR, LAST_YEAR = 1950, 2100


def _int(c: Column) -> Column:
    return c.try_cast("int")


def parse_token(token: Column) -> Column:
    """struct<month, year> of '2020', '3/2020' or 'Mar 2020'; null fields where it is none of them."""

    def of(t: Column) -> Column:
        none = F.lit(None).cast("int")
        pair = lambda month, year: F.struct(month.cast("int").alias("month"), year.cast("int").alias("year"))
        plain = let(_int(t), lambda y: pair(none, F.when(y.between(FIRST_YEAR, LAST_YEAR), y)))
        slash = let(_int(F.regexp_extract(t, r"^(\d{1,2})\s*/\s*\d{4}$", 1)), lambda m: F.when(m.between(1, 12), pair(m, _int(F.right(t, F.lit(4))))).otherwise(pair(none, none)))
        month = F.instr(F.lit("".join(MONTHS)), F.lower(F.left(t, F.lit(3))))
        named = F.when(t.rlike(r"^[A-Za-z]{3} \d{4}$") & (month % 3 == 1), pair((month + 2) / 3, _int(F.right(t, F.lit(4))))).otherwise(pair(none, none))
        # Of a token's three shapes only one is worked out.
        return F.when(t.rlike(r"^[+-]?\d+$"), plain).when(F.contains(t, F.lit("/")), slash).otherwise(named)

    return let(trim_ws(token), of)


def is_present(token: Column) -> Column:
    return F.coalesce(F.lower(token).isin(*PRESENT), F.lit(False))


def parse_segment(c: Column) -> Column:
    """struct<start_month, start_year, end_month, end_year, is_present> of the first range in a text; null without one.

    The pattern finds a range; whether its ends are dates is judged apart, so an end can stand without its start.
    """

    def of(m: Column) -> Column:
        # Both ends go through one expression, so that it is built once.
        ends = F.array(F.regexp_extract(m, RANGE, 1), F.regexp_extract(m, RANGE, 2))
        return let(F.struct(F.transform(ends, lambda e: parse_token(e)).alias("ends"), is_present(F.regexp_extract(m, RANGE, 2)).alias("now")), build)

    def build(x: Column) -> Column:
        a, b, now = F.get(x["ends"], F.lit(0)), F.get(x["ends"], F.lit(1)), x["now"]
        value = F.struct(
            a["month"].alias("start_month"),
            a["year"].alias("start_year"),
            F.when(~now, b["month"]).alias("end_month"),
            F.when(~now, b["year"]).alias("end_year"),
            now.alias("is_present"),
        )
        return F.when(a["year"].isNotNull() | now | b["year"].isNotNull(), value)

    # Only four digits in a row can make a range, which most lines lack.
    return F.when(c.rlike(r"\d{4}"), let(F.regexp_extract(c, RANGE, 0), of))


def parse_range(line: Column) -> Column:
    """The range after the last middle dot of a line, else the first of the line."""
    tail = trim_ws(F.substring_index(line, "·", -1))
    texts = F.when(line.contains("·"), F.array(tail, line)).otherwise(F.array(line))
    # Only lines with four digits in a row can hold one; others are not looked at.
    none = F.lit(None).cast("struct<start_month:int,start_year:int,end_month:int,end_year:int,is_present:boolean>")
    return F.when(line.rlike(r"\d{4}"), F.aggregate(texts, none, lambda found, t: F.coalesce(found, parse_segment(t))))


def valid_month_year(month: Column, year: Column) -> Column:
    return F.coalesce(month.between(1, 12) & year.between(FIRST_YEAR, LAST_YEAR), F.lit(False))


def sort_key(month: Column, year: Column) -> Column:
    """year * 100 + month for ordering; -1 when either is missing."""
    return F.coalesce(year * 100 + month, F.lit(-1))


def iso(month: Column, year: Column) -> Column:
    return F.when(month.isNull(), F.format_string("%04d", year)).otherwise(F.format_string("%04d-%02d", year, month))


def first_of_month(month: Column, year: Column) -> Column:
    return F.when(valid_month_year(month, year), F.make_date(year, month, F.lit(1)))


def _partial(month: Column, year: Column) -> Column:
    return F.when(month.isNotNull() & year.isNotNull(), F.format_string("%02d / %d", month, year)).when(year.isNotNull(), year.cast("string")).otherwise("-")


def range_label(sm: Column, sy: Column, em: Column, ey: Column, current: Column, present: str = "Present") -> Column:
    """'MM / YYYY – MM / YYYY', the present label for a running entry, a hyphen for what is missing."""
    end = F.when(current, F.lit(present)).otherwise(_partial(em, ey))
    return F.concat(_partial(sm, sy), F.lit(" – "), end)


def work_dates(sm: Column, sy: Column, em: Column, ey: Column, current: Column) -> Column:
    """Completed dates of a job: none ends while it runs; an end year without month ends with the start's month or 12;
    a start with month and no end ends as it starts."""
    no_end = em.isNull() & ey.isNull()
    month = F.when(current, F.lit(None)).when(ey.isNotNull() & em.isNull(), F.coalesce(sm, F.lit(12))).when(no_end & sm.isNotNull(), sm).otherwise(em)
    year = F.when(current, F.lit(None)).when(no_end & sm.isNotNull(), sy).otherwise(ey)
    return F.struct(sm.cast("int").alias("start_month"), sy.cast("int").alias("start_year"), month.cast("int").alias("end_month"), year.cast("int").alias("end_year"))


#: Years before its end that a degree starts, by kind (fixed values).
STUDY_YEARS = {"Bachelor": 4, "Master": 2, "Doctorate": 3, "Associate": 2, "HighSchool": 4, "Certificate": 1, "Other": 3}


def education_dates(parsed: Column, degree_type: Column) -> Column:
    """A single date ends an education; a missing start is September some years earlier, marked as inferred."""
    single = parsed["end_year"].isNull() & ~parsed["is_present"]
    em = F.when(single, parsed["start_month"]).otherwise(parsed["end_month"])
    ey = F.when(single, parsed["start_year"]).otherwise(parsed["end_year"])
    sm, sy = F.when(~single, parsed["start_month"]), F.when(~single, parsed["start_year"])
    years = F.coalesce(*(F.when(degree_type == k, F.lit(v)) for k, v in STUDY_YEARS.items()), F.lit(3))
    inferred = sy.isNull() & ey.isNotNull()
    return F.struct(
        F.when(inferred, F.lit(9)).otherwise(sm).cast("int").alias("start_month"),
        F.when(inferred, ey - years).otherwise(sy).cast("int").alias("start_year"),
        em.cast("int").alias("end_month"),
        ey.cast("int").alias("end_year"),
        parsed["is_present"].alias("is_current"),
        inferred.alias("inferred"),
    )


def year_month(c: Column) -> Column:
    """Month and year of an ISO date, 'yyyy-MM', 'MM/yyyy', 'MMM yyyy' or a bare year after 1900."""
    t = trim_ws(c)
    full = F.coalesce(*(F.try_to_timestamp(t, F.lit(p)) for p in ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM", "MM/yyyy", "MMM yyyy", "MM/dd/yyyy")))
    bare = F.when(t.rlike(r"^\d{4}$"), _int(t))
    bare = F.when(bare > 1900, bare)
    return F.struct(
        F.when(bare.isNull(), F.month(full)).cast("int").alias("month"),
        F.coalesce(bare, F.year(full)).cast("int").alias("year"),
    )


def years_in(c: Column, after: int = 1950, before: int = 2150) -> Column:
    """All years 19xx and 20xx strictly between the bounds, distinct, ascending."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1))
    numbers = F.transform(found, lambda x: x.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda y: (y > after) & (y < before))))
