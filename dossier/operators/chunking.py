"""Chunks for model calls: windows, paragraph batches, phases; and what comes back: fragments, repairs, advice, guard."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.text import has_text, paragraphs, rationale, strip_bullet, strip_fence, trim_ws, truncated
from dossier.operators.lines import with_sections


@dataclass(frozen=True)
class Profile:
    """Batch sizes of a class of models."""

    name: str
    max_input: int
    work: int
    education: int
    projects: int
    overlap: bool
    combined: bool
    overhead: int

    @property
    def slice_chars(self) -> int:
        return max(200, self.max_input - self.overhead)


# Profiles by size of model.
PROFILES = {
    p.name: p
    for p in (
        Profile("compact", 1200, 1, 1, 1, True, True, 350),
        Profile("small", 2400, 2, 2, 2, True, False, 500),
        Profile("medium", 5000, 4, 3, 3, False, False, 700),
        Profile("large", 10_000, 8, 6, 6, False, False, 700),
        Profile("extralarge", 16_000, 12, 8, 8, False, False, 700),
    )
}


def windows(text: Column, size: int, overlap: bool) -> Column:
    """Slices of at most ``size`` characters; overlapping ones share a tenth, at most 120 characters; it ends at the end."""
    shared = min(120, max(1, size // 10)) if overlap else 0
    step = max(1, size - shared)
    n = F.length(text)
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(float(step))).cast("int"))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.substring(text, k * step + 1, F.lit(size)))


def batches(parts: Column, each: int, most: int) -> Column:
    """Every ``each`` paragraphs as one slice, cut with a mark when too long."""
    n = F.ceil(F.size(parts) / F.lit(float(each))).cast("int")
    whole = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.array_join(F.slice(parts, k * each + 1, F.lit(each)), "\n\n"))
    return F.transform(whole, lambda s: truncated(s, most))


def slices(text: Column, each: int, profile: Profile) -> Column:
    """Slices of a section: paragraph batches if it has several paragraphs, windows if it is one long paragraph."""
    size = profile.slice_chars
    parts = paragraphs(text)
    return F.when(F.size(parts) > 1, batches(parts, each, size)).otherwise(windows(text, size, profile.overlap))


def plan(docs: DataFrame, profile: Profile, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, phase, batch_index, batch_count, step, slice) of normalised texts, in the order of the calls."""
    base = with_sections(docs.select(key, F.col(text).alias("t")), "t")
    body = lambda s: F.element_at("sections", F.lit(s))
    glued = lambda *cs: F.array_join(F.filter(F.array(*cs), has_text), "\n\n")
    personal = glued(body("Header"), body("Contact"), body("Summary"))
    personal = F.when(has_text(personal), personal).otherwise(F.col("t"))
    phases = [("Personal", personal, 1), ("Work", body("WorkExperience"), profile.work), ("Education", body("Education"), profile.education)]
    if profile.combined:
        phases.append(("SkillsAndLanguages", glued(body("Skills"), body("Languages")), 1))
    else:
        phases += [("Skills", body("Skills"), 1), ("Languages", body("Languages"), 1)]
    phases += [
        ("Certificates", body("Certificates"), profile.education),
        ("Projects", body("Projects"), profile.projects),
        ("Links", body("Links"), 1),
        ("Additional", body("AdditionalInformation"), 1),
    ]
    rows = [F.when(has_text(c), F.struct(F.lit(n).alias("order"), F.lit(p).alias("phase"), slices(c, each, profile).alias("s"))) for n, (p, c, each) in enumerate(phases)]
    calls = base.select(key, F.explode(F.array(F.filter(F.array(*rows), lambda x: x.isNotNull()))).alias("c"))
    before = F.aggregate(F.slice("c", 1, F.col("n")), F.lit(0), lambda a, x: a + F.size(x["s"]))
    out = calls.select(key, "c", F.posexplode("c").alias("n", "p")).select(key, "p.phase", F.size("p.s").alias("batch_count"), before.alias("before"), F.posexplode("p.s").alias("i", "slice"))
    return out.select(key, "phase", (F.col("i") + 1).alias("batch_index"), "batch_count", (F.col("before") + F.col("i")).alias("step"), "slice")


NUMBER = r"(\d+(?:[.,]\d+)*\s?%?)"
EMAIL = r"([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})"
NAME = r"([A-Z][\p{L}&]+(?:\s+[A-Z][\p{L}&]+)+)"


def unsupported(source: Column, output: Column, most: int = 6) -> Column:
    """Numbers of two digits or more, addresses and proper names of an output that its source lacks, the first few."""
    src = F.coalesce(source, F.lit(""))
    low = F.lower(src)
    runs = F.regexp_extract_all(src, F.lit(r"(\d+)"), F.lit(1))
    tokens = lambda p: F.transform(F.regexp_extract_all(F.coalesce(output, F.lit("")), F.lit(p), F.lit(1)), trim_ws)
    digits = lambda t: F.regexp_replace(t, r"\D", "")
    numbers = F.filter(tokens(NUMBER), lambda t: (F.length(digits(t)) >= 2) & ~F.array_contains(runs, digits(t)))
    others = F.filter(F.concat(tokens(EMAIL), tokens(NAME)), lambda t: ~F.contains(low, F.lower(t)))
    every = F.concat(numbers, others)
    keys = F.transform(every, F.lower)
    return F.slice(F.filter(every, lambda t, i: F.array_position(keys, F.lower(t)) == i + 1), 1, most)


def advice(raw: Column, most: int = 4) -> Column:
    """The first few items of a list answer as struct<advice, rationale>."""
    lines = F.transform(F.split(strip_fence(F.coalesce(raw, F.lit(""))), "\n", -1), strip_bullet)
    items = F.transform(F.filter(lines, has_text), rationale)
    return F.slice(F.filter(items, lambda x: has_text(x["advice"])), 1, most)


def repairs(raw: Column) -> Column:
    """map<int, string> of 'N: value' lines; the last of a number wins."""
    shape = r"^\s*(\d+)\s*[:).\-]\s*(.+?)\s*$"
    hits = F.filter(F.split(F.coalesce(raw, F.lit("")), "\n", -1), lambda x: x.rlike(shape))
    pairs = F.transform(hits, lambda x: F.struct(F.regexp_extract(x, shape, 1).try_cast("int").alias("k"), trim_ws(F.regexp_extract(x, shape, 2)).alias("v")))
    pairs = F.filter(pairs, lambda x: x["k"] >= 1)
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def repaired(targets: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Targets (key, pos, value) with the answer at their number (from 1); a miss keeps the value."""
    line = F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    given = answers.select(F.col(key).alias("k"), F.explode(repairs(F.col("raw"))).alias("n", "fixed"))
    numbered = targets.withColumn("n", line)
    out = numbered.join(given, (numbered[key] == given["k"]) & (numbered["n"] == given["n"]), "left")
    return out.select(key, "pos", F.coalesce("fixed", "value").alias("value"))


def prompt(fields: Column, source: Column, most: int = 600) -> Column:
    """Numbered fields and the first characters of the source."""
    numbered = F.transform(fields, lambda x, i: F.concat((i + 1).cast("string"), F.lit(": "), x))
    return F.concat(F.array_join(numbered, "\n"), F.lit("\n---\n"), F.left(source, F.lit(most)))


# Fragments of model names and the profiles they take, in order; the first match wins.
MODEL_RULES = [
    ("gpt-4o-mini", "small"), ("gpt-4.1-mini", "small"), ("gpt-4.1-nano", "small"), ("claude-3-5-haiku", "small"), ("claude-haiku", "small"), ("gemini-2.0-flash", "small"),
    ("gemini-flash", "small"), ("open-mistral-nemo", "small"), ("gpt-4o", "large"), ("gpt-4.1", "large"), ("claude-sonnet", "large"), ("claude-3-5-sonnet", "large"),
    ("gemini-2.5-pro", "large"), ("llama-3.3-70b", "large"), ("llama3.3-70b", "large"), ("mixtral-8x7b", "medium"), ("mistral-small", "medium"), ("deepseek-chat", "medium"),
]


def profile_of(model: Column, default: str = "small") -> Column:
    """Profile of a hosted model by its name, in any case; the default for blank and unknown names."""
    out = F.lit(default)
    for part, name in reversed(MODEL_RULES):
        out = F.when(F.lower(model).contains(part), name).otherwise(out)
    return out


# Models of the local catalogue whose plan is not their tier's: profile and, where it is not the profile's, the longest input.
CATALOGUE = {
    "gemma2-2b": ("compact", None), "phi3-mini": ("small", 2000), "llama32-3b": ("small", None), "qwen25-3b": ("small", None), "mistral-7b": ("medium", None), "llama31-8b": ("medium", 5500),
    "gemma2-9b": ("medium", None), "qwen25-7b": ("medium", 5500), "mixtral-8x7b": ("large", None), "llama31-70b": ("extralarge", None), "llama33-70b": ("large", None),
}
#: The provider whose models are known by the name they are deployed under.
DEPLOYED = "azure-openai"


def plan_of(settings: Column, catalogue: Column) -> Column:
    """struct<profile, id, max_chars>: how texts are cut for the model that settings name.

    ``settings`` has backend ('Local' or 'Online'), local_model, provider, and online, a map of provider to (model,
    deployment); ``catalogue`` maps local models to tiers. A local model takes its own plan, else its tier's; a hosted one
    the plan of its name; what is not known is small.
    """

    def made(profile: Column, name: Column, most: Column | None = None) -> Column:
        own = _by_name({k: v.max_input for k, v in PROFILES.items()}, profile)
        return F.struct(profile.alias("profile"), name.alias("id"), (own if most is None else F.coalesce(most, own)).alias("max_chars"))

    local, online = settings["local_model"], F.element_at(settings["online"], settings["provider"])
    own, tier = _by_name({k: v[0] for k, v in CATALOGUE.items()}, local), F.lower(F.element_at(catalogue, local))
    hosted = profile_of(F.coalesce(F.when(settings["provider"] == DEPLOYED, online["deployment"]).otherwise(online["model"]), F.lit("")))
    small = F.lit("small")
    here = F.when(own.isNotNull(), made(own, local, _by_name({k: v[1] for k, v in CATALOGUE.items() if v[1]}, local))).when(
        has_text(local) & tier.isNotNull(), made(F.when(tier.isin(*PROFILES), tier).otherwise(small), local)
    )
    there = F.when(has_text(settings["provider"]) & online.isNotNull(), made(hosted, F.concat(F.lit("online:"), hosted)))
    unknown = lambda where: made(small, F.lit(f"{where}:unknown"))
    return F.when(settings["backend"] == "Local", F.coalesce(here, unknown("local"))).otherwise(F.coalesce(F.when(settings["backend"] == "Online", there), unknown("online")))


def _by_name(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def trigger_flags(text_route: Column, chars: Column, success: Column, no_data: Column, sections: Column, low: Column, ocr: Column) -> Column:
    """Bit flags that offer assisted import: 1 failed, 2 thin, 4 low confidence, 16 partial, 32 has low fields."""
    bits = (
        F.when(~success & no_data, 1).otherwise(0)
        + F.when(success & (sections <= 2), 2).otherwise(0)
        + F.when(success & ((low >= 5) | (ocr & (sections <= 4))), 4).otherwise(0)
        + F.when(success & sections.between(3, 4), 16).otherwise(0)
        + F.when(success & (low >= 1), 32).otherwise(0)
    )
    return F.when(text_route & (chars >= 80), bits).otherwise(0)
