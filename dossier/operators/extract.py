"""Fields of segmented CV texts: personal data, jobs, education, skills, languages, certificates, projects, links.

Segmentation runs inside a row (operators.lines); what is left per section is ordered, stateful reading of a few dozen
lines, done a document at a time in Arrow batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions.cues import DEGREE_TYPES, INSTITUTION
from dossier.functions.dates import FIRST_YEAR, LAST_YEAR, MONTHS, PRESENT, RANGE, STUDY_YEARS
from dossier.functions.text import normalize
from dossier.operators.lines import EMAIL, PHONE, TECHNOLOGY_NAMES, TITLE_WORDS, with_sections

_EMAIL, _PHONE, _URL = re.compile(EMAIL), re.compile(PHONE), re.compile(r"(?i)https?://[^\s<>()]+")
_RANGE = re.compile(RANGE.replace("(?iu)", "(?i)"))
_LABEL = re.compile(r"^([A-Za-zÀ-ž\s]+):\s*(.+)$")
_NAME_PART = re.compile(r"^[^\W\d_][^\W\d_'’-]*(?:['’-][^\W\d_]+)*$")

# Cues of proficiencies.
LEVELS = {"native": "Native", "mother tongue": "Native", "fluent": "Fluent", "advanced": "Advanced", "professional": "Advanced", "intermediate": "Intermediate", "conversational": "Intermediate", "basic": "Basic", "beginner": "Basic", "elementary": "Basic"}

#: Results that a task holds at a time: so many texts, or as many as together have so many characters. Of texts it holds one.
AT_ONCE, CHARACTERS_AT_ONCE = 256, 1 << 20

CV = """personal struct<first_name:string,last_name:string,title:string,email:string,phone:string,location:string,linkedin_url:string,github_url:string,portfolio_url:string,summary:string>,
 work array<struct<job_title:string,company:string,location:string,start_month:int,start_year:int,end_month:int,end_year:int,is_current:boolean,description:string,technologies:string>>,
 education array<struct<institution:string,degree:string,field_of_study:string,degree_type:string,start_month:int,start_year:int,end_month:int,end_year:int,is_current:boolean,description:string>>,
 skills array<struct<category:string,names:array<string>>>, languages array<struct<language:string,proficiency:string,cefr:string>>,
 certificates array<struct<name:string,issuer:string,month:int,year:int,credential_url:string>>,
 projects array<struct<name:string,role:string,url:string,technologies:array<string>,description:string>>, links array<struct<label:string,url:string>>,
 additional string, confidences array<struct<field_key:string,confidence:string>>, warnings array<string>"""


def token(text: str | None) -> tuple[int | None, int | None]:
    """(month, year) of one date token; nulls where it is none."""
    t = (text or "").strip()
    if re.fullmatch(r"\d{4}", t):
        return (None, int(t)) if FIRST_YEAR <= int(t) <= LAST_YEAR else (None, None)
    if (m := re.fullmatch(r"(\d{1,2})\s*/\s*(\d{4})", t)) and 1 <= int(m[1]) <= 12:
        return int(m[1]), int(m[2])
    if (m := re.fullmatch(r"([A-Za-z]{3}) (\d{4})", t)) and m[1].lower() in MONTHS:
        return MONTHS.index(m[1].lower()) + 1, int(m[2])
    return None, None


def date_range(line: str) -> dict | None:
    """Range after the last middle dot, else the first of the line."""
    for part in ([line.rsplit("·", 1)[1], line] if "·" in line else [line]):
        if m := _RANGE.search(part):
            (sm, sy), (em, ey) = token(m[1]), token(m[2])
            now = (m[2] or "").lower() in PRESENT
            if sy or ey or now:
                return {"start_month": sm, "start_year": sy, "end_month": None if now else em, "end_year": None if now else ey, "is_current": now}
    return None


def is_name(line: str) -> bool:
    parts = line.split()
    if not 2 <= len(parts) <= 4 or len(line) > 60 or _EMAIL.search(line) or _PHONE.search(line):
        return False
    return all(_NAME_PART.match(p) and 2 <= len(p) <= 32 and not (len(p) <= 3 and p.islower()) and p.lower() not in TITLE_WORDS + TECHNOLOGY_NAMES for p in parts)


def _blocks(lines: list[str], starts: list[bool]) -> list[list[str]]:
    out: list[list[str]] = []
    for line, start in zip(lines, starts, strict=True):
        if start or not out:
            out.append([])
        out[-1].append(line)
    return out


def _entries(body: str) -> list[list[str]]:
    """Entries of a section: by blank lines, else from each line that a date follows within three lines."""
    parts = [[x for x in p.split("\n") if x.strip()] for p in body.split("\n\n")]
    parts = [p for p in parts if p]
    if len(parts) > 1:
        return parts
    lines = [x.strip() for x in body.split("\n") if x.strip()]
    dated = [date_range(x) is not None for x in lines]
    heads = [" - " in x or " at " in x.lower() or "|" in x or any(c in x.lower() for c in INSTITUTION) for x in lines]
    starts = [h and not d and any(dated[n + 1 : n + 4]) for n, (h, d) in enumerate(zip(heads, dated, strict=True))]
    return _blocks(lines, starts) if any(starts) else [lines]


def title_company(line: str) -> tuple[str, str]:
    for sep, order in ((" at ", 0), (" - ", 1), ("|", 0)):
        at = line.lower().find(sep)
        if at > 0:
            pair = line[:at].strip(), line[at + len(sep) :].strip()
            return pair if order == 0 else pair[::-1]
    return line.strip(), ""


def personal(sections: dict[str, str], confidences: list, warnings: list) -> dict:
    head = "\n".join(sections.get(s, "") for s in ("Header", "Contact"))
    lines = [x.strip() for x in head.split("\n") if x.strip()]
    everything = head + "\n" + "\n".join(v for k, v in sections.items() if k not in ("Header", "Contact"))
    out = dict.fromkeys(("first_name", "last_name", "title", "email", "phone", "location", "linkedin_url", "github_url", "portfolio_url", "summary"), "")
    for field, shape in (("email", _EMAIL), ("phone", _PHONE)):
        if m := shape.search(head) or shape.search(everything):
            out[field] = m[0].strip()
            confidences.append((field, "High" if m[0] in head else "Medium"))
    for url in _URL.findall(head):
        slot = "linkedin_url" if "linkedin.com" in url.lower() else "github_url" if "github.com" in url.lower() else "portfolio_url"
        out[slot] = out[slot] or url
    labels = {m[1].strip().lower(): m[2].strip() for x in lines if (m := _LABEL.match(x))}
    out["location"] = next((v for k, v in labels.items() if k in ("location", "address", "city", "bydlisko", "adresa")), "")
    name = labels.get("name") or next((x for x in lines if is_name(x)), None)
    direct = name is not None
    if name is None:
        for s in ("Skills", "WorkExperience", "Summary"):
            name = next((x.strip() for x in sections.get(s, "").split("\n")[:25] if is_name(x.strip())), None)
            if name:
                warnings.append("name_guessed")
                break
    if name:
        first, *rest = name.split()
        out["first_name"], out["last_name"] = first, " ".join(rest)
        confidences += [(f, "Medium" if direct else "Low") for f in ("firstName", "lastName")]
        if direct and name in lines:
            after = lines[lines.index(name) + 1 : lines.index(name) + 2]
            if after and not (_EMAIL.search(after[0]) or _PHONE.search(after[0]) or _URL.search(after[0]) or _LABEL.match(after[0])) and len(after[0]) <= 80:
                out["title"] = after[0]
    out["summary"] = sections.get("Summary", "")[:800].rstrip()
    return out


def work(body: str) -> list[dict]:
    out = []
    for lines in _entries(body):
        entry = dict.fromkeys(("job_title", "company", "location", "description", "technologies"), "") | {"start_month": None, "start_year": None, "end_month": None, "end_year": None, "is_current": False}
        rest, dated = [], False
        for n, line in enumerate(lines):
            if not dated and n < 5 and (found := date_range(line)):
                entry |= found
                dated = True
                left = [p.strip() for p in line.split("·")[:-1] if p.strip()] if "·" in line else []
                if left:
                    entry["company"] = entry["company"] or left[0]
                    entry["location"] = left[1] if len(left) > 1 else ""
            elif not entry["job_title"]:
                entry["job_title"], entry["company"] = title_company(line)
            elif (m := _LABEL.match(line)) and m[1].lower() == "technologies":
                entry["technologies"] = m[2]
            else:
                rest.append(line)
        if dated and not entry["is_current"]:
            if entry["end_year"] is None and entry["end_month"] is None and entry["start_month"] is not None:
                entry["end_month"], entry["end_year"] = entry["start_month"], entry["start_year"]
            elif entry["end_year"] is not None and entry["end_month"] is None:
                entry["end_month"] = entry["start_month"] or 12
        entry["description"] = "\n".join(rest)[:2000].rstrip()
        if entry["job_title"] or entry["company"]:
            out.append(entry)
    return out


def education(body: str, confidences: list) -> list[dict]:
    out = []
    for lines in _entries(body):
        entry = {"institution": "", "degree": "", "field_of_study": "", "degree_type": "Other", "start_month": None, "start_year": None, "end_month": None, "end_year": None, "is_current": False, "description": ""}
        head, rest, dated = [], [], None
        for line in lines:
            if dated is None and (found := date_range(line)):
                dated = found
            elif dated is None or len(head) < 2:
                head.append(line)
            else:
                rest.append(line)
        for line in head:
            low = line.lower()
            if not entry["institution"] and any(c in low for c in INSTITUTION):
                entry["institution"] = line
            elif not entry["degree"]:
                entry["degree"], entry["field_of_study"] = (line.split(" in ", 1) + [""])[:2]
            elif not entry["institution"]:
                entry["institution"] = line
            else:
                rest.insert(0, line)
        text = " ".join(head).lower()
        entry["degree_type"] = next((k for k, own in DEGREE_TYPES.items() if any(c in text for c in own)), "Other")
        if dated:
            if dated["end_year"] is None and not dated["is_current"]:  # a single date is the end
                dated = {"start_month": None, "start_year": None, "end_month": dated["start_month"], "end_year": dated["start_year"], "is_current": False}
            if dated["start_year"] is None and dated["end_year"] is not None:
                dated |= {"start_month": 9, "start_year": dated["end_year"] - STUDY_YEARS[entry["degree_type"]]}
                confidences.append((f"education.{len(out)}.startYear", "Low"))
            entry |= dated
        entry["description"] = "\n".join(rest)[:2000].rstrip()
        if entry["institution"] or entry["degree"]:
            out.append(entry)
    return out


def skills(body: str) -> list[dict]:
    """'Category: a, b', bullets, comma lists, 'name · level' lines; a category line opens the next group."""
    groups: dict[str, list[str]] = {}
    current = "General"
    for line in (x.strip() for x in body.split("\n")):
        line = line.removeprefix("- ").strip()
        if not line:
            continue
        if m := _LABEL.match(line):
            current, line = m[1].strip(), m[2]
        elif line.endswith(":"):
            current = line.rstrip(":").strip()
            continue
        for name in re.split(r"[,;|]", line):
            name = name.split("·")[0].strip()
            if name and len(name) <= 80:
                groups.setdefault(current, []).append(name)
    return [{"category": k, "names": list(dict.fromkeys(v))} for k, v in groups.items()]


def languages(body: str) -> list[dict]:
    out: dict[str, dict] = {}
    for line in re.split(r"[\n,]", body):
        parts = [p.strip() for p in re.split(r"\s[-–]\s|[:·()]", line.removeprefix("- ")) if p.strip()]
        if not parts or len(parts[0]) > 40:
            continue
        text = " ".join(parts[1:]).lower()
        cefr = re.search(r"\b([abc][12])\b", text)
        level = next((v for k, v in LEVELS.items() if k in text), "Intermediate")
        out.setdefault(parts[0].lower(), {"language": parts[0], "proficiency": level, "cefr": cefr[1].upper() if cefr else None})
    return list(out.values())


def certificates(body: str) -> list[dict]:
    out = []
    for lines in _entries(body):
        parts = [p.strip() for p in lines[0].split("·")]
        found = next((r for x in lines if (r := date_range(x))), None) or {}
        url = _URL.search("\n".join(lines))
        issuer = parts[1] if len(parts) > 1 else next((x for x in lines[1:] if not date_range(x) and not _URL.search(x) and not _LABEL.match(x)), "")
        out.append({"name": parts[0], "issuer": issuer, "month": found.get("start_month") or found.get("end_month"), "year": found.get("start_year") or found.get("end_year"), "credential_url": url[0] if url else ""})
    return out


def projects(body: str) -> list[dict]:
    out = []
    for lines in _entries(body):
        parts = [p.strip() for p in lines[0].split("·")]
        labels = {m[1].strip().lower(): m[2] for x in lines[1:] if (m := _LABEL.match(x))}
        url = _URL.search("\n".join(lines))
        rest = [x for x in lines[1:] if not _LABEL.match(x) and not _URL.fullmatch(x.strip()) and not date_range(x)]
        out.append({"name": parts[0], "role": parts[1] if len(parts) > 1 else "", "url": url[0] if url else "", "technologies": [t.strip() for t in labels.get("technologies", "").split(",") if t.strip()], "description": "\n".join(rest)})
    return out


def links(body: str, own: set[str], warnings: list) -> list[dict]:
    out: dict[str, dict] = {}
    for url in _URL.findall(body):
        if url.lower() in own:
            warnings.append("link_is_personal")
            continue
        host = re.sub(r"^www\.", "", url.split("/")[2].lower())
        known = {"linkedin.com": "LinkedIn", "github.com": "GitHub", "gitlab.com": "GitLab"}
        out.setdefault(url.lower(), {"label": known.get(host, host.split(".")[0].capitalize()), "url": url})
    return list(out.values())


def read_cv(sections: dict[str, str]) -> dict:
    """All fields of one segmented text, in fixed order; nothing raises for odd texts."""
    confidences: list[tuple[str, str]] = []
    warnings: list[str] = []
    who = personal(sections, confidences, warnings)
    own = {who[k].lower() for k in ("linkedin_url", "github_url", "portfolio_url") if who[k]}
    get = lambda s: sections.get(s, "")
    out = {
        "personal": who,
        "work": work(get("WorkExperience")) if get("WorkExperience") else [],
        "education": education(get("Education"), confidences) if get("Education") else [],
        "skills": skills(get("Skills")),
        "languages": languages(get("Languages")),
        "certificates": certificates(get("Certificates")) if get("Certificates") else [],
        "projects": projects(get("Projects")) if get("Projects") else [],
        "links": links(get("Links"), own, warnings),
        "additional": get("AdditionalInformation")[:3000],
    }
    for n, entry in enumerate(out["work"]):
        confidences += [(f"workExperience.{n}.{f}", "Medium") for f, k in (("jobTitle", "job_title"), ("company", "company")) if entry[k]]
    return out | {"confidences": [{"field_key": k, "confidence": c} for k, c in confidences], "warnings": warnings}


def import_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, personal, work, …, warnings, error): normalise, segment and read every text; a row per text.

    'no_structured_data' marks texts in which no section and no name, address or phone was found.
    """
    parts = with_sections(docs.select(F.col(key).alias("key"), normalize(text).alias("t")), "t")
    joined = parts.select("key", F.map_entries("sections").alias("sections"), "warning")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, warned = batch.columns
            cvs, size = [], 0
            for n in range(len(keys)):
                found = read_cv({s["key"]: s["value"] for s in texts[n].as_py() or []})
                if warning := warned[n].as_py():
                    found["warnings"].insert(0, warning)
                cvs.append(json.dumps(found, ensure_ascii=False))
                size += len(cvs[-1])
                if len(cvs) >= AT_ONCE or size >= CHARACTERS_AT_ONCE or n + 1 == len(keys):
                    yield pa.RecordBatch.from_arrays([keys.slice(n + 1 - len(cvs), len(cvs)), pa.array(cvs, pa.string())], ["key", "cv"])
                    cvs, size = [], 0

    kind = dict(docs.dtypes)[key]
    out = joined.mapInArrow(run, f"key {kind}, cv string").withColumn("cv", F.from_json("cv", CV)).select(F.col("key").alias(key), "cv.*")
    content = F.lit(False)
    for c in ("work", "education", "skills", "languages", "certificates", "projects", "links"):
        content |= F.size(c) > 0
    for f in ("first_name", "email", "phone", "summary"):
        content |= F.col(f"personal.{f}") != ""
    return out.withColumn("error", F.when(~content, "no_structured_data"))
