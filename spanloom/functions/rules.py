"""Document, policy, label and cleaning rules as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: enums, labels, patterns and thresholds, in their order.
ROLES = ["supervisor", "co_supervisor", "committee", "department_head", "principal_investigator", "research_staff", "coauthor", "division_head", "office_head", "project_manager"]
ROLE_LABELS = dict(zip(ROLES, ["지도교수", "부지도교수", "심사위원", "학과장", "책임자", "참여연구진", "공저자", "부서장", "실장", "과제책임자"]))
DOC_LABELS = {"degree_thesis": "학위논문", "representative_research": "대표연구실적", "journal_article": "학술논문", "research_project": "연구과제", "hindex": "구글스칼라(hindex)", "unknown": "미분류"}
FLAG_LABELS = {"seal": "도장", "handwriting": "손글씨", "signature": "서명", "low_confidence": "저신뢰", "ambiguous": "동명이인/약어", "needs_vision": "비전 판독 필요"}
LABEL_ROLES = {
    "지도교수": "supervisor",
    "지도": "supervisor",
    "advisor": "supervisor",
    "supervisor": "supervisor",
    "thesis advisor": "supervisor",
    "부지도교수": "co_supervisor",
    "공동지도교수": "co_supervisor",
    "공동지도": "co_supervisor",
    "co-advisor": "co_supervisor",
    "co advisor": "co_supervisor",
    "co-supervisor": "co_supervisor",
    "co-chair": "co_supervisor",
    "심사위원": "committee",
    "심사위원장": "committee",
    "위원": "committee",
    "위원장": "committee",
    "chair": "committee",
    "committee": "committee",
    "committee member": "committee",
    "examiner": "committee",
    "member": "committee",
    "학과장": "department_head",
    "주임교수": "department_head",
    "head": "department_head",
    "department head": "department_head",
    "head of department": "department_head",
    "책임자": "principal_investigator",
    "연구책임자": "principal_investigator",
    "pi": "principal_investigator",
    "principal investigator": "principal_investigator",
    "참여연구진": "research_staff",
    "연구원": "research_staff",
    "공저자": "coauthor",
    "저자": "coauthor",
    "coauthor": "coauthor",
    "co-author": "coauthor",
    "author": "coauthor",
    "부서장": "division_head",
    "실장": "office_head",
    "과제책임자": "project_manager",
}
TAG_TYPES = {"학위논문": "degree_thesis", "대표연구실적": "representative_research", "학술논문": "journal_article", "연구보고서": "research_project", "연구과제": "research_project", "과제": "research_project"}
THESIS_CONTENT = r"(?i)지도\s*교수|심사\s*위원|위원장|학위\s*논문|dissertation|thesis advisor|committee member"
PROJECT_CONTENT = r"연구책임자|참여\s*연구원|연구보고서|용역보고서|위탁\s*연구|과제\s*책임자|제\s*출\s*문"
JOURNAL_CONTENT = r"(?i)abstract|초록|keywords|저자|authors?|©|doi:"
KO_STOPWORDS = "교수 교수님 박사 석사 위원 위원장 지도 심사 학과 학과장 대학 대학교 대학원 공동 부지도 주임 학장 원장 연구 논문 심사위원 지도교수".split()
LATIN_STOPWORDS = "University Department College School Professor Committee Advisor Supervisor Institute Graduate Faculty Dean Chair Member Examiner Head Of The And For Dissertation Thesis".split()
FORMATS = {"pdf": ["pdf"], "hwp": ["hwp", "hwpx"], "text": ["txt", "text", "md"], "image": ["png", "jpg", "jpeg", "gif", "bmp", "tif", "tiff", "webp"]}
PRINTED_PASS = 0.75


def lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


# ---- review policy


def needs_human(kind: Column, confidence: Column, ambiguous: Column | bool = False) -> Column:
    """Ambiguous, or not printed, or printed below the pass mark."""
    return (F.lit(ambiguous) if isinstance(ambiguous, bool) else ambiguous) | (kind != "printed") | (confidence < PRINTED_PASS)


def flag_type(kind: Column, confidence: Column) -> Column:
    return F.when(kind == "seal", "seal").when(kind == "handwritten", "handwriting").when(kind == "signature", "signature").when(confidence < PRINTED_PASS, "low_confidence")


def needs_vision(fmt: Column, has_text: Column, persons: Column) -> Column:
    return (fmt.isin("image", "hwp") | ((fmt == "pdf") & ~has_text)) & (persons == 0)


def primary_role(roles: Column) -> Column:
    """The role that stands first in ROLES; null for none."""
    order = F.array(*map(F.lit, ROLES))
    at = F.array_min(F.filter(F.transform(roles, lambda r: F.array_position(order, r)), lambda i: i > 0))
    return F.get(order, at.cast("int") - 1)


def person_hit(query: Column, name: Column, affiliation: Column, roles: Column) -> Column:
    """Roster search: name or affiliation in any case, or a role's label."""
    q = F.lower(query)
    label = F.exists(roles, lambda r: F.coalesce(lookup(ROLE_LABELS, r).contains(query), F.lit(False)))
    return (query == "") | F.lower(name).contains(q) | F.coalesce(F.lower(affiliation).contains(q), F.lit(False)) | label


def selector(value: Column) -> Column:
    """How an applicant is named: 'all', by external id (has a hyphen), or by id."""
    return F.when(value == "all", "all").when(value.contains("-"), "external_id").otherwise("id")


def routes_to_text(pages: Column) -> Column:
    """Whether a document goes to the text extractor."""
    return F.exists(pages, lambda p: p["hasText"] & (F.trim(p["text"]) != ""))


def mark_pages(fmt: Column, doc_type: Column) -> Column:
    """Pages to scan for marks: two of a thesis, one of a project, none otherwise."""
    return F.when(fmt.isin("hwp", "text") | ~doc_type.isin("degree_thesis", "research_project"), F.array().cast("array<int>")).when((fmt != "image") & (doc_type == "degree_thesis"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))


# ---- roles and kinds


def role_from_label(label: Column) -> Column:
    words = LABEL_ROLES | {r: r for r in ROLES}
    s = F.trim(label)
    return F.coalesce(lookup(words, s), lookup(words, F.lower(s)))


def default_role(doc_type: Column) -> Column:
    return F.when(doc_type == "degree_thesis", "committee").when(doc_type == "research_project", "research_staff").otherwise("coauthor")


def source_kind(kind: Column) -> Column:
    """Unknown kinds count as printed."""
    k = F.lower(kind)
    return F.when(k.isin("printed", "handwritten", "seal", "signature"), k).otherwise("printed")


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(F.coalesce(x, F.lit(0.0)), F.lit(0.0))))


# ---- files


def format_of(filename: Column) -> Column:
    ext = F.lower(F.regexp_extract(filename, r"\.([^./\\]+)$", 1))
    return reduce(lambda w, kv: w.when(ext.isin(kv[1]), kv[0]), list(FORMATS.items())[1:], F.when(ext.isin(FORMATS["pdf"]), "pdf"))


def parse_filename(filename: Column) -> Column:
    """Struct of applicant_id, tag, title, degree, language and base."""
    base = F.regexp_replace(F.regexp_replace(filename, r"^.*[/\\]", ""), r"\.[^.]*$", "")
    pattern = r"^([^_]+)_(?:\[([^\]]+)\]_?)?(.*)$"
    part = lambda i: F.nullif(F.trim(F.regexp_extract(base, pattern, i)), F.lit(""))
    degree = F.when(base.rlike(r"(?i)박사|doctoral|ph\.?\s?d"), "doctoral").when(base.rlike("(?i)석사|master"), "master")
    language = F.when(base.rlike("(?i)영문|english"), "en").when(base.rlike("(?i)국문|korean"), "ko")
    return F.struct(part(1).alias("applicant_id"), part(2).alias("tag"), part(3).alias("title"), degree.alias("degree"), language.alias("language"), base.alias("base"))


def parse_folder(folder: Column) -> Column:
    """Struct of applicant_id and name, from 'id (name)'."""
    pattern = r"^(.*?)\s*\(([^)]+)\)\s*$"
    named = folder.rlike(pattern)
    return F.struct(F.when(named, F.trim(F.regexp_extract(folder, pattern, 1))).otherwise(F.trim(folder)).alias("applicant_id"), F.when(named, F.trim(F.regexp_extract(folder, pattern, 2))).alias("name"))


def external_id(folder: Column) -> Column:
    """Struct of external id and recruitment round; both null unless the folder names a person."""
    p = parse_folder(folder)
    found = F.when(p["name"].isNotNull(), p["applicant_id"])
    return F.struct(found.alias("external_id"), F.when(found.contains("-"), F.substring_index(found, "-", 1)).alias("round"))


def classify(tag: Column, filename: Column, folder: Column, content: Column) -> Column:
    """Struct of doc_type, method and confidence: tag, then file name, folder and content."""
    nothing = lambda c: F.coalesce(c, F.lit(""))
    by = lambda kind, method, confidence: F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("doc_type"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence"))
    tagged, folder, content = lookup(TAG_TYPES, F.trim(tag)), nothing(folder), nothing(content)
    return (
        F.when(tagged.isNotNull(), by(tagged, "tag", 0.99))
        .when(F.lower(nothing(filename)).rlike(r"h[\s_-]?index|scholar"), by("hindex", "filename", 0.95))
        .when(folder.rlike("학위|논문첨부"), by("degree_thesis", "folder", 0.7))
        .when(folder.rlike(r"연구과제|연구보고서|과제\s*참여|수탁|용역"), by("research_project", "folder", 0.65))
        .when(folder.rlike("학술|게재"), by("journal_article", "folder", 0.6))
        .when(content.rlike(THESIS_CONTENT), by("degree_thesis", "content", 0.6))
        .when(content.rlike(PROJECT_CONTENT), by("research_project", "content", 0.55))
        .when(content.rlike(JOURNAL_CONTENT), by("journal_article", "content", 0.55))
        .otherwise(by("unknown", "default", 0.3))
    )


# ---- text


def clean_lines(text: Column) -> Column:
    """Line feeds only, no blanks at line ends or around the text."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n", "\n"), r"[ \t]+(?=\n|$)", ""), r"^\s+|\s+$", "")


def clean_blocks(text: Column) -> Column:
    """Blanks within lines become one, three or more line ends two."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), "[\\t\\x0B\\f\\r  　]+", " ")
    return F.regexp_replace(F.regexp_replace(s, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def decode_entities(text: Column) -> Column:
    """The five XML entities and decimal references (of the basic plane), ampersands last."""
    for name, c in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(c))
    pieces = F.split(text, "(?=&#[0-9]+;)")
    number = lambda p: F.regexp_extract(p, "^&#([0-9]+);", 1)
    one = lambda p: F.when(number(p) != "", F.concat(F.decode(F.unhex(F.lpad(F.hex(number(p).cast("long")), 4, "0")), "UTF-16BE"), F.regexp_replace(p, "^&#[0-9]+;", ""))).otherwise(p)
    return F.replace(F.array_join(F.transform(pieces, one), ""), F.lit("&amp;"), F.lit("&"))


def xml_runs(xml: Column) -> Column:
    """Text runs of a section joined; without runs, the text between tags."""
    runs = F.regexp_extract_all(xml, F.lit(r"(?s)<hp:t(?:\s[^>]*)?>(.*?)</hp:t>"), 1)
    return decode_entities(F.when(F.size(runs) > 0, F.array_join(runs, "")).otherwise(F.regexp_replace(xml, "<[^>]+>", " ")))


def strip_markers(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, "[0-9*†‡§¶¹²³]+", ""))


def is_person_name(s: Column) -> Column:
    """Two to four Hangul syllables, or two to four capitalised tokens, and no stopword."""
    from spanloom.functions import names

    t = F.trim(s)
    latin = t.rlike(r"^[A-Z][a-zA-Z]*\.?(?:\s+[A-Z][a-zA-Z]*\.?){1,3}$") & ~t.rlike(rf"(?i)(?<![A-Za-z0-9_])(?:{'|'.join(LATIN_STOPWORDS)})(?![A-Za-z0-9_])")
    return (t.rlike(r"^[가-힣](?:\s?[가-힣]){1,3}$") & ~names.normalize(t).isin(KO_STOPWORDS)) | latin


def readable_name(composed: Column) -> Column:
    """Null for empty names and for those with letters left in parts; the input is in composed form."""
    return F.when((composed != "") & ~composed.rlike("[ᄀ-ᇿ㄰-㆏]"), composed)


def json_block(text: Column) -> Column:
    """A fenced block if there is one; of it, from the first brace to the last. Without such braces all of it, or '{}' for nothing."""
    fence = r"(?is)```(?:json)?\s*(.*?)```"
    body = F.when(text.rlike(fence), F.regexp_extract(text, fence, 1)).otherwise(text)
    start, back = F.instr(body, "{"), F.instr(F.reverse(body), "}")
    end = F.length(body) - back + 1
    bare = F.regexp_replace(body, r"^\s+|\s+$", "")
    return F.when((start > 0) & (back > 0) & (end > start), F.substring(body, start, end - start + 1)).otherwise(F.when(bare == "", "{}").otherwise(bare))


#: The JSON types that an answer's fields must have, where they aren't null or missing.
ANSWER_FIELDS = {"name": ["STRING"], "role": ["STRING"], "affiliation": ["STRING"], "source_kind": ["STRING"], "page": ["BIGINT", "DECIMAL", "DOUBLE"], "confidence": ["BIGINT", "DECIMAL", "DOUBLE"], "is_self": ["BOOLEAN"]}


def answer_json(text: Column) -> Column:
    """The answer's JSON as a variant; null if it can't be parsed, which counts as a failed call."""
    return F.try_parse_json(json_block(text))


def response_persons(text: Column, doc_type: Column, self_name: Column | None = None) -> Column:
    """A model's answer as an array of persons with defaults filled in. One record that isn't as it should be (a name that is
    missing or empty, a field of another JSON type) rejects the whole list. Null for an answer that isn't JSON."""
    from spanloom.functions import names

    whole = answer_json(text)
    kind = lambda v, path: F.regexp_extract(F.schema_of_variant(F.try_variant_get(v, path, "variant")), "^[A-Z]+", 0)
    people = F.try_variant_get(whole, "$.persons", "array<variant>")
    get = lambda p, field, of: F.try_variant_get(p, f"$.{field}", of)
    typed = lambda p: reduce(lambda x, y: x & y, [F.coalesce(kind(p, f"$.{field}").isin("VOID", *kinds), F.lit(True)) for field, kinds in ANSWER_FIELDS.items()])
    good = lambda p: (kind(p, "$") == "OBJECT") & typed(p) & (F.coalesce(get(p, "name", "string"), F.lit("")) != "")
    me = F.lit(None).cast("string") if self_name is None else self_name
    fill = lambda p: F.struct(
        get(p, "name", "string").alias("nameRaw"), F.coalesce(role_from_label(get(p, "role", "string")), default_role(doc_type)).alias("role"), get(p, "affiliation", "string").alias("affiliation"),
        source_kind(get(p, "source_kind", "string")).alias("sourceKind"), F.coalesce(get(p, "page", "double").cast("int"), F.lit(1)).alias("sourcePage"),
        clamp01(F.coalesce(get(p, "confidence", "double"), F.lit(0.6))).alias("confidence"),
        F.coalesce(get(p, "is_self", "boolean"), names.matches(get(p, "name", "string"), me) & (F.coalesce(me, F.lit("")) != ""), F.lit(False)).alias("isSelf"), get(p, "confidence", "double").alias("ocrConfidence"))
    return F.when(whole.isNull(), None).when(people.isNull() | F.exists(people, lambda p: ~F.coalesce(good(p), F.lit(False))), F.array()).otherwise(F.transform(people, fill))


PROMPT_CHARS = 12000  # fixed value
TASKS = {
    "degree_thesis": "From the cover and approval pages of this thesis, list the supervisor (지도교수), co_supervisor (부지도교수), committee (심사위원) and department_head (학과장).",
    "representative_research": "List the coauthors (공저자) in the author block of page 1, with affiliation or mail domain; leave out authors that the text cites.",
    "journal_article": "List the coauthors (공저자) in the author block of page 1, with affiliation or mail domain; leave out authors that the text cites.",
    "research_project": "List the people of this project: principal_investigator (연구책임자), project_manager (과제책임자), research_staff (연구원), from the submission page and staff tables; leave out institutions.",
    "hindex": "List the coauthors shown in the panel and the paper list of this scholar page; names are often initials and a surname.",
}
PROMPT_RULES = (
    "You list the people named in a document for a conflict-of-interest review. Use only names that stand in it; never make one up; with none, return an empty list. "
    "Never take names from references. Answer with one JSON object: "
    '{"persons":[{"name":string,"role":string,"affiliation":string|null,"source_kind":string,"page":number,"confidence":number,"is_self":boolean}]}. '
    "role is one of supervisor, co_supervisor, committee, department_head, principal_investigator, research_staff, coauthor, project_manager; "
    "source_kind is one of printed, handwritten, seal, signature; confidence is from 0 to 1."
)


def prompt(doc_type: Column, pages: Column, self_name: Column | None = None) -> Column:
    """Struct of system and user message for a document's pages. The text is cut after PROMPT_CHARS; without any, the
    model is told to read the page images."""
    texts = F.filter(F.transform(pages, lambda p: p["text"]), lambda t: F.coalesce(t, F.lit("")) != "")
    text = F.substring(F.array_join(texts, "\n\n"), 1, PROMPT_CHARS)
    task = F.coalesce(lookup(TASKS, doc_type), F.lit("List the supervisors, committee members, coauthors and other people tied to this document."))
    me = F.lit("") if self_name is None else F.when(F.coalesce(self_name, F.lit("")) != "", F.concat(F.lit('\nThe applicant is "'), self_name, F.lit('"; set is_self to true for that person.'))).otherwise("")
    body = F.when(F.trim(text) != "", F.concat(F.lit("[document]\n"), text, F.lit("\n[end]"))).otherwise("The document has no text layer: read the attached page images.")
    return F.struct(F.lit(PROMPT_RULES).alias("system"), F.concat(task, me, F.lit("\n\n"), body).alias("user"))


def endpoints(setting: Column) -> Column:
    """'url|model,url|model' as structs; incomplete entries go."""
    pairs = F.transform(F.split(setting, ","), lambda x: F.transform(F.split(x, r"\|"), lambda v: F.trim(v)))
    whole = F.filter(pairs, lambda p: (F.size(p) >= 2) & (F.get(p, 0) != "") & (F.get(p, 1) != ""))
    return F.transform(whole, lambda p: F.struct(F.get(p, 0).alias("url"), F.get(p, 1).alias("model")))


# ---- marks


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def clamp_box(box: Column) -> Column:
    x, y = clamp01(box["x"]), clamp01(box["y"])
    return F.struct(x.alias("x"), y.alias("y"), F.least(clamp01(box["w"]), 1 - x).alias("w"), F.least(clamp01(box["h"]), 1 - y).alias("h"))


def crop(box: Column, width: Column, height: Column) -> Column:
    """Pixel rectangle, at least one pixel and inside the image."""
    left, top = F.greatest(F.lit(0), F.least(half_up(box["x"] * width), width - 1)), F.greatest(F.lit(0), F.least(half_up(box["y"] * height), height - 1))
    return F.struct(left.alias("left"), top.alias("top"), F.greatest(F.lit(1), F.least(half_up(box["w"] * width), width - left)).alias("width"), F.greatest(F.lit(1), F.least(half_up(box["h"] * height), height - top)).alias("height"))


def mark_label(page: Column, confidence: Column) -> Column:
    return F.concat(F.lit("p."), page.cast("string"), F.lit(" ("), half_up(confidence * 100).cast("string"), F.lit("%)"))


def known_marks(marks: Column) -> Column:
    return F.filter(marks, lambda m: F.lower(m["type"]).isin("seal", "signature", "handwriting"))


# ---- export


def csv_cell(s: Column) -> Column:
    s = F.coalesce(s, F.lit(""))
    return F.when(s.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def yes_no(b: Column) -> Column:
    return F.when(b, "Y").otherwise("N")
