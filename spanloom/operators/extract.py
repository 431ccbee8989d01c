"""Extractors: documents' pages to mentions, natively (posexplode and regular expressions)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions import names, rules

# Fixed values; word borders are those of ASCII words.
L, R = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
ROLE_PATTERNS = [
    ("co_supervisor", r"(?i)부\s*지도\s*교수|공동\s*지도\s*교수|공동\s*지도|co-?\s*advisor|co-?\s*supervisor|co-?\s*chair"),
    ("supervisor", rf"(?i)지도\s*교수|thesis\s*advisor|{L}advisor{R}|{L}supervisor{R}"),
    ("department_head", r"(?i)학과장|주임\s*교수|head\s*of\s*department|department\s*head"),
    ("committee", rf"(?i)심사\s*위원장|심사\s*위원|위원장|committee\s*member|{L}committee{R}|{L}examiner{R}|{L}chair{R}"),
]
KOREAN, LATIN = r"[가-힣](?:\s?[가-힣]){1,3}", r"[A-Z][a-zA-Z]*\.?(?:\s+[A-Z][a-zA-Z]*\.?){1,3}"
REFERENCES = r"references|참고\s*문헌|bibliography"
STOP = rf"{L}abstract{R}|초록|keywords|{L}introduction{R}|서\s*론"
EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_.-]+\.[A-Za-z]{2,}"
EDGES = r"^\s+|\s+$"
SEPARATOR = rf"(?i),|·|;|&|{L}and{R}"
THESIS_PAGES, BLOCK, THESIS_CONFIDENCE, ARTICLE_CONFIDENCE = 2, 800, 0.9, 0.85
#: What every extractor returns, so that mentions of all of them go into one table.
MENTION = ["documentId", "person_seq", "nameRaw", "role", "affiliation", "sourceKind", "sourcePage", "confidence", "evidence", "isSelf", "ocrEngine", "ocrConfidence"]


def found_names(segment: Column) -> Column:
    """Korean names of a segment; Latin ones only if there are none."""
    korean = F.filter(F.transform(F.regexp_extract_all(segment, F.lit(f"({KOREAN})"), 1), names.normalize), lambda n: (F.length(n) >= 2) & ~n.isin(rules.KO_STOPWORDS))
    stop = rf"(?i){L}(?:{'|'.join(rules.LATIN_STOPWORDS)}){R}"
    latin = F.filter(F.transform(F.regexp_extract_all(segment, F.lit(f"({LATIN})"), 1), lambda v: F.trim(v)), lambda n: ~n.rlike(stop))
    return F.when(F.size(korean) > 0, korean).otherwise(latin)


def thesis_people(docs: DataFrame) -> DataFrame:
    """docs: documentId, pages (pageNumber, text). Names beside the role words of the first two pages; one role a line."""
    pages = docs.select("documentId", F.posexplode(F.slice("pages", 1, THESIS_PAGES)).alias("p", "page"))
    lines = pages.select("documentId", "p", F.col("page.pageNumber").alias("sourcePage"), F.posexplode(F.split("page.text", "[\n;]+")).alias("l", "line")).withColumn("line", F.regexp_replace("line", EDGES, "")).where("line <> ''")
    role, pattern = None, None
    for name, p in ROLE_PATTERNS:
        hit = F.col("line").rlike(p)
        role = F.when(hit, name) if role is None else role.when(hit, name)
        pattern = F.when(hit, F.lit(p)) if pattern is None else pattern.when(hit, F.lit(p))
    tagged = lines.withColumns({"role": role, "pattern": pattern}).where("role is not null")
    around = tagged.withColumn("hit", F.expr("regexp_extract(line, concat('(?s)^(.*?)(', pattern, ')'), 0)")).withColumn("word", F.expr("regexp_substr(line, pattern)"))
    after, before = F.expr("substring(line, length(hit) + 1)"), F.expr("substring(line, 1, length(hit) - length(word))")
    both = around.withColumns({"after": found_names(after), "before": found_names(before)})
    each = both.select("documentId", "p", "l", "sourcePage", "role", "line", F.posexplode(F.when(F.size("after") > 0, F.col("after")).otherwise(F.col("before"))).alias("i", "nameRaw"))
    first = each.groupBy("documentId", "role", names.normalize(F.col("nameRaw")).alias("n")).agg(F.min(F.struct("p", "l", "i", "nameRaw", "sourcePage", "line")).alias("m"))
    return _numbered(first.select("documentId", "m.*", "role", F.lit(None).cast("string").alias("affiliation"), F.lit(THESIS_CONFIDENCE).alias("confidence"), F.col("m.line").alias("evidence")), ["p", "l", "i"])


def article_people(docs: DataFrame) -> DataFrame:
    """docs: documentId, pages. Author lines of page 1 before the abstract: not the first line, every part of them a name."""
    text = F.coalesce(F.get("pages", 0)["text"], F.lit(""))
    before = lambda c, p: F.regexp_extract(c, rf"(?is)^(.*?)(?:{p})", 1)  # noqa: E731  what stands before the first hit
    head = docs.select("documentId", F.get("pages", 0)["pageNumber"].alias("sourcePage"), F.when(before(text, REFERENCES) != "", before(text, REFERENCES)).otherwise(text).alias("text"))
    cut = before("text", STOP)
    block = head.select("documentId", "sourcePage", F.when(cut != "", cut).otherwise(F.substring("text", 1, BLOCK)).alias("block"))
    domain = F.nullif(F.substring_index(F.regexp_extract("block", EMAIL, 0), "@", -1), F.lit(""))
    lines = F.filter(F.transform(F.split("block", "\n+"), lambda v: F.regexp_replace(v, EDGES, "")), lambda x: x != "")
    each = block.select("documentId", "sourcePage", domain.alias("affiliation"), F.posexplode(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))).alias("l", "line"))
    segments = F.filter(F.transform(F.split("line", SEPARATOR), rules.strip_markers), lambda s: s != "")
    signal = (F.size("segments") >= 2) | F.col("line").rlike(SEPARATOR) | F.col("line").rlike(r"(^|\s)[A-Z]\.?(\s|$)")
    good = each.withColumn("segments", segments).where((F.size("segments") > 0) & F.forall("segments", rules.is_person_name) & signal)
    people = good.select("documentId", "sourcePage", "affiliation", "l", F.posexplode("segments").alias("i", "nameRaw"))
    first = people.groupBy("documentId", F.lower(names.normalize(F.col("nameRaw"))).alias("n")).agg(F.min(F.struct("l", "i", "nameRaw", "sourcePage", "affiliation")).alias("m"))
    return _numbered(first.select("documentId", "m.*", F.lit("coauthor").alias("role"), F.lit(ARTICLE_CONFIDENCE).alias("confidence"), F.col("m.nameRaw").alias("evidence")), ["l", "i"])


def _numbered(df: DataFrame, order: list[str]) -> DataFrame:
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("documentId").orderBy(*order)) - 1  # the names of one document
    none = F.lit(None)
    return df.withColumns({"person_seq": seq, "sourceKind": F.lit("printed"), "isSelf": F.lit(False), "ocrEngine": none.cast("string"), "ocrConfidence": none.cast("double")}).select(*MENTION)


def rule_people(docs: DataFrame) -> DataFrame:
    """docs: documentId, docType, pages (and selfName). Theses by role words; scholar captures give nothing; all others by
    author lines."""
    found = thesis_people(docs.where("docType = 'degree_thesis'")).unionByName(article_people(docs.where("docType not in ('degree_thesis', 'hindex')")))
    return tag_self(found, docs) if "selfName" in docs.columns else found


def tag_self(mentions: DataFrame, documents: DataFrame) -> DataFrame:
    """documents: documentId, selfName. isSelf also marks the names that match the applicant's."""
    mine = F.coalesce(names.matches(F.col("nameRaw"), F.col("selfName")), F.lit(False)) & (F.coalesce("selfName", F.lit("")) != "")
    known = F.coalesce("isSelf", F.lit(False)) if "isSelf" in mentions.columns else F.lit(False)
    return mentions.join(documents.select("documentId", "selfName"), "documentId", "left").withColumn("isSelf", known | mine).select(*mentions.columns, *([] if "isSelf" in mentions.columns else ["isSelf"]))


Extractor = Callable[[DataFrame], DataFrame]
EXTRACTORS: dict[str, Extractor] = {"stub": rule_people}


def register(name: str, extractor: Extractor) -> None:
    """Adds an extractor: a function from documents to mentions, such as a mapInPandas around a model client."""
    EXTRACTORS[name] = extractor


def extractor(name: str | None = None) -> Extractor:
    return EXTRACTORS[name or "stub"]


def hybrid(docs: DataFrame, text: Extractor = rule_people, image: Extractor | None = None) -> DataFrame:
    """Documents with a text page go to one extractor, the others to the other; both before the costly call. Both have to
    return the columns of MENTION."""
    has_text = F.coalesce(rules.routes_to_text(F.col("pages")), F.lit(False))
    return text(docs.where(has_text)).unionByName((image or extractor("vlm"))(docs.where(~has_text)))


def ask_model(docs: DataFrame, call: Callable[[str, str, list[str]], str]) -> DataFrame:
    """docs: documentId, docType, pages (and selfName). `call` sends a system and a user message and the paths of page images and
    returns the answer. Adds answer and error: what a failing call raised, or that the answer is no JSON."""
    me = F.col("selfName") if "selfName" in docs.columns else F.lit(None).cast("string")
    kind = docs.schema["documentId"].dataType.simpleString()
    prompt = rules.prompt(F.col("docType"), F.col("pages"), me)
    images = F.filter(F.transform("pages", lambda p: p["imagePath"]), lambda p: p.isNotNull())
    asked = docs.select("documentId", "docType", me.alias("selfName"), prompt.alias("p"), images.alias("images")).select("documentId", "docType", "selfName", "p.system", "p.user", "images")

    def rows(batches):
        for b in batches:
            answers, errors = [], []
            for system, user, paths in zip(b.system, b.user, b.images):
                try:
                    answers.append(call(system, user, list(paths) if paths is not None else []))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  told in the row
                    answers.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            b["answer"], b["error"] = answers, errors
            yield b[["documentId", "docType", "selfName", "answer", "error"]]

    out = asked.mapInPandas(rows, f"documentId {kind}, docType string, selfName string, answer string, error string")
    bad = F.when(F.col("answer").isNotNull() & rules.answer_json(F.col("answer")).isNull(), "the answer is no JSON")
    return out.withColumn("error", F.coalesce("error", bad))


def answered_people(answers: DataFrame, engine: str = "vlm") -> DataFrame:
    """Mentions of the answers without an error."""
    people = rules.response_persons(F.col("answer"), F.col("docType"), F.col("selfName"))
    each = answers.where("error is null").select("documentId", F.posexplode(people).alias("person_seq", "p")).select("documentId", "person_seq", "p.*")
    return each.withColumns({"evidence": F.lit(None).cast("string"), "ocrEngine": F.lit(engine)}).select(*MENTION)


def model_people(docs: DataFrame, call: Callable[[str, str, list[str]], str], engine: str = "vlm") -> DataFrame:
    """Mentions of one model. Failed documents give none; `ask_model` tells them from those in which nobody was found."""
    return answered_people(ask_model(docs, call), engine)


def ensemble_people(docs: DataFrame, calls: dict[str, Callable[[str, str, list[str]], str]], min_votes: int = 1) -> DataFrame:
    """The models' votes; a failing model counts among those asked."""
    from spanloom.operators import resolve

    votes = None
    for i, (engine, call) in enumerate(calls.items()):
        one = model_people(docs, call, engine).withColumn("model", F.lit(i))
        votes = one if votes is None else votes.unionByName(one)
    won = resolve.ensemble_vote(votes.withColumnRenamed("documentId", "document_id"), len(calls), min_votes).withColumnsRenamed({"document_id": "documentId", "seq": "person_seq"})
    return won.withColumns({"evidence": F.lit(None).cast("string"), "ocrEngine": F.lit("ensemble")}).select(*MENTION)


def detect_marks(docs: DataFrame, find: Callable[[str, int], list[dict]]) -> DataFrame:
    """docs: documentId, format, docType, filepath. `find` looks at one page and returns marks (type, x, y, w, h, confidence)."""
    pages = docs.select("documentId", "filepath", F.explode(rules.mark_pages(F.col("format"), F.col("docType"))).alias("page"))

    def rows(batches):
        import pandas as pd

        for b in batches:
            out = [(d, p, m["type"], m["x"], m["y"], m["w"], m["h"], m["confidence"]) for d, f, p in zip(b.documentId, b.filepath, b.page) for m in find(f, p)]
            yield pd.DataFrame(out, columns=["documentId", "page", "type", "x", "y", "w", "h", "confidence"])

    found = pages.mapInPandas(rows, "documentId string, page int, type string, x double, y double, w double, h double, confidence double")
    kept = found.where(F.lower("type").isin("seal", "signature", "handwriting"))
    return kept.select("documentId", "page", F.lower("type").alias("type"), rules.clamp_box(F.struct("x", "y", "w", "h")).alias("bbox"), rules.clamp01(F.col("confidence")).alias("confidence"))


def cut_marks(marks: DataFrame, documents: DataFrame, cut: Callable[[str, int, dict], str | None]) -> DataFrame:
    """Adds cropPath: `cut` stores a page's region (a box in shares of the page) and returns where, or None. A failing cut
    leaves the mark without a picture."""
    placed = marks.join(documents.select("documentId", "filepath"), "documentId", "left")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema) + ", cropPath string"

    def rows(batches):
        for b in batches:
            paths = []
            for f, page, box in zip(b.filepath, b.page, b.bbox):
                try:
                    paths.append(cut(f, page, dict(box)))
                except Exception:  # noqa: BLE001  the mark itself still counts
                    paths.append(None)
            b["cropPath"] = paths
            yield b

    return placed.mapInPandas(rows, schema).drop("filepath")
