"""An applicant's documents to people and flags: the whole chain, and its last stage alone.

Each returns tables of the applicants' new rows. `replaced` puts them in the place of the old ones, so running it
again gives the same tables; ids are made from documents and positions, not drawn.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions import names, rules
from spanloom.operators import extract, resolve, review

FLAG = ["applicant_id", "document_id", "person_id", "flag_type", "label", "crop_path", "status"]


def _flags(df: DataFrame) -> DataFrame:
    for c in FLAG:
        if c not in df.columns:
            df = df.withColumn(c, F.lit("open" if c == "status" else None).cast("string"))
    return df.select(*FLAG)


def typed_documents(files: DataFrame) -> DataFrame:
    """files: applicant_id, document_id, filename, folder_category, format, pages, pageCount, hasTextLayer, note. Adds doc_type, from
    tag, file name, folder and the first page with text (else the first page); a file that couldn't be read is unknown."""
    first = F.coalesce(F.get(F.filter("pages", lambda p: p["hasText"]), 0)["text"], F.get("pages", 0)["text"], F.lit(""))
    kind = rules.classify(rules.parse_filename(F.col("filename"))["tag"], F.col("filename"), F.col("folder_category"), first)["doc_type"]
    return files.withColumn("doc_type", F.when(F.coalesce("pageCount", F.lit(0)) == 0, "unknown").otherwise(kind))


def process(files: DataFrame, applicants: DataFrame, extractor: Callable[[DataFrame], DataFrame] = extract.rule_people, marks: DataFrame | None = None) -> dict[str, DataFrame]:
    """Documents, persons, aggregates and flags of the applicants. applicants: applicant_id, name. marks: documentId, page, type,
    confidence (and cropPath)."""
    docs = typed_documents(files).join(applicants.select("applicant_id", F.col("name").alias("selfName")), "applicant_id", "left")
    wanted = docs.select(F.col("document_id").alias("documentId"), F.col("doc_type").alias("docType"), "pages", "selfName")
    found = extractor(wanted).join(docs.select(F.col("document_id").alias("documentId"), "applicant_id", "filename", F.col("doc_type").alias("docType")), "documentId")
    found = resolve.cross_check(found)
    n = F.col("nameRaw")
    persons = found.select(
        F.concat_ws(":", "documentId", "person_seq").alias("person_id"), "applicant_id", F.col("documentId").alias("document_id"), F.col("person_seq"), n.alias("name_raw"), names.normalize(n).alias("name_normalized"),
        names.initials_form(n).alias("name_initials"), "role", "affiliation", F.col("isSelf").alias("is_self"), F.col("sourceKind").alias("source_kind"), F.col("sourcePage").alias("source_page"), "confidence",
        F.col("ocrEngine").alias("ocr_engine"), F.col("ocrConfidence").alias("ocr_confidence"), F.col("verificationStatus").alias("verification_status"), "evidence",
        rules.needs_human(F.col("sourceKind"), F.coalesce("confidence", F.lit(0.0))).alias("needs_human"), F.lit("pending").alias("review_status"))
    aggregates = _people(persons, docs, applicants)
    flagged = review.person_flags(persons).join(persons.select("person_id", "applicant_id"), "person_id")
    vision = review.vision_flags(docs.select("applicant_id", "document_id", "format", F.col("hasTextLayer").alias("has_text_layer"), "note"), persons)
    parts = [_flags(flagged), _flags(vision), _flags(resolve.ambiguous_flags(aggregates))]
    if marks is not None:
        seen = marks.join(docs.select(F.col("document_id").alias("documentId"), "applicant_id"), "documentId")
        crop = F.col("cropPath") if "cropPath" in marks.columns else F.lit(None).cast("string")
        parts.append(_flags(seen.select("applicant_id", F.col("documentId").alias("document_id"), F.col("type").alias("flag_type"), rules.mark_label(F.col("page"), F.col("confidence")).alias("label"), crop.alias("crop_path"))))
    flags = parts[0]
    for more in parts[1:]:
        flags = flags.unionByName(more)
    documents = docs.select("applicant_id", "document_id", "filename", "doc_type", "format", "pageCount", "hasTextLayer", "note")
    return {"documents": documents, "persons": persons, "aggregates": aggregates, "flags": flags}


def _people(persons: DataFrame, documents: DataFrame, applicants: DataFrame) -> DataFrame:
    told = documents.select("document_id", "filename", F.col("doc_type").alias("docType"))
    mentions = persons.join(told, "document_id", "left").select(
        "applicant_id", F.col("document_id").alias("doc_seq"), "person_seq", F.col("name_raw").alias("nameRaw"), "role", "affiliation", F.col("source_kind").alias("sourceKind"), F.col("source_page").alias("sourcePage"),
        "confidence", F.col("is_self").alias("isSelf"), F.col("document_id").alias("documentId"), "filename", "docType", *(["evidence"] if "evidence" in persons.columns else []))
    return resolve.aggregate_people(mentions, applicants).withColumn("final_status", F.lit("pending"))


def reaggregate(persons: DataFrame, documents: DataFrame, applicants: DataFrame, flags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From stored mentions: the applicants' aggregates made anew, and all flags with only their ambiguous ones replaced. What
    mentions rest on (evidence) isn't stored, so sources lose it."""
    own = persons.join(applicants.select("applicant_id"), "applicant_id", "left_semi").drop("evidence")
    aggregates = _people(own, documents, applicants)
    return aggregates, review.replace_ambiguous(_flags(flags), _flags(resolve.ambiguous_flags(aggregates)), applicants)


def replaced(old: dict[str, DataFrame], new: dict[str, DataFrame], applicants: DataFrame) -> dict[str, DataFrame]:
    """Every table after the applicants' rows have been replaced, those without new rows included."""
    gone = applicants.select("applicant_id").distinct()
    return {name: table.join(gone, "applicant_id", "left_anti").unionByName(new[name]).select(table.columns) for name, table in old.items()}
