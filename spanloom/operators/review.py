"""The review tables: joins, summaries, state changes. Native throughout; small sides are left to the optimizer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions import rules


def latest_status(jobs: DataFrame, key: Column) -> DataFrame:
    """Status of each key's newest job; ties by id."""
    return jobs.withColumn("key", key).where("key is not null").groupBy("key").agg(F.max_by("status", F.struct("created_at", "id")).alias("job_status"))


def applicant_summary(applicants: DataFrame, people: DataFrame, documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """Counts of people, people to review and documents, and the newest job's status; one aggregate for each table before the joins.
    In display order, newest first, where applicants have created_at."""
    n_people = people.groupBy("applicant_id").agg(F.count("*").alias("people"), F.count_if("needs_human").alias("needs"))
    n_docs = documents.groupBy("applicant_id").agg(F.count("*").alias("documents"))
    status = latest_status(jobs, F.get_json_object("payload", "$.applicantId")).withColumnRenamed("key", "applicant_id")
    joined = applicants.join(n_people, "applicant_id", "left").join(n_docs, "applicant_id", "left").join(status, "applicant_id", "left")
    out = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("people", "needs", "documents")})
    return out.orderBy(F.desc("created_at"), "applicant_id") if "created_at" in applicants.columns else out


def status_badge(status: Column, needs: Column) -> Column:
    return F.when(status.isin("queued", "running"), "running").when(status == "error", "error").when(needs > 0, "needs_human").otherwise("ok")


def review_queue(flags: DataFrame, applicants: DataFrame, documents: DataFrame, persons: DataFrame) -> DataFrame:
    """Open flags with the names of what they point to; what is missing stays null, but a format, which is then 'pdf'. In display
    order, by applicant and newest first, where flags have created_at."""
    out = (
        flags.where("status = 'open'")
        .join(applicants.select("applicant_id", F.col("name").alias("applicant_name")), "applicant_id", "left")
        .join(documents.select("document_id", "filename", "format"), "document_id", "left")
        .join(persons.select("person_id", "name_raw"), "person_id", "left")
        .withColumn("format", F.coalesce("format", F.lit("pdf")))
    )
    return out.orderBy("applicant_id", F.desc("created_at")) if "created_at" in flags.columns else out


def candidate_sources(flags: DataFrame, people: DataFrame) -> DataFrame:
    """For each ambiguous flag, the sources of each candidate in its label; none gives an empty list."""
    named = flags.where("flag_type = 'ambiguous'").select("flag_id", "applicant_id", F.posexplode(F.split("label", " / ")).alias("i", "name"))
    known = people.select("applicant_id", F.col("canonical_name").alias("name"), "sources")
    return named.join(known, ["applicant_id", "name"], "left").select("flag_id", "i", "name", F.coalesce("sources", F.from_json(F.lit("[]"), known.schema["sources"].dataType)).alias("sources"))


def review_volume(persons: DataFrame, documents: DataFrame) -> DataFrame:
    """Mentions and those to review by document type and source kind, with the grand total (null type and kind)."""
    joined = persons.join(documents.select("document_id", "doc_type"), "document_id")
    out = joined.rollup("doc_type", "source_kind").agg(F.count("*").alias("total"), F.count_if("needs_human").alias("needs"), F.grouping_id().alias("level"))
    return out.where("level in (0, 3)").withColumn("pct", F.when(F.col("total") == 0, 0).otherwise(rules.half_up(F.col("needs") / F.col("total") * 100))).drop("level")


def people_per_document(people: DataFrame) -> DataFrame:
    """Distinct people of each document, the applicant left out."""
    return people.where("not is_self").select(F.explode(F.array_distinct(F.transform("sources", lambda s: s["documentId"]))).alias("document_id")).groupBy("document_id").agg(F.count("*").alias("people"))


def role_counts(people: DataFrame) -> DataFrame:
    return people.select(F.explode(F.array_distinct("roles")).alias("role")).groupBy("role").agg(F.count("*").alias("people"))


def primary_roles(people: DataFrame) -> DataFrame:
    """People by their first role, in the order of roles and null last, with how many are to review."""
    review = F.col("needs_human") | (F.size("name_candidates") > 1)
    order = F.array_position(F.array(*map(F.lit, rules.ROLES)), F.col("role"))
    return people.groupBy(rules.primary_role(F.col("roles")).alias("role")).agg(F.count("*").alias("people"), F.count_if(review).alias("to_review")).orderBy(order.asc_nulls_last())


def roster(people: DataFrame, view: str = "all", query: str = "") -> DataFrame:
    """A roster page: those to review, a role's, or all; searched; in display order."""
    keep = {"all": F.lit(True), "review": F.col("needs_human") | (F.size("name_candidates") > 1)}.get(view, F.array_contains("roles", view))
    hit = rules.person_hit(F.lit(query), F.col("canonical_name"), F.col("affiliation"), F.col("roles"))
    return people.where(keep & hit).orderBy("is_self", F.desc("needs_human"), "canonical_name")


def korean_order(people: DataFrame) -> DataFrame:
    """To review first, then by Korean collation."""
    return people.orderBy(F.desc(F.col("needs_human") | (F.size("name_candidates") > 1)), F.expr("collate(canonical_name, 'ko')"))


def newest(df: DataFrame, keys: list[str], created: str, tie: str) -> DataFrame:
    """The newest row of each key; ranked after a partial top-1, so a hot key costs one row a task."""
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(created, tie)).alias("r"))
    return best.select("r.*")


def duplicate_applicants(applicants: DataFrame) -> DataFrame:
    """For maintenance: applicants that an newer one with the same external id, or else the same normal name, replaces."""
    from spanloom.functions import names

    key = F.coalesce(F.concat(F.lit("ext:"), "external_id"), F.concat(F.lit("name:"), names.normalize(F.col("name"))))
    keyed = applicants.withColumn("key", key)
    last = keyed.groupBy("key").agg(F.max(F.struct("created_at", "applicant_id")).alias("last"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(last, "key").where(F.col("applicant_id") != F.col("last.applicant_id")).select("applicant_id", "key", F.col("last.applicant_id").alias("survivor"))


def orphan_files(files: DataFrame, flags: DataFrame, now: Column, min_age: str = "1 day") -> DataFrame:
    """Cached files that no flag refers to and that are older than min_age."""
    used = flags.where("crop_path is not null").select(F.col("crop_path").alias("path")).distinct()
    return files.join(used, "path", "left_anti").where(F.col("modificationTime") < now - F.expr(f"interval {min_age}"))


def expired(files: DataFrame, now: Column, ttl: str = "7 days") -> DataFrame:
    return files.where(F.col("modificationTime") < now - F.expr(f"interval {ttl}"))


def vision_flags(documents: DataFrame, persons: DataFrame) -> DataFrame:
    """Documents that only an image model could read and that gave nobody."""
    n = persons.groupBy("document_id").agg(F.count("*").alias("n"))
    joined = documents.join(n, "document_id", "left")
    return joined.where(rules.needs_vision(F.col("format"), F.col("has_text_layer"), F.coalesce("n", F.lit(0)))).select("applicant_id", "document_id", F.lit("needs_vision").alias("flag_type"), F.col("note").alias("label"))


def person_flags(persons: DataFrame) -> DataFrame:
    flag = rules.flag_type(F.col("source_kind"), F.col("confidence"))
    return persons.withColumn("flag_type", flag).where("flag_type is not null").select("person_id", "document_id", "flag_type")


def flag_counts(flags: DataFrame) -> DataFrame:
    return flags.groupBy("flag_type").agg(F.count("*").alias("flags"))


# ---- changes: tables are values, so each returns the table after the change


def replace_partition(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new's rows instead of all of table's with one of new's keys; what a dynamic partition overwrite by key does."""
    return table.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def cascade(child: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """child without the rows of deleted parents."""
    return child.join(gone.select(key).distinct(), key, "left_anti")


def upload(applicants: DataFrame, new: DataFrame) -> DataFrame:
    """New applicants replace those with their external id; rows without one never replace any."""
    gone = new.where("external_id is not null").select("external_id").distinct()
    return applicants.join(gone, "external_id", "left_anti").unionByName(new, allowMissingColumns=True)


def replace_ambiguous(flags: DataFrame, new: DataFrame, applicants: DataFrame) -> DataFrame:
    """Only the ambiguous flags of these applicants are made anew."""
    keyed = flags.join(applicants.select("applicant_id").distinct().withColumn("hit", F.lit(True)), "applicant_id", "left")
    return keyed.where(~(F.coalesce("hit", F.lit(False)) & (F.col("flag_type") == "ambiguous"))).drop("hit").unionByName(new, allowMissingColumns=True)


def act(people: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Review actions (id, action, name): the people after them, and the audit rows."""
    joined = people.join(actions.select("id", "action", F.trim("name").alias("new_name")), "id", "left")
    edit = (F.col("action") == "edit") & (F.coalesce("new_name", F.lit("")) != "")
    status = F.when(F.col("action") == "confirm", "confirmed").when(F.col("action").isin("reject", "exclude"), "rejected").when(F.col("action") == "edit", "edited").otherwise(F.col("final_status"))
    after = joined.withColumns({"after_status": status, "after_name": F.when(edit, F.col("new_name")).otherwise(F.col("canonical_name"))})
    field = F.when(F.col("action") == "edit", "canonical_name").otherwise("final_status")
    audit = after.where("action is not null").select(
        "applicant_id", F.col("id").alias("person_id"), field.alias("field"), F.when(F.col("action") == "edit", F.col("canonical_name")).otherwise(F.col("final_status")).alias("old_value"),
        F.when(F.col("action") == "edit", F.col("after_name")).otherwise(F.col("after_status")).alias("new_value"), "action")
    out = after.withColumns({"final_status": F.col("after_status"), "canonical_name": F.col("after_name")}).select(*people.columns)
    return out, audit


def keep_newest(files: DataFrame, n: int = 14) -> DataFrame:
    """Snapshots to delete: all but the n last by name."""
    rank = files.orderBy(F.desc("path")).limit(n)
    return files.join(rank.select("path"), "path", "left_anti")


def layout(entries: DataFrame) -> DataFrame:
    """Archive entries (archive, path) with the wrapper folder, if all lie in one, and the category folder behind it."""
    split = entries.withColumn("parts", F.split("path", "/"))
    top = split.groupBy("archive").agg(F.min(F.get("parts", 0)).alias("lo"), F.max(F.get("parts", 0)).alias("hi"), F.every(F.size("parts") > 1).alias("deep"))
    joined = split.join(top, "archive").withColumn("wrapper", F.when((F.col("lo") == F.col("hi")) & F.col("deep"), F.col("lo")))
    inner = F.when(F.col("wrapper").isNotNull(), F.slice("parts", 2, F.size("parts"))).otherwise(F.col("parts"))
    return joined.withColumn("inner", inner).select("archive", "path", "wrapper", F.when(F.size("inner") > 1, F.get("inner", 0)).alias("category"), F.element_at("inner", -1).alias("filename"))


def ranked(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
