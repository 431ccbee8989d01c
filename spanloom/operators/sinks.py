"""Exports: roster and review queue rows, CSV and XLSX, snapshots."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import rules

#: Fixed values, in order.
COLUMNS = ["canonical_name", "roles", "affiliation", "sources", "needs_human", "is_self"]


def export_rows(people: DataFrame) -> DataFrame:
    roles = F.array_join(F.transform("roles", lambda r: F.coalesce(rules.lookup(rules.ROLE_LABELS, r), r)), ", ")
    sources = F.array_join(F.transform("sources", lambda s: F.concat(F.coalesce(rules.lookup(rules.DOC_LABELS, s["docType"]), s["docType"]), F.lit(" p."), s["page"].cast("string"))), "; ")
    return people.select("canonical_name", roles.alias("roles"), F.coalesce("affiliation", F.lit("")).alias("affiliation"), sources.alias("sources"), rules.yes_no(F.col("needs_human")).alias("needs_human"), rules.yes_no(F.col("is_self")).alias("is_self"))


def roster_export(people: DataFrame) -> DataFrame:
    return export_rows(people.where("not is_self and final_status <> 'rejected'"))


def queue_export(queue: DataFrame, flag: str | None = None) -> DataFrame:
    kept = queue if flag is None else queue.where(F.col("flag_type") == flag)
    return kept.select(F.coalesce("applicant_name", "applicant_id").alias("applicant"), F.coalesce(rules.lookup(rules.FLAG_LABELS, F.col("flag_type")), "flag_type").alias("flag"), F.coalesce("filename", F.lit("")).alias("document"), F.coalesce("label", F.lit("")).alias("label"))


def csv_lines(df: DataFrame) -> DataFrame:
    """One column `value`: each row as a CSV line."""
    return df.select(F.concat_ws(",", *(rules.csv_cell(F.col(c).cast("string")) for c in df.columns)).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    """One file with byte order mark and header, for an export that one person opens."""
    head = df.sparkSession.createDataFrame([("﻿" + ",".join(df.columns),)], "value string")
    head.unionByName(csv_lines(df)).coalesce(1).write.mode("overwrite").option("lineSep", "\n").text(path)


def xlsx_bytes(df: DataFrame, sheet: str = "people", width: int = 24, most_rows: int = 100_000) -> bytes:
    """A sheet with a bold header, for one roster; fails rather than collect more than most_rows."""
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    cell = lambda v, style="": f'<c t="inlineStr"{style}><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>'
    body = "<row>" + "".join(cell(c, ' s="1"') for c in df.columns) + "</row>" + "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows)
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office, package = "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/package/2006"
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    files = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{kind}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{kind}.styles+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Type="{office}/styles" Target="styles.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet xmlns="{main}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{main}"><cols><col min="1" max="{max(1, len(df.columns))}" width="{width}" customWidth="1"/></cols><sheetData>{body}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(name, '<?xml version="1.0" encoding="UTF-8"?>' + text)
    return out.getvalue()


def snapshot(spark: SparkSession, tables: dict[str, DataFrame], root: str, name: str, keep: int = 14) -> list[str]:
    """Copies the tables to a folder of that name under root and deletes all but the `keep` last by name. Returns what went."""
    for table, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{name}/{table}")
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = sorted((s.getPath().getName() for s in fs.listStatus(at)), reverse=True)[keep:]
    for old in gone:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(at, old), True)
    return gone


def write_by_key(df: DataFrame, path: str, key: str) -> None:
    """Overwrites only the partitions of the keys in df, so a repeated run gives the same table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)
