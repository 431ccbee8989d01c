"""Operator 2: URL filters by dated lists.

Dated entries (pattern, day, action) become validity intervals: an entry holds from its day to the day
of the next one for the same pattern. Every capture is evaluated as of its fetch day against the
entries of its host and of all parent domains; the longest pattern with an entry in force decides:
`block` and `allow` give that verdict, `remove` takes the pattern off the list.

Scale: entries are first reduced to one for each pattern and day (block before allow before remove), so
a pattern's history has at most as many rows as days. Captures are reduced to distinct hosts and
days before the join, which is by pattern, month and salt: no row meets intervals of other months, and the hosts below one
domain are dealt to SALTS tasks a month by their hash (intervals are repeated for each). Verdicts go back to captures
by host and day.

Defined cases: a null or unusable url, or a null day, has verdict 'none'; entries with a null pattern, day or
action are ignored; patterns and hosts compare in lower case; repeated captures get a row each; equal entries count
once; an empty table of captures gives an empty result, an empty list 'none' for all; further columns are
not read. Host names are looked up as they are, without a list of public suffixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.llm.common import table

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
LAST_DAY = "9999-12-31"
SALTS = 8


def host_of(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(url), HOST, 1), F.lit(""))


def parents(host: Column) -> Column:
    """The host and every domain above it."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """entries: pattern, day, action. Returns pattern, action, since, until (exclusive)."""
    strict = F.when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1).when(F.col("action") == "remove", 0)
    dated = entries.select(F.lower("pattern").alias("pattern"), F.col("day").alias("since"), strict.alias("strict")).dropna()
    daily = dated.groupBy("pattern", "since").agg(F.max("strict").alias("strict"))
    until = F.lead("since").over(Window.partitionBy("pattern").orderBy("since"))
    action = F.element_at(F.array(F.lit("remove"), F.lit("allow"), F.lit("block")), F.col("strict") + 1)
    return daily.select("pattern", action.alias("action"), "since", F.coalesce(until, F.lit(LAST_DAY).cast("date")).alias("until"))


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures: page_id, url, day. Returns page_id, host, day, verdict, pattern and since of the deciding entry."""
    keyed = captures.select("page_id", host_of(F.col("url")).alias("host"), "day")
    wanted = keyed.dropna(subset=["host", "day"]).select("host", "day").distinct()
    month = lambda c: F.year(c) * 12 + F.month(c)
    span = wanted.agg(F.min("day").alias("first"), F.max("day").alias("last"))  # one row
    held = intervals(entries).join(F.broadcast(span), (F.col("since") <= F.col("last")) & (F.col("until") > F.col("first")))
    spread = held.select("pattern", "action", "since", "until", F.explode(F.sequence(month(F.greatest("since", "first")), month(F.least("until", "last")))).alias("month"))
    spread = spread.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = wanted.withColumns({"month": month("day"), "pattern": F.explode(parents(F.col("host")))})
    asked = asked.withColumn("salt", F.when(F.col("pattern") == F.col("host"), 0).otherwise(F.pmod(F.xxhash64("host", "day"), F.lit(SALTS))).cast("int"))
    hits = asked.join(spread, ["pattern", "month", "salt"]).where((F.col("since") <= F.col("day")) & (F.col("day") < F.col("until")) & (F.col("action") != "remove"))
    best = hits.groupBy("host", "day").agg(F.max_by(F.struct("action", "pattern", "since"), F.length("pattern")).alias("hit"))
    return keyed.join(best, ["host", "day"], "left").select(
        "page_id", "host", "day", F.coalesce("hit.action", F.lit("none")).alias("verdict"), F.col("hit.pattern").alias("pattern"), F.col("hit.since").alias("since")
    )


# The tables have neither fetch days nor lists; both are made here from the urls, by fixed rules.
FIRST_DAY, DAYS, LIST_FIRST, LIST_DAYS, VERSIONS = "2020-01-01", 1461, "2019-06-01", 1800, 4


def captured(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod("page_id", F.lit(DAYS)).cast("int")).alias("day"))


def made_list(pages: DataFrame) -> DataFrame:
    """Entries of every host, VERSIONS - 1 of its own and one of its parent domain, dated by a hash."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).dropna().distinct()
    each = hosts.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(VERSIONS - 1))))
    h = F.conv(F.substring(F.md5(F.concat("host", F.lit("|"), F.col("k").cast("string")).cast("binary")), 1, 7), 16, 10).cast("int")
    pattern = F.when(F.col("k") == VERSIONS - 1, F.regexp_replace("host", r"^[^.]*\.", "")).otherwise(F.col("host"))
    action = F.element_at(F.array(F.lit("block"), F.lit("allow"), F.lit("remove")), h % 3 + 1)
    return each.select(pattern.alias("pattern"), F.date_add(F.lit(LIST_FIRST).cast("date"), h % LIST_DAYS).alias("day"), action.alias("action"))


def op2_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return evaluate(captured(pages), made_list(pages))


OP2_SQL = f"""
with c as (select page_id, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '') host,
                  cast(date '{FIRST_DAY}' + cast(page_id % {DAYS} as int) as date) as day from pages),
h as (select distinct host from c where host is not null),
e0 as (select host, k, cast('0x' || substr(md5(host || '|' || k::varchar), 1, 7) as int) v from h, range({VERSIONS}) r(k)),
e1 as (select case when k = {VERSIONS - 1} then regexp_replace(host, '^[^.]*\\.', '') else host end pattern,
              cast(date '{LIST_FIRST}' + cast(v % {LIST_DAYS} as int) as date) as since, case v % 3 when 0 then 2 when 1 then 1 else 0 end strict from e0),
e2 as (select pattern, since, max(strict) strict from e1 group by 1, 2),
e as (select *, coalesce(lead(since) over (partition by pattern order by since), date '{LAST_DAY}') as until from e2),
m as (select c.host, c.day, arg_max(struct_pack(strict := e.strict, pattern := e.pattern, since := e.since), length(e.pattern)) hit
      from (select distinct host, day from c where host is not null) c join e on (c.host = e.pattern or ends_with(c.host, '.' || e.pattern))
        and e.since <= c.day and c.day < e.until where e.strict > 0 group by 1, 2)
select page_id, c.host, c.day, case hit.strict when 2 then 'block' when 1 then 'allow' else 'none' end verdict, hit.pattern pattern, hit.since since
from c left join m on c.host = m.host and c.day = m.day
"""
