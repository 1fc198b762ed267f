"""URL filtering against dated lists.

List entries (list, rule, day, add or remove) become validity intervals; an as-of join judges every capture by the
entries that were active when it was fetched. A rule is a domain and covers its subdomains.

Intervals are kept one row a rule, so that a capture meets a rule once and looks its fetch time up among the rule's
sorted intervals instead of joining with each of them. Rules are matched to distinct hosts and these to captures: the few
hosts that have many captures by a broadcast, so that their captures stay where they are, the others by shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from heristat.llm.common import materialize, quoted, spread_join

#: Host of a URL: lower case, without user, port and final dot. Empty where there is none.
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"


def host(url: F.Column) -> F.Column:
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), _HOST, 1)), r"\.$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """entries (list, rule, day, added 0/1) to rows (list, rule, since, until): since <= t < until, until null while it lasts.

    Of a rule's entries on one day an addition prevails; repeated entries and entries with a null count once or not at
    all. After that a rule has one entry a day at most, which bounds its window.
    """
    daily = entries.dropna(subset=["list", "rule", "day", "added"]).groupBy("list", "rule", "day").agg(F.max("added").alias("added"))
    own = W.partitionBy("list", "rule").orderBy("day")
    changes = daily.withColumn("was", F.lag("added", 1, 0).over(own)).filter("added <> was")
    return changes.withColumn("until", F.lead("day").over(own)).filter("added = 1").select("list", "rule", F.col("day").alias("since"), "until")


def judge(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "day") -> DataFrame:
    """captures' id, host and time with lists (active ones that cover the host, sorted, comma-joined) and blocked (0/1).

    One row for each capture, repeated ones alike; without captures no rows. A null or odd URL has the empty host; it, and a
    null time, are covered by nothing; a URL of any length counts whole. Without entries nothing is blocked. Other columns
    don't count.
    """
    own = captures.select(F.col(quoted(id_col)), host(F.col(quoted(url_col))).alias("host"), F.col(quoted(time_col)).cast("long").alias(time_col))
    suffixes = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'))")
    hosts = own.filter("host <> ''").groupBy("host").agg(F.count(F.lit(1)).alias("_n")).select("host", "_n", F.explode(suffixes).alias("rule"))
    rules = intervals(entries).groupBy("rule").agg(F.sort_array(F.collect_set(F.struct("since", "until", "list"))).alias("_spans"))
    covered = materialize(hosts.join(rules, "rule").groupBy("host").agg(F.flatten(F.collect_list("_spans")).alias("_spans"), F.max("_n").alias("_n")), "hosts")
    active = F.expr(f"array_sort(array_distinct(transform(filter(_spans, s -> s.since <= {quoted(time_col)} AND (s.until IS NULL OR {quoted(time_col)} < s.until)), s -> s.list)))")
    found = spread_join(own, covered, "host", "_n", "left").withColumn("active", F.coalesce(active, F.expr("CAST(array() AS ARRAY<STRING>)")))
    return found.select(F.col(quoted(id_col)), "host", F.col(quoted(time_col)), F.array_join("active", ",").alias("lists"), F.when(F.size("active") > 0, 1).otherwise(0).alias("blocked"))


# --- the query's captures and lists: derived from the pages by rules that SQL can repeat ----------------------------------

_V = "CAST(conv(substr(md5(host), 1, 8), 16, 10) AS BIGINT)"


def captures_of(pages: DataFrame) -> DataFrame:
    """Every page with the day it was fetched on, from 0 to 729."""
    return pages.select("page_id", "url", F.expr("pmod(page_id * 37, 730)").alias("day"))


def entries_of(pages: DataFrame) -> DataFrame:
    """Three lists whose rules are hosts and parent domains of the pages, with additions, removals and new additions."""
    hosts = pages.select(host(F.col("url")).alias("host")).distinct().filter("host <> ''").withColumn("v", F.expr(_V)).filter("v % 5 < 3")
    rule = "CASE WHEN v % 2 = 1 AND size(split(host, '[.]')) > 3 THEN substr(host, instr(host, '.') + 1) ELSE host END"
    gone = "v % 500 + 1 + (v div 7) % 300"
    steps = f"""array(named_struct('day', v % 500, 'added', 1), CASE WHEN v % 4 <> 0 THEN named_struct('day', {gone}, 'added', 0) END,
        CASE WHEN v % 8 = 1 THEN named_struct('day', {gone} + 1 + (v div 11) % 100, 'added', 1) END)"""
    return hosts.select(F.expr("element_at(array('ads', 'gambling', 'malware'), CAST(v % 3 AS INT) + 1)").alias("list"), F.expr(rule).alias("rule"), F.explode(F.expr(f"filter({steps}, x -> x IS NOT NULL)")).alias("e")).select("list", "rule", "e.day", "e.added")


def query(pages: DataFrame) -> DataFrame:
    return judge(captures_of(pages), entries_of(pages))


SQL = r"""
WITH c AS (SELECT page_id, regexp_replace(lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.$', '') AS host,
    page_id * 37 % 730 AS day FROM pages),
h AS (SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 8))::BIGINT AS v FROM c WHERE host <> ''),
k AS (SELECT host, v, ['ads', 'gambling', 'malware'][v % 3 + 1] AS list,
    CASE WHEN v % 2 = 1 AND len(string_split(host, '.')) > 3 THEN substr(host, instr(host, '.') + 1) ELSE host END AS rule, v % 500 + 1 + v // 7 % 300 AS gone FROM h WHERE v % 5 < 3),
e AS (SELECT list, rule, v % 500 AS day, 1 AS added FROM k UNION ALL SELECT list, rule, gone, 0 FROM k WHERE v % 4 <> 0
    UNION ALL SELECT list, rule, gone + 1 + v // 11 % 100, 1 FROM k WHERE v % 8 = 1),
d AS (SELECT list, rule, day, max(added) AS added FROM e GROUP BY ALL),
w AS (SELECT *, lag(added, 1, 0) OVER (PARTITION BY list, rule ORDER BY day) AS was FROM d),
i AS (SELECT list, rule, added, day AS since, lead(day) OVER (PARTITION BY list, rule ORDER BY day) AS until FROM w WHERE added <> was),
a AS (SELECT DISTINCT c.page_id, i.list FROM c JOIN i ON i.added = 1 AND (c.host = i.rule OR suffix(c.host, '.' || i.rule)) AND i.since <= c.day AND (i.until IS NULL OR c.day < i.until)),
g AS (SELECT page_id, string_agg(list, ',' ORDER BY list) AS lists FROM a GROUP BY page_id)
SELECT c.page_id, c.host, c.day, coalesce(g.lists, '') AS lists, CASE WHEN g.lists IS NULL THEN 0 ELSE 1 END AS blocked FROM c LEFT JOIN g USING (page_id)
"""
