"""URL filters over dated lists, by a temporal join in DataFrame operations.

A list is a log of dated entries: at a date, a rule (a domain, a path prefix or a word of the URL) is put on the block list or the allow list, or taken off.
Entries of one rule become validity intervals, from one entry's date to the next one's. A capture is judged by the entries active when it was
fetched, never by later ones: its URL gives the keys a rule could have (parent domains, path prefixes, words), the keys meet the rules in an
equi-join, and the as-of interval is found among the rule's own, which are sorted in one array. Allow beats block.

Rows are few and narrow: keys, ids and dates, not pages. A URL gives no more parent domains and path prefixes than the longest rule has labels and segments, so
that a very long URL costs its length times that. Rules are written once and broadcast if Spark's own size check allows, else both sides shuffle by key
and adaptive execution splits a hot host. Null URLs and URLs without host have no host and are not blocked by a domain; null fetch
dates meet no interval. Other columns are not read. Entries of one rule and date apply in order of seq. Repeated captures are judged each.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.session import cut

# The default list: (seq, listed_on, list, kind, pattern, action).
ENTRIES = [
    (1, "2023-05-01", "block", "domain", "spam-farm.example.org", "add"),
    (2, "2024-03-10", "block", "domain", "cheap-pills.example.com", "add"),
    (3, "2024-06-30", "block", "domain", "spam-farm.example.org", "remove"),
    (4, "2024-09-01", "block", "domain", "spam-farm.example.org", "add"),
    (5, "2024-02-01", "block", "word", "casino", "add"),
    (6, "2024-08-15", "block", "word", "pills", "add"),
    (7, "2024-04-01", "block", "prefix", "blog.tionsh.example.com/es", "add"),
    (8, "2024-01-15", "block", "domain", "example.net", "add"),
    (9, "2024-02-15", "block", "domain", "example.net", "remove"),
    (10, "2024-05-05", "allow", "prefix", "blog.tionsh.example.com/es/533", "add"),
    (11, "2024-07-01", "allow", "domain", "www.cheap-pills.example.com", "add"),
    (12, "2024-10-01", "allow", "domain", "www.cheap-pills.example.com", "remove"),
    (13, "2024-11-11", "block", "word", "utm", "add"),
]
ENTRY_SCHEMA = "seq int, listed_on string, list string, kind string, pattern string, action string"
#: The pages table has no fetch date; captures are taken to be made on one day after another of this many.
FIRST_FETCH, FETCH_DAYS = "2024-01-01", 366
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def intervals(entries: DataFrame) -> DataFrame:
    """kind, pattern, spans: the sorted intervals in which a rule is on a list; a rule taken off has none there."""
    own = Window.partitionBy("list", "kind", "pattern").orderBy("since", "seq")
    dated = entries.select(F.lower("pattern").alias("pattern"), "list", "kind", "action", "seq", F.to_date("listed_on").alias("since"))
    spans = dated.withColumn("until", F.lead("since").over(own)).filter("action = 'add' and (until is null or since < until)")
    return spans.groupBy("kind", "pattern").agg(F.array_sort(F.collect_list(F.struct("since", "until", "list"))).alias("spans"))


def parsed(url: Column) -> tuple[Column, Column]:
    """A lower-case URL's host, without full stops at its end, and its path."""
    return F.regexp_replace(F.regexp_extract(url, _HOST, 1), r"\.+$", ""), F.regexp_extract(url, _PATH, 1)


def keys(captures: DataFrame, labels_most: int, segments_most: int) -> DataFrame:
    """id, fetched_on, kind, pattern for each key that a capture's URL has and a rule could have."""
    low = captures.select("id", "fetched_on", F.lower(F.coalesce("url", F.lit(""))).alias("url"))
    host, path = parsed(F.col("url"))
    rows = low.select("id", "fetched_on", "url", host.alias("host"), F.split(path, "/").alias("path"))
    labels = F.split("host", r"\.")
    first = F.greatest(F.lit(1), F.size(labels) - labels_most + 1)
    domains = F.transform(F.sequence(first, F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    last = F.least(F.size("path"), F.lit(max(segments_most, 1)))
    prefixes = F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(F.lit("prefix").alias("kind"), F.concat("host", F.array_join(F.slice("path", F.lit(1), i), "/")).alias("pattern")))
    words = F.transform(F.array_distinct(F.split("url", "[^a-z0-9]+")), lambda w: F.struct(F.lit("word").alias("kind"), w.alias("pattern")))
    found = F.array_distinct(F.filter(F.concat(domains, prefixes, words), lambda k: k.pattern != ""))
    return rows.select("id", "fetched_on", F.explode(found).alias("key")).select("id", "fetched_on", "key.*")


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures: id, url, fetched_on. Adds host, blocked, n_rules (active block rules), rule (the first by kind and pattern), allowed_by."""
    active = "transform(filter(spans, s -> s.since <= fetched_on and (s.until is null or fetched_on < s.until)), s -> s.list)"
    rules = cut(intervals(entries), "rules")
    most = lambda kind, by: F.max(F.when(F.col("kind") == kind, F.size(F.split("pattern", by))))
    longest = rules.agg(most("domain", r"\.").alias("labels"), most("prefix", "/").alias("segments")).first()
    hits = keys(captures, longest["labels"] or 1, longest["segments"] or 1).join(rules, ["kind", "pattern"]).select("id", "fetched_on", F.concat_ws(":", "kind", "pattern").alias("rule"), F.explode(F.expr(active)).alias("list"))
    block, allow = F.when(F.col("list") == "block", F.col("rule")), F.when(F.col("list") == "allow", F.col("rule"))
    # a capture's hits are few; repeated rows have the same hits, which count once
    verdicts = hits.distinct().groupBy("id", "fetched_on").agg(F.count(block).alias("n_rules"), F.min(block).alias("rule"), F.min(allow).alias("allowed_by"))
    host, _ = parsed(F.lower(F.coalesce("url", F.lit(""))))
    out = captures.select("id", "url", "fetched_on", host.alias("host")).join(verdicts, ["id", "fetched_on"], "left")
    return out.select("id", "url", "fetched_on", "host", F.coalesce("n_rules", F.lit(0)).cast("long").alias("n_rules"), "rule", "allowed_by", (F.coalesce("n_rules", F.lit(0)) > 0).alias("listed")).withColumn(
        "blocked", F.col("listed") & F.col("allowed_by").isNull()
    ).drop("listed")


def made_list(urls: DataFrame) -> DataFrame:
    """Dated entries for a share of the hosts and paths that occur, chosen by a hash of the pattern: a list that grows with the pages, as crawled lists do.

    urls: url. Every third host and every twentieth path is put on a list; half of these are taken off again, and half of those put back.
    """
    host, path = parsed(F.lower(F.coalesce("url", F.lit(""))))
    names = urls.select(host.alias("host"), F.regexp_replace(path, "/+$", "").alias("path")).filter("host <> ''").distinct()
    whole = F.concat("host", "path")
    both = F.array(F.struct(F.lit("domain").alias("kind"), F.col("host").alias("pattern")), F.struct(F.lit("prefix").alias("kind"), F.when(F.col("path") != "", whole).alias("pattern")))
    items = names.select(F.explode(both).alias("x")).select("x.*").filter("pattern is not null").distinct()
    code = lambda k: F.conv(F.substring(F.md5("pattern"), 1 + 4 * k, 4), 16, 10).cast("int")
    chosen = items.select("kind", "pattern", code(0).alias("c0"), code(1).alias("c1"), code(2).alias("c2")).filter("c0 % if(kind = 'domain', 3, 20) = 0")
    since = f"date_add(date'{FIRST_FETCH}', c1 % {FETCH_DAYS})"
    events = f"""filter(array(struct(101 as seq, {since} as day, 'add' as action), if(c2 % 2 = 0, struct(102 as seq, date_add({since}, 1 + c2 % 60) as day, 'remove' as action), null),
      if(c2 % 4 = 0, struct(103 as seq, date_add({since}, 90 + c2 % 60) as day, 'add' as action), null)), x -> x is not null)"""
    dated = chosen.selectExpr("kind", "pattern", "if(c0 % 9 = 0, 'allow', 'block') as list", f"explode({events}) as e")
    return dated.selectExpr("e.seq as seq", "cast(e.day as string) as listed_on", "list", "kind", "pattern", "e.action as action")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    day = F.date_add(F.to_date(F.lit(FIRST_FETCH)), F.pmod("page_id", F.lit(FETCH_DAYS)).cast("int"))
    captures = pages.select(F.col("page_id").alias("id"), "url", day.alias("fetched_on"))
    rows = ", ".join(str(x) for x in ENTRIES)
    entries = spark.sql(f"SELECT * FROM VALUES {rows} AS t({', '.join(x.split()[0] for x in ENTRY_SCHEMA.split(', '))})")
    return judge(captures, entries.union(made_list(pages.select("url")))).withColumnRenamed("id", "page_id")


_CODE = "CAST('0x' || substr(md5(pattern), {}, 4) AS INTEGER)"
ORACLE = f"""
WITH c AS (SELECT page_id, url, lower(coalesce(url, '')) AS u, (DATE '{FIRST_FETCH}' + CAST(page_id % {FETCH_DAYS} AS INTEGER))::DATE AS fetched_on FROM pages),
p AS (SELECT *, regexp_replace(regexp_extract(u, '{_HOST}', 1), '\\.+$', '') AS host, regexp_extract(u, '{_PATH}', 1) AS path FROM c),
n AS (SELECT 'domain' AS kind, host AS pattern FROM p WHERE host <> '' UNION SELECT 'prefix', host || regexp_replace(path, '/+$', '') FROM p WHERE host <> '' AND regexp_replace(path, '/+$', '') <> ''),
g AS (SELECT *, DATE '{FIRST_FETCH}' + c1 % {FETCH_DAYS} AS since, CASE WHEN c0 % 9 = 0 THEN 'allow' ELSE 'block' END AS list
  FROM (SELECT *, {_CODE.format(1)} AS c0, {_CODE.format(5)} AS c1, {_CODE.format(9)} AS c2 FROM n) WHERE c0 % CASE kind WHEN 'domain' THEN 3 ELSE 20 END = 0),
e(seq, listed_on, list, kind, pattern, action) AS (SELECT * FROM (VALUES {", ".join(str(x).replace(f"'{x[1]}'", f"DATE '{x[1]}'", 1) for x in ENTRIES)})
  UNION ALL SELECT 101, since, list, kind, pattern, 'add' FROM g UNION ALL SELECT 102, since + 1 + c2 % 60, list, kind, pattern, 'remove' FROM g WHERE c2 % 2 = 0
  UNION ALL SELECT 103, since + 90 + c2 % 60, list, kind, pattern, 'add' FROM g WHERE c2 % 4 = 0),
i AS (SELECT list, kind, pattern, action, listed_on AS since, lead(listed_on) OVER (PARTITION BY list, kind, pattern ORDER BY listed_on, seq) AS until FROM e),
h AS (SELECT p.page_id, i.list, i.kind || ':' || i.pattern AS rule FROM p JOIN i ON i.action = 'add' AND i.since <= p.fetched_on AND (i.until IS NULL OR p.fetched_on < i.until)
  AND CASE i.kind WHEN 'domain' THEN p.host = i.pattern OR ends_with(p.host, '.' || i.pattern)
    WHEN 'prefix' THEN p.host || p.path = i.pattern OR starts_with(p.host || p.path, i.pattern || '/')
    ELSE list_contains(string_split_regex(p.u, '[^a-z0-9]+'), i.pattern) END),
v AS (SELECT page_id, count(*) FILTER (list = 'block') AS n, min(rule) FILTER (list = 'block') AS rule, min(rule) FILTER (list = 'allow') AS allowed_by FROM (SELECT DISTINCT * FROM h) GROUP BY page_id)
SELECT p.page_id, p.url, p.fetched_on, p.host, coalesce(v.n, 0) AS n_rules, v.rule, v.allowed_by, coalesce(v.n, 0) > 0 AND v.allowed_by IS NULL AS blocked FROM p LEFT JOIN v USING (page_id)
"""
