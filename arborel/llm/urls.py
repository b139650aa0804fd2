"""URL rules as a sort-merge range join.

A host's canonical key is its labels in reverse, each ended by a full stop, so that a rule's host and its subdomains are one interval of keys: those
that begin with the rule's key. Two sorted sweeps find what fits:

1. Over hosts: the ends of the rules' intervals and the hosts of the urls stand in one order. Where an interval begins, its rule is pushed on the stack of
   the rules that are open there; where it ends, it is popped. So the stack that a host meets holds the hosts, nested in each other, whose rules may fit.
2. Over paths, for each of these rule hosts: a rule's path covers the interval of paths that begin with it. Each rule carries the stack of the rules that
   enclose it, so the last rule before a url has on its stack all that can be active there, and the deepest of them whose interval holds the url fits.

A sweep over very many urls is dealt out, each part with all the rules of its sweep, and never in more parts than keep the rules' copies fewer than the urls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Urls that are swept together, about.
SWEEP = 200_000
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Verdict on urls that no rule fits.
DEFAULT = "allow"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty if url is null or has no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    ascii_ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, ascii_, ascii_.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def canonical(host: Column) -> Column:
    """The host's labels in reverse, each ended by a full stop."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def above(key: Column) -> Column:
    """The canonical keys of a host and of all hosts above it, from the top."""
    labels = F.split(F.substring(key, 1, F.length(key) - 1), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), "."), F.lit(".")))


def _host(key: Column) -> Column:
    return F.array_join(F.reverse(F.split(F.substring(key, 1, F.length(key) - 1), r"\.")), ".")


def _swept(events: DataFrame, opens: DataFrame, *group: str) -> DataFrame:
    """events (group, at, host, path) with `active`: what the last of opens (group, at, stack) before or at the same place of its group holds; events without any fall out.

    Each group's events are dealt to parts of SWEEP rows, or of as many as the group has opens, if these are more.
    """
    size = opens.groupBy(*group).agg(F.count("*").alias("n"))
    parts = F.ceil(F.count("*") / F.greatest(F.lit(SWEEP), F.max("n"))).cast("int")
    parts = events.join(size, list(group)).groupBy(*group).agg(parts.alias("parts"))
    dealt = events.join(parts, list(group)).withColumn("part", F.pmod(F.xxhash64("host", "path"), F.col("parts")).cast("int"))
    every = opens.join(parts, list(group)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = dealt.select(*group, "part", "at", "host", "path", F.lit(True).alias("is_event")).unionByName(every.select(*group, "part", "at", "stack", F.lit(False).alias("is_event")), allowMissingColumns=True)
    sweep = Window.partitionBy(*group, "part").orderBy("at", "is_event").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).where("is_event and active is not null").select(*group, "host", "path", "active")


def _open_hosts(hosts: DataFrame, known: DataFrame) -> DataFrame:
    """Of distinct hosts (host, at, its canonical key): a row (host, key) for each rule host that covers it, by a sweep over hosts."""
    own = known.select("key").distinct()
    nested = own.select("key", F.explode(above(F.col("key"))).alias("outer")).join(own.withColumnRenamed("key", "outer"), "outer").groupBy("key").agg(F.array_sort(F.collect_list("outer")).alias("stack"))
    top = lambda key: F.substring_index(key, ".", 1)
    push = nested.select(top("key").alias("top"), F.col("key").alias("at"), "stack")
    # What begins with the key is less than the key with the full stop at its end raised by one.
    end = F.concat(F.substring("key", F.lit(1), F.length("key") - 1), F.lit("/"))
    pop = nested.select(top("key").alias("top"), end.alias("at"), F.filter("stack", lambda k: k != F.col("key")).alias("stack"))
    events = hosts.select(top("at").alias("top"), "at", "host", F.lit("").alias("path"))
    return _swept(events, push.unionByName(pop), "top").select("host", F.explode("active").alias("key"))


def stacked(rules: DataFrame) -> DataFrame:
    """rules (key, path, verdict), unique by key and path, each with its stack: itself and the rules of its host whose path begins its path, short to long."""
    starts = F.transform(F.sequence(F.lit(0), F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    above = rules.select("key", "path", F.explode(starts).alias("start"))
    outer = rules.select("key", F.col("path").alias("start"), "verdict")
    entry = F.struct(F.length("start").alias("size"), F.col("start"), F.col("verdict"))
    return above.join(outer, ["key", "start"]).groupBy("key", "path").agg(F.array_sort(F.collect_list(entry)).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """Each row of pages (page_id, url) with the longest rule that fits it.

    rules: host, path, verdict; the rule's length is that of host and path together, and of two equally long the one
    with the longer host wins; rules repeated for a host and path count once (the smallest verdict). Rules with a null fit nothing.
    Returns page_id, host, path, rule (host and path; null if none fits) and verdict. A null url, and one without ://, has
    an empty host and path and fits no rule. Repeated pages and pages with a null id are each judged by
    themselves, by their url. Other columns of pages are ignored. No pages give no rows; no rules give the default verdict.
    """
    host, path = split_url(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = rules.where("host is not null and path is not null and verdict is not null").groupBy(canonical(F.col("host")).alias("key"), "path").agg(F.min("verdict").alias("verdict"))
    stacks = stacked(known)

    distinct = urls.where("host <> ''").select("host", "path").distinct()
    hosts = distinct.select("host").distinct().withColumn("at", canonical(F.col("host")))
    levels = distinct.join(_open_hosts(hosts, known), "host").withColumn("at", F.col("path"))
    swept = _swept(levels, stacks.withColumnRenamed("path", "at"), "key")
    fitting = F.filter("active", lambda r: F.substring(F.col("path"), F.lit(1), r["size"]) == r["start"])
    deepest = swept.select("host", "path", "key", F.element_at(F.when(F.size(fitting) > 0, fitting), -1).alias("r")).where("r is not null")
    own = F.struct((F.length("key") + F.col("r.size")).alias("size"), F.length("key").alias("host_size"), _host(F.col("key")).alias("rule_host"), F.col("r.start").alias("start"), F.col("r.verdict").alias("verdict"))
    best = deepest.groupBy("host", "path").agg(F.max(own).alias("best"))
    out = urls.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.concat("best.rule_host", "best.start").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict by RULES."""
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


ORACLE = r"""
with parts as (
  select page_id, translate(coalesce(regexp_extract(case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end, '^[^/?#]*'), ''),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end, '^[^/?#]*([^?#]*)', 1), '') as path
  from pages),
rules(rule_host, rule_path, rule_verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits as (
  select page_id, host, path, rule_host || rule_path as rule, rule_verdict,
         row_number() over (partition by page_id, host, path order by length(rule_host || rule_path) desc, length(rule_host) desc) as n
  from parts join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path))
select p.page_id, p.host, p.path, f.rule, coalesce(f.rule_verdict, 'allow') as verdict
from parts p left join fits f on p.page_id = f.page_id and p.host = f.host and p.path = f.path and f.n = 1
"""
