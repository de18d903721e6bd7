"""URL filters with redirect equivalence (DataFrame operations only).

1. A rule (host, path, action) fits a URL whose host is the rule's or a subdomain of it and whose path starts
   with the rule's path; the longest fitting rule decides. The rules compile into one conditional expression.
2. URLs without a rule follow their aliases. Nodes are URLs without scheme, fragment, tracking parameters
   and closing slash; edges are canonical links and redirects (meta refresh) taken from the pages. A distributed
   connected-components run joins what points at each other; in a component an explicit allow of any member
   wins over blocks, a block without an allow is passed on to every member without a rule, and without either
   the verdict is ``default``. Explicit rules of a page itself always stand.

Scale: rules never shuffle; only keys of pages without a rule do. Decisions are reduced by a map-side aggregation per
component and only components that change a verdict are joined back; a very common address is split by the engine's skew join.

Defined cases: a null URL or one without ``://`` has empty host and path, fits no rule, has no aliases and gets the
default; null or broken html has no edges; repeated rows each get their verdict; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import materialize
from tallyloom.llm.components import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
TRACKING = r"(^|&)(?:(?:utm_[a-z]+|gclid|fbclid|ref)=[^&#]*(?:&|$))+"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    action: str

    @property
    def name(self) -> str:
        return self.host + self.path


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, SPLIT, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, SPLIT, 2), F.lit(""))


def rule_of(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """(name, action) of the longest fitting rule, nulls if none; equal lengths go by order of the list."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(sorted(rules, key=lambda r: -len(r.name))):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, action = F.when(fits, r.name).otherwise(name), F.when(fits, r.action).otherwise(action)
    return name, action


def key_of(url: Column) -> Column:
    """What aliases of one address share; null without ``://``."""
    query = F.regexp_replace(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)", 1), TRACKING, "$1")
    query = F.regexp_replace(query, "&$", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    return F.when(url.contains("://"), F.concat(host_of(url), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def undotted(path: Column) -> Column:
    """An absolute path without its ``.`` and ``..`` parts."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)
    step = lambda acc, x: F.when(x == ".", acc).when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), step)
    end = F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise("")
    return F.concat(F.lit("/"), F.array_join(kept, "/"), end)


def links(pages: DataFrame) -> DataFrame:
    """(url, to) of canonical links and redirects, resolved against the page's address."""
    tag = F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0)))
    t = pages.where("url is not null and html is not null").where(F.col("html").rlike(r"(?i)canonical|http-equiv")).select("url", tag.alias("tag"))
    href = F.regexp_extract("tag", r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    content = F.regexp_extract("tag", r"(?is)\bcontent\s*=\s*(?:\"[^\">]*?url\s*=\s*'?([^\"'>\s]+)|'[^'>]*?url\s*=\s*\"?([^'\">\s]+))", 1)
    to = F.when(F.col("tag").rlike(r"(?is)^<link\b.*\brel\s*=\s*[\"']?canonical\b"), href).when(
        F.col("tag").rlike(r"(?is)^<meta\b.*\bhttp-equiv\s*=\s*[\"']?refresh\b"), content
    )
    t = t.select("url", F.replace(to, F.lit("&amp;"), F.lit("&")).alias("to")).where("to <> ''")
    scheme = F.regexp_extract("url", r"^([^:/?#]*)://", 1)
    site, path = F.concat(scheme, F.lit("://"), host_of(F.col("url"))), path_of(F.col("url"))
    tail = F.regexp_extract("to", r"(?s)^[^?#]*(.*)$", 1)
    relative = F.concat(F.regexp_replace(path, "[^/]*$", ""), F.regexp_extract("to", r"(?s)^([^?#]*)", 1))
    relative = F.when(relative.startswith("/"), relative).otherwise(F.concat(F.lit("/"), relative))
    query = F.regexp_extract("url", r"(?s)^[^?#]*(\?[^#]*)", 1)
    full = (
        F.when(F.col("to").rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.col("to"))
        .when(F.col("to").startswith("//"), F.concat(scheme, F.lit(":"), F.col("to")))
        .when(F.col("to").startswith("/"), F.concat(site, undotted(F.regexp_extract("to", r"(?s)^([^?#]*)", 1)), tail))
        .when(F.col("to").startswith("?"), F.concat(site, path, F.col("to")))
        .when(F.col("to").startswith("#"), F.concat(site, path, query))
        .when(~F.col("to").rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.concat(site, undotted(relative), tail))  # mailto: and the like are no addresses
    )
    full = F.when(F.col("url").contains("://"), full)
    return t.select("url", full.alias("to")).where("to is not null")


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict, a row per row of ``pages``."""
    url = F.col("url")
    name, action = rule_of(rules, host_of(url), path_of(url))
    base = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), name.alias("rule"), action.alias("action"), key_of(url).alias("key"))
    edges = links(pages)
    target = F.col("to")
    edges = materialize(
        edges.select(key_of(url).alias("u"), key_of(target).alias("v"), rule_of(rules, host_of(target), path_of(target))[1].alias("action")), "url-edges"
    )
    part = connected_components(edges.select("u", "v"))
    said = base.select("key", "action").unionAll(edges.select("v", "action")).where("key is not null")
    said = said.groupBy("key").agg(F.bool_or(F.col("action") == "allow").alias("a"), F.bool_or(F.col("action") == "block").alias("b"))
    said = said.join(part, said["key"] == part["node"], "left").select("key", F.coalesce("component", "key").alias("component"), "a", "b")
    decided = said.groupBy("component").agg(F.coalesce(F.bool_or("a"), F.lit(False)).alias("a"), F.coalesce(F.bool_or("b"), F.lit(False)).alias("b"))
    other = F.when(F.col("a"), "allow").when(F.col("b"), "block").otherwise(default)
    changed = decided.select("component", other.alias("passed")).where(F.col("passed") != default)
    changed = said.select("key", "component").join(changed, "component").select(F.col("key").alias("k"), "passed")
    # Only rows that no rule decides ask their component; rows without an address have none, and would be one key.
    asks = F.col("action").isNull() & F.col("key").isNotNull()
    asked = base.where(asks).join(changed, F.col("key") == F.col("k"), "left").select(*base.columns, "passed")
    out = asked.unionByName(base.where(~asks).withColumn("passed", F.lit(None).cast("string")))
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", "passed", F.lit(default)).alias("verdict"))


#: The rules that the query is to apply.
RULES = [
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
]

ORACLE = r"""
with recursive p as (
  select page_id, url, html,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path,
         regexp_replace(regexp_replace(regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)', 1), '(^|&)(?:(?:utm_[a-z]+|gclid|fbclid|ref)=[^&#]*(?:&|$))+', '\1', 'g'), '&$', '') as query
  from pages),
k as (
  select *, case when contains(url, '://') then host || regexp_replace(path, '/+$', '') || case when query <> '' then '?' || query else '' end end as key,
         case when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
              when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
              when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
              when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
              when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/') then 'org/' end as rule
  from p),
r as (
  select *, case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block' end as action from k),
d as (select key, bool_or(action = 'allow') as a, bool_or(action = 'block') as b from r where key is not null group by key)
select page_id, host, path, rule, coalesce(action, case when a then 'allow' when b then 'block' end, 'allow') as verdict
from r left join d using (key)
"""
