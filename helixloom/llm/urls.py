"""URL filters by redirect equivalence.

Pages point at other urls by canonical links and by immediate redirects (meta refresh). Both kinds make edges;
connected components over them are groups of aliases. A decision of a rule on one url holds for its
aliases, an explicit allow before any block.
"""

from __future__ import annotations

import html
import re
from html.entities import html5
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixloom.llm.common import join_to_one
from helixloom.llm.components import connected_components

HOST = r"(?s)^.*?://([^/?#]*)"
PATH = r"(?s)^.*?://[^/?#]*([^?#]*)"
#: A canonical link, either order of its attributes, and the target of a meta refresh.
CANONICAL_TAG = r"(?is)(<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>)"
REFRESH_TAG = r"(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>)"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"
BASE_TAG = r"(?is)(<base\b[^>]*\bhref\b[^>]*>)"
ENTITY = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
ABSOLUTE, SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://"), re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*:")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, decision string")


def url_parts(url):
    """Host (A-Z lower-cased) and path; both empty where the url is null or has no ``://``."""
    host = F.coalesce(F.translate(F.regexp_extract(url, HOST, 1), UPPER, LOWER), F.lit(""))
    return host, F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def url_node(url):
    """The name under which aliases meet: host, path and query, without scheme and fragment."""
    host, path = url_parts(url)
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return F.when(host == "", F.coalesce(url, F.lit(""))).otherwise(F.concat(host, path, query))


def unescaped(t: str) -> str:
    """The text with its HTML entities decoded once; names count with their semicolon only, as in attributes."""
    return ENTITY.sub(lambda m: html.unescape(m[0]) if m[0][1] == "#" else html5.get(m[0][1:], m[0]), t)


def resolved(base: str, t: str) -> str | None:
    """The absolute url that t names on a page of url base; None where there is none: t is empty, a fragment, of a scheme
    without host, or relative to a base that has no host."""
    if ABSOLUTE.match(t):
        return t
    if not t or t[0] == "#" or SCHEME.match(t) or not ABSOLUTE.match(base):
        return None
    try:
        return urljoin(base, t)
    except ValueError:  # a host that is none
        return None


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): the page's url and each url that its canonical links or redirects name, relative ones resolved."""
    pages = pages.select("url", "html").where("contains(url, '://') and html is not null")

    def run(batches):
        for batch in batches:
            url, tags, base, pattern = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("url", "tags", "base", "pattern"))
            out = []
            for u, ts, b, p in zip(url, tags, base, pattern):
                named = lambda tag, p: unescaped(m[1]) if (m := re.search(p, tag)) else ""
                at = resolved(u, named(b, HREF)) or u
                out += [(u, to) for t in ts if (to := resolved(at, named(t, p)))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(2)], names=["url", "to"])

    def edges(tag: str, word: str, target: str) -> DataFrame:
        found = pages.where(F.lower("html").contains(word))
        return found.select("url", F.regexp_extract_all("html", F.lit(tag), 1).alias("tags"), F.regexp_extract("html", BASE_TAG, 1).alias("base"), F.lit(target).alias("pattern"))

    found = edges(CANONICAL_TAG, "canonical", HREF).unionByName(edges(REFRESH_TAG, "http-equiv", REFRESH_URL))
    found = found.where("size(tags) > 0").mapInArrow(run, "url string, to string")
    return found.select(url_node(F.col("url")).alias("a"), url_node(F.col("to")).alias("b")).where("a <> b")


def match_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path, rule, decision for each distinct (host, path) that a rule fits: the longest rule, block before
    allow if a rule stands there twice.

    A rule fits its host and the subdomains, where the path starts with the rule's. The join is on
    host suffixes, so it stays an equi-join however many rules there are.
    """
    r = rules.where("host is not null and path is not null and decision is not null").select(
        F.col("host").alias("suffix"), F.col("path").alias("rule_path"), "decision"
    )
    labels = F.split("host", "\\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".")
    )
    keyed = places.where("host <> ''").select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("suffix"))
    fits = keyed.join(r, "suffix").where(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("suffix", "rule_path")
    best = F.max(F.struct(F.length(rule).alias("len"), (F.col("decision") == "block").alias("b"), rule.alias("rule"), "decision"))
    return fits.groupBy("host", "path").agg(best.alias("best")).select("host", "path", "best.rule", "best.decision")


def filter_urls(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, via for every page.

    ``via`` says where the verdict comes from: rule, alias (a rule on another url of the component) or none
    (allowed, as nothing blocks it). edges (a, b of url_node names) default to those read from the pages'
    html. Null or odd urls have no host, no rule and no alias, and are allowed; repeated pages get equal
    results; extra columns are ignored; an empty table gives no rows. Components with an allowing rule are
    allowed, else those with a blocking rule are blocked.
    """
    host, path = url_parts(F.col("url"))
    edges = alias_edges(pages) if edges is None else edges
    placed = pages.select("page_id", host.alias("host"), path.alias("path"), F.when(F.col("url").contains("://"), url_node(F.col("url"))).alias("node"))
    members = connected_components(edges, "a", "b")
    mhost, mpath = (F.regexp_extract("node", p, 1) for p in (r"(?s)^([^/?#]*)", r"(?s)^[^/?#]*([^?#]*)"))
    members = members.select("node", "component", mhost.alias("host"), mpath.alias("path"))
    ruled = match_rules(placed.select("host", "path").unionByName(members.select("host", "path")), rules)
    groups = members.join(ruled, ["host", "path"]).groupBy("component").agg(
        F.max(F.col("decision") == "allow").alias("allowed"), F.max(F.col("decision") == "block").alias("blocked")
    )
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    aliases = join_to_one(members, groups.join(sizes, "component"), ["component"], "n", members.count()).select(
        "node", F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block").alias("alias_decision")
    )
    out = placed.join(ruled, ["host", "path"], "left").join(aliases, "node", "left")
    return out.select(
        "page_id", "host", "path", "rule",
        F.coalesce("decision", "alias_decision", F.lit("allow")).alias("verdict"),
        F.when(F.col("rule").isNotNull(), "rule").when(F.col("alias_decision").isNotNull(), "alias").otherwise("none").alias("via"),
    )


ORACLE = r"""
with recursive parts as (
  select page_id, url, html,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path,
    coalesce(regexp_extract(url, '(?s)^[^?#]*(\?[^#]*)', 1), '') as query from pages),
placed as (select *, case when host = '' then coalesce(url, '') else host || path || query end as node from parts),
targets as (
  select node as a, regexp_extract(regexp_extract(html, '(?is)(<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>)', 1), '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) as t from placed
  union all
  select node, regexp_extract(regexp_extract(html, '(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>)', 1), '(?is)\burl\s*=\s*["'']?([^"''\s>]+)', 1) from placed),
edges0 as (
  select a, translate(regexp_extract(t, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || regexp_extract(t, '(?s)^.*?://[^/?#]*([^?#]*)', 1) || regexp_extract(t, '(?s)^[^?#]*(\?[^#]*)', 1) as b
  from targets where t like '%://%'),
edges as (select a, b from edges0 where a <> b union select b, a from edges0 where a <> b),
reach(node, other) as (select a, a from edges union select r.node, e.b from reach r join edges e on e.a = r.other),
rules(host, path, decision) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
places as (select host, path from placed union
  select regexp_extract(other, '(?s)^([^/?#]*)', 1), regexp_extract(other, '(?s)^[^/?#]*([^?#]*)', 1) from reach),
ruled as (
  select p.host, p.path, arg_max(r.host || r.path, length(r.host || r.path)) as rule, arg_max(r.decision, length(r.host || r.path)) as decision
  from places p join rules r on (p.host = r.host or p.host like '%.' || r.host) and starts_with(p.path, r.path) group by all),
aliases as (
  select node, case when max(decision = 'allow') then 'allow' else 'block' end as alias_decision
  from reach join ruled on ruled.host = regexp_extract(other, '(?s)^([^/?#]*)', 1) and ruled.path = regexp_extract(other, '(?s)^[^/?#]*([^?#]*)', 1) group by node)
select page_id, placed.host, placed.path, rule, coalesce(decision, alias_decision, 'allow') as verdict,
  case when rule is not null then 'rule' when alias_decision is not null then 'alias' else 'none' end as via
from placed left join ruled on placed.host = ruled.host and placed.path = ruled.path left join aliases on aliases.node = placed.node
"""
