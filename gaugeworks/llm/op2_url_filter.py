"""URL filters with redirect equivalence.

A rule is an action, a host and a path; it fits a url whose host is the rule's
or one of its subdomains and whose path starts with the rule's. Of the rules
that fit, the longest wins (host and path together).

A url without a rule of its own takes the decision of its equivalence class.
Classes are the connected components over redirect edges (``meta`` refresh) and
canonical links of the pages, all of a page's, resolved against its ``base``.
Pages that mention either are read tag by tag, by the names of attributes. Urls that differ only in
scheme, in the case of their host, in dot segments of their path, or in their
fragment are one address. A class with an explicitly
allowed address allows its unjudged members, whatever else it holds; else a
class with a blocked address blocks them; else they are allowed. An address's
own rule always stands.

Defined results: a null url, and one without ``://``, has empty host and path,
fits no rule, and is allowed; null html has no edges; repeated pages are judged
each; links without a target add nothing; very long pages are read whole; other columns are ignored; an empty
table gives an empty table. Only addresses and edges are shuffled, never html;
a class's decision is a grouped maximum, so one host or class may hold any
share of the pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeworks.llm.components import components
from gaugeworks.llm.runtime import bound_batches, materialise, table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rules(text: str) -> list[Rule]:
    """Rules from lines ``allow host/path`` or ``block host/path``."""
    out = []
    for line in text.strip().splitlines():
        action, _, place = line.strip().partition(" ")
        host, slash, path = place.partition("/")
        if action not in ("allow", "block") or not host:
            raise ValueError(f"not a rule: {line!r}")
        out.append(Rule(action, host.lower(), slash + path))
    return out


RULES = rules(
    """
    allow org/
    block example.org/es/
    block example.org/en/1
    allow com/fr/
    block com/de/
    """
)


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def folded(path: Column) -> Column:
    """The path without ``.`` and ``..`` segments; one above the root stays at the root."""
    parts = F.split(path, "/")
    none = F.array().cast("array<string>")
    step = lambda acc, p: F.when(p == ".", acc).when(p == "..", F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1))).otherwise(F.array_append(acc, p))
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), none, step)
    kept = F.when(F.element_at(parts, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    return F.when(path.contains("/."), F.concat(F.lit("/"), F.array_join(kept, "/"))).otherwise(path)


def address_of(url: Column) -> Column:
    """What equivalent urls share: host, folded path and query, without scheme and fragment; null without ``://``."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))
    return F.when(F.instr(url, "://") > 0, F.concat(host_of(url), folded(path_of(url)), query))


def winner(host: Column, path: Column, given: list[Rule]) -> tuple[Column, Column]:
    """The winning rule's name and action, null where none fits; longer rules are asked first."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(given, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, action = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.action)).otherwise(action)
    return name, action


def absolute(link: Column, url: Column) -> Column:
    """A link's absolute url, as seen from the page's url."""
    base = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_replace(path_of(url), r"[^/]*$", "")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)^(.*?:)//", 1), link))
        .when(link.startswith("/"), F.concat(base, link))
        .when(link.startswith("#"), url)
        .when(link.startswith("?"), F.concat(base, path_of(url), link))
        .when(F.length(link) > 0, F.concat(base, F.when(folder == "", F.lit("/")).otherwise(folder), link))
    )


_REFRESH = re.compile(r"""\s*[0-9.]+(?:\s*[;,]\s*|\s+)(?:url\s*=\s*)?(?:"([^"]*)|'([^']*)|([^"'\s].*))""", re.IGNORECASE | re.DOTALL)


class _Links(HTMLParser):
    """The first base, canonical links and refreshes of a page, by its tags' attributes.

    Comments, scripts and styles are no tags; of attributes with one name the first counts; character
    references are read once.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.base: str | None = None
        self.found: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in ("link", "meta", "base"):
            return
        have: dict[str, str] = {}
        for name, value in attrs:
            have.setdefault(name, value or "")
        if tag == "base" and self.base is None and "href" in have:
            self.base = have["href"]
        elif tag == "link" and "canonical" in have.get("rel", "").lower().split():
            self.found.append(have.get("href", ""))
        elif tag == "meta" and have.get("http-equiv", "").strip().lower() == "refresh" and (m := _REFRESH.match(have.get("content", ""))):
            self.found.append(next(g for g in m.groups() if g is not None))

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """In HTML a marked section of whatever name is a comment up to the next angle bracket."""
        return self.parse_bogus_comment(i, report)


def links_of(html: str) -> tuple[str | None, list[str]]:
    """The base, if any, and the addresses that a page names as its own, white space around them gone."""
    parser = _Links()
    parser.feed(html)
    parser.close()
    clean = [re.sub(r"[\t\r\n]", "", x).strip() for x in (parser.base or "", *parser.found)]
    return clean[0] or None, [x for x in clean[1:] if x]


def alias_edges(pages: DataFrame) -> DataFrame:
    """(u, v): addresses that a canonical link or a refresh makes equivalent."""
    bound_batches(pages.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages_of = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            got = [(url, base, link) for url, html in pages_of for base, links in [links_of(html)] for link in links]
            columns = zip(*got, strict=True) if got else ((), (), ())
            yield pa.record_batch([pa.array(c, pa.string()) for c in columns], ["url", "base", "link"])

    html = F.lower(F.col("html"))
    likely = html.contains("canonical") | html.contains("refresh")
    links = pages.where(likely & F.col("url").contains("://")).select("url", "html").mapInArrow(read, "url string, base string, link string")
    links = links.withColumn("base", F.coalesce(absolute(F.col("base"), F.col("url")), F.col("url")))
    edges = links.select(address_of(F.col("url")).alias("u"), address_of(absolute(F.col("link"), F.col("base"))).alias("v"))
    return edges.where("u is not null and v is not null and u != v").distinct()


def filter_urls(pages: DataFrame, given: list[Rule]) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of ``pages``."""
    url = F.col("url")
    host, path = host_of(url), path_of(url)
    name, action = winner(F.col("host"), F.col("path"), given)
    judged = pages.select("page_id", host.alias("host"), path.alias("path"), address_of(url).alias("address"))
    judged = judged.withColumn("rule", name).withColumn("action", action)
    edges = materialise(alias_edges(pages.select("url", "html")))
    if not edges.head(1):
        # Addresses alone: each row stands by its own host and path.
        return judged.select("page_id", "host", "path", "rule", F.coalesce("action", F.lit("allow")).alias("verdict"))
    label = materialise(components(edges))
    # An address starts with its host; put a scheme before it to read its parts again.
    node = label.withColumn("full", F.concat(F.lit("x://"), "node"))
    node_name, node_action = winner(F.col("host"), F.col("path"), given)
    node = node.select("node", "label", host_of(F.col("full")).alias("host"), path_of(F.col("full")).alias("path")).withColumn("action", node_action)
    decision = node.groupBy("label").agg(
        F.coalesce(F.bool_or(F.col("action") == "allow"), F.lit(False)).alias("allows"),
        F.coalesce(F.bool_or(F.col("action") == "block"), F.lit(False)).alias("blocks"),
    )
    inherited = F.when(F.col("blocks") & ~F.col("allows"), "block").otherwise("allow")
    taken = materialise(label.join(decision, "label").select(F.col("node").alias("address"), inherited.alias("inherited")))
    out = judged.join(taken, "address", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("action", "inherited", F.lit("allow")).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), RULES)


ORACLE = """
WITH RECURSIVE
rules(rule, rhost, rpath, action) AS (VALUES
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
p AS (
  SELECT page_id, url, html,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*(\\?[^#]*)', 1), '') AS query
  FROM pages),
a AS (SELECT *, CASE WHEN contains(url, '://') THEN host || path || query END AS address FROM p),
shown AS (
  SELECT url, address, regexp_replace(html, '(?is)<!--.*?(?:-->|\\z)|<script\\b.*?(?:</script\\s*>|\\z)|<style\\b.*?(?:</style\\s*>|\\z)', ' ', 'g') AS html
  FROM a WHERE address IS NOT NULL AND (html ILIKE '%canonical%' OR html ILIKE '%refresh%')),
tag AS (SELECT url, address, unnest(regexp_extract_all(html, '(?is)<(?:link|meta|base)[\\s/](?:[^>"'']|"[^"]*"|''[^'']*'')*>')) AS t FROM shown),
attribute AS (
  SELECT url, address, lower(regexp_extract(t, '<([A-Za-z]+)', 1)) AS tag,
    list_transform(regexp_extract_all(t, '(?s)[\\s/"'']([^\\s"''>/=]+)\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)', 1), lambda x: lower(x)) AS names,
    list_transform(regexp_extract_all(t, '(?s)[\\s/"'']([^\\s"''>/=]+)\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s"''>]+)', 2),
      lambda x: replace(CASE WHEN x[1] IN ('"', '''') THEN x[2:-2] ELSE x END, '&amp;', '&')) AS vals
  FROM tag),
had AS (
  SELECT url, address, tag, trim(vals[list_position(names, 'href')], E' \\t\\r\\n') AS href, string_split_regex(lower(vals[list_position(names, 'rel')]), '\\s+') AS rel,
    lower(trim(vals[list_position(names, 'http-equiv')])) AS equiv, vals[list_position(names, 'content')] AS content
  FROM attribute),
based AS (SELECT url, any_value(href) AS base FROM had WHERE tag = 'base' GROUP BY 1),
link AS (
  SELECT coalesce(CASE WHEN contains(base, '://') THEN base WHEN starts_with(base, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || base END, url) AS url, address, l
  FROM (
    SELECT url, address, href AS l FROM had WHERE tag = 'link' AND list_contains(rel, 'canonical')
    UNION ALL SELECT url, address, trim(regexp_extract(content, '(?is)^\\s*[0-9.]+(?:\\s*[;,]\\s*|\\s+)(?:url\\s*=\\s*)?["'']?([^"'']*)', 1)) FROM had WHERE tag = 'meta' AND equiv = 'refresh') x
  LEFT JOIN based USING (url)),
target AS (
  SELECT address AS u, CASE
    WHEN regexp_matches(l, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN l
    WHEN starts_with(l, '//') THEN 'x:' || l
    WHEN starts_with(l, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || l
    ELSE regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || coalesce(nullif(regexp_replace(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '[^/]*$', ''), ''), '/') || l END AS t
  FROM link WHERE l <> ''),
edge AS (
  SELECT u, translate(regexp_extract(t, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract(t, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS v
  FROM target WHERE u IS NOT NULL),
two AS (SELECT u, v FROM edge WHERE u <> v UNION SELECT v, u FROM edge WHERE u <> v),
reach(s, n) AS (SELECT u, u FROM two UNION SELECT s, v FROM reach JOIN two ON n = u),
ruled AS (
  SELECT n, action FROM (
    SELECT DISTINCT n, split_part(split_part(n, '?', 1), '/', 1) AS h, regexp_extract(n, '^[^/?]*([^?]*)', 1) AS q FROM reach) x
  JOIN rules ON (h = rhost OR ends_with(h, '.' || rhost)) AND starts_with(q, rpath)
  QUALIFY row_number() OVER (PARTITION BY n ORDER BY length(rule) DESC) = 1),
class AS (SELECT s, bool_or(action = 'allow') AS allows, bool_or(action = 'block') AS blocks FROM reach LEFT JOIN ruled USING (n) GROUP BY s),
own AS (
  SELECT page_id, host, path, address, rule, action FROM (SELECT *, row_number() OVER () AS k FROM a) b
  LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  QUALIFY row_number() OVER (PARTITION BY k ORDER BY length(rule) DESC NULLS LAST) = 1)
SELECT page_id, host, path, rule,
  coalesce(action, CASE WHEN blocks AND NOT coalesce(allows, false) THEN 'block' END, 'allow') AS verdict
FROM own LEFT JOIN class ON address = s
"""
