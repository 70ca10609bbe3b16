"""URL filters with redirect equivalence, in DataFrame operations.

A rule names a host and the start of a path; it fits the host and its subdomains, and the longest fitting rule
decides. URLs joined by redirects and canonical links are aliases: connected components spread a block decision to
aliases without a rule of their own, unless an explicit allow stands in the same component.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeloom.llm.common import components
from treeloom.operators.checkpoints import checkpointed

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL = r"""(?i)<link\b(?=[^>]*\brel\s*=\s*["']?canonical\b)[^>]*\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?i)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*["']?refresh\b)[^>]*\bcontent\s*=\s*["']?\s*[\d.]*\s*[;,]\s*url\s*=\s*["']?([^"'\s>]+)"""


def rules(spark: SparkSession, block: list[tuple[str, str]], allow: list[tuple[str, str]]) -> DataFrame:
    rows = [(host, path, "block") for host, path in block] + [(host, path, "allow") for host, path in allow]
    return spark.createDataFrame(rows, "rule_host string, rule_path string, decision string")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical_url(url: Column) -> Column:
    """The name of a URL's node: without its fragment, scheme and host in lower case, a path of at least ``/``."""
    head = F.translate(F.regexp_extract(url, r"^[^:/?#]*://[^/?#]*", 0), UPPER, LOWER)
    rest = F.regexp_replace(F.regexp_replace(url, r"(?s)#.*$", ""), r"^[^:/?#]*://[^/?#]*", "")
    return F.concat(head, F.when((rest == "") & (head != ""), "/").otherwise(rest))


def resolved(base: Column, link: Column) -> Column:
    """``link`` as seen from ``base``: absolute, from the scheme, from the host, or from the folder."""
    scheme = F.regexp_extract(base, r"^[^:/?#]*(?=://)", 0)
    host = F.regexp_extract(base, r"^[^:/?#]*://[^/?#]*", 0)
    folder = F.regexp_extract(base, r"^[^:/?#]*://[^/?#]*(?:[^?#]*/)?", 0)
    folder = F.when(folder.endswith("/") & (folder != F.concat(scheme, F.lit("://"))), folder).otherwise(F.concat(host, F.lit("/")))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(host, link)).when(link.startswith("?"), F.concat(F.regexp_extract(base, r"^[^?#]*", 0), link))
        .otherwise(F.concat(folder, link))
    )


def links_in_pages(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``source`` and ``target`` URLs of the canonical links and refresh redirects that pages declare."""
    found = F.array(F.regexp_extract(html_col, CANONICAL, 1), F.regexp_extract(html_col, REFRESH, 1))
    some = F.contains(F.lower(html_col), F.lit("canonical")) | F.contains(F.lower(html_col), F.lit("http-equiv"))
    links = pages.where(F.col(url_col).isNotNull() & some).select(F.col(url_col).alias("source"), F.explode(found).alias("link")).where("link <> ''")
    return links.select("source", resolved(F.col("source"), F.regexp_replace("link", "&amp;", "&")).alias("target"))


def fitting_rule(urls: DataFrame, rule_list: DataFrame) -> DataFrame:
    """``urls`` (host, path: distinct) that some rule fits, with the longest: ``rule`` and ``decision``. Of equal rules
    that both block and allow, allow counts."""
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(labels, n, F.size(labels)), "."))
    spread = urls.where("host <> ''").withColumn("rule_host", F.explode(suffixes))
    fits = spread.join(rule_list, "rule_host").where(F.startswith("path", F.col("rule_path")))
    best = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"), F.length("rule_host"), (F.col("decision") == "allow").alias("allows"),
        F.concat("rule_host", "rule_path").alias("rule"), "decision",
    )
    return fits.groupBy("host", "path").agg(F.max(best).alias("best")).select("host", "path", "best.rule", "best.decision")


def judge(
    pages: DataFrame, rule_list: DataFrame, links: DataFrame, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """One row per row of ``pages``: ``page_id``, ``host``, ``path``, ``rule`` (null without one), ``verdict``, and
    ``aliases`` (other URLs of its component).

    ``rule_list`` has ``rule_host``, ``rule_path``, ``decision`` (block or allow); ``links`` has ``source`` and ``target`` URLs,
    redirects and canonical links alike. A URL with a rule gets its decision. Without one it is blocked if its
    component holds a blocked URL and no explicitly allowed one, else allowed. Links may name URLs without a page;
    rules count for those as well. Null links are ignored.

    A null URL, or one without ``://``, has an empty host and path and fits no rule. Ids may be null or repeat, pages may
    share a URL: each row is answered. Other columns are ignored. An empty table gives an empty result.
    """
    url = F.col(url_col)
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.coalesce(host_of(url), F.lit("")).alias("host"), F.coalesce(path_of(url), F.lit("")).alias("path"), canonical_url(url).alias("name"))
    links = checkpointed(links.select("source", "target").distinct())
    edges = links.select(canonical_url(F.col("source")).alias("source"), canonical_url(F.col("target")).alias("target")).where(
        "source is not null and target is not null and source <> target"
    ).distinct()
    edges = checkpointed(edges)
    names = edges.select(F.col("source").alias("name")).union(edges.select("target")).distinct()
    nodes = checkpointed(names.withColumn("node", F.monotonically_increasing_id()))  # numbers, fixed by the checkpoint
    numbered = edges.join(nodes.select(F.col("name").alias("source"), F.col("node").alias("a")), "source").join(
        nodes.select(F.col("name").alias("target"), F.col("node").alias("b")), "target"
    )
    grouped = nodes.join(components(numbered.select("a", "b")), "node").withColumn("host", host_of(F.col("name"))).withColumn("path", path_of(F.col("name")))

    places = own.select("host", "path").union(grouped.select("host", "path")).distinct()
    ruled = checkpointed(fitting_rule(places, rule_list))
    groups = grouped.join(ruled, ["host", "path"], "left").groupBy("root").agg(
        F.max(F.coalesce((F.col("decision") == "block"), F.lit(False))).alias("blocked"),
        F.max(F.coalesce((F.col("decision") == "allow"), F.lit(False))).alias("allowed"), (F.count(F.lit(1)) - 1).alias("aliases"),
    )
    spread = grouped.select("name", "root").join(groups, "root").drop("root")
    judged = own.join(ruled, ["host", "path"], "left").join(spread, "name", "left")
    method = F.when(F.coalesce(F.col("blocked") & ~F.col("allowed"), F.lit(False)), "block").otherwise("allow")
    return judged.select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("decision", method).alias("verdict"),
        F.coalesce("aliases", F.lit(0)).cast("long").alias("aliases"),
    )
