"""URL filters: listed rules, and a tree of path templates with labelled purity.

Every host has a tree of path segments. Going down level by level,

* a segment that is rare among many siblings is variable and becomes ``*``, unless its
  labels differ from its siblings' beyond chance (a likelihood ratio that allows for the
  number of siblings, as most rare segments have few labels);
* a sibling whose labels and whose continuations do not differ from those of its
  siblings together (a two-sided test of the bad rate, and the Hellinger distance of
  the shapes of what follows) is merged into ``*`` too;
* other segments stay as they are.

A template's purity is the bad part of its labelled pages, shrunk to its host's, which is
shrunk to that of all pages. Templates above ``reject`` are blocked.

All of it is aggregation by (host, template, segment): a host with a third of all pages is
summed map-side, and no branch is compared with each other branch, only with the pool. Where rows
meet their node's sums they are written before they are summed again, so that Spark can split the join of a hot host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import fresh_names, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WILD, STOP = "*", ""


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters lower-cased) and path of a URL; empty for null and for a URL without ``://``."""
    form = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, form, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def listed(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule ``host/path`` that fits the host or a subdomain and begins the path, and its verdict; null if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: len(r[1])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _shape(segment: Column) -> Column:
    """What kind of segment: its digits, letters and other characters as runs."""
    short = F.regexp_replace(F.regexp_replace(segment, r"\p{N}+", "0"), r"\p{L}+", "a")
    return F.substring(short, 1, 8)


def _log_likelihood(bad: Column | str, seen: Column | str) -> Column:
    """Of ``bad`` among ``seen`` labels, at their own rate."""
    bad, seen = (F.col(c) if isinstance(c, str) else c for c in (bad, seen))
    part = lambda k: F.when(k > 0, k * F.log(k / seen)).otherwise(F.lit(0.0))
    return part(bad) + part(seen - bad)


def templates(urls: DataFrame, many: int = 8, rare: float = 0.05, similar: float = 0.2, z: float = 2.58) -> DataFrame:
    """(host, path, bad) to (host, path, template), one row for each different host and path.

    ``bad`` is 1, 0 or null for unlabelled. A segment is variable if its node has more
    than ``many`` different segments, it holds less than the part ``rare`` of the node's
    pages and its labels do not tell it apart. There is one round for each level until
    every path has ended or is alone under its template.
    """
    segments = F.filter(F.split("path", "/"), lambda s: s != "")
    rows = urls.groupBy("host", "path").agg(F.count("*").alias("n"), F.count("bad").alias("seen"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    rows = written(rows.withColumn("segments", segments).withColumn("template", F.lit("")), "url-paths")
    columns = ["host", "path", "template", "n", "seen", "bad"]
    done, level = rows.where(F.size("segments") == 0).select(columns), 0
    rows = rows.where(F.size("segments") > 0)
    while not rows.isEmpty():
        here = F.coalesce(F.get("segments", F.lit(level)), F.lit(STOP))
        then = _shape(F.coalesce(F.get("segments", F.lit(level + 1)), F.lit(STOP)))
        rows = rows.withColumns({"segment": here, "next": then})
        shapes = written(rows.groupBy("host", "template", "segment", "next").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"), F.sum("bad").alias("bad"), F.count("*").alias("paths")), "url-branches")
        branch = shapes.groupBy("host", "template", "segment").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen"), F.sum("bad").alias("bad"), F.sum("paths").alias("paths"))
        branch = written(branch, "url-segments")
        node = branch.where(F.col("segment") != STOP).groupBy("host", "template").agg(F.count("*").alias("children"), F.sum("n").alias("all_n"), F.sum("seen").alias("all_seen"), F.sum("bad").alias("all_bad"))
        node = written(node, "url-nodes")
        pool = shapes.where(F.col("segment") != STOP).groupBy("host", "template", "next").agg(F.sum("n").alias("pool_n"))
        # Bhattacharyya coefficient of the branch's continuations and the pool's
        kinds = written(pool.join(node.select("host", "template", "all_n"), ["host", "template"]), "url-kinds")
        joined = written(shapes.join(kinds, ["host", "template", "next"]), "url-shapes")
        alike = joined.groupBy("host", "template", "segment").agg(F.sum(F.sqrt(F.col("n") * F.col("pool_n") / F.col("all_n"))).alias("common"))
        judged = branch.where(F.col("segment") != STOP).join(node, ["host", "template"]).join(alike, ["host", "template", "segment"])
        distance = F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("common") / F.sqrt("n")))
        others, other_bad = F.col("all_seen") - F.col("seen"), F.col("all_bad") - F.col("bad")
        pooled = F.when(F.col("all_seen") > 0, F.col("all_bad") / F.col("all_seen")).otherwise(F.lit(0.0))
        noise = F.sqrt(pooled * (1 - pooled) * (F.when(F.col("seen") > 0, 1 / F.col("seen")).otherwise(0.0) + F.when(others > 0, 1 / others).otherwise(0.0)))
        gap = F.when((F.col("seen") > 0) & (others > 0), F.abs(F.col("bad") / F.col("seen") - other_bad / others)).otherwise(F.lit(0.0))
        evidence = _log_likelihood("bad", "seen") + _log_likelihood(other_bad, others) - _log_likelihood("all_bad", "all_seen")
        telling = (others > 0) & (evidence > z * z / 2 + F.log("children"))
        variable = (F.col("children") > many) & (F.col("n") < rare * F.col("all_n")) & ~telling
        merged = (F.col("children") > 1) & (distance <= similar) & (gap <= z * noise)
        wild = variable | merged
        named = judged.select("host", "template", "segment", F.when(wild, WILD).otherwise(F.col("segment")).alias("name"), (~wild & (F.col("paths") == 1)).alias("alone"))
        rows = rows.join(named, ["host", "template", "segment"])
        # the rest of a path that is alone under its template has no siblings: it stays as it is
        rest = F.when(F.col("alone"), F.slice("segments", level + 2, F.size("segments"))).otherwise(F.array().cast("array<string>"))
        grown = F.concat("template", F.lit("/"), F.array_join(F.concat(F.array("name"), rest), "/"))
        ended = F.col("alone") | (F.size("segments") == level + 1)
        rows = written(rows.withColumns({"grown": grown, "ended": ended}).select("host", "path", "n", "seen", "bad", "segments", F.col("grown").alias("template"), "ended"), "url-templates")
        done = done.union(rows.where("ended").select(columns))
        rows, level = rows.where("NOT ended").drop("ended"), level + 1
    return done


def url_filter(
    pages: DataFrame,
    labels: DataFrame,
    rules: list[tuple[str, str]],
    url_col: str = "url",
    smoothing: float = 4.0,
    reject: float = 0.5,
    **tree,
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``template``, ``bad_part``, ``rule`` and ``verdict`` (allow or block).

    ``labels`` is (url, bad) with bad 1 or 0; null labels do not count, repeated ones all
    do. ``rules`` are ("allow" or "block", "host/path"); the longest that fits decides, ties
    by their order. Where none fits the template does. A null URL, or one without
    ``://``, has an empty host and path and is judged as such. Without labels nothing but
    listed URLs is blocked. Names that are taken get a leading underscore.
    """
    host, path, template, part, rule, verdict = fresh_names(pages, "host", "path", "template", "bad_part", "rule", "verdict")
    own_host, own_path = host_and_path(F.col(url_col).cast("string"))
    parsed = pages.withColumns({host: own_host, path: own_path})
    label_host, label_path = host_and_path(F.col("url").cast("string"))
    known = labels.where("bad IS NOT NULL").select(label_host.alias("host"), label_path.alias("path"), F.col("bad").cast("long").alias("bad"))
    urls = parsed.select(F.col(host).alias("host"), F.col(path).alias("path"), F.lit(None).cast("long").alias("bad")).union(known)
    tree_rows = templates(urls, **tree)
    by_template = tree_rows.groupBy("host", "template").agg(F.sum("seen").alias("seen"), F.sum("bad").alias("bad"))
    by_host = by_template.groupBy("host").agg(F.sum("seen").alias("host_seen"), F.sum("bad").alias("host_bad"))
    total = by_host.agg(F.coalesce(F.sum("host_seen"), F.lit(0)).alias("s"), F.coalesce(F.sum("host_bad"), F.lit(0)).alias("b")).first()
    prior = total.b / total.s if total.s else 0.0
    host_part = (F.col("host_bad") + smoothing * prior) / (F.col("host_seen") + smoothing)
    purity = by_template.join(by_host, "host").select("host", "template", ((F.col("bad") + smoothing * host_part) / (F.col("seen") + smoothing)).alias("part"))
    judged = tree_rows.join(purity, ["host", "template"]).select(F.col("host").alias(host), F.col("path").alias(path), F.col("template").alias(template), F.col("part").alias(part))
    found, what = listed(F.col(host), F.col(path), rules)
    by_tree = F.when(F.col(part) >= reject, "block").otherwise("allow")
    return parsed.join(judged, [host, path]).withColumns({rule: found, verdict: F.coalesce(what, by_tree)}).select(*pages.columns, host, path, template, part, rule, verdict)
