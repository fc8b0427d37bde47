"""Path-template tree for urls: variable segments become wildcards, similar branches merge, impure templates are rejected.

Built-in functions only. The tree is grown over distinct normalised paths with their counts, never over urls, so a
host with a third of all urls is one aggregated group; the urls meet it again in one equality join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_DEPTH = 6


def url_host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule (verdict, host, path) that fits, as struct<size, rule, verdict>; null if none fits.

    A rule fits its host and every subdomain of it when the path starts with the rule's path.
    """
    fits = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p),
               F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")))
        for verdict, h, p in rules
    ]
    if not fits:
        return F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    return F.array_max(F.array_compact(F.array(*fits)))


def normal_segment(segment: Column) -> Column:
    """Ids of a segment become wildcards at once: digit runs ``<n>``, long hexadecimal strings ``<x>``."""
    plain = F.regexp_replace(segment, r"(?i)(?<![0-9a-z])[0-9a-f]{16,}(?![0-9a-z])", "<x>")
    return F.regexp_replace(plain, r"[0-9]+", "<n>")


def normal_path(path: Column, depth: int = MAX_DEPTH) -> Column:
    """Non-empty segments, ids as wildcards; segments beyond ``depth`` become one tail ``**``."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    head = F.transform(F.slice(parts, 1, depth), normal_segment)
    return F.array_join(F.when(F.size(parts) > depth, F.concat(head, F.array(F.lit("**")))).otherwise(head), "/")


def grow_templates(paths: DataFrame, *, depth: int = MAX_DEPTH, min_share: float = 0.05, min_count: int = 2) -> DataFrame:
    """Template of each (host, npath) with its count ``n``: level by level, a segment that holds less than ``min_share`` of
    its parent's urls, or fewer than ``min_count``, joins its siblings in the wildcard ``*``."""
    out = paths.withColumn("_segs", F.split("npath", "/")).withColumn("template", F.lit(""))
    for level in range(depth + 1):
        seg = F.get("_segs", F.lit(level))
        parent, child = W.partitionBy("host", "template"), W.partitionBy("host", "template", "_seg")
        rare = (F.sum("n").over(child) < min_share * F.sum("n").over(parent)) | (F.sum("n").over(child) < min_count)
        held = F.when(F.col("_seg").isNull(), F.lit(None)).when(F.col("_seg").rlike("^(<n>|<x>|\\*\\*)"), F.col("_seg")).when(
            rare, F.lit("*")).otherwise(F.col("_seg"))
        out = out.withColumn("_seg", seg).withColumn("_held", held).withColumn(
            "template", F.when(F.col("_held").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "_held"))
        ).drop("_seg", "_held")
    return out.drop("_segs")


def template_purity(templates: DataFrame, *, z: float = 1.96, prior: float = 0.1, strength: float = 4.0) -> DataFrame:
    """Smoothed labelled purity of each (host, template) from ``bad`` and ``good`` counts.

    Branches of a host that differ in their first segment only form a family. A branch whose bad rate lies within ``z``
    standard errors of its family's rate (a branch without labels always does) is merged: the family's counts stand for it.
    """
    one = templates.groupBy("host", "template").agg(*(F.sum(c).alias(c) for c in ("n", "bad", "good"))).withColumn(
        "family", F.regexp_replace("template", r"^/[^/]*", "/*"))
    family = W.partitionBy("host", "family")
    all_bad, all_seen = F.sum("bad").over(family), F.sum(F.col("bad") + F.col("good")).over(family)
    seen = F.col("bad") + F.col("good")
    rate = F.when(F.col("_all_seen") > 0, F.col("_all_bad") / F.col("_all_seen")).otherwise(F.lit(0.0))
    error = F.sqrt(rate * (1 - rate) / F.greatest(seen, F.lit(1)))
    merged = (seen == 0) | (F.abs(F.col("bad") / F.greatest(seen, F.lit(1)) - rate) <= z * error)
    out = one.withColumn("_all_bad", all_bad).withColumn("_all_seen", all_seen).withColumn("merged", merged)
    bad = F.when(F.col("merged"), F.col("_all_bad")).otherwise(F.col("bad"))
    total = F.when(F.col("merged"), F.col("_all_seen")).otherwise(seen)
    return out.withColumn("purity", (bad + F.lit(prior * strength)) / (total + F.lit(strength))).select(
        "host", "template", "n", "bad", "good", "merged", "purity")


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], *, key: str = "page_id", url: str = "url",
               bad: Column | None = None, reject_from: float = 0.5, depth: int = MAX_DEPTH, min_share: float = 0.05,
               min_count: int = 2) -> DataFrame:
    """One row per url row: key, host, path, rule, verdict, template, purity.

    Labels of the tree are the rules' own verdicts, and ``bad`` (a boolean column, null where unlabelled) if given. The
    verdict is the rule's; without one, ``block`` if the purity of the template (share of bad labels, smoothed towards
    clean) reaches ``reject_from``, else ``allow``. Null urls and urls without ``://`` have empty host and path and are
    judged like others; repeated rows stay repeated; other columns are ignored; an empty table gives an empty result.
    """
    u, extra = F.col(f"`{url}`"), F.lit(None).cast("boolean") if bad is None else bad
    rows = pages.select(F.col(f"`{key}`").alias(key), url_host(u).alias("host"), url_path(u).alias("path"), extra.alias("_bad"))
    rows = rows.withColumn("_rule", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("npath", normal_path(F.col("path"), depth))
    label = F.coalesce(F.col("_bad"), F.col("_rule.verdict") == "block")
    paths = rows.groupBy("host", "npath").agg(
        F.count("*").alias("n"), F.count_if(label).alias("bad"), F.count_if(~label).alias("good"))
    grown = grow_templates(paths, depth=depth, min_share=min_share, min_count=min_count)
    judged = grown.select("host", "npath", "template").join(template_purity(grown).select("host", "template", "purity"), ["host", "template"])
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("purity") >= reject_from, "block").otherwise("allow"))
    return rows.join(judged, ["host", "npath"]).select(
        key, "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")
