"""Verdicts on urls by rules and by a tree of path templates per host.

Rules name a host and a path; the longest that fits decides. What no rule decides is
judged by its template: per host the segments of a path become literals or wildcards,
level by level, as deep as the paths of a place differ. A segment that varies (digits, or too few urls for its place) becomes a
wildcard, and so do branches whose labelled purity cannot be told from that of their place.
A template is rejected by its share of blocked urls among those that rules label,
smoothed by the share of the place above it.

The records of the library hold no urls: the operator works on any table with an id and a url.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.llm.common import is_empty, pick
from rankspark.session import cut


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    def __post_init__(self) -> None:
        if self.verdict not in ("allow", "block") or not self.host or not self.path.startswith("/"):
            raise ValueError(f"no rule: {self}")

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class TemplateConfig:
    """At least ``depth`` levels, more where paths go on; ``smoothing`` counts as that many labelled urls of the place above.

    The z-test judges every branch of ``least_urls`` urls, however large its place; in a small
    place ``least_share`` of its urls is enough.
    """

    depth: int = 3
    least_share: float = 0.02
    least_urls: int = 10
    smoothing: float = 4.0
    z: float = 2.0
    block_from: float = 0.5


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WILDCARD = "*"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host between the first ``://`` and the next of ``/ ? #``, A-Z in lower case; path from there to ``?`` or ``#``."""
    rest = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.coalesce(F.regexp_extract(url, rest, 1), F.lit("")), UPPER, LOWER)
    return host, F.coalesce(F.regexp_extract(url, rest, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null if none does."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        at_host = (host == r.host) | F.endswith(host, F.lit("." + r.host))
        fits = at_host & F.startswith(path, F.lit(r.path))
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def segments(path: Column) -> Column:
    """All segments of a path as an array; those with a digit are wildcards, empty ones at the end are left out."""
    parts = F.split(F.regexp_replace(F.regexp_replace(path, r"/+\z", ""), "^/", ""), "/")
    return F.transform(parts, lambda s: F.when(F.rlike(s, F.lit("[0-9]")), F.lit(WILDCARD)).otherwise(s))


def templates(paths: DataFrame, cfg: TemplateConfig) -> DataFrame:
    """Template and purity of every distinct generalised path.

    ``paths`` has ``host, parts, n, n_labelled, n_blocked``. Level by level, the children of
    a place are compared with the place as a whole, so the cost is one row per child. A place
    is finished when all its paths have ended or only one is left in it; the others go on.
    """
    sums = [F.sum(c).alias(c) for c in ("n", "n_labelled", "n_blocked")]
    share_blocked = (F.coalesce(F.sum("n_blocked"), F.lit(0)) + 1) / (F.coalesce(F.sum("n_labelled"), F.lit(0)) + 2)
    overall = paths.agg(share_blocked.alias("share")).first()["share"]  # one number
    smoothed = (F.col("n_blocked") + cfg.smoothing * F.col("above")) / (F.col("n_labelled") + cfg.smoothing)

    # a place is written as its host and a step per level; neither holds a slash
    now = paths.withColumns({"above": F.lit(float(overall)), "place": F.col("host")})
    known: DataFrame | None = None
    k = 0
    while True:
        whole = (
            now.groupBy("place")
            .agg(*sums, F.min("above").alias("above"))
            .select(
                "place",
                F.col("n").alias("n_place"),
                F.nullif("n_labelled", F.lit(0)).alias("l_place"),
                F.col("n_blocked").alias("b_place"),
                smoothed.alias("purity"),
            )
        )
        now = now.withColumn("segment", F.coalesce(F.get("parts", F.lit(k)), F.lit("")))
        child = now.groupBy("place", "segment").agg(*sums).join(whole, "place")
        labelled, p = F.nullif("n_labelled", F.lit(0)), F.col("b_place") / F.col("l_place")
        differs = F.abs(F.col("n_blocked") / labelled - p) > cfg.z * F.sqrt(p * (1 - p) / labelled)
        large = F.col("n") >= F.least(F.lit(cfg.least_urls), cfg.least_share * F.col("n_place"))
        literal = (F.col("segment") != WILDCARD) & large & F.coalesce(differs, F.lit(False))
        step = F.when(F.col("segment") == "", "").when(literal, F.col("segment")).otherwise(WILDCARD)
        decided = child.select("place", "segment", step.alias("step"), F.col("purity").alias("above"))
        now = now.drop("above").join(decided, ["place", "segment"]).withColumn("place", F.concat_ws("/", "place", "step"))
        now = cut(now.drop("segment", "step"))
        k += 1
        if k < cfg.depth:
            continue
        goes_on = (F.max(F.size("parts")) > k) & (F.count(F.lit(1)) > 1)
        places = now.groupBy("place").agg(*sums, F.min("above").alias("above"), goes_on.alias("goes_on"))
        places = cut(places.select("place", smoothed.alias("purity"), "goes_on"))
        rest = F.slice("parts", F.lit(k + 1), F.greatest(F.size("parts") - k, F.lit(0)))
        rest = F.array_join(F.transform(rest, lambda s: F.when(s == "", "").otherwise("/" + WILDCARD)), "")
        template = F.concat(F.regexp_replace(F.regexp_replace("place", "/+", "/"), r"/\z", ""), rest)
        ended = now.join(places.where("not goes_on"), "place").select("host", "parts", template.alias("template"), "purity")
        known = ended if known is None else known.unionByName(ended)
        if is_empty(places.where("goes_on")):
            return known
        now = cut(now.join(places.where("goes_on"), "place", "left_semi"))


def judge_urls(
    urls: DataFrame, rules: Sequence[Rule], cfg: TemplateConfig = TemplateConfig(), key: str = "page_id", url: str = "url"
) -> DataFrame:
    """``key, host, path, rule, verdict, template, purity`` for every row.

    ``verdict`` is that of the rule, or else block where the template's purity (its smoothed
    share of blocked urls) reaches ``block_from``. Paths are read whole, however deep. A null url and one without ``://`` have an
    empty host and path and share one template. Repeated rows give repeated results; an
    empty table gives an empty result; other columns are not read.
    """
    rows = pick(urls, **{"key_": key, "url_": url})
    host, path = host_and_path(F.col("url_"))
    rows = rows.select("key_", host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("key_", "host", "path", rule.alias("rule"), verdict.alias("by_rule"))
    rows = rows.withColumn("parts", segments(F.col("path")))
    paths = rows.groupBy("host", "parts").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("by_rule").alias("n_labelled"),
        F.count_if(F.col("by_rule") == "block").alias("n_blocked"),
    )
    known = templates(cut(paths), cfg)
    by_method = F.when(F.col("purity") >= cfg.block_from, "block").otherwise("allow")
    return rows.join(known, ["host", "parts"]).select(
        F.col("key_").alias(key),
        "host",
        "path",
        "rule",
        F.coalesce("by_rule", by_method).alias("verdict"),
        "template",
        "purity",
    )
