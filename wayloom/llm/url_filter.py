"""URL filters by a tree of path templates.

Rules (host suffix and path prefix, longest first) judge what they fit and label it. The rest is judged by templates. Level
by level, each host's path segments under one template node are counted with their labels. Branches with least labelled
pages or more are binned by their share of blocked ones; neighbouring bins of a node are merged unless a two-proportion z
test tells them apart. Where a node keeps several clusters, a cluster of one branch stays literal and a cluster of several
similar branches becomes *0, *1, ... by rising share; all other segments, and all segments of a node with one cluster,
are generalised to *. The last level takes all that is left of a path as one segment, so no part of a path is ignored.

A template's share is smoothed towards its parent's, that towards its parent's, up to the host, its domain (the last two
labels) and the corpus; a template whose smoothed share is min_purity or more is rejected. A branch without labels so
inherits what its host shows; a domain without labels counts as clean.

All counts are groupBys over (host, template, segment); windows run over one node's bins, of which there are BINS + 1 at
most; pages join lists of branches, steps and hosts with a salt, so a hot host or segment is dealt over SALTS tasks.

Defined results: null urls and urls without :// have empty host and path, fit no rule and are allowed; empty segments are skipped; repeated rows count each time; an empty table gives an
empty table; urls of any length are read whole; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayloom.llm.common import materialize, unwritten

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BINS, SALTS = 32, 16


def host_of(url):
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url):
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host, path, rules: list[tuple[str, str]]):
    """Column: the longest rule (its text) that fits; rules are (verdict, text) of a configuration, not of the data."""
    out = F.lit(None).cast("string")
    for _, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(text)).otherwise(out)
    return out


def _salted(table: DataFrame) -> DataFrame:
    return table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def _counts(*keys: str):
    return lambda df: df.groupBy(*keys).agg(F.sum("k").alias("k"), F.sum("b").alias("b"))


def _smoothed(b, k, parent, smoothing: float):
    return (b + smoothing * parent) / (k + smoothing)


def host_scores(p: DataFrame, smoothing: float) -> DataFrame:
    """host, k, b, score: labelled and blocked pages, and the share smoothed towards domain and corpus."""
    hosts = _counts("host")(p).withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1))
    domains = _counts("domain")(hosts).withColumnsRenamed({"k": "dk", "b": "db"})
    corpus = hosts.agg(F.coalesce(F.try_divide(F.sum("b"), F.sum("k")), F.lit(0.0)).alias("share"))  # one row
    above = F.when(F.col("dk") > 0, _smoothed(F.col("db"), F.col("dk"), F.col("share"), smoothing)).otherwise(0.0)
    domains = domains.crossJoin(F.broadcast(corpus)).select("domain", above.alias("above"))
    return hosts.join(domains, "domain").select("host", "k", "b", _smoothed(F.col("b"), F.col("k"), F.col("above"), smoothing).alias("score"))


def branches(nodes: DataFrame, least: int, z: float) -> DataFrame:
    """host, template, segment, step of the segments (k labelled pages, b blocked) that stay apart from *."""
    node = ["host", "template"]
    told = nodes.where(F.col("k") >= least).withColumn("bin", F.floor(BINS * F.col("b") / F.col("k")).cast("int"))
    bins = told.groupBy(*node, "bin").agg(F.sum("k").alias("k"), F.sum("b").alias("b"), F.count("*").alias("many"))
    by_share, whole = Window.partitionBy(*node).orderBy("bin"), Window.partitionBy(*node)
    k0, b0 = F.lag("k").over(by_share), F.lag("b").over(by_share)
    pool = (F.col("b") + b0) / (F.col("k") + k0)
    apart = F.col("b") / F.col("k") - b0 / k0 > z * F.sqrt(pool * (1 - pool) * (1 / F.col("k") + 1 / k0))
    bins = bins.withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("cluster", F.sum("apart").over(by_share.rowsBetween(Window.unboundedPreceding, 0)))
    bins = bins.withColumn("clusters", F.max("cluster").over(whole)).withColumn("many", F.sum("many").over(Window.partitionBy(*node, "cluster"))).where("clusters > 0")
    step = F.when(F.col("many") == 1, F.col("segment")).otherwise(F.concat(F.lit("*"), F.col("cluster").cast("string")))
    return told.select(*node, "bin", "segment").join(bins.select(*node, "bin", "cluster", "many"), [*node, "bin"]).select(*node, "segment", step.alias("step"))


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str]], depth: int = 4, least: int = 5, z: float = 2.58, smoothing: float = 4.0, min_purity: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, template, template_labelled, template_blocked, template_score for every page."""
    verdict_of = F.create_map(*[F.lit(x) for v, t in rules for x in (t, v)]) if rules else None
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    p = pages.select(F.col("page_id"), host.alias("host"), path.alias("path")).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    label = F.try_element_at(verdict_of, F.col("rule")) if rules else F.lit(None).cast("string")
    p = p.withColumn("label", label).withColumns({"k": F.col("label").isNotNull().cast("long"), "b": F.coalesce(F.col("label") == "block", F.lit(False)).cast("long")})
    p = materialize(p.withColumns({"segments": F.filter(F.split("path", "/"), lambda s: s != ""), "salt": F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"), "template": F.lit("")}), "urls")
    known = ["page_id", "host", "path", "rule", "label", "k", "b", "segments", "salt"]
    hosts = materialize(host_scores(p, smoothing), "hosts").withColumnsRenamed({"k": "labelled", "b": "blocked"})
    p, done, used = p.join(_salted(hosts), ["host", "salt"]).select(*known, "template", "labelled", "blocked", "score"), [], []
    for d in range(depth):
        rest = F.size("segments") > d
        segment = F.get("segments", F.lit(d)) if d < depth - 1 else F.array_join(F.slice("segments", depth, F.greatest(F.size("segments"), F.lit(1))), "/")
        if d:
            done.append(p.where(~rest))
        p = p.withColumn("segment", F.when(rest, segment)) if d == 0 else p.where(rest).withColumn("segment", segment)
        nodes = materialize(_counts("host", "template", "segment")(p.where("segment is not null")), "nodes")
        kept = materialize(branches(nodes, least, z), "branches")
        steps = _counts("host", "template", "step")(nodes.join(kept, ["host", "template", "segment"], "left").withColumn("step", F.coalesce("step", F.lit("*"))))
        steps = materialize(steps.withColumnsRenamed({"k": "sk", "b": "sb"}), "steps")
        moved = p.join(_salted(kept), ["host", "template", "segment", "salt"], "left").withColumn("step", F.when(F.col("segment").isNotNull(), F.coalesce("step", F.lit("*"))))
        moved = moved.join(_salted(steps), ["host", "template", "step", "salt"], "left")
        go = F.col("step").isNotNull()
        p = moved.select(
            *known, F.when(go, F.concat("template", F.lit("/"), "step")).otherwise(F.col("template")).alias("template"), F.when(go, F.col("sk")).otherwise(F.col("labelled")).alias("labelled"),
            F.when(go, F.col("sb")).otherwise(F.col("blocked")).alias("blocked"), F.when(go, _smoothed(F.col("sb"), F.col("sk"), F.col("score"), smoothing)).otherwise(F.col("score")).alias("score"),
        )
        p = materialize(p, "templates")
        used += [nodes, kept, steps]
    for part in done:
        p = p.unionByName(part)
    unwritten(*used)
    verdict = F.when(F.col("label").isNotNull(), F.col("label")).when(F.col("score") >= min_purity, "block").otherwise("allow")
    return p.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", F.col("labelled").alias("template_labelled"), F.col("blocked").alias("template_blocked"), F.col("score").alias("template_score"))
