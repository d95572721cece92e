"""URL filter: explicit rules first, then a tree of path templates judged by labelled purity.

A rule names a host suffix and a path prefix and allows or blocks what it fits; the longest fitting rule
wins. URLs that a rule decides are the labelled examples for the rest. Per host, path segments form a tree,
built level by level from counts alone:

1. numbers, hexadecimal strings and other machine-made segments become ``{num}``, ``{hex}``, ``{id}``;
2. where a node has more than ``fanout`` literal children, those no commoner than an even share become ``{var}``;
3. of the other literal children, those without labels become ``{new}``; those whose share of blocked labels
   is statistically like that of their siblings (two-proportion z of at most 2) merge into ``{any}``; the
   rest keep their name.

A template is rejected when it has at least ``min_labels`` labels and its share of blocked ones, smoothed by
``prior_weight`` labels at the overall share, is at least ``reject``; everything else is allowed. The
first ``depth`` levels add a token to every path. Below them a node grows only while it holds different paths: what
its paths still have in common is passed over, and the next segment splits it, down to the deepest path. A level reads and
writes only the paths that are still open.

Everything is built from DataFrame functions. URLs are counted per host and generalised path before anything
is shuffled, so one host with a third of all rows is some rows of counts. Verdicts come back by host and path; a path
that very many rows share is dealt to several tasks.

Defined cases: a null URL or one without ``://`` has empty host and path, fits no rule and is judged like any
other; repeated rows count each; other columns are not read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, UPPER, new_path, with_groups, written

HOST, PATH = r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)"
#: Machine-made segments, first match wins; an extension such as .html is kept apart from the number before it.
KINDS = ((r"^[0-9]+$", "{num}"), (r"^[0-9]+\.[A-Za-z]{1,5}$", "{num}.{ext}"), (r"^[0-9a-f]{8,}$", "{hex}"), (r"^[0-9A-Za-z_-]*[0-9][0-9A-Za-z_-]*$", "{id}"))


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(rule, action) of the longest rule that fits, else null; of equally long ones the blocking one.
    rules: (action, host, path prefix), a short configured list."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1], r[2]))
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    cases = [(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))) for action, h, p in ranked]
    return reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(cases), F.lit(None).cast("struct<rule:string,action:string>"))


def _kind(segment: Column) -> Column:
    return reduce(lambda rest, k: F.when(segment.rlike(k[0]), F.lit(k[1])).otherwise(rest), reversed(KINDS), segment)


def segments(path: Column) -> Column:
    """The segments that are not empty, machine-made ones by their kind."""
    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), _kind)


def _level(paths: DataFrame, fanout: int) -> DataFrame:
    """paths (host, segs, n, labels, blocked, template, rest) with the template grown by the first segment of ``rest``, which is
    never empty."""
    branch = paths.groupBy("host", "template", F.element_at("rest", 1).alias("seg")).agg(*[F.sum(c).alias(c) for c in ("n", "labels", "blocked")])
    literal = ~F.col("seg").startswith("{")
    node = branch.filter(literal).groupBy("host", "template").agg(F.count("*").alias("kids"), F.sum("n").alias("all_n"), F.sum("labels").alias("all_labels"), F.sum("blocked").alias("all_blocked"))
    both = branch.join(node, ["host", "template"], "left")
    rest, rest_blocked = F.col("all_labels") - F.col("labels"), F.col("all_blocked") - F.col("blocked")
    pooled = F.col("all_blocked") / F.col("all_labels")
    gap = F.col("blocked") / F.col("labels") - rest_blocked / rest
    noise = pooled * (1 - pooled) * (1 / F.col("labels") + 1 / rest)
    token = (
        F.when(~literal, F.col("seg"))
        .when((F.col("kids") > fanout) & (F.col("n") * F.col("kids") <= F.col("all_n")), F.lit("{var}"))
        .when(F.col("labels") == 0, F.lit("{new}"))
        .when((rest > 0) & (gap * gap > 4 * noise), F.col("seg"))
        .otherwise(F.lit("{any}"))
    )
    tokens = both.select(F.col("host").alias("_h"), F.col("template").alias("_t"), F.col("seg").alias("_s"), token.alias("_token"))
    grown = paths.join(tokens, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")) & (F.element_at("rest", 1) == F.col("_s")))
    return grown.withColumn("template", F.concat("template", F.lit("/"), "_token")).withColumn("rest", _after("rest", 1)).drop("_h", "_t", "_s", "_token")


def _after(segs: str, n: int | Column) -> Column:
    """The segments after the first n."""
    return F.slice(segs, F.lit(n) + 1, F.greatest(F.size(segs) - F.lit(n), F.lit(0)))


def _open(paths: DataFrame) -> DataFrame:
    """paths with the ``rest`` that can still split their node: without what all of the node's paths begin with, and
    empty where they are all alike."""
    node = paths.groupBy("host", "template").agg(F.min("rest").alias("_first"), F.max("rest").alias("_last"))
    same = F.zip_with("_first", "_last", lambda a, b: F.coalesce(a == b, F.lit(False)))
    node = node.filter("_first != _last").select(F.col("host").alias("_h"), F.col("template").alias("_t"), (F.array_position(same, F.lit(False)) - 1).cast("int").alias("_common"))
    joined = paths.join(node, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t")), "left")
    rest = F.when(F.col("_h").isNull(), F.array().cast("array<string>")).otherwise(_after("rest", F.col("_common")))
    return joined.withColumn("rest", rest).drop("_h", "_t", "_common")


def templates(paths: DataFrame, depth: int, fanout: int, min_labels: int, prior_weight: float, reject: float) -> DataFrame:
    """(host, segs, n, template, purity, rejected) for paths (host, segs, n, labels, blocked)."""
    open_paths, at, done = paths.withColumns({"template": F.lit(""), "rest": F.col("segs")}), 0, new_path(paths.sparkSession, "done")
    ended = F.size("rest") == 0
    columns = [*paths.columns, "template"]
    open_paths.filter(ended).select(columns).write.parquet(done)
    open_paths = open_paths.filter(~ended)
    while not open_paths.isEmpty():
        at += 1
        grown = _level(open_paths, fanout)
        grown = written(_open(grown) if at >= depth else grown, f"paths{at}")
        grown.filter(ended).select(columns).write.mode("append").parquet(done)
        open_paths = grown.filter(~ended)  # only these go on
    paths = paths.sparkSession.read.schema(open_paths.select(columns).schema).parquet(done)
    per = paths.groupBy("host", "template").agg(F.sum("labels").alias("_labels"), F.sum("blocked").alias("_blocked"))
    total = paths.agg(F.sum("labels").alias("_all"), F.sum("blocked").alias("_all_blocked"))
    prior = F.coalesce(F.try_divide(F.col("_all_blocked"), F.col("_all")), F.lit(0.0))
    purity = (F.col("_blocked") + prior_weight * prior) / (F.col("_labels") + prior_weight)
    judged = per.crossJoin(F.broadcast(total)).select(F.col("host").alias("_h"), F.col("template").alias("_t"), purity.alias("purity"), ((F.col("_labels") >= min_labels) & (purity >= reject)).alias("rejected"))
    return paths.join(judged, (F.col("host") == F.col("_h")) & (F.col("template") == F.col("_t"))).select("host", "segs", "n", "template", "purity", "rejected")


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", depth: int = 4, fanout: int = 20, min_labels: int = 5, prior_weight: float = 4.0, reject: float = 0.8) -> DataFrame:
    """Per page: its id, host, path, rule, verdict (allow or block), template, purity."""
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    parsed = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    fit = rule_for(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumn("_fit", fit).select(id_col, "host", "path", F.col("_fit.rule").alias("rule"), F.col("_fit.action").alias("action"), segments(F.col("path")).alias("segs"))
    labelled, blocked = F.col("action").isNotNull().cast("long"), F.coalesce((F.col("action") == "block").cast("long"), F.lit(0).cast("long"))
    paths = written(parsed.groupBy("host", "segs").agg(F.count("*").alias("n"), F.sum(labelled).alias("labels"), F.sum(blocked).alias("blocked")), "paths")
    found = templates(paths, depth, fanout, min_labels, prior_weight, reject)
    total = paths.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    joined = with_groups(parsed, found, ["host", "segs"], "n", total, [id_col, "path"])
    verdict = F.coalesce(F.col("action"), F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return joined.select(id_col, "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
