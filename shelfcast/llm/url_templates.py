"""URL filter by a path-template tree, in DataFrame functions only.

Pages that a rule judges are labelled by it. The others are judged by the
template of their URL:

1. Digit runs in a path's segments become N. Then, level by level below each
   host, a segment stays literal if at least ``MIN_SHARE`` of its branch's pages
   have it and else becomes a wildcard; behind ``depth`` levels (``DEPTH``, or any number, or
   None for all) the rest of the path is one segment.
2. From the last segment to the first, templates of a host that differ in this segment
   alone are siblings. The two neighbours, by share of blocked labels, that differ least are
   merged and their labels pooled, again and again while they do not differ
   significantly. So whole branches with the same templates below them (/en/..., /de/...) merge too.
3. A merged branch is rejected when its share of blocked among labelled pages,
   smoothed with one page of either kind, is at least ``REJECT``. A branch
   without labels has a share of one half and passes.

Pages are counted by host and shape before anything else is done, so the tree
is built on counts. A level's segments and branches are grouped sums, joined back to the
shapes, so no task must hold all shapes of a host; the shapes are written after each
level. A list of siblings has at most 1 / ``MIN_SHARE`` segments and a wildcard. Only the verdicts come
back to the pages, by host and shape.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: (rule, verdict). A rule is a host and the beginning of a path; the longest that fits wins.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
DEPTH = 4
MIN_SHARE = 0.02
REJECT = 0.8
Z = 1.96

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for a url without ``://``."""
    part = lambda k: F.coalesce(F.regexp_extract(url, _URL, k), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, or null."""
    fits = []
    for rule, _ in sorted(rules, key=lambda r: -len(r[0])):
        at, slash, beginning = rule.partition("/")
        fit = ((host == at) | host.endswith("." + at)) & path.startswith(slash + beginning)
        fits.append(F.when(fit, F.lit(rule)))
    return F.coalesce(*fits, F.lit(None).cast("string"))


def path_shape(path: Column, depth: int | None = DEPTH) -> Column:
    """The path with digit runs as N and at most ``depth`` + 1 segments (the last one holds the rest)."""
    return F.split(F.regexp_replace(F.regexp_replace(path, "^/", ""), "[0-9]+", "N"), "/", -1 if depth is None else depth + 1)


def _share(x: Column) -> Column:
    return (x["blocked"] + 1) / (x["labelled"] + 2)


def _gap(x: Column, y: Column) -> Column:
    """How many standard errors the shares of two branches lie apart."""
    pooled = (x["blocked"] + y["blocked"] + 1) / (x["labelled"] + y["labelled"] + 2)
    return F.abs(_share(y) - _share(x)) / F.sqrt(pooled * (1 - pooled) * (1 / x["labelled"] + 1 / y["labelled"]))


def _merge_nearest(siblings: Column, _: Column) -> Column:
    """The siblings with the nearest two neighbours (of equals the first) as one, if they do not differ significantly."""
    gaps = F.transform(F.slice(siblings, 2, F.size(siblings)), lambda y, k: _gap(siblings[k], y))
    least = F.array_min(gaps)
    at = F.array_position(gaps, least).cast("int")
    x, y = siblings[at - 1], siblings[at]
    one = F.struct(
        (x["labelled"] + y["labelled"]).alias("labelled"), (x["blocked"] + y["blocked"]).alias("blocked"),
        F.concat(x["names"], y["names"]).alias("names"),
    )
    rest = F.slice(siblings, at + 2, F.size(siblings))
    return F.when(least <= Z, F.concat(F.slice(siblings, F.lit(1), at - 1), F.array(one), rest)).otherwise(siblings)


def merge_siblings(leaves: DataFrame, position: int) -> DataFrame:
    """``leaves`` (host, prefix, label, labelled, blocked) with the segment at ``position`` of the labels (from 0)
    replaced by the smallest one of its merged branch. Branches without labels are like none: each stays by itself."""
    segment = F.get("label", F.lit(position))
    others = F.concat(F.slice("label", 1, position), F.slice("label", position + 2, 1 << 30))
    branches = leaves.where(F.size("label") > position).groupBy("host", others.alias("others"), segment.alias("segment"))
    branches = branches.agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")).where("labelled > 0")
    one = F.struct("labelled", "blocked", F.array("segment").alias("names"))
    row = F.struct(((F.col("blocked") + 1) / (F.col("labelled") + 2)).alias("share"), "segment", one.alias("branch"))
    siblings = branches.groupBy("host", "others").agg(F.array_sort(F.collect_list(row))["branch"].alias("siblings")).where(F.size("siblings") > 1)
    merged = siblings.select("host", "others", F.explode(F.aggregate("siblings", F.col("siblings"), _merge_nearest)).alias("branch"))
    names = merged.select("host", "others", F.array_min("branch.names").alias("name"), F.explode("branch.names").alias("segment"))
    joined = leaves.withColumn("others", others).withColumn("segment", segment).join(names, ["host", "others", "segment"], "left")
    label = F.concat(F.slice("label", 1, position), F.array(F.coalesce("name", "segment")), F.slice("label", position + 2, 1 << 30))
    return joined.withColumn("label", F.when(F.size("label") > position, label).otherwise(F.col("label"))).select(leaves.columns)


def templates(shapes: DataFrame, depth: int | None = DEPTH) -> DataFrame:
    """host, shape and ``rejected``, from the counts (host, shape, n, labelled, blocked)."""
    out = written(shapes.withColumn("prefix", F.array().cast("array<string>")), "shapes")
    columns = out.columns
    levels = (out.agg(F.max(F.size("shape"))).first()[0] or 0) if depth is None else depth + 1
    for level in range(levels):
        out = out.withColumn("_here", F.get("shape", F.lit(level)))
        segments = out.groupBy("host", "prefix", "_here").agg(F.sum("n").alias("_n"))
        branches = segments.groupBy("host", "prefix").agg(F.sum("_n").alias("_all"))
        literal = segments.join(branches, ["host", "prefix"]).where(F.col("_n") >= F.lit(MIN_SHARE) * F.col("_all"))
        literal = literal.select("host", "prefix", "_here", F.lit(True).alias("_common"))
        step = F.array(F.when(F.col("_common"), F.col("_here")).otherwise("*"))
        out = out.join(literal, ["host", "prefix", "_here"], "left")
        out = out.withColumn("prefix", F.when(F.col("_here").isNull(), F.col("prefix")).otherwise(F.concat("prefix", step)))
        out = written(out.select(columns), f"shapes-{level}")
    leaves = out.groupBy("host", "prefix").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    leaves = written(leaves.select("host", "prefix", F.col("prefix").alias("label"), "labelled", "blocked"), "templates")
    for position in reversed(range(levels)):
        leaves = written(merge_siblings(leaves, position), f"templates-{position}")
    purity = (F.sum("blocked") + 1) / (F.sum("labelled") + 2)
    judged = leaves.groupBy("host", "label").agg((purity >= REJECT).alias("rejected"))
    judged = leaves.select("host", "prefix", "label").join(judged, ["host", "label"]).select("host", "prefix", "rejected")
    return out.join(judged, ["host", "prefix"]).select("host", "shape", "rejected")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, depth: int | None = DEPTH) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    A null url, or one without ``://``, has an empty host and path, fits no rule
    and is judged with its like. Repeated rows count, and are returned, as often
    as they occur. Columns other than page_id and url take no part. With ``depth`` None
    every segment is a level of its own, at the cost of two jobs for each level of the deepest path.
    """
    host, path = url_parts(F.col("url"))
    read = pages.select("page_id", host.alias("host"), path.alias("path"))
    read = read.select("*", longest_rule(F.col("host"), F.col("path"), rules).alias("rule"), path_shape(F.col("path"), depth).alias("shape"))
    own = F.coalesce(*[F.when(F.col("rule") == r, F.lit(v)) for r, v in rules], F.lit(None).cast("string"))
    read = read.withColumn("own", own)
    shapes = read.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.count("own").alias("labelled"), F.count(F.when(F.col("own") == "block", 1)).alias("blocked")
    )
    verdict = F.coalesce("own", F.when(F.col("rejected"), "block").otherwise("allow"))
    return read.join(templates(shapes, depth), ["host", "shape"]).select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _oracle() -> str:
    def fits(rule: str) -> str:
        at, slash, beginning = rule.partition("/")
        return f"(host = '{at}' OR ends_with(host, '.{at}')) AND starts_with(path, '{slash}{beginning}')"

    by_length = sorted(RULES, key=lambda r: -len(r[0]))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for r, _ in by_length) + " END"
    own = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES) + " END"
    levels, last = [], "l0"
    for k in range(DEPTH + 1):
        part = f"seg[{k + 1}]" if k < DEPTH else f"CASE WHEN len(seg) > {DEPTH} THEN array_to_string(seg[{DEPTH + 1}:], '/') END"
        levels.append(f"""
v{k} AS (SELECT *, {part} AS here FROM {last}),
l{k + 1} AS (SELECT * EXCLUDE (prefix, here), CASE WHEN here IS NULL THEN prefix WHEN
  sum(n) OVER (PARTITION BY host, prefix, here) >= {MIN_SHARE} * sum(n) OVER (PARTITION BY host, prefix)
  THEN list_append(prefix, here) ELSE list_append(prefix, '*') END AS prefix FROM v{k})""")
        last = f"l{k + 1}"
    passes = []
    share = lambda x: f"(({x}.blocked + 1) / ({x}.labelled + 2))"
    pooled = "((s[k].blocked + s[k + 1].blocked + 1) / (s[k].labelled + s[k + 1].labelled + 2))"
    error = f"sqrt({pooled} * (1 - {pooled}) * (1 / s[k].labelled + 1 / s[k + 1].labelled))"
    gaps = f"list_transform(range(1, len(s)), lambda k: abs({share('s[k + 1]')} - {share('s[k]')}) / {error})"
    one = "{'labelled': s[m].labelled + s[m + 1].labelled, 'blocked': s[m].blocked + s[m + 1].blocked, 'names': s[m].names || s[m + 1].names}"
    for k in reversed(range(DEPTH + 1)):
        others = f"(list_slice(label, 1, {k}) || list_slice(label, {k + 2}, len(label)))"
        passes.append(f"""
b{k} AS (SELECT host, {others} AS others, label[{k + 1}] AS segment, sum(labelled)::BIGINT AS labelled, sum(blocked)::BIGINT AS blocked
  FROM t{k + 1} WHERE len(label) > {k} GROUP BY ALL HAVING sum(labelled) > 0),
s{k} AS (SELECT host, others, list({{'labelled': labelled, 'blocked': blocked, 'names': [segment]}}
  ORDER BY (blocked + 1) / (labelled + 2), segment) AS s FROM b{k} GROUP BY ALL),
r{k} AS (SELECT host, others, s, 0 AS step FROM s{k} UNION ALL
  SELECT host, others, list_slice(s, 1, m - 1) || [{one}] || list_slice(s, m + 2, len(s)), step + 1
  FROM (SELECT *, list_position(g, list_min(g)) AS m FROM (SELECT *, {gaps} AS g FROM r{k}) WHERE list_min(g) <= {Z})),
e{k} AS (SELECT host, others, unnest(arg_max(s, step)) AS x FROM r{k} GROUP BY host, others),
u{k} AS (SELECT host, others, list_min(x.names) AS name, unnest(x.names) AS segment FROM e{k}),
t{k} AS (SELECT t.* EXCLUDE (label), CASE WHEN len(label) > {k} THEN list_slice(label, 1, {k}) || [coalesce(u.name, label[{k + 1}])]
  || list_slice(label, {k + 2}, len(label)) ELSE label END AS label
  FROM t{k + 1} t LEFT JOIN u{k} u ON u.host = t.host AND u.others = {others} AND u.segment = t.label[{k + 1}])""")
    return f"""
WITH RECURSIVE p AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r AS (SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host, path FROM h),
j AS (SELECT *, {rule} AS rule, regexp_replace(regexp_replace(path, '^/', ''), '[0-9]+', 'N', 'g') AS shape FROM r),
o AS (SELECT *, {own} AS own FROM j),
l0 AS (SELECT host, shape, string_split(shape, '/') AS seg, CAST([] AS VARCHAR[]) AS prefix, count(*) AS n, count(own) AS labelled,
  count(*) FILTER (WHERE own = 'block') AS blocked FROM o GROUP BY host, shape),{','.join(levels)},
t{DEPTH + 1} AS (SELECT host, prefix, prefix AS label, sum(labelled) AS labelled, sum(blocked) AS blocked FROM {last} GROUP BY ALL),{','.join(passes)},
judged AS (SELECT host, prefix, (sum(blocked) OVER w + 1) / (sum(labelled) OVER w + 2) >= {REJECT} AS rejected FROM t0
  WINDOW w AS (PARTITION BY host, label))
SELECT o.page_id, o.host, o.path, o.rule, coalesce(o.own, CASE WHEN judged.rejected THEN 'block' ELSE 'allow' END) AS verdict
FROM o JOIN {last} t ON o.host = t.host AND o.shape = t.shape JOIN judged ON judged.host = t.host AND judged.prefix = t.prefix
"""


ORACLE_SQL = _oracle()
