"""URL filter: fixed rules, and a tree of path templates for the urls that no rule fits.

The urls that a rule fits are the labels. Per host, a path is a list of
segments. A segment that looks variable (numbers, long or hashed names) becomes
``*``; then, level by level from the root, all segments under a branch become
``*`` where they are too many for their pages. Labelled branches under one parent that
do not differ by a two-proportion test are merged. A template's purity is its
share of blocked labels, smoothed towards an even prior by ``PRIOR`` pages; a url
is blocked where its template, or the nearest branch above with labels, has a
purity of ``REJECT_PURITY`` or more. Without any label a url is allowed.

NULL urls and urls without ``://`` have an empty host and path, match no rule
and are allowed. Repeated rows are judged each; an empty table gives no rows.
All of it is column expressions, joins and groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendlake.llm.common import staged

#: Host, path and verdict of the rules.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: Levels of the tree below the host; what lies deeper counts by its shape only.
LEVELS = 4
#: A branch with more different segments than this, and fewer pages for each than that, is variable.
MANY_SEGMENTS = 20
FEW_PAGES = 5.0
#: Branches whose shares differ by fewer standard errors are alike.
ALIKE = 1.96
PRIOR = 10.0
REJECT_PURITY = 0.8

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, F.when(at > 0, path).otherwise("")


def ruled(host: Column, path: Column) -> Column:
    """Name and verdict of the longest rule that fits, or NULL."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(RULES, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value).otherwise(found)
    return found


def _shape(segment: Column) -> Column:
    """``*`` (and the extension) for a segment that is a number, a hash or a long name."""
    extension = F.regexp_extract(segment, r"(\.[A-Za-z]{1,5})$", 1)
    stem = F.substring(segment, F.lit(1), F.length(segment) - F.length(extension))
    variable = stem.rlike(r"[0-9]") | (F.length(stem) > 24) | stem.rlike(r"^[0-9a-f-]{16,}$")
    return F.when(variable, F.concat(F.lit("*"), extension)).otherwise(segment)


def shaped(path: Column) -> Column:
    """The segments of a path, variable ones as wildcards."""
    return F.transform(F.split(F.regexp_replace(path, "^/", ""), "/"), _shape)


def _wildcards(tree: DataFrame) -> DataFrame:
    """Level by level, the segments of a branch with too many of them become ``*``."""
    for level in range(LEVELS):
        above = [f"s{k}" for k in range(level)]
        children = tree.groupBy("host", *above, f"s{level}").agg(F.sum("pages").alias("pages"))
        crowded = children.filter(F.col(f"s{level}").isNotNull()).groupBy("host", *above)
        crowded = crowded.agg(F.count("*").alias("n"), F.sum("pages").alias("pages")).filter(
            (F.col("n") > MANY_SEGMENTS) & (F.col("pages") < F.col("n") * FEW_PAGES)
        )
        crowded = crowded.select(*(F.col(c).alias(f"_{c}") for c in ("host", *above)), F.lit(True).alias("crowded"))
        same = [tree[c].eqNullSafe(crowded[f"_{c}"]) for c in ("host", *above)]
        on = same[0]
        for more in same[1:]:
            on = on & more
        wild = F.col("crowded") & F.col(f"s{level}").isNotNull()
        tree = tree.join(crowded, on, "left").withColumn(
            f"s{level}", F.when(wild, F.lit("*")).otherwise(F.col(f"s{level}"))
        )
        # Each level reads the last one twice: written, so that the plan stays small.
        tree = staged(tree.drop("crowded", *(f"_{c}" for c in ("host", *above))), "url-wildcards")
    return tree


def _merged(tree: DataFrame) -> DataFrame:
    """Labelled branches of one parent that are alike get one number (``m<level>``).

    In order of their share of blocked pages, a branch starts a new number where it differs
    from the one before; unlabelled branches keep their own name.
    """
    for level in range(LEVELS):
        above = ["host", *(f"m{k}" for k in range(level))]
        own = f"s{level}"
        branch = tree.groupBy(*above, own).agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("n"))
        branch = branch.filter((F.col("n") > 0) & F.col(own).isNotNull())
        order = Window.partitionBy(*above).orderBy(F.col("b") / F.col("n"), own)
        pooled = (F.col("b") + F.lag("b").over(order)) / (F.col("n") + F.lag("n").over(order))
        error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("n") + 1 / F.lag("n").over(order)))
        apart = F.abs(F.col("b") / F.col("n") - F.lag("b").over(order) / F.lag("n").over(order))
        new = F.when(F.lag("n").over(order).isNull() | (apart > ALIKE * error), 1).otherwise(0)
        branch = branch.withColumn("new", new)
        number = F.concat(F.lit("="), F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        branch = branch.select(*(F.col(c).alias(f"_{c}") for c in (*above, own)), number.alias("number"))
        on = tree[above[0]] == branch[f"_{above[0]}"]
        for c in (*above[1:], own):
            on = on & tree[c].eqNullSafe(branch[f"_{c}"])
        tree = tree.join(branch, on, "left").withColumn(f"m{level}", F.coalesce("number", own))
        tree = staged(tree.drop("number", *(f"_{c}" for c in (*above, own))), "url-merges")
    return tree


def judged_shapes(shapes: DataFrame) -> DataFrame:
    """``host, shape, template, purity`` from ``host, shape, pages, blocked, labelled``.

    ``template`` has the wildcards in it; ``purity`` is NULL where there is no label above.
    """
    levels = [F.get("shape", F.lit(k)).alias(f"s{k}") for k in range(LEVELS)]
    tail = F.array_join(F.slice("shape", LEVELS + 1, F.greatest(F.size("shape") - LEVELS, F.lit(0))), "/")
    tree = shapes.select("*", *levels, F.when(F.size("shape") > LEVELS, tail).alias("tail"))
    tree = _merged(_wildcards(tree))
    merged = [f"m{k}" for k in range(LEVELS)]
    purity = F.lit(None).cast("double")
    judged = tree
    for depth in range(1, LEVELS + 1):  # the deepest branch with labels counts; a host alone says too little
        branch = tree.groupBy("host", *merged[:depth]).agg(F.sum("blocked").alias("b"), F.sum("labelled").alias("n"))
        branch = branch.filter("n > 0").select(
            *(F.col(c).alias(f"_{c}") for c in ("host", *merged[:depth])),
            ((F.col("b") + PRIOR / 2) / (F.col("n") + PRIOR)).alias(f"purity{depth}"),
        )
        on = judged["host"] == branch["_host"]
        for c in merged[:depth]:
            on = on & judged[c].eqNullSafe(branch[f"_{c}"])
        judged = judged.join(branch, on, "left").drop(*(f"_{c}" for c in ("host", *merged[:depth])))
        purity = F.coalesce(F.col(f"purity{depth}"), purity)
    template = F.concat(F.lit("/"), F.concat_ws("/", *(f"s{k}" for k in range(LEVELS)), "tail"))
    return judged.select("host", "shape", template.alias("template"), purity.alias("purity"))


def judge(pages: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` of every row."""
    host, path = host_and_path(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path"))
    pages = pages.withColumn("fit", ruled(F.col("host"), F.col("path"))).withColumn("shape", shaped(F.col("path")))
    pages = staged(pages, "url-pages")
    blocked = F.when(F.col("fit.verdict") == "block", 1).otherwise(0)
    shapes = pages.groupBy("host", "shape").agg(
        F.count("*").alias("pages"),
        F.sum(blocked).alias("blocked"),
        F.sum(F.when(F.col("fit").isNotNull(), 1).otherwise(0)).alias("labelled"),
    )
    known = judged_shapes(staged(shapes, "url-shapes"))
    known = known.select(F.col("host").alias("_host"), F.col("shape").alias("_shape"), "template", "purity")
    by_tree = F.when(F.col("purity") >= REJECT_PURITY, "block").otherwise("allow")
    return pages.join(known, (F.col("host") == F.col("_host")) & (F.col("shape") == F.col("_shape")), "left").select(
        "page_id",
        "host",
        "path",
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.verdict", by_tree).alias("verdict"),
        "template",
        "purity",
    )
