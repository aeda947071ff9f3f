"""URL filters: listed rules first, then a tree of path templates for each host.

Urls that a rule decides are the labelled ones.  Level by level, the segments that follow a template of a host are
counted; a segment stays literal only where it is common enough among its siblings, or where its labelled share
differs from theirs, else it becomes a wildcard of its shape.  A branch below which all urls are alike is done, so that
depth is not bounded.  Branches of one parent are put in order of their share of blocked urls, and neighbours that don't
differ statistically are merged.  From the host down to the leaves the share of each merged branch is smoothed towards
its parent's; one without labels, or whose share doesn't differ from its parent's, is merged into the parent and judged
by the evidence of what it is merged into.
All counts are grouped sums over host and template, salted where a host's rows must meet its templates again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded, cut, let, salt_of

#: Fixed values: (verdict, host, path) of the listed rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: A segment stays literal with this share of its siblings' urls.
LEAST_SHARE = 0.02
#: Weight of the parent's share, labelled urls that a verdict needs, and the share from which a template goes.
WEIGHT, LEAST_LABELS, PURITY = 5.0, 10, 0.8
#: Standard errors up to which a branch doesn't differ from its parent.
SAME = 2.0
SALTS = 32


def split_url(url: Column) -> Column:
    """host and path of a url, as a struct; both empty for null or without ://."""
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)

    def parts(rest: Column) -> Column:
        host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
        path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
        lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        return F.struct(lower.alias("host"), path.alias("path"))

    return let(after, parts)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """rule and verdict of the longest rule that fits, nulls if none does."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"))
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def shape(segment: Column) -> Column:
    """The wildcard of a segment: numbers, hexadecimal and mixed identifiers, dates, files, or any word."""
    return (
        F.when(segment.rlike("^[0-9]+$"), "{number}")
        .when(segment.rlike(r"^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$"), "{date}")
        .when(segment.rlike(r"^[0-9]+\.[A-Za-z0-9]+$"), F.concat(F.lit("{number}."), F.regexp_extract(segment, r"\.([A-Za-z0-9]+)$", 1)))
        .when(segment.rlike("^[0-9a-fA-F-]{8,}$"), "{hex}")
        .when(segment.rlike("[0-9]") & segment.rlike("[A-Za-z]"), "{id}")
        .otherwise("{word}")
    )


def segments(path: Column) -> Column:
    """Segments of a path; numbers and the like take their shape at once."""
    named = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(named, lambda s: let(shape(s), lambda w: F.when(w == "{word}", s).otherwise(w)))


def _meet(rows: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """rows left-joined with found; a host with most of the rows is spread over SALTS parts."""
    if bounded(found):
        return rows.join(F.broadcast(found), keys, "left")
    dealt = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", salt_of(F.xxhash64(F.monotonically_increasing_id()), SALTS)).join(dealt, [*keys, "salt"], "left").drop("salt")


def _same(n: Column, k: Column, above: Column) -> Column:
    """Whether k of n may be a sample of the share above; nothing at all may be."""
    least = F.greatest(n, F.lit(1))
    return (n == 0) | (F.abs(k / least - above) <= SAME * F.sqrt(above * (1 - above) / least))


def templates(urls: DataFrame) -> DataFrame:
    """host, segments, template for each different host and segments of urls(host, segments, blocked, ...)."""
    told = (F.count("blocked").alias("told"), F.coalesce(F.sum(F.col("blocked").cast("long")), F.lit(0)).alias("k"))
    rows = cut(urls.groupBy("host", "segments").agg(F.count("*").alias("n"), *told).withColumn("template", F.lit("")))
    done, level = None, 0
    while True:
        # where one path is all that is left of a branch, nothing below is to be decided
        alone = rows.groupBy("host", "template").agg(F.count("*").alias("paths")).where("paths = 1").select("host", "template", F.lit(True).alias("alone"))
        rows = cut(_meet(rows, cut(alone), ["host", "template"]))
        ends = F.coalesce("alone", F.lit(False)) | (F.size("segments") <= level)
        rest = F.array_join(F.slice("segments", level + 1, F.greatest(F.size("segments") - level, F.lit(0))), "/")
        ended = rows.where(ends).select("host", "segments", F.when(rest == "", F.col("template")).otherwise(F.concat_ws("/", "template", rest)).alias("template"))
        done = ended if done is None else done.union(ended)
        rows = rows.where(~ends).drop("alone")
        if rows.isEmpty():
            return done
        step = rows.withColumn("next", F.get("segments", F.lit(level)))
        children = step.groupBy("host", "template", "next").agg(F.sum("n").alias("urls"), F.sum("told").alias("told"), F.sum("k").alias("k"))
        parents = children.groupBy("host", "template").agg(F.sum("urls").alias("all"), ((F.sum("k") + 0.5) / (F.sum("told") + 1)).alias("above"))
        literal = _meet(children.withColumn("segments", F.array("next")), cut(parents), ["host", "template"])
        literal = cut(literal.where((F.col("urls") >= LEAST_SHARE * F.col("all")) | ~_same(F.col("told"), F.col("k"), F.col("above"))).select("host", "template", "next", F.lit(True).alias("literal")))
        step = _meet(step, literal, ["host", "template", "next"])
        shown = F.when(F.col("literal") | F.col("next").startswith("{"), F.col("next")).otherwise("{word}")
        rows = cut(step.select("host", "segments", "n", "told", "k", F.concat_ws("/", "template", shown).alias("template")))
        level += 1


def _with_siblings(nodes: DataFrame) -> DataFrame:
    """nodes with n and k of all that are merged with them: in order of their shares, the labelled branches of a parent
    go together while neighbours don't differ, by the deviation of the difference of two shares."""
    told = nodes.withColumn("told", F.col("n") > 0)
    n = F.greatest("n", F.lit(1))  # branches without labels differ from none
    order = Window.partitionBy("host", "parent", "told").orderBy(F.col("k") / n, "node")
    n0, k0 = F.lag(n).over(order), F.lag("k").over(order)
    pooled = (F.col("k") + k0) / (n + n0)
    differ = F.abs(F.col("k") / n - k0 / n0) > SAME * F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / n0))
    told = told.withColumn("first", F.coalesce((F.col("told") & differ).cast("int"), F.lit(0)))
    told = told.withColumn("group", F.sum("first").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("host", "parent", "told", "group")
    return told.withColumns({"n": F.sum("n").over(whole), "k": F.sum("k").over(whole)}).drop("told", "first", "group")


def judge(labelled: DataFrame) -> DataFrame:
    """host, template, merged, purity, rejected from labelled(host, template, blocked; blocked may be null).

    Level by level from the host: similar branches of one parent are merged, purity is smoothed towards the purity
    above; n is how many labels tell of the branch that a template is merged into.
    """
    leaves = cut(labelled.groupBy("host", "template").agg(F.count("blocked").alias("n"), F.coalesce(F.sum(F.col("blocked").cast("long")), F.lit(0)).alias("k")))
    whole = leaves.agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.max(F.size(F.split("template", "/"))).alias("depth")).first()
    prior = ((whole["k"] or 0) + 0.5) / ((whole["n"] or 0) + 1)
    above, done = None, None
    for level in range(1, (whole["depth"] or 0) + 1):
        at = leaves.where(F.size(F.split("template", "/")) >= level)
        at = at.withColumn("node", F.substring_index("template", "/", level))
        nodes = at.groupBy("host", "node").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.max(F.col("template") == F.col("node")).alias("leaf"))
        if above is None:
            same, p, group = F.lit(False), F.lit(prior), F.col("n")
        else:
            nodes = _with_siblings(nodes.withColumn("parent", F.substring_index("node", "/", level - 1))).withColumn("segments", F.array("node"))
            nodes = _meet(nodes, above, ["host", "parent"])
            same, p, group = _same(F.col("n"), F.col("k"), F.col("above")), F.col("above"), F.col("above_n")
        purity = F.when(same, p).otherwise((F.col("k") + WEIGHT * p) / (F.col("n") + WEIGHT))
        nodes = cut(nodes.select("host", "node", "leaf", same.alias("merged"), purity.alias("purity"), F.when(same, group).otherwise(F.col("n")).alias("evidence")))
        above = nodes.select("host", F.col("node").alias("parent"), F.col("purity").alias("above"), F.col("evidence").alias("above_n"))
        ends = nodes.where("leaf").select("host", F.col("node").alias("template"), "merged", "purity", ((F.col("evidence") >= LEAST_LABELS) & (F.col("purity") >= PURITY)).alias("rejected"))
        done = ends if done is None else done.union(ends)
    return leaves.sparkSession.createDataFrame([], "host string, template string, merged boolean, purity double, rejected boolean") if done is None else done


def filter_urls(pages: DataFrame, labels: DataFrame | None = None, rules=RULES) -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict, template, purity.

    labels: further labelled pages (page_id, blocked boolean), one for each page at most.  A null url, or one without
    ://, has an empty host and path and is allowed unless its template is rejected.  Repeated rows count as often.
    """
    seen = pages.select(F.col("page_id").cast("long").alias("page_id"), split_url(F.col("url").cast("string")).alias("u")).select("page_id", "u.host", "u.path")
    seen = seen.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)).select("page_id", "host", "path", "r.rule", F.col("r.verdict").alias("ruled"), segments(F.col("path")).alias("segments"))
    seen = cut(seen)
    marked = seen
    blocked = F.when(F.col("ruled").isNotNull(), F.col("ruled") == "block")
    if labels is not None:
        more = labels.where("page_id is not null").groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.max("blocked").alias("told"))
        marked = seen.join(more, "page_id", "left")
        blocked = F.coalesce(blocked, F.col("told"))
    marked = marked.withColumn("blocked", blocked)
    shown = templates(marked)
    named = _meet(marked, shown, ["host", "segments"])
    found = cut(judge(named.select("host", "template", "blocked")))
    out = _meet(_meet(seen, shown, ["host", "segments"]), found, ["host", "template"])
    verdict = F.coalesce("ruled", F.when(F.col("rejected"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
