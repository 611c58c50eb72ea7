"""URL filter by rules and a tree of path templates per host (operator 11), in Spark expressions only.

A url is judged by the longest rule that fits it. The others are judged by their template:

* Each host has a tree whose root holds all its distinct paths. A node of ``MIN_SPLIT`` paths or more is
  split by the next path segment, all hosts' nodes of a level at once.
* A segment that looks variable (a number with or without a file ending, a long hexadecimal or dashed id) becomes the wildcard
  ``*``; so does a name with fewer than ``SUPPORT`` paths where a node has more than ``BRANCHES`` names.
* A path's kind under a branch is its label, how many segments follow, and how it ends. The named branches of a node
  that have their commonest kind in common are a pool, and each is compared with its whole pool by a chi-square statistic over the kinds.
  Two or more branches that do not differ from their pool are merged into one, named after the least of them with a ``+``. So a
  branch is compared with one distribution, not with each other branch.
* The labels are the verdicts of the rules. A template is rejected when its share of blocked paths among the
  labelled ones, smoothed by ``WEIGHT`` paths of a share of one half, is ``PURITY`` or more.

All statistics are aggregates that combine map-side, joined back by (host, node), so a host of a third of all rows is
no group of one task. The tree ends where too few paths are left to split, and so do the rounds.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import written

MIN_SPLIT = 8
SUPPORT = 3
BRANCHES = 20
WEIGHT = 4
PURITY = 0.9
#: Segments that look variable: numbers, and ids of eight hexadecimal digits and dashes or more.
NUMBER = r"^[0-9]+(\.[A-Za-z0-9]+)?$"
IDENTIFIER = r"^[0-9A-Fa-f-]{8,}$"
ENDING = r"(\.[A-Za-z0-9]+|/)?$"


class Rule(NamedTuple):
    verdict: str  # allow or block
    text: str  # host suffix and path prefix

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (Rule("block", "net/"), Rule("allow", "example.net/en/"), Rule("block", "example.com/de/"), Rule("allow", "org/fr/"))


def judged_by_rules(pages: DataFrame, url: str, rules: Sequence[Rule]) -> DataFrame:
    """``pages`` with host, path, and the text and verdict of the longest rule that fits (nulls if none does).

    The host is what follows the first ``://`` up to ``/``, ``?`` or ``#``, A-Z in lower case; the path goes from there up to ``?`` or ``#``."""
    after = F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    pages = pages.withColumn("__after", F.coalesce(after, F.lit("")))
    raw = F.regexp_extract("__after", r"^[^/?#]*", 0)
    pages = pages.withColumn("host", F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    pages = pages.withColumn("path", F.regexp_extract("__after", r"^[^/?#]*([^?#]*)", 1)).drop("__after")
    longest_first = sorted(rules, key=lambda r: (-len(r.text), r.text))
    fits = [((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path) for r in longest_first]

    def chosen(value) -> Column:
        none = F.lit(None).cast("string")
        return reduce(lambda rest, f: F.when(f[0], value(f[1])).otherwise(rest), reversed(list(zip(fits, longest_first, strict=True))), none)

    return pages.withColumn("rule", chosen(lambda r: r.text)).withColumn("__verdict", chosen(lambda r: r.verdict))


def _shape(segment: Column) -> Column:
    """The wildcard of a segment that looks variable, else the segment itself."""
    return (F.when(segment.rlike(NUMBER), F.concat(F.lit("*"), F.regexp_extract(segment, ENDING, 0)))
            .when(segment.rlike(IDENTIFIER) & segment.rlike("[0-9]"), "*")
            .when(segment.rlike(r"^\*|\+$"), F.concat(F.lit("="), segment, F.lit("="))).otherwise(segment))


def _decided(open_paths: DataFrame, spark) -> DataFrame:
    """For each (host, node, seen branch) of a level: ``branch``, what it is taken as, and ``n``, the paths of that."""
    counts = written(spark, open_paths.groupBy("host", "node", "seen", "named", "kind").agg(F.count(F.lit(1)).alias("x")), "branch_counts")
    seen = counts.groupBy("host", "node", "seen", "named").agg(F.sum("x").alias("n"))
    names = seen.filter("named").groupBy("host", "node").agg(F.count(F.lit(1)).alias("names"))
    rare = (F.coalesce("names", F.lit(0)) > BRANCHES) & (F.col("n") < SUPPORT)
    seen = written(spark, seen.join(names, ["host", "node"], "left").select("host", "node", "seen", "n", (F.col("named") & ~rare).alias("named")), "branches")
    # the named branches of one commonest kind against all of them together
    kept = counts.drop("named").join(seen.filter("named").drop("named"), ["host", "node", "seen"])
    commonest = kept.groupBy("host", "node", "seen").agg(F.max_by("kind", F.struct("x", "kind")).alias("pool"))
    kept = written(spark, kept.join(commonest, ["host", "node", "seen"]), "kept")
    pool = ["host", "node", "pool"]
    whole = kept.groupBy(*pool, "kind").agg(F.sum("x").alias("p"))
    size = whole.groupBy(*pool).agg(F.sum("p").alias("all"), F.count(F.lit(1)).alias("kinds"))
    chi = kept.join(whole, [*pool, "kind"]).groupBy(*pool, "seen").agg(F.sum(F.col("x") * F.col("x") / F.col("p")).alias("s"), F.first("n").alias("n"))
    free = F.col("kinds") - 1
    alike = F.round(F.col("all") / F.col("n") * F.col("s") - F.col("n"), 6) <= F.round(free + 2 * F.sqrt(2 * free), 6)
    alike = written(spark, chi.join(size, pool).filter(alike).select(*pool, "seen"), "alike")
    merged = alike.groupBy(*pool).agg(F.count(F.lit(1)).alias("alike"), F.concat(F.min("seen"), F.lit("+")).alias("merged")).filter("alike > 1")
    merged = alike.join(merged, pool).select("host", "node", "seen", "merged")
    variable = F.when(F.col("seen").startswith("*"), F.col("seen")).otherwise("*")
    branch = F.when(~F.col("named"), variable).otherwise(F.coalesce("merged", "seen"))
    taken = seen.join(merged, ["host", "node", "seen"], "left").select("host", "node", "seen", "n", branch.alias("branch"))
    total = taken.groupBy("host", "node", "branch").agg(F.sum("n").alias("n"))
    return taken.drop("n").join(total, ["host", "node", "branch"])


def path_templates(labelled: DataFrame) -> DataFrame:
    """(host, path, label, template) for the distinct rows (host, path, label) of ``labelled``; a path has one label or none."""
    spark = labelled.sparkSession
    segments = F.when(F.col("path") == "", F.array().cast("array<string>")).otherwise(F.split(F.expr("substring(path, 2)"), "/"))
    paths = labelled.groupBy("host", "path").agg(F.max("label").alias("label")).withColumn("segments", segments).withColumn("node", F.lit(""))
    paths = written(spark, paths, "paths")
    paths = paths.join(paths.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "host")
    out, depth = [], 0
    while True:
        few, ended = F.col("n") < MIN_SPLIT, F.size("segments") <= depth
        template = F.when(few, F.concat("node", F.lit("/**"))).when(ended, F.col("node"))
        paths = written(spark, paths.withColumn("template", template), "level")
        out.append(paths.filter("template is not null").select("host", "path", "label", "template"))
        going = paths.filter("template is null").drop("n", "template")
        if going.isEmpty():
            return reduce(DataFrame.unionByName, out)
        segment = F.col("segments")[depth]
        kind = F.concat_ws("|", F.coalesce("label", F.lit("none")), (F.size("segments") - depth).cast("string"), F.regexp_extract("path", ENDING, 0))
        going = going.withColumn("seen", _shape(segment)).withColumn("named", ~F.col("seen").startswith("*")).withColumn("kind", kind)
        decided = _decided(going, spark)
        paths = going.drop("named", "kind").join(decided, ["host", "node", "seen"]).withColumn("node", F.concat_ws("/", "node", "branch")).drop("seen", "branch")
        depth += 1


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (its text, or null), ``verdict``, ``template`` and ``purity``; columns of these names are replaced.

    A null url or one without ``://`` has an empty host and path and, like any url without a fitting rule or a rejected template, is allowed.
    Template and purity are those of the url's host, also where a rule decides. Equal paths of a host count once; repeated rows stay.
    ``rules`` is a list that the plan holds whole.
    """
    spark = pages.sparkSession
    pages = pages.drop(*(c for c in ("host", "path", "rule", "verdict", "template", "purity") if c != url))
    names = pages.columns
    judged = judged_by_rules(pages, url, rules)
    found = written(spark, path_templates(judged.select("host", "path", F.col("__verdict").alias("label"))), "templates")
    blocked, labelled = F.count_if(F.col("label") == "block"), F.count("label")
    purity = ((blocked + WEIGHT / 2) / (labelled + WEIGHT)).alias("purity")
    purity = found.groupBy("host", "template").agg(purity)
    by_path = found.drop("label").join(purity, ["host", "template"])
    verdict = F.coalesce("__verdict", F.when(F.col("purity") >= PURITY, "block").otherwise("allow"))
    return judged.join(by_path, ["host", "path"]).select(*names, "host", "path", "rule", verdict.alias("verdict"), "template", "purity")
