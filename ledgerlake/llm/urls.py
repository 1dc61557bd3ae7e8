"""URL filters: a path-template tree per host, judged by smoothed labelled purity.

1. A url is split into host and path; the path into its segments, however many.
2. Segments of digits or of long mixed tokens are variable and become ``<num>`` or ``<id>``.
   Level by level, a node whose children are nearly all different gets the one child ``*``; repeats
   of a url do not count in this.
3. Level by level, a branch whose subtree is spread like that of all its siblings together (total
   variation at most ``SPREAD``) and whose labelled share agrees with theirs is merged with its like
   into ``*``. Below the first level, pages without a subtree have nothing to compare and are kept.
4. Urls that a rule decides are the labels. A template is rejected when its purity, the blocked
   share of its labels smoothed towards ``PRIOR``, reaches ``REJECT`` and at least ``SUPPORT`` of
   its urls carry a label; so templates that nothing is known about are allowed.

Only DataFrame functions are used. Urls are counted per distinct host and path before the tree is
built, each branch is compared with its parent's pool and never with every sibling, and the rows
that look up a node are salted, so a host that holds a third of the urls is spread over tasks.

Defined cases: null or without ``://``: host, path and template are empty and the verdict is
allow; repeated urls are judged alike; empty tables give empty results.
"""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.words import fold
from ledgerlake.sources.scratch import stored

#: More segments than any path has.
MOST = 2**30
#: A node with at least this many different urls, and a higher share of different children, is variable.
VARIABLE_ROWS, VARIABLE_SHARE = 20, 0.5
SPREAD = 0.2
AGREE = 0.1
PRIOR, SMOOTHING = 0.2, 2.0
REJECT, SUPPORT = 0.7, 0.5
SALTS = 16
WILD, NONE = "*", ""


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(fold(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``? #`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule as (rule, verdict), else null. ``rules``: verdict and rule text."""
    ordered = sorted(rules, key=lambda rule: (-len(rule[1]), rule[1]))

    def fits(rule: str) -> Column:
        name, slash, rest = rule.partition("/")
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)

    answer = [(fits(rule), F.struct(F.lit(rule).alias("rule"), F.lit(v).alias("verdict"))) for v, rule in ordered]
    if not answer:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    return reduce(lambda chain, step: chain.when(*step), answer[1:], F.when(*answer[0]))


def segment_class(segment: Column) -> Column:
    """Variable segments by their form; a final extension and the other segments stay."""
    shaped = F.regexp_replace(segment, r"^[0-9]+(?=\z|\.[A-Za-z0-9]{1,5}\z)", "<num>")
    mixed = segment.rlike(r"^(?=.*[0-9])[0-9A-Za-z_-]{12,}\z") | segment.rlike(r"^[0-9a-fA-F-]{16,}\z")
    return F.when(mixed, F.lit("<id>")).otherwise(shaped)


def _look_up(rows: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which the rows of one node meet ``SALTS`` copies of it."""
    copies = nodes.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return rows.join(copies, [*keys, "salt"], "left")


def segments_of(path: Column) -> Column:
    """The segments of a path, variable ones by their form; slashes at its end make none."""
    inner = F.regexp_replace(F.regexp_replace(path, r"^/", ""), r"/+\z", "")
    split = F.transform(F.split(inner, "/"), segment_class)
    return F.when(inner != "", split).otherwise(F.array().cast("array<string>"))


def _rest(segments: Column, level: int) -> Column:
    """The segments below ``level``, each after a slash; empty if there are none."""
    return F.array_join(F.transform(F.slice(segments, level + 1, MOST), lambda s: F.concat(F.lit("/"), s)), "")


def _settled(active: DataFrame, step: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """The rows with ``head`` as the levels leave it: each takes the rows that are still open."""
    done, level = [], 0
    while True:
        rows = stored(step(active, level), "url-level")
        done.append(rows.filter(~F.col("open")).drop("open"))
        active, level = rows.filter("open").drop("open"), level + 1
        if active.isEmpty():
            return reduce(DataFrame.unionByName, done)


def shape_level(rows: DataFrame, level: int) -> DataFrame:
    """``head`` with the segment of ``level``, or ``*`` below a variable node.

    A row below a node of too few urls has its whole path as head: no node further down is variable.
    """
    child = F.coalesce(F.get(segments_of(F.col("path")), F.lit(level)), F.lit(NONE))
    rows = rows.withColumn("child", child)
    children = rows.groupBy("host", "head", "child").agg(F.count("*").alias("n"))
    nodes = children.groupBy("host", "head").agg(F.sum("n").alias("rows"), F.count("*").alias("kinds"))
    large = nodes.filter(F.col("rows") >= VARIABLE_ROWS).select(
        "host", "head", (F.col("kinds") > F.col("rows") * VARIABLE_SHARE).alias("variable")
    )
    found = _look_up(rows, large, ["host", "head"]).withColumn("segments", segments_of(F.col("path")))
    taken = F.when(F.col("variable") & (F.col("child") != NONE), F.lit(WILD)).otherwise(F.col("child"))
    more = F.size("segments") > level
    head = (
        F.when(F.col("variable").isNull(), F.concat("head", _rest(F.col("segments"), level)))
        .when(more, F.concat_ws("/", "head", taken))
        .otherwise(F.col("head"))
    )
    return found.select(
        *[c for c in rows.columns if c not in ("head", "child")],
        head.alias("head"),
        (F.col("variable").isNotNull() & (F.size("segments") > level + 1)).alias("open"),
    )


def merge_level(shapes: DataFrame, level: int) -> DataFrame:
    """``head`` with the segment of ``level``, or ``*`` for a branch that is like its siblings together."""
    segments = F.slice(F.split("shape", "/"), 2, MOST)
    rows = shapes.withColumn("child", F.coalesce(F.get(segments, F.lit(level)), F.lit(NONE)))
    rows = rows.withColumn("below", _rest(segments, level + 1))
    spread = rows.groupBy("host", "head", "child", "below").agg(
        F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"), F.count("*").alias("shapes")
    )
    pool = spread.groupBy("host", "head", "below").agg(F.sum("n").alias("pool_n"))
    branch = spread.groupBy("host", "head", "child").agg(
        F.sum("n").alias("b_n"),
        F.sum("labelled").alias("b_labelled"),
        F.sum("blocked").alias("b_blocked"),
        F.max(F.col("below") != "").alias("deep"),
        F.sum("shapes").alias("shapes"),
    )
    whole = branch.groupBy("host", "head").agg(
        F.sum("b_n").alias("h_n"),
        F.sum("b_labelled").alias("h_labelled"),
        F.sum("b_blocked").alias("h_blocked"),
        F.count("*").alias("branches"),
        F.sum("shapes").alias("shapes"),
    )
    # a shape that is alone below its node has no siblings to merge with at any level
    shared = whole.filter("shapes > 1").select("host", "head", F.lit(True).alias("shared"))
    distance = (
        spread.join(pool, ["host", "head", "below"])
        .join(branch, ["host", "head", "child"])
        .join(whole, ["host", "head"])
        # half the L1 distance: what the branch lacks of the pool's shape counts the same as its excess
        .groupBy("host", "head", "child")
        .agg(
            F.sum(
                F.greatest(F.col("n") / F.col("b_n") - F.col("pool_n") / F.col("h_n"), F.lit(0.0))
            ).alias("apart"),
            F.max(F.abs(F.col("b_blocked") / F.col("b_n") - F.col("h_blocked") / F.col("h_n"))).alias("blocked_gap"),
            F.max(F.abs(F.col("b_labelled") / F.col("b_n") - F.col("h_labelled") / F.col("h_n"))).alias("label_gap"),
            F.max("branches").alias("branches"),
            F.max("deep").alias("deep"),
        )
    )
    alike = distance.filter(
        (F.col("branches") > 1)
        & (F.lit(level == 0) | F.col("deep"))
        & (F.col("apart") <= SPREAD)
        & (F.col("blocked_gap") <= AGREE)
        & (F.col("label_gap") <= AGREE)
    ).select("host", "head", "child")
    several = alike.groupBy("host", "head").agg(F.count("*").alias("alike")).filter("alike > 1").select("host", "head")
    merged = alike.join(several, ["host", "head"]).withColumn("merge", F.lit(True))
    taken = F.when(F.col("merge") & (F.col("child") != NONE), F.lit(WILD)).otherwise(F.col("child"))
    more = F.size(segments) > level
    found = _look_up(_look_up(rows, merged, ["host", "head", "child"]), shared, ["host", "head"])
    alone = F.col("shared").isNull()
    head = F.when(alone, F.concat("head", _rest(segments, level)))
    return found.select(
        *[c for c in shapes.columns if c != "head"],
        head.when(more, F.concat_ws("/", "head", taken)).otherwise(F.col("head")).alias("head"),
        (~alone & (F.size(segments) > level + 1)).alias("open"),
    )


def templates(counted: DataFrame) -> DataFrame:
    """host, path, its ``template`` and whether the template is rejected (``blocked_by``).

    ``counted`` has one row per host and path: n urls, of which ``labelled`` and ``blocked``.
    """
    salt = F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")
    rows = counted.withColumn("salt", salt).withColumn("head", F.lit(""))

    # 2. variable nodes, from the top
    rows = _settled(rows, shape_level).withColumnRenamed("head", "shape")

    # 3. branches against the pool of their parent, from the top; equal shapes are one row
    sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
    shapes = rows.groupBy("host", "shape").agg(*sums).withColumn("head", F.lit(""))
    shapes = shapes.withColumn("salt", F.pmod(F.xxhash64("host", "shape"), F.lit(SALTS)).cast("int"))
    merged = _settled(shapes, merge_level).select("host", "shape", F.col("head").alias("template"))
    rows = _look_up(rows, merged, ["host", "shape"])
    rows = rows.withColumn("template", F.regexp_replace("template", r"/+\z", "")).drop("shape")

    # 4. purity
    known = rows.groupBy("host", "template").agg(
        F.sum("n").alias("t_n"), F.sum("labelled").alias("t_labelled"), F.sum("blocked").alias("t_blocked")
    )
    purity = (F.col("t_blocked") + PRIOR * SMOOTHING) / (F.col("t_labelled") + SMOOTHING)
    rejected = known.select(
        "host",
        "template",
        purity.alias("purity"),
        ((purity >= REJECT) & (F.col("t_labelled") >= F.col("t_n") * SUPPORT)).alias("rejected"),
    )
    return _look_up(rows, rejected, ["host", "template"]).select("host", "path", "template", "purity", "rejected")


def judge(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every page."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    decided = parsed.withColumn("by_rule", rule_of(F.col("host"), F.col("path"), rules))
    known = F.col("by_rule").isNotNull().cast("int")
    bad = F.coalesce(F.col("by_rule.verdict") == "block", F.lit(False)).cast("int")
    counted = (
        decided.filter(F.col("host") != "")
        .groupBy("host", "path")
        .agg(F.count("*").alias("n"), F.sum(known).alias("labelled"), F.sum(bad).alias("blocked"))
    )
    found = templates(counted)
    # a path repeated by a third of the urls meets one row of its own here; copies of it are salted
    pages_salted = decided.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    judged = _look_up(pages_salted, found, ["host", "path"])
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("by_rule.rule").alias("rule"),
        F.when(F.col("by_rule").isNotNull(), F.col("by_rule.verdict"))
        .when(F.coalesce("rejected", F.lit(False)), F.lit("block"))
        .otherwise(F.lit("allow"))
        .alias("verdict"),
        F.coalesce("template", F.lit("")).alias("template"),
        "purity",
    )
