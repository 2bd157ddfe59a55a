"""Transcription diagnostics: context checks, paired outcomes and printed page numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.operators import records


def _places(text: Column, anchor: Column) -> Column:
    """0, 1 or 2 for none, one or several occurrences, overlapping ones counted."""
    first = F.instr(text, anchor)
    again = F.position(anchor, text, first + 1)
    return F.when(first == 0, 0).when(again == 0, 1).otherwise(2)


def context_checks(checks: DataFrame) -> DataFrame:
    """``checks`` with status and reason.

    Rows: text (of the candidate context, null if there is none), left_anchor, right_anchor, expected.  A check passes
    only if both anchors (where not empty) occur once, in order, and what stands between them is what is expected.
    """
    left, right, text = F.col("left_anchor"), F.col("right_anchor"), F.col("text")
    start = F.when(left == "", 1).otherwise(F.instr(text, left) + F.length(left))
    end = F.when(right == "", F.length(text) + 1).otherwise(F.instr(text, right))
    between = F.substring(text, start, end - start)
    reason = (
        F.when(text.isNull(), "not_available")
        .when(F.trim(text) == "", "empty_candidate_context")
        .when((left != "") & (_places(text, left) == 0) | (right != "") & (_places(text, right) == 0), "anchor_missing")
        .when((left != "") & (_places(text, left) == 2) | (right != "") & (_places(text, right) == 2), "anchor_repeated")
        .when(start > end, "anchor_order_changed")
        .when(between == F.col("expected"), "exact_occurrence_match")
        .otherwise("occurrence_differs")
    )
    status = F.when(reason == "exact_occurrence_match", "passed").when(reason == "not_available", "abstained").otherwise(F.when(reason.isin("occurrence_differs", "empty_candidate_context"), "failed").otherwise("abstained"))
    return checks.withColumn("reason", reason).withColumn("status", status)


def paired_outcomes(baseline: DataFrame, retry: DataFrame, measures: list[str]) -> DataFrame:
    """id, deltas and outcome (improved, unchanged, regressed, mixed); fewer is better, ids must agree."""
    one, two = baseline.select("id", *[F.col(m).alias(f"{m}_1") for m in measures]), retry.select("id", *[F.col(m).alias(f"{m}_2") for m in measures])
    joined = one.withColumn("a", F.lit(True)).join(two.withColumn("b", F.lit(True)), "id", "full_outer")
    checked = joined.withColumn("paired", F.when(F.col("a").isNull() | F.col("b").isNull(), F.raise_error(F.lit("ids differ"))).otherwise(True))
    deltas = [(F.col(f"{m}_2") - F.col(f"{m}_1")).alias(f"{m}_delta") for m in measures]
    own = checked.where("paired").select("id", *deltas)
    values = F.array(*[F.col(f"{m}_delta").cast("double") for m in measures])
    better, worse = F.exists(values, lambda x: x < 0), F.exists(values, lambda x: x > 0)
    return own.withColumn("outcome", F.when(better & worse, "mixed").when(worse, "regressed").when(better, "improved").otherwise("unchanged"))


def page_number_furniture(items: DataFrame, support: int = 3, tolerance: float = 0.02) -> DataFrame:
    """doc and ref of numeric text items that are printed page numbers in the margin lane of labelled ones.

    ``items``: doc, ref, page, label (page_header, page_footer or text), printed, edge (top or bottom), ratio (distance
    from that edge over the page's height).  Each page has one vote for page minus printed number; pages whose votes differ
    have none; the leading difference needs ``support`` pages and more than half of all.
    """
    own = items.withColumn("delta", F.col("page") - F.col("printed"))
    labelled = own.where(((F.col("label") == "page_header") & (F.col("edge") == "top")) | ((F.col("label") == "page_footer") & (F.col("edge") == "bottom")))
    votes = labelled.groupBy("doc", "page").agg(F.min("delta").alias("delta"), F.countDistinct("delta").alias("n")).where("n = 1")
    counts = votes.groupBy("doc", "delta").agg(F.count("*").alias("support"))
    totals = votes.groupBy("doc").agg(F.count("*").alias("pages"))
    leading = counts.join(totals, "doc").where((F.col("support") >= support) & (F.col("support") * 2 > F.col("pages"))).select("doc", "delta")
    lanes = labelled.join(leading, ["doc", "delta"]).groupBy("doc", "delta", "edge").agg(F.sort_array(F.collect_list("ratio")).alias("r"))
    centres = lanes.select("doc", "delta", "edge", F.element_at("r", (F.floor(F.size("r") / 2) + 1).cast("int")).alias("centre"))
    found = own.where("label = 'text'").join(centres, ["doc", "delta", "edge"])
    return found.where(F.abs(F.col("ratio") - F.col("centre")) <= tolerance).select("doc", "ref")


def assign_lines(regions: DataFrame, lines: DataFrame) -> DataFrame:
    """page, line_id, candidates (regions that hold the line whole) and region_id where there is just one."""
    whole = (F.col("l.left") >= F.col("r.left")) & (F.col("l.right") <= F.col("r.right")) & (F.col("l.top") >= F.col("r.top")) & (F.col("l.bottom") <= F.col("r.bottom"))
    joined = lines.alias("l").join(regions.alias("r"), (F.col("l.page") == F.col("r.page")) & whole, "left")
    counted = joined.groupBy(F.col("l.page").alias("page"), F.col("l.line_id").alias("line_id")).agg(F.count("r.region_id").alias("candidates"), F.min("r.region_id").alias("one"))
    return counted.select("page", "line_id", "candidates", F.when(F.col("candidates") == 1, F.col("one")).alias("region_id"))


def omission_status(regions: DataFrame, lines: DataFrame) -> DataFrame:
    """status (no_recovered_line, one_line, several_lines), regions and pages: how many recovered lines touch the regions."""
    touches = records.boxes_overlap(regions, lines).groupBy("page", "region_id").agg(F.count("*").alias("n"))
    own = regions.select("page", "region_id").join(touches, ["page", "region_id"], "left")
    status = F.when(F.col("n").isNull(), "no_recovered_line").when(F.col("n") == 1, "one_line").otherwise("several_lines")
    return own.groupBy(status.alias("status")).agg(F.count("*").alias("regions"), F.countDistinct("page").alias("pages"))


def overlap_graph(regions: DataFrame, lines: DataFrame, share: float = 0.5) -> DataFrame:
    """page, region_id, line_id, iou and kind of the pairs that overlap in ``share`` of the smaller one at least.

    kind: one_to_one, split (a region with several lines), merge (a line with several regions) or tangled (both).
    """
    width = F.least("l.right", "r.right") - F.greatest("l.left", "r.left")
    height = F.least("l.bottom", "r.bottom") - F.greatest("l.top", "r.top")
    area = lambda s: (F.col(f"{s}.right") - F.col(f"{s}.left")) * (F.col(f"{s}.bottom") - F.col(f"{s}.top"))
    joined = regions.alias("r").join(lines.alias("l"), (F.col("r.page") == F.col("l.page")) & (width > 0) & (height > 0))
    edges = joined.where(width * height >= share * F.least(area("l"), area("r"))).select(F.col("r.page").alias("page"), "region_id", "line_id", (width * height / (area("l") + area("r") - width * height)).alias("iou"))
    degree = lambda c: F.count("*").over(W.partitionBy("page", c))
    own = edges.withColumn("x", degree("region_id")).withColumn("y", degree("line_id"))
    kind = F.when((F.col("x") == 1) & (F.col("y") == 1), "one_to_one").when((F.col("x") > 1) & (F.col("y") == 1), "split").when(F.col("x") == 1, "merge").otherwise("tangled")
    return own.select("page", "region_id", "line_id", "iou", kind.alias("kind"))


def check_totals(checked: DataFrame, category: str) -> DataFrame:
    """category, status and n of checked rows."""
    return checked.groupBy(category, "status").agg(F.count("*").alias("n"))


def run_comparison(reference: DataFrame, baseline: DataFrame, retry: DataFrame) -> DataFrame:
    """page, both statuses and outcome of every reference page; (page, status, errors) of two runs.

    A page that either run has not recovered is not comparable; else fewer errors is improved, more is regressed.
    """
    one, two = (df.select("page", F.col("status").alias(f"{n}_status"), F.col("errors").alias(f"{n}_errors")) for df, n in ((baseline, "baseline"), (retry, "retry")))
    both = reference.select("page").join(one, "page", "left").join(two, "page", "left").fillna("not_requested", ["baseline_status", "retry_status"])
    delta = F.col("retry_errors") - F.col("baseline_errors")
    known = (F.col("baseline_status") == "recovered") & (F.col("retry_status") == "recovered")
    return both.select("page", "baseline_status", "retry_status", F.when(~known | delta.isNull(), "not_comparable").when(delta < 0, "improved").when(delta > 0, "regressed").otherwise("unchanged").alias("outcome"))


def rectangle(quad: Column, slope: float = 0.1) -> Column:
    """left, top, right and bottom of four (x, y) corners from the upper left, clockwise, if their sides are nearly upright and level, else null."""
    p = [quad[i] for i in range(4)]
    across = lambda a, b: (F.abs(b["y"] - a["y"]) <= slope * F.abs(b["x"] - a["x"])) & (b["x"] > a["x"])
    down = lambda a, b: (F.abs(b["x"] - a["x"]) <= slope * F.abs(b["y"] - a["y"])) & (b["y"] > a["y"])
    good = across(p[0], p[1]) & down(p[1], p[2]) & across(p[3], p[2]) & down(p[0], p[3])
    box = F.struct(F.least(p[0]["x"], p[3]["x"]).alias("left"), F.least(p[0]["y"], p[1]["y"]).alias("top"), F.greatest(p[1]["x"], p[2]["x"]).alias("right"), F.greatest(p[2]["y"], p[3]["y"]).alias("bottom"))
    return F.when(good, box)


def polygon_area(points: Column) -> Column:
    """The area of a polygon of (x, y) points, by the shoelace formula."""
    ahead = F.concat(F.slice(points, 2, F.size(points) - 1), F.slice(points, 1, 1))
    terms = F.zip_with(points, ahead, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2


def clipped_polygon(points: list[tuple[float, float]], left: float, top: float, right: float, bottom: float) -> list[tuple[float, float]]:
    """The part of a convex polygon inside a box, cut by one side of the box after another."""
    for axis, limit, sign in ((0, left, 1), (0, right, -1), (1, top, 1), (1, bottom, -1)):
        inside = lambda p, a=axis, m=limit, s=sign: s * (p[a] - m) >= 0
        out = []
        for p, q in zip(points, [*points[1:], *points[:1]]):
            if inside(p):
                out.append(p)
            if inside(p) != inside(q):
                t = (limit - p[axis]) / (q[axis] - p[axis])
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        points = out
    return points


def nearest_binary32(numerator: int, denominator: int) -> float:
    """The single-precision number nearest to a fraction, ties to even, without rounding twice."""
    from fractions import Fraction

    value = abs(Fraction(numerator, denominator))
    if not value:
        return 0.0
    power = value.numerator.bit_length() - value.denominator.bit_length()
    power -= value < Fraction(2) ** power
    step = Fraction(2) ** (max(power, -126) - 23)
    whole = round(value / step)  # to even on ties
    result = float(whole * step)
    if result >= 2.0**128:
        raise OverflowError("beyond single precision")
    return -result if (numerator < 0) != (denominator < 0) else result
