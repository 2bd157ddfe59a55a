"""Diagnostics of page layout: lines matched with boxes, two columns inferred from geometry alone, and cells of tables.

A page is the group of all windows here; its lines are few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import udfs

#: Share of the smaller box that must overlap, and least intersection over union of a match; fixed values.
OVERLAP, MATCH = 0.5, 0.5
#: Gap between bands and least gutter in median heights, least gutter in page widths, lines of a dense band and of a column; fixed values.
BAND_GAP, GUTTER_HEIGHTS, GUTTER_WIDTHS, DENSE, COLUMN = 2.5, 2.0, 0.015, 6, 3


def matched_lines(lines: DataFrame, boxes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of every line (page, line_id, ord) its status and its box, and of every box (page, box_id) how many lines it overlaps.

    Both have left, top, right and bottom.  A line and a box are joined if they overlap in half of the smaller one at least.
    A line without a box is no_overlap, with several split_or_ambiguous; with one that has other lines merge_or_ambiguous; with
    one that fits badly weak_geometry; else one_to_one.  Nothing ambiguous is forced into a match.
    """
    width = F.least("l.right", "b.right") - F.greatest("l.left", "b.left")
    height = F.least("l.bottom", "b.bottom") - F.greatest("l.top", "b.top")
    area = lambda s: (F.col(f"{s}.right") - F.col(f"{s}.left")) * (F.col(f"{s}.bottom") - F.col(f"{s}.top"))
    joined = lines.alias("l").join(boxes.alias("b"), (F.col("l.page") == F.col("b.page")) & (width > 0) & (height > 0))
    shared = width * height
    edges = joined.where(shared >= OVERLAP * F.least(area("l"), area("b"))).select(F.col("l.page").alias("page"), "line_id", "box_id", (shared / (area("l") + area("b") - shared)).alias("iou"))
    held = edges.groupBy("page", "box_id").agg(F.count("*").alias("lines"))
    of_line = edges.join(held, ["page", "box_id"]).groupBy("page", "line_id").agg(F.count("*").alias("boxes"), F.min("box_id").alias("one"), F.min("lines").alias("shared"), F.min("iou").alias("iou"))
    own = lines.select("page", "line_id", "ord").join(of_line, ["page", "line_id"], "left")
    status = F.when(F.col("boxes").isNull(), "no_overlap").when(F.col("boxes") > 1, "split_or_ambiguous").when(F.col("shared") > 1, "merge_or_ambiguous").when(F.col("iou") < MATCH, "weak_geometry").otherwise("one_to_one")
    told = own.withColumn("status", status).select("page", "line_id", "ord", "status", F.when(F.col("status") == "one_to_one", F.col("one")).alias("box_id"))
    return told, boxes.select("page", "box_id").join(held, ["page", "box_id"], "left").fillna(0, ["lines"])


def stage_counts(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """page and the counts, recall, precision and inversions of a detection stage (see ``matched_lines``); box ids are in the stage's order."""
    of_line, of_box = matched_lines(lines, boxes)
    n = lambda c: F.count(F.when(c, 1))
    is_ = lambda s: F.col("status") == s
    order = F.transform(F.array_sort(F.collect_list(F.when(is_("one_to_one"), F.struct("ord", "box_id")))), lambda x: x["box_id"].cast("int"))
    left = of_line.groupBy("page").agg(
        F.count("*").alias("reference_lines"), n(is_("one_to_one")).alias("matched_lines"), n(is_("no_overlap")).alias("no_overlap_lines"),
        n(is_("split_or_ambiguous")).alias("split_candidates"), n(is_("weak_geometry")).alias("weak_pairs"), order.alias("order"),
    )
    right = of_box.groupBy("page").agg(F.count("*").alias("observed_boxes"), n(F.col("lines") > 1).alias("merge_candidates"), n(F.col("lines") == 0).alias("unmatched_boxes"))
    both = left.join(right, "page", "full").fillna(0)
    pairs = F.floor(F.col("matched_lines") * (F.col("matched_lines") - 1) / 2)
    ratio = lambda a, b: F.col(a) / F.nullif(F.col(b), F.lit(0))
    return both.select(
        "page", *[c for c in both.columns if c not in ("page", "order")], udfs.inversions(F.coalesce("order", F.array().cast("array<int>"))).cast("long").alias("order_inversions"), pairs.alias("comparable_pairs"),
        ratio("matched_lines", "reference_lines").alias("line_recall"), ratio("matched_lines", "observed_boxes").alias("box_precision"),
    )


def inferred_columns(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """page, status, reason, the body's top and bottom and the gutter's sides (as shares of the page), and the order of the lines.

    ``lines``: page, line (the engine's order), left, top, right, bottom (null: no upright box); ``pages``: page, width, height.  Lines
    fall into bands where a gap of 2.5 median heights separates them; in the one dense band, x-intervals that overlap are merged by a sweep, and
    there must be two with a gutter between.  Then every line must lie whole above, below, left or right, in the engine's order within
    each; else the page is ``abstained``, with the first reason that holds.  Otherwise the hypothesis is
    ``unconfirmed_hypothesis``: lines above, left, right, below.
    """
    page = W.partitionBy("page")
    down, across = page.orderBy("top", "bottom", "line"), W.partitionBy("page", "band").orderBy("left", "right", "line")
    before = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    upto = lambda w: w.rowsBetween(W.unboundedPreceding, 0)
    box = F.col("left").isNotNull() & F.col("top").isNotNull() & F.col("right").isNotNull() & F.col("bottom").isNotNull()
    own = lines.select("page", "line", *[F.col(c).cast("double").alias(c) for c in ("left", "top", "right", "bottom")]).join(pages.select("page", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height")), "page")
    own = own.withColumns({"odd": F.max((~box).cast("int")).over(page), "typical": F.median(F.col("bottom") - F.col("top")).over(page)})
    opens = F.coalesce(F.col("top") - F.max("bottom").over(before(down)) > BAND_GAP * F.col("typical"), F.lit(False))
    own = own.withColumn("opens", opens.cast("int")).withColumn("band", F.sum("opens").over(upto(down)))
    own = own.withColumn("size", F.count("*").over(W.partitionBy("page", "band")))
    own = own.withColumn("dense", F.size(F.collect_set(F.when(F.col("size") >= DENSE, F.col("band"))).over(page)))
    own = own.withColumn("body", F.max(F.when(F.col("size") >= DENSE, F.col("band"))).over(page))
    starts = F.coalesce(F.col("left") > F.max("right").over(before(across)), F.lit(False))
    own = own.withColumn("starts", starts.cast("int")).withColumn("part", F.sum("starts").over(upto(across)))
    inside = F.col("band") == F.col("body")
    of = lambda f, c, k: f(F.when(inside & k, F.col(c))).over(page)
    every, first, second = F.lit(True), F.col("part") == 0, F.col("part") == 1
    own = own.withColumns(
        {
            "parts": F.max(F.when(inside, F.col("part"))).over(page) + 1,
            "fewest": F.least(of(F.count, "line", first), of(F.count, "line", second)),
            "a": of(F.max, "right", first), "b": of(F.min, "left", second), "upper": of(F.min, "top", every), "lower": of(F.max, "bottom", every),
            "over": F.coalesce(F.max(F.when(F.col("band") == F.col("body") - 1, F.col("bottom"))).over(page), F.lit(0.0)),
            "under": F.coalesce(F.min(F.when(F.col("band") == F.col("body") + 1, F.col("top"))).over(page), F.col("height")),
        }
    )
    gutter = F.col("b") - F.col("a")
    own = own.withColumns(
        {
            "body_top": (F.col("over") + F.col("upper")) / (2 * F.col("height")), "body_bottom": (F.col("lower") + F.col("under")) / (2 * F.col("height")),
            "gutter_left": (F.col("a") + gutter / 3) / F.col("width"), "gutter_right": (F.col("b") - gutter / 3) / F.col("width"),
        }
    )
    y0, y1 = F.col("body_top") * F.col("height"), F.col("body_bottom") * F.col("height")
    x0, x1 = F.col("gutter_left") * F.col("width"), F.col("gutter_right") * F.col("width")
    group = F.when(F.col("bottom") <= y0, 0).when(F.col("top") >= y1, 3).when((F.col("top") < y0) | (F.col("bottom") > y1), -2).when(F.col("right") <= x0, 1).when(F.col("left") >= x1, 2).otherwise(-1)
    own = own.withColumn("group", group)
    lane = W.partitionBy("page", "group").orderBy("line")
    third = F.when(F.col("group").isin(1, 2), 1).otherwise(F.col("group"))
    back = third < F.max(third).over(before(page.orderBy("line")))
    crossed = F.when(F.col("group") < 0, F.struct("line", "group"))
    told = own.withColumns({"back": F.coalesce(back, F.lit(False)), "overlaps": F.col("group").isin(1, 2) & F.coalesce(F.col("top") < F.lag("bottom").over(lane), F.lit(False))})
    same = [F.first(c).alias(c) for c in ("odd", "dense", "parts", "fewest", "a", "b", "typical", "width", "body_top", "body_bottom", "gutter_left", "gutter_right")]
    n = lambda k: F.count(F.when(F.col("group") == k, 1))
    found = told.groupBy("page").agg(
        *same, F.min(crossed)["group"].alias("crossed"), F.max("back").alias("back"), F.max("overlaps").alias("overlaps"), F.least(n(1), n(2)).alias("least"),
        F.array_sort(F.collect_list(F.struct("group", "line"))).alias("placed"), F.array_sort(F.collect_list("line")).alias("lines"),
    )
    narrow = F.col("b") - F.col("a") < F.greatest(F.col("typical") * GUTTER_HEIGHTS, F.col("width") * GUTTER_WIDTHS)
    reason = (
        F.when(F.col("odd") == 1, "ambiguous_geometry").when(F.col("dense") != 1, "no_unique_dense_body_band").when(F.col("parts") != 2, "not_exactly_two_disjoint_x_components")
        .when(F.col("fewest") < COLUMN, "insufficient_column_support").when(narrow, "gutter_support_too_narrow").when(F.col("crossed") == -2, "body_boundary_crossed")
        .when(F.col("crossed") == -1, "gutter_crossed").when(F.col("back"), "noncontiguous_body").when(F.col("least") < COLUMN, "insufficient_columns").when(F.col("overlaps"), "overlapping_or_reversed_lines")
    )
    order = F.transform("placed", lambda x: x["line"])
    good = reason.isNull()
    shown = [F.when(good, F.col(c)).alias(c) for c in ("body_top", "body_bottom", "gutter_left", "gutter_right")]
    why = F.coalesce(reason, F.when(order == F.col("lines"), "already_engine_ordered_hypothesis").otherwise("geometry_two_column_hypothesis"))
    return found.select("page", F.when(good, "unconfirmed_hypothesis").otherwise("abstained").alias("status"), why.alias("reason"), *shown, F.when(good, order).alias("line_order"))


def cell_counts(cohort: DataFrame) -> DataFrame:
    """split and the sums of matched, missing and extra regions, and of correct, wrong, missing and extra table cells, with the cells' accuracy.

    ``cohort``: id, split, reference and prediction (arrays of region ids), reference_cells and prediction_cells (arrays of
    region_id, table, row, column, row_span, column_span); a cell is correct if it is all the same.
    """
    size = lambda c: F.size(c).cast("long")
    ids = lambda c: F.array_distinct(F.transform(c, lambda x: x["region_id"]))
    known = F.array_intersect(ids("reference_cells"), ids("prediction_cells"))
    correct: Column = size(F.array_intersect("reference_cells", "prediction_cells"))
    own = cohort.select(
        "split", size(F.array_intersect("reference", "prediction")).alias("matched_regions"), size(F.array_except("reference", "prediction")).alias("missing_regions"),
        size(F.array_except("prediction", "reference")).alias("extra_regions"), size(ids("reference_cells")).alias("reference_table_cells"), correct.alias("correct_table_cells"),
        (size(known) - correct).alias("wrong_table_cells"), (size(ids("reference_cells")) - size(known)).alias("missing_table_cells"), (size(ids("prediction_cells")) - size(known)).alias("extra_table_cells"),
    )
    sums = own.groupBy("split").agg(*[F.sum(c).alias(c) for c in own.columns[1:]])
    return sums.withColumn("table_cell_accuracy", F.col("correct_table_cells") / F.nullif(F.col("reference_table_cells"), F.lit(0)))


def cell_grid(cells: DataFrame) -> DataFrame:
    """table, row and column of every place that the cells (table, row, column, row_span, column_span, region_id) of tables cover, with region_id.

    A place that two cells cover has a row for each.
    """
    rows = F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1))
    columns = F.explode(F.sequence(F.col("column"), F.col("column") + F.col("column_span") - 1))
    return cells.select("table", "region_id", "column", "column_span", rows.alias("row")).select("table", "region_id", "row", columns.alias("column"))


def grid_accuracy(reference: DataFrame, prediction: DataFrame) -> DataFrame:
    """table, places of the reference's grid, places, of either, whose cell agrees in text, and their share: spans count with all they cover.

    Both: table, row, column, row_span, column_span, region_id, text.
    """
    def grid(cells: DataFrame, name: str) -> DataFrame:
        return cell_grid(cells).join(cells.select("table", "region_id", "text"), ["table", "region_id"]).groupBy("table", "row", "column").agg(F.min("text").alias(name))

    both = grid(reference, "a").join(grid(prediction, "b"), ["table", "row", "column"], "full")
    sums = both.groupBy("table").agg(F.count("a").alias("reference_places"), F.count("*").alias("all_places"), F.count(F.when(F.col("a") == F.col("b"), 1)).alias("agreeing"))
    return sums.withColumn("agreement", F.col("agreeing") / F.col("all_places"))
