"""Geometry and hierarchies over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.spans import column_totals
from tracewell.session import cut_lineage


def boxes_to_cells(boxes: DataFrame, page: str, size: float) -> DataFrame:
    """Every grid cell that a box (x0, y0, x1, y1) touches."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size))
    return boxes.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))


def outside_boxes(points: DataFrame, boxes: DataFrame, page: str, x: str, y: str, size: float) -> DataFrame:
    """Points whose page has no box around them: anti join on (page, grid cell) plus the test.

    The cell is part of the join key, so a page with very many points spreads over many tasks
    and a point meets only the boxes near it.
    """
    cells = boxes_to_cells(boxes, page, size).select(F.col(page).alias("_p"), "cx", "cy", "x0", "y0", "x1", "y1")
    placed = points.withColumns({"_cx": F.floor(F.col(x) / size), "_cy": F.floor(F.col(y) / size)})
    hit = (
        (F.col(page) == F.col("_p")) & (F.col("_cx") == F.col("cx")) & (F.col("_cy") == F.col("cy"))
        & F.col(x).between(F.col("x0"), F.col("x1")) & F.col(y).between(F.col("y0"), F.col("y1"))
    )
    return placed.join(cells, hit, "left_anti").drop("_cx", "_cy")


def _joined(upper: Column, lower: Column, separator: str) -> Column:
    return F.when(upper == "", lower).when(lower == "", upper).otherwise(F.concat(upper, F.lit(separator), lower))


def parent_paths(nodes: DataFrame, node: str, parent: str, title: str, separator: str = " > ") -> DataFrame:
    """Titles from the root down to each node; a missing parent or a cycle ends the path.

    Every round replaces the ancestor of each row by that ancestor's ancestor, so a tree of
    depth d takes about log2(d) rounds. Rows that never reach a root hang on a cycle; only
    those are walked step by step with the visited ids at hand.
    """
    base = nodes.select(F.col(node).alias("id"), F.col(parent).alias("at"), F.coalesce(F.col(title), F.lit("")).alias("path"))
    ids = base.select(F.col("id").alias("_id"))
    base = base.join(ids, base["at"] == ids["_id"], "left").select("id", F.col("_id").alias("at"), "path")
    base = cut_lineage(base)
    done, waiting = [base.where("at IS NULL")], base.where("at IS NOT NULL")
    left = waiting.count()
    while left:
        # Only waiting rows move; finished ones are looked up.
        known = reduce(DataFrame.unionByName, done, waiting)
        upper = known.select(F.col("id").alias("at"), F.col("at").alias("u_at"), F.col("path").alias("u_path"))
        moved = cut_lineage(waiting.join(upper, "at").select("id", F.col("u_at").alias("at"), _joined(F.col("u_path"), F.col("path"), separator).alias("path")))
        done.append(moved.where("at IS NULL"))
        waiting = moved.where("at IS NOT NULL")
        before, left = left, waiting.count()
        if left == before:
            break
    finished = reduce(DataFrame.unionByName, done).select(F.col("id").alias(node), "path")
    if not left:
        return finished
    stuck = base.join(waiting.select("id"), "id", "left_semi")
    return finished.unionByName(_walk(base, stuck, separator).withColumnRenamed("id", node))


def _walk(base: DataFrame, rows: DataFrame, separator: str) -> DataFrame:
    """Step-by-step walk for rows on or below a cycle."""
    lookup = base.select(F.col("id").alias("_id"), F.col("at").alias("_up"), F.col("path").alias("_t"))
    current = cut_lineage(rows.withColumn("seen", F.array("id")))
    done: list[DataFrame] = []
    while True:
        joined = current.join(lookup, F.col("at") == F.col("_id"), "left")
        go = F.col("_id").isNotNull() & ~F.array_contains("seen", F.col("_id"))
        moved = cut_lineage(joined.select(
            "id", F.when(go, F.col("_up")).alias("at"),
            F.when(go, _joined(F.col("_t"), F.col("path"), separator)).otherwise(F.col("path")).alias("path"),
            F.when(go, F.array_append("seen", F.col("_id"))).otherwise(F.col("seen")).alias("seen"), go.alias("go")))
        done.append(moved.where("NOT go").select("id", "path"))
        current = moved.where("go").drop("go")
        if current.isEmpty():
            return reduce(DataFrame.unionByName, done)


def or_by_group(rows: DataFrame, group: str, test: Column, name: str) -> DataFrame:
    return rows.groupBy(group).agg(F.bool_or(test).alias(name))


def coalesce_blocks(blocks: DataFrame, document: str, *, max_chars: int, gap: float = 28.0, overlap: float = 12.0) -> DataFrame:
    """Merge neighbouring blocks of a page whose boxes are close, up to ``max_chars``.

    ``blocks``: document, page, position, text, bbox, location. One page holds few blocks, and a
    merged block never spans pages, so windows are per page. Blocks without a page or box, as texts
    and paragraphs have, stay as they are and are not gathered.
    """
    from tracewell.functions.packing import pack_blocks

    placed = F.col("page").isNotNull() & (F.size("bbox") == 4)
    alone = blocks.where(~F.coalesce(placed, F.lit(False))).select(
        document, "page", "position", "text", "location", "bbox", F.array(F.struct("text", "location", "bbox")).alias("source_spans"))
    blocks = blocks.where(placed)
    page = Window.partitionBy(document, "page").orderBy("position")
    before = F.lag("bbox").over(page)
    close = (
        (F.get("bbox", 1) - F.get(before, 3) <= gap)
        & (F.least(F.get(before, 2), F.get("bbox", 2)) - F.greatest(F.get(before, 0), F.get("bbox", 0)) >= -overlap)
    )
    marked = blocks.withColumn("_new", F.when(F.coalesce(close, F.lit(False)), 0).otherwise(1))
    runs = marked.withColumn("_run", F.sum("_new").over(page.rowsBetween(Window.unboundedPreceding, 0)))
    held = runs.groupBy(document, "page").agg(F.array_sort(F.collect_list(F.struct("position", "text", "bbox", "location", "_run"))).alias("b"))
    packed = held.withColumn("_w", pack_blocks(max_chars, 0)(
        F.transform("b", lambda x: F.length(x["text"])), F.transform("b", lambda x: x["_run"].cast("string"))))
    rows = packed.select(document, "page", "b", F.explode("_w").alias("w")).withColumn(
        "m", F.slice("b", F.col("w.start") + 1, F.col("w.stop") - F.col("w.start")))
    edge = lambda i, f: f(F.transform("m", lambda x: F.get(x["bbox"], i)))
    first, last = F.get("m", 0), F.element_at("m", -1)
    merged = rows.select(
        document, "page", first["position"].alias("position"), F.array_join("m.text", "\n").alias("text"),
        F.when(F.size("m") == 1, first["location"]).otherwise(F.concat(first["location"], F.lit(".."), last["location"])).alias("location"),
        F.array(edge(0, F.array_min), edge(1, F.array_min), edge(2, F.array_max), edge(3, F.array_max)).alias("bbox"),
        F.transform("m", lambda x: F.struct(x["text"].alias("text"), x["location"].alias("location"), x["bbox"].alias("bbox"))).alias("source_spans"))
    return merged.unionByName(alone)


def unpivoted(grids: DataFrame, key: str, lengths: str) -> DataFrame:
    """One row (key, column_id, cells, last_row, chars) per column of a grid, given as lines of cell lengths.

    A grid's columns are counted in its row and stay one list until the end: grids are shuffled and held,
    not their columns. Grids of the same key count together.
    """
    def both(a: Column, b: Column) -> Column:
        sums = {c: F.coalesce(a[c], F.lit(0)) + F.coalesce(b[c], F.lit(0)) for c in ("cells", "chars")}
        return F.struct(sums["cells"].alias("cells"), F.greatest(a["last_row"], b["last_row"]).alias("last_row"), sums["chars"].alias("chars"))

    lists = grids.select(key, column_totals(lengths).alias("t")).groupBy(key).agg(F.collect_list("t").alias("all"))
    one = F.aggregate(F.slice("all", F.lit(2), F.size("all")), F.get("all", F.lit(0)), lambda held, x: F.zip_with(held, x, both))
    return lists.select(key, F.posexplode_outer(one).alias("c", "t")).where("c IS NOT NULL").select(key, F.concat(F.lit("c"), F.col("c").cast("string")).alias("column_id"), "t.*")
