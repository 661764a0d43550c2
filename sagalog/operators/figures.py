"""Clustering of adjacent image panels into figures, and stitched metadata."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import TOLERANCE, adjacency

BOX = ["bbox_x", "bbox_y", "bbox_w", "bbox_h"]


def adjacent_pairs(images: DataFrame, keys: list[str], tol: float = TOLERANCE) -> DataFrame:
    """(keys, i, j, layout) of adjacent panels of a page, i < j in stream order.

    The lower edges or left edges of adjacent panels differ by a panel's size,
    so the join is on the page and on one shared coordinate, rounded to cells of
    the tolerance; a page with many panels is not compared all with all.
    """
    cell = max(tol, 1e-9) * 4
    side = images.where("bbox_w != 0").select(*keys, "ord", *BOX)
    left = side.select(*keys, *[F.col(c).alias(f"a_{c}") for c in ["ord", *BOX]])
    right = side.select(*keys, *[F.col(c).alias(f"b_{c}") for c in ["ord", *BOX]])
    found = []
    for axis, layout in (("x", "vertical"), ("y", "horizontal")):
        at = F.floor(F.col(f"a_bbox_{axis}") / cell)
        cells = F.array_distinct(F.array(F.floor((F.col(f"b_bbox_{axis}") - tol) / cell), F.floor((F.col(f"b_bbox_{axis}") + tol) / cell)))
        pairs = left.withColumn("cell", at).join(right.withColumn("cell", F.explode(cells)), [*keys, "cell"]).where("a_ord < b_ord")
        found.append(pairs.withColumn("layout", adjacency("a_", "b_", tol)).where(F.col("layout") == layout).select(*keys, F.col("a_ord").alias("i"), F.col("b_ord").alias("j"), "layout"))
    return found[0].unionByName(found[1])


def _joined(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(panel, smallest panel of its group) for every panel in a link."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in links:
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in sorted(root)]


def panel_groups(boxes: list[tuple], tol: float = TOLERANCE) -> list[tuple[list[int], str]]:
    """(places of the panels, layout) of each figure of several panels, from the boxes of one page.

    The rule of ``adjacency`` and ``figures`` for a page that one task holds. Equal boxes are one node, so that copies of a
    panel cost nothing but their votes; nodes meet by the cell of the corner at which one begins and the other ends.
    """
    cell = max(tol, 1e-9) * 4
    nodes: dict[tuple, list[int]] = {}
    for at, box in enumerate(boxes):
        if box[2] and None not in box:
            nodes.setdefault(box, []).append(at)
    if sum(map(len, nodes.values())) < 2:
        return []
    known = list(nodes)
    corner: dict[tuple, list[int]] = {}
    for n, (x, y, _, _) in enumerate(known):
        corner.setdefault((x // cell, y // cell), []).append(n)
    layouts: dict[tuple[int, int], str] = {}
    for n, (x, y, w, h) in enumerate(known):
        for to_x, to_y in ((x + w, y), (x, y + h)):
            for a in {(to_x - cell / 2) // cell, (to_x + cell / 2) // cell}:
                for b in {(to_y - cell / 2) // cell, (to_y + cell / 2) // cell}:
                    for m in corner.get((a, b), ()):
                        if (n != m or len(nodes[known[n]]) > 1) and (layout := _layout(known[n], known[m], tol)):
                            layouts[min(n, m), max(n, m)] = layout
    group, votes, members = dict(_joined(list(layouts))), {}, {}
    for (n, m), layout in layouts.items():
        a, b = len(nodes[known[n]]), len(nodes[known[m]])
        votes.setdefault(group[n], [0, 0])[layout == "vertical"] += a * b if n != m else a * (a - 1) // 2
    for n, g in group.items():
        members.setdefault(g, []).extend(nodes[known[n]])
    return [(sorted(places), "horizontal" if votes[g][0] > votes[g][1] else "vertical") for g, places in members.items()]


def _layout(a: tuple, b: tuple, tol: float) -> str | None:
    ax, ay, aw, ah = a
    bx, by, bw, bh = b
    if abs(ax - bx) <= tol and abs(ax + aw - (bx + bw)) <= tol and (abs(ay - (by + bh)) <= tol or abs(by - (ay + ah)) <= tol):
        return "vertical"
    if abs(ay - by) <= tol and abs(ay + ah - (by + bh)) <= tol and (abs(ax - (bx + bw)) <= tol or abs(bx - (ax + aw)) <= tol):
        return "horizontal"
    return None


def _components(keys: list[str]):
    """Links sorted by page in, panels with their group and its votes out; only one page's links are held at a time."""
    columns = [*keys, "ord", "group_id", "_h", "_v"]

    def page(at, links):
        group = dict(_joined([x[:2] for x in links]))
        votes: dict[int, list[int]] = {}
        for i, _, layout in links:
            votes.setdefault(group[i], [0, 0])[layout == "vertical"] += 1
        return [(*at, x, g, *votes[g]) for x, g in group.items()]

    def run(frames):
        at, links = None, []
        for pdf in frames:
            rows = []
            for *key, i, j, layout in zip(*[pdf[c].tolist() for c in [*keys, "i", "j", "layout"]], strict=True):
                if key != at:
                    rows += page(at, links) if at is not None else []
                    at, links = key, []
                links.append((i, j, layout))
            yield pd.DataFrame(rows, columns=columns)
        if at is not None:
            yield pd.DataFrame(page(at, links), columns=columns)

    return run


def group_panels(images: DataFrame, keys: list[str], tol: float = TOLERANCE) -> DataFrame:
    """``images`` with group_id (smallest ``ord`` of the group) per page; only adjacent panels go through the union-find."""
    return _grouped(images, keys, tol).drop("_h", "_v")


def _grouped(images: DataFrame, keys: list[str], tol: float) -> DataFrame:
    """The same with the numbers of horizontal and vertical pairs of the group."""
    links = adjacent_pairs(images, keys, tol)
    types = dict(images.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", ord long, group_id long, _h long, _v long"
    ordered = links.select(*keys, F.col("i").cast("long"), F.col("j").cast("long"), "layout").repartition(*keys).sortWithinPartitions(*keys)
    linked = ordered.mapInPandas(_components(keys), schema)
    return images.join(linked.withColumnRenamed("ord", "_ord"), [*[images[k] == linked[k] for k in keys], images["ord"] == F.col("_ord")], "left").select(*[images[c] for c in images.columns], F.coalesce("group_id", images["ord"].cast("long")).alias("group_id"), "_h", "_v")


def figures(images: DataFrame, keys: list[str], tol: float = TOLERANCE) -> DataFrame:
    """One row per figure: layout by majority of its pairs (vertical wins ties), parts in display order, union box, canvas size."""
    grouped = _grouped(images, keys, tol)
    part = F.struct("ord", "name", *BOX, *[c for c in ("width", "height") if c in images.columns])
    out = grouped.groupBy(*keys, "group_id").agg(
        F.count("*").alias("n_parts"),
        F.max("_h").alias("_h"),
        F.max("_v").alias("_v"),
        F.sort_array(F.collect_list(part)).alias("_parts"),
        F.min("bbox_x").alias("bbox_x"),
        F.min("bbox_y").alias("bbox_y"),
        (F.max(F.col("bbox_x") + F.col("bbox_w")) - F.min("bbox_x")).alias("bbox_w"),
        (F.max(F.col("bbox_y") + F.col("bbox_h")) - F.min("bbox_y")).alias("bbox_h"),
        *([F.sum(x).alias(f"_sum_{x}") for x in ("width", "height")] + [F.max(x).alias(f"_max_{x}") for x in ("width", "height")] if "width" in images.columns else []),
    )
    out = out.withColumn("layout", F.when(F.col("n_parts") == 1, "").when(F.col("_h") > F.col("_v"), "horizontal").otherwise("vertical"))
    by = F.transform("_parts", lambda p: F.struct(F.when(F.col("layout") == "vertical", -p["bbox_y"]).when(F.col("layout") == "horizontal", p["bbox_x"]).otherwise(F.lit(0.0)).alias("at"), p["ord"].alias("ord"), p["name"].alias("name")))
    out = out.withColumn("parts", F.transform(F.sort_array(by), lambda p: p["name"])).withColumn("stitched_name", F.array_join("parts", "+"))
    if "width" in images.columns:
        tall = F.col("layout") != "horizontal"
        out = out.withColumns({"width": F.when(tall, F.col("_max_width")).otherwise(F.col("_sum_width")), "height": F.when(tall, F.col("_sum_height")).otherwise(F.col("_max_height"))})
    return out.drop("_parts", "_h", "_v", "_sum_width", "_sum_height", "_max_width", "_max_height")
