"""Level of detail, visibility and label placement."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def active_levels(rows: DataFrame, levels: list[tuple[str, float | None, bool]], distance: str = "distance") -> DataFrame:
    """Adds ``levels``: ids in order that are implemented and always on or within their threshold. No join: levels are few."""
    on = [F.when(F.lit(ok) & (F.lit(t is None) | (F.col(distance) <= F.lit(t))), F.lit(i)) for i, t, ok in levels]
    return rows.withColumn("levels", F.array_compact(F.array(*on)))


def deepest_level(levels: Column) -> Column:
    """The last in order, whatever its threshold."""
    return F.try_element_at(levels, F.lit(-1))


def level_is_active(levels: Column, level: str) -> Column:
    """Levels that are unknown or not implemented are never among the active ones."""
    return F.array_contains(levels, level)


def least_score(deepest: Column, floors: dict[str, float]) -> Column:
    """Infinite where the level shows nothing."""
    out = F.lit(float("inf"))
    for level, floor in floors.items():
        out = F.when(deepest == level, F.lit(float(floor))).otherwise(out)
    return out


def on_near_side(dot: Column, radius: Column, distance: Column) -> Column:
    return dot >= radius / distance


def in_view(px: Column, py: Column, width: float, height: float, margin: float = 100.0) -> Column:
    return px.between(-margin, width + margin) & py.between(-margin, height + margin)


def apparent_size(extent_deg: Column, distance: Column, viewport: Column, fov_deg: Column, radius: Column) -> Column:
    seen = 2 * distance * F.tan(F.radians(fov_deg) / 2)
    return F.when((distance <= 0) | (seen <= 0), 0.0).otherwise(2 * radius * F.sin(F.radians(extent_deg) / 2) * viewport / F.nullif(seen, F.lit(0.0)))


def font_size(size: Column, share: float = 0.12, low: float = 6.0, high: float = 11.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), size * share))


def pool(rows: DataFrame, floor: Column, visible: Column, score: str, tie: str, most: int = 500) -> DataFrame:
    """Visible rows over the floor, the best ``most`` of them: a top-k, the operator's own limit."""
    return rows.where((F.col(score) >= floor) & visible).orderBy(F.desc(score), tie).limit(most)


def view_pool(rows: DataFrame, view: str, floor: Column, visible: Column, score: str, tie: str, most: int = 500) -> DataFrame:
    """The pool of each view, with ``ord`` 1 to ``most``."""
    order = Window.partitionBy(view).orderBy(F.desc(score), tie)
    return rows.where((F.col(score) >= floor) & visible).withColumn("ord", F.row_number().over(order)).where(F.col("ord") <= most)


def greedy_labels(rows: DataFrame, view: str, priority: str, min_spacing: float, most: int) -> DataFrame:
    """Rows(view, priority, px, py, spacing) accepted in priority order unless too near an accepted one.

    Rows come sorted by view, so a task holds the accepted labels of one view (at most ``most``), never a whole view.
    """

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, accepted = object(), []
        for batch in batches:
            keep = []
            for v, x, y, s in zip(batch[view], batch["px"], batch["py"], batch["spacing"], strict=True):
                if v != current:
                    current, accepted = v, []
                r = min_spacing / 2 if pd.isna(s) else s
                ok = len(accepted) < most and all((x - a) ** 2 + (y - b) ** 2 >= (r + c) ** 2 for a, b, c in accepted)
                if ok:
                    accepted.append((x, y, r))
                keep.append(ok)
            yield batch[keep]

    return rows.repartition(view).sortWithinPartitions(view, priority).mapInPandas(place, rows.schema)


def shown_labels(rows: DataFrame, view: str, floor: Column, visible: Column, score: str, tie: str, min_spacing: float, pool_size: int = 500, most: int = 120) -> DataFrame:
    """Score floor, visibility, the view's pool, then greedy placement: a task places at most ``pool_size`` rows of a view."""
    return greedy_labels(view_pool(rows, view, floor, visible, score, tie, pool_size), view, "ord", min_spacing, most)


def passive_labels(rows: DataFrame, width_share: float = 1.15, min_spacing: float = 12.0) -> DataFrame:
    """rows(name, short, size): label, font and spacing; a name too wide for its size gives way to the short one."""
    from ..functions.text import text_width

    font = font_size(F.col("size"))
    fits = text_width(F.col("name"), font) <= F.col("size") * width_share
    label = F.when(fits, F.col("name")).otherwise(F.col("short"))
    return rows.withColumns({"font": font, "label": label, "spacing": F.greatest(F.lit(min_spacing), text_width(label, font) / 2)})


def passive_placement(rows: DataFrame, view: str, tie: str, pool_size: int = 500, most: int = 120) -> DataFrame:
    """rows(view, name, short, size, px, py): labels of each view, the largest first, unless too near one placed before."""
    labels = view_pool(passive_labels(rows), view, F.lit(0.0), F.lit(True), "size", tie, pool_size)
    return greedy_labels(labels, view, "ord", 12.0, most)
