"""Pixels, masks and regions: zonal statistics of pixel tables.

A pixel table has (date, row, col, value), a mask (row, col, weight), region pixels (adm, row, col). Pixels meet the mask in one
equi-join on (row, col), never once a region, and aggregates are partial before they shuffle (region, date) rows. The mask's
side is broadcast if it is small enough (see ``join_mask``), else both sides shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.numeric import points_in_rings
from fieldloom.functions.quantiles import grouped_quantiles, null_safe
from fieldloom.functions.stats import correlation

#: Mask rows (region, cell) up to which the mask is broadcast.
BROADCAST_CELLS = 2_000_000


class Grid(NamedTuple):
    """Where cell (row, col) of a grid begins and ends on each axis: at row0 + row * row_step, with a positive step."""

    row0: float
    row_step: float
    col0: float
    col_step: float


def join_mask(pixels: DataFrame, mask: DataFrame) -> DataFrame:
    """Pixels with the regions and weights of their cell; the mask is broadcast only after a check of its size."""
    side = F.broadcast(mask) if mask.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS else mask
    return pixels.join(side, ["row", "col"])


def crop_to_bbox(pixels: DataFrame, lon_min: float, lat_min: float, lon_max: float, lat_max: float, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Rectangular window, limits included; a plain range filter that reaches the scan. Works on row and col as well."""
    return pixels.where(F.col(lon).between(lon_min, lon_max) & F.col(lat).between(lat_min, lat_max))


def regrid_average(pixels: DataFrame, rows: int, cols: int, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Mean of non-null cells of blocks of ``rows`` x ``cols`` cells: a coarser grid whose cells are whole multiples."""
    block = lambda c, n: F.floor(F.col(c) / n).cast("int").alias(c)
    return pixels.groupBy(*by, block("row", rows), block("col", cols)).agg(F.avg(value).alias(value))


def regrid_overlap(pixels: DataFrame, source: Grid, target: Grid, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """(by, row, col, value, covered): means over target cells, source cells weighing by the area that they share with the target's.

    Any ratio and offset of the grids. Null cells are left out and the others' weights renormalised; ``covered`` is the part of the
    target cell that cells with a value cover. Target cells without any have no row. The shared parts follow from the axes alone, so
    nothing is joined: every source cell is sent to the target cells that it reaches.
    """
    rows = pixels.where(F.col(value).isNotNull())
    for c, x0, dx, to0, to in (("row", source.row0, source.row_step, target.row0, target.row_step), ("col", source.col0, source.col_step, target.col0, target.col_step)):
        low = F.lit(float(x0)) + F.col(c) * F.lit(float(dx))
        place = lambda x: (x - F.lit(float(to0))) / F.lit(float(to))  # noqa: E731, B023
        reached = F.explode(F.sequence(F.floor(place(low)), F.ceil(place(low + F.lit(float(dx)))) - 1))
        rows = rows.withColumn(f"__{c}", reached)
        start = F.lit(float(to0)) + F.col(f"__{c}") * F.lit(float(to))
        shared = F.least(low + F.lit(float(dx)), start + F.lit(float(to))) - F.greatest(low, start)
        rows = rows.withColumn(f"__w_{c}", shared / F.lit(float(to))).where(F.col(f"__w_{c}") > 1e-9)
    w = F.col("__w_row") * F.col("__w_col")
    out = rows.groupBy(*by, F.col("__row").cast("int").alias("row"), F.col("__col").cast("int").alias("col"))
    return out.agg((F.sum(w * F.col(value)) / F.sum(w)).alias(value), F.sum(w).alias("covered"))


def regrid_bilinear(pixels: DataFrame, targets: DataFrame, scale_row: float, scale_col: float, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Values at target cells (row, col), which lie at (row * scale_row, col * scale_col) of the source grid.

    The four source cells around a target are met by an equi-join; weights are renormalised over those that have a value.
    """
    y, x = F.col("row") * F.lit(float(scale_row)), F.col("col") * F.lit(float(scale_col))
    corners = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    part = lambda f, bit: F.when(bit == 1, f).otherwise(1 - f)
    near = targets.select("row", "col", y.alias("y"), x.alias("x"), corners.alias("c")).select(
        F.col("row").alias("to_row"), F.col("col").alias("to_col"),
        (F.floor("y") + F.col("c.a")).cast("int").alias("row"), (F.floor("x") + F.col("c.b")).cast("int").alias("col"),
        (part(F.col("y") - F.floor("y"), F.col("c.a")) * part(F.col("x") - F.floor("x"), F.col("c.b"))).alias("w"),
    ).where("w > 0")
    met = near.join(pixels.where(F.col(value).isNotNull()), ["row", "col"])
    out = met.groupBy(*by, F.col("to_row").alias("row"), F.col("to_col").alias("col"))
    return out.agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias(value))


def fill_null_from_neighbors(pixels: DataFrame, passes: int = 1, value: str = "value") -> DataFrame:
    """Null cells get the mean of the non-null cells of their 3 x 3 window, as it was before the pass; else they stay null."""
    offsets = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]))
    for _ in range(passes):
        given = pixels.where(F.col(value).isNotNull()).select("row", "col", F.col(value).alias("__v"), offsets.alias("o"))
        given = given.select((F.col("row") + F.col("o.a")).alias("row"), (F.col("col") + F.col("o.b")).alias("col"), "__v")
        empty = pixels.where(F.col(value).isNull())
        means = empty.select("row", "col").distinct().join(given, ["row", "col"]).groupBy("row", "col").agg(F.avg("__v").alias("__m"))
        pixels = pixels.join(means, ["row", "col"], "left").withColumn(value, F.coalesce(value, "__m")).drop("__m")
    return pixels


def quality_filter(pixels: DataFrame, qa: str = "qa", value: str = "value") -> DataFrame:
    """Values whose quality code is not 0 become null."""
    return pixels.withColumn(value, F.when(F.col(qa) == 0, F.col(value)))


def binarize_mask(mask: DataFrame, threshold: float = 50.0) -> DataFrame:
    """Weight 1 above the percentage, else 0; null stays null."""
    return mask.withColumn("weight", F.when(F.col("weight").isNotNull(), (F.col("weight") > threshold).cast("int")))


def null_codes(pixels: DataFrame, max_valid: float = 200.0, value: str = "value") -> DataFrame:
    """Codes above ``max_valid`` (water, no data) become null."""
    return pixels.withColumn(value, F.when(F.col(value) <= max_valid, F.col(value)))


#: Cells along the side of a tile at most, where the cells' size is known.
TILE_CELLS = 256


def _crossed(lon: np.ndarray, lat: np.ndarray, half: tuple[float, float], rings: list[np.ndarray]) -> np.ndarray:
    """Whether an edge of the rings meets the cells around (lon, lat), their borders included: no axis tells segment and rectangle apart."""
    hit = np.zeros(len(lon), bool)
    for ring in rings:
        for p, q in zip(ring, np.roll(ring, -1, axis=0)):
            low, high = np.minimum(p, q), np.maximum(p, q)
            near = np.flatnonzero((lon >= low[0] - half[0]) & (lon <= high[0] + half[0]) & (lat >= low[1] - half[1]) & (lat <= high[1] + half[1]) & ~hit)
            d = q - p
            hit[near] = np.abs(d[0] * (lat[near] - p[1]) - d[1] * (lon[near] - p[0])) <= half[0] * abs(d[1]) + half[1] * abs(d[0])
    return hit


def region_pixels(grid: DataFrame, polygons: DataFrame, tile: float | None = None, touched: tuple[float, float] | None = None) -> DataFrame:
    """(adm, row, col): the cells whose centre (lon, lat) lies in a region; a cell may lie in several.

    With ``touched``, the cells' (width, height), a cell belongs to every region that it shares a point with, its border included, so that
    regions smaller than a cell have one too. ``polygons`` has (adm, rings: array of rings of points (lon, lat)). Cells and the regions
    whose bounding box reaches there meet by square tiles ``tile`` wide, in workers; the grid is read once. By default a tile is as
    wide as the regions' boxes on average, and at most TILE_CELLS cells wide where their size is known.
    """
    half = (touched[0] / 2, touched[1] / 2) if touched else (0.0, 0.0)
    side = lambda c: F.transform(F.flatten("rings"), lambda p: p[c].cast("double"))
    box = {f"{c}_{k}": f(side(c)) for c in ("lon", "lat") for k, f in (("low", F.array_min), ("high", F.array_max))}
    shapes = polygons.select("adm", "rings").where(F.size(F.flatten("rings")) > 2).withColumns(box)
    if tile is None:
        wide = shapes.agg(F.avg(F.greatest(F.col("lon_high") - F.col("lon_low"), F.col("lat_high") - F.col("lat_low")))).head()[0]
        tile = wide or 1.0
        tile = min(tile, TILE_CELLS * max(touched)) if touched else tile
    number = lambda c: F.floor(c / F.lit(float(tile)))
    reach = lambda c, more: F.explode(F.sequence(number(F.col(f"{c}_low") - more), number(F.col(f"{c}_high") + more)))
    there = shapes.withColumn("tile_x", reach("lon", half[0])).withColumn("tile_y", reach("lat", half[1])).select("tile_x", "tile_y", "adm", "rings")
    cells = grid.select(F.col("row").cast("int"), F.col("col").cast("int"), F.col("lon").cast("double"), F.col("lat").cast("double")).where("lon IS NOT NULL AND lat IS NOT NULL")
    cells = cells.select(number(F.col("lon")).alias("tile_x"), number(F.col("lat")).alias("tile_y"), "row", "col", "lon", "lat")

    def inside(cells: pa.Table, regions: pa.Table) -> pa.Table:
        row, col, lon, lat = (cells.column(c).to_numpy() for c in ("row", "col", "lon", "lat"))
        found = []
        for adm, parts in zip(regions.column("adm").to_pylist(), regions.column("rings").to_pylist()):
            rings = [np.array([(p["lon"], p["lat"]) for p in ring], float) for ring in parts if len(ring) > 2]
            if not rings:
                continue
            low, high = np.concatenate(rings).min(0), np.concatenate(rings).max(0)
            near = np.flatnonzero((lon >= low[0] - half[0]) & (lon <= high[0] + half[0]) & (lat >= low[1] - half[1]) & (lat <= high[1] + half[1]))
            member = points_in_rings(lon[near], lat[near], rings)
            if touched:
                member = member | _crossed(lon[near], lat[near], half, rings)
            hit = near[member]
            found.append(pa.table({"adm": pa.array([adm] * len(hit), pa.string()), "row": pa.array(row[hit], pa.int32()), "col": pa.array(col[hit], pa.int32())}))
        return pa.concat_tables(found) if found else pa.table({"adm": pa.array([], pa.string()), "row": pa.array([], pa.int32()), "col": pa.array([], pa.int32())})

    return cells.groupBy("tile_x", "tile_y").cogroup(there.groupBy("tile_x", "tile_y")).applyInArrow(inside, "adm string, row int, col int")


def merge_regions(df: DataFrame, mapping: Sequence[tuple[Sequence[str], str]], column: str = "adm", attributes: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """Replace several regions by a new one, in the order of the list, so that later entries see earlier results.

    Without ``order``: on region pixels, the union of the members' cells. With it: one row a region, with the attributes of its
    last member by ``order``.
    """
    name = F.col(column)
    for members, new in mapping:
        name = F.when(name.isin(*members), F.lit(new)).otherwise(name)
    renamed = df.withColumn(column, name)
    if order is None:
        return renamed.distinct()
    last = F.max_by(F.struct(*attributes), order).alias("__last")
    return renamed.groupBy(column).agg(last).select(column, "__last.*")


def region_mask(pixels_of_regions: DataFrame, crop_mask: DataFrame) -> DataFrame:
    """(adm, row, col, weight) of the cells with a crop."""
    return pixels_of_regions.join(crop_mask.where(F.col("weight") > 0), ["row", "col"]).select("adm", "row", "col", "weight")


def _value(value: str) -> Column:
    return F.when(~F.isnan(F.col(value)), F.col(value))


def zonal_mean(pixels: DataFrame, mask: DataFrame, by: Sequence[str] = ("date",), value: str = "value") -> DataFrame:
    """Mean of the non-null pixels of each region and date; zeros count."""
    return join_mask(pixels, mask).groupBy("adm", *by).agg(F.avg(_value(value)).alias("mean"))


def _good(value: str) -> Column:
    return F.when(_value(value) > 0, _value(value))


def zonal_mean_quality(pixels: DataFrame, mask: DataFrame, by: Sequence[str] = ("date",), min_quality: float = 0.1, scale: float = 100.0, value: str = "value") -> DataFrame:
    """(adm, by, quality, mean): share of the region's cells with a value above 0, and their mean / scale, null at low quality.

    Cells that an image lacks count as not good.
    """
    cells = mask.groupBy("adm").agg(F.count("*").alias("cells"))
    sums = join_mask(pixels, mask).groupBy("adm", *by).agg(F.count(_good(value)).alias("good"), F.sum(_good(value)).alias("total"))
    quality = F.col("good") / F.col("cells")
    return sums.join(cells, "adm").select("adm", *by, quality.alias("quality"), F.when(quality >= min_quality, F.try_divide("total", "good") / scale).alias("mean"))


def zonal_weighted_mean(pixels: DataFrame, mask: DataFrame, by: Sequence[str] = ("date",), spread_limit: float | None = None, exact: bool = True, value: str = "value") -> DataFrame:
    """(adm, by, mean, low, high[, wide]): mean weighted by crop share over non-null pixels, and their 2.5 and 97.5 % quantiles.

    Null without any weight. Exact quantiles come from counts of narrowing ranges (``grouped_quantiles``), ``exact=False`` takes approximate
    ones, which merge from sketches; neither holds a region's pixels.
    """
    v, w = _value(value), F.col("weight")
    met = join_mask(pixels, mask)
    present = F.when(w > 0, v)
    out = met.groupBy("adm", *by).agg(F.sum(v * w).alias("__s"), F.sum(F.when(v.isNotNull(), w)).alias("__w"), *([] if exact else [F.approx_percentile(present, F.array(F.lit(0.025), F.lit(0.975)), F.lit(10000)).alias("quantiles")]))
    if exact:
        out = null_safe(out, grouped_quantiles(met.withColumn("__present", present), ["adm", *by], "__present", [0.025, 0.975]), ["adm", *by])
    out = out.select("adm", *by, F.try_divide("__s", "__w").alias("mean"), F.col("quantiles")[0].alias("low"), F.col("quantiles")[1].alias("high"))
    return out if spread_limit is None else out.withColumn("wide", F.col("high") - F.col("low") > spread_limit)


def bin_of(value: Column, low: float, high: float, bins: int) -> Column:
    """Number of the fixed-width bin from 0, null outside the range; the upper limit belongs to the last bin."""
    width = (high - low) / bins
    return F.when(value.between(low, high), F.least(F.floor((value - low) / width), F.lit(bins - 1))).cast("int")


def zonal_histogram(
    pixels: DataFrame, mask: DataFrame, low: float, high: float, bins: int = 32, by: Sequence[str] = ("date",), min_quality: float | None = None, value: str = "value"
) -> DataFrame:
    """(adm, by, histogram): percentages of the in-range pixels in ``bins`` bins, an array; null without any.

    With ``min_quality`` only values above 0 count, and regions with fewer good cells than that share get null.
    """
    v = _good(value) if min_quality is not None else _value(value)
    rows = join_mask(pixels, mask).withColumn("bin", bin_of(v, low, high, bins))
    counts = rows.groupBy("adm", *by, "bin").agg(F.count("*").alias("n"), F.count(v).alias("good"))
    filled = F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n"))))
    per_date = counts.groupBy("adm", *by).agg(filled.alias("m"), F.sum(F.when(F.col("bin").isNotNull(), F.col("n"))).alias("inside"), F.sum("good").alias("good"))
    percents = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: 100 * F.coalesce(F.col("m")[i], F.lit(0)) / F.col("inside"))
    valid = F.col("inside") > 0
    if min_quality is not None:
        per_date = per_date.join(mask.groupBy("adm").agg(F.count("*").alias("cells")), "adm")
        valid = valid & (F.col("good") / F.col("cells") >= min_quality)
    return per_date.select("adm", *by, F.when(valid, percents).alias("histogram"))


def zonal_static(properties: DataFrame, mask: DataFrame, names: Sequence[str], cell_deg: float = 0.0025) -> DataFrame:
    """(adm, est_cropland_area, mean of each property) over the region's cells; a null among them fails the job.

    The area is the number of cells times a cell's hectares at the equator.
    """
    hectares = (cell_deg / 360 * 400_300) ** 2
    means = join_mask(properties, mask).groupBy("adm").pivot("property", list(names)).agg(F.avg("value"))
    area = mask.groupBy("adm").agg((F.count("*") * hectares).alias("est_cropland_area"))
    out = area.join(means, "adm", "left")
    checked = [F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a region has no {c}"))).otherwise(F.col(c)).cast("double").alias(c) for c in names]
    return out.select("adm", "est_cropland_area", *checked)


def monthly_quality(quality: DataFrame, by: str = "country") -> DataFrame:
    """(by, month, quality): mean quality by calendar month."""
    return quality.groupBy(by, F.month("date").alias("month")).agg(F.avg("quality").alias("quality"))


def correlation_matrix(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, a, b, r): Pearson correlation of each pair of columns, in one aggregation."""
    pairs = list(combinations(cols, 2))
    sums = df.groupBy(*by).agg(*[correlation(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return sums.select(*by, F.explode(rows).alias("p")).select(*by, "p.*")


