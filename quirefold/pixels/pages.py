"""Pixel work on pages inside Spark: one decode per page, only for the pages that need it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.pixels import kernels, png

MEASURED = "struct<width:int,height:int,colour:boolean,background:string,box:struct<left:int,top:int,right:int,bottom:int>,error:string>"


def measure(content: Column) -> Column:
    """Size, colour, background and crop box of PNG pages; an error instead where the image can't be read."""

    @F.pandas_udf(MEASURED)
    def measured(blobs: pd.Series) -> pd.DataFrame:
        rows = []
        for blob in blobs:
            try:
                pixels = png.decode(blob or b"")
                box = dict(zip(("left", "top", "right", "bottom"), kernels.margin_box(pixels)))
                rows.append((pixels.shape[1], pixels.shape[0], kernels.is_colour(pixels), kernels.background(pixels), box, None))
            except ValueError as e:
                rows.append((None, None, None, None, None, str(e)))
        return pd.DataFrame(rows, columns=["width", "height", "colour", "background", "box", "error"]).astype({"width": "Int32", "height": "Int32", "colour": "boolean"})

    return measured(content)


def transform(content: Column, work: Callable[[np.ndarray], np.ndarray]) -> Column:
    """PNG pages with ``work`` done on their pixels; null where the image can't be read."""

    @F.pandas_udf("binary")
    def done(blobs: pd.Series) -> pd.Series:
        def one(blob):
            try:
                return png.encode(work(png.decode(blob or b"")))
            except ValueError:
                return None

        return blobs.map(one)

    return done(content)


def fit_pages(pages: DataFrame, width: int, height: int) -> DataFrame:
    """Pages (content, width, height) no larger than a frame: those that fit go through untouched, only the others are decoded."""
    from quirefold.functions.geometry import contain_size

    fits = F.coalesce((F.col("width") <= width) & (F.col("height") <= height), F.lit(True))
    size = contain_size(F.col("width"), F.col("height"), F.lit(width), F.lit(height))

    def shrink(pixels: np.ndarray) -> np.ndarray:
        h, w = pixels.shape[:2]
        scale = min(width / w, height / h)
        return kernels.resize(pixels, max(1, int(w * scale + 0.5)), max(1, int(h * scale + 0.5)))

    large = pages.where(~fits).withColumn("content", transform(F.col("content"), shrink)).withColumn("size", size)
    large = large.withColumn("width", F.col("size.width").cast("int")).withColumn("height", F.col("size.height").cast("int")).drop("size")
    return pages.where(fits).unionByName(large)


#: Pages whose luma spans less than this are meant to be pale.
PALE = 255 - 3 * 32


def prepared(pixels: np.ndarray, work) -> np.ndarray:
    """One page after all work on it, in the order in which it is stated; a page that stays grey has one channel."""
    if work.crop:
        left, top, right, bottom = kernels.margin_box(pixels, work.crop_power)
        pixels = pixels[top:bottom, left:right]
    coloured = kernels.is_colour(pixels)
    if work.gamma != 1.0:
        pixels = kernels.gamma(pixels, work.gamma)
    if not (coloured and work.colour) and pixels.ndim == 3:
        pixels = kernels.gray(pixels)
    if work.contrast and not coloured:
        luma = pixels if pixels.ndim == 2 else kernels.gray(pixels)
        if int(luma.max()) - int(luma.min()) >= PALE:
            pixels = kernels.keep_tone_contrast(kernels.raise_black(pixels) if work.level else pixels)
    h, w = pixels.shape[:2]
    scale = min(work.width / w, work.height / h)
    if scale < 1 or (work.upscale and scale > 1):
        pixels = kernels.resize(pixels, max(1, int(w * scale + 0.5)), max(1, int(h * scale + 0.5)))
    if work.moire and min(pixels.shape[:2]) > 1:
        pixels = kernels.erase_moire(pixels)
    return pixels


def encoded(pixels: np.ndarray, levels: int) -> bytes:
    """A PNG; a grey page in so many levels, with as few bits a sample as they need, if levels are given."""
    if levels and pixels.ndim == 2:
        tones = np.round(np.linspace(0, 255, levels)).astype(np.uint8)
        bits = 1 if levels <= 2 else 2 if levels <= 4 else 4 if levels <= 16 else 8
        return png.encode(kernels.dither(pixels, tones), np.repeat(tones[:, None], 3, 1), bits)
    return png.encode(pixels)


def worked_pages(pages: DataFrame, work) -> DataFrame:
    """Pages (path, content and others) with all work done in one decode each; what can't be decoded here goes through as it is."""

    @F.pandas_udf("binary")
    def done(blobs: pd.Series) -> pd.Series:
        def one(blob):
            try:
                return encoded(prepared(png.decode(blob or b""), work), work.levels)
            except ValueError:
                return None

        return blobs.map(one)

    made = pages.withColumn("_made", done("content"))
    path = F.when(F.col("_made").isNotNull(), F.regexp_replace("path", r"(?<=[^/])\.[^./]*$", ".png")).otherwise(F.col("path"))
    return made.withColumn("path", path).withColumn("content", F.coalesce("_made", "content")).drop("_made")
