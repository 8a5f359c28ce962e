"""Raster differences of pages, page signatures and render geometry."""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.schema import LIMITS, CompareError
from palimpsest.sources.png import decode_png, encode_png

#: Overlay of changed pixels, and the bounds of its opacity.
OVERLAY = (220, 40, 72)
LEAST_ALPHA, ALPHA_RANGE, MOST_ALPHA = 90, 145, 235
LUMA = np.array([0.2126, 0.7152, 0.0722])
VISUAL = "struct<overlay:string,changed_pixels:bigint,total_pixels:bigint,ratio:double,error:string>"


def fit_scale(width: Column, height: Column) -> Column:
    """Scale at which a page fits the render box; null for a page without size."""
    fits = F.least(F.lit(LIMITS["render_scale"]), LIMITS["render_width"] / width, LIMITS["render_height"] / height)
    return F.when((width > 0) & (height > 0), fits)


def pad_white(image: np.ndarray, height: int, width: int) -> np.ndarray:
    out = np.full((height, width, 4), 255, np.uint8)
    out[: image.shape[0], : image.shape[1]] = image
    return out


def raster_diff(a: np.ndarray, b: np.ndarray, threshold: int) -> tuple[np.ndarray, int]:
    """Overlay (RGBA) and number of pixels that differ by more than ``threshold`` in any channel.

    The canvas spans both images; outside an image everything is 255.
    """
    height, width = max(a.shape[0], b.shape[0]), max(a.shape[1], b.shape[1])
    apart = np.abs(pad_white(a, height, width).astype(np.int32) - pad_white(b, height, width)).max(axis=2)
    changed = apart > threshold
    overlay = np.zeros((height, width, 4), np.uint8)
    overlay[changed, :3] = OVERLAY
    alpha = np.minimum(MOST_ALPHA, LEAST_ALPHA + np.floor(apart * ALPHA_RANGE / 255 + 0.5)).astype(np.uint8)
    overlay[..., 3] = np.where(changed, alpha, 0)
    return overlay, int(changed.sum())


def signature(image: np.ndarray) -> list[int]:
    """16 x 16 mean luma of an image, fitted into 64 x 64 on white."""
    height, width = image.shape[:2]
    scale = min(64 / width, 64 / height)
    h, w = max(1, round(height * scale)), max(1, round(width * scale))
    rows, cols = (np.arange(h) * height // h), (np.arange(w) * width // w)
    canvas = np.full((64, 64), 255.0)
    top, left = (64 - h) // 2, (64 - w) // 2
    canvas[top : top + h, left : left + w] = image[rows][:, cols, :3] @ LUMA
    return np.floor(canvas.reshape(16, 4, 16, 4).mean(axis=(1, 3)) + 0.5).astype(int).ravel().tolist()


def visual_udf(threshold: int):
    """Column function (before PNG, after PNG) -> overlay data URL, counts, ratio; an error code instead of an exception."""

    @F.pandas_udf(VISUAL)
    def visual(before: pd.Series, after: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(before, after, strict=True):
            try:
                if x is None or y is None:
                    out.append((None, None, None, None, None))
                    continue
                overlay, changed = raster_diff(decode_png(bytes(x)), decode_png(bytes(y)), threshold)
                total = overlay.shape[0] * overlay.shape[1]
                url = "data:image/png;base64," + base64.b64encode(encode_png(overlay)).decode()
                out.append((url, changed, total, changed / total if total else 0.0, None))
            except CompareError as e:
                out.append((None, None, None, None, e.code))
        return pd.DataFrame(out, columns=["overlay", "changed_pixels", "total_pixels", "ratio", "error"]).astype({"changed_pixels": "Int64", "total_pixels": "Int64"})

    return visual


def signature_of(png: Column) -> Column:
    """16 x 16 grayscale samples of PNG pages, null for what can't be read."""

    def one(raw):
        try:
            return None if raw is None else signature(decode_png(bytes(raw)))
        except CompareError:
            return None

    @F.pandas_udf("array<int>")
    def samples(raws: pd.Series) -> pd.Series:
        return raws.map(one)

    return samples(png)


def page_differences(rows: DataFrame, images: DataFrame, threshold: int, only: str | None = None) -> DataFrame:
    """Add ``visual`` to rows with both sides: ``images(pair_id, side, unit_index, png)``.

    ``only``: a status, such as moved, whose rows are compared; the filter stands below the Python step.
    """
    wanted = rows.where("before_idx is not null and after_idx is not null")
    if only:
        wanted = wanted.where(F.col("status") == only)
    for side in ("before", "after"):
        own = images.where(F.col("side") == side).select("pair_id", F.col("unit_index").alias(f"{side}_idx"), F.col("png").alias(f"{side}_png"))
        wanted = wanted.join(own, ["pair_id", f"{side}_idx"])
    told = wanted.select("pair_id", "row_seq", visual_udf(threshold)("before_png", "after_png").alias("visual"))
    return rows.join(told, ["pair_id", "row_seq"], "left")


def pixel_budget(images: DataFrame, most: int = LIMITS["rendered_pixels"]) -> DataFrame:
    """pair_id, pixels, error where a pair's images pass the budget or one is too large: ``images(pair_id, width, height)``."""
    one = F.max(F.col("width") * F.col("height"))
    per = images.groupBy("pair_id").agg(F.sum(F.col("width").cast("long") * F.col("height")).alias("pixels"), one.alias("largest"))
    over = (F.col("pixels") > most) | (F.col("largest") > LIMITS["image_pixels"])
    return per.select("pair_id", "pixels", F.when(over, "PIXEL_LIMIT_EXCEEDED").alias("error"))
