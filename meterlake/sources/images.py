"""Scanned pages as tables of pixels: a guard against huge images, clean-up, statistics.

Rows are (doc_id, page, height, width, channels, pixels), one byte per pixel and channel, row after row. Decoding PNG and
JPEG files into such rows is a reader's task (``pages.register``); all that follows is here. A map over pages, a few at a
time in a worker; a row without pixels, or with another number of bytes than its sizes say, gives null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import raster

MOST_PIXELS = 100_000_000  # fixed value
PIXELS = "doc_id long, page int, height int, width int, channels int, pixels binary"
STATISTICS = "doc_id long, page int, skew double, text_height double, light_spread double"


def png_size(content: Column) -> tuple[Column, Column]:
    """Width and height as a PNG file's header gives them; null for other files. Nothing is decoded."""
    whole = F.startswith(F.hex(F.substring(content, 1, 16)), F.lit("89504E470D0A1A0A0000000D49484452")) & (F.octet_length(content) >= 24)
    return tuple(F.when(whole, F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")) for at in (17, 21))


def within_pixels(files: DataFrame, content: str = "content", most: int = MOST_PIXELS) -> tuple[DataFrame, DataFrame]:
    """Files that may be decoded, and PNG files whose header promises more than ``most`` pixels."""
    width, height = png_size(F.col(content))
    huge = F.coalesce(width.cast("double") * height > most, F.lit(False))
    return files.filter(~huge), files.filter(huge)


def _pages(batch: pa.RecordBatch) -> Iterator[np.ndarray | None]:
    for row in batch.select(["height", "width", "channels", "pixels"]).to_pylist():
        shape, raw = [row[k] for k in ("height", "width", "channels")], row["pixels"]
        if raw is None or None in shape or min(shape) < 1 or len(raw) != np.prod(shape, dtype=np.int64):
            yield None
        else:
            page = np.frombuffer(raw, np.uint8).reshape(shape)
            yield page[..., 0] if shape[2] == 1 else page


def _map(pages: DataFrame, schema: str, columns: Callable[[list], list]) -> DataFrame:
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one page at a time: pages are large
                one = batch.slice(k, 1)
                yield pa.record_batch([one.column("doc_id"), one.column("page"), *columns(list(_pages(one)))], names)

    kinds = dict(c.split(" ") for c in PIXELS.split(", "))
    return pages.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()]).mapInArrow(run, schema)


def prepared(pages: DataFrame, pipeline: str = "light") -> DataFrame:
    """Pages after a pipeline: ``light`` (grey, sized, speckle and skew and ruling lines removed), ``binary`` or ``none``."""
    clean = raster.PIPELINES[pipeline]

    def columns(found: list) -> list:
        done = [None if p is None else clean(p) for p in found]
        size = [pa.array([None if p is None else p.shape[k] for p in done], pa.int32()) for k in (0, 1)]
        return [*size, pa.array([None if p is None else 1 for p in done], pa.int32()), pa.array([None if p is None else np.ascontiguousarray(p).tobytes() for p in done], pa.binary())]

    return _map(pages, PIXELS, columns)


def statistics(pages: DataFrame) -> DataFrame:
    """Each page's skew in degrees, height of its letters in pixels and spread of its light."""

    def columns(found: list) -> list:
        plain = [None if p is None else raster.grey(p) for p in found]
        kinds = (raster.skew, lambda p: raster.glyph_height(raster.ink(p)), raster.light_spread)
        return [pa.array([None if p is None else f(p) for p in plain], pa.float64()) for f in kinds]

    return _map(pages, STATISTICS, columns)
