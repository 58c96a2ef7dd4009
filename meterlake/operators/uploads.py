"""Checks of uploaded files, first failure wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.text import display_name, extension

# Suffixes, media types and signatures of the accepted types.
SUFFIXES = {".pdf": "pdf", ".png": "png", ".jpg": "jpeg", ".jpeg": "jpeg"}
MEDIA_TYPES = {"pdf": ["application/pdf", "application/x-pdf"], "png": ["image/png"], "jpeg": ["image/jpeg", "image/jpg", "image/pjpeg"]}
ANY_TYPE = ["", "application/octet-stream", "binary/octet-stream"]
PNG, JPEG, PDF = "89504E470D0A1A0A", "FFD8FF", "255044462D"


def sniffed(content: Column) -> Column:
    """The type that the first bytes show; a PDF's header may stand anywhere in the first 1024."""
    head = F.hex(F.substring(content, 1, 1024))
    at_byte = F.regexp_count(head, F.lit(f"^(?:..)*?{PDF}")) > 0
    return F.when(at_byte, "pdf").when(F.startswith(head, F.lit(PNG)), "png").when(F.startswith(head, F.lit(JPEG)), "jpeg")


def check(uploads: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Add ``original_filename``, ``file_type``, ``http_status`` and ``error_code`` (null for good files)."""
    df = uploads.withColumn("original_filename", display_name(F.col("filename")))
    suffix = extension(F.col("original_filename"))
    wanted = F.try_element_at(F.create_map(*[F.lit(x) for p in SUFFIXES.items() for x in p]), suffix)
    media = F.lower(F.trim(F.substring_index(F.coalesce("content_type", F.lit("")), ";", 1)))
    df = df.withColumns({"_wanted": wanted, "_media": media, "_size": F.coalesce(F.octet_length("content"), F.lit(0))})
    allowed = F.try_element_at(F.create_map(*[x for k, v in MEDIA_TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), F.col("_wanted"))
    # signatures are read only from files that are small enough
    df = df.withColumn("_actual", F.when((F.col("_size") > 0) & (F.col("_size") <= settings.max_upload_bytes), sniffed(F.col("content"))))
    fail = (
        F.when(F.col("_wanted").isNull(), "415 unsupported_file_type")
        .when(F.col("_size") == 0, "400 empty_file")
        .when(F.col("_size") > settings.max_upload_bytes, "413 file_too_large")
        .when(~F.col("_media").isin(ANY_TYPE) & ~F.array_contains(allowed, F.col("_media")), "415 unsupported_file_type")
        .when(F.col("_actual").isNull(), "415 unsupported_file_type")
        .when(F.col("_actual") != F.col("_wanted"), "400 invalid_upload")
    )
    df = df.withColumn("_fail", fail)
    return df.withColumns(
        {
            "file_type": F.when(F.col("_fail").isNull(), F.col("_wanted")),
            "http_status": F.coalesce(F.left("_fail", F.lit(3)).cast("int"), F.lit(201)),
            "error_code": F.regexp_extract("_fail", r"^\d+ (.*)$", 1),
        }
    ).drop("_wanted", "_media", "_size", "_actual", "_fail")
