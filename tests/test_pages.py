"""Scanned pages as pixels, readers' preconditions, settings, failed writes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.config import Settings, normal_url
from meterlake.functions import raster
from meterlake.operators import store
from meterlake.plans.page_queries import drawn
from meterlake.sources import images, pages


def shapes_by_search(dark):
    """Heights of all letter-sized shapes, found pixel by pixel."""
    left, heights = {(int(y), int(x)) for y, x in zip(*np.nonzero(dark))}, []
    while left:
        shape, todo = [], [left.pop()]
        while todo:
            y, x = todo.pop()
            shape.append((y, x))
            near = {(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            todo += near
        height, width = (max(p[k] for p in shape) - min(p[k] for p in shape) + 1 for k in (0, 1))
        if 8 <= height <= 300 and len(shape) >= 20 and width <= 3 * height:
            heights.append(height)
    return float(np.median(heights)) if heights else 0.0


@pytest.mark.parametrize("share", [0.0, 0.2, 0.35, 0.45, 1.0])
def test_letters_by_brute_force(share):
    dark = np.random.default_rng(3).random((60, 70)) < share
    assert raster.glyph_height(dark) == shapes_by_search(dark)


@pytest.mark.parametrize("degrees", [-6.0, -0.2, 0.0, 0.4, 3.3])
def test_skew(degrees):
    page = drawn(500, 800, degrees, 36)
    assert abs(raster.skew(page) - degrees) < 0.11  # one step of the search
    assert (raster.deskewed(page) is page) == (abs(raster.skew(page)) < 0.3)


def test_clean_up():
    page = drawn(500, 800, 0, 36)
    ruled = page.copy()
    ruled[250:253, 20:780] = 0
    ruled[20:480, 400:402] = 0
    clean = raster.without_lines(ruled)
    assert (clean[251, 20:780] == 255).all() and (clean[20:480, 401] == 255).all() and (raster.without_lines(page) == page).all()
    specks = page.copy()
    specks[5::20, 5::20] = 0
    assert (raster.denoised(specks)[:40, :40] == 240).all()
    light = np.where(page < 100, 0.4, 1.0) * np.linspace(60, 250, 800)[None, :]
    assert raster.light_spread(page) == 0 and raster.light_spread(light.astype(np.uint8)) > 60
    assert ((raster.binarized(light.astype(np.uint8)) == 0) == (page < 100)).mean() > 0.99
    assert raster.rescaled(page).shape == (1500, 2400) and raster.rescaled(np.zeros((6000, 10), np.uint8)).shape[0] == 5000
    assert raster.grey(np.array([[[10, 20, 30, 0], [255, 0, 0, 255]]], np.uint8)).tolist() == [[255, 76]]
    blank = np.full((50, 50), 255, np.uint8)
    assert raster.skew(blank) == 0 and (raster.without_lines(blank) == blank).all()


def test_pages_with_odd_rows(spark):
    rows = [(1, 1, 2, 2, 1, bytearray(b"\x00\xff\x00\xff")), (2, 1, 2, 2, 1, bytearray(b"\x00")), (None, None, None, 2, 1, None)]
    df = spark.createDataFrame(rows, images.PIXELS)
    got = sorted((r.doc_id or 0, r.skew is None) for r in images.statistics(df).collect())
    assert got == [(0, True), (1, False), (2, True)]
    assert sorted((r.doc_id or 0, r.pixels and len(r.pixels)) for r in images.prepared(df, "none").collect()) == [(0, None), (1, 4), (2, None)]
    assert images.statistics(df.limit(0)).count() == 0


def test_size_guard_lets_other_files_pass(spark):
    df = spark.createDataFrame([(1, bytearray(b"%PDF-1")), (2, None), (3, bytearray(bytes.fromhex("89504E470D0A1A0A0000000D49484452FFFFFFFFFFFFFFFF")))], "id long, content binary")
    good, huge = images.within_pixels(df)
    assert sorted(r.id for r in good.collect()) == [1, 2] and [r.id for r in huge.collect()] == [3]


def test_reader_precondition(monkeypatch):
    monkeypatch.setattr(pages, "_READERS", {})
    monkeypatch.setattr(pages, "_LANGUAGES", {})
    with pytest.raises(NotImplementedError):
        pages.require("ocr")
    pages.register("ocr", lambda batches: batches, {"eng"})
    pages.require("ocr")
    with pytest.raises(RuntimeError, match="hin"):
        pages.require("ocr", Settings(ocr_language="eng+hin"))
    pages.register("ocr", lambda batches: batches)
    pages.require("ocr", Settings(ocr_language="eng+hin"))


def test_settings(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# a comment\n\nMETERLAKE_MAX_PAGES=3\nexport METERLAKE_OCR_LANGUAGE='hin'\nMETERLAKE_PAGE_SIZE=5\n=x\n")
    monkeypatch.setenv("METERLAKE_PAGE_SIZE", "7")
    got = Settings.from_environment(file=str(tmp_path / ".env"))
    assert (got.max_pages, got.ocr_language, got.page_size) == (3, "hin", 7)
    assert normal_url("postgres://h/b") == "postgresql://h/b" and normal_url("sqlite:///:memory:") == "sqlite:///:memory:" and normal_url("sqlite:///a.db").endswith("/a.db")
    assert normal_url("sqlite:////x/a.db") == "sqlite:////x/a.db" and normal_url(None) is None
    for url in (None, "sqlite:///a.db"):
        with pytest.raises(ValueError):
            Settings(environment="Production", database_url=url)
    Settings(environment="production", database_url="postgres://h/b")


def test_a_failed_append_leaves_the_store_as_it_was(spark, tmp_path):
    path = str(tmp_path / "events")
    store.append(spark.range(3), path)
    with pytest.raises(Exception, match="broken row"):
        store.append(spark.range(100).repartition(4).withColumn("id", F.when(F.col("id") == 77, F.raise_error(F.lit("broken row"))).otherwise(F.col("id"))), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 1, 2]
    assert [p.name for p in (tmp_path / "events").rglob("*.parquet") if "_temporary" in str(p)] == []
