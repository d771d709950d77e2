"""Operators on small tables with known answers, and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framefold.config import Settings
from framefold.functions import paths
from framefold.operators import catalog, fusion, kernels, sharpness, transforms
from framefold.operators.ranking import numbered
from framefold.plans import align, control, series, stack
from framefold.sources import images, jpeg, scores
from framefold.streaming import ingest


def one(spark, expr):
    return spark.range(1).select(F.expr(expr)).first()[0]


def test_paths(spark):
    assert one(spark, paths.stem("'a/test_image.jpg'")) == "test_image"
    rows = spark.createDataFrame([("a/test_image.jpg",), ("b/.hidden",), ("c/x.y.CR2",), ("noext",)], "path string")
    got = {r.path: r for r in catalog.derived_paths(catalog.classified(rows)).collect()}
    assert got["a/test_image.jpg"].score_path == "a/sharpness/test_image.yml"
    assert (got["c/x.y.CR2"].kind, got["c/x.y.CR2"].resized_path) == ("raw", "c/resized/x.y.png")
    assert got["b/.hidden"].ext == "" and got["noext"].stem == "noext"


@pytest.mark.parametrize(("spec", "out"), [("2400", 2400), (" 50% ", 2000), ("0", None), ("-3", None), ("", None), ("2400.5", None), ("x%", None), ("12.5%", 500)])
def test_resize_target(spark, spec, out):
    assert one(spark, paths.resize_target(f"'{spec}'", "4000")) == out


def test_overlapping_chunks(spark):
    rows = spark.range(25).withColumn("g", F.lit(1))
    got = catalog.overlapping(rows, ["g"], ["id"], 12, 2).groupBy("chunk").agg(F.min("place"), F.max("place")).orderBy("chunk").collect()
    assert [tuple(r) for r in got] == [(0, 0, 11), (1, 10, 21), (2, 20, 24)]
    with pytest.raises(ValueError):
        catalog.overlapping(rows, ["g"], ["id"], 2, 2)


@pytest.mark.parametrize("order", [["v", "k"], ["-v", "k"], ["k"]])
def test_numbered(spark, order):
    rng = np.random.default_rng(6)
    table = [(None if i % 3 else "a", i, None if i % 50 == 0 else float(rng.integers(0, 30))) for i in range(700)]
    got = numbered(spark.createDataFrame(table, "g string, k long, v double"), ["g"], order, "at", "n", parts=7).collect()
    down = order[0] == "-v"
    key = (lambda r: r[1]) if order == ["k"] else lambda r: ((r[2] is None) == down, (-1 if down else 1) * (r[2] or 0), r[1])
    for g in (None, "a"):
        own = sorted((r for r in table if r[0] == g), key=key)
        assert {r.k: (r.at, r.n) for r in got if r.g == g} == {r[1]: (i, len(own)) for i, r in enumerate(own)}
    assert numbered(spark.createDataFrame([], "g string, k long"), ["g"], ["k"]).count() == 0


def test_free_number(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 4), ("b", 2), ("c", 1), ("c", 1)], "g string, n long")
    assert {r.g: r.n for r in catalog.free_number(rows, ["g"]).collect()} == {"a": 3, "b": 1, "c": 2}


def test_statistics_take_sorted_places(spark):
    rows = spark.createDataFrame([("a", float(v)) for v in (5, 1, 4, 2, 3, 3)], "g string, score double")
    r = sharpness.statistics(rows, ["g"]).first()
    assert (r.n, r.median, r.q1, r.q3) == (6, 3.0, 2.0, 4.0)


def test_too_few_frames_is_an_error(spark):
    rows = spark.createDataFrame([(1, 2.0)], "seq long, score double")
    assert sharpness.checked(rows, 1).count() == 1
    with pytest.raises(Exception, match="are needed"):
        sharpness.checked(rows, 2).collect()
    with pytest.raises(Exception, match="are needed"):
        sharpness.checked(rows.limit(0), 1).collect()


def test_invalid_transforms(spark):
    rows = spark.createDataFrame([(1, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0), (2, math.nan, 0.0, 0.0, 0.0, 1.0, 0.0), (3, -1.0, 0.0, 0.0, 0.0, 1.0, 0.0), (4, 1.0, 0.0, 900.0, 0.0, 1.0, 0.0), (5, math.inf, 0.0, 0.0, 0.0, 1.0, 0.0)], "k long, m00 double, m01 double, m02 double, m10 double, m11 double, m12 double")
    assert {r.k: r.v for r in rows.withColumn("v", transforms.is_valid(1.5, 500.0, 2.5)).collect()} == {1: True, 2: False, 3: True, 4: False, 5: False}


def test_chain_resets_or_carries(spark):
    rows = spark.createDataFrame([(1, s, 1.0, 0.0, 2.0, 0.0, 1.0, 0.0, s == 3) for s in range(1, 6)], "g long, seq long, m00 double, m01 double, m02 double, m10 double, m11 double, m12 double, missing boolean")
    at = lambda carry: [r.m02 for r in transforms.chained(rows, ["g"], carry).orderBy("seq").collect()]
    assert at(False) == [2, 4, 0, 2, 4] and at(True) == [2, 4, 4, 6, 8]


def test_bounding_box_of_nothing_is_the_frame(spark):
    rows = spark.createDataFrame([(1, 2, 3, [0] * 6), (2, 2, 3, [0, 0, 0, 0, 0, 9])], "img long, h int, w int, mask array<int>")
    assert [tuple(r) for r in transforms.bounding_box(rows, ["img"]).orderBy("img").collect()] == [(1, 0, 0, 3, 2), (2, 2, 1, 1, 1)]


def test_small_rasters_are_scored(spark):
    rows = spark.createDataFrame([(1, 1, 1, [7]), (2, 3, 3, list(range(9)))], "img long, h int, w int, p array<int>")
    got = {r.img: r.score for r in sharpness.measures(rows).collect()}
    assert got[1] == 0 and got[2] > 0


def test_ties_go_to_the_last_frame(spark):
    rows = spark.createDataFrame([(0, i, 8, 8, [5] * 64) for i in (3, 9, 4)], "stack int, img long, h int, w int, p array<int>")
    assert {r.img for r in fusion.fused(rows, ["stack"]).collect()} == {9}


def test_array_and_packed_forms_agree(spark):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(i, 16, 12, rng.integers(0, 256, 192).tolist()) for i in range(5)], "img long, h int, w int, p array<int>")
    for name in ("lap_var", "tenengrad", "mod_laplacian", "score"):
        a = {r.img: r[name] for r in sharpness.measures(rows).collect()}
        assert a == pytest.approx({r.img: r[name] for r in kernels.measures(kernels.packed(rows)).collect()})
    for least in (3, 100):
        a = {r.img: (r.max_regional, r.global_score, r.sharp_areas) for r in sharpness.regional(rows, 4, least).collect()}
        b = {r.img: (r.max_regional, r.global_score, r.sharp_areas) for r in kernels.regional(kernels.packed(rows), 4, least).collect()}
        assert all(a[i] == pytest.approx(b[i]) for i in a) and len(a) == len(b) == 5


def pictures(spark, n=5, size=96):
    rng = np.random.default_rng(3)
    base = kernels.gaussian(rng.integers(0, 256, (size + 20, size + 20)).astype(float), 1.2)
    base = np.clip((base - base.mean()) * 4 + 128, 0, 255)
    rows = [(0, i, size, size, 1, bytearray(kernels.to_bytes(base[10 + i : 10 + i + size, 10 - i : 10 - i + size]).tobytes())) for i in range(n)]
    return spark.createDataFrame(rows, "stack int, img long, h int, w int, c int, data binary"), rows


def test_alignment_undoes_shifts(spark):
    frames, rows = pictures(spark)
    steps = {r.img: r for r in align.pair_transforms(frames, most=300).collect()}
    assert steps[0].missing and not any(steps[i].missing for i in range(1, 5))
    assert all(abs(steps[i].m02 + 1) < 0.2 and abs(steps[i].m12 - 1) < 0.2 for i in range(1, 5))
    done = align.align(frames, Settings(sharpness_threshold=10, iqr_multiplier=5), most=300)
    kept = {r.img: np.frombuffer(r.data, np.uint8).reshape(96, 96, 4) for r in done.collect()}
    first = np.frombuffer(bytes(rows[0][5]), np.uint8).reshape(96, 96).astype(int)
    for image in kept.values():
        assert np.abs(image[20:-20, 20:-20, 0].astype(int) - first[20:-20, 20:-20]).mean() < 6
    area = align.common_area(done).first()
    assert 80 <= area.width < 96 and 80 <= area.height < 96
    out = stack.stack(done, Settings(stack_batch=4, sharpen=True, sharpening=0.5, colour=True, contrast=1.1), align.common_area(done)).first()
    assert (out.w, out.h, out.c) == (area.width, area.height, 4)


def test_stacking_in_chunks_is_one_raster(spark):
    frames, _ = pictures(spark, 9, 24)
    out = stack.stack(frames, Settings(stack_batch=4)).collect()
    assert len(out) == 1 and len(out[0].data) == 24 * 24


def test_files_round_trip(spark, tmp_path):
    frames, rows = pictures(spark, 3, 16)
    images.write_files(images.as_png(frames.select(F.format_string("f%02d.png", "img").alias("name"), "h", "w", "c", "data")), str(tmp_path))
    (tmp_path / "broken.png").write_bytes(b"no picture")
    back = {r.path[-7:]: bytes(r.data) for r in images.read_png(spark, str(tmp_path)).collect()}
    assert back == {f"f{i:02d}.png": bytes(rows[i][5]) for i in range(3)}
    with pytest.raises(Exception, match="no PNG file"):
        images.read_png(spark, str(tmp_path), strict=True).collect()
    assert catalog.scan(spark, str(tmp_path)).count() == 4
    assert images.read_spark(spark, str(tmp_path)).count() == 3


def test_a_whole_series(spark, tmp_path):
    frames, _ = pictures(spark, 4, 64)
    folder = str(tmp_path)
    images.write_files(images.as_png(frames.select(F.format_string("f%02d.png", "img").alias("name"), "h", "w", "c", "data")), folder)
    settings = Settings(sharpness_threshold=10, iqr_multiplier=5)
    assert series.run(spark, folder, settings, most=200).endswith("final/result_0001.png")
    first = spark.read.parquet(f"{folder}/aligned").select("img", "out_name").collect()
    assert series.run(spark, folder, settings, most=200).endswith("final/result_0002.png")
    again = spark.read.parquet(f"{folder}/aligned").select("img", "out_name").collect()
    assert sorted(first) == sorted(again) and len(first) == 4  # nothing was warped twice
    (tmp_path / "final" / "result_0001.png").unlink()
    assert series.run(spark, folder, settings, resume=False, most=200).endswith("final/result_0001.png")
    out = images.decoded((tmp_path / "final" / "result_0002.png").read_bytes())
    assert out.shape[2] == 4 and 50 <= out.shape[0] < 64
    (tmp_path / "flat").mkdir()
    (tmp_path / "flat" / "a.png").write_bytes(images.encoded(np.full((32, 32), 9, np.uint8)))
    with pytest.raises(ValueError, match="no frame"):
        series.run(spark, f"{folder}/flat", settings, most=200)


@pytest.mark.parametrize("detector", ["sift", "akaze"])
def test_steps_by_every_detector(spark, detector):
    frames, _ = pictures(spark, 3)
    steps = {r.img: r for r in align.pair_transforms(frames, Settings(detector=detector), most=300).collect()}
    assert steps[0].missing and all(abs(steps[i].m02 + 1) < 0.2 and abs(steps[i].m12 - 1) < 0.2 for i in (1, 2))


def test_jpeg_files(spark, tmp_path):
    """Spark's own reader gives back what was written; at the best quality but for rounding."""
    y, x = np.mgrid[:41, :67]
    wave = np.clip(128 + 90 * np.sin(x / 9)[..., None] * np.cos(y[..., None] / [7, 5, 11]) + np.random.default_rng(5).normal(0, 6, (41, 67, 3)), 0, 255).astype(np.uint8)
    rows = [("grey", wave[..., 0]), ("colour", wave), ("clear", np.dstack([wave, wave[..., 0]])), ("dot", wave[:1, :1]), ("flat", np.full((8, 24), 77, np.uint8)), ("rough", np.random.default_rng(6).integers(0, 256, (33, 40), np.uint8))]
    made = [(f"{n}.jpg", *i.shape[:2], 1 if i.ndim == 2 else i.shape[2], bytearray(i.tobytes())) for n, i in rows]
    frames = spark.createDataFrame(made, "path string, h int, w int, c int, data binary")
    images.write_files(images.as_jpeg(frames, 100).withColumnRenamed("path", "name"), str(tmp_path))
    back = {r.path.rsplit("/", 1)[1]: np.frombuffer(r.data, np.uint8).reshape(r.h, r.w, r.c) for r in images.read_files(spark, str(tmp_path)).collect()}
    assert set(back) == {m[0] for m in made}
    for n, i in rows:
        told = i[..., None] if i.ndim == 2 else i[..., :3]
        assert np.abs(back[f"{n}.jpg"].astype(int) - told).mean() < 1, n
        assert len(jpeg.encoded(i)) <= len(jpeg.encoded(i, 100)) and jpeg.encoded(i) != jpeg.encoded(i, 20), n
    kept = series.cached_previews(frames, str(tmp_path), 30, 30).collect()
    assert len(kept) == 6 and all(bytes(r.content[:2]) == b"\xff\xd8" for r in kept) and series.clear_cache(spark, str(tmp_path))


def test_bunches_are_kept_and_fused_again(spark, tmp_path):
    frames, _ = pictures(spark, 9, 48)
    folder = str(tmp_path)
    settings = Settings(stack_batch=3, stack_overlap=1)
    kept = stack.stack(frames, settings, keep=series.written_bunches(spark, folder)).collect()
    assert kept[0].data == stack.stack(frames, settings).collect()[0].data
    names = [sorted(r.out_name for r in series.bunches(spark, folder, k).collect()) for k in (0, 1)]
    assert names == [[f"L0_B{i:04d}.png" for i in range(4)], [f"L1_B{i:04d}.png" for i in range(2)]]
    assert series.restacked(spark, folder, settings).endswith("final/result_0001.png")
    assert images.decoded((tmp_path / "final" / "result_0001.png").read_bytes()).shape == (48, 48)
    assert [series.bunches(spark, folder, k).count() for k in (0, 1)] == [4, 2]  # they stay


@pytest.mark.parametrize("layout", ["RGGB", "BGGR", "GRBG", "GBRG"])
def test_mosaics_of_every_layout(spark, layout):
    """Against one pixel at a time."""
    rows = [("a", 6, 4, [(37 * i * i + 11 * i) % 256 for i in range(24)]), ("b", 3, 5, [(91 * i) % 256 for i in range(15)]), ("c", 1, 1, [200]), ("d", 2, 1, [20, 250])]
    low, top, gain = (10.0, 20.0, 0.0), (200.0, 220.0, 240.0), (2.0, 1.6, 0.0)
    got = {(r.img, r.y, r.x): (r.b, r.g, r.r) for r in fusion.demosaiced(spark.createDataFrame(rows, "img string, h int, w int, p array<int>"), low, top, gain, layout=layout).collect()}
    told = {}
    for name, h, w, p in rows:
        for y in range(max(1, h // 2)):
            for x in range(max(1, w // 2)):
                sums = {c: [] for c in "RGB"}
                for k, c in enumerate(layout):
                    v, u, j = 2 * y + k // 2, 2 * x + k % 2, "RGB".index(c)
                    if v < h and u < w:
                        sums[c].append(min(1, max(0, (p[v * w + u] - low[j]) / (top[j] - low[j]))))
                mean = {c: sum(v) / len(v) if v else 0 for c, v in sums.items()}
                told[name, y, x] = tuple(int(min(1, mean[c] * {"R": 1.25, "G": 1, "B": 1}[c]) * 255 + 0.5) for c in "BGR")
    assert got == told
    with pytest.raises(ValueError):
        fusion.demosaiced(spark.createDataFrame(rows, "img string, h int, w int, p array<int>"), 0, 255, gain, layout="RGBE")


def test_records_round_trip(spark, tmp_path):
    rows = [("a.jpg", 8785.1, 1232.63, 5.0, 4, "2024-01-01T00:00:00+01:00", 2624, 1750), ("b.c.png", 1.0, 0.5, 1.0, 8, "t", 10, 20)]
    df = spark.createDataFrame(rows, "image_filename string, max_regional_sharpness double, global_sharpness double, sharp_region_count double, grid_size long, timestamp string, width int, height int")
    images.write_files(scores.as_files(df), str(tmp_path))
    (tmp_path / "broken.yml").write_text("nothing: here")
    (tmp_path / "quoted.yaml").write_text("image_filename: 'q r.tif'\nmax_regional_sharpness: 7\nimage_size: [3, 4]\n")
    back = {r.image_filename: r for r in scores.read_records(spark, str(tmp_path)).collect()}
    assert {tuple(back[r[0]][n] for n in [*scores.FIELDS, "width", "height"]) for r in rows} == set(rows)
    assert set(back) == {"a.jpg", "b.c.png", "q r.tif"} and (back["q r.tif"].width, back["q r.tif"].height) == (3, 4)
    scores.replace_table(df, str(tmp_path / "t"))
    scores.replace_table(df.limit(1), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1


def test_progress_and_selection(spark):
    df, seen = control.counted(spark.range(7), "n", top=F.max("id"))
    with control.cancellable(spark, "job"):
        assert len(df.collect()) == 7
    assert seen.get == {"rows": 7, "top": 6}
    assert control.cancel(spark, "job") == [] and control.selected(df, False).count() == 0
    assert control.may_run(spark.range(1), False) and not control.may_run(spark.range(0), False) and not control.may_run(spark.range(1), True)


def test_stream_of_scores(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    schema = "img long, h int, w int, p array<int>"
    rows = spark.createDataFrame([(i, 3, 3, [i, 0, 0, 0, 9, 0, 0, 0, 0]) for i in range(4)], schema)
    for n in (1, 2):
        rows.filter(f"img % 2 = {n - 1}").write.mode("append").parquet(source)
        ingest.into(ingest.scored(ingest.watched(spark, source, schema)), out, mark, once=True).awaitTermination()
        assert spark.read.parquet(out).count() == 2 * n
    seen = []
    ingest.latest(ingest.watched(spark, source, schema), ["h"], "img", lambda df: seen.extend(df.collect()), mark + "2", once=True).awaitTermination()
    assert max(r.img for r in seen) == 3
