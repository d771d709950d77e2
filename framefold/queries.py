"""The engine's queries over a data folder, and the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from math import ceil, exp, floor, pi, sin

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framefold.functions import paths
from framefold.functions.stencils import grey
from framefold.operators import catalog, estimation, fusion, kernels, matching, sharpness, transforms
from framefold.plans import previews, views
from framefold.sources.rasters import exploded, frames
from framefold.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: DuckDB views of the tables, as plans/views.py makes them.
_FILES = """files AS (SELECT doc_id AS id, 'd/IMG_' || doc_id || '.' || (['jpg','JPG','png','tif','ARW','cr2','txt'])[doc_id % 7 + 1] AS path,
  (['imported','sharpness','aligned','bunches','final'])[doc_id % 5 + 1] AS stage, doc_id % 100 AS mtime, doc_id + 4000 AS width FROM documents)"""
_CACHE = """cache AS (SELECT f.path, (l.doc_id * 7) % 100 AS mtime, CAST(l.doc_id % 13 + l.quality * 100.0 AS DOUBLE) AS score FROM labels l JOIN files f ON f.id = l.doc_id)"""
_EXT = "lower(regexp_extract(path, '[^/][.]([^./]*)$', 1))"
_STD = f"{_EXT} IN ({', '.join(repr(x) for x in paths.STANDARD)})"
_RAW = f"{_EXT} IN ({', '.join(repr(x) for x in paths.RAW)})"
_PX = """px AS (SELECT label AS stack, vec_id AS img, i // 8 AS y, i % 8 AS x, CAST(floor((CAST(embedding[i + 1] AS DOUBLE) + 1) * 127.5) AS BIGINT) AS p FROM embeddings, range(64) t(i))"""
_ALPHA = "CASE WHEN (img + y + x) % 7 = 0 THEN 0 ELSE 255 END"
_SCORES = "scores AS (SELECT event_type AS collection, event_id AS seq, value AS score FROM events)"
_STEPS = """steps AS (SELECT l_orderkey AS chain, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_returnflag, l_shipdate) AS seq,
  1 + l_discount / 7 AS m00, l_tax / 3 AS m01, l_quantity / 7 AS m02, -l_tax / 3 AS m10, 1 + l_discount / 7 AS m11, -l_quantity / 11 AS m12, l_returnflag = 'R' AS missing FROM lineitem)"""


def _kernel(name: str, rows: list[list[int]]) -> str:
    reach = len(rows) // 2
    return f"{name}(dy, dx, k) AS (VALUES {', '.join(f'({i - reach}, {j - reach}, {k})' for i, r in enumerate(rows) for j, k in enumerate(r) if k)})"


def _stencil(out: str, source: str, kernel: str, value: str = "p", n: int = 8) -> str:
    """A CTE of the kernel's sums; the border is mirrored without its edge."""
    at = f"abs({n - 1} - abs({n - 1} - (c.{{0}} + k.d{{0}})))"
    return f"{out} AS (SELECT c.stack, c.img, c.y, c.x, CAST(sum(k.k * s.{value}) AS BIGINT) AS {value} FROM {source} c, {kernel} k JOIN {source} s ON s.img = c.img AND s.y = {at.format('y')} AND s.x = {at.format('x')} GROUP BY ALL)"


_L5 = _kernel("l5", sharpness.LAPLACE5)
_G3 = _kernel("g3", sharpness.GAUSS3)
_SX, _SY = _kernel("kx", sharpness.SOBEL_X), _kernel("ky", sharpness.SOBEL_Y)
_ENERGY = f"{_PX}, {_L5}, {_G3}, {_stencil('lap', 'px', 'l5')}, pos AS (SELECT stack, img, y, x, abs(p) AS p FROM lap), {_stencil('energy', 'pos', 'g3')}"
_MEASURES = f"""{_G3}, {_L5}, {_SX}, {_SY}, {_stencil('blur', 'px', 'g3')}, {_stencil('lap', 'blur', 'l5')}, {_stencil('gx', 'px', 'kx')}, {_stencil('gy', 'px', 'ky')},
  m1 AS (SELECT img, sum(p * p) / 64.0 AS s, sum(p) / 64.0 AS m FROM lap GROUP BY img),
  m2 AS (SELECT gx.img, sum(gx.p * gx.p + gy.p * gy.p) / 64.0 AS tenengrad, sum(least(255, least(255, abs(gx.p)) + least(255, abs(gy.p)))) / 64.0 AS mod_laplacian FROM gx JOIN gy ON gx.img = gy.img AND gx.y = gy.y AND gx.x = gy.x GROUP BY gx.img),
  measures AS (SELECT img, CAST((s - m * m) / 256 AS DOUBLE) AS lap_var, CAST(tenengrad AS DOUBLE) AS tenengrad, CAST(mod_laplacian AS DOUBLE) AS mod_laplacian FROM m1 JOIN m2 USING (img))"""
_SCORE = "(0.4 * lap_var + 0.3 * tenengrad + 0.3 * mod_laplacian) / 0.5"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# Catalogue


@query("ext_classify", f"WITH {_FILES} SELECT id, path, {_EXT} AS ext, CASE WHEN {_STD} THEN 'standard' WHEN {_RAW} THEN 'raw' ELSE 'other' END AS kind, {_STD} OR {_RAW} AS is_image FROM files")
def ext_classify(spark: SparkSession, d: str) -> DataFrame:
    return catalog.classified(views.files(spark, d).select("id", "path"))


_NAME = "regexp_extract(path, '([^/]*)$', 1)"
_STEM = "regexp_replace(regexp_extract(path, '([^/]*)$', 1), '(.)[.][^.]*$', '\\1')"


@query(
    "path_stem_yaml",
    f"""WITH {_FILES} SELECT path, {_NAME} AS filename, {_STEM} AS stem, 'd/sharpness/' || {_STEM} || '.yml' AS score_path, 'd/.thumbnails/' || {_NAME} || '.png' AS thumb_path,
  'd/.previews/' || {_STEM} || '_1920.jpg' AS preview_path, 'd/resized/' || CASE WHEN {_RAW} THEN {_STEM} || '.png' ELSE {_NAME} END AS resized_path FROM files""",
)
def path_stem_yaml(spark: SparkSession, d: str) -> DataFrame:
    return catalog.derived_paths(views.files(spark, d).select("path"))


_SPEC = "CASE id % 7 WHEN 0 THEN CAST(n AS VARCHAR) WHEN 1 THEN CAST(n % 150 AS VARCHAR) || '%' WHEN 2 THEN ' 12 ' WHEN 3 THEN '' WHEN 4 THEN 'abc' WHEN 5 THEN '-5' ELSE '2400.5' END"


@query(
    "resize_target_parse",
    f"""WITH s AS (SELECT doc_id AS id, n_chars AS n, doc_id + 4000 AS width, doc_id % 3000 + 1 AS height FROM documents), t AS (SELECT id, width, height, trim({_SPEC}) AS spec FROM s),
  u AS (SELECT id, width, height, spec, CASE WHEN spec LIKE '%\\%' ESCAPE '\\' THEN CAST(round(width * TRY_CAST(trim(substr(spec, 1, length(spec) - 1)) AS DOUBLE) / 100) AS BIGINT) WHEN regexp_full_match(spec, '[+-]?[0-9]+') THEN TRY_CAST(spec AS BIGINT) END AS v FROM t)
  SELECT id, spec, CASE WHEN v > 0 THEN v END AS target_w, CASE WHEN v > 0 THEN CAST(round(CAST(height AS DOUBLE) * v / width) AS BIGINT) END AS target_h FROM u""",
)
def resize_target_parse(spark: SparkSession, d: str) -> DataFrame:
    """P4, P5."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("n"), (F.col("doc_id") + 4000).alias("width"), (F.col("doc_id") % 3000 + 1).alias("height"))
    rows = rows.withColumn("spec", F.expr(f"trim({_SPEC.replace('VARCHAR', 'STRING')})")).withColumn("target_w", F.expr(paths.resize_target("spec", "width")))
    return rows.select("id", "spec", "target_w", F.expr("cast(round(double(height) * target_w / width) as bigint)").alias("target_h"))


_SIZES = "SELECT doc_id AS id, n_chars + 1 AS w, doc_id % 3000 + 1 AS h FROM documents"


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") + 1).alias("w"), (F.col("doc_id") % 3000 + 1).alias("h"))


@query("thumb_fit", f"WITH s AS ({_SIZES}), f AS (SELECT id, w, h, least(CAST(800 AS DOUBLE) / w, CAST(800 AS DOUBLE) / h) AS k FROM s) SELECT id, CAST(floor(w * k) AS BIGINT) AS tw, CAST(floor(h * k) AS BIGINT) AS th FROM f")
def thumb_fit(spark: SparkSession, d: str) -> DataFrame:
    """May enlarge; sizes are cut to whole pixels."""
    return _sizes(spark, d).withColumn("k", F.expr(paths.fitted("w", "h", "800", "800"))).selectExpr("id", "cast(floor(w * k) as bigint) tw", "cast(floor(h * k) as bigint) th")


@query(
    "preview_fit",
    f"WITH s AS ({_SIZES}), f AS (SELECT id, w, h, least(CAST(1920 AS DOUBLE) / w, CAST(1080 AS DOUBLE) / h, 1) AS k FROM s) SELECT id, k < 0.95 AS resized, CASE WHEN k < 0.95 THEN CAST(floor(w * k) AS BIGINT) ELSE w END AS pw, CASE WHEN k < 0.95 THEN CAST(floor(h * k) AS BIGINT) ELSE h END AS ph FROM f",
)
def preview_fit(spark: SparkSession, d: str) -> DataFrame:
    """P8."""
    rows = _sizes(spark, d).withColumn("k", F.expr(paths.fitted("w", "h", "1920", "1080", "1D")))
    return rows.selectExpr("id", "k < 0.95D resized", "if(k < 0.95D, cast(floor(w * k) as bigint), w) pw", "if(k < 0.95D, cast(floor(h * k) as bigint), h) ph")


@query(
    "jpeg_reduction",
    f"WITH s AS ({_SIZES}) SELECT id, CASE WHEN least(CAST(1920 AS DOUBLE) / (w / 8.0), CAST(1080 AS DOUBLE) / (h / 8.0)) <= 1 THEN 8 WHEN least(CAST(1920 AS DOUBLE) / (w / 4.0), CAST(1080 AS DOUBLE) / (h / 4.0)) <= 1 THEN 4 WHEN least(CAST(1920 AS DOUBLE) / (w / 2.0), CAST(1080 AS DOUBLE) / (h / 2.0)) <= 1 THEN 2 ELSE 1 END AS reduction FROM s",
)
def jpeg_reduction(spark: SparkSession, d: str) -> DataFrame:
    """The strongest reduction whose result still covers the screen."""
    ladder = " ".join(f"when {paths.fitted(f'(w / {n}D)', f'(h / {n}D)', '1920', '1080')} <= 1 then {n}" for n in (8, 4, 2))
    return _sizes(spark, d).selectExpr("id", f"case {ladder} else 1 end reduction")


@query(
    "batch_sizing",
    """WITH s AS (SELECT event_id AS id, CAST(user_id % 64 + 1 AS DOUBLE) AS gb, CAST(event_id % 200 + 1 AS DOUBLE) AS mb FROM events), m AS (SELECT id, greatest(4, CAST(floor(gb * 0.5 * 1024 / mb) AS BIGINT)) AS m FROM s)
  SELECT id, least(16, greatest(4, m)) AS sharpness_batch, least(32, greatest(8, 2 * m)) AS feature_batch, least(24, greatest(8, m)) AS warp_batch, least(16, greatest(6, m // 2)) AS stack_batch FROM m""",
)
def batch_sizing(spark: SparkSession, d: str) -> DataFrame:
    """P27."""
    rows = table(spark, d, "events").selectExpr("event_id id", "double(user_id % 64 + 1) gb", "double(event_id % 200 + 1) mb")
    return rows.select("id", *[F.expr(e).cast("long").alias(k) for k, e in paths.batch_sizes("gb", "mb").items()])


@query(
    "feature_batch",
    """WITH s AS (SELECT event_id AS id, (['orb','sift','akaze'])[event_id % 3 + 1] AS detector, user_id % 60 AS mp, event_id % 32 + 1 AS b FROM events)
  SELECT id, detector, CASE WHEN mp > 30 THEN CASE detector WHEN 'orb' THEN least(3, b) WHEN 'sift' THEN 3 ELSE 2 END ELSE CASE detector WHEN 'orb' THEN b ELSE greatest(b // 4, 3) END END AS batch FROM s""",
)
def feature_batch(spark: SparkSession, d: str) -> DataFrame:
    """P28."""
    rows = table(spark, d, "events").selectExpr("event_id id", "element_at(array('orb', 'sift', 'akaze'), int(event_id % 3 + 1)) detector", "user_id % 60 mp", "event_id % 32 + 1 b")
    return rows.selectExpr("id", "detector", f"cast({paths.feature_batch('detector', 'mp', 'b')} as bigint) batch")


@query("cache_valid_join", f"WITH {_FILES}, {_CACHE} SELECT f.path, f.mtime, c.mtime AS cached FROM files f JOIN cache c ON c.path = f.path AND c.mtime >= f.mtime")
def cache_valid_join(spark: SparkSession, d: str) -> DataFrame:
    return catalog.fresh(views.files(spark, d).select("path", "mtime"), views.cache(spark, d)).select("path", "mtime", "cached")


@query("missing_thumbnails_anti", f"WITH {_FILES}, {_CACHE} SELECT f.path, f.mtime FROM files f WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE c.path = f.path AND c.mtime >= f.mtime)")
def missing_thumbnails_anti(spark: SparkSession, d: str) -> DataFrame:
    return catalog.missing(views.files(spark, d).select("path", "mtime"), views.cache(spark, d))


@query("cached_score_coalesce", f"WITH {_FILES}, {_CACHE} SELECT f.path, c.score IS NOT NULL AS from_cache, coalesce(c.score, CAST(f.width AS DOUBLE)) AS score FROM files f LEFT JOIN cache c ON c.path = f.path")
def cached_score_coalesce(spark: SparkSession, d: str) -> DataFrame:
    computed = views.files(spark, d).select("path", F.col("width").cast("double").alias("score"))
    return catalog.scores_or_cached(computed, views.cache(spark, d).select("path", "score"), ["path"]).select("path", "from_cache", "score")


_NAMED = f"named AS (SELECT path, stage, {_NAME} AS filename, {_STEM} AS stem FROM files)"
_SCORED = "scored AS (SELECT 'IMG_' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.jpg' ELSE '.png' END AS filename, 'IMG_' || doc_id AS stem FROM labels)"


def _named(spark: SparkSession, d: str) -> DataFrame:
    return catalog.derived_paths(views.files(spark, d).select("path", "stage")).select("path", "stage", "filename", "stem")


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").selectExpr("concat('IMG_', doc_id, if(doc_id % 3 = 0, '.jpg', '.png')) filename", "concat('IMG_', doc_id) stem")


@query("two_key_sharpness_join", f"WITH {_FILES}, {_NAMED}, {_SCORED} SELECT s.filename, s.stem, coalesce((SELECT min(path) FROM named n WHERE n.filename = s.filename), (SELECT min(path) FROM named n WHERE n.stem = s.stem AND n.path NOT LIKE '%txt')) AS image_path FROM scored s")
def two_key_sharpness_join(spark: SparkSession, d: str) -> DataFrame:
    images = catalog.classified(_named(spark, d)).filter("is_image").select("path", "filename", "stem")
    return catalog.image_of_score(_scored(spark, d), images).select("filename", "stem", "image_path")


@query("stem_join", f"WITH {_FILES}, {_NAMED}, {_SCORED} SELECT s.stem, min(n.path) AS image_path FROM scored s JOIN named n ON n.stem = s.stem GROUP BY s.stem, s.filename")
def stem_join(spark: SparkSession, d: str) -> DataFrame:
    return catalog.first_image_by_stem(_scored(spark, d), _named(spark, d)).select("stem", "image_path")


@query("existing_semi", f"WITH {_FILES}, {_NAMED}, {_SCORED} SELECT filename, stem FROM scored s WHERE EXISTS (SELECT 1 FROM named n WHERE n.filename = s.filename)")
def existing_semi(spark: SparkSession, d: str) -> DataFrame:
    return catalog.with_image(_scored(spark, d), _named(spark, d)).select("filename", "stem")


@query("resume_skip", f"WITH {_FILES}, {_CACHE} SELECT path, printf('aligned_%04d.png', id) AS out_name FROM files WHERE path NOT IN (SELECT path FROM cache)")
def resume_skip(spark: SparkSession, d: str) -> DataFrame:
    """K2."""
    inputs = views.files(spark, d).select("path", F.format_string("aligned_%04d.png", "id").alias("out_name"))
    done = inputs.join(views.cache(spark, d).select("path"), "path", "left_semi")
    return catalog.unfinished(inputs, done).select("path", "out_name")


@query("free_output_name", f"WITH {_FILES}, e AS (SELECT DISTINCT stage, id // 5 + 1 AS n FROM files WHERE (id // 5) % 11 <> id % 5), k AS (SELECT stage, n, row_number() OVER (PARTITION BY stage ORDER BY n) AS k FROM e) SELECT s.stage, printf('result_%04d.png', coalesce((SELECT max(n) FROM k WHERE k.stage = s.stage AND n = k), 0) + 1) AS name FROM (SELECT DISTINCT stage FROM e) s")
def free_output_name(spark: SparkSession, d: str) -> DataFrame:
    """K4."""
    taken = views.files(spark, d).filter("(id div 5) % 11 <> id % 5").selectExpr("stage", "id div 5 + 1 n")
    return catalog.free_number(taken, ["stage"]).select("stage", F.format_string("result_%04d.png", "n").alias("name"))


@query("toggle_selection", f"WITH {_FILES}, {_CACHE}, s AS (SELECT path, id AS place FROM files WHERE id % 3 = 0), t AS (SELECT path, id AS place FROM files WHERE id % 4 = 0) SELECT path, place FROM s WHERE path NOT IN (SELECT path FROM t) UNION ALL SELECT path, place + (SELECT max(place) FROM s) + 1 FROM t WHERE path NOT IN (SELECT path FROM s)")
def toggle_selection(spark: SparkSession, d: str) -> DataFrame:
    files = views.files(spark, d).select("path", F.col("id").alias("place"))
    return catalog.toggled(files.filter("place % 3 = 0"), files.filter("place % 4 = 0"))


@query("stage_refresh_merge", f"WITH {_FILES}, b AS (SELECT stage, path FROM files), s AS (SELECT stage, path || '.new' AS path FROM files WHERE stage IN ('aligned', 'final')) SELECT stage, path FROM b WHERE stage NOT IN (SELECT stage FROM s) UNION ALL SELECT stage, path FROM s")
def stage_refresh_merge(spark: SparkSession, d: str) -> DataFrame:
    before = views.files(spark, d).select("stage", "path")
    return catalog.merged_stages(before, before.filter("stage in ('aligned', 'final')").withColumn("path", F.concat("path", F.lit(".new"))))


@query("stage_union", f"WITH {_FILES}, {_CACHE} SELECT path, 'thumbnail' AS wanted FROM files WHERE stage <> 'sharpness' AND path NOT IN (SELECT path FROM cache) UNION ALL SELECT path, 'score' FROM files WHERE stage = 'sharpness'")
def stage_union(spark: SparkSession, d: str) -> DataFrame:
    """O3, O4."""
    files = views.files(spark, d)
    thumbs = files.filter("stage <> 'sharpness'").join(views.cache(spark, d).select("path"), "path", "left_anti").select("path", F.lit("thumbnail").alias("wanted"))
    return thumbs.unionByName(files.filter("stage = 'sharpness'").select("path", F.lit("score").alias("wanted")))


@query("cascading_delete", f"WITH {_FILES}, {_NAMED}, {_SCORED}, del AS (SELECT path, stem FROM named WHERE stage = 'final') SELECT 'files' AS tab, path AS name FROM named WHERE path NOT IN (SELECT path FROM del) UNION ALL SELECT 'scores', stem FROM scored WHERE stem NOT IN (SELECT stem FROM del)")
def cascading_delete(spark: SparkSession, d: str) -> DataFrame:
    """K10, O5."""
    named = _named(spark, d)
    left = catalog.without({"files": named, "scores": _scored(spark, d)}, named.filter("stage = 'final'").select("path", "stem"))
    return left["files"].select(F.lit("files").alias("tab"), F.col("path").alias("name")).unionByName(left["scores"].select(F.lit("scores").alias("tab"), F.col("stem").alias("name")))


@query("preferred_source", f"WITH {_FILES}, o AS (SELECT id % 10 AS folder, path FROM files), r AS (SELECT folder, 'resized/' || path AS path FROM o WHERE folder < 4) SELECT folder, path FROM r UNION ALL SELECT folder, path FROM o WHERE folder NOT IN (SELECT folder FROM r)")
def preferred_source(spark: SparkSession, d: str) -> DataFrame:
    """F7."""
    originals = views.files(spark, d).selectExpr("id % 10 folder", "path")
    return catalog.preferred_source(originals, originals.filter("folder < 4").withColumn("path", F.concat(F.lit("resized/"), "path")), "folder")


@query(
    "cyclic_neighbors",
    f"WITH {_FILES}, f AS (SELECT id // 50 AS folder, path FROM files) SELECT folder, path, coalesce(lead(path) OVER w, first_value(path) OVER a) AS next_path, coalesce(lag(path) OVER w, last_value(path) OVER a) AS prev_path, row_number() OVER w * CAST(100 AS DOUBLE) / count(*) OVER a AS progress FROM f WINDOW w AS (PARTITION BY folder ORDER BY path), a AS (PARTITION BY folder ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
)
def cyclic_neighbors(spark: SparkSession, d: str) -> DataFrame:
    rows = views.files(spark, d).selectExpr("id div 50 folder", "path")
    return catalog.neighbours(rows, ["folder"]).withColumn("progress", F.col("progress").cast("double"))


@query("tumbling_batches", f"WITH {_SCORES} SELECT collection, seq, (row_number() OVER (PARTITION BY collection ORDER BY seq) - 1) // 12 AS batch FROM scores")
def tumbling_batches(spark: SparkSession, d: str) -> DataFrame:
    return catalog.tumbling(views.scores(spark, d), ["collection"], ["seq"], 12).select("collection", "seq", "batch")


@query(
    "overlap_chunks",
    f"""WITH {_SCORES}, r AS (SELECT collection, seq, row_number() OVER (PARTITION BY collection ORDER BY seq) - 1 AS place, count(*) OVER (PARTITION BY collection) AS n FROM scores),
  c AS (SELECT DISTINCT collection, n, unnest(range(greatest(0, CAST(ceil((n - 12) / 10.0) AS BIGINT)) + 1)) AS chunk FROM r)
  SELECT r.collection, r.seq, r.place, c.chunk FROM r JOIN c ON c.collection = r.collection AND r.place BETWEEN c.chunk * 10 AND c.chunk * 10 + 11""",
)
def overlap_chunks(spark: SparkSession, d: str) -> DataFrame:
    return catalog.overlapping(views.scores(spark, d), ["collection"], ["seq"], 12, 2).select("collection", "seq", "place", "chunk")


# Sharpness


@query("gray_convert", f"WITH {_PX} SELECT img, y, x, CAST(floor(0.114 * CAST(p AS DOUBLE) + 0.587 * CAST((p + 85) % 256 AS DOUBLE) + 0.299 * CAST((p + 170) % 256 AS DOUBLE) + 0.5) AS INTEGER) AS grey FROM px")
def gray_convert(spark: SparkSession, d: str) -> DataFrame:
    rows = frames(spark, d).withColumn("grey", F.expr(f"transform(p, v -> {grey('v', '((v + 85) % 256)', '((v + 170) % 256)')})"))
    return exploded(rows.select("img", "w", "grey"), "grey").select("img", F.col("y").cast("long"), F.col("x").cast("long"), "grey")


@query("laplacian_energy", f"WITH {_ENERGY} SELECT img, y, x, p AS energy FROM energy")
def laplacian_energy(spark: SparkSession, d: str) -> DataFrame:
    rows = sharpness.energy(frames(spark, d)).select("img", "w", "energy")
    return exploded(rows, "energy").select("img", F.col("y").cast("long"), F.col("x").cast("long"), F.col("energy").cast("long"))


def _measured(spark: SparkSession, d: str) -> DataFrame:
    return sharpness.measures(frames(spark, d))


for _name, _column in (("laplacian_variance", "lap_var"), ("sobel_tenengrad", "tenengrad"), ("mod_laplacian_saturated", "mod_laplacian")):
    query(_name, f"WITH {_PX}, {_MEASURES} SELECT img, round({_column}, 4) AS {_column} FROM measures")(lambda spark, d, c=_column: _measured(spark, d).select("img", F.round(c, 4).alias(c)))


@query("combined_sharpness", f"WITH {_PX}, {_MEASURES} SELECT img, round({_SCORE}, 4) AS score FROM measures")
def combined_sharpness(spark: SparkSession, d: str) -> DataFrame:
    return _measured(spark, d).select("img", F.round("score", 4).alias("score"))


def _cell_measures() -> str:
    """The measures of 4 by 4 cells, each with its own border."""
    px = "px AS (SELECT stack, img * 4 + (y // 4) * 2 + x // 4 AS img, y % 4 AS y, x % 4 AS x, p FROM px0)"
    steps = ", ".join([_G3, _L5, _SX, _SY, _stencil("blur", "px", "g3", n=4), _stencil("lap", "blur", "l5", n=4), _stencil("gx", "px", "kx", n=4), _stencil("gy", "px", "ky", n=4)])
    return f"""{_PX.replace('px AS', 'px0 AS', 1)}, {px}, {steps},
  c1 AS (SELECT img, sum(p * p) / 16.0 AS s, sum(p) / 16.0 AS m FROM lap GROUP BY img),
  c2 AS (SELECT gx.img, sum(gx.p * gx.p + gy.p * gy.p) / 16.0 AS t, sum(least(255, least(255, abs(gx.p)) + least(255, abs(gy.p)))) / 16.0 AS q FROM gx JOIN gy ON gx.img = gy.img AND gx.y = gy.y AND gx.x = gy.x GROUP BY gx.img),
  cells AS (SELECT img // 4 AS img, (0.4 * CAST((s - m * m) / 256 AS DOUBLE) + 0.3 * CAST(t AS DOUBLE) + 0.3 * CAST(q AS DOUBLE)) / 0.5 AS score FROM c1 JOIN c2 USING (img))"""


@query("regional_sharpness", f"WITH {_cell_measures()}, b AS (SELECT img, max(score) AS m FROM cells GROUP BY img) SELECT img, round(any_value(b.m), 4) AS max_regional, count(*) FILTER (WHERE score >= 0.7 * m) AS sharp_areas FROM cells JOIN b USING (img) GROUP BY img")
def regional_sharpness(spark: SparkSession, d: str) -> DataFrame:
    """With cells of four pixels or more, so that the rasters have four."""
    rows = sharpness.regional(frames(spark, d).select("img", "h", "w", "p"), 4, least=4)
    return rows.select("img", F.round("max_regional", 4).alias("max_regional"), "sharp_areas")


@query("regional_too_small", f"WITH {_PX}, {_MEASURES} SELECT img, round({_SCORE}, 4) AS max_regional, round({_SCORE}, 4) AS global_score, CAST(1 AS BIGINT) AS sharp_areas FROM measures")
def regional_too_small(spark: SparkSession, d: str) -> DataFrame:
    rows = sharpness.regional(frames(spark, d).select("img", "h", "w", "p"), 4)
    return rows.select("img", F.round("max_regional", 4).alias("max_regional"), F.round("global_score", 4).alias("global_score"), "sharp_areas")


def _quartiles(source: str) -> str:
    at = "list_sort(list(score))[CAST({} AS BIGINT) + 1]"
    return f"SELECT collection, count(*) AS n, {at.format('count(*) // 2')} AS median, {at.format('count(*) // 4')} AS q1, {at.format('(3 * count(*)) // 4')} AS q3, avg(score) AS mean, stddev_pop(score) AS stddev, min(score) AS low, max(score) AS high FROM {source} GROUP BY collection"


@query("collection_stats", f"WITH {_SCORES} SELECT collection, n, median, q1, q3, round(mean, 4) AS mean, round(stddev, 4) AS stddev, low, high FROM ({_quartiles('scores')})")
def collection_stats(spark: SparkSession, d: str) -> DataFrame:
    rows = sharpness.statistics(views.scores(spark, d), ["collection"])
    return rows.select("collection", "n", "median", "q1", "q3", F.round("mean", 4).alias("mean"), F.round("stddev", 4).alias("stddev"), "low", "high")


@query("absolute_filter", f"WITH {_SCORES} SELECT collection, seq, score FROM scores WHERE score >= 30")
def absolute_filter(spark: SparkSession, d: str) -> DataFrame:
    return sharpness.above(views.scores(spark, d), 30.0)


_KEPT = f"{_SCORES}, sharp AS (SELECT * FROM scores WHERE score >= 5), q AS ({_quartiles('sharp')}), kept AS (SELECT s.* FROM sharp s JOIN q USING (collection) WHERE s.score >= greatest(q.q1 - 0.5 * (q.q3 - q.q1), 5))"


@query("iqr_filter", f"WITH {_KEPT} SELECT collection, seq, score FROM kept")
def iqr_filter(spark: SparkSession, d: str) -> DataFrame:
    return sharpness.without_outliers(views.scores(spark, d), ["collection"], 5.0, 0.5).select("collection", "seq", "score")


@query("frame_counters", f"WITH {_KEPT} SELECT collection, count(*) AS total, count(*) FILTER (WHERE score >= 5) AS sharp, (SELECT count(*) FROM kept k WHERE k.collection = s.collection) AS kept, count(*) - (SELECT count(*) FROM kept k WHERE k.collection = s.collection) AS skipped FROM scores s GROUP BY collection")
def frame_counters(spark: SparkSession, d: str) -> DataFrame:
    return sharpness.counted(views.scores(spark, d), ["collection"], 5.0, 0.5)


@query("reference_frame_middle", f"WITH {_SCORES}, r AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY score DESC, seq) AS rn, count(*) OVER (PARTITION BY collection) AS n FROM scores) SELECT collection, seq, score FROM r WHERE rn = n // 2 + 1")
def reference_frame_middle(spark: SparkSession, d: str) -> DataFrame:
    return sharpness.middle_frame(views.scores(spark, d), ["collection"])


@query("first_sharp_frame", f"WITH {_SCORES} SELECT collection, min(seq) AS seq, arg_min(score, seq) AS score FROM scores WHERE score >= 30 GROUP BY collection")
def first_sharp_frame(spark: SparkSession, d: str) -> DataFrame:
    return sharpness.first_frame(sharpness.above(views.scores(spark, d), 30.0), ["collection"])


# Matching

_KP = f"{_PX}, kp AS (SELECT img // 50 AS stack, img // 10 AS frame, img % 10 AS kp_id, list(p ORDER BY y, x) AS d FROM px GROUP BY img)"
_CODES = f"{_PX}, kp AS (SELECT img // 50 AS stack, img // 10 AS frame, img % 10 AS kp_id, list(p > 127 ORDER BY y, x) AS d FROM px GROUP BY img)"
_L2 = "list_sum(list_transform(list_zip(q.d, t.d), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
_BITS = "len(list_filter(list_zip(q.d, t.d), lambda z: z[1] <> z[2]))"


def _near(kp: str, distance: str, mutual: bool = False) -> str:
    all_ = f"{kp}, d AS (SELECT q.stack, q.frame AS query_img, q.kp_id AS query_id, t.kp_id AS train_id, CAST({distance} AS BIGINT) AS dist FROM kp q JOIN kp t ON t.stack = q.stack AND t.frame = q.frame - 1)"
    best = "m AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_img, query_id ORDER BY dist, train_id) = 1"
    return f"{all_}, {best}{' AND row_number() OVER (PARTITION BY query_img, train_id ORDER BY dist, query_id) = 1' if mutual else ''})"


def _pairs(spark: SparkSession, d: str, binary: bool = False) -> DataFrame:
    return matching.consecutive(views.keypoints(spark, d, binary), ["stack"])


_MATCH = "SELECT stack, query_img, query_id, train_id, dist FROM m"


@query("nn_match_l2", f"WITH {_near(_KP, _L2)} {_MATCH}")
def nn_match_l2(spark: SparkSession, d: str) -> DataFrame:
    return matching.nearest(_pairs(spark, d), ["stack"])


@query("hamming_nn_match", f"WITH {_near(_CODES, _BITS)} {_MATCH}")
def hamming_nn_match(spark: SparkSession, d: str) -> DataFrame:
    return matching.nearest(_pairs(spark, d, True), ["stack"], binary=True)


@query("mutual_nn_match", f"WITH {_near(_CODES, _BITS, True)} {_MATCH}")
def mutual_nn_match(spark: SparkSession, d: str) -> DataFrame:
    return matching.nearest(_pairs(spark, d, True), ["stack"], binary=True, mutual=True)


@query("top_half_matches", f"WITH {_near(_KP, _L2)}, r AS (SELECT *, row_number() OVER (PARTITION BY stack, query_img ORDER BY dist, query_id) AS rn, count(*) OVER (PARTITION BY stack, query_img) AS n FROM m) SELECT stack, query_img, query_id, train_id, dist, CAST(rn AS INTEGER) AS rn FROM r WHERE rn <= least(greatest(floor(n * 0.5), 4), n)")
def top_half_matches(spark: SparkSession, d: str) -> DataFrame:
    return matching.best_matches(nn_match_l2(spark, d), ["stack", "query_img"], 0.5, 4)


@query("strongest_keypoints", f"WITH {_KP} SELECT stack, frame AS img, kp_id, CAST(d[1] AS DOUBLE) AS response FROM kp QUALIFY row_number() OVER (PARTITION BY frame ORDER BY d[1] DESC, kp_id) <= 3")
def strongest_keypoints(spark: SparkSession, d: str) -> DataFrame:
    return matching.strongest(views.keypoints(spark, d), 3).select("stack", "img", "kp_id", "response")


# Transforms

_VALID = "sqrt(m00 * m00 + m10 * m10) BETWEEN 1 / CAST({0} AS DOUBLE) AND {0} AND sqrt(m01 * m01 + m11 * m11) BETWEEN 1 / CAST({0} AS DOUBLE) AND {0} AND sqrt(m02 * m02 + m12 * m12) <= {1} AND abs(m00 * m11 - m01 * m10) BETWEEN 1 / CAST({2} AS DOUBLE) AND {2}"


@query("transform_validity", f"WITH {_STEPS} SELECT chain, seq, {_VALID.format(1.012, 5, 1.02)} AS valid, abs(m00 - 1) < 0.01 AND abs(m11 - 1) < 0.01 AND abs(m01) < 0.01 AND abs(m10) < 0.01 AND abs(m02) < 1 AND abs(m12) < 1 AS near_identity FROM steps")
def transform_validity(spark: SparkSession, d: str) -> DataFrame:
    return views.steps(spark, d).select("chain", "seq", transforms.is_valid(1.012, 5.0, 1.02).alias("valid"), transforms.near_identity().alias("near_identity"))


@query("fallback_ladder", f"WITH {_STEPS}, g AS (SELECT chain, arg_min({{'m00': m00, 'm02': m02, 'm12': m12}}, seq) AS m, min(seq) AS rung FROM steps WHERE {_VALID.format(1.01, 4, 1.015)} GROUP BY chain) SELECT s.chain, coalesce(g.rung, -1) AS rung, round(coalesce(g.m.m00, 1), 4) AS m00, round(coalesce(g.m.m02, 0), 4) AS m02, round(coalesce(g.m.m12, 0), 4) AS m12 FROM (SELECT DISTINCT chain FROM steps) s LEFT JOIN g USING (chain)")
def fallback_ladder(spark: SparkSession, d: str) -> DataFrame:
    rows = transforms.by_ladder(views.steps(spark, d).withColumnRenamed("seq", "rung"), ["chain"], 1.01, 4.0, 1.015)
    return rows.select("chain", F.col("rung").cast("long"), *[F.round(c, 4).alias(c) for c in ("m00", "m02", "m12")])


_CHAIN = """WITH RECURSIVE {steps}, c(chain, seq, m00, m01, m02, m10, m11, m12) AS (
  SELECT chain, seq, CASE WHEN missing THEN 1 ELSE m00 END, CASE WHEN missing THEN 0 ELSE m01 END, CASE WHEN missing THEN 0 ELSE m02 END, CASE WHEN missing THEN 0 ELSE m10 END, CASE WHEN missing THEN 1 ELSE m11 END, CASE WHEN missing THEN 0 ELSE m12 END FROM steps WHERE seq = 1
  UNION ALL SELECT s.chain, s.seq, CASE WHEN missing THEN 1 ELSE c.m00 * s.m00 + c.m01 * s.m10 END, CASE WHEN missing THEN 0 ELSE c.m00 * s.m01 + c.m01 * s.m11 END, CASE WHEN missing THEN 0 ELSE c.m00 * s.m02 + c.m01 * s.m12 + c.m02 END,
  CASE WHEN missing THEN 0 ELSE c.m10 * s.m00 + c.m11 * s.m10 END, CASE WHEN missing THEN 1 ELSE c.m10 * s.m01 + c.m11 * s.m11 END, CASE WHEN missing THEN 0 ELSE c.m10 * s.m02 + c.m11 * s.m12 + c.m12 END FROM c JOIN steps s ON s.chain = c.chain AND s.seq = c.seq + 1)
  SELECT chain, seq, round(m00, 6) AS m00, round(m01, 6) AS m01, round(m02, 6) AS m02, round(m10, 6) AS m10, round(m11, 6) AS m11, round(m12, 6) AS m12 FROM c"""


@query("transform_chain_reset", _CHAIN.format(steps=_STEPS))
def transform_chain_reset(spark: SparkSession, d: str) -> DataFrame:
    return transforms.chained(views.steps(spark, d), ["chain"]).select("chain", "seq", *[F.round(c, 6).alias(c) for c in transforms.M])


# Fusion

_PXA = f"{_PX}, pxa AS (SELECT *, {_ALPHA} AS a FROM px)"


@query("wta_fusion", f"WITH {_ENERGY}, j AS (SELECT p.stack, p.img, p.y, p.x, p.p, e.p AS e FROM px p JOIN energy e ON e.img = p.img AND e.y = p.y AND e.x = p.x) SELECT stack, y, x, CAST(p AS INTEGER) AS p, img FROM j QUALIFY row_number() OVER (PARTITION BY stack, y, x ORDER BY e DESC, img DESC) = 1")
def wta_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fused(frames(spark, d), ["stack"]).select("stack", F.col("y").cast("long"), F.col("x").cast("long"), "p", "img")


@query(
    "wta_alpha_weighted",
    f"""WITH {_ENERGY}, last AS (SELECT stack, max(img) AS l FROM px GROUP BY stack), j AS (SELECT p.stack, p.img, p.y, p.x, p.p, e.p * CASE WHEN p.img = l THEN 255 ELSE {_ALPHA.replace('img', 'p.img').replace(' y', ' p.y').replace(' x)', ' p.x)')} END AS e FROM px p JOIN energy e ON e.img = p.img AND e.y = p.y AND e.x = p.x JOIN last ON last.stack = p.stack)
  SELECT stack, y, x, CAST(p AS INTEGER) AS p, img FROM j QUALIFY row_number() OVER (PARTITION BY stack, y, x ORDER BY e DESC, img DESC) = 1""",
)
def wta_alpha_weighted(spark: SparkSession, d: str) -> DataFrame:
    rows = fusion.alpha_weighted(views.frames_with_alpha(spark, d), ["stack"])
    return fusion.winners(rows, ["stack"]).select("stack", F.col("y").cast("long"), F.col("x").cast("long"), "p", "img")


@query("alpha_and", f"WITH {_PXA} SELECT stack, y, x, CASE WHEN min(a) > 0 THEN 255 ELSE 0 END AS alpha FROM pxa GROUP BY stack, y, x")
def alpha_and(spark: SparkSession, d: str) -> DataFrame:
    rows = views.frames_with_alpha(spark, d)
    return fusion.alpha_and(rows, ["stack"]).select("stack", F.col("y").cast("long"), F.col("x").cast("long"), "alpha")


_REACH = ", ".join(f"({i - 5}, {r})" for i, r in enumerate(fusion.ELLIPSE11))


@query("alpha_erode", f"WITH {_PXA}, r(dy, reach) AS (VALUES {_REACH}) SELECT c.img, c.y, c.x, min(n.a) AS eroded FROM pxa c JOIN pxa n ON n.img = c.img JOIN r ON n.y - c.y = r.dy AND abs(n.x - c.x) <= r.reach GROUP BY c.img, c.y, c.x")
def alpha_erode(spark: SparkSession, d: str) -> DataFrame:
    rows = fusion.eroded(views.frames_with_alpha(spark, d)).select("img", "w", "eroded")
    return exploded(rows, "eroded").select("img", F.col("y").cast("long"), F.col("x").cast("long"), "eroded")


@query("alpha_census", f"WITH {_PXA} SELECT stack, min(a) AS min_alpha, max(a) AS max_alpha, round(avg(a), 4) AS mean_alpha, count(*) FILTER (WHERE a >= 128) AS half_opaque, count(*) FILTER (WHERE a >= 250) AS opaque, round(count(*) FILTER (WHERE a >= 250) * 100.0 / count(*), 4) AS opaque_pct FROM pxa GROUP BY stack")
def alpha_census(spark: SparkSession, d: str) -> DataFrame:
    rows = fusion.census(views.frames_with_alpha(spark, d), ["stack"])
    return rows.withColumns({c: F.round(c, 4) for c in ("mean_alpha", "opaque_pct")})


@query("valid_bbox", f"WITH {_PX}, o AS (SELECT img, y, x FROM px WHERE p > 140) SELECT img, CAST(coalesce(min(o.x), 0) AS INTEGER) AS x, CAST(coalesce(min(o.y), 0) AS INTEGER) AS y, CAST(coalesce(max(o.x) - min(o.x) + 1, 8) AS INTEGER) AS width, CAST(coalesce(max(o.y) - min(o.y) + 1, 8) AS INTEGER) AS height FROM (SELECT DISTINCT img FROM px) i LEFT JOIN o USING (img) GROUP BY img")
def valid_bbox(spark: SparkSession, d: str) -> DataFrame:
    rows = frames(spark, d).withColumn("mask", F.expr("transform(p, v -> if(v > 140, 255, 0))"))
    return transforms.bounding_box(rows, ["img"])


@query("crop_roi", f"WITH {_PX} SELECT img, y - 1 AS y, x - 2 AS x, CAST(p AS INTEGER) AS p FROM px WHERE x BETWEEN 2 AND 6 AND y BETWEEN 1 AND 4")
def crop_roi(spark: SparkSession, d: str) -> DataFrame:
    pixels = exploded(frames(spark, d).select("img", "w", "p"), "p")
    return fusion.cropped(pixels, 2, 1, 5, 4).select("img", F.col("y").cast("long"), F.col("x").cast("long"), "p")


def _sat(x: str) -> str:
    return f"CAST(least(255, greatest(0, round_even({x}, 0))) AS INTEGER)"


def _toned(c: str) -> str:
    return _sat(f"CASE WHEN top = 0 THEN 0 ELSE {c} * held / top END")


@query(
    "color_correct",
    f"""WITH {_PX}, c AS (SELECT img, y, x, CAST(p AS INTEGER) AS b, CAST((p + 85) % 256 AS INTEGER) AS g, CAST((p + 170) % 256 AS INTEGER) AS r FROM px), t AS (SELECT *, greatest(b, g, r) AS top, CAST({_sat('greatest(b, g, r) * CAST(1.25 AS DOUBLE)')} AS DOUBLE) AS held FROM c)
  SELECT img, y, x, {_sat(_toned('b') + ' * CAST(1.5 AS DOUBLE) + -20')} AS b, {_sat(_toned('g') + ' * CAST(1.5 AS DOUBLE) + -20')} AS g, {_sat(_toned('r') + ' * CAST(1.5 AS DOUBLE) + -20')} AS r FROM t""",
)
def color_correct(spark: SparkSession, d: str) -> DataFrame:
    pixels = exploded(frames(spark, d).select("img", "w", "p"), "p").selectExpr("img", "bigint(y) y", "bigint(x) x", "p b", "(p + 85) % 256 g", "(p + 170) % 256 r")
    b, g, r = fusion.coloured("b", "g", "r", 1.25, 1.5, -20.0)
    return pixels.select("img", "y", "x", b.alias("b"), g.alias("g"), r.alias("r"))


@query(
    "mask_warp_nearest",
    f"""WITH {_PXA}, whole AS MATERIALIZED (SELECT img, list(CAST(a AS INTEGER) ORDER BY y, x) AS m FROM pxa GROUP BY img), places(y, x) AS (SELECT i // 8, i % 8 FROM range(64) t(i)),
  s AS (SELECT img, m, y, x, CAST(floor(x - 1.5 + 0.5) AS BIGINT) AS sx, CAST(floor(y + 2.25 + 0.5) AS BIGINT) AS sy FROM whole, places)
  SELECT img, y, x, CASE WHEN sx BETWEEN 0 AND 7 AND sy BETWEEN 0 AND 7 THEN m[sy * 8 + sx + 1] ELSE 0 END AS warped FROM s""",
)
def mask_warp_nearest(spark: SparkSession, d: str) -> DataFrame:
    moved = views.frames_with_alpha(spark, d).selectExpr("*", "1D m00", "0D m01", "1.5D m02", "0D m10", "1D m11", "-2.25D m12")
    return exploded(fusion.warped_nearest(moved).select("img", "w", "warped"), "warped").select("img", F.col("y").cast("long"), F.col("x").cast("long"), "warped")


def _cfa(v: str, gain: float) -> str:
    return f"CAST(round(least(1, {v} * CAST({gain} AS DOUBLE)) * 255) AS INTEGER)"


@query(
    "raw_demosaic_2x2",
    f"""WITH {_PX}, held AS (SELECT img, y, x, least(1, greatest(0, (CAST(p AS DOUBLE) - 16) / CAST(200 AS DOUBLE))) AS v FROM px),
  m AS (SELECT img, y // 2 AS y, x // 2 AS x, max(v) FILTER (WHERE y % 2 = 0 AND x % 2 = 0) AS r, avg(v) FILTER (WHERE y % 2 <> x % 2) AS g, max(v) FILTER (WHERE y % 2 = 1 AND x % 2 = 1) AS b FROM held GROUP BY img, held.y // 2, held.x // 2)
  SELECT img, y, x, {_cfa('b', 1.25)} AS b, {_cfa('g', 1.0)} AS g, {_cfa('r', 1.5)} AS r FROM m""",
)
def raw_demosaic_2x2(spark: SparkSession, d: str) -> DataFrame:
    rows = fusion.demosaiced(frames(spark, d).select("img", "h", "w", "p"), 16.0, 216.0, (3.0, 2.0, 2.5))
    return rows.select("img", F.col("y").cast("long"), F.col("x").cast("long"), "b", "g", "r")


@query("stage_counts", f"WITH {_FILES} SELECT stage, count(*) AS files, count(*) FILTER (WHERE {_STD}) AS standard, count(*) FILTER (WHERE {_RAW}) AS raw FROM files GROUP BY stage")
def stage_counts(spark: SparkSession, d: str) -> DataFrame:
    """What each stage folder holds."""
    return catalog.classified(views.files(spark, d)).groupBy("stage").agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("kind") == "standard").alias("standard"), F.count_if(F.col("kind") == "raw").alias("raw"))


# Kernels and estimation: rows only, tested against properties and hand-made values


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return kernels.packed(frames(spark, d))


def _dealt(rasters: DataFrame) -> DataFrame:
    """Rasters over all cores: they cost more to work on than to move, and a table may come as one task, or joined as one a stack."""
    return rasters.repartition(4 * rasters.sparkSession.sparkContext.defaultParallelism, "img")


def _with_first(spark: SparkSession, d: str) -> DataFrame:
    """Each frame with the pixels (ref) of the first of its stack."""
    rows = _packed(spark, d).select("stack", "img", "h", "w", "c", "data")
    first = rows.groupBy("stack").agg(F.min_by("data", "img").alias("ref"))
    return _dealt(rows.join(first, "stack"))


@query("packed_laplacian_variance", f"WITH {_PX}, {_MEASURES} SELECT img, round(lap_var, 4) AS lap_var FROM measures")
def packed_laplacian_variance(spark: SparkSession, d: str) -> DataFrame:
    """The packed form of laplacian_variance, which real rasters take."""
    return kernels.measures(_packed(spark, d).select("img", "h", "w", "c", "data")).select("img", F.round("lap_var", 4).alias("lap_var"))


@query("packed_regional_sharpness", ORACLES["regional_sharpness"])
def packed_regional_sharpness(spark: SparkSession, d: str) -> DataFrame:
    """The packed form of regional_sharpness."""
    rows = kernels.regional(_packed(spark, d).select("img", "h", "w", "c", "data"), 4, least=4)
    return rows.select("img", F.round("max_regional", 4).alias("max_regional"), "sharp_areas")


@query("pyramid_stack")
def pyramid_stack(spark: SparkSession, d: str) -> DataFrame:
    """A12-A14 over each stack at once."""
    rows = kernels.in_reverse(_packed(spark, d), ["stack"])
    return kernels.fused_once(rows, ["stack"])


@query("hierarchical_stack")
def hierarchical_stack(spark: SparkSession, d: str) -> DataFrame:
    """A15."""
    return kernels.stacked(kernels.in_reverse(_packed(spark, d), ["stack"]), ["stack"])


Weights = list[tuple[int, int, float]]


def _kernel_query(name: str, kernel: Callable, sql: str | None = None) -> None:
    """A kernel over every frame: (img, h, w, c, pixels), the bytes in hexadecimal digits."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = kernels.mapped(_packed(spark, d).select("img", "h", "w", "c", "data"), kernel)
        return rows.select("img", "h", "w", "c", F.lower(F.hex("data")).alias("pixels"))

    query(name, sql)(run)


def _bytes(image: np.ndarray) -> np.ndarray:
    """Halves that sums in another order would miss by their last digits are halves."""
    return kernels.to_bytes(np.round(image, 6))


def _linear(t: float) -> list[tuple[int, float]]:
    return [(0, 1 - t), (1, t)]


def _lanczos(t: float) -> list[tuple[int, float]]:
    def wave(x: float) -> float:
        return 1.0 if x == 0 else sin(pi * x) * sin(pi * x / 4) / (pi * x) ** 2 * 4

    total = sum(wave(t - k) for k in range(-3, 5))
    return [(k, wave(t - k) / total) for k in range(-3, 5)]


def _at(places: list[float], taps: Callable, edge: bool, n: int = 8) -> Weights:
    """(out, in, weight) of places on a line of n pixels; outside is nothing, or the edge pixel."""
    out = [(i, floor(x) + k, v) for i, x in enumerate(places) for k, v in taps(x - floor(x))]
    return [(i, min(max(x, 0), n - 1), v) for i, x, v in out if edge or 0 <= x < n]


def _scaled(m: int, n: int = 8) -> list[float]:
    return [min(max((i + 0.5) * n / m - 0.5, 0), n - 1) for i in range(m)]


def _areas(m: int, n: int = 8) -> Weights:
    return [(i, x, max(0.0, min((i + 1) * n / m, x + 1) - max(i * n / m, x)) * m / n) for i in range(m) for x in range(n)]


def _blurred(sigma: float, n: int = 8) -> Weights:
    reach = ceil(3 * sigma)
    k = [exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    return [(i, abs((i + d) % (2 * n - 2)) if (i + d) % (2 * n - 2) < n else 2 * n - 2 - (i + d) % (2 * n - 2), v / sum(k)) for i in range(n) for d, v in zip(range(-reach, reach + 1), k, strict=True)]


def _separable(rows: Weights, columns: Weights, value: str = "v") -> str:
    """SQL: sums of pixels by weights along each axis, as a kernel's bytes."""
    h, w = max(i for i, _, _ in rows) + 1, max(j for j, _, _ in columns) + 1
    wy, wx = (", ".join(f"({i}, {x}, {v:.17e})" for i, x, v in part) for part in (rows, columns))
    return f"""WITH {_PX}, wy(i, y, k) AS (VALUES {wy}), wx(j, x, k) AS (VALUES {wx}), o AS (SELECT img, i, j, sum(wy.k * wx.k * p) AS v, max(CASE WHEN wy.i = wy.y AND wx.j = wx.x THEN p END) AS p FROM px JOIN wy USING (y) JOIN wx USING (x) GROUP BY img, i, j)
  SELECT img, {h} AS h, {w} AS w, 1 AS c, string_agg(printf('%02x', CAST(least(255, greatest(0, round_even(round({value}, 6), 0))) AS INTEGER)), '' ORDER BY i, j) AS pixels FROM o GROUP BY img"""


_SHIFT = np.array([[1, 0, 0.5], [0, 1, -0.25]])
_DOWN, _RIGHT = [y + 0.25 for y in range(8)], [x - 0.5 for x in range(8)]

_kernel_query("clahe", lambda image: kernels.equalised(image, tiles=2))
_kernel_query("bilateral", lambda image: kernels.bilateral(image, 1.0))
_kernel_query("unsharp", lambda image: _bytes(2 * image.astype(float) - kernels.gaussian(image.astype(float), 3.0)), _separable(_blurred(3.0), _blurred(3.0), "2 * p - v"))
_kernel_query("warp_lanczos", lambda image: _bytes(kernels.warped(image.astype(float), _SHIFT)), _separable(_at(_DOWN, _lanczos, False), _at(_RIGHT, _lanczos, False)))
_kernel_query("warp_bilinear", lambda image: _bytes(kernels.warped(image.astype(float), _SHIFT, taps=kernels.linear_taps)), _separable(_at(_DOWN, _linear, False), _at(_RIGHT, _linear, False)))
_kernel_query("resize_bilinear", lambda image: _bytes(kernels.resized(image, 5, 6)), _separable(_at(_scaled(5), _linear, True), _at(_scaled(6), _linear, True)))
_kernel_query("resize_lanczos", lambda image: _bytes(kernels.resized(image, 12, 10, kernels.lanczos_taps)), _separable(_at(_scaled(12), _lanczos, True), _at(_scaled(10), _lanczos, True)))
_kernel_query("thumbnail_rgba", lambda image: previews.thumbnail(image, 4))
_kernel_query("thumbnail_area", lambda image: _bytes(kernels.area_resized(image, 3, 3)), _separable(_areas(3), _areas(3)))


@query("ransac_affine")
def ransac_affine(spark: SparkSession, d: str) -> DataFrame:
    """A similarity for each chain of points."""
    points = views.steps(spark, d).selectExpr("chain pair", "double(seq * 7 % 5) * 10 qx", "double(seq * 3 % 7) * 10 qy", "double(seq * 7 % 5) * 10 + 3 tx", "double(seq * 3 % 7) * 10 - 2 + if(missing, 50, 0) ty")
    return estimation.fitted(points, ["pair"], "similarity")


@query("ecc_translation")
def ecc_translation(spark: SparkSession, d: str) -> DataFrame:
    """Each frame against the first of its stack."""
    return estimation.aligned(_with_first(spark, d), ["stack", "img"], "translation")


@query("corner_features")
def corner_features(spark: SparkSession, d: str) -> DataFrame:
    """Corners at many scales with binary descriptors."""
    return estimation.features(_dealt(_packed(spark, d).select("img", "h", "w", "c", "data")), 20)


@query("registration_ladder")
def registration_ladder(spark: SparkSession, d: str) -> DataFrame:
    """A22-A24 over each frame and the first of its stack."""
    return estimation.registered(_with_first(spark, d), ["stack", "img"])
