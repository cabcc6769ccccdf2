"""The registered queries of the image engine and the SQL that gives the same rows.

No table holds images, so each query derives its inputs from columns that exist.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import color as C
from .functions import encoding as E
from .functions import geometry as G
from .functions import naming as N
from .operators import compose as P
from .operators import raster as R
from .plans.pick_crop import pick_crop
from .sources.files import read_sources
from .sources.sinks import skip_existing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Headers of the kinds, cut and wrong ones among them.
HEADERS = ("FFD8FFE0", "89504E47", "524946460400000057454250", "524946460400000041564920", "FFD8", "", "424D")
_HEADER_SQL = "CASE event_id % 7 " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(HEADERS)) + " END"
_KIND_SQL = (
    f"(SELECT event_id, h, CASE WHEN starts_with(h, 'FFD8FF') THEN 'jpg' WHEN starts_with(h, '89504E') THEN 'png'"
    f" WHEN starts_with(h, '52494646') AND length(h) >= 24 AND substr(h, 17, 8) = '57454250' THEN 'webp' END AS kind"
    f" FROM (SELECT event_id, {_HEADER_SQL} AS h FROM events))")


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select("event_id", F.unhex(F.expr(_HEADER_SQL)).alias("bytes"))


@query(f"""SELECT event_id, starts_with(h, 'FFD8FF') AS is_jpg, starts_with(h, '89504E') AS is_png, coalesce(kind = 'webp', false) AS is_webp, kind,
  CASE WHEN kind = 'jpg' THEN -1 END::INTEGER AS quality, CASE WHEN kind IS NULL THEN 'unsupported_type' END AS error FROM {_KIND_SQL}""")
def q01_sniff(spark, sf_dir):
    b = F.col("bytes")
    e = E.sniff_encoding(b)
    return _headers(spark, sf_dir).select(
        "event_id", E.is_jpg(b).alias("is_jpg"), E.is_png(b).alias("is_png"), E.is_webp(b).alias("is_webp"), e["kind"].alias("kind"),
        e["quality"].alias("quality"), F.when(e["kind"].isNull(), "unsupported_type").alias("error"))


@query(f"""SELECT event_id, CASE kind WHEN 'jpg' THEN 'image/jpeg' WHEN 'png' THEN 'image/png' WHEN 'webp' THEN 'image/webp' END AS mime,
  CASE kind WHEN 'jpg' THEN '.jpg' WHEN 'png' THEN '.png' WHEN 'webp' THEN '.webp' END AS extension FROM {_KIND_SQL}""")
def q02_mime_ext(spark, sf_dir):
    kind = E.sniff_kind(F.col("bytes"))
    return _headers(spark, sf_dir).select("event_id", E.mime_type(kind).alias("mime"), E.extension(kind).alias("extension"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_size - 2 = -1 THEN 'Jpg' ELSE 'Jpg(' || (p_size - 2) || ')' END WHEN 1 THEN 'Png' ELSE 'Webp' END AS label FROM part""")
def q03_label(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("jpg"), F.lit("png"), F.lit("webp")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return _table(spark, sf_dir, "part").select("p_partkey", E.label(kind, F.col("p_size") - 2).alias("label"))


@query("""SELECT event_id, (event_id % 126 - 5)::INTEGER AS quality, event_id % 126 - 5 BETWEEN -1 AND 100 AS ok,
  CASE WHEN event_id % 126 - 5 NOT BETWEEN -1 AND 100 THEN 'bad_quality' END AS error FROM events""")
def q04_quality_check(spark, sf_dir):
    q = (F.col("event_id") % 126 - 5).cast("int")
    ok = E.quality_ok(q)
    return _table(spark, sf_dir, "events").select("event_id", q.alias("quality"), ok.alias("ok"), F.when(~ok, "bad_quality").alias("error"))


@query("""SELECT doc_id, '{width: ' || (doc_id % 640 + 1) || ', height: ' || (doc_id % 480 + 1) || ', encoding: Png, sizeInBytes: ' || strlen(text) || '}' AS debug,
  '{' || concat_ws(', ', CASE WHEN doc_id % 2 = 0 THEN 'width: ' || doc_id % 640 END, CASE WHEN doc_id % 3 = 0 THEN 'height: ' || doc_id % 480 END) || '}' AS options FROM documents""")
def q05_debug_map(spark, sf_dir):
    d = F.col("doc_id")
    w, h = d % 640, d % 480
    return _table(spark, sf_dir, "documents").select(
        "doc_id", E.debug_text(w + 1, h + 1, E.label(F.lit("png"), F.lit(None).cast("int")), F.col("text").cast("binary")).alias("debug"),
        E.options_text(width=F.when(d % 2 == 0, w), height=F.when(d % 3 == 0, h)).alias("options"))


def _argb(df: DataFrame) -> DataFrame:
    e = F.col("event_id")
    return df.select("event_id", *[((e * k + o) % 256).cast("int").alias(n) for n, k, o in (("a", 7, 255), ("r", 13, 1), ("g", 29, 2), ("b", 31, 3))])


_ARGB = "(SELECT event_id, (event_id * 7 + 255) % 256 AS a, (event_id * 13 + 1) % 256 AS r, (event_id * 29 + 2) % 256 AS g, (event_id * 31 + 3) % 256 AS b FROM events)"


@query(f"SELECT event_id, ((a << 24) | (b << 16) | (g << 8) | r)::BIGINT AS color FROM {_ARGB}")
def q06_color_pack(spark, sf_dir):
    rows = _argb(_table(spark, sf_dir, "events"))
    return rows.select("event_id", C.pack_color(*map(F.col, "argb")).alias("color"))


@query("""SELECT event_id, (c >> 24 & 255)::INTEGER AS a, (c >> 16 & 255)::INTEGER AS r, (c >> 8 & 255)::INTEGER AS g, (c & 255)::INTEGER AS b
  FROM (SELECT event_id, (event_id * 2654435761) % 4294967296 AS c FROM events)""")
def q07_color_unpack(spark, sf_dir):
    parts = C.unpack_color((F.col("event_id") * 2654435761) % 4294967296)
    return _table(spark, sf_dir, "events").select("event_id", *[parts[n].alias(n) for n in "argb"])


@query(f"SELECT event_id, a::INTEGER AS a, b::INTEGER AS r, g::INTEGER AS g, r::INTEGER AS b FROM {_ARGB}")
def q08_color_roundtrip(spark, sf_dir):
    parts = C.unpack_color(C.pack_color(*map(F.col, "argb")))
    return _argb(_table(spark, sf_dir, "events")).select("event_id", *[parts[n].alias(n) for n in "argb"])


_LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    col = F.col
    cropped = col("l_linenumber") % 2 == 0
    return _table(spark, sf_dir, "lineitem").select(
        *_LINE_KEY, F.when(col("l_partkey") % 2 == 0, col("l_quantity").cast("int")).alias("w"),
        F.when(col("l_suppkey") % 3 == 0, (col("l_tax") * 1000).cast("int") + 1).alias("h"),
        F.when(cropped, col("l_quantity") + 0.5).alias("cw"), F.when(cropped, col("l_discount") * 100 + 0.5).alias("ch"),
        (col("l_partkey") % 640 + 1).cast("int").alias("lw"), (col("l_suppkey") % 480 + 1).cast("int").alias("lh"))


_REQUESTS = """(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 2 = 0 THEN trunc(l_quantity)::INTEGER END AS w,
  CASE WHEN l_suppkey % 3 = 0 THEN trunc(l_tax * 1000)::INTEGER + 1 END AS h,
  CASE WHEN l_linenumber % 2 = 0 THEN l_quantity + 0.5::DOUBLE END AS cw, CASE WHEN l_linenumber % 2 = 0 THEN l_discount * 100 + 0.5::DOUBLE END AS ch,
  (l_partkey % 640 + 1)::INTEGER AS lw, (l_suppkey % 480 + 1)::INTEGER AS lh FROM lineitem)"""
_RATIO = "CASE WHEN cw IS NOT NULL THEN cw / ch ELSE lw::DOUBLE / lh END"
_RESOLVED = f"""CASE WHEN w IS NOT NULL THEN w WHEN h IS NOT NULL THEN round(h * ({_RATIO}))::INTEGER ELSE coalesce(round(cw)::INTEGER, lw) END AS width,
  CASE WHEN h IS NOT NULL THEN h WHEN w IS NOT NULL THEN round(w / ({_RATIO}))::INTEGER ELSE coalesce(round(ch)::INTEGER, lh) END AS height"""


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_RESOLVED} FROM {_REQUESTS}")
def q09_resolve_size(spark, sf_dir):
    size = G.resolve_size(*map(F.col, ("w", "h", "cw", "ch", "lw", "lh")))
    return _requests(spark, sf_dir).select(*_LINE_KEY, size["width"].alias("width"), size["height"].alias("height"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 3 > 0 THEN p_size::DOUBLE / (p_partkey % 50 + 1) WHEN p_partkey % 5 > 0 THEN 1.5::DOUBLE END AS aspect FROM part""")
def q10_aspect(spark, sf_dir):
    k = F.col("p_partkey")
    aspect = G.aspect_ratio(F.when(k % 2 == 0, F.col("p_size")), F.when(k % 3 > 0, k % 50 + 1), F.when(k % 5 > 0, 1.5))
    return _table(spark, sf_dir, "part").select("p_partkey", aspect.alias("aspect"))


@query("""SELECT p_partkey, (w - cw) / 2 AS "left", (h - ch) / 2 AS top, cw AS width, ch AS height FROM (
  SELECT p_partkey, w, h, CASE WHEN r IS NULL THEN w WHEN w / h > r THEN h * r ELSE w END AS cw, CASE WHEN r IS NULL OR w / h > r THEN h ELSE w / r END AS ch
  FROM (SELECT p_partkey, (p_size * 10)::DOUBLE AS w, (p_partkey % 300 + 1)::DOUBLE AS h,
          CASE p_partkey % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 16.0::DOUBLE / 9 WHEN 2 THEN 0.75::DOUBLE END AS r FROM part))""")
def q11_autocrop(spark, sf_dir):
    k = F.col("p_partkey")
    ratio = F.when(k % 4 == 0, 1.0).when(k % 4 == 1, 16.0 / 9).when(k % 4 == 2, 0.75)
    r = G.auto_crop(F.col("p_size") * 10, k % 300 + 1, ratio)
    return _table(spark, sf_dir, "part").select("p_partkey", *[r[n].alias(n) for n in ("left", "top", "width", "height")])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, trunc(x)::INTEGER AS trunc_left, trunc(y)::INTEGER AS trunc_top, trunc(w)::INTEGER AS trunc_width,
  round(x)::INTEGER AS round_left, round(y)::INTEGER AS round_top, round(w)::INTEGER AS round_width
  FROM (SELECT *, l_discount * 1000 - 50.5::DOUBLE AS x, l_quantity * -0.5::DOUBLE AS y, l_extendedprice / 8 AS w FROM lineitem)""")
def q12_rect_round_modes(spark, sf_dir):
    r = G.rect(F.col("l_discount") * 1000 - 50.5, F.col("l_quantity") * -0.5, F.col("l_extendedprice") / 8, F.lit(1.0))
    t, n = G.truncated_rect(r), G.rounded_rect(r)
    return _table(spark, sf_dir, "lineitem").select(*_LINE_KEY, *[x[c].alias(f"{p}_{c}") for p, x in (("trunc", t), ("round", n)) for c in ("left", "top", "width")])


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(w, round(cw)::INTEGER, lw) AS width, coalesce(h, round(ch)::INTEGER, lh) AS height FROM {_REQUESTS}""")
def q13_legacy_size(spark, sf_dir):
    return _requests(spark, sf_dir).select(
        *_LINE_KEY, *[G.legacy_size(F.col(a), F.col(c), F.col(i)).alias(n) for n, a, c, i in (("width", "w", "cw", "lw"), ("height", "h", "ch", "lh"))])


@query("""SELECT p_partkey, greatest(1, p_size - 5)::INTEGER AS width, greatest(1, round((p_size - 5) / ((p_partkey % 640 + 1)::DOUBLE / (p_size * 7)))::INTEGER)::INTEGER AS height FROM part""")
def q14_webp_dims(spark, sf_dir):
    size = G.conversion_size(F.col("p_size") - 5, F.col("p_partkey") % 640 + 1, F.col("p_size") * 7)
    return _table(spark, sf_dir, "part").select("p_partkey", size["width"].alias("width"), size["height"].alias("height"))


@query("SELECT o_orderkey, o_custkey::INTEGER AS width, (o_orderkey % 4096 + 1)::INTEGER AS height FROM orders")
def q15_png_header(spark, sf_dir):
    number = lambda c: F.lpad(F.hex(c), 8, "0")
    head = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), number(F.col("o_custkey")), number(F.col("o_orderkey") % 4096 + 1), F.lit("0806000000")))
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", head.alias("bytes"))
    size = P.png_header_size(F.col("bytes"))
    return rows.select("o_orderkey", size["width"].alias("width"), size["height"].alias("height"))


_TARGETS = """(SELECT event_id, m.mode, CASE event_id % 5 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' WHEN 3 THEN 'bmp' END AS k,
  CASE WHEN event_id % 5 = 0 THEN event_id % 102 - 1 END AS q FROM events, (VALUES ('correct'), ('placeholder'), ('compose'), ('compose_web'), ('legacy')) m(mode))"""


@query(f"""SELECT event_id, mode, CASE WHEN bad THEN NULL WHEN k = 'jpg' OR (mode = 'placeholder' AND other) THEN 'jpg' ELSE 'png' END AS bytes_kind,
  CASE WHEN bad THEN NULL WHEN k = 'jpg' OR (mode = 'placeholder' AND other) THEN 'jpg' WHEN mode = 'correct' OR k IS NULL THEN 'png' ELSE k END AS label_kind,
  CASE WHEN k = 'jpg' THEN CASE WHEN q = -1 THEN 50 ELSE q END WHEN mode = 'placeholder' AND other THEN 50 END::INTEGER AS label_quality,
  CASE WHEN bad THEN 'unsupported_target' END AS error
  FROM (SELECT *, coalesce(k NOT IN ('jpg', 'png'), true) AS other, mode = 'compose_web' AND coalesce(k NOT IN ('jpg', 'png'), true) AS bad FROM {_TARGETS})""")
def q16_encode_target(spark, sf_dir):
    e = F.col("event_id")
    kind = F.when(e % 5 == 0, "jpg").when(e % 5 == 1, "png").when(e % 5 == 2, "webp").when(e % 5 == 3, "bmp")
    rows = _table(spark, sf_dir, "events").select("event_id", F.explode(F.lit(list(E.MODES))).alias("mode"))
    t = E.encode_target(kind, F.when(e % 5 == 0, e % 102 - 1).cast("int"), F.col("mode"))
    return rows.select("event_id", "mode", *[t[n].alias(n) for n in ("bytes_kind", "label_kind", "label_quality", "error")])


@query("SELECT o_orderkey, 'out/' || o_orderkey || '.webp' AS dst FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 1)")
def q17_skip_existing(spark, sf_dir):
    name = lambda c: F.concat(F.lit("out/"), F.col(c).cast("string"), F.lit(".webp")).alias("dst")
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", name("o_orderkey"))
    return skip_existing(rows, _table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(name("l_orderkey")))


@query(f"""SELECT l_orderkey, {_RESOLVED}, n_layers FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k,
  count(*) OVER (PARTITION BY l_orderkey) AS n_layers FROM {_REQUESTS}) WHERE k = 1""")
def q18_first_layer(spark, sf_dir):
    names = ("w", "h", "cw", "ch", "lw", "lh")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    first = _requests(spark, sf_dir).groupBy("l_orderkey").agg(F.min_by(F.struct(*names), order).alias("f"), F.count(F.lit(1)).alias("n_layers"))
    size = G.resolve_size(*[F.col(f"f.{n}") for n in names])
    return first.select("l_orderkey", size["width"].alias("width"), size["height"].alias("height"), "n_layers")


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").where("size(embedding) = 64").select("vec_id", F.col("embedding").cast("array<double>").alias("px"))


_TILES = "(SELECT vec_id, embedding::DOUBLE[] AS px FROM embeddings WHERE len(embedding) = 64)"


def _nine(px) -> F.Column:
    return F.transform(px, lambda v: F.round(v, 9)).alias("px")


@query(f"SELECT vec_id, list_transform(range(0, 12), lambda i: px[(i // 4 + 2) * 8 + i % 4 + 3 + 1]) AS px FROM {_TILES}")
def q19_raster_crop(spark, sf_dir):
    return _tiles(spark, sf_dir).select("vec_id", R.crop(F.col("px"), 8, 8, 3, 2, 4, 3).alias("px"))


@query(f"SELECT vec_id, list_transform(range(0, 60), lambda i: px[((i // 12) * 8 // 5) * 8 + (i % 12) * 8 // 12 + 1]) AS px FROM {_TILES}")
def q20_resize_nearest(spark, sf_dir):
    return _tiles(spark, sf_dir).select("vec_id", R.resize_nearest(F.col("px"), 8, 8, 12, 5).alias("px"))


@query(f"""SELECT vec_id, list_transform(range(0, 16), lambda i: round((px[(i // 4) * 16 + (i % 4) * 2 + 1] + px[(i // 4) * 16 + (i % 4) * 2 + 2]
  + px[(i // 4) * 16 + (i % 4) * 2 + 9] + px[(i // 4) * 16 + (i % 4) * 2 + 10]) / 4, 9)) AS px FROM {_TILES}""")
def q21_resize_average(spark, sf_dir):
    return _tiles(spark, sf_dir).select("vec_id", _nine(R.resize_average(F.col("px"), 8, 8, 4, 4)))


@query("""SELECT l_orderkey, (list_reduce(list_prepend({'v': 0.0::DOUBLE, 'a': 0.0::DOUBLE}, list({'v': l_quantity, 'a': l_discount * 5} ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount)),
  lambda acc, x: {'v': x.v * x.a + acc.v * (1 - x.a), 'a': x.a})).v AS value, count(*) AS n_layers FROM lineitem GROUP BY l_orderkey""")
def q22_composite(spark, sf_dir):
    layer = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").alias("v"), (F.col("l_discount") * 5).alias("a"))
    stacks = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(layer).alias("layers"), F.count(F.lit(1)).alias("n_layers"))
    value = R.fold_layers(F.col("layers"), F.lit(0.0), lambda x: x["v"], lambda x: x["a"])
    return stacks.select("l_orderkey", value.alias("value"), "n_layers")


@query(f"""SELECT vec_id, list_transform(range(0, 100), lambda i: CASE WHEN i // 10 BETWEEN 1 AND 8 AND i % 10 BETWEEN 1 AND 8 THEN px[(i // 10 - 1) * 8 + i % 10 - 1 + 1] ELSE 0 END) AS padded,
  list_transform(range(0, 12), lambda i: (vec_id % 7)::INTEGER) AS filled, list_transform(range(0, 8), lambda i: 0::INTEGER) AS empty FROM {_TILES}""")
def q23_pad_fill(spark, sf_dir):
    return _tiles(spark, sf_dir).select(
        "vec_id", R.pad(F.col("px"), 8, 8, 10, 10).alias("padded"), R.fill(4, 3, F.array((F.col("vec_id") % 7).cast("int"))).alias("filled"), R.blank(2, 1).alias("empty"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'png' ELSE 'jpg' END AS kind, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 3 = 1 THEN 75 ELSE 50 END::INTEGER AS quality,
  CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 256 END::INTEGER AS width, (p_partkey % 17 + 1)::INTEGER AS height FROM part""")
def q24_placeholder(spark, sf_dir):
    """Sizes as read back from the encoded images of all parts."""
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, "png").when(k % 3 == 1, "jpg")
    rows = _table(spark, sf_dir, "part").select(
        "p_partkey", F.when(k % 2 == 0, F.col("p_size")).alias("width"), (k % 17 + 1).cast("int").alias("height"),
        F.when(k % 5 > 0, k * 2654435).alias("color"), E.encoding(kind, F.when(k % 3 == 1, 75)).alias("encoding"))
    made = P.placeholders(rows).select("p_partkey", F.col("image.bytes").alias("bytes"), F.col("image.encoding.quality").alias("quality"))
    return P.image_meta(made).select("p_partkey", F.col("meta.encoding.kind").alias("kind"), "quality", F.col("meta.width").alias("width"), F.col("meta.height").alias("height"))


def _png_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles as 8 x 8 PNG, red = green = blue = the value brought to a byte."""
    byte = F.transform("px", lambda v: F.least(F.greatest(F.floor(v * 128.0 + 128.0), F.lit(0)), F.lit(255)).cast("int"))
    return P.spread(_tiles(spark, sf_dir)).select("vec_id", P.gray_png(byte).alias("bytes"))


_BYTES = f"(SELECT vec_id, list_transform(px, lambda v: least(greatest(floor(v * 128 + 128), 0), 255)::INTEGER) AS px FROM {_TILES})"


@query(f"SELECT vec_id, px FROM {_BYTES}")
def q25_png_pixels(spark, sf_dir):
    return _png_tiles(spark, sf_dir).select("vec_id", P.first_channel(F.col("bytes")).alias("px"))


@query("SELECT doc_id, 'data:image/png;base64,' || base64(encode(text)) AS url FROM documents")
def q26_data_url(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", N.data_url(F.col("text").cast("binary")).alias("url"))


@query("""SELECT c_custkey, array_to_string(list_transform(range(0, strlen(c_name)), lambda i: '0x' || regexp_replace(lower(substr(hex(encode(c_name)), 2 * i + 1, 2)), '^0', '')), ',') AS literal,
  replace(c_mktsegment || '.png', '.', '_') AS name FROM customer""")
def q27_hex_literal(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select(
        "c_custkey", N.hex_literal(F.col("c_name").cast("binary")).alias("literal"), N.literal_name(F.concat("c_mktsegment", F.lit(".png"))).alias("name"))


@query("""SELECT p_partkey, '/tmp/' || regexp_extract(p, '([^/]*?)(\\.[^./]*)?$', 1) || '.png' AS temp, 'image_' || p_size || 'x' || p_partkey || '.jpg' AS name,
  CASE WHEN p_partkey % 2 = 0 THEN '-lossless' ELSE '-q ' || p_size || ' -alpha_q 100' END || ' ' || p || ' -o out.webp' AS args
  FROM (SELECT *, 'a.b/' || replace(p_type, ' ', '/') || CASE WHEN p_partkey % 3 = 0 THEN '.tar.png' WHEN p_partkey % 3 = 1 THEN '.jpg' ELSE '' END AS p FROM part)""")
def q28_names_cli(spark, sf_dir):
    k = F.col("p_partkey")
    path = F.concat(F.lit("a.b/"), F.replace(F.col("p_type"), F.lit(" "), F.lit("/")), F.when(k % 3 == 0, ".tar.png").when(k % 3 == 1, ".jpg").otherwise(""))
    return _table(spark, sf_dir, "part").select(
        "p_partkey", N.temp_png(F.lit("/tmp"), path).alias("temp"), N.image_name(F.col("p_size"), k, F.lit(".jpg")).alias("name"),
        N.encoder_arguments(k % 2 == 0, F.col("p_size"), F.lit(100), path, F.lit("out.webp")).alias("args"))


# Source kinds and platforms dealt out by event_id.
_SOURCES = ("gallery", "camera", "memory", "asset", "tape")
_PLATFORMS = ("linux", "windows", "macos", "android", "ios", "web", "stub")


@query(f"""SELECT event_id, kind, platform, CASE WHEN kind = 'tape' THEN 'unsupported_source' WHEN kind IN ('memory', 'asset') THEN 'direct' WHEN platform IN ('linux', 'windows', 'macos') THEN 'file_dialog'
  WHEN platform = 'stub' THEN 'unsupported_platform' ELSE 'picker_' || kind END AS route,
  CASE kind WHEN 'gallery' THEN 'ImageSourceGallery()' WHEN 'camera' THEN 'ImageSourceCamera(' || CASE WHEN event_id % 2 = 0 THEN 'front' ELSE 'rear' END || ')' WHEN 'memory' THEN 'ImageSourceMemory()'
  WHEN 'asset' THEN 'ImageSourceAsset(a' || event_id || ')' END AS source
  FROM (SELECT event_id, {list(_SOURCES)}[event_id % 5 + 1] AS kind, {list(_PLATFORMS)}[event_id % 7 + 1] AS platform FROM events)""")
def q29_source_routing(spark, sf_dir):
    e = F.col("event_id")
    pick = lambda values, n: F.element_at(F.lit(list(values)), (e % n + 1).cast("int"))
    rows = _table(spark, sf_dir, "events").select("event_id", pick(_SOURCES, 5).alias("kind"), pick(_PLATFORMS, 7).alias("platform"))
    text = N.source_text(F.col("kind"), F.when(e % 2 == 0, "front"), F.concat(F.lit("a"), e.cast("string")))
    return rows.select("event_id", "kind", "platform", N.pick_route(F.col("kind"), F.col("platform")).alias("route"), text.alias("source"))


@query(f"""SELECT vec_id, 12::INTEGER AS width, 5::INTEGER AS height, list_transform(range(0, 60), lambda i: px[((i // 12) * 8 // 5) * 8 + (i % 12) * 8 // 12 + 1]) AS px FROM {_BYTES}""")
def q30_resize_e2e(spark, sf_dir):
    out = P.resize_images(_png_tiles(spark, sf_dir), width=F.lit(12), height=F.lit(5))
    return out.select("vec_id", F.col("image.width").alias("width"), F.col("image.height").alias("height"), P.first_channel(F.col("image.bytes")).alias("px"))


@query("""SELECT vec_id, vec_id % 3 = 2 AS cancelled, CASE vec_id % 3 WHEN 0 THEN 4 WHEN 1 THEN 6 END::INTEGER AS width, CASE vec_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 6 END::INTEGER AS height
  FROM embeddings WHERE len(embedding) = 64""")
def q31_pick_crop(spark, sf_dir):
    """Every picture; those of remainder 2 have no annotation, as if their crop was cancelled, and so no image."""
    out = pick_crop(*_annotated(spark, sf_dir))
    return out.select(F.col("image_id").alias("vec_id"), F.col("image").isNull().alias("cancelled"), F.col("image.width").alias("width"), F.col("image.height").alias("height"))


def _annotated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Pictures, and rectangles of two thirds of them."""
    images = _png_tiles(spark, sf_dir).withColumnRenamed("vec_id", "image_id")
    side = F.when(F.col("image_id") % 3 == 0, 4.0).otherwise(6.0)
    high = F.when(F.col("image_id") % 3 == 0, 2.0).otherwise(6.0)
    return images, images.where("image_id % 3 < 2").select("image_id", G.rect(F.lit(1.0), F.lit(1.0), side, high).alias("rect"))


@query(f"""SELECT vec_id, list_transform(range(0, 16), lambda i: CASE WHEN i // 4 BETWEEN 1 AND 2 AND i % 4 BETWEEN 1 AND 2 THEN px[(i // 4 - 1) * 8 + i % 4 - 1 + 1 ] ELSE px[(i // 4) * 16 + (i % 4) * 2 + 1] END) AS px FROM {_BYTES}""")
def q32_layers(spark, sf_dir):
    """Two layers: the whole tile over the whole canvas, then its corner over the middle."""
    tiles = _png_tiles(spark, sf_dir)
    none = F.lit(None).cast("struct<left: double, top: double, width: double, height: double>")
    corner, middle = G.rect(*map(F.lit, (0.0, 0.0, 2.0, 2.0))), G.rect(*map(F.lit, (1.9, 1.9, 2.9, 2.9)))
    layer = lambda src, dst: F.struct("bytes", src.alias("src"), dst.alias("dst"))
    asked = tiles.select("vec_id", F.array(layer(none, none), layer(corner, middle)).alias("layers"), F.lit(4).alias("width"), F.lit(4).alias("height"), E.encoding(F.lit("png"), F.lit(None)).alias("encoding"))
    return P.compose_images(asked).select("vec_id", P.first_channel(F.col("image.bytes")).alias("px"))


@query(f"""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN NULL ELSE (event_id % 900)::INTEGER END AS side,
  (event_id % 640) || 'x' || (event_id % 480) || ', ' || event_id || ' bytes, image/png' AS result,
  CASE WHEN event_id % 3 = 0 THEN '' ELSE CASE WHEN event_id % 3 = 1 THEN event_id % 640 || 'x' ELSE 'x' || event_id % 480 END || CASE WHEN event_id % 2 = 0 THEN ' oval' ELSE '' END END AS request FROM events""")
def q33_texts(spark, sf_dir):
    e = F.col("event_id")
    typed = F.when(e % 4 == 1, "wide").when(e % 4 > 1, F.concat(F.lit(" "), (e % 900).cast("string")))
    return _table(spark, sf_dir, "events").select(
        "event_id", N.parsed_side(typed).alias("side"), N.result_text(e % 640, e % 480, e, E.mime_type(F.lit("png"))).alias("result"),
        N.request_text(F.when(e % 3 == 1, e % 640), F.when(e % 3 == 2, e % 480), e % 2 == 0).alias("request"))


@query(f"""SELECT vec_id, list_transform(range(0, 64), lambda i: px[(7 - i % 8) * 8 + i // 8 + 1]) AS turned, greatest(0, least(8, 2 + vec_id % 9) - 2)::DOUBLE AS clip_width FROM {_TILES}""")
def q34_turn_clip(spark, sf_dir):
    clip = G.clipped(G.translated(G.rect(*map(F.lit, (1.0, 1.0, 6.0, 6.0))), F.lit(1.0), F.lit(0.0)), G.rect(F.lit(0.0), F.lit(0.0), (2 + F.col("vec_id") % 9).cast("double"), F.lit(8.0)))
    return _tiles(spark, sf_dir).select("vec_id", R.rotate_quarters(F.col("px"), 8, 8, 1).alias("turned"), clip["width"].alias("clip_width"))


@query("""SELECT event_id, (event_id % 101) / 100.0::DOUBLE AS quality, CASE event_id % 5 WHEN 0 THEN '-q 50 -alpha_q 100 a -o b' WHEN 1 THEN '-q 50 -alpha_q 100 a -o b'
  WHEN 2 THEN '-q 75 -alpha_q 100 a -o b' WHEN 3 THEN '-lossless a -o b' END AS args,
  CASE WHEN event_id % 4 = 0 THEN 'ImageSourceCamera(rear)' WHEN event_id % 4 < 3 THEN 'ImageSourceCamera(' || CASE event_id % 4 WHEN 1 THEN 'rear' ELSE 'front' END || ')' END AS camera FROM events""")
def q35_encoder_settings(spark, sf_dir):
    """Canvas quality, presets of an external encoder (an unknown one gives null) and cameras (an unknown one gives null)."""
    e = F.col("event_id")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (e % n + 1).cast("int"))
    return _table(spark, sf_dir, "events").select(
        "event_id", E.blob_quality(e % 101).alias("quality"), N.preset_arguments(pick(("default", "q50", "q75", "lossless", "best"), 5), F.lit("a"), F.lit("b")).alias("args"),
        N.source_text(F.lit("camera"), pick((None, "rear", "front", "side"), 4), F.lit(None).cast("string")).alias("camera"))


@query("""SELECT event_id, CASE WHEN w = 0 AND h = 0 THEN 300 ELSE w END::INTEGER AS width, CASE WHEN w = 0 AND h = 0 THEN 300 ELSE h END::INTEGER AS height
  FROM (SELECT event_id, event_id % 3 AS w, event_id % 4 AS h FROM events)""")
def q36_loaded_size(spark, sf_dir):
    w, h = (F.col("event_id") % 3).cast("int"), (F.col("event_id") % 4).cast("int")
    return _table(spark, sf_dir, "events").select("event_id", G.loaded_side(w, h).alias("width"), G.loaded_side(h, w).alias("height"))


@query(f"""SELECT vec_id, 6::INTEGER AS width, 4::INTEGER AS height, list_transform(range(0, 24), lambda i: CASE WHEN vec_id % 2 = 0 THEN px[(i // 6 + 2) * 8 + i % 6 + 1 + 1]
  WHEN i // 6 BETWEEN 1 AND 2 AND i % 6 BETWEEN 2 AND 3 THEN px[(i // 6 - 1 + 6) * 8 + i % 6 - 2 + 6 + 1] ELSE 0 END) AS px FROM {_BYTES} WHERE vec_id % 7 <> 0""")
def q37_convert_files(spark, sf_dir):
    """Crops within the picture, or leaving it and padded; pictures whose result exists (remainder 0 of 7) are skipped."""
    tiles = _png_tiles(spark, sf_dir).withColumn("dst", F.concat(F.lit("out/"), F.col("vec_id").cast("string"), F.lit(".png")))
    existing = tiles.where("vec_id % 7 = 0").select("dst")
    even = F.col("vec_id") % 2 == 0
    side = lambda a, b: F.when(even, a).otherwise(b).cast("int")
    crop = F.struct(side(1, 6).alias("left"), side(2, 6).alias("top"), F.lit(6).alias("width"), F.lit(4).alias("height"))
    out = P.convert_files(tiles, crop=crop, existing=existing)
    return out.select("vec_id", F.col("image.width").alias("width"), F.col("image.height").alias("height"), P.first_channel(F.col("image.bytes")).alias("px"))


@query(f"""SELECT vec_id, 4::INTEGER AS width, 4::INTEGER AS height, list_transform(range(0, 16), lambda i: (px[(i // 4) * 16 + (i % 4) * 2 + 1] + px[(i // 4) * 16 + (i % 4) * 2 + 2]
  + px[(i // 4) * 16 + (i % 4) * 2 + 9] + px[(i // 4) * 16 + (i % 4) * 2 + 10] + 2) // 4)::INTEGER[] AS px FROM {_BYTES}""")
def q38_convert_average(spark, sf_dir):
    out = P.convert_files(_png_tiles(spark, sf_dir), resize_width=F.lit(4))
    return out.select("vec_id", F.col("image.width").alias("width"), F.col("image.height").alias("height"), P.first_channel(F.col("image.bytes")).alias("px"))


@query("""SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 'png' END AS kind, CASE WHEN vec_id % 2 = 0 THEN 8 END::INTEGER AS width, CASE WHEN vec_id % 2 = 1 THEN 'unsupported_target' END AS error
  FROM embeddings WHERE len(embedding) = 64""")
def q39_compose_web(spark, sf_dir):
    """The canvas mode refuses targets that it cannot write."""
    tiles = _png_tiles(spark, sf_dir)
    none = F.lit(None).cast("struct<left: double, top: double, width: double, height: double>")
    layer = F.struct("bytes", none.alias("src"), none.alias("dst"))
    asked = tiles.select("vec_id", F.array(layer).alias("layers"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"), E.encoding(F.when(F.col("vec_id") % 2 == 0, "png").otherwise("webp"), F.lit(None)).alias("encoding"))
    out = P.compose_images(asked, mode="compose_web")
    ok = F.col("image.error").isNull()
    return out.select("vec_id", F.when(ok, F.col("image.encoding.kind")).alias("kind"), F.col("image.width").alias("width"), F.col("image.error").alias("error"))


@query("""SELECT vec_id, CASE vec_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 36 END::INTEGER AS area, CASE WHEN vec_id % 3 < 2 THEN 'image/x-own' END AS mime FROM embeddings WHERE len(embedding) = 64""")
def q40_own_conversion(spark, sf_dir):
    """A conversion of the user's in place of the default one."""
    images, crops = _annotated(spark, sf_dir)
    own = lambda request: F.struct((request["rect"]["width"] * request["rect"]["height"]).cast("int").alias("area"), F.lit("image/x-own").alias("mime"))
    return pick_crop(images, crops, convert=own).select(F.col("image_id").alias("vec_id"), F.col("image.area").alias("area"), F.col("image.mime").alias("mime"))


@query("""SELECT p_partkey, w AS width, h AS height, list_transform(range(0, 6), lambda i: v) AS px, 'jpg' AS kind
  FROM (SELECT p_partkey, (p_partkey % 23 + 1)::INTEGER AS w, (p_partkey % 11 + 1)::INTEGER AS h, (p_partkey % 256)::INTEGER AS v FROM part)""")
def q41_jpg_pixels(spark, sf_dir):
    """Flat JPG pictures, decoded, resized to 3 x 2, and their sizes by full decoding."""
    k = F.col("p_partkey")
    flat = P.spread(_table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", P.flat_jpg(k % 256, k % 23 + 1, k % 11 + 1).alias("bytes"))
    sized = P.image_meta(flat, mode="strict")
    out = P.resize_images(sized, width=F.lit(3), height=F.lit(2))
    return out.select("p_partkey", F.col("meta.width").alias("width"), F.col("meta.height").alias("height"), P.first_channel(F.col("image.bytes")).alias("px"), F.col("meta.encoding.kind").alias("kind"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN c_mktsegment END AS text FROM customer""")
def q42_read_sources(spark, sf_dir):
    """Sources in memory, files by path, a missing file, and nothing picked."""
    k = F.col("c_custkey")
    rows = _table(spark, sf_dir, "customer")
    files = rows.where("c_custkey % 4 = 1").select(F.concat(F.lit("f/"), k.cast("string")).alias("path"), F.col("c_mktsegment").cast("binary").alias("bytes"))
    kind = F.when(k % 4 == 0, "memory").when(k % 4 < 3, "asset").otherwise("gallery")
    source = F.struct(kind.alias("kind"), F.lit(None).cast("string").alias("camera"), F.when((k % 4).isin(1, 2), F.concat(F.lit("f/"), k.cast("string"))).alias("path"), F.when(k % 4 == 0, F.col("c_name").cast("binary")).alias("bytes"))
    return read_sources(rows.select("c_custkey", source.alias("source")), files).select("c_custkey", F.col("bytes").cast("string").alias("text"))


@query("""SELECT vec_id, 'raw' AS kind, (8 * 8 * 4)::INTEGER AS size FROM embeddings WHERE len(embedding) = 64""")
def q43_own_encoder(spark, sf_dir):
    """A registered kind with an encoder of its own: the pixels as they are."""
    held = dict(E.KINDS), dict(E.ENCODERS)
    E.register("raw", "image/x-raw", ".raw", encoder=lambda pixels, quality: pixels.tobytes())
    try:
        out = P.resize_images(_png_tiles(spark, sf_dir), width=F.lit(None), height=F.lit(None), kind="raw")
    finally:
        for now, before in zip((E.KINDS, E.ENCODERS), held, strict=True):
            now.clear()
            now.update(before)
    return out.select("vec_id", F.col("image.encoding.kind").alias("kind"), F.length("image.bytes").cast("int").alias("size"))
