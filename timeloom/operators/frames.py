"""Analysis-size frames as rows of pixels, and detections in them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Luma and chroma by BT.709 (scopes), luma, chroma and skin tones by BT.601 (saliency), and the weights of a salient cell.
LUMA = (0.2126, 0.7152, 0.0722)
SKIN_CB, SKIN_CR = (77, 127), (133, 173)
SKIN_WEIGHT, EDGE_WEIGHT, CONTRAST_WEIGHT = 0.5, 0.3, 0.2
SHOT_THRESHOLD = 0.5


def luma() -> Column:
    return F.lit(LUMA[0]) * F.col("r") + F.lit(LUMA[1]) * F.col("g") + F.lit(LUMA[2]) * F.col("b")


def _bin(c: Column, bins: int) -> Column:
    """The bin of a value of 0 to 1; what lies outside falls into the last or the first."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(0.9999), c)) * bins).cast("long")


def _channels() -> Column:
    return F.array(*[F.struct(F.lit(n).alias("channel"), c.alias("v")) for n, c in (("r", F.col("r")), ("g", F.col("g")), ("b", F.col("b")), ("y", luma()))])


def histogram(pixels: DataFrame, bins: int = 256) -> DataFrame:
    """Histograms of the channels and of luma (``frame_id, x, y, r, g, b``, values of 0 to 1): ``frame_id, channel, bin, n``."""
    rows = pixels.select("frame_id", F.explode(_channels()).alias("c"))
    return rows.groupBy("frame_id", "c.channel", _bin(F.col("c.v"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def clipped_pixels(pixels: DataFrame) -> DataFrame:
    """Pixels of each frame with a channel outside 0 to 1."""
    out = reduce(lambda x, y: x | y, [(F.col(c) < 0) | (F.col(c) > 1) for c in "rgb"])
    return pixels.groupBy("frame_id").agg(F.count_if(out).alias("n_clipped"))


def column_waveform(pixels: DataFrame) -> DataFrame:
    """Waveform and parade: extremes of luma and of each channel in each column, in 65536ths: ``frame_id, x, channel, low, high``."""
    rows = pixels.select("frame_id", "x", F.explode(_channels()).alias("c"))
    q = F.floor(F.greatest(F.lit(0.0), F.col("c.v")) * 65535).cast("long")
    return rows.groupBy("frame_id", "x", "c.channel").agg(F.min(q).alias("low"), F.max(q).alias("high"))


def vectorscope(pixels: DataFrame, size: int = 64) -> DataFrame:
    """Two-dimensional histogram of chroma: ``bin_u, bin_v, n``."""
    cb, cr = (F.col("b") - luma()) / 1.8556 + 0.5, (F.col("r") - luma()) / 1.5748 + 0.5
    return pixels.groupBy(_bin(cb, size).alias("bin_u"), _bin(cr, size).alias("bin_v")).agg(F.count(F.lit(1)).alias("n"))


def colour_histogram(pixels: DataFrame, bins: int = 8) -> DataFrame:
    """Colours in ``bins`` steps a channel: ``frame_id, bin, n, share``."""
    index = (_bin(F.col("r"), bins) * bins + _bin(F.col("g"), bins)) * bins + _bin(F.col("b"), bins)
    n = pixels.groupBy("frame_id", index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    size = pixels.groupBy("frame_id").agg(F.count(F.lit(1)).alias("_size"))
    return n.join(size, "frame_id").select("frame_id", "bin", "n", (F.col("n") / F.col("_size")).alias("share"))


def previous(ids: DataFrame, by: list[str]) -> DataFrame:
    """``by``, ``frame_id`` and ``prev_id``, the largest smaller id of the key; the first id is left out.

    Without a key, numeric ids are dealt into ranges of about the same size: lag inside each, and the first id of a
    range follows the largest of the range before (one row a range).
    """
    if by:
        return ids.withColumn("prev_id", F.lag("frame_id").over(Window.partitionBy(*by).orderBy("frame_id"))).filter("prev_id is not null")
    n = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds = ids.agg(F.percentile_approx("frame_id", [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else None
    at = F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda b: b <= F.col("frame_id"))) if bounds else F.lit(0)
    ids = ids.filter("frame_id is not null").withColumn("range", at)
    ends = ids.groupBy("range").agg(F.max("frame_id").alias("end"))
    before = ends.select("range", F.lag("end").over(Window.partitionBy().orderBy("range")).alias("before"))
    lagged = ids.withColumn("lagged", F.lag("frame_id").over(Window.partitionBy("range").orderBy("frame_id")))
    return lagged.join(before, "range").select("frame_id", F.coalesce("lagged", "before").alias("prev_id")).filter("prev_id is not null")


def shot_distances(hist: DataFrame, by: list[str] | None = None, threshold: float = SHOT_THRESHOLD) -> DataFrame:
    """Chi-squared distance of each frame's histogram (``frame_id, bin, n``, frames of one size) to that of the frame before, and whether it is a ``boundary``; bins empty in both are skipped.

    Frames are ordered by id (give ``by`` to order within a key).
    """
    by = by or []
    ids = hist.select(*by, "frame_id").distinct()
    prev = previous(ids, by)
    size = hist.groupBy(*by, "frame_id").agg(F.sum("n").alias("size"))
    own = hist.join(prev, [*by, "frame_id"]).select(*by, "frame_id", "prev_id", "bin", F.col("n").alias("a"), F.lit(0).cast("long").alias("b"))
    other = hist.withColumnRenamed("frame_id", "prev_id").join(prev, [*by, "prev_id"]).select(*by, "frame_id", "prev_id", "bin", F.lit(0).cast("long").alias("a"), F.col("n").alias("b"))
    both = own.unionByName(other).groupBy(*by, "frame_id", "prev_id", "bin").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    far = F.pow(F.col("a") - F.col("b"), 2) / (F.col("a") + F.col("b"))
    made = both.groupBy(*by, "frame_id", "prev_id").agg(F.sum(far).alias("d")).join(size, [*by, "frame_id"])
    made = made.select(*by, "frame_id", "prev_id", F.round(F.col("d") / F.col("size"), 6).alias("distance"))
    return made.withColumn("boundary", F.col("distance") > threshold)


def ssim(a: DataFrame, b: DataFrame, window: int = 4, c1: float = 100.0, c2: float = 900.0) -> DataFrame:
    """Mean structural similarity of frames with one id over whole windows that don't overlap."""
    other = b.select("frame_id", "x", "y", F.col("v_milli").alias("w_milli"))
    met = a.join(other, ["frame_id", "x", "y"])
    p, q = F.col("v_milli"), F.col("w_milli")
    w = met.groupBy("frame_id", F.expr(f"y div {window}").alias("wy"), F.expr(f"x div {window}").alias("wx")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("ma"), F.avg(q).alias("mb"), F.avg(p * p).alias("aa"), F.avg(q * q).alias("bb"), F.avg(p * q).alias("ab"))
    value = F.expr(f"((2 * ma * mb + {c1}D) * (2 * (ab - ma * mb) + {c2}D)) / ((ma * ma + mb * mb + {c1}D) * (aa - ma * ma + bb - mb * mb + {c2}D))")
    return w.filter(F.col("n") == window * window).groupBy("frame_id").agg(F.round(F.avg(value), 6).alias("ssim"))


def salient_cells(pixels: DataFrame, across: int = 16) -> DataFrame:
    """The most salient cell of an ``across`` by ``across`` grid of each frame, the first on a tie: ``frame_id, cell, confidence``.

    A cell's score mixes the share of skin tones, the mean Sobel magnitude of luma (0 at the frame's edge) and luma's spread,
    each in parts of its largest value in the frame. Values are 0 to 1; cells under two pixels give no row.
    """
    r, g, b = (F.least(F.lit(255.0), F.floor(F.greatest(F.lit(0.0), F.col(c)) * 256)) for c in "rgb")
    cb, cr = 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b
    rows = pixels.select("frame_id", "x", "y", (cb.between(*SKIN_CB) & cr.between(*SKIN_CR)).alias("skin"), (0.299 * r + 0.587 * g + 0.114 * b).alias("l"))
    across_x, down_y = Window.partitionBy("frame_id", "y").orderBy("x"), Window.partitionBy("frame_id", "x").orderBy("y")
    # a Sobel filter is a difference one way of a weighted sum the other way; frames have all their pixels
    rows = rows.withColumns({"_v": F.lag("l").over(down_y) + 2 * F.col("l") + F.lead("l").over(down_y), "_h": F.lag("l").over(across_x) + 2 * F.col("l") + F.lead("l").over(across_x)})
    rows = rows.withColumns({"_gx": F.lead("_v").over(across_x) - F.lag("_v").over(across_x), "_gy": F.lead("_h").over(down_y) - F.lag("_h").over(down_y)})
    size = rows.groupBy("frame_id").agg(F.expr(f"(max(x) + 1) div {across}").alias("_w"), F.expr(f"(max(y) + 1) div {across}").alias("_d")).filter("_w >= 2 AND _d >= 2")
    rows = rows.join(size, "frame_id").filter(f"x < _w * {across} AND y < _d * {across}").withColumn("cell", F.expr(f"CAST(y div _d * {across} + x div _w AS INT)"))
    edge = F.coalesce(F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy")), F.lit(0.0))
    cells = rows.groupBy("frame_id", "cell").agg(F.avg(F.col("skin").cast("double")).alias("skin"), F.avg(edge).alias("edge"), F.stddev_pop("l").alias("contrast"))
    whole = Window.partitionBy("frame_id")
    part = lambda c: F.coalesce(F.try_divide(F.col(c), F.max(c).over(whole)), F.lit(0.0))
    score = F.round(SKIN_WEIGHT * part("skin") + EDGE_WEIGHT * part("edge") + CONTRAST_WEIGHT * part("contrast"), 6)
    scored = cells.select("frame_id", "cell", score.alias("confidence"))
    return scored.groupBy("frame_id").agg(F.max_by(F.struct("cell", "confidence"), F.struct("confidence", -F.col("cell"))).alias("m")).select("frame_id", "m.*")


def box_iou(boxes: DataFrame) -> DataFrame:
    """``frame_id, a, b, iou`` of overlapping boxes of a frame; a frame holds few boxes, and none is paired with itself."""
    columns = ("x_milli", "y_milli", "w_milli", "h_milli")
    a = boxes.select("frame_id", F.col("det_id").alias("a"), *[F.col(c).alias(f"a_{c[0]}") for c in columns])
    b = boxes.select("frame_id", F.col("det_id").alias("b"), *[F.col(c).alias(f"b_{c[0]}") for c in columns])
    met = a.join(b, "frame_id").filter("a < b")
    part = F.expr("greatest(0, least(a_x + a_w, b_x + b_w) - greatest(a_x, b_x)) * greatest(0, least(a_y + a_h, b_y + b_h) - greatest(a_y, b_y))")
    met = met.withColumn("i", part).filter("i > 0")
    return met.select("frame_id", "a", "b", F.round(F.expr("i / (a_w * a_h + b_w * b_h - i)"), 6).alias("iou"))


def best_detection(boxes: DataFrame) -> DataFrame:
    """The detection of each frame with the largest confidence, then area, then the first."""
    order = F.struct("conf_milli", F.col("w_milli") * F.col("h_milli"), -F.col("det_id"))
    return boxes.groupBy("frame_id").agg(F.max_by(F.struct("det_id", "conf_milli"), order).alias("m")).select("frame_id", "m.*")


def non_max_suppression(boxes: DataFrame, threshold: float, most: int) -> DataFrame:
    """Greedy by confidence: a box stays unless it overlaps one that stays by ``threshold`` or more; at most ``most`` a frame.

    The boxes of a frame are one sorted array, folded natively.
    """
    box = F.struct(F.col("conf_milli").alias("c"), (-F.col("det_id")).alias("d"), F.col("x_milli").alias("x"), F.col("y_milli").alias("y"), F.col("w_milli").alias("w"), F.col("h_milli").alias("h"))
    rows = boxes.groupBy("frame_id").agg(F.sort_array(F.collect_list(box), asc=False).alias("boxes"))

    def iou(a, b):
        i = F.greatest(F.lit(0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])) * F.greatest(F.lit(0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
        return i / (a["w"] * a["h"] + b["w"] * b["h"] - i)

    kept = F.aggregate("boxes", F.slice("boxes", 1, 0), lambda acc, b: F.when((F.size(acc) < most) & ~F.exists(acc, lambda k: iou(k, b) >= threshold), F.concat(acc, F.array(b))).otherwise(acc))
    return rows.select("frame_id", F.explode(kept).alias("k")).select("frame_id", (-F.col("k.d")).alias("det_id"), F.col("k.c").alias("conf_milli"))
