"""Positioned words to movement rows, for all documents at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from balanza.functions.plan import settle
from balanza.operators import dedup, layout as L
from balanza.session import cut

PAGE = list(L.PAGE)


def extract_movements(words: DataFrame, pages: DataFrame, bank: str = "") -> DataFrame:
    """Movement rows (doc_id, page, row place, date, description, amount, kind).

    ``words`` has doc_id, page, x0, y0, x1, y1 and text; ``pages`` doc_id, page, width and height.
    Page geometry is one small row per page; the words are joined to it once, and take their columns from the last
    header above them. Frames that several steps read are written to the shared folder in between.
    """
    line_rows = L.lines(words)
    headers = cut(L.page_headers(line_rows, pages.select(*PAGE, "height")).join(pages, PAGE))
    footers = L.page_footers(line_rows, headers)
    layouts = L.column_layout(words, headers, bank)
    stops = L.hard_stop(line_rows).filter("stopped").groupBy(*PAGE).agg((F.min("y") - 5).alias("stop_y"))

    layouts = cut(layouts)
    pages_once = headers.join(footers, PAGE).join(stops, PAGE, "left")
    geometry = settle(pages_once, {"footer_y": F.least("footer_y", F.coalesce("stop_y", "footer_y"))}).select(*PAGE, "width", "header_y", "footer_y")
    middle = (F.col("y0") + F.col("y1")) / 2
    body = cut(words.join(geometry, PAGE).filter(middle.between(F.col("header_y"), F.col("footer_y"))).select(
        *PAGE, "x0", "y0", "x1", "y1", "text", "width"
    ))

    # columns of the header above each word: the page's own, one further down, or the last of the pages before
    own = layouts.filter("own_header").select(*PAGE, "columns")
    lowest = F.array_max(F.array(*[F.col(f"columns.{n}.y1") for n in L.R.COLUMN_WORDS]))
    tops = headers.join(own, PAGE, "left").select(*PAGE, F.greatest("header_y", lowest).alias("top"))
    placed = L.banded_words(body, cut(L.inline_bands(body, tops)), own)
    date_box = F.col("columns.FECHA")
    wide = date_box["x1"] - date_box["x0"] > 70
    low = F.when(wide, F.greatest(date_box["x0"] - 10, F.lit(0.0))).otherwise(F.greatest(date_box["x0"] - 40, F.lit(0.0)))
    high = F.when(wide, date_box["x0"] + 60).otherwise(date_box["x1"] + 10)
    placed = cut(settle(placed, {
        "date_from": F.coalesce(low, F.lit(0.0)), "date_to": F.coalesce(high, F.col("width") * 0.14), "zones": L.amount_zones(F.col("columns")),
        "desc_center": F.coalesce("columns.DESCRIPCION.center", F.lit(-1.0)),
    }).withColumn("text_from", F.col("date_to") + 5).drop("columns", "band_page", "band_y"))

    anchors = L.date_anchors(placed, F.col("date_from"), F.col("date_to"), F.col("width"))
    sliced = L.anchor_slices(L.stitch_signs(placed), cut(anchors)).filter(F.col("anchor_page").isNotNull())
    marked = L.mark_amounts(sliced).withColumn("one_column", F.col("zones.cargo.lo") >= 9999)
    described = L.stitch_orphans(L.slice_rows(marked, carry=("date_text", "one_column")))
    zoned = L.zone_mode(line_rows).select(*PAGE, "y", "mode") if bank.upper() == "MIFEL" else None
    if zoned is None:
        out = described.withColumn("mode", F.lit(None).cast("string"))
    else:
        at = F.floor(F.col("row_y") / 3) * 3
        out = described.withColumn("y", at).join(zoned, [*PAGE, "y"], "left")
    one_column = F.col("one_column")
    kind = L.final_kind(F.col("kind"), F.col("mode"), F.col("was_single"), F.col("signed"), one_column)
    rows = out.select(*PAGE, "row_y", "row_no", F.col("date_text").alias("posted"), "description", "amount", kind.alias("kind"), "mode", "was_single", "signed", one_column.alias("_one"))
    # an unsigned amount of a shared column, or of a transfer or credit zone, may repeat a movement
    loose = F.col("was_single") & ~F.col("signed") & (~F.col("_one") | F.col("mode").isNotNull())
    place = F.struct("page", "row_y", "row_no")
    roles = cut(rows.withColumns({
        "mov_id": place, "role": F.when(loose, "child").otherwise("parent"), "fragment": loose & F.coalesce(F.col("mode") == "DETALLE_CREDITO", F.lit(False)),
    }))
    return dedup.apply_fragments(roles).select(*PAGE, "row_y", "row_no", "posted", "description", "amount", "kind", "mode")
