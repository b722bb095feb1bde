"""Reading order of boxes on a page: rows by vertical place, columns by side."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pages that a task holds as Python values at a time.
AT_ONCE = 256


def box_lines(boxes: list[tuple]) -> list[str]:
    """Lines of one page of boxes (top, left, text, height) in that order: a box starts a row when it is lower than the row's
    first box by more than the tolerance.

    The tolerance is one and a half of the upper median height, rounded up. Rows compare with their first box, so this
    is a fold and no window.
    """
    tolerance = math.ceil(1.5 * sorted(b[3] for b in boxes)[len(boxes) // 2])
    rows: list[list[tuple]] = []
    for top, left, text, _ in boxes:
        if not rows or abs(top - rows[-1][0][1]) > tolerance:
            rows.append([])
        rows[-1].append((left, top, text))
    return [" ".join([t for _, _, t in sorted(r)]) for r in rows]


def order_boxes(boxes: pd.DataFrame) -> list[str]:
    """Lines of one page of boxes (text, top, left, bottom)."""
    sized = boxes.assign(height=boxes["bottom"] - boxes["top"]).sort_values(["top", "left", "text"])
    return box_lines(list(sized[["top", "left", "text", "height"]].itertuples(index=False, name=None)))


def _page_lines(boxes: DataFrame, fields: tuple[str, ...], fold: Callable[[list[tuple]], list[str]]) -> DataFrame:
    """(page_id, pos, line): what a fold makes of each page's boxes, ordered by some fields; many pages pass in a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(start, AT_ONCE)
                ends = part.column(1).offsets.to_pylist()
                flat = list(zip(*(c.to_pylist() for c in part.column(1).flatten().flatten()), strict=True))
                found = [fold(flat[a - ends[0] : b - ends[0]]) for a, b in zip(ends, ends[1:], strict=False)]
                page = part.column(0).take(pa.array([k for k, lines in enumerate(found) for _ in lines], pa.int32()))
                pos = pa.array([n for lines in found for n in range(len(lines))], pa.int32())
                yield pa.RecordBatch.from_arrays([page, pos, pa.array([x for lines in found for x in lines], pa.string())], ["page_id", "pos", "line"])

    kind = dict(boxes.dtypes)["page_id"]
    pages = boxes.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("boxes"))
    return pages.mapInArrow(run, f"page_id {kind}, pos int, line string")


def reading_order(boxes: DataFrame) -> DataFrame:
    """(page_id, pos, line) of boxes (page_id, text, top, left, bottom, right); a group is one page."""
    kept = boxes.where("text is not null and top is not null and bottom is not null and `left` is not null")
    return _page_lines(kept.withColumn("height", F.col("bottom") - F.col("top")), ("top", "left", "text", "height"), box_lines)


def word_rows(words: list[tuple], most: float = 3.0) -> list[str]:
    """Lines of one column of words (y, x, text) in that order: a line lasts until a word lies ``most`` points or more from its first."""
    rows: list[list[tuple]] = []
    for y, x, text in words:
        if not rows or abs(y - rows[-1][0][1]) >= most:
            rows.append([])
        rows[-1].append((x, y, text))
    return [" ".join([t for _, _, t in sorted(r)]) for r in rows]


def line_words(words: pd.DataFrame, most: float = 3.0) -> list[str]:
    """Lines of one column of words (text, x, y)."""
    return word_rows(list(words.sort_values(["y", "x", "text"])[["y", "x", "text"]].itertuples(index=False, name=None)), most)


def word_lines(words: DataFrame) -> DataFrame:
    """(page_id, pos, line) of the words (page_id, text, x, y) of pages or columns; a group is one page."""
    return _page_lines(words.where("text is not null and x is not null and y is not null"), ("y", "x", "text"), word_rows)


def columns(words: DataFrame, ratio: float = 0.5, least: int = 3) -> DataFrame:
    """Words (page_id, x0, x1, width, …) with ``side``: 'L' or 'R' by their centre where both sides have enough words, else 'L'."""
    side = F.when((F.col("x0") + F.col("x1")) / 2 <= F.col("width") * ratio, "L").otherwise("R")
    w = Window.partitionBy("page_id")
    marked = words.withColumn("_side", side)
    both = (F.count_if(F.col("_side") == "L").over(w) >= least) & (F.count_if(F.col("_side") == "R").over(w) >= least) & (F.col("width") >= 80)
    return marked.withColumn("side", F.when(both, F.col("_side")).otherwise("L")).drop("_side")


def own_export(text: Column) -> Column:
    """Whether a text looks like this engine's own export: three skill lines, or one with two dotted job lines."""
    lines = F.split(text, "\n")
    skill = F.size(F.filter(lines, lambda x: x.rlike(r"^[^·]+ · (Beginner|Intermediate|Advanced|Expert)( · \d+ .*)?$")))
    meta = F.size(F.filter(lines, lambda x: x.rlike(r" · .*\d{4}")))
    return (skill >= 3) | ((skill >= 1) & (meta >= 2))


def fallback(text_layer: Column, ocr: Column, usable: Column, forced: Column, locked: Column) -> Column:
    """struct<text, strategy> of the extraction chain: forced OCR, locked files stop, usable text layer, OCR, what there is."""
    return (
        F.when(forced, F.struct(ocr.alias("text"), F.lit("ocr").alias("strategy")))
        .when(locked, F.struct(F.lit(None).cast("string").alias("text"), F.lit("locked").alias("strategy")))
        .when(usable, F.struct(text_layer.alias("text"), F.lit("text_layer").alias("strategy")))
        .when(ocr.isNotNull(), F.struct(ocr.alias("text"), F.lit("ocr").alias("strategy")))
        .otherwise(F.struct(text_layer.alias("text"), F.lit("text_layer").alias("strategy")))
    )
