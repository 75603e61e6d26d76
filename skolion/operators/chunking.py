"""Overlapping windows over the pages of a paper, without ever putting a whole paper together.

Windows start at fixed multiples of the step, so every page knows which windows it takes part in; a window is put
together from the few pages it touches. A paper with very many pages is as many small groups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Windows of one counting range; chunk numbers are counted within ranges, then over them.
RANGE = 4096
#: Characters before a window's end in which a sentence's end is looked for.
LOOK_BACK = 200


@dataclass(frozen=True)
class Windows:
    size: int = 900
    overlap: int = 150
    least: int = 120

    def __post_init__(self) -> None:
        if self.size <= LOOK_BACK:
            raise ValueError(f"a window is longer than {LOOK_BACK} characters")

    @property
    def step(self) -> int:
        return max(1, self.size - self.overlap)


def page_offsets(pages: DataFrame) -> DataFrame:
    """Pages given as (paper_id, page_number, text) with normalised text and char_start, char_end.

    One line feed stands between pages. Offsets are sums within ranges of 1,024 pages, then over the ranges.
    """
    p = pages.select("paper_id", "page_number", T.normalised("text").alias("text")).withColumn("r", F.floor(F.col("page_number") / 1024))
    length = F.char_length("text") + 1
    within = F.sum(length).over(Window.partitionBy("paper_id", "r").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1))
    sums = p.groupBy("paper_id", "r").agg(F.sum(length).alias("n"))
    before = sums.select("paper_id", "r", F.coalesce(F.sum("n").over(Window.partitionBy("paper_id").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    out = p.withColumn("within", F.coalesce(within, F.lit(0))).join(before, ["paper_id", "r"])
    start = (F.col("before") + F.col("within")).cast("int")
    return out.select("paper_id", "page_number", "text", start.alias("char_start"), (start + F.char_length("text")).alias("char_end"))


def distinct_pages(pages: DataFrame) -> DataFrame:
    """One row of each page; null texts are empty."""
    one = pages.where("paper_id IS NOT NULL AND page_number IS NOT NULL").groupBy("paper_id", "page_number").agg(F.min(F.struct("char_start", "char_end", F.coalesce("text", F.lit("")).alias("text"))).alias("p"))
    return one.select("paper_id", "page_number", "p.*")


def chunk_pages(pages: DataFrame, w: Windows = Windows(), fixed_pages: bool = False) -> DataFrame:
    """paper_id, chunk_index, chunk_id, text, page_start, page_end, char_start, char_end, n_tokens, sha256.

    Windows end after the last sentence's end in their last 200 characters, where there is one and text follows.
    Texts of fewer than `least` characters, and papers with less text, give none. An offset on the line feed
    between pages counts to the paper's last page, as in the published behaviour, or with fixed_pages to the page
    before it.
    """
    p = distinct_pages(pages)
    size = p.groupBy("paper_id").agg(F.max("char_end").alias("n"), F.max("page_number").alias("last_page"), F.sum(F.char_length("text")).alias("letters")).where(F.col("letters") >= w.least)
    first = F.greatest(F.lit(0), F.ceil((F.col("char_start") - w.size) / w.step))
    each = p.select("*", F.explode(F.sequence(first, F.greatest(first, F.floor(F.col("char_end") / w.step)))).alias("k")).withColumn("s", F.col("k") * w.step)
    each = each.where((F.col("s") <= F.col("char_end")) & (F.col("s") + w.size >= F.col("char_start")))
    a, b = F.greatest("s", "char_start"), F.least(F.col("s") + w.size, F.col("char_end"))
    part = F.substr("text", (a - F.col("char_start") + 1).cast("int"), F.greatest(F.lit(0), b - a).cast("int"))
    groups = each.select("paper_id", "s", F.struct("page_number", "char_start", "char_end", part.alias("part")).alias("x")).groupBy("paper_id", "s").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    rows = groups.join(size, "paper_id").where(F.col("s") < F.col("n")).withColumn("window", F.array_join(F.transform("xs", lambda x: x["part"]), "\n"))
    full = F.least(F.col("s") + w.size, F.col("n"))
    tail = F.substr("window", (F.lit(w.size - LOOK_BACK + 1)), F.lit(LOOK_BACK))
    found = F.length(F.regexp_extract(tail, r"(?s)^(.*[.!?]\s)", 1))
    end = F.when((full < F.col("n")) & (found > 0), F.col("s") + w.size - LOOK_BACK + found).otherwise(full)
    rows = rows.withColumn("end", end).withColumn("text", F.regexp_replace(F.substr("window", F.lit(1), (F.col("end") - F.col("s")).cast("int")), r"^\s+|\s+$", ""))
    rows = rows.where(F.char_length("text") >= w.least)

    def page(offset):
        on = F.filter("xs", lambda x: (x["char_start"] <= offset) & (offset < x["char_end"]))
        before = F.filter("xs", lambda x: x["char_end"] <= offset)
        other = F.element_at(before, -1)["page_number"] if fixed_pages else F.col("last_page")
        return F.when(F.size(on) > 0, F.element_at(on, 1)["page_number"]).otherwise(other)

    # numbers are counted on narrow rows, within ranges of windows and then over the ranges
    narrow = rows.select("paper_id", "s", F.floor(F.col("s") / (w.step * RANGE)).alias("r"))
    inside = narrow.withColumn("i", F.row_number().over(Window.partitionBy("paper_id", "r").orderBy("s")))
    before = narrow.groupBy("paper_id", "r").agg(F.count("*").alias("c")).select(
        "paper_id", "r", F.coalesce(F.sum("c").over(Window.partitionBy("paper_id").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    index = inside.join(before, ["paper_id", "r"]).select("paper_id", "s", (F.col("before") + F.col("i") - 1).cast("int").alias("chunk_index"))
    last = F.greatest(F.col("s"), F.col("end") - 1)
    return rows.join(index, ["paper_id", "s"]).select(
        "paper_id", "chunk_index", F.concat_ws("::", "paper_id", F.col("chunk_index").cast("string")).alias("chunk_id"), "text", page(F.col("s")).cast("int").alias("page_start"), page(last).cast("int").alias("page_end"),
        F.col("s").cast("int").alias("char_start"), F.col("end").cast("int").alias("char_end"), T.token_count("text").alias("n_tokens"), T.short_hash("text").alias("sha256"),
    )
