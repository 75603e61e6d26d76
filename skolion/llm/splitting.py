"""Splitting oversized items at natural boundaries by packing a structure tree.

A text is parsed into a tree: sections nested by the depth of their headings, blocks between blank lines, list
items nested by indentation, lines, sentences, clauses, words. Sibling subtrees are merged from below while they
fit, and only nodes above the limit are opened; what an opened node gives isn't mixed with its neighbours. Pieces
overlap by exactly the given number of characters, so a piece's own new part is packed to the limit less the
overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

if TYPE_CHECKING:
    import pandas as pd

LIMIT, OVERLAP = 900, 150
#: Width of the offset bins in which pages and pieces meet.
PAGE_BIN = 4096

# Notations of headings and of list items.
_HEADING = re.compile(r"^(?:(#{1,6}) \S|(\d{1,2}(?:\.\d{1,3})*)\.? [A-Z][^\n]{0,60}$)", re.MULTILINE)
_ITEM = re.compile(r"^([ \t]*)(?:[-*•]|\(?[a-z0-9]{1,3}[.)])[ \t]+\S", re.MULTILINE)
_BLANK = re.compile(r"\n[ \t]*\n+")
#: Where spans without structure are cut, from the coarsest. A cut lies after the match.
SPANS = tuple(
    re.compile(p)
    for p in (
        r"(?<=[.!?:])[\"')\]]*\n",  # lines that end a sentence
        r"[.!?][\"')\]]*\s+(?=[\"'(\[]?[\w])",  # sentences
        r"[;:,][\"')\]]*\s+",  # clauses
        r"\s+",  # words
    )
)


@dataclass
class Node:
    """text[start:end] with its subtrees in order; they cover it without gaps. level: the first of SPANS to open it
    at where it has no subtrees."""

    start: int
    end: int
    depth: int = 0
    children: list[Node] = field(default_factory=list)
    level: int = 0


def _nest(start: int, end: int, heads: list[tuple[int, int]]) -> Node:
    """The tree of nodes that begin at heads (place, depth) and go on to the next one that isn't deeper; what stands
    before a node's first subtree is its first subtree."""
    root = Node(start, end, -1)
    open_ = [root]
    for at, depth in heads:
        while open_[-1].depth >= depth:
            open_.pop().end = at
        open_[-1].children.append(Node(at, end, depth))
        open_.append(open_[-1].children[-1])
    todo = [root]
    while todo:
        node = todo.pop()
        todo += node.children
        if node.children and node.children[0].start > node.start:
            node.children.insert(0, Node(node.start, node.children[0].start))
    return root


def _leaves(node: Node) -> list[Node]:
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        todo += n.children
        if not n.children:
            out.append(n)
    return out


def tree(text: str) -> Node:
    """Sections by the depth of headings, in them blocks, in these list items by indentation."""
    root = _nest(0, len(text), [(m.start(), len(m[1]) if m[1] else m[2].count(".") + 1) for m in _HEADING.finditer(text)])
    for body in _leaves(root):
        ends = [m.end() for m in _BLANK.finditer(text, body.start, body.end) if m.end() < body.end]
        if ends:
            body.children = [Node(a, b) for a, b in zip([body.start, *ends], [*ends, body.end])]
        for block in body.children or [body]:
            items = [(m.start(), len(m[1].expandtabs(4))) for m in _ITEM.finditer(text, block.start, block.end)]
            if items:
                block.children = _nest(block.start, block.end, items).children
    return root


def _open(text: str, node: Node) -> list[Node]:
    """The subtrees of a node; one without any is cut at the first level of SPANS that cuts it."""
    if node.children:
        return node.children
    for level in range(node.level, len(SPANS)):
        cuts = [m.end() for m in SPANS[level].finditer(text, node.start, node.end) if node.start < m.end() < node.end]
        if cuts:
            return [Node(a, b, level=level + 1) for a, b in zip([node.start, *cuts], [*cuts, node.end])]
    return []


def pack(text: str, root: Node, limit: int) -> list[int]:
    """Ends of the runs of at most `limit` characters that cover the tree."""
    ends: list[int] = []
    todo = [iter([root])]  # a stack, as trees may be deep
    begun = root.start
    while todo:
        node = next(todo[-1], None)
        if node is None:
            todo.pop()
            if todo and ends[-1:] != [at]:  # an opened node ends, and with it the run of its last subtrees
                ends.append(at)
                begun = at
            continue
        if node.end - node.start > limit:  # opened; what was merged before it is a run
            if begun < node.start:
                ends.append(node.start)
            begun = at = node.start
            parts = _open(text, node)
            if parts:
                todo.append(iter(parts))
            else:  # one word longer than the limit
                ends += [*range(node.start + limit, node.end, limit), node.end]
                begun = at = node.end
        else:
            if node.end - begun > limit:
                ends.append(node.start)
                begun = node.start
            at = node.end
    return ends if ends[-1:] == [root.end] else [*ends, root.end]


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of every piece: each at most `limit` long, each next one starting `overlap` before the last end."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    ends = pack(text, tree(text), limit - overlap)
    return [(max(0, (0 if i == 0 else ends[i - 1] - overlap)), e) for i, e in enumerate(ends)]


def oversized(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row of each chunk_id whose text is above the limit; its other columns are those of the copy that arrived first."""
    wanted = ["chunk_id", "paper_id", "text", "char_start", "page_start"]
    rows = chunks.where(F.char_length("text") > limit).where(F.col("chunk_id").isNotNull())
    order = F.struct(F.col("received_at").isNull(), "received_at", "delivery_id", *wanted)
    return rows.groupBy("chunk_id").agg(F.min_by(F.struct(*wanted), order).alias("r")).select("r.*")


def pieces(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """chunk_id, paper_id, piece_no, text, begin, end and n_tokens of every piece of every oversized chunk.

    begin and end count code points of the chunk's text; n_tokens counts words between white space. Texts at or
    under the limit, empty or null ones and rows without chunk_id give no rows. Copies are cut once.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for batch in batches:
            out = [
                (*row[:4], i, row.text[a:b], a, b, len(row.text[a:b].split()))
                for row in batch.itertuples(index=False)
                for i, (a, b) in enumerate(cut(row.text, limit, overlap))
            ]
            yield pd.DataFrame(out, columns=["chunk_id", "paper_id", "char_start", "page_start", "piece_no", "text", "begin", "end", "n_tokens"])

    rows = oversized(chunks, limit).select("chunk_id", "paper_id", "char_start", "page_start", "text")
    schema = "chunk_id string, paper_id string, char_start int, page_start int, piece_no int, text string, begin int, end int, n_tokens int"
    return rows.mapInPandas(split, schema)


def _leads(starts: DataFrame, pages: DataFrame) -> DataFrame:
    """(chunk_id, lead): how much white space the paper has from a chunk's char_start on, over line feeds and pages.

    Numbers meet first; a page's text is looked at only where a chunk starts in it.
    """
    ends = pages.select("paper_id", "page_number", "lo", "hi", F.col("head").alias("white"))
    inside = _on(starts, "char_start", pages).where(F.col("lo").isNotNull()).select("chunk_id", "paper_id", "page_number", "lo", "hi", (F.col("char_start") - F.col("lo")).alias("skip"))
    texts = pages.select("paper_id", "page_number", "lo", "text")
    white = F.length(F.regexp_extract(F.substr("text", F.col("skip") + 1), r"^[\s\p{Z}]*", 0))
    first = inside.join(texts, ["paper_id", "page_number", "lo"]).select("chunk_id", "paper_id", "hi", white.alias("lead"), (F.col("lo") + F.col("skip") + white).alias("at"))
    done, open_ = [], materialise(first)
    while True:
        # a run that reaches the page's end goes on with the line feed and the next page's first characters
        done.append(open_.where("at < hi").select("chunk_id", "lead"))
        ended = open_.where("at >= hi")
        onward = materialise(ended.select("chunk_id", "paper_id", "lead", (F.col("hi") + 1).alias("lo")).join(ends.drop("page_number"), ["paper_id", "lo"], "left"))
        done.append(onward.where("hi IS NULL").select("chunk_id", "lead"))
        open_ = onward.where("hi IS NOT NULL").select("chunk_id", "paper_id", "hi", (F.col("lead") + 1 + F.col("white")).alias("lead"), (F.col("lo") + F.col("white")).alias("at"))
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, done).groupBy("chunk_id").agg(F.max("lead").alias("lead"))


def _on(df: DataFrame, offset: str, pages: DataFrame) -> DataFrame:
    """df with the page (page_number, lo, hi) that its offset lies on, or its line feed; nulls where there is none."""
    bins = F.sequence(F.floor(F.col("lo") / PAGE_BIN), F.floor(F.col("hi") / PAGE_BIN))
    spans = pages.select(F.col("paper_id").alias("pid"), "page_number", "lo", "hi", F.explode(bins).alias("bin"))
    hit = (F.col("paper_id") == F.col("pid")) & (F.floor(F.col(offset) / PAGE_BIN) == F.col("bin")) & F.col(offset).between(F.col("lo"), F.col("hi"))
    return df.join(spans, hit, "left").drop("pid", "bin")


def located(parts: DataFrame, pages: DataFrame) -> DataFrame:
    """Pieces with page_start, page_end, char_start and char_end in the paper.

    A chunk's text has lost the white space at the start of its window, so the white space that the paper has from
    the chunk's char_start on is skipped first, however long. The line feed between two pages belongs to the page
    before it. A paper without pages leaves the pages null and takes char_start as the place of the first character.
    Pages and offsets meet in bins of PAGE_BIN characters, so that a paper with very many pages never meets itself;
    of copies of a page one counts.
    """
    head = F.length(F.regexp_extract("text", r"^[\s\p{Z}]*", 0))
    place = ["paper_id", "page_number", F.col("char_start").alias("lo"), F.col("char_end").alias("hi")]
    page = pages.where("char_end >= char_start").select(*place, F.coalesce(head, F.lit(0)).alias("head"), F.coalesce("text", F.lit("")).alias("text"))
    leads = _leads(parts.select("chunk_id", "paper_id", "char_start").distinct(), page)
    # empty pages hold no character; numbers only from here on
    page = page.where("hi > lo").select("paper_id", "page_number", "lo", "hi").distinct()
    start = F.col("char_start") + F.coalesce("lead", F.lit(0))
    placed = parts.join(leads, "chunk_id", "left").select(
        "chunk_id", "paper_id", "piece_no", "text", "n_tokens", (start + F.col("begin")).alias("char_start"), (start + F.col("end")).alias("char_end"), F.col("page_start").alias("given"))
    key = ["chunk_id", "piece_no"]
    begins = _on(placed.select("paper_id", *key, F.col("char_start").alias("at")), "at", page).where((F.col("at") < F.col("hi")) | F.col("hi").isNull())
    begins = begins.groupBy(*key).agg(F.min("page_number").alias("page_start"))
    ends = _on(placed.select("paper_id", *key, (F.col("char_end") - 1).alias("at")), "at", page).groupBy(*key).agg(F.min("page_number").alias("page_end"))
    both = placed.join(begins, key, "left").join(ends, key, "left")
    start = F.coalesce("page_start", "page_end", "given")
    return both.select("chunk_id", "paper_id", "piece_no", start.alias("page_start"), F.coalesce("page_end", "page_start").alias("page_end"), "char_start", "char_end", "n_tokens", "text")
