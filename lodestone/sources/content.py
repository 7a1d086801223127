"""Main content of pages: blocks of text with their words and linked words, and a decision by them and their neighbours.

A page is read once, in order. Block elements end a block, inline ones don't; what stands in navigation, scripts, forms and
other elements that are no content is left out with all that is in them. A block's link density is the share of its words
that are in links. Which blocks are content is decided by three neighbouring blocks' words and densities (after
Kohlschuetter, Fankhauser and Nejdl, "Boilerplate Detection using Shallow Text Features", 2010, table of the
densitometric classifier); headings stay if a content block follows before the next heading.

Null pages give null, pages without content an empty text. Pages of any length are read whole. Unclosed and crossed tags
end with the element around them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

OUT = {"script", "style", "nav", "footer", "noscript", "template", "head", "form", "aside", "button", "select", "svg", "iframe"}
BLOCK = {"address", "article", "blockquote", "body", "dd", "div", "dl", "dt", "fieldset", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "br"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


@dataclass
class Block:
    text: str
    words: int
    linked: int
    heading: bool
    depth: int


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__()
        self.open: list[str] = []
        self.out = 0  # open elements that are no content
        self.parts: list[tuple[str, bool]] = []
        self.found: list[Block] = []

    def _end(self) -> None:
        text = " ".join("".join(p for p, _ in self.parts).split())
        if text:
            linked = len("".join(p if in_link else " " for p, in_link in self.parts).split())
            self.found.append(Block(text, len(text.split()), min(linked, len(text.split())), any(t in HEADINGS for t in self.open), len(self.open)))
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK or tag in OUT:
            self._end()
        if tag not in VOID:
            self.open.append(tag)
            self.out += tag in OUT

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCK:
            self._end()

    def handle_endtag(self, tag):
        if tag not in self.open:
            return
        if tag in BLOCK or tag in OUT:
            self._end()
        while True:
            last = self.open.pop()
            if last in BLOCK:
                self._end()
            self.out -= last in OUT
            if last == tag:
                break

    def handle_data(self, data):
        if not self.out:
            self.parts.append((data, "a" in self.open))


def blocks(html: str) -> list[Block]:
    p = _Blocks()
    p.feed(html)
    p.close()
    p._end()
    return p.found


_NONE = Block("", 0, 0, False, 0)


def is_content(before: Block, block: Block, after: Block) -> bool:
    if 3 * block.linked > block.words:
        return False
    if 9 * before.linked <= 5 * before.words:
        return block.words > 16 or after.words > 15 or before.words > 4
    return block.words > 40 or after.words > 17


def chosen(found: list[Block]) -> list[str]:
    """Texts of the content blocks, and of the headings over them."""
    kept, heading = [], None
    for i, b in enumerate(found):
        if b.heading:
            heading = b if 3 * b.linked <= b.words else None
        elif is_content(found[i - 1] if i else _NONE, b, found[i + 1] if i + 1 < len(found) else _NONE):
            if heading:
                kept.append(heading.text)
                heading = None
            kept.append(b.text)
    return kept


def main_text(html: str) -> str:
    return "\n".join(chosen(blocks(html)))


def with_content(pages: DataFrame, *, html: str = "html", name: str = "content") -> DataFrame:
    """pages with their main content and how many blocks there were and stayed (blocks, kept), in Arrow batches; other columns come along."""
    schema = pages.schema
    at = pages.columns.index(html)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts, total, kept = [], [], []
                for v in part.column(at).to_pylist():
                    found = None if v is None else blocks(v)
                    lines = None if v is None else chosen(found)
                    texts.append(None if v is None else "\n".join(lines))
                    total.append(None if v is None else len(found))
                    kept.append(None if v is None else len(lines))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string()), pa.array(total, pa.int32()), pa.array(kept, pa.int32())], names)

    names = [*pages.columns, name, "blocks", "kept"]
    return pages.mapInArrow(run, StructType([*schema, StructField(name, StringType()), StructField("blocks", IntegerType()), StructField("kept", IntegerType())]))


@pandas_udf(StringType())
def content(s: pd.Series) -> pd.Series:
    """The main content as a column, for fetch()."""
    return s.map(lambda v: None if v is None else main_text(v))
