"""Page bodies to blocks, heading paths, sections and page hashes."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import SEPARATOR
from .tables import slices

PANELS = ("info", "note", "warning", "tip", "panel")
MACRO = "ac:structured-macro"
LEVELS = {f"h{i}": i for i in range(1, 7)}
#: The kind of the block that begins at a tag.
BEGINS = dict.fromkeys(LEVELS, "heading") | {"ul": "list", "ol": "list", "table": "table"}
_NAMED = re.compile(r"""\bac:name\s*=\s*["']?([^"'\s>]+)""", re.I)
#: Raw text of scripts and styles, CDATA, a tag (with > in quoted values), other markup, text.
_TOKEN = re.compile(
    r"""<(?P<raw>script|style)\b[^>]*>(?P<said>.*?)(?:</(?P=raw)\s*>|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<!--.*?(?:-->|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<rest>(?:"[^"]*+"|'[^']*+'|[^>"'])*+)>|<[!?/][^>]*+>|(?P<text>[^<]++|<)""",
    re.S | re.I,
)
#: (level of the block that ends, kind of the next one; None: as it was, or a paragraph after a block with text)
Cut = tuple[int, str | None]


def _tidy(text: str) -> str:
    return " ".join((text if text.isascii() else unicodedata.normalize("NFC", text)).split())


def _cuts(tag: str, rest: str, end: bool) -> Iterator[Cut]:
    """What a tag ends or begins."""
    if not end:
        named = m[1].lower() if tag == MACRO and (m := _NAMED.search(rest)) else None
        kind = "code" if named == "code" else "panel" if named in PANELS else BEGINS.get(tag)
        if kind:
            yield 0, kind
    if end or rest.endswith("/"):
        if tag in BEGINS or tag == MACRO:
            yield LEVELS.get(tag, 0), "paragraph"
        elif tag == "p":
            yield 0, None


def _marks(body: str, keep_cdata: bool, drop_script_style: bool) -> Iterator[str | Cut]:
    """The body's texts and cuts in order, with a cut at the end."""
    for m in _TOKEN.finditer(body):
        if m["text"]:
            yield html.unescape(m["text"])
        elif m["tag"]:
            yield from _cuts(m["tag"].lower(), m["rest"], bool(m["end"]))
        elif m["cdata"] and keep_cdata:
            yield m["cdata"]
        elif m["said"] and not drop_script_style:
            yield m["said"]
    yield 0, None


def _blocks(body: str | None, keep_cdata: bool, drop_script_style: bool) -> list[tuple[str, int, str]]:
    """(kind, level, text) of what lies between cuts, where that has text."""
    out: list[tuple[str, int, str]] = []
    kind, said = "paragraph", []
    for x in _marks(body or "", keep_cdata, drop_script_style):
        if isinstance(x, str):
            said.append(x)
            continue
        level, then = x
        text, said = _tidy(" ".join(said)), []
        if text:
            out.append((kind, level, text))
        kind = then or ("paragraph" if text else kind)
    return out


def normalize_pages(pages: DataFrame, id_col: str = "page_id", body_col: str = "body", keep_cdata: bool = True, drop_script_style: bool = True) -> DataFrame:
    """(page_id, pos, kind, level, text): blocks of each body in order, from 0. With both options off, CDATA is lost and
    script text kept, as a plain HTML parser does. Empty bodies have no blocks; any other body gives some for its text,
    however broken its markup is."""

    def parse(batches):
        for b in slices(batches):
            yield pd.DataFrame([(p, i, *x) for p, body in zip(b["p"], b["body"], strict=True) for i, x in enumerate(_blocks(body, keep_cdata, drop_script_style))], columns=["page_id", "pos", "kind", "level", "text"])

    return pages.select(F.col(id_col).cast("long").alias("p"), F.col(body_col).alias("body")).mapInPandas(parse, "page_id long, pos int, kind string, level int, text string")


def line_blocks(pages: DataFrame, id_col: str = "page_id", body_col: str = "body") -> DataFrame:
    """Blocks of plain texts: one a line that isn't blank; lines that begin with # are headings of that level."""
    lines = pages.select(F.col(id_col).cast("long").alias("page_id"), F.posexplode(F.split(body_col, "\n")).alias("pos", "line")).where(F.trim("line") != "")
    level = F.when(F.col("line").rlike("^#{1,6} "), F.length(F.regexp_extract("line", "^(#{1,6}) ", 1))).otherwise(0)
    text = F.trim(F.regexp_replace(F.regexp_replace("line", "^#{1,6} ", ""), r"\s+", " "))
    return lines.select("page_id", "pos", F.when(level > 0, "heading").otherwise("paragraph").alias("kind"), level.cast("int").alias("level"), text.alias("text"))


def _page() -> Window:
    return Window.partitionBy("page_id").orderBy("pos")


def heading_paths(blocks: DataFrame) -> DataFrame:
    """blocks with path array<string>: the texts of the headings around each, itself included for headings. A heading ends
    those of its own level and below: level L's last heading counts if it comes after the last ones of all levels above."""
    upto = _page().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = {v: (F.last(F.when(F.col("level") == v, F.col("text")), True).over(upto), F.last(F.when(F.col("level") == v, F.col("pos")), True).over(upto)) for v in range(1, 7)}
    out = blocks.select("*", *(c.alias(f"_{n}{v}") for v, (t, p) in last.items() for n, c in (("t", t), ("p", p))))
    parts, above = [], F.lit(-1)
    for v in range(1, 7):
        at = F.col(f"_p{v}")
        parts.append(F.when(at.isNotNull() & (at > above), F.col(f"_t{v}")))
        above = F.greatest(above, F.coalesce(at, F.lit(-1)))
    return out.withColumn("path", F.array_compact(F.array(*parts))).drop(*(f"_{n}{v}" for v in range(1, 7) for n in "tp"))


def build_sections(blocks: DataFrame) -> DataFrame:
    """blocks (with path) with section (0 for what comes before any heading, if anything), section_level and
    sibling_ordinal: how many sections of the page had this path before. All of it goes by page, so rows are dealt once. Rows
    without a page have no section and are left out."""
    is_heading = (F.col("kind") == "heading").cast("int")
    out = blocks.withColumn("section", F.sum(is_heading).over(_page().rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int"))
    inside = Window.partitionBy("page_id", "section").orderBy("pos")
    out = out.where("page_id is not null").withColumns({"_path": F.first("path").over(inside), "section_level": F.first("level").over(inside)})
    return out.withColumn("sibling_ordinal", F.dense_rank().over(Window.partitionBy("page_id", "_path").orderBy("section")) - 1).drop("_path")


def _ordered(parts: Column) -> Column:
    texts = F.transform(F.array_sort(F.collect_list(F.struct("pos", parts.alias("s")))), lambda x: x["s"])
    return F.sha2(F.aggregate(texts, F.lit(b""), lambda a, x: F.concat(a, x.cast("binary"), F.lit(SEPARATOR))), 256)


def page_hashes(blocks: DataFrame) -> DataFrame:
    """(page_id, content_hash, structure_hash) of blocks with path: ordered hashes of kind:level:text, and of
    kind:level:path."""
    what = F.concat_ws(":", "kind", F.col("level").cast("string"), "text")
    where = F.concat_ws(":", "kind", F.col("level").cast("string"), F.array_join("path", ">"))
    return blocks.groupBy("page_id").agg(_ordered(what).alias("content_hash"), _ordered(where).alias("structure_hash"))


def doc_text(blocks: DataFrame, most: int = 60_000) -> DataFrame:
    """(page_id, doc_text): block texts by line, cut to ``most`` characters."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n")
    return blocks.groupBy("page_id").agg(F.left(lines, F.lit(most)).alias("doc_text"))
