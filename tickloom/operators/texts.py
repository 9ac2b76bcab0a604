"""Documents: sections by heading, chunks of bounded size, topic search, extraction helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Chunk size and characters per token.
CHUNK_CHARS = 320_000
CHARS_PER_TOKEN = 4
RISK_WORDS = ("risk", "position siz")
BULLETS = ("-", "*", "1.", "2.", "3.")


def page_markdown(html: Column, heading: str = "#") -> Column:
    """Page text with titles as headings, list items as bullets and paragraphs apart."""
    steps = [
        (r"(?is)<(script|style)[^>]*>.*?</(script|style)>", ""),
        (r"(?s)<!--.*?-->", ""),
        (r"\r", ""),
        (r"(?is)<(title|h1)[^>]*>(.*?)</(title|h1)>", f"\n{heading} $2\n"),
        (r"(?i)<li[^>]*>", "\n- "),
        (r"(?i)<(p|br)[^>]*>", "\n\n"),
        (r"(?s)<[^>]*>", ""),
    ]
    for pattern, to in steps:
        html = F.regexp_replace(html, pattern, to)
    return html


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def sections(docs: DataFrame, id_col: str, text: str = "text", levels: tuple[int, int] = (1, 6), preamble: bool = False) -> DataFrame:
    """One row per heading of the given levels: number, level, title, body.

    The text is cut in place, so no row leaves its partition.  With ``preamble``
    the text before the first heading is kept as a section of its own, a document
    without headings is one ``(root)`` section, and empty bodies are dropped.
    """
    lo, hi = levels
    mark = rf"(?m)^(?=#{{{lo},{hi}}}[ \t])"
    head = rf"\A(#{{{lo},{hi}}})[ \t]+([^\n]*?)[ \t]*(?:\n|\z)"
    cut = docs.select(id_col, F.posexplode(F.split(F.col(text), mark)).alias("section", "_piece"))
    hashes = F.regexp_extract("_piece", head, 1)
    titled = hashes != ""
    out = cut.select(
        id_col, F.col("section").cast("long").alias("section"), F.length(hashes).cast("long").alias("level"),
        F.when(titled, F.trim(F.regexp_extract("_piece", head, 2))).otherwise(F.lit("(preamble)")).alias("title"),
        F.when(titled, F.regexp_replace("_piece", head, "")).otherwise(F.col("_piece")).alias("body"),
    )
    if not preamble:
        return out.where(F.col("level") > 0)
    return out


def section_paths(docs: DataFrame, id_col: str, text: str = "text") -> DataFrame:
    """Sections of levels 2 and 3 with their heading path; a level 3 hangs under the last level 2."""
    s = sections(docs, id_col, text, (2, 3), preamble=True)
    w = Window.partitionBy(id_col).orderBy("section")  # sections of one document
    whole = Window.partitionBy(id_col)
    s = s.withColumn("_h2", F.last(F.when(F.col("level") == 2, F.col("title")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = s.withColumn("_headings", F.sum(F.when(F.col("level") > 0, 1).otherwise(0)).over(whole))
    root = F.col("_headings") == 0
    path = (
        F.when(root, F.array(F.lit("(root)")))
        .when(F.col("level") == 0, F.array(F.lit("(preamble)")))
        .when((F.col("level") == 3) & F.col("_h2").isNotNull(), F.array("_h2", "title"))
        .otherwise(F.array("title"))
    )
    body = F.when(root, F.col("body")).otherwise(_trim(F.col("body")))
    return s.select(id_col, "section", path.alias("path"), body.alias("body"), root.alias("_root")).where(
        F.col("_root") | (F.col("body") != "")
    ).drop("_root")


def pack_chunks(paths: DataFrame, id_col: str, target: int = CHUNK_CHARS) -> DataFrame:
    """Sections packed in order into chunks of at most ``target`` characters.

    A section longer than that is cut at blank lines into chunks of its own.  The
    chunk number of each piece comes from one fold over the document's pieces;
    the texts are then put together per chunk.
    """
    prefix = F.array_join("path", " > ")
    big = F.length("body") > target
    pieces = F.when(big, F.split("body", "\n\n")).otherwise(F.array("body"))
    p = paths.select(id_col, "section", "path", big.alias("_big"), prefix.alias("_pre"), F.posexplode(pieces).alias("_k", "_t"))
    size = F.length("_t")
    item = F.struct(
        "section", "_k", F.col("_big").alias("big"), size.alias("len"),
        F.when(F.col("_big"), size + 2).otherwise(size + F.length("_pre") + 8).alias("add"),
    )
    per_doc = p.groupBy(id_col).agg(F.array_sort(F.collect_list(item)).alias("_items"))  # pieces of one document
    zero = F.struct(
        F.lit(0).alias("no"), F.lit(0).alias("chars"), F.lit(False).alias("big"),
        F.array().cast("array<struct<no:int,chars:int>>").alias("out"),
    )

    def step(acc: Column, x: Column) -> Column:
        over = acc["chars"] + x["len"] > target
        first = x["_k"] == 0
        opens = F.when(x["big"], first | over).otherwise((acc["no"] == 0) | acc["big"] | over)
        no = F.when(opens, acc["no"] + 1).otherwise(acc["no"])
        restart = F.when(x["big"] & ~first, x["len"]).otherwise(x["add"])
        chars = F.when(opens, restart).otherwise(acc["chars"] + x["add"])
        mark = F.struct(no.alias("no"), chars.alias("chars"))
        return F.struct(no.alias("no"), chars.alias("chars"), x["big"].alias("big"), F.concat(acc["out"], F.array(mark)).alias("out"))

    marks = F.aggregate("_items", zero, step, lambda acc: acc["out"])
    numbered = per_doc.select(id_col, F.explode(F.arrays_zip(F.col("_items"), marks.alias("_marks"))).alias("_z"))
    numbered = numbered.select(id_col, F.col("_z._items.section").alias("section"), F.col("_z._items._k").alias("_k"),
                               F.col("_z._marks.no").cast("long").alias("chunk"), F.col("_z._marks.chars").alias("_chars"))
    j = p.join(numbered, [id_col, "section", "_k"])
    shown = F.when(F.col("_big"), F.col("_t")).otherwise(F.concat(F.lit("### "), F.col("_pre"), F.lit("\n\n"), F.col("_t")))
    order = F.struct("section", "_k")
    g = j.groupBy(id_col, "chunk").agg(
        F.min_by("path", order).alias("path"), F.bool_or("_big").alias("_big"), F.max_by("_chars", order).alias("_chars"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section", "_k", shown.alias("t")))), lambda x: x["t"]), "\n\n").alias("body"),
    )
    tokens = F.floor(F.when(F.col("_big"), F.col("_chars")).otherwise(F.length("body")) / F.lit(CHARS_PER_TOKEN))
    return g.select(id_col, "chunk", "path", "body", tokens.alias("token_estimate"))


def _lines(secs: DataFrame, id_col: str) -> DataFrame:
    cut = secs.select(id_col, "section", "title", F.posexplode(F.split("body", "\n")).alias("line", "_l"))
    return cut.withColumn("text", _trim(F.col("_l"))).withColumn("line", F.col("line").cast("long")).drop("_l")


def find_lines(secs: DataFrame, id_col: str, topic: str) -> DataFrame:
    """Lines of all sections that mention the topic."""
    return _lines(secs, id_col).where(F.lower("text").contains(topic.lower()))


def find_section(secs: DataFrame, id_col: str, name: str) -> DataFrame:
    """First section per document whose title contains the name."""
    hits = secs.where(F.lower("title").contains(name.lower()))
    best = hits.groupBy(id_col).agg(F.min_by(F.struct("section", "level", "title", "body"), "section").alias("s"))
    return best.select(id_col, "s.section", "s.level", "s.title", _trim(F.col("s.body")).alias("text"))


def bullet_lines(secs: DataFrame, id_col: str, words: Sequence[str] = RISK_WORDS) -> DataFrame:
    """Bullet lines of the sections whose title holds one of the words."""
    title = F.lower("title")
    wanted = F.lit(False)
    for w in words:
        wanted = wanted | title.contains(w)
    bullet = F.lit(False)
    for b in BULLETS:
        bullet = bullet | F.col("text").startswith(b)
    return _lines(secs.where(wanted), id_col).where(bullet)
