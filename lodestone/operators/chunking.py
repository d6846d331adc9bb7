"""Documents into chunks: paragraphs packed greedily, long ones cut hard, an overlap with the chunk before."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

#: Fixed value: a numbered heading.
HEADING = re.compile(r"^\s*(\d+(?:\.\d+)*)\s+(\S.{0,60}?)\s*$")


def pack(text: Column, most: int, overlap: int) -> Column:
    """array<string>: the chunks of a stripped text.

    A paragraph counts two more than its length. Longer ones than ``most`` are cut; the rest of a cut one goes on being
    packed. The overlap is the end of the chunk before as it was without its own overlap.
    """
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda p: p != "")

    def pieces(p: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.floor((F.length(p) - 1) / F.lit(most)).cast("int"), F.lit(0)))
        return F.transform(starts, lambda k: F.named_struct(F.lit("s"), p.substr(k * most + 1, F.lit(most)), F.lit("hard"), (k + 1) * most < F.length(p)))

    state = "struct<out:array<string>,cur:string,n:int>"
    start = F.named_struct(F.lit("out"), F.array().cast("array<string>"), F.lit("cur"), F.lit(None).cast("string"), F.lit("n"), F.lit(0)).cast(state)

    def step(acc: Column, p: Column) -> Column:
        flushed = F.when(acc["cur"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["cur"])))
        size = F.length(p["s"]) + 2
        fits = acc["cur"].isNotNull() & (acc["n"] + size <= most)
        make = lambda out, cur, n: F.named_struct(F.lit("out"), out, F.lit("cur"), cur, F.lit("n"), n).cast(state)
        hard = make(F.concat(flushed, F.array(p["s"])), F.lit(None), F.lit(0))
        soft = F.when(fits, make(acc["out"], F.concat(acc["cur"], F.lit("\n"), p["s"]), acc["n"] + size)).otherwise(make(flushed, p["s"], size))
        return F.when(p["hard"], hard).otherwise(soft)

    raw = F.aggregate(F.flatten(F.transform(paragraphs, pieces)), start, step, lambda acc: F.when(acc["cur"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["cur"]))))
    if overlap <= 0:
        return raw
    tail = lambda c: F.when(F.length(c) > overlap, F.substring(c, -overlap, overlap)).otherwise(c)
    return F.transform(raw, lambda c, i: F.when(i > 0, F.concat(tail(F.get(raw, i - 1)), F.lit("\n"), c)).otherwise(c))


def chunk_documents(docs: DataFrame, most: int = 4000, overlap: int = 200, id_col: str = "source_id", text_col: str = "body") -> DataFrame:
    """chunk_id, doc_id, seq, text; documents without text have no chunks."""
    stripped = docs.select(F.col(id_col).alias("doc_id"), strip(F.coalesce(F.col(text_col), F.lit(""))).alias("t")).where(F.col("t") != "")
    chunks = F.when(F.length("t") <= most, F.array("t")).otherwise(pack(F.col("t"), most, overlap))
    rows = stripped.select("doc_id", F.posexplode(chunks).alias("seq", "text"))
    return rows.select(F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.col("seq").cast("string")).alias("chunk_id"), "doc_id", "seq", "text")


def is_heading(line: str) -> bool:
    """A numbered, short line that isn't one of a table of contents."""
    return len(line) <= 80 and "...." not in line and "…" not in line and bool(HEADING.match(line))


def sections(text: str) -> list[tuple[str, str]]:
    """(heading, text) of a manual; a heading right before another one belongs to a table of contents."""
    lines = [x.strip() for x in text.splitlines()]
    heads = [is_heading(x) for x in lines]
    out, title, held = [], "", []
    for i, line in enumerate(lines):
        if heads[i]:
            if i + 1 < len(lines) and lines[i + 1] and heads[i + 1]:
                continue
            if held:
                out.append((title, "\n".join(held)))
            title, held = line, []
        else:
            held.append(line)
    return [*out, (title, "\n".join(held))] if held else out


def section_documents(docs: DataFrame, id_col: str = "source_id", text_col: str = "body") -> DataFrame:
    """doc_id, position, section, text of manuals; sections keep their order."""

    @F.pandas_udf("array<struct<section:string,text:string>>")
    def cut(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [{"section": s, "text": x} for s, x in sections((t or "").strip()) if x])

    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(cut(F.col(text_col))).alias("position", "s")).select("doc_id", "position", "s.section", "s.text")


def chunk_manuals(docs: DataFrame, most: int = 4000, overlap: int = 200, id_col: str = "source_id", text_col: str = "body") -> DataFrame:
    """chunk_id, doc_id, seq, section, text; a chunk begins with its section's heading."""
    cut = section_documents(docs, id_col, text_col)
    texts = F.when(F.length("text") <= most, F.array("text")).otherwise(pack(F.col("text"), most, overlap))
    marked = F.transform(texts, lambda t: F.when(F.col("section") != "", F.concat(F.lit("【"), F.col("section"), F.lit("】\n"), t)).otherwise(t))
    per = cut.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("position", "section", marked.alias("texts")))).alias("s"))
    flat = F.flatten(F.transform("s", lambda s: F.transform(s["texts"], lambda t: F.named_struct(F.lit("section"), s["section"], F.lit("text"), t))))
    rows = per.select("doc_id", F.posexplode(flat).alias("seq", "c"))
    return rows.select(F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.col("seq").cast("string")).alias("chunk_id"), "doc_id", "seq", "c.section", "c.text")
