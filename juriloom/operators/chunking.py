"""Segmentation of extracted text: sections by heading, articles inside sections, parts of bounded size.

Sections and articles are cut by zero-width patterns; the article in force is carried over the sections of a document by a
fold over its segments; greedy packing is a fold over a text's blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocabulary as V
from ..functions.text import article_tag, let

_HEADER = rf"\b(?:Article|ARTICLE)[ \t]+({V.ARTICLE_NUMBER})\b"
_BLOCKS = r"\n\s*\n|(?<=\.)\s+(?=[A-ZÀ-ÖØ-Þ])"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def split_parts(text: Column, target: int = V.CHUNK_TARGET) -> Column:
    """A text's parts: whole if it fits; else blocks (at blank lines, or a sentence's end before a capital) packed greedily
    with an empty line between them; a block beyond the target is cut at the target and stands alone. Whoever comes after
    a full part is still charged for the separator."""
    whole = strip(text)
    blocks = F.filter(F.transform(F.split(whole, _BLOCKS), strip), lambda b: b != "")
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), empty.alias("open"), F.lit(0).alias("size"))
    join = lambda a: F.array_join(a, "\n\n")

    def pack(acc: Column, b: Column) -> Column:
        n, opened = F.length(b), F.size(acc["open"]) > 0
        flushed = F.when(opened, F.concat(acc["done"], F.array(join(acc["open"])))).otherwise(acc["done"])
        pieces = F.transform(F.sequence(F.lit(0), ((n - 1) / target).cast("int")), lambda i: F.substring(b, i * target + 1, F.lit(target)))
        cost = n + F.when(opened, 2).otherwise(0)
        big = F.struct(F.concat(flushed, pieces).alias("done"), empty.alias("open"), F.lit(0).alias("size"))
        next_part = F.struct(flushed.alias("done"), F.array(b).alias("open"), cost.alias("size"))
        same_part = F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.array(b)).alias("open"), (acc["size"] + cost).alias("size"))
        return F.when(n > target, big).when(opened & (acc["size"] + cost > target), next_part).otherwise(same_part)

    packed = F.aggregate(blocks, start, pack, lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(join(acc["open"])))).otherwise(acc["done"]))
    return F.when(whole == "", empty).when(F.length(whole) <= target, F.array(whole)).otherwise(packed)


def sections(docs: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """(key, section, locator, body). Text before the first heading is left out; without headings it is one "Document"."""
    heading = "(?m)" + V.LOCATOR
    parts = F.split(F.col(text), f"(?m)(?={V.LOCATOR})")
    rows = docs.select(key, F.posexplode(parts).alias("section", "__part"), F.col(text).rlike(heading).alias("__any"))
    located = F.regexp_extract("__part", heading, 1)
    rows = rows.filter(~F.col("__any") | F.col("__part").rlike(r"\A" + heading))
    return rows.select(key, "section", F.when(F.col("__any"), F.trim(located)).otherwise("Document").alias("locator"), F.when(F.col("__any"), F.regexp_replace("__part", r"\A##[^\r\n]*", "")).otherwise(F.col("__part")).alias("body"))


def chunks(docs: DataFrame, key: str = "document_id", text: str = "text", target: int = V.CHUNK_TARGET) -> DataFrame:
    """(key, ord, locator, content, article_number), ord from 1 in a document's order."""
    heading, own_text = "(?m)" + V.LOCATOR, F.col(text)
    bodies = lambda parts, any_: F.transform(F.filter(parts, lambda p: ~any_ | p.rlike(r"\A" + heading)), lambda p: F.struct(F.when(any_, F.trim(F.regexp_extract(p, heading, 1))).otherwise("Document").alias("locator"), F.when(any_, F.regexp_replace(p, r"\A##[^\r\n]*", "")).otherwise(p).alias("body")))
    secs = let(own_text.rlike(heading), lambda any_: bodies(F.split(own_text, f"(?m)(?={V.LOCATOR})"), any_))
    number = lambda p: let(F.regexp_extract(p, r"\A" + _HEADER, 1), lambda h: F.when(h != "", article_tag(h)))

    def segments(sec: Column) -> Column:
        """Of a section: its articles, and whether it ends the article before."""
        pieces = F.transform(F.split(sec["body"], f"(?={_HEADER})"), lambda p: F.struct(number(p).alias("own"), strip(p).alias("text")))
        ends = lambda x, i: F.when((i == 0) & x["own"].isNull(), F.substring(sec["body"], 1, 1000).rlike(V.RESET)).otherwise(F.lit(False))
        return F.transform(F.filter(pieces, lambda x: x["text"] != ""), lambda x, i: F.struct(sec["locator"].alias("locator"), x["own"].alias("own"), x["text"].alias("text"), ends(x, i).alias("ends")))

    def carried(all_: Column) -> Column:
        """The article of each segment: one goes on until the next, or until a section opens without an article under a
        structural heading."""
        start = F.struct(F.lit(None).cast("string").alias("now"), F.array().cast("array<string>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            now = F.when(~x["ends"], F.coalesce(x["own"], acc["now"]))
            return F.struct(now.alias("now"), F.concat(acc["out"], F.array(now)).alias("out"))

        return F.aggregate(all_, start, step, lambda acc: acc["out"])

    def parts_of(x: Column, article: Column) -> Column:
        label = lambda ps, i: F.when(F.size(ps) > 1, F.concat(x["locator"], F.lit(", part "), (i + 1).cast("string"))).otherwise(x["locator"])
        return let(split_parts(x["text"], target), lambda ps: F.transform(ps, lambda p, i: F.struct(label(ps, i).alias("locator"), p.alias("content"), article.alias("article_number"))))

    # All of a document is worked out in its row: nothing is shuffled or sorted.
    rows = let(F.flatten(F.transform(secs, segments)), lambda all_: F.flatten(F.zip_with(all_, carried(all_), parts_of)))
    return docs.select(key, F.posexplode(rows).alias("at", "c")).select(key, (F.col("at") + 1).alias("ord"), "c.locator", "c.content", "c.article_number")
