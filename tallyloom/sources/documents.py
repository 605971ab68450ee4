"""Documents in markup: facts, footnotes and page text."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import document_number

FACT_SCHEMA = "doc string, kind string, id string, context string, name string, text string, scale int, sign string, format string, refs string, to_refs string"


# The entities that pages use; the ampersand's own comes last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": " ", "&copy;": "©", "&middot;": "·", "&amp;": "&"}


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _parsed(doc: str, content: bytes | str) -> list[tuple]:
    """Flat rows of one document: contexts, numeric and text facts, footnotes, relationships."""
    try:
        root = ElementTree.fromstring(content)
    except ElementTree.ParseError as e:
        return [(doc, "error", None, None, None, str(e)[:200], None, None, None, None, None)]
    rows = []
    for node in root.iter():
        kind, get = _local(node.tag), node.get
        text = " ".join("".join(node.itertext()).split())
        if kind == "context":
            member = next((" ".join("".join(m.itertext()).split()) for m in node.iter() if _local(m.tag) in ("explicitMember", "typedMember")), None)
            date = next((d.text for d in node.iter() if _local(d.tag) in ("instant", "endDate")), None)
            rows.append((doc, "context", get("id"), None, member, date, None, None, None, None, None))
        elif kind in ("nonFraction", "nonNumeric"):
            if any(_local(k) == "nil" and v == "true" for k, v in node.attrib.items()):
                continue
            rows.append((doc, "number" if kind == "nonFraction" else "text", get("id"), get("contextRef"), get("name"), text, int(get("scale") or 0), get("sign"), get("format"), None, None))
        elif kind == "footnote":
            rows.append((doc, "footnote", get("id"), None, None, text, None, None, None, None, None))
        elif kind == "relationship":
            rows.append((doc, "relationship", None, None, None, None, None, None, None, get("fromRefs"), get("toRefs")))
    return rows


def inline_rows(files: DataFrame, doc: str = "path", content: str = "content") -> DataFrame:
    """Flat rows of every document; one that can't be read gives one row of kind error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in FACT_SCHEMA.split(", ")]
        for frame in frames:
            for d, c in zip(frame[doc], frame[content]):
                out = pd.DataFrame(_parsed(d, c), columns=names)
                yield out.astype({"scale": "Int64"})

    return files.select(F.col(doc), F.col(content)).mapInPandas(run, FACT_SCHEMA)


def facts(rows: DataFrame) -> DataFrame:
    """(doc, ddate, identifier, name, value, text): facts in contexts that name an identifier."""
    contexts = rows.filter("kind = 'context' AND name IS NOT NULL").select("doc", F.col("id").alias("context"), F.col("name").alias("identifier"), F.to_date("text").alias("ddate"))
    f = rows.filter("kind IN ('number', 'text')").join(contexts, ["doc", "context"])
    comma = F.coalesce(F.col("format"), F.lit("")).rlike("(?i)num-?comma")
    value = F.when(comma, document_number(F.col("text"), F.col("scale"), F.col("sign"), True)).otherwise(document_number(F.col("text"), F.col("scale"), F.col("sign")))
    return f.select("doc", "ddate", "identifier", "name", F.when(F.col("kind") == "number", value).alias("value"), F.when(F.col("kind") == "text", F.col("text")).alias("text"))


def footnotes(rows: DataFrame) -> DataFrame:
    """(doc, ddate, identifier, footnote), distinct: every from-reference tied to every to-reference."""
    rel = rows.filter("kind = 'relationship'").select("doc", F.explode(F.split("refs", " ")).alias("from"), "to_refs").select("doc", "from", F.explode(F.split("to_refs", " ")).alias("to"))
    notes = rows.filter("kind = 'footnote'").select("doc", F.col("id").alias("to"), F.col("text").alias("footnote"))
    tied = rows.filter("kind IN ('number', 'text')").select("doc", F.col("id").alias("from"), "context")
    contexts = rows.filter("kind = 'context' AND name IS NOT NULL").select("doc", F.col("id").alias("context"), F.col("name").alias("identifier"), F.to_date("text").alias("ddate"))
    return rel.join(notes, ["doc", "to"]).join(tied, ["doc", "from"]).join(contexts, ["doc", "context"]).select("doc", "ddate", "identifier", "footnote").distinct()


def page_text(pages: DataFrame, key: str = "page_id", markup: str = "html") -> DataFrame:
    """(key, title, n_links, n_paragraphs, text): what a page says, without scripts, styles and tags."""
    body = F.regexp_replace(markup, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " ")
    plain = F.regexp_replace(F.regexp_replace(body, r"(?s)<[^>]*>", " "), r"\s+", " ")
    for entity, char in ENTITIES.items():
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    count = lambda p: F.size(F.regexp_extract_all(body, F.lit(p), F.lit(0))).cast("bigint")
    return pages.select(key, F.regexp_extract(markup, r"(?is)<title>(.*?)</title>", 1).alias("title"), count(r"<a\s[^>]*href=").alias("n_links"), count(r"<p[\s>]").alias("n_paragraphs"), F.trim(plain).alias("text"))
