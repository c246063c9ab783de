"""Documents and chat: chunks, text of pages, facts and titles."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.markup import markdown
from ..functions.rules import java_pattern

_SENTENCE = re.compile(r"[^.!?]+[.!?]+")


def chunks(text: str | None, most: int = 8000) -> list[str]:
    """Paragraphs packed up to `most` characters; a longer one by its sentences, whose unended rest is lost unless it is all there is."""
    out: list[str] = []
    have = ""

    def add(piece: str, after: str) -> None:
        nonlocal have
        if have and len(have) + len(piece) > most:
            out.append(have.strip())
            have = ""
        have += piece + after

    for paragraph in re.split(r"\n\n+", text or ""):
        if len(paragraph) <= most:
            add(paragraph, "\n\n")
            continue
        if have.strip():
            out.append(have.strip())
            have = ""
        for sentence in _SENTENCE.findall(paragraph) or [paragraph]:
            add(sentence, " ")
    if have.strip():
        out.append(have.strip())
    return out


def chunk_text(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most: int = 8000) -> DataFrame:
    """id, chunk (from 0) and text of each chunk."""

    @F.pandas_udf("array<string>")
    def cut(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.map(lambda x: chunks(x, most))

    return docs.select(F.col(id_col), F.posexplode(cut(F.col(text_col).cast("string"))).alias("chunk", "text"))


def page_text(html: Column) -> Column:
    """Text of a page: without scripts, styles and comments; blocks on lines of their own; entities of the usual kind resolved."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<\s*(br|/p|/div|/li|/h[1-6]|/tr|/title)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(name), F.lit(char))
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t\r\f]+", " "), r" ?\n ?", "\n")
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|\s+\z", "")


#: Fixed value: pages of more bytes are not read.
MOST_PAGE_BYTES = 2 * 1024 * 1024


def page_markdown(pages: DataFrame, *, html_col: str = "html", most: int = MOST_PAGE_BYTES) -> DataFrame:
    """Pages with their markdown, or null and a problem: too large (bytes of UTF-8), or no text.

    Pages are read batch by batch where they lie; those that are too large don't reach Python.
    """

    @F.pandas_udf("string")
    def read(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield t.map(markdown, na_action="ignore")

    html = F.col(html_col).cast("string")
    small = F.octet_length(html) <= most
    df = pages.withColumn("markdown", read(F.when(small, html)))
    return df.withColumn("problem", F.when(~small, "too large").when(F.coalesce("markdown", F.lit("")) == "", "no text"))


def source_type(name: Column) -> Column:
    """By scheme or extension: url, pdf, docx, txt, or text itself."""
    n = F.lower(F.trim(name))
    return F.when(n.rlike("^https?://"), "url").when(n.endswith(".pdf"), "pdf").when(n.endswith(".docx"), "docx").when(n.rlike(r"\.(txt|md)\z"), "txt").otherwise("text")


def squeeze(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"\s+", " ")


def names_tenant(text: Column, tenant_name: Column) -> Column:
    """The tenant's full or first name stands in the text as a word, in any case; false without a name of two letters."""
    clean = squeeze(F.coalesce(tenant_name, F.lit("")))
    # Words of the text and of the name, each between spaces: letters, digits and _ are kept, other characters parted.
    parted = lambda c: F.concat(F.lit(" "), F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"([^\p{L}\p{N}_])", " $1 "), r"\s+", " ")), F.lit(" "))
    said = lambda name: (F.length(name) >= 2) & F.contains(parted(text), parted(name))
    return F.coalesce(said(clean) | said(F.split_part(clean, F.lit(" "), F.lit(1))), F.lit(False))


def accepts_fact(text: Column, *, tenant_name: Column | None = None, most: int = 320) -> Column:
    """A statement about the user: 12 to 320 characters, no greeting, not the assistant's voice, which wins over all, and
    the user is mentioned, or the tenant by name.
    """
    t = squeeze(text)
    ok = F.length(t).between(12, most) & ~t.rlike(java_pattern(P.GREETING, True)) & ~t.rlike(java_pattern(P.ASSISTANT_VOICE, True))
    anchor = t.rlike(java_pattern(P.USER_ANCHOR, True))
    return F.coalesce(ok & (anchor if tenant_name is None else anchor | names_tenant(t, tenant_name)), F.lit(False))


def chat_facts(turns: DataFrame, *, key: str, order: str, text_col: str = "text", title_col: str | None = None, tenant_name: Column | None = None, most: int = 5) -> DataFrame:
    """The first accepted facts of each conversation, equal ones (but for case) once, `most` of them: key, place, fact, title."""
    t = squeeze(F.col(text_col))
    raw = F.col(title_col) if title_col else F.lit(None).cast("string")
    rows = turns.where(accepts_fact(F.col(text_col), tenant_name=tenant_name)).select(F.col(key), F.col(order).alias("ord"), t.alias("fact"), raw.alias("raw"))
    first = rows.groupBy(key, F.lower("fact").alias("_same")).agg(F.min(F.struct("ord", "fact", "raw")).alias("m")).select(key, "m.ord", "m.fact", "m.raw")
    ranked = first.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("ord", "fact")))
    return ranked.where(F.col("place") <= most).select(key, "place", "fact", chat_title(F.col("raw"), F.col("fact")).alias("title"))


_EDGE = r"^[.,;:«»“”\"'()]+|[.,;:«»“”\"'()]+\z"


def _head(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 100_000))


def _bare_words(text: Column) -> Column:
    """Words without punctuation around them; those that were nothing else are left out."""
    return F.filter(F.transform(F.split(text, r"\s+"), lambda w: F.regexp_replace(w, _EDGE, "")), lambda w: w != "")


def chat_title(raw: Column, fact: Column) -> Column:
    """A provider's title without quotes, final marks and the opening about the user, of six words at most; else from the fact."""
    t = squeeze(F.coalesce(raw, F.lit("")))
    q = f"[{P.TITLE_QUOTES}]+"
    t = F.regexp_replace(F.regexp_replace(t, rf"^{q}\s*", ""), rf"\s*{q}\z", "")
    ended = lambda c: F.trim(F.regexp_replace(c, r"[.!?…;:]+\z", ""))
    t = ended(F.regexp_replace(ended(t), java_pattern(P.TITLE_LEAD, True), ""))
    long = F.size(F.split(t, r"\s+")) > P.TITLE_WORDS
    cut = F.array_join(_bare_words(F.array_join(F.slice(F.split(t, r"\s+"), 1, P.TITLE_WORDS), " ")), " ")
    return F.when(t == "", fallback_title(fact)).otherwise(_head(F.when(long, cut).otherwise(t)))


def fallback_title(fact: Column) -> Column:
    """Five words of the fact without its opening: no past marker, no anchor, no fillers; capitalized."""
    t = F.regexp_replace(squeeze(fact), r"[.!?…;]+\z", "")
    t = F.regexp_replace(t, java_pattern(P.TITLE_PAST, True), "")
    t = F.regexp_replace(t, java_pattern(P.TITLE_LEAD, True), "")
    for _ in range(3):
        t = F.regexp_replace(t, java_pattern(P.TITLE_FILLER, True), "")
    title = F.array_join(F.slice(_bare_words(t), 1, 5), " ")
    return _head(F.when(title != "", title).otherwise(F.array_join(F.slice(F.split(t, r"\s+"), 1, 5), " ")))


def merged_facts(results: DataFrame, *, key: str = "doc_id", order: str = "chunk") -> DataFrame:
    """Facts of all chunks of a document (facts array), each once, in the order of first appearance."""
    each = results.select(key, F.col(order).alias("o"), F.posexplode("facts").alias("p", "fact"))
    first = each.groupBy(key, "fact").agg(F.min(F.struct("o", "p")).alias("at"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "fact"))), lambda x: x["fact"]).alias("facts"))


def rating(raw: Column) -> Column:
    """relevance 1 to 5 (3 if anything else), kind and sensitive of a provider's answer, with defaults."""
    r = raw["relevance"]
    return F.struct(
        F.when((r >= 1) & (r <= 5) & (r == F.floor(r)), r.cast("int")).otherwise(F.lit(3)).alias("relevance"),
        F.when(raw["kind"] == "state", "state").otherwise("fact").alias("kind"),
        F.coalesce(raw["sensitive"].cast("boolean"), F.lit(False)).alias("sensitive"),
    )
