"""Articles out of HTML as DataFrame expressions: tags and texts as tokens, folded with the stack of open elements.

The text of a page becomes an array of tokens (one regular expression), each a
struct of its kind, and one ``aggregate`` over them keeps the open elements, so
that what stands inside of an element that holds no article text is left out
however elements nest and wherever they aren't closed. The same fold in SQL is
the oracle of the queries.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge.functions import fixed_values as fixed

# Elements without an end tag; least length of a paragraph; character references that are read, that of ``&`` last.
VOID = tuple("area base br col embed hr img input link meta source track wbr".split())
PARAGRAPH = 30
REFERENCES = (
    ("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&apos;", "'"), ("&#39;?", "'"), ("&#x27;?", "'"), ("&nbsp;?", " "), ("&copy;?", "©"), ("&reg;?", "®"), ("&middot;?", "·"),
    ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&laquo;?", "«"), ("&raquo;?", "»"), ("&euro;", "€"), ("&amp;?", "&"),
)
#: Comments, elements whose content isn't markup, tags, texts.
TOKEN = r"""(?is)<!--.*?(?:-->|\z)|<script\b[^>]*>.*?(?:</script\s*>|\z)|<style\b[^>]*>.*?(?:</style\s*>|\z)|</?[a-z](?:"[^"]*"|'[^']*'|[^>"'])*(?:>|\z)|<[!?/][^>]*(?:>|\z)|[^<]+|<"""
_NOISE = r"(?i)\b(?:" + "|".join(fixed.NOISE_WORDS) + r")\b"


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of a start tag, without quotes; empty where there is none."""
    return F.regexp_replace(F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", 1), r"""^["']|["']$""", "")


def plain(text: Column) -> Column:
    """Text without character references, and with single spaces."""
    for reference, character in REFERENCES:
        text = F.regexp_replace(text, reference, character)
    return F.btrim(F.regexp_replace(text, r"[\s ]+", " "))


def _token(t: Column) -> Column:
    name = F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][^\s/>]*)", 1))
    whole = t.rlike(r"(?is)^<(?:script|style)\b") | t.rlike(r"^<[!?]") | t.rlike(r"^</[^a-zA-Z]")
    kind = F.when(whole, "skip").when(t.startswith("</"), "close").when(t.rlike("^<[a-zA-Z]"), F.when(name.isin(*VOID) | t.rlike(r"/>$"), "void").otherwise("open")).otherwise("text")
    noise = name.isin(*fixed.NOISE_TAGS) | F.concat_ws(" ", attribute(t, "class"), attribute(t, "id")).rlike(_NOISE)
    return F.struct(kind.alias("kind"), name.alias("name"), F.when(kind == "open", noise).otherwise(F.lit(False)).alias("noise"), F.when(kind == "text", plain(t)).otherwise("").alias("text"), t.alias("tag"))


def tokens(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TOKEN), F.lit(0)), _token)


#: The fold: ``open`` are the open elements (``!`` before those without article text), ``texts`` the paragraphs, ``heading`` the text of headings.
_FOLD = """aggregate({tokens}, named_struct('open', cast(array() as array<string>), 'texts', cast(array() as array<string>), 'heading', ''), (s, t) ->
  case
    when t.kind = 'open' then element_at(transform(array(concat(case when t.name = 'p' and {has_p} then {cut_p} else s.open end, array(concat(case when t.noise then '!' else '' end, t.name)))), o ->
      named_struct('open', o, 'texts', case when t.name = 'p' and not exists(o, x -> startswith(x, '!')) then concat(s.texts, array('')) else s.texts end, 'heading', s.heading)), 1)
    when t.kind = 'close' and {has} then named_struct('open', {cut}, 'texts', s.texts, 'heading', s.heading)
    when t.kind = 'text' and t.text <> '' and not exists(s.open, x -> startswith(x, '!')) then named_struct('open', s.open,
      'texts', case when size(s.texts) > 0 and {has_p} then concat(slice(s.texts, 1, size(s.texts) - 1), array(ltrim(concat(element_at(s.texts, -1), ' ', t.text)))) else s.texts end,
      'heading', case when array_contains(s.open, 'h1') then ltrim(concat(s.heading, ' ', t.text)) else s.heading end)
    else s end)"""
_HAS = "(array_contains(s.open, {n}) or array_contains(s.open, concat('!', {n})))"
_CUT = "slice(s.open, 1, size(s.open) - cast(array_position(reverse(transform(s.open, x -> ltrim('!', x))), {n}) as int))"


def folded(tokens: str) -> Column:
    """(open, texts, heading) of the column of tokens that is named."""
    return F.expr(_FOLD.format(tokens=tokens, has_p=_HAS.format(n="'p'"), cut_p=_CUT.format(n="'p'"), has=_HAS.format(n="t.name"), cut=_CUT.format(n="t.name")))


def valid(paragraph: Column) -> Column:
    low = "|".join(re.escape(w) for w in fixed.FOOTER_WORDS)
    return (F.length(paragraph) >= PARAGRAPH) & ~paragraph.rlike(r"^(?:https?://|www\.)") & ~paragraph.rlike(r"^\[.+\]$") & ~F.lower(paragraph).rlike(low)


def meta(tokens: Column, *names: str) -> Column:
    """The content of the first meta element of the first of ``names`` that has any, or null."""
    metas = F.filter(tokens, lambda t: t["name"] == "meta")
    keyed = lambda t: F.coalesce(*[F.nullif(attribute(t["tag"], a), F.lit("")) for a in ("property", "name", "itemprop")])
    first = lambda name: F.get(F.filter(metas, lambda t: keyed(t) == name), F.lit(0))["tag"]
    return F.coalesce(*[F.nullif(plain(attribute(first(n), "content")), F.lit("")) for n in names])


def summary_of(tokens: Column) -> Column:
    """The text right after the first element of a class that holds a summary, or null."""
    at = F.array_position(F.transform(tokens, lambda t: (t["kind"] == "open") & F.concat(F.lit(" "), attribute(t["tag"], "class"), F.lit(" ")).rlike(" (?:story__summary|sapo) ")), F.lit(True)).cast("int")
    return F.when(at > 0, F.nullif(F.get(tokens, at)["text"], F.lit("")))  # ``get`` counts from 0: the token after


def article(html: str) -> list[Column]:
    """Columns of the article in the page whose column is named: two steps, since tokens are used several times."""
    t, f = F.col("_tokens"), F.col("_folded")
    texts = F.filter(f["texts"], valid)
    moment = F.nullif(attribute(F.get(F.filter(t, lambda x: x["name"] == "time"), F.lit(0))["tag"], "datetime"), F.lit(""))
    return [
        F.coalesce(meta(t, "og:title"), F.nullif(f["heading"], F.lit(""))).alias("title"), F.coalesce(meta(t, "og:description", "description"), summary_of(t)).alias("summary"), meta(t, "og:image").alias("image_url"),
        F.coalesce(meta(t, "article:published_time", "pubdate", "datePublished", "date"), moment).alias("published"), F.array_join(texts, "\n").alias("content"), F.size(texts).alias("paragraphs"),
    ]


def articles(pages, html: str = "html"):
    """``pages`` with the article of each: title (og:title, else h1; null: no article), summary, image_url, published, content, paragraphs."""
    kept = pages.columns
    # written out twice, a column of tokens would be made anew for each use: two projections that a generator parts
    rows = pages.withColumn("_tokens", F.explode(F.array(tokens(F.col(html))))).withColumn("_folded", F.explode(F.array(folded("_tokens"))))
    return rows.select(*kept, *article(html))
