"""Lexicon scores, company tags, article text out of HTML, and label and URL helpers."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegauge.functions import automaton
from tidegauge.functions import fixed_values as fixed
from tidegauge.functions.dates import parse_datetime

# Characters before a phrase in which a negation turns it; characters around a ticker in which a trap is looked for; least length of a paragraph.
NEGATION_REACH, TRAP_REACH, PARAGRAPH = 18, 20, 30
# Weight of the lexicon, steepness, and half-width of the neutral class.
ALPHA, STEEPNESS, NEUTRAL = 0.6, 0.8, 0.1


def lexicon(positive=fixed.POSITIVE, negative=fixed.NEGATIVE, negation=fixed.NEGATION):
    """A vectorised function: text -> struct(pos, neg, net) of phrase counts; a negation just before a phrase turns it.

    A negation counts if it begins at most NEGATION_REACH characters before the phrase and ends before it.
    """
    sides = [automaton.prepared(p) for p in (positive, negative)]
    turns = automaton.prepared(negation)
    hits = lambda text, blocks: [h for b in blocks for h in automaton.occurrences(text, b)]

    def count(text: str | None) -> tuple[int, int]:
        found, text = [0, 0], text or ""
        turning = hits(text, turns)
        for side, blocks in enumerate(sides):
            for start, _, _ in automaton.leftmost_longest(hits(text, blocks)):
                turned = any(start - NEGATION_REACH <= a and b <= start for a, b, _ in turning)
                found[side ^ turned] += 1
        return found[0], found[1]

    @F.pandas_udf("pos int, neg int, net int")
    def score(texts: pd.Series) -> pd.DataFrame:
        rows = pd.DataFrame([count(t) for t in texts], columns=["pos", "neg"], dtype="int32")
        rows["net"] = rows["pos"] - rows["neg"]
        return rows

    return score


def tagger(companies: dict[str, tuple] = fixed.COMPANIES, traps: dict[str, tuple] = fixed.TICKER_TRAPS):
    """A vectorised function: text -> sorted tickers whose code (in capitals) or company name stands in it."""
    codes = automaton.prepared(companies, ignore_case=False)
    owner = {automaton.folded(name.strip()): code for code, (names, _) in reversed(list(companies.items())) for name in names}
    names = automaton.prepared(owner)

    def tags(text: str | None) -> list[str]:
        found, text = set(), text or ""
        for start, stop, code in (h for b in codes for h in automaton.occurrences(text, b, ignore_case=False, ascii_words=True)):
            near = text[max(0, start - TRAP_REACH) : stop + TRAP_REACH].upper()
            if not any(t in near for t in traps.get(code, ())):
                found.add(code)
        for _, _, name in automaton.leftmost_longest([h for b in names for h in automaton.occurrences(text, b)]):
            found.add(owner[name])
        return sorted(found)

    @F.pandas_udf("array<string>")
    def tag(texts: pd.Series) -> pd.Series:
        return texts.map(tags)

    return tag


def hybrid(model: Column, net: Column, alpha: float = ALPHA, k: float = STEEPNESS) -> Column:
    """Linear fusion of a model's score and the squashed lexicon net."""
    return F.lit(1 - alpha) * model + F.lit(alpha) * F.tanh(F.lit(k) * net)


def polarity(score: Column) -> Column:
    return F.when(score > 0, "positive").otherwise("negative")


def three_classes(score: Column, tau: float = NEUTRAL) -> Column:
    return F.when(score > tau, "positive").when(score < -tau, "negative").otherwise("neutral")


def label_of(raw: Column) -> Column:
    """negative, positive or neutral by the parts of a label's name, or null."""
    text, out = F.lower(raw), None
    for label, parts in fixed.LABEL_PARTS.items():
        has = text.rlike("|".join(parts))
        out = F.when(has, label) if out is None else out.when(has, label)
    return out


# Fixed value: how a question names a symbol.
QUESTION_SYMBOL = r"\b([A-Z]{2,4})\b"

# Consistency and confidence of votes that are fit for training, and consistency of those to be used with care.
HIGH, MEDIUM = (0.8, 0.6), 0.6


def question_symbol(question: Column) -> Column:
    """The first symbol that a question names, or null. Letters, digits and underscores are word characters, as in ASCII."""
    return F.nullif(F.regexp_extract(question, QUESTION_SYMBOL.replace(r"\b", "(?<![A-Za-z0-9_])", 1).replace(r"\b", "(?![A-Za-z0-9_])"), 1), F.lit(""))


def route(url: Column, routes, other: str) -> Column:
    """The first of ``routes`` (part of a host, name) whose part stands in the URL's host: not in its path or query."""
    place = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z]+://([^/?#]*)", 1)), "^[w.]+", "")
    out = None
    for part, name in routes:
        out = F.when(place.contains(part), name) if out is None else out.when(place.contains(part), name)
    return out.otherwise(other)


def sentences(content: Column) -> Column:
    """The sentences of a text, without blank ones."""
    parts = F.transform(F.split(F.coalesce(content, F.lit("")), r"[.!?\n]+"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def snippet(parts: Column, hit: Column, tokens: int) -> Column:
    """The sentences that are hit and their neighbours in a row, else the first one; at most ``tokens`` tokens of it."""
    near = lambda i: F.get(hit, i) | F.coalesce(F.get(hit, i + 1), F.lit(False)) | F.when(i > 0, F.get(hit, i - 1)).otherwise(False)
    whole = F.when(F.array_contains(hit, True), F.array_join(F.filter(parts, lambda x, i: near(i)), " ")).otherwise(F.coalesce(F.get(parts, F.lit(0)), F.lit("")))
    return F.array_join(F.slice(F.split(whole, " "), 1, tokens), " ")


def slug(url: Column) -> Column:
    """The last part of a URL that ends in .html, without that, else the whole URL; in lower case."""
    part = F.regexp_extract(url, r"/([^/]+?)\.html$", 1)
    return F.lower(F.when(part != "", part).otherwise(url))


def relevant_slug(slug: Column, tokens, brands) -> Column:
    """Whether one of a slug's parts between hyphens is one of ``tokens``, or one of ``brands`` stands in it."""
    hit = F.arrays_overlap(F.split(slug, "-"), F.array(*[F.lit(t) for t in tokens]))
    for b in brands:
        hit = hit | slug.contains(b)
    return hit


def weak_sector(content: Column, sectors: dict[str, str], least: int = 2) -> Column:
    """The one sector of the codes that stand in a text as words, and ``least`` times in all; null where there are none or several."""
    found = []
    for code, sector in sectors.items():
        word = content.rlike(rf"(?<![A-Za-z0-9_]){re.escape(code)}(?![A-Za-z0-9_])")
        found.append(F.when(word & (F.regexp_count(content, F.lit(re.escape(code))) >= least), sector))
    kinds = F.array_distinct(F.array_compact(F.array(*found)))
    return F.when(F.size(kinds) == 1, F.get(kinds, F.lit(0)))


def distribution(label: Column, confidence: Column) -> list[Column]:
    """A label (0 negative, 1 neutral, 2 positive; null: neutral) and its confidence (null: a half) as probabilities and a signed score."""
    label, c = F.coalesce(label, F.lit(1)), F.coalesce(confidence, F.lit(0.5))
    named = [F.round(F.when(label == k, c).otherwise((1 - c) / 2), 4).alias(f"prob_{n}") for k, n in enumerate(("negative", "neutral", "positive"))]
    return [*named, F.round(c * (label - 1), 4).alias("sentiment_score")]


_NOISE_NAME = re.compile(r"\b(?:" + "|".join(fixed.NOISE_WORDS) + r")\b", re.IGNORECASE)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Article(HTMLParser):
    """Title, meta values and paragraphs outside of noise elements."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool]] = []
        self.meta: dict[str, str] = {}
        self.paragraphs: list[list[str]] = []
        self.heading: list[str] = []
        self.times: list[str] = []
        self.dated: dict[str, list[str]] = {}
        self.marks: list[list[str]] = []

    def _noisy(self) -> bool:
        return any(noise for _, noise in self.open)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        values = {k: v or "" for k, v in attrs}
        if tag == "meta":
            self.meta.setdefault(values.get("property") or values.get("name") or values.get("itemprop") or "", values.get("content", ""))
        if tag == "time":
            self.times.append(values.get("datetime", ""))
        # the first element of each class, and the first <time> without a moment, give their whole text
        marks = [c for c in values.get("class", "").split() if c in fixed.DATE_CLASSES and c not in self.dated]
        if tag == "time" and len(self.times) == 1 and not self.times[0]:
            marks.append("<time>")
        if tag in _VOID:
            return
        if tag == "p" and any(t == "p" for t, _ in self.open):
            self.handle_endtag("p")  # a paragraph ends where the next one begins
        noise = tag in fixed.NOISE_TAGS or bool(_NOISE_NAME.search(f"{values.get('class', '')} {values.get('id', '')}"))
        self.open.append((tag, noise))
        self.marks.append(marks)
        self.dated.update({c: [] for c in marks})
        if tag == "p" and not self._noisy():
            self.paragraphs.append([])

    def handle_endtag(self, tag: str) -> None:
        if any(t == tag for t, _ in self.open):
            while self.open.pop()[0] != tag:
                self.marks.pop()
            self.marks.pop()

    def handle_data(self, data: str) -> None:
        text = " ".join(data.split())
        for c in {c for marks in self.marks for c in marks} if text else ():
            self.dated[c].append(text)
        if not text or self._noisy():
            return
        if any(t == "h1" for t, _ in self.open):
            self.heading.append(text)
        if self.paragraphs and any(t == "p" for t, _ in self.open):
            self.paragraphs[-1].append(text)


def valid_paragraph(text: str) -> bool:
    low = text.lower()
    return len(text) >= PARAGRAPH and not text.startswith(("http://", "https://", "www.")) and not re.fullmatch(r"\[.+\]", text) and not any(w in low for w in fixed.FOOTER_WORDS)


def _articles(pages: pd.Series) -> pd.DataFrame:
    rows = []
    for html in pages:
        parser = _Article()
        parser.feed(html or "")
        parser.close()
        texts = [t for t in (" ".join(p) for p in parser.paragraphs) if valid_paragraph(t)]
        meta = lambda *names: next((parser.meta[n].strip() for n in names if parser.meta.get(n, "").strip()), None)  # noqa: E731, B023
        rows.append((
            meta("og:title") or " ".join(parser.heading) or None, meta("og:description", "description"), meta("og:image"),
            meta("article:published_time", "pubdate", "datePublished", "date") or next(filter(None, parser.times), None), "\n".join(texts), len(texts),
        ))
    return pd.DataFrame(rows, columns=["title", "summary", "image_url", "published", "content", "paragraphs"])


def _date_texts(pages: pd.Series) -> pd.Series:
    out = []
    for html in pages:
        parser = _Article()
        parser.feed(html or "")
        parser.close()
        first_time = next(iter(parser.times), "") or "".join(parser.dated.get("<time>", []))
        found = [*[parser.meta.get(n, "") for n in fixed.DATE_METAS], first_time, *["".join(parser.dated.get(c, [])) for c in fixed.DATE_CLASSES]]
        out.append([t for t in found if t])
    return pd.Series(out)


def published_date(html: Column) -> Column:
    """The date of a page: of the places where pages state one, in order, the first that parses; null if none does."""
    texts = F.pandas_udf(_date_texts, "array<string>")(html)
    return F.get(F.filter(F.transform(texts, lambda t: F.to_date(parse_datetime(t))), lambda d: d.isNotNull()), F.lit(0))


def article(html: Column) -> Column:
    """The article in a page: meta values first, then elements; a page without a title has a null title."""
    return F.pandas_udf(_articles, "title string, summary string, image_url string, published string, content string, paragraphs int")(html)


def paragraphs(html: Column) -> Column:
    """Native approximation of the article text: valid paragraphs of the page without its noise elements."""
    noise = "|".join(fixed.NOISE_TAGS)
    bare = F.regexp_replace(html, rf"(?is)<({noise})\b[^>]*>.*?</({noise})>|<!--.*?-->", " ")
    found = F.transform(F.regexp_extract_all(bare, F.lit(r"(?is)<p[^>]*>(.*?)</p>"), F.lit(1)), lambda p: F.trim(F.regexp_replace(F.regexp_replace(p, r"<[^>]*>", " "), r"\s+", " ")))
    low = "|".join(re.escape(w) for w in fixed.FOOTER_WORDS)
    return F.filter(found, lambda p: (F.length(p) >= PARAGRAPH) & ~p.rlike(r"^(https?://|www\.)") & ~p.rlike(r"^\[.+\]$") & ~F.lower(p).rlike(low))
