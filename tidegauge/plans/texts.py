"""Text queries: tags, lexicons, scores, pages, URLs, dates, snippets and term weights."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidegauge.functions import automaton, dates, fixed_values, markup, text
from tidegauge.operators import inference
from tidegauge.shared import shared_dir, written
from tidegauge.sources import files
from tidegauge.sources.adapters import MARKET, NEWS, news, spread, table

QUERIES: dict[str, tuple] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return register


#: Stand-ins for tickers and phrases in the driver's invented prose.
CODES = ("The", "And", "Of", "In", "To", "La", "Der")
GOOD, BAD = ("of the", "and the", "is the"), ("to the", "in the", "that the")


def _native(phrases) -> str:
    return r"(?<![A-Za-z0-9_])(" + "|".join(phrases) + r")(?![A-Za-z0-9_])"


def _re2(phrases) -> str:
    return r"\b(" + "|".join(phrases) + r")\b"


def _tags(n):
    found = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(_native(CODES)), F.lit(1))))
    return n.select("news_id", F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(MARKET)))).alias("symbol"))


_TAGS = rf"tags as (select news_id, unnest(case when len(t) > 0 then t else ['{MARKET}'] end) as symbol from (select news_id, list_distinct(regexp_extract_all(text, '{_re2(CODES)}', 1)) as t from news))"


@query(f"with {NEWS}, {_TAGS} select news_id, symbol from tags")
def tag_or_market(spark, sf_dir):
    return _tags(news(spark, sf_dir))


@query(f"with {NEWS}, {_TAGS} select symbol, count(*) as n, count(distinct news_id) as articles from tags group by symbol")
def news_entities_explode(spark, sf_dir):
    return _tags(news(spark, sf_dir)).groupBy("symbol").agg(F.count("*").alias("n"), F.count_distinct("news_id").alias("articles"))


_NET = rf"net as (select news_id, symbol, date, score, source, cast(len(regexp_extract_all(lower(text), '{_re2(GOOD)}')) as integer) as pos, cast(len(regexp_extract_all(lower(text), '{_re2(BAD)}')) as integer) as neg from news)"


def _net(n):
    low = F.lower("text")
    return spread(n.select("news_id", "symbol", "date", "score", "source", "text"), "news_id").select("news_id", "symbol", "date", "score", "source", F.regexp_count(low, F.lit(_native(GOOD))).alias("pos"), F.regexp_count(low, F.lit(_native(BAD))).alias("neg"))


@query(f"with {NEWS}, {_NET} select news_id, pos, neg, pos - neg as net from net")
def lexicon_net(spark, sf_dir):
    return _net(news(spark, sf_dir)).select("news_id", "pos", "neg", (F.col("pos") - F.col("neg")).alias("net"))


_HYBRID = f"{_NET}, h as (select *, 0.4::double * score + 0.6::double * tanh(0.8::double * (pos - neg)) as s from net)"


def _hybrid(n):
    return _net(n).withColumn("s", text.hybrid(F.col("score"), F.col("pos") - F.col("neg")))


@query(f"with {NEWS}, {_HYBRID} select news_id, round(s, 6) as score, case when s > 0 then 'positive' else 'negative' end as polarity, case when s > 0.1 then 'positive' when s < -0.1 then 'negative' else 'neutral' end as label_3cls from h")
def hybrid_score(spark, sf_dir):
    rows = _hybrid(news(spark, sf_dir))
    return rows.select("news_id", F.round("s", 6).alias("score"), text.polarity(F.col("s")).alias("polarity"), text.three_classes(F.col("s")).alias("label_3cls"))


@query(f"with {NEWS}, {_HYBRID} select source, count(*) filter (where s > 0.1) as positive, count(*) filter (where s < -0.1) as negative, count(*) filter (where abs(s) <= 0.1) as neutral from h group by source")
def polarity_counts(spark, sf_dir):
    s = F.col("s")
    return _hybrid(news(spark, sf_dir)).groupBy("source").agg(F.count_if(s > 0.1).alias("positive"), F.count_if(s < -0.1).alias("negative"), F.count_if(F.abs(s) <= 0.1).alias("neutral"))


@query(f"""with {NEWS}, {_HYBRID}, r as (select source, count(*) filter (where s > 0) / nullif(count(*), 0)::double as ratio from h group by source)
  select source, round(ratio, 6) as ratio, case when ratio is null then 'none' when ratio > 0.55 then 'positive' when ratio < 0.45 then 'negative' else 'balanced' end as mood from r""")
def sentiment_ratio(spark, sf_dir):
    r = _hybrid(news(spark, sf_dir)).groupBy("source").agg(F.try_divide(F.count_if(F.col("s") > 0).cast("double"), F.count("*")).alias("ratio"))
    mood = F.when(F.col("ratio").isNull(), "none").when(F.col("ratio") > 0.55, "positive").when(F.col("ratio") < 0.45, "negative").otherwise("balanced")
    return r.select("source", F.round("ratio", 6).alias("ratio"), mood.alias("mood"))


#: Words that turn the phrase after them, in the driver's prose.
TURNS = ("on", "er", "no")
_INSIDE = r"[\p{L}\p{N}_]"


def _phrase_sql(phrase: str) -> str:
    """Whole occurrences of a phrase in ``low``, as a list of whether each is turned: text is split at the phrase, and looked at on both sides."""
    pieces = f"string_split(low, '{phrase}')"
    before = f"array_to_string(p[greatest(1, i - 5):i], '{phrase}')"
    after = f"left(p[i + 1] || case when i + 1 < len(p) then '{phrase}' else '' end, 1)"
    turn = "(" + "|".join(TURNS) + ")"
    turned = f"case when length({before}) <= {text.NEGATION_REACH} then regexp_matches({before}, '(^|[^{_INSIDE[1:-1]}]){turn}([^{_INSIDE[1:-1]}]|$)') else regexp_matches(right({before}, {text.NEGATION_REACH + 1}), '[^{_INSIDE[1:-1]}]{turn}([^{_INSIDE[1:-1]}]|$)') end"
    whole = f"not regexp_matches(right({before}, 1), '{_INSIDE}') and not regexp_matches({after}, '{_INSIDE}')"
    return f"list_concat([]::boolean[], list_transform([{pieces}], lambda p: list_filter(list_transform(range(1, len(p)), lambda i: case when {whole} then {turned} end), lambda x: x is not null))[1])"


_SIDES = [" || ".join(_phrase_sql(p) for p in side) for side in (GOOD, BAD)]


@query(f"""with {NEWS}, x as (select news_id, {_SIDES[0]} as g, {_SIDES[1]} as b from (select news_id, lower(coalesce(text, '')) as low from news)),
  y as (select news_id, len(list_filter(g, lambda t: not t)) + len(list_filter(b, lambda t: t)) as pos, len(list_filter(b, lambda t: not t)) + len(list_filter(g, lambda t: t)) as neg from x)
  select news_id, cast(pos as integer) as pos, cast(neg as integer) as neg, cast(pos - neg as integer) as net from y""")
def lexicon_negated(spark, sf_dir):
    """Phrase counts with turning negations, by the exact function."""
    score = text.lexicon(GOOD, BAD, TURNS)
    return spread(news(spark, sf_dir).select("news_id", "text"), "news_id").select("news_id", score("text").alias("x")).select("news_id", "x.*")


#: What is said of companies in the driver's prose, by the article's number: codes, names in any case, traps, parts of words, nothing.
SAID = (
    "VIC", "shares of VCB, FPT and VNM", "Tập đoàn Vingroup", "vinamilk; PETROLIMEX", "VIC: a VICTORY", "VIC ................. VICTORY far off", "natural gas and GAS", "GAS from afar", "XVIC VICx VIC9 vic", "ACBBank",
    "Ngân hàng Quốc tế Việt Nam", "Vietcombanker", "HPG/Hòa Phát", "", "(SSI) TCB-TPB", "Công ty FPTé", "éVRE",
)
_EDGE = r"[^\p{L}\p{N}_]"


def _tagged_sql() -> str:
    """Per company: its names as words in any case, and its code between characters that aren't ASCII letters or digits, without a trap near by."""
    each = []
    for code, (names, _) in fixed_values.COMPANIES.items():
        named = [f"regexp_matches(t, '(?i)(^|{_EDGE}){re.escape(n)}({_EDGE}|$)')" for n in names]
        bad = fixed_values.TICKER_TRAPS.get(code, ())
        near = "".join(f" and not contains(upper(substr(t, greatest(1, p - {text.TRAP_REACH}), p - greatest(1, p - {text.TRAP_REACH}) + {len(code) + text.TRAP_REACH})), '{b}')" for b in bad)
        free = f"not regexp_matches(case when p > 1 then substr(t, p - 1, 1) else '' end, '[A-Za-z0-9]') and not regexp_matches(substr(t, p + {len(code)}, 1), '[A-Za-z0-9]')"
        places = f"list_filter(range(1, length(t)), lambda p: substr(t, p, {len(code)}) = '{code}' and {free}{near})"
        each.append(f"case when (contains(t, '{code}') and len({places}) > 0) or {' or '.join(named)} then '{code}' end")
    return f"list_filter([{', '.join(each)}], lambda x: x is not null)"


_SAID = "[" + ", ".join(f"'{x}'" for x in SAID) + "]"


@query(f"""with {NEWS}, x as (select news_id, right(coalesce(text, ''), 200) || ' -- ' || ({_SAID})[cast(news_id % {len(SAID)} + 1 as integer)] as t from news)
  select news_id, unnest(case when len(c) > 0 then c else ['{MARKET}'] end) as symbol from (select news_id, {_tagged_sql()} as c from x)""")
def company_tags(spark, sf_dir):
    """Tickers and company names of the built-in dictionary in the ends of articles, MARKET where there are none."""
    tag = text.tagger()
    said = F.element_at(F.array(*[F.lit(x) for x in SAID]), (F.col("news_id") % len(SAID) + 1).cast("int"))
    rows = news(spark, sf_dir).select("news_id", F.concat(F.right(F.coalesce("text", F.lit("")), F.lit(200)), F.lit(" -- "), said).alias("t")).select("news_id", tag("t").alias("t"))
    return rows.select("news_id", F.explode(F.when(F.size("t") > 0, F.col("t")).otherwise(F.array(F.lit(MARKET)))).alias("symbol"))


#: What is set into the heads and bodies of pages, by the page's number: meta values, summaries, dates in several forms, and what isn't text of the article.
HEADS = (
    '<meta property="og:title" content="Title &amp; more"><meta name="description" content="From a name">', '<meta content="Turned &quot;round&quot;" property="og:description">', "<meta property='og:image' content='https://i.example/x.png'>",
    '<meta property="article:published_time" content="2026-04-14T21:04:05">', '<meta itemprop="datePublished" content="14/04/2026 21:04"><meta name="pubdate" content="">', "",
)
BODIES = (
    '<div class="box related"><p>A text of thirty characters and more that is beside the article.</p></div>', '<p class="sapo">A summary of the page.</p><time datetime="2026-03-01">no</time>', "<header><p>Not in the article, though it is a long paragraph.</header>",
    '<p>Contact us: <b>Email: someone at example dot com</b> for more of it.</p>', '<section><p>One that is open <div id="share">never seen here</div> and goes on to be long enough</section>', '<time>01/02/2026</time><p>[all of it stands in brackets, so it does not count]</p>', "<p>https://only.a.link/of-some-length-that-is-over-thirty</p>",
)


def _dressed(pages):
    """Pages with more in their heads and bodies."""
    pick = lambda parts: F.element_at(F.array(*[F.lit(x) for x in parts]), (F.col("page_id") % len(parts) + 1).cast("int"))
    html = F.concat(F.replace("html", F.lit("</title>"), F.concat(F.lit("</title>"), pick(HEADS))), pick(BODIES))
    return pages.select("page_id", "url", html.alias("html"))


def _sql_list(parts) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in parts) + "]"


_ATTRIBUTE = r"""regexp_replace(regexp_extract({t}, '(?is)\s{n}\s*=\s*("[^"]*"|''[^'']*''|[^\s>"'']+)', 1), '^["'']|["'']$', '', 'g')"""


def _plain_sql(x: str) -> str:
    for reference, character in markup.REFERENCES:
        x = f"regexp_replace({x}, '{reference.replace(chr(39), chr(39) * 2)}', '{character.replace(chr(39), chr(39) * 2)}', 'g')"
    return f"trim(regexp_replace({x}, '[\\s ]+', ' ', 'g'))"


_SQL_TOKEN = markup.TOKEN.replace("'", "''")
_CLASSES = f"{_ATTRIBUTE.format(t='t', n='class')} || ' ' || {_ATTRIBUTE.format(t='t', n='id')}"
_KIND = f"case when regexp_matches(t, '(?is)^<(script|style)\\b') or regexp_matches(t, '^<[!?]') or regexp_matches(t, '^</[^a-zA-Z]') then 'skip' when t like '</%' then 'close' when regexp_matches(t, '^<[a-zA-Z]') then case when n in {markup.VOID} or t like '%/>' then 'void' else 'open' end else 'text' end"
_HAS, _CUT = "(list_contains(s.open, {n}) or list_contains(s.open, '!' || {n}))", "s.open[1:len(s.open) - list_position(list_reverse(list_transform(s.open, lambda x: ltrim(x, '!'))), {n})]"
_NEXT = "case when t.name = 'p' and " + _HAS.format(n="'p'") + " then " + _CUT.format(n="'p'") + " else s.open end || [case when t.noise then '!' else '' end || t.name]"
_QUIET = "len(list_filter({o}, lambda x: x like '!%')) = 0"
_STATE = "{{kind: '', name: '', noise: false, text: '', tag: '', open: {o}, texts: {x}, heading: {h}}}"
_PAGES = f"""dressed as (select page_id, url, replace(html, '</title>', '</title>' || ({_sql_list(HEADS)})[cast(page_id % {len(HEADS)} + 1 as integer)]) || ({_sql_list(BODIES)})[cast(page_id % {len(BODIES)} + 1 as integer)] as html from pages),
  cut as (select page_id, url, generate_subscripts(k, 1) as i, unnest(k) as t from (select *, regexp_extract_all(html, '{_SQL_TOKEN}') as k from dressed)),
  named as (select *, lower(regexp_extract(t, '^</?([a-zA-Z][^\\s/>]*)', 1)) as n from cut), kinds as (select *, {_KIND} as kind from named),
  tokens as (select page_id, any_value(url) as url, list({{kind: kind, name: n, noise: kind = 'open' and (n in {fixed_values.NOISE_TAGS} or regexp_matches({_CLASSES}, '(?i)\\b({"|".join(fixed_values.NOISE_WORDS)})\\b')), text: case when kind = 'text' then {_plain_sql("t")} else '' end, tag: t, open: []::varchar[], texts: []::varchar[], heading: ''}} order by i) as k from kinds group by page_id),
  folded as (select page_id, url, k, list_reduce(list_prepend({_STATE.format(o="[]::varchar[]", x="[]::varchar[]", h="''")}, k), lambda s, t: case
    when t.kind = 'open' then {_STATE.format(o=_NEXT, x="case when t.name = 'p' and " + _QUIET.format(o=f"({_NEXT})") + " then s.texts || [''] else s.texts end", h="s.heading")}
    when t.kind = 'close' and {_HAS.format(n="t.name")} then {_STATE.format(o=_CUT.format(n="t.name"), x="s.texts", h="s.heading")}
    when t.kind = 'text' and t.text <> '' and {_QUIET.format(o="s.open")} then {_STATE.format(o="s.open", x="case when len(s.texts) > 0 and " + _HAS.format(n="'p'") + " then s.texts[1:len(s.texts) - 1] || [ltrim(s.texts[len(s.texts)] || ' ' || t.text)] else s.texts end", h="case when list_contains(s.open, 'h1') then ltrim(s.heading || ' ' || t.text) else s.heading end")}
    else s end) as f from tokens)"""


def _meta_sql(*names: str) -> str:
    key = "coalesce(" + ", ".join(f"nullif({_ATTRIBUTE.format(t='x.tag', n=a)}, '')" for a in ("property", "name", "itemprop")) + ")"
    content = _plain_sql(_ATTRIBUTE.format(t="list_filter(k, lambda x: x.name = 'meta' and {key} = '{n}')[1].tag", n="content"))
    return ", ".join(f"nullif({content.replace('{key}', key).replace('{n}', n)}, '')" for n in names)


_TIME = _ATTRIBUTE.format(t="list_filter(k, lambda x: x.name = 'time')[1].tag", n="datetime")
_AFTER = f"list_position(list_transform(k, lambda x: x.kind = 'open' and regexp_matches(' ' || {_ATTRIBUTE.format(t='x.tag', n='class')} || ' ', ' (story__summary|sapo) ')), true)"
_VALID = f"length(x) >= {markup.PARAGRAPH} and not regexp_matches(x, '^(https?://|www\\.)') and not regexp_matches(x, '^\\[.+\\]$') and not regexp_matches(lower(x), '{'|'.join(fixed_values.FOOTER_WORDS)}')"


@query(f"""with {_PAGES} select page_id, url, coalesce({_meta_sql("og:title")}, nullif(f.heading, '')) as title, coalesce({_meta_sql("og:description", "description")}, nullif(k[{_AFTER} + 1].text, '')) as summary, coalesce({_meta_sql("og:image")}) as image_url,
  coalesce({_meta_sql("article:published_time", "pubdate", "datePublished", "date")}, nullif({_TIME}, '')) as published, array_to_string(list_filter(f.texts, lambda x: {_VALID}), chr(10)) as content, cast(len(list_filter(f.texts, lambda x: {_VALID})) as integer) as paragraphs from folded""")
def html_articles(spark, sf_dir):
    """Articles out of pages that have more in their heads and bodies, by a fold over their tags."""
    return markup.articles(_dressed(spread(table(spark, sf_dir, "pages"), "page_id"))).drop("html")


_FORMS = "['%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S', '%d/%m/%Y %H:%M', '%d/%m/%Y', '%Y-%m-%d']"


@query(f"""with {_PAGES}, d as (select page_id, list_concat([{_meta_sql(*fixed_values.DATE_METAS)}], [nullif({_TIME}, ''), nullif(k[list_position(list_transform(k, lambda x: x.name = 'time' and x.kind = 'open'), true) + 1].text, '')]) as texts from folded)
  select page_id, list_filter(list_transform(texts, lambda t: try_strptime(t, {_FORMS})::date), lambda t: t is not null)[1] as published_date from d""")
def html_dates(spark, sf_dir):
    """The dates that pages state, in meta values, moments and texts of elements."""
    return _dressed(spread(table(spark, sf_dir, "pages"), "page_id")).select("page_id", text.published_date(F.col("html")).alias("published_date"))


@query(r"select page_id, coalesce(nullif(regexp_extract(html, '(?is)<meta[^>]*property=\"og:title\"[^>]*content=\"([^\"]*)\"', 1), ''), nullif(trim(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)), ''), nullif(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '')) as title from pages")
def html_title(spark, sf_dir):
    found = lambda p: F.nullif(F.trim(F.regexp_extract("html", p, 1)), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(found(r'(?is)<meta[^>]*property="og:title"[^>]*content="([^"]*)"'), found(r"(?is)<h1[^>]*>(.*?)</h1>"), found(r"(?is)<title[^>]*>(.*?)</title>")).alias("title"))


_NOISE = "nav|header|footer|aside|script|style|noscript|iframe|form|button|select|figure"
_FOOTER = "©|bản quyền|tòa soạn|giấy phép|tổng biên tập|phó tổng biên tập|điện thoại:|email:|fax:|onecms|mastercms|issn"


@query(rf"""with b as (select page_id, regexp_replace(html, '(?is)<({_NOISE})\b[^>]*>.*?</({_NOISE})>|<!--.*?-->', ' ', 'g') as h from pages),
  p as (select page_id, list_transform(regexp_extract_all(h, '(?is)<p[^>]*>(.*?)</p>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) as ps from b),
  f as (select page_id, list_filter(ps, lambda x: length(x) >= 30 and not regexp_matches(x, '^(https?://|www\.)') and not regexp_matches(x, '^\[.+\]$') and not regexp_matches(lower(x), '{_FOOTER}')) as ps from p)
  select page_id, cast(len(ps) as integer) as paragraphs, coalesce(array_to_string(ps, chr(10)), '') as content from f""")
def html_valid_paragraphs(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", text.paragraphs(F.col("html")).alias("ps"))
    return rows.select("page_id", F.size("ps").alias("paragraphs"), F.array_join("ps", "\n").alias("content"))


#: Hosts and what reads their pages.
ROUTES = (("example.com", "com"), ("example.net", "net"))


@query(r"""with u as (select page_id, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^[w.]+', '') as place from pages)
  select page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) as host, case """ + " ".join(f"when contains(place, '{h}') then '{r}'" for h, r in ROUTES) + r""" else 'other' end as route, regexp_extract(url, '([0-9]+)(?:[?#].*)?$', 1) as trailing_id,
  case when url like 'http%' then url else 'https://example.org' || url end as absolute_url from u""")
def url_host(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(u, r"^[a-z]+://([^/?#:]+)", 1).alias("host"), text.route(u, ROUTES, "other").alias("route"), F.regexp_extract(u, r"([0-9]+)(?:[?#].*)?$", 1).alias("trailing_id"), F.when(u.startswith("http"), u).otherwise(F.concat(F.lit("https://example.org"), u)).alias("absolute_url"))


#: Tokens and parts of slugs that make an address relevant, in the driver's addresses.
TOKENS, BRANDS = ("en", "es"), ("example.net", "the")
_SLUG = r"lower(case when regexp_matches(u, '/([^/]+?)\.html$') then regexp_extract(u, '/([^/]+?)\.html$', 1) else u end)"


@query(rf"""with u as (select page_id, case when page_id % 3 = 0 then url else regexp_replace(url, '[?#].*$', '') || '-' || case when page_id % 4 = 0 then 'EN' when page_id % 4 = 1 then 'Then' else 'x' end || '-' || page_id || '.html' end as u from pages), s as (select page_id, {_SLUG} as slug from u)
  select page_id, slug, array_to_string(string_split(slug, '-'), ' ') as tokens, list_has_any(string_split(slug, '-'), {list(TOKENS)}) or {" or ".join(f"contains(slug, '{b}')" for b in BRANDS)} as relevant from s""")
def url_slug_tokens(spark, sf_dir):
    """The last part of an address that ends in .html (else all of it), its tokens, and whether one is a code or a brand stands in it."""
    n = F.col("page_id")
    word = F.when(n % 4 == 0, "EN").when(n % 4 == 1, "Then").otherwise("x")
    u = F.when(n % 3 == 0, F.col("url")).otherwise(F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("-"), word, F.lit("-"), n.cast("string"), F.lit(".html")))
    rows = table(spark, sf_dir, "pages").select("page_id", text.slug(u).alias("slug"))
    return rows.select("page_id", "slug", F.array_join(F.split("slug", "-"), " ").alias("tokens"), text.relevant_slug(F.col("slug"), TOKENS, BRANDS).alias("relevant"))


@query(r"select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) as href from pages")
def page_links(spark, sf_dir):
    """Links of pages, as a sitemap's locations are read."""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]+)"'), F.lit(1))).alias("href"))


#: Dates as pages write them, with what they mean.
DATES = (
    ("2026-04-14T21:04:00+07:00", "2026-04-14 21:04:00"), ("2026-04-14T21:04:05", "2026-04-14 21:04:05"), ("2026-04-14 21:04:05", "2026-04-14 21:04:05"), ("14/04/2026 21:04", "2026-04-14 21:04:00"),
    ("14/04/2026 - 21:04", "2026-04-14 21:04:00"), ("22:07 14/04/2026", "2026-04-14 22:07:00"), ("14/04/2026", "2026-04-14 00:00:00"), ("2026-04-14", "2026-04-14 00:00:00"), ("4/14/2026 5:02:01 PM", "2026-04-14 17:02:01"),
    ("4/14/2026 15:02:01", "2026-04-14 15:02:01"), ("- 14/04/2026 21:04", "2026-04-14 00:00:00"), ("14/04/2026 | 21:04", "2026-04-14 21:04:00"), ("on 2026-04-14, late", "2026-04-14 00:00:00"), ("junk", None), ("31/02/2026", None), ("", None),
)


@query("select * from (values " + ", ".join(f"('{a}', {f'timestamp {b!r}' if b else 'null'}, {f'date {b[:10]!r}' if b else 'null'})" for a, b in DATES) + ") v(raw, moment, day)")
def parse_datetime_formats(spark, sf_dir):
    rows = spark.createDataFrame([(a,) for a, _ in DATES], "raw string")
    return rows.select("raw", dates.parse_datetime(F.col("raw")).alias("moment")).withColumn("day", F.to_date("moment"))


@query("select event_id, case when m is null then '' when m < 0 then 'just now' when m < 60 then cast(m as varchar) || ' minutes' when m < 1440 then cast(m // 60 as varchar) || ' hours' else cast(m // 1440 as varchar) || ' days' end as age from (select event_id, cast(floor(date_diff('second', date_trunc('second', ts), timestamp '2024-01-16') / 60) as bigint) as m from events)")
def relative_age(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", dates.age(F.date_trunc("second", "ts"), F.lit("2024-01-16").cast("timestamp_ntz")).alias("age"))


#: Names that models give to their labels.
LABELS = (("NEG", "negative"), ("Positive", "positive"), ("tiêu cực", "negative"), ("tích cực", "positive"), ("neutral", "neutral"), ("trung tính", "neutral"), ("xau", "negative"), ("LABEL_1", None))


@query("select * from (values " + ", ".join(f"('{a}', {f'{b!r}' if b else 'null'})" for a, b in LABELS) + ") v(raw, label)")
def label_mapping(spark, sf_dir):
    return spark.createDataFrame([(a,) for a, _ in LABELS], "raw string").withColumn("label", text.label_of(F.col("raw")))


@query("""select doc_id, case when quality = 1 and toxic = 0 then 'positive' when toxic = 1 then 'negative' else 'neutral' end as label, round(case when quality = 1 and toxic = 0 then c + (1 - c) / 3 when toxic = 1 then 0 else 0 end, 6) as score_hint from
  (select doc_id, quality, toxic, 0.5 + (doc_id % 50) / 100.0::double as c from labels)""")
def gold_relabel(spark, sf_dir):
    c = F.lit(0.5) + (F.col("doc_id") % 50) / F.lit(100.0)
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return table(spark, sf_dir, "labels").select("doc_id", F.when(good, "positive").when(F.col("toxic") == 1, "negative").otherwise("neutral").alias("label"), F.round(F.when(good, c + (1 - c) / 3).otherwise(0.0), 6).alias("score_hint"))


@query("""with x as (select event_id, ['neg', 'neu', 'pos'] as names, [exp(least(value, 50) / 10), exp(1.0::double), exp((event_id % 7) / 2.0::double)] as e from events)
  select event_id, round(e[1] / list_sum(e), 6) as p_neg, round(e[2] / list_sum(e), 6) as p_neu, round(e[3] / list_sum(e), 6) as p_pos, names[list_position(e, list_max(e))] as label from x""")
def softmax_labels(spark, sf_dir):
    e = F.array(F.exp(F.least("value", F.lit(50)) / 10), F.exp(F.lit(1.0)), F.exp((F.col("event_id") % 7) / 2))
    rows = table(spark, sf_dir, "events").select("event_id", e.alias("e")).withColumn("t", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    names = F.array(F.lit("neg"), F.lit("neu"), F.lit("pos"))
    return rows.select("event_id", *[F.round(F.col("e")[i] / F.col("t"), 6).alias(f"p_{n}") for i, n in enumerate(("neg", "neu", "pos"))], F.element_at(names, F.array_position("e", F.array_max("e")).cast("int")).alias("label"))


_SENTENCES = "s as (select doc_id, generate_subscripts(t, 1) as place, unnest(t) as sentence from (select doc_id, list_filter(string_split_regex(text, '[.!?\\n]+'), lambda x: trim(x) <> '') as t from documents))"


@query(f"""with {_SENTENCES}, n as (select *, contains(sentence, 'tion') as hit, coalesce(contains(lag(sentence) over w, 'tion'), false) as before, coalesce(contains(lead(sentence) over w, 'tion'), false) as after from s window w as (partition by doc_id order by place))
  select doc_id, count(*) as sentences, count(*) filter (where hit) as hits, md5(string_agg(trim(sentence), '|' order by place)) as snippet_md5 from n where hit or before or after group by doc_id""")
def snippet_window(spark, sf_dir):
    """Sentences that hold an entity, with their neighbours; per document inside its own row."""
    parts = F.filter(F.split("text", r"[.!?\n]+"), lambda x: F.trim(x) != "")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(parts).alias("place", "sentence"))
    w = Window.partitionBy("doc_id").orderBy("place")
    hit = F.col("sentence").contains("tion")
    n = rows.withColumn("hit", hit).select("doc_id", "place", "sentence", "hit", F.coalesce(F.lag("hit").over(w), F.lit(False)).alias("b"), F.coalesce(F.lead("hit").over(w), F.lit(False)).alias("a"))
    kept = n.where("hit or a or b").groupBy("doc_id")
    ordered = F.array_sort(F.collect_list(F.struct("place", F.trim("sentence").alias("t"))))
    return kept.agg(F.count("*").alias("sentences"), F.count_if("hit").alias("hits"), F.md5(F.array_join(F.transform(ordered, lambda x: x["t"]), "|")).alias("snippet_md5"))


# Words of messages that say a rate limit was hit.
RATE_LIMITS = ("rate limit", "rate_limit", "giới hạn", "exceeded", "too many requests", "429", "tối đa", "wait to retry")


@query("select doc_id, " + " or ".join(f"contains(lower(coalesce(text, '')), '{w}')" for w in RATE_LIMITS) + " as limited from documents")
def rate_limit_errors(spark, sf_dir):
    """Which messages say that a rate limit was hit."""
    message = F.lower(F.coalesce("text", F.lit("")))
    hit = F.lit(False)
    for w in RATE_LIMITS:
        hit |= message.contains(w)
    return table(spark, sf_dir, "documents").select("doc_id", hit.alias("limited"))


@query(r"select conv_id, turn, nullif(regexp_extract(text, '\b([A-Z]{2,4})\b', 1), '') as symbol from conversations")
def question_symbol(spark, sf_dir):
    """The first word of two to four capitals and no more of a question, or null."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.question_symbol(F.col("text")).alias("symbol"))


@query("""with e as (select event_id, event_type, value from events), x as (select event_id, unnest([upper(substr(event_type, 1, 4)), substr(event_type, 1, 3), upper(event_type)]) as entity, unnest(['stock', 'stock', case when event_id % 2 = 0 then 'stock' else 'org' end]) as type, value from e)
  select event_id, entity, type = 'stock' and length(entity) <= 4 and entity = upper(entity) and entity <> lower(entity) as is_symbol from x""")
def entity_symbols(spark, sf_dir):
    """Entities out of a JSON list, each validated on its own; those of type stock, in capitals and of at most four letters, are symbols."""
    e = table(spark, sf_dir, "events").select("event_id", F.to_json(F.array(
        F.struct(F.upper(F.substring("event_type", 1, 4)).alias("entity"), F.lit("stock").alias("type")), F.struct(F.substring("event_type", 1, 3).alias("entity"), F.lit("stock").alias("type")),
        F.struct(F.upper("event_type").alias("entity"), F.when(F.col("event_id") % 2 == 0, "stock").otherwise("org").alias("type")))).alias("entities"))
    return valid_entities(e, "entities").select("event_id", "entity", "is_symbol")


_ENTITY_ROWS = """(select event_id, value, event_type, event_id % 3 as label, 0.34 + event_id % 66 / 100.0::double as confidence from events)"""


@query(f"""with x as (select event_id, round(confidence * (label - 1), 4) as score, unnest([upper(substr(event_type, 1, 4)), event_type, case when event_id % 2 = 0 then upper(substr(event_type, 1, 3)) end]) as entity, unnest(['stock', 'unknown', 'stock']) as type, unnest(['neutral', 'positive', 'negative']) as sentiment from {_ENTITY_ROWS})
  select event_id, entity, type, sentiment, case when type = 'stock' then entity end as symbol, case when type = 'stock' then 0.8::double end as relevance, case when type = 'stock' then score end as sentiment_score from x where entity is not null""")
def entity_rows(spark, sf_dir):
    """Entities with their defaults, and for those that are symbols how they are mapped to their article's score."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("event_id") % 3).alias("label"), (F.lit(0.34) + F.col("event_id") % 66 / 100).alias("confidence"))
    named = lambda **given: F.to_json(F.struct(*[v.alias(k) for k, v in given.items()]))
    parts = F.array(
        named(entity=F.concat(F.lit("  "), F.upper(F.substring("event_type", 1, 4))), type=F.lit("stock")), named(entity=F.col("event_type"), sentiment=F.lit("positive")), F.lit('"not an object"'), named(entity=F.lit("  ")), F.lit("7"),
        F.when(F.col("event_id") % 2 == 0, named(entity=F.upper(F.substring("event_type", 1, 3)), type=F.lit("stock"), sentiment=F.lit("negative"))).otherwise("null"))
    rows = e.select("event_id", *text.distribution(F.col("label"), F.col("confidence"))[3:], F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]")).alias("entities"))
    found = valid_entities(rows, "entities")
    mapped = lambda value: F.when(F.col("is_symbol"), value)
    return found.select("event_id", "entity", F.coalesce("type", F.lit("unknown")).alias("type"), F.coalesce("sentiment", F.lit("neutral")).alias("sentiment"), mapped(F.col("entity")).alias("symbol"), mapped(F.lit(0.8)).alias("relevance"), mapped(F.col("sentiment_score")).alias("sentiment_score"))


_SCORED = "(select doc_id, text, label from (select d.doc_id, d.text, case when quality = 1 then true when quality = 0 then false end as label from documents d left join labels using (doc_id)))"


@query(rf"""with d as (select doc_id, label, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]+') as w from {_SCORED}), u as (select label, unnest(list_distinct(w)) as word from d where label is not null),
  n as (select word, count(*) filter (where label)::double as g, count(*) filter (where not label)::double as b from u group by 1), v as (select word, ln((g + 1) / (b + 1)) as weight from n where g + b >= 2 order by g + b desc, word limit 50000),
  x as (select doc_id, unnest(w[1:256]) as word from d), s as (select doc_id, sum(coalesce(weight, 0)) / count(*) as m from x left join v using (word) group by 1)
  select doc_id, round(1 / (1 + exp(-coalesce(m, 0))), 6) as probability from d left join s using (doc_id)""")
def model_scores(spark, sf_dir):
    """Scores of whole texts by a saved model, loaded once by each worker, in batches of a fixed size."""
    path = shared_dir(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good"))
    inference.fitted(docs.join(good, "doc_id"), path)
    rows = spread(docs, "doc_id").select("doc_id", inference.scores(path)("text").alias("s"))
    return rows.select("doc_id", F.round("s.probability", 6).alias("probability"))


def valid_entities(rows, column: str):
    """``rows`` with a row per usable element of a JSON list of objects: (entity, type, sentiment, is_symbol). Others, and lists that can't be read, are left out."""
    found = rows.withColumn("_e", F.explode(F.from_json(column, "array<string>"))).withColumn("_e", F.from_json("_e", "struct<entity: string, type: string, sentiment: string>"))
    found = found.select(*[F.col(c) for c in rows.columns if c != column], F.btrim("_e.entity").alias("entity"), F.col("_e.type").alias("type"), F.col("_e.sentiment").alias("sentiment")).where("entity <> ''")
    name = F.col("entity")
    return found.withColumn("is_symbol", F.coalesce((F.col("type") == "stock") & (F.length(name) <= 4) & (name == F.upper(name)) & (name != F.lower(name)), F.lit(False)))


@query("select user_id, string_agg(event_type || '=' || n, ',' order by event_type) as counts from (select user_id, event_type, count(*) as n from events group by 1, 2) group by user_id")
def zipped_map(spark, sf_dir):
    """Two lists zipped into a map, looked up key by key."""
    n = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("event_type", "n")))
    lists = n.groupBy("user_id").agg(pairs.alias("p")).select("user_id", F.map_from_arrays("p.event_type", "p.n").alias("m"))
    listed = F.transform(F.array_sort(F.map_keys("m")), lambda k: F.concat(k, F.lit("="), F.element_at("m", k)))
    return lists.select("user_id", F.array_join(listed, ",").alias("counts"))


#: Sectors of the codes.
CODE_SECTORS = {"The": "articles", "La": "articles", "Der": "articles", "And": "links", "Of": "links", "In": "places", "To": "places"}
_SECTORS = ", ".join(f"case when regexp_matches(text, '{_re2([c])}') and (length(text) - length(replace(text, '{c}', ''))) / {len(c)} >= 2 then '{s}' end" for c, s in CODE_SECTORS.items())


@query(f"with {NEWS}, c as (select news_id, list_distinct([{_SECTORS}]) as s from news) select news_id, case when len(s) = 1 then s[1] end as sector from c")
def weak_sector_label(spark, sf_dir):
    """The sector of an article whose codes that are named as words, and stand in it twice at least, are of one sector; else null."""
    return news(spark, sf_dir).select("news_id", text.weak_sector(F.col("text"), CODE_SECTORS).alias("sector"))


# Documents that a term must stand in, the greatest share of documents, terms of the vocabulary, terms reported.
LEAST_DOCS, MOST_DOCS, VOCABULARY, REPORTED = 5, 0.5, 20000, 50


@query(f"""with c as (select doc_id, text, list_distinct([{_SECTORS}]) as s from documents), d as (select doc_id, s[1] as source, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') as w from c where text is not null and len(s) = 1),
  g as (select doc_id, source, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) as term from d), n as (select count(*) as docs from d), size as (select source, count(*) as sd from d group by 1),
  v as (select term, count(distinct doc_id) as df, count(*) as c from g group by term), vocabulary as (select term, ln((1 + docs) / (1.0::double + df)) + 1 as idf from v, n where df >= {LEAST_DOCS} and df <= {MOST_DOCS} * docs order by c desc, term limit {VOCABULARY}),
  t as (select doc_id, source, term, count(*) * any_value(idf) as x from g join vocabulary using (term) group by 1, 2, 3), norm as (select doc_id, sqrt(sum(x * x)) as len from t group by 1),
  s as (select source, term, sum(x / len) as total from t join norm using (doc_id) group by 1, 2), a as (select term, sum(total) / any_value(docs) as whole from s, n group by term),
  r as (select source, term, round(total / sd - whole, 6) as weight from s join a using (term) join size using (source) where not regexp_matches(term, '[0-9]') and not list_has_any(string_split(term, ' '), {[c.lower() for c in CODE_SECTORS]}))
  select source as sector, term, weight from (select *, row_number() over (partition by source order by weight desc, term) as rn from r) where rn <= {REPORTED}""")
def tfidf_top_terms(spark, sf_dir):
    """The words and pairs of words that set a weakly labelled sector apart: its mean TF-IDF (unit vectors) less that of all labelled articles; terms with digits, or with a code, are left out."""
    w = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))

    def terms(w):
        pairs = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.element_at(w, i), F.element_at(w, i + 1)))
        return F.when(F.size(w) > 1, F.concat(w, pairs)).otherwise(w)

    # a lambda's variable binds the words once: as a column they would be found anew for every pair
    texts = spread(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text"), "doc_id").withColumn("source", text.weak_sector(F.col("text"), CODE_SECTORS)).where("source is not null")
    words = written(texts.select("doc_id", "source", w.alias("w")))  # texts are split into words once
    docs = words.select("doc_id", "source", F.element_at(F.transform(F.array("w"), terms), 1).alias("terms"))
    sizes = docs.groupBy("source").agg(F.count("*").alias("sd"))
    n = sizes.agg(F.sum("sd").alias("docs"))
    # occurrences and documents of a term in one combined aggregation
    marks = lambda w: F.concat(F.transform(F.array_distinct(w), lambda t: F.struct(t.alias("term"), F.lit(1).alias("d"), F.lit(0).alias("c"))), F.transform(w, lambda t: F.struct(t.alias("term"), F.lit(0).alias("d"), F.lit(1).alias("c"))))
    counted = docs.select(F.explode(F.element_at(F.transform(F.array("terms"), marks), 1)).alias("m")).groupBy("m.term").agg(F.sum("m.d").alias("df"), F.sum("m.c").alias("c")).join(F.broadcast(n))
    common = counted.where((F.col("df") >= LEAST_DOCS) & (F.col("df") <= MOST_DOCS * F.col("docs"))).orderBy(F.desc("c"), "term").limit(VOCABULARY)
    vocabulary = written(common.select("term", (F.ln((1 + F.col("docs")) / (1.0 + F.col("df"))) + 1).alias("idf")))
    x = docs.select("doc_id", "source", F.explode("terms").alias("term")).join(F.broadcast(vocabulary), "term")  # VOCABULARY rows at most
    x = x.groupBy("doc_id", "source", "term").agg((F.count("*") * F.first("idf")).alias("x"))
    norms = x.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len"))
    s = written(x.join(norms, "doc_id").groupBy("source", "term").agg(F.sum(F.col("x") / F.col("len")).alias("total")))
    whole = s.groupBy("term").agg(F.sum("total").alias("all"))
    r = s.join(whole, "term").join(sizes, "source").join(F.broadcast(n)).where(~F.col("term").rlike("[0-9]") & ~F.arrays_overlap(F.split("term", " "), F.array(*[F.lit(c.lower()) for c in CODE_SECTORS])))
    r = r.select("source", "term", F.round(F.col("total") / F.col("sd") - F.col("all") / F.col("docs"), 6).alias("weight"))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("weight"), "term"))
    return r.withColumn("rn", place).where(F.col("rn") <= REPORTED).select(F.col("source").alias("sector"), "term", "weight")


#: Tokens of a snippet at most.
SNIPPET = 400
_ENTITY = f"({list(CODES)})[cast(doc_id % {len(CODES)} + 1 as integer)]"


@query(rf"""with s as (select doc_id, text, {_ENTITY} as entity, list_filter(list_transform(string_split_regex(coalesce(text, ''), '[.!?\n]+'), lambda x: trim(x, ' ')), lambda x: x <> '') as p from documents),
  h as (select *, list_transform(p, lambda x: regexp_matches(x, '\b' || entity || '\b')) as hit from s),
  k as (select doc_id, entity, list_contains(hit, true) as named, case when list_contains(hit, true) then array_to_string(list_filter(p, lambda x, i: hit[i] or (i > 1 and hit[i - 1]) or coalesce(hit[i + 1], false)), ' ') else coalesce(p[1], '') end as t from h)
  select doc_id, entity, named, array_to_string(string_split(t, ' ')[1:{SNIPPET}], ' ') as snippet from k""")
def entity_snippets(spark, sf_dir):
    """The sentences of an article that name an entity, with their neighbours, up to 400 tokens; without any, its first sentence."""
    entity = F.element_at(F.array(*[F.lit(c) for c in CODES]), (F.col("doc_id") % len(CODES) + 1).cast("int"))
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", entity.alias("entity"), text.sentences(F.col("text")).alias("p"))
    rows = rows.withColumn("hit", F.transform("p", lambda x: F.regexp_like(x, F.concat(F.lit(r"(?<![A-Za-z0-9_])"), F.col("entity"), F.lit(r"(?![A-Za-z0-9_])")))))
    return rows.select("doc_id", "entity", F.array_contains("hit", True).alias("named"), text.snippet(F.col("p"), F.col("hit"), SNIPPET).alias("snippet"))


#: Words of the four categories, in the driver's prose.
CATEGORIES = {"negative": ("not", "against", "on"), "positive": ("with", "for"), "uncertain": ("may", "or", "if"), "litigious": ("by", "from")}


@query("select doc_id, " + ", ".join(f"cast(len(list_filter(w, lambda x: x in {v})) as integer) as {k}_count" for k, v in CATEGORIES.items()) + r", cast(len(w) as integer) as words from (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') as w from documents)")
def dictionary_counts(spark, sf_dir):
    """Counts of the categories of a dictionary that is read from its file."""
    path = shared_dir(spark)
    lines = [f"{name}:\n" + "\n".join(f"  - {w}" for w in words) + "\n" for name, words in CATEGORIES.items()]
    spark.createDataFrame([("".join(lines),)], "value string").write.text(path)
    terms = automaton.dictionary(files.read_term_lists(spark, path))
    owner = {w: name for name, words in terms.items() for w in words}
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", "text", automaton.matches(F.col("text"), list(owner)).alias("hits"))
    count = lambda words: F.size(F.filter("hits", lambda h: h["term"].isin(*words)))
    return rows.select("doc_id", *[count(words).alias(f"{name}_count") for name, words in terms.items()], F.coalesce(F.regexp_count(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+")), F.lit(0)).alias("words"))


_VOTES = "(select user_id as item, case when value < 30 then 'neutral' when value < 60 then 'positive' else 'negative' end as label, 0.4 + event_id % 60 / 100.0::double as confidence from events)"


@query(f"""with v as (select item, label, count(*) as n, sum(confidence) as s from {_VOTES} group by 1, 2), a as (select item, arg_max(label, (n, label)) as label, max(n) / sum(n)::double as c, sum(s) / sum(n) as confidence from v group by 1)
  select item, label, round(c, 6) as consistency, round(confidence, 6) as confidence, case when c >= 0.8 and confidence >= 0.6 then 'HIGH' when c >= 0.6 then 'MEDIUM' else 'LOW' end as quality from a""")
def majority_vote(spark, sf_dir):
    """The label that most votes give, how many agree, their mean confidence, and what that is good for."""
    value = F.col("value")
    label = F.when(value < 30, "neutral").when(value < 60, "positive").otherwise("negative")
    votes = table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), label.alias("label"), (F.lit(0.4) + F.col("event_id") % 60 / 100).alias("confidence"))
    return voted(votes).select("item", "label", F.round("consistency", 6).alias("consistency"), F.round("confidence", 6).alias("confidence"), "quality")


def voted(votes):
    """(item, label, consistency, confidence, quality) of ``votes`` (item, label, confidence); of labels with as many votes the last in order."""
    v = votes.groupBy("item", "label").agg(F.count("*").alias("n"), F.sum("confidence").alias("s"))
    a = v.groupBy("item").agg(F.max_by("label", F.struct("n", "label")).alias("label"), (F.max("n") / F.sum("n")).alias("consistency"), (F.sum("s") / F.sum("n")).alias("confidence"))
    quality = F.when((F.col("consistency") >= text.HIGH[0]) & (F.col("confidence") >= text.HIGH[1]), "HIGH").when(F.col("consistency") >= text.MEDIUM, "MEDIUM").otherwise("LOW")
    return a.withColumn("quality", quality)


_LABELLED = "(select doc_id, case when toxic = 1 then 0 when quality = 1 then 2 else 1 end as label, case when doc_id % 13 = 0 then null else 0.34 + doc_id % 66 / 100.0::double end as given from labels)"


@query(f"""with x as (select *, coalesce(given, 0.5) as c from {_LABELLED}) select doc_id, label, round(case when label = 0 then c else (1 - c) / 2 end, 4) as prob_negative, round(case when label = 1 then c else (1 - c) / 2 end, 4) as prob_neutral,
  round(case when label = 2 then c else (1 - c) / 2 end, 4) as prob_positive, round(c * (label - 1), 4) as sentiment_score from x""")
def label_distribution(spark, sf_dir):
    """A label and its confidence as three probabilities (what is left is shared equally) and a signed score."""
    label = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)
    rows = table(spark, sf_dir, "labels").select("doc_id", label.alias("label"), F.when(F.col("doc_id") % 13 != 0, F.lit(0.34) + F.col("doc_id") % 66 / 100).alias("confidence"))
    return rows.select("doc_id", "label", *text.distribution(F.col("label"), F.col("confidence")))


#: Terms of sectors and of the economy at large, in a corpus without either.
SECTORS, ECONOMY = {"banks": ("of the", "and the"), "trade": ("to the", "in the")}, ("is the", "that the", "for the")
_COUNTED = ", ".join(f"len(regexp_extract_all(low, '{_re2(v)}')) as {k}" for k, v in SECTORS.items())


@query(rf"""with {NEWS}, x as (select news_id, text, lower(text) as low from news where text is not null), m as (select news_id, list_sort(list_distinct(regexp_extract_all(text, '{_re2(CODES[:2])}', 1))) as companies, {_COUNTED}, list_sort(list_distinct(regexp_extract_all(low, '{_re2(ECONOMY)}', 1))) as terms from x),
  t as (select news_id, companies, list_filter([{", ".join(f"case when {k} > 0 then '{k}' end" for k in SECTORS)}], lambda s: s is not null) as sectors, terms from m)
  select news_id, cast(case when len(companies) > 0 then 3 when len(sectors) > 0 then 2 else 1 end as integer) as tier, array_to_string(case when len(companies) > 0 then companies when len(sectors) > 0 then sectors else terms end, ',') as entities from t""")
def article_tiers(spark, sf_dir):
    """Companies named in an article (tier 3); without any, its sectors (2); without any, terms of the economy (1)."""
    low = F.lower("text")
    named = lambda column, words: F.array_sort(F.array_distinct(F.regexp_extract_all(column, F.lit(_native(words)), F.lit(1))))
    sectors = F.array_compact(F.array(*[F.when(low.rlike(_native(v)), k) for k, v in SECTORS.items()]))
    found = news(spark, sf_dir).where("text is not null").select("news_id", named(F.col("text"), CODES[:2]).alias("companies"), sectors.alias("sectors"), named(low, ECONOMY).alias("terms"))
    tier = F.when(F.size("companies") > 0, 3).when(F.size("sectors") > 0, 2).otherwise(1)
    entities = F.when(tier == 3, F.col("companies")).when(tier == 2, F.col("sectors")).otherwise(F.col("terms"))
    return found.select("news_id", tier.alias("tier"), F.array_join(entities, ",").alias("entities"))
