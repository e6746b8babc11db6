"""Web pages: visible text, links, sections, scores, work lists, reachability."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealloom.functions.arrays import running_sums

# Patterns that tell pages with deals, menus and prices.
DEAL_PATTERNS = (r"\bhappy\s*hour\b", r"\bspecials?\b", r"\bdeals?\b", r"\bapr[eè]s\b", r"\bearly\s*bird\b", r"\blate\s*night\b", r"\bdrink\s*specials?\b", r"\bfood\s*specials?\b", r"\bdaily\s*specials?\b")
MENU_PATTERNS = (r"\bmenu\b", r"\bfood\b", r"\bdining\b", r"\beat\b", r"\bbrunch\b", r"\blunch\b", r"\bdinner\b", r"\bappetizers?\b", r"\bentr[eé]es?\b", r"\bmains?\b", r"\bdesserts?\b", r"\bbeverage\b", r"\bcocktails?\b", r"\bwine\s*list\b", r"\bprix\s*fixe\b", r"\btasting\s*menu\b", r"\bchef.*menu\b", r"\bseasonal\s*menu\b")
PRICE_PATTERNS = (r"\$\d+", r"\$\d+\.\d{2}", r"\$\d+\s*[-–]\s*\$?\d+", r"market\s*price", r"seasonal\s*price", r"mp\b")
URL_PATTERNS = ("happy.*hour", "specials?", "deals?", "menu", "food", "dining", "eat", "drink", "apr[eè]s", "bar", "lounge", "brunch", "lunch", "dinner", "prix.*fixe", "tasting.*menu", "chef.*menu")
STRONG_TERMS = ("happy hour", "specials", "deals", "menu")
MENU_TERMS = ("food menu", "dinner menu", "lunch menu", "brunch menu", "drink menu", "cocktail menu", "wine list", "prix fixe", "tasting menu", "chef menu", "seasonal menu")
PRICE_TERMS = ("prices", "pricing", "cost", "$", "price list")
CONTAINERS = ("main", "article", "section", "aside", "div", "p", "li")


def visible_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags, with the usual entities and white space collapsed."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", " ")
    t = F.regexp_replace(F.regexp_replace(t, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    for entity, text in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(text))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def page_text(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", title(F.col("html")).alias("title"), visible_text(F.col("html")).alias("text"))


def links(pages: DataFrame) -> DataFrame:
    """One row per anchor: the page, the place of the anchor, its address and text; relative addresses are resolved by host."""
    found = F.regexp_extract_all("html", F.lit(r'(?is)<a\s[^>]*href="[^"]*"[^>]*>.*?</a>'), F.lit(0))
    rows = pages.select("page_id", "url", F.posexplode(found).alias("pos", "anchor"))
    href = F.regexp_extract("anchor", r'(?i)href="([^"]*)"', 1)
    host = F.regexp_extract("url", r"^(https?://[^/]+)", 1)
    return rows.select("page_id", F.col("url").alias("source_url"), "pos", F.when(href.startswith("/"), F.concat(host, href)).otherwise(href).alias("url"), visible_text(F.col("anchor")).alias("anchor_text"))


def sections(pages: DataFrame, tags: Sequence[str] = CONTAINERS, longer_than: int = 20, distinct: bool = True) -> DataFrame:
    """Texts of container elements (up to the first closing tag), longer than a limit.

    The same text under several tags counts once per page, unless distinct is off.
    """
    each = F.array(*[F.struct(F.lit(t).alias("tag"), F.regexp_extract_all("html", F.lit(rf"(?is)<{t}\b[^>]*>(.*?)</{t}>"), F.lit(1)).alias("parts")) for t in tags])
    rows = pages.select("page_id", "url", F.explode(each).alias("s")).select("page_id", "url", "s.tag", F.posexplode("s.parts").alias("pos", "part"))
    rows = rows.select("page_id", "url", "tag", "pos", visible_text(F.col("part")).alias("text")).filter(F.length("text") > longer_than)
    if not distinct:
        return rows
    return rows.groupBy("page_id", "url", F.xxhash64("text").alias("key")).agg(F.min_by(F.struct("tag", "pos", "text"), F.struct("pos", "tag")).alias("s")).select("page_id", "url", "s.*")


# Tags whose elements may hold others of their kind, with or without a class or an id.
NESTING = ("main", "article", "section", "aside", "header", "footer", "nav", "div", "span", "ul", "ol", "table", "form")


def _selected(piece: Column, tag: str, selector: str) -> Column:
    """Whether an opening tag is meant by a selector: a tag, .class, #id, or a tag with one of these."""
    name, mark, value = re.fullmatch(r"([A-Za-z][\w-]*)?(?:([.#])([\w-]+))?", selector).groups()
    out = F.lit(name is None or name.lower() == tag)
    if mark:
        attribute = "class" if mark == "." else "id"
        own = F.regexp_extract(piece, rf"(?is)\s{attribute}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
        tokens = F.split(F.trim(F.regexp_replace(own, "[\"']", "")), r"\s+")
        out = out & (F.array_contains(tokens, value) if mark == "." else F.regexp_replace(own, "[\"']", "") == value)
    return out


def containers(pages: DataFrame, key: Sequence[str], selectors: Sequence[str], html: str = "html", longer_than: int = 20, first: int | None = None, tags: Sequence[str] = NESTING) -> DataFrame:
    """key, selector, pos and text of the elements that a selector means, whatever is nested in them.

    pos counts a selector's elements of a page in the order in which they open, from 0, before short texts
    are left out; first keeps so many of each. The page is cut at its tags. The depth of each tag within
    its own kind is a running sum; of the tags of one kind and depth, the one after an opening tag
    closes it. An element that is not closed goes to the end of the page. Scripts, styles and comments hold no tags.
    """
    clean = F.regexp_replace(F.regexp_replace(F.col(html), r"(?is)<(script|style)\b[^>]*>.*?</(script|style)>", " "), r"(?s)<!--.*?-->", " ")
    rows = pages.select(*key, F.split(clean, "<").alias("_pieces"))
    rows = rows.withColumn("_names", F.transform("_pieces", lambda p: F.lower(F.regexp_extract(p, r"^(/?[A-Za-z][A-Za-z0-9]*)", 1))))
    total = F.size("_pieces")

    def elements(tag: str) -> Column:
        """Opening and closing place of each element of a tag; pieces count from 1."""
        named = F.filter(F.transform("_names", lambda n, i: F.struct((i + 1).alias("at"), F.when(n == tag, 1).when(n == f"/{tag}", -1).alias("step"))), lambda m: m["step"].isNotNull())

        def levels(marks: Column) -> Column:
            depth = running_sums(F.transform(marks, lambda m: m["step"]))
            return F.zip_with(marks, depth, lambda m, d: F.struct(F.when(m["step"] > 0, d).otherwise(d + 1).alias("level"), m["at"].alias("at"), m["step"].alias("step")))

        def closed(marks: Column) -> Column:
            after = F.slice(marks, F.lit(2), F.size(marks))
            pairs = F.zip_with(marks, after, lambda m, x: F.struct(m["at"].alias("open"), m["step"].alias("step"), F.when((x["level"] == m["level"]) & (x["step"] < 0), x["at"]).otherwise(total + 1).alias("close")))
            return F.transform(F.filter(pairs, lambda p: p["step"] > 0), lambda p: F.struct(p["open"].alias("open"), p["close"].alias("close")))

        once = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))
        return F.when(F.array_contains("_names", tag), once(named, lambda marks: once(F.array_sort(levels(marks)), closed)))

    none = F.array().cast("array<struct<open:int,close:int>>")
    rows = rows.withColumns({f"_{t}": F.coalesce(elements(t), none) for t in tags})
    piece = lambda e: F.element_at("_pieces", e["open"])

    def meant(selector: str) -> Column:
        some = [F.filter(f"_{t}", _one(lambda e, t=t: _selected(piece(e), t, selector))) for t in tags if t == selector.lower() or not re.fullmatch(r"[A-Za-z][\w-]*", selector)]
        found = F.array_sort(F.concat(*some)) if some else none
        return F.slice(found, 1, first) if first else found

    inner = lambda e: visible_text(F.concat(F.lit("<"), F.array_join(F.slice("_pieces", e["open"], e["close"] - e["open"]), "<")))
    each = F.flatten(F.array(*[F.transform(meant(s), _pair(lambda e, i, s=s: F.struct(F.lit(s).alias("selector"), i.alias("pos"), inner(e).alias("text")))) for s in selectors]))
    # Short texts go before rows are made, so a text is read once.
    return rows.select(*key, F.explode(F.filter(each, lambda e: F.length(e["text"]) > longer_than)).alias("e")).select(*key, "e.*")


def _one(f):
    """A function of exactly one parameter, as filter counts them."""
    return lambda x: f(x)


def _pair(f):
    """A function of exactly two parameters, as transform counts them."""
    return lambda x, i: f(x, i)


def _count(text: Column, patterns: Sequence[str]) -> Column:
    """Matches of all patterns, each counted by itself."""
    return sum((F.regexp_count(text, F.lit("(?i)" + p)) for p in patterns), F.lit(0))


def _hits(text: Column, patterns: Sequence[str]) -> Column:
    """How many of the patterns are found."""
    return sum((F.when(text.rlike("(?i)" + p), 1).otherwise(0) for p in patterns), F.lit(0))


def likelihood(text: Column, url: Column, page_title: Column, deals: Sequence[str] = DEAL_PATTERNS, menus: Sequence[str] = MENU_PATTERNS, prices: Sequence[str] = PRICE_PATTERNS) -> Column:
    """Likelihood that a page has deals: weighted counts of patterns, at most 1."""
    times = F.regexp_count(text, F.lit(r"(?i)\d{1,2}\s*(?::\d{2})?\s*(?:am|pm)")) + F.regexp_count(text, F.lit("(?i)monday|tuesday|wednesday|thursday|friday|saturday|sunday"))
    score = _count(text, deals) * 0.2 + _count(text, menus) * 0.15 + _count(text, prices) * 0.25 + _hits(F.lower(url), URL_PATTERNS) * 0.3
    score = score + _hits(F.lower(F.coalesce(page_title, F.lit(""))), [*deals, *menus]) * 0.4 + times * 0.1 + F.when(F.lower(url).endswith(".pdf"), 0.5).otherwise(0.0)
    return F.round(F.least(score, F.lit(1.0)), 6)


def relevance(url: Column, anchor: Column, deals: Sequence[str] = DEAL_PATTERNS, menus: Sequence[str] = MENU_PATTERNS, strong: Sequence[str] = STRONG_TERMS) -> Column:
    """How likely a link leads to deals, at most 1."""
    low = F.lower(url)
    has = lambda text, words: sum((F.when(text.contains(w), 1).otherwise(0) for w in words), F.lit(0))
    score = _hits(anchor, deals) * 0.4 + _hits(anchor, menus) * 0.35 + _hits(low, URL_PATTERNS) * 0.3 + has(anchor, strong) * 0.5 + has(low, strong) * 0.3
    score = score + has(anchor, MENU_TERMS) * 0.6 + has(low, MENU_TERMS) * 0.4 + has(anchor, PRICE_TERMS) * 0.4 + has(low, PRICE_TERMS) * 0.3
    document = F.when(low.endswith(".pdf"), F.when(low.rlike("menu|food|drink|price"), 0.8).otherwise(0.5)).otherwise(0.0)
    return F.round(F.least(score + document, F.lit(1.0)), 6)


def keywords(text: Column, patterns: Sequence[str], most: int = 20) -> Column:
    """Distinct matches in lower case, in alphabetical order, at most so many."""
    found = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(F.lower(text), F.lit(p), F.lit(0)) for p in patterns])))
    return F.slice(F.array_sort(found), 1, most)


def page_flags(text: Column, html: Column, thin: int = 300) -> list[Column]:
    """Flags of blocked, thin and script-only pages."""
    blocked = (F.length(text) < 1000) & F.lower(text).rlike("access denied|captcha|forbidden|are you a robot")
    shell = F.regexp_count(html, F.lit("(?i)<script")) > F.regexp_count(html, F.lit("(?i)<p[ >]"))
    return [blocked.alias("is_blocked"), (F.length(text) < thin).alias("is_thin"), shell.alias("is_script_shell")]


def dynamic_score(html: Column) -> Column:
    """Signs of a page that is filled by scripts, at most 1."""
    tokens = F.least(F.regexp_count(html, F.lit("(?i)react|angular|vue|__next_data__|ng-app")) * 0.2, F.lit(0.4))
    empty = F.least(F.regexp_count(html, F.lit(r"(?i)<div[^>]*>\s*</div>")) * 0.1, F.lit(0.3))
    return F.round(F.least(tokens + empty + F.least(F.regexp_count(html, F.lit("(?i)<script")) * 0.05, F.lit(0.3)), F.lit(1.0)), 6)


def host(url: Column) -> Column:
    """Host in lower case without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^https?://([^/:?#]+)", 1)), r"^www\.", "")


def normal_url(url: Column) -> Column:
    """https, host in lower case, no slash at the end; null for other text."""
    u = F.trim(url)
    rest = F.regexp_extract(u, r"(?i)^https?://[^/?#]+([^#]*)", 1)
    head = F.lower(F.regexp_extract(u, r"(?i)^https?://([^/?#]+)", 1))
    return F.when(head != "", F.concat(F.lit("https://"), head, F.regexp_replace(rest, "/+$", "")))


def of_known_hosts(rows: DataFrame, known: DataFrame, url: str = "url", website: str = "website") -> DataFrame:
    """Links whose host is the host of a known website. The sizes of both sides decide how they are joined."""
    hosts = known.select(host(F.col(website)).alias("_host")).filter("_host <> ''").distinct()
    return rows.withColumn("_host", host(F.col(url))).join(hosts, "_host", "left_semi").drop("_host")


def reachable(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """node and its least distance from the seeds, up to depth; edges have a and b.

    Each level is written to the shared checkpoint folder before the next, so a lost executor costs one level.
    """
    from dealloom.sources.tables import checkpointed

    seen = checkpointed(seeds.select(F.col("node")).distinct().withColumn("depth", F.lit(0)))
    level = seen
    for k in range(1, depth + 1):
        found = level.join(edges, level["node"] == edges["a"]).select(F.col("b").alias("node")).distinct()
        level = checkpointed(found.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(k)))
        seen = seen.unionByName(level)
    return seen


def best_candidates(scored: DataFrame, by: str, score: str, order: str, most: int) -> DataFrame:
    """The best rows of each group with their rank."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(score), order))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= most)


def repaired(rows: DataFrame, paths: Sequence[str], known: DataFrame, base: str = "base") -> DataFrame:
    """First of base + path, in the order of the paths, among the known good addresses; the base if none is."""
    each = F.posexplode(F.array(*map(F.lit, paths))).alias("ord", "path")
    tried = rows.select(base, each).withColumn("url", F.concat(F.col(base), F.col("path")))
    found = tried.join(known.select("url").distinct(), "url").groupBy(base).agg(F.min_by("url", "ord").alias("found"))
    return rows.join(found, base, "left").withColumn("url", F.coalesce("found", base)).drop("found")


def content_score(text: Column, words: Sequence[str]) -> Column:
    """Score of a page's content: 0.2 for each word, up to 0.3 for times and 0.2 for prices, 0.3 for menus with deals; at most 1."""
    low = F.lower(text)
    score = sum((F.when(low.contains(w), 0.2).otherwise(0.0) for w in words), F.lit(0.0))
    score = score + F.least(F.regexp_count(low, F.lit(r"\d{1,2}\s*(?::\d{2})?\s*(?:am|pm)")) * 0.1, F.lit(0.3)) + F.least(F.regexp_count(low, F.lit(r"\$\d+")) * 0.05, F.lit(0.2))
    return F.round(F.least(score + F.when(low.contains("happy hour") & low.rlike("menu|specials|deals"), 0.3).otherwise(0.0), F.lit(1.0)), 6)


def menu_documents(pages: DataFrame, url: str = "url", kind: str = "content_type") -> DataFrame:
    """Pages that are PDF files by type or name, and look like a menu by their address."""
    low = F.lower(F.col(url))
    return pages.filter((F.coalesce(F.col(kind), F.lit("")).contains("pdf") | low.endswith(".pdf")) & low.rlike("menu|food|drink|happy"))
