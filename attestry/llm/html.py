"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree of presentation: a node is a path of tags with their classes. For each
node the tree holds on how many pages it stands, how its children are laid out there (presentation), and which texts
its blocks have (content). Importance is the entropy of those over the pages: a node laid out alike everywhere with
the same text everywhere has none; one whose text differs from page to page has much. A block's importance is its prior
times ``(1 - GAMMA) * presentation of its parent + GAMMA * content``; blocks below ``THRESHOLD`` are removed. On nodes seen on fewer than
``MIN_PAGES`` pages entropy says nothing and counts as 1.

The prior is 1, but 0 for what HTML itself says is no article: navigation, page headers and footers, asides, forms, scripts and the like,
and elements whose role, or class or id names an advert, notice, sidebar, reader comments and so on. Entropy can't judge those on a host of
few pages, nor a menu or advert that differs on each page. With a prior of 0 nothing that entropy
could say would keep a block, so such blocks aren't looked up. Inside article and main elements only a class or id that is such a name as a
whole counts ("ad", "comments", not "market-share"). Also inside those elements, pages that hold the same text there count
as one: copies of an article don't make it a part of the site's layout.

Only hashes of paths and texts are counted by (host, path, text), so a hot host is spread over its texts; no host's
pages ever meet in one task. Pages from which a block goes are joined with their list of removed blocks by a key of
the host and the page's content.

Edge cases: null or empty html gives an empty text; null urls share the host ''; pages without any tag are one block;
unclosed, misnested and cut-off tags are closed as at the end of the page; repeated rows are extracted alike; an
empty table gives no rows. Other columns of the input are kept by :func:`extract`, apart from text and n_chars.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import fresh, replace_columns, stored, table

GAMMA = 0.9
THRESHOLD = 0.25
MIN_PAGES = 4
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that never hold main text.
DROP = frozenset("nav footer aside form script style noscript template iframe head title button select option textarea svg menu dialog".split())
MAIN = frozenset(("article", "main"))
_DROP_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|banner\w*|sponsor\w*|promo\w*|sidebar\w*|side-?bar|nav\w*|menu\w*|breadcrumbs?|footer\w*|masthead|site-?header|page-?header|cookies?\w*|consent|gdpr|"
    r"notice\w*|notification\w*|popup|modal|overlay|newsletter|subscribe\w*|subscription|share\w*|sharing|social\w*|related\w*|recommend\w*|comments?|comment-?\w+|disqus\w*|respond|replies|login|signin|search\w*|"
    r"pagination|pager|toolbar|widget\w*|skip-?link|copyright|legal|alert\w*|disclaimer)(?:$|[\s_-])",
    re.I,
)
#: A whole class or id that names no article inside one.
_DROP_NAMES = re.compile(
    r"ads?|ad[_-]?(?:box|slot|unit|banner|container|wrapper)|advert(?:isement|s|ising)?|adsense|sponsor(?:ed|s)?|promo(?:tion|box)?|banner|side-?bar|nav(?:bar|igation)?|menu|breadcrumbs?|(?:site|page)?-?footer|"
    r"(?:site|page)-header|masthead|cookies?|cookie[_-]\w+|consent|gdpr|(?:site|page|cookie|privacy)?-?notice|notification|popup|modal|newsletter|subscribe|subscription|shar(?:e|ing)(?:[_-](?:bar|buttons?|links?|tools|this))?|"
    r"social(?:[_-](?:bar|buttons?|links?|media|share))?|(?:related|recommended)(?:[_-](?:posts?|articles?|links?|content|stories))?|comments?|comments?[_-](?:list|section|area|form|thread|body|box)|reader-comments|disqus\w*|respond|replies|"
    r"login|signin|search(?:[_-]?(?:box|form|bar))?|pagination|pager|toolbar|skip-?link|copyright|disclaimer",
    re.I,
)
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"\s+")
#: End tags that HTML lets authors leave out: a start tag closes an open element of these.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _dropped(tag: str, attrs: dict[str, str], in_main: bool) -> bool:
    if tag in DROP or tag == "header" and not in_main or attrs.get("role", "").lower() in _DROP_ROLES:
        return True
    if tag in ("html", "body", "main"):
        return False
    if in_main:
        return any(_DROP_NAMES.fullmatch(name) for k in ("class", "id") for name in attrs.get(k, "").split())
    return any(_DROP_WORDS.search(attrs[k]) for k in ("class", "id") if k in attrs)


def blocks_of(page: str | None) -> Iterator[tuple[str, int, str]]:
    """(path, state, text) of each non-empty block in page order. state: 0 never content, 1 undecided, 2 undecided in an article or main element."""
    page = page or ""
    stack: list[tuple[str, str, int]] = []  # tag, path, state
    parts: list[str] = []
    at, path, state, out = 0, "", 1, []

    def flush():
        if parts:
            text = _SPACE.sub(" ", _html.unescape("".join(parts))).strip()
            parts.clear()
            if text:
                out.append((path, state, text))

    while at < len(page):
        m = _TAG.search(page, at)
        if not m:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if not m[4]:  # cut off inside a tag
            break
        if tag == "br":
            parts.append(" ")
            continue
        closing = bool(m[1])
        block = tag in BLOCK or tag in RAW or tag in DROP
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    if block or any(s[0] in BLOCK for s in stack[i:]):
                        flush()
                    del stack[i:]
                    break
                if tag not in BLOCK and stack[i][0] in BLOCK:  # a stray inline end tag closes no block
                    break
            path, state = stack[-1][1:] if stack else ("", 1)
            continue
        attrs = {a[1].lower(): _html.unescape(a[2] or a[3] or a[4] or "") for a in _ATTR.finditer(m[3])} if m[3] else {}
        new = _dropped(tag, attrs, state == 2)
        if block or new != (state == 0):
            flush()
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        if tag in BLOCK and stack:
            ends = _CLOSES.get(tag, ())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in ends or stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] in BLOCK and (stack[i][0] in _SCOPE.get(tag, ()) or tag not in _SCOPE):
                    break
            path, state = stack[-1][1:] if stack else ("", 1)
            new = _dropped(tag, attrs, state == 2)
        if block:
            name = tag + "." + ".".join(sorted(attrs.get("class", "").split())) if attrs.get("class") else tag
            path = f"{path}/{name}"
        state = 0 if state == 0 or new else 2 if state == 2 or tag in MAIN or attrs.get("role", "").lower() == "main" else 1
        stack.append((tag, path, state))
    flush()
    return iter(out)


def _hash(text: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def page_key(host: str, page: str | None) -> int:
    return _hash(f"{host}\n{page or ''}")


def _features(html_col: str, url_col: str):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for page, url in zip(b.column(b.schema.get_field_index(html_col)).to_pylist(), b.column(b.schema.get_field_index(url_col)).to_pylist(), strict=True):
                open_ = [(i, p, s, t) for i, (p, s, t) in enumerate(blocks_of(page)) if s]
                if open_:
                    layout: dict[str, list[str]] = {}
                    for _, p, _s, _t in open_:
                        layout.setdefault(p.rpartition("/")[0], []).append(p.rpartition("/")[2])
                    host = host_of(url)
                    key = page_key(host, page)
                    voice = {1: key, 2: _hash("\n".join(t for _, _p, s, t in open_ if s == 2))}
                    rows += [(key, voice[s], host, i, _hash(p), _hash(p.rpartition("/")[0]), _hash(" ".join(dict.fromkeys(layout[p.rpartition("/")[0]]))), _hash(t)) for i, p, s, t in open_]
            cols = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 2 else pa.int64()) for k, c in enumerate(cols)], names=["page", "voice", "host", "at", "path", "parent", "layout", "content"])

    return run


#: voice: what counts as one page for a block; the page, or inside article and main all that stands there.
_FEATURES = "page long, voice long, host string, at long, path long, parent long, layout long, content long"


def low_blocks(pages: DataFrame, url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page, drop array<long>): the undecided blocks of each page whose importance in the site's style tree is low."""
    f = stored(pages.select(F.col(html_col).cast("string").alias(html_col), F.col(url_col).cast("string").alias(url_col)).mapInArrow(_features(html_col, url_col), _FEATURES), "blocks")
    pages_of = lambda *keys: f.select(*keys, "voice").distinct().groupBy(*keys).agg(F.count("*").alias("n"))
    node = pages_of("host", "path").withColumnRenamed("n", "m")
    content = pages_of("host", "path", "content").withColumnRenamed("n", "same")
    layouts = pages_of("host", "parent", "layout")
    # entropy to the base of the pages: -sum p log_m p
    look = layouts.groupBy("host", "parent").agg(F.sum("n").alias("m"), (F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("e"))
    look = look.select("host", "parent", F.when(F.col("m") > 1, F.col("e") / F.log("m")).otherwise(1.0).alias("presentation"))
    parents = f.select("host", "path", "parent").distinct()
    nodes = node.where(F.col("m") >= min_pages).join(parents, ["host", "path"]).join(look, ["host", "parent"])
    weight = (1 - GAMMA) * F.col("presentation") + GAMMA * (1 - F.log("same") / F.log("m"))
    low = stored(content.where(F.col("same") > 1).join(nodes, ["host", "path"]).where(weight < threshold).select("host", "path", "content").distinct(), "low")
    # both sides come from exchanges, so that a text on a third of all pages can be split
    return f.select("page", "at", "host", "path", "content").join(low.hint("merge"), ["host", "path", "content"]).groupBy("page").agg(F.collect_set("at").alias("drop"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", threshold: float = THRESHOLD, min_pages: int = MIN_PAGES) -> DataFrame:
    """pages without html, with text (blocks joined by \\n) and n_chars (code points)."""
    low = stored(low_blocks(pages, url_col, html_col, threshold, min_pages), "low-blocks")
    keep = [f for f in pages.schema.fields if f.name not in (html_col, "text", "n_chars")]
    drop_, key_ = fresh(pages, "_drop"), fresh(pages, "_key")
    schema = StructType([*keep, StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            html, drops = (b.column(b.schema.get_field_index(c)).to_pylist() for c in (html_col, drop_))
            texts = []
            for page, drop in zip(html, drops, strict=True):
                drop = set(drop or ())
                texts.append("\n".join(t for i, (_, s, t) in enumerate(blocks_of(page)) if s and i not in drop))
            out = replace_columns(b, ("text", "n_chars"), [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())])
            yield out.select([f.name for f in schema.fields])

    if low.limit(1).count():
        # the key is computed from the page itself, as in the first pass; pages without such blocks meet no match
        keyed = pages.mapInArrow(_with_key(html_col, url_col, key_), StructType([*pages.schema.fields, StructField(key_, LongType())]))
        rows = keyed.join(low.select(F.col("page").alias(key_), F.col("drop").alias(drop_)), key_, "left").drop(key_)
    else:
        rows = pages.withColumn(drop_, F.lit(None).cast("array<bigint>"))
    return rows.mapInArrow(run, schema)


def _with_key(html_col: str, url_col: str, key: str):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            page, url = (b.column(b.schema.get_field_index(c)).cast(pa.string()).to_pylist() for c in (html_col, url_col))
            yield replace_columns(b, (key,), [pa.array([page_key(host_of(u), p) for p, u in zip(page, url, strict=True)], pa.int64())])

    return run


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
