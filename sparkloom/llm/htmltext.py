"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Blocks inside menus, headers, footers, sidebars, notices, adverts, forms
and comments (by tag, role, class or id) are ``bad``. The first pass decides the others by link density, length and the
density of stop words: ``good``, ``bad``, or ambiguous if they are short or the densities lie between. The rules
soften inside ``article`` and ``main``, and for paragraphs: what has few stop words is ambiguous there, and so is what is
mostly links in an article's paragraphs. In the second pass an ambiguous block takes the label of the nearest block that the densities decided: the one
that shares the innermost element with it, then the nearer one; ``good`` on a tie. A heading looks at what follows it
first. Blocks that are neither paragraphs nor headings also look at the neighbours that are ``bad`` by their tags. Where
nothing on a page is ``good``, its ambiguous blocks are.

Stop words are those of STOP_WORDS (nine languages) or the caller's. They count only on pages whose text holds enough of
them. On other pages a block that is neither short nor mostly links is ``good``; scripts without blanks count two characters
as a word. A page's text follows from that page alone, whatever other pages the table has.

Odd input: a null or empty page, or one without a good block, has the empty text. Unclosed tags end with the element
around them; an unclosed comment, script or style ends with the page; after a tag with an unclosed quote, quotes are
plain characters. Pages are read in one forward scan, so that a page takes time in proportion to its length; a very long
page is one value and is parsed in one task. Pages are independent rows: repeated rows repeat, ties don't occur, an empty
table gives an empty result, and other columns of the table are neither read nor changed.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: What follows a tag's name, with quoted values; and the same without quotes.
REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
ATTR = re.compile(r"""([a-zA-Z-]+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME = re.compile(r"[a-z]+|\d+")

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template iframe object svg canvas head title select textarea button datalist audio video math".split())
RAW = frozenset("script style iframe noscript textarea title template xmp".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: A paragraph ends where one of these begins or ends; a list item, cell or row ends at the next one.
CLOSED_BY = {"p": BLOCK, "li": frozenset({"li"}), "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "tr": frozenset({"tr"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option"})}
BAD_TAGS = frozenset("nav footer aside form menu header dialog".split())
BAD_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Words of a class or id that mark what isn't the article.
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright "
    "disclaimer disqus footer footers gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification pager pagination popup promo promoted "
    "promotion recommended related respond share sharing sidebar sidebars signup social sponsor sponsored subscribe teaser toolbar widget widgets".split()
)
GOOD_TAGS = frozenset({"article", "main"})
#: Common function words of English, German, French, Spanish, Italian, Portuguese, Dutch, Swedish and Polish.
STOP_WORDS = frozenset(
    "the of and to in is it that was for on are with as be at this by from or an not have which but "
    "der die das und zu den von mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei "
    "le la les de des du et un une que qui est dans pour pas sur au plus par avec ce il sont en "
    "el los las y que en del se por con para una su al lo como más pero sus "
    "di il che è e per non i gli della del con sono alla anche più si "
    "o os do da dos das em não uma com mais foi ao na no "
    "het een van dat niet zijn voor met op aan ook er maar om bij "
    "och att det som på av inte med till har ett jag var "
    "nie się na jest do z to że jak co".split()
)
HIGH_LINKS, LONG_WORDS, SHORT_WORDS, STOPS_HIGH, STOPS_LOW = 0.35, 25, 8, 0.2, 0.1
#: Characters of scripts that don't put blanks between words (Thai to Burmese, Khmer, Chinese, Japanese).
NO_BLANKS = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿]")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p blockquote pre figcaption".split()) | HEADINGS


@dataclass
class Block:
    parts: list[str] = field(default_factory=list)
    words: list[str] = field(default_factory=list)
    linked: int = 0
    bad: bool = False
    article: bool = False
    tag: str = ""
    #: The fewest elements that were open at once since the block before.
    low: int = 0


def _is_bad(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in BAD_TAGS and not (tag == "header" and in_article):
        return True
    if not attrs or tag in ("body", "html", "article", "main"):
        return False
    for name, *values in ATTR.findall(attrs):
        value = "".join(values).lower()
        name = name.lower()
        if name == "role" and value in BAD_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name in ("class", "id") and not BAD_NAMES.isdisjoint(NAME.findall(value)):
            return True
        if name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def tokens(page: str):
    """(text, closing, tag, attributes, place behind it) of a page, in one scan: the text before a tag, and the tag. The
    caller may send the place to go on from. Markup that isn't a tag has an empty name; the last text comes alone."""
    at, n, quotes = 0, len(page), True
    last_end, cdata = page.rfind(">"), True  # what isn't ahead any more is not looked for again
    text = 0  # where the text before the next tag begins
    while at < n:
        i = page.find("<", at)
        if i < 0:
            break
        if i > last_end:  # a tag that the page's end cuts off is no text
            if not (TAG.match(page, i) or page.startswith(("<!", "<?"), i)):
                at = i + 1
                continue
            page, n = page[:i], i
            break
        at = i + 1
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            end = n if end < 0 else end + 3
            yield page[text:i], False, "", "", end
        elif cdata and page.startswith("<![CDATA[", i):
            end = page.find("]]>", i + 9)
            if end < 0:
                cdata, at = False, i
                continue
            yield page[text:i], False, "", "", i + 9
            yield None, False, "", page[i + 9 : end], end + 3
            end += 3
        elif page.startswith(("<!", "<?"), i):
            end = page.find(">", i) + 1
            yield page[text:i], False, "", "", end
        elif m := TAG.match(page, i):
            rest = REST.match(page, m.end()) if quotes else None
            quotes &= rest is not None
            end = rest.end() if rest else page.find(">", m.end()) + 1
            end = (yield page[text:i], bool(m[1]), m[2].lower(), page[m.end() : end - 1], end) or end
        else:
            continue
        at = text = end
    if text < n:
        yield page[text:], False, "", "", n


def blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, int]] = []  # open elements with what they add: 1 bad, 2 article, 4 hidden, 8 link
    opened: Counter = Counter()
    holder: list[str] = []  # the open block-level elements
    depth = [0, 0, 0, 0]
    now, low = Block(), 0

    def shift(flags: int, by: int) -> None:
        for k in range(4):
            if flags >> k & 1:
                depth[k] += by

    def flush() -> None:
        nonlocal now
        if now.parts:
            out.append(now)
        now = Block()

    def add(text: str) -> None:
        nonlocal low
        if depth[2] or not text:
            return
        if not now.parts:
            if text.isspace():
                return
            now.bad, now.article, now.low = depth[0] > 0, depth[1] > 0, low
            now.tag = next((t for t in holder[:-4:-1] if t in HEADINGS), holder[-1] if holder else "")
            low = len(stack)
        now.parts.append(text)
        if depth[3]:
            now.linked += len(text.strip())

    def close(k: int) -> None:
        nonlocal low
        while len(stack) > k:
            tag, flags = stack.pop()
            opened[tag] -= 1
            if tag in BLOCK:
                holder.pop()
            shift(flags, -1)
        low = min(low, k)

    scan = tokens(page)
    token = next(scan, None)
    while token is not None:
        text, closing, tag, attrs, at = token
        skip = None
        if text is None:
            add(attrs)
        elif text:
            add(html.unescape(text))
        if not tag:
            pass
        elif closing:
            if tag in BLOCK:
                flush()
            if opened[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                close(k)
        elif tag == "br":
            add(" ")
        else:
            if tag in BLOCK:
                flush()
                while stack and tag in CLOSED_BY.get(stack[-1][0], ()):
                    close(len(stack) - 1)
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                skip = end.end() if end else len(page)
            elif not (tag in VOID or attrs.endswith("/") and tag not in BLOCK and tag not in HIDDEN):
                flags = _is_bad(tag, attrs, depth[1] > 0) | (tag in GOOD_TAGS) << 1 | (tag in HIDDEN) << 2 | (tag == "a") << 3
                stack.append((tag, flags))
                opened[tag] += 1
                if tag in BLOCK:
                    holder.append(tag)
                shift(flags, 1)
        try:
            token = scan.send(skip)
        except StopIteration:
            token = None
    flush()
    return out


def covered(texts: list[tuple[Block, str]], stops: frozenset[str]) -> bool:
    """Whether stop words tell about a page: they are frequent in what isn't bad or mostly links, or there is no such text."""
    own = [block.words for block, text in texts if not block.bad and block.linked <= HIGH_LINKS * len(text)]
    wordless = sum(len(NO_BLANKS.findall(text)) for block, text in texts if not block.bad and not text.isascii())
    return sum(sum(map(stops.__contains__, words)) for words in own) >= STOPS_HIGH * (sum(map(len, own)) + wordless / 2)


def label(block: Block, text: str, known: bool = True, stops: frozenset[str] = STOP_WORDS) -> bool | None:
    """True: main text, False: not, None: ambiguous; ``known``: stop words tell about the page."""
    if block.bad:
        return False
    if block.linked > HIGH_LINKS * len(text):
        return None if block.article and block.tag != "li" else False
    size = len(block.words) if text.isascii() else len(block.words) + len(NO_BLANKS.findall(text)) / 2
    if block.tag in HEADINGS or size <= SHORT_WORDS:
        return None
    if not known:
        return True
    dense = sum(map(stops.__contains__, block.words)) / size
    if size >= LONG_WORDS and dense >= STOPS_HIGH:
        return True
    return None if dense >= STOPS_LOW or block.article or block.tag in PROSE else False


def _nearest(both: list[tuple[Block, str]], first: list[bool | None], order: range) -> tuple[list, list]:
    """For each block the last one before it in ``order`` that the densities decided, and that which has any label: (elements
    shared with it, minus the distance, its label)."""
    decided, any_label = [None] * len(both), [None] * len(both)
    seen, seen_any = None, None
    back = order.step < 0
    for i in order:
        if not back and i:
            shared = both[i][0].low
        elif back and i + 1 < len(both):
            shared = both[i + 1][0].low
        else:
            shared = 0
        if seen:
            seen = min(seen[0], shared), seen[1], seen[2]
            decided[i] = seen[0], -abs(i - seen[1]), seen[2]
        if seen_any:
            seen_any = min(seen_any[0], shared), seen_any[1], seen_any[2]
            any_label[i] = seen_any[0], -abs(i - seen_any[1]), seen_any[2]
        if first[i] is not None:
            seen_any = 1 << 60, i, first[i]
            if not both[i][0].bad:
                seen = seen_any
    return decided, any_label


def chosen(both: list[tuple[Block, str]], stops: frozenset[str] = STOP_WORDS) -> list[bool]:
    """Whether each block is main text."""
    known = covered(both, stops)
    first = [label(b, text, known, stops) for b, text in both]
    if True not in first:
        return [x is None for x in first]
    before, before_any = _nearest(both, first, range(len(both)))
    after, after_any = _nearest(both, first, range(len(both) - 1, -1, -1))
    out = []
    for i, x in enumerate(first):
        if x is None:
            block = both[i][0]
            prose = block.tag in PROSE or block.article
            left, right = (before[i], after[i]) if prose else (before_any[i], after_any[i])
            if block.tag in HEADINGS and right and (not left or right[0] >= left[0]):
                x = right[2]
            elif block.tag in HEADINGS and after_any[i] and after_any[i][1] == -1 and not after_any[i][2] and (not left or after_any[i][0] >= left[0]):
                x = False  # it heads what is bad by its tags
            elif left and right and left[:2] == right[:2]:
                x = left[2] or right[2]
            else:
                x = max(y for y in (left, right) if y)[2] if left or right else True
        out.append(bool(x))
    return out


def _cut(page: str) -> list[tuple[Block, str]]:
    out = []
    for block in blocks(page):
        words = "".join(block.parts).split()
        if words:
            text = " ".join(words)
            block.words = text.lower().split()
            out.append((block, text))
    return out


def main_text(page: str | None, stops: frozenset[str] = STOP_WORDS) -> str:
    if not page:
        return ""
    both = _cut(page)
    return "\n".join(text for (_, text), x in zip(both, chosen(both, stops)) if x)


def extract(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), stops: frozenset[str] = STOP_WORDS) -> DataFrame:
    """``keep`` columns, text and n_chars of every page."""
    own = df.select(*keep, F.col(html_col).alias("_html"))
    schema = own.drop("_html").withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema

    def run(batches):
        for batch in batches:
            texts = [main_text(p, stops) for p in batch.column(batch.num_columns - 1).to_pylist()]
            if texts:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=schema.names)

    return own.mapInArrow(run, schema)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
