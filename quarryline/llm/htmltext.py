"""Main text of web pages by the line-block distribution.

Markup is stripped block by block: every block element starts a new line, and elements that stand
inside a line leave no break, even if nothing of them is shown. Each line weighs as many characters as
it shows outside of links, none if these have neither letter nor digit. Tags only set weights: lines of
menus, headers, footers, sidebars, notices, adverts, forms and reader comments weigh nothing, and such a
stretch of lines counts as ``window`` lines at least, since its markup left blank lines. Where the page names
its article (article or main), lines outside of it weigh nothing likewise, and inside links count as text.

Over the whole page, with blank lines before and after it, run sums of ``window`` weights. A dive point is
where a sum falls to zero, a surge point where sums leave zero again; the text is what stands between each
surge and the next dive, lines that no sum of zero covers. So a line of nothing but links stays where text is
near and goes where it stands in a run of its kind.
"""

from __future__ import annotations

import html as htmllib
import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows

#: Lines summed at each place of the distribution.
WINDOW = 3
#: Share of a page's text beyond which a form is the page's frame and no part of it.
FRAME = 0.5
#: Elements whose text is never shown or never part of an article.
DROPPED = frozenset("head nav footer aside form dialog menu button select option textarea label fieldset iframe object canvas svg math audio video map".split())
#: Elements whose content is not markup.
RAW = "script|style|noscript|template|title|xmp|noembed|noframes"
#: Elements that stand inside a line.
INLINE = frozenset(
    "a abbr acronym audio b bdi bdo big br button canvas cite code data del dfn em font i iframe img input ins kbd label map mark math meter "
    "object output picture progress q rp rt ruby s samp select small span strike strong sub sup svg textarea time tt u var video wbr".split())
#: Elements without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class or id that name what is no article.
NAMES = frozenset(
    "ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
    "disclaimer disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices notification pager pagination "
    "paywall popup promo promoted promotion related replies respond search share sharing sidebar signup social sponsor sponsored "
    "subscribe subscription toolbar topbar widget widgets".split())
#: Words that may follow such a name without changing what it names.
PLAIN = frozenset(
    "area articles author bar block body bottom box btn button buttons card carousel cell col column container content desktop "
    "feed form frame group header heading holder icon icons image inner item items label layer layout left link links list main "
    "meta mobile module outer overlay pane panel post posts reply right row section site slot stories text thread title top unit "
    "us view wide wrap wrapper x".split())
#: Roles of the same kind.
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Elements that such a name never takes away, and words by which a name speaks of another element.
KEPT, ABOUT = frozenset("html body article main".split()), frozenset("has no with without".split())

#: Elements whose end tag may be left out, and the start tags that end them; the end of what they stand in does so too.
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDED_BY = {"p": BLOCKS, "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "option": frozenset({"option", "optgroup"}), "optgroup": frozenset({"optgroup"}),
            "td": frozenset("td th tr tbody tfoot".split()), "th": frozenset("td th tr tbody tfoot".split()), "tr": frozenset("tr tbody tfoot".split()),
            "thead": frozenset("tbody tfoot".split()), "tbody": frozenset("tbody tfoot".split()), "tfoot": frozenset({"tbody"})}

#: Attributes up to the end of a tag. A quoted value ends where white space or the tag's end follows; if
#: quotes don't pair up so, the tag ends at the first >.
_REST = r"(?:(?:[^>\"']|\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>]))*+>|[^>]*(?:>|$))"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<(?P<raw>{RAW})\b{_REST}.*?(?:</(?P=raw)\s*>|$)"
    rf"|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>{_REST})", re.I | re.S)
ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")


def _names_other(word: str) -> bool:
    """Whether a word of class or id names what is no article: it ends in such a name, or begins with
    one and goes on with plain words only. "cookie-notice" and "ad-slot" do, "related-work" does not."""
    parts = [p for p in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", word).lower()) if p]
    if not parts or set(parts) & ABOUT:
        return False
    return parts[-1] in NAMES or parts[0] in NAMES and all(p in PLAIN or p in NAMES for p in parts)


def _apart(name: str, attrs: str, in_article: bool, forms: bool = True) -> bool:
    """Whether an element that opens here is no part of an article; without forms, a form may be one."""
    if name == "form" and not forms:
        return False
    if name in DROPPED or name == "header" and not in_article:
        return True
    if not attrs.strip() or name in KEPT:
        return False
    for m in ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            if any(_names_other(one) or one.lower() == "header" and not in_article for one in value.split()):
                return True
            continue
        value = value.lower()
        if key == "role" and value in ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def lines(page: str, forms: bool = True) -> list[tuple[str, int, str, bool]]:
    """(text, characters outside of links, the element that sets it apart or "", in article) of each line in
    page order. Without forms, forms set nothing apart."""
    out: list[tuple[str, int, str, bool]] = []
    parts: list[str] = []
    own: list[str] = []
    skip, depth, article, left, in_link = "", 0, 0, 0, False
    held = 0  # open elements inside what is set apart whose end tag is needed
    hidden, within, blocks = "", 0, 0  # an element inside a line of which nothing is shown

    def close() -> None:
        nonlocal parts, own
        text = SPACE.sub(" ", htmllib.unescape("".join(parts))).strip()
        if text:
            plain = SPACE.sub(" ", htmllib.unescape("".join(own))).strip()
            out.append((text, len(plain) if any(map(str.isalnum, plain)) else 0, skip, article > 0))
        parts, own = [], []

    def add(text: str) -> None:
        parts.append(text)
        if not in_link:
            own.append(text)

    for m in TOKEN.finditer(page):
        if not hidden:
            add(page[left : m.start()])
        left = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        end, attrs = bool(m["end"]), m["attrs"].removesuffix(">")
        opens = not end and name not in VOID and not attrs.rstrip().endswith("/")
        if hidden:
            if name == hidden and (opens or end):
                within += -1 if end else 1
            elif name not in INLINE and (opens or end):
                blocks += -1 if end else 1
            if within and blocks >= 0:
                continue
            hidden = ""
            if not within and blocks >= 0:
                continue
        if name == "br":
            add(" ")
        elif name not in INLINE:
            close()
        if name == "a":
            in_link = not end
        if name in ("article", "main"):
            if skip and not end and skip not in ("article", "main"):
                skip, depth = "", 0  # what stays open before an article ends there
            article = max(0, article + (-1 if end else 1)) if not skip else article
        if skip in ENDED_BY and not held and (opens and name in ENDED_BY[skip] or end and name != skip and name not in INLINE and name not in ENDED_BY):
            close()
            skip, depth = "", 0  # its end tag was left out
        if skip:
            if name == skip and (opens or end):
                depth += -1 if end else 1
                if not depth:
                    close()
                    skip = ""
            elif end and name in ("body", "html"):
                skip, depth = "", 0
            elif (opens or end) and name not in INLINE and name not in ENDED_BY:
                held = max(0, held + (-1 if end else 1))
        elif opens and _apart(name, attrs, article > 0, forms):
            if name in INLINE:
                hidden, within, blocks = name, 1, 0
                in_link = False if name == "a" else in_link
            else:
                close()
                skip, depth, held = name, 1, 0
    if not hidden:
        add(page[left:])
    close()
    return out


def sums(weights: list[int], window: int) -> list[int]:
    """The distribution: the sum of each window of lines; a page of fewer lines is one window."""
    upto = list(accumulate(weights, initial=0))
    window = max(1, min(window, len(weights)))
    return [upto[i + window] - upto[i] for i in range(len(weights) - window + 1)] if weights else []


def stretches(weights: list[int], window: int) -> list[tuple[int, int, int]]:
    """(surge, dive, highest sum) of each run of lines that no sum of zero covers."""
    found = sums(weights, window)
    size = len(weights) - len(found) + 1
    out, start = [], 0
    for i, total in enumerate([*found, 0]):
        if total:
            continue
        stop = i if i < len(found) else len(weights)
        if stop > start:  # a dive
            out.append((start, stop, max(found[max(0, start - size + 1) : min(stop, len(found))])))
        start = i + size  # the earliest line behind this window, where a surge may be
    return out


def weighed(found: list[tuple[str, int, str, bool]], window: int) -> tuple[list[int], list[int]]:
    """(weights, places): the lines' weights with blank lines in front, behind and between, and each weight's
    line, or -1 for a blank one. Lines set apart, and those outside where there is an article, come in stretches
    of ``window`` places or more."""
    named = any(inside and not apart for _, _, apart, inside in found)
    weights, places, run = [0] * window, [-1] * window, window

    def fill() -> None:
        blank = window - run if 0 < run < window else 0
        weights.extend([0] * blank)
        places.extend([-1] * blank)

    for i, (text, plain, apart, inside) in enumerate(found):
        other = bool(apart) or named and not inside
        if not other:
            fill()
        run = run + 1 if other else 0
        weights.append(0 if other else len(text) if named else plain)
        places.append(i)
    fill()
    return weights + [0] * window, places + [-1] * window


def main_text(page: str | None, window: int = WINDOW) -> str:
    """The lines between surge and dive points, joined by one newline."""
    found = lines(page or "")
    total = lambda x: sum(len(line[0]) for line in x)
    if total(x for x in found if x[2] == "form") > FRAME * total(found):
        found = lines(page or "", forms=False)
    weights, places = weighed(found, window)
    return "\n".join(found[places[i]][0] for a, b, _ in stretches(weights, window) for i in range(a, b) if places[i] >= 0)


def extract(pages: DataFrame, window: int = WINDOW) -> DataFrame:
    """For each row of pages (page_id, url, html): page_id, url, text, n_chars (code points).

    Null or empty html gives an empty text, so do pages without a line that counts. Nulls in other
    columns and repeated rows pass through, other columns are ignored, an empty table gives no rows.
    """
    def each(batches):
        for d in rows(batches, 250):
            texts = [main_text(h, window) for h in d["html"]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(d["page_id"], pa.int64()), pa.array(d["url"], pa.string()), pa.array(texts, pa.string()),
                 pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return chosen.mapInArrow(each, "page_id long, url string, text string, n_chars long")
