"""Main text of web pages by two-pass block rules.

The first pass labels each block by its link density, length and
stop-word density: good, bad, or undecided if it is short. Standing in an article's
element lowers what is asked of a block, and standing outside the page's articles raises it. The second pass
gives undecided blocks the label of their nearest decided neighbours of the same kind of place.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corpuslab.llm.common import bounded_batches

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    """a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was were which with you
    aber als am an auch auf aus bei das dass dem den der des die durch ein eine einen einer er es für hat ich im in ist mit nach nicht noch oder sich sie sind so über um und von vor war was wie wir wird zu zum zur
    au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous
    al como con cual del el ella entre era es esta fue ha hay la las lo los más me mi muy no nos o para pero por que se ser si sin sobre su sus también una uno y ya""".split()
)
# Frequent function words of further languages, each held against a block on its own.
OTHER_WORDS = tuple(
    frozenset(w.split())
    for w in (
        "a ai al alla anche che chi ci come con cui da dal dalla dei del della delle di e è ed gli ha hanno i il in io la le lo loro ma nel nella non o per più quando questa questo se si sono su sua suo tra un una uno",
        "a ao aos as com como da das de do dos e é ela ele em entre era essa esta eu foi há isso já mais mas não na nas no nos o os ou para pela pelo por que se sem ser seu sua são também um uma",
        "aan al als bij dan dat de der deze die dit door een en er geen had heeft het hij hun ik in is je kan maar meer met naar niet nog of om onder ook op over te toen tot uit van veel voor was wat werd wordt ze zich zijn",
        "a ale bo był była było by być co czy dla do gdy go i ich im jak jako je jego jej jest już ku lub ma może na nad nie o od oraz po pod przez przy są się tak także tego ten to tym w we z za ze że",
        "а без был была были было быть в вы где да для до его ее если есть же за и из или им их к как ко когда который ли мы на не него нет но о об он она они от по под при с со так также то только у что чтобы это этот я",
        "att av de den det där eller en ett från för ha han har hade hon i inte jag kan med men när och om på sig sin som så till under upp var vi vid är över",
        "bir bu çok da daha de değil diye en gibi her için ile ise kadar ki mi ne o olan olarak oldu olduğu sonra şey var ve veya ya",
    )
)
# Letters of scripts that are written without spaces, and marks that end sentences.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")
ENDS = re.compile("[.!?\u3002\uff01\uff1f\u0964\u06d4\u061f\u104b]")
# Elements that are never text of an article, and those that start a block.
DROPPED = frozenset("script style noscript template head title nav footer aside form button select option textarea input iframe object svg math canvas audio video dialog menu datalist figure-embed map".split())
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "noscript", "template", "textarea", "title", "iframe"))
# Words of class and id names, and roles, of page furniture.
FURNITURE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed|s)?|promo(?:tion)?s?|banners?|cookies?|consent|gdpr|notices?|alerts?|popups?|pop-up|modals?|overlay|newsletters?|subscribe|subscription|signup|login|sidebars?|sidebar|side|aside|nav|navs?|navbar|navigation|menus?|breadcrumbs?|footers?|masthead|topbar|toolbar|share|sharing|social|related|recommended|recommendations|more-stories|widgets?|pagination|pager|comments?|commentlist|comment-list|discussion|replies|reply|responses|disqus|site-header|page-header|skip|copyright|legal|disclaimer|hidden)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar".split())
MARKUP = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|$)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[^\W\d_]+")

#: Links' share of the characters beyond which a block is furniture; words of a short and of a long block; stop words' shares.
MOST_LINKS, SHORT, LONG, FEW, MANY = 0.5, 8, 30, 0.15, 0.25


class Block:
    __slots__ = ("article", "bad", "heading", "label", "linked", "parts")

    def __init__(self, bad: bool, article: bool, heading: bool):
        self.parts, self.linked, self.bad, self.article, self.heading, self.label = [], 0, bad, article, heading, ""


def blocks_of(page: str) -> list[tuple[str, Block]]:
    """Blocks of a page with text, in order; markup errors never raise."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []  # name, in furniture, in the article
    links, now, at = 0, None, 0
    raw = None

    def add(text: str) -> None:
        nonlocal now
        if not text or (raw and raw != "title"):
            return
        if now is None:
            bad, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            now = Block(bad, article, bool(stack) and stack[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6"))
            out.append(now)
        now.parts.append(text)
        if links:
            now.linked += len("".join(text.split()))

    for m in MARKUP.finditer(page):
        if m.start() < at:
            continue
        add(html.unescape(page[at : m.start()]))
        at = m.end()
        close, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>"))
            continue
        name = name.lower()
        if not close and name in RAW:
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            now = None if name in BLOCKS else now
            continue
        if name in ("br", "wbr"):
            if name == "br":
                add(" ")
            continue
        if name in VOID:
            now = None if name in BLOCKS else now
            continue
        if close:
            if name == "a":
                links = max(0, links - 1)
            if any(x[0] == name for x in stack):
                while stack.pop()[0] != name:
                    pass
            now = None if name in BLOCKS else now
            continue
        if attrs.rstrip().endswith("/") and name not in BLOCKS and name not in DROPPED:
            continue
        bad, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        given = {a.lower(): b or c or d for a, b, c, d in ATTRIBUTE.findall(attrs)} if attrs.strip() else {}
        named = f"{given.get('class', '')} {given.get('id', '')}"
        if name in ("body", "html", "article", "main"):  # layout classes of the whole page say nothing
            furniture = given.get("role", "").lower() in ROLES or (name == "article" and bool(re.search(r"(?:^|[\s_-])comments?(?:$|[\s_-])", named, re.I)))
        else:
            furniture = name in DROPPED or bool(FURNITURE.search(named)) or given.get("role", "").lower() in ROLES or "hidden" in given or given.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", given.get("style", ""), re.I))
        if name == "header":
            furniture = furniture or not article
        if name in BLOCKS:
            if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option") or name[0] == "h" and name[1:].isdigit():
                # an open paragraph, item or cell of this kind ends here
                ending = ("p",) if name == "p" or name[0] == "h" else (name, "p")
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ending:
                        bad, article = (stack[i - 1][1], stack[i - 1][2]) if i else (False, False)
                        del stack[i:]
                        break
                    if stack[i][0] in BLOCKS:
                        break
            now = None
        if name == "a":
            links += 1
        elif name in BLOCKS and links:
            links = 0
        stack.append((name, bad or furniture, article or name in ("article", "main") or given.get("role", "").lower() in ("main", "article") or given.get("itemprop") == "articleBody"))
    add(html.unescape(page[at:]))
    found = []
    for b in out:
        text = " ".join("".join(b.parts).split())
        if text:
            found.append((text, b))
    return found


def _words(text: str) -> tuple[list[str], int]:
    """Lower-cased words, and their number; two letters of a script without spaces count as one."""
    words = [w.lower() for w in WORDS.findall(text)]
    return words, sum(max(1, len(w) // 2) if UNSPACED.match(w) else 1 for w in words)


def _density(words: list[str]) -> float:
    """Stop words' share, by the list that fits best."""
    return max(sum(w in known for w in words) for known in (STOP_WORDS, *OTHER_WORDS)) / max(1, len(words))


def _first_pass(text: str, b: Block, in_article: bool, fits: bool) -> str:
    if b.bad:
        return "bad"
    words, size = _words(text)
    solid = len("".join(text.split()))
    if b.linked > MOST_LINKS * solid:
        # a link alone in running text is a short block; a list of links is furniture
        return "bad" if len(words) > 1 or not b.article else "short"
    if size < SHORT:
        return "short"
    if not fits:
        # a language without a list: length and sentences
        return "good" if (b.article or size >= LONG) and ENDS.search(text) else "short"
    share = _density(words)
    if b.article:
        # sentences of few stop words go by their neighbours; a list of words does not
        return "good" if share >= FEW or size < LONG and share >= FEW / 2 else "short" if size < LONG or ENDS.search(text) else "bad"
    if in_article:
        return "good" if size >= LONG and share >= MANY else "short" if size < LONG else "bad"
    if share >= MANY or size >= LONG and share >= FEW:
        return "good"
    return "short" if size < LONG else "bad"


def main_text(page: str | None) -> str:
    """The page's article: its blocks joined by two line ends; empty for null, empty or article-less pages."""
    if not page:
        return ""
    found = blocks_of(page)
    in_article = any(b.article and not b.bad for _, b in found)
    fits = _density(_words(" ".join(t for t, b in found if not b.bad))[0]) >= FEW
    labels = [_first_pass(t, b, in_article, fits) for t, b in found]
    places = [b.article for _, b in found]
    keep = []
    for i, label in enumerate(labels):
        if label == "short":
            near, inside = [], places[i]
            for step in (-1, 1):
                j = i + step
                # neighbours of the same container count; furniture inside an article says nothing of its text
                while 0 <= j < len(labels) and (labels[j] == "short" or places[j] != inside and not found[j][1].bad or inside and (not places[j] or found[j][1].bad)):
                    j += step
                if 0 <= j < len(labels):
                    near.append((abs(j - i), labels[j]))
            if not near:
                label = "good" if inside else "bad"
            elif len(near) == 2 and near[0][1] != near[1][1]:
                label = "good" if inside or found[i][1].heading and near[1][1] == "good" else min(near)[1] if near[0][0] != near[1][0] else "bad"
            else:
                label = near[0][1] if not inside or near[0][1] == "good" else "bad"
        if label == "good":
            keep.append(found[i][0])
    return "\n\n".join(keep)


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)``, a row for each row of ``pages(page_id, url, html)``.

    Null and empty html give empty text; whole pages are read, whatever their
    length. Rows that repeat each get their row; other columns are ignored.
    """
    bounded_batches(pages.sparkSession)
    pages = pages.select("page_id", "url", "html")

    @F.pandas_udf(StringType())
    def text(html_: pd.Series) -> pd.Series:
        return html_.map(lambda x: main_text(x) if isinstance(x, str) else "")

    return pages.select("page_id", "url", text("html").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
