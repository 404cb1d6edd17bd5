"""Main text of raw web pages by two-pass block rules.

A page is cut into blocks at block-level tags. The first pass labels each block from its own length, stop-word density and
link density: good, bad, near (close to good) or short. Blocks inside navigation, footers, sidebars, forms, adverts, notices or
reader comments are boilerplate whatever their words. The second pass settles near and short blocks: they take the label of
their nearest decided neighbours in the same article (or page, where no article is marked).

Stop words are listed for four languages. Blocks in other scripts, and all blocks of a page without an article mark on which no block is
good, are judged by length and links alone; if none is good even then, every block stays that isn't bad. Inside an article a part whose
class or id is a word that may also name a subject ("legal", "search") is boilerplate only if it holds no good block.

Null or empty pages have an empty text. Pages are handled one by one and whole, so ties, repeated rows and skewed keys need no
care; a table without rows gives none. Markup may be broken: unclosed tags, comments and quotes end with the page.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewise.llm.common import blocks, schema_with, text_of

#: Frequent function words of the four languages; fixed values.
STOP_WORDS = frozenset(
    "a an and are as at be been but by can do for from had has have he her his how i if in into is it its more my no not of on or our out "
    "she so some than that the their them then there these they this to up was we were what when which who will with would you your "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais me même mes moi mon ne nos notre nous on ont ou par pas "
    "pour qu que qui sa se ses son sont sur ta te tes toi ton tu un une vos votre vous été "
    "aber als am auch auf aus bei bin bis bist da das dass dem den der des die doch du durch ein eine einem einen einer eines er es für hat hatte "
    "ich ihr im in ist ja kann mehr mich mir mit nach nicht noch nur oder sein sich sie sind so über um und uns unter vom von vor war was wenn "
    "wie wir wird zu zum zur "
    "al algo como con cuando de del desde donde el ella ellos en entre era es esa ese esta este fue ha hay la las le lo los más me mi muy no nos "
    "o para pero por que se sea ser si sin sobre son su sus también te tiene todo tu un una uno y ya".split()
)

#: Tags that start and end a block; fixed values.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Tags whose content is never main text; fixed values.
BOILERPLATE_TAGS = frozenset("nav footer aside form button select option label menu dialog title figcaption".split()) - {"figcaption"}
#: Elements that hold no readable text at all; fixed values.
RAW_TAGS = "script|style|noscript|template|iframe|svg|annotation-xml|annotation|object|canvas|textarea|video|audio"
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Parts of class names and ids that mark boilerplate; fixed values.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|sponsor(?:ed|s)?|promos?|promotions?|banners?|cookies?|consent|gdpr|notices?|"
    r"popups?|modals?|overlays?|toasts?|alerts?|sidebars?|side|menus?|nav|navbars?|navigation|breadcrumbs?|comments?|commentlist|disqus|replies|"
    r"responses?|footers?|foot|masthead|topbar|toolbar|share|sharing|social|related|recommended|recommendations|newsletter|"
    r"subscribe|subscription|signup|login|widgets?|pagination|pager|copyright|legal|disclaimer|skip|search)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Those of them that may also name a part of an article; fixed values.
SUBJECTS = re.compile(r"(?:^|[\s_-])(?:social|login|copyright|legal|disclaimer|skip|search|recommendations)(?:$|[\s_-])", re.IGNORECASE)
ARTICLE_MARKS = re.compile(r"(?:^|[\s_-])(?:comments?|replies|related|teasers?|cards?|promos?|ads?)(?:$|[\s_-])", re.IGNORECASE)

PIECE = re.compile(
    rf"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<(?P<raw>{RAW_TAGS})\b[^>]*>.*?(?:</(?P=raw)\s*>|$)|<[!?][^>]*(?:>|$)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?P<end2>/?)(?P<tag2>[a-zA-Z][a-zA-Z0-9:-]*)[^>]*(?:>|$)",
    re.IGNORECASE | re.DOTALL,
)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
WORD = re.compile(r"[^\W\d_]+")
#: End of the Latin letters; letters that stand for syllables or words, each of which counts as this many more characters.
LATIN_END = "\u0250"
DENSE, DENSE_WEIGHT = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\U00020000-\U0003134f]"), 2


@dataclass(frozen=True)
class Rules:
    """Thresholds of the first pass: characters, and shares of words."""

    short: int = 70
    long: int = 200
    links: float = 0.33
    stop_low: float = 0.2
    stop_high: float = 0.3


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    article: int  # number of the innermost article or main element, 0 if none
    boilerplate: bool
    heading: bool
    part: int = 0  # number of the innermost part with a doubtful class or id, 0 if none


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)} if text.strip(" /") else {}


def is_boilerplate(tag: str, attrs: dict[str, str], within_article: bool) -> bool:
    if tag in BOILERPLATE_TAGS or tag == "header" and not within_article:
        return True
    if not attrs or tag in ("html", "body"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or HIDDEN.search(attrs.get("style", "")):
        return True
    if attrs.get("role", "").lower() in BOILERPLATE_ROLES:
        return True
    marks = ARTICLE_MARKS if tag in ("article", "main") else MARKS
    names = [attrs.get(a, "") for a in ("class", "id")]
    if within_article:
        names = [SUBJECTS.sub(" ", n) for n in names]
    return any(marks.search(n) for n in names)


def is_doubtful(attrs: dict[str, str]) -> bool:
    return any(SUBJECTS.search(attrs.get(a, "")) for a in ("class", "id"))


def cut(page: str) -> list[Block]:
    """The blocks of a page in order, without empty ones."""
    out: list[Block] = []
    stack: list[tuple[str, bool, int, int]] = []  # tag, boilerplate, article, part
    pieces: list[str] = []
    linked, anchors, articles, parts, heading = 0, 0, 0, 0, False

    def close() -> None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            _, bad, article, part = stack[-1] if stack else ("", False, 0, 0)
            out.append(Block(text, min(linked, len(text)), article, bad, heading, part))
        linked = 0

    at = 0
    for m in PIECE.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            pieces.append(piece)
            if anchors:
                linked += len(" ".join(entities.unescape(piece).split()))
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            if m["raw"]:
                pieces.append(" ")
            continue
        ends = bool(m["end"] or m["end2"])
        if tag == "a":
            anchors = 0 if ends else 1
        if tag == "br":
            pieces.append(" ")
        if tag in BLOCK_TAGS:
            close()
            anchors = 0
        if tag in VOID_TAGS:
            continue
        if ends:
            if tag in BLOCK_TAGS or any(t[0] == tag for t in stack[-1:]):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
        else:
            if tag in BLOCK_TAGS or m["attrs"] and tag == "span":
                if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == tag:
                    stack.pop()
                if tag in BLOCK_TAGS and tag != "p" and stack and stack[-1][0] == "p":
                    stack.pop()
                _, bad, article, part = stack[-1] if stack else ("", False, 0, 0)
                own = attributes(m["attrs"] or "")
                bad = bad or is_boilerplate(tag, own, article > 0)
                if article and not bad and own and is_doubtful(own):
                    parts += 1
                    part = parts
                if not bad and (tag in ("article", "main") or own.get("role", "").lower() in ("main", "article")):
                    articles += 1
                    article = articles
                if tag != "span":
                    stack.append((tag, bad, article, part))
            heading = tag in ("h1", "h2", "h3", "h4", "h5", "h6") if tag in BLOCK_TAGS else heading
    if at < len(page):
        pieces.append(page[at:])
    close()
    return out


def first_pass(block: Block, rules: Rules, by_words: bool = True) -> str:
    """good, bad, near or short, from the block alone; stop words count unless ``by_words`` is off."""
    if block.boilerplate:
        return "bad"
    length = len(block.text)
    links = block.linked / length
    if links > rules.links:
        return "short" if block.article else "bad"  # the title and whole paragraphs of an article may be links
    if not block.article and block.text[:1] in "©" or "© " in block.text[:12]:
        return "bad"
    words = WORD.findall(block.text.lower())
    if not by_words or 2 * sum(w[0] < LATIN_END for w in words) < len(words):
        length += DENSE_WEIGHT * len(DENSE.findall(block.text))
        return "good" if length > rules.long else "near" if length >= rules.short else "short"
    if length < rules.short:
        return "short"
    density = sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0
    if density >= rules.stop_high:
        return "good" if length > rules.long else "near"
    if density >= rules.stop_low:
        return "near"
    return "near" if block.article else "bad"


def labelled(found: list[Block], rules: Rules) -> list[str]:
    """Labels of the first pass; blocks of doubtful parts without a good block become boilerplate."""
    labels = [first_pass(b, rules) for b in found]
    good = {b.part for b, label in zip(found, labels, strict=True) if label == "good"}
    for i, b in enumerate(found):
        if b.part and b.part not in good:
            b.boilerplate, labels[i] = True, "bad"
    if "good" not in labels and not any(b.article and not b.boilerplate for b in found):
        labels = [first_pass(b, rules, by_words=False) for b in found]
    return labels


def second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    """Whether each block is main text. Undecided blocks follow their nearest decided neighbours in the same article."""
    if "good" not in labels and not any(b.article and not b.boilerplate for b in found):
        return [label != "bad" for label in labels]
    keep = [label == "good" for label in labels]
    for article in sorted({b.article for b in found}):
        members = [i for i, b in enumerate(found) if b.article == article and not b.boilerplate]
        decided = [labels[i] in ("good", "bad") for i in members]
        before: list[str | None] = []
        last = None
        for i, d in zip(members, decided, strict=True):
            before.append(last)
            last = labels[i] if d else last
        last, after = None, [None] * len(members)
        for k in range(len(members) - 1, -1, -1):
            after[k] = last
            last = labels[members[k]] if decided[k] else last
        for k, i in enumerate(members):
            if decided[k]:
                continue
            around = {before[k], after[k]} - {None}
            if article:  # the author marked this region: it counts as good unless all around says otherwise
                keep[i] = around != {"bad"}
            elif around == {"good"} or labels[i] == "near":
                keep[i] = "good" in around or labels[i] == "near" and not around
            else:  # a short block at the edge of the text: headings belong to what follows
                keep[i] = found[i].heading and after[k] == "good"
    return keep


def main_text(page: str, rules: Rules = Rules()) -> str:
    """Main text of one page, one line a block."""
    found = cut(page)
    keep = second_pass(found, labelled(found, rules))
    if any(k and b.article for b, k in zip(found, keep, strict=True)):  # an article is marked: nothing outside it belongs to it
        keep = [k and b.article > 0 for b, k in zip(found, keep, strict=True)]
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, html: str = "html", rules: Rules = Rules()) -> DataFrame:
    """``pages`` without the markup, plus ``text`` and ``n_chars``."""
    keep = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    rows = pages.select(*keep, text_of(html).alias("_html"))
    schema = schema_with(rows.drop("_html"), "text", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "_html"):
            texts = pa.array([main_text(page, rules) for page in batch.column("_html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), texts], [*keep, "text"])

    return rows.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))
