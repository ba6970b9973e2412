"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks."""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*)>?|[^<]+|<", re.DOTALL)
_ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements that begin and end a block, those without content, and those whose content isn't text. Fixed values.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hr html iframe label legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template".split())
#: An element on the left ends open ones on the right.
ENDS = {"p": {"p"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of class, id and role names that tell something, by their beginnings. Fixed values.
NAMES = "ad ads adv advert sponsor promo banner cookie consent notice alert popup modal overlay nav menu breadcrumb crumb tab header masthead logo top footer bottom copyright legal sidebar side aside widget rail related recommend share social comment reply respond discuss thread form search login subscribe newsletter signup tag meta byline author date pagination pager content article main post entry body text story page".split()


def leaf_blocks(page: str) -> Iterator[tuple[str, list[str]]]:
    """Text and features of each leaf block of a page, in order.

    Broken markup doesn't stop it: tags that end nothing are skipped, what stays open ends with the page.
    """
    stack: list[Node] = []
    open_: Counter[str] = Counter()
    parts: list[str] = []
    linked, at, n = 0, 0, len(page)

    def block() -> tuple[str, list[str]] | None:
        nonlocal linked
        text = " ".join(entities.unescape("".join(parts)).split())
        share, linked = linked / max(1, sum(map(len, parts))), 0
        parts.clear()
        return (text, features(text, share, stack[-1] if stack else Node())) if text else None

    def close(k: int) -> None:
        while len(stack) > k:
            open_[stack.pop().tag] -= 1

    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        if (tag := m[2]) is None:
            if (piece := m[0])[:1] != "<" or piece == "<":
                parts.append(piece)
                if open_["a"]:
                    linked += len(piece)
            continue
        tag = tag.lower()
        if tag in BLOCKS and parts and (found := block()):
            yield found
        if m[1]:
            if open_[tag]:
                close(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag))
            if tag not in BLOCKS and not parts:
                continue
        elif tag in RAW:
            end = None if m[3].rstrip().endswith("/") else re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(page, at)
            # The rest of a page belongs to a script or style that stays open, as browsers read it.
            at = end.end() if end else at if m[3].rstrip().endswith("/") or tag == "template" else n
        elif tag == "br" or tag in VOID:
            parts.append(" ")
        else:
            closes = ENDS.get(tag) or ({"p"} if tag in BLOCKS else set())
            if any(open_[c] for c in closes):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag in closes:
                        close(k)
                        break
                    if stack[k].tag in BLOCKS and stack[k].tag != "p":
                        break
            stack.append((stack[-1] if stack else Node()).child(tag, names(m[3]) if "=" in m[3] else ()))
            open_[tag] += 1
    if parts and (found := block()):
        yield found


@dataclass(frozen=True)
class Node:
    """An open element: its tag, the features of it and its ancestors, and the nearest block. Depth costs nothing, since features are shared."""

    tag: str = ""
    above: frozenset[str] = frozenset()
    block: str = "none"

    def child(self, tag: str, called: tuple[str, ...]) -> Node:
        more = {f"in:{tag}", *(f"name:{x}" for x in called)}
        return Node(tag, self.above if more <= self.above else self.above | more, tag if tag in BLOCKS else self.block)


def names(attributes: str) -> tuple[str, ...]:
    words = (w.lower() for a in _ATTRIBUTE.finditer(attributes) for w in _NAME.findall(a[2] or a[3] or a[4] or ""))
    return tuple(x for w in words for x in NAMES if w == x or len(x) > 3 and w.startswith(x))


def features(text: str, links: float, within: Node) -> list[str]:
    """Ancestors by tag and by name, the nearest block, and what the text looks like."""
    found = set(within.above)
    count = text.count(" ") + 1
    found.add(f"own:{within.block}")
    found.add(f"words:{min(6, count.bit_length())}")
    found.add(f"links:{int(4 * links)}")
    found.add(f"end:{'stop' if text[-1] in '.!?:…' else 'none'}")
    found.add(f"commas:{min(3, text.count(','))}")
    if "©" in text or "copyright" in text.lower():
        found.add("sign:copyright")
    return sorted(found)


@dataclass
class Crf:
    """A chain of two labels: log odds of each feature for main text, and log odds of label pairs."""

    weights: dict[str, float]
    pairs: np.ndarray

    def decode(self, blocks: list[list[str]]) -> list[bool]:
        """The likeliest labels, by Viterbi."""
        if not blocks:
            return []
        odds = [self.weights.get("bias", 0.0) + sum(self.weights.get(f, 0.0) for f in fs) for fs in blocks]
        (p00, p01), (p10, p11) = self.pairs.tolist()
        low, high, back = 0.0, odds[0], []
        for x in odds[1:]:
            a, b, c, d = low + p00, high + p10, low + p01, high + p11
            back.append((a < b, c < d))
            low, high = max(a, b), max(c, d) + x
        labels = [high > low]
        for to_low, to_high in reversed(back):
            labels.append(to_high if labels[-1] else to_low)
        return labels[::-1]


def fit(pages: Iterable[tuple[str, set[str]]], steps: int = 150, rate: float = 0.15, shrink: float = 0.02) -> Crf:
    """Conditional maximum likelihood over labelled pages: their html, and the texts of their blocks that are main text.

    Gradients are expected less observed counts, from forward and backward sums in log space over all pages at once.
    """
    seen = [(list(leaf_blocks(page)), main) for page, main in pages]
    seen = [x for x in seen if x[0]]
    vocabulary = {f: k for k, f in enumerate(["bias", *sorted({f for blocks, _ in seen for _, fs in blocks for f in fs})])}
    longest, count = max(len(b) for b, _ in seen), len(seen)
    gold, mask = np.zeros((count, longest), int), np.zeros((count, longest), bool)
    cell, feature = [], []
    for i, (blocks, main) in enumerate(seen):
        for t, (text, fs) in enumerate(blocks):
            gold[i, t], mask[i, t] = text in main, True
            for f in ("bias", *fs):
                cell.append(i * longest + t)
                feature.append(vocabulary[f])
    cell, feature = np.array(cell), np.array(feature)
    w, pairs = np.zeros(len(vocabulary)), np.zeros((2, 2))
    moments = [(np.zeros_like(w), np.zeros_like(w)), (np.zeros_like(pairs), np.zeros_like(pairs))]
    both = mask[:, 1:] & mask[:, :-1]
    observed = np.array([[((gold[:, :-1] == a) & (gold[:, 1:] == b) & both).sum() for b in (0, 1)] for a in (0, 1)])
    for step in range(1, steps + 1):
        odds = np.bincount(cell, w[feature], count * longest).reshape(count, longest)
        unary = np.stack([np.zeros_like(odds), odds], 2)
        forward, backward = np.zeros((count, longest, 2)), np.zeros((count, longest, 2))
        forward[:, 0] = unary[:, 0]
        for t in range(1, longest):
            forward[:, t] = unary[:, t] + np.where(mask[:, t, None], np.logaddexp.reduce(forward[:, t - 1, :, None] + pairs, axis=1), 0)
        for t in range(longest - 2, -1, -1):
            backward[:, t] = np.where(mask[:, t + 1, None], np.logaddexp.reduce(pairs + (unary[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2), 0)
        joint = forward + backward
        total = np.logaddexp(joint[..., 0], joint[..., 1])
        high = np.where(mask, np.exp(joint[..., 1] - total), 0)
        edge = forward[:, :-1, :, None] + pairs + (unary[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, 1:, None, None]
        expected = np.exp(np.where(both[..., None, None], edge, -np.inf)).sum((0, 1))
        slopes = (np.bincount(feature, (high - gold * mask).ravel()[cell], len(w)) + shrink * w, expected - observed + shrink * pairs)
        for value, slope, (m, v) in zip((w, pairs), slopes, moments, strict=True):
            m += 0.1 * (slope - m)
            v += 0.01 * (slope**2 - v)
            value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf({f: float(w[k]) for f, k in vocabulary.items()}, pairs)


def labelled_pages(count: int = 300, seed: int = 0) -> Iterator[tuple[str, set[str]]]:
    """Pages with known main text: layouts, containers and names as they are common on the web, words at random."""
    rng = random.Random(seed)
    syllables = ["".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiouy") for _ in range(rng.randint(1, 3))) for _ in range(400)]

    def words(low: int, high: int, stop: bool = False) -> str:
        text = " ".join(rng.choices(syllables, k=rng.randint(low, high))).capitalize()
        if stop:
            text = re.sub(r"(\w+ \w+ \w+ \w+) (?=\w)", lambda m: m[1] + rng.choice([" ", " ", ", ", ". "]), text) + rng.choice(".....!?")
        return f"{text} {next(serial)}" if not stop else f"{text[:-1]} {next(serial)}{text[-1]}"

    serial = iter(range(10**9))

    def sentences() -> str:
        return words(*rng.choice([(1, 4), (4, 15), (10, 60), (40, 160)]), stop=rng.random() < 0.9)

    def links(n: int, wrap: str) -> str:
        return "".join(f'<{wrap}><a href="/{k}">{words(1, 4)}</a></{wrap}>' for k in range(n))

    def named(options: str) -> str:
        tag, _, name = rng.choice(options.split()).partition(".")
        return f"<{tag}" + (f' {rng.choice(["class", "class", "id"])}="{name.replace("+", " ")}"' if name else "") + ">", f"</{tag}>"  # type: ignore[return-value]

    def within(options: str, inner: str) -> str:
        begin, end = named(options)
        return begin + inner + end

    for _ in range(count):
        main: set[str] = set()

        def keep(text: str, main: set[str] = main) -> str:
            main.add(text)
            return text

        advert = lambda: within("div.ad div.ads div.advert div.sponsored aside.promo div.banner-ad section.ad-slot div.ad", rng.choice([words(2, 25, True), f"<p>{sentences()}</p>", f'<a href="#">{words(2, 6)}</a>']))
        menu = lambda: within("nav nav.menu div.nav div.menu ul.navbar nav div.main-nav", "<ul>" + links(rng.randint(2, 9), "li") + "</ul>" if rng.random() < 0.7 else links(rng.randint(2, 8), "span"))
        notice = lambda: within("div.cookie-notice div.notice div.consent div.alert section.notice dialog div.cookie-banner", f"<p>{sentences()}</p>" + f"<button>{words(1, 2)}</button>" * (rng.random() < 0.5))
        form = lambda: within("form form.search div.newsletter div.subscribe-form", f"<form><label>{words(1, 4)}</label><input name=x><button>{words(1, 2)}</button></form>")
        aside = lambda: within("aside div.sidebar aside.sidebar section.related div.widget div.related-posts", f"<h3>{words(1, 4)}</h3>" + ("<ul>" + links(rng.randint(2, 6), "li") + "</ul>" if rng.random() < 0.6 else f"<p>{sentences()}</p>" * rng.randint(1, 1) + f"<p>{sentences()}</p>"))
        comments = lambda: within("div.comments section.comments ol.comment-list div.comment-thread section.reader-comments div.discussion", "".join(within("div.comment article.comment li.comment p", f"<b>{words(1, 2)}</b> {sentences()}") for _ in range(rng.randint(1, 5))))

        def paragraph() -> str:
            text = keep(sentences())
            kind = rng.random()
            if kind < 0.7:
                mark = rng.choice(["<p>{}</p>", "<p>{}", "<p><b>{}</b></p>", "<p>{}<br></p>"])
                return mark.format(text)
            if kind < 0.78:
                return f"<blockquote><p>{text}</p></blockquote>"
            if kind < 0.86:
                return "<ul>" + "".join(f"<li>{keep(sentences())}</li>" for _ in range(rng.randint(1, 4))) + f"<li>{text}</li></ul>"
            if kind < 0.92:
                return f"<h2>{keep(words(1, 6))}</h2><div>{text}</div>"
            if kind < 0.96:
                return f"<table><tr><td>{text}</td><td>{keep(words(1, 3))}</td></tr></table>"
            return f"<pre>{text}</pre>"

        content = [f"<h1>{keep(words(1, 9))}</h1>"] * (rng.random() < 0.8)
        for _ in range(rng.randint(1, 9)):
            content.append(paragraph())
            if rng.random() < 0.08:
                content.append(rng.choice([advert, advert, aside, notice, form])())
        begin, end = named("article article article.post main div.content div.article-body div.post section.story main.main-content div.entry-content article.content")
        if begin.startswith("<div") and rng.random() < 0.3:
            begin, end = f"<main>{begin}", f"{end}</main>"
        body = [begin, *content, end if rng.random() < 0.95 else ""]
        before = [x() for x in (menu, advert, notice, form) if rng.random() < (0.8 if x is menu else 0.35)]
        if rng.random() < 0.4:
            before.insert(0, within("header div.header header.site-header div.masthead", f"<a href=/>{words(1, 3)}</a>" + f"<p>{words(2, 10, True)}</p>" * (rng.random() < 0.6)))
        after = [x() for x in (aside, comments, advert, form, notice) if rng.random() < 0.35]
        if rng.random() < 0.85:
            after.append(within("footer footer.site-footer div.footer div.copyright footer", rng.choice([f"&copy; {words(1, 6)}", f"<p>{words(2, 20, True)}</p>", f"&copy; {words(1, 4)} <a href=/>{words(1, 2)}</a>", "<ul>" + links(3, "li") + "</ul>"])))
        rng.shuffle(before)
        head = f"<head><title>{words(1, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>"
        yield f"<!DOCTYPE html><html>{head}<body>{''.join(before + body + after)}</body></html>", main


_FITTED: dict[tuple[int, int], Crf] = {}


def trained(count: int = 300, seed: int = 0) -> Crf:
    if (count, seed) not in _FITTED:
        _FITTED[count, seed] = fit(labelled_pages(count, seed))
    return _FITTED[count, seed]


def extract(page: str | None, model: Crf) -> str:
    """Main text of one page: its blocks that the model keeps, one line each."""
    blocks = list(leaf_blocks(page or ""))
    return "\n".join(text for (text, _), keep in zip(blocks, model.decode([f for _, f in blocks]), strict=True) if keep)


def extract_pages(pages: DataFrame, model: Crf | None = None) -> DataFrame:
    """page_id, url and the main text of every page, with its length in code points.

    Takes page_id, url and html and ignores other columns. A null or empty html, or a page without main text,
    gives an empty text; broken markup is read as far as it goes; repeated rows are done each; an empty table gives no rows.
    The model is fitted by the driver on generated labelled pages, whose number is a parameter, and sent along.
    """
    ship(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p.as_py(), sent.value) for p in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")
