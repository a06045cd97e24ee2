"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page becomes a tree of its block elements; inline elements belong to the block around them.
Each node has features of its tag, its attribute tokens, its depth, its siblings and the
density of text and links in its subtree.  Spark's gradient-boosted trees, fitted here on a
bounded sample, give each node the odds of being article text.

Decoding picks the likeliest labels that fit together: on any path from the root there is first
frame, then article, then parts cut out of the article.  Nothing below a part that is cut out
comes back, and no article lies inside another's cut-out part.  One pass up and one down the
tree find the best such choice.

Training takes at most ``sample_pages`` pages of up to ``sample_bytes`` each, chosen by a hash
of page_id.  Labels are weak: text inside ``article`` or ``main`` is article text, unless a
navigation, aside, form, header or footer element is nearer.  Beside each page stand
``layouts`` pages set from its own paragraphs with known labels: other frames, plain ``div``
elements for semantic ones, sidebars, notices, forms and reader comments.

A null or empty html, or one without article text, gives an empty text.  Rows may repeat; a
null url or page_id is carried along.  An empty table gives no rows (and trains nothing).
"""

from __future__ import annotations

import html as html_lib
import math
import random
import re
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.workers import by_value
from riskloom.plans.staging import stage

#: Their content is no markup; all other text of a page is left to the trees.
RAW = {"script", "style", "title", "textarea"}
#: Nodes that may stand in a paragraph and do not end it.
EMBEDDED = {"noscript", "template", "iframe", "svg", "math", "select", "button", "object", "canvas", "audio", "video"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small",
    "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "input", "picture", "source", "nobr", "ruby", "rt", "rp", "data",
}
VOID = {"area", "base", "col", "embed", "hr", "link", "meta", "param", "track", "frame", "keygen"}
#: A start tag on the left ends an open element on the right.
ENDED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ARTICLE = {"article", "main"}
FRAME = {"nav", "aside", "footer", "header", "form", "menu", "dialog"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
GOOD_TOKENS = {"article", "articlebody", "main", "content", "post", "entry", "story", "body", "text", "blog"}
BAD_TOKENS = {
    "ad", "ads", "adv", "advert", "advertisement", "banner", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation", "menu", "breadcrumb",
    "breadcrumbs", "header", "masthead", "topbar", "footer", "foot", "copyright", "legal", "sidebar", "side", "aside", "rail", "widget", "related", "recommended",
    "share", "sharing", "social", "comment", "comments", "reply", "replies", "respond", "discussion", "disqus", "cookie", "cookies", "consent", "gdpr", "notice",
    "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "form", "search", "searchbox", "pagination", "pager", "tags", "toolbar",
}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|(?P<text>[^<]+|<)", re.S
)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|data-y)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
FEATURES = [
    "paragraph", "heading", "list", "table", "article_tag", "frame_tag", "plain_box", "quote", "good_tokens", "bad_tokens", "under_article", "under_frame",
    "under_good", "under_bad", "depth", "children", "place", "siblings", "same_tag", "own_length", "length", "link_share", "paragraphs", "points", "per_block", "share_of_parent",
    "share_of_page", "begins_at", "sibling_length", "before_length",
]


class Page:
    """Block elements of a page in order of their start tags, and its runs of text."""

    def __init__(self, text: str, labelled: bool = False):
        """``labelled`` pages are those of ``_layout``, with their labels in data-y."""
        self.tag, self.parent, self.tokens, self.label = ["#page"], [-1], [()], [None]
        self.runs: list[tuple[int, str, int]] = []  # block, text, characters of it in links
        stack, tags, held, link, linked = [0], ["#page"], [], 0, 0
        at, size = 0, len(text)

        def flush() -> None:
            nonlocal linked
            if held:
                run = " ".join("".join(held).split())
                if run:
                    self.runs.append((stack[-1], run, min(linked, len(run))))
                held.clear()
            linked = 0

        def close(depth: int) -> None:
            flush()
            del stack[depth:], tags[depth:]

        while at < size:
            m = TOKEN.match(text, at)
            at = m.end()
            kind = m.lastgroup
            if kind == "text":
                piece = m.group("text")
                if "&" in piece:
                    piece = html_lib.unescape(piece)
                held.append(piece)
                if link:
                    linked += len(piece)
                continue
            tag = m.group("tag")
            if tag is None:
                continue
            tag = tag.lower()
            if m.group("close"):
                if tag == "a":
                    link = max(0, link - 1)
                elif tag not in INLINE and tag in tags[1:]:
                    close(len(tags) - 1 - tags[::-1].index(tag))
                    link = 0
                continue
            if tag == "br":
                held.append(" ")
            elif tag == "a":
                link += 1
            elif tag in INLINE:
                pass
            elif tag in RAW:
                if not m.group("attrs").endswith("/"):
                    end = re.compile(f"</{tag}[^>]*>", re.I).search(text, at)
                    at = end.end() if end else size
            elif tag in VOID or (tag in EMBEDDED and m.group("attrs").endswith("/")):
                flush()
            else:
                inside = next((d for d in range(len(tags) - 1, 0, -1) if tags[d] in EMBEDDED), 0)
                if inside and m.group("attrs").endswith("/"):
                    continue
                flush()
                link = 0
                if tag not in EMBEDDED and "p" in tags[inside:]:  # any block ends an open paragraph
                    close(len(tags) - 1 - tags[::-1].index("p"))
                ended = ENDED.get(tag)
                if ended:
                    for d in range(len(tags) - 1, 0, -1):
                        if tags[d] in ended:
                            close(d)
                            break
                        if tags[d] in ("ul", "ol", "dl", "table"):
                            break
                attrs = m.group("attrs")
                words, label = (), None
                if "=" in attrs:
                    found = [(k.lower(), v.strip("\"'")) for k, v in ATTRIBUTE.findall(attrs)]
                    words = tuple(w for k, v in found if k != "data-y" for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", v).lower()) if w)
                    label = next((int(v) for k, v in found if k == "data-y"), None) if labelled else None
                self.tag.append(tag)
                self.parent.append(stack[-1])
                self.tokens.append(words)
                self.label.append(label)
                stack.append(len(self.tag) - 1)
                tags.append(tag)
        flush()

    def features(self) -> np.ndarray:
        n = len(self.tag)
        parent = self.parent
        own, links, points, begin = [0] * n, [0] * n, [0] * n, [-1] * n
        total = 0
        for block, run, linked in self.runs:
            own[block] += len(run)
            links[block] += linked
            points[block] += run.count(",") + run.count(".")
            if begin[block] < 0:
                begin[block] = total
            total += len(run)
        length, link, paragraphs, blocks = own[:], links[:], [int(t == "p") for t in self.tag], [1] * n
        kids: list[list[int]] = [[] for _ in range(n)]
        for i in range(n - 1, 0, -1):
            p = parent[i]
            length[p] += length[i]
            link[p] += link[i]
            points[p] += points[i]
            paragraphs[p] += paragraphs[i]
            blocks[p] += blocks[i]
            if begin[i] >= 0 and (begin[p] < 0 or begin[i] < begin[p]):
                begin[p] = begin[i]
        for i in range(1, n):
            kids[parent[i]].append(i)
        out = np.zeros((n, len(FEATURES)))
        depth, under = [0] * n, [(0, 0, 0, 0)] * n
        place, family, same = [0] * n, [1] * n, [1] * n
        for members in kids:
            counts: dict[str, int] = {}
            for i in members:
                counts[self.tag[i]] = counts.get(self.tag[i], 0) + 1
            for k, i in enumerate(members):
                place[i], family[i], same[i] = k, len(members), counts[self.tag[i]]
        for i in range(n):
            tag, p = self.tag[i], max(parent[i], 0)
            good = sum(w in GOOD_TOKENS for w in self.tokens[i])
            bad = sum(w in BAD_TOKENS for w in self.tokens[i])
            if i:
                depth[i] = depth[p] + 1
                u = under[p]
                under[i] = (u[0] | (self.tag[p] in ARTICLE), u[1] | (self.tag[p] in FRAME), u[2] | (out[p, 8] > 0), u[3] | (out[p, 9] > 0))
            rest = length[p] - length[i]
            out[i] = (
                tag == "p", tag in HEADINGS, tag in ("ul", "ol", "li", "dl", "dt", "dd"), tag in ("table", "tbody", "tr", "td", "th"), tag in ARTICLE, tag in FRAME,
                tag in ("div", "section", "center"), tag in ("blockquote", "pre", "figure"), good, bad, *under[i], depth[i], len(kids[i]), place[i], family[i],
                same[i], math.log1p(own[i]), math.log1p(length[i]), link[i] / max(length[i], 1), paragraphs[i], points[i] / max(length[i], 1) * 100,
                math.log1p(length[i] / blocks[i]), length[i] / max(length[p], 1), length[i] / max(total, 1), max(begin[i], 0) / max(total, 1),
                math.log1p(rest / max(family[i] - 1, 1)), math.log1p(length[i - 1] if i and place[i] else 0),
            )
        return out

    def weak_labels(self) -> list[int]:
        """1: article text.  Known labels (data-y) first, then the nearest telling element."""
        out = [0] * len(self.tag)
        for i in range(1, len(self.tag)):
            tag = self.tag[i]
            known = self.label[i]
            if known is not None:
                out[i] = known
            elif tag in ARTICLE:
                out[i] = 1
            elif tag in FRAME:
                out[i] = 0
            else:
                out[i] = out[self.parent[i]]
        return out


def consistent(parent: list[int], odds: np.ndarray) -> list[bool]:
    """Per node whether it is article, by the likeliest labels frame, then article, then cut out
    along every path; ``odds`` are log odds of article."""
    n = len(parent)
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    frame, article, cut = no.tolist(), yes.tolist(), no.tolist()
    for i in range(n - 1, 0, -1):
        p = parent[i]
        frame[p] += max(frame[i], article[i])
        article[p] += max(article[i], cut[i])
        cut[p] += cut[i]
    state = ["frame"] * n
    for i in range(1, n):
        above = state[parent[i]]
        if above == "frame":
            state[i] = "article" if article[i] > frame[i] else "frame"
        elif above == "article":
            state[i] = "article" if article[i] >= cut[i] else "cut"
        else:
            state[i] = "cut"
    return [s == "article" for s in state]


class Trees:
    """Boosted trees as arrays; a node's children stand at twice its place plus one and two."""

    def __init__(self, feature: np.ndarray, limit: np.ndarray, value: np.ndarray, weight: np.ndarray, depth: int):
        self.feature, self.limit, self.value, self.weight, self.depth = feature, limit, value, weight, depth

    def odds(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros(len(rows))
        every = np.arange(len(rows))
        for f, t, v, w in zip(self.feature, self.limit, self.value, self.weight):
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (rows[every, f[at]] > t[at])
            out += w * v[at]
        return 2 * out  # the margin of Spark's log loss is half the log odds


def _layout(page: Page, pick: random.Random) -> str:
    """A page set anew from the article paragraphs and the frame texts of another."""
    labels = page.weak_labels()
    esc = html_lib.escape
    body = [esc(r) for b, r, _ in page.runs if labels[b]] or ["Empty."]
    other = [esc(r) for b, r, _ in page.runs if not labels[b]] or ["More"]
    words = " ".join(body).split()
    few = lambda a, b: " ".join(pick.choices(words, k=pick.randint(a, b)))
    say = lambda: pick.choice([few(3, 12), few(8, 40), pick.choice(other)])
    links = lambda: "<ul>" + "".join(f'<li><a href="/x">{few(1, 4)}</a></li>' for _ in range(pick.randint(3, 9))) + "</ul>"
    paragraphs = lambda a, b: "".join(f"<p>{say()}</p>" for _ in range(pick.randint(a, b)))

    def box(tag: str, names: list[str], inside: str, y: int) -> str:
        plain = pick.random() < 0.35
        tag = pick.choice(["div", "section", "div"]) if pick.random() < 0.4 else tag
        named = "" if plain and tag not in ("div", "section") else f' {pick.choice(["class", "id"])}="{pick.choice(names)}"'
        return f'<{tag}{named} data-y="{y}">{inside}</{tag}>'

    before = [
        box("header", ["header", "site-header", "masthead"], f"<h1>{few(1, 4)}</h1>" + (links() if pick.random() < 0.5 else ""), 0),
        box("nav", ["nav", "menu", "main-navigation", "breadcrumbs"], links(), 0),
        box("div", ["ad", "ads", "banner", "sponsored", "promo"], say(), 0),
        box("div", ["cookie-notice", "notice", "alert", "consent", "popup"], f"<p>{say()}</p>", 0),
        box("form", ["search", "login", "newsletter"], f"{say()}<p>{few(1, 4)}</p>", 0),
    ]
    after = [
        box("aside", ["sidebar", "widget", "related", "side-rail"], f"<h3>{few(1, 3)}</h3>" + pick.choice([links(), paragraphs(1, 4)]), 0),
        box("section", ["comments", "comment-list", "discussion", "replies"], f"<h2>{few(1, 3)}</h2>" + "".join(f'<div class="comment"><p>{say()}</p></div>' for _ in range(pick.randint(1, 6))), 0),
        box("div", ["ad", "advert", "share", "social", "tags"], pick.choice([links(), say()]), 0),
        box("form", ["subscribe", "respond", "signup"], f"<p>{say()}</p>", 0),
        box("footer", ["footer", "site-footer", "copyright"], pick.choice([f"&copy; {say()}", f"<p>{say()}</p>" + links()]), 0),
    ]
    take = lambda xs: [x for x in xs if pick.random() < 0.6]
    inner = [f"<p>{x}</p>" for x in body] if pick.random() < 0.85 else ["<br><br>".join(body)]
    if pick.random() < 0.3:  # something to cut out in the middle
        inner.insert(pick.randint(0, len(inner)), pick.choice([before[2], after[2], after[0], before[4]]))
    if pick.random() < 0.25:
        inner.append("<ul>" + "".join(f"<li>{few(3, 12)}</li>" for _ in range(3)) + "</ul>")
    if pick.random() < 0.2:
        inner.insert(1, f"<blockquote><p>{few(8, 40)}</p></blockquote>")
    title = f"<h1>{few(3, 9)}</h1>" if pick.random() < 0.7 else ""
    tag, named = pick.choice([
        ("article", ""), ("main", ""), ("article", ' class="post"'), ("div", ' class="content"'), ("div", ' id="content"'), ("div", ' class="main-content"'), ("div", ' id="article-body"'),
        ("div", ' class="entry-content"'), ("div", ' class="post"'), ("section", ' class="story"'), ("div", ""), ("section", ""),
    ])
    core = f'<{tag}{named} data-y="1">{title}{"".join(inner)}</{tag}>'
    for _ in range(pick.randint(0, 3)):
        core = pick.choice([f'<div data-y="0">{core}</div>', f'<div class="{pick.choice(["wrapper", "container", "row", "outer", "layout"])}" data-y="0">{core}</div>'])
    inside = "".join(take(before)) + core + "".join(take(after))
    return f"<html><body>{inside}</body></html>" if pick.random() < 0.7 else inside


def fit(pages: DataFrame, sample_pages: int = 150, sample_bytes: int = 1 << 17, layouts: int = 8, trees: int = 20, depth: int = 5) -> Trees | None:
    """Trees fitted on weakly labelled nodes; none if there is no page to learn from."""
    fits = F.octet_length("html").between(1, sample_bytes)
    chosen = pages.select("page_id", "html").where(fits).orderBy(F.xxhash64("page_id"), F.xxhash64("html")).limit(sample_pages)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["html"]:
                page = Page(text)
                pick = random.Random(len(text))
                for p in [page, *(Page(_layout(page, pick), labelled=True) for _ in range(layouts))]:
                    out += [(f.tolist(), float(y)) for f, y in zip(p.features(), p.weak_labels())]
            yield pd.DataFrame(out, columns=["f", "label"])

    nodes = stage(chosen.mapInPandas(rows, "f array<double>, label double"), "dom-nodes")
    kinds = nodes.groupBy("label").count().count()
    if not kinds:
        return None
    size = 2 ** (depth + 1)
    if kinds < 2:  # nothing to tell apart: every node has the one label that was seen
        only = nodes.first()["label"]
        return Trees(np.zeros((1, size), np.int64), np.zeros((1, size)), np.full((1, size), 9.0 if only else -9.0), np.ones(1), depth)
    learner = GBTClassifier(featuresCol="v", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7, maxBins=64)
    model = learner.fit(nodes.select(array_to_vector("f").alias("v"), "label").coalesce(2))
    feature, limit, value = np.zeros((len(model.trees), size), np.int64), np.full((len(model.trees), size), np.inf), np.zeros((len(model.trees), size))
    for k, tree in enumerate(model.trees):
        todo = [(0, tree._java_obj.rootNode())]
        while todo:
            at, node = todo.pop()
            if node.subtreeDepth() == 0:
                below = [at]
                while below:  # a leaf's value reaches down to the last level
                    i = below.pop()
                    value[k, i] = node.prediction()
                    below += [x for x in (2 * i + 1, 2 * i + 2) if x < size]
            else:
                feature[k, at], limit[k, at] = node.split().featureIndex(), node.split().threshold()
                todo += [(2 * at + 1, node.leftChild()), (2 * at + 2, node.rightChild())]
    return Trees(feature, limit, value, np.array(model.treeWeights), depth)


def extract(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    fitted = trees or fit(pages)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 64):
                batch = whole.slice(first, 64)
                parsed = [Page(h or "") for h in batch.column(2).to_pylist()]
                counts = [len(p.tag) for p in parsed]
                odds = fitted.odds(np.concatenate([p.features() for p in parsed]))
                texts = []
                for page, mine in zip(parsed, np.split(odds, np.cumsum(counts)[:-1])):
                    keep = consistent(page.parent, mine)
                    texts.append(" ".join([run for block, run, _ in page.runs if keep[block]]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
                )

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    if fitted is None:  # no page has any html
        return rows.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars"))
    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long")


by_value(sys.modules[__name__])
