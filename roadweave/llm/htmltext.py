"""Main text of web pages by consensus of each host's pages.

A page is read once into blocks of text and the containers above them. Containers are scored by the
text of their blocks without links. Every page votes with its best containers' generalised
tag-class paths; votes are summed per host in Spark, and each page is extracted again from the
containers on its host's winning path, or from its own best one where it lacks that path.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import stored

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']|"[^"]*+"|'[^']*+')*+)>|(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)>|[!?][^>]*+>)""", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: A tag that the end of the page cuts off is markup too.
_CUT = re.compile(r"</?[a-zA-Z][^<>]*\Z")
_WORD = re.compile(r"[a-z]+")

#: HTML element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg object canvas textarea title".split())
GONE = frozenset("head nav footer aside button select dialog menu audio video".split())
FORMS = frozenset("form fieldset".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEADER = frozenset(["header"])
#: Elements that end an open one of their own kind, and elements that end tags inside do not reach beyond.
ALONE = frozenset("li dd dt tr td th".split())
HOLDERS = frozenset("main body section div td".split())
WALLS = ("article", "body", "table", "td")
#: Words in class, id or role that mark reader comments, other parts that are never the article, and parts that a
#: page may also name its article by.
READERS = frozenset("comment comments discussion disqus replies reply respond".split())
NOISE = READERS | frozenset(
    "ad ads adv advert adverts advertisement advertising breadcrumb breadcrumbs consent cookie cookies copyright footer gdpr masthead menu modal "
    "nav navbar navigation newsletter pager pagination popup promo promotion sidebar signup sponsor sponsored subscribe contentinfo complementary footnav".split()
)
DOUBTFUL = frozenset("alert alerts banner feedback header login notice notices overlay popover recommended related search share sharing skip social toolbar topbar widget".split())
LIKELY = frozenset("article content entry main post story body text".split())
#: Words before which a mark says what a page has or lacks, not what an element is, and words for a part of what a mark names.
ABOUT = frozenset("has no non not with without".split())
PARTS = frozenset(
    "area bar block bottom box container content footer form frame group header holder inner item items left link links list message outer panel "
    "region right row section slot text title top unit window wrap wrapper".split()
)


def marked(token: str, words: frozenset[str]) -> bool:
    """Whether a class, id or role names one of ``words``: as its last word, or as its first before words for parts."""
    said = _WORD.findall(token)
    if not said or not ABOUT.isdisjoint(said):
        return False
    return said[-1] in words or (said[0] in words and all(w in PARTS or w in DOUBTFUL or w in words for w in said[1:]))


class Page:
    """Blocks (text, container, characters in links) and containers (parent, tag, path) of one page.

    Blocks are judged by the marks of the containers around them, elements inside a line by nothing but
    ``hidden``. A container of a ``NOISE`` word, and a form, is left out; not so one that holds an
    ``article`` or ``main``, nor one that holds most of the page's unlinked text where the page has no
    article, or (forms aside) inside it. Of readers' comments only what holds ``main`` is kept. A container of a
    ``DOUBTFUL`` word is left out if it holds less than half of the text that is left. Every pass is
    linear in the page, however deep it nests.
    """

    def __init__(self, source: str):
        self.parents: list[int] = [-1]
        self.tags: list[str] = [""]
        self.steps: list[str] = [""]
        self.paths: list[int] = [0]  # number of each container's path
        self.likely: list[bool] = [False]
        self.named: list[bool] = [False]  # by a whole LIKELY mark
        self.holders: list[int] = [0]  # the container that each one's text counts for
        self.blocks: list[tuple[str, int, int]] = []
        self._path_numbers: dict[tuple[int, str], int] = {}
        # of each container to be judged: the one around it, "noise", "form", "reader" or "doubtful", whether it is in an article, and in comments
        self._doubts: list[tuple[int, str, bool, bool]] = [(-1, "", False, False)]
        self._holds: list[bool] = [False]  # an article or main
        self._article = False  # on the page, outside comments
        self._block_doubts: list[int] = []
        self._read(_CUT.sub("", source))
        self._settle()

    def _read(self, source: str) -> None:
        # tag, node, state ("" kept, "x" gone, "h" headings alone), doubtful container
        stack: list[tuple[str, int, str, int]] = [("", 0, "", 0)]
        places: dict[str, list[int]] = {}  # where the open elements of each name stand
        blocks_at: list[int] = []
        open_of = {"link": 0, "heading": 0, "article": 0}
        text: list[str] = []
        linked = 0
        ended: set[str] = set()  # raw elements that no later end tag closes
        at = 0

        def flush() -> None:
            nonlocal text, linked
            if text:
                joined = " ".join(entities.unescape("".join(text)).split())
                if joined:
                    _, node, _, doubt = stack[-1]
                    self.blocks.append((joined, node, linked))
                    self._block_doubts.append(doubt)
                text, linked = [], 0

        def kind(tag: str) -> str | None:
            return "link" if tag == "a" else "heading" if tag in HEADINGS else "article" if tag in ("article", "main") else None

        def close(to: int) -> None:
            if blocks_at and blocks_at[-1] >= to:
                flush()
            for tag, *_ in stack[to:]:
                places[tag].pop()
                if (k := kind(tag)) is not None:
                    open_of[k] -= 1
            while blocks_at and blocks_at[-1] >= to:
                blocks_at.pop()
            del stack[to:]

        def said(part: str) -> None:
            nonlocal linked
            state = stack[-1][2]
            if part and (not state or (state == "h" and open_of["heading"])):
                text.append(part)
                if open_of["link"]:
                    linked += len(part)

        last = source.rfind(">") + 1  # no tag ends after it
        while at < last:
            m = _TAG.search(source, at, last)
            if not m:
                break
            said(source[at : m.start()])
            at = m.end()
            tag = (m["name"] or m["name2"] or "").lower()
            if not tag:
                if m[0].startswith("<!--") and not m[0].endswith("-->"):
                    at = len(source)
                continue
            if m["end"] or m["end2"]:
                own = places.get(tag)
                wall = max((places[w][-1] for w in WALLS if places.get(w)), default=0)
                if own and (own[-1] >= wall or tag in ("article", "body", "html", "table", "main")):
                    close(own[-1])
                elif not own and tag in BLOCK:
                    flush()
                continue
            if tag in RAW:
                end = None if tag in ended else re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
                if end:
                    at = end.end()
                elif tag not in ("title", "noscript"):
                    at = len(source)
                else:
                    ended.add(tag)
                continue
            if tag == "br":
                said(" ")
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                continue
            if tag in BLOCK:
                flush()
                if blocks_at:  # what this start tag ends by itself
                    open_ = stack[blocks_at[-1]][0]
                    if open_ == "p" or (open_ == tag and tag in ALONE):
                        close(blocks_at[-1])
            self._open(stack, places, blocks_at, open_of, kind(tag), tag, m["attrs"] or m["attrs2"] or "")
        tail = source[at:]
        said(tail[: tail.find("<!--")] if "<!--" in tail else tail)
        flush()

    def _open(self, stack: list, places: dict, blocks_at: list, open_of: dict, kind: str | None, tag: str, attrs: str) -> None:
        """Put a start tag on the stack, with its state, and with a container if it is a block."""
        marks: list[str] = []
        classes = ""
        hidden = False
        for name, *values in _ATTR.findall(attrs) if attrs else ():
            value, name = next((v for v in values if v), ""), name.lower()
            if name in ("class", "id", "role"):
                marks += value.lower().split()
                if name == "class":
                    classes = re.sub(r"\d+", "#", ".".join(sorted(value.lower().split()))).replace("/", "|")
            elif name == "style":
                hidden |= "display:none" in value.replace(" ", "").lower()
            elif name == "hidden" or value == "true":
                hidden = True
        _, node, state, doubt = stack[-1]
        block = tag in BLOCK
        if state != "x" and (hidden or tag in GONE):
            state = "x"
        elif state != "x" and block and tag not in ("html", "body", "main"):
            says = lambda words: any(marked(m, words) for m in marks)
            judged = ""
            if tag == "article":
                state = "x" if marks and says(READERS) else state
            elif tag == "header" or (marks and open_of["article"] and says(HEADER)):
                state = "h" if open_of["article"] else "x"
            elif marks and says(READERS):
                judged = "reader"
            elif marks and says(NOISE):
                judged = "noise"
            elif tag in FORMS:
                judged = "form"
            elif marks and says(DOUBTFUL):
                judged = "doubtful"
            if judged:
                self._doubts.append((doubt, judged, bool(places.get("article")), judged == "reader" or self._doubts[doubt][3]))
                self._holds.append(False)
                doubt = len(self._doubts) - 1
        if tag in ("article", "main") and state != "x":
            self._article |= tag == "main" or not self._doubts[doubt][3]
            at = doubt
            while at > 0 and not self._holds[at] and (tag == "main" or self._doubts[at][1] != "reader"):
                self._holds[at] = True
                at = self._doubts[at][0]
        if block:
            step = f"{tag}.{classes}" if classes else tag
            self.paths.append(self._path_numbers.setdefault((self.paths[node], step), len(self._path_numbers) + 1))
            self.parents.append(node)
            self.tags.append(tag)
            self.steps.append(step)
            above = self.holders[node]
            own = tag == "article" or (tag in HOLDERS and self.tags[above] not in ("article", "main"))
            self.holders.append(len(self.parents) - 1 if own else above)
            self.likely.append(tag in ("article", "main") or any(w in LIKELY for m in marks for w in _WORD.findall(m)))
            self.named.append(any(m in LIKELY for m in marks))
            node = len(self.parents) - 1
            blocks_at.append(len(stack))
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, node, state, doubt))
        if kind is not None:
            open_of[kind] += 1

    def _sums(self, gone: list[bool], unlinked: bool) -> list[int]:
        """Characters in each container to be judged, without what is gone; the page's at 0."""
        sizes = [0] * len(self._doubts)
        for (text, _, linked), doubt in zip(self.blocks, self._block_doubts, strict=True):
            if not gone[doubt]:
                sizes[doubt] += max(0, len(text) - linked * unlinked)
        for k in range(len(sizes) - 1, 0, -1):  # inner ones come later
            sizes[self._doubts[k][0]] += sizes[k]
        return sizes

    def _settle(self) -> None:
        """Leave out the blocks of containers that are not of the article."""
        gone = [False] * len(self._doubts)
        sizes = self._sums(gone, True)
        for k in range(1, len(gone)):
            outer, judged, inside, _ = self._doubts[k]
            most = judged != "reader" and 2 * sizes[k] > sizes[0] and ((inside and judged == "noise") or not self._article)
            gone[k] = gone[outer] or (judged != "doubtful" and not self._holds[k] and not most)
        sizes = self._sums(gone, False)
        for k in range(1, len(gone)):
            outer, judged, _, _ = self._doubts[k]
            gone[k] |= gone[outer] or (judged == "doubtful" and 2 * sizes[k] < sizes[0])
        self.blocks = [b for b, doubt in zip(self.blocks, self._block_doubts, strict=True) if not gone[doubt]]

    def path(self, node: int) -> str:
        steps = []
        while node > 0:
            steps.append(self.steps[node])
            node = self.parents[node]
        return "/".join(reversed(steps))

    def _on(self, path: str) -> set[int]:
        """The containers on a path."""
        number: int | None = 0
        for step in path.split("/") if path else ():
            number = self._path_numbers.get((number, step))
            if number is None:
                return set()
        return {k for k, p in enumerate(self.paths) if p == number}

    def scores(self) -> dict[int, float]:
        """Score of each container: the unlinked text of blocks in it, less for each level above.

        Text counts for the article around it, or for ``main``, or for the nearest container that may hold a whole text.
        """
        found: dict[int, float] = {}
        for text, node, linked in self.blocks:
            worth = max(0.0, len(text) - 2.0 * linked)
            node = self.holders[node]
            for share in (1.0, 0.5, 0.25):
                if node < 0:
                    break
                found[node] = found.get(node, 0.0) + worth * share * (1.5 if self.likely[node] else 1.0)
                node = self.parents[node]
        return found

    def _whole(self, node: int) -> int:
        """The container that a part without a mark of its own belongs to: the one around it that is named as the text."""
        around = self.parents[node]
        while around > 0 and self.named[around] and not self.likely[node] and self.tags[around] != "body":
            node, around = around, self.parents[around]
        return node

    def best(self, n: int = 3) -> list[tuple[int, float]]:
        """The best containers with their shares of all scores, ties to the earlier one."""
        found = {k: v for k, v in self.scores().items() if v > 0}
        total, shares = sum(found.values()), {}
        for k, v in sorted(found.items(), key=lambda x: (-x[1], x[0]))[:n]:
            k = self._whole(k)
            shares[k] = shares.get(k, 0.0) + v / total
        return sorted(shares.items(), key=lambda x: (-x[1], x[0]))

    def text(self, path: str | None) -> str:
        """Blocks under the containers on ``path``, or on that of the page's own best one."""
        roots = self._on(path) if path is not None else set()
        if not roots:
            own = self.best(1)
            roots = self._on(self.path(own[0][0])) if own else {0}
        under: dict[int, bool] = {}
        for k in range(len(self.parents)):  # parents come before children
            under[k] = k in roots or (self.parents[k] >= 0 and under[self.parents[k]])
        return "\n".join(t for t, node, _ in self.blocks if under[node])


def host_paths(pages: DataFrame, least: int = 3) -> DataFrame:
    """host, path: the winning path of each host with at least ``least`` pages that vote for it."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, shares = [], [], []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                page = Page(source.as_py() or "")
                seen: dict[str, float] = {}
                for node, share in page.best():
                    p = page.path(node)
                    seen[p] = max(seen.get(p, 0.0), share)
                hosts += [host] * len(seen)
                paths += list(seen)
                shares += list(seen.values())
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(shares, pa.float64())], ["host", "path", "share"])

    votes = pages.select("host", "html").mapInArrow(vote, "host string, path string, share double")
    per = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round("share", 6).cast("decimal(38,6)")).alias("share"))
    best = per.groupBy("host").agg(F.max(F.struct("share", "n", "path")).alias("b"))
    return best.where(F.col("b.n") >= least).select(F.col("host").alias("_rw_host"), F.col("b.path").alias("_rw_path"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each row of ``pages`` (page_id, url, html).

    Null and empty pages, and pages without text, have an empty text. Pages without a host vote
    among themselves. Repeated rows are extracted each, of whatever length; an empty table gives an
    empty result. Other columns are left out.
    """
    lean = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    lean = lean.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", 1)))
    paths = stored(host_paths(lean), "host-paths")

    @F.arrow_udf("string")
    def main_text(sources: pa.Array, winners: pa.Array) -> pa.Array:
        return pa.array([Page(s.as_py()).text(w) for s, w in zip(sources, winners.to_pylist(), strict=True)], pa.string())

    # A row a host: broadcast only if the stored table's size allows it.
    joined = lean.join(paths, lean["host"] == paths["_rw_host"], "left").withColumn("text", main_text("html", "_rw_path"))
    return joined.select("page_id", "url", "text").withColumn("n_chars", F.length("text").cast("long"))
