"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

Each page is a chain of leaf blocks (``html_blocks``). A block's features are its
ancestors' tags, the kinds of their class, id and role words, and its text: length,
share of links, punctuation, place in the page. Two labels, main text or not, with a
weight for each pair of neighbours; trained by maximum likelihood, decoded by Viterbi.

Training pages: a bounded sample of the table (``SAMPLE_PAGES`` of at most ``SAMPLE_CHARS``
characters, chosen by hash) whose markup labels it (an ``article`` or ``main`` element,
without what its own markup sets apart), and ``BUILT_PAGES`` built pages that label the
parts the sample may lack, in and outside an article: side bars, notices, forms, reader
comments, menus and footers, pages without an article element. The built pages weigh as
much as the sample, whatever its length.

Defined cases: a null or empty page has an empty text, as has a page without main text.
Pages of any length are read whole. A page without any tag is one block. Repeated rows
give repeated results. The input's other columns stay; one called like an output is
replaced by it.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from icefathom.llm.columns import shield
from icefathom.llm.html_blocks import KINDS, Block, Place, blocks

SAMPLE_PAGES = 200
BUILT_PAGES = 600
#: Parts that do not set their text apart.
OPEN_PARTS = frozenset(("none", "main", "body"))
#: Pages longer than this do not train; so the sample is bounded in bytes too.
SAMPLE_CHARS = 1 << 18


def path_features(place: Place | None) -> list[str]:
    """Features of a block's ancestors.

    Next to what is anywhere above: the innermost part that sets text apart or opens main text,
    alone and with the part around it, so that a side bar inside an article is told from the
    article's own text however often the training pages show the latter.
    """
    if place is None:
        return ["in nothing", "part none", "part none within none"]
    out = [f"has {tag}" for tag in sorted(place.tags)] + [f"kind {kind}" for kind in sorted(place.kinds)]
    out += [f"in {place.tag}", f"part {place.part}", f"part {place.part} within {place.within}"]
    # The same without the kind, so that rare kinds learn from all others.
    inner, outer = place.part not in OPEN_PARTS, place.within not in OPEN_PARTS
    return out + [f"apart {inner} within {outer}"] + ["is apart"] * inner


def text_features(block: Block, place: int, total: int) -> list[str]:
    """Features of a block's text and place."""
    text = block.text
    n = text.count(" ") + 1
    out = [f"words {min(int(log2(n + 1)), 8)}", f"links {4 * block.linked // len(text)}", f"place {5 * place // total}"]
    if text[-1] in ".!?…:;\"”»":
        out.append("sentence")
    if "©" in text:
        out.append("mark")
    return out


@dataclass
class Field:
    """Weights of the field: features, start, and neighbours [left][right]."""

    weights: dict[str, float]
    start: float
    pairs: tuple[tuple[float, float], tuple[float, float]]
    _paths: dict = field(default_factory=dict, repr=False)

    def score(self, block: Block, place: int, total: int) -> float:
        """Log odds of main text before the neighbours are heard."""
        signs = block.place.signs if block.place else None
        of_path = self._paths.get(signs)
        if of_path is None:
            if len(self._paths) > 50_000:
                self._paths.clear()
            of_path = sum(self.weights.get(f, 0.0) for f in path_features(block.place))
            self._paths[signs] = of_path
        return of_path + sum(self.weights.get(f, 0.0) for f in text_features(block, place, total))

    def decode(self, page: list[Block]) -> list[bool]:
        """Best labels of a page (Viterbi; a tie is not main text)."""
        if not page:
            return []
        (oo, om), (mo, mm) = self.pairs
        other, main = 0.0, self.score(page[0], 0, len(page)) + self.start
        back: list[tuple[bool, bool]] = []
        for i in range(1, len(page)):
            unary = self.score(page[i], i, len(page))
            to_other, to_main = main + mo > other + oo, main + mm > other + om
            back.append((to_other, to_main))
            other, main = (main + mo if to_other else other + oo), (main + mm if to_main else other + om) + unary
        label = main > other
        labels = [label]
        for to_other, to_main in reversed(back):
            label = to_main if label else to_other
            labels.append(label)
        return labels[::-1]


def markup_labels(page: list[Block]) -> list[bool] | None:
    """Labels that the markup itself gives; None if it sets no main text apart."""
    out = [bool(block.place and block.place.marked) for block in page]
    return out if any(out) else None


def built_page(draw: random.Random) -> list[tuple[str, list[bool]]]:
    """Parts of one built page: markup, and whether each of its blocks is main text."""
    alphabet = "abcdefghijklmnopqrstuvwxyz"

    def some(low: int, high: int) -> str:
        return " ".join("".join(draw.choices(alphabet, k=draw.randint(2, 9))) for _ in range(draw.randint(low, high)))

    def sentence() -> str:
        return some(5, 40).capitalize() + "."

    def word(kind: str) -> str:
        return draw.choice(KINDS[kind]) + draw.choice(("", "-list", "-box", " wide", "_inner"))

    def wrapped(tag: str, kind: str | None, inside: str) -> str:
        name = f' {draw.choice(("class", "id"))}="{word(kind)}"' if kind else ""
        return f"<{tag}{name}>{inside}</{tag}>"

    def links() -> tuple[str, int]:
        n = draw.randint(2, 7)
        return "<ul>" + "".join(f'<li><a href="#">{some(1, 3)}</a></li>' for _ in range(n)) + "</ul>", n

    def apart(kind: str) -> tuple[str, list[bool]]:
        tags = {"menu": "nav", "top": "header", "bottom": "footer", "side": "aside", "form": "form"}
        tag, name = (tags[kind], None) if kind in tags and draw.random() < 0.5 else (draw.choice(("div", "section")), kind)
        if kind == "control":
            control = draw.choice(("button", "select", "dialog", "fieldset", "menu"))
            if control == "select":
                n = draw.randint(1, 4)
                return "<select>" + "".join(f"<option>{some(1, 3)}" for _ in range(n)) + "</select>", [False] * n
            return f"<{control}>{draw.choice((some(1, 4), sentence()))}</{control}>", [False]
        if kind == "menu" or (kind == "side" and draw.random() < 0.5):
            inside, n = links()
        elif kind == "bottom":
            inside, n = "&copy; " + draw.choice((some(1, 4), sentence())), 1
        elif kind == "form" and draw.random() < 0.6:
            inside, n = f"<label>{some(1, 3)}</label><input><button>{some(1, 2)}</button>", 2
        elif kind == "top":
            inside, n = f"<h1>{some(1, 4)}</h1><p>{some(2, 8)}</p>", 2
        elif kind == "talk" and draw.random() < 0.3:
            n = draw.randint(1, 3)
            inside = "".join(f"<article><p>{sentence()}</p></article>" for _ in range(n))
        elif draw.random() < 0.5:
            n = draw.randint(1, 4)
            inside = "".join(f"<p>{sentence()}</p>" for _ in range(n))
        else:
            inside, n = draw.choice((some(2, 12), sentence())), 1
        return wrapped(tag, name, inside), [False] * n

    def paragraph() -> tuple[str, list[bool]]:
        shape = draw.random()
        if shape < 0.7:
            return f"<p>{' '.join(sentence() for _ in range(draw.randint(1, 5)))}", [True]
        if shape < 0.8:
            return f"<h2>{some(1, 8)}</h2>", [True]
        if shape < 0.87:
            return f"<blockquote>{sentence()}</blockquote>", [True]
        if shape < 0.93:
            n = draw.randint(1, 4)
            return "<ul>" + "".join(f"<li>{some(2, 12)}" for _ in range(n)) + "</ul>", [True] * n
        return f"<p>{some(1, 4)}", [True]

    parts: list[tuple[str, list[bool]]] = []
    for kind in ("notice", "top", "menu", "ad", "form", "side"):
        if draw.random() < 0.5:
            parts.append(apart(kind))
    body = [paragraph() for _ in range(draw.choice((1, 1, 2, 3, draw.randint(1, 12))))]
    if draw.random() < 0.6:
        body.insert(0, (f"<h1>{some(1, 10)}</h1>", [True]))
    often = draw.choice((0.0, 0.15, 0.5))
    for kind in ("ad", "share", "side", "form", "talk", "menu", "bottom", "notice", "control"):
        if draw.random() < often:
            markup, labels = apart(kind)
            if draw.random() < 0.3:  # a wrapper that says nothing
                markup = f"<{(tag := draw.choice(('div', 'section')))}>{markup}</{tag}>"
            body.insert(draw.randint(0, len(body)), (markup, labels))
    shape = draw.random()
    opening = "<article>" if shape < 0.4 else "<main>" if shape < 0.55 else f'<div class="{word("body")}">' if shape < 0.85 else "<div>"
    parts += [(opening, []), *body, ("</article>" if shape < 0.4 else "</main>" if shape < 0.55 else "</div>", [])]
    for kind in ("share", "talk", "talk", "side", "ad", "menu", "bottom", "notice"):
        if draw.random() < 0.5:
            parts.append(apart(kind))
    return parts


def built_pages(n: int = BUILT_PAGES) -> list[tuple[list[Block], list[bool]]]:
    """Labelled built pages, the same ones every time."""
    draw = random.Random(8191)
    out = []
    for _ in range(n):
        parts = built_page(draw)
        page = blocks("<html><body>" + "".join(markup for markup, _ in parts))
        labels = [label for _, many in parts for label in many]
        if len(page) != len(labels):
            raise AssertionError("a built page has blocks without labels")
        out.append((page, labels))
    return out


def train(
    pages: list[tuple[list[Block], list[bool]]], rounds: int = 150, penalty: float = 0.05, shares: list[float] | None = None
) -> Field:
    """Maximum likelihood weights, by gradient steps of adapted size over all pages at once.

    ``shares`` says how often each page counts (once by default).
    """
    shares = [share for share, (p, _) in zip(shares or [1.0] * len(pages), pages) if p]
    pages = [(p, y) for p, y in pages if p]
    names: dict[str, int] = {}
    features, begins, lengths, gold = [], [0], [], []
    for page, labels in pages:
        lengths.append(len(page))
        gold += labels
        for i, block in enumerate(page):
            own = path_features(block.place) + text_features(block, i, len(page))
            features += [names.setdefault(f, len(names)) for f in own]
            begins.append(len(features))
    index, bounds = np.array(features), np.array(begins)
    truth = np.array(gold, float)
    counted = np.repeat(np.array(shares), lengths)
    lengths = np.array(lengths)
    heads = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    owner = np.repeat(np.arange(len(truth)), np.diff(bounds))
    longest = lengths.max()
    # Row t of ``grid`` is block t of every page that has one, longest pages first.
    order = np.argsort(-lengths, kind="stable")
    grid = [heads[order[: np.count_nonzero(lengths > t)]] + t for t in range(longest)]
    weights, pairs, start = np.zeros(len(names)), np.zeros((2, 2)), 0.0
    follows = np.ones(len(truth), bool)
    follows[heads] = False
    after = np.flatnonzero(follows)
    seen_pairs = np.zeros((2, 2))
    np.add.at(seen_pairs, (truth[after - 1].astype(int), truth[after].astype(int)), counted[after])
    state = [np.zeros(len(names)), np.zeros((2, 2)), 0.0]
    for _ in range(rounds):
        unary = np.zeros((len(truth), 2))
        unary[:, 1] = np.bincount(owner, weights=weights[index], minlength=len(truth))
        unary[heads, 1] += start
        forward = np.empty((len(truth), 2))
        backward = np.zeros((len(truth), 2))
        forward[grid[0]] = unary[grid[0]]
        for t in range(1, longest):
            here = grid[t]
            forward[here] = np.logaddexp.reduce(forward[here - 1][:, :, None] + pairs[None], axis=1) + unary[here]
        for t in range(longest - 1, 0, -1):
            here = grid[t]
            backward[here - 1] = np.logaddexp.reduce(pairs[None] + (unary[here] + backward[here])[:, None, :], axis=2)
        both = forward + backward
        total = np.logaddexp.reduce(both, axis=1)
        chance = np.exp(both[:, 1] - total)
        edge = forward[after - 1][:, :, None] + pairs[None] + (unary[after] + backward[after])[:, None, :]
        expected = (np.exp(edge - total[after][:, None, None]) * counted[after][:, None, None]).sum(axis=0)
        missed = counted * (truth - chance)
        slopes = [
            np.bincount(index, weights=missed[owner], minlength=len(names)) - penalty * weights,
            seen_pairs - expected - penalty * pairs,
            float(missed[heads].sum()) - penalty * start,
        ]
        steps = []
        for i, slope in enumerate(slopes):
            state[i] = state[i] + slope * slope
            steps.append(0.5 * slope / np.sqrt(state[i] + 1e-8))
        weights, pairs, start = weights + steps[0], pairs + steps[1], start + steps[2]
    return Field(
        {name: float(weights[i]) for name, i in names.items()},
        float(start),
        ((float(pairs[0, 0]), float(pairs[0, 1])), (float(pairs[1, 0]), float(pairs[1, 1]))),
    )


def fit(pages: DataFrame, key: str = "page_id", html: str = "html", sample: int = SAMPLE_PAGES) -> Field:
    """A field trained on about ``sample`` pages of the table (never more than twice that) and the built ones."""
    total = pages.count()
    share = int(min(1.0, sample / max(total, 1)) * (1 << 30))
    draw = F.xxhash64(F.col(key).cast("string"))
    few = pages.filter(F.col(key).isNotNull() & (F.coalesce(F.length(html), F.lit(0)) <= SAMPLE_CHARS) & (F.pmod(draw, F.lit(1 << 30)) < share))
    chosen = few.orderBy(draw, key).limit(2 * sample).select(html).collect()
    labelled = []
    for row in sorted(chosen, key=lambda r: r[0] or ""):
        page = blocks(row[0] or "")
        labels = markup_labels(page)
        if labels:
            labelled.append((page, labels))
    built = built_pages()
    # Blocks of both halves count alike: clean articles of the table do not outvote the built parts.
    many, few = sum(len(p) for p, _ in labelled), sum(len(p) for p, _ in built)
    return train(labelled + built, shares=[few / max(many, 1)] * len(labelled) + [1.0] * len(built))


def main_text(html: str | None, model: Field) -> str:
    """Main text of one page."""
    page = blocks(html or "")
    return "\n".join(b.text for b, keep in zip(page, model.decode(page)) if keep)


def extract(pages: DataFrame, model: Field, html: str = "html") -> DataFrame:
    """Replaces the markup by ``text`` and ``n_chars`` (its code points)."""
    pages, restore = shield(pages, (html,), ("text", "n_chars"))
    rest = [f for f in pages.schema.fields if f.name != html]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for at in range(0, batch.num_rows, 256):
                cut = batch.slice(at, 256)
                texts = [main_text(h, model) for h in cut.column(cut.schema.get_field_index(html)).to_pylist()]
                kept = [cut.column(cut.schema.get_field_index(f.name)) for f in rest]
                new = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(kept + new, [f.name for f in rest] + ["text", "n_chars"])

    added = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return restore(pages.mapInArrow(batches, T.StructType(rest + added)))
