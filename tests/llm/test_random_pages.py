"""Pages of random nestings against a plain walk over the same tree."""

import random
import time

from riverlog.llm.html_extract import read_page
from riverlog.llm.pieces import PieceCoder
from riverlog.llm.catalog import piece_model

INLINE, BLOCK, OUT = ("b", "em", "span"), ("div", "section", "blockquote"), ("nav", "aside", "form")


def grown(draw, depth):
    """A list of texts, None for a line break, and (tag, children)."""
    items = []
    for _ in range(draw.randint(0, 4)):
        kind = draw.random()
        if kind < 0.35 or depth == 0:
            items.append(draw.choice(["one", " two ", "three four", " ", "\n", "x"]))
        elif kind < 0.5:
            items.append(None)
        else:
            tag = draw.choice(INLINE + BLOCK + (OUT if draw.random() < 0.3 else BLOCK))
            items.append((tag, grown(draw, depth - 1)))
    return items


def markup(items):
    out = []
    for item in items:
        if item is None:
            out.append("<br>")
        elif isinstance(item, str):
            out.append(item)
        else:
            out.append(f"<{item[0]}>{markup(item[1])}</{item[0]}>")
    return "".join(out)


def walked(items):
    """Blocks of the tree: text is cut at the borders of blocks and nowhere else."""
    blocks, parts = [], []

    def cut():
        text = " ".join("".join(parts).split())
        if text:
            blocks.append(text)
        parts.clear()

    def walk(children, out):
        for item in children:
            if item is None or isinstance(item, str):
                if not out:
                    parts.append(" " if item is None else item)
                continue
            tag, inner = item
            if tag not in INLINE:
                cut()
            walk(inner, out or tag in OUT)
            if tag not in INLINE:
                cut()

    walk(items, False)
    cut()
    return blocks


def test_random_pages_lose_no_text():
    draw = random.Random(11)
    for _ in range(20_000):
        tree = grown(draw, 4)
        inside = [("article", tree)]
        assert [text for _, text in read_page(f"<html><body>{markup(inside)}</body></html>")[0]] == walked(inside)


def test_text_before_and_in_the_article():
    page = "<div>menu here</div><article><br>Hello first words<p>second</p></article>"
    assert [text for _, text in read_page(page)[0]] == ["Hello first words", "second"]
    assert [text for _, text in read_page("<html><body><br>Hello world</body></html>")[0]] == ["Hello world"]
    assert [text for _, text in read_page("<article><nav><br></nav>a<nav>b<br></nav> c</article>")[0]] == ["a", "c"]


def test_deep_pages_take_time_in_proportion():
    for tag in ("span", "div"):
        begun = time.perf_counter()
        blocks, _ = read_page("<body>" + f"<{tag}>x" * 20_000 + f"</{tag}>" * 20_000)
        assert len("".join(text for _, text in blocks).replace(" ", "")) == 20_000
        assert time.perf_counter() - begun < 3


def test_units_of_odd_spacing_equal_the_library():
    import sentencepiece

    coder, draw = PieceCoder(piece_model()), random.Random(2)
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    for _ in range(3000):
        text = "".join(draw.choice([" ", "  ", "a", "the", "\n", "é", "▁", "word", ".", "\t", "漢"]) for _ in range(draw.randint(0, 12)))
        ids = library.encode(text)
        assert coder.both(text) == (",".join(map(str, ids)), library.decode(ids)), repr(text)


def test_remembered_units_turn_over(monkeypatch):
    coder, fresh = PieceCoder(piece_model()), PieceCoder(piece_model())
    monkeypatch.setattr("riverlog.llm.pieces.UNITS", 3)
    for text in ["a b c d", "a b", "e f a", "long " + "x" * 200 + " a", "b b b"] * 3:
        ids = fresh.encode(text)
        assert coder.both(text) == (",".join(map(str, ids)), fresh.decode(ids))
