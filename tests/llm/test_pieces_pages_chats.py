"""Pieces against the library, pages and conversations against plain versions."""

import collections
import hashlib
import html
import random
import re

import pytest
import sentencepiece

from riverlog.llm import catalog, chat_tree, html_extract, pieces

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def coder():
    path = catalog.piece_model()
    return pieces.PieceCoder.of(path), sentencepiece.SentencePieceProcessor(model_file=path)


def same(coder, text):
    ours, library = coder
    ids = library.encode(text)
    both = ours.both(text)
    assert ours.encode(text) == ids, text[:80]
    assert both == (",".join(map(str, ids)), library.decode(ids)), text[:80]
    assert ours.decode(ids) == library.decode(ids), text[:80]


def test_pieces_of_random_texts(coder):
    rng = random.Random(4)
    parts = [*"abcdefgh", " the", "ing ", "TH", "\n", "\t", ".", ",", "12", "é", "ß", "漢", "🎉", "▁", " ", "  ", "\x00", "<s>", "</s>"]
    for _ in range(4000):
        same(coder, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40))))


def test_pieces_of_runs_and_long_texts(coder):
    for n in (1, 2, 3, 5, 8, 15, 16, 17, 31, 33, 64, 100):
        for part in (" ", "a", "ab", "\n", "=", "a ", "the"):
            same(coder, part * n)
    rng = random.Random(8)
    same(coder, "".join(rng.choice("abcdefghijklmnop") for _ in range(30_000)))


def test_bytes_that_are_no_text(coder):
    ours, library = coder
    for ids in ([3 + 0xE6, 3 + 0xBC], [3 + 0xFF, 3 + 0x41], [0], [1, 415, 2]):
        assert ours.decode(ids) == library.decode(ids)


def test_piece_columns_and_digests(spark):
    path = catalog.piece_model()
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a  b 漢", None), (3, "a  b 漢", None)], "doc_id bigint, text string, ids2 string")
    encoded = pieces.encode_column(df, path)
    back = pieces.decode_column(encoded, path)
    assert [r.decoded for r in back.orderBy("doc_id").collect()] == ["", "", "a  b 漢", "a  b 漢"]
    rows = {r.doc_id: r for r in pieces.digests(df, path).collect()}
    assert rows[1].n_tokens == 0 and rows[1].ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[3].decoded_sha256 == hashlib.sha256("a  b 漢".encode()).hexdigest()
    assert pieces.digests(df.where("false"), path).count() == 0


def page(body, head="<title>t</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def texts(markup):
    return [text for _, text in html_extract.read_page(markup)[0]]


def test_blocks_of_a_page():
    assert texts("") == []
    body = (
        "<nav><ul><li><a href=/>Home</a></li></ul></nav><header class=top>Site</header><div class='cookie-notice'>We use cookies</div>"
        "<article><header><h1>Tom &amp;  Jerry</h1></header><p>One <b>two<br>three<p>Four&nbsp;five &lt;six&gt;<script>var t='</p>'</script>"
        "<div class='ad-box ad'>Buy</div><form><input value=x>Mail</form><pre>a\n  b</pre></article>"
        "<section id=comments><article class=comment>First!</article></section><aside>More</aside><footer>&copy; x</footer>"
    )
    assert texts(page(body)) == ["Tom & Jerry", "One two three", "Four five <six>", "a b"]
    assert texts("<div class=sidebar>s</div><p>cut off <b>here") == ["cut off here"]
    assert texts("<p>Text.</p><p><a href=/x>only a link</a></p>") == ["Text."]


def test_pages_of_the_table(spark):
    known = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in catalog.op6_html_extract(spark, SF).collect():
        found = re.search(r"<article>(.*?)(</article>|<footer>|$)", known[r.page_id], re.S)
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", found[1]).replace("<br>", " "))
        expected = "\n\n".join(t for t in (" ".join(html.unescape(part).split()) for part in parts) if t)
        assert (r.text, r.n_chars) == (expected, len(expected))


def test_template_text_goes_and_copied_articles_stay(spark):
    rows = []
    for n in range(9):
        rows.append((n, f"http://a.example/{n}", page(f"<div><p>Terms of this site</p><h2>Title {n}</h2><p>Own words {n}</p></div>")))
    for n in range(9):
        rows.append((20 + n, f"http://b.example/{n}", page("<div><p>The same article</p><p>on all pages</p></div>")))
    rows += [(40, None, page("<p>no host</p>")), (41, "http://c.example/", None), (41, "http://c.example/", None), (42, "x", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = collections.Counter((r.page_id, r.text) for r in html_extract.extract(df).collect())
    assert all(got[n, f"Title {n}\n\nOwn words {n}"] == 1 for n in range(9))
    assert all(got[20 + n, "The same article\n\non all pages"] == 1 for n in range(9))
    assert got[40, "no host"] == 1 and got[41, ""] == 2 and got[42, ""] == 1
    assert html_extract.extract(df.where("false")).count() == 0


def test_turns_are_read_back():
    rng = random.Random(3)
    parts = ["\\", "-", "<", "s", ">", "</s>", "<s>", "[INST]", "[/INST]", "n", "\n", "<|", "a", "é"]
    for _ in range(5000):
        role, text = ("".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(2))
        segment = chat_tree.format_turn(role, text)
        assert chat_tree.read_turn(segment) == (role, text)
        assert not chat_tree.CONTROL.search(segment.removeprefix("<s>").removesuffix("</s>"))


def test_conversations_of_the_table(spark):
    known = collections.defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        known[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    known[-7] = [(n, role, "</s>[INST] ok [/INST]") for n, role in enumerate(("user", "assistant"))]
    rows = catalog.op5_chat_tree(spark, SF).collect()
    assert len(rows) == len(known)
    for r in rows:
        turns = sorted(known[r.conv_id])
        loss = "".join(text for _, role, text in turns if role == "assistant")
        every = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(every.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(chat_tree.format_turn(role, text)) for _, role, text in turns)


def test_shared_turns_are_emitted_once(spark):
    rows = [
        (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (2, 0, "user", "a"), (2, 1, "assistant", "x"),
        (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "user", "d"), (4, 0, "user", "z"), (5, 0, None, None), (None, 0, "user", "a"),
    ]
    tree = chat_tree.Tree(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    emitted = tree.emitted().collect()
    paths = {tuple((role, text) for c, _, role, text in rows if c == conv)[:n] for conv in (1, 2, 3, 4, 5) for n in (1, 2, 3)}
    assert len(emitted) == len({p for p in paths if p})
    begin = {(r.branch, r.depth): (r.begin, r.end) for r in emitted}
    assert begin[3, 2] == begin[1, 2] and begin[2, 1] == begin[1, 1]
    seen = collections.defaultdict(list)
    for r in tree.intervals().collect():
        seen[r.conv_id].append((r.owner, r.begin, r.end))
    assert sorted(seen[3]) == [(1, 0, begin[1, 1][1]), (3, *begin[3, 2])]
    order = [r.branch for r in sorted(emitted, key=lambda r: ([tuple(o) for o in r.order], r.depth)) if r.branch in (1, 2, 3)]
    assert order == [1, 1, 1, 3, 2]


def test_reading_back_follows_the_output_and_its_intervals(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (2, 0, "user", "a"), (2, 1, "assistant", "d"),
            (3, 0, "user", "a"), (3, 1, "assistant", "b"), (None, 0, "user", "e"), (None, 1, "user", "e")]
    tree = chat_tree.Tree(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    turns = {r.conv_id: r.n_turns for r in tree.read_back().collect()}
    assert turns == {1: 3, 2: 2, 3: 2, None: 2}
    emitted, intervals = tree.emitted(), tree.intervals()
    tree.emitted = lambda: emitted.where("NOT (branch <=> 1 AND depth = 0)")
    assert {r.conv_id: r.n_turns for r in tree.read_back().collect()} == {1: 2, 2: 1, 3: 1, None: 2}
    tree.emitted, tree.intervals = lambda: emitted, lambda: intervals.where("NOT (conv_id <=> 3)")
    assert {r.conv_id: r.n_turns for r in tree.read_back().collect()} == {1: 3, 2: 2, None: 2}
