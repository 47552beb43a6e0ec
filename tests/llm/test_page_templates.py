"""Templates of hosts: order and nesting of classes, and roles of tokens by their places."""

import random

from riverlog.llm import html_extract
from riverlog.llm.html_extract import Classes, roles, violations

# Odd tokens are tags.
A, B, C, D, E, X, Y = 11, 13, 15, 17, 19, 21, 23


def extracted(spark, bodies):
    """The texts of a host's pages, as lists of blocks."""
    rows = [(n, f"http://a.example/{n}", f"<html><body><div>{body}</div></body></html>") for n, body in enumerate(bodies)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    return [r.text.split("\n\n") for r in html_extract.extract(df).orderBy("page_id").collect()]


def test_text_that_keeps_no_order_is_no_template(spark):
    note, rules = "<p>A note</p>", "<h2>Rules</h2><h3>By the staff</h3><h4>To all</h4>"
    bodies = [f"{note if n % 2 else ''}{rules}{'' if n % 2 else note}<p>Words {n}</p>" for n in range(10)]
    got = extracted(spark, bodies)
    assert got == [["A note", f"Words {n}"] for n in range(10)]


def test_a_text_has_a_role_for_each_place(spark):
    # "More" opens every page; on some it is said again in the page's own words
    bodies = [f"<p>More</p><h2>Site</h2><p>Words {n}</p>" + "<p>More</p>" * (n % 3) for n in range(12)]
    assert extracted(spark, bodies) == [[f"Words {n}"] + ["More"] * (n % 3) for n in range(12)]


def test_roles_are_sought_again_until_none_is_new(spark):
    # the last "Note" of a box joins its class by its place in the host's, and only then "Line" stands inside the box
    box = "<h5>Box</h5><p>Note</p><h6>Low</h6><p>Line</p><p>Note</p>"
    bodies = [f"<h2>Site</h2>{'<p>Line</p>' * (n % 2)}{box * (1 + n % 3)}<h3>Words {n}</h3>" + "<p>Note</p>" * (n % 2) for n in range(12)]
    assert extracted(spark, bodies) == [["Line"] * (n % 2) + [f"Words {n}"] + ["Note"] * (n % 2) for n in range(12)]


def test_a_class_in_two_places_is_not_nested(spark):
    box = "<section><h5>Box</h5></section>"
    bodies = []
    for n in range(20):
        boxes = box * (1 + n % 3 // 2)
        bodies.append(f"{boxes if n % 2 else ''}<h2>Site</h2><h3>Rules</h3>{'' if n % 2 else boxes}<p>Words {n}</p>")
    assert extracted(spark, bodies) == [["Box"] * (1 + n % 3 // 2) + [f"Words {n}"] for n in range(20)]


def test_order_of_a_page():
    assert violations([A, B, C, A, B, C], Classes([[A, B, C]]))[:2] == (set(), set())
    assert violations([A, X, B, C, D], Classes([[A, B, C, D, X]]))[0] == {X}
    assert violations([A, B, A, C, B, C], Classes([[A, B, C]]))[0]


def test_spans_that_cross_and_places_around():
    assert violations([A, C, B, D], Classes([[A, B], [C, D]]))[1] == {1}
    assert violations([C, A, D, B], Classes([[A, B], [C, D]]))[1] == {1}
    assert violations([A, C, D, C, D, B], Classes([[A, B], [C, D]]))[1] == set()
    around = violations([A, C, D, B, E, C, D, X], Classes([[A, B, E, X], [C, D]]))[2]
    assert len(around[0]) == 1 and len(around[1]) == 2


def test_roles_by_place():
    found = roles([Y, A, Y, B, Y, C, Y], [Classes([[A, B, C]])])
    assert (found[0], found[6]) == (Y, Y) and len({found[0], found[2], found[4]}) == 3 and all(role & 1 for role in found)
    text = roles([A, 4, B], [Classes([[A, B]])])[1]
    assert text != 4 and text & 1 == 0
    assert roles([B, 4, A, 4], [Classes([[A, B]])])[1] == 4  # a page that is not built so


def test_what_is_left_of_random_classes_is_ordered_and_nested():
    draw = random.Random(5)
    for _ in range(3000):
        size, times = draw.randint(2, 5), draw.randint(1, 3)
        classes = [[10 * c + i for i in range(size)] for c in range(draw.randint(1, 3))]
        tokens = [role for known in classes for role in known] * times
        if draw.random() < 0.7:
            draw.shuffle(tokens)
        moved, crossed, _ = violations(tokens, Classes(classes))
        kept = [[role for role in known if role not in moved] for c, known in enumerate(classes) if c not in crossed]
        spans = []
        for known in (k for k in kept if len(k) > 1):
            assert [t for t in tokens if t in known] == known * times
            at = [place for place, t in enumerate(tokens) if t in known]
            spans += [(at[k * len(known)], at[(k + 1) * len(known) - 1]) for k in range(times)]
        assert not any(a < c < b < d for a, b in spans for c, d in spans)
