"""Child lists of any length are matched alike."""

import random

import pytest

from keelspark.llm import html_extract


def best(left, right):
    """The largest order-keeping match of two rows of (sign, text), most equal texts among the largest."""
    row = [(0, 0)] * (len(right) + 1)
    for sign, text in left:
        new = [(0, 0)]
        for j, (other, theirs) in enumerate(right):
            more = [(row[j][0] + 1, row[j][1] + (text == theirs))] if sign == other else []
            new.append(max(row[j + 1], new[j], *more))
        row = new
    return row[-1]


@pytest.mark.parametrize("n", [20, 190, 230, 500])
def test_match_of_long_lists(n):
    rng = random.Random(n)
    some = [[(rng.choice(["p", "h2", "ul"]), rng.choice("abcde")) for _ in range(k)] for k in (n, n + n // 10)]
    a, b = (html_extract.parse("<div>" + "".join(f"<{s}>{t}</{s}>" for s, t in rows) + "</div>") for rows in some)
    texts = html_extract.owned(a), html_extract.owned(b)
    for x, y, mine, yours in ((a, b, *texts), (b, a, *reversed(texts))):
        size, pairs = html_extract.align(x, y)
        equal = sum(1 for p, q in pairs if id(p) in mine and mine[id(p)] == yours.get(id(q)))
        assert (size - 2, equal) == best(*some) and len(pairs) == size


@pytest.mark.parametrize("n", [40, 400])
def test_template_in_long_lists(n):
    pages, want = [], []
    for i in range(5):
        own = [f"Paragraph {i}.{k} of this page" for k in range(n + 3 * i)]
        shown = [f"<p>{t}</p>" + ("<p>All rates may change</p>" if (k - 3 * i) % 10 == 5 and k >= 3 * i else "") for k, t in enumerate(own)]
        pages.append(f"<html><body><div class=c1>{''.join(shown)}</div></body></html>")
        want.append("\n\n".join(own))
    made = html_extract.induce(pages)
    assert [html_extract.extract(p, {html_extract.layout(html_extract.parse(p)): made}) for p in pages] == want


def test_list_of_a_hundred_thousand():
    many = html_extract.parse("<div>" + "".join(f"<p>a{i}" for i in range(100_000)) + "</div>")
    few = html_extract.parse("<div>" + "".join(f"<p>a{7 * i}" for i in range(40)) + "</div>")
    texts = html_extract.owned(many), html_extract.owned(few)
    size, pairs = html_extract.align(many, few)
    assert size == 42 and sum(texts[0].get(id(p)) == texts[1].get(id(q)) for p, q in pairs if id(p) in texts[0]) == 40
