"""HTML extraction: copies and passages that pages share."""

from __future__ import annotations

import random

from millrace.llm.html_extract import extract_text

SCHEMA = "page_id long, url string, html string"


def prose(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(n))


def test_copies_and_shared_passages_without_an_article(spark):
    r = random.Random(5)
    menu, passage = prose(r, 8), prose(r, 30)
    own = [prose(r, 40) for _ in range(40)]
    texts = [f"{o} {passage}" if i < 3 else o for i, o in enumerate(own)]
    page = [f"<div>{menu}</div><div>{t}</div>" for t in texts]
    pages = [(i, f"http://h.com/{i}", p) for i, p in enumerate(page)]
    pages += [(100, "http://h.com/5?utm_source=x", page[5]), (101, "https://h.com/6", page[6]), (102, "http://h.com/7", page[7])]
    pages += [(103, "http://two.com/1", page[8]), (104, "http://two.com/1?a", page[8])]
    found = {p.page_id: p.text for p in extract_text(spark.createDataFrame(pages, SCHEMA)).collect()}
    whole = f"{menu} {texts[8]}"
    assert found == dict(enumerate(texts)) | {100: texts[5], 101: texts[6], 102: texts[7], 103: whole, 104: whole}


def test_notices_inside_articles(spark):
    r = random.Random(6)
    notice, passage = "This story was sent to you by our partners.", prose(r, 30)
    bodies = [[prose(r, 40)] + ([passage] if i < 4 else []) for i in range(12)]
    pages = [(i, f"http://h.com/{i}", f"<article><p>{notice}</p>" + "".join(f"<p>{b}</p>" for b in body) + "</article>") for i, body in enumerate(bodies)]
    pages += [(20, "http://h.com/20", f"<article>{notice}</article>"), (21, "http://small.com/1", f"<article><p>{notice}</p><p>x</p></article>")]
    pages += [(30 + i, f"http://copies.com/{i}", "<article><p>one</p><p>story</p></article>") for i in range(8)]
    found = {p.page_id: p.text for p in extract_text(spark.createDataFrame(pages, SCHEMA)).collect()}
    expected = {i: " ".join(body) for i, body in enumerate(bodies)} | {20: notice, 21: f"{notice} x"} | {30 + i: "one story" for i in range(8)}
    assert found == expected


def test_runs_decide_inside_articles(spark):
    """Two notices that stand in one block on some pages and in two on others: no block of both is in half of the articles, their runs are."""
    r = random.Random(8)
    one, two, few = prose(r, 10), prose(r, 9), "Read more"
    bodies = [prose(r, 30) for _ in range(10)]
    shown = [f"<p>{one} {two}</p>" if i < 4 else f"<p>{one}</p><p>{two}</p>" for i in range(10)]
    pages = [(i, f"http://h.com/{i}", f"<article>{shown[i]}<p>{body}</p><p>{few}</p></article>") for i, body in enumerate(bodies)]
    # A block that only begins as they do stays whole.
    pages.append((10, "http://h.com/10", f"<article><p>{one} but this is new</p><p>{bodies[0][::-1]}</p></article>"))
    found = {x.page_id: x.text for x in extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert found == dict(enumerate(bodies)) | {10: f"{one} but this is new {bodies[0][::-1]}"}
