"""SentencePiece codec, HTML extraction and the pipeline."""

from __future__ import annotations

import random
import re
import sys
from pathlib import Path

import pytest

from millrace.llm.html_extract import ARTICLE, MARKED, UNMARKED, blocks_of, extract_text
from millrace.llm.sentencepiece_codec import EDGE, MARK, Codec, choose, decode_documents, encode_documents, product

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def codec():
    return Codec(MODEL)


def odd_texts():
    r = random.Random(3)
    letters = "  ▁aabcehlnost étñ中😀\n0123the in er"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(1, 120))) for _ in range(150)]
    texts += [" " * n for n in range(1, 45)] + ["a" + " " * n + "b" * n for n in range(1, 45, 3)]
    return [*texts, "x" * 300, "ab" * 200, "the" * 100, "aeiou" * 60, "<0xFC><s></s><unk>", "Some plain words, and more of them."]


def test_words_equal_the_library(codec):
    for t in odd_texts():
        assert list(codec.encode_marked(" " + t.replace(MARK, " "))) == codec.model.encode(t), t


@pytest.mark.parametrize("chunk", [17, 40])
def test_chunks_equal_the_library(codec, chunk):
    for t in odd_texts():
        marked = MARK + t.replace(" ", MARK)
        parts = []
        for start in range(0, len(marked), chunk):
            low, high = max(0, start - codec.longest), min(len(marked), start + chunk + codec.longest)
            parts.append((marked[low:high], start - low, min(start + chunk, len(marked)) - low))
        matrices = [codec.transfer(*p) for p in parts]
        total = matrices[0]
        for m in matrices[1:]:
            total = product(total, m)
        assert total == {(EDGE, EDGE): 0.0}, t
        ends = [EDGE, *choose(matrices, EDGE, EDGE), EDGE]
        ids = [i for p, a, b in zip(parts, ends, ends[1:], strict=False) for i in codec.trace(*p, a, b)]
        assert ids == codec.model.encode(t), t


def test_product_is_associative(codec):
    text = MARK + MARK.join("some words that are being cut anywhere".split()) * 3
    at = [0, 20, 45, 70, len(text)]
    a, b, c, d = (codec.transfer(text, x, y) for x, y in zip(at, at[1:], strict=False))
    assert product(product(product(a, b), c), d) == product(a, product(b, product(c, d))) == product(product(a, b), product(c, d))


@pytest.mark.parametrize("chunk", [100, 1 << 15])
def test_documents(spark, codec, chunk):
    texts = [*odd_texts()[:40], None, "", "word and word " * (700 if chunk == 100 else 6000), "z" * 500]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(0, texts[0], "x", 1), (None, "a b", "x", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string, row_key int").repartition(3)
    found = encode_documents(frame, MODEL, chunk=chunk, round_trip=True)
    decoded = decode_documents(found, MODEL).collect()
    expected = sorted(((i is None, i or 0), codec.model.encode(t or "")) for i, t, *_ in rows)
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.ids) for r in decoded) == expected
    by = {i: t for i, t, *_ in rows}
    assert all(r.round_trip and r.decoded == (by[r.doc_id] or "").replace(MARK, " ") for r in decoded)
    assert max(r.n_chunks for r in decoded) > (64 if chunk == 100 else 1)
    assert encode_documents(frame.limit(0), MODEL).count() == 0


BLOCKS = {
    "<p>a<b>b</b> c &amp;amp; d<br>e": [(UNMARKED, "ab c &amp; d"), (UNMARKED, "e")],
    "<nav>x<nav>y</nav>z</nav>w<article>t <p class='ad box'>q<p>r</article>u": [(MARKED, "x"), (MARKED, "y"), (MARKED, "z"), (UNMARKED, "w"), (ARTICLE, "t"), (MARKED, "q"), (ARTICLE, "r"), (UNMARKED, "u")],
    '<script>var a="</p>";</script>ok<!-- x': [(UNMARKED, "ok")],
    "<article><header>h</header><h1>T</h1>b<form>f</form>c</article><footer>z": [(MARKED, "h"), (ARTICLE, "T"), (ARTICLE, "b"), (MARKED, "f"), (ARTICLE, "c"), (MARKED, "z")],
    "a < b and <3 c": [(UNMARKED, "a < b and <3 c")],
    '<div class="comment-list">x<div>y</div></div>z<a href="a>b">k</a>': [(MARKED, "x"), (MARKED, "y"), (UNMARKED, "zk")],
    "<head><title>t</title><style>s</style><body>b": [(UNMARKED, "b")],
    "<MAIN>\n A\t B </MAIN>": [(ARTICLE, "A B")],
    "<article>cut off <b": [(ARTICLE, "cut off")],
    "<form><article>in</article></form>": [(ARTICLE, "in")],
    "": [],
}


@pytest.mark.parametrize("html", BLOCKS)
def test_blocks(html):
    assert blocks_of(html) == BLOCKS[html]


def test_extraction(spark):
    notice = "this site keeps small files on your machine"  # eight words
    pages = [
        (1, "http://h.com/1", f"<div>{notice}</div><div>first page has words of its own here</div>"),
        (2, "http://h.com/2", f"<div>{notice}</div><div>second one</div>"),
        (3, "http://other.com/1", f"<div>{notice}</div>"),
        (4, "http://h.com/4", f"<article>{notice}</article><aside>side</aside>"),
        (5, "http://h.com/5", None),
        (6, None, "<p>x</p>"),
        (7, "http://h.com/7", ""),
        (8, "http://one.com/", "<p>a b c d e f g h</p>"),
        (8, "http://one.com/", "<p>a b c d e f g h</p>"),
        (None, "http://x.com", "<nav>n</nav><article>" + "<p>w w</p>" * 20000),
    ]
    frame = spark.createDataFrame([(*p, "h", 1) for p in pages], "page_id long, url string, html string, host string, row_key int").repartition(3)
    found = {(r.page_id, r.text, r.n_chars) for r in extract_text(frame).collect()}
    texts = {1: "first page has words of its own here", 2: "second one", 3: notice, 4: notice, 5: "", 6: "x", 7: "", 8: "a b c d e f g h", None: " ".join(["w w"] * 20000)}
    assert found == {(i, t, len(t)) for i, t in texts.items()}
    assert extract_text(frame).count() == len(pages) and extract_text(frame.limit(0)).count() == 0


def test_repeated_runs_against_brute_force(spark):
    r = random.Random(8)
    pool = [" ".join(r.choice("abcdefghij") * 2 for _ in range(9)) for _ in range(4)]
    pages = [(i, f"http://h{i % 2}.com/{i}", "".join(f"<p>{r.choice(pool) if r.random() < 0.5 else ' '.join(r.choice('klmnopq') for _ in range(12))}</p>" for _ in range(3))) for i in range(20)]
    found = {p.page_id: p.text for p in extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    words = {i: re.sub(r"<[^>]*>", " ", h).split() for i, _, h in pages}
    for i, url, _ in pages:
        others = {tuple(words[j][k : k + 6]) for j, u, _ in pages if j != i and u[:10] == url[:10] for k in range(len(words[j]) - 5)}
        covered = {k + d for k in range(len(words[i]) - 5) if tuple(words[i][k : k + 6]) in others for d in range(6)}
        assert found[i] == " ".join(w for k, w in enumerate(words[i]) if k not in covered)


# The pipeline


@pytest.fixture(scope="module")
def pipeline():
    sys.path.insert(0, str(Path(__file__).parents[2]))
    import corpus_pipeline

    return corpus_pipeline


def test_pipeline_by_stage(spark, pipeline, tmp_path):
    r = random.Random(6)
    english, german = "the thing and that which when this then other house".split(), "der die das und nicht eine schön für über haus".split()

    def text(words, lines=3):
        return "\n".join(" ".join(r.choice(words) + r.choice("abcdefgh") for _ in range(14)) for _ in range(lines))

    passage = " ".join(r.choice(english) + r.choice("xyz") for _ in range(30))
    rows = [(i, text(english if i % 2 else german), "en" if i % 2 else "de", "s") for i in range(60)]
    rows += [(100, rows[3][1].replace("\n", " "), "en", "s"), (101, "123 456", "en", "s"), (102, None, None, None), (103, "", "de", "s")]
    rows += [(104, text(english) + "\n" + passage, "en", "s"), (105, rows[5][1].split("\n")[0] + "\n" + text(english, 1), "en", "s")]
    docs = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < 4:
            assert out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = {x.doc_id: x for x in now.collect()}
        assert len(seen[name]) == now.count()
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    everything = {i for i, *_ in rows}
    assert set(seen["language_id"]) == everything - {101, 102, 103}
    assert set(seen["line_dedup"]) == set(seen["language_id"])
    assert seen["line_dedup"][105].text == rows[-1][1].split("\n")[1] and seen["line_dedup"][105].n_chars == len(seen["line_dedup"][105].text)
    assert set(seen["minhash"]) == set(seen["line_dedup"]) - {100}
    assert set(seen["decontaminate"]) == set(seen["minhash"]) - {104}
    assert set(seen["sentencepiece"]) == set(seen["decontaminate"]) and all(x.round_trip for x in seen["sentencepiece"].values())
    whole = {x.doc_id: x.ids for x in pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {i: x.ids for i, x in seen["sentencepiece"].items()}
