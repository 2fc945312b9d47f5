"""Exact dedup, URL filter, token counts, language ID and toxicity, with odd rows."""

from __future__ import annotations

import random
import hashlib
import re
import zlib

import numpy as np
import pytest

from millrace.llm import language_id, toxicity
from millrace.llm.exact_dedup import DigestIndex, exact_dedup
from millrace.llm.language_id import identify_languages
from millrace.llm.token_count import Cutter, count_tokens
from millrace.llm.toxicity import noisy_or, score_toxicity, train_toxicity
from millrace.llm.url_filter import build_filter, canonical_rules, filter_urls

public_tokenizers = pytest.importorskip("public_tokenizers")
#: Columns whose names the operators use inside.
CLASHING = "doc_id long, text string, digest string, key string, score double, w string, n int, row_key int, hash string, words string, held_out string, label int, keep_id long"


def docs(spark, rows, clash=False):
    if clash:
        return spark.createDataFrame([(*r, "x", "x", 0.5, "x", 1, 2, "x", "x", "x", 1, 7) for r in rows], CLASHING)
    return spark.createDataFrame(rows, "doc_id long, text string")


TEXTS = [(1, "a b"), (2, "ab"), (3, "a\tb\n"), (4, None), (5, ""), (6, " \r\x0b\x0c"), (7, "é  x"), (8, "éx"), (8, "éx"), (9, "\xa0ab"), (None, "ab"), (10, "ab c" * 40000)]


@pytest.mark.parametrize("clash", [False, True])
def test_exact_dedup(spark, clash):
    found = exact_dedup(docs(spark, TEXTS, clash)).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    groups: dict = {}
    for i, t in TEXTS:
        groups.setdefault(norm(t), []).append((-len(t or ""), i is None, i or 0, i))
    expected = sorted((i is None, i or 0, min(groups[norm(t)])[3], len(groups[norm(t)]), i == min(groups[norm(t)])[3], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in TEXTS)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in found) == expected
    assert exact_dedup(docs(spark, [])).collect() == []


def test_digest_index_persists(spark):
    index = DigestIndex.create(spark, 3)
    exact_dedup(docs(spark, [(1, "a"), (2, "b")]), index=index)
    later = exact_dedup(docs(spark, [(0, "a  "), (5, "c"), (6, "c")]), index=index).collect()
    assert sorted((r.doc_id, r.keep_id, r.kept) for r in later) == [(0, 1, False), (5, 5, True), (6, 5, False)]
    spark.sql(f"DROP TABLE {index.name}")
    index.attach(spark)
    assert index.read(spark).count() == 3
    plan = index.read(spark).select("digest").groupBy("digest").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan  # the bucketing serves


RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("a.b.org", "/", "block")]
URLS = [
    (1, "http://x.com/en/1"), (2, "http://www.Example.COM/en/745?x#y"), (3, "https://example.com/en/8"), (4, "example.com/en/7"), (5, None), (6, ""), (7, "ftp://com/en/"), (8, "http://notcom/en/"),
    (9, "http://a.b.org"), (10, "http://z.a.b.org/#"), (11, "http://net/de"), (12, "http://u.net/de/?//com/en/"), (12, "http://u.net/de/?//com/en/"), (13, "x://y://com/en/"), (None, "http://q.com/en/"), (14, "http://" + "a." * 3000 + "com/en/" + "p" * 50000),
]


def judged(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    host, path = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, "allow"))


@pytest.mark.parametrize("blocks", [1, 1 << 10])
def test_url_filter(spark, blocks):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, u, "x", "y", 1) for i, u in URLS], "page_id long, url string, host string, key string, block int")
    found = filter_urls(pages, rules, blocks=blocks).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *map(str, r[1:]))
    assert sorted(map(tuple, found), key=key) == sorted(((i, *judged(u)) for i, u in URLS), key=key)
    assert filter_urls(pages, rules.limit(0)).where("verdict = 'allow'").count() == len(URLS)
    assert filter_urls(pages.limit(0), rules).count() == 0


def test_bloom_filter_is_bounded(spark):
    rules = spark.range(500).selectExpr("concat('h', id, '.com') AS host", "'/' AS path", "'block' AS verdict")
    assert build_filter(canonical_rules(rules), 16).count() <= 16


ODD = ["", None, "  \n", "İstanbul don't DON'T 'S x<|endoftext|>y <|startoftext|>", "a\xa0b\x1cc\x85d", "e\u0301te\u0301 ǅ ſ ß", "中文 字 😀😀", "１２３ ½", "<|endoftext|><|endoftext|>", "\x00a\x01 a_b__c", "I'M ''s", "word " * 30000, "x" * 20000]


def test_token_counts_equal_the_library(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Cutter(path).tokenizer
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, ODD[3]), (None, "some text")]
    expected = sorted((i is None, i or 0, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    for head, clash in ((1 << 18, False), (3, True), (0, False)):
        found = count_tokens(docs(spark, rows, clash), path, head=head).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in found) == expected
        assert all(r.over_limit == (r.n_tokens > 2048) for r in found)
    assert count_tokens(docs(spark, []), path).count() == 0


LANGS = {"aa": "the thing and that which when this then other", "bb": "der die das und nicht eine schön für über", "cc": "el que los para una más señor niño"}


def language_rows():
    r = np.random.default_rng(1)
    rows = []
    for i in range(120):
        lang = sorted(LANGS)[i % 3]
        rows.append((i, " ".join(r.choice(LANGS[lang].split(), 25)), lang))
    return rows + [(200, None, "aa"), (201, "", "bb"), (202, "123 ... ", "cc"), (203, "Q", None), (204, "der die das " * 20000, "bb"), (204, "der die das", "bb")]


def test_language_id(spark):
    rows = spark.createDataFrame(language_rows(), "doc_id long, text string, lang string")
    found = {(r.doc_id, r.lang_pred): r for r in identify_languages(rows, dim=256).collect()}
    assert all((i, lang) in found for i, t, lang in language_rows() if i < 200 or i == 204)
    assert all(found[i, "und"].score == 0 for i in (200, 201, 202))
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for (i, _), r in found.items())
    kept = identify_languages(rows.selectExpr("*", "1 AS score", "2 AS lang_pred"), dim=256, keep=True)
    assert kept.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and kept.count() == rows.count()
    assert identify_languages(rows.limit(0)).count() == 0
    assert {r.lang_pred for r in identify_languages(rows.selectExpr("doc_id", "text", "cast(null AS string) AS lang")).collect()} == {"und"}


def test_profiles_against_brute_force():
    text, dim, n, seed = "ab, cAb", 64, 3, 7
    rolled = language_id._letter_vectors(dim, n, seed)
    number = lambda c: 0 if c == " " else 1 + ord(c)
    total = np.zeros(dim, int)
    padded = " ab cab "
    for gram in (padded[i : i + 3] for i in range(len(padded) - 2)):
        if gram[1] != " ":
            total += np.prod([rolled[k][number(c)] for k, c in enumerate(gram)], axis=0)
    assert (language_id.text_vectors([text, "", None], dim, n, seed) == np.stack([total, 0 * total, 0 * total])).all()


def toxic_rows():
    r = np.random.default_rng(2)
    calm = "the tree grows in green fields near water and stone".split()
    rows, labels = [], []
    for i in range(300):
        toxic = i % 5 == 0
        sentences = [" ".join(r.choice(calm, 8)) for _ in range(6)]
        if toxic:
            sentences[int(r.integers(6))] += " you vilewort" + "abcdefg"[int(r.integers(7))]
        rows.append((i, ". ".join(sentences) + "."))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows()
    odd = [(900, None), (901, ""), (902, "!!! 123"), (903, "you vileworth"), (904, "the tree. " * 20000), (904, "the tree.")]
    all_docs = docs(spark, rows + odd)
    marks = spark.createDataFrame([*labels, (901, None), (5000, 1), (0, 0)], "doc_id long, toxic int")
    model = train_toxicity(all_docs, marks)
    found = score_toxicity(all_docs, model).collect()
    assert len(found) == len(rows) + len(odd)
    for r in found:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    by = {r.doc_id: r for r in found}
    held = [i for i, _ in labels if by[i].held_out]
    assert np.mean([by[i].predicted == dict(labels)[i] for i in held]) > 0.95
    assert by[900].score == by[901].score == by[902].score == 0 and by[903].predicted == 1
    text = dict(rows)[5]
    assert all("vilewort" in text[s.start : s.end] for s in by[5].offending) and by[5].offending
    assert score_toxicity(all_docs.limit(0), model).count() == 0
    untrained = train_toxicity(all_docs, marks.limit(0))
    assert max(r.score for r in score_toxicity(docs(spark, rows[:3]), untrained).collect()) < 1e-6


def test_labels_of_the_held_out_fold_are_not_learned_from(spark):
    rows, labels = toxic_rows()
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    schema = "doc_id long, toxic int"
    a, b = (train_toxicity(docs(spark, rows), spark.createDataFrame(x, schema)) for x in (labels, flipped))
    assert (a.weights == b.weights).all() and a.bias == b.bias


def test_noisy_or():
    assert noisy_or([]) == 0 and noisy_or([0.5, 0.5]) == pytest.approx(0.75) and noisy_or([1.0]) == pytest.approx(1)
    bags = toxicity.bags(["A b. c", None, ""])
    assert bags.doc.tolist() == [0, 0] and len(set(bags.sentence.tolist())) == 2


def test_token_counts_of_odd_characters(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    cutter, r, odd = Cutter(path), random.Random(3), []
    for _ in range(4000):
        odd.append("".join(chr(r.randrange(0x3000)) if r.random() < 0.3 else r.choice("\0\0.,;:!?#'\"()<|>-_ ") if r.random() < 0.6 else r.choice(["aZé1", "<|startoftext|>"]) for _ in range(r.randrange(1, 12))))
    expected = [len(e.ids) for e in cutter.tokenizer.encode_batch(odd, add_special_tokens=False)]
    for text, n in zip(odd, expected, strict=True):
        found, added = cutter.cut(text)
        assert added + sum(f * m for f, m in zip(found.values(), cutter.pieces(list(found)), strict=True)) == n
    rows = [(0, "\0."), (1, "\0. hi"), (2, "\0#2"), (3, "<|startoftext|>\0#"), *((i + 4, t) for i, t in enumerate(odd[:300]))]
    for head in (1 << 18, 3):
        found = {x.doc_id: x.n_tokens for x in count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path, head=head).collect()}
        assert found == {i: len(cutter.tokenizer.encode(t, add_special_tokens=False).ids) for i, t in rows}


def test_language_vectors_of_long_texts_in_many_letters():
    """Equal to the plain bundling of every n-gram, in pieces of any size."""
    from millrace.llm import language_id as own

    r = random.Random(8)
    texts = ["", None, "a", *("".join(chr(r.choice([0x20] * 40 + [*range(0x4E00, 0x5200)])) for _ in range(n)) for n in (30, 4000, 9000))]
    whole = own.text_vectors(texts, 64, 3, 7)
    row, code, count = own.ngram_counts(texts, 3)
    plain = np.zeros((len(texts), 64))
    for i, c, k in zip(row, code, count, strict=True):
        plain[i] += k * own.ngram_vectors(np.array([c]), 64, 3, 7)[0]
    assert (whole == plain).all()
    size, own.PIECE = own.PIECE, 500
    try:
        assert (own.text_vectors(texts, 64, 3, 7) == plain).all()
    finally:
        own.PIECE = size
