"""Languages, pages and tokens."""

import numpy as np
import pytest

from borehole.llm import blocks, bpe, language

DATA = "/root/testdata/sf0.01"


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_texts(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "123 ...", None), (4, "the end of the day", "en"),
            (5, "der Tag und die Nacht", "de"), (5, "der Tag und die Nacht", "de"), (6, "x" * 100_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs)
    got = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5)] == ["und", "und", "und", "en", "de"]
    assert got[1].score == 0 and language.predict(docs, model).count() == 7
    unlabelled = language.fit(docs.where("lang is null"))
    assert {r.lang_pred for r in language.predict(docs, unlabelled).collect()} == {"und"}
    single = language.fit(docs.where("lang = 'en'"))
    assert {r.lang_pred for r in language.predict(docs, single).collect()} == {"und", "en"}
    assert language.identify(docs.where("false")).count() == 0


@pytest.mark.parametrize("n", [2, 4, 7, 12])
def test_codewords_differ(n):
    code = language.codewords(n).astype(int)
    apart = (code.shape[1] - code @ code.T) // 2
    assert apart[~np.eye(n, dtype=bool)].min() >= 1
    assert n > 7 or code.shape[1] == 2 ** (n - 1) - 1


PAGE = """<html><head><title>T</title><script>if (a<b) "</p>";</script></head><body>
<nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies on this page</div>
<article><h1>A &amp; B</h1><p>First\n  para&nbsp;graph <b>bold<br>text</p><p>x &lt; y
<section id="comments"><p>A reader says hello to everyone here</p></section></article>
<form><button>Go</button>Sign up</form><footer>&copy; us</footer></body>"""


def test_pages(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<p>" + "word " * 50_000), (1, "u", PAGE)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = blocks.extract(table).collect()
    by = {r.page_id: r for r in got}
    assert by[1].text == "A & B\nFirst para graph bold text\nx < y"
    assert by[2].text == by[3].text == "" and by[2].n_chars == 0
    assert by[4].n_chars == 50_000 * 5 - 1 and len(got) == 5
    assert blocks.extract(table.where("false")).count() == 0


def test_names_of_asides():
    for name in ("ad", "site-footer", "cookieNotice", "comment-42", "col-4 left-sidebar", "top_nav"):
        assert blocks.aside_name(name), name
    for name in ("side-effects", "social-security", "share-price-note", "article-header", "post-header", "main", ""):
        assert not blocks.aside_name(name), name
    page = """<article><header class="article-header"><h1 class="post-header">Title</h1></header>
        <section class="side-effects"><p>Some people feel tired after it.</p></section>
        <div class="share-price-note">The price fell.</div><div class="comment-list"><p>Nice one!</p></div></article>"""
    assert blocks.main_text(page, blocks.trained()) == "Title\nSome people feel tired after it.\nThe price fell."


def test_tokens_equal_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(150).collect()]
    texts += [None, "", "I'LL 'ss ''s 're've12²½", "ΑΣ ΣΑΣ İ ß", "漢字 ひらがな 🙂", "a" * 3000, "<|endoftext|>x<|startoftext|>",
              "\x00\x1f\x7f\x85 ​", "ét́"]
    texts += ["the" * 40 + "ing" * 30 + "zq" * 50 + "ß" * 40]  # one word above LONG bytes
    # other columns, also of the result's names, take no part; repeated rows come back
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(0, texts[0], "x", 1), (None, texts[1], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int")
    for coded in (bpe.decode(bpe.encode(docs)), bpe.encode(docs, decoded=True)):
        assert coded.columns == ["doc_id", "n_tokens", "ids", "decoded"]
        got = coded.collect()
        assert len(got) == len(rows)
        for r in got:
            ids = lib.encode(texts[1 if r.doc_id is None else r.doc_id] or "", add_special_tokens=False).ids
            assert (r.ids, r.n_tokens) == (ids, len(ids))
            assert r.decoded == lib.decode(ids, skip_special_tokens=False)
    assert bpe.decode(bpe.encode(docs.where("false"))).count() == 0
