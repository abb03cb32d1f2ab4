"""Official-journal pages: structure, titles, markers and tables by hand-made pages."""

from __future__ import annotations

import random

import public_tokenizers
import pytest

from anchorspark.sources import official, passages
from anchorspark.sources.budget import Budget

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
BUDGET = Budget(TOKENIZER)

PAGE = """
<html><head><title>t</title></head><body><nav>menu</nav>
<p>(42)</p><p>Whereas this.</p><p>(43)</p><p>Whereas that.</p>
<div id="cpt_I"><p class="oj-ti-section-1">KAPITEL I</p><p class="oj-ti-section-2">ALMINDELIGE BESTEMMELSER</p>
<div id="cpt_I.sct_2"><p>AFDELING 2</p><p class="oj-ti-section-2">Anden del</p>
<div id="art_6"><p class="oj-ti-art">Artikel 6</p><p class="oj-sti-art">Regler</p>
<p>1. First rule:</p><p>a)</p><p>letter a</p><p>—</p><p>b)</p><p>letter b</p><p>ii)</p><p>roman</p><p>(2)</p><p>Second &amp; last.</p></div></div></div>
<div id="anx_III"><p class="oj-doc-ti">BILAG III</p><p class="oj-doc-ti">Systemer</p>
<p class="oj-ti-grseq-1">Afsnit A. Lister</p><p>1.</p><p>Point one</p><p>2. Point two</p><p>2.1 Sub two one</p>
<table class="oj-table"><tr class="oj-table"><td class="oj-table">Sektor</td><td>Delsektor</td><td>Type enhed</td></tr><tr><td rowspan="2">Energi</td><td>El</td><td>Producent</td></tr><tr><td>Gas</td><td>Leverandør</td></tr></table>
<table class="oj-table"><tr><td>Direktiv 1</td><td>Nærværende direktiv</td></tr><tr><td>Artikel 1</td><td>Artikel 2</td></tr></table>
<table class="oj-table"><tr><td>k</td><td>v</td></tr></table></div></body></html>
"""


def test_places_titles_and_markers():
    got = list(official.chunk_official(PAGE, BUDGET))
    short = [(c["recital"], c["chapter"], c["section"], c["article"], c["paragraph"], c["litra"], c["text"]) for c in got if not c["annex"]]
    assert short == [
        ("42", None, None, None, None, None, "(42) Whereas this."), ("43", None, None, None, None, None, "(43) Whereas that."),
        (None, "I", "2", "6", "1", None, "1. First rule:"), (None, "I", "2", "6", "1", "a", "a) letter a"), (None, "I", "2", "6", "1", "b", "b) letter b"), (None, "I", "2", "6", "1", None, "ii) roman"), (None, "I", "2", "6", "2", None, "(2) Second & last."),
    ]
    article = next(c for c in got if c["article"])
    assert (article["chapter_title"], article["section_title"], article["article_title"]) == ("ALMINDELIGE BESTEMMELSER", "Anden del", "Regler")


def test_annexes_and_tables():
    got = [c for c in official.chunk_official(PAGE, BUDGET) if c["annex"]]
    assert [(c["annex_section"], c["annex_point"], c["annex_subpoint"], c["sector"], c["subsector"], c["text"]) for c in got] == [
        ("A", "1", None, None, None, "1. Point one"), ("A", "2", None, None, None, "2. Point two"), ("A", "2", "2.1", None, None, "2.1 Sub two one"),
        ("A", "2", "2.1", "Energi", "El", "Sektor: Energi Delsektor: El Type enhed: Producent"), ("A", "2", "2.1", "Energi", "Gas", "Sektor: Energi Delsektor: Gas Type enhed: Leverandør"), ("A", "2", "2.1", None, None, "k v"),
    ]
    assert all(c["annex"] == "III" and c["annex_title"] == "Systemer" and c["annex_section_title"] == "Lister" and c["chapter"] is None for c in got)


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "<table class='oj-table'><tr><td>open"), (4, ""), (1, PAGE), (None, "<p>w " + "word " * 1200)], "page_id long, html string")
    rows = passages.passages(pages, TOKENIZER, "official").collect()
    assert sum(r["page_id"] == 1 for r in rows) == 2 * len(list(official.chunk_official(PAGE, BUDGET)))
    assert [r["text"] for r in rows if r["page_id"] == 3] == ["open"]
    assert all(r["n_tokens"] == BUDGET.count(r["text"]) <= 500 for r in rows) and sum(r["page_id"] is None for r in rows) == 3


def words(n: int) -> str:
    rnd = random.Random(n)
    return "".join(rnd.choice(["det ", "forordning ", "ØKO-systemer, ", "x. ", "Nr. 7! ", "漢字 ", "  ", "a\u00a0b ", "overensstemmelsesvurdering? "]) for _ in range(n))


@pytest.mark.parametrize(("most", "overlap"), [(500, 100), (30, 10), (7, 0), (1, 0)])
def test_budget(most, overlap):
    budget = Budget(TOKENIZER, most, overlap)
    for text in ["", "  ", words(40), words(2000), "w " * 3000, "ab" * 3000, "<|endoftext|> " * 90, "One. " + "two " * 700 + "three. Four."]:
        got = list(budget.pieces(text))
        assert all(n == budget.count(piece) and (n <= most or len(piece) == 1) for piece, n in got)
        whole, at, done = " ".join(text.split()), 0, 0  # the pieces cover the text in order; what two share is the second one's start
        for piece, _ in got:
            own = " ".join(piece.split())
            start = max((k for k in range(at, done + 2) if whole.startswith(own, k) and k + len(own) > done), default=-1)
            assert start >= 0
            at, done = start, start + len(own)
        assert done == len(whole)


def test_budget_takes_sentences_and_overlaps_them():
    budget = Budget(TOKENIZER, 12, 6)
    got = [piece for piece, _ in budget.pieces(" ".join(f"s{i} a b." for i in range(9)))]
    assert got[0] == "s0 a b. s1 a b." and got[1].startswith("s1 a b. s2") and all(piece.endswith("b.") for piece in got)
    with pytest.raises(ValueError, match="overlap"):
        Budget(TOKENIZER, 5, 5)


def test_passages_in_sql(spark):
    passages.register(spark)
    spark.createDataFrame([("x", "<h1>Artikel 6</h1><p>1. One.</p>" + "<p>word. " * 900), ("y", None)], "page_id string, html string").createOrReplaceTempView("few_pages")
    rows = spark.sql(f"SELECT page_id, c.* FROM few_pages, LATERAL html_passages(html, 'generic', '{TOKENIZER}', 50, 10) c").collect()
    assert {r.page_id for r in rows} == {"x"} and max(r.n_tokens for r in rows) <= 50 and {(r.article, r.paragraph) for r in rows} == {("6", "1")}
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
