"""Trees of pages and of cases, some of them broken."""

from __future__ import annotations

import json

import pytest

from anchorspark.sources import trees

GOOD = """
- id: b1
  profile: engineering
  prompt: " Hvad er det? "
  test_types: [Retrieval, " Multi_hop "]
  expected:
    must_include_any_of: ["Article: 6 ", "annex:III"]
- id: b2
  profile: LEGAL
  prompt: q
  synthesis_mode: "null"
  target_corpora: [cra, 7]
  expected: {behavior: Abstain, min_citations: 1, contract_check: true, min_corpora_cited: 2}
"""


def test_pages(spark, tmp_path):
    for name, data in {"a/x.html": "<p>ø".encode(), "b/x.html": b"<p>\xff", "b/c/y.htm": b"", "z.txt": b"no page", "big.xhtml": b"x" * 200}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    pages, aside = trees.read_pages(spark, f"file://{tmp_path}", most_bytes=100)
    got = {r.page_id.split(tmp_path.name)[1]: r.html for r in pages.collect()}
    assert got == {"/a/x.html": "<p>ø", "/b/x.html": "<p>�"}
    assert [(r.file.rsplit("/")[-1], r.reason) for r in aside.collect()] == [("big.xhtml", "larger than the bound")]
    assert trees.read_pages(spark, f"file://{tmp_path}/a", pattern="*.md")[0].count() == 0


def test_cases(spark, tmp_path):
    files = {
        "law/good.yaml": GOOD, "more.json": json.dumps({"cases": [{"id": 5, "profile": "legal", "prompt": "p"}]}), "broken.yml": "- id: [", "empty.json": "", "object.json": "{}", "half.yaml": GOOD + "\n- id: b3\n  profile: OTHER\n  prompt: x\n",
        "mood.json": json.dumps([{"id": "x", "profile": "LEGAL", "prompt": "p", "expected": {"behavior": "guess"}}]), "odd.json": "[3]", "anchors.json": json.dumps([{"id": "x", "profile": "LEGAL", "prompt": "p", "expected": {"must_include_all_of": 3}}]), "notes.md": "no case",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    cases, aside = trees.read_cases(spark, f"file://{tmp_path}")
    got = {r.id: r for r in cases.collect()}
    assert set(got) == {"b1", "b2", "5"}
    a, b, c = got["b1"], got["b2"], got["5"]
    assert (a.profile, a.prompt, a.test_types, a.must_include_any_of) == ("ENGINEERING", "Hvad er det?", ["retrieval", "multi_hop"], ["article:6", "annex:iii"])
    assert (a.contract_check, a.min_citations, a.max_citations, a.behavior, a.origin, a.corpus_scope) == (True, 2, 8, "answer", "auto", "single")
    assert (b.synthesis_mode, b.target_corpora, b.behavior, b.min_citations, b.max_citations, b.min_corpora_cited) == (None, ["cra", "7"], "abstain", 1, 8, 2)
    assert (c.contract_check, c.min_citations, c.required_corpora) == (False, None, [])
    why = {r.file.rsplit("/")[-1]: r.reason for r in aside.collect()}
    assert set(why) == {"broken.yml", "half.yaml", "object.json", "mood.json", "odd.json", "anchors.json"}
    assert why["half.yaml"] == "case 2: profile 'OTHER'" and why["odd.json"] == "case 0: a case must be an object" and why["object.json"] == "no list of cases" and "guess" in why["mood.json"]


@pytest.mark.parametrize("item", [None, [], {"id": " "}, {"id": "a", "profile": "LEGAL"}])
def test_cases_that_lack_something(item):
    with pytest.raises(ValueError):
        trees.case_of(item)
