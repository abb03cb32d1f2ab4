"""What preflight counts, by small pages."""

from __future__ import annotations

import pytest

from anchorspark.sources import preflight

JOURNAL = '<table class="x oj-table">{}</table>'
ROW = "<tr><td>a</td></tr>"


@pytest.mark.parametrize(
    ("page", "handled", "unhandled"),
    [
        ("", {}, {}),
        ("<p>a<p>b</p><li>c", {"paragraphs": 2, "list_items": 1}, {}),
        ("<div id='ART_6a'><div id='cpt_I'><p id='art_7'></div><div id=anx_x>", {"articles": 1, "chapters": 1, "annexes": 1, "paragraphs": 1}, {}),
        ("<ul>" * 5, {}, {"deep_nested_list": 2}),
        ("<ul></ul>" * 5, {}, {}),
        (JOURNAL.format(ROW * 3), {}, {"unclassified_table": 1}),
        (JOURNAL.format(ROW * 2), {}, {}),
        (JOURNAL.format("<tr><td>Direktiv 95</td><td>Nærværende forordning</td></tr>" + "<tr><td>1</td><td>2</td></tr>" * 4), {"concordance_table": 1}, {}),
        (JOURNAL.format("<tr><td>Sektor</td><td>Delsektor</td><td>Enhed</td></tr><tr><td>1</td><td>2</td><td>3 &amp; 4</td></tr>"), {"definitional_table": 1}, {}),
        (JOURNAL.format(f"<tr><td><table><tr><th>h</th></tr>{ROW * 3}</table></td></tr>"), {}, {"unclassified_table": 1}),
        (f"<table><tr><TD class='tblHDR'>h</TD></tr>{ROW * 2}</table><table>{ROW * 5}</table>", {}, {"suspicious_table": 1}),
        (f"<table><tr><th>h</th></tr>{ROW}</table>", {}, {}),
        (f"<table><tr><th>h</th></tr>{ROW * 2}", {}, {"suspicious_table": 1}),
        ("<dl><dt>a</dl><dl></dl><dt>outside", {}, {"definition_list": 2}),
        ("<dl><dd>a</dl><dt>outside", {}, {}),
        ("<pre><code>x</code></pre><math><msub></msub></math><figure><img alt='a'><img alt=' '></figure>", {}, {"code_block": 2, "math_formula": 2, "figure": 1, "image_with_alt": 1}),
        ("<span class='Endnote-ref'>1</span><p class='oj-note'>", {"footnotes": 2, "paragraphs": 1}, {}),
        ("<script>'<p><figure>'</script><!-- <p> --><blockquote>", {"blockquote": 1}, {}),
    ],
)
def test_counts(page, handled, unhandled):
    assert preflight.counted(page) == (handled, unhandled)


def test_pages(spark):
    pages = spark.createDataFrame([("a", "<figure><pre><p>"), ("b", None), ("b", ""), (None, "<p>")], "page_id string, html string")
    got = {(r.page_id, tuple(sorted(r.handled.items()))): [tuple(w) for w in r.warnings] for r in preflight.preflight(pages).collect()}
    assert got == {("a", (("paragraphs", 1),)): [("figure", "warning", 1), ("code_block", "info", 1)], ("b", ()): [], (None, (("paragraphs", 1),)): []}
