import re

import pytest

from symgraph.llm import residue
from symgraph.llm import residue_exemplars as X
from symgraph.llm.residue import Exemplars, find_residue, part_terms, terms, windows


DF = {"the": 900, "of": 900, "a": 900, "is": 900, "to": 900, "such": 400, "figure": 500, "screen": 100, "by": 800, "value": 300, "when": 500, "statio": 200, "displa": 300, "shows": 400, "on": 800, "in": 800}


@pytest.fixture(scope="module")
def index():
    return Exemplars(DF, 1000)


RESIDUE = {
    "template": ["Applicant: {{ applicant.name }}", "The invention relates to [INSERT TITLE HERE].", "<TITLE_OF_INVENTION>", "According to |ABSTRACT|, it moves.", "(please insert date)", "«titre»", "XX.XX.XXXX", "【出願人を記入】", "Title: {$so1icitante}", "[Name of applicant]", "${filingDate}", "<?= $title ?>", "[Anmelder eintragen]", "(à compléter)", "$docket_number$"],
    "error": ["404 Not Found", "ERROR 503 (SERVICE UNAVAILABLE)", '{"error":{"code":502,"message":"Bad Gateway"}}', "<p>Page introuvable.</p>", "* Access  denied.", "ページが見つかりません", "[0003] Seite nicht gefunden.", "The file could not be opened.", "服务器繁忙，请稍后重试", "Se ha producido un error inesperado."],
    "script": ["PLEASE ENABLE JAVASCRIPT TO VIEW THIS PAGE.", "请启用JavaScript", "Yóur browser does not support scripts.", "Bitte aktivieren Sie JavaScript, um fortzufahren."],
    "filler": ["Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Sidera mela lorem vanto ipsum nonum.", "xxxxx xxxxx xxxxx xxxxx", "Dies ist ein Blindtext.", "ダミーテキスト", "Description to be added later.", "Text text text."],
}

CLEAN = [
    "", "   ", "The rendering unit 22 replaces a placeholder such as {{TITLE}} by a value of the table.", "A tag [[name]] of the template is a variable.", "Die Vorlage hat einen Platzhalter <%= demandeur %>.",
    'When the server answers with "Error 429. Access denied.", the unit 14 marks the address as stale and tries the next one.', 'Figure 4 shows a screen on which the notice "Please enable JavaScript to continue." appears as soon as scripts are blocked.',
    "Until the content arrives, the preview pane 7 displays grey text, for instance lorem ipsum, on the screen.", "x_{{n}+1} = x_{n} - f / f'", "F = \\frac{{k}_{1}}{2 \\pi r", "[chemical formula 2 omitted]", "[0002] The rotor 4 is closed.", "|x| < |y|", "Detailed description", "<|endoftext|>",
    "The error of the sensor is below 3 percent.", "[Figure 2]", "(claim 1)", "(title)", "【要約】", "The requested torque could not be reached by the second motor of the hoist.",
]


def kinds(index, text):
    return {k for w in windows(text) if (k := index.kind(w))}


@pytest.mark.parametrize("kind", RESIDUE)
def test_residue(index, kind):
    for text in RESIDUE[kind]:
        assert kinds(index, text) == {kind}, text


def test_clean(index):
    for text in CLEAN:
        assert not kinds(index, text), text


def test_residue_inside_a_patent(index):
    body = "Rotor with membrane\nABSTRACT\nThe rotor 4 is coupled to the membrane 5.\n"
    assert not kinds(index, body)
    assert kinds(index, body + "The width is 5 mm. [[invention_title]]\n" + body) == {"template"}
    assert kinds(index, body + "CLAIMS\nThe requested document could not be loaded.") == {"error"}


def test_trigger_passes_over_no_template_part(index, monkeypatch):
    texts = ["[5ummary]", "[-Title-]", "[2 Absätze ergänzen]", "(3 mots à remplir)", "【2 記入】", "Xx.xX.XXXX", "** title missing **", "__inventor__", "%name%", "see [12] and (7)", *[t for ts in RESIDUE.values() for t in ts], *CLEAN]
    got = [(kinds(index, t), list(index.residue(t))) for t in texts]
    monkeypatch.setattr(residue, "_TRIGGER", re.compile(""))
    assert [(kinds(index, t), list(index.residue(t))) for t in texts] == got and sum(("template" in k) for k, _ in got[:9]) >= 6


def test_windows_keep_quotations_whole():
    assert [w.strip() for w in windows('It reads "Wait. Reload." twice. Then 3.5 mm.\n\n後で。次')] == ['It reads "Wait. Reload." twice.', "Then 3.5 mm.", "後で。", "次"]
    assert terms("Élan 12 a1b 日本語 x") == ["elan", "alb", "日本", "本語", "x"]
    assert part_terms("docketNumber_2") == ["docket", "number"] and part_terms("figure 2") == ["figure", "#"]
    assert list(X.expand("a (b|(c|d) e|)f")) == ["a bf", "a c ef", "a d ef", "a f"]


def test_retrieval_misses_no_exemplar(index):
    """The index over the heaviest terms finds what a comparison with every exemplar finds."""
    texts = [t for ts in RESIDUE.values() for t in ts] + CLEAN + ["not found page requested the", "try again in a few minutes please sir"]
    got = [index.kind(t) for t in texts]
    full = Exemplars(DF, 1000)
    everything = list(range(len(full.terms)))
    full.index = dict.fromkeys(full.known, everything)
    full.first = full.known
    assert [full.kind(t) for t in texts] == got


def test_families_can_be_held_out():
    """An error message is still found by its likes when the family it belongs to is left out; without any family nothing is."""
    text = "The requested resource could not be retrieved."
    own = next(f for f in residue.families() if f[1].startswith("The (requested |)") and "retrieved" in f[1])
    assert Exemplars(DF, 1000, lambda f: f != own).kind(text) == "error"
    assert Exemplars(DF, 1000, lambda f: False).kind(text) is None


def test_frequencies(spark):
    rows = [("Élan of the rotor",), ("The rotor, the ROTORS and 日本語",), (None,), ("",)]
    df, n = residue.document_frequencies(spark.createDataFrame(rows, "text string"))
    assert n == 4 and (df["rotor"], df["rotors"], df["the"], df["elan"], df["日本"], df["本語"]) == (2, 1, 2, 1, 1, 1)


def test_documents(spark):
    rows = [(1, "404 Not Found"), (1, "404 Not Found"), (2, None), (3, ""), (4, " \n "), (5, "good text. " * 50_000 + "\nThis site needs JavaScript."), (None, "[[abstract]]"), (6, "A rotor.")]
    got = find_residue(spark.createDataFrame([(*r, "k", None) for r in rows], "doc_id long, text string, kind string, windows string")).collect()
    assert sorted((r.doc_id or 0, r.kind) for r in got) == [(0, "template"), (1, "error"), (1, "error"), (5, "script")]
    assert find_residue(spark.createDataFrame([], "doc_id long, text string")).collect() == []
