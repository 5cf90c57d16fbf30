"""Golden forms, and what must hold in every cell."""

import pytest

from lexispark.functions import morphology as M
from lexispark.plans.lexicon import derived, examples

GOLDEN = (
    ("punoj", "indicative.perfect.1sg.active", "kam punuar"), ("punoj", "imperative.present.2sg.active", "puno"), ("punoj", "imperative.present.2pl.active", "punoni"), ("punoj", "indicative.pluperfect.1sg.active", "kisha punuar"),
    ("punoj", "admirative.perfect.1sg.active", "paskam punuar"), ("punoj", "conditional.perfect.1sg.active", "do të kisha punuar"), ("punoj", "indicative.present.1sg.active", "punoj"), ("hap", "subjunctive.imperfect.1sg.active", "të hapja"),
    ("pi", "indicative.present.1pl.active", "pimë"), ("jam", "indicative.aorist.1sg.active", "qeshë"), ("jap", "indicative.aorist.1sg.active", "dhashë"), ("laj", "indicative.aorist.1sg.middle-passive", "u lava"), ("laj", "indicative.perfect.1sg.middle-passive", "jam larë"),
)
SAID = (
    ("punoj", "indicative.present.1sg.active", "negative", "declarative", "nuk punoj"), ("punoj", "imperative.present.2sg.active", "negative", "declarative", "mos puno"),
    ("punoj", "subjunctive.present.1sg.active", "negative", "declarative", "të mos punoj"), ("punoj", "indicative.present.2sg.active", "affirmative", "interrogative", "a punon"),
)


@pytest.fixture(scope="module")
def table(spark):
    rows = M.conjugate(examples(spark), ("affirmative", "negative"), ("declarative", "interrogative")).collect()
    return {(r["verb_id"], f"{r['mood']}.{r['tense']}.{r['cell']}.{r['voice']}", r["polarity"], r["modality"]): r for r in rows}


def test_golden(table):
    for verb, cell, form in GOLDEN:
        assert table[verb, cell, "affirmative", "declarative"]["form"] == form
    for verb, cell, polarity, modality, form in SAID:
        assert table[verb, cell, polarity, modality]["form"] == form
    assert table["punoj", "non-finite.gerund.None.None", None, None]["form"] == "duke punuar"


def test_grid(table):
    assert len(M.grid_rows()) == 273
    assert all((r["form"] is None) == (r["reason"] is not None) for r in table.values())
    assert all(r["form"] == " ".join(r["form"].split()) for r in table.values() if r["form"])
    compound = [r for r in table.values() if r["voice"] == "middle-passive" and r["tense"] == "perfect" and r["form"]]
    assert compound and all(any(f" {f} " in f" {r['form']} " for (aux, _), forms in M.AUXILIARIES.items() if aux == "jam" for f in forms.split()) for r in compound)
    assert {r["cell"] for r in table.values() if r["verb_id"] == "ngjet" and r["form"] and r["mood"] != "non-finite"} == {"3sg", "3pl"}


#: Entries with other stems before some endings, and the cells that say so (fixed values of the language).
_MP = lambda stem: {f"indicative.present.middle-passive/{c}": f"{stem}{e}" for c, e in zip(M.CELLS, "em esh et emi eni en".split())}
_IPF = lambda stem: {f"indicative.imperfect/{c}": f"{stem}{e}" for c, e in zip(M.CELLS, "ja je te nim nit nin".split())}
CHANGING = (
    ("djeg", 2, "djeg", "dogj", "djegur", False, {"indicative.present/2pl": "digjni", "subjunctive.present/2pl": "të digjni", "imperative.present/2sg": "digj", "imperative.present/2pl": "digjni", **_MP("digj"), **_IPF("digj")}),
    ("pjek", 2, "pjek", "poq", "pjekur", False, {"indicative.present/2pl": "piqni", "subjunctive.present/2pl": "të piqni", "imperative.present/2sg": "piq", "imperative.present/2pl": "piqni", **_MP("piq"), **_IPF("piq")}),
    ("flas", 2, "flas", "fol", "folur", False, {"indicative.present/2sg": "flet", "indicative.present/3sg": "flet", "indicative.present/2pl": "flisni", "imperative.present/2sg": "fol", "imperative.present/2pl": "flisni", **_MP("flit"), **_IPF("flis")}),
    ("shoh", 2, "shoh", "pa", "parë", True, {"imperative.present.middle-passive/2sg": "shihu", "imperative.present.middle-passive/2pl": "shihuni", **_MP("shih")}),
    ("them", 2, "them", "thash", "thënë", True, _MP("thuh")),
)
CHANGED = (
    ("pjek", "indicative.aorist.{}.active", "poqa poqe poqi poqëm poqët poqën"), ("djeg", "indicative.aorist.{}.active", "dogja dogje dogji dogjëm dogjët dogjën"), ("djeg", "indicative.imperfect.{}.active", "digjja digjje digjte digjnim digjnit digjnin"),
    ("djeg", "indicative.present.{}.middle-passive", "digjem digjesh digjet digjemi digjeni digjen"), ("djeg", "indicative.present.{}.active", "djeg djeg djeg djegim digjni djegin"), ("flas", "indicative.present.{}.active", "flas flet flet flasim flisni flasin"),
    ("flas", "admirative.imperfect.{}.active", "folkësha folkëshe folkësh folkëshim folkëshit folkëshin"), ("flas", "admirative.present.{}.middle-passive", "u folkam|u folke|u folka|u folkemi|u folkeni|u folkan"), ("pjek", "admirative.imperfect.{}.active", "pjekkësha pjekkëshe pjekkësh pjekkëshim pjekkëshit pjekkëshin"),
    ("shoh", "indicative.perfect.{}.active", "kam parë|ke parë|ka parë|kemi parë|keni parë|kanë parë"), ("shoh", "indicative.present.{}.middle-passive", "shihem shihesh shihet shihemi shiheni shihen"), ("them", "indicative.present.{}.middle-passive", "thuhem thuhesh thuhet thuhemi thuheni thuhen"),
)


def test_verbs_that_change_their_stems(spark):
    rows = [(i, i, f"to {i}", k, "kam", present, aorist, participle, suppletive, False, False, False, cells) for i, k, present, aorist, participle, suppletive, cells in CHANGING]
    found = {(r["verb_id"], f"{r['mood']}.{r['tense']}.{r['cell']}.{r['voice']}"): r["form"] for r in M.conjugate(spark.createDataFrame(rows, M.LEXICON)).collect()}
    for verb, cells, forms in CHANGED:
        for cell, form in zip(M.CELLS, forms.split("|") if "|" in forms else forms.split()):
            assert found[verb, cells.format(cell)] == form
    assert found["djeg", "subjunctive.present.2pl.active"] == "të digjni" and found["shoh", "imperative.present.2sg.middle-passive"] == "shihu"


def test_derived_lexicon(spark):
    """Frequent words become entries that the validating rules accept, each once."""
    docs = spark.createDataFrame([(1, "abcd " * 40 + "punoj " * 50 + "ABCD " * 60 + "abc " * 90), (2, "wxyz vwxj " * 45), (3, None)], "doc_id int, text string")
    found = {r["verb_id"]: r for r in derived(docs, 40).collect()}
    assert set(found) == {"abcd", "wxyz"} and all(r["class"] in (1, 2, 3) and r["participle"].startswith(r["present"]) for r in found.values())
    assert derived(docs, 46).count() == 0
