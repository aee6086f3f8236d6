import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievewright.llm import lookalikes as la


@pytest.mark.parametrize(
    "text, plain, form",
    [
        ("Stone", True, "Stone"), ("café", True, "café"), ("Жилощ Dew", True, "Жилощ Dew"), ("“a” — b – c • d’s", True, "“a” — b – c • d’s"), ("a\tb\r\nc", True, "a\tb\r\nc"),
        ("Stоne", False, "Stone"), ("cafe\u0301", False, "café"), ("Ｋｅｅｎ １", False, "Keen 1"), ("ﬁne", False, "fine"), ("a\u00a0b", False, "a b"), ("a\u2009b", False, "a b"),
        ("a\u200bb", False, "ab"), ("\ufeffa", False, "a"), ("so\u00adft", False, "soft"), ("a‑b", False, "a-b"), ("a，b", False, "a,b"), ("", True, ""), ("ab…", True, "ab…"),
    ],
)
def test_forms(text, plain, form):
    assert (la.plain_form(text) == text) == plain and la.plain_form(text) == form and la.plain_form(form) == form


def is_plain(text):
    """The definition, character by character and word by word."""
    if unicodedata.normalize("NFC", text) != text or any(la.simple(ch) != ch for ch in text):
        return False
    if any(unicodedata.category(ch) == "Mn" and text[i - 1 : i].isalpha() and la.alphabet(text[i - 1]) in ("LATIN", "CYRILLIC", "GREEK") for i, ch in enumerate(text)):
        return False
    return not any(la.mixed(w) for w in la.words(text))


@settings(max_examples=400)
@given(st.text(alphabet=st.sampled_from("aеοxйѕMЅКᎠⲞꓐ-‑ \u00a0\u200bＡﬁé\u0301\u0302ж1ω한क\u093cא\u05b7②㎏½"), max_size=10))
def test_forms_decide_as_the_definition_does(text):
    form = la.plain_form(text)
    mixed_for_good = any(la.mixed(w) for w in la.words(form))  # letters of two alphabets that have no look-alikes
    assert (form == text and not mixed_for_good) == is_plain(text)


@pytest.mark.parametrize("text, form", [("éеόό", "éeóó"), ("xιιжж", "хііжж"), ("жжо", "жжо"), ("жжo", "жжо")])
def test_forms_of_several_alphabets_settle(text, form):
    assert la.plain_form(text) == form == la.plain_form(form)


@settings(max_examples=1000, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeoеоοόιжяωxй́̂Ꭰꓐ"), max_size=9))
def test_forms_always_settle(text):
    form = la.plain_form(text)
    assert la.plain_form(form) == form


def test_prototypes_are_single_and_files_add_to_them(tmp_path):
    assert all(len(b) == 1 and la.alphabet(a) != "" for a, b in la.LETTERS.items())
    file = tmp_path / "table.txt"
    file.write_text("\ufeff# a comment\n0531 ;\t0055 ;\tMA\t# letter\n0030 ;\t004F ;\tMA\n", encoding="utf-8")
    assert la.read_table(str(file)) == {"\u0531": "U"}


def test_groups_hold_what_looks_alike(spark):
    df = spark.createDataFrame([(1, "Iron"), (2, "lron"), (3, "Irоn"), (4, "Iran"), (5, "modern"), (6, "modem")], "n long, t string")
    groups = la.lookalike_groups(la.lookalike_forms(df, "n", ["t"])).collect()
    assert sorted((r["first_id"], r["originals"]) for r in groups) == [(1, 3), (5, 2)]


@given(st.text(alphabet=st.sampled_from("aеοxй-‑ \u00a0\u200bＡﬁé\u0301ж1"), max_size=12))
def test_forms_are_stable_and_skeletons_do_not_see_them(text):
    form = la.plain_form(text)
    assert la.plain_form(form) == form
    assert la.skeleton(la.skeleton(text)) == la.skeleton(text)


def test_table(spark):
    df = spark.createDataFrame([(1, "Stone", None, "s"), (2, "Stоne", "", "t"), (2, "Stоne", "x" * 100_000 + "é", "t"), (3, None, "ＡＢ", "u")], "card_no long, name string, oracle_text string, skeleton string")
    forms = la.lookalike_forms(df, "card_no", ["name", "oracle_text"])
    assert sorted((r["id"], r["field_name"]) for r in forms.filter("is_case").collect()) == [(2, "name"), (2, "name"), (3, "oracle_text")]
    one = spark.createDataFrame([(1, "cafe\u0301"), (2, "caf\u00e9"), (3, "\u0436\u0430b")], "n long, t string")
    assert sorted(r["id"] for r in la.lookalike_forms(one, "n", ["t"]).filter("is_case").collect()) == [1, 3]
    assert forms.filter("field_name = 'name'").select("form").distinct().count() == 1
    g = la.lookalike_groups(forms).filter("field_name = 'name'").first()
    assert (g["originals"], g["fields"], g["first_id"]) == (2, 3, 1)
    assert la.lookalike_forms(df.limit(0), "card_no", ["name"]).count() == 0


def test_marks_without_a_composed_form_are_cases(spark):
    df = spark.createDataFrame([(1, "x\u0302"), (2, "q\u0301"), (3, "Jalape\u00f1o"), (4, "\u05d0\u05b7")], "n long, t string")  # the last mark is on Hebrew
    assert sorted(r["id"] for r in la.lookalike_forms(df, "n", ["t"]).filter("is_case").collect()) == [1, 2]
