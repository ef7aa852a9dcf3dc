import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parchmill.llm import forms, lookalikes
from parchmill.llm.forms import Canonical, LookalikeTrie, canonical, plain_table
from tests.conftest import rows


def test_what_looks_the_same():
    form = canonical()
    for a, b in [("Dоmеѕtiс", "Domestic"), ("Ｍеｓｓｒｓ", "Messrs"), ("co­op", "coop"), ("a\u00a0b", "a b"), ("a\u3000b", "a\u202fb"), ("ﬁrst ﬂat oﬃce", "first flat office"), ("cafe\u0301", "caf\u00e9"), ("non‑stop", "non-stop"), ("ТО bе", "TO be"), ("Mӓrz", "März")]:
        assert form(a) == form(b), (a, b)


def test_what_looks_different():
    form = canonical()
    for a, b in [("m²", "m2"), ("resume", "résumé"), ("A", "a"), ("1", "l"), ("a  b", "a b"), ("a\nb", "a b"), ("Москва", "Mockba")]:
        assert form(a) != form(b), (a, b)


def test_cyrillic_words_stay_cyrillic():
    form = canonical()
    assert form("Оса и сор, всё в порядке: НДС") == "Оса и сор, всё в порядке: НДС"


def test_ambiguous_letters_are_spelled_by_the_trie():
    trie = LookalikeTrie(["little", "title"])
    assert trie.spell("ӏittӏe") == "little"
    assert trie.spell("ti​tle") == "title"
    assert trie.spell("tinle") is None
    assert trie.spell("tinle", budget=1) == "title"
    assert trie.spell("titlle", budget=1) == "title"


def test_trie_and_table_differ_where_a_letter_has_two_twins():
    """The table knows one twin of a letter; the trie takes the one that makes a word, and no edit that shows."""
    with_trie, table_only = canonical(), Canonical("/no/such/file")
    for shown, table, want in [("Іeave", "Ieave", "leave"), ("ӏntern", "lntern", "Intern"), ("Нeӏp", "Help", "Help"), ("finаncial", "financial", "financial")]:
        assert table_only(shown) == table and with_trie(shown) == want
    assert with_trie.apart >= 2 and table_only.by_trie == 0
    trie = LookalikeTrie(["leave", "sleeve"])
    assert trie.spell("ӏeave") == "leave" and trie.spell("leaven") is None and trie.spell("ſleave") is None
    assert trie.spell("leаven", budget=1.0) == "leave" and trie.spell("") is None


def test_every_odd_word_goes_to_the_trie_first():
    form = Canonical()
    for odd, want in [("ｆｉｎａｎｃｉａｌ", "financial"), ("fi\u200bnan\u00adcial", "financial"), ("ﬁnancial", "financial"), ("Finаnciaӏ", "Financial")]:
        assert form(odd) == want
    assert form.by_trie == 4 and form.by_table == 0
    assert form("Тhе хсрх") == "The xcpx" and form.by_table == 1  # a word of look-alikes in a line that reads Latin
    assert form("Мос\u200bква") == "Москва" and form("αβx") == "aβx"


def test_long_runs_are_linear():
    import time

    began = time.process_time()
    assert len(canonical()("a" * 300_000 + "\u200b" + "b" * 300_000)) == 600_000
    assert len(canonical()("ａ" * 200_000 + " é" * 100_000)) == 400_000
    assert time.process_time() - began < 20


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_form_is_stable_and_keeps_ascii(text):
    form = canonical()
    once = form(text)
    assert form(once) == once
    if text.isascii():
        assert once == text
    assert not any(ch in plain_table() for ch in once)


def test_pairs_and_classes(spark):
    data = [(1, "Net score", "x"), (2, "Nеt score", "y"), (3, "Net\u00a0score", "z"), (4, None, "a"), (5, "", "b"), (6, "...", "c"), (7, "．．．", "d"), (8, "other", "e"), (9, "Net score", "f")]
    df = spark.createDataFrame(data, "record_id long, core_text string, form string")
    assert rows(lookalikes.lookalike_pairs(df)) == [(1, 2), (1, 3), (2, 3), (2, 9), (3, 9)]
    assert rows(lookalikes.lookalike_classes(df)) == [(1, 1, 3), (2, 1, 3), (3, 1, 3), (9, 1, 3)]
    assert lookalikes.lookalike_pairs(df.limit(0)).count() == 0
    assert rows(lookalikes.with_form(df.filter("record_id IN (2, 4)"), "core_text").select("form_text")) == [("Net score",), (None,)]


def test_a_lost_vocabulary_is_an_error(spark, tmp_path, monkeypatch):
    """Without its words the table would give a form of its own: Іeave would look like Ieave, not like leave."""
    df = spark.createDataFrame([(1, "Іeave"), (2, "leave"), (3, "Ieave")], "record_id long, core_text string")
    assert rows(lookalikes.lookalike_pairs(df)) == [(1, 2)]
    for make in (lookalikes.lookalike_pairs, lookalikes.lookalike_classes):
        with pytest.raises(Exception, match="/no/such/file"):
            make(df.filter("record_id > 1"), path="/no/such/file").collect()  # whatever the texts hold
    with pytest.raises(Exception, match="/no/such/file"):
        lookalikes.with_form(df, "core_text", path="/no/such/file").collect()
    for make in (forms.vocabulary, canonical):
        with pytest.raises(FileNotFoundError):
            make("/no/such/file")
        for k, text in enumerate(["{", "{}", json.dumps({"model": {"vocab": {"a": 0, "leave": 1, "a1</w>": 2}}})]):
            (tmp_path / str(k)).write_text(text)
            with pytest.raises((ValueError, KeyError)):
                make(str(tmp_path / str(k)))
    (tmp_path / "words").write_text(json.dumps({"model": {"vocab": {"leave</w>": 0}}}))
    assert canonical(str(tmp_path / "words"))("Іeave") == "leave"
    monkeypatch.setattr(forms, "VOCABULARY", "/no/such/vocabulary")
    with pytest.raises(FileNotFoundError):
        Canonical("/no/such/vocabulary")("Іeave")
