import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from parchmill.llm import sentences
from parchmill.llm.sentences import units
from tests.conftest import rows


def cut(text, wrapped=False):
    return [text[a:b] for a, b in units(text, wrapped)]


@pytest.mark.parametrize("parts", [
    ["The program rated it at 27.2.", "See Note 5 and Sec. 4.25 for the U.K. business."],
    ["“Is it? Yes, it is.” said Dr. J. A. Foo of Bar Inc. today.", "We agree!"],
    ["It lost 13.11 pts. vs. the team, yet the U.S. held.", "They left at 5 p.m. on Feb. 3."],
    ["It opened at 7 a.m.", "The plan pays 10%."],
    ["Details are in Schedule C.", "Our head asked whether Dr. R. Keshan replied."],
    ["Works! Inc. filed Form X-5 (see Fig. 2. It is new).", "Messrs. A. Bee and Cee agreed."],
    ["Volumes... did they matter at all?", "Mr. M. Grith said: “Yes. No.”", "Of 99 responses, 3 count."],
    ["Was it true?!", "2,424 of 18,481 depots reported, incl. those of St. Mary, est. 2013."],
    ["Skonura acquired it from Ombrax Ltd.", "Our target is 9."],
    ["Wir haben z. B. 937 Antworten bzw. d. h. 3 Mio. Euro.", "Laut Dr. Lirax wurde sie am 5. September 2007 umgestellt."],
    ["„Die Kulanz zählt. Das bleibt so“, sagte der Vorstand der Ulcheth AG.", "Hat sie?"],
    ["« La fidélité compte. Nous le savons », a déclaré M. Lirond.", "Quelle année pour la boutique !", "Cf. art. 47 et env. 5 euros."],
    ["Véase la pág. 20 del informe núm. 46.", "¿Cambió la póliza?", "¡Qué trimestre, según el Sr. Urqosk!"],
    ["В 2015 г. уровень составил 78,7 балла, т. е. на 14 больше.", "См. п. 11.19 о том.", "Изменилась ли проверка за 2010 г.?", "Да."],
    ["«Важна ясность. Так и будет», — заявил совет.", "Опрошено ок. 50 семей."],
])
def test_sentences_of_a_line(parts):
    assert cut(" ".join(parts)) == parts


@pytest.mark.parametrize("parts", [
    ["本公司在都市圈调查了742户家庭。", "车队是否稳定？", "“态度很重要。这一点不会改变”，公司表示。", "指数上升！"],
    ["当社は4,716世帯に尋ねた。", "「在庫が大切だ。変わらない」と代表は述べた。", "NPSも補った！", "次。"],
    ["विकास हुआ।", "क्या दक्षिण में कीमत घटी?", "कंपनी लि. ने डॉ. राव से पूछी।"],
])
def test_scripts_without_spaces(parts):
    joined = ("" if "本" in parts[0] or "当" in parts[0] else " ").join(parts)
    assert cut(joined) == parts


def test_thai_spaces():
    assert cut("สาขาทำให้ดีขึ้นร้อยละ 9 โดยรวม คะแนนอยู่ที่ 27.5 คะแนนในปี 2015 เพราะดีขึ้น") == ["สาขาทำให้ดีขึ้นร้อยละ 9 โดยรวม", "คะแนนอยู่ที่ 27.5 คะแนนในปี 2015 เพราะดีขึ้น"]


def test_arabic():
    assert cut("هل تحسن؟ قال د. Grithex إن الراحة تعافى بنسبة 16%! بلغ 88.0 نقطة.") == ["هل تحسن؟", "قال د. Grithex إن الراحة تعافى بنسبة 16%!", "بلغ 88.0 نقطة."]


def test_lines_and_wrapping():
    text = "Item 42. Internal branch, 2009\n1. First entry\nA | Target 3 | Result 4\n* * *\n  We go. You\nstay."
    assert cut(text) == ["Item 42. Internal branch, 2009", "1. First entry", "A | Target 3 | Result 4", "We go.", "You", "stay."]
    assert cut("Heading\n\nWe go\nhome. You\nstay.\n \nEnd", True) == ["Heading", "We go\nhome.", "You\nstay.", "End"]


def test_invisible_and_odd_characters_keep_positions():
    text = "Re​sults of D­r. Foo rose. Ｓｅｅ Ｎｏｔｅ ５． Next."
    assert cut(text) == ["Re​sults of D­r. Foo rose.", "Ｓｅｅ Ｎｏｔｅ ５．", "Next."]
    assert cut("Gemäß Ziﬀ. 34 ist es neu. Am 5. Аpril kam er. By X Corp. Invеstor Relations, www.x.example") == ["Gemäß Ziﬀ. 34 ist es neu.", "Am 5. Аpril kam er.", "By X Corp. Invеstor Relations, www.x.example"]
    assert cut("満足度も改善した!「在庫が大切だ。」と述べた。次?5点。") == ["満足度も改善した!", "「在庫が大切だ。」と述べた。", "次?", "5点。"]
    assert cut("IT OPENS AT 7 A.M. DORMANT COSTS ROSE, ETC. MODEST GAINS IN THE U.K. BUSINESS FOLLOWED.") == ["IT OPENS AT 7 A.M.", "DORMANT COSTS ROSE, ETC.", "MODEST GAINS IN THE U.K. BUSINESS FOLLOWED."]
    assert cut("THE CLINIC OF KESHUME S.A. HAS NOT BEEN APPROVED. They know.") == ["THE CLINIC OF KESHUME S.A. HAS NOT BEEN APPROVED.", "They know."]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("aB1 .!?。“”()«»\n\t ​กา।é„‘’\"-|")), max_size=80), st.booleans())
def test_units_cover_letters_in_order(text, wrapped):
    spans = units(text, wrapped)
    last = 0
    for a, b in spans:
        assert last <= a < b and text[a:b] == text[a:b].strip() and any(map(str.isalnum, text[a:b]))
        last = b
    covered = {i for a, b in spans for i in range(a, b)}
    assert all(i in covered for i, ch in enumerate(text) if ch.isalnum())


def test_long_texts_are_linear():
    text = "We go e.g. there “and (back " * 20_000
    assert len(units(text)) >= 1
    assert len(units("One two three four. " * 20_000)) == 20_000


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 300), st.integers(0, 3), st.sampled_from([-1e6, -9.0, -4.5, -1.0, 0.5, 3.0, 9.0])), max_size=60))
def test_program_against_all_spans(parts):
    """The program over all beginnings, without the running maximum, has the same score."""
    ends, at = [], 0
    for size, gap, weight in parts:
        ends.append((at + size, at + size + gap, weight))
        at += size + gap
    size = at + 7
    starts, closes = [0, *(x[1] for x in ends)], [*((x[0], x[2]) for x in ends), (size, 0.0)]
    best = [0.0]
    for j, (end, weight) in enumerate(closes):
        best.append(max(best[i] + sentences._length(end - starts[i]) for i in range(j + 1)) + weight)
    got = sentences._best(0, ends, size)
    weights = dict(closes)
    score = sum(sentences._length(b - a) + weights[b] for a, b in got)
    assert [a for a, _ in got] == [0, *(starts[starts.index(a)] for a, _ in got[1:])] and got[-1][1] == size
    assert len({b for b, _ in closes}) < len(closes) or abs(score - best[-1]) < 1e-6 * max(1, abs(best[-1]))


def test_quotations_behind_many_open_marks():
    text = "‘a ‘b ‘c ‘d ‘e ‘f ‘g ‘h ‘i We said “It is done. We go. You stay.” They left. End of it."
    assert cut(text)[-2:] == ["They left.", "End of it."] and "It is done. We go. You stay.”" in cut(text)[0]
    names = "The list has " + " ".join(f"J. R. {chr(65 + k % 26)}. Foo" for k in range(60)) + " as members. Next one follows."
    assert cut(names)[-1] == "Next one follows." and len(cut(names)) == 2
    quoted = "He said: “" + "It is so. " * 2_000 + "” and left. Then we went."
    assert cut(quoted)[-1] == "Then we went." and len(cut(quoted)) == 2


def test_table(spark):
    df = spark.createDataFrame([(1, "A is. B is.", True), (2, None, False), (3, "", None), (4, "--- \n", False)], "record_id long, core_text string, w boolean")
    got = sentences.sentence_units(df, wrapped=df["w"])
    assert rows(got) == [(1, 0, 5), (1, 6, 11)]
    assert rows(sentences.unit_texts(df, "record_id", "core_text", got).select("unit")) == [("A is.",), ("B is.",)]
    assert sentences.sentence_units(df.limit(0)).count() == 0
