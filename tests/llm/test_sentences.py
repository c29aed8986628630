import pytest
from foliospark.llm import sentences
from foliospark.llm.sentences import lattice_words, split_sentences


def units(text):
    return [text[a:b] for a, b in split_sentences(text)]


CASES = {
    "Dr. A. B. Fox saw Fig. 3.2 (cf. p. 9) at 5 p.m. The end.": ["Dr. A. B. Fox saw Fig. 3.2 (cf. p. 9) at 5 p.m.", "The end."],
    'She asked, "Is it so? I doubt it." and left. Next.': ['She asked, "Is it so? I doubt it." and left.', "Next."],
    'He wrote: "It is." Both agreed (e.g. here) at 3.5 m. pH values fell.': ['He wrote: "It is."', "Both agreed (e.g. here) at 3.5 m.", "pH values fell."],
    "(All was seen.) Well ... it was!": ["(All was seen.)", "Well ... it was!"],
    "Am 12. Mai 1999 kam z. B. Nr. 4 an. Vgl. Abb. 2 und S. 4.": ["Am 12. Mai 1999 kam z. B. Nr. 4 an.", "Vgl. Abb. 2 und S. 4."],
    "M. Roux demanda : « Est-ce prêt ? » puis partit. Voir fig. 2 et p. 3.": ["M. Roux demanda : « Est-ce prêt ? » puis partit.", "Voir fig. 2 et p. 3."],
    "¿Es así? La Dra. Paz dijo: «Sí.» ¡Bien!": ["¿Es así?", "La Dra. Paz dijo: «Sí.»", "¡Bien!"],
    "डॉ. राम 5 कि.मी. दूर है| यह ठीक है. उसने पूछा, \"क्या?\" और गया।": ["डॉ. राम 5 कि.मी. दूर है|", "यह ठीक है.", "उसने पूछा, \"क्या?\" और गया।"],
    "老师问：「好了吗？」然后等待。他写道：「对。」真好！": ["老师问：「好了吗？」然后等待。", "他写道：「对。」", "真好！"],
    "ในปี 1918 น้ำแข็งละลาย เมื่อน้ำถึง 39.11 กรัม จะเดือด ดร. ซุนเขียนแล้ว": ["ในปี 1918 น้ำแข็งละลาย", "เมื่อน้ำถึง 39.11 กรัม จะเดือด", "ดร. ซุนเขียนแล้ว"],
    "One.\n- item one\n2) item two. Still it\nTwo wrapped\nlines here.": ["One.", "- item one", "2) item two. Still it", "Two wrapped\nlines here."],
    "Ends so.Next one. See v3.5 of Node.Js now.": ["Ends so.", "Next one.", "See v3.5 of Node.Js now."],
}


@pytest.mark.parametrize("text", CASES)
def test_boundaries(text):
    assert units(text) == CASES[text]


@pytest.mark.parametrize("text", ["", " \n\t ", "\n\n", "​"])
def test_nothing(text):
    assert [u for u in units(text) if u.strip("​ ")] == []


def test_long_text_and_spans():
    text = "A short sentence. " * 20_000
    spans = split_sentences(text)
    assert len(spans) == 20_000 and all(text[a:b] == "A short sentence." for a, b in spans)
    assert split_sentences("x" * 100_000) == [(0, 100_000)]


def test_lattice_prefers_words():
    assert lattice_words("然后等待", frozenset({"然后", "后等", "等待"})) == ["然后", "等待"]


def test_table(spark):
    rows = [(1, "Crumb \nOne. Two.", "Crumb ", "text", False, "x"), (1, "Crumb \nOne. Two.", "Crumb ", "text", False, "y"), (2, None, "", "text", False, ""), (3, "Scan.", "", "text", True, ""), (4, "Table.", "", "table", False, ""), (5, "", "", "text", None, "")]
    df = spark.createDataFrame(rows, "chunk_id long, page_content string, source string, type string, ocr boolean, sent_start string")
    assert sorted(map(tuple, sentences.sentence_units(df).collect())) == [(1, 7, 11), (1, 12, 16)]
    assert sentences.sentence_units(df.limit(0)).count() == 0
