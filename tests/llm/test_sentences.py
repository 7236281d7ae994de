import pytest

from sylvan.llm import sentences as S

CASES = [
    (["Dr. Smith measured 3.14 mm.", "The U.S. office lists e.g. valves, seals, etc., without dates."], " "),
    (["“Is it broken?” asked Ana, and nobody replied.", "“It is.”", "Mr. Ito wrote, “Stop now!” but it kept turning."], " "),
    (["The gauge read 4.2 at 4 a.m. and 17.30 at 10 p.m.", "No. 2 vs. no. 17 was never a fair test.", "iPhones cost less.", "Wait... the bridge is out again."], " "),
    (["J. R. Miller signed v2.6.27 of the plan.", "See sec. 9.5 or docs.miller.example for it."], " "),
    (["Am 9. Mai maß Dr. Haas genau 4,2 mm.", "In Ulm fehlen Schrauben usw. seit Woche 27.", "Nach dem Umbau ist z. B. das Tor stabil, d. h. gut.", "„Ist es schwer?“, fragte Eva am Abend."], " "),
    (["« Qui a réglé la vanne ? » demanda Luc vers 10 h.", "Attention, le pont est stable !", "Voir p. ex. la fig. 24, p. 25, du rapport.", "M. Noir a mesuré 4,2 mm."], " "),
    (["La oficina de EE. UU. de Lima cita juntas.", "—¿Está estable? —preguntó Luis sin esperar respuesta.", "¿Por qué sigue así?", "El Sr. Paz midió 2 mm."], " "),
    (["Завод им. А. Б. Белова указал 3,5 мм.", "В 1969 г. инженер Носов проверил рис. 9 и табл. 8.", "«Мост исправен!» — крикнул Павел и ушёл.", "Участок, т. е. зона 3, стоит 4 млн руб. в месяц."], " "),
    (["Είναι η γέφυρα ακόμη ζεστή;", "Η μηχανή είναι φθαρμένη· ο Πέτρος συμφωνεί, π.χ. στη σελ. 12.", "Ο κ. Φίλης μέτρησε 29,5 χιλ. στη ζώνη 19."], " "),
    (["「炉は静かだ。」と彼は言った。", "『止めろ！』という声が響いた。", "えっ、熱い？！", "幅は97.73ミリで、基準（第16.12版。）を満たす。", "Dr. ボチはNo. 7の炉を選んだ。", "v40.2では熱い…と記されている。"], ""),
    (["“桥墩需要更换。”沙岩说。", "“快停下！”喊声传到了河平。", "记录写着水泵需要更换……然后中断了。", "结果很稳定；比预期更热。"], ""),
    (["ในปีพ.ศ.2021เครื่องยนต์เสียอีกแล้ว", "ดร.ลีวัดได้192.91มม.จากสะพาน"], " "),
    (["«هل الجسر ساخنة؟» سأل سامي بهدوء.", "قاس د. سامي نحو 3.5 مم في الموقع."], " "),
    (["“पुल स्थिर है।” राम ने कहा।", "डॉ. राम ने 3.5 मिमी मापा।", "क्या पुल शांत है?"], " "),
    (["ዶ/ር ማማ 3.5 ሚሜ ለካ።", "ፓምፑ ሞቃት ነው?"], " "),
    (["It is fixed.", "The next follows without a space."], ""),
]


@pytest.mark.parametrize(("want", "between"), CASES)
@pytest.mark.parametrize("noise", ["", "​"])
def test_sentences_come_back(want, between, noise):
    if noise:
        want = [s[0] + noise + s[1:] for s in want]
    text = "﻿  " + between.join(want) + " \n\n\tA heading\r\n\r\nwith a\nline break in it."
    got = [text[s:e] for s, e in S.sentences(text)]
    assert got == [*want, "A heading", "with a\nline break in it."]


def test_look_alike_letters_keep_abbreviations():
    text = "Участок, т. e. зoна 3. Мост исправен."  # Latin e and o
    assert len(S.sentences(text)) == 2


def test_nulls_and_blanks(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " \n ", "x"), (4, "One. Two", "x"), (None, "Gone.", "x"), (5, "a" * 300_000, "x")], "doc_id long, content string, pos string")
    got = sorted((r.doc_id, r.pos, r.start_idx, r.end_idx) for r in S.split(df, "doc_id", "content").collect())
    assert got == [(4, 0, 0, 4), (4, 1, 5, 8), (5, 0, 0, 300_000)]


@pytest.mark.parametrize(
    "want",
    [
        ["He said no.", "Then he left."],
        ["She told me.", "We agreed."],
        ["He likes art.", "She prefers music."],
        ["Pass me the fig.", "Then eat it."],
        ["We went to the dept.", "Nobody came."],
        ["The cap.", "It fell."],
        ["El respondió que no.", "Luego salió."],
        ["See Fig. A.3 and no. 7.", "He left."],
        ["Vgl. Abb. 3 und S. 12.", "Das ist Nr. 5.", "Der Arzt kam."],
        ["Il voit Mme. Noir, art. 5.", "Dites-le-moi."],
        ["Es ist die Kunst, engl. art.", "Sie bleibt."],
    ],
)
def test_words_that_are_abbreviations_elsewhere(want):
    text = " ".join(want)
    assert [text[s:e] for s, e in S.sentences(text)] == want


@pytest.mark.parametrize("want", [["ကျွန်တော်သွားသည်။", "သူလာသည်။"], ["ខ្ញុំទៅ។", "គាត់មក។"], ["ߒ ߦߋ߫߹", "ߊ߬ ߓߘߊ߫ ߣߊ߬߹"], ["ꦄꦏꦸ꧉", "ꦏꦺꦴꦮꦺ꧉"]])
@pytest.mark.parametrize("between", ["", " "])
def test_terminators_by_property(want, between):
    text = between.join(want)
    assert [text[s:e] for s, e in S.sentences(text)] == want


def test_an_abbreviation_right_after_a_stop_without_a_space():
    want = ["The gauge is noisy again.", "Dr. Ito measured 4 mm.", "It broke.", "No. 9 vs. no. 10 was never a fair test."]
    text = "".join([want[0], want[1], " ", want[2], want[3]])
    assert [text[s:e] for s, e in S.sentences(text)] == want
