"""Sentence boundaries: one line of each kind for each script, positions, awkward rows."""

import pytest

from quaverlake.llm.sentences import sentences, split_sentences

CASES = [
    ["Dr. Bell wrote to Mr. and Mrs. Dorn.", "It cost 3.50 crowns, i.e. too much."],
    ["The stamp \"Not for sale.\" is on one rim.", "\"Stop there. Take it again,\" said Ann Bell.", "Ann asked, \"Who cut it?\"", "No one spoke."],
    ["Nos. 7 and 8 are lost (see vol. ii, p. 9).", "It was sold to Bell & Sons Ltd.", "The tempo slackens ... then returns."],
    ["It starts at 7 a.m. on a Sunday.", "The take lasts 3 min. 24 sec. in all.", "Who owns it now?!", "iReel users skip it."],
    ["Die Kopie kam am 7. Mai 1982 zurück.", "Bd. 3 fehlt auf S. 42.", "R. Bell steht bei Dorn & Co. unter Nr. 9.", "„Noch einmal. Ab Takt 51“, rief Ann Bell vom Pult.", "Es gilt u. a. hier usw.", "Ende."],
    ["M. Bell revint le 3 mai, etc.", "« Reprenez. Mesure 73 », dit Ann.", "Il passa pour « introuvable ! » pendant 7 ans.", "Quelle fin !"],
    ["¿Quién cortó la cinta?", "«Otra vez. Desde el compás 37», dijo B. Bell.", "La copia n.º 5 figura en la pág. 22.", "¡Qué final!"],
    ["Темп равен 4,5 удара, т. е. медленнее.", "«Ещё раз. С такта 5», — сказал Н. Белл.", "Запись длится ок. 6 мин. на стороне А.", "В каталоге нет нот и т. д.", "Том 4 найден в 1936 г.", "Конец."],
    ["Ποιος έκοψε την ταινία;", "«Ξανά. Από το μέτρο 8», είπε ο κ. Μορβεν.", "Έμεινε εκεί, κ.λπ.", "Τι ωραίο τέλος!"],
    ["أرشيف د. مورفين بيع عام 1983.", "أين النسخة الثانية؟", "قال: «مرة أخرى. من هنا» ثم صمت."],
    ["यह टेप 1929 में मिला।", "\"फिर से। माप 70 से,\" संचालक ने कहा।", "डॉ. तारविक का रिकॉर्ड पृ. 77 पर है।"],
]
JOINED = [
    ["录音长46.7秒。", "盒子上写着“未经剪辑！”几个字。", "“再来一次。从第30小节开始。”基尔纳说。", "是谁剪断了磁带？"],
    ["この盤はOp. 63 No. 9と表示されている。", "「もう一度。51小節から」とリンスカが言った。", "箱には「未編集。」と書かれている。"],
]
THAI = ["ความยาวทั้งหมดคือ 76.8 วินาที", "หนังสือเล่มที่ 3 หายไปหลังสงคราม", "สำเนาจากท่าเรือขายไปในปี 1993", "เพลงนี้บันทึกเสียงในปี 1952 ที่หอประชุมริมท่าเรือ"]


def texts(t):
    return [t[a:b] for a, b in sentences(t)]


@pytest.mark.parametrize("case", [*range(len(CASES))])
def test_spaced(case):
    for sep in (" ", "  ", "\n"):
        assert texts(sep.join(CASES[case])) == CASES[case]


@pytest.mark.parametrize("case", [0, 1])
def test_unspaced(case):
    assert texts("".join(JOINED[case])) == JOINED[case]


def test_thai():
    assert texts(" ".join(THAI)) == THAI


def test_empty_lines_headings_and_blanks():
    t = "\n\n  Programme \n \nOne two. Three\nfour.\r\n\r\nEnd "
    assert texts(t) == ["Programme", "One two.", "Three\nfour.", "End"]
    assert sentences("") == [] and sentences(" \n\n ") == []


def test_code_points():
    t = "𝄞 sounds. Ends."
    assert sentences(t) == [(0, 9), (10, 15)]


def test_unclosed_quotes_do_not_swallow():
    assert texts('He said "go. Then left. She stayed.') == ['He said "go.', "Then left.", "She stayed."]


def test_operator(spark):
    df = spark.createDataFrame([(1, "Ab cd. Ef gh.", 9), (2, None, 9), (3, "", 9), (4, "x " * 50000 + ". End.", 9)], "doc_id bigint, text string, start_pos int")
    got = sorted(map(tuple, split_sentences(df, "doc_id", "text").collect()))
    assert got == [(1, 0, 6), (1, 7, 13), (4, 0, 100001), (4, 100002, 100006)]
    assert split_sentences(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("ខ្ញុំទៅផ្សារ។ គាត់នៅផ្ទះ។", ["ខ្ញុំទៅផ្សារ។", "គាត់នៅផ្ទះ។"]),
        ("မင်္ဂလာပါ။ နေကောင်းလား။", ["မင်္ဂလာပါ။", "နေကောင်းလား။"]),
        ("Բարեւ։ Ինչպես ես։", ["Բարեւ։", "Ինչպես ես։"]),
        ("ꦱꦸꦒꦼꦁ꧉ꦲꦺꦴꦫ꧉", ["ꦱꦸꦒꦼꦁ꧉", "ꦲꦺꦴꦫ꧉"]),
        ("A" * 100 + "nr. 5 here. B", ["A" * 100 + "nr.", "5 here.", "B"]),
    ],
)
def test_terminators_of_all_scripts(text, parts):
    assert [text[a:b] for a, b in sentences(text)] == parts


def test_long_texts_take_time_in_proportion():
    import time

    began = time.time()
    for text in ("(" * 100_000 + " a. B", "x. " * 50_000, "„x “" * 50_000):
        sentences(text)
    assert time.time() - began < 20
    assert [b - a for a, b in sentences("(" * 100_000 + " a. B")] == [100_005]
