"""Sentence boundaries in many scripts, and their edges."""

import pytest

from quirefold.llm.sentences import _words, language_of, sentence_ends, split_sentences


def cut(text):
    out, at = [], 0
    for end in sentence_ends(text):
        out.append(text[at:end].strip())
        at = end
    return out


CASES = [
    ["Dr. Roe left at 5 p.m. The train had gone.", "Dr. Roe left at 5 p.m.", "The train had gone."],
    ["At 5 p.m. Dr. Roe locks the map away. It weighs approx. 3.5 kg.", "At 5 p.m. Dr. Roe locks the map away.", "It weighs approx. 3.5 kg."],
    ["“Stop!” the man shouted. She whispered, “We leave at dawn.” Prof. L. R. Poe agrees.", "“Stop!” the man shouted.", "She whispered, “We leave at dawn.”", "Prof. L. R. Poe agrees."],
    ['"I saw it. I held it," he said. Why?', '"I saw it. I held it," he said.', "Why?"],
    ["It was (twice!) a mistake. (The cut is missing.) They sell pens, etc. in a box.", "It was (twice!) a mistake.", "(The cut is missing.)", "They sell pens, etc. in a box."],
    ["Who knew... See No. 5 of vol. 3. She waited... and left.", "Who knew...", "See No. 5 of vol. 3.", "She waited... and left."],
    ["It ends in .cbz at https://a.example/vol.2?p=1&q=a.b for now. J.R. and M.Poe split it 1/2.", "It ends in .cbz at https://a.example/vol.2?p=1&q=a.b for now.", "J.R. and M.Poe split it 1/2."],
    ["What a panel!The map is new, isn’t it?", "What a panel!", "The map is new, isn’t it?"],
    ["Am 13. März kam er, z. B. nachts. „Halt!“, ruft er. Er sagt: „Es ist vorbei.“ Bd. 3 kostet 5 €, usw. Ende.", "Am 13. März kam er, z. B. nachts.", "„Halt!“, ruft er.", "Er sagt: „Es ist vorbei.“", "Bd. 3 kostet 5 €, usw.", "Ende."],
    ["« Attends ! » crie-t-elle. M. Roe a dessiné les p. 3 à 5, etc. Quel relieur !", "« Attends ! » crie-t-elle.", "M. Roe a dessiné les p. 3 à 5, etc.", "Quel relieur !"],
    ["El n.º 51 cuesta 5 euros, aprox. —No vuelvas —dijo él. ¿Dónde está?", "El n.º 51 cuesta 5 euros, aprox.", "—No vuelvas —dijo él.", "¿Dónde está?"],
    ["И т. д. и т. п. — так везде. Д-р Roe пришёл в 9 ч. утра, т. е. поздно. «Стой!» — крикнул он.", "И т. д. и т. п. — так везде.", "Д-р Roe пришёл в 9 ч. утра, т. е. поздно.", "«Стой!» — крикнул он."],
    ["Πού είναι το βιβλίο; Ο κ. Roe περιμένει· ήρθε, π.χ. χθες.", "Πού είναι το βιβλίο;", "Ο κ. Roe περιμένει· ήρθε, π.χ. χθες."],
    ["“रुको!” वह चिल्लाया। डॉ. Roe ने पढ़ा॥ क्या?", "“रुको!” वह चिल्लाया।", "डॉ. Roe ने पढ़ा॥", "क्या?"],
    ["قال: «انتظر!» ثم مضى. كتب د. Roe عن 3.5 من 5. أين؟", "قال: «انتظر!» ثم مضى.", "كتب د. Roe عن 3.5 من 5.", "أين؟"],
    ["Տղան ասաց. «Սպասիր»։ Ո՞ւր է։", "Տղան ասաց. «Սպասիր»։", "Ո՞ւր է։"],
    ["ልጁ ሄደ። የት ነው፧", "ልጁ ሄደ።", "የት ነው፧"],
    ["「待って。まだだ。」と言った。「鍵をくれ！」評価は1.5点だ。（欠けている。）見ていた……そして笑った。", "「待って。まだだ。」と言った。", "「鍵をくれ！」", "評価は1.5点だ。", "（欠けている。）", "見ていた……そして笑った。"],
    ["“你看见了吗？”船长问道。他说：“别走。我还有话说。”灯在哪里？", "“你看见了吗？”船长问道。", "他说：“别走。我还有话说。”", "灯在哪里？"],
    ["그는 “가지 마.”라고 말했다. “어디 있어?” 소녀가 물었다. 평점은 1.4점이다.", "그는 “가지 마.”라고 말했다.", "“어디 있어?” 소녀가 물었다.", "평점은 1.4점이다."],
    ["เล่มที่ 22 มี 145 หน้า คนเฝ้าถือไว้แน่น Roe วาดภาพได้สวย ฉันให้คะแนน 3.5 เต็ม 5 เด็กไม่พูด", "เล่มที่ 22 มี 145 หน้า", "คนเฝ้าถือไว้แน่น", "Roe วาดภาพได้สวย", "ฉันให้คะแนน 3.5 เต็ม 5", "เด็กไม่พูด"],
    ["THE TRAIN LEFT AT 7 P.M. THE MAN (WHO? NOBODY!) LAUGHED. “STOP!” THE MAN SHOUTED. MR. AND MRS. ROE SELL PENS, ETC. WHO KNEW... DR. POE.", "THE TRAIN LEFT AT 7 P.M.", "THE MAN (WHO? NOBODY!) LAUGHED.", "“STOP!” THE MAN SHOUTED.", "MR. AND MRS. ROE SELL PENS, ETC.", "WHO KNEW...", "DR. POE."],
    ["the train left at 7 p.m. mr. roe laughs. see no. 5, i.e. the last. why?", "the train left at 7 p.m.", "mr. roe laughs.", "see no. 5, i.e. the last.", "why?"],
    ["Release 1.2\n1. renamed chapter 4 (was 2.5)\n- added vol. 3.", "Release 1.2", "1. renamed chapter 4 (was 2.5)", "- added vol. 3."],
    ["Q: (Gone.) Yes.\nROE: See fig. 4. Now.", "Q: (Gone.)", "Yes.", "ROE: See fig. 4.", "Now."],
]


@pytest.mark.parametrize("case", CASES, ids=[c[0][:20] for c in CASES])
def test_cases(case):
    assert cut(case[0]) == case[1:]


# Texts that no rule was written for.
HELD_OUT = [
    ["Gen. Smith arrived with Sgt. Pepper and Lt. Col. Moss.", "See Sec. 4 for Rev. Jones.", "He lives in the U.S. She lives in the U.K. too.|"],
    ["He moved to the U.S. ", "She stayed in the U.K. ", "They met at 5 a.m. by the gate."],
    ["Prof. em. A. B. Meier kam am 3. Oktober mit ca. 20 Leuten.", "Vgl. Abb. 4 und Kap. 7.", "Er blieb, evtl. bis morgen."],
    ["Mme. Roux et M. Petit habitent au no. 12 de la rue.", "Ils vendent des livres, des cartes, etc. et du thé.", "C’est tout ?", "Oui."],
    ["El Dr. Ruiz y la Sra. Gómez viven en la pág. 3 del libro.", "¿Quién es?", "¡Nadie!", "Dijo que no."],
    ["Il sig. Rossi e il dott. Bianchi leggono a pag. 4 del libro.", "Che cosa vuoi?", "Niente, disse."],
    ["A sra. Lima mora no n. 7 da rua e não quer sair.", "O que é isso?", "Não sei."],
    ["Pan inż. Nowak mieszka na ul. Długiej, tzn. w domu nr. 5 i nie wychodzi.", "To jest wszystko."],
    ["Г-н Петров живёт на ул. Ленина и работает с проф. Ивановым.", "См. рис. 4 и табл. 2.", "Что это?"],
    ["Ο κ. Παππάς και η κα. Λάμπρου είναι στο σπίτι, βλ. σελ. 4.", "Τι είναι;", "Δεν ξέρω."],
    ["ד״ר כהן גר כאן.", "האם זה נכון?", "כן!", "הספר בעמ׳ 12 מצוין."],
    ["আমি বাড়ি যাই।", "তুমি কোথায়?", "ডা. সেন এখানে আছেন।"],
    ["မင်္ဂလာပါ။", "နေကောင်းလား။"],
    ["ខ្ញុំទៅផ្ទះ។", "អ្នកនៅឯណា?"],
    ["བཀྲ་ཤིས།", "བདེ་ལེགས།"],
    ["میں گھر جاتا ہوں۔", "تم کہاں ہو؟"],
    ["彼は「行く。」と言った。", "天気は良い！", "さようなら。"],
    ["他说：“走吧。”", "我们走了。", "你好吗？", "很好！"],
    ["“어디 가니?” 어머니가 조용히 물었다.", "나는 3.5점을 주었다."],
]


@pytest.mark.parametrize("case", HELD_OUT, ids=[c[0][:20] for c in HELD_OUT])
def test_held_out(case):
    case = [c.strip() for c in case if not c.endswith("|")]
    text = " ".join(case) if not any("。" in c for c in case) else "".join(case)
    assert cut(text) == case


def test_words_of_languages_are_data():
    assert language_of("The man and the dog went to the park with his hat", "Cased") == "en" and language_of("Der Mann und die Frau sind nicht mit dem Hund", "Cased") == "de"
    assert language_of("Vega 7", "Cased") == "" and language_of("ไม่", "Thai") == "th"
    words = _words("Cased", "de")
    assert words["months"].split("|")[0] == "september" and r"z\. ?b" in words["inside"].split("|") and _words("Cased", "")["title"].count("|") > 40
    assert _words("Cased", "ru")["inside"].split("|").count(r"т\. ?е") == 1 and r"ee\. ?uu" in _words("Cased", "es")["inside"].split("|")


def test_lines_of_pages():
    text = "The salt trader\nrebuilds Mr.\nRoe's wall. « Fini.\n» Why?\n\nNext\npage"
    assert cut(text) == ["The salt trader\nrebuilds Mr.\nRoe's wall.", "« Fini.\n»", "Why?", "Next\npage"]
    assert cut("Plot\nIt ends.") == ["Plot", "It ends."]
    assert cut("The wall rebuilt by the\nman before dawn. Yes.") == ["The wall rebuilt by the\nman before dawn.", "Yes."]


def test_edges():
    assert sentence_ends(None) == [] and sentence_ends("") == [] and sentence_ends(" \n \t") == []
    assert sentence_ends("  Hi.  \r\n") == [5] and sentence_ends("...") == [3] and sentence_ends("“Hi. No") == [4, 7]
    for long in ("a.b" * 30000, "Ünïcödé! " * 20000, "(" * 20000 + "a. B" + ")" * 20000, "。" * 30000):
        ends = sentence_ends(long)
        assert ends == sorted(set(ends)) and ends[-1] == len(long.rstrip())


def test_table(spark):
    rows = [(1, "Hi. You.", "review", 3, "x"), (2, None, None, 1, None), (3, "  ", "ocr", 1, ""), (None, "A b.", None, 0, ""), (4, "🦊 Hi. Yes", "wiki", 0, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, end_pos int, ends string")
    got = [(r.doc_id, r.sentence, r.start_pos, r.end_pos, r.sentence_text) for r in split_sentences(df).orderBy("doc_id", "sentence").collect()]
    assert got == [(None, 1, 1, 4, "A b."), (1, 1, 1, 3, "Hi."), (1, 2, 5, 8, "You."), (4, 1, 1, 5, "🦊 Hi."), (4, 2, 7, 9, "Yes")]
    assert split_sentences(df.limit(0)).collect() == []


@pytest.mark.parametrize("n", [10, 100, 5000])
def test_long_addresses_stay_whole(n):
    path = "a/" * n
    for address in (f"https://a.example/{path}x?Query=1.Next", f"www.a.example/{path}x?Query", f"{'a' * n}@{'b.' * n}Example"):
        assert cut(f"See {address} for now. It is long.") == [f"See {address} for now.", "It is long."]


@pytest.mark.parametrize("n", [3, 9, 500])
def test_quotations_over_many_open_marks(n):
    quote = "“Look. " + "( " * n + "Then go. Now.”"
    assert cut(f"He said: {quote} She left.") == [f"He said: {quote}", "She left."]
