import pytest

from foliant.llm.sentences import sentence_ends, sentences

CASES = [
    ("Dr. A. B. Smith saw Fig. 3. It rose to 3.5 mm. See config.json v1.2.3 now.", ["Dr. A. B. Smith saw Fig. 3.", "It rose to 3.5 mm.", "See config.json v1.2.3 now."]),
    ("It failed twice ... yet stayed. pH rose to 4 K. The rest…  Done?! Yes!!", ["It failed twice ... yet stayed.", "pH rose to 4 K.", "The rest…", "Done?!", "Yes!!"]),
    ('"A is b. Nothing is c," wrote Doe. He asked "Why?" and left. (It ended.) Then', ['"A is b. Nothing is c," wrote Doe.', 'He asked "Why?" and left.', "(It ended.)", "Then"]),
    ("# Head one. Two\nA wrapped\nline goes on. Next\n- item 1.5 kg\n* other\n\n2. Title\n\nLast", ["# Head one. Two", "A wrapped\nline goes on.", "Next", "- item 1.5 kg", "* other", "2. Title", "Last"]),
    ("Am 3. März wurden z. B. Tabellen geprüft. „X ist offen. Niemand prüft“, schrieb Y.", ["Am 3. März wurden z. B. Tabellen geprüft.", "„X ist offen. Niemand prüft“, schrieb Y."]),
    ("« Le x suffit. Rien ne va », écrit Yves. Pourquoi ? Selon M. Z, oui.", ["« Le x suffit. Rien ne va », écrit Yves.", "Pourquoi ?", "Selon M. Z, oui."]),
    ("“甲不可靠。乙才是。”Name在丙中写道。丁戊！“己。”庚辛？", ["“甲不可靠。乙才是。”Name在丙中写道。", "丁戊！", "“己。”", "庚辛？"]),
    ("「甲は弱い。乙は強い。」とXは書いた。丙。", ["「甲は弱い。乙は強い。」とXは書いた。", "丙。"]),
    ("รูปที่ 10 แสดง ผลลัพธ์ abc ทั้งหมด\nขอบเขต 5% ลดลง", ["รูปที่ 10 แสดง", "ผลลัพธ์ abc ทั้งหมด", "ขอบเขต 5% ลดลง"]),
    ("क्या यह है? \"अ है। ब नहीं,\" ऐसा लिखा। अंत", ["क्या यह है?", "\"अ है। ब नहीं,\" ऐसा लिखा।", "अंत"]),
    ("هل هذا صحيح؟ نعم هو كذلك۔ انتهى", ["هل هذا صحيح؟", "نعم هو كذلك۔", "انتهى"]),
    ("Սա մեկն է։ Սա երկուսն է։", ["Սա մեկն է։", "Սա երկուսն է։"]),
    ("ይህ አንድ ነው። ይህ ሁለት ነው።", ["ይህ አንድ ነው።", "ይህ ሁለት ነው።"]),
    ("अ है॥ ब है॥", ["अ है॥", "ब है॥"]),
    ("One line\n> goes on here. Two", ["One line\n  goes on here.", "Two"]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_units(spark, text, want):
    got = sentences(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("sent_no").collect()
    assert [r["sentence"] for r in got] == want and [r["sent_no"] for r in got] == list(range(1, len(want) + 1))
    assert sorted(r["sent_end"] for r in sentence_ends(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()) == [r["sent_end"] for r in got]
    for r in got:
        assert len(text[r["sent_start"] : r["sent_end"]]) == len(r["sentence"])


def test_defined_results(spark):
    long = "A sentence stands here. " * 20_000
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n ", "a"), (4, "😀 One. Two.", "a"), (4, "😀 One. Two.", "a"), (5, long, "a"), (6, "ab\uE001cd. \uE00FDone", "a")]
    got = sentences(spark.createDataFrame(rows, "doc_id long, text string, sentence string")).collect()
    assert {(r["doc_id"], r["sent_end"]) for r in got if r["doc_id"] != 5} == {(4, 6), (4, 11), (6, 6), (6, 12)}
    assert sum(r["doc_id"] == 5 for r in got) == 20_000 and max(r["sent_end"] for r in got if r["doc_id"] == 5) == len(long) - 1


def test_long_units_stay_whole(spark):
    item = "- " + "Some words go on here. " * 40 + "End"
    cjk = "- 甲是。乙是！丙是？丁\n# अ है। ब है। स"
    quote = '"' + "Some words go on here. " * 40 + 'It ends," wrote Doe.'
    german = "„" + "Etwas steht hier. " * 60 + "Ende“, schrieb Y."
    japanese = "「" + "甲は弱い。" * 200 + "」とXは書いた。"
    want = {1: [item, "Next."], 2: cjk.split("\n"), 3: [quote, "Then."], 4: [german], 5: [japanese, "丙。"]}
    texts = [(1, item + "\nNext."), (2, cjk), (3, quote + " Then."), (4, german), (5, japanese + "丙。")]
    got = sentences(spark.createDataFrame(texts, "doc_id long, text string")).orderBy("doc_id", "sent_no").collect()
    assert {i: [r["sentence"] for r in got if r["doc_id"] == i] for i in want} == want
