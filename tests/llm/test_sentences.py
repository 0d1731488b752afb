import pytest

from mentionloom.llm import sentences as S

LINES = {
    "en": ["When re-examined by Dr. Orvane, the infant showed mild spasm (cf. Fig. 6.8).", "Slides went to Hastovan Labs Inc.", "The dose was raised at 8 a.m.", "Twin B weighed 3.5 kg at birth... then a tremor set in.", "The kit was shipped from the U.S.", 'The aunt replied: "He was well until spring."', '"He never crawled. He only rolled," said the mother of twin A.', "Did she walk?", "No. 9 in the pedigree had spasm vs. laxity in No. 14."],
    "de": ["Die Kontrolle erfolgte am 9. 7. um 8 Uhr.", "Prof. Brithok fand milde Steife der Hüfte vgl. Abb. 6 und S. 68.", "Am 8. Tag nach der Geburt wurde Steife gesehen, z. B. von Dr. Nirelle.", "„Er läuft nicht. Er rollt nur“, sagte die Mutter."],
    "zh": ["患者2没有小脑萎缩，也没有关节僵硬；随访8个月。", "“疼吗？”医生问。", "姨妈说：“他很好。”", "剂量增至27.7 mg……但没有效果。"],
    "th": ["แพทย์นัดติดตามอาการทุกเดือน", "ค่าแลกเตตเท่ากับ18.4มก./ดล.", "มารดามีอาการบวมที่ขา"],
}


@pytest.fixture(scope="module")
def corpus():
    import random

    r, rows = random.Random(3), []
    for _ in range(400):
        lang = r.choice(list(LINES))
        parts = [r.choice(LINES[lang]) for _ in range(r.randint(1, 5))]
        joint = "" if lang == "zh" else " "
        rows.append((joint.join(parts), parts))
    return rows


@pytest.fixture(scope="module")
def found(spark, corpus):
    df = spark.createDataFrame([(i, t, "x") for i, (t, _) in enumerate(corpus)], "passage_id bigint, text string, sent_no string")
    out = {}
    for r in S.sentences(df).collect():
        out.setdefault(r["passage_id"], []).append((r["sent_no"], r["start_char"], r["end_char"]))
    return {k: [(a, b) for _, a, b in sorted(v)] for k, v in out.items()}


def test_held_out_sentences_of_every_script(corpus, found):
    right = wrong = 0
    for i, (text, parts) in enumerate(corpus):
        got = [text[a:b] for a, b in found[i]]
        right += got == parts
        wrong += got != parts
    assert right / (right + wrong) > 0.95


def test_sentences_cover_the_text_without_outer_space(corpus, found):
    for i, (text, _) in enumerate(corpus):
        spans = found[i]
        assert all(text[a:b] == text[a:b].strip() and a < b for a, b in spans)
        assert "".join(text[a:b] for a, b in spans).replace(" ", "") == text.replace(" ", "")
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:], strict=False))


def test_headings_lists_and_wrapped_lines(spark):
    text = "Case report\n\nThe infant showed\nmild spasm. She walked.\n1. mild spasm\n2. late tremor\n\nVerlauf"
    df = spark.createDataFrame([(1, text)] * 3 + [(2, "Case report\nShe sat.")] * 4, "passage_id bigint, text string")
    got = {text[r["start_char"] : r["end_char"]] for r in S.sentences(df).filter("passage_id = 1").collect()}
    assert got == {"Case report", "The infant showed\nmild spasm.", "She walked.", "1. mild spasm", "2. late tremor", "Verlauf"}


def test_null_blank_empty_and_long(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, "😀 One. " * 5000)], "passage_id bigint, text string")
    rows = S.sentences(df).collect()
    assert {r["passage_id"] for r in rows} == {4} and max(r["end_char"] for r in rows) == len("😀 One. " * 5000) - 1
    assert S.sentences(df.limit(0)).count() == 0


def test_every_counted_token_and_line_is_kept(spark):
    word = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:05d}")
    many = [(f"{word(i)[0].upper()}{word(i)[1:]} {word(i)}x. next\nhead {word(i)}\nend",) for i in range(6000) for _ in range(8)]
    rare = [("Zz zz. next\nhead zz\nend",)] * 8
    stats = S.statistics(spark.createDataFrame(many + rare, "text string").repartition(4))
    assert len(stats.before) >= 6001 and stats.before["zz"] == (8, 0) and stats.final("zz") == "never"
    assert all(stats.starter(f"{word(i)[0].upper()}{word(i)[1:]}") == "often" for i in range(0, 6000, 500)) and stats.starter("Zz") == "often"
    assert stats.lines["head zz"] == 8 and len(stats.lines) == 12002


def test_copies_take_no_place_in_the_training_sample(spark):
    texts = spark.createDataFrame([(f"She sat {w}. He ran.",) for w in ("up", "in", "by", "on")], "text string")
    from pyspark.sql import functions as F

    first = texts.orderBy(F.xxhash64("text")).first()[0]
    copies = texts.unionByName(spark.createDataFrame([(first,)] * 20, "text string"))
    stats = S.statistics(texts)
    assert (S.train(copies, stats, 4) == S.train(texts, stats, 4)).all()


def test_joined_statistics_give_the_same_sentences(spark, corpus, found):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(corpus)], "passage_id bigint, text string")
    got = {}
    for r in S.sentences(df, broadcast=0).orderBy("passage_id", "sent_no").collect():
        got.setdefault(r["passage_id"], []).append((r["start_char"], r["end_char"]))
    assert got == found


def test_sample_is_bounded_and_the_same_everywhere(spark):
    texts = spark.createDataFrame([(f"Case {i} sat. He ran {i}.",) for i in range(3000)], "text string")
    a, b = ({r[0] for r in S.sample_texts(df, 300).collect()} for df in (texts, texts.unionByName(texts).repartition(7)))
    assert a == b and 200 < len(a) < 400


@pytest.mark.parametrize("unit", ["患者没有小脑萎缩，也没有关节僵硬；“随访。”8个月.", "The infant (\"case 3\") showed mild spasm, vs. 3.5 kg. ", "a\n\n\n", "(", 'a: "b" '])
def test_time_in_proportion_to_length(unit):
    from time import process_time

    stats, model = S.Statistics({}, {}, {}), S.Model(S.fit([]))
    seconds = []
    for n in (20_000, 200_000):
        began = process_time()
        S.split(unit * (n // len(unit)), stats, model)
        seconds.append(process_time() - began)
    assert seconds[1] < 40 * seconds[0] + 0.2  # a hundred times and more if it were quadratic
