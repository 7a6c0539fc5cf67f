import pytest

from lectern.llm import sentences

PARAGRAPHS = [
    "The parser skips the cells. The nightly job hides the notes. The copy desk is here! Our editor plugin waits? The parser stops.",
    "The copy desk waits. A stray comma looks better. texpurge joins two. The nightly job by Prof. Move is on. See Fig. 3 below.",
    "Our editor plugin drops it. The parser keeps p. 5 there. texpurge hides it! The copy desk is at approx. 3 now.",
    "A stray comma drops it.", "A stray comma is here.", "texpurge drops it.", "texpurge waits here.", "Die Vorlage ist da.", "Der Setzer prüft alles.",
    "Der Parser zählt Wörter. Die Vorlage prüft alles! Der Setzer wartet am 7. Mai hier. Die Vorlage ist da.",
    "校正者は見出しを残す。目次は行を落とす！編集部は待っている。", "目次は語数を数える。校正者は飛ばす。", "编辑部重写了符号。目录页跳过了单元格！夜间任务还在等。",
    "ร่างฉบับที่สองข้ามช่องว่าง", "หน้าสารบัญนับคำสองครั้ง", "ผู้ตรวจปรู๊ฟซ่อนหมายเหตุ",
]


@pytest.fixture(scope="module")
def model():
    return sentences.train(["\n\n".join(PARAGRAPHS)] * 5)


CASES = [
    ("The parser skips it. The copy desk waits.", ["The parser skips it.", "The copy desk waits."]),
    ("The parser (cf. Eq. 5) skips it by Prof. Move and J. Renda here. Our editor plugin waits.", ["The parser (cf. Eq. 5) skips it by Prof. Move and J. Renda here.", "Our editor plugin waits."]),
    ('The parser says "The copy desk waits. A stray comma looks." because so. The parser stops.', ['The parser says "The copy desk waits. A stray comma looks." because so.', "The parser stops."]),
    ("The parser waits. (The copy desk is here.) The parser stops.", ["The parser waits.", "(The copy desk is here.)", "The parser stops."]),
    ("The parser waits.The copy desk stops.", ["The parser waits.", "The copy desk stops."]),
    ("The parser waits at 5 p.m. The copy desk stops at 8 a.m. Monday or so.", ["The parser waits at 5 p.m.", "The copy desk stops at 8 a.m. Monday or so."]),
    ("The parser... waits. texpurge hides it.", ["The parser... waits.", "texpurge hides it."]),
    ("The parser\nwaits here\n\nThe copy desk stops", ["The parser\nwaits here", "The copy desk stops"]),
    ("The parser waits:\n\n- one. Two\n- three\n\n1) four", ["The parser waits:", "one. Two", "three", "four"]),
    ("The parser uses `a. B` and $x = 4. Y$ and https://a.example/v5.1/a.html now. The copy desk stops.", ["The parser uses `a. B` and $x = 4. Y$ and https://a.example/v5.1/a.html now.", "The copy desk stops."]),
    ("校正者は「目次は行を落とす。」と書いて残す。目次は待つ！", ["校正者は「目次は行を落とす。」と書いて残す。", "目次は待つ！"]),
    ("「目次は行を落とす。」校正者は残す。", ["「目次は行を落とす。」", "校正者は残す。"]),
    ("编辑部重写了……目录页跳过了。", ["编辑部重写了……", "目录页跳过了。"]),
    ("ร่างฉบับที่สองข้ามช่องว่างในหน้า 15 ของเล่ม หน้าสารบัญนับคำ ผู้ตรวจปรู๊ฟซ่อน", ["ร่างฉบับที่สองข้ามช่องว่างในหน้า 15 ของเล่ม", "หน้าสารบัญนับคำ", "ผู้ตรวจปรู๊ฟซ่อน"]),
    ("これは文です 次の文もあります", ["これは文です", "次の文もあります"]), ("今天天气很好 我们去公园", ["今天天气很好", "我们去公园"]), ("校正者は 見出しを残す。目次は待つ。", ["校正者は 見出しを残す。", "目次は待つ。"]),
    ("ນີ້ແມ່ນປະໂຫຍກ ນີ້ແມ່ນອີກປະໂຫຍກ", ["ນີ້ແມ່ນປະໂຫຍກ", "ນີ້ແມ່ນອີກປະໂຫຍກ"]),
    ("यह अनुच्छेद है। पुराना साँचा रखता है॥ रात का काम", ["यह अनुच्छेद है।", "पुराना साँचा रखता है॥", "रात का काम"]),
    ("Der Setzer wartet am 7. Mai hier. Die Vorlage ist da.", ["Der Setzer wartet am 7. Mai hier.", "Die Vorlage ist da."]),
    ("", []), (" \n\t", []), (None, []), ("...", ["..."]), ("- ", ["-"]),
]


@pytest.mark.parametrize("text, expected", CASES)
def test_units(model, text, expected):
    assert [text[a:b] for a, b in sentences.units(text, model)] == expected


def test_declared_abbreviations(model):
    text = "The parser is next Krf. Beta here. The copy desk stops."
    declared = sentences.spelled([" Krf. ", None, ""])
    assert [text[a:b] for a, b in sentences.units(text, model, declared)] == ["The parser is next Krf. Beta here.", "The copy desk stops."]


def test_units_cover_the_text(model):
    import random

    random.seed(3)
    for _ in range(300):
        text = "".join(random.choice(["The parser ", "waits", ". ", "! ", "\n", "\n\n", "- ", "(", ")", '"', "。", "目次は", " ", "1. ", "«", "ก ข ", "`", "$"]) for _ in range(30))
        spans = sentences.units(text, model)
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        left = list(text)
        for a, b in spans:
            left[a:b] = " " * (b - a)
        assert not any(c.isalpha() for c in left)


def test_viterbi():
    assert sentences.viterbi([], []) == []
    assert sentences.viterbi([1.0, -1.0, 2.0], [0, 9, 9]) == [True, False, True]
    assert sentences.viterbi([1.0, 1.5], [0, 1]) == [False, True]


def test_rows(spark):
    from datetime import datetime

    text = "The parser is Krf. Beta. The copy desk stops. The parser waits."
    rows = [(1, 1, text, ["Krf"]), (1, 1, text, ["Krf"]), (2, 2, text, None), (3, None, None, None), (4, 1, "", [None])]
    calls = spark.createDataFrame([(*r, 5) for r in rows], "call_id bigint, project_id bigint, text string, extra_abbreviations array<string>, start_pos int")
    configs = spark.createDataFrame([(2, "a", datetime(2025, 1, 1), ["Krf."])], "project_id bigint, rc_path string, loaded_at timestamp, extra_abbreviations array<string>")
    got = sorted(tuple(r) for r in sentences.starts(calls, configs).collect())
    assert [c for c, _ in got] == [1, 1, 2, 2] and all(text[p : p + 3] == "The" for _, p in got)
    assert sentences.starts(calls.limit(0), configs).count() == 0


def test_very_long(model):
    text = "The parser skips it. The copy desk waits. " * 20_000
    assert len(sentences.units(text, model)) == 40_000


def test_learns_from_all_texts(spark):
    rare = [f"The parser skips the Zwq. notes of page {k} here." for k in range(3)]
    texts = [f"{p} {k}." for k, p in enumerate(PARAGRAPHS * 1000)] + rare
    calls = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "call_id bigint, text string").repartition(4)
    whole, got = sentences.train(texts), sentences.fitted(calls)
    assert "Zwq" in got.short and got.short == whole.short
    assert got.odds.items() <= whole.odds.items()
    tried = [*set(PARAGRAPHS), *rare]
    assert [sentences.units(t, got) for t in tried] == [sentences.units(t, whole) for t in tried]


def test_weights_are_learnt():
    known = sentences.FIRST_EVIDENCE
    seen = {("dot upper", 5): 900, ("dot upper", 1): 100, ("close lower", 1): 500, ("start upper", 5): 9, ("inside lower", 1): 9}
    got = sentences.context_weights(seen, known)
    assert set(got) == {"dot upper", "close lower"}
    assert abs(1 / (1 + 2.718281828 ** -got["dot upper"]) - 0.9) < 0.06 and got["close lower"] < sentences.first_weight("close lower")
    sure = {("start upper", 5): 900, ("start upper", 0): 100, ("inside lower", 0): 500, ("inside lower", 1): 500}
    learnt = sentences.evidence_weights(sure)
    assert learnt["dense"] == known["dense"] and learnt["spaced"][5] == sentences.MOST_EVIDENCE and learnt["spaced"][1] == sentences.LEAST_EVIDENCE
    assert sentences.evidence_weights({}) == known  # too little to learn from
