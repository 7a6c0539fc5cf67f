import numpy as np
import pytest

from lectern.llm import language


@pytest.mark.parametrize("code, lang", [("en", "en"), ("EN_us", "en"), ("eng", "en"), ("German", "de"), ("pt-BR", "pt"), ("zho", "zh"), ("", None), (None, None), ("und", None), ("xx", None), ("zh-CN", "zh"), (" fr ", "fr")])
def test_declared(code, lang):
    assert language.declared(code) == lang


def test_viterbi_is_best_path():
    rng = np.random.default_rng(1)
    for _ in range(40):
        s = -rng.random((5, 3)) * 6
        best = max(
            ((sum(s[i, p[i]] for i in range(5)) - 2.0 * sum(a != b for a, b in zip(p, p[1:])), p) for p in np.ndindex(3, 3, 3, 3, 3)),
        )[0]
        path = language.viterbi(np.concatenate([s[:2], s, s]), np.array([0, 2, 7]), np.array([2, 5, 5]), 2.0)[2:7]
        got = sum(s[i, path[i]] for i in range(5)) - 2.0 * sum(a != b for a, b in zip(path, path[1:]))
        assert abs(got - best) < 1e-9


def test_paragraphs():
    text = "# Head\n\nA paragraph of text.\nIt goes on.\n\n- item\n- item\n\n```\ncode\n```\n\n| a | b |\n\nLast one."
    assert language.prose_paragraphs(text, "markdown") == ["A paragraph of text. It goes on.", "Last one."]
    assert language.prose_paragraphs("") == [] and language.prose_paragraphs(" \n\n ") == []


SAMPLES = {
    "en": "The parser keeps every heading in place after each save because the margin is narrow. ", "de": "Der Parser behält jede Überschrift nach jedem Speichern und das ist nicht gut für den Druck. ",
    "fr": "Le correcteur garde chaque titre à sa place avant le tirage dans la plupart des cahiers. ", "es": "El corrector mantiene cada título en su sitio cuando la cola está vacía sin ningún aviso. ",
    "pt": "O corretor mantém cada título no lugar depois de cada gravação e não esconde as notas. ", "pl": "Korektorka zostawia każdy nagłówek na miejscu po każdym zapisie i nie gubi nic przez to. ",
    "is": "Kaflinn heldur hverri fyrirsögn á sínum stað þegar biðröðin er tóm og það er ekki við. ", "ru": "Корректор держит каждый заголовок на месте после каждого сохранения текста. ",
    "ja": "校正者は保存のたびに見出しをそのまま残すので、この段落は短い。", "zh": "每次保存之后编辑部保留了每个标题的位置，因为页边太窄了。", "th": "ผู้ตรวจปรู๊ฟเก็บหัวข้อไว้ที่เดิมหลังจากบันทึกทุกครั้ง ", "hi": "यह अनुच्छेद छपाई से पहले हर शीर्षक को वहीं रखता है। ",
}


@pytest.fixture(scope="module")
def labeller():
    return language.Labeller(language.train([(s * 2, "plaintext") for s in SAMPLES.values() for _ in range(3)]))


@pytest.mark.parametrize("lang", sorted(SAMPLES))
def test_languages(labeller, lang):
    assert language.paragraph_language(labeller.paragraph(SAMPLES[lang])) == lang


def test_accents_and_shapes(labeller):
    assert language.paragraph_language(labeller.paragraph(language.plain(SAMPLES["fr"].lower()))) == "fr"
    assert language.paragraph_language(labeller.paragraph(SAMPLES["en"].replace("a", "а").replace("e", "е"))) == "en"
    mixed = labeller.paragraph(SAMPLES["en"] + SAMPLES["de"])
    assert [x[0] for x in mixed] == ["en", "de"] and all(0 <= x[2] <= 1 for x in mixed)
    assert language.paragraph_language(labeller.paragraph("If a < b and c > d, keep both.")) is None
    assert labeller.paragraph("") == [] and labeller.paragraph("123 !!") == []


def test_rows(spark):
    from datetime import datetime

    two = SAMPLES["en"] * 2 + "\n\n" + SAMPLES["ru"] * 2
    rows = [(1, 1, two), (1, 1, two), (2, None, two), (3, 2, SAMPLES["ja"]), (4, 9, ""), (5, 1, None)]
    calls = spark.createDataFrame([(*r, None, "x") for r in rows], "call_id bigint, project_id bigint, text string, format string, lang string")
    configs = spark.createDataFrame([(1, "a", datetime(2025, 1, 1), "ru"), (1, "a", datetime(2025, 1, 2), "English"), (2, "b", None, "und")], "project_id bigint, rc_path string, loaded_at timestamp, lang string")
    got = sorted(tuple(r) for r in language.undeclared(calls, configs).collect())
    assert got == [(1, "ru"), (2, "en"), (2, "ru"), (3, "ja")]
    assert language.undeclared(calls.limit(0), configs).count() == 0


def test_learns_from_all_texts(spark):
    rare = "Kaflinn heldur hverri fyrirsögn og það er ekki við."
    texts = [f"{SAMPLES['en']}\n\n{SAMPLES['ja']}"] * 6000 + [rare, SAMPLES["zh"]]
    calls = spark.createDataFrame([(k, t, None) for k, t in enumerate(texts)], "call_id bigint, text string, format string").repartition(4)
    whole, got = language.train([(t, "plaintext") for t in texts]), language.fitted(language.packed_words(calls))
    assert got.han == whole.han and np.array_equal(got.table, whole.table) and got.taught.tolist() == whole.taught.tolist()
    assert got.taught[language.LATIN.index("is")] and not got.taught[language.LATIN.index("pl")]


def test_no_score_without_training():
    model = language.train([(SAMPLES["en"] * 2, "plaintext"), (SAMPLES["de"] * 2, "plaintext")])
    scores = dict(zip(language.LABELS, model.score("qvuxyz")))
    assert max(scores, key=scores.get) in ("en", "de") and scores["is"] == scores["pl"] == -6.0
    assert np.isfinite(language.Model().score("word")).all()


@pytest.mark.parametrize("text", ["이 문단은 여백이 좁아서 제목을 그대로 둔다 그리고 저장한다", "هذه الفقرة تحتفظ بالعنوان بعد كل حفظ لأن الهامش ضيق", "Το κείμενο αυτό κρατά κάθε επικεφαλίδα στη θέση της", "Цей абзац зберігає кожен заголовок після кожного збереження, і він їх не губить"])
def test_other_languages(labeller, text):
    assert {x[0] for x in labeller.paragraph(text)} == {"und"} and language.paragraph_language(labeller.paragraph(text)) is None


def test_vocabulary_is_bounded(monkeypatch):
    texts = [(" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}q the and of is in to for" for i in range(k, k + 9)), "plaintext") for k in range(200)]
    whole = language.train(texts)
    monkeypatch.setattr(language.Vocabulary, "LIMIT", 10)
    assert np.array_equal(language.train(texts).table, whole.table)
    words = [language.words_of(t) for t, _ in texts]
    a = language.Labeller(whole)
    monkeypatch.setattr(language.Labeller, "STEP", 20)
    assert a.label(words) == language.Labeller(whole).label(words)


def test_documents(spark):
    rows = [(1, SAMPLES["en"] + "\n\n" + SAMPLES["ru"] * 3, None), (2, "- " + SAMPLES["de"] + "\n- " + SAMPLES["de"], "markdown"), (3, "12 !!", None), (4, None, None), (1, SAMPLES["en"] + "\n\n" + SAMPLES["ru"] * 3, None)]
    rows += [(6, SAMPLES["de"] * 2, None), (5, ".. note::\n\n   " + SAMPLES["fr"], "rst")]
    calls = spark.createDataFrame([(*r, "x") for r in rows], "call_id bigint, text string, format string, lang string")
    got = {r.call_id: r for r in language.documents(calls).collect()}
    assert {k: r.lang for k, r in got.items()} == {1: "ru", 2: "de", 5: "fr", 6: "de"} and all(0 < r.confidence <= 1 for r in got.values())
    assert {r.whole for r in language.segments(calls).where("call_id = 5").collect()} == {"fr"}
    assert language.documents(calls.limit(0)).count() == 0
