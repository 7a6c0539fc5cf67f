from lectern.llm import reading

GIT = "commit 0123\nAuthor: A B <a@b.c>\nDate:   now\n\n    Fix title\n\n    First part of the prose is here. It goes on.\n\n    Second one.\n\n    Signed-off-by: A <a@b.c>\n"
MAIL = "From 0123 Mon\nFrom: A <a@b>\nSubject: [PATCH] A title\n that goes on\n\nThe body is here.\n---\n x | 2 +\n"
HG = "# HG changeset patch\n# User A\n\nTitle\n\nThe body is here.\n"
PLAIN = "A B <a@b.c>\n\nTitle\n\nThe body is here.\n\nCloses #12\n"


def test_prose():
    assert reading.prose(GIT) == ["First part of the prose is here. It goes on.", "Second one."]
    assert reading.prose(GIT.replace("\n", "\r\n")) == reading.prose(GIT)
    for x in (MAIL, HG, PLAIN):
        assert reading.prose(x) == ["The body is here."]
    for x in ("", "\n \n", "commit 0\nAuthor: x[bot] <x>\n\n    t\n\n    Text here.", "A <a@b>\n\nMerge branch 'x'\n\nThe body is here."):
        assert reading.prose(x) == []


def test_diffs_go_by_their_form(spark):
    diff = "diff --git a/x b/x\nindex 1..2\n--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n a\n-b\n+c\n\n"
    binary = "diff --git a/y b/y\nnew file mode 100644\nindex 0..1\nGIT binary patch\nliteral 9\nzX^@7u*ShgHk|16a-A{%(\n\nliteral 0\nHcmV?d00001\n\n"
    said = "diff -- is a tool that we use.\ndiff --git is one, too."
    message = PLAIN.replace("The body is here.", said)
    texts = [message + "\n" + diff, message + "\n" + diff + binary, message + "\n" + diff.replace("diff --git a/x b/x\nindex 1..2\n", ""), (message + "\n" + diff).replace("\n", "\r\n"), message + "\n" + diff + "More prose is here.\n", message + "\n" + diff * 3000]
    got = [r.message for r in reading.messages(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()]
    one = said.replace("\n", " ")
    assert got == [one, one, one, one, one + "\n\nMore prose is here.", one]


def test_syllables():
    known = {"the": 1, "table": 2, "made": 1, "created": 3, "jumped": 1, "reading": 2, "classification": 5, "cases": 2, "nation": 2, "variation": 4, "rhythm": 1, "being": 2}
    wrong = {w for w, n in known.items() if reading.syllables(w) != n}
    assert len(wrong) <= 1, wrong


def test_order():
    easy = ["The dog ran to the box. It was red. We had it in the sun."]
    hard = ["The jurisdictional misrepresentation of any contractual obligation circumscribes the fiduciary indemnification of every otherwise unenforceable relinquishment, notwithstanding that such stipulation invalidates the apportionment."]
    a, b = reading.grade(easy, {}), reading.grade(hard, {})
    assert a[1] < 3 < 18 < b[1]
    assert reading.grade([], {}) == (0, None)


def test_cut():
    assert reading.best_cut([(1.0, 1), (2.0, 1), (8.0, 2), (9.0, 3)], 1) == 5.0
    assert reading.best_cut([(1.0, 1), (2.0, 2), (3.0, 1), (8.0, 2), (9.0, 2)], 1) == 5.5
    assert reading.best_cut([], 2) == reading.THRESHOLDS[1]


def test_rows(spark):
    long = "The box ran to the hut. " * 20
    german = PLAIN.replace("The body is here.", "Der Hund läuft auf die Straße und das ist nicht gut. " * 5)
    rows = [(5, german, ""), (1, PLAIN.replace("The body is here.", long), "x"), (2, None, "y"), (3, "", None), (3, "", None), (4, "  \n", "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, level string")
    labels = spark.createDataFrame([(1, "r", 4), (2, "r", None), (2, None, 9)], "doc_id bigint, rater string, reading_level int")
    got = reading.reading_levels(docs, labels).orderBy("doc_id").collect()
    assert [(r.doc_id, r.words) for r in got] == [(1, 120), (2, 0), (3, 0), (3, 0), (4, 0), (5, 0)] and got[0].level == 1 and got[1].level is None
    assert reading.most_demanding(docs.limit(0), labels).count() == 0


def test_held_out(spark, data):
    """Fitted on half of the labels, right on most of the rest."""
    from lectern.runtime import table

    docs, labels = table(spark, data.replace("sf0.001", "sf0.01"), "documents"), table(spark, data.replace("sf0.001", "sf0.01"), "reading_labels")
    a, b = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    held = b.where("reading_level IS NOT NULL").join(reading.reading_levels(docs, a), "doc_id").where(f"words >= {reading.LEAST_WORDS}")
    n, right = held.count(), held.where("level = reading_level").count()
    assert right > 0.85 * n
