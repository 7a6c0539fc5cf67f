"""Problem 8: the reading level of a commit's message.

The prose of the message is taken out of the export (headers, title, trailers, automatic and merge messages, quoted
lines and diffs are not prose), only its paragraphs in English (by problem 3's operator) count, and six classic readability formulas over sentence
lengths, letters and syllables (counted by hyphenation-style rules) are combined by their median.  Levels are grades
cut at the thresholds that are wrong for the fewest of a bounded sample of labelled documents.

Defined results: null, empty and blank texts and messages without English prose have 0 words and null grade and level;
a repeated row is repeated in the result.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import language
from lectern.llm.common import map_rows
from lectern.runtime import bounded_sample, checkpointed, small_side, spread, worker_cache

#: At most about so many labelled documents are read to fit the thresholds.
LABELLED = 2000
#: Thresholds between levels 1|2, 2|3 and 3|4 where labels of a level are missing.
THRESHOLDS = (5.0, 11.0, 20.0)
LEAST_WORDS = 40

TRAILER = re.compile(r"^(?:[A-Z][A-Za-z]*(?:-[A-Za-z]+)*:\s|(?:Closes|Fixes|Refs|See|Resolves|Related)\b[: ]*\S*#\d|\(cherry picked from|git-svn-id:|This reverts commit|\[[a-z-]+\]\s|#\s)")
AUTOMATIC = re.compile(r"^(?:Merge (?:branch|remote|pull|tag|commit|changeset|in)\b|Merged? |Auto|Bump )|\[bot\]")
WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
SENTENCE_END = re.compile(r"[.!?]+(?=[\s\"')\]]|$)")
#: A diff of one file in any of its forms, with all its hunks: what its header must look like is what tells it from prose.
DIFF = (
    r"(?:(?<=\n)|\A)(?:diff --(?:git|cc|combined) [^\n]++\n(?=(?:index|old mode|new (?:mode|file)|deleted file|mode|similarity|dissimilarity|rename|copy|Binary|GIT binary|---) ?)"
    r"|Index: [^\n]++\n(?====)|(?=--- [^\n]++\n\+\+\+ [^\n]++\n@@))"
    r"(?:(?!diff --)(?:[-+ @\\=]|index |old mode |new mode |new file |deleted file |mode |similarity |dissimilarity |rename |copy |Binary files |GIT binary patch|literal |delta )[^\n]*+(?:\n|\z)"
    r"|[A-Za-z][0-9A-Za-z!#$%&()*+;<=>?@^_`{|}~-]{10,}+\r?(?:\n|\z)|\r?\n)*+"  # binary data, blank lines
)
CODE = re.compile(r"`[^`]*`|https?://\S+|\S+@\S+\.\S+")


def prose(head: str) -> list[str]:
    """The paragraphs of prose of a commit export, of which ``head`` is what is left without its diffs."""
    lines = head.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    while lines and not lines[0].strip():
        lines.pop(0)
    if not lines:
        return []
    first = lines[0]
    body: list[str]
    if first.startswith("commit ") or first.startswith("From "):
        at = next((i for i, x in enumerate(lines) if not x.strip()), len(lines))
        header, body = lines[:at], lines[at + 1 :]
        if first.startswith("From "):  # the title is the subject
            stop = next((i for i, x in enumerate(body) if x.rstrip() == "---"), len(body))
            body = [" ".join(x for x in header if x.startswith(("Subject:", " "))).removeprefix("Subject:").strip(), "", *body[:stop]]
            body[0] = re.sub(r"^\[[^\]]*\]\s*", "", body[0])
    elif first.startswith("# HG changeset"):
        at = next((i for i, x in enumerate(lines) if not x.startswith("#")), len(lines))
        header, body = lines[:at], lines[at:]
    else:
        header, body = (lines[:1], lines[1:]) if re.match(r"^.*<[^>]*>\s*$", first) else ([], lines)
    if any("[bot]" in x for x in header):
        return []
    body = [x.strip() for x in body]
    while body and not body[0]:
        body.pop(0)
    if not body or AUTOMATIC.search(body[0]):
        return []
    body.pop(0)  # the title
    out: list[str] = []
    part: list[str] = []
    for x in [*body, ""]:
        if TRAILER.match(x) or x.startswith((">", "|", "* ", "#")) or re.fullmatch(r"[-=_*~]{3,}", x):
            x = ""
        if x:
            part.append(x)
        elif part:
            out.append(CODE.sub(" ", " ".join(part)))
            part = []
    if part:
        out.append(CODE.sub(" ", " ".join(part)))
    return out


#: Where vowels that stand together part, in the manner of hyphenation patterns: a digit weighs the place before the next
#: letter, the largest one of all patterns that match holds, and an odd one parts.  A point is an end of the word.
PARTS = (
    "i1a i1o i1um i1us i1ent i1ence i1er. i1est i1et i1al ci2a ti2a si2a gi2a ci2o ti2o si2o gi2o xi2o ni2on li2on lli4on ti2ent ci2ent are3a. pe2op"
    " i3ation ri3ous ri3or vi3ous di3ous bi3o li3o vi3o ni3or ri3o di3o"
    " u1a u1ous u1ity u1ing u1ine u1ent u1ence u1al u1el u1ate u1o q2u2a q2u2e q2u2i q2u2o q2u4al q2u4ent q2u4ence q2u4ate q2u4ing g2u2a g2u2e g2u2ing g2u2ish s2u2a"
    " e1o e1a1t e2at e2ate cre3ate e3al. e1ality re3al i3de1a i1de3al re3act re3app e2ous g2e2o c2e2ou"
    " a1ing e1ing i1ing o1ing y1ing a1ic o1ic e1ist o1ist o1e1v po3em po3et co3op co3ord y1a1 a1os"
).split()


def _weights(pattern: str) -> tuple[str, list[int]]:
    letters = re.sub(r"\d", "", pattern)
    weights = [0] * (len(letters) + 1)
    at = 0
    for c in pattern:
        if c.isdigit():
            weights[at] = int(c)
        else:
            at += 1
    return letters, weights


PATTERNS = dict(map(_weights, PARTS))
LONGEST = max(map(len, PATTERNS))
VOWELS = frozenset("aeiouyäöüáéíóúàèâêîôû")


def syllables(word: str) -> int:
    """Groups of vowels, parted where :data:`PARTS` say so, less silent endings."""
    w = f".{word.lower()}."
    parts = [0] * (len(w) + 1)
    for i in range(len(w)):
        for j in range(i + 1, min(i + LONGEST, len(w)) + 1):
            if weights := PATTERNS.get(w[i:j]):
                for k, n in enumerate(weights, i):
                    parts[k] = max(parts[k], n)
    n = 0
    for i in range(1, len(w) - 1):
        if w[i] in VOWELS and (w[i - 1] not in VOWELS or parts[i] % 2):
            n += 1
    bare = w[1:-1]
    if re.search(r"[^aeiouy]e$", bare) and not re.search(r"[^aeiouy]le$", bare):
        n -= 1
    elif re.search(r"[^aeiouytd]ed$", bare) or re.search(r"[^aeiouysxzcg]es$", bare) and not re.search(r"(?:sh|ch|[^aeiouy]l)es$", bare):
        n -= 1
    return max(n + bare.endswith("ism"), 1)


def grade(paragraphs: list[str], syllables_of: dict[str, int]) -> tuple[int, float | None]:
    """Words of the paragraphs, and the median of six grade estimates."""
    n = letters = syl = hard = sentences = 0
    for text in paragraphs:
        words = WORD.findall(text)
        n += len(words)
        for w in words:
            letters += len(w)
            s = syllables_of.get(w)
            if s is None:
                s = sum(map(syllables, w.replace("’", "'").replace("'", "").split("-")))
                if len(syllables_of) < 200_000:
                    syllables_of[w] = s
            syl += s
            hard += s > 2
        sentences += max(len(SENTENCE_END.findall(text)), 1)
    if not n:
        return 0, None
    per, easy = n / sentences, n - hard
    linsear = (easy + 3 * hard) * 100 / n / (sentences * 100 / n)
    grades = sorted((
        0.39 * per + 11.8 * syl / n - 15.59,
        0.4 * (per + 100 * hard / n),
        1.043 * math.sqrt(hard * 30 / sentences) + 3.1291,
        5.88 * letters / n - 29.6 * sentences / n - 15.8,
        4.71 * letters / n + 0.5 * per - 21.43,
        linsear / 2 if linsear > 20 else linsear / 2 - 1,
    ))
    return n, (grades[2] + grades[3]) / 2


def messages(docs: DataFrame) -> DataFrame:
    """``(doc_id, message)``: the paragraphs of prose of each text, by blank lines; diffs go before texts leave the JVM."""

    def of_batch(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "message": ["\n\n".join(prose(t)) if t else "" for t in batch.column("rest").to_pylist()]}

    rest = docs.select("doc_id", F.regexp_replace("text", DIFF, "\n").alias("rest"))
    return map_rows(spread(rest), of_batch, "doc_id bigint, message string")


def language_model(said: DataFrame) -> language.Model:
    """Problem 3's model of languages, learnt from all messages."""
    texts = said.select(F.col("doc_id").alias("call_id"), F.col("message").alias("text"), F.lit(None).cast("string").alias("format"))
    return language.fitted(checkpointed(language.packed_words(texts)))


def grades(said: DataFrame, model: language.Model) -> DataFrame:
    """``(doc_id, words, grade)`` of the English paragraphs of each message."""
    labeller_of = language.shared_labeller(said.sparkSession, model)

    def of_batch(batch: pa.RecordBatch) -> dict:
        labeller, syllables_of = labeller_of(), worker_cache().setdefault("syllables", {})
        paragraphs = [[p for p in m.split("\n\n") if p] for m in batch.column("message").to_pylist()]
        labels = iter(labeller.label([language.words_of(p) for ps in paragraphs for p in ps]))
        found = [grade([p for p in ps if language.main_language(next(labels)) == "en"], syllables_of) for ps in paragraphs]
        return {"doc_id": batch.column("doc_id"), "words": [n for n, _ in found], "grade": [g for _, g in found]}

    return map_rows(said, of_batch, "doc_id bigint, words int, grade double", rows=4096)


def thresholds(graded: DataFrame, labels: DataFrame, rows: int = LABELLED) -> tuple[float, float, float]:
    """Fitted on at most about ``rows`` labelled documents (a documented bound); a document's label is its median one."""
    rated = labels.where("reading_level BETWEEN 1 AND 4").groupBy("doc_id").agg(F.percentile("reading_level", 0.5).alias("level"))
    some = small_side(bounded_sample(rated.where("level = floor(level)"), "doc_id", rows))
    held = graded.where(F.col("words") >= LEAST_WORDS).join(some, "doc_id").select("grade", "level")
    pairs = [(r["grade"], r["level"]) for r in held.collect()]
    return tuple(best_cut(pairs, k) for k in (1, 2, 3))  # type: ignore[return-value]


def best_cut(pairs: list[tuple[float, float]], k: int) -> float:
    """The grade that best parts levels up to ``k`` from those above: fewest wrong, then the middle of the widest gap."""
    pairs = sorted(pairs)
    if not any(lv <= k for _, lv in pairs) or not any(lv > k for _, lv in pairs):
        return THRESHOLDS[k - 1]
    wrong = [sum(lv <= k for _, lv in pairs)]  # all above the cut
    for _, lv in pairs:
        wrong.append(wrong[-1] + (1 if lv > k else -1))
    gaps = [(wrong[i], pairs[i - 1][0] - pairs[i][0], (pairs[i - 1][0] + pairs[i][0]) / 2) for i in range(1, len(pairs))]
    return min(gaps)[2] if gaps else THRESHOLDS[k - 1]


def reading_levels(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, words, grade, level)`` of each document."""
    said = checkpointed(messages(docs))  # read to learn the languages, and to grade
    graded = checkpointed(grades(said, language_model(said)))  # three numbers a document: for the thresholds, and the result
    a, b, c = thresholds(graded, labels)
    level = 1 + (F.col("grade") >= a).cast("int") + (F.col("grade") >= b).cast("int") + (F.col("grade") >= c).cast("int")
    return graded.withColumn("level", F.when(F.col("words") > 0, level))


def most_demanding(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id)`` of documents with at least 40 words of English prose on level 4."""
    return reading_levels(docs, labels).where((F.col("words") >= LEAST_WORDS) & (F.col("level") == 4)).select("doc_id")
