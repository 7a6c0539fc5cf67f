"""Problem 3: the language of texts and of their segments.

The script of a word narrows its candidate languages; within a script a naive Bayes model over character n-grams and
words scores each candidate; Viterbi decoding with a penalty for switching labels the words of a paragraph, so that
foreign words do not break a paragraph up and a change of language does.  The model is trained here, on all the
texts themselves: function words label the first paragraphs, then the model labels all of them again.

Defined results: null, empty and blank texts and texts without letters have no segments; repeated rows of one call
count once in :func:`undeclared`; a project that is null or has no configuration declares nothing.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import format_key, latest_configs, map_rows
from lectern.llm.markup import _DROP_LINE, _HEADING, _ITEM, TAG, masked
from lectern.runtime import checkpointed, small_side, spread, worker_cache

LANGS = ("en", "de", "fr", "es", "pt", "pl", "is", "ru", "ja", "zh", "th", "hi")
LATIN = LANGS[:7]
#: All that a segment may be labelled: a language, or none of them.
LABELS = (*LANGS, "und")
#: Features are hashed into so many buckets, which is what bounds the model.
BUCKETS = 1 << 18
#: Counts are summed in blocks of so many buckets.
BLOCK = 1024
#: How often the model labels its own lessons again.
ROUNDS = 1
SWITCH = 6.0
#: A whole paragraph has at least so many letters; fewer in scripts whose characters hold more.
LEAST, LEAST_DENSE = 28, 12
#: A function-word vote needs so many words.
LEAST_WORDS = 6
#: A paragraph is in a language if at least this share of its letters is.
SHARE = 0.6

#: Codes and names of the languages (two letters, three letters, names); fixed values.
NAMES = {
    "en": "en eng english", "de": "de deu ger german deutsch", "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castilian", "pt": "pt por portuguese português portugues", "pl": "pl pol polish polski",
    "is": "is isl ice icelandic íslenska islenska", "ru": "ru rus russian русский", "ja": "ja jpn japanese 日本語",
    "zh": "zh zho chi cmn chinese mandarin 中文", "th": "th tha thai ไทย", "hi": "hi hin hindi हिन्दी हिंदी",
}
CODES = {name: lang for lang, names in NAMES.items() for name in names.split()}

#: Function words that label the first paragraphs; fixed values.
SEEDS = {
    "en": "the and of is in to for with this that are was on after before without because when",
    "de": "der die das und ist nicht ein eine mit auf für nach vor den dem des wegen ohne",
    "fr": "le la les des est une dans pour avec sans après avant chaque sur et du au",
    "es": "el la los las una por para con sin del después antes cuando más cada y en",
    "pt": "o os as um uma não dos das do da na nas no por para sem depois antes com em",
    "pl": "nie się na w z do przed po przez bez gdy jest każdym i dla ten",
    "is": "og er í á að við fyrir eftir með þessi sem hverri ekki um þegar",
}

#: Letters of other scripts with the shape of a Latin one, in words that are otherwise Latin; fixed values.
SHAPES = str.maketrans("асеіјорѕухһԁԛԝАВСЕНІЈКМОРЅТХУοΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aceijopsuxhdqwABCEHIJKMOPSTXYoABEZHIKMNOPTYX")
WORD = re.compile(
    r"(?P<ja>[぀-ヿㇰ-ㇿ]+)|(?P<han>[㐀-䶿一-鿿豈-﫿々]+)|(?P<th>[฀-๿]+)"
    r"|(?P<hi>[ऀ-ॣ०-ॿ‌‍]+)|(?P<other>[^\W\d_]+(?:['’][^\W\d_]+)*)"
)
PLAIN_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
DENSE = re.compile(r"[ऀ-ॿ฀-๿぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿]")
INVISIBLE = re.compile("[­᠎​-‏⁠-⁤﻿]")
_TAGGED_LINE = re.compile(r"</?(?:h[1-6]|li|ul|ol|table|t[dhr]|dl|dt)\b", re.I)
CYRILLIC = re.compile(r"[Ѐ-ԯ]")
LATIN_LETTER = re.compile(r"[A-Za-zÀ-ɏ]")


def plain(word: str) -> str:
    """The word without its accents."""
    word = word.replace("ł", "l").replace("ß", "ss").replace("ð", "d").replace("þ", "th").replace("æ", "ae").replace("ø", "o")
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


SEED_WORDS = {lang: frozenset(words.split()) for lang, words in SEEDS.items()}
PLAIN_SEEDS = {lang: frozenset(map(plain, words)) - {"a", "e", "o", "i", "y", "en", "la", "de", "as"} for lang, words in SEED_WORDS.items()}


def declared(code: str | None) -> str | None:
    """The language that a configured code or name declares, or None."""
    if not code or not code.strip():
        return None
    low = code.strip().lower()
    return CODES.get(low) or CODES.get(re.split(r"[-_ ()./]", low)[0])


#: Cyrillic letters that Russian does not have.
NOT_RUSSIAN = re.compile(r"[^\W\d_а-яё]")


def script(word: str) -> str:
    """ja (kana), han, th, hi, cyrillic, latin, or und where no language is told apart."""
    if word.isascii():
        return "latin"
    m = WORD.match(word)
    kind = m.lastgroup if m else "other"
    if kind != "other":
        return kind
    return "latin" if LATIN_LETTER.search(word) else "cyrillic" if CYRILLIC.search(word) else "und"


def words_of(text: str) -> list[str]:
    """Words in lower case, and runs of characters of scripts without spaces; single letters tell nothing."""
    if text.isascii():
        return [w for w in PLAIN_WORD.findall(text.lower()) if len(w) > 1]
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    if not text.isprintable():
        text = INVISIBLE.sub("", text)
    text = text.lower()
    if not DENSE.search(text):
        words = PLAIN_WORD.findall(text)
        if CYRILLIC.search(text):
            words = [w.translate(SHAPES) if not w.isascii() and LATIN_LETTER.search(w) else w for w in words]
        return [w for w in words if len(w) > 1]
    out = []
    for m in WORD.finditer(text):
        word = m[0]
        if m.lastgroup == "other":
            if len(word) == 1:
                continue
            if not word.isascii() and LATIN_LETTER.search(word):
                word = word.translate(SHAPES)
        out.append(word)
    return out


def digraphs(word: str) -> str:
    return plain(word.replace("ä", "ae").replace("ö", "oe").replace("ü", "ue"))


def prose_paragraphs(text: str, own: str = "plaintext") -> list[str]:
    """Whole paragraphs of prose: no code, headings, list items, tables, directives or pieces of markup."""
    rest, _ = masked(text.replace("\r\n", "\n"), own)
    out: list[str] = []
    part: list[str] = []
    skip = noted = False
    lines = rest.split("\n")
    for line in [*lines, ""]:
        bare = line.strip()
        if bare and (noted := _ADMONITION.match(line) is not None or noted and line[0] in " \t"):
            line = line if _ADMONITION.match(line) else bare  # what it says is indented prose
        if not bare:
            if part and not skip:
                out.append(" ".join(part))
            part, skip = [], False
        elif skip:
            pass
        elif _ITEM.match(line) or re.match(r"^[ \t]*(?:\d+[.)]|[•‣])[ \t]", line) or line.startswith((" .. ", ".. ", "   ")) and not part:
            if part:
                out.append(" ".join(part))
            part, skip = [], True
        elif _DROP_LINE.match(line) or _HEADING.match(line) or bare.startswith(("|", "{|", "!", "@@", "\\")) and not bare.startswith("![") or _TAGGED_LINE.match(bare) or re.fullmatch(rf"(?:{TAG})+", bare, re.I):
            if re.fullmatch(r"([~^\"=-])\1{2,}", bare) and len(part) == 1:
                part = []  # the title above its underline
            elif part:
                out.append(" ".join(part))
                part = []
            if _HEADING.match(line) or bare.startswith("\\"):
                part = []
        else:
            part.append(bare)
    return out


#: Directives whose bodies are prose; fixed values.
_ADMONITION = re.compile(r"[ \t]*\.\. (?:note|tip|warning|seealso|important|hint|caution|danger|attention|error|admonition)::")
_NO_PROSE = re.compile(
    rf"{TAG}|<!--.*?-->|&\w+;|https?://\S+|\\[A-Za-z]+\*?(?:\[[^\]]*\])?(?:\{{[a-z]+:[^}}]*\}})?|\]\([^)]*\)|\[\[[a-z]+:[^\]]*\]|\$[^$]*\$|\{{\{{[^}}]*\}}\}}|@@[^@]*@@|<[^>]*>`_",
    re.I,
)
_NO_WORD = re.compile(r"\S+@\S+|:[a-z]+:`|\w*_\w+|[A-Za-z0-9+/=_-]{24,}|(?<![A-Za-z0-9])(?=[A-Za-z]*\d)[A-Za-z0-9]{4,}")
_MAY_HOLD = re.compile(r"[<&$\[\]{\\]|@@|://")
_MAY_HOLD_NO_WORD = re.compile(r"[@_`\d+/=]")


def _strip(paragraph: str) -> str:
    """Without links, commands, identifiers, hashes and encoded blobs."""
    if _MAY_HOLD.search(paragraph):
        paragraph = _NO_PROSE.sub(" ", paragraph)
    return _NO_WORD.sub(" ", paragraph) if _MAY_HOLD_NO_WORD.search(paragraph) else paragraph


def buckets_of(word: str) -> np.ndarray:
    """The buckets of a word's features: the word itself and its character n-grams, hashed."""
    w = f"^{word}$"
    grams = [w, *(w[i : i + n] for n in (1, 2, 3, 4) for i in range(len(w) - n + 1))]
    return np.fromiter((zlib.crc32(g.encode()) % BUCKETS for g in grams), np.int32, len(grams))


def lessons_of(word: str) -> np.ndarray:
    """The buckets that are learnt from a word: its own and those of its spellings without accents."""
    return np.concatenate([buckets_of(form) for form in sorted({word, plain(word), digraphs(word)})])


class Model:
    """Naive Bayes over hashed character n-grams for the languages of the Latin script, and over Han characters.

    Its size is fixed by ``BUCKETS``, whatever the vocabulary of the corpus.
    """

    def __init__(self, counts: np.ndarray | None = None, han: dict[str, tuple[int, int]] | None = None) -> None:
        """From counts by Latin language and bucket, and of each Han character in ja and zh."""
        self.table = None
        self.taught = np.zeros(len(LATIN), bool)
        if counts is not None and counts.any():
            counts = counts.astype(np.float64)
            totals = counts.sum(1, keepdims=True) + 1.0
            self.taught = totals[:, 0] > 1.0
            size = np.count_nonzero(counts.any(0)) + 1.0
            self.table = np.ascontiguousarray(np.log((counts + 0.1) / (totals + 0.1 * size)).T.astype(np.float32))
        total = [sum(n[k] for n in (han or {}).values()) + 1 for k in (0, 1)]
        odds = lambda n: math.log((n[0] + 0.5) / total[0]) - math.log((n[1] + 0.5) / total[1])
        self.han = {c: max(-2.0, min(2.0, odds(n))) for c, n in (han or {}).items()}

    def score(self, word: str) -> np.ndarray:
        """Log-probabilities over LABELS, floored so that no single word outweighs its paragraph."""
        out, kind = np.full(len(LABELS), -8.0), script(word)
        if kind == "latin":
            s = self.table[buckets_of(word)].sum(0, dtype=np.float64) / math.sqrt(len(word) + 2) if self.table is not None else np.zeros(len(LATIN))
            if self.taught.any():
                s = np.where(self.taught, s, -np.inf)
            s = s - (s.max() + math.log(np.exp(s - s.max()).sum()))
            out[: len(LATIN)] = np.maximum(s, -6.0)
        elif kind == "cyrillic":
            known = not NOT_RUSSIAN.search(word)
            out[LABELS.index("ru")], out[-1] = (0.0, -1.0) if known else (-8.0, 0.0)
        elif kind == "han":
            ja = 1 / (1 + math.exp(-sum(self.han.get(c, 0.0) for c in word)))
            out[LABELS.index("ja")], out[LABELS.index("zh")] = math.log(max(ja, 0.02)), math.log(max(1 - ja, 0.02))
        else:
            out[LABELS.index(kind)] = 0.0
        return out


def viterbi(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best labels of many sequences of words at once; each change of label costs ``switch``.

    ``scores`` holds the rows of all sequences; each has a start and a length in it.  All sequences take a step together.
    """
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    own = np.arange(scores.shape[1], dtype=np.int8)
    back, path = np.empty(scores.shape, np.int8), np.zeros(len(scores), np.int8)
    going = np.searchsorted(-lengths, -np.arange(lengths[0] + 1), side="left")  # how many are longer than t
    best = scores[starts]
    for t in range(1, int(lengths[0])):
        n = going[t]
        at, b = starts[:n] + t, best[:n]
        top = b.argmax(1)
        moved = b[np.arange(n), top] - switch
        stays = b >= moved[:, None]
        back[at] = np.where(stays, own, top[:, None])
        best[:n] = np.where(stays, b, moved[:, None]) + scores[at]
    label = best.argmax(1)
    for t in range(int(lengths[0]) - 1, 0, -1):
        n = going[t]
        at = starts[:n] + t
        path[at] = label[:n]
        label[:n] = back[at, label[:n]]
    path[starts] = label
    return path


class Said(NamedTuple):
    """Paragraphs as numbers of words: how many words each has, the distinct words, and the number of each word in turn."""

    lengths: np.ndarray
    words: list[str]
    ids: np.ndarray

    @classmethod
    def of(cls, paragraphs: list[list[str]]) -> Said:
        known: dict[str, int] = {}
        n = sum(map(len, paragraphs))
        ids = np.fromiter((known.setdefault(w, len(known)) for p in paragraphs for w in p), np.int64, n)
        return cls(np.fromiter(map(len, paragraphs), np.int64, len(paragraphs)), list(known), ids)

    def parts(self, step: int) -> Iterator[Said]:
        """The same in steps of about ``step`` words."""
        ends = np.cumsum(self.lengths)
        at = begin = 0
        while at < len(ends):
            end = max(at + 1, int(np.searchsorted(ends, begin + step, side="right")))
            yield Said(self.lengths[at:end], self.words, self.ids[begin : ends[end - 1]])
            at, begin = end, int(ends[end - 1])


class Vocabulary:
    """Rows of numbers for words, worked out once for each; ``row`` tells a word's."""

    LIMIT = 100_000

    def __init__(self, columns: int, row: Callable[[str], np.ndarray | Sequence[float]]) -> None:
        self.known: dict[str, int] = {}
        self.words: list[str] = []
        self.table, self.of = np.empty((1024, columns)), row

    def _add(self, word: str) -> int:
        k = self.known[word] = len(self.known)
        self.words.append(word)
        if k >= len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        self.table[k] = self.of(word)
        return k

    def ids(self, words: Sequence[str]) -> np.ndarray:
        known, add = self.known, self._add
        return np.fromiter((known[w] if w in known else add(w) for w in words), np.int64, len(words))

    def is_full(self) -> bool:
        return len(self.known) >= self.LIMIT

    def clear(self) -> None:
        self.known.clear()
        self.words.clear()


Segment = tuple[str, int, float]


class Labeller:
    """A model with the scores of the words it has met; paragraphs are labelled many at a time."""

    #: So many words at most are labelled in one step.
    STEP = 10_000

    def __init__(self, model: Model) -> None:
        self.words = Vocabulary(len(LABELS) + 1, lambda w: [*model.score(w), len(w)])

    def label(self, paragraphs: list[list[str]]) -> list[list[Segment]]:
        """``(language, size, confidence)`` of the segments of each paragraph, given as its words."""
        return self.label_all(Said.of(paragraphs))

    def label_all(self, said: Said) -> list[list[Segment]]:
        if self.words.is_full():
            self.words.clear()
        rows = self.words.ids(said.words)  # may replace the table
        return [x for part in said.parts(self.STEP) for x in self._label(part.lengths, self.words.table[rows[part.ids]])]

    def _label(self, lengths: np.ndarray, rows: np.ndarray) -> list[list[Segment]]:
        filled = np.flatnonzero(lengths)
        out: list[list[Segment]] = [[] for _ in lengths]
        if not len(filled):
            return out
        starts = np.concatenate([[0], np.cumsum(lengths[filled])])
        scores, sizes = rows[:, :-1], rows[:, -1]
        stay = np.add.reduceat(scores, starts[:-1], axis=0)
        lang = stay.argmax(1)
        # No path with a switch can be better than one label throughout.
        is_one = stay.max(1) >= np.add.reduceat(scores.max(1), starts[:-1]) - SWITCH
        sure = np.exp(scores[np.arange(len(scores)), np.repeat(lang, lengths[filled])]) * sizes
        total = np.add.reduceat(sizes, starts[:-1])
        confidence = np.add.reduceat(sure, starts[:-1]) / total
        mixed = np.flatnonzero(~is_one)
        labels = viterbi(scores, starts[mixed], lengths[filled][mixed]) if len(mixed) else None
        for k, (p, one) in enumerate(zip(filled.tolist(), is_one.tolist())):
            if one:
                out[p] = [(LABELS[lang[k]], int(total[k]), float(confidence[k]))]
                continue
            a, b = starts[k], starts[k + 1]
            path, own = labels[a:b], sizes[a:b]
            sure_of = np.exp(scores[np.arange(a, b), path]) * own
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(path)) + 1])
            for x, size, c in zip(cuts, np.add.reduceat(own, cuts), np.add.reduceat(sure_of, cuts)):
                out[p].append((LABELS[path[x]], int(size), float(c / size)))
        return out

    def paragraph(self, text: str) -> list[Segment]:
        return self.label([words_of(_strip(text))])[0]


def main_language(segments: list[Segment]) -> str | None:
    """The language of most letters of a paragraph, if it is that of most of them."""
    sizes: dict[str, int] = {}
    for lang, n, _ in segments:
        sizes[lang] = sizes.get(lang, 0) + n
    lang = max(sizes, key=sizes.get, default=None)
    return lang if lang and sizes[lang] >= SHARE * sum(sizes.values()) else None


def paragraph_language(segments: list[tuple[str, int, float]]) -> str | None:
    """The language in which a whole paragraph is written."""
    lang = main_language(segments)
    if lang not in LANGS:
        return None
    size = sum(n for x, n, _ in segments if x == lang)
    return lang if size >= (LEAST_DENSE if lang in ("ja", "zh") else LEAST) else None


def _told(word: str) -> list[float]:
    """Votes of a word for the Latin languages, whether it is Latin, Han or kana, and how long it is."""
    kind = script(word)
    if kind != "latin":
        return [*[0.0] * len(LATIN), 0.0, kind == "han", kind == "ja"]
    return [*((word in SEED_WORDS[x]) + 0.5 * (word in PLAIN_SEEDS[x]) for x in LATIN), 1.0, 0.0, 0.0]


class Counter:
    """Counts of buckets by Latin language and of Han characters by ja and zh, over the paragraphs it is given."""

    def __init__(self, model: Model | None = None) -> None:
        columns = len(LATIN) + 3
        self.told = Vocabulary(2 * len(LATIN) + 3, lambda w: [*_told(w), *(model.score(w)[: len(LATIN)] if model else [0.0] * len(LATIN))])
        self.by_model, self.columns = model is not None, columns
        self.words = np.zeros((len(LATIN), 1024), np.int64)
        self.counts = np.zeros((len(LATIN), BUCKETS), np.int64)
        self.han: dict[str, list[int]] = {}

    #: So many words at most are counted in one step.
    STEP = 10_000

    def add(self, said: Said) -> None:
        if self.told.is_full():
            self._flush()
        rows = self.told.ids(said.words)
        for part in said.parts(self.STEP):
            self._add(part.lengths, rows[part.ids])

    def _add(self, lengths: np.ndarray, ids: np.ndarray) -> None:
        filled = np.flatnonzero(lengths)
        if not len(filled):
            return
        starts = np.concatenate([[0], np.cumsum(lengths[filled])[:-1]])
        n, rows = len(LATIN), self.told.table[ids]
        is_latin = rows[:, n] > 0
        sums = np.add.reduceat(rows[:, : n + 3], starts, axis=0)
        known = (sums[:, n] > 0.5 * lengths[filled]) & (sums[:, n] >= LEAST_WORDS)
        if self.by_model:
            votes = np.add.reduceat(np.where(is_latin[:, None], rows[:, n + 3 :], 0.0), starts, axis=0)
            ranked = np.sort(votes, axis=1)
            sure = ranked[:, -1] - ranked[:, -2] > 3
        else:
            votes = sums[:, :n]
            ranked = np.sort(votes, axis=1)
            sure = (ranked[:, -1] >= 2) & (ranked[:, -1] > 1.3 * ranked[:, -2])
        lang = np.where(known & sure, votes.argmax(1), -1)
        of_word = np.where(is_latin, np.repeat(lang, lengths[filled]), -1)
        size = len(self.told.words)
        if self.words.shape[1] < size:
            self.words = np.pad(self.words, ((0, 0), (0, 2 * size - self.words.shape[1])))
        taken = of_word >= 0
        self.words[:, :size] += np.bincount(of_word[taken] * size + ids[taken], minlength=n * size).reshape(n, size)
        if not self.by_model:
            for k in np.flatnonzero(~known & (sums[:, n + 1] > 0)).tolist():
                column = 0 if sums[k, n + 2] > 0 else 1
                for i in range(starts[k], starts[k] + lengths[filled[k]]):
                    if rows[i, n + 1] > 0:
                        for c in self.told.words[ids[i]]:
                            self.han.setdefault(c, [0, 0])[column] += 1

    def _flush(self) -> None:
        for k, word in enumerate(self.told.words):
            n = self.words[:, k]
            if n.any():
                np.add.at(self.counts.T, lessons_of(word), n)
        self.words[:] = 0
        self.told.clear()

    def result(self) -> tuple[np.ndarray, dict[str, list[int]]]:
        self._flush()
        return self.counts, self.han


def train(texts: list[tuple[str, str]], rounds: int = ROUNDS) -> Model:
    """From ``(text, format)``: function words label the first paragraphs, then the model labels all of them again."""
    paragraphs = Said.of([words_of(_strip(p)) for text, own in texts for p in prose_paragraphs(text, own)])
    model, han = None, {}
    for _ in range(rounds + 1):
        counter = Counter(model)
        counter.add(paragraphs)
        counts, seen = counter.result()
        if model is None or counts.any():
            han = han or {c: tuple(n) for c, n in seen.items()}
            model = Model(counts, han)
    return model


#: A row holds the paragraphs of many texts: their calls and numbers, and what they say as in :class:`Said`.
PACKED = "calls array<bigint>, numbers array<int>, lengths array<int>, words array<string>, ids binary"


def packed_words(calls: DataFrame) -> DataFrame:
    """The words of all paragraphs, packed as ``PACKED``: texts are parsed here and nowhere else.

    A text without prose has one paragraph numbered -1 with the words of all it has.
    """

    def pack(b: pa.RecordBatch) -> dict:
        ids, numbers, paragraphs = [], [], []
        for call, text, own in zip(*(b.column(c).to_pylist() for c in ("call_id", "text", "own"))):
            before = len(ids)
            for k, paragraph in enumerate(prose_paragraphs(text, own)):
                if words := words_of(_strip(paragraph)):
                    ids.append(call)
                    numbers.append(k)
                    paragraphs.append(words)
            if len(ids) == before and (words := words_of(_strip(masked(text.replace("\r\n", "\n"), own)[0]))):
                ids.append(call)
                numbers.append(-1)
                paragraphs.append(words)
        said = Said.of(paragraphs)
        width = np.uint16 if len(said.words) <= 1 << 16 else np.uint32
        return {"calls": [ids], "numbers": [numbers], "lengths": [said.lengths], "words": [said.words], "ids": [said.ids.astype(width).tobytes()]}

    texts = spread(calls.where(F.col("text").isNotNull()).select("call_id", "text", format_key(F.col("format")).alias("own")))
    return map_rows(texts, pack, PACKED)


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[list[int | None], np.ndarray, Said]]:
    """Of each packed row: calls, numbers of paragraphs, and what they say."""
    for calls, numbers, lengths, words, ids in zip(*(batch.column(c) for c in ("calls", "numbers", "lengths", "words", "ids"))):
        sizes = lengths.values.to_numpy(zero_copy_only=False).astype(np.int64)
        raw, n = ids.as_py(), int(sizes.sum())
        of = np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32).astype(np.int64)
        yield calls.as_py(), numbers.values.to_numpy(zero_copy_only=False), Said(sizes, words.as_py(), of)


def fitted(packed: DataFrame, rounds: int = ROUNDS) -> Model:
    """What :func:`train` learns, from the words of all texts; each round is one sum of partial counts.

    What reaches the driver is at most ``BUCKETS`` counts for each language, and for Han characters in ja and zh.
    """
    context = packed.sparkSession.sparkContext
    # Each task gives a table of counts, so there are no more tasks than cores can use.
    tasks = packed.coalesce(4 * context.defaultParallelism)
    rows = ("lang", "block", "counts")

    def blocks_of(tables: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
        keys = list(tables)
        columns = [pa.array([x for x, _ in keys], pa.int32()), pa.array([y for _, y in keys], pa.int32()), pa.array([tables[k].tobytes() for k in keys], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, list(rows))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for lang, block, counts in zip(*(batch.column(c).to_pylist() for c in rows)):
                found = np.frombuffer(counts, np.int64)
                sums[lang, block] = sums[lang, block] + found if (lang, block) in sums else found
        yield blocks_of(sums)

    def counted(model: Model | None) -> tuple[np.ndarray, dict[str, tuple[int, int]]]:
        shared = context.broadcast(vars(model)) if model else None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = None
            if shared:
                known = Model()
                vars(known).update(shared.value)
            counter = Counter(known)
            for batch in batches:
                for _, numbers, said in unpacked(batch):
                    prose = numbers >= 0
                    counter.add(Said(said.lengths[prose], said.words, said.ids[np.repeat(prose, said.lengths)]))
            counts, han = counter.result()
            of_han = np.zeros((2, BUCKETS), np.int64)  # by code point, which are fewer than buckets
            for c, both in han.items():
                of_han[:, ord(c)] = both
            whole = np.concatenate([counts, of_han]).reshape(-1, BUCKETS // BLOCK, BLOCK)
            yield blocks_of({(int(x), int(y)): whole[x, y] for x, y in np.argwhere(whole.any(2))})

        parts = tasks.mapInArrow(run, "lang int, block int, counts binary").repartition("lang", "block")
        sums = parts.mapInArrow(add_up, "lang int, block int, counts binary").toArrow()
        whole = np.zeros((len(LATIN) + 2, BUCKETS // BLOCK, BLOCK), np.int64)
        for lang, block, counts in zip(*(sums.column(c).to_pylist() for c in rows)):
            whole[lang, block] = np.frombuffer(counts, np.int64)
        whole = whole.reshape(len(LATIN) + 2, BUCKETS)
        ja, zh = whole[len(LATIN) :]
        return whole[: len(LATIN)], {chr(c): (int(ja[c]), int(zh[c])) for c in np.flatnonzero(ja + zh).tolist()}

    counts, han = counted(None)
    model = Model(counts, han)
    for _ in range(rounds):
        counts, _ = counted(model)
        if counts.any():
            model = Model(counts, han)
    return model


def shared_labeller(session: SparkSession, model: Model) -> Callable[[], Labeller]:
    """What gives a worker its labeller, which is made once and keeps the scores of the words it has met."""
    shared, stamp = session.sparkContext.broadcast(vars(model)), uuid.uuid4().hex

    def get() -> Labeller:
        cache = worker_cache()
        if cache.get("labeller", (None,))[0] != stamp:
            known = Model()
            vars(known).update(shared.value)
            cache["labeller"] = stamp, Labeller(known)
        return cache["labeller"][1]

    return get


SEGMENTS = "call_id bigint, paragraph int, segment int, lang string, size int, confidence double, whole string"


def segments(calls: DataFrame, model: Model | None = None) -> DataFrame:
    """A row for each segment of a prose paragraph: ``(call_id, paragraph, segment, lang, size, confidence, whole)``.

    ``whole`` is the language of the whole paragraph (null where it is too short or mixed).  Languages of other scripts
    are ``und``.  A text without prose has its segments under paragraph -1, none of them whole.
    """
    packed = checkpointed(packed_words(calls))
    model = model or fitted(packed)
    labeller_of = shared_labeller(calls.sparkSession, model)

    def batch(b: pa.RecordBatch) -> dict:
        labeller, rows = labeller_of(), []
        for ids, numbers, said in unpacked(b):
            for call, p, found in zip(ids, numbers.tolist(), labeller.label_all(said)):
                whole = paragraph_language(found) if p >= 0 else None
                rows += [(call, p, s, lang, size, confidence, whole) for s, (lang, size, confidence) in enumerate(found)]
        names = SEGMENTS.replace(",", "").split()[::2]
        return dict(zip(names, zip(*rows))) if rows else {n: [] for n in names}

    return map_rows(packed, batch, SEGMENTS, rows=16)


def declarations(configs: DataFrame) -> DataFrame:
    """``(project_id, declared)`` of each project's latest configuration."""
    low = F.lower(F.trim("lang"))
    pairs = F.create_map(*[F.lit(x) for pair in CODES.items() for x in pair])
    code = F.coalesce(F.try_element_at(pairs, low), F.try_element_at(pairs, F.split(low, r"[-_ ()./]")[0]))
    return latest_configs(configs).select("project_id", code.alias("declared"))


def undeclared(calls: DataFrame, configs: DataFrame) -> DataFrame:
    """``(call_id, lang)`` of each language of a whole paragraph that the call's project does not declare.

    Texts are labelled before anything is joined, so the join moves a few short rows per call.
    """
    found = segments(calls).where(F.col("whole").isNotNull()).groupBy("call_id", F.col("whole").alias("lang")).agg(F.lit(1).alias("one"))
    project = calls.select("call_id", "project_id").distinct()
    known = project.join(small_side(declarations(configs)), "project_id", "left").select("call_id", "declared")
    return found.join(known, "call_id").where(F.col("declared").isNull() | (F.col("declared") != F.col("lang"))).select("call_id", "lang").distinct()


def documents(calls: DataFrame) -> DataFrame:
    """``(call_id, lang, confidence)``: the language of most of each text that has any letters.

    The confidence is the mean over the text's letters of how sure each is of that language.
    """
    once = segments(calls).select("call_id", "paragraph", "segment", "lang", "size", "confidence").distinct()
    per = once.groupBy("call_id", "lang").agg(F.sum("size").alias("n"), (F.sum(F.col("confidence") * F.col("size")) / F.sum("size")).alias("c"))
    top = per.groupBy("call_id").agg(F.max(F.struct("n", "lang", "c")).alias("m"), F.sum("n").alias("all"))
    return top.select("call_id", F.col("m.lang").alias("lang"), F.round(F.col("m.c") * F.col("m.n") / F.col("all"), 4).alias("confidence"))
