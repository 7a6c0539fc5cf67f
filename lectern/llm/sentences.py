"""Problem 1: sentence units of texts in any language and script.

The characters of a block of text are tagged B (a unit begins here) or I by a linear chain with Viterbi decoding.  A
character can only be B where a terminator, a closing mark or, in scripts without periods, a space stands before it;
elsewhere its score for B is minus infinity, so runs of such characters collapse and decoding walks over candidates.
A score adds the weight of the context (kind of mark, kind of what follows, an abbreviation before it) and that of the
evidence: how likely the next words or characters begin a unit.  All is learnt from all texts: beginnings from how
paragraphs begin as against what stands inside them once punctuation is stripped, which is what finds the boundaries of
scripts without periods; the weights of evidence from both of these; abbreviations as words whose period is mostly
followed by no beginning (others are declared or known); the weights of contexts by expectation and maximisation.

Blank lines and list items part blocks before that; pairs of brackets and quotation marks, code, formulas, links and
addresses are taken as single characters, so nothing inside them is B.

Defined results: null, empty and blank texts have no units; repeated rows of one call count once in :func:`starts`;
a text of one unit gives no start; null entries among abbreviations are left out.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.abbreviations import DOTTED, WORDS
from lectern.llm.common import map_rows, with_config
from lectern.runtime import checkpointed, small_side, spread

#: So many texts at most are counted in one step before their counts are summed.
COUNTED_ROWS = 8192

#: Abbreviations that are known in any language: the core's lists. All others are declared or learnt.
KNOWN = frozenset(w.lower() for words in (*WORDS.values(), *DOTTED.values()) for w in words)
TERMINATORS = ".!?…。！？．｡।॥؟‼⁇⁈⁉"
SOFT = ".…．"  # may also stand inside a sentence
OPEN = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "「": "」", "『": "』", "【": "】", "《": "》", "〈": "〉", "«": "»", "“": "”", "„": "“", "‘": "’", "‚": "‘"}
CLOSERS = frozenset(OPEN.values()) | {'"'}
QUOTES = re.compile("[" + "".join(re.escape(c) for c in sorted({*OPEN, *CLOSERS})) + "]")
#: Characters that go on with a sentence after a quotation; fixed values.
PARTICLES = frozenset("とをがはにのもでやか的地得着了")
EVENT = re.compile(f"[{TERMINATORS}]+")
THAI_EVENT = re.compile(f"[{TERMINATORS}]+|\\s+")
ITEM = re.compile(r"[ \t　]*(?:[-*+•‣◦]|\(?\d{1,3}[.)]|\(?[A-Za-z]\)|[（(]?[一二三四五六七八九十]+[)）、])[ \t　]+(?=\S)")
WHOLE = re.compile(
    r"!?\[\[[^\[\]\n]*\](?:\[[^\[\]\n]*\])?\]|!?\[[^\[\]]+\]\([^()\s]+\)|`[^`\n]+`|\$[^$\s][^$\n]*\$|\\[A-Za-z]+\{[^{}]*\}"
    r"|(?<![\w~])~[^~\n]+~(?!\w)|(?<![\w=])=[^=\s][^=\n]*=(?!\w)|@@[a-z]+:.*?@@"
    r"|https?://[^\s<>\"“”«»「」（）。、，　-鿿฀-๿ऀ-ॿ]*[^\s<>\"“”«»「」（）。、，.,;:!?)\]'　-鿿฀-๿ऀ-ॿ]"
    r"|[\w.+-]+@[\w-]+(?:\.[\w-]+)+|(?:file|mailto):[^\s　-鿿]+",
    re.S,
)
BARE = re.compile(r"[^\w\s]+")
UNSPACED = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff]")
LAST_WORD = re.compile(r"[^\s\"'“„«(\[（「、，。：　-鿿]*$")
#: Scripts that put spaces between sentences or clauses, not words: Thai, Lao, Khmer, Myanmar.
THAI = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff]")
#: Scripts without spaces between words that have marks; a text may still do without them.
MARKLESS = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]")


def parted_by_spaces(s: str) -> bool:
    """Whether spaces may part units here: in scripts that never mark them, and where no mark does in one that could."""
    return THAI.search(s) is not None or MARKLESS.search(s) is not None and EVENT.search(s) is None


#: What may be learnt as an abbreviation.
_LETTER = r"(?:[^\W\d_]|[\u0300-\u036f\u0900-\u0903\u093a-\u094f])"
WORD_BEFORE = re.compile(rf"{_LETTER}{{1,8}}(?:\.{_LETTER}{{1,3}})*")
TAIL = re.compile(r"[\s \-–/]")
TWO_PARTS = re.compile(r"\w{1,2}\. \w{1,4}\.")
#: From this class of evidence on, what follows is taken for a beginning.
BEGINS = 4
#: What stands before every character that decoding may make a B.
_MARKS = "".join(re.escape(c) for c in sorted({*TERMINATORS, *CLOSERS}))
AFTER = re.compile(f"(?<=[{_MARKS}])\\s*(?=\\S)")
AFTER_THAI = re.compile(f"(?<=[{_MARKS}])\\s*(?=\\S)|\\s+(?=\\S)")


def blocks(text: str) -> list[tuple[int, int, bool]]:
    """``(start, end, is_item)`` of paragraphs and list items; starts skip white space and list markers."""
    out: list[tuple[int, int, bool]] = []
    at, open_block, prev_blank, in_list = 0, False, True, False
    for line in text.splitlines(keepends=True) if "\r" not in text else re.findall(r"[^\n]*\n|[^\n]+", text):
        end = at + len(line)
        bare = line.strip()
        if not bare:
            open_block, prev_blank = False, True
        else:
            m = ITEM.match(line)
            if m and (prev_blank or in_list):
                out.append((at + m.end(), at + len(line.rstrip()), True))
                in_list = open_block = True
            elif open_block:
                s, _, item = out[-1]
                out[-1] = (s, at + len(line.rstrip()), item)
            else:
                out.append((at + len(line) - len(line.lstrip()), at + len(line.rstrip()), False))
                open_block, in_list = True, False
            prev_blank = False
        at = end
    return out


def covered(s: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Spans that are never cut inside: code, links and the like; and pairs of brackets or quotation marks."""
    whole = [m.span() for m in WHOLE.finditer(s)] if any(c in s for c in "[`$\\~=@:") else []
    pairs: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    k = 0
    for m in QUOTES.finditer(s):
        i, c = m.start(), m[0]
        while k < len(whole) and whole[k][1] <= i:
            k += 1
        if k < len(whole) and whole[k][0] <= i:
            continue
        if c == '"':
            if stack and stack[-1][0] == '"':
                pairs.append((stack.pop()[1], i + 1))
            elif i + 1 < len(s) and not s[i + 1].isspace():
                stack.append(('"', i))
        elif stack and c == stack[-1][0]:
            pairs.append((stack.pop()[1], i + 1))
        elif c in OPEN and not (c == "‘" and i and s[i - 1].isalnum()):
            stack.append((OPEN[c], i))
        elif c in CLOSERS and any(x == c for x, _ in stack):
            while stack[-1][0] != c:
                stack.pop()
            pairs.append((stack.pop()[1], i + 1))
    outer: list[tuple[int, int]] = []
    for a, b in sorted(pairs):
        if not outer or a >= outer[-1][1]:
            outer.append((a, b))
    return whole, outer


def beginnings(s: str) -> list[str]:
    """What of a unit's beginning tells that it is one: its first words, or its first characters."""
    s = s[:60].lstrip("\"'([{“„«‘「『（《¿¡ ")
    if UNSPACED.match(s):
        return [s[:n] for n in (5, 4, 3, 2) if len(s) >= n]
    words = s.split()[:2]
    if not words:
        return []
    first = words[0].rstrip(",;:")
    return [f"{first} {words[1].rstrip(',;:.')}", first] if len(words) > 1 else [first]


#: Upper ends of the classes that log-odds of beginnings fall into; class 0 is an unknown beginning.
BIN_ENDS = (-2.5, -0.75, 0.75, 2.5)
#: What unknown to sure beginnings weigh before anything is learnt.
FIRST_EVIDENCE = {"spaced": (-1.0, -3.0, -1.2, 0.0, 1.5, 3.4), "dense": (0.0, -3.0, -1.2, 0.0, 1.5, 3.4)}
#: What evidence weighs at least and at most: no words alone outweigh a context that speaks clearly.
LEAST_EVIDENCE, MOST_EVIDENCE = -5.0, 3.0
#: How many observations the first weight of a context counts for.
PRIOR = 20.0


def bin_of(odds: float | None) -> int:
    return 0 if odds is None else 1 + bisect_right(BIN_ENDS, odds)


class Model:
    """What is learnt: log-odds of beginnings, abbreviations, and the weights of evidence and of contexts.

    A candidate's score for B is the weight of its context (the mark, what follows in kind, whether an abbreviation
    stands before it) plus the weight of the evidence (how likely what follows begins a unit).
    """

    def __init__(self) -> None:
        self.odds: dict[str, float] = {}
        self.short: frozenset[str] = frozenset()
        self.evidence: dict[str, tuple[float, ...]] = FIRST_EVIDENCE
        self.weights: dict[str, float] = {}

    def begins(self, s: str) -> float | None:
        """From the longest known beginning; None where nothing is known."""
        for g in beginnings(s):
            if g in self.odds:
                return self.odds[g]
        return None


def paragraphs_of(text: str) -> list[str]:
    """The paragraphs that are learnt from, white space made single."""
    return [" ".join(text[a:b].split()) for a, b, item in blocks(text) if not item and b - a > 12]


def evidence(paragraphs: list[str]) -> tuple[Counter, Counter]:
    """How often each beginning begins a unit, and how often it stands inside one."""
    yes, no, pieces = Counter(), Counter(), Counter()
    for p in paragraphs:
        firsts = [0]
        if ends := [m.end() for m in re.finditer(r"[!?。！？।][ ]?(?=\S)", p)]:
            _, spans = covered(p)
            firsts += [e for e in ends if not any(a < e <= b for a, b in spans)]
        stripped = BARE.sub("", p)  # what stands inside, without the punctuation that would give it away
        for at in firsts:
            yes.update(beginnings(p[at : at + 60]))
        if UNSPACED.search(stripped[:3]):
            pieces.update(stripped[i : i + 5] for i in range(4, len(stripped) - 5) if not stripped[i - 1].isspace())
        else:
            words = p.split()
            pieces.update(f"{words[i]} {words[i + 1]}" for i in range(2, len(words) - 1) if words[i - 1][-1].isalnum() and words[i][0].isalnum())
    for piece, n in pieces.items():
        for g in beginnings(piece):
            no[g] += n
    return yes, no


def log_odds(yes: int, no: int) -> float:
    return max(-4.0, min(4.0, math.log((yes + 0.2) / (no + 0.2))))


def asked(text: str) -> set[str]:
    """All beginnings whose odds decoding this text, or learning from it, may ask for."""
    out: set[str] = set()
    for a, b, item in blocks(text):
        if not item:
            s = text[a:b]
            after = AFTER_THAI if parted_by_spaces(s) else AFTER
            joined = " ".join(s.split())
            out.update(beginnings(joined[:60]))
            out.update(beginnings(middle_of(joined)))
            # Between spaced words it makes no difference how they are spaced.
            for x in {s, joined} if UNSPACED.search(s) else (joined,):
                for m in after.finditer(x):
                    out.update(beginnings(x[m.end() : m.end() + 60]))
    return out


def evidence_weights(seen: dict[tuple[str, int], int]) -> dict[str, tuple[float, ...]]:
    """Of each class of evidence the log-likelihood ratio, for scripts with and without spaces between words.

    What surely begins units is what begins paragraphs or follows a mark that ends units only; what stands inside is
    seen in the middle of paragraphs.
    """
    out = {}
    for script in FIRST_EVIDENCE:
        counts = [[1.0, 1.0] for _ in range(len(BIN_ENDS) + 2)]
        for (context, k), n in seen.items():
            kind, following, *_ = context.split(" ")
            if kind in ("start", "inside", "hard") and script_of(following) == script and (kind != "hard" or following not in ("lower", "digit")):
                counts[k][kind == "inside"] += n
        totals = [sum(c[j] for c in counts) for j in (0, 1)]
        if min(totals) > 500:
            out[script] = tuple(max(LEAST_EVIDENCE, min(MOST_EVIDENCE, math.log(b / totals[0]) - math.log(i / totals[1]))) for b, i in counts)
    return {**FIRST_EVIDENCE, **out}


def script_of(following: str) -> str:
    return "dense" if following in ("dense", "particle") else "spaced"


def is_learnable(word: str) -> bool:
    """Whether a word before a period may be learnt as an abbreviation."""
    return WORD_BEFORE.fullmatch(word) is not None


def abbreviations(seen: dict[tuple[str, str, int], int]) -> frozenset[str]:
    """Words whose period is mostly followed by something that begins no unit, from counts by (word, context, class)."""
    after: dict[str, list[int]] = {}
    for (word, _, k), n in seen.items():
        if word:
            after.setdefault(word, [0, 0])[k >= BEGINS] += n
    return frozenset(w for w, (other, begin) in after.items() if other >= max(3, 1.5 * begin))


def context_weights(seen: dict[tuple[str, int], int], evidence: dict[str, tuple[float, ...]]) -> dict[str, float]:
    """The prior log-odds of B in each context, by expectation and maximisation over the classes of evidence seen there.

    Each context starts at its first weight, which counts for ``PRIOR`` observations.
    """
    by_context: dict[str, dict[int, int]] = {}
    for (context, k), n in seen.items():
        if not context.startswith(("start ", "inside ")):
            by_context.setdefault(context, {})[k] = n
    sigmoid = lambda x: 1.0 / (1.0 + math.exp(-x))
    out = {}
    for context, bins in by_context.items():
        first = share = sigmoid(first_weight(context))
        total, weight_of = sum(bins.values()), evidence[script_of(context.split(" ")[1])]
        for _ in range(50):
            odds = math.log(share / (1.0 - share))
            expected = sum(n * sigmoid(odds + weight_of[k]) for k, n in bins.items())
            share = min(max((PRIOR * first + expected) / (PRIOR + total), 1e-3), 1.0 - 1e-3)
        out[context] = math.log(share / (1.0 - share))
    return out


def middle_of(p: str) -> str:
    """What stands at a word in the middle of a paragraph; nothing if that is right behind a mark."""
    at = len(p) // 2 if UNSPACED.search(p[:3]) else p.find(" ", len(p) // 2) + 1
    return p[at : at + 60] if at and p[:at].rstrip()[-1:].isalnum() else ""


def observed(paragraphs: list[str], model: Model) -> Counter:
    """How often each ``(word, context, class of evidence)`` is a candidate; the word is one that may be learnt as short."""
    seen: Counter = Counter()
    for p in paragraphs:
        seen["", f"start {following_of(p)}", bin_of(model.begins(p))] += 1
        if inside := middle_of(p):
            seen["", f"inside {following_of(inside)}", bin_of(model.begins(inside))] += 1
        for c in candidates(p, model, frozenset()):
            word = c.word if c.context.startswith("dot ") and not c.short and is_learnable(c.word) else ""
            seen[word, c.context + " short" if c.short else c.context, bin_of(c.begins)] += 1
    return seen


def contexts(seen: dict[tuple[str, str, int], int], short: frozenset[str]) -> Counter:
    """The same by context alone, abbreviations told."""
    out: Counter = Counter()
    for (word, context, k), n in seen.items():
        out[context + " short" if word in short else context, k] += n
    return out


def train(texts: list[str], least: int = 2) -> Model:
    model = Model()
    paragraphs = [p for text in texts for p in paragraphs_of(text)]
    yes, no = evidence(paragraphs)
    for g in set(yes) | {x for x, n in no.items() if n >= 3}:
        if yes[g] + no[g] >= least:
            model.odds[g] = log_odds(yes[g], no[g])
    seen = observed(paragraphs, model)
    model.short = abbreviations(seen)
    by_context = contexts(seen, model.short)
    model.evidence = evidence_weights(by_context)
    model.weights = context_weights(by_context, model.evidence)
    return model


class Candidate(NamedTuple):
    """A character that may be B: where, in what context, before what, and which word stands before its mark."""

    at: int
    context: str
    begins: float | None
    word: str
    short: bool

    def score(self, model: Model) -> float:
        short = self.short or self.context.startswith("dot ") and self.word in model.short
        context = self.context + " short" if short else self.context
        weight = model.weights.get(context)
        return (first_weight(context) if weight is None else weight) + model.evidence[script_of(context.split(" ", 2)[1])][bin_of(self.begins)]


def first_weight(context: str) -> float:
    """The weight of a context before anything is learnt."""
    kind, following, *rest = context.split(" ")
    total = {"lower": -4.0, "digit": -3.0, "upper": 0.5}.get(following, 0.0)
    if "opens" in rest:  # a pair with a terminator inside stands alone here
        total = max(total, 0.0) + 2.0
    if kind == "space":
        return total + (0.5 if "unspaced" in rest else -2.0)
    if kind == "close":
        return total + (-1.0 if "alone" not in rest else 2.0 if following == "particle" else 5.0)
    if kind == "hard":
        return total + 3.0
    if kind == "dots":  # before a capital an ellipsis may end a unit; in scripts without case it mostly does
        return total + (2.5 if following in ("dense", "particle") else 0.5 if following != "lower" else -0.5)
    total += 2.0
    if "short" in rest:
        total -= 4.0
    if "joined" in rest:  # nothing between the period and what follows
        total -= 1.5 if following == "dense" or "opens" in rest else 4.0
    return total


def is_short(word: str, s: str, mark: int, declared: frozenset[str]) -> bool:
    """Whether a word before a period is an abbreviation by what is known, declared or seen in it."""
    if not word:
        return False
    low = word.lower()
    tail = TAIL.split(low)[-1]
    if word in declared or low in declared or low in KNOWN or tail in KNOWN or len(word) == 1 and word.isalpha():
        return True
    if "." in word and not word[0].isdigit() and all(len(x) <= 3 for x in word.split(".")):
        return True
    previous = s[max(0, mark - len(word) - 12) : mark - len(word) - 1].split()
    return bool(previous) and TWO_PARTS.fullmatch(f"{previous[-1]} {word}.") is not None


def following_of(rest: str) -> str:
    """What kind of character follows, opening marks apart."""
    first = rest.lstrip("\"'([{“„«‘「『（《¿¡")[:1]
    if first.islower():
        return "lower"
    if first.isdigit():
        return "digit"
    if first.isupper():
        return "upper"
    return "particle" if first in PARTICLES else "dense" if first and UNSPACED.match(first) else "other"


def candidate(s: str, kind: str, mark: int, after: int, model: Model, declared: frozenset[str], alone: bool, opens: bool, spaced: bool) -> Candidate:
    """The candidate at ``after``; the mark begins (or what is closed ends) at ``mark``."""
    rest = s[after : after + 60]
    begins = model.begins(rest)
    following = following_of(rest)
    context, word, short = f"{kind} {following}", "", False
    if opens:
        context += " opens"
    if kind == "space":
        context += " unspaced" if UNSPACED.match(s[mark - 1]) else ""
    elif kind == "close":
        context += " alone" if alone else ""
    elif kind == "dot":
        context += "" if spaced else " joined"
        word = LAST_WORD.search(s, max(0, mark - 40), mark)[0].rstrip(".．")
        short = is_short(word, s, mark, declared) or word.isdigit() and len(word) <= 2 and (begins or 0.0) <= 0.5
    return Candidate(after, context, begins, word, short)


def viterbi(scores: list[float], gaps: list[int]) -> list[bool]:
    """Tags of the candidates: B pays its score, two B within three characters pay for being close."""
    best_i, best_b = 0.0, scores[0] if scores else 0.0
    back: list[tuple[bool, bool]] = []
    for k in range(1, len(scores)):
        close = 3.0 if gaps[k] < 3 else 0.0
        from_b_to_b = best_b - close
        back.append((best_b > best_i, from_b_to_b > best_i))
        best_i, best_b = max(best_i, best_b), max(best_i, from_b_to_b) + scores[k]
    tags = [best_b > best_i]
    for to_i, to_b in reversed(back):
        tags.append(to_b if tags[-1] else to_i)
    return tags[::-1] if scores else []


def unit_starts(s: str, model: Model, declared: frozenset[str]) -> list[int]:
    """Where units begin in a block, the first included."""
    found = candidates(s, model, declared)
    if not found:
        return [0]
    gaps = [0, *(b.at - a.at for a, b in zip(found, found[1:]))]
    tags = viterbi([c.score(model) for c in found], gaps)
    return [0, *(c.at for c, t in zip(found, tags) if t)]


def candidates(s: str, model: Model, declared: frozenset[str]) -> list[Candidate]:
    """The characters of a block that may be B, in order."""
    whole, pairs = covered(s)
    inside = sorted([*whole, *pairs])
    opening = {a: b for a, b in pairs}
    found: list[Candidate] = []
    i, n, last = 0, len(s), 0
    k = 0
    by_spaces = parted_by_spaces(s)
    events = THAI_EVENT if by_spaces else EVENT
    standing = {0}
    while i < n:
        while k < len(inside) and inside[k][1] <= i:
            k += 1
        event = events.search(s, i)
        i = event.start() if event else n
        if k < len(inside) and inside[k][0] <= i:
            a, b = inside[k]
            if a in opening and b == opening[a] and s[a:b].rstrip("\"'”’»)]）」』“》")[-1:] and s[a:b].rstrip("\"'”’»)]）」』“》")[-1] in TERMINATORS:
                j = b
                while j < n and s[j].isspace():
                    j += 1
                if j < n and not (s[b] in TERMINATORS + ",;:，、：；"):
                    found.append(candidate(s, "close", b, j, model, declared, a in standing, False, j > b))
                    standing.add(j)
            i = b
            continue
        if i == n:
            break
        j = event.end()
        if s[i] in TERMINATORS:
            run = s[i:j]
            while j < n and s[j] in CLOSERS and j not in opening and not (s[j] == '"' and j + 1 < n and not s[j + 1].isspace()):
                j += 1
            e = j
            while e < n and s[e].isspace():
                e += 1
            if e < n:
                kind = "hard" if any(x not in SOFT for x in run) else "dots" if len(run) > 1 or "…" in run else "dot"
                opens = e in opening and _ends_inside(s, e, opening[e])
                if e > j or opens or s[e].isupper() or UNSPACED.match(s[e]):
                    found.append(candidate(s, kind, i, e, model, declared, False, opens, e > j))
                    standing.add(e)
            i = max(j, i + 1)
            continue
        if i and (UNSPACED.match(s[i - 1]) or s[i - 1] in CLOSERS or s[i - 1].isalnum()):
            e = j
            if e < n and (UNSPACED.match(s[e]) or e in opening):
                found.append(candidate(s, "space", i, e, model, declared, False, e in opening and _ends_inside(s, e, opening[e]), True))
        i = j
    return found


def _ends_inside(s: str, a: int, b: int) -> bool:
    inner = s[a:b].rstrip("\"'”’»)]）」』“》")
    return bool(inner) and inner[-1] in TERMINATORS


def units(text: str | None, model: Model, declared: frozenset[str] = frozenset()) -> list[tuple[int, int]]:
    """``(start, end)`` of every sentence unit; ends leave out white space."""
    out: list[tuple[int, int]] = []
    for a, b, item in blocks(text or ""):
        s = text[a:b]
        begins = [0] if item else unit_starts(s, model, declared)
        for x, y in zip(begins, [*begins[1:], len(s)]):
            out.append((a + x, a + x + len(s[x:y].rstrip())))
    return out


def spelled(abbreviations: list[str | None] | None) -> frozenset[str]:
    """Declared abbreviations without stray spaces and periods, as written and in lower case."""
    words = [w.strip().rstrip(".").strip() for w in abbreviations or () if w]
    return frozenset(w for x in words if x for w in (x, x.lower()))


def fitted(calls: DataFrame, least: int = 2) -> Model:
    """What :func:`train` learns from all texts of the calls, as far as decoding these texts asks for it.

    Both counts are sums over partial counts; odds that no text asks for, most of them of what stands inside units,
    never leave the executors.
    """
    texts = spread(calls.where(F.col("text").isNotNull()).select("text"))

    def beginning(b: pa.RecordBatch) -> dict:
        of_batch = b.column("text").to_pylist()
        yes, no = evidence([p for t in of_batch for p in paragraphs_of(t)])
        wanted = set().union(*map(asked, of_batch))
        keys = list(yes.keys() | no.keys() | wanted)
        return {"g": keys, "yes": [yes[g] for g in keys], "no": [no[g] for g in keys], "wanted": [g in wanted for g in keys]}

    counts = map_rows(texts, beginning, "g string, yes bigint, no bigint, wanted boolean", rows=COUNTED_ROWS)
    sums = counts.groupBy("g").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"), F.max("wanted").alias("wanted"))
    enough = ((F.col("yes") > 0) | (F.col("no") >= 3)) & (F.col("yes") + F.col("no") >= least)
    model = Model()
    model.odds = {r["g"]: log_odds(r["yes"], r["no"]) for r in sums.where(F.col("wanted") & enough).collect()}
    shared = calls.sparkSession.sparkContext.broadcast(vars(model))

    def following(b: pa.RecordBatch) -> dict:
        known = Model()
        vars(known).update(shared.value)
        seen = observed([p for t in b.column("text").to_pylist() for p in paragraphs_of(t)], known)
        keys = list(seen)
        return {"word": [w for w, _, _ in keys], "context": [c for _, c, _ in keys], "k": [k for _, _, k in keys], "n": list(seen.values())}

    counts = map_rows(texts, following, "word string, context string, k int, n bigint", rows=COUNTED_ROWS)
    sums = checkpointed(counts.groupBy("word", "context", "k").agg(F.sum("n").alias("n")))
    after = sums.where("word <> ''").groupBy("word").agg(
        F.sum(F.when(F.col("k") >= BEGINS, F.col("n")).otherwise(0)).alias("begin"), F.sum(F.when(F.col("k") < BEGINS, F.col("n")).otherwise(0)).alias("other")
    )
    short = after.where(F.col("other") >= F.greatest(F.lit(3.0), 1.5 * F.col("begin"))).select("word")
    model.short = frozenset(r["word"] for r in short.collect())
    told = sums.join(small_side(short.withColumn("is_short", F.lit(True))), "word", "left")
    named = F.when(F.col("is_short"), F.concat("context", F.lit(" short"))).otherwise(F.col("context"))
    rows = told.groupBy(named.alias("context"), "k").agg(F.sum("n").alias("n")).collect()
    by_context = {(r["context"], r["k"]): r["n"] for r in rows}
    model.evidence = evidence_weights(by_context)
    model.weights = context_weights(by_context, model.evidence)
    return model


def sentence_units(calls: DataFrame, configs: DataFrame, model: Model | None = None) -> DataFrame:
    """A row for each unit of each row: ``(call_id, unit_no, start_pos, end_pos, sentence)``."""
    model = model or fitted(calls)
    shared = calls.sparkSession.sparkContext.broadcast(vars(model))

    def batch(b: pa.RecordBatch) -> dict:
        known = Model()
        vars(known).update(shared.value)
        out: dict[str, list] = {k: [] for k in ("call_id", "unit_no", "start_pos", "end_pos", "sentence")}
        for call, text, abbreviations in zip(*(b.column(c).to_pylist() for c in ("call_id", "text", "abbreviations"))):
            for k, (x, y) in enumerate(units(text, known, spelled(abbreviations))):
                for name, v in zip(out, (call, k, x, y, text[x:y])):
                    out[name].append(v)
        return out

    own = spread(calls.where(F.col("text").isNotNull()).select("call_id", "project_id", "text", "extra_abbreviations"))
    with_words = with_config(own, configs, F.col("extra_abbreviations").alias("of_project"))
    none = F.array().cast("array<string>")
    words = F.concat(F.coalesce("extra_abbreviations", none), F.coalesce("of_project", none))
    return map_rows(with_words.select("call_id", "text", words.alias("abbreviations")), batch, "call_id bigint, unit_no int, start_pos bigint, end_pos bigint, sentence string")


def starts(calls: DataFrame, configs: DataFrame) -> DataFrame:
    """``(call_id, start_pos)`` of each unit but the first of its text."""
    return sentence_units(calls, configs).where(F.col("unit_no") > 0).select("call_id", "start_pos").distinct()
