"""Problem 2: questions whose answers are empty, cut off, refused, copied or in another language."""

from __future__ import annotations

import bisect
import heapq
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_blank

#: What stands for no answer, without brackets and outer punctuation, in lower case.
PLACEHOLDERS = ["none", "null", "n/a", "na", "nan", "nil", "undefined", "empty", "no answer", "no response", "keine antwort", "leer", "sans réponse", "pas de réponse", "vide", "sin respuesta", "vacío", "ninguna", "tbd", "todo"]
#: Function words that one of the four languages uses often and the others don't; they label the rows that the profiles are fitted on.
LANGUAGE_WORDS = {
    "en": "the is and of for if with what which how does do should can my at are be to after before that this when only it its has was were from or not by why where between under each both no there then",
    "de": "der die das und ist nicht wie welche warum wenn sie den dem ein eine auf für nach bei am zum wird muss ich was gilt aus auch ohne mit von einer des im ja nein bis nur zu zur oder sich",
    "fr": "le les des et est pas sur quand quelle pourquoi comment dans pour une du au il faut vous à avec après même sans ce cette ces ou où qui aux votre ne oui non soit doit être quoi",
    "es": "el los las y está del cómo qué por para cuando una con después sin lo hasta más al ya sí sea entre según queda tiene unos puede o su",
}
LANGUAGES = sorted(LANGUAGE_WORDS)
#: Rows whose letters fit the language profiles (the first by hash), and the cells of a profile.
FIT_ROWS, CELLS = 20_000, 1 << 15
#: Share of all cells that were never seen, and signs up to which a profile counts for little.
UNSEEN, FEW_SIGNS = 0.02, 1000
#: Function words that label a text for fitting.
LEAST_WORDS = 3
#: Letters and blanks of an answer from which its language is judged by letters.
LEAST_SIGNS = 10
#: By how much (natural logarithm) the answer's letters must speak for another language than the question's, and the question's for its own.
ANSWER_MARGIN, QUESTION_MARGIN = 6.0, 1.5
#: How each language declines, and how it takes leave without saying more.
REFUSES = (
    r"\b(?:can(?:'|’)?t|cannot|can not|unable to|not able to|won(?:'|’)t be able|must decline|(?:have|had) to decline|must refuse|rather not|outside what i may|no answer can be given|not (?:allowed|permitted) to|don(?:'|’)t feel able)\b"
    r"|\b(?:nicht (?:helfen|beantworten|eingehen|möglich|sagen)|keine (?:auskunft|antwort|hilfe)|muss ich (?:leider )?(?:ablehnen|passen)|ablehnen)\b"
    r"|\b(?:ne (?:peux|puis|suis) pas|dois (?:refuser|décliner)|sort de ce que|préfère ne pas|impossible de répondre|aucune réponse ne peut)\b"
    r"|\b(?:no puedo|debo (?:rechazar|declinar)|fuera de lo que puedo|prefiero no|no me es posible|no se puede dar)"
)
TAKES_LEAVE = (
    r"\b(?:sorry|apolog\w+|thanks?|unfortunately|please ask|ask your|contact|anything else|help you|is there)\b|\b(?:tut mir leid|leider|danke|bitte|fragen sie|kann ich sonst|sonst noch)\b"
    r"|\b(?:désolé\w*|malheureusement|merci|adressez|autre chose|souhaitez)\b|(?:\b(?:lo siento|gracias|consulte|desgracia|desea saber)\b|\balgo más\b)"
)
#: Words of an introduction that may stand before a copied question.
INTRODUCTION_WORDS = 8


def _sentences(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"(?<=[.!?…])\s+|\n+"), lambda s: F.length(F.trim(s)) > 0)


def is_refusal(sentences: Column) -> Column:
    """Some sentence declines, and each sentence that doesn't takes leave; a sentence with a figure says something."""
    declines = lambda s: s.rlike(f"(?i){REFUSES}") & ~s.rlike(r"\d")
    leaves = lambda s: s.rlike(f"(?i){TAKES_LEAVE}") & ~s.rlike(r"\d")
    return F.forall(sentences, lambda s: declines(s) | leaves(s)) & F.exists(sentences, declines)


def is_empty(answer: Column) -> Column:
    """Null, blank, without letters and digits, or a placeholder, whatever signs stand around it."""
    core = F.regexp_replace(F.lower(answer), r"^[^\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+$", "")
    return is_blank(answer) | ~answer.rlike(r"[\p{L}\p{Nd}]") | core.isin(*PLACEHOLDERS)


_OTHERS = re.compile(r"[\W\d_]+")
_LANGUAGE_SETS = [frozenset(LANGUAGE_WORDS[x].split()) for x in LANGUAGES]


def _cells(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The cells of the runs of three letters and word ends of all texts, laid end to end, and where each text begins."""
    padded = [f" {_OTHERS.sub(' ', t.lower()).strip()} " for t in texts]
    signs = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(t) for t in padded])
    mixed = (signs[:-2] * np.uint64(1_000_003) + signs[1:-1]) * np.uint64(1_000_003) + signs[2:]
    cells = ((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)
    return np.concatenate([cells, [0, 0]]), np.cumsum(sizes) - sizes


def language_scores(texts: list[str], profiles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log probability of each text's letters under each language (texts x languages), and how many signs these are."""
    cells, starts = _cells(texts)
    return np.stack([np.add.reduceat(profile[cells], starts) for profile in profiles], axis=1), np.diff(starts, append=len(cells)) - 2


def language_profiles(feedback: DataFrame, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Log probabilities of the cells for each language, fitted on a bounded sample: fit_rows rows, the first by hash.

    A text is labelled by its function words, LEAST_WORDS at least and twice as many as any other language's; at most
    CELLS numbers a language come to the driver.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((len(LANGUAGES), CELLS), dtype=np.int64)
        for batch in batches:
            texts = [t for c in ("question", "answer") for t in batch[c] if t]
            for t in texts:
                words = _OTHERS.sub(" ", t.lower()).split()
                votes = [sum(w in known for w in words) for known in _LANGUAGE_SETS]
                best, second = sorted(votes)[-1], sorted(votes)[-2]
                if best >= LEAST_WORDS and best >= 2 * second:
                    np.add.at(counts[votes.index(best)], _cells([t])[0][:-2], 1)
        lang, cell = np.nonzero(counts)
        yield pd.DataFrame({"lang": lang, "cell": cell, "n": counts[lang, cell]})

    sample = feedback.select("feedback_id", "question", "answer").orderBy(F.xxhash64("feedback_id"), "feedback_id").limit(fit_rows).select("question", "answer")
    rows = sample.mapInPandas(run, "lang int, cell int, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(LANGUAGES), CELLS))
    counts[rows["lang"], rows["cell"]] = rows["n"]
    return log_shares(counts)


def log_shares(counts: np.ndarray) -> np.ndarray:
    """Log shares of the cells of each language; what was never seen has the same small share in all, however much was counted,
    and a language of which little was seen speaks softly."""
    return np.log(counts / (counts.sum(axis=1, keepdims=True) + FEW_SIGNS) + UNSEEN / CELLS)


@lru_cache(maxsize=10_000)
def _script(sign: str) -> str:
    """The script of a letter, by the first word of its Unicode name."""
    return unicodedata.name(sign, "?").split(" ")[0].split("-")[0]


def script_of(text: str) -> str | None:
    """The script of most letters; None for fewer than four letters."""
    if text.isascii():
        return "LATIN" if sum(c.isalpha() for c in text) >= 4 else None
    found = Counter(_script(c) for c in text if c.isalpha())
    return max(found, key=lambda k: (found[k], k)) if found.total() >= 4 else None


def other_languages(questions: list[str], answers: list[str], profiles: np.ndarray) -> np.ndarray:
    """Whether each answer is written in another language than its question: by its letters, or by its script."""
    if not questions:
        return np.zeros(0, dtype=bool)
    (q, _), (a, signs) = language_scores(questions, profiles), language_scores(answers, profiles)
    own, other, rows = q.argmax(axis=1), a.argmax(axis=1), np.arange(len(q))
    letters = (own != other) & (signs >= LEAST_SIGNS) & (a[rows, other] - a[rows, own] >= ANSWER_MARGIN) & (q[rows, own] - q[rows, other] >= QUESTION_MARGIN)
    scripts = [False if x.isascii() and y.isascii() else None not in (pair := (script_of(x), script_of(y))) and pair[0] != pair[1] for x, y in zip(questions, answers, strict=True)]
    return letters | np.array(scripts, dtype=bool)


_TOKEN = re.compile(r"[^\W_]+")
_SIGN = re.compile(r"```|<(/?)([a-z][a-z0-9]*)(?:\s[^<>]*)?>|[()\[\]{}“”„«»\"]", re.I)
_OPENS = {"(": ")", "[": "]", "{": "}", "„": "“", "«": "»", '"': '"', "“": "”"}
_QUANTITY = re.compile(r"[-+≈~]?\d+(?:[.,]\d+)?\s?\S{0,4}|\w+")
_ITEM = re.compile(r"\s*([-*•]|\d+[.)])(?:\s+(.*))?$")
_VOID = {"br", "hr", "img", "input", "meta", "link"}
_FENCE, _LISTED = "```", "item"


def parsed(text: str) -> tuple[list[str], list[tuple[str, str]]]:
    """A pushdown parser: what is still open where the text stops, innermost last, and the items of the list that is open.

    One stack holds fences, brackets, quotations, elements and list items. A fence hides all else; an element's end closes
    what was left open inside it; an item is closed by the next item or by another line that isn't blank.
    """
    stack: list[str] = []
    items: list[tuple[str, str]] = []
    for line in text.split("\n"):
        if line.strip() and _FENCE not in stack:
            item = _ITEM.match(line)
            if stack and stack[-1] == _LISTED:
                stack.pop()
            if item:
                items.append((item.group(1), (item.group(2) or "").strip()))
                stack.append(_LISTED)
            elif not line.startswith((" ", "\t")):
                items = []
        for m in _SIGN.finditer(line):
            sign, name = m.group(), (m.group(2) or "").lower()
            if sign == _FENCE:
                if _FENCE in stack:
                    while stack.pop() != _FENCE:
                        pass
                else:
                    stack.append(_FENCE)
            elif _FENCE in stack:
                continue
            elif name:
                if m.group(1):
                    if f"<{name}" in stack:
                        while stack.pop() != f"<{name}":
                            pass
                elif name not in _VOID:
                    stack.append(f"<{name}")
            elif stack and sign == stack[-1]:
                stack.pop()
            elif sign in _OPENS:
                stack.append(_OPENS[sign])
    return stack, items


def open_at_end(text: str) -> bool:
    """Whether a fence, bracket, quotation or element is still open where the text stops."""
    return any(x != _LISTED for x in parsed(text)[0])


def _item_shape(body: str) -> list[str]:
    """The parts of a list item in order: words, colon, number, unit, end mark."""
    label, colon, value = body.rpartition(":") if re.search(r":\s*\S", body) else (body, "", "")
    shape = ["words"] if label.strip() else []
    if colon:
        number = re.match(r"\s*\d+(?:[.,]\d+)?", value)
        shape += ["colon", *(["number", *["unit"] * bool(value[number.end() :].strip(" .!?"))] if number else ["words"])]
    return shape + ["end"] * bool(re.search(r"[.!?)\]»”\"]$", body))


def _item_stops(items: list[tuple[str, str]]) -> bool:
    """The last item has less than one before it: its shape is a beginning of theirs."""
    own, others = _item_shape(items[-1][1]), [_item_shape(b) for _, b in items[:-1]]
    return own not in others and any(len(own) < len(x) and x[: len(own)] == own for x in others)


def is_truncated(text: str) -> bool:
    """The text stops inside a sentence, bracket, list item or code block."""
    stack, items = parsed(text)
    if any(x != _LISTED for x in stack):
        return True
    end = text.rstrip()
    if not end or end.endswith(_FENCE):
        return False
    last = end[end.rfind("\n") + 1 :].strip()
    if stack:
        marker, body = items[-1]
        if not body or body.endswith(":"):
            return True
        if marker in "-*•":
            return _item_stops(items)
        last = body
    if re.search(r"https?://\S{6,}$|www\.\S+$", last):
        return False
    if re.search(r"(?:…|\.\.\.)$", last):
        return True
    if re.search(r"[.!?。！？؟][)\]\"'’”“»*_]*$", last):
        return False
    if re.search(r"[)\]»”“\"]$", last) and re.search(r"[.!?]", last):
        return False
    return not _QUANTITY.fullmatch(last)


class _Automaton:
    """The suffix automaton of a list of words: for each place of another list the longest run of words that ends there in both."""

    def __init__(self, words: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.size, self.end = [-1], [0], [-1]
        last = 0
        for i, w in enumerate(words):
            now = self._add({}, self.size[last] + 1, i)
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = now
                p = self.link[p]
            if p < 0:
                self.link[now] = 0
            else:
                q = self.next[p][w]
                if self.size[q] == self.size[p] + 1:
                    self.link[now] = q
                else:
                    twin = self._add(dict(self.next[q]), self.size[p] + 1, self.end[q])
                    self.link[twin] = self.link[q]
                    while p >= 0 and self.next[p].get(w) == q:
                        self.next[p][w] = twin
                        p = self.link[p]
                    self.link[q] = self.link[now] = twin
            last = now

    def _add(self, edges: dict[str, int], size: int, end: int) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.size.append(size)
        self.end.append(end)
        return len(self.next) - 1

    def runs(self, words: list[str]) -> list[tuple[int, int]]:
        """For each place its longest run and where that ends in the words of the automaton."""
        out, state, n = [], 0, 0
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.size[state]
            if w in self.next[state]:
                state, n = self.next[state][w], n + 1
            else:
                n = 0
            out.append((n, self.end[state]))
        return out


def tiles(q: list[str], a: list[str], least: int) -> tuple[list[bool], list[bool]]:
    """Greedy string tiling: which words of q the tiles cover, and which of a; the longest common runs are laid first.

    Words of q may be covered again, those of a once. A run that meets a tile keeps what is left of it and waits for its turn.
    """
    covered, used = [False] * len(q), [False] * len(a)
    ends = _Automaton(q).runs(a)
    waiting = [(-n, j - n + 1, j) for j, (n, _) in enumerate(ends) if n >= least]
    heapq.heapify(waiting)
    laid: list[int] = []
    while waiting:
        n, start, j = heapq.heappop(waiting)
        if used[j]:
            continue
        before = bisect.bisect_right(laid, j)
        free = laid[before - 1] + 1 if before else 0
        if free > start:
            if j - free + 1 >= least:
                heapq.heappush(waiting, (free - j - 1, free, j))
            continue
        used[start : j + 1] = [True] * -n
        covered[ends[j][1] + n + 1 : ends[j][1] + 1] = [True] * -n
        bisect.insort(laid, j)
    return covered, used


def is_copy(question: str, answer: str) -> bool:
    """The answer is the question: tiles lie over all its words but one at most, once or more, and besides the answer has an
    introduction at most. The same rule holds for any length."""
    q, a = _TOKEN.findall(question.lower()), _TOKEN.findall(answer.lower())
    known = set(q)
    if not q or len(a) < max(1, len(q) - 1) or not all(map(known.__contains__, a[INTRODUCTION_WORDS:])):
        return False
    covered, used = tiles(q, a, 2 if len(q) > 2 else 1)
    at = {w: i for i, w in reversed(list(enumerate(q)))}
    for j, w in enumerate(a):
        if not used[j] and w in at and any(used[max(0, j - 1) : j + 2]):
            used[j] = covered[at[w]] = True
    if covered.count(False) > (1 if len(q) > 2 else 0) or not any(used):
        return False
    first = used.index(True)
    return first <= INTRODUCTION_WORDS and all(used[first:])


def _shape(question: Column, answer: Column, profiles: np.ndarray) -> Column:
    """copied, truncated, other_language or null, by tiling, parser and letters, in batches."""

    @F.pandas_udf("string")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for questions, answers in parts:
            other = other_languages(list(questions), list(answers), profiles)
            yield pd.Series(["copied" if is_copy(q, a) else "truncated" if is_truncated(a) else "other_language" if o else None for q, a, o in zip(questions, answers, other, strict=True)], dtype=object)

    return run.asNondeterministic()(question, answer)  # else the filter behind it would run it a second time


def defective_pairs(feedback: DataFrame) -> DataFrame:
    """feedback_id, question, answer, rating, defect of every row; defect is null where the answer is sound.

    The defect is the first of empty, copied or refusal, truncated, other_language. A null or blank question is never a
    case; a null answer is empty; repeated rows count each; an empty table gives an empty result; other columns are ignored.
    """
    rows = feedback.where(~is_blank(F.col("question"))).select("feedback_id", "question", "answer", "rating")
    rows = rows.withColumn("shape", _shape(F.col("question"), F.coalesce("answer", F.lit("")), language_profiles(feedback)))
    rows = rows.withColumn("first", F.when(is_empty(F.col("answer")), "empty").when(is_refusal(_sentences(F.col("answer"))), "refusal"))
    defect = F.coalesce(F.when(F.col("first") == "empty", "empty"), F.when(F.col("shape") == "copied", "copied"), F.col("first"), F.col("shape"))
    return rows.select("feedback_id", "question", "answer", "rating", defect.alias("defect"))


def found(feedback: DataFrame) -> DataFrame:
    return defective_pairs(feedback).where("defect is not null").select("feedback_id", "defect")
