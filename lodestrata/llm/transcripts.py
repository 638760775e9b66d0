"""Problem 5: timed transcript cues into clean, ordered turns of known speakers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import before, checkpointed, join_checked

#: Seconds of a video that are ordered together; longer videos are split and joined again.
PART_SECONDS = 300
#: Cue ids that are ordered together where the start is missing.
PART_CUES = 5000
#: Cues from which the tagger is fitted: the first by hash, so the same at any partitioning; rounds of the fit.
FIT_CUES, FIT_ROUNDS = 20_000, 6
#: Occurrences that the prior of the tagger counts for.
PRIOR = 20
STATES = ["speaker", "timestamp", "annotation", "filler", "speech"]
#: Sounds that fill a pause, in the four languages.
FILLER = re.compile(r"(?:u+h*m*|u+h+|e+r+m*|e+h+m*|ä+h*m*|ä+h+|h+m+|m+h*m+|a+h+|e+u+h+|e+h+|ö+h*m*|pff+|ahem|este|mhm)", re.I)
_CLOCK = r"\d{1,2}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?"
_TOKENS = re.compile(rf"<v(?:\.\S+)? [^>]*>|<[^>]*>|\[[^\]]*\]|\([^)]*\):?|\{{[^}}]*\}}|♪[^♪]*♪?|\*[^*\s][^*]*\*|>>+|(?<!\w)(?:speaker|spk|sprecher|locuteur|orador|hablante)[ _#-]?\d+\s?:?|{_CLOCK}(?!\w)|\S+", re.I)
_NUMBERED = re.compile(r"(?:speaker|spk|sprecher|locuteur|orador|hablante)[ _#-]?0*(\d+)", re.I)
_BARE = re.compile(r"^[^\w]+|[^\w.]+$")
_CLOCK_TOKEN = re.compile(rf"[\[(<{{]?\s*{_CLOCK}\s*[\])>}}]?")
_PLAIN = re.compile(r"[^\W\d_]{2,}[.,]?")


@lru_cache(maxsize=200_000)
def _plain_core(token: str) -> str | None:
    """The word of a token that can only be a word or a name; None for all that has to be looked at."""
    core = token.rstrip(".,").lower()
    return core if _PLAIN.fullmatch(token) and not FILLER.fullmatch(core) else None


@lru_cache(maxsize=4096)
def aliases(names: tuple[tuple[int, str], ...]) -> tuple[dict[str, int], frozenset[str]]:
    """Spellings of the speakers of one video, without those that two share, and the words they are made of."""
    found: dict[str, set[int]] = {}
    for no, name in names:
        words = (name or "").lower().split()
        if not words:
            continue
        first, last = words[0], words[-1]
        for spelling in (" ".join(words), first, last, f"{last}, {first}", f"{last} {first}", f"{first[0]}. {last}", f"{first} {last[0]}."):
            found.setdefault(spelling, set()).add(no)
    table = {s: next(iter(nos)) for s, nos in found.items() if len(nos) == 1}
    return table, frozenset(w for s in found for w in s.replace(",", "").split() if len(w) > 1)


def speaker_of(label: str, names: tuple[tuple[int, str], ...]) -> int | None:
    """The speaker a label means, whatever brackets, marks and roles stand around the name."""
    text = re.sub(r"^<v(?:\.\S+)?\s+", "", label.strip(), flags=re.I).replace("<", " ").replace(">", " ")
    text = re.sub(r"(?<=\w)\s*\((?:[^)]*)\)", " ", text)
    text = re.sub(r"\s+", " ", re.sub(r"[\[\](){}]", " ", text)).strip(" -:–—")
    numbered = _NUMBERED.fullmatch(text)
    if numbered:
        return int(numbered.group(1)) if int(numbered.group(1)) in {no for no, _ in names} else None
    return aliases(names)[0].get(re.sub(r"\s*,\s*", ", ", text.lower()))


def observed(line: str, names: tuple[tuple[int, str], ...]) -> list[tuple[str, str]]:
    """The tokens of a line, each with the class of what is seen."""
    words = aliases(names)[1]
    out: list[tuple[str, str]] = []
    for m in _TOKENS.finditer(line):
        t = m.group()
        core = _plain_core(t)
        if core is not None and core not in words:
            out.append((t, "word"))
            continue
        core = _BARE.sub("", t).lower()
        if _CLOCK_TOKEN.fullmatch(t):
            kind = "clock"
        elif t[0] in "[(<{" and t[-1] in "])>}:" and len(t) > 2:
            if t[-1] == ":" and out and out[-1][1] in ("name", "tag"):
                kind = "role"
            elif t[:2].lower() == "<v" or speaker_of(t, names) is not None:
                kind = "tag"
            elif out and out[-1][1] == "name" and re.match(r"\s*[:–—-]", line[m.end() :]):
                kind = "role"
            else:
                kind = "word" if re.search(r"\d", t) else "note"
        elif t[0] == "♪" or t[0] == "*" and t[-1] == "*" and len(t) > 2:
            kind = "note"
        elif set(t) == {">"} or t in ("-", "–", "—") and not out:
            kind = "arrow"
        elif t in (":", "-", "–", "—"):
            kind = "sep"
        elif _NUMBERED.fullmatch(t.rstrip(": ")):
            kind = "namec" if t.rstrip().endswith(":") else "name"
        elif len(core) == 2 and core[1] == "." and not (t[0].isupper() and _BARE.sub("", line[m.end() :].strip().split(" ")[0]).lower() in words):
            kind = "word"
        elif core and t[-1] not in "?!;" and (core in words or core.rstrip(".") in words and t[-1] != "."):
            kind = "namec" if t.endswith(":") else "name"
        elif FILLER.fullmatch(core.strip(".")) and not (core.strip(".") == "mm" and out and re.search(r"\d$", out[-1][0])):
            kind = "filler"
        else:
            kind = "word"
        out.append((t, kind))
    return out


#: What some classes mean by themselves; names, roles, arrows and signs between them mean a speaker or belong to what is said.
CLEAR = {"clock": "timestamp", "note": "annotation", "tag": "speaker", "filler": "filler", "word": "speech", "namec": "speaker"}
_OPEN = ("speaker", "speech")
AHEAD, BACK = ["namec", "sep", "role", "word", "end"], ["start", "name", "namec", "tag", "arrow", "role", "other"]


def symbols(kinds: tuple[str, ...]) -> tuple[str, ...]:
    """What the model sees of each token: its class and, where that is open, the next class that isn't a name and, for signs and roles, the class before."""
    out = []
    for i, k in enumerate(kinds):
        if k in CLEAR:
            out.append(k)
            continue
        ahead = next((x for x in kinds[i + 1 :] if x != "name"), "end")
        seen = f"{k} {ahead if ahead in AHEAD else 'word'}"
        if k in ("sep", "role"):
            seen += f" {'start' if i == 0 else kinds[i - 1] if kinds[i - 1] in BACK else 'other'}"
        out.append(seen)
    return tuple(out)


def _all_symbols() -> list[str]:
    return [*CLEAR, *(f"{k} {a}" for k in ("name", "arrow") for a in AHEAD), *(f"{k} {a} {b}" for k in ("sep", "role") for a in AHEAD for b in BACK)]


class Tagger:
    """A hidden Markov model over what is seen of the tokens of a line; clear classes have their one label.

    counts holds the expected starts, steps and observations. To them comes a prior of PRIOR occurrences, for corpora of a few
    lines: what stands before a sign or role that ends a label leans to the label, anything else to what is said.
    """

    def __init__(self, counts: dict[tuple[str, str, str], float]):
        self.seen = {x: i for i, x in enumerate(_all_symbols())}
        self.start = self._share(np.array([counts.get(("start", s, ""), 0.0) for s in STATES]))
        self.step = self._share(np.array([[counts.get(("step", a, b), 0.0) for b in STATES] for a in STATES]))
        leans = {o: "speaker" if o.split(" ")[1] in ("namec", "sep", "role") or o.startswith(("sep", "role")) else "speech" for o in self.seen if o not in CLEAR}
        self.look = self._share(np.array([[counts.get(("look", a, o), 0.0) + PRIOR * (leans.get(o) == a) for o in self.seen] for a in STATES]))
        may = np.array([[CLEAR.get(o.split(" ")[0], s) == s and (o in CLEAR or s in _OPEN) for o in self.seen] for s in STATES])
        self.look = self.look * may
        with np.errstate(divide="ignore"):
            self.logs = np.log(self.start), np.log(self.step), np.log(self.look)

    @staticmethod
    def _share(n: np.ndarray) -> np.ndarray:
        return (n + 0.1) / (n + 0.1).sum(axis=-1, keepdims=True)

    def decode(self, kinds: tuple[str, ...]) -> tuple[str, ...]:
        """The most likely labels (Viterbi)."""
        if not kinds:
            return ()
        start, step, look = self.logs
        at = [self.seen[x] for x in symbols(kinds)]
        score, back = start + look[:, at[0]], []
        for o in at[1:]:
            ways = score[:, None] + step
            back.append(ways.argmax(axis=0))
            score = ways.max(axis=0) + look[:, o]
        path = [int(score.argmax())]
        for best in reversed(back):
            path.append(int(best[path[-1]]))
        return tuple(STATES[i] for i in reversed(path))

    def expected(self, sequences: Iterator[tuple[str, int]]) -> dict[tuple[str, str, str], float]:
        """Expected counts over sequences of symbols (joined by |) and how often each occurs (forward and backward pass)."""
        starts, steps, looks = np.zeros(len(STATES)), np.zeros((len(STATES),) * 2), np.zeros(self.look.shape)
        for joined, n in sequences:
            at = [self.seen[x] for x in joined.split("|")]
            emit = self.look[:, at].T
            forward, scale = np.zeros(emit.shape), np.zeros(len(at))
            for i, e in enumerate(emit):
                forward[i] = (forward[i - 1] @ self.step if i else self.start) * e
                scale[i] = forward[i].sum()
                forward[i] /= scale[i]
            later = np.ones(len(STATES))
            looks[:, at[-1]] += n * forward[-1]
            for i in range(len(at) - 2, -1, -1):
                ahead = emit[i + 1] * later / scale[i + 1]
                steps += n * forward[i][:, None] * self.step * ahead[None, :]
                later = self.step @ ahead
                looks[:, at[i]] += n * forward[i] * later
            starts += n * forward[0] * later
        out = {("start", s, ""): starts[i] for i, s in enumerate(STATES)}
        out |= {("step", a, b): steps[i, j] for i, a in enumerate(STATES) for j, b in enumerate(STATES)}
        out |= {("look", a, o): looks[i, j] for i, a in enumerate(STATES) for o, j in self.seen.items()}
        return {k: float(v) for k, v in out.items() if v > 0}


def segments(lines: list[str], names: tuple[tuple[int, str], ...], decode) -> list[tuple[int | None, bool, str]]:
    """What a cue holds in order: (speaker, says something, words); the first speaker is None where the last label still holds."""
    out: list[tuple[int | None, bool, str]] = [(None, False, "")]
    for line in lines:
        seen = observed(line, names)
        labels = decode(tuple(k for _, k in seen))
        i = 0
        while i < len(seen):
            if labels[i] == "speaker":
                j = i
                while j < len(seen) and labels[j] == "speaker" and not (j > i and seen[j][1] in ("tag", "arrow")):
                    j += 1
                no = speaker_of(" ".join(t for t, k in seen[i:j] if k != "arrow"), names)
                if no is not None:
                    out.append((no, False, ""))
                else:
                    said = " ".join(t for t, k in seen[i:j] if k in ("name", "word", "namec"))
                    if said and seen[i][1] not in ("tag",):
                        out[-1] = (out[-1][0], True, f"{out[-1][2]} {said}".strip())
                i = j
                continue
            if labels[i] == "speech" and re.search(r"\w", seen[i][0]):
                out[-1] = (out[-1][0], True, f"{out[-1][2]} {seen[i][0]}".strip())
            i += 1
    return out


def fresh_cues(cues: DataFrame) -> DataFrame:
    """video_id, part, start, cue_id, lines: each cue once, with the lines that the cue before doesn't have."""
    once = cues.where("video_id is not null").groupBy("video_id", "start_seconds", "end_seconds", "text").agg(F.min("cue_id").alias("cue_id"))
    rows = once.select("video_id", F.coalesce(F.floor(F.col("start_seconds") / PART_SECONDS), F.floor(F.col("cue_id") / PART_CUES) - F.lit(1 << 50)).alias("part"), F.coalesce("start_seconds", F.lit(-1.0)).alias("start"), "cue_id", F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), F.trim), lambda x: x != "").alias("lines"))
    return before(rows, "video_id", "lines", "shown", ["start", "cue_id"]).select("video_id", "part", "start", "cue_id", F.filter("lines", lambda x: ~F.coalesce(F.array_contains("shown", x), F.lit(False))).alias("lines"))


def with_names(cues: DataFrame, speakers: DataFrame) -> DataFrame:
    """Cues with the speakers of their video."""
    of_video = speakers.where("video_id is not null and speaker_no is not null").groupBy("video_id").agg(F.sort_array(F.collect_set(F.struct("speaker_no", "display_name"))).alias("names"))
    return join_checked(cues, of_video, ["video_id"], "left", salt_by="cue_id")


def _pairs(names) -> tuple[tuple[int, str], ...]:
    return tuple((int(x["speaker_no"]), x["display_name"] or "") for x in names) if names is not None else ()


def fitted(named: DataFrame, fit_cues: int = FIT_CUES, rounds: int = FIT_ROUNDS) -> dict[tuple[str, str, str], float]:
    """Expected counts of starts, steps and observations, fitted by expectation maximisation on a bounded sample (fit_cues cues, the first by hash).

    No token is labelled beforehand but those of a clear class: what names, signs, roles and arrows mean is learnt from
    where they stand. Equal sequences are counted first; each round is a pass over these, of which a few hundred numbers come back.
    """

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kinds = (tuple(k for _, k in observed(line, _pairs(names))) for lines, names in zip(batch["lines"], batch["names"], strict=True) for line in lines)
            yield pd.DataFrame({"seen": ["|".join(symbols(k)) for k in kinds if k]}, dtype=object)

    sample = named.orderBy(F.xxhash64("video_id", "cue_id"), "cue_id").limit(fit_cues).select("lines", "names")
    sequences = checkpointed(sample.mapInPandas(seen, "seen string").groupBy("seen").agg(F.count(F.lit(1)).alias("n")))
    counts: dict[tuple[str, str, str], float] = {}
    for _ in range(rounds):
        tagger = Tagger(counts)

        def count(batches: Iterator[pd.DataFrame], tagger: Tagger = tagger) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = tagger.expected(zip(batch["seen"], batch["n"], strict=True))
                yield pd.DataFrame([(*k, v) for k, v in found.items()], columns=["kind", "a", "b", "n"])

        rows = sequences.mapInPandas(count, "kind string, a string, b string, n double").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
        counts = {(r.kind, r.a, r.b): r.n for r in rows}
    return counts


def spoken(cues: DataFrame, speakers: DataFrame, fit_cues: int = FIT_CUES) -> DataFrame:
    """video_id, part, start, cue_id, i, speaker_no, words: what each speaker says, in order; words before any label have no row."""
    named = checkpointed(with_names(fresh_cues(cues), speakers))
    counts = fitted(named, fit_cues)

    @F.pandas_udf("array<struct<no:int,says:boolean,words:string>>")
    def parse(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        tagger = Tagger(counts)
        decode = lru_cache(maxsize=50_000)(tagger.decode)
        for all_lines, all_names in parts:
            yield pd.Series([[{"no": n, "says": s, "words": w} for n, s, w in segments(list(x), _pairs(y), decode)] for x, y in zip(all_lines, all_names, strict=True)], dtype=object)

    parsed = checkpointed(named.select("video_id", "part", "start", "cue_id", parse("lines", "names").alias("segs")))
    labelled = parsed.withColumn("label", F.try_element_at(F.filter(F.transform("segs", lambda s: s["no"]), lambda n: n.isNotNull()), F.lit(-1)))
    held = before(labelled, "video_id", "label", "held", ["start", "cue_id"])
    rows = held.select("video_id", "part", "start", "cue_id", "held", F.posexplode("segs").alias("i", "s"))
    return rows.where("s.says").select("video_id", "part", "start", "cue_id", "i", F.coalesce("s.no", "held").alias("speaker_no"), F.col("s.words").alias("words")).where("speaker_no is not null")


def turn_starts(cues: DataFrame, speakers: DataFrame, fit_cues: int = FIT_CUES) -> DataFrame:
    """video_id, first_cue_id, speaker_no of each turn.

    Null and empty texts say nothing; repeated cues count once; equal starts are ordered by cue_id; cues without start come
    first; videos without speakers have no turns; empty tables give an empty result; other columns are ignored.
    """
    said = checkpointed(spoken(cues, speakers, fit_cues))
    last = before(said, "video_id", "speaker_no", "previous", ["start", "cue_id", "i"])
    return last.where(F.col("previous").isNull() | (F.col("previous") != F.col("speaker_no"))).select("video_id", F.col("cue_id").alias("first_cue_id"), "speaker_no").distinct()


def turns(cues: DataFrame, speakers: DataFrame, fit_cues: int = FIT_CUES) -> DataFrame:
    """video_id, first_cue_id, speaker_no, text: the words of each turn, one row a turn; parts are joined in order."""
    said = checkpointed(spoken(cues, speakers, fit_cues))
    order = ["start", "cue_id", "i"]
    last = before(said, "video_id", "speaker_no", "previous", order)
    opens = last.withColumn("opens", F.when(F.col("previous").isNull() | (F.col("previous") != F.col("speaker_no")), F.struct(*order)))
    current = checkpointed(before(opens, "video_id", "opens", "opened", order).withColumn("turn", F.coalesce("opens", "opened")))
    words = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, "words"))), lambda x: x["words"]), " ")
    parts = current.groupBy("video_id", "turn", "speaker_no", "part").agg(words.alias("text"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), " ")
    return parts.groupBy("video_id", "turn", "speaker_no").agg(whole.alias("text")).select("video_id", F.col("turn.cue_id").alias("first_cue_id"), "speaker_no", "text")
