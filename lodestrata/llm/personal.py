"""Problem 9: personal information in free text, found and replaced by typed placeholders."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed, join_checked

PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "identity_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}
#: A span counts from this score on.
LEAST_SCORE = 1.0

_CAP = r"A-ZÀ-ÖØ-Þ"
_WORD = rf"[{_CAP}][\w'’]+(?:-[{_CAP}][\w'’]+)*"
_AT = r"(?:\s?@\s?|\s?[\[({]\s?at\s?[\])}]\s?)"
_DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?)"
EMAIL = re.compile(rf"[\w.+%-]*\w{_AT}[\w-]+(?:{_DOT}[\w-]+)*{_DOT}[A-Za-z]{{2,}}(?![\w@])|[\w.+%-]*\w\s+at\s+[\w-]+(?:\s+dot\s+[\w-]+)*\s+dot\s+[A-Za-z]{{2,}}\b")
#: What every address but a written-out one holds, and the words before it; the written-out one.
_SIGN_AT = re.compile(r"@|[\[({]\s?at\s?[\])}]")
_BEFORE_AT = re.compile(r"[\w.+%-]*\w\s?$")
_WORD_DOT = re.compile(r"\sdot\s")
#: Where a number can be: a run of the signs that the forms below are made of, with two digits at least.
_RUN = re.compile(r"[+(]?[A-Z0-9](?:[A-Z0-9+().,/-]| (?=[A-Z0-9+(/]))*[0-9)](?:[A-Z0-9+()./-]| (?=[A-Z0-9+(/]))*")
#: Written forms of telephone numbers and the score that the form alone has.
PHONES = [
    (re.compile(r"(?<![\w.+])\+\d{1,3}(?:[ .-]?\(0\)[ .-]?|[ .-])?\(?\d{1,4}\)?(?:[ .-]?\d{1,10}){1,5}(?![\w-])"), 1.0),
    (re.compile(r"(?<![\w.+)])\(\d{2,5}\) ?\d{3,4}[ .-]\d{3,4}(?![\w-])"), 1.0),
    (re.compile(r"(?<![\w.+-])1-\d{3}-\d{3}-\d{4}(?![\w-])"), 1.0),
    (re.compile(r"(?<![\w.+-])\d{3}([.-])\d{3}\1\d{4}(?![\w-])"), 1.0),
    (re.compile(r"(?<![\w.+-])0\d(?:[ .]\d\d){4}(?![\w-]| \d)"), 1.0),
    (re.compile(r"(?<![\w.+-])0\d{2,4} \d{3,4} \d{4}(?![\w-])"), 1.0),
    (re.compile(r"(?<![\w.+-])0\d{2,4}[ /]\d{4,6}[ -]\d{2,4}(?![\w-])"), 1.0),
    (re.compile(r"(?<![\w.+-])0\d{2,4}[ /-]?\d{6,8}(?![\w-])"), 0.5),
]
#: Written forms of identity numbers and the score that the form alone has.
IDENTITIES = [
    (re.compile(r"(?<![\w-])[A-Z]{2}(?: \d\d){3} [A-Z](?![\w-])"), 0.6),
    (re.compile(r"(?<![\w-])\d{8}-?[A-Z](?![\w-])"), 0.6),
    (re.compile(r"(?<![\w-])[A-Z]\d[A-Z]\d{5}(?![\w-])"), 0.4),
    (re.compile(r"(?<![\w-])\d{3}([- ])\d{2}\1\d{4}(?![\w-])"), 0.5),
    (re.compile(r"(?<![\w.-])\d{4}\.\d{3}\.\d{3}(?![\w.-]\d)"), 0.5),
    (re.compile(r"(?<![\w-])(?:\d{4}([ -]?)\d{4}\1\d{4}\1\d{1,7})(?![\w-])"), 0.3),
    (re.compile(r"(?<![\w-])[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\w-])"), 0.3),
    (re.compile(r"(?<![\w.-])\d{8,12}(?![\w-])"), 0.2),
    (re.compile(r"(?<![\w-])(?=[A-Z0-9]*\d[A-Z0-9]*\d)[A-Z0-9]{6,12}(?![\w-])"), 0.2),
]
#: Words before a number that speak for, or against, a person's identity number.
FOR_IDENTITY = re.compile(
    r"(?:passport|passeport|pasaporte|reisepass\w*|ausweis\w*|licen[cs]e|führerschein\w*|permis(?: de conduire)?|national id|identity(?: card)?|id[_ ]card|carte (?:d['’]identité|vitale|bancaire)|documento de identidad|carn[eé]t?|dni|nie|social security|insurance|versicher\w+|sécurité sociale|seguridad social|seguro|assuran\w+|(?:credit|debit|bank) ?card|kreditkarte|tarjeta|iban|tax id)"
    r"[\s:=#(]*(?:(?:card|number|nummer|numéro|número|no|nr|n)\b[.°º]?|n[°º]\.?)?[\s:=#(]*$",
    re.I,
)
AGAINST_IDENTITY = re.compile(r"(?<!\w)(?:serial|serien\w*|série|serie|order|ticket|drawing|part|frame|batch|lot|firmware|version|port|invoice|rev)\.?(?: (?:number|id|no))?[\s:=#(.]*$", re.I)
#: Words of streets in the four languages.
_TOWN = rf"[{_CAP}][\w'’]+(?:-[{_CAP}][\w'’]+)*"
_POST = r"(?:\d{5}|[A-Z]{1,2}\d{1,2}[A-Z]? \d[A-Z]{2})"
ADDRESSES = [
    re.compile(rf"(?<![\w-])(?:(?:Unit|Flat|Suite|Apt\.?) \d+[A-Za-z]?, |\d{{1,5}}[A-Za-z]? )(?:[NSEW]\. )?{_WORD}(?:[ ]{_WORD}){{0,4}}\.?(?:, (?:Suite|Unit|Flat|Apt\.?) \d+[A-Za-z]?)?, {_TOWN}(?: {_TOWN}){{0,2}},? {_POST}(?!\w)"),
    re.compile(rf"(?<!\w)(?:Calle|Plaza|Avda\.?|Avenida|Paseo|Camino|Carrera|C/)(?: [\wáéíóúñ.]+){{1,6}}? ?\d+[a-z]?(?:, ?[\d.ºª]+ ?[A-Z\wº]{{0,4}}\.?)?, \d{{5}} {_TOWN}"),
    re.compile(rf"(?<![\w-])\d{{1,5}}(?: bis| ter)?,? (?:rue|quai|allée|avenue|place|boulevard|chemin|impasse|cours|route)(?: [\w'’éèêàçîô-]+){{1,6}}?, \d{{5}} {_TOWN}"),
    re.compile(rf"(?<![\w-])(?:(?:Am|An der|Im|In der|Hinterm|Auf dem|Zum|Zur|Alte|Alter|Neue) )?[{_CAP}][\wäöüß]+(?:-[{_CAP}][\wäöüß]+)*\.? \d{{1,4}} ?[a-z]?, (?:D-)?\d{{5}} {_TOWN}"),
]
#: Titles, and words that begin with a capital before a name without belonging to it.
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "herr", "herrn", "frau", "mme", "mlle", "monsieur", "madame", "sr", "sra", "srta", "señor", "señora", "don", "doña"}
NOT_GIVEN = TITLES | {"dear", "el", "la", "los", "las", "the", "le", "les", "hello", "hi", "hallo", "liebe", "lieber", "bonjour", "hola", "cher", "chère", "contact", "call", "regards", "saludo", "grüßen", "cordialement", "mail", "from", "to", "by", "for", "photo", "pickup", "visitor", "our", "please", "unit", "suite", "der", "die", "das", "un", "une", "una", "m"}


#: What every address ends in: a postcode, before or behind a town.
_POSTCODE = re.compile(r"\d(?:\d{4}(?!\d)|[A-Z]? \d[A-Z]{2}(?!\w))")


def luhn(number: str) -> bool:
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return len(digits) >= 13 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def mod97(number: str) -> bool:
    flat = re.sub(r"\s", "", number).upper()
    return bool(re.fullmatch(r"[A-Z]{2}\d\d[A-Z0-9]{8,30}", flat)) and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


#: Forms that a checksum decides: groups of four digits of a card, and the beginning of an account number.
_CARD, _ACCOUNT = re.compile(r"\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}"), re.compile(r"[A-Z]{2}\d\d(?: [A-Z0-9]{1,4}){3,}")


def _checked(number: str) -> float:
    """What the checksums add: they confirm a number, and refuse one that is written as a card or account but fails."""
    if luhn(number) or mod97(number):
        return 0.8
    return -2.0 if _CARD.fullmatch(number) or _ACCOUNT.fullmatch(number) else 0.0


Span = tuple[str, int, int, float, str, str]


def _emails(text: str) -> Iterator[re.Match]:
    """The matches of EMAIL, looked for only where its sign stands."""
    if _WORD_DOT.search(text):
        yield from EMAIL.finditer(text)
        return
    done = 0
    for sign in _SIGN_AT.finditer(text):
        at, reach = sign.start(), 64
        if at < done:
            continue
        local = _BEFORE_AT.search(text, max(done, at - reach), at)
        while local and local.start() == at - reach > done:
            reach *= 4
            local = _BEFORE_AT.search(text, max(done, at - reach), at)
        found = EMAIL.match(text, local.start()) if local else None
        if found:
            yield found
            done = found.end()


def _numbers(text: str) -> Iterator[Span]:
    """Identity numbers and telephone numbers: form, checksum and the words before make the score.

    Forms are tried only on the runs of signs that numbers are made of.
    """
    for run in _RUN.finditer(text):
        lo, hi = run.start(), run.end()
        digits = sum(map(run.group().count, "0123456789"))
        if hi - lo < 6 or digits < 2:
            continue
        for pattern, score in IDENTITIES:
            for m in pattern.finditer(text, lo, hi + 3):
                before = text[max(0, m.start() - 45) : m.start()]
                score_here = score + 1.0 * bool(FOR_IDENTITY.search(before)) - 1.0 * bool(AGAINST_IDENTITY.search(before)) + _checked(m.group())
                if score_here >= LEAST_SCORE:
                    yield "identity_number", m.start(), m.end(), score_here + 1, "", ""
        for pattern, score in PHONES if digits >= 8 else ():
            for m in pattern.finditer(text, lo, hi + 3):
                if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                    before = text[max(0, m.start() - 30) : m.start()]
                    score_here = score + 0.5 * bool(re.search(r"(?:tel|call|phone|fax|voice|on|au|al|unter|mobile|llame a|rückruf)\W*$", before, re.I)) - 1.0 * bool(AGAINST_IDENTITY.search(before) or FOR_IDENTITY.search(before))
                    if score_here >= LEAST_SCORE:
                        yield "phone", m.start(), m.end(), score_here, "", ""


_NAME_TOKEN = re.compile(rf"(?<![\w'’-])(?:{_WORD}|[{_CAP}]\.)(?!\w)")


def _names(text: str, given: frozenset[str]) -> Iterator[Span]:
    """Names with a known given name or a title count at once; others carry the words that the lexicon must know."""
    tokens = [(m.group(), m.start(), m.end()) for m in _NAME_TOKEN.finditer(text)]
    for i, (word, start, end) in enumerate(tokens):
        j, gap_at = i + 1, end
        while j < len(tokens) and tokens[j][0][1] == "." and text[gap_at : tokens[j][1]] in (" ", ""):
            gap_at, j = tokens[j][2], j + 1
        initial = word[1] == "."
        if j < len(tokens) and text[gap_at : tokens[j][1]] == " " and tokens[j][0][1] != ".":
            last, _, stop = tokens[j]
            french = word == "M." and bool(re.match(r"\s+a\s", text[stop:]))
            if word.lower() in given:
                yield "name", start, stop, 3.0, "", ""
            elif initial and not french:
                yield "name", start, stop, 0.75, last.lower(), ""
            elif not initial and word.lower() not in NOT_GIVEN:
                yield "name", start, stop, 0.8, last.lower(), ""
        if not initial and text[end : end + 2] == ", " and i + 1 < len(tokens) and tokens[i + 1][1] == end + 2:
            other, _, stop = tokens[i + 1]
            if other[1] == "." or other.lower() in given:
                yield "name", start, stop, 0.95, word.lower(), ""
            elif other.lower() not in NOT_GIVEN:
                yield "name", start, stop, 0.7, word.lower(), other.lower()
        if not initial:
            before = re.search(r"(\w+)\.?\s$", text[max(0, start - 12) : start])
            french = bool(re.search(r"(?<!\w)M\. $", text[max(0, start - 4) : start])) and bool(re.match(r"\s+a\s", text[end:]))
            if before and before.group(1)[0].isupper() and before.group(1).lower() in TITLES or french:
                if word.lower() not in given and not (j < len(tokens) and text[gap_at : tokens[j][1]] == " " and tokens[j][0][1] != "."):
                    yield "name", start, end, 1.1, "", ""


def proposed(text: str, given: frozenset[str]) -> list[Span]:
    """Spans of one text without overlaps; of spans that overlap the one with the highest score, then the longest, stays."""
    found: list[Span] = [("email", m.start(), m.end(), 5.0, "", "") for m in _emails(text)]
    for pattern in ADDRESSES if _POSTCODE.search(text) else ():
        found += [("address", m.start(), m.end(), 4.0, "", "") for m in pattern.finditer(text)]
    found += _numbers(text)
    kept: list[Span] = []
    taken: list[tuple[int, int]] = []
    for span in sorted(found, key=lambda s: (-s[3], s[1] - s[2], s[1])):
        if _free(taken, span):
            kept.append(span)
            bisect.insort(taken, span[1:3])
    return kept + [s for s in _names(text, given) if _free(taken, s)]


def _free(taken: list[tuple[int, int]], span: Span) -> bool:
    """Whether a span overlaps none of the sorted, disjoint ones."""
    at = bisect.bisect_left(taken, (span[1], span[1]))
    return not (at < len(taken) and taken[at][0] < span[2] or at and taken[at - 1][1] > span[1])


def proposals(documents: DataFrame, given_names: DataFrame) -> DataFrame:
    """doc_id, kind, start, stop, found_text, score, surname, given of every proposed span.

    given_names is the fixed list (a few rows), sent to the tasks; all else is worked out a document at a time.
    """
    given = frozenset(r.given_name.lower() for r in given_names.where("given_name is not null").select("given_name").distinct().toLocalIterator())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, *s, t[s[1] : s[2]]) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for s in proposed(t, given)]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "start", "stop", "score", "surname", "given", "found_text"])

    return documents.where("text is not null").select("doc_id", "text").mapInPandas(run, "doc_id bigint, kind string, start int, stop int, score double, surname string, given string, found_text string")


def _parts(name: Column) -> Column:
    return F.split(F.lower(name), "-")


def lexicon(documents: DataFrame, given_names: DataFrame) -> DataFrame:
    """word, role ('surname' or 'given') of the names that the corpus itself shows.

    Surnames are the words after known given names; further given names are the words before these surnames.
    """
    pair = rf"([{_CAP}][\p{{L}}'’]+)(?: [{_CAP}]\.)? ([{_CAP}][\p{{L}}'’]+(?:-[{_CAP}][\p{{L}}'’]+)*)"
    text = F.col("text")
    pairs = documents.where("text is not null").select(F.explode(F.regexp_extract_all(text, F.lit(pair), F.lit(0))).alias("pair")).select(F.lower(F.regexp_extract("pair", pair, 1)).alias("given"), F.explode(_parts(F.regexp_extract("pair", pair, 2))).alias("surname")).where("length(surname) > 3").groupBy("given", "surname").agg(F.count(F.lit(1)).alias("n"))
    pairs = checkpointed(pairs)
    known = given_names.where("given_name is not null").select(F.lower("given_name").alias("given")).distinct()
    surnames = pairs.join(known, "given", "left_semi").select("surname").distinct()
    more = pairs.join(surnames, "surname", "left_semi").where(~F.col("given").isin(*sorted(NOT_GIVEN))).select("given").distinct()
    return surnames.select(F.col("surname").alias("word"), F.lit("surname").alias("role")).unionByName(more.select(F.col("given").alias("word"), F.lit("given").alias("role")))


def personal_spans(documents: DataFrame, given_names: DataFrame) -> DataFrame:
    """doc_id, kind, start, stop, found_text of the spans that count, without overlaps between names.

    Null and blank texts give no rows; an empty list of given names leaves names after titles; repeated documents count
    by their doc_id; other columns are ignored.
    """
    all_spans = checkpointed(proposals(documents, given_names))
    sure = all_spans.where(F.col("score") >= LEAST_SCORE).select("doc_id", "kind", "start", "stop", "score", "found_text")
    words = checkpointed(lexicon(documents, given_names))
    surnames = words.where("role = 'surname'").select(F.col("word").alias("part"))
    givens = words.where("role = 'given'").select(F.col("word").alias("given"))
    open_ = all_spans.where(F.col("score") < LEAST_SCORE).withColumn("part", F.explode(_parts(F.col("surname"))))
    known = join_checked(open_, surnames, ["part"], "left_semi", salt_by="doc_id").drop("part").distinct()
    plain = known.where("given = ''")
    turned = join_checked(known.where("given != ''"), givens, ["given"], "left_semi", salt_by="doc_id")
    names = plain.unionByName(turned).select("doc_id", "kind", "start", "stop", (F.col("score") + 1).alias("score"), "found_text")
    return _apart(sure.unionByName(names))


def _apart(spans: DataFrame) -> DataFrame:
    """Of spans of one document that overlap, the one with the highest score, then the longest, then the first.

    Only runs of spans that touch one another are compared, so a long document with many spans stays cheap.
    """
    order = Window.partitionBy("doc_id").orderBy("start", "stop")
    rows = spans.distinct().withColumn("reach", F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    runs = rows.withColumn("run", F.sum(F.when(F.col("start") < F.col("reach"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    entry = F.struct((-F.col("score")).alias("a"), (F.col("start") - F.col("stop")).alias("b"), "start", "stop", "kind", "found_text")
    grouped = runs.groupBy("doc_id", "run").agg(F.sort_array(F.collect_set(entry)).alias("all"))
    free = lambda kept, x: ~F.exists(kept, lambda k: (x["start"] < k["stop"]) & (x["stop"] > k["start"]))
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    return grouped.select("doc_id", F.explode(kept).alias("s")).select("doc_id", "s.kind", "s.start", "s.stop", "s.found_text")


def personal_items(documents: DataFrame, given_names: DataFrame) -> DataFrame:
    """doc_id, kind, found_text: each distinct item once."""
    return personal_spans(documents, given_names).select("doc_id", "kind", "found_text").distinct()


def redacted(documents: DataFrame, given_names: DataFrame) -> DataFrame:
    """doc_id, text with each span replaced by its placeholder and the rest unchanged; a null text stays null."""
    kinds = F.create_map(*[F.lit(x) for pair in PLACEHOLDERS.items() for x in pair])
    spans = personal_spans(documents, given_names).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop", kinds[F.col("kind")].alias("mark")))).alias("spans"))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, s: F.struct(F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), s["mark"]).alias("out"), s["stop"].alias("at"))
    done = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1)))
    return documents.select("doc_id", "text").join(spans, "doc_id", "left").select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(done).alias("text"))
