"""Problem 3: noise in the text of scanned pages, found and repaired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import before, checkpointed, join_checked
from .common import is_blank

#: Filled lines at the top and at the bottom of a page where a running header or page number stands: what recurs further inside is
#: body (searching all lines gave 566 more rows at sf0.1, body lines and lists, and none of the rest).
TOP_LINES, BOTTOM_LINES = 2, 3
#: Pages, and share of a source's pages, on which a header or a count of page numbers must show.
MIN_PAGES, MIN_SHARE, NUMBER_SHARE = 2, 0.25, 0.05
#: A form is misread if another with the same skeleton is so many times as frequent, and found so often.
TIMES, MIN_COUNT = 8, 5
#: The same for spellings with a sign inside that no word has.
ODD_TIMES, ODD_COUNT = 1, 3
#: The same where no neighbour supports the form.
ALONE_TIMES = 8
#: Occurrences from which a word counts as known.
KNOWN = 3
#: Pages of a source that are ordered together.
PART_PAGES = 500
#: Signs that stand for a hyphen at the end of a line.
HYPHENS = "-~­‐‑¬_"
#: Words after which a hyphen is one of its own (two- or three-core).
JOINING = ["and", "or", "to", "und", "oder", "bis", "et", "ou", "y", "o", "e", "u", "i", "a", "sowie", "nor", "but"]
#: Glyphs that are taken for one another, as one sign each; m, n, u and w are spelt out by _skeleton.
CONFUSED = ("l1!|jceft@0q59hb86$", "iiiiieettaoosgbbbbs")

_LETTER = r"\p{L}\p{N}@!|"
_N = r"[0-9OoIl|SBZ]{1,6}"


def skeleton(word: Column) -> Column:
    """Words that glyph confusion can turn into one another have the same skeleton.

    Letters are spelt out by the strokes they are split into (m as rn, n as ri, u as ii, w as vv), then each group of
    confusable glyphs becomes one sign; so the mapping of a misread word is that of the right one.
    """
    text = F.lower(word)
    for letter, strokes in (("w", "vv"), ("m", "rn"), ("n", "ri"), ("u", "ii")):
        text = F.replace(text, F.lit(letter), F.lit(strokes))
    return F.translate(text, *CONFUSED)


def _roman(n: int) -> str:
    out = ""
    for value, sign in ((900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out, n = out + sign * (n // value), n % value
    return out


def page_form(text: Column) -> Column:
    """A struct of the way a page number is written and its value; null if it isn't one."""
    number = lambda x: F.translate(x, "OoIl|SBZ", "00111582").cast("int")
    ways = {
        "dash": rf"^[-–—]\s?({_N})\s?[-–—]$",
        "of": rf"^[\p{{L}}0-9@!]{{3,9}}\.?\s({_N})\s(?:of|ot|von|vori|de|dc|sur|/)\s?{_N}$",
        "dot": rf"^[\p{{L}}á]{{1,5}}\.\s?({_N})$",
        "word": rf"^(?i:page|seite|página|pagina|folio)\s({_N})$",
        "bracket": rf"^[\[(]\s?({_N})\s?[\])]$",
        "slash": rf"^({_N})\s?/\s?{_N}$",
        "plain": rf"^({_N})$",
    }
    romans = F.create_map(*[F.lit(x) for n in range(1, 1000) for x in (_roman(n), n)])
    picked = [F.when(text.rlike(p), F.struct(F.lit(k).alias("way"), number(F.regexp_extract(text, p, 1)).alias("n"))) for k, p in ways.items()]
    picked.append(F.when(romans[F.lower(text)].isNotNull(), F.struct(F.lit("roman").alias("way"), romans[F.lower(text)].alias("n"))))
    return F.coalesce(*picked)


def header_form(text: Column) -> Column:
    return skeleton(F.regexp_replace(F.lower(F.trim(text)), r"(?<![\p{L}@!|0-9])[0-9][0-9oil|]*(?![\p{L}@!])", "#"))


def scanned_pages(chunks: DataFrame) -> DataFrame:
    """point_id, src, page, part and lines of the pdf text chunks."""
    rows = chunks.where("source_type = 'pdf' and content_type = 'text' and text is not null")
    return rows.select("point_id", F.xxhash64("source").alias("src"), F.coalesce("page", F.lit(0)).alias("page"), F.coalesce("chunk_index", F.lit(0)).alias("part"), F.split("text", "\n", -1).alias("lines"))


def edges(pages: DataFrame) -> DataFrame:
    """One row for each piece (parted by two spaces) of the lines at the top and bottom of a page."""
    filled = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("line_no"), x.alias("line"))), lambda s: ~is_blank(s["line"]))
    picked = F.array_distinct(F.concat(F.slice("filled", 1, TOP_LINES), F.slice("filled", F.greatest(F.size("filled") - BOTTOM_LINES + 1, F.lit(1)), BOTTOM_LINES)))
    rows = pages.select("point_id", "src", "page", filled.alias("filled")).where(F.size("filled") > 0).select("point_id", "src", "page", F.explode(picked).alias("e"))
    pieces = rows.select("point_id", "src", "page", "e.line_no", F.explode(F.split(F.trim("e.line"), r"\s{2,}")).alias("piece")).where("piece != ''")
    return pieces.select("*", page_form(F.col("piece")).alias("number"), header_form(F.col("piece")).alias("form"))


def headers_and_numbers(pages: DataFrame) -> DataFrame:
    """point_id, line_no, kind (header or page_number), by what repeats over the pages of a source.

    Page numbers of a source are those whose value less the page is the same on several pages; headers are pieces whose
    form with masked digits is. Pages are made distinct before they are counted, so no source or line is gathered.
    """
    found = checkpointed(edges(pages))
    count = F.count(F.lit(1))
    total = pages.select("src", "page").distinct().groupBy("src").agg(count.alias("pages"))
    numbers = found.where("number is not null").select("point_id", "line_no", "src", "page", F.col("number.way").alias("way"), (F.col("number.n") - F.col("page")).alias("shift"))
    votes = numbers.select("src", "way", "shift", "page").distinct().groupBy("src", "way", "shift").agg(count.alias("n"))
    firm = F.col("way").isin("dash", "of", "dot", "slash", "word")
    kept = votes.join(total, "src").where(((F.col("n") >= MIN_PAGES) & (F.col("n") >= F.col("pages") * NUMBER_SHARE)) | ((F.col("pages") <= 2) & firm)).select("src", "way", "shift")
    page_numbers = checkpointed(join_checked(numbers, kept, ["src", "way", "shift"], "left_semi", salt_by="point_id").select("point_id", "line_no", F.lit("page_number").alias("kind")).distinct())
    named = found.where("number is null").where(F.length(F.regexp_replace("form", r"[^\p{L}]", "")) >= 4)
    repeated = named.select("src", "form", "page").distinct().groupBy("src", "form").agg(count.alias("n"))
    enough = F.greatest(F.lit(MIN_PAGES), F.least(F.lit(MIN_PAGES + 1), F.floor(F.col("pages") / 2)))
    forms = repeated.join(total, "src").where((F.col("n") >= enough) & (F.col("n") >= F.col("pages") * MIN_SHARE)).select("src", "form")
    headers = join_checked(named, forms, ["src", "form"], "left_semi", salt_by="point_id").select("point_id", "line_no", F.lit("header").alias("kind")).distinct()
    return page_numbers.unionByName(headers)


#: Fixed value: signs cut off at both ends of a word.
_PUNCTUATION = ".,;:()[]{}\"'’‘„“”«»…?%/\\¿¡§–—°+=*<>#&" + HYPHENS


#: Of these the ones that may be dropped anywhere in a line.
_AROUND = ".,;:()[]{}\"„“”«»…?%¿¡"


def _bare(word: Column) -> Column:
    return F.btrim(word, F.lit(_PUNCTUATION))


def _mark(line: Column) -> Column:
    """The hyphen that a letter at the end of the line is followed by; empty if there is none."""
    end = F.right(F.rtrim(line), F.lit(2))
    return F.when(end.rlike(rf"^[\p{{L}}@!|0-9][{HYPHENS}]$"), F.right(end, F.lit(1))).otherwise("")


def is_table_row(line: Column) -> Column:
    return F.trim(line).rlike(r"\S {2,}\S.* {2,}\S")


def running_lines(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """point_id, line_no, line, whether it goes on from a broken word, and the first word of the running line that follows
    (next_point, next_no, next), also on the next page.

    Within a page lines follow by position; across pages through a join on (source, page), never a sorted source.
    """
    gone = marks.groupBy("point_id").agg(F.collect_set("line_no").alias("gone"))
    numbered = F.transform("lines", lambda x, i: F.struct(i.alias("no"), x.alias("line")))
    body = F.filter(numbered, lambda s: ~is_blank(s["line"]) & ~F.coalesce(F.array_contains("gone", s["no"]), F.lit(False)))
    flagged = F.transform(body, lambda s: F.struct(s["no"].alias("no"), s["line"].alias("line"), is_table_row(s["line"]).alias("table")))
    rows = checkpointed(pages.dropDuplicates(["point_id"]).join(gone, "point_id", "left").select("point_id", "src", "page", "part", flagged.alias("body")))
    prose = lambda body: F.filter(body, lambda s: ~s["table"])
    begun = rows.select("src", "page", "part", "point_id", F.try_element_at(prose(F.col("body")), F.lit(1)).alias("s")).where("s is not null").select("src", "page", "part", F.struct("point_id", "s.no", F.substring_index(F.ltrim("s.line"), " ", 1).alias("word")).alias("p"))
    heads = begun.groupBy("src", "page").agg(F.min_by("p", F.struct("part", "p")).alias("h"))
    parts = begun.where("part > 0").withColumn("part", F.col("part") - 1).groupBy("src", "page", "part").agg(F.min("p").alias("p"))
    after = heads.select("src", (F.col("page") - 1).alias("page"), "h")
    joined = rows.join(after, ["src", "page"], "left").join(parts, ["src", "page", "part"], "left")
    joined = joined.select("point_id", "body", F.coalesce("p", "h").alias("beyond"))
    follows = lambda i: F.try_element_at(prose(F.slice("body", i + 2, F.size("body"))), F.lit(1))
    before = lambda i: F.when(i > 0, F.try_element_at("body", F.greatest(i, F.lit(1)))["line"])
    entry = lambda s, i: F.struct(s["no"].alias("no"), s["line"].alias("line"), before(i).alias("before"), follows(i).alias("f"))
    each = joined.select("point_id", "beyond", F.explode(F.transform("body", entry)).alias("s"))
    own = F.col("s.f").isNotNull()
    return each.select(
        "point_id",
        F.col("s.no").alias("line_no"),
        F.col("s.line").alias("line"),
        (_mark(F.coalesce("s.before", F.lit(""))) != "").alias("continued"),
        F.when(own, F.col("point_id")).otherwise(F.col("beyond.point_id")).alias("next_point"),
        F.when(own, F.col("s.f.no")).otherwise(F.col("beyond.no")).alias("next_no"),
        F.when(own, F.substring_index(F.ltrim("s.f.line"), " ", 1)).otherwise(F.col("beyond.word")).alias("next"),
    )


def broken_words(lines: DataFrame) -> DataFrame:
    """Lines with a next one: left and right piece, the sign between them ('' where there is none), alone if left is the line."""
    last = F.substring_index(F.rtrim("line"), " ", -1)
    rows = lines.where("next is not null").select("point_id", "line_no", "next_point", "next_no", last.alias("last"), _bare(last).alias("left"), _mark(F.col("line")).alias("mark"), _bare(F.col("next")).alias("right"), (~F.trim("line").contains(" ")).alias("alone"))
    ends = F.right("last", F.lit(1)).rlike(rf"[{HYPHENS}{_LETTER}]")
    return rows.where(ends & F.col("left").rlike(r"\p{L}") & F.col("right").rlike(r"^[\p{L}@!|0-9]*\p{L}")).drop("last")


def word_counts(lines: DataFrame) -> DataFrame:
    """word (lower case), n over all running lines, without the pieces of broken words."""
    words = F.split(F.trim("line"), " ")
    inner = F.when(F.col("continued"), F.slice(words, 2, F.size(words))).otherwise(words)
    rows = lines.select(F.explode(inner).alias("w"), (_mark(F.col("line")) != "").alias("broken"), F.substring_index(F.rtrim("line"), " ", -1).alias("last"))
    counted = rows.where(~(F.col("broken") & (F.col("w") == F.col("last")))).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(F.lower(_bare(F.col("w"))).alias("word")).agg(F.sum("n").alias("n")).where(F.length("word") > 1)


def misread_forms(words: DataFrame) -> DataFrame:
    """word, form, form_n, n, odd: spellings that may be misread and the forms of their skeleton that they may stand for.

    A form is a spelling of letters that isn't itself misread by the same rule: none of its skeleton is TIMES as frequent.
    So a word meets the few forms at the top of its skeleton, however many misreadings recur.
    """
    keyed = words.where(F.col("word").rlike(r"\p{L}.*\p{L}")).withColumn("skeleton", skeleton(F.col("word")))
    clean = keyed.where(F.col("word").rlike(r"^[\p{L}'’.-]+$") & (F.length("word") > 1) & (F.col("n") >= ODD_COUNT))
    most = clean.groupBy("skeleton").agg(F.max("n").alias("most"))
    forms = clean.join(most, "skeleton").where(F.col("n") * TIMES > F.col("most")).select("skeleton", F.col("word").alias("form"), F.col("n").alias("form_n"))
    pairs = keyed.join(forms, "skeleton").select("word", "n", "form", "form_n", F.col("word").rlike(r"[0-9@!|]").alias("odd"))
    rare = (F.col("form_n") >= MIN_COUNT) & (F.col("form_n") >= TIMES * F.col("n"))
    return pairs.where((F.col("word") != F.col("form")) & (rare | F.col("odd") & (F.col("form_n") >= ODD_TIMES * F.col("n"))))


def _words(line: Column) -> Column:
    """The words of a line in lower case, marks that stand around words dropped."""
    return F.split(F.translate(F.lower(F.trim(line)), _AROUND, ""), " ")


def misread_words(lines: DataFrame, words: DataFrame) -> DataFrame:
    """point_id, line_no, i, word, form of the misread words: the form that the neighbours support best.

    A spelling of letters alone counts only if its neighbours stand at the form at least as often as at the spelling; where
    they stand at neither form nor other lines, the form must be much the more frequent. Only pairs of neighbours that a
    candidate needs are counted, over all lines.
    """
    rows = lines.select("point_id", "line_no", _words(F.col("line")).alias("ws"))
    at = lambda i: F.coalesce(F.try_element_at("ws", i), F.lit(""))
    entry = lambda x, i: F.struct(x.alias("word"), F.when(i > 0, at(F.greatest(i, F.lit(1)))).otherwise("").alias("l"), at(i + 2).alias("r"))
    tokens = rows.select("point_id", "line_no", F.posexplode(F.transform("ws", entry)).alias("i", "e")).select("point_id", "line_no", "i", "e.word", "e.l", "e.r")
    forms = misread_forms(words)
    found = join_checked(tokens, forms, ["word"], "inner", salt_by="point_id")
    found = checkpointed(found.select("point_id", "line_no", "i", "word", "n", "form", "form_n", "odd", "l", "r"))
    sides = [F.struct(F.lit(w).alias("of"), F.xxhash64(*pair).alias("pair")) for w in ("form", "word") for pair in (("l", w), (w, "r"))]
    sides = found.where("not odd").select("point_id", "line_no", "i", "form", F.explode(F.array(*sides)).alias("s")).select("point_id", "line_no", "i", "form", "s.of", "s.pair")
    asked = sides.select("pair").distinct()
    beside = F.explode(F.arrays_zip(F.col("ws").alias("a"), F.slice("ws", 2, F.size("ws")).alias("b"))).alias("p")
    all_pairs = rows.select("point_id", beside).select("point_id", F.xxhash64("p.a", "p.b").alias("pair"))
    counts = checkpointed(join_checked(all_pairs, asked, ["pair"], "left_semi", salt_by="point_id").groupBy("pair").agg(F.count(F.lit(1)).alias("c")))
    seen = join_checked(sides, counts, ["pair"], "inner", salt_by="point_id").groupBy("point_id", "line_no", "i", "form").agg(F.sum(F.when(F.col("of") == "form", F.col("c")).otherwise(0)).alias("support"), F.sum(F.when(F.col("of") == "word", F.col("c")).otherwise(0)).alias("against"))
    judged = found.join(seen, ["point_id", "line_no", "i", "form"], "left").na.fill(0, ["support", "against"])
    elsewhere = F.col("against") - 2  # both pairs of the candidate itself count against it
    supported = (F.col("support") >= elsewhere) & ((F.col("support") > 0) | (F.col("form_n") >= ALONE_TIMES * F.col("n")))
    kept = judged.where(F.col("odd") | supported)
    return kept.groupBy("point_id", "line_no", "i", "word").agg(F.max_by("form", F.struct("support", "form_n", "form")).alias("form"))


def noisy_lines(chunks: DataFrame) -> DataFrame:
    """point_id, line_no, kind (header, page_number, hyphen, ocr) of the noisy lines of pdf text chunks.

    Null texts and pages without lines give no rows; a null page counts as page 0; chunks stored twice count once; an empty
    table gives an empty result; other columns are ignored.
    """
    pages = scanned_pages(chunks)
    marks = checkpointed(headers_and_numbers(pages))
    lines = checkpointed(running_lines(pages, marks))
    words = checkpointed(word_counts(lines))
    known = checkpointed(words.where(F.col("n") >= KNOWN))
    hyphens = checkpointed(hyphenated(lines, known, words))
    return marks.unionByName(hyphens.select("point_id", "line_no", F.lit("hyphen").alias("kind"))).unionByName(misread_lines(lines, words, hyphens)).distinct()


def hyphenated(lines: DataFrame, known: DataFrame, words: DataFrame) -> DataFrame:
    """Broken words: point_id, line_no, next_point, next_no, left, right."""
    pairs = checkpointed(broken_words(lines))
    marked = pairs.where("mark != ''")
    own = (F.col("mark") == "-") & F.lower("right").isin(*JOINING)
    joined = join_checked(marked.where(own).withColumn("word", F.lower(F.concat("left", "right"))), known.select("word"), ["word"], "left_semi", salt_by="point_id").drop("word")
    sure = marked.where(~own & F.col("right").rlike(r"^[\p{Ll}@!|0-9]"))
    capital = marked.where(~own & ~F.col("right").rlike(r"^[\p{Ll}@!|0-9]")).withColumn("word", F.lower(F.concat("left", "right")))
    compound = capital.withColumn("word", F.lower(F.concat("left", F.lit("-"), "right")))
    capitals = join_checked(capital.unionByName(compound), words.select("word"), ["word"], "left_semi", salt_by="point_id").drop("word")
    unmarked = unmarked_breaks(pairs.where("mark = ''"), known, words)
    return sure.unionByName(joined).unionByName(capitals).drop("mark", "alone").unionByName(unmarked).distinct()


def unmarked_breaks(pairs: DataFrame, known: DataFrame, words: DataFrame) -> DataFrame:
    """Pairs without a sign that make a known word, of which a piece is no word: rare elsewhere beside the whole.

    Elsewhere are the places other than line ends without a sign and the starts that follow them, where the pieces of breaks
    stand; so the judgement is the same however many breaks and pages there are.
    """
    bare = pairs.withColumn("word", F.lower(F.concat("left", "right")))
    whole = checkpointed(join_checked(bare, known.select("word", F.col("n").alias("whole_n")), ["word"], "inner", salt_by="point_id").drop("word"))
    asked = checkpointed(whole.select(F.explode(F.array(F.lower("left"), F.lower("right"))).alias("word")).distinct())
    ends = pairs.select("point_id", "line_no", F.when(F.col("alone"), "start").otherwise("end").alias("place"), F.lower("left").alias("word"))
    starts = pairs.select(F.col("next_point").alias("point_id"), F.col("next_no").alias("line_no"), F.lit("start").alias("place"), F.lower("right").alias("word"))
    beside = join_checked(ends.unionByName(starts), asked, ["word"], "left_semi", salt_by="point_id").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("beside"))
    elsewhere = asked.join(words, "word", "left").join(beside, "word", "left").select("word", (F.coalesce("n", F.lit(0)) - F.coalesce("beside", F.lit(0))).alias("n"))
    elsewhere = checkpointed(elsewhere)
    judged = whole
    for side in ("left", "right"):
        judged = join_checked(judged.withColumn("word", F.lower(side)), elsewhere.withColumnRenamed("n", f"{side}_n"), ["word"], "inner", salt_by="point_id").drop("word")
    no_word = lambda side: (F.length(side) > 1) & (F.col("whole_n") >= TIMES * F.col(f"{side}_n"))
    return judged.where(no_word("left") | no_word("right")).select("point_id", "line_no", "next_point", "next_no", "left", "right")


def misread_joins(words: DataFrame, hyphens: DataFrame) -> DataFrame:
    """The broken words whose pieces make a misread word, with its form; pieces in lower case."""
    best = words.where((F.col("n") >= MIN_COUNT) & F.col("word").rlike(r"^[\p{L}'’.-]+$")).withColumn("skeleton", skeleton(F.col("word"))).groupBy("skeleton").agg(F.max(F.struct("n", "word")).alias("b")).select("skeleton", F.col("b.word").alias("form"))
    parts = hyphens.withColumn("left", F.lower("left")).withColumn("right", F.lower("right")).withColumn("skeleton", skeleton(F.concat("left", "right")))
    return join_checked(parts, best, ["skeleton"], "inner", salt_by="point_id").where(F.concat("left", "right") != F.col("form"))


def misread_lines(lines: DataFrame, words: DataFrame, hyphens: DataFrame) -> DataFrame:
    """point_id, line_no, kind ocr: lines with a misread word, whole or broken over two lines."""
    whole = misread_words(lines, words).select("point_id", "line_no")
    pairs = misread_joins(words, hyphens)
    on_left = pairs.where(~F.col("form").startswith(F.col("left"))).select("point_id", "line_no")
    on_right = pairs.where(~F.col("form").endswith(F.col("right"))).select(F.col("next_point").alias("point_id"), F.col("next_no").alias("line_no"))
    return whole.unionByName(on_left).unionByName(on_right).select("point_id", "line_no", F.lit("ocr").alias("kind"))


def _cased(form: Column, like: Column) -> Column:
    """The form with the capitals of the word it stands for."""
    return F.when(like.rlike(r"^\p{Lu}+$"), F.upper(form)).when(like.rlike(r"^\p{Lu}"), F.concat(F.upper(F.left(form, F.lit(1))), F.substr(form, F.lit(2)))).otherwise(form)


def _goes_on(line: Column) -> Column:
    """A line of prose, four words or more, that ends no sentence."""
    return ~line.rlike(r"[.!?:…][\"'”»)\]]*\s*$") & (F.size(F.split(F.trim(line), " ")) >= 4) & ~line.rlike(r"^\s*(?:[-*•–]|\d+[.)])\s")


def over_pages(pieces: DataFrame, pages: DataFrame) -> DataFrame:
    """point_id, paragraph_no, text: the paragraphs of pages, with what goes on at the top of the next page joined to its beginning.

    Pages stand in the order of their source, worked out in parts of PART_PAGES pages; a part hands on one row.
    """
    at = ["page", "part_no", "point_id"]
    edge = pieces.groupBy("point_id").agg(F.min("paragraph_no").alias("first_no"), F.max("paragraph_no").alias("last_no"), F.min_by("first_line", "paragraph_no").alias("top"), F.max_by("last_line", "paragraph_no").alias("bottom"))
    placed = pages.select("point_id", "src", "page", F.col("part").alias("part_no")).dropDuplicates(["point_id"])
    edge = edge.join(placed, "point_id").withColumn("part", F.floor(F.col("page") / PART_PAGES))
    edge = before(edge, "src", F.struct("page", "part_no", _goes_on(F.col("bottom")).alias("open")), "last", at)
    follows = (F.col("last.page") + 1 == F.col("page")) | (F.col("last.page") == F.col("page")) & (F.col("last.part_no") + 1 == F.col("part_no"))
    edge = checkpointed(edge.withColumn("goes_on", F.coalesce(F.col("last.open") & follows & ~F.col("top").rlike(r"^\s*(?:[-*•–]|\d+[.)])\s"), F.lit(False))).drop("last"))
    begun = F.when(~F.col("goes_on") | (F.col("first_no") != F.col("last_no")), F.struct("point_id", F.col("last_no").alias("paragraph_no")))
    owners = before(edge, "src", begun, "owner", at).where("goes_on").select("point_id", F.col("first_no").alias("paragraph_no"), "owner")
    own = F.struct("point_id", "paragraph_no")
    rows = pieces.join(placed, "point_id").join(owners, ["point_id", "paragraph_no"], "left").select(F.coalesce("owner", own).alias("o"), F.struct("page", "part_no", "paragraph_no", "text").alias("t"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list("t")), lambda x: x["text"]), " ")
    return rows.groupBy("o").agg(text.alias("text")).select("o.point_id", "o.paragraph_no", F.trim("text").alias("text"))


def repaired(chunks: DataFrame) -> DataFrame:
    """point_id, paragraph_no, text: continuous paragraphs without headers and page numbers, broken and misread words put right.

    Paragraphs end at blank lines; one that runs over the end of a page is whole where it begins, and so is a word broken
    over two pages. A misread word gets the form that noisy_lines goes by, also where it is broken over two lines.
    """
    pages = scanned_pages(chunks)
    marks = checkpointed(headers_and_numbers(pages))
    lines = checkpointed(running_lines(pages, marks))
    words = checkpointed(word_counts(lines))
    hyphens = checkpointed(hyphenated(lines, checkpointed(words.where(F.col("n") >= KNOWN)), words))
    tokens = lines.select("point_id", "line_no", F.posexplode(F.split(F.trim("line"), " ")).alias("i", "w"))
    fixed = tokens.join(misread_words(lines, words).drop("word"), ["point_id", "line_no", "i"], "left")
    core = _bare(F.col("w"))
    right = F.when(F.col("form").isNull(), F.col("w")).otherwise(F.replace(F.col("w"), core, _cased(F.col("form"), core)))
    text = fixed.select("point_id", "line_no", "i", right.alias("w")).groupBy("point_id", "line_no").agg(F.sort_array(F.collect_list(F.struct("i", "w"))).alias("ws"))
    forms = misread_joins(words, hyphens).select("point_id", "line_no", "form").groupBy("point_id", "line_no").agg(F.max("form").alias("form"))
    broken = hyphens.groupBy("point_id", "line_no").agg(F.max_by("left", "right").alias("begin"), F.max("right").alias("joins")).join(forms, ["point_id", "line_no"], "left")
    text = text.join(broken, ["point_id", "line_no"], "left")
    text = text.join(hyphens.groupBy(F.col("next_point").alias("point_id"), F.col("next_no").alias("line_no")).agg(F.max("right").alias("joined")), ["point_id", "line_no"], "left")
    first = F.col("ws")[0]["w"]
    kept = F.when(F.col("joined").isNotNull(), F.slice("ws", 2, F.size("ws"))).otherwise(F.col("ws"))
    line = F.array_join(F.transform(kept, lambda x: x["w"]), " ")
    bare = F.regexp_replace(line, rf"[{HYPHENS}]$", "")
    put = F.when(F.col("form").isNotNull() & bare.endswith(F.col("begin")), F.concat(F.left(bare, F.length(bare) - F.length("begin")), _cased(F.col("form"), F.col("begin")))).otherwise(F.concat(bare, "joins"))
    line = F.when(F.col("joins").isNotNull(), put).otherwise(line)
    tail = F.when(F.col("joined").isNotNull(), F.regexp_replace(first, rf"^.*?([^{_LETTER}]*)$", "$1")).otherwise("")
    rows = text.select("point_id", "line_no", F.concat(tail, F.when(tail != "", " ").otherwise(""), line).alias("line"))
    blanks = pages.dropDuplicates(["point_id"]).select("point_id", F.posexplode("lines").alias("line_no", "l")).where(is_blank(F.col("l"))).groupBy("point_id").agg(F.sort_array(F.collect_set("line_no")).alias("blanks"))
    placed = rows.join(blanks, "point_id", "left").withColumn("paragraph_no", F.size(F.filter(F.coalesce("blanks", F.array().cast("array<int>")), lambda b: b < F.col("line_no"))))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), " ")
    pieces = placed.groupBy("point_id", "paragraph_no").agg(F.trim(joined).alias("text"), F.min_by("line", "line_no").alias("first_line"), F.max_by("line", "line_no").alias("last_line"))
    return over_pages(checkpointed(pieces), pages)
