"""Scalar functions over text, names and identifiers, as Columns that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the URL name space of RFC 4122.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
#: Names of document types and what they stand for.
DOC_TYPES = ["manual", "datasheet", "tutorial", "release_notes", "article", "other"]
DOC_TYPE_ALIASES = {"user_manual": "manual", "quick_start": "tutorial", "api_reference": "manual", "integration_guide": "tutorial", "troubleshooting": "other", "specification": "datasheet"}


#: A time beyond this is in milliseconds.
MILLISECONDS_FROM = 1e11


def seconds_of(at: Column) -> Column:
    """Epoch seconds of a time in seconds or milliseconds."""
    return F.when(at > MILLISECONDS_FROM, at / 1000).otherwise(at)


def normalised(text: Column) -> Column:
    """Trimmed lower case; null where nothing is left."""
    return F.nullif(F.lower(F.trim(text)), F.lit(""))


def terms(text: Column) -> Column:
    """Runs of a-z and 0-9 in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, 1 at least; 0 for an empty or null text."""
    size = F.coalesce(F.length(text), F.lit(0))
    return F.when(size == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(size / 4).cast("int")))


def preview(text: Column, size: int) -> Column:
    """The first characters, without blanks at the end and with an ellipsis where something is cut off."""
    return F.when(F.length(text) > size, F.concat(F.rtrim(F.substring(text, 1, size)), F.lit("…"))).otherwise(text)


def body(text: Column, size: int = 1000) -> Column:
    """A text as it stands in a prompt: its first characters as they are, with an ellipsis where something is cut off."""
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("…"))).otherwise(text)


def digest_id(source: Column, index: Column) -> Column:
    """The first 32 signs of the SHA-256 of source:index, with / for backslashes."""
    return F.substring(F.sha2(F.concat(F.replace(source, F.lit("\\"), F.lit("/")), F.lit(":"), index.cast("string")), 256), 1, 32)


def uuid5(name: Column) -> Column:
    """The name-based UUID of RFC 4122 (version 5, URL name space)."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("bigint").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def doc_type(value: Column) -> Column:
    """One of the known document types; manual for null or blank, other for what is unknown."""
    v = F.lower(F.trim(value))
    known = F.create_map(*[F.lit(x) for pair in (DOC_TYPE_ALIASES | {t: t for t in DOC_TYPES}).items() for x in pair])
    return F.when(F.coalesce(v, F.lit("")) == "", "manual").otherwise(F.coalesce(known[v], F.lit("other")))


def url_slug(url: Column, empty: Column) -> Column:
    """A file name of a url: the slug of its last path segment (or empty), eight signs of its digest, .html."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(path, r"([^/]*)/*$", 1)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat(F.when(slug == "", empty).otherwise(slug), F.lit("-"), F.substring(F.sha2(url, 256), 1, 8), F.lit(".html"))


def hash_vector(text: Column, size: int = 32) -> Column:
    """A deterministic stand-in for an embedding: bytes of the SHA-256, each over 255, repeated to the size."""
    h = F.sha2(text, 256)
    byte = lambda i: F.conv(F.substr(h, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), byte)


def term_vector(text: Column, size: int = 32) -> Column:
    """How many terms of a text fall into each of size cells, by the first byte of their SHA-256: a plain dense vector that needs no model."""
    cells = F.transform(terms(text), lambda t: F.conv(F.substring(F.sha2(t, 256), 1, 2), 16, 10).cast("int") % size)
    return F.aggregate(cells, F.array_repeat(F.lit(0.0), size), lambda acc, c: F.transform(acc, lambda v, i: F.when(i == c, v + 1).otherwise(v)))


def in_sample(text: Column, rate: float) -> Column:
    """Whether the first 32 bits of the digest, as a share, lie below the rate."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double") / 4294967295 < rate


def jaccard(a: Column, b: Column) -> Column:
    """Shared terms over all terms of two arrays; 0 where both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def term_hash(term: Column) -> Column:
    """The unsigned CRC32 of a term, its place in a sparse vector."""
    return F.crc32(F.encode(term, "UTF-8"))


def tenths(seconds: Column, digits: int = 1) -> Column:
    """Seconds with so many decimals, as text; halves go to the even digit."""
    return F.call_function("format_number", seconds.cast("double"), F.lit("0." + "0" * digits))


def short_hash(text: Column, signs: int) -> Column:
    """The first signs of the SHA-256."""
    return F.substring(F.sha2(text, 256), 1, signs)


def vendor_of_path(path: Column) -> Column:
    """The folder below the first data folder, if a file follows it."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    at = F.array_position(parts, "data").cast("int")
    return F.when((at > 0) & (at + 2 <= F.size(parts)), F.lower(F.try_element_at(parts, at + 1)))


def vendor_of_source(source: Column) -> Column:
    """The folder below docs; uploads for paths below data, else unknown."""
    parts = F.split(F.replace(source, F.lit("\\"), F.lit("/")), "/")
    return F.when((F.size(parts) >= 2) & (parts[0] == "docs"), F.lower(F.try_element_at(parts, F.lit(2)))).when((F.size(parts) >= 2) & (parts[0] == "data"), "uploads").otherwise("unknown")


#: How versions stand in file names, in order of trust.
VERSION_FORMS = [r"(?i)_v(\d+)\.(\d+)(?:\.(\d+))?_", r"(?i)(?:^|[^A-Za-z0-9])v(\d+)\.(\d+)(?:\.(\d+))?(?:[^A-Za-z0-9]|$)", r"(?i)(?:^|[^A-Za-z0-9])v(\d{2,3})(?:[^A-Za-z0-9]|$)", r"_(\d)(\d{2})(\d?)_"]


def version_of_name(name: Column) -> Column:
    """The software version in a file name, by the first form that matches; empty if none does."""
    part = lambda k, i: F.regexp_extract(name, VERSION_FORMS[k], i)
    has = [name.rlike(x) for x in VERSION_FORMS]
    first = F.concat_ws(".", part(0, 1), part(0, 2), F.nullif(part(0, 3), F.lit("")))
    last = F.concat_ws(".", part(3, 1), part(3, 2), F.coalesce(F.nullif(part(3, 3), F.lit("")), F.lit("0")))
    return F.when(has[0], first).when(has[1], F.concat_ws(".", part(1, 1), part(1, 2))).when(has[2], part(2, 1)).when(has[3], last).otherwise("")


def language_of_name(name: Column) -> Column:
    """de where a file name says so and doesn't say English, else en."""
    up = F.upper(name)
    return F.when(up.rlike("_EN[-_]US|-EN-US|-EN-"), "en").when(up.rlike("_DE|-DE-"), "de").otherwise("en")


def doc_type_of_name(name: Column) -> Column:
    """The document type that a file name shows: by its ending, then by its words; manual where it shows nothing."""
    low = F.lower(name)
    return F.when(low.rlike(r"\.html?$"), "article").when(low.rlike("data[-_]?sheet"), "datasheet").when(low.rlike("release[-_]notes"), "release_notes").when(low.rlike("tutorial|quick[-_]start"), "tutorial").otherwise("manual")


#: How captions begin without saying anything.
CAPTION_OPENINGS = [
    r"(?i)^this (?:image|figure|photo|screenshot|diagram|picture) (?:shows|depicts|displays|contains|is)\s*:?\s*",
    r"(?i)^the (?:image|figure|photo|screenshot|diagram|picture) (?:shows|depicts|displays|contains|is)\s*:?\s*",
    r"(?i)^(?:an? )?(?:image|figure|photo|screenshot|diagram|picture)\s+(?:shows|depicts|displays)\s*:?\s*",
]


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def caption_text(raw: Column, size: int = 600) -> Column:
    """A caption without its empty opening, cut behind the last sentence within size, else before the last word."""
    text = squeezed(raw)
    for opening in CAPTION_OPENINGS:
        text = F.regexp_replace(text, opening, "")
    text = squeezed(text)
    window = F.substring(text, 1, size)
    sentence, words = F.regexp_extract(window, r"(?s)^(.+[.!?])", 1), F.regexp_extract(window, r"(?s)^(.+) ", 1)
    return F.when(F.length(text) <= size, text).when(sentence != "", F.trim(sentence)).when(words != "", F.trim(words)).otherwise(F.trim(window))


def snippet(text: Column, size: int = 1200) -> Column:
    """A text cut behind the last sentence, else line, in the second half of its first size signs, with an ellipsis."""
    window = F.substring(text, 1, size)
    cut = F.regexp_replace(window, r"\s+$", "")
    for mark in ("\n", ".\n", ". "):
        at = size - F.instr(F.reverse(window), mark[::-1]) - len(mark) + 2
        found = F.contains(window, F.lit(mark)) & (at - 1 > size // 2)
        cut = F.when(found, F.regexp_replace(F.substr(window, F.lit(1), at), r"^\s+|\s+$", "")).otherwise(cut)
    return F.when(F.length(text) <= size, text).otherwise(F.concat(cut, F.lit("…")))


def is_video_url(url: Column) -> Column:
    return F.lower(url).rlike(r"youtube\.com/(?:watch|embed/|shorts/)|youtu\.be/")


def video_of_url(url: Column) -> Column:
    """The id in the url of a video, short, embedded or plain; null if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(F.trim(url), r"(?i)(?:youtu\.be/|embed/|shorts/)([a-zA-Z0-9_-]{6,})", 1), F.lit("")), F.nullif(F.regexp_extract(F.trim(url), r"(?i)[?&]v=([a-zA-Z0-9_-]{6,})", 1), F.lit("")))


def watch_url(url: Column) -> Column:
    """Short and embedding urls in the plain form; others stay."""
    found = F.nullif(F.regexp_extract(F.trim(url), r"(?i)^[a-z]+://(?:[^/?#]*youtube\.com[^/?#]*/embed|[^/?#]*youtu\.be[^/?#]*)/([^/?#]+)", 1), F.lit(""))
    return F.coalesce(F.concat(F.lit("https://www.youtube.com/watch?v="), found), F.trim(url))


def url_at(url: Column, seconds: Column) -> Column:
    """The url with the second to begin at."""
    t = F.greatest(F.lit(0), F.bround(seconds).cast("bigint"))
    return F.when(seconds.isNull(), url).otherwise(F.concat(url, F.when(F.contains(url, F.lit("?")), "&").otherwise("?"), F.lit("t="), t.cast("string"), F.lit("s")))


def index_text(kind: str, source: Column, place: Column, text: Column) -> Column:
    """What is embedded in the place of a caption, transcript or frame: its kind, file and place before the text."""
    return F.concat(F.lit(f"[{kind}, "), source, F.coalesce(F.concat(F.lit(", "), place), F.lit("")), F.lit("] "), text)


#: What speaks for code in a text.
CODE_SIGNS = ["{", "}", "def ", "function", "import", "#include"]


def has_code(text: Column) -> Column:
    """A sign of code, or a line that begins with two blanks or more or a tab."""
    found = text.rlike(r"(?m)^(?:\s{2,}|\t)\S")
    for sign in CODE_SIGNS:
        found = found | F.contains(text, F.lit(sign))
    return found
