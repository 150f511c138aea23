"""Column expressions over text: tokens, phrases, chunks, keys of patent numbers, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that the keyword planner leaves out.
PLANNER_STOPWORDS = """
a an and are as at be being by claim claims comprise comprises comprising
configured each first for from further has have having herein in includes
including is it its least method methods of on one or other plurality
provided said second such system systems that the thereof third to use used
using via wherein whereby which with
""".split()
#: Words that topic names leave out.
TOPIC_STOPWORDS = """
a an and are as at be by for from has have in is it its of on or that the
this to was were will with which said wherein thereof comprising method system
apparatus device first second one more least each other than may can such
using used use based include includes including data unit means plurality
configured present invention according embodiment embodiments claim claims
""".split()
#: Fixed value: the form of a patent number once it is upper case without commas, slashes and blanks.
NUMBER_PATTERN = r"^([A-Z]{2})?[- ]?([A-Z]?[0-9][0-9,./]*[0-9]|[0-9])[- ]?([A-Z][0-9]?)?$"
CHUNK_WORDS, CHUNK_STEP = 700, 560


def tokens(text: Column) -> Column:
    """Runs of a-z and digits of the lower-cased text; none for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def _without(words: list[str], pattern: str, text: Column) -> Column:
    stop = F.array(*map(F.lit, words))
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t))


def topic_tokens(text: Column) -> Column:
    """Tokens that begin with a letter, of three characters or more, without topic stopwords."""
    return _without(TOPIC_STOPWORDS, "[a-z][a-z0-9]+", text)


def planner_tokens(text: Column, digits: bool = False) -> Column:
    """Tokens of three characters or more, without planner stopwords and, unless wanted, numbers."""
    found = _without(PLANNER_STOPWORDS, "[a-z0-9]+", text)
    return found if digits else F.filter(found, lambda t: ~t.rlike("^[0-9]+$"))


def stripped(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def phrase(text: Column) -> Column:
    """Lower-case words joined by single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def concept_name(text: Column, longest: int = 60) -> Column:
    """A phrase as an upper-case name with underscores; CONCEPT if nothing is left."""
    name = F.regexp_replace(F.regexp_replace(F.upper(text), "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(name, 1, longest), "_+$", ""), F.lit("")), F.lit("CONCEPT"))


def chunks(text: Column, words: int = CHUNK_WORDS, step: int = CHUNK_STEP) -> Column:
    """Overlapping runs of words, each joined by single blanks; a last one may lie within the one before."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    starts = F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.size(parts), F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: F.array_join(F.slice(parts, at, words), " "))


def number_parts(raw: Column) -> Column:
    """struct(country_code, number, kind_code) of a patent number, or null if it has not the form of one."""
    plain = F.translate(F.upper(stripped(raw)), ",/ ", "")
    part = lambda i: F.nullif(F.regexp_extract(plain, NUMBER_PATTERN, i), F.lit(""))
    found = F.struct(F.coalesce(part(1), F.lit("US")).alias("country_code"), F.regexp_replace(part(2), "[,./]", "").alias("number"), part(3).alias("kind_code"))
    return F.when(plain.rlike(NUMBER_PATTERN), found)


def number_display(parts: Column) -> Column:
    return F.concat(parts["country_code"], parts["number"], F.coalesce(parts["kind_code"], F.lit("")))


def number_key(parts: Column) -> Column:
    """The same for all kinds of a document and for leading zeros."""
    return F.concat(parts["country_code"], F.coalesce(F.nullif(F.regexp_replace(parts["number"], "^0+", ""), F.lit("")), F.lit("0")))


def reference_key(raw: Column) -> Column:
    """number_key of what is a number, or else the trimmed text in upper case."""
    return F.coalesce(number_key(number_parts(raw)), F.upper(stripped(raw)))


def compact_date(raw: Column) -> Column:
    """A date of YYYYMMDD or ISO form; null if it is none."""
    text = stripped(raw)
    return F.coalesce(F.try_to_date(F.substring(text, 1, 8), "yyyyMMdd"), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))


def effective_date(priority: Column, filing: Column, publication: Column | None = None) -> Column:
    """The earlier of priority and filing, else publication."""
    first = F.least(priority, filing)
    return first if publication is None else F.coalesce(first, publication)


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(F.lit(0.0))


def overlap(tokens_: Column, wanted: Column) -> Column:
    """The share of the distinct wanted tokens that occur; 0 if none are wanted."""
    n = F.size(F.array_distinct(wanted))
    return F.when(n > 0, F.size(F.array_intersect(tokens_, wanted)) / n).otherwise(F.lit(0.0))


def duration(seconds: Column) -> Column:
    """For people: seconds, minutes or hours."""
    one = lambda x, unit: F.concat(F.format_string("%.1f", x), F.lit(unit))
    return F.when(seconds < 90, F.concat(F.rint(seconds).cast("long").cast("string"), F.lit(" seconds"))).when(seconds < 5400, one(seconds / 60, " minutes")).otherwise(one(seconds / 3600, " hours"))


def search_text(*parts: Column) -> Column:
    """The parts that have any text, a line each."""
    return F.concat_ws("\n", F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")))


#: US patent numbers in prose; the parts of examiners' search logs.
US_NUMBER = r"(?i)\b(?:U\.?S\.?\s*(?:Pat(?:ent)?\.?\s*(?:No\.?)?)?\s*)?\d{1,2},\d{3},\d{3}\b|\bUS[-\s]?\d{7,8}\b"
_FIELD = "(?:clm|clms|dclm|ab|abs|ti|spec|ccls|cpc|ipc|in|as|kwic)"
LOG_FIELD = rf"(?i)\.\s*{_FIELD}(?:\s*,\s*{_FIELD})*\s*\."
LOG_BOOLEAN = r"(?i)\b(?:and|or|not|adj\d*|near\d*|same|with)\b"
LOG_PREFIX = r"^[LS]\d+\b[\s|:]*(?:[\d,]+[\s|]+)?(?=.)"
LOG_TRAILER = r"(?i)\s+(?:US-PGPUB|USPAT|USOCR|FPRS|EPO|JPO|DERWENT|IBM[_-]TDB)\b.*$"


def us_numbers(text: Column) -> Column:
    """Distinct keys of the US patent numbers named in prose, in order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(US_NUMBER), F.lit(0))
    return F.array_distinct(F.transform(found, lambda m: F.concat(F.lit("US"), F.regexp_replace(m, "[^0-9]", ""))))


def log_queries(text: Column) -> Column:
    """Distinct search queries of an examiner's log, in order: lines with a field suffix, or a boolean word and structure."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda line: stripped(F.regexp_replace(F.regexp_replace(stripped(line), LOG_PREFIX, ""), LOG_TRAILER, "")))
    structure = lambda q: q.contains('"') | (q.contains("(") & q.contains(")")) | q.contains("$")
    queries = F.filter(lines, lambda q: (q != "") & (q.rlike(LOG_FIELD) | (q.rlike(LOG_BOOLEAN) & structure(q))))
    lower = F.transform(queries, lambda q: F.lower(q))
    return F.filter(queries, lambda q, i: F.array_position(lower, F.lower(q)) == i + 1)
