"""Facts from posting texts, as column expressions: plain text of HTML, salary, experience, arrangement, employment, sections."""

from __future__ import annotations

import json
from html import unescape
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------------------------------------------------

BLOCK_TAGS = "p|div|br|li|ul|ol|h1|h2|h3|h4|h5|h6|tr|table|section|article|header|footer|blockquote"
#: Thousands, unless the letter begins a word.
THOUSANDS = r"[kK](?![\p{L}\p{N}_])"
AMOUNT = rf"\$?\s?(\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?|\d+(?:\.\d+)?\s?{THOUSANDS}|\d+(?:\.\d+)?)"
RANGE = AMOUNT + r"\s*(?:-|–|—|\bto\b)\s*" + AMOUNT
UP_TO = r"(?i)up to\s+" + AMOUNT
SINGLE = rf"\$\s?(\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?|\d+(?:\.\d+)?\s?{THOUSANDS})"
HOURLY = r"(?i)per\s+hour|hourly|/\s?hour|/\s?hr\b"
ANNUAL = r"(?i)per\s+(year|annum)|annual|/\s?year|/\s?yr\b|a year"
CUE_CHARS, HOURS = 80, 2080
HOUR_BOUNDS, YEAR_BOUNDS = (10, 500), (20_000, 1_500_000)
YEARS = r"(?i)(?:at least\s+|minimum(?: of)?\s+)?(\d{1,2})\s*\+?\s*(?:[-–]\s*(\d{1,2})\s*)?years?(?:'|s)?\s+(?:of\s+)?(?:[\w/-]+\s+){0,3}?experience"
HYBRID, ONSITE = r"(?i)\bhybrid\b", r"(?i)on[- ]?site|in[- ]office|in the office"
REMOTE = r"(?i)fully remote|remote[- ]first|100% remote|work from anywhere|remote position|remote role|remote \(?(?:us|united states)\)?"
#: Employment types in the order in which they are tried: patterns for titles and for bodies.
EMPLOYMENT = (
    ("internship", r"(?i)\b(?:intern|interns|internship|internships|co[- ]op|co[- ]ops|apprentice(?:ship)?)\b|\b(?:student\s+(?:intern|internship|worker|researcher|associate|trainee)|(?:summer|winter|fall|spring)\s+student|(?:graduate|undergraduate|phd|master'?s?)\s+(?:intern|student))",
     r"(?i)(?:\binternship\s+(?:program|opportunit|position|role)|\b(?:this|our|the|summer|winter|fall|spring)\s+internship|\bco[- ]op\s+(?:program|student|term|position)|\bcurrently\s+enrolled\s+in|\bpursuing\s+a\s+(?:bachelor|master|ba\b|bs\b|ms\b|degree)|\brising\s+(?:junior|senior|sophomore))"),
    ("part_time", r"(?i)\bpart[- ]time\b", r"(?i)\bpart[- ]time\b"),
    ("contract", r"(?i)\b(?:contract|contractor|consultant|freelance)\b", r"(?i)(?:\bcontract\s+(?:position|role|opportunity|basis|assignment)|\b(?:\d{1,2}|six|three|twelve)[- ]month\s+contract|\bw2\s+contract|\bcorp[- ]to[- ]corp|\b1099\s+(?:contractor|basis))"),
    ("temporary", r"(?i)\b(?:temporary|seasonal|fixed[- ]term|temp\s+(?:position|role|assignment))\b", r"(?i)\b(?:temporary|seasonal|fixed[- ]term|temp\s+(?:position|role|assignment))\b"),
)
EMPLOYMENT_BODY_CHARS = 4000
#: Section kinds in the order in which a header line is tried.
HEADERS = (
    ("preferred", r"(?i)^(nice to have|nice-to-have|preferred qualification|preferred skill|bonus point|bonus|a plus|pluses|it'?d be great|great to have|extra credit|preferred experience|even better|not required)"),
    ("required", r"(?i)^(requirements?|qualifications?|what you('| wi)ll need|what we('| a)re looking for|must[- ]haves?|minimum qualification|basic qualification|about you|who you are|what you bring|your background|skills? (and|&) experience|what you need|you (should )?have|we('| a)re looking for|required (skills?|experience|qualification))"),
    ("responsibilities", r"(?i)^(responsibilit|what you('| wi)ll (do|be doing|work on|own)|the role|your (role|impact)|day[- ]to[- ]day|in this role|you will|about the (role|job|position)|duties|what you('| wi)ll (accomplish|achieve))"),
    ("benefits", r"(?i)^(benefits?|perks?|what we offer|compensation|pay (range|transparency)|salary|we offer|total rewards|why (join|work))"),
)
HEADER_CHARS = 90
#: What \\s means in a regular expression.
BLANKS = " \t\n\v\f\r"

# Expressions ----------------------------------------------------------------------------------------------------------


#: HTML's named characters; those that stand without a semicolon too; numbers that stand for other characters than their own.
_NAMED = {name[:-1]: chars for name, chars in html5.items() if name.endswith(";")}
_LEGACY = sorted((name for name in html5 if not name.endswith(";")), key=len, reverse=True)
_RENUMBERED = {n: unescape(f"&#{n};") for n in (0, 0x0B, *range(1, 9), *range(0x0E, 0x20), *range(0x7F, 0xA0))}
REFERENCE = rf"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;|{'|'.join(_LEGACY)})"


def _table(values: dict) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])


def once(value: Column, f) -> Column:
    """f(value), with value worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def unescaped(text: Column) -> Column:
    """``text`` with its character references (decimal, hexadecimal, named, with or without a semicolon) as the characters.

    Of an unknown name with a semicolon, the longest beginning that needs none counts; without one it stays. The text is cut
    once into gaps and references, so the work is linear in them; names are looked up by their first letter, then whole.
    """
    letters = sorted({name[0] for name in _NAMED})
    table = F.from_json(F.lit(json.dumps({c: {n: chars for n, chars in _NAMED.items() if n[0] == c} for c in letters})), "map<string,map<string,string>>")
    named = lambda name: table[F.left(name, F.lit(1))][name]

    def number(name: Column) -> Column:
        digits = F.regexp_replace(name, "^#[xX]?0*", "")
        n = F.when(F.length(digits) > 8, F.lit(0x110000)).when(name.rlike("^#[xX]"), F.conv(digits, 16, 10).cast("long")).otherwise(F.when(digits == "", F.lit(0)).otherwise(digits.cast("long")))
        return once(F.coalesce(n, F.lit(0)), _numbered)

    def character(written: Column) -> Column:
        name = F.regexp_replace(written, ";$", "")
        begun = F.regexp_extract(written, f"^(?:{'|'.join(_LEGACY)})", 0)
        prefixed = once(begun, lambda b: F.when(b != "", F.concat(named(b), F.substr(written, F.length(b) + 1))))
        known = once(name, lambda n: F.coalesce(named(n), prefixed, F.concat(F.lit("&"), written)))
        return F.when(written.startswith("#"), once(name, number)).otherwise(known)

    def joined(t: Column) -> Column:
        pairs = F.arrays_zip(F.split(t, REFERENCE, -1).alias("gap"), F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(1)).alias("name"))
        return F.array_join(F.transform(pairs, lambda p: F.concat(p["gap"], F.coalesce(character(p["name"]), F.lit("")))), "")

    return once(text, lambda t: F.when(t.contains("&"), joined(t)).otherwise(t))


def _numbered(n: Column) -> Column:
    """The characters that a numeric reference stands for."""
    valid = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    unassigned = n.between(0xFDD0, 0xFDEF) | ((n % 0x10000) >= 0xFFFE)
    own = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.coalesce(_table(_RENUMBERED)[n.cast("int")], F.when(~valid, F.lit("\ufffd")).when(unassigned, F.lit("")).otherwise(own))


def html_to_text(html: Column) -> Column:
    """Text of an HTML fragment: list items as bullets, blocks as lines, scripts and styles out, entities decoded."""
    t = F.regexp_replace(html, r"(?is)<!--.*?-->|<!doctype[^>]*>|<(script|style)\b[^>]*>.*?</\1\s*>", "")
    t = F.regexp_replace(t, r"(?i)<li\b[^>]*>", "\n• ")
    t = F.regexp_replace(t, rf"(?i)<(?:{BLOCK_TAGS})\b[^>]*>|</(?:{BLOCK_TAGS.replace('br|', '')})\s*>", "\n")
    t = F.regexp_replace(t, r"(?s)<[a-zA-Z/!?][^>]*>", "")
    t = unescaped(t)
    t = F.regexp_replace(F.translate(t, "\u00a0\u200b", " "), r"(?<![ \t])[ \t]++\n", "\n")  # begun where blanks begin: a long run is read once
    return F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"^\s+|(?<!\s)\s++$", "")


def found(text: Column, pattern: str) -> Column:
    """Every match from left to right: array of struct(hit, near), near being CUE_CHARS before it and as many from its start on.

    What is near is put together from the pieces between and of neighbouring matches, so the work is linear in the matches.
    """
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    n = F.lit(CUE_CHARS)

    def described(pairs: Column, x: Column, i: Column) -> Column:
        before = F.transform(F.slice(pairs, F.greatest(i - n, F.lit(0)) + 1, F.least(i, n)), lambda p: F.concat(F.right(p["gap"], n), p["hit"]))
        after = F.transform(F.slice(pairs, i + 2, n), lambda p: F.concat(F.left(p["gap"], n), F.coalesce(p["hit"], F.lit(""))))
        near = F.concat(F.right(F.concat(F.array_join(before, ""), F.right(x["gap"], n)), n), F.left(F.concat(x["hit"], F.array_join(after, "")), n))
        return F.struct(x["hit"].alias("hit"), near.alias("near"))

    once = F.transform(F.array(pairs), lambda ps: F.transform(ps, lambda x, i: described(ps, x, i)))[0]  # named, so that the text is split once
    listed = F.filter(once, lambda m: m["hit"].isNotNull())
    return F.when(text.rlike(pattern), listed).otherwise(F.array().cast("array<struct<hit: string, near: string>>"))


def _amount(raw: Column) -> Column:
    plain = F.regexp_replace(raw, r"[$,\skK]", "").cast("double")
    return F.when(raw.rlike("[kK]$"), plain * 1000).otherwise(plain)


def _priced(m: Column, pattern: str, both: bool) -> Column:
    """struct(low, high, period) of one match; period is NULL where nothing is plausible."""
    low = _amount(F.regexp_extract(m["hit"], pattern, 1))
    high = _amount(F.regexp_extract(m["hit"], pattern, 2)) if both else low
    low = F.when((high >= 1000) & (low < 1000), low * 1000).otherwise(low) if both else low
    near = m["near"]
    period = F.when(near.rlike(HOURLY), "hour").when(near.rlike(ANNUAL), "year").when(low.between(*HOUR_BOUNDS), "hour").when(low >= YEAR_BOUNDS[0], "year")
    fits = lambda bounds: low.between(*bounds) & high.between(*bounds) & (low <= high)
    good = F.when((period == "hour") & fits(HOUR_BOUNDS), period).when((period == "year") & fits(YEAR_BOUNDS), period)
    return F.struct(low.alias("low"), high.alias("high"), good.alias("period"))


def salary(text: Column) -> Column:
    """struct(low, high, period, annual_min, annual_max): the first plausible range, else "up to", else single amount; NULL if none."""

    def first(pattern: str, both: bool) -> Column:
        return F.get(F.filter(F.transform(found(text, pattern), lambda m: _priced(m, pattern, both)), lambda p: p["period"].isNotNull()), F.lit(0))

    best = F.coalesce(first(RANGE, True), first(UP_TO, False), first(SINGLE, False))
    return F.transform(F.array(best), lambda p: F.when(p.isNotNull(), F.struct(
        p["low"].alias("low"), p["high"].alias("high"), p["period"].alias("period"),
        (p["low"] * F.when(p["period"] == "hour", HOURS).otherwise(1)).alias("annual_min"), (p["high"] * F.when(p["period"] == "hour", HOURS).otherwise(1)).alias("annual_max"))))[0]


def years(text: Column) -> Column:
    """Least years of experience asked for, from the first plausible phrase."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(YEARS), F.lit(1)), lambda x: x.cast("int"))
    return F.get(F.filter(numbers, lambda n: (n > 0) & (n <= 20)), F.lit(0))


def level_of_years(n: Column) -> Column:
    return F.when(n < 2, "entry").when(n < 5, "mid").when(n < 8, "senior").when(n >= 8, "staff_plus")


def arrangement(text: Column, remote_place: Column) -> Column:
    return F.when(text.rlike(HYBRID), "hybrid").when(text.rlike(REMOTE) | F.coalesce(remote_place, F.lit(False)), "remote").when(text.rlike(ONSITE), "onsite")


def is_remote(place: Column) -> Column:
    return F.lower(place).contains("remote")


def employment_type(title: Column, text: Column, declared: Column) -> Column:
    """The declared type if known, else what the title says, else the beginning of the text, else full time; unknown if both are blank."""
    title, body = F.coalesce(title, F.lit("")), F.substring(F.coalesce(text, F.lit("")), 1, EMPLOYMENT_BODY_CHARS)
    out = F.lit("full_time")
    for kind, _, pattern in reversed(EMPLOYMENT):
        out = F.when(body.rlike(pattern), kind).otherwise(out)
    for kind, pattern, _ in reversed(EMPLOYMENT):
        out = F.when(title.rlike(pattern), kind).otherwise(out)
    return F.coalesce(declared, F.when(F.trim(F.concat(title, body)) == "", "unknown").otherwise(out))


#: How sources spell employment types, in lower case without marks and blanks.
DECLARED = {
    "fulltime": "full_time", "full": "full_time", "fte": "full_time", "permanent": "full_time", "regular": "full_time",
    "parttime": "part_time", "part": "part_time",
    "intern": "internship", "interns": "internship", "internship": "internship", "internships": "internship", "coop": "internship",
    "coopinternship": "internship", "internshipcoop": "internship", "student": "internship", "apprentice": "internship", "apprenticeship": "internship",
    "contract": "contract", "contractor": "contract", "contracttohire": "contract", "consultant": "contract", "consulting": "contract", "freelance": "contract",
    "temporary": "temporary", "temp": "temporary", "seasonal": "temporary", "fixedterm": "temporary",
}


def declared_employment(raw: Column) -> Column:
    """The type for the whole value without marks, else for the first of its words that has one, else NULL."""
    known = F.create_map(*[x for k, v in DECLARED.items() for x in (F.lit(k), F.lit(v))])
    whole = known[F.regexp_replace(F.lower(raw), "[^a-z0-9]+", "")]
    words = F.transform(F.split(F.lower(raw), "[^a-z0-9]+"), lambda w: known[w])
    return F.coalesce(whole, F.get(F.filter(words, lambda x: x.isNotNull()), F.lit(0)))


def job_level(title_level: Column, least_years: Column) -> Column:
    """The level that the title names, else the one that the years asked for stand for."""
    return F.coalesce(title_level, level_of_years(least_years))


def header_kind(line: Column) -> Column:
    """The section that a line opens, or NULL."""
    def named(bare: Column) -> Column:
        out = F.lit(None).cast("string")
        for kind, pattern in reversed(HEADERS):
            out = F.when(bare.rlike(pattern), kind).otherwise(out)
        return F.when(F.length(bare).between(1, HEADER_CHARS), out)

    return once(F.btrim(line, F.lit(f"{BLANKS}:•-–")), named)


def normal_text(text: Column) -> Column:
    """Stored text of a resume: unix line ends, no blanks at line ends, at most one empty line."""
    t = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"(?<![ \t])[ \t]++(?=\n|$)", "")
    return F.regexp_replace(t, r"\n{3,}", "\n\n")
