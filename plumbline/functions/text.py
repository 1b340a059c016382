"""Text functions: tokens, sentences, anchors, negation and overlap scores, hashes, rationales. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S
from . import scalars as X


class Reading(NamedTuple):
    """How reports are read: by default as the reference's Python does, or, as SQL says, as the queries' SQL does."""

    flag: str = "U"  # of patterns with spaces or headers
    space: str = r"\s"  # in a character class
    ends: str = " "  # trimmed from the flat report
    cuts: str = ""  # ends a sentence too
    short: bool = False  # a letter's other case is one letter: i for İ, and ß has no SS
    edge: str = r"\b"  # of a word


PYTHON = Reading()
#: White space is ASCII's without \v; U+0001 is what the SQL splits at.
SQL = Reading("u", r"\t\n\f\r ", " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000", "|\x01", True, r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lowered(t: Column, reading: Reading = PYTHON) -> Column:
    return F.lower(F.when(F.contains(t, F.lit("İ")), F.translate(t, "İ", "i")).otherwise(t) if reading.short else t)


def tokens(t: Column, reading: Reading = PYTHON) -> Column:
    """Lower-case runs of two or more ASCII letters and hyphens that begin with a letter."""
    return F.regexp_extract_all(lowered(t, reading), F.lit(r"([a-zA-Z][a-zA-Z\-]+)"), F.lit(1))


def _dotless(s: Column) -> Column:
    return F.btrim(s, F.lit(" ."))


def normalize_sentence(s: Column, reading: Reading = PYTHON) -> Column:
    """Without dots and spaces at its ends and headers at its head; empty with fewer than two tokens or as a bare header."""
    heads = "|".join(S.HEADERS)
    bare = _dotless(F.regexp_replace(_dotless(s), rf"(?i{reading.flag})^[ .]*(?:(?:{heads})[:.{reading.space}-]*[ .]*)*", ""))
    header = lambda s: F.upper(s).isin(*S.BARE_HEADERS) & (F.length(F.upper(s)) == F.length(s) if reading.short else F.lit(True))
    return let(bare, lambda s: F.when((F.size(tokens(s, reading)) < 2) | header(s), "").otherwise(s))


def flat_report(report: Column, reading: Reading = PYTHON) -> Column:
    t = F.replace(F.replace(report, F.lit("\n"), F.lit(" ")), F.lit(":."), F.lit(": "))
    t = F.regexp_replace(t, r"\.(?=[A-Z_])", ". ")
    return F.btrim(F.regexp_replace(t, rf"(?{reading.flag})[{reading.space}]+", " "), F.lit(reading.ends))


def sentences(report: Column, reading: Reading = PYTHON) -> Column:
    """The normalized sentences; the flat report if none is left."""

    def of(flat: Column) -> Column:
        kept = F.filter(F.transform(F.split(flat, rf"(?{reading.flag})(?<=[.!?])[{reading.space}]+{reading.cuts}"), lambda s: normalize_sentence(s, reading)), lambda s: s != "")
        return let(kept, lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(flat)))

    return let(flat_report(F.coalesce(report, F.lit("")), reading), of)


def anchor_terms(finding: Column, definition: Column, stop_words: tuple[str, ...] = S.STOP_WORDS) -> Column:
    words = F.transform(tokens(F.concat_ws(" ", finding, definition)), lambda w: F.btrim(w, F.lit("-")))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*stop_words)))


def _positions(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def cue_positions(words: Column, cue: str) -> Column:
    parts = cue.split()
    width = F.size(words) - (len(parts) - 1)
    wanted = F.array(*[F.lit(p) for p in parts])
    return F.filter(_positions(width), lambda i: F.slice(words, i + 1, F.lit(len(parts))) == wanted)


def sentence_negation(sentence: Column, anchors: Column, cues: tuple[str, ...] = S.CUES, reading: Reading = PYTHON) -> Column:
    """Over cues and their positions: 1 / (distance to the nearest anchor + 1), or 0.15 in a sentence without anchors."""
    hit = lambda w: F.array_contains(anchors, w) | F.array_contains(anchors, F.rtrim(w, F.lit("s")))

    def total(words: Column, at: Column) -> Column:
        near = lambda p: F.when(F.size(at) == 0, F.lit(0.15)).otherwise(F.lit(1.0) / (F.array_min(F.transform(at, lambda a: F.abs(a - p))) + F.lit(1.0)))
        of = lambda cue: F.aggregate(cue_positions(words, cue), F.lit(0.0), lambda acc, p: acc + near(p))
        return reduce(lambda a, b: a + b, [F.when(F.array_contains(words, cue.split()[0]), of(cue)).otherwise(F.lit(0.0)) for cue in cues])

    at = lambda words: F.filter(_positions(F.size(words)), lambda i: hit(F.get(words, i)))
    heads = F.array(*[F.lit(c) for c in dict.fromkeys(cue.split()[0] for cue in cues)])  # most sentences have none of these
    told = lambda words: let(at(words), lambda places: total(words, places))
    return let(tokens(sentence, reading), lambda words: F.when(F.arrays_overlap(words, heads), told(words)).otherwise(F.lit(0.0)))


def _best(found: Column, score) -> Column:
    """struct<score, text> of the sentence with the highest score over 0, the earliest of equals."""
    none = F.struct(F.lit(0.0).alias("score"), F.lit("").alias("text"))
    scored = F.transform(found, lambda s: F.struct(score(s).alias("score"), s.alias("text")))
    return F.aggregate(scored, none, lambda acc, x: F.when(x["score"] > acc["score"], x).otherwise(acc))


def negation(found: Column, anchors: Column, cues: tuple[str, ...] = S.CUES, reading: Reading = PYTHON) -> Column:
    best = _best(found, lambda s: sentence_negation(s, anchors, cues, reading))
    return let(best, lambda x: F.struct((F.lit(1.0) - F.exp(-x["score"])).alias("score"), x["text"].alias("text")))


def implicit(found: Column, anchors: Column, wordless: Column | None = None, reading: Reading = PYTHON) -> Column:
    """struct<score, text>. wordless: the score, else 0, of a sentence without words, or of any without anchors."""
    def score(words: Column) -> Column:
        both = F.size(F.array_intersect(words, anchors)).cast("double")
        return F.coalesce(F.try_divide(both, F.sqrt((F.size(words) * F.size(anchors)).cast("double"))), F.lit(0.0) if wordless is None else wordless)

    return _best(found, lambda s: let(F.array_distinct(tokens(s, reading)), score))


def risk(report: Column, finding: Column, definition: Column, cues: tuple[str, ...] = S.CUES, wordless: float = 0.0, reading: Reading = PYTHON) -> Column:
    """struct<s_neg, s_imp, neg_evidence, imp_evidence>, scores to six places. wordless: s_imp of a report without words; a null report has 0."""
    empty = F.when(report.isNull(), 0.0).otherwise(F.lit(float(wordless)))

    def both(found: Column, anchors: Column) -> Column:
        parts = F.struct(negation(found, anchors, cues, reading).alias("n"), implicit(found, anchors, empty, reading).alias("i"))
        return let(parts, lambda x: F.struct(X.rounded(x["n"]["score"], 6).alias("s_neg"), X.rounded(x["i"]["score"], 6).alias("s_imp"), x["n"]["text"].alias("neg_evidence"), x["i"]["text"].alias("imp_evidence")))

    return let(sentences(report, reading), lambda found: let(anchor_terms(finding, definition), lambda anchors: both(found, anchors)))


def normalize_text(t: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(t), "_{2,}", "_"), r"(?U)\s+", " "))


def text_hash(t: Column) -> Column:
    """SHA-1 of the normalized text; empty for an empty text."""
    return F.when(F.coalesce(t, F.lit("")) == "", "").otherwise(F.sha1(F.encode(normalize_text(t), "UTF-8")))


def report_of(prompt: Column, or_separator: bool = False) -> Column:
    """What stands between `Report:` and `Finding:`; else the whole text (trimmed where separators count too)."""
    ends = r"\nFinding:|\sFinding:" + (r"|\s\[SEP\]\s*Finding:" if or_separator else "")
    pattern = rf"(?s)Report:\s*(.*?)(?:{ends})"
    return F.when(prompt.rlike(pattern), F.btrim(F.regexp_extract(prompt, pattern, 1), F.lit(" \t\n\r"))).otherwise(F.btrim(prompt, F.lit(" \t\n\r")) if or_separator else prompt)


def field_of(prompt: Column, name: str) -> Column:
    return F.btrim(F.regexp_extract(prompt, rf"{name}:\s*(.+)", 1))


def uncertainty(assigned: Column, report: Column, patterns: tuple[str, ...] = S.UNCERTAINTY, reading: Reading = PYTHON) -> Column:
    """struct<score, hit>: the first pattern, in the list's order, that a positive label's report holds."""
    low = lowered(F.coalesce(report, F.lit("")), reading)
    hit = F.coalesce(*[F.nullif(F.regexp_extract(low, p.replace(r"\b", reading.edge), 0), F.lit("")) for p in patterns])
    hit = F.when(F.lower(assigned) == "positive", hit)
    return F.struct(F.when(hit.isNotNull(), 1.0).otherwise(0.0).alias("score"), F.coalesce(hit, F.lit("")).alias("hit"))


#: Letters that F.upper makes several of, with their capital of one letter; the others of that kind have none.
CAPITALS = {"ß": "ẞ", "ᾳ": "ᾼ", "ῃ": "ῌ", "ῳ": "ῼ"} | {chr(row + i): chr(row + 8 + i) for row in (0x1F80, 0x1F90, 0x1FA0) for i in range(8)}


def capital(letter: Column) -> Column:
    """The capital of a letter that is one letter too, as in the SQL: ẞ for ß, and ŉ as it is. Letters that got theirs in Unicode 16 depend on the library."""
    up = F.upper(letter)
    return F.when(F.length(up) == F.length(letter), up).otherwise(F.translate(letter, "".join(CAPITALS), "".join(CAPITALS.values())))


def clean_rationale(r: Column, upper: Callable[[Column], Column] = F.upper) -> Column:
    """upper: of the first letter; F.upper makes SS of ß."""
    r = F.regexp_replace(F.btrim(r, F.lit(" \t\n\r")), r"(?U)\s+", " ")
    for old, new in S.REPAIRS:
        r = F.replace(r, F.lit(old), F.lit(new))
    for p in S.RATIONALE_PREFIXES:
        r = F.btrim(F.regexp_replace(r, f"(?iU){p}", ""))
    return F.concat(upper(F.substring(r, 1, 1)), r.substr(F.lit(2), F.length(r)))


def word_count(t: Column) -> Column:
    t = F.btrim(F.regexp_replace(t, r"(?U)\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))
