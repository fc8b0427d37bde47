"""Text expressions: tokens, symbols, blocks, sentences, snippets. Built-in functions only."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom import fixed_values as fv

# White space as Python's str.strip sees it; Java's \s is ASCII only.
SPACES = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
          "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
# An ASCII word with at most one inner apostrophe, or one other letter or digit.
TOKEN = r"[a-z0-9]+(?:'[a-z0-9]+)?|[\p{L}\p{N}]"
# Case folding that differs from lower-casing. Each of these characters is a token of its
# own, so the replacement is set off by blanks.
FOLDS = {"\u212a": "k", "\u00df": "ss", "\u017f": "s", "\ufb00": "ff", "\ufb01": "fi",
         "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl", "\ufb05": "st", "\ufb06": "st"}
KELVIN = "\u212a"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside an expression, so that lambdas do not re-evaluate it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def squeeze(c: Column) -> Column:
    """Collapse white space to single blanks and trim."""
    return F.trim(F.regexp_replace(F.translate(c, SPACES, " " * len(SPACES)), " {2,}", " "))


def compact(c: Column, limit: int = 700) -> Column:
    s = squeeze(c)
    return F.when(F.length(s) <= limit, s).otherwise(
        F.concat(F.rtrim(F.substring(s, 1, limit - 3)), F.lit("...")))


def snippet(c: Column, limit: int = 360) -> Column:
    s = squeeze(c)
    return F.when(F.length(s) <= limit, s).otherwise(
        F.concat(F.rtrim(F.substring(s, 1, limit - 1)), F.lit("...")))


def sentence_case(c: Column) -> Column:
    s = compact(c, 420)
    up = F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1000))
    return (F.when(s == "", F.lit(""))
             .when(F.substring(s, -1, 1).isin(".", "?", "!"), up)
             .otherwise(F.concat(up, F.lit("."))))


def fold(c: Column) -> Column:
    """Case-folded text (kept apart from its neighbours where folding adds letters)."""
    # The Kelvin sign lower-cases to an ASCII letter, so it is set apart first.
    out = F.translate(F.lower(F.replace(c, F.lit(KELVIN), F.lit(" k "))), "\u03c2\u00b5", "\u03c3\u03bc")
    for raw, folded in FOLDS.items():
        if raw != KELVIN:
            out = F.replace(out, F.lit(raw), F.lit(f" {folded} "))
    return out


def fold_plain(c: Column) -> Column:
    """Case-folded text for substring tests."""
    return F.replace(F.translate(F.lower(c), "\u03c2\u00b5", "\u03c3\u03bc"), F.lit("\u00df"), F.lit("ss"))


def raw_words(c: Column) -> Column:
    """Folded words in order, before stop terms, singular forms and mixed-word splitting."""
    return F.regexp_extract_all(fold(c), F.lit(TOKEN), F.lit(0))


def singular(x: Column) -> Column:
    n = F.length(x)
    return (F.when((n > 4) & x.endswith("ies"), F.concat(F.substring(x, F.lit(1), n - 3), F.lit("y")))
             .when((n > 3) & x.endswith("s") & ~x.endswith("ss"), F.substring(x, F.lit(1), n - 1))
             .otherwise(x))


def is_mixed(x: Column) -> Column:
    """Letters and digits together, without an apostrophe."""
    return x.rlike("^(?:[a-z]+[0-9]|[0-9]+[a-z])[a-z0-9]*$")


def word_anchors(x: Column) -> Column:
    """Anchors of one kept word: its characters if mixed, else its singular."""
    return F.when(is_mixed(x), F.split(x, "")).otherwise(F.array(singular(x)))


def anchors(c: Column, stop: Iterable[str] = fv.STOP_TERMS) -> Column:
    """Normalised anchors of a text in order. Stop terms go before singular forms are made."""
    stop = list(stop)
    kept = F.filter(raw_words(c), lambda x: ~x.isin(stop)) if stop else raw_words(c)
    plain = F.transform(kept, singular)
    mixed = F.flatten(F.transform(kept, word_anchors))
    # Texts without any digit cannot hold mixed words; skip the nested arrays for them.
    return F.coalesce(F.when(c.rlike("[0-9]"), mixed).otherwise(plain), F.array().cast("array<string>"))


def has_letter_only(x: Column) -> Column:
    return x.rlike(r"^\p{L}+$")


def is_digits(x: Column) -> Column:
    return x.rlike(r"^\p{Nd}+$")


def expand(terms: Column, stop: Iterable[str] = fv.STOP_TERMS) -> Column:
    """Query expansion: each anchor, its singular and its plural; distinct, order kept."""
    stop = list(stop)
    variants = F.flatten(F.transform(terms, lambda a: F.when(
        has_letter_only(a) & (F.length(a) > 2),
        F.array(a, singular(a), F.concat(a, F.lit("s")))).otherwise(F.array(a, singular(a)))))
    return F.array_distinct(F.filter(variants, lambda v: (v != "") & ~v.isin(stop)))


def symbol(anchor: Column) -> Column:
    return F.concat(F.lit("0x"), F.upper(F.substring(F.sha1(anchor.cast("binary")), 1, fv.SYMBOL_HEX_CHARS)))


def symbol_bytes(anchor: Column) -> Column:
    return F.unhex(F.substring(symbol(anchor), 3, fv.SYMBOL_HEX_CHARS))


def normalise_symbol(c: Column) -> Column:
    """Symbol text in its one written form: ``0x`` and upper-case hex digits."""
    return F.concat(F.lit("0x"), F.upper(F.regexp_replace(F.trim(c), "^0[xX]", "")))


def stable_id(prefix: str, *parts: Column, chars: int = 12, sep: str = "|") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws(sep, *parts).cast("binary")), 1, chars))


def safe_id(c: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(strip(c), "[^A-Za-z0-9_.-]+", "_"), "^[._]+|[._]+$", "")
    return F.when(out == "", F.raise_error(F.lit("id is empty"))).otherwise(out)


def text_lines(c: Column) -> Column:
    """Lines as Python's splitlines gives them."""
    return let(F.split(c, LINE_BREAK, -1), lambda p: F.when(
        F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p))


def text_blocks(c: Column, max_lines: int = fv.MAX_BLOCK_LINES) -> Column:
    """Blank-line paragraphs of at most ``max_lines`` lines, with 1-based line numbers.

    Row-local: a document is split where it is read, with no shuffle and no window.
    """
    def split_up(lines: Column) -> Column:
        n = F.size(lines)
        spans = let(F.transform(lines, lambda x: ~is_blank(x)), lambda full: let(
            F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda at: F.arrays_zip(
                F.filter(at, lambda i: F.get(full, i - 1) & ~F.coalesce(F.get(full, i - 2), F.lit(False))).alias("s"),
                F.filter(at, lambda i: F.get(full, i - 1) & ~F.coalesce(F.get(full, i), F.lit(False))).alias("e"))))
        pieces = F.flatten(F.transform(spans, lambda p: F.transform(
            F.sequence(p["s"], p["e"], F.lit(max_lines)), lambda s: F.struct(
                s.alias("line_start"),
                F.least(s + (max_lines - 1), p["e"]).alias("line_end"),
                F.array_join(F.slice(lines, s, F.least(F.lit(max_lines), p["e"] - s + 1)), "\n").alias("text")))))
        whole = F.array(F.struct(F.lit(1).alias("line_start"), F.greatest(n, F.lit(1)).alias("line_end"),
                                 c.alias("text")))
        return F.when(F.size(pieces) > 0, pieces).when(c != "", whole).otherwise(F.slice(whole, 1, 0))
    return let(text_lines(c), split_up)


def answer_sentences(c: Column) -> Column:
    """Sentences for answers: runs up to a full stop, or the last line of the text."""
    found = F.regexp_extract_all(c, F.lit(r"(?d)[^.!?\n]+(?:[.!?]|$)"), F.lit(0))
    return F.filter(F.transform(found, squeeze), lambda s: s != "")


def evidence_sentences(c: Column) -> Column:
    """Sentences for snippets: white space collapsed, cut after end marks."""
    s = squeeze(c)
    return F.filter(F.split(s, r"(?<=[.!?])\s+", -1), lambda x: x != "")


def plain_words(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)


def overlap(words: Column, others: Column) -> Column:
    """Multiset overlap of two word arrays."""
    return F.aggregate(F.array_intersect(words, others), F.lit(0), lambda acc, w: acc + F.least(
        F.size(F.filter(words, lambda x: x == w)), F.size(F.filter(others, lambda x: x == w))))


def best_sentence(text: Column, question_words: Column) -> Column:
    """Sentence with most question words; then the shorter, then the earlier by text."""
    ranked = F.array_min(F.transform(answer_sentences(text), lambda s: F.struct(
        (-overlap(question_words, plain_words(s))).alias("o"), F.length(s).alias("n"), s.alias("s"))))
    return F.coalesce(ranked["s"], squeeze(text))


def evidence_only(c: Column) -> Column:
    """Text without chat header lines and blank lines."""
    keep = F.filter(text_lines(c), lambda x: (strip(x) != "") & ~strip(x).startswith("## CHAT_TURN_")
                    & ~strip(x).rlike("^CHAT_[A-Z0-9_]+:"))
    return F.array_join(keep, "\n")


def header_value(c: Column, key: str) -> Column:
    """First non-empty ``key: value`` line of a text."""
    got = F.regexp_extract(c, rf"(?md)^[ \t]*{key}[ \t]*:(.*)$", 1)
    return F.when(F.trim(got) != "", F.trim(got))


def body_text(c: Column) -> Column:
    """Text after the first ``TEXT:`` marker, or all of it."""
    at = F.instr(c, "TEXT:")
    return F.when(at > 0, strip(F.substring(c, at + 5, F.length(c)))).otherwise(strip(c))


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    out = F.lit(False)
    for needle in needles:
        out = out | text.contains(needle)
    return out


def term_positions(terms: Column, term: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.greatest(F.size(terms) - 1, F.lit(0))),
                    lambda i: F.get(terms, i) == term)


def sequence_positions(terms: Column, phrase: Column) -> Column:
    """Start positions of a run of anchors."""
    width = F.size(phrase)
    empty = F.array().cast("array<int>")
    return F.when((width == 0) | (width > F.size(terms)), empty).otherwise(
        F.filter(F.sequence(F.lit(0), F.size(terms) - width),
                 lambda i: (F.get(terms, i) == F.get(phrase, F.lit(0)))
                 & (F.slice(terms, i + 1, width) == phrase)))


def round_to(c: Column, places: int) -> Column:
    """Half-up rounding by plain double arithmetic, the same on every engine."""
    scale = float(10 ** places)
    return F.floor(c * scale + 0.5).cast("double") / F.lit(scale)
