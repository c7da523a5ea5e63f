"""Text expressions: offsets of matches, token sets, scores, boundary alignment, hashes and prompts.

Offsets are code points, ends exclusive. Everything here is built from Spark's own functions.
"""

from __future__ import annotations

import operator

from pyspark.sql import Column, functions as F

from quillspan.functions import constants as K

TOKENS = "array<struct<tok:string,start:int,end:int>>"


def let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` evaluated once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), lambda v: f(v)), F.lit(0))


def running(values: Column, f=operator.add) -> Column:
    """For each value, ``f`` of 0 and all values before it.

    Blocks of about the square root of their number are summed first, so that n values take n ** 1.5 steps and nothing is copied twice.
    """

    def folded(x: Column, upto: Column) -> Column:
        return F.aggregate(F.slice(x, F.lit(1), upto), F.lit(0), lambda a, b: f(a, b))

    def of(all_: Column) -> Column:
        n = F.size(all_)
        return F.when(n > 0, let(F.ceil(F.sqrt(n)).cast("int"), lambda width: in_blocks(F.transform(F.sequence(F.lit(1), n, width), lambda at: F.slice(all_, at, width))))).otherwise(F.array().cast("array<int>"))

    def in_blocks(blocks: Column) -> Column:
        def of(parts: Column) -> Column:
            sums = F.transform(parts, lambda x: folded(x, F.size(x)))
            return let(sums, lambda s: F.flatten(F.transform(parts, lambda x, k: let(folded(s, k), lambda base: F.transform(x, lambda v, i: f(base, folded(x, i)))))))

        return let(blocks, of)

    return let(values, of)


def offsets(gaps: Column, hits: Column) -> Column:
    """Array of (tok, start, end) for ``hits``, which lie between ``gaps``."""
    def of(pairs: Column) -> Column:
        before = running(F.transform(pairs, lambda p: F.length(p["gap"]) + F.length(p["tok"])))
        here = lambda p, at: F.struct(p["tok"].alias("tok"), (at + F.length(p["gap"])).alias("start"), (at + F.length(p["gap"]) + F.length(p["tok"])).alias("end"))
        return F.zip_with(pairs, before, here)

    return let(F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("tok"))), of)


def find_all(text: Column, pattern: str) -> Column:
    """Array of (tok, start, end) for the matches of ``pattern``; gaps come from splitting by it."""
    of = lambda hits: F.when(F.size(hits) > 0, offsets(F.split(text, pattern, -1), hits)).otherwise(F.array().cast(TOKENS))
    return let(F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>")), of)


def tokenize(text: Column) -> Column:
    return find_all(text, K.TOKEN)


def emoji_clean(text: Column) -> Column:
    """Each run of emoji (and of the CJK range that the class covers) becomes one space."""
    return F.regexp_replace(text, K.EMOJI, " ")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of the lower-cased word sets, 0 to 100; 0 where either has no words."""
    x, y = F.array_distinct(words(F.lower(a))), F.array_distinct(words(F.lower(b)))
    empty = (F.size(x) == 0) | (F.size(y) == 0)
    return F.when(empty, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)) * 100.0)


def exact_match(a: Column, b: Column, case_sensitive: bool = False) -> Column:
    return a == b if case_sensitive else F.lower(a) == F.lower(b)


def confidence(fuzzy: Column, jaccard_score: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), fuzzy / 100.0 * 0.8 + jaccard_score / 100.0 * 0.2))


def negation_penalty(score: Column, negated: Column, penalty: float = 0.1) -> Column:
    return F.when(negated, F.greatest(F.lit(0.0), score - penalty)).otherwise(score)


def align_span(text: Column, start: Column, end: Column) -> Column:
    """(start, end, text) without edge characters that are neither letter nor digit; null if nothing is left.

    The end moves from the given end, even where that lies beyond the text.
    """
    cut = F.substring(text, start + 1, end - start)
    tail = F.length(F.regexp_extract(cut, r"[^\p{L}\p{N}]*$", 0))
    front = F.when(tail < F.length(cut), F.length(F.regexp_extract(cut, r"^[^\p{L}\p{N}]*", 0))).otherwise(F.lit(0))
    inner = F.substring(cut, front + 1, F.length(cut) - tail - front)
    return F.when(F.length(inner) > 0, F.struct((start + front).alias("start"), (end - tail).alias("end"), inner.alias("text")))


def is_anatomy_only(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(K.TOKEN), F.lit(0))
    return (F.size(found) == 1) & F.lower(F.get(found, 0)).isin(*K.ANATOMY)


def text_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def prompt(template: Column, text: Column, spans: Column, knowledge: Column) -> Column:
    """``spans`` is an array of (text, start, end, label, confidence)."""
    lines = F.array_join(F.transform(spans, lambda s: F.format_string("%s [%d,%d] %s conf=%.2f", s["text"], s["start"], s["end"], s["label"], s["confidence"])), "\n")
    filled = F.replace(F.replace(template, F.lit("{text}"), text), F.lit("{candidates}"), lines)
    return F.replace(filled, F.lit("{knowledge}"), knowledge)


PII = (("email", K.EMAIL, "[EMAIL]"), ("phone", K.PHONE, "[PHONE]"), ("ssn", K.SSN, "[SSN]"))


def pii_matches(text: Column) -> Column:
    """Array of (kind, tok, start, end, mask) on the original text, in the order email, phone, ssn."""
    def marked(kind: str, pattern: str, mask: str) -> Column:
        return F.transform(find_all(text, pattern), lambda m: F.struct(F.lit(kind).alias("kind"), m["tok"].alias("tok"), m["start"].alias("start"), m["end"].alias("end"), F.lit(mask).alias("mask")))

    return F.concat(*(marked(*x) for x in PII))


def deidentify(text: Column) -> Column:
    """Matches masked kind after kind. A literal that matched is masked only where the pattern matches."""
    for _, pattern, mask in PII:
        text = F.regexp_replace(text, pattern, F.lit(mask))
    return text


def shift_spans(spans: Column, matches: Column, new_text: Column) -> Column:
    """Spans moved by the masks that end before them; spans that touch a match are dropped."""
    def of(found: Column) -> Column:
        clear = F.filter(spans, lambda s: ~F.exists(found, lambda m: (s["start"] < m["end"]) & (s["end"] > m["start"])))
        shift = lambda s: F.aggregate(found, F.lit(0), lambda acc, m: acc + F.when(m["end"] <= s["start"], F.length(m["mask"]) - F.length(m["tok"])).otherwise(0))
        moved = F.transform(clear, lambda s: let(shift(s), lambda d: s.withField("start", s["start"] + d).withField("end", s["end"] + d)))
        return F.filter(moved, lambda s: (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= F.length(new_text)))

    return let(matches, of)


def sentences(text: Column) -> Column:
    """Array of (tok, start, end): cut after ``! ``, ``? `` and ``. ``; the space belongs to no sentence."""
    def of(parts: Column) -> Column:
        before = running(F.transform(parts, lambda p: F.length(p) + 1))
        return F.zip_with(parts, before, lambda p, at: F.struct(p.alias("tok"), at.alias("start"), (at + F.length(p)).alias("end")))

    return let(F.split(text, r"(?<=[.!?]) ", -1), of)


def occurrences(text: Column, term: Column) -> Column:
    """Starts of ``term`` in ``text`` without regard to case, overlapping ones included; no boundaries are asked for."""
    low, needle = F.lower(text), F.lower(term)

    def of(parts: Column) -> Column:
        starts = F.zip_with(running(F.transform(parts, lambda p: F.length(p))), parts, lambda at, p: F.when(F.startswith(p, needle), at))
        return F.array_compact(starts)

    return let(F.split(low, F.concat(F.lit("(?=\\Q"), needle, F.lit("\\E)")), -1), of)


def change_pattern(weak_text: Column, new_text: Column) -> Column:
    """What a correction did to a span: an adjective of degree was there, words were lost, or something else."""
    degree = F.contains(weak_text, F.lit("severe")) | F.contains(weak_text, F.lit("mild"))
    return F.when(degree, "removed_adjective").when(F.size(words(new_text)) < F.size(words(weak_text)), "truncated_compound").otherwise("other")
