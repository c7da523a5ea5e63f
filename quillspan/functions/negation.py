"""Negation: cue tokens, the regions they cover, and the tests of spans against regions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from quillspan.functions import constants as K
from quillspan.functions.text import let

REGIONS = "array<struct<start:int,end:int>>"


def is_cue(token: Column) -> Column:
    """A listed cue, or a word that starts with a cue of more than three letters."""
    listed = "|".join(f"{cue}$" for cue in K.NEGATION_CUES)
    started = "|".join(cue for cue in K.NEGATION_CUES if len(cue) > 3)
    return F.lower(token).rlike(f"^(?:{listed}|{started})")


def negated_regions(tokens: Column, window: int = K.NEGATION_WINDOW) -> Column:
    """Array of (start, end): per cue the tokens after it, then those before it, or the cue itself if there are none."""

    def regions(toks: Column) -> Column:
        def of(i: Column) -> Column:
            here, last = F.get(toks, i), F.size(toks) - 1
            after = F.when((i < last) & F.lit(window > 0), F.struct(F.get(toks, i + 1)["start"].alias("start"), F.get(toks, F.least(i + window, last))["end"].alias("end")))
            before = F.when((i > 0) & F.lit(window > 0), F.struct(F.get(toks, F.greatest(i - window, F.lit(0)))["start"].alias("start"), F.get(toks, i - 1)["end"].alias("end")))
            alone = F.when((F.size(toks) == 1) | F.lit(window == 0), F.struct(here["start"].alias("start"), here["end"].alias("end")))
            return F.filter(F.array(after, before, alone), lambda r: r.isNotNull())

        at = F.filter(F.transform(toks, lambda t, i: F.when(is_cue(t["tok"]), i)), lambda i: i.isNotNull())
        return F.flatten(F.transform(at, of)).cast(REGIONS)

    return let(tokens, regions)


def touches(start: Column, end: Column, regions: Column) -> Column:
    """Any overlap: the rule that matching uses."""
    return F.exists(regions, lambda r: (end > r["start"]) & (start < r["end"]))


def covered(start: Column, end: Column, regions: Column, share: float = 0.5) -> Column:
    """A single region covers at least ``share`` of the span; false for an empty or inverted span."""
    cut = lambda r: F.greatest(F.lit(0), F.least(end, r["end"]) - F.greatest(start, r["start"]))
    return (end > start) & F.exists(regions, lambda r: cut(r) >= (end - start) * share)
