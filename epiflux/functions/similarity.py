"""String similarity as column expressions: edit-distance ratio and matching-blocks ratio."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edit_ratio(left: Column, right: Column) -> Column:
    """``round(100 * (1 - distance / longer length))``; 0 for two empty texts."""
    longest = F.greatest(F.length(left), F.length(right))
    return F.when(
        longest > 0, F.floor(100.0 * (longest - F.levenshtein(left, right)) / longest + 0.5)
    ).otherwise(F.lit(0)).cast("int")


def best_by_edit_ratio(pattern: Column, choices: Column) -> Column:
    """Best ``struct(score, choice)`` of an array; ties go to the alphabetically first choice."""
    scored = F.transform(
        choices, lambda choice: F.struct(
            (-edit_ratio(pattern, choice)).alias("loss"), choice.alias("choice")
        )
    )
    best = F.array_min(scored)
    return F.when(
        F.size(choices) > 0, F.struct((-best["loss"]).alias("score"), best["choice"].alias("choice"))
    )


def _named(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _split_at_block(piece: Column) -> Column:
    """Size of the longest common block of ``piece.l`` and ``piece.r``, and the pieces on both sides of it.

    Among blocks of that size the first on the left counts, and its first place on the right.
    """
    left, right = piece["l"], piece["r"]

    def reach(start: Column) -> Column:
        # a block is on the right if any longer one from the same start is
        sizes = F.sequence(F.lit(1), F.length(left) - start + 1)
        fits = F.filter(sizes, lambda size: F.instr(right, F.substring(left, start, size)) > 0)
        return F.struct(F.size(fits).alias("size"), (-start).alias("back"))

    def around(block: Column) -> Column:
        start, size = -block["back"], block["size"]
        at = F.instr(right, F.substring(left, start, size))

        def pair(l: Column, r: Column) -> Column:
            return F.struct(l.alias("l"), r.alias("r"))

        sides = F.array(
            pair(F.substring(left, F.lit(1), start - 1), F.substring(right, F.lit(1), at - 1)),
            pair(F.substring(left, start + size, F.length(left)), F.substring(right, at + size, F.length(right))),
        )
        whole = F.filter(sides, lambda side: (size > 0) & (side["l"] != "") & (side["r"] != ""))
        return F.struct(size.alias("size"), whole.alias("rest"))

    return _named(F.array_max(F.transform(F.sequence(F.lit(1), F.length(left)), reach)), around)


def matched_characters(left: Column, right: Column) -> Column:
    """How many characters are in matching blocks: the longest block, then those before and after it."""
    rounds = F.sequence(F.lit(1), F.greatest(F.least(F.length(left), F.length(right)), F.lit(1)))
    both = F.filter(F.array(F.struct(left.alias("l"), right.alias("r"))), lambda piece: (piece["l"] != "") & (piece["r"] != ""))

    def step(state: Column, _: Column) -> Column:
        def add(found: Column) -> Column:
            sizes = F.aggregate(F.transform(found, lambda block: block["size"]), F.lit(0), lambda s, size: s + size)
            rest = F.flatten(F.transform(found, lambda block: block["rest"]))
            return F.struct((state["matched"] + sizes).alias("matched"), rest.alias("open"))

        return _named(F.transform(state["open"], _split_at_block), add)

    start = F.struct(F.lit(0).alias("matched"), both.alias("open"))
    return F.aggregate(rounds, start, step, lambda state: state["matched"])


def block_ratio(left: Column, right: Column) -> Column:
    """Share of characters in matching blocks, as a whole percentage, halves to even; 0 where a text is empty."""
    total = F.length(left) + F.length(right)
    return F.when(total > 0, F.bround(100.0 * (2.0 * matched_characters(left, right) / total))).otherwise(
        F.when(total == 0, 0.0)).cast("int")


def best_by_block_ratio(pattern: Column, choices: Column, above: int) -> Column:
    """Best ``struct(score, choice)`` of an array by matching blocks, for scores greater than ``above``.

    Scores up to ``above`` may give NULL fields; ties go to the alphabetically first choice.
    Matched characters number at most ``(lengths - edit distance) / 2``, so most choices are
    dropped by their edit distance before any block is looked for.  The bound is exact.
    """
    total = lambda choice: F.length(pattern) + F.length(choice)
    plausible = F.filter(
        choices, lambda choice: 100.0 * (total(choice) - F.levenshtein(pattern, choice)) >= (above + 0.49) * total(choice))
    scored = F.transform(
        plausible, lambda choice: F.struct((-block_ratio(pattern, choice)).alias("loss"), choice.alias("choice")))
    return _named(F.array_min(scored), lambda best: F.struct((-best["loss"]).alias("score"), best["choice"].alias("choice")))


def char_ngrams(text: Column, n: int) -> Column:
    """Distinct character n-grams; a text shorter than ``n`` is its own gram."""
    whole = F.array(text)
    return F.when(F.length(text) < n, whole).otherwise(
        F.array_distinct(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))),
                lambda at: F.substring(text, at, F.lit(n)),
            )
        )
    )
