"""Registration grammar: repair of confusable characters, parsers, validity and scores.

A cleaned text becomes three numbers, whose bits tell which characters can be letters, can be digits, and are digits. Windows
are ruled out, and their repairs counted, by integer operations on these; only the best window's plate is built, by translate().
Catalyst expressions throughout. Scores are held as whole hundredths, so ties are exact.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.functions.text import _c, clean_text
from sightline.plans.lineage import let

# State codes, confusable characters.
STATES = "AN AP AR AS BR CG CH DD DL DN GA GJ HP HR JH JK KA KL LA LD MH ML MN MP MZ NL OD PB PY RJ SK TN TR TS UK UP WB".split()
TO_DIGIT = ("OQDILZSGB", "000112568")
TO_LETTER = ("012568", "OIZSGB")
#: The older map, without Q and D.
TO_DIGIT_OLD = ("OILZSBG", "0112586")

STATE = "(" + "|".join(STATES) + ")"
BH = "[0-9]{2}BH[0-9]{4}[A-Z]{2}"
_LETTERS, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
_ALL = _LETTERS + _DIGITS
#: Places of a text that one number of bits covers; a window has 11 characters at most.
STRIDE = 48


def digits(x: Column, table: tuple[str, str] = TO_DIGIT) -> Column:
    return F.translate(x, *table)


def letters(x: Column) -> Column:
    return F.translate(x, *TO_LETTER)


def _count(x: Column, kind: str) -> Column:
    return F.length(F.regexp_replace(x, f"[^{kind}]", ""))


def _bits(text: Column, chars: str) -> Column:
    """A text of at most 63 characters as a number: a bit for each character, the first one highest, set for those in chars."""
    return F.conv(F.translate(text, _ALL, "".join("1" if c in chars else "0" for c in _ALL)), 2, 10).cast("long")


def _fits(bits: Column, shift: Column, series: int, number: int) -> Column:
    """Whether the window of a mask that ends `shift` characters before the text's end has characters that can all be what the
    mask wants; bits: l (can be letters), d (can be digits)."""
    letter, digit = _mask(series, number)
    held = lambda name, mask: F.call_function("shiftright", bits[name], shift).bitwiseAND(F.lit(mask)) == F.lit(mask)
    return held("l", letter) & held("d", digit)


def _cost(bits: Column, shift: Column, series: int, number: int) -> Column:
    """Digits where the mask wants letters, and letters where it wants digits; bits: x (digits)."""
    letter, digit = _mask(series, number)
    own = F.call_function("shiftright", bits["x"], shift)
    return F.bit_count(own.bitwiseAND(F.lit(letter))) + F.bit_count(F.bitwise_not(own).bitwiseAND(F.lit(digit)))


def _mask(series: int, number: int) -> tuple[int, int]:
    kinds = "LLDD" + "L" * series + "D" * number
    return tuple(int("".join("1" if k == kind else "0" for k in kinds), 2) for kind in "LD")


def _facts(text: Column, table: tuple[str, str] = TO_DIGIT) -> Column:
    return F.struct(_bits(text, _LETTERS + TO_LETTER[0]).alias("l"), _bits(text, _DIGITS + table[0]).alias("d"), _bits(text, _DIGITS).alias("x"), F.length(text).alias("n"))


def _windows(text: Column, masks: list[tuple[int, int]], score, by_cost: bool) -> Column:
    """All windows of a text that become a plate under one of the masks (series, number), as score, cost (0 unless by_cost),
    ord (mask and place), own_cost, removed, start, size, series. Whether a window fits is told by integer operations on bits
    of the whole text; only the state code of what fits is looked up. A long text is taken in pieces of STRIDE places."""
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(STRIDE)), lambda base: F.struct(base.alias("base"), _facts(F.substring(text, base + 1, F.lit(STRIDE + 10))).alias("bits")))

    least = min(4 + s + n for _, s, n in masks)
    shifted = lambda bits, name, shift: F.call_function("shiftright", bits[name], shift)

    def of(piece: Column) -> Column:
        bits = piece["bits"]
        places = F.when(bits["n"] >= least, F.sequence(F.lit(0), F.least(bits["n"] - least, F.lit(STRIDE - 1)))).otherwise(F.array().cast("array<int>"))
        # all masks begin with a state code and two digits
        heads = F.filter(places, lambda at: (shifted(bits, "l", bits["n"] - at - 2).bitwiseAND(F.lit(3)) == 3) & (shifted(bits, "d", bits["n"] - at - 4).bitwiseAND(F.lit(3)) == 3))
        heads = F.filter(heads, lambda at: letters(F.substring(text, piece["base"] + at + 1, F.lit(2))).isin(STATES))

        def found(at: Column, k: int, series: int, number: int) -> Column:
            size = 4 + series + number
            shift, start, removed = bits["n"] - size - at, piece["base"] + at + 1, F.length(text) - size
            cost = _cost(bits, shift, series, number)
            one = F.struct(
                score(cost, removed, size).alias("score"), (cost if by_cost else F.lit(0)).alias("cost"), (F.lit(k * 100_000) + start).alias("ord"), cost.alias("own_cost"), removed.alias("removed"), start.alias("start"),
                F.lit(size).alias("size"), F.lit(series).alias("series"),
            )
            return F.when((shift >= 0) & _fits(bits, shift, series, number), one)

        return F.flatten(F.transform(heads, lambda at: F.array_compact(F.array(*[found(at, k, s, n) for k, s, n in masks]))))

    return F.flatten(F.transform(pieces, of))


def _picked(text: Column, windows: Column) -> Column:
    """The best window; only its plate is built. A window without a series is the whole text as it is."""

    def plate(w: Column) -> Column:
        part = lambda at, n: F.substring(text, w["start"] + at, n if isinstance(n, Column) else F.lit(n))
        return F.when(w["series"] == 0, text).otherwise(F.concat(letters(part(0, 2)), digits(part(2, 2)), letters(part(4, w["series"])), digits(part(4 + w["series"], w["size"] - 4 - w["series"]))))

    best = lambda w: F.struct(F.coalesce(F.when(w.isNotNull(), plate(w)), F.lit("")).alias("plate"), F.coalesce(w["own_cost"], F.lit(-1)).alias("cost"), F.coalesce(w["removed"], F.lit(999)).alias("removed"), F.coalesce(w["start"] - 1, F.lit(-1)).alias("start"))
    return let(F.array_min(windows), best)


def parse_plate(raw: Column | str) -> Column:
    """plate, cost, removed, start: the best window of nine or ten characters, by cost + 0.25 removed -
    0.02 length, then cost, then characters removed, then shorter and earlier; no window gives '', -1, 999, -1."""
    score = lambda cost, removed, size: cost * 100 + removed * 25 - 2 * size
    return let(clean_text(raw), lambda text: _picked(text, _windows(text, [(2, 1, 4), (1, 2, 4)], score, True)))


def parse_fused(raw: Column | str) -> Column:
    """The parser of the two-line fusion: series of 1-3 letters, numbers of 1-4 digits, by cost + 0.35
    removed - 0.01 length only; a text that is a BH number is one more candidate, of score -0.1."""
    return let(clean_text(raw), _fused)


def _fused(text: Column) -> Column:
    score = lambda cost, removed, size: cost * 100 + removed * 35 - size
    masks = [(k, s, n) for k, (s, n) in enumerate(((s, n) for s in (1, 2, 3) for n in (1, 2, 3, 4)), 1)]
    whole = F.struct(*[F.lit(v).alias(c) for c, v in (("score", -10), ("cost", 0), ("ord", 9_900_000), ("own_cost", 0), ("removed", 0), ("start", 1), ("size", 10), ("series", 0))])
    bh = F.when(text.rlike(f"^{BH}$"), F.array(whole)).otherwise(F.slice(F.array(whole), 1, 0))
    return _picked(text, F.concat(_windows(text, masks, score, False), bh))


def correct_standard(raw: Column | str) -> Column:
    """plate and cost of the whole text under the twelve standard masks, first of least cost; null if none."""
    return let(clean_text(raw), _standard)


def _standard(text: Column) -> Column:
    masks = [(k, s, n) for k, (s, n) in enumerate((s, n) for s in (1, 2, 3) for n in (1, 2, 3, 4))]
    none = F.lit(0)

    def best(bits: Column) -> Column:
        found = [F.when((F.length(text) == 4 + s + n) & _fits(bits, none, s, n), F.struct(_cost(bits, none, s, n).alias("cost"), F.lit(k).alias("k"), F.lit(s).alias("s"))) for k, s, n in masks]
        return F.when(F.length(text).between(7, 11) & letters(F.substring(text, 1, 2)).isin(STATES), F.array_min(F.array(*found)))

    def built(w: Column) -> Column:
        part = lambda at, n: F.substring(text, at, n)
        plate = F.concat(letters(part(F.lit(1), F.lit(2))), digits(part(F.lit(3), F.lit(2)), TO_DIGIT_OLD), letters(part(F.lit(5), w["s"])), digits(part(5 + w["s"], F.lit(4)), TO_DIGIT_OLD))
        return F.when(w.isNotNull(), F.struct(plate.alias("plate"), w["cost"].alias("cost")))

    # bits are taken of short texts only; longer ones are none of these
    return let(let(_facts(F.substring(text, 1, 12), TO_DIGIT_OLD), best), built)


def correct_bh(raw: Column | str) -> Column:
    text = clean_text(raw)
    a, b, c, d = (F.substring(text, i, n) for i, n in ((1, 2), (3, 2), (5, 4), (9, 2)))
    plate = F.concat(digits(a, TO_DIGIT_OLD), letters(b), digits(c, TO_DIGIT_OLD), letters(d))
    cost = _count(F.concat(a, c), "A-Z") + _count(F.concat(b, d), "0-9")
    return F.when((F.length(text) == 10) & plate.rlike(f"^{BH}$"), F.struct(plate.alias("plate"), cost.alias("cost")))


def correct_plate(raw: Column | str) -> Column:
    """The cheaper of the standard and the BH correction (standard on a tie); null above a cost of 2."""

    def cheaper(s: Column, b: Column) -> Column:
        return let(F.when(s.isNotNull() & (b.isNull() | (s["cost"] <= b["cost"])), s).otherwise(b), lambda best: F.when(best["cost"] <= 2, best))

    return let(correct_standard(raw), lambda s: let(correct_bh(raw), lambda b: cheaper(s, b)))


def plausible_counts(text: Column | str) -> Column:
    """6 to 12 characters, two letters and two digits at least."""
    t = _c(text)
    return F.length(t).between(6, 12) & (_count(t, "A-Z") >= 2) & (_count(t, "0-9") >= 2)


def plausible_state(raw: Column | str) -> Column:
    """7 to 11 characters, a state code, two characters that can be digits, then letters and digits."""
    t = clean_text(raw)
    rest = F.substring(t, 5, 20)
    return F.length(t).between(7, 11) & t.rlike(f"^{STATE}[0-9OILZSBG]{{2}}") & rest.rlike("[A-Z]") & rest.rlike("[0-9]")


def format_valid(text: Column | str) -> Column:
    return _c(text).rlike(f"^[A-Z]{{2}}[0-9]{{1,2}}[A-Z]{{1,3}}[0-9]{{1,4}}$|^{BH}$")


def valid_format(raw: Column | str) -> Column:
    return clean_text(raw).rlike(f"^{STATE}[0-9]{{2}}[A-Z]{{1,3}}[0-9]{{1,4}}$|^{BH}$")


def classify(text: Column | str, confidence: Column | str) -> Column:
    return F.when(format_valid(text) & (_c(confidence) >= 0.6), "FORMAT_VALID").when(format_valid(text) | plausible_counts(text), "NEEDS_REVIEW").otherwise("REJECTED")


def attempt_score(corrected: Column, raw: Column | str, confidence: Column | str) -> Column:
    """The score of one reading: valid ones gain 0.4 less 0.08 a correction, plausible ones 0.1."""
    return _c(confidence) + F.when(corrected.isNotNull(), 0.4 - 0.08 * corrected["cost"]).when(plausible_state(raw), 0.1).otherwise(0.0)


def attempt_score_simple(text: Column | str, confidence: Column | str) -> Column:
    return _c(confidence) + F.when(format_valid(text), 0.4).when(plausible_counts(text), 0.1).otherwise(0.0)


def fusion_weight(ocr, quality, detection, cost) -> Column:
    return 0.55 * _c(ocr) + 0.25 * _c(quality) + 0.2 * _c(detection) - 0.05 * F.greatest(_c(cost), F.lit(0))


def vote_weight(ocr, quality, detection) -> Column:
    return 0.5 * _c(ocr) + 0.3 * _c(quality) + 0.2 * _c(detection)
