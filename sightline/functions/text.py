"""Column functions on recognised text: cleaning, distances, error classes, lenient casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sightline.plans.lineage import let


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_text(x: Column | str) -> Column:
    """Upper case, only A-Z and 0-9; null becomes empty."""
    return F.regexp_replace(F.upper(F.coalesce(_c(x), F.lit(""))), "[^A-Z0-9]", "")


def blank_to_empty(x: Column | str) -> Column:
    return F.coalesce(_c(x), F.lit(""))


def to_int(x: Column | str) -> Column:
    """Whole numbers as int; anything else, null included, is 0."""
    text = F.trim(_c(x))
    return F.coalesce(F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int")), F.lit(0))


def to_double(x: Column | str, default: float = 0.0) -> Column:
    return F.coalesce(_c(x).try_cast("double"), F.lit(default))


def to_bool(x: Column | str) -> Column:
    return F.lower(F.coalesce(_c(x), F.lit(""))) == "true"


def mixed_alphanumeric(x: Column | str) -> Column:
    return _c(x).rlike("[A-Z]") & _c(x).rlike("[0-9]")


def first_filled(x: Column | str, other: Column | str) -> Column:
    return F.coalesce(F.nullif(_c(x), F.lit("")), _c(other))


def contains_truth(pred: Column | str, truth: Column | str) -> Column:
    return (_c(pred) != "") & _c(pred).contains(_c(truth))


def min_fragment(x: Column | str) -> Column:
    """The shortest fragment that corroborates a text: 60 % of it, six characters at least."""
    return F.greatest(F.lit(6), F.ceil(F.lit(0.6) * F.length(_c(x)))).cast("int")


def longest_common_substring(a: Column | str, b: Column | str) -> Column:
    """The longest run of a that also stands in b; of equally long ones the first in a. Empty or null sides give an empty
    string. A fold over the characters of a, whose state is one row: how long a run ends at each place of b. So memory is
    linear in b, and long texts take the product of the lengths."""
    a, b = F.coalesce(_c(a), F.lit("")), F.coalesce(_c(b), F.lit(""))

    def folded(places: Column) -> Column:
        start = F.struct(F.array().cast("array<int>").alias("row"), F.lit(0).alias("n"), F.lit(0).alias("end"), F.lit(0).alias("i"))

        def step(state: Column, x: Column) -> Column:
            row = F.transform(places, lambda y, j: F.when(x == y, F.coalesce(F.get(state["row"], j - 1), F.lit(0)) + 1).otherwise(0))

            def longer(new: Column) -> Column:
                top = F.coalesce(F.array_max(new), F.lit(0))
                more = top > state["n"]
                return F.struct(new.alias("row"), F.when(more, top).otherwise(state["n"]).alias("n"), F.when(more, state["i"] + 1).otherwise(state["end"]).alias("end"), (state["i"] + 1).alias("i"))

            return let(row, longer)

        return F.aggregate(F.split(a, ""), start, step, lambda s: F.substring(a, s["end"] - s["n"] + 1, s["n"]))

    return F.when((a == "") | (b == ""), "").otherwise(let(F.split(b, ""), folded))


def change_status(before: Column | str, after: Column | str, pred: Column | str, truth: Column | str) -> Column:
    """EXACT, else whether an edit distance went down, up, or stayed."""
    return F.when(_c(pred) == _c(truth), "EXACT").when(_c(after) < _c(before), "IMPROVED").when(_c(after) > _c(before), "WORSE").otherwise("UNCHANGED")


def _anagram(a: Column, b: Column) -> Column:
    letters = lambda x: F.array_join(F.array_sort(F.split(x, "")), "")
    return letters(a) == letters(b)


def error_class(pred: Column | str, truth: Column | str, order_first: bool = True) -> Column:
    """What is wrong with a reading. The two engines test CHAR_ORDER_ERROR and SAME_LENGTH_CHAR_ERRORS in
    different orders, so an anagram is the former for one (order_first) and the latter for the other."""
    p, t = _c(pred), _c(truth)
    d = F.levenshtein(p, t)
    rules = [(_anagram(p, t), "CHAR_ORDER_ERROR"), (F.length(p) == F.length(t), "SAME_LENGTH_CHAR_ERRORS")]
    out = F.when(p == "", "NO_TEXT").when(p == t, "EXACT").when(p.contains(t), "GT_WITH_EXTRA_TEXT")
    for test, name in rules if order_first else rules[::-1]:
        out = out.when(test, name)
    return out.when(d <= 2, "NEAR_MATCH").otherwise("MAJOR_ERROR")


def winner(a: Column | str, b: Column | str, names: tuple[str, str]) -> Column:
    return F.when(_c(a) < _c(b), names[0]).when(_c(b) < _c(a), names[1]).otherwise("Tie")


def hard_example_labels(fp: Column | str, fn: Column | str, visible: Column | str) -> Column:
    fp, fn, visible = _c(fp), _c(fn), _c(visible)
    labels = F.array(F.when((fp > 0) & (visible == 0), "pure_hard_negative"), F.when((fp > 0) & (visible > 0), "mixed_false_positive"), F.when(fn > 0, "false_negative_positive_candidate"))
    return F.array_join(F.array_compact(labels), ";")


def round_optional(x: Column | str, places: int = 6) -> Column:
    return F.coalesce(F.round(_c(x), places).cast("string"), F.lit(""))


def source_of_augmented(name: Column | str) -> Column:
    """The source of an augmented image: what stands before _jpg.rf.<hash>.<ext> (any of three kinds), else
    the name without its extension."""
    x = _c(name)
    own = F.regexp_extract(x, r"(?i)^(.+?)_(?:jpg|jpeg|png)\.rf\.[^.]+\.(?:jpg|jpeg|png)$", 1)
    return F.coalesce(F.nullif(own, F.lit("")), F.regexp_replace(x, r"\.[^.]*$", ""))


def source_of_frame(name: Column | str) -> Column:
    """The other rule: a V_P_I_<number> anywhere, else what stands before _jpg.rf."""
    x = _c(name)
    return F.coalesce(F.nullif(F.regexp_extract(x, r"(V_P_I_\d+)", 1), F.lit("")), F.split_part(x, F.lit("_jpg.rf."), F.lit(1)))


def sample_id(number: Column | str, name: str, width: int = 4, part: Column | None = None, last: str = "", gap: str = "_") -> Column:
    """name, the part (a split, say) if any, and the number with at least `width` digits, joined by gap."""
    parts = [F.lit(name), *([part] if part is not None else []), F.format_string(f"%0{width}d", _c(number))]
    return F.concat(F.concat_ws(gap, *parts), F.lit(last))
