"""Token and text expressions: keys, fixed lengths, windows around a mention, pairs, masks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """Words of two or more letters, digits or underscores, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]{2,})"), 1)


def spaced(text: Column) -> Column:
    """What single spaces separate, case kept."""
    return F.split(text, " ")


def entity_key(idx: Column, document_id: Column) -> Column:
    """The number behind ``curid=`` if there is one, else the trimmed id, else the document's id."""
    number = F.try_element_at(F.split(idx, "curid="), F.lit(2))
    return F.coalesce(number.try_cast("long").cast("string"), F.trim(idx), document_id)


def fixed_length(tokens: Column, length: int, first: int, last: int, pad: int = 0) -> Column:
    """``first``, as many tokens as fit, ``last``, then padding up to ``length``."""
    kept = F.slice(tokens, 1, length - 2)
    return F.concat(F.array(F.lit(first)), kept, F.array(F.lit(last)), F.array_repeat(F.lit(pad), F.lit(length - 2) - F.size(kept)))


def context_window(left: Column, mention: Column, right: Column, room: int) -> Column:
    """Tokens around a mention: the last of the left, the mention, the first of the right context.

    Each side may take half of what the mention leaves; what one side does not need goes to the other.
    """
    mention = F.slice(mention, 1, room)
    free = F.lit(room) - F.size(mention)
    half_left, half_right = F.floor(free / 2).cast("int"), (free - F.floor(free / 2)).cast("int")
    n_left, n_right = F.size(left), F.size(right)
    take_left = F.least(n_left, half_left + F.greatest(half_right - n_right, F.lit(0)))
    take_right = F.least(n_right, half_right + F.greatest(half_left - n_left, F.lit(0)))
    return F.concat(F.slice(left, n_left - take_left + 1, take_left), mention, F.slice(right, F.lit(1), take_right))


def pair(query: Column, item: Column) -> Column:
    """A query's tokens followed by an item's without its first."""
    return F.concat(query, F.slice(item, F.lit(2), F.greatest(F.size(item) - 1, F.lit(0))))


def attention(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: (t != 0).cast("int"))


def segments(tokens: Column, first_end: Column | int) -> Column:
    """1 for tokens from place ``first_end`` on that are no padding."""
    return F.transform(tokens, lambda t, i: ((i >= first_end) & (t > 0)).cast("int"))


def cycled(items: Column, n: int) -> Column:
    """A list repeated until it has ``n`` items, then cut; an empty one stays empty."""
    times = F.ceil(F.lit(n) / F.greatest(F.size(items), F.lit(1))).cast("int")
    return F.slice(F.flatten(F.array_repeat(items, times)), 1, n)


def padded_with_last(items: Column, n: int) -> Column:
    """A list whose last item is repeated up to ``n`` items."""
    return F.when(F.size(items) == 0, items).otherwise(F.concat(items, F.array_repeat(F.element_at(items, -1), F.greatest(F.lit(n) - F.size(items), F.lit(0)))))


def number_pair(text: Column) -> Column:
    """``(a,b)`` as an array of two doubles."""
    return F.transform(F.split(F.regexp_replace(text, r"[()\s]", ""), ","), lambda x: x.cast("double"))
