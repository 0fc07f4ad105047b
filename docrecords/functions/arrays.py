"""Small helpers over array columns.

`scan` carries state along one row's array.  It keeps per-document line work inside the row that
holds the document, so the text is never exploded, shuffled and sorted just to number its lines.
"""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHUNK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` once inside an expression, so that `body` can use it several times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(
    items: Column,
    zero: Column,
    step: Callable[[Column, Column], Column],
    emit: Callable[[Column, Column], Column],
    out_type: str,
    after: bool = False,
) -> Column:
    """Running fold over an array: for every item, emit a value from the state before it, or `after` it.

    `step(state, item)` gives the next state and `emit(state, item)` the output.  Appending to an
    array copies it, so outputs are built in chunks and flattened: the cost stays linear in the
    number of items (times the chunk length) even for a document of a million lines.
    """
    empty = F.array().cast(f"array<{out_type}>")

    def added(out: Column, value: Column) -> Column:
        return F.concat(out, F.array(value.cast(out_type))).alias("out")

    def run_item(a: Column, x: Column) -> Column:
        following = step(a["state"], x)
        if after:
            return let(following, lambda state: F.struct(state.alias("state"), added(a["out"], emit(state, x))))
        return F.struct(following.alias("state"), added(a["out"], emit(a["state"], x)))

    def run_chunk(acc: Column, chunk: Column) -> Column:
        return F.aggregate(
            chunk,
            F.struct(acc["state"].alias("state"), empty.alias("out")),
            run_item,
            lambda r: F.struct(
                r["state"].alias("state"),
                F.concat(acc["out"], F.array(r["out"])).alias("out"),
            ),
        )

    nested = F.array().cast(f"array<array<{out_type}>>")

    def folded(bound: Column) -> Column:
        chunk_no = F.sequence(F.lit(0), F.floor((F.size(bound) - 1) / F.lit(_CHUNK)).cast("int"))
        chunks = F.transform(
            F.filter(chunk_no, lambda k: F.size(bound) > 0),
            lambda k: F.slice(bound, k * _CHUNK + 1, F.lit(_CHUNK)),
        )
        return F.aggregate(
            chunks,
            F.struct(zero.alias("state"), nested.alias("out")),
            run_chunk,
            lambda acc: acc["out"],
        )

    # Bound once: each chunk would else compute the items again.  Unlike `let` this does not copy the result.
    none = F.lit(None).cast(f"array<array<{out_type}>>")
    return F.flatten(F.aggregate(F.array(items), none, lambda _, bound: folded(bound)))


def replace_matches(text: Column, pattern: str, convert: Callable[[Column], Column]) -> Column:
    """Replace every match of `pattern` by `convert(match)`; what lies between stays as it is.

    `regexp_replace` takes only a template; this is its form with a function.
    """

    def rebuilt(bound: Column) -> Column:
        between = F.split(bound, pattern, -1)
        found = F.regexp_extract_all(bound, F.lit(pattern), F.lit(0))
        pieces = F.zip_with(
            between, found, lambda b, m: F.concat(b, F.coalesce(convert(m), F.lit("")))
        )
        return F.array_join(pieces, "")

    return let(text, rebuilt)
