"""Array idioms shared by every text operator.

A transcript is one row, so everything derived from it stays inside that row as an
array until it is exploded: no shuffle, no window over a document, and one long or
popular document never becomes a hot partition.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

Fn = Callable[[Column], Column]


def let(value: Column, body: Fn) -> Column:
    """Bind ``value`` once and use it many times in ``body``."""
    return F.transform(F.array(value), body).getItem(0)


def let_all(values: list[Column], body: Callable[..., Column]) -> Column:
    """``let`` for several values at once."""
    packed = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return let(packed, lambda s: body(*[s.getField(f"v{i}") for i in range(len(values))]))


def head(items: Column, n: int | Column) -> Column:
    if isinstance(n, int):
        return F.slice(items, 1, n)
    return F.slice(items, F.lit(1), n)


def no_blank(items: Column) -> Column:
    return F.filter(items, lambda x: x != "")


def or_empty(items: Column, ddl: str = "array<string>") -> Column:
    return F.coalesce(items, F.array().cast(ddl))


def keep_first(items: Column, key: Fn, limit: int | Column | None = None) -> Column:
    """Order-preserving dedupe on ``key``; items with an empty or null key are dropped.

    Sort by (key, position), keep the first of each run, sort back by position:
    n log n in the length of the array, and the key is computed once per item.
    """
    keyed = F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x")))
    keyed = F.filter(keyed, lambda s: F.coalesce(s["k"] != "", F.lit(False)))
    firsts = let(
        F.sort_array(keyed),
        lambda run: F.filter(
            run, lambda s, j: (j == 0) | (F.get(run, j - 1)["k"] != s["k"])
        ),
    )
    ordered = F.sort_array(
        F.transform(firsts, lambda s: F.struct(s["i"].alias("i"), s["x"].alias("x")))
    )
    kept = F.transform(ordered, lambda s: s["x"])
    return kept if limit is None else head(kept, limit)


def greedy_keep(
    items: Column,
    features: Fn,
    similar: Callable[[Column, Column], Column],
    item_ddl: str,
    feature_ddl: str,
    limit: int | None = None,
) -> Column:
    """Keep an item unless it is similar to one already kept (arrival order decides).

    ``features`` (for example the token set) is computed once per item and carried in the
    fold state.  With ``limit`` the state never grows beyond it.
    """
    state_ddl = f"array<struct<x:{item_ddl},f:{feature_ddl}>>"
    packed = F.transform(items, lambda x: F.struct(x.alias("x"), features(x).alias("f")))

    def step(kept: Column, cand: Column) -> Column:
        clash = F.exists(kept, lambda s: similar(cand["f"], s["f"]))
        if limit is not None:
            clash = (F.size(kept) >= limit) | clash
        return F.when(clash, kept).otherwise(F.concat(kept, F.array(cand)).cast(state_ddl))

    folded = F.aggregate(packed, F.array().cast(state_ddl), step)
    return F.transform(folded, lambda s: s["x"])


def best_first(items: Column, score: Fn, limit: int | Column | None = None) -> Column:
    """Stable sort by descending score."""
    keyed = F.transform(
        items, lambda x, i: F.struct((-score(x)).alias("s"), i.alias("i"), x.alias("x"))
    )
    ranked = F.transform(F.sort_array(keyed), lambda s: s["x"])
    return ranked if limit is None else head(ranked, limit)


def rows(df, items: Column, keys: list[str], value: str = "item", first: int = 1):
    """One row per array item with its position, keyed by ``keys``.

    The outer form is used on purpose: an inner explode of a column makes the optimizer
    add a size test and push it down to the scan, which computes the whole array twice.
    """
    out = df.select(*keys, F.posexplode_outer(items).alias("pos", value))
    return out.filter(F.col("pos").isNotNull()).withColumn(
        "pos", (F.col("pos") + first).cast("long")
    )


def kinds(df, lists: dict[str, Column]):
    """One row (doc_id, pos, text, kind) per item of several lists; what they are made from is computed once."""

    def tagged(items: Column, kind: str) -> Column:
        return F.transform(
            or_empty(items),
            lambda x, i: F.struct((i + 1).cast("long").alias("pos"), x.alias("text"), F.lit(kind).alias("kind")),
        )

    every = F.concat(*[tagged(items, kind) for kind, items in lists.items()])
    out = df.select("doc_id", F.explode_outer(every).alias("item"))
    return out.filter(F.col("item").isNotNull()).select("doc_id", "item.*")
