"""Mixing sources to target weights by temperature, in DataFrame functions only.

A source's weight is its token share to the power ``alpha``, normalised.  ``alpha`` in
[0, 1] is bisected (31 cuts an aggregation over the table of sources) until the weights
meet a target entropy; where some source would then be repeated more than allowed, it is
bisected on that limit instead, towards the natural shares.

Weights become documents as budgeted block permutations.  A source's share of the
budget is so many whole epochs and a remainder; each epoch is a permutation of the
source by a hash seeded with the epoch's number, and the last takes that permutation's
longest prefix within the remainder.  Prefixes are found by two rounds of 4096 hash
cells: token sums of cells, then of the cells of the one cell where the remainder ends,
then single documents of one such cell.  The epochs of a source, one after the other,
are then laid over all blocks: every block holds its budget of ``block_tokens`` tokens
in the target mixture, of each source its weight's part to within a document.  Places
are token sums of cells before and of documents within a cell, so a source with a third
of all rows is summed map-side and never sorted or windowed whole.

Words are counted once: the rows are written with their counts and hashes, and all but
the last pass read these alone.

Defined cases: a null source is a source of its own; null or empty texts have no tokens
and come with every epoch begun; rows that share an id are documents of their own, told
apart by the hash of all their columns (maps aside) and, where equal in these, by their
place in the written table; an empty table gives an empty result; the input's columns
may bear any names, and one named like a result (``mix_copy``, ...) comes back as
``input_mix_copy``, with more ``input_`` before it until it is free.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import _cuts

CELLS = 4096
CUTS = 31
SLOTS = 1 << 40
MADE = ("mix_copy", "mix_tokens", "mix_block", "mix_slot")


def n_words(text: Column) -> Column:
    """Words of a text, without building them; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def shares(docs: DataFrame, source: Column, tokens: Column) -> DataFrame:
    """(source, docs, tokens) of every source; partial sums come first, however large a source is."""
    return docs.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("docs"), F.sum(tokens).alias("tokens"))


def _profile(table: DataFrame, alphas: list[float]) -> list[tuple[float, float]]:
    """Entropy of the weights and the most repetition per unit of budget share, for each alpha."""
    total = table.agg(F.sum("tokens").alias("t")).first()["t"]
    p = F.col("tokens") / F.lit(float(total))
    sums = []
    for i, a in enumerate(alphas):
        w = F.pow(p, F.lit(a))
        sums += [F.sum(w).alias(f"z{i}"), F.sum(w * F.log(p) * a).alias(f"e{i}"), F.max(w / p).alias(f"r{i}")]
    row = table.where("tokens > 0").agg(*sums).first()
    return [(math.log(row[f"z{i}"]) - row[f"e{i}"] / row[f"z{i}"], row[f"r{i}"] / row[f"z{i}"]) for i in range(len(alphas))]


def find_alpha(table: DataFrame, entropy: float | None, repeats: float | None, budget_share: float, rounds: int = 5) -> float:
    """The exponent by which the weights meet ``entropy`` (a part of the largest possible
    one) without repeating a source more than ``repeats`` times.

    ``budget_share`` is the budget over all tokens.  Entropy falls and repetition too as
    alpha rises from 0 (uniform) to 1 (natural shares), so either is bisected alone.
    """

    def bisect(ok) -> float:
        lo, hi = 0.0, 1.0  # ok at hi
        for _ in range(rounds):
            at = [lo + (hi - lo) * i / (CUTS + 1) for i in range(CUTS + 2)]
            good = [ok(x) for x in _profile(table, at)]
            first = next((i for i, g in enumerate(good) if g), CUTS + 1)
            lo, hi = at[max(0, first - 1)], at[first]
        return hi

    n = table.where("tokens > 0").count()
    alpha = 1.0
    if n > 1 and entropy is not None:
        alpha = 1 - _mirror(table, entropy * math.log(n), rounds)
    if n and repeats is not None and _profile(table, [alpha])[0][1] * budget_share > repeats:
        alpha = max(alpha, bisect(lambda x: x[1] * budget_share <= repeats))
    return alpha


def _mirror(table: DataFrame, target: float, rounds: int) -> float:
    """Least ``1 - alpha`` at which the entropy reaches the target."""
    lo, hi = 0.0, 1.0
    for _ in range(rounds):
        at = [lo + (hi - lo) * i / (CUTS + 1) for i in range(CUTS + 2)]
        reach = [h >= target - 1e-12 for h, _ in _profile(table, [1 - x for x in at])]
        first = next((i for i, g in enumerate(reach) if g), CUTS + 1)
        lo, hi = at[max(0, first - 1)], at[first]
    return hi


def plan(table: DataFrame, alpha: float, budget: float, cover: bool = False) -> DataFrame:
    """source, docs, tokens, weight, whole epochs and the remainder in tokens; with
    ``cover`` every source is whole at least once, however the floats are rounded."""
    total = table.agg(F.sum(F.pow("tokens", F.lit(alpha))).alias("z")).first()["z"] or 1.0
    w = table.where("tokens > 0").withColumn("weight", F.pow("tokens", F.lit(alpha)) / F.lit(float(total)))
    # whole tokens: sums are then equal however they are grouped
    w = w.withColumn("quota", F.floor(F.col("weight") * F.lit(float(budget)) + F.lit(1e-6)).cast("long"))
    if cover:
        w = w.withColumn("quota", F.greatest("quota", "tokens"))
    w = w.withColumn("epochs", F.floor(F.col("quota") / F.col("tokens")).cast("int"))
    w = w.withColumn("rest", F.col("quota") - F.col("epochs") * F.col("tokens"))
    none = table.where("tokens = 0 or tokens is null").select("*", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("quota"), F.lit(1).alias("epochs"), F.lit(0).cast("long").alias("rest"))
    return w.unionByName(none)


def mix(docs: DataFrame, source: str = "source", tokens: Column | None = None, entropy: float | None = 0.95, repeats: float | None = 4.0,
        budget: float | str = "tokens", seed: int = 0, block_tokens: int = 1 << 20, laid: bool = True) -> DataFrame:
    """The input's columns, for every copy of a document that the mixture holds, with
    ``mix_copy`` (its epoch), ``mix_tokens``, ``mix_block`` and ``mix_slot``: in order of
    block and slot, sources alternate by their weights.

    ``budget`` is a number of tokens, ``"tokens"`` for as many as the input has, or
    ``"cover"`` for the least at which every source comes whole once.  Without ``laid`` the
    same copies come with ``mix_copy`` and ``mix_tokens`` alone: for those who order them otherwise, no text moves.
    """
    names = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    text = F.col("row.text") if "text" in names else F.lit(None).cast("string")
    count = tokens if tokens is not None else n_words(text)
    apart = [F.col(f"row.`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    rows = rows.withColumns({"source": F.col(f"row.`{source}`"), "tokens": F.coalesce(count, F.lit(0)).cast("long"), "id": F.xxhash64(F.lit(seed), *apart)})
    whole = [F.col(f"row.`{c}`").alias(f"in{i}") for i, c in enumerate(names)]
    rows = _cuts.written(rows.select("source", "tokens", "id", F.monotonically_increasing_id().alias("place"), *whole))
    table = _cuts.written(shares(rows, F.col("source"), F.col("tokens")))
    total = table.agg(F.sum("tokens")).first()[0] or 0
    share = 1.0
    if isinstance(budget, (int, float)):
        share = budget / max(1, total)
    alpha = find_alpha(table, entropy, repeats, share) if total else 1.0
    if budget == "cover" and total:
        # the source repeated least sets the budget: once; the limit is then relative to it
        def spread(a: float) -> tuple[float, float]:
            row = table.where("tokens > 0").agg(F.sum(F.pow("tokens", F.lit(a))).alias("z"), F.max(F.pow("tokens", F.lit(1 - a))).alias("m"), F.min(F.pow("tokens", F.lit(1 - a))).alias("l")).first()
            return row["z"] * row["m"], row["m"] / row["l"]
        if repeats is not None and spread(alpha)[1] > repeats:
            lo, hi = alpha, 1.0
            for _ in range(20):
                mid = (lo + hi) / 2
                lo, hi = (lo, mid) if spread(mid)[1] <= repeats else (mid, hi)
            alpha = hi
        amount = spread(alpha)[0]
    else:
        amount = float(total if budget in ("tokens", "cover") else budget)
    quota = _cuts.written(plan(table, alpha, amount, budget == "cover").withColumn("sid", F.monotonically_increasing_id()))
    # the last epoch's order of a source: cells, cells of a cell, documents of such a cell
    side = quota.select(F.col("source").alias("s"), "sid", "epochs", "rest")
    rows = rows.join(F.broadcast(side) if _small(side) else side, F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
    rows = rows.withColumn("h", F.xxhash64("id", F.lit(seed + 1), F.col("epochs")))
    rows = rows.withColumns({"c1": _cell("h", 52), "c2": _cell("h", 40)})
    light = rows.select("sid", "tokens", "epochs", "rest", "h", "id", "place", "c1", "c2")
    first = _cuts.written(_edge(light, "c1", F.col("rest"), "1"))
    second = _cuts.written(_edge(_join(light, first).where("c1 = e1"), "c2", F.col("r1"), "2"))
    last = _join(_join(light, first).where("c1 = e1"), second).where("c2 = e2")
    order = Window.partitionBy("sid").orderBy(F.struct("h", "place")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    third = last.withColumn("upto", F.sum("tokens").over(order)).where("upto <= r2").groupBy("sid").agg(F.max(F.struct("h", "place")).alias("e3"))
    third = _cuts.written(third)

    def copies(of: DataFrame) -> DataFrame:
        of = _join(_join(_join(of, first, "left"), second, "left"), third, "left")
        inner = (F.col("c2") < F.col("e2")) | ((F.col("c2") == F.col("e2")) & (F.struct("h", "place") <= F.col("e3")))
        within = (F.col("c1") < F.col("e1")) | ((F.col("c1") == F.col("e1")) & inner)
        n = F.col("epochs") + F.when((F.col("rest") > 0) & F.coalesce(within, F.lit(False)), 1).otherwise(0)
        of = of.withColumn("mix_copy", F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))))
        of = of.withColumn("turn", F.xxhash64("id", F.lit(seed + 2), F.col("mix_copy")))
        return of.withColumn("cell", _cell("turn", 52))

    if not laid:
        return copies(rows).select(*(F.col(f"in{i}").alias(c) for i, c in enumerate(_free(names))), "mix_copy", F.col("tokens").alias("mix_tokens"))
    # epochs one after the other, each in the order of its turns: token sums before every cell
    cells = copies(light).groupBy("sid", "mix_copy", "cell").agg(F.sum("tokens").alias("tokens"))
    along = Window.partitionBy("sid").orderBy("mix_copy", "cell")  # at most CELLS rows an epoch of a source
    before = F.coalesce(F.sum("tokens").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumns({"before": before, "all": F.sum("tokens").over(Window.partitionBy("sid"))}).drop("tokens")
    cells = _cuts.written(cells)
    blocks = max(1, math.ceil(amount / block_tokens))
    mixed = copies(rows).join(cells, ["sid", "mix_copy", "cell"])
    inside = Window.partitionBy("sid", "mix_copy", "cell").orderBy("turn", "place").rowsBetween(Window.unboundedPreceding, -1)
    at = (F.col("before") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))) / F.greatest("all", F.lit(1)) * blocks
    mixed = mixed.withColumn("at", at).withColumn("mix_block", F.least(F.floor("at"), F.lit(blocks - 1)).cast("long"))
    slot = ((F.col("at") - F.col("mix_block")) * SLOTS).cast("long")
    return mixed.select(
        *(F.col(f"in{i}").alias(c) for i, c in enumerate(_free(names))),
        "mix_copy", F.col("tokens").alias("mix_tokens"), "mix_block", slot.alias("mix_slot"),
    )


def _free(names: list[str]) -> list[str]:
    """The input's names, those of results told apart."""
    out: list[str] = []
    for name in names:
        c, held = name, {*MADE, *map(str.lower, [*names, *out])} - {name.lower()}
        while c.lower() in MADE or (c != name and c.lower() in held):
            c = "input_" + c
        out.append(c)
    return out


def _cell(name: str, shift: int) -> Column:
    return F.shiftrightunsigned(name, shift).bitwiseAND(F.lit(CELLS - 1).cast("long"))


def _small(table: DataFrame, limit: int = 10_000) -> bool:
    """Whether a table of sources may be broadcast: its rows are counted."""
    return table.limit(limit + 1).count() <= limit


def _join(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """Rows with their source's line of a table that has at most one a source, broadcast where it is small."""
    return rows.join(F.broadcast(table) if _small(table) else table, "sid", how)


def _edge(rows: DataFrame, cell: str, rest: Column, name: str) -> DataFrame:
    """For each source: the cell ``e`` in which the remainder ends, and what is left for it, ``r``."""
    sums = rows.groupBy("sid", cell).agg(F.sum("tokens").alias("tokens"), F.max(rest).alias("rest"))
    order = Window.partitionBy("sid").orderBy(cell)  # at most CELLS rows a source
    sums = sums.withColumn("upto", F.sum("tokens").over(order))
    left = F.col("rest") - F.col("upto") + F.col("tokens")
    over = sums.where(F.col("upto") > F.col("rest")).groupBy("sid").agg(F.min(F.struct(F.col(cell).alias("edge"), left.alias("left"))).alias("x"))
    return over.select("sid", F.col("x.edge").alias("e" + name), F.col("x.left").alias("r" + name))
