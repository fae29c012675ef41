"""Document fingerprints by invertible Bloom lookup sketches, in SQL functions alone.

A text's paragraphs have 64-bit digests; repeated ones count once. They end at line breaks and at sentence ends of any
script, a rule that looks only at the text around it; a full stop that a lower-case letter follows, as after an
abbreviation, ends none. A sketch has three tables of cells; a digest goes into one cell of each, as a count, an XOR of
digests and an XOR of the digests' own hashes. Two sketches of one size subtract cell by cell, which leaves the digests
of only one of them. Peeling then finds cells that hold a single digest (count +-1 and a matching hash), takes this
digest out of its other cells, and goes on until all cells are empty: the differing digests are recovered, with their
sides.

A fingerprint is the number of its digests and a row of stripes, one sketch each, chosen by bits of the digest; there
is about one stripe for LOAD digests, so cost grows with the number of paragraphs rather than with its square. A stripe
has 3 * WIDTH cells; where these do not peel to its own digests, it is sketched four times as large, and so on. So a
fingerprint always lists its digests. `likeness` takes two fingerprints and nothing else (`parsed` reads a stored one):
stripes of one size subtract and peel; where peeling fails, or sizes differ, both stripes are listed and laid out four
times as large, until the difference peels. A fingerprint of fewer stripes than the other is laid out anew with as
many. With D differing digests of n and m, likeness is (n + m - D) / (n + m + D), the Jaccard index of the sets.

`with_next` gives each document the next one in descending doc_id without a global sort: ids are cut into ranges of
about equal numbers of rows by two levels of quantiles (`ranged`), a range's first document is copied to the end of the
range before, and one window runs inside each range. Rows that share one id over several ranges, and null ids, are
dealt out by a hash of their text, which is also the order in which they follow each other.

Defined results: null is the empty text, which has no paragraphs; two texts without paragraphs are alike (1), one
alone is unlike (0). Documents that repeat a doc_id follow each other in order of a hash of their text; null ids come
last. The next document after the last is the first, and a lone document is its own next. Copies of one text under one
id share a range. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import kit

WIDTH, LOAD, LEVELS, ROUNDS, EARLY = 8, 8, 7, 16, 3
#: Rows of a range, as aimed at, and ranges of each of the two levels at most: a million ranges in all.
RANGE_ROWS, FANOUT = 2000, 1000
# Mark, closing quotes, spaces, then a capital, an uncased letter, a digit or an opening mark; or a full-width or danda mark.
BREAKS = r"\n|[.!?…][\x22\x27\p{Pe}\p{Pf}]* +(?=[\p{Lu}\p{Lt}\p{Lo}\p{N}\p{Ps}\p{Pi}\x22\x27¿¡])|[。！？।؟۔] *"


NONE = "cast(array() as array<struct<n: int, k: bigint, h: bigint>>)"

# Expressions are SQL text: each function below takes and gives the text of one.


def digests(text: str) -> str:
    """The different paragraphs' digests, 64-bit numbers."""
    breaks = BREAKS.replace("\\", "\\\\")
    parts = f"filter(transform(split({text}, '{breaks}'), p -> trim(p)), p -> p <> '')"
    return f"array_distinct(transform({parts}, p -> xxhash64(p)))"


def _let(name: str, value: str, then: str) -> str:
    """then, in which `name` stands for value, evaluated once: the start of an empty aggregation, which copies nothing (transform copies each result, cells and all)."""
    return f"aggregate(cast(array() as array<int>), {value}, (v, i) -> v, {name} -> {then})"


def _rounds(first: str, ends: str, then: str) -> str:
    """p after at most ROUNDS rounds of `then` (of p), or where `ends` holds. The later rounds are a loop of their own: a loop copies p, arrays and all, after each round, also an idle one."""
    early, late = (f"array({', '.join(map(str, r))})" for r in (range(EARLY), range(EARLY, ROUNDS)))
    return f"aggregate(array({early}, {late}), {first}, (p, rounds) -> if({ends}, p, aggregate(rounds, p, (p, r) -> if({ends}, p, {then}))))"


def _place(h: str, table: int, width: str) -> str:
    return f"cast(shiftrightunsigned({h}, {21 * table}) & ({width} - 1) as int)"


def placed(members: str, width: str) -> str:
    """The digests with their cells in the three tables of `width` (a power of two) cells each."""
    return f"transform({members}, x -> struct(x.k as k, x.h as h, {', '.join(f'{_place("x.h", j, width)} as p{j}' for j in range(3))}))"


def sketch(placed: str, width: str) -> str:
    """The cells of one sketch, table by table: n, k, h: count, XOR of digests, XOR of hashes. placed: a name."""
    empty = "struct(0 as n, 0L as k, 0L as h)"
    cell = "if(size(m) = 1, struct(1 as n, m[0].k as k, m[0].h as h), struct(size(m) as n, aggregate(m, 0L, (s, x) -> s ^ x.k) as k, aggregate(m, 0L, (s, x) -> s ^ x.h) as h))"
    own = lambda j: _let("m", f"filter({placed}, x -> x.p{j} = c)", cell)
    table = lambda j: _let("used", f"{placed}.p{j}", f"transform(sequence(0, {width} - 1), c -> if(array_position(used, c) = 0, {empty}, {own(j)}))")
    return f"flatten(array({table(0)}, {table(1)}, {table(2)}))"


def lists(placed: str, width: str) -> str:
    """Will a sketch of these digests peel? In each round those go that are alone in one of their cells."""
    rounds = lambda first, kept: f"size({_rounds(first, 'size(p) = 0', kept)}) = 0"
    if width.isdecimal() and 3 * int(width) <= 31:  # a digest's cells as bits; in the sum, the cells used and, above them, those used twice
        bits = " | ".join(f"shiftleft(1L, x.p{j} + {j * int(width)})" for j in range(3))
        twice = f"shiftright(aggregate(p, 0L, (s, x) -> s | x | shiftleft(s & x, {3 * int(width)})), {3 * int(width)})"
        return rounds(f"transform({placed}, x -> {bits})", _let("full", twice, "filter(p, x -> x & full = x)"))
    shared = " and ".join(f"exists(p, y -> y.p{j} = x.p{j} and y.k <> x.k)" for j in range(3))
    return rounds(placed, f"filter(p, x -> {shared})")


def subtracted(a: str, b: str) -> str:
    """The cells of a less those of b, a sketch of the same size, with their places i: those that differ. a, b: names."""
    return f"transform(filter(sequence(0, size({a}) - 1), i -> {a}[i] <> {b}[i]), i -> struct(i as i, {a}[i].n - {b}[i].n as n, {a}[i].k ^ {b}[i].k as k, {a}[i].h ^ {b}[i].h as h))"


def filled(a: str) -> str:
    """The cells of a that are not empty, with their places i. a: a name."""
    return f"filter(transform({a}, (c, i) -> if(c.n = 0, null, struct(i as i, c.n as n, c.k as k, c.h as h))), c -> c is not null)"


def peeled(cells: str, width: str) -> str:
    """done, found: do the cells (of subtracted or filled, in tables of `width`) end up empty, and the recovered digests (n is +1 or -1: their side)."""
    pure = "filter(p.cells, c -> abs(c.n) = 1 and xxhash64(c.k) = c.h)"
    # Digests are told apart by hashing their numbers, on each side; structs would be compared one with another.
    at = ", ".join(f"{_place('x.h', j, 'w')} + {j} * w as i{j}" for j in range(3))
    side = lambda n: f"transform(array_distinct(filter(pure, c -> c.n = {n}).k), k -> {_let('h', 'xxhash64(k)', f'struct({n} as n, k as k, h as h, {at.replace("x.h", "h")})')})"
    one = "struct(c.i as i, c.n - m[0].n as n, c.k ^ m[0].k as k, c.h ^ m[0].h as h)"
    more = "aggregate(m, c, (s, x) -> struct(s.i as i, s.n - x.n as n, s.k ^ x.k as k, s.h ^ x.h as h))"
    less = _let("m", "filter(q, x -> x.i0 = c.i or x.i1 = c.i or x.i2 = c.i)", f"if(size(m) = 0, c, if(size(m) = 1, {one}, {more}))")
    left = f"filter(transform(p.cells, c -> {less}), c -> c.n <> 0 or c.k <> 0 or c.h <> 0)"
    step = f"if(size(q) = 0, struct(p.cells as cells, p.found as found, false as more), struct({left} as cells, concat(p.found, q) as found, true as more))"
    found = _let("pure", pure, f"flatten(array({side(1)}, {side(-1)}))")
    none = "cast(array() as array<struct<n: int, k: bigint, h: bigint, i0: int, i1: int, i2: int>>)"
    rounds = _rounds(f"struct({cells} as cells, {none} as found, true as more)", "not p.more or size(p.cells) = 0", _let("q", found, step))
    return _let("w", f"cast({width} as int)", _let("v", rounds, "struct(size(v.cells) = 0 as done, transform(v.found, x -> struct(x.n as n, x.k as k, x.h as h)) as found)"))


def _larger(first: str, then: str) -> str:
    """`then` (done, ...) of z and level, tried for level after level from `first` on until it is done."""
    return _let("least", first, f"if(least.done, least, aggregate(sequence(1, {LEVELS - 1}), least, (z, level) -> if(z.done, z, {then})))")


def listed(stripe: str) -> str:
    """The digests of a stripe: those alone in a cell, if these are all, or else what peels."""
    alone = "transform(array_distinct(transform(filter(o, c -> c.n = 1), c -> c.k)), k -> struct(1 as n, k as k, xxhash64(k) as h))"
    number = "aggregate(slice(o, 1, size(o) div 3), 0, (s, c) -> s + c.n)"
    return _let("o", stripe, _let("q", alone, f"if(size(q) = {number}, q, {peeled(filled('o'), 'size(o) div 3')}.found)"))


_STEPS = "array(" + ", ".join(str(1 << k) for k in range(30, -1, -1)) + ")"


def laid(members: str, stripes: str) -> str:
    """The row of `stripes` (a power of two) stripes of digests; each has the least size at which it lists its own digests."""
    tried = lambda width: _let("at", placed("own", width), f"if(size(at) < 2 or {lists('at', width)}, struct(true as done, {sketch('at', width)} as cells), struct(false as done, {NONE} as cells))")
    stripe = f"get(transform(array({_larger(tried(str(WIDTH)), tried(f'shiftleft({WIDTH}, 2 * level)'))}), y -> y.cells), 0)"
    # Digests in order of their stripe; each stripe's first place by halving steps.
    ordered = f"sort_array(transform({members}, x -> struct(x.k & ({stripes} - 1) as t, x.k as k, x.h as h)))"
    first = lambda t: f"aggregate(steps, 0, (lo, step) -> if(lo + step <= size(by_stripe) and get(by_stripe, lo + step - 1).t < {t}, lo + step, lo))"
    starts = _let("steps", f"filter({_STEPS}, step -> step <= size(by_stripe))", f"transform(sequence(0L, cast({stripes} as bigint)), t -> {first('t')})")
    cut = _let("start", starts, "transform(sequence(0, size(start) - 2), i -> slice(by_stripe, start[i] + 1, start[i + 1] - start[i]))")
    parts = f"if({stripes} = 1, array(transform({members}, x -> struct(0L as t, x.k as k, x.h as h))), {_let('by_stripe', ordered, cut)})"
    return f"transform({parts}, own -> {stripe})"


def fingerprint(digests: str) -> str:
    """n, stripes: of an array of digests."""
    number = f"shiftleft(1, least(cast(ceil(log(2D, greatest(size(ds) / {LOAD}D, 1D))) as int), 22))"
    return _let("ds", f"transform({digests}, d -> struct(d as k, xxhash64(d) as h))", _let("many", number, f"struct(size(ds) as n, {laid('ds', 'many')} as stripes)"))


def differing(rows: DataFrame, a: str, b: str, to: str) -> DataFrame:
    """The rows with column `to` (done, found): the digests (k) of only one of two fingerprints (n: +1 or -1), from the smallest sketches that peel.

    One projection a step: expressions nested any deeper would be too much for Spark's analyzer.
    """
    names = rows.columns
    many = f"greatest(size({a}.stripes), size({b}.stripes))"
    more = [f"if(size({x}.stripes) = {many}, null, flatten(transform({x}.stripes, s -> {listed('s')}))) as {to}_{k}" for k, x in (("la", a), ("lb", b))]
    rows = rows.selectExpr("*", f"{many} as {to}_many", *more)
    as_many = [f"if({to}_l{k} is null, {x}.stripes, {laid(f'{to}_l{k}', f'{to}_many')})" for k, x in (("a", a), ("b", b))]
    first = f"if(a = b, struct(true as done, {NONE} as found), if(size(a) = size(b), {peeled(subtracted('a', 'b'), 'size(a) div 3')}, struct(false as done, {NONE} as found)))"
    rows = rows.selectExpr(*names, *[f"{x} as {to}_x{k}" for k, x in zip("ab", as_many, strict=True)])
    rows = rows.selectExpr(*names, f"zip_with({to}_xa, {to}_xb, (a, b) -> struct(a as a, b as b, {first} as first)) as {to}_s")
    rows = rows.selectExpr(*names, f"transform({to}_s, s -> struct(s.first as first, if(s.first.done, null, {listed('s.a')}) as a, if(s.first.done, null, {listed('s.b')}) as b)) as {to}_s")
    wider = f"shiftleft({WIDTH}, 2 * level)"
    sketches = lambda then: _let("pa", placed("s.a", wider), _let("pb", placed("s.b", wider), _let("ca", sketch("pa", wider), _let("cb", sketch("pb", wider), then))))
    again = sketches(peeled(subtracted("ca", "cb"), wider))
    stripe = f"if(s.first.done, s.first, {_larger('s.first', again)})"
    rows = rows.selectExpr(*names, f"transform({to}_s, s -> {stripe}) as {to}_s")
    return rows.selectExpr(*names, f"struct(forall({to}_s, s -> s.done) as done, flatten({to}_s.found) as found) as {to}")


def likeness(rows: DataFrame, a: str, b: str, to: str) -> DataFrame:
    """The rows with column `to`: the Jaccard index of the sets of digests of the fingerprints a and b."""
    total, e = f"({a}.n + {b}.n)", f"size({to}.found)"
    index = f"if({total} = 0, 1D, ({total} - {e}) / cast({total} + {e} as double))"
    return differing(rows, a, b, to).withColumn(to, F.expr(f"if({to}.done, {index}, cast(raise_error('fingerprints that the largest sketch does not peel') as double))"))


def as_text(fp: str) -> str:
    """A fingerprint as text: n, then its stripes after '|', cells apart by spaces: count:digests:hashes, in decimal."""
    cell = "concat(c.n, ':', c.k, ':', c.h)"
    return f"concat({fp}.n, '|', array_join(transform({fp}.stripes, s -> array_join(transform(s, c -> {cell}), ' ')), '|'))"


def parsed(text: str) -> str:
    """The fingerprint that as_text wrote."""
    cell = _let("y", "split(x, ':')", "struct(cast(y[0] as int) as n, cast(y[1] as bigint) as k, cast(y[2] as bigint) as h)")
    return _let("t", f"split({text}, '[|]')", f"struct(cast(t[0] as int) as n, transform(slice(t, 2, size(t) - 1), s -> transform(split(s, ' '), x -> {cell})) as stripes)")


def _found(bounds: str, key: str, strictly: bool) -> str:
    """How many of the ascending bounds (2^20 at most) are below the key (strictly) or not above it."""
    test = f"element_at(b, lo + step) {'<' if strictly else '<='} {key}"
    steps = "array(" + ", ".join(str(1 << k) for k in range(20, -1, -1)) + ")"
    return _let("b", bounds, f"aggregate({steps}, 0, (lo, step) -> if(lo + step <= size(b), if({test}, lo + step, lo), lo))")


def _dealt(bounds: str, u: str) -> str:
    """The range (r) of a row among bounds of k. A k that is itself a bound, so has many rows, is dealt out by u over all ranges it spans; u: what is left of u inside the range."""
    at = _let("v", f"{u} * (hi - lo + 1)", _let("w", "least(cast(floor(v) as int), hi - lo)", "struct(lo + w as r, v - w as u)"))
    return _let("lo", _found(bounds, "k", True), _let("hi", _found(bounds, "k", False), at))


def _quantiles(k: str, n: int) -> Column:
    """n - 1 bounds between n ranges of about equal numbers of rows."""
    return F.percentile_approx(k, [i / n for i in range(1, n)], 10 * n) if n > 1 else F.array().cast("array<bigint>")


def ranged(rows: DataFrame) -> DataFrame:
    """The rows (with k, a bigint or null, and u, from 0 to below 1) with `range`: about RANGE_ROWS rows each, in ascending order of (k, u), null last."""
    s = rows.agg(F.count("k").alias("n"), F.count(F.lit(1)).alias("all")).first()
    parts = max(1, min(FANOUT**2, s.n // RANGE_ROWS))
    outer = math.ceil(math.sqrt(parts))
    inner = math.ceil(parts / outer)
    nulls = max(1, min(FANOUT**2, (s["all"] - s.n) // RANGE_ROWS))
    null_range = F.lit(outer * inner) + F.floor(F.col("u") * nulls).cast("int")
    bounds = rows.agg(_quantiles("k", outer).alias("b")).first().b or []
    text = ",".join(map(str, bounds))  # at most FANOUT numbers
    coarse = _dealt(f"cast(split('{text}', ',') as array<bigint>)" if bounds else "cast(array() as array<bigint>)", "u")
    rows = rows.withColumn("coarse", F.expr(f"if(k is null, null, {coarse})"))
    rows = rows.withColumn("outer", F.col("coarse.r"))
    fine = rows.where("k is not null").groupBy("outer").agg(_quantiles("k", inner).alias("inner_bounds"))  # at most FANOUT rows of FANOUT numbers
    at = F.col("outer") * inner + F.expr(f"get(transform(array({_dealt('inner_bounds', 'coarse.u')}), y -> y.r), 0)")
    return rows.join(F.broadcast(fine), "outer", "left").withColumn("range", F.when(F.col("k").isNull(), null_range).otherwise(at)).drop("outer", "coarse", "inner_bounds")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), own (its digests), next_text, next_own: those of the next document in descending doc_id, the first one after the last."""
    text = F.coalesce("text", F.lit(""))
    tie = F.xxhash64(text)
    rows = docs.select("doc_id", text.alias("text"), F.bitwise_not(F.col("doc_id").cast("bigint")).alias("k"), tie.alias("tie"))
    rows = ranged(rows.withColumn("u", F.expr("shiftrightunsigned(tie, 11) / 9007199254740992D")))
    rows = rows.withColumn("order", F.expr("struct(k is null as none, k as k, shiftrightunsigned(tie, 1) as t, tie as tie)"))
    tops = rows.groupBy("range").agg(F.min("order").alias("top"))
    # At most 2 * FANOUT ** 2 rows: where each range's first document is also needed.
    tops = tops.selectExpr("top", "coalesce(lag(range) over (order by range), max(range) over ()) as before")
    rows = rows.join(F.broadcast(tops), F.col("order").eqNullSafe(F.col("top")), "left")
    own, copy = F.struct(F.col("range"), F.lit(False).alias("copy")), F.struct(F.col("before").alias("range"), F.lit(True).alias("copy"))
    rows = rows.selectExpr("doc_id", "text", digests("text") + " as own", "order", "range", "before")
    rows = rows.select("doc_id", "text", "own", "order", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("at"))
    rows = rows.select("doc_id", "text", "own", "order", F.col("at.range").alias("range"), F.col("at.copy").alias("copy"))
    after = "over (partition by range order by copy, order)"
    rows = rows.selectExpr("doc_id", "text", "own", "copy", f"lead(text) {after} as next_text", f"lead(own) {after} as next_own")
    return rows.where("not copy").drop("copy")


def edited(docs: DataFrame) -> DataFrame:
    """The columns of with_next, n_chars, edited: the last third of the code points replaced by the next document's first ones."""
    third = F.floor(F.col("n_chars") / 3).cast("int")
    both = with_next(docs).withColumn("n_chars", F.length("text").cast("bigint"))
    return both.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - third).cast("int")), F.substring(F.col("next_text"), F.lit(1), third)))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edited(kit.documents(spark, sf_dir))
    rows = rows.selectExpr(
        "doc_id", "n_chars", "sha2(cast(edited as binary), 256) as edited_sha256",
        fingerprint("own") + " as own", fingerprint(digests("edited")) + " as changed", fingerprint("next_own") + " as other",
    )
    rows = likeness(likeness(rows, "own", "changed", "near_edited"), "own", "other", "near_next")
    return rows.selectExpr("doc_id", "n_chars", "edited_sha256", as_text("own") + " as fingerprint", as_text("changed") + " as edited_fingerprint", "near_edited", "near_next")
