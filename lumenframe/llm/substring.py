"""Removal of passages that repeat: level-wise doubling of windows of words.

Levels double up to the window: 5, 10 and 20 words. Each window of 20 is represented by the 5-word run of least hash in
it (a minimizer), so equal windows have equal runs at equal places. Runs that occur once in the corpus drop out with
all their windows; those that repeat are extended to twice their length, to 10 words inside the window, and again only
those that repeat survive; the last level judges the whole windows of what is left.

Neighbouring windows with one run on every level travel as one row (a stretch, at most 30 words): its runs' hashes, a
hash of all its words, where it starts. One shuffle by the 5-word run and one sort serve all levels, since a longer run
lies with its shorter one. On the last level stretches of the same words are settled first, all but the earliest by
(doc_id, start); of the earliest, those whose 10-word run lies in other stretches too are extended to windows, told
apart by the hashes of both halves. Hashes of words are polynomials modulo two primes (`kit.word_hashes`). Each window but the earliest of its kind covers words to remove.

A run with more than a 10,000th of all rows is hot (at most 10,000 are; they are listed in a filter): its rows go to the next
level, where longer runs spread them. What is hot on every level is settled by aggregates that combine before the
shuffle, and meets their results by broadcast.

Nothing is sampled: minimizers choose which run *represents* a window, and every window has one. What repeats inside a
slice of text is settled there, so a passage that a third of all documents share costs a row for each slice, not one
for each document or pair.

Defined results: null text has no words. Texts shorter than a window lose nothing. Equal windows at overlapping places
of one document count: the later start is removed. Rows that repeat a doc_id are judged each by its own text: windows
under one id and at one start are not earlier than each other. A null doc_id sorts before all others. Extra columns are ignored.
An empty table gives an empty result; a text that loses every word gives the empty string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm import kit

WINDOW = 20
_STEP = np.uint64(0xD6E8FEB86659FD93)


#: Levels start at this many words, or at half the window where that is odd or less.
LEAST_RUN = 5
#: A key of more than one part in HOT of a table's rows is hot; there are at most HOT such keys.
HOT = 10_000


def level_lengths(window: int) -> list[int]:
    """The lengths of the levels, each twice the one before."""
    if window < 2 or window % 2:
        raise ValueError("window: an even number of words")
    lengths = [window // 2, window]
    while lengths[0] % 2 == 0 and lengths[0] // 2 >= LEAST_RUN:
        lengths.insert(0, lengths[0] // 2)
    return lengths


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each `width` neighbouring values is (the leftmost of equal ones)."""
    place, size = np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        less = values[step:] < values[: len(values) - step]
        values = np.where(less, values[step:], values[: len(values) - step])
        place = np.where(less, place[step:], place[: len(place) - step])
        size += step
    return place


class Words:
    """Words of a slice of texts, and the hashes of runs of each level under the window (by the index of their first word)."""

    def __init__(self, part: pa.RecordBatch, window: int):
        data, off = kit.utf8(part.column("text"))
        self.levels, self.half, self.window = level_lengths(window), window // 2, window
        starts, ends, self.first = kit.spans(~kit.SPACE[data], off)
        h = kit.word_hashes(data, starts, ends)
        n = max(0, len(h) - self.levels[0] + 1)
        run = np.zeros(n, np.uint64)
        for k in range(self.levels[0]):
            run *= _STEP
            run += h[k : k + n]
        self.runs = [kit.mixed(run)]
        for length in self.levels[:-2]:
            run = self.runs[-1]
            n = max(0, len(run) - length)
            self.runs.append(kit.mixed(run[:n] * _STEP + run[length : length + n]))

    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """Row, index of the first word, windows, hashes of the runs on each level and identity of each stretch of windows with the same runs."""
        row, at = kit.ragged(np.maximum(0, np.diff(self.first) - self.window + 1))
        at += self.first[row]
        places = [_least(self.runs[0], self.window - self.levels[0] + 1)[at]]
        for length in self.levels[:-2]:  # twice the run, to its right if that stays inside the window
            places.append(places[-1] - np.where(places[-1] - at + 2 * length <= self.window, 0, length))
        head = np.ones(len(at), bool)
        head[1:] = row[1:] != row[:-1]
        for place in places:
            head[1:] |= place[1:] != place[:-1]
        i = np.flatnonzero(head)
        n, half = np.diff(np.append(i, len(at))), self.runs[-1]
        s, shape = at[i], kit.mixed(n.astype(np.uint64) << np.uint64(32) | (places[-1][i] - at[i]).astype(np.uint64))
        # Three halves cover all words of the stretch: one run of half a window lies in all its windows.
        whole = kit.mixed(kit.mixed(kit.mixed(half[s] + shape) ^ half[s + self.half]) + half[s + n - 1 + self.half])
        return row[i], s, n, [run[place[i]] for run, place in zip(self.runs, places, strict=True)], whole


def _first_in_slice(ids: pa.Array, keys: list[np.ndarray], rows: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by keys and (doc_id, start), and which in this order come after an equal key at another place."""
    code = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="min")
    key = code.to_numpy(zero_copy_only=False)[rows]
    order = np.lexsort((start, key, *keys[::-1]))
    key, start = key[order], start[order]
    head = np.ones(len(order), bool)
    head[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    lead = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    return order, (key != key[lead]) | (start != start[lead])


def _rows(ids: pa.Array, own: pa.Array, keys: dict[str, np.ndarray], same: list[str], rows: np.ndarray, start: np.ndarray, n: np.ndarray, window: int) -> Iterator[pa.RecordBatch]:
    """Of stretches (or windows: n = 1) with these keys, of which `same` tell kinds apart: the first of its kind in the slice as a row each; the others settled, as ranges of words, a row for each text."""
    if not len(rows):
        return
    order, later = _first_in_slice(ids, [keys[k] for k in same], rows, start)
    rows, start, n = (x[order] for x in (rows, start, n))
    keep = ~later
    yield kit.batch(
        **{k: x[order[keep]].view(np.int64) for k, x in keys.items()}, doc_id=ids.take(pa.array(rows[keep])), own=own.take(pa.array(rows[keep])), start=start[keep].astype(np.int32), n=n[keep].astype(np.int32),
        settled=pa.nulls(int(keep.sum()), pa.list_(pa.int32())),
    )
    if later.any():
        r, s, e = rows[later], start[later], start[later] + n[later] - 1 + window
        order = np.lexsort((s, r))
        r, s, e = r[order], s[order], e[order]
        reach = np.maximum.accumulate(r * (1 << 40) + e)  # ranges of one text that touch are one
        new = np.ones(len(r), bool)
        new[1:] = (r[1:] << 40) + s[1:] > reach[:-1]
        at = np.flatnonzero(new)
        r, s, e = r[at], s[at], reach[np.append(at[1:], len(reach)) - 1] & ((1 << 40) - 1)
        flat = np.stack([s, e], 1).ravel().astype(np.int32)
        head = np.concatenate([[0], np.flatnonzero(r[1:] != r[:-1]) + 1])
        settled = pa.ListArray.from_arrays(pa.array((np.append(head, len(r)) * 2).astype(np.int32)), pa.array(flat))
        k = len(head)
        yield kit.batch(**{x: pa.nulls(k, pa.int64()) for x in keys}, doc_id=ids.take(pa.array(r[head])), own=own.take(pa.array(r[head])), start=s[head].astype(np.int32), n=np.zeros(k, np.int32), settled=settled)


def _run_names(window: int) -> list[str]:
    return [f"run_{length}" for length in level_lengths(window)[:-1]]


def _stretches(window: int):
    names = _run_names(window)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in kit.slices(batches):
            w = Words(part, window)
            row, at, n, runs, whole = w.stretches()
            keys = dict(zip(names, runs, strict=True)) | {"whole": whole}
            yield from _rows(part.column("doc_id"), part.column("own"), keys, [names[-1], "whole"], row, at - w.first[row], n, window)

    return found


def _extended(window: int):
    """The windows of candidate stretches (column at: their starts and numbers of windows)."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in kit.slices(batches):
            w, at = Words(part, window), part.column("at")
            row = np.repeat(np.arange(part.num_rows), pc.list_value_length(at).to_numpy(zero_copy_only=False))
            flat = at.flatten()
            again, k = kit.ragged(flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64))
            row, start = row[again], flat.field("start").to_numpy(zero_copy_only=False)[again] + k
            i, half = w.first[row] + start, w.runs[-1]
            yield from _rows(part.column("doc_id"), part.column("own"), {"a": half[i], "b": half[i + w.half]}, ["a", "b"], row, start, np.ones(len(row), np.int64), window)

    return windows


def _met(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows joined with table, which has each key once and in k how many of `rows` have it. Rows of hot keys stay where they are."""
    hot = F.broadcast(table.where(F.col("k") * F.lit(HOT) > F.lit(rows.count())))
    cold = rows.join(hot.select(keys), keys, "left_anti").join(table, keys)
    return rows.join(hot, keys).unionByName(cold)


def _counted(rows: DataFrame, keys: list[str], *more) -> DataFrame:
    return rows.groupBy(keys).agg(F.count(F.lit(1)).alias("k"), *more)


def _levels(rows: DataFrame, runs: list[str]) -> DataFrame:
    """Stretches whose runs repeat on every level, with later (the same stretch occurs earlier) and kinds (different stretches that have its longest run)."""
    kind = [*runs, "whole"]
    rows = rows.repartition(runs[0]).sortWithinPartitions(*kind, "doc_id", "start")
    for k in range(len(runs)):
        rows = rows.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy(*runs[: k + 1]))).where("k > 1").drop("k")
    rows = rows.withColumn("later", F.rank().over(Window.partitionBy(*kind).orderBy("doc_id", "start")) > 1)
    return rows.withColumn("kinds", F.sum((~F.col("later")).cast("int")).over(Window.partitionBy(*runs))).select("doc_id", "own", "start", "n", "later", "kinds")


def repeated_ranges(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, own, ranges: arrays of from, to, from, to ... of words that windows cover whose words also start earlier. Only rows that have some; own tells rows of one doc_id apart (`row_key`)."""
    runs = _run_names(window)
    half = runs[-1]
    docs = docs.select("doc_id", row_key().alias("own"), "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, own bigint, start int, n int, settled array<int>"
    place = F.struct("doc_id", "start")
    first = F.min(place).alias("first")
    covers = F.array(F.col("start"), F.col("start") + F.col("n") + F.lit(window - 1)).alias("ranges")
    settled = lambda t: t.where("settled is not null").select("doc_id", "own", F.col("settled").alias("ranges"))

    stretches = kit.written(docs.mapInArrow(_stretches(window), "".join(f"{r} bigint, " for r in runs) + "whole bigint, " + schema), "stretches")
    live = stretches.where("settled is null").drop("settled")
    total, judged, small = live.count(), [], []
    for k, run in enumerate(runs):
        hot = _counted(live, [run]).where(F.col("k") * F.lit(HOT) > F.lit(total)).select(run)
        listed = ", ".join(f"{r[0]}L" for r in hot.collect())  # at most HOT numbers
        if not listed:
            judged.append(_levels(live, runs[k:]))
            break
        judged.append(_levels(live.where(f"{run} not in ({listed})"), runs[k:]))
        live = kit.written(live.where(f"{run} in ({listed})"), "hot-stretches")
        small.append(live)
    else:
        small.append(kit.written(_counted(live, [half, "whole"], first), "kinds"))
        small.append(kit.written(_counted(small[-1], [half]).withColumnRenamed("k", "kinds"), "kinds-of-runs"))
        rows = _met(live, small[-2], [half, "whole"]).withColumn("later", place != F.col("first"))
        judged.append(rows.join(F.broadcast(small[-1]), half).select("doc_id", "own", "start", "n", "later", "kinds"))  # at most HOT runs
    found = kit.written(reduce(DataFrame.unionByName, judged).where("later or kinds > 1"), "judged")
    apart = kit.written(settled(stretches), "settled")
    for table in (stretches, *small):
        kit.removed(table)

    at = found.where("not later").groupBy(F.col("doc_id").alias("at_id"), F.col("own").alias("at_own")).agg(F.collect_set(F.struct("start", "n")).alias("at"))
    extended = docs.join(at, F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("own") == F.col("at_own"))).select("doc_id", "own", "text", "at")
    windows = kit.written(extended.mapInArrow(_extended(window), "a bigint, b bigint, " + schema), "windows")
    each = windows.where("settled is null").drop("settled")
    firsts = kit.written(_counted(each, ["a", "b"], first).where("k > 1"), "window-kinds")
    later = _met(each, firsts, ["a", "b"]).where(place != F.col("first"))
    ranges = apart.unionByName(found.where("later").select("doc_id", "own", covers)).unionByName(settled(windows)).unionByName(later.select("doc_id", "own", covers))
    out = kit.written(ranges.groupBy("doc_id", "own").agg(F.collect_set("ranges").alias("ranges")), "repeated-ranges")
    for table in (found, apart, windows, firsts):
        kit.removed(table)
    return out


def covered(n: int, ranges: np.ndarray) -> np.ndarray:
    """For each of n words: is it in one of the ranges (from, to, from, to ...)?"""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, np.minimum(ranges[::2], n), 1)
    np.add.at(depth, np.minimum(ranges[1::2], n), -1)
    return np.cumsum(depth)[:-1] > 0


def _cut(part: pa.RecordBatch):
    """Of each text: its words, and which of them go (None: none). The last column has the ranges."""
    texts, ranges = part.column("text"), part.column(part.num_columns - 1)
    for i in range(part.num_rows):
        words = (texts[i].as_py() or "").encode().split()
        yield words, covered(len(words), ranges.slice(i, 1).flatten().flatten().to_numpy(zero_copy_only=False).astype(np.int64)) if ranges[i].is_valid else None


def _result():
    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in kit.slices(batches):
            n, removed, text = [], [], []
            for words, gone in _cut(part):
                n.append(len(words))
                removed.append(int(gone.sum()) if gone is not None else 0)
                text.append(b" ".join(words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
            yield kit.batch(
                doc_id=part.column("doc_id"), n_words=pa.array(n, pa.int64()), n_removed=pa.array(removed, pa.int64()),
                kept_sha256=pa.array([hashlib.sha256(t).hexdigest() for t in text], pa.string()), kept=pa.array(text, pa.binary()).cast(pa.string()),
            )

    return result


def _digest():
    result = _result()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in result(batches):
            yield b.select(["doc_id", "n_words", "n_removed", "kept_sha256"])

    return digest


def row_key() -> Column:
    """Tells rows of one doc_id apart by their texts."""
    return F.xxhash64("text")


def _with_ranges(docs: DataFrame, window: int) -> DataFrame:
    """docs and, as the last column, the ranges of words that go; no column of docs clashes with it."""
    own_id, own, key, last = (max(docs.columns, key=len) + x for x in ("_id", "_own", "_key", "_ranges"))
    ranges = repeated_ranges(docs, window).select(F.col("doc_id").alias(own_id), F.col("own").alias(own), F.col("ranges").alias(last))
    return docs.withColumn(key, row_key()).join(ranges, F.col("doc_id").eqNullSafe(F.col(own_id)) & (F.col(key) == F.col(own)), "left").drop(own_id, own, key)


def dedup(docs: DataFrame, window: int = WINDOW, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept: the words that stay, joined by one space."""
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string"
    joined = _with_ranges(docs, window)
    return joined.mapInArrow(_result(), schema + ", kept string") if texts else joined.mapInArrow(_digest(), schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(kit.documents(spark, sf_dir), texts=False)


def _shortened(names: list[str]):
    def shortened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in kit.slices(batches):
            old, text = part.column("text"), []
            for i, (words, gone) in enumerate(_cut(part)):
                whole = gone is None or not gone.any()
                text.append(old[i].as_py() if whole else b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode())
            new = {"text": pa.array(text, pa.string())}
            if "n_chars" in names:
                new["n_chars"] = pa.array([len(t) if t is not None else None for t in text], part.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([new.get(k, part.column(k)) for k in names], names=names)

    return shortened


def shortened(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without their repeated passages. A text that loses nothing stays as it was; n_chars follows the text; a text left empty goes."""
    new = _with_ranges(docs, WINDOW).mapInArrow(_shortened(docs.columns), docs.schema)
    return new.where("text is null or text <> ''") if "text" in docs.columns else new


#: op8 in DuckDB's SQL.
ORACLE_SQL = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
words as (select doc_id, generate_subscripts(ws, 1) - 1 as pos, unnest(ws) as word from w),
k as (select doc_id, pos, string_agg(word, ' ') over win as key, count(*) over win as n from words window win as (partition by doc_id order by pos rows between current row and 19 following)),
r as (select doc_id, pos, row_number() over (partition by key order by doc_id, pos) as rn from k where n = 20),
gone as (select distinct doc_id, pos + j as pos from r, range(0, 20) t(j) where rn > 1),
kept as (select words.doc_id, count(*) as n, string_agg(word, ' ' order by words.pos) as t from words anti join gone using (doc_id, pos) group by words.doc_id)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join kept using (doc_id)
"""
