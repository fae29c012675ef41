"""SimHash near-duplicates by a self-join of binary tries.

A document's fingerprint has bit i set if bit i is set in over half of the XXH64 values (seed 42) of its word
shingles. It has one or more lanes of 64 bits; a further lane's hashes are mixed from the first lane's. Two
fingerprints link if at most `budget` of their bits differ; a component is what links reach.

The join. Fingerprints that differ in at most `budget` bits differ in at most b = budget div lanes in one of the lanes,
and there agree in one of b + 1 disjoint blocks of bits. So each distinct fingerprint goes to b + 1 groups (lane, mask,
masked value) a lane, and each group is a binary trie of the fingerprints in it, that lane's bits first. Pairs of trie
nodes are traversed together from the root: each step splits both nodes at the next bit, adds one to the count of
differing bits where the halves differ, and drops the pair once the count is over b in the lane or over budget. A pair
of nodes whose leaves are all of one component already is dropped too, so a dense cloud of near copies costs no pair
for each pair of its members. A group sends out at most one link for each of its members. A group of over `group_rows`
fingerprints is split again in the same way: on the bits outside its mask, two linked members agree in one of b + 1
further blocks. After `SPLITS` levels a group is solved whole, whatever its size: a level more would copy each of its
rows b + 1 times, and the trie takes a dense cloud as it is. Nothing is capped. With one lane and a budget of 4, about
26 bits are free on the last level, so a cloud whose members are up to 5 bits from its centre has at most 84,000
fingerprints in a group there.

The links of all groups meet in a large-star/small-star connected-components loop over DataFrames, cut by written
tables. A join on a star's centre is salted, so that a centre's neighbours are several tasks' work.

`op7` has one lane, four-word shingles and a budget of 4. The pipeline's stage `kept` takes five-word shingles and a
similarity of 0.8 or more: four lanes, of whose 256 bits at most SIMILAR_BITS differ. The angle between two texts'
counts of shingles is that share of 180 degrees; a Jaccard index of 0.8 has a cosine of 2 * 0.8 / 1.8 and 15.2 % of the
bits (38.8, give or take 5.7). So wide a budget leaves bit blocks of few bits, whose groups would grow with the corpus;
the stage's groups are bands of minimum hashes instead (`banded_links`), of which texts of an index of 0.8 share one
with a probability of 0.98, and the trie join runs inside them. How far that tells texts' similarity is measured in README.

The stage decides by row: a row is known by its id and its text.

Defined results: null and empty texts, and texts without a word, have fingerprint 0 and link to each other. A text of
fewer words than a shingle is one shingle. Exact copies share a fingerprint and are expanded only when ids are joined
back. Rows that repeat a doc_id keep a row each. A null doc_id is never the smallest of a component unless the
component has no other; it then has a null component_id. Extra columns are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import kit

WORDS, SEED, BUDGET, GROUP_ROWS, SPLITS, SALTS, HOT = 4, 42, 4, 4096, 4, 16, 10_000
#: The pipeline's stage: words of a shingle, lanes of a fingerprint, and how many of its bits may differ.
SIMILAR_WORDS, SIMILAR_LANES, SIMILAR_BITS = 5, 4, 43
#: Its groups: keys of this many bands of so many minima of the shingles' hashes.
BANDS, BAND_ROWS = 8, 4
#: A band's group of more fingerprints is split by bit blocks; one of fewer (64 MB of rows) is solved as it is, since a cloud of texts that are alike stays together in most blocks.
CLOUD_ROWS = 1 << 20
_ODD = np.random.default_rng(11).integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
FULL = 2**64 - 1


def shingle_hashes(text: bytes, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    w = text.translate(_FOLD).split()  # bytes.split cuts at exactly \x20 and \x09-\x0D
    joined, digest = b" ".join(w), xxhash.xxh64_intdigest
    if len(w) <= words:
        return np.array([digest(joined, seed)] if w else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.array([digest(joined[s:e], seed) for s, e in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 18):
        ones += np.unpackbits(hashes[at : at + (1 << 18)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: two sets of shingles with a Jaccard index of J share one with probability J ** BAND_ROWS."""
    least = np.full(len(_ODD), FULL, np.uint64)
    for at in range(0, len(hashes), 1 << 14):
        np.minimum(least, np.multiply.outer(hashes[at : at + (1 << 14)], _ODD).min(axis=0), out=least)
    keys = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BAND_ROWS, BANDS):
        keys = kit.mixed(keys * np.uint64(0x9E3779B97F4A7C15) + row)
    return keys.view(np.int64)


def lane_names(lanes: int) -> list[str]:
    return ["fp", *(f"fp{k}" for k in range(1, lanes))]


def _fingerprints(words: int, lanes: int, banded: bool = False):
    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in kit.slices(batches):
            data, off = kit.utf8(part.column("text"))
            raw, off = data.tobytes(), off.tolist()
            fp, keys = np.zeros((len(off) - 1, lanes), np.uint64), []
            for i, (a, b) in enumerate(zip(off, off[1:], strict=False)):
                h = shingle_hashes(raw[a:b], words)
                for k in range(lanes):
                    fp[i, k] = simhash(h if k == 0 else kit.mixed(h + np.uint64(k)))
                if banded:
                    keys.append(band_keys(h))
            more = {"bands": pa.array(keys, pa.list_(pa.int64()))} if banded else {}
            yield kit.batch(doc_id=part.column("doc_id"), **{n: fp[:, k].copy().view(np.int64) for k, n in enumerate(lane_names(lanes))}, **more)

    return made


def fingerprints(docs: DataFrame, words: int = WORDS, lanes: int = 1, banded: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed 64-bit integer) and further lanes fp1, fp2 ...; banded: and the keys of its bands."""
    docs = docs.select("doc_id", "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{n} bigint" for n in lane_names(lanes))
    return docs.mapInArrow(_fingerprints(words, lanes, banded), schema + (", bands array<bigint>" if banded else ""))


def united(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (each the least index of its component) after linking i[k] with j[k]."""
    while True:
        a, b = label[i], label[j]
        if not (a != b).any():
            return label
        label = label.copy()
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def trie_components(a: np.ndarray, budget: int = BUDGET, more: tuple[np.ndarray, ...] = (), all_bits: int | None = None, chunk: int = 1 << 17, leaf: int = 16) -> np.ndarray:
    """Component labels of sorted distinct fingerprints (uint64) under links of at most `budget` differing bits.

    more: further lanes; fingerprints are then sorted by all lanes, `budget` holds for the first lane and `all_bits` for
    all. A trie node at depth d is a range of the sorted arrays whose members share d leading bits. Node pairs are kept
    as arrays and expanded in chunks, deepest first, so memory is bounded by depth times chunk.
    """
    n, lanes = len(a), (a, *more)
    all_bits = budget if all_bits is None else all_bits
    label, sums = np.arange(n), {}
    if n < 2:
        return label
    first = (np.array([0]), np.array([n]), np.array([0]), np.array([n]), np.array([0]))
    stack = [(0, first)]
    while stack:
        depth, (l1, h1, l2, h2, err) = stack.pop()
        change = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
        one = (change[h1 - 1] == change[l1]) & (change[h2 - 1] == change[l2]) & (label[l1] == label[l2])
        keep = ~one
        l1, h1, l2, h2, err = l1[keep], h1[keep], l2[keep], h2[keep], err[keep]
        if not len(l1):
            continue
        small = (h1 - l1) * (h2 - l2) <= leaf
        if depth == 64 * len(lanes):
            small[:] = True
        if small.any():  # the remaining bits of few leaves, at once
            p, q, w = l1[small], l2[small], (h2 - l2)[small]
            row, at = kit.ragged((h1 - l1)[small] * w)
            i, j = p[row] + at // w[row], q[row] + at % w[row]
            link = (i < j) & (sum(np.bitwise_count(x[i] ^ x[j]).astype(np.int64) for x in lanes) <= all_bits)
            label = united(label, i[link], j[link])
            l1, h1, l2, h2, err = (x[~small] for x in (l1, h1, l2, h2, err))
            if not len(l1):
                continue
        if depth not in sums:
            sums[depth] = np.concatenate([[0], np.cumsum((lanes[depth // 64] >> np.uint64(63 - depth % 64)) & np.uint64(1), dtype=np.int64)])
        s = sums[depth]
        m1, m2 = h1 - (s[h1] - s[l1]), h2 - (s[h2] - s[l2])
        own = (l1 == l2) & (h1 == h2)  # a node with itself: its halves' cross pair counts once
        parts = [(l1, m1, l2, m2, err), (m1, h1, m2, h2, err), (l1, m1, m2, h2, err + 1)]
        other = tuple(x[~own] for x in (m1, h1, l2, m2, err + 1))
        new = tuple(np.concatenate([*(p[k] for p in parts), other[k]]) for k in range(5))
        keep = (new[0] < new[1]) & (new[2] < new[3]) & (new[4] <= (budget if depth < 64 else all_bits))
        new = tuple(x[keep] for x in new)
        for at in range(0, len(new[0]), chunk):
            stack.append((depth + 1, tuple(x[at : at + chunk] for x in new)))
    return label


def _blocks(mask: int, parts: int) -> list[int]:
    """The bits outside the mask, cut into `parts` runs."""
    free = [b for b in range(63, -1, -1) if not mask >> b & 1]
    return [sum(1 << b for b in x) for x in np.array_split(np.array(free), parts) for x in [x.tolist()]]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _grouped(budget: int, all_bits: int, lanes: int):
    names = lane_names(lanes)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; a group may span batches. One link for each linked member that isn't its component's first."""
        held: list[np.ndarray] = []

        def solved(rows: np.ndarray) -> np.ndarray:
            group = rows[:, :3]
            cut = np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1
            out = []
            for part in np.split(rows, cut):
                if len(part) < 2:
                    continue
                lane, mask = int(part[0, 0]), int(part[0, 1]) & FULL
                columns = np.ascontiguousarray(part[:, 4:].T).view(np.uint64)
                columns = [columns[lane] & np.uint64(~mask & FULL), *(columns[k] for k in range(lanes) if k != lane)]  # bits of the mask are equal: nothing to split on
                order = np.lexsort(columns[::-1])
                a, *more = (x[order] for x in columns)
                label = trie_components(a, budget, tuple(more), all_bits)
                moved, node = np.flatnonzero(label != np.arange(len(a))), part[order, 3]
                out.append(np.stack([node[moved], node[label[moved]]], axis=1))
            return np.concatenate(out) if out else np.zeros((0, 2), np.int64)

        def sent(rows: np.ndarray):
            e = solved(rows)
            return kit.batch(u=e[:, 0].copy(), v=e[:, 1].copy())

        for b in batches:
            rows = np.stack([np.asarray(b.column(k)).astype(np.int64) for k in ("lane", "mask", "value", "node", *names)], axis=1)
            if not len(rows):
                continue
            last = (rows[:, :3] != rows[-1, :3]).any(axis=1)
            cut = int(last.nonzero()[0][-1]) + 1 if last.any() else 0
            if cut:
                yield sent(np.concatenate([*held, rows[:cut]]))
                held = []
            elif held and (held[-1][-1, :3] != rows[0, :3]).any():
                yield sent(np.concatenate(held))
                held = []
            held.append(rows[cut:])
        if held:
            yield sent(np.concatenate(held))

    return links


def links(fps: DataFrame, budget: int = BUDGET, group_rows: int = GROUP_ROWS, lanes: int = 1) -> DataFrame:
    """Links (u, v) of distinct fingerprints (columns node and the lanes' names) that together have the components of all links."""
    names, own, masks, out = lane_names(lanes), budget // lanes, [0], None
    key = ["lane", "mask", "value"]
    zero = F.lit(0).cast("bigint")
    grouped = fps.select(F.explode(F.array(*map(F.lit, range(lanes)))).alias("lane"), zero.alias("mask"), zero.alias("value"), "node", *names)
    lane_bits = F.get(F.array(*names), F.col("lane"))
    for depth in range(1, SPLITS + 1):
        children = {m: [m | x for x in _blocks(m, own + 1) if x] for m in masks}
        options = F.create_map(*[x for m, c in children.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(y)) for y in c]))])
        grouped = grouped.select("lane", F.explode(options[F.col("mask")]).alias("mask"), "node", *names)
        grouped = kit.written(grouped.select("lane", "mask", lane_bits.bitwiseAND(F.col("mask")).alias("value"), "node", *names), "simhash-groups")
        hot = kit.written(grouped.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_rows).select(*key), "simhash-hot")
        masks = sorted({y for c in children.values() for y in c})
        more = depth < SPLITS and not hot.isEmpty() and all(bin(FULL ^ m).count("1") > 2 * (own + 1) for m in masks)
        ready = grouped.join(hot, key, "left_anti") if more else grouped
        found = ready.repartition(*key).sortWithinPartitions(*key).mapInArrow(_grouped(own, budget, lanes), "u bigint, v bigint")
        out = found if out is None else out.unionByName(found)
        if not more:
            return out
        grouped = grouped.join(hot, key, "left_semi")


def banded_links(fps: DataFrame, budget: int, group_rows: int = CLOUD_ROWS, lanes: int = 1) -> tuple[DataFrame, list[DataFrame]]:
    """Links between fingerprints (node, the lanes' names, bands) that share a band and differ in at most `budget` bits; and the tables they are read from.

    A fingerprint is in BANDS groups, whatever the corpus; only fingerprints of groups over group_rows (clouds of texts
    that are alike) go through the bit blocks of `links`, each once.
    """
    names = lane_names(lanes)
    groups = kit.written(fps.select(F.explode("bands").alias("value"), "node", *names).distinct(), "simhash-bands")
    hot = kit.written(groups.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > group_rows).select("value"), "simhash-hot-bands")
    ready = groups.join(hot, "value", "left_anti").select(F.lit(0).alias("lane"), F.lit(0).cast("bigint").alias("mask"), "value", "node", *names)
    found = ready.repartition("value").sortWithinPartitions("value").mapInArrow(_grouped(min(budget, 64), budget, lanes), "u bigint, v bigint")
    if not hot.isEmpty():
        found = found.unionByName(links(groups.join(hot, "value", "left_semi").select("node", *names).distinct(), budget, group_rows, lanes))
    return found, [groups, hot]


def met(rows: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """rows with the columns of values (one row a key). The rows of a key are dealt to SALTS tasks: a hot key is several tasks' work."""
    salts = F.explode(F.array(*map(F.lit, range(SALTS)))).alias("salt")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), F.lit(SALTS)).cast("int"))
    return salted.join(values.select("*", salts), [key, "salt"]).drop("salt")


def named(rows: DataFrame, values: DataFrame) -> DataFrame:
    """rows (a written table) with the columns of values, which has each node once and in k how many of `rows` have it. Nodes of over a HOT-th of all rows (at most HOT are) meet them by broadcast."""
    hot = F.broadcast(values.where(F.col("k") * F.lit(HOT) > F.lit(rows.count())).drop("k"))
    return rows.join(hot, "node").unionByName(rows.join(hot.select("node"), "node", "left_anti").join(values.drop("k"), "node"))


def components(edges: DataFrame) -> DataFrame:
    """(u, root): for each end of an edge, the least vertex it reaches. Large-star and small-star in turn until nothing changes.

    A star's centre may have very many neighbours: its minimum is a pre-aggregated groupBy, and the join back is one
    that Spark can split.
    """

    def stars(e: DataFrame, small: bool) -> DataFrame:
        both = e if small else e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        near = met(both, least, "u")
        if small:
            return near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    e = kit.written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    before = state(e)
    while before[0]:
        e, old = kit.written(stars(stars(e, False), True).distinct(), "stars"), e
        now = state(e)
        kit.removed(old)
        if now == before:
            break
        before = now
    return e.select("u", F.col("v").alias("root"))


def _known(own: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of own (node, first, k) with root: the component of each distinct fingerprint under the links found."""
    roots = components(found)
    return kit.written(own.join(roots, own.node == roots.u, "left").select("node", "first", "k", F.coalesce("root", "node").alias("root")), "roots")


def near_duplicates(docs: DataFrame, budget: int = BUDGET, group_rows: int = GROUP_ROWS, words: int = WORDS, lanes: int = 1) -> DataFrame:
    """doc_id, fp and further lanes, component_id: the smallest doc_id that links reach."""
    names = lane_names(lanes)
    node = F.col("fp") if lanes == 1 else F.xxhash64(*names)
    fps = kit.written(fingerprints(docs, words, lanes).withColumn("node", node), "fingerprints")
    own = kit.written(fps.groupBy("node", *names).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("k")), "distinct-fingerprints")
    known = _known(own, links(own, budget, group_rows, lanes))
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    return named(fps, met(known, least, "root").select("node", "k", "component_id")).select("doc_id", *names, "component_id")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(kit.documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def kept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component one row stays, that with its smallest doc_id (of several, that whose text has the least hash); rows without an id stay.

    Rows that repeat an id are judged each by its own text: what happens to one says nothing of the others.
    """
    names, key = docs.columns, max(docs.columns, key=len) + "_key"
    lanes = lane_names(SIMILAR_LANES)
    # A row is known by its id and text: an id that carries the text's hash, so that each text has its own fingerprint row.
    row = F.struct("doc_id", F.xxhash64("text").alias("key"))
    fps = fingerprints(docs.where("doc_id is not null").select(F.to_json(row).alias("doc_id"), "text"), SIMILAR_WORDS, SIMILAR_LANES, banded=True)
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, key bigint"
    fps = fps.withColumn("node", F.xxhash64(*lanes)).withColumn("doc_id", F.from_json("doc_id", kind))
    fps = kit.written(fps.groupBy("doc_id", "node", *lanes).agg(F.count(F.lit(1)).alias("rows"), F.first("bands").alias("bands")), "fingerprints")
    own = kit.written(fps.groupBy("node").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("k")), "distinct-fingerprints")
    found, tables = banded_links(fps, SIMILAR_BITS, lanes=SIMILAR_LANES)
    known = _known(own, found)
    stays = known.groupBy("root").agg(F.min("first").alias("stays"))
    judged = named(fps, met(known, stays, "root").select("node", "k", "stays")).where("doc_id <> stays or rows > 1")
    judged = kit.written(judged.select("doc_id.*", F.col("doc_id").alias("row"), "stays").selectExpr("doc_id as judged_id", "key as judged_key", "row = stays as again"), "near-duplicates")
    for table in (fps, own, known, *tables):
        kit.removed(table)
    keyed = docs.withColumn(key, F.xxhash64("text"))
    same = (F.col("doc_id") == F.col("judged_id")) & (F.col(key) == F.col("judged_key"))
    again = judged.where("again")
    rest = keyed.join(judged.where("not again"), same, "left_anti")
    if again.isEmpty():
        return rest.select(names)
    # Of equal rows, and of rows of one id and text, one by one: the least hash of all columns, then any of the equal ones.
    one = rest.join(again, same, "left_semi").groupBy("doc_id", key).agg(F.min_by(F.struct(*[F.col(c) for c in names]), F.xxhash64(*names)).alias("row")).select("row.*")
    return rest.join(again, same, "left_anti").select(names).unionByName(one)
