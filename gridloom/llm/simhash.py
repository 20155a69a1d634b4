"""SimHash near-deduplication with pivot distance tables.

A fingerprint has 64 bits.  A text's words (runs without ASCII white space, A-Z lower-cased) give
shingles of ``width`` words, repeats included; a text of fewer words is one shingle, a text without
words (null, empty, blank) has fingerprint zero.  Bit i is 1 if it is set in more than half of the
shingles' XXH64 hashes.

Texts of one fingerprint are one class.  Classes are linked when their fingerprints differ in at
most ``radius`` bits.  Before a partition's pairs are looked at, the Hamming distances of its fingerprints
to fixed reference fingerprints (pivots) are computed once into a table (filling it where it is used costs
16 bit counts a member, less than moving 16 bytes with every copy): by the triangle inequality two fingerprints within the
radius differ by at most the radius in every coordinate of that table, so pairs with a larger
difference are discarded and only survivors are verified with an exact bit count.

Distances between random fingerprints lie close together, so a pivot table alone cannot say
which pairs to look at.  Pairs are therefore taken within partitions: the bits are cut into m blocks,
and fingerprints within the radius agree on at least m - radius of them, hence share the value of
some choice of m - radius blocks.  That is exact at any m; m grows with the number of fingerprints so
that a partition stays small.  Large partitions are dealt to tiles of bounded size.  A tile gives a
spanning forest of its links, never all of its pairs, and components are found from those.

Texts whose shingle sets have a Jaccard similarity of 0.8 differ in about ten bits and in up to twenty; partitions
by bits that lose none of those would be nearly as many as there are fingerprints.  :func:`similar_groups` therefore has two kinds of partitions.  Its classes are
texts of one set of shingles (by a 64-bit digest of the sorted set; repeats do not count).

* Fingerprint partitions as above, for fingerprints within CLOSE bits; they lose none of those.
* BANDS bands of ROWS minimum hashes, for texts that are similar though their fingerprints are further apart: a pair of similarity J shares none with probability
  (1 - J^ROWS)^BANDS, at any number of texts (4e-4 at 0.8).

In either, pairs are discarded by the pivot table and bit counts at a radius that a pair of similarity 0.8 exceeds with probability below 1e-6, and by a sketch of minimum hashes at a
similarity lower by 0.25 (about 1e-4).  What is left only says which texts could belong together.  Inside each such component
texts are compared by their whole shingle sets, and only those at the similarity or above are links.  Both steps look for components, not for pairs: large
partitions and components go through :mod:`.links`, whose rows grow with the members.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, components, forest, groups, map_rows, moved, numbered, tiles, written
from .links import linear_components

PIVOTS = 16


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """The majority of each bit; whole bytes of up to 4096 hashes are unpacked at a time."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        part = hashes[k : k + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = (2 * ones > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def pivots() -> np.ndarray:
    """The reference fingerprints: hashes of 0, 1, 2, ..., the same in every run."""
    return np.array([xxhash.xxh64_intdigest(str(i), 7) for i in range(PIVOTS)], np.uint64)


SKETCH = 48
BANDS, ROWS = 20, 5
CLOSE = 3
_turns = np.random.default_rng(11).integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def minima(hashes: np.ndarray, count: int = BANDS * ROWS) -> np.ndarray:
    """The minimum of the hashes under each of ``count`` rearrangements."""
    low = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 2048):
        turned = hashes[k : k + 2048, None] * _turns[None, :count]
        low = np.minimum(low, (turned ^ (turned >> np.uint64(31))).min(0))
    return low


def packed(low: np.ndarray) -> bytes:
    places = ((low[:SKETCH] * MIX) >> np.uint64(60)).astype(np.uint8)
    return (places[::2] << 4 | places[1::2]).tobytes()


def sketch(hashes: np.ndarray) -> bytes:
    """Four bits of each of SKETCH minimum hashes, two places to a byte.

    Places of texts with Jaccard similarity J agree with probability J + (1 - J) / 16; :func:`similarity_of` takes that back.
    """
    return packed(minima(hashes, SKETCH)) if len(hashes) else bytes(SKETCH // 2)


def bands(low: np.ndarray) -> list[int]:
    """One 32-bit key for each band of minimum hashes."""
    h = np.zeros(BANDS, np.uint64)
    for column in low.reshape(BANDS, ROWS).T:
        h = (h ^ column) * MIX
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32).tolist()


def similarity_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The estimated Jaccard similarity of each row of ``a`` with the same row of ``b``, packed sketches."""
    differ = a ^ b
    agree = ((differ & 0xF0) == 0).mean(1) / 2 + ((differ & 0x0F) == 0).mean(1) / 2
    return (agree - 1 / 16) / (1 - 1 / 16)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(id, fp): the fingerprint as a signed long with the same bits."""

    def make():
        def step(x):
            return {"id": x["_i"], "fp": [signed(fingerprint(shingle_hashes(t, width))) for t in x["_t"]]}

        return step

    return map_rows(docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("_t")), make, "id long, fp long")


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(row, id, node, fp, sketch, bands) of numbered documents; node is the digest of the set of shingles, fp its fingerprint."""

    def make():
        def step(x):
            out = {"row": x["_row"], "id": x["_i"], "node": [], "fp": [], "sketch": [], "bands": []}
            for text in x["_t"]:
                hashes = np.unique(shingle_hashes(text, width))
                low = minima(hashes)
                for name, value in (("node", signed(xxhash.xxh64_intdigest(hashes.tobytes(), 42))), ("fp", signed(fingerprint(hashes))), ("sketch", packed(low)), ("bands", bands(low))):
                    out[name].append(value)
            return out

        return step

    return map_rows(docs.select("_row", F.col(id_col).alias("_i"), F.col(text_col).alias("_t")), make, "row string, id long, node long, fp long, sketch binary, bands array<int>")


def distance_table(fp: np.ndarray) -> np.ndarray:
    """The pivot distance table of some fingerprints: one row each, one column for each pivot."""
    return np.bitwise_count(fp[:, None] ^ pivots()[None, :]).astype(np.int8)


def blocks_for(count: int, radius: int, bits: int = 64) -> int:
    """The number of blocks at which a partition of random fingerprints has a few dozen members."""
    m = radius + 1
    while m < 4 * radius and count >> (bits * (m - radius) // m) > 64:
        m += 1
    return m


def partition_keys(m: int, radius: int) -> list[int]:
    """Masks of all choices of m - radius of the m blocks."""
    edges = [64 * i // m for i in range(m + 1)]
    block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(m)]
    return [sum(block[i] for i in chosen) for chosen in combinations(range(m), m - radius)]


def near(dist_a: np.ndarray, fp_a: np.ndarray, dist_b: np.ndarray, fp_b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs within the radius: discarded by the pivot table, verified by bit counts."""
    alive = np.abs(dist_a[:, None, 0] - dist_b[None, :, 0]) <= radius
    i, j = np.nonzero(alive)
    for c in range(1, dist_a.shape[1]):
        stay = np.abs(dist_a[i, c] - dist_b[j, c]) <= radius
        i, j = i[stay], j[stay]
    stay = np.bitwise_count(fp_a[i] ^ fp_b[j]) <= radius
    return i[stay], j[stay]


def mask_keys(masks: list[int]) -> Column:
    """The partitions of a fingerprint: its bits under each mask."""
    return F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(mask))).alias("v")) for k, mask in enumerate(masks)])


def near_links(classes: DataFrame, keys: Column, radius: int, block: int = 400) -> DataFrame:
    """(a, b): links that connect what is within the radius, from ``classes(id, fp)`` by partitions."""
    dealt = classes.select("id", "fp", F.explode(keys).alias("p")).select("id", "fp", F.col("p.k").alias("k"), F.col("p.v").alias("v"))
    dealt = tiles(dealt, ["k", "v"], F.xxhash64("id"), block)

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        for t in groups(batches, ["k", "v", "ti", "tj"]):
            if len(t) < 2:
                continue
            ids, fp = t["id"].to_numpy(), t["fp"].to_numpy().view(np.uint64)
            dist = distance_table(fp)
            ti, tj = t["ti"][0].as_py(), t["tj"][0].as_py()
            if ti == tj:
                x = y = np.arange(len(ids))
            else:
                part = t["part"].to_numpy()
                x, y = np.flatnonzero(part == ti), np.flatnonzero(part == tj)
            i, j = near(dist[x], fp[x], dist[y], fp[y], radius)
            i, j = x[i], y[j]
            if len(i):
                root = forest(len(ids), i, j)
                moved = np.flatnonzero(root != np.arange(len(ids)))
                a.append(ids[moved])
                b.append(ids[root[moved]])
            if len(a) > 500:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return dealt.select("k", "v", "ti", "tj", "part", "id", "fp").mapInArrow(links, "a long, b long")


def possible_pairs(t: pa.Table, radius: int, agree: float) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a tile that could be similar: within the radius by pivot table and bit count, and alike enough in their sketches."""
    fp = t["fp"].to_numpy().view(np.uint64)
    dist = distance_table(fp)
    marks = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(len(fp), SKETCH // 2)
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k in range(0, len(fp), 256):  # rows that follow suffice
        i, j = near(dist[k : k + 256], fp[k : k + 256], dist[k:], fp[k:], radius)
        i, j = i[i < j] + k, j[i < j] + k
        for q in range(0, len(i), 20_000):
            stay = similarity_of(marks[i[q : q + 20_000]], marks[j[q : q + 20_000]]) >= agree
            a.append(i[q : q + 20_000][stay])
            b.append(j[q : q + 20_000][stay])
    return np.concatenate(a), np.concatenate(b)


def possible_groups(classes: DataFrame, radius: int, agree: float, block: int = 400) -> DataFrame:
    """(node, component): which of ``classes(id, fp, sketch, bands)`` could be similar, directly or over others."""
    masks = partition_keys(blocks_for(classes.count(), CLOSE), CLOSE)
    keys = F.concat(F.transform("bands", lambda v, k: F.struct(k.alias("k"), v.cast("long").alias("v"))), F.transform(mask_keys(masks), lambda s: F.struct((s["k"] + BANDS).alias("k"), s["v"].alias("v"))))
    rows = classes.select("id", "fp", "sketch", F.explode(keys).alias("p")).select(F.col("p.k").alias("k"), F.col("p.v").alias("v"), "id", "fp", "sketch")
    rows = written(rows, "dealt")  # read several times, and more often when some partition is large
    return linear_components(rows, ["k", "v"], lambda t: possible_pairs(t, radius, agree), block)


def named(rows: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, fp, component) of rows(id, fp) by the components of their fingerprints' classes."""
    roots = components(links)
    found = classes.join(roots, classes["id"] == roots["node"], "left").select("fp", F.coalesce("component", "id").alias("component"))
    return rows.join(found, "fp").select("id", "fp", "component")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int = 3) -> DataFrame:
    """(id, fp, component): the smallest id that near-duplicate links reach, itself included.

    Rows with a null id belong to the component of their fingerprint; if no other row has it, to none.
    """
    rows = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("id").alias("id")).select("id", "fp"), "classes")
    masks = partition_keys(blocks_for(classes.count(), radius), radius)
    return named(rows, classes, near_links(classes.where("id IS NOT NULL"), mask_keys(masks), radius))


def similar_pairs(sets: list[np.ndarray], similarity: float, chunk: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs of sets whose Jaccard similarity is ``similarity`` or more, counted in full."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, symbol, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[symbol] > 1  # the others only count for the sizes
    symbol, owner = (np.cumsum(count > 1) - 1)[symbol[shared]], owner[shared]
    order = np.argsort(symbol, kind="stable")
    symbol, owner = symbol[order], owner[order]
    both = np.zeros((n, n), np.float32)
    for low in range(0, int(symbol[-1]) + 1 if len(symbol) else 0, chunk):
        a, b = np.searchsorted(symbol, [low, low + chunk])
        has = np.zeros((n, min(chunk, int(symbol[b - 1]) + 1 - low)), np.float32)
        has[owner[a:b], symbol[a:b] - low] = 1
        both += has @ has.T
    union = sizes[:, None] + sizes[None, :] - both.astype(np.float64)
    return np.nonzero(np.triu(both >= similarity * union - 1e-6, 1))


def verified_groups(sets: DataFrame, similarity: float, block: int = 300_000, least: int = 400) -> DataFrame:
    """(node, component): what is similar, directly or over others, of ``sets(component, id, shingles)``, by whole sets.

    A tile has about ``block`` shingles, where a set counts as ``least`` of them at least: so many sets of any length fit in memory.
    """
    pairs = lambda t: similar_pairs([np.frombuffer(s, np.uint64) for s in t["shingles"].to_pylist()], similarity)
    return linear_components(sets, ["component"], pairs, block, F.greatest(F.length("shingles") / 8, F.lit(least)))


def similar_rows(docs: DataFrame, id_col: str, text_col: str, width: int, similarity: float, radius: int) -> DataFrame:
    """(row, id, fp, first) of numbered documents: first is the (id, row) that leads the group, null ids last."""
    rows = written(shingle_sets(docs, id_col, text_col, width), "fingerprints")
    classes = rows.groupBy("node").agg(F.min("row").alias("row"), *[F.first(c).alias(c) for c in ("fp", "sketch", "bands")])
    classes = written(classes.withColumnRenamed("node", "id"), "classes")
    possible = possible_groups(classes, radius, similarity - 0.25)
    asked = written(possible.join(classes.select(F.col("id").alias("node"), F.col("row").alias("_row")), "node"), "possible")

    def make():
        def step(x):
            return {"component": x["component"], "id": x["node"], "shingles": [np.unique(shingle_hashes(t, width)).tobytes() for t in x["_t"]]}

        return step

    texts = docs.select("_row", F.col(text_col).alias("_t")).join(moved(asked), "_row")
    sets = written(map_rows(texts.select("node", "component", "_t"), make, "component long, id long, shingles binary"), "sets")
    roots = verified_groups(sets, similarity)
    found = rows.select("row", "id", "fp", "node").join(roots, "node", "left").select("row", "id", "fp", F.coalesce("component", "node").alias("group"))
    found = written(found, "similar")
    lead = found.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first"))
    return found.join(lead, "group").select("row", "id", "fp", "first")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, radius: int = 28) -> DataFrame:
    """(id, fp, component) by links of texts whose shingle sets have that Jaccard similarity or more; component is the smallest id."""
    return similar_rows(numbered(docs), id_col, text_col, width, similarity, radius).select("id", "fp", F.col("first.id").alias("component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, radius: int = 28) -> DataFrame:
    """One document of each group of similar texts, that of the smallest id; columns stay as they are.

    Rows of the same id are told apart, and a null id comes last.
    """
    rows = numbered(docs)
    gone = similar_rows(rows, id_col, text_col, width, similarity, radius).where("row <> first.row").select(F.col("row").alias("_row"))
    return rows.join(moved(gone), "_row", "left_anti").select(docs.columns)


def op8(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = simhash_groups(docs, width=4, radius=4)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
