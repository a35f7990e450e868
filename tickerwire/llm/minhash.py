"""Near-duplicate classes by DartMinHash signatures and banding.

A text is the weighted set of its runs of five words, the weight being how
often the run occurs. Per element a Poisson process of darts lies over the
plane weight x rank, a function of the element alone; a text's darts are those
below its elements' weights. Every dart falls to one of ``COORDINATES``
coordinates, and the signature keeps the least rank of each: two texts agree
in a coordinate with the probability of their weighted Jaccard similarity. The
plane is cut into strips with a hashed number of darts each, and only the
strips up to rank t / (total weight) are opened, which costs about t darts a
text however many elements it has; texts left with an empty coordinate look
further up.

Bands of ``ROWS`` coordinates give bucket keys, and one bit of each coordinate
a sketch of the text. In each bucket whose texts lie in several components the
largest component sends one text, another each round, to be compared with the
bucket's texts of the other components: no group's pairs are multiplied out,
and a group of near copies grows together in a few rounds. What still lies
apart after ``ROUNDS`` rounds is compared without exception, in blocks: the
smaller components' texts of a bucket, ``BLOCK`` at a time, against blocks of
all the bucket's texts. A block pair is one unit of work of bounded size, and
gives back only links that join components. The verification is exact, on the
whole texts; before it, rounds pass over pairs whose sketches differ in more
than ``FAR`` of the 240 bits (at similarity 0.8 a tenth of them differ, ``FAR``
is seven standard deviations more). At similarity 0.8 a pair shares no band
with probability (1 - 0.8**6)**40 < 1e-5.

Defined results: equal texts are one node and always of one class; null counts
as the empty text; texts without words are alike only if equal; a text of
under five words is one run; a null doc_id never names a class unless all ids
of the class are null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerwire.llm.common import cut, ship, text_key
from tickerwire.llm.graph import components
from tickerwire.llm.wordhash import grams, mix, slices, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 40, 6
COORDINATES = BANDS * ROWS
ROUNDS, FAR, BLOCK = 2, 56, 128
# A text that meets more others than this is sent to several tasks.
FAN = 1000
# Expected darts of a text: leaves a coordinate empty for 2 % of the texts.
DARTS = COORDINATES * (np.log(COORDINATES) + 4)
_LOWEST = 1 / 64   # rank strips: [0, 1/64), then fourfold steps
_TABLES: dict[float, np.ndarray] = {}


def _poisson(area: float, u: np.ndarray) -> np.ndarray:
    """Counts of Poisson(area) by inversion of ``u`` in [0, 1)."""
    if area not in _TABLES:
        k = np.arange(int(area + 12 * np.sqrt(area) + 20))
        logs = -area + k * np.log(area) - np.concatenate([[0.0], np.cumsum(np.log(k[1:]))])
        _TABLES[area] = np.minimum(np.cumsum(np.exp(logs)), 1.0)
    return np.searchsorted(_TABLES[area], u, "right")


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _salt(*parts: int) -> np.uint64:
    x = 0x243F6A8885A308D3
    for p in parts:
        x = (x ^ (p + 0x9E3779B97F4A7C15)) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        x ^= x >> 29
    return np.uint64(x)


def _darts(hashes, weights, owner, reach, out) -> None:
    """Lower ``out`` (text x coordinate) to the darts of the elements; the
    texts look up to rank ``reach``."""
    limit = reach[owner]
    top = limit.max(initial=0.0)
    heaviest = weights.max(initial=0)
    low, strip = 0.0, 0
    while low < top:
        high = _LOWEST * 4.0**strip
        left, floor = 0.0, 0
        while left < heaviest:   # weight strips [0, 1), [1, 2), [2, 4), ...
            right = 2.0**floor
            at = np.flatnonzero((limit > low) & (weights > left))
            area = (high - low) * (right - left)
            seed = mix(hashes[at] ^ _salt(strip, floor))
            counts = _poisson(area, _unit(seed))
            at, seed = np.repeat(at, counts), np.repeat(seed, counts)
            if len(at):
                first = np.repeat(np.cumsum(counts) - counts, counts)
                dart = mix(seed + (np.arange(len(at)) - first + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                rank = low + _unit(mix(dart ^ np.uint64(0xA5A5A5A5A5A5A5A5))) * (high - low)
                keep = rank <= limit[at]
                if left:
                    keep &= left + _unit(mix(dart ^ np.uint64(0x3C3C3C3C3C3C3C3C))) * (right - left) <= weights[at]
                at, rank, dart = at[keep], rank[keep], dart[keep]
                np.minimum.at(out, (owner[at], (dart % np.uint64(COORDINATES)).astype(np.int64)), rank)
            left, floor = right, floor + 1
        low, strip = high, strip + 1


def signatures(sets: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Least rank per coordinate of weighted sets (element hashes, weights),
    none of them empty."""
    out = np.full((len(sets), COORDINATES), np.inf)
    total = np.array([w.sum() for _, w in sets], np.float64)
    todo, look = np.arange(len(sets)), DARTS
    while len(todo):
        hashes = np.concatenate([sets[i][0] for i in todo])
        weights = np.concatenate([sets[i][1] for i in todo])
        owner = np.repeat(np.arange(len(todo)), [len(sets[i][0]) for i in todo])
        part = np.full((len(todo), COORDINATES), np.inf)
        _darts(hashes, weights, owner, look / total[todo], part)
        out[todo] = part
        todo, look = todo[np.isinf(part).any(axis=1)], look * 2
    return out


def shingles(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(grams(words, SHINGLE), return_counts=True)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(texts x BANDS) bucket keys."""
    bits = signature.view(np.uint64).reshape(len(signature), BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0x632BE59BD9B4E019) + np.uint64(1)
    for r in range(ROWS):
        key = mix(key ^ bits[:, :, r])
    return key.view(np.int64)


def sketches(signature: np.ndarray) -> np.ndarray:
    """(texts x 4) words with one bit per coordinate."""
    bits = (mix(signature.view(np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.packbits(np.pad(bits, ((0, 0), (0, 256 - COORDINATES))), axis=1).view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc_id, text) -> (key, doc_id, bands, sketch)."""
    for batch in batches:
        for part in slices(batch, "text", 1 << 20):
            hashes, first = word_hashes(part.column("text"))
            bands: list = [None] * part.num_rows
            sketch: list = [None] * part.num_rows
            some = [i for i in range(part.num_rows) if first[i + 1] > first[i]]
            if some:
                found = signatures([shingles(hashes[first[i]:first[i + 1]]) for i in some])
                for i, k, s in zip(some, band_keys(found), sketches(found)):
                    bands[i], sketch[i] = k, s
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("doc_id"), pa.array(bands, pa.list_(pa.int64())),
                                              pa.array(sketch, pa.list_(pa.int64()))], names=["key", "doc_id", "bands", "sketch"])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two arrays of word hashes."""
    (x, n), (y, m) = shingles(a), shingles(b)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = np.minimum(n[i], m[j]).sum()
    return float(both / max(n.sum() + m.sum() - both, 1))


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "ta", 2 << 20):
                (h, f), (g, e) = word_hashes(part.column("ta")), word_hashes(part.column("tb"))
                good = [similarity(h[f[i]:f[i + 1]], g[e[i]:e[i + 1]]) >= least for i in range(part.num_rows)]
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
    return run


def common(rows: list[np.ndarray], chunk: int = 1 << 15) -> np.ndarray:
    """How many runs each two of some arrays of word hashes share, counted with
    their repeats. Only runs of several arrays are laid out, some at a time."""
    runs, owner = [], []
    for i, words in enumerate(rows):
        run, count = shingles(words)
        times = np.repeat(run, count)   # the k-th time that a run occurs is an element of its own
        nth = np.arange(len(times)) - np.repeat(np.cumsum(count) - count, count)
        runs.append(mix(times + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        owner.append(np.full(len(times), i))
    _, element, seen = np.unique(np.concatenate(runs), return_inverse=True, return_counts=True)
    owner = np.concatenate(owner)
    shared = seen[element] > 1
    number = np.cumsum(seen > 1) - 1
    column, owner = number[element[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    both = np.zeros((len(rows), len(rows)), np.float32)
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, chunk):
        a, b = np.searchsorted(column, [begin, begin + chunk])
        laid = np.zeros((len(rows), chunk), np.float32)
        laid[owner[a:b], column[a:b] - begin] = 1
        both += laid @ laid.T
    return both


def _linked(keys: list[bytes], roots: list[bytes], texts: pa.Array, least: float) -> list[tuple[bytes, bytes]]:
    """Links between texts of different components, as many as join them."""
    hashes, first = word_hashes(texts)
    rows = [hashes[first[i]:first[i + 1]] for i in range(len(keys))]
    both = common(rows)
    total = np.array([max(len(r) - SHINGLE + 1, 1 if len(r) else 0) for r in rows], np.float32)
    number = {r: i for i, r in enumerate(dict.fromkeys(roots))}
    own = np.array([number[r] for r in roots])
    top = list(range(len(number)))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i
    out = []
    near = (both >= least * (total[:, None] + total[None, :] - both) - 1e-3) & (own[:, None] < own[None, :])
    for i, j in zip(*np.nonzero(near)):
        x, y = find(own[i]), find(own[j])
        if x != y and similarity(rows[i], rows[j]) >= least:
            top[x] = y
            out.append((keys[i], keys[j]))
    return out


def _units(least: float):
    """Sorted (unit.., key, root, text) -> links; a unit's rows are held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, []

        def done() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            links = _linked(table.column("key").to_pylist(), table.column("root").to_pylist(), table.column("text").chunk(0), least)
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], names=["a", "b"])
        for batch in batches:
            if not batch.num_rows:
                continue
            units = list(zip(*(batch.column(c).to_pylist() for c in ("bucket", "i", "j"))))
            cuts = [0, *(k for k in range(1, len(units)) if units[k] != units[k - 1]), len(units)]
            for a, b in zip(cuts, cuts[1:]):
                if held and units[a] != unit:
                    yield done()
                    held = []
                unit = units[a]
                held.append(batch.slice(a, b - a).select(["key", "root", "text"]))
        if held:
            yield done()
    return run


def _close(a: str, b: str) -> Column:
    """Whether two sketches differ in few bits."""
    return sum(F.bit_count(F.get(a, k).bitwiseXOR(F.get(b, k))) for k in range(4)) <= FAR


def _pairs(df: DataFrame) -> DataFrame:
    """(a, b) of columns x and y, the smaller first, each pair once."""
    return df.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _rooted(df: DataFrame, roots: DataFrame, key: str, out: str) -> DataFrame:
    """``df`` with the component ``out`` of ``key``, itself where it has no link."""
    up = roots.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return df.join(up, F.col(key) == F.col("_node"), "left").withColumn(out, F.coalesce("_root", key)).drop("_node", "_root")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: they join components, and what belongs to
    one follows it."""
    ends = _rooted(_rooted(links, roots, "a", "x"), roots, "b", "y").where("x <> y")
    upper = cut(components(_pairs(ends)), "minhash-upper")
    below = _rooted(roots, upper, "root", "top").select("node", F.col("top").alias("root"))
    return cut(below.unionByName(upper.join(roots.select("node"), "node", "left_anti")), "minhash-roots")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """(key, class_key, class_id, n_docs) per distinct text: ``key`` is
    ``text_key`` of the text, ``class_key`` that of the class, class_id the
    smallest doc_id of the class and n_docs its number of documents."""
    ship(docs.sparkSession)
    base = docs.select(text_key(F.col(text)).alias("key"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    nodes = cut(base.mapInArrow(_sign, "key binary, doc_id long, bands array<long>, sketch array<long>").groupBy("key")
                .agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.first("bands").alias("bands"),
                     F.first("sketch").alias("sketch")), "minhash-nodes")
    rows = nodes.select("key", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    met = cut(rows.join(shared, "bucket"), "minhash-buckets", few=True)
    texts = cut(base.join(met.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text")), "minhash-texts")

    def verified(pairs: DataFrame) -> DataFrame:
        """The similar ones of ``pairs``. A text of very many pairs is sent to
        several tasks, each of which gets a share of the others."""
        often = pairs.groupBy("a").agg(F.ceil(F.count("*") / FAN).cast("int").alias("shares"))
        left = (texts.join(often, F.col("key") == F.col("a")).select("a", F.col("text").alias("ta"), "shares")
                .withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares"))
        dealt = pairs.join(often, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"))
        right = texts.select(F.col("key").alias("b"), F.col("text").alias("tb"))
        both = dealt.join(left, ["a", "share"]).join(right, "b").select("a", "b", "ta", "tb")
        return cut(both.mapInArrow(_verify(least), "a binary, b binary"), "minhash-links", few=True)

    def compared(open_: DataFrame) -> DataFrame:
        """Links of the buckets' smaller components, by blocks of texts."""
        block = lambda n: F.pmod(F.xxhash64("key"), n).cast("int")
        up = lambda n: F.sequence(F.lit(0), n - 1)
        # blocks 0.. of the smaller components' texts, then those of the largest one's
        few, many = F.ceil((F.col("n") - F.col("n_top")) / BLOCK).cast("int"), F.ceil(F.col("n_top") / BLOCK).cast("int")
        sized = open_.withColumns({"few": few, "many": many}).withColumn("is_top", F.col("root") == F.col("top_root"))
        sized = sized.withColumn("block", F.when(F.col("is_top"), F.col("few") + block(F.col("many"))).otherwise(block(F.col("few"))))
        partners = F.when(F.col("is_top"), up(F.col("few"))).otherwise(up(F.col("few") + F.col("many")))
        units = sized.select("bucket", "key", "root", "block", F.explode(partners).alias("other")).select(
            "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "root")
        laid = units.join(texts, "key").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
        return cut(laid.mapInArrow(_units(least), "a binary, b binary"), "minhash-links", few=True)

    roots = nodes.limit(0).select(F.col("key").alias("node"), F.col("key").alias("root"))
    tested = nodes.limit(0).select(F.col("key").alias("a"), F.col("key").alias("b"))
    sketch = lambda c: nodes.select(F.col("key").alias(c), F.col("sketch").alias(f"s{c}"))
    for turn in range(ROUNDS + 1):
        placed = _rooted(met, roots, "key", "root")
        heads = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.min_by("key", F.xxhash64(F.lit(turn), "key")).alias("head"))
        heads = (heads.groupBy("bucket").agg(F.max(F.struct("n", "root", "head")).alias("top"), F.sum("n").alias("n"), F.count("*").alias("parts"))
                 .where("parts > 1").select("bucket", "n", F.col("top.n").alias("n_top"), F.col("top.root").alias("top_root"), "top.head"))
        open_ = cut(placed.join(heads, "bucket"), "minhash-open")
        if open_.isEmpty():
            break
        if turn == ROUNDS:
            roots = _merged(roots, compared(open_))
            break
        new = cut(_pairs(open_.where("root <> top_root").select(F.col("head").alias("x"), F.col("key").alias("y")))
                  .join(tested, ["a", "b"], "left_anti"), "minhash-pairs")
        tested = tested.unionByName(new)
        close = new.join(sketch("a"), "a").join(sketch("b"), "b").where(_close("sa", "sb")).select("a", "b")
        roots = _merged(roots, verified(cut(close, "minhash-close")))
        met = open_.select("bucket", "key")
    placed = _rooted(nodes.select("key", "doc_id", "n"), roots, "key", "class_key")
    named = placed.groupBy("class_key").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("n_docs"))
    return cut(placed.select("key", "class_key").join(named, "class_key").select("key", "class_key", "class_id", "n_docs"), "minhash-classes")
