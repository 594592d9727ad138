"""Near-duplicates by one-permutation MinHash with optimal densification.

Each text's set of five-word shingles is hashed once; the hash's leading part names one
of K bins and the least hash of a bin is its value. An empty bin takes the value of a bin
that a sequence of hashes of its own number finds first (Shrivastava, 2017). Bands of
values make buckets. A bucket is a star: its most popular member, by how many others
share buckets with it, is compared with each other member: on sizes, on one byte of each
value, and if enough of them agree on the full sets. Further rounds take a new centre in
each bucket whose members still lie in several components, as long as a tenth of the pairs
compared are links.

Stars alone lose links between members that are no centres, and the bytes some pairs. So
all members of buckets that still lie in several components are then joined exactly: with
the shingles in one order, the least common first, two sets alike enough have one in
common among the first few of both (prefix filter; Xiao and others, 2008). Long lists of
such a shingle are first taken as stars, so that dense groups are one component before;
then each pair of different components with a shingle in common is compared on the full
sets, unless its sizes or the places of the common shingles rule it out (an upper bound of
the overlap, which drops no link).

Equal sets (by a hash of 128 bits) are one node, whose members are never paired with each
other; a node's number is a hash of 64 bits of one of its rows. A pair at the
threshold of 70 percent shares no bucket with probability (1 - 0.7**3)**32, below 2e-6; this
is the only loss. Bands are made for 70 percent and more; less is refused.

Defined results: a null, empty or blank text has an empty set and is linked with nothing;
a text of one to four words has one shingle, its whole sequence; a very long text is
hashed whole, in a run of its own; rows with equal text and any ids are one node; a node's
least id is that of its rows that have one (a null id is kept with component null only if
no row of the component has an id); rows repeated as a whole get equal results. An empty
table gives no rows. Other columns are ignored (``deduplicated``: kept).

Data sizes: texts are read once for their features and once a round; texts of pairs are
found by a bitmap of MARKS bits and shuffled, of members of unresolved buckets at most
three tenths of the shingles. A star's centre is no longer than 10/7 of a member, so pairs
move about twice their members' bytes. Pairs of the last join grow with the square of a
rare shingle's list where its texts are alike, but not enough, and in different components.
Buckets are counted with partial sums, lists are cut into parts of LIST_PART nodes, and
stars are joined with adaptive skew splitting, so one bucket may hold any share of all
rows. Nothing is broadcast but what Spark's own threshold allows, the bitmaps, and
MOST_COMMON counts of shingles, which only decide an order. ``deduplicated`` decides by two
bitmaps, of kept rows and of others; it shuffles those rows only whose bit is in both, and
repeated ones: a share that grows with the rows over MARKS. It reads docs twice for that.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm import scratch, tokens, wordvec

WORDS = 5
PERCENT = 70
BANDS, BAND_ROWS = 32, 3
BINS = BANDS * BAND_ROWS
#: A star's pairs of sets of LARGE shingles or more are compared only if as many of the BINS values agree as at the threshold, less five deviations; the others are left to the exact join.
LARGE = 200
#: A round of stars follows another if one in so many pairs compared was a link.
PRODUCTIVE = 10
#: Bits of the map that finds the texts of pairs: 8 MB.
MARKS = 1 << 26
#: Texts of pairs that are compared at once have about so many bytes.
VERIFY_BYTES = 1_000_000
#: Nodes whose shingles are counted to find the common ones, and common ones that are known.
COUNTED, MOST_COMMON = 10_000, 500_000
#: Members of a rare shingle's list up to which all pairs are compared at once, and about so many of a list are in a part.
SHORT_LIST, LIST_PART = 32, 512
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, one row after the other, and the len + 1 places where rows begin."""
    w = wordvec.words(data, offsets)
    h = wordvec.word_hashes(w, wordvec.lowered(data))
    n_rows, n_words = len(offsets) - 1, np.diff(w.first)
    values, at = wordvec.windows(h, w.row, WORDS)
    row = w.row[at]
    short = np.flatnonzero((n_words > 0) & (n_words < WORDS))
    if len(short):
        more, where = [values], [row]
        for n in range(1, WORDS):
            own = short[n_words[short] == n]
            if len(own):
                total = np.full(len(own), n, np.uint64)
                for k in range(n):
                    total = wordvec.mix(total * np.uint64(0xC4CEB9FE1A85EC53) + h[w.first[own] + k])
                more.append(total)
                where.append(own)
        values, row = np.concatenate(more), np.concatenate(where)
        order = np.argsort(row, kind="stable")
        values, row = values[order], row[order]
    first = np.searchsorted(row, np.arange(n_rows + 1))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a > 1:
            values[a:b].sort()
    if len(values):
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
        values, row = values[new], row[new]
        first = np.searchsorted(row, np.arange(n_rows + 1))
    return values, first


def signatures(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """rows x BINS least hashes, densified; rows with an empty set stay all ones."""
    n = len(first) - 1
    out = np.full((n, BINS), _EMPTY)
    if not len(values):
        return out
    row = np.repeat(np.arange(n), np.diff(first))
    cell = row * BINS + ((values >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    lead = np.ones(len(cell), bool)
    lead[1:] = cell[1:] != cell[:-1]
    out.reshape(-1)[cell[lead]] = values[lead]
    filled = out != _EMPTY
    empty = np.flatnonzero((~filled & filled.any(1)[:, None]).reshape(-1))
    flat, known, attempt = out.reshape(-1), filled.reshape(-1), 0
    while len(empty):
        bin_ = empty % BINS
        attempt += 1
        if attempt <= 64 * BINS:
            other = (wordvec.mix(bin_.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(BINS)).astype(np.int64)
        else:
            other = (bin_ + attempt) % BINS
        source = empty - bin_ + other
        hit = known[source]
        flat[empty[hit]] = flat[source[hit]]
        empty = empty[~hit]
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """rows x BANDS bucket keys; equal keys of two rows mean equal values in a band."""
    parts = signature.reshape(len(signature), BANDS, BAND_ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts.shape[:2]).copy()
    for k in range(BAND_ROWS):
        key = wordvec.mix(key * np.uint64(0xFF51AFD7ED558CCD) + parts[:, :, k])
    return key


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens.forget()
    for batch in batches:
        data, offsets = wordvec.buffers(batch.column(2))
        for a, b in wordvec.runs(offsets):
            values, first = sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            signature, size = signatures(values, first), np.diff(first)
            keys = band_keys(signature).view(np.int64)
            sketch = np.concatenate([(signature >> np.uint64(8)).astype(np.uint8), np.minimum(size, 255).astype(np.uint8)[:, None]], 1)
            node = [xxhash.xxh3_128_digest(values[x:y]) if y > x else None for x, y in zip(first[:-1].tolist(), first[1:].tolist())]
            lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.reshape(-1)), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(size, pa.int64()), pa.array(node, pa.binary()), lists, pa.array(list(map(bytes, sketch)), pa.binary())],
                names=["doc_id", "row_key", "n_shingles", "node", "bands", "sketch"],
            )


def _row_key(id_col: str, text_col: str):
    return F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))


def least_agreeing(percent: int) -> int:
    share = percent / 100
    return int(BINS * share - 5 * (BINS * share * (1 - share)) ** 0.5)


def _plausible(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Those pairs (a, b, sketch of a, sketch of b) that may be alike enough."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, BINS + 1) for k in (2, 3))
        small = np.minimum(x[:, BINS], y[:, BINS]) < LARGE
        mask = pa.array(small | ((x[:, :BINS] == y[:, :BINS]).sum(1) >= least_agreeing(percent)))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])


def _own_sets(column: pa.Array) -> list[np.ndarray]:
    data, offsets = wordvec.buffers(column)
    values, first = sets(data, offsets)
    return np.split(values, first[1:-1])


def _verify(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Those pairs (a, b, text of a, text of b) whose full sets are alike enough. Pairs in a row with the same b hash its text once."""
    last, last_set = None, np.zeros(0, np.uint64)
    for batch in batches:
        ends = np.cumsum(np.concatenate([[0], pc.add(pc.binary_length(batch.column(2)), pc.binary_length(batch.column(3))).to_numpy()]))
        linked = np.zeros(batch.num_rows, bool)
        for first, end in wordvec.runs(ends, VERIFY_BYTES):
            part = batch.slice(first, end - first)
            keys = part.column(1).to_pylist()
            new = [k for k, key in enumerate(keys) if key != (keys[k - 1] if k else last)]
            sets_b = iter(_own_sets(part.column(3).take(pa.array(new, pa.int64()))) if new else ())
            for k, x in enumerate(_own_sets(part.column(2))):
                if keys[k] != last:
                    last, last_set = keys[k], next(sets_b)
                both = int(np.isin(x, last_set, assume_unique=True, kind="sort").sum()) if len(x) and len(last_set) else 0
                linked[first + k] = both > 0 and 100 * both >= percent * (len(x) + len(last_set) - both)
        mask = pa.array(linked)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])
    tokens.trim()


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingle hashes of all texts."""
    for batch in batches:
        data, offsets = wordvec.buffers(batch.column(1))
        for a, b in wordvec.runs(offsets):
            values, _ = sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64))], names=["x"])


def _prefixes(batches: Iterator[pa.RecordBatch], common: np.ndarray, counts: np.ndarray, percent: int) -> Iterator[pa.RecordBatch]:
    """node, size, x, place and lead: the first shingles of each text, by count and hash. A set shares one of them with any set alike enough, and a leading one with any that is not smaller."""
    for batch in batches:
        data, offsets = wordvec.buffers(batch.column(1))
        for a, b in wordvec.runs(offsets):
            values, first = sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            count = np.zeros(len(values), np.int64)
            if len(common):
                at = np.minimum(np.searchsorted(common, values), len(common) - 1)
                count = np.where(common[at] == values, counts[at], 0)
            size = np.diff(first)
            row = np.repeat(np.arange(b - a), size)
            order = np.lexsort((values, count, row))
            place = np.arange(len(values)) - first[row]
            some = place < (size - -(-percent * size // 100) + 1)[row]
            lead = place < (size - -(-2 * percent * size // (100 + percent)) + 1)[row]
            nodes = batch.column(0).slice(a, b - a).take(pa.array(row[some]))
            out = [nodes, pa.array(size[row[some]], pa.int32()), pa.array(values[order][some].view(np.int64)), pa.array(place[some], pa.int32()), pa.array(lead[some])]
            yield pa.RecordBatch.from_arrays(out, names=["node", "size", "x", "place", "lead"])
    tokens.trim()


def _edge_sum(edges: DataFrame) -> tuple:
    """A digest of a set of edges: their number and the sum of hashes."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, label: label is the least node of its component. edges has a and b; nodes without edges are absent.

    Large and small stars alternate (Kiveris and others, 2014): each round joins every node
    with the least of its neighbours until only stars are left.
    """
    known = scratch.written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = _edge_sum(known)
    while True:
        both = known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(least, "a")
        small = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        known = scratch.written(small.where("a <> b").distinct(), "cc")
        after = _edge_sum(known)
        if after == before:
            break
        before = after
    roots = known.select(F.col("b").alias("node")).distinct()
    return known.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots.select("node", F.col("node").alias("label")))


def _bit():
    """The bit of a number, in a bitmap of MARKS bits."""
    return F.pmod("node", F.lit(MARKS))


def _maps(keys: DataFrame, **which) -> DataFrame:
    """For each block of bits, a map of those numbers of the keys that each condition holds for; MARKS / 8 bytes each at most."""
    bits = keys.select(_bit().alias("_bit"), *[c.alias(name) for name, c in which.items()])
    bits = bits.select(F.bitmap_bucket_number("_bit").alias("_block"), F.bitmap_bit_position("_bit").alias("_at"), *which)
    return scratch.written(bits.groupBy("_block").agg(*[F.bitmap_construct_agg(F.when(F.col(name), F.col("_at"))).alias(name) for name in which]), "near-marks")


def _beside(rows: DataFrame, maps: DataFrame) -> DataFrame:
    """Rows with the place of their bit and the maps of its block, which go to all tasks."""
    return rows.withColumn("_block", F.bitmap_bucket_number(_bit())).withColumn("_bit", F.bitmap_bit_position(_bit())).join(F.broadcast(maps), "_block")


def _is_in(name: str):
    """Whether a row's bit is in a map."""
    byte, at = F.shiftright(F.col("_bit"), 3).cast("int"), F.col("_bit").bitwiseAND(F.lit(7)).cast("int")
    word = F.conv(F.hex(F.substring(name, byte + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("getbit", word, at) == 1


def _marked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows whose number may be among those of the keys, by a bitmap; few others, and none lost."""
    return _beside(rows, _maps(keys, _map=F.lit(True))).where(_is_in("_map")).select(*rows.columns)


def links(docs: DataFrame, feats: DataFrame, *, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Verified links (a, b) between nodes, and the label of each node that has one. A node's number is the least row_key of its rows."""
    if percent < PERCENT:
        raise ValueError(f"the bands find links of {PERCENT} percent and more, not of {percent}")
    spark = docs.sparkSession
    nodes = feats.where("n_shingles > 0").groupBy("node").agg(F.min("row_key").alias("number"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("size"))
    nodes = scratch.written(nodes.drop("node").withColumnRenamed("number", "node"), "near-nodes")
    members = nodes.select("node", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = scratch.written(members.join(shared, "key"), "near-members")
    popular = members.groupBy("node").agg(F.sum("n").alias("pop"))
    members = scratch.written(members.join(popular, "node"), "near-popular")
    rows = docs.select(_row_key(id_col, text_col).alias("node"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def texts(keys: DataFrame) -> DataFrame:
        """node and text of some nodes."""
        # Not a semi-join: the optimizer would move that before the bitmap, and all texts would be shuffled.
        return _marked(rows, keys).join(keys, "node").groupBy("node").agg(F.first("text").alias("text"))

    def verified(near: DataFrame) -> DataFrame:
        """Pairs whose full sets are alike enough."""
        keys = scratch.written(near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct(), "near-keys")
        own = texts(keys)  # shuffled once, by node, for both ends of the pairs
        text = lambda side: own.select(F.col("node").alias(side), F.col("text").alias(f"{side}_text"))
        met = text("a").join(near, "a").join(text("b"), "b").select("a", "b", "a_text", "b_text")
        return scratch.written(met.mapInArrow(lambda x: _verify(x, percent), "a long, b long"), "near-links")

    def plausible(pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes and sketches do not speak against a link."""
        side = lambda name: nodes.select(F.col("node").alias(name), F.col("sketch").alias(f"{name}_sketch"), F.col("size").alias(f"{name}_size"))
        met = side("a").join(pairs, "a").join(side("b"), "b").where(f"100 * least(a_size, b_size) >= {percent} * greatest(a_size, b_size)")
        return met.select("a", "b", "a_sketch", "b_sketch").mapInArrow(lambda x: _plausible(x, percent), "a long, b long")

    found: list[DataFrame] = []
    compared: list[DataFrame] = []
    labels = None

    def labelled(members: DataFrame) -> DataFrame:
        if labels is None:
            return members.withColumn("label", F.col("node"))
        return members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    def mixed(now: DataFrame) -> DataFrame:
        """Those members whose bucket has several components."""
        several = now.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
        return now.join(several, "key", "left_semi")

    def tried(pairs: DataFrame, sketched: bool) -> bool:
        """Compares pairs that were not yet; whether many of them are links."""
        nonlocal labels
        for old in compared:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        near = scratch.written(pairs, "near-pairs")
        if sketched:
            near = scratch.written(plausible(near), "near-plausible")
        n = near.count()
        if not n:
            return False
        compared.append(near)
        new = verified(near)
        if not (m := new.count()):
            return False
        found.append(new)
        known = new if labels is None else new.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
        labels = scratch.written(components(known), "near-labels")
        return PRODUCTIVE * m >= n

    def stars(members: DataFrame) -> None:
        """Rounds of a centre for each bucket, as long as they find many links."""
        spent = None  # each bucket's earlier centres
        while True:
            now = labelled(members)
            now = scratch.written(now if labels is None else mixed(now), "near-now")
            free = now if spent is None else now.join(spent, (now["key"] == spent["_key"]) & (now["node"] == spent["_node"]), "left_anti")
            centres = free.groupBy("key").agg(F.max(F.struct("pop", "node", "label")).alias("c")).select("key", F.col("c.node").alias("centre"), F.col("c.label").alias("centre_label"))
            centres = scratch.written(centres, "near-centres")
            star = now.join(centres, "key").where("label <> centre_label").select(F.greatest("node", "centre").alias("a"), F.least("node", "centre").alias("b"))
            if not tried(star.distinct(), True):
                break
            own = centres.select(F.col("key").alias("_key"), F.col("centre").alias("_node"))
            spent = own if spent is None else spent.unionByName(own)

    def parts(now: DataFrame, name: str) -> DataFrame:
        """Lists of about LIST_PART nodes of a shingle and component, so that nodes of one component are not paired."""
        long = scratch.written(now.groupBy("key", "label").agg(F.count("*").alias("n")).where(F.col("n") > LIST_PART), "near-parts")
        cut = now.join(long, ["key", "label"], "left").withColumn("part", F.pmod(F.xxhash64("node"), F.coalesce(F.ceil(F.col("n") / LIST_PART), F.lit(1))))
        return cut.groupBy("key", F.col("label").alias(f"{name}_label"), "part").agg(F.collect_list(F.struct("size", "node", "place")).alias(name)).drop("part")

    def rest() -> None:
        """Compares all pairs of other components among the members of buckets that are still mixed: those that have a rare shingle in common."""
        open_ = mixed(labelled(members)).select("node").distinct()
        open_ = scratch.written(open_, "near-open")
        n = open_.count()
        if not n:
            return
        own = scratch.written(texts(open_), "near-texts")
        some = own.where(F.pmod(F.xxhash64("node"), F.lit(-(-n // COUNTED))) == 0).mapInArrow(_shingles, "x long")
        most = some.groupBy("x").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "x").limit(MOST_COMMON).toArrow()
        common, counts = most.column("x").to_numpy().view(np.uint64), most.column("n").to_numpy()
        order = np.argsort(common)
        known = spark.sparkContext.broadcast((common[order], counts[order]))
        kind = "node long, size int, x long, place int, lead boolean"
        lists = own.mapInArrow(lambda x: _prefixes(x, *known.value, percent), kind).withColumnRenamed("x", "key")
        lists = scratch.written(lists, "near-prefixes")
        known.destroy()
        led = lists.groupBy("key").agg(F.count("*").alias("n"), F.max("lead").alias("led")).where("n > 1 and led").select("key")
        lists = scratch.written(lists.join(led, "key", "left_semi"), "near-lists")
        leads = lists.where("lead").select("node", "key")
        long = leads.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > SHORT_LIST)
        long = leads.join(long, "key")
        if long.take(1):
            stars(scratch.written(long.join(long.groupBy("node").agg(F.sum("n").alias("pop")), "node"), "near-long"))
        now = scratch.written(mixed(labelled(lists)), "near-now")
        met = parts(now.where("lead"), "x").join(parts(now, "y"), "key").where("x_label <> y_label")
        met = met.select(F.explode("x").alias("x"), "y").select("x", F.explode("y").alias("y")).where(f"x < y and 100 * x.size >= {percent} * y.size")
        met = met.groupBy("x.node", "y.node").agg(
            F.count("*").alias("n"), F.max("x.size").alias("x_size"), F.max("y.size").alias("y_size"), F.max("x.place").alias("x_place"), F.max("y.place").alias("y_place")
        ).toDF("x", "y", "n", "x_size", "y_size", "x_place", "y_place")
        # All shingles in common that are not counted come after the last one that is.
        met = met.where(f"(100 + {percent}) * (n + least(x_size - x_place, y_size - y_place) - 1) >= {percent} * (x_size + y_size)")
        tried(met.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")), False)

    stars(members)
    rest()
    if not found:
        none = spark.createDataFrame([], "a long, b long")
        return none, none.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return reduce(DataFrame.unionByName, found), labels


def features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_key, n_shingles, node (a digest of the set; null: empty), bands and sketch (a byte of each value, and the size up to 255) of each row, written."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), _row_key(id_col, text_col).alias("row_key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return scratch.written(rows.mapInArrow(_features, f"doc_id {kind}, row_key long, n_shingles long, node binary, bands array<long>, sketch binary"), "near-features")


def clustered(docs: DataFrame, *, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_key, n_shingles, component_id, n_links (of its node, those that the search verified: one at least if it has any, not all) and kept, a row for each row of docs."""
    feats = features(docs, id_col=id_col, text_col=text_col)
    pairs, labels = links(docs, feats, percent=percent, id_col=id_col, text_col=text_col)
    classes = feats.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.min("row_key").alias("number"))
    classes = classes.join(labels.withColumnRenamed("node", "number"), "number", "left").withColumn("label", F.coalesce("label", "number"))
    classes = scratch.written(classes, "near-classes")
    least = classes.groupBy("label").agg(F.min("least").alias("component"))
    degree = pairs.select(F.col("a").alias("number")).unionByName(pairs.select(F.col("b").alias("number"))).groupBy("number").agg(F.count("*").alias("links"))
    classes = scratch.written(classes.join(least, "label").join(degree, "number", "left").select("node", "component", "links"), "near-components")
    out = feats.select("doc_id", "row_key", "n_shingles", "node").join(classes, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select(
        "doc_id", "row_key", "n_shingles", component.alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def deduplicated(docs: DataFrame, *, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each component: that of its least id (of rows repeated as a whole, one). Empty texts stay, one for each id."""
    keys = clustered(docs, percent=percent, id_col=id_col, text_col=text_col).groupBy(F.col("row_key").alias("node")).agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    keys = scratch.written(keys, "near-kept")
    # A bit of kept rows alone and one of others alone decide without a shuffle of rows; only rows whose bit is both, and repeated ones, are joined.
    maps = _maps(keys, _kept=F.col("kept"), _open=~F.col("kept") | (F.col("n") > 1))
    at = _beside(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _row_key(id_col, text_col).alias("node")), maps).where(_is_in("_kept"))
    once = at.where(~_is_in("_open")).select("row")
    # Not a semi-join: see links.
    met = at.where(_is_in("_open")).select("row", "node").join(keys.where("kept").select("node"), "node").dropDuplicates(["node"])
    return once.unionByName(met.select("row")).select("row.*")
