"""Near duplicates by SetSketch.

A document's set of word shingles is sketched: register i holds the level floor(1 - log_b h), truncated to its range,
of the smallest of exponentially distributed hashes h that hash function i gives the set's members. Registers of a
union are the maxima of registers, and registers of similar sets agree often. Bands of registers put similar sets
into common buckets; the registers of two sets then give the likelihood of their similarity (both sizes being known),
and pairs that may reach the threshold are compared on their full sets.

A bucket is never expanded into all its pairs: first all its members are compared with two of them, links are put
together to components, and only members of different components that still share a bucket are compared further, block
by block: first by their registers, then by their full sets where these leave a link possible. Documents with equal
sets are one class from the start. A shingle is known by its 64-bit hash throughout, so two documents are taken for
more similar than they are only where hashes collide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseframe.llm.common import columns, drop_table, handing_back, materialize, small_batches
from clauseframe.llm.components import components

WORDS, SIMILARITY = 5, (75, 100)
#: Registers, registers of a band; base and rate of the sketch; largest level.
REGISTERS, BAND = 128, 4
BASE, RATE, TOP = 1.05, 20.0, 2**16 - 2
#: A pair is compared in full unless its estimate is so many deviations below the threshold.
DEVIATIONS = 5.0
#: Members of a block and bytes of their sets, at most; characters of the texts that are worked on at once.
BLOCK, BLOCK_BYTES, CHUNK_CHARS = 4096, 32 << 20, 1_000_000
#: Bits of a filter of classes, as a power of two at most (64 MB), and bits that it sets for each.
FILTER_BITS, PROBES = 29, 4
_ODD = np.random.default_rng(20240229).integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str], n: int = WORDS) -> list[np.ndarray]:
    """The sorted set of 64-bit shingle hashes of each text: A-Z lowered, words split at ASCII white space."""
    words = [x.encode("utf-8", "surrogatepass").lower().split() for x in texts]
    flat = [w for ws in words for w in ws]
    if not flat:
        return [np.zeros(0, dtype=np.uint64)] * len(texts)
    codes, distinct = pd.factorize(np.array(flat, dtype=object))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in distinct), dtype=np.uint64, count=len(distinct))[codes]
    out, at = [], 0
    with np.errstate(over="ignore"):
        for ws in words:
            h = hashes[at : at + len(ws)]
            at += len(ws)
            k = min(n, len(h))
            if not k:
                out.append(h)
                continue
            roll = np.full(len(h) - k + 1, np.uint64(k), dtype=np.uint64)
            for j in range(k):
                roll = roll * _STEP + h[j : len(h) - k + 1 + j]
            out.append(np.unique(_mix(roll)))
    return out


def registers(members: np.ndarray) -> np.ndarray:
    """The sketch of a set that isn't empty."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(members), 2048):
            least = np.minimum(least, np.multiply.outer(_ODD, members[i : i + 2048]).min(axis=1))
    h = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(h) / math.log(BASE)), 0, TOP).astype(np.uint16)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The likeliest Jaccard similarity of pairs of sets of known sizes, from their registers (pairs in rows)."""
    above, below = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    equal = a.shape[1] - above - below
    u = (na / (na + nb))[:, None]
    v = 1 - u
    most = np.minimum(u / v, v / u)
    j = np.linspace(0, 1, 65)[None, :] * most * (1 - 1e-9)
    for _ in range(2):
        p = -np.log1p(-np.maximum(u - v * j, 0) * (BASE - 1) / BASE) / math.log(BASE)
        q = -np.log1p(-np.maximum(v - u * j, 0) * (BASE - 1) / BASE) / math.log(BASE)
        tiny = 1e-12
        like = above * np.log(np.maximum(p, tiny)) + below * np.log(np.maximum(q, tiny)) + equal * np.log(np.maximum(1 - p - q, tiny))
        best = np.take_along_axis(j, like.argmax(axis=1)[:, None], axis=1)
        j = np.clip(best + np.linspace(-1, 1, 33)[None, :] * most / 64, 0, most * (1 - 1e-9))
    return best[:, 0]


def _promise(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, similarity: float) -> np.ndarray:
    """How far each pair's estimate is above what leaves the threshold possible; below 0 if it doesn't."""
    slack = DEVIATIONS * math.sqrt(similarity * (1 - similarity) / REGISTERS)
    return np.where(np.minimum(na, nb) >= similarity * np.maximum(na, nb), estimate(a, b, na, nb) - similarity + slack, -1.0)


def _sketch(df: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    """__key, __id, __text and n, d1, d2 (size and digest of the set), regs; with ``carry`` also __row."""
    extra = T.StructType([*columns(n="long", d1="long", d2="long"), T.StructField("regs", T.BinaryType())])
    row = [F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row")] if carry else []
    text = [] if carry else [F.col(f"`{text_col}`").alias("__text")]  # a carried row has it already
    rows = df.select(F.monotonically_increasing_id().alias("__key"), F.col(f"`{id_col}`").alias("__id"), *text, *row)
    out, at = T.StructType([*rows.schema, *extra]), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = ["" if x is None else x for x in (b.column(2).field(at) if carry else b.column(2)).to_pylist()]
            start = chars = 0
            for i, x in enumerate(texts):
                chars += len(x)
                if chars < CHUNK_CHARS and i < len(texts) - 1:
                    continue
                sets = shingle_sets(texts[start : i + 1])
                with np.errstate(over="ignore"):
                    d1 = [int(_mix(s + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                    d2 = [int(_mix(s * _STEP).sum(dtype=np.uint64).view(np.int64)) for s in sets]
                made = [
                    pa.array([len(s) for s in sets], pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                    pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(start, i + 1 - start) for c in range(b.num_columns)), *made], names=out.fieldNames())
                start, chars = i + 1, 0

    return rows.mapInArrow(handing_back(run), out)


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(len(column), REGISTERS)


def _filter_pairs(pairs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (a, b), those whose sketches leave the threshold possible, with how far they do."""
    side = lambda x: reps.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ra", "rb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                b = whole.slice(i, 4096)
                na, nb = b.column(2).to_numpy().astype(float), b.column(3).to_numpy().astype(float)
                promise = _promise(_regs(b.column(4)), _regs(b.column(5)), na, nb, similarity)
                made = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(promise)], names=["a", "b", "promise"])
                yield made.filter(pa.array(promise >= 0))

    return met.mapInArrow(run, columns(a="long", b="long", promise="double"))


def _verify(pairs: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Of the pairs (a, b), those whose full sets reach the threshold."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("members").alias(f"m{x}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ma", "mb")
    least, most = similarity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            linked = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(most * both >= least * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    return met.mapInArrow(run, columns(a="long", b="long"))


def _marks(keys: np.ndarray, bits: int) -> np.ndarray:
    """The bits (keys x PROBES) that a filter of 2**bits bits has for each key."""
    with np.errstate(over="ignore"):
        return np.stack([_mix(keys.astype(np.uint64) + np.uint64(k + 1) * _STEP) >> np.uint64(64 - bits) for k in range(PROBES)], axis=1)


def _filter_of(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """A Bloom filter of some classes: 16 bits for each, FILTER_BITS in all at most, whatever their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = _marks(b.column(0).to_numpy(), bits).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "mark"])

    bits = min(FILTER_BITS, max(16, math.ceil(math.log2(max(1, nodes.count()) * 16))))
    got = nodes.select("node").mapInArrow(run, columns(word="long", mark="long")).groupBy("word").agg(F.bit_or("mark").alias("mark")).toArrow()
    words = np.zeros(1 << (bits - 6), dtype=np.uint64)
    words[got.column("word").to_numpy()] = got.column("mark").to_numpy().view(np.uint64)
    return bits, words


def _sets(sketches: DataFrame, nodes: DataFrame, text: Column) -> DataFrame:
    """The full sets (node, members) of some classes, from the text of one document of each.

    The classes' filter goes to where the texts are, so no text is shuffled; what it lets through besides does no harm,
    as the sets are joined by class.
    """
    bits, words = _filter_of(nodes)
    shared = sketches.sparkSession.sparkContext.broadcast(words)
    out = T.StructType([*columns(node="long"), T.StructField("members", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = _marks(whole.column(0).to_numpy(), bits)
            hit = ((shared.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)
            passed = whole.filter(pa.array(hit))
            for i in range(0, passed.num_rows, 256):
                b = passed.slice(i, 256)
                sets = shingle_sets(["" if x is None else x for x in b.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.tobytes() for x in sets], pa.binary())], names=out.fieldNames())

    made = materialize(sketches.where("n > 0").select(F.col("__key").alias("node"), text.alias("__text")).mapInArrow(handing_back(run), out), "near-sets")
    shared.destroy()
    return made


def _promising(regs: np.ndarray, n: np.ndarray, x: int, ys: np.ndarray, band: int, share: float) -> np.ndarray:
    """Of a block's rows ys, those whose sketches allow a link with row x and agree with its in this band first; the likeliest first."""
    ys = ys[np.minimum(n[ys], n[x]) >= share * np.maximum(n[ys], n[x])]
    ys = ys[(regs[ys] == regs[x]).reshape(len(ys), -1, BAND).all(axis=2).argmax(axis=1) == band] if len(ys) else ys
    if not len(ys):
        return ys
    promise = _promise(np.broadcast_to(regs[x], (len(ys), REGISTERS)), regs[ys], np.full(len(ys), float(n[x])), n[ys].astype(float), share)
    return ys[np.argsort(-promise, kind="stable")[: int((promise >= 0).sum())]]


def _dealt(rows: DataFrame, total: int) -> DataFrame:
    """Members of buckets (bucket, node, parts, ...), of which there are ``total``, in blocks (bucket, i, j).

    A bucket's members are dealt to its parts, and every two parts meet in a block of their own.
    """
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("node", "bucket"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    blocks = dealt.withColumns({"i": F.least("part", "other"), "j": F.greatest("part", "other")}).drop("other")
    # As many partitions as the comparisons need, not as few as the rows would fit.
    return blocks.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // 4000), "bucket", "i", "j")


def _sides(key: tuple, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a block (bucket, i, j) that are compared with each other."""
    i, j = key[1].as_py(), key[2].as_py()
    return (np.flatnonzero(part == i), np.flatnonzero(part == j)) if i != j else (np.arange(len(part)),) * 2


def _candidates(open_: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Where full sets are needed: (node, bucket, band) of classes that may be linked with one of another component there.

    Only sketches go to the buckets, where most members meet by chance. A class is named as soon as one pair of it
    allows a link, and pairs of two named classes needn't be tried, so what comes out is no longer than what goes in.
    """
    share = similarity[0] / similarity[1]

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        band, regs = t.column("band")[0].as_py(), _regs(t.column("regs"))
        node, comp, n, part = (t.column(c).to_numpy() for c in ("node", "comp", "n", "part"))
        left, right = _sides(key, part)
        named = np.zeros(len(node), dtype=bool)
        for x in left:
            ys = right[((node[right] > node[x]) | (left is not right)) & (comp[right] != comp[x]) & ~(named[x] & named[right])]
            ys = _promising(regs, n, x, ys, band, share)
            named[ys] = True
            named[x] |= len(ys) > 0
        return t.select(["node", "bucket", "band"]).filter(pa.array(named))

    total = open_.agg(F.sum(F.size("at"))).first()[0] or 0
    blocks = _dealt(open_.select("node", "comp", "n", "regs", F.inline("at")), total)
    return blocks.groupBy("bucket", "i", "j").applyInArrow(run, columns(node="long", bucket="long", band="int")).distinct()


def _blocks(met: DataFrame, open_: DataFrame, sets: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Links (a, b) that join different components of one bucket's members: where classes meet (node, bucket, band), what is
    known of them (node, comp, n, regs), and their sets (node, members). A class meets its set once, then goes to its buckets.

    Members of a bucket larger than a block are dealt to parts, and every two parts meet in a block of their own. In a
    block a pair is compared in full if the sketches allow a link, this is the first band in which both agree, and no
    link found in the block so far has joined their components; so what comes out is a forest, not all pairs.
    """
    share, (least, most) = similarity[0] / similarity[1], similarity
    parts = F.ceil(F.greatest(F.count("*") / BLOCK, 8 * F.sum("n") / BLOCK_BYTES)).cast("int")
    sized = met.join(open_.select("node", "n"), "node")
    places = sized.join(sized.groupBy("bucket").agg(parts.alias("parts")), "bucket").groupBy("node").agg(F.collect_list(F.struct("bucket", "band", "parts")).alias("at"))
    each = places.join(open_.select("node", "comp", "n", "regs"), "node").join(sets, "node").select("node", "comp", "n", "regs", "members", F.inline("at"))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        band, regs, sets = t.column("band")[0].as_py(), _regs(t.column("regs")), [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in t.column("members")]
        node, n, part = (t.column(c).to_numpy() for c in ("node", "n", "part"))
        _, comp = np.unique(t.column("comp").to_numpy(), return_inverse=True)
        left, right = _sides(key, part)
        found = []
        for x in left:
            ys = right[((node[right] > node[x]) | (left is not right)) & (comp[right] != comp[x])]
            for y in _promising(regs, n, x, ys, band, share):
                if comp[y] != comp[x]:
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if most * both >= least * (len(sets[x]) + len(sets[y]) - both):
                        found.append((int(node[x]), int(node[y])))
                        comp[comp == comp[y]] = comp[x]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return _dealt(each, met.count()).groupBy("bucket", "i", "j").applyInArrow(run, columns(a="long", b="long"))


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: tuple[int, int] = SIMILARITY, carry: bool = False) -> DataFrame:
    """Every row with its group of near duplicates: the identifier, ``n_shingles``, ``component_id``, ``kept``; with ``carry``
    also ``__row``, all columns, and ``__key``, a number of the row.

    Two documents are linked if their sets of shingles have a Jaccard similarity of at least ``similarity``;
    ``component_id`` is the smallest identifier among all that links reach, its own included.

    Defined cases: a text of fewer words than a shingle is one shingle; a null or empty text has an empty set and is
    linked with nothing; texts are read whole; rows with equal sets are one class; null identifiers come last, a group
    of nothing else has a null component and its rows are kept; repeated rows are each kept or not, as one; an empty
    table gives an empty result; other columns are not read. A pair at the threshold is missed by all bands with a
    probability below 1e-5, and by the estimate below 1e-6.
    """
    small_batches(df.sparkSession)
    share = similarity[0] / similarity[1]
    sketches = materialize(_sketch(df, id_col, text_col, carry), "near-sketches")
    reps = materialize(
        sketches.where("n > 0").groupBy("d1", "d2", "n").agg(F.min(F.struct("__key", "regs")).alias("first"), F.min("__id").alias("least"), F.count("*").alias("copies"))
        .select("d1", "d2", "n", F.col("first.__key").alias("node"), F.col("first.regs").alias("regs"), "least", "copies"),
        "near-classes",
    )

    # Buckets: one row for each band of each class, and those of two or more classes with two of their members.
    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            regs = _regs(b.column(1))
            m = REGISTERS // BAND
            words = np.ascontiguousarray(regs).view(np.uint64).reshape(len(regs), m)  # four 16-bit registers
            with np.errstate(over="ignore"):
                hashed = _mix(words + (np.arange(m, dtype=np.uint64) + np.uint64(1)) * _STEP)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(b.column(0).to_numpy(), m)), pa.array(hashed.reshape(-1).view(np.int64)), pa.array(np.tile(np.arange(m, dtype=np.int32), len(regs)))],
                names=["node", "bucket", "band"],
            )

    banded = reps.select("node", "regs").mapInArrow(bands, columns(node="long", bucket="long", band="int"))
    rank = F.struct(F.xxhash64("node"), "node")
    hubs = materialize(
        banded.groupBy("bucket").agg(F.count("*").alias("size"), F.min(rank).alias("lo"), F.max(rank).alias("hi")).where("size > 1")
        .select("bucket", "size", F.array_distinct(F.array("lo.node", "hi.node")).alias("hubs")),
        "near-buckets",
    )
    members = materialize(banded.join(hubs, "bucket"), "near-members")
    stars = members.select("node", F.explode("hubs").alias("hub")).where("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    near = materialize(_filter_pairs(stars, reps, share), "near-pairs")

    text = F.col("__row").getField(text_col) if carry else F.col("__text")

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = materialize(nodes.distinct(), "near-nodes")
        made = _sets(sketches, wanted, text)
        drop_table(wanted)
        return made

    # First each class with its most promising partner, to join what is easily joined; then only what is still apart.
    ends = near.select("a", "b", F.explode(F.array("a", "b")).alias("end"), "promise")
    best = ends.groupBy("end").agg(F.max_by(F.struct("a", "b"), F.struct("promise", "a", "b")).alias("pair")).select("pair.a", "pair.b").distinct()
    sets = sets_of(near.select(F.explode(F.array("a", "b")).alias("node")))
    links = materialize(_verify(best, sets, similarity), "near-links")
    comps = materialize(components(links), "near-components")

    def apart(pairs: DataFrame) -> DataFrame:
        side = lambda x: comps.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
        met = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
        return met.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    rest = _verify(apart(near.select("a", "b")).join(best, ["a", "b"], "left_anti"), sets, similarity)
    rest = materialize(rest, "near-links")
    drop_table(sets)

    def joined(links: DataFrame) -> DataFrame:
        """The components when some links join those found so far."""
        return materialize(components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links)), "near-components")

    comps = joined(rest)
    # In buckets of up to three, the stars have met all pairs. Of the others, those that still hold several components are open.
    labelled = members.where("size > 3").select("bucket", "band", "node").join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    parts = F.ceil(F.count("*") / BLOCK).cast("int")
    split = labelled.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), parts.alias("parts")).where("lo < hi").select("bucket", "parts")
    # A class is looked up once, whatever the number of its buckets.
    shared = labelled.join(split, "bucket").groupBy("node", "comp").agg(F.collect_list(F.struct("bucket", "band", "parts")).alias("at"))
    open_ = materialize(shared.join(reps.select("node", "n", "regs"), "node"), "near-open")
    met = materialize(_candidates(open_, similarity), "near-met")
    sets = sets_of(met.select("node"))
    more = materialize(_blocks(met, open_, sets, similarity), "near-links")
    drop_table(sets)
    comps = joined(more)
    for done in (members, open_, met, near):
        drop_table(done)

    # Back to the documents. Classes of very many copies are few, and their names can be broadcast; all others meet by a join.
    named = reps.join(comps, "node", "left").withColumn("comp", F.coalesce("component", "node"))
    least = comps.join(reps.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("component_id"))
    names = named.join(least.withColumnRenamed("component", "comp"), "comp", "left").where("copies > 1 OR component_id IS NOT NULL")
    names = materialize(names.select("d1", "d2", "copies", F.coalesce("component_id", "least").alias("component_id")), "near-names")
    rows = sketches.select("__key", "__id", "n", "d1", "d2", *(["__row"] if carry else []))
    most = max(200, names.agg(F.sum("copies")).first()[0] or 0) // 2000 + 200
    heavy = names.where(F.col("copies") > most).select(F.col("d1").alias("h1"), F.col("d2").alias("h2"), F.col("component_id").alias("hc"))
    light = names.where(F.col("copies") <= most).select(F.col("d1").alias("l1"), F.col("d2").alias("l2"), F.col("component_id").alias("lc"))
    # At most 2000 rows: each stands for more than a 2000th of all copies.
    met = rows.join(F.broadcast(heavy), (F.col("d1") == F.col("h1")) & (F.col("d2") == F.col("h2")) & (F.col("n") > 0), "left")
    met = met.withColumn("k1", F.when(F.col("h1").isNotNull() | (F.col("n") == 0), F.col("__key")).otherwise(F.col("d1")))
    met = met.join(light, (F.col("k1") == F.col("l1")) & (F.col("d2") == F.col("l2")), "left")
    plain = F.col("n").isNull() | (F.col("n") == 0)
    component = F.when(plain, F.col("__id")).when(F.col("h1").isNotNull(), F.col("hc")).when(F.col("l1").isNotNull(), F.col("lc")).otherwise(F.col("__id"))
    more = ["__key", "__row"] if carry else []
    return met.select(F.col("__id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), *more).withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The table with the rows that stay, one for each identifier that is its group's smallest; columns as they were."""
    kept = near_groups(df, id_col, text_col, similarity, carry=True).where("kept")
    return kept.select(*(F.col("__row").getField(c).alias(c) for c in df.columns))
