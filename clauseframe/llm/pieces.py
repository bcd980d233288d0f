"""SentencePiece encoding and decoding from a relational lattice.

A text is cut into words where no piece can reach across: before runs of spaces, and around line ends and tabs. For
the words that make up most of a corpus the lattice is built with DataFrame operations: every substring of bounded
length is exploded with its place, equi-joined to the piece table, and the edges found are grouped by word. A Spark
higher-order ``aggregate`` then folds the edges to a segmentation: for unigram models the best path (Viterbi), for BPE
models the merges in order of score, which is what the library does with such a model and the best path isn't. The
folded words are bounded in number and go to all tasks; a task folds the same edges itself for each word beyond them.

The model's file is only read, on the driver; its path is a parameter.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseframe.llm.common import columns, handing_back, materialize, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words that are folded once for all tasks, at most; longest word that a 64-bit mask holds.
HEAD_WORDS, MASK_CHARS = 200_000, 60
#: Words a task remembers besides; words that it counts before it passes them on.
CACHE_WORDS, COUNT_WORDS = 30_000, 200_000
#: Ids whose bytes are looked up at once; words that are looked up at once.
DECODE_IDS, LOOKUP_WORDS = 50_000, 100_000
_NONE = float("-inf")
_ENDS = "\n\t\r\x0b\x0c"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces (text -> id, score), the ids of the 256 bytes (empty without), the unknown piece, and whether scores rank merges."""

    pieces: dict[str, tuple[int, float]]
    bytes_: tuple[int, ...]
    unknown: int
    merges: bool = True

    @classmethod
    def load(cls, path: str = MODEL, merges: bool = True) -> Vocabulary:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.get_piece_size())
        plain = {m.id_to_piece(i): (i, m.get_score(i)) for i in ids if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))}
        by_byte = {m.id_to_piece(i): i for i in ids if m.is_byte(i)}
        return cls(plain, tuple(by_byte[f"<0x{b:02X}>"] for b in range(256)) if by_byte else (), m.unk_id(), merges)

    @cached_property
    def _ids(self) -> dict[str, int]:
        return {p: i for p, (i, _) in self.pieces.items()}

    @cached_property
    def _scores(self) -> dict[str, float]:
        return {p: s for p, (_, s) in self.pieces.items()}

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.pieces), default=1)

    @cached_property
    def cuts(self) -> re.Pattern:
        """Words: a run of spaces with what follows; characters that are in no longer piece stand alone."""
        alone = "".join(c for c in _ENDS if not any(c in p for p in self.pieces if len(p) > 1))
        assert not any(MARK in p.lstrip(MARK) for p in self.pieces), "a piece reaches across words"
        return re.compile(f" +[^ {alone}]*|[^ {alone}]+" + (f"|[{alone}]" if alone else ""))

    def words(self, text: str) -> list[str]:
        return self.cuts.findall(" " + text.replace(MARK, " ")) if text else []

    def other(self, char: str) -> list[int]:
        """A character that is no piece."""
        return [self.bytes_[b] for b in char.encode("utf-8", "surrogatepass")] if self.bytes_ else [self.unknown]

    def fold(self, word: str) -> list[int]:
        """Ids of one word (spaces as the mark), without Spark."""
        word = word.replace(" ", MARK)
        return (self._merge if self.merges else self._best)(word)

    def _merge(self, word: str) -> list[int]:
        """Highest score first, leftmost of equals, until no two neighbours make a piece."""
        if len(word) > MASK_CHARS:
            return self._merge_long(word)
        ids, score = self._ids, self._scores.get
        symbols = list(word)
        pairs = [score(x + y, _NONE) for x, y in zip(symbols, symbols[1:], strict=False)]
        while pairs:
            best = max(pairs)
            if best == _NONE:
                break
            i = pairs.index(best)
            symbols[i] += symbols.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = score(symbols[i] + symbols[i + 1], _NONE)
            if i:
                pairs[i - 1] = score(symbols[i - 1] + symbols[i], _NONE)
        return [x for s in symbols for x in ((ids[s],) if s in ids else self.other(s))]

    def _merge_long(self, word: str) -> list[int]:
        pieces = self.pieces
        n = len(word)
        end, after, before = [i + 1 for i in range(n)], [i + 1 for i in range(n)], [i - 1 for i in range(n)]
        heap: list[tuple[float, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and end[j] - i <= self.longest and (hit := pieces.get(word[i : end[j]])) is not None:
                heapq.heappush(heap, (-hit[1], i, end[j]))

        for i in range(n):
            offer(i)
        gone = [False] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= n or end[j] != stop:
                continue
            gone[j] = True
            end[i], after[i] = stop, after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            s = word[i : end[i]]
            out += [pieces[s][0]] if s in pieces else self.other(s)
            i = after[i]
        return out

    def _best(self, word: str) -> list[int]:
        """The path of the largest sum of scores; of equal ones the last edge that starts first."""
        n = len(word)
        low = min((s for _, s in self.pieces.values()), default=0.0) - 10
        best: list[tuple[float, int, list[int]]] = [(0.0, 0, [])] + [(float("-inf"), 0, [])] * n
        for e in range(1, n + 1):
            for s in range(max(0, e - self.longest), e):
                hit = self.pieces.get(word[s:e])
                if hit is None and e - s > 1:
                    continue
                ids, score = ([hit[0]], hit[1]) if hit else (self.other(word[s:e]), low)
                if best[s][0] + score > best[e][0]:
                    best[e] = (best[s][0] + score, s, ids)
        out: list[int] = []
        e = n
        while e:
            out[:0] = best[e][2]
            e = best[e][1]
        return out

    @cached_property
    def by_id(self) -> dict[int, bytes]:
        return {i: p.replace(MARK, " ").encode("utf-8", "surrogatepass") for p, (i, _) in self.pieces.items()} | {i: bytes([b]) for b, i in enumerate(self.bytes_)}

    @cached_property
    def _spelled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All pieces' bytes in a row, and by id where each begins and how long it is."""
        most = max(self.by_id, default=0) + 1
        each = [self.by_id.get(i, b"\xe2\x81\x87") for i in range(most + 1)]  # the last for ids beyond
        sizes = np.array([len(x) for x in each], dtype=np.int64)
        return np.frombuffer(b"".join(each), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes

    def decode_many(self, flat: np.ndarray, ends: list[int]) -> list[str]:
        """The texts of several lists of ids that lie one after the other: of each, where it ends; as ``decode`` gives them."""
        blob, starts, sizes = self._spelled
        parts, cut = [], [np.zeros(1, dtype=np.int64)]
        done = 0
        for i in range(0, len(flat), DECODE_IDS):
            ids = flat[i : i + DECODE_IDS]
            ids = np.where((ids < 0) | (ids >= len(sizes)), len(sizes) - 1, ids)
            size = sizes[ids]
            to = np.cumsum(size)
            parts.append(blob[np.arange(to[-1]) + np.repeat(starts[ids] - (to - size), size)].tobytes())
            cut.append(to + done)
            done += int(to[-1])
        data, at = b"".join(parts), np.concatenate(cut)[ends].tolist()
        return [x.removeprefix(" ") for x in (data[a:b].decode("utf-8", "replace") for a, b in pairwise([0, *at]))]

    def decode(self, ids: list[int]) -> str:
        """The text of some ids; the space that encoding puts in front is taken off, bytes that are no UTF-8 become U+FFFD."""
        try:
            made = b"".join(map(self.by_id.__getitem__, ids)).decode("utf-8", "replace")
        except KeyError:
            made = b"".join([self.by_id.get(i, b"\xe2\x81\x87") for i in ids]).decode("utf-8", "replace")
        return made[1:] if made[:1] == " " else made


def piece_table(spark: SparkSession, v: Vocabulary) -> DataFrame:
    ids, scores = zip(*v.pieces.values(), strict=True) if v.pieces else ((), ())
    return spark.createDataFrame(pa.table({"piece": pa.array(list(v.pieces), pa.string()), "id": pa.array(ids, pa.int32()), "score": pa.array(scores, pa.float64())}))


def lattice(words: DataFrame, v: Vocabulary) -> DataFrame:
    """words: (word). Each with its edges: every substring that is a piece, as (score, start, end, id, inner).

    ``inner`` has a bit for each place between the edge's characters. The piece table is as large as the model's file
    says and no larger, so it is broadcast; words stay where they are, and grouping them moves nothing.
    """
    spark = words.sparkSession
    shown = words.repartition("word").withColumn("shown", F.translate("word", " ", MARK))
    starts = shown.withColumn("start", F.explode(F.sequence(F.lit(0), F.length("shown") - 1)))
    subs = starts.withColumn("size", F.explode(F.sequence(F.lit(1), F.least(F.lit(v.longest), F.length("shown") - F.col("start")))))
    subs = subs.withColumn("sub", F.substring(F.col("shown"), F.col("start") + 1, F.col("size")))
    met = subs.join(F.broadcast(piece_table(spark, v)), F.col("sub") == F.col("piece"))
    end = F.col("start") + F.col("size")
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    edge = F.struct((-F.col("score")).alias("cost"), "start", end.alias("end"), "id", (bit(end) - bit(F.col("start") + 1)).alias("inner"))
    return met.groupBy("word").agg(F.array_sort(F.collect_list(edge)).alias("edges"))


def _bit(mask: Column, i: Column) -> Column:
    return F.call_function("shiftright", mask, i).bitwiseAND(F.lit(1).cast("long")) == 1


def fold_merges(edges: Column, size: Column) -> Column:
    """The mask of boundaries (bit i: a boundary before character i) that merging leaves; edges by cost, then start."""
    full = F.call_function("shiftleft", F.lit(1).cast("long"), size + 1) - 1

    def step(mask: Column, _: Column) -> Column:
        def fits(e: Column) -> Column:
            inside = mask.bitwiseAND(e["inner"])
            return (inside != 0) & (inside.bitwiseAND(inside - 1) == 0) & _bit(mask, e["start"]) & _bit(mask, e["end"])

        first = F.get(F.filter(edges, fits), F.lit(0))
        return mask.bitwiseAND(F.bitwise_not(F.coalesce(first["inner"], F.lit(0).cast("long"))))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), full, step)


def fold_best(edges: Column, size: Column, low: float) -> Column:
    """Viterbi: the mask of the boundaries of the best path; a character that is no piece costs more than any."""
    zero = F.lit(0).cast("long")
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    first = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(1).cast("long").alias("mask")))

    def step(best: Column, e: Column) -> Column:
        here = F.filter(edges, lambda x: x["end"] == e)
        known = F.transform(here, lambda x: F.struct((F.get(best, x["start"])["score"] - x["cost"]).alias("score"), (-x["start"]).alias("order"), F.get(best, x["start"])["mask"].bitwiseOR(bit(e)).alias("mask")))
        alone = F.exists(here, lambda x: x["start"] == e - 1)
        other = F.struct((F.get(best, e - 1)["score"] + F.lit(low)).alias("score"), (1 - e).alias("order"), F.get(best, e - 1)["mask"].bitwiseOR(bit(e)).alias("mask"))
        top = F.array_max(F.when(alone, known).otherwise(F.concat(known, F.array(other))))
        return F.concat(best, F.array(F.struct(top["score"].alias("score"), top["mask"].alias("mask"))))

    return F.coalesce(F.get(F.aggregate(F.sequence(F.lit(1), size), first, step), size)["mask"], zero)


def folded(words: DataFrame, v: Vocabulary) -> DataFrame:
    """(word, ids) for words of at most MASK_CHARS characters; characters that are no piece are left out as -1 - code point."""
    low = min((s for _, s in v.pieces.values()), default=0.0) - 10
    met = words.join(lattice(words, v), "word", "left").withColumn("edges", F.coalesce("edges", F.array().cast("array<struct<cost:double,start:int,end:int,id:int,inner:bigint>>")))
    size = F.length("word")
    mask = met.withColumn("mask", fold_merges(F.col("edges"), size) if v.merges else fold_best(F.col("edges"), size, low))
    shown = F.translate("word", " ", MARK)

    def at(i: Column) -> Column:
        hit = F.filter(F.col("edges"), lambda e: (e["start"] == i) & _bit(F.col("mask"), e["end"]) & (F.col("mask").bitwiseAND(e["inner"]) == 0))
        return F.coalesce(F.get(hit, F.lit(0))["id"], -1 - F.ascii(F.substring(shown, i + 1, F.lit(1))))

    starts = F.filter(F.sequence(F.lit(0), size - 1), lambda i: _bit(F.col("mask"), i))
    return mask.select("word", F.transform(starts, at).alias("ids"))


def head_words(df: DataFrame, v: Vocabulary, text_col: str = "text", most: int = HEAD_WORDS) -> DataFrame:
    """(word): at most ``most`` of the words that the texts hold most often, all that are as frequent as another or none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            kept = [(w, n) for w, n in counts.items() if n > 1 and len(w) <= MASK_CHARS]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        for b in batches:
            for text in b.column(0).to_pylist():
                if text:
                    counts.update(v.words(text))
                    if len(counts) > COUNT_WORDS:
                        yield flush()
        yield flush()

    counted = df.select(F.col(f"`{text_col}`").alias("__text")).mapInArrow(handing_back(count), columns(word="string", n="long")).groupBy("word").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "pieces-words")
    # How many words occur how often, in powers of 2 ** (1 / 8): a few hundred rows.
    level = F.floor(F.log2("n") * 8).cast("int")
    sizes = sorted(((r["level"], r["count"]) for r in counted.groupBy(level.alias("level")).count().collect()), reverse=True)
    total, least = 0, None
    for at, n in sizes:
        if total + n > most:
            break
        total, least = total + n, at
    found = counted.where(level >= least if least is not None else F.lit(False)).select("word")
    return found


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype=np.int32).tobytes()


def _packed_words(found: DataFrame, v: Vocabulary) -> DataFrame:
    """(word, ids): ids as bytes, characters that are no piece as the model writes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [_packed([x for i in row for x in ((i,) if i >= 0 else v.other(chr(-1 - i)))]) for row in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["word", "ids"])

    return found.mapInArrow(run, T.StructType([T.StructField("word", T.StringType()), T.StructField("ids", T.BinaryType())]))


def _joined(df: DataFrame, v: Vocabulary, id_col: str, text_col: str) -> DataFrame:
    """Ids by the lattice of all words: words are exploded with their places, joined to their ids and put together again."""
    text = F.translate(F.col(f"`{text_col}`"), MARK, " ")
    words = F.when(text != "", F.regexp_extract_all(F.concat(F.lit(" "), text), F.lit(v.cuts.pattern), F.lit(0)))
    numbered = df.select(F.monotonically_increasing_id().alias("__key"), F.col(f"`{id_col}`").alias("__id"), words.alias("__words"))
    each = numbered.select("__key", "__id", F.posexplode_outer("__words").alias("__at", "word"))
    distinct = materialize(each.where("word IS NOT NULL").select("word").distinct(), "pieces-all-words")
    short = F.length("word") <= MASK_CHARS
    long = distinct.where(~short).mapInArrow(_folded_here(v), "word string, ids binary")
    known = _packed_words(folded(distinct.where(short), v), v).unionByName(long)
    met = each.join(known, "word", "left").groupBy("__key").agg(F.first("__id").alias("__id"), F.array_sort(F.collect_list(F.struct("__at", "ids"))).alias("__parts"))
    out = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *columns(ids="int[]", n_tokens="long", decoded="string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield _rows(b.column(0), [b"".join(p or b"" for p in row) for row in b.column(1).to_pylist()], v, out)

    return met.select("__id", F.transform("__parts", lambda p: p["ids"]).alias("__ids")).mapInArrow(handing_back(run), out)


def _folded_here(v: Vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([_packed(v.fold(w)) for w in b.column(0).to_pylist()], pa.binary())], names=["word", "ids"])

    return run


def _rows(names: pa.Array, made: list[bytes], v: Vocabulary, out: T.StructType) -> pa.RecordBatch:
    """Rows of the result from each document's packed ids."""
    return _row_batch(names, np.frombuffer(b"".join(made), dtype=np.int32), np.cumsum([0, *(len(x) // 4 for x in made)]), v, out)


def _row_batch(names: pa.Array, flat: np.ndarray, ends: np.ndarray, v: Vocabulary, out: T.StructType) -> pa.RecordBatch:
    """Rows of the result from ids that lie one after the other, and where each document's end, from 0."""
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
    texts = pa.array(v.decode_many(flat, ends[1:].tolist()), pa.string())
    return pa.RecordBatch.from_arrays([names, lists, pa.array(np.diff(ends), pa.int64()), texts], names=out.fieldNames())


def _some_words(texts: pa.Array, v: Vocabulary) -> Iterator[tuple[int, list[str], list[int]]]:
    """Some texts at a time: where they begin, all their words, and behind which word each text ends."""
    start, words, stops = 0, [], []
    for i in range(len(texts)):
        words += v.words(texts[i].as_py() or "")
        stops.append(len(words))
        if len(words) >= LOOKUP_WORDS or i == len(texts) - 1:
            yield start, words, stops
            start, words, stops = i + 1, [], []


class _Head:
    """The head's words by number, and their ids one after the other."""

    def __init__(self, stream: bytes):
        table = pa.ipc.open_stream(stream).read_all().combine_chunks()
        n = table.num_rows
        self.number: dict[str, int] = {}
        for i in range(0, n, 10_000):
            part = table.column("word").slice(i, 10_000).to_pylist()
            self.number.update(zip(part, range(i, i + len(part)), strict=True))
        ends, self.flat = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int32)
        if n:
            packed = table.column("ids").chunk(0)
            _, offsets, data = packed.buffers()
            ends = np.frombuffer(offsets, dtype=np.int32)[packed.offset : packed.offset + n + 1].astype(np.int64)
            self.flat = np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]].copy().view(np.int32)
            ends = (ends - ends[0]) // 4
        self.sizes, self.begins = np.append(np.diff(ends), 0), ends  # the last for words that aren't here

    def ids(self, words: list[str], v: Vocabulary, others: dict[str, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of some words, and where each word's end, from 0; words that aren't in the head are folded here and remembered."""
        at = np.fromiter(map(self.number.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        size, begin = self.sizes[at], self.begins[at]
        missing = np.flatnonzero(at < 0)
        more = []
        for i in missing.tolist():
            word = words[i]
            more.append(others.get(word) or others.setdefault(word, _packed(v.fold(word))))
        size[missing] = [len(x) // 4 for x in more]
        begin[missing] = len(self.flat) + np.cumsum(size[missing]) - size[missing]
        ends = np.cumsum(np.concatenate([[0], size]))
        source = np.concatenate([self.flat, np.frombuffer(b"".join(more), dtype=np.int32)])
        return source[np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)], ends


def encode(df: DataFrame, v: Vocabulary, id_col: str = "doc_id", text_col: str = "text", head: int | None = HEAD_WORDS) -> DataFrame:
    """One row a document: its identifier, ``ids``, ``n_tokens`` and ``decoded``, the text read back from the ids.

    ``head``: so many of the most frequent words go through Spark's lattice, and others through the same fold in the
    task that meets them; None: all words go through the lattice and are joined back, whatever that takes.

    Defined cases: a null or empty text has no ids and an empty ``decoded``; texts are encoded whole, words of any
    length; U+2581 counts as a space, as in the library; repeated rows and null identifiers are rows of their own; an
    empty table gives an empty result; other columns are not read.
    """
    small_batches(df.sparkSession)
    if head is None:
        return _joined(df, v, id_col, text_col)
    spark = df.sparkSession
    got = _packed_words(folded(head_words(df, v, text_col, head), v), v).toArrow()  # at most ``head`` rows, about 30 bytes each
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, got.schema) as writer:
        writer.write_table(got, max_chunksize=10_000)
    shared = spark.sparkContext.broadcast((v, sink.getvalue().to_pybytes()))
    del got, sink
    out = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *columns(ids="int[]", n_tokens="long", decoded="string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, stream = shared.value
        found = _Head(stream)
        others: dict[str, bytes] = {}
        for whole in batches:
            for start, words, stops in _some_words(whole.column(1), v):
                flat, ends = found.ids(words, v, others)
                yield _row_batch(whole.column(0).slice(start, len(stops)), flat, np.concatenate([[0], ends[stops]]), v, out)
                if len(others) > CACHE_WORDS:
                    others.clear()

    return df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text")).mapInArrow(handing_back(run), out)


def decode(df: DataFrame, v: Vocabulary, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The table with the text of a column of ids; null ids give null, unknown ones U+2047."""
    shared = df.sparkSession.sparkContext.broadcast(v)
    rest = [c for c in df.columns if c != out_col]
    out = T.StructType([*(df.schema[c] for c in rest), T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [None if x is None else shared.value.decode(x) for x in b.column(rest.index(ids_col)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], names=out.fieldNames())

    return df.select(*(F.col(f"`{c}`") for c in rest)).mapInArrow(run, out)
