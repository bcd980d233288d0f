"""Cross-tokenizer alignment: which tokens of two vocabularies share bytes of the same texts.

Both tokenizers' tokens cover the same bytes, so their ends are cumulative sums of token lengths. Where both end, the
text is cut into groups; tokens link where their bytes overlap, and the links are written out by repeating each token
as often as it has partners. All that is numpy over many texts at once, laid end to end.

Tokens are found once: words (runs of white space with what follows, where no token of either vocabulary reaches
across, so that both sides' tokens end there) are remembered, new ones are encoded and set side by side together. The ids are written to the shared folder, and links are made
from them again for counting and for scoring, as that is cheaper than to move links. Pairs of ids are counted in the
task, then by (pair, salt), then by pair. Counts go back to the links in two ways: those of the most frequent pairs, of
a bounded number, are sent to all tasks; links of other pairs, which are rare by that, are summed by text and pair and
joined to their counts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clauseframe.llm.common import columns, handing_back, materialize, small_batches

BYTES_MODEL, PIECES_MODEL = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words a task remembers twice over; characters whose tokens are aligned at once; words of a part of a long text.
CACHE_WORDS, CHUNK_CHARS, PART_WORDS = 100_000, 1_000_000, 50_000
#: Pairs a task counts before it passes them on; salts; pairs whose counts are sent to all tasks, at most.
COUNT_PAIRS, SALTS, HELD_PAIRS = 1_000_000, 16, 2_000_000
#: Fixed value: how a byte-level vocabulary cuts words before it merges.
_BYTE_LEVEL_WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass(frozen=True)
class Tokenizer:
    """A vocabulary: its file's content, and the bytes of each token by id."""

    kind: str
    content: bytes
    spelled: tuple[bytes, ...]

    @classmethod
    def byte_level(cls, path: str = BYTES_MODEL) -> Tokenizer:
        with open(path, "rb") as f:
            content = f.read()
        model, letters = json.loads(content), byte_letters()
        ids = model["model"]["vocab"] | {x["content"]: x["id"] for x in model.get("added_tokens", [])}
        special = {x["content"] for x in model.get("added_tokens", [])}
        words = {i: w.encode() if w in special else bytes(letters[c] for c in w) for w, i in ids.items()}
        return cls("bytes", content, tuple(words.get(i, b"") for i in range(max(words) + 1)))

    @classmethod
    def pieces(cls, path: str = PIECES_MODEL) -> Tokenizer:
        import sentencepiece

        with open(path, "rb") as f:
            content = f.read()
        m = sentencepiece.SentencePieceProcessor(model_proto=content)
        words = [bytes([int(m.id_to_piece(i)[1:-1], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace(MARK, " ").encode() for i in range(m.get_piece_size())]
        return cls("pieces", content, tuple(words))

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("kind", "content", "spelled")}  # a task makes the rest for itself

    @cached_property
    def lengths(self) -> np.ndarray:
        return np.array([len(x) for x in self.spelled], dtype=np.int64)

    @cached_property
    def digits(self) -> tuple[np.ndarray, np.ndarray]:
        """Each id's decimal digits, with room for a sign behind, and how many they are."""
        n = np.array([len(str(i)) for i in range(len(self.spelled))], dtype=np.int64)
        wide = len(str(len(self.spelled))) + 1
        return np.frombuffer(b"".join(str(i).encode().ljust(wide, b",") for i in range(len(self.spelled))), dtype=np.uint8).reshape(-1, wide), n

    @cached_property
    def run(self):
        """Texts to lists of ids: of a byte-level vocabulary the text itself, of pieces the text without a space in front of it."""
        if self.kind == "pieces":
            import sentencepiece
            from sentencepiece import sentencepiece_model_pb2

            proto = sentencepiece_model_pb2.ModelProto.FromString(self.content)
            proto.normalizer_spec.add_dummy_prefix = False  # texts come with their space
            m = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
            return lambda texts: m.encode(texts, num_threads=1)
        model = json.loads(self.content)
        if self._plain(model):
            import tiktoken

            special = {x["id"] for x in model.get("added_tokens", [])}
            ranks = {w: i for i, w in enumerate(self.spelled) if i not in special and w}
            m = tiktoken.Encoding("bytes", pat_str=_BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens={})
            return lambda texts: [m.encode_ordinary(x) for x in texts]
        import tokenizers

        m = tokenizers.Tokenizer.from_str(self.content.decode())
        m.encode_special_tokens = True
        return lambda texts: [e.ids for e in m.encode_batch(texts, add_special_tokens=False)]

    def _plain(self, model: dict) -> bool:
        """Whether ids rank merges and words are cut as usual, so that a faster library gives the same ids."""
        vocab, pre, merges = model["model"]["vocab"], model.get("pre_tokenizer") or {}, model["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        bare = all(not model["model"].get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        usual = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not model.get("normalizer")
        ids = [vocab.get("".join(p), -1) for p in pairs]
        return bare and usual and ids == list(range(256, 256 + len(ids))) and all(vocab.get(c, 256) < 256 for c in byte_letters())

    def reaches(self, char: str) -> bool:
        """Whether a token holds the character behind another one."""
        return any(char.encode() in x[1:] for x in self.spelled)


#: A word's or a text's tokens: packed ids of both sides, and the written groups; nothing where bytes differ.
Entry = tuple[bytes, bytes, bytes] | tuple[()]


@dataclass(frozen=True)
class Pair:
    """Two vocabularies, and how their tokens are found and set side by side."""

    a: Tokenizer
    b: Tokenizer

    def __getstate__(self) -> dict:
        return {"a": self.a, "b": self.b}

    @cached_property
    def words(self) -> re.Pattern:
        """Words: they begin where white space follows anything else and no token of ``b`` reaches over; byte-level words never do."""
        cuts = "".join(re.escape(c) for c in " \n\t\r\x0b\x0c" if not self.b.reaches(c) or c == " " and not any(b" " in x.lstrip(b" ") for x in self.b.spelled))
        return re.compile(rf"\s*\S+(?:[^\S{cuts}]\s*\S*)*|\s+" if cuts else r"(?s).+")

    def single(self, text: str) -> Entry:
        """A word by itself; nothing if the tokens' bytes aren't its own."""
        ids = [np.array(t.run([text])[0], dtype=np.int64) for t in (self.a, self.b)]
        if any(b"".join([t.spelled[i] for i in x]) != text.encode() for t, x in zip((self.a, self.b), ids, strict=True)):
            return ()
        met = Aligned(self, ids[0], np.array([len(ids[0])]), ids[1], np.array([len(ids[1])]))
        return self.packed(ids[0]), self.packed(ids[1]), met.written()[0]

    def encode_words(self, found: list[str]) -> dict[str, Entry]:
        """Distinct words, each beginning with white space as in a text: aligned end to end, those that end with white space or hold the mark singly."""
        if any(MARK in w or w[-1].isspace() or not w[0].isspace() for w in found):
            odd = {w: self.single(w) for w in found if MARK in w or w[-1].isspace() or not w[0].isspace()}
            return odd | self.encode_words([w for w in found if w not in odd])
        if not found:
            return {}
        text = "".join(found)
        raw = text.encode()
        ends = np.cumsum([len(w) for w in found] if text.isascii() else [len(w.encode()) for w in found], dtype=np.int64)
        sides: list[np.ndarray] = []
        for t in (self.a, self.b):
            lists = t.run([text] if t.kind == "bytes" else found)
            ids = np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=sum(map(len, lists)))
            stops = np.cumsum(t.lengths[ids])
            at = np.minimum(np.searchsorted(stops, ends), len(stops) - 1)
            if b"".join([t.spelled[i] for i in ids.tolist()]) != raw or not np.array_equal(stops[at], ends):
                return {w: self.single(w) for w in found}
            sides += [ids, at + 1]
        cut = [[blob[x:y] for x, y in pairwise([0, *(stop * self.width).tolist()])] for blob, stop in zip(map(self.packed, sides[::2]), sides[1::2], strict=True)]
        return dict(zip(found, zip(*cut, Aligned(self, *sides).written(), strict=True), strict=True))

    @cached_property
    def kind(self) -> type:
        return np.uint16 if max(len(self.a.spelled), len(self.b.spelled)) <= 1 << 16 else np.uint32

    @property
    def width(self) -> int:
        return np.dtype(self.kind).itemsize

    def packed(self, ids: np.ndarray) -> bytes:
        return ids.astype(self.kind).tobytes()

    def ids(self, packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Packed ids laid end to end, and where each ends."""
        return np.frombuffer(b"".join(packed), dtype=self.kind).astype(np.int64), np.cumsum([len(x) // self.width for x in packed], dtype=np.int64)

    def aligned(self, a_parts: list[bytes], b_parts: list[bytes]) -> Aligned:
        return Aligned(self, *self.ids(a_parts), *self.ids(b_parts))


@dataclass
class Aligned:
    """Tokens of both sides, texts laid end to end; where each text's tokens end."""

    pair: Pair
    a: np.ndarray
    a_stop: np.ndarray
    b: np.ndarray
    b_stop: np.ndarray

    @cached_property
    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        return np.cumsum(self.pair.a.lengths[self.a]), np.cumsum(self.pair.b.lengths[self.b])

    @cached_property
    def cuts(self) -> np.ndarray:
        return np.intersect1d(*self.ends, assume_unique=True)

    @cached_property
    def partners(self) -> np.ndarray:
        """How many tokens of b each token of a overlaps: from the first that ends behind its start to the first that ends no sooner."""
        ends_a, ends_b = self.ends
        self.first = np.searchsorted(ends_b, ends_a - self.pair.a.lengths[self.a], "right")
        return np.searchsorted(ends_b, ends_a, "left") - self.first + 1

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The id pair of every link, text by text, as one number; where each text's links end."""
        n = self.partners
        to = np.cumsum(n)
        total = int(to[-1]) if len(to) else 0
        b = np.arange(total) - np.repeat(to - n - self.first, n)
        return np.repeat(self.a, n) * len(self.pair.b.spelled) + self.b[b], np.concatenate([[0], to])[self.a_stop]

    def written(self) -> list[bytes]:
        """Each text's groups, ``a1,a2|b1;a3|b2,b3``."""
        ends_a, ends_b = self.ends
        group_a, group_b = np.searchsorted(self.cuts, ends_a), np.searchsorted(self.cuts, ends_b)
        through_a, through_b = np.searchsorted(group_a, np.arange(len(self.cuts)), "right"), np.searchsorted(group_b, np.arange(len(self.cuts)), "right")
        at_a = np.arange(len(self.a)) + np.concatenate([[0], through_b])[group_a]
        at_b = np.arange(len(self.b)) + through_a[group_b]
        (digits_a, n_a), (digits_b, n_b) = self.pair.a.digits, self.pair.b.digits
        wide = max(digits_a.shape[1], digits_b.shape[1])
        made = np.empty((len(self.a) + len(self.b), wide), dtype=np.uint8)
        size = np.empty(len(made), dtype=np.int64)
        made[at_a, : digits_a.shape[1]], size[at_a] = digits_a[self.a], n_a[self.a]
        made[at_b, : digits_b.shape[1]], size[at_b] = digits_b[self.b], n_b[self.b]
        sign = np.full(len(made), ord(","), dtype=np.uint8)
        sign[at_a[through_a - 1]], sign[at_b[through_b - 1]] = ord("|"), ord(";")
        made[np.arange(len(made)), size] = sign
        blob = made[np.arange(wide) <= size[:, None]].tobytes()
        stop = np.concatenate([[0], np.cumsum(size + 1)])[self.a_stop + self.b_stop].tolist()
        return [blob[x : max(x, y - 1)] for x, y in pairwise([0, *stop])]


class Encoder:
    """Texts to packed ids and written groups, in parts; words are remembered, the less recent ones forgotten."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.young: dict[str, Entry] = {}
        self.old: dict[str, Entry] = {}

    def parts(self, texts: list[str]) -> list[list[Entry]]:
        """For each text its parts; none without tokens."""
        split = [self.pair.words.findall(" " + x) if x else [] for x in texts]
        hits = [list(map(self.young.get, words)) for words in split]
        gaps = [[i for i, hit in enumerate(known) if hit is None] for known in hits]
        missing = {words[i]: None for words, at in zip(split, gaps, strict=True) for i in at}
        again = {w: self.old[w] for w in missing if w in self.old}
        self.young.update(again | self.pair.encode_words([w for w in missing if w not in again]))
        out = []
        for words, made, at in zip(split, hits, gaps, strict=True):
            for i in at:
                made[i] = self.young[words[i]]
            out.append([] if () in made else [self._part(made[i : i + PART_WORDS]) for i in range(0, len(made), PART_WORDS)])
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        return out

    def _part(self, words: list[Entry]) -> Entry:
        return b"".join([w[0] for w in words]), b"".join([w[1] for w in words]), b";".join([w[2] for w in words])


#: What a Python worker remembers from task to task: the encoder of the pair it had last.
_LAST: list[tuple[str, Encoder]] = []


def encoder_of(pair: Pair) -> Encoder:
    name = hashlib.sha256(pair.a.content + pair.b.content).hexdigest()
    if not _LAST or _LAST[0][0] != name:
        _LAST[:] = [(name, Encoder(pair))]
    return _LAST[0][1]


_MEASURES = columns(n_a="long", n_b="long", n_groups="long", n_links="long", groups_sha256="string")
_IDS = T.StructType([T.StructField("__a", T.ArrayType(T.BinaryType())), T.StructField("__b", T.ArrayType(T.BinaryType()))])


@dataclass(frozen=True)
class Alignment:
    """docs: a row a text with its measures; pairs: (id_a, id_b, n_links, best)."""

    docs: DataFrame
    pairs: DataFrame


def _runs(lists: list[list], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Slices of the rows with about so many bytes of ids."""
    start = size = 0
    for i, parts in enumerate(lists):
        size += sum(map(len, parts))
        if size >= most or i == len(lists) - 1:
            yield start, i + 1
            start, size = i + 1, 0


def encoded(df: DataFrame, pair: Pair, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every text's measures and packed ids, with a ``__key`` of its own, written to the shared folder."""
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(pair)  # two vocabularies
    kept = T.StructType([T.StructField("__key", T.LongType()), T.StructField("__id", df.schema[id_col].dataType)])
    out = T.StructType([*kept, *_MEASURES, *_IDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        for b in batches:
            texts = [x or "" for x in b.column(2).to_pylist()]
            start = size = 0
            for i, x in enumerate(texts):
                size += len(x)
                if size < CHUNK_CHARS and i < len(texts) - 1:
                    continue
                made = encoder.parts(texts[start : i + 1])
                yield pa.RecordBatch.from_arrays([*(c.slice(start, i + 1 - start) for c in b.columns[:2]), *_measured(encoder.pair, made)], names=out.fieldNames())
                start, size = i + 1, 0

    rows = df.select(F.monotonically_increasing_id().alias("__key"), F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    return materialize(rows.mapInArrow(handing_back(run), out), "alignment-ids", compression="zstd")


def _measured(pair: Pair, texts: list[list[Entry]]) -> list[pa.Array]:
    rows = []
    for text in texts:
        n_a, n_b = (sum(len(p[k]) for p in text) // pair.width for k in (0, 1))
        groups = sum(p[2].count(b"|") for p in text)
        sha = hashlib.sha256(b";".join([p[2] for p in text])).hexdigest() if text else ""
        rows.append((n_a, n_b, groups, n_a + n_b - groups, sha))  # a group of m and n tokens has m + n - 1 links
    kinds = [pa.int64()] * 4 + [pa.string()]
    own = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return [*own, *(pa.array([[p[k] for p in text] for text in texts], pa.list_(pa.binary())) for k in (0, 1))]


def _links(pair: Pair, b: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of slices of a batch's rows their links, and where each row's links begin, and the last one's end."""
    lists = [b.column(at + k).to_pylist() for k in (0, 1)]
    for x, y in _runs(lists[0]):
        met = pair.aligned(*([p for row in side[x:y] for p in row] for side in lists))
        links, stops = met.links()
        yield x, y, links, np.concatenate([[0], stops])[np.cumsum([0, *(len(row) for row in lists[0][x:y])])]


def counted_pairs(ids: DataFrame, pair: Pair) -> DataFrame:
    """(pair, n): the links of every id pair, counted in the task, by (pair, salt), and by pair."""
    shared = ids.sparkSession.sparkContext.broadcast(pair)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, n = (np.concatenate([x[k] for x in held]) for k in (0, 1))
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            return keys[first], np.add.reduceat(n, first)

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in held[0]], names=["pair", "n"])

        for b in batches:
            for _, _, links, _ in _links(shared.value, b, 0):
                if len(links):
                    held.append(np.unique(links, return_counts=True))
                if sum(len(x[0]) for x in held) > 2 * COUNT_PAIRS:
                    held = [merged()]
                    if len(held[0][0]) > COUNT_PAIRS:
                        yield batch()
                        held = []
        if held:
            held = [merged()]
            yield batch()

    found = ids.select("__a", "__b").mapInArrow(handing_back(run), columns(pair="long", n="long"))
    salted = found.groupBy("pair", (F.spark_partition_id() % SALTS).alias("salt")).agg(F.sum("n").alias("n"))
    return salted.groupBy("pair").agg(F.sum("n").alias("n"))


def align(df: DataFrame, a: Tokenizer, b: Tokenizer, id_col: str = "doc_id", text_col: str = "text", held_pairs: int = HELD_PAIRS) -> Alignment:
    """Every text with n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair has the corpus-wide largest count of its
    b id, ties too), count_sum (of its links' counts) and groups_sha256; and the pairs with their counts. ``a`` encodes a space
    and the text, ``b`` the text, to which it adds that space.

    ``held_pairs``: so many of the most frequent pairs' counts are sent to all tasks, and the links of others joined.

    Defined cases: a text that is null, empty, or that one of the vocabularies spells otherwise has no tokens: zeros, and an
    empty ``groups_sha256``; texts are taken whole, long ones in parts that end where both vocabularies' tokens do; repeated
    rows and null identifiers are rows of their own, and repeated rows count; other columns are not read; an empty table gives empty tables.
    """
    spark, pair = df.sparkSession, Pair(a, b)
    wide = len(b.spelled)
    ids = encoded(df, pair, id_col, text_col)
    counts = materialize(counted_pairs(ids, pair), "alignment-counts")
    top = counts.groupBy((F.col("pair") % wide).alias("id_b")).agg(F.max("n").alias("top"))
    counts = materialize(counts.withColumn("id_b", F.col("pair") % wide).join(top, "id_b").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "alignment-pairs")
    held, least = _held(counts, held_pairs)
    shared = spark.sparkContext.broadcast((pair, *held))
    out = T.StructType([*ids.drop("__a", "__b").schema, *columns(__best="long", __sum="long", __rare="long[]", __times="long[]")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, keys, n, best = shared.value
        for b in batches:
            done = {k: [] for k in ("best", "sum", "rare", "times")}
            for _, _, links, stops in _links(pair, b, b.num_columns - 2):
                at = np.minimum(np.searchsorted(keys, links), max(0, len(keys) - 1))
                hit = keys[at] == links if len(keys) else np.zeros(len(links), dtype=bool)
                sums = [np.concatenate([[0], np.cumsum(np.where(hit, x[at], 0))])[stops] if len(keys) else np.zeros(len(stops), dtype=np.int64) for x in (best, n)]
                done["best"] += np.diff(sums[0]).tolist()
                done["sum"] += np.diff(sums[1]).tolist()
                rest = np.concatenate([[0], np.cumsum(~hit)])[stops]
                others = links[~hit]
                for x, y in zip(rest, rest[1:], strict=False):
                    rare, times = np.unique(others[x:y], return_counts=True) if y > x else ((), ())
                    done["rare"].append(rare)
                    done["times"].append(times)
            made = [pa.array(done["best"], pa.int64()), pa.array(done["sum"], pa.int64()), *(pa.array(done[k], pa.list_(pa.int64())) for k in ("rare", "times"))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *made], names=out.fieldNames())

    scored = materialize(ids.mapInArrow(handing_back(run), out), "alignment-scored")
    rare = scored.where(F.size("__rare") > 0).select("__key", F.explode(F.arrays_zip("__rare", "__times")).alias("r")).select("__key", F.col("r.__rare").alias("pair"), F.col("r.__times").alias("times"))
    met = rare.join(counts.where(F.col("n") < least), "pair").groupBy("__key").agg(F.sum(F.col("times") * F.col("n")).alias("more"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("better"))
    plus = lambda x, y: (F.col(x) + F.coalesce(F.col(y), F.lit(0))).cast("long")
    docs = scored.join(met, "__key", "left").select(
        F.col("__id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", plus("__best", "better").alias("n_best"), plus("__sum", "more").alias("count_sum"), "groups_sha256"
    )
    split: Column = F.floor(F.col("pair") / wide)
    pairs = counts.select(split.cast("int").alias("id_a"), (F.col("pair") % wide).cast("int").alias("id_b"), F.col("n").alias("n_links"), "best")
    return Alignment(docs, pairs)


def _held(counts: DataFrame, most: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], int]:
    """The pairs, counts and best marks, by pair, of all pairs as frequent as some number, which is given too: at most ``most``."""
    level = F.floor(F.log2("n") * 8).cast("int")
    sizes = counts.groupBy(level.alias("level")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).orderBy(F.desc("level")).collect()  # a few hundred
    total, least = 0, 1 << 62
    for r in sizes:
        if total + r["pairs"] > most:
            break
        total, least = total + r["pairs"], r["least"]
    got = counts.where(F.col("n") >= least).toArrow().sort_by("pair")
    return (got["pair"].to_numpy(), got["n"].to_numpy(), got["best"].to_numpy(zero_copy_only=False).astype(np.int64)), least
