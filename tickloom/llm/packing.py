"""Best-fit packing of tokenised documents by a tree of residual bins.

Every document becomes its token ids and one end id.  Documents longer than the
limit are cut into pieces of the limit; full pieces are sequences of their own.
The rest is dealt by hash into partitions of about ``per_task`` items, so that each
holds the same mixture of lengths, and packed there best fit, longest first.  Bins
with at most ``slack`` free places are finished.  The others go up a tree: each node
packs the open bins of ``fan`` children as items, whole, again best fit, finishes
what is nearly full and hands on at most ``carry`` bins, the emptiest.  Bins beyond
are finished as they are, so no node ever holds more than ``fan * carry`` bins and no
document is lost.

Only (piece, length) pairs are packed; places are joined back to the pieces.

Defined results: a null or empty text is the end id alone; a null id is kept; equal
rows are packed each on its own; an empty table gives no rows; of other columns only
those asked for are read.  Very long texts are tokenised in segments that end at
white space, so memory follows the segment and the longest word, not the text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled

LIMIT = 4096
END_ID = 1
PER_TASK = 16_384    # items packed by one task
FAN = 8              # children of a node
CARRY = 4096         # open bins a node hands on
SEGMENT = 1 << 20    # characters tokenised at a time
SHORT_WORD = 64      # longer words are not remembered
REMEMBERED = 3 << 17  # words a worker remembers, and as many of those before
PIECE_SCHEMA = "piece int, start long, length long, ids binary"

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: words that the vocabulary's normalisation leaves as they are and does not cut
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
_STOP = re.compile(rb"[.,;:!?](?<=[0-9A-Za-z].)[.,;:!?]*(?=[\x20\x09-\x0D0-9A-Za-z]|\Z)")


def byte_letters() -> dict[int, str]:
    """The letters from U+00DF to U+00FF in the alphabet of byte-level vocabularies.

    There, printable Latin-1 bytes stand for themselves and the others, in order, for
    the code points from 256 on.
    """
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = [b for b in range(256) if b not in printable]
    shown = {b: chr(b) if b in printable else chr(256 + moved.index(b)) for b in range(256)}
    return {c: "".join(shown[b] for b in chr(c).encode()) for c in range(0xDF, 0x100)}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    """Token ids of UTF-8 texts as little-endian 32-bit numbers, remembered per word.

    The vocabulary drops white space and no token crosses it, so the ids of a text
    are those of its words one after the other.  Only ASCII white space is cut at;
    whatever else the vocabulary takes for white space stays inside a word.
    """

    def __init__(self, vocabulary: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(vocabulary)
        # the same merges without normalisation, for words that need none
        bare = {**json.loads(vocabulary), "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        self.letters = byte_letters()
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _learn(self, words: set[bytes]) -> None:
        """Remember words not seen yet."""
        plain, other = {}, {}
        for w in words:
            text = w.decode()
            (plain if _PLAIN.fullmatch(text) else other)[w] = text
        if plain:
            got = self.bare.encode([t if t.isascii() else t.translate(self.letters) for t in plain.values()], is_pretokenized=True, add_special_tokens=False)
            self._keep(plain, got.ids, np.searchsorted(np.array(got.word_ids), np.arange(1, len(plain) + 1)))
        if other:
            got = self.model.encode(" ".join(other.values()), add_special_tokens=False)
            ends = np.cumsum([len(t) + 1 for t in other.values()])
            self._keep(other, got.ids, np.searchsorted(np.array([a for a, _ in got.offsets], np.int64), ends))

    def _keep(self, words: dict[bytes, str], ids: list[int], ends: np.ndarray) -> None:
        packed, last = np.array(ids, "<u4").tobytes(), 0
        for word, at in zip(words, (4 * ends).tolist()):
            self.known[word] = packed[last:at]
            last = at

    def _long(self, word: bytes) -> bytes:
        return np.array(self.model.encode(word.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def segments(self, text: bytes) -> Iterator[bytes]:
        at = 0
        while len(text) - at > SEGMENT:
            gap = _SPACE.search(text, at + SEGMENT)
            if gap is None:
                break
            yield text[at : gap.start()]
            at = gap.end()
        yield text[at:]

    def encode(self, texts: Sequence[bytes | None]) -> Iterator[bytes]:
        group: list[bytes] = []
        size = 0
        for text in texts:
            text = text or b""
            if size + len(text) > SEGMENT:
                yield from self._group(group)
                group, size = [], 0
            if len(text) > SEGMENT:
                yield b"".join([self._group([part])[0] for part in self.segments(text)])
            else:
                group.append(text)
                size += len(text)
        yield from self._group(group)

    def _group(self, texts: list[bytes]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        # small ASCII letters, and a gap before stops where a token ends in any case, make fewer words;
        # special tokens are written in small letters, so texts that may hold one keep their case
        cut = [_STOP.sub(rb" \g<0>", t if b"<|" in t else t.lower()).split() for t in texts]  # at ASCII white space
        got = [list(map(self.known.get, words)) for words in cut]
        gaps = [(i, [k for k, ids in enumerate(row) if ids is None]) for i, row in enumerate(got) if None in row]
        wanted = {cut[i][k] for i, at in gaps for k in at}
        long = {w: self._long(w) for w in wanted if len(w) > SHORT_WORD}
        fresh = set()
        for w in wanted.difference(long):
            ids = self.older.get(w)
            if ids is None:
                fresh.add(w)
            else:
                self.known[w] = ids
        self._learn(fresh)
        for i, at in gaps:
            row, words = got[i], cut[i]
            for k in at:
                row[k] = long[words[k]] if words[k] in long else self.known[words[k]]
        return [b"".join(row) for row in got]


@lru_cache(maxsize=2)
def _tokenizer(vocabulary: str) -> WordTokenizer:
    return WordTokenizer(vocabulary)


def token_pieces(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length and ids (packed 32-bit numbers) of every piece of every document."""
    with open(tokenizer or default_tokenizer(), encoding="utf-8") as file:
        vocabulary = docs.sparkSession.sparkContext.broadcast(file.read())  # a file of fixed size
    end = int(end_id).to_bytes(4, "little")
    width = 4 * limit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _tokenizer(vocabulary.value)
        for batch in batches:
            rows: list[int] = []
            number: list[int] = []
            parts: list[bytes] = []
            size = 0

            def table() -> pa.RecordBatch:
                count = np.array([len(p) // 4 for p in parts], np.int64)
                place = np.array(number, np.int64)
                return pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(place.astype(np.int32)), pa.array(place * limit),
                     pa.array(count), pa.array(parts, pa.binary())],
                    ["doc_id", "piece", "start", "length", "ids"])

            for i, ids in enumerate(model.encode(batch.column(1).cast(pa.binary()).to_pylist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), width)):
                    rows.append(i)
                    number.append(k)
                    parts.append(ids[at : at + width])
                size += len(ids)
                if size > 8 << 20:
                    yield table()
                    rows, number, parts, size = [], [], [], 0
            if rows:
                yield table()

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, {PIECE_SCHEMA}")


def best_fit(length: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leader (index of a bin's first item), place in the bin, and the bin's fill, per item.

    Longest items first, each into the fullest bin that holds it.  Bins are kept by
    their free places, which are at most ``limit``, so an item costs one look-up.
    """
    free: list[list[int]] = [[] for _ in range(limit + 1)]
    leader, place, fill = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    open_ = 0  # bit r: some bin has r places left
    order = np.argsort(-length, kind="stable").tolist()
    size = length.tolist()
    for i in order:
        need = size[i]
        fits = open_ >> need
        if fits:
            left = need + (fits & -fits).bit_length() - 1
            stack = free[left]
            first = stack.pop()
            if not stack:
                open_ &= ~(1 << left)
        else:
            left, first = limit, i
        leader[i], place[i] = first, limit - left
        fill[first] = limit - left + need
        left -= need
        if left:
            free[left].append(first)
            open_ |= 1 << left
    return leader, place, fill[leader]


def _packed(keys: np.ndarray, length: np.ndarray, node: int, limit: int, slack: int, carry: int) -> pa.RecordBatch:
    """Each item's bin and place; ``up`` marks the leaders of the bins that go to the next node."""
    leader, place, fill = best_fit(length, limit)
    up = (leader == np.arange(len(length))) & (fill < limit - slack)
    at = np.flatnonzero(up)
    if len(at) > carry:
        up[at[np.argsort(fill[at], kind="stable")[carry:]]] = False
    return pa.RecordBatch.from_arrays(
        [pa.array(keys), pa.array(keys[leader]), pa.array(place), pa.array(fill), pa.array(up), pa.array(np.full(len(keys), node, np.int64))],
        ["child", "parent", "shift", "fill", "up", "node"])


LINKS = "child long, parent long, shift long, fill long, up boolean, node long"


def _pack_partition(limit: int, slack: int, carry: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if got:
            keys, length = (np.concatenate(x) for x in zip(*got))
            yield _packed(keys, length, TaskContext.get().partitionId(), limit, slack, carry)

    return run


def _pack_node(limit: int, slack: int, carry: int) -> Callable:
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("child")
        batch = _packed(table["child"].to_numpy(), table["fill"].to_numpy(), key[0].as_py(), limit, slack, carry)
        return pa.Table.from_batches([batch])

    return run


def assign(items: DataFrame, limit: int = LIMIT, slack: int | None = None, per_task: int = PER_TASK, fan: int = FAN, carry: int = CARRY) -> DataFrame:
    """sequence_id and offset of each item of ``items`` (key long, unique; length long, 1 to ``limit``)."""
    slack = limit // 512 if slack is None else slack
    nodes = max(1, -(-items.count() // per_task))
    dealt = items.select("key", F.col("length").cast("long")).repartition(nodes, "key")
    first = settled(dealt.mapInArrow(_pack_partition(limit, slack, carry), LINKS), "packed")
    levels = []
    rows = first
    while nodes > 1:
        nodes = -(-nodes // fan)
        waiting = rows.where("up").select("child", "fill", F.floor(F.col("node") / F.lit(fan)).cast("long").alias("node"))
        rows = settled(waiting.groupBy("node").applyInArrow(_pack_node(limit, slack, carry), LINKS), "merged")
        levels.append(rows)
    roots = None
    for level in reversed(levels):
        own = level.select("child", F.col("parent").alias("_p"), F.col("shift").alias("_s"))
        if roots is None:
            roots = own
        else:
            high = roots.select(F.col("child").alias("_c"), F.col("_p").alias("_hp"), F.col("_s").alias("_hs"))
            roots = own.join(high, F.col("_p") == F.col("_c"), "left").select(
                "child", F.coalesce("_hp", "_p").alias("_p"), (F.col("_s") + F.coalesce("_hs", F.lit(0))).alias("_s"))
    if roots is None:
        return first.select(F.col("child").alias("key"), F.col("parent").alias("sequence_id"), F.col("shift").alias("offset"))
    moved = roots.select(F.col("child").alias("_c"), "_p", "_s")
    joined = first.join(moved, F.col("parent") == F.col("_c"), "left")
    return joined.select(F.col("child").alias("key"), F.coalesce("_p", "parent").alias("sequence_id"), (F.col("shift") + F.coalesce("_s", F.lit(0))).alias("offset"))


def pack(pieces: DataFrame, limit: int = LIMIT, **options) -> DataFrame:
    """The pieces (any columns, with ``length``) and the ``sequence_id`` and ``offset`` of each."""
    kept = settled(pieces.withColumn("_llm_key", F.monotonically_increasing_id()), "pieces")
    places = assign(kept.where(F.col("length") < limit).select(F.col("_llm_key").alias("key"), "length"), limit, **options)
    places = places.withColumnsRenamed({"key": "_llm_at", "sequence_id": "_llm_sequence", "offset": "_llm_offset"})
    both = kept.join(places, F.col("_llm_key") == F.col("_llm_at"), "left")
    return both.select(*pieces.columns, F.coalesce("_llm_sequence", "_llm_key").alias("sequence_id"), F.coalesce("_llm_offset", F.lit(0)).cast("long").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: its ids in order, packed, and its length; ``packed`` holds ``ids``."""
    places = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most ``limit`` ids together
    joined = packed.groupBy("sequence_id").agg(places.alias("_parts"), F.sum("length").alias("length"))
    whole = F.aggregate("_parts", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["ids"]))
    return joined.select("sequence_id", "length", whole.alias("ids"))


def packed_digest(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece."""
    pieces = token_pieces(docs, tokenizer).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return pack(pieces)
