"""Collocations per language by SON partitioning: local mining, then exact counts.

A phrase found ``support`` times in a language is found, in some shard of the corpus,
at least as often as that shard's share of the language's words asks.  So each shard
(every ``SHARDS``-th partition of the tokenised corpus) is mined completely at that
lower support: words first, then pairs of words frequent in the shard, then triples
whose pairs are.  The union of what is frequent in some shard is then counted over all
texts, by text, and only phrases with the whole support stay.

What is frequent in a shard is passed to the next step as a bit filter.  It never
misses a phrase and lets through a few others, which the exact counts drop; its size
follows the number of phrases up to ``FILTER_BITS``, beyond which it lets through more
and the counts do the rest.  Counting is combined per slice of text and per task
before it is shuffled, so frequent words and phrases do not gather anywhere.  Phrases
are words in a piece; a long text is cut into slices at word ends, and a slice's words
are put in line with those before it.

Defined results: a null text is empty, a null language is ``und`` and so joins the
language of that name; equal rows count each; ids play no part; an empty table gives
no rows.  In the local steps, words and phrases are known by 64-bit hashes; counts
that are returned are of texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, numbers, settled, text_of
from .words import LOWER, hashed, mix, slices, spans, utf8

SUPPORT = 10
LONGEST = 3
SHARDS = 2
FIRST = 2000          # phrases of a language that are returned
KEEP_PERCENT = 50     # a phrase goes if a longer one has this share of its places
SLICE = 2 << 20       # bytes of text counted at a time
CHUNK = 1 << 18       # bytes of text cut into words at a time
COUNTED = 1 << 20     # words, pairs or triples counted together in a task
FILTER_BITS = 1 << 28
LINE = 1 << 15        # words of a line, and as many more as its last piece has
ROW_GROUP = 8 << 20   # a reader holds a group's lines at once
MILLION = 1_000_000

#: words are runs of anything but space, tab and the separators of pieces
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[ord(c) for c in ".,;:!?\n\v\f\r"]] = True
WORD = ~SEPARATOR
WORD[[9, 32]] = False

_MUL = np.uint64(0x9E3779B97F4A7C15)
_ADD = np.uint64(0xD1B54A32D192ED03)


def language_key(langs: list[str]) -> np.ndarray:
    """A 64-bit number of each language, folded into the hashes of its words; unlike the hash of a word of that name."""
    data, offsets = utf8(pa.array(langs, pa.string()))
    return mix(hashed(data, offsets[:-1], offsets[1:]) * _ADD + _MUL)


def cut_words(data: np.ndarray, offsets: np.ndarray, langs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word, and whether a word continues the piece of the one before.

    Works through chunks of ``CHUNK`` bytes that end between words.
    """
    n = len(data)
    hashes, first, last = [], [], []
    follows = []
    at, before = 0, 0
    while at < n:
        stop = min(n, at + CHUNK)
        while stop < n and WORD[data[stop - 1]] and WORD[data[stop]]:
            gap = np.flatnonzero(~WORD[data[stop : stop + CHUNK]])
            stop = stop + int(gap[0]) if len(gap) else min(n, stop + CHUNK)
        low = LOWER[data[at:stop]]
        inner = offsets[(offsets > at) & (offsets < stop)] - at
        s, e, _ = spans(low, np.concatenate([[0], inner, [stop - at]]).astype(np.int64), WORD)
        if len(s):
            doc = np.searchsorted(offsets, s + at, "right") - 1
            hashes.append(mix(hashed(low, s, e) ^ langs[doc]))
            # a separator or a document's border between two words ends the piece
            marks = np.concatenate([[0], np.cumsum(SEPARATOR[low])])
            near = np.zeros(len(s), bool)
            near[1:] = (marks[s[1:]] == marks[e[:-1]]) & (doc[1:] == doc[:-1])
            if first:
                gap = data[before : s[0] + at]
                near[0] = not SEPARATOR[gap].any() and not ((offsets >= before) & (offsets <= s[0] + at)).any()
            follows.append(near)
            first.append(s + at)
            last.append(e + at)
            before = int(e[-1]) + at
        at = stop
    if not hashes:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none.astype(bool)
    return np.concatenate(hashes), np.concatenate(first), np.concatenate(last), np.concatenate(follows)


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a slice's words by language: shard, number of words, and the words' hashes; 0 ends a piece, and lines end there."""
    shard = TaskContext.get().partitionId() % SHARDS
    for batch in slices(batches, 1, SLICE):
        langs = batch.column(0).to_pylist()
        data, offsets = utf8(batch.column(1))
        names = sorted(set(langs))
        keys = language_key(names)
        number = np.searchsorted(np.array(names, object), np.array(langs, object)) if names else np.zeros(0, np.int64)
        h, start, _, follows = cut_words(data, offsets, keys[number])
        h[h == 0] = 1
        of = number[np.searchsorted(offsets, start, "right") - 1]
        rows = []
        for k in range(len(names)):
            mine = np.flatnonzero(of == k)
            if len(mine):
                place = np.arange(len(mine)) + np.cumsum(~follows[mine])
                line = np.zeros(int(place[-1]) + 2, np.uint64)
                line[place] = h[mine]
                ends = np.flatnonzero(line == 0)
                cuts = np.unique(ends[np.searchsorted(ends, np.arange(LINE, len(line), LINE)).clip(max=len(ends) - 1)])
                rows += [(names[k], shard, int(np.count_nonzero(part)), part.tobytes()) for part in np.split(line, cuts)]
        if rows:
            lang, shards, count, lines = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(shards, pa.int64()), pa.array(count, pa.int64()), pa.array(lines, pa.binary())],
                                             ["lang", "shard", "n", "line"])


def grams(line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the pairs and triples that start at each word (0: there is none)."""
    two = np.zeros(len(line), np.uint64)
    three = np.zeros(len(line), np.uint64)
    if len(line) > 1:
        two[:-1] = np.where((line[:-1] > 0) & (line[1:] > 0), mix(line[:-1] * _MUL + line[1:]) | np.uint64(1), np.uint64(0))
    if len(line) > 2:
        three[:-2] = np.where((two[:-2] > 0) & (two[1:-1] > 0), mix(two[:-2] * _MUL + line[2:] * _ADD) | np.uint64(1), np.uint64(0))
    return two, three


class BitFilter:
    """Which 64-bit keys are in a set: never no for a member, seldom yes for others."""

    def __init__(self, words: np.ndarray) -> None:
        self.bits = words.view(np.uint64)
        self.mask = np.uint64(64 * len(words) - 1)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for shift in (0, 32):
            place = (keys >> np.uint64(shift)) & self.mask
            out &= (self.bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0
        return out


def bit_filter(keys: DataFrame, most_bits: int = FILTER_BITS) -> BitFilter:
    """Filter of the ``h`` (long) of a settled table: about 16 bits a key, at most ``most_bits``.

    Spark sets the bits; at most ``most_bits / 64`` longs come to the driver.
    """
    rows = keys.count()
    bits = 1 << 12
    while bits < min(16 * rows, most_bits):
        bits *= 2
    h = F.col("h")
    place = F.explode(F.array(h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1)))).alias("at")
    set_ = keys.select(place).groupBy(F.shiftrightunsigned("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 AS INT))")).alias("bits"))
    word, value = numbers(set_, ["word", "bits"])
    out = np.zeros(bits // 64, np.int64)
    out[word] = value
    return BitFilter(out)


def in_shard(h: np.ndarray, shard: int) -> np.ndarray:
    return mix(h + np.uint64(shard) * _MUL)


def _counted(keys: np.ndarray) -> tuple[pa.Array, pa.Array]:
    got = pc.value_counts(pa.array(keys.view(np.int64)))
    return got.field("values"), got.field("counts")


def _local(level: int, known: list) -> Callable:
    """Counts of the words (pairs, triples) of each shard whose parts are frequent in that shard.

    Lines of a shard and language are counted together, about ``COUNTED`` words at a time.
    """

    def keys_of(line: np.ndarray, shard: int, words, pairs) -> np.ndarray:
        if level > 1:
            here = line > 0
            here[here] = words(in_shard(line[here], shard))
            line = np.where(here, line, np.uint64(0))
        two, three = grams(line) if level > 1 else (None, None)
        if level > 2:
            here = two > 0
            here[here] = pairs(in_shard(two[here], shard))
            three[:-1][~(here[:-1] & here[1:])] = 0
        got = (line, two, three)[level - 1]
        return got[got > 0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = [k.value if k is not None else None for k in known]
        waiting: dict[tuple[int, int], list[np.ndarray]] = {}

        def told(of: tuple[int, int]) -> pa.RecordBatch:
            value, count = _counted(np.concatenate(waiting.pop(of)))
            same = lambda x: pa.array(np.full(len(value), x, np.int64))
            return pa.RecordBatch.from_arrays([same(of[0]), value, same(of[1]), count], ["shard", "h", "need", "c"])

        for batch in batches:
            for i in range(batch.num_rows):
                of = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                kept = waiting.setdefault(of, [])
                kept.append(keys_of(np.frombuffer(batch.column(2)[i].as_buffer(), np.uint64), of[0], words, pairs))
                if sum(map(len, kept)) >= COUNTED:
                    yield told(of)
            pa.default_memory_pool().release_unused()
        for of in list(waiting):
            yield told(of)

    return run


def _slices(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Pieces of a byte array as strings."""
    size = end - start
    offsets = np.concatenate([[0], np.cumsum(size)])
    at = np.arange(int(offsets[-1])) + np.repeat(start - offsets[:-1], size)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[at]))


def _texts(known) -> Callable:
    """Words, pairs and triples that are candidates, by text and language, counted per slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = known.value
        for batch in slices(batches, 1, SLICE):
            langs = batch.column(0).to_pylist()
            data, offsets = utf8(batch.column(1))
            names = sorted(set(langs))
            number = np.searchsorted(np.array(names, object), np.array(langs, object)) if names else np.zeros(0, np.int64)
            h, start, end, follows = cut_words(data, offsets, language_key(names)[number])
            if not len(h):
                continue
            h[h == 0] = 1
            of = number[np.searchsorted(offsets, start, "right") - 1]
            place = np.arange(len(h)) + np.cumsum(~follows)
            line = np.zeros(int(place[-1]) + 3, np.uint64)
            line[place] = h
            size = end - start
            first = np.cumsum(size + 1) - size - 1
            plain = np.full(int(first[-1] + size[-1]), 32, np.uint8)  # the words, one space between
            inside = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            plain[inside + np.repeat(first, size)] = LOWER[data[inside + np.repeat(start, size)]]
            word_of = np.full(len(line), -1, np.int64)
            word_of[place] = np.arange(len(h))
            for k, keys in enumerate((line, *grams(line)), 1):
                at = np.flatnonzero(keys)
                at = at[wanted(keys[at])]
                if not len(at):
                    continue
                coded = pa.array(keys[at].view(np.int64)).dictionary_encode()
                index = coded.indices.to_numpy()
                count = np.bincount(index, minlength=len(coded.dictionary))
                one = np.zeros(len(coded.dictionary), np.int64)
                one[index] = at  # some place of each phrase
                w = word_of[one]
                lang = pa.DictionaryArray.from_arrays(pa.array(of[w].astype(np.int32)), pa.array(names, pa.string())).cast(pa.string())
                text = _slices(plain, first[w], first[w + k - 1] + size[w + k - 1])
                yield pa.RecordBatch.from_arrays([lang, text, pa.array(np.full(len(w), k, np.int64)), pa.array(count.astype(np.int64))],
                                                 ["lang", "phrase", "k", "a"])

    return run


def frequent_phrases(docs: DataFrame, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """Every phrase of one to three words with at least ``support`` places (lang, phrase, k, a), and each language's words (lang, n)."""
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().alias("text"))
    lines = settled(texts.mapInArrow(_tokens, "lang string, shard long, n long, line binary"), "lines", ROW_GROUP)
    per_shard = lines.groupBy("lang", "shard").agg(F.sum("n").alias("n"))
    totals = settled(per_shard.groupBy("lang").agg(F.sum("n").alias("n")), "words")
    share = settled(per_shard.join(totals.withColumnRenamed("n", "_all"), "lang").select(
        "lang", "shard", F.ceil(F.col("n").cast("decimal(20,0)") * F.lit(support) / F.col("_all")).cast("long").alias("need")), "support")
    rows = lookup(lines, share, ["lang", "shard"], ["need"], F.xxhash64("line")).select("shard", "need", "line")
    known, found = [None, None], []
    for level in range(1, LONGEST + 1):
        local = rows.mapInArrow(_local(level, list(known)), "shard long, h long, need long, c long")
        # counted per task already, so shuffled as they are
        often = local.repartition("shard", "h").groupBy("shard", "h", "need").agg(F.sum("c").alias("c")).where(F.col("c") >= F.col("need"))
        found.append(settled(often.select("shard", "h"), f"local{level}"))
        if level < LONGEST:
            known[level - 1] = context.broadcast(bit_filter(_shard_keys(found[-1])))
    union = found[0].unionByName(found[1]).unionByName(found[2]).select("h").distinct()
    candidates = context.broadcast(bit_filter(settled(union, "candidates")))
    counted = texts.mapInArrow(_texts(candidates), "lang string, phrase string, k long, a long")
    exact = counted.repartition("lang", "phrase").groupBy("lang", "phrase", "k").agg(F.sum("a").alias("a")).where(F.col("a") >= support)
    return settled(exact, "phrases"), totals


def _shard_keys(found: DataFrame) -> DataFrame:
    """The keys of ``in_shard`` for the phrases of a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard, h = b.column(0).to_numpy().astype(np.uint64), b.column(1).to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(mix(h + shard * _MUL).view(np.int64))], ["h"])

    return settled(found.mapInArrow(run, "h long"), "keys")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) without rounding."""
    wide = lambda c: c.cast("decimal(18,0)")
    top = (wide(a) * wide(a)).cast("decimal(38,0)") * F.lit(MILLION).cast("decimal(7,0)")
    return F.call_function("div", top, (wide(left) * wide(right)).cast("decimal(38,0)")).cast("long")


def scored(phrases: DataFrame, keep_percent: int = KEEP_PERCENT) -> DataFrame:
    """The candidates (two and three words) that no longer one covers: lang, phrase, k, a, l, r, score.

    ``phrases`` is settled and holds every phrase as frequent as the candidates.
    """
    words = F.split("phrase", " ")
    part = lambda name: phrases.select(F.col("lang"), F.col("phrase").alias(f"_{name}"), F.col("a").alias(name))
    longer = phrases.where("k = 3").select("lang", F.explode(F.array(F.array_join(F.slice(words, 1, 2), " "), F.array_join(F.slice(words, 2, 2), " "))).alias("phrase"), "a")
    cover = longer.groupBy("lang", "phrase").agg(F.max("a").alias("_cover"))
    two = phrases.where("k = 2").select("lang", "phrase", "k", "a", F.get(words, F.lit(0)).alias("_l"), F.get(words, F.lit(1)).alias("_r"))
    two = two.join(cover, ["lang", "phrase"], "left").where(F.col("_cover").isNull() | (F.col("_cover") * 100 < F.col("a") * keep_percent)).drop("_cover")
    three = phrases.where("k = 3").select(
        "lang", "phrase", "k", "a", F.get(words, F.lit(0)).alias("_l"), F.array_join(F.slice(words, 2, 2), " ").alias("_r"),
        F.array_join(F.slice(words, 1, 2), " ").alias("_l2"), F.get(words, F.lit(2)).alias("_r2"))
    two = two.join(part("l").where("l is not null"), ["lang", "_l"]).join(part("r"), ["lang", "_r"])
    two = two.select("lang", "phrase", "k", "a", "l", "r", _score(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    three = three.join(part("l"), ["lang", "_l"]).join(part("r"), ["lang", "_r"]).join(part("l2"), ["lang", "_l2"]).join(part("r2"), ["lang", "_r2"])
    one, other = _score(F.col("a"), F.col("l"), F.col("r")), _score(F.col("a"), F.col("l2"), F.col("r2"))
    three = three.withColumns({"_s1": one, "_s2": other})
    early = F.col("_s1") <= F.col("_s2")  # ties to the earlier cut
    three = three.select("lang", "phrase", "k", "a", F.when(early, F.col("l")).otherwise(F.col("l2")).alias("l"), F.when(early, F.col("r")).otherwise(F.col("r2")).alias("r"),
                         F.least("_s1", "_s2").alias("score"))
    return two.unionByName(three)


def collocations(docs: DataFrame, support: int = SUPPORT, first: int = FIRST) -> DataFrame:
    """Each language's ``first`` phrases: lang, rank, phrase, a, l, r, n and score."""
    from ..operators.series import ranged, with_position  # not with the module: Python workers would load pandas

    phrases, totals = frequent_phrases(docs, support)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    placed = with_position(ranged(scored(phrases), ["lang"], order), ["lang"], order, F.col("_rb"), "_at")
    best = placed.where(F.col("_at") < first)
    counts = totals.withColumnsRenamed({"lang": "_lang", "n": "_n"})
    return best.join(counts, F.col("lang") == F.col("_lang")).select(
        "lang", (F.col("_at") + 1).cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("_n").alias("n"), "score")


PHRASES_SQL = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
totals AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY 1),
o AS (SELECT lang, ws, unnest(generate_series(1, len(ws))) AS i FROM w),
g AS (SELECT lang, 1 AS k, ws[i] AS phrase FROM o UNION ALL SELECT lang, 2, ws[i] || ' ' || ws[i + 1] FROM o WHERE i < len(ws)
  UNION ALL SELECT lang, 3, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] FROM o WHERE i + 1 < len(ws)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= {SUPPORT}),
c AS (SELECT lang, phrase, k, a, string_split(phrase, ' ') AS ws, unnest(generate_series(1, k - 1)) AS cut FROM f WHERE k > 1),
halves AS MATERIALIZED (SELECT *, array_to_string(ws[1 : cut], ' ') AS p, array_to_string(ws[cut + 1 : k], ' ') AS q FROM c),
cuts AS (SELECT h.lang, h.phrase, h.k, h.a, h.cut, x.a AS l, y.a AS r, (({MILLION}::HUGEINT * h.a * h.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM halves h JOIN f x ON x.lang = h.lang AND x.phrase = h.p JOIN f y ON y.lang = h.lang AND y.phrase = h.q),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_ AS (SELECT lang, ws[1] || ' ' || ws[2] AS phrase, a FROM halves WHERE k = 3 UNION ALL SELECT lang, ws[2] || ' ' || ws[3], a FROM halves WHERE k = 3),
cover AS (SELECT lang, phrase, max(a) AS most FROM inner_ GROUP BY 1, 2),
kept AS (SELECT best.* FROM best LEFT JOIN cover USING (lang, phrase) WHERE k = 3 OR most IS NULL OR 100 * most < {KEEP_PERCENT} * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {FIRST}
"""
