"""N-gram Jaccard join by grouped prefixes, and the groups of linked documents.

A document's set holds its distinct shingles of five words, as 64-bit hashes; two
documents link when the sets' Jaccard similarity is at least 0.8.

1. *Shared share.* A partner must hold at least 80 % of a document's shingles, so
   documents with fewer shingles seen elsewhere have no link.  Shingles go to hash
   buckets, packed: one four-byte fingerprint and owner per shingle, and one per
   task batch for those a batch holds more than once, so a frequent shingle is not
   one task's burden.  Buckets send counts back per batch.
2. *Classes.* Documents with equal sets are one class; copies are never paired.
3. *Grouped prefixes.* The remaining sets are ordered by frequency, rare first, and
   cut to the prefix that any partner must touch.  Classes with equal prefix and
   size are one group.  Members of a group are verified first.  Groups meet on prefix
   shingles, pairs are filtered by size and position, then tried with one member of
   each and, where that leaves two components, expanded and verified in full.
4. *Hubs.* A list of groups that share a shingle is not paired in full: its first
   few groups meet all others.  Pairs already connected are left out; lists that
   still hold two components go on with eight times the hubs, until every pair is
   either connected or verified.  The result is exact, yet a cluster of m near
   copies costs about m pairs.

Defined results: null or empty texts, and texts without words, have size 0 and link
with nothing; a text of fewer words is one shingle; equal rows are one class; a
component's id is its smallest non-null id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, lookup, named, numbers, released, settled, text_of
from .graph import components
from .words import Words, give_back, mix, sets, slices, tidy

SHINGLE = 5
PERCENT = 80
BUCKET_BYTES = 8 << 20     # of text, for one bucket of shingles
SLICE_BYTES = 4 << 20      # of text, worked on at a time; each gives a row for each bucket
SET_BYTES = 1 << 20        # of text, made sets of at a time
FREQUENT = 1 << 20          # longest broadcast list of frequent shingles
FIRST_HUBS, MORE_HUBS = 2, 8
NOBODY = np.uint32(0xFFFFFFFF)


def key_of(text: str = "text"):
    return F.unhex(F.md5(F.encode(text_of(text), "UTF-8")))


def signature(g: np.ndarray, offsets: np.ndarray) -> list[bytes | None]:
    """Sixteen bytes per set; null for the empty one."""
    full = np.flatnonzero(np.diff(offsets))
    out: list[bytes | None] = [None] * (len(offsets) - 1)
    if len(full):
        one = np.add.reduceat(mix(g), offsets[:-1][full], dtype=np.uint64)
        two = np.add.reduceat(mix(g ^ np.uint64(0x5851F42D4C957F2D)), offsets[:-1][full], dtype=np.uint64)
        for i, a, b in zip(full.tolist(), one, two):
            out[i] = a.tobytes() + b.tobytes()
    return out


def _sorted_runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts x, and the start of each run of equal values."""
    order = np.argsort(x, kind="stable")
    s = x[order]
    return order, np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)


def _scatter(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 3, SLICE_BYTES):
            base = batch.column(1)[0].as_py()
            g, doc, offsets = sets(Words(batch.column(3)), SHINGLE)
            order, first = _sorted_runs(g)
            size = np.diff(np.append(first, len(g)))
            many = np.repeat(size > 1, size)
            known = np.bincount(doc[order[many]], minlength=batch.num_rows)
            value, owner = g[order[first]], np.where(size > 1, NOBODY, doc[order[first]].astype(np.uint32)).astype(np.uint32)
            bucket = ((value >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)
            by, cut = _sorted_runs(bucket)
            ends = np.append(cut, len(bucket))
            low = value.astype(np.uint32)
            k, n = len(cut), batch.num_rows
            none = pa.nulls
            yield pa.RecordBatch.from_arrays([
                pa.array(bucket[by[cut]], pa.int32()), pa.array([base] * k, pa.int64()), pa.array([low[by[a:b]].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary()),
                pa.array([owner[by[a:b]].tobytes() for a, b in zip(ends[:-1], ends[1:])], pa.binary()), none(k, pa.int32()), none(k, batch.column(0).type), none(k, pa.binary()), none(k, pa.int64()), none(k, pa.binary()), none(k, pa.int64())], _COLUMNS)
            place = np.arange(n)
            yield pa.RecordBatch.from_arrays([
                pa.array((place + base) % buckets, pa.int32()), pa.array([base] * n, pa.int64()), none(n, pa.binary()), none(n, pa.binary()), pa.array(place, pa.int32()),
                batch.column(0), batch.column(2), pa.array(np.diff(offsets), pa.int64()), pa.array(signature(g, offsets), pa.binary()), pa.array(known, pa.int64())], _COLUMNS)

    return run


_COLUMNS = ["bucket", "base", "fps", "owners", "place", "doc_id", "key", "n", "sig", "shared"]


def _count(table: pa.Table) -> pa.Table:
    """Fingerprints of one bucket: how many of each owner's stand under another record too; documents pass through."""
    give_back()  # what the bucket before held
    table = table.combine_chunks()
    packed = table.filter(pc.is_valid(table["fps"]))
    rows = table.filter(pc.is_valid(table["place"]))
    out = [rows.select(["base", "owners", "place", "doc_id", "key", "n", "sig", "shared"]).append_column("counts", pa.nulls(rows.num_rows, pa.binary()))]
    if packed.num_rows:
        bases = packed["base"].to_pylist()
        fps = [np.frombuffer(x, np.uint32) for x in packed["fps"].to_pylist()]
        owners = [np.frombuffer(x, np.uint32) for x in packed["owners"].to_pylist()]
        fp = np.concatenate(fps)
        order, first = _sorted_runs(fp)
        size = np.diff(np.append(first, len(fp)))
        hit = np.zeros(len(fp), bool)
        hit[order] = np.repeat(size > 1, size)
        at, made = 0, []
        for base, own in zip(bases, owners):
            mine = own[hit[at : at + len(own)]]
            at += len(own)
            who, n = np.unique(mine[mine != NOBODY], return_counts=True)
            if len(who):
                made.append((base, who.tobytes(), n.astype(np.uint32).tobytes()))
        none, k = pa.nulls, len(made)
        out.append(pa.table({"base": pa.array([m[0] for m in made], pa.int64()), "owners": pa.array([m[1] for m in made], pa.binary()), "place": none(k, pa.int32()), "doc_id": none(k, table["doc_id"].type),
                             "key": none(k, pa.binary()), "n": none(k, pa.int64()), "sig": none(k, pa.binary()), "shared": none(k, pa.int64()), "counts": pa.array([m[2] for m in made], pa.binary())}))
    return pa.concat_tables(out)


def _gather(table: pa.Table) -> pa.Table:
    """Documents of one batch with the sum of their shared shingles."""
    rows = table.filter(pc.is_valid(table["place"])).combine_chunks()
    packed = table.filter(pc.is_valid(table["counts"]))
    place = rows["place"].to_numpy()
    total = np.zeros(int(place.max()) + 1 if len(place) else 1, np.int64)
    for who, n in zip(packed["owners"].to_pylist(), packed["counts"].to_pylist()):
        total[np.frombuffer(who, np.uint32)] += np.frombuffer(n, np.uint32)
    shared = rows["shared"].to_numpy() + total[place]
    return rows.select(["doc_id", "key", "n", "sig"]).append_column("shared", pa.array(shared, pa.int64()))


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), n (set size), sig (of the set) and the number of shingles shared with other rows."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_of())), F.lit(0))).first()[0]
    buckets = int(size // BUCKET_BYTES) + 1
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), key_of().alias("key"), text_of().alias("text"))
    packed = rows.mapInArrow(tidy(_scatter(buckets)), f"bucket int, base long, fps binary, owners binary, place int, doc_id {kind}, key binary, n long, sig binary, shared long")
    counted = packed.groupBy("bucket").applyInArrow(_count, f"base long, owners binary, place int, doc_id {kind}, key binary, n long, sig binary, shared long, counts binary")
    return settled(counted.groupBy("base").applyInArrow(_gather, f"doc_id {kind}, key binary, n long, sig binary, shared long"), "profiles")


def _class_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1, SET_BYTES):
        g, _, offsets = sets(Words(batch.column(1)), SHINGLE)
        flat = pa.array(g.astype(np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], ["sig", "members"])


def class_sets(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """id, sig, n and the set (``members``) of each class that can have a link."""
    able = rows.where((F.col("n") > 0) & (F.col("shared") * 100 >= F.col("n") * PERCENT))
    wanted = settled(able.groupBy("sig").agg(F.min("key").alias("key"), F.max("n").alias("n")), "wanted")
    texts = docs.select(key_of().alias("key"), text_of().alias("text"))
    small = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted  # 40 bytes a row
    found = texts.join(small, "key").select("sig", "text").mapInArrow(tidy(_class_sets), "sig binary, members array<long>")
    once = found.groupBy("sig").agg(F.first("members").alias("members"))
    return settled(once.select(F.monotonically_increasing_id().alias("id"), "sig", F.size("members").cast("long").alias("n"), "members"), "sets")


def frequent(classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles held by many classes and their counts, the most frequent ``FREQUENT`` at most; rarer ones count as equal.

    Any order of shingles gives the same links; this one keeps lists short.
    """
    counts = settled(classes.select(F.explode("members").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 2"), "counts")
    levels = counts.groupBy(F.floor(F.log2("c")).cast("int").alias("level")).count().collect()  # at most 64 rows
    least, left = 64, FREQUENT
    for row in sorted(levels, key=lambda r: -r["level"]):
        if row["count"] > left:
            break
        left -= row["count"]
        least = row["level"]
    h, c = numbers(counts.where(F.floor(F.log2("c")) >= least), ["h", "c"])
    order = np.argsort(h)
    return h[order], c[order]


def _prefixes(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, counts = shared.value
        for batch in batches:
            gids, prefixes = [], []
            for n, members in zip(batch.column(1).to_pylist(), batch.column(2)):
                h = members.values.to_numpy()
                order = np.zeros(len(h), np.int64)
                if len(hot):
                    slot = np.minimum(np.searchsorted(hot, h), len(hot) - 1)
                    order = np.where(hot[slot] == h, counts[slot], 0)
                size = n - -(-PERCENT * n // 100) + 1
                cut = h[np.lexsort((h, order))[:size]]
                prefixes.append(cut)
                gids.append(mix(cut.astype(np.uint64)).tobytes() + n.to_bytes(8, "little"))
            gid = pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in gids], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), gid, pa.array(prefixes, pa.list_(pa.int64()))], ["id", "n", "gid", "prefix"])

    return run


def needed(a: str, b: str):
    """Least common shingles of sets of these sizes."""
    return F.ceil((F.col(a) + F.col(b)) * PERCENT / F.lit(100.0 + PERCENT))


def _state(grouped: DataFrame, roots: DataFrame) -> DataFrame:
    """Smallest and largest root in each group."""
    return settled(grouped.join(roots, "id").groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high")), "state")


def _apart(x: str = "x_", y: str = "y_"):
    """Whether two groups hold more than one component together."""
    return F.least(f"{x}low", f"{y}low") != F.greatest(f"{x}high", f"{y}high")


def _hub_pairs(members: DataFrame, key: str, low: int, high: int, condition=None) -> DataFrame:
    """Each list's members of rank low < r <= high (by ``order``) with the members after them, as columns x_ and y_."""
    ranked = members.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("order", "who")))
    hubs = settled(ranked.where(F.col("rank") <= high).where(F.col("rank") > low).drop("rank"), "hubs")  # Spark keeps only the first rows of a list on the map side
    fields = [c for c in members.columns if c != key]
    x = hubs.select(F.col(key).alias("_k"), *[F.col(c).alias(f"x_{c}") for c in fields])
    y = members.select(F.col(key), *[F.col(c).alias(f"y_{c}") for c in fields])
    after = (F.col("y_order") > F.col("x_order")) | ((F.col("y_order") == F.col("x_order")) & (F.col("y_who") > F.col("x_who")))
    on = (F.col("_k") == F.col(key)) & after
    return x.join(y, on if condition is None else on & condition)


def _verify(pairs: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """New roots after linking the pairs of classes (x, y) whose sets are similar enough."""
    named = pairs.join(roots.select(F.col("id").alias("x"), F.col("root").alias("rx")), "x").join(roots.select(F.col("id").alias("y"), F.col("root").alias("ry")), "y")
    named = settled(named.where("rx != ry").select("x", "y", "rx", "ry"), "pairs")
    a = classes.select(F.col("id").alias("x"), F.col("members").alias("ma"), F.col("n").alias("na"))
    b = classes.select(F.col("id").alias("y"), F.col("members").alias("mb"), F.col("n").alias("nb"))
    same = F.size(F.array_intersect("ma", "mb"))
    true = named.join(a, "x").join(b, "y").where(same * (100 + PERCENT) >= (F.col("na") + F.col("nb")) * PERCENT).select(F.col("rx").alias("a"), F.col("ry").alias("b"))
    merged = components(true).withColumnsRenamed({"node": "_n", "root": "_r"})
    roots = settled(roots.join(merged, F.col("root") == F.col("_n"), "left").select("id", F.coalesce("_r", "root").alias("root")), "roots")
    released(roots.sparkSession)
    return roots


def _link_inside(grouped: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """Roots after comparing the members of each group."""
    sizes = settled(grouped.groupBy("g").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "group-sizes")
    lists = settled(grouped.join(sizes, "g").select("g", F.xxhash64("id").alias("order"), F.col("id").alias("who"), "size"), "inner")
    low, high = 0, FIRST_HUBS
    while not lists.isEmpty():
        pairs = _hub_pairs(lists, "g", low, high).select(F.col("x_who").alias("x"), F.col("y_who").alias("y"))
        roots = _verify(pairs, classes, roots)
        rest = lists.where(F.col("size") > high + 1)
        if rest.isEmpty():
            break
        open_ = settled(rest.join(roots.withColumnRenamed("id", "who"), "who").groupBy("g").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("g"), "open")
        lists = settled(rest.join(open_, "g", "left_semi"), "inner")
        low, high = high, high * MORE_HUBS
    return roots


def _link_between(sizes: DataFrame, grouped: DataFrame, classes: DataFrame, roots: DataFrame) -> DataFrame:
    """Roots after comparing groups that share a prefix shingle."""
    lists = sizes.select("g", "n", F.posexplode("prefix").alias("pos", "h")).select("h", F.xxhash64("g").alias("order"), F.col("g").alias("who"), "n", "pos")
    lists = settled(lists, "lists")
    counts = settled(lists.groupBy("h").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "list-sizes")
    lists = settled(lists.join(counts, "h"), "lists")
    state = _state(grouped, roots)
    low, high = 0, FIRST_HUBS
    # the first common shingle of a linked pair stands no later than this in either set
    fits = (F.col("x_pos") <= F.col("x_n") - needed("x_n", "y_n")) & (F.col("y_pos") <= F.col("y_n") - needed("x_n", "y_n"))
    while not lists.isEmpty():
        known = settled(lists.join(state.withColumnRenamed("g", "who"), "who"), "lists")
        met = settled(_hub_pairs(known, "h", low, high, fits & _apart()).select(F.col("x_who").alias("gx"), F.col("y_who").alias("gy")).distinct(), "group-pairs")
        for whole in (False, True):  # one member of each group first; then all of those still apart
            people = grouped.join(roots, "id").select("g", "id", "root") if whole else grouped.groupBy("g").agg(F.min("id").alias("id")).join(roots, "id")
            people = settled(people, "people")
            px = people.select(F.col("g").alias("gx"), F.col("id").alias("x"), F.col("root").alias("rx"))
            py = people.select(F.col("g").alias("gy"), F.col("id").alias("y"), F.col("root").alias("ry"))
            both = met.join(px, "gx").join(py, "gy").where("rx != ry")
            roots = _verify(both.select("x", "y"), classes, roots)
            state = _state(grouped, roots)
            x = state.select(F.col("g").alias("gx"), F.col("low").alias("x_low"), F.col("high").alias("x_high"))
            y = state.select(F.col("g").alias("gy"), F.col("low").alias("y_low"), F.col("high").alias("y_high"))
            met = settled(met.join(x, "gx").join(y, "gy").where(_apart()).select("gx", "gy"), "group-pairs")
            if met.isEmpty():
                break
        rest = lists.where(F.col("size") > high + 1)
        if rest.isEmpty():
            break
        open_ = settled(rest.join(state.withColumnRenamed("g", "who"), "who").groupBy("h").agg(F.min("low").alias("a"), F.max("high").alias("b")).where("a != b").select("h"), "open")
        lists = settled(rest.join(open_, "h", "left_semi"), "lists")
        low, high = high, high * MORE_HUBS
    return roots


def links(classes: DataFrame) -> DataFrame:
    """``id`` and ``root`` of every class: the smallest id it is connected with by links."""
    shared = classes.sparkSession.sparkContext.broadcast(frequent(classes))
    cut = settled(classes.select("id", "n", "members").mapInArrow(tidy(_prefixes(shared)), "id long, n long, gid binary, prefix array<long>"), "prefixes")
    sizes = cut.groupBy("gid").agg(F.min("n").alias("n"), F.first("prefix").alias("prefix"))
    sizes = settled(sizes.select("gid", F.monotonically_increasing_id().alias("g"), "n", "prefix"), "groups")
    grouped = settled(cut.join(sizes.select("gid", "g"), "gid").select("id", "g"), "members")
    roots = settled(grouped.select("id", F.col("id").alias("root")), "roots")
    released(classes.sparkSession)
    roots = _link_inside(grouped, classes, roots)
    return _link_between(sizes, grouped, classes, roots)


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_shingles, component_id and component (a key that no id decides) for every row of ``docs``."""
    rows = profiles(docs.select("doc_id", "text"))
    released(docs.sparkSession)
    classes = class_sets(docs, rows)
    released(docs.sparkSession)
    roots = links(classes)
    smallest = settled(rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("first")), "smallest")
    tied = smallest.join(classes.select("sig", "id"), "sig").join(roots, "id").select("sig", "root", "first")
    best = settled(tied.groupBy("root").agg(F.min("first").alias("least"), F.min("sig").alias("component")), "least")
    named = settled(smallest.join(tied.join(best, "root").select("sig", "least", "component"), "sig", "left").select("sig", F.coalesce("least", "first").alias("component_id"), F.coalesce("component", "sig").alias("component")), "named")
    return settled(rows.join(named, "sig", "left").select("doc_id", "key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "component"), "linked")


def component_digest(docs: DataFrame) -> DataFrame:
    return linked(docs).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component, the one with the smallest id; its columns as they are.

    Ids need not be distinct or known: components are told apart by their sets.
    Documents without words all stay.  Of equal rows (id and text) one stays.
    """
    got = linked(docs).where("n_shingles > 0")
    first = got.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("key").alias("k"))).alias("_s"))
    first = settled(first.select(F.col("_s.i").alias("_i"), F.col("_s.k").alias("_k"), F.lit(True).alias("_stays")), "stays")
    seen = got.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("times"))
    told = seen.join(first, seen["doc_id"].eqNullSafe(first["_i"]) & (seen["key"] == first["_k"]), "left")
    act = settled(told.select("doc_id", "key", F.when(F.col("_stays").isNull(), 1).when(F.col("times") > 1, 2).alias("act")).where("act is not null"), "acts")
    rows = docs.select(F.struct(*named(docs.columns)).alias("_row"), F.col("doc_id"), F.when(text_of().rlike(r"[^\x20\x09-\x0D]"), key_of()).alias("key"))
    marked = lookup(rows, act, ["doc_id", "key"], ["act"], F.xxhash64("key", "doc_id"))
    repeated = marked.where("act = 2").groupBy("doc_id", "key").agg(F.first("_row").alias("_row"))
    return marked.where("act is null").select("_row.*").unionByName(repeated.select("_row.*"))
