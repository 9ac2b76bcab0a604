"""Vector compression by part codebooks, with candidate entries remembered per grid cell.

Vectors become integers floor(1024 * x) and are cut into parts.  Each round assigns
every part to the nearest entry of its codebook and moves the entries to the floor of
their parts' means.  A part's nearest entry is looked for in its grid cell only: the
cell is hashed, and for a new cell the entries are kept that no other entry beats
everywhere in the cell's box (their least distance to the box is not above the
smallest greatest distance of any entry).  A worker remembers the kept entries of a
cell while the codebook stands; parts in the same cell are evaluated exactly against
those entries alone.  Cells are as fine as the codebook: a share of the distance
between neighbouring entries.  All arithmetic is exact: doubles where every value is
an integer below 2**53, Python's integers otherwise.

One pass over the vectors a round.  Tasks hand on one row per part, entry and place;
the codebooks (parts x entries x part length) are all that reaches the driver.

Defined results: vectors that are null or hold a null or non-finite component are
dropped; shorter vectors count as filled up with zeros to the longest one, whose
length is rounded up to a multiple of the parts; a null vec_id ranks last and equal
ones by their vectors; fewer vectors than entries make a shorter codebook; errors
beyond a long are given as the largest long; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, numbers, settled
from .words import mix

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
CELL_SHARE = 8         # cells to the distance between neighbouring entries, along the box's diagonal
REMEMBERED = 1 << 16   # cells a worker remembers
NEW_CELLS = 512        # cells bounded at a time
PAIRS = 1 << 17        # (part, entry) pairs evaluated at a time
EXACT = 1 << 53
LARGEST = (1 << 63) - 1
LIMB = 32

_MUL = np.uint64(0x9E3779B97F4A7C15)


def kept_vectors(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector and components are all known and finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) <= F.lit(1.7976931348623157e308)))
    return vectors.where(F.col(vector).isNotNull() & finite)


def integers(values: np.ndarray) -> np.ndarray:
    """floor(1024 * x), as doubles where these are exact, else as Python's integers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * float(SCALE))
    if not len(values) or np.abs(scaled).max() < EXACT:
        return scaled
    return np.array([math.floor(Fraction(x) * SCALE) for x in values.tolist()], object)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of ``width`` integers from a list column, filled up with zeros."""
    size = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = integers(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), flat.dtype)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out


class PartBook:
    """Nearest entries of one part, by remembered cells."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        self.top = max([0, *(abs(int(x)) for x in (entries.min(), entries.max()))]) if entries.size else 0
        self.cells: dict[int, tuple[bytes, np.ndarray]] = {}
        self.ready = False

    def _prepare(self) -> None:
        """Distinct entries (of equal ones the first wins any tie) and the side of a cell."""
        rows = self.entries.astype(np.float64)
        _, first = np.unique(rows, axis=0, return_index=True)
        self.index = np.sort(first)
        self.points = rows[self.index]
        self.norm = (self.points**2).sum(1)
        self.side = 1.0
        if len(self.points) > 1 and rows.shape[1]:
            apart = self.norm[:, None] + self.norm[None, :] - 2 * self.points @ self.points.T
            np.fill_diagonal(apart, np.inf)
            gap = float(np.sqrt(np.median(apart.min(1))))
            self.side = max(1.0, math.floor(gap / (CELL_SHARE * math.sqrt(rows.shape[1]))))
        self.ready = True

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, list | np.ndarray]:
        """Index of the nearest entry and the squared distance, per row."""
        n, width = parts.shape
        if not n or not width:
            return np.zeros(n, np.int64), np.zeros(n, np.int64)
        top = max(abs(int(parts.min())), abs(int(parts.max()))) + self.top
        if parts.dtype == object or self.entries.dtype == object or width * (top + 1) ** 2 >= EXACT:
            return self._any_size(parts)
        if not self.ready:
            self._prepare()
        cell = np.floor(parts / self.side).astype(np.int64)
        h = np.zeros(n, np.uint64)
        for j in range(width):
            h = (h + cell[:, j].astype(np.uint64)) * _MUL
        _, first, at = np.unique(mix(h), return_index=True, return_inverse=True)
        found = self._candidates(cell[first])
        code, error = self._evaluate(parts, found, at)
        other = np.flatnonzero((cell != cell[first][at]).any(1))  # cells that share a hash with another
        if len(other):
            whole = [np.arange(len(self.points))]
            code[other], error[other] = self._evaluate(parts[other], whole, np.zeros(len(other), np.int64))
        return self.index[code], error.astype(np.int64)

    def _candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        keys = [c.tobytes() for c in cells]
        new = [i for i, k in enumerate(keys) if k not in self.cells]
        if len(self.cells) + len(new) > REMEMBERED:
            self.cells.clear()
            new = list(range(len(keys)))
        got: dict[bytes, np.ndarray] = {}
        for at in range(0, len(new), NEW_CELLS):
            some = new[at : at + NEW_CELLS]
            for i, kept in zip(some, self._undominated(cells[some])):
                got[keys[i]] = kept
        out = [got[k] if k in got else self.cells[k] for k in keys]
        if len(got) <= REMEMBERED:
            self.cells.update(got)
        return out

    def _undominated(self, cells: np.ndarray) -> list[np.ndarray]:
        """Entries that are nearest somewhere in the box as far as least and greatest distances tell.

        The ball around the box gives a short list, the box itself decides.
        """
        half = (self.side - 1) / 2
        middle = cells * self.side + half
        square = np.maximum((middle**2).sum(1)[:, None] + self.norm[None, :] - 2 * middle @ self.points.T, 0)
        apart = np.sqrt(square)
        reach = half * math.sqrt(cells.shape[1])
        row, entry = np.nonzero(apart <= (apart.min(1) + 2 * reach)[:, None] * (1 + 1e-9) + 1e-6)
        off = np.abs(middle[row] - self.points[entry])
        least = (np.maximum(off - half, 0) ** 2).sum(1)
        start = np.searchsorted(row, np.arange(len(cells)))
        bound = np.minimum.reduceat(((off + half) ** 2).sum(1), start)
        keep = least <= bound[row]
        return np.split(entry[keep], np.searchsorted(row[keep], np.arange(1, len(cells))))

    def _evaluate(self, parts: np.ndarray, found: list[np.ndarray], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The exact nearest of each row's candidates; of equal distances the first entry."""
        size = np.array([len(f) for f in found], np.int64)
        place = np.cumsum(size) - size
        flat = np.concatenate(found)
        each = size[at]
        code, error = np.zeros(len(parts), np.int64), np.zeros(len(parts))
        ends = np.cumsum(each)
        low = 0
        while low < len(parts):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS, "right")))
            n = each[low:high]
            start = np.cumsum(n) - n
            row = np.repeat(np.arange(high - low), n)
            entry = flat[np.arange(len(row)) - np.repeat(start, n) + np.repeat(place[at[low:high]], n)]
            square = ((parts[low:high][row] - self.points[entry]) ** 2).sum(1)
            best = np.minimum.reduceat(square, start)
            hit = np.flatnonzero(square == best[row])
            first = hit[np.concatenate([[True], row[hit][1:] != row[hit][:-1]])]
            code[low:high], error[low:high] = entry[first], best
            low = high
        return code, error

    def _any_size(self, parts: np.ndarray) -> tuple[np.ndarray, list]:
        """The same with Python's integers, for components of any size."""
        entries = [[int(x) for x in e] for e in self.entries]
        code, error = [], []
        for row in parts:
            values = [int(x) for x in row]
            square, best = min((sum((a - b) ** 2 for a, b in zip(values, e)), i) for i, e in enumerate(entries))
            code.append(best)
            error.append(square)
        return np.array(code, np.int64), error


Books = list[list[list[int]]]  # part, entry, place


def _arrays(books: Books) -> list[np.ndarray]:
    def one(book: list[list[int]]) -> np.ndarray:
        small = all(abs(x) < EXACT for e in book for x in e)
        return np.array(book, np.float64 if small else object).reshape(len(book), -1)

    return [one(b) for b in books]


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """The value as a sum of longs times powers of 2**32."""
    k = 0
    while abs(value) >= 1 << 56:
        yield k, value & ((1 << LIMB) - 1)
        value >>= LIMB
        k += 1
    yield k, value


def _sums(books, width: int) -> Callable:
    """Sums (place >= 0) and counts (place -1) of each entry's parts, one set per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [PartBook(b) for b in _arrays(books.value)]
        parts, each = len(own), width // len(own)
        total = [np.zeros((len(b.entries), each), np.int64) for b in own]
        large: dict[tuple[int, int, int], int] = {}
        count = np.zeros((parts, len(own[0].entries)), np.int64)
        for batch in batches:
            rows = matrix(batch.column(0), width)
            for p, book in enumerate(own):
                x = rows[:, p * each : (p + 1) * each]
                code, _ = book.nearest(x)
                m = len(book.entries)
                count[p] += np.bincount(code, minlength=m)
                if x.dtype != object and x.size and np.abs(x).max() < EXACT / (1 + len(x)):
                    for j in range(each):
                        total[p][:, j] += np.bincount(code, x[:, j], m).astype(np.int64)
                else:
                    for c, row in zip(code.tolist(), x):
                        for j, v in enumerate(row):
                            large[p, c, j] = large.get((p, c, j), 0) + int(v)
        out = [(p, c, -1, 0, int(count[p, c])) for p in range(parts) for c in np.flatnonzero(count[p]).tolist()]
        out += [(p, c, j, 0, int(total[p][c, j])) for p in range(parts) for c, j in zip(*(a.tolist() for a in np.nonzero(total[p])))]
        out += [(p, c, j, k, v) for (p, c, j), value in large.items() for k, v in _limbs(value)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["part", "entry", "place", "limb", "value"])

    return run


def codebooks(kept: DataFrame, vector: str = "embedding", by: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[Books, int]:
    """The codebooks after all rounds, and the padded vector length; ``kept`` is a table, read once a round."""
    longest = kept.agg(F.max(F.size(vector))).first()[0]
    if longest is None:
        return [[] for _ in range(parts)], 0
    width = -(-longest // parts) * parts
    each = width // parts
    start = kept.orderBy(F.asc_nulls_last(by), F.col(vector)).select(vector).limit(entries).collect()  # as many rows as a codebook has
    first = []
    for row in start:
        whole = [int(x) for x in integers(np.array(row[0], np.float64))]
        first.append(whole + [0] * (width - len(whole)))
    books = [[e[p * each : (p + 1) * each] for e in first] for p in range(parts)]
    context = kept.sparkSession.sparkContext
    for _ in range(rounds):
        shared = context.broadcast(books)
        sums = kept.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(_sums(shared, width), "part long, entry long, place long, limb long, value long")
        once = sums.groupBy("part", "entry", "place", "limb").agg(F.sum("value").alias("value"))
        total: dict[tuple[int, int, int], int] = {}
        for p, c, j, k, v in zip(*(a.tolist() for a in numbers(once, ["part", "entry", "place", "limb", "value"]))):
            total[p, c, j] = total.get((p, c, j), 0) + (v << (LIMB * k))
        for p in range(parts):
            for c in range(len(books[p])):
                n = total.get((p, c, -1), 0)
                if n:
                    books[p][c] = [total.get((p, c, j), 0) // n for j in range(each)]
        shared.unpersist()
    return books, width


def encode(kept: DataFrame, books: Books, width: int, vector: str = "embedding") -> DataFrame:
    """The rows with ``code``, two hex digits a part (entry numbers below 256), and ``error`` in place of the vector."""
    shared = kept.sparkSession.sparkContext.broadcast(books)
    rest = [c for c in kept.columns if c != vector]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [PartBook(b) for b in _arrays(shared.value)]
        each = width // len(own)
        for batch in batches:
            rows = matrix(batch.column(len(rest)), width)
            codes, error = [], None
            for p, book in enumerate(own):
                code, square = book.nearest(rows[:, p * each : (p + 1) * each])
                codes.append(code)
                error = square if error is None else [int(a) + int(b) for a, b in zip(error, square)] if isinstance(square, list) or isinstance(error, list) else error + square
            text = np.stack(codes, 1).astype(np.uint8).tobytes().hex()
            step = 2 * len(own)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(rest)], pa.array([text[i * step : (i + 1) * step] for i in range(batch.num_rows)], pa.string()),
                 pa.array([min(int(e), LARGEST) for e in error], pa.int64())],
                [*rest, "code", "error"])

    kinds = dict(kept.dtypes)
    shape = ", ".join(f"`{c}` {kinds[c]}" for c in rest)
    return kept.select(*rest, F.col(vector).cast("array<double>").alias(vector)).mapInArrow(run, f"{shape}, code string, error long")


def decode(coded: DataFrame, books: Books) -> DataFrame:
    """The rows and ``decoded``, the vector that a row's code stands for."""
    shared = coded.sparkSession.sparkContext.broadcast([np.array(b, np.float64) / SCALE for b in books])
    names = coded.columns
    at = names.index("code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.array([list(bytes.fromhex(c)) for c in batch.column(at).to_pylist()], np.int64).reshape(batch.num_rows, -1)
            whole = np.concatenate([b[code[:, p]] for p, b in enumerate(shared.value)], 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(whole), pa.list_(pa.float64()))], [*names, "decoded"])

    shape = ", ".join(f"`{c}` {k}" for c, k in coded.dtypes)
    return coded.mapInArrow(run, f"{shape}, decoded array<double>")


def books_sha256(books: Books) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()


def code_digest(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every vector that is kept."""
    kept = settled(kept_vectors(vectors.select("vec_id", "label", "embedding")), "vectors")
    books, width = codebooks(kept)
    shape = kept.select("vec_id", "label")
    if not width and not books[0]:
        return shape.limit(0).select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    coded = settled(encode(kept, books, width), "codes")
    whole = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LARGEST).cast("decimal(38,0)")).cast("long")
    labels = settled(coded.groupBy("label").agg(whole.alias("label_error")), "labels")
    joined = lookup(coded, labels, ["label"], ["label_error"], F.xxhash64("vec_id"))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def _codes_sql() -> str:
    """The same by comparing every part with every entry, one pair of tables a round."""
    steps = [f"""v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS e, row_number() OVER (ORDER BY vec_id) AS n
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, n, part, e[part * (len(e) // {PARTS}) + 1 : (part + 1) * (len(e) // {PARTS})] AS x FROM v, range({PARTS}) r(part)),
c0 AS MATERIALIZED (SELECT part, n - 1 AS entry, x FROM p WHERE n <= {ENTRIES})"""]
    for k in range(ROUNDS + 1):
        steps.append(f"""d{k} AS MATERIALIZED (SELECT vec_id, part, min({{'d': list_dot_product(p.x, p.x) - 2 * list_dot_product(p.x, c.x) + list_dot_product(c.x, c.x), 'e': entry}}) AS best
  FROM p JOIN c{k} c USING (part) GROUP BY ALL)""")
        if k < ROUNDS:
            steps.append(f"""s{k} AS MATERIALIZED (SELECT part, entry, list(floor(s / n) ORDER BY j) AS x FROM (
  SELECT part, best.e AS entry, j, sum(p.x[j]) AS s, count(*) AS n FROM p JOIN d{k} USING (vec_id, part), unnest(range(1, len(p.x) + 1)) u(j) GROUP BY ALL) GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(s.x, c.x) AS x FROM c{k} c LEFT JOIN s{k} s USING (part, entry))""")
    return f"""WITH {', '.join(steps)},
r AS (SELECT vec_id, string_agg(format('{{:02x}}', best.e::INTEGER), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM d{ROUNDS} GROUP BY 1),
k AS (SELECT sha256(string_agg(x[j]::BIGINT::VARCHAR, ',' ORDER BY part, entry, j)) AS codebooks_sha256 FROM c{ROUNDS}, unnest(range(1, len(x) + 1)) u(j))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM r JOIN v USING (vec_id), k"""


CODES_SQL = _codes_sql()
