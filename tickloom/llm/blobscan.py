r"""Secret scans over an incremental ledger of content-addressed blobs.

Each version of each path is addressed by the SHA-256 of its text.  A ledger table
notes, per blob, which rule versions have scanned it and what they found.  A scan
reads the ledger, takes from the given versions only blobs with a rule version not
yet noted, scans each such blob once with the rules it lacks, appends to the
ledger, and joins the findings of the current rules back to all paths.

Defined results: a null text is the empty blob; equal texts share one scan; an
unpaired or empty text has no findings; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import named, settled, text_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret: pattern, least size of ``group``, byte strings one of which must occur (any case)."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False
    hints: tuple[bytes, ...] = ()

    @property
    def version(self) -> str:
        return f"{self.kind}@{hashlib.sha256(repr((self.pattern, self.least, self.group, self.any_case)).encode()).hexdigest()[:16]}"


#: base kinds, in their fixed order, then the kinds added here
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True, (b"password", b"passwd", b"secret", b"token", b"api")),
    Rule("access", r"AKIA[A-Z0-9]+", 18, 0, False, (b"akia",)),
    # runs are maximal, so asking for the least size in the pattern is the same as dropping shorter ones
    Rule("hex", r"[0-9a-f]{16,}", 16),
)
ADDED = (
    Rule("private", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, 0, False, (b"private key-----",)),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0, False, (b"eyj",)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, False, (b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_")),
    Rule("urlauth", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]{1,64}:[^\s/@]{6,64}@", 0, 0, False, (b"://",)),
)
RULES = BASE + ADDED
FOUND = "array<struct<rule string, start long, stop long>>"
LEDGER = f"blob binary, rules array<string>, found {FOUND}"


def find(text: str, rules: Sequence[Rule], compiled: dict[str, re.Pattern]) -> list[tuple[str, int, int]]:
    """(rule version, start, end) in code points, leftmost non-overlapping per rule."""
    low = text.encode("utf-8", "surrogatepass").lower()
    out = []
    for rule in rules:
        if rule.hints and not any(h in low for h in rule.hints):
            continue
        for m in compiled[rule.version].finditer(text):
            if m.end(rule.group) - m.start(rule.group) >= rule.least:
                out.append((rule.version, m.start(), m.end()))
    return out


def _scan(rules: Sequence[Rule]):
    by = {r.version: r for r in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = {v: re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.any_case else 0)) for v, r in by.items()}
        kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))
        for batch in batches:
            lacks = batch.column(1).to_pylist()
            found = [find(t.as_py(), [by[v] for v in lack], compiled) for t, lack in zip(batch.column(2), lacks)]
            rows = [[{"rule": v, "start": a, "stop": b} for v, a, b in f] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, kind)], ["blob", "rules", "found"])

    return run


def read_ledger(spark, path: str) -> DataFrame:
    """The ledger so far; empty where nothing is written yet."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(LEDGER).parquet(path) if there else spark.createDataFrame([], LEDGER)


def address(text: str = "text"):
    return F.unhex(F.sha2(F.encode(text_of(text), "UTF-8"), 256))


def scan(versions: DataFrame, ledger: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Scan what the ledger at ``ledger`` has not seen, append it there, and return the ledger's rows as a table.

    Scans may overlap: both then append what neither saw, so a blob and rule version can have several equal rows.

    ``versions`` has a ``text`` column, one row per path and version.
    """
    spark = versions.sparkSession
    wanted = F.array(*[F.lit(r.version) for r in rules])
    seen = read_ledger(spark, ledger).groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("_seen"))  # one entry per change of rules
    blobs = versions.select(address().alias("blob"), text_of().alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    lacking = blobs.join(seen, "blob", "left").select("blob", F.array_except(wanted, F.coalesce("_seen", F.array().cast("array<string>"))).alias("rules"), "text")
    lacking.where(F.size("rules") > 0).mapInArrow(_scan(rules), LEDGER).write.mode("append").parquet(ledger)
    return read_ledger(spark, ledger)


def findings(versions: DataFrame, ledger: str, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Every row of ``versions`` without its text, with ``found``: kind, start and end of each secret of the current rules.

    ``found`` is ordered by start, then by the rules' order.
    """
    current = {r.version: i for i, r in enumerate(rules)}
    book = scan(versions, ledger, rules)
    rank = F.create_map(*[F.lit(x) for pair in current.items() for x in pair])
    kind = lambda s: F.struct(s["start"].alias("start"), F.element_at(rank, s["rule"]).alias("rank"), s["stop"].alias("stop"))
    valid = F.filter("found", lambda s: s["rule"].isin(*current))
    hits = book.where(F.size(valid) > 0).select("blob", F.transform(valid, kind).alias("_found"))
    # scans that overlapped, or ran again after a lost append, leave a blob's rows more than once: each span counts once
    hits = settled(hits.groupBy("blob").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("_found")))).alias("found")), "findings")
    kept = [c for c in versions.columns if c.lower() not in ("text", "found", "blob")]
    paths = settled(versions.select(*named(kept), address().alias("blob")), "paths")
    names = F.array(*[F.lit(r.kind) for r in rules])
    listed = F.transform(F.coalesce("found", F.array().cast("array<struct<start:bigint,rank:int,stop:bigint>>")),
                        lambda s: F.struct(F.element_at(names, s["rank"] + 1).alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")))
    return paths.join(hits, "blob", "left").select(*named(kept), "blob", listed.alias("found"))


def secret_digest(docs: DataFrame, ledger: str | None = None, rules: Sequence[Rule] = RULES) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, and all spans as text."""
    ledger = ledger or f"{shared_dir(docs.sparkSession).rstrip('/')}/ledger-{uuid.uuid4().hex}"
    got = findings(docs.select("doc_id", "text"), ledger, rules)
    base = [r.kind for r in BASE]
    line = lambda f: F.array_join(F.transform(f, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return got.select("doc_id", *[count(k) for k in base], F.sha2(line(F.filter("found", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"), line(F.col("found")).alias("spans"))
