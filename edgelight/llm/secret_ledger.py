"""Secret scans over a history of texts: content is scanned once for each version of a pack of rules, and findings are joined back to all paths."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, scratch, shared_dir, short_lived_shuffles, staged


@dataclass(frozen=True)
class Rule:
    """Matches of pattern, leftmost first and not overlapping, whose group has at least so many characters. ASCII only, letters in either case where folded.

    hints: lower-case strings of which one at least is in each text with a match, if it is folded to lower case.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    folded: bool = False
    hints: tuple[str, ...] = ()


@dataclass(frozen=True)
class Pack:
    """Rules with a version: whatever changes them changes the version, and what it has scanned is scanned again."""

    name: str
    rules: tuple[Rule, ...]

    @property
    def version(self) -> str:
        return f"{self.name}-{hashlib.sha256(repr(self.rules).encode()).hexdigest()[:16]}"


BASE = Pack(
    "base",
    (
        Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True, ("password", "passwd", "secret", "token", "apikey", "api_key")),
        Rule("access", r"AKIA[A-Z0-9]+", 0, 20, False, ("akia",)),
        Rule("hex", r"[0-9a-f]+", 0, 24),
    ),
)
#: Formats that say of themselves that they are secrets.
FORMATS = Pack(
    "formats",
    (
        Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[^-]+-----END (?:[A-Z]+ )*PRIVATE KEY-----", hints=("private key-----",)),
        Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", hints=("eyj",)),
        Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", hints=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
        Rule("login", r"[A-Za-z][A-Za-z0-9+.-]*://[A-Za-z0-9._~%-]+:[A-Za-z0-9._~%!-]+@", hints=("://",)),
    ),
)
KINDS = [r.kind for p in (BASE, FORMATS) for r in p.rules]

_HEX_RUNS = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_CONTINUATION = bytes(range(0x80, 0xC0))
SPANS = "array<struct<start: bigint, end: bigint, kind: string>>"


def matches(data: bytes, folded: bytes, rule: Rule, pattern: re.Pattern) -> list[tuple[int, int]]:
    """Byte offsets of a rule's matches. Most texts have none, which a search for plain strings tells."""
    if rule.hints and not any(h.encode() in folded for h in rule.hints):
        return []
    if rule.pattern == "[0-9a-f]+" and b"x" * rule.least not in data.translate(_HEX_RUNS):
        return []
    return [m.span() for m in pattern.finditer(data) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def in_code_points(data: bytes, offsets: list[int]) -> dict[int, int]:
    """Byte offsets as code points, in one pass over the text."""
    out, at, points = {}, 0, 0
    for offset in sorted(set(offsets)):
        points += len(data[at:offset].translate(None, _CONTINUATION))
        at, out[offset] = offset, points
    return out


def find(data: bytes, packs: Sequence[Pack]) -> dict[str, list[dict]]:
    """Spans of code points by the version of each pack, end exclusive."""
    folded = data.lower()
    found = {p.version: [(r.kind, *span) for r in p.rules for span in matches(data, folded, r, _compiled(r))] for p in packs}
    at = in_code_points(data, [x for spans in found.values() for span in spans for x in span[1:]])
    return {v: [{"start": at[s], "end": at[e], "kind": kind} for kind, s, e in spans] for v, spans in found.items()}


_patterns: dict[Rule, re.Pattern] = {}


def _compiled(rule: Rule) -> re.Pattern:
    if rule not in _patterns:
        _patterns[rule] = re.compile(rule.pattern.encode(), re.IGNORECASE if rule.folded else 0)
    return _patterns[rule]


def _scanner(packs: Sequence[Pack]):
    by_version = {p.version: p for p in packs}

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        last = None
        for batch in batches:
            blobs, versions, spans = [], [], []
            for blob, text, wanted in zip(batch.column("blob").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                if blob == last:  # rows that agree in path and text
                    continue
                last = blob
                for version, found in find(text, [by_version[v] for v in wanted]).items():
                    blobs.append(blob)
                    versions.append(version)
                    spans.append(found)
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(versions, pa.string()), pa.array(spans, kind)], names=["blob", "version", "spans"])

    return scan


class Ledger:
    """What has been scanned: blob (SHA-256 of a text), version (of a pack) and spans, none for a clean text. A folder of Parquet files that only grows.

    A run adds all of its rows or none. Two runs at once may scan a blob twice; their rows agree, and readers take one.
    """

    SCHEMA = f"blob binary, version string, spans {SPANS}"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.add(spark.createDataFrame([], self.SCHEMA))

    def add(self, rows: DataFrame) -> None:
        with short_lived_shuffles(self.spark):
            rows.write.mode("append").option("compression", "zstd").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)


def addressed(versions: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """keys and blob, the SHA-256 of each text: the history by content. A null text is the empty one."""
    return versions.select(*keys, F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("blob"))


def unseen(paths: DataFrame, keys: Sequence[str], ledger: Ledger, packs: Sequence[Pack]) -> DataFrame:
    """(blob, holder, wanted): blobs that some pack's present version has not scanned, with those versions; holder is a hash of the keys of one of its rows."""
    versions = F.array(*[F.lit(p.version) for p in packs])
    known = ledger.rows().groupBy("blob").agg(F.collect_set("version").alias("known"))
    blobs = paths.groupBy("blob").agg(F.min(F.xxhash64(*keys)).alias("holder"))
    left = blobs.join(known, "blob", "left").select("blob", "holder", F.array_except(versions, F.coalesce("known", F.array().cast("array<string>"))).alias("wanted"))
    return left.where(F.size("wanted") > 0)


def scan_history(versions: DataFrame, ledger: Ledger, packs: Sequence[Pack] = (BASE, FORMATS), keys: Sequence[str] = ("doc_id",), text: str = "text") -> DataFrame:
    """keys and spans (start, rank, end, kind; in code points, in this order) for every row of a history; the ledger gains what it lacked.

    versions: a row for each path and version (keys), with its text. Texts are told apart by SHA-256; only those that the ledger lacks for the present
    version of a pack are scanned, each once, however many rows hold it: its text comes from one of them, picked by a hash of keys, and no copy is
    moved to the same task. rank is the kind's place in the packs. Rows with null keys, repeated rows and null texts (as empty ones) each have their
    row in the result; no rows give none. Other columns, whatever their names, are left out.
    """
    paths = staged(addressed(versions, keys, text))
    todo = unseen(paths, keys, ledger, packs)
    texts = versions.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(*keys).alias("holder")).withColumn("blob", F.unhex(F.sha2("text", 256)))
    scanned = texts.join(todo.hint("merge"), ["blob", "holder"]).select("blob", "text", "wanted")
    ledger.add(scanned.mapInArrow(_scanner(packs), Ledger.SCHEMA))
    kinds = [r.kind for p in packs for r in p.rules]
    ranked = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (F.array_position(F.array(*[F.lit(k) for k in kinds]), s["kind"]) - 1).cast("int").alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    rows = ledger.rows().where(F.col("version").isin([p.version for p in packs]) & (F.size("spans") > 0)).dropDuplicates(["blob", "version"])
    found = staged(rows.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(ranked))).alias("spans")))  # staged, so that the join can split a text with very many copies
    none = F.array().cast("array<struct<start: bigint, rank: int, end: bigint, kind: string>>")
    return paths.join(found, "blob", "left").select(*keys, F.coalesce("spans", none).alias("spans"))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def new_ledger(spark: SparkSession) -> Ledger:
    return Ledger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")


def op12_blob_ledger(spark, sf_dir):
    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["rank"] < len(BASE.rules))
    columns = ["doc_id", *[number(r.kind) for r in BASE.rules], F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("spans")).alias("spans")]
    with scratch() as keep:
        return keep(staged(scan_history(documents(spark, sf_dir), new_ledger(spark)).select(*columns)))
