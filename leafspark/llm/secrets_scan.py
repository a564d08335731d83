"""Secret scans with corpus-wide ownership: copied examples apart from credentials of one owner.

A scan of every whole text finds candidates. Their values' hashes are then counted over the corpus by distinct
repositories and by distinct owners. A value that several owners carry is a published example, and so is one that a great
many repositories carry, whoever owns them; a value of one owner or two, in fewer repositories, that looks random is a
live credential. A repository is a different text, so that copies of a document which leaks a credential, under whatever
ids, don't make it an example. Candidates of the base kinds are always reported; those of the wider kind
``key`` (well-known token prefixes, signed web tokens) become spans only if the counts say live.

Distinct (value, owner) and (value, repository) pairs are reduced before they are counted, so a value that a third of
all rows hold is one row per task; its verdict comes back by a join that AQE can split. Texts aren't shuffled.

Defined results: a null or empty text has no spans; every row is scanned on its own, whatever its doc_id; rows of equal
text are one repository; rows without an owner are one owner, other than the empty one; an empty table gives no rows;
extra columns are ignored by scan_secrets() and kept by redact_secrets(), whatever their names. A text is held whole.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize

KINDS = ("assign", "access", "hex", "key")
#: A value that this many owners, or this many repositories, hold is an example.
EXAMPLE_OWNERS = 3
EXAMPLE_REPOSITORIES = 100

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
KEY = r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"
_KEY = re.compile(KEY)
_KEY_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "sk_live_", "AIza", "eyJ")
DULL = r"example|sample|changeme|password|placeholder|your|dummy|test|xxxx|1234567|abcdef"
_DULL = re.compile(DULL, re.I | re.A)

_SPANS = "array<struct<kind int, start int, end int, value_start int, value_end int, value long, shaped boolean>>"
_ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value_start", pa.int32()), ("value_end", pa.int32()), ("value", pa.int64()), ("shaped", pa.bool_())]))


def looks_random(value: str) -> bool:
    """Eight characters or more with 2.5 bits each at least, and no word that marks a placeholder."""
    if len(value) < 8 or _DULL.search(value):
        return False
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values()) >= 2.5


def candidates(text: str) -> list[tuple]:
    """(kind, start, end, value_start, value_end, value, shaped) by start, then kind; kinds count as in KINDS."""
    found = []
    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(0, *m.span(), *m.span(2), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(1, *m.span(), *m.span(), m[0]) for m in _ACCESS.finditer(text)]
    found += [(2, *m.span(), *m.span(), m[0]) for m in _HEX.finditer(text)]
    if any(w in text for w in _KEY_WORDS):
        found += [(3, *m.span(), *m.span(), m[0]) for m in _KEY.finditer(text)]
    return sorted(((*x[:5], int.from_bytes(hashlib.blake2b(x[5].encode(), digest_size=8).digest(), "big", signed=True), looks_random(x[5])) for x in found), key=lambda x: (x[1], x[0]))


def joined(spans: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, *_ in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.name for f in _ARROW.value_type]
    for batch in batches:
        spans = [candidates(t.as_py() or "") for t in batch.column("text")]
        base = [hashlib.sha256(joined([x for x in s if x[0] < 3]).encode()).hexdigest() for s in spans]
        flat = [x for s in spans for x in s]
        ends = [0]
        for s in spans:
            ends.append(ends[-1] + len(s))
        items = pa.StructArray.from_arrays([pa.array([x[i] for x in flat], _ARROW.value_type[i].type) for i in range(len(names))], names)
        out = {"doc_id": batch.column("doc_id"), "owner": batch.column("owner"), "text_key": batch.column("text_key")}
        yield pa.RecordBatch.from_pydict(out | {"base_sha256": pa.array(base), "found": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)})


def scan_secrets(docs: DataFrame, owner: str = "source", example_owners: int = EXAMPLE_OWNERS, example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """For each row: doc_id, text_key (xxhash64 of the text), n_assign, n_access, n_hex, base_sha256, n_live, n_example,
    spans (as text) and live (an array of the spans that look like credentials of one owner)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.col(owner).cast("string").alias("owner"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    scanned = materialize(rows.mapInArrow(_scan, f"doc_id long, owner string, text_key long, base_sha256 string, found {_SPANS}"))

    each = scanned.where("size(found) > 0").withColumn("row", F.monotonically_increasing_id())
    each = materialize(each.select("row", "doc_id", "owner", "text_key", "base_sha256", F.explode("found").alias("span")))
    value = F.col("span.value").alias("value")
    owners = each.select(value, F.col("owner").isNull().alias("nobody"), "owner").distinct().groupBy("value").agg(F.count("*").alias("owners"))
    repositories = each.select(value, "text_key").distinct().groupBy("value").agg(F.count("*").alias("repositories"))
    counted = materialize(owners.join(repositories, "value"))
    judged = each.withColumn("value", F.col("span.value")).join(counted, "value")
    judged = judged.withColumn("example", (F.col("owners") >= example_owners) | (F.col("repositories") >= example_repositories)).withColumn("is_live", ~F.col("example") & F.col("span.shaped"))

    def count(kind: int):
        return F.count_if(F.col("span.kind") == kind).alias(f"n_{KINDS[kind]}")

    live = F.struct("span.value_start", "span.value_end", "span.kind", "repositories", "owners")
    shown = F.struct(F.col("span.start"), F.col("span.kind"), F.col("span.end"))
    found = judged.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("text_key").alias("text_key"),
        *map(count, range(3)),
        F.first("base_sha256").alias("base_sha256"),
        F.count_if("is_live").alias("n_live"),
        F.count_if("example").alias("n_example"),
        F.sort_array(F.collect_list(F.when((F.col("span.kind") < 3) | F.col("is_live"), shown))).alias("shown"),
        F.sort_array(F.collect_list(F.when(F.col("is_live"), live))).alias("live"),
    )
    kind = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform("shown", lambda s: F.concat_ws(":", F.element_at(kind, s.kind + 1), s.start, s.end)), ",")
    found = found.withColumn("spans", text).drop("row", "shown")
    none = scanned.where("size(found) = 0").select("doc_id", "text_key", *(F.lit(0).cast("long").alias(f"n_{k}") for k in KINDS[:3]), "base_sha256", F.lit(0).cast("long").alias("n_live"), F.lit(0).cast("long").alias("n_example"), F.lit("").alias("spans"))
    return found.unionByName(none, allowMissingColumns=True)


def _redact(mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, live in zip(batch.column("text").to_pylist(), batch.column("live").to_pylist(), strict=True):
                at, parts = 0, []
                for s in sorted(live or [], key=lambda s: (s["value_start"], -s["value_end"])):
                    if s["value_start"] >= at:
                        parts += [text[at : s["value_start"]], mark]
                    at = max(at, s["value_end"])
                out.append("".join([*parts, text[at:]]) if live else text)
            yield batch.set_column(batch.schema.names.index("text"), "text", pa.array(out, pa.string()))

    return run


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with each live credential replaced by ``mark``; examples stay; n_chars, if there, follows the new text."""
    live = scan_secrets(docs, **options).where("n_live > 0").groupBy("doc_id", "text_key").agg(F.first("live").alias("live"))
    live = materialize(live).withColumnsRenamed({"doc_id": "id", "text_key": "key"})
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own"), F.xxhash64(text).alias("mark"))
    both = rows.join(live, F.col("own").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("key")), "left").select("row", "live")
    plain = both.where("live is null").select("row.*")
    changed = both.where("live is not null").select("row", F.col("row.text").cast("string").alias("text"), "live")
    changed = changed.mapInArrow(_redact(mark), changed.schema)
    new = {"text": F.col("text").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return plain.unionByName(changed.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns)))
