"""Append-only ledgers: chaining, signing, verification, filters, activity.

An entry's hash covers its content and the hash of the entry before it, so history can't be rewritten from any
point on without redoing all that follows.  A chain is sequential by nature; to keep any one task bounded, each
writer's entries are cut into segments.  A segment starts from an anchor of its own, and the segments' last hashes
are chained in turn (``heads``, one row per segment): to change an entry, its segment and all later heads must be redone.
Verification needs no order: every row holds the hash before it, and is recomputed alone.
"""

from __future__ import annotations

import hashlib
import hmac as _hmac
import json
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casework.functions.text import hmac_sha256
from casework.shared import cut, ranked

GENESIS = "0" * 64


def _sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def anchor(writer: Column, segment: Column) -> Column:
    """What the first entry of a segment follows: for the first segment the genesis, else a hash of writer and number."""
    return F.when(segment == 0, F.lit(GENESIS)).otherwise(F.sha2(F.concat_ws(":", writer.cast("string"), segment.cast("string")), 256))


def chain(events: DataFrame, writer: str, order: list[str], content: Column, *, segment: int = 4096) -> DataFrame:
    """Events with content, segment, sequence (from 1 per writer), previous_hash and entry_hash.

    ``order`` must be total within a writer.  A null writer's entries form a chain of their own.  No group larger
    than ``segment`` rows is gathered; a writer may hold any share of the rows.
    """
    e = ranked(events.withColumn("content", content), [writer, *order], rank="_rank")
    first = e.groupBy(writer).agg(F.min("_rank").alias("_first"))
    e = e.join(first.withColumnRenamed(writer, "_w"), F.col(writer).eqNullSafe(F.col("_w"))).withColumn("sequence", F.col("_rank") - F.col("_first") + 1)
    e = e.withColumn("segment", F.floor((F.col("sequence") - 1) / segment).cast("int")).drop("_rank", "_first", "_w")
    e = cut(e.withColumn("previous_hash", anchor(F.coalesce(F.col(writer).cast("string"), F.lit("")), F.col("segment"))).withColumn("entry_hash", F.lit("")))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sequence")
        before, made = [], []
        last = pdf["previous_hash"].iloc[0]
        for c in pdf["content"]:
            before.append(last)
            last = _sha(f"{last}|{c}")
            made.append(last)
        return pdf.assign(previous_hash=before, entry_hash=made)

    return e.groupBy(writer, "segment").applyInPandas(link, e.schema)


def heads(ledger: DataFrame, writer: str) -> DataFrame:
    """writer, segment, entries, tip, head: the chain over the last hashes of a writer's segments; a row per segment."""
    tips = ledger.groupBy(writer, "segment").agg(F.count(F.lit(1)).alias("entries"), F.max(F.struct("sequence", "entry_hash")).alias("m"))
    tips = tips.select(writer, "segment", "entries", F.col("m.entry_hash").alias("tip"), F.lit("").alias("head"))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("segment")
        last, made = GENESIS, []
        for t in pdf["tip"]:
            last = _sha(f"{last}|{t}")
            made.append(last)
        return pdf.assign(head=made)

    return tips.groupBy(writer).applyInPandas(link, tips.schema)


def sign(ledger: DataFrame, key: bytes) -> DataFrame:
    """The ledger with an HMAC-SHA256 of ``sequence:entry_hash`` for every entry."""
    return ledger.withColumn("signature", hmac_sha256(key, F.concat_ws(":", F.col("sequence").cast("string"), "entry_hash")))


def verify(ledger: DataFrame, writer: str, key: bytes | None = None, stored_heads: DataFrame | None = None) -> DataFrame:
    """writer, sequence, error of every entry that fails; the first rule that fails counts.

    Rules in order: sequence_null, hash_null, signature_null, hash_invalid (the content isn't what was hashed), chain_broken
    (it doesn't follow the entry before it), signature_invalid, sequence_mismatch (a number twice, or one left out).
    With ``stored_heads`` also tip_mismatch, at the last entry of a segment whose head is another.
    """
    w = Window.partitionBy(writer, "segment").orderBy("sequence", "entry_hash")  # at most a segment
    e = ledger.withColumn("_last", F.lag("entry_hash").over(w)).withColumn("_n", F.lag("sequence").over(w)).withColumn("_place", F.row_number().over(w))
    want = F.when(F.col("_place") == 1, anchor(F.coalesce(F.col(writer).cast("string"), F.lit("")), F.col("segment"))).otherwise(F.col("_last"))
    signed = hmac_sha256(key, F.concat_ws(":", F.col("sequence").cast("string"), "entry_hash")) if key is not None else None
    rules = [("sequence_null", F.col("sequence").isNull()), ("hash_null", F.col("entry_hash").isNull())]
    if signed is not None:
        rules.append(("signature_null", F.col("signature").isNull()))
    rules.append(("hash_invalid", F.sha2(F.concat_ws("|", F.coalesce("previous_hash", F.lit("")), F.coalesce("content", F.lit(""))), 256) != F.col("entry_hash")))
    rules.append(("chain_broken", ~F.col("previous_hash").eqNullSafe(want)))
    if signed is not None:
        rules.append(("signature_invalid", F.col("signature") != signed))
    rules.append(("sequence_mismatch", (F.col("_place") > 1) & (F.col("sequence") != F.col("_n") + 1)))
    error = F.lit(None).cast("string")
    for name, bad in reversed(rules):
        error = F.when(bad, F.lit(name)).otherwise(error)
    out = e.select(writer, "sequence", error.alias("error")).where("error is not null")
    if stored_heads is None:
        return out
    now = heads(ledger, writer).select(F.col(writer).alias("_w"), "segment", F.col("head").alias("_head"))
    both = stored_heads.join(now, F.col(writer).eqNullSafe(F.col("_w")) & (stored_heads["segment"] == now["segment"]), "left")
    torn = both.where(~F.col("head").eqNullSafe(F.col("_head"))).select(writer, F.lit(None).cast("long").alias("sequence"), F.lit("tip_mismatch").alias("error"))
    return out.select(writer, F.col("sequence").cast("long").alias("sequence"), "error").unionByName(torn)


def by_operation(ledger: DataFrame, operation: str) -> DataFrame:
    return ledger.where(F.col("operation") == operation)


def by_input(ledger: DataFrame, item: str) -> DataFrame:
    return ledger.where(F.array_contains("inputs", item))


def by_output(ledger: DataFrame, item: str) -> DataFrame:
    return ledger.where(F.array_contains("outputs", item))


def tail(ledger: DataFrame, n: int) -> DataFrame:
    """The last ``n`` entries, in order."""
    return ledger.orderBy(F.desc("sequence")).limit(n).orderBy("sequence")


def read(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines ledger with the number of its line; blank lines are skipped, a malformed line fails with its number."""
    schema = "timestamp string, operation string, inputs array<string>, outputs array<string>, args string, previous_hash string, sequence long, entry_hash string, signature string"
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("at", "value")).where("trim(value) <> ''")
    parsed = lines.select((F.col("at") + 1).alias("line"), F.from_json("value", schema).alias("e"), F.try_parse_json("value").alias("ok"))
    good = F.when(F.col("ok").isNull() | F.col("e").isNull(), F.raise_error(F.format_string("line %d of the ledger is not JSON", F.col("line")))).otherwise(F.col("line"))
    return parsed.select(good.alias("line"), "e.*")


class Writer:
    """The single writer of a JSON-lines ledger: every entry is chained, signed, flushed to disk."""

    def __init__(self, path: str, key: bytes):
        self.path, self.key = Path(path), key
        self.sequence, self.previous = 0, GENESIS
        if self.path.exists():
            for line in self.path.read_text().splitlines():
                e = json.loads(line)
                self.sequence, self.previous = e["sequence"], e["entry_hash"]

    def log(self, operation: str, *, inputs=(), outputs=(), args=None, timestamp: str = "") -> dict:
        import os

        e = {"timestamp": timestamp, "operation": operation, "inputs": list(inputs), "outputs": list(outputs), "args": args or {}, "previous_hash": self.previous, "sequence": self.sequence + 1}
        e["entry_hash"] = _sha(json.dumps(e, sort_keys=True))
        e["signature"] = _hmac.new(self.key, f"{e['sequence']}:{e['entry_hash']}".encode(), hashlib.sha256).hexdigest()
        with self.path.open("a") as f:
            f.write(json.dumps(e, sort_keys=True) + "\n")
            f.flush()
            os.fsync(f.fileno())
        self.sequence, self.previous = e["sequence"], e["entry_hash"]
        self.seal()
        return e

    def seal(self) -> None:
        """The number and hash of the last entry, signed, beside the ledger: a ledger that was cut short shows."""
        body = {"sequence": self.sequence, "tip": self.previous}
        body["signature"] = _hmac.new(self.key, f"{self.sequence}:{self.previous}".encode(), hashlib.sha256).hexdigest()
        tmp = Path(f"{self.path}.seal.tmp")
        tmp.write_text(json.dumps(body, sort_keys=True))
        tmp.replace(f"{self.path}.seal")


def verify_file(path: str, key: bytes) -> tuple[bool, str | None]:
    """Whether a written ledger is whole, and the first error."""
    previous, n = GENESIS, 0
    for i, line in enumerate(Path(path).read_text().splitlines(), 1):
        try:
            e = json.loads(line)
        except ValueError:
            return False, f"line {i}: not JSON"
        body = {k: v for k, v in e.items() if k not in ("entry_hash", "signature")}
        if e.get("sequence") is None:
            return False, f"line {i}: sequence missing"
        if e.get("entry_hash") is None:
            return False, f"line {i}: hash missing"
        if e.get("signature") is None:
            return False, f"line {i}: signature missing"
        if _sha(json.dumps(body, sort_keys=True)) != e["entry_hash"]:
            return False, f"line {i}: hash invalid"
        if e["previous_hash"] != previous:
            return False, f"line {i}: chain broken"
        want = _hmac.new(key, f"{e['sequence']}:{e['entry_hash']}".encode(), hashlib.sha256).hexdigest()
        if not _hmac.compare_digest(want, e["signature"]):
            return False, f"line {i}: signature invalid"
        if e["sequence"] != i:
            return False, f"line {i}: sequence mismatch"
        previous, n = e["entry_hash"], i
    seal = Path(f"{path}.seal")
    if seal.exists():
        s = json.loads(seal.read_text())
        if (s.get("sequence"), s.get("tip")) != (n, previous):
            return False, "the seal names another tip"
    return True, None
