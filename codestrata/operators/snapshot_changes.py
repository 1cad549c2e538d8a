"""What changed between full snapshots, by Merkle trees over hash ranges of the keys.

Each record gets a 128-bit digest of its JSON value. Keys fall into ``2 ** leaf_bits`` hash ranges; the
digest of a range is the xor of the digests of its records, the digest of an inner node that of its
children. Two consecutive snapshots of a root are compared from the top: below a node whose digests
are equal nothing is looked at, and records are compared only within ranges that differ.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .changed_records import final_runs


def _number(spelled: str) -> Decimal:
    return Decimal(spelled)


def _refuse(word: str):
    raise ValueError(word)


def _plain(value):
    """A JSON value as text: keys in order, numbers by value, strings without needless escapes."""
    kind = type(value)
    if kind is str:
        return json.dumps(value, ensure_ascii=False)
    if kind is Decimal:
        value = value.normalize() if value else Decimal(0)
        return f"{value:E}"
    if kind is dict:
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_plain(value[k])}" for k in sorted(value)) + "}"
    if kind is list:
        return "[" + ",".join(map(_plain, value)) + "]"
    return "null" if value is None else "true" if value else "false"


_decoder = json.JSONDecoder(parse_float=_number, parse_int=_number, parse_constant=_refuse)


def canonical(payload: str | None, without: tuple[str, ...] = ("scannedAt",)) -> str | None:
    """The text that is equal for equal JSON values (members named in ``without`` of the outermost object
    left out). Null stays null; a text that is not JSON stands for itself."""
    if payload is None:
        return None
    try:
        value = _decoder.decode(payload.strip())
        if type(value) is dict:
            for name in without:
                value.pop(name, None)
        return "j" + _plain(value)
    except (ValueError, RecursionError, InvalidOperation):
        return "r" + payload


@F.pandas_udf(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
def payload_digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """128 bits of the canonical payload as two integers; null has a digest of its own."""
    for payloads in batches:
        first, second = [], []
        for p in payloads:
            c = canonical(p if isinstance(p, str) else None)
            d = hashlib.blake2b(b"\0null" if c is None else c.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            first.append(int.from_bytes(d[:8], "big", signed=True))
            second.append(int.from_bytes(d[8:], "big", signed=True))
        yield pd.DataFrame({"a": first, "b": second})


def snapshots_in_order(runs: DataFrame, records: DataFrame, per_leaf: int, most_bits: int) -> DataFrame:
    """The snapshots that count (they have rows and their run succeeded), numbered per root by ``run_no``, with
    the number of the root's last one and the bits of a hash range that give about ``per_leaf`` records a range."""
    there = records.groupBy("run_id").agg(F.count("*").alias("size"))
    ok = final_runs(runs).filter(F.col("status") == "succeeded").join(there, "run_id")
    root = F.coalesce("root_id", F.lit(-(2**63)))
    w = W.partitionBy("root").orderBy("run_no", "run_id")
    whole = W.partitionBy("root")
    bits = F.least(F.lit(most_bits), F.greatest(F.lit(0), F.ceil(F.log2(F.max("size").over(whole) / per_leaf)))).cast("int")
    return ok.withColumn("root", root).select("run_id", "root", F.row_number().over(w).alias("n"), F.count("*").over(whole).alias("last"), bits.alias("bits"))


def snapshot_changes(runs: DataFrame, records: DataFrame, per_leaf: int = 16, most_bits: int = 20) -> DataFrame:
    """``run_id, section, record_key, change_kind`` of each pair of consecutive snapshots of a root.

    Null payload: a value of its own. Null section or key: a name like any other. Null root: one root of its
    own. A record that a snapshot has more than once: the latest delivery holds, equal ones by the greater
    digest. A root's first snapshot gives nothing; empty tables give nothing; further columns are ignored.

    The hashes in ``scan_runs.canonical`` aren't asked: they are missing or stale at times, so that equal ones prove
    nothing.

    Plan: records are shuffled by run to find their snapshot's place, then once by (root, hash range), and written to
    the shared folder with a digest of 16 bytes in place of the payload, so that payloads are read and parsed once.
    Digests of ranges are summed where those rows are read, and written too; inner nodes are built from them. Records
    are read again only to be joined with the ranges that differ. A root with a third of all records is spread over up
    to ``2 ** most_bits`` ranges; a run with a third of them is split by AQE in the join."""
    order = snapshots_in_order(runs, records, per_leaf, most_bits)
    section, key = (F.coalesce(c, F.lit("\0")) for c in ("section", "record_key"))
    placed = (
        records.select("run_id", "section", "record_key", "delivered_at", payload_digest("payload").alias("d"))
        .join(order, "run_id")
        .select("root", "n", "last", "bits", "run_id", section.alias("section"), key.alias("record_key"), "delivered_at", F.col("d.a").alias("a"), F.col("d.b").alias("b"))
        # shifts count modulo 64: a shift by one and then by the rest also does for 0 bits
        .withColumn("leaf", F.expr("shiftrightunsigned(shiftrightunsigned(xxhash64(section, record_key), 1), 63 - bits)"))
        .repartition("root", "leaf")
    )
    name = W.partitionBy("root", "leaf").orderBy("n", "section", "record_key", F.desc_nulls_last("delivered_at"), F.desc("a"), F.desc("b"))
    place = F.struct("n", "section", "record_key")
    once = stored(placed.withColumn("before", F.lag(place).over(name)).filter(F.col("before").isNull() | (F.col("before") != place)).select("root", "n", "last", "bits", "section", "record_key", "a", "b", "leaf"))

    def digest(seed: int, part: str):
        return F.bit_xor(F.xxhash64(F.lit(seed), "section", "record_key", part))

    leaves = stored(once.groupBy("root", "leaf", "n").agg(digest(1, "a").alias("x"), digest(2, "b").alias("y"), F.max("last").alias("last"), F.max("bits").alias("bits")))
    # each node stands in the comparison with the snapshot before (pair n) and with the one after (pair n + 1)
    paired = leaves.withColumn("pair", F.explode(F.array("n", F.col("n") + 1))).filter("pair > 1 AND pair <= last").withColumn("mid", F.expr("shiftright(leaf, bits div 2)"))

    def differing(nodes: DataFrame, *by: str) -> DataFrame:
        return nodes.groupBy("root", *by, "pair").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y")).filter("x <> 0 OR y <> 0").select("root", *by, "pair")

    top = differing(paired)
    middle = differing(paired.join(top, ["root", "pair"], "left_semi"), "mid")
    low = differing(paired.join(middle, ["root", "mid", "pair"], "left_semi"), "leaf")

    low = low.select(F.col("root").alias("r"), F.col("leaf").alias("l"), "pair")
    near = once.join(low, (F.col("root") == F.col("r")) & (F.col("leaf") == F.col("l")) & ((F.col("pair") == F.col("n")) | (F.col("pair") == F.col("n") + 1)))
    now, was = F.col("n") == F.col("pair"), F.col("n") < F.col("pair")
    value = F.struct("a", "b")
    both = near.groupBy("root", "leaf", "pair", "section", "record_key").agg(F.max(F.when(now, value)).alias("new"), F.max(F.when(was, value)).alias("old"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    found = both.withColumn("change_kind", kind).filter("change_kind IS NOT NULL")
    later = order.select(F.col("root").alias("r"), F.col("n").alias("p"), "run_id")
    back = lambda c: F.when(F.col(c) != "\0", F.col(c)).alias(c)
    return found.join(later, (F.col("root") == F.col("r")) & (F.col("pair") == F.col("p"))).select("run_id", back("section"), back("record_key"), "change_kind")
