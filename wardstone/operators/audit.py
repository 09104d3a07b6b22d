"""Tamper-evident audit chains: canonical JSON, hashing, append and verification.

Verification compares with recorded hashes only, so it runs over ranges of each workspace's sequence, in parallel. Appending is sequential within a workspace by nature: each task streams its workspaces' events in order
and holds one hash at a time.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .ranges import numbered

# --- canonical JSON ---------------------------------------------------------------------------------------------------

_ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}
_SPECIAL = re.compile(r'["\\\x00-\x1f]')


def _quoted(text: str) -> str:
    return '"' + _SPECIAL.sub(lambda m: _ESCAPES.get(m[0]) or f"\\u{ord(m[0]):04x}", text) + '"'


def _number(x: float) -> str:
    return re.sub(r"e([+-])0*", lambda m: "e" + ("-" if m[1] == "-" else ""), repr(x))


def canonical(value) -> str:
    """A JSON value without white space, keys sorted by UTF-16 code units, minimal escapes; a float stays a float."""
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    if isinstance(value, str):
        return _quoted(value)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return _number(value)
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    return "{" + ",".join(f"{_quoted(k)}:{canonical(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"


@F.pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """The canonical form of JSON texts; null for null and for what is no JSON."""

    def one(text):
        try:
            return None if text is None else canonical(json.loads(text))
        except ValueError:
            return None

    return texts.map(one)


#: Texts that the built-in functions may write otherwise: numbers with a fraction, an exponent or many digits, escapes and
#: control characters, and characters whose UTF-16 order is not that of UTF-8.
_OWN_WAY = r"[0-9][.eE]|[0-9]{18}|[\\\x00-\x1F]|[^\x00-\x{D7FF}]"


def canonicalised(df: DataFrame, column: str, to: str | None = None) -> DataFrame:
    """``df`` with ``column`` (or ``to``) as ``canonical_json`` has it.

    JSON texts are read and written as variants, whose keys are sorted; only texts that these may write otherwise, or
    can't read, go through Python.
    """
    to = to or column
    variant, text = F.try_parse_json(F.col(column)), F.col(column)
    native = df.withColumn("__ws_json", F.when(text.isNotNull() & ~text.rlike(_OWN_WAY), F.to_json(variant)))
    done, rest = F.col("__ws_json").isNotNull() | text.isNull(), F.col("__ws_json").isNull() & text.isNotNull()
    return native.where(done).withColumn(to, F.col("__ws_json")).drop("__ws_json").unionByName(native.where(rest).withColumn(to, canonical_json(column)).drop("__ws_json"))


# --- the hashed envelope ----------------------------------------------------------------------------------------------


def _json_string(x: Column) -> Column:
    text = F.to_json(F.array(x))
    return F.when(x.isNull(), "null").otherwise(F.substring(text, 2, F.length(text) - 2))


def rfc3339(t: Column) -> Column:
    """A UTC instant with 0, 3 or 6 digits of fraction, as few as it needs."""
    text = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    short = F.regexp_replace(F.regexp_replace(text, r"\.000000$", ""), r"(\.\d{3})000$", "$1")
    return F.concat(short, F.lit("+00:00"))


#: The envelope's fields in canonical order, and how each is written; fixed values.
ENVELOPE = (
    ("action_code", "string"), ("actor_id", "string"), ("actor_type", "string"), ("after_ref", "json"), ("audit_event_id", "string"), ("authority_snapshot", "json"),
    ("before_ref", "json"), ("correlation_id", "string"), ("entity_id", "string"), ("entity_type", "string"), ("entity_version", "number"), ("job_id", "string"),
    ("metadata", "json"), ("occurred_at", "time"), ("request_id", "string"), ("sequence", "number"), ("source_state_hash", "hex"), ("workspace_id", "string"),
)


def envelope(df: DataFrame) -> Column:
    """The canonical JSON of an event; JSON columns must be canonical already, and fields that ``df`` lacks are null."""
    parts = []
    for name, kind in ENVELOPE:
        if name not in df.columns:
            value = F.lit("null")
        elif kind == "time":
            value = _json_string(rfc3339(F.col(name)))
        elif kind == "hex":
            value = _json_string(F.lower(F.hex(F.col(name))))
        elif kind == "string":
            value = _json_string(F.col(name).cast("string"))
        else:
            value = F.coalesce(F.col(name).cast("string"), F.lit("null"))
        parts.append(F.concat(F.lit(f'"{name}":'), value))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def event_hash(previous_hex: Column, body: Column) -> Column:
    """Hex SHA-256 of the previous hash's bytes (none for the first event), a zero byte and the canonical body."""
    return F.sha2(F.concat(F.coalesce(F.unhex(previous_hex), F.lit(b"")), F.lit(b"\0"), body.cast("binary")), 256)


# --- append and verify ------------------------------------------------------------------------------------------------


def chained(events: DataFrame, heads: DataFrame | None = None, order: tuple[str, ...] = ("occurred_at", "event_id")) -> DataFrame:
    """``events`` (workspace_id, audit_event_id, body columns) appended to their chains.

    Adds sequence (after the head's), body, previous_event_hash and event_hash (hex). ``heads``: workspace_id,
    last_sequence, last_event_hash of chains that exist; they come first in their workspace's stream.
    """
    place = F.row_number().over(Window.partitionBy("workspace_id").orderBy(*order))
    rows = events.withColumn("sequence", place.cast("long"))
    if heads is not None:
        known = heads.select(F.col("workspace_id").alias("__w"), F.col("last_sequence").alias("__s"), F.col("last_event_hash").alias("__h"))
        rows = rows.join(known, F.col("workspace_id") == F.col("__w"), "left").withColumn("sequence", F.col("sequence") + F.coalesce("__s", F.lit(0))).drop("__w", "__s")
    else:
        rows = rows.withColumn("__h", F.lit(None).cast("string"))
    rows = rows.withColumn("body", envelope(rows)).repartition("workspace_id").sortWithinPartitions("workspace_id", "sequence")
    names = ("previous_event_hash", "event_hash")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = object(), None
        for batch in batches:
            before, hashes = [], []
            for workspace, body, head in zip(*(batch.column(c).to_pylist() for c in ("workspace_id", "body", "__h"))):
                if workspace != at:
                    at, last = workspace, head
                before.append(last)
                last = hashlib.sha256((bytes.fromhex(last) if last else b"") + b"\0" + body.encode()).hexdigest()
                hashes.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(hashes, pa.string())], names=[*batch.schema.names, *names])

    schema = StructType([*rows.schema.fields, *(StructField(n, StringType()) for n in names)])
    return rows.mapInArrow(fold, schema).drop("__h")


def chain_heads(chain: DataFrame) -> DataFrame:
    """(workspace_id, last_sequence, last_event_hash) of each chain."""
    return chain.groupBy("workspace_id").agg(F.max("sequence").alias("last_sequence"), F.max_by("event_hash", "sequence").alias("last_event_hash"))


def initialised_heads(heads: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Heads with an empty one for each workspace that has none; those that exist stay as they are."""
    new = workspaces.select("workspace_id").distinct().join(heads, "workspace_id", "left_anti")
    return heads.unionByName(new.select("workspace_id", F.lit(0).cast("long").alias("last_sequence"), F.lit(None).cast("string").alias("last_event_hash")))


def head_mismatches(heads: DataFrame, chain: DataFrame) -> DataFrame:
    """Workspaces whose head is not their last event."""
    own = chain_heads(chain).select("workspace_id", F.col("last_sequence").alias("s"), F.col("last_event_hash").alias("h"))
    rows = heads.join(own, "workspace_id", "left")
    return rows.where(~(F.col("last_sequence").eqNullSafe(F.coalesce("s", F.lit(0))) & F.col("last_event_hash").eqNullSafe(F.col("h")))).select("workspace_id")


def event_errors(chain: DataFrame, tie: str = "audit_event_id", partitioned: bool = True, expected_workspace=None) -> DataFrame:
    """Each event with its index in its chain and its first error (kind, expected, actual), or nulls.

    With ``partitioned`` false the rows are one list that must belong to ``expected_workspace``. Chains are verified by
    ranges of their sequence, whose last hash meets the next one's first event, so neither a workspace nor the list is one
    task's.
    """
    rows = numbered(chain, ["workspace_id"] if partitioned else [], ["sequence", tie], "index", {"event_hash": "__prior"})
    due, own = F.col("index") + 1, event_hash(F.col("__prior"), F.col("body"))
    other = ~F.col("workspace_id").eqNullSafe(F.lit(expected_workspace)) if not partitioned else F.lit(False)
    linked = F.col("previous_event_hash").eqNullSafe(F.col("__prior"))
    text = lambda x: F.coalesce(x.cast("string"), F.lit("NULL"))
    cases = [
        ("WorkspaceMismatch", other, text(F.lit(expected_workspace)), text(F.col("workspace_id"))), ("SequenceDisorder", F.col("sequence") < due, text(due - 1), text(F.col("sequence"))),
        ("SequenceGap", F.col("sequence") > due, text(due), text(F.col("sequence"))), ("PreviousHashMismatch", ~linked, text(F.col("__prior")), text(F.col("previous_event_hash"))),
        ("HashTamperDetected", own != F.col("event_hash"), F.col("event_hash"), own),
    ]
    pick = lambda of: F.coalesce(*(F.when(case[1], of(case)) for case in cases))
    return rows.select(
        "workspace_id", "sequence", "index", pick(lambda c: F.lit(c[0])).alias("kind"), pick(lambda c: c[2]).alias("expected"), pick(lambda c: c[3]).alias("actual")
    )


def verified(chain: DataFrame, tie: str = "audit_event_id") -> DataFrame:
    """One row per workspace: how many events, whether the chain is intact, and its first error."""
    rows = event_errors(chain, tie)
    first = F.min(F.when(F.col("kind").isNotNull(), F.struct("index", "sequence", "kind", "expected", "actual")))
    out = rows.groupBy("workspace_id").agg(F.count("*").alias("events"), first.alias("e"))
    return out.select("workspace_id", "events", F.col("e").isNull().alias("intact"), "e.kind", "e.index", "e.sequence", "e.expected", "e.actual")


# --- payloads ---------------------------------------------------------------------------------------------------------


def actor_type(actor: str) -> Column:
    return F.when(F.col(actor).isNotNull(), "principal").otherwise("system")


def payload(**fields: Column) -> Column:
    """Canonical JSON of the fields (columns of JSON texts), keys sorted, nulls kept."""
    pairs = (F.concat(F.lit(f'"{k}":'), F.coalesce(fields[k], F.lit("null"))) for k in sorted(fields))
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))


def _text(c: str | Column) -> Column:
    return _json_string((F.col(c) if isinstance(c, str) else c).cast("string"))


def _instant(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull(), _json_string(rfc3339(c)))


def grant_payload(granted_by: Column) -> Column:
    return payload(
        capability=_text("capability_code"), expires_at=_instant("expires_at"), grant_id=_text("capability_grant_id"), granted_by=_text(granted_by), principal_id=_text("principal_id"),
        workspace_id=_text("workspace_id"),
    )


def revoke_payload(revoked_at: Column) -> Column:
    return payload(
        capability=_text("capability_code"), grant_id=_text("capability_grant_id"), principal_id=_text("principal_id"), revoked_at=_instant(revoked_at), workspace_id=_text("workspace_id")
    )


def workspace_payload() -> Column:
    return payload(**{c: _text(c) for c in ("workspace_id", "program_id", "organization_id", "workspace_code", "name")})


def membership_payload() -> Column:
    return payload(membership_id=_text("membership_id"), workspace_id=_text("workspace_id"), principal_id=_text("principal_id"), role=_text("role_code"))


def role_payload(old: str, new: str) -> Column:
    return payload(membership_id=_text("membership_id"), workspace_id=_text("workspace_id"), principal_id=_text("principal_id"), old_role=_text(old), new_role=_text(new))


def role_before(old: str) -> Column:
    return payload(role=_text(old))


def audited(
    rows: DataFrame, action: str, entity: str, entity_id: str, version: Column, payload: Column, in_metadata: bool = False, before: Column | None = None, actor: str | None = None
) -> DataFrame:
    """Event columns for a change; a service puts the payload in after_ref, a route in metadata.

    ``actor``: the column of who made the change; without one, and for nulls in it, it is the system.
    """
    empty, none = F.lit("{}"), F.lit(None).cast("string")
    return rows.select(
        "workspace_id", (actor_type(actor) if actor else F.lit("system")).alias("actor_type"), (before if before is not None else none).alias("before_ref"), F.lit(action).alias("action_code"), F.lit(entity).alias("entity_type"), F.col(entity_id).cast("string").alias("entity_id"),
        version.cast("int").alias("entity_version"), (F.lit(None).cast("string") if in_metadata else payload).alias("after_ref"), (payload if in_metadata else empty).alias("metadata"),
    )
