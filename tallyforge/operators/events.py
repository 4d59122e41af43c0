"""Raw transactions and events made into ordered, typed rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import guard

#: Columns that place an event.
CONTEXT = ["tx_signature", "slot", "block_time", "tx_index", "event_ordinal"]
#: Fields of each kind of event; the kinds of values are text, flag, int, whole (64 bits without sign), big (text of any digits) and hash; `?` may be absent.
FIELDS = {
    "AgentRegistered": "asset text, collection text, owner text, atom_enabled flag=true, agent_uri text?",
    "AgentOwnerSynced": "asset text, old_owner text, new_owner text",
    "AtomEnabled": "asset text, enabled_by text",
    "UriUpdated": "asset text, new_uri text, updated_by text",
    "WalletUpdated": "asset text, old_wallet text?, new_wallet text, updated_by text",
    "WalletResetOnOwnerSync": "asset text, old_wallet text?, new_wallet text, owner_after_sync text",
    "MetadataSet": "asset text, key text, value text, immutable flag",
    "MetadataDeleted": "asset text, key text",
    "RegistryInitialized": "collection text, authority text",
    "CollectionPointerSet": "asset text, set_by text, col text, lock flag?",
    "ParentAssetSet": "asset text, parent_asset text, parent_creator text, set_by text, lock flag?",
    "NewFeedback": "asset text, client_address text, feedback_index whole, value big, value_decimals int, score int?, seal_hash hash, atom_enabled flag, new_trust_tier int, new_quality_score int, new_confidence int, new_risk_score int, new_diversity_ratio int, new_feedback_digest hash, new_feedback_count whole, tag1 text?, tag2 text?, endpoint text?, feedback_uri text?, feedback_file_hash hash?",
    "FeedbackRevoked": "asset text, client_address text, feedback_index whole, seal_hash hash, original_score int?, atom_enabled flag, had_impact flag, new_trust_tier int, new_quality_score int, new_confidence int, new_revoke_digest hash, new_revoke_count whole",
    "ResponseAppended": "asset text, client text, feedback_index whole, responder text, response_hash hash, seal_hash hash, new_response_digest hash, new_response_count whole, response_uri text?",
    "ValidationRequested": "asset text, validator_address text, nonce whole, request_uri text?, request_hash hash, requester text",
    "ValidationResponded": "asset text, validator_address text, nonce whole, response int, response_uri text?, response_hash hash, tag text?",
}


def _camel(name: str) -> str:
    first, *rest = name.split("_")
    return first + "".join(w.capitalize() for w in rest)


def _read(text: Column, kind: str) -> Column:
    if kind == "flag":
        return text.try_cast("boolean")
    if kind == "int":
        return F.when(text.rlike("^[0-9]{1,9}$"), text.try_cast("int"))
    if kind == "whole":  # up to 2**64 - 1
        return F.when(text.rlike("^[0-9]{1,20}$"), text.try_cast("decimal(20,0)"))
    if kind == "big":
        return F.when(text.rlike("^-?[0-9]{1,39}$"), text)
    if kind == "hash":
        return F.when(text.rlike("^(0x)?[0-9a-fA-F]{64}$"), F.unhex(F.regexp_replace(text, "^0x", "")))
    return text


def _fields(text: str) -> list[tuple[str, str, bool, str]]:
    """name, kind of value, whether it may be absent, default of each field."""
    out = []
    for entry in text.split(", "):
        name, value = entry.split(" ")
        value, _, default = value.partition("=")
        out.append((name, value.rstrip("?"), value.endswith("?"), default))
    return out


def wide(raw: DataFrame) -> DataFrame:
    """A row for each event of a known kind: name, its place, at (block time), o (the place as a comparable struct), ok, and the fields of all kinds.

    Fields of other kinds are null. A field that kinds read differently bears
    the first one's name, and for others `name_kind`. data is parsed once, for
    all kinds; `ok` as in typed().
    """
    place = ["slot", "tx_index", "event_ordinal", "tx_signature"]
    kinds: dict[str, str] = {}  # column: kind of value
    needs: dict[str, list[Column]] = {}
    texts: dict[str, Column] = {}
    defaults: dict[str, list[Column]] = {}
    for kind, spec in FIELDS.items():
        needs[kind] = [F.col("_d").isNotNull()]
        for name, value, optional, default in _fields(spec):
            column = name if kinds.setdefault(name, value) == value else f"{name}_{value}"
            kinds[column] = value
            texts[column] = F.col(f"_d.{_camel(name)}")
            if default:
                defaults.setdefault(column, []).append(F.when(F.col("name") == kind, F.lit(default)))
            good = F.col(column).isNotNull()
            needs[kind].append(good | F.col(f"_d.{_camel(name)}").isNull() if optional else good)
    schema = ", ".join(f"`{n}` string" for n in sorted({_camel(n) for spec in FIELDS.values() for n, *_ in _fields(spec)}))
    at = F.col("block_time") if "block_time" in raw.columns else F.lit(None).cast("timestamp")
    rows = raw.where(F.col("name").isin(*FIELDS)).select("name", F.col("slot").cast("long").alias("slot"), F.col("tx_index").cast("int").alias("tx_index"), F.col("event_ordinal").cast("int").alias("event_ordinal"), "tx_signature", at.cast("timestamp").alias("at"), F.from_json("data", schema).alias("_d"))
    rows = rows.select("name", *place, "at", guard().alias("o"), "_d", *[_read(F.coalesce(texts[c], *defaults.get(c, [])), k).alias(c) for c, k in kinds.items()])
    ok = F.lit(False)
    for kind, good in needs.items():
        ok = F.when(F.col("name") == kind, reduce(Column.__and__, good)).otherwise(ok)
    return rows.withColumn("ok", F.coalesce(ok, F.lit(False))).drop("_d")


def typed(raw: DataFrame, kind: str, fields: str | None = None) -> DataFrame:
    """The rows of raw (name, data as JSON text, any other columns) of that kind, with the fields of the kind in place of name and data.

    Keys are read in camel case. `ok` is false where a needed field is missing
    or cannot be read (also if data is null or no JSON): those are dead
    letters, which fold nothing but are not lost. Columns of raw that bear a
    field's name are replaced by the field.
    """
    specs = _fields(fields or FIELDS[kind])
    schema = ", ".join(f"`{_camel(n)}` string" for n, *_ in specs)
    # exploded, as a condition on fields is pushed below a plain column, and would parse (and make data) once a field
    rows = raw.where(F.col("name") == kind).select("*", F.explode(F.array(F.from_json("data", schema))).alias("_d"))
    ok, columns = F.col("_d").isNotNull(), {}
    for name, value, optional, default in specs:
        text = F.col(f"_d.{_camel(name)}")
        if default:
            text = F.coalesce(text, F.lit(default))
        columns[name] = _read(text, value)
        good = columns[name].isNotNull()
        ok = ok & (good | text.isNull() if optional else good)
    kept = [c for c in raw.columns if c not in {"name", "data", "ok", *columns}]
    return rows.select(*kept, *[c.alias(n) for n, c in columns.items()], F.coalesce(ok, F.lit(False)).alias("ok"))


def with_ordinal(transactions: DataFrame, events: str = "events") -> DataFrame:
    """A row for each event of a transaction's array, with its place from 0; without events, or with null, none."""
    rest = [c for c in transactions.columns if c not in (events, "event_ordinal")]
    return transactions.select(*rest, F.posexplode(events).alias("event_ordinal", "event"))


def with_tx_index(events: DataFrame, blocks: DataFrame) -> DataFrame:
    """events with the place of their transaction in blocks (slot, signatures as an array), 0 included; unknown blocks leave null.

    `unresolved` marks events whose place is null though their slot has more than one transaction: their order is unknown.
    """
    places = blocks.select("slot", F.posexplode("signatures").alias("tx_index", "tx_signature"))
    several = events.groupBy("slot").agg((F.min("tx_signature") != F.max("tx_signature")).alias("_several"))
    got = events.drop("tx_index", "unresolved").join(places, ["slot", "tx_signature"], "left").join(several, "slot", "left")
    return got.withColumn("unresolved", F.col("tx_index").isNull() & F.coalesce("_several", F.lit(False))).drop("_several")


def with_lock_hints(events: DataFrame, hints: DataFrame) -> DataFrame:
    """The n-th event of a kind in a transaction takes the n-th hint (tx_signature, kind, position, lock) of that kind where it has no lock of its own."""
    nth = lambda by: F.row_number().over(Window.partitionBy("tx_signature", "kind").orderBy(by))
    given = hints.select("tx_signature", "kind", nth("position").alias("_n"), F.col("lock").alias("_hint"))
    got = events.withColumn("_n", nth("event_ordinal")).join(given, ["tx_signature", "kind", "_n"], "left")
    return got.withColumn("lock", F.coalesce("lock", "_hint")).drop("_n", "_hint")


def attribute_frames(transactions: DataFrame, logs: str = "logs") -> DataFrame:
    """A row for each log line of a transaction: position, line, and the program that was innermost when it was written (null outside all).

    Lines that open or close a program belong to that program. One that closes
    a program which isn't innermost closes all that opened after it too; one
    that closes a program which isn't open changes nothing. One pass over the
    array of a transaction, within built-in functions.
    """
    opened = lambda x: F.nullif(F.regexp_extract(x, r"^Program (\S+) invoke \[\d+\]$", 1), F.lit(""))
    closed = lambda x: F.nullif(F.regexp_extract(x, r"^Program (\S+) (?:success|failed.*)$", 1), F.lit(""))
    none = F.array().cast("array<string>")

    def step(acc: Column, line: Column) -> Column:
        stack, enter, leave = acc["stack"], opened(line), closed(line)
        # the last place of the program that ends
        back = F.array_position(F.reverse(stack), leave)
        left = F.when(back > 0, F.slice(stack, F.lit(1), (F.size(stack) - back).cast("int"))).otherwise(stack)
        after = F.when(enter.isNotNull(), F.array_append(stack, enter)).when(leave.isNotNull(), left).otherwise(stack)
        program = F.coalesce(enter, leave, F.try_element_at(stack, F.lit(-1)))
        return F.struct(after.alias("stack"), F.array_append(acc["out"], program).alias("out"))

    start = F.struct(none.alias("stack"), none.alias("out"))
    programs = F.aggregate(logs, start, step, lambda acc: acc["out"])
    rest = [c for c in transactions.columns if c not in (logs, "position", "line", "program")]
    return transactions.select(*rest, F.posexplode(F.arrays_zip(F.col(logs).alias("line"), programs.alias("program"))).alias("position", "_z")).select(*rest, "position", "_z.line", "_z.program")


def unparsed(frames: DataFrame, events: DataFrame, program: str) -> DataFrame:
    """Transactions in which the program wrote data though no event was read from them; must be empty."""
    wrote = frames.where((F.col("program") == program) & F.startswith(F.col("line"), F.lit("Program data: "))).select("tx_signature").distinct()
    return wrote.join(events, "tx_signature", "left_anti")


def succeeded(transactions: DataFrame, error: str = "err") -> DataFrame:
    return transactions.where(F.col(error).isNull())
