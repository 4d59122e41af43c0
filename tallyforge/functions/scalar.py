"""Column builders: ordering keys, ids, digests, statuses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Genesis in milliseconds, milliseconds a slot, and how far ahead of now a block time may lie.
GENESIS_MS, SLOT_MS, AHEAD_MS = 1_584_316_800_000, 400, 300_000


def canonical(slot="slot", tx="tx_index", ordinal="event_ordinal", signature="tx_signature", *ids: str) -> list[Column]:
    """The canonical order: nulls last, text by code points."""
    return [F.col(c).asc_nulls_last() for c in (slot, tx, ordinal, signature, *ids)]


def guard(slot="slot", tx="tx_index", ordinal="event_ordinal", signature="tx_signature") -> Column:
    """A comparable struct (slot, tx_index, event_ordinal, tx_signature) in which nulls come lowest."""
    names = {"slot": slot, "tx_index": tx, "event_ordinal": ordinal}
    return F.struct(*[F.coalesce(F.col(c).cast("long"), F.lit(-1).cast("long")).alias(n) for n, c in names.items()], F.coalesce(F.col(signature), F.lit("")).alias("tx_signature"))


def sort_key(tier: Column, quality: Column, confidence: Column, tie: Column) -> Column:
    return tier.cast("long") * 1_000_200_010_000_000 + quality.cast("long") * 100_010_000_000 + confidence.cast("long") * 10_000_000 + tie.cast("long")


def normalize_value(raw: Column, decimals: Column) -> Column:
    """Exact decimal text of an integer text and its decimals, without trailing zeros; works at any number of digits."""
    negative, digits = F.startswith(raw, F.lit("-")), F.ltrim(F.regexp_replace(raw, "^-", ""), F.lit("0"))
    padded = F.lpad(digits, F.greatest(F.length(digits), decimals + 1), "0")
    whole = F.substr(padded, F.lit(1), F.length(padded) - decimals)
    part = F.rtrim(F.substr(padded, F.length(padded) - decimals + 1, decimals), F.lit("0"))
    text = F.when(F.length(part) > 0, F.concat(whole, F.lit("."), part)).otherwise(whole)
    return F.when(negative & (text != "0"), F.concat(F.lit("-"), text)).otherwise(text)


def uri_type(uri: Column) -> Column:
    return F.when(uri.rlike("^(ipfs://|Qm|bafy)"), "IPFS").when(uri.startswith("ar://"), "ARWEAVE").otherwise("HTTP")


def to_unix(ts: Column) -> Column:
    return F.unix_seconds(ts)


def key_hash(key: Column) -> Column:
    return F.substring(F.sha2(key, 256), 1, 32)


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def hashes_equal(a: Column, b: Column) -> Column:
    """Equality in which null and 32 zero bytes are the same."""
    zero = F.unhex(F.lit("00" * 32))
    return F.nullif(a, zero).eqNullSafe(F.nullif(b, zero))


def compose_id(*parts: Column) -> Column:
    return F.concat_ws(":", *[p.cast("string") for p in parts])


def format_id(n: Column) -> Column:
    """'#' and the number with zeros in front: 3, 4, 5 or 6 digits by its size."""
    width = F.when(n < 1000, 3).when(n < 10_000, 4).when(n < 100_000, 5).otherwise(F.greatest(F.lit(6), F.length(n.cast("string"))))
    return F.concat(F.lit("#"), F.lpad(n.cast("string"), width, "0"))


def block_time(seconds: Column, slot: Column, now_ms: Column) -> Column:
    """Chain time if positive, at most a little ahead of now, else from the slot."""
    ms = F.when(seconds > 0, F.least(seconds * 1000, now_ms + AHEAD_MS)).otherwise(F.lit(GENESIS_MS) + slot * SLOT_MS)
    return F.timestamp_millis(ms.cast("long"))


def decompose_id(text: Column, *names: str) -> Column:
    """The parts of `a:b:c`, without the prefix `sol:` of old ids, as a struct of texts; null if their number differs."""
    parts = F.split(F.regexp_replace(text, "^sol:", ""), ":")
    return F.when(F.size(parts) == len(names), F.struct(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)]))


def strip_nul(text: Column) -> Column:
    """The text without zero characters."""
    return F.replace(text, F.lit("\0"), F.lit(""))


def digest_text(text: Column) -> Column:
    """A digest's hex digits in lower case, without `\\x` or `0x` in front; blank is null."""
    return F.nullif(F.lower(F.regexp_replace(F.trim(text), r"^(\\x|0x)", "")), F.lit(""))


def response_status(status: Column) -> Column:
    """What a response's status is called: an orphaned one is ORPHANED, a verified one FINALIZED, others PENDING."""
    return F.when(status.isin("ORPHANED", "FINALIZED"), status).otherwise("PENDING")


def cluster_id(network: Column) -> Column:
    """101 is the main network, 103 the development one."""
    return F.when(network == "mainnet", 101).otherwise(103)


def pointer_variants(pointer: Column) -> Column:
    """`c1:<cid>` and the bare cid stand for each other if the cid is base32."""
    bare = F.regexp_replace(pointer, "^c1:", "")
    return F.when(bare.rlike("^b[a-z2-7]{20,}$"), F.array(bare, F.concat(F.lit("c1:"), bare))).otherwise(F.array(pointer))


def request_status(response: Column) -> Column:
    return F.when(response.isNull(), "PENDING").otherwise("COMPLETED")


def timestamp_literal(text: Column) -> Column:
    """Whole numbers from 10**12 on are milliseconds, others seconds; else ISO text."""
    n = text.try_cast("long")
    return F.when(n >= 10**12, F.timestamp_millis(n)).when(n.isNotNull(), F.timestamp_seconds(n)).otherwise(text.try_cast("timestamp"))


def where(**conditions) -> Column:
    """field, field_in, field_gt, field_gte, field_lt, field_lte=value: their conjunction; None is left out, lists are cut at 250."""
    found = F.lit(True)
    tests = {"in": lambda c, v: c.isin(list(v)[:250]), "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v}
    for name, value in conditions.items():
        field, _, test = name.rpartition("_")
        if value is None:
            continue
        found = found & (tests[test](F.col(field), value) if field and test in tests else F.col(name) == value)
    return found


def active(status: str = "status") -> Column:
    return F.col(status) != "ORPHANED"


def violations(rules: dict[str, Column]) -> Sequence[Column]:
    """One count for each rule of the rows that break it."""
    return [F.count_if(~rule).alias(name) for name, rule in rules.items()]
