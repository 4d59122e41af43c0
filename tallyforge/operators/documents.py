"""Fetched documents and stored metadata values: sanitised fields, metadata rows, compressed values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a text field that are kept, bytes of a compressed value and of what it may expand to, bytes from which values are compressed.
TEXT, PACKED, EXPANDED, PLAIN = 1000, 10_240, 1_048_576, 256


#: Elements whose content goes with them.
HIDDEN = "annotation-xml audio colgroup desc foreignobject head iframe math mi mn mo ms mtext noembed noframes noscript plaintext script style svg template thead title video xmp".split(" ")
#: The rest of a tag behind its name: quotes hold values only behind a sign of equality, and > in them doesn't end it.
_REST = r"""(?:[^>=]|=\s*+"[^"]*+(?:"|$)|=\s*+'[^']*+(?:'|$)|=)*+(?:>|$)"""
#: A comment, a declaration or such, a tag; what lacks its end goes up to the text's end.
_MARKUP = rf"<!--(?:-?>|[\s\S]*?(?:--!?>|$))|<(?:[!?]|/[^A-Za-z>])[^>]*+(?:>|$)|</>|</?[A-Za-z]{_REST}"
_OUTER = r"(?U)^[\s\uFEFF]+|[\s\uFEFF]+$"


def without_markup(text: Column) -> Column:
    """The text of an HTML fragment, as HTML: tags, comments and HIDDEN elements with what they hold go, and what is left of & < > and hard blanks is written as entities.

    A < that begins no tag is text. Text without any < is left as it is. Of
    entities those for & < > and hard blanks stay, quotes and numbers are read;
    other names stay as they are.
    """
    hidden = rf"(?i)<({'|'.join(HIDDEN)})(?=[\s/>]){_REST}[\s\S]*?(?:</\1(?=[\s/>])[^>]*+(?:>|$)|$)"
    # comments first, as tags in them are none
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"<!--(?:-?>|[\s\S]*?(?:--!?>|$))", ""), hidden, ""), _MARKUP, "")
    number = lambda x: F.coalesce(F.conv(F.nullif(F.regexp_extract(x, r"^&#[xX]([0-9a-fA-F]{1,6});", 1), F.lit("")), 16, 10), F.nullif(F.regexp_extract(x, r"^&#([0-9]{1,7});", 1), F.lit(""))).cast("long")
    good = lambda n: n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
    letter = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    read = lambda x: F.when(good(number(x)), F.concat(letter(number(x)), F.regexp_replace(x, "^[^;]*;", ""))).otherwise(x)
    decoded = F.when(F.contains(bare, F.lit("&#")), F.array_join(F.transform(F.split(bare, "(?=&#)"), read), "")).otherwise(bare)
    decoded = F.regexp_replace(F.regexp_replace(decoded, "&quot;", '"'), "&apos;", "'")
    escaped = F.regexp_replace(decoded, "&(?!(?:[a-zA-Z][a-zA-Z0-9]*;))", "&amp;")
    for plain, name in (("<", "&lt;"), (">", "&gt;"), ("\u00a0", "&nbsp;")):
        escaped = F.replace(escaped, F.lit(plain), F.lit(name))
    return F.when(F.contains(text, F.lit("<")), escaped).otherwise(text)


def clean_text(text: Column) -> Column:
    """The first TEXT characters without markup, then without outer blanks, then without control characters but tab and line ends; what is empty then is null."""
    bare = F.regexp_replace(without_markup(F.substring(text, 1, TEXT)), _OUTER, "")
    return F.nullif(F.regexp_replace(bare, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), F.lit(""))


def clean_url(url: Column) -> Column:
    """An http or https address with a host, or an ipfs or ar one whose first part is a plain id; without markup and outer blanks, of TEXT characters. Others are null."""
    plain = F.regexp_replace(without_markup(F.substring(url, 1, TEXT)), _OUTER, "")
    web = plain.rlike(r"^(?i)https?://[^\s/?#<>\"]+[^\s<>\"]*$")
    return F.when(web | plain.rlike(r"^ipfs://[a-zA-Z0-9]+(/[^<>]*)?$") | plain.rlike(r"^ar://[a-zA-Z0-9_-]+(/[^<>]*)?$"), plain)


def digest(docs: DataFrame, most: int, body: str = "body") -> DataFrame:
    """docs with doc_status (ok, oversize, invalid_json, error), bytes, sha256 and fields, the members of the JSON object as texts.

    A null body is an error. Only an ok document has fields; only bodies of up to `most` bytes are parsed.
    """
    rows = docs.drop("doc_status", "bytes", "sha256", "fields")
    size = F.octet_length(body)
    text = F.col(body).cast("string")
    parsed = F.when(size <= most, F.from_json(text, "map<string,string>"))
    whole = text.rlike(r"^\s*\{") & F.try_parse_json(text).isNotNull()
    status = F.when(F.col(body).isNull(), "error").when(size > most, "oversize").when(whole & parsed.isNotNull(), "ok").otherwise("invalid_json")
    rows = rows.withColumns({"doc_status": status, "bytes": size.cast("long"), "sha256": F.sha2(F.col(body).cast("binary"), 256), "fields": parsed})
    return rows.withColumn("fields", F.when(F.col("doc_status") == "ok", F.col("fields")))


def to_metadata(digested: DataFrame, agents: DataFrame, most: int) -> DataFrame:
    """asset, key, value: one row for each field that isn't empty, and the source and status rows.

    A document counts only while its uri is still the agent's. A value of more
    than `most` bytes gives a `<key>_meta` row with its size and digest instead.
    """
    live = digested.join(agents.select("asset", "uri"), ["asset", "uri"], "left_semi")
    each = live.select("asset", F.explode("fields").alias("k", "v")).where("v IS NOT NULL AND v <> ''")
    large = F.octet_length("v") > most
    told = F.to_json(F.struct(F.lit("oversize").alias("status"), F.octet_length("v").alias("bytes"), F.sha2("v", 256).alias("sha256")))
    fields = each.select("asset", F.concat(F.lit("_uri:"), "k", F.when(large, "_meta").otherwise("")).alias("key"), F.when(large, told).otherwise(F.col("v")).alias("value"))
    status = F.to_json(F.struct(F.col("doc_status").alias("status"), "bytes", "sha256", F.col("doc_status").isin("error", "timeout").alias("retryable")))
    extra = live.select("asset", F.explode(F.map_from_arrays(F.array(F.lit("_uri:_source"), F.lit("_uri:_status")), F.array(F.col("uri"), status))).alias("key", "value"))
    return fields.unionByName(extra)


def replace_metadata(old: DataFrame, new: DataFrame) -> DataFrame:
    """old (asset, key, value, immutable) with the `_uri:` rows of new's assets replaced; immutable rows stay and win."""
    assets = new.select("asset").distinct().withColumn("_new", F.lit(True))
    stays = old.join(assets, "asset", "left").where("immutable OR _new IS NULL OR NOT startswith(key, '_uri:')").drop("_new")
    fixed = old.where("immutable").select("asset", "key").distinct()
    return stays.unionByName(new.join(fixed, ["asset", "key"], "left_anti").withColumn("immutable", F.lit(False)))


def to_refresh(agents: DataFrame, metadata: DataFrame) -> DataFrame:
    """Agents with a uri whose source row is missing or another, or whose status is missing or to be tried again."""
    of = lambda key: F.max(F.when(F.col("key") == key, F.col("value")))
    seen = metadata.where("key IN ('_uri:_source', '_uri:_status')").groupBy("asset").agg(of("_uri:_source").alias("_s"), of("_uri:_status").alias("_t"))
    again = F.get_json_object("_t", "$.retryable") == "true"
    need = F.col("_s").isNull() | (F.col("_s") != F.col("uri")) | F.col("_t").isNull() | F.coalesce(again, F.lit(False))
    return agents.where("uri <> ''").join(seen, "asset", "left").where(need).select("asset", "uri")


@F.pandas_udf(T.BinaryType())
def encode_value(value: pd.Series) -> pd.Series:
    """Byte 0 and the value, or byte 1 and its zstd frame if the value is over PLAIN bytes and that is shorter; null stays null."""
    import zstandard

    packer = zstandard.ZstdCompressor(level=3)

    def one(b):
        if b is None:
            return None
        packed = packer.compress(bytes(b)) if len(b) > PLAIN else None
        return b"\1" + packed if packed is not None and len(packed) < len(b) else b"\0" + bytes(b)

    return value.map(one)


#: Keys whose values are never compressed.
PLAIN_KEYS = ["_uri:type", "_uri:name", "_uri:description", "_uri:image", "_uri:services", "_uri:registrations", "_uri:supported_trust", "_uri:active", "_uri:x402_support", "_uri:skills", "_uri:domains", "_uri:_status"]


def encode_values(metadata: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """metadata with its values encoded: those of PLAIN_KEYS as they are behind a byte 0, others as encode_value() says."""
    raw = F.concat(F.unhex(F.lit("00")), F.col(value).cast("binary"))
    packed = encode_value(F.when(~F.col(key).isin(PLAIN_KEYS), F.col(value).cast("binary")))
    return metadata.withColumn(value, F.when(F.col(key).isin(PLAIN_KEYS), raw).otherwise(packed))


@F.pandas_udf(T.BinaryType())
def decode_value(value: pd.Series) -> pd.Series:
    """The value that was encoded; without a known first byte the bytes themselves. Damaged frames, and those beyond the limits, are null."""
    import zstandard

    opener = zstandard.ZstdDecompressor()

    def one(b):
        if b is None or not len(b):
            return b
        b = bytes(b)
        if b[0] == 1:
            if len(b) - 1 > PACKED:
                return None
            try:
                out = opener.decompressobj().decompress(b[1:]) if zstandard.frame_content_size(b[1:]) <= EXPANDED else None
            except zstandard.ZstdError:
                return None
            return out if out is None or len(out) <= EXPANDED else None
        return b[1:] if b[0] == 0 else b

    return value.map(one)


#: The members that every document may have, by their metadata key; the trust kinds; the members beyond those that are kept, the items of a list, characters of a nested value.
STANDARD = {"name": "name", "description": "description", "image": "image", "type": "type", "services": "services", "registrations": "registrations", "supportedTrust": "supported_trust", "active": "active", "x402Support": "x402_support"}
TRUSTS = ["reputation", "crypto-economic", "tee-attestation", "8004", "oasf", "x402"]
EXTRA, ITEMS, NESTED = 50, 20, 10_000


def supported_trust(text: Column) -> Column:
    """The known trust kinds among the first ITEMS of a JSON list, in lower case, as a JSON list; null if none is."""
    items = F.transform(F.slice(F.from_json(text, "array<string>"), 1, ITEMS), lambda x: clean_text(F.lower(x)))
    good = F.filter(items, lambda x: x.isin(TRUSTS))
    return F.when(F.size(good) > 0, F.to_json(good))


def flag(text: Column) -> Column:
    """true or false; other values are null."""
    return F.when(text.isin("true", "false"), text)


def read_documents(docs: DataFrame, most: int, full: bool = False, body: str = "body", fetched: str | None = None) -> DataFrame:
    """digest() with the fetch's own status (timeout, error, blocked) where it isn't ok, fields cleaned by their kind, and `truncated`.

    Only STANDARD members are kept, under their metadata names; with full, up to
    EXTRA others in the order of the document, cleaned as text, nested ones as
    JSON of NESTED characters; `truncated` says that there were more. Members
    that are empty after cleaning go. Services and registrations stay JSON text
    here; registrations.sanitize_services() and sanitize_registrations() clean
    them. Names of the extra members that clash with a standard one's metadata
    name lose to it.
    """
    rows = digest(docs, most, body)
    if fetched is not None:
        bad = F.col(fetched).isNotNull() & (F.col(fetched) != "ok")
        rows = rows.withColumns({"doc_status": F.when(bad, F.col(fetched)).otherwise(F.col("doc_status")), "fields": F.when(~bad, F.col("fields"))})
    cleaners = {"name": clean_text, "description": clean_text, "type": clean_text, "image": clean_url, "supportedTrust": supported_trust, "active": flag, "x402Support": flag}
    kept = [F.struct(F.lit(meta).alias("key"), cleaners.get(k, lambda x: x)(F.try_element_at("fields", F.lit(k))).alias("value")) for k, meta in STANDARD.items()]
    standard = F.array(*kept)
    names = F.filter(F.map_entries("fields"), lambda e: ~e["key"].isin(list(STANDARD) + list(STANDARD.values())))
    nested = lambda v: F.when(v.rlike(r"^\s*[\[{]"), F.substring(v, 1, NESTED)).otherwise(clean_text(v))
    extra = F.transform(F.slice(names, 1, EXTRA), lambda e: F.struct(e["key"].alias("key"), nested(e["value"]).alias("value")))
    every = F.concat(standard, extra) if full else standard
    good = F.filter(every, lambda e: e["value"].isNotNull() & ~e["value"].isin("", "[]"))
    rows = rows.withColumn("truncated", F.coalesce(F.size(names) > EXTRA, F.lit(False)) if full else F.lit(False))
    return rows.withColumn("fields", F.when(F.col("fields").isNotNull(), F.map_from_entries(good)))


def backfill_names(agents: DataFrame, metadata: DataFrame) -> DataFrame:
    """agents whose nft_name is null or empty take the name that their document gives."""
    names = metadata.where("key = '_uri:name'").groupBy("asset").agg(F.max("value").alias("_name"))
    return agents.join(names, "asset", "left").withColumn("nft_name", F.coalesce(F.nullif("nft_name", F.lit("")), F.col("_name"))).drop("_name")


def latest_tasks(tasks: DataFrame, order: str = "queued_at") -> DataFrame:
    """The newest queued document of each agent; ties to the higher uri."""
    columns = [c for c in tasks.columns if c != "asset"]
    newest = F.max_by(F.struct(*columns), F.struct(order, "uri")).alias("_t")
    return tasks.groupBy("asset").agg(newest).select("asset", *[F.col(f"_t.{c}").alias(c) for c in columns])


def base64_to_binary(metadata: DataFrame, value: str = "value") -> DataFrame:
    """Old values, base64 texts, as bytes; what is no base64 becomes its own bytes."""
    text = F.col(value).cast("string")
    return metadata.withColumn(value, F.coalesce(F.try_to_binary(F.when(text.rlike("^[A-Za-z0-9+/]*={0,2}$") & (F.length(text) % 4 == 0), text), F.lit("base64")), text.cast("binary")))


def cap_bytes(page: DataFrame, most: int = 10 << 20, value: str = "value") -> DataFrame:
    """A page with its stored bytes in `page_bytes`; `rejected` is true on every row if they are more than `most`."""
    total = page.agg(F.coalesce(F.sum(F.octet_length(value)), F.lit(0)).alias("page_bytes"))
    return page.crossJoin(F.broadcast(total)).withColumn("rejected", F.col("page_bytes") > most)  # one row
