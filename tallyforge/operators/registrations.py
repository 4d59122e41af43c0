"""Documents of agents and collections in detail: services, registrations, wide registration records, collection documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .documents import clean_text, clean_url

#: Kinds of services, items of a list that are read, lengths of lists and of a version, and the forms of endpoints, slugs, registries and pointers.
KINDS = ["mcp", "a2a", "oasf", "ens", "sns", "did", "agentwallet", "wallet"]
ITEMS, NAMES, SLUGS, VERSION = 20, 100, 50, 20
ENS = r"^(?=.{1,255}$)(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}$"
SNS = r"^(?=.{1,255}$)(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+sol$"
DID = r"^did:[a-z0-9]+:[A-Za-z0-9._:%-]+(?::[A-Za-z0-9._:%-]+)*(?:[/?#][^\s]*)?$"
ACCOUNT = r"^eip155:[0-9]+:0x[a-fA-F0-9]{40}$"
SLUG = r"^[a-z0-9]+(?:[a-z0-9_-]*[a-z0-9])?(?:/[a-z0-9]+(?:[a-z0-9_-]*[a-z0-9])?)*$"
REGISTRY = r"^[a-z0-9]+:[a-z0-9]+:[a-zA-Z0-9]+$"
POINTER = r"^c1:\s*[a-zA-Z0-9]+(?:/[a-zA-Z0-9._-]+)*\s*$"
#: Members of a collection's document and the most characters of each; None marks an address.
COLLECTION = {"version": 32, "name": 128, "symbol": 32, "description": 4096, "image": None, "banner_image": None, "socials.website": None, "socials.x": 128, "socials.discord": None}


def _typed(value: Column, path: str) -> tuple[Column, Column]:
    found = F.try_variant_get(value, path, "variant")
    return found, F.schema_of_variant(found)


def _text(value: Column, path: str) -> Column:
    """A member that is a JSON string; null for any other type."""
    found, kind = _typed(value, path)
    return F.when(kind == "STRING", F.try_variant_get(found, "$", "string"))


def _items(value: Column, path: str = "$") -> Column:
    """The elements of a member that is an array, as variants; else null."""
    return F.try_variant_get(value, path, "array<variant>")


def _strings(value: Column, path: str) -> Column:
    """The JSON strings among a member's elements; null if it isn't an array."""
    return F.filter(F.transform(_items(value, path), lambda x: _text(x, "$")), lambda x: x.isNotNull())


def _kind(item: Column, clean) -> Column:
    name, kind = clean(F.lower(_text(item, "$.name"))), clean(F.lower(_text(item, "$.type")))
    return F.when(name.isin(KINDS), name).when(kind.isin(KINDS), kind)


def _objects(text: Column) -> Column:
    """Up to ITEMS elements of the array in a JSON text, those that are objects; without an array, none."""
    first = F.slice(_items(F.try_parse_json(text)), 1, ITEMS)
    return F.coalesce(F.filter(first, lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT"))), F.array().cast("array<variant>"))


def sanitize_services(text: Column) -> Column:
    """The valid services in a JSON array: kind from name, else from type; an endpoint of the kind's form.

    An item without a known kind, or with an endpoint of another form, goes; one
    without an endpoint stays. Names are cleaned, taxonomy entries must be slugs.
    """

    def one(item: Column) -> Column:
        kind, raw = _kind(item, clean_text), _text(item, "$.endpoint")
        plain = clean_text(raw)
        low = F.lower(plain)
        endpoint = (
            F.when(kind.isin("agentwallet", "wallet"), F.when(plain.rlike(ACCOUNT), plain))
            .when(kind == "ens", F.when(low.rlike(ENS), low))
            .when(kind == "sns", F.when(low.rlike(SNS), low))
            .when(kind == "did", F.when(plain.rlike(DID), plain))
            .otherwise(clean_url(raw))
        )
        names = lambda path: F.slice(F.filter(F.transform(_strings(item, path), clean_text), lambda x: x.isNotNull()), 1, NAMES)
        slugs = lambda path: F.slice(F.filter(_strings(item, path), lambda x: x.rlike(SLUG)), 1, SLUGS)
        same = clean_text(F.lower(_text(item, "$.type")))
        record = F.struct(
            kind.alias("name"),
            F.when(same == kind, same).alias("type"),
            endpoint.alias("endpoint"),
            F.substring(clean_text(_text(item, "$.version")), 1, VERSION).alias("version"),
            names("$.mcpTools").alias("mcpTools"),
            names("$.a2aSkills").alias("a2aSkills"),
            slugs("$.skills").alias("skills"),
            slugs("$.domains").alias("domains"),
        )
        return F.when(kind.isNotNull() & (raw.isNull() | endpoint.isNotNull()), record)

    return F.filter(F.transform(_objects(text), one), lambda x: x.isNotNull())


def sanitize_registrations(text: Column) -> Column:
    """agentId (decimal text) and agentRegistry of the valid items in a JSON array; ids are whole numbers from 0 on, or digits."""

    def one(item: Column) -> Column:
        found, kind = _typed(item, "$.agentId")
        digits, number = clean_text(_text(item, "$.agentId")), F.try_variant_get(found, "$", "double")
        whole = (number >= 0) & (number == F.floor(number)) & ~kind.isin("BOOLEAN", "STRING")
        agent = F.when(digits.rlike("^[0-9]+$"), digits).when(whole, F.try_variant_get(found, "$", "decimal(38,0)").cast("string"))
        registry = clean_text(_text(item, "$.agentRegistry"))
        return F.when(agent.isNotNull() & registry.rlike(REGISTRY), F.struct(agent.alias("agentId"), registry.alias("agentRegistry")))

    return F.filter(F.transform(_objects(text), one), lambda x: x.isNotNull())


def to_boolean(text: Column) -> Column:
    plain = F.lower(F.trim(text))
    return F.when(plain.isin("true", "1"), True).when(plain.isin("false", "0"), False)


def to_strings(text: Column) -> Column:
    """The array in a JSON text if all its elements are strings, else null."""
    items = _items(F.try_parse_json(text))
    return F.when(F.forall(items, lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False))), F.transform(items, lambda x: _text(x, "$")))


def registration_files(metadata: DataFrame) -> DataFrame:
    """One wide record for each asset from its `_uri:` rows (asset, key, value as text).

    One aggregation over pruned keys; the rest is a projection. Skills and
    domains come from the oasf services if these have any, else from the fields.
    """
    keys = ["name", "description", "image", "active", "x402_support", "services", "skills", "domains", "supported_trust"]
    rows = metadata.where(F.col("key").isin([f"_uri:{k}" for k in keys]))
    wide = rows.groupBy("asset").agg(*[F.max(F.when(F.col("key") == f"_uri:{k}", F.col("value"))).alias(f"_{k}") for k in keys])
    bare = lambda x: F.nullif(F.trim(x), F.lit(""))
    items = F.coalesce(_items(F.try_parse_json(F.col("_services"))), F.array().cast("array<variant>"))
    wide = wide.withColumn("_items", items)
    first = lambda kind: F.get(F.filter("_items", lambda x: _kind(x, bare) == kind), F.lit(0))
    own = lambda path: F.flatten(F.transform(F.filter("_items", lambda x: _kind(x, bare) == "oasf"), lambda x: F.coalesce(_strings(x, path), F.array().cast("array<string>"))))
    wide = wide.withColumns({"_mcp": first("mcp"), "_a2a": first("a2a"), "_own_skills": own("$.skills"), "_own_domains": own("$.domains")})
    either = lambda kind: F.when(F.size(f"_own_{kind}") > 0, F.col(f"_own_{kind}")).otherwise(to_strings(F.col(f"_{kind}")))
    legacy = F.coalesce(F.nullif("_skills", F.lit("")), F.nullif("_domains", F.lit(""))).isNotNull()
    return wide.select(
        "asset",
        F.col("_name").alias("name"),
        F.col("_description").alias("description"),
        F.col("_image").alias("image"),
        to_boolean(F.col("_active")).alias("active"),
        to_boolean(F.col("_x402_support")).alias("x402_support"),
        _text(F.col("_mcp"), "$.endpoint").alias("mcp_endpoint"),
        F.coalesce(_strings(F.col("_mcp"), "$.mcpTools"), _strings(F.col("_mcp"), "$.tools")).alias("mcp_tools"),
        _text(F.col("_a2a"), "$.endpoint").alias("a2a_endpoint"),
        F.coalesce(_strings(F.col("_a2a"), "$.a2aSkills"), _strings(F.col("_a2a"), "$.skills")).alias("a2a_skills"),
        either("skills").alias("oasf_skills"),
        either("domains").alias("oasf_domains"),
        ((F.size("_own_skills") > 0) | (F.size("_own_domains") > 0) | legacy).alias("has_oasf"),
        to_strings(F.col("_supported_trust")).alias("supported_trusts"),
    )


def digest_collections(docs: DataFrame, most: int, pointer: str = "pointer", body: str = "body") -> DataFrame:
    """docs with doc_status, bytes, sha256 and the members of COLLECTION, dots written as underscores.

    error: null body, or a pointer that isn't c1:<path>. Only an ok document has
    members, and only bodies of up to `most` bytes are parsed or hashed.
    """
    size, raw = F.octet_length(body), F.col(body).cast("binary")
    parsed = F.when(size <= most, F.try_parse_json(F.col(body).cast("string")))
    kind = F.schema_of_variant(parsed)
    known = F.coalesce(F.col(pointer).rlike(POINTER), F.lit(False)) & F.col(body).isNotNull()
    status = F.when(~known, "error").when(size > most, "oversize").when(parsed.isNull(), "invalid_json").when(kind == "VOID", "error").otherwise("ok")
    member = lambda name, cap: clean_url(_text(parsed, f"$.{name}")) if cap is None else F.nullif(F.trim(F.substring(clean_text(_text(parsed, f"$.{name}")), 1, cap)), F.lit(""))
    read = known & (size <= most)
    out = {"doc_status": status, "bytes": F.when(known, size.cast("long")), "sha256": F.when(read, F.sha2(raw, 256))}
    return docs.withColumns(out | {name.replace(".", "_"): F.when(read, member(name, cap)) for name, cap in COLLECTION.items()})


def collections_to_refresh(agents: DataFrame, pointers: DataFrame) -> DataFrame:
    """asset and canonical_col of agents (with creator, owner) whose pointer row is missing, not ok, or older than last seen."""
    seen = pointers.select(F.col("col").alias("canonical_col"), F.col("creator").alias("_creator"), F.lit(True).alias("_there"), "metadata_status", "metadata_updated_at", "last_seen_at")
    rows = agents.where("canonical_col <> ''").select("asset", "canonical_col", F.coalesce("creator", "owner").alias("_creator"))
    stale = F.col("metadata_updated_at").isNull() | F.coalesce(F.col("metadata_updated_at") < F.col("last_seen_at"), F.lit(False))
    need = F.col("_there").isNull() | F.col("metadata_status").isNull() | (F.col("metadata_status") != "ok") | stale
    return rows.join(seen, ["canonical_col", "_creator"], "left").where(need).select("asset", "canonical_col")


def fetch_url(uri: Column, gateway: str = "https://ipfs.io", insecure: bool = False) -> Column:
    """The https address of an ipfs, ar or https uri; http only if insecure; others are null."""
    base = gateway.rstrip("/")
    found = F.when(uri.startswith("ipfs://"), F.concat(F.lit(f"{base}/ipfs/"), F.substr(uri, F.lit(8)))).when(uri.startswith("/ipfs/"), F.concat(F.lit(base), uri))
    found = found.when(uri.startswith("ar://"), F.concat(F.lit("https://arweave.net/"), F.substr(uri, F.lit(6)))).when(uri.startswith("https://"), uri)
    return found.when(uri.startswith("http://"), uri) if insecure else found
