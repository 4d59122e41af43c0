"""Filters and lists of the entity tables.

An entity is described once, in ENTITIES: the fields that may be filtered and
how, and the orders of its lists. Filters become one conjunction of columns,
which Spark pushes into the scan; lists are `orderBy().limit()`, which keeps
only that many rows of a task.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar
from .paging import after

#: The longest `in` list, and the default and greatest sizes of pages.
MOST_IN, FIRST, MOST_FIRST, MOST_SKIP = 250, 100, 250, 5000


@dataclass(frozen=True)
class Entity:
    #: field: column and tests, of which eq is the field's plain name and the others are its suffixes.
    fields: dict[str, tuple[str, tuple[str, ...]]]
    #: the columns that a list may be ordered by, by name; the first is the default.
    orders: dict[str, str]
    #: what breaks ties: (column, direction), where None is the list's own direction.
    ties: tuple[tuple[str, bool | None], ...]
    #: ties of lists in order of slot, counter or scoped id.
    slot_ties: tuple[str, ...] = ()
    status: str = "status"
    #: fields with ranges that only mean something within one of these.
    scoped: dict[str, tuple[str, ...]] = field(default_factory=dict)


_RANGE = ("eq", "gt", "gte", "lt", "lte")
_TIMES = ("gt", "lt")
_PLACE = ("tx_index", "event_ordinal", "tx_signature")
_KEY = ("asset", "client_address", "feedback_index")
#: Names of fields, columns and orders.
ENTITIES = {
    "agent": Entity(
        {
            "id": ("asset", ("eq", "in")), "agentId": ("agent_id", ("eq",)), "owner": ("owner", ("eq", "in")), "creator": ("creator", ("eq",)), "agentWallet": ("agent_wallet", ("eq",)),
            "collection": ("collection", ("eq",)), "collectionPointer": ("canonical_col", ("pointer",)), "parentAsset": ("parent_asset", ("eq",)), "parentCreator": ("parent_creator", ("eq",)),
            "atomEnabled": ("atom_enabled", ("eq",)), "colLocked": ("col_locked", ("eq",)), "parentLocked": ("parent_locked", ("eq",)), "trustTier": ("trust_tier", ("gte",)),
            "totalFeedback": ("total_feedback", ("gt", "gte")), "createdAt": ("created_at", _TIMES), "updatedAt": ("updated_at", _TIMES),
        },
        {"createdAt": "created_at", "updatedAt": "updated_at", "totalFeedback": "total_feedback", "qualityScore": "quality_score", "trustTier": "trust_tier"},
        (("asset", None),), ("tx_index", "event_ordinal", "asset"),
    ),
    "feedback": Entity(
        {
            "agent": ("asset", ("eq",)), "feedbackId": ("feedback_id", _RANGE), "clientAddress": ("client_address", ("eq",)), "tag1": ("tag1", ("eq",)), "tag2": ("tag2", ("eq",)),
            "endpoint": ("endpoint", ("eq",)), "isRevoked": ("is_revoked", ("eq",)), "createdAt": ("created_at", _TIMES),
        },
        {"createdAt": "created_at", "value": "value", "feedbackIndex": "feedback_index"},
        (("asset", True), ("client_address", True), ("feedback_index", True), ("feedback_id", True), ("id", True)), ("created_at", *_KEY, "id"),
    ),
    "response": Entity(
        {"feedback": ("", ("feedback",)), "responseId": ("response_id", _RANGE), "responder": ("responder", ("eq",)), "createdAt": ("created_at", _TIMES)},
        {"createdAt": "created_at", "responseCount": "response_count"}, (("response_id", None), ("id", None)), (*_KEY, "responder", *_PLACE), scoped={"responseId": ("feedback",)},
    ),
    "revocation": Entity(
        {
            "agent": ("asset", ("eq",)), "revocationId": ("revocation_id", _RANGE), "clientAddress": ("client_address", ("eq",)), "feedbackIndex": ("feedback_index", ("eq",)),
            "createdAt": ("created_at", _TIMES),
        },
        {"createdAt": "created_at", "revokeCount": "revoke_count"}, (("revocation_id", None), ("id", None)), (*_KEY, *_PLACE), scoped={"revocationId": ("agent",)},
    ),
    "validation": Entity({"agent": ("asset", ("eq",)), "validatorAddress": ("validator_address", ("eq",)), "status": ("", ("state",))}, {"createdAt": "created_at"}, (("id", None),), status="chain_status"),
    "metadata": Entity({"agent": ("asset", ("eq",)), "key": ("key", ("eq",))}, {"agent": "asset"}, (("key", True),)),
}


def pointer_is(column: Column, test: str, values: Sequence[str]) -> Column:
    """A pointer against values, each of which stands for its other spelling too; test is in or not.in."""
    wide = sorted({w for v in values for w in pointer_spellings(v)})
    return column.isin(wide) if test == "in" else ~column.isin(wide)


def pointer_spellings(value: str) -> list[str]:
    """`c1:<cid>` and the bare cid, if it is base32; else the value alone."""
    bare = value.removeprefix("c1:")
    return [bare, f"c1:{bare}"] if re.fullmatch("b[a-z2-7]{20,}", bare) else [value]


def _test(column: str, how: str, value) -> Column | None:
    c = F.col(column) if column else None
    if how == "in":
        return c.isin(list(value)[:MOST_IN]) if value else None
    if how == "pointer":
        return pointer_is(c, "in", [value])
    if how == "state":
        return {"PENDING": F.col("response").isNull(), "COMPLETED": F.col("response").isNotNull(), "EXPIRED": F.lit(False)}.get(value)
    if column.endswith("_at") and how != "eq" and isinstance(value, int | float):
        value = F.timestamp_seconds(F.lit(value))
    return {"eq": lambda: c == value, "gt": lambda: c > value, "gte": lambda: c >= value, "lt": lambda: c < value, "lte": lambda: c <= value}[how]()


def condition(entity: str, **given) -> Column:
    """The conjunction of the given filters and of not being orphaned; null values, empty lists and unknown fields don't count.

    `in` lists count up to MOST_IN values. A filter of a scoped id without its
    scope is an error. A null column fits no filter.
    """
    spec = ENTITIES[entity]
    known = {(name if how in ("eq", "pointer", "state", "feedback") else f"{name}_{how}"): (name, column, how) for name, (column, tests) in spec.fields.items() for how in tests}
    found = F.col(spec.status) != "ORPHANED"
    for key, value in given.items():
        if value is None or key not in known:
            continue
        name, column, how = known[key]
        if name in spec.scoped and all(given.get(s) is None for s in spec.scoped[name]):
            raise ValueError(f"{key} needs one of {spec.scoped[name]}")
        test = _test(column, how, value) if how != "feedback" else None
        found = found if test is None else found & test
    return found


def where(rows: DataFrame, entity: str, feedbacks: DataFrame | None = None, **given) -> DataFrame:
    """The rows that fit condition(); a response's `feedback` is asset:client:index, or a scoped id, which feedbacks must hold (a semi join)."""
    found = rows.where(condition(entity, **given))
    ref = given.get("feedback") if entity == "response" else None
    if ref is None:
        return found
    parts = str(ref).removeprefix("sol:").split(":")
    if len(parts) == 3 and re.fullmatch(r"-?\d+", parts[2]):
        return found.where((F.col("asset") == parts[0]) & (F.col("client_address") == parts[1]) & (F.col("feedback_index") == int(parts[2])))
    if not re.fullmatch(r"-?\d+", str(ref)):
        return found
    if feedbacks is None:
        raise ValueError("a scoped id needs the feedbacks")
    return with_feedback_id(found, feedbacks, int(ref))


def with_feedback_id(responses: DataFrame, feedbacks: DataFrame, feedback_id: int) -> DataFrame:
    """Responses whose feedback bears a scoped id."""
    return responses.join(feedbacks.where(F.col("feedback_id") == feedback_id).select(*_KEY), list(_KEY), "left_semi")


def user_metadata(rows: DataFrame) -> DataFrame:
    """Metadata that no document gave."""
    return rows.where(~F.startswith("key", F.lit("_uri:")))


def any_tag(*tests: tuple[str, str]) -> Column:
    """Rows with one of the (column, value) pairs."""
    found = F.lit(False)
    for column, value in tests:
        found = found | (F.col(column) == value)
    return found


def by_status(status: str | None = None, negate: bool = False, include_orphaned: bool = False, column: str = "status") -> Column:
    """An explicit status, or its negation; without one all but the orphaned rows, or all."""
    if status is not None:
        return F.col(column) != status if negate else F.col(column) == status
    return F.lit(True) if include_orphaned else F.col(column) != "ORPHANED"


def at_slot(responses: DataFrame, feedbacks: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """Responses whose slot, or, if they have none, whose feedback's, lies in [low, high]."""
    parents = feedbacks.select(*_KEY, F.col("block_slot").alias("_parent_slot"))
    slot = F.coalesce("block_slot", "_parent_slot")
    rows = responses.join(parents, list(_KEY), "left")
    rows = rows if low is None else rows.where(slot >= low)
    rows = rows if high is None else rows.where(slot <= high)
    return rows.drop("_parent_slot")


def clamp(first: int | None, skip: int | None, default: int = FIRST, most: int = MOST_FIRST, most_skip: int = MOST_SKIP) -> tuple[int, int]:
    """A page's size and offset within bounds."""
    return max(0, min(default if first is None else first, most)), max(0, min(skip or 0, most_skip))


def list_order(entity: str, order: str | None = None, descending: bool = True) -> list[tuple[str, bool]]:
    """(column, ascending) of a list; an unknown order is the default one."""
    spec = ENTITIES[entity]
    up = not descending
    return [(spec.orders.get(order or "", next(iter(spec.orders.values()))), up), *((c, up if d is None else d) for c, d in spec.ties)]


def list_rows(rows: DataFrame, entity: str, order: str | None = None, descending: bool = True, first: int | None = None, skip: int | None = None, cursor: Sequence | None = None, most: int = MOST_FIRST, **given) -> DataFrame:
    """A page of an entity's list: filtered, in order (nulls last), from the row after the cursor, or from an offset.

    The cursor holds the order's columns of the last row seen; it goes with the
    default order alone, and not with an offset.
    """
    first, skip = clamp(first, skip, most=most)
    keys = list_order(entity, order, descending)
    if cursor is not None and (skip or keys[0][0] != next(iter(ENTITIES[entity].orders.values()))):
        raise ValueError("a cursor goes with the default order and without an offset")
    feedbacks = given.pop("feedbacks", None)
    rows = where(rows, entity, feedbacks, **given)
    if cursor is not None:
        rows = rows.where(after(keys, list(cursor)))
    rows = rows.orderBy(*[F.asc_nulls_last(c) if up else F.desc_nulls_last(c) for c, up in keys])
    return (rows.offset(skip) if skip else rows).limit(first)


def list_by_slot(rows: DataFrame, entity: str, column: str, descending: bool = False, first: int = FIRST, skip: int = 0) -> DataFrame:
    """A list in order of a slot, counter or scoped id; what breaks ties is ascending, for agents in the list's direction."""
    ties = ENTITIES[entity].slot_ties
    turn = descending and entity == "agent"
    first, skip = clamp(first, skip, most=1000, most_skip=10_000)
    order = [F.desc_nulls_last(column) if descending else F.asc_nulls_last(column), *[F.desc_nulls_last(c) if turn else F.asc_nulls_last(c) for c in ties]]
    return rows.orderBy(*order).offset(skip).limit(first)


def list_collections(pointers: DataFrame, order: str = "first_seen_at", descending: bool = True, first: int | None = None, skip: int | None = None, pointer: str | None = None, creator: str | None = None, first_asset: str | None = None, ids: tuple[int | None, int | None] = (None, None), slots: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """Pointers by first sight, then col and creator, filtered by either spelling of the pointer, creator, first asset, and ranges of id and slot."""
    first, skip = clamp(first, skip)
    found = F.lit(True)
    if pointer is not None:
        found = found & pointer_is(F.col("col"), "in", [pointer])
    for column, value in (("creator", creator), ("first_seen_asset", first_asset)):
        found = found if value is None else found & (F.col(column) == value)
    for column, (low, high) in (("collection_id", ids), ("first_seen_slot", slots)):
        found = found if low is None else found & (F.col(column) >= low)
        found = found if high is None else found & (F.col(column) <= high)
    return pointers.where(found).orderBy(F.desc(order) if descending else F.asc(order), "col", "creator").offset(skip).limit(first)


def in_collection(agents: DataFrame, pointer: str, creator: str | None = None) -> DataFrame:
    """The agents, orphaned ones aside, that point at a collection, in either spelling, of a creator (else owner)."""
    found = agents.where(pointer_is(F.col("canonical_col"), "in", [pointer])).where(F.col("status") != "ORPHANED")
    return found if creator is None else found.where(F.coalesce("creator", "owner") == creator)


def collection_assets(agents: DataFrame, pointer: str, creator: str | None = None, **options) -> DataFrame:
    return list_rows(in_collection(agents, pointer, creator), "agent", **options)


def collection_asset_count(agents: DataFrame, pointer: str, creator: str | None = None) -> DataFrame:
    return in_collection(agents, pointer, creator).agg(F.count("*").alias("n"))


def children(agents: DataFrame, parent: str, first: int | None = None, skip: int | None = None) -> DataFrame:
    """The direct children of an agent, newest first."""
    first, skip = clamp(first, skip)
    return agents.where((F.col("parent_asset") == parent) & (F.col("status") != "ORPHANED")).orderBy(F.desc_nulls_last("created_at"), F.desc("asset")).offset(skip).limit(first)


def get_leaderboard(agents: DataFrame, collection: str | None = None, min_tier: int = 0, limit: int = 50, cursor_sort_key: int | None = None, include_orphaned: bool = False) -> DataFrame:
    """Agents of a tier and up by sort key, from below a sort key on; of one collection if it is named."""
    found = by_status(include_orphaned=include_orphaned) & (F.col("trust_tier") >= min_tier)
    if collection is not None:
        found = found & (F.col("collection") == collection)
    if cursor_sort_key is not None:
        found = found & (F.col("sort_key") < cursor_sort_key)
    return agents.where(found).orderBy(F.desc("sort_key"), "asset").limit(max(0, min(limit, 1000)))


_OPS = {"eq": lambda c, v: c == v, "neq": lambda c, v: c != v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v}


def parse_list(text: str) -> list[str]:
    """The values of `a,"b,c",d`: commas part them but within double quotes, where a backslash keeps the next character."""
    values = re.findall(r'\s*("(?:[^"\\]|\\.)*"|[^,"]*)\s*(?:,|$)', text)
    rebuilt = sum(len(m.group(0)) for m in re.finditer(r'\s*("(?:[^"\\]|\\.)*"|[^,"]*)\s*(?:,|$)', text))
    if rebuilt != len(text):
        raise ValueError(f"not a list: {text}")
    if values and not values[-1] and not text.endswith(","):
        values.pop()
    got = [re.sub(r"\\(.)", r"\1", v[1:-1]) if v[:1] == '"' else v.strip() for v in values]
    if any(not v for v in got):
        raise ValueError(f"empty value in a list: {text}")
    return got


def parse_filter(column: str, text: str, pointer: bool = False) -> Column:
    """A filter text as a condition on a column: eq.x, neq.x, gt.x, gte.x, lt.x, lte.x, in.(x,y), not.in.(x,y); a bare x is eq.

    Numbers and timestamps compare as such if the column does (the value is cast
    by Spark); malformed lists raise ValueError. With pointer, both spellings of
    a pointer count.
    """
    c = F.col(column)
    for test in ("not.in", "in"):
        if text.startswith(f"{test}.("):
            if not text.endswith(")"):
                raise ValueError(f"list without an end: {text}")
            values = parse_list(text[len(test) + 2 : -1])[:MOST_IN]
            if pointer:
                return pointer_is(c, test, values)
            return c.isin(values) if test == "in" else ~c.isin(values)
    test, dot, value = text.partition(".")
    if not dot or test not in _OPS:
        test, value = "eq", text
    if pointer and test in ("eq", "neq"):
        return pointer_is(c, "in" if test == "eq" else "not.in", [value])
    if column.endswith("_at"):
        return _OPS[test](c, scalar.timestamp_literal(F.lit(value)))
    return _OPS[test](c, F.lit(value))


def lookup(rows: DataFrame, condition: Column) -> DataFrame:
    """The one row that fits, or none. Two rows fail the job: the id is ambiguous."""
    two = rows.where(condition).limit(2)
    n = two.agg(F.count("*").alias("_n")).select(F.when(F.col("_n") > 1, F.raise_error(F.lit("ambiguous id"))).otherwise(F.col("_n")).alias("_n"))
    return two.join(F.broadcast(n), F.col("_n").isNotNull()).drop("_n")  # one row
