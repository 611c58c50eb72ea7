"""Projections, filters, lookups and lists.

Single-key lookups of the reference are bulk here: a DataFrame of requested
keys is semi-joined, so one call serves one key or millions. Literal lists
(subscription filters, kinds) are small arguments, not data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.expr import BASE58_PATTERN, norm_kind
from tallyframe.schemas import WALLET_ACTIVITY_TYPES


# -- lookups ---------------------------------------------------------------

def lookup(df: DataFrame, keys_df: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key is requested (0 or 1 row per key when key is the pk).

    A semi join: duplicate requests do not duplicate rows.
    """
    keys = [key] if isinstance(key, str) else list(key)
    return df.join(keys_df.select(*keys), keys, "left_semi")


def resolve_identifier(registry: DataFrame, requests: DataFrame, ident: str = "identifier") -> DataFrame:
    """P5: ``address = ident OR name = ident``, first hit per request.

    Two equi semi-matches instead of an OR join (which would plan a nested
    loop); address matches win, then lowest id.
    """
    req = requests.select(F.col(ident)).distinct()
    by_addr = req.join(registry, req[ident] == registry["address"]).select(ident, F.lit(0).alias("_prio"), "id")
    by_name = req.join(registry, req[ident] == registry["name"]).select(ident, F.lit(1).alias("_prio"), "id")
    best = (by_addr.unionByName(by_name).groupBy(ident)
            .agg(F.min(F.struct("_prio", "id")).alias("_b"))
            .select(ident, F.col("_b")["id"].alias("id"), (F.col("_b")["_prio"] == 0).alias("matched_address")))
    return best.join(registry, "id")


def activity_filter(df: DataFrame, kinds: Sequence[str], col: str = "activity_type") -> DataFrame:
    """Case- and underscore-insensitive member-of-list; 'all' or empty = no filter."""
    wanted = [k.lower().replace("_", "") for k in kinds]
    if not wanted or "all" in wanted:
        return df
    return df.where(norm_kind(col).isin(wanted))


def subscription_filter(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (),
                        required: Sequence[str] = (), vote: bool | None = None, failed: bool | None = None,
                        signature: str | None = None, keys: str = "account_keys") -> DataFrame:
    """account_include any-of, account_exclude none-of, account_required all-of
    (an empty list is no constraint), vote / failed flags, exact signature."""
    cond = F.lit(True)
    k = F.col(keys)
    if include:
        cond = cond & F.arrays_overlap(k, F.array(*[F.lit(a) for a in include]))
    if exclude:
        cond = cond & ~F.arrays_overlap(k, F.array(*[F.lit(a) for a in exclude]))
    if required:
        cond = cond & (F.size(F.array_except(F.array(*[F.lit(a) for a in required]), k)) == 0)
    if vote is not None:
        cond = cond & (F.col("is_vote") == F.lit(vote))
    if failed is not None:
        cond = cond & (F.col("failed") == F.lit(failed))
    if signature is not None:
        cond = cond & (F.col("signature") == F.lit(signature))
    return df.where(cond)


def watchlist_edit(watch: DataFrame, edits: DataFrame, key: str = "address") -> DataFrame:
    """Apply ordered add/remove edits to a watch set; the last edit of an address wins.

    ``edits`` has (address, op in {'add','remove'}, seq). The initial set acts
    as adds before any edit. Aggregated map-side, so a hot address is fine.
    """
    base = watch.select(key, F.lit("add").alias("op"), F.lit(None).cast("long").alias("seq"))
    ev = edits.select(key, "op", F.col("seq").cast("long"))
    last = (base.unionByName(ev).groupBy(key)
            .agg(F.max_by("op", F.coalesce(F.col("seq"), F.lit(-(2 ** 63)))).alias("op")))
    return last.where(F.col("op") == "add").select(key)


# -- derived labels and normalisation --------------------------------------

def commitment_levels(df: DataFrame, tip, finalized_depth: int = 32, confirmed_depth: int = 2,
                      slot: str = "slot") -> DataFrame:
    """Finalized <=> slot <= tip-32, confirmed <=> slot <= tip-2, else processed (no saturation)."""
    s = F.col(slot)
    return df.withColumn("commitment",
                         F.when(s <= tip - F.lit(finalized_depth), "finalized")
                         .when(s <= tip - F.lit(confirmed_depth), "confirmed").otherwise("processed"))


def chain_status(slots: DataFrame, finalized_depth: int = 32, confirmed_depth: int = 2) -> DataFrame:
    """Tip, confirmed and finalized slot numbers (saturated) and the lag; one row."""
    tip = F.max("slot")
    return slots.agg(tip.alias("tip")).select(
        "tip",
        F.greatest(F.col("tip") - confirmed_depth, F.lit(0)).cast("long").alias("confirmed_slot"),
        F.greatest(F.col("tip") - finalized_depth, F.lit(0)).cast("long").alias("finalized_slot"),
        (F.col("tip") - F.greatest(F.col("tip") - finalized_depth, F.lit(0))).cast("long").alias("finality_lag"))


def classify_activity(df: DataFrame, wallet: str = "wallet", keys: str = "account_keys",
                      address_pattern: str | None = BASE58_PATTERN) -> DataFrame:
    """Wallet at key 0 with more than two keys -> SEND; at key 0 otherwise -> UNKNOWN;
    else RECEIVE (even when absent, Q5); a malformed wallet address -> UNKNOWN."""
    w, k = F.col(wallet), F.col(keys)
    kind = F.when(F.get(k, 0) == w, F.when(F.size(k) > 2, "SEND").otherwise("UNKNOWN")).otherwise("RECEIVE")
    if address_pattern is not None:
        kind = F.when(w.rlike(address_pattern), kind).otherwise("UNKNOWN")
    return df.withColumn("activity_type", kind)


def account_labels(df: DataFrame) -> DataFrame:
    """Program/Data, readonly (rent epoch 0), ACTIVE/EMPTY by lamports."""
    return df.withColumns({
        "account_type": F.when(F.col("executable"), "Program").otherwise("Data"),
        "readonly": F.when(F.col("rent_epoch") == 0, "Yes").otherwise("No"),
        "account_status": F.when(F.col("lamports") > 0, "ACTIVE").otherwise("EMPTY"),
    })


def confirmation_label(status: Column) -> Column:
    """P16."""
    return F.when(status.isNotNull(), "CONFIRMED").otherwise("UNKNOWN")


def sample_every(df: DataFrame, n: int, r: int = 0, col: str = "slot") -> DataFrame:
    """Every n-th value."""
    return df.where(F.col(col) % n == r)


def block_size_mb(tx_count: Column) -> Column:
    """P21."""
    return tx_count.cast("double") * 200 / 1e6


def access_counts(df: DataFrame, read: str = "accounts_read", written: str = "accounts_written",
                  first: str = "first_account") -> DataFrame:
    """Access-list sizes and an 'N/A' default address."""
    return df.withColumns({
        "n_read": F.size(F.coalesce(F.col(read), F.array().cast("array<string>"))),
        "n_written": F.size(F.coalesce(F.col(written), F.array().cast("array<string>"))),
        first: F.coalesce(F.nullif(F.col(first), F.lit("")), F.lit("N/A")),
    })


# -- sort, top-k -----------------------------------------------------------

def recent_slots(slots: DataFrame, limit: int = 10, finalized: bool = False) -> DataFrame:
    """Latest N (finalized) slots; planned as a top-k (TakeOrderedAndProject)."""
    df = slots.where(F.col("finalized")) if finalized else slots
    return df.orderBy(F.col("slot").desc()).limit(limit)


def top_k_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """First k rows per key. ``row_number() <= k`` is planned with a
    group limit on both sides of the shuffle, so a hot key ships at most k rows per task."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def history(activities: DataFrame, requests: DataFrame, address: str = "wallet_address", limit: int = 50,
            start=None, end=None, kind: str | None = None, ts: str = "ts", kind_col: str = "activity_type",
            ) -> DataFrame:
    """Newest-first activity history per requested address, id tie-break (Q11).

    A kind that is not one of the known ones asks for the rows of no known kind, as 'unknown' does."""
    df = lookup(activities, requests.select(F.col(address)), address)
    if start is not None:
        df = df.where(F.to_date(F.col(ts)) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.to_date(F.col(ts)) <= F.lit(end).cast("date"))
    if kind is not None:
        # kinds are stored in upper case, so that a known kind is a plain equality that reaches the scan
        stored = F.col(kind_col)
        others = [k for k in WALLET_ACTIVITY_TYPES if k != "UNKNOWN"]
        df = df.where(stored == kind.upper()) if kind.upper() in others else df.where(stored.isNull() | ~stored.isin(others))
    if limit and limit > 0:
        df = top_k_per_key(df, address, [F.col(ts).desc(), F.col("id").desc()], limit)
    return df


def latest_per_key(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """The whole row with the greatest ``order`` per key, as a partial aggregate."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return packed.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def sort_keys(sort: str) -> list[Column]:
    """Listing orders by name, balance, activity or creation time."""
    return {
        "name": lambda: [F.col("name").asc_nulls_last()],
        "balance": lambda: [F.col("balance").desc_nulls_last()],
        "activity": lambda: [F.col("activity_count").desc()],
        "created": lambda: [F.col("created_at").desc()],
    }[sort]()


def list_registry(registry: DataFrame, sort: str = "created", tags: Sequence[str] | None = None,
                  program_id: str | None = None, active: bool | None = None) -> DataFrame:
    """Registry listing with its Active/Inactive label, filtered, ordered by the
    chosen key with an id tie-break."""
    df = registry
    if active is not None:
        df = df.where(F.col("is_active") == F.lit(active))
    if tags:
        df = df.where(F.arrays_overlap(F.col("tags"), F.array(*[F.lit(t) for t in tags])))
    if program_id is not None:
        df = df.where(F.col("program_id") == F.lit(program_id))
    df = df.withColumn("registry_status", F.when(F.col("is_active"), "Active").otherwise("Inactive"))
    return df.orderBy(*sort_keys(sort), F.col("id").asc())


def new_signatures(current: DataFrame, seen: DataFrame, keys: Sequence[str] = ("address", "signature")) -> DataFrame:
    """(address, signature) pairs not seen before."""
    return current.join(seen.select(*keys), list(keys), "left_anti")
