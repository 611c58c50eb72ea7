"""Scalar column helpers. All are built-in Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the ledger model.
LAMPORTS_PER_COIN = 1_000_000_000
CID_PREFIX = "bafybeib"
BASE32_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # RFC 4648, no padding
BASE58_PATTERN = "^[1-9A-HJ-NP-Za-km-z]{32,44}$"
UNKNOWN_BLOCKHASH = "unknown_blockhash"
UNNAMED = "Unnamed"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def saturating_sub(x, n) -> Column:
    """x - n floored at 0."""
    return F.greatest(_c(x) - n, F.lit(0))


def to_coin(lamports) -> Column:
    """lamports -> coin units as double (cast first: long / decimal literal is decimal)."""
    return _c(lamports).cast("double") / F.lit(float(LAMPORTS_PER_COIN))


def fee_text(lamports) -> Column:
    """fee with 9 decimals, or 'No fee' when zero."""
    return F.when(_c(lamports) == 0, F.lit("No fee")) \
        .otherwise(F.format_string("%.9f SOL", to_coin(lamports)))


def short_address(addr, head: int = 8, tail: int = 8) -> Column:
    """head...tail when longer than head+tail; never fails on short input."""
    a = _c(addr)
    return F.when(F.length(a) > head + tail,
                  F.concat(F.substring(a, 1, head), F.lit("..."), F.substring(a, -tail, tail))).otherwise(a)


def prefix(c, n: int) -> Column:
    """the first n characters (whole value when shorter)."""
    return F.substring(_c(c), 1, n)


def json_string_array(c) -> Column:
    """JSON text -> array<string>; malformed or missing -> empty array."""
    return F.coalesce(F.from_json(_c(c), "array<string>"), F.array().cast("array<string>"))


def display_time(ts, short: bool = False) -> Column:
    """F7."""
    return F.date_format(_c(ts), "MM-dd HH:mm:ss" if short else "yyyy-MM-dd HH:mm:ss")


def norm_kind(c) -> Column:
    """Case- and underscore-insensitive activity kind."""
    return F.lower(F.regexp_replace(_c(c), "_", ""))


def enum_or_unknown(c, allowed) -> Column:
    """a known enum value in upper case, else (null too) UNKNOWN."""
    u = F.upper(_c(c))
    return F.when(u.isin(list(allowed)), u).otherwise(F.lit("UNKNOWN"))


def name_or_default(c) -> Column:
    """F14."""
    return F.coalesce(_c(c), F.lit(UNNAMED))


def content_id(payload) -> Column:
    """'bafybeib' + base32 (RFC 4648, no padding) of the first 20 bytes of sha256(payload)."""
    return cid_of(F.sha2(_c(payload), 256))


def cid_of(checksum) -> Column:
    """F11 from the hex sha256; a stored column, since it is read eight times.

    20 bytes = 40 hex digits = 8 groups of 5 hex digits (20 bits) = 8 x 4 base32 digits.
    """
    h = _c(checksum)
    alphabet = F.lit(BASE32_ALPHABET)
    digits = []
    for i in range(8):
        v = F.conv(F.substring(h, i * 5 + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            digits.append(F.substr(alphabet, F.shiftright(v, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(F.lit(CID_PREFIX), *digits)


EPOCH_NTZ = "1970-01-01 00:00:00"


def unix_micros_ntz(ts) -> Column:
    """Microseconds since 1970-01-01 of a timestamp_ntz, its wall time read as UTC.

    Pure NTZ arithmetic: the result does not depend on the session time zone."""
    return F.timestamp_diff("MICROSECOND", F.lit(EPOCH_NTZ).cast("timestamp_ntz"), _c(ts))


def ntz_from_micros(us) -> Column:
    """Inverse of ``unix_micros_ntz``."""
    return F.timestamp_add("MICROSECOND", _c(us), F.lit(EPOCH_NTZ).cast("timestamp_ntz"))


# Fixed value: the base-58 alphabet (no 0, O, I, l), which is in ASCII order.
BASE58_ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
ADDRESS_BYTES = 32


def base58_number(n: int) -> str:
    """Base-58 digits of a number ('' for 0)."""
    out = ""
    while n:
        n, r = divmod(n, 58)
        out = BASE58_ALPHABET[r] + out
    return out


def address_bounds() -> list[tuple[str, str]]:
    """By number k of leading 1s: the smallest rest of a text that decodes to 32 bytes, and the first beyond."""
    return [(base58_number(256 ** (ADDRESS_BYTES - 1 - k)), base58_number(256 ** (ADDRESS_BYTES - k))) for k in range(ADDRESS_BYTES)]


def is_valid_address(c) -> Column:
    """Base-58 public key: the pattern holds and the text decodes to exactly 32 bytes.

    Each leading 1 is a zero byte. The rest is a number whose bytes fill up to 32 iff it lies between two
    powers of 256; as the alphabet is in ASCII order, numbers compare as (length, text) do.
    """
    a = _c(c)
    rest = F.regexp_replace(a, "^1+", "")
    k = F.length(a) - F.length(rest)
    low, high = (F.element_at(F.array(*(F.lit(b[i]) for b in address_bounds())), F.least(k, F.lit(ADDRESS_BYTES - 1)) + 1) for i in (0, 1))

    def at_least(x, y):
        return (F.length(x) > F.length(y)) | ((F.length(x) == F.length(y)) & (x >= y))

    inside = F.when(k < ADDRESS_BYTES, at_least(rest, low) & ~at_least(rest, high)).otherwise((k == ADDRESS_BYTES) & (rest == ""))
    return F.coalesce(a.rlike(BASE58_PATTERN) & inside, F.lit(False))
