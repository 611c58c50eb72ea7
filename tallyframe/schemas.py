"""Spark schemas of landed records, and fixed values of the ledger model."""

from pyspark.sql import types as T

L, S = T.LongType(), T.StringType()
ARR_S = T.ArrayType(T.StringType())


def _st(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


# The JSON-lines transaction log: the sample record shape.
TX_JSONL = _st(("signature", S, True), ("slot", L, True), ("fee", L, True), ("status", S, True),
               ("programIds", ARR_S, True), ("timestamp", S, True))

# Second-chain latest-block response document.
FLOW_BLOCK_DOC = T.StructType([T.StructField("result", _st(
    ("height", L, True), ("id", S, True), ("timestamp", S, True)), True)])

# Fixed values of the ledger model.
WALLET_ACTIVITY_TYPES = ("SEND", "RECEIVE", "SWAP", "BUY", "SELL", "STAKE", "UNSTAKE", "UNKNOWN")
SYSTEM_PROGRAM = "11111111111111111111111111111111"
# Account change kinds in emission order: (activity_type, change_type, state field, value text suffix).
ACCOUNT_CHANGE_KINDS = (
    ("BALANCE_CHANGE", "BALANCE", "lamports", " lamports"),
    ("DATA_CHANGE", "DATA_SIZE", "data_size", " bytes"),
    ("OWNER_CHANGE", "OWNER", "owner", ""),
    ("EXECUTABLE_CHANGE", "EXECUTABLE", "executable", ""),
    ("RENT_EPOCH_CHANGE", "RENT_EPOCH", "rent_epoch", ""),
)

# Stored relations that are joined by slot.
SLOTS = _st(("slot", L, False), ("blockhash", S, True), ("parent_slot", L, True), ("finalized", T.BooleanType(), True),
            ("ts", T.TimestampNTZType(), True))
TRANSACTIONS = _st(("signature", S, False), ("slot", L, True), ("fee", L, True), ("status", S, True), ("program_id", S, True),
                   ("payer", S, True), ("amount", T.DoubleType(), True), ("ts", T.TimestampNTZType(), True))
SLOT_LEADERS = _st(("slot", L, False), ("leader_pubkey", S, True))
