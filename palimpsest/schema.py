"""Tables of a mutation history, and the fixed ids in them."""

from pyspark.sql import types as T

FORMAT_VERSION = 1


def _of(text: str) -> T.StructType:
    names = {"i": T.IntegerType(), "l": T.LongType(), "s": T.StringType(), "b": T.BinaryType()}
    return T.StructType([T.StructField(n, names[k]) for n, k in (x.split(":") for x in text.split())])


#: World, chunk key, milliseconds, sequence, position, states before and after, actor, cause and kind.
MUTATION = _of("w:i c:l ts:l seq:i x:i y:i z:i b:i a:i actor:i cause:i kind:i")
GAP = _of("from_ts:l to_ts:l reason:i dropped:l detail:s")
EXCLUSION = _of("actor:i from_ts:l to_ts:l")
AUDIT = _of("action:s shard_id:i affected:l")
BLOB = _of("id:s version:i payload:b")
BLOB_REF = _of("w:i c:l ts:l seq:i actor:i blob_id:s")
KEY = ["w", "c", "ts", "seq"]
POSITION = ["w", "x", "y", "z"]

#: Ids in stored rows.
CAUSES = {0: "UNKNOWN", 1: "BREAKING", 2: "PLACING", 3: "ROLLBACK"}
KINDS = {1: "BLOCK", 14: "GAP", 15: "HEARTBEAT"}
REASONS = {1: "OVERFLOW", 2: "CRASH_WINDOW", 3: "QUARANTINE", 4: "NOT_CAPTURED", 5: "EXPIRED", 6: "PURGED"}
STATES = {1: "RUNNING", 2: "DONE", 3: "PARTIAL", 4: "FAILED", 5: "CANCELLED"}
REFUSING = (3, 5, 6)


class StoreError(Exception):
    """code: LOCKED, CORRUPT, DISK, CONTENDED or INTERNAL."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code
