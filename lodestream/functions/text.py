"""String expressions: sanitising, ids, reason text, time decay."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestream.functions.clock import MICROS, epoch_micros

# fixed values: the kept characters, the four accepted id spellings, and the reason format
KEPT_CHARACTERS = r"[^\p{IsAlphabetic}\p{N}\p{IsWhite_Space}\-_.,!?]"
UUID_FORMS = (
    "^("
    "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    "|[0-9a-fA-F]{32}"
    "|[{][0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}[}]"
    "|urn:uuid:[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
    ")$"
)
REASON_FORMAT = "Similar to your preferences (score: %.3f)"
TRENDING_FORMAT = "Personalized trending (score: %.3f)"
TRENDING_REASON = "Trending item"


def sanitize(text: Column, max_length: int | None = None) -> Column:
    """Drop every character outside the kept set, then keep max_length characters."""
    clean = F.regexp_replace(text, KEPT_CHARACTERS, "")
    return clean if max_length is None else F.substring(clean, 1, max_length)


def trim(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(UUID_FORMS), F.lit(False))


def surrogate_id(text: Column) -> Column:
    """Stable UUID-shaped id for a string: eight hash bytes, written twice.

    The hash is md5 rather than a language runtime's own hasher, so the bits
    differ from such a hasher but are the same in every engine.
    """
    half = F.substring(F.md5(text), 1, 16)
    return F.concat_ws(
        "-",
        F.substring(half, 1, 8),
        F.substring(half, 9, 4),
        F.substring(half, 13, 4),
        F.substring(half, 1, 4),
        F.substring(half, 5, 12),
    )


def reason(score: Column, fmt: str = REASON_FORMAT) -> Column:
    return F.format_string(fmt, F.round(score, 3))


def decay_weight(ts: Column, as_of: Column, rate: float) -> Column:
    """exp(-rate * hours) with the age taken in whole seconds."""
    micros = epoch_micros(as_of) - epoch_micros(ts)
    seconds = F.signum(micros) * F.floor(F.abs(micros) / F.lit(MICROS))
    return F.exp(F.lit(-float(rate)) * seconds / F.lit(3600.0))
