"""Column functions."""

from keyfold.functions.scalars import (
    composite_key,
    json_number,
    lenient_int,
    normalised_date,
    partition_id,
    quirk_date,
    round_half_away,
    salt,
    words,
)

__all__ = ["composite_key", "json_number", "lenient_int", "normalised_date", "partition_id", "quirk_date", "round_half_away", "salt", "words"]
