"""Job settings."""

from __future__ import annotations

from dataclasses import dataclass

MIB = 1 << 20


@dataclass(frozen=True)
class JobConfig:
    """How a job reads, deals out and orders its rows.

    inputs: paths that together form one relation (UNION ALL).
    logical_split: cut inputs at line ends (True) or read whole files only (False).
    randomized_partition: aggregate in two levels over salted keys, for skewed keys.
    num_reducers: partitions of the result; None leaves it to adaptive execution.
    split_bytes: size of input partitions, set for the session when a job reads; None leaves the session's own.
    drop_empty: a global aggregate over no rows gives no row instead of one row of nulls.
    """

    inputs: tuple[str, ...] = ()
    logical_split: bool = True
    randomized_partition: bool = False
    num_reducers: int | None = None
    salts: int = 16
    split_bytes: int | None = None
    drop_empty: bool = False
    log_level: int = 2

    def __post_init__(self) -> None:
        if self.num_reducers is not None and self.num_reducers < 1:
            raise ValueError("num_reducers must be at least 1")
        if self.salts < 1 or self.split_bytes is not None and self.split_bytes < 1:
            raise ValueError("salts and split_bytes must be positive")

    @property
    def spark_log_level(self) -> str:
        """1 info, 3 warn, anything else error."""
        return {1: "INFO", 3: "WARN"}.get(self.log_level, "ERROR")
