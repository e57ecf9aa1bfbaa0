from tallymill.functions.columns import (
    bucket,
    decade_label,
    epoch_micros,
    is_missing,
    main_value,
    round_to,
    seconds_between,
    timestamp_from_epoch,
)
from tallymill.functions.measures import Measure, count_rows, measure_column

__all__ = [
    "Measure",
    "bucket",
    "count_rows",
    "decade_label",
    "epoch_micros",
    "is_missing",
    "main_value",
    "measure_column",
    "round_to",
    "seconds_between",
    "timestamp_from_epoch",
]
