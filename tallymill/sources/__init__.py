from tallymill.sources.files import (
    literal_rows,
    read_csv,
    read_csv_split,
    read_first,
    read_lines,
    read_table,
    register_view,
    spread,
    write_csv,
)
from tallymill.sources.streams import MESSAGE_SCHEMA, read_sample_stream, read_sensor_stream
from tallymill.sources.synthetic import add_synthetic_columns, synth_table

__all__ = [
    "MESSAGE_SCHEMA",
    "add_synthetic_columns",
    "literal_rows",
    "read_csv",
    "read_csv_split",
    "read_first",
    "read_lines",
    "read_sample_stream",
    "read_sensor_stream",
    "read_table",
    "register_view",
    "spread",
    "synth_table",
    "write_csv",
]
