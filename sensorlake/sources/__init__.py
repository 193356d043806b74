"""Sources and sinks: message streams, the stored table, CSV import/export."""

from sensorlake.sources.csv import export_csv, import_csv
from sensorlake.sources.messages import (
    decode_messages,
    encode_messages,
    kafka_options,
    read_messages,
    split_malformed,
    write_messages,
)
from sensorlake.sources.table import append_result, read_table

__all__ = [
    "append_result",
    "decode_messages",
    "encode_messages",
    "export_csv",
    "import_csv",
    "kafka_options",
    "read_messages",
    "read_table",
    "split_malformed",
    "write_messages",
]
