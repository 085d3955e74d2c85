"""Table schemas. Postcodes are strings and times carry no zone in every table."""

from __future__ import annotations

# CSV files as published: header names, in file order.
PLANNED_CSV = (
    "Postcode STRING, outage_start_date_time STRING, outage_end_date_time STRING, "
    "reason_for_outage STRING, Suburb STRING"
)
POSTCODES_CSV = "Postcode STRING, Suburb STRING"
HISTORY_CSV = (
    "Postcode STRING, Suburb STRING, Weather_Conditions STRING, Field_Staff STRING, Outage_StartTime STRING, "
    "Outage_EndTime STRING, Outage_Hours STRING, Day STRING, DOW STRING, Month STRING"
)

# Tables the library works on.
PLANNED = "postcode STRING, start_ts TIMESTAMP_NTZ, end_ts TIMESTAMP_NTZ, reason STRING, suburb STRING"
POSTCODES = "postcode STRING, suburb STRING"
HISTORY = (
    "postcode STRING, suburb STRING, condition STRING, staff INT, start_ts TIMESTAMP_NTZ, "
    "end_ts TIMESTAMP_NTZ, hours DOUBLE, day INT, dow STRING, month STRING"
)
REQUESTS = (
    "request_id BIGINT, postcode STRING, start_date DATE, end_date DATE, asked_at TIMESTAMP_NTZ, condition STRING"
)
WEATHER = "postcode STRING, observed_at TIMESTAMP_NTZ, condition_text STRING, temp_c DOUBLE"
CHUNKS = "chunk_id BIGINT, doc_id BIGINT, chunk_no INT, text STRING"
TRACK = "file_name STRING"
TURNS = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
EVENTS = (
    "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
)

# What the binary file source gives.
BINARY_FILE = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"

# They must equal the reference's for right results.
CONDITIONS = ("Fine_Conditions", "Rain", "Storms", "High Temperature")
ADVERSE_CONDITIONS = ("Rain", "Storms", "High Temperature")
REASONS = (
    "Planned maintenance",
    "Road and commercial work",
    "Routine inspection",
    "Equipment failure",
    "Power grid upgrade",
)
NOT_SUPPORTED = "Postcode not supported"
