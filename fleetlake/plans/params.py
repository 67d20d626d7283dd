"""Fixed literals of the registered queries (never the clock)."""

# Indicator window and device (closed range, end at midnight: S1 default).
EVENT_START, EVENT_END, EVENT_VIN = "2024-01-05", "2024-01-12", "8"
TASK_START, TASK_END = "1997-01-01", "1997-12-31"
EXPORT_START, EXPORT_END = "2024-01-01", "2024-01-31"
EXPORT_LIMIT = 2500                 # stated by the caller; below the rows in range

PAGE_NO, PAGE_SIZE = 3, 20          # offset 40, limit 20

ID_WATERMARK = 5000                 # incremental id scan: event_id > 5000
TIME_WATERMARK = "2024-01-10 00:00:00"
TIME_UPPER = "2024-01-20 00:00:00"
DATE_WATERMARK = "1998-01-01"
DATE_RUN_DAY = "1999-01-01"         # upper bound = the day before

OFFSET_START = 99                    # bounded message read: after this offset ...
SEGMENT = 1000                       # offsets of one log segment
OFFSET_MAX = 1000                    # ... at most this many, as the caller states

UPSERT_OLD_BEFORE = "2024-01-20 00:00:00"   # old batch: events before this time
UPSERT_NEW_FROM = "2024-01-15 00:00:00"     # new batch: events from this time (overlap)
OLD_STAMP = "2024-01-31 00:00:00"
NEW_STAMP = "2024-02-01 00:00:00"

VALUE_SCALE = 2                     # decimals of events.value

RUN_DAY = "2024-01-30"              # "today" of the audit summary
AUDIT_USER_PART = "7"
RETENTION_DAYS, RETENTION_RUN_DAY = 10, "2024-01-30"

FK_CLOSED_REGION = "ASIA"           # fk_reject: registry rows of this region are closed

# Data-quality / error-limit rules (fixed values of the copy job).
MIN_VALUE = 0.05
ERROR_LIMIT_RECORDS, ERROR_LIMIT_RATIO = 0, 0.02
