"""Parameters the registered queries run with. The events span January 2024."""

AS_OF = "2024-01-31 00:00:00"
COUNT_START, COUNT_END = "2024-01-10 00:00:00", "2024-01-20 00:00:00"
DAY = "2024-01-15"
STATUS_AS_OF = "2024-01-15 12:34:56"
RETENTION_DAYS, ARCHIVE_DAYS = 20, 10
REPEAT_WINDOW, REPEAT_THRESHOLD = 6 * 3600, 3
BURST = {"window_seconds": 60, "threshold": 3, "cooldown_seconds": 300}
DENSE_BURST = {"window_seconds": 3600, "threshold": 5, "cooldown_seconds": 6 * 3600}
KEYWORD = "Error request"
DOC_KEYWORD = "license token"
