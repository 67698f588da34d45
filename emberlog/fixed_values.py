"""Fixed values.

Everything here is part of the observable contract (accepted domains, limits, patterns and reason texts), so
it must equal the contract letter for letter. Nothing in this module is computed.
"""

# Levels, bucket sizes and grouping columns a request may name.
LEVELS = ("debug", "info", "warn", "error")
BUCKETS = {"1m": "1 minute", "5m": "5 minutes", "1h": "1 hour", "1d": "1 day"}
GROUP_COLUMNS = ("service", "level")

# Entry validation.
ENTRY_TIMESTAMP_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
MAX_FUTURE_SECONDS = 5 * 60
MAX_SERVICE_LENGTH = 100
MAX_MESSAGE_LENGTH = 1000

# Reasons; the three with a raw value put it between the quotes.
REASON_ENTRY = "invalid entry"
REASON_TIMESTAMP_MISSING = "timestamp is required"
REASON_TIMESTAMP_INVALID = "invalid timestamp: '"
REASON_TIMESTAMP_FUTURE = "timestamp is too far in the future: '"
REASON_LEVEL = "invalid level: '"
REASON_SERVICE_MISSING = "service is required"
REASON_SERVICE_EMPTY = "service must be a non-empty string"
REASON_MESSAGE_MISSING = "message is required"
REASON_MESSAGE_EMPTY = "message must be a non-empty string"
REASON_ATTRIBUTES = "attributes must be a flat object with string, number, or boolean values"
REASON_ENVELOPE = "request body must be an object with a non-empty 'logs' array"

# Request parameters.
DEFAULT_LIMIT = 100
MIN_LIMIT = 1
MAX_LIMIT = 1000
# UTC only, seconds and fraction optional.
QUERY_TIMESTAMP_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?Z$"
CURSOR_ID_PATTERN = r"^\d+$"
ERROR_RANGE = "until must not be earlier than since"
ERROR_CURSOR = "invalid cursor"
ERROR_ATTRIBUTE_KEY = "invalid attribute filter key"

# White space that trimming removes: ASCII controls 9-13, space, no-break space, the Unicode space separators,
# line and paragraph separators and the byte-order mark.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# Ingestion and retention defaults.
FLUSH_INTERVAL = "1 second"
DEFAULT_RETENTION_DAYS = 30
RETENTION_SETTING = "RETENTION_DAYS"
ERROR_RETENTION = "invalid RETENTION_DAYS value"
