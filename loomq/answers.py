"""What statements and the wire protocol answer. Clients read these texts, so they stay as they are."""

from __future__ import annotations

# statements
TABLE_CREATED, TABLE_DROPPED = "Table '{}' created", "Table '{}' dropped"
TABLE_EXISTS, TABLE_MISSING = "Table '{}' already exists", "Table '{}' does not exist"
INDEX_CREATED, INDEX_EXISTS = "Index '{}' created on {}({})", "Index '{}' already exists"
CHANGED, SELECTED = "{} row(s) {}", "{} row(s)"
BEGUN, IN_PROGRESS = "BEGIN (txn {})", "A transaction is already in progress"

# the wire protocol
GOODBYE, EXPECTED_AUTH = "Goodbye", "Expected auth message"
AUTHENTICATED, REFUSED = "Authenticated as '{}'", "Authentication failed"
TOO_LARGE = "Message too large: {}"
