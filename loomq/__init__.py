"""An analytics engine on PySpark: a compact SQL dialect, a versioned table store, and corpus operators."""
