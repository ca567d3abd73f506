"""Where tables come from and go to: the versioned table store and its locks."""
