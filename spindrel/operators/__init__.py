"""Set-at-a-time operators: search, evaluation, duplicates, change log, artifacts."""
