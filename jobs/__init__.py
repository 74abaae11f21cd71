"""Jobs: ``python -m jobs.NAME --config FILE ...``. Each has a function that takes a session and plain paths."""
