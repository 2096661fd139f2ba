"""Named queries over the test tables, each with the same question in SQL."""
