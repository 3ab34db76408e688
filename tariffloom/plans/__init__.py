"""Named queries over the fixture tables, each with SQL that gives the same result."""
