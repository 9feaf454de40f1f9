"""Named queries over the test tables, their SQL twins, and the nightly run."""
