"""DataFrame -> DataFrame operators; every ordered operator takes key columns."""
