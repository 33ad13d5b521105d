"""Every analysis as a named query over the test tables, with the same as DuckDB SQL."""
