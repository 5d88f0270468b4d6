"""Sources and sinks: metadata stores, catalogs, dumps, tables over files, Spark catalog and JDBC, dBase files."""
